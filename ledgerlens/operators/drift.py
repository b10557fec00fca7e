"""Population-stability drift on long-form observations ``(..., feature, value)``.

Features are rows, not columns: one shuffle on ``(feature, class)`` with
map-side partial counts serves any number of features. The reference profile
(bounds and class shares per feature) has one row per feature and is joined
(broadcast) to the observations; its size is features x 10 numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.columns import psi_band, shift_clip
from ledgerlens.functions.rounding import round_dec
from ledgerlens.operators.ordered import percentile_cont
from ledgerlens.session import checkpointed, materialised

# ---------------------------------------------------------------- fixed values
# Inner deciles, floor of a class share inside the PSI, rounding of the stored
# profile and of the PSI before banding.
DECILES = [round(0.1 * i, 1) for i in range(1, 10)]
EPSILON = 1e-4
PROFILE_DECIMALS = 6
PSI_DECIMALS = 4
MISSING_DECIMALS = 4


def observations(frame: DataFrame, features: dict[str, Column], keep: list[str]) -> DataFrame:
    """Long form: one row per (row, feature); missing values stay as NULL rows."""
    entries = F.array(*[F.struct(F.lit(name).alias("feature"), expr.cast("double").alias("value"))
                        for name, expr in features.items()])
    return frame.select(*keep, F.inline(entries))


def class_of(bounds: Column, value: Column) -> Column:
    """Number of bounds <= value (a value on a bound goes to the upper class)."""
    return F.size(F.filter(bounds, lambda b: b <= value))


def decile_bounds(obs: DataFrame) -> DataFrame:
    """Inner deciles (linear interpolation) of the non-missing values, de-duplicated and sorted."""
    q = percentile_cont(obs, "value", DECILES, ["feature"], prefix="q", few_groups=True)
    cols = [F.col(f"q{round(p * 100)}") for p in DECILES]
    return q.select("feature", F.array_sort(F.array_distinct(F.array(*cols))).alias("bounds"))


def class_counts(obs: DataFrame, bounds: DataFrame, group_cols: list[str] | tuple = ()) -> DataFrame:
    """``(group..., feature, class, _cnt)``: rows per class, the missing values as class NULL, from one pass over the
    observations, written once for the shares and missing rates made from them.

    The class is ``class_of`` as a sum of as many comparisons as the longest array of bounds has: Spark compiles these,
    but calls the lambda of an array function for each bound of each row. NaN, the greatest value, stands for the bounds
    that a feature has less than that.
    """
    most = bounds.agg(F.max(F.size("bounds"))).first()[0] or 0                     # bounds has one row per feature
    b = F.broadcast(bounds.select("feature", F.size("bounds").alias("_size"), *[
        F.coalesce(F.get("bounds", F.lit(i)), F.lit(float("nan"))).alias(f"_b{i}") for i in range(most)]))
    reached = sum([(F.col(f"_b{i}") <= F.col("value")).cast("int") for i in range(most)], F.lit(0))
    found = F.when(F.col("value").isNotNull(), F.least("_size", reached))
    counts = obs.join(b, "feature").groupBy(*group_cols, "feature", found.alias("class")).agg(F.count(F.lit(1)).alias("_cnt"))
    return materialised(counts, "class-counts")


def missing_rates(counts: DataFrame, name: str, decimals: int, group_cols: list[str] | tuple = ()) -> DataFrame:
    """Share of the missing values per group and feature, from ``class_counts``."""
    absent = F.sum(F.when(F.col("class").isNull(), F.col("_cnt")).otherwise(0))
    return counts.groupBy(*group_cols, "feature").agg(round_dec(absent / F.sum("_cnt"), decimals).alias(name))


def class_shares(obs: DataFrame, bounds: DataFrame, group_cols: list[str] | tuple = (), counts: DataFrame | None = None) -> DataFrame:
    """Share of the non-missing values per class, every class present (empty -> 0).

    Returns ``(group..., feature, class, share, n_values)``; ``n_values`` is 0
    when the feature has no non-missing value in the group. ``counts``: the ``class_counts`` of the observations, if made already.
    """
    g = list(group_cols)
    b = F.broadcast(bounds.select("feature", "bounds"))
    counts = class_counts(obs, bounds, g) if counts is None else counts
    present = counts.select(*g, "feature").distinct() if g else bounds.select("feature")
    grid = present.join(b, "feature").select(*g, "feature", F.explode(F.sequence(F.lit(0), F.size("bounds"))).alias("class"))
    full = grid.join(counts, g + ["feature", "class"], "left").fillna(0, ["_cnt"])
    tot = full.groupBy(*g, "feature").agg(F.sum("_cnt").alias("n_values"))
    full = full.join(tot, g + ["feature"])
    share = F.when(F.col("n_values") == 0, F.lit(0.0)).otherwise(F.col("_cnt") / F.col("n_values"))
    return full.select(*g, "feature", F.col("class").cast("int").alias("class"), share.alias("share"), "n_values")


def reference_profile(obs: DataFrame, importance: DataFrame | None = None) -> DataFrame:
    """``(feature, bounds, proportions, missing, importance)``; a feature without any
    non-missing value has no deciles and is left out."""
    # one row per feature: written once so the later joins do not recompute the deciles
    bounds = checkpointed(decile_bounds(obs))
    counts = class_counts(obs, bounds)
    shares = class_shares(obs, bounds, counts=counts)
    props = shares.groupBy("feature").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("class", "share"))),
                    lambda s: round_dec(s.getField("share"), PROFILE_DECIMALS)).alias("proportions"))
    missing = missing_rates(counts, "missing", PROFILE_DECIMALS)
    prof = bounds.join(props, "feature").join(missing, "feature")
    if importance is not None:
        prof = prof.join(importance, "feature", "left")
    else:
        prof = prof.withColumn("importance", F.lit(None).cast("double"))
    return checkpointed(prof.select("feature", "bounds", "proportions", "missing", "importance"))


def psi(obs: DataFrame, profile: DataFrame, group_cols: list[str] | tuple = (), counts: DataFrame | None = None) -> DataFrame:
    """PSI = sum over classes of (p - r) ln(p / r), both floored at 1e-4, no renormalisation;
    rounded to 4 decimals, then banded. ``counts``: see ``class_shares``."""
    g = list(group_cols)
    prod = class_shares(obs, profile, g, counts)
    ref = F.broadcast(profile.select("feature", F.posexplode("proportions").alias("class", "r")))
    j = prod.join(ref, ["feature", "class"])
    p = F.greatest(F.col("share"), F.lit(EPSILON))
    r = F.greatest(F.col("r"), F.lit(EPSILON))
    out = j.groupBy(*g, "feature").agg(F.sum((p - r) * F.log(p / r)).alias("_psi"))
    out = out.withColumn("psi", round_dec(F.col("_psi"), PSI_DECIMALS)).drop("_psi")
    return out.withColumn("band", psi_band("psi"))


def psi_of_counts(counts: DataFrame, profile: DataFrame, group_cols: list[str]) -> DataFrame:
    """PSI per group and feature from ``(group..., feature, class, n)``, classes without a row counting 0."""
    g = [*group_cols, "feature"]
    per = counts.groupBy(*g).agg(F.map_from_entries(F.collect_list(F.struct("class", "n"))).alias("_n"), F.sum("n").alias("_all"))
    j = per.join(F.broadcast(profile.select("feature", F.posexplode("proportions").alias("class", "r"))), "feature")
    share = F.coalesce(F.try_divide(F.try_element_at("_n", F.col("class")), F.col("_all")), F.lit(0.0))
    p, r = F.greatest(share, F.lit(EPSILON)), F.greatest(F.col("r"), F.lit(EPSILON))
    out = j.groupBy(*g).agg(round_dec(F.sum((p - r) * F.log(p / r)), PSI_DECIMALS).alias("psi"))
    return out.withColumn("band", psi_band("psi"))


def psi_of_classes(classes: Column, proportions: Column) -> Column:
    """PSI of a group and feature from its array of (class, n) and the reference's shares, classes without a row counting 0;
    NULL without reference shares."""
    total = F.aggregate(classes, F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
    found = F.map_from_entries(classes)

    def term(reference, i):
        share = F.coalesce(F.try_divide(F.try_element_at(found, i), total), F.lit(0.0))
        p, r = F.greatest(share, F.lit(EPSILON)), F.greatest(reference, F.lit(EPSILON))
        return (p - r) * F.log(p / r)
    return round_dec(F.aggregate(F.transform(proportions, term), F.lit(0.0), lambda a, x: a + x), PSI_DECIMALS)


def shifted_psi(obs: DataFrame, profile: DataFrame, shifts: list[float], shifted: list[str]) -> DataFrame:
    """``(shift, feature, psi, band)``: PSI of every feature of the profile if the values of the features ``shifted`` were
    smaller by each shift (then clipped to 0..1).

    No row is multiplied: a row's classes under all shifts are one array, which steps through at most shifts x bounds + 1
    different arrays as the value grows, so counting the arrays is one map-side combined aggregate. A feature that is not
    shifted has one class. The arrays are expanded after counting.
    """
    info = F.broadcast(profile.select("feature", "bounds"))            # one row per feature
    moves = F.when(F.col("feature").isin(shifted), F.array(*[F.lit(float(s)) for s in shifts]))
    classes = F.coalesce(F.transform(moves, lambda s: class_of(F.col("bounds"), shift_clip("value", s))),
                         F.array(class_of(F.col("bounds"), F.col("value"))))
    rows = obs.filter(F.col("value").isNotNull()).join(info, "feature")
    counts = rows.groupBy("feature", classes.alias("classes")).agg(F.count(F.lit(1)).alias("n"))
    per = counts.select("feature", "classes", "n", F.posexplode(F.array(*[F.lit(float(s)) for s in shifts])).alias("i", "shift"))
    per = per.select("shift", "feature", F.coalesce(F.get("classes", F.col("i")), F.get("classes", F.lit(0))).alias("class"), "n")
    none = profile.select(F.explode(F.array(*[F.lit(float(s)) for s in shifts])).alias("shift"), "feature",
                          F.lit(0).alias("class"), F.lit(0).cast("bigint").alias("n"))     # a feature without any value
    per = per.unionByName(none).groupBy("shift", "feature", "class").agg(F.sum("n").alias("n"))
    return psi_of_counts(per, profile, ["shift"])


def drift_table(obs: DataFrame, profile: DataFrame, group_cols: list[str] | tuple = ()) -> DataFrame:
    """PSI, band, missing rates and importance per feature of the profile. Without
    groups the profile drives the join, so a feature with no production row still
    gets a PSI (all-zero shares) and a NULL production missing rate."""
    g = list(group_cols)
    counts = class_counts(obs, profile, g)
    p = psi(obs, profile, g, counts)
    miss = missing_rates(counts, "missing_production", MISSING_DECIMALS, g)
    info = profile.select("feature", F.col("missing").alias("missing_reference"), "importance")
    if g:
        out = p.join(miss, g + ["feature"], "left").join(F.broadcast(info), "feature")
    else:
        out = info.join(p, "feature", "left").join(miss, "feature", "left")
        zero = _psi_of_zero(profile)
        out = out.join(zero, "feature").select(
            "*", F.coalesce("psi", "psi_zero").alias("_p")).drop("psi", "band", "psi_zero") \
            .withColumnRenamed("_p", "psi").withColumn("band", psi_band("psi"))
    return out.select(*g, "feature", "psi", "band", "missing_reference", "missing_production", "importance")


def _psi_of_zero(profile: DataFrame) -> DataFrame:
    """PSI of an empty production distribution (every share floored at 1e-4)."""
    r = F.greatest(F.col("r"), F.lit(EPSILON))
    e = F.lit(EPSILON)
    x = profile.select("feature", F.posexplode("proportions").alias("class", "r"))
    return x.groupBy("feature").agg(round_dec(F.sum((e - r) * F.log(e / r)), PSI_DECIMALS).alias("psi_zero"))
