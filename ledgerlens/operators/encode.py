"""Category encoders: catalogue, one-hot indicators, category shares, factorisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.ranges import running_totals
from ledgerlens.session import materialised

# Upper bound on the categories of one column: one-hot output columns are
# created per category, so a larger catalogue means the column is not categorical.
MAX_CATEGORIES = 1000


def _ref(name: str) -> Column:
    return F.col(f"`{name}`")


def string_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    return [n for n, t in df.dtypes if t == "string" and n not in exclude]


def fit_catalogue(df: DataFrame, columns: list[str]) -> dict[str, list[str]]:
    """Sorted distinct non-missing values per column, in one distributed pass.

    ``collect_set`` is combined map-side, so only the distinct values travel.
    The size is checked before anything reaches the driver.
    """
    if not columns:
        return {}
    sizes = df.agg(*[F.countDistinct(_ref(c)).alias(c) for c in columns]).first().asDict()
    too_big = {c: n for c, n in sizes.items() if n > MAX_CATEGORIES}
    if too_big:
        raise ValueError(f"not categorical (more than {MAX_CATEGORIES} values): {too_big}")
    row = df.agg(*[F.array_sort(F.collect_set(_ref(c))).alias(c) for c in columns]).first()
    return {c: list(row[c]) for c in columns}


def indicator_name(col: str, value: str | None) -> str:
    return f"{col}_{'nan' if value is None else value}"


def one_hot(df: DataFrame, catalogue: dict[str, list[str]], nan_as_category: bool = True
            ) -> tuple[DataFrame, list[str]]:
    """Replace each catalogued string column by 0/1 indicators ``col_value``.

    With ``nan_as_category`` a ``col_nan`` indicator exists even when nothing is
    missing; without it a missing value gives all zeros. A value outside the
    catalogue also gives all zeros (fixed output schema).
    """
    new_cols: list[str] = []
    exprs: list[Column] = []
    for name in df.columns:
        if name not in catalogue:
            exprs.append(_ref(name))
            continue
        for value in catalogue[name]:
            out = indicator_name(name, value)
            exprs.append(F.when(_ref(name) == F.lit(value), 1).otherwise(0).alias(out))
            new_cols.append(out)
        if nan_as_category:
            out = indicator_name(name, None)
            exprs.append(F.when(_ref(name).isNull(), 1).otherwise(0).alias(out))
            new_cols.append(out)
    return df.select(*exprs), new_cols


def category_share(df: DataFrame, key: str, column: str, values: list[str], prefix: str = "") -> DataFrame:
    """Share of each category among all rows of the key (missing rows count in the total)."""
    return df.groupBy(key).agg(*[
        F.avg(F.when(_ref(column) == F.lit(v), 1.0).otherwise(0.0)).alias(f"{prefix}{column}_{v}_MEAN")
        for v in values])


def first_seen_codes(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """``(column, value, code)``: the distinct non-missing values of each column, as text, numbered by where
    they first appear in ``order``.

    The columns are stacked, so one ``groupBy(column, value)`` (combined map-side) finds every first
    appearance; the numbering is a running total over range partitions, whatever the number of values.
    """
    at = [f"_o{i}" for i in range(len(order))]
    stacked = df.select(
        *[_ref(o).alias(n) for o, n in zip(order, at)],
        F.inline(F.array(*[F.struct(F.lit(c).alias("column"), _ref(c).cast("string").alias("value")) for c in columns])))
    firsts = (stacked.filter(F.col("value").isNotNull()).groupBy("column", "value")
              .agg(F.min(F.struct(*at)).alias("_first"), F.lit(1).alias("_one")))
    numbered = running_totals(firsts, ["_first", "value"], ["_one"], ["column"])
    return numbered.select("column", "value", (F.col("cum__one") - 1).cast("bigint").alias("code"))


def factorize(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """Replace each column by integer codes in order of first appearance (explicit ``order``), missing = -1.

    The code table is written once and joined to each column by value; Spark broadcasts it when it is small.
    """
    codes = materialised(first_seen_codes(df, columns, order), "codes")
    out = df
    for i, name in enumerate(columns):
        table = codes.filter(F.col("column") == name).select(F.col("value").alias(f"_v{i}"), F.col("code").alias(f"_c{i}"))
        out = out.join(table, _ref(name).cast("string") == F.col(f"_v{i}"), "left")
    coded = {name: F.coalesce(F.col(f"_c{i}"), F.lit(-1).cast("bigint")) for i, name in enumerate(columns)}
    return out.select(*[coded[c].alias(c) if c in coded else _ref(c) for c in df.columns])


def factorize_few(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """``factorize`` for columns of few values (at most ``MAX_CATEGORIES`` together, else the query fails): nothing runs while the
    plan is built, and no row of ``df`` is shuffled or joined.

    The first appearances are one aggregate; its few rows become a scalar subquery, a map from value to code per column.
    """
    stacked = df.select(
        *[_ref(o).alias(f"_o{i}") for i, o in enumerate(order)],
        F.inline(F.array(*[F.struct(F.lit(c).alias("column"), _ref(c).cast("string").alias("value")) for c in columns])))
    firsts = (stacked.filter(F.col("value").isNotNull()).groupBy("column", "value")
              .agg(F.min(F.struct(*[f"_o{i}" for i in range(len(order))])).alias("first")).limit(MAX_CATEGORIES + 1))
    seen = F.array_sort(F.collect_list(F.struct("first", "column", "value")))
    listed = firsts.agg(seen.alias("seen")).select(F.when(F.size("seen") <= MAX_CATEGORIES, F.col("seen")).otherwise(
        F.raise_error(F.lit(f"not categorical (more than {MAX_CATEGORIES} values): {columns}"))).alias("seen"))

    def values_of(column):
        return F.transform(F.filter("seen", lambda x: x["column"] == F.lit(column)), lambda x: x["value"])
    values = [values_of(c).alias(f"v{i}") for i, c in enumerate(columns)]
    codes = listed.select(F.struct(*values).alias("values")).scalar()
    coded = {c: F.coalesce(F.array_position(codes.getField(f"v{i}"), _ref(c).cast("string")), F.lit(0)) - 1 for i, c in enumerate(columns)}
    return df.select(*[coded[c].cast("bigint").alias(c) if c in coded else _ref(c) for c in df.columns])
