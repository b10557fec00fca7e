"""Model evaluation on (label, score) tables: business cost, confusion metrics,
threshold sweep, rank AUC, score comparison. Every operator is one or two
aggregations; nothing is ordered globally in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.ordered import attach, exact_percentiles, ordered_cumsum

# ---------------------------------------------------------------- fixed values
# Business cost weights (a missed default costs ten refused good customers), the
# decision threshold, the sweep grid 0.05 ... 0.95 step 0.05 and the gap tolerance.
COST_FN = 10
COST_FP = 1
THRESHOLD = 0.10
SWEEP = [round(0.05 * i, 2) for i in range(1, 20)]
GAP_TOLERANCE = 1e-4


def scored(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """The rows that take part in a metric: a row without a label, or whose score is NULL or NaN, counts nowhere."""
    return df.filter(F.col(y).isNotNull() & F.col(p).isNotNull() & ~F.isnan(F.col(p).cast("double")))


def confusion_columns(y: str = "y", p: str = "p", threshold: float | Column = THRESHOLD) -> list[Column]:
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    pred = F.col(p) >= t
    pos = F.col(y) == 1
    return [F.count_if(pos & pred).alias("tp"), F.count_if(~pos & pred).alias("fp"),
            F.count_if(pos & ~pred).alias("fn"), F.count_if(~pos & ~pred).alias("tn")]


def _div0(a: Column, b: Column) -> Column:
    """a / b, 0 when the denominator is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


def metrics_from_confusion(df: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    precision = _div0(tp, tp + fp)
    recall = _div0(tp, tp + fn)
    f1 = F.when(precision + recall == 0, F.lit(0.0)).otherwise(2 * precision * recall / (precision + recall))
    return df.select("*",
                     _div0(tp + tn, n).alias("accuracy"), precision.alias("precision"), recall.alias("recall"),
                     f1.alias("f1"), (COST_FN * fn + COST_FP * fp).alias("cost"),
                     _div0(tp + fp, n).alias("refusal_rate"))


def metrics_at_threshold(scores: DataFrame, threshold: float, y: str = "y", p: str = "p",
                         group_cols: list[str] | tuple = ()) -> DataFrame:
    agg = scored(scores, y, p).groupBy(*group_cols).agg(*confusion_columns(y, p, threshold))
    return metrics_from_confusion(agg.withColumn("threshold", F.lit(float(threshold))))


def business_cost(scores: DataFrame, threshold: float = THRESHOLD, y: str = "y", p: str = "p") -> DataFrame:
    c = scored(scores, y, p).agg(*confusion_columns(y, p, threshold))
    return c.select(F.lit(float(threshold)).alias("threshold"), "fn", "fp",
                    (COST_FN * F.col("fn") + COST_FP * F.col("fp")).alias("cost"))


def threshold_sweep(scores: DataFrame, thresholds: list[float] = SWEEP, y: str = "y", p: str = "p",
                    group_cols: list[str] | tuple = ()) -> DataFrame:
    """Confusion counts at every threshold in one pass, for every group.

    One aggregation holds a pair of conditional counts per grid threshold
    (literal comparisons, so no float-division boundary error); it is combined
    map-side, so one row per task is shuffled. The one-row result is unpivoted
    to one row per threshold. No join with the grid.
    """
    pos = F.col(y) == 1
    counts = [F.count_if(pos).alias("_P"), F.count_if(~pos).alias("_N")]
    for i, t in enumerate(thresholds):
        hit = F.col(p) >= F.lit(float(t))
        counts += [F.count_if(pos & hit).alias(f"_tp{i}"), F.count_if(~pos & hit).alias(f"_fp{i}")]
    per_threshold = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_tp{i}").alias("tp"),
                                       F.col(f"_fp{i}").alias("fp")) for i, t in enumerate(thresholds)])
    long = scored(scores, y, p).groupBy(*group_cols).agg(*counts).select(*group_cols, "_P", "_N", F.inline(per_threshold))
    out = long.select(
        *group_cols, "threshold", F.col("tp").cast("bigint").alias("tp"), F.col("fp").cast("bigint").alias("fp"),
        (F.col("_P") - F.col("tp")).cast("bigint").alias("fn"), (F.col("_N") - F.col("fp")).cast("bigint").alias("tn"))
    return out.select("*", (COST_FN * F.col("fn") + COST_FP * F.col("fp")).alias("cost"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """Arg-min of the cost, first (lowest) threshold on ties."""
    best = F.min_by(F.struct("threshold", "cost"), F.struct("cost", "threshold"))
    return sweep.agg(best.alias("b")).select("b.threshold", "b.cost")


def pairs(n_pos: Column, n_neg: Column) -> Column:
    """Number of (positive, negative) pairs, as a double: it outgrows a bigint at a few billion rows a class."""
    return n_pos.cast("double") * n_neg


def auc_rank(scores: DataFrame, y: str = "y", p: str = "p", group_cols: list[str] | tuple = ()) -> DataFrame:
    """Mann-Whitney AUC with ties counting half: per distinct score the negatives ranked
    below come from a distributed prefix sum over the distinct scores."""
    g = list(group_cols)
    per_score = scored(scores, y, p).groupBy(*g, p).agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg"))
    cum = ordered_cumsum(per_score, p, ["neg"], g)
    u = cum.groupBy(*g).agg(
        F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") + F.col("neg") / 2.0)).alias("_u"),
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    auc = F.when((F.col("n_pos") == 0) | (F.col("n_neg") == 0), F.lit(None).cast("double")) \
        .otherwise(F.col("_u") / pairs(F.col("n_pos"), F.col("n_neg")))
    return u.select(*g, auc.alias("auc"), "n_pos", "n_neg")


def compare_scores(a: DataFrame, b: DataFrame, id_col: str, pa: str, pb: str, threshold: float = THRESHOLD) -> DataFrame:
    """Two engines' scores on the same rows (joined on the row id): gap statistics and decision flips."""
    j = a.select(id_col, F.col(pa).alias("_a")).join(b.select(id_col, F.col(pb).alias("_b")), id_col, "inner")
    gap = F.abs(F.col("_a") - F.col("_b"))
    flip = (F.col("_a") >= threshold) != (F.col("_b") >= threshold)
    g = j.select(gap.alias("gap"), flip.alias("flip"))
    agg = g.agg(F.max("gap").alias("max_gap"), F.avg("gap").alias("mean_gap"),
                F.count_if(F.col("gap") > GAP_TOLERANCE).alias("n_gap_above_tol"),
                F.count_if("flip").alias("decision_flips"), F.count(F.lit(1)).alias("n"))
    out = attach(agg, exact_percentiles(g, "gap", {"p99_gap": 0.99}))
    return out.select("max_gap", "mean_gap", "p99_gap", "n_gap_above_tol", "decision_flips", "n")
