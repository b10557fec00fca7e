"""Training, out-of-fold scoring and batch scoring with MLlib pipelines.

The fold-tagged training table is written once with ``checkpoint()`` (into the
cluster's ``spark.checkpoint.dir``): it cuts the long feature-table lineage and
every fold fit reads it instead of recomputing the aggregates. MLlib trees do
not route missing values, so numeric features are median-imputed
(``Imputer``, approximate medians) before the vector is assembled.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import Imputer, SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators import evaluate as E
from ledgerlens.operators.sampling import hash_key, stratified_folds
from ledgerlens.session import checkpointed, ensure_checkpoint_dir

LABEL = "label"
WEIGHT = "weight"
MEDIANS_AT_ONCE = 50


def numeric_features(df: DataFrame, exclude: tuple[str, ...]) -> list[str]:
    return [n for n, t in df.dtypes if n not in exclude and t in ("double", "float", "int", "bigint")]


def training_table(features: DataFrame, key: str, target: str, folds: int = 3) -> tuple[DataFrame, list[str]]:
    """Labelled rows with double features, class-balanced weights and a stratified fold column.

    Weights and folds are found from keys and labels alone: of a lazy feature table Spark then leaves out the joined
    aggregates. The features are computed once, in the pass that adds both, shuffled once and checkpointed for the repeated fits.
    """
    ensure_checkpoint_dir(features.sparkSession)
    cols = numeric_features(features, (key, target))
    lab = features.filter(F.col(target).isNotNull()).selectExpr(
        f"`{key}` AS id", f"CAST(`{target}` AS DOUBLE) AS {LABEL}", *[f"CAST(`{c}` AS DOUBLE) AS `{c}`" for c in cols])
    counts = lab.groupBy(LABEL).agg(F.count(F.lit(1)).alias("_nc"))
    total = counts.agg(F.sum("_nc")).scalar()
    weights = counts.select(LABEL, (total / (2.0 * F.col("_nc"))).alias(WEIGHT))
    lab = stratified_folds(lab.join(F.broadcast(weights), LABEL), LABEL, "id", folds)
    lab = checkpointed(lab)
    # a column without any value cannot be imputed or learnt from: one aggregate finds them
    present = lab.agg(*[F.expr(f"count(`{c}`) AS `{c}`") for c in cols]).first().asDict()
    cols = [c for c in cols if present[c] > 0]
    return lab, cols


def columns_with_missing(train: DataFrame, cols: list[str]) -> list[str]:
    """The columns that some row has no value in (NULL or NaN), found by one aggregate."""
    if not cols:
        return []
    absent = train.agg(*[F.count_if(_missing(c)).alias(c) for c in cols]).first().asDict()
    return [c for c in cols if absent[c] > 0]


def _missing(c: str):
    return F.col(f"`{c}`").isNull() | F.isnan(f"`{c}`")


def missing_vector(df: DataFrame, cols: list[str], out: str = "missing") -> DataFrame:
    """``df`` with a sparse vector of the indicators of ``cols``: 1 where the value is missing."""
    return Pipeline(stages=_indicators(cols, out)).fit(df).transform(df).drop(*[f"{c}__na" for c in cols])


def _indicators(cols: list[str], out: str) -> list:
    """Stages that make one 0/1 column for each column and assemble them; few are missing, so the vectors are sparse."""
    flags = ", ".join(f"CAST(`{c}` IS NULL OR isnan(`{c}`) AS DOUBLE) AS `{c}__na`" for c in cols)
    return [SQLTransformer(statement=f"SELECT *, {flags} FROM __THIS__"),
            VectorAssembler(inputCols=[f"{c}__na" for c in cols], outputCol=out)]


def imputer(cols: list[str]) -> Pipeline:
    """Medians of ``cols``, filled in as ``{c}__imp``.

    Spark spreads the values over one row per column and keeps a summary of each column in a hash map. Above 128 columns
    (``spark.sql.objectHashAggregate.sortBased.fallbackThreshold``) a task sorts, and spills, all its values instead, so
    each ``Imputer`` has at most ``MEDIANS_AT_ONCE`` columns.
    """
    parts = [cols[i:i + MEDIANS_AT_ONCE] for i in range(0, len(cols), MEDIANS_AT_ONCE)]
    return Pipeline(stages=[Imputer(inputCols=some, outputCols=[f"{c}__imp" for c in some], strategy="median", relativeError=0.001)
                            for some in parts])


def pipeline(cols: list[str], estimator, scale: bool = False, indicators: list[str] | tuple = (), medians=None) -> Pipeline:
    """Median imputation, assembly, the estimator. ``indicators``: columns whose missingness is a feature of its own, after the
    imputed values (never scaled, so that the vectors stay sparse there); see ``columns_with_missing``. ``medians``: an
    ``imputer`` that is fitted on the same rows already, for several fits on them."""
    imputed = [f"{c}__imp" for c in cols]
    stages = [medians or imputer(cols)]
    values = "values" if indicators else "features"
    stages.append(VectorAssembler(inputCols=imputed, outputCol="raw" if scale else values, handleInvalid="keep"))
    if scale:
        stages.append(StandardScaler(inputCol="raw", outputCol=values))
    if indicators:
        stages += [*_indicators(list(indicators), "missing"),
                   VectorAssembler(inputCols=[values, "missing"], outputCol="features", handleInvalid="keep")]
    stages.append(estimator)
    return Pipeline(stages=stages)


def logistic(max_iter: int = 50, reg: float = 0.01) -> LogisticRegression:
    return LogisticRegression(labelCol=LABEL, featuresCol="features", weightCol=WEIGHT, maxIter=max_iter, regParam=reg)


def forest(trees: int = 100, depth: int = 10, seed: int = 42) -> RandomForestClassifier:
    return RandomForestClassifier(labelCol=LABEL, featuresCol="features", weightCol=WEIGHT, numTrees=trees,
                                  maxDepth=depth, seed=seed)


def boosted(max_iter: int = 30, depth: int = 4, step: float = 0.1, validation_col: str | None = None,
            rows: float = 1.0, least: int = 1) -> GBTClassifier:
    """``rows``: share of the rows that a tree is grown from; ``least``: rows of a leaf."""
    gbt = GBTClassifier(labelCol=LABEL, featuresCol="features", weightCol=WEIGHT, maxIter=max_iter, maxDepth=depth,
                        stepSize=step, subsamplingRate=rows, minInstancesPerNode=least, seed=42, checkpointInterval=10)
    if validation_col:
        gbt = gbt.setValidationIndicatorCol(validation_col)
    return gbt


def positive_probability(scored: DataFrame) -> DataFrame:
    return scored.withColumn("p", vector_to_array("probability").getItem(1))


def out_of_fold(train: DataFrame, cols: list[str], make_estimator, folds: int = 3, scale: bool = False) -> DataFrame:
    """Fit on k-1 folds, score the held-out fold; one row per labelled id."""
    parts = []
    for k in range(folds):
        model = pipeline(cols, make_estimator(), scale).fit(train.filter(F.col("fold") != k))
        scored = positive_probability(model.transform(train.filter(F.col("fold") == k)))
        parts.append(scored.select("id", "fold", F.col(LABEL).cast("int").alias("y"), "p"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


class BusinessCostEvaluator(Evaluator):
    """Minimum business cost over the threshold grid (lower is better)."""

    def _evaluate(self, dataset: DataFrame) -> float:
        scored = positive_probability(dataset).select(F.col(LABEL).cast("int").alias("y"), "p")
        best = E.best_threshold(E.threshold_sweep(scored)).first()
        return float(best["cost"])

    def isLargerBetter(self) -> bool:  # noqa: N802 (MLlib API)
        return False


def param_search(train: DataFrame, cols: list[str], reg_values=(0.001, 0.01, 0.1)) -> DataFrame:
    """Grid search over the fold column with the cost evaluator; one row per candidate.

    Imputation and scaling are fitted once for each fold, on its training rows only; the candidates then refit only the
    classifier. A fold's vectors are as large as the checkpointed rows, which make them again if lost: they are cached while the
    fold is in use, not written.
    """
    folds = [r[0] for r in train.select("fold").distinct().orderBy("fold").collect()]   # a handful
    evaluator = BusinessCostEvaluator()
    costs: dict[float, list[float]] = {reg: [] for reg in reg_values}
    for k in folds:
        prep = Pipeline(stages=pipeline(cols, logistic(), scale=True).getStages()[:-1]).fit(train.filter(F.col("fold") != k))
        vectors = prep.transform(train).select("id", "fold", LABEL, WEIGHT, "features").persist()
        for reg in reg_values:
            model = logistic(reg=reg).fit(vectors.filter(F.col("fold") != k))
            costs[reg].append(evaluator.evaluate(model.transform(vectors.filter(F.col("fold") == k))))
        vectors.unpersist()
    rows = [(float(reg), sum(c) / len(c)) for reg, c in costs.items()]
    best = min(rows, key=lambda r: (r[1], r[0]))
    return train.sparkSession.createDataFrame(
        [(r, c, r == best[0]) for r, c in rows], "reg_param double, mean_cost double, best boolean")


def permutation_partners(df: DataFrame, seed: int) -> DataFrame:
    """``(id, partner)``: the row whose hash rank equals this row's id rank, i.e. a
    seeded permutation of the rows built from two distributed rankings and a join."""
    from ledgerlens.operators.ordered import row_numbers
    by_id = row_numbers(df.select("id"), "id").withColumnRenamed("row_number", "_r")
    by_hash = row_numbers(df.select("id").withColumn("_h", hash_key("id", seed)), "_h", tiebreak=["id"])
    by_hash = by_hash.select(F.col("row_number").alias("_r"), F.col("id").alias("partner"))
    return by_id.join(by_hash, "_r").select("id", "partner")
