"""Registered training and scoring queries (MLlib). Their results depend on
iterative fits, so they are checked by row counts only; the evaluation
operators they use are checked exactly elsewhere."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ledgerlens.functions.columns import decide
from ledgerlens.operators import evaluate as E
from ledgerlens.operators import ml as M
from ledgerlens.operators import search as S
from ledgerlens.operators import trees as T
from ledgerlens.operators.sampling import sql_hash_key
from ledgerlens.plans import feature_sql as FS
from ledgerlens.plans.feature_queries import build_feature_table
from ledgerlens.plans.registry import register
from ledgerlens.session import materialised
from ledgerlens.sources.roles import with_roles

KEY, TARGET = "SK_ID_CURR", "TARGET"
VALIDATION_FOLD = 0
TOP_IMPORTANCE = 20
REPEATS = 3


def _train(spark, d):
    return M.training_table(build_feature_table(spark, d), KEY, TARGET)


@register("training_folds", with_roles("application") + f"""
SELECT SK_ID_CURR AS id, CAST(TARGET AS INTEGER) AS y,
       CAST((row_number() OVER (PARTITION BY TARGET ORDER BY {sql_hash_key("SK_ID_CURR")}, SK_ID_CURR) - 1) % 3 AS INTEGER) AS fold
FROM application WHERE TARGET IS NOT NULL AND CODE_GENDER IS DISTINCT FROM 'XNA'""")
def training_folds(spark, d):
    """M9: what the out-of-fold fits start from: labelled ids, label and stratified fold."""
    return _train(spark, d)[0].select("id", F.col(M.LABEL).cast("int").alias("y"), "fold")


@register("oof_predictions")
def oof_predictions(spark, d):
    """M9: out-of-fold probabilities of a class-weighted logistic pipeline, 3 stratified folds."""
    train, cols = _train(spark, d)
    return M.out_of_fold(train, cols, M.logistic, scale=True)


@register("baseline_models")
def baseline_models(spark, d):
    """Median imputation + scaling + weighted logistic regression, and a weighted random forest, each without and with
    indicators of missing values, fitted on two folds and scored by rank AUC on the third."""
    train, cols = _train(spark, d)
    fit_rows = train.filter(F.col("fold") != VALIDATION_FOLD)
    held = train.filter(F.col("fold") == VALIDATION_FOLD)
    absent = M.columns_with_missing(fit_rows, cols)
    medians = M.imputer(cols).fit(fit_rows)             # of the same rows in all four fits
    out = None
    for name, est, scale in (("logistic", M.logistic(), True), ("random_forest", M.forest(), False)):
        for indicators in ([], absent):
            scored = M.positive_probability(M.pipeline(cols, est, scale, indicators, medians).fit(fit_rows).transform(held))
            auc = E.auc_rank(scored.select(F.col(M.LABEL).cast("int").alias("y"), "p"))
            row = auc.select(F.lit(name).alias("model"), F.lit(len(indicators)).alias("n_indicators"), "auc",
                             (F.col("n_pos") + F.col("n_neg")).alias("n_eval"))
            out = row if out is None else out.unionByName(row)
    return out


@register("missing_indicators", f"""WITH ftab AS ({FS.feature_table_query()}),
cells AS (UNPIVOT (SELECT SK_ID_CURR AS id, CAST(COLUMNS(* EXCLUDE (SK_ID_CURR, TARGET)) AS DOUBLE) FROM ftab WHERE TARGET IS NOT NULL)
          ON COLUMNS(* EXCLUDE (id)) INTO NAME feature VALUE value),
present AS (SELECT feature, count(*) AS n FROM cells GROUP BY feature),
rows AS (SELECT SK_ID_CURR AS id FROM ftab WHERE TARGET IS NOT NULL)
SELECT id, feature FROM rows, (SELECT feature FROM present WHERE n < (SELECT count(*) FROM rows))
EXCEPT SELECT id, feature FROM cells""")
def missing_indicators(spark, d):
    """The indicator matrix of the training rows, read off the sparse vectors: one row per missing value of a feature that
    is present elsewhere."""
    train, cols = _train(spark, d)
    absent = M.columns_with_missing(train, cols)
    rows = M.missing_vector(train.select("id", *[F.col(f"`{c}`") for c in absent]), absent).select("id", "missing")
    names = F.array(*[F.lit(c) for c in absent])
    flags = F.arrays_zip(names.alias("feature"), vector_to_array("missing").alias("flag"))
    return rows.select("id", F.explode(F.filter(flags, lambda x: x["flag"] == 1.0)).alias("f")).select("id", "f.feature")


def _boosted(spark, d):
    """(rows, features, nodes, forest): all boosting iterations fitted on the training folds; ``rows`` has the labelled rows with
    the imputed values of the features that the trees split on, and their part (train or valid)."""
    train, cols = _train(spark, d)
    model = M.pipeline(cols, M.boosted()).fit(train.filter(F.col("fold") != VALIDATION_FOLD))
    nodes = materialised(T.node_table(model.stages[-1], cols), "nodes")
    forest = T.Forest.of(nodes)
    part = F.when(F.col("fold") == VALIDATION_FOLD, "valid").otherwise("train").alias("part")
    rows = model.stages[0].transform(train).select(
        "id", F.col(M.LABEL).cast("int").alias("y"), part, *[F.col(f"`{c}__imp`").alias(c) for c in forest.features()])
    return rows, cols, nodes, forest


def _kept(rows, forest):
    """(trees, AUC): the iteration with the best validation AUC, the first of equals."""
    curve = T.learning_curve(rows.filter("part = 'valid'"), forest)
    best = curve.agg(F.max_by(F.struct("iteration", "auc"), F.struct("auc", -F.col("iteration"))).alias("b")).first()["b"]
    return best["iteration"], best["auc"]


@register("boosted_model")
def boosted_model(spark, d):
    """Boosted trees kept up to the iteration with the best AUC on the validation fold, and that AUC."""
    rows, _, _, forest = _boosted(spark, d)
    trees, auc = _kept(rows, forest)
    counts = rows.filter("part = 'valid'").agg(F.count_if(F.col("y") == 1).alias("n_pos"), F.count_if(F.col("y") == 0).alias("n_neg"))
    return counts.select(F.lit(trees).alias("n_trees"), F.lit(auc).alias("auc"), "n_pos", "n_neg")


@register("learning_curve")
def learning_curve(spark, d):
    """AUC and log loss on the training and the validation rows after each boosting iteration, from one pass over the
    rows' leaf values."""
    rows, _, _, forest = _boosted(spark, d)
    curve = materialised(T.learning_curve(rows, forest), "curve")        # two rows per tree
    side = lambda part: curve.filter(F.col("part") == part).select(
        "iteration", F.col("auc").alias(f"{part}_auc"), F.col("log_loss").alias(f"{part}_log_loss"))
    return side("train").join(side("valid"), "iteration")


@register("param_search")
def param_search(spark, d):
    """Regularisation grid evaluated on the fold column by the minimum business cost."""
    train, cols = _train(spark, d)
    return M.param_search(train, cols)


@register("halving_search")
def halving_search(spark, d):
    """Successive halving over a space of boosted trees; one row per candidate and rung with its business cost."""
    train, cols = _train(spark, d)
    trials, _ = S.halving_search(train, cols)
    return trials


@register("feature_importance")
def feature_importance(spark, d):
    """Gain importance of the boosted model, top 20 with the cumulative share of the total."""
    rows, _, nodes, forest = _boosted(spark, d)
    gains = T.gain_importance(nodes.filter(F.col("tree") < _kept(rows, forest)[0]))
    return gains.filter(F.col("rank") <= TOP_IMPORTANCE).select("feature", "importance", "rank", "cum_share")


@register("permutation_importance")
def permutation_importance(spark, d):
    """AUC drop on the validation fold when one feature is permuted, for every feature, 3 repeats; only trees that split
    on a feature are scored again for it."""
    rows, cols, _, forest = _boosted(spark, d)
    kept = T.Forest(forest.trees[:_kept(rows, forest)[0]])
    return T.permutation_drops(rows.filter("part = 'valid'"), kept, cols, [100 + r for r in range(REPEATS)])


@register("score_batch")
def score_batch(spark, d):
    """Fit on the labelled rows, score every feature row (train and test), decide at 0.1."""
    ft = materialised(build_feature_table(spark, d), "features")          # fitted on and scored: built once
    train, cols = M.training_table(ft, KEY, TARGET)
    model = M.pipeline(cols, M.logistic(), scale=True).fit(train)
    rows = ft.select(F.col(KEY).alias("id"), *[F.col(f"`{c}`").cast("double").alias(c) for c in cols])
    scored = M.positive_probability(model.transform(rows))
    return scored.select("id", F.col("p").alias("probability"), decide("p", E.THRESHOLD).alias("decision"))
