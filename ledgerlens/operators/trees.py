"""Boosted trees as a table of nodes: staged scores, learning curve, gain, permutation importance.

A fitted ensemble is a table (tree, node, feature, split, left, right, value, gain), read back from the saved model. It has
trees x 2^(depth + 1) rows at most, so it is collected, and each tree becomes one nested CASE over the columns that it
splits on: scoring reads the used features only, inside generated code, with no vector of all features.

A row goes left if its value is at most the split; a missing value goes right (a table read from MLlib expects
imputed values). The margin is the sum of the trees' leaf values (already times the tree's weight), the probability is
1 / (1 + exp(-2 margin)).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.operators import evaluate as E
from ledgerlens.operators.ml import permutation_partners
from ledgerlens.operators.ordered import scalar_fields
from ledgerlens.session import materialised, shared_path

NODES = "tree int, node int, feature string, split double, left int, right int, value double, gain double"


def node_table(model: GBTClassificationModel, names: Sequence[str]) -> DataFrame:
    """The nodes of a fitted ensemble whose vector holds the features ``names``. A leaf has no feature and the tree's weight in
    its ``value``; ``gain`` is the node's gain times its rows."""
    spark = SparkSession.active()
    path = shared_path(spark, f"trees-{uuid.uuid4().hex}")
    model.write().save(path)
    n = F.col("nodeData")
    inner = n["leftChild"] >= 0
    weight = F.get(F.array(*[F.lit(float(w)) for w in model.treeWeights]), F.col("treeID"))
    feature = F.get(F.split(F.lit("\n".join(names)), "\n"), n["split"]["featureIndex"])
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), n["id"].alias("node"), F.when(inner, feature).alias("feature"),
        F.when(inner, F.get(n["split"]["leftCategoriesOrThreshold"], F.lit(0))).alias("split"),
        F.when(inner, n["leftChild"]).alias("left"), F.when(inner, n["rightChild"]).alias("right"),
        F.when(~inner, weight * n["prediction"]).alias("value"), F.when(inner, n["gain"] * n["rawCount"]).alias("gain"))


def _number(x: float) -> str:
    return f"{x!r}D"


@dataclass
class Forest:
    """The trees of a node table, as {node: row}."""

    trees: list[dict[int, dict]]

    @staticmethod
    def of(nodes: DataFrame) -> Forest:
        trees: dict[int, dict[int, dict]] = {}
        for r in nodes.collect():                      # trees x nodes of a tree
            trees.setdefault(r["tree"], {})[r["node"]] = r.asDict()
        return Forest([trees[t] for t in sorted(trees)])

    def splits_on(self, tree: int) -> set[str]:
        return {n["feature"] for n in self.trees[tree].values() if n["feature"] is not None}

    def features(self) -> list[str]:
        return sorted(set().union(*(self.splits_on(t) for t in range(len(self.trees)))))

    def leaf(self, tree: int, column: Callable[[str], str] = lambda f: f"`{f}`") -> str:
        """SQL of the leaf value that a row reaches; ``column`` gives the SQL of a feature."""
        def at(k: int) -> str:
            n = self.trees[tree][k]
            if n["feature"] is None:
                return _number(n["value"])
            return f"CASE WHEN {column(n['feature'])} <= {_number(n['split'])} THEN {at(n['left'])} ELSE {at(n['right'])} END"
        return at(0)

    def margin(self, column: Callable[[str], str] = lambda f: f"`{f}`") -> Column:
        return F.expr(" + ".join(["0.0D", *(self.leaf(t, column) for t in range(len(self.trees)))]))


def probability(margin: Column | str) -> Column:
    margin = F.col(margin) if isinstance(margin, str) else margin
    return 1.0 / (1.0 + F.exp(-2.0 * margin))


def log_loss(y: Column, margin: Column) -> Column:
    """-log of the probability of the label, without overflow."""
    z = F.when(y == 1, -2.0 * margin).otherwise(2.0 * margin)
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))


def staged_margins(rows: DataFrame, forest: Forest, keep: Sequence[str]) -> DataFrame:
    """``keep`` and ``margins``: the margin after each tree, a prefix sum over the leaf values of one pass."""
    leaves = rows.select(*keep, F.expr(f"array({', '.join(forest.leaf(t) for t in range(len(forest.trees)))})").alias("_leaves"))
    start = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("all"))
    staged = F.aggregate("_leaves", start, lambda a, x: F.struct(
        (a["sum"] + x).alias("sum"), F.concat(a["all"], F.array(a["sum"] + x)).alias("all")))
    return leaves.select(*keep, staged["all"].alias("margins"))


def learning_curve(rows: DataFrame, forest: Forest, y: str = "y", part: str = "part") -> DataFrame:
    """(part, iteration, auc, log_loss, n): both metrics of every part of the rows after each tree."""
    staged = staged_margins(rows, forest, [part, y])
    long = staged.select(F.col(part).alias("part"), F.col(y).alias("y"), F.posexplode("margins").alias("_i", "p"))
    long = long.select("part", "y", "p", (F.col("_i") + 1).alias("iteration"))
    keys = ["part", "iteration"]
    loss = long.groupBy(*keys).agg(F.avg(log_loss(F.col("y"), F.col("p"))).alias("log_loss"), F.count(F.lit(1)).alias("n"))
    return E.auc_rank(long, group_cols=keys).select(*keys, "auc").join(loss, keys)


def gain_importance(nodes: DataFrame) -> DataFrame:
    """(feature, importance, share, rank, cum_share): the gain of each feature that the trees split on, largest first."""
    gains = nodes.filter("feature IS NOT NULL").groupBy("feature").agg(F.sum("gain").alias("importance"))
    total = gains.agg(F.sum("importance")).scalar()
    w = Window.orderBy(F.desc("importance"), "feature")          # one row per used feature
    return gains.select("feature", "importance", (F.col("importance") / total).alias("share"),
                        F.row_number().over(w).alias("rank"),
                        (F.sum("importance").over(w.rowsBetween(Window.unboundedPreceding, 0)) / total).alias("cum_share"))


def permutation_drops(rows: DataFrame, forest: Forest, names: Sequence[str], seeds: Sequence[int],
                      key: str = "id", y: str = "y") -> DataFrame:
    """(feature, repeat, auc_drop): how much the AUC falls when one feature is taken from each row's partner in a
    seeded permutation of the rows.

    Only trees that split on the feature change, so their leaf values alone are computed again: the work is
    proportional to the splits. A feature of ``names`` that no tree splits on has a drop of exactly 0 and is not scored.
    """
    used = forest.features()
    trees = range(len(forest.trees))
    leaves = [F.expr(forest.leaf(t)).alias(f"_l{t}") for t in trees]
    scored = materialised(rows.select(key, y, *[F.col(f"`{f}`").alias(f"_f{i}") for i, f in enumerate(used)], *leaves), "leaves")
    at = {f: i for i, f in enumerate(used)}
    base = E.auc_rank(scored.select(y, F.expr(" + ".join(["0.0D", *(f"_l{t}" for t in trees)])).alias("p")), y=y)
    base = scalar_fields(base)["auc"]
    partner = scored.select(F.col(key).alias("_partner"), *[F.col(f"_f{i}").alias(f"_w{i}") for i in range(len(used))])
    out = None
    for repeat, seed in enumerate(seeds, start=1):
        pairs = permutation_partners(scored.select(F.col(key).alias("id")), seed).select(
            F.col("id").alias(key), F.col("partner").alias("_partner"))
        joined = scored.join(pairs, key).join(partner, "_partner")

        def permuted(feature: str) -> str:
            changed = {t for t in trees if feature in forest.splits_on(t)}
            column = lambda f: f"_w{at[f]}" if f == feature else f"_f{at[f]}"
            return " + ".join(["0.0D", *(forest.leaf(t, column) if t in changed else f"_l{t}" for t in trees)])
        entries = F.array(*[F.struct(F.lit(f).alias("feature"), F.expr(permuted(f)).alias("p")) for f in used])
        variants = joined.select(y, F.lit(repeat).alias("repeat"), F.inline(entries))
        out = variants if out is None else out.unionByName(variants)
    drops = E.auc_rank(out, y=y, group_cols=["feature", "repeat"]).select("feature", "repeat", (base - F.col("auc")).alias("auc_drop"))
    unused = [f for f in names if f not in at]
    if not unused:
        return drops
    listed = rows.sparkSession.range(1).select(F.explode(F.split(F.lit("\n".join(unused)), "\n")).alias("feature"))
    zero = listed.select("feature", F.explode(F.sequence(F.lit(1), F.lit(len(seeds)))).alias("repeat"), F.lit(0.0).alias("auc_drop"))
    return drops.unionByName(zero)
