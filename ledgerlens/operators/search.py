"""Parameter search by successive halving.

Every candidate of an explicit space is first fitted with few boosting iterations on few folds. The better half, by the mean
business cost at each fold's best threshold, goes on to the next rung with more of both, until the last rung covers all folds.
The scores of a rung are written as one table for each fold (candidate, rung, fold, id, y, p); its costs are one grouped threshold
sweep of these. The driver holds a number per candidate.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.ml import Pipeline
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators import evaluate as E
from ledgerlens.operators import ml as M
from ledgerlens.session import materialised

# The space: depth, step, share of rows per tree, rows of a leaf; and the rungs: (iterations, folds).
SPACE = [dict(depth=d, step=s, rows=r, least=n) for (d, n), s, r in product(((2, 5), (4, 20)), (0.1, 0.3), (0.7, 1.0))]
RUNGS = [(4, 1), (8, 2), (16, 3)]
PARTITIONS_PER_CORE = 2
TRIALS = ("candidate int, depth int, step double, rows double, least int, rung int, iterations int, folds int, cost double, "
          "state string")


def rung_costs(scores: DataFrame) -> DataFrame:
    """(candidate, fold, threshold, cost): the smallest cost of each fold, at the lowest threshold that has it."""
    sweep = E.threshold_sweep(scores, group_cols=["candidate", "fold"])
    best = sweep.groupBy("candidate", "fold").agg(F.min(F.struct("cost", "threshold")).alias("b"))
    return best.select("candidate", "fold", "b.threshold", "b.cost")


def halving_search(train: DataFrame, cols: list[str], space: Sequence[dict] = SPACE, rungs: Sequence[tuple] = RUNGS
                   ) -> tuple[DataFrame, DataFrame]:
    """(trials, scores) of ``train`` (id, label, weight, fold, ``cols``). A trial's state is ``dropped`` at its last rung,
    ``kept`` before, and ``best`` for the winner; of equal costs the smaller candidate goes on.

    For each level of each tree every partition shuffles its statistics of all features, whatever its number of rows. The fits
    therefore run on a few partitions for each core, not on as many as the rows were written in.
    """
    spark = train.sparkSession
    train = train.coalesce(PARTITIONS_PER_CORE * spark.sparkContext.defaultParallelism)
    steps: dict = {}

    def prepared(fold: int) -> DataFrame:
        # imputation is fitted on the fold's training rows only, once for all candidates; the vectors are as large as the
        # checkpointed rows, which make them again if lost, so they are cached while the fold is in use and not written
        if fold not in steps:
            steps[fold] = Pipeline(stages=M.pipeline(cols, M.boosted()).getStages()[:-1]).fit(train.filter(F.col("fold") != fold))
        return steps[fold].transform(train).select("id", "fold", M.LABEL, M.WEIGHT, "features").persist()

    alive, trials, written = list(range(len(space))), [], None
    for rung, (iterations, folds) in enumerate(rungs, start=1):
        scores = None
        for fold in range(folds):
            rows, parts = prepared(fold), None
            for candidate in alive:
                model = M.boosted(max_iter=iterations, **space[candidate]).fit(rows.filter(F.col("fold") != fold))
                part = M.positive_probability(model.transform(rows.filter(F.col("fold") == fold))).select(
                    F.lit(candidate).alias("candidate"), F.lit(rung).alias("rung"), "fold", "id", F.col(M.LABEL).cast("int").alias("y"), "p")
                parts = part if parts is None else parts.unionByName(part)
            parts = materialised(parts, f"scores-{rung}-{fold}", scratch=False)
            rows.unpersist()
            scores = parts if scores is None else scores.unionByName(parts)
        written = scores if written is None else written.unionByName(scores)
        costs = {r["candidate"]: r["cost"] for r in rung_costs(scores).groupBy("candidate").agg(F.avg("cost").alias("cost")).collect()}
        ranked = sorted(alive, key=lambda c: (costs[c], c))
        last = rung == len(rungs)
        kept = ranked[:1] if last else ranked[:(len(ranked) + 1) // 2]
        for c in sorted(alive):
            state = "best" if last and c in kept else "kept" if c in kept else "dropped"
            p = space[c]
            trials.append((c, p["depth"], p["step"], p["rows"], p["least"], rung, iterations, folds, float(costs[c]), state))
        alive = kept
    return spark.createDataFrame(trials, TRIALS), written
