"""Boosted trees for several classes, with probabilities that policy bands can rely on.

Spark ML boosts two classes at a time.  Each class is boosted against the rest on one part of the rows; its margin is the
weighted sum of its trees.  A multinomial regression over the margins of all classes, fitted on the rows that no tree has
seen, turns them into probabilities that sum to one.  All of it is one saved pipeline: ``models.score`` takes its
``probability`` as it takes that of the forest.
"""

from __future__ import annotations

from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, VectorAssembler, VectorSlicer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perigee import fixed_values as fv
from perigee.operators.models import NODE_STATS_MB, PIECE_ROWS, TRAIN_PARTITIONS
from perigee.session import fixed_partitions, pieces_of

ROUNDS, DEPTH, STEP = 20, 5, 0.3
# One row in this many fits the probabilities and no tree.
CALIBRATE_EVERY = 5
CALIBRATION_STEPS, CALIBRATION_PENALTY = 40, 1e-4
# Classes boosted at the same time: many for few rows, whose jobs are short.  Each booster keeps some 260 bytes a row in memory
# and goes over them for each level of each tree, so many rows are boosted for one class after the other, on all executors.
AT_ONCE, ROWS_AT_ONCE = 5, 2_000_000


def margin_column(label: int) -> str:
    return f"_margin{label}"


def _held_out(features: Sequence[str], every: int) -> Column:
    """Rows chosen by their values, so equal rows fall on one side and a second run chooses the same."""
    return F.pmod(F.xxhash64(*features, "_label"), F.lit(every)) == 0


def train_boosted(
    raw: DataFrame, features: Sequence[str], label: str = "Label", classes: int = len(fv.CLASS_NAMES), rounds: int = ROUNDS,
    depth: int = DEPTH, step: float = STEP, seed: int = fv.SEED, partitions: int = TRAIN_PARTITIONS,
    calibrate_every: int = CALIBRATE_EVERY,
) -> PipelineModel:
    """A pipeline from ``features`` to ``rawPrediction``, ``probability`` and ``prediction``.

    A class that the rows lack gets the margin of its absence.  Rows without a label take no part.  A missing feature
    counts as the mean of the training rows, since these trees refuse NaN; infinite values are refused.  As in ``train_classifier`` the
    same rows and the same ``partitions`` (the least number of pieces) give the same model however the input was cut.
    """
    filled = [f"_filled_{name}" for name in features]
    assembler = VectorAssembler(inputCols=filled, outputCol="features")
    rows = raw.where(F.col(label).isNotNull()).select(
        *[F.col(name).cast("double").alias(name) for name in features], F.col(label).cast("double").alias("_label")
    ).withColumn("_held_out", _held_out(features, calibrate_every))
    # Dealt and sorted once, and kept on disk for all that follows, as the boosters need the memory.
    dealt = fixed_partitions(rows, pieces_of(rows, partitions, PIECE_ROWS), *features, "_label").persist(StorageLevel.DISK_ONLY)
    imputer = Imputer(inputCols=list(features), outputCols=filled).fit(dealt)
    seen = assembler.transform(imputer.transform(dealt.where(~F.col("_held_out")))).select("features", "_label")
    seen = seen.persist(StorageLevel.DISK_ONLY)

    def boost(k: int) -> GBTClassificationModel:
        booster = GBTClassifier(
            labelCol="_mine", maxIter=rounds, maxDepth=depth, stepSize=step, seed=seed, maxMemoryInMB=NODE_STATS_MB, predictionCol=f"_is{k}"
        ).setRawPredictionCol(margin_column(k)).setProbabilityCol(f"_alone{k}")
        return booster.fit(seen.withColumn("_mine", (F.col("_label") == k).cast("double")))

    with ThreadPool(boosted_at_once(seen.count(), classes)) as pool:
        boosters = pool.map(inheritable_thread_target(raw.sparkSession)(boost), range(classes), chunksize=1)
    seen.unpersist()
    # Spark gives each booster's margin twice, once with either sign.
    both = VectorAssembler(inputCols=[margin_column(k) for k in range(classes)], outputCol="_both")
    margins = VectorSlicer(inputCol="_both", outputCol="margins", indices=[2 * k + 1 for k in range(classes)])
    stages = [imputer, assembler, *boosters, both, margins]
    held_out = PipelineModel(stages).transform(dealt.where("_held_out"))
    calibration = LogisticRegression(
        featuresCol="margins", labelCol="_label", family="multinomial", maxIter=CALIBRATION_STEPS, regParam=CALIBRATION_PENALTY
    )
    # The regression goes over the margins several times: the trees are asked once.
    margins_known = _every_class(held_out.select("margins", "_label"), classes).persist()
    calibrated = calibration.fit(margins_known)
    margins_known.unpersist()
    dealt.unpersist()
    return PipelineModel([*stages, calibrated])


def boosted_at_once(rows: int, classes: int) -> int:
    """How many classes are boosted at the same time: as many as keep ``ROWS_AT_ONCE`` rows in all, one at least and ``AT_ONCE`` at most."""
    return max(1, min(AT_ONCE, classes, ROWS_AT_ONCE // max(rows, 1)))


def _every_class(held_out: DataFrame, classes: int) -> DataFrame:
    """Adds to the rows, for each class, one whose margins speak for that class alone.

    The regression then knows all classes, also those without a held-out row, and no class can get a probability of 0 from few rows.
    """
    from pyspark.ml.linalg import Vectors

    clear = [(Vectors.dense([1.0 if i == k else -1.0 for i in range(classes)]), float(k)) for k in range(classes)]
    return held_out.unionAll(held_out.sparkSession.createDataFrame(clear, held_out.schema))


def boosters(model: PipelineModel) -> list[GBTClassificationModel]:
    """The boosters of a trained pipeline, by class."""
    return [stage for stage in model.stages if isinstance(stage, GBTClassificationModel)]
