"""Spark ML models: window classifier, sequence classifier, anomaly score, importance."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from perigee import fixed_values as fv
from perigee.functions.numeric import argmax, round_exact, sum_balanced
from perigee.operators.features import fit_scaler, scaled_columns
from perigee.operators.gate import column_stats
from perigee.operators.lookup import with_class_name
from perigee.operators.order import permutation_key, with_dense_index
from perigee.session import fixed_partitions, materialize, pieces_of
from perigee.sources.artifacts import stats_map
from perigee.sources.dims import local_table

# Room for the statistics of the tree nodes split in one pass: more room, fewer passes over the data.
NODE_STATS_MB = 512
# Part of what a model is: bagging and sums follow it, so it does not depend on the cluster.
TRAIN_PARTITIONS = 16
# Rows of a piece: a forest of 150 trees holds some 720 bytes a row, which every pass reads.
PIECE_ROWS = 250_000


def train_classifier(
    raw: DataFrame,
    features: Sequence[str],
    label: str = "Label",
    trees: int = fv.TREES,
    depth: int = fv.TREE_DEPTH,
    seed: int = fv.SEED,
    partitions: int = TRAIN_PARTITIONS,
) -> PipelineModel:
    """A forest over the ordered features: Spark ML has no boosted trees for many classes.

    The features are assembled once and only they and the label reach training.  Rows are dealt
    by their values into ``partitions`` pieces, more where these would exceed ``PIECE_ROWS``: the same rows and
    the same number give the same model however the input was cut.
    """
    assembler = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")
    forest = RandomForestClassifier(
        labelCol="_label", numTrees=trees, maxDepth=depth, seed=seed, maxMemoryInMB=NODE_STATS_MB
    )
    rows = raw.where(F.col(label).isNotNull()).select(
        *[F.col(name).cast("double").alias(name) for name in features], F.col(label).cast("double").alias("_label")
    )
    dealt = fixed_partitions(rows, pieces_of(rows, partitions, PIECE_ROWS), *features, "_label")
    # Classes, sizes, split candidates and bags are each a pass over the rows: dealt and sorted once for all of them, and
    # kept on disk, as the bags need the memory.
    seen = assembler.transform(dealt).select("features", "_label").persist(StorageLevel.DISK_ONLY)
    model = forest.fit(seen)
    seen.unpersist()
    return PipelineModel([assembler, model])


def score(df: DataFrame, model: PipelineModel, classes: DataFrame | None = None) -> DataFrame:
    """Adds ``predicted_label`` and the rounded ``confidence``, and the class name if asked."""
    scored = model.transform(df).withColumn("_p", vector_to_array("probability"))
    scored = scored.withColumns({
        "predicted_label": argmax("_p"),
        "confidence": round_exact(F.array_max("_p"), fv.CONFIDENCE_PLACES),
    }).select(*df.columns, "predicted_label", "confidence")
    return scored if classes is None else with_class_name(scored, classes, "predicted_label")


def feature_importance(spark: SparkSession, model: PipelineModel, features: Sequence[str]) -> DataFrame:
    """Importance of each feature in the trained forest: one row per feature."""
    weights = model.stages[-1].featureImportances.toArray()
    return local_table(
        spark, {"feature": pa.string(), "importance": pa.float64()},
        [(name, float(weight)) for name, weight in zip(features, weights)],
    )


def permuted(df: DataFrame, features: Sequence[str], idx: str = "seq", seed: int = fv.SEED) -> DataFrame:
    """The rows once as they are (``permuted`` NULL) and once per feature with its values dealt out anew among the rows.

    One seeded permutation of the rows serves all features: a row takes the value of the row that stands at its place in
    the seeded order of ``idx``, so each value is used once.  ``idx`` is unique.
    """
    own = with_dense_index(df, [idx], out="_place")
    key = permutation_key(idx, seed)
    donors = with_dense_index(df.select(idx, *[F.col(name).alias(f"_{name}") for name in features]), [key, F.col(idx)], out="_place")
    both = own.join(donors.drop(idx), "_place")
    chosen = F.explode(F.array(F.lit(None).cast("string"), *map(F.lit, features))).alias("permuted")
    copies = both.select("*", chosen)
    values = {name: F.when(F.col("permuted") == name, F.col(f"_{name}")).otherwise(F.col(name)) for name in features}
    return copies.withColumns(values).select(*df.columns, "permuted")


def permutation_importance(
    df: DataFrame, model: PipelineModel, features: Sequence[str], label: str = "Label", idx: str = "seq", seed: int = fv.SEED,
) -> DataFrame:
    """(feature, accuracy, importance): accuracy with the feature permuted, and what was lost by that; one scoring plan for all."""
    scored = score(permuted(df.select(idx, *features, label), features, idx, seed), model)
    hits = scored.groupBy("permuted").agg(F.avg((F.col("predicted_label") == F.col(label)).cast("double")).alias("accuracy"))
    hits = materialize(hits, "permutation")
    # One row per feature and one more: a window over all of them is small.
    base = F.max(F.when(F.col("permuted").isNull(), F.col("accuracy"))).over(Window.partitionBy())
    return hits.withColumn("importance", base - F.col("accuracy")).where("permuted IS NOT NULL").select(
        F.col("permuted").alias("feature"), "accuracy", "importance")


class AnomalyModel:
    """Linear reconstruction of scaled Normal rows; the error is low for normal-like rows."""

    def __init__(
        self,
        features: Sequence[str],
        scaler: Mapping[str, tuple[float, float]],
        centre: Mapping[str, float],
        components: list[list[float]],
    ) -> None:
        self.features = list(features)
        self.scaler = dict(scaler)
        self.centre = dict(centre)
        self.components = components

    def error(self, df: DataFrame, out: str = "error") -> DataFrame:
        """Adds the mean squared reconstruction error, as plain arithmetic in the JVM."""
        centred = {
            f"_y{i}": column - F.lit(self.centre[name])
            for i, (name, column) in enumerate(zip(self.features, scaled_columns(self.scaler, self.features)))
        }
        width = len(self.features)
        projected = {
            f"_p{j}": sum_balanced([F.col(f"_y{i}") * F.lit(axis[i]) for i in range(width)])
            for j, axis in enumerate(self.components)
        }
        squares = []
        for i in range(width):
            rebuilt = sum_balanced([F.col(f"_p{j}") * F.lit(axis[i]) for j, axis in enumerate(self.components)])
            gap = F.col(f"_y{i}") - rebuilt
            squares.append(gap * gap)
        return (
            df.withColumns(centred).withColumns(projected)
            .withColumn(out, sum_balanced(squares) / F.lit(float(width)))
            .drop(*centred, *projected)
        )


def train_anomaly(
    raw: DataFrame, features: Sequence[str], label: str = "Label", components: int = 8,
    normal: int = fv.NORMAL_LABEL, scaler: Mapping[str, tuple[float, float]] | None = None,
) -> AnomalyModel:
    """Scaler over all raw rows, principal axes over the Normal ones.

    Aggregates only; the driver gets one row per feature and a features-by-axes matrix.  A
    missing feature of a Normal row counts as its mean, so the row stays in the fit.
    """
    scaler = stats_map(fit_scaler(raw, features), features) if scaler is None else dict(scaler)
    scaled = raw.where(F.col(label) == normal).select(*scaled_columns(scaler, features))
    centre = {name: mean for name, (mean, _) in stats_map(column_stats(scaled, features), features).items()}
    k = min(components, len(features))
    filled = scaled.select(*[
        F.coalesce(F.when(~F.isnan(name), F.col(name)), F.lit(centre[name])).alias(name) for name in features
    ])
    vectors = VectorAssembler(inputCols=list(features), outputCol="v").transform(filled)
    axes = PCA(k=k, inputCol="v", outputCol="p").fit(vectors.select("v")).pc.toArray().T
    return AnomalyModel(features, scaler, centre, [[float(x) for x in axis] for axis in axes])


def sequence_vectors(sequences: DataFrame) -> DataFrame:
    """Flattens ``steps`` into one vector per sequence."""
    return sequences.withColumn("features", array_to_vector(F.flatten("steps"))).drop("steps")


def train_sequence_classifier(
    sequences: DataFrame, length: int, width: int, classes: int, label: str = "Label",
    hidden: int = 64, iterations: int = 15, seed: int = fv.SEED, idx: str = "seq", partitions: int = TRAIN_PARTITIONS,
) -> PipelineModel:
    """A one-hidden-layer network over flattened sequences, dealt by ``idx`` into ``partitions`` pieces or more, as in ``train_classifier``."""
    network = MultilayerPerceptronClassifier(
        labelCol="_label", layers=[length * width, hidden, classes], maxIter=iterations, seed=seed
    )
    rows = sequence_vectors(sequences).select(idx, "features", F.col(label).cast("double").alias("_label"))
    # Kept on disk, so that sequences are built and dealt once for all that the fit asks of them.
    seen = fixed_partitions(rows, pieces_of(sequences, partitions, PIECE_ROWS), idx).persist(StorageLevel.DISK_ONLY)
    model = Pipeline(stages=[network]).fit(seen)
    seen.unpersist()
    return model


def score_sequences(sequences: DataFrame, model: PipelineModel) -> DataFrame:
    scored = model.transform(sequence_vectors(sequences))
    kept = [name for name in sequences.columns if name != "steps"]
    return scored.select(*kept, F.col("prediction").cast("int").alias("sequence_pred"))
