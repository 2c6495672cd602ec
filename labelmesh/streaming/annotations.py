"""Annotations arriving as a stream: running votes, windowed activity and scoring with a saved model.

Spark keeps the sums of every item as state; a micro-batch brings the items that it touched, with their sums so far, and
these replace their rows in a table with one row per item.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from labelmesh.functions import arrays
from labelmesh.models.scoring import ClassifierModel, PointModel, evidence_rows, score_evidence
from labelmesh.streaming.upserts import read_target, upsert

AVAILABLE = {"availableNow": True}


def _keep(changes: DataFrame, target: str, checkpoint: str, trigger: dict) -> StreamingQuery:
    def write(batch: DataFrame, number: int) -> None:
        upsert(batch, number, target, ["item_id"])

    return (
        changes.writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )


def running_vote(stream: DataFrame, n_labels: int, target: str, checkpoint: str, trigger: dict = AVAILABLE) -> StreamingQuery:
    """Keep the majority label of every item (ties: lowest label) as annotations arrive; only changed winners are written."""
    counts = stream.groupBy("item_id").agg(arrays.count_by_class("label", "1", n_labels).alias("c"))
    return _keep(counts.select("item_id", arrays.argmax("c").alias("label")), target, checkpoint, trigger)


def current_votes(spark: SparkSession, target: str) -> DataFrame:
    """(item_id, label), as of the last batch."""
    return read_target(spark, target)


def windowed_activity(stream: DataFrame, n_labels: int, window: str, delay: str) -> DataFrame:
    """Per annotator and tumbling window: number of annotations and share of each label.

    A window is final once the watermark (newest time minus ``delay``) passes its end; later rows are dropped.
    """
    counted = (
        stream.withWatermark("ts", delay)
        .groupBy(F.window("ts", window).alias("w"), "annotator_id")
        .agg(F.count(F.lit(1)).alias("n"), arrays.count_by_class("label", "1", n_labels).alias("c"))
    )
    return counted.select(
        "annotator_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n",
        arrays.normalized("c", n_labels).alias("share"),
    )


def write_windows(activity: DataFrame, out: str, checkpoint: str, trigger: dict = AVAILABLE) -> StreamingQuery:
    return (
        activity.writeStream.outputMode("append").format("parquet").option("path", out)
        .option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )


def stream_score(stream: DataFrame, model: PointModel | ClassifierModel, target: str, checkpoint: str, trigger: dict = AVAILABLE) -> StreamingQuery:
    """Join arriving annotations with a model and keep every item's summed evidence.

    The model may come from :func:`labelmesh.sources.models.load_model`, so a stream that was stopped goes on, from the
    same checkpoint, with the model it began with.
    """
    return _keep_evidence(evidence_rows(model, annotations=stream.withColumn("n", F.lit(1))), model, target, checkpoint, trigger)


def stream_score_features(stream: DataFrame, model: ClassifierModel, target: str, checkpoint: str, trigger: dict = AVAILABLE) -> StreamingQuery:
    """The same for arriving features (item_id, feature, value) of new items, under a classifier."""
    return _keep_evidence(evidence_rows(model, features=stream), model, target, checkpoint, trigger)


def _keep_evidence(rows: DataFrame, model, target: str, checkpoint: str, trigger: dict) -> StreamingQuery:
    return _keep(rows.groupBy("item_id").agg(arrays.sum_arrays("e", model.n_labels).alias("evidence")), target, checkpoint, trigger)


def current_scores(spark: SparkSession, target: str, model: PointModel | ClassifierModel) -> DataFrame:
    """(item_id, p) from the evidence kept by :func:`stream_score`."""
    return score_evidence(read_target(spark, target), model)
