"""Measurements: statements about sums over items, with the items each one refers to.

A measurement table has (meas_id, annotator_id, kind, label, value) and, by kind, item_id (annotation),
predicate (labelled word), location or source_item with neighbors (labelled location).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from labelmesh.operators.joins import attach
from labelmesh.operators.neighbors import nearest
from labelmesh.runtime import cut
from labelmesh.skew import Spread

ANNOTATION, PROPORTION, PREDICATE, LOCATION = "annotation", "label_proportion", "labeled_predicate", "labeled_location"

MEASUREMENT_FIELDS = (
    "meas_id", "annotator_id", "kind", "label", "value", "item_id", "predicate", "location", "source_item", "neighbors",
)


def measurement_counts(measurements: DataFrame) -> DataFrame:
    return measurements.groupBy("annotator_id").agg(F.count(F.lit(1)).alias("n"))


def annotation_targets(measurements: DataFrame, items: DataFrame) -> DataFrame:
    """(meas_id, item_id, sigma): one target with value one."""
    own = measurements.filter(F.col("kind") == ANNOTATION).select("meas_id", "item_id", F.lit(1.0).alias("sigma"))
    spread = Spread.plan(own, ["item_id"], ["meas_id"])
    return spread.join(own, items.select("item_id").distinct()).select("meas_id", "item_id", "sigma")


def predicate_targets(measurements: DataFrame, features: DataFrame) -> DataFrame:
    """(meas_id, item_id, sigma, words): every document with the word; ``words`` counts its tokens there."""
    asked = measurements.filter(F.col("kind") == PREDICATE).select("meas_id", F.col("predicate").alias("feature"))
    joined = attach(features, asked, ["feature"], ["item_id"], 8)
    return joined.select("meas_id", "item_id", F.lit(1.0).alias("sigma"), F.col("value").alias("words"))


def cosine_adjacency(sources: DataFrame, vectors: DataFrame) -> DataFrame:
    """(source_id, item_id, cosine) of long-form vectors sharing at least one feature.

    ``sources``: (source_id, feature, value), only the vectors asked for; ``vectors``: (item_id, feature, value).
    Products are summed before the shuffle on the pair; a feature that most items have is split.
    """
    spread = Spread.plan(vectors, ["feature"], ["item_id"])
    asked = sources.select("source_id", "feature", F.col("value").alias("_v"))
    dots = spread.join(vectors, asked).groupBy("source_id", "item_id").agg(F.sum(F.col("value") * F.col("_v")).alias("dot"))
    norms = vectors.groupBy("item_id").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("n"))
    asked_norms = asked.groupBy("source_id").agg(F.sqrt(F.sum(F.col("_v") * F.col("_v"))).alias("s"))
    return (
        dots.join(norms, "item_id")
        .join(asked_norms, "source_id")
        .filter((F.col("n") > 0) & (F.col("s") > 0))
        .select("source_id", "item_id", (F.col("dot") / (F.col("n") * F.col("s"))).alias("cosine"))
    )


def knn_location(sources: DataFrame, items: DataFrame, neighbors: int) -> DataFrame:
    """(source_id, item_id, cosine, rank): the ``neighbors`` nearest items of every source location.

    ``neighbors`` < 1 keeps every item. Zero vectors have no cosine: as sources and as items they give no rows.
    """
    return nearest(sources.select("source_id", "location", F.lit(neighbors).alias("k")), items)


def _long(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, F.posexplode("location").alias("feature", "_v")).select(
        key, "feature", F.col("_v").cast("double").alias("value")
    )


def location_targets(measurements: DataFrame, items: DataFrame) -> DataFrame:
    """(meas_id, item_id, sigma): nearest items of each labelled location, weighted by cosine.

    All measurements are looked up together, each with its own number of neighbours.
    """
    asked = measurements.filter(F.col("kind") == LOCATION)
    own = items.select(F.col("item_id").alias("source_item"), F.col("location").cast("array<double>").alias("_own"))
    given = asked.filter(F.col("location").isNotNull()).select("meas_id", "neighbors", F.col("location").cast("array<double>"))
    by_item = asked.filter(F.col("location").isNull()).select("meas_id", "neighbors", "source_item").join(
        own, "source_item").select("meas_id", "neighbors", F.col("_own").alias("location"))
    located = cut(given.unionByName(by_item).select(F.col("meas_id").alias("source_id"), "location", F.col("neighbors").alias("k")), "located")
    if located.isEmpty():
        return located.join(items.select("item_id"), F.lit(False)).select(F.col("source_id").alias("meas_id"), "item_id", F.lit(0.0).alias("sigma"))
    return nearest(located, items).select(F.col("source_id").alias("meas_id"), "item_id", F.col("cosine").alias("sigma"))


def measurement_targets(measurements: DataFrame, items: DataFrame, features: DataFrame | None = None) -> DataFrame:
    """(meas_id, annotator_id, kind, label, item_id, sigma) of all item-level kinds.

    Label proportions refer to every item and are kept as per-class sums instead. A measurement without
    targets gives no rows, which is how ineffective ones drop out.
    """
    parts = [annotation_targets(measurements, items)]
    if features is not None:
        parts.append(predicate_targets(measurements, features).select("meas_id", "item_id", "sigma"))
    if "location" in items.columns:
        parts.append(location_targets(measurements, items))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    head = measurements.select("meas_id", "annotator_id", "kind", "label")
    return attach(every, head, ["meas_id"], ["item_id"], 6).select("meas_id", "annotator_id", "kind", "label", "item_id", "sigma")


def scale_measurements(targets: DataFrame, measurements: DataFrame, ranges: DataFrame, pre_scaled: bool = False) -> DataFrame:
    """Targets with sigma and value divided by the measurement's range. ``ranges``: (meas_id, range)."""
    value = F.col("value") if pre_scaled else F.col("value") / F.col("range")
    scale = measurements.select("meas_id", "value").join(ranges.filter("range > 0"), "meas_id").select(
        "meas_id", "range", value.alias("tau")
    )
    return attach(targets, scale, ["meas_id"], ["item_id"], 3).withColumn("sigma", F.col("sigma") / F.col("range")).drop("range")


def measurement_ranges(targets: DataFrame, measurements: DataFrame, features: DataFrame | None = None) -> DataFrame:
    """(meas_id, range): 1 for annotations, all tokens of a word, the kept cosines of a location."""
    fixed = targets.filter(F.col("kind") == ANNOTATION).select("meas_id", F.lit(1.0).alias("range"))
    near = targets.filter(F.col("kind") == LOCATION).groupBy("meas_id").agg(F.sum("sigma").alias("range"))
    out = fixed.unionByName(near)
    if features is not None:
        words = predicate_targets(measurements, features).groupBy("meas_id").agg(F.sum("words").alias("range"))
        out = out.unionByName(words)
    return out


def measurement_expectation(targets: DataFrame, posterior: DataFrame) -> DataFrame:
    """(meas_id, e, q, s): sums over targets of sigma p, (sigma p)^2 and sigma^2 p for the measured label."""
    spread = Spread.plan(targets, ["item_id"], ["meas_id"])
    joined = spread.join(targets, posterior).withColumn("_p", F.expr("p[label]"))
    return joined.groupBy("meas_id").agg(
        F.sum(F.expr("sigma * _p")).alias("e"),
        F.sum(F.expr("sigma * _p * sigma * _p")).alias("q"),
        F.sum(F.expr("sigma * sigma * _p")).alias("s"),
    )


def proportion_expectation(measurements: DataFrame, class_sums: list[float], class_squares: list[float], n_items: int) -> DataFrame:
    """The same for label proportions, from per-class sums of p and p^2."""
    sums = "array(" + ", ".join(f"{v!r}D" for v in class_sums) + ")"
    squares = "array(" + ", ".join(f"{v!r}D" for v in class_squares) + ")"
    n = f"{float(n_items)!r}D"
    return measurements.filter(F.col("kind") == PROPORTION).select(
        "meas_id", F.expr(f"{sums}[label] / {n}").alias("e"), F.expr(f"{squares}[label] / ({n} * {n})").alias("q"),
        F.expr(f"{sums}[label] / ({n} * {n})").alias("s"),
    )


def is_annotated_by_measurement(items: DataFrame, measurements: DataFrame) -> DataFrame:
    """Items that an annotation names or that are the source of a labelled location."""
    named = measurements.filter(F.col("kind") == ANNOTATION).select("item_id").unionByName(
        measurements.filter((F.col("kind") == LOCATION) & F.col("source_item").isNotNull()).select(
            F.col("source_item").alias("item_id")
        )
    ).distinct().withColumn("_seen", F.lit(True))
    return items.select("item_id").join(named, "item_id", "left").select(
        "item_id", F.coalesce("_seen", F.lit(False)).alias("annotated")
    )
