"""Projections, filters and preparation of items, annotations and features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from labelmesh.functions import rand
from labelmesh.operators.joins import attach
from labelmesh.runtime import cut, fits_broadcast
from labelmesh.skew import ROWS_PER_SPLIT


def compile_annotations(events: DataFrame) -> DataFrame:
    """Raw events -> (item_id, annotator_id, label, n). Counts are combined before the shuffle."""
    return events.groupBy("item_id", "annotator_id", "label").agg(F.count(F.lit(1)).alias("n"))


def split_annotated(items: DataFrame, annotations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items with at least one annotation, items with none)."""
    keys = annotations.select("item_id").distinct()
    return items.join(keys, "item_id", "left_semi"), items.join(keys, "item_id", "left_anti")


def split_observed(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items with a trusted observed label, items without)."""
    seen = F.col("observed_label")
    return items.filter(seen.isNotNull()), items.filter(seen.isNull())


def item_weights(items: DataFrame, annotations: DataFrame, strategy: str | float) -> DataFrame:
    """Weight 1 for annotated items, a static weight in [0, 1] for the rest."""
    try:
        static = float(strategy)
    except ValueError as exc:
        raise ValueError(f"item weight must be a number, got {strategy!r}") from exc
    if not 0.0 <= static <= 1.0:
        raise ValueError(f"item weight must lie in [0, 1], got {static}")
    marked = annotations.groupBy("item_id").agg(F.lit(True).alias("_seen"))
    return (
        items.join(marked, "item_id", "left")
        .withColumn("weight", F.when(F.col("_seen"), F.lit(1.0)).otherwise(F.lit(static)))
        .drop("_seen")
    )


def overlay_observed(assignment: DataFrame, items: DataFrame) -> DataFrame:
    """Observed labels replace the initial ones."""
    observed = items.select("item_id", "observed_label")
    return assignment.join(observed, "item_id", "left").select(
        "item_id", F.coalesce("observed_label", "label").alias("label")
    )


def backoff_state(items: DataFrame, state: DataFrame, fallback: DataFrame, topics: DataFrame | None = None) -> DataFrame:
    """Saved y and m where present, the fallback initialiser's label otherwise (decided per item).

    With ``topics`` (item_id, z) the saved token topics are completed the same way.
    """
    saved = state.select("item_id", "y", "m", *(["z"] if topics is not None else []))
    out = (
        items.select("item_id")
        .join(saved, "item_id", "left")
        .join(fallback.select("item_id", "label"), "item_id", "left")
        .withColumn("y", F.coalesce("y", "label")).withColumn("m", F.coalesce("m", "label")).drop("label")
    )
    if topics is None:
        return out
    fresh = topics.select("item_id", F.col("z").alias("_z"))
    return out.join(fresh, "item_id", "left").withColumn("z", F.coalesce("z", "_z")).drop("_z")


def doc_size(features: DataFrame) -> DataFrame:
    return features.groupBy("item_id").agg(F.sum("value").alias("size"))


#: tasks that the texts of one input split are dealt to; their words are counted in memory
PER_SPLIT = 8


def item_parts(documents: DataFrame) -> int:
    """Tasks that texts are dealt to by item."""
    spark = documents.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism,
               PER_SPLIT * documents.rdd.getNumPartitions())


def by_item(documents: DataFrame) -> DataFrame:
    """Texts dealt by item: all words of an item then come up in one task, so words are counted without moving again."""
    return documents.repartition(item_parts(documents), "item_id")


#: what separates words in lower-cased text (fixed value)
SEPARATOR = "[^a-z]+"


def tokenize(documents: DataFrame, text: str = "text") -> DataFrame:
    """One row per token: (item_id, pos, word), words being lower-cased runs of ASCII letters."""
    # text that starts with a separator splits into an empty first part, which is no token
    split = by_item(documents.select("item_id", text)).select(
        "item_id", F.split(F.lower(F.regexp_replace(text, "^[^a-zA-Z]+", "")), SEPARATOR).alias("words")
    )
    return split.select("item_id", F.posexplode("words").alias("pos", "word")).filter(F.col("word") != "")


def bag_of_words(documents: DataFrame, cutoff: int = 0, text: str = "text") -> DataFrame:
    """(item_id, feature, value) with words seen at most ``cutoff`` times in the corpus dropped.

    Tokens are counted per item first, so the corpus-wide totals add up item counts, not tokens. Texts move once, their
    words do not.
    """
    words = by_item(documents.select("item_id", text)).select(
        "item_id", F.explode(F.split(F.lower(text), SEPARATOR)).alias("feature")
    )
    counts = (
        words.filter(F.col("feature") != "")
        .groupBy("item_id", "feature")
        .agg(F.count(F.lit(1)).cast("double").alias("value"))
    )
    if cutoff <= 0:
        return counts
    # stored once: the cutoff needs the counts twice and the texts must not be tokenised twice
    counts = cut(counts, "word_counts")
    kept = counts.groupBy("feature").agg(F.sum("value").alias("_n")).filter(F.col("_n") > cutoff).select("feature")
    return attach(counts, kept, ["feature"], ["item_id"], 1).select("item_id", "feature", "value")


def rescale_features(features: DataFrame, top: float = 100.0) -> DataFrame:
    """If any value is negative, map all values linearly onto 0..top; otherwise leave them."""
    bounds = features.agg(F.struct(F.min("value").alias("lo"), F.max("value").alias("hi")).alias("b")).scalar()
    lo, hi = bounds["lo"], bounds["hi"]
    mapped = F.when(hi > lo, (F.col("value") - lo) / (hi - lo) * top).otherwise(F.lit(0.0))
    return features.withColumn("value", F.when(lo < 0, mapped).otherwise(F.col("value")))


def train_heldout_split(items: DataFrame, train_percent: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Hash split: an item's side depends on its id and the seed only."""
    bucket = F.pmod(rand.hash_int(seed, "item_id"), F.lit(100))
    return items.filter(bucket < train_percent), items.filter(bucket >= train_percent)


def perturb_labels(assignment: DataFrame, n_labels: int, probability: float, seed: int) -> DataFrame:
    """With the given probability replace a label by a uniform random one (possibly the same)."""
    hit = rand.uniform(f"{seed}-hit", "item_id") < probability
    fresh = F.pmod(rand.hash_int(f"{seed}-new", "item_id"), F.lit(n_labels)).cast("int")
    return assignment.withColumn("label", F.when(hit, fresh).otherwise(F.col("label")))


def uniform_assignment(items: DataFrame, n_labels: int, seed: int) -> DataFrame:
    return items.select(
        "item_id", F.pmod(rand.hash_int(seed, "item_id"), F.lit(n_labels)).cast("int").alias("label")
    )


def attach_saved_labels(items: DataFrame, state: DataFrame) -> DataFrame:
    """Label every item from a saved state; the job fails if an item is missing from it."""
    joined = items.select("item_id").join(state.select("item_id", "y"), "item_id", "left")
    missing = F.raise_error(F.concat(F.lit("no saved label for item "), F.col("item_id").cast("string")))
    return joined.select("item_id", F.when(F.col("y").isNull(), missing.cast("int")).otherwise(F.col("y")).alias("label"))


def concat_predictions(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def known_items(predictions: DataFrame, items: DataFrame) -> DataFrame:
    """Predictions for items outside ``items`` are ignored."""
    return predictions.join(items.select("item_id").distinct(), "item_id", "left_semi")


def nth_annotation(events: DataFrame, order: list[str], rows_per_split: int | None = None) -> DataFrame:
    """Replay position of each event among its annotator's events on the same item, earliest first.

    Pairs with more than ``rows_per_split`` events are dealt by ranges of (pair, order columns), whatever their types:
    positions inside a range, plus the sizes of the pair's ranges before it.
    """
    pair, limit = ["item_id", "annotator_id"], rows_per_split or ROWS_PER_SPLIT
    ranked = F.row_number().over(Window.partitionBy(*pair).orderBy(*order))
    sizes = events.groupBy(*pair).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit)
    pairs, rows = sizes.agg(F.count(F.lit(1)), F.sum("_n")).first()
    if not pairs:
        return events.withColumn("nth", ranked)
    hot = cut(sizes.select(*pair), "hot_pairs")
    hot = F.broadcast(hot) if fits_broadcast(pairs, 64) else hot
    dealt = events.join(hot, pair, "left_semi").repartitionByRange(-(-rows // limit), *pair, *order)
    # stored: the ranges come from a sample, and every reader must see the same ones
    sliced = cut(dealt.withColumn("_slice", F.spark_partition_id()), "slices")
    before = sliced.groupBy(*pair, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*pair).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = before.select(*pair, "_slice", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy(*pair, "_slice").orderBy(*order))
    busy = sliced.withColumn("_r", inside).join(offsets, [*pair, "_slice"]).withColumn(
        "nth", (F.col("_r") + F.col("_offset")).cast("int")).select(*events.columns, "nth")
    return events.join(hot, pair, "left_anti").withColumn("nth", ranked).select(*events.columns, "nth").unionByName(busy)


def sorted_index(values: DataFrame, column: str, out: str) -> DataFrame:
    """(column, out): distinct values numbered 0..n-1 in their order, null left out; only a count per range is gathered."""
    ranged = values.select(column).filter(F.col(column).isNotNull()).distinct().repartitionByRange(column)
    ranged = cut(ranged.withColumn("_range", F.spark_partition_id()), "sorted_values")
    offset, at = F.when(F.lit(False), F.lit(0).cast("bigint")), 0
    for r in sorted(ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: r["_range"]):
        offset, at = offset.when(F.col("_range") == r["_range"], F.lit(at).cast("bigint")), at + r["n"]
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(column))
    return ranged.select(column, (offset + rank - 1).alias(out))


def dense_index(values: DataFrame, column: str, out: str, buckets: int = 256) -> DataFrame:
    """Number distinct values 0..n-1 without gathering them: rank inside hash buckets plus bucket offsets."""
    bucketed = values.select(column).distinct().withColumn("_bucket", F.pmod(F.xxhash64(column), F.lit(buckets)))
    sizes = {r["_bucket"]: r["n"] for r in bucketed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, at = [], 0
    for b in range(buckets):
        offsets.append(at)
        at += sizes.get(b, 0)
    offset = F.array(*[F.lit(o).cast("bigint") for o in offsets])[F.col("_bucket").cast("int")]
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy(column))
    return bucketed.select(column, (offset + rank - 1).alias(out))
