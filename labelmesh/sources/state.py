"""Saved per-item state, prediction tables and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def write_state(state: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Persist (item_id, y, m, z); every field but the key may be null."""
    state.select("item_id", "y", "m", "z").write.mode("overwrite").format(fmt).save(path)


def read_state(spark: SparkSession, path: str, fmt: str = "parquet", id_type: T.DataType = T.LongType()) -> DataFrame:
    schema = T.StructType([
        T.StructField("item_id", id_type),
        T.StructField("y", T.IntegerType()),
        T.StructField("m", T.IntegerType()),
        T.StructField("z", T.ArrayType(T.IntegerType())),
    ])
    return spark.read.schema(schema).format(fmt).load(path)


#: tokens of a document whose topics one task puts in order
TOKEN_CHUNK = 1 << 16


def token_chunks(tokens: DataFrame, chunk: int = TOKEN_CHUNK) -> DataFrame:
    """(item_id, chunk, first, z): topics of (item_id, pos, z) in position order, ``chunk`` positions together.

    A long document spans many rows and tasks. Positions without a token have no topic; ``first`` is the least position.
    """
    placed = tokens.select("item_id", F.floor(F.col("pos") / chunk).cast("int").alias("chunk"), F.struct("pos", "z").alias("t"))
    ordered = placed.groupBy("item_id", "chunk").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return ordered.select("item_id", "chunk", F.expr("t[0].pos").alias("first"), F.expr("transform(t, x -> x.z)").alias("z"))


def topics_of_chunks(chunks: DataFrame) -> DataFrame:
    """The inverse of :func:`token_chunks` for documents without gaps: (item_id, pos, z), to start a topic model from."""
    return chunks.select("item_id", "first", F.posexplode("z").alias("_i", "z")).select("item_id", (F.col("first") + F.col("_i")).cast("int").alias("pos"), "z")


def token_state(tokens: DataFrame, chunk: int = TOKEN_CHUNK) -> DataFrame:
    """(item_id, z): one array per document, as a saved state holds it, joined from chunks in their order."""
    chunks = token_chunks(tokens, chunk).groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("chunk", "z"))).alias("c"))
    return chunks.select("item_id", F.flatten(F.expr("transform(c, x -> x.z)")).alias("z"))


def topics_of_state(state: DataFrame) -> DataFrame:
    """(item_id, pos, z) of a saved state: the start of a topic model that goes on from it."""
    return state.filter("z IS NOT NULL").select("item_id", F.posexplode("z").alias("pos", "z"))


def state_from_predictions(predictions: DataFrame, topics: DataFrame | None = None, tokens: DataFrame | None = None) -> DataFrame:
    """Predicted label -> y, alternative (machine) label -> m, token topics -> z.

    Topics come as arrays (item_id, z), or as the ``tokens`` (item_id, pos, z) of a topic model.
    """
    out = predictions.select(
        "item_id", F.col("label").cast("int").alias("y"), F.col("alternative").cast("int").alias("m")
    )
    topics = token_state(tokens) if tokens is not None else topics
    if topics is None:
        return out.withColumn("z", F.lit(None).cast("array<int>"))
    return out.join(topics.select("item_id", "z"), "item_id", "left")


def predictions_table(predictions: DataFrame, annotated: DataFrame, heldout: DataFrame | None = None) -> DataFrame:
    """Predictions tagged labeled / unlabeled (by presence of annotations) and heldout."""
    marked = annotated.groupBy("item_id").agg(F.lit(True).alias("_seen"))
    out = predictions.join(marked, "item_id", "left").withColumn(
        "split", F.when(F.col("_seen"), F.lit("labeled")).otherwise(F.lit("unlabeled"))
    ).drop("_seen")
    if heldout is None:
        return out
    return out.unionByName(heldout.withColumn("split", F.lit("heldout")))


def annotator_report(confusion: DataFrame, accuracies: DataFrame) -> DataFrame:
    """(annotator_id, accuracy, matrix): cells as (truth, label, value) in grid order."""
    cells = F.array_sort(F.collect_list(F.struct("truth", "label", "value")))
    return confusion.groupBy("annotator_id").agg(cells.alias("matrix")).join(accuracies, "annotator_id")
