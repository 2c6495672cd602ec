"""The tables every registered query starts from, as (item, annotator, label) views of the given parquet.

Each view has a Spark definition here and the same definition as SQL text in ``plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from labelmesh.functions import rand
from labelmesh.models.corpus import lay_out
from labelmesh.operators import prep

#: accuracy in percent of the five rule annotators over the embedding table (fixed values)
EMB_ACCURACY = [90, 80, 70, 60, 50]

#: event types in label order (fixed values)
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _code(column: str, values: list[str]):
    """Position of the value, NULL for any other."""
    return (F.nullif(F.array_position(F.array(*[F.lit(v) for v in values]), F.col(column)), F.lit(0)) - 1).cast("int")


def line_events(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("item_id"),
        F.col("l_suppkey").alias("annotator_id"),
        _code("l_returnflag", ["A", "N", "R"]).alias("label"),
        F.col("l_shipdate").alias("ts"),
        "l_orderkey",
        "l_linenumber",
    ).filter("label IS NOT NULL")


def line_annotations(spark, sf) -> DataFrame:
    return prep.compile_annotations(line_events(spark, sf))


def line_items(spark, sf) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"))


def order_events(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("item_id"),
        F.col("o_orderpriority").alias("annotator_id"),
        _code("o_orderstatus", ["F", "O", "P"]).alias("label"),
        F.col("o_orderdate").alias("ts"),
        "o_orderkey",
    ).filter("label IS NOT NULL")


def order_annotations(spark, sf) -> DataFrame:
    return prep.compile_annotations(order_events(spark, sf))


def customer_items(spark, sf) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("item_id"))


def event_annotations(events: DataFrame) -> DataFrame:
    """Stream-capable: item = props.k, annotator = user, label = event type."""
    return events.select(
        F.get_json_object("props", "$.k").cast("bigint").alias("item_id"),
        F.col("user_id").alias("annotator_id"),
        _code("event_type", EVENT_TYPES).alias("label"),
        "ts",
    ).filter("label IS NOT NULL")


def emb_items(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("item_id"), F.col("label").alias("gold_label"), F.col("embedding").alias("location")
    )


def emb_annotations(spark, sf) -> DataFrame:
    """Five rule annotators per vector: right with their accuracy, else a fixed shift of the gold label."""
    votes = emb_items(spark, sf).select(
        "item_id", "gold_label", F.posexplode(F.array(*[F.lit(a) for a in EMB_ACCURACY])).alias("annotator_id", "acc")
    )
    h = rand.hash_int("emb", "item_id", "annotator_id")
    label = F.when(F.pmod(h, F.lit(100)) < F.col("acc"), F.col("gold_label")).otherwise(
        F.pmod(F.col("gold_label") + 1 + F.pmod(h, F.lit(9)), F.lit(10))
    )
    return votes.select("item_id", "annotator_id", label.cast("int").alias("label"), F.lit(1).cast("bigint").alias("n"))


def documents(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), "text", "lang", "source", "n_chars")


def doc_items(spark, sf) -> DataFrame:
    """All documents with the reviewed quality as observed label, where there is one."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"))
    gold = table(spark, sf, "labels").select(F.col("doc_id").alias("item_id"), F.col("quality").alias("observed_label"))
    return docs.join(gold, "item_id", "left")


def label_annotations(spark, sf) -> DataFrame:
    """The reviewed labels read as one annotator's annotations (most documents have none)."""
    return table(spark, sf, "labels").select(
        F.col("doc_id").alias("item_id"),
        F.lit(0).alias("annotator_id"),
        F.col("quality").alias("label"),
        F.lit(1).cast("bigint").alias("n"),
    )


def doc_annotations(spark, sf) -> DataFrame:
    """Five rule annotators over the documents: length, language, source parity, md5 bit, reviewed quality."""
    gold = table(spark, sf, "labels").select(F.col("doc_id").alias("item_id"), "quality")
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), "lang", "source", "n_chars")
    votes = docs.join(gold, "item_id", "left").select(
        "item_id",
        F.posexplode(F.array(
            F.when(F.col("n_chars") >= 1000, 1).otherwise(0),
            F.when(F.col("lang") == "en", 1).otherwise(0),
            F.pmod(F.length("source"), F.lit(2)),
            F.pmod(rand.hash_int("doc", "item_id"), F.lit(2)).cast("int"),
            F.col("quality"),
        )).alias("annotator_id", "label"),
    )
    return votes.filter(F.col("label").isNotNull()).withColumn("n", F.lit(1).cast("bigint"))


def doc_features(spark, sf, cutoff: int = 0) -> DataFrame:
    texts = documents(spark, sf).select("item_id", "text")
    bag = prep.bag_of_words(texts, cutoff)
    # words of an item come up together: stored as they come, in buckets by item, and tokenised once for all uses
    return bag if cutoff > 0 else lay_out(bag, prep.item_parts(texts), ["item_id"]).table


def class_of_rows(spark, sf) -> DataFrame:
    """Majority label and weight of every annotated line item."""
    from labelmesh.operators import votes

    return votes.majority_vote(line_annotations(spark, sf)).withColumn("weight", F.lit(1.0))
