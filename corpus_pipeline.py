"""A training corpus in five stages: toxic documents go, unknown languages go, near copies go, sources are mixed, the
rest is packed into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from labelmesh.llm import jaccard, language, mixing, packing, toxicity
from labelmesh.runtime import cut, shared_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores below one half; the model learns from the labels that are not held out.

    Null and empty texts score as texts without a match and stay; rows that repeat an id or a text are judged one by one,
    rows without an id too. Without labels of both classes all rows stay. All columns are kept, whatever their names; an
    empty table gives an empty one.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.filter(toxicity.toxic_score(docs["text"], model, spark) < 0.5)


def drop_unknown_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the language model does not reject: with letters, and not far from every learned language.

    Null and empty texts and texts without a letter go; short texts are held against short texts. Ties between languages
    do not matter here. Repeated rows and rows without an id are judged one by one. Without a labelled row all go. All
    columns are kept, whatever their names; an empty table gives an empty one.
    """
    model = language.fit(docs)
    return docs.filter(~language.language_of(docs["text"], model, spark)["rejected"])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies: the one with the smallest id, then text hash; rows without an id come last.

    A row is known by its id and the hash of its text, so rows that repeat an id with other texts are documents of their
    own, as are rows without an id. Of rows equal in both the first by the other columns stays. Null texts and texts
    without words all stay. All columns are kept, whatever their names; an empty table gives an empty one.
    """
    prefix = "_near"
    while any(column.lower().startswith(prefix) for column in docs.columns):
        prefix += "_"
    name = lambda column: f"{prefix}{column}"
    text = F.col("text").cast("string")
    known = docs.withColumn(name("hash"), F.unhex(F.sha2(text, 256)))
    key = F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("id"), F.col(name("hash")).alias("hash"))
    classes = cut(jaccard.classes_of(known.select(key.alias("key"), text.alias("text"))).filter("n > 0").groupBy("key", "component_id").agg(
        F.count(F.lit(1)).alias("rows")), "near-classes")
    named = lambda rows: rows.select(F.col("key.id").alias(name("id")), F.col("key.hash").alias(name("same")))
    same = lambda rows: rows["doc_id"].eqNullSafe(F.col(name("id"))) & (rows[name("hash")] == F.col(name("same")))
    kept = known.join(named(classes.filter("NOT key <=> component_id")), same(known), "left_anti")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    twice = named(classes.filter("key <=> component_id AND rows > 1"))
    if twice.isEmpty():
        return kept.select(*columns)
    again, once = kept.join(twice, same(kept), "left_semi"), kept.join(twice, same(kept), "left_anti")
    first = again.groupBy("doc_id", name("hash")).agg(F.min(F.struct(*columns)).alias(name("row")))
    return once.select(*columns).unionByName(first.select(*(F.col(f"{name('row')}.`{c}`").alias(c) for c in docs.columns)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix of sources takes them: not at all, once or twice.

    Null texts and texts without words have size 0 and go by their hash; rows without a source are a source. Rows equal in
    id and text are taken by a hash of all columns, rows equal in all columns by number, so a source's words come near
    its target whatever is repeated. All columns are kept, whatever their names; an empty table gives an empty one.
    """
    return mixing.repeat_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and the sequences that hold them.

    Every row is packed, repeated ones as often as they occur; null and empty texts have their end id alone. Among open
    sequences of equal room the order of creation decides. Only id and text are read; an empty table gives no rows.
    """
    return packing.pack_documents(docs, added=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_languages),
    ("near_copies", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: learned models and tokenizers have no SQL; tests hold the stages against plain versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents; what a stage keeps is a Parquet table that the next one reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        folder = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {}
