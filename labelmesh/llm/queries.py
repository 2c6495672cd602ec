"""The numbered queries of this subpackage and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from labelmesh.llm import boosting, chat, divergence, grammar, jaccard, language, lexical, mixing, packing, periods, subspace, token_counts, toxicity
from labelmesh.runtime import shared_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


@_query
def op1_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return token_counts.token_counts(_read(spark, sf, "documents"))


#: the conversation whose texts consist of control strings
CONTROL = "\\### Assistant: </turn> ok"


@_query
def op2_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    """Every conversation formatted as ids and mask, and read back from these."""
    table = _read(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast(table.schema["conv_id"].dataType).alias("conv_id"), F.col("id").cast(table.schema["turn"].dataType).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL).alias("text"))
    return chat.read_back(chat.format_turns(table.unionByName(extra)))


_ESCAPES = "(length({0}) - length(replace({0}, chr(92), ''))) + coalesce(list_sum(list_transform(regexp_extract_all({0}, '#{{3,}}'), lambda x: length(x) - 2)), 0) + (length({0}) - length(replace({0}, '</turn>', ''))) // 7"

ORACLES["op2_chat_format"] = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', chr(92) || '### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', chr(92) || '### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('### ' || role || ': ' || text || '</turn>' || chr(10)) + {_ESCAPES.format("text")} + {_ESCAPES.format("role")}
    + (length(role) - length(replace(role, ': ', ''))) // 2)::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""


@_query
def op3_token_files(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of all documents written to grammar-compressed files and read back."""
    folder = shared_path(spark, "token-files")
    grammar.write_token_files(_read(spark, sf, "documents"), folder, added=True)
    return grammar.document_checksums(grammar.read_token_files(spark, folder))


@_query
def op6_pack_sequences(spark: SparkSession, sf: str) -> DataFrame:
    """Pieces of all documents and the sequences that hold them."""
    return packing.pack_documents(_read(spark, sf, "documents"), added=True)


@_query
def op5_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    """All documents with the words that the mix takes of each."""
    return mixing.mix_documents(_read(spark, sf, "documents"))


ORACLES["op5_mix_sources"] = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || chr(31) || coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents
), s AS (
  SELECT source, n, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM (SELECT source, sum(size)::BIGINT AS n FROM d GROUP BY source)
), o AS (
  SELECT *, (1.5::DOUBLE * (SELECT sum(n) FROM s)::DOUBLE - coalesce(sum(2 * n) OVER before, 0)::DOUBLE)
      / ((SELECT sum(w) FROM s) - coalesce(sum(w) OVER before, 0))::DOUBLE AS rate,
    row_number() OVER (ORDER BY n::DOUBLE / w, source ASC NULLS LAST) AS nth
  FROM s WINDOW before AS (ORDER BY n::DOUBLE / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), r AS (SELECT arg_min(rate, nth) AS rate FROM o WHERE w * rate <= 2 * n
), t AS (
  SELECT source, n, CASE WHEN w * r.rate > 2 * n THEN 2.0::DOUBLE * n ELSE w * r.rate END AS target FROM s, r
), b AS (
  SELECT *, CASE WHEN n > 0 THEN floor(target / n)::BIGINT ELSE 0 END AS rounds FROM t
), c AS (
  SELECT d.*, b.n, b.target, b.rounds, b.target - b.rounds * b.n AS rest,
    sum(size) OVER (PARTITION BY d.source ORDER BY h ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, n AS source_size, target::DOUBLE AS target,
  (size * (rounds + CASE WHEN upto <= rest OR (upto - size <= rest AND upto - rest < rest - (upto - size)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""


@_query
def op7_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Counts, distances and verdict of every document."""
    return divergence.quality(_read(spark, sf, "documents"))


@_query
def op8_language_id(spark: SparkSession, sf: str) -> DataFrame:
    """Language of every document, learned from the rows that are not held out."""
    return language.identify_languages(_read(spark, sf, "documents"))


@_query
def op10_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """Toxicity of every document, learned from the labels that are not held out."""
    return toxicity.score_toxicity(_read(spark, sf, "documents"), _read(spark, sf, "labels"))


@_query
def op4_embedding_neardup(spark: SparkSession, sf: str) -> DataFrame:
    """Links and components of all embeddings."""
    return subspace.near_duplicates(_read(spark, sf, "embeddings"))


ORACLES["op4_embedding_neardup"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings
), l AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE a.n > 0 AND b.n > 0 AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95
), r AS (
  SELECT vec_id AS x, vec_id AS c FROM v UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.x
)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.x = v.vec_id)::BIGINT AS n_links, min(c) AS component_id, vec_id = min(c) AS kept
FROM v JOIN r ON r.x = v.vec_id GROUP BY vec_id
"""


@_query
def op9_ngram_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return jaccard.jaccard_classes(_read(spark, sf, "documents"))


@_query
def op11_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    """Quality of every document, learned from the labels that are not held out."""
    return boosting.score_quality(_read(spark, sf, "documents"), _read(spark, sf, "labels"))


@_query
def op12_lexical_search(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return lexical.search(_read(spark, sf, "documents"), _read(spark, sf, "benchmark"))


ORACLES["op12_lexical_search"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents
), i AS (
  SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM (SELECT DISTINCT item_id, text FROM benchmark)
), g AS (SELECT count(*)::BIGINT AS n, sum(len(t))::BIGINT AS l FROM d WHERE len(t) > 0
), m AS (SELECT r, doc_id, 100 - 75 + (75 * len(t) * g.n) // g.l AS m FROM d, g WHERE len(t) > 0
), p AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(t) AS term FROM d) GROUP BY ALL
), f AS (SELECT term, floor(1000 * ln((2 * any_value(g.n) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, g GROUP BY term
), a AS (SELECT q, item_id, term, count(*)::BIGINT AS times FROM (SELECT q, item_id, unnest(t) AS term FROM i) GROUP BY ALL
), s AS (
  SELECT q, item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM a JOIN f USING (term) JOIN p USING (term) JOIN m USING (r) GROUP BY ALL
), k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k WHERE rank <= 10
"""


@_query
def op13_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Periodic runs of every document, those whose end is made periodic among them."""
    return periods.periodic_runs(_read(spark, sf, "documents"), periods.planted)
