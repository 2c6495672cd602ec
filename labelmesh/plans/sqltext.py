"""Common table expressions and formulas shared by the checking SQL."""

from __future__ import annotations

from labelmesh.plans.views import EMB_ACCURACY


def hash_int(seed: str, *keys: str) -> str:
    text = " || ':' || ".join([f"'{seed}'", *[f"cast({k} AS VARCHAR)" for k in keys]])
    return f"cast('0x' || substr(md5({text}), 1, 8) AS BIGINT)"


def uniform(seed: str, *keys: str) -> str:
    return f"(({hash_int(seed, *keys)} + 0.5) / 4294967296.0)"


def digamma(x: str) -> str:
    z = f"({x} + 6.0)"
    r = f"(1.0::DOUBLE / ({z} * {z}))"
    back = " - ".join(f"1.0::DOUBLE / ({x} + {i})" for i in range(6))
    return (
        f"(ln({z}) - 0.5::DOUBLE / {z} - {r} * (1.0::DOUBLE/12 - {r} * (1.0::DOUBLE/120 - {r} * (1.0::DOUBLE/252 - "
        f"{r} * (1.0::DOUBLE/240 - {r} / 132)))) - {back})"
    )


LINE_EVENTS = """ev AS (
  SELECT l_partkey AS item_id, l_suppkey AS annotator_id,
         CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 END AS label,
         l_shipdate AS ts, l_orderkey, l_linenumber
  FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R'))"""

LINE = LINE_EVENTS + """,
items AS (SELECT p_partkey AS item_id FROM part),
ann AS (SELECT item_id, annotator_id, label, count(*)::BIGINT AS n FROM ev GROUP BY ALL)"""

ORDERS = """ev AS (
  SELECT o_custkey AS item_id, o_orderpriority AS annotator_id,
         CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 2 END AS label, o_orderdate AS ts, o_orderkey
  FROM orders WHERE o_orderstatus IN ('F', 'O', 'P')),
items AS (SELECT c_custkey AS item_id FROM customer),
ann AS (SELECT item_id, annotator_id, label, count(*)::BIGINT AS n FROM ev GROUP BY ALL)"""

EMB = f"""items AS (SELECT vec_id AS item_id, label AS gold_label, embedding AS location FROM embeddings),
raters AS (SELECT unnest(range({len(EMB_ACCURACY)})) AS annotator_id, unnest({EMB_ACCURACY}) AS acc),
ann AS (
  SELECT item_id, annotator_id::INT AS annotator_id,
         (CASE WHEN h % 100 < acc THEN gold_label ELSE (gold_label + 1 + h % 9) % 10 END)::INT AS label, 1::BIGINT AS n
  FROM (SELECT *, {hash_int('emb', 'item_id', 'annotator_id')} AS h FROM items, raters))"""

DOC_ITEMS = """items AS (
  SELECT d.doc_id AS item_id, l.quality AS observed_label FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""

LABEL_ANN = "ann AS (SELECT doc_id AS item_id, 0 AS annotator_id, quality AS label, 1::BIGINT AS n FROM labels)"

DOC_ANN = f"""ann AS (
  SELECT item_id, annotator_id, label::INT AS label, 1::BIGINT AS n FROM (
    SELECT d.doc_id AS item_id, unnest(range(5)) AS annotator_id,
      unnest([(d.n_chars >= 1000)::INT, (d.lang = 'en')::INT, (length(d.source) % 2)::INT,
              ({hash_int('doc', 'd.doc_id')} % 2)::INT, l.quality]) AS label
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id) WHERE label IS NOT NULL)"""

TOKENS = """tok AS (
  SELECT item_id, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos
  FROM (SELECT doc_id AS item_id, regexp_extract_all(lower(text), '[a-z]+') AS words FROM documents))"""


def features(cutoff: int = 0) -> str:
    return f"""{TOKENS},
bag AS (SELECT item_id, word AS feature, count(*)::DOUBLE AS value FROM tok GROUP BY ALL),
feat AS (SELECT b.* FROM bag b
         JOIN (SELECT feature FROM bag GROUP BY 1 HAVING sum(value) > {cutoff}) v ON v.feature = b.feature)"""


#: majority label of every item of ``ann`` (ties: lowest label)
MAJORITY = """maj AS (
  SELECT item_id, label FROM (
    SELECT item_id, label, row_number() OVER (PARTITION BY item_id ORDER BY sum(n) DESC, label) AS r
    FROM ann GROUP BY item_id, label) WHERE r = 1)"""


def classes(k: int, name: str = "truth") -> str:
    """A derived table of class indices."""
    return f"(SELECT unnest(range({k}))::INT AS {name})"


def prior_cell(diag: float, off: float, a: str, b: str) -> str:
    return f"CASE WHEN {a} = {b} THEN {diag!r}::DOUBLE ELSE {off!r}::DOUBLE END"
