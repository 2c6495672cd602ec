"""Registered queries: votes, rankings and label alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelmesh.functions import arrays
from labelmesh.operators import prep, votes
from labelmesh.plans import sqltext as S, views as V
from labelmesh.plans.registry import query


def long_p(df, digits: int = 6, name: str = "p", index: str = "truth"):
    """(item_id, truth, p) with p rounded."""
    return arrays.long_form(df, name, index, "_v").withColumn("_v", F.round("_v", digits)).withColumnRenamed("_v", "p")


@query("vote_counts", f"WITH {S.LINE} SELECT item_id, label, sum(n)::BIGINT AS n FROM ann GROUP BY ALL")
def vote_counts(spark, sf):
    return votes.vote_counts(V.line_annotations(spark, sf))


@query("soft_majority", f"""WITH {S.DOC_ITEMS}, {S.LABEL_ANN},
k AS {S.classes(2)}
SELECT i.item_id, k.truth, round(sum((a.label = k.truth)::INT * a.n) / sum(a.n)::DOUBLE, 6) AS p
FROM items i JOIN ann a ON a.item_id = i.item_id, k GROUP BY ALL""")
def soft_majority(spark, sf):
    """Items without annotations have a NULL distribution and so give no rows here."""
    p = votes.soft_majority(V.label_annotations(spark, sf), V.doc_items(spark, sf), 2)
    return long_p(p)


SMOOTHED = f"""j AS (SELECT count(DISTINCT annotator_id) AS j FROM ann),
g0 AS (
  SELECT i.item_id, k.truth,
         (coalesce(sum((a.label = k.truth)::INT * a.n), 0) + any_value(j.j) * 1e-6)
         / (coalesce(sum(a.n), 0) + any_value(j.j) * 1e-6 * KK)::DOUBLE AS g
  FROM items i CROSS JOIN k CROSS JOIN j LEFT JOIN ann a ON a.item_id = i.item_id GROUP BY i.item_id, k.truth)"""


@query("smoothed_majority", f"""WITH {S.LINE}, k AS {S.classes(3)}, {SMOOTHED.replace('KK', '3')}
SELECT item_id, truth, round(g, 6) AS p FROM g0""")
def smoothed_majority(spark, sf):
    ann = V.line_annotations(spark, sf)
    n = ann.select("annotator_id").distinct().count()
    return long_p(votes.smoothed_majority(ann, V.line_items(spark, sf), 3, n))


@query("majority_vote", f"""WITH {S.DOC_ITEMS}, {S.LABEL_ANN}, {S.MAJORITY}
SELECT i.item_id, m.label FROM items i LEFT JOIN maj m ON m.item_id = i.item_id""")
def majority_vote(spark, sf):
    return votes.majority_vote(V.label_annotations(spark, sf), V.doc_items(spark, sf))


@query("majority_vote_lines", f"WITH {S.LINE}, {S.MAJORITY} SELECT item_id, label FROM maj")
def majority_vote_lines(spark, sf):
    return votes.majority_vote(V.line_annotations(spark, sf))


@query("arbiter_vote", f"""WITH {S.ORDERS}, {S.MAJORITY},
arb AS (SELECT item_id, label, row_number() OVER (PARTITION BY item_id ORDER BY sum(1) DESC, label) AS r
        FROM ann WHERE annotator_id = '1-URGENT' GROUP BY item_id, label),
tot AS (SELECT item_id, sum(n) AS n, sum((annotator_id = '1-URGENT')::INT) AS a FROM ann GROUP BY 1)
SELECT m.item_id, coalesce(arb.label, m.label) AS label, (t.n > 3 OR t.a > 1) AS violation
FROM maj m JOIN tot t ON t.item_id = m.item_id LEFT JOIN arb ON arb.item_id = m.item_id AND arb.r = 1""")
def arbiter_vote(spark, sf):
    return votes.arbiter_vote(V.order_annotations(spark, sf), F.col("annotator_id") == "1-URGENT", strict=False)


#: seeds of the three saved runs the chain queries combine (fixed values)
RUNS = [1, 2, 3]


def _runs(spark, sf):
    items = V.line_items(spark, sf)
    ann = V.line_annotations(spark, sf)
    out = None
    for run in RUNS:
        y = prep.perturb_labels(votes.majority_vote(ann), 3, 0.3, run).withColumnRenamed("label", "y")
        m = prep.uniform_assignment(items, 3, run).withColumnRenamed("label", "m")
        one = y.join(m, "item_id").select(F.lit(run).alias("run"), "item_id", "y", "m")
        out = one if out is None else out.unionByName(one)
    return out


_RUNS_SQL = " UNION ALL ".join(
    f"""SELECT {r} AS run, item_id, CASE WHEN {S.uniform(f'{r}-hit', 'item_id')} < 0.3
        THEN ({S.hash_int(f'{r}-new', 'item_id')} % 3)::INT ELSE label END AS y,
        ({S.hash_int(str(r), 'item_id')} % 3)::INT AS m FROM maj""" for r in RUNS)


def _mode_sql(source: str, column: str) -> str:
    return f"""(SELECT item_id, {column} FROM (SELECT item_id, {column},
      row_number() OVER (PARTITION BY item_id ORDER BY count(*) DESC, {column}) AS r
      FROM {source} GROUP BY item_id, {column}) WHERE r = 1)"""


@query("chain_vote", f"""WITH {S.LINE}, {S.MAJORITY}, runs AS ({_RUNS_SQL})
SELECT a.item_id, a.y, b.m FROM {_mode_sql('runs', 'y')} a JOIN {_mode_sql('runs', 'm')} b ON a.item_id = b.item_id""")
def chain_vote(spark, sf):
    return votes.chain_vote(_runs(spark, sf))


@query("chain_vote_tokens", f"""WITH {S.LINE}, {S.MAJORITY}, runs AS ({_RUNS_SQL}),
z AS (SELECT item_id, 0 AS pos, y AS z FROM runs UNION ALL SELECT item_id, 1, m FROM runs)
SELECT item_id, pos, z FROM (SELECT item_id, pos, z,
  row_number() OVER (PARTITION BY item_id, pos ORDER BY count(*) DESC, z) AS r FROM z
  GROUP BY item_id, pos, z) WHERE r = 1""")
def chain_vote_tokens(spark, sf):
    return votes.chain_vote_tokens(_runs(spark, sf).withColumn("z", F.array("y", "m")))


@query("marginal_mode", f"""WITH {S.LINE}, {S.MAJORITY}, runs AS ({_RUNS_SQL})
SELECT item_id, y AS label FROM {_mode_sql('runs', 'y')}""")
def marginal_mode(spark, sf):
    return votes.marginal_mode(_runs(spark, sf).select(F.col("run").alias("sweep"), "item_id", F.col("y").alias("label")))


@query("ranked_labels", f"""WITH {S.LINE}
SELECT item_id, label, sum(n)::BIGINT AS score,
  row_number() OVER (PARTITION BY item_id ORDER BY sum(n) DESC, label)::INT AS rank
FROM ann GROUP BY item_id, label""")
def ranked_labels(spark, sf):
    counts = votes.vote_counts(V.line_annotations(spark, sf)).withColumnRenamed("n", "score")
    return votes.ranked_labels(counts)


@query("log_normalize", f"""WITH {S.LINE}, k AS {S.classes(3)},
s AS (SELECT i.item_id, k.truth, coalesce(sum((a.label = k.truth)::INT * a.n), 0)::DOUBLE AS s
      FROM items i CROSS JOIN k LEFT JOIN ann a ON a.item_id = i.item_id GROUP BY ALL)
SELECT item_id, truth, round(exp(s - max(s) OVER w) / sum(exp(s)) OVER w * exp(max(s) OVER w), 6) AS p
FROM s WINDOW w AS (PARTITION BY item_id)""")
def log_normalize(spark, sf):
    """Softmax of the vote counts."""
    scores = votes.vote_array(V.line_annotations(spark, sf), 3)
    full = V.line_items(spark, sf).join(scores, "item_id", "left").withColumn(
        "votes", F.expr(f"coalesce(votes, {arrays.zeros(3)})")
    )
    return long_p(arrays.softmax(full, "votes", "p", 3))
