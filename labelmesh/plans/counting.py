"""Registered queries: count tables, joins, confusion matrices and accuracies."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from labelmesh.functions import arrays, special
from labelmesh.models.variational import argmax_labels
from labelmesh.operators import counts, joins, prep, votes
from labelmesh.plans import sqltext as S, views as V
from labelmesh.plans.registry import query
from labelmesh.plans.voting import long_p
from labelmesh.priors import Priors
from labelmesh.runtime import cut
from labelmesh.sources import state

P = Priors()
SEED = 11
D3, O3 = P.annotator_cell(3)
M3D, M3O = P.machine_cell(3)
#: weight of the line items' parts in weighted counts
WEIGHT = 0.5


def _stored(spark, sf):
    """Compiled line annotations, stored because the query reads them several times."""
    return cut(V.line_annotations(spark, sf), "annotations")


def _assigned(spark, sf, annotations=None):
    votes_on = V.line_annotations(spark, sf) if annotations is None else annotations
    return votes.majority_vote(votes_on).withColumn("weight", F.lit(WEIGHT))


def rounded(df, *names, digits: int = 6):
    for n in names:
        df = df.withColumn(n, F.round(n, digits))
    return df


@query("class_counts", f"""WITH {S.LINE}, {S.MAJORITY}, k AS {S.classes(3, 'label')}
SELECT k.label, round(ln({P.b_theta} + coalesce(sum({WEIGHT}) FILTER (WHERE m.label IS NOT NULL), 0)), 6) AS log_count
FROM k LEFT JOIN maj m ON m.label = k.label GROUP BY 1""")
def class_counts(spark, sf):
    return rounded(counts.class_counts(_assigned(spark, sf), 3, P), "log_count")


@query("vocab_counts", f"""WITH {S.features()}, {S.DOC_ANN}, {S.MAJORITY}, k AS {S.classes(2, 'label')},
v AS (SELECT DISTINCT feature FROM feat)
SELECT v.feature, k.label, round({P.b_phi} + coalesce(s.t, 0), 6) AS total
FROM v CROSS JOIN k LEFT JOIN (SELECT f.feature, m.label, sum(f.value * 0.5) AS t FROM feat f
  JOIN maj m ON m.item_id = f.item_id GROUP BY ALL) s ON s.feature = v.feature AND s.label = k.label""")
def vocab_counts(spark, sf):
    y = votes.majority_vote(V.doc_annotations(spark, sf)).withColumn("weight", F.lit(0.5))
    return rounded(counts.vocab_counts(V.doc_features(spark, sf), y, 2, P), "total")


@query("machine_counts", f"""WITH {S.LINE}, {S.MAJORITY}, a AS {S.classes(3)}, b AS {S.classes(3, 'm')},
pair AS (SELECT item_id, label AS y, ({S.hash_int(str(SEED), 'item_id')} % 3)::INT AS mm FROM maj)
SELECT a.truth, b.m, round({S.prior_cell(M3D, M3O, 'a.truth', 'b.m')} + {WEIGHT} * count(p.item_id), 6) AS total
FROM a CROSS JOIN b LEFT JOIN pair p ON p.y = a.truth AND p.mm = b.m GROUP BY a.truth, b.m""")
def machine_counts(spark, sf):
    y = _assigned(spark, sf).withColumnRenamed("label", "y")
    m = prep.uniform_assignment(V.line_items(spark, sf), 3, SEED).withColumnRenamed("label", "m")
    return rounded(counts.machine_counts(y.join(m, "item_id"), 3, P), "total")


CONFUSION = f"""a AS {S.classes(3)}, b AS {S.classes(3, 'label')}, j AS (SELECT DISTINCT annotator_id FROM ann),
conf AS (SELECT j.annotator_id, a.truth, b.label,
  {S.prior_cell(D3, O3, 'a.truth', 'b.label')} + {WEIGHT} * coalesce(s.n, 0) AS value
  FROM j CROSS JOIN a CROSS JOIN b LEFT JOIN (
    SELECT ann.annotator_id, m.label AS truth, ann.label, sum(ann.n) AS n
    FROM ann JOIN maj m ON m.item_id = ann.item_id GROUP BY ALL) s
  ON s.annotator_id = j.annotator_id AND s.truth = a.truth AND s.label = b.label)"""


def _confusion(spark, sf):
    ann = _stored(spark, sf)
    return counts.confusion_counts(ann, _assigned(spark, sf, ann), ann.select("annotator_id").distinct(), 3, P)


@query("confusion_counts", f"""WITH {S.LINE}, {S.MAJORITY}, {CONFUSION}
SELECT annotator_id, truth, label, round(value, 6) AS value,
  round(sum(value) OVER (PARTITION BY annotator_id, truth), 6) AS row_total FROM conf""")
def confusion_counts(spark, sf):
    return rounded(_confusion(spark, sf), "value", "row_total")


@query("prior_confusion", f"""WITH {S.LINE}, a AS {S.classes(3)}, b AS {S.classes(3, 'label')}
SELECT DISTINCT annotator_id, truth, b.label, round({S.prior_cell(D3, O3, 'a.truth', 'b.label')}, 6) AS value
FROM ann, a, b""")
def prior_confusion(spark, sf):
    annotators = V.line_annotations(spark, sf).select("annotator_id").distinct()
    return rounded(counts.prior_confusion(annotators, 3, P.b_gamma, P.c_gamma), "value")


@query("normalize_rows", f"""WITH {S.LINE}, {S.MAJORITY}, {CONFUSION}
SELECT annotator_id, truth, label, round(value / sum(value) OVER (PARTITION BY annotator_id, truth), 6) AS value
FROM conf""")
def normalize_rows(spark, sf):
    return rounded(counts.normalize_rows(_confusion(spark, sf).drop("row_total")), "value")


ACCURACY = f"""norm AS (SELECT *, value / sum(value) OVER (PARTITION BY annotator_id, truth) AS v FROM conf),
theta AS (SELECT label AS truth, count(*) / sum(count(*)) OVER () AS share FROM maj GROUP BY 1),
acc AS (SELECT annotator_id, sum(share * v) AS accuracy FROM norm JOIN theta ON theta.truth = norm.truth
  WHERE norm.label = norm.truth GROUP BY 1)"""


def _accuracy(spark, sf):
    theta = _assigned(spark, sf).groupBy(F.col("label").alias("truth")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return counts.annotator_accuracy(counts.normalize_rows(_confusion(spark, sf).drop("row_total")), theta)


@query("annotator_accuracy", f"""WITH {S.LINE}, {S.MAJORITY}, {CONFUSION}, {ACCURACY}
SELECT annotator_id, round(accuracy, 6) AS accuracy FROM acc""")
def annotator_accuracy(spark, sf):
    return rounded(_accuracy(spark, sf), "accuracy")


@query("annotator_report", f"""WITH {S.LINE}, {S.MAJORITY}, {CONFUSION}, {ACCURACY}
SELECT n.annotator_id, round(any_value(acc.accuracy), 6) AS accuracy,
  string_agg(printf('%d/%d=%d', n.truth, n.label, round(n.v * 1000000)::BIGINT), ' ' ORDER BY n.truth, n.label) AS matrix
FROM norm n JOIN acc ON acc.annotator_id = n.annotator_id GROUP BY 1""")
def annotator_report(spark, sf):
    norm = counts.normalize_rows(_confusion(spark, sf).drop("row_total"))
    report = state.annotator_report(norm, _accuracy(spark, sf))
    text = "array_join(transform(matrix, c -> format_string('%d/%d=%d', c.truth, c.label, cast(round(c.value * 1000000) AS bigint))), ' ')"
    return report.select("annotator_id", F.round("accuracy", 6).alias("accuracy"), F.expr(text).alias("matrix"))


@query("machine_accuracy", f"""WITH {S.LINE}, {S.MAJORITY},
pair AS (SELECT label AS y, ({S.hash_int(str(SEED), 'item_id')} % 3)::INT AS m FROM maj),
a AS {S.classes(3)}, b AS {S.classes(3, 'm')},
mu AS (SELECT a.truth, b.m, {S.prior_cell(M3D, M3O, 'a.truth', 'b.m')} + {WEIGHT} * count(p.y) AS v
  FROM a CROSS JOIN b LEFT JOIN pair p ON p.y = a.truth AND p.m = b.m GROUP BY a.truth, b.m),
theta AS (SELECT label AS truth, count(*) / sum(count(*)) OVER () AS share FROM maj GROUP BY 1)
SELECT round(sum(share * v / tot), 6) AS accuracy FROM (SELECT *, sum(v) OVER (PARTITION BY truth) AS tot FROM mu) x
JOIN theta ON theta.truth = x.truth WHERE x.m = x.truth""")
def machine_accuracy(spark, sf):
    y = _assigned(spark, sf).withColumnRenamed("label", "y")
    m = prep.uniform_assignment(V.line_items(spark, sf), 3, SEED).withColumnRenamed("label", "m")
    mu = counts.machine_counts(y.join(m, "item_id"), 3, P)
    norm = mu.select("truth", "m", (F.col("total") / F.sum("total").over(Window.partitionBy("truth"))).alias("value"))
    theta = y.groupBy(F.col("y").alias("truth")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return rounded(counts.machine_accuracy(norm, theta), "accuracy")


@query("gold_confusion", f"""WITH {S.EMB}, {S.MAJORITY}
SELECT i.gold_label AS gold, m.label AS guess, count(*)::BIGINT AS n
FROM maj m JOIN items i ON i.item_id = m.item_id GROUP BY ALL""")
def gold_confusion(spark, sf):
    return counts.gold_confusion(votes.majority_vote(V.emb_annotations(spark, sf)), V.emb_items(spark, sf))


@query("gold_confusion_unannotated", f"""WITH {S.DOC_ITEMS}, {S.DOC_ANN}, {S.MAJORITY},
marked AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1)
SELECT i.observed_label AS gold, m.label AS guess, count(*)::BIGINT AS n FROM maj m JOIN items i ON i.item_id = m.item_id
WHERE i.observed_label IS NOT NULL AND i.item_id NOT IN (SELECT doc_id FROM marked) GROUP BY ALL""")
def gold_confusion_unannotated(spark, sf):
    """Gold confusion over the items without an annotation, where annotations are the toxic marks."""
    items = V.doc_items(spark, sf).withColumnRenamed("observed_label", "gold_label")
    marks = V.table(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").alias("item_id"))
    return counts.gold_confusion(votes.majority_vote(V.doc_annotations(spark, sf)), items, marks, annotated=False)


@query("accuracy", f"""WITH {S.EMB}, {S.MAJORITY}
SELECT round(avg((m.label = i.gold_label)::INT), 6) AS accuracy, count(*)::BIGINT AS labelled
FROM maj m JOIN items i ON i.item_id = m.item_id""")
def accuracy(spark, sf):
    return rounded(counts.accuracy(votes.majority_vote(V.emb_annotations(spark, sf)), V.emb_items(spark, sf)), "accuracy")


@query("definiteness", f"""WITH {S.LINE}, {S.MAJORITY}, {CONFUSION},
norm AS (SELECT *, value / sum(value) OVER (PARTITION BY annotator_id, truth) AS v FROM conf)
SELECT annotator_id, round(sum(least(v, 1 - v) * least(v, 1 - v)), 6) AS indecision FROM norm GROUP BY 1""")
def definiteness(spark, sf):
    norm = counts.normalize_rows(_confusion(spark, sf).drop("row_total"))
    return rounded(counts.definiteness(norm), "indecision")


@query("annotation_totals", f"WITH {S.LINE} SELECT item_id, annotator_id, sum(n)::BIGINT AS n FROM ann GROUP BY ALL")
def annotation_totals(spark, sf):
    return counts.annotation_totals(V.line_annotations(spark, sf))


SOFT = f"""k AS {S.classes(3)},
g AS (SELECT a.item_id, k.truth, sum((a.label = k.truth)::INT * a.n) / sum(a.n)::DOUBLE AS p FROM ann a, k GROUP BY ALL)"""


def _soft(spark, sf, annotations=None):
    votes_on = V.line_annotations(spark, sf) if annotations is None else annotations
    return votes.soft_majority(votes_on, V.line_items(spark, sf), 3).filter("p IS NOT NULL")


@query("soft_confusion", f"""WITH {S.LINE}, {SOFT}
SELECT annotator_id, label, truth, round(sum(n * p), 6) AS value
FROM ann JOIN g ON g.item_id = ann.item_id GROUP BY ALL""")
def soft_confusion(spark, sf):
    ann = _stored(spark, sf)
    soft = joins.soft_confusion(ann, _soft(spark, sf, ann), 3)
    return rounded(arrays.long_form(soft, "c", "truth", "value"), "value")


@query("annotation_evidence", f"""WITH {S.LINE}, {SOFT},
w AS (SELECT annotator_id, label, truth, ln(1 + sum(n * p)) AS w FROM ann JOIN g ON g.item_id = ann.item_id GROUP BY ALL)
SELECT ann.item_id, w.truth, round(sum(ann.n * w.w), 6) AS p
FROM ann JOIN w ON w.annotator_id = ann.annotator_id AND w.label = ann.label GROUP BY ALL""")
def annotation_evidence(spark, sf):
    """Evidence with weights ln(1 + soft count)."""
    ann = _stored(spark, sf)
    soft = joins.soft_confusion(ann, _soft(spark, sf, ann), 3)
    w = soft.select("annotator_id", "label", F.transform("c", lambda c: F.log1p(c)).alias("w"))
    return long_p(joins.annotation_evidence(ann, w, 3), name="evidence")


DOC_SOFT = f"""k AS {S.classes(2)},
g AS (SELECT a.item_id, k.truth, sum((a.label = k.truth)::INT * a.n) / sum(a.n)::DOUBLE AS p FROM ann a, k GROUP BY ALL)"""


def _doc_soft(spark, sf):
    return votes.soft_majority(V.doc_annotations(spark, sf), V.doc_items(spark, sf), 2)


@query("soft_vocab_counts", f"""WITH {S.features()}, {S.DOC_ANN}, {DOC_SOFT}
SELECT feature, truth, round(sum(value * p), 5) AS value FROM feat JOIN g ON g.item_id = feat.item_id GROUP BY ALL""")
def soft_vocab_counts(spark, sf):
    soft = joins.soft_vocab_counts(V.doc_features(spark, sf), _doc_soft(spark, sf), 2)
    return rounded(arrays.long_form(soft, "c", "truth", "value"), "value", digits=5)


@query("feature_evidence", f"""WITH {S.features()}, {S.DOC_ANN}, {DOC_SOFT},
w AS (SELECT feature, truth, ln(1 + sum(value * p)) AS w FROM feat JOIN g ON g.item_id = feat.item_id GROUP BY ALL)
SELECT feat.item_id, w.truth, round(sum(feat.value * w.w), 5) AS p
FROM feat JOIN w ON w.feature = feat.feature GROUP BY ALL""")
def feature_evidence(spark, sf):
    feat = V.doc_features(spark, sf)
    soft = joins.soft_vocab_counts(feat, _doc_soft(spark, sf), 2)
    w = soft.select("feature", F.transform("c", lambda c: F.log1p(c)).alias("w"))
    return long_p(joins.feature_evidence(feat, w, 2), 5, "evidence")


@query("soft_machine_confusion", f"""WITH {S.LINE}, {SOFT},
h AS (SELECT truth AS m, item_id, p AS h FROM g)
SELECT g.truth, h.m, round(sum(g.p * h.h), 5) AS value FROM g JOIN h ON h.item_id = g.item_id GROUP BY ALL""")
def soft_machine_confusion(spark, sf):
    pairs = _soft(spark, sf).withColumn("h", F.col("p"))
    one = joins.soft_machine_confusion(pairs, 3)
    long = arrays.long_form(one, "c", "cell", "value")
    return long.select(
        F.expr("cast(floor(cell / 3) AS int)").alias("truth"), F.expr("cast(cell % 3 AS int)").alias("m"),
        F.round("value", 5).alias("value"),
    )


@query("special_functions", f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round({S.digamma('x')}, 6) AS psi, round(lgamma(x), 4) AS lg,
  round(lgamma(x + 3) - lgamma(x), 6) AS rising, round(lgamma(x) + lgamma(y) - lgamma(x + y), 5) AS log_b,
  round(ln(exp(x / 50) + exp(y / 50)), 6) AS log_sum
FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity + l_discount AS x, 0.5 + l_tax AS y FROM lineitem)""")
def special_functions(spark, sf):
    base = V.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.expr("l_quantity + l_discount").alias("x"), F.expr("0.5D + l_tax").alias("y")
    )
    return base.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.expr(f"round({special.digamma('x')}, 6)").alias("psi"),
        F.expr(f"round({special.lgamma('x')}, 4)").alias("lg"),
        F.expr(f"round({special.log_rising('x', '3')}, 6)").alias("rising"),
        F.expr(f"round({special.log_beta(['x', 'y'])}, 5)").alias("log_b"),
        F.expr(f"round({special.log_add(['(x / 50D)', '(y / 50D)'])}, 6)").alias("log_sum"),
    )
