"""Registered queries: measurements."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelmesh.functions import arrays
from labelmesh.models import measurement as MM
from labelmesh.operators import measurements as ms, votes
from labelmesh.plans import modelsql as Q, sqltext as S, views as V
from labelmesh.plans.counting import rounded
from labelmesh.plans.preparing import EMB_LONG, emb_long
from labelmesh.plans.registry import query
from labelmesh.plans.voting import long_p
from labelmesh.priors import Priors
from labelmesh.runtime import cut

#: (alpha, beta) of the noise prior are b_gamma and c_gamma
P = Priors(b_gamma=2.0, c_gamma=1.0)
#: neighbours kept per location
NEAR = 20

_EMPTY = {
    "item_id": "bigint", "predicate": "string", "location": "array<double>", "source_item": "bigint", "neighbors": "int",
}


def _shape(df, key: str, kind: str):
    """Give a measurement table all fields; ``key`` (SQL text) identifies a row within its kind."""
    for name, kind_of in _EMPTY.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind_of))
    df = df.withColumn("kind", F.lit(kind)).withColumn("meas_id", F.expr(f"xxhash64('{kind}', {key})"))
    return df.select(*ms.MEASUREMENT_FIELDS)


def emb_marks(spark, sf):
    return _shape(V.emb_annotations(spark, sf).select("item_id", "annotator_id", "label", F.lit(1.0).alias("value")),
                  "annotator_id, item_id", ms.ANNOTATION)


def centroids(spark, sf):
    """Mean location of every class: (label, location)."""
    gold = V.emb_items(spark, sf).select("item_id", F.col("gold_label").alias("label"))
    means = emb_long(spark, sf).join(gold, "item_id").groupBy("label", "feature").agg(F.avg("value").alias("v"))
    return means.groupBy("label").agg(
        F.expr("transform(array_sort(collect_list(struct(feature, v))), x -> x.v)").alias("location")
    )


def emb_regions(spark, sf):
    """One labelled location per class centroid (annotator 5) and one per class from its first vector (annotator 6)."""
    near = F.lit(NEAR).alias("neighbors")
    value = F.lit(8.0).alias("value")
    given = centroids(spark, sf).select("label", "location", F.lit(5).alias("annotator_id"), value, near)
    first = V.emb_items(spark, sf).groupBy(F.col("gold_label").alias("label")).agg(F.min("item_id").alias("source_item"))
    by_item = first.select("label", "source_item", F.lit(6).alias("annotator_id"), value, near)
    return _shape(given, "annotator_id, label", ms.LOCATION).unionByName(_shape(by_item, "annotator_id, label", ms.LOCATION))


def doc_marks(spark, sf):
    return _shape(V.doc_annotations(spark, sf).select("item_id", "annotator_id", "label", F.lit(1.0).alias("value")),
                  "annotator_id, item_id", ms.ANNOTATION)


def doc_words(spark, sf, features=None):
    """Every word as a labelled word: label from the word's length, value four fifths of its tokens."""
    features = V.doc_features(spark, sf) if features is None else features
    words = cut(features.groupBy("feature").agg(F.sum("value").alias("n")), "words")
    return _shape(words.select(
        F.col("feature").alias("predicate"), F.expr("cast(length(feature) % 2 AS int)").alias("label"),
        F.expr("n * 0.8D").alias("value"), F.lit(5).alias("annotator_id"),
    ), "predicate", ms.PREDICATE)


def doc_shares(spark, sf):
    """Expected number of documents per quality class, scaled up from the reviewed ones."""
    n = V.documents(spark, sf).select(F.count(F.lit(1)).alias("n")).scalar()
    reviewed = V.label_annotations(spark, sf)
    total = reviewed.agg(F.count(F.lit(1))).scalar()
    share = reviewed.groupBy("label").agg((F.count(F.lit(1)) / total * n).alias("value"))
    return _shape(share.withColumn("annotator_id", F.lit(6)), "label", ms.PROPORTION)


def doc_measurements(spark, sf, features=None):
    return doc_marks(spark, sf).unionByName(doc_words(spark, sf, features)).unionByName(doc_shares(spark, sf))


CENTROID = f"""{EMB_LONG}, cen AS (SELECT e.label, f.feature, avg(f.value) AS v FROM f JOIN embeddings e ON e.vec_id = f.item_id
  GROUP BY e.label, f.feature)"""
ADJ = f"""{CENTROID},
cos AS (SELECT c.label AS source_id, f.item_id, sum(c.v * f.value) / (sqrt(sum(c.v * c.v)) * sqrt(sum(f.value * f.value))) AS cosine
  FROM cen c JOIN f ON f.feature = c.feature GROUP BY c.label, f.item_id)"""


@query("log_vote", f"""WITH {S.EMB}, k AS {S.classes(10)},
sc AS (SELECT i.item_id, k.truth, coalesce(sum((a.label = k.truth)::INT), 0)::DOUBLE AS score FROM items i CROSS JOIN k
  LEFT JOIN ann a ON a.item_id = i.item_id GROUP BY i.item_id, k.truth), {Q.softmax('q', 'sc', 'score')}
SELECT item_id, truth, round(g, 6) AS p FROM q""")
def log_vote(spark, sf):
    return long_p(votes.log_vote(emb_marks(spark, sf), V.emb_items(spark, sf), 10))


@query("measurement_counts", f"""WITH {S.features()}, {S.DOC_ANN},
w AS (SELECT DISTINCT feature FROM feat)
SELECT annotator_id, count(*)::BIGINT AS n FROM ann GROUP BY 1
UNION ALL SELECT 5, count(*) FROM w UNION ALL SELECT 6, count(DISTINCT quality) FROM labels""")
def measurement_counts(spark, sf):
    return ms.measurement_counts(doc_measurements(spark, sf))


@query("cosine_adjacency", f"WITH {ADJ} SELECT source_id, item_id, round(cosine, 6) AS cosine FROM cos")
def cosine_adjacency(spark, sf):
    """Cosine of every vector with every class centroid."""
    long = centroids(spark, sf).select(F.col("label").alias("source_id"), F.posexplode("location").alias("feature", "value"))
    return rounded(ms.cosine_adjacency(long, emb_long(spark, sf)), "cosine")


@query("knn_location", f"""WITH {ADJ}
SELECT source_id::BIGINT AS source_id, item_id, round(cosine, 6) AS cosine, rank::INT AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY round(cosine, 9) DESC, item_id) AS rank FROM cos)
WHERE rank <= {NEAR}""")
def knn_location(spark, sf):
    sources = centroids(spark, sf).select(F.col("label").cast("bigint").alias("source_id"), "location")
    return rounded(ms.knn_location(sources, V.emb_items(spark, sf), NEAR), "cosine")


WORD_TARGETS = f"""w AS (SELECT feature, sum(value) AS n FROM feat GROUP BY feature),
tg AS (SELECT f.item_id, f.feature, length(f.feature) % 2 AS label, 1.0 / w.n AS sigma, 0.8::DOUBLE AS tau
  FROM feat f JOIN w ON w.feature = f.feature)"""


@query("measurement_targets", f"""WITH {S.features()}, {S.DOC_ANN}, {WORD_TARGETS}
SELECT annotator_id, 'annotation' AS kind, label, item_id, count(*)::BIGINT AS targets, 1.0::DOUBLE AS sigma FROM ann GROUP BY ALL
UNION ALL SELECT 5, 'labeled_predicate', label::INT, item_id, count(*), 1.0 FROM tg GROUP BY ALL""")
def measurement_targets(spark, sf):
    features = V.doc_features(spark, sf)
    targets = ms.measurement_targets(doc_measurements(spark, sf, features), V.doc_items(spark, sf), features)
    return targets.groupBy("annotator_id", "kind", "label", "item_id").agg(
        F.count(F.lit(1)).alias("targets"), F.max("sigma").alias("sigma")
    )


@query("annotation_targets", f"WITH {S.DOC_ANN} SELECT item_id, count(*)::BIGINT AS n, sum(1.0)::DOUBLE AS sigma FROM ann GROUP BY 1")
def annotation_targets(spark, sf):
    found = ms.annotation_targets(doc_measurements(spark, sf), V.doc_items(spark, sf))
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.sum("sigma").alias("sigma"))


@query("predicate_targets", f"""WITH {S.features()}, {WORD_TARGETS}
SELECT t.feature AS predicate, t.item_id, 1.0::DOUBLE AS sigma, f.value AS words FROM tg t
JOIN feat f ON f.item_id = t.item_id AND f.feature = t.feature""")
def predicate_targets(spark, sf):
    features = V.doc_features(spark, sf)
    asked = doc_words(spark, sf, features)
    return ms.predicate_targets(asked, features).join(
        asked.select("meas_id", "predicate"), "meas_id"
    ).select("predicate", "item_id", "sigma", "words")


REGIONS = f"""{ADJ},
firsts AS (SELECT label, min(vec_id) AS item_id FROM embeddings GROUP BY label),
cos6 AS (SELECT s.label AS source_id, f.item_id, sum(v.value * f.value) / (sqrt(sum(v.value * v.value)) * sqrt(sum(f.value * f.value))) AS cosine
  FROM firsts s JOIN f v ON v.item_id = s.item_id JOIN f ON f.feature = v.feature GROUP BY s.label, f.item_id),
near AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY annotator_id, source_id ORDER BY round(cosine, 9) DESC, item_id) AS rank FROM (
    SELECT 5 AS annotator_id, * FROM cos UNION ALL SELECT 6, * FROM cos6)) WHERE rank <= {NEAR}),
reg AS (SELECT annotator_id, source_id AS label, item_id, cosine / r AS sigma, 8.0 / r AS tau FROM (
  SELECT *, sum(cosine) OVER (PARTITION BY annotator_id, source_id) AS r FROM near))"""


@query("location_targets", f"""WITH {REGIONS}
SELECT annotator_id, label, item_id, round(sigma, 6) AS sigma, round(tau, 6) AS tau FROM reg""")
def location_targets(spark, sf):
    """Scaled targets of the labelled locations."""
    asked, items = emb_regions(spark, sf), V.emb_items(spark, sf)
    targets = ms.measurement_targets(asked, items)
    scaled = ms.scale_measurements(targets, asked, ms.measurement_ranges(targets, asked))
    return rounded(scaled.select("annotator_id", "label", "item_id", "sigma", "tau"), "sigma", "tau")


@query("scale_measurements", f"""WITH {S.features()}, {WORD_TARGETS}
SELECT feature AS predicate, item_id, round(sigma, 8) AS sigma, round(tau, 6) AS tau FROM tg""")
def scale_measurements(spark, sf):
    feat = V.doc_features(spark, sf)
    asked = doc_words(spark, sf, feat)
    targets = ms.measurement_targets(asked, V.doc_items(spark, sf), feat)
    scaled = ms.scale_measurements(targets, asked, ms.measurement_ranges(targets, asked, feat))
    return scaled.join(asked.select("meas_id", "predicate"), "meas_id").select(
        "predicate", "item_id", F.round("sigma", 8).alias("sigma"), F.round("tau", 6).alias("tau")
    )


DOC_Q0 = f"""k AS {S.classes(2)},
sc0 AS (SELECT i.item_id, k.truth, coalesce(sum((a.label = k.truth)::INT), 0)::DOUBLE AS score FROM items i CROSS JOIN k
  LEFT JOIN ann a ON a.item_id = i.item_id GROUP BY i.item_id, k.truth), {Q.softmax('q0', 'sc0', 'score')}"""


@query("measurement_expectation", f"""WITH {S.features()}, {S.DOC_ITEMS}, {S.DOC_ANN}, {WORD_TARGETS}, {DOC_Q0}
SELECT t.feature AS predicate, round(sum(t.sigma * q.g), 6) AS e, round(sum(t.sigma * q.g * t.sigma * q.g), 8) AS q,
  round(sum(t.sigma * t.sigma * q.g), 8) AS s
FROM tg t JOIN q0 q ON q.item_id = t.item_id AND q.truth = t.label GROUP BY t.feature""")
def measurement_expectation(spark, sf):
    feat, items = V.doc_features(spark, sf), V.doc_items(spark, sf)
    asked = doc_words(spark, sf, feat)
    targets = ms.measurement_targets(asked, items, feat)
    scaled = ms.scale_measurements(targets, asked, ms.measurement_ranges(targets, asked, feat))
    p = votes.log_vote(doc_marks(spark, sf), items, 2)
    found = ms.measurement_expectation(scaled, p).join(asked.select("meas_id", "predicate"), "meas_id")
    return found.select("predicate", F.round("e", 6).alias("e"), F.round("q", 8).alias("q"), F.round("s", 8).alias("s"))


@query("proportion_expectation", f"""WITH {S.DOC_ITEMS}, {S.DOC_ANN}, {DOC_Q0}, n AS (SELECT count(*)::DOUBLE AS n FROM items)
SELECT truth AS label, round(sum(g) / any_value(n), 6) AS e, round(sum(g * g) / any_value(n * n), 8) AS q,
  round(sum(g) / any_value(n * n), 8) AS s FROM q0, n WHERE truth IN (SELECT quality FROM labels) GROUP BY truth""")
def proportion_expectation(spark, sf):
    from labelmesh.operators import joins
    from labelmesh.runtime import scalars

    items, asked = V.doc_items(spark, sf), doc_shares(spark, sf)
    p = votes.log_vote(doc_marks(spark, sf), items, 2)
    sums = scalars(joins.class_sums(p, 2), "c", 2)
    squares = scalars(p.agg(F.expr(arrays.array([f"sum({c} * {c})" for c in arrays.cells("p", 2)])).alias("c")), "c", 2)
    found = ms.proportion_expectation(asked, sums, squares, items.count()).join(asked.select("meas_id", "label"), "meas_id")
    return found.select("label", F.round("e", 6).alias("e"), F.round("q", 8).alias("q"), F.round("s", 8).alias("s"))


@query("is_annotated_by_measurement", """SELECT vec_id AS item_id,
  vec_id IN (SELECT min(vec_id) FROM embeddings GROUP BY label) AS annotated FROM embeddings""")
def is_annotated_by_measurement(spark, sf):
    return ms.is_annotated_by_measurement(V.emb_items(spark, sf), emb_regions(spark, sf))


def _noise_sql(t: int, err: str) -> str:
    return f"""no{t} AS (SELECT annotator_id, any_value(m) / 2.0 + {P.b_gamma} AS alpha, {P.c_gamma} + 0.5 * sum(err) AS beta
  FROM ({err}) JOIN mc USING (annotator_id) GROUP BY annotator_id)"""


def _own_steps(steps: int, k: int) -> str:
    parts = ["mc AS (SELECT annotator_id, count(*) AS m FROM ann GROUP BY annotator_id)"]
    for t in range(1, steps + 1):
        q = f"q{t - 1}"
        parts.append(f"th{t} AS (SELECT truth, {S.digamma('pi')} - {S.digamma('tot')} AS lp FROM (SELECT *, sum(pi) OVER () AS tot "
                     f"FROM (SELECT truth, {P.b_theta} + sum(g) AS pi FROM {q} GROUP BY truth)))")
        parts.append(_noise_sql(t, f"SELECT a.annotator_id, 1 - 2 * q.g + q.g AS err FROM ann a JOIN {q} q "
                                   f"ON q.item_id = a.item_id AND q.truth = a.label"))
        parts.append(f"""me{t} AS (SELECT i.item_id, th.truth, any_value(th.lp) + coalesce(sum(n.alpha / (2 * n.beta)), 0) AS score
  FROM items i CROSS JOIN th{t} th LEFT JOIN ann a ON a.item_id = i.item_id AND a.label = th.truth
  LEFT JOIN no{t} n ON n.annotator_id = a.annotator_id GROUP BY i.item_id, th.truth)""")
        parts.append(Q.softmax(f"q{t}", f"me{t}", "score"))
    return ",\n".join(parts)


EMB_Q0 = f"""k AS {S.classes(10)},
sc0 AS (SELECT i.item_id, k.truth, coalesce(sum((a.label = k.truth)::INT), 0)::DOUBLE AS score FROM items i CROSS JOIN k
  LEFT JOIN ann a ON a.item_id = i.item_id GROUP BY i.item_id, k.truth), {Q.softmax('q0', 'sc0', 'score')}"""


@query("measurement_vb", f"""WITH {S.EMB}, {EMB_Q0}, {_own_steps(2, 10)}
SELECT item_id, truth, round(g, 6) AS p FROM q2""")
def measurement_vb(spark, sf):
    """Annotations only, two steps."""
    return long_p(MM.measurement_vb(emb_marks(spark, sf), V.emb_items(spark, sf), 10, None, P, 2).posterior)


@query("annotator_variance", f"""WITH {S.EMB}, {EMB_Q0}, {_own_steps(2, 10)}
SELECT annotator_id, round(beta / (alpha - 1), 6) AS variance FROM no2""")
def annotator_variance(spark, sf):
    model = MM.measurement_vb(emb_marks(spark, sf), V.emb_items(spark, sf), 10, None, P, 2)
    return rounded(model.annotator_variance(), "variance")


@query("elbo_measurement", f"""WITH {S.EMB}, {EMB_Q0}, {_own_steps(1, 10)},
th AS (SELECT q0.truth, {P.b_theta} + sum(g) AS nu FROM q0 GROUP BY q0.truth),
tl AS (SELECT truth, nu, {S.digamma('nu')} - {S.digamma('tot')} AS lp FROM (SELECT *, sum(nu) OVER () AS tot FROM th)),
c1 AS (SELECT truth, sum(g) AS s FROM q1 GROUP BY truth),
er AS (SELECT a.annotator_id, sum(1 - q.g) AS err FROM ann a JOIN q1 q ON q.item_id = a.item_id AND q.truth = a.label GROUP BY 1),
nz AS (SELECT no1.*, mc.m, er.err, {S.digamma('alpha')} AS psi FROM no1 JOIN mc USING (annotator_id) JOIN er USING (annotator_id))
SELECT round((SELECT sum(lgamma(nu)) - lgamma(sum(nu)) FROM th) - 10 * lgamma({P.b_theta}::DOUBLE) + lgamma({10 * P.b_theta}::DOUBLE)
 + (SELECT sum(lp * ({P.b_theta} + s - nu)) FROM tl JOIN c1 USING (truth))
 + (SELECT sum({P.b_gamma} * ln({P.c_gamma}) - lgamma({P.b_gamma}::DOUBLE) - m / 2.0 * ln(2 * pi())
     - ({P.b_gamma} + m / 2.0 + 1) * (ln(beta) - psi) - alpha / beta * ({P.c_gamma} + 0.5 * err)
     + lgamma(alpha) - psi * (alpha + 1) + ln(beta) + alpha) FROM nz)
 - (SELECT sum(g * ln(g)) FROM q1 WHERE g > 0), 3) AS bound""")
def elbo_measurement(spark, sf):
    model = MM.measurement_vb(emb_marks(spark, sf), V.emb_items(spark, sf), 10, None, P, 1)
    return rounded(spark.createDataFrame([(model.bound(),)], "bound double"), "bound", digits=3)


TH1 = f"""th1 AS (SELECT truth, {S.digamma('pi')} - {S.digamma('tot')} AS lp FROM (SELECT *, sum(pi) OVER () AS tot FROM (
  SELECT truth, {P.b_theta} + sum(g) AS pi FROM q0 GROUP BY truth)))"""

MIXED = f"""{S.features()}, {S.DOC_ITEMS}, {S.DOC_ANN}, {WORD_TARGETS}, {DOC_Q0}, {TH1},
n AS (SELECT count(*)::DOUBLE AS n FROM items),
sh AS (SELECT quality AS label, count(*) / (SELECT count(*) FROM labels)::DOUBLE AS tau FROM labels GROUP BY quality),
mc AS (SELECT annotator_id, count(*) AS m FROM ann GROUP BY annotator_id
  UNION ALL SELECT 5, count(*) FROM w UNION ALL SELECT 6, count(*) FROM sh),
cs AS (SELECT truth, sum(g) AS s, sum(g * g) AS ss FROM q0 GROUP BY truth),
wm AS (SELECT t.feature, any_value(t.tau) AS tau, sum(t.sigma * q.g) AS e, sum(t.sigma * q.g * t.sigma * q.g) AS q,
  sum(t.sigma * t.sigma * q.g) AS s FROM tg t JOIN q0 q ON q.item_id = t.item_id AND q.truth = t.label GROUP BY t.feature),
{_noise_sql(1, '''SELECT a.annotator_id, 1 - 2 * q.g + q.g AS err FROM ann a JOIN q0 q ON q.item_id = a.item_id AND q.truth = a.label
  UNION ALL SELECT 5, tau * tau - 2 * tau * e + e * e - q + s FROM wm
  UNION ALL SELECT 6, tau * tau - 2 * tau * s / n + s * s / (n * n) - ss / (n * n) + s / (n * n) FROM sh JOIN cs ON cs.truth = sh.label, n''')},
pw AS (SELECT annotator_id, alpha / (2 * beta) AS w FROM no1),
t1 AS (SELECT a.item_id, a.label AS truth, sum(pw.w) AS e FROM ann a JOIN pw ON pw.annotator_id = a.annotator_id GROUP BY a.item_id, a.label),
t3 AS (SELECT t.item_id, t.label AS truth, sum(pw.w * (2 * t.tau * t.sigma - t.sigma * t.sigma - 2 * t.sigma * (wm.e - t.sigma * q.g))) AS e
  FROM tg t JOIN wm ON wm.feature = t.feature JOIN q0 q ON q.item_id = t.item_id AND q.truth = t.label JOIN pw ON pw.annotator_id = 5
  GROUP BY t.item_id, t.label),
me AS (SELECT q.item_id, q.truth, q.g AS old, th.lp + coalesce(t1.e, 0) + coalesce(t3.e, 0)
    + coalesce(pw.w * (2 * sh.tau / n.n - 1 / (n.n * n.n) - 2 / n.n * (cs.s / n.n - q.g / n.n)), 0) AS fresh
  FROM q0 q JOIN th1 th ON th.truth = q.truth CROSS JOIN n JOIN cs ON cs.truth = q.truth JOIN pw ON pw.annotator_id = 6
  LEFT JOIN sh ON sh.label = q.truth
  LEFT JOIN t1 ON t1.item_id = q.item_id AND t1.truth = q.truth LEFT JOIN t3 ON t3.item_id = q.item_id AND t3.truth = q.truth),
{Q.softmax('q1', 'me', '0.5 * ln(old) + 0.5 * fresh')}"""


@query("measurement_vb_mixed", f"WITH {MIXED} SELECT item_id, truth, round(g, 6) AS p FROM q1")
def measurement_vb_mixed(spark, sf):
    """Annotations, labelled words and label proportions together; one damped step."""
    features = V.doc_features(spark, sf)
    model = MM.measurement_vb(doc_measurements(spark, sf, features), V.doc_items(spark, sf), 2, features, P, 1)
    return long_p(model.posterior)


REGIONAL = f"""{S.EMB}, {EMB_Q0}, {REGIONS}, {TH1},
mc AS (SELECT annotator_id, count(*) AS m FROM ann GROUP BY annotator_id UNION ALL SELECT 5, count(DISTINCT label) FROM embeddings
  UNION ALL SELECT 6, count(DISTINCT label) FROM embeddings),
rm AS (SELECT r.annotator_id, r.label, any_value(r.tau) AS tau, sum(r.sigma * q.g) AS e, sum(r.sigma * q.g * r.sigma * q.g) AS q,
  sum(r.sigma * r.sigma * q.g) AS s FROM reg r JOIN q0 q ON q.item_id = r.item_id AND q.truth = r.label GROUP BY r.annotator_id, r.label),
{_noise_sql(1, '''SELECT a.annotator_id, 1 - 2 * q.g + q.g AS err FROM ann a JOIN q0 q ON q.item_id = a.item_id AND q.truth = a.label
  UNION ALL SELECT annotator_id, tau * tau - 2 * tau * e + e * e - q + s FROM rm''')},
pw AS (SELECT annotator_id, alpha / (2 * beta) AS w FROM no1),
tt AS (SELECT a.item_id, a.label AS truth, pw.w AS e FROM ann a JOIN pw ON pw.annotator_id = a.annotator_id UNION ALL
  SELECT r.item_id, r.label, pw.w * (2 * r.tau * r.sigma - r.sigma * r.sigma - 2 * r.sigma * (rm.e - r.sigma * q.g))
  FROM reg r JOIN rm ON rm.annotator_id = r.annotator_id AND rm.label = r.label
  JOIN q0 q ON q.item_id = r.item_id AND q.truth = r.label JOIN pw ON pw.annotator_id = r.annotator_id),
me AS (SELECT q.item_id, q.truth, any_value(q.g) AS old, any_value(th.lp) + coalesce(sum(tt.e), 0) AS fresh
  FROM q0 q JOIN th1 th ON th.truth = q.truth LEFT JOIN tt ON tt.item_id = q.item_id AND tt.truth = q.truth GROUP BY q.item_id, q.truth),
{Q.softmax('q1', 'me', '0.5 * ln(old) + 0.5 * fresh')}"""


@query("measurement_vb_locations", f"WITH {REGIONAL} SELECT item_id, truth, round(g, 6) AS p FROM q1")
def measurement_vb_locations(spark, sf):
    """Annotations and labelled locations together; one damped step."""
    marks = emb_marks(spark, sf).unionByName(emb_regions(spark, sf))
    return long_p(MM.measurement_vb(marks, V.emb_items(spark, sf), 10, None, P, 1).posterior)
