"""Registered queries: models with a classifier, and topic models."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelmesh.models import classifier, loglinear, scoring, topics, variational as M
from labelmesh.operators import joins, prep
from labelmesh.plans import modelsql as Q, sqltext as S, views as V
from labelmesh.plans.registry import query
from labelmesh.plans.voting import long_p
from labelmesh.priors import Priors
from labelmesh.runtime import cut, shared_path
from labelmesh.sources.models import load_model, save_model

P = Priors()
SEED, TOPICS = 3, 6


def _tokens(spark, sf):
    """Every token of every document."""
    return prep.tokenize(V.documents(spark, sf))


def _dealt(spark, sf):
    """Tasks that these tokens are dealt to by document."""
    return prep.item_parts(V.documents(spark, sf))


Z = f"""{S.TOKENS}, z AS (SELECT t.item_id, t.pos, t.word, {S.hash_int(str(SEED), 't.item_id', 't.pos')} % {TOPICS} AS z FROM tok t)"""


@query("topic_proportions", f"""WITH {Z}, docs AS (SELECT doc_id AS item_id FROM documents),
t AS (SELECT unnest(range({TOPICS})) AS topic), n AS (SELECT item_id, count(*) AS n FROM z GROUP BY 1)
SELECT d.item_id, t.topic::INT AS topic, round(coalesce(c.c, 0) / greatest(coalesce(n.n, 0), 1)::DOUBLE, 6) AS share
FROM docs d CROSS JOIN t LEFT JOIN n ON n.item_id = d.item_id
LEFT JOIN (SELECT item_id, z, count(*) AS c FROM z GROUP BY 1, 2) c ON c.item_id = d.item_id AND c.z = t.topic
UNION ALL SELECT item_id, {TOPICS}, 1.0 FROM docs""")
def topic_proportions(spark, sf):
    z = topics.start_topics(_tokens(spark, sf), TOPICS, SEED)
    shares = topics.topic_proportions(z, V.documents(spark, sf), TOPICS)
    return shares.select("item_id", F.posexplode("zbar").alias("topic", "share")).withColumn("share", F.round("share", 6))


@query("top_words", f"""WITH {Z}
SELECT z::INT AS z, word, n::BIGINT AS n, rank::INT AS rank FROM (
  SELECT z, word, count(*) AS n, row_number() OVER (PARTITION BY z ORDER BY count(*) DESC, word) AS rank FROM z GROUP BY z, word)
WHERE rank <= 10""")
def top_words(spark, sf):
    return topics.top_words(topics.start_topics(_tokens(spark, sf), TOPICS, SEED), 10)


@query("log_resp_vb")
def log_resp_vb(spark, sf):
    """Classes of the vectors from five raters and the vectors themselves."""
    items = V.emb_items(spark, sf)
    design = classifier.dense_design(items, "location", 10)
    return M.argmax_labels(loglinear.log_resp_vb(V.emb_annotations(spark, sf), items, design, 10, P).posterior)


@query("log_resp_em")
def log_resp_em(spark, sf):
    """Document quality from the reviewed labels; the classifier labels the documents without one."""
    items = V.doc_items(spark, sf)
    design = classifier.sparse_design(V.doc_features(spark, sf), items, 2)
    return long_p(loglinear.log_resp_em(V.label_annotations(spark, sf), items, design, 2, P).posterior)


@query("discriminative_em")
def discriminative_em(spark, sf):
    fit = loglinear.discriminative_em(V.doc_annotations(spark, sf), V.doc_features(spark, sf), V.doc_items(spark, sf), 2, P)
    return M.argmax_labels(fit.posterior)


# -- what a fitted classifier says about other items ------------------------------------------------

GIVEN_BIAS = [0.25, -0.5]


@query("score_new_items_classifier", f"""WITH {S.features()}, {S.DOC_ITEMS}, {S.DOC_ANN}, {Q.variational(2, 1, False, P)},
js AS (SELECT DISTINCT annotator_id FROM ann),
nu AS (SELECT j.annotator_id, k.truth, l.truth AS label, {S.prior_cell(*P.with_(c_gamma=1.0).annotator_cell(2), 'k.truth', 'l.truth')} + coalesce(s.c, 0) AS v
  FROM js j CROSS JOIN k CROSS JOIN k l LEFT JOIN (SELECT a.annotator_id, a.label, g.truth, sum(a.n * g.g) AS c FROM ann a
    JOIN g1 g ON g.item_id = a.item_id GROUP BY a.annotator_id, a.label, g.truth) s ON s.annotator_id = j.annotator_id AND s.truth = k.truth AND s.label = l.truth),
lw AS (SELECT annotator_id, truth, label, ln(v / sum(v) OVER (PARTITION BY annotator_id, truth)) AS w FROM nu),
cnt AS (SELECT f.feature, l.quality AS truth, sum(f.value) AS c FROM feat f JOIN labels l ON l.doc_id = f.item_id GROUP BY ALL),
known AS (SELECT DISTINCT feature FROM cnt),
cw AS (SELECT feature, truth, ln(v / sum(v) OVER (PARTITION BY truth)) AS w FROM (
  SELECT n.feature, k.truth, {P.b_phi} + coalesce(c.c, 0) AS v FROM known n CROSS JOIN k LEFT JOIN cnt c ON c.feature = n.feature AND c.truth = k.truth)),
fe AS (SELECT f.item_id, cw.truth, sum(f.value * cw.w) AS e FROM feat f JOIN cw ON cw.feature = f.feature GROUP BY ALL),
ae AS (SELECT a.item_id, lw.truth, sum(a.n * lw.w) AS e FROM ann a JOIN lw ON lw.annotator_id = a.annotator_id AND lw.label = a.label GROUP BY ALL),
sc AS (SELECT i.item_id, k.truth, CASE k.truth WHEN 0 THEN {GIVEN_BIAS[0]!r} ELSE {GIVEN_BIAS[1]!r} END + coalesce(fe.e, 0) + coalesce(ae.e, 0) AS score
  FROM items i CROSS JOIN k LEFT JOIN fe ON fe.item_id = i.item_id AND fe.truth = k.truth LEFT JOIN ae ON ae.item_id = i.item_id AND ae.truth = k.truth),
{Q.softmax('res', 'sc', 'score')}
SELECT item_id, truth, round(g, 5) AS p FROM res""")
def score_new_items_classifier(spark, sf):
    """All documents scored by a saved classifier whose coefficients know the words of reviewed documents only."""
    features, ann = V.doc_features(spark, sf), V.doc_annotations(spark, sf)
    hard = joins.one_hot(V.label_annotations(spark, sf), 2)
    vocab = cut(joins.soft_vocab_counts(features, hard, 2), "vocab")
    raters = scoring.point_model(M.item_resp_vb(ann, V.doc_items(spark, sf), 2, P, 1))
    model = scoring.ClassifierModel(2, GIVEN_BIAS, scoring.log_words(vocab, 2, vocab.count(), P), raters.labels, raters.unknown, raters.spread)
    saved = shared_path(spark, "classifier")
    save_model(spark, model, saved)
    return long_p(scoring.score_items_classifier(features, load_model(spark, saved), V.doc_items(spark, sf), ann), 5)


@query("classifier_gradient", f"""WITH {S.features()},
g AS (SELECT f.feature, k.truth, sum(f.value * (0.5 - (l.quality = k.truth)::INT)) AS g FROM feat f JOIN labels l ON l.doc_id = f.item_id
  CROSS JOIN {S.classes(2)} k GROUP BY ALL)
SELECT (SELECT count(DISTINCT feature) FROM feat)::BIGINT AS features, round(sqrt(sum(g * g)), 3) AS at_zero, 0.0::DOUBLE AS left_over FROM g""")
def classifier_gradient(spark, sf):
    """Norm of the classifier's gradient at zero coefficients, and what share of it is left at the fitted ones."""
    features, items = cut(V.doc_features(spark, sf), "features"), V.doc_items(spark, sf)
    hard = cut(joins.one_hot(V.label_annotations(spark, sf), 2), "labels")
    design = classifier.sparse_design(features, items, 2)
    found = classifier.fit(design, hard, P)
    weights = classifier.coefficient_table(design, found, spark)
    flat = hard.select("item_id", F.expr("array(ln(0.5D), ln(0.5D))").alias("lp"))
    norm = lambda g: g.agg(F.sqrt(F.sum(F.expr("g[0] * g[0] + g[1] * g[1]")))).first()[0]
    start = norm(classifier.gradient(features, hard, flat, None, P, 2))
    end = norm(classifier.gradient(features, hard, found.scores, weights, P, 2))
    row = spark.createDataFrame([(design.size, start, end / start)], "features long, at_zero double, left_over double")
    return row.select("features", F.round("at_zero", 3).alias("at_zero"), F.round("left_over", 2).alias("left_over"))


# -- one move of a topic model under given coefficients -----------------------------------------------

#: coefficients of two classes over the topic shares, their intercepts last, and the topic strength of documents
ETA = [[0.75, -0.5, 0.25, 0.125, -0.25, 0.5, 0.25], [-0.5, 0.5, 0.125, -0.75, 0.375, 0.25, -0.125]]
ALPHA = 0.5


def _given(spark, sf, annotations, labelled=True):
    model = topics.TopicLabelModel.start(_tokens(spark, sf), annotations, V.doc_items(spark, sf), 2, TOPICS, P, ALPHA, SEED, labelled, dealt=_dealt(spark, sf))
    model.eta = classifier.Classifier(None, [row[:-1] for row in ETA], [row[-1] for row in ETA])
    return model


_W = ", ".join(f"({c}, {t}, {w!r}::DOUBLE)" for c, row in enumerate(ETA) for t, w in enumerate(row))
#: counts at the start, and the unnormalised weight x of each token's topics
MOVE = f"""{Z}, topic AS (SELECT unnest(range({TOPICS}))::INT AS topic), vn AS (SELECT count(DISTINCT word) AS v FROM z),
dn AS (SELECT item_id, z, count(*) AS c FROM z GROUP BY ALL), ds AS (SELECT item_id, count(*) AS n FROM z GROUP BY 1),
wn AS (SELECT word, z, count(*) AS c FROM z GROUP BY ALL), tn AS (SELECT z, count(*) AS c FROM z GROUP BY 1),
wt AS (SELECT t.item_id, t.pos, g.topic, (coalesce(dn.c, 0) - (t.z = g.topic)::INT + {ALPHA}::DOUBLE)
    * (coalesce(wn.c, 0) - (t.z = g.topic)::INT + {P.b_phi}::DOUBLE) / (coalesce(tn.c, 0) + vn.v * {P.b_phi}::DOUBLE - (t.z = g.topic)::INT) AS x
  FROM z t CROSS JOIN topic g CROSS JOIN vn LEFT JOIN dn ON dn.item_id = t.item_id AND dn.z = g.topic
  LEFT JOIN wn ON wn.word = t.word AND wn.z = g.topic LEFT JOIN tn ON tn.z = g.topic)"""
#: log probability of each class, and the weight f that a document's label gives to each topic
ETA_SQL = f"""eta AS (SELECT * FROM (VALUES {_W}) w(truth, topic, w)), alldocs AS (SELECT doc_id AS item_id FROM documents),
raw AS (SELECT d.item_id, e.truth, sum(e.w * CASE WHEN e.topic = {TOPICS} THEN 1 ELSE coalesce(dn.c, 0) / greatest(coalesce(ds.n, 0), 1)::DOUBLE END) AS r
  FROM alldocs d CROSS JOIN eta e LEFT JOIN dn ON dn.item_id = d.item_id AND dn.z = e.topic LEFT JOIN ds ON ds.item_id = d.item_id GROUP BY ALL),
lp AS (SELECT *, r - max(r) OVER (PARTITION BY item_id) - ln(sum(exp(r - (SELECT max(q.r) FROM raw q WHERE q.item_id = raw.item_id))) OVER (PARTITION BY item_id)) AS lp FROM raw),
sm AS (SELECT raw.item_id, e.topic, ln(sum(exp(raw.r + e.w / ds.n))) AS s FROM raw JOIN ds ON ds.item_id = raw.item_id
  JOIN eta e ON e.truth = raw.truth AND e.topic < {TOPICS} GROUP BY ALL),
fm AS (SELECT m.item_id, e.topic, e.w / ds.n - sm.s AS meta FROM maj m JOIN ds ON ds.item_id = m.item_id
  JOIN eta e ON e.truth = m.label AND e.topic < {TOPICS} JOIN sm ON sm.item_id = m.item_id AND sm.topic = e.topic),
ff AS (SELECT item_id, topic, exp(meta - max(meta) OVER (PARTITION BY item_id)) AS f FROM fm)"""


@query("topic_sweep_sample", f"""WITH {MOVE}, run AS (
  SELECT *, sum(x) OVER (PARTITION BY item_id, pos ORDER BY topic) AS upto, sum(x) OVER (PARTITION BY item_id, pos) AS whole FROM wt)
SELECT item_id, pos::INT AS pos, least(count(*) FILTER (upto <= {S.uniform(f'{SEED}-z0', 'item_id', 'pos')} * whole), {TOPICS - 1})::INT AS z
FROM run GROUP BY item_id, pos""")
def topic_sweep_sample(spark, sf):
    """Every token's topic drawn once, blind to labels."""
    model = _given(spark, sf, V.label_annotations(spark, sf), labelled=False)
    model.move_topics()
    return model.tokens.select("item_id", F.col("pos").cast("int").alias("pos"), "z")


@query("topic_sweep_annealed", f"""WITH {MOVE}, run AS (
  SELECT *, sum(pow(x, 0.5)) OVER (PARTITION BY item_id, pos ORDER BY topic) AS upto, sum(pow(x, 0.5)) OVER (PARTITION BY item_id, pos) AS whole FROM wt)
SELECT item_id, pos::INT AS pos, least(count(*) FILTER (upto <= {S.uniform(f'{SEED}-z0', 'item_id', 'pos')} * whole), {TOPICS - 1})::INT AS z
FROM run GROUP BY item_id, pos""")
def topic_sweep_annealed(spark, sf):
    model = _given(spark, sf, V.label_annotations(spark, sf), labelled=False)
    model.move_topics(temperature=2.0)
    return model.tokens.select("item_id", F.col("pos").cast("int").alias("pos"), "z")


@query("topic_sweep_maximize", f"""WITH {S.LABEL_ANN}, {S.MAJORITY}, {MOVE}, {ETA_SQL},
sc AS (SELECT wt.item_id, wt.pos, wt.topic, round(ln(wt.x * coalesce(ff.f, 1)), 9) AS s FROM wt
  LEFT JOIN ff ON ff.item_id = wt.item_id AND ff.topic = wt.topic)
SELECT item_id, pos::INT AS pos, arg_min(topic, (-s, topic))::INT AS z FROM sc GROUP BY item_id, pos""")
def topic_sweep_maximize(spark, sf):
    """Every token's best topic, given the labels of reviewed documents."""
    model = _given(spark, sf, V.label_annotations(spark, sf))
    model.move_topics(sample=False)
    return model.tokens.select("item_id", F.col("pos").cast("int").alias("pos"), "z")


TOPIC_LABELS = f"{S.DOC_ANN}, {S.MAJORITY}, st AS (SELECT item_id, label AS y FROM maj), {Q.sweep_counts(2, P)}, {Q.y_conditional()}, {MOVE}, {ETA_SQL}"


@query("topic_labels_maximize", f"""WITH {TOPIC_LABELS},
sc AS (SELECT ys.item_id, ys.truth, ys.s - ln(cc.c - (st.y = cc.truth)::INT) + lp.lp AS s FROM ys JOIN st ON st.item_id = ys.item_id
  JOIN cc ON cc.truth = ys.truth JOIN lp ON lp.item_id = ys.item_id AND lp.truth = ys.truth)
SELECT item_id, arg_min(truth, (-round(s, 7), truth))::INT AS y FROM sc GROUP BY item_id""")
def topic_labels_maximize(spark, sf):
    """Every rated document's best label from its topics and its raters."""
    model = _given(spark, sf, V.doc_annotations(spark, sf))
    model.move_labels(sample=False)
    return model.labels.state.select("item_id", "y")


_BETA = f"lgamma({P.annotator_cell(2)[0]!r}::DOUBLE) + lgamma({P.annotator_cell(2)[1]!r}::DOUBLE) - lgamma({sum(P.annotator_cell(2))!r}::DOUBLE)"


@query("topic_objective", f"""WITH {TOPIC_LABELS},
dg AS (SELECT item_id, sum(lgamma(c + {ALPHA})) + ({TOPICS} - count(*)) * lgamma({ALPHA}::DOUBLE) AS g FROM dn GROUP BY item_id),
wg AS (SELECT sum(lgamma(c + {P.b_phi})) + ({TOPICS} * (SELECT v FROM vn) - count(*)) * lgamma({P.b_phi}::DOUBLE) AS g FROM wn),
full_nv AS (SELECT js.annotator_id, t.truth, l.truth AS label, {S.prior_cell(*P.annotator_cell(2), 't.truth', 'l.truth')} + coalesce(nn.c, 0) AS v
  FROM js CROSS JOIN k t CROSS JOIN k l LEFT JOIN nn ON nn.annotator_id = js.annotator_id AND nn.truth = t.truth AND nn.label = l.truth),
cb AS (SELECT sum(lgamma(v)) - lgamma(sum(v)) AS b FROM full_nv GROUP BY annotator_id, truth)
SELECT round((SELECT sum(dg.g - lgamma(ds.n + {TOPICS * ALPHA})) FROM dg JOIN ds ON ds.item_id = dg.item_id)
  - (SELECT count(*) FROM ds) * ({TOPICS} * lgamma({ALPHA}::DOUBLE) - lgamma({TOPICS * ALPHA}::DOUBLE))
  + (SELECT g FROM wg) - (SELECT sum(lgamma(c + vn.v * {P.b_phi}::DOUBLE)) FROM tn CROSS JOIN vn)
  - {TOPICS} * (SELECT v * lgamma({P.b_phi}::DOUBLE) - lgamma(v * {P.b_phi}::DOUBLE) FROM vn)
  + (SELECT sum(lp.lp) FROM lp JOIN st ON st.item_id = lp.item_id AND st.y = lp.truth)
  + (SELECT sum(b) FROM cb) - 2 * (SELECT count(*) FROM js) * ({_BETA})
  - (SELECT sum(w * w) FROM eta WHERE topic < {TOPICS}) / {2 * P.eta_variance!r}, 0) AS log_joint""")
def topic_objective(spark, sf):
    """Objective of the joint model before its first move."""
    value = _given(spark, sf, V.doc_annotations(spark, sf)).log_joint()
    return spark.createDataFrame([(float(value),)], "log_joint double").select(F.round("log_joint", 0).alias("log_joint"))


@query("tune_topics", f"""WITH RECURSIVE {Z}, dn AS (SELECT item_id, z, count(*) AS c FROM z GROUP BY ALL),
wn AS (SELECT word, z, count(*) AS c FROM z GROUP BY ALL), vn AS (SELECT count(DISTINCT word)::DOUBLE AS f FROM z),
dc AS (SELECT c AS v, count(*) AS n FROM dn GROUP BY 1), dt AS (SELECT v, count(*) AS n FROM (SELECT sum(c) AS v FROM dn GROUP BY item_id) GROUP BY 1),
wc AS (SELECT c AS v, count(*) AS n FROM wn GROUP BY 1), wz AS (SELECT v, count(*) AS n FROM (SELECT sum(c) AS v FROM wn GROUP BY z) GROUP BY 1),
{Q.fixed_point('alpha', 'dc', 'dt', f'{TOPICS}::DOUBLE', ALPHA)}, {Q.fixed_point('phi', 'wc', 'wz', '(SELECT f FROM vn)', P.b_phi)}
SELECT round((SELECT arg_max(a, i) FROM alpha), 3) AS alpha, round((SELECT arg_max(a, i) FROM phi), 3) AS b_phi""")
def tune_topics(spark, sf):
    """Prior strengths of topics in documents and of words in topics, fitted to the topics that tokens start with."""
    model = _given(spark, sf, V.label_annotations(spark, sf), labelled=False)
    model.tune("theta", "phi")
    return spark.createDataFrame([(model.alpha, model.priors.b_phi)], "alpha double, b_phi double").select(
        F.round("alpha", 3).alias("alpha"), F.round("b_phi", 3).alias("b_phi"))


@query("topic_schedule")
def topic_schedule(spark, sf):
    """Annealed topics, then labels, then everything; the objective and the changes as it ran."""
    model = topics.TopicLabelModel.start(_tokens(spark, sf), V.label_annotations(spark, sf), V.doc_items(spark, sf), 2, TOPICS, P, ALPHA, SEED,
                                         dealt=_dealt(spark, sf))
    trace = topics.train(model, [
        topics.Step("sample", "z", 2, 2.0), topics.Step("sample", "y", 1), topics.Step("maximize", "b", 1), topics.Step("maximize", "all", 1)])
    rows = [(i, t["step"], t["variable"], t["iteration"], t.get("log_joint"), t.get("changes")) for i, t in enumerate(trace)]
    return spark.createDataFrame(rows, "nth int, step string, variable string, iteration int, log_joint double, changes long")


@query("topic_label_model")
def topic_label_model(spark, sf):
    model = topics.topic_label_model(_tokens(spark, sf), V.label_annotations(spark, sf), V.doc_items(spark, sf), 2, TOPICS, P, seed=SEED,
                                     dealt=_dealt(spark, sf))
    return model.predictions()


@query("topic_then_label")
def topic_then_label(spark, sf):
    return topics.topic_then_label(_tokens(spark, sf), V.doc_annotations(spark, sf), V.doc_items(spark, sf), 2, TOPICS, P, seed=SEED,
                                   dealt=_dealt(spark, sf))
