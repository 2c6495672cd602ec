"""Registered queries: iterative models, bounds, scoring, tuning and label alignment."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from labelmesh.models import bounds, scoring, sweeps, tuning, variational as M
from labelmesh.operators import align, counts, joins, prep, votes
from labelmesh.plans import modelsql as Q, sqltext as S, views as V
from labelmesh.plans.counting import CONFUSION, rounded
from labelmesh.plans.registry import query
from labelmesh.plans.voting import long_p
from labelmesh.priors import Priors

P = Priors()
U = P.with_(c_gamma=1.0)
SEED = 5
DOCS = f"{S.features()}, {S.DOC_ITEMS}, {S.DOC_ANN}"


def _line_fit(spark, sf, steps):
    return M.item_resp_vb(V.line_annotations(spark, sf), V.line_items(spark, sf), 3, P, steps)


def _mom_fit(spark, sf, steps, features=None):
    features = V.doc_features(spark, sf) if features is None else features
    return M.mom_resp_vb(V.doc_annotations(spark, sf), features, V.doc_items(spark, sf), 2, P, steps)


def _multi_fit(spark, sf, steps, features=None):
    items = V.doc_items(spark, sf)
    features = V.doc_features(spark, sf) if features is None else features
    return M.multi_resp_vb(V.doc_annotations(spark, sf), features, items, 2,
                           M.random_simplex(items, 2, SEED), P, steps)


@query("item_resp_vb", f"""WITH {S.LINE}, {Q.variational(3, 2, False, P)}
SELECT item_id, truth, round(g, 6) AS p FROM g2""")
def item_resp_vb(spark, sf):
    return long_p(_line_fit(spark, sf, 2).posterior)


@query("item_resp_vb_labels", f"""WITH {S.EMB}, {Q.variational(10, 2, False, P)}
SELECT item_id, truth AS label FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(g, 9) DESC, truth) AS r FROM g2) WHERE r = 1""")
def item_resp_vb_labels(spark, sf):
    """Inferred class of every vector from its five raters."""
    fit = M.item_resp_vb(V.emb_annotations(spark, sf), V.emb_items(spark, sf), 10, P, 2)
    return M.argmax_labels(fit.posterior)


def _nu(t: int, k: int) -> str:
    """Full confusion grid nu and class prior from posterior g<t>."""
    d, o = U.annotator_cell(k)
    return f"""js AS (SELECT DISTINCT annotator_id FROM ann),
softf AS (SELECT a.annotator_id, a.label, g.truth, sum(a.n * g.g) AS c
  FROM ann a JOIN g{t} g ON g.item_id = a.item_id GROUP BY a.annotator_id, a.label, g.truth),
nu AS (SELECT js.annotator_id, k.truth, l.truth AS label, {S.prior_cell(d, o, 'k.truth', 'l.truth')} + coalesce(s.c, 0) AS v
  FROM js CROSS JOIN k CROSS JOIN k l LEFT JOIN softf s
  ON s.annotator_id = js.annotator_id AND s.truth = k.truth AND s.label = l.truth),
pif AS (SELECT truth, {U.b_theta} + sum(g) AS pi FROM g{t} GROUP BY truth)"""


@query("item_resp_vb_accuracy", f"""WITH {S.LINE}, {Q.variational(3, 2, False, P)}, {_nu(2, 3)}
SELECT n.annotator_id, round(sum(n.v / n.t * p.pi / p.tot), 6) AS accuracy
FROM (SELECT *, sum(v) OVER (PARTITION BY annotator_id, truth) AS t FROM nu) n
JOIN (SELECT *, sum(pi) OVER () AS tot FROM pif) p ON p.truth = n.truth WHERE n.truth = n.label GROUP BY n.annotator_id""")
def item_resp_vb_accuracy(spark, sf):
    return rounded(_line_fit(spark, sf, 2).annotator_accuracy(), "accuracy")


@query("mom_resp_vb", f"""WITH {DOCS}, {Q.variational(2, 2, True, P)}
SELECT item_id, truth, round(g, 5) AS p FROM g2""")
def mom_resp_vb(spark, sf):
    return long_p(_mom_fit(spark, sf, 2).posterior, 5)


MULTI = ",\n".join([
    DOCS, Q.start(2), Q.simplex(2, SEED), Q.pair_step(1, "g0", "h0", "g0", "h0", 2, U),
    Q.pair_step(2, "g1", "h1", "g0", "h0", 2, U),
])


@query("multi_resp_vb", f"""WITH {MULTI}
SELECT g.item_id, g.truth, round(g.g, 5) AS p, round(h.g, 5) AS h
FROM g2 g JOIN h2 h ON h.item_id = g.item_id AND h.truth = g.truth""")
def multi_resp_vb(spark, sf):
    fit = _multi_fit(spark, sf, 2)
    h = long_p(fit.machine, 5, "h").withColumnRenamed("p", "h")
    return long_p(fit.posterior, 5).join(h, ["item_id", "truth"])


@query("multi_resp_vb_machine", f"""WITH {MULTI},
tauf AS (SELECT a.truth, b.truth AS m, {S.prior_cell(*U.machine_cell(2), 'a.truth', 'b.truth')} + sum(a.g * b.g) AS v
  FROM g2 a JOIN h2 b ON b.item_id = a.item_id GROUP BY a.truth, b.truth),
pif AS (SELECT truth, {P.b_theta} + sum(g) AS pi FROM g2 GROUP BY truth)
SELECT round(sum(t.v / t.tot * p.pi / p.tot), 5) AS accuracy
FROM (SELECT *, sum(v) OVER (PARTITION BY truth) AS tot FROM tauf) t
JOIN (SELECT *, sum(pi) OVER () AS tot FROM pif) p ON p.truth = t.truth WHERE t.m = t.truth""")
def multi_resp_vb_machine(spark, sf):
    return rounded(_multi_fit(spark, sf, 2).machine_accuracy(), "accuracy", digits=5)


def _one_row(spark, **values):
    return spark.createDataFrame([tuple(float(v) for v in values.values())], ", ".join(f"{k} double" for k in values))


def _beta_sql(k: int) -> str:
    d, o = U.annotator_cell(k)
    off = f" + {k - 1} * lgamma({o!r}::DOUBLE)"
    return f"""(SELECT sum(lg) - sum(lgt) FROM (SELECT sum(lgamma(v)) AS lg, lgamma(sum(v)) AS lgt FROM nu GROUP BY annotator_id, truth))
 - {k} * (SELECT count(*) FROM js) * (lgamma({d!r}::DOUBLE){off} - lgamma({d + (k - 1) * o!r}::DOUBLE))
 + (SELECT sum(lgamma(pi)) - lgamma(sum(pi)) FROM pif) - {k} * lgamma({U.b_theta}::DOUBLE) + lgamma({k * U.b_theta}::DOUBLE)
 + (SELECT sum(lgamma(t + 1)) FROM (SELECT sum(n) AS t FROM ann GROUP BY item_id, annotator_id)) - (SELECT sum(lgamma(n + 1)) FROM ann)"""


@query("elbo_item_resp", f"""WITH {S.LINE}, {Q.variational(3, 2, False, P)}, {_nu(2, 3)}
SELECT round({_beta_sql(3)} - (SELECT sum(g * ln(g)) FROM g2 WHERE g > 0), 2) AS bound""")
def elbo_item_resp(spark, sf):
    fit = _line_fit(spark, sf, 2)
    return rounded(_one_row(spark, bound=bounds.elbo(fit, V.line_annotations(spark, sf))), "bound", digits=2)


@query("elbo_mom_resp", f"""WITH {DOCS}, {Q.variational(2, 1, True, P)}, {_nu(1, 2)},
vf AS (SELECT f.feature, g.truth, sum(f.value * g.g) + {P.b_phi} AS v FROM feat f JOIN g1 g ON g.item_id = f.item_id
  GROUP BY f.feature, g.truth),
nf AS (SELECT count(DISTINCT feature) AS f FROM feat)
SELECT round({_beta_sql(2)} - (SELECT sum(g * ln(g)) FROM g1 WHERE g > 0)
 + (SELECT sum(lg) - sum(lgt) FROM (SELECT sum(lgamma(v)) AS lg, lgamma(sum(v)) AS lgt FROM vf GROUP BY truth))
 - 2 * (SELECT f * lgamma({P.b_phi}::DOUBLE) - lgamma(f * {P.b_phi}::DOUBLE) FROM nf)
 + (SELECT sum(lgamma(t + 1)) FROM (SELECT sum(value) AS t FROM feat GROUP BY item_id)) - (SELECT sum(lgamma(value + 1)) FROM feat)
 , 1) AS bound""")
def elbo_mom_resp(spark, sf):
    features = V.doc_features(spark, sf)
    value = bounds.elbo(_mom_fit(spark, sf, 1, features), V.doc_annotations(spark, sf), features)
    return rounded(_one_row(spark, bound=value), "bound", digits=1)


@query("elbo_multi_resp", f"""WITH {MULTI}, {_nu(2, 2)},
vf AS (SELECT f.feature, h.truth, sum(f.value * h.g) + {P.b_phi} AS v FROM feat f JOIN h2 h ON h.item_id = f.item_id GROUP BY f.feature, h.truth),
nf AS (SELECT count(DISTINCT feature) AS f FROM feat),
tf AS (SELECT a.truth, b.truth AS m, {S.prior_cell(*U.machine_cell(2), 'a.truth', 'b.truth')} + sum(a.g * b.g) AS v
  FROM g2 a JOIN h2 b ON b.item_id = a.item_id GROUP BY a.truth, b.truth)
SELECT round({_beta_sql(2)} - (SELECT sum(g * ln(g)) FROM g2 WHERE g > 0) - (SELECT sum(g * ln(g)) FROM h2 WHERE g > 0)
 + {Q.beta_rows('vf', 'v', 'truth')} - 2 * (SELECT f * lgamma({P.b_phi}::DOUBLE) - lgamma(f * {P.b_phi}::DOUBLE) FROM nf)
 + (SELECT sum(lgamma(t + 1)) FROM (SELECT sum(value) AS t FROM feat GROUP BY item_id)) - (SELECT sum(lgamma(value + 1)) FROM feat)
 + {Q.beta_rows('tf', 'v', 'truth')} - 2 * ({' + '.join(f'lgamma({v!r}::DOUBLE)' for v in U.machine_cell(2))} - lgamma({sum(U.machine_cell(2))!r}::DOUBLE))
 , 0) AS bound""")
def elbo_multi_resp(spark, sf):
    features = V.doc_features(spark, sf)
    value = bounds.elbo(_multi_fit(spark, sf, 2, features), V.doc_annotations(spark, sf), features)
    return rounded(_one_row(spark, bound=value), "bound", digits=0)


# -- sweeps ---------------------------------------------------------------------------------------

LINE_STATE = f"{S.LINE}, {S.MAJORITY}, st AS (SELECT item_id, label AS y FROM maj), {Q.sweep_counts(3, P)}"
DOC_STATE = f"""{DOCS}, {S.MAJORITY},
st AS (SELECT item_id, label AS y, ({S.hash_int(str(SEED), 'item_id')} % 2)::INT AS m FROM maj), {Q.sweep_counts(2, P)}"""


def _pick(source: str, score: str, columns: str, order: str) -> str:
    return f"""SELECT item_id, {columns} FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY {score} DESC, {order}) AS r
  FROM {source}) WHERE r = 1"""


def _line_run(spark, sf):
    ann = V.line_annotations(spark, sf)
    return sweeps.Sweeper.start(sweeps.ITEM, ann, votes.majority_vote(ann).withColumnRenamed("label", "y"), 3, P, seed=SEED)


def _doc_run(spark, sf, kind):
    ann = V.doc_annotations(spark, sf)
    y = votes.majority_vote(ann).withColumnRenamed("label", "y")
    if kind == sweeps.MULTI:
        y = y.join(prep.uniform_assignment(V.doc_items(spark, sf), 2, SEED).withColumnRenamed("label", "m"), "item_id")
    return sweeps.Sweeper.start(kind, ann, y, 2, P, V.doc_features(spark, sf), seed=SEED)


@query("item_resp_sweep_maximize", f"""WITH {LINE_STATE}, {Q.y_conditional()}
{_pick('ys', 'round(s, 9)', 'truth AS y', 'truth')}""")
def item_resp_sweep_maximize(spark, sf):
    return _line_run(spark, sf).sweep(sample=False).state.select("item_id", "y")


@query("item_resp_sweep_sample", f"""WITH {LINE_STATE}, {Q.y_conditional()}
{_pick('ys', f"s + {Q.gumbel(f'{SEED}-0', 'item_id', 'truth')}", 'truth AS y', 'truth')}""")
def item_resp_sweep_sample(spark, sf):
    return _line_run(spark, sf).sweep(sample=True).state.select("item_id", "y")


@query("item_resp_conditional", f"""WITH {LINE_STATE}, {Q.y_conditional()}
SELECT item_id, truth, round(s, 5) AS p FROM ys""")
def item_resp_conditional(spark, sf):
    return long_p(_line_run(spark, sf).conditional().select("item_id", "s"), 5, "s")


@query("mom_resp_sweep_maximize", f"""WITH {DOC_STATE}, {Q.y_conditional()}, {Q.m_conditional('y', P)},
b AS (SELECT ys.item_id, ys.truth, ys.s + ms.s AS s FROM ys JOIN ms ON ms.item_id = ys.item_id AND ms.truth = ys.truth)
{_pick('b', 'round(s, 7)', 'truth AS y', 'truth')}""")
def mom_resp_sweep_maximize(spark, sf):
    return _doc_run(spark, sf, sweeps.MOM).sweep(sample=False).state.select("item_id", "y")


@query("mom_resp_sweep_sample", f"""WITH {DOC_STATE}, {Q.y_conditional()}, {Q.m_conditional('y', P)},
b AS (SELECT ys.item_id, ys.truth, ys.s + ms.s AS s FROM ys JOIN ms ON ms.item_id = ys.item_id AND ms.truth = ys.truth)
{_pick('b', f"s + {Q.gumbel(f'{SEED}-0', 'item_id', 'truth')}", 'truth AS y', 'truth')}""")
def mom_resp_sweep_sample(spark, sf):
    return _doc_run(spark, sf, sweeps.MOM).sweep(sample=True).state.select("item_id", "y")


BLOCK = f"{DOC_STATE}, {Q.y_conditional()}, {Q.m_conditional('m', P)}, {Q.ym_conditional(2, P)}"


@query("multi_resp_sweep_maximize", f"""WITH {BLOCK}
{_pick('block', 'round(s, 7)', 'y, m', 'y, m')}""")
def multi_resp_sweep_maximize(spark, sf):
    return _doc_run(spark, sf, sweeps.MULTI).sweep(sample=False).state.select("item_id", "y", "m")


@query("multi_resp_sweep_sample", f"""WITH {BLOCK}
{_pick('block', f"s + {Q.gumbel(f'{SEED}-0', 'item_id', 'y * 2 + m')}", 'y, m', 'y, m')}""")
def multi_resp_sweep_sample(spark, sf):
    return _doc_run(spark, sf, sweeps.MULTI).sweep(sample=True).state.select("item_id", "y", "m")


@query("multi_resp_sweep_y", f"""WITH {BLOCK},
top AS (SELECT *, max(s) OVER (PARTITION BY item_id) AS t FROM block),
my AS (SELECT item_id, y, any_value(t) + ln(sum(exp(s - t))) AS s FROM top GROUP BY item_id, y)
SELECT p.item_id, p.y, st.m FROM (
{_pick('my', f"s + {Q.gumbel(f'{SEED}-0', 'item_id', 'y')}", 'y', 'y')}) p JOIN st ON st.item_id = p.item_id""")
def multi_resp_sweep_y(spark, sf):
    """y drawn with m summed out; m keeps its value."""
    return _doc_run(spark, sf, sweeps.MULTI).sweep("y", sample=True).state.select("item_id", "y", "m")


@query("log_joint", f"""WITH {LINE_STATE}, {CONFUSION.replace('0.5 *', '1.0 *')}
SELECT round((SELECT sum(lgamma(c)) FROM cc) + (SELECT sum(lg) - sum(lgt) FROM (
  SELECT sum(lgamma(value)) AS lg, lgamma(sum(value)) AS lgt FROM conf GROUP BY annotator_id, truth)), 2) AS log_joint""")
def log_joint(spark, sf):
    return rounded(_one_row(spark, log_joint=_line_run(spark, sf).log_joint()), "log_joint", digits=2)


@query("log_joint_words", f"""WITH {DOC_STATE}, {Q.m_conditional('y', P)}, {Q.confusion_grid(2, P)}
SELECT round((SELECT sum(lgamma(c)) FROM cc) + {Q.beta_rows('full_nv', 'v', 'annotator_id', 'truth')} + {Q.beta_rows('fv', 'v', 'truth')}, 1) AS log_joint""")
def log_joint_words(spark, sf):
    return rounded(_one_row(spark, log_joint=_doc_run(spark, sf, sweeps.MOM).log_joint()), "log_joint", digits=1)


@query("log_joint_pair", f"""WITH {BLOCK}, {Q.confusion_grid(2, P)}
SELECT round((SELECT sum(lgamma(c)) FROM cc) + {Q.beta_rows('full_nv', 'v', 'annotator_id', 'truth')} + {Q.beta_rows('fv', 'v', 'truth')}
  + {Q.beta_rows('mu', 'v', 'truth')}, 1) AS log_joint""")
def log_joint_pair(spark, sf):
    return rounded(_one_row(spark, log_joint=_doc_run(spark, sf, sweeps.MULTI).log_joint()), "log_joint", digits=1)


@query("rescore_from_assignment", f"""WITH {LINE_STATE}, {CONFUSION.replace('0.5 *', '1.0 *')},
lw AS (SELECT annotator_id, truth, label, ln(value / sum(value) OVER (PARTITION BY annotator_id, truth)) AS w FROM conf),
th AS (SELECT truth, ln(c / sum(c) OVER ()) AS w FROM cc),
sc AS (SELECT x.item_id, lw.truth, sum(x.n * lw.w) + any_value(th.w) AS score FROM ann x
  JOIN lw ON lw.annotator_id = x.annotator_id AND lw.label = x.label JOIN th ON th.truth = lw.truth GROUP BY x.item_id, lw.truth),
{Q.softmax('res', 'sc', 'score')}
SELECT item_id, truth, round(g, 6) AS p FROM res""")
def rescore_from_assignment(spark, sf):
    """Point estimates of a hard assignment score the same items again, as at the end of a sampling run."""
    return long_p(scoring.score_items(V.line_annotations(spark, sf), _line_run(spark, sf).point_model()))


_STAGE = f"{Q.sweep_counts(2, P)}, {Q.y_conditional()}, {Q.m_conditional('m', P)}, {Q.ym_conditional(2, P)}"


def _stage(i: int) -> str:
    """The block conditional of state ``st<i>``, all its tables numbered."""
    return re.sub(r"\b(st|k|cc|nn|cells|js|nv|nt|ya|pairs|yt|ys|fv|ft|sz|ma|ms|mu|mr|block)\b", rf"\g<1>{i}", _STAGE)


def _summed(i: int, keep: str) -> str:
    """The block of state i with the other variable summed out."""
    return f"""sum{i} AS (SELECT item_id, {keep}, any_value(t) + ln(sum(exp(s - t))) AS s
  FROM (SELECT *, max(s) OVER (PARTITION BY item_id) AS t FROM block{i}) GROUP BY item_id, {keep})"""


@query("training_schedule", f"""WITH {DOCS}, {S.MAJORITY},
st0 AS (SELECT item_id, label AS y, ({S.hash_int(str(SEED), 'item_id')} % 2)::INT AS m FROM maj), {_stage(0)},
st1 AS ({_pick('block0', f"s / 2 + {Q.gumbel(f'{SEED}-0', 'item_id', 'y * 2 + m')}", 'y, m', 'y, m')}), {_stage(1)}, {_summed(1, 'y')},
st2 AS (SELECT p.item_id, p.y, st1.m FROM ({_pick('sum1', f"s + {Q.gumbel(f'{SEED}-1', 'item_id', 'y')}", 'y', 'y')}) p JOIN st1 ON st1.item_id = p.item_id),
{_stage(2)}, {_summed(2, 'm')},
st3 AS (SELECT p.item_id, st2.y, p.m FROM ({_pick('sum2', 'round(s, 7)', 'm', 'm')}) p JOIN st2 ON st2.item_id = p.item_id), {_stage(3)},
st4 AS ({_pick('block3', 'round(s, 7)', 'y, m', 'y, m')})
SELECT st1.item_id, least(st1.y, st2.y) AS y, st1.m, st4.y AS y_now, st4.m AS m_now
FROM st1 JOIN st2 ON st2.item_id = st1.item_id JOIN st4 ON st4.item_id = st1.item_id""")
def training_schedule(spark, sf):
    """Annealed sampling, then greedy sweeps; the marginal modes since the last change of temperature, and the last values."""
    run = _doc_run(spark, sf, sweeps.MULTI)
    sweeps.train(run, [
        sweeps.Step("sample", "all", 1, 2.0), sweeps.Step("sample", "y", 1), sweeps.Step("maximize", "m", 1),
        sweeps.Step("maximize", "all", 1),
    ])
    now = run.state.select("item_id", F.col("y").alias("y_now"), F.col("m").alias("m_now"))
    return run.marginal().join(now, "item_id")


# -- scoring, baseline, tuning, alignment -----------------------------------------------------------


@query("score_new_items", f"""WITH {S.LINE}, {Q.variational(3, 1, False, P)}, {_nu(1, 3)},
lw AS (SELECT annotator_id, truth, label, ln(v / sum(v) OVER (PARTITION BY annotator_id, truth)) AS w FROM nu),
th AS (SELECT truth, ln(pi / sum(pi) OVER ()) AS w FROM pif),
new AS (SELECT l_orderkey AS item_id, annotator_id, label, count(*) AS n FROM ev GROUP BY l_orderkey, annotator_id, label),
sc AS (SELECT n.item_id, lw.truth, sum(n.n * lw.w) + any_value(th.w) AS score
  FROM new n JOIN lw ON lw.annotator_id = n.annotator_id AND lw.label = n.label JOIN th ON th.truth = lw.truth
  GROUP BY n.item_id, lw.truth),
{Q.softmax('res', 'sc', 'score')}
SELECT item_id, truth, round(g, 6) AS p FROM res""")
def score_new_items(spark, sf):
    """Parameters learned on parts, applied to orders labelled by the same suppliers."""
    model = scoring.point_model(_line_fit(spark, sf, 1))
    new = prep.compile_annotations(
        V.line_events(spark, sf).select(F.col("l_orderkey").alias("item_id"), "annotator_id", "label")
    )
    return long_p(scoring.score_items(new, model))


@query("score_new_items_expected", f"""WITH {S.LINE}, {Q.variational(3, 1, False, P)}, {_nu(1, 3)},
lw AS (SELECT annotator_id, truth, label, {S.digamma('v')} - {S.digamma('t')} AS w FROM (
  SELECT *, sum(v) OVER (PARTITION BY annotator_id, truth) AS t FROM nu)),
th AS (SELECT truth, {S.digamma('pi')} - {S.digamma('t')} AS w FROM (SELECT *, sum(pi) OVER () AS t FROM pif)),
new AS (SELECT l_orderkey AS item_id, annotator_id, label, count(*) AS n FROM ev GROUP BY l_orderkey, annotator_id, label),
sc AS (SELECT n.item_id, lw.truth, sum(n.n * lw.w) + any_value(th.w) AS score
  FROM new n JOIN lw ON lw.annotator_id = n.annotator_id AND lw.label = n.label JOIN th ON th.truth = lw.truth
  GROUP BY n.item_id, lw.truth),
{Q.softmax('res', 'sc', 'score')}
SELECT item_id, truth, round(g, 6) AS p FROM res""")
def score_new_items_expected(spark, sf):
    """The same with expected log parameters, as the variational models score items outside the corpus."""
    new = prep.compile_annotations(
        V.line_events(spark, sf).select(F.col("l_orderkey").alias("item_id"), "annotator_id", "label")
    )
    return long_p(scoring.score_items_expected(new, _line_fit(spark, sf, 1)))


def _turn(i: str) -> str:
    """One alternation of an item's two posteriors under fixed parameters, for two classes."""
    g = [f"th{a} + ye{a} + h0 * mu{a}0 + h1 * mu{a}1" for a in range(2)]
    return f"""SELECT i, item_id, ye0, ye1, me0, me1, g, 1 / (1 + exp((me1 + (1 - g) * mu11 + g * mu01) - (me0 + g * mu00 + (1 - g) * mu10))) AS h0,
    1 / (1 + exp((me0 + g * mu00 + (1 - g) * mu10) - (me1 + (1 - g) * mu11 + g * mu01))) AS h1
  FROM (SELECT {i} AS i, item_id, ye0, ye1, me0, me1, 1 / (1 + exp(({g[1]}) - ({g[0]}))) AS g, mu00, mu01, mu10, mu11"""


@query("score_new_items_pair", f"""WITH RECURSIVE {DOCS}, {Q.start(2)}, {Q.simplex(2, SEED)}, {Q.pair_step(1, 'g0', 'h0', 'g0', 'h0', 2, U)},
{Q.m_step(2, 'g1', 2, U)}, {Q.word_step(2, 'h1', 2, U)}, {Q.evidence(2, True)},
tv AS (SELECT a.truth, b.truth AS m, {S.prior_cell(*U.machine_cell(2), 'a.truth', 'b.truth')} + sum(a.g * b.g) AS v
  FROM g1 a JOIN h1 b ON b.item_id = a.item_id GROUP BY a.truth, b.truth),
tw AS (SELECT truth, m, {S.digamma('v')} - {S.digamma('t')} AS w FROM (SELECT *, sum(v) OVER (PARTITION BY truth) AS t FROM tv)),
par AS (SELECT {', '.join(f'max(w) FILTER (truth = {a} AND m = {b}) AS mu{a}{b}' for a in range(2) for b in range(2))},
  (SELECT lp FROM pr2 WHERE truth = 0) AS th0, (SELECT lp FROM pr2 WHERE truth = 1) AS th1 FROM tw),
ev AS (SELECT i.item_id, {', '.join(f'coalesce(max({t}.e) FILTER ({t}.truth = {a}), 0) AS {n}{a}' for t, n in (('x', 'ye'), ('f', 'me')) for a in range(2))}
  FROM items i LEFT JOIN ae2 x ON x.item_id = i.item_id LEFT JOIN fe2 f ON f.item_id = i.item_id GROUP BY i.item_id),
turns AS (SELECT 0 AS i, item_id, ye0, ye1, me0, me1, 0::DOUBLE AS g, exp(1::DOUBLE) AS h0, exp(1::DOUBLE) AS h1 FROM ev UNION ALL
  {_turn('i + 1')} FROM turns CROSS JOIN par WHERE i < {scoring.ALTERNATIONS}))
SELECT item_id, truth, round(CASE truth WHEN 0 THEN g ELSE 1 - g END, 5) AS p FROM turns CROSS JOIN {S.classes(2)} c WHERE i = {scoring.ALTERNATIONS}""")
def score_new_items_pair(spark, sf):
    """Documents scored as new items under the two-class model."""
    features = V.doc_features(spark, sf)
    fit = _multi_fit(spark, sf, 1, features)
    return long_p(scoring.score_items_expected(V.doc_annotations(spark, sf), fit, V.doc_items(spark, sf), features), 5)


@query("score_new_items_words", f"""WITH {DOCS}, {Q.variational(2, 1, True, P)}, {_nu(1, 2)},
lw AS (SELECT annotator_id, truth, label, ln(v / sum(v) OVER (PARTITION BY annotator_id, truth)) AS w FROM nu),
th AS (SELECT truth, ln(pi / sum(pi) OVER ()) AS w FROM pif),
vf AS (SELECT f.feature, g.truth, sum(f.value * g.g) + {P.b_phi} AS v FROM feat f JOIN g1 g ON g.item_id = f.item_id
  GROUP BY f.feature, g.truth),
vl AS (SELECT feature, truth, ln(v / sum(v) OVER (PARTITION BY truth)) AS w FROM vf),
sa AS (SELECT a.item_id, lw.truth, sum(a.n * lw.w) AS e FROM ann a JOIN lw ON lw.annotator_id = a.annotator_id
  AND lw.label = a.label GROUP BY a.item_id, lw.truth),
sw AS (SELECT f.item_id, vl.truth, sum(f.value * vl.w) AS e FROM feat f JOIN vl ON vl.feature = f.feature
  GROUP BY f.item_id, vl.truth),
sc AS (SELECT i.item_id, th.truth, th.w + coalesce(sa.e, 0) + coalesce(sw.e, 0) AS score FROM items i CROSS JOIN th
  LEFT JOIN sa ON sa.item_id = i.item_id AND sa.truth = th.truth LEFT JOIN sw ON sw.item_id = i.item_id AND sw.truth = th.truth),
{Q.softmax('res', 'sc', 'score')}
SELECT item_id, truth, round(g, 5) AS p FROM res""")
def score_new_items_words(spark, sf):
    features = V.doc_features(spark, sf)
    model = scoring.point_model(_mom_fit(spark, sf, 1, features))
    return long_p(scoring.score_items(V.doc_annotations(spark, sf), model, V.doc_items(spark, sf), features), 5)


@query("naive_bayes_baseline", f"""WITH {S.features()}, {S.DOC_ITEMS}, {S.LABEL_ANN}, {S.MAJORITY}, k AS {S.classes(2)},
voc AS (SELECT DISTINCT feature FROM feat),
cnt AS (SELECT f.feature, m.label AS truth, sum(f.value) AS c FROM feat f JOIN maj m ON m.item_id = f.item_id
  GROUP BY f.feature, m.label),
wt AS (SELECT feature, truth, ln(v / sum(v) OVER (PARTITION BY truth)) AS w FROM (
  SELECT voc.feature, k.truth, 1 + coalesce(c.c, 0) AS v FROM voc CROSS JOIN k
  LEFT JOIN cnt c ON c.feature = voc.feature AND c.truth = k.truth)),
pr AS (SELECT k.truth, ln((1.0 + count(m.item_id)) / (SELECT count(*) + 2 FROM maj)) AS w FROM k
  LEFT JOIN maj m ON m.label = k.truth GROUP BY k.truth),
sc AS (SELECT i.item_id, pr.truth, any_value(pr.w) + coalesce(sum(f.value * wt.w), 0) AS s FROM items i CROSS JOIN pr
  LEFT JOIN feat f ON f.item_id = i.item_id LEFT JOIN wt ON wt.feature = f.feature AND wt.truth = pr.truth
  GROUP BY i.item_id, pr.truth)
SELECT p.item_id, coalesce(m.label, p.truth) AS label FROM (
{_pick('sc', 'round(s, 7)', 'truth', 'truth')}) p LEFT JOIN maj m ON m.item_id = p.item_id""")
def naive_bayes_baseline(spark, sf):
    """Reviewed labels train the classifier that labels the documents without one."""
    out = scoring.naive_bayes_baseline(
        V.label_annotations(spark, sf), V.doc_features(spark, sf), V.doc_items(spark, sf), 2
    )
    return out.select("item_id", "label")


def _tune_sql(k: int) -> str:
    d, o = P.annotator_cell(k)
    a = P.b_theta
    return f"""rows AS (SELECT item_id, truth, g FROM g0),
sym AS (SELECT (1 + {a} * up) / (2 + {k} * down) AS b_theta FROM
  (SELECT sum({S.digamma(f'(g + {a})')} - {S.digamma(f'{a}::DOUBLE')}) AS up FROM rows),
  (SELECT sum({S.digamma(f'(t + {k * a})')} - {S.digamma(f'{k * a}::DOUBLE')}) AS down FROM (SELECT sum(g) AS t FROM rows GROUP BY item_id))),
cf AS (SELECT s.annotator_id, s.truth, l.truth AS label, coalesce(x.c, 0) AS c FROM (SELECT DISTINCT annotator_id, truth FROM soft1) s
  CROSS JOIN k l LEFT JOIN soft1 x ON x.annotator_id = s.annotator_id AND x.truth = s.truth AND x.label = l.truth),
dn AS (SELECT sum({S.digamma(f'(t + {d + (k - 1) * o!r})')} - {S.digamma(f'{d + (k - 1) * o!r}::DOUBLE')}) AS down
  FROM (SELECT sum(c) AS t FROM cf GROUP BY annotator_id, truth)),
con AS (SELECT (1 + {d!r} * (SELECT sum({S.digamma(f'(c + {d!r})')} - {S.digamma(f'{d!r}::DOUBLE')}) FROM cf WHERE truth = label)) / (2 + down) AS diag,
  (1 + {o!r} * (SELECT sum({S.digamma(f'(c + {o!r})')} - {S.digamma(f'{o!r}::DOUBLE')}) FROM cf WHERE truth <> label)) / (2 + {k - 1} * down) AS off FROM dn)"""


@query("tune_priors_step", f"""WITH {S.LINE}, {Q.start(3)}, {Q.m_step(1, 'g0', 3, P)}, {_tune_sql(3)}
SELECT round(b_theta, 6) AS b_theta, round(diag, 6) AS diag, round("off", 6) AS off_diag FROM sym, con""".replace("AS off FROM dn", 'AS "off" FROM dn'))
def tune_priors_step(spark, sf):
    """One fixed-point step for the class and confusion priors from the vote-share start."""
    ann = V.line_annotations(spark, sf)
    g = votes.smoothed_majority(ann, V.line_items(spark, sf), 3, ann.select("annotator_id").distinct().count())
    b_theta = tuning.symmetric_step(g.select(F.col("p").alias("c")), 3, P.b_theta)
    rows = tuning.confusion_rows(joins.soft_confusion(ann, g, 3), 3)
    diag, off = tuning.confusion_step(rows, 3, *P.annotator_cell(3))
    return rounded(_one_row(spark, b_theta=b_theta, diag=diag, off_diag=off), "b_theta", "diag", "off_diag")


def _strengths(soft: str, k: int) -> str:
    """cf(annotator_id, truth, label, c): every row of soft counts on all labels."""
    return f"""cf AS (SELECT r.annotator_id, r.truth, l.truth AS label, coalesce(x.c, 0) AS c FROM (SELECT DISTINCT annotator_id, truth FROM {soft}) r
  CROSS JOIN {S.classes(k)} l LEFT JOIN {soft} x ON x.annotator_id = r.annotator_id AND x.truth = r.truth AND x.label = l.truth)"""


#: a stop so tight that rounded strengths do not depend on the way to them
TIGHT = {"max_steps": 400, "stop": 1e-8}


def _tuned(spark, priors, *names):
    row = _one_row(spark, **{n: getattr(priors, n) for n in names})
    return row.select(*(F.round(n, 1 if n == "c_gamma" else 3).alias(n) for n in names))


_PAIR_OUT = "round((SELECT arg_max(d / (d + {n} * o), i) FROM con), 3) AS b_gamma, round((SELECT arg_max(d + {n} * o, i) FROM con), 1) AS c_gamma"


@query("tune_priors", f"""WITH RECURSIVE {S.LINE}, {Q.variational(3, 1, False, P)}, {Q.m_step(2, 'g1', 3, U)}, {_strengths('soft2', 3)},
tc AS (SELECT g AS v, 1 AS n FROM g1), tt AS (SELECT sum(g) AS v, 1 AS n FROM g1 GROUP BY item_id),
{Q.fixed_point('theta', 'tc', 'tt', '3::DOUBLE', P.b_theta)}, {Q.fixed_pair('con', 'cf', 3, *U.annotator_cell(3))}
SELECT round((SELECT arg_max(a, i) FROM theta), 3) AS b_theta, {_PAIR_OUT.format(n=2)}""")
def tune_priors(spark, sf):
    """Priors of the label-only model re-estimated to convergence after a fit."""
    fit = _line_fit(spark, sf, 1)
    return _tuned(spark, tuning.tune_priors(fit.posterior, fit.soft, fit.priors, 3, **TIGHT), "b_theta", "b_gamma", "c_gamma")


@query("tune_priors_pair", f"""WITH RECURSIVE {DOCS}, {Q.start(2)}, {Q.simplex(2, SEED)}, {Q.pair_step(1, 'g0', 'h0', 'g0', 'h0', 2, U)},
{Q.m_step(2, 'g1', 2, U)}, {Q.word_step(2, 'g1', 2, U)}, {_strengths('soft2', 2)},
tc AS (SELECT sum(g) AS v, 1 AS n FROM g1 GROUP BY truth), tt AS (SELECT sum(g) AS v, 1 AS n FROM g1),
wc AS (SELECT c AS v, 1 AS n FROM voc2), wz AS (SELECT sum(c) AS v, 1 AS n FROM voc2 GROUP BY truth), vn AS (SELECT count(DISTINCT feature)::DOUBLE AS f FROM feat),
{Q.fixed_point('theta', 'tc', 'tt', '2::DOUBLE', P.b_theta)}, {Q.fixed_point('phi', 'wc', 'wz', '(SELECT f FROM vn)', P.b_phi)},
{Q.fixed_pair('con', 'cf', 2, *U.annotator_cell(2))}
SELECT round((SELECT arg_max(a, i) FROM theta), 3) AS b_theta, round((SELECT arg_max(a, i) FROM phi), 3) AS b_phi, {_PAIR_OUT.format(n=1)}""")
def tune_priors_pair(spark, sf):
    """Priors of the two-class model, tuned inside its fit."""
    items = V.doc_items(spark, sf)
    fit = M.multi_resp_vb(V.doc_annotations(spark, sf), V.doc_features(spark, sf), items, 2, M.random_simplex(items, 2, SEED), P, 1,
                          tune=lambda *a: tuning.inline_tuner(*a, **TIGHT))
    return _tuned(spark, fit.priors, "b_theta", "b_phi", "b_gamma", "c_gamma")


_HARD = "cf AS (SELECT r.annotator_id, r.truth, l.truth AS label, coalesce(nn.c, 0) AS c FROM (SELECT js.annotator_id, k.truth FROM js CROSS JOIN k) r CROSS JOIN k l LEFT JOIN nn ON nn.annotator_id = r.annotator_id AND nn.truth = r.truth AND nn.label = l.truth)"


@query("tune_sweep", f"""WITH RECURSIVE {LINE_STATE}, {_HARD},
tc AS (SELECT c - {P.b_theta} AS v, 1 AS n FROM cc), tt AS (SELECT sum(v) AS v, 1 AS n FROM tc),
{Q.fixed_point('theta', 'tc', 'tt', '3::DOUBLE', P.b_theta)}, {Q.fixed_pair('con', 'cf', 3, *P.annotator_cell(3))}
SELECT round((SELECT arg_max(a, i) FROM theta), 3) AS b_theta, {_PAIR_OUT.format(n=2)}""")
def tune_sweep(spark, sf):
    """Priors of a sweep over labels, from histograms of its counts."""
    run = _line_run(spark, sf)
    run.tune()
    return _tuned(spark, run.priors, "b_theta", "b_gamma", "c_gamma")


@query("tune_sweep_pair", f"""WITH RECURSIVE {DOC_STATE}, {Q.m_conditional('m', P)}, {_HARD},
tc AS (SELECT c - {P.b_theta} AS v, 1 AS n FROM cc), tt AS (SELECT sum(v) AS v, 1 AS n FROM tc),
wc AS (SELECT v - {P.b_phi} AS v, count(*) AS n FROM fv GROUP BY 1), wz AS (SELECT sum(v - {P.b_phi}) AS v, 1 AS n FROM fv GROUP BY truth),
vn AS (SELECT count(DISTINCT feature)::DOUBLE AS f FROM feat),
{Q.fixed_point('theta', 'tc', 'tt', '2::DOUBLE', P.b_theta)}, {Q.fixed_point('phi', 'wc', 'wz', '(SELECT f FROM vn)', P.b_phi)},
{Q.fixed_pair('con', 'cf', 2, *P.annotator_cell(2))}
SELECT round((SELECT arg_max(a, i) FROM theta), 3) AS b_theta, round((SELECT arg_max(a, i) FROM phi), 3) AS b_phi, {_PAIR_OUT.format(n=1)}""")
def tune_sweep_pair(spark, sf):
    """The same with words through a second class."""
    run = _doc_run(spark, sf, sweeps.MULTI)
    run.tune()
    return _tuned(spark, run.priors, "b_theta", "b_phi", "b_gamma", "c_gamma")


_PERMS = [(0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)]


@query("align_labels", f"""WITH {S.LINE}, {S.MAJORITY.replace('maj AS', 'maj0 AS')},
maj AS (SELECT item_id, (label + 1) % 3 AS label FROM maj0), {CONFUSION},
norm AS (SELECT *, value / sum(value) OVER (PARTITION BY annotator_id, truth) AS v FROM conf),
cum AS (SELECT truth, label, sum(v) AS v FROM norm GROUP BY truth, label),
perm AS (SELECT * FROM (VALUES {', '.join(f'({i}, {t}, {p[t]})' for i, p in enumerate(_PERMS) for t in range(3))}) x(id, truth, target)),
best AS (SELECT id FROM perm JOIN cum ON cum.truth = perm.truth AND cum.label = perm.target
  GROUP BY id ORDER BY sum(v) DESC LIMIT 1)
SELECT m.item_id, p.target AS label FROM maj m JOIN perm p ON p.truth = m.label JOIN best ON best.id = p.id""")
def align_labels(spark, sf):
    """Rotated majority labels lined up again through the average annotator confusion."""
    ann = V.line_annotations(spark, sf)
    rotated = votes.majority_vote(ann).select("item_id", ((F.col("label") + 1) % 3).alias("label"), F.lit(0.5).alias("weight"))
    conf = counts.confusion_counts(ann, rotated, ann.select("annotator_id").distinct(), 3, P)
    norm = counts.normalize_rows(conf.drop("row_total"))
    return align.apply_map(rotated.select("item_id", "label"), "label", align.class_map("avg_gamma", 3, norm))


@query("align_labels_gold", f"WITH {S.EMB}, {S.MAJORITY} SELECT item_id, label FROM maj")
def align_labels_gold(spark, sf):
    """Majority labels rotated by one class; the gold labels bring them back."""
    rotated = votes.majority_vote(V.emb_annotations(spark, sf)).select("item_id", ((F.col("label") + 1) % 10).alias("label"))
    cells = counts.gold_confusion(rotated, V.emb_items(spark, sf))
    return align.apply_map(rotated, "label", align.class_map("gold", 10, gold_cells=cells))


