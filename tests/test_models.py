"""Model properties: conditionals against the log joint, monotone bounds, skew and partition invariance."""

import math
import warnings
from dataclasses import replace
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelmesh.functions import arrays
from labelmesh.models import bounds, classifier, loglinear, measurement, newton, scoring, sweeps, tuning, variational as M
from labelmesh.operators import joins, measurements as ms, neighbors, votes
from labelmesh.plans import measuring, views as V
from labelmesh.priors import Priors

P = Priors(b_theta=1 / 3, b_mu=0.75, c_mu=2.0, b_gamma=0.75, c_gamma=2.0, b_phi=1.23)
ITEMS = ["0", "1", "2", "3", "4"]
Y, MM = [0, 1, 2, 1, 0], [0, 0, 1, 2, 0]
ANN = {("0", 0, 0): 1, ("1", 1, 1): 1, ("2", 0, 2): 1, ("2", 1, 1): 1, ("3", 0, 0): 2, ("3", 1, 0): 1, ("3", 1, 1): 1}
FEAT = {("0", 0): 1, ("0", 4): 2, ("1", 1): 3, ("1", 2): 1, ("2", 1): 1, ("2", 3): 4, ("3", 1): 1, ("3", 4): 1,
        ("4", 2): 4, ("4", 3): 1}


def brute_log_joint(kind, y, m, weight):
    """Written out from dense count tables."""
    lg = np.vectorize(math.lgamma)
    w = {i: weight[n] for n, i in enumerate(ITEMS)}
    c = np.full(3, P.b_theta)
    n = np.full((2, 3, 3), 0.25) + np.eye(3) * 1.25
    f = np.full((3, 5), P.b_phi)
    mu = np.full((3, 3), 0.25) + np.eye(3) * 1.25
    ys, mms = dict(zip(ITEMS, y)), dict(zip(ITEMS, m))
    for i in ITEMS:
        c[ys[i]] += w[i]
        mu[ys[i], mms[i]] += w[i]
    for (i, j, k), v in ANN.items():
        n[j, ys[i], k] += v * w[i]
    for (i, x), v in FEAT.items():
        f[ys[i] if kind == sweeps.MOM else mms[i], x] += v * w[i]
    out = lg(c).sum() + lg(n).sum() - lg(n.sum(2)).sum()
    if kind != sweeps.ITEM:
        out += lg(f).sum() - lg(f.sum(1)).sum()
    if kind == sweeps.MULTI:
        out += lg(mu).sum() - lg(mu.sum(1)).sum()
    return out


@pytest.mark.parametrize("kind", [sweeps.ITEM, sweeps.MOM, sweeps.MULTI])
@pytest.mark.parametrize("last", [1.0, 0.5, 0.1])
def test_conditional_is_normalised_log_joint(spark, stub, kind, last):
    """The unannotated last item's weight varies."""
    weight = [1.0, 1.0, 1.0, 1.0, last]
    items = spark.createDataFrame(list(zip(ITEMS, weight)), "item_id string, weight double")
    feats = None if kind == sweeps.ITEM else stub["features"]
    run = sweeps.Sweeper.start(kind, stub["annotations"], stub["state"], 3, P, feats, items)
    start_m = Y if kind != sweeps.MULTI else MM
    assert run.log_joint() == pytest.approx(brute_log_joint(kind, Y, MM if kind == sweeps.MULTI else start_m, weight), abs=1e-8)
    for row in run.conditional().select("item_id", "s").collect():
        at = ITEMS.index(row["item_id"])
        values = []
        for choice in product(range(3), range(3)) if kind == sweeps.MULTI else [(c, c) for c in range(3)]:
            y, m = list(Y), list(MM)
            y[at], m[at] = choice
            values.append(brute_log_joint(kind, y, m, weight))
        want = np.array(values) - np.max(values)
        want = want - np.log(np.exp(want).sum())
        got = np.array(row["s"])
        got = got - got.max()
        got = got - np.log(np.exp(got).sum())
        assert got == pytest.approx(want, abs=1e-8)


def test_observed_label_is_kept(spark, stub):
    items = spark.createDataFrame([("1", 2), ("0", None)], "item_id string, observed_label int")
    state = stub["state"].withColumn("y", F.when(F.col("item_id") == "1", 2).otherwise(F.col("y")))
    run = sweeps.Sweeper.start(sweeps.MULTI, stub["annotations"], state, 3, P, stub["features"], items, seed=4)
    for variable in ("all", "y", "m"):
        run.sweep(variable, sample=True)
        assert run.state.filter("item_id = '1'").first()["y"] == 2


def test_half_sweep_temperature_and_schedule(spark, stub):
    run = sweeps.Sweeper.start(sweeps.ITEM, stub["annotations"], stub["state"], 3, P, seed=1)
    before = {r["item_id"]: r["y"] for r in run.state.collect()}
    moved = run.sweep(sample=True, half=0).state.collect()
    from labelmesh.functions import rand

    halves = {r[0]: r[1] % 2 for r in run.state.select("item_id", F.expr(rand.hash_text("1-half", "item_id"))).collect()}
    assert all(before[r["item_id"]] == r["y"] for r in moved if halves[r["item_id"]] == 1)
    run.set_temperature(2.0)
    assert run.state.filter("aggregate(y_seen, 0L, (a, b) -> a + b) <> 1 OR y_seen[y] <> 1").count() == 0
    assert {r["item_id"]: r["y"] for r in run.marginal().collect()} == {r["item_id"]: r["y"] for r in moved}
    trace = sweeps.train(run, [sweeps.Step("sample", "y", 2, 2.0), sweeps.Step("maximize", "y", 1)])
    assert [t["step"] for t in trace] == ["sample", "maximize"]
    assert run.state.agg(F.min(F.expr("aggregate(y_seen, 0L, (a, b) -> a + b)"))).first()[0] == 3
    with pytest.raises(ValueError):
        sweeps.Step("guess")


def rows(df):
    """(key..., rounded cells) for comparing whole tables."""
    out = []
    for r in df.collect():
        out.append(tuple(
            tuple(round(x, 9) for x in v) if isinstance(v, list) else round(v, 9) if isinstance(v, float) else v for v in r
        ))
    return sorted(out)


def test_variational_bounds_rise(spark, stub):
    h = M.random_simplex(stub["items"], 3, 1)
    last = {}
    for steps in range(4):
        fits = {
            "item": M.item_resp_vb(stub["annotations"], stub["items"], 3, P, steps),
            "mom": M.mom_resp_vb(stub["annotations"], stub["features"], stub["items"], 3, P, steps),
        }
        for name, fit in fits.items():
            feats = stub["features"] if name == "mom" else None
            value = bounds.elbo(fit, stub["annotations"], feats)
            assert value >= last.get(name, -math.inf) - 1e-7
            last[name] = value
    first = bounds.elbo(M.multi_resp_vb(stub["annotations"], stub["features"], stub["items"], 3, h, P, 1), stub["annotations"], stub["features"])
    later = bounds.elbo(M.multi_resp_vb(stub["annotations"], stub["features"], stub["items"], 3, h, P, 5), stub["annotations"], stub["features"])
    assert later >= first - 1e-7


def test_hot_items_do_not_change_results(spark, stub):
    """Splitting every group of more than one row gives the same posteriors and sweeps."""
    plain = M.mom_resp_vb(stub["annotations"], stub["features"], stub["items"], 3, P, 2)
    split = M.mom_resp_vb(stub["annotations"], stub["features"], stub["items"], 3, P, 2, rows_per_split=1)
    assert rows(plain.posterior) == rows(split.posterior)
    assert rows(plain.confusion()) == rows(split.confusion())
    for kind in (sweeps.ITEM, sweeps.MULTI):
        feats = None if kind == sweeps.ITEM else stub["features"]
        runs = [
            sweeps.Sweeper.start(kind, stub["annotations"], stub["state"], 3, P, feats, seed=2, rows_per_split=n)
            for n in (None, 1)
        ]
        assert rows(runs[0].conditional().select("item_id", "s")) == rows(runs[1].conditional().select("item_id", "s"))


def test_split_join_of_parameters(spark, stub, monkeypatch):
    """Without broadcasts parameters are joined by split keys; nothing changes."""
    plain = M.mom_resp_vb(stub["annotations"], stub["features"], stub["items"], 3, P, 2)
    monkeypatch.setattr("labelmesh.runtime.BROADCAST_BYTES", 0)
    wide = M.mom_resp_vb(stub["annotations"], stub["features"], stub["items"], 3, P, 2, rows_per_split=1)
    assert rows(plain.posterior) == rows(wide.posterior)
    new = stub["annotations"].withColumn("annotator_id", F.col("annotator_id") + 1)
    wide_scores = scoring.score_items(new, scoring.point_model(plain))
    monkeypatch.undo()
    assert rows(scoring.score_items(new, scoring.point_model(plain))) == rows(wide_scores)


def test_partitioning_does_not_matter(spark, stub):
    def run():
        fit = M.item_resp_vb(stub["annotations"].repartition(5), stub["items"], 3, P, 2)
        sweep = sweeps.Sweeper.start(sweeps.MULTI, stub["annotations"], stub["state"], 3, P, stub["features"], seed=9)
        return rows(fit.posterior), rows(sweep.sweep().state.select("item_id", "y", "m"))

    many = run()
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert run() == many
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "3")


def test_new_items_of_the_two_class_model(spark, stub):
    """Ten alternations written out in numpy."""
    h = M.random_simplex(stub["items"], 3, 1)
    fit = M.multi_resp_vb(stub["annotations"], stub["features"], stub["items"], 3, h, P, 1)
    got = {r["item_id"]: r["p"] for r in scoring.score_items_expected(
        stub["annotations"], fit, stub["items"], stub["features"]).collect()}
    from labelmesh.functions.special import digamma_value as psi

    nu = {(r[0], r[1], r[2]): r[3] for r in fit.confusion().collect()}
    row = {(j, t): sum(nu[j, t, k] for k in range(3)) for j in range(2) for t in range(3)}
    lam = {r["feature"]: r["c"] for r in fit.vocab.collect()}
    tot = [sum(lam[f][t] + P.b_phi for f in lam) for t in range(3)]
    tau = np.array(fit.machine_cells).reshape(3, 3)
    lt = np.array([[psi(tau[a, b]) - psi(tau[a].sum()) for b in range(3)] for a in range(3)])
    lp = np.array([psi(v) - psi(sum(fit.class_prior)) for v in fit.class_prior])
    for i in ITEMS:
        a = np.array([sum(v * (psi(nu[j, t, k]) - psi(row[j, t])) for (x, j, k), v in ANN.items() if x == i) for t in range(3)])
        b = np.array([sum(v * (psi(lam[f][t] + P.b_phi) - psi(tot[t])) for (x, f), v in FEAT.items() if x == i) for t in range(3)])
        hh = np.full(3, math.e)
        for _ in range(10):
            g = lp + lt @ hh + a
            g = np.exp(g - g.max())
            g /= g.sum()
            hh = lt.T @ g + b
            hh = np.exp(hh - hh.max())
            hh /= hh.sum()
        assert got[i] == pytest.approx(list(g), abs=1e-9)


def test_unknown_annotators_use_the_prior(spark, stub):
    fit = M.item_resp_vb(stub["annotations"], stub["items"], 3, P, 1)
    new = spark.createDataFrame([("x", 99, 2, 1)], "item_id string, annotator_id int, label int, n bigint")
    p = scoring.score_items(new, scoring.point_model(fit)).first()["p"]
    theta = np.array(fit.class_prior) / sum(fit.class_prior)
    want = theta * np.array([0.125, 0.125, 0.75])
    assert p == pytest.approx(list(want / want.sum()), abs=1e-9)


def test_tuned_priors_are_stationary(spark, sf):
    ann = V.line_annotations(spark, sf)
    fit = M.item_resp_vb(ann, V.line_items(spark, sf), 3, Priors(), 1)
    tuned = tuning.tune_priors(fit.posterior, fit.soft, fit.priors, 3)
    again = tuning.symmetric_step(fit.posterior.select(F.col("p").alias("c")), 3, tuned.b_theta)
    assert again == pytest.approx(tuned.b_theta, rel=2e-3)
    cell = tuned.annotator_cell(3)
    assert tuning.confusion_step(tuning.confusion_rows(fit.soft, 3), 3, *cell) == pytest.approx(cell, rel=2e-3)
    inline = M.item_resp_vb(ann, V.line_items(spark, sf), 3, Priors(), 1, tune=tuning.inline_tuner)
    assert inline.priors.b_theta != 1.0


@pytest.fixture(scope="module")
def emb(spark, sf):
    items = V.emb_items(spark, sf)
    return items, V.emb_annotations(spark, sf), {r["item_id"]: r["gold_label"] for r in items.collect()}


def share_right(df, gold):
    got = df.collect()
    assert len(got) == len(gold)
    return np.mean([gold[r["item_id"]] == r["label"] for r in got])


def test_models_recover_classes(spark, emb):
    items, ann, gold = emb
    vote = share_right(votes.majority_vote(ann), gold)
    item = share_right(M.argmax_labels(M.item_resp_vb(ann, items, 10, Priors(), 5).posterior), gold)
    assert item >= vote
    design = classifier.dense_design(items, "location", 10)
    fit = loglinear.log_resp_vb(ann, items, design, 10, Priors(), 2)
    assert share_right(M.argmax_labels(fit.posterior), gold) >= vote
    ranked = [r["annotator_id"] for r in fit.annotator_accuracy().orderBy(F.desc("accuracy")).collect()]
    assert ranked == [0, 1, 2, 3, 4]


def test_log_linear_em(spark, emb):
    items, ann, gold = emb
    half = ann.filter("item_id % 2 = 0")
    design = classifier.dense_design(items, "location", 10)
    fit = loglinear.log_resp_em(half, items, design, 10, Priors(), 3)
    assert fit.posterior.filter("p IS NULL").count() == 0
    assert share_right(M.argmax_labels(fit.posterior), gold) > 0.5
    both = loglinear.log_resp_em(half, items, design, 10, Priors(), 2, semisupervised=True)
    assert both.posterior.count() == len(gold)


def test_classifier_by_joins_agrees(spark, stub):
    """The table-of-coefficients solver and the dense one reach the same fit."""
    soft = spark.createDataFrame([("0", [0.9, 0.1]), ("1", [0.2, 0.8]), ("2", [0.1, 0.9]), ("3", [0.5, 0.5])],
                                 "item_id string, p array<double>")
    strong = Priors(eta_variance=0.05)
    dense = classifier.fit(classifier.sparse_design(stub["features"], stub["items"], 2), soft, strong, 100)
    design = classifier.sparse_design(stub["features"], stub["items"], 2)
    long = stub["features"].withColumn("feature", F.col("feature").cast("string"))
    table = classifier.Design(2, design.size, long=long, items=stub["items"].select("item_id"))
    joined = classifier.fit(table, soft, strong, 25)
    a = {r["item_id"]: r["lp"] for r in dense.scores.collect()}
    b = {r["item_id"]: r["lp"] for r in joined.scores.collect()}
    assert set(a) == set(b) == set(ITEMS)
    for i in ITEMS:
        assert np.exp(a[i]) == pytest.approx(np.exp(b[i]), abs=0.05)


def test_both_classifier_solvers_agree_at_the_switch(spark, monkeypatch):
    """Lowering the limit of dense coefficients changes the solver, not the probabilities."""
    r = np.random.default_rng(5)
    features = [(i, f"w{f}", float(n)) for i in range(60) for f, n in zip(r.choice(30, 6, False), r.integers(1, 6, 6))]
    features = spark.createDataFrame(features, "item_id int, feature string, value double")
    items = spark.range(62).select(F.col("id").cast("int").alias("item_id"))
    soft = spark.createDataFrame([(i, [0.0, *map(float, r.dirichlet([0.3, 0.3]))]) for i in range(50)], "item_id int, p array<double>")
    dense = classifier.fit(classifier.sparse_design(features, items, 3), soft, Priors())
    monkeypatch.setattr(classifier, "MAX_COEFFICIENTS", 10)
    design = classifier.sparse_design(features, items, 3)
    assert design.vectors is None
    joined = classifier.fit(design, soft, Priors())
    a = {r["item_id"]: r["lp"] for r in dense.scores.collect()}
    b = {r["item_id"]: r["lp"] for r in joined.scores.collect()}
    assert set(a) == set(b) == set(range(62))
    assert max(np.abs(np.exp(a[i]) - np.exp(b[i])).max() for i in a) < 2e-3
    assert joined.table.count() == len(dense.coefficients[0]) and all(len(x["w"]) == 3 and x["w"][0] == 0 for x in joined.table.collect())


def test_absent_classes_keep_a_chance(spark):
    """A class no training row has gets its smoothed share, whatever its place."""
    vectors = spark.createDataFrame([(i, [float(i % 2), 1.0]) for i in range(8)], "item_id int, x array<double>")
    soft = spark.createDataFrame([(i, [1.0 - i % 2, float(i % 2), 0.0]) for i in range(8)], "item_id int, p array<double>")
    fit = classifier.fit(classifier.dense_design(vectors, "x", 3), soft, Priors())
    assert len(fit.coefficients) == len(fit.intercepts) == 3 and fit.coefficients[2] == [0.0, 0.0]
    for r in fit.scores.collect():
        p = np.exp(r["lp"])
        assert p.sum() == pytest.approx(1) and 1e-3 < p[2] < 0.5 and p.argmax() == r["item_id"] % 2


def test_discriminative_em(spark, sf):
    fit = loglinear.discriminative_em(
        V.doc_annotations(spark, sf), V.doc_features(spark, sf), V.doc_items(spark, sf), 2, Priors(), 2)
    assert all(0 <= r["accuracy"] <= 1 for r in fit.annotator_accuracy().collect())
    assert fit.posterior.count() == V.doc_items(spark, sf).count()


def test_measurement_bound_rises_for_annotations(spark, emb):
    items, _, _ = emb
    model = None
    marks = measuring.emb_marks(items.sparkSession, "/root/testdata/sf0.001")
    model = measurement.MeasurementModel.build(marks, items, 10, None, measuring.P)
    last = -math.inf
    for _ in range(4):
        value = model.step().bound()
        assert value >= last - 1e-6
        last = value
    assert sorted(model.class_ranking()) == list(range(10))


def test_measurement_halves_and_trust(spark, emb, sf):
    items, _, gold = emb
    marks = measuring.emb_marks(spark, sf).unionByName(measuring.emb_regions(spark, sf))
    model = measurement.measurement_vb(marks, items, 10, None, measuring.P, 2, halves=True, trusted=0)
    labels = M.argmax_labels(model.posterior)
    rater = {r["item_id"]: r["label"] for r in V.emb_annotations(spark, sf).filter("annotator_id = 0").collect()}
    assert np.mean([rater[r["item_id"]] == r["label"] for r in labels.collect()]) > 0.99
    noise = {r[0]: r[1] for r in model.annotator_variance().collect()}
    assert noise[0] < min(v for k, v in noise.items() if k not in (0, 5, 6))


def plain_nearest(sources, items, digits=9):
    """{(source, item): (cosine, rank)} by comparing everything."""
    out = {}
    for source, vector, k in sources:
        scored = []
        for item, other in items:
            if other is not None and vector is not None and len(other) == len(vector) and any(other) and any(vector):
                scored.append((-round(float(np.dot(vector, other) / np.linalg.norm(vector) / np.linalg.norm(other)), digits), item))
        for rank, (cosine, item) in enumerate(sorted(scored)[:k if k and k > 0 else None], 1):
            out[source, item] = (-cosine, rank if k and k > 0 else 0)
    return out


@pytest.mark.parametrize("pivots,piece", [(1, 8192), (40, 8192), (40, 7)])
def test_nearest_items_equal_brute_force(spark, monkeypatch, pivots, piece):
    monkeypatch.setattr(neighbors, "LEAST_PIVOTS", pivots)
    monkeypatch.setattr(neighbors, "PIECE_ROWS", piece)
    r = np.random.default_rng(3)
    base = r.normal(size=(12, 8))
    items = [(i, (base[i % 12] * (1 + i % 3) + r.normal(size=8) * 0.1 * (i % 5)).tolist()) for i in range(300)]
    items += [(1000 + i, base[0].tolist()) for i in range(60)] + [(2000, [0.0] * 8), (2001, None), (2002, [1.0, 2.0])]
    sources = [(i, r.normal(size=8).tolist(), 1 + i % 9) for i in range(10)] + [(20 + i, base[i].tolist(), 4) for i in range(12)]
    sources += [(50, base[0].tolist(), None), (51, base[1].tolist(), 0), (52, [0.0] * 8, 3), (53, None, 3), (54, base[2].tolist(), 5000), (55, [1.0, 2.0], 2)]
    table = spark.createDataFrame(items, "item_id long, location array<double>").repartition(3)
    asked = spark.createDataFrame(sources, "source_id int, location array<double>, k int")
    got = {(x.source_id, x.item_id): (round(x.cosine, 9), x["rank"]) for x in neighbors.nearest(asked, table).collect()}
    assert got == {k: (pytest.approx(c, abs=2e-9), n) for k, (c, n) in plain_nearest([s for s in sources if s[0] != 55], items).items()}
    assert neighbors.nearest(asked, table.limit(0)).count() == 0 and neighbors.nearest(asked.limit(0), table).count() == 0


def test_nearest_items_compare_few_pairs_of_clustered_vectors(spark):
    r = np.random.default_rng(5)
    base = r.normal(size=(50, 16)) * 4
    items = [(i, (base[i % 50] + r.normal(size=16) * 0.2).tolist()) for i in range(6000)]
    sources = [(i, (base[i % 50] + r.normal(size=16) * 0.2).tolist(), 5) for i in range(100)]
    neighbors_of, pairs = neighbors.visits(spark.createDataFrame(sources, "source_id int, location array<double>, k int"),
                                           spark.createDataFrame(items, "item_id long, location array<double>"))
    assert pairs < 0.2 * len(items) * len(sources)


@pytest.mark.parametrize("near", [3, 0])
def test_nearest_items(spark, emb, sf, near):
    items, _, _ = emb
    sources = measuring.centroids(spark, sf).select(F.col("label").cast("bigint").alias("source_id"), "location")
    got = rows(ms.knn_location(sources, items, near).select("source_id", "item_id", F.round("cosine", 7)))
    every = ms.cosine_adjacency(ms._long(sources, "source_id"), ms._long(items, "item_id"))
    assert len(got) == 10 * (near or items.count()) and set(got) <= set(rows(every.select("source_id", "item_id", F.round("cosine", 7))))


def test_dense_index(spark, sf):
    from labelmesh.operators.prep import dense_index

    words = V.doc_features(spark, sf)
    index = dense_index(words, "feature", "idx")
    n = words.select("feature").distinct().count()
    stats = index.agg(F.count(F.lit(1)), F.countDistinct("idx"), F.min("idx"), F.max("idx")).first()
    assert tuple(stats) == (n, n, 0, n - 1)


def test_array_helpers(spark):
    df = spark.createDataFrame([(1, [1000.0, 1000.0, 999.0], [3.0, 4.0], [4.0, 3.0])],
                               "i int, s array<double>, a array<double>, b array<double>")
    p = arrays.softmax(df.select("i", "s"), "s", "p", 3).first()["p"]
    assert sum(p) == pytest.approx(1.0) and p[0] == p[1] > p[2]
    row = df.select(arrays.cosine("a", "b"), arrays.argmax("s"), F.expr(arrays.softmax_text("s"))).first()
    assert row[0] == pytest.approx(24 / 25) and row[1] == 0 and row[2] == pytest.approx(p)
    assert df.select(votes.rank_array("s")).first()[0] == [0, 1, 2]
    assert joins.class_sums(df.select(F.col("a").alias("p")), 2).first()[0] == [3.0, 4.0]


def test_predictions_after_sampling(spark, stub):
    run = sweeps.Sweeper.start(sweeps.MULTI, stub["annotations"], stub["state"], 3, P, stub["features"], seed=3)
    for _ in range(2):
        run.sweep(sample=True)
    mean = run.mean_machine()
    assert [sum(mean[a * 3:a * 3 + 3]) for a in range(3)] == pytest.approx([1.0] * 3)
    scored = scoring.score_items(stub["annotations"], run.point_model(), stub["items"], stub["features"]).collect()
    assert len(scored) == 5 and all(sum(r["p"]) == pytest.approx(1.0) for r in scored)


def test_further_measurement_kind(spark, stub):
    """A kind given as a function; one that repeats the built-in annotation kind as coupled targets agrees with it."""
    marks = stub["annotations"].select(
        F.xxhash64("item_id", "annotator_id", "label").alias("meas_id"), "annotator_id", F.lit("annotation").alias("kind"),
        "label", F.lit(1.0).alias("value"), "item_id")

    def same(mine, items):
        return mine.select("meas_id", "item_id", F.lit(1.0).alias("sigma")), mine.select("meas_id", F.lit(1.0).alias("range"))

    prior = Priors(b_gamma=2.0, c_gamma=1.0)
    plain = measurement.MeasurementModel.build(marks, stub["items"], 3, None, prior)
    other = measurement.MeasurementModel.build(
        marks.withColumn("kind", F.lit("mine")), stub["items"], 3, None, prior, more_kinds={"mine": same})
    plain.rolling.push(votes.log_vote(marks, stub["items"], 3))
    other.rolling.push(votes.log_vote(marks, stub["items"], 3))
    assert rows(plain.step(1.0).posterior) == rows(other.step(1.0).posterior)
    assert plain.bound() == pytest.approx(other.bound(), abs=1e-8)


def test_backoff_of_topics(spark):
    from labelmesh.operators.prep import backoff_state

    items = spark.createDataFrame([(1,), (2,)], "item_id int")
    state = spark.createDataFrame([(1, 5, None, [1, 0])], "item_id int, y int, m int, z array<int>")
    fallback = spark.createDataFrame([(1, 7), (2, 8)], "item_id int, label int")
    topics = spark.createDataFrame([(1, [0]), (2, [1])], "item_id int, z array<int>")
    got = sorted(tuple(r) for r in backoff_state(items, state, fallback, topics).collect())
    assert got == [(1, 5, 7, [1, 0]), (2, 8, 8, [1])]


def wide_case(spark, k, n=60):
    r = np.random.default_rng(k)
    truth = r.integers(0, k, n)
    marks = [(i, j, int(truth[i] if r.random() < 0.7 else r.integers(0, k)), 1) for i in range(n) for j in range(4)]
    bag = [(i, f"w{truth[i] if r.random() < 0.8 else r.integers(0, k)}", float(r.integers(1, 4))) for i in range(n) for _ in range(3)]
    ann = spark.createDataFrame(marks, "item_id int, annotator_id int, label int, n long")
    features = spark.createDataFrame(bag, "item_id int, feature string, value double").groupBy("item_id", "feature").agg(F.sum("value").alias("value"))
    items = spark.createDataFrame([(i,) for i in range(n)], "item_id int")
    start = spark.createDataFrame([(i, int(truth[i]), int(r.integers(0, k))) for i in range(n)], "item_id int, y int, m int")
    return ann, features, items, start, truth


def test_pairs_of_many_classes_as_rows_equal_pairs_written_out(spark, monkeypatch):
    k = 3
    ann, features, items, start, _ = wide_case(spark, k, 25)
    seen = []
    for unrolled in (k, 1):
        monkeypatch.setattr(arrays, "UNROLLED_CLASSES", unrolled)
        fit = M.multi_resp_vb(ann, features, items, k, M.random_simplex(items, k, 1), P, 1)
        scored = scoring.score_items_expected(ann, fit, items, features)
        point = scoring.score_items(ann, scoring.point_model(fit), items, features)
        out = [sorted((r["item_id"], *np.round(r[c], 7)) for r in df.collect()) for df, c in ((fit.posterior, "p"), (fit.machine, "h"), (scored, "p"), (point, "p"))]
        for variable, sample in (("all", True), ("y", True), ("m", False)):
            run = sweeps.Sweeper.start(sweeps.MULTI, ann, start, k, P, features, seed=2).sweep(variable, sample)
            out.append(sorted((r["item_id"], r["y"], r["m"]) for r in run.state.collect()))
        seen.append(out)
    assert seen[0] == seen[1]


def _long_documents(spark):
    """Rows of very different lengths over words of very different frequency, with hard labels and an unlabelled row."""
    r = np.random.default_rng(11)
    rows = []
    for i in range(150):
        n = int(10 ** r.uniform(0.5, 3.7))
        words, times = np.unique(np.minimum((r.pareto(0.7, n) * 3).astype(int), 4000), return_counts=True)
        rows += [(i, f"w{w}", float(t)) for w, t in zip(words, times)]
    features = spark.createDataFrame(rows, "item_id int, feature string, value double")
    items = spark.range(152).select(F.col("id").cast("int").alias("item_id"))
    soft = spark.createDataFrame([(i, [1.0 - float(y), float(y)]) for i, y in enumerate(r.integers(0, 2, 150))], "item_id int, p array<double>")
    return features, items, soft


def test_two_classes_converge_on_long_documents(spark):
    """A hundred steps leave next to nothing of the gradient, though lengths differ a thousandfold; an earlier fit saves them."""
    features, items, soft = _long_documents(spark)
    design = classifier.sparse_design(features, items, 2)
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        fit = classifier.fit(design, soft, Priors(), 100)
        again = classifier.fit(design, soft, Priors(), 8, start=fit)
    flat = soft.select("item_id", F.expr("array(ln(0.5D), ln(0.5D))").alias("lp"))
    norm = lambda g: sum(x * x for row in g.collect() for x in row["g"]) ** 0.5
    start = norm(classifier.gradient(features, soft, flat, None, Priors(), 2))
    end = norm(classifier.gradient(features, soft, fit.scores, classifier.coefficient_table(design, fit, spark), Priors(), 2))
    assert end < 1e-3 * start
    a, b = ({r["item_id"]: np.exp(r["lp"]) for r in f.scores.collect()} for f in (fit, again))
    assert set(a) == set(range(152)) and max(np.abs(a[i] - b[i]).max() for i in a) < 1e-4
    assert sum(fit.intercepts) == pytest.approx(0) and a[150] == pytest.approx(np.exp(fit.intercepts) / np.exp(fit.intercepts).sum())


def test_the_driver_receives_one_sum_of_vectors(spark, monkeypatch):
    """However many tasks add up vectors, no job sends the driver more than the gradient and the diagonal; slices change no result."""
    from pyspark import RDD

    features, items, soft = _long_documents(spark)
    pair = lambda v: isinstance(v, tuple) and len(v) == 2 and all(isinstance(x, np.ndarray) for x in v)  # noqa: E731  entries of a heavy row
    size_of = lambda v: (v.nbytes if isinstance(v, np.ndarray) else sum(map(size_of, v)) if isinstance(v, list | tuple) and not pair(v) else 0)
    sizes, collect, few = [], RDD.collect, Priors(eta_variance=0.01)
    apart = {"spark.sql.files.maxPartitionBytes": "20000b", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    try:
        for k, v in apart.items():
            spark.conf.set(k, v)
        design = classifier.sparse_design(features, items, 2)
        plain = {r["item_id"]: r["lp"] for r in classifier.fit(design, soft, few, 3).scores.collect()}
        monkeypatch.setattr(newton, "DIRECT", 0)
        monkeypatch.setattr(newton, "SLICE", 300, raising=False)
        monkeypatch.setattr(newton, "ENTRIES_PER_TASK", 1000)
        monkeypatch.setattr(RDD, "collect", lambda self: (out := collect(self), sizes.append(size_of(out)))[0])
        sliced = {r["item_id"]: r["lp"] for r in classifier.fit(design, soft, few, 3).scores.collect()}
    finally:
        for k in apart:
            spark.conf.unset(k)
    vector = 8 * (design.size + 1)
    assert vector < max(sizes) <= 2 * vector + 3 * 8 * newton.ROWS
    assert set(plain) == set(sliced) and max(np.abs(np.exp(plain[i]) - np.exp(sliced[i])).max() for i in plain) < 1e-6


def test_soft_labels_reach_the_dense_optimum(spark):
    """Shares of two classes and rows without words: the probabilities that the dense solver finds."""
    features, items, _ = _long_documents(spark)
    r = np.random.default_rng(3)
    few = features.filter("item_id < 40 AND value < 5")
    soft = spark.createDataFrame([(i, [float(a), float(b)]) for i, (a, b) in enumerate(r.dirichlet([0.5, 0.5], 45))], "item_id int, p array<double>")
    design, strong = classifier.sparse_design(few, items, 2), Priors(eta_variance=0.1)
    found = classifier.fit(design, soft, strong)
    dense = classifier.fit(replace(design, packed=None), soft, strong)
    a, b = ({r["item_id"]: np.exp(r["lp"]) for r in f.scores.collect()} for f in (found, dense))
    assert max(np.abs(a[i] - b[i]).max() for i in a) < 2e-3


def test_words_are_counted_once_for_every_state(spark, stub, monkeypatch):
    """A schedule counts the words again only after a move of the class they are tied to; its log joints are those of fresh counts."""
    state = stub["state"]
    run = sweeps.Sweeper.start(sweeps.MULTI, stub["annotations"], state, 3, P, stub["features"], seed=4)
    count, counted = type(run.corpus).soft_vocab, []
    monkeypatch.setattr(type(run.corpus), "soft_vocab", lambda self, p: (counted.append(1), count(self, p))[1])
    joints = [x["log_joint"] for x in sweeps.train(run, [
        sweeps.Step("sample", "all", 1, 2.0), sweeps.Step("sample", "y", 1), sweeps.Step("maximize", "m", 1), sweeps.Step("maximize", "all", 1)])]
    assert len(counted) == 4  # the start, and after each of the three moves of m
    fresh = sweeps.Sweeper.start(sweeps.MULTI, stub["annotations"], run.state.select("item_id", "y", "m"), 3, P, stub["features"], seed=4)
    assert joints[-1] == pytest.approx(fresh.log_joint(), abs=1e-9)
