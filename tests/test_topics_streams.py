"""Topic sweeps against brute force, and streams that arrive in several batches."""

import math
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from labelmesh.functions import arrays, rand
from labelmesh.functions.special import digamma_value
from labelmesh.models import classifier, scoring, topics, tuning, variational as M
from labelmesh.operators import prep
from labelmesh.plans import learning, modelling, streams, views as V
from labelmesh.priors import Priors
from labelmesh.runtime import shared_path
from labelmesh.sources.models import load_model, save_model
from labelmesh.streaming import annotations as stream, upserts

T, SEED, P = 2, 3, Priors(b_phi=0.1)


@pytest.fixture(scope="module")
def corpus(spark):
    """Two kinds of documents with hardly shared words; half of them annotated; one without a token."""
    docs = [(i, ("moon star orbit " if i % 2 else "goal team match ") * 4 + "the") for i in range(20)] + [(20, "42")]
    docs = spark.createDataFrame(docs, "item_id bigint, text string")
    marks = [(i, j, i % 2, 1) for i in range(0, 10) for j in range(2)]
    ann = spark.createDataFrame(marks, "item_id bigint, annotator_id int, label int, n bigint")
    return docs, ann


def test_tokens_are_whole_and_in_order(spark):
    text = "  Alpha, beta\n\nGAMMA-delta 7 x" + " tail" * 5000
    docs = spark.createDataFrame([(1, text), (2, "!!")], "item_id int, text string")
    got = [r["word"] for r in prep.tokenize(docs).orderBy("pos").collect()]
    assert got == ["alpha", "beta", "gamma", "delta", "x"] + ["tail"] * 5000
    bag = {r["feature"]: r["value"] for r in prep.bag_of_words(docs, 1).collect()}
    assert bag == {"tail": 5000.0}


def brute_weights(before, meta, z, i, word, vocabulary, temperature=1.0):
    d, w = Counter((i, z) for (i, _), (_, z) in before.items()), Counter(before.values())
    n = Counter(z for _, z in before.values())
    own = lambda t: 1 if t == z else 0
    return [((d[i, t] - own(t) + 0.5) * (w[word, t] - own(t) + P.b_phi) / (n[t] - own(t) + vocabulary * P.b_phi) * math.exp(meta[i][t])) ** (1 / temperature)
            for t in range(T)]


@pytest.mark.parametrize("temperature,unrolled", [(1.0, 24), (3.0, 0)])
def test_topic_draw_equals_brute_force(spark, corpus, monkeypatch, temperature, unrolled):
    monkeypatch.setattr(arrays, "UNROLLED", unrolled)
    docs, ann = corpus
    model = topics.TopicLabelModel.start(prep.tokenize(docs), ann, docs, 2, T, P, 0.5, SEED)
    before = {(r["item_id"], r["pos"]): (r["word"], r["z"]) for r in model.tokens.collect()}
    u = F.expr(rand.uniform_text(f"{SEED}-z0", "item_id", "pos")).alias("u")
    uniforms = {(r["item_id"], r["pos"]): r["u"] for r in model.tokens.select("item_id", "pos", u).collect()}
    model.fit_eta()
    meta = {r["item_id"]: r["meta"] for r in model._document_terms().collect()}
    assert meta[20] == [0.0, 0.0] and any(v != 0 for v in meta[0]) and meta[15] == [0.0, 0.0]
    model.move_topics(temperature=temperature)
    after = {(r["item_id"], r["pos"]): r["z"] for r in model.tokens.collect()}
    assert set(after) == set(before)
    vocabulary = len({word for word, _ in before.values()})
    for (i, pos), (word, z) in before.items():
        weights = brute_weights(before, meta, z, i, word, vocabulary, temperature)
        goal, upto = uniforms[i, pos] * sum(weights), 0.0
        for t, weight in enumerate(weights):
            upto += weight
            if goal < upto:
                break
        assert after[i, pos] == t
    assert model.topics_changed() == sum(after[k] != before[k][1] for k in before)


def test_counts_are_taken_again_only_when_stale(spark, corpus):
    docs, ann = corpus
    model = topics.TopicLabelModel.start(prep.tokenize(docs), ann, docs, 2, T, P, 0.5, SEED)
    first = model.word_counts()
    model.fit_eta()
    model.move_labels(sample=False)
    assert model.word_counts() is first
    model.move_topics(sample=False)
    assert model.word_counts() is not first
    want = Counter((r["word"], r["z"]) for r in model.tokens.collect())
    got = {(r["word"], t): c for r in model.word_counts().collect() for t, c in enumerate(r["c"]) if c}
    assert got == dict(want)
    sizes = {r["item_id"]: (r["size"], sum(r["d"])) for r in model.document_counts().collect()}
    assert len(sizes) == 21 and sizes[20] == (0.0, 0.0) and all(a == b for a, b in sizes.values())


def test_topic_schedule(spark, corpus):
    docs, ann = corpus
    model = topics.TopicLabelModel.start(prep.tokenize(docs), ann, docs, 2, T, P, 0.5, SEED)
    trace = topics.train(model, [topics.Step("sample", "z", 2, 2.0), topics.Step("sample", "y", 1), topics.Step("maximize", "b", 1), topics.Step("maximize", "all", 2)], tune=True)
    assert [(t["step"], t["variable"], t["iteration"]) for t in trace] == [
        ("sample", "z", 0), ("sample", "y", 0), ("maximize", "b", 0), ("maximize", "all", 0), ("maximize", "all", 1)]
    assert all(math.isfinite(t["log_joint"]) for t in trace[:2])
    assert trace[2]["changes"] == 0 and 0 <= trace[3]["changes"] <= trace[4]["changes"]
    assert model.alpha != 0.5 and model.priors.b_phi != P.b_phi and model.labels.priors.b_gamma == model.priors.b_gamma
    for step in (topics.Step("sample", "b"), topics.Step("sample", "m")):
        with pytest.raises(ValueError):
            topics.train(model, [step])
    again = topics.TopicLabelModel.start(prep.tokenize(docs), ann, docs, 2, T, P, 0.5, SEED, topics=model.tokens.filter("item_id < 10"))
    kept = {(r["item_id"], r["pos"]): r["z"] for r in model.tokens.collect()}
    assert all(r["z"] == kept[r["item_id"], r["pos"]] for r in again.tokens.collect() if r["item_id"] < 10)


def brute_strength(draws, size, start):
    a = start
    for _ in range(20000):
        up = sum(digamma_value(v + a) - digamma_value(a) for d in draws for v in d)
        down = sum(digamma_value(sum(d) + size * a) - digamma_value(size * a) for d in draws)
        a, last = (1 + a * up) / (2 + size * down), a
        if abs(a - last) < 1e-12:
            return a


@pytest.mark.parametrize("driver_rows", [0, 1000])
def test_histograms_give_the_strength_of_all_draws(spark, monkeypatch, driver_rows):
    monkeypatch.setattr(tuning, "DRIVER_ROWS", driver_rows)
    monkeypatch.setattr(tuning, "STOP", 1e-7)
    draws = [[3.0, 0.0, 5.0], [1.0, 1.0, 0.0], [9.0, 2.0, 2.0], [0.0, 0.0, 0.0], [4.0, 4.0, 0.0]] * 3
    rows = spark.createDataFrame([(d,) for d in draws], "c array<double>")
    assert tuning.symmetric(rows, 3, 1.0) == pytest.approx(brute_strength(draws, 3, 1.0), rel=1e-5)
    vocab = spark.createDataFrame([(f"w{i}", list(c)) for i, c in enumerate(zip(*draws[:2]))], "feature string, c array<double>")
    assert tuning.vocabulary(vocab, 2, 3, 1.0) == pytest.approx(brute_strength(draws[:2], 3, 1.0), rel=1e-5)


def test_where_a_histogram_is_iterated_changes_no_strength(spark, sf, monkeypatch):
    """Histograms too long for the driver end as near to the fixed point as those that it holds."""
    found = []
    for rows in (0, 200_000):
        monkeypatch.setattr(tuning, "DRIVER_ROWS", rows)
        run = modelling._line_run(spark, sf)
        run.tune()
        found.append([getattr(run.priors, n) for n in ("b_theta", "b_gamma", "c_gamma")])
    assert found[0] == pytest.approx(found[1], rel=1e-7)


def test_the_query_runs_every_sweep(spark, sf, monkeypatch):
    """The joint topic model makes the sweeps that the operator makes by itself: 25, all sampling."""
    swept = []
    monkeypatch.setattr(topics.TopicLabelModel, "sweep", lambda self, sample=True, temperature=1.0: swept.append(sample))
    monkeypatch.setattr(topics.TopicLabelModel, "predictions", lambda self: None)
    learning.topic_label_model(spark, sf)
    assert swept == [True] * 25


def test_topic_label_models(spark, corpus):
    docs, ann = corpus
    model = topics.topic_label_model(prep.tokenize(docs), ann, docs, 2, T, P, 5, 1, SEED)
    got = {r["item_id"]: r["label"] for r in model.predictions().collect()}
    assert len(got) == 21 and all(got[i] == i % 2 for i in range(10))
    assert math.isfinite(model.log_joint())
    piped = {r["item_id"]: r["label"] for r in topics.topic_then_label(prep.tokenize(docs), ann, docs, 2, T, P, 5, 1, SEED).collect()}
    assert len(piped) == 21 and all(piped[i] == i % 2 for i in range(10))


def test_greedy_topics_are_repeatable_and_ignore_the_seed_of_draws(spark, corpus):
    docs, ann = corpus
    model = topics.TopicLabelModel.start(prep.tokenize(docs), ann, docs, 2, T, P, 0.5, SEED, labelled=False)
    first = sorted(map(tuple, model.tokens.collect()))
    model.move_topics(sample=False)
    once = sorted(map(tuple, model.tokens.collect()))
    again = topics.TopicLabelModel.start(prep.tokenize(docs), ann, docs, 2, T, P, 0.5, SEED, labelled=False)
    again.sweeps = 7
    again.move_topics(sample=False)
    assert sorted(map(tuple, again.tokens.collect())) == once != first


def test_sparse_vectors(spark, corpus):
    docs, _ = corpus
    bag = prep.bag_of_words(docs)
    design = classifier.sparse_design(bag, docs, 2)
    vectors = {r["item_id"]: r["features"] for r in design.vectors.collect()}
    assert design.size == 7 and vectors[20].numNonzeros() == 0 and len(vectors) == 21
    assert sorted(vectors[0].values) == [1.0, 4.0, 4.0, 4.0]


@pytest.fixture()
def files(spark, sf):
    """The events split over several files, to arrive one per batch in time order."""
    path = shared_path(spark, "event_files")
    events = V.table(spark, sf, "events").orderBy("ts").coalesce(1)
    events.write.option("maxRecordsPerFile", 300).parquet(path)
    return path, events.schema


def arriving(spark, files):
    path, schema = files
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    return V.event_annotations(raw).withColumn("ts", F.col("ts").cast("timestamp"))


def test_running_vote_over_batches(spark, sf, files):
    out = shared_path(spark, "vote")
    query = stream.running_vote(arriving(spark, files), 5, out, f"{out}-state")
    query.awaitTermination()
    assert query.lastProgress["batchId"] > 1
    got = stream.current_votes(spark, out)
    want = streams.running_vote(spark, sf)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.count() == got.select("item_id").distinct().count()


def test_upserts_follow_the_batch(spark, monkeypatch):
    out = shared_path(spark, "target")
    batch = lambda rows: spark.createDataFrame(rows, "item_id long, label int")
    table = {i: 0 for i in range(400)}
    assert upserts.upsert(batch(list(table.items())), 0, out, ["item_id"]) == {"buckets": 8, "rows": 400}
    table |= {7: 3, 1000: 1, None: 2}
    small = upserts.upsert(batch([(7, 3), (1000, 1), (None, 2), (8, 0)]), 1, out, ["item_id"])
    assert small["buckets"] <= 3 and small["rows"] < 400  # 8 is as before, so its bucket stays
    rows = lambda: {r.item_id: r.label for r in upserts.read_target(spark, out).collect()}
    assert rows() == table
    assert upserts.upsert(batch([(7, 9)]), 1, out, ["item_id"]) == {"buckets": 0, "rows": 0} and rows() == table  # taken already
    assert upserts.upsert(batch([(8, 0)]), 2, out, ["item_id"]) == {"buckets": 0, "rows": 0} and rows() == table
    assert upserts.upsert(batch([]), 3, out, ["item_id"]) == {"buckets": 0, "rows": 0} and rows() == table
    monkeypatch.setattr(upserts, "ROWS_PER_BUCKET", 20)
    upserts.upsert(batch([(i, 5) for i in range(300, 600)]), 4, out, ["item_id"])
    assert rows() == table | {i: 5 for i in range(300, 600)}
    upserts.upsert(batch([(1, 6)]), 5, out, ["item_id"])
    assert rows()[1] == 6 and len(rows()) == 602
    folders = {r.path.split("/_bucket=")[0] for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(out).select("path").collect()}
    assert len(folders) <= 3  # nothing older than the table before this one


def test_failed_batch_leaves_the_table(spark, monkeypatch):
    out = shared_path(spark, "target")
    batch = lambda rows: spark.createDataFrame(rows, "item_id long, label int")
    upserts.upsert(batch([(1, 1), (2, 2)]), 0, out, ["item_id"])
    with monkeypatch.context() as broken:
        broken.setattr(upserts, "replace_text", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            upserts.upsert(batch([(1, 5)]), 1, out, ["item_id"])
    assert sorted(map(tuple, upserts.read_target(spark, out).collect())) == [(1, 1), (2, 2)]
    upserts.upsert(batch([(1, 5)]), 1, out, ["item_id"])
    assert sorted(map(tuple, upserts.read_target(spark, out).collect())) == [(1, 5), (2, 2)]


def test_stream_goes_on_with_the_saved_model(spark, sf, files):
    """Stopped after some batches, the model read from disk, continued: equal to one run."""
    batch = prep.compile_annotations(V.event_annotations(V.table(spark, sf, "events")))
    model = scoring.point_model(M.item_resp_vb(batch, batch.select("item_id").distinct(), 5, Priors(), 1))
    saved, out, source = shared_path(spark, "model"), shared_path(spark, "score"), shared_path(spark, "arriving")
    save_model(spark, model, saved)
    events, schema = V.table(spark, sf, "events").orderBy("ts", "event_id").collect(), files[1]
    raw = lambda: V.event_annotations(spark.readStream.schema(schema).parquet(source)).withColumn("ts", F.col("ts").cast("timestamp"))
    for part in (events[:500], events[500:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream.stream_score(raw(), load_model(spark, saved), out, f"{out}-state").awaitTermination()
    got = {r["item_id"]: r["p"] for r in stream.current_scores(spark, out, load_model(spark, saved)).collect()}
    want = {r["item_id"]: r["p"] for r in scoring.score_items(batch, model).collect()}
    assert set(got) == set(want) and all(got[i] == pytest.approx(want[i], abs=1e-9) for i in want)


def test_models_are_saved_in_versions(spark, stub):
    fit = M.mom_resp_vb(stub["annotations"], stub["features"], stub["items"], 3, Priors(), 1)
    model, path = scoring.point_model(fit), shared_path(spark, "model")
    with pytest.raises(FileNotFoundError):
        load_model(spark, path)
    first, before = save_model(spark, model, path), model.log_theta
    model.log_theta = [v - 1.0 for v in model.log_theta]
    save_model(spark, model, path)
    old, new = load_model(spark, path, first), load_model(spark, path)
    assert new.log_theta == model.log_theta and old.log_theta == before
    for table in ("labels", "words"):
        assert sorted(map(tuple, getattr(new, table).collect())) == sorted(map(tuple, getattr(model, table).collect()))
    save_model(spark, model, path)
    with pytest.raises(FileNotFoundError):
        load_model(spark, path, first)
    scored = lambda m: {r["item_id"]: r["p"] for r in scoring.score_items(stub["annotations"], m, stub["items"], stub["features"]).collect()}
    assert scored(load_model(spark, path)) == scored(model)


@pytest.mark.parametrize("wide", [False, True])
def test_stream_score_over_batches(spark, sf, files, wide, monkeypatch):
    """The same rows from a broadcast model and from one joined by split keys."""
    batch = prep.compile_annotations(V.event_annotations(V.table(spark, sf, "events")))
    model = scoring.point_model(M.item_resp_vb(batch, batch.select("item_id").distinct(), 5, Priors(), 1))
    if wide:
        monkeypatch.setattr("labelmesh.operators.joins.fits_broadcast", lambda rows, size: False)
        soft = batch.groupBy("annotator_id", "label").agg(F.array(F.sum("n").cast("double"), *[F.lit(0.0)] * 4).alias("c"))
        model.spread = scoring.training_spread(soft, 5, 2)
        assert model.spread.hot is not None
    out = shared_path(spark, "score")
    stream.stream_score(arriving(spark, files), model, out, f"{out}-state").awaitTermination()
    got = {r["item_id"]: r["p"] for r in stream.current_scores(spark, out, model).collect()}
    want = {r["item_id"]: r["p"] for r in scoring.score_items(batch, model).collect()}
    assert set(got) == set(want) and all(got[i] == pytest.approx(want[i], abs=1e-9) for i in want)


def test_late_rows_are_dropped(spark):
    path = shared_path(spark, "late")
    schema = "item_id bigint, annotator_id int, label int, ts timestamp"
    for times in (["2024-01-01 01:00:00", "2024-01-01 02:00:00"], ["2024-01-05 00:00:00"], ["2024-01-06 00:00:00"],
                  ["2024-01-01 03:00:00"], ["2024-01-09 00:00:00"]):
        rows = spark.createDataFrame([(1, 0, 1, t) for t in times], "item_id bigint, annotator_id int, label int, ts string")
        rows.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(path)
    out = shared_path(spark, "windows")
    activity = stream.windowed_activity(source, 2, "1 day", "1 hour")
    stream.write_windows(activity, out, f"{out}-state").awaitTermination()
    got = sorted((str(r["start"].date()), r["n"], r["share"]) for r in spark.read.parquet(out).collect())
    assert got == [("2024-01-01", 2, [0.0, 1.0]), ("2024-01-05", 1, [0.0, 1.0]), ("2024-01-06", 1, [0.0, 1.0])]
