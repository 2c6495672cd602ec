"""Closed-form values on small tables."""

import math

import pytest
from pyspark.sql import functions as F

from labelmesh.functions import special
from labelmesh.models import scoring, topics
from labelmesh.operators import align, counts, prep, votes
from labelmesh.priors import Priors
from labelmesh.sources import annotations as records, state

P = Priors(b_theta=1 / 3, b_mu=0.75, c_mu=2.0, b_gamma=0.75, c_gamma=2.0, b_phi=1.23)
DIAG, OFF = 1.5, 0.25


def weighted(stub, column):
    return stub["state"].select("item_id", F.col(column).alias("label"), F.lit(1.0).alias("weight"))


def test_priors_must_be_positive():
    with pytest.raises(ValueError):
        Priors(b_phi=0.0)


def test_special_functions(spark):
    one = spark.createDataFrame([(1.0, 0.5)], "a double, b double")
    row = one.select(
        F.expr(special.digamma("a")), F.expr(special.digamma("b")), F.expr(special.lgamma("b")),
        F.expr(special.log_rising("a", "4")), F.expr(special.lgamma_ratio("b", "2.5D")),
    ).first()
    euler = 0.5772156649015329
    assert row[0] == pytest.approx(-euler, abs=1e-10)
    assert row[1] == pytest.approx(-euler - 2 * math.log(2), abs=1e-10)
    assert row[2] == pytest.approx(0.5 * math.log(math.pi), abs=1e-10)
    assert row[3] == pytest.approx(math.log(24), abs=1e-12)
    assert row[4] == pytest.approx(math.lgamma(3.0) - math.lgamma(0.5), abs=1e-10)
    assert special.digamma_value(0.5) == pytest.approx(row[1], abs=1e-12)


def test_log_rising_of_counts(spark):
    """Counts [0,10,1] with annotations [0,3,1]: ln10+ln11+ln12 + ln1 - (ln11+ln12+ln13+ln14)."""
    rows = spark.createDataFrame([(10.0, 3), (1.0, 1)], "c double, n int")
    up = rows.agg(F.sum(F.expr(special.log_rising("c", "n")))).first()[0]
    down = spark.createDataFrame([(11.0, 4)], "c double, n int").select(F.expr(special.log_rising("c", "n"))).first()[0]
    want = math.log(10) + math.log(11) + math.log(12) - sum(math.log(v) for v in (11, 12, 13, 14))
    assert up - down == pytest.approx(want, abs=1e-12)


def test_class_counts(stub):
    got = {r["label"]: r["log_count"] for r in counts.class_counts(weighted(stub, "y"), 3, P).collect()}
    assert got == pytest.approx({0: math.log(1 / 3 + 2), 1: math.log(1 / 3 + 2), 2: math.log(1 / 3 + 1)})


def test_vocab_counts(stub):
    table = counts.vocab_counts(stub["features"], weighted(stub, "m"), 3, P).collect()
    got = {(r["label"], r["feature"]): r["total"] - P.b_phi for r in table}
    want = [[1, 3, 5, 1, 2], [0, 1, 0, 4, 0], [0, 1, 0, 0, 1]]
    assert got == pytest.approx({(c, f): want[c][f] for c in range(3) for f in range(5)})


def test_machine_counts(stub):
    pairs = stub["state"].withColumn("weight", F.lit(1.0))
    got = {(r["truth"], r["m"]): r["total"] for r in counts.machine_counts(pairs, 3, P).collect()}
    want = [[DIAG + 2, OFF, OFF], [OFF + 1, DIAG, OFF + 1], [OFF, OFF + 1, DIAG]]
    assert got == pytest.approx({(a, b): want[a][b] for a in range(3) for b in range(3)})


def test_confusion_counts(stub):
    annotators = stub["annotations"].select("annotator_id").distinct()
    table = counts.confusion_counts(stub["annotations"], weighted(stub, "y"), annotators, 3, P).collect()
    got = {(r["annotator_id"], r["truth"], r["label"]): r["value"] for r in table}
    zero = [[DIAG + 1, OFF, OFF], [OFF + 2, DIAG, OFF], [OFF, OFF, DIAG + 1]]
    one = [[DIAG, OFF, OFF], [OFF + 1, DIAG + 2, OFF], [OFF, OFF + 1, DIAG]]
    want = {(j, a, b): m[a][b] for j, m in enumerate([zero, one]) for a in range(3) for b in range(3)}
    assert got == pytest.approx(want)


def test_definiteness(spark):
    cells = spark.createDataFrame([(0, 0, 0, 1.0), (0, 0, 1, 0.0), (1, 0, 0, 0.5), (1, 0, 1, 0.5), (2, 0, 0, 0.9)],
                                  "annotator_id int, truth int, label int, value double")
    got = {r[0]: r[1] for r in counts.definiteness(cells).collect()}
    assert got == pytest.approx({0: 0.0, 1: 0.5, 2: 0.01})


def test_marginal_mode(spark):
    sweeps = [[1, 5, 2, 3, 1], [1, 5, 2, 3, 1], [2, 1, 5, 2, 4]]
    rows = [(s, i, v) for s, sweep in enumerate(sweeps) for i, v in enumerate(sweep)]
    got = votes.marginal_mode(spark.createDataFrame(rows, "sweep int, item_id int, label int"))
    assert [r["label"] for r in got.orderBy("item_id").collect()] == [1, 5, 2, 3, 1]


def test_json_records_majority_and_baseline(spark, tmp_path):
    lines = []
    marks = {1: ["A:0", "B:1", "B:0"], 2: ["A:0", "B:1", "B:1"], 3: ["A:1", "B:0", "B:0"], 4: []}
    gold = {1: 0, 2: 1, 3: 0, 4: 0}
    data = {1: "alpha", 2: "beta", 3: "alpha", 4: "alpha"}
    for source, given in marks.items():
        lines.append(f'{{"batch":1,"data":"{data[source]}","source":{source},"label":"{gold[source]}","startTime":0,"endTime":1}}')
        for i, mark in enumerate(given):
            who, what = mark.split(":")
            lines.append(f'{{"batch":1,"source":{source},"annotation":"{what}","annotator":"{who}","startTime":{i},"endTime":{i + 1}}}')
    for order in (lines, lines[::-1]):
        path = tmp_path / f"records-{order[0] == lines[0]}"
        path.mkdir()
        (path / "a.json").write_text("\n".join(order))
        labels, events = records.read_annotations(spark, str(path))
        events, dictionary = records.index_labels(events, "annotation")
        assert sorted(map(tuple, dictionary.collect())) == [("0", 0), ("1", 1)]
        ann = prep.compile_annotations(events.withColumnRenamed("annotator", "annotator_id"))
        items = labels.select("item_id")
        bag = prep.bag_of_words(labels.withColumnRenamed("data", "text").select("item_id", "text"))
        out = scoring.naive_bayes_baseline(ann, bag, items, 2)
        assert {r["item_id"]: r["label"] for r in out.collect()} == {1: 0, 2: 1, 3: 0, 4: 0}


def test_text_folders(spark, tmp_path):
    for name, text in (("space", "From: me\nSubject: x\n\nOrbit orbit moon\nand star"), ("sport", "no header here"), ("mail", "To: you\r\n\r\nGoal\r\n\r\nmatch")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "1.txt").write_bytes(text.encode())
    assert records.read_documents(spark, str(tmp_path)).count() == 3
    got = {r["item_id"]: (r["gold"], r["text"]) for r in records.read_documents(spark, str(tmp_path)).collect()}
    assert got == {"space/1.txt": ("space", "Orbit orbit moon\nand star"), "sport/1.txt": ("sport", "no header here"), "mail/1.txt": ("mail", "Goal\r\n\r\nmatch")}


def test_label_dictionary_has_no_limit(spark):
    labels = [f"label {i:05}" for i in range(12000)]
    events = spark.createDataFrame([(i, labels[i % len(labels)]) for i in range(15000)] + [(-1, None)], "item_id long, mark string").repartition(3)
    indexed, dictionary = records.index_labels(events, "mark")
    assert {r.mark: r.label for r in dictionary.collect()} == {label: i for i, label in enumerate(labels)}
    got = {r.item_id: r.label for r in indexed.collect()}
    assert len(got) == 15001 and got[-1] is None and all(got[i] == i % len(labels) for i in range(15000))


def test_token_state_round_trip(spark, tmp_path):
    """Texts longer than a chunk, one without tokens, and a topic model that goes on from the saved state."""
    tokens = spark.createDataFrame([(i, pos, (i + pos) % 5) for i, n in ((1, 2500), (2, 3), (3, 1000)) for pos in range(n)], "item_id long, pos int, z int").repartition(5)
    items = spark.createDataFrame([(i, 0, None) for i in (1, 2, 3, 4)], "item_id long, label int, alternative int")
    chunks = state.token_chunks(tokens, 100)
    assert chunks.count() == 25 + 1 + 10
    want = sorted(map(tuple, tokens.collect()))
    assert sorted(map(tuple, state.topics_of_chunks(chunks).collect())) == want
    state.write_state(state.state_from_predictions(items, tokens=tokens), str(tmp_path / "s"))
    saved = state.read_state(spark, str(tmp_path / "s"))
    assert {r.item_id: r.z is None for r in saved.collect()} == {1: False, 2: False, 3: False, 4: True}
    assert sorted(map(tuple, state.topics_of_state(saved).collect())) == want
    words = tokens.select("item_id", "pos", F.concat(F.lit("w"), F.col("pos") % 7).alias("word"))
    marks = spark.createDataFrame([(1, 0, 1, 1), (2, 0, 0, 1)], "item_id long, annotator_id int, label int, n long")
    model = topics.TopicLabelModel.start(words, marks, items, 2, 5, topics=state.topics_of_state(saved))
    assert sorted((r.item_id, r.pos, r.z) for r in model.tokens.collect()) == want


def test_strict_checks(spark):
    many = spark.createDataFrame([(1, 7, 0, 2), (1, 8, 1, 2)], "item_id int, annotator_id int, label int, n bigint")
    assert votes.arbiter_vote(many, F.col("annotator_id") == 7, strict=False).first()["violation"]
    with pytest.raises(Exception, match="more than three"):
        votes.arbiter_vote(many, F.col("annotator_id") == 7).collect()
    items = spark.createDataFrame([(1,), (2,)], "item_id int")
    with pytest.raises(Exception, match="no saved label"):
        prep.attach_saved_labels(items, spark.createDataFrame([(1, 0)], "item_id int, y int")).collect()
    for bad in ("1.5", "classifier"):
        with pytest.raises(ValueError):
            prep.item_weights(items, many, bad)


def test_random_assignments_are_near_uniform(spark):
    items = spark.range(30_000).withColumnRenamed("id", "item_id")
    start = prep.uniform_assignment(items, 3, 1)
    shares = [r["count"] / 30_000 for r in start.groupBy("label").count().collect()]
    assert all(abs(s - 1 / 3) < 1e-2 for s in shares)
    same = start.withColumn("label", F.lit(0))
    changed = prep.perturb_labels(same, 4, 0.8, 2).filter("label <> 0").count() / 30_000
    assert abs(changed - 0.8 * 0.75) < 1e-2


def test_alignment_methods(spark):
    sharp, flat = [[0.0, 1.0], [1.0, 0.0]], [[0.6, 0.4], [0.4, 0.6]]
    rows = [(j, a, b, m[a][b]) for j, m in enumerate([sharp, flat, flat]) for a in range(2) for b in range(2)]
    conf = spark.createDataFrame(rows, "annotator_id int, truth int, label int, value double")
    assert align.class_map("max_gamma", 2, conf) == [1, 0]
    assert align.class_map("avg_gamma", 2, conf) == [1, 0]
    assert align.class_map("avg_gamma", 2, conf.filter("annotator_id > 0")) == [0, 1]
    assert align.class_map("none", 2) == [0, 1]
    assert sorted(align.class_map("rand", 5, seed=3)) == list(range(5))
    machine = spark.createDataFrame([(0, 0, 0.9), (0, 1, 0.1), (1, 0, 0.2), (1, 1, 0.8)], "truth int, m int, value double")
    assert align.machine_map(machine, [1, 0], 2) == [1, 0]
    with pytest.raises(ValueError):
        align.class_map("sideways", 2)


def test_best_assignment_is_optimal():
    import itertools
    import random

    rnd = random.Random(5)
    for _ in range(200):
        k = rnd.randint(1, 6)
        m = [[float(rnd.randint(0, 9)) for _ in range(k)] for _ in range(k)]
        got = align.best_assignment(m)
        best = max(sum(m[i][p[i]] for i in range(k)) for p in itertools.permutations(range(k)))
        assert sorted(got) == list(range(k)) and sum(m[i][got[i]] for i in range(k)) == best


def test_replay_of_a_hot_pair(spark):
    """Ranks of a pair cut into slices equal those of one window, ties in the first order column included."""
    rows = [(1, 1, (i * 7919) % 97, i) for i in range(500)] + [(2, i % 3, i % 5, i) for i in range(40)]
    events = spark.createDataFrame(rows, "item_id int, annotator_id int, ts int, event int")
    for at in ("ts", "date_add(DATE'2024-01-01', ts)", "cast(ts AS string)", "timestamp_seconds(ts)", "DATE'2024-01-01'"):
        shown = events.withColumn("ts", F.expr(at))
        plain = prep.nth_annotation(shown, ["ts", "event"]).collect()
        sliced = prep.nth_annotation(shown, ["ts", "event"], rows_per_split=50)
        assert sorted(map(tuple, sliced.collect())) == sorted(map(tuple, plain))
