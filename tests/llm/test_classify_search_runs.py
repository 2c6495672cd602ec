"""Quality classifier, lexical search and periodic runs against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from awkward import TEXTS, documents, empty
from labelmesh.llm import boosting, lexical, periods, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


# quality classifier


def walk(forest, tree, row):
    at = forest.roots[tree]
    while forest.left[at] != at:
        at = forest.left[at] + (row[forest.feature[at]] > forest.threshold[at])
    return forest.value[at]


def test_flat_trees_equal_a_walk_down_each():
    r = np.random.default_rng(3)
    x = r.normal(size=(600, 7)).round(1)
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] * x[:, 5] > 0.1)).astype(float)
    forest = boosting.fit_forest(x, y, np.ones(len(y)), rounds=25)
    got = forest.margins(x)
    for row, margin in zip(x, got):
        assert math.isclose(margin, forest.bias + sum(walk(forest, t, row) for t in range(len(forest.roots))), abs_tol=1e-9)
    assert ((forest.scores(x) > 0.5) == (y == 1)).mean() > 0.95


def test_histogram_split_is_the_best_of_all():
    r = np.random.default_rng(5)
    for _ in range(20):
        x = r.integers(0, 6, size=(40, 4)).astype(float)
        g, h = r.normal(size=40), r.uniform(0.1, 1, size=40)
        sums = [np.stack([np.bincount(c.astype(int), v, minlength=6) for c in x.T]) for v in (g, h)]
        gain, feature, at = boosting.best_split(*sums, 1.0, 2.0)
        part = lambda rows: g[rows].sum() ** 2 / (h[rows].sum() + 1.0)
        plain = max((part(left) + part(~left) - part(left | ~left) for f in range(4) for b in range(6) for left in [x[:, f] <= b]
                     if h[left].sum() >= 2 and h[~left].sum() >= 2), default=0.0)
        left = x[:, feature] <= at
        assert math.isclose(gain, max(plain, 0.0), abs_tol=1e-9)
        if gain > 0:
            assert math.isclose(gain, part(left) + part(~left) - part(left | ~left), abs_tol=1e-9)


def test_statistics_do_not_depend_on_blocks(monkeypatch):
    text = "\n".join(f"Line {i % 5}, with $ym &bols and WORDS again again!\n" for i in range(300))
    whole = boosting.statistics(text)
    assert len(whole) == len(boosting.STATISTICS)
    monkeypatch.setattr(boosting, "TEXT_BLOCK", 50)
    assert np.allclose(boosting.statistics(text), whole)
    assert all(np.isfinite(boosting.statistics(t)).all() for t in [*TEXTS, "x" * 6_000_000])


def test_quality_classifier(spark, sf):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.QUERIES["op11_quality_classifier"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    right = [r.predicted == labels[r.doc_id] for r in rows if r.held_out and r.doc_id in labels]
    assert len(right) > 10 and sum(right) / len(right) > 0.9


def test_quality_classifier_of_awkward_rows(spark):
    docs = documents(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, text string")
    assert {r.predicted for r in boosting.score_quality(docs, none).collect()} == {0}
    ones = spark.createDataFrame([(i, 1, "") for i in range(12)], "doc_id long, quality int, score string")
    assert {r.predicted for r in boosting.score_quality(docs, ones).collect()} == {1}
    some = spark.createDataFrame([(None, 1, ""), (5, None, ""), (6, 1, ""), (6, 1, ""), (7, 0, ""), (8, 0, ""), (8, 1, "")], "doc_id long, quality int, text string")
    rows = boosting.score_quality(docs, some).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    by_text = {}
    for text, r in zip([r.text for r in docs.collect()], boosting.score_quality(docs.coalesce(1), some).collect()):
        assert by_text.setdefault(text or "", r.score) == r.score
    assert boosting.score_quality(empty(spark), none).count() == 0


# lexical search


def plain_search(docs, items, k=10):
    """{(item, text): [(rank, key, score)]} by scoring everything."""
    fold = lambda t: Counter(TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")))
    rows = [(key, fold(text)) for key, text in docs]
    rows = [(key, c, c.total()) for key, c in rows if c]
    n_docs, total = len(rows), sum(n for *_, n in rows)
    df = Counter(t for _, c, _ in rows for t in c)
    out = {}
    for item, text in set(items):
        terms, scored = fold(text), []
        for key, c, n in rows:
            m = 100 - 75 + 75 * n * n_docs // total
            score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, q in terms.items() if t in c)
            if score > 0:
                scored.append((-score, key is None, key))
        best = sorted(scored, key=lambda s: (s[0], s[1], s[2] or 0))[:k]
        out[item, text] = [(i + 1, key, -score) for i, (score, _, key) in enumerate(best)]
    return out


@pytest.mark.parametrize("shard,step", [(5, 1), (60, 2), (1 << 20, 8)])
def test_search_equals_scoring_everything(spark, monkeypatch, shard, step):
    monkeypatch.setattr(lexical, "SHARD_POSTINGS", shard)
    monkeypatch.setattr(lexical, "STEP", step)
    r = random.Random(shard)
    words = ["the", "of", "a", *(f"w{i}" for i in range(60)), "É1", "日本"]
    text = lambda n: " ".join(r.choice(words[:r.choice([3, 10, 65])]) for _ in range(n))
    docs = [(i, text(r.randint(0, 60))) for i in range(150)] + [(i, "the same words w1") for i in range(200, 230)] + [(None, "the same words w1"), (7, "THE W2-w2"), (7, None)]
    items = [(i, text(r.randint(0, 30))) for i in range(12)] + [(50, "w1 Words words"), (50, "w1 Words words"), (51, None), (52, "?!"), (None, "w3 w4"), (50, "w5")]
    table = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, item_id string").repartition(3)
    asked = spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, doc_id int")
    got = Counter((x.item_id, x.rank, x.doc_id, x.score) for x in lexical.search(table, asked).collect())
    assert got == Counter((item, *row) for (item, _), rows in plain_search(docs, items).items() for row in rows)


def test_search_reads_less_than_everything():
    """The stop bites: a rare term decides, and lists of common terms are left early."""
    r = random.Random(1)
    n = 4000
    counts = [Counter(["a"] * r.randint(1, 9) + ["b"] * r.randint(0, 9) + ["rare"] * (i % 400 == 0)) for i in range(n)]
    postings = sorted((t, i, c[w]) for i, c in enumerate(counts) for t, w in enumerate(("a", "b", "rare")) if c[w])
    terms, owners, tfs = (np.array(x) for x in zip(*postings))
    distinct, df = np.unique(terms, return_counts=True)
    shard = lexical.Shard(distinct, df, np.array([c.total() for c in counts]), owners, tfs, n, sum(c.total() for c in counts), np.array([10, 300, 6000]))
    best = lexical.Best(10)
    looked = lexical.best_positions(shard, list(range(n)), np.array([0, 1, 2]), np.array([1, 1, 1]), best)
    assert looked < n / 4 and {key % 400 for _, key in best.rows} == {0}


def test_search_in_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(lexical, "QUERY_BYTES", 20)
    monkeypatch.setattr(lexical, "TEXT_BLOCK", 16)
    docs = [(i, f"word{i % 7} and {'more ' * i}") for i in range(40)]
    items = [(i, f"word{i} more") for i in range(9)]
    got = Counter(tuple(x) for x in lexical.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id int, text string")).collect())
    assert got == Counter((item, rank, key, score) for (item, _), rows in plain_search(docs, items).items() for rank, key, score in rows)


def test_search_of_awkward_rows(spark):
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "item_id long, text string")
    docs = documents(spark)
    want = plain_search([(r.doc_id, r.text) for r in docs.collect()], [(i, t) for i, t in enumerate(TEXTS)])
    got = Counter(tuple(x) for x in lexical.search(docs, asked).collect())
    assert got == Counter((item, rank, key, score) for (item, _), rows in want.items() for rank, key, score in rows)
    assert lexical.search(empty(spark), asked).count() == 0
    none = lexical.search(docs, asked.limit(0))
    assert none.columns == ["item_id", "rank", "doc_id", "score"] and none.count() == 0


# periodic runs


def plain_runs(words):
    best = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                best.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((a, b - a, q) for (a, b), q in best.items())


def plain_row(key, text):
    words = WORD.findall(text or "")
    h, n = zlib.crc32(("" if key is None else str(key)).encode()), len(words)
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(words)
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    return (key, len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None,
            sha("".join(f"{a},{n},{q}\n" for a, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_transform_multiplies_polynomials():
    r = np.random.default_rng(2)
    for size in (2, 4, 16, 64):
        a, b = r.integers(0, periods.PRIME, size=(2, 3, size), dtype=np.uint64)
        assert (periods.transform_back(periods.transform(a)) == a).all()
        got = periods.transform_back(periods.transform(a) * periods.transform(b) % np.uint64(periods.PRIME))
        for x, y, z in zip(a.tolist(), b.tolist(), got.tolist()):
            assert z == [sum(x[i] * y[(k - i) % size] for i in range(size)) % periods.PRIME for k in range(size)]


def test_mismatch_is_the_sum_of_squared_differences():
    r = np.random.default_rng(4)
    for size in (1, 2, 8, 32):
        blocks, windows = r.integers(0, 1 << 20, size=(5, size)), r.integers(0, 1 << 20, size=(5, 2 * size))
        windows[0, size // 2:size // 2 + size] = blocks[0]
        want = [[int(((b - w[lag:lag + size]) ** 2).sum()) % periods.PRIME for lag in range(size)] for b, w in zip(blocks, windows)]
        assert periods.mismatch(blocks, windows).tolist() == want and want[0][size // 2] == 0


def repeating(r, longest=150):
    words = [str(r.randint(0, r.choice([1, 2, 50]))) for _ in range(r.randint(0, longest))]
    for _ in range(r.randint(0, 3)):
        unit = [str(r.randint(0, 3)) for _ in range(r.randint(1, 12))]
        at = r.randint(0, len(words))
        words[at:at] = (unit * 12)[:r.randint(1, 12 * len(unit))]
    return words


@pytest.mark.parametrize("many,probes,numbers", [(0, 2, 4), (64, 16, 1 << 19)])
def test_all_runs_are_found(monkeypatch, many, probes, numbers):
    for name, value in (("MANY", many), ("PROBES", probes), ("TRANSFORM", numbers)):
        monkeypatch.setattr(periods, name, value)
    r = random.Random(many)
    for _ in range(150):
        texts, names = [repeating(r) for _ in range(r.randint(1, 4))], periods.numbers()
        words = [periods.numbered(" ".join(t), names) for t in texts]
        bounds = np.concatenate(([0], np.cumsum([len(w) + 1 for w in words])))
        x = np.concatenate([np.append(w, len(names) + i) for i, w in enumerate(words)])
        got = [(a, b - a, q) for a, b, q in periods.find_runs(x, bounds).tolist()]
        assert got == [(low + a, n, q) for low, t in zip(bounds.tolist(), texts) for a, n, q in plain_runs(t)]


def test_periodic_runs_equal_plain_version(spark, sf, monkeypatch):
    r = random.Random(8)
    rows = [(i, " ".join(repeating(r, 60))) for i in range(300)] + [(None, "a b " * 9), (None, "a b " * 9)]
    table = spark.createDataFrame([(*x, 1, "clash") for x in rows], "doc_id long, text string, start int, period string").repartition(3)
    got = Counter(tuple(x) for x in periods.periodic_runs(table, periods.planted).collect())
    assert got == Counter(plain_row(*x) for x in rows)
    docs = [(x.doc_id, x.text) for x in spark.read.parquet(f"{sf}/documents.parquet").collect() if len(x.text or "") < 6000]
    some = {x.doc_id: tuple(x) for x in queries.QUERIES["op13_periodic_runs"](spark, sf).collect()}
    assert all(some[key] == plain_row(key, text) for key, text in docs)


def test_periodic_runs_of_awkward_rows(spark, monkeypatch):
    docs = documents(spark)
    got = Counter(tuple(x) for x in periods.periodic_runs(docs, periods.planted).collect())
    assert got == Counter(plain_row(x.doc_id, x.text) for x in docs.collect())
    assert periods.periodic_runs(empty(spark)).count() == 0
    unit = " ".join(f"w{i}" for i in range(3000))
    monkeypatch.setattr(periods, "TEXT_BLOCK", 5000)  # not shipped to workers: the text is split here
    names = periods.numbers()
    words = periods.numbered(f"x {unit} " * 1 + f"{unit} " * 250 + "y", names)
    runs = periods.find_runs(np.append(words, len(names)), np.array([0, len(words) + 1]))
    assert runs.tolist() == [[1, 1 + 251 * 3000, 3000]]
