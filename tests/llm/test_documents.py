"""Mixing, quality, language, toxicity, near copies, embeddings and the pipeline against plain versions."""

import binascii
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from awkward import TEXTS, documents, empty
from labelmesh.llm import divergence, jaccard, language, mixing, queries, subspace, toxicity
from labelmesh.llm.automata import best_path, compose
from oracle import compare
from test_tokens import check_packing, tokenizer  # noqa: F401

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, sf, duck, name):
    assert compare(queries.QUERIES[name](spark, sf), duck, queries.ORACLES[name]) is None


def components_of(nodes, links):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_mixing_awkward_rows(spark):
    docs = documents(spark)
    rows = mixing.mix_documents(docs).collect()
    assert len(rows) == docs.count()
    by_source = defaultdict(list)
    for r in docs.collect():
        by_source[r.source].append(len(WORD.findall(r.text or "")))
    assert Counter(r.size for r in rows) == Counter(n for sizes in by_source.values() for n in sizes)
    assert math.isclose(sum({r.source_size: r.target for r in rows}.values()), 1.5 * sum(r.size for r in rows))
    assert all(0 <= r.taken <= 2 * r.size and r.target <= 2 * r.source_size for r in rows)
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mixing.mix_documents(docs.repartition(5)).collect()), key=repr)
    assert mixing.mix_documents(empty(spark)).count() == 0
    copies = mixing.repeat_documents(docs)
    assert copies.columns == docs.columns and mixing.repeat_documents(empty(spark)).count() == 0


@pytest.mark.parametrize("repeat", [100_000, 7])
def test_mixing_meets_targets_with_a_hot_key(spark, monkeypatch, repeat):
    """A third of the rows without an id, a third equal in all columns: each source's words still come near its target."""
    monkeypatch.setattr(mixing, "REPEAT", repeat)
    r = random.Random(3)
    text = lambda: " ".join(r.choice("abcdefgh") * r.randint(1, 9) for _ in range(r.randint(1, 12)))
    rows = [(i, text(), "abc"[i % 3], i) for i in range(60)] + [(None, text(), "abc"[i % 3], i) for i in range(60)]
    rows += [(7, "one two three four", "a", 0)] * 40 + [(8, "five words are in here", "b", i % 2) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, more int").repartition(4)
    got = mixing.mix_documents(docs).collect()
    assert Counter((x.doc_id, x.size) for x in got) == Counter((doc, len(t.split())) for doc, t, *_ in rows)
    assert all(x.taken <= 2 * x.size for x in got)
    taken, target = defaultdict(int), {}
    for x in got:  # sources have different sizes here, so their size names them
        taken[x.source_size] += x.taken
        target[x.source_size] = x.target
    assert len(target) == 3 and all(abs(taken[n] - target[n]) <= 12 for n in target)
    copies = mixing.repeat_documents(docs).collect()
    assert sum(len(x.text.split()) for x in copies) == sum(taken.values())
    by_row = Counter(map(tuple, copies))
    allowed = Counter(rows)
    assert all(n <= 2 * allowed[row] for row, n in by_row.items())
    assert Counter((x.doc_id, len(x.text.split())) for x in copies) == Counter(
        (x.doc_id, x.size) for x in got for _ in range(x.taken // x.size if x.size else 0))
    assert sorted(map(tuple, copies), key=repr) == sorted(map(tuple, mixing.repeat_documents(docs.repartition(3)).collect()), key=repr)


def plain_quality(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 8)}
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered),
            len(words) < 20 or 100 * len(covered) > 30 * len(words))


def test_quality_counts(spark, sf):
    for docs in (documents(spark), spark.read.parquet(f"{sf}/documents.parquet")):
        got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in divergence.quality(docs).collect())
        assert got == Counter((r.doc_id, *plain_quality(r.text)) for r in docs.collect())
    assert divergence.quality(empty(spark)).count() == 0


def test_distance_is_jensen_shannon(spark):
    from pyspark.sql import functions as F

    def plain(p, q):
        part = lambda a, m: a * math.log2(a / m) if a else 0.0
        return math.sqrt(sum(part(a, (a + b) / 2) + part(b, (a + b) / 2) for a, b in zip(p, q)) / 2)

    rows = [([0.5, 0.5, 0.0], [0.0, 0.5, 0.5]), ([1.0, 0.0], [0.0, 1.0]), ([0.25, 0.75], [0.25, 0.75])]
    got = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, p array<double>, q array<double>").select(
        "i", divergence.distance(F.col("p"), F.col("q")).alias("d")).collect()
    for r in got:
        assert math.isclose(r.d, plain(*rows[r.i]), abs_tol=1e-9)


def test_quality_keeps_clean_rows_and_drops_strange_ones(spark):
    r = random.Random(2)
    prose = lambda: " ".join(r.choice(["the", "of", "and", "house", "river", "garden", "is", "to", "stone", "light", "walks"]) for _ in range(80)) + "."
    junk = " ".join("".join(r.choice("#$%&*<>|") for _ in range(6)) for _ in range(80))
    docs = spark.createDataFrame([(i, prose(), "en") for i in range(40)] + [(99, junk, "en")], "doc_id long, text string, lang string")
    kept = {r.doc_id: r.kept for r in divergence.quality(docs).collect()}
    assert not kept.pop(99) and all(kept.values())


def test_language(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = queries.QUERIES["op8_language_id"](spark, sf).collect()
    out = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and out
    assert sum(truth[r.doc_id] == r.lang_pred for r in out) / len(out) > 0.9
    model = language.fit(docs)
    strange = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    for r in language.identify_languages(strange.selectExpr("*", "'x' as lang_pred", "null as lang"), model).collect():
        text = TEXTS[r.doc_id] or ""
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text)) and 0 <= r.score <= 1
    assert language.identify_languages(empty(spark)).count() == 0
    unlabelled = documents(spark).drop("lang").selectExpr("*", "cast(null as string) as lang")
    assert {r.lang_pred for r in language.identify_languages(unlabelled).collect()} == {"und"}


STRANGERS = (
    "Съешь же ещё этих мягких французских булок, да выпей чаю. Широкая электрификация южных губерний даст мощный толчок подъёму.",
    "Zażółć gęślą jaźń, pchnąć w tę łódź jeża lub ośm skrzyń fig. Litwo, ojczyzno moja, ty jesteś jak zdrowie, ile cię trzeba cenić.",
    "zxqj vkwp bfgh qqzx wvkj xzqp kkjw ppzq vvxk jjqz wwkp zzxv qkjw pxzv kqwj zpxk vjqw xkpz qwvj kzxp vqjk pzwx",
    "日本語の文章はここにあります。漢字とひらがなとカタカナを使います。東京は大きな町です。私は毎日電車で学校に行きます。",
)


def test_strangers_of_any_length_are_rejected_and_clean_texts_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs)
    known = [r.text for r in docs.filter("lang IS NOT NULL AND text IS NOT NULL").collect()]
    for size in (25, 60, 110, 400, 3000):
        strange = [(text * 40)[:size] for text in STRANGERS]
        assert all(rejected for *_, rejected in model.predict(np.stack([language.count_ngrams(t) for t in strange]))), size
        clean = model.predict(np.stack([language.count_ngrams(t[:size]) for t in known]))
        assert sum(rejected for *_, rejected in clean) <= 0.01 * len(clean), size


def test_every_language_is_learned(spark):
    """More languages than 200, rare ones beside a common one and a row that repeats often."""
    r = random.Random(9)
    words = {i: ["".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(5)] for i in range(230)}
    rows = [(1000 * i + n, " ".join(r.choice(words[i]) for _ in range(60)), f"l{i:03}") for i in range(230) for n in range(30 if i == 0 else 4)]
    rows += [(None, rows[0][1], "l000")] * 4000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs)
    used = {lang for key, _, lang in rows if key is not None and binascii.crc32(str(key).encode()) % 3 != 1}
    assert len(used) > 220 and set(model.languages) == used
    got = model.predict(np.stack([language.count_ngrams(text) for _, text, _ in rows[:949]]))
    assert all(g[0] == lang for g, (_, _, lang) in zip(got, rows) if lang in used)


def test_ngram_counts_do_not_depend_on_blocks(monkeypatch):
    text = "Ünïted  stätes, of the! 12 " * 50
    whole = language.count_ngrams(text)
    monkeypatch.setattr(language, "BLOCK", 7)
    assert np.abs(language.count_ngrams(text) - whole).sum() <= 0.02 * whole.sum()


def all_paths(machine, symbols):
    """(weight, written) of every path that reads all symbols and ends in a final state."""
    found = [(0.0, machine.start, [])]
    for symbol in symbols:
        found = [(w + v, to, [*out, write]) for w, state, out in found for to, write, v in machine.arcs.get((state, symbol), ())]
    return [(w, out) for w, state, out in found if state in machine.final]


MACHINES = [toxicity.negation(), toxicity.reported(), toxicity.threat(), toxicity.target()]


def test_composition_equals_running_one_machine_after_the_other():
    r = random.Random(6)
    first = compose(MACHINES[0], MACHINES[1])
    for _ in range(300):
        symbols = [r.choice(toxicity.CLASSES) for _ in range(r.randint(0, 7))]
        one_by_one = [(0.0, symbols)]
        for machine in MACHINES:
            one_by_one = [(w + v, out) for w, read in one_by_one for v, out in all_paths(machine, read)]
        whole = all_paths(toxicity.MACHINE, symbols)
        assert Counter((w, tuple(out)) for w, out in whole) == Counter((w, tuple(out)) for w, out in one_by_one)
        assert Counter((w, tuple(out)) for w, out in all_paths(first, symbols)) == Counter(
            (w + v, tuple(out)) for w, read in all_paths(MACHINES[0], symbols) for v, out in all_paths(MACHINES[1], read))


@pytest.mark.parametrize("machine", [*MACHINES, toxicity.MACHINE])
def test_best_path_is_the_heaviest_of_all(machine):
    r = random.Random(7)
    alphabet = sorted(machine.alphabet)
    for _ in range(300):
        symbols = [r.choice(alphabet) for _ in range(r.randint(0, 8))]
        every = all_paths(machine, symbols)
        best = best_path(machine, symbols)
        assert best[0] == max(w for w, _ in every) and any(w == best[0] and out == best[1] for w, out in every)


def test_toxic_grammar_contexts():
    g = toxicity.Grammar({"idiot": 2.0}, {"trash": 1.0})
    assert g.matches("what an idiot") == [("plain", 2.0)]
    for clause, context in {
        "you are an idiot": "targeted", "an idiot like you": "targeted", "he is not an idiot": "negated", "he isn't an idiot": "negated",
        "don't call him an idiot": "negated", "they said idiot": "reported", "he claims that you are an idiot": "reported",
        "you are no idiot but they said hello": "negated", "they said hello but what an idiot": "plain", "idiot at last said the reporter": "plain",
    }.items():
        assert g.matches(clause) == [(context, 2.0)], clause
    for clause in ("kill the dragon", "they beat the team and you cheered", "the fire will burn you", "you kill me", "idiotic"):
        assert g.matches(clause) == [], clause
    for clause in ("i will kill you", "we are gonna destroy him", "killing you", "i will beat them", "ich werde dich töten you"):
        assert g.matches(clause) == [("threat", 2.0)], clause
    assert g.matches("i will not hurt you") == [("negated", 2.0)] and g.matches("she said i will kill you") == [("reported", 2.0)]
    assert g.matches("trashy") == [("plain", 1.0)]
    assert g.features("A clean text. Nothing here.") == [0.0] * len(toxicity.FEATURES)
    assert g.features("Idiot. " * 400_000)[0] > 10  # a very long text


def test_toxicity(spark, sf):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.QUERIES["op10_toxicity"](spark, sf).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    right = [r.predicted == labels[r.doc_id] for r in rows if r.held_out and r.doc_id in labels]
    assert len(right) > 10 and sum(right) / len(right) > 0.9
    docs = documents(spark)
    none = spark.createDataFrame([], "doc_id long, toxic int, text string")
    assert {r.predicted for r in toxicity.score_toxicity(docs, none).collect()} == {0}
    some = spark.createDataFrame([(None, 1, ""), (5, None, ""), (6, 1, ""), (6, 1, ""), (7, 0, "")], "doc_id long, toxic int, text string")
    assert toxicity.score_toxicity(docs, some).count() == docs.count()
    assert toxicity.score_toxicity(empty(spark), none).count() == 0


def test_learned_insults_equal_a_plain_choice(spark):
    """What tasks count is what one pass over all texts counts; many insults are learned, not only the first ones."""
    r = random.Random(11)
    bad = [f"bad{chr(97 + i // 26)}{chr(97 + i % 26)}zz" for i in range(60)]
    rows = [(i, int(i % 2), " ".join([r.choice(["stone", "river", "light"]) for _ in range(6)] + ([bad[i // 2 % 60]] if i % 2 else []))) for i in range(2400)]
    sample = spark.createDataFrame(rows, "nth long, y int, text string").repartition(4)
    got = toxicity._learn(sample)
    counts, where = defaultdict(lambda: [0, 0]), defaultdict(set)
    for nth, y, text in rows:
        for p in toxicity._patterns(text):
            counts[p][1 - y] += 1
            if y:
                where[p].add(nth)
    counts = {p: tuple(c) for p, c in counts.items()}
    weights = toxicity.candidates(counts, 1200, 1200)
    want = toxicity.choose_insults({p: where[p] for p in weights}, counts, weights, 1200, 1200)
    assert (got.words, got.stems) == (want.words, want.stems)
    assert all(got.insult(word) > 0 for word in bad) and not got.insult("stone")


def plain_shingles(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def near(rows):
    """{key: (set size, smallest key reachable)} by comparing everything."""
    sets = {k: plain_shingles(t) for k, t in rows}
    keys = [k for k in sets if sets[k]]
    links = [(a, b) for i, a in enumerate(keys) for b in keys[i + 1:]
             if 100 * min(len(sets[a]), len(sets[b])) >= 80 * max(len(sets[a]), len(sets[b])) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    roots = components_of(list(sets), links)
    return {k: (len(sets[k]), roots[k]) for k in sets}


def edited(seed, groups=12, members=12):
    """Groups of copies with more and more edits, short and long, and a passage that many share."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    passage, texts = [word() for _ in range(40)], []
    for g in range(groups):
        base = [word() for _ in range([1, 3, 5, 6, 9, 14, 30, 60, 120, 200, 300, 500][g % 12])] + (passage if g % 3 == 0 else [])
        for m in range(members):
            words = list(base)
            for _ in range(m // 2):
                i = r.randrange(len(words))
                words[i:i + 1] = [] if r.random() < 0.3 and len(words) > 1 else [word()]
            texts.append(r.choice([" ", "\n", "\t"]).join(words).upper() if m == 3 else " ".join(words))
    return texts


@pytest.mark.parametrize("hot", [0, 2, 20])
def test_near_copies_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(jaccard, "HOT", hot)
    monkeypatch.setattr(jaccard, "BLOCK_TOKENS", 700)
    monkeypatch.setattr(jaccard, "ROUNDS", 1 + hot // 10)
    rows = list(enumerate(edited(hot)))
    docs = spark.createDataFrame([(k, t, 1, 2) for k, t in rows], "doc_id long, text string, node int, n int").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_classes(docs).collect()}
    assert got == near(rows)


def test_near_copies_of_awkward_rows(spark):
    rows = jaccard.jaccard_classes(documents(spark)).collect()
    assert len(rows) == len(TEXTS) + 3
    want = near([(i, t) for i, t in enumerate(TEXTS) if i not in (2, 3, 4)])
    for r in rows:
        if r.doc_id is not None and r.doc_id not in (2, 3):
            assert (r.n_shingles, r.component_id) == want[r.doc_id]
    assert jaccard.jaccard_classes(empty(spark)).count() == 0


def test_every_linked_pair_of_sets_shares_a_signature():
    r = np.random.default_rng(4)
    plan = jaccard.Plan({n: 50 for n in range(1, 400)})
    for _ in range(300):
        n = int(r.integers(1, 300))
        a = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
        drop, add = int(r.integers(0, n // 9 + 1)), int(r.integers(0, n // 9 + 1))
        b = np.unique(np.concatenate((a[drop:], r.integers(0, 1 << 63, add, dtype=np.uint64))))
        if len(b) and jaccard.linked(a, b):
            (x, short_x), (y, short_y) = plan.signatures(a), plan.signatures(b)
            assert len(np.intersect1d(x, y)) or set(short_x) & set(short_y)


def test_embeddings_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(subspace, "CELL_ROWS", 40)
    monkeypatch.setattr(subspace, "PIECE", 30)
    monkeypatch.setattr(subspace, "VISITORS", 16)
    r = np.random.default_rng(7)
    base = r.normal(size=(60, 24))
    vectors = np.concatenate([base + r.normal(size=base.shape) * s for s in (0, 0, 0.05, 0.1, 0.2, 0.25)] + [base[:1] + r.normal(size=(150, 24)) * 0.15, base * 3])
    vectors[[3, 70]] *= [[1e-200], [1e200]]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    odd = [None, [], [0.0] * 24, [float("nan")] * 24, [None] * 24, [float("inf")] + [1.0] * 23, [1.0, 2.0]]
    rows += [(1000 + i, v) for i, v in enumerate(odd)] + [(5, rows[5][1])]
    docs = spark.createDataFrame([(*x, "clash", 1) for x in rows], "vec_id long, embedding array<double>, node string, weight int").repartition(3)
    got = defaultdict(list)
    for x in subspace.near_duplicates(docs).collect():
        got[x.vec_id].append((x.n_links, x.component_id, x.kept))
    good = [(k, np.array(v)) for k, v in rows if k < 1000]
    unit = np.array([v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()) for _, v in good])
    linked = unit @ unit.T >= 0.95
    np.fill_diagonal(linked, False)
    keys = [k for k, _ in good]
    roots = components_of(set(keys), [(keys[i], keys[j]) for i, j in zip(*np.nonzero(linked))])
    want = defaultdict(list)
    for i, k in enumerate(keys):
        want[k].append((int(linked[i].sum()), roots[k], roots[k] == k))
    for i in range(len(odd)):
        want[1000 + i].append((0, 1000 + i, True))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert subspace.near_duplicates(docs.limit(0)).count() == 0


def test_pipeline_equals_plain_stages(spark, sf, duck, tokenizer):  # noqa: F811
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = [r for r in docs.collect() if model.score(r.text) < 0.5]
    known = language.fit(spark.createDataFrame(rows, docs.schema))
    rows = [r for r in rows if not known.predict(language.count_ngrams(r.text or "")[None])[0][2]]
    classes = near([(r.doc_id, r.text) for r in rows])
    rows = [r for r in rows if classes[r.doc_id][1] == r.doc_id]
    kept = {r.doc_id: r for r in rows}
    import pandas as pd

    duck.register("kept_rows", pd.DataFrame({"doc_id": list(kept), "text": [r.text for r in rows], "source": [r.source for r in rows]}))
    taken = duck.execute(queries.ORACLES["op5_mix_sources"].replace("FROM documents", "FROM kept_rows")).fetchall()
    mixed = [kept[doc] for doc, size, _, _, n in taken for _ in range(n // size if size else 0)]
    words = {doc for doc, size, *_ in taken if size}
    got = [r for r in corpus_pipeline.run(spark, sf).collect()]
    assert {r.doc_id for r in got if r.doc_id in words} == {r.doc_id for r in mixed}
    mixed += [kept[k] for k, n in Counter(r.doc_id for r in got if r.doc_id not in words and r.start == 0).items() for _ in range(n)]
    check_packing(got, mixed, tokenizer, 1024)


def test_one_row_of_each_class_of_texts_stays(spark, sf):
    a, b, c = (" ".join(f"{letter}{i}" for i in range(40)) for letter in "abc")
    near_a, near_b, near_c = f"{a} more", f"{b} more", f"{c} more"
    rows = [(3, a, "x"), (7, near_a, "x"), (7, b, "x"), (9, near_b, "x"),  # clashing ids
            (None, c, "x"), (None, near_c, "x"), (None, a, "x"),  # near copies without ids, and one of a numbered row
            (5, "one text of five", "y"), (5, "one text of five", "x"), (5, "other words than those", "x"),
            (None, "no id here", None), (None, "no id here", None), (8, " ", "x"), (8, " ", "x"), (None, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _near string").repartition(3)
    got = corpus_pipeline.drop_near_copies(spark, docs, sf)
    assert got.columns == docs.columns
    got = Counter(map(tuple, got.collect()))
    kept_c = [t for t in (c, near_c) if (None, t, "x") in got]
    assert len(kept_c) == 1
    assert got == Counter([(3, a, "x"), (7, b, "x"), (None, kept_c[0], "x"), (5, "one text of five", "x"), (5, "other words than those", "x"),
                           (None, "no id here", None), (8, " ", "x"), (8, " ", "x"), (None, None, "x")])


def test_stages_take_awkward_rows(spark, sf):
    for docs in (documents(spark), empty(spark)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns, name
            out.count()
        corpus_pipeline.pack(spark, docs, sf).count()
