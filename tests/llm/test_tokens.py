"""Token counts, chat formatting, token files and packing against the libraries themselves."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from awkward import TEXTS, documents, empty
from labelmesh.llm import chat, grammar, language, packing, queries, token_counts, tokens
from labelmesh.llm.tokens import AddedBpe, ByteBpe, vocabulary

BYTES = vocabulary("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(BYTES)
    out.encode_special_tokens = True
    return out


@pytest.fixture(scope="module")
def pieces():
    return token_counts.PieceBpe(open(vocabulary("piece_bpe_32k.model"), "rb").read())


def ids_of(tokenizer, text, end):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, end], dtype="<u4")


def crc(ids):
    return zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())


def random_text(seed):
    r = random.Random(seed)
    parts = ["the", "straße", " ", "  ", "\n", "日本語", "①", "\t", "x" * 9, "é", "12", "▁", "</s>", "!?", " ", "'ll", "\x85", "\x1c"]
    return "".join(r.choice(parts) for _ in range(r.randrange(1, 400)))


def random_words(seed):
    r = random.Random(seed)
    parts = ["the", "éa", "'s", "'", "ll", ".", "\n", "12", "²", "ǅ", "ª", "#$", "ok", "\xad", "日", "_", "\t", "ʰ", "\u0301"]
    return " ".join("".join(r.choice(parts) for _ in range(r.randrange(1, 6))) for _ in range(60))


def test_spliced_chunks_equal_the_whole(pieces):
    for seed in range(60):
        text = random_text(seed)
        whole = pieces.model.encode(text)
        for chunk, overlap in ((7, 2), (40, 8), (100, 64)):
            got = [int(i) for part in pieces.splice(text, chunk, overlap) for i in part]
            assert got == whole, (seed, chunk, overlap)


def test_alignment_widens_until_the_end(pieces):
    text = "a" * 500 + " " + "ab" * 300
    assert [int(i) for part in pieces.splice(text, 32, 4) for i in part] == pieces.model.encode(text)


def test_stable_positions_are_never_inside_a_token(pieces):
    for seed in range(30):
        text = random_text(seed)
        _, begin, end = pieces._spans(text)
        for at in range(1, len(text)):
            byte = len(text[:at].encode())
            if pieces.stable(text, at):
                assert not ((begin < byte) & (end > byte)).any()


def test_counts_of_awkward_rows(spark, pieces):
    docs = documents(spark)
    got = Counter(tuple(r) for r in token_counts.token_counts(docs, chunk=50, overlap=4, limit=100).collect())
    want = Counter()
    for r in docs.collect():
        n = len(pieces.model.encode(r.text or ""))
        want[(r.doc_id, len((r.text or "").encode()), n, n > 100)] += 1
    assert got == want
    assert token_counts.token_counts(empty(spark)).count() == 0


def test_op1_over_the_table(spark, sf, pieces):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.QUERIES["op1_token_counts"](spark, sf).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in got} == {
        k: (len((t or "").encode()), len(pieces.model.encode(t or ""))) for k, t in texts.items()}


def test_words_encode_like_the_whole(tokenizer):
    bpe = ByteBpe(open(BYTES, "rb").read())
    for text in [*TEXTS, *map(random_text, range(200)), *map(random_words, range(300))]:
        got = np.frombuffer(bpe.encode(text), dtype="<u4").tolist()
        assert got == tokenizer.encode(text or "", add_special_tokens=False).ids, text


def odd_text(seed):
    r = random.Random(seed)
    parts = ["a", "B", "é", "ß", "×", "«", "ɏ", "ɐ", "\u0300", "я", "日", "。", "🙂", "𝒳", "1", "²", "Ⅷ", "'", "'ll", " ", "  ", "\n", "\t", "\x1c",
             "\x85", "\xa0", "\u3000", ".", "-", "_", "\x7f", "\x00", "\xad", "µ", "Ġ", "Ċ", "<|endoftext|>", "ी", "ह"]
    return "".join(r.choice(parts) for _ in range(r.randrange(0, 60)))


@pytest.mark.parametrize("block, memo, call", [(1 << 20, 150_000, 1000), (40, 5, 2)])
def test_columns_encode_like_their_texts(monkeypatch, block, memo, call):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "BLOCK", block)
    monkeypatch.setattr(tokens, "MEMO_UNITS", memo)
    monkeypatch.setattr(tokens, "CALL_RUNS", call)
    texts = [None, *TEXTS, *map(random_text, range(100)), *map(random_words, range(100)), *map(odd_text, range(1500)), ""]
    for kind, special in ((AddedBpe, False), (ByteBpe, True)):
        bpe, whole = kind(open(BYTES, "rb").read()), Tokenizer.from_file(BYTES)
        whole.encode_special_tokens = special
        want = [[*whole.encode(text or "", add_special_tokens=False).ids, 2] for text in texts]
        for some in (slice(None), slice(7, 400), slice(0, 1), slice(0, 0)):  # the second time from memory
            ids, counts = bpe.encode_all(pa.array(texts, pa.string())[some], 2)
            assert counts.tolist() == list(map(len, want[some]))
            assert ids.tolist() == [i for found in want[some] for i in found]


def test_the_library_sees_a_unit_once(monkeypatch):
    bpe, asked = ByteBpe(open(BYTES, "rb").read()), []
    learned = bpe._learned
    monkeypatch.setattr(bpe, "_learned", lambda units: (asked.extend(units), learned(units))[1])
    texts = pa.array(["so many, many. (many) many\nmany", "many; so: many, so", None])
    for _ in range(2):
        bpe.encode_all(texts)
    assert sorted(asked) == sorted(["so", " many", ",", ".", " (", "many", ")", "\n", ";", " so", ":"])


def test_added_tokens_need_no_second_tokenizer():
    from tokenizers import Tokenizer

    bpe, whole = AddedBpe(open(BYTES, "rb").read()), Tokenizer.from_file(BYTES)
    special = next(t.content for t in whole.get_added_tokens_decoder().values())
    for text in [f"a {special} b", *TEXTS, f"{special}{special}", special[:-1], *map(random_text, range(50))]:
        assert np.frombuffer(bpe.encode(text), dtype="<u4").tolist() == whole.encode(text or "", add_special_tokens=False).ids, text
        assert bpe.tokenizer.encode_special_tokens
    assert sum(isinstance(value, Tokenizer) for value in vars(bpe).values()) == 1


def test_stages_without_an_encoder_free_those_of_others(monkeypatch):
    monkeypatch.setattr(tokens, "_workers", {})
    blob = open(BYTES, "rb").read()
    assert tokens.once(ByteBpe, blob) is tokens.once(ByteBpe, blob)

    class Rows:
        schema = packing.T.StructType([])
        select = lambda self, *columns: self
        mapInArrow = lambda self, run, schema: run

    assert list(language._counted(Rows(), [])([])) == [] and not tokens._workers


def test_escapes_round_trip():
    for seed in range(200):
        r = random.Random(seed)
        text = "".join(r.choice(["\\", "#", "##", "###", "</turn>", "</", "turn>", ": ", "a", "\n"]) for _ in range(20))
        for role in (True, False):
            escaped = chat.escape(text, role)
            assert chat.unescape(escaped) == text
            plain = chat.re.sub(r"\\.", "\0", escaped, flags=chat.re.S)
            assert not any(mark in plain for mark in ("###", "</turn>", ": " if role else "###"))


def test_chat_of_awkward_rows(spark):
    rows = [(i // 4, i % 4 if i % 5 else None, ["user", "assistant", None, "a: b### \\", "assistant"][i % 5], t) for i, t in enumerate(TEXTS)]
    rows += [(None, 1, "assistant", "x"), (None, 0, "user", "y"), (0, 9, "assistant", "same"), (0, 9, "assistant", "same")]
    turns = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, ids string, _turn int")
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(turns)).collect()}
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((-1 if turn is None else turn, role or "", text or ""))
    assert set(got) == set(groups)
    for conv, said in groups.items():
        r, said = got[conv], sorted(said, key=lambda x: x[0])
        assert r.n_turns == len(said)
        assert r.loss_chars == sum(len(t) for _, role, t in said if role == "assistant")
        assert r.formatted_chars == sum(len(f"### {chat.escape(a, True)}: {chat.escape(b)}</turn>\n") for _, a, b in said)
        if len({t for t, _, _ in said}) == len(said) or conv == 0:
            assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in said).encode()).hexdigest()
            assert r.loss_sha256 == hashlib.sha256("".join(b for _, a, b in said if a == "assistant").encode()).hexdigest()
    assert chat.read_back(chat.format_turns(turns.limit(0))).count() == 0


def test_grammar_round_trip_and_random_access():
    r = np.random.default_rng(3)
    for n, kinds in ((0, 5), (1, 5), (2, 1), (5000, 1), (5000, 3), (20000, 300), (3000, 60000)):
        ids = r.integers(0, kinds, n).astype("<u4")
        g = grammar.compress(ids, 60000, rounds=8, least=3)
        again = grammar.unpack(grammar._pack(g))
        assert (again.expand(again.symbols) == ids).all()
        for a, b in r.integers(0, n + 1, (20, 2)):
            a, b = sorted((int(a), int(b)))
            assert (again.span(a, b - a) == ids[a:b]).all()
        if n == 5000:
            assert len(g.symbols) < n / 2
        for rule, length in zip(g.rules, g.lengths):
            assert length == len(again.expand(np.array([g.base + int(np.flatnonzero((g.rules == rule).all(1))[0])])))


def plain_rounds(ids, base, least):
    """Re-Pair in rounds, every pair counted anew in each: rules, and what is left of the ids."""
    symbols, rules = ids.tolist(), []
    while True:
        counts = Counter(zip(symbols, symbols[1:]))
        lefts, rights, chosen = set(), set(), {}
        for pair, n in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
            if n < least:
                break
            a, b = pair
            if a in rights or b in lefts or a == b and (a in lefts or b in rights):
                continue
            lefts.add(a)
            rights.add(b)
            chosen[pair] = base + len(rules)
            rules.append(pair)
        if not chosen:
            return rules, symbols
        out, i = [], 0
        while i < len(symbols):
            name = chosen.get(tuple(symbols[i:i + 2]))
            out.append(symbols[i] if name is None else name)
            i += 1 if name is None else 2
        symbols = out


def test_kept_counts_equal_counting_everything_again(monkeypatch):
    monkeypatch.setattr(grammar, "SLOTS", 1 << 24)  # no two pairs in one place, as in the plain version
    r = np.random.default_rng(12)
    for n, kinds, narrow in ((400, 3, 1 << 16), (3000, 40, 1 << 16), (3000, 40, 1), (2000, 500, 30)):
        monkeypatch.setattr(grammar, "NARROW", narrow)
        ids = r.integers(0, kinds, n).astype("<u4")
        g = grammar.compress(ids, kinds, least=3)
        rules, symbols = plain_rounds(ids, kinds, 3)
        assert g.rules.tolist() == [list(x) for x in rules] and g.symbols.tolist() == symbols


def test_later_rounds_look_at_changed_places_only(monkeypatch):
    looked, slot = [], grammar._slot
    monkeypatch.setattr(grammar, "_slot", lambda left, right: (looked.append(len(left)), slot(left, right))[1])
    ids = np.concatenate((np.arange(40000), np.tile(np.arange(40000, 40064), 10))).astype("<u4")
    g = grammar.compress(ids, 50257)
    assert (g.expand(g.symbols) == ids).all() and len(g.levels) > 3
    assert sum(looked) < 1.2 * len(ids)


def test_span_expands_what_it_covers_only(monkeypatch):
    r = np.random.default_rng(4)
    ids = np.tile(r.integers(0, 900, 5000), 6).astype("<u4")
    g = grammar.compress(ids, 900)
    monkeypatch.setattr(grammar.Grammar, "_expansions", lambda self: 1 / 0)
    for a in r.integers(0, len(ids) - 70, 50).tolist():
        assert (g.span(a, 70) == ids[a:a + 70]).all()
    assert (g.span(0, len(ids)) == ids).all() and len(g.span(7, 0)) == 0


def test_no_frequent_pair_is_left():
    """With the values that op3 uses: copies, symbols past 16 bits, and pairs that meet in the lookup table."""
    r = np.random.default_rng(8)
    copies = np.tile(r.integers(0, 50257, 3000), 40)
    wide = r.permutation(np.repeat(np.arange(20000), 6))  # more frequent pairs than 16 bits have symbols for
    for ids in (copies, np.stack((2 * wide, 2 * wide + 1), axis=1).ravel()):
        g = grammar.compress(ids.astype("<u4"), 50257)
        _, counts = np.unique((g.symbols[:-1] << 32) | g.symbols[1:], return_counts=True)
        assert counts.max() < grammar.LEAST
        again = grammar.unpack(grammar._pack(g))
        assert (again.expand(again.symbols) == ids).all()
        assert len(g.symbols) <= len(ids) / 2


@pytest.mark.parametrize("shard", [1, 300, 1 << 19])
def test_token_files_of_awkward_rows(spark, tokenizer, tmp_path, shard):
    docs = documents(spark)
    grammar.write_token_files(docs, str(tmp_path / "f"), shard_tokens=shard, least=2)
    got = sorted((tuple(r) for r in grammar.document_checksums(grammar.read_token_files(spark, str(tmp_path / "f"))).collect()), key=lambda r: r[1])
    start = 0
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert [r[0] for r in got] == [r.doc_id for r in rows]
    for doc, begin, n, _ in got:
        assert begin == start
        start += n
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((g[0], g[2], g[3]) for g in got), key=key) == sorted(
        ((r.doc_id, len(i), crc(i)) for r in rows for i in [ids_of(tokenizer, r.text, 2)]), key=key)


def test_token_files_of_an_empty_table(spark, tmp_path):
    grammar.write_token_files(empty(spark), str(tmp_path / "f"))
    assert grammar.document_checksums(grammar.read_token_files(spark, str(tmp_path / "f"))).count() == 0


def test_op3_over_the_table(spark, sf, tokenizer):
    got = sorted((tuple(r) for r in queries.QUERIES["op3_token_files"](spark, sf).collect()))
    start = 0
    for (doc, begin, n, code), r in zip(got, sorted(spark.read.parquet(f"{sf}/documents.parquet").collect(), key=lambda r: r.doc_id), strict=True):
        ids = ids_of(tokenizer, r.text, 2)
        assert (doc, begin, n, code) == (r.doc_id, start, len(ids), crc(ids))
        start += n


def test_op3_and_op6_follow_the_plain_call(spark, tmp_path):
    """Strings of added tokens inside a text give these tokens, as an unchanged tokenizer does."""
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(BYTES)
    docs = documents(spark).withColumn("doc_id", F.monotonically_increasing_id()).coalesce(1)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = sorted(spark.read.parquet(f"{tmp_path}/documents.parquet").collect(), key=lambda r: r.doc_id)
    assert any(50256 in ids_of(plain, r.text, 2)[:-1] for r in rows)
    got = sorted(tuple(r) for r in queries.QUERIES["op3_token_files"](spark, str(tmp_path)).collect())
    start = 0
    for (doc, begin, n, code), r in zip(got, rows, strict=True):
        ids = ids_of(plain, r.text, 2)
        assert (doc, begin, n, code) == (r.doc_id, start, len(ids), crc(ids))
        start += n
    check_packing(queries.QUERIES["op6_pack_sequences"](spark, str(tmp_path)).collect(), rows, plain, 1024)


def check_packing(rows, docs, tokenizer, length):
    """Every id in one piece, sequences gapless and not too long; returns the share of padding."""
    want = Counter()
    for r in docs:
        ids = ids_of(tokenizer, r.text, 0)
        for at in range(0, len(ids), length):
            want[(r.doc_id, at, len(ids[at:at + length]), crc(ids[at:at + length]), len(ids))] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
    padded = filled = 0
    for members in sequences.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length and {r.sequence_tokens for r in members} == {at}
        padded += members[0].padded_length
        filled += at
    assert sorted(sequences) == list(range(len(sequences)))
    return 1 - filled / max(padded, 1)


def test_packing_awkward_rows(spark, tokenizer):
    for length in (1024, 64, 7):
        docs = documents(spark).repartition(3)
        check_packing(packing.pack_documents(docs, length=length).collect(), documents(spark).collect(), tokenizer, length)
    assert packing.pack_documents(empty(spark)).count() == 0


def test_op6_over_the_table(spark, sf, tokenizer):
    rows = queries.QUERIES["op6_pack_sequences"](spark, sf).collect()
    assert check_packing(rows, spark.read.parquet(f"{sf}/documents.parquet").collect(), tokenizer, 1024) < 0.02


def test_patterns_place_every_piece():
    r = random.Random(5)
    for _ in range(50):
        histogram = {r.randrange(1, 1024): r.randrange(1, 1000) for _ in range(r.randrange(1, 200))}
        patterns = packing.shortest_pack_first(histogram)
        placed = Counter()
        for pattern, count in patterns:
            assert sum(pattern) <= 1024
            for size in pattern:
                placed[size] += count
        assert placed == Counter(histogram)
        assert len(patterns) <= 2 * len(histogram)
