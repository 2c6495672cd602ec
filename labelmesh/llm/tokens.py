"""Tokenizer vocabularies as broadcast values, and encoders that live once per Python worker."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import SparkSession

from labelmesh.llm.shipping import ship

#: Distinct units after whose arrival a worker forgets those that it has not met since the last time; longer ones are not kept.
MEMO_UNITS, UNIT_CHARS = 150_000, 64
#: bytes of texts that are encoded at once; longer texts are cut at a safe place after as many characters
BLOCK = 1 << 20
#: runs of letters that go through the library as one text
CALL_RUNS = 1000
#: A cut before a space is safe after one of these: none of them is white space under any definition.
_SAFE_CUT = re.compile(r"(?<=[\w!-~])(?= )")
_WORD = np.array([chr(code).isalnum() or chr(code) == "_" for code in range(1 << 16)])
# Letters up to U+024F, whose classes no version of Unicode changes.
_ASCII = "A-Za-z"
_LATIN = f"{_ASCII}\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_IS_LATIN = np.array([re.fullmatch(f"[{_LATIN}]", chr(code)) is not None for code in range(0x250)] + [False] * (0x10000 - 0x250))
# by byte: letters and all of longer characters, visible ASCII, white space
_LETTER = np.concatenate((_IS_LATIN[:128], np.ones(128, dtype=bool)))
_VISIBLE = np.isin(np.arange(256), np.arange(33, 127))
_BLANK = np.isin(np.arange(256), [*range(9, 14), *range(28, 33)])

_workers: dict[tuple, object] = {}


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def publish(spark: SparkSession, path: str) -> Broadcast:
    """The bytes of one vocabulary file (a few MB at most, whatever the data) for every task."""
    ship(spark)
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def once(kind: type, blob: bytes):
    """One ``kind(blob)`` for each worker process and vocabulary."""
    key = (kind, len(blob), hash(blob))
    if key not in _workers:
        _release()
        _workers[key] = kind(blob)
    return _workers[key]


def forget() -> None:
    """Frees the encoders that earlier tasks left in this worker; for work that needs none, as workers serve many stages."""
    if _workers:
        _workers.clear()
        _release()


def _release() -> None:
    """Gives memory that this worker holds but no longer uses back to the system."""
    for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
        pool.release_unused()


class ByteBpe:
    """Byte-level BPE through the tokenizers library.

    The library splits a text by a pattern before it merges, and no such part continues across a space that follows
    a visible character. Words between those spaces therefore encode alike wherever they stand, and so do the runs of
    letters and of other characters in a word. All texts of a column are cut into such units at once, and only distinct
    units are looked up. Each worker keeps the ids of units it has met lately; only new ones reach the library. Special
    strings inside a text are ordinary text.
    """

    def __init__(self, blob: bytes):
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_buffer(blob)
        self.tokenizer.encode_special_tokens = True
        self.size = self.tokenizer.get_vocab_size()
        self.letters = _byte_letters()
        # tokens that begin with a space
        self.spaced = np.array([(self.tokenizer.id_to_token(n) or "").startswith(self.letters[32]) for n in range(self.size)])
        self.memo: dict[str, bytes] = {}  # units met lately
        self.older: dict[str, bytes] = {}  # the same from the time before

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        """What the library gives for each text."""
        return [np.array(found.ids, dtype="<u4") for found in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _runs(self, runs: list[str]) -> Iterator[bytes]:
        """Ids of runs of letters after a space: each is one part for the library's merges and begins with the only space in it."""
        from tokenizers.pre_tokenizers import Split

        whole = self.tokenizer.pre_tokenizer
        self.tokenizer.pre_tokenizer = Split(self.letters[32], "merged_with_next")
        try:
            for at in range(0, len(runs), CALL_RUNS):
                text = "".join(runs[at:at + CALL_RUNS])
                if text.isascii():
                    text = text.replace(" ", self.letters[32])
                else:
                    text = text.encode().decode("latin-1").translate(self.letters)
                ids, = self._plain([text])
                data, begins = ids.tobytes(), (4 * np.flatnonzero(self.spaced[ids])).tolist()
                yield from (data[a:b] for a, b in zip(begins, [*begins[1:], len(data)], strict=True))
        finally:
            self.tokenizer.pre_tokenizer = whole

    def _learned(self, units: list[str]) -> np.ndarray:
        """Ids of units, as the library gives them."""
        column, found = pa.array(units, pa.string()), np.empty(len(units), dtype=object)
        left = np.ones(len(units), dtype=bool)
        for letters in (_ASCII, _LATIN):  # apart, as ASCII letters stand for themselves
            at = np.flatnonzero(left & pc.match_substring_regex(column, f"^ [{letters}]+$").to_numpy(zero_copy_only=False))
            found[at] = list(self._runs([units[i] for i in at.tolist()]))
            left[at] = False
        at = np.flatnonzero(left)
        found[at] = [ids.tobytes() for ids in self._plain([units[i] for i in at.tolist()])]
        return found

    def _known(self, units: list[str]) -> list[bytes]:
        """Ids of units: those met lately from memory."""
        found = list(map(self.memo.get, units))
        missing = [at for at, ids in enumerate(found) if ids is None]
        if not missing:
            return found
        if len(self.memo) > MEMO_UNITS:
            self.memo, self.older = {}, self.memo
        asked = [units[at] for at in missing]
        again = list(map(self.older.get, asked))
        learned = iter(self._learned([unit for unit, ids in zip(asked, again) if ids is None]))
        again = [next(learned) if ids is None else ids for ids in again]
        for at, ids in zip(missing, again):
            found[at] = ids
        if max(map(len, asked)) > UNIT_CHARS:
            self.memo.update((unit, ids) for unit, ids in zip(asked, again) if len(unit) <= UNIT_CHARS)
        else:
            self.memo.update(zip(asked, again))
        return found

    @staticmethod
    def _begins(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Where units begin in the UTF-8 bytes of texts that begin at ``starts``."""
        kind, blank = _LETTER[data], _BLANK[data]
        safe = _VISIBLE[data]
        odd = data == ord("'")  # where parts of a word could influence each other: contractions, white space, other scripts
        odd[1:] |= blank[1:] & blank[:-1]
        lead = np.flatnonzero(data >= 0xC2)
        if len(lead):
            byte = [data[np.minimum(lead + i, len(data) - 1)].astype(np.int64) for i in range(3)]
            two, three = byte[0] < 0xE0, byte[0] < 0xF0
            code = np.where(two, (byte[0] & 31) << 6 | byte[1] & 63, (byte[0] & 15) << 12 | (byte[1] & 63) << 6 | byte[2] & 63)
            odd[lead] = ~(two & _IS_LATIN[code])
            at = np.flatnonzero(three)
            safe[lead[at] + np.where(two[at], 1, 2)] = _WORD[code[at]]
        space = data == ord(" ")
        words = np.zeros(len(data), dtype=bool)
        words[1:] = space[1:] & safe[:-1]
        words[starts] = True
        odd |= space & ~words
        parts = np.flatnonzero((kind[1:] != kind[:-1]) & ~space[:-1] & ~words[1:]) + 1
        at = np.flatnonzero(odd)
        if len(at):
            begins = np.flatnonzero(words)
            whole = np.zeros(len(begins), dtype=bool)
            whole[np.searchsorted(begins, at, "right") - 1] = True
            parts = parts[~whole[np.searchsorted(begins, parts, "right") - 1]]
        words[parts] = True
        return np.flatnonzero(words)

    def _block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each has."""
        texts = texts.cast(pa.string())
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
        if offsets[0] == offsets[-1]:
            return np.empty(0, dtype="<u4"), np.zeros(len(texts), dtype=np.int64)
        data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0]:offsets[-1]]
        offsets = offsets - offsets[0]
        begins = self._begins(data, offsets[:-1][offsets[:-1] < len(data)])
        bounds = np.append(begins, len(data)).astype(np.int32)
        units = pa.StringArray.from_buffers(len(begins), pa.py_buffer(bounds), pa.py_buffer(data)).dictionary_encode()
        known = self._known(units.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, known), dtype=np.int32, count=len(known)) // 4
        index = units.indices.to_numpy()
        taken = sizes[index]
        ids = np.frombuffer(b"".join(known), dtype="<u4")[ranges((np.cumsum(sizes, dtype=np.int32) - sizes)[index], taken)]
        upto = np.concatenate(([0], np.cumsum(taken)))
        return ids, np.diff(upto[np.searchsorted(begins, offsets)])

    def encode_all(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all whole texts one after the other, ``end_id`` after each text's if given, and how many each has.

        Null gives none. The work goes in blocks of ``BLOCK`` bytes, so memory for a long text is that for its ids.
        """
        texts, n = pc.fill_null(texts, ""), len(texts)
        lengths = pc.binary_length(texts).to_numpy()
        rows, owner = texts, np.arange(n)
        if n and lengths.max() > BLOCK:
            cut = [list(_slices(text.as_py())) if length > BLOCK else [text.as_py()] for text, length in zip(texts, lengths.tolist())]
            rows, owner = pa.array([part for parts in cut for part in parts], pa.string()), np.repeat(owner, list(map(len, cut)))
            lengths = pc.binary_length(rows).to_numpy()
        blocks = np.flatnonzero(np.diff(np.cumsum(lengths) // BLOCK, prepend=-1))
        found = [self._block(rows.slice(a, b - a)) for a, b in zip(blocks.tolist(), [*blocks[1:].tolist(), len(rows)])]
        ids = np.concatenate([np.empty(0, dtype="<u4"), *(f[0] for f in found)])
        counts = np.bincount(owner, np.concatenate([np.empty(0), *(f[1] for f in found)]), n).astype(np.int64)
        if end_id is not None:
            ids, counts = np.insert(ids, np.cumsum(counts), end_id), counts + 1
        return ids, counts

    def encode(self, text: str | None) -> bytes:
        """The ids of the whole text as little-endian unsigned 32-bit integers; null gives none."""
        return self.encode_all(pa.array([text], pa.string()))[0].tobytes()

    def decode(self, ids: Iterable[int]) -> str:
        return self.tokenizer.decode(list(ids), skip_special_tokens=False)


class AddedBpe(ByteBpe):
    """The library's plain call: strings of added tokens inside a text give these tokens' ids."""

    def __init__(self, blob: bytes):
        super().__init__(blob)
        self.added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]

    def encode_all(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts, "")
        holds = np.zeros(len(texts), dtype=bool)
        for string in self.added:
            holds |= pc.match_substring(texts, string).to_numpy(zero_copy_only=False)
        if not holds.any():
            return super().encode_all(texts, end_id)
        ids, counts = super().encode_all(pc.if_else(pa.array(holds), "", texts), end_id)
        parts = np.split(ids, np.cumsum(counts)[:-1])
        self.tokenizer.encode_special_tokens = False  # a second tokenizer would take as much memory again
        try:
            for at in np.flatnonzero(holds).tolist():
                parts[at] = np.concatenate((*self._plain([texts[at].as_py()]), parts[at]))
        finally:
            self.tokenizer.encode_special_tokens = True
        return np.concatenate(parts), np.array(list(map(len, parts)), dtype=np.int64)


def _slices(text: str) -> Iterator[str]:
    """A long text in pieces that encode like the whole."""
    at = 0
    while cut := _SAFE_CUT.search(text, at + BLOCK):
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:]


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes for themselves, the others for
    the letters from U+0100 on in ascending order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [byte for byte in range(256) if byte not in shown]
    return {byte: chr(256 + n) for n, byte in enumerate(hidden)}


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start and size, one after the other."""
    ends = np.cumsum(sizes, dtype=sizes.dtype)
    out = np.repeat(starts - ends + sizes, sizes)
    out += np.arange(len(out), dtype=out.dtype)
    return out


def texts_of(column) -> Iterator[str]:
    """The strings of an Arrow column one after the other; null counts as the empty text."""
    for value in column:
        yield value.as_py() or ""
