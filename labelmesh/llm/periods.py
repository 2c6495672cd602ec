"""Periodic runs of words: blocks matched with what follows them by exact convolution, matches grown to runs."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from labelmesh.llm.shipping import ship

#: a run repeats its period so often, and has so many words, at least
REPEATS, LEAST = 4, 6
#: words that are searched together, and bytes of a text that are split at once
GROUP_WORDS, TEXT_BLOCK = 1 << 19, 1 << 22
#: numbers that one batch of transforms holds
TRANSFORM = 1 << 19
#: words of a block that are looked up in the following window before it is transformed
PROBES = 16
#: above so many matches at one distance, all stretches of that distance are found at once
MANY = 64

# A prime with 2^30 dividing one less, and its least primitive root.
PRIME, ROOT = 3221225473, 5
_P = np.uint64(PRIME)

_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _mod(x: np.ndarray) -> np.ndarray:
    return x - x // _P * _P


@lru_cache(maxsize=64)
def _powers(size: int, inverse: bool) -> np.ndarray:
    """Powers 0 to size/2 - 1 of a primitive root of unity of order ``size``, or of its inverse."""
    w = pow(ROOT, (PRIME - 1) // size, PRIME)
    w = pow(w, PRIME - 2, PRIME) if inverse else w
    out = np.ones(size // 2, dtype=np.uint64)
    done = 1
    while done < len(out):
        out[done:2 * done] = _mod(out[:done] * np.uint64(pow(w, done, PRIME)))
        done *= 2
    return out


def transform(x: np.ndarray) -> np.ndarray:
    """Number-theoretic transform of each row modulo PRIME, in bit-reversed order."""
    x, rows = x.astype(np.uint64), len(x)
    half = x.shape[1] // 2
    while half:
        y = x.reshape(rows, -1, 2, half)
        a, b = y[:, :, 0], y[:, :, 1]
        x = np.stack((_mod(a + b), _mod(_mod(a + (_P - b)) * _powers(2 * half, False))), axis=2).reshape(rows, -1)
        half //= 2
    return x


def transform_back(x: np.ndarray) -> np.ndarray:
    """Inverse of ``transform``."""
    size, rows, half = x.shape[1], len(x), 1
    while half < size:
        y = x.reshape(rows, -1, 2, half)
        a, b = y[:, :, 0], _mod(y[:, :, 1] * _powers(2 * half, True))
        x = np.stack((_mod(a + b), _mod(a + (_P - b))), axis=2).reshape(rows, -1)
        half *= 2
    return _mod(x * np.uint64(pow(size, PRIME - 2, PRIME)))


def mismatch(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Sum of squared differences, modulo PRIME, of each block with its window at each of the block's length of lags.

    A row of ``blocks`` has B words, a row of ``windows`` 2 B (the last one is not used): a cyclic convolution of 2 B
    numbers holds all B lags. With x for the block and y for the window the sum is that of x², of y² over the lag's
    stretch, less twice the sum of products. It is zero wherever the words are equal.
    """
    size = blocks.shape[1]
    x = np.zeros((len(blocks), 2 * size), dtype=np.uint64)
    x[:, 0], x[:, :size:-1] = blocks[:, 0], blocks[:, 1:]  # reversed: products then run along the window
    products = transform_back(_mod(transform(x) * transform(windows)))[:, :size]
    squares = _mod(windows.astype(np.uint64) ** np.uint64(2))
    sums = np.concatenate((np.zeros((len(blocks), 1), dtype=np.uint64), np.cumsum(squares, axis=1)), axis=1)
    own = _mod(blocks.astype(np.uint64) ** np.uint64(2)).sum(axis=1)[:, None]
    return _mod(_mod(own + sums[:, size:2 * size] - sums[:, :size]) + np.uint64(2) * (_P - products))


def _candidates(x: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Blocks whose probed words all come again, each at some distance from ``size`` to 2 ``size`` - 1; others match nowhere."""
    probes = range(size) if size <= PROBES else sorted({i * (size - 1) // (PROBES - 1) for i in range(PROBES)})
    for probe in probes:
        if not len(starts):
            break
        view = np.lib.stride_tricks.sliding_window_view(x, size)
        keep = np.empty(len(starts), dtype=bool)
        step = max(1, TRANSFORM // size)
        for at in range(0, len(starts), step):
            here = starts[at:at + step] + probe
            keep[at:at + step] = (view[here + size] == x[here][:, None]).any(axis=1)
        starts = starts[keep]
    return starts


def _matches(x: np.ndarray, starts: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Starts of blocks and the distances from ``size`` to 2 ``size`` - 1 at which they come again."""
    step = max(1, TRANSFORM // (2 * size))
    for at in range(0, len(starts), step):
        here = starts[at:at + step]
        blocks = x[here[:, None] + np.arange(size)]
        windows = x[here[:, None] + np.arange(size, 3 * size)]
        row, lag = np.nonzero(mismatch(blocks, windows) == 0)
        yield here[row], lag + size


def _same(x: np.ndarray, i: int, d: int, direction: int) -> int:
    """How many places from ``i`` on, in a direction, have an equal ``d`` further on."""
    total, width = 0, 64
    while True:
        if direction > 0:
            part = x[i + total:i + total + width]
            far = x[i + total + d:i + total + d + width]
            equal = part[:len(far)] == far
        else:
            end = i + 1 - total
            low = max(0, end - width)
            equal = (x[low:end] == x[low + d:end + d])[::-1]
        if not len(equal):
            return total
        stop = int(np.argmin(equal))
        if not equal[stop]:
            return total + stop
        total, width = total + len(equal), 2 * width


def _grow(x: np.ndarray, seeds: np.ndarray, d: int) -> list[tuple[int, int]]:
    """Longest stretches with period ``d`` around the seeds (sorted) that are runs: (start, end)."""
    if len(seeds) > MANY:
        equal = np.concatenate(([False], x[:-d] == x[d:], [False]))
        edges = np.flatnonzero(equal[1:] != equal[:-1])
        low, high = edges[::2], edges[1::2]
        long = (high - low >= (REPEATS - 1) * d) & (high - low + d >= LEAST)
        low, high = low[long], high[long]
        held = np.searchsorted(seeds, high) > np.searchsorted(seeds, low)
        return list(zip(low[held].tolist(), (high[held] + d).tolist()))
    out, end = [], -1
    for seed in seeds.tolist():
        if seed < end:
            continue
        end = seed + _same(x, seed, d, 1)
        if end == seed:  # equal only modulo the prime
            continue
        low = seed + 1 - _same(x, seed, d, -1)
        if end - low >= (REPEATS - 1) * d and end - low + d >= LEAST:
            out.append((low, end + d))
    return out


def find_runs(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """All runs (start, end, period) of the sequences that lie between ``bounds`` in ``x``, a number that comes once
    after each of them; rows by start, then period.

    A run of period p has 4 p words. At the scale B with B <= p < 2 B the first block of B words at a multiple of B inside
    it comes again p words later, still inside it; so every run has a matched block at its distance, and grows from it.
    Stretches of a multiple of their smallest period cover the same words and are dropped. Blocks that lie, with all that
    a run could compare them to, in a known run of period B or less are skipped: by the periodicity lemma a run found
    there would be the known one.
    """
    lengths = np.diff(bounds) - 1
    limit = np.repeat(bounds[1:] - 1, lengths + 1)  # where the sequence of each place ends
    first = np.repeat(bounds[:-1], lengths + 1)
    best: dict[tuple[int, int], int] = {}
    padded = np.concatenate((x, np.full(1, -1, dtype=x.dtype)))
    size, longest = 1, int(lengths.max(initial=0))
    inside = np.zeros(len(x), dtype=np.int64)  # end of the known run that holds a place
    while REPEATS * size <= longest:
        starts = np.arange(0, len(x), size)
        # with REPEATS * p words at least, the run goes on for (REPEATS - 1) * p words or more after the block's first B
        starts = starts[(limit[starts] - first[starts] >= REPEATS * size) & (starts + 2 * size <= limit[starts])]
        starts = starts[inside[starts] < np.minimum(starts + 3 * size, limit[starts])]
        if len(starts) and starts[-1] + 3 * size > len(padded):
            padded = np.concatenate((padded, np.full(starts[-1] + 3 * size - len(padded), -1, dtype=x.dtype)))
        found: list[tuple[np.ndarray, np.ndarray]] = list(_matches(padded, _candidates(padded, starts, size), size))
        if found:
            seeds, distances = (np.concatenate(part) for part in zip(*found))
            order = np.lexsort((seeds, distances))
            seeds, distances = seeds[order], distances[order]
            edges = np.flatnonzero(np.concatenate(([True], distances[1:] != distances[:-1], [True]))) if len(seeds) else np.zeros(1, dtype=int)
            fresh = []
            for a, b in zip(edges, edges[1:]):
                d = int(distances[a])
                for run in _grow(x, seeds[a:b], d):
                    if run not in best:
                        best[run] = d
                        fresh.append(run)
            for low, high in fresh:
                if (high - low) >= 6 * size:
                    inside[low:high] = np.maximum(inside[low:high], high)
        size *= 2
    rows = np.array([(low, high, d) for (low, high), d in best.items()], dtype=np.int64).reshape(-1, 3)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def numbers() -> defaultdict[bytes, int]:
    """Gives each new word the next number."""
    return defaultdict(count().__next__)


def numbered(text: str | None, names: defaultdict[bytes, int]) -> np.ndarray:
    """The whole text's words as numbers that ``names`` gives them, split some at a time."""
    data = (text or "").encode()
    parts, at = [], 0
    while at < len(data):
        space = _SPACE.search(data, at + TEXT_BLOCK) if at + TEXT_BLOCK < len(data) else None
        end = space.start() if space else len(data)
        words = data[at:end].split()
        parts.append(np.fromiter(map(names.__getitem__, words), dtype=np.int64, count=len(words)))
        at = end
    return np.concatenate(parts) if parts else np.empty(0, dtype=np.int64)


def planted(words: np.ndarray, key: object) -> np.ndarray:
    """The words of one document as the query searches them: for a tenth of all keys the end is made periodic."""
    h, n = zlib.crc32(("" if key is None else str(key)).encode()), len(words)
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return words[np.where(i >= a, a + (i - a) % p, i)]


def collapsed_digest(words: np.ndarray, keep: np.ndarray | None, spelled: list[bytes]) -> str:
    """SHA-256 of the kept words joined by one space."""
    kept = words if keep is None else words[keep]
    digest = hashlib.sha256()
    for at in range(0, len(kept), GROUP_WORDS):
        digest.update(b" " * (at > 0) + b" ".join([spelled[i] for i in kept[at:at + GROUP_WORDS].tolist()]))
    return digest.hexdigest()


def describe(words: np.ndarray, runs: np.ndarray, spelled: list[bytes]) -> tuple:
    """n_runs, the strongest run's start, length, period and exponent in thousandths, digests of runs and of the text
    without what repeats: words after the first period of a run go."""
    if not len(runs):
        return 0, None, None, None, None, hashlib.sha256(b"").hexdigest(), collapsed_digest(words, None, spelled)
    rows = [(low, high - low, d) for low, high, d in runs.tolist()]
    start, length, period = min(rows, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
    keep = np.ones(len(words), dtype=bool)
    for low, n, d in rows:
        keep[low + d:low + n] = False
    listed = "".join(f"{a},{n},{d}\n" for a, n, d in rows)
    return len(rows), start, length, period, 1000 * length // period, hashlib.sha256(listed.encode()).hexdigest(), collapsed_digest(words, keep, spelled)


_FIELDS = {"n_runs": "long", "start": "long", "length": "long", "period": "long", "exponent_milli": "long", "runs_sha256": "string", "collapsed_sha256": "string"}


def periodic_runs(docs: DataFrame, prepare=None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, ``n_runs``, the run of greatest exponent, digests of all runs and of the collapsed text.

    One pass without a shuffle: a task searches its documents' words in groups of about half a million, side by side, a
    longer text by itself. ``prepare(words, key)`` may change the words first. Null texts and texts without words have no
    run and collapse to the empty text; null keys and repeated rows are searched row by row; other columns are not read;
    an empty table gives no rows. Of runs with equal exponents the first start, then the smaller period is described.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([T.StructField("key", rows.schema["key"].dataType)])
    for name, kind in _FIELDS.items():
        schema.add(name, kind)

    def run(batches):
        kind = None
        keys, texts, names, held = [], [], numbers(), 0

        def flush():
            lengths = np.array([len(t) for t in texts], dtype=np.int64)
            bounds = np.concatenate(([0], np.cumsum(lengths + 1)))
            x = np.empty(bounds[-1], dtype=np.int64)
            for low, words in zip(bounds.tolist(), texts):
                x[low:low + len(words)] = words
            x[bounds[1:] - 1] = len(names) + np.arange(len(texts))
            runs, spelled = find_runs(x, bounds), list(names)
            edges = np.searchsorted(runs[:, 0], bounds)
            out = [describe(words, runs[a:b] - [low, low, 0], spelled)
                   for words, low, a, b in zip(texts, bounds.tolist(), edges.tolist(), edges[1:].tolist())]
            columns = list(zip(*out))
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, kind), *(pa.array(c, pa.int64()) for c in columns[:5]), *(pa.array(c, pa.string()) for c in columns[5:])], names=schema.names)

        for batch in batches:
            kind = batch.schema.field(0).type
            for name, value in zip(batch.column(0), batch.column(1)):
                words = numbered(value.as_py(), names)
                keys.append(name.as_py())
                texts.append(words if prepare is None else prepare(words, keys[-1]))
                held += len(words) + 1
                if held >= GROUP_WORDS:
                    yield flush()
                    keys, texts, names, held = [], [], numbers(), 0
        if keys:
            yield flush()

    found = rows.mapInArrow(run, schema)
    return found.withColumnRenamed("key", key)
