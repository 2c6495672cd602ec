"""Quality classifier: histogram gradient-boosted trees over document statistics, flattened into arrays."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from labelmesh.llm.shipping import ship

#: labelled rows of each class that the model is fitted on, about
SAMPLE_ROWS = 6000
#: bins of a statistic, rounds, levels of a tree, shrinkage, ridge on leaf values, least curvature of a leaf
BINS, ROUNDS, LEVELS, RATE, RIDGE, LEAST_CURVATURE = 64, 150, 4, 0.1, 1.0, 2.0
#: score from which a document counts as good
GOOD = 0.7
#: bytes of a text that are read at once
TEXT_BLOCK = 1 << 22

_BYTE = np.arange(256)
_CLASSES = {
    "upper": (_BYTE >= 0x41) & (_BYTE <= 0x5A),
    "lower": (_BYTE >= 0x61) & (_BYTE <= 0x7A),
    "digit": (_BYTE >= 0x30) & (_BYTE <= 0x39),
    "stop": np.isin(_BYTE, list(b".,;:")),
    "call": np.isin(_BYTE, list(b"!?")),
    "quote": np.isin(_BYTE, list(b"\"'()-")),
    "symbol": np.isin(_BYTE, list(b"#*$%&|<>@^~=+{}[]\\/_`")),
    "foreign": _BYTE >= 0x80,
    "control": (_BYTE < 0x09) | (_BYTE > 0x0D) & (_BYTE < 0x20) | (_BYTE == 0x7F),
}
_LETTER = (_CLASSES["upper"] | _CLASSES["lower"] | _CLASSES["foreign"]).astype(np.int64)
_SPACE = (_BYTE == 0x20) | (_BYTE >= 0x09) & (_BYTE <= 0x0D)
_ENDS = np.isin(_BYTE, list(b"#*$%&|<>@^~=+\\/_`"))
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_TOTALS = np.stack([mask for mask in _CLASSES.values()]).astype(np.int64)
STATISTICS = (
    "words", "word_bytes", "longest", *_CLASSES, "entropy", "lines", "line_words", "line_copies", "line_stops", "distinct", "distinct_root",
    "top", "top_five", "again", "pairs", "triples", "letterless", "symbol_ends", "short", "sentences",
)


def _distinct_share(codes: np.ndarray, width: int) -> float:
    """Distinct stretches of ``width`` words per stretch; 1 where there is none."""
    n = len(codes) - width + 1
    if n < 1:
        return 1.0
    mixed = codes[:n].copy()
    for i in range(1, width):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + codes[i:i + n]
    mixed.sort()
    return (1 + np.count_nonzero(mixed[1:] != mixed[:-1])) / n


def statistics(text: str | None) -> list[float]:
    """The numbers that a tree may look at, of the whole text; all are finite, those of the empty text too."""
    data = (text or "").encode()
    counts, codes, lengths, lines, at = np.zeros(256, dtype=np.int64), [], [], Counter(), 0
    stops = letterless = ends = 0
    while at < len(data):
        gap = _GAP.search(data, at + TEXT_BLOCK) if at + TEXT_BLOCK < len(data) else None
        end = gap.end() if gap else len(data)
        part = data[at:end]
        raw = np.frombuffer(part, dtype=np.uint8)
        counts += np.bincount(raw, minlength=256)
        space = np.concatenate(([True], _SPACE[raw], [True]))
        turns = np.flatnonzero(space[1:] != space[:-1])
        first, past = turns[::2], turns[1::2]
        if len(first):
            codes.append(np.fromiter(map(hash, part.split()), dtype=np.int64, count=len(first)).view(np.uint64))
            lengths.append(past - first)
            letterless += int(np.count_nonzero(np.add.reduceat(_LETTER[raw], first) == 0))
            ends += int(np.count_nonzero(_ENDS[raw[past - 1]]))
        at = end
    for line in data.split(b"\n"):
        line = line.strip()
        if line:
            lines[hash(line)] += 1
            stops += line[-1:] in b".!?:;\""
    code = np.concatenate(codes) if codes else np.empty(0, dtype=np.uint64)
    length = np.concatenate(lengths) if lengths else np.empty(0, dtype=np.int64)
    n, size, n_lines = len(code), max(1, len(data)), lines.total()
    some = max(1, n)
    share = counts[counts > 0] / size
    ordered = np.sort(code)
    edges = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1], [True]))) if n else np.zeros(1, dtype=np.int64)
    most = np.sort(np.diff(edges))[::-1]
    return [
        math.log1p(n), float(length.sum() / some), math.log1p(int(length.max(initial=0))), *(_TOTALS @ counts / size).tolist(),
        float(-(share * np.log2(share)).sum()), math.log1p(n_lines), math.log1p(n / max(1, n_lines)),
        1 - len(lines) / n_lines if n_lines else 0.0, stops / max(1, n_lines), len(most) / some, len(most) / math.sqrt(some),
        float(most[:1].sum() / some), float(most[:5].sum() / some), float(np.count_nonzero(code[1:] == code[:-1]) / some),
        _distinct_share(code, 2), _distinct_share(code, 3), letterless / some, ends / some, float(np.count_nonzero(length <= 3) / some),
        int(counts[list(b".!?")].sum()) / some,
    ]


@dataclass
class Forest:
    """All trees' nodes one after the other. A node sends a row to ``left`` or the node after it; a leaf to itself."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray  # rows above go right; infinite at a leaf
    left: np.ndarray
    value: np.ndarray  # of leaves
    bias: float
    levels: int

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Sum of the leaves that each row of ``x`` reaches: all rows step down all trees together."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.levels):
            at = self.left[at] + (x[rows, self.feature[at]] > self.threshold[at])
        return self.bias + self.value[at].sum(axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -30, 30)))


def edges_of(x: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """For each column the values between bins: halfway between neighbouring quantiles."""
    out = []
    for column in x.T:
        values = np.unique(column)
        if len(values) > bins:
            values = np.unique(np.quantile(column, np.linspace(0, 1, bins), method="nearest"))
        out.append((values[1:] + values[:-1]) / 2)
    return out


def best_split(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> tuple[float, int, int]:
    """(gain, feature, bin) of the best split of one node's histograms (feature, bin); rows of that bin and below go left."""
    left_g, left_h = np.cumsum(g, axis=1), np.cumsum(h, axis=1)
    total_g, total_h = left_g[0, -1], left_h[0, -1]
    right_g, right_h = total_g - left_g, total_h - left_h
    gain = left_g ** 2 / (left_h + ridge) + right_g ** 2 / (right_h + ridge) - total_g ** 2 / (total_h + ridge)
    gain = np.where((left_h >= least) & (right_h >= least), gain, 0.0)
    at = int(np.argmax(gain))
    return float(gain.flat[at]), at // gain.shape[1], at % gain.shape[1]


def fit_forest(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = ROUNDS, levels: int = LEVELS, rate: float = RATE,
               bins: int = BINS, ridge: float = RIDGE, least: float = LEAST_CURVATURE) -> Forest:
    """Boosts trees on the logistic loss: in each round gradients and curvatures are summed by node, statistic and bin."""
    n, width = x.shape
    mean = float(np.clip((weight * y).sum() / weight.sum(), 1e-3, 1 - 1e-3))
    bias = math.log(mean / (1 - mean))
    edges = edges_of(x, bins)
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], axis=1)  # bin b: up to edge b
    spot = np.arange(width) * bins + binned
    margin = np.full(n, bias)
    roots, feature, threshold, left, value = [], [], [], [], []

    def node() -> int:
        feature.append(0)
        threshold.append(math.inf)
        left.append(len(left))
        value.append(0.0)
        return len(left) - 1

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        g, h = weight * (p - y), weight * p * (1 - p)
        roots.append(node())
        at = np.full(n, roots[-1])
        level = [roots[-1]]
        for _ in range(levels):
            place = np.full(len(left), -1)
            place[level] = np.arange(len(level))
            mine = place[at] >= 0
            keys = (place[at[mine]][:, None] * width * bins + spot[mine]).ravel()
            shape = (len(level), width, bins)
            sums = [np.bincount(keys, np.repeat(v[mine], width), minlength=math.prod(shape)).reshape(shape) for v in (g, h)]
            grown = []
            for i, parent in enumerate(level):
                gain, f, b = best_split(sums[0][i], sums[1][i], ridge, least)
                if gain <= 1e-9 or b >= len(edges[f]):
                    continue
                first = node()
                node()
                feature[parent], threshold[parent], left[parent] = f, float(edges[f][b]), first
                rows = at == parent
                at[rows] = first + (binned[rows, f] > b)
                grown += [first, first + 1]
            level = grown
            if not level:
                break
        for leaf in np.unique(at).tolist():
            rows = at == leaf
            value[leaf] = -rate * float(g[rows].sum() / (h[rows].sum() + ridge))
        margin = margin + np.array(value)[at]
    return Forest(np.array(roots, dtype=np.int64), np.array(feature, dtype=np.int64), np.array(threshold), np.array(left, dtype=np.int64),
                  np.array(value), bias, levels)


def held_out(key: Column) -> Column:
    """Rows that no model may learn from: the CRC-32 of the key as text leaves 2 when divided by 4."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 4 == 2


def _matrix(texts: pa.Array) -> np.ndarray:
    return np.array([statistics(t.as_py()) for t in texts]).reshape(-1, len(STATISTICS))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, key: str = "doc_id", text: str = "text", label: str = "quality") -> Forest:
    """Fits on about ``sample_rows`` labelled rows of each class, drawn by hash and weighted back to their shares.

    The ids of the draw (bounded by it) are broadcast to find their texts; statistics are taken in tasks, and only they
    reach the driver: four times ``sample_rows`` rows at most, however often an id is repeated. An id that is labelled
    both ways is left out. With one class or none every score is that class's share.
    """
    ship(docs.sparkSession)
    marked = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("y")).filter(
        F.col("key").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("key"))).groupBy("key").agg(
        F.min("y").alias("y"), F.max("y").alias("most")).filter("y = most").select("key", "y")
    sizes = {r.y: r.n for r in marked.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = {y: min(1.0, sample_rows / n) for y, n in sizes.items()}
    draw = F.pmod(F.xxhash64(F.lit("quality"), "key"), F.lit(1 << 30)) / float(1 << 30)
    picked = marked.filter(draw < F.when(F.col("y") == 1, share.get(1, 0.0)).otherwise(share.get(0, 0.0))).limit(4 * sample_rows)
    texts = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    found = texts.join(F.broadcast(picked), "key").select(F.xxhash64(F.lit("quality"), "key", "text").alias("nth"), "y", "text")

    def measure(batches):
        for batch in batches:
            x = _matrix(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(x), pa.list_(pa.float64()))], names=["nth", "y", "x"])

    rows = found.mapInArrow(measure, "nth long, y int, x array<double>").orderBy("nth", "y", "x").limit(4 * sample_rows).toArrow()
    y = rows.column("y").to_numpy().astype(np.float64)
    x = np.array(rows.column("x").to_pylist()).reshape(-1, len(STATISTICS))
    if not len(y) or len(np.unique(y)) < 2:
        mean = float(y.mean()) if len(y) else 0.5
        return Forest(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0, dtype=np.int64), np.zeros(0),
                      math.log((mean + 1e-3) / (1 - mean + 1e-3)), 0)
    weight = np.where(y == 1, 1 / share.get(1, 1.0), 1 / share.get(0, 1.0))
    return fit_forest(x, y, weight / weight.mean())


def score_quality(docs: DataFrame, labels: DataFrame, model: Forest | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, ``held_out``, ``score`` and ``predicted``; no shuffle but for the fit.

    Labels of held-out rows are never read into the model; scores depend on the whole text alone. Null and empty texts
    have the statistics of no words; repeated rows and null keys are scored row by row; other columns are not read; an
    empty table gives no rows. The trees, some 100 kB however many rows there are, travel with the function.
    """
    ship(docs.sparkSession)
    forest = model or fit(docs, labels, key=key, text=text)

    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(forest.scores(_matrix(texts)))

    rows = docs.select(F.col(key).alias("key"), score(F.col(text).cast("string")).alias("score"))
    return rows.select(F.col("key").alias(key), held_out(F.col("key")).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))
