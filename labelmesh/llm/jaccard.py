"""Jaccard join on word shingles: a pigeonhole over the partitioned universe, verified exactly."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from xxhash import xxh3_64_intdigest

from labelmesh.llm.components import components, smallest_key
from labelmesh.llm.shipping import ship, small_batches
from labelmesh.llm.tokens import forget
from labelmesh.runtime import cut, fits_broadcast

#: words of a shingle; links need 100 * intersection >= PERCENT * union
WORDS, PERCENT = 5, 80
#: bytes of text whose words are held at once
TEXT_BLOCK = 1 << 22
#: a signature shared by more sets than this is hot; spare segments, as a share, that let a set do without hot ones
HOT, SPARE = 20, 0.1
#: first rounds at most; they end when fewer than one comparison in so many finds a link
ROUNDS, FEW = 8, 10
#: common signatures, as a share of a set's size, that make a comparison worth while in the first rounds
LIKELY = 0.05
#: signatures of one reducing bucket (on average), of one packed row, and of a bucket's buffer
BUCKET, PACKED, BUFFER = 300_000, 250_000, 200_000
#: elements of a block of sets that is compared with another
BLOCK_TOKENS = 1 << 17
#: assumed share of equal tokens in unrelated sets, for the cost of a plan
NOISE = 0.02
#: bits of a signature that are kept within its bucket; more candidates, not fewer, follow from equal ones
SIG_BITS, BUCKET_BITS = 40, 22

_MIX = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None) -> np.ndarray:
    """Sorted 64-bit hashes of the set of the whole text's shingles."""
    data = (text or "").encode().lower()  # bytes: only A-Z change
    parts, at = [], 0
    while at < len(data):
        end = at + TEXT_BLOCK
        space = _SPACE.search(data, end) if end < len(data) else None
        end = space.start() if space else len(data)
        words = data[at:end].split()  # bytes: at space and \x09-\x0D
        parts.append(np.fromiter(map(xxh3_64_intdigest, words), dtype=np.uint64, count=len(words)))
        at = end
    hashed = np.concatenate(parts) if parts else np.empty(0, dtype=np.uint64)
    if not len(hashed):
        return hashed
    if len(hashed) < WORDS:
        total = np.array([len(hashed)], dtype=np.uint64)
        for i in range(len(hashed)):
            total = (total ^ hashed[i]) * _MIX[i]
        return _mix(total)
    total = np.zeros(len(hashed) - WORDS + 1, dtype=np.uint64)
    for i in range(WORDS):
        total += hashed[i:len(hashed) - WORDS + 1 + i] * _MIX[i]
    return np.unique(_mix(total))


def node_of(tokens: np.ndarray) -> int:
    """The set's identity: a signed 64-bit digest."""
    value = xxh3_64_intdigest(tokens.tobytes())
    return value - (1 << 64) if value >> 63 else value


def most_apart(both: int) -> int:
    """Most elements by which linked sets can differ that have so many together."""
    return both * (100 - PERCENT) // (100 + PERCENT)


@dataclass
class Band:
    """How sets of ``low`` to ``split`` - 1 elements are compared with one another and with larger ones below ``high``."""

    low: int
    split: int
    high: int
    apart: int  # most elements by which two linked ones differ
    segments: int
    emitted: int  # signatures of whole segments that each set gives, if segments are single
    double: bool  # whether one-deletion neighbourhoods are indexed too

    @property
    def spare(self) -> int:
        """Hot signatures that a set can do without; -1: none, as every signature may be needed."""
        return -1 if self.double else self.emitted - self.apart - 1


def plan_band(low: int, split: int, high: int, sets: int) -> Band:
    """The cheaper of two allocations of the errors to segments, by rows indexed and expected false candidates.

    Single: more segments than errors, so one is equal; a few spare ones make up for hot values. Double: half as many
    segments, one of which differs by at most one element and is found through one-deletion neighbourhoods.
    """
    size = (low + high - 1) / 2
    smaller = split - 1
    apart = most_apart(smaller + min(high - 1, 100 * smaller // PERCENT))
    emitted = apart + 1 + math.ceil(SPARE * (apart + 1))
    segments, short = emitted, 1.0
    while short > 1e-4 and segments < low:  # so many that even the smallest sets hardly ever leave too many empty
        segments = segments + 1 + segments // 16
        held = low / segments
        full = segments * (1 - math.exp(-held))
        spread = math.sqrt(max(1e-9, segments * math.exp(-held) * (1 - (1 + held) * math.exp(-held))))
        short = 0.5 * math.erfc((full - emitted) / spread / math.sqrt(2))
    single_cost = emitted + sets * (emitted * NOISE ** (size / segments) + short)
    halves = apart // 2 + 1
    double_cost = halves + size + sets * halves * (size / halves + 1) * NOISE ** max(0.0, size / halves - 1)
    if double_cost <= single_cost or segments >= low:
        return Band(low, split, high, apart, halves, halves, True)
    return Band(low, split, high, apart, segments, emitted, False)


class Plan:
    """Size bands a quarter wide: linked sets are in one band or in neighbouring ones. Key k compares band k - 1 with
    itself and with band k, so a set of band k gives signatures under the keys k and k + 1."""

    def __init__(self, counts: dict[int, int]):
        largest = max(counts, default=1)
        self.starts = [1]
        while self.starts[-1] <= largest:
            self.starts.append(max(self.starts[-1] + 1, -(-self.starts[-1] * 100 // PERCENT)))
        for _ in range(2):
            self.starts.append(max(self.starts[-1] + 1, -(-self.starts[-1] * 100 // PERCENT)))
        per_band = [0] * len(self.starts)
        for size, n in counts.items():
            per_band[self.band(size)] += n
        # key 0 has no band below it and is not used
        self.keys = [plan_band(self.starts[max(0, k - 1)], max(2, self.starts[k]), self.starts[k + 1], per_band[k] + (per_band[k - 1] if k else 0))
                     for k in range(len(self.starts) - 1)]

    def band(self, size: int) -> int:
        return bisect_right(self.starts, size) - 1

    def keys_of(self, size: int) -> tuple[int, ...]:
        k = self.band(size)
        return (k, k + 1) if k else (1,)

    def spare(self, size: int) -> int:
        return min(self.keys[k].spare for k in self.keys_of(size))

    def signatures(self, tokens: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Signatures of a set, and the keys under which it has too few segments with elements."""
        out, short = [], []
        values = (tokens & np.uint64((1 << 40) - 1)).astype(np.float64)  # sums stay exact: 40 bits and 8192 elements
        spot = tokens >> np.uint64(40)
        for k in self.keys_of(len(tokens)):
            band = self.keys[k]
            segment = ((spot * np.uint64(2 * k + 1) ^ (spot >> np.uint64(7))) % np.uint64(band.segments)).astype(np.int64)
            filled = np.bincount(segment, minlength=band.segments)
            if filled.max() > 8192:
                sums = np.zeros(band.segments, dtype=np.uint64)
                np.add.at(sums, segment, tokens & np.uint64((1 << 40) - 1))
            else:
                sums = np.bincount(segment, weights=values, minlength=band.segments).astype(np.uint64)
            tag = (np.arange(band.segments, dtype=np.uint64) + np.uint64(k << 40)) * _MIX[0]
            if band.double:
                out.append(_mix(sums * _MIX[1] + tag))
                deleted = sums[segment] - (tokens & np.uint64((1 << 40) - 1))
                out.append(_mix(deleted * _MIX[1] + tag[segment]))
                continue
            use = np.flatnonzero(filled)[:band.emitted]
            if len(use) < band.emitted:
                short.append(k)
            out.append(_mix(sums[use] * _MIX[1] + tag[use]))
        return np.concatenate(out), short


def short_signature(key: int) -> int:
    return (1 << SIG_BITS + BUCKET_BITS) + key


def _measure(docs: DataFrame) -> DataFrame:
    """(key, n, node) of each document; the empty set has no node."""
    def run(batches):
        forget()
        for batch in batches:
            sizes, nodes = [], []
            for text in batch.column(1):
                tokens = shingles(text.as_py())
                sizes.append(len(tokens))
                nodes.append(node_of(tokens) if len(tokens) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64())], names=["key", "n", "node"])

    schema = T.StructType([T.StructField("key", docs.schema["key"].dataType)]).add("n", "long").add("node", "long")
    return docs.mapInArrow(run, schema)


def _packed(docs: DataFrame, plan, buckets: int) -> DataFrame:
    """Signatures dealt to buckets by hash, many to a row; equal copies in a task's batch are given once."""
    def pack(signatures, owners):
        sig, node = np.concatenate(signatures), np.concatenate(owners)
        order = np.lexsort((node, sig))
        sig, node = sig[order], node[order]
        fresh = np.concatenate(([True], (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])))
        sig, node = sig[fresh], node[fresh]
        bucket = (sig % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((node, bucket))
        sig, node, bucket = sig[order], node[order], bucket[order]
        low = (sig >> np.uint64(64 - SIG_BITS)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SIG_BITS // 8]
        edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
        owners = [np.unique(node[a:b], return_counts=True) for a, b in zip(edges, edges[1:])]
        return pa.RecordBatch.from_arrays(
            [pa.array(bucket[edges[:-1]], pa.int32()), pa.array([low[a:b].tobytes() for a, b in zip(edges, edges[1:])], pa.binary()),
             pa.array([n.astype("<i8").tobytes() for n, _ in owners], pa.binary()),
             pa.array([c.astype("<u4").tobytes() for _, c in owners], pa.binary())], names=["bucket", "sigs", "nodes", "counts"])

    def run(batches):
        forget()
        plan_ = plan.value
        signatures, owners, held, seen = [], [], 0, set()
        lonely: dict[int, set[int]] = {}
        for batch in batches:
            for text in batch.column(0):
                tokens = shingles(text.as_py())
                if not len(tokens):
                    continue
                node = node_of(tokens)
                if node in seen:
                    continue
                seen.add(node)
                found, short = plan_.signatures(tokens)
                signatures.append(found)
                owners.append(np.full(len(found), node, dtype="<i8"))
                held += len(found)
                for key in short:
                    lonely.setdefault(key, set()).add(node)
                if held >= PACKED:
                    yield pack(signatures, owners)
                    signatures, owners, held, seen = [], [], 0, set()
        if held:
            yield pack(signatures, owners)
        if lonely:  # sets that a key may miss: always reported, under one signature for each key
            keys = sorted(lonely)
            yield pa.RecordBatch.from_arrays(
                [pa.array([-1 - k for k in keys], pa.int32()), pa.array([b""] * len(keys), pa.binary()),
                 pa.array([np.array(sorted(lonely[k]), dtype="<i8").tobytes() for k in keys], pa.binary()), pa.array([b""] * len(keys), pa.binary())],
                names=["bucket", "sigs", "nodes", "counts"])

    return docs.select("text").mapInArrow(run, "bucket int, sigs binary, nodes binary, counts binary")


def _shared(packed: DataFrame) -> DataFrame:
    """(sig, node) of signatures that different sets share; memory for one bucket's distinct signatures and a buffer."""
    def run(batches):
        forget()
        here, table, buffer, held = None, None, [], 0

        def settle():
            """Merges the buffer into the table; returns rows of signatures that now have more than one node."""
            sig, node, state = table
            new_sig = np.concatenate([s for s, _ in buffer])
            new_node = np.concatenate([n for _, n in buffer])
            fresh = np.zeros(len(sig) + len(new_sig), dtype=np.int8)
            fresh[len(sig):] = 2  # not reported, came now
            fresh[:len(sig)] = state
            sig, node = np.concatenate((sig, new_sig)), np.concatenate((node, new_node))
            order = np.lexsort((fresh, node, sig))
            sig, node, fresh = sig[order], node[order], fresh[order]
            again = np.concatenate(([False], (sig[1:] == sig[:-1]) & (node[1:] == node[:-1])))
            sig, node, fresh = sig[~again], node[~again], fresh[~again]
            head = np.concatenate(([True], sig[1:] != sig[:-1]))
            group = np.cumsum(head) - 1
            many = np.bincount(group) > 1
            known = np.zeros(len(many), dtype=bool)
            np.logical_or.at(known, group, fresh == 1)
            report = (many | known)[group] & (fresh != 1)
            out = (sig[report], node[report])
            return (sig[head], node[head], (many | known)[group[head]].astype(np.int8)), out

        def emit(out):
            sig, node = out
            for at in range(0, len(sig), 1 << 18):
                part = slice(at, at + (1 << 18))
                yield pa.RecordBatch.from_arrays([pa.array(sig[part].astype(np.int64) << BUCKET_BITS | here % (1 << BUCKET_BITS)), pa.array(node[part])], names=["sig", "node"])

        def blank():
            return np.empty(0, dtype="<u8"), np.empty(0, dtype="<i8"), np.empty(0, dtype=np.int8)

        for batch in batches:
            for bucket, sigs, nodes, counts in zip(batch.column(0).to_pylist(), *batch.columns[1:]):
                node = np.frombuffer(nodes.as_buffer(), dtype="<i8")
                if bucket < 0:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(node), short_signature(-1 - bucket))), pa.array(node)], names=["sig", "node"])
                    continue
                if bucket != here:
                    if buffer:
                        table, out = settle()
                        yield from emit(out)
                    here, table, buffer, held = bucket, blank(), [], 0
                node = np.repeat(node, np.frombuffer(counts.as_buffer(), dtype="<u4"))
                wide = np.zeros((len(node), 8), dtype=np.uint8)
                wide[:, :SIG_BITS // 8] = np.frombuffer(sigs.as_buffer(), dtype=np.uint8).reshape(len(node), -1)
                buffer.append((wide.view("<u8").ravel(), node))
                held += len(node)
                if held >= BUFFER:
                    table, out = settle()
                    yield from emit(out)
                    buffer, held = [], 0
        if buffer:
            table, out = settle()
            yield from emit(out)

    dealt = packed.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "sig long, node long").distinct()


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _sets(docs: DataFrame, rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, tokens) of the wanted nodes, from the text of one document each."""
    found = rows.join(wanted, "node").groupBy("node").agg(F.min("key").alias("key"))
    found = cut(found.select("key", "node"), "jaccard-wanted")
    keys = found.withColumnRenamed("key", "_key")
    if fits_broadcast(found.count(), 80):
        keys = F.broadcast(keys)
    texts = docs.join(keys, docs["key"].eqNullSafe(F.col("_key"))).select("node", "text")

    def run(batches):
        forget()
        for batch in batches:
            nodes, sets = [], []
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                tokens = shingles(text.as_py())
                if len(tokens) and node_of(tokens) == node:  # another row with the same key has another text
                    nodes.append(node)
                    sets.append(tokens.astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], names=["node", "tokens"])

    return texts.mapInArrow(run, "node long, tokens binary").dropDuplicates(["node"])


def _able(sets: DataFrame) -> DataFrame:
    """Nodes of ``sets`` that can have a partner among them.

    Elements that no other set has lie outside every intersection, so a set with a partner has n / 5 of them at most
    (at 80 %). Members of a large group of distant copies mostly have more.
    """
    def run(batches):
        forget()
        for batch in batches:
            for node, tokens in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.frombuffer(tokens.as_buffer(), dtype="<i8")
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), node))], names=["token", "node"])

    alone = sets.mapInArrow(run, "token long, node long").groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("node")).filter(
        "c = 1").groupBy("node").agg(F.count(F.lit(1)).alias("alone"))
    sized = sets.select("node", (F.octet_length("tokens") / 8).alias("n")).join(alone, "node", "left")
    return sized.filter(100 * F.coalesce("alone", F.lit(0)) <= (100 - PERCENT) * F.col("n")).select("node")


def _meet(left: list[tuple], right: list[tuple] | None):
    """One link (a, b) for each pair of components that two blocks of (node, root, tokens) join; of one block with itself
    if ``right`` is missing. Intersections of a set with all of a block are counted through the block's own index."""
    other = left if right is None else right
    owner = np.repeat(np.arange(len(other)), [len(t) for _, _, t in other])
    tokens = np.concatenate([t for _, _, t in other])
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    sizes = np.array([len(t) for _, _, t in other])
    roots = np.array([r for _, r, _ in other])
    joined: set[tuple[int, int]] = set()
    for node, root, own in left:
        first, last = np.searchsorted(tokens, own, "left"), np.searchsorted(tokens, own, "right")
        count = last - first
        spots = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
        both = np.bincount(owner[spots], minlength=len(other))
        for i in np.flatnonzero((100 * both >= PERCENT * (len(own) + sizes - both)) & (roots != root)).tolist():
            pair = (min(root, int(roots[i])), max(root, int(roots[i])))
            if pair not in joined:
                joined.add(pair)
                yield node, other[i][0]


def _blocks(rows: DataFrame, plan: Plan) -> DataFrame:
    """Links (a, b) between components of (node, tokens, root), block against block: every set meets all sets of its
    band and of the bands beside it, in tasks of two blocks; no pair is a row."""
    spark = rows.sparkSession
    rows = cut(rows.select("node", "root", "tokens"), "jaccard-able")
    starts = plan.starts
    shared = spark.sparkContext.broadcast(starts)
    band = F.size(F.filter(F.array(*map(F.lit, starts)), lambda e: e <= F.octet_length("tokens") / 8)) - 1
    sizes = {r.band: -(-r.n // BLOCK_TOKENS) for r in rows.groupBy(band.alias("band")).agg(
        F.sum((F.octet_length("tokens") / 8).cast("long")).alias("n")).collect()}
    blocks = spark.sparkContext.broadcast(sizes)

    def deal(batches):
        forget()
        starts, many = shared.value, blocks.value
        for batch in batches:
            keys, picked = [], []
            for at, (node, tokens) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2))):
                k = bisect_right(starts, len(tokens.as_buffer()) // 8) - 1
                mine = node % many[k]
                own = [(k, 0, min(mine, j), max(mine, j), int(mine > j)) for j in range(many[k])]
                upper = [(k, 1, mine, j, 0) for j in range(many.get(k + 1, 0))]
                lower = [(k - 1, 1, i, mine, 1) for i in range(many.get(k - 1, 0))]
                keys += own + upper + lower
                picked += [at] * (len(own) + len(upper) + len(lower))
            if picked:
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in zip(*keys)), *batch.take(pa.array(picked)).columns],
                                                 names=["band", "beside", "i", "j", "side", "node", "root", "tokens"])

    def run(batches):
        forget()
        here, sides = None, ([], [])

        def settle():
            if here is None or not sides[0]:
                return
            single = here[1] == 0 and here[2] == here[3]
            if single or sides[1]:
                found = list(_meet(sides[0], None if single else sides[1]))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[:7]]
            for *key, side, node, root, tokens in zip(*columns, batch.column(7)):
                if key != here:
                    yield from settle()
                    here, sides = key, ([], [])
                sides[side].append((node, root, np.frombuffer(tokens.as_buffer(), dtype="<u8")))
        yield from settle()

    dealt = rows.mapInArrow(deal, "band int, beside int, i int, j int, side int, node long, root long, tokens binary")
    place = ["band", "beside", "i", "j"]
    return dealt.repartition(*place).sortWithinPartitions(*place).mapInArrow(run, "a long, b long")


def _verify(pairs: DataFrame, docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (a, b) that are linked."""
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = cut(_sets(docs, rows, wanted), "jaccard-sets")
    left = sets.select(F.col("node").alias("a"), F.col("tokens").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("tokens").alias("y"))
    # small first: sizes alone exclude some pairs
    x, y = F.octet_length("x"), F.octet_length("y")
    joined = pairs.join(left, "a").join(right, "b").filter((100 * F.least(x, y) >= PERCENT * F.greatest(x, y)))

    def run(batches):
        forget()
        for batch in batches:
            keep, last, mine = [], None, None
            for i, (a, x, y) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3))):
                if a != last:
                    last, mine = a, np.frombuffer(x.as_buffer(), dtype="<u8")
                if linked(mine, np.frombuffer(y.as_buffer(), dtype="<u8")):
                    keep.append(i)
            kept = batch.select([0, 1]).take(pa.array(keep, pa.int64()))
            yield kept

    return joined.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def jaccard_classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, ``n_shingles`` and ``component_id``, the smallest key reachable by links.

    Equal sets are one node. Sets give signatures as ``Plan`` allots them; of linked sets at least one has few enough
    hot signatures to be found through others, or both are looked up in the hot ones too:

    1. in rounds, every set is compared with one of another component, the first of most of its signatures: linear work
       that joins most copies;
    2. sets of different components are then compared if they share enough signatures that are not hot, as many as
       linked sets must (the spare segments and one, less hot ones);
    3. sets with more hot signatures than spare segments are compared with one another, block against block.

    No pair within the limit is lost. Null texts and texts without words have the empty set and stand alone, each row
    under its own key. Null keys are documents (a component of null keys only has null as its id), repeated rows share
    a node, other columns are not read, an empty table gives no rows.
    """
    rows = classes_of(docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")))
    return rows.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id")


def classes_of(docs: DataFrame) -> DataFrame:
    """(key, n, component_id) of ``docs`` (key, text)."""
    ship(docs.sparkSession)
    with small_batches(docs.sparkSession):
        return _classes(docs)


def _classes(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    rows = cut(_measure(docs), "jaccard-rows")
    filled = rows.filter("n > 0").select("key", "n", "node")
    # sizes rounded to 2 %, so a bounded table whatever the number of documents
    rounded = F.when(F.col("n") < 100, F.col("n")).otherwise(F.floor(F.pow(F.lit(1.02), F.floor(F.log(F.col("n").cast("double")) / math.log(1.02))))).cast("long")
    counts = {r.size: r.sets for r in filled.groupBy(rounded.alias("size")).agg(F.count(F.lit(1)).alias("sets")).collect()}
    largest = filled.agg(F.max("n")).first()[0] or 1
    plan = Plan(counts | {largest: counts.get(largest, 0)})
    total = sum(n * sum(plan.keys[k].emitted + (size if plan.keys[k].double else 0) for k in plan.keys_of(size)) for size, n in counts.items())
    buckets = max(8, -(-total // BUCKET))
    shared = cut(_shared(_packed(docs, spark.sparkContext.broadcast(plan), buckets)), "jaccard-shared")
    sizes = shared.groupBy("sig").agg(F.count(F.lit(1)).alias("members"))
    shared = cut(shared.join(sizes, "sig"), "jaccard-members")
    # 1: each set with one set of another component, the first of most of its signatures; this only saves work in 2
    roots, rolling, tried, links, open_ = None, None, None, None, shared
    node_sizes = cut(filled.join(shared.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("n").alias("size")), "jaccard-sizes")
    for _ in range(ROUNDS):
        placed = open_.select("sig", "node", "members", F.col("node").alias("root")) if roots is None else open_.join(
            roots, "node", "left").select("sig", "node", "members", F.coalesce("root", "node").alias("root"))
        at = F.struct("root", "node")
        ends = placed.groupBy("sig").agg(F.min(at).alias("lo"), F.max(at).alias("hi")).filter("lo.root <> hi.root")
        placed = cut(placed.join(ends, "sig"), "jaccard-mixed")  # signatures of more than one component
        open_ = placed.select("sig", "node", "members")
        other = F.when(F.col("lo.root") == F.col("root"), F.col("hi.node")).otherwise(F.col("lo.node"))
        near = placed.select("node", other.alias("other")).groupBy("node", "other").agg(F.count(F.lit(1)).alias("n"))
        near = near.join(node_sizes, "node").filter(F.col("n") >= LIKELY * F.col("size"))
        pairs = near.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"), "node", "other", "n")
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        best = pairs.groupBy("node").agg(F.max(F.struct("n", "a", "b")).alias("p")).select("p.a", "p.b").distinct()
        best = cut(best, "jaccard-best")
        found = cut(_verify(best, docs, filled), "jaccard-links")
        tried = best if tried is None else tried.unionByName(best)
        links = found if links is None else links.unionByName(found)
        new, of = found.count(), best.count()
        if new:
            if rolling is not None:
                rolling.drop()
            roots, rolling = components(links)
        if new * FEW < of:
            break
    # 2: what is left between components
    if roots is None:
        roots, rolling = components(links)
    placed = open_.join(roots, "node", "left").select("sig", "node", "members", F.coalesce("root", "node").alias("root"))
    mixed = placed.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("sig")
    placed = cut(placed.join(mixed, "sig"), "jaccard-mixed")
    edges = [start for start in plan.starts if start <= largest]
    spare = F.element_at(F.array(*(F.lit(plan.spare(start)) for start in edges)), F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col("n"))))
    hot, short = F.col("members") > HOT, F.col("sig") >= short_signature(0)
    per_node = shared.groupBy("node").agg(F.sum((hot & ~short).cast("long")).alias("hot"), F.max(short.cast("int")).alias("short"))
    per_node = per_node.join(node_sizes.withColumnRenamed("size", "n"), "node")
    # shared signatures that a linked partner must have at least, hot ones among them; none is sure for short sets
    needs = cut(per_node.select("node", "hot", F.when(F.col("short") > 0, 0).otherwise(spare + 1).cast("long").alias("need"),
                                ((F.col("hot") > spare) | (F.col("short") > 0)).alias("pressed")), "jaccard-needs")
    cool = placed.filter(~hot).select("sig", "node", "root")
    x = cool.select("sig", F.col("node").alias("a"), F.col("root").alias("ra"))
    y = cool.select("sig", F.col("node").alias("b"), F.col("root").alias("rb"))
    between = x.join(y, "sig").filter("a < b AND ra <> rb").select("a", "b")
    warm = placed.filter(hot).join(needs.filter("pressed").select("node"), "node", "left_semi").select("node", "root").distinct()
    warm = cut(warm, "jaccard-warm")
    sets = cut(_sets(docs, filled, warm.select("node")), "jaccard-sets")
    hotly = cut(_blocks(sets.join(_able(sets), "node").join(warm, "node"), plan), "jaccard-links")
    rest = between.groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"))
    for side in ("a", "b"):
        rest = rest.join(needs.select(F.col("node").alias(side), F.col("hot").alias(f"hot_{side}"), F.col("need").alias(f"need_{side}")), side)
    rest = rest.filter(F.col("common") >= F.least("need_a", "need_b") - F.least("hot_a", "hot_b")).select("a", "b")
    rest = cut(rest.join(tried, ["a", "b"], "left_anti"), "jaccard-rest")
    more = cut(_verify(rest, docs, filled).unionByName(hotly), "jaccard-links")
    if not more.isEmpty():
        rolling.drop()
        roots, rolling = components(links.unionByName(more))
    ids = smallest_key(filled, roots).withColumnRenamed("node", "_node")
    joined = rows.join(ids, rows["node"] == ids["_node"], "left")
    return joined.select("key", "n", F.when(F.col("node").isNull(), F.col("key")).otherwise(F.col("component_id")).alias("component_id"))
