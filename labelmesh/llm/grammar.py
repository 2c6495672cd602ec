"""Token ids in files of grammar-compressed shards (Re-Pair), with random access."""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from labelmesh.llm.tokens import AddedBpe, ByteBpe, once, publish, ranges, vocabulary

#: ids of a shard, and how often a pair must occur to become a rule
SHARD_TOKENS, LEAST = 1 << 19, 6
#: symbols of a shard are stored in 16 bits while there are no more than these, in 32 bits above
NARROW = 1 << 16
#: places of a round's lookup table; of pairs that meet in one place the most frequent is replaced, the others in later rounds
SLOTS = 1 << 18


@dataclass
class Grammar:
    """``symbols`` with ids from ``base`` on standing for ``rules`` (pairs of earlier symbols)."""

    base: int
    rules: np.ndarray  # (n, 2)
    levels: np.ndarray  # first rule of each round
    lengths: np.ndarray  # expansion length of each rule
    symbols: np.ndarray

    def _expansions(self) -> tuple[np.ndarray, np.ndarray]:
        """All expansions one after the other, ids standing for themselves first, and where each begins."""
        flat = [np.arange(self.base, dtype=np.int64)]
        starts = [np.arange(self.base, dtype=np.int64)]
        sizes = np.concatenate((np.ones(self.base, dtype=np.int64), self.lengths))
        bounds = [*self.levels.tolist(), len(self.rules)]
        end = self.base
        for first, last in zip(bounds, bounds[1:]):  # rules of a round join symbols of earlier rounds
            known, begin = np.concatenate(flat), np.concatenate(starts)
            both = self.rules[first:last].ravel()
            flat.append(known[ranges(begin[both], sizes[both])])
            starts.append(end + np.cumsum(self.lengths[first:last]) - self.lengths[first:last])
            end += int(self.lengths[first:last].sum())
        return np.concatenate(flat), np.concatenate(starts)

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids that some symbols stand for."""
        flat, starts = self._expansions()
        sizes = np.concatenate((np.ones(self.base, dtype=np.int64), self.lengths))
        return flat[ranges(starts[symbols], sizes[symbols])].astype("<u4")

    def _sizes(self, symbols: np.ndarray) -> np.ndarray:
        """How many ids each symbol stands for."""
        size = np.ones(len(symbols), dtype=np.int64)
        rule = symbols >= self.base
        size[rule] = self.lengths[symbols[rule] - self.base]
        return size

    @cached_property
    def _ends(self) -> np.ndarray:
        """Ids up to the end of each symbol."""
        return np.cumsum(self._sizes(self.symbols))

    def span(self, start: int, length: int) -> np.ndarray:
        """Ids ``start`` to ``start + length``.

        Symbols are replaced by their two parts, level by level, and what lies outside is dropped before each: the work
        follows the span and the depth of the rules, not their number.
        """
        symbols = self.symbols
        while length > 0:
            ends = self._ends if symbols is self.symbols else np.cumsum(self._sizes(symbols))
            first, last = np.searchsorted(ends, [start, start + length - 1], "right")
            start -= int(ends[first - 1]) if first else 0
            symbols = symbols[first:last + 1]
            rule = symbols >= self.base
            if not rule.any():
                return symbols[start:start + length].astype("<u4")
            parts = np.repeat(symbols, 1 + rule)
            at = np.cumsum(1 + rule) - 1 - rule  # where each symbol's parts begin
            parts[at[rule]], parts[at[rule] + 1] = self.rules[symbols[rule] - self.base].T
            symbols = parts
        return np.empty(0, dtype="<u4")


def _slot(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A place for each pair of 32-bit symbols."""
    return ((left * np.uint32(2654435761) + right * np.uint32(40503)) >> np.uint32(11)) & np.uint32(SLOTS - 1)


def _counted(left: np.ndarray, right: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that occur ``least`` times, as 64-bit keys, most frequent first, and how often."""
    narrow = len(left) and max(int(left.max()), int(right.max())) < NARROW  # half as much to sort
    keys = (left << np.uint32(16)) | right if narrow else (left.astype(np.uint64) << np.uint64(32)) | right
    keys.sort()
    last = max(len(keys) - least + 1, 0)
    keys = keys[:last][keys[:last] == keys[least - 1:]]  # of a pair that occurs n times, n - least + 1
    edges = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True]))) if len(keys) else np.zeros(1, dtype=np.int64)
    counts = np.diff(edges) + least - 1
    keys = keys[edges[:-1]].astype(np.uint64)
    if narrow:
        keys = (keys >> np.uint64(16) << np.uint64(32)) | (keys & np.uint64(0xFFFF))
    order = np.lexsort((keys, -counts))
    return keys[order], counts[order]


def _apart(keys: np.ndarray) -> np.ndarray:
    """Which of the pairs, in order, no earlier one can overlap in the text."""
    lefts: set[int] = set()
    rights: set[int] = set()
    chosen = np.zeros(len(keys), dtype=bool)
    for i, (left, right) in enumerate(zip((keys >> np.uint64(32)).tolist(), (keys & np.uint64(0xFFFFFFFF)).tolist())):
        if left in rights or right in lefts or left == right and (left in lefts or right in rights):
            continue
        lefts.add(left)
        rights.add(right)
        chosen[i] = True
    return chosen


def compress(ids: np.ndarray, base: int, rounds: int | None = None, least: int = LEAST) -> Grammar:
    """Repeatedly gives the frequent pairs a nonterminal. In one round all pairs are replaced that cannot overlap,
    which is the same as replacing them one after the other; a pair of equal symbols is replaced from the left of
    each run. Ends when no pair is frequent, or after ``rounds`` if given.

    A pair that has become frequent holds a symbol of the round before; any other frequent pair was one already and was
    left over. No round makes two earlier symbols neighbours. So after the first round only places of new symbols and those
    where a pair was left over are looked at.
    """
    symbols = ids.astype(np.uint32)
    base = max(base, int(symbols.max(initial=0)) + 1)
    rules, lengths, levels = np.empty((0, 2), dtype=np.int64), np.empty(0, dtype=np.int64), []
    at = None  # places that are looked at, if not all
    while (rounds is None or len(levels) < rounds) and len(symbols) > 1:
        left, right = (symbols[:-1], symbols[1:]) if at is None else (symbols[at], symbols[at + 1])
        keys, counts = _counted(left, right, least)
        if not len(keys):
            break
        chosen = np.flatnonzero(_apart(keys))
        pairs = np.stack((keys[chosen] >> np.uint64(32), keys[chosen] & np.uint64(0xFFFFFFFF)), axis=1).astype(np.uint32)
        table = np.full(SLOTS, -1, dtype=np.int32)
        places = _slot(pairs[:, 0], pairs[:, 1])
        table[places[::-1]] = np.arange(len(pairs))[::-1]
        owners = table[places] == np.arange(len(pairs))
        pairs = pairs[owners]
        table[places[owners]] = np.arange(len(pairs))
        waiting = np.delete(keys, chosen[owners])
        levels.append(len(rules))
        fresh = base + len(rules)
        slots = _slot(left, right)
        found = table[slots]
        spots = np.flatnonzero(found >= 0)
        found = found[spots]
        hit = (pairs[found, 0] == left[spots]) & (pairs[found, 1] == right[spots])
        spots, found = spots[hit], found[hit]
        again = np.zeros(len(symbols), dtype=bool)
        if len(waiting):
            marked = np.zeros(SLOTS, dtype=bool)
            marked[_slot((waiting >> np.uint64(32)).astype(np.uint32), waiting.astype(np.uint32))] = True
            again[np.flatnonzero(marked[slots]) if at is None else at[marked[slots]]] = True
        if at is not None:
            spots = at[spots]
        twin = symbols[spots] == symbols[spots + 1]
        if twin.any():  # of neighbours in a run of one symbol, take every other
            runs = spots[twin]
            first = np.concatenate(([True], np.diff(runs) != 1))
            head = np.maximum.accumulate(np.where(first, np.arange(len(runs)), 0))
            drop = (np.arange(len(runs)) - head) % 2 == 1
            keep = np.ones(len(spots), dtype=bool)
            keep[np.flatnonzero(twin)[drop]] = False
            spots, found = spots[keep], found[keep]
        keep = np.ones(len(symbols), dtype=bool)
        keep[spots + 1] = False
        symbols[spots] = (fresh + found).astype(np.uint32)
        symbols, again = symbols[keep], again[keep]
        new = spots - np.arange(len(spots))
        again[new] = again[new[new > 0] - 1] = True
        at = np.flatnonzero(again[:-1])
        pairs = pairs.astype(np.int64)
        size = lambda s: np.where(s >= base, lengths[np.maximum(s - base, 0)] if len(lengths) else 1, 1)
        rules, lengths = np.concatenate((rules, pairs)), np.concatenate((lengths, size(pairs[:, 0]) + size(pairs[:, 1])))
    return Grammar(base, rules, np.array(levels, dtype=np.int64), lengths, symbols.astype(np.int64))


SHARD = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("shard", T.IntegerType()), T.StructField("part_start", T.LongType()),
    T.StructField("n_tokens", T.LongType()), T.StructField("doc_tokens", T.ArrayType(T.LongType())),
    T.StructField("base", T.LongType()), T.StructField("width", T.IntegerType()), T.StructField("levels", T.BinaryType()),
    T.StructField("rules", T.BinaryType()), T.StructField("lengths", T.BinaryType()), T.StructField("symbols", T.BinaryType()),
])


def _pack(grammar: Grammar) -> dict:
    width = 2 if grammar.base + len(grammar.rules) <= NARROW else 4
    kind = f"<u{width}"
    return {"base": grammar.base, "width": width, "levels": grammar.levels.astype("<u4").tobytes(),
            "rules": grammar.rules.astype(kind).tobytes(), "lengths": grammar.lengths.astype("<u4").tobytes(),
            "symbols": grammar.symbols.astype(kind).tobytes()}


def unpack(row: dict) -> Grammar:
    """The grammar that a shard row holds."""
    kind = f"<u{row['width']}"
    read = lambda name, k: np.frombuffer(row[name], dtype=k).astype(np.int64)
    return Grammar(row["base"], read("rules", kind).reshape(-1, 2), read("levels", "<u4"), read("lengths", "<u4"), read("symbols", kind))


def write_token_files(
    docs: DataFrame, folder: str, path: str | None = None, end_id: int = 2, shard_tokens: int = SHARD_TOKENS,
    rounds: int | None = None, least: int = LEAST, key: str = "doc_id", text: str = "text",
    added: bool = False,
) -> None:
    """Writes the ids of all texts, ``end_id`` after each, to ``folder`` in ascending key order.

    The folder holds Parquet files of shard rows: rules, expansion lengths, symbols, and keys and lengths of the
    shard's whole documents. Keys are dealt by range, so each task writes one run of the order (``part``) and needs
    memory for one shard. Spark's writer commits whole tasks, so a lost executor's shards are written again. Null
    texts have the end id alone, null keys come first, rows that repeat a key are ordered by text within a task's run
    and by the text's hash between runs, an empty table gives an empty folder. With ``added`` the strings of added
    tokens inside a text give these tokens.
    """
    vocab = publish(docs.sparkSession, path or vocabulary("byte_bpe_50k.json"))
    kept = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([T.StructField("doc_keys", T.ArrayType(kept.schema["key"].dataType)), *SHARD.fields])

    def run(batches):
        bpe = once(AddedBpe if added else ByteBpe, vocab.value)
        part = TaskContext.get().partitionId()
        names, parts, sizes, held, start, shard = [], [], [], 0, 0, 0
        kind = None

        def flush():
            row = _pack(compress(np.concatenate(parts), bpe.size, rounds, least))
            row |= {"doc_keys": names, "part": part, "shard": shard, "part_start": start, "n_tokens": held, "doc_tokens": sizes}
            return pa.RecordBatch.from_arrays(
                [pa.array([row[n]], pa.list_(kind) if n == "doc_keys" else _ARROW[n]) for n in schema.names], names=schema.names)

        for batch in batches:
            kind = batch.schema.field(0).type
            ids, counts = bpe.encode_all(batch.column(1), end_id)
            upto = 0
            for name, count in zip(batch.column(0).to_pylist(), counts.tolist()):
                names.append(name)
                parts.append(ids[upto:upto + count])
                sizes.append(count)
                upto += count
                held += count
                if held >= shard_tokens:
                    yield flush()
                    start, shard = start + held, shard + 1
                    names, parts, sizes, held = [], [], [], 0
        if names:
            yield flush()

    ordered = kept.repartitionByRange("key", F.xxhash64("text")).sortWithinPartitions("key", "text")
    ordered.mapInArrow(run, schema).write.mode("overwrite").option("compression", "zstd").parquet(folder)


_ARROW = {
    "part": pa.int32(), "shard": pa.int32(), "part_start": pa.int64(), "n_tokens": pa.int64(), "doc_tokens": pa.list_(pa.int64()),
    "base": pa.int64(), "width": pa.int32(), "levels": pa.binary(), "rules": pa.binary(), "lengths": pa.binary(), "symbols": pa.binary(),
}


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """The shard rows with ``start``, the ids of all documents before the shard.

    Only the totals of the files' runs go through one ordered window: a row for each writing task.
    """
    shards = spark.read.parquet(folder)
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("_tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("_tokens").over(before), F.lit(0)).alias("_before"))
    return shards.join(starts, "part").withColumn("start", F.col("_before") + F.col("part_start")).drop("_before")


def document_checksums(shards: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document of the read shards: key, ``start``, ``n_tokens`` and the CRC-32 of its decoded ids."""
    element = shards.schema["doc_keys"].dataType.elementType
    schema = T.StructType([T.StructField(key, element), T.StructField("start", T.LongType()),
                           T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    used = ["doc_keys", "start", "doc_tokens", "base", "width", "levels", "rules", "lengths", "symbols"]

    def run(batches):
        for batch in batches:
            kind = batch.schema.field(0).type.value_type
            for row in batch.to_pylist():
                grammar = unpack(row)
                ids = grammar.expand(grammar.symbols).tobytes()
                ends = np.cumsum(np.array(row["doc_tokens"], dtype=np.int64))
                begins = ends - np.array(row["doc_tokens"], dtype=np.int64)
                view = memoryview(ids)
                crc = [zlib.crc32(view[4 * a:4 * b]) for a, b in zip(begins.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_keys"], kind), pa.array(begins + row["start"]), pa.array(row["doc_tokens"], pa.int64()),
                     pa.array(crc, pa.int64())], names=schema.names)

    return shards.select(*used).mapInArrow(run, schema)
