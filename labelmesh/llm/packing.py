"""Packing documents into sequences: shortest pack first over the histogram of lengths."""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from labelmesh.llm.shipping import small_batches
from labelmesh.llm.tokens import AddedBpe, ByteBpe, once, publish, vocabulary
from labelmesh.runtime import cut

LENGTH = 1024


def shortest_pack_first(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns and how many sequences follow each.

    Lengths are placed longest first, each into the shortest pack that it still fits. All packs of one pattern move
    together: placing n pieces changes whole pattern counts and splits at most one, so there are at most two patterns
    for each length, however many pieces there are.
    """
    packs: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # by tokens in the pack
    totals: list[int] = []

    def put(pattern: tuple[int, ...], total: int, count: int) -> None:
        if total not in packs:
            packs[total] = []
            insort(totals, total)
        packs[total].append((pattern, count))

    for size in sorted((s for s in histogram if histogram[s]), reverse=True):
        left = histogram[size]
        while left:
            if totals and totals[0] + size <= length:
                total = totals[0]
                pattern, count = packs[total].pop()
                if not packs[total]:
                    del packs[total], totals[0]
                used = min(count, left)
                if used < count:
                    put(pattern, total, count - used)
                put(pattern + (size,), total + size, used)
                left -= used
            else:
                fill = min(length // size, left)
                many = left // fill
                put((size,) * fill, size * fill, many)
                left -= many * fill
    return [entry for total in totals for entry in packs[total]]


class Plan:
    """For each length, the runs of ranks that a slot of a pattern takes."""

    def __init__(self, patterns: list[tuple[tuple[int, ...], int]]):
        taken: dict[int, int] = {}
        runs: dict[int, list[tuple[int, int, int, int]]] = {}
        self.sequences = 0
        for pattern, count in patterns:
            offset = 0
            for size in pattern:
                start = taken.get(size, 0)
                runs.setdefault(size, []).append((start, self.sequences, offset, sum(pattern)))
                taken[size] = start + count
                offset += size
            self.sequences += count
        self.runs = {size: np.array(rows, dtype=np.int64) for size, rows in runs.items()}

    def place(self, size: int, rank: int) -> tuple[int, int, int]:
        """(sequence, offset in it, tokens in it) of the piece of this size and rank."""
        rows = self.runs[size]
        row = rows[bisect_right(rows[:, 0], rank) - 1]
        return int(row[1]) + rank - int(row[0]), int(row[2]), int(row[3])


def measure(
    docs: DataFrame, path: str | None, end_id: int, length: int, key: str, text: str, added: bool,
) -> DataFrame:
    """One row per document, no shuffle: key, tokens, checksum of every piece, and its place among equals in its task.

    ``full_before`` counts the full pieces before it in its task, ``twin`` the documents before it in its task whose
    last piece is as long (null if the last piece is full).
    """
    vocab = publish(docs.sparkSession, path or vocabulary("byte_bpe_50k.json"))
    kept = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    schema = (T.StructType([kept.schema["key"]]).add("doc_tokens", "long").add("crcs", T.ArrayType(T.LongType())).add("part", "integer")
              .add("full_before", "long").add("last", "integer").add("twin", "long"))

    def run(batches):
        bpe = once(AddedBpe if added else ByteBpe, vocab.value)
        part, full, seen = TaskContext.get().partitionId(), 0, [0] * length
        for batch in batches:
            sizes, crcs, fulls, lasts, twins = [], [], [], [], []
            ids, counts = bpe.encode_all(batch.column(1), end_id)
            upto = 0
            for tokens in counts.tolist():
                begin, upto = upto, upto + tokens
                sizes.append(tokens)
                crcs.append([zlib.crc32(ids[at:min(at + length, upto)]) for at in range(begin, upto, length)])
                last = tokens % length
                fulls.append(full)
                lasts.append(last)
                twins.append(seen[last] if last else None)
                full += tokens // length
                seen[last] += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(crcs, pa.list_(pa.int64())),
                 pa.array([part] * len(sizes), pa.int32()), pa.array(fulls, pa.int64()), pa.array(lasts, pa.int32()),
                 pa.array(twins, pa.int64())], names=schema.names)

    return kept.mapInArrow(run, schema)


def pack_documents(
    docs: DataFrame, path: str | None = None, end_id: int = 0, length: int = LENGTH, key: str = "doc_id", text: str = "text",
    added: bool = False,
) -> DataFrame:
    """One row per piece: key, ``start`` and ``length`` in its document's ids, checksum, ``sequence_id``, ``offset``.

    A document's ids (its text's, then ``end_id``) are cut every ``length`` ids; full pieces are sequences by
    themselves, last pieces are packed by ``shortest_pack_first`` over their histogram (``length`` counts at most).
    A piece finds its pattern by its rank among pieces as long: its place in the task that tokenised it plus the
    prefix sum of the tasks before. ``sequence_tokens`` are the ids in the sequence and ``padded_length`` what it
    is padded to: ``length``, or nothing more where the ids are a power of two.

    Null and empty texts have the end id alone; null keys and repeated rows are documents like any other; an empty
    table gives no rows; other columns are not read. With ``added`` the strings of added tokens inside a text give these
    tokens.
    """
    spark = docs.sparkSession
    with small_batches(spark):
        measured = cut(measure(docs, path, end_id, length, key, text, added), "packing-measured")
    counts = measured.groupBy("last", "part").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.size("crcs") - F.when(F.col("last") > 0, 1).otherwise(0)).alias("_full"))
    counts = cut(counts, "packing-counts")
    histogram = {r["last"]: r["n"] for r in counts.filter("last > 0").groupBy("last").agg(F.sum("_n").alias("n")).collect()}
    plan = Plan(shortest_pack_first(histogram, length))
    runs = spark.sparkContext.broadcast(plan)
    before = Window.partitionBy("last").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.select("last", "part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_rank"))
    tasks = counts.groupBy("part").agg(F.sum("_full").alias("_full"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    fulls = tasks.select("part", (F.coalesce(F.sum("_full").over(order), F.lit(0)) + F.lit(plan.sequences)).alias("_first"))
    placed = measured.join(ranks, ["last", "part"]).join(fulls, "part").select(
        "key", "doc_tokens", "crcs", "last", (F.col("_rank") + F.col("twin")).alias("rank"),
        (F.col("_first") + F.col("full_before")).alias("first"))
    schema = T.StructType([T.StructField(key, placed.schema["key"].dataType)])
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "padded_length"]
    for name in names:
        schema = schema.add(name, "long")

    def run(batches):
        plan = runs.value
        for batch in batches:
            keys, sizes, crcs, last, rank, first = batch.columns
            begins = crcs.offsets.to_numpy()
            pieces = np.diff(begins)
            doc = np.repeat(np.arange(len(pieces)), pieces)
            nth = np.arange(len(doc)) - np.repeat(begins[:-1] - begins[0], pieces)
            last, first = last.to_numpy(), first.to_numpy()
            size = np.full(len(doc), length, dtype=np.int64)
            sequence, offset, filled = first[doc] + nth, np.zeros(len(doc), dtype=np.int64), size.copy()
            ends = np.cumsum(pieces) - 1
            for i, (tail, r) in enumerate(zip(last.tolist(), rank.to_pylist())):
                if tail:
                    at = ends[i]
                    size[at] = tail
                    sequence[at], offset[at], filled[at] = plan.place(tail, r)
            power = (filled & (filled - 1)) == 0
            columns = [nth * length, size, crcs.values.to_numpy()[begins[0]:begins[-1]], sizes.to_numpy()[doc], sequence, offset,
                       filled, np.where(power, filled, length)]
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(doc)), *(pa.array(c, pa.int64()) for c in columns)], names=schema.names)

    return placed.mapInArrow(run, schema)
