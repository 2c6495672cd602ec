"""Exact nearest neighbours by cosine, through cells around pivots.

On unit vectors the cosine orders like the distance, which obeys the triangle inequality. Every item lies in the cell of
its nearest pivot, at a known distance from it. What a source can find in a cell is then bounded by its own distance to
the pivot and the cell's smallest and largest radius, and by how much nearer another pivot is. A source first visits its
closest cells until they hold as many items as it wants; the last of the best of these limits its radius, and a second
round visits the other cells that the radius reaches. Inside a cell only items whose distance from the pivot fits are
compared. Nothing is left out that could be among the nearest; how much is saved depends on how the vectors lie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T

from labelmesh.runtime import cut

#: items of a cell, on average, pivots at least (where there are so many items) and at most, and items of one task's piece of a cell
CELL_ROWS, LEAST_PIVOTS, MOST_PIVOTS, PIECE_ROWS = 2048, 16, 1024, 8192
#: cosines that differ by less are ordered by item; bounds leave that much room
NEAR = 1e-8


def nearest(sources: DataFrame, items: DataFrame) -> DataFrame:
    """(source_id, item_id, cosine, rank): each source's ``k`` nearest items, by cosine to nine places, then item id.

    ``sources`` (source_id, location, k), ids unique; k null or below one keeps every item, ranked 0. ``items``
    (item_id, location). Locations that are null, hold null or non-finite numbers, are zero or of another length than
    the items' first pivot have no cosine and give no rows.
    """
    found, _ = visits(sources, items)
    wanted = found.join(sources.select("source_id", F.when(F.col("k") >= 1, F.col("k")).alias("_k")), "source_id")
    best = Window.partitionBy("source_id").orderBy(F.desc(F.round("cosine", 9)), F.asc("item_id"))
    limited = wanted.filter("_k IS NOT NULL").withColumn("rank", F.row_number().over(best)).filter("rank <= _k")
    return limited.unionByName(wanted.filter("_k IS NULL").withColumn("rank", F.lit(0))).drop("_k")


def visits(sources: DataFrame, items: DataFrame) -> tuple[DataFrame, int]:
    """All (source_id, item_id, cosine) that may be among the nearest, and the number of pairs that were compared."""
    spark = items.sparkSession
    source_type, item_type = sources.schema["source_id"].dataType, items.schema["item_id"].dataType
    nothing = spark.createDataFrame([], T.StructType([T.StructField("source_id", source_type), T.StructField("item_id", item_type), T.StructField("cosine", T.DoubleType())]))
    pivots = _pivots(items)
    if pivots is None:
        return nothing, 0
    unit = _unit(pivots.shape[1])

    def place(batches: Iterator) -> Iterator:
        for batch in batches:
            rows, vectors = unit(batch.column(1))
            if len(rows):
                apart = np.sqrt(np.maximum(2 - 2 * vectors @ pivots.T, 0))
                cell = apart.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), pa.array(cell.astype(np.int32)), pa.array(apart[np.arange(len(rows)), cell]),
                     pa.array([v.tobytes() for v in vectors], pa.binary())], names=["item_id", "cell", "r", "v"])

    located = items.select("item_id", F.col("location").cast("array<double>"))
    schema = T.StructType([T.StructField("item_id", item_type)]).add("cell", "integer").add("r", "double").add("v", "binary")
    placed = cut(located.mapInArrow(place, schema), "neighbor-cells")
    count, low, high = np.zeros(len(pivots), dtype=np.int64), np.zeros(len(pivots)), np.zeros(len(pivots))
    for row in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("low"), F.max("r").alias("high")).collect():
        count[row.cell], low[row.cell], high[row.cell] = row.n, row.low, row.high
    pieces = np.maximum(1, -(-count // PIECE_ROWS))

    def bounds(vector: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distance to every pivot, and the least distance that an item of its cell can have."""
        apart = np.sqrt(np.maximum(2 - 2 * pivots @ vector, 0))
        return apart, np.maximum.reduce([apart - high, low - apart, (apart - apart.min()) / 2, np.zeros(len(apart))])

    def send(first: bool):
        def run(batches: Iterator) -> Iterator:
            for batch in batches:
                rows, vectors = unit(batch.column(1))
                ks, limits = batch.column(2).to_pylist(), batch.column(3).to_pylist()
                out = []
                for row, vector in zip(rows.tolist(), vectors):
                    apart, least = bounds(vector)
                    order = np.argsort(least, kind="stable")
                    order = order[count[order] > 0]
                    k = ks[row]
                    near = len(order) if k is None or k < 1 else int(np.searchsorted(np.cumsum(count[order]), k)) + 1
                    if first:
                        chosen, reach = order[:near], np.inf
                    else:  # without a kth cosine everything is within reach
                        reach = np.inf if limits[row] is None else np.sqrt(max(0.0, 2 - 2 * (limits[row] - NEAR))) + NEAR
                        chosen = order[near:][least[order[near:]] <= reach]
                    out += [(row, c, piece, apart[c], reach, vector.tobytes()) for c in chosen.tolist() for piece in range(pieces[c])]
                if out:
                    row, cell, piece, apart, reach, v = zip(*out)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cell, pa.int32()), pa.array(piece, pa.int32()), batch.column(0).take(pa.array(row)), batch.column(2).take(pa.array(row)).cast(pa.int32()),
                         pa.array(apart, pa.float64()), pa.array(reach, pa.float64()), pa.array(v, pa.binary())],
                        names=["cell", "piece", "source_id", "k", "apart", "reach", "v"])
        return run

    asked = sources.select("source_id", F.col("location").cast("array<double>").alias("location"), F.col("k").cast("int").alias("k"))
    way = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("piece", T.IntegerType()), T.StructField("source_id", source_type)]).add(
        "k", "integer").add("apart", "double").add("reach", "double").add("v", "binary")
    once = asked.withColumn("limit", F.lit(None).cast("double")).mapInArrow(send(True), way)
    found = cut(_meet(once, placed, pieces, item_type, source_type), "neighbors-first")
    mine = found.filter("cosine IS NOT NULL").join(asked.filter("k >= 1").select("source_id", "k"), "source_id")
    ranked = mine.withColumn("nth", F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("cosine"))))
    kth = ranked.filter("nth = k").select("source_id", F.col("cosine").alias("limit"))
    again = asked.filter("k >= 1").join(kth, "source_id", "left").select("source_id", "location", "k", "limit").mapInArrow(send(False), way)
    more = cut(_meet(again, placed, pieces, item_type, source_type), "neighbors-second")
    every = found.unionByName(more)
    pairs = every.agg(F.sum("pairs")).first()[0] or 0
    return every.filter("cosine IS NOT NULL").select("source_id", "item_id", "cosine"), pairs


def _pivots(items: DataFrame) -> np.ndarray | None:
    """Unit vectors of some items, drawn by hash: about one for ``CELL_ROWS`` items."""
    usable = items.filter(F.expr("aggregate(location, 0D, (a, x) -> a + abs(cast(x AS double))) > 0"))
    n = usable.count()
    most = min(n, MOST_PIVOTS, max(LEAST_PIVOTS, -(-n // CELL_ROWS)))
    drawn = usable.orderBy(F.xxhash64(F.lit("pivot"), "item_id"), "item_id").limit(most).select("location").collect() if n else []
    size = len(drawn[0][0]) if drawn else 0
    rows, vectors = _unit(size)(pa.array([r[0] for r in drawn], pa.list_(pa.float64())))
    return np.unique(vectors, axis=0) if len(rows) else None


def _unit(size: int):
    """A function from an Arrow list array to the places and unit vectors of its usable rows; it travels to workers."""
    def unit(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        rows, vectors = [], []
        for i, value in enumerate(column):
            vector = np.array(value.values.to_numpy(zero_copy_only=False) if value.is_valid else [], dtype=np.float64)
            if len(vector) == size and size and np.isfinite(vector).all():
                vector = vector / (np.abs(vector).max() or 1.0)
                length = np.linalg.norm(vector)
                if length > 0:
                    rows.append(i)
                    vectors.append(vector / length)
        return np.array(rows, dtype=np.int64), np.array(vectors).reshape(len(rows), size)

    return unit


def _meet(visits: DataFrame, placed: DataFrame, pieces: np.ndarray, item_type: T.DataType, source_type: T.DataType) -> DataFrame:
    """(source_id, item_id, cosine, pairs): the best of each visit to a piece of a cell; ``pairs`` on the visit's first row.

    Both sides are dealt by piece, items first, so a task holds one piece and reads its visits as they come.
    """
    piece = F.pmod(F.xxhash64("item_id"), F.element_at(F.array(*(F.lit(int(n)) for n in pieces)), F.col("cell") + 1)).cast("int")
    here = placed.select("cell", piece.alias("piece"), F.lit(0).alias("side"), "item_id", F.lit(None).cast(source_type).alias("source_id"),
                         F.lit(None).cast("int").alias("k"), F.col("r").alias("apart"), F.lit(None).cast("double").alias("reach"), "v")
    come = visits.select("cell", "piece", F.lit(1).alias("side"), F.lit(None).cast(item_type).alias("item_id"), "source_id", "k", "apart", "reach", "v")
    room = NEAR

    def run(batches: Iterator) -> Iterator:
        place, held, ids, radius, vectors = None, [], None, None, None
        kind = None

        def settle():
            order = np.argsort(np.concatenate([h[1] for h in held]), kind="stable")
            return (pa.concat_arrays([h[0] for h in held]).take(pa.array(order)), np.concatenate([h[1] for h in held])[order],
                    np.concatenate([h[2] for h in held])[order])

        for batch in batches:
            kind = batch.schema.field(3).type
            cell, part, side = (batch.column(i).to_numpy() for i in range(3))
            edges = np.flatnonzero(np.concatenate(([True], (cell[1:] != cell[:-1]) | (part[1:] != part[:-1]) | (side[1:] != side[:-1]), [True])))
            found = []
            for a, b in zip(edges.tolist(), edges[1:].tolist()):
                if (cell[a], part[a]) != place:
                    place, held, ids = (cell[a], part[a]), [], None
                matrix = np.frombuffer(b"".join(v.as_py() for v in batch.column(8)[a:b]), dtype=np.float64).reshape(b - a, -1)
                apart = batch.column(6)[a:b].to_numpy()
                if side[a] == 0:
                    held.append((batch.column(3)[a:b], apart, matrix))
                    continue
                if not held:
                    continue
                if ids is None:
                    ids, radius, vectors = settle()
                for i, (k, reach) in enumerate(zip(batch.column(5)[a:b].to_pylist(), batch.column(7)[a:b].to_pylist())):
                    low, high = np.searchsorted(radius, [apart[i] - reach - room, apart[i] + reach + room]) if np.isfinite(reach) else (0, len(radius))
                    cosine = vectors[low:high] @ matrix[i]
                    keep = np.flatnonzero(cosine >= 1 - (reach + room) ** 2 / 2 - room) if np.isfinite(reach) else np.arange(len(cosine))
                    names = ids.slice(low, high - low).take(pa.array(keep))
                    cosine = cosine[keep]
                    if k is not None and 0 < k < len(cosine):
                        table = pa.table({"c": np.round(cosine, 9), "i": names})
                        top = pc.sort_indices(table, sort_keys=[("c", "descending"), ("i", "ascending")], null_placement="at_start")[:k]
                        names, cosine = names.take(top), cosine[top.to_numpy()]
                    source = batch.column(4).slice(a + i, 1)
                    if len(cosine):
                        pairs = np.zeros(len(cosine), dtype=np.int64)
                        pairs[0] = high - low
                        found.append((source.take(pa.array(np.zeros(len(cosine), dtype=np.int64))), names, pa.array(cosine), pa.array(pairs)))
                    elif high > low:
                        found.append((source, pa.nulls(1, kind), pa.nulls(1, pa.float64()), pa.array([int(high - low)])))
            if found:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*found)], names=["source_id", "item_id", "cosine", "pairs"])

    schema = T.StructType([T.StructField("source_id", source_type), T.StructField("item_id", item_type)]).add("cosine", "double").add("pairs", "long")
    dealt = here.unionByName(come).repartition("cell", "piece").sortWithinPartitions("cell", "piece", "side")
    return dealt.mapInArrow(run, schema)
