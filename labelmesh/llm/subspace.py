"""Near-duplicate embeddings: a pigeonhole join over low-dimensional blocks of rotated vectors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from labelmesh.llm.components import components, smallest_key
from labelmesh.llm.shipping import ship
from labelmesh.runtime import cut

#: dimensions of a block; vectors that a cell should hold; most cells of a block; vectors that find the cells
BLOCK, CELL_ROWS, MOST_CELLS, SAMPLE_ROWS = 8, 1024, 1024, 4096
#: vectors of a cell's piece, of a batch of visitors, and pairs checked at once
PIECE, VISITORS, PAIRS = 2048, 256, 50_000
#: added to budgets against rounding
SLACK = 1e-9


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one. A power of two is taken out first, exactly, so no square overflows or vanishes."""
    _, power = np.frexp(np.abs(vectors).max(axis=1, keepdims=True))
    scaled = np.ldexp(vectors, -power)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


@dataclass
class Space:
    """A rotation, its blocks with their share of the squared distance, and cells (Voronoi) inside each block."""

    limit: float
    rotation: np.ndarray
    bounds: list[tuple[int, int]]
    budgets: np.ndarray
    centers: list[np.ndarray]

    def rotate(self, vectors: np.ndarray) -> np.ndarray:
        """Unit vectors in rotated coordinates; every row's result depends on that row alone."""
        unit = unit_rows(vectors)
        out = np.empty_like(unit)
        for at in range(0, len(unit), 128):
            out[at:at + 128] = (unit[at:at + 128, None, :] * self.rotation).sum(axis=2)
        return out

    def cells(self, rotated: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
        """Home cell of each vector, and a matrix of the cells that a vector within the block's budget may call home.

        Such a vector lies at most the budget's radius away, so the bisector of the two centers does too.
        """
        a, b = self.bounds[block]
        centers = self.centers[block]
        far = ((rotated[:, None, a:b] - centers) ** 2).sum(axis=2)
        home = far.argmin(axis=1)
        own = far[np.arange(len(far)), home]
        apart = np.sqrt(((centers[:, None] - centers) ** 2).sum(axis=2))[home]
        near = far - own[:, None] <= 2 * apart * (np.sqrt(self.budgets[block]) + 1e-7) + SLACK
        return home, near


def make_space(sample: np.ndarray, rows: int, limit: float, seed: int = 11) -> Space:
    """Cells from a bounded sample of vectors; their number follows the number of rows."""
    size = sample.shape[1]
    rotation = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, size)))[0]
    blocks = max(1, size // BLOCK)
    edges = np.linspace(0, size, blocks + 1).astype(int)
    bounds = list(zip(edges[:-1].tolist(), edges[1:].tolist()))
    budgets = np.array([(2 - 2 * limit) * (b - a) / size for a, b in bounds])
    space = Space(limit, rotation, bounds, budgets, [])
    rotated = space.rotate(sample)
    k = max(1, min(MOST_CELLS, len(sample), -(-rows // CELL_ROWS)))
    for a, b in bounds:
        points = rotated[:, a:b]
        centers = np.unique(points[np.linspace(0, len(points) - 1, k).astype(int)], axis=0)
        for _ in range(8):
            mine = ((points[:, None] - centers) ** 2).sum(axis=2).argmin(axis=1) if len(centers) * len(points) < 1 << 23 else np.concatenate(
                [((points[at:at + 256, None] - centers) ** 2).sum(axis=2).argmin(axis=1) for at in range(0, len(points), 256)])
            full = np.bincount(mine, minlength=len(centers)) > 0
            centers = np.stack([np.bincount(mine, weights=points[:, d], minlength=len(centers))[full] / np.bincount(mine, minlength=len(centers))[full]
                                for d in range(b - a)], axis=1)
        space.centers.append(centers)
    return space


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


class _Cell:
    """The vectors at home in one piece of a cell, and what visitors have found so far."""

    def __init__(self, space: Space, block: int, nodes: np.ndarray, weights: np.ndarray, vectors: np.ndarray):
        self.space, self.block, self.nodes, self.weights = space, block, nodes, weights
        self.vectors = vectors
        self.unit = unit_rows(vectors)
        self.rotated = space.rotate(vectors)
        self.counts = np.zeros(len(nodes), dtype=np.int64)
        self.parent = np.arange(len(nodes))

    def _find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def links(self, rotated: np.ndarray, unit: np.ndarray, inside: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(visitor, home) of linked pairs whose first block within its budget is this one."""
        a, b = self.space.bounds[self.block]
        x, y = rotated[:, a:b], self.rotated[:, a:b]
        near = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * (x @ y.T) <= self.space.budgets[self.block] + 1e-7
        if inside is not None:  # these visitors are home rows themselves: each pair once
            near &= np.arange(len(self.nodes)) < (inside + np.arange(len(x)))[:, None]
        visitor, home = np.nonzero(near)
        keep = []
        starts = [lo for lo, _ in self.space.bounds]
        for at in range(0, len(visitor), PAIRS):
            p, q = visitor[at:at + PAIRS], home[at:at + PAIRS]
            spent = np.add.reduceat((rotated[p] - self.rotated[q]) ** 2, starts, axis=1) <= self.space.budgets + SLACK
            first = spent[:, self.block] & ~spent[:, :self.block].any(axis=1)
            first[first] = (unit[p[first]] * self.unit[q[first]]).sum(axis=1) >= self.space.limit
            keep.append(first)
        keep = np.concatenate(keep) if keep else np.empty(0, dtype=bool)
        return visitor[keep], home[keep]

    def _join(self, visitor: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Joins home rows that share a visitor; returns one (visitor, home) for each visitor with a link."""
        who, first = np.unique(visitor, return_index=True)
        lead = home[first][np.searchsorted(who, visitor)]
        for i, j in np.unique(np.stack((lead, home), axis=1), axis=0).tolist():
            a, b = self._find(i), self._find(j)
            if a != b:
                self.parent[max(a, b)] = min(a, b)
        return who, home[first]

    def inner(self) -> None:
        for at in range(0, len(self.nodes), VISITORS):
            part = slice(at, at + VISITORS)
            visitor, home = self.links(self.rotated[part], self.unit[part], at)
            visitor = visitor + at
            np.add.at(self.counts, visitor, self.weights[home])
            np.add.at(self.counts, home, self.weights[visitor])
            for i, j in zip(*self._join(visitor, home)):
                a, b = self._find(int(i)), self._find(int(j))
                if a != b:
                    self.parent[max(a, b)] = min(a, b)

    def visit(self, nodes: np.ndarray, weights: np.ndarray, vectors: np.ndarray):
        """Rows (a, b, n): links found for visitors, and one edge for each of them."""
        unit = unit_rows(vectors)
        visitor, home = self.links(self.space.rotate(vectors), unit)
        if not len(visitor):
            return []
        np.add.at(self.counts, home, weights[visitor])
        found = np.zeros(len(nodes), dtype=np.int64)
        np.add.at(found, visitor, self.weights[home])
        who, other = self._join(visitor, home)
        return [(nodes[who], self.nodes[other], found[who])]

    def rows(self):
        root = np.array([self._find(i) for i in range(len(self.nodes))], dtype=np.int64)
        use = (self.counts > 0) | (root != np.arange(len(root)))
        return [(self.nodes[use], self.nodes[root[use]], self.counts[use])] if use.any() else []


def _valid(vector) -> F.Column:
    """Arrays without null or non-finite components that are not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _links(nodes: DataFrame, size: int, limit: float) -> DataFrame:
    """(a, b, n): b is a node linked with a, directly or through others found in the same cell; the sum of n over rows
    of a is the weight of all nodes linked directly with it."""
    spark = nodes.sparkSession
    rows = nodes.count()
    sample = nodes.orderBy("node").select("vector").limit(SAMPLE_ROWS).toArrow().column(0).combine_chunks()
    space = make_space(_matrix(sample, size), rows, limit)
    shared = spark.sparkContext.broadcast(space)

    def homes(batches):
        space = shared.value
        for batch in batches:
            rotated = space.rotate(_matrix(batch.column(0), size))
            for block in range(len(space.bounds)):
                cell, n = np.unique(space.cells(rotated, block)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(cell), pa.int32()), pa.array(cell, pa.int32()), pa.array(n, pa.int64())], names=["block", "cell", "n"])

    # one number for each cell: at most MOST_CELLS for each block
    sizes = nodes.select("vector").mapInArrow(homes, "block int, cell int, n long").groupBy("block", "cell").agg(F.sum("n").alias("n")).collect()
    pieces = spark.sparkContext.broadcast({(r.block, r.cell): -(-r.n // PIECE) for r in sizes})

    def deal(batches):
        space, cut_into = shared.value, pieces.value
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                node = batch.column(0).to_numpy()
                rotated = space.rotate(_matrix(batch.column(2), size))
                picked, keys = [], []
                for block in range(len(space.bounds)):
                    home, near = space.cells(rotated, block)
                    for i, h in enumerate(home.tolist()):
                        own = int(node[i] % cut_into[block, h])
                        keys.append((block, h, own, 0))
                        picked.append(i)
                        for c in np.flatnonzero(near[i, :h]).tolist() + [h]:
                            for piece in range(own if c == h else cut_into.get((block, c), 0)):
                                keys.append((block, c, piece, 1))
                                picked.append(i)
                taken = batch.take(pa.array(picked))
                columns = [pa.array(k, pa.int32()) for k in zip(*keys)]
                yield pa.RecordBatch.from_arrays([*columns, *taken.columns], names=["block", "cell", "piece", "visits", "node", "weight", "vector"])

    kind = nodes.schema["vector"]
    schema = T.StructType([T.StructField(n, T.IntegerType()) for n in ("block", "cell", "piece", "visits")] + [
        T.StructField("node", T.LongType()), T.StructField("weight", T.LongType()), kind])
    dealt = nodes.select("node", "weight", "vector").mapInArrow(deal, schema)

    def meet(batches):
        space = shared.value
        key, cell, waiting = None, None, []

        def settle():
            nonlocal cell, waiting
            node, weight, vector = (np.concatenate(x) for x in zip(*waiting))
            cell, waiting = _Cell(space, key[0], node, weight, vector), []
            cell.inner()

        def emit(found):
            for a, b, n in found:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n)], names=["a", "b", "n"])

        for batch in batches:
            marks = np.stack([batch.column(i).to_numpy() for i in range(4)], axis=1)
            node, weight, vector = batch.column(4).to_numpy(), batch.column(5).to_numpy(), _matrix(batch.column(6), size)
            turns = np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1
            for lo, hi in zip([0, *turns], [*turns, len(marks)]):
                if key is None or tuple(marks[lo, :3]) != key:
                    if waiting:
                        settle()
                    if cell is not None:
                        yield from emit(cell.rows())
                    key, cell, waiting = tuple(marks[lo, :3].tolist()), None, []
                if marks[lo, 3] == 0:
                    waiting.append((node[lo:hi], weight[lo:hi], vector[lo:hi]))
                    continue
                if cell is None:
                    settle()
                for at in range(lo, hi, VISITORS):
                    part = slice(at, min(hi, at + VISITORS))
                    yield from emit(cell.visit(node[part], weight[part], vector[part]))
        if waiting:
            settle()
        if cell is not None:
            yield from emit(cell.rows())

    place = ["block", "cell", "piece"]
    return dealt.repartition(*place).sortWithinPartitions(*place, "visits").mapInArrow(meet, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, limit: float = 0.95, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per vector: key, ``n_links`` (other rows with cosine >= ``limit``), ``component_id`` and ``kept``.

    Equal vectors are one weighted node. Two unit vectors within the limit differ by at most 2 - 2 limit squared, so in
    some block of the rotated coordinates they differ by no more than its share. Every vector is at home in one cell of
    each block and visits those earlier cells that a vector within the share may live in; a pair is verified, in double
    precision, where both meet, and counted in the first block that allows it. Large cells are cut into pieces. Counts
    and a spanning forest leave a task, never all pairs.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of
    different lengths. Components may be as small or large as doubles go. Repeated rows are linked with each other. A null key counts as a vector but names a component
    only if all its keys are null. Other columns are not read, an empty table gives no rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).alias("vector"))
    valid = rows.filter(_valid(F.col("vector"))).select("key", "vector", F.xxhash64("vector").alias("node"))
    nodes = cut(valid.groupBy("node").agg(F.first("vector").alias("vector"), F.count(F.lit(1)).alias("weight")), "subspace-nodes")
    sizes = [r[0] for r in nodes.select(F.size("vector")).distinct().collect()]
    found = None
    for size in sizes:
        some = _links(nodes.filter(F.size("vector") == size), size, limit)
        found = some if found is None else found.unionByName(some)
    named = vectors.select(F.col(key).alias("key"), F.when(_valid(F.col(vector)), F.xxhash64(vector)).alias("node"))
    if found is None:
        return named.select(F.col("key").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"), F.lit(True).alias("kept"))
    found = cut(found, "subspace-links")
    roots, _ = components(found.select("a", "b"))
    links = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    own = named.filter("node IS NOT NULL")
    result = nodes.select("node", "weight").join(links, "node", "left").join(smallest_key(own, roots), "node").select(
        F.col("node").alias("_node"), (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")
    joined = named.join(result, named["node"] == result["_node"], "left")
    component = F.when(F.col("node").isNull(), F.col("key")).otherwise(F.col("component_id"))
    return joined.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"),
                         F.col("key").eqNullSafe(component).alias("kept"))
