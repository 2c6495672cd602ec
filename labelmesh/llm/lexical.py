"""Ranked lexical search: best positions over impact lists, shard by shard, with direct accesses."""

from __future__ import annotations

import math
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from labelmesh.llm.shipping import ship, small_batches
from labelmesh.runtime import cut_at, drop_path, shared_path

#: postings, and documents, after which a task closes a shard of the index
SHARD_POSTINGS, SHARD_DOCS = 1 << 20, 1 << 15
#: bytes of query texts that one pass over the documents serves
QUERY_BYTES = 8 << 20
#: bytes of text whose words are held at once
TEXT_BLOCK = 1 << 22
#: positions of each list that are read at first and at most between two looks at the threshold
STEP, MOST_STEP = 8, 512

_KEPT = frozenset((string.ascii_letters + string.digits).encode()) | frozenset(range(0x80, 0x100))
#: bytes of terms in lower case (A-Z only), all others as spaces; bytes from 0x80 on belong to characters above 0x7F
_FOLD = bytes(b if b in _KEPT else 0x20 for b in range(256)).lower()


def blocks_of_terms(text: str | None) -> Iterator[list[bytes]]:
    """The whole text's terms in order, some at a time."""
    data = (text or "").encode().translate(_FOLD)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + TEXT_BLOCK)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def term_counts(text: str | None) -> Counter[bytes]:
    counts: Counter[bytes] = Counter()
    for terms in blocks_of_terms(text):
        counts.update(terms)
    return counts


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Queries:
    """A block of queries: their terms numbered, and for each query its numbers and how often it has each."""

    def __init__(self, items: list[tuple[object, str | None]]):
        self.vocabulary: dict[bytes, int] = {}
        self.items, self.terms, self.repeats = [], [], []
        for item, text in items:
            counts = term_counts(text)
            if counts:
                self.items.append(item)
                self.terms.append(np.array([self.vocabulary.setdefault(t, len(self.vocabulary)) for t in counts], dtype=np.int64))
                self.repeats.append(np.array(list(counts.values()), dtype=np.int64))


_SHARD = ["docs", "total", "keys", "terms", "df", "sizes", "owners", "tfs"]


def _index(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Shards of the index of ``docs`` (key, text): documents with a term and their terms' total, keys and sizes of those
    that hold a query's term, and the postings of each such term."""
    schema = T.StructType([
        T.StructField("docs", T.LongType()), T.StructField("total", T.LongType()), T.StructField("keys", T.ArrayType(docs.schema["key"].dataType)),
        T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("df", T.ArrayType(T.LongType())),
        *(T.StructField(c, T.BinaryType()) for c in ("sizes", "owners", "tfs"))])

    def run(batches):
        known = vocabulary.keys()
        n_docs = total = 0
        keys, sizes, terms, owners, tfs = [], [], [], [], []
        kind = None

        def flush():
            term = np.array(terms, dtype=np.int64)
            order = np.argsort(term, kind="stable")
            distinct, df = np.unique(term, return_counts=True)
            return pa.RecordBatch.from_arrays([
                pa.array([n_docs], pa.int64()), pa.array([total], pa.int64()), pa.array([keys], pa.list_(kind)),
                pa.array([distinct.tolist()], pa.list_(pa.int32())), pa.array([df.tolist()], pa.list_(pa.int64())),
                pa.array([np.array(sizes, dtype="<i8").tobytes()]), pa.array([np.array(owners, dtype="<i4")[order].tobytes()]),
                pa.array([np.array(tfs, dtype="<i8")[order].tobytes()])], names=_SHARD)

        for batch in batches:
            kind = batch.schema.field(0).type
            for key, text in zip(batch.column(0), batch.column(1)):
                counts = term_counts(text.as_py())
                if not counts:
                    continue
                size = counts.total()
                n_docs, total = n_docs + 1, total + size
                found = counts.keys() & known
                if found:
                    terms += [vocabulary[t] for t in found]
                    tfs += [counts[t] for t in found]
                    owners += [len(keys)] * len(found)
                    keys.append(key.as_py())
                    sizes.append(size)
                    if len(terms) >= SHARD_POSTINGS or len(keys) >= SHARD_DOCS:
                        yield flush()
                        n_docs = total = 0
                        keys, sizes, terms, owners, tfs = [], [], [], [], []
        if n_docs:
            yield flush()

    return docs.mapInArrow(run, schema)


class Shard:
    """Impact lists, best first, and direct access from a document and a term to a place in the term's list."""

    def __init__(self, terms: np.ndarray, df: np.ndarray, sizes: np.ndarray, owners: np.ndarray, tfs: np.ndarray, n_docs: int, total: int, weights: np.ndarray):
        m = 100 - 75 + 75 * sizes * n_docs // total
        ends = np.cumsum(df)
        self.start = dict(zip(terms.tolist(), (ends - df).tolist()))
        self.count = dict(zip(terms.tolist(), df.tolist()))
        of = np.repeat(terms, df)
        impact = weights[of] * (1_000_000_000 * tfs // (1000 * tfs + 8 * m[owners]))
        order = np.lexsort((owners, -impact, np.repeat(np.arange(len(terms)), df)))
        self.impact, self.doc = impact[order], owners[order].astype(np.int64)
        self.n_terms, self.n_docs = len(weights), len(sizes)
        places = self.doc * self.n_terms + of
        self.by_place = np.argsort(places, kind="stable")
        self.places = places[self.by_place]

    def direct(self, docs: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """Place in each term's list, -1 where the document lacks the term: a row for each document."""
        wanted = docs[:, None] * self.n_terms + terms[None, :]
        at = np.minimum(np.searchsorted(self.places, wanted), len(self.places) - 1)
        return np.where(self.places[at] == wanted, self.by_place[at], -1)


class Best:
    """The k best (score, key) so far; equal scores by ascending key, null last."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    @property
    def kth(self) -> int:
        """Score that a further document must at least have."""
        return self.rows[-1][0] if len(self.rows) == self.k else 1

    def add(self, scores: list[int], keys: list) -> None:
        self.rows = sorted([*self.rows, *zip(scores, keys)], key=lambda r: (-r[0], r[1] is None, r[1]))[:self.k]


def best_positions(shard: Shard, keys: list, terms: np.ndarray, repeats: np.ndarray, best: Best) -> int:
    """Adds the shard's best documents for one query to ``best``; returns how many documents it looked at.

    Every list is read from its best impact on. A document that turns up is scored at once through direct accesses, which
    mark its place in all lists. A list's best position ends the stretch from the top of which every place is marked, by
    either kind of access; a document not yet seen lies behind it in each list. So the impacts there bound its score, and
    reading stops when their sum is strictly below the kth score: an equal one could still win by its key.
    """
    held = [i for i, t in enumerate(terms.tolist()) if t in shard.start]
    if not held:
        return 0
    terms, repeats = terms[held], repeats[held]
    start = np.array([shard.start[t] for t in terms.tolist()])
    size = np.array([shard.count[t] for t in terms.tolist()])
    seen = [np.zeros(n + 1, dtype=bool) for n in size.tolist()]  # the place past the end is never seen
    done = np.zeros(shard.n_docs, dtype=bool)
    front = np.zeros(len(terms), dtype=np.int64)  # first place not seen: one past the best position
    step, looked = STEP, 0
    while True:
        left = front < size
        bound = int((repeats[left] * shard.impact[start[left] + front[left]]).sum())
        if bound < best.kth:  # also when all lists have ended, as kth is 1 at least
            return looked
        spans = [shard.doc[s + f:s + min(f + step, n)] for s, f, n in zip(start[left].tolist(), front[left].tolist(), size[left].tolist())]
        docs = np.unique(np.concatenate(spans))
        docs = docs[~done[docs]]
        done[docs] = True
        looked += len(docs)
        places = shard.direct(docs, terms)
        hit = places >= 0
        scores = (np.where(hit, shard.impact[places], 0) * repeats).sum(axis=1)
        for j, (s, marks) in enumerate(zip(start.tolist(), seen)):
            marks[places[hit[:, j], j] - s] = True
            if left[j]:
                front[j] += int(np.argmin(marks[front[j]:]))
        good = np.flatnonzero(scores >= best.kth)
        if len(good) > best.k:  # ties at the kth score stay
            least = np.partition(scores[good], len(good) - best.k)[len(good) - best.k]
            good = good[scores[good] >= least]
        if len(good):
            best.add(scores[good].tolist(), [keys[d] for d in docs[good].tolist()])
        step = min(2 * step, MOST_STEP)


def _search(shards: DataFrame, queries: Queries, weights: np.ndarray, n_docs: int, total: int, k: int, item: T.StructField, key: T.DataType) -> DataFrame:
    """Up to k (query, item_id, key, score) of each query from each task; a task's later shards profit from its earlier ones."""
    schema = T.StructType([T.StructField("query", T.IntegerType()), T.StructField("item_id", item.dataType), T.StructField("key", key), T.StructField("score", T.LongType())])

    def run(batches):
        best = [Best(k) for _ in queries.items]
        kind = None
        for batch in batches:
            kind = batch.schema.field(2).type.value_type
            for at in range(batch.num_rows):
                row = {name: column[at] for name, column in zip(_SHARD, batch.columns)}
                keys = row["keys"].as_py()
                if not keys:
                    continue
                ints = lambda name, t: np.frombuffer(row[name].as_buffer(), dtype=t).astype(np.int64)  # noqa: E731,B023
                shard = Shard(row["terms"].values.to_numpy().astype(np.int64), row["df"].values.to_numpy(), ints("sizes", "<i8"), ints("owners", "<i4"),
                              ints("tfs", "<i8"), n_docs, total, weights)
                for terms, repeats, found in zip(queries.terms, queries.repeats, best):
                    best_positions(shard, keys, terms, repeats, found)
        rows = [(q, queries.items[q], key, score) for q, found in enumerate(best) for score, key in found.rows]
        if rows:
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int32()), pa.array(columns[1], _arrow(item.dataType)), pa.array(columns[2], kind), pa.array(columns[3], pa.int64())],
                names=schema.names)

    return shards.select(*_SHARD).mapInArrow(run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def search(docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The ``k`` best documents of each item: item, ``rank`` from 1, key and ``score``.

    The items are the stated queries: blocks of them, bounded in bytes, go to every task, a pass over the documents each.
    A pass writes shards of an index that holds the items' terms only, with document counts and sizes; their sums give the
    weights; then each task runs best positions over its shards' impact lists and gives k rows an item. Only these meet
    in a shuffle. The index is removed once the result, k rows an item, is written.

    Null texts and texts without terms are no documents and no queries; a null key is a document and comes last among
    equal scores; rows that repeat a key are documents of their own; items equal in id and text are one, others of one id
    are ranked apart; other columns are not read; without documents or items there are no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    asked = items.select(F.col(item).alias("item"), F.col(item_text).cast("string").alias("text")).filter(F.col("text").isNotNull()).distinct()
    blocks = -(-(asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // QUERY_BYTES)
    results = []
    for block in range(blocks):
        mine = asked.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block)
        queries = Queries([(r.item, r.text) for r in mine.orderBy("item", "text").collect()])
        folder = shared_path(spark, "lexical-index")
        with small_batches(spark):
            shards = cut_at(_index(rows, queries.vocabulary), folder)
        n_docs, total = shards.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
        weights = np.zeros(len(queries.vocabulary), dtype=np.int64)
        for r in shards.select(F.explode(F.arrays_zip("terms", "df")).alias("t")).groupBy("t.terms").agg(F.sum("t.df").alias("df")).collect():
            weights[r.terms] = term_weight(n_docs, r.df)
        with _few_rows(spark):
            found = _search(shards, queries, weights, n_docs, total, k, T.StructField("item", asked.schema["item"].dataType), rows.schema["key"].dataType)
            order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("key").asc_nulls_last())
            top = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            results.append(cut_at(top.select("item_id", "rank", "key", "score"), shared_path(spark, "lexical-best")))
        drop_path(spark, folder)
    if not results:
        results = [asked.join(rows, F.lit(False)).select(F.col("item").alias("item_id"), F.lit(1).alias("rank"), "key", F.lit(0).cast("long").alias("score"))]
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out.select(F.col("item_id").alias(item), "rank", F.col("key").alias(key), "score")


def _few_rows(spark):
    """Shard rows are large, so few of them travel at once."""
    return small_batches(spark, 4)
