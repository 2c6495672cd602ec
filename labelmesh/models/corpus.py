"""Annotations, items and features laid out once for many iterations."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from labelmesh.functions import arrays
from labelmesh.operators import joins
from labelmesh.runtime import Rolling, drop_path, path_bytes, shared_path, stored_path
from labelmesh.skew import Spread


#: bytes of a stored table that one bucket of its layout holds, about
BUCKET_BYTES = 128 << 20


#: folders of layouts by item without split items; joins on the item read such a table as it lies
_by_item: dict[str, int] = {}


def laid_by_item(df: DataFrame) -> int:
    """The number of buckets if ``df`` reads one table that lies in buckets by item, else 0."""
    folders = {f.rsplit("/", 2)[-2] for f in df.inputFiles()}
    return _by_item.get(folders.pop(), 0) if len(folders) == 1 else 0


def lay_out(rows: DataFrame, parts: int, on: list[str]) -> "Layout":
    """Stores rows, which are dealt by ``on`` over ``parts`` tasks already, in as many buckets."""
    spark = rows.sparkSession
    name, path = f"labelmesh_{uuid.uuid4().hex}", shared_path(spark, "layout")
    rows.write.bucketBy(parts, *on).option("path", path).format("parquet").saveAsTable(name)
    if on == ["item_id"]:
        _by_item[path.rsplit("/", 1)[-1]] = parts
    return Layout(name, path, spark.table(name))


class LaidRolling(Rolling):
    """Generations that lie in buckets by item; each is pushed as rows dealt by item over ``parts`` tasks already."""

    def __init__(self, name: str, parts: int, keep: int = 2):
        super().__init__(name, keep)
        self.parts, self.laid = parts, []

    def push(self, df: DataFrame) -> DataFrame:
        self.laid.append(lay_out(df, self.parts, ["item_id"]))
        self.generations.append((self.laid[-1].table, self.laid[-1].path))
        if len(self.laid) > self.keep:
            self.generations.pop(0)
            self.laid.pop(0).drop()
        return self.last

    def drop(self) -> None:
        for layout in self.laid:
            layout.drop()
        self.laid.clear()
        self.generations.clear()


@dataclass
class Layout:
    """A table in buckets by item, hot items split; joins on the item read it as it lies."""

    name: str
    path: str
    table: DataFrame

    @classmethod
    def of(cls, df: DataFrame, stored: str, spread: Spread) -> "Layout":
        """``stored``: path of ``df``, whose size decides the number of buckets; at least as many as a shuffle has
        partitions, or Spark would rather shuffle both sides of a join."""
        spark = df.sparkSession
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-path_bytes(spark, stored) // BUCKET_BYTES))
        return lay_out(spread.big(df).repartition(parts, *spread.on), parts, spread.on)

    def drop(self) -> None:
        spark = self.table.sparkSession
        spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        _by_item.pop(self.path.rsplit("/", 1)[-1], None)
        drop_path(spark, self.path)


@dataclass
class Corpus:
    n_labels: int
    n_annotators: int
    items: DataFrame
    annotations: DataFrame
    cells: int
    by_item: Spread
    held: Rolling
    by_cell: Spread | None = None
    features: DataFrame | None = None
    n_features: int = 0
    by_item_features: Spread | None = None
    by_feature: Spread | None = None
    layouts: list[Layout] = field(default_factory=list)

    @classmethod
    def build(cls, annotations: DataFrame, items: DataFrame, n_labels: int, features: DataFrame | None = None,
              rows_per_split: int | None = None, written: bool = False) -> "Corpus":
        """``written``: the features are a stored table already, so they need no copy of their own. Features that lie in
        buckets by item are read as they lie."""
        held = Rolling("corpus", keep=3)
        plain = held.push(annotations)
        items = held.push(items.select("item_id").distinct())
        per_annotator = plain.select("annotator_id", "label").distinct().groupBy("annotator_id").count()
        sizes = per_annotator.agg(F.count(F.lit(1)).alias("j"), F.sum("count").alias("cells")).first()
        by_item = Spread.plan(plain, ["item_id"], ["annotator_id", "label"], rows_per_split)
        laid = Layout.of(plain, held.generations[0][1], by_item)
        corpus = cls(n_labels, sizes["j"], items, laid.table, sizes["cells"], by_item, held, layouts=[laid])
        if not joins.fits_broadcast(sizes["cells"], 8 * n_labels + 64):
            corpus.by_cell = Spread.with_counts(plain, ["annotator_id", "label"], ["item_id"], rows_per_split)
        if features is not None:
            laid = laid_by_item(features)
            bag = features if written or laid else held.push(features.select("item_id", "feature", "value"))
            corpus.n_features = bag.agg(F.countDistinct("feature")).first()[0]
            corpus.by_item_features = Spread.plan(bag, ["item_id"], ["feature"], rows_per_split)
            if laid and corpus.by_item_features.hot is None:
                corpus.features = bag
            else:
                corpus.layouts.append(Layout.of(bag, stored_path(bag), corpus.by_item_features))
                corpus.features = corpus.layouts[-1].table
            if not joins.fits_broadcast(corpus.n_features, 8 * n_labels + 64):
                corpus.by_feature = Spread.with_counts(bag, ["feature"], ["item_id"], rows_per_split)
        return corpus

    def annotators(self) -> DataFrame:
        return self.annotations.select("annotator_id").distinct()

    def vote_start(self, smoothing: float = 1e-6) -> DataFrame:
        from labelmesh.operators.votes import smoothed_majority

        return smoothed_majority(self.annotations, self.items, self.n_labels, self.n_annotators, smoothing)

    def soft_confusion(self, posterior: DataFrame) -> DataFrame:
        return self._count(self.annotations, posterior, self.by_item, ["annotator_id", "label"], "n")

    def soft_vocab(self, posterior: DataFrame) -> DataFrame:
        return self._count(self.features, posterior, self.by_item_features, ["feature"], "value")

    def _count(self, rows, posterior, spread, keys, amount):
        """``rows`` already carry their sub-key, only the posterior is repeated for hot items."""
        joined = rows.join(spread.small(posterior).hint("shuffle_hash"), spread.on)
        return joined.groupBy(*keys).agg(
            arrays.sum_scaled("p", amount, self.n_labels).alias("c")
        )

    def annotation_terms(self, weights: DataFrame) -> DataFrame:
        rows = self.annotations.drop("_split")
        return joins.annotation_terms(rows, weights, self.n_labels, self.cells, self.by_cell)

    def feature_terms(self, weights: DataFrame) -> DataFrame:
        rows = self.features.drop("_split")
        return joins.feature_terms(rows, weights, self.n_labels, self.n_features, self.by_feature)

    def item_evidence(self, *terms: DataFrame) -> DataFrame:
        """All items with their summed terms (zero without any): one shuffle for all sources together."""
        every = terms[0]
        for t in terms[1:]:
            every = every.unionByName(t)
        summed = joins.sum_terms(every, self.n_labels)
        return self.items.join(summed, "item_id", "left").withColumn(
            "evidence", F.expr(f"coalesce(evidence, {arrays.zeros(self.n_labels)})")
        )

    def release(self) -> None:
        """Remove the layout and the stored copies once the results no longer read them."""
        for layout in self.layouts:
            layout.drop()
        self.held.drop()
