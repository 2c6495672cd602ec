"""Exact splitting of hot join keys.

A key whose group on the large side exceeds ``rows_per_split`` rows is cut into several sub-keys. Only
those keys' rows on the small side are repeated, once per sub-key, so the join result is unchanged while
no task receives more than about ``rows_per_split`` rows of one key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from labelmesh.runtime import cut, fits_broadcast

#: At most total_rows / ROWS_PER_SPLIT keys can be hot.
ROWS_PER_SPLIT = 2_000_000


@dataclass
class Spread:
    keys: list[str]
    by: list[str]
    hot: DataFrame | None
    rows: int = 0
    counts: DataFrame | None = None

    @classmethod
    def plan(cls, big: DataFrame, keys: list[str], by: list[str], rows_per_split: int | None = None) -> "Spread":
        return cls.of_counts(big.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")), keys, by, rows_per_split or ROWS_PER_SPLIT)

    @classmethod
    def of_counts(cls, counts: DataFrame, keys: list[str], by: list[str], limit: int = ROWS_PER_SPLIT, kept: bool = False) -> "Spread":
        """``counts``: (keys, _rows), ``kept`` with the plan for :meth:`frequent`."""
        hot = counts.filter(F.col("_rows") > limit).select(*keys, F.ceil(F.col("_rows") / limit).cast("int").alias("_splits"))
        counts = counts if kept else None
        if hot.isEmpty():
            return cls(keys, by, None, counts=counts)
        stored = cut(hot, "hot_keys")
        return cls(keys, by, stored, stored.count(), counts)

    @classmethod
    def with_counts(cls, big: DataFrame, keys: list[str], by: list[str], rows_per_split: int | None = None) -> "Spread":
        """A plan that also knows the rows of every key."""
        counts = cut(big.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")), "key_counts")
        return cls.of_counts(counts, keys, by, rows_per_split or ROWS_PER_SPLIT, True)

    def frequent(self, most: int) -> DataFrame | None:
        """At most ``most`` keys, those with the most rows: all that have as many rows as the last of them."""
        sizes = self.counts.groupBy("_rows").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("_rows")).collect()
        taken, least = 0, None
        for r in sizes:
            if taken + r["n"] > most:
                break
            taken, least = taken + r["n"], r["_rows"]
        return None if least is None else self.counts.filter(F.col("_rows") >= least).select(*self.keys)

    @property
    def table(self) -> DataFrame:
        """The hot keys, broadcast where their counted number allows it."""
        return F.broadcast(self.hot) if fits_broadcast(self.rows, 16 + 32 * len(self.keys)) else self.hot

    @property
    def on(self) -> list[str]:
        return self.keys if self.hot is None else [*self.keys, "_split"]

    def big(self, df: DataFrame) -> DataFrame:
        """Tag each row of the large side with its sub-key."""
        if self.hot is None:
            return df
        return (
            df.join(self.table, self.keys, "left")
            .withColumn("_split", F.pmod(F.xxhash64(*self.by), F.coalesce("_splits", F.lit(1))).cast("int"))
            .drop("_splits")
        )

    def small(self, df: DataFrame) -> DataFrame:
        """Repeat the small side's hot rows once per sub-key."""
        if self.hot is None:
            return df
        return (
            df.join(self.table, self.keys, "left")
            .withColumn("_split", F.explode(F.sequence(F.lit(0), F.coalesce("_splits", F.lit(1)) - 1)))
            .drop("_splits")
        )

    def join(self, big: DataFrame, small: DataFrame, how: str = "inner") -> DataFrame:
        return self.big(big).join(self.small(small), self.on, how).drop("_split")
