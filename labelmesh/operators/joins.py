"""The joins behind every model: evidence for items, and soft counts for parameters.

Naming: ``weights`` tables carry one array ``w`` per (annotator_id, label) or per feature, indexed by the
true class; ``posterior`` is (item_id, p ARRAY<DOUBLE>).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from labelmesh.functions import arrays
from labelmesh.runtime import BROADCAST_BYTES, cut, fits_broadcast
from labelmesh.skew import Spread


def attach(big: DataFrame, table: DataFrame, keys: list[str], by: list[str], width: int, rows: int | None = None,
           spread: Spread | None = None, dealt: tuple[int, str] | None = None) -> DataFrame:
    """Join a parameter table onto a large table.

    Broadcasts only when the counted size is small; past that, the part of the table for the most frequent keys, and rows
    of other keys go through a shuffled join with hot keys split. ``dealt``: how ``big`` is dealt, rows that moved go back.
    """
    stored = rows is None
    if stored:
        table = cut(table, "parameters")
        rows = table.count()
    row_bytes = 8 * width + 32 * len(keys)
    if fits_broadcast(rows, row_bytes):
        return big.join(F.broadcast(table), keys)
    spread = spread if spread is not None and spread.counts is not None else Spread.with_counts(big, keys, by)
    frequent = spread.frequent(BROADCAST_BYTES // row_bytes)
    if frequent is None:
        moved = spread.join(big, table)
        return moved if dealt is None else moved.repartition(*dealt)
    if not stored:
        table = cut(table, "parameters")
    near = big.join(F.broadcast(table.join(F.broadcast(frequent), keys, "left_semi")), keys)
    far = spread.join(big.join(F.broadcast(frequent), keys, "left_anti"), table)
    return near.unionByName(far if dealt is None else far.repartition(*dealt))


def annotation_terms(annotations: DataFrame, weights: DataFrame, n_labels: int, rows: int | None = None,
                     spread: Spread | None = None) -> DataFrame:
    """Per annotation row: n * w[k]. Columns (item_id, e)."""
    joined = attach(annotations, weights, ["annotator_id", "label"], ["item_id"], n_labels, rows, spread)
    return joined.select("item_id", arrays.scaled("w", "n", n_labels).alias("e"))


def feature_terms(features: DataFrame, weights: DataFrame, n_labels: int, rows: int | None = None,
                  spread: Spread | None = None) -> DataFrame:
    """Per feature row: value * w[k]. Columns (item_id, e)."""
    joined = attach(features, weights, ["feature"], ["item_id"], n_labels, rows, spread)
    return joined.select("item_id", arrays.scaled("w", "value", n_labels).alias("e"))


def sum_terms(terms: DataFrame, n_labels: int) -> DataFrame:
    return terms.groupBy("item_id").agg(arrays.sum_arrays("e", n_labels).alias("evidence"))


def annotation_evidence(annotations: DataFrame, weights: DataFrame, n_labels: int) -> DataFrame:
    """Sum over an item's annotations of n * w[truth]."""
    return sum_terms(annotation_terms(annotations, weights, n_labels), n_labels)


def feature_evidence(features: DataFrame, weights: DataFrame, n_labels: int) -> DataFrame:
    return sum_terms(feature_terms(features, weights, n_labels), n_labels)


def soft_confusion(annotations: DataFrame, posterior: DataFrame, n_labels: int,
                   spread: Spread | None = None) -> DataFrame:
    """(annotator_id, label, c): c[k] = sum over items of n * p[k]. Items are the join key."""
    spread = spread or Spread.plan(annotations, ["item_id"], ["annotator_id", "label"])
    joined = spread.big(annotations).join(spread.small(posterior), spread.on)
    return joined.groupBy("annotator_id", "label").agg(
        arrays.sum_scaled("p", "n", n_labels).alias("c")
    )


def soft_vocab_counts(features: DataFrame, posterior: DataFrame, n_labels: int,
                      spread: Spread | None = None) -> DataFrame:
    """(feature, c): c[k] = sum over items of value * p[k]."""
    spread = spread or Spread.plan(features, ["item_id"], ["feature"])
    joined = spread.big(features).join(spread.small(posterior), spread.on)
    return joined.groupBy("feature").agg(
        arrays.sum_scaled("p", "value", n_labels).alias("c")
    )


def class_sums(posterior: DataFrame, n_labels: int) -> DataFrame:
    """One row: c[k] = sum over items of p[k]."""
    return posterior.agg(arrays.sum_arrays("p", n_labels).alias("c"))


def soft_machine_confusion(pairs: DataFrame, n_labels: int) -> DataFrame:
    """One row: c[k*K + m] = sum over items of p[k] * h[m]. Input has both arrays per item.

    Few classes are written out as K*K sums; many become rows (truth, m, product), combined before they move.
    """
    k = n_labels
    if k <= arrays.UNROLLED_CLASSES:
        return pairs.agg(F.expr(arrays.array([f"sum(p[{a}] * h[{m}])" for a in range(k) for m in range(k)])).alias("c"))
    long = pairs.select(F.posexplode("p").alias("a", "_p"), "h").select("a", "_p", F.posexplode("h").alias("m", "_h"))
    cells = long.groupBy((F.col("a") * k + F.col("m")).alias("i")).agg(F.sum(F.col("_p") * F.col("_h")).alias("v"))
    return cells.agg(F.expr("transform(array_sort(collect_list(struct(i, v))), x -> x.v)").alias("c")).select(
        F.expr(f"CASE WHEN size(c) = 0 THEN array_repeat(0D, {k * k}) ELSE c END").alias("c"))


def one_hot(assignment: DataFrame, n_labels: int, label: str = "label", weight: str = "1D") -> DataFrame:
    """Hard labels as a (weighted) posterior."""
    p = arrays.array([f"CASE WHEN {label} = {k} THEN {weight} ELSE 0D END" for k in range(n_labels)])
    return assignment.select("item_id", F.expr(p).alias("p"))
