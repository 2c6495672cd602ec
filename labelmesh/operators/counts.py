"""Count tables, confusion matrices, accuracies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from labelmesh.functions import arrays
from labelmesh.operators import joins
from labelmesh.priors import Priors, confusion_cell


def _grid(df: DataFrame, n_labels: int, *names: str) -> DataFrame:
    """Every row of ``df`` with every combination of class indices (generated row by row, no join)."""
    for name in names:
        df = df.withColumn(name, F.expr(f"explode(sequence(0, {n_labels - 1}))"))
    return df


def class_counts(assignment: DataFrame, n_labels: int, priors: Priors) -> DataFrame:
    """ln(b_theta + total weight of items labelled k) for every class. Input: (item_id, label, weight)."""
    one = assignment.agg(arrays.count_by_class("label", "weight", n_labels).alias("c"))
    long = arrays.long_form(one, "c", "label", "total")
    return long.select("label", F.log(F.coalesce("total", F.lit(0.0)) + priors.b_theta).alias("log_count"))


def vocab_counts(features: DataFrame, assignment: DataFrame, n_labels: int, priors: Priors) -> DataFrame:
    """(feature, label, total): b_phi + weighted value sums, on the whole class grid."""
    weighted = joins.one_hot(assignment, n_labels, weight="weight")
    counts = joins.soft_vocab_counts(features, weighted, n_labels)
    return arrays.long_form(counts, "c", "label", "total").withColumn("total", F.col("total") + priors.b_phi)


def machine_counts(pairs: DataFrame, n_labels: int, priors: Priors) -> DataFrame:
    """(truth, m, total): prior + weighted count of (y, m). Input: (item_id, y, m, weight)."""
    diag, off = priors.machine_cell(n_labels)
    seen = pairs.groupBy(F.col("y").alias("truth"), "m").agg(F.sum("weight").alias("total"))
    cell = F.col("id")
    grid = pairs.sparkSession.range(n_labels * n_labels).select(
        F.floor(cell / n_labels).cast("int").alias("truth"), F.pmod(cell, F.lit(n_labels)).cast("int").alias("m"))
    prior = F.when(F.col("truth") == F.col("m"), F.lit(diag)).otherwise(F.lit(off))
    return grid.join(seen, ["truth", "m"], "left").select("truth", "m", (F.coalesce("total", F.lit(0.0)) + prior).alias("total"))


def confusion_grid(soft: DataFrame, annotators: DataFrame, n_labels: int, diag: float, off: float) -> DataFrame:
    """Prior plus soft counts on the full (annotator_id, truth, label) grid."""
    cells = arrays.long_form(soft, "c", "truth", "v")
    grid = _grid(annotators.select("annotator_id"), n_labels, "truth", "label")
    prior = F.when(F.col("truth") == F.col("label"), F.lit(diag)).otherwise(F.lit(off))
    return grid.join(cells, ["annotator_id", "truth", "label"], "left").select(
        "annotator_id", "truth", "label", (F.coalesce("v", F.lit(0.0)) + prior).alias("value")
    )


def confusion_counts(annotations: DataFrame, assignment: DataFrame, annotators: DataFrame, n_labels: int,
                     priors: Priors) -> DataFrame:
    """Prior + weighted annotation counts per (annotator, assigned label, label), with row totals."""
    weighted = joins.one_hot(assignment, n_labels, weight="weight")
    soft = joins.soft_confusion(annotations, weighted, n_labels)
    grid = confusion_grid(soft, annotators, n_labels, *priors.annotator_cell(n_labels))
    row = Window.partitionBy("annotator_id", "truth")
    return grid.withColumn("row_total", F.sum("value").over(row))


def prior_confusion(annotators: DataFrame, n_labels: int, accuracy: float, concentration: float) -> DataFrame:
    """Every annotator's prior confusion cells."""
    diag, off = confusion_cell(accuracy, concentration, n_labels)
    return _grid(annotators.select("annotator_id"), n_labels, "truth", "label").withColumn(
        "value", F.when(F.col("truth") == F.col("label"), F.lit(diag)).otherwise(F.lit(off))
    )


def normalize_rows(confusion: DataFrame) -> DataFrame:
    """Each confusion row divided by its sum."""
    row = Window.partitionBy("annotator_id", "truth")
    return confusion.withColumn("value", F.col("value") / F.sum("value").over(row))


def annotator_accuracy(confusion: DataFrame, class_prior: DataFrame) -> DataFrame:
    """Sum over classes of prior share * diagonal. ``class_prior``: (truth, value), normalised here."""
    total = class_prior.agg(F.sum("value")).scalar()
    share = F.broadcast(class_prior.select("truth", (F.col("value") / total).alias("share")))
    diagonal = confusion.filter(F.col("truth") == F.col("label"))
    return diagonal.join(share, "truth").groupBy("annotator_id").agg(
        F.sum(F.col("value") * F.col("share")).alias("accuracy")
    )


def machine_accuracy(machine_confusion: DataFrame, class_prior: DataFrame) -> DataFrame:
    """The same for the single machine confusion (truth, m, value)."""
    total = class_prior.agg(F.sum("value")).scalar()
    share = F.broadcast(class_prior.select("truth", (F.col("value") / total).alias("share")))
    return machine_confusion.filter(F.col("truth") == F.col("m")).join(share, "truth").agg(
        F.sum(F.col("value") * F.col("share")).alias("accuracy")
    )


def gold_confusion(guesses: DataFrame, items: DataFrame, annotations: DataFrame | None = None,
                   annotated: bool | None = None) -> DataFrame:
    """(gold, guess, n) over items with a gold label, optionally only (un)annotated ones."""
    known = items.filter(F.col("gold_label").isNotNull()).select("item_id", "gold_label")
    if annotated is not None:
        known = known.join(annotations.select("item_id").distinct(), "item_id", "left_semi" if annotated else "left_anti")
    return (
        guesses.select("item_id", "label")
        .join(known, "item_id")
        .groupBy(F.col("gold_label").alias("gold"), F.col("label").alias("guess"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def accuracy(guesses: DataFrame, items: DataFrame) -> DataFrame:
    known = items.filter(F.col("gold_label").isNotNull()).select("item_id", "gold_label")
    hit = F.when(F.col("label") == F.col("gold_label"), F.lit(1.0)).otherwise(F.lit(0.0))
    return guesses.join(known, "item_id").agg(
        F.avg(hit).alias("accuracy"), F.count(F.lit(1)).alias("labelled")
    )


def definiteness(confusion: DataFrame) -> DataFrame:
    """Sum of squared distances to the nearer of 0 and 1 over a confusion matrix; 0 = fully decisive."""
    gap = F.least(F.col("value"), F.lit(1.0) - F.col("value"))
    return confusion.groupBy("annotator_id").agg(F.sum(gap * gap).alias("indecision"))


def annotation_totals(annotations: DataFrame) -> DataFrame:
    return annotations.groupBy("item_id", "annotator_id").agg(F.sum("n").alias("n"))
