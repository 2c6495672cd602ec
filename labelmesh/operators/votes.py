"""Votes over annotations: counts, soft distributions, winners and rankings.

Ties always go to the lowest label, so results do not depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from labelmesh.functions import arrays


def vote_counts(annotations: DataFrame) -> DataFrame:
    return annotations.groupBy("item_id", "label").agg(F.sum("n").alias("n"))


def vote_array(annotations: DataFrame, n_labels: int) -> DataFrame:
    """(item_id, votes): one shuffle, one partial row per item and map task however hot the item is."""
    return annotations.groupBy("item_id").agg(arrays.count_by_class("label", "n", n_labels).alias("votes"))


def soft_majority(annotations: DataFrame, items: DataFrame, n_labels: int) -> DataFrame:
    """Vote shares; NULL for items without annotations."""
    votes = vote_array(annotations, n_labels)
    return items.select("item_id").join(votes, "item_id", "left").select(
        "item_id", arrays.normalized("votes", n_labels).alias("p")
    )


def smoothed_majority(annotations: DataFrame, items: DataFrame, n_labels: int, n_annotators: int,
                      smoothing: float = 1e-6) -> DataFrame:
    """Vote shares with ``smoothing`` added per annotator; uniform for items without annotations."""
    votes = vote_array(annotations, n_labels)
    extra = arrays.num(n_annotators * smoothing)
    return (
        items.select("item_id")
        .join(votes, "item_id", "left")
        .withColumn("votes", F.expr(f"coalesce(votes, {arrays.zeros(n_labels)})"))
        .select("item_id", F.expr(arrays.array([f"{c} + {extra}" for c in arrays.cells("votes", n_labels)])).alias("s"))
        .select("item_id", arrays.normalized("s", n_labels).alias("p"))
    )


def log_vote(measurements: DataFrame, items: DataFrame, n_labels: int) -> DataFrame:
    """Softmax of summed annotation values, read as log scores; a missing value is a zero."""
    scores = measurements.groupBy("item_id").agg(arrays.count_by_class("label", "value", n_labels).alias("s"))
    joined = items.select("item_id").join(scores, "item_id", "left").withColumn(
        "s", F.expr(f"coalesce(s, {arrays.zeros(n_labels)})")
    )
    return arrays.softmax(joined, "s", "p", n_labels).select("item_id", "p")


def majority_vote(annotations: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """Most frequent label per item; NULL for items (when given) without annotations."""
    winner = (
        vote_counts(annotations)
        .groupBy("item_id")
        .agg(F.max_by("label", F.struct(F.col("n"), -F.col("label"))).alias("label"))
    )
    if items is None:
        return winner
    return items.select("item_id").join(winner, "item_id", "left")


def arbiter_vote(annotations: DataFrame, is_arbiter: Column, strict: bool = True) -> DataFrame:
    """The arbiter's label where there is one, otherwise the majority label.

    ``strict`` makes the job fail on items with more than three annotations or more than one arbiter
    label; otherwise those items are decided the same way and flagged in ``violation``.
    """
    tallied = (
        annotations.withColumn("_arbiter", is_arbiter)
        .groupBy("item_id", "label")
        .agg(
            F.sum("n").alias("n"),
            F.sum(F.when(F.col("_arbiter"), F.lit(1)).otherwise(F.lit(0))).alias("arb"),
        )
        .groupBy("item_id")
        .agg(
            F.sum("n").alias("n"),
            F.sum("arb").alias("arb"),
            F.max_by("label", F.struct(F.col("n"), -F.col("label"))).alias("majority"),
            F.max_by("label", F.when(F.col("arb") > 0, F.struct(F.col("arb"), -F.col("label")))).alias("arbited"),
        )
    )
    bad = (F.col("n") > 3) | (F.col("arb") > 1)
    out = tallied.select(
        "item_id",
        F.coalesce("arbited", "majority").alias("label"),
        bad.alias("violation"),
    )
    if not strict:
        return out
    message = F.concat(F.lit("more than three annotations or one arbiter label on item "), F.col("item_id").cast("string"))
    return out.select(
        "item_id",
        F.when(F.col("violation"), F.raise_error(message).cast("int")).otherwise(F.col("label")).alias("label"),
    )


def _mode(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    counted = df.filter(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("_n"))
    return counted.groupBy(*keys).agg(F.max_by(column, F.struct(F.col("_n"), -F.col(column))).alias(column))


def chain_vote(chains: DataFrame) -> DataFrame:
    """Majority over saved runs, separately for y and m. Input: (run, item_id, y, m)."""
    items = chains.select("item_id").distinct()
    return items.join(_mode(chains, ["item_id"], "y"), "item_id", "left").join(
        _mode(chains, ["item_id"], "m"), "item_id", "left"
    )


def chain_vote_tokens(chains: DataFrame) -> DataFrame:
    """Majority topic of every token over saved runs. Input: (run, item_id, z ARRAY<INT>)."""
    tokens = chains.select("item_id", F.posexplode("z").alias("pos", "z"))
    return _mode(tokens, ["item_id", "pos"], "z")


def marginal_mode(samples: DataFrame) -> DataFrame:
    """Most frequent label of each item over all sweeps. Input: (sweep, item_id, label)."""
    return _mode(samples, ["item_id"], "label")


def ranked_labels(scores: DataFrame, n: int = -1) -> DataFrame:
    """(item_id, label, score) -> rank 1.. per item, best first; n < 1 keeps all ranks."""
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc("label"))
    ranked = scores.withColumn("rank", F.row_number().over(w))
    return ranked if n < 1 else ranked.filter(F.col("rank") <= n)


def rank_array(column: str) -> Column:
    """Labels of a per-class array, best first, without a shuffle."""
    pairs = f"transform({column}, (v, k) -> struct(-v AS s, cast(k AS int) AS k))"
    return F.expr(f"transform(array_sort({pairs}), x -> x.k)")
