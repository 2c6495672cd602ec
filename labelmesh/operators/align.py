"""Undo label switching: permute inferred classes so that a K x K matrix has a strong diagonal."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from labelmesh.operators import counts

METHODS = ("none", "rand", "gold", "avg_gamma", "max_gamma")


def best_assignment(matrix: list[list[float]]) -> list[int]:
    """Column for every row so that the picked cells have the largest sum (K is the number of classes).

    Rows are added one at a time along the cheapest augmenting path, with prices kept for rows and columns.
    """
    k = len(matrix)
    row_price, col_price = [0.0] * k, [0.0] * k
    owner = [-1] * k
    for new in range(k):
        best, came, done = [math.inf] * k, [-1] * k, [False] * k
        row, last, reached = new, -1, 0.0
        while True:
            for c in range(k):
                if not done[c]:
                    cost = reached - matrix[row][c] - row_price[row] - col_price[c]
                    if cost < best[c] - 1e-12:
                        best[c], came[c] = cost, last
            last = min((c for c in range(k) if not done[c]), key=lambda c: best[c])
            reached, done[last] = best[last], True
            if owner[last] < 0:
                break
            row = owner[last]
        row_price[new] += reached
        for c in range(k):
            if done[c] and c != last:
                col_price[c] += best[c] - reached
                row_price[owner[c]] += reached - best[c]
        while last >= 0:
            before = came[last]
            owner[last] = new if before < 0 else owner[before]
            last = before
    columns = [0] * k
    for c, r in enumerate(owner):
        columns[r] = c
    return columns


def _matrix(cells: DataFrame, row: str, column: str, value: str, k: int) -> list[list[float]]:
    """A K x K table as nested lists (its size is that of the label set, squared)."""
    out = [[0.0] * k for _ in range(k)]
    for r in cells.groupBy(row, column).agg(F.sum(value).alias("v")).collect():
        out[r[0]][r[1]] = float(r["v"])
    return out


def class_map(method: str, n_labels: int, confusion: DataFrame | None = None, gold_cells: DataFrame | None = None,
              seed: int = 0) -> list[int]:
    """New class of every inferred class.

    gold: ``gold_cells`` (gold, guess, n). avg_gamma / max_gamma: ``confusion`` (annotator_id, truth, label,
    value) row-normalised; the average over annotators, or the single most decisive annotator.
    """
    k = n_labels
    if method == "none":
        return list(range(k))
    if method == "rand":
        import random

        order = list(range(k))
        random.Random(seed).shuffle(order)
        return order
    if method == "gold":
        return best_assignment(_matrix(gold_cells, "guess", "gold", "n", k))
    if method == "avg_gamma":
        return best_assignment(_matrix(confusion, "truth", "label", "value", k))
    if method == "max_gamma":
        sharpest = counts.definiteness(confusion).agg(
            F.min_by("annotator_id", F.struct("indecision", "annotator_id")).alias("annotator_id")
        )
        one = confusion.join(F.broadcast(sharpest), "annotator_id", "left_semi")
        return best_assignment(_matrix(one, "truth", "label", "value", k))
    raise ValueError(f"unknown method {method!r}, choose one of {METHODS}")


def machine_map(machine: DataFrame, y_map: list[int], n_labels: int) -> list[int]:
    """New class of every m, after y was permuted: machine columns lined up with the new y rows."""
    cells = _matrix(machine, "m", "truth", "value", n_labels)
    moved = [[0.0] * n_labels for _ in range(n_labels)]
    for m in range(n_labels):
        for y in range(n_labels):
            moved[m][y_map[y]] = cells[m][y]
    return best_assignment(moved)


def apply_map(df: DataFrame, column: str, mapping: list[int]) -> DataFrame:
    """Rename classes in one column; the map is a literal, so no join."""
    values = ", ".join(str(v) for v in mapping)
    return df.withColumn(column, F.expr(f"array({values})[{column}]"))


