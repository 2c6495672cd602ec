"""Per-class arrays of a length known at plan time, unrolled into plain SQL arithmetic.

Helpers that return ``str`` give SQL text, the others finished columns or frames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def num(value: float) -> str:
    """A driver scalar as a SQL double literal."""
    return f"({float(value)!r}D)"


def cells(column: str, size: int) -> list[str]:
    return [f"{column}[{k}]" for k in range(size)]


def array(terms: list[str]) -> str:
    return f"array({', '.join(terms)})"


def total(terms: list[str]) -> str:
    return f"({' + '.join(terms)})"


def largest(terms: list[str]) -> str:
    return terms[0] if len(terms) == 1 else f"greatest({', '.join(terms)})"


def zeros(size: int) -> str:
    return array(["0D"] * size)


def sum_arrays(column: str, size: int) -> Column:
    """Aggregate: element-wise sum of an array column."""
    return sum_scaled(column, None, size)


def sum_scaled(column: str, weight: str | None, size: int) -> Column:
    """Aggregate: element-wise sum of an array column times a scalar column."""
    factor = f" * {weight}" if weight else ""
    return F.expr(array([f"sum({c}{factor})" for c in cells(column, size)]))


def count_by_class(label: str, amount: str, size: int) -> Column:
    """Aggregate: total amount per class index."""
    return F.expr(array([f"cast(sum(CASE WHEN {label} = {k} THEN {amount} ELSE 0 END) AS double)" for k in range(size)]))


def scaled(column: str, weight: str, size: int) -> Column:
    return F.expr(array([f"{c} * {weight}" for c in cells(column, size)]))


def softmax(df: DataFrame, scores: str, out: str, size: int) -> DataFrame:
    """Replace the array column ``scores`` by ``out``, the distribution proportional to exp(scores)."""
    keep = [c for c in df.columns if c not in (scores, out)]
    e = cells("_exp", size)
    return (
        df.withColumn("_top", F.expr(largest(cells(scores, size))))
        .withColumn("_exp", F.expr(array([f"exp({c} - _top)" for c in cells(scores, size)])))
        .select(*keep, F.expr(array([f"{c} / {total(e)}" for c in e])).alias(out))
    )


def let(value: str, name: str, body: str) -> str:
    """SQL text of ``body`` with ``name`` bound to ``value``, evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def softmax_text(scores: str) -> str:
    """SQL text of a softmax for use inside other array functions."""
    powers = "transform(_v, x -> exp(x - array_max(_v)))"
    shares = "transform(_e, x -> x / aggregate(_e, 0D, (a, b) -> a + b))"
    return let(scores, "_v", let(powers, "_e", shares))


def normalized(column: str, size: int) -> Column:
    """Array divided by its sum; NULL when the sum is zero."""
    norm = total(cells(column, size))
    return F.expr(f"CASE WHEN {norm} > 0 THEN {array([f'{c} / {norm}' for c in cells(column, size)])} END")


def argmax(column: str) -> Column:
    """Index of the largest element; the lowest index among equals."""
    return F.expr(f"cast(array_position({column}, array_max({column})) - 1 AS int)")


#: Longest array whose running sums are written out one by one, and most classes whose pairs are.
UNROLLED, UNROLLED_CLASSES = 24, 12


def matrix(rows: list[list[float]]) -> str:
    """A driver table as an array of arrays."""
    return array([array([num(v) for v in row]) for row in rows])


def times(rows: list[list[float]], vector: str) -> str:
    """Product of a driver table with an array column, as an array. The column is bound: a lambda would compute it for each row."""
    dot = "aggregate(zip_with(_row, _vector, (a, b) -> a * b), 0D, (s, v) -> s + v)"
    return let(vector, "_vector", f"transform({matrix(rows)}, _row -> {dot})")


def draw(df: DataFrame, weights: str, uniform: str, size: int, out: str) -> DataFrame:
    """Adds ``out``, an index drawn from an array column of weights by a number in (0, 1): where their running sum passes its share."""
    if size > UNROLLED:
        start = "named_struct('s', 0D, 'i', 0)"
        passed = "(a, x) -> named_struct('s', a.s + x, 'i', a.i + CASE WHEN a.s + x <= _g THEN 1 ELSE 0 END)"
        staged = df.withColumn("_g", F.expr(f"({uniform}) * aggregate({weights}, 0D, (a, x) -> a + x)"))
        pick = f"least(aggregate({weights}, {start}, {passed}).i, {size - 1})"
    else:
        w = cells(weights, size)
        staged = df.withColumn("_g", F.expr(f"({uniform}) * {total(w)}"))
        pick = " ".join(["CASE", *(f"WHEN _g < {total(w[:i + 1])} THEN {i}" for i in range(size - 1)), "WHEN _g IS NOT NULL THEN", str(size - 1), "END"])
    return staged.withColumn(out, F.expr(f"cast({pick} AS int)")).drop("_g")


def long_form(df: DataFrame, column: str, index: str, value: str) -> DataFrame:
    keep = [c for c in df.columns if c != column]
    return df.select(*keep, F.posexplode(column).alias(index, value))


def cosine(a: str, b: str) -> Column:
    """Cosine of two equally long arrays."""

    def dot(x, y):
        product = f"zip_with({x}, {y}, (p, q) -> cast(p AS double) * cast(q AS double))"
        return f"aggregate({product}, 0D, (acc, v) -> acc + v)"

    return F.expr(f"{dot(a, b)} / sqrt({dot(a, a)} * {dot(b, b)})")
