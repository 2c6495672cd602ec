"""Prior strengths by maximum a posteriori, as fixed-point steps over aggregated counts.

Both strengths carry a Gamma(2, 2) hyper-prior. Counts of hard assignments are whole numbers, so they are first counted
themselves: a histogram says how many cells, and how many draws in all, have each count. A step then costs the number of
distinct counts, whatever the number of documents; histograms of ordinary size are iterated on the driver. Soft counts
repeat less; their steps aggregate the count table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from labelmesh.functions import arrays
from labelmesh.functions.special import digamma, digamma_value
from labelmesh.priors import Priors
from labelmesh.runtime import cut

#: Gamma hyper-prior shape and rate, relative stop (fixed values)
SHAPE, RATE, STOP = 2.0, 2.0, 1e-4
#: relative stop and steps over histograms, wherever they are iterated
EXACT, EXACT_STEPS = 1e-10, 5000
#: most histogram rows that are iterated on the driver; decides where a step is taken, not where the steps end
DRIVER_ROWS = 200_000


def symmetric_step(rows: DataFrame, n_labels: int, alpha: float) -> float:
    """One step for a symmetric Dirichlet-multinomial. ``rows``: (c ARRAY) of counts, one per draw."""
    a = arrays.num(alpha)
    cells = arrays.cells("c", n_labels)
    gain = arrays.total([f"({digamma(f'({c} + {a})')} - {arrays.num(digamma_value(alpha))})" for c in cells])
    whole = arrays.num(n_labels * alpha)
    norm = f"({digamma(f'(t + {whole})')} - {arrays.num(digamma_value(n_labels * alpha))})"
    staged = rows.select("c", F.expr(arrays.total(cells)).alias("t"))
    up, down = staged.agg(F.expr(f"sum({gain})"), F.expr(f"sum({norm})")).first()
    return (SHAPE - 1.0 + alpha * up) / (RATE + n_labels * down)


def _accelerated(step, start: list[float], max_steps: int, stop: float = STOP) -> list[float]:
    """Fixed point of ``step`` on a few positive scalars.

    After every (dimension + 1) plain steps their logs are combined so that the linear part of the error
    cancels (minimal polynomial extrapolation); each step is a pass over the count table, so few matter.
    """
    size, done = len(start), 0
    path = [np.log(start)]
    while done < max_steps:
        path.append(np.log(step(list(np.exp(path[-1])))))
        done += 1
        if np.max(np.abs(path[-1] - path[-2])) <= stop:
            break
        if len(path) == size + 2:
            moves = np.diff(path, axis=0)
            share, *_ = np.linalg.lstsq(moves[:-1].T, -moves[-1], rcond=None)
            share = np.append(share, 1.0)
            jump = path[-1]
            if abs(share.sum()) > 1e-9:
                jump = (share / share.sum()) @ np.array(path[:-1])
            path = [np.clip(jump, path[-1] - 2.0, path[-1] + 2.0)]
    return [float(v) for v in np.exp(path[-1])]


# -- histograms ---------------------------------------------------------------------------------------


@dataclass
class Histogram:
    """(kind, value, n): how often a count occurs, among cells (of one or more kinds) and among draws' totals."""

    table: DataFrame
    rows: int
    held: dict[str, tuple[np.ndarray, np.ndarray]] | None = None

    @classmethod
    def of(cls, counted: DataFrame) -> "Histogram":
        """``counted``: (e ARRAY<STRUCT<kind, value>>) per draw. Zeros do not matter to any sum here."""
        table = counted.select(F.explode("e").alias("e")).filter("e.value > 0").groupBy("e.kind", "e.value").agg(F.count(F.lit(1)).alias("n"))
        table = cut(table, "histogram")
        out = cls(table, table.count())
        if out.rows <= DRIVER_ROWS:
            rows = table.toPandas()
            out.held = {kind: (part["value"].to_numpy(np.float64), part["n"].to_numpy(np.float64)) for kind, part in rows.groupby("kind")}
        return out

    def excess(self, **strengths: float) -> dict[str, float]:
        """For each kind the sum over its counts of digamma(count + strength) - digamma(strength)."""
        base = {kind: digamma_value(a) for kind, a in strengths.items()}
        if self.held is not None:
            none = (np.empty(0), np.empty(0))
            return {kind: float((n * (digamma_values(v + a) - base[kind])).sum()) for kind, a in strengths.items() for v, n in [self.held.get(kind, none)]}
        gain = lambda kind, a: digamma(f"(value + {arrays.num(a)})") + f" - {arrays.num(base[kind])}"
        row = self.table.agg(*(F.expr(f"coalesce(sum(CASE WHEN kind = '{kind}' THEN n * ({gain(kind, a)}) END), 0D)").alias(kind)
                               for kind, a in strengths.items())).first()
        return row.asDict()


def digamma_values(x: np.ndarray) -> np.ndarray:
    """:func:`digamma_value` of every element."""
    z = x + 6.0
    r = 1.0 / (z * z)
    series = r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r * (1 / 132)))))
    return np.log(z) - 0.5 / z - series - sum(1.0 / (x + i) for i in range(6))


def _cells(kind: str, column: str) -> str:
    return f"transform({column}, x -> named_struct('kind', '{kind}', 'value', cast(x AS double)))"


def _total(column: str, size: int) -> str:
    return f"array(named_struct('kind', 'total', 'value', {arrays.total(arrays.cells(column, size))}))"


def symmetric(rows: DataFrame, n_labels: int, alpha: float) -> float:
    """MAP strength of a symmetric Dirichlet-multinomial. ``rows``: (c ARRAY) of counts, one per draw."""
    seen = Histogram.of(rows.select(F.expr(f"concat({_cells('cell', 'c')}, {_total('c', n_labels)})").alias("e")))

    def step(x: list[float]) -> list[float]:
        sums = seen.excess(cell=x[0], total=n_labels * x[0])
        return [(SHAPE - 1.0 + x[0] * sums["cell"]) / (RATE + n_labels * sums["total"])]

    return _accelerated(step, [alpha], EXACT_STEPS, EXACT)[0]


def vocabulary(vocab: DataFrame, n_classes: int, n_features: int, b_phi: float) -> float:
    """MAP b_phi. ``vocab``: (c ARRAY by class) per word; each class is a draw over all words, so the totals are few."""
    seen = Histogram.of(vocab.select(F.expr(_cells("cell", "c")).alias("e")))
    totals = [t or 0.0 for t in vocab.agg(arrays.sum_arrays("c", n_classes).alias("t")).first()["t"]]

    def step(x: list[float]) -> list[float]:
        whole = n_features * x[0]
        down = sum(digamma_value(t + whole) - digamma_value(whole) for t in totals)
        return [(SHAPE - 1.0 + x[0] * seen.excess(cell=x[0])["cell"]) / (RATE + n_features * down)]

    return _accelerated(step, [b_phi], EXACT_STEPS, EXACT)[0]


def hard_confusion(rows: DataFrame, n_labels: int, diag: float, off: float) -> tuple[float, float]:
    """MAP (diagonal, off-diagonal) strengths shared by all rows (truth, c ARRAY over labels)."""
    kinds = "transform(c, (x, i) -> named_struct('kind', CASE WHEN i = truth THEN 'diag' ELSE 'off' END, 'value', cast(x AS double)))"
    seen = Histogram.of(rows.select(F.expr(f"concat({kinds}, {_total('c', n_labels)})").alias("e")))

    def step(x: list[float]) -> list[float]:
        sums = seen.excess(diag=x[0], off=x[1], total=x[0] + (n_labels - 1) * x[1])
        return [(SHAPE - 1.0 + x[0] * sums["diag"]) / (RATE + sums["total"]),
                (SHAPE - 1.0 + x[1] * sums["off"]) / (RATE + (n_labels - 1) * sums["total"])]

    found = _accelerated(step, [diag, off], EXACT_STEPS, EXACT)
    return found[0], found[1]


def with_confusion(priors: Priors, n_labels: int, cells: DataFrame) -> Priors:
    """``priors`` with (b_gamma, c_gamma) tuned to hard counts (annotator_id, label, c by truth)."""
    diag, off = hard_confusion(confusion_rows(cells, n_labels), n_labels, *priors.annotator_cell(n_labels))
    strength = diag + (n_labels - 1) * off
    return priors.with_(b_gamma=diag / strength, c_gamma=strength)


# -- soft counts --------------------------------------------------------------------------------------


def confusion_step(rows: DataFrame, n_labels: int, diag: float, off: float) -> tuple[float, float]:
    """One step for the shared (diagonal, off-diagonal) prior. ``rows``: (truth, c ARRAY over labels)."""
    k, num = n_labels, arrays.num
    d0, o0 = num(digamma_value(diag)), num(digamma_value(off))
    total = diag + (k - 1) * off
    own = f"c[truth] + {num(diag)}"
    gain_d = f"({digamma(f'({own})')} - {d0})"
    gain_o = arrays.total([
        f"CASE WHEN truth = {i} THEN 0D ELSE {digamma(f'(c[{i}] + {num(off)})')} - {o0} END" for i in range(k)
    ])
    norm = f"({digamma(f'(t + {num(total)})')} - {num(digamma_value(total))})"
    staged = rows.select("truth", "c", F.expr(arrays.total(arrays.cells("c", k))).alias("t"))
    up_d, up_o, down = staged.agg(F.expr(f"sum({gain_d})"), F.expr(f"sum({gain_o})"), F.expr(f"sum({norm})")).first()
    return (
        (SHAPE - 1.0 + diag * up_d) / (RATE + down),
        (SHAPE - 1.0 + off * up_o) / (RATE + (k - 1) * down),
    )


def confusion(rows: DataFrame, n_labels: int, diag: float, off: float, max_steps: int = 100, stop: float = STOP) -> tuple[float, float]:
    found = _accelerated(lambda x: list(confusion_step(rows, n_labels, *x)), [diag, off], max_steps, stop)
    return found[0], found[1]


def confusion_rows(soft: DataFrame, n_labels: int) -> DataFrame:
    """(annotator_id, label, c by truth) -> (annotator_id, truth, c by label); one row per annotator and truth."""
    long = arrays.long_form(soft, "c", "truth", "v")
    return long.groupBy("annotator_id", "truth").agg(arrays.count_by_class("label", "v", n_labels).alias("c"))



def vocab_step(vocab: DataFrame, n_labels: int, n_features: int, b_phi: float) -> float:
    """One step for b_phi: each class is a draw over words, so totals come first as class-sized scalars."""
    a = arrays.num(b_phi)
    base = arrays.num(digamma_value(b_phi))
    gain = arrays.total([f"({digamma(f'({c} + {a})')} - {base})" for c in arrays.cells("c", n_labels)])
    row = vocab.agg(F.expr(f"sum({gain})").alias("up"), arrays.sum_arrays("c", n_labels).alias("t")).first()
    whole = n_features * b_phi
    down = sum(digamma_value(t + whole) - digamma_value(whole) for t in row["t"])
    return (SHAPE - 1.0 + b_phi * row["up"]) / (RATE + n_features * down)


def tune_priors(fit_posterior: DataFrame, soft: DataFrame, priors: Priors, n_labels: int, vocab: DataFrame | None = None,
                n_features: int = 0, per_item: bool = True, max_steps: int = 100, stop: float = STOP) -> Priors:
    """New b_theta, (b_gamma, c_gamma) and, with words, b_phi.

    The label-only model takes every item's distribution as a draw for b_theta; with ``per_item`` off the
    summed class counts are the one draw, as in the models with words.
    """
    from labelmesh.operators.joins import class_sums

    draws = cut(fit_posterior.select(F.col("p").alias("c")) if per_item else class_sums(fit_posterior, n_labels), "tuning_draws")
    b_theta = _accelerated(lambda x: [symmetric_step(draws, n_labels, x[0])], [priors.b_theta], max_steps, stop)[0]
    tuned = tune_annotators(soft, priors, n_labels, max_steps, stop).with_(b_theta=b_theta)
    if vocab is not None:
        tuned = tuned.with_(b_phi=_accelerated(lambda x: [vocab_step(vocab, n_labels, n_features, x[0])], [priors.b_phi], max_steps, stop)[0])
    return tuned


def tune_annotators(soft: DataFrame, priors: Priors, n_labels: int, max_steps: int = 100, stop: float = STOP) -> Priors:
    """New (b_gamma, c_gamma) from soft counts (annotator_id, label, c by truth)."""
    rows = cut(confusion_rows(soft, n_labels), "confusion_rows")
    diag, off = confusion(rows, n_labels, *priors.annotator_cell(n_labels), max_steps, stop)
    c_gamma = diag + (n_labels - 1) * off
    return priors.with_(b_gamma=diag / c_gamma, c_gamma=c_gamma)


def inline_tuner(corpus, posterior: DataFrame, priors: Priors, max_steps: int = 100, stop: float = STOP) -> Priors:
    """Pass as ``tune`` to a variational fit to re-estimate priors after every iteration."""
    soft = cut(corpus.soft_confusion(posterior), "tuning_soft")
    vocab = cut(corpus.soft_vocab(posterior), "tuning_vocab") if corpus.features is not None else None
    return tune_priors(posterior, soft, priors, corpus.n_labels, vocab, corpus.n_features, corpus.features is None, max_steps, stop)


def annotator_tuner(corpus, posterior: DataFrame, priors: Priors) -> Priors:
    """The same for models without class and word priors."""
    return tune_annotators(cut(corpus.soft_confusion(posterior), "tuning_soft"), priors, corpus.n_labels)
