"""Evidence lower bounds and collapsed log joints, as aggregates over parameter and posterior tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from labelmesh.functions import arrays
from labelmesh.functions.special import lgamma
from labelmesh.models.variational import Fit
from labelmesh.priors import Priors


def _one(df: DataFrame, expression: str) -> float:
    value = df.agg(F.expr(expression)).first()[0]
    return 0.0 if value is None else float(value)


def _log_beta(values: list[float]) -> float:
    return sum(math.lgamma(v) for v in values) - math.lgamma(sum(values))


def label_arrangements(annotations: DataFrame) -> float:
    """Log number of orders in which each (item, annotator)'s labels could have come."""
    cells = _one(annotations.filter("n > 1"), f"sum({lgamma('(n + 1D)')})")
    totals = annotations.groupBy("item_id", "annotator_id").agg(F.sum("n").alias("n")).filter("n > 1")
    return _one(totals, f"sum({lgamma('(n + 1D)')})") - cells


def word_arrangements(features: DataFrame) -> float:
    cells = _one(features, f"sum({lgamma('(value + 1D)')})")
    totals = features.groupBy("item_id").agg(F.sum("value").alias("value"))
    return _one(totals, f"sum({lgamma('(value + 1D)')})") - cells


def entropy(posterior: DataFrame, column: str, n_labels: int) -> float:
    terms = [f"CASE WHEN {c} > 0 THEN {c} * ln({c}) ELSE 0D END" for c in arrays.cells(column, n_labels)]
    return -_one(posterior, f"sum({arrays.total(terms)})")


def confusion_beta(confusion: DataFrame) -> float:
    """Sum of ln B over all confusion rows (annotator_id, truth)."""
    rows = confusion.groupBy("annotator_id", "truth").agg(
        F.expr(f"sum({lgamma('value')})").alias("cells"), F.sum("value").alias("total")
    )
    return _one(rows, f"sum(cells - {lgamma('total')})")


def vocab_beta(vocab: DataFrame, n_labels: int, n_features: int, priors: Priors) -> float:
    """Sum over classes of ln B(word counts + b_phi)."""
    b = arrays.num(priors.b_phi)
    cells = arrays.cells("c", n_labels)
    row = vocab.agg(
        F.expr(f"sum({arrays.total([lgamma(f'({c} + {b})') for c in cells])})").alias("logs"),
        arrays.sum_arrays("c", n_labels).alias("totals"),
    ).first()
    return row["logs"] - sum(math.lgamma(t + n_features * priors.b_phi) for t in row["totals"])


def elbo(fit: Fit, annotations: DataFrame, features: DataFrame | None = None) -> float:
    """Bound of a variational fit.

    The fit's parameters are the optimum for its posterior, so expected log-parameters cancel and every
    Dirichlet contributes ln B(posterior counts) - ln B(prior).
    """
    k, p = fit.n_labels, fit.priors
    diag, off = p.annotator_cell(k)
    n_annotators = fit.annotators.count()
    bound = _log_beta(fit.class_prior) - _log_beta([p.b_theta] * k)
    bound += confusion_beta(fit.confusion()) - n_annotators * k * _log_beta([diag] + [off] * (k - 1))
    bound += label_arrangements(annotations) + entropy(fit.posterior, "p", k)
    if fit.vocab is not None:
        flat = fit.n_features * math.lgamma(p.b_phi) - math.lgamma(fit.n_features * p.b_phi)
        bound += vocab_beta(fit.vocab, k, fit.n_features, p) - k * flat + word_arrangements(features)
    if fit.machine is not None:
        md, mo = p.machine_cell(k)
        rows = [fit.machine_cells[a * k:(a + 1) * k] for a in range(k)]
        bound += sum(_log_beta(r) for r in rows) - k * _log_beta([md] + [mo] * (k - 1))
        bound += entropy(fit.machine, "h", k)
    return bound


def log_joint(class_counts: list[float], confusion: DataFrame, vocab: DataFrame | None = None, n_features: int = 0,
              machine_cells: list[float] | None = None, priors: Priors = Priors()) -> float:
    """Collapsed log joint of hard assignments. Counts include priors, except ``vocab``, which gets b_phi here."""
    k = len(class_counts)
    value = sum(math.lgamma(c) for c in class_counts) + confusion_beta(confusion)
    if vocab is not None:
        value += vocab_beta(vocab, k, n_features, priors)
    if machine_cells is not None:
        value += sum(_log_beta(machine_cells[a * k:(a + 1) * k]) for a in range(k))
    return value
