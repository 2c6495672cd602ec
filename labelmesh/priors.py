"""Hyper-parameters shared by every model."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Priors:
    """Prior strengths. ``b_gamma``/``b_mu`` are diagonal masses (accuracies), ``c_gamma``/``c_mu``
    the concentrations of the annotator and machine confusion rows."""

    b_theta: float = 1.0
    b_mu: float = 0.75
    c_mu: float = 2.0
    b_gamma: float = 0.75
    c_gamma: float = 2.0
    b_phi: float = 1.0
    eta_variance: float = 1.0

    def __post_init__(self):
        for name in ("b_theta", "b_mu", "c_mu", "b_gamma", "c_gamma", "b_phi", "eta_variance"):
            if not getattr(self, name) > 0:
                raise ValueError(f"{name} must be positive")

    def with_(self, **changes) -> "Priors":
        return replace(self, **changes)

    def annotator_cell(self, n_labels: int) -> tuple[float, float]:
        """(diagonal, off-diagonal) pseudo-counts of one annotator's confusion row."""
        return confusion_cell(self.b_gamma, self.c_gamma, n_labels)

    def machine_cell(self, n_labels: int) -> tuple[float, float]:
        return confusion_cell(self.b_mu, self.c_mu, n_labels)


def confusion_cell(accuracy: float, concentration: float, n_labels: int) -> tuple[float, float]:
    if n_labels < 2:
        return accuracy * concentration, 0.0
    return accuracy * concentration, (1.0 - accuracy) / (n_labels - 1) * concentration
