"""Special functions Spark lacks, as SQL expression text over built-in arithmetic.

Each takes and returns SQL text (give a column name or a short expression) and is used through ``F.expr``:
one parse builds the whole tree, and evaluation stays inside generated code.
"""

from __future__ import annotations

import math

_DIGAMMA_SHIFT = 6
_LGAMMA_SHIFT = 8


def digamma(x: str) -> str:
    """Asymptotic series at x+6, brought back by the recurrence psi(x) = psi(x+1) - 1/x."""
    z = f"({x} + {_DIGAMMA_SHIFT}D)"
    r = f"(1D / ({z} * {z}))"
    series = f"{r} * (1D/12D - {r} * (1D/120D - {r} * (1D/252D - {r} * (1D/240D - {r} * (1D/132D)))))"
    back = " - ".join(f"1D / ({x} + {i}D)" for i in range(_DIGAMMA_SHIFT))
    return f"(ln({z}) - 0.5D / {z} - {series} - {back})"


def lgamma(x: str) -> str:
    """Stirling's series at x+8, brought back by ln Gamma(x) = ln Gamma(x+1) - ln x."""
    z = f"({x} + {_LGAMMA_SHIFT}D)"
    r = f"(1D / ({z} * {z}))"
    series = f"(1D/12D - {r} * (1D/360D - {r} * (1D/1260D - {r} * (1D/1680D - {r} * (1D/1188D))))) / {z}"
    product = " * ".join(f"({x} + {i}D)" for i in range(_LGAMMA_SHIFT))
    return f"(({z} - 0.5D) * ln({z}) - {z} + {0.5 * math.log(2 * math.pi)!r}D + {series} - ln({product}))"


def lgamma_ratio(base: str, step: str) -> str:
    """ln Gamma(base+step) - ln Gamma(base); the frequent unit step is just ln(base)."""
    return (
        f"(CASE WHEN {step} = 0 THEN 0D WHEN {step} = 1 THEN ln({base}) "
        f"ELSE {lgamma(f'({base} + {step})')} - {lgamma(base)} END)"
    )


def log_rising(base: str, n: str) -> str:
    """ln(base (base+1) ... (base+n-1)) for a whole number n, term by term."""
    return (
        f"(CASE WHEN {n} <= 0 THEN 0D ELSE "
        f"aggregate(sequence(0, cast({n} AS int) - 1), 0D, (acc, i) -> acc + ln({base} + i)) END)"
    )


def log_beta(cells: list[str]) -> str:
    """ln B(cells) = sum ln Gamma(cell) - ln Gamma(sum)."""
    return f"({' + '.join(lgamma(c) for c in cells)} - {lgamma('(' + ' + '.join(cells) + ')')})"


def log_add(terms: list[str]) -> str:
    """ln(sum exp(term)) with the largest term factored out."""
    top = terms[0] if len(terms) == 1 else f"greatest({', '.join(terms)})"
    return f"({top} + ln({' + '.join(f'exp({t} - {top})' for t in terms)}))"


def digamma_value(x: float) -> float:
    """The same series for a driver-side scalar (class-sized parameters)."""
    z = x + _DIGAMMA_SHIFT
    r = 1.0 / (z * z)
    series = r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r * (1 / 132)))))
    return math.log(z) - 0.5 / z - series - sum(1.0 / (x + i) for i in range(_DIGAMMA_SHIFT))
