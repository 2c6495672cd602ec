"""Pseudo-random columns that depend on row keys only, so every partitioning draws the same values.

Keys are SQL text: column names or literals.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def hash_text(seed: int | str, *keys: str) -> str:
    parts = ", ".join([f"'{seed}'", *[f"cast({k} AS string)" for k in keys]])
    return f"cast(conv(substring(md5(concat_ws(':', {parts})), 1, 8), 16, 10) AS bigint)"


def uniform_text(seed: int | str, *keys: str) -> str:
    return f"(({hash_text(seed, *keys)} + 0.5D) / 4294967296D)"


def gumbel_text(seed: int | str, *keys: str) -> str:
    """Adding this to log-weights and taking the arg-max draws from the categorical."""
    return f"(-ln(-ln({uniform_text(seed, *keys)})))"


def hash_int(seed: int | str, *keys: str) -> Column:
    """32-bit integer from md5, reproducible in any engine that has md5."""
    return F.expr(hash_text(seed, *keys))


def uniform(seed: int | str, *keys: str) -> Column:
    """Uniform draw in the open interval (0, 1)."""
    return F.expr(uniform_text(seed, *keys))


def fast_uniform_text(seed: int, *keys: str) -> str:
    """Cheaper uniform draw (64-bit xxhash) for per-token work."""
    bits = f"shiftrightunsigned(xxhash64({', '.join([str(seed) + 'L', *keys])}), 11)"
    return f"((cast({bits} AS double) + 0.5D) / {float(1 << 53)!r}D)"
