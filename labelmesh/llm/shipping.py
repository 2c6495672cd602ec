"""Makes this package importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


#: bytes that a task and its Python worker exchange at once; texts and sets differ too much for a number of rows to bound them
BATCH_BYTES = 4 << 20
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def _bytes(value: str) -> int:
    number, unit = value.strip().lower().rstrip("b"), 1
    for mark, size in (("k", 10), ("m", 20), ("g", 30)):
        if number.endswith(mark):
            number, unit = number[:-1], 1 << size
    return int(number) * unit


def ship(spark: SparkSession) -> None:
    """Gives the package's modules to the application's workers, once; a worker then imports and keeps them.

    Also bounds the session's exchanges with Python workers in bytes, where they may be larger.
    """
    now = _bytes(spark.conf.get(_BYTES))
    if now <= 0 or now > BATCH_BYTES:
        spark.conf.set(_BYTES, f"{BATCH_BYTES}b")
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    archive = os.path.join(tempfile.mkdtemp(prefix="labelmesh-code-"), f"{package.name}.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


#: rows that tasks and Python workers exchange at once where rows are whole texts or sets
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS):
    """Smaller exchanges with Python workers for what is run (not only planned) inside."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)
