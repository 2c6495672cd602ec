"""Cutting lineage, shared scratch tables and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Largest table this package ever hints for broadcast, in bytes of raw payload.
BROADCAST_BYTES = 64 << 20

#: folder of each local application that names none itself
_local_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    A local session without that setting gets a folder of its own; a cluster must name one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    application = spark.sparkContext.applicationId
    if application not in _local_roots:
        _local_roots[application] = tempfile.mkdtemp(prefix="labelmesh-")
    return _local_roots[application]


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/labelmesh/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut", schema=None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The written copy survives the loss of any executor, carries true size statistics (so later joins
    pick a broadcast from facts) and ends the plan, which keeps iterative plans flat.
    """
    return cut_at(df, shared_path(df.sparkSession, name), schema)


def cut_at(df: DataFrame, path: str, schema=None) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema or df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a shared table once nothing reads it any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def path_bytes(spark: SparkSession, path: str | None) -> int:
    """Size of all files under a path."""
    if path is None:
        return 0
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(target).getLength()


def stored_path(df: DataFrame) -> str | None:
    """The folder of a table that was cut; None if it has no file."""
    files = df.inputFiles()
    return files[0].rsplit("/", 1)[0] if files else None


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file in one atomic step: readers see the old content or the new one, never part of it."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    files = jvm.org.apache.hadoop.fs
    target, draft = files.Path(path), files.Path(f"{path}.{uuid.uuid4().hex}")
    out = target.getFileSystem(conf).create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    how = spark.sparkContext._gateway.new_array(files.Options.Rename, 1)
    how[0] = files.Options.Rename.OVERWRITE
    files.FileContext.getFileContext(target.toUri(), conf).rename(draft, target, how)


def read_text(spark: SparkSession, path: str) -> str | None:
    """The whole of a small file; None where there is none."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return None
    return spark.read.text(path, wholetext=True).first()[0]


class Rolling:
    """Cuts each generation of an iterated table and drops the files of those older than ``keep``."""

    def __init__(self, name: str, keep: int = 2):
        self.name, self.keep = name, keep
        self.generations: list[tuple[DataFrame, str]] = []

    def push(self, df: DataFrame) -> DataFrame:
        spark = df.sparkSession
        path = shared_path(spark, self.name)
        self.generations.append((cut_at(df, path), path))
        if len(self.generations) > self.keep:
            drop_path(spark, self.generations.pop(0)[1])
        return self.last

    @property
    def last(self) -> DataFrame:
        return self.generations[-1][0]

    def drop(self) -> None:
        """Remove the files of all generations."""
        for df, path in self.generations:
            drop_path(df.sparkSession, path)
        self.generations.clear()


def fits_broadcast(rows: int, row_bytes: int) -> bool:
    return rows * row_bytes <= BROADCAST_BYTES


def scalars(df: DataFrame, column: str, width: int) -> list[float]:
    """The ``width`` numbers of a one-row array aggregate, as driver floats."""
    row = df.select(column).first()
    values = row[0] if row is not None else None
    if values is None:
        return [0.0] * width
    return [0.0 if v is None else float(v) for v in values]

