"""A table with one row per key that micro-batches keep up to date.

Rows lie in buckets by a hash of the key. A batch reads the buckets that its keys fall into and writes again only those
in which a row has changed; a small manifest names the folder of every bucket and is replaced in one atomic step. So a
batch that fails, or is run again, leaves the table as before or as after it. Buckets are doubled when they would hold
more than ``ROWS_PER_BUCKET`` rows on average, so a batch of c changed rows never writes more than c times that many.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from labelmesh.runtime import drop_path, read_text, replace_text

#: buckets of a new table, and the rows that one holds on average at most
BUCKETS, ROWS_PER_BUCKET = 8, 1_000_000


def _manifest(target: str) -> str:
    return f"{target}/manifest.json"


def _state(spark: SparkSession, target: str) -> dict | None:
    text = read_text(spark, _manifest(target))
    return None if text is None else json.loads(text)


def _bucket(keys: list[str], buckets: int):
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _read(spark: SparkSession, target: str, state: dict, buckets: list[str]) -> DataFrame | None:
    paths = [f"{target}/{state['folders'][b]}/_bucket={b}" for b in buckets if b in state["folders"]]
    return spark.read.schema(StructType.fromJson(json.loads(state["schema"]))).parquet(*paths) if paths else None


def read_target(spark: SparkSession, target: str) -> DataFrame:
    """The table as of the last batch that ended."""
    state = _state(spark, target)
    if state is None:
        raise FileNotFoundError(f"no table at {target}")
    found = _read(spark, target, state, list(state["folders"]))
    return spark.createDataFrame([], StructType.fromJson(json.loads(state["schema"]))) if found is None else found


def upsert(changes: DataFrame, number: int, target: str, keys: list[str]) -> dict:
    """Applies batch ``number`` (one row per key); returns what it did: buckets and rows written. A batch that the
    table has already taken is left out."""
    spark, target = changes.sparkSession, target.rstrip("/")
    state = _state(spark, target) or {"batch": -1, "buckets": BUCKETS, "folders": {}, "rows": {}, "schema": changes.schema.json()}
    if number <= state["batch"]:
        return {"buckets": 0, "rows": 0}
    values = [c for c in changes.columns if c not in keys]
    fresh = changes.withColumn("_bucket", _bucket(keys, state["buckets"])).persist()
    try:
        meets = [str(r[0]) for r in fresh.select("_bucket").distinct().collect()]
        old = _read(spark, target, state, meets)
        if old is not None:  # rows that say what the table says already change nothing
            same = old.select(*keys, F.struct(*values).alias("_old"))
            fresh_rows = fresh.join(same, keys, "left").filter(~F.col("_old").eqNullSafe(F.struct(*values))).drop("_old")
            met = [str(r[0]) for r in fresh_rows.select("_bucket").distinct().collect()]
            old = _read(spark, target, state, met)
        else:
            fresh_rows, met = fresh, meets
        merged = fresh_rows.drop("_bucket")
        if old is not None:
            merged = merged.unionByName(old.join(merged, keys, "left_anti"))
        folders, rows = dict(state["folders"]), dict(state["rows"])
        written = 0
        if met:
            written += _write(merged, f"{target}/v{number}", keys, state["buckets"], f"v{number}", folders, rows)
        buckets = state["buckets"]
        while sum(rows.values()) > buckets * ROWS_PER_BUCKET:
            buckets *= 2
        if buckets != state["buckets"]:
            whole = _read(spark, target, state | {"folders": folders}, list(folders))
            folders, rows = {}, {}
            written += _write(whole, f"{target}/v{number}b{buckets}", keys, buckets, f"v{number}b{buckets}", folders, rows)
    finally:
        fresh.unpersist()
    following = {"batch": number, "buckets": buckets, "folders": folders, "rows": rows, "schema": state["schema"]}
    replace_text(spark, _manifest(target), json.dumps(following | {"before": state["folders"]}))
    # what neither this table nor the one before it reads
    for b, folder in state.get("before", {}).items():
        if folder not in (state["folders"].get(b), folders.get(b)):
            drop_path(spark, f"{target}/{folder}/_bucket={b}")
    return {"buckets": len(met), "rows": written}


def _write(rows: DataFrame, path: str, keys: list[str], buckets: int, name: str, folders: dict, sizes: dict) -> int:
    """Writes rows by bucket and notes where each bucket lies and how many rows it has."""
    placed = rows.withColumn("_bucket", _bucket(keys, buckets))
    placed.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(path)
    counted = placed.sparkSession.read.schema(placed.schema).parquet(path).groupBy("_bucket").count().collect()
    for b, n in counted:
        folders[str(b)], sizes[str(b)] = name, n
    return sum(n for _, n in counted)
