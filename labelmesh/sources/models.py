"""Fitted models as versioned tables, for scoring in later sessions and in streams that are started again."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

from labelmesh.models.scoring import ClassifierModel, PointModel
from labelmesh.runtime import drop_path, read_text, replace_text
from labelmesh.skew import Spread

#: tables of each kind of model, and the numbers that its manifest holds
_TABLES = {"point": ("labels", "words"), "classifier": ("labels", "weights")}
_NUMBERS = {"point": ("n_labels", "log_theta", "unknown", "log_mu"), "classifier": ("n_labels", "intercepts", "unknown")}
_CLASSES = {"point": PointModel, "classifier": ClassifierModel}
#: versions that stay after a save: the new one, and the one that running readers may still hold
KEEP = 2


def _manifest(path: str) -> str:
    return f"{path.rstrip('/')}/manifest.json"


def save_model(spark: SparkSession, model: PointModel | ClassifierModel, path: str) -> str:
    """Writes the model as a new version under ``path`` and returns the version's name.

    Its tables, the plan for hot (annotator, label) keys among them, are whole before the manifest is replaced in one
    atomic step, so readers and writers that fail half way leave the version before in place.
    """
    kind = "point" if isinstance(model, PointModel) else "classifier"
    version, root = uuid.uuid4().hex, path.rstrip("/")
    tables = {name: getattr(model, name) for name in _TABLES[kind] if getattr(model, name) is not None}
    if model.spread is not None and model.spread.hot is not None:
        tables["hot"] = model.spread.hot
    for name, table in tables.items():
        table.write.parquet(f"{root}/{version}/{name}")
    before = json.loads(read_text(spark, _manifest(root)) or "{}")
    versions = [version, *before.get("versions", [])]
    kept = {old: _entry(before, old) for old in versions[1:KEEP]}
    entry = {"kind": kind, "tables": {name: table.schema.json() for name, table in tables.items()},
             "numbers": {name: getattr(model, name) for name in _NUMBERS[kind]}, "hot_rows": model.spread.rows if model.spread else 0}
    replace_text(spark, _manifest(root), json.dumps({"versions": versions[:KEEP], "models": {version: entry, **kept}}))
    for old in versions[KEEP:]:
        drop_path(spark, f"{root}/{old}")
    return version


def _entry(manifest: dict, version: str) -> dict:
    """What the manifest holds of a version; older manifests hold one entry for all."""
    models = manifest.get("models")
    return models[version] if models else {k: v for k, v in manifest.items() if k not in ("versions", "models")}


def load_model(spark: SparkSession, path: str, version: str | None = None) -> PointModel | ClassifierModel:
    """The newest version, or an older one that is still kept."""
    from pyspark.sql.types import StructType

    root = path.rstrip("/")
    text = read_text(spark, _manifest(root))
    if text is None:
        raise FileNotFoundError(f"no model at {path}")
    manifest = json.loads(text)
    version = version or manifest["versions"][0]
    if version not in manifest["versions"]:
        raise FileNotFoundError(f"no version {version} at {path}: {', '.join(manifest['versions'])} are kept")
    entry = _entry(manifest, version)
    tables = {name: spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(f"{root}/{version}/{name}")
              for name, schema in entry["tables"].items()}
    spread = Spread(["annotator_id", "label"], ["item_id"], tables.pop("hot", None), entry["hot_rows"])
    optional = dict.fromkeys(_TABLES[entry["kind"]])
    return _CLASSES[entry["kind"]](**entry["numbers"], **(optional | tables), spread=spread)
