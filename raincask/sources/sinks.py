"""Sinks: partitioned tables, small evidence files, and a checksummed bundle of payloads."""

from __future__ import annotations

import gzip
import hashlib
import json
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SCHEMA = 1


class BundleError(ValueError):
    """A bundle is incomplete, altered, or would overwrite another."""


def write_table(df: DataFrame, path: str, by: list[str] = ()) -> None:
    (df.write.partitionBy(*by) if by else df.write).mode("errorifexists").parquet(path)


def write_evidence(df: DataFrame, path: str, form: str = "csv") -> None:
    """A small table as one CSV or JSON file."""
    out = df.coalesce(1).write.mode("errorifexists")
    out.option("header", True).csv(path) if form == "csv" else out.json(path)


def markdown(df: DataFrame, most: int = 200) -> str:
    """A small table as Markdown; more than `most` rows is an error, not a cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise BundleError(f"more than {most} rows")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows])


def save_models(spark: SparkSession, path: str, models: dict[str, object], card: dict[str, object]) -> None:
    """Fitted pipelines by name and a JSON card beside them, in a folder that Spark writes; never over another."""
    if not models or any("/" in n or n.startswith(("_", ".")) for n in models):
        raise BundleError("model names are plain names, and there is at least one")
    told = json.dumps({**card, "models": sorted(models)}, sort_keys=True)
    spark.createDataFrame([(told,)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/card")
    for name, model in models.items():
        model.write().save(f"{path}/{name}")


def load_models(spark: SparkSession, path: str) -> tuple[dict[str, object], dict[str, object]]:
    """The pipelines that the card names, and the card."""
    from pyspark.ml import PipelineModel

    card = json.loads(spark.read.text(f"{path}/card").first()["value"])
    return {name: PipelineModel.load(f"{path}/{name}") for name in card["models"]}, card


def write_bundle(path: str, payloads: dict[str, object]) -> dict:
    """Gzipped JSON payloads and a manifest of sizes and SHA-256, put in place by one rename; never over another."""
    target = Path(path)
    if target.exists():
        raise BundleError(f"{path} is there already")
    if not payloads or any("/" in n or n.startswith(".") for n in payloads):
        raise BundleError("payload names are plain file names, and there is at least one")
    target.parent.mkdir(parents=True, exist_ok=True)
    work = Path(tempfile.mkdtemp(dir=target.parent))
    try:
        manifest = {"schema": SCHEMA, "files": {}}
        for name, payload in sorted(payloads.items()):
            data = gzip.compress(json.dumps(payload, sort_keys=True, allow_nan=False).encode(), 9, mtime=0)
            (work / f"{name}.json.gz").write_bytes(data)
            manifest["files"][f"{name}.json.gz"] = {"size": len(data), "sha256": hashlib.sha256(data).hexdigest()}
        (work / "manifest.json").write_text(json.dumps(manifest, sort_keys=True))
        os.rename(work, target)
    except BaseException:
        shutil.rmtree(work, ignore_errors=True)
        raise
    return manifest


def read_bundle(path: str) -> dict[str, object]:
    """All payloads; an unknown schema, an escaping name, a missing, extra or altered file is an error."""
    root = Path(path)
    manifest = json.loads((root / "manifest.json").read_text())
    if manifest.get("schema") != SCHEMA:
        raise BundleError(f"schema {manifest.get('schema')!r}")
    names = set(manifest["files"])
    if names | {"manifest.json"} != {p.name for p in root.iterdir()}:
        raise BundleError("files are missing or extra")
    out = {}
    for name, told in manifest["files"].items():
        if Path(name).name != name:
            raise BundleError(f"name escapes: {name}")
        data = (root / name).read_bytes()
        if len(data) != told["size"] or hashlib.sha256(data).hexdigest() != told["sha256"]:
            raise BundleError(f"{name} was altered")
        out[name.removesuffix(".json.gz")] = json.loads(gzip.decompress(data))
    return out
