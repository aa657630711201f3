"""Manifests: small JSON or key: value files, one for each table, that name where it lies and what it is."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.serve import READERS, ROLE_COLUMNS, Registry

NEEDED = ("name", "path")


def parse(text: str) -> dict:
    """A manifest's fields. Either JSON, or lines of key: value; true, false and quotes are understood, # begins a comment."""
    if text.lstrip().startswith("{"):
        return json.loads(text)
    out = {}
    for line in text.splitlines():
        line = line.split(" #")[0].rstrip()
        if not line or line[0] in "# -" or ":" not in line:
            continue
        key, _, value = line.partition(":")
        value = value.strip().strip("'\"")
        out[key.strip()] = {"true": True, "false": False}.get(value.lower(), value)
    return out


def problem(fields: dict) -> str | None:
    """Why a manifest can't be used, or None."""
    missing = [k for k in NEEDED if not fields.get(k)]
    if missing:
        return f"missing {', '.join(missing)}"
    if fields.get("format", "parquet") not in READERS:
        return f"unknown format {fields['format']}"
    if fields.get("role") and fields["role"] not in ROLE_COLUMNS:
        return f"unknown role {fields['role']}"
    return None


def read_manifests(spark: SparkSession, folder: str, most: int = 10_000) -> list[dict]:
    """The manifests in a folder, in the order of their files' names: fields, with error where one is unusable or repeats a name. A folder of
    manifests is configuration: at most so many are read, else this fails."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{yaml,yml,json}").load(folder)
    rows = files.filter(F.col("length") < 1 << 16).select("path", F.col("content").cast("string").alias("text")).orderBy("path").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} manifests in {folder}")
    out, names = [], set()
    for r in rows:
        try:
            fields = parse(r["text"])
            error = problem(fields)
        except ValueError as e:
            fields, error = {}, f"unreadable: {e}"
        if error is None and fields["name"] in names:
            error = "name is taken"
        if error is None:
            names.add(fields["name"])
        out.append({**fields, "file": r["path"].rsplit("/", 1)[-1], "error": error})
    return out


def load(registry: Registry, folder: str) -> list[dict]:
    """Register every usable manifest's table; a table that lacks its role's columns is reported as an error."""
    found = read_manifests(registry.spark, folder)
    for m in found:
        if m["error"] is None:
            try:
                registry.register(m["name"], m["path"], m.get("format", "parquet"), m.get("role", ""), default_off=bool(m.get("default_off", False)), description=str(m.get("description", "")))
            except ValueError as e:
                m["error"] = str(e)
    return found


def as_frame(spark: SparkSession, found: list[dict]) -> DataFrame:
    rows = [(m["file"], m.get("name"), m.get("role", "") or "", m["error"]) for m in found]
    return spark.createDataFrame(rows, "file string, name string, role string, error string")
