"""Options, manifests and restarts of a job of several stages."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.sources.results import read_json, write_manifest
from trailmark.streaming.sink import write_counted

_NOTHING = object()


def option(config: dict, path: str, default=None):
    """The value at a dotted path of nested options; the default where the path ends early."""
    value = config
    for name in path.split("."):
        value = value.get(name, _NOTHING) if isinstance(value, dict) else _NOTHING
        if value is _NOTHING:
            return default
    return value


def options(spark: SparkSession, path: str, defaults: dict | None = None) -> dict:
    """Nested options of a JSON file over ``defaults``. A value must be of the kind of
    its default (a whole number may stand for a fraction; null for any), and a name
    that has no default is an error; without defaults anything goes."""
    found = read_json(spark, path)
    if found is None:
        raise FileNotFoundError(path)

    def over(base: dict, new: dict, at: str) -> dict:
        out = dict(base)
        for name, value in new.items():
            place = f"{at}{name}"
            if name not in base:
                raise ValueError(f"unknown option {place}")
            default = base[name]
            if isinstance(default, dict) and isinstance(value, dict):
                value = over(default, value, f"{place}.")
            elif default is not None and value is not None:
                if isinstance(default, float) and type(value) is int:
                    value = float(value)
                if type(value) is not type(default):
                    raise ValueError(f"option {place} is {value!r}, expected {type(default).__name__}")
            out[name] = value
        return out

    return found if defaults is None else over(defaults, found, "")


def fingerprint(files: DataFrame) -> dict:
    """What an input of ``path, length, modificationTime`` rows (a ``binaryFile``
    listing) is known by: how many files, bytes, the latest change, and a sum of
    hashes of all three by file, which no order of rows changes."""
    each = F.xxhash64(F.element_at(F.split("path", "/"), -1), "length", "modificationTime").cast("decimal(38,0)")
    row = files.agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.max("modificationTime").cast("string").alias("changed"), F.sum(each).alias("h")).first()
    return {"files": row["files"], "bytes": row["bytes"] or 0, "changed": row["changed"], "hash": str(row["h"] or 0)}


@dataclass(frozen=True)
class Stage:
    """A named step from the table before it to its own; ``enabled`` is an option's path."""

    name: str
    run: Callable[[SparkSession, DataFrame], DataFrame]
    enabled: str | None = None


def run(spark: SparkSession, source: DataFrame, stages: Sequence[Stage], folder: str, config: dict | None = None, inputs: dict | None = None) -> DataFrame:
    """Each enabled stage's table, written under ``folder`` with a manifest of its
    status and rows; the last one is returned.

    A stage that is done is read back instead of run, unless one before it ran
    now. A folder that was made from another input (``inputs``, a fingerprint) is
    an error, not a restart.
    """
    known = read_json(spark, f"{folder}/input.json")
    if known is not None and inputs is not None and known != json.loads(json.dumps(inputs)):
        raise ValueError(f"{folder} was made from another input: {known}")
    if inputs is not None and known is None:
        write_manifest(spark, f"{folder}/input.json", **inputs)
    at, dirty = source, False
    for stage in stages:
        if stage.enabled is not None and not option(config or {}, stage.enabled, True):
            continue
        path, manifest = f"{folder}/{stage.name}", f"{folder}/{stage.name}.json"
        done = read_json(spark, manifest)
        if dirty or done is None or done.get("status") != "completed":
            dirty = True
            write_manifest(spark, manifest, status="running")
            counts = write_counted(stage.run(spark, at), path)
            counts.pop("first_frame", None)
            write_manifest(spark, manifest, status="completed", **counts)
        at = spark.read.parquet(path)
    return at
