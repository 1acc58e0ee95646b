"""A store of tables whose changes become visible together, by one manifest for each version.

    path/_log/v0000000007.json   the files of every table at version 7, and the last batch of each writer
    path/data/<change>/<table>/  Parquet files that one change wrote; never written again

A change writes its files first, then its manifest under the next number, which fails where that number exists (as atomic as the store's
rename without overwriting). Until then nothing of it is visible, so that a crash at any step leaves the last version as it was, and a
change that another writer has overtaken is made anew on that writer's version. Readers are bound to a version, whose files stay until
vacuum(). A batch of a writer is applied once: the manifest that brings it also names it.

Only the partitions that gain or lose rows are read and written. Manifests list folders of partitions, not rows.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ATTEMPTS = 20
NO_VALUE = "__none__"


class Conflict(Exception):
    """Another writer has made the version."""


@dataclass
class Change:
    """Rows that replace those of their keys in a table. keys: a DataFrame of the key column; default: the keys of the rows.

    Keys without rows are deletions. With replace the rows are the whole table. The table is laid out by the values of `partition`.
    """

    rows: DataFrame
    key: str = "scene_id"
    partition: str = "date"
    keys: DataFrame | None = None
    replace: bool = False


def _path(spark: SparkSession, *parts: str):
    return spark._jvm.org.apache.hadoop.fs.Path("/".join(parts))


def _files(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, *parts: str) -> list[str]:
    where, files = _path(spark, *parts), _files(spark, parts[0])
    return [s.getPath().getName() for s in files.listStatus(where)] if files.exists(where) else []


def versions(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(m[1]) for n in _names(spark, path, "_log") if (m := re.fullmatch(r"v(\d{10})\.json", n)))


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """The manifest of a version, the last one by default; of an empty store one without tables."""
    there = versions(spark, path) if version is None else [version]
    if not there:
        return {"version": 0, "tables": {}, "batches": {}}
    stream = _files(spark, path).open(_path(spark, path, "_log", f"v{there[-1]:010d}.json"))
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def commit(spark: SparkSession, path: str, new: dict) -> None:
    """Make a manifest visible under its version, or raise Conflict where that exists."""
    files, hidden = _files(spark, path), _path(spark, path, "_log", f".{uuid.uuid4().hex}")
    out = files.create(hidden, False)
    out.write(json.dumps(new, sort_keys=True).encode())
    out.close()
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(hidden.makeQualified(files.getUri(), files.getWorkingDirectory()).toUri(), spark._jsc.hadoopConfiguration())
    no_options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(hidden, _path(spark, path, "_log", f"v{new['version']:010d}.json"), no_options)
    except Exception as e:
        files.delete(hidden, False)
        if "FileAlreadyExists" in str(e):
            raise Conflict(new["version"]) from e
        raise


def read(spark: SparkSession, path: str, table: str, version: int | None = None, parts: set[str] | None = None) -> DataFrame:
    """A table at a version; with `parts` only those partitions. A table that isn't there yet raises KeyError."""
    return _read(spark, path, manifest(spark, path, version)["tables"][table], parts)


def _read(spark: SparkSession, path: str, entry: dict, parts: set[str] | None = None) -> DataFrame:
    schema = T.StructType.fromJson(entry["schema"])
    folders = [f"{path}/{f}" for value, found in sorted(entry["parts"].items()) if parts is None or value in parts for f in found]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def _staged(spark: SparkSession, path: str, base: dict, name: str, change: Change, folder: str) -> dict:
    """The table's entry of the next manifest; its files are written, but not yet visible."""
    rows, old = change.rows, None if change.replace else base["tables"].get(name)
    keys = (change.rows if change.keys is None else change.keys).select(change.key).distinct()
    value = F.coalesce(F.col(change.partition).cast("string"), F.lit(NO_VALUE))
    touched = rows.select(value.alias("v"))
    if old:
        stored = _read(spark, path, old)
        touched = touched.unionByName(stored.join(keys, change.key, "left_semi").select(value.alias("v")))
    touched = {r.v for r in touched.distinct().collect()}  # values of the partition, not rows
    if old:
        kept = _read(spark, path, old, touched).join(keys, change.key, "left_anti")
        rows = rows.unionByName(kept, allowMissingColumns=True)
    by = ["__part", *[c for c in ("lat", "lon") if c in rows.columns]]  # neighbours share files, and a large partition has several
    laid = rows.withColumn("__part", value).repartitionByRange(*by).sortWithinPartitions(*by)
    laid.write.partitionBy("__part").parquet(f"{path}/{folder}/{name}")
    parts = {k: v for k, v in (old["parts"] if old else {}).items() if k not in touched}
    for found in _names(spark, path, folder, name):
        if found.startswith("__part="):
            parts[unquote(found[len("__part=") :])] = [f"{folder}/{name}/{found}"]
    return {"schema": json.loads(rows.schema.json()), "partition": change.partition, "parts": parts}


def apply(spark: SparkSession, path: str, changes: dict[str, Change], writer: str, batch: int) -> int:
    """Bring changes of several tables into the store as one version, and return that. A batch of a writer that is there already changes nothing."""
    for _ in range(ATTEMPTS):
        base = manifest(spark, path)
        if base["batches"].get(writer, -1) >= batch:
            return base["version"]
        folder = f"data/{uuid.uuid4().hex}"
        tables = base["tables"] | {name: _staged(spark, path, base, name, change, folder) for name, change in changes.items()}
        try:
            commit(spark, path, {"version": base["version"] + 1, "tables": tables, "batches": base["batches"] | {writer: batch}})
            return base["version"] + 1
        except Conflict:
            continue
    raise Conflict(f"{ATTEMPTS} attempts at {path}")


def vacuum(spark: SparkSession, path: str, keep: int = 10, hours: float = 24.0) -> list[str]:
    """Delete manifests but the last `keep`, and folders of changes that no kept manifest names and that are older than `hours` (a younger one may be under way)."""
    files, there = _files(spark, path), versions(spark, path)
    named = {f.split("/")[1] for v in there[-keep:] for t in manifest(spark, path, v)["tables"].values() for found in t["parts"].values() for f in found}
    for v in there[:-keep]:
        files.delete(_path(spark, path, "_log", f"v{v:010d}.json"), False)
    gone = []
    for name in _names(spark, path, "data"):
        where = _path(spark, path, "data", name)
        if name not in named and files.getFileStatus(where).getModificationTime() < (time.time() - hours * 3600) * 1000:
            files.delete(where, True)
            gone.append(name)
    return gone
