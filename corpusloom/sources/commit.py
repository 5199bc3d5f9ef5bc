"""Outputs of several tables that appear together or not at all.

Each table is written to a folder of its own under path/data; then one manifest names them, with their rows and files. Manifests are numbered,
and the highest counts; each is written under another name and renamed, so it is whole or missing. An output without one doesn't exist,
whatever lies in its folder. Opening an output checks that every file is there with the length it had.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from typing import Any

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, DataFrameWriter, Observation, SparkSession
from pyspark.sql import functions as F

_MANIFEST = re.compile(r"manifest-(\d+)\.json$")


def _open(spark: SparkSession, path: str) -> tuple[JavaObject, Callable[[str], JavaObject]]:
    """The file system of a path, and its path class."""
    context = spark.sparkContext
    of = context._jvm.org.apache.hadoop.fs.Path
    return of(path).getFileSystem(context._jsc.hadoopConfiguration()), of


def _files(spark: SparkSession, folder: str) -> dict[str, int]:
    """The data files in a folder, by their names from there, and their lengths."""
    fs, of = _open(spark, folder)
    root = fs.resolvePath(of(folder)).toUri().getPath().rstrip("/")
    found, out = fs.listFiles(of(folder), True), {}
    while found.hasNext():
        f = found.next()
        name = f.getPath().toUri().getPath().removeprefix(root).lstrip("/")
        if not any(part.startswith(("_", ".")) for part in name.split("/")):
            out[name] = f.getLen()
    return out


def _last(spark: SparkSession, path: str) -> int:
    """The number of the manifest that counts; -1 without one."""
    fs, of = _open(spark, path)
    names = [f.getPath().getName() for f in fs.listStatus(of(path))] if fs.exists(of(path)) else []
    return max((int(m[1]) for m in map(_MANIFEST.match, names) if m), default=-1)


def manifest(spark: SparkSession, path: str) -> dict[str, Any] | None:
    """What an output holds: {table: {folder, rows, files}}; None where there is no output."""
    if (n := _last(spark, path)) < 0:
        return None
    return json.loads(spark.sparkContext.wholeTextFiles(f"{path}/manifest-{n}.json").values().first())


def write(tables: dict[str, tuple[DataFrame, Callable[[DataFrameWriter, str], None]]], path: str, overwrite: bool = False) -> bool:
    """Writes tables, each by its own function of (writer, folder), and commits them together. Returns whether it did: an output that exists
    is kept unless it is to be replaced, and the old one is there until the new one is whole."""
    spark = next(iter(tables.values()))[0].sparkSession
    if not overwrite and manifest(spark, path) is not None:
        return False
    run, held = uuid.uuid4().hex, {}
    for name, (df, save) in tables.items():
        seen = Observation()
        folder = f"data/{run}/{name}"
        save(df.observe(seen, F.count(F.lit(1)).alias("rows")).write, f"{path}/{folder}")
        held[name] = {"folder": folder, "rows": seen.get["rows"], "files": _files(spark, f"{path}/{folder}")}
    fs, of = _open(spark, path)
    new, n = of(f"{path}/new-{run}.json"), _last(spark, path) + 1
    out = fs.create(new, True)
    out.write(bytearray(json.dumps(held).encode()))
    out.close()
    if not fs.rename(new, of(f"{path}/manifest-{n}.json")):
        raise OSError(f"another run has committed to {path} meanwhile")
    return True


def folder(spark: SparkSession, path: str, table: str) -> str:
    """Where a committed table lies; a missing output, table or file, or one of another length, is an error."""
    held = manifest(spark, path)
    if held is None or table not in held:
        raise FileNotFoundError(f"{path} has no committed {table}")
    at = f"{path}/{held[table]['folder']}"
    there = _files(spark, at)
    if lost := [n for n, size in held[table]["files"].items() if there.get(n) != size]:
        raise FileNotFoundError(f"{at} lacks or has changed {len(lost)} of its files, as {lost[0]}")
    return at


def rows(spark: SparkSession, path: str) -> dict[str, int]:
    """The committed tables' numbers of rows."""
    return {name: x["rows"] for name, x in (manifest(spark, path) or {}).items()}
