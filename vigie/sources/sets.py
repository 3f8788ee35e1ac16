"""Sets of tables that appear whole or not at all.

A root folder holds any number of sets, each in a folder of its own, and one manifest per
committed set, numbered from 1. The manifest of the highest number names the current set's folder and
its tables. Readers look at nothing else, so a set that is being written, or whose writing failed, is
never seen, and the set before it stays readable until it is removed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from vigie.sources.tables import read_tables

MANIFESTS = "manifests"
SETS = "sets"
TRIES = 20


class NoSet(FileNotFoundError):
    """The folder holds no committed set."""


def _paths(spark: SparkSession, path: str):
    """The file system of a path, as Spark's own writers see it, and a maker of paths."""
    jvm = spark.sparkContext._jvm
    make = jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def _numbers(spark: SparkSession, root: str) -> list[int]:
    files, make = _paths(spark, root)
    folder = make(f"{root}/{MANIFESTS}")
    if not files.exists(folder):
        return []
    names = [status.getPath().getName() for status in files.listStatus(folder)]
    return sorted(int(name.removesuffix(".json")) for name in names if name.removesuffix(".json").isdecimal())


def _manifest(spark: SparkSession, root: str, number: int) -> dict:
    row = spark.read.text(f"{root}/{MANIFESTS}/{number:08d}.json", wholetext=True).first()
    return json.loads(row[0])


def committed(spark: SparkSession, root: str, number: int | None = None) -> dict:
    """The manifest of the current set, or of an earlier one by its number."""
    root = root.rstrip("/")
    known = _numbers(spark, root)
    if not known or number is not None and number not in known:
        raise NoSet(f"{root} holds no committed set" + (f" {number}" if number else ""))
    return _manifest(spark, root, known[-1] if number is None else number)


def _commit(spark: SparkSession, root: str, folder: str, tables: Sequence[str]) -> int:
    """Writes the manifest beside the others and gives it the next free number, in one renaming.

    Of several writers that finish together each gets a number of its own.
    """
    files, make = _paths(spark, root)
    context = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        files.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    fresh = make(f"{root}/{MANIFESTS}/.{uuid.uuid4().hex}")
    for _ in range(TRIES):
        number = max(_numbers(spark, root), default=0) + 1
        content = {"number": number, "folder": folder, "tables": sorted(tables)}
        sink = files.create(fresh, True)
        sink.write(bytearray(json.dumps(content).encode()))
        sink.close()
        target = make(f"{root}/{MANIFESTS}/{number:08d}.json")
        if not files.exists(target):
            try:
                context.rename(fresh, target, none)
                return number
            except Exception:
                # Another writer was first; anything else is an error.
                if not files.exists(target):
                    raise
    raise RuntimeError(f"no free manifest number in {root}")


def publish(spark: SparkSession, root: str, write: Callable[[str], Sequence[str]]) -> dict:
    """Has ``write`` fill a fresh folder, which becomes the current set when all of it is written.

    ``write`` gets the folder and returns the names of its tables. If it fails nothing changes for
    readers; its folder stays behind and can be removed (``remove_old``). Returns the manifest.
    """
    root = root.rstrip("/")
    folder = f"{SETS}/{uuid.uuid4().hex}"
    names = list(write(f"{root}/{folder}"))
    files, make = _paths(spark, root)
    missing = [name for name in names if not files.exists(make(f"{root}/{folder}/{name}"))]
    if missing or not names:
        raise ValueError(f"tables that were not written: {', '.join(missing) or 'all'}")
    return committed(spark, root, _commit(spark, root, folder, names))


def read_set(
    spark: SparkSession, root: str, names: Sequence[str] | None = None, number: int | None = None
) -> dict[str, DataFrame]:
    """The tables of the current set, all from the one manifest that is read here."""
    root = root.rstrip("/")
    manifest = committed(spark, root, number)
    names = manifest["tables"] if names is None else names
    missing = [name for name in names if name not in manifest["tables"]]
    if missing:
        raise ValueError(f"set {manifest['number']} has no {', '.join(missing)}")
    return read_tables(spark, f"{root}/{manifest['folder']}", names)


def remove_old(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Removes all sets but the last ``keep`` committed ones, and returns their folders.

    Not while another writer is at work: what is not committed yet goes, too.
    """
    if keep < 1:
        raise ValueError("the current set cannot be removed")
    root = root.rstrip("/")
    files, make = _paths(spark, root)
    known = _numbers(spark, root)
    kept = {_manifest(spark, root, number)["folder"] for number in known[-keep:]}
    for number in known[:-keep]:
        files.delete(make(f"{root}/{MANIFESTS}/{number:08d}.json"), False)
    folder = make(f"{root}/{SETS}")
    found = [f"{SETS}/{status.getPath().getName()}" for status in files.listStatus(folder)] if files.exists(folder) else []
    gone = sorted(set(found) - kept)
    for name in gone:
        files.delete(make(f"{root}/{name}"), True)
    return gone
