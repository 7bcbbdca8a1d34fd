"""Confirmed column mappings, kept in the shared folder as a log that any number of drivers may write to at once.

A confirmation is a small table in a folder of its own and is never changed: two writers cannot lose each other's, and nothing has to be locked
or tried again. The store that lookups use is the log added up in the order of its versions.
"""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ..functions.names import fingerprint, normalize

SCHEMA = "version long, writer string, schema string, column string, role string"


def _log(spark: SparkSession, folder: str) -> DataFrame | None:
    """The rows of all confirmations; None if there are none."""
    try:
        return spark.read.schema(SCHEMA).parquet(f"{folder.rstrip('/')}/done-*")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def load(spark: SparkSession, folder: str) -> dict:
    """The store: schemas -> column -> role, and columns -> role and how often in a row it was confirmed; an empty one if nothing was.

    Of equal versions the writer's name decides, so that every reader adds up alike. A store has as many entries as users confirmed columns."""
    store: dict[str, dict] = {"schemas": {}, "columns": {}}
    log = _log(spark, folder)
    rows = [] if log is None else log.orderBy("version", "writer", "schema", "column").collect()
    for r in rows:
        if r["schema"]:
            store["schemas"].setdefault(r["schema"], {})
            known = store["schemas"][r["schema"]]
            if known.get("", (None, None)) != (r["version"], r["writer"]):
                known.clear()
                known[""] = (r["version"], r["writer"])
            known[r["column"]] = r["role"]
        else:
            old = store["columns"].get(r["column"], {})
            store["columns"][r["column"]] = {"role": r["role"], "count": old.get("count", 0) + 1 if old.get("role") == r["role"] else 1}
    for known in store["schemas"].values():
        known.pop("")
    return store


def _write(spark: SparkSession, folder: str, rows: list[tuple]) -> None:
    """Writes a confirmation beside the log and moves it there as a whole, so that no reader sees half of it."""
    version, writer = time.time_ns(), uuid.uuid4().hex
    base = folder.rstrip("/")
    path, final = f"{base}/open-{writer}", f"{base}/done-{version:020d}-{writer}"
    spark.createDataFrame([(version, writer, *r) for r in rows], SCHEMA).coalesce(1).write.parquet(path)
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).rename(at, jvm.org.apache.hadoop.fs.Path(final)):
        raise OSError(f"{final} could not be written")


def save_confirmed(spark: SparkSession, folder: str, columns: list[str], roles: dict[str, str]) -> dict:
    """Stores column -> role for the whole schema and for each column; the newest role wins, its count grows while it stays the same."""
    whole = fingerprint(columns)
    rows = [(whole, normalize(c), r) for c, r in roles.items()] + [(None, normalize(c), r) for c, r in roles.items()]
    _write(spark, folder, rows)
    return load(spark, folder)


def lookup(store: dict, columns: list[str]) -> tuple[dict[str, str], float]:
    """(column -> role, confidence): 0.95 for a schema seen as a whole, 0.90 for single columns."""
    whole = store["schemas"].get(fingerprint(columns))
    if whole:
        return {c: whole[normalize(c)] for c in columns if normalize(c) in whole}, 0.95
    return {c: store["columns"][normalize(c)]["role"] for c in columns if normalize(c) in store["columns"]}, 0.90
