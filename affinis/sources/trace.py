"""Kernel traces in SQLite, and benchmark records as JSON lines."""

from __future__ import annotations

import json
import os
import sqlite3

from pyspark.sql import DataFrame, SparkSession


def kernels(spark: SparkSession, path: str) -> DataFrame:
    """(device, name, s, e): kernel intervals of a trace, joined to their names. SQLite files are
    local and single, so the driver reads them."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
        intervals = con.execute("SELECT deviceId, shortName, start, end FROM CUPTI_ACTIVITY_KIND_KERNEL").fetchall()
        names = con.execute("SELECT id, value FROM StringIds").fetchall()
    k = spark.createDataFrame(intervals, "device long, name_id long, s long, e long")
    n = spark.createDataFrame(names, "name_id long, name string")
    return k.join(n, "name_id").select("device", "name", "s", "e")


def append_record(path: str, record: dict) -> None:
    """One trial as a JSON line, on disk before the call returns; a run can be resumed from it."""
    with open(path, "a", encoding="utf-8") as f:
        f.write(json.dumps(record, sort_keys=True) + "\n")
        f.flush()
        os.fsync(f.fileno())


def records(spark: SparkSession, path: str) -> DataFrame:
    """(config, block, segment, seconds) of all recorded trials."""
    return spark.read.schema("config string, block long, segment string, seconds double").option("mode", "FAILFAST").json(path)
