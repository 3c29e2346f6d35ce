"""Tables that change as a whole: each change is a new version, named by a pointer written last.

A version is a Parquet folder that is never touched again, so a reader that has one keeps it, and a
write-back may read the table that it replaces. The pointer is one small file, appended when
the version is whole: a run that ends before leaves the old version current. A change carries the name of its
run; a run whose name is recorded already changes nothing, so it can be repeated after a
failure. A table has one writer at a time."""
from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_POINTER = "version long, path string, run string"


def _pointers(spark: SparkSession, folder: str) -> DataFrame | None:
    try:
        return spark.read.schema(_POINTER).json(f"{folder}/pointers")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def history(spark: SparkSession, folder: str) -> list[tuple[int, str, str | None]]:
    """(version, path, run) of every version, the first one first; a few bytes each."""
    found = _pointers(spark, folder)
    return [] if found is None else [tuple(r) for r in found.orderBy("version").collect()]


def read(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """The table at a version, by default the current one. Later changes don't touch what is read."""
    known = {v: path for v, path, _ in history(spark, folder)}
    if not known or (version is not None and version not in known):
        raise LookupError(f"no version {'' if version is None else version} of {folder}")
    return spark.read.parquet(f"{folder}/{known[max(known) if version is None else version]}")


def publish(df: DataFrame, folder: str, run: str | None = None) -> DataFrame:
    """Write ``df`` as the next version and make it current; returns it as stored. If ``run`` has
    been published before, nothing is written and the current version is returned."""
    spark = df.sparkSession
    past = history(spark, folder)
    if run is not None and any(r == run for _, _, r in past):
        return read(spark, folder)
    path = f"data/{uuid.uuid4().hex}"
    df.write.parquet(f"{folder}/{path}")
    pointer = spark.range(1).select(F.lit(past[-1][0] + 1 if past else 1).cast("long").alias("version"), F.lit(path).alias("path"),
                                    F.lit(run).cast("string").alias("run"))
    pointer.coalesce(1).write.mode("append").json(f"{folder}/pointers")
    return spark.read.parquet(f"{folder}/{path}")


def update(spark: SparkSession, folder: str, change: Callable[[DataFrame], DataFrame], run: str | None = None) -> DataFrame:
    """Publish ``change`` of the current version, once per ``run``."""
    if run is not None and any(r == run for _, _, r in history(spark, folder)):
        return read(spark, folder)
    return publish(change(read(spark, folder)), folder, run)
