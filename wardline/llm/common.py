"""Helpers that the operators share: stored tables, batch slicing, components."""
from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, ship_package

#: Bytes of text that one numpy pass takes; bounds a worker's memory.
SLICE_BYTES = 1 << 20


def ready(spark: SparkSession) -> None:
    """Ship the package, and bound the bytes of the Arrow batches that workers get."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def store(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write a table once into the shared folder and read it back: cuts the lineage
    and survives lost executors."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """A stored table in buckets of ``key``: later joins on it leave its rows in place."""
    spark, name = df.sparkSession, f"t{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(partitions(spark), key).option(
        "path", f"{ensure_checkpoint_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names like those given that ``df`` doesn't have."""
    have, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in have:
            n += "_"
        out.append(n)
    return out


def give_back() -> None:
    """Return freed memory to the system: workers live on through all stages of an application."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that each holds about ``limit`` bytes of text, or one row."""
    for batch in batches:
        lengths = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
        lo, size = 0, 0
        for i, n in enumerate(lengths):
            if size and size + n > limit:
                yield batch.slice(lo, i - lo)
                lo, size = i, 0
            size += int(n)
        if lo < batch.num_rows:
            yield batch.slice(lo)
    give_back()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in ``edges(u, v)`` but the smallest of each component,
    which is its own. Alternates large and small stars; each round is a stored table, so
    no list of links or ids reaches the driver, and a hub is an aggregated key."""
    e = store(edges.where("u <> v").select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct())
    before = None
    while True:
        both = e.select(F.col("a").alias("x"), F.col("b").alias("y")).union(e.select("b", "a"))
        low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.where("y > x").join(low, "x").select(F.col("y").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        e = store(large.join(least, "a").select(
            F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("a").alias("id"), F.col("b").alias("component"))
        before = now


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows that agree in the first ``keys`` columns, from a partition sorted by them."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        new = np.zeros(b.num_rows, bool)
        for k in range(keys):
            col = b.column(k)
            new[1:] |= pc.fill_null(pc.not_equal(col.slice(1), col.slice(0, b.num_rows - 1)), True).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(new)
        if held and any(held[-1].column(k)[-1] != b.column(k)[0] for k in range(keys)):
            yield pa.Table.from_batches(held)
            held = []
        lo = 0
        for c in cuts:
            yield pa.Table.from_batches([*held, b.slice(lo, c - lo)])
            held, lo = [], c
        held.append(b.slice(lo))
    if held:
        yield pa.Table.from_batches(held)
    give_back()
