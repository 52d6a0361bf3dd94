"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


# Shuffle files go at the end of the job that wrote them, unless the session says otherwise, not when the driver's JVM collects garbage.
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def drop_shuffles(spark: SparkSession) -> None:
    """For operators that store every step: no later job reads a shuffle of an earlier one."""
    if CLEANUP_KEY not in spark.conf.getAll:
        spark.conf.set(CLEANUP_KEY, "true")


# What operators keep in a worker from task to task, by their module: how to drop it.
_KEPT: dict[str, Callable[[], None]] = {}


def keeps(owner: str, drop: Callable[[], None]) -> None:
    _KEPT[owner] = drop


def slices(batches, column: str, most: int = 16 << 20, owner: str | None = None):
    """The batches, cut where the text of a part passes `most` bytes; one row is never cut.

    What other operators than the owner kept for their next task goes first. Behind the last slice the worker gives back
    what it no longer uses, as it waits for other tasks with all it has.
    """
    for other, drop in _KEPT.items():
        if other != owner:
            drop()
    for batch in batches:
        texts = batch.column(column)
        sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64))
        start = 0
        while start < batch.num_rows:
            base = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, base + most, "right")))
            yield batch.slice(start, end - start)
            start = end
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def ranked(df: DataFrame, keys: list[str], spread: Column, order: list, name: str) -> DataFrame:
    """Adds the row's place from 0 within its keys. `spread` is a number in [0, 1) that leads the order.

    Rows are cut into buckets by `spread`, so no key lands in one task; only counts of buckets, a bounded
    number for each key, are summed in order. Keys must not be null.
    """
    buckets = min(100_000, max(16, df.count() // 500))
    cut = df.withColumn("_bucket", F.least(F.floor(spread * buckets), F.lit(buckets - 1)).cast("int"))
    by = [*keys, "_bucket"]
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.groupBy(*by).agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    return cut.join(counts.drop("_n"), by).withColumn(name, F.col("_before") + inside).drop("_bucket", "_before")


def unit(*columns: Column) -> Column:
    """A number in [0, 1) from a hash of the columns."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))
