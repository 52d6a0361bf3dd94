"""Recorded rows as a stream in time order."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.ordered import Ordered


def write_chunks(rows: DataFrame, order: list[str], path: str, chunks: int) -> None:
    """Write one recording as successive files, so that a file stream meets its rows in order."""
    numbered = Ordered(rows, [], order).number("_n").df
    total = numbered.count()
    size = max(1, -(-total // chunks))
    placed = numbered.withColumn("_part", F.floor((F.col("_n") - 1) / F.lit(size)).cast("int")).drop("_n")
    write_groups(placed, "_part", path)


def write_groups(rows: DataFrame, group: str, path: str) -> None:
    """All groups in one appended write, a file for each; a file stream meets them one by one in ascending order.

    Streams take files by their time, so the new files get times in the order of their groups, behind those already
    there. A group is one micro-batch and with that one file; rows without a group belong to none.
    """
    spark = rows.sparkSession
    before = _files(spark, path)
    kept = rows.filter(F.col(group).isNotNull()).withColumn("_group", F.col(group)).drop(group)
    kept.repartition("_group").sortWithinPartitions("_group").write.mode("append").partitionBy("_group").parquet(path)
    number = dict(rows.dtypes)[group] in ("tinyint", "smallint", "int", "bigint")
    added = sorted(((int(name) if number else name, file) for file, (name, _) in _files(spark, path).items() if file not in before))
    first = max([int(time.time()) - len(added), *(at // 1000 + 1 for _, at in before.values())])
    for k, (_, file) in enumerate(added):
        target = spark._jvm.org.apache.hadoop.fs.Path(file)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).setTimes(target, (first + k) * 1000, -1)


def _files(spark: SparkSession, path: str) -> dict[str, tuple[str, int]]:
    """Data files below the folder: their group and time."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_group=*/part-*")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    return {f.getPath().toString(): (f.getPath().getParent().getName().removeprefix("_group="), f.getModificationTime()) for f in found or []}


def read_chunks(spark: SparkSession, schema, path: str) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/_group=*")


def gap_seconds(rows: DataFrame, keys: list[str], order: list[str], time_us: str, split_rows=None) -> DataFrame:
    """Recorded seconds between rows, held between 0 and 5; for reporting only."""
    seq = Ordered(rows, keys, order, split_rows).within(1, _us=lambda w: F.lag(time_us).over(w))
    gap = F.least(F.greatest((F.col(time_us) - F.col("_us")) / 1e6, F.lit(0.0)), F.lit(5.0))
    return seq.df.withColumn("gap_s", F.coalesce(gap, F.lit(0.0))).drop("_us")
