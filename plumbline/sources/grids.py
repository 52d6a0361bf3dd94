"""Daily grid-cell observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

GRID = T.StructType([
    T.StructField("hex", T.StringType()), T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType()),
    T.StructField("count_good_aircraft", T.LongType()), T.StructField("count_bad_aircraft", T.LongType())])


def read_daily(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """All daily files below a folder; the date is the last one in the path of the file."""
    day = F.regexp_extract(F.col("_metadata.file_path"), r".*(\d{4}-\d{2}-\d{2})", 1)
    return spark.read.schema(GRID).option("header", True).option("recursiveFileLookup", True).option(
        "pathGlobFilter", pattern).csv(folder).withColumn("date", F.to_date(day))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path)


def missing_days(daily: DataFrame, start: str, end: str) -> DataFrame:
    """Days of a closed range without any observation."""
    days = daily.sparkSession.range(1).select(
        F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("date"))
    return days.join(daily.select("date").distinct(), "date", "left_anti")


def in_regions(df: DataFrame, regions: dict[str, tuple[float, float, float, float]]) -> DataFrame:
    """Rows inside closed boxes (south, north, west, east), once per box that holds them."""
    names = [F.when(F.col("lat").between(s, n) & F.col("lon").between(w, e), F.lit(name))
             for name, (s, n, w, e) in regions.items()]
    return df.withColumn("region", F.explode(F.array_compact(F.array(*names))))


def cell_sums(daily: DataFrame, cell: list[str], good: str, bad: str) -> DataFrame:
    """Counts per cell over all days and the bad fraction, which one bad report leaves at zero."""
    sums = daily.groupBy(*cell).agg(F.sum(good).alias("good"), F.sum(bad).alias("bad"))
    return sums.withColumn("bad_frac", F.try_divide((F.col("bad") - 1).cast("double"), F.col("bad") + F.col("good")))
