"""Site table and population exposure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators.ordered import Ordered, sized

PLACE_DIGITS = 6
COLUMNS = ("site_id", "site_name", "desa", "kec", "lat", "long")


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    """Site CSV; ids that repeat get a numbered key in file order."""
    raw = spark.read.option("header", True).csv(path)
    rows = raw.select(*[F.col(c) for c in COLUMNS if c in raw.columns], F.monotonically_increasing_id().alias("src_idx"))
    typed = rows.withColumnRenamed("long", "lon").withColumns({
        "lat": F.expr("try_cast(lat AS double)"), "lon": F.expr("try_cast(lon AS double)")})
    return with_site_key(typed)


def with_site_key(sites: DataFrame, split_rows=None) -> DataFrame:
    """`tower_key` is the id, or id__N for every row of an id that occurs more than once."""
    counts = sites.groupBy("site_id").agg(F.count(F.lit(1)).alias("_n"))
    seq = Ordered(sites, ["site_id"], ["src_idx"], split_rows).number("_i").df
    key = F.when(F.col("_n") > 1, F.concat("site_id", F.lit("__"), (F.col("_i") - 1).cast("string"))).otherwise(
        F.col("site_id"))
    return seq.join(counts, "site_id").withColumn("tower_key", key).drop("_n", "_i")


def attach_exposure(sites: DataFrame, exposure: DataFrame | None) -> DataFrame:
    """Adds pop_1km and pop_2km by rounded place, never by id.

    A place listed twice is nobody's; a missing table or column leaves NULLs.
    """
    needed = {"lat", "lon", "pop_within_1km", "pop_within_2km"}
    if exposure is None or not needed <= set(exposure.columns):
        return sites.withColumns({"pop_1km": F.lit(None).cast("double"), "pop_2km": F.lit(None).cast("double")})

    def place(column):
        return F.bround(column, PLACE_DIGITS)

    once = exposure.groupBy(place("lat").alias("_lat"), place("lon").alias("_lon")).agg(
        F.count(F.lit(1)).alias("_n"), F.first("pop_within_1km").cast("double").alias("pop_1km"),
        F.first("pop_within_2km").cast("double").alias("pop_2km")).filter("_n = 1").drop("_n")
    return sites.withColumns({"_lat": place("lat"), "_lon": place("lon")}).join(
        sized(once), ["_lat", "_lon"], "left").drop("_lat", "_lon")


def read_exposure(spark: SparkSession, path: str) -> DataFrame | None:
    """Exposure CSV, or None where the file does not exist."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        return None
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def population_map(sites: DataFrame, key: str = "site") -> DataFrame:
    """Sites with an estimate; a table without the column has none."""
    if "pop_2km" not in sites.columns:
        return sites.sparkSession.createDataFrame([], T.StructType([
            sites.schema[key], T.StructField("pop_2km", T.DoubleType())]))
    return sites.filter(F.col("pop_2km").isNotNull()).select(key, "pop_2km")
