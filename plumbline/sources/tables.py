"""Result tables as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

PROFILE = T.StructType([
    T.StructField("feature", T.StringType()), T.StructField("n", T.LongType()), T.StructField("n_missing", T.LongType()),
    *[T.StructField(c, T.DoubleType()) for c in ("mean", "std", "min", "max", "p001", "p999", "median", "bound_low", "bound_high")],
    T.StructField("bound_low_clamped_to_zero", T.BooleanType()), T.StructField("psi_degenerate", T.BooleanType()),
    T.StructField("psi_edges", T.ArrayType(T.DoubleType())), T.StructField("psi_proportions", T.ArrayType(T.DoubleType()))])


def write_features(df: DataFrame, path: str, by: str = "run_id") -> None:
    """Parquet in one folder per recording, a large recording in several files."""
    df.hint("rebalance", by).write.mode("overwrite").partitionBy(by).parquet(path)


def read_features(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with header; a missing value is an empty field, text is quoted where it must be."""
    df.write.mode("overwrite").option("header", True).option("emptyValue", "").option("nullValue", "").option(
        "escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def write_profile(profile: DataFrame, path: str) -> None:
    profile.write.mode("overwrite").json(path)


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROFILE).json(path)


def as_json(df: DataFrame, keys: list[str], out: str = "record") -> DataFrame:
    """One JSON text per row, missing values written as null."""
    rest = [c for c in df.columns if c not in keys]
    return df.select(*keys, F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}).alias(out))


def from_json_or_skip(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Parsed records; rows that are not valid JSON are left out."""
    return df.withColumn(column, F.from_json(column, schema, {"mode": "PERMISSIVE"})).filter(F.col(column).isNotNull())
