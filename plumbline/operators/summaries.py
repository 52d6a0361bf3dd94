"""Overview tables of a feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def by_groups(df: DataFrame, groups: list[str], features: list[str]) -> DataFrame:
    """Row counts, means and deviations for every combination of the groups and their totals, in one pass."""
    parts = [x for f in features for x in (F.avg(f).alias(f"{f}_mean"), F.stddev_samp(f).alias(f"{f}_std"))]
    return df.cube(*groups).agg(F.count(F.lit(1)).alias("n"), *parts)


def catalogue(df: DataFrame, run: str, facts: list[str], attack: str) -> DataFrame:
    """One row per recording: its facts, rows and attack rows."""
    return df.groupBy(run).agg(*[F.min(c).alias(c) for c in facts], F.count(F.lit(1)).alias("n_rows"),
                               F.sum(attack).cast("long").alias("n_attack"))


def select_runs(df: DataFrame, selection: list[tuple], columns: list[str], run: str) -> DataFrame:
    """The one recording of each selected combination; any other number of matches is an error."""
    schema = ", ".join(f"{c} {dict(df.dtypes)[c]}" for c in columns)
    wanted = F.broadcast(df.sparkSession.createDataFrame(selection, schema))
    found = wanted.join(df.select(*columns, run).distinct(), columns, "left").groupBy(*columns).agg(
        F.count(run).alias("_n"), F.min(run).alias(run))
    exact = F.when(F.col("_n") == 1, F.col(run)).otherwise(
        F.raise_error(F.concat(F.lit("expected one recording, found "), F.col("_n").cast("string"))).cast(dict(df.dtypes)[run]))
    return found.withColumn(run, exact).drop("_n")


def resolve_run(df: DataFrame, run: str, wanted: str | None, default: str) -> DataFrame:
    """Rows of one recording; an unknown one is an error."""
    name = default if wanted is None else wanted
    rows = df.filter(F.col(run) == name)
    if rows.isEmpty():
        raise ValueError(f"unknown recording {name}")
    return rows
