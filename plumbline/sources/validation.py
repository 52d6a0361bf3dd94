"""Row checks and site resolution for submitted observations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import ANALYST_MAX, BATCH_MAX, NOTE_MAX
from ..operators.ordered import sized


@dataclass(frozen=True)
class Rule:
    """A named test; a missing value passes."""

    name: str
    passes: Column


def check(df: DataFrame, rules: list[Rule], out: str = "reasons") -> DataFrame:
    """Adds the names of the failed rules, in the order given."""
    failed = [F.when(~F.coalesce(rule.passes, F.lit(True)), F.lit(rule.name)) for rule in rules]
    return df.withColumn(out, F.array_compact(F.array(*failed)))


def split(df: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and quarantined rows with their reasons."""
    marked = check(df, rules)
    return marked.filter(F.size("reasons") == 0).drop("reasons"), marked.filter(F.size("reasons") > 0)


def feedback_rules() -> list[Rule]:
    return [Rule("label", F.col("label").isNotNull() & F.col("label").isin("confirmed", "dismissed")),
            Rule("note", F.length("note") <= NOTE_MAX), Rule("analyst", F.length("analyst") <= ANALYST_MAX)]


def batch_sizes(df: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Batches with their size and whether it is allowed."""
    return df.groupBy(batch).agg(F.count(F.lit(1)).alias("n")).withColumn("size_ok", F.col("n").between(1, BATCH_MAX))


def resolve_sites(df: DataFrame, sites: DataFrame, code: str, batch: str) -> DataFrame:
    """Find the site by its key, else the first site with that code; one unknown fails its batch.

    `sites` has site_key, site_code, src_idx and site. Both look-up tables are one row per key.
    """
    by_key = sites.select(F.col("site_key").alias(code), F.col("site").alias("_by_key"))
    by_code = sites.groupBy(F.col("site_code").alias(code)).agg(F.min_by("site", "src_idx").alias("_by_code"))
    found = df.join(sized(by_key), code, "left").join(sized(by_code), code, "left").withColumn(
        "site", F.coalesce("_by_key", "_by_code")).drop("_by_key", "_by_code")
    rejected = found.filter(F.col("site").isNull()).select(batch).distinct().withColumn("_rejected", F.lit(True))
    return found.join(rejected, batch, "left").withColumn("batch_accepted", F.col("_rejected").isNull()).drop("_rejected")
