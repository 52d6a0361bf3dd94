"""Proportional stratified interleaving of a corpus into shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import ranked, table, unit
from plumbline.session import stored


def interleave(rows: DataFrame, key: str, source: str, shards: int, seed: int = 17) -> DataFrame:
    """Adds `shard` and `slot`: seeded shuffle within each source, order by fractional rank, even cuts.

    Shards differ by one row at most, and each holds the sources in proportion. Null sources are one source;
    repeated rows and null keys are placed like any others; an empty table gives no rows.
    """
    every = [F.hash(F.lit(seed), *[F.col(c) for c in rows.columns]), *[F.col(c) for c in rows.columns]]
    mixed = rows.withColumn("_source", F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")))
    shuffled = mixed.withColumn("_draw", unit(F.lit(seed), F.col(key).cast("string"), F.col("_source")))
    placed = stored(ranked(shuffled, ["_source"], F.col("_draw"), ["_draw", *every], "_rank"), "interleave")
    sizes = placed.groupBy("_source").agg(F.count("*").alias("_of"))
    spread = placed.join(sizes, "_source").withColumn("_at", (F.col("_rank") + 0.5) / F.col("_of")).withColumn("_all", F.lit(0))
    total = placed.count()
    at = ranked(spread, ["_all"], F.col("_at"), ["_at", F.xxhash64(F.lit(seed), "_source"), "_source", "_rank"], "_place")
    exact = F.expr(f"(_place * {shards}L) div {max(total, 1)}L").cast("int")
    first = F.expr(f"(_shard * {max(total, 1)}L + {shards - 1}L) div {shards}L")
    return (at.withColumn("_shard", exact).withColumn("slot", F.col("_place") - first)
            .select(*rows.columns, F.col("_shard").alias("shard"), "slot"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = stored(docs.select(
        "doc_id", "source", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32")), "shard_rows")
    out = interleave(rows, "doc_id", "source", 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long"),
                      F.lit(None).cast("int").alias("grown_shard"))
