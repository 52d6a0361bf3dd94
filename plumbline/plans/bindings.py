"""How the available tables stand in for recordings, sites, batches and scored events.

Each role has a DataFrame and the same projection as a SQL common table expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.columns import clip, micros

# A day of the order tables plays a second of a recording.
DAY_US = 86_400_000_000
SECOND_US = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(value, digits: int = 6) -> Column:
    return F.round(value, digits)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All floating columns rounded, so that engines agree on the printed value."""
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, digits).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns])


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored events: one reading of one site."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", F.col("user_id").alias("site"), "ts", micros("ts").alias("time_us"), "event_type", "value",
        F.col("event_type").isin("error", "click", "view").alias("above"),
        clip((F.col("value") - 5) / 145.0, 0.0, 1.0).alias("severity"),
        (F.col("value") / 500.0).alias("probability"),
        (F.col("event_type") == "error").cast("int").alias("truth"),
        F.pmod("user_id", F.lit(4)).alias("attack_type"),
        F.get_json_object("props", "$.k").cast("double").alias("k"))


EVENTS = """ev AS (
  SELECT event_id, user_id AS site, ts, epoch_us(ts) AS time_us, event_type, value,
         event_type IN ('error', 'click', 'view') AS above,
         least(greatest((value - 5) / 145.0::DOUBLE, 0), 1) AS severity,
         value / 500.0::DOUBLE AS probability,
         CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS truth,
         user_id % 4 AS attack_type,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k
  FROM events)"""


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites with coordinates and an estimated population, which may be missing."""
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("site"), F.col("c_name").alias("site_name"), F.col("c_nationkey").alias("zone"),
        (F.pmod(F.col("c_custkey") * 37, F.lit(1000)) / 1000.0).alias("lat"),
        (F.lit(109.0) + F.pmod(F.col("c_custkey") * 91, F.lit(1000)) / 1000.0).alias("lon"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("pop_2km"))


SITES = """si AS (
  SELECT c_custkey AS site, c_name AS site_name, c_nationkey AS zone,
         ((c_custkey * 37) % 1000) / 1000.0::DOUBLE AS lat,
         109.0::DOUBLE + ((c_custkey * 91) % 1000) / 1000.0::DOUBLE AS lon,
         CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS pop_2km
  FROM customer)"""


def satellites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Satellite observables of six recordings."""
    li = table(spark, sf_dir, "lineitem")
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return li.select(
        F.concat("l_linestatus", "l_returnflag").alias("run_id"),
        F.concat(F.substring(F.lit("GREC"), F.pmod("l_suppkey", F.lit(4)).cast("int") + 1, F.lit(1)),
                 F.col("l_suppkey").cast("string")).alias("satellite"),
        (day * SECOND_US).alias("time_us"),
        ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")).alias("src_idx"),
        F.col("l_extendedprice").alias("pseudorange"), F.col("l_quantity").alias("carrier"),
        (F.col("l_discount") * 600).alias("doppler"), (F.col("l_tax") * 1000).alias("snr"),
        (F.col("l_quantity") + 10).alias("snr_l2"),
        F.when(F.col("l_quantity") > 10, F.col("l_extendedprice")).alias("pseudorange_l2"))


SATELLITES = """sat AS (
  SELECT l_linestatus || l_returnflag AS run_id,
         substr('GREC', CAST(l_suppkey % 4 AS INTEGER) + 1, 1) || CAST(l_suppkey AS VARCHAR) AS satellite,
         CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) * 1000000 AS time_us,
         (l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey AS src_idx,
         l_extendedprice AS pseudorange, l_quantity AS carrier, l_discount * 600 AS doppler,
         l_tax * 1000 AS snr, l_quantity + 10 AS snr_l2,
         CASE WHEN l_quantity > 10 THEN l_extendedprice END AS pseudorange_l2
  FROM lineitem)"""

RUNS = ("FA", "FN", "FR", "OA", "ON", "OR")


def nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Navigation solutions of the same six recordings."""
    o = table(spark, sf_dir, "orders")
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return o.select(
        F.element_at(F.array(*[F.lit(x) for x in RUNS]),
                     F.pmod("o_custkey", F.lit(6)).cast("int") + 1).alias("run_id"),
        (day * SECOND_US).alias("time_us"), F.col("o_orderkey").alias("src_idx"),
        F.col("o_totalprice").alias("iTOW"),
        (F.pmod(F.col("o_custkey") * 37, F.lit(1000)) / 1000.0).alias("lat"),
        (F.lit(109.0) + F.pmod(F.col("o_custkey") * 91, F.lit(1000)) / 1000.0).alias("lon"),
        (F.col("o_totalprice") / 1000.0).alias("height"))


NAV = """nav AS (
  SELECT (['FA', 'FN', 'FR', 'OA', 'ON', 'OR'])[o_custkey % 6 + 1] AS run_id,
         CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) * 1000000 AS time_us,
         o_orderkey AS src_idx, o_totalprice AS iTOW,
         ((o_custkey * 37) % 1000) / 1000.0::DOUBLE AS lat,
         109.0::DOUBLE + ((o_custkey * 91) % 1000) / 1000.0::DOUBLE AS lon,
         o_totalprice / 1000.0::DOUBLE AS height
  FROM orders)"""


def km(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """Great-circle distance as SQL text."""
    return (f"(2 * 6371.0088::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians({lat2} - {lat1}) / 2), 2) + "
            f"cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)))))")


BATCH_US = 21_600_000_000


def batches(spark: SparkSession, sf_dir: str, width_us: int = BATCH_US) -> DataFrame:
    """Submitted observations in six-hour batches, in a scrambled order that makes rows late."""
    e = events(spark, sf_dir)
    scrambled = F.pmod(F.col("event_id") * 7919, F.lit(10007))
    return e.withColumns({
        "batch_seq": F.floor((F.col("time_us") + scrambled * 4_000_000) / F.lit(width_us)).cast("long"),
        "position": scrambled * 10_000_000 + F.col("event_id"),
        # Readings rounded down to half a day repeat, so some of them are duplicates.
        "time_us": F.when(F.pmod("event_id", F.lit(5)) == 0,
                          F.floor(F.col("time_us") / 43_200_000_000).cast("long") * 43_200_000_000)
        .otherwise(F.col("time_us"))})


BATCHES = EVENTS + """, bat AS (
  SELECT event_id, site, ts, event_type, value, above, severity, probability, truth, attack_type, k,
         CAST(floor((time_us + ((event_id * 7919) % 10007) * 4000000) / 21600000000.0::DOUBLE) AS BIGINT) AS batch_seq,
         ((event_id * 7919) % 10007) * 10000000 + event_id AS position,
         CASE WHEN event_id % 5 = 0 THEN CAST(floor(time_us / 43200000000.0::DOUBLE) AS BIGINT) * 43200000000
              ELSE time_us END AS time_us
  FROM ev)"""
