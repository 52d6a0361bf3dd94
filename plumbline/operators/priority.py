"""Which sites need attention first."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import gate_basis, is_flagged, whole_people
from .ordered import Ordered, sized


def rank(df: DataFrame, population: str, severity: str, key: str, name: str = "rank", split_rows=None) -> DataFrame:
    """Number rows 1..n by population (missing last), then severity, both falling, then key."""
    weighed = df.withColumns({
        "_none": F.col(population).isNull(), "_pop": F.coalesce(-F.col(population), F.lit(0.0)),
        "_sev": -F.coalesce(F.col(severity), F.lit(0.0))})
    return Ordered(weighed, [], ["_none", "_pop", "_sev", key], split_rows).number(name).df.drop("_none", "_pop", "_sev")


def latest(events: DataFrame, key: str = "site", event_id: str = "event_id") -> DataFrame:
    """Last event of every site, whole row."""
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*rest), event_id).alias("_e")).select(key, "_e.*")


def alerting_now(latest_rows: DataFrame) -> DataFrame:
    """Adds `alerting_now`: own state, and for replayed data also that of the newest replay event."""
    replay = latest_rows.filter("source = 'replay'").agg(
        F.max_by("alert_state", "event_id").alias("replay_state"))
    joined = latest_rows.withColumn("_one", F.lit(1)).join(
        F.broadcast(replay.withColumn("_one", F.lit(1))), "_one", "left").drop("_one")
    now = (F.col("alert_state") == "alerting") & (
        (F.coalesce(F.col("source"), F.lit("")) != "replay") | (F.col("replay_state") == "alerting"))
    return joined.withColumn("alerting_now", F.coalesce(now, F.lit(False))).drop("replay_state")


def priority_list(events: DataFrame, sites: DataFrame, split_rows=None) -> DataFrame:
    """Sites that alerted in the session, ranked by people nearby.

    A site is listed when its latest event is flagged or any of its events was. A site the table
    does not know stays in the list, without a population.
    """
    flags = events.withColumn("_flag", is_flagged(F.col("alert_state"), F.col("predicted_label")))
    ever = flags.groupBy("site").agg(F.bool_or("_flag").alias("_ever"))
    now = alerting_now(latest(events))
    gated = now.join(ever, "site").filter("_ever")
    known = sites.select("site", "site_name", "lat", "lon", whole_people(F.col("pop_2km")).alias("pop_2km"))
    out = gated.join(sized(known), "site", "left").withColumns({
        "population_status": F.when(F.col("pop_2km").isNull(), "population unavailable")
        .otherwise("estimated population available"),
        "state": F.when(F.col("alerting_now"), "alerting").otherwise("cleared"),
        "gate_basis": gate_basis(F.col("alert_state"))})
    return rank(out, "pop_2km", "severity", "site", split_rows=split_rows).drop("_ever")


def min_rank(df: DataFrame, value: str, name: str = "rank", split_rows=None) -> DataFrame:
    """Rank by falling value; equal values share the lowest rank. Counted on distinct values."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("_c")).withColumn("_down", -F.col(value))
    above = Ordered(counts, [], ["_down"], split_rows).running(exclusive=True, _above=("sum", F.col("_c"))).df
    ranks = above.select(value, (F.coalesce("_above", F.lit(0).cast("long")) + 1).alias(name))
    return df.join(ranks, value)
