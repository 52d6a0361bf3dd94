"""Queries over alert state, arrivals and ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alerts, priority
from . import bindings as B
from .registry import query

# Debounced state as SQL: the latest completed streak decides.
STATE = """streaks AS (
  SELECT *, sum(CASE WHEN above THEN 1 ELSE 0 END) OVER (PARTITION BY site ORDER BY time_us ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS up3,
         sum(CASE WHEN above THEN 0 ELSE 1 END) OVER (PARTITION BY site ORDER BY time_us ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS down5
  FROM ev), marks AS (
  SELECT *, CASE WHEN up3 = 3 THEN 'alerting' WHEN down5 = 5 THEN 'normal' END AS mark FROM streaks), st AS (
  SELECT * EXCLUDE (up3, down5, mark),
         coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY site ORDER BY time_us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'normal') AS alert_state
  FROM marks)"""


def stated(spark, sf_dir):
    return alerts.hysteresis(B.events(spark, sf_dir), ["site"], ["time_us"], "above")


@query("alert_report", f"""WITH {B.EVENTS}, {STATE}, {B.SITES}, latest AS (
  SELECT site, arg_max(event_id, time_us) AS event_id, arg_max(severity, time_us) AS severity,
         arg_max(alert_state, time_us) AS alert_state FROM st GROUP BY site)
SELECT site, event_id, round(severity, 6) AS severity, pop_2km,
       row_number() OVER (ORDER BY pop_2km IS NULL, pop_2km DESC, severity DESC, site) AS rank
FROM latest LEFT JOIN si USING (site) WHERE alert_state = 'alerting'""")
def alert_report(spark, sf_dir):
    """Sites that are alerting now, the most populated first."""
    latest = stated(spark, sf_dir).groupBy("site").agg(
        F.max_by(F.struct("event_id", "severity", "alert_state"), "time_us").alias("_e")).select("site", "_e.*")
    joined = latest.filter("alert_state = 'alerting'").join(B.sites(spark, sf_dir), "site", "left")
    ranked = priority.rank(joined, "pop_2km", "severity", "site")
    return ranked.select("site", "event_id", B.r("severity").alias("severity"), "pop_2km", "rank")


@query("w13_alert_state", f"""WITH {B.EVENTS}, {STATE}
SELECT event_id, site, above, alert_state FROM st""")
def alert_state(spark, sf_dir):
    return stated(spark, sf_dir).select("event_id", "site", "above", "alert_state")


@query("w31_current_state", f"""WITH {B.EVENTS}, {STATE}
SELECT site, arg_max(alert_state, time_us) AS alert_state FROM st GROUP BY site""")
def current_state(spark, sf_dir):
    return alerts.current_state(stated(spark, sf_dir), ["site"], ["time_us"])


SEEN = """seen AS (
  SELECT *, first_value(event_id) OVER (PARTITION BY site, time_us ORDER BY batch_seq, position) AS original_id
  FROM bat), fresh AS (
  SELECT *, time_us < max(time_us) OVER (PARTITION BY site ORDER BY batch_seq RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS late
  FROM seen WHERE event_id = original_id), moving AS (
  SELECT *, sum(CASE WHEN above THEN 1 ELSE 0 END) OVER three AS up3, sum(CASE WHEN above THEN 0 ELSE 1 END) OVER five AS down5
  FROM fresh WHERE NOT coalesce(late, false)
  WINDOW three AS (PARTITION BY site ORDER BY batch_seq, time_us ROWS BETWEEN 2 PRECEDING AND CURRENT ROW),
         five AS (PARTITION BY site ORDER BY batch_seq, time_us ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)), marked AS (
  SELECT f.*, CASE WHEN m.up3 = 3 THEN 'alerting' WHEN m.down5 = 5 THEN 'normal' END AS mark
  FROM fresh f LEFT JOIN moving m USING (event_id)), accepted AS (
  SELECT event_id, site, batch_seq, original_id, false AS duplicate, coalesce(late, false) AS out_of_order,
         coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY site ORDER BY batch_seq, time_us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'normal') AS alert_state
  FROM marked
  UNION ALL
  SELECT event_id, site, batch_seq, original_id, true, false, NULL FROM seen WHERE event_id <> original_id)"""


@query("w14_w15_accepted_batches", f"""WITH {B.BATCHES}, {SEEN}
SELECT event_id, site, original_id, duplicate, out_of_order, alert_state FROM accepted""")
def accepted_batches(spark, sf_dir):
    out = alerts.accept(B.batches(spark, sf_dir))
    return out.select("event_id", "site", "original_id", "duplicate", "out_of_order", "alert_state")


REORDERED = """reo AS (
  SELECT event_id, coalesce(time_us < max(time_us) OVER (PARTITION BY batch_seq, site ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS reordered
  FROM bat)"""


@query("w16_reordered_rows", f"""WITH {B.BATCHES}, {REORDERED}
SELECT batch_seq, CAST(sum(CASE WHEN reordered THEN 1 ELSE 0 END) AS BIGINT) AS reordered, count(*) AS received
FROM bat JOIN reo USING (event_id) GROUP BY batch_seq""")
def reordered_rows(spark, sf_dir):
    marked = alerts.reordered_in_batch(B.batches(spark, sf_dir), "batch_seq", "site", "position", "time_us")
    return marked.groupBy("batch_seq").agg(F.count_if("reordered").alias("reordered"),
                                           F.count(F.lit(1)).alias("received"))


@query("a35_batch_counters", f"""WITH {B.BATCHES}, {SEEN}, {REORDERED}
SELECT batch_seq, count(*) AS received, count(*) FILTER (NOT duplicate) AS scored, count(*) FILTER (duplicate) AS duplicates,
       count(*) FILTER (out_of_order) AS out_of_order, count(*) FILTER (reordered) AS reordered_in_batch,
       count(*) FILTER (alert_state = 'alerting') AS alerts
FROM accepted JOIN reo USING (event_id) GROUP BY batch_seq""")
def batch_counters(spark, sf_dir):
    marked = alerts.reordered_in_batch(B.batches(spark, sf_dir), "batch_seq", "site", "position", "time_us")
    return alerts.batch_counters(alerts.accept(marked), "batch_seq")
