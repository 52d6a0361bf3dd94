"""Queries that run as streams over the event table, cut into micro-batches."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from ..functions import columns as fx
from ..session import fresh_path
from ..streaming import keyed, pipeline, replay
from . import alerting, bindings as B
from .registry import query

WIDE_US = 864_000_000_000
STATE_KEY = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocks_state(spark):
    before = spark.conf.get(STATE_KEY, None)
    spark.conf.set(STATE_KEY, keyed.STATE_STORE)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STATE_KEY)
        else:
            spark.conf.set(STATE_KEY, before)


def replayed(spark, sf_dir, columns):
    """The events as a stream of four files in time order."""
    e = B.events(spark, sf_dir).select(*columns)
    path = fresh_path(spark, "replay")
    replay.write_chunks(e, ["time_us", "event_id"], path, 4)
    return replay.read_chunks(spark, e.schema, path)


def drained(stream, name):
    """Run a stream to its end into a table and read that."""
    spark = stream.sparkSession
    path = fresh_path(spark, name)
    with rocks_state(spark):
        run = stream.writeStream.format("parquet").option("path", path).option(
            "checkpointLocation", f"{path}-checkpoint").outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@query("t02_s15_stream_alert_state", f"""WITH {B.EVENTS}, {alerting.STATE} SELECT event_id, site, alert_state, false AS out_of_order FROM st""")
def stream_alert_state(spark, sf_dir):
    states = keyed.alert_states(replayed(spark, sf_dir, ["event_id", "site", "time_us", "above"]))
    return drained(states, "alerts").select("event_id", "site", "alert_state", "out_of_order")


@query("t03_session_scoped_state", f"""WITH {B.EVENTS}, streaks AS (
  SELECT *, sum(CASE WHEN above THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS up3,
    sum(CASE WHEN above THEN 0 ELSE 1 END) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS down5
  FROM ev WINDOW w AS (PARTITION BY site, attack_type, CAST(k AS BIGINT) % 2 ORDER BY time_us)), m AS (
  SELECT *, CASE WHEN up3 = 3 THEN 'alerting' WHEN down5 = 5 THEN 'normal' END AS mark FROM streaks)
SELECT event_id, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY site, attack_type, CAST(k AS BIGINT) % 2 ORDER BY time_us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'normal') AS alert_state FROM m""")
def session_scoped_state(spark, sf_dir):
    """State per recording and replay session."""
    stream = replayed(spark, sf_dir, ["event_id", "site", "time_us", "above", "k"]).withColumn(
        "session", F.pmod(F.col("k").cast("long"), F.lit(2)))
    return drained(keyed.alert_states(stream, ["site", "session"]), "sessions").select("event_id", "alert_state")


@query("t10_stream_trailing_deviation", f"""WITH {B.EVENTS}
SELECT event_id, CASE WHEN count(value) OVER w >= 30 THEN round(value - quantile_cont(value, 0.5) OVER w, 6) END AS deviation
FROM ev WINDOW w AS (PARTITION BY site ORDER BY time_us ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)""")
def stream_trailing_deviation(spark, sf_dir):
    out = keyed.trailing_deviation(replayed(spark, sf_dir, ["event_id", "site", "time_us", "value"]))
    return B.rounded(drained(out, "trailing"))


def verdicts(rows):
    p = F.col("value") / 500.0
    return rows.withColumns({"probability": p, "severity": fx.clip((F.col("value") - 5) / 145.0, 0.0, 1.0),
                             "predicted_label": fx.verdict(p, 0.1)})


# Store that a session has already filled from a set of tables.
_FILLED: dict[tuple[str, str], str] = {}


def filled_store(spark, sf_dir):
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FILLED or not pipeline.exists(spark, f"{_FILLED[key]}/events"):
        _FILLED[key] = fresh_path(spark, "intake")
        intake(spark, sf_dir, _FILLED[key])
    return _FILLED[key]


def intake(spark, sf_dir, store):
    """Ten-day batches of scrambled readings through the whole intake."""
    rows = B.batches(spark, sf_dir, WIDE_US).select(
        F.col("event_id").alias("source_id"), "site", "position", "time_us", "value", "batch_seq")
    inbox = f"{store}/inbox"
    replay.write_groups(rows, "batch_seq", inbox)
    steps = pipeline.Intake(store, B.sites(spark, sf_dir), verdicts, window_s=1800, decay_km=20.0)
    stream = replay.read_chunks(spark, rows.drop("batch_seq").schema, inbox)
    steps.start(stream, f"{store}/checkpoint").awaitTermination()


WIDE = (B.BATCHES + ", " + alerting.SEEN).replace("21600000000.0", f"{WIDE_US}.0").replace(
    "event_id, site, ts, event_type, value, above,", "event_id, site, ts, event_type, value, probability >= 0.1 AS above,")
INTAKE = f"""WITH {WIDE}, {B.SITES}, nu AS (
  SELECT event_id AS source_id, row_number() OVER (ORDER BY batch_seq, time_us, position) AS event_id FROM fresh)"""


@query("t01_t04_t05_stream_intake", INTAKE + """
SELECT source_id, nu.event_id, site, alert_state, out_of_order FROM accepted JOIN nu ON nu.source_id = accepted.event_id""")
def stream_intake(spark, sf_dir):
    store = filled_store(spark, sf_dir)
    return pipeline.read(spark, store, "events", pipeline.EVENTS).select(
        "source_id", "event_id", "site", "alert_state", "out_of_order")


@query("j20_s14_intake_replies", INTAKE + """
SELECT s.event_id AS source_id, nu.event_id, s.event_id <> s.original_id AS duplicate FROM seen s JOIN nu ON nu.source_id = s.original_id""")
def intake_replies(spark, sf_dir):
    store = filled_store(spark, sf_dir)
    return pipeline.read(spark, store, "replies", pipeline.REPLIES).select("source_id", "event_id", "duplicate")


@query("t06_stream_correlation", INTAKE + f""", lo AS (SELECT fresh.*, lat, lon FROM fresh JOIN si USING (site)), pr AS (
  SELECT a.event_id, exp(-{B.km('a.lat', 'a.lon', 'b.lat', 'b.lon')} / 20.0::DOUBLE) AS w, b.severity
  FROM lo a JOIN lo b ON b.time_us BETWEEN a.time_us - 1800000000 AND a.time_us AND b.batch_seq <= a.batch_seq AND b.site <> a.site
    AND (b.time_us < a.time_us OR b.batch_seq < a.batch_seq OR b.position < a.position))
SELECT lo.event_id AS source_id, count(w) AS n_correlated, round(CASE WHEN sum(w) > 1e-9 THEN sum(w * pr.severity) / sum(w) ELSE 0 END, 6) AS correlation_score
FROM lo LEFT JOIN pr USING (event_id) GROUP BY lo.event_id""")
def stream_correlation(spark, sf_dir):
    store = filled_store(spark, sf_dir)
    return B.rounded(pipeline.read(spark, store, "events", pipeline.EVENTS).select(
        "source_id", "n_correlated", "correlation_score"))


@query("t08_latest_view", INTAKE + """, f2 AS (SELECT fresh.site, fresh.event_id AS source_id, nu.event_id AS id FROM fresh JOIN nu ON nu.source_id = fresh.event_id)
SELECT site, max(id) AS event_id, arg_max(source_id, id) AS source_id FROM f2 GROUP BY site""")
def latest_view(spark, sf_dir):
    store = filled_store(spark, sf_dir)
    return pipeline.latest_per_site(spark, store).select("site", "event_id", "source_id")


@query("s16_live_feed", INTAKE + " SELECT event_id FROM nu")
def live_feed(spark, sf_dir):
    store, feed = filled_store(spark, sf_dir), fresh_path(spark, "feed")
    pipeline.publish(spark, store, feed, f"{feed}-checkpoint").awaitTermination()
    return spark.read.schema(pipeline.EVENTS).json(feed).select("event_id")


@query("p30_replay_gaps", f"""WITH {B.EVENTS}
SELECT event_id, round(coalesce(least(greatest((time_us - lag(time_us) OVER (PARTITION BY site ORDER BY time_us)) / 1000000.0::DOUBLE, 0), 5), 0), 6) AS gap_s FROM ev""")
def replay_gaps(spark, sf_dir):
    out = replay.gap_seconds(B.events(spark, sf_dir), ["site"], ["time_us"], "time_us")
    return B.rounded(out.select("event_id", "gap_s"))
