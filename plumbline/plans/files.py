"""Queries that pass data through files, and the whole feature table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import feedback, profile
from ..session import fresh_path
from ..sources import grids, recordings, tables
from . import bindings as B, investigation as I, recordings as R
from .registry import query


def _windows(spark, sf_dir):
    """Two weeks of every other month of each recording."""
    n = B.nav(spark, sf_dir)
    month = F.floor(F.col("time_us") / (61 * B.SECOND_US))
    spans = n.groupBy("run_id", month.alias("m")).agg(F.min("time_us").alias("window_start"))
    return spans.select("run_id", "window_start", (F.col("window_start") + 14 * B.SECOND_US).alias("window_end"))


WINDOWS = """wi AS (SELECT run_id, min(time_us) AS ws, min(time_us) + 14000000 AS we FROM nav GROUP BY run_id, floor(time_us / 61000000.0::DOUBLE))"""


def near(right: str, at: str, columns: str, out: str, left: str) -> str:
    """Nearest-in-time join of two tables as SQL text, tie to the earlier, within 1 s."""
    picks = ", ".join(f"CASE WHEN abs(l.time_us - t) <= 1000000 THEN {c} END AS {c}" for c in columns.split())
    return f"""{out}_b AS (SELECT l.run_id, l.src_idx, l.time_us, r.{at} AS bt FROM {left} l ASOF LEFT JOIN {right} r ON l.run_id = r.run_id AND l.time_us >= r.{at}), {out}_f AS (
  SELECT l.run_id, l.src_idx, r.{at} AS ft FROM {left} l ASOF LEFT JOIN {right} r ON l.run_id = r.run_id AND l.time_us <= r.{at}), {out}_t AS (
  SELECT run_id, src_idx, CASE WHEN ft IS NULL OR time_us - bt <= ft - time_us THEN bt ELSE ft END AS t FROM {out}_b JOIN {out}_f USING (run_id, src_idx)), {out} AS (
  SELECT l.run_id, l.src_idx, {picks} FROM {left} l JOIN {out}_t USING (run_id, src_idx) LEFT JOIN {right} r ON r.run_id = l.run_id AND r.{at} = t)"""


def feature_table(spark, sf_dir):
    return recordings.feature_table(B.nav(spark, sf_dir), B.satellites(spark, sf_dir), R.rf(spark, sf_dir),
                                    _windows(spark, sf_dir), limits=R.LIMITS)


FEATURE_SQL = f"""WITH {B.NAV}, {B.SATELLITES}, {R.FIX}, {R.CODE}, {R.RF}, {WINDOWS}, ep AS (
  SELECT run_id, time_us, count(satellite) AS n_sats_l1, avg(snr) AS snr_l1_mean, stddev_samp(resid) AS pr_doppler_residual_std FROM code GROUP BY run_id, time_us),
  {near('ep', 'time_us', 'n_sats_l1 snr_l1_mean pr_doppler_residual_std', 'j1', 'nav')},
  {near('rf', 'time_us', 'agc_cnt_mean', 'j2', 'nav')}"""


@query("feature_table", FEATURE_SQL + """
SELECT nav.run_id, nav.src_idx, j1.n_sats_l1, round(j1.snr_l1_mean, 6) AS snr_l1_mean, round(j1.pr_doppler_residual_std, 6) AS pr_doppler_residual_std,
  round(j2.agc_cnt_mean, 6) AS agc_cnt_mean,
  CAST(EXISTS (SELECT 1 FROM wi WHERE wi.run_id = nav.run_id AND nav.time_us BETWEEN ws AND we) AS INTEGER) AS attack,
  (SELECT count(*) FROM wi WHERE wi.run_id = nav.run_id) AS n_attack_windows
FROM nav JOIN j1 USING (run_id, src_idx) JOIN j2 USING (run_id, src_idx)""")
def feature_rows(spark, sf_dir):
    """Recordings to labelled feature rows: both as-of joins, the windows and the labels."""
    return B.rounded(feature_table(spark, sf_dir).select(
        "run_id", "src_idx", "n_sats_l1", "snr_l1_mean", "pr_doppler_residual_std", "agc_cnt_mean", "attack", "n_attack_windows"))


@query("s05_s07_feature_table_files", FEATURE_SQL + """
SELECT nav.run_id, count(*) AS n, count(j1.n_sats_l1) AS n_with_satellites FROM nav JOIN j1 USING (run_id, src_idx) GROUP BY nav.run_id""")
def feature_table_files(spark, sf_dir):
    path = fresh_path(spark, "features")
    tables.write_features(feature_table(spark, sf_dir), path)
    return tables.read_features(spark, path).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n"), F.count("n_sats_l1").alias("n_with_satellites"))


@query("s06_j21_supplement", f"""WITH {B.NAV}, {B.SATELLITES}, {R.ARCS}, te AS (SELECT run_id, time_us, max(slope) AS slope_max FROM arc GROUP BY run_id, time_us),
  {near('te', 'time_us', 'slope_max', 'j1', 'nav')}
SELECT run_id, src_idx, round(slope_max, 5) AS sp_cmc_slope_max FROM j1""")
def supplement(spark, sf_dir):
    from ..operators.features import temporal_epochs

    out = recordings.supplement(B.nav(spark, sf_dir), temporal_epochs(B.satellites(spark, sf_dir), R.LIMITS))
    return B.rounded(out.select("run_id", "src_idx", "sp_cmc_slope_max"), 5)


@query("s03_p01_coerced_csv", """SELECT CASE WHEN event_id % 10 = 0 THEN NULL ELSE value END AS value, count(*) AS n
FROM events WHERE event_id % 7 <> 0 GROUP BY 1""")
def coerced_csv(spark, sf_dir):
    """Events as CSV with bad numbers and bad times, read back by column name."""
    e = B.events(spark, sf_dir)
    dirty = e.select(
        F.lit("x").alias("unused"), F.when(F.pmod("event_id", F.lit(10)) == 0, "n/a").otherwise(F.col("value").cast("string")).alias("value"),
        F.when(F.pmod("event_id", F.lit(7)) == 0, "not a time").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("real_time"))
    path = fresh_path(spark, "dirty")
    dirty.write.option("header", True).csv(path)
    rows = recordings.read_csv(spark, path, {"value": "value"}, [], "real_time")
    return rows.groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query("s10_f16_daily_grid", """SELECT user_id % 50 AS hex, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS bad,
  CAST(sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) AS BIGINT) AS good, count(DISTINCT CAST(ts AS DATE)) AS days FROM events GROUP BY user_id % 50""")
def daily_grid(spark, sf_dir):
    """Daily cell files, read over all days."""
    e = B.events(spark, sf_dir)
    daily = e.groupBy(F.to_date("ts").alias("day"), F.pmod("site", F.lit(50)).cast("string").alias("hex")).agg(
        F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"), F.count_if(F.col("event_type") != "error").alias("count_good_aircraft"),
        F.count_if(F.col("event_type") == "error").alias("count_bad_aircraft"))
    path = fresh_path(spark, "grid")
    daily.write.partitionBy("day").option("header", True).csv(path)
    read = grids.read_daily(spark, path)
    sums = grids.cell_sums(read, ["hex"], "count_good_aircraft", "count_bad_aircraft").drop("bad_frac")
    days = read.groupBy("hex").agg(F.count_distinct("date").alias("days"))
    return sums.join(days, "hex").withColumn("hex", F.col("hex").cast("long"))


@query("s10_missing_days", """SELECT CAST(CAST(d AS DATE) AS VARCHAR) AS date FROM range(DATE '2023-12-30', DATE '2024-02-05', INTERVAL 1 DAY) r(d)
WHERE CAST(d AS DATE) NOT IN (SELECT CAST(ts AS DATE) FROM events)""")
def missing_days(spark, sf_dir):
    daily = B.events(spark, sf_dir).select(F.to_date("ts").alias("date"))
    return grids.missing_days(daily, "2023-12-30", "2024-02-04").select(F.col("date").cast("string").alias("date"))


@query("s12_profile_files", f"""WITH {B.EVENTS}, {I.PROFILE}
SELECT feature, n, round(bound_low, 6) AS bound_low, round(bound_high, 6) AS bound_high, len(interior) AS n_inner_edges FROM ba""")
def profile_files(spark, sf_dir):
    path = fresh_path(spark, "profile")
    tables.write_profile(I._profile(spark, sf_dir), path)
    back = tables.read_profile(spark, path).withColumn("n_inner_edges", F.size("psi_edges").cast("long"))
    return B.rounded(back.select("feature", "n", "bound_low", "bound_high", "n_inner_edges"))


@query("s17_label_export", I.SCORED + f""", {I.LABEL_LOG}
SELECT cl.event_id, cl.label AS feedback_label, nullif(cl.analyst, '') AS analyst, arg_note.note AS note, value AS feature_value, k AS feature_k
FROM cl JOIN sc USING (event_id) JOIN (SELECT event_id, arg_max(note, log_id) AS note FROM ll GROUP BY event_id) arg_note USING (event_id)""")
def label_export(spark, sf_dir):
    """Labelled events as CSV, notes with commas and line breaks included, read back."""
    joined = feedback.labeled_events(feedback.current(I.label_log(spark, sf_dir)), I.scored(spark, sf_dir))
    out = feedback.export(joined, ["event_id", "feedback_label", "analyst", "note"], ["value", "k"])
    path = fresh_path(spark, "export")
    tables.write_csv(out, path)
    return tables.read_csv(spark, path, out.schema)


@query("s09_missing_exposure", """SELECT c_custkey AS site, CAST(NULL AS DOUBLE) AS pop_2km FROM customer""")
def missing_exposure(spark, sf_dir):
    """A missing exposure file leaves the population unknown."""
    from ..sources.towers import attach_exposure, read_exposure

    absent = read_exposure(spark, f"{sf_dir}/no-such-exposure.csv")
    return attach_exposure(B.sites(spark, sf_dir).drop("pop_2km"), absent).select("site", "pop_2km")


@query("p28_f22_json_records", """SELECT count(*) AS n, count(*) FILTER (c_acctbal < 0) AS n_null FROM customer""")
def json_records(spark, sf_dir):
    """Records written as JSON with explicit nulls, some of them broken, read back without the broken ones."""
    records = tables.as_json(B.sites(spark, sf_dir), ["site"])
    parsed = tables.from_json_or_skip(records, "record", "site_name string, pop_2km double")
    return parsed.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("record.pop_2km").isNull()).alias("n_null"))


@query("p26_plain_names", """SELECT c_mktsegment AS feature, upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS plain_name, count(*) AS n FROM customer GROUP BY ALL""")
def plain_names(spark, sf_dir):
    from ..functions.names import plain_name

    return B.table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("feature"), plain_name(
        F.col("c_mktsegment")).alias("plain_name")).agg(F.count(F.lit(1)).alias("n"))


@query("p13_feature_columns", """SELECT 'value' AS feature UNION ALL SELECT 'probability' UNION ALL SELECT 'severity' UNION ALL SELECT 'k'""")
def feature_columns(spark, sf_dir):
    """Columns left for a model once keys, clocks and labels are excluded."""
    from ..operators.models import feature_columns as columns

    e = B.events(spark, sf_dir)
    names = columns(e, ("event_id", "site", "ts", "time_us", "event_type", "above", "truth", "attack_type"))
    return profile.to_long(e, names).select("feature").distinct()
