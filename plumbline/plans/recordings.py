"""Queries over receiver recordings: sequence features, alignment and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alignment, features
from . import bindings as B
from .registry import query

# One day stands for one second, so gaps between rows are wider than those of a receiver.
LIMITS = features.Limits(max_gap_s=10.0, code_residual=50000.0, carrier_sanity=34.0, arc_gap_s=120.0,
                         slip_cycles=6000.0)
WAVE = "(299792458.0::DOUBLE / 1575420000.0::DOUBLE)"
SV = "PARTITION BY run_id, satellite ORDER BY time_us, src_idx"


@query("w01_clock_drift", f"""WITH {B.NAV}
SELECT run_id, src_idx, round((iTOW - lag(iTOW) OVER w) / 1000.0::DOUBLE - (time_us - lag(time_us) OVER w) / 1000000.0::DOUBLE, 6) AS drift
FROM nav WINDOW w AS (PARTITION BY run_id ORDER BY time_us, src_idx)""")
def clock_drift(spark, sf_dir):
    out = features.clock_drift(B.nav(spark, sf_dir))
    return out.select("run_id", "src_idx", B.r("clock_drift_proxy_s").alias("drift"))


FIX = """fix AS (
  SELECT run_id, median(lat) AS ref_lat, median(lon) AS ref_lon, median(height) AS ref_height
  FROM nav JOIN (SELECT run_id, min(time_us) AS t0 FROM nav GROUP BY run_id) USING (run_id)
  WHERE time_us < t0 + 60000000 GROUP BY run_id)"""


@query("a06_reference_fix", f"""WITH {B.NAV}, {FIX}
SELECT run_id, round(ref_lat, 6) AS ref_lat, round(ref_lon, 6) AS ref_lon, round(ref_height, 6) AS ref_height FROM fix""")
def reference_fix(spark, sf_dir):
    return B.rounded(features.reference_fix(B.nav(spark, sf_dir)))


@query("p06_position_deviation", f"""WITH {B.NAV}, {FIX}
SELECT run_id, src_idx, round(sqrt(pow((lat - ref_lat) * 111320.0::DOUBLE, 2)
  + pow((lon - ref_lon) * 111320.0::DOUBLE * cos(radians(ref_lat)), 2) + pow(height - ref_height, 2)), 5) AS pos_dev_m
FROM nav LEFT JOIN fix USING (run_id)""")
def position_deviation(spark, sf_dir):
    out = features.position_deviation(B.nav(spark, sf_dir))
    return out.select("run_id", "src_idx", B.r("pos_dev_m", 5).alias("pos_dev_m"))


CODE = f"""steps AS (
  SELECT *, (time_us - lag(time_us) OVER w) / 1000000.0::DOUBLE AS dt,
         pseudorange - lag(pseudorange) OVER w AS dpr FROM sat WINDOW w AS ({SV})), raw AS (
  SELECT *, CASE WHEN dt <> 0 THEN dpr / dt END + doppler * {WAVE} AS raw FROM steps), code AS (
  SELECT * EXCLUDE (snr), CASE WHEN dt > 0 AND dt <= 10 AND abs(raw) <= 50000 THEN raw END AS resid,
         CASE WHEN snr BETWEEN 0 AND 60 THEN snr END AS snr FROM raw)"""


@query("w02_code_residual", f"""WITH {B.SATELLITES}, {CODE}
SELECT run_id, satellite, src_idx, round(resid, 6) AS pr_doppler_residual, snr FROM code""")
def code_residual(spark, sf_dir):
    out = features.code_residuals(B.satellites(spark, sf_dir), LIMITS)
    return out.select("run_id", "satellite", "src_idx", B.r("pr_doppler_residual").alias("pr_doppler_residual"), "snr")


@query("a01_code_epochs", f"""WITH {B.SATELLITES}, {CODE}
SELECT run_id, time_us, count(satellite) AS n_sats_l1, round(avg(snr), 6) AS snr_l1_mean,
       round(stddev_samp(snr), 6) AS snr_l1_std, round(min(snr), 6) AS snr_l1_min, round(avg(doppler), 6) AS doppler_l1_mean,
       round(stddev_samp(doppler), 6) AS doppler_l1_std, round(avg(resid), 6) AS pr_doppler_residual_mean,
       round(stddev_samp(resid), 6) AS pr_doppler_residual_std
FROM code GROUP BY run_id, time_us""")
def code_epochs(spark, sf_dir):
    return B.rounded(features.code_epochs(features.code_residuals(B.satellites(spark, sf_dir), LIMITS)))


def rf(spark, sf_dir):
    return B.satellites(spark, sf_dir).select(
        "run_id", "time_us", F.col("doppler").alias("jamInd_01"), F.col("carrier").alias("agcCnt_01"),
        F.col("snr").alias("noisePerMS_01"))


RF = """rf AS (SELECT run_id, time_us, avg(doppler) AS jam_ind_mean, avg(carrier) AS agc_cnt_mean, avg(snr) AS noise_per_ms_mean
  FROM sat GROUP BY run_id, time_us)"""


@query("a02_rf_epochs", f"""WITH {B.SATELLITES}, {RF}
SELECT run_id, time_us, round(jam_ind_mean, 6) AS jam_ind_mean, round(agc_cnt_mean, 6) AS agc_cnt_mean,
       round(noise_per_ms_mean, 6) AS noise_per_ms_mean FROM rf""")
def rf_epochs(spark, sf_dir):
    return B.rounded(features.rf_epochs(rf(spark, sf_dir)))


CARRIER = f"""cs AS (
  SELECT *, pseudorange - {WAVE} * carrier AS cmc FROM sat), cd AS (
  SELECT *, (time_us - lag(time_us) OVER w) / 1000000.0::DOUBLE AS dt, carrier - lag(carrier) OVER w AS dphase,
         abs(cmc - lag(cmc) OVER w) AS dcmc FROM cs WINDOW w AS ({SV})), cm AS (
  SELECT *, CASE WHEN dt > 0 AND dt <= 10 AND abs(dphase / dt + doppler) <= 10000 THEN dphase / dt + doppler END AS cp0,
         CASE WHEN dt > 0 AND dt <= 10 AND dcmc <= 100000 THEN dcmc END AS step0 FROM cd), ok AS (
  SELECT run_id, coalesce(median(abs(cp0)) <= 34, false) AS trusted FROM cm GROUP BY run_id), car AS (
  SELECT * EXCLUDE (snr, snr_l2), CASE WHEN trusted THEN cp0 END AS cp, CASE WHEN trusted THEN step0 END AS step,
         CASE WHEN snr BETWEEN 0 AND 60 THEN snr END AS snr, CASE WHEN snr_l2 BETWEEN 0 AND 60 THEN snr_l2 END AS snr_l2,
         substr(satellite, 1, 1) AS constellation
  FROM cm JOIN ok USING (run_id))"""


@query("w03_w04_carrier_steps", f"""WITH {B.SATELLITES}, {CARRIER}
SELECT run_id, satellite, src_idx, trusted, round(cp, 6) AS cp_doppler_resid, round(step, 6) AS cmc_l1_step FROM car""")
def carrier_steps(spark, sf_dir):
    out = features.carrier_steps(B.satellites(spark, sf_dir), LIMITS)
    return B.rounded(out.select("run_id", "satellite", "src_idx", "trusted", "cp_doppler_resid", "cmc_l1_step"))


@query("a07_trusted_recordings", f"""WITH {B.SATELLITES}, {CARRIER} SELECT run_id, trusted FROM ok""")
def trusted_recordings(spark, sf_dir):
    out = features.carrier_steps(B.satellites(spark, sf_dir), LIMITS)
    return out.groupBy("run_id").agg(F.bool_and("trusted").alias("trusted"))


@query("a03_a04_spoofing_epochs", f"""WITH {B.SATELLITES}, {CARRIER}, dev AS (
  SELECT *, abs(doppler - median(doppler) OVER (PARTITION BY run_id, time_us)) AS dd FROM car), con AS (
  SELECT run_id, time_us, constellation, avg(snr) AS m FROM car GROUP BY ALL), spread AS (
  SELECT run_id, time_us, count(*) AS sp_n_const, CASE WHEN count(m) >= 2 THEN max(m) - min(m) END AS sp_xconst_cn0_spread
  FROM con GROUP BY ALL)
SELECT run_id, time_us, round(stddev_samp(cp), 6) AS sp_cp_doppler_resid_std, round(max(abs(cp)), 6) AS sp_cp_doppler_resid_maxabs,
       round(stddev_samp(step), 6) AS sp_cmc_l1_step_std, round(max(step), 6) AS sp_cmc_l1_step_maxabs,
       round(avg(CASE WHEN pseudorange_l2 IS NULL THEN 0 ELSE 1 END), 6) AS sp_frac_l2_tracked,
       round(avg(snr - snr_l2), 6) AS sp_cn0_l1_minus_l2_mean,
       round(avg(CASE WHEN snr < 30 THEN 1 WHEN snr IS NOT NULL THEN 0 END), 6) AS sp_frac_low_cn0,
       round(median(dd), 6) AS sp_doppler_l1_mad, any_value(sp_n_const) AS sp_n_const,
       round(any_value(sp_xconst_cn0_spread), 6) AS sp_xconst_cn0_spread
FROM dev JOIN spread USING (run_id, time_us) GROUP BY run_id, time_us""")
def spoofing_epochs(spark, sf_dir):
    return B.rounded(features.spoofing_epochs(B.satellites(spark, sf_dir), LIMITS))


ARCS = f"""a0 AS (
  SELECT *, (time_us - lag(time_us) OVER w) / 1000000.0::DOUBLE AS dt, carrier - lag(carrier) OVER w AS dphase,
         pseudorange - {WAVE} * carrier AS cmc, doppler - 2 * lag(doppler) OVER w + lag(doppler, 2) OVER w AS bend
  FROM sat WINDOW w AS ({SV})), a1 AS (
  SELECT *, CASE WHEN dt <> 0 THEN dphase / dt END + doppler AS resid FROM a0), aok AS (
  SELECT run_id, coalesce(median(abs(CASE WHEN dt = 0 AND dphase <> 0 THEN 'infinity'::DOUBLE ELSE resid END)) <= 34, false) AS trusted FROM a1 GROUP BY run_id), a2 AS (
  SELECT *, CASE WHEN dt IS NULL OR dt > 120 OR coalesce(abs(resid) * dt > 6000, false) THEN 1 ELSE 0 END AS slip FROM a1), a3 AS (
  SELECT *, CAST(sum(slip) OVER ({SV} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS arc FROM a2), a4 AS (
  SELECT *, row_number() OVER (PARTITION BY run_id, satellite, arc ORDER BY time_us, src_idx) - 1 AS p FROM a3), a5 AS (
  SELECT *, abs(regr_slope(cmc, p) OVER w) AS slope0, stddev_samp(CASE WHEN p >= 2 THEN bend END) OVER w AS curv0
  FROM a4 WINDOW w AS (PARTITION BY run_id, satellite, arc ORDER BY p ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)), arc AS (
  SELECT *, CASE WHEN trusted AND p >= 19 THEN slope0 END AS slope, CASE WHEN p >= 21 THEN curv0 END AS curv
  FROM a5 JOIN aok USING (run_id))"""


@query("w06_w09_tracking_arcs", f"""WITH {B.SATELLITES}, {ARCS}
SELECT run_id, satellite, src_idx, arc, p, round(slope, 5) AS cmc_slope_abs, round(curv, 5) AS dop_curv FROM arc""")
def tracking_arcs(spark, sf_dir):
    out = features.arcs(B.satellites(spark, sf_dir), LIMITS)
    return B.rounded(out.select("run_id", "satellite", "src_idx", "arc", "p", "cmc_slope_abs", "dop_curv"), 5)


@query("a05_temporal_epochs", f"""WITH {B.SATELLITES}, {ARCS}
SELECT run_id, time_us, round(max(slope), 5) AS sp_cmc_slope_max,
       CASE WHEN count(slope) > 0 THEN round(count(*) FILTER (slope > 3) / count(*), 6) END AS sp_cmc_slope_frac_hi,
       round(max(curv), 5) AS sp_dop_smooth_max, round(median(slope), 5) AS sp_cmc_slope_p50, round(median(curv), 5) AS sp_dop_smooth_p50
FROM arc GROUP BY run_id, time_us""")
def temporal_epochs(spark, sf_dir):
    out = features.temporal_epochs(B.satellites(spark, sf_dir), LIMITS)
    return B.rounded(out.withColumn("sp_cmc_slope_frac_hi", B.r("sp_cmc_slope_frac_hi")), 5).drop(
        "sp_cmc_slope_frac_hi").join(out.select("run_id", "time_us", B.r("sp_cmc_slope_frac_hi").alias(
            "sp_cmc_slope_frac_hi")), ["run_id", "time_us"])


@query("w10_causal_spread", f"""WITH {B.EVENTS}
SELECT event_id, CASE WHEN count(value) OVER w >= 15 THEN round(stddev_samp(value) OVER w, 6) END AS spread
FROM ev WINDOW w AS (PARTITION BY site ORDER BY time_us ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)""")
def causal_spread(spark, sf_dir):
    out = features.causal_spread(B.events(spark, sf_dir), ["site"], ["time_us"], "value", "spread")
    return B.rounded(out.select("event_id", "spread"))


@query("w11_causal_deviation", f"""WITH {B.EVENTS}
SELECT event_id, CASE WHEN count(value) OVER w >= 30 THEN round(value - quantile_cont(value, 0.5) OVER w, 6) END AS deviation
FROM ev WINDOW w AS (PARTITION BY site ORDER BY time_us ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)""")
def causal_deviation(spark, sf_dir):
    out = features.causal_deviation(B.events(spark, sf_dir), ["site"], ["time_us"], "value", "deviation")
    return B.rounded(out.select("event_id", "deviation"))


@query("w12_session_deviation", f"""WITH {B.EVENTS}
SELECT event_id, round(value - median(value) OVER (PARTITION BY site), 6) AS deviation FROM ev""")
def session_deviation(spark, sf_dir):
    out = features.session_deviation(B.events(spark, sf_dir), ["site"], "value", "deviation")
    return B.rounded(out.select("event_id", "deviation"))


RUNS = f"""g0 AS (
  SELECT *, CASE WHEN lag(time_us) OVER w IS NULL OR (time_us - lag(time_us) OVER w) / 1000000.0::DOUBLE > 60 THEN 1 ELSE 0 END AS opens
  FROM sat WINDOW w AS ({SV})), runs AS (
  SELECT *, CAST(sum(opens) OVER ({SV} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM g0)"""


def _runs(spark, sf_dir):
    return features.gap_runs(B.satellites(spark, sf_dir), ["run_id", "satellite"], "time_us", ["src_idx"], 60)


@query("w21_gap_runs", f"""WITH {B.SATELLITES}, {RUNS} SELECT run_id, satellite, src_idx, run FROM runs""")
def gap_runs(spark, sf_dir):
    return _runs(spark, sf_dir).select("run_id", "satellite", "src_idx", "run")


@query("a40_run_lengths", f"""WITH {B.SATELLITES}, {RUNS}, l AS (
  SELECT count(*) AS len FROM runs GROUP BY run_id, satellite, run)
SELECT count(*) AS n_runs, round(avg(len), 6) AS mean_len, max(len) AS max_len,
       round(avg(CASE WHEN len >= 10 THEN 1 ELSE 0 END), 6) AS runs_ge_10, round(sum(CASE WHEN len >= 10 THEN len ELSE 0 END) / sum(len), 6) AS rows_ge_10,
       round(avg(CASE WHEN len >= 20 THEN 1 ELSE 0 END), 6) AS runs_ge_20, round(sum(CASE WHEN len >= 20 THEN len ELSE 0 END) / sum(len), 6) AS rows_ge_20,
       round(avg(CASE WHEN len >= 30 THEN 1 ELSE 0 END), 6) AS runs_ge_30, round(sum(CASE WHEN len >= 30 THEN len ELSE 0 END) / sum(len), 6) AS rows_ge_30,
       round(avg(CASE WHEN len >= 50 THEN 1 ELSE 0 END), 6) AS runs_ge_50, round(sum(CASE WHEN len >= 50 THEN len ELSE 0 END) / sum(len), 6) AS rows_ge_50,
       quantile_cont(len, 0.1) AS p10, quantile_cont(len, 0.5) AS median, quantile_cont(len, 0.9) AS p90
FROM l""")
def run_lengths(spark, sf_dir):
    return B.rounded(features.run_lengths(_runs(spark, sf_dir), ["run_id", "satellite"]))


def _arc_rows(spark, sf_dir):
    rows = features.arcs(B.satellites(spark, sf_dir), LIMITS)
    return rows.withColumn("attack", F.when(F.col("carrier") > 25, 1).otherwise(0))


@query("a41_arc_fits", f"""WITH {B.SATELLITES}, {ARCS}
SELECT run_id, satellite, arc, count(*) AS n, round(regr_slope(cmc, (time_us - t0) / 1000000.0::DOUBLE), 5) AS slope,
       CASE WHEN stddev_pop(cmc) > 0 THEN round(regr_r2(cmc, (time_us - t0) / 1000000.0::DOUBLE), 6) END AS r2,
       avg(CASE WHEN carrier > 25 THEN 1 ELSE 0 END) > 0.5 AS is_attack
FROM (SELECT *, min(time_us) OVER (PARTITION BY run_id, satellite, arc) AS t0 FROM arc)
GROUP BY run_id, satellite, arc HAVING count(*) >= 20""")
def arc_fits(spark, sf_dir):
    fits = features.arc_fits(_arc_rows(spark, sf_dir), ["run_id", "satellite", "arc"], "time_us", "cmc", "attack")
    return fits.withColumns({"slope": B.r("slope", 5), "r2": B.r("r2")})


@query("w24_tracked_set_overlap", f"""WITH {B.SATELLITES}, ep AS (
  SELECT run_id, time_us, list_sort(list(DISTINCT satellite)) AS s FROM sat GROUP BY run_id, time_us), pr AS (
  SELECT *, lag(s) OVER (PARTITION BY run_id ORDER BY time_us) AS p FROM ep)
SELECT run_id, time_us, round(len(list_intersect(s, p)) / len(list_distinct(list_concat(s, p))), 6) AS jaccard
FROM pr WHERE p IS NOT NULL""")
def tracked_set_overlap(spark, sf_dir):
    return B.rounded(features.tracked_set_overlap(B.satellites(spark, sf_dir)))


EPOCHS = """ep AS (
  SELECT run_id, time_us, CAST(sum(slip) AS BIGINT) AS starts, count(*) AS seen FROM arc GROUP BY run_id, time_us)"""


@query("w23_reacquisition_rate", f"""WITH {B.SATELLITES}, {ARCS}, {EPOCHS}
SELECT run_id, time_us, CAST(sum(starts) OVER w AS BIGINT) AS starts, CAST(sum(seen) OVER w AS BIGINT) AS seen,
       round(sum(starts) OVER w / sum(seen) OVER w, 6) AS reacquisition
FROM ep WINDOW w AS (PARTITION BY run_id ORDER BY time_us RANGE BETWEEN 9999999 PRECEDING AND CURRENT ROW)""")
def reacquisition_rate(spark, sf_dir):
    rows = features.arcs(B.satellites(spark, sf_dir), LIMITS)
    epochs = rows.groupBy("run_id", "time_us").agg(F.sum("slip").alias("slips"), F.count(F.lit(1)).alias("rows"))
    sums = features.trailing_sums(epochs, ["run_id"], "time_us", 10, {"starts": "slips", "seen": "rows"})
    return sums.withColumn("reacquisition", B.r(F.col("starts") / F.col("seen")))


@query("w25_quadratic_residual", f"""WITH {B.SATELLITES}, {ARCS}, q0 AS (
  SELECT *, doppler - avg(doppler) OVER w AS y0, avg(doppler) OVER w AS m,
    list(doppler) OVER w AS ys FROM arc WINDOW w AS (PARTITION BY run_id, satellite, arc ORDER BY p ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)), q1 AS (
  SELECT *, list_transform(ys, lambda y, i: (y - m) * (y - m)) AS yy, list_transform(ys, lambda y, i: (y - m) * (i - 10.5)) AS y1,
    list_transform(ys, lambda y, i: (y - m) * ((i - 10.5) * (i - 10.5) - 33.25)) AS y2 FROM q0 WHERE p >= 19)
SELECT run_id, satellite, src_idx, round(sqrt(greatest(list_sum(yy) - pow(list_sum(y1), 2) / 665.0::DOUBLE - pow(list_sum(y2), 2) / 17556.0::DOUBLE, 0) / 20), 5) AS residual
FROM q1""")
def quadratic_residual(spark, sf_dir):
    rows = features.arcs(B.satellites(spark, sf_dir), LIMITS)
    out = features.quadratic_residual(rows, ["run_id", "satellite"], ["time_us", "src_idx"], "doppler", "p", "residual")
    return out.filter("residual IS NOT NULL").select("run_id", "satellite", "src_idx", B.r("residual", 5).alias("residual"))


@query("a42_probe_quantiles", f"""WITH {B.SATELLITES}, {ARCS}
SELECT carrier > 25 AS attack, round(quantile_cont(slope, 0.5), 5) AS slope_p50, round(quantile_cont(slope, 0.9), 5) AS slope_p90,
       round(quantile_cont(curv, 0.5), 5) AS curv_p50, round(quantile_cont(curv, 0.9), 5) AS curv_p90
FROM arc GROUP BY carrier > 25""")
def probe_quantiles(spark, sf_dir):
    rows = features.arcs(B.satellites(spark, sf_dir), LIMITS).withColumn("attack", F.col("carrier") > 25)
    return B.rounded(features.percentile_columns(rows, ["attack"], {
        "slope_p50": ("cmc_slope_abs", 0.5), "slope_p90": ("cmc_slope_abs", 0.9),
        "curv_p50": ("dop_curv", 0.5), "curv_p90": ("dop_curv", 0.9)}), 5)


@query("a39_coverage", f"""WITH {B.SATELLITES}, {ARCS}
SELECT 'cmc_slope_abs' AS "column", count(slope) / count(*) AS share FROM arc
UNION ALL SELECT 'dop_curv', count(curv) / count(*) FROM arc
UNION ALL SELECT 'pseudorange_l2', count(pseudorange_l2) / count(*) FROM arc""")
def coverage(spark, sf_dir):
    rows = features.arcs(B.satellites(spark, sf_dir), LIMITS)
    return features.coverage(rows, ["cmc_slope_abs", "dop_curv", "pseudorange_l2"])


LOG = """lg AS (SELECT user_id AS site, ts, epoch_us(ts) AS time_us,
  CASE WHEN event_type = 'signup' THEN 'Jamming STARTED' WHEN event_type = 'purchase' THEN 'jamming ended' ELSE 'note' END AS event FROM events),
  pair AS (SELECT *, lag(event) OVER w AS pe, lag(time_us) OVER w AS pt FROM lg WHERE event <> 'note' WINDOW w AS (PARTITION BY site ORDER BY time_us)),
  win AS (SELECT site, pt AS window_start, time_us AS window_end FROM pair WHERE event LIKE '%ended' AND pe LIKE '%STARTED')"""


def _log(spark, sf_dir):
    kind = F.when(F.col("event_type") == "signup", "Jamming STARTED").when(
        F.col("event_type") == "purchase", "jamming ended").otherwise("note")
    return B.events(spark, sf_dir).select("site", "time_us", kind.alias("event"))


def _windows(spark, sf_dir):
    return alignment.paired_windows(_log(spark, sf_dir), ["site"], ["time_us"], "event", "time_us")


@query("w17_attack_windows", f"WITH {LOG} SELECT site, window_start, window_end FROM win")
def attack_windows(spark, sf_dir):
    return _windows(spark, sf_dir)


@query("j02_interval_labels", f"""WITH {LOG}
SELECT event_id, CAST(max(CASE WHEN win.site IS NOT NULL THEN 1 ELSE 0 END) AS INTEGER) AS attack
FROM events e LEFT JOIN win ON win.site = e.user_id AND epoch_us(e.ts) BETWEEN window_start AND window_end GROUP BY event_id""")
def interval_labels(spark, sf_dir):
    out = alignment.covered(B.events(spark, sf_dir), _windows(spark, sf_dir), ["site"], "time_us",
                            "window_start", "window_end")
    return out.select("event_id", "attack")


@query("j03_window_facts", f"""WITH {LOG}, span AS (SELECT site, min(time_us) AS a, max(time_us) AS b FROM lg GROUP BY site)
SELECT site, count(window_start) AS n_attack_windows, coalesce(bool_or(window_start BETWEEN a AND b), false) AS window_start_in_range
FROM span LEFT JOIN win USING (site) GROUP BY site""")
def window_facts(spark, sf_dir):
    return alignment.window_facts(B.events(spark, sf_dir), _windows(spark, sf_dir), ["site"], "time_us")


@query("j01_nearest_asof", f"""WITH {B.EVENTS}, l AS (SELECT * FROM ev WHERE event_type = 'purchase'),
  r AS (SELECT site, time_us AS rt, value AS rv, event_id AS rid FROM ev WHERE event_type = 'view'),
  b AS (SELECT l.event_id, l.site, l.time_us, rt, rv, rid FROM l ASOF LEFT JOIN r ON l.site = r.site AND l.time_us >= r.rt),
  f AS (SELECT l.event_id, rt AS ft, rv AS fv, rid AS fid FROM l ASOF LEFT JOIN r ON l.site = r.site AND l.time_us <= r.rt),
  p AS (SELECT event_id, time_us, CASE WHEN ft IS NULL OR time_us - rt <= ft - time_us THEN rid ELSE fid END AS id,
        CASE WHEN ft IS NULL OR time_us - rt <= ft - time_us THEN rt ELSE ft END AS t FROM b JOIN f USING (event_id))
SELECT event_id, CASE WHEN abs(time_us - t) <= 21600000000 THEN id END AS nearest_id FROM p""")
def nearest_asof(spark, sf_dir):
    e = B.events(spark, sf_dir)
    left = e.filter("event_type = 'purchase'").select("site", "event_id", "time_us")
    right = e.filter("event_type = 'view'").select("site", F.col("time_us").alias("seen_us"),
                                                   F.col("event_id").alias("nearest_id"))
    out = alignment.nearest(left, right, ["site"], "time_us", "seen_us", 21600, ["nearest_id"], ["event_id"])
    return out.select("event_id", "nearest_id")


@query("j13_positional_join", f"""WITH {B.NAV}, a AS (SELECT run_id, time_us, src_idx, row_number() OVER (PARTITION BY run_id, time_us ORDER BY src_idx) AS n FROM nav),
  b AS (SELECT run_id, time_us, iTOW, row_number() OVER (PARTITION BY run_id, time_us ORDER BY src_idx) AS n FROM nav)
SELECT run_id, time_us, src_idx, iTOW AS extra, true AS matched FROM a JOIN b USING (run_id, time_us, n)""")
def positional_join(spark, sf_dir):
    n = B.nav(spark, sf_dir)
    extra = n.select("run_id", "time_us", F.col("src_idx").alias("row_idx"), F.col("iTOW").alias("extra"))
    out = alignment.positional(n.select("run_id", "time_us", "src_idx"), extra, ["run_id", "time_us"],
                               ["src_idx"], ["row_idx"], ["extra"])
    return out.select("run_id", "time_us", "src_idx", "extra", "matched")


BOUNDARY = f"""WITH {B.EVENTS}, ch AS (
  SELECT *, lead(truth) OVER w <> truth AS changes, min(time_us) OVER (PARTITION BY site) AS t0 FROM ev WINDOW w AS (PARTITION BY site ORDER BY time_us)), bd AS (
  SELECT *, last_value(CASE WHEN changes THEN time_us END IGNORE NULLS) OVER (PARTITION BY site ORDER BY time_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past,
    first_value(CASE WHEN changes THEN time_us END IGNORE NULLS) OVER (PARTITION BY site ORDER BY time_us ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS coming FROM ch), bx AS (
  SELECT event_id, site, truth, probability, round((time_us - t0) / 1000000.0::DOUBLE, 6) AS elapsed_s,
    round(CASE WHEN past IS NULL THEN coming - time_us WHEN coming IS NULL THEN time_us - past ELSE least(time_us - past, coming - time_us) END / 1000000.0::DOUBLE, 6) AS boundary_s FROM bd)"""


def _boundary(spark, sf_dir):
    return alignment.boundary_distance(B.events(spark, sf_dir), ["site"], "time_us", "truth", [])


@query("j19_boundary_distance", BOUNDARY + " SELECT event_id, elapsed_s, boundary_s FROM bx")
def boundary_distance(spark, sf_dir):
    return B.rounded(_boundary(spark, sf_dir).select("event_id", "elapsed_s", "boundary_s"))


@query("w26_w27_label_transitions", BOUNDARY + """
SELECT site, count(*) FILTER (changes) AS transitions FROM ch GROUP BY site""")
def label_transitions(spark, sf_dir):
    out = _boundary(spark, sf_dir)
    return out.groupBy("site").agg(F.count_if(F.col("boundary_s") == 0).alias("transitions"))


@query("p31_error_by_position", BOUNDARY + """
SELECT elapsed_s < 86400 AS warm_up, coalesce(boundary_s < 3600, false) AS near_boundary, count(*) AS n,
       round(avg(CASE WHEN probability >= 0.1 THEN 1 ELSE 0 END), 6) AS error_rate
FROM bx WHERE truth = 0 GROUP BY ALL""")
def error_by_position(spark, sf_dir):
    clean = _boundary(spark, sf_dir).filter("truth = 0")
    return clean.groupBy((F.col("elapsed_s") < 86400).alias("warm_up"),
                         F.coalesce(F.col("boundary_s") < 3600, F.lit(False)).alias("near_boundary")).agg(
        F.count(F.lit(1)).alias("n"), B.r(F.avg((F.col("probability") >= 0.1).cast("int"))).alias("error_rate"))
