"""Queries over scored events: correlation, incidents, priority, feedback, profile and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as fx
from ..operators import correlate, feedback, incidents, neighbours, priority, profile
from ..operators.ordered import Ordered, sized
from . import alerting, bindings as B
from .registry import query

SOURCES = ("replay", "ingest", "api")


def scored(spark, sf_dir):
    """Events with verdict, source, run, session and place."""
    e = alerting.stated(spark, sf_dir).join(sized(B.sites(spark, sf_dir).select("site", "site_name", "lat", "lon")),
                                            "site", "left")
    kind = F.element_at(F.array(*[F.lit(s) for s in SOURCES]), F.pmod("event_id", F.lit(3)).cast("int") + 1)
    return e.withColumns({
        "source": kind, "predicted_label": fx.verdict(F.col("probability"), 0.1),
        "alert_state": F.when(kind != "api", F.col("alert_state")),
        "run_id": F.concat(F.lit("R"), F.floor(F.col("time_us") / 86_400_000_000).cast("string")),
        "session": F.concat(F.lit("S"), F.floor(F.col("time_us") / 129_600_000_000).cast("string"))})


SCORED = f"""WITH {B.EVENTS}, {alerting.STATE}, {B.SITES}, sc AS (
  SELECT st.* EXCLUDE (alert_state), site_name, lat, lon, (['replay', 'ingest', 'api'])[event_id % 3 + 1] AS source,
    CASE WHEN probability >= 0.1 THEN 'attack' ELSE 'clean' END AS predicted_label,
    CASE WHEN event_id % 3 <> 2 THEN alert_state END AS alert_state,
    'R' || CAST(time_us // 86400000000 AS VARCHAR) AS run_id, 'S' || CAST(time_us // 129600000000 AS VARCHAR) AS session
  FROM st LEFT JOIN si USING (site)), fl AS (
  SELECT *, CASE WHEN alert_state IS NOT NULL THEN alert_state = 'alerting' ELSE predicted_label = 'attack' END AS flagged FROM sc)"""


def flagged(spark, sf_dir):
    s = scored(spark, sf_dir)
    return s.filter(fx.is_flagged(F.col("alert_state"), F.col("predicted_label")))


# -- verdicts, gates, small projections -------------------------------------------------------


@query("p14_p16_verdict_gate", SCORED + """
SELECT event_id, predicted_label, round(severity, 6) AS severity, flagged,
       CASE WHEN alert_state IS NOT NULL THEN 'hysteresis' ELSE 'threshold' END AS gate_basis FROM fl""")
def verdict_gate(spark, sf_dir):
    s = scored(spark, sf_dir)
    return s.select("event_id", "predicted_label", B.r("severity").alias("severity"),
                    fx.is_flagged(F.col("alert_state"), F.col("predicted_label")).alias("flagged"),
                    fx.gate_basis(F.col("alert_state")).alias("gate_basis"))


@query("p20_validated_rows", """WITH c AS (
  SELECT event_id, value BETWEEN 0 AND 300 AS ok_value, CAST(json_extract_string(props, '$.k') AS INTEGER) <= 90 AS ok_k FROM events)
SELECT ok_value AND ok_k AS accepted, CASE WHEN NOT ok_value THEN 'value' WHEN NOT ok_k THEN 'k' END AS first_reason, count(*) AS n
FROM c GROUP BY ALL""")
def validated_rows(spark, sf_dir):
    from ..sources.validation import Rule, check

    rows = check(B.events(spark, sf_dir), [Rule("value", F.col("value").between(0, 300)), Rule("k", F.col("k") <= 90)])
    return rows.groupBy((F.size("reasons") == 0).alias("accepted"), F.try_element_at("reasons", F.lit(1)).alias(
        "first_reason")).agg(F.count(F.lit(1)).alias("n"))


@query("p21_region_filter", f"""WITH {B.SITES}, re(region, s, n, w, e) AS (VALUES ('north', 0.5, 1.0, 109.0, 110.0), ('corner', 0.0, 0.25, 109.25, 109.5))
SELECT region, site FROM si JOIN re ON lat BETWEEN s AND n AND lon BETWEEN w AND e""")
def region_filter(spark, sf_dir):
    from ..sources.grids import in_regions

    regions = {"north": (0.5, 1.0, 109.0, 110.0), "corner": (0.0, 0.25, 109.25, 109.5)}
    return in_regions(B.sites(spark, sf_dir), regions).select("region", "site")


@query("p22_a27_bad_fraction", """SELECT user_id AS cell, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS bad,
  CAST(sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) AS BIGINT) AS good,
  round((sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) - 1) / count(*), 6) AS bad_frac FROM events GROUP BY user_id""")
def bad_fraction(spark, sf_dir):
    from ..sources.grids import cell_sums

    daily = B.events(spark, sf_dir).groupBy(F.to_date("ts").alias("day"), F.col("site").alias("cell")).agg(
        F.count_if(F.col("event_type") == "error").alias("bad"), F.count_if(F.col("event_type") != "error").alias("good"))
    return cell_sums(daily, ["cell"], "good", "bad").withColumn("bad_frac", B.r("bad_frac"))


@query("p23_p24_canonical_text", """SELECT c_custkey AS site, CAST(round_even(c_acctbal, 0) AS BIGINT) AS people,
  strftime(TIMESTAMP '2024-01-01' + to_microseconds(c_custkey * 1234567), '%Y-%m-%dT%H:%M:%S.%fZ') AS at FROM customer""")
def canonical_text(spark, sf_dir):
    c = B.table(spark, sf_dir, "customer")
    at = F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("c_custkey") * 1_234_567)
    return c.select(F.col("c_custkey").alias("site"), fx.whole_people(F.col("c_acctbal")).alias("people"),
                    fx.iso_utc(at).alias("at"))


@query("p27_model_tag", """SELECT event_type, substr(sha256(event_type || chr(10) || CAST(count(*) AS VARCHAR)), 1, 12) AS tag FROM events GROUP BY event_type""")
def model_tag(spark, sf_dir):
    from ..operators.models import short_hash

    counted = B.events(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("event_type", short_hash(F.array("event_type", F.col("n").cast("string"))).alias("tag"))


# -- look-ups over events ---------------------------------------------------------------------


@query("j09_latest_per_site", SCORED + """
SELECT site, max(event_id) AS event_id, arg_max(predicted_label, event_id) AS predicted_label, round(arg_max(severity, event_id), 6) AS severity
FROM sc GROUP BY site""")
def latest_per_site(spark, sf_dir):
    out = priority.latest(scored(spark, sf_dir))
    return out.select("site", "event_id", "predicted_label", B.r("severity").alias("severity"))


@query("o02_recent_events", SCORED + " SELECT event_id, site, alert_state FROM sc ORDER BY event_id DESC LIMIT 200")
def recent_events(spark, sf_dir):
    return profile.recent(scored(spark, sf_dir), 200).select("event_id", "site", "alert_state")


@query("o03_flagged_events", SCORED + " SELECT event_id, site, source FROM fl WHERE flagged ORDER BY event_id DESC")
def flagged_events(spark, sf_dir):
    return flagged(spark, sf_dir).select("event_id", "site", "source").orderBy(F.desc("event_id"))


@query("o04_site_events_since", f"""WITH {B.EVENTS} SELECT event_id, site, value FROM ev
WHERE time_us >= (SELECT max(time_us) FROM ev) - 86400000000""")
def site_events_since(spark, sf_dir):
    e = B.events(spark, sf_dir)
    newest = e.agg(F.max("time_us").alias("_top")).withColumn("_j", F.lit(1))
    return e.withColumn("_j", F.lit(1)).join(F.broadcast(newest), "_j").filter(
        F.col("time_us") >= F.col("_top") - 86_400_000_000).select("event_id", "site", "value")


@query("o05_recent_feature_rows", """SELECT event_id, value FROM events WHERE event_type = 'click' ORDER BY event_id DESC LIMIT 1000""")
def recent_feature_rows(spark, sf_dir):
    e = B.events(spark, sf_dir).withColumn("source", F.col("event_type"))
    return profile.recent(e, 1000, source="click").select("event_id", "value")


@query("o13_event_by_id", """SELECT event_id, user_id AS site, value FROM events WHERE event_id = 77""")
def event_by_id(spark, sf_dir):
    return B.events(spark, sf_dir).filter("event_id = 77").select("event_id", "site", "value")


@query("o11_hash_sample", "SELECT event_id, value FROM events ORDER BY md5('42:' || event_id), event_id LIMIT 300")
def hash_sample(spark, sf_dir):
    """A repeatable sample without replacement of 300 rows."""
    from ..operators.models import hash_sample as sample

    return sample(B.events(spark, sf_dir), ["event_id"], 300, seed=42).select("event_id", "value")


@query("so02_flagged_sites", SCORED + " SELECT DISTINCT site FROM fl WHERE flagged")
def flagged_sites(spark, sf_dir):
    return flagged(spark, sf_dir).select("site").distinct()


@query("so03_flagged_now_or_before", SCORED + """, l AS (SELECT site, arg_max(flagged, event_id) AS now FROM fl GROUP BY site)
SELECT site FROM l WHERE now UNION SELECT site FROM fl WHERE flagged""")
def flagged_now_or_before(spark, sf_dir):
    s = scored(spark, sf_dir)
    flag = fx.is_flagged(F.col("alert_state"), F.col("predicted_label"))
    now = priority.latest(s).filter(flag).select("site")
    return now.union(s.filter(flag).select("site")).distinct()


@query("so04_j14_known_sites", f"""WITH {B.SITES} SELECT event_id FROM events WHERE user_id IN (SELECT site FROM si WHERE pop_2km IS NOT NULL)""")
def known_sites(spark, sf_dir):
    known = B.sites(spark, sf_dir).filter("pop_2km IS NOT NULL").select("site")
    return B.events(spark, sf_dir).join(sized(known), "site", "left_semi").select("event_id")


@query("so05_training_complement", f"""WITH {B.EVENTS} SELECT event_id FROM ev WHERE site NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def training_complement(spark, sf_dir):
    held = B.table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("site"))
    return B.events(spark, sf_dir).join(held, "site", "left_anti").select("event_id")


@query("j05_site_lookup", f"""WITH {B.SITES}, byname AS (SELECT zone, min(site) AS first_site FROM si GROUP BY zone), asked AS (
  SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'Z' || CAST(user_id % 30 AS VARCHAR) ELSE 'K' || CAST(user_id AS VARCHAR) END AS code, event_id // 100 AS batch_id FROM events), hit AS (
  SELECT event_id, batch_id, code, coalesce(k.site, z.first_site) AS site FROM asked
  LEFT JOIN si k ON code = 'K' || CAST(k.site AS VARCHAR) LEFT JOIN byname z ON code = 'Z' || CAST(z.zone AS VARCHAR))
SELECT event_id, site, batch_id NOT IN (SELECT batch_id FROM hit WHERE site IS NULL) AS batch_accepted FROM hit""")
def site_lookup(spark, sf_dir):
    from ..sources.validation import resolve_sites

    e = B.events(spark, sf_dir)
    code = F.when(F.pmod("event_id", F.lit(4)) == 0, F.concat(F.lit("Z"), F.pmod("site", F.lit(30)).cast("string"))).otherwise(
        F.concat(F.lit("K"), F.col("site").cast("string")))
    asked = e.select("event_id", code.alias("code"), F.floor(F.col("event_id") / 100).cast("long").alias("batch_id"))
    known = B.sites(spark, sf_dir).select(
        F.concat(F.lit("K"), F.col("site").cast("string")).alias("site_key"),
        F.concat(F.lit("Z"), F.col("zone").cast("string")).alias("site_code"), F.col("site").alias("src_idx"), "site")
    return resolve_sites(asked, known, "code", "batch_id").select("event_id", "site", "batch_accepted")


@query("j06_exposure_by_place", f"""WITH {B.SITES}, ex AS (
  SELECT ((s_suppkey * 37) % 50) / 1000.0::DOUBLE AS lat, 109.0::DOUBLE + ((s_suppkey * 91) % 50) / 1000.0::DOUBLE AS lon, s_acctbal AS pop FROM supplier), one AS (
  SELECT round(lat, 6) AS a, round(lon, 6) AS o, any_value(pop) AS pop FROM ex GROUP BY 1, 2 HAVING count(*) = 1)
SELECT site, one.pop AS pop_2km FROM si LEFT JOIN one ON round(lat, 6) = a AND round(lon, 6) = o""")
def exposure_by_place(spark, sf_dir):
    from ..sources.towers import attach_exposure

    s = B.table(spark, sf_dir, "supplier").select(
        (F.pmod(F.col("s_suppkey") * 37, F.lit(50)) / 1000.0).alias("lat"),
        (F.lit(109.0) + F.pmod(F.col("s_suppkey") * 91, F.lit(50)) / 1000.0).alias("lon"),
        F.col("s_acctbal").alias("pop_within_2km"), F.col("s_acctbal").alias("pop_within_1km"))
    out = attach_exposure(B.sites(spark, sf_dir).drop("pop_2km"), s)
    return out.select("site", "pop_2km")


@query("j22_population_map", f"""WITH {B.SITES} SELECT site, pop_2km FROM si WHERE pop_2km IS NOT NULL""")
def population_map(spark, sf_dir):
    from ..sources.towers import population_map as by_site

    return by_site(B.sites(spark, sf_dir))


# -- correlation ------------------------------------------------------------------------------


@query("j04_correlation", f"""WITH {B.EVENTS}, {B.SITES}, kn AS (SELECT * FROM si WHERE pop_2km IS NOT NULL), lo AS (SELECT ev.*, lat, lon FROM ev JOIN kn USING (site)), pr AS (
  SELECT a.event_id, exp(-{B.km('a.lat', 'a.lon', 'b.lat', 'b.lon')} / 20.0::DOUBLE) AS w, b.severity
  FROM lo a JOIN lo b ON b.time_us >= a.time_us - 1800000000 AND (b.time_us < a.time_us OR (b.time_us = a.time_us AND b.event_id < a.event_id)) AND b.site <> a.site)
SELECT lo.event_id, count(w) AS n_correlated, round(CASE WHEN sum(w) > 1e-9 THEN sum(w * pr.severity) / sum(w) ELSE 0 END, 6) AS correlation_score
FROM lo LEFT JOIN pr USING (event_id) GROUP BY lo.event_id""")
def correlation(spark, sf_dir):
    known = B.sites(spark, sf_dir).filter("pop_2km IS NOT NULL")
    out = correlate.correlate(B.events(spark, sf_dir), known, window_s=1800, decay_km=20.0)
    return out.select("event_id", "n_correlated", B.r("correlation_score").alias("correlation_score"))


# -- incidents --------------------------------------------------------------------------------

CHAIN = SCORED + f""", g0 AS (
  SELECT *, lag(time_us) OVER w AS pu, lag(site) OVER w AS ps, lag(lat) OVER w AS pa, lag(lon) OVER w AS po,
    lag(run_id) OVER w AS pr, lag(session) OVER w AS pn FROM fl WHERE flagged WINDOW w AS (ORDER BY time_us, event_id)), g1 AS (
  SELECT *, CASE WHEN pu IS NULL OR time_us - pu > 900000000 OR NOT (ps = site OR coalesce({B.km('pa', 'po', 'lat', 'lon')} <= 60, false))
    OR pr <> run_id OR pn <> session THEN 1 ELSE 0 END AS brk FROM g0), ch AS (
  SELECT *, CAST(sum(brk) OVER (ORDER BY time_us, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS incident FROM g1)"""


def chained(spark, sf_dir):
    return incidents.chain(flagged(spark, sf_dir), window_s=900, reach_km=60.0)


@query("w18_incident_chain", CHAIN + " SELECT event_id, incident FROM ch")
def incident_chain(spark, sf_dir):
    return chained(spark, sf_dir).select("event_id", "incident")


# Runs and sessions that are partly missing and contradict each other: what an incident has seen so far decides.
PARTLY = SCORED.replace("WITH", "WITH RECURSIVE", 1) + f""", go AS (
  SELECT event_id, time_us, CASE WHEN event_id % 3 > 0 THEN 'R' || CAST(event_id % 5 // 3 AS VARCHAR) END AS run_id,
    CASE WHEN event_id % 4 <> 1 THEN 'S' || CAST(event_id % 7 // 5 AS VARCHAR) END AS session, site, lat, lon,
    lag(time_us) OVER w AS pu, lag(site) OVER w AS ps, lag(lat) OVER w AS pa, lag(lon) OVER w AS po FROM fl WHERE flagged WINDOW w AS (ORDER BY time_us, event_id)), gc AS (
  SELECT *, sum(CASE WHEN pu IS NULL OR time_us - pu > 1800000000 OR NOT (ps = site OR coalesce({B.km('pa', 'po', 'lat', 'lon')} <= 120, false)) THEN 1 ELSE 0 END)
    OVER (ORDER BY time_us, event_id ROWS UNBOUNDED PRECEDING) AS coarse FROM go), gp AS (
  SELECT event_id, run_id, session, coarse, row_number() OVER (PARTITION BY coarse ORDER BY time_us, event_id) AS pos FROM gc), fo AS (
  SELECT coarse, pos, event_id, run_id, session, 0 AS part FROM gp WHERE pos = 1 UNION ALL
  SELECT coarse, pos, event_id, CASE WHEN against THEN run_id ELSE coalesce(run_id, seen_run) END,
    CASE WHEN against THEN session ELSE coalesce(session, seen_session) END, part + against::INTEGER
  FROM (SELECT gp.*, fo.part, fo.run_id AS seen_run, fo.session AS seen_session,
          coalesce(fo.run_id <> gp.run_id, false) OR coalesce(fo.session <> gp.session, false) AS against
        FROM fo JOIN gp ON gp.coarse = fo.coarse AND gp.pos = fo.pos + 1))"""


@query("w18_partly_missing", PARTLY + """
SELECT event_id, CAST(dense_rank() OVER (ORDER BY coarse, part) AS BIGINT) AS incident FROM fo""")
def partly_missing(spark, sf_dir):
    e = F.col("event_id")
    rows = flagged(spark, sf_dir).withColumns({
        "run_id": F.when(e % 3 > 0, F.concat(F.lit("R"), F.floor(e % 5 / 3).cast("string"))),
        "session": F.when(e % 4 != 1, F.concat(F.lit("S"), F.floor(e % 7 / 5).cast("string")))})
    return incidents.chain(rows, window_s=1800, reach_km=120.0).select("event_id", "incident")


def labels(spark, sf_dir):
    return B.table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("event_id"), F.when(F.col("quality") == 1, "confirmed").otherwise("dismissed").alias("label"))


SUMMARY = CHAIN + """, lab AS (SELECT doc_id AS event_id, CASE WHEN quality = 1 THEN 'confirmed' ELSE 'dismissed' END AS label FROM labels), iv AS (
  SELECT 'INC-' || CAST(arg_min(event_id, (time_us, event_id)) AS VARCHAR) AS incident_id, arg_min(event_id, (-severity, time_us, event_id)) AS top_event_id,
    arg_min(attack_type, (-severity, time_us, event_id)) AS attack_type,
    round(max(severity), 4) AS severity, min(time_us) AS start_us, max(time_us) AS end_us, (max(time_us) - min(time_us)) / 1000000.0::DOUBLE AS duration_seconds,
    CASE WHEN bool_or(coalesce(label = 'confirmed', false)) THEN 'Confirmed' WHEN bool_or(coalesce(label = 'dismissed', false)) THEN 'Dismissed' ELSE 'New' END AS status,
    count(*) AS event_count, count(label) AS labeled_event_count, count(DISTINCT site) AS n_sites, bool_or(source = 'replay') AS tower_attribution_simulated,
    max(si.pop_2km) AS max_pop_2km
  FROM ch LEFT JOIN lab USING (event_id) LEFT JOIN si USING (site) GROUP BY incident)"""


@query("a26_o06_incidents", SUMMARY + " SELECT * FROM iv ORDER BY severity DESC, end_us DESC")
def incident_list(spark, sf_dir):
    out = incidents.summarise(chained(spark, sf_dir), labels(spark, sf_dir), B.sites(spark, sf_dir))
    return incidents.listed(out)


@query("a26_incident_members", CHAIN + """
SELECT 'INC-' || CAST(first_value(event_id) OVER w AS VARCHAR) AS incident_id, event_id, row_number() OVER w AS ordinal
FROM ch WINDOW w AS (PARTITION BY incident ORDER BY time_us, event_id)""")
def incident_members(spark, sf_dir):
    return incidents.members(chained(spark, sf_dir))


@query("a26_incident_sites", CHAIN + """
SELECT incident, site, min(time_us) AS first_us, row_number() OVER (PARTITION BY incident ORDER BY min(time_us), min(event_id)) AS ordinal
FROM ch GROUP BY incident, site""")
def incident_sites(spark, sf_dir):
    return incidents.incident_sites(chained(spark, sf_dir))


# -- priority ---------------------------------------------------------------------------------


@query("w20_priority_list", SCORED + """, l AS (
  SELECT site, max(event_id) AS event_id, arg_max(source, event_id) AS source, arg_max(severity, event_id) AS severity,
    CASE WHEN arg_max(source, event_id) <> 'api' THEN arg_max(coalesce(alert_state, ''), event_id) END AS alert_state, bool_or(flagged) AS ever FROM fl GROUP BY site), rs AS (
  SELECT arg_max(alert_state, event_id) AS replay_state FROM l WHERE source = 'replay'), n AS (
  SELECT l.*, coalesce(alert_state = 'alerting' AND (source <> 'replay' OR replay_state = 'alerting'), false) AS alerting_now,
    CAST(round_even(si.pop_2km, 0) AS BIGINT) AS pop_2km FROM l CROSS JOIN rs LEFT JOIN si USING (site) WHERE ever)
SELECT site, event_id, pop_2km, round(severity, 6) AS severity, alerting_now, CASE WHEN alert_state IS NOT NULL THEN 'hysteresis' ELSE 'threshold' END AS gate_basis,
  row_number() OVER (ORDER BY pop_2km IS NULL, pop_2km DESC, severity DESC, site) AS rank FROM n""")
def priority_list(spark, sf_dir):
    out = priority.priority_list(scored(spark, sf_dir).drop("site_name", "lat", "lon"), B.sites(spark, sf_dir))
    return out.select("site", "event_id", "pop_2km", B.r("severity").alias("severity"), "alerting_now", "gate_basis", "rank")


@query("w29_round_robin", f"""WITH t AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS i, count(*) OVER () AS n FROM customer)
SELECT event_id, c_custkey AS site FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events) e
JOIN t ON t.i = e.i % t.n""")
def round_robin(spark, sf_dir):
    towers = Ordered(B.sites(spark, sf_dir).select("site"), [], ["site"]).number("_i").df
    n = towers.count()
    rows = Ordered(B.events(spark, sf_dir).select("event_id"), [], ["event_id"]).number("_n").df
    return rows.withColumn("_i", F.pmod(F.col("_n") - 1, F.lit(n)) + 1).join(sized(towers), "_i").select("event_id", "site")


# -- feedback ---------------------------------------------------------------------------------


def label_log(spark, sf_dir):
    """Conversation turns as submissions about the event of the same number."""
    t = B.table(spark, sf_dir, "conversations")
    return t.select(
        F.col("conv_id").alias("event_id"), F.col("turn").alias("log_id"),
        F.when(F.length("text") % 2 == 0, "confirmed").otherwise("dismissed").alias("label"),
        F.when(F.col("role") != "user", F.col("role")).alias("analyst"), F.col("text").alias("note"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("created_at"))


LABEL_LOG = """ll AS (
  SELECT conv_id AS event_id, turn AS log_id, CASE WHEN length(text) % 2 = 0 THEN 'confirmed' ELSE 'dismissed' END AS label,
    CASE WHEN role <> 'user' THEN role END AS analyst, text AS note, conv_id * 1000 + turn AS created_at FROM conversations), cl AS (
  SELECT event_id, arg_max(label, log_id) AS label, min(created_at) AS first_labeled_at, arg_max(created_at, log_id) AS labeled_at,
    arg_max(coalesce(analyst, ''), log_id) AS analyst, count(*) AS revision FROM ll GROUP BY event_id)"""


@query("w30_label_history", f"""WITH {LABEL_LOG}
SELECT event_id, log_id, label, lag(label) OVER w AS previous_label, row_number() OVER w AS revision,
  min(created_at) OVER (PARTITION BY event_id) AS first_labeled_at FROM ll WINDOW w AS (PARTITION BY event_id ORDER BY log_id)""")
def label_history(spark, sf_dir):
    return feedback.history(label_log(spark, sf_dir)).select(
        "event_id", "log_id", "label", "previous_label", "revision", "first_labeled_at")


@query("j10_j11_labeled_events", SCORED + f""", {LABEL_LOG}
SELECT cl.event_id, cl.label AS feedback_label, cl.revision, cl.labeled_at, sc.site, sc.source, sc.predicted_label
FROM cl JOIN sc USING (event_id)""")
def labeled_events(spark, sf_dir):
    out = feedback.labeled_events(feedback.current(label_log(spark, sf_dir)), scored(spark, sf_dir))
    return out.select("event_id", "feedback_label", "revision", "labeled_at", "site", "source", "predicted_label")


@query("a25_j12_feedback_summary", SCORED + f""", {LABEL_LOG}, j AS (SELECT sc.*, cl.label AS fb FROM sc LEFT JOIN cl USING (event_id))
SELECT count(*) AS total_events, count(*) FILTER (fb IS NOT NULL AND predicted_label = 'attack') AS predicted_attack_labeled,
  count(*) FILTER (fb = 'confirmed' AND predicted_label = 'attack') AS predicted_attack_confirmed,
  count(*) FILTER (fb IS NOT NULL AND alert_state = 'alerting') AS hysteresis_alerting_labeled,
  count(*) FILTER (fb = 'confirmed' AND alert_state = 'alerting') AS hysteresis_alerting_confirmed,
  (SELECT count(*) FROM cl WHERE label = 'confirmed') AS confirmed, (SELECT count(*) FROM cl WHERE label = 'dismissed') AS dismissed,
  (SELECT count(*) FROM cl WHERE revision > 1) AS relabeled_events, (SELECT count(*) FROM ll) AS total_submissions,
  (SELECT count(DISTINCT analyst) FROM cl WHERE analyst <> '') AS distinct_analysts, (SELECT count(*) FROM cl) AS total_labeled,
  count(*) - (SELECT count(*) FROM cl) AS unlabeled,
  round(count(*) FILTER (fb = 'confirmed' AND predicted_label = 'attack') / nullif(count(*) FILTER (fb IS NOT NULL AND predicted_label = 'attack'), 0), 6) AS predicted_attack_precision,
  round(count(*) FILTER (fb = 'confirmed' AND alert_state = 'alerting') / nullif(count(*) FILTER (fb IS NOT NULL AND alert_state = 'alerting'), 0), 6) AS hysteresis_alert_precision
FROM j""")
def feedback_summary(spark, sf_dir):
    return B.rounded(feedback.summary(scored(spark, sf_dir), label_log(spark, sf_dir)))


@query("a25_labeled_by_source", SCORED + f""", {LABEL_LOG} SELECT source, count(*) AS n FROM cl JOIN sc USING (event_id) GROUP BY source""")
def labeled_by_source(spark, sf_dir):
    return feedback.labeled_by_source(scored(spark, sf_dir), label_log(spark, sf_dir))


@query("a36_operational_counts", SCORED + """
SELECT source, predicted_label, count(*) AS n, count(*) FILTER (alert_state = 'alerting') AS alerts FROM sc GROUP BY ALL""")
def operational_counts(spark, sf_dir):
    return scored(spark, sf_dir).groupBy("source", "predicted_label").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.col("alert_state") == "alerting", F.lit(False))).alias("alerts"))


# -- profile and drift ------------------------------------------------------------------------

SPLIT_US = 1_705_363_200_000_000
PROFILE = f"""lo AS (
  SELECT 'value' AS feature, value AS v, time_us < {SPLIT_US} AS old, event_id FROM ev UNION ALL SELECT 'k', k, time_us < {SPLIT_US}, event_id FROM ev), b0 AS (
  SELECT feature, count(v) AS n, count(*) - count(v) AS n_missing, quantile_cont(v, 0.001) AS p001, quantile_cont(v, 0.999) AS p999,
    quantile_cont(v, 0.5) AS median, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS min, max(v) AS max,
    list_sort(list_distinct(quantile_cont(v, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS edges
  FROM lo WHERE old GROUP BY feature), ba AS (
  SELECT *, p999 + 0.25 * (p999 - p001) AS bound_high,
    CASE WHEN feature = 'value' AND p001 - 0.25 * (p999 - p001) < 0 THEN 0 ELSE p001 - 0.25 * (p999 - p001) END AS bound_low,
    edges[2:len(edges) - 1] AS interior FROM b0), bins AS (
  SELECT feature, old, len(list_filter(interior, lambda x: x <= v)) AS bin, count(*) AS c, any_value(len(interior)) AS m
  FROM lo JOIN ba USING (feature) GROUP BY feature, old, bin), sh AS (
  SELECT feature, old, bin, c / sum(c) OVER (PARTITION BY feature, old) AS share FROM bins)"""


def _profile(spark, sf_dir):
    return profile.baseline(B.events(spark, sf_dir).filter(F.col("time_us") < SPLIT_US), ["value", "k"], ("value",))


@query("a10_a11_baseline_profile", f"""WITH {B.EVENTS}, {PROFILE}
SELECT feature, n, n_missing, round(p001, 6) AS p001, round(p999, 6) AS p999, round(median, 6) AS median, round(mean, 6) AS mean,
  round(std, 6) AS std, min, max, round(bound_low, 6) AS bound_low, round(bound_high, 6) AS bound_high, len(interior) AS n_inner_edges FROM ba""")
def baseline_profile(spark, sf_dir):
    out = _profile(spark, sf_dir).withColumn("n_inner_edges", F.size("psi_edges").cast("long"))
    return B.rounded(out.select("feature", "n", "n_missing", "p001", "p999", "median", "mean", "std", "min", "max",
                                "bound_low", "bound_high", "n_inner_edges"))


@query("a12_baseline_bins", f"""WITH {B.EVENTS}, {PROFILE} SELECT feature, bin, round(share, 6) AS share FROM sh WHERE old""")
def baseline_bins(spark, sf_dir):
    rows = _profile(spark, sf_dir).select("feature", F.posexplode("psi_proportions").alias("bin", "share"))
    return rows.withColumns({"bin": F.col("bin").cast("long"), "share": B.r("share")})


@query("a13_a14_drift_report", f"""WITH {B.EVENTS}, {PROFILE}, ps AS (
  SELECT feature, sum((greatest(coalesce(n.share, 0), 1e-6) - greatest(o.share, 1e-6)) * ln(greatest(coalesce(n.share, 0), 1e-6) / greatest(o.share, 1e-6))) AS psi
  FROM (SELECT * FROM sh WHERE old) o LEFT JOIN (SELECT * FROM sh WHERE NOT old) n USING (feature, bin) GROUP BY feature)
SELECT feature, (SELECT count(*) FROM ev WHERE time_us >= {SPLIT_US}) AS n_live, round(psi, 6) AS psi,
  CASE WHEN psi >= 0.25 THEN 'major' WHEN psi >= 0.1 THEN 'minor' ELSE 'none' END AS severity, CAST(NULL AS VARCHAR) AS skipped FROM ps""")
def drift_report(spark, sf_dir):
    live = B.events(spark, sf_dir).filter(F.col("time_us") >= SPLIT_US)
    return B.rounded(profile.drift(live, _profile(spark, sf_dir), ["value", "k"])).orderBy(F.desc("psi"))


@query("p19_plausibility_warnings", f"""WITH {B.EVENTS}, {PROFILE}
SELECT event_id, feature, CASE WHEN v < bound_low THEN 'below_baseline_range' ELSE 'above_baseline_range' END AS direction, v AS value
FROM lo JOIN ba USING (feature) WHERE v < bound_low OR v > bound_high""")
def plausibility_warnings(spark, sf_dir):
    checked = profile.warnings(B.events(spark, sf_dir), _profile(spark, sf_dir), ["value", "k"])
    return checked.select("event_id", F.explode("input_warnings").alias("w")).select(
        "event_id", "w.feature", "w.direction", "w.value")


@query("a36_warning_counts", f"""WITH {B.EVENTS}, {PROFILE}
SELECT feature, CASE WHEN v < bound_low THEN 'below_baseline_range' ELSE 'above_baseline_range' END AS direction, count(*) AS n
FROM lo JOIN ba USING (feature) WHERE v < bound_low OR v > bound_high GROUP BY ALL""")
def warning_counts(spark, sf_dir):
    return profile.warning_counts(profile.warnings(B.events(spark, sf_dir), _profile(spark, sf_dir), ["value", "k"]))
