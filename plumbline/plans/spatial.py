"""Queries over places: neighbours, sums by distance and spatial autocorrelation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bijection
from ..operators import moran, neighbours
from . import bindings as B
from .registry import query

PAIRS = f"""pa AS (
  SELECT a.site, b.site AS neighbour, round({B.km('a.lat', 'a.lon', 'b.lat', 'b.lon')}, 9) AS km FROM si a JOIN si b ON a.site <> b.site), kn AS (
  SELECT *, row_number() OVER (PARTITION BY site ORDER BY km, neighbour) AS rank FROM pa QUALIFY rank <= 5)"""


def edges(spark, sf_dir):
    return neighbours.nearest_sites(B.sites(spark, sf_dir))


def balances(spark, sf_dir):
    """Account balance as the value measured at each site."""
    return B.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("site"), F.col("c_acctbal").alias("value"))


@query("j07_nearest_sites", f"""WITH {B.SITES}, {PAIRS} SELECT site, neighbour, round(km, 6) AS km, rank FROM kn""")
def nearest_sites(spark, sf_dir):
    return B.rounded(edges(spark, sf_dir)).withColumn("rank", F.col("rank").cast("long"))


@query("j07_inverse_distance_weights", f"""WITH {B.SITES}, {PAIRS}
SELECT site, neighbour, round((1 / greatest(km, 1e-6)) / sum(1 / greatest(km, 1e-6)) OVER (PARTITION BY site), 6) AS weight FROM kn""")
def inverse_distance_weights(spark, sf_dir):
    out = neighbours.inverse_distance_weights(edges(spark, sf_dir))
    return out.select("site", "neighbour", B.r("weight").alias("weight"))


@query("j08_adjacent_sites", f"""WITH {B.SITES}, {PAIRS} SELECT site, neighbour, round(km, 3) AS km FROM pa WHERE km <= 4""")
def adjacent_sites(spark, sf_dir):
    return neighbours.adjacency(B.sites(spark, sf_dir), 4.0, key="site", digits=3)


CELLS = """ce AS (SELECT DISTINCT o_custkey % 397 AS q, o_orderkey % 389 AS r FROM orders)"""


def _cells(spark, sf_dir):
    o = B.table(spark, sf_dir, "orders")
    return o.select(F.pmod("o_custkey", F.lit(397)).alias("q"), F.pmod("o_orderkey", F.lit(389)).alias("r")).distinct()


@query("j08_axial_neighbours", f"""WITH {CELLS}, d(dq, dr) AS (VALUES (1, 0), (-1, 0), (0, 1), (0, -1), (1, -1), (-1, 1))
SELECT ce.q, ce.r, ce.q + dq AS nq, ce.r + dr AS nr FROM ce, d WHERE EXISTS (SELECT 1 FROM ce o WHERE o.q = ce.q + dq AND o.r = ce.r + dr)""")
def axial_neighbours(spark, sf_dir):
    return neighbours.axial_neighbours(_cells(spark, sf_dir))


@query("j18_radius_sums", f"""WITH {B.SITES}, su AS (
  SELECT s_suppkey AS place, ((s_suppkey * 53) % 1000) / 1000.0::DOUBLE AS slat, 109.0::DOUBLE + ((s_suppkey * 71) % 1000) / 1000.0::DOUBLE AS slon FROM supplier), d AS (
  SELECT place, pop_2km, {B.km('slat', 'slon', 'si.lat', 'si.lon')} AS km FROM su JOIN si ON abs(slat - si.lat) < 0.2)
SELECT su.place, round(sum(pop_2km) FILTER (km <= 5), 4) AS sum_5km, count(*) FILTER (km <= 5) AS n_5km,
  round(sum(pop_2km) FILTER (km <= 10), 4) AS sum_10km, count(*) FILTER (km <= 10) AS n_10km FROM su LEFT JOIN d USING (place) GROUP BY su.place""")
def radius_sums(spark, sf_dir):
    s = B.table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("place"), (F.pmod(F.col("s_suppkey") * 53, F.lit(1000)) / 1000.0).alias("lat"),
        (F.lit(109.0) + F.pmod(F.col("s_suppkey") * 71, F.lit(1000)) / 1000.0).alias("lon"))
    return B.rounded(neighbours.radius_sums(s, B.sites(spark, sf_dir), "pop_2km", [5.0, 10.0], key="place"), 4)


MORAN = f"""WITH {B.SITES}, {PAIRS}, va AS (SELECT c_custkey AS site, c_acctbal AS value FROM customer), mu AS (SELECT avg(value) AS m, count(*) AS n FROM va), ze AS (
  SELECT site, value - m AS z, n FROM va, mu), la AS (SELECT kn.site, avg(ze.z) AS lag FROM kn JOIN ze ON ze.site = kn.neighbour GROUP BY kn.site), zl AS (
  SELECT ze.*, lag FROM ze JOIN la USING (site))"""


@query("a28_global_moran", MORAN + """
SELECT count(*) AS n, 0::BIGINT AS n_isolates, true AS computable, CAST(NULL AS VARCHAR) AS reason,
  round(sum(z * lag) / sum(z * z), 6) AS morans_i, round(-1.0::DOUBLE / (count(*) - 1), 6) AS expected_i FROM zl""")
def global_moran(spark, sf_dir):
    return B.rounded(moran.global_moran(balances(spark, sf_dir), edges(spark, sf_dir)))


@query("a30_local_index", MORAN + """
SELECT site, round(z * lag * (n - 1) / (SELECT sum(z * z) FROM ze), 6) AS local_i, round(lag, 6) AS lag FROM zl""")
def local_index(spark, sf_dir):
    return B.rounded(moran.local_index(balances(spark, sf_dir), edges(spark, sf_dir)).select("site", "local_i", "lag"))


def places(rounds: int, seed: int) -> str:
    """SQL of the keyed permutations: pl(r, place, y) has where each round puts each place of the sites in order."""
    def once(source):
        out = f"SELECT *, y // w2 AS hi, y % w2 AS lo FROM ({source})"
        for s in range(bijection.STEPS):
            mine, other, size = ("hi", "lo", "w1") if s % 2 == 0 else ("lo", "hi", "w2")
            one, two = f"h[{2 * s + 1}]", f"h[{2 * s + 2}]"
            drawn = f"(({other} * (1 + {one} % 1073741824) + ({one} >> 30)) % {bijection.FIRST} * (1 + {two} % 1073741824) + ({two} >> 30)) % {bijection.SECOND} % {size}"
            out = f"SELECT * REPLACE (({mine} + {drawn}) % {size} AS {mine}) FROM ({out})"
        return f"SELECT r, h, n, w1, w2, place, hi * w2 + lo AS y FROM ({out})"

    return f"""ra AS (SELECT c_custkey AS site, c_acctbal AS value, row_number() OVER (ORDER BY c_custkey) - 1 AS place FROM customer), dm AS (
  SELECT n, w1, (n + w1 - 1) // w1 AS w2 FROM (SELECT count(*) AS n, greatest(floor(sqrt(count(*)))::BIGINT, 1) AS w1 FROM customer)), ky AS (
  SELECT r, list(('0x' || substr(md5('{seed}:' || r || ':' || i), 1, 15))::BIGINT ORDER BY i) AS h FROM range(1, {rounds + 1}) t(r), range({2 * bijection.STEPS}) u(i) GROUP BY r), wk AS (
  {once("SELECT r, h, n, w1, w2, place, place AS y FROM ra, ky, dm")} UNION ALL {once("SELECT * FROM wk WHERE y >= n")}), pl AS (SELECT r, place, y FROM wk WHERE y < n)"""


RECURSIVE = MORAN.replace("WITH", "WITH RECURSIVE", 1)
SEEN = """count(*) AS n, 0::BIGINT AS n_isolates, true AS computable, CAST(NULL AS VARCHAR) AS reason"""
LOCAL = RECURSIVE + f""", {places(999, 42)}, rk AS (SELECT r, site, z, y FROM pl JOIN ra USING (place) JOIN ze USING (site)), cu AS (
  SELECT r, y + 1 AS k, s FROM (SELECT r, y, sum(z) OVER (PARTITION BY r ORDER BY y) AS s FROM rk) WHERE y <= 5), sc AS (
  SELECT (count(*) - 1) / sum(z * z) AS scale FROM ze), si2 AS (
  SELECT rk.site, count(*) FILTER (round(rk.z * (CASE WHEN y < 5 THEN s - rk.z ELSE s END) / 5 * scale, 9) >= round(zl.z * lag * scale, 9)) AS c
  FROM rk JOIN cu ON cu.r = rk.r AND cu.k = CASE WHEN y < 5 THEN 6 ELSE 5 END JOIN zl ON zl.site = rk.site, sc GROUP BY rk.site), lo AS (
  SELECT zl.site, value, zl.z, lag, zl.z * lag * scale AS local_i, (least(c, 999 - c) + 1) / 1000.0::DOUBLE AS p_value FROM zl JOIN si2 USING (site) JOIN va USING (site), sc), lm AS (
  SELECT *, CASE WHEN p_value >= 0.05 THEN 0 WHEN z > 0 AND lag > 0 THEN 1 WHEN z <= 0 AND lag > 0 THEN 2 WHEN z <= 0 THEN 3 ELSE 4 END AS quadrant FROM lo)"""


@query("a30_local_moran", LOCAL + """
SELECT site, round(value, 6) AS value, round(z, 6) AS z, round(lag, 6) AS lag, round(local_i, 6) AS local_i, round(p_value, 6) AS p_value, quadrant FROM lm""")
def local_moran(spark, sf_dir):
    return B.rounded(moran.local_moran(balances(spark, sf_dir), edges(spark, sf_dir)))


@query("a48_quadrant_counts", LOCAL + " SELECT quadrant, count(*) AS n FROM lm GROUP BY quadrant")
def quadrant_counts(spark, sf_dir):
    out = moran.local_moran(balances(spark, sf_dir), edges(spark, sf_dir))
    return out.groupBy("quadrant").agg(F.count(F.lit(1)).alias("n"))


@query("a29_permutation_test", RECURSIVE + f""", {places(999, 42)}, sv AS (
  SELECT r, ra.site, o.value - m AS z FROM pl JOIN ra USING (place) JOIN ra o ON o.place = pl.y, mu), sl AS (
  SELECT r, kn.site, avg(sv.z) AS lag FROM kn JOIN sv ON sv.site = kn.neighbour GROUP BY r, kn.site), sm AS (
  SELECT sum(z * lag) / sum(z * z) AS sim FROM sv JOIN sl USING (r, site) GROUP BY r), ob AS (
  SELECT {SEEN}, sum(z * lag) / sum(z * z) AS i FROM zl), st AS (
  SELECT avg(sim) AS a, stddev_pop(sim) AS s, count(*) FILTER (round(sim, 9) >= (SELECT round(i, 9) FROM ob)) AS c FROM sm)
SELECT n, n_isolates, computable, reason, round(i, 6) AS morans_i, round(-1.0::DOUBLE / (n - 1), 6) AS expected_i, round(a, 6) AS sim_mean, round(s, 6) AS sim_std,
  round((least(c, 999 - c) + 1) / 1000.0::DOUBLE, 6) AS p_value, round((i - a) / s, 6) AS z_score FROM ob, st""")
def permutation_test(spark, sf_dir):
    return B.rounded(moran.permutation_test(balances(spark, sf_dir), edges(spark, sf_dir)))


@query("a33_shuffled_control", RECURSIVE + f""", {places(1, 7)}, sv AS (
  SELECT ra.site, o.value - m AS z FROM pl JOIN ra USING (place) JOIN ra o ON o.place = pl.y, mu), sl AS (
  SELECT kn.site, avg(sv.z) AS lag FROM kn JOIN sv ON sv.site = kn.neighbour GROUP BY kn.site)
SELECT {SEEN}, round(sum(z * lag) / sum(z * z), 6) AS morans_i, round(-1.0::DOUBLE / (count(*) - 1), 6) AS expected_i FROM sv JOIN sl USING (site)""")
def shuffled_control(spark, sf_dir):
    """Moran's I after the values of all sites changed places once."""
    mixed = moran.shuffled(balances(spark, sf_dir), 1, seed=7).drop("round")
    return B.rounded(moran.global_moran(mixed, edges(spark, sf_dir)))


@query("a32_scatter_line", MORAN + """
SELECT count(*) AS n, round(regr_slope(lag, z), 6) AS slope, round(regr_intercept(lag, z), 4) AS intercept FROM zl""")
def scatter_line(spark, sf_dir):
    out = moran.scatter_line(balances(spark, sf_dir), edges(spark, sf_dir))
    return out.select("n", B.r("slope").alias("slope"), B.r("intercept", 4).alias("intercept"))


def _seen_edges(spark, sf_dir):
    seen = B.events(spark, sf_dir).select("site").distinct()
    return neighbours.nearest_sites(B.sites(spark, sf_dir).join(seen, "site", "left_semi"))


@query("a31_moran_at_checkpoints", f"""WITH {B.EVENTS}, {B.SITES}, sn AS (SELECT * FROM si WHERE site IN (SELECT site FROM ev)), pa AS (
  SELECT a.site, b.site AS neighbour, round({B.km('a.lat', 'a.lon', 'b.lat', 'b.lon')}, 9) AS km FROM sn a JOIN sn b ON a.site <> b.site), kn AS (
  SELECT * FROM pa QUALIFY row_number() OVER (PARTITION BY site ORDER BY km, neighbour) <= 5), cp AS (SELECT DISTINCT (top * k) // 10 AS checkpoint FROM (SELECT max(event_id) AS top FROM ev), range(1, 11) t(k)), va AS (
  SELECT checkpoint, site, arg_max(severity, event_id) AS v FROM cp JOIN ev ON event_id <= checkpoint GROUP BY ALL), ze AS (
  SELECT *, v - avg(v) OVER (PARTITION BY checkpoint) AS z FROM va), la AS (
  SELECT a.checkpoint, a.site, any_value(a.z) AS z, avg(b.z) AS lag FROM ze a LEFT JOIN (SELECT kn.site, ze.checkpoint, ze.z FROM kn JOIN ze ON ze.site = kn.neighbour) b
  ON a.site = b.site AND a.checkpoint = b.checkpoint GROUP BY a.checkpoint, a.site)
SELECT CAST(checkpoint AS BIGINT) AS checkpoint, count(*) AS n, CASE WHEN count(*) >= 15 THEN round(count(*) / count(lag) * sum(z * lag) / sum(z * z), 6) END AS morans_i FROM la GROUP BY checkpoint""")
def moran_at_checkpoints(spark, sf_dir):
    """Checkpoints at tenths of the largest id, so that the last one covers all events."""
    events = B.events(spark, sf_dir)
    top = events.agg(F.max("event_id")).first()[0] or 0
    marks = sorted({top * k // 10 for k in range(1, 11)})
    return B.rounded(moran.at_checkpoints(events, _seen_edges(spark, sf_dir), marks))


@query("a34_serial_correlation", f"""WITH {B.EVENTS}, l AS (SELECT site, value, lag(value) OVER (PARTITION BY site ORDER BY time_us) AS p FROM ev)
SELECT site, round(corr(value, p), 6) AS lag1 FROM l GROUP BY site""")
def serial_correlation(spark, sf_dir):
    return B.rounded(moran.serial_correlation(B.events(spark, sf_dir), ["site"], ["time_us"], "value"))


@query("a46_o10_centre_site", f"""WITH {B.SITES}, c AS (SELECT avg(lat) AS clat, avg(lon) AS clon FROM si)
SELECT round(clat, 6) AS clat, round(clon, 6) AS clon, site, round({B.km('clat', 'clon', 'lat', 'lon')}, 6) AS km
FROM si, c ORDER BY round({B.km('clat', 'clon', 'lat', 'lon')}, 9), site LIMIT 1""")
def centre_site(spark, sf_dir):
    return B.rounded(neighbours.centre_site(B.sites(spark, sf_dir)))


@query("a47_decay_field", f"""WITH {B.SITES}, d(decay_km) AS (VALUES (2.0::DOUBLE), (5.0::DOUBLE), (10.0::DOUBLE), (20.0::DOUBLE)), f AS (
  SELECT site, decay_km, 0.05 + (0.95 - 0.05) * exp(-{B.km('0.5::DOUBLE', '109.5::DOUBLE', 'lat', 'lon')} / decay_km) AS level FROM si, d)
SELECT site, decay_km, round(level, 6) AS level, level >= 0.5 AS flagged FROM f""")
def decay_field(spark, sf_dir):
    out = neighbours.decay_field(B.sites(spark, sf_dir), 0.5, 109.5, [2, 5, 10, 20], floor=0.05, ceiling=0.95)
    return out.select("site", "decay_km", B.r("level").alias("level"), "flagged")


@query("a47_flagged_per_step", f"""WITH {B.SITES}, d(decay_km) AS (VALUES (2.0::DOUBLE), (5.0::DOUBLE), (10.0::DOUBLE), (20.0::DOUBLE))
SELECT decay_km, count(*) FILTER (0.05 + 0.9 * exp(-{B.km('0.5::DOUBLE', '109.5::DOUBLE', 'lat', 'lon')} / decay_km) >= 0.5) AS n_flagged FROM si, d GROUP BY decay_km""")
def flagged_per_step(spark, sf_dir):
    out = neighbours.decay_field(B.sites(spark, sf_dir), 0.5, 109.5, [2, 5, 10, 20], floor=0.05, ceiling=0.95)
    return out.groupBy("decay_km").agg(F.count_if("flagged").alias("n_flagged"))


@query("w22_severity_rank", f"""WITH {B.EVENTS} SELECT event_id, rank() OVER (ORDER BY severity DESC) AS rank FROM ev""")
def severity_rank(spark, sf_dir):
    from ..operators.priority import min_rank

    return min_rank(B.events(spark, sf_dir), "severity").select("event_id", "rank")


@query("w19_repeated_keys", """WITH t AS (SELECT c_custkey, CAST(c_custkey // 3 AS VARCHAR) || CASE WHEN c_custkey % 7 < 4 THEN '' ELSE c_mktsegment END AS site_id FROM customer)
SELECT c_custkey AS src_idx, CASE WHEN count(*) OVER (PARTITION BY site_id) > 1 THEN site_id || '__' || CAST(row_number() OVER (PARTITION BY site_id ORDER BY c_custkey) - 1 AS VARCHAR) ELSE site_id END AS tower_key FROM t""")
def repeated_keys(spark, sf_dir):
    from ..sources.towers import with_site_key

    c = B.table(spark, sf_dir, "customer")
    site_id = F.concat(F.floor(F.col("c_custkey") / 3).cast("string"),
                       F.when(F.pmod("c_custkey", F.lit(7)) < 4, "").otherwise(F.col("c_mktsegment")))
    return with_site_key(c.select(F.col("c_custkey").alias("src_idx"), site_id.alias("site_id"))).select("src_idx", "tower_key")
