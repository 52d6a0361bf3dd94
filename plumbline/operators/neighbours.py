"""Nearest neighbours, adjacency and radius sums on the sphere."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..constants import EARTH_RADIUS_KM, NEIGHBOURS
from ..functions.geo import haversine_km, haversine_matrix
from ..session import cut
from .ordered import Ordered, sized

CELL_DEG = 1.0
TIE_DIGITS = 9
# Cells of one centre that meet others as one list; pairs that are worth a task, tasks at most.
LIST_ROWS, TASK_PAIRS, MOST_TASKS = 128, 8_000_000, 2000


def _spread_bits(value: Column) -> Column:
    """Insert a zero bit between the low 16 bits of a number."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        value = value.bitwiseOR(F.shiftleft(value, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return value


def z_order(lat: Column, lon: Column) -> Column:
    """Place on a curve that keeps near points near."""
    x = F.floor((lon + 180.0) / 360.0 * 65535).cast("long")
    y = F.floor((lat + 90.0) / 180.0 * 65535).cast("long")
    return _spread_bits(x).bitwiseOR(F.shiftleft(_spread_bits(y), 1))


def nearest_sites(points: DataFrame, k: int = NEIGHBOURS, key: str = "site", block_rows: int = 2048,
                  split_rows: int | None = None) -> DataFrame:
    """The k nearest other points of every point: (key, neighbour, km, rank).

    Points are ordered along a curve and cut into blocks of bounded size. A block's own points bound
    the distance its neighbours can have, which selects the few blocks to compare with. Of points
    that share a place only the first k+1 can matter to anyone, so a crowded place stays small.
    Equal distances go by key.
    """
    ranked = points.select(key, "lat", "lon").withColumn(
        "_rn", F.row_number().over(Window.partitionBy("lat", "lon").orderBy(key)))
    kept = ranked.filter(F.col("_rn") <= k + 1).withColumn("_z", z_order(F.col("lat"), F.col("lon")))
    numbered = cut(Ordered(kept, [], ["_z", "lat", "lon", key], split_rows).number("_n").df)
    blocks = max(1, numbered.count() // block_rows)
    blocked = numbered.withColumn("block", F.least(
        F.floor((F.col("_n") - 1) / block_rows), F.lit(blocks - 1)).cast("long")).select(
        key, "lat", "lon", "block", (F.col("_rn") == 1).alias("asks"))

    def bound(pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf[pdf["asks"]]
        worst = np.inf if len(asks) else 0.0
        if len(asks) and len(pdf) > k:
            d = haversine_matrix(asks["lat"].to_numpy(), asks["lon"].to_numpy(),
                                 pdf["lat"].to_numpy(), pdf["lon"].to_numpy())
            worst = float(np.partition(d, k, axis=1)[:, k].max())
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "s": [pdf["lat"].min()], "n": [pdf["lat"].max()],
                             "w": [pdf["lon"].min()], "e": [pdf["lon"].max()], "reach": [worst]})

    boxes = cut(blocked.groupBy("block").applyInPandas(
        bound, "block long, s double, n double, w double, e double, reach double"))
    pairs = _block_pairs(boxes)
    asking = blocked.filter("asks").withColumn("side", F.lit(0)).join(
        pairs.withColumnRenamed("block", "_b").withColumn("block", F.col("_b")), "block").drop("block")
    offered = blocked.withColumn("side", F.lit(1)).join(
        pairs.withColumnRenamed("block", "_b").withColumn("block", F.col("other")), "block").drop("block")

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1].sort_values(key)
        d = np.round(haversine_matrix(a["lat"].to_numpy(), a["lon"].to_numpy(),
                                      b["lat"].to_numpy(), b["lon"].to_numpy()), TIE_DIGITS)
        take = min(k + 1, len(b))
        best = np.argsort(d, axis=1, kind="stable")[:, :take]
        rows = np.repeat(np.arange(len(a)), take)
        return pd.DataFrame({"lat": a["lat"].to_numpy()[rows], "lon": a["lon"].to_numpy()[rows],
                             "neighbour": b[key].to_numpy()[best.ravel()], "km": d[rows, best.ravel()]})

    kind = dict(points.dtypes)[key]
    found = asking.unionByName(offered).groupBy("_b", "other").applyInPandas(
        tile, f"lat double, lon double, neighbour {kind}, km double")
    place = Window.partitionBy("lat", "lon").orderBy("km", "neighbour")
    best = found.withColumn("_r", F.row_number().over(place)).filter(F.col("_r") <= k + 1).drop("_r")
    own = points.select(key, "lat", "lon").join(best, ["lat", "lon"]).filter(F.col(key) != F.col("neighbour"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("km", "neighbour"))
    return own.withColumn("rank", rank).filter(F.col("rank") <= k).select(key, "neighbour", "km", "rank")


def _cells(s: Column, n: Column, w: Column, e: Column, whole: int = int(360 / CELL_DEG)) -> Column:
    """Grid cells a box touches, `whole` of them around the globe, wrapping at the date line."""
    deg = 360 / whole
    lats = F.sequence(F.floor(s / deg).cast("long"), F.floor(n / deg).cast("long"))
    wide = F.when(e - w >= 360 - deg, F.sequence(F.lit(0).cast("long"), F.lit(whole - 1).cast("long"))).otherwise(
        F.transform(F.sequence(F.floor(w / deg).cast("long"), F.floor(e / deg).cast("long")),
                    lambda x: F.pmod(x, F.lit(whole).cast("long"))))
    lons = F.array_distinct(wide)
    return F.flatten(F.transform(lats, lambda y: F.transform(lons, lambda x: F.struct(y.alias("y"), x.alias("x")))))


def _grown(s, n, w, e, km):
    """Box grown by a distance; the longitude margin widens towards the poles."""
    angle = F.least(km / F.lit(EARTH_RADIUS_KM), F.lit(np.pi))
    south, north = s - F.degrees(angle), n + F.degrees(angle)
    polar = (south <= -90) | (north >= 90)
    top = F.greatest(F.abs(s), F.abs(n))
    margin = F.when(polar, F.lit(360.0)).otherwise(
        F.degrees(F.asin(F.least(F.sin(angle) / F.cos(F.radians(top)), F.lit(1.0)))) + 1e-9)
    return F.greatest(south, F.lit(-90.0)), F.least(north, F.lit(90.0)), w - margin, e + margin


def _block_pairs(boxes: DataFrame) -> DataFrame:
    """Blocks to compare: `other` may hold a neighbour of a point of `block`."""
    c = F.col
    south, north, west, east = _grown(c("s"), c("n"), c("w"), c("e"), c("reach"))
    ask = boxes.select("block", south.alias("gs"), north.alias("gn"), west.alias("gw"), east.alias("ge"),
                       F.explode(_cells(south, north, west, east)).alias("cell"))
    have = boxes.select(c("block").alias("other"), c("s").alias("os"), c("n").alias("on"), c("w").alias("ow"), c("e").alias("oe"),
                        F.explode(_cells(c("s"), c("n"), c("w"), c("e"))).alias("cell"))
    meets = F.lit(False)
    for turn in (-360.0, 0.0, 360.0):
        meets = meets | ((c("ow") + turn <= c("ge") + 1e-9) & (c("oe") + turn >= c("gw") - 1e-9))
    near = ask.join(have, "cell").filter((c("os") <= c("gn") + 1e-9) & (c("on") >= c("gs") - 1e-9) & meets)
    return near.select("block", "other").distinct()


def inverse_distance_weights(edges: DataFrame, key: str = "site") -> DataFrame:
    """Weights 1/km with a floor of a millimetre, normalised to 1 per point."""
    raw = edges.withColumn("_w", 1.0 / F.greatest("km", F.lit(1e-6)))
    total = raw.groupBy(key).agg(F.sum("_w").alias("_sum"))
    return raw.join(total, key).withColumn("weight", F.col("_w") / F.col("_sum")).drop("_w", "_sum")


def adjacency(cells: DataFrame, within_km: float, key: str = "cell", digits: int | None = None) -> DataFrame:
    """Cells whose centres are at most `within_km` apart, both ways; a cell without any stays isolated.

    The grid of the join is as wide as the distance, so a centre meets the centres around it only. Cells that share a centre
    meet as one list: a distance is computed (and rounded to `digits`) once for two centres, whatever the number of their cells.
    """
    c = F.col
    centres = cells.filter(c(key).isNotNull() & c("lat").isNotNull() & c("lon").isNotNull()).select(key, "lat", "lon")
    sizes = centres.groupBy("lat", "lon").agg(F.ceil(F.count(F.lit(1)) / LIST_ROWS).alias("_lists"))
    lists = cut(centres.join(sizes, ["lat", "lon"]).groupBy("lat", "lon", F.pmod(F.xxhash64(key), "_lists").alias("_list")).agg(F.collect_list(key).alias("_keys")))
    south, north, west, east = _grown(c("lat"), c("lat"), c("lon"), c("lon"), F.lit(float(within_km)))
    reach = float(np.degrees(within_km / EARTH_RADIUS_KM))
    whole = max(4, int(360 / max(reach, 1e-5)))
    ask = lists.select(c("_keys").alias("_own"), c("lat").alias("_lat"), c("lon").alias("_lon"), "_list",
                       F.explode(_cells(south, north, west, east, whole)).alias("_at"))
    have = lists.select("_keys", "lat", "lon", F.explode(_cells(c("lat"), c("lat"), c("lon"), c("lon"), whole)).alias("_at"))
    # The lists are small beside the pairs that come of them, so tasks go by these; a crowded place of the grid is dealt to several.
    asked, held = (t.groupBy("_at").agg(F.sum(F.size(k).cast("double")).alias(n)) for t, k, n in ((ask, "_own", "_a"), (have, "_keys", "_h")))
    crowds = cut(asked.join(held, "_at").select("_at", (c("_a") * c("_h") / TASK_PAIRS).alias("_tasks")))
    tasks = int(min(max(1, crowds.agg(F.sum("_tasks")).first()[0] or 0), MOST_TASKS))
    dealt = crowds.select("_at", F.ceil("_tasks").alias("_deals"))
    ask = ask.join(dealt, "_at").withColumn("_deal", F.pmod(F.xxhash64("_lat", "_lon", "_list"), "_deals"))
    have = have.join(dealt, "_at").withColumn("_deal", F.explode(F.sequence(F.lit(0).cast("long"), c("_deals") - 1)))
    pairs = ask.repartition(tasks, "_at", "_deal").join(have.repartition(tasks, "_at", "_deal"), ["_at", "_deal"])
    km = haversine_km(c("_lat"), c("_lon"), c("lat"), c("lon"))
    near = pairs.withColumn("km", km).filter(c("km") <= within_km)
    near = near.select("_own", "_keys", F.round("km", digits).alias("km") if digits is not None else c("km"))
    each = near.select(F.explode("_own").alias(key), "_keys", "km").select(key, F.explode("_keys").alias("neighbour"), "km")
    return each.filter(c(key) != c("neighbour"))


def axial_neighbours(cells: DataFrame, q: str = "q", r: str = "r") -> DataFrame:
    """First-ring neighbours on an axial hexagon grid, kept where the neighbour cell is present."""
    ring = F.array(*[F.struct(F.lit(dq).alias("dq"), F.lit(dr).alias("dr"))
                     for dq, dr in ((1, 0), (-1, 0), (0, 1), (0, -1), (1, -1), (-1, 1))])
    asked = cells.select(q, r, F.explode(ring).alias("_o")).select(
        q, r, (F.col(q) + F.col("_o.dq")).alias("nq"), (F.col(r) + F.col("_o.dr")).alias("nr"))
    present = cells.select(F.col(q).alias("nq"), F.col(r).alias("nr")).distinct()
    return asked.distinct().join(present, ["nq", "nr"], "left_semi")


def radius_sums(sites: DataFrame, points: DataFrame, value: str, radii_km: list[float], key: str = "site",
                cell_deg: float = 0.1) -> DataFrame:
    """Sum and number of raster points within each radius of every site.

    Sites are entered under every cell their circle touches; points stay in one cell. Points of one
    place are summed before the join.
    """
    far, c = max(radii_km), F.col
    south, north, west, east = _grown(c("lat"), c("lat"), c("lon"), c("lon"), F.lit(float(far)))
    whole = round(360 / cell_deg)

    def row(x):
        return F.floor(x / cell_deg).cast("long")

    cells = F.flatten(F.transform(F.sequence(row(south), row(north)), lambda y: F.transform(
        F.array_distinct(F.transform(F.sequence(row(west), row(east)), lambda x: F.pmod(x, F.lit(whole).cast("long")))),
        lambda x: F.struct(y.alias("y"), x.alias("x")))))
    circles = sites.select(key, c("lat").alias("_lat"), c("lon").alias("_lon"), F.explode(cells).alias("_cell"))
    places = points.groupBy("lat", "lon").agg(F.sum(value).alias("_v"), F.count(F.lit(1)).alias("_n")).withColumn(
        "_cell", F.struct(row(c("lat")).alias("y"), F.pmod(row(c("lon")), F.lit(whole).cast("long")).alias("x")))
    near = places.join(sized(circles), "_cell").withColumn(
        "_km", haversine_km(c("_lat"), c("_lon"), c("lat"), c("lon"))).filter(c("_km") <= far)
    sums = []
    for radius in radii_km:
        inside = c("_km") <= radius
        sums.append(F.sum(F.when(inside, c("_v"))).alias(f"sum_{radius:g}km"))
        sums.append(F.sum(F.when(inside, c("_n")).otherwise(0)).alias(f"n_{radius:g}km"))
    counted = near.groupBy(key).agg(*sums)
    return sites.select(key).join(counted, key, "left").fillna(0, [f"n_{x:g}km" for x in radii_km])


def centre_site(sites: DataFrame, key: str = "site") -> DataFrame:
    """Mean place of all sites and the site nearest to it."""
    centre = sites.agg(F.avg("lat").alias("clat"), F.avg("lon").alias("clon")).withColumn("_j", F.lit(1))
    joined = sites.withColumn("_j", F.lit(1)).join(F.broadcast(centre), "_j")
    km = F.round(haversine_km(F.col("clat"), F.col("clon"), F.col("lat"), F.col("lon")), TIE_DIGITS)
    return joined.groupBy("clat", "clon").agg(F.min(F.struct(km.alias("km"), key)).alias("_m")).select(
        "clat", "clon", F.col(f"_m.{key}").alias(key), F.col("_m.km").alias("km"))


def decay_field(sites: DataFrame, lat: float, lon: float, decays_km: list[float], floor: float = 0.0,
                ceiling: float = 1.0, flag_from: float = 0.5, key: str = "site") -> DataFrame:
    """Intensity falling off from an origin, one row per site and decay length."""
    km = haversine_km(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon"))
    steps = sites.withColumn("km", km).withColumn("decay_km", F.explode(F.array(*[F.lit(float(d)) for d in decays_km])))
    level = F.lit(floor) + F.lit(ceiling - floor) * F.exp(-F.col("km") / F.col("decay_km"))
    return steps.withColumn("level", level).withColumn("flagged", F.col("level") >= flag_from).select(
        key, "decay_km", "km", "level", "flagged")
