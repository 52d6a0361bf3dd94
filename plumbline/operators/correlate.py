"""Distance-weighted severity of other sites over the last seconds, per event."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..constants import DECAY_KM, WINDOW_S
from ..functions.geo import haversine_matrix
from ..session import cut, split_rows as conf_split_rows
from .ordered import group_sizes, sized

SOURCE, PAST = 1, 0
CARRIED_IN, CARRIED_BACK = -1, 3
RESULT = "event_id long, num double, den double, n long"
# Rows weighed one by one, and the most places whose weights a task keeps (34 MB).
BLOCK, MOST_PLACES = 512, 2048


def correlate(events: DataFrame, sites: DataFrame, window_s: float = WINDOW_S, decay_km: float = DECAY_KM,
              split_rows: int | None = None) -> DataFrame:
    """Adds `correlation_score` and `n_correlated` to the events of known sites.

    The score is the mean severity of events that other known sites had in the window before,
    weighted by exp(-distance / decay). Time is cut into slots of one window, so that the window of
    an event is the end of one slot and the beginning of the next: two running sums, forwards in the
    event's own slot and backwards in the one before. Events are never paired; the work is events
    times active places, as sites that share a place share its sums. A slot too large for one task is range-partitioned and the per-site sums of
    the other parts are handed in.
    """
    limit = split_rows or conf_split_rows(events.sparkSession)
    width = int(window_s * 1e6)
    located = events.join(sized(sites.select("site", "lat", "lon")), "site")
    base = ["event_id", "site", "lat", "lon"]
    here = located.select(*base, F.col("time_us").alias("t"), F.lit(SOURCE).alias("kind"),
                          F.col("severity").alias("sev"), F.lit(1).cast("long").alias("n"))
    past = located.select(*base, (F.col("time_us") - width).alias("t"), F.lit(PAST).alias("kind"),
                          F.lit(0.0).alias("sev"), F.lit(0).cast("long").alias("n"))
    asked = here.unionByName(past).withColumn("slot", F.floor(F.col("t") / F.lit(width)).cast("long"))
    top, total = group_sizes(asked, ["slot"])
    if top <= limit:
        tasks = 3 * events.sparkSession.sparkContext.defaultParallelism
        slots = max(1, min(limit, total // tasks) // max(top, 1))
        chunked = asked.withColumn("chunk", F.floor(F.col("slot") / F.lit(slots)).cast("long"))
    else:
        chunked = _with_carry(asked, -(-2 * total // limit))

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        return _score_chunk(pdf, decay_km)

    parts = chunked.groupBy("chunk").applyInPandas(score, RESULT)
    sums = parts.groupBy("event_id").agg(F.sum("num").alias("num"), F.sum("den").alias("den"),
                                         F.sum("n").alias("n"))
    out = located.drop("lat", "lon").join(sums, "event_id", "left")
    score_col = F.when((F.col("n") > 0) & (F.col("den") > 1e-9), F.col("num") / F.col("den")).otherwise(0.0)
    return out.withColumns({"correlation_score": score_col,
                            "n_correlated": F.coalesce("n", F.lit(0).cast("long"))}).drop("num", "den", "n")


def _with_carry(asked: DataFrame, parts: int) -> DataFrame:
    """Balanced chunks in time order, each with the per-site sums of its slot before and after it."""
    ranged = cut(asked.repartitionByRange(parts, "slot", "t", "kind", "event_id")
                 .withColumn("chunk", F.spark_partition_id().cast("long")))
    spans = ranged.groupBy("slot", "chunk").agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_parts", F.count(F.lit(1)).over(Window.partitionBy("slot"))).filter("_parts > 1").select("slot", "chunk")
    spans = cut(spans)
    totals = (ranged.filter(F.col("n") > 0).join(F.broadcast(spans), ["slot", "chunk"], "left_semi")
              .groupBy("slot", "chunk", "site", "lat", "lon")
              .agg(F.sum("sev").alias("sev"), F.sum("n").alias("n")))
    grid = totals.select("slot", "site", "lat", "lon").distinct().join(F.broadcast(spans), "slot")
    dense = grid.join(totals, ["slot", "chunk", "site", "lat", "lon"], "left")
    w = Window.partitionBy("slot", "site").orderBy("chunk")
    back = Window.partitionBy("slot", "site").orderBy(F.desc("chunk"))

    def side(window, kind):
        frame = window.rowsBetween(Window.unboundedPreceding, -1)
        summed = dense.select("slot", "chunk", "site", "lat", "lon", F.sum("sev").over(frame).alias("sev"),
                              F.sum("n").over(frame).alias("n"))
        return summed.filter(F.col("n") > 0).withColumns({
            "kind": F.lit(kind), "t": F.lit(0).cast("long"), "event_id": F.lit(-1).cast("long")})

    return ranged.unionByName(side(w, CARRIED_IN)).unionByName(side(back, CARRIED_BACK))


def _score_chunk(pdf: pd.DataFrame, decay_km: float) -> pd.DataFrame:
    place = pdf["kind"].map({CARRIED_IN: 0, CARRIED_BACK: 2}).fillna(1)
    rows = pdf.assign(place=place).sort_values(["slot", "place", "t", "kind", "event_id"], ignore_index=True)
    spots, known = pd.factorize(pd.MultiIndex.from_arrays([rows["lat"], rows["lon"]]))
    weights = _Weights(np.array([k[0] for k in known], float), np.array([k[1] for k in known], float), decay_km)
    kind, sums = rows["kind"].to_numpy(), np.zeros((len(rows), 3))
    amounts = rows[["sev", "n"]].to_numpy(dtype=float)
    busy = rows.groupby("slot")["n"].transform("sum").to_numpy() > 0
    for asked, step in ((SOURCE, 1), (PAST, -1)):
        way, asks = rows[::step], (kind == asked) & busy
        # Other sites of the same place count in full: the running sums of the place less those of the site.
        beside = (way.groupby(["slot", way["lat"], way["lon"]], dropna=False)[["sev", "n"]].cumsum()
                  - way.groupby(["slot", "site"])[["sev", "n"]].cumsum()).to_numpy(dtype=float)[::step]
        sums[asks, :2] = beside[asks]
        sums[asks, 2] = (way.groupby("slot")["n"].cumsum() - way.groupby(["slot", "site"])["n"].cumsum()).to_numpy()[::step][asks]
        edges = np.flatnonzero(np.diff(rows["slot"].to_numpy(), prepend=np.nan) != 0)
        for start, stop in zip(edges, [*edges[1:], len(rows)]):
            if busy[start]:
                some = slice(start, stop)
                own = np.flatnonzero(asks[some][::step])
                far = _running(spots[some][::step], amounts[some][::step], own, weights)
                at = start + own if step == 1 else stop - 1 - own
                sums[at, :2] += far
    told = ((kind == SOURCE) | (kind == PAST)) & busy
    return pd.DataFrame({"event_id": rows["event_id"].to_numpy()[told], "num": sums[told, 0], "den": sums[told, 1],
                         "n": sums[told, 2].astype("int64")})


class _Weights:
    """Weights between different places; few places are weighed once, many when they are asked for."""

    def __init__(self, lat: np.ndarray, lon: np.ndarray, decay_km: float):
        self.lat, self.lon, self.decay_km = lat, lon, decay_km
        self.all = self._of(np.arange(len(lat)), np.arange(len(lat))) if len(lat) <= MOST_PLACES else None

    def _of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        km = haversine_matrix(self.lat[a], self.lon[a], self.lat[b], self.lon[b])
        return np.where(a[:, None] == b[None, :], 0.0, np.exp(-km / self.decay_km))

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self._of(a, b) if self.all is None else self.all[np.ix_(a, b)]


def _running(spots: np.ndarray, amounts: np.ndarray, asks: np.ndarray, weights: _Weights) -> np.ndarray:
    """Weighted sums of the rows up to each asking row, those of its own place left out.

    Blocks of rows: the sums by place up to the block are weighed for the places that ask in it, the rows within it one by one.
    """
    used, local = np.unique(spots, return_inverse=True)
    before, out = np.zeros((len(used), amounts.shape[1])), np.zeros((len(asks), amounts.shape[1]))
    for start in range(0, len(spots), BLOCK):
        block, first = slice(start, start + BLOCK), np.searchsorted(asks, start)
        mine = asks[first:np.searchsorted(asks, start + BLOCK)]
        own, inside = amounts[block], local[block]
        if len(mine):
            targets, line = np.unique(local[mine], return_inverse=True)
            # Columns: all places of the slot where rows stand before, then those of this block.
            held = np.flatnonzero(before.any(axis=1))
            ahead = weights.between(used[targets], used[held]) @ before[held]
            near, column = np.unique(inside, return_inverse=True)
            pairs = weights.between(used[targets], used[near])[line][:, column]
            pairs[np.arange(len(inside))[None, :] > (mine - start)[:, None]] = 0.0
            out[first:first + len(mine)] = ahead[line] + pairs @ own
        np.add.at(before, inside, own)
    return out
