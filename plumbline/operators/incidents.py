"""Flagged events chained into incidents, and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..constants import INCIDENT_KM, WINDOW_S
from ..functions.geo import haversine_km
from ..session import cut
from .ordered import Ordered, sized


# Slots of time whose order is settled together; blocks of slots are so few that their order is a matter of one small table.
SLOTS_BITS = 12


def chain(flagged: DataFrame, window_s: float = WINDOW_S, reach_km: float = INCIDENT_KM, time_us: str = "time_us",
          event_id: str = "event_id", split_rows: int | None = None) -> DataFrame:
    """Number the incidents of flagged events (`incident`, in time order over all sites).

    An event joins the incident of the event before it when the gap is short, the sites are the
    same or close (unknown places never match), and neither its run nor its session contradicts
    one already in the incident. Columns used: site, lat, lon, run_id, session.

    Time is cut into slots as long as the longest gap. An empty slot parts the chain for certain, so the stretches
    between empty slots are ordered and chained side by side; a stretch too large for a task is split by `Ordered`.
    """
    def before(column):
        return lambda w: F.lag(column).over(w)

    width, c, keys = int(window_s * 1e6), F.col, ["_stretch"]
    rows, sizes = _stretched(flagged, width, time_us)
    seq = Ordered(rows, keys, [time_us, event_id], split_rows, sizes)
    seq.within(1, _us=before(time_us), _site=before("site"), _lat=before("lat"), _lon=before("lon"))
    close = F.coalesce(c("site") == c("_site"), F.lit(False)) | F.coalesce(
        haversine_km(c("_lat"), c("_lon"), c("lat"), c("lon")) <= reach_km, F.lit(False))
    apart = c("_us").isNull() | (c(time_us) - c("_us") > width) | ~close
    seq.map(lambda d: d.withColumn("_break", apart.cast("int")))
    seq.running(_coarse=("sum", c("_break")), _pos=("sum", F.lit(1).cast("long")))
    seen = {f"_seen_{x}": ("last", F.when(c(x).isNotNull(), F.struct("_coarse", "_pos", c(x).alias("v"))))
            for x in ("run_id", "session")}
    seq.running(exclusive=True, **seen)

    def conflict(x):
        s = c(f"_seen_{x}")
        return F.when((s["_coarse"] == c("_coarse")) & (s["v"] != c(x)), s["_pos"])

    seq.map(lambda d: d.withColumn("_against", F.greatest(conflict("run_id"), conflict("session"))))
    marked = cut(seq.df.drop("_us", "_site", "_lat", "_lon", *seen))
    splits = _splits(marked.filter(c("_against").isNotNull()).select(*keys, "_coarse", "_pos", "_against"), keys, split_rows)
    if splits is None:
        # Without contradictions the coarse groups are the incidents.
        numbered = marked.withColumn("_within", c("_coarse"))
    else:
        marked = marked.join(sized(splits.select(*keys, "_pos", F.lit(1).alias("_split"))), [*keys, "_pos"], "left").withColumn(
            "_break", F.greatest("_break", F.coalesce("_split", F.lit(0)))).drop("_split")
        numbered = cut(Ordered(marked, keys, [time_us, event_id], split_rows, sizes).running(_within=("sum", c("_break"))).df)
    # Incidents of the stretches before: summed inside blocks of slots, then over the blocks.
    found = numbered.groupBy(*keys).agg(F.max("_within").alias("_n")).withColumn("_block", F.shiftright("_stretch", SLOTS_BITS))
    inside = Window.partitionBy("_block").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    local = found.withColumn("_earlier", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    blocks = found.groupBy("_block").agg(F.sum("_n").alias("_all")).withColumn("_base", F.coalesce(F.sum("_all").over(_earlier()), F.lit(0)))
    base = local.join(F.broadcast(blocks.select("_block", "_base")), "_block").select(*keys, (c("_earlier") + c("_base")).alias("_before"))
    out = numbered.join(base, keys).withColumn("incident", c("_before") + c("_within"))
    return out.select(*flagged.columns, "incident")


def _earlier():
    """Order of the blocks of slots: one row for 4,096 times the longest gap, so a year of two-minute slots has 65."""
    return Window.partitionBy(F.lit(0)).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)


def _stretched(flagged: DataFrame, width: int, time_us: str) -> tuple[DataFrame, tuple[int, int]]:
    """Rows with the first slot of their stretch of filled slots, and (rows of the largest stretch, all rows)."""
    at = F.col(time_us)
    slotted = cut(flagged.withColumn("_slot", F.call_function("div", at - F.pmod(at, F.lit(width)), F.lit(width))))
    slots = slotted.groupBy("_slot").agg(F.count(F.lit(1)).alias("_n"))
    filled = slots.select((F.col("_slot") + 1).alias("_slot"), F.lit(True).alias("_after"))
    first = slots.join(filled, "_slot", "left").withColumns({
        "_first": F.when(F.col("_after").isNull(), F.col("_slot")), "_block": F.shiftright("_slot", SLOTS_BITS)})
    inside = Window.partitionBy("_block").orderBy("_slot").rowsBetween(Window.unboundedPreceding, 0)
    local = first.withColumn("_from", F.last("_first", ignorenulls=True).over(inside))
    blocks = first.groupBy("_block").agg(F.max("_first").alias("_last")).withColumn("_carried", F.last("_last", ignorenulls=True).over(_earlier()))
    stretches = cut(local.join(F.broadcast(blocks.select("_block", "_carried")), "_block").select(
        "_slot", F.coalesce("_from", "_carried").alias("_stretch"), "_n"))
    facts = stretches.groupBy("_stretch").agg(F.sum("_n").alias("n")).agg(F.max("n").alias("top"), F.sum("n").alias("total")).first()
    rows = slotted.join(stretches.drop("_n"), "_slot").drop("_slot")
    return rows, (int(facts["top"] or 0), int(facts["total"] or 0))


def _splits(conflicts: DataFrame, keys: list[str], split_rows: int | None) -> DataFrame | None:
    """Which contradictions really open a new incident, or None if there are none.

    A row contradicts an earlier position; that only counts if no split lies in between. Where
    the earlier position is at or after the previous contradiction this is certain. From a split
    the next one is the first row that contradicts a position at or after it, so the rest follows
    from the certain ones by following that link, doubled in every round.
    """
    if conflicts.isEmpty():
        return None
    seq = Ordered(conflicts, keys, ["_pos"], split_rows).within(
        1, _last=lambda w: F.lag("_pos").over(w), _last_coarse=lambda w: F.lag("_coarse").over(w))
    certain = F.col("_last").isNull() | (F.col("_last_coarse") != F.col("_coarse")) | (
        F.col("_against") >= F.col("_last"))
    marked = cut(seq.df.select(*keys, "_pos", "_against", certain.alias("_certain")))
    chosen = marked.filter("_certain").select(*keys, "_pos")
    if marked.filter("NOT _certain").isEmpty():
        return chosen
    ends = marked.select(*keys, F.col("_against").alias("_x"), F.lit(1).alias("_kind"), "_pos",
                         F.col("_pos").alias("_end"))
    asks = marked.select(*keys, F.col("_pos").alias("_x"), F.lit(0).alias("_kind"), "_pos",
                         F.lit(None).cast("long").alias("_end"))
    links = Ordered(ends.unionByName(asks), keys, ["_x", "_kind", "_pos"], split_rows).running(
        reverse=True, _next=("min", F.col("_end"))).df
    jump = cut(links.filter("_kind = 0 AND _next IS NOT NULL").select(*keys, "_pos", "_next"))
    chosen, known = cut(chosen), -1
    while (size := chosen.count()) != known:
        known = size
        reached = chosen.join(jump, [*keys, "_pos"]).select(*keys, F.col("_next").alias("_pos"))
        chosen = cut(chosen.unionByName(reached).distinct())
        second = jump.select(*keys, F.col("_pos").alias("_next"), F.col("_next").alias("_far"))
        jump = cut(jump.join(second, [*keys, "_next"]).select(*keys, "_pos", F.col("_far").alias("_next")))
    return chosen


def summarise(chained: DataFrame, labels: DataFrame | None = None, populations: DataFrame | None = None,
              time_us: str = "time_us", event_id: str = "event_id") -> DataFrame:
    """One row per incident. Members and sites stay in long form: an incident has no size limit.

    Aggregated per (incident, site) first. `labels` holds one row per event, `populations` one per
    site; the population reported is the largest of any site, never a sum.
    """
    rows = chained
    if labels is not None:
        rows = rows.join(labels.select(event_id, F.col("label").alias("_label")), event_id, "left")
    else:
        rows = rows.withColumn("_label", F.lit(None).cast("string"))
    place = F.struct(F.col(time_us).alias("us"), F.col(event_id).alias("id"))
    per_site = rows.groupBy("incident", "site").agg(
        F.count(F.lit(1)).alias("n"), F.count("_label").alias("labelled"), F.min(place).alias("first"),
        F.max(place).alias("last"),
        F.min(F.struct((-F.col("severity")).alias("s"), place.alias("p"), "attack_type")).alias("top"),
        F.bool_or(F.coalesce(F.col("source") == "replay", F.lit(False))).alias("replayed"),
        F.bool_or(F.coalesce(F.col("_label") == "confirmed", F.lit(False))).alias("confirmed"),
        F.bool_or(F.coalesce(F.col("_label") == "dismissed", F.lit(False))).alias("dismissed"))
    if populations is not None:
        per_site = per_site.join(sized(populations.select("site", F.col("pop_2km").alias("_pop"))), "site", "left")
    else:
        per_site = per_site.withColumn("_pop", F.lit(None).cast("double"))
    out = per_site.groupBy("incident").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.min("top").alias("top"),
        F.sum("n").alias("event_count"), F.sum("labelled").alias("labeled_event_count"),
        F.count("site").alias("n_sites"), F.bool_or("replayed").alias("tower_attribution_simulated"),
        F.max("_pop").alias("max_pop_2km"), F.bool_or("confirmed").alias("confirmed"),
        F.bool_or("dismissed").alias("dismissed"))
    return out.select(
        F.concat(F.lit("INC-"), F.col("first.id").cast("string")).alias("incident_id"),
        F.col("top.p.id").alias("top_event_id"), F.col("top.attack_type").alias("attack_type"),
        F.bround(-F.col("top.s"), 4).alias("severity"),
        F.col("first.us").alias("start_us"), F.col("last.us").alias("end_us"),
        ((F.col("last.us") - F.col("first.us")) / 1e6).alias("duration_seconds"),
        F.when(F.col("confirmed"), "Confirmed").when(F.col("dismissed"), "Dismissed").otherwise("New").alias("status"),
        "event_count", "labeled_event_count", "n_sites", "tower_attribution_simulated", "max_pop_2km")


def listed(summaries: DataFrame) -> DataFrame:
    """Most severe first, the latest first within equal severity."""
    return summaries.orderBy(F.desc("severity"), F.desc("end_us"))


def members(chained: DataFrame, time_us: str = "time_us", event_id: str = "event_id", split_rows=None) -> DataFrame:
    """Every event with its incident id and its place in the incident."""
    seq = Ordered(chained, ["incident"], [time_us, event_id], split_rows)
    seq.running(ordinal=("sum", F.lit(1).cast("long")))
    first = chained.groupBy("incident").agg(F.min_by(event_id, F.struct(time_us, event_id)).alias("_first"))
    named = seq.df.join(first, "incident")
    return named.select(F.concat(F.lit("INC-"), F.col("_first").cast("string")).alias("incident_id"),
                        event_id, "ordinal")


def incident_sites(chained: DataFrame, time_us: str = "time_us", event_id: str = "event_id",
                   split_rows=None) -> DataFrame:
    """Sites of every incident in the order they were first seen."""
    first = chained.filter(F.col("site").isNotNull()).groupBy("incident", "site").agg(
        F.min(time_us).alias("first_us"), F.min_by(event_id, F.struct(time_us, event_id)).alias("_first"))
    return Ordered(first, ["incident"], ["first_us", "_first"], split_rows).number("ordinal").df.drop("_first")
