"""Debounced alert state, late and duplicate arrivals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..constants import ENTER_STREAK, EXIT_STREAK
from .ordered import Ordered, group_sizes


def _streak_event(above: Column, enter: int, leave: int):
    """'alerting' after `enter` readings above in a row, 'normal' after `leave` below in a row."""
    high = F.when(above, 1).otherwise(0)

    def event(w: Window) -> Column:
        last_in = w.rowsBetween(1 - enter, 0)
        last_out = w.rowsBetween(1 - leave, 0)
        entered = (F.sum(high).over(last_in) == enter)
        left = (F.sum(1 - high).over(last_out) == leave)
        return F.when(entered, F.lit("alerting")).when(left, F.lit("normal"))

    return event


def hysteresis(df: DataFrame, keys: list[str], order: list[str], above: str, state: str = "alert_state",
               enter: int = ENTER_STREAK, leave: int = EXIT_STREAK, advances: str | None = None,
               known: str | None = None, split_rows: int | None = None, sizes: tuple[int, int] | None = None) -> DataFrame:
    """Alert state per key after every reading.

    The two-state machine has a closed form: a run of `enter` readings above always ends in
    alerting and a run of `leave` below in normal, so the state is the latest such event.
    Rows whose `advances` flag is false neither extend nor break a run; they get the state of
    the readings before them. A state in `known` holds from that row on, whatever the runs say.
    """
    event = _streak_event(F.col(above), enter, leave)
    back = max(enter, leave) - 1
    if advances is None:
        seq = Ordered(df, keys, order, split_rows, sizes).within(back, _event=event)
    else:
        sizes = sizes or group_sizes(df, keys)
        moving = Ordered(df.filter(F.col(advances)), keys, order, split_rows, sizes).within(back, _event=event).df
        waiting = df.filter(~F.col(advances)).withColumn("_event", F.lit(None).cast("string"))
        seq = Ordered(moving.unionByName(waiting), keys, order, split_rows, sizes)
    event_now = F.coalesce(known, "_event") if known else F.col("_event")
    seq.running(**{state: ("last", event_now)})
    return seq.df.drop("_event").withColumn(state, F.coalesce(state, F.lit("normal")))


def current_state(df: DataFrame, keys: list[str], order: list[str], state: str = "alert_state") -> DataFrame:
    """State of every key after its last reading."""
    return df.groupBy(*keys).agg(F.max_by(state, F.struct(*order)).alias(state))


def reordered_in_batch(df: DataFrame, batch: str, submitted_key: str, position: str, time_us: str,
                       split_rows: int | None = None) -> DataFrame:
    """Flag rows submitted after a later reading of the same submitted key in their batch."""
    seq = Ordered(df, [batch, submitted_key], [position], split_rows)
    seq.running(exclusive=True, _seen=("max", F.col(time_us)))
    return seq.df.withColumn("reordered", F.coalesce(F.col(time_us) < F.col("_seen"), F.lit(False))).drop("_seen")


def first_arrivals(df: DataFrame, keys: list[str], arrival: list[str], event_id: str) -> DataFrame:
    """Flag repeats of a key and name the event that was accepted first.

    The first arrival is found by a map-side aggregate; the join back splits under skew.
    """
    first = df.groupBy(*keys).agg(F.min_by(event_id, F.struct(*arrival)).alias("original_id"))
    out = df.join(first, keys)
    return out.withColumn("duplicate", F.col(event_id) != F.col("original_id"))


def late_rows(df: DataFrame, keys: list[str], batch: str, time_us: str, split_rows: int | None = None,
              sizes: tuple[int, int] | None = None) -> DataFrame:
    """Flag rows older than what earlier batches had already delivered for their key.

    The high-water mark needs one row per key and batch, not the readings themselves.
    """
    marks = df.groupBy(*keys, batch).agg(F.max(time_us).alias("_top"))
    seq = Ordered(marks, keys, [batch], split_rows, sizes).running(exclusive=True, _mark=("max", F.col("_top")))
    joined = df.join(seq.df.drop("_top"), [*keys, batch])
    return joined.withColumn("out_of_order", F.coalesce(F.col(time_us) < F.col("_mark"), F.lit(False))).drop("_mark")


def accept(df: DataFrame, site: str = "site", batch: str = "batch_seq", position: str = "position",
           time_us: str = "time_us", event_id: str = "event_id", above: str = "above",
           split_rows: int | None = None) -> DataFrame:
    """Arrival handling of a whole history of batches: repeats, late rows and alert state.

    Repeats keep the original event id and carry no state. Late rows are kept and get the
    current state without changing it. Batches are read in order, and by time inside a batch.
    """
    sizes = group_sizes(df, [site])
    seen = first_arrivals(df, [site, time_us], [batch, position], event_id)
    fresh = late_rows(seen.filter(~F.col("duplicate")), [site], batch, time_us, split_rows, sizes)
    fresh = fresh.withColumn("_moves", ~F.col("out_of_order"))
    stated = hysteresis(fresh, [site], [batch, time_us], above, advances="_moves",
                        split_rows=split_rows, sizes=sizes)
    repeats = seen.filter("duplicate").withColumns({
        "out_of_order": F.lit(False), "alert_state": F.lit(None).cast("string")})
    return stated.drop("_moves").unionByName(repeats)


def batch_counters(accepted: DataFrame, batch: str = "batch_id") -> DataFrame:
    """What the sender of every batch is told."""
    def n(test: Column) -> Column:
        return F.count_if(F.coalesce(test, F.lit(False)))

    return accepted.groupBy(batch).agg(
        F.count(F.lit(1)).alias("received"),
        n(~F.col("duplicate")).alias("scored"),
        n(F.col("duplicate")).alias("duplicates"),
        n(F.col("out_of_order")).alias("out_of_order"),
        n(F.col("reordered")).alias("reordered_in_batch"),
        n(F.col("alert_state") == "alerting").alias("alerts"))
