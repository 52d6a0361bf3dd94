"""As-of, interval and positional joins written as one ordered pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .ordered import Ordered


def nearest(left: DataFrame, right: DataFrame, keys: list[str], left_us: str, right_us: str,
            tolerance_s: float, columns: list[str], left_tie: list[str],
            split_rows: int | None = None, sizes: tuple[int, int] | None = None) -> DataFrame:
    """Every left row with the `columns` of the right row nearest in time, if close enough.

    Both tables are stacked in time order; each left row sees the last right row before it and
    the first one after it. A tie goes to the earlier row, the tolerance is inclusive. The right table holds
    one row per key and time.
    """
    found = F.struct(F.col(right_us).alias("at"), *columns)
    blank = [F.lit(None).cast(dict(left.dtypes)[c]).alias(f"_tie{i}") for i, c in enumerate(left_tie)]
    ties = [F.col(c).alias(f"_tie{i}") for i, c in enumerate(left_tie)]
    spine = left.select(*keys, F.col(left_us).alias("_t"), F.lit(1).alias("_side"), *ties,
                        F.struct(*left.columns).alias("_left"))
    points = right.select(*keys, F.col(right_us).alias("_t"), F.lit(0).alias("_side"), *blank,
                          found.alias("_right"))
    both = spine.unionByName(points, allowMissingColumns=True)
    order = ["_t", "_side", *[f"_tie{i}" for i in range(len(left_tie))]]
    seq = Ordered(both, keys, order, split_rows, sizes)
    seq.running(_before=("last", F.col("_right")))
    seq.running(reverse=True, _after=("last", F.col("_right")))
    gap_before = F.col("_t") - F.col("_before.at")
    gap_after = F.col("_after.at") - F.col("_t")
    pick = F.when(F.col("_after").isNull() | (gap_before <= gap_after), F.col("_before")).otherwise(F.col("_after"))
    hits = seq.df.filter("_side = 1").withColumn("_hit", pick)
    near = F.abs(F.col("_t") - F.col("_hit.at")) <= F.lit(int(tolerance_s * 1_000_000))
    return hits.select("_left.*", *[F.when(near, F.col(f"_hit.{c}")).alias(c) for c in columns])


def covered(points: DataFrame, intervals: DataFrame, keys: list[str], time_us: str, start_us: str,
            end_us: str, label: str = "attack", split_rows: int | None = None) -> DataFrame:
    """Label points that lie in any closed interval of their key, in one sweep.

    Interval starts count +1 before the points of the same instant and ends -1 after them, so no
    point has to meet every interval of its key. Points of one instant share their label.
    """
    instants = points.select(*keys, time_us).distinct()
    marks = (instants.select(*keys, F.col(time_us).alias("_t"), F.lit(1).alias("_side"), F.lit(0).alias("_step"))
             .unionByName(intervals.groupBy(*keys, F.col(start_us).alias("_t"))
                          .agg(F.count(F.lit(1)).cast("int").alias("_step")).withColumn("_side", F.lit(0)))
             .unionByName(intervals.groupBy(*keys, F.col(end_us).alias("_t"))
                          .agg((-F.count(F.lit(1))).cast("int").alias("_step")).withColumn("_side", F.lit(2))))
    seq = Ordered(marks, keys, ["_t", "_side"], split_rows).running(_open=("sum", F.col("_step")))
    labelled = seq.df.filter("_side = 1").select(
        *keys, F.col("_t").alias(time_us), (F.col("_open") > 0).cast("int").alias(label))
    return points.join(labelled, [*keys, time_us], "left")


def paired_windows(log: DataFrame, keys: list[str], order: list[str], event: str, time: str,
                   split_rows: int | None = None) -> DataFrame:
    """Closed windows from a start/end log: an end closes the start right before it.

    A later start replaces a pending one; an end without a pending start is ignored.
    """
    text = F.lower(event)
    kind = F.when(F.contains(text, F.lit("start")), "start").when(F.contains(text, F.lit("end")), "end")
    marked = log.withColumn("_kind", kind).filter(F.col("_kind").isNotNull())
    seq = Ordered(marked, keys, order, split_rows).within(
        1, _prev=lambda w: F.lag("_kind").over(w), window_start=lambda w: F.lag(time).over(w))
    closed = seq.df.filter("_kind = 'end' AND _prev = 'start'")
    return closed.select(*keys, "window_start", F.col(time).alias("window_end"))


def window_facts(points: DataFrame, windows: DataFrame, keys: list[str], time: str) -> DataFrame:
    """Per key: how many windows there are and whether one starts within the recorded time."""
    spans = points.groupBy(*keys).agg(F.min(time).alias("_from"), F.max(time).alias("_to"))
    inside = F.col("window_start").between(F.col("_from"), F.col("_to"))
    return (spans.join(windows, keys, "left").groupBy(*keys).agg(
        F.count("window_start").alias("n_attack_windows"),
        F.coalesce(F.bool_or(inside), F.lit(False)).alias("window_start_in_range")))


def positional(left: DataFrame, right: DataFrame, keys: list[str], left_order: list[str],
               right_order: list[str], columns: list[str], split_rows: int | None = None) -> DataFrame:
    """Join rows of equal keys by their position inside the key, where keys repeat.

    Rows without a partner stay with `matched` false, so a mismatch can be asserted on.
    """
    a = Ordered(left, keys, left_order, split_rows).number("_pos").df
    b = Ordered(right, keys, right_order, split_rows).number("_pos").df
    b = b.select(*keys, "_pos", *columns).withColumn("_b", F.lit(True))
    out = a.withColumn("_a", F.lit(True)).join(b, [*keys, "_pos"], "full_outer")
    matched = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return out.withColumn("matched", matched).drop("_a", "_b", "_pos")


def boundary_distance(df: DataFrame, keys: list[str], time_us: str, label: str, tie: list[str],
                      split_rows: int | None = None) -> DataFrame:
    """Seconds since the start of the key and to the nearest label change.

    A change is dated by the last row before it. Without any change the distance is NULL.
    """
    seq = Ordered(df, keys, [time_us, *tie], split_rows)
    seq.within(1, _prev=lambda w: F.lag(label).over(w), _prev_us=lambda w: F.lag(time_us).over(w))
    seq.map(lambda d: d.withColumn("_change", F.when(F.col("_prev") != F.col(label), F.col("_prev_us"))))
    seq.running(_past=("last", F.col("_change")), _first=("min", F.col(time_us)))
    seq.running(exclusive=True, reverse=True, _coming=("last", F.col("_change")))
    gap = F.least(F.col(time_us) - F.col("_past"), F.col("_coming") - F.col(time_us))
    out = seq.df.withColumns({"elapsed_s": (F.col(time_us) - F.col("_first")) / 1e6, "boundary_s": gap / 1e6})
    return out.drop("_prev", "_prev_us", "_change", "_past", "_first", "_coming")
