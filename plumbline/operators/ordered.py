"""Ordered per-key computations that hold when one key owns a large share of all rows.

A plain window sends every row of a key to one task. `Ordered` measures the largest key first
(one aggregate over the key columns). Below the limit it is a plain window. Above it, rows are
range-partitioned on (key, order), so that a large key spreads over many partitions; the
partition number is kept as the chunk and the rows are checkpointed. After that

* `within`  looks back a fixed number of rows: every chunk borrows that many rows from the
  chunks before it;
* `running` accumulates from the first row of the key: chunk totals are summed over the chunks
  before, and only keys that cross a chunk border need them. Range partitions are contiguous, so
  there are at most two such (key, chunk) pairs per partition and the table is safe to broadcast.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import broadcast_rows, cut, split_rows as conf_split_rows

CHUNK = "_seq_at"


def group_sizes(df: DataFrame, keys: list[str]) -> tuple[int, int]:
    """(rows in the largest group, rows in total), from map-side counts."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    row = counts.agg(F.max("n").alias("top"), F.sum("n").alias("total")).first()
    return int(row["top"] or 0), int(row["total"] or 0)


def measure(df: DataFrame, *key_sets: list[str]) -> list[tuple[int, int]]:
    """`group_sizes` for several keys from one scan."""
    columns = sorted({k for keys in key_sets for k in keys})
    counts = df.groupingSets(key_sets, *columns).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    found = {r["g"]: (int(r["top"]), int(r["total"])) for r in counts.groupBy("g").agg(
        F.max("n").alias("top"), F.sum("n").alias("total")).collect()}
    last = len(columns) - 1
    ids = [sum(1 << (last - i) for i, c in enumerate(columns) if c not in keys) for keys in key_sets]
    return [found.get(g, (0, 0)) for g in ids]


def same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    tests = [left[k].eqNullSafe(right[f"_seq_k_{k}"]) for k in keys]
    return reduce(lambda a, b: a & b, tests, left[CHUNK] == right["_seq_chunk"])


class Ordered:
    """Rows with a total order per key; `order` columns ascend, are not NULL and unique per key."""

    def __init__(self, df: DataFrame, keys: list[str], order: list[str],
                 split_rows: int | None = None, sizes: tuple[int, int] | None = None):
        self.keys, self.order = list(keys), list(order)
        self._rows = df
        self._limit = split_rows or conf_split_rows(df.sparkSession)
        self._spans = None
        self._pending = False
        # `sizes` spares the measurement where a bound is known, such as that of a superset.
        top, total = sizes or group_sizes(df, self.keys)
        if top > self._limit:
            self._split(total)

    @property
    def is_split(self) -> bool:
        return self._spans is not None

    @property
    def df(self) -> DataFrame:
        return self._rows.drop(CHUNK)

    def map(self, step: Callable[[DataFrame], DataFrame]) -> "Ordered":
        """Apply a row-wise step; it must keep the key and order columns and the row set."""
        self._rows = step(self._rows)
        return self

    def within(self, before: int, **columns: Callable) -> "Ordered":
        """Add columns that depend on at most `before` rows before the current one.

        Each value takes the window (no frame set) and returns a column.
        """
        if not self.is_split:
            w = Window.partitionBy(*self.keys).orderBy(*self.order)
            self._rows = self._rows.withColumns({n: f(w) for n, f in columns.items()})
            return self
        self._settle()
        w = Window.partitionBy(*self.keys, CHUNK).orderBy(*self.order)
        rows = self._rows.withColumn("_seq_lent", F.lit(False))
        lent = self._tails(before).withColumn("_seq_lent", F.lit(True))
        both = rows.unionByName(lent)
        self._rows = (both.withColumns({n: f(w) for n, f in columns.items()})
                      .filter(~F.col("_seq_lent")).drop("_seq_lent"))
        self._pending = True
        return self

    def running(self, exclusive: bool = False, reverse: bool = False,
                **columns: tuple[str, Column]) -> "Ordered":
        """Add accumulations from the first row of the key (from its last row if `reverse`).

        Each value is (how, expression) with how one of sum, max, min, last; `last` is the
        nearest non-NULL value met so far. `exclusive` leaves out the current row.
        """
        end = -1 if exclusive else 0
        if not self.is_split:
            w = Window.partitionBy(*self.keys).orderBy(*self._sorting(self.order, reverse))
            frame = w.rowsBetween(Window.unboundedPreceding, end)
            self._rows = self._rows.withColumns(
                {n: _accumulate(how, e).over(frame) for n, (how, e) in columns.items()})
            return self
        self._settle()
        w = (Window.partitionBy(*self.keys, CHUNK).orderBy(*self._sorting(self.order, reverse))
             .rowsBetween(Window.unboundedPreceding, end))
        carry = self._carry(columns, reverse)
        local = self._rows.withColumns(
            {f"_seq_l_{n}": _accumulate(how, e).over(w) for n, (how, e) in columns.items()})
        joined = local.join(F.broadcast(carry), same_keys(local, carry, self.keys), "left")
        out = joined.withColumns({n: _combine(how, F.col(f"_seq_l_{n}"), F.col(f"_seq_c_{n}"))
                                  for n, (how, _) in columns.items()})
        self._rows = out.select(*self._rows.columns, *columns)
        self._pending = True
        return self

    def number(self, name: str) -> "Ordered":
        """Add the 1-based position within the key."""
        return self.running(**{name: ("sum", F.lit(1).cast("long"))})

    # -- split mode ---------------------------------------------------------------------------

    def _split(self, total: int) -> None:
        spark = self._rows.sparkSession
        parts = max(ceil(2 * total / self._limit), int(spark.conf.get("spark.sql.shuffle.partitions")))
        ranged = self._rows.repartitionByRange(parts, *self.keys, *self.order)
        self._rows = cut(ranged.withColumn(CHUNK, F.spark_partition_id()))
        per_key = Window.partitionBy(*self.keys)
        sizes = (self._rows.groupBy(*self.keys, CHUNK).agg(F.count(F.lit(1)).alias("_seq_n"))
                 .withColumn("_seq_parts", F.count(F.lit(1)).over(per_key)).filter("_seq_parts > 1"))
        before = per_key.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
        self._spans = cut(sizes.withColumn("_seq_start", F.coalesce(F.sum("_seq_n").over(before), F.lit(0)))
                          .select(*[F.col(k).alias(f"_seq_k_{k}") for k in self.keys],
                                  F.col(CHUNK).alias("_seq_chunk"), "_seq_n", "_seq_start"))

    def _settle(self) -> None:
        """Keep the cost of a chain linear: each step reads its input twice."""
        if self._pending:
            self._rows = cut(self._rows)
            self._pending = False

    def _sorting(self, columns: list[str], reverse: bool) -> list[Column]:
        return [F.desc(c) if reverse else F.asc(c) for c in columns]

    def _tails(self, before: int) -> DataFrame:
        """Last rows of every chunk, addressed to the later chunks that look back on them."""
        later = (Window.partitionBy(*[f"_seq_k_{k}" for k in self.keys]).orderBy("_seq_chunk")
                 .rowsBetween(1, before))
        reach = self._spans.withColumn("_seq_next", F.collect_list(F.struct("_seq_chunk", "_seq_start")).over(later))
        w = Window.partitionBy(*self.keys, CHUNK).orderBy(*self._sorting(self.order, True))
        last = self._rows.withColumn("_seq_r", F.row_number().over(w)).filter(F.col("_seq_r") <= before)
        placed = last.join(F.broadcast(reach), same_keys(last, reach, self.keys))
        position = F.col("_seq_start") + F.col("_seq_n") - F.col("_seq_r")
        near = F.filter("_seq_next", lambda c: c["_seq_start"] - position <= before)
        sent = placed.withColumn("_seq_to", F.explode(near))
        kept = [c for c in self._rows.columns if c != CHUNK]
        return sent.select(*kept, F.col("_seq_to._seq_chunk").alias(CHUNK))

    def _carry(self, columns: dict, reverse: bool) -> DataFrame:
        rows = self._rows
        crossing = rows.join(F.broadcast(self._spans), same_keys(rows, self._spans, self.keys), "left_semi")
        place = F.struct(*self.order)
        totals = crossing.groupBy(*self.keys, CHUNK).agg(
            *[_total(how, e, place, reverse).alias(f"_seq_t_{n}") for n, (how, e) in columns.items()])
        w = (Window.partitionBy(*self.keys).orderBy(*self._sorting([CHUNK], reverse))
             .rowsBetween(Window.unboundedPreceding, -1))
        summed = totals.withColumns({f"_seq_c_{n}": _accumulate(how, F.col(f"_seq_t_{n}")).over(w)
                                     for n, (how, _) in columns.items()})
        return summed.select(*[F.col(k).alias(f"_seq_k_{k}") for k in self.keys],
                             F.col(CHUNK).alias("_seq_chunk"), *[f"_seq_c_{n}" for n in columns])


def _accumulate(how: str, value: Column) -> Column:
    if how == "last":
        return F.last(value, ignorenulls=True)
    return {"sum": F.sum, "max": F.max, "min": F.min}[how](value)


def _total(how: str, value: Column, place: Column, reverse: bool) -> Column:
    if how != "last":
        return _accumulate(how, value)
    pick = F.min_by if reverse else F.max_by
    return pick(value, F.when(value.isNotNull(), place))


def _combine(how: str, local: Column, carried: Column) -> Column:
    if how == "sum":
        return F.coalesce(local + carried, local, carried)
    if how == "last":
        return F.coalesce(local, carried)
    return F.greatest(local, carried) if how == "max" else F.least(local, carried)


def percentiles(df: DataFrame, keys: list[str], value: str, wanted: dict[str, float],
                split_rows: int | None = None, sizes: tuple[int, int] | None = None) -> DataFrame:
    """Exact percentiles with linear interpolation, per key; NULL for a key without values.

    The built-in aggregate keeps all distinct values of a group in one buffer, so it is used only
    while the largest group is small. Otherwise distinct values are counted first and their
    cumulative counts locate the two neighbours of every requested rank.
    """
    limit = split_rows or conf_split_rows(df.sparkSession)
    narrow = df.select(*keys, value)
    if (sizes or group_sizes(narrow, keys))[0] <= limit:
        picks = [F.percentile(value, F.lit(q)).alias(n) for n, q in wanted.items()]
        return narrow.groupBy(*keys).agg(*picks)
    if not keys:
        one = percentiles(narrow.withColumn("_all", F.lit(1)), ["_all"], value, wanted, limit, sizes)
        return one.drop("_all")
    counted = (narrow.filter(F.col(value).isNotNull()).groupBy(*keys, value)
               .agg(F.count(F.lit(1)).alias("_c")))
    cumulative = Ordered(counted, keys, [value], limit).running(_upto=("sum", F.col("_c"))).df
    sizes = narrow.groupBy(*keys).agg(F.count(value).alias("_total"))
    named = sizes.select(*[F.col(k).alias(f"_seq_k_{k}") for k in keys], "_total")
    ranked = cumulative.join(named, _match(cumulative, named, keys))
    picks = []
    for n, q in wanted.items():
        rank = F.lit(q) * (F.col("_total") - 1)
        low, high = [F.max(F.when((F.col("_upto") - F.col("_c") <= r) & (r < F.col("_upto")), F.col(value)))
                     for r in (F.floor(rank), F.ceil(rank))]
        picks.append((low + (high - low) * F.max(rank - F.floor(rank))).alias(n))
    found = ranked.groupBy(*[F.col(f"_seq_k_{k}") for k in keys]).agg(*picks)
    return sizes.join(found, _match(sizes, found, keys), "left").select(*keys, *wanted)


def _match(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[f"_seq_k_{k}"]) for k in keys])


def percentile_columns(df: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]],
                       split_rows: int | None = None, sizes: tuple[int, int] | None = None) -> DataFrame:
    """Exact percentiles of several columns: {output: (column, fraction)}, one row per key."""
    limit = split_rows or conf_split_rows(df.sparkSession)
    sizes = sizes or group_sizes(df.select(*keys), keys)
    if sizes[0] <= limit:
        picks = [F.percentile(c, F.lit(q)).alias(n) for n, (c, q) in wanted.items()]
        return df.groupBy(*keys).agg(*picks)
    columns: dict[str, dict[str, float]] = {}
    for n, (c, q) in wanted.items():
        columns.setdefault(c, {})[n] = q
    parts = [percentiles(df.withColumn("_one", F.lit(1)), keys or ["_one"], c, qs, limit, sizes)
             for c, qs in columns.items()]
    out = parts[0]
    for part in parts[1:]:
        renamed = part.select(*[F.col(k).alias(f"_seq_k_{k}") for k in keys or ["_one"]],
                              *[c for c in part.columns if c in wanted])
        out = out.join(renamed, _match(out, renamed, keys or ["_one"])).drop(
            *[f"_seq_k_{k}" for k in keys or ["_one"]])
    return out.drop("_one")


def sized(df: DataFrame) -> DataFrame:
    """Broadcast hint for a table whose row count was checked; a larger one is left to shuffle.

    Meant for tables that are cheap to count; a derived one goes through `settled` first.
    """
    limit = broadcast_rows(df.sparkSession)
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def settled(df: DataFrame) -> DataFrame:
    """A small derived table, computed once, with the hint of `sized`."""
    return sized(cut(df))
