"""Null-safe numbers, clocks and labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

INF = float("inf")


def micros(ts) -> Column:
    """Microseconds since the epoch; a zoneless timestamp is read as UTC."""
    return F.unix_micros(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))


def portable_hash(*parts) -> Column:
    """Number of 60 bits from the MD5 of the parts as text, joined by colons: the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])), 1, 15), 16, 10).cast("long")


def seconds_between(later: Column, earlier: Column) -> Column:
    """Seconds between two microsecond clocks."""
    return (later - earlier) / F.lit(1e6)


def finite(value: Column) -> Column:
    """The value, or NULL where it is NaN or infinite."""
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(INF)), value)


def nan_to_null(df: DataFrame) -> DataFrame:
    """One pass right after a scan: NaN is the missing mark of the files, NULL is ours."""
    kinds = dict(df.dtypes)
    return df.withColumns({
        c: F.when(~F.isnan(c), F.col(c)) for c, kind in kinds.items() if kind in ("double", "float")
    })


def clip(value: Column, low: float, high: float) -> Column:
    """Bounded value; a missing input stays missing (greatest/least would skip it)."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def ratio(top: Column, bottom: Column) -> Column:
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def severity(probability: Column, floor: float, ceiling: float) -> Column:
    return clip((probability - F.lit(floor)) / F.lit(max(ceiling - floor, 1e-9)), 0.0, 1.0)


def verdict(probability: Column, threshold: float) -> Column:
    return F.when(probability >= F.lit(threshold), F.lit("attack")).otherwise(F.lit("clean"))


def iso_utc(ts: Column) -> Column:
    """Fixed-width UTC text whose text order is time order."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def is_flagged(alert_state: Column, predicted: Column) -> Column:
    """Debounced state decides where there is one, otherwise the verdict."""
    return F.when(alert_state.isNotNull(), alert_state == "alerting").otherwise(
        F.coalesce(predicted == "attack", F.lit(False)))


def gate_basis(alert_state: Column) -> Column:
    return F.when(alert_state.isNotNull(), F.lit("hysteresis")).otherwise(F.lit("threshold"))


def whole_people(value: Column) -> Column:
    return F.bround(value, 0).cast("long")


def nullif_empty(value: Column) -> Column:
    return F.when(value != "", value)
