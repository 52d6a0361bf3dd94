"""Baseline profile of features, plausibility warnings and drift.

Tables with one row per feature are broadcast: the caller lists the features, so they are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as C
from ..functions.columns import INF, finite, ratio
from .ordered import percentiles


def to_long(df: DataFrame, features: list[str], keep: list[str] | None = None) -> DataFrame:
    """One row per value: (feature, value)."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    return df.select(*(keep or []), F.inline(pairs))


def bin_of(interior: Column, value: Column) -> Column:
    """0-based bin: as many interior edges as are not above the value."""
    return F.size(F.filter(interior, lambda edge: edge <= value))


def baseline(df: DataFrame, features: list[str], non_negative=C.NON_NEGATIVE, margin: float = C.BOUND_MARGIN,
             bins: int = C.PSI_BINS, split_rows=None) -> DataFrame:
    """One row per feature: statistics, widened bounds, bin edges and the share of every bin."""
    long = to_long(df, features).withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    quantiles = {f"_q{i}": i / bins for i in range(bins + 1)}
    marks = percentiles(long, ["feature"], "value", {
        "p001": 0.001, "p999": 0.999, "median": 0.5, **quantiles}, split_rows)
    stats = long.groupBy("feature").agg(
        F.count("value").alias("n"), (F.count(F.lit(1)) - F.count("value")).alias("n_missing"),
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    c = F.col
    span = (c("p999") - c("p001")) * margin
    low = c("p001") - span
    clamped = c("feature").isin(*non_negative) & (low < 0) if non_negative else F.lit(False)
    edges = F.array_distinct(F.array(*quantiles))
    shaped = stats.join(F.broadcast(marks), "feature").withColumns({
        "bound_low": F.when(clamped, F.lit(0.0)).otherwise(low), "bound_high": c("p999") + span,
        "bound_low_clamped_to_zero": clamped, "psi_degenerate": F.size(edges) < 3,
        "psi_edges": F.when(F.size(edges) < 3, F.array().cast("array<double>")).otherwise(
            F.slice(edges, F.lit(2), F.size(edges) - 2))}).drop(*quantiles)
    usable = shaped.filter(~c("psi_degenerate")).select("feature", "psi_edges", c("n").alias("_n"))
    counts = long.filter(c("value").isNotNull()).join(F.broadcast(usable), "feature").groupBy("feature", "_n", bin_of(
        c("psi_edges"), c("value")).alias("bin")).agg(F.count(F.lit(1)).alias("_c"))
    shares = counts.groupBy("feature").agg(F.map_from_entries(F.collect_list(
        F.struct("bin", (c("_c") / c("_n")).alias("share")))).alias("_m"))
    size = F.size("psi_edges")
    dense = F.transform(F.sequence(F.lit(0), size), lambda i: F.coalesce(F.try_element_at(c("_m"), i), F.lit(0.0)))
    return shaped.join(F.broadcast(shares), "feature", "left").withColumn("psi_proportions", F.when(
        c("psi_degenerate"), F.array().cast("array<double>")).otherwise(dense)).drop("_m")


def warnings(df: DataFrame, profile: DataFrame, features: list[str], out: str = "input_warnings") -> DataFrame:
    """Adds the features outside their bounds, by name; nothing is rejected.

    The bounds travel as one broadcast row, so every row is checked where it is.
    """
    picks = [F.max(F.when(F.col("feature") == f, F.struct("bound_low", "bound_high", "median"))).alias(f"_b_{f}")
             for f in features]
    bounds = profile.filter(F.col("feature").isin(*features)).agg(*picks)
    checks = []
    for f in sorted(features):
        v, b = F.col(f).cast("double"), F.col(f"_b_{f}")
        odd = F.isnan(v) | (F.abs(v) == F.lit(INF))
        direction = F.when(odd, "not_finite").when(v < b["bound_low"], "below_baseline_range").when(
            v > b["bound_high"], "above_baseline_range")
        checks.append(F.when(b.isNotNull() & direction.isNotNull(), F.struct(
            F.lit(f).alias("feature"), F.when(~odd, v).alias("value"), direction.alias("direction"),
            b["bound_low"].alias("bound_low"), b["bound_high"].alias("bound_high"),
            b["median"].alias("baseline_median"))))
    joined = df.withColumn("_j", F.lit(1)).join(F.broadcast(bounds.withColumn("_j", F.lit(1))), "_j")
    return joined.withColumn(out, F.array_compact(F.array(*checks))).drop("_j", *[f"_b_{f}" for f in features])


def warning_counts(checked: DataFrame, column: str = "input_warnings") -> DataFrame:
    return checked.select(F.explode(column).alias("w")).groupBy(
        F.col("w.feature").alias("feature"), F.col("w.direction").alias("direction")).agg(
        F.count(F.lit(1)).alias("n"))


def drift(live: DataFrame, profile: DataFrame, features: list[str], least: int = C.PSI_MIN_ROWS) -> DataFrame:
    """Population stability index per feature, with the reason where there is none."""
    c = F.col
    long = to_long(live, features).withColumn("value", finite(c("value")))
    based = profile.select("feature", "psi_degenerate", "psi_edges", "psi_proportions")
    seen = long.groupBy("feature").agg(F.count("value").alias("n_live"))
    counted = long.filter(c("value").isNotNull()).join(F.broadcast(based.select("feature", "psi_edges")), "feature").groupBy(
        "feature", bin_of(c("psi_edges"), c("value")).alias("bin")).agg(F.count(F.lit(1)).alias("_c"))
    grid = based.select("feature", F.posexplode("psi_proportions").alias("bin", "base"))
    joined = grid.join(counted, ["feature", "bin"], "left").join(seen, "feature")
    now = F.greatest(F.coalesce(c("_c"), F.lit(0)) / c("n_live"), F.lit(C.PSI_FLOOR))
    was = F.greatest(c("base"), F.lit(C.PSI_FLOOR))
    psi = joined.groupBy("feature").agg(F.sum((now - was) * F.log(now / was)).alias("_psi"))
    out = seen.join(based.select("feature", "psi_degenerate"), "feature", "left").join(psi, "feature", "left")
    reason = F.when(c("psi_degenerate").isNull(), "not in the baseline").when(
        c("psi_degenerate"), "near-constant baseline").when(c("n_live") < least, "too few values")
    out = out.withColumn("skipped", reason).withColumn("psi", F.when(c("skipped").isNull(), c("_psi")))
    level = F.when(c("psi") >= C.PSI_MAJOR, "major").when(c("psi") >= C.PSI_MINOR, "minor").when(
        c("psi").isNotNull(), "none")
    return out.withColumn("severity", level).select("feature", "n_live", "psi", "severity", "skipped")


def drift_summary(report: DataFrame) -> DataFrame:
    return report.agg(F.count_if(F.col("severity") == "major").alias("n_major"),
                      F.count_if(F.col("severity") == "minor").alias("n_minor"),
                      F.count("skipped").alias("n_skipped"),
                      F.coalesce(F.bool_or(F.col("severity").isin("major", "minor")), F.lit(False)).alias("flagged"))


def recent(events: DataFrame, rows: int, event_id: str = "event_id", source: str | None = None) -> DataFrame:
    """The newest rows, optionally of one source."""
    kept = events if source is None else events.filter(F.col("source") == source)
    return kept.orderBy(F.desc(event_id)).limit(rows)
