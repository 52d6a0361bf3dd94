"""Signal-consistency features of receiver recordings.

Inputs are DataFrames of all recordings at once. `time_us` is a microsecond clock and `src_idx`
the position of the row in its file, which settles the order of equal times.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as C
from ..functions.columns import INF
from ..functions.geo import offset_metres
from ..session import split_rows as conf_split_rows
from .ordered import Ordered, measure, percentile_columns, percentiles, settled


@dataclass(frozen=True)
class Limits:
    """Cut-offs of the satellite features; the defaults are those of a 5 Hz receiver."""

    max_gap_s: float = C.RESIDUAL_MAX_GAP_S
    code_residual: float = C.CODE_RESIDUAL_MAX
    carrier_residual: float = C.CARRIER_RESIDUAL_MAX
    cmc_step: float = C.CMC_STEP_MAX
    carrier_sanity: float = C.CARRIER_SANITY_HZ
    arc_gap_s: float = C.ARC_GAP_S
    slip_cycles: float = C.ARC_SLIP_CYCLES
    trailing: int = C.TRAILING_ROWS


@dataclass(frozen=True)
class Sizes:
    """Largest groups of the satellite rows, from one scan of their keys."""

    track: tuple[int, int]
    run: tuple[int, int]
    epoch: tuple[int, int]

    @classmethod
    def of(cls, sat: DataFrame) -> "Sizes":
        return cls(*measure(sat, TRACK, ["run_id"], EPOCH))


TRACK, EPOCH = ["run_id", "satellite"], ["run_id", "time_us"]
# Epochs up to this many rows are ranked inside one aggregate.
LIST_ROWS = 10_000


def _lag(column: str, rows: int = 1):
    return lambda w: F.lag(column, rows).over(w)


def _valid_cn0(column: str) -> Column:
    low, high = C.CN0_RANGE
    return F.when(F.col(column).between(low, high), F.col(column))


def clock_drift(nav: DataFrame, keys=("run_id",), split_rows=None) -> DataFrame:
    """Receiver clock step minus logging clock step, in seconds."""
    seq = Ordered(nav, list(keys), ["time_us", "src_idx"], split_rows)
    seq.within(1, _itow=_lag("iTOW"), _us=_lag("time_us"))
    step = (F.col("iTOW") - F.col("_itow")) / 1000.0 - (F.col("time_us") - F.col("_us")) / 1e6
    return seq.df.withColumn("clock_drift_proxy_s", step).drop("_itow", "_us")


def reference_fix(nav: DataFrame, first_s: float = C.REFERENCE_FIX_S, split_rows=None) -> DataFrame:
    """Median position of every recording over its first seconds."""
    start = nav.groupBy("run_id").agg(F.min("time_us").alias("_start"))
    early = nav.join(start, "run_id").filter(F.col("time_us") < F.col("_start") + int(first_s * 1e6))
    return percentile_columns(early, ["run_id"], {
        "ref_lat": ("lat", 0.5), "ref_lon": ("lon", 0.5), "ref_height": ("height", 0.5)}, split_rows)


def position_deviation(nav: DataFrame, first_s: float = C.REFERENCE_FIX_S, split_rows=None) -> DataFrame:
    fixes = settled(reference_fix(nav, first_s, split_rows))
    c = F.col
    dev = offset_metres(c("lat"), c("lon"), c("height"), c("ref_lat"), c("ref_lon"), c("ref_height"))
    return nav.join(fixes, "run_id", "left").withColumn("pos_dev_m", dev).drop("ref_lat", "ref_lon", "ref_height")


def _steps(sat: DataFrame, columns: list[str], split_rows, sizes: Sizes | None) -> DataFrame:
    """Satellite rows with the previous epoch's values and the time since then."""
    seq = Ordered(sat, TRACK, ["time_us", "src_idx"], split_rows, sizes and sizes.track)
    seq.within(1, _us=_lag("time_us"), **{f"_p_{c}": _lag(c) for c in columns})
    return seq.df.withColumn("dt", (F.col("time_us") - F.col("_us")) / 1e6)


def code_residuals(sat: DataFrame, limits: Limits = Limits(), split_rows=None) -> DataFrame:
    """Pseudorange rate against the rate the Doppler shift implies, per satellite."""
    rows = _steps(sat, ["pseudorange"], split_rows, None)
    rate = F.try_divide(F.col("pseudorange") - F.col("_p_pseudorange"), F.col("dt"))
    raw = rate + F.col("doppler") * F.lit(C.L1_WAVELENGTH_M)
    bad = (F.col("dt") <= 0) | (F.col("dt") > limits.max_gap_s) | (F.abs("_raw") > limits.code_residual)
    return (rows.withColumn("_raw", raw)
            .withColumns({"pr_doppler_residual": F.when(~bad, F.col("_raw")), "snr": _valid_cn0("snr")})
            .drop("_us", "_raw", "_p_pseudorange", "dt"))


def code_epochs(residuals: DataFrame) -> DataFrame:
    return residuals.groupBy("run_id", "time_us").agg(
        F.count("satellite").alias("n_sats_l1"),
        F.avg("snr").alias("snr_l1_mean"), F.stddev_samp("snr").alias("snr_l1_std"),
        F.min("snr").alias("snr_l1_min"),
        F.avg("doppler").alias("doppler_l1_mean"), F.stddev_samp("doppler").alias("doppler_l1_std"),
        F.avg("pr_doppler_residual").alias("pr_doppler_residual_mean"),
        F.stddev_samp("pr_doppler_residual").alias("pr_doppler_residual_std"))


def rf_epochs(rf: DataFrame) -> DataFrame:
    """Monitor means per instant, first antenna only."""
    return rf.groupBy("run_id", "time_us").agg(
        F.avg("jamInd_01").alias("jam_ind_mean"), F.avg("agcCnt_01").alias("agc_cnt_mean"),
        F.avg("noisePerMS_01").alias("noise_per_ms_mean"))


def trusted_runs(rows: DataFrame, residual: str, limits: Limits, split_rows, sizes: Sizes) -> DataFrame:
    """Recordings with `trusted`: the median absolute carrier residual is finite and small."""
    absolute = rows.select("run_id", F.abs(residual).alias("_abs"))
    median = percentiles(absolute, ["run_id"], "_abs", {"_median": 0.5}, split_rows, sizes.run)
    return settled(median.select("run_id", F.coalesce(F.col("_median") <= limits.carrier_sanity, F.lit(False)).alias("trusted")))


def _carrier_rows(sat: DataFrame, limits: Limits, split_rows, sizes: Sizes) -> DataFrame:
    rows = _steps(sat.withColumn("cmc", F.col("pseudorange") - F.lit(C.L1_WAVELENGTH_M) * F.col("carrier")),
                  ["carrier", "cmc"], split_rows, sizes)
    close = (F.col("dt") > 0) & (F.col("dt") <= limits.max_gap_s)
    resid = F.try_divide(F.col("carrier") - F.col("_p_carrier"), F.col("dt")) + F.col("doppler")
    rows = rows.withColumns({"_resid": F.when(close, resid),
                             "_step": F.when(close, F.abs(F.col("cmc") - F.col("_p_cmc")))})
    return rows.withColumns({
        "cp_doppler_resid": F.when(F.abs("_resid") <= limits.carrier_residual, F.col("_resid")),
        "cmc_l1_step": F.when(F.col("_step") <= limits.cmc_step, F.col("_step"))}).drop(
        "_us", "dt", "_p_carrier", "_p_cmc", "_resid", "_step")


def carrier_steps(sat: DataFrame, limits: Limits = Limits(), split_rows=None) -> DataFrame:
    """Carrier-rate residual and code-minus-carrier step per satellite, blanked where implausible."""
    sizes = Sizes.of(sat)
    rows = _carrier_rows(sat, limits, split_rows, sizes)
    out = rows.join(trusted_runs(rows, "cp_doppler_resid", limits, split_rows, sizes), "run_id")
    return out.withColumns({c: F.when(F.col("trusted"), F.col(c)) for c in ("cp_doppler_resid", "cmc_l1_step")})


def _median_deviation(rows: DataFrame, split_rows, sizes: Sizes) -> DataFrame:
    """Median distance from the epoch median, where epochs are too large for a list."""
    medians = percentiles(rows, EPOCH, "doppler", {"_mid": 0.5}, split_rows, sizes.epoch)
    away = rows.join(medians, EPOCH).withColumn("_away", F.abs(F.col("doppler") - F.col("_mid")))
    return percentiles(away, EPOCH, "_away", {"sp_doppler_l1_mad": 0.5}, split_rows, sizes.epoch)


def _list_median(values: Column) -> Column:
    ordered = F.array_sort(values)
    n = F.size(ordered)
    low, high = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
    return F.when(n > 0, (F.get(ordered, low) + F.get(ordered, high)) / 2)


def spoofing_epochs(sat: DataFrame, limits: Limits = Limits(), split_rows=None) -> DataFrame:
    """Ten consistency features per epoch.

    Distrust of a recording blanks whole columns, so it is applied to the epochs, not to the rows.
    """
    sizes = Sizes.of(sat)
    raw = sat.withColumns({"snr": _valid_cn0("snr"), "snr_l2": _valid_cn0("snr_l2")})
    rows = _carrier_rows(raw, limits, split_rows, sizes).withColumns({
        "_l2": F.col("pseudorange_l2").isNotNull().cast("double"),
        "_cn0_gap": F.col("snr") - F.col("snr_l2"),
        "_weak": (F.col("snr") < C.WEAK_CN0).cast("double")})
    listed = sizes.epoch[0] <= min(LIST_ROWS, split_rows or conf_split_rows(sat.sparkSession))
    main = rows.groupBy(*EPOCH).agg(
        F.stddev_samp("cp_doppler_resid").alias("sp_cp_doppler_resid_std"),
        F.max(F.abs("cp_doppler_resid")).alias("sp_cp_doppler_resid_maxabs"),
        F.stddev_samp("cmc_l1_step").alias("sp_cmc_l1_step_std"),
        F.max("cmc_l1_step").alias("sp_cmc_l1_step_maxabs"),
        F.avg("_l2").alias("sp_frac_l2_tracked"),
        F.avg("_cn0_gap").alias("sp_cn0_l1_minus_l2_mean"),
        F.avg("_weak").alias("sp_frac_low_cn0"),
        *([F.collect_list("doppler").alias("_dopplers")] if listed else []))
    if listed:
        main = main.withColumn("_mid", _list_median(F.col("_dopplers"))).withColumn(
            "sp_doppler_l1_mad", _list_median(F.transform("_dopplers", lambda d: F.abs(d - F.col("_mid"))))).drop(
            "_dopplers", "_mid")
    else:
        main = main.join(_median_deviation(raw.select(*EPOCH, "doppler"), split_rows, sizes), EPOCH)
    per_const = raw.groupBy(*EPOCH, F.substring("satellite", 1, 1).alias("constellation")).agg(F.avg("snr").alias("_mean"))
    spread = per_const.groupBy(*EPOCH).agg(
        F.count("constellation").alias("sp_n_const"),
        F.when(F.count("_mean") >= 2, F.max("_mean") - F.min("_mean")).alias("sp_xconst_cn0_spread"))
    out = main.join(spread, EPOCH).join(trusted_runs(rows, "cp_doppler_resid", limits, split_rows, sizes), "run_id")
    doubtful = [c for c in main.columns if c.startswith(("sp_cp_", "sp_cmc_"))]
    return out.withColumns({c: F.when(F.col("trusted"), F.col(c)) for c in doubtful}).drop("trusted")


def _arc_rows(sat: DataFrame, limits: Limits, split_rows, sizes: Sizes) -> DataFrame:
    kept = sat.na.drop(subset=["time_us", "satellite", "pseudorange", "carrier", "doppler"])
    seq = Ordered(kept, TRACK, ["time_us", "src_idx"], split_rows, sizes.track)
    seq.within(2, _us=_lag("time_us"), _p_carrier=_lag("carrier"),
               _d1=_lag("doppler"), _d2=_lag("doppler", 2))
    seq.map(lambda d: d.withColumn("dt", (F.col("time_us") - F.col("_us")) / 1e6))
    resid = F.try_divide(F.col("carrier") - F.col("_p_carrier"), F.col("dt")) + F.col("doppler")
    seq.map(lambda d: d.withColumns({
        "_resid": resid, "cmc": F.col("pseudorange") - F.lit(C.L1_WAVELENGTH_M) * F.col("carrier")}))
    slip = F.col("dt").isNull() | (F.col("dt") > limits.arc_gap_s) | F.coalesce(
        F.abs("_resid") * F.col("dt") > limits.slip_cycles, F.lit(False))
    seq.map(lambda d: d.withColumn("slip", slip.cast("int")))
    seq.running(arc=("sum", F.col("slip")), _n=("sum", F.lit(1).cast("long")))
    seq.running(_from=("last", F.when(F.col("slip") == 1, F.col("_n"))))
    seq.map(lambda d: d.withColumn("p", F.col("_n") - F.col("_from")))
    bend = F.col("doppler") - 2 * F.col("_d1") + F.col("_d2")
    seq.map(lambda d: d.withColumn("_bend", F.when(F.col("p") >= 2, bend)))
    rows = limits.trailing
    seq.within(
        rows - 1,
        _slope=lambda w: F.abs(F.regr_slope(F.col("cmc"), F.col("p").cast("double")).over(w.rowsBetween(1 - rows, 0))),
        _curv=lambda w: F.stddev_samp("_bend").over(w.rowsBetween(1 - rows, 0)))
    return seq.df.withColumns({
        "cmc_slope_abs": F.when(F.col("p") >= rows - 1, F.col("_slope")),
        "dop_curv": F.when(F.col("p") >= rows + 1, F.col("_curv"))}).drop(
        "_us", "_p_carrier", "_d1", "_d2", "_n", "_from", "_bend", "_slope", "_curv")


def _trusted_arcs(sat: DataFrame, limits: Limits, split_rows, sizes: Sizes) -> DataFrame:
    """The arc test looks at the residual before it is blanked, so its own trust differs from that of the carrier steps."""
    kept = sat.na.drop(subset=["time_us", "satellite", "pseudorange", "carrier", "doppler"])
    rows = _steps(kept, ["carrier"], split_rows, sizes)
    step = F.col("carrier") - F.col("_p_carrier")
    # Two rows of one instant with different phases have an infinite rate, which counts in this median.
    rate = F.when(F.col("dt") == 0, F.when(step != 0, F.lit(INF))).otherwise(F.try_divide(step, F.col("dt")))
    raw = rate + F.col("doppler")
    return trusted_runs(rows.select("run_id", raw.alias("_raw")), "_raw", limits, split_rows, sizes)


def arcs(sat: DataFrame, limits: Limits = Limits(), split_rows=None) -> DataFrame:
    """Continuous tracking arcs per satellite: a gap or a cycle slip opens a new one.

    Adds arc number, position in the arc, trailing code-minus-carrier slope (per row) and the
    trailing spread of the Doppler second difference. The two wait until their window fits the arc.
    """
    sizes = Sizes.of(sat)
    out = _arc_rows(sat, limits, split_rows, sizes).drop("_resid").join(
        _trusted_arcs(sat, limits, split_rows, sizes), "run_id")
    return out.withColumn("cmc_slope_abs", F.when(F.col("trusted"), F.col("cmc_slope_abs")))


def temporal_epochs(sat: DataFrame, limits: Limits = Limits(), split_rows=None) -> DataFrame:
    """Five arc features per epoch; the high share counts rows without a slope in its base."""
    sizes = Sizes.of(sat)
    rows = _arc_rows(sat, limits, split_rows, sizes)
    plain = [
        F.max("cmc_slope_abs").alias("sp_cmc_slope_max"),
        F.when(F.count("cmc_slope_abs") > 0,
               F.count_if(F.col("cmc_slope_abs") > C.SLOPE_HIGH) / F.count(F.lit(1))).alias("sp_cmc_slope_frac_hi"),
        F.max("dop_curv").alias("sp_dop_smooth_max")]
    mids = {"sp_cmc_slope_p50": ("cmc_slope_abs", 0.5), "sp_dop_smooth_p50": ("dop_curv", 0.5)}
    if sizes.epoch[0] <= (split_rows or conf_split_rows(sat.sparkSession)):
        epochs = rows.groupBy(*EPOCH).agg(*plain, *[F.percentile(c, F.lit(q)).alias(n) for n, (c, q) in mids.items()])
    else:
        epochs = rows.groupBy(*EPOCH).agg(*plain).join(
            percentile_columns(rows, EPOCH, mids, split_rows, sizes.epoch), EPOCH)
    out = epochs.join(_trusted_arcs(sat, limits, split_rows, sizes), "run_id")
    doubtful = [c for c in epochs.columns if c.startswith("sp_cmc_")]
    return out.withColumns({c: F.when(F.col("trusted"), F.col(c)) for c in doubtful}).drop("trusted")


def causal_spread(df: DataFrame, keys: list[str], order: list[str], value: str, out: str,
                  rows: int = 30, least: int = 15, split_rows=None) -> DataFrame:
    """Sample deviation of the previous rows, the current one left out."""
    return Ordered(df, keys, order, split_rows).within(rows, **{out: lambda w: F.when(
        F.count(value).over(w.rowsBetween(-rows, -1)) >= least,
        F.stddev_samp(value).over(w.rowsBetween(-rows, -1)))}).df


def causal_deviation(df: DataFrame, keys: list[str], order: list[str], value: str, out: str,
                     rows: int = 60, least: int = 30, split_rows=None) -> DataFrame:
    """Distance from the median of the previous rows, the current one left out."""
    return Ordered(df, keys, order, split_rows).within(rows, **{out: lambda w: F.when(
        F.count(value).over(w.rowsBetween(-rows, -1)) >= least,
        F.col(value) - F.percentile(value, F.lit(0.5)).over(w.rowsBetween(-rows, -1)))}).df


def session_deviation(df: DataFrame, keys: list[str], value: str, out: str, split_rows=None) -> DataFrame:
    """Distance from the median of the whole recording."""
    mids = percentiles(df, keys, value, {"_mid": 0.5}, split_rows)
    return df.join(settled(mids), keys).withColumn(out, F.col(value) - F.col("_mid")).drop("_mid")


def gap_runs(df: DataFrame, keys: list[str], time_us: str, tie: list[str], gap_s: float,
             out: str = "run", split_rows=None) -> DataFrame:
    """Number the runs of a key that are separated by more than `gap_s` seconds."""
    seq = Ordered(df, keys, [time_us, *tie], split_rows).within(1, _us=_lag(time_us))
    opens = F.when(F.col("_us").isNull() | ((F.col(time_us) - F.col("_us")) / 1e6 > gap_s), 1).otherwise(0)
    seq.map(lambda d: d.withColumn("_open", opens)).running(**{out: ("sum", F.col("_open"))})
    return seq.df.drop("_us", "_open")


def run_lengths(runs: DataFrame, keys: list[str], run: str = "run", cuts=(10, 20, 30, 50),
                split_rows=None) -> DataFrame:
    """Length statistics of tracking runs and the share of runs and rows that are long."""
    lengths = runs.groupBy(*keys, run).agg(F.count(F.lit(1)).alias("len"))
    shares = [c for k in cuts for c in (
        (F.count_if(F.col("len") >= k) / F.count(F.lit(1))).alias(f"runs_ge_{k}"),
        (F.sum(F.when(F.col("len") >= k, F.col("len")).otherwise(0)) / F.sum("len")).alias(f"rows_ge_{k}"))]
    stats = lengths.agg(F.count(F.lit(1)).alias("n_runs"), F.avg("len").alias("mean_len"),
                        F.max("len").alias("max_len"), *shares).withColumn("_j", F.lit(1))
    quantiles = percentiles(lengths, [], "len", {"p10": 0.1, "median": 0.5, "p90": 0.9}, split_rows)
    return stats.join(quantiles.withColumn("_j", F.lit(1)), "_j").drop("_j")


def arc_fits(rows: DataFrame, keys: list[str], time_us: str, value: str, attack: str, least: int = 20) -> DataFrame:
    """Straight-line fit of every long arc; an arc is an attack arc by majority of its rows."""
    start = rows.groupBy(*keys).agg(F.min(time_us).alias("_start"))
    timed = rows.join(start, keys).withColumn("_x", (F.col(time_us) - F.col("_start")) / 1e6)
    fits = timed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count(value).alias("_seen"),
        F.regr_slope(F.col(value), F.col("_x")).alias("slope"),
        F.regr_r2(F.col(value), F.col("_x")).alias("r2"),
        (F.avg(attack) > 0.5).alias("is_attack"), F.stddev_pop(value).alias("_sd"))
    flat = F.coalesce(F.col("_sd") == 0, F.lit(True))
    return (fits.filter((F.col("n") >= least) & (F.col("_seen") == F.col("n")))
            .withColumn("r2", F.when(~flat, F.col("r2"))).drop("_seen", "_sd"))


def trailing_sums(epochs: DataFrame, keys: list[str], time_us: str, span_s: float, sums: dict[str, str],
                  split_rows=None) -> DataFrame:
    """Sums over (t - span, t] per epoch, as the difference of two running sums.

    Each epoch asks once at its own time and once `span` earlier, so no window has to hold all
    rows of a busy span. Meant for whole numbers, where the difference is exact.
    """
    here = epochs.select(*keys, F.col(time_us).alias("_t"), F.lit(0).alias("_ask"),
                         F.col(time_us).alias("_of"), *sums.values())
    before = epochs.select(*keys, (F.col(time_us) - int(span_s * 1e6)).alias("_t"), F.lit(1).alias("_ask"),
                           F.col(time_us).alias("_of"),
                           *[F.lit(0).cast("long").alias(c) for c in sums.values()])
    seq = Ordered(here.unionByName(before), keys, ["_t", "_ask", "_of"], split_rows)
    seq.running(**{f"_s_{n}": ("sum", F.col(c)) for n, c in sums.items()})
    parts = seq.df.groupBy(*keys, F.col("_of").alias(time_us)).agg(*[
        F.sum(F.when(F.col("_ask") == 0, F.col(f"_s_{n}")).otherwise(-F.col(f"_s_{n}"))).alias(n) for n in sums])
    return parts


def tracked_set_overlap(sat: DataFrame, split_rows=None) -> DataFrame:
    """Jaccard overlap of the satellites of an epoch with those of the epoch before.

    Sets are never collected: shared members are counted by an equi-join on the epoch number.
    """
    members = sat.select("run_id", "time_us", "satellite").distinct()
    sizes = members.groupBy("run_id", "time_us").agg(F.count(F.lit(1)).alias("_size"))
    seq = Ordered(sizes, ["run_id"], ["time_us"], split_rows).within(
        1, _before=_lag("_size"), _prev_us=_lag("time_us")).df
    now = members.join(seq.select("run_id", "time_us", "_prev_us"), ["run_id", "time_us"])
    was = members.select("run_id", F.col("time_us").alias("_prev_us"), "satellite")
    shared = now.join(was, ["run_id", "_prev_us", "satellite"]).groupBy("run_id", "time_us").agg(
        F.count(F.lit(1)).alias("_both"))
    out = seq.filter(F.col("_prev_us").isNotNull()).join(shared, ["run_id", "time_us"], "left")
    both = F.coalesce("_both", F.lit(0))
    return out.select("run_id", "time_us", (both / (F.col("_size") + F.col("_before") - both)).alias("jaccard"))


def quadratic_residual(rows: DataFrame, keys: list[str], order: list[str], value: str, position: str,
                       out: str, size: int = C.TRAILING_ROWS, split_rows=None) -> DataFrame:
    """Deviation of the residual of a quadratic fit over the last `size` rows.

    With x = 0..size-1 the normal equations have constant coefficients, so the residual sum
    follows from the windowed projections on three orthogonal polynomials.
    """
    mid = (size - 1) / 2.0
    spread = (size * size - 1) / 12.0
    x = [i - mid for i in range(size)]
    norm1 = sum(v * v for v in x)
    norm2 = sum((v * v - spread) ** 2 for v in x)

    def residual(w):
        frame = w.rowsBetween(1 - size, 0)
        values = F.collect_list(value).over(frame)
        centre = F.avg(value).over(frame)
        both = F.transform(values, lambda v, i: F.struct((v - centre).alias("y"), (i - F.lit(mid)).alias("x")))
        def total(step):
            return F.aggregate(both, F.lit(0.0), lambda acc, e: acc + step(e))
        yy = total(lambda e: e["y"] * e["y"])
        first = total(lambda e: e["y"] * e["x"])
        second = total(lambda e: e["y"] * (e["x"] * e["x"] - F.lit(spread)))
        rest = yy - first * first / F.lit(norm1) - second * second / F.lit(norm2)
        return F.when(F.col(position) >= size - 1, F.sqrt(F.greatest(rest, F.lit(0.0)) / size))

    return Ordered(rows, keys, order, split_rows).within(size - 1, **{out: residual}).df


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """Share of rows with a value, one row per column."""
    n = F.count(F.lit(1))
    shares = df.agg(*[(F.count(c) / n).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("share")) for c in columns])
    return shares.select(F.inline(pairs))
