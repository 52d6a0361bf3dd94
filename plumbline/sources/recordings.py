"""Recording folders: three CSV files and a scenario document each, read all at once.

Every CSV file goes by its own header: columns may stand in another order, lack or be more. What can't be read costs only its
recording: `quarantined` names those left out and why.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..constants import LOCAL_OFFSET_HOURS
from ..functions.columns import micros, nan_to_null, nullif_empty
from ..operators import alignment, features
from ..operators.ordered import group_sizes, settled, sized
from ..session import cut

NAV_FILE, SATELLITE_FILE, RF_FILE, SCENARIO_FILE = "nav_pvt.csv", "rinex.csv", "mon_rf.csv", "scenario.json"
NAV_COLUMNS = ("iTOW", "fixType", "gSpeed", "hAcc", "vAcc", "sAcc", "headAcc", "pDOP", "numSV", "lat", "lon",
               "height", "velN", "velE", "velD")
SATELLITE_COLUMNS = {"pseudorange_L1": "pseudorange", "carrier_phase_L1": "carrier", "doppler_L1": "doppler",
                     "snr_L1": "snr", "pseudorange_L2": "pseudorange_l2", "snr_L2": "snr_l2"}
RF_COLUMNS = ("jamInd_01", "jamInd_02", "agcCnt_01", "agcCnt_02", "noisePerMS_01", "noisePerMS_02")
# Columns without which a recording can't be used.
REQUIRED = {NAV_FILE: ("real_time", "iTOW", "lat", "lon", "height"), SATELLITE_FILE: ("time", "satellite", "pseudorange_L1", "doppler_L1", "snr_L1"),
            RF_FILE: ("real_time",)}
TOLERANCE_S = 1.0

SCENARIO = T.StructType([
    T.StructField("scenario_id", T.StringType()), T.StructField("attack_type", T.StringType()),
    T.StructField("attack_log", T.ArrayType(T.StructType([
        T.StructField("timestamp_utc", T.StringType()), T.StructField("event", T.StringType())]))),
    T.StructField("attack_parameters", T.StructType([
        T.StructField("Rover states", T.StringType()), T.StructField("rover_states", T.StringType()),
        T.StructField("power_max", T.StringType()), T.StructField("frequency_band", T.StringType())])),
    T.StructField("_corrupt_record", T.StringType())])


def _run_id(root: str) -> Column:
    """Folder of the file relative to the root."""
    tail = re.escape(re.sub(r"^[a-z0-9]+:/*", "", root).strip("/"))
    return F.regexp_extract(F.col("_metadata.file_path"), f".*?{tail}/(.*)/[^/]+$", 1)


def complete_runs(spark: SparkSession, root: str) -> DataFrame:
    """Recordings that have all four files, from the listing alone."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    files = listed.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), _run_id(root).alias("run_id"))
    needed = [NAV_FILE, SATELLITE_FILE, RF_FILE, SCENARIO_FILE]
    return files.filter(F.col("name").isin(needed)).groupBy("run_id").agg(
        F.count_distinct("name").alias("n")).filter(F.col("n") == len(needed)).select("run_id")


def read_csv(spark: SparkSession, path: str, numbers: dict[str, str], texts: list[str], time: str | None,
             run_id: Column | None = None, pattern: str = "*.csv") -> DataFrame:
    """Chosen CSV columns; a bad number or time is missing, a column the files lack is missing throughout.

    `src_idx` is the place of the row in its file: rows of a split are fewer than its bytes, so the
    start of the split plus the row number in the task rises through the file.
    """
    raw = spark.read.option("header", True).option("enforceSchema", False).option(
        "recursiveFileLookup", True).option("pathGlobFilter", pattern).csv(path)
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    columns = [F.col(c) for c in texts if c in raw.columns]
    for name, out in numbers.items():
        value = F.col(name).try_cast("double") if name in raw.columns else F.lit(None).cast("double")
        columns.append(value.alias(out))
    if time:
        columns.append(F.try_to_timestamp(F.col(time)).alias(time))
    columns.append((F.col("_metadata.file_block_start") + row).alias("src_idx"))
    if run_id is not None:
        columns.append(run_id.alias("run_id"))
    rows = nan_to_null(raw.select(*columns))
    return rows.filter(F.col(time).isNotNull()).withColumn("time_us", micros(time)) if time else rows


def headers(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Column names of every file of one name, from its first line: (path, run_id, header)."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).text(root).select(
        F.col("_metadata.file_path").alias("path"), _run_id(root).alias("run_id"), F.col("_metadata.file_block_start").alias("_at"), "value",
        F.monotonically_increasing_id().alias("_row"))
    first = lines.filter("_at = 0").groupBy("path", "run_id").agg(F.min_by("value", "_row").alias("_line"))
    clean = F.regexp_replace("_line", "^\\ufeff|\r$", "")
    return first.select("path", "run_id", F.transform(F.split(clean, ","), lambda c: F.trim(F.regexp_replace(c, '"', ""))).alias("header"))


def read_by_name(spark: SparkSession, root: str, name: str, numbers: dict[str, str], texts: list[str], time: str) -> DataFrame:
    """Chosen columns of all files of one name, each by its own header; a bad number, or a column a file lacks, is missing.

    Files are read once, without names; a small table has the place of each column in each file.
    """
    known = cut(headers(spark, root, name))
    width = known.agg(F.max(F.size("header")).alias("n")).first()["n"] or 1
    raw = spark.read.schema(T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(width)])).option(
        "recursiveFileLookup", True).option("pathGlobFilter", name).csv(root)
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    cells = raw.select(F.array(*[F.col(f"_c{i}") for i in range(width)]).alias("_cells"), F.col("_metadata.file_path").alias("path"),
                       (F.col("_metadata.file_block_start") + row).alias("src_idx"))
    placed = cells.join(sized(known), "path").filter(
        F.array_join(F.slice("_cells", 1, F.size("header")), ",", "") != F.array_join("header", ","))

    def column(c: str) -> Column:
        at = F.array_position("header", c).cast("int")
        return F.when(at > 0, F.get("_cells", at - 1))

    rows = nan_to_null(placed.select(*[column(c).alias(c) for c in texts], *[column(c).try_cast("double").alias(out) for c, out in numbers.items()],
                                     F.try_to_timestamp(column(time)).alias(time), "src_idx", "run_id"))
    return rows.filter(F.col(time).isNotNull()).withColumn("time_us", micros(time))


def read_nav(spark: SparkSession, root: str) -> DataFrame:
    return read_by_name(spark, root, NAV_FILE, {c: c for c in NAV_COLUMNS}, [], "real_time")


def read_satellites(spark: SparkSession, root: str) -> DataFrame:
    return read_by_name(spark, root, SATELLITE_FILE, SATELLITE_COLUMNS, ["satellite"], "time").na.drop(subset=["satellite"])


def read_rf(spark: SparkSession, root: str) -> DataFrame:
    return read_by_name(spark, root, RF_FILE, {c: c for c in RF_COLUMNS}, [], "real_time")


def quarantined(spark: SparkSession, root: str) -> DataFrame:
    """Recordings that are left out, and why: a file lacks or is empty, a file lacks a column, or the scenario can't be read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), _run_id(root).alias("run_id"))
    needed = [NAV_FILE, SATELLITE_FILE, RF_FILE, SCENARIO_FILE]
    files = listed.filter(F.col("name").isin(needed)).groupBy("run_id").agg(F.collect_set("name").alias("_have"))
    lost = files.select("run_id", F.explode(F.array_except(F.array(*map(F.lit, needed)), "_have")).alias("_x")).select(
        "run_id", F.concat(F.lit("no file "), "_x").alias("reason"))
    out = lost.unionByName(read_scenarios(spark, root)[1].select("run_id", F.lit(f"unreadable {SCENARIO_FILE}").alias("reason")))
    for name, columns in REQUIRED.items():
        lacking = F.array_except(F.array(*map(F.lit, columns)), "header")
        have = files.filter(F.array_contains("_have", name)).select("run_id").join(headers(spark, root, name), "run_id", "left").withColumn(
            "header", F.coalesce("header", F.array().cast("array<string>")))
        out = out.unionByName(have.select("run_id", F.explode(lacking).alias("_x")).select(
            "run_id", F.concat(F.lit("no column "), "_x", F.lit(f" in {name}")).alias("reason")))
    return out


def read_scenarios(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Readable scenario documents, and the unreadable ones."""
    # Stored once: the reader refuses queries that need nothing but the mark of a broken document.
    raw = cut(spark.read.schema(SCENARIO).option("multiLine", True).option("recursiveFileLookup", True).option(
        "pathGlobFilter", SCENARIO_FILE).json(root).withColumn("run_id", _run_id(root)))
    return raw.filter("_corrupt_record IS NULL").drop("_corrupt_record"), raw.filter("_corrupt_record IS NOT NULL")


def scenario_facts(scenarios: DataFrame) -> DataFrame:
    given = F.col("attack_parameters")
    return scenarios.select(
        "run_id", "scenario_id", "attack_type",
        F.coalesce(nullif_empty(given["Rover states"]), given["rover_states"]).alias("rover_state"),
        given["power_max"].alias("power_w_max"), given["frequency_band"].alias("bands"))


def attack_windows(scenarios: DataFrame, offset_hours: float = LOCAL_OFFSET_HOURS, split_rows=None) -> DataFrame:
    """Attack windows on the recording clock: local log times without zone, shifted."""
    log = scenarios.select("run_id", F.posexplode("attack_log").alias("pos", "e"))
    wall = F.regexp_replace(F.col("e.timestamp_utc"), r"(Z|[+-]\d{2}:?\d{2})$", "")
    shifted = micros(F.try_to_timestamp(wall)) - int(offset_hours * 3_600_000_000)
    return alignment.paired_windows(log.select("run_id", "pos", F.col("e.event").alias("event"), shifted.alias("at")),
                                    ["run_id"], ["pos"], "event", "at", split_rows)


def feature_table(nav: DataFrame, satellites: DataFrame, rf: DataFrame, windows: DataFrame,
                  facts: DataFrame | None = None, limits: features.Limits = features.Limits(),
                  tolerance_s: float = TOLERANCE_S, split_rows=None) -> DataFrame:
    """One labelled row per navigation epoch with all base features."""
    epochs = nav.select("run_id").unionByName(satellites.select("run_id", "time_us").unionByName(
        rf.select("run_id", "time_us")).distinct().select("run_id"))
    sizes = group_sizes(epochs, ["run_id"])
    spine = features.position_deviation(features.clock_drift(nav, split_rows=split_rows), split_rows=split_rows)
    sat = features.code_epochs(features.code_residuals(satellites, limits, split_rows)).withColumnRenamed("time_us", "_sat_us")
    monitor = features.rf_epochs(rf).withColumnRenamed("time_us", "_rf_us")
    for right, at in ((sat, "_sat_us"), (monitor, "_rf_us")):
        columns = [c for c in right.columns if c not in ("run_id", at)]
        spine = alignment.nearest(spine, right, ["run_id"], "time_us", at, tolerance_s, columns, ["src_idx"],
                                  split_rows, sizes)
    labelled = alignment.covered(spine, windows, ["run_id"], "time_us", "window_start", "window_end", split_rows=split_rows)
    out = labelled.join(settled(alignment.window_facts(nav, windows, ["run_id"], "time_us")), "run_id", "left")
    return out if facts is None else out.join(sized(facts), "run_id", "left")


def build_features(spark: SparkSession, root: str, limits: features.Limits = features.Limits()) -> DataFrame:
    """The feature table of all complete recordings below a folder."""
    scenarios, _ = read_scenarios(spark, root)
    usable = settled(complete_runs(spark, root).join(scenarios.select("run_id"), "run_id", "left_semi")
                     .join(quarantined(spark, root).select("run_id"), "run_id", "left_anti"))

    def kept(df):
        return df.join(usable, "run_id", "left_semi")

    return feature_table(kept(read_nav(spark, root)), kept(read_satellites(spark, root)), kept(read_rf(spark, root)),
                         attack_windows(kept(scenarios)), scenario_facts(kept(scenarios)), limits)


def supplement(nav: DataFrame, epochs: DataFrame, tolerance_s: float = TOLERANCE_S, split_rows=None) -> DataFrame:
    """Extra epoch features on the navigation spine: run, time and the features."""
    columns = [c for c in epochs.columns if c not in ("run_id", "time_us")]
    right = epochs.withColumnRenamed("time_us", "_at_us")
    return alignment.nearest(nav.select("run_id", "time_us", "src_idx"), right, ["run_id"], "time_us", "_at_us",
                             tolerance_s, columns, ["src_idx"], split_rows)
