"""Profile, drift, warnings, priority, labels and site tables."""

import math
import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import alignment, feedback, folds, metrics, models, priority, profile
from plumbline.sources import grids, tables, towers, validation


@pytest.fixture(scope="module")
def readings(spark):
    rng = random.Random(7)
    rows = [(i, rng.gauss(40, 5), float(rng.randint(4, 12)), 3.0) for i in range(3000)]
    return spark.createDataFrame(rows, "event_id long, snr_l1_mean double, numSV double, fixType double").cache()


FEATURES = ["snr_l1_mean", "numSV", "fixType"]


@pytest.mark.parametrize("split_rows", [None, 200])
def test_a_baseline_does_not_drift_from_itself(readings, split_rows):
    base = profile.baseline(readings, FEATURES, split_rows=split_rows)
    report = {r["feature"]: r for r in profile.drift(readings, base, FEATURES).collect()}
    assert abs(report["snr_l1_mean"]["psi"]) < 1e-9 and report["snr_l1_mean"]["severity"] == "none"
    assert report["fixType"]["psi"] is None and report["fixType"]["skipped"] == "near-constant baseline"


def test_shifted_values_are_major_drift_and_few_values_are_skipped(readings):
    base = profile.baseline(readings, FEATURES)
    shifted = readings.withColumn("snr_l1_mean", F.col("snr_l1_mean") + 20)
    report = profile.drift(shifted, base, FEATURES)
    assert report.filter("feature = 'snr_l1_mean'").first()["severity"] == "major"
    assert profile.drift_summary(report).first()["flagged"] is True
    few = profile.drift(profile.recent(readings, 99), base, FEATURES).filter("feature = 'numSV'").first()
    assert (few["psi"], few["skipped"]) == (None, "too few values")


def test_bins_close_at_the_top_and_bounds_stay_non_negative(readings):
    base = {r["feature"]: r for r in profile.baseline(readings, FEATURES).collect()}
    assert sum(base["numSV"]["psi_proportions"]) == pytest.approx(1.0)
    assert len(base["numSV"]["psi_proportions"]) == len(base["numSV"]["psi_edges"]) + 1
    assert base["numSV"]["bound_low"] == pytest.approx(4 - 0.25 * 8) and not base["numSV"]["bound_low_clamped_to_zero"]


def test_warnings_name_the_side_and_reject_nothing(spark, readings):
    base = profile.baseline(readings, FEATURES)
    odd = spark.createDataFrame([(1, 40.0, 8.0, 3.0), (2, -900.0, 99.0, None), (3, math.nan, math.inf, 3.0)],
                                "event_id long, snr_l1_mean double, numSV double, fixType double")
    got = {r["event_id"]: [(w["feature"], w["direction"]) for w in r["input_warnings"]]
           for r in profile.warnings(odd, base, FEATURES).collect()}
    assert got == {1: [], 2: [("numSV", "above_baseline_range"), ("snr_l1_mean", "below_baseline_range")],
                   3: [("numSV", "not_finite"), ("snr_l1_mean", "not_finite")]}
    counts = profile.warning_counts(profile.warnings(odd, base, FEATURES)).collect()
    assert sum(r["n"] for r in counts) == 4


def test_profile_survives_its_file(spark, readings, tmp_path):
    base = profile.baseline(readings, FEATURES)
    tables.write_profile(base, str(tmp_path / "p"))
    back = tables.read_profile(spark, str(tmp_path / "p"))
    assert sorted(base.select(*back.columns).collect()) == sorted(back.collect())


EVENT = "event_id long, site string, source string, alert_state string, predicted_label string, severity double"
SITE = "site string, site_name string, lat double, lon double, pop_2km double"


def test_priority_gate_and_order(spark):
    events = spark.createDataFrame([
        (1, "low", "ingest", "alerting", "attack", 0.9), (2, "high", "ingest", "alerting", "attack", 0.1),
        (3, "tie1", "ingest", "alerting", "attack", 0.4), (4, "tie2", "ingest", "alerting", "attack", 0.6),
        (5, "none", "ingest", "alerting", "attack", 1.0), (6, "calm", "ingest", "normal", "attack", 1.0),
        (7, "ghost", "api", None, "attack", 0.5), (8, "past", "ingest", "alerting", "attack", 0.5),
        (9, "past", "ingest", "normal", "clean", 0.2), (10, "clear", "api", None, "clean", 0.9)], EVENT)
    sites = spark.createDataFrame([("low", "L", 0.0, 0.0, 10.4), ("high", "H", 0.0, 0.0, 9000.5), ("tie1", "1", 0.0, 0.0, 50.0),
                                   ("tie2", "2", 0.0, 0.0, 50.0), ("none", "N", 0.0, 0.0, None), ("calm", "C", 0.0, 0.0, 1e9),
                                   ("past", "P", 0.0, 0.0, 0.0)], SITE)
    rows = priority.priority_list(events, sites).orderBy("rank").collect()
    assert [r["site"] for r in rows] == ["high", "tie2", "tie1", "low", "past", "none", "ghost"]
    by = {r["site"]: r for r in rows}
    assert by["high"]["pop_2km"] == 9000 and by["past"]["pop_2km"] == 0 and by["past"]["state"] == "cleared"
    assert by["none"]["population_status"] == "population unavailable" and by["ghost"]["gate_basis"] == "threshold"
    assert not by["ghost"]["alerting_now"]


@pytest.mark.parametrize("last, alerting", [("normal", False), ("alerting", True)])
def test_replayed_sites_follow_the_state_of_the_recording(spark, last, alerting):
    events = spark.createDataFrame([(1, "a", "replay", "alerting", "attack", 0.9), (2, "b", "replay", last, "clean", 0.1)], EVENT)
    sites = spark.createDataFrame([("a", "A", 0.0, 0.0, 1.0)], SITE)
    row = priority.priority_list(events, sites).filter("site = 'a'").first()
    assert row["alerting_now"] is alerting


def test_relabelled_events(spark):
    log = spark.createDataFrame([(1, 1, "confirmed", "ann", "x", 10), (2, 2, "dismissed", "", "y", 11), (3, 1, "dismissed", "bob", "z", 12),
                                 (4, 99, "confirmed", "ann", "gone", 13)],
                                "log_id long, event_id long, label string, analyst string, note string, created_at long")
    events = spark.createDataFrame([(1, "replay", "attack", "alerting"), (2, "api", "attack", None), (3, "api", "clean", None)],
                                   "event_id long, source string, predicted_label string, alert_state string")
    row = feedback.summary(events, log).first()
    assert (row["confirmed"], row["dismissed"], row["relabeled_events"], row["total_submissions"]) == (1, 2, 1, 4)
    assert (row["predicted_attack_labeled"], row["predicted_attack_precision"], row["distinct_analysts"]) == (2, 0.0, 2)
    hist = feedback.history(log).filter("event_id = 1").orderBy("revision").collect()
    assert [(r["previous_label"], r["revision"], r["first_labeled_at"]) for r in hist] == [(None, 1, 10), ("confirmed", 2, 10)]
    assert feedback.labeled_events(feedback.current(log), events).count() == 2


def test_precision_without_labels_is_missing(spark):
    log = spark.createDataFrame([], "log_id long, event_id long, label string, analyst string, note string, created_at long")
    events = spark.createDataFrame([(1, "api", "attack", None)], "event_id long, source string, predicted_label string, alert_state string")
    row = feedback.summary(events, log).first()
    assert row["predicted_attack_precision"] is None and row["total_labeled"] == 0


def test_notes_with_commas_and_lines_survive_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a, "b"\nc', None), (2, None, 2.5)], "event_id long, note string, feature_x double")
    tables.write_csv(df, str(tmp_path / "out"))
    assert sorted(tables.read_csv(spark, str(tmp_path / "out"), df.schema).collect()) == sorted(df.collect())


def test_sites_with_one_id_get_their_own_key(spark, tmp_path):
    (tmp_path / "t.csv").write_text("site_id,site_name,lat,long,other\ntbg,A,1,109,x\nu,B,2,109,x\ntbg,C,bad,110,x\n")
    rows = towers.read_sites(spark, str(tmp_path / "t.csv")).orderBy("src_idx").collect()
    assert [(r["tower_key"], r["lat"], r["lon"]) for r in rows] == [("tbg__0", 1.0, 109.0), ("u", 2.0, 109.0), ("tbg__1", None, 110.0)]


def test_exposure_goes_by_place_and_ignores_places_listed_twice(spark):
    sites = spark.createDataFrame([("a", 1.0000001, 2.0), ("b", 3.0, 4.0), ("c", 5.0, 6.0)], "site string, lat double, lon double")
    exposure = spark.createDataFrame([(1.0, 2.0, 5.0, 9.0), (3.0, 4.0, 1.0, 1.0), (3.0, 4.0, 2.0, 2.0)],
                                     "lat double, lon double, pop_within_1km double, pop_within_2km double")
    got = {r["site"]: r["pop_2km"] for r in towers.attach_exposure(sites, exposure).collect()}
    assert got == {"a": 9.0, "b": None, "c": None}
    assert towers.attach_exposure(sites, exposure.drop("pop_within_2km")).filter("pop_2km IS NOT NULL").count() == 0
    assert towers.population_map(sites).count() == 0


def test_an_unknown_site_rejects_its_batch(spark):
    sites = spark.createDataFrame([("k1", "z", 0, 1), ("k2", "z", 1, 2)], "site_key string, site_code string, src_idx int, site int")
    asked = spark.createDataFrame([(1, "k2", 1), (2, "z", 1), (3, "k1", 2), (4, "?", 2)], "id int, code string, batch int")
    got = {r["id"]: (r["site"], r["batch_accepted"]) for r in validation.resolve_sites(asked, sites, "code", "batch").collect()}
    assert got == {1: (2, True), 2: (1, True), 3: (1, False), 4: (None, False)}


def test_feedback_rules(spark):
    rows = spark.createDataFrame([("confirmed", "n", "a"), ("maybe", "n", "a"), ("dismissed", "x" * 2001, "a" * 121), (None, None, None)],
                                 "label string, note string, analyst string")
    good, bad = validation.split(rows, validation.feedback_rules())
    assert good.count() == 1 and sorted(map(tuple, (r["reasons"] for r in bad.collect()))) == [("label",), ("label",), ("note", "analyst")]


def test_daily_grid_files(spark, tmp_path):
    head = "hex,lat,lon,count_good_aircraft,count_bad_aircraft\n"
    (tmp_path / "2024-04-01-h3.csv").write_text(head + "a,1,2,9,1\nb,1,2,0,0\n")
    (tmp_path / "2024-04-03-h3.csv").write_text(head + "a,1,2,5,5\n")
    daily = grids.read_daily(spark, str(tmp_path))
    assert [str(r["date"]) for r in grids.missing_days(daily, "2024-04-01", "2024-04-03").collect()] == ["2024-04-02"]
    cells = {r["hex"]: r["bad_frac"] for r in grids.cell_sums(daily, ["hex"], "count_good_aircraft", "count_bad_aircraft").collect()}
    assert cells == {"a": 0.25, "b": None}


@pytest.mark.parametrize("split_rows", [None, 20])
def test_ranking_quality_with_ties(spark, split_rows):
    rng = random.Random(3)
    rows = [(rng.randint(0, 1), rng.randint(0, 60) / 60) for _ in range(300)]
    got = metrics.ranking_quality(spark.createDataFrame(rows, "truth int, probability double"), split_rows=split_rows).first()
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    ap, before = 0.0, 0.0
    for cut in sorted({s for _, s in rows}, reverse=True):
        tp, fp = sum(s >= cut for s in pos), sum(s >= cut for s in neg)
        ap, before = ap + (tp / len(pos) - before) * tp / (tp + fp), tp / len(pos)
    assert got["roc_auc"] == pytest.approx(auc) and got["pr_auc"] == pytest.approx(ap)


def test_threshold_keeps_its_start_unless_strictly_better(spark):
    rows = [(0, "x", 0.3), (0, "x", 0.55), (1, "J", 0.9), (1, "J", 0.8)]
    df = spark.createDataFrame(rows, "truth int, attack_type string, probability double")
    best = metrics.choose_threshold(df, [0.4, 0.6, 0.7, 0.85], held="J").first()
    assert (best["threshold"], best["clean_recall"]) == (0.6, 1.0)
    same = metrics.choose_threshold(df.filter("probability <> 0.55"), [0.4, 0.6], held="J").first()
    assert same["threshold"] == 0.5


def test_folds_keep_recordings_whole(spark):
    rows = spark.createDataFrame([(f"r{i % 11}", i) for i in range(500)], "run string, i int")
    sizes = folds.by_size(rows, "run", 4).groupBy("fold").sum("n").collect()
    assert len(sizes) == 4 and sum(r["sum(n)"] for r in sizes) == 500


def test_model_columns_follow_the_table_order(spark):
    df = spark.createDataFrame([(1.0, 2.0, "r", 3.0)], "numSV double, lat double, run_id string, hAcc double")
    assert models.feature_columns(df) == ["numSV", "hAcc"]


@pytest.mark.parametrize("split_rows", [None, 15])
def test_nearest_join_takes_the_earlier_of_two_equal_gaps(spark, split_rows):
    left = spark.createDataFrame([("r", 10_000_000 + i * 1_000_000, i) for i in range(20)] + [("r", 90_000_000, 99)], "run_id string, t long, i long")
    right = spark.createDataFrame([("r", 9_500_000 + i * 1_000_000, i) for i in range(12)], "run_id string, u long, v long")
    got = {r["i"]: r["v"] for r in alignment.nearest(left, right, ["run_id"], "t", "u", 1.0, ["v"], ["i"], split_rows).collect()}
    assert [got[i] for i in range(12)] == list(range(12)) and got[12] is None and got[99] is None
    assert alignment.nearest(left, right, ["run_id"], "t", "u", 1.5, ["v"], ["i"]).filter("i = 12").first()["v"] == 11


@pytest.mark.parametrize("split_rows", [None, 10])
def test_overlapping_windows_label_closed_intervals(spark, split_rows):
    points = spark.createDataFrame([("a", t) for t in range(40)] + [("b", 5)], "k string, t long")
    spans = spark.createDataFrame([("a", 3, 10), ("a", 8, 12), ("a", 20, 20), ("a", 20, 22)], "k string, s long, e long")
    got = {(r["k"], r["t"]): r["attack"] for r in alignment.covered(points, spans, ["k"], "t", "s", "e", split_rows=split_rows).collect()}
    assert {t for (k, t), v in got.items() if v} == {*range(3, 13), 20, 21, 22} and got[("b", 5)] == 0
