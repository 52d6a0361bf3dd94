"""Recording folders to feature rows, against pandas on the same files."""

import json

import numpy as np
import pandas as pd
import pytest

from plumbline.constants import L1_WAVELENGTH_M
from plumbline.operators import features
from plumbline.sources import recordings, tables

START = pd.Timestamp("2024-09-10 08:00:00")


def write_run(folder, seed, seconds=120, log=None, states=None):
    folder.mkdir(parents=True)
    rng = np.random.default_rng(seed)
    t = START + pd.to_timedelta(np.arange(seconds), unit="s")
    nav = pd.DataFrame({"unused": 1, "real_time": t.astype(str), "iTOW": np.arange(seconds) * 1000.0 + rng.normal(size=seconds),
                        **{c: rng.normal(size=seconds) for c in recordings.NAV_COLUMNS if c != "iTOW"}})
    nav = nav.astype({"hAcc": object})
    nav.loc[3, "hAcc"], nav.loc[5, "real_time"] = "bad", "not a time"
    nav.to_csv(folder / "nav_pvt.csv", index=False)
    rows = []
    for name in ("G01", "G02", "R03", "E04"):
        phase = rng.normal() * 10
        for i in range(seconds * 5):
            if rng.random() < 0.01:
                phase += 300
            at = START + pd.Timedelta(milliseconds=200 * i + (900 if i > 300 else 0))
            doppler = 100 + rng.normal() * 0.2
            phase -= doppler * 0.2
            rows.append((at, name, 2e7 + phase * L1_WAVELENGTH_M + rng.normal(), phase, doppler, rng.choice([-1, 25, 45, 60, 4e7]),
                         None if name == "R03" else 2e7, 40.0))
    sat = pd.DataFrame(rows, columns=["time", "satellite", "pseudorange_L1", "carrier_phase_L1", "doppler_L1", "snr_L1", "pseudorange_L2", "snr_L2"])
    sat.sample(frac=1, random_state=seed).to_csv(folder / "rinex.csv", index=False)
    rf = pd.DataFrame({"real_time": np.repeat(t[::3] + pd.Timedelta(milliseconds=500), 2).astype(str)})
    for c in recordings.RF_COLUMNS:
        rf[c] = rng.normal(size=len(rf))
    rf.to_csv(folder / "mon_rf.csv", index=False)
    (folder / "scenario.json").write_text(json.dumps({
        "scenario_id": folder.name, "attack_type": "Jamming", "attack_log": log or [],
        "attack_parameters": {"Rover states": "", "rover_states": states, "power_max": 5, "frequency_band": "L1"}}))


LOG = [{"timestamp_utc": "2024-09-10T10:00:10Z", "event": "Jamming STARTED"}, {"timestamp_utc": "2024-09-10T10:00:20Z", "event": "jamming start"},
       {"timestamp_utc": "2024-09-10T10:00:40Z", "event": "Ended"}, {"timestamp_utc": "2024-09-10T10:00:50Z", "event": "End again"}]


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("recordings")
    write_run(base / "a" / "one", 1, log=LOG, states="static")
    write_run(base / "b", 2)
    write_run(base / "c", 3)
    (base / "c" / "mon_rf.csv").unlink()
    write_run(base / "d", 4)
    (base / "d" / "scenario.json").write_text("{not json")
    return base


@pytest.fixture(scope="module")
def table(spark, root):
    return recordings.build_features(spark, str(root)).toPandas().sort_values(["run_id", "time_us", "src_idx"])


def test_only_complete_and_readable_recordings(spark, root, table):
    assert sorted(table["run_id"].unique()) == ["a/one", "b"]
    assert [r["run_id"] for r in recordings.read_scenarios(spark, str(root))[1].collect()] == ["d"]


def test_windows_labels_and_facts(table):
    one = table[table["run_id"] == "a/one"]
    attacked = one[one["attack"] == 1]["real_time"]
    assert (attacked.min(), attacked.max()) == (START + pd.Timedelta(seconds=20), START + pd.Timedelta(seconds=40))
    assert set(one["n_attack_windows"]) == {1} and set(one["window_start_in_range"]) == {True}
    assert set(one["rover_state"]) == {"static"} and set(table[table["run_id"] == "b"]["attack"]) == {0}
    assert len(one) == 119 and one["hAcc"].isna().sum() == 1


def expected(root):
    """Base features of one recording, in pandas."""
    nav = pd.read_csv(root / "nav_pvt.csv")
    nav["real_time"] = pd.to_datetime(nav["real_time"], errors="coerce")
    nav = nav.dropna(subset=["real_time"]).sort_values("real_time")
    sat = pd.read_csv(root / "rinex.csv", float_precision="round_trip")
    sat["time"] = pd.to_datetime(sat["time"], format="mixed")
    sat = sat.sort_values(["satellite", "time"])
    sat["snr_L1"] = sat["snr_L1"].where(sat["snr_L1"].between(0, 60))
    by = sat.groupby("satellite")
    dt = by["time"].diff().dt.total_seconds()
    resid = by["pseudorange_L1"].diff() / dt + sat["doppler_L1"] * L1_WAVELENGTH_M
    sat["resid"] = resid.where((dt > 0) & (dt <= 1) & (resid.abs() <= 5000))
    epochs = sat.groupby("time").agg(n=("satellite", "count"), snr=("snr_L1", "mean"), spread=("resid", "std")).reset_index()
    rf = pd.read_csv(root / "mon_rf.csv")
    rf["real_time"] = pd.to_datetime(rf["real_time"])
    rf = rf.groupby("real_time")["jamInd_01"].mean().reset_index()
    out = pd.merge_asof(nav, epochs, left_on="real_time", right_on="time", direction="nearest", tolerance=pd.Timedelta("1s"))
    return pd.merge_asof(out, rf, on="real_time", direction="nearest", tolerance=pd.Timedelta("1s"))


def test_features_equal_pandas(root, table):
    got, wanted = table[table["run_id"] == "b"], expected(root / "b")
    for mine, theirs in (("n_sats_l1", "n"), ("snr_l1_mean", "snr"), ("pr_doppler_residual_std", "spread"), ("jam_ind_mean", "jamInd_01")):
        np.testing.assert_allclose(got[mine].to_numpy(dtype=float), wanted[theirs].to_numpy(dtype=float), rtol=1e-7)


@pytest.mark.parametrize("step", ["code", "carrier", "spoofing", "arcs", "temporal"])
def test_large_recordings_are_split_without_changing_a_value(spark, root, step):
    sat = recordings.read_satellites(spark, str(root))
    small = 3 if step in ("spoofing", "temporal") else 400
    if small == 3:
        sat = sat.filter(sat["time"] < START + pd.Timedelta(seconds=5))
    sat = sat.cache()
    build = {"code": lambda n: features.code_residuals(sat, split_rows=n), "carrier": lambda n: features.carrier_steps(sat, split_rows=n),
             "spoofing": lambda n: features.spoofing_epochs(sat, split_rows=n), "arcs": lambda n: features.arcs(sat, split_rows=n),
             "temporal": lambda n: features.temporal_epochs(sat, split_rows=n)}[step]
    order = ["run_id", "time_us"] + (["satellite", "src_idx"] if step in ("code", "carrier", "arcs") else [])
    a, b = (build(n).toPandas().sort_values(order).reset_index(drop=True) for n in (None, small))
    pd.testing.assert_frame_equal(a, b[a.columns], check_dtype=False, rtol=1e-8)


def test_feature_files_keep_rows_and_missing_values(spark, table, tmp_path):
    df = spark.createDataFrame(table[["run_id", "src_idx", "hAcc", "n_sats_l1"]])
    tables.write_features(df, str(tmp_path / "f"))
    back = tables.read_features(spark, str(tmp_path / "f"))
    assert back.count() == len(table) and set(back.columns) == set(df.columns)


def test_each_file_goes_by_its_own_header_and_a_bad_one_costs_its_recording_only(spark, tmp_path):
    for i, name in enumerate(("plain", "moved", "short", "renamed", "empty", "mangled")):
        write_run(tmp_path / name, 1, seconds=40)
    def rewrite(name, change, file="nav_pvt.csv"):
        table = pd.read_csv(tmp_path / name / file, dtype=str, keep_default_na=False)
        change(table).to_csv(tmp_path / name / file, index=False)
    rewrite("moved", lambda t: t[t.columns[::-1]].assign(extra="x,y"))
    rewrite("short", lambda t: t.drop(columns=["hAcc", "unused"]))
    rewrite("renamed", lambda t: t.rename(columns={"iTOW": "zz"}))
    (tmp_path / "empty" / "mon_rf.csv").write_text("")
    (tmp_path / "mangled" / "rinex.csv").write_bytes(b"\x00\xff\xfe\nnot,a,table\n")
    (tmp_path / "mangled" / "scenario.json").write_text("{")
    nav = recordings.read_nav(spark, str(tmp_path)).toPandas().sort_values("time_us")
    plain, moved, short = (nav[nav.run_id == r].reset_index(drop=True) for r in ("plain", "moved", "short"))
    values = ["time_us", *recordings.NAV_COLUMNS]
    pd.testing.assert_frame_equal(plain[values], moved[values])
    assert short.hAcc.isna().all() and len(short) == len(plain) == 39
    pd.testing.assert_frame_equal(plain[values].drop(columns="hAcc"), short[values].drop(columns="hAcc"))
    why = {}
    for r in recordings.quarantined(spark, str(tmp_path)).collect():
        why.setdefault(r["run_id"], set()).add(r["reason"])
    assert why.keys() == {"renamed", "empty", "mangled"}
    assert why["renamed"] == {"no column iTOW in nav_pvt.csv"} and why["empty"] == {"no file mon_rf.csv"}
    assert "unreadable scenario.json" in why["mangled"] and "no column satellite in rinex.csv" in why["mangled"]
    table = recordings.build_features(spark, str(tmp_path)).toPandas()
    assert sorted(table.run_id.unique()) == ["moved", "plain", "short"]
    assert table.groupby("run_id").size().nunique() == 1
