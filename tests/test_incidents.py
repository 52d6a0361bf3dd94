"""Incident chaining against an event-by-event loop, with partly missing runs and sessions."""

import math
import random

import pandas as pd
import pytest

from plumbline.operators import incidents

PLACES = {"A": (0.0, 109.0), "B": (0.0, 109.009), "C": (0.0, 109.45), "X": (None, None)}
SCHEMA = ("event_id long, time_us long, site string, lat double, lon double, run_id string, session string, "
          "severity double, attack_type string, source string")


def km(a, b):
    (lat1, lon1), (lat2, lon2) = a, b
    h = math.sin(math.radians(lat2 - lat1) / 2) ** 2 + math.cos(math.radians(lat1)) * math.cos(
        math.radians(lat2)) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(h))


def fold(events):
    group, run, session, prev, out = 0, None, None, None, {}
    for e in sorted(events, key=lambda e: (e["time_us"], e["event_id"])):
        join = False
        if prev is not None:
            near = prev["site"] == e["site"] or (None not in (prev["lat"], e["lat"]) and km(
                (prev["lat"], prev["lon"]), (e["lat"], e["lon"])) <= 5.0)
            join = e["time_us"] - prev["time_us"] <= 120_000_000 and near and not (
                run and e["run_id"] and run != e["run_id"]) and not (session and e["session"] and session != e["session"])
        if not join:
            group, run, session = group + 1, None, None
        run, session, prev = e["run_id"] or run, e["session"] or session, e
        out[e["event_id"]] = group
    return out


def event(i, t, site="A", run=None, session=None, severity=0.5, source="ingest"):
    lat, lon = PLACES[site]
    return {"event_id": i, "time_us": int(t * 1e6), "site": site, "lat": lat, "lon": lon, "run_id": run, "session": session,
            "severity": severity, "attack_type": f"t{i % 2}", "source": source}


def frame(spark, events):
    return spark.createDataFrame([tuple(e.values()) for e in events], SCHEMA)


def chained(spark, events, split_rows=None):
    return {r["event_id"]: r["incident"] for r in incidents.chain(frame(spark, events), split_rows=split_rows).collect()}


@pytest.mark.parametrize("events, groups", [
    ([event(1, 0), event(2, 120)], 1), ([event(1, 0), event(2, 121)], 2), ([event(1, 0, "A"), event(2, 5, "B")], 1),
    ([event(1, 0, "A"), event(2, 5, "C")], 2), ([event(1, 0, "X"), event(2, 5, "A")], 2), ([event(1, 0, "X"), event(2, 5, "X")], 1),
    ([event(1, 0, run="r1"), event(2, 5, run="r2")], 2), ([event(1, 0, run="r1"), event(2, 5), event(3, 9, run="r2")], 2),
    ([event(1, 0, run="r1", session="s1"), event(2, 5, run="r1", session="s2")], 2),
    ([event(1, 0, run="r1"), event(2, 5, run="r1", session="s1")], 1)])
def test_chain_cases(spark, events, groups):
    got = chained(spark, events)
    assert got == fold(events) and len(set(got.values())) == groups


@pytest.mark.parametrize("seed, split_rows", [(1, None), (2, None), (3, 60), (4, 35)])
def test_chain_with_partly_missing_runs_and_sessions(spark, seed, split_rows):
    rng = random.Random(seed)
    events, t = [], 0
    for i in range(400):
        t += rng.choice([0, 1, 5, 5, 30, 130 if i % 29 == 0 else 3])
        events.append(event(i, t, rng.choice("AAB"), rng.choice([None, None, "r1", "r2"]), rng.choice([None, None, "s1", "s2"])))
    assert chained(spark, events, split_rows) == fold(events)


def test_long_chains_of_contradictions_are_followed(spark):
    runs, sessions = ["r1", None, "r2", None], [None, "s1", None, "s2"]
    events = [event(i, i, "A", runs[i % 4], sessions[(i * 3 + i // 7) % 4]) for i in range(300)]
    assert chained(spark, events) == fold(events)


def test_summary_of_an_incident(spark):
    events = [event(10, 0, "B", severity=0.9, source="replay"), event(11, 20, "A", severity=0.2), event(12, 50, "B", severity=0.9)]
    labels = spark.createDataFrame([(11, "dismissed"), (12, "confirmed")], "event_id long, label string")
    pops = spark.createDataFrame([("A", 500.0), ("B", None)], "site string, pop_2km double")
    chain = incidents.chain(frame(spark, events))
    row = incidents.summarise(chain, labels, pops).first()
    assert (row["incident_id"], row["top_event_id"], row["status"]) == ("INC-10", 10, "Confirmed")
    assert (row["event_count"], row["labeled_event_count"], row["n_sites"]) == (3, 2, 2)
    assert (row["max_pop_2km"], row["duration_seconds"], row["severity"]) == (500.0, 50.0, 0.9)
    assert row["tower_attribution_simulated"] is True
    sites = incidents.incident_sites(chain).orderBy("ordinal").collect()
    assert [r["site"] for r in sites] == ["B", "A"]
    assert [r["event_id"] for r in incidents.members(chain).orderBy("ordinal").collect()] == [10, 11, 12]


def test_no_population_anywhere_stays_missing(spark):
    chain = incidents.chain(frame(spark, [event(1, 0)]))
    row = incidents.summarise(chain).first()
    assert row["max_pop_2km"] is None and row["status"] == "New"


def test_order_is_by_severity_then_latest(spark):
    summary = spark.createDataFrame(pd.DataFrame({"severity": [0.5, 0.9, 0.9], "end_us": [9, 1, 5], "id": [1, 2, 3]}))
    assert [r["id"] for r in incidents.listed(summary).collect()] == [3, 2, 1]
