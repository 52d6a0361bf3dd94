"""Alert state and arrivals against a reading-by-reading loop."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators import alerts


class Machine:
    def __init__(self):
        self.state, self.up, self.down = "normal", 0, 0

    def update(self, above):
        self.up, self.down = (self.up + 1, 0) if above else (0, self.down + 1)
        if self.state == "normal" and self.up >= 3:
            self.state = "alerting"
        elif self.state == "alerting" and self.down >= 5:
            self.state = "normal"
        return self.state


@pytest.mark.parametrize("split_rows", [None, 40])
def test_hysteresis_equals_the_state_machine(spark, split_rows):
    rng = random.Random(1)
    data = [("hot" if i % 3 else f"s{i % 4}", i, rng.random() < 0.55) for i in range(600)]
    df = spark.createDataFrame(data, "site string, t long, above boolean")
    got = {r["t"]: r["alert_state"] for r in alerts.hysteresis(df, ["site"], ["t"], "above", split_rows=split_rows).collect()}
    machines = {}
    for site, t, above in data:
        assert got[t] == machines.setdefault(site, Machine()).update(above)


@pytest.mark.parametrize("sequence, wanted", [
    ("AAA", "n n a"), ("AABAAB", "n n n n n n"), ("AAABBBB", "n n a a a a a"), ("AAABBBBB", "n n a a a a a n"),
    ("AAABBBBABBBBB", "n n a a a a a a a a a a n")])
def test_streak_lengths(spark, sequence, wanted):
    df = spark.createDataFrame([("s", i, c == "A") for i, c in enumerate(sequence)], "site string, t long, above boolean")
    got = [r["alert_state"][0] for r in alerts.hysteresis(df, ["site"], ["t"], "above").orderBy("t").collect()]
    assert got == wanted.split()


def ingest(rows):
    """Batches one by one: repeats, late rows, state."""
    machines, marks, seen, out = {}, {}, {}, {}
    for batch in sorted({r["batch_seq"] for r in rows}):
        mine = sorted((r for r in rows if r["batch_seq"] == batch), key=lambda r: (r["time_us"], r["position"]))
        base = dict(marks)
        for r in mine:
            site, key = r["site"], (r["site"], r["time_us"])
            if key in seen:
                out[r["event_id"]] = (seen[key], True, False, None)
                continue
            seen[key] = r["event_id"]
            machine = machines.setdefault(site, Machine())
            late = site in base and r["time_us"] < base[site]
            state = machine.state if late else machine.update(r["above"])
            marks[site] = max(marks.get(site, r["time_us"]), r["time_us"])
            out[r["event_id"]] = (r["event_id"], False, late, state)
    return out


@pytest.mark.parametrize("split_rows", [None, 60])
def test_accept_equals_batch_by_batch_intake(spark, split_rows):
    rng = random.Random(5)
    rows = [{"event_id": i, "site": "hot" if i % 2 else f"s{i % 6}", "batch_seq": b, "position": i,
             "time_us": b * 40 + rng.randint(-60, 40), "above": rng.random() < 0.6}
            for i, b in enumerate(sorted(rng.randint(0, 11) for _ in range(700)))]
    df = spark.createDataFrame(pd.DataFrame(rows))
    got = {r["event_id"]: (r["original_id"], r["duplicate"], r["out_of_order"], r["alert_state"])
           for r in alerts.accept(df, split_rows=split_rows).collect()}
    wanted = ingest(rows)
    assert sum(v[2] for v in wanted.values()) > 100 and sum(v[1] for v in wanted.values()) > 50
    assert got == wanted


def test_reordered_rows_count_against_the_submitted_key(spark):
    df = spark.createDataFrame([(1, "a", 0, 10), (1, "a", 1, 5), (1, "b", 2, 7), (1, "a", 3, 12), (2, "a", 4, 1)],
                               "batch_seq int, site string, position int, time_us long")
    out = alerts.reordered_in_batch(df, "batch_seq", "site", "position", "time_us")
    assert [r["reordered"] for r in out.orderBy("position").collect()] == [False, True, False, False, False]


def test_a_known_state_holds_until_the_next_streak(spark):
    df = spark.createDataFrame([("s", 0, False, "alerting"), ("s", 1, True, None), ("s", 2, False, None)],
                               "site string, t long, above boolean, known string")
    out = alerts.hysteresis(df, ["site"], ["t"], "above", known="known").orderBy("t")
    assert [r["alert_state"] for r in out.select(F.col("alert_state")).collect()] == ["alerting"] * 3
