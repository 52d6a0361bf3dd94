"""Streams give the batch result, also over a restart."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions import columns as fx
from plumbline.operators import alerts
from plumbline.plans.streams import drained
from plumbline.streaming import keyed, pipeline, replay

SCHEMA = "source_id long, site long, position long, time_us long, p double"


def verdicts(rows):
    return rows.withColumns({"probability": F.col("p"), "severity": F.col("p"), "predicted_label": fx.verdict(F.col("p"), 0.5)})


@pytest.fixture(scope="module")
def history():
    rng = random.Random(8)
    return [(i, rng.choice([0, 0, 0, 1, 2, 77]), i, (b * 40 + rng.randint(-60, 40)) * 1_000_000, rng.random(), b)
            for i, b in enumerate(sorted(rng.randint(0, 4) for _ in range(250)))]


def test_intake_equals_the_batch_job_over_a_restart(spark, history, tmp_path):
    store = str(tmp_path / "store")
    sites = spark.createDataFrame([(i, 0.01 * i, 109.0) for i in range(3)], "site long, lat double, lon double")
    rows = spark.createDataFrame(history, SCHEMA + ", batch int")
    intake = pipeline.Intake(store, sites, verdicts)
    for part in ("batch < 2", "batch >= 2"):
        replay.write_groups(rows.filter(part), "batch", f"{store}/inbox")
        stream = replay.read_chunks(spark, rows.drop("batch").schema, f"{store}/inbox")
        intake.start(stream, f"{store}/checkpoint").awaitTermination()
    got = {r["source_id"]: (r["alert_state"], r["out_of_order"]) for r in pipeline.read(spark, store, "events", pipeline.EVENTS).collect()}
    known = rows.filter("site < 3").select(F.col("source_id").alias("event_id"), "site", "position", "time_us",
                                           (F.col("p") >= 0.5).alias("above"), F.col("batch").alias("batch_seq"))
    batch = alerts.accept(known).collect()
    assert got == {r["event_id"]: (r["alert_state"], r["out_of_order"]) for r in batch if not r["duplicate"]}
    replies = {r["source_id"]: r for r in pipeline.read(spark, store, "replies", pipeline.REPLIES).collect()}
    ids = {r["source_id"]: r["event_id"] for r in pipeline.read(spark, store, "events", pipeline.EVENTS).collect()}
    assert all(replies[r["event_id"]]["event_id"] == ids[r["original_id"]] for r in batch)
    assert sorted(ids.values()) == list(range(1, len(ids) + 1))
    assert spark.read.json(f"{store}/rejected").count() == sum(h[1] == 77 for h in history)
    # Running a batch again changes nothing.
    before = sorted(pipeline.read(spark, store, "events", pipeline.EVENTS).collect())
    last = rows.filter("batch = 4").drop("batch")
    intake.process(last, 4)
    assert sorted(pipeline.read(spark, store, "events", pipeline.EVENTS).collect()) == before
    assert pipeline.latest_per_site(spark, store).count() == 3
    pipeline.clear(spark, store)
    assert pipeline.read(spark, store, "events", pipeline.EVENTS).count() == 0


def test_keyed_state_equals_the_batch_job(spark, tmp_path):
    rng = random.Random(4)
    rows = spark.createDataFrame([(i, i % 3, i * 10, rng.random() < 0.5) for i in range(200)],
                                 "event_id long, site long, time_us long, above boolean")
    replay.write_chunks(rows, ["time_us", "event_id"], str(tmp_path / "in"), 3)
    out = drained(keyed.alert_states(replay.read_chunks(spark, rows.schema, str(tmp_path / "in"))), "alerts")
    wanted = alerts.hysteresis(rows, ["site"], ["time_us"], "above")
    assert sorted(out.select("event_id", "alert_state").collect()) == sorted(wanted.select("event_id", "alert_state").collect())


def test_an_unknown_site_rejects_its_whole_batch(spark, tmp_path):
    store = str(tmp_path / "store")
    sites = spark.createDataFrame([(i, 0.01 * i, 109.0) for i in range(3)], "site long, lat double, lon double")
    rows = spark.createDataFrame([(1, 0, 1, 1_000_000, 0.9, "a"), (2, 77, 2, 2_000_000, 0.9, "a"), (3, 1, 3, 3_000_000, 0.1, "b"),
                                  (4, 2, 4, 4_000_000, 0.1, None), (5, 0, 5, 5_000_000, 0.9, "b")], SCHEMA + ", request string")
    intake = pipeline.Intake(store, sites, verdicts, batch="request")
    intake.process(rows, 0)
    intake.process(rows.filter("request = 'a'").withColumn("site", F.col("site") % 75), 1)
    events = pipeline.read(spark, store, "events", pipeline.EVENTS)
    assert {r["source_id"]: r["event_id"] for r in events.collect()} == {3: 1, 4: 2, 5: 3, 1: 4, 2: 5}
    rejected = spark.read.json(f"{store}/rejected").filter("epoch = 0")
    assert {r["source_id"]: r["reason"] for r in rejected.collect()} == {1: "another row of the batch", 2: "unknown site"}
