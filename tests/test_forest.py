"""Forests grown in tasks: the same trees however rows and nodes are spread, and each split the best of those it tried."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import forest, models

FEATURES = ["a", "b", "c", "d", "e"]


@pytest.fixture(scope="module")
def rows(spark):
    draw = np.random.default_rng(3)
    x = np.round(draw.normal(size=(400, len(FEATURES))), 2)
    y = (x[:, 0] * x[:, 1] + x[:, 2] + draw.normal(size=400) > 0).astype(int)
    # Some rows are copies of one another.
    x[300:360], y[300:360] = x[0], y[0]
    return spark.createDataFrame([(i, *map(float, r), int(t)) for i, (r, t) in enumerate(zip(x, y))], f"id long, {', '.join(f'{f} double' for f in FEATURES)}, y int").cache()


def table(model):
    return sorted(map(repr, model.stages[-1].nodes().collect()))


def test_a_forest_is_the_same_however_it_is_grown_and_scored(spark, rows, monkeypatch):
    whole = models.fit_forest(rows, FEATURES, "y", trees=5, depth=6)
    wanted = {r["id"]: r["probability"] for r in models.probability(whole, rows).collect()}
    monkeypatch.setattr(forest, "LOCAL_BYTES", 60 * len(FEATURES))
    monkeypatch.setattr(forest, "PACKED_ROWS", 37)
    monkeypatch.setattr(forest, "PIECE_NODES", 5)
    monkeypatch.setattr(forest, "COUNTED_NODES", 3)
    parted = models.fit_forest(rows.repartition(7), FEATURES, "y", trees=5, depth=6)
    assert table(parted) == table(whole)
    monkeypatch.setattr(forest, "SCORED_ROWS", 50)
    monkeypatch.setattr(forest, "SCORED_NODES", 20)
    assert {r["id"]: r["probability"] for r in models.probability(parted, rows.repartition(3)).collect()} == wanted


def test_nodes_hold_the_drawn_rows_and_split_them_best(spark, rows):
    model = models.fit_forest(rows, FEATURES, "y", trees=2, depth=20).stages[-1]
    weights = models.class_weights(rows, "y")
    packed = np.array([list(map(float, r)) for r in rows.select(*FEATURES, "y").collect()])
    codes = np.stack([np.searchsorted(c, packed[:, i]) for i, c in enumerate(model.cuts)], axis=1)
    plan = forest.Plan(model.cuts, (weights[0], weights[1]), 2, 20, 42)
    nodes = {(r["tree"], r["id"]): r for r in model.nodes().collect()}
    for tree in (0, 1):
        root = nodes[tree, 0]
        assert 300 < root["cover"] < 500
        for (t, i), n in nodes.items():
            if t == tree and n["left"] >= 0:
                low, high = nodes[t, n["left"]], nodes[t, n["right"]]
                assert low["cover"] + high["cover"] == pytest.approx(n["cover"]) and low["cover"] > 0 and high["cover"] > 0
                assert n["feature"] in plan.choice(t, np.array([i]))[0] and n["gain"] > 0
                gini = [1 - v["value"] ** 2 - (1 - v["value"]) ** 2 for v in (n, low, high)]
                assert n["gain"] == pytest.approx(gini[0] - (gini[1] * low["cover"] + gini[2] * high["cover"]) / n["cover"])
    # The root by brute force over its drawn rows, which stand in the table of packed rows.
    ready = models._prepared(rows, models._prepare(rows, FEATURES))
    key = F.xxhash64(F.lit(42), F.col("y"), *[F.col(f"_x_{f}") for f in FEATURES])
    blocks = forest._packed(ready, F.array(*[F.col(f"_x_{f}") for f in FEATURES]), key, "y", model.cuts).toArrow()
    x, y, hashes = forest.unpacked(blocks, len(FEATURES))
    assert sorted(map(tuple, x.tolist())) == sorted(map(tuple, codes.tolist())) and len(np.unique(hashes)) == 400
    drawn = plan.drawn(hashes, 0)
    w = drawn * np.where(y == 1, weights[1], weights[0])

    def side(held):
        return (w[held & (y == 1)].sum() ** 2 + w[held & (y == 0)].sum() ** 2) / w[held].sum() if w[held].sum() else 0.0

    gains = {(f, b): side(x[:, f] <= b) + side(x[:, f] > b) for f in plan.choice(0, np.array([0]))[0] for b in range(forest.BINS - 1)}
    best = nodes[0, 0]
    assert gains[best["feature"], list(model.cuts[best["feature"]]).index(best["cut"])] == pytest.approx(max(gains.values()))


def test_importances_follow_what_decides(spark, rows):
    df = rows.withColumn("y", (F.col("d") > 0.1).cast("int"))
    values = models.fit_forest(df, FEATURES, "y", trees=10, depth=5).stages[-1].featureImportances.toArray()
    assert values.sum() == pytest.approx(1) and values.argmax() == 3
