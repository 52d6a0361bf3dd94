"""Correlation, neighbours and autocorrelation against brute force."""

import math
import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.functions import bijection
from plumbline.functions.geo import haversine_matrix
from plumbline.operators import moran, neighbours
from plumbline.operators.correlate import correlate


def correlation_loop(events, sites, window, decay):
    out = {}
    for e in events:
        if e[1] not in sites:
            continue
        num = den = n = 0
        for o in events:
            before = (o[2], o[0]) < (e[2], e[0])
            if o[1] in sites and o[1] != e[1] and before and o[2] >= e[2] - window:
                a, b = sites[e[1]], sites[o[1]]
                d = haversine_matrix(np.array([a[0]]), np.array([a[1]]), np.array([b[0]]), np.array([b[1]]))[0, 0]
                w = math.exp(-d / decay)
                num, den, n = num + w * o[3], den + w, n + 1
        out[e[0]] = (num / den if n and den > 1e-9 else 0.0, n)
    return out


@pytest.mark.parametrize("split_rows", [None, 50])
def test_correlation_equals_pairs(spark, split_rows):
    rng = random.Random(2)
    sites = {i: (rng.random() / 10, 109 + rng.random() / 10) for i in range(12)}
    # Two thirds of the events fall into one minute, and one site sends most of them.
    events = [(i, rng.choice([0, 0, 0, *range(14)]), int((rng.random() * 60 if i % 3 else rng.random() * 3000) * 1e6) // 500_000 * 500_000,
               rng.random()) for i in range(400)]
    df = spark.createDataFrame(events, "event_id long, site long, time_us long, severity double")
    place = spark.createDataFrame([(k, *v) for k, v in sites.items()], "site long, lat double, lon double")
    got = {r["event_id"]: (r["correlation_score"], r["n_correlated"]) for r in correlate(df, place, split_rows=split_rows).collect()}
    wanted = correlation_loop(events, sites, 120_000_000, 2.0)
    assert got.keys() == wanted.keys()
    for k, (score, n) in wanted.items():
        assert got[k][1] == n and got[k][0] == pytest.approx(score, abs=1e-9)


def test_far_sites_below_the_weight_floor_score_zero(spark):
    df = spark.createDataFrame([(1, 1, 0, 0.9), (2, 2, 10, 0.1)], "event_id long, site long, time_us long, severity double")
    place = spark.createDataFrame([(1, 0.0, 0.0), (2, 10.0, 10.0)], "site long, lat double, lon double")
    row = correlate(df, place).filter("event_id = 2").first()
    assert (row["correlation_score"], row["n_correlated"]) == (0.0, 1)


def test_sites_that_share_a_place_share_its_weights(monkeypatch):
    from plumbline.operators import correlate as module

    rng, cells = np.random.default_rng(3), []
    n, spots = 3000, np.array([(0.0, 109.0), (0.02, 109.0), (0.0, 109.05)])

    def counted(*args):
        found = haversine_matrix(*args)
        cells.append(found.size)
        return found

    monkeypatch.setattr(module, "haversine_matrix", counted)
    at, sev = rng.integers(0, len(spots), n), rng.random(n)
    rows = pd.DataFrame({"slot": 0, "event_id": np.arange(n), "site": np.arange(n), "lat": spots[at, 0], "lon": spots[at, 1],
                         "t": np.arange(n), "kind": module.SOURCE, "sev": sev, "n": 1})
    got = module._score_chunk(rows, 2.0).set_index("event_id").sort_index()
    assert sum(cells) <= 1000
    w = np.exp(-haversine_matrix(spots[at, 0], spots[at, 1], spots[at, 0], spots[at, 1]) / 2.0)
    w[np.triu_indices(n)] = 0
    assert np.allclose(got["num"], w @ sev) and np.allclose(got["den"], w.sum(1)) and (got["n"] == np.arange(n)).all()


def knn_loop(points, k):
    keys = np.array([p[0] for p in points])
    lat, lon = (np.array([p[i] for p in points], dtype=float) for i in (1, 2))
    d = np.round(haversine_matrix(lat, lon, lat, lon), 9)
    out = {}
    for i, key in enumerate(keys):
        order = sorted((j for j in range(len(keys)) if j != i), key=lambda j: (d[i, j], keys[j]))[:k]
        out[int(key)] = [(int(keys[j]), d[i, j]) for j in order]
    return out


def knn(spark, points, k, block):
    df = spark.createDataFrame(points, "site long, lat double, lon double")
    got = {}
    for r in neighbours.nearest_sites(df, k, block_rows=block).orderBy("site", "rank").collect():
        got.setdefault(r["site"], []).append((r["neighbour"], r["km"]))
    return got


@pytest.mark.parametrize("block", [2048, 20])
def test_nearest_sites_equal_brute_force(spark, block):
    rng = random.Random(4)
    points = [(i, rng.uniform(-60, 60), rng.uniform(-180, 180)) if i % 2 else (i, 1 + rng.random() / 50, 109 + rng.random() / 50)
              for i in range(150)]
    points += [(200 + i, 1.5, 109.5) for i in range(40)]
    points += [(300, 10.0, 179.99), (301, 10.0, -179.99), (302, 89.9, 0.0), (303, 89.9, 180.0)]
    assert knn(spark, points, 5, block) == knn_loop(points, 5)


def test_few_points_have_few_neighbours(spark):
    points = [(1, 0.0, 0.0), (2, 0.0, 1.0), (3, 0.0, 3.0)]
    assert knn(spark, points, 5, 2048) == knn_loop(points, 5)


def test_adjacency_over_the_date_line(spark):
    cells = spark.createDataFrame([("a", 0.0, 179.9), ("b", 0.0, -179.9), ("c", 0.0, 150.0)], "cell string, lat double, lon double")
    pairs = {(r["cell"], r["neighbour"]) for r in neighbours.adjacency(cells, 50.0).collect()}
    assert pairs == {("a", "b"), ("b", "a")}


def test_adjacency_of_crowded_places_lists_every_pair(spark, monkeypatch):
    rng = random.Random(8)
    spots = [(0.0, 109.0), (0.02, 109.01), (0.03, 109.04), (5.0, 109.0)]
    cells = [(i, *(spots[0] if i % 2 else rng.choice(spots))) for i in range(60)] + [(3, *spots[1]), (None, *spots[0]), (99, None, 109.0)]
    df = spark.createDataFrame(cells, "cell long, lat double, lon double")
    known = [c for c in cells if None not in c]
    wanted = sorted((a[0], b[0], round(float(haversine_matrix(*(np.array([v]) for v in (*a[1:], *b[1:])))[0, 0]), 3))
                    for a in known for b in known if a[0] != b[0])
    wanted = [w for w in wanted if w[2] <= 4]
    for rows, task in ((128, 8_000_000), (3, 5)):
        monkeypatch.setattr(neighbours, "LIST_ROWS", rows)
        monkeypatch.setattr(neighbours, "TASK_PAIRS", task)
        found = neighbours.adjacency(df, 4.0, digits=3)
        assert found.columns == ["cell", "neighbour", "km"] and sorted(map(tuple, found.collect())) == wanted
        # Distances are those of lists: the pairs are made after them.
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Generate explode(_keys") < plan.index("ASIN")


def ring(n):
    return [(i, (i + s) % n) for i in range(n) for s in (1, -1)]


def test_moran_by_hand(spark):
    rng = np.random.default_rng(0)
    values = rng.normal(size=20)
    df = spark.createDataFrame(pd.DataFrame({"site": range(20), "value": values}))
    edges = spark.createDataFrame(ring(20), "site long, neighbour long")
    z = values - values.mean()
    lag = np.array([(z[(i + 1) % 20] + z[i - 1]) / 2 for i in range(20)])
    row = moran.global_moran(df, edges).first()
    assert row["morans_i"] == pytest.approx((z * lag).sum() / (z * z).sum()) and row["expected_i"] == pytest.approx(-1 / 19)


def test_isolates_stay_in_n_but_not_in_the_weights(spark):
    values = np.arange(16.0)
    df = spark.createDataFrame(pd.DataFrame({"site": range(16), "value": values}))
    edges = [(i, j) for i in range(15) for j in (i - 1, i + 1) if 0 <= j < 15]
    z = values - values.mean()
    lag = np.zeros(16)
    for i in range(15):
        lag[i] = np.mean([z[j] for a, j in edges if a == i])
    row = moran.global_moran(df, spark.createDataFrame(edges, "site long, neighbour long")).first()
    assert row["n_isolates"] == 1
    assert row["morans_i"] == pytest.approx(16 / 15 * (z * lag).sum() / (z * z).sum())


@pytest.mark.parametrize("values, reason", [(list(range(14)), "too few sites"), ([0.3] * 20, "zero variance")])
def test_not_computable(spark, values, reason):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "site long, value double")
    edges = spark.createDataFrame(ring(len(values)), "site long, neighbour long")
    row = moran.global_moran(df, edges).first()
    assert (row["computable"], row["reason"], row["morans_i"]) == (False, reason, None)


def test_permutation_test_sees_order_and_repeats_with_its_seed(spark):
    df = spark.createDataFrame([(i, math.sin(i / 30 * 2 * math.pi)) for i in range(30)], "site long, value double")
    edges = spark.createDataFrame(ring(30), "site long, neighbour long")
    first, second = (moran.permutation_test(df, edges, rounds=99, seed=1).first() for _ in range(2))
    assert first == second
    assert first["p_value"] == pytest.approx(0.01) and first["z_score"] > 3 and abs(first["sim_mean"]) < 0.15


@pytest.mark.parametrize("section", [None, 16])
def test_permutation_test_equals_a_loop_and_makes_no_row_for_a_site_in_a_round(spark, monkeypatch, section):
    monkeypatch.setattr(moran, "shuffled", None)
    if section:  # Three sections of the values, of two packed rows each.
        monkeypatch.setattr(moran, "SECTION", section)
        monkeypatch.setattr(moran, "PIECE", section // 2)
    rng, n, rounds = random.Random(4), 40, 49
    values = [rng.gauss(0, 1) for _ in range(n)]
    edges = [(i, j) for i in range(n - 3) for j in rng.sample([x for x in range(n) if x != i], 1 + i % 4)]
    row = moran.permutation_test(spark.createDataFrame(list(enumerate(values)), "site long, value double"),
                                 spark.createDataFrame(edges, "site long, neighbour long"), rounds=rounds, seed=5).first()
    z, linked = np.array(values) - np.mean(values), {i: [b for a, b in edges if a == i] for i in range(n)}

    def index(x):
        return n / (n - 3) * sum(x[i] * x[near].mean() for i, near in linked.items() if near) / (x * x).sum()

    sims = np.array([index(z[bijection.moved(np.arange(n), np.repeat(bijection.keys(5, rounds)[r:r + 1], n, 0), n)]) for r in range(1, rounds + 1)])
    larger = int((sims.round(9) >= round(index(z), 9)).sum())
    assert (row["morans_i"], row["sim_mean"], row["sim_std"]) == pytest.approx((index(z), sims.mean(), sims.std()))
    assert row["p_value"] == (min(larger, rounds - larger) + 1) / (rounds + 1)


def test_shuffled_is_a_permutation_in_both_modes(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(50)], "site long, value double")
    a, b = (moran.shuffled(df, 3, 9, split_rows=s).orderBy("round", "site").collect() for s in (None, 10))
    assert a == b
    assert sorted(r["value"] for r in a if r["round"] == 2) == [float(i) for i in range(50)]


def test_local_moran_quadrants(spark):
    values = [5.0 + i % 3 / 10 for i in range(15)] + [1.0 + i % 3 / 10 for i in range(15)]
    df = spark.createDataFrame(list(enumerate(values)), "site long, value double")
    edges = spark.createDataFrame([(i, j) for i in range(30) for j in range(30) if i != j and i // 15 == j // 15 and abs(i - j) <= 4],
                                  "site long, neighbour long")
    out = {r["site"]: r for r in moran.local_moran(df, edges, rounds=199).collect()}
    assert out[7]["quadrant"] == 1 and out[22]["quadrant"] == 3 and out[7]["p_value"] <= 0.02
    z = np.array(values) - np.mean(values)
    lag = np.mean([z[j] for j in (3, 4, 5, 6, 8, 9, 10, 11)])
    assert out[7]["local_i"] == pytest.approx(z[7] * lag * 29 / (z * z).sum())


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 26, 997])
def test_bijection_meets_every_place_once_and_back(spark, n):
    df = spark.range(n).withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(20)))).withColumn("to", bijection.place("id", "round", n, 20, 3))
    rows = df.withColumn("back", bijection.place("to", "round", n, 20, 3, inverse=True)).collect()
    for r in range(1, 21):
        assert sorted(x["to"] for x in rows if x["round"] == r) == list(range(n))
    assert all(x["back"] == x["id"] for x in rows)
    assert n < 16 or len({tuple(x["to"] for x in sorted(rows) if x["round"] == r) for r in range(1, 21)}) == 20


def test_bijection_spreads_evenly():
    n, rounds = 50, 4000
    of = bijection.keys(1, rounds)[np.repeat(np.arange(1, rounds + 1), n)]
    to = bijection.moved(np.tile(np.arange(n), rounds), of, n).reshape(rounds, n)
    counts = np.stack([np.bincount(to[:, i], minlength=n) for i in range(n)])
    chi = ((counts - rounds / n) ** 2 / (rounds / n)).sum() / (n - 1) ** 2
    assert 0.9 < chi < 1.1 and abs(np.corrcoef(to[:, 0], to[:, 1])[0, 1] + 1 / (n - 1)) < 0.05


def local_loop(values, edges, rounds, seed):
    """Neighbours of a site are drawn as the first sites of the round's order, itself left out."""
    n, z = len(values), np.array(values) - np.mean(values)
    scale, out = (n - 1) / (z * z).sum(), {}
    order = [bijection.moved(np.arange(n), np.repeat(bijection.keys(seed, rounds)[r:r + 1], n, 0), n, inverse=True) for r in range(1, rounds + 1)]
    for i in range(n):
        near = [b for a, b in edges if a == i]
        if near:
            seen = round(z[i] * z[near].mean() * scale, 9)
            bigger = sum(round(z[i] * z[[j for j in o if j != i][:len(near)]].mean() * scale, 9) >= seen for o in order)
            out[i] = (min(bigger, rounds - bigger) + 1) / (rounds + 1)
        else:
            out[i] = None
    return out


@pytest.mark.parametrize("split_rows", [None, 10])
def test_local_moran_equals_a_loop(spark, split_rows):
    rng = random.Random(8)
    values = [rng.gauss(0, 1) for _ in range(24)]
    # A hub with every other site, a site without neighbours, and different degrees.
    edges = [(0, j) for j in range(1, 24)] + [(i, j) for i in range(1, 23) for j in rng.sample([x for x in range(24) if x != i], 1 + i % 4)]
    out = moran.local_moran(spark.createDataFrame(list(enumerate(values)), "site long, value double"),
                            spark.createDataFrame(edges, "site long, neighbour long"), rounds=49, seed=3, split_rows=split_rows).collect()
    assert {r["site"]: r["p_value"] for r in out} == local_loop(values, edges, 49, 3)


def test_local_moran_makes_no_pairs_of_sites_and_rounds(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(moran, "place", lambda *a, inverse=False, **kw: asked.append(inverse) or bijection.place(*a, inverse=inverse, **kw))
    # Few different values, so that many rounds tie with the index of a site.
    values = [float(i % 3) for i in range(40)]
    edges = [(i, (i + d) % 40) for i in range(40) for d in (1, 2, 5)]
    out = moran.local_moran(spark.createDataFrame(list(enumerate(values)), "site long, value double"),
                            spark.createDataFrame(edges, "site long, neighbour long"), rounds=49, seed=3).collect()
    assert asked == [True]
    wanted = local_loop(values, edges, 49, 3)
    assert {r["site"]: r["p_value"] for r in out} == pytest.approx(wanted)


def golden(name):
    path = os.environ.get(name)
    if not path:
        pytest.skip(f"{name} names no file")
    return path


def test_published_grid_index(spark):
    """69 cells of one week: I = 0.6272 with four isolated cells."""
    cells = spark.read.option("header", True).option("inferSchema", True).csv(golden("PLUMBLINE_GRID_CSV"))
    edges = neighbours.adjacency(cells, 50.0, key="hex").withColumnRenamed("hex", "site")
    row = moran.global_moran(cells.select(F.col("hex").alias("site"), F.col("bad_frac").alias("value")), edges).first()
    assert round(row["morans_i"], 4) == 0.6272 and row["n_isolates"] == 4


def test_published_site_index(spark):
    """136 sites, five neighbours: I = 0.686 and 65 significant sites."""
    raw = spark.read.option("header", True).option("inferSchema", True).csv(golden("PLUMBLINE_SITES_CSV"))
    level = next(c for c in raw.columns if "severity" in c)
    sites = raw.select(F.monotonically_increasing_id().alias("site"), "lat", "lon", F.col(level).alias("value"))
    edges = neighbours.nearest_sites(sites)
    assert round(moran.global_moran(sites.select("site", "value"), edges).first()["morans_i"], 3) == 0.686
    local = moran.local_moran(sites.select("site", "value"), edges)
    assert abs(local.filter("quadrant > 0").count() - 65) <= 2
