"""Attributions, stored attributions, tags and calibration against brute force."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from plumbline.operators import attribution, models

FEATURES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows(spark):
    pick = random.Random(5)
    data = []
    for i in range(240):
        x = [pick.gauss(0, 1) for _ in FEATURES]
        data.append((i, *[None if pick.random() < 0.05 else v for v in x], int(x[0] * x[1] + 0.5 * x[2] + pick.gauss(0, 0.5) > 0), i % 4))
    return spark.createDataFrame(data, "id long, a double, b double, c double, d double, y int, fold int").cache()


def expected(tree, at, row, known):
    """Mean value of a tree with only some features known, by walking it."""
    n = tree[at]
    if n["left"] < 0:
        return n["value"]
    if n["feature"] in known:
        return expected(tree, n["left"] if row[n["feature"]] <= n["cut"] else n["right"], row, known)
    return sum(expected(tree, c, row, known) * tree[c]["cover"] for c in (n["left"], n["right"])) / n["cover"]


def brute_shapley(trees, row, size):
    out, d = np.zeros(size), size
    for tree in trees.values():
        for j in range(d):
            for k in range(d):
                for others in itertools.combinations([x for x in range(d) if x != j], k):
                    weight = math.factorial(k) * math.factorial(d - 1 - k) / math.factorial(d)
                    out[j] += weight * (expected(tree, 0, row, {*others, j}) - expected(tree, 0, row, set(others)))
    return out


@pytest.mark.parametrize("kind, rows_block, nodes_block", [("forest", 512, 200_000), ("forest", 30, 60), ("boosted", 100, 40)])
def test_attributions_equal_subset_enumeration(spark, rows, monkeypatch, kind, rows_block, nodes_block):
    monkeypatch.setattr(attribution, "BLOCK_ROWS", rows_block)
    monkeypatch.setattr(attribution, "BLOCK_NODES", nodes_block)
    fit = models.fit_forest(rows, FEATURES, "y", trees=4, depth=7) if kind == "forest" else models.fit_boosted(rows, FEATURES, "y", rounds=3, depth=4)
    scorer = models.Scorer(fit, FEATURES)
    parts, base = attribution.attributions(scorer, rows, ["id"])
    found = {r["id"]: np.array([r[f] for f in FEATURES]) for r in parts.collect()}
    trees = {}
    for n in attribution.nodes(scorer, spark).collect():
        trees.setdefault(n["tree"], {})[n["id"]] = n.asDict()
    score = vector_to_array("probability" if kind == "forest" else "rawPrediction")[1]
    scored = {r["id"]: (np.array([r[f"_x_{f}"] for f in FEATURES]), r["s"]) for r in fit.transform(rows).withColumn("s", score).collect()}
    assert found.keys() == scored.keys()
    for key, (x, s) in scored.items():
        assert found[key].sum() + base == pytest.approx(s, abs=1e-12)
    for key in list(scored)[:25]:
        assert found[key] == pytest.approx(brute_shapley(trees, scored[key][0], 4), abs=1e-12)


def test_rows_and_trees_meet_without_copies_of_either(spark, rows, monkeypatch):
    monkeypatch.setattr(attribution, "BLOCK_ROWS", 30)
    monkeypatch.setattr(attribution, "BLOCK_NODES", 20)
    parts, _ = attribution.attributions(models.Scorer(models.fit_forest(rows, FEATURES, "y", trees=4, depth=6), FEATURES), rows, ["id"])
    plan = parts._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan


def test_small_subtrees_are_worked_out_by_their_ways(spark, rows, monkeypatch):
    fit = models.fit_forest(rows, FEATURES, "y", trees=1, depth=12)
    packed = attribution._pack_trees(attribution.nodes(models.Scorer(fit, FEATURES), spark).toArrow())
    columns = {c: np.frombuffer(packed[c][0].as_buffer(), k) for c, k in attribution.NODE_KINDS.items()}
    values = np.random.default_rng(1).normal(size=(len(FEATURES), 3000))
    calls, down = [], attribution.Tree.down

    def counted(self, at, product, *args):
        calls.append(len(product))
        return down(self, at, product, *args)

    monkeypatch.setattr(attribution.Tree, "down", counted)
    found = []
    for most in (0, attribution.UNIT_NODES):
        monkeypatch.setattr(attribution, "UNIT_NODES", most)
        calls.clear()
        found.append(np.zeros(values.shape))
        attribution.Tree(columns).contributions(values, found[-1])
        visits = sum(n == 3000 for n in calls)
    assert len(columns["left"]) > 60 and visits < len(columns["left"]) / 2
    assert found[0] == pytest.approx(found[1], abs=1e-12)


def test_attributions_are_stored_once_for_each_model(spark, rows, tmp_path):
    one, two = (models.Scorer(models.fit_forest(rows, FEATURES, "y", trees=n, depth=3), FEATURES) for n in (2, 3))
    path = str(tmp_path / "kept")
    assert attribution.kept_attributions(one, rows.filter("id < 100"), ["id"], path).count() == 100
    first = {f for f in (tmp_path / "kept").rglob("*.parquet")}
    assert attribution.kept_attributions(one, rows.filter("id < 100"), ["id"], path).count() == 100
    assert first == {f for f in (tmp_path / "kept").rglob("*.parquet")}
    both = attribution.kept_attributions(one, rows, ["id"], path)
    assert both.count() == both.select("id").distinct().count() == 240
    assert attribution.kept_attributions(two, rows.filter("id < 10"), ["id"], path).count() == 10
    assert {r["model"]: r["n"] for r in spark.read.parquet(path).groupBy("model").agg(F.count("*").alias("n")).collect()} == {one.tag: 240, two.tag: 10}


def test_tag_changes_with_whatever_changes_a_score(spark, rows, tmp_path):
    scorer = models.stamped(models.Scorer(models.fit_forest(rows, FEATURES, "y", trees=2, depth=3), FEATURES, 0.52), spark)
    models.save(scorer, str(tmp_path / "m"))
    again = models.load(spark, str(tmp_path / "m"))
    again.facts.clear()
    assert models.stamped(again, spark).tag == scorer.tag and "+t0.5200+f" in scorer.tag and scorer.tag.startswith("1+")
    for other in (models.Scorer(scorer.pipeline, FEATURES, 0.53), models.Scorer(scorer.pipeline, FEATURES[::-1], 0.52),
                  models.Scorer(models.fit_forest(rows, FEATURES, "y", trees=2, depth=3, seed=1), FEATURES, 0.52)):
        assert models.stamped(other, spark).tag != scorer.tag


def platt(raw, y):
    """Newton steps on the smoothed targets."""
    n1, n0 = y.sum(), (1 - y).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    w = np.zeros(2)
    x = np.stack([raw, np.ones(len(raw))], 1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x, x.T @ (p - t))
    return w


def pooled(raw, y):
    """Least-squares monotone fit by the min-max formula over distinct scores."""
    at, back, n = np.unique(raw, return_inverse=True, return_counts=True)
    s = np.bincount(back, y)
    sums, counts = np.concatenate([[0], np.cumsum(s)]), np.concatenate([[0], np.cumsum(n)])
    fit = [max(min((sums[b + 1] - sums[a]) / (counts[b + 1] - counts[a]) for b in range(i, len(at))) for a in range(i + 1)) for i in range(len(at))]
    return at, np.array(fit)


@pytest.mark.parametrize("method", ["sigmoid", "isotonic"])
def test_calibrators_equal_plain_fits(spark, method):
    draw = np.random.default_rng(2)
    raw = np.round(draw.random(150), 2)
    y = (draw.random(150) < raw ** 2).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(raw, y)], "_raw double, y int").repartition(4)
    asked = np.linspace(0.01, 0.99, 40)
    model = models._calibrator(df, "y", method)
    out = models._apply(model, spark.createDataFrame([(float(a), float(a)) for a in asked], "_raw double, at double"), method, "c").orderBy("at").collect()
    if method == "sigmoid":
        w = platt(raw, y)
        wanted = 1 / (1 + np.exp(-(w[0] * asked + w[1])))
    else:
        at, fit = pooled(raw, y)
        wanted = np.interp(asked, at, fit)
    assert [r["c"] for r in out] == pytest.approx(wanted, abs=1e-5)
    assert all(a["c"] <= b["c"] + 1e-12 for a, b in zip(out, out[1:]))


def test_calibrated_scores_are_nested_and_one_per_row(spark, rows):
    seen = []

    def fit(part):
        seen.append(frozenset(r["fold"] for r in part.select("fold").distinct().collect()))
        return models.fit_forest(part, FEATURES, "y", trees=3, depth=3)

    out = models.calibrated(rows, "fold", 4, "y", fit).collect()
    assert sorted(r["id"] for r in out) == list(range(240)) and all(0 <= r["calibrated"] <= 1 for r in out)
    assert sorted(map(sorted, seen)) == sorted(sorted({0, 1, 2, 3} - {i, j}) for i in range(4) for j in range(i))
