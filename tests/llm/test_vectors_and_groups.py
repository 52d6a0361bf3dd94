"""op11 to op13 beside brute force on small tables with nulls, empties, repeats, ties and clashing columns."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from plumbline.llm import clustering, divergence, forest

DOCS = "doc_id long, text string, lang string, source string, at long, base string, p int"


def brute_divergence(rows, least, top):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for _, text, lang, source, *_ in rows]
    held, seen = defaultdict(Counter), defaultdict(Counter)
    for lang, source, words in docs:
        held[lang, source].update(words)
        seen[lang].update(set(words))
    kept = {lang: sorted(w for w, d in c.items() if d >= least) for lang, c in seen.items()}
    share = lambda c, n, v: 1 + 1_000_000_000 * (c + 2) // (n + 2 * v)
    f = lambda p, q: (p - q) ** 2 // (p + q)
    out = set()
    for (lang, source), own in held.items():
        terms = kept[lang]
        p = {g: {t: share(c[t], sum(c[x] for x in terms), len(terms)) for t in terms} for g, c in held.items() if g[0] == lang}
        total = Counter(t for g, c in held.items() if g[0] == lang for t in terms for _ in range(c[t]))
        q = {t: share(total[t], sum(total.values()), len(terms)) for t in terms}
        mine = p[lang, source]
        pairs = [(-sum(f(mine[t], p[g][t]) for t in terms), g[1]) for g in p if g[1] != source]
        marks = [(-f(mine[t], q[t]), t) for t in terms if own[t] and mine[t] > q[t]]
        for part, found, most in (("pair", pairs, None), ("term", marks, top)):
            out |= {(lang, source, part, item, -v, k + 1) for k, (v, item) in enumerate(sorted(found, key=lambda x: (x[0], x[1].encode()))[:most])}
    return out


@pytest.fixture(scope="module")
def group_rows():
    pick = random.Random(11)
    words = [f"{a}{b}" for a in "abcdé" for b in ("x", "Y", "zz", "ß")]
    rows = [(i, " ".join(pick.choices(words, k=pick.randint(0, 60))) + "-9." * (i % 3), pick.choice(["en", "de", None]), pick.choice(["s1", "S1", None, "é", "z"]), 1, "b", 2) for i in range(250)]
    rows += [(900, None, "en", "silent", 1, "b", 2), (901, "only once", "fr", "x", 1, "b", 2), (902, None, "fr", "y", 1, "b", 2), (None, "ax " * 30000, "de", "z", 1, "b", 2)]
    return rows + rows[:20]


@pytest.mark.parametrize("least, block", [(10, 1 << 14), (3, 7), (1000, 1 << 14)])
def test_divergence_equals_brute_force(spark, group_rows, monkeypatch, least, block):
    monkeypatch.setattr(divergence, "BLOCK_LEAST", block)
    monkeypatch.setattr(divergence, "BLOCK_MOST", block)
    monkeypatch.setattr(divergence, "FLUSH", 20)
    found = [tuple(r) for r in divergence.divergence(spark.createDataFrame(group_rows, DOCS).repartition(3), least).collect()]
    assert len(found) == len(set(found)) and set(found) == brute_divergence(group_rows, least, 10)


def test_divergence_of_nothing(spark):
    assert divergence.divergence(spark.createDataFrame([], DOCS)).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int, k1 string, least int, cluster string"


def vector_rows(n, size, seed):
    draw = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in draw.standard_normal(size).astype(np.float32)], 0, "k", 1, "c") for i in range(n)]
    return rows, draw


@pytest.fixture(scope="module")
def odd_vectors():
    rows, draw = vector_rows(600, 64, 5)
    same = rows[100][1]
    rows += [(1000 + i, same, 0, "k", 1, "c") for i in range(150)]  # a hot vector, three of its ids are queries
    rows += [rows[50], rows[50], (2000, None, 0, "", 1, ""), (2050, [], 0, "", 1, ""), (2100, [0.0] * 64, 0, "", 1, ""), (2150, [1.0, None] * 32, 0, "", 1, ""),
             (2200, [math.nan] * 64, 0, "", 1, ""), (2250, [math.inf] + [1.0] * 63, 0, "", 1, ""), (2300, [1.0, 2.0], 0, "", 1, ""), (2301, [2.0, 4.0], 0, "", 1, ""), (None, same, 0, "", 1, ""),
             (2350, [1.0, 2.0, 3.0], 0, "", 1, "")]
    return rows


def brute_nearest(rows, every=50, most=5):
    good = [(i, np.array(v, np.float64)) for i, v, *_ in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for at, (i, v) in enumerate(good):
        if i is None or i % every:
            continue
        near = [(-float(forest.cosines(w[None], v)[0]), math.inf if j is None else j) for k, (j, w) in enumerate(good) if k != at and len(w) == len(v)]
        out[i] = [(r + 1, None if j == math.inf else j, -s) for r, (s, j) in enumerate(sorted(near)[:most])]
    return {i: found for i, found in out.items() if found}


def test_nearest_of_small_shards_is_exact(spark, odd_vectors, monkeypatch):
    monkeypatch.setattr(forest, "SHARD", 200)
    monkeypatch.setattr(forest, "BLOCK", 5)
    found = defaultdict(list)
    for r in forest.nearest(spark.createDataFrame(odd_vectors, VECTORS).repartition(3)).collect():
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert {i: sorted(x) for i, x in found.items()} == brute_nearest(odd_vectors)


def test_forest_ascends_to_a_high_recall_without_measuring_all():
    rows, draw = vector_rows(forest.SHARD, 64, 7)
    vectors = np.array([r[1] for r in rows], np.float64)
    own, hit, measured = forest.Forest(vectors), 0, 0
    asked = draw.standard_normal((100, 64))
    low, high = own.spans(asked, forest.FOUND)
    for at, q in enumerate(asked):
        near = own.candidates(low[:, at], high[:, at])
        hit += len(set(np.argsort(-forest.cosines(vectors, q))[:5]) & set(near))
        measured += len(near)
    assert hit / 500 >= 0.9 and measured < 0.7 * 100 * len(vectors)


def test_spans_hold_exactly_the_entries_of_one_prefix():
    rows, draw = vector_rows(500, 8, 9)
    own, asked = forest.Forest(np.array([r[1] for r in rows])), draw.standard_normal((20, 8))
    low, high = own.spans(asked, 400)
    strings = forest.strings(asked)[0]
    for q in range(20):
        shared = np.stack([forest._shared(s, mine[q], own.bits) for s, mine in zip(own.sorted, strings)])
        level = min(shared[t, low[t, q]:high[t, q]].min(initial=own.bits) for t in range(len(shared)))
        held = [(shared[t] >= x).sum() for x in (level, level + 1) for t in range(len(shared))]
        assert sum(held[:len(shared)]) >= 400 > sum(held[len(shared):])
        assert ((high - low)[:, q] == held[:len(shared)]).all()


def test_nearest_of_nothing(spark):
    assert forest.nearest(spark.createDataFrame([], VECTORS)).count() == 0


def brute_clusters(rows, size, k, rounds, seed=2):
    kept = [(i, [math.floor(256 * x) for x in v], v) for i, v, *_ in rows if v and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[2]))
    centroids = [list(r[1]) for r in start[:k]]
    assign = lambda: [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids)) for _, v, _ in kept]
    for _ in range(rounds):
        sides = assign()
        for n in range(len(centroids)):
            own = [v for (_, v, _), (_, c) in zip(kept, sides) if c == n]
            if own:
                centroids[n] = [sum(x) // len(own) for x in zip(*own)]
    sides = assign()
    inertia = Counter()
    for d, c in sides:
        inertia[c] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return Counter((i, c, d, inertia[c], sum(inertia.values()), sha[c]) for (i, _, _), (d, c) in zip(kept, sides))


@pytest.mark.parametrize("size, n, clusters, block", [(64, 600, 40, 100), (2, 400, 40, 64), (1, 60, 40, 1 << 12), (3, 5, 40, 3), (4, 30, 1, 7)])
def test_clusters_equal_brute_force(spark, odd_vectors, monkeypatch, size, n, clusters, block):
    monkeypatch.setattr(clustering, "BLOCK", block)
    rows = vector_rows(n, size, 3)[0] if size != 64 else odd_vectors
    rows = rows + [(9000 + i, [float(i % 2)] * size, 0, "k", 1, "c") for i in range(min(n, 40) if n > 5 else 0)]  # ties
    found = Counter(tuple(r) for r in clustering.cluster(spark.createDataFrame(rows, VECTORS).repartition(3), size, clusters).collect())
    assert found == brute_clusters(rows, size, clusters, clustering.ROUNDS)


def test_clusters_of_nothing_and_of_too_large_components(spark):
    assert clustering.cluster(spark.createDataFrame([(1, None, 0, "", 1, "")], VECTORS)).count() == 0
    with pytest.raises(Exception, match="too large"):
        clustering.cluster(spark.createDataFrame([(1, [1e30] * 64, 0, "", 1, "")], VECTORS)).count()


def test_later_rounds_measure_only_expired_gaps():
    rows, _ = vector_rows(400, 8, 1)
    vectors = np.floor(256 * (np.array([r[1] for r in rows]) * 0.05 + np.repeat(np.eye(8) * 4, 50, axis=0))).astype(np.int32)
    import pyarrow as pa
    batch = pa.RecordBatch.from_pylist([{"ids": list(range(400)), "vectors": vectors.tobytes()}])
    centroids = vectors[::50].tolist()
    first = next(clustering._round(centroids, None)([batch]))
    again = next(clustering._round(centroids, [1.0] * 8)([first]))
    assert first.column("popped").to_pylist() == [400] and again.column("popped").to_pylist()[0] < 20
    assert first.column("cluster") == again.column("cluster")
