"""Quality rules and monotone gradient-boosted trees over document statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import slices, table
from plumbline.session import ship

SYMBOLS = frozenset("#*$%&|<>")
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
# Shares the trees see, and how the score may move as each grows: -1 only down, 0 either way.
FEATURES = {"words": 0, "mean_length": 0, "symbols": -1, "dup_lines": -1, "repeats": -1, "capitals": -1, "punctuation": 0}
# Bound of the labelled rows the trees are fitted on.
FIT_ROWS = 20_000
TREES, DEPTH, RATE, BINS = 40, 3, 0.2, 32


def repeated(words: list[bytes], size: int = 5) -> int:
    """Words inside windows of `size` words that occur twice or more."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    code = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    key = code[:n]
    for k in range(1, size):
        _, key = np.unique(key * (len(ids) + 1) + code[k:n + k], return_inverse=True)
    hit = np.bincount(key)[key] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def statistics(text: str) -> tuple[list[int], list[float]]:
    raw = text.encode()
    words = raw.split()
    seen, dup = set(), 0
    for line in raw.split(b"\n"):
        if line.split(None, 1):
            dup += line in seen
            seen.add(line)
    chars = len(b"".join(words).decode())
    symbols = sum(map(text.count, SYMBOLS))
    again = repeated(words)
    n, c = max(len(words), 1), max(chars, 1)
    capitals = sum(w.isupper() and len(w) > 1 for w in text.split()) / n
    ends = sum(w[-1:] in b".!?," for w in words) / n
    return [len(words), chars, symbols, dup, again], [min(len(words), 1000), chars / n, symbols / c, dup / n, again / n, capitals, ends]


class Trees:
    """Boosted trees as flat node arrays: feature (-1 at a leaf), threshold, left child, value."""

    def __init__(self, x: np.ndarray, y: np.ndarray, signs: list[int]):
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T] if len(x) else []
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], 1) if len(x) else None
        self.bias = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        score, self.trees = np.full(len(y), self.bias), []
        for _ in range(TREES if len(np.unique(y)) > 1 else 0):
            p = 1 / (1 + np.exp(-score))
            nodes: list[list[float]] = []
            self._grow(nodes, binned, edges, p - y, np.maximum(p * (1 - p), 1e-6), np.arange(len(y)), 0, -np.inf, np.inf, signs)
            tree = tuple(np.array(c, t) for c, t in zip(zip(*nodes), (np.int32, float, np.int32, float)))
            self.trees.append(tree)
            score += RATE * self._one(tree, x)

    def _grow(self, nodes, binned, edges, g, h, rows, depth, low, high, signs) -> None:
        """Children stay on their side of the middle of a constrained split, so the whole tree is monotone."""
        at, best = len(nodes), None
        total_g, total_h = g[rows].sum(), h[rows].sum()
        nodes.append([-1, 0.0, 0, float(np.clip(-total_g / (total_h + 1), low, high))])
        for f, cuts in enumerate(edges if depth < DEPTH else []):
            part = binned[rows, f]
            lg, lh = (np.cumsum(np.bincount(part, v[rows], len(cuts) + 1))[:-1] for v in (g, h))
            lv, rv = np.clip(-lg / (lh + 1), low, high), np.clip(-(total_g - lg) / (total_h - lh + 1), low, high)
            gain = lg * lv + (lh + 1) * lv ** 2 / 2 + (total_g - lg) * rv + (total_h - lh + 1) * rv ** 2 / 2
            gain[(lh < 1) | (total_h - lh < 1) | (signs[f] * (rv - lv) < 0)] = np.inf
            k = int(np.argmin(gain)) if len(gain) else 0
            if len(gain) and (best is None or gain[k] < best[0]):
                best = (gain[k], f, k, float(lv[k]), float(rv[k]))
        if best is None or not best[0] < -total_g ** 2 / (total_h + 1) / 2 - 1e-6:
            return
        _, f, k, lv, rv = best
        left = binned[rows, f] <= k
        middle = (lv + rv) / 2
        bounds = ((low, high), (low, high)) if not signs[f] else ((low, middle), (middle, high)) if signs[f] > 0 else ((middle, high), (low, middle))
        nodes[at][:3] = [f, float(edges[f][k]), 0]
        self._grow(nodes, binned, edges, g, h, rows[left], depth + 1, *bounds[0], signs)
        nodes[at][2] = len(nodes)
        self._grow(nodes, binned, edges, g, h, rows[~left], depth + 1, *bounds[1], signs)

    @staticmethod
    def _one(tree, x: np.ndarray) -> np.ndarray:
        feature, cut, right, value = tree
        node = np.zeros(len(x), np.int64)
        for _ in range(DEPTH):
            f = feature[node]
            go = x[np.arange(len(x)), np.maximum(f, 0)] <= cut[node]
            node = np.where(f < 0, node, np.where(go, node + 1, right[node]))
        return value[node]

    def predict(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.bias)
        for tree in self.trees:
            score += RATE * self._one(tree, x)
        return 1 / (1 + np.exp(-score))


def _measured(batches, trees=None):
    for batch in slices(batches, "text"):
        found = [statistics(t or "") for t in batch.column("text").to_pylist()]
        stats = np.array([s for s, _ in found], np.int64).reshape(-1, len(STATS))
        x = np.array([v for _, v in found], float).reshape(-1, len(FEATURES))
        columns = dict(zip(batch.schema.names, batch.columns)) | {f"_{n}": pa.array(stats[:, i]) for i, n in enumerate(STATS)}
        columns["_x"] = pa.array(x.tolist(), pa.list_(pa.float64()))
        columns["_score"] = pa.array(trees.predict(x) if trees else np.zeros(len(x)))
        yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _schema(schema):
    return T.StructType([*schema.fields, *(T.StructField(f"_{n}", T.LongType()) for n in STATS),
                         T.StructField("_x", T.ArrayType(T.DoubleType())), T.StructField("_score", T.DoubleType())])


def fit(docs: DataFrame, labels: DataFrame) -> Trees:
    """Trees from at most FIT_ROWS labelled rows, taken in the order of their hash. Null labels are left out."""
    known = (labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS))
    rows = docs.select("doc_id", "text").join(known, "doc_id")
    rows = rows.mapInArrow(_measured, _schema(rows.schema)).select("doc_id", "_x", "quality").dropDuplicates(["doc_id"]).limit(FIT_ROWS).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["_x"]))
    return Trees(np.array([r["_x"] for r in rows], float).reshape(-1, len(FEATURES)), np.array([float(r["quality"]) for r in rows]), list(FEATURES.values()))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds the statistics, `_score`, `base_failed` and `kept` (score of a half or more) to the rows. Null texts have no words."""
    ship(docs.sparkSession)
    trees = fit(docs, labels)
    out = docs.mapInArrow(lambda batches: _measured(batches, trees), _schema(docs.schema))
    failed = (F.col("_n_words") < 10) | (100 * F.col("_n_repeat_words") > 20 * F.col("_n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("_score") >= 0.5))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", *(F.col(f"_{n}").alias(n) for n in STATS), "base_failed", "kept", F.round("_score", 6).alias("score"))
