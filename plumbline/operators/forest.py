"""Random forest whose trees grow and score in tasks; neither the trees nor the rows pass through the driver.

Values become places between at most BINS - 1 cuts of each feature, one byte each. A node with more than LOCAL_BYTES of
rows is split from counts that are summed over blocks of rows; the rows of a smaller node meet in one task, which grows
all that lies below it. Draws come from keyed hashes of row, tree and node and counts are whole numbers, so a forest does
not depend on how rows are spread or on which way a node was split. Trees are kept as a table of pieces of nodes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import fresh_path, stored

BINS = 32
# Rows that the cuts are taken from (the sample of Spark ML), rows of a packed block, nodes of a piece.
SAMPLE_ROWS, PACKED_ROWS, PIECE_NODES = 10_000, 2048, 4096
# Bytes of rows that one task grows trees from, nodes that it counts at a time.
LOCAL_BYTES, COUNTED_NODES = 64 << 20, 2048
# Rows and nodes that meet in a task that scores; scores are summed as whole numbers of 2**-SCALE_BITS.
SCORED_ROWS, SCORED_NODES, SCALE_BITS = 262_144, 2_000_000, 50
PIECES = "tree int, size int, id binary, feature binary, bin binary, cut binary, n0 binary, n1 binary, gain binary, w0 double, w1 double"
KINDS = {"id": "<i8", "feature": "<i2", "bin": "u1", "cut": "<f8", "n0": "<i8", "n1": "<i8", "gain": "<f8"}
CHANCES = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(14)])


def mixed(x: np.ndarray) -> np.ndarray:
    """Hash of 64-bit numbers (the finisher of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class Plan:
    """What a forest is grown by. `cuts` are those of each feature, `weights` those of the classes."""

    cuts: tuple[np.ndarray, ...]
    weights: tuple[float, float]
    trees: int
    depth: int
    seed: int

    @property
    def tried(self) -> int:
        return math.ceil(math.sqrt(len(self.cuts)))

    def salt(self, tree: int, use: int) -> np.ndarray:
        return mixed(np.array([(self.seed * 0x9E3779B97F4A7C15 + tree * 0xD1B54A32D192ED03 + use) % (1 << 64)], np.uint64))

    def drawn(self, rows: np.ndarray, tree: int) -> np.ndarray:
        """How often a tree takes each row: once on average, by Poisson's law."""
        u = (mixed(rows.view(np.uint64) ^ self.salt(tree, 1)) >> np.uint64(11)).astype(np.float64) * 2.0 ** -53
        return np.searchsorted(CHANCES, u, "right")

    def choice(self, tree: int, ids: np.ndarray) -> np.ndarray:
        """The features that each node tries, in their order."""
        at = mixed(ids.astype(np.uint64) ^ self.salt(tree, 2))[:, None]
        keys = mixed(at + np.arange(1, len(self.cuts) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return np.sort(np.argpartition(keys, self.tried - 1, axis=1)[:, :self.tried], axis=1)

    def counts(self, codes: np.ndarray, y: np.ndarray, drawn: np.ndarray, node: np.ndarray, tried: np.ndarray) -> np.ndarray:
        """Rows by node, tried feature, place and class."""
        m, k = tried.shape
        at = codes[np.arange(len(node))[:, None], tried[node]].astype(np.int64)
        key = ((node[:, None] * k + np.arange(k)) * BINS + at) * 2 + y[:, None]
        return np.bincount(key.ravel(), np.repeat(drawn, k), m * k * BINS * 2).reshape(m, k, BINS, 2)

    def best(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place among the tried features, bin, gain) of each node; a gain of 0 is no split."""
        low = np.cumsum(counts, axis=2)
        all_ = low[:, :, -1:, :]
        low, w = low[:, :, :-1, :], np.array(self.weights)
        left, right, whole = low * w, (all_ - low) * w, all_ * w
        t, tl, tr = whole.sum(3), left.sum(3), right.sum(3)
        with np.errstate(divide="ignore", invalid="ignore"):
            after = (left * left).sum(3) / tl + (right * right).sum(3) / tr
            gain = (after - (whole * whole).sum(3) / t) / t
        gain = np.where((tl > 0) & (tr > 0) & (gain > 1e-12), gain, 0.0).reshape(len(counts), -1)
        at = gain.argmax(1)
        return at // (BINS - 1), at % (BINS - 1), gain[np.arange(len(gain)), at]

    def room(self, ids: np.ndarray) -> np.ndarray:
        """Whether nodes may have children: their depth follows from their number."""
        return ids < 2 ** self.depth - 1

    def grow(self, codes: np.ndarray, y: np.ndarray, rows: np.ndarray, tree: int, root: int) -> dict[str, np.ndarray]:
        """All nodes from `root` down, by number; a node's children are 2 * id + 1 and 2 * id + 2."""
        drawn = self.drawn(rows, tree)
        kept = np.flatnonzero(drawn)
        drawn, node, ids, out = drawn[kept], np.zeros(len(kept), np.int64), np.array([root], np.int64), []
        while len(ids):
            n = np.bincount(node * 2 + y[kept], drawn, 2 * len(ids)).reshape(-1, 2)
            feature, bin_, gain = np.full(len(ids), -1, np.int64), np.zeros(len(ids), np.int64), np.zeros(len(ids))
            open_ = np.flatnonzero((n.min(1) > 0) & self.room(ids))
            place = np.full(len(ids), -1, np.int64)
            place[open_] = np.arange(len(open_))
            node = place[node]
            live = np.flatnonzero(node >= 0)
            live = live[np.argsort(node[live], kind="stable")]
            kept, drawn, node = kept[live], drawn[live], node[live]
            for first in range(0, len(open_), COUNTED_NODES):
                these = open_[first:first + COUNTED_NODES]
                a, b = np.searchsorted(node, [first, first + COUNTED_NODES])
                tried = self.choice(tree, ids[these])
                which, bin_[these], gain[these] = self.best(self.counts(codes[kept[a:b]], y[kept[a:b]], drawn[a:b], node[a:b] - first, tried))
                feature[these] = np.where(gain[these] > 0, tried[np.arange(len(these)), which], -1)
            out.append((ids, feature, bin_, n, gain))
            split = open_[feature[open_] >= 0]
            place = np.full(len(open_), -1, np.int64)
            place[np.searchsorted(open_, split)] = np.arange(len(split))
            node = place[node]
            live = np.flatnonzero(node >= 0)
            kept, drawn, node = kept[live], drawn[live], node[live]
            high = codes[kept, feature[split][node]] > bin_[split][node]
            node = node * 2 + high
            ids = (2 * ids[split][:, None] + [1, 2]).ravel()
        ids, feature, bin_, n, gain = (np.concatenate(c) for c in zip(*out, strict=True))
        return {"id": ids, "feature": feature, "bin": bin_, "n0": n[:, 0], "n1": n[:, 1], "gain": gain}

    def pieces(self, tree: int, found: dict[str, np.ndarray]) -> list[dict]:
        """Rows of the table of pieces."""
        widths = max(1, *map(len, self.cuts))
        cuts = np.stack([np.pad(c, (0, widths - len(c)), constant_values=np.nan) for c in self.cuts])
        found = found | {"cut": np.where(found["feature"] >= 0, cuts[found["feature"], np.minimum(found["bin"], widths - 1)], np.nan)}
        return [{"tree": tree, "size": len(found["id"][at:at + PIECE_NODES]), "w0": self.weights[0], "w1": self.weights[1],
                 **{c: found[c][at:at + PIECE_NODES].astype(k).tobytes() for c, k in KINDS.items()}}
                for at in range(0, len(found["id"]), PIECE_NODES)]


PIECE_SCHEMA = pa.schema([("tree", pa.int32()), ("size", pa.int32()), *((c, pa.binary()) for c in KINDS), ("w0", pa.float64()), ("w1", pa.float64())])


def unpacked(batch, features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, classes, hashes) of the rows of packed blocks."""
    codes, y, rows = (np.frombuffer(b"".join(batch.column(c).to_pylist()), k) for c, k in (("codes", "u1"), ("y", "u1"), ("rows", "<i8")))
    return codes.reshape(-1, features), y, rows


def coded(values: pa.Array, cuts: tuple[np.ndarray, ...]) -> np.ndarray:
    """Places of values among the cuts: at most b if the value is not above cut b."""
    x = np.asarray(values.flatten(), np.float64).reshape(-1, len(cuts))
    return np.stack([np.searchsorted(c, x[:, i], "left") for i, c in enumerate(cuts)], axis=1).astype(np.uint8)


def _cuts(ready: DataFrame, values, key, width: int) -> tuple[np.ndarray, ...]:
    sample = ready.select(values.alias("x"), key.alias("h")).orderBy("h").limit(SAMPLE_ROWS).select("x").toArrow()["x"]
    x = np.asarray(sample.combine_chunks().flatten(), np.float64).reshape(-1, width)
    out = []
    for column in x.T:
        distinct = np.unique(column)
        if len(distinct) > BINS:
            out.append(np.unique(np.quantile(column, np.arange(1, BINS) / BINS, method="lower")))
        else:
            out.append((distinct[1:] + distinct[:-1]) / 2)
    return tuple(out)


def _packed(ready: DataFrame, values, key, label: str, cuts: tuple[np.ndarray, ...]) -> DataFrame:
    def pack(batches):
        last, before = None, 0
        for batch in batches:
            for at in range(0, batch.num_rows, PACKED_ROWS):
                part = batch.slice(at, PACKED_ROWS)
                h = np.asarray(part.column("h"), np.int64)
                # Copies of a row follow each other and are drawn apart by their place among them.
                place = np.arange(len(h)) - np.searchsorted(h, h, "left") + np.where(h == last, before, 0)
                last, before = h[-1], int(place[-1]) + 1
                apart = h.view(np.uint64) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                yield pa.RecordBatch.from_pydict({"codes": [coded(part.column("x"), cuts).tobytes()], "y": [np.asarray(part.column("y"), np.uint8).tobytes()],
                                                  "rows": [apart.tobytes()]})

    rows = ready.select(values.alias("x"), key.alias("h"), F.col(label).cast("int").alias("y")).repartition("h").sortWithinPartitions("h")
    return stored(rows.mapInArrow(pack, "codes binary, y binary, rows binary"), "forest-rows")


def _top(blocks: DataFrame, plan: Plan, most: int) -> tuple[list[dict[int, tuple]], list[tuple[int, int]]]:
    """Splits (and leaves) of nodes with more than `most` rows, for each tree, and the smaller nodes below them."""
    found, open_, small, width = [{} for _ in range(plan.trees)], {t: [0] for t in range(plan.trees)}, [], len(plan.cuts)
    while open_:
        def count(batches, open_=open_, found=found):
            sums: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                codes, y, rows = unpacked(batch, width)
                for tree, ids in open_.items():
                    drawn, at, ids = plan.drawn(rows, tree), routed(codes, found[tree]), np.array(ids, np.int64)
                    node = np.minimum(np.searchsorted(ids, at), len(ids) - 1)
                    held = np.flatnonzero((drawn > 0) & (ids[node] == at))
                    counts = plan.counts(codes[held], y[held], drawn[held], node[held], plan.choice(tree, ids))
                    for i, c in zip(ids.tolist(), counts, strict=True):
                        sums[tree, i] = sums[tree, i] + c if (tree, i) in sums else c
            if sums:
                yield pa.RecordBatch.from_pydict({"tree": pa.array([t for t, _ in sums], pa.int32()), "id": [i for _, i in sums],
                                                  "counts": [c.tobytes() for c in sums.values()]})

        def choose(group: pa.Table) -> pa.Table:
            counts = sum(np.frombuffer(c, np.float64).reshape(1, plan.tried, BINS, 2) for c in group["counts"].to_pylist())
            tree, id_ = group["tree"][0].as_py(), group["id"][0].as_py()
            which, bin_, gain = (x[0] for x in plan.best(counts))
            low, whole = counts[0, which, :bin_ + 1].sum(0), counts[0, which].sum(0)
            feature = plan.choice(tree, np.array([id_]))[0, which] if gain > 0 and plan.room(np.array([id_]))[0] else -1
            return pa.table({"tree": pa.array([tree], pa.int32()), "id": [id_], "feature": pa.array([feature], pa.int32()), "bin": pa.array([bin_], pa.int32()),
                             "gain": [float(gain) if feature >= 0 else 0.0], **{n: [int(v)] for n, v in zip(("n0", "n1", "l0", "l1"), (*whole, *low), strict=True)}})

        chosen = blocks.mapInArrow(count, "tree int, id long, counts binary").groupBy("tree", "id").applyInArrow(
            choose, "tree int, id long, feature int, bin int, gain double, n0 long, n1 long, l0 long, l1 long").orderBy("tree", "id").collect()
        open_ = {}
        for r in chosen:
            found[r["tree"]][r["id"]] = (r["feature"], r["bin"], r["n0"], r["n1"], r["gain"])
            if r["feature"] >= 0:
                low = r["l0"] + r["l1"]
                for child, n in ((2 * r["id"] + 1, low), (2 * r["id"] + 2, r["n0"] + r["n1"] - low)):
                    if n > most:
                        open_.setdefault(r["tree"], []).append(child)
                    else:
                        small.append((r["tree"], child))
    return found, small


def routed(codes: np.ndarray, splits: dict[int, tuple]) -> np.ndarray:
    """The node that each row comes to."""
    at, ids = np.zeros(len(codes), np.int64), np.array(sorted(i for i, s in splits.items() if s[0] >= 0), np.int64)
    if len(ids):
        feature, bin_ = (np.array([splits[i][k] for i in ids.tolist()], np.int64) for k in (0, 1))
        inner = np.arange(len(codes))
        while len(inner):
            place = np.minimum(np.searchsorted(ids, at[inner]), len(ids) - 1)
            hit = ids[place] == at[inner]
            inner, place = inner[hit], place[hit]
            at[inner] = 2 * at[inner] + 1 + (codes[inner, feature[place]] > bin_[place])
    return at


def fit(ready: DataFrame, features: list[str], label: str, weights: tuple[float, float], trees: int, depth: int, seed: int) -> ForestModel:
    """A forest on the columns `_x_<feature>` (no gaps) and a label of 0 and 1."""
    spark = ready.sparkSession
    values = F.array(*[F.col(f"_x_{f}").cast("double") for f in features])
    key = F.xxhash64(F.lit(seed), F.col(label).cast("int"), *[F.col(f"_x_{f}").cast("double") for f in features])
    width = len(features)
    plan = Plan(_cuts(ready, values, key, width), weights, trees, depth, seed)
    blocks = _packed(ready, values, key, label, plan.cuts)
    rows = blocks.agg(F.sum(F.length("y"))).first()[0] or 0
    most, top = max(1, LOCAL_BYTES // width), []
    if rows <= most:
        lots = min(trees, 6 * spark.sparkContext.defaultParallelism)
        units = [[(t, 0) for t in range(u, trees, lots)] for u in range(lots)]
        sent = blocks.withColumn("unit", F.explode(F.sequence(F.lit(0), F.lit(lots - 1))))
    else:
        found, small = _top(blocks, plan, most)
        units = [[s] for s in sorted(small)]
        for tree, splits in enumerate(found):
            ids = np.array(sorted(splits), np.int64)
            columns = {c: np.array([splits[i][k] for i in ids.tolist()]) for k, c in enumerate(("feature", "bin", "n0", "n1", "gain"))}
            top += plan.pieces(tree, {"id": ids, **columns})

        def send(batches):
            for batch in batches:
                codes, y, rows = unpacked(batch, width)
                last = None
                for unit, [(tree, root)] in enumerate(units):
                    if tree != last:
                        last, at = tree, np.where(plan.drawn(rows, tree) > 0, routed(codes, found[tree]), -1)
                    held = np.flatnonzero(at == root)
                    if len(held):
                        yield pa.RecordBatch.from_pydict({"codes": [codes[held].tobytes()], "y": [y[held].tobytes()], "rows": [rows[held].tobytes()],
                                                          "unit": pa.array([unit], pa.int32())})

        sent = blocks.mapInArrow(send, "codes binary, y binary, rows binary, unit int")

    def grow(group: pa.Table) -> pa.Table:
        codes, y, rows = unpacked(group, width)
        made = [p for tree, root in units[group["unit"][0].as_py()] for p in plan.pieces(tree, plan.grow(codes, y, rows, tree, root))]
        return pa.Table.from_pylist(made, PIECE_SCHEMA)

    # Neighbouring ranges hold the same number of units, so that no task gets several by chance.
    grown = sent.repartitionByRange(max(1, min(len(units), 2000)), "unit").groupBy("unit").applyInArrow(grow, PIECES)
    if top:
        grown = grown.unionByName(spark.createDataFrame(pa.Table.from_pylist(top, PIECE_SCHEMA)))
    path = fresh_path(spark, "forest")
    grown.write.parquet(path)
    return ForestModel(path, features, plan.cuts, trees)


class ForestModel(Model, MLWritable, MLReadable):
    """A forest as a table of pieces of nodes, by its path."""

    def __init__(self, path: str, features: list[str], cuts: tuple[np.ndarray, ...], trees: int):
        super().__init__()
        self.path, self.features, self.cuts, self.trees = path, features, cuts, trees

    def pieces(self) -> DataFrame:
        return SparkSession.active().read.schema(PIECES).parquet(self.path)

    def nodes(self) -> DataFrame:
        """One row for each node; `value` is the share of attack, leaves have no children and no feature."""
        def unpack(batches):
            for batch in batches:
                for p in batch.to_pylist():
                    c = {k: np.frombuffer(p[k], kind) for k, kind in KINDS.items()}
                    inner, cover = c["feature"] >= 0, c["n0"] * p["w0"] + c["n1"] * p["w1"]
                    yield pa.RecordBatch.from_pydict({
                        "tree": pa.array(np.full(p["size"], p["tree"], np.int32)), "id": c["id"], "left": np.where(inner, 2 * c["id"] + 1, -1),
                        "right": np.where(inner, 2 * c["id"] + 2, -1), "feature": c["feature"].astype(np.int32), "cut": c["cut"], "cover": cover,
                        "value": c["n1"] * p["w1"] / np.where(cover > 0, cover, 1), "gain": c["gain"]})

        return self.pieces().mapInArrow(unpack, "tree int, id long, left long, right long, feature int, cut double, cover double, value double, gain double")

    @property
    def featureImportances(self) -> DenseVector:
        """Gains by their rows, as shares of each tree and then of the forest."""
        each = self.nodes().filter("feature >= 0").groupBy("tree", "feature").agg(F.sum(F.col("gain") * F.col("cover")).alias("g"))
        total = each.groupBy("tree").agg(F.sum("g").alias("all"))
        shares = each.join(total, "tree").groupBy("feature").agg(F.sum(F.col("g") / F.col("all")).alias("s")).collect()
        out = np.zeros(len(self.features))
        for r in shares:
            out[r["feature"]] = r["s"]
        return Vectors.dense(out / out.sum() if out.sum() else out)

    def _transform(self, df: DataFrame) -> DataFrame:
        """Adds `probability`: the mean share of both classes in the leaves that a row comes to."""
        spark, cuts, scale = df.sparkSession, self.cuts, 1 << SCALE_BITS
        kept = stored(df.withColumn("_row", F.monotonically_increasing_id()), "scored")
        facts = self.pieces().agg(F.sum("size")).first()[0] or 0
        blocks = max(1, -(-kept.count() // SCORED_ROWS))
        parts = min(self.trees, max(-(-facts // SCORED_NODES), -(-4 * spark.sparkContext.defaultParallelism // blocks)))

        def code(batches):
            for batch in batches:
                rows = coded(batch.column("x"), cuts)
                yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array([r.tobytes() for r in rows], pa.binary())], ["_row", "codes"])

        values = F.array(*[F.col(f"_x_{f}").cast("double") for f in self.features]).alias("x")
        rows = kept.select("_row", values).mapInArrow(code, "_row long, codes binary").select(
            "*", F.pmod(F.xxhash64("_row"), F.lit(blocks)).cast("int").alias("_block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part"))
        trees = self.pieces().drop("size", "cut", "gain").select(
            "*", F.pmod("tree", F.lit(parts)).cast("int").alias("_trees"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_rows"))

        def score(_, left: pa.Table, right: pa.Table) -> pa.Table:
            total = np.zeros(left.num_rows, np.int64)
            if left.num_rows:
                codes = np.frombuffer(b"".join(left["codes"].to_pylist()), np.uint8).reshape(-1, len(cuts))
                of = np.asarray(right["tree"])
                for tree in np.unique(of):
                    own = right.take(np.flatnonzero(of == tree))
                    c = {k: np.frombuffer(b"".join(own[k].to_pylist()), KINDS[k]) for k in ("id", "feature", "bin", "n0", "n1")}
                    order = np.argsort(c["id"], kind="stable")
                    c = {k: v[order] for k, v in c.items()}
                    w0, w1 = own["w0"][0].as_py(), own["w1"][0].as_py()
                    value = np.rint(c["n1"] * w1 / np.maximum(c["n0"] * w0 + c["n1"] * w1, 1e-300) * scale).astype(np.int64)
                    below = np.searchsorted(c["id"], 2 * c["id"] + 1)
                    at, inner = np.zeros(len(codes), np.int64), np.arange(len(codes))
                    while len(inner):
                        inner = inner[c["feature"][at[inner]] >= 0]
                        here = at[inner]
                        at[inner] = below[here] + (codes[inner, c["feature"][here]] > c["bin"][here])
                    total += value[at]
            return pa.table({"_row": left["_row"], "_sum": total})

        sums = rows.groupBy("_block", "_part").cogroup(trees.groupBy("_rows", "_trees")).applyInArrow(score, "_row long, _sum long")
        share = F.col("_sum") / F.lit(float(scale * self.trees))
        scores = stored(sums.groupBy("_row").agg(F.sum("_sum").alias("_sum")), "scores")
        return kept.join(scores, "_row").withColumn("probability", array_to_vector(F.array(1 - share, share))).drop("_row", "_sum")

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: ForestModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        m = self.model
        DefaultParamsWriter.saveMetadata(m, path, self.sparkSession, extraMetadata={
            "features": m.features, "trees": m.trees, "cuts": [[float(v).hex() for v in c] for c in m.cuts]})
        m.pieces().write.parquet(f"{path}/data")


class _Reader(MLReader):
    def load(self, path: str) -> ForestModel:
        facts = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        cuts = tuple(np.array([float.fromhex(v) for v in c]) for c in facts["cuts"])
        return ForestModel(f"{path}/data", facts["features"], cuts, facts["trees"])._resetUid(facts["uid"])
