"""Exact centroid clustering whose rounds touch only vectors that may have changed sides: heap-ordered bounds.

A vector's gap is its distance to the second-nearest centroid less that to its own. A round can shrink it by no more than
its own centroid's drift plus the largest drift of the others, which is the same for all vectors of a cluster. So each
cluster keeps a heap of gaps, offset by the drift accumulated when they went in; those that the accumulated drift has
passed are popped and measured again against all centroids, the rest are not looked at.
"""

from __future__ import annotations

import hashlib
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import table
from plumbline.session import ship, stored

COMPONENTS, CLUSTERS, ROUNDS, SEED, SCALE = 64, 40, 5, 2, 256
# Vectors of a block; a block's heaps are rebuilt by one task in each round.
BLOCK = 1 << 12
# Components beyond this have squared distances that no long holds.
LARGEST = 1 << 27
BLOCKS = "ids array<long>, vectors binary, cluster binary, entries binary, popped long, moves array<struct<cluster: int, n: long, sums: array<long>>>"


def _integers(data: bytes, components: int) -> np.ndarray:
    return np.frombuffer(data, np.int32).reshape(-1, components).astype(np.int64)


def _squares(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances (vector, centroid)."""
    return np.stack([((vectors - c) ** 2).sum(1) for c in centroids], 1) if len(vectors) else np.zeros((0, len(centroids)), np.int64)


def _measured(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centroid, gap to the second); equal distances go to the smaller number and have no gap."""
    squares = _squares(vectors, centroids)
    nearest = squares.argmin(1)
    if len(centroids) == 1:
        return nearest, np.full(len(vectors), np.inf)
    roots = np.sqrt(np.partition(squares, 1, axis=1)[:, :2].astype(np.float64))
    # Rounding of the roots and of the drifts must never make a gap look wider than it is.
    return nearest, roots[:, 1] - roots[:, 0] - 1e-9 * (roots.sum(1) + 1)


def _moves(vectors: np.ndarray, old: np.ndarray, new: np.ndarray) -> list[dict]:
    """What each cluster gained or lost by the vectors that changed sides; `old` is -1 for those that come in."""
    out = []
    for c in np.union1d(old[old >= 0], new):
        gained, lost = vectors[new == c], vectors[old == c]
        out.append({"cluster": int(c), "n": len(gained) - len(lost), "sums": (gained.sum(0) - lost.sum(0)).tolist()})
    return out


def _blocks(batches):
    """Rows of up to BLOCK vectors with their ids; no heap yet."""
    ids, parts, held = [], [], 0

    def block():
        return pa.RecordBatch.from_pylist([{"ids": np.concatenate(ids).tolist(), "vectors": np.concatenate(parts).tobytes()}],
                                          pa.schema([("ids", pa.list_(pa.int64())), ("vectors", pa.binary())]))

    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            vectors = np.asarray(part.column("embedding").flatten(), dtype=np.float64).reshape(part.num_rows, -1)
            # A null id stands as the smallest long until the end.
            ids.append(np.asarray(part.column("vec_id").fill_null(np.iinfo(np.int64).min), dtype=np.int64))
            parts.append(np.floor(SCALE * vectors).astype(np.int32))
            held += part.num_rows
            if held >= BLOCK:
                yield block()
                ids, parts, held = [], [], 0
    if held:
        yield block()


ENTRY = np.dtype([("key", "<f8"), ("at", "<i4"), ("cluster", "<i4")])


def _round(centroids: list[list[int]], offsets: list[float] | None):
    """One assignment of the blocks. `offsets` is each cluster's accumulated drift; None in the first round."""
    now = np.array(centroids, np.int64)

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                vectors = _integers(row["vectors"], now.shape[1])
                if offsets is None:
                    old = np.full(len(vectors), -1, np.int32)
                    heaps, due = [[] for _ in now], list(range(len(vectors)))
                else:
                    old = np.frombuffer(row["cluster"], np.int32)
                    heaps, due = [[] for _ in now], []
                    for key, at, cluster in np.frombuffer(row["entries"], ENTRY).tolist():
                        heaps[cluster].append((key, at))  # stored in heap order
                    for heap, offset in zip(heaps, offsets, strict=True):
                        while heap and heap[0][0] <= offset:
                            due.append(heappop(heap)[1])
                due = np.array(due, np.int64)
                nearest, gap = _measured(vectors[due], now)
                new = old.copy()
                new[due] = nearest
                base = offsets or [0.0] * len(now)
                for at, cluster, width in zip(due.tolist(), nearest.tolist(), gap.tolist(), strict=True):
                    heaps[cluster].append((width + base[cluster], at)) if offsets is None else heappush(heaps[cluster], (width + base[cluster], at))
                if offsets is None:
                    for heap in heaps:
                        heapify(heap)
                entries = np.array([(key, at, c) for c, heap in enumerate(heaps) for key, at in heap], ENTRY)
                changed = new != old
                out.append({"ids": row["ids"], "vectors": row["vectors"], "cluster": new.tobytes(), "entries": entries.tobytes(), "popped": len(due),
                            "moves": _moves(vectors[changed], old[changed], new[changed])})
            move = pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])
            yield pa.RecordBatch.from_pylist(out, pa.schema([("ids", pa.list_(pa.int64())), ("vectors", pa.binary()), ("cluster", pa.binary()),
                                                             ("entries", pa.binary()), ("popped", pa.int64()), ("moves", pa.list_(move))]))
    return run


def _distances(centroids: list[list[int]]):
    now = np.array(centroids, np.int64)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                vectors, cluster = _integers(row["vectors"], now.shape[1]), np.frombuffer(row["cluster"], np.int32)
                ids = np.array(row["ids"], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=ids == np.iinfo(np.int64).min), pa.array(cluster),
                                                  pa.array(((vectors - now[cluster]) ** 2).sum(1))], ["vec_id", "cluster", "distance"])
    return run


def cluster(rows: DataFrame, components: int = COMPONENTS, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """Rows (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), one for each kept vector.

    Kept are vectors of exactly `components` components, none null or non-finite. Fewer kept vectors than `clusters`
    make as many centroids; repeated rows are rows of their own, equal ids start in the order of their vectors, a null id
    is hashed as ''; an empty table gives no rows and other columns are not read. A component of 2**27 or more after
    scaling is an error, since no long holds its squared distances. The driver sees centroids and sums only.
    """
    spark = ship(rows.sparkSession)
    valid = F.expr(f"size(embedding) = {components} AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf'))")
    kept = rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.coalesce(valid, F.lit(False)))
    within = F.expr(f"forall(embedding, x -> abs(x) < {LARGEST // SCALE - 1})")
    kept = kept.withColumn("embedding", F.when(within, F.col("embedding")).otherwise(F.raise_error(F.lit("a component is too large for squared distances in a long"))))
    first = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    starts = kept.orderBy(first, "embedding").limit(clusters).collect()
    if not starts:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = [[int(x) for x in np.floor(SCALE * np.array(r["embedding"]))] for r in starts]
    k = len(centroids)
    state = stored(kept.mapInArrow(_blocks, "ids array<long>, vectors binary"), "vector-blocks")
    counts, sums, offsets = [0] * k, [[0] * components for _ in range(k)], None
    for step in range(rounds + 1):
        state = stored(state.mapInArrow(_round(centroids, offsets), BLOCKS), "heap-blocks")
        if step == rounds:
            break
        move = state.select(F.explode("moves").alias("m")).select("m.cluster", "m.n", F.posexplode("m.sums").alias("at", "x"))
        # A sum over all vectors may pass a long; clusters x components rows come back.
        for r in move.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect():
            sums[r["cluster"]][r["at"]] += int(r["x"])
            counts[r["cluster"]] += r["n"] if r["at"] == 0 else 0
        after = [[s // n for s in own] if n else old for own, n, old in zip(sums, counts, centroids, strict=True)]
        drift = [float(np.sqrt(float(sum((a - b) ** 2 for a, b in zip(x, y, strict=True))))) * (1 + 1e-9) for x, y in zip(after, centroids, strict=True)]
        others = [max(drift[:c] + drift[c + 1:], default=0.0) for c in range(k)]
        offsets = [o + d + m for o, d, m in zip(offsets or [0.0] * k, drift, others, strict=True)]
        centroids = after
    found = stored(state.select("ids", "vectors", "cluster").mapInArrow(_distances(centroids), "vec_id long, cluster int, distance long"), "distances")
    within = {r["cluster"]: int(r["x"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("x")).collect()}
    about = spark.createDataFrame([(c, str(x), str(sum(within.values())), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, x in within.items()],
                                  "cluster int, cluster_inertia string, inertia string, centroid_sha256 string")
    about = about.withColumns({c: F.expr(f"try_cast({c} AS long)") for c in ("cluster_inertia", "inertia")})
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def _sql() -> str:
    """The rounds as one statement: each assigns all vectors, then takes floors of exact means."""
    steps = [f"""
WITH kept AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {COMPONENTS} AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE)))),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), v) - 1 AS c, v AS m FROM kept QUALIFY c < {CLUSTERS})"""]
    for step in range(ROUNDS + 1):
        steps.append(f"""
a{step} AS (
  SELECT vec_id, v, unnest(min(struct_pack(d := d, c := c))) FROM (
    SELECT vec_id, v, c, list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM kept, c{step}) GROUP BY vec_id, v)""")
        if step < ROUNDS:
            steps.append(f"""
s{step} AS (SELECT c, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{step}, range(1, {COMPONENTS + 1}) AS r(i) GROUP BY c, i),
m{step} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM s{step} GROUP BY c),
c{step + 1} AS (SELECT c, coalesce(n.m, o.m) AS m FROM c{step} o LEFT JOIN m{step} n USING (c))""")
    last = ROUNDS
    return ",".join(steps) + f"""
SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{last} JOIN c{last} USING (c)"""


SQL = _sql()
