"""Approximate nearest neighbours by cosine: a forest of sorted hash strings with variable-length prefixes.

The different vectors are dealt into shards of about SHARD rows by their hash. A task holds one shard as TREES sorted
arrays of long hash strings and searches one block of queries in it: in each tree it descends to the longest prefix that
a query shares with an entry, then all trees ascend together, a bit at a time, until they hold FOUND entries with equal
prefixes. Those are measured exactly. Each shard is searched to the same depth, so recall doesn't fall as rows are added.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import table
from plumbline.session import ship, stored

QUERY_EVERY, NEAREST = 50, 5
# Rows of a shard, queries of a block, trees, symbols of a string, axes that a symbol is taken from.
SHARD, BLOCK, TREES, SYMBOLS, AXES = 1 << 13, 1 << 13, 32, 4, 64
# Entries, repeats in several trees included, that end the ascent in a shard.
FOUND = 6000
HITS = "q1 long, q2 long, k1 long, k2 long, least long, score double"


@lru_cache(maxsize=8)
def _turns(dimension: int) -> np.ndarray:
    """Orthonormal axes for each tree and symbol, the same in every task."""
    draw = np.random.default_rng(dimension)
    axes = min(dimension, AXES)
    turns = [np.linalg.qr(draw.standard_normal((dimension, axes)))[0] for _ in range(TREES * SYMBOLS)]
    return np.stack(turns).reshape(TREES, SYMBOLS, dimension, axes).astype(np.float32)


def strings(vectors: np.ndarray) -> tuple[np.ndarray, int]:
    """Hash strings (tree, vector) and their bits. A symbol is the axis that a turned vector is closest to, and its side."""
    turns = _turns(vectors.shape[1])
    bits = max(1, int(2 * turns.shape[3] - 1).bit_length())
    unit = (vectors / np.sqrt((vectors * vectors).sum(1))[:, None]).astype(np.float32)
    out = np.zeros((TREES, len(unit)), np.int64)
    for tree in range(TREES):
        for symbol in range(SYMBOLS):
            at = unit @ turns[tree, symbol]
            axis = np.abs(at).argmax(1)
            out[tree] = (out[tree] << bits) | (2 * axis + (at[np.arange(len(at)), axis] > 0))
    return out, bits * SYMBOLS


def _scaled(columns: pa.ChunkedArray, dimension: int) -> np.ndarray:
    """The vectors as doubles, each times a power of two, so that no square overflows and no cosine changes."""
    flat = columns.combine_chunks().flatten()
    vectors = np.asarray(flat, dtype=np.float64).reshape(-1, dimension)
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(1, initial=0))[1][:, None])


def _shared(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Length of the common prefix of strings."""
    return bits - np.frexp((a ^ b).astype(np.float64))[1]


class Forest:
    """The sorted arrays of one shard."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        hashes, self.bits = strings(vectors)
        self.order = np.argsort(hashes, axis=1, kind="stable")
        self.sorted = np.take_along_axis(hashes, self.order, 1)

    def spans(self, queries: np.ndarray, found: int) -> tuple[np.ndarray, np.ndarray]:
        """For each tree and query the entries [low, high) that share the prefix at which the ascent ended."""
        asked, n = strings(queries)[0], self.sorted.shape[1]
        longest = np.zeros(len(queries), np.int64)
        for own, mine in zip(self.sorted, asked, strict=True):
            at = np.searchsorted(own, mine)
            for near in (np.maximum(at - 1, 0), np.minimum(at, n - 1)):
                longest = np.maximum(longest, _shared(own[near], mine, self.bits))
        low, high = (np.zeros(asked.shape, np.int32) for _ in range(2))
        active, level = np.arange(len(queries)), longest
        while len(active):
            shift = self.bits - level[active]
            for tree, own in enumerate(self.sorted):
                prefix = asked[tree, active] >> shift
                low[tree, active] = np.searchsorted(own, prefix << shift)
                high[tree, active] = np.searchsorted(own, (prefix + 1) << shift)
            held = (high[:, active] - low[:, active]).sum(0)
            active = active[(held < found) & (level[active] > 0)]
            level[active] -= 1
        return low, high

    def candidates(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        marked = np.zeros(len(self.vectors), bool)
        for order, a, b in zip(self.order, low, high, strict=True):
            marked[order[a:b]] = True
        return np.flatnonzero(marked)


def cosines(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Row by row in one fixed order, so equal vectors have equal scores."""
    return (vectors * query).sum(1) / (np.sqrt((vectors * vectors).sum(1)) * np.sqrt((query * query).sum()))


def _searcher(best: int, found: int):
    def search(key, rows: pa.Table, queries: pa.Table) -> pa.Table:
        out = [[] for _ in range(6)]
        if rows.num_rows and queries.num_rows:
            dimension = key[0].as_py()
            forest, asked = Forest(_scaled(rows.column("embedding"), dimension)), _scaled(queries.column("q_embedding"), dimension)
            lengths = np.sqrt((forest.vectors ** 2).sum(1))
            k1, k2 = (np.asarray(rows.column(c), dtype=np.int64) for c in ("k1", "k2"))
            least = np.asarray(rows.column("least").fill_null(np.iinfo(np.int64).max), dtype=np.int64)
            keys = np.stack([np.asarray(queries.column(c), dtype=np.int64) for c in ("q1", "q2")], 1)
            low, high = forest.spans(asked, found)
            for at, query in enumerate(asked):
                near = forest.candidates(low[:, at], high[:, at])
                rough = (forest.vectors[near] @ query) / lengths[near]
                if len(near) > best:
                    near = near[rough >= np.partition(rough, -best)[-best] - 1e-9 * np.sqrt(query @ query)]
                score = cosines(forest.vectors[near], query)
                top = np.lexsort((least[near], -score))[:best]
                for column, part in zip(out, (np.full(len(top), keys[at, 0]), np.full(len(top), keys[at, 1]), k1[near[top]], k2[near[top]], least[near[top]], score[top]), strict=True):
                    column.append(part)
        names, kinds = ["q1", "q2", "k1", "k2", "least", "score"], [pa.int64()] * 5 + [pa.float64()]
        return pa.table({n: pa.array(np.concatenate(c) if c else [], t) for n, c, t in zip(names, out, kinds, strict=True)})
    return search


def nearest(rows: DataFrame, queries: int = QUERY_EVERY, most: int = NEAREST, found: int = FOUND) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each vec_id divisible by `queries` its `most` nearest other rows found.

    Vectors that are null, empty, zero or hold null or non-finite components take no part; only vectors of equal length
    are compared. Ties go to the smaller vec_id, null ids (never queries) last. Equal vectors are one entry of the index
    with its `most` + 1 smallest ids, which is all that a result can need. Of repeated rows a query leaves out one, its
    own; an id with several vectors asks once for each. An empty table gives no rows; other columns are not read.
    """
    spark, best = ship(rows.sparkSession), most + 1
    valid = F.expr("embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf')) AND exists(embedding, x -> x <> 0)")
    keyed = (rows.select(F.col("vec_id").cast("long"), "embedding").where(F.coalesce(valid, F.lit(False)))
             .select("vec_id", "embedding", F.xxhash64("embedding").alias("k1"), F.xxhash64(F.lit(12), "embedding").alias("k2")))
    asks = F.coalesce(F.col("vec_id") % queries == 0, F.lit(False))
    vectors = stored(keyed.groupBy("k1", "k2").agg(F.first("embedding").alias("embedding"), F.min("vec_id").alias("least"), F.max(asks).alias("asks"))
                     .withColumn("dimension", F.size("embedding")), "vectors")
    # One row for each length of vector.
    lengths = vectors.groupBy("dimension").agg(F.count("*").alias("n"), F.count_if("asks").alias("asked")).select(
        "dimension", F.ceil(F.col("n") / SHARD).alias("shards"), F.ceil(F.col("asked") / BLOCK).alias("blocks")).where("blocks > 0")
    dealt = vectors.join(F.broadcast(lengths), "dimension")
    index = dealt.select("dimension", F.pmod("k1", "shards").alias("shard"), F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block"), "k1", "k2", "least", "embedding")
    asked = dealt.where("asks").select(F.col("dimension").alias("q_dimension"), F.explode(F.expr("sequence(0L, shards - 1)")).alias("q_shard"),
                                       F.pmod("k2", "blocks").alias("q_block"), F.col("k1").alias("q1"), F.col("k2").alias("q2"), F.col("embedding").alias("q_embedding"))
    hits = (index.groupBy("dimension", "shard", "block").cogroup(asked.groupBy("q_dimension", "q_shard", "q_block"))
            .applyInArrow(_searcher(best, found), HITS))
    by = Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "least")
    hits = hits.withColumn("_rank", F.row_number().over(by)).where(F.col("_rank") <= best)

    of_vector = Window.partitionBy("k1", "k2").orderBy(F.asc_nulls_last("vec_id"))
    members = keyed.select("k1", "k2", "vec_id").withColumn("_rank", F.row_number().over(of_vector)).where(F.col("_rank") <= best).drop("_rank")
    by = Window.partitionBy("q1", "q2").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    lists = (hits.drop("_rank", "least").join(members, ["k1", "k2"]).withColumn("_rank", F.row_number().over(by)).where(F.col("_rank") <= best)
             .groupBy("q1", "q2").agg(F.array_sort(F.collect_list(F.struct("_rank", "vec_id", "score", ((F.col("k1") == F.col("q1")) & (F.col("k2") == F.col("q2"))).alias("same")))).alias("found")))
    own = F.expr("array_position(transform(found, x -> x.same AND x.vec_id = query_id), true) - 1")
    asking = keyed.where(asks).select(F.col("vec_id").alias("query_id"), F.col("k1").alias("q1"), F.col("k2").alias("q2")).distinct()
    return (asking.join(lists, ["q1", "q2"]).withColumn("own", own)
            .select("query_id", F.posexplode(F.expr(f"slice(filter(found, (x, i) -> i <> own), 1, {most})")).alias("at", "x"))
            .select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score")))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
