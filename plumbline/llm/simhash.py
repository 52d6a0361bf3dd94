"""SimHash near-duplicates: pivot distance tables discard pairs, survivors are verified."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import drop_shuffles, slices, table
from plumbline.session import broadcast_rows, discard, ship, stored

WORDS, SEED, BITS = 4, 42, 4
# Six blocks of bits: fingerprints that differ in at most four bits agree on two blocks at least.
BLOCKS = [(0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10)]
PIVOTS = np.random.default_rng(7).integers(0, 1 << 64, 24, dtype=np.uint64)
TILE = 2048
# Rows of buckets that a task compares at a time, and the longest bucket that is compared step by step.
LOT, RUN = 100_000, 256
# The pipeline's contract: shingles of five words, Jaccard similarity.
SIMILAR_WORDS, SIMILAR = 5, 0.8
# One of so many texts is sampled for frequent shingles; sampled texts that make one frequent; frequent ones at most.
SAMPLED, FREQUENT, LATE_KEYS = 16, 20, 200_000
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None) -> int:
    """Majority bits of the XXH64 of all word shingles, as a signed long. Null and wordless texts are zero."""
    import xxhash

    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length + 1) - 1
    start, k = end - length, min(WORDS, len(words)) - 1
    h = xxhash.xxh64_intdigest
    return _majority(np.array([h(joined[a:b], SEED) for a, b in zip(start[:len(words) - k].tolist(), end[k:].tolist(), strict=True)], np.uint64))


def _majority(codes: np.ndarray) -> int:
    """The bits that over half of the hashes have, as a signed long."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(codes), 1 << 16):
        ones += np.unpackbits(codes[at:at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(codes)).view(">i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, fp) of each row; `mark` is the hash of the text."""
    def run(batches):
        for batch in slices(batches, "text"):
            fps = pa.array([fingerprint(t) for t in batch.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), fps], ["doc_id", "mark", "fp"])

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("mark"), "text").mapInArrow(run, "doc_id long, mark long, fp long")


def _block(column, index: int):
    at, width = BLOCKS[index]
    return F.shiftrightunsigned(column, at).bitwiseAND((1 << width) - 1)


def _pairs(a: np.ndarray, b: np.ndarray, bits: int):
    """Index pairs within `bits`: distances to the pivots first, the fingerprints themselves last."""
    da, db = (np.bitwise_count(x[:, None] ^ PIVOTS).astype(np.int8) for x in (a, b))
    for at in range(0, len(a), 256):
        near = np.abs(da[at:at + 256, None, 0] - db[None, :, 0]) <= bits
        i, j = np.nonzero(near)
        for p in range(1, len(PIVOTS)):
            keep = np.abs(da[at + i, p] - db[j, p]) <= bits
            i, j = i[keep], j[keep]
        keep = np.bitwise_count(a[at + i] ^ b[j]) <= bits
        yield at + i[keep], j[keep]


def _near(codes: np.ndarray, end: np.ndarray, bits: int):
    """Index pairs within `bits` of each row and the later ones of its run, which stops before `end`; pivots first."""
    to = np.bitwise_count(codes[:, None] ^ PIVOTS).astype(np.int8)
    live = np.arange(len(codes))
    for step in range(1, len(codes)):
        live = live[live + step < end[live]]
        if not len(live):
            return
        i = live
        for p in range(len(PIVOTS)):
            i = i[np.abs(to[i, p] - to[i + step, p]) <= bits]
        i = i[np.bitwise_count(codes[i] ^ codes[i + step]) <= bits]
        yield i, i + step


class _Forest:
    """Links of fingerprints reduced to a spanning forest."""

    def __init__(self, fps: np.ndarray):
        self.fps, self.place = np.unique(fps, return_inverse=True)
        self.parent = np.arange(len(self.fps))

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        parent, i, j = self.parent, self.place[i], self.place[j]
        while len(i):
            low = np.minimum(parent[i], parent[j])
            np.minimum.at(parent, parent[i], low)
            np.minimum.at(parent, parent[j], low)
            while (parent != parent[parent]).any():
                parent = parent[parent]
            apart = parent[i] != parent[j]
            i, j = i[apart], j[apart]
        self.parent = parent

    def links(self) -> pa.RecordBatch:
        linked = np.flatnonzero(self.parent != np.arange(len(self.fps)))
        return pa.RecordBatch.from_arrays([pa.array(self.fps[linked]), pa.array(self.fps[self.parent[linked]])], ["a", "b"])


def _reduced(batches):
    """Links of the buckets (or pairs of their tiles) in each lot of rows; the rows of a bucket stand together."""
    def lots():
        held, rows = [], 0
        for batch in batches:
            part = np.stack([np.asarray(batch.column(c), dtype=np.int64) for c in ("bucket", "low", "high", "fp")], 1)
            held.append(part)
            rows += len(part)
            if rows >= LOT:
                whole = np.concatenate(held)
                cut = int(np.flatnonzero((whole[:, :3] != whole[-1, :3]).any(1))[-1:].sum() + 1) if (whole[:, :3] != whole[-1, :3]).any() else 0
                if cut:
                    yield whole[:cut]
                held, rows = [whole[cut:]], len(whole) - cut
        if rows:
            yield np.concatenate(held)

    for lot in lots():
        start = np.flatnonzero(np.r_[True, (lot[1:, :3] != lot[:-1, :3]).any(1)])
        stop = np.r_[start[1:], len(lot)]
        fps, forest = lot[:, 3].copy(), _Forest(lot[:, 3])
        codes = fps.view(np.uint64)
        large = stop - start > RUN
        end = np.repeat(np.where(large, 0, stop), stop - start)
        for i, j in _near(codes, end, BITS):
            forest.add(i, j)
        for x, y in zip(start[large].tolist(), stop[large].tolist()):
            for i, j in _pairs(codes[x:y], codes[x:y], BITS):
                forest.add(x + i, x + j)
        yield forest.links()


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) that join the same fingerprints as all pairs within four bits do.

    Buckets are pairs of equal blocks. A bucket above TILE fingerprints is cut into tiles that meet two at a
    time, so no task holds more than two tiles.
    """
    pairs = list(combinations(range(len(BLOCKS)), 2))
    keys = F.array(*[(F.lit(n).cast("long") * (1 << 24) + _block(F.col("fp"), x) * (1 << 11) + _block(F.col("fp"), y))
                     for n, (x, y) in enumerate(pairs)])
    rows = distinct.select("fp", F.explode(keys).alias("bucket"))
    sizes = stored(rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    own = F.pmod(F.xxhash64("fp"), tiles).cast("int")
    met = (rows.join(sizes, "bucket").withColumn("own", own).withColumn("of", tiles)
           .select("fp", "bucket", "own", F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("other"))
           .withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")))
    met = met.select("bucket", "low", "high", "fp").repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")
    return met.mapInArrow(_reduced, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(fp, root) of every linked fingerprint: alternating large and small stars until nothing changes."""
    def state(rows):
        return rows.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    edges = stored(edges, "links")
    known = state(edges)
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.distinct()
        lowest = stored(down.groupBy("a").agg(F.min("b").alias("m")), "lowest")
        small = (down.join(lowest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(lowest.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        after = stored(small, "stars")
        discard(edges, lowest)
        known, before = state(after), known
        if known == before:
            return after.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "fp")
        edges = after


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, fp, root, component_id) of each row; root names the group, component_id is the smallest doc_id reachable.

    Rows with a null doc_id link like others but name no component (null if the group has no id at all).
    """
    rows = stored(fingerprints(docs), "fingerprints")
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = stored(components(links(distinct)), "roots")
    named = stored(distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "named")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    members = stored(named.join(ids, "root").select("fp", "root", "component_id"), "members")
    return rows.join(members, "fp")


def _one_each(docs: DataFrame, found: DataFrame, group: str) -> DataFrame:
    """One row of each group of (doc_id, mark): that of the smallest doc_id, then mark. Rows without an id stay.

    A row is told by its id and text, so rows that share an id only do not go with each other.
    """
    rows = stored(found.where("doc_id IS NOT NULL").groupBy(group, "doc_id", "mark").agg(F.count("*").alias("n")), "rows")
    first = rows.groupBy(group).agg(F.min(F.struct("doc_id", "mark")).alias("first"))
    kept = stored(rows.join(first, group).select(F.col("doc_id").alias("_doc"), F.col("mark").alias("_of"), "n",
                                                 (F.struct("doc_id", "mark") == F.col("first")).alias("stays")), "kept")
    keyed = docs.withColumn("_mark", F.xxhash64("text"))
    same = (F.col("doc_id").cast("long") == F.col("_doc")) & (F.col("_mark") == F.col("_of"))
    left = keyed.join(kept.where("NOT stays"), same, "left_anti")
    repeated = stored(kept.where("stays AND n > 1"), "repeated")
    if repeated.isEmpty():
        return left.select(*docs.columns)
    once = left.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "_mark"])
    return left.join(repeated, same, "left_anti").union(once).select(*docs.columns)


def deduplicate(docs: DataFrame) -> DataFrame:
    """One document of each group: that of the smallest doc_id. Rows without an id stay, repeated rows appear once."""
    return _one_each(docs, stored(near_duplicates(docs).select("doc_id", "mark", "root"), "groups"), "root")


def shingles(text: str | None, words: int) -> np.ndarray:
    """The different XXH64 of all runs of `words` words, sorted; a shorter text is one run, a wordless one has none."""
    import xxhash

    parts = (text or "").encode().translate(LOWER).split()
    if not parts:
        return np.zeros(0, np.int64)
    h = xxhash.xxh64_intdigest
    codes = [h(b" ".join(parts[i:i + words]), SEED) for i in range(max(1, len(parts) - words + 1))]
    return np.unique(np.array(codes, np.uint64).view(np.int64))


def _sets(docs: DataFrame, words: int, part=None) -> DataFrame:
    """(doc_id, mark, sid, n, h, fp, sig) of each row; `sid` stands for the set of its n shingles, h are all of them or what `part` takes.

    With `part`, fp is the fingerprint of the set and sig its signature.
    """
    def run(batches):
        for batch in slices(batches, "text", 4 << 20):
            sets = [shingles(t, words) for t in batch.column("text").to_pylist()]
            sid = pa.array([_sid(x) for x in sets], pa.int64())
            n = pa.array([len(x) for x in sets], pa.int32())
            held = pa.array(sets if part is None else [part(x) for x in sets], pa.list_(pa.int64()))
            fp = pa.array([None if part is None else _majority(x.view(np.uint64)) for x in sets], pa.int64())
            sig = pa.array([None if part is None else signature(x) for x in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), sid, n, held, fp, sig], ["doc_id", "mark", "sid", "n", "h", "fp", "sig"])

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("mark"), "text").mapInArrow(
        run, "doc_id long, mark long, sid long, n int, h array<long>, fp long, sig binary")


def _sid(found: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), SEED)).view(np.int64))


def _possible(shared, n, o, similarity: float):
    """Whether sets of n and o shingles can be similar if their prefixes share `shared`.

    Of two prefixes one ends first in the order of all shingles: what the sets share up to there stands in both prefixes,
    what they share behind it is at most the rest of that set.
    """
    rest = F.ceil(similarity * F.greatest(n, o) - 1e-9) - 1
    return (shared + rest) * (1 + similarity) >= similarity * (F.col(n) + F.col(o)) - 1e-6


def signature(x: np.ndarray) -> bytes:
    """A bit for each shingle by its lowest bits, in four to eight times as many bits as there are shingles."""
    size = 1 << max(6, (4 * len(x) - 1).bit_length())
    bits = np.zeros(size, np.uint8)
    bits[x.view(np.uint64) & np.uint64(size - 1)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def most_shared(n: int, one: bytes, o: int, two: bytes) -> int:
    """What sets of n and o shingles share at most: a bit that only one of them has is a shingle that the other lacks.

    The longer signature is folded to the length of the other, as its places are remainders.
    """
    size = 8 * min(len(one), len(two))
    a, b = int.from_bytes(one, "little"), int.from_bytes(two, "little")
    a, b = _folded(a, 8 * len(one), size), _folded(b, 8 * len(two), size)
    return min(n - (a & ~b).bit_count(), o - (b & ~a).bit_count())


def _folded(bits: int, size: int, to: int) -> int:
    while size > to:
        size //= 2
        bits = (bits >> size) | (bits & ((1 << size) - 1))
    return bits


def _similar(pairs: DataFrame, docs: DataFrame, words: int, distinct: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of sets whose Jaccard similarity reaches `similarity`: first by their signatures, then by the sets themselves.

    The sets of pairs that pass are made once more from one text each. Other texts are left out before anything is
    shuffled while the list of those wanted is small enough to broadcast; beyond that both are shuffled.
    """
    def sift(batches):
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("na", "siga", "nb", "sigb")]
            keep = [most_shared(n, one, o, two) * (1 + similarity) >= similarity * (n + o) - 1e-6 for n, one, o, two in zip(*columns, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    one, two = (distinct.select(F.col("sid").alias(c), F.col("n").alias(f"n{c}"), F.col("sig").alias(f"sig{c}")) for c in "ab")
    pairs = stored(pairs.join(one, "a").join(two, "b").select("a", "b", "na", "siga", "nb", "sigb").mapInArrow(sift, "a long, b long"), "pairs")
    used = pairs.select(F.col("a").alias("sid")).union(pairs.select(F.col("b").alias("sid"))).distinct()
    used = stored(distinct.select("sid", "mark").join(used, "sid", "left_semi").select(F.col("mark").alias("_mark")), "used")
    small = used.count() <= broadcast_rows(pairs.sparkSession)
    wanted = docs.join(F.broadcast(used) if small else used, F.xxhash64("text") == F.col("_mark"), "left_semi")
    known = stored(_sets(wanted, words).groupBy("sid").agg(F.first("h").alias("h")), "sets")
    one, two = (known.select(F.col("sid").alias(c), F.col("h").alias(f"h{c}")) for c in "ab")
    both = F.size(F.array_intersect("ha", "hb"))
    found = pairs.join(one, "a").join(two, "b").where(both >= similarity * (F.size("ha") + F.size("hb") - both) - 1e-9).select("a", "b")
    found = stored(found, "similar")
    discard(pairs, used, known)
    return found


def _by_fingerprint(distinct: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets: each with the least of its fingerprint, and these with those whose fingerprints are linked."""
    least = stored(distinct.groupBy("fp").agg(F.min("sid").alias("b")), "marks")
    same = distinct.join(least, "fp").select(F.col("sid").alias("a"), "b")
    one, two = least.select(F.col("fp").alias("a"), F.col("b").alias("_a")), least.select(F.col("fp").alias("b"), F.col("b").alias("_b"))
    near = links(least).join(one, "a").join(two, "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    return same.union(near).where("a <> b")


def similar_groups(docs: DataFrame, words: int = SIMILAR_WORDS, similarity: float = SIMILAR) -> DataFrame:
    """(doc_id, mark, root) of each row; texts of Jaccard similarity `similarity` share a root, directly or by others.

    No pair is missed: with all shingles in one order, two sets that similar share one of the first
    n - ceil(similarity * n) + 1 of each. Frequent shingles of a sample stand last in that order, which changes the
    work only. Sets first meet those of near fingerprints, found through the pivots as in `links`, and one set drawn for
    each shingle, so that dense groups need no pair lists; similar texts may differ in more bits than four, so afterwards
    the pairs of different groups that share a prefix are compared. Pairs are sifted by signatures, which rule out only what can't be similar. Equal sets count once from the start. Null and wordless texts are
    one group, a text without a similar one is a group of its own; an empty table gives no rows.
    """
    drop_shuffles(docs.sparkSession)
    sample = docs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0)
    counts = _sets(sample, words).select(F.explode("h").alias("key")).groupBy("key").count().where(F.col("count") > FREQUENT)
    last = np.sort(np.array([r["key"] for r in counts.orderBy(F.desc("count"), "key").limit(LATE_KEYS).collect()], np.int64))

    def prefix(x):
        if len(last):
            late = last[np.minimum(np.searchsorted(last, x), len(last) - 1)] == x
            x = np.concatenate([x[~late], x[late]])
        return x[:len(x) - int(np.ceil(similarity * len(x) - 1e-9)) + 1]

    made = stored(_sets(docs, words, prefix), "prefixes")
    rows = stored(made.select("doc_id", "mark", "sid"), "sets-of-rows")
    firsts = [F.first(c).alias(c) for c in ("n", "h", "fp", "sig")]
    distinct = stored(made.where("n > 0").groupBy("sid").agg(F.min("mark").alias("mark"), *firsts), "distinct-sets")
    discard(made)
    # Kept: the links by fingerprints are read from it.
    named = stored(distinct.select("sid", "fp"), "set-fingerprints")
    every = distinct.select(F.explode("h").alias("key"), "sid", "n")
    # The sets of a key in an order of its own; the least is the one drawn. The mask gives the set back.
    mask = F.xxhash64("key")
    order = F.col("sid").bitwiseXOR(mask)
    shared = every.groupBy("key").agg(F.min(order).alias("low"), F.max(order).alias("high"), F.min_by("n", order).alias("o")).where("low <> high")
    drawn = stored(shared.select("key", F.col("low").bitwiseXOR(mask).alias("b"), "o"), "drawn-sets")
    met = stored(every.join(drawn, "key"), "met")
    discard(drawn)
    fits = F.least("n", "o") >= similarity * F.greatest("n", "o") - 1e-9
    met_first = _by_fingerprint(named).union(met.where(fits).select(F.col("sid").alias("a"), "b"))
    first = _similar(met_first, docs, words, distinct, similarity)
    roots = stored(components(first).withColumnRenamed("fp", "sid"), "first-roots")
    placed = met.select("key", "sid", "n").join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    open_ = stored(placed.join(mixed, "key", "left_semi"), "open")
    discard(met, roots)
    others = open_.select("key", F.col("sid").alias("b"), F.col("n").alias("o"), F.col("root").alias("of"))
    across = open_.join(others, "key").where((F.col("sid") < F.col("b")) & (F.col("root") != F.col("of")) & fits)
    # Shared keys of sets of different groups are all open, so their number is that of the prefixes.
    counted = across.groupBy("sid", "b", "n", "o").agg(F.count("*").alias("shared")).where(_possible(F.col("shared"), "n", "o", similarity))
    second = _similar(counted.select(F.col("sid").alias("a"), "b"), docs, words, distinct, similarity)
    discard(open_, distinct)
    final = stored(components(first.union(second)).withColumnRenamed("fp", "sid"), "similar-roots")
    discard(first, second)
    return rows.select("doc_id", "mark", "sid").join(final, "sid", "left").select("doc_id", "mark", F.coalesce("root", "sid").alias("root"))


def distinct_by_similarity(docs: DataFrame, words: int = SIMILAR_WORDS, similarity: float = SIMILAR) -> DataFrame:
    """One document of each group of similar texts, as in `deduplicate`."""
    return _one_each(docs, stored(similar_groups(docs, words, similarity), "groups"), "root")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
