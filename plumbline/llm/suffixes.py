"""Removal of long repeated byte strings by sorting suffixes, shallow first, deep ties in blind tries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import drop_shuffles, slices, table
from plumbline.session import discard, ship, stored

LENGTH = 200
# Every LENGTH-byte string holds an anchor: the least hash of the KEY-byte strings in it, leftmost if tied.
KEY = 64
BEFORE = LENGTH - KEY
SHALLOW = 3  # words of eight bytes compared before the tries
MULTIPLIER = 0x9E3779B97F4A7C15 | 1
GROUP = 4096


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up = np.cumprod(np.r_[np.uint64(1), np.full(n, MULTIPLIER, np.uint64)])
        down = np.cumprod(np.r_[np.uint64(1), np.full(n, pow(MULTIPLIER, -1, 1 << 64), np.uint64)])
    return up, down


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def anchors(data: bytes) -> list[tuple[int, int, int, int, int]]:
    """(position, key hash, hash of the surroundings, least and most offset of the strings it stands for)."""
    n = len(data)
    if n < LENGTH:
        return []
    up, down = _powers(n)
    prefix = np.r_[np.uint64(0), np.cumsum((np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)) * up[:n])]

    def piece(a, b):
        return mixed((prefix[b] - prefix[a]) * down[a])

    keys = piece(np.arange(n - KEY + 1), np.arange(KEY, n + 1))
    width = BEFORE + 1
    strings = n - LENGTH + 1
    # Places in the order of key and position: the least place of a window is that of its leftmost least key.
    order = np.argsort(keys, kind="stable")
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.arange(len(keys))
    blocks = np.concatenate([rank, np.full(-len(keys) % width, len(keys))]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    at = order[np.minimum(behind[:strings], ahead[width - 1:width - 1 + strings])]
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    last = np.r_[first[1:], strings] - 1
    place = at[first]
    left, right = first, np.minimum(last + LENGTH, n)
    around = piece(left, right)
    return list(zip(place.tolist(), keys[place].view(np.int64).tolist(), around.view(np.int64).tolist(),
                    (place - last).tolist(), (place - first).tolist(), strict=True))


class _Trie:
    """Blind trie of equal-length strings: inner nodes hold the first differing byte, a descent is checked once."""

    def __init__(self, text: bytes, number: int):
        self.root = (text, [number])

    def add(self, text: bytes, number: int) -> None:
        node, path = self.root, []
        while isinstance(node, list):
            path.append(node)
            depth, children = node
            node = children.get(text[depth]) or next(iter(children.values()))
        shared = common(text, node[0])
        if shared == len(text):
            node[1].append(number)
            return
        parent, below = None, self.root
        for step in path:
            if step[0] >= shared:
                break
            parent, below = step, step[1].get(text[step[0]])
        leaf = (text, [number])
        if isinstance(below, list) and below[0] == shared:
            below[1][text[shared]] = leaf
        elif below is None:
            parent[1][text[parent[0]]] = leaf
        else:
            split = [shared, {node[0][shared]: below, text[shared]: leaf}]
            if parent is None:
                self.root = split
            else:
                parent[1][text[parent[0]]] = split

    def numbers(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, list):
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]
            else:
                out += node[1]
        return out


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle)
    return low


def deep_shallow(strings: list[bytes]) -> list[int]:
    """Order of equal-length strings: multikey quicksort on words of eight bytes to the shallow depth, then tries."""
    n = len(strings)
    if n == 2:
        return [0, 1] if strings[0] <= strings[1] else [1, 0]
    width = max(map(len, strings), default=0)
    words = np.frombuffer(b"".join(s[:8 * SHALLOW].ljust(8 * SHALLOW, b"\0") for s in strings), ">u8").reshape(n, SHALLOW)
    out, stack = [], [(np.arange(n), 0)]
    while stack:
        rows, depth = stack.pop()
        if len(rows) < 2:
            out += rows.tolist()
        elif depth == SHALLOW or depth * 8 >= width:
            trie = _Trie(strings[rows[0]], int(rows[0]))
            for r in rows[1:].tolist():
                trie.add(strings[r], r)
            out += trie.numbers()
        else:
            key = words[rows, depth]
            pivot = key[len(key) // 2]
            stack += [(rows[key > pivot], depth), (rows[key == pivot], depth + 1), (rows[key < pivot], depth)]
    return out


def repeated(texts: list[bytes], at: list[int], offsets: range) -> np.ndarray:
    """For each text and offset: does the LENGTH-byte string that starts so far before its anchor stand in another text?"""
    n = len(texts)
    right = [t[a:].ljust(LENGTH, b"\0") for t, a in zip(texts, at)]
    left = [t[:a][::-1].ljust(BEFORE, b"\0") for t, a in zip(texts, at)]
    after = [len(t) - a for t, a in zip(texts, at)]
    shared = []
    for strings, sizes in ((right, after), (left, at)):
        order = deep_shallow(strings)
        lcp = np.array([0] + [min(common(strings[a], strings[b]), len(strings[a])) for a, b in zip(order, order[1:])])
        shared.append((np.array(order), lcp, np.array(sizes)))
    out = np.zeros((n, len(offsets)), bool)
    # The groups change only where a needed length passes one that is shared or there at all.
    (_, right_lcp, right_size), (_, left_lcp, left_size) = shared
    border = np.unique(np.r_[offsets.start, LENGTH - right_lcp, LENGTH - right_size, left_lcp + 1, left_size + 1])
    border = border[(border >= offsets.start) & (border < offsets.stop)].tolist()
    for a, end in zip(border, [*border[1:], offsets.stop]):
        ids = []
        for (order, lcp, sizes), need in zip(shared, (LENGTH - a, a)):
            group = np.empty(n, np.int64)
            group[order] = np.cumsum(lcp < need) if need else 0
            ids.append(np.where(sizes >= need, group, -1))
        whole = np.flatnonzero((ids[0] >= 0) & (ids[1] >= 0))
        _, same, count = np.unique(ids[0][whole] * (n + 1) + ids[1][whole], return_inverse=True, return_counts=True)
        out[whole, a - offsets.start:end - offsets.start] = (count[same] > 1)[:, None]
    return out


PLACES = "row long, at long, key long, ctx long, lo int, hi int"


def mark(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, cover): the rows with a number of their own, and for each number the starts of repeated strings as (first, last).

    Anchors whose key occurs once can't repeat. Equal surroundings are all repeated and count as one text; the
    different surroundings of a key are sorted together. A key with more than GROUP of them is first parted by what
    lies around the anchor, for halved intervals of offsets, until the parts are small or each is one string.
    """
    def scan(batches):
        for batch in slices(batches, "text"):
            rows = [(r, *x) for r, t in zip(*(batch.column(c).to_pylist() for c in ("row", "text")), strict=True)
                    for x in anchors((t or "").encode())]
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = (pa.int64(),) * 4 + (pa.int32(),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["row", "at", "key", "ctx", "lo", "hi"])

    drop_shuffles(ship(docs.sparkSession))
    rows = docs.select(F.xxhash64(F.col("doc_id").cast("string"), "text").alias("row"), F.col("doc_id").cast("long"), "text")
    # In periodic texts equal surroundings may hold the anchor at different places.
    places = stored(rows.select("row", "text").mapInArrow(scan, PLACES).withColumn("ctx", F.xxhash64("ctx", "lo", "hi")), "anchors")
    # The place of one text of each kind, in one number: offsets are below 256.
    spot = F.shiftleft("at", 16) + F.shiftleft("lo", 8) + F.col("hi")
    every = stored(places.groupBy("key", "ctx").agg(F.count("*").alias("n"), F.min("row").alias("row"), F.min_by(spot, "row").alias("spot")), "kinds")
    shared = stored(every.groupBy("key").agg(F.sum("n").alias("all"), F.count("*").alias("kinds")).where("all > 1"), "shared")
    kinds = stored(every.join(shared, "key"), "kinds")
    discard(every, shared)
    part_of = {"at": F.shiftright("spot", 16), "lo": F.shiftright("spot", 8).bitwiseAND(255).cast("int"), "hi": F.col("spot").bitwiseAND(255).cast("int")}
    wanted = kinds.where("kinds > 1").select("key", "ctx", "row", *[c.alias(name) for name, c in part_of.items()])
    by_row = stored(wanted.groupBy("row").agg(F.collect_list(F.struct("key", "ctx", "at", "lo", "hi")).alias("want")), "wanted")

    def surroundings(batches):
        for batch in slices(batches, "text"):
            out = []
            for text, want in zip(batch.column("text").to_pylist(), batch.column("want").to_pylist(), strict=True):
                data = text.encode()
                for w in want:
                    start = w["at"] - w["hi"]
                    out.append((w["key"], w["ctx"], data[start:w["at"] - w["lo"] + LENGTH], w["hi"], w["lo"], w["hi"]))
            columns = list(zip(*out, strict=True)) or [[]] * 6
            kinds_ = (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds_, strict=True)], ["key", "ctx", "body", "anchor", "lo", "hi"])

    bodies = rows.join(by_row, "row").dropDuplicates(["row"]).select("text", "want")
    whole = stored(bodies.mapInArrow(surroundings, "key long, ctx long, body binary, anchor int, lo int, hi int"), "bodies")
    discard(by_row)
    parts = whole.withColumn("part", F.col("key")).withColumn("a", F.lit(0)).withColumn("b", F.lit(BEFORE))
    done, made = [], []
    while True:
        sizes = stored(parts.groupBy("part").agg(F.count("*").alias("n"), F.max(F.col("b") - F.col("a")).alias("wide")), "sizes")
        parts = stored(parts.drop("n", "wide").join(sizes.where("n > 1"), "part"), "parts")
        discard(sizes, *([] if made else [whole]))
        made.append(parts)
        done.append(parts.where((F.col("n") <= GROUP) & (F.col("wide") > 0)))
        single = parts.where(F.col("wide") == 0)
        big = parts.where((F.col("n") > GROUP) & (F.col("wide") > 0))
        done.append(single.withColumn("all", F.lit(True)))
        if big.isEmpty():
            break
        middle = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
        halves = big.withColumn("h", F.explode(F.array(F.struct(F.col("a").alias("x"), middle.alias("y")), F.struct((middle + 1).alias("x"), F.col("b").alias("y")))))
        halves = halves.withColumn("a", F.col("h.x")).withColumn("b", F.col("h.y")).drop("h")
        # The bytes that all strings of the interval share, so parts hold only texts that agree on them.
        core = F.substring("body", F.col("anchor") - F.col("a") + 1, F.lit(LENGTH) - F.col("b") + F.col("a"))
        fits = (F.col("a") <= F.col("hi")) & (F.col("b") >= F.col("lo"))
        parts = halves.where(fits).withColumn("part", F.xxhash64("key", "a", "b", core))

    def compare(batches):
        """Repeats of each part; the rows of a part, at most GROUP, stand together and may cross batches."""
        names = ("part", "key", "ctx", "body", "anchor", "lo", "hi", "a", "b")

        def parts_of():
            rows = []
            for batch in batches:
                for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                    if rows and rows[0][0] != row[0]:
                        yield rows
                        rows = []
                    rows.append(row)
            if rows:
                yield rows

        def packed(out):
            kinds_ = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds_, strict=True)], ["key", "ctx", "lo", "hi"])

        out = []
        for rows in parts_of():
            _, keys, ctxs, bodies, places_, lows, highs, begin, end = zip(*rows, strict=True)
            offsets = range(max(begin[0], min(lows)), min(end[0], max(highs)) + 1)
            found = repeated(list(bodies), list(places_), offsets)
            inside = np.arange(offsets.start, offsets.stop)
            found &= (inside >= np.array(lows)[:, None]) & (inside <= np.array(highs)[:, None])
            edge = np.diff(np.pad(found.astype(np.int8), ((0, 0), (1, 1))), axis=1)
            for (i, x), (_, y) in zip(np.argwhere(edge == 1).tolist(), np.argwhere(edge == -1).tolist(), strict=True):
                out.append((keys[i], ctxs[i], offsets.start + x, offsets.start + y - 1))
            if len(out) > 50_000:
                yield packed(out)
                out = []
        if out:
            yield packed(out)

    sets = []
    for part in done:
        if "all" in part.columns:
            sets.append(part.select("key", "ctx", F.col("a").alias("lo"), F.col("b").alias("hi")))
        else:
            sets.append(part.repartition("part").sortWithinPartitions("part").mapInArrow(compare, "key long, ctx long, lo int, hi int"))
    more = sets[0]
    for s in sets[1:]:
        more = more.union(s)
    # A kind that occurs more than once is repeated at all its offsets, which are the same in all its texts.
    again = kinds.where("n > 1").select("key", "ctx", part_of["lo"].alias("lo"), part_of["hi"].alias("hi"))
    more = stored(more.union(again).distinct(), "repeats")
    discard(kinds, *made)
    hit = places.select("row", "at", "key", "ctx").join(more, ["key", "ctx"])
    spans = hit.select("row", (F.col("at") - F.col("hi")).alias("x"), (F.col("at") - F.col("lo")).alias("y"))
    cover = stored(spans.groupBy("row").agg(F.collect_set(F.struct("x", "y")).alias("cover")), "cover")
    discard(places, more)
    return rows, cover


def deduplicate(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of each row. Null texts are empty, other columns are ignored.

    Rows of equal doc_id and text share one number; their strings repeat each other.
    """
    rows, cover = mark(docs)

    def cut(batches):
        for batch in slices(batches, "text"):
            out = []
            for doc, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "cover")), strict=True):
                data, pieces, at, runs, end = (text or "").encode(), [], 0, 0, 0
                for x, y in sorted((s["x"], s["y"] + LENGTH) for s in spans or []):
                    if x > end or not runs:
                        runs += 1
                        pieces.append(data[at:x])
                    at = end = max(end, y)
                pieces.append(data[at:])
                kept = b"".join(pieces)
                out.append((doc, len(data), len(data) - len(kept), runs, kept))
            columns = list(zip(*out, strict=True))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    joined = rows.join(cover, "row", "left").select("doc_id", "text", "cover")
    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
