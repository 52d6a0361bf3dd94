"""Benchmark decontamination with an FM-index for each shard of documents."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import slices, table
from plumbline.session import ship, stored

WINDOW, SAMPLE = 10, 16
# Text of benchmark items that one index is searched for at a time.
BLOCK_BYTES = 8 << 20
WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def lowered(text: str | None) -> str:
    return (text or "").translate(LOWER)


class Phrases:
    """Windows of the items as numbers of their words, with the items each belongs to."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.words: dict[str, int] = {}
        windows: dict[tuple[int, ...], set] = {}
        for item, text in items:
            ids = [self.words.setdefault(w, len(self.words) + 2) for w in WORD.findall(lowered(text))]
            for at in range(max(1, len(ids) - WINDOW + 1) if ids else 0):
                windows.setdefault(tuple(ids[at:at + WINDOW]), set()).add(item)
        self.groups = {}
        for size in sorted({len(w) for w in windows}):
            same = [w for w in windows if len(w) == size]
            self.groups[size] = (np.array(same, np.int64), [windows[w] for w in same])


class FmIndex:
    """Burrows-Wheeler transform in a wavelet matrix, with every 16th suffix position kept.

    Symbols: 0 ends the text, 1 parts runs of words, words are numbered from 2. Separators sort by position, so
    suffixes never compare beyond one.
    """

    def __init__(self, symbols: np.ndarray):
        text = np.append(symbols, 0)
        n = len(text)
        parts = np.flatnonzero(text == 1)
        rank = text + len(parts)
        rank[parts] = np.arange(1, len(parts) + 1)
        rank[-1] = 0
        order = np.argsort(rank, kind="stable")
        rank = self._ranks(rank[order], order, n)
        step = 1
        while True:
            count = np.bincount(rank, minlength=n)
            tied = np.flatnonzero(count[rank] > 1)
            if not len(tied):
                break
            key = (rank[tied] << 32) | rank[np.minimum(tied + step, n - 1)]
            order = np.argsort(key, kind="stable")
            key, at = key[order], tied[order]
            new = np.r_[True, key[1:] != key[:-1]]
            group = np.r_[True, (key[1:] >> 32) != (key[:-1] >> 32)]
            place = np.arange(len(key))
            start = np.maximum.accumulate(np.where(group, place, 0))
            rank[at] = (key >> 32) + np.maximum.accumulate(np.where(new, place, 0)) - start
            step *= 2
        suffixes = np.empty(n, np.int64)
        suffixes[rank] = np.arange(n)
        bwt = text[suffixes - 1]
        self.first = np.r_[0, np.cumsum(np.bincount(text))]
        kept = (suffixes % SAMPLE == 0) | (bwt <= 1)
        self.kept, self.kept_rank, self.positions = kept, np.r_[0, np.cumsum(kept)], suffixes[kept]
        self.levels = []
        for bit in range(max(1, int(text.max()).bit_length()) - 1, -1, -1):
            ones = (bwt >> bit) & 1
            before = np.r_[0, np.cumsum(ones)]
            self.levels.append((bit, ones, before, n - int(before[-1])))
            bwt = np.concatenate([bwt[ones == 0], bwt[ones == 1]])

    @staticmethod
    def _ranks(sorted_: np.ndarray, order: np.ndarray, n: int) -> np.ndarray:
        place = np.maximum.accumulate(np.where(np.r_[True, sorted_[1:] != sorted_[:-1]], np.arange(n), 0))
        rank = np.empty(n, np.int64)
        rank[order] = place
        return rank

    def before(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the transform before the row."""
        start = np.zeros_like(row)
        for bit, _, ones, zeros in self.levels:
            up = (symbol >> bit) & 1 == 1
            row = np.where(up, zeros + ones[row], row - ones[row])
            start = np.where(up, zeros + ones[start], start - ones[start])
        return row - start

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of rows whose suffixes begin with each phrase."""
        last = phrases[:, -1]
        known = last + 1 < len(self.first)
        low, high = np.zeros(len(last), np.int64), np.zeros(len(last), np.int64)
        low[known], high[known] = self.first[last[known]], self.first[last[known] + 1]
        for at in range(phrases.shape[1] - 2, -1, -1):
            live = np.flatnonzero((high > low) & (phrases[:, at] + 1 < len(self.first)))
            dead = np.setdiff1d(np.arange(len(low)), live, assume_unique=True)
            high[dead] = low[dead]
            symbol = phrases[live, at]
            low[live] = self.first[symbol] + self.before(symbol, low[live])
            high[live] = self.first[symbol] + self.before(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: steps back to a kept position, counted."""
        found = np.zeros(len(rows), np.int64)
        todo, rows = np.arange(len(rows)), rows.copy()
        for step in range(SAMPLE + 1):
            there = self.kept[rows]
            found[todo[there]] = self.positions[self.kept_rank[rows[there]]] + step
            todo, rows = todo[~there], rows[~there]
            if not len(rows):
                return found
            symbol, row, start = np.zeros_like(rows), rows, np.zeros_like(rows)
            for bit, ones, before, zeros in self.levels:
                up = ones[row] == 1
                symbol |= np.where(up, 1 << bit, 0)
                row = np.where(up, zeros + before[row], row - before[row])
                start = np.where(up, zeros + before[start], start - before[start])
            rows = self.first[symbol] + row - start
        return found


def shard_hits(texts: list[str], phrases: Phrases):
    """Words of each text, which words over all texts in turn are hit, the items of each text, each text's first word.

    Words outside the benchmark are in no phrase: a run of them becomes one separator, and runs of known words
    shorter than the shortest phrase are left out. Nothing that could match is lost.
    """
    get = phrases.words.get
    codes, counts = [], []
    for text in texts:
        ids = [get(w, 1) for w in WORD.findall(text)]
        codes += ids
        codes.append(1)
        counts.append(len(ids))
    code = np.array(codes, np.int64)
    hit = np.zeros(len(code) + 1, np.int64)
    items: list[set] = [set() for _ in texts]
    base = np.r_[0, np.cumsum(np.array(counts, np.int64) + 1)]
    least = min(phrases.groups, default=0)
    known = np.r_[False, code != 1, False]
    start, end = np.flatnonzero(known[1:] & ~known[:-1]), np.flatnonzero(~known[1:] & known[:-1])
    long = end - start >= max(least, 1)
    start, end = start[long], end[long]
    if len(start) and least:
        size = end - start + 1
        shift = np.cumsum(size) - size
        origin = np.arange(int(size.sum())) + np.repeat(start - shift, size)
        symbols = code[np.minimum(origin, len(code) - 1)]
        symbols[np.cumsum(size) - 1] = 1
        index = FmIndex(symbols)
        for width, (windows, owners) in phrases.groups.items():
            low, high = index.search(windows)
            n = high - low
            rows = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
            which = np.repeat(np.arange(len(n)), n)
            at = origin[index.locate(rows)]
            np.add.at(hit, at, 1)
            np.add.at(hit, at + width, -1)
            doc = np.searchsorted(base, at, "right") - 1
            for d, w in np.unique(np.stack([doc, which], 1), axis=0).tolist():
                items[d] |= owners[w]
    return counts, np.cumsum(hit)[:-1] > 0, items, base


def _pass(phrases):
    """Arrow function that adds the hits of one block of phrases to `_hit` (word numbers) and `_items`."""
    def run(batches):
        for batch in slices(batches, "text"):
            texts = [lowered(t) for t in batch.column("text").to_pylist()]
            counts, hit, items, base = shard_hits(texts, phrases.value)
            hits = [np.flatnonzero(hit[b:b + n]).tolist() for b, n in zip(base, counts)]
            old_hits, old_items = batch.column("_hit").to_pylist(), batch.column("_items").to_pylist()
            hits = [sorted({*a, *b}) if b else a for a, b in zip(hits, old_hits)]
            named = [sorted({*b, *(str(i) for i in a if i is not None)}) for a, b in zip(items, old_items)]
            kept = [c for i, c in enumerate(batch.columns) if batch.schema.names[i] not in ("_hit", "_items", "_n")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(counts, pa.int64()), pa.array(hits, pa.list_(pa.int64())), pa.array(named, pa.list_(pa.string()))],
                [*(c for c in batch.schema.names if c not in ("_hit", "_items", "_n")), "_n", "_hit", "_items"])
    return run


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Adds `_n` (words), `_hit` (numbers of the hit words) and `_items` (ids met, sorted as text).

    The benchmark is read in blocks of BLOCK_BYTES, one pass each, so no task holds more than one block.
    Null texts have no words; an item without an id hits words but is not listed.
    """
    spark = ship(docs.sparkSession)
    items = benchmark.select(F.col("item_id").cast("long"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = total // BLOCK_BYTES + 1
    out = docs.withColumns({"_n": F.lit(0).cast("long"), "_hit": F.array().cast("array<long>"), "_items": F.array().cast("array<string>")})
    for number in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == number)
        phrases = spark.sparkContext.broadcast(Phrases([tuple(r) for r in part.toLocalIterator()]))
        schema = T.StructType([f for f in out.schema.fields if f.name not in ("_n", "_hit", "_items")]
                              + [T.StructField("_n", T.LongType()), T.StructField("_hit", T.ArrayType(T.LongType())),
                                 T.StructField("_items", T.ArrayType(T.StringType()))])
        out = out.mapInArrow(_pass(phrases), schema)
        if number + 1 < blocks:
            out = stored(out, "hits")
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without the hit passages: neighbouring hit words are one removed span."""
    def cut(text, hits):
        words = [m.span() for m in WORD.finditer(lowered(text))]
        out, at, i = [], 0, 0
        while i < len(hits):
            j = i
            while j + 1 < len(hits) and hits[j + 1] == hits[j] + 1:
                j += 1
            out.append(text[at:words[hits[i]][0]])
            at, i = words[hits[j]][1], j + 1
        return "".join(out) + text[at:]

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            texts = [cut(t, h) if h else t for t, h in zip(batch.column("text").to_pylist(), batch.column("_hit").to_pylist())]
            columns = {n: c for n, c in zip(names, batch.columns) if n not in ("_n", "_hit", "_items")}
            columns["text"] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    out = find(docs, benchmark).mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.col("_n").alias("n_words"), F.size("_hit").cast("long").alias("n_hit"),
                        F.size("_items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "_items"), 256).alias("items_sha256"), (F.size("_hit") > 0).alias("contaminated"))


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
p AS (SELECT item_id, least(10, len(ws)) AS k, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') AS ph
  FROM (SELECT *, unnest(range(1, greatest(2, len(ws) - 8))) AS i FROM b WHERE len(ws) > 0)),
k AS (SELECT DISTINCT k FROM p),
o AS (SELECT doc_id, i, k.k, array_to_string(ws[i:i + k.k - 1], ' ') AS ph
  FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM w) x, k WHERE i + k.k - 1 <= len(ws)),
m AS (SELECT o.doc_id, o.i, o.k, p.item_id FROM o JOIN p ON o.ph = p.ph AND o.k = p.k),
h AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS q FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM m) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items,
  sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM w LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""
