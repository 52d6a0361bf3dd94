"""Audit of how far the sources of a language diverge in their words: Gustavson row accumulation.

Each group (lang, source) is a sparse row of term shares, each block of terms a term-major index of postings. A row
scatters its terms through the index into one dense accumulator over its peers; no (group, group, term) row exists.
Terms that only one side has, or neither, are not in the index: their part follows from each group's share of an
absent term (the zero baseline) and is put right by the counts of equal shares.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import slices, table
from plumbline.session import ship, stored

LEAST_DOCS, TOP, SCALE = 10, 10, 1_000_000_000
# Different (group, term) entries that a Python worker gathers before it hands them on; bounds of a block's postings.
FLUSH, BLOCK_LEAST, BLOCK_MOST = 250_000, 1 << 14, 1 << 21
# Term bytes: ASCII letters in lower case and all bytes of other characters; everything else parts terms.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
COUNTS = "lang string, source string, term string, n long, d long"


def _count(batches):
    """(lang, source, term, occurrences, documents), summed over as many rows as fit FLUSH entries."""
    held: dict[tuple[str, str], dict[bytes, list[int]]] = {}

    def emit():
        for (lang, source), terms in held.items():
            n, d = zip(*terms.values(), strict=True) if terms else ((), ())
            same = lambda x: pa.array([x] * len(terms), pa.string())
            yield pa.RecordBatch.from_arrays(
                [same(lang), same(source), pa.array(list(terms), pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(d, pa.int64())],
                ["lang", "source", "term", "n", "d"])

    size = 0
    for batch in slices(batches, "text"):
        columns = [batch.column(c).to_pylist() for c in ("lang", "source")]
        for lang, source, text in zip(*columns, batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
            terms = held.setdefault((lang, source), {})
            size -= len(terms)
            for word, c in Counter(text.translate(LETTERS).split()).items():
                if word in terms:
                    x = terms[word]
                    x[0] += c
                    x[1] += 1
                else:
                    terms[word] = [c, 1]
            size += len(terms)
            if size > FLUSH:
                yield from emit()
                held.clear()
                size = 0
    yield from emit()


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)), exact."""
    top = F.lit(SCALE).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)")
    under = F.greatest((total + 2 * terms), F.lit(1)).cast("decimal(20,0)")
    return 1 + F.call_function("div", top, under)


def _gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _f(p, q):
    return (p - q) ** 2 // (p + q)


def _accumulate(key, postings: pa.Table, groups: pa.Table) -> pa.Table:
    """Sums of a block's terms for pairs (a < b) of groups, less what the zero baselines give for them."""
    g, p = (np.asarray(postings.column(c), dtype=np.int64) for c in ("at", "p"))
    term = np.asarray(postings.column("term").combine_chunks().dictionary_encode().indices, dtype=np.int64) if len(g) else g
    base = np.zeros(groups.num_rows, np.int64)
    base[np.asarray(groups.column("its_at"), dtype=np.int64)] = np.asarray(groups.column("its_base"), dtype=np.int64)
    order = np.lexsort((g, term))
    g, p, term = g[order], p[order], term[order]
    ends = np.searchsorted(term, term, "right")
    by_row = np.argsort(g, kind="stable")
    cuts = np.flatnonzero(np.diff(g[by_row], prepend=-1))
    out = []
    for own in np.split(by_row, cuts[1:]) if len(g) else []:
        row = g[own[0]]
        peers = np.zeros(len(base), np.int64)
        # The row's own terms against peers that lack them, equal shares at once.
        none = _f(base[row], base)
        for share, times in zip(*np.unique(p[own], return_counts=True), strict=True):
            peers += times * (_f(share, base) - none)
        # Scatter through the index: the postings behind the row's own, so each pair is met once.
        lengths = ends[own] - own - 1
        first = np.cumsum(lengths) - lengths
        at = np.arange(lengths.sum()) + np.repeat(own + 1 - first, lengths)
        peer, mine, its = g[at], np.repeat(p[own], lengths), p[at]
        np.add.at(peers, peer, _f(mine, its) - _f(mine, base[peer]) - _f(base[row], its) + none[peer])
        peers[row] = 0
        found = np.flatnonzero(peers)
        out.append((np.minimum(found, row), np.maximum(found, row), peers[found]))
    a, b, value = (np.concatenate([o[k] for o in out] or [np.zeros(0, np.int64)]) for k in range(3))
    return pa.table({"lang": pa.array([key[0].as_py()] * len(a), pa.string()), "a": a, "b": b, "value": value})


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): all peers of each group, and the terms that mark it most.

    Null text, lang and source are ''. A group without terms stands in the result with its zero baseline; a language
    without kept terms has peers of value 0 and no terms. Repeated rows count as often as they occur, equal values
    rank by item, an empty table gives no rows; texts of any length are whole and other columns are not read.
    """
    spark = ship(docs.sparkSession)
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = stored(rows.mapInArrow(_count, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d")), "term-counts")
    terms = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("d").alias("d")).where(F.col("d") >= least_docs)
    kept = stored(counts.drop("d").join(terms.drop("d"), ["lang", "term"]), "kept-terms")

    group = kept.groupBy("lang", "source").agg(F.sum("n").alias("of"))
    lang = kept.groupBy("lang").agg(F.sum("n").alias("of_lang"), F.count("*").alias("postings"))
    size = terms.groupBy("lang").agg(F.count("*").alias("v"))
    by = Window.partitionBy("lang")
    groups = (rows.select("lang", "source").distinct().join(group, ["lang", "source"], "left").join(lang, "lang", "left").join(size, "lang", "left")
              .fillna(0, ["of", "of_lang", "postings", "v"])
              .withColumn("at", F.row_number().over(by.orderBy("source")).cast("long") - 1).withColumn("peers", F.count("*").over(by))
              # A block holds as many postings as the language has pairs, within bounds, so sums never outnumber postings.
              .withColumn("room", F.least(F.greatest(F.col("peers") * F.col("peers"), F.lit(BLOCK_LEAST)), F.lit(BLOCK_MOST)))
              .withColumn("blocks", F.ceil(F.col("postings") / F.col("room")).cast("long"))
              .withColumn("base", _share(F.lit(0), F.col("of"), F.col("v"))))
    groups = stored(groups, "term-groups")

    shares = kept.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "at", _share(F.col("n"), F.col("of"), F.col("v")).alias("p"), _share(F.col("total"), F.col("of_lang"), F.col("v")).alias("q"),
        F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    marks = (shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _gap(F.col("p"), F.col("q")).alias("value"))
             .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top))

    everywhere = groups.where("blocks > 0").select(*[F.col(c).alias(f"its_{c}") for c in ("lang", "at", "base")], F.explode(F.expr("sequence(0L, blocks - 1)")).alias("its_block"))
    sums = (shares.select("lang", "block", "at", "term", "p").groupBy("lang", "block").cogroup(everywhere.groupBy("its_lang", "its_block"))
            .applyInArrow(_accumulate, "lang string, a long, b long, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("more")))
    other = groups.select("lang", F.col("at").alias("peer"), F.col("source").alias("item"), F.col("base").alias("its"))
    pairs = (groups.select("lang", "source", "at", "v", "base", F.explode(F.expr("sequence(0L, peers - 1)")).alias("peer")).where("peer <> at")
             .join(other, ["lang", "peer"]).withColumns({"a": F.least("at", "peer"), "b": F.greatest("at", "peer")}).join(sums, ["lang", "a", "b"], "left")
             .select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("v") * _gap(F.col("base"), F.col("its")) + F.coalesce("more", F.lit(0))).alias("value"))
             .withColumn("rank", F.row_number().over(best)))
    return pairs.unionByName(marks).select("lang", "source", "part", "item", F.col("value").cast("long"), F.col("rank").cast("int"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents").select("lang", "source", "text"))


SQL = r"""
WITH docs AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
words AS (SELECT lang, source, r, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
terms AS (SELECT lang, term, count(*) AS total FROM words GROUP BY ALL HAVING count(DISTINCT r) >= 10),
counts AS (SELECT lang, source, term, count(*) AS n FROM words JOIN terms USING (lang, term) GROUP BY ALL),
size AS (SELECT lang, count(*) AS v, sum(total) AS of_lang FROM terms GROUP BY lang),
grouped AS (
  SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM docs) g
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
shares AS (
  SELECT g.lang, g.source, t.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (g.total + 2 * s.v) AS p,
         1 + 1000000000::HUGEINT * (t.total + 2) // (s.of_lang + 2 * s.v) AS q
  FROM grouped g JOIN terms t ON t.lang = g.lang JOIN size s ON s.lang = g.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = t.term),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
  UNION ALL
  SELECT a.lang, a.source, 'pair', b.source, 0 FROM grouped a JOIN grouped b ON a.lang = b.lang AND a.source <> b.source
  WHERE a.lang NOT IN (SELECT lang FROM size)),
marks AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM marks))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
