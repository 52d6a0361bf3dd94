"""Personal data: fixed forms, and identifiers found by contexts learnt from them."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import slices, table
from plumbline.session import ship, stored

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]+")
TOKEN = re.compile(r"[^\s\"'=:,;()<>\[\]{}]+")
# A context counts as reliable from this share of known identifiers, seen with so many different ones.
CONFIDENCE, SUPPORT, ROUNDS = 0.6, 3, 3


def luhn(digits: str) -> bool:
    total = 0
    for n, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if n % 2 == 0 else x * 2 - 9 * (x > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the four fixed forms, ordered by start and kind."""
    found, last = [], 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            found.append((start, m.end(), 0))
            last = m.end()
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p[-3:]) <= 255 for p in m[0].split(".")):
            found.append((m.start(), m.end(), 1))
    for m in CARD.finditer(text):
        if m.end() - m.start() < 40 and 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            found.append((m.start(), m.end(), 2))
    for m in PHONE.finditer(text):
        if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            found.append((m.start(), m.end(), 3))
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda x: (x[0], x[2]))]


def _context(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns around a span: the word before with its marks, alone and with the word after."""
    left = re.findall(r"[^\W\d_]+", text[max(0, start - 40):start])
    right = re.findall(r"[^\W\d_]+", text[end:end + 40])
    marks = re.search(r"[^\w]*$", text[max(0, start - 8):start])[0].strip()
    if not left:
        return []
    word = left[-1].lower()
    return [f"{word}{marks}|", f"{word}{marks}|{right[0].lower() if right else ''}"]


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple]:
    """(start, end, seed, patterns, value): base spans as seeds, and other parts that hold digits."""
    out = [(a, b, True, _context(text, a, b), text[a:b].lower()) for a, b, _ in base]
    taken, at, i = sorted((a, b) for a, b, _ in base), 0, 0
    for m in DIGIT.finditer(text):
        if m.start() < at:
            continue
        start = m.start()
        while start > at and TOKEN.fullmatch(text[start - 1]):
            start -= 1
        at = end = TOKEN.match(text, m.start()).end()
        while i < len(taken) and taken[i][1] <= start:
            i += 1
        if end - start >= 6 and not any(a < end for a, _ in taken[i:i + 1]):
            out.append((start, end, False, _context(text, start, end), text[start:end].lower()))
    return out


SPANS = "array<struct<s:int,e:int,k:string>>"
SCAN = f"row long, doc_id long, mark long, base {SPANS}, cand array<struct<s:int,e:int,seed:boolean,p:array<string>,v:string>>"


def scan(docs: DataFrame) -> DataFrame:
    """Base spans and candidates of each row; no text is kept."""
    def run(batches):
        for batch in slices(batches, "text"):
            base, cand = [], []
            for text in batch.column("text").to_pylist():
                spans = base_spans(text or "")
                base.append([{"s": a, "e": b, "k": k} for a, b, k in spans])
                cand.append([dict(zip("s e seed p v".split(), c)) for c in candidates(text or "", spans)])
            kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("k", pa.string())]))
            more = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("seed", pa.bool_()), ("p", pa.list_(pa.string())), ("v", pa.string())]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "doc_id", "mark")), pa.array(base, kind), pa.array(cand, more)],
                                             ["row", "doc_id", "mark", "base", "cand"])

    ship(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.xxhash64("text").alias("mark"), "text")
    return stored(rows.mapInArrow(run, SCAN), "pii")


def bootstrap(scanned: DataFrame) -> DataFrame:
    """(row, s, e) of identifiers found by context.

    Patterns and values are the two sides of a graph. In each round a pattern scores the mean of its values'
    scores, if SUPPORT different known values stand in it; a value takes the best score of its reliable patterns.
    """
    each = scanned.select("row", F.explode("cand").alias("c")).select("row", "c.*")
    places = stored(each.select("row", "s", "e", "seed", "v", F.explode("p").alias("pattern")), "places")
    edges = stored(places.groupBy("pattern", "v").agg(F.max(F.col("seed").cast("double")).alias("seed")), "edges")
    scored = edges.withColumn("score", F.col("seed"))
    for _ in range(ROUNDS):
        patterns = stored(scored.groupBy("pattern").agg(F.avg("score").alias("conf"), F.sum((F.col("score") >= CONFIDENCE).cast("int")).alias("known"))
                          .where((F.col("conf") >= CONFIDENCE) & (F.col("known") >= SUPPORT)), "patterns")
        values = edges.join(patterns, "pattern").groupBy("v").agg(F.max("conf").alias("best"))
        scored = stored(edges.join(stored(values, "values"), "v", "left")
                        .withColumn("score", F.greatest("seed", F.coalesce("best", F.lit(0.0)))).drop("best"), "scores")
    return places.where(~F.col("seed")).join(patterns, "pattern").select("row", "s", "e").distinct()


def extract(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, base, spans) of each row; spans are the base ones and those of kind `context`.

    `mark` is the hash of the text. Null texts are empty; ties and repeated rows give equal results.
    """
    scanned = scan(docs)
    found = bootstrap(scanned).groupBy("row").agg(F.collect_list(F.struct("s", "e", F.lit("context").alias("k"))).alias("more"))
    joined = scanned.drop("cand").join(stored(found, "found"), "row", "left")
    none = F.array().cast(SPANS)
    rank = {k: i for i, k in enumerate([*KINDS, "context"])}
    place = F.create_map(*[F.lit(x) for kv in rank.items() for x in kv])
    keyed = F.transform(F.concat("base", F.coalesce("more", none)), lambda x: F.struct(x.s.alias("s"), place[x.k].alias("o"), x.e.alias("e"), x.k.alias("k")))
    return joined.select("doc_id", "mark", "base", F.array_sort(keyed).alias("spans"))


def _text(spans):
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.k, x.s.cast("string"), x.e.cast("string"))), ",")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "documents").select("doc_id", "text"))
    def of(kind):
        return F.size(F.filter("base", lambda x: x.k == kind)).cast("long").alias(f"n_{kind}")

    counts = [of(kind) for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(_text(F.col("base")), 256).alias("base_sha256"), _text(F.col("spans")).alias("spans"))


def mask(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in angle brackets."""
    found = extract(docs).where(F.size("spans") > 0).groupBy("doc_id", "mark").agg(F.first("spans").alias("spans"))

    def run(batches):
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                out, at = [], 0
                for x in spans or []:
                    if x["s"] >= at:
                        out += [text[at:x["s"]], f"<{x['k'].upper()}>"]
                    at = max(at, x["e"])
                texts.append(text if not spans else "".join(out) + text[at:])
            names = [n for n in batch.schema.names if n != "spans"]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names], names)

    keyed = docs.withColumn("_mark", F.xxhash64("text"))
    spans = stored(found, "spans").withColumnsRenamed({"doc_id": "_doc", "mark": "_of"})
    joined = keyed.join(spans, (F.col("doc_id").eqNullSafe(F.col("_doc"))) & (F.col("_mark") == F.col("_of")), "left")
    out = joined.select(*docs.columns, "spans").mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
