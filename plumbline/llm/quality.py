"""Quality classifier from overlapping heuristic labellers, weighed by expectation-maximisation."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import keeps, slices, table
from plumbline.session import ship, stored

LABELLERS = ("marks", "capitals", "repeats", "columns", "variety", "phrases", "plain")
TOXIC_LABELLERS = ("words", "pairs", "rows")
DIMENSIONS, EPOCHS = 1 << 12, 30
# Bound of the labelled sample that the scorer is fitted on.
SAMPLE_ROWS = 6000
REJECT = 0.5
MARKS = ".,;:!?\"'()[]{}*#$%&<>|"
# Bound of the rows of each side of labels.toxic that toxicity is learnt from, hashes of words and pairs, how much
# likelier a mark of toxicity is in toxic rows, and the toxic rows and the G value that it takes.
TOXIC_ROWS, WORD_BITS, ODDS, LEAST, G = 3000, 20, 4.0, 3, 12.0


class Words:
    """The words of a text: how many, how often each, how many equal the one before, how many pairs were there before."""

    def __init__(self, text: str | None):
        words = (text or "").split()
        self.n, self.counts, self.same = len(words), Counter(words), sum(map(eq, words, words[1:]))
        self.again = len(words) - 1 - len(set(zip(words, words[1:]))) if words else 0

    def where(self, holds) -> int:
        return sum(c for w, c in self.counts.items() if holds(w))


def votes(words: Words) -> list[int]:
    """One vote for each labeller: 1 good, 0 bad, -1 none."""
    n = max(words.n, 1)
    marked = words.where(lambda w: w[-1] in "#*$%&<>") / n
    capital = words.where(lambda w: len(w) > 1 and w.isupper()) / n
    bars = words.counts["|"] / n
    repeat = words.same / n
    distinct = len(words.counts) / n
    again = words.again / n
    return [0 if marked > 0.2 else 1 if marked < 0.02 else -1,
            0 if capital > 0.3 else 1 if capital < 0.02 else -1,
            0 if repeat > 0.2 else 1 if repeat < 0.02 else -1,
            0 if bars > 0.15 else 1 if not bars else -1,
            -1 if n < 20 else 0 if distinct < 0.15 else 1 if distinct > 0.3 else -1,
            0 if n >= 8 and again > 0.5 else -1,
            -1 if n < 5 else 1 if max(marked, capital, repeat, bars) < 0.05 and again < 0.3 else 0 if again > 0.5 or max(marked, capital, repeat, bars) > 0.25 else -1]


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashed shapes of words, and word pairs that are equal words or were there before, as shares of the text."""
    shapes = {"same": words.same, "new": words.n - words.same, "again": words.again} if words.n else {}
    for w, c in words.counts.items():
        case = "A" if w.isupper() and len(w) > 1 else "a" if w.isalpha() or any(map(str.isalpha, w)) else "-"
        end = w[-1] if not w[-1].isalnum() else ""
        for key in (f"s{case}{end}", f"l{min(len(w), 20)}"):
            shapes[key] = shapes.get(key, 0) + c
    shapes = {k: c for k, c in shapes.items() if c}
    index = np.array([crc32(k.encode()) % DIMENSIONS for k in shapes], np.int64)
    return index, np.array(list(shapes.values()), np.float64) / max(words.n, 1)


def em(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """(accuracies by class and labeller, posterior of good by pattern) from vote patterns and their counts."""
    v = np.array([p for p, _ in patterns], np.int64).reshape(len(patterns), -1)
    n = np.array([c for _, c in patterns], np.float64)
    said = v >= 0
    # A labeller looks for one defect only, so a bad vote counts twice at the start.
    post = np.clip(np.where(said.any(1), 1 - 2 * (v == 0).sum(1) / np.maximum(said.sum(1), 1), 0.5), 0.05, 0.95)
    right = np.full((2, v.shape[1]), 0.8)
    for _ in range(rounds):
        for c, weight in enumerate((1 - post, post)):
            w = (n * weight)[:, None] * said
            right[c] = np.clip(((w * (v == c)).sum(0) + 4) / (w.sum(0) + 5), 0.51, 0.999)
        prior = np.clip((n * post).sum() / n.sum(), 0.05, 0.95)
        logs = [np.log(p) + np.where(said, np.where(v == c, np.log(right[c]), np.log(1 - right[c])), 0).sum(1) for c, p in ((0, 1 - prior), (1, prior))]
        post = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
    return right, post


@dataclass(frozen=True)
class Scorer:
    """What is learnt of quality: the posterior of each vote pattern and the linear scorer."""

    belief: dict[tuple[int, ...], float]
    weights: np.ndarray
    bias: float

    def score(self, words: Words) -> float:
        i, x = features(words)
        return float(1 / (1 + np.exp(-np.clip(self.weights[i] @ x + self.bias, -30, 30))))


def _fit(index: list[np.ndarray], value: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic weights by gradient steps over sparse rows."""
    weights, bias = np.zeros(DIMENSIONS), 0.0
    row = np.repeat(np.arange(len(y)), [len(i) for i in index])
    at, x = (np.concatenate(c) if c else np.zeros(0) for c in (index, value))
    used, at = np.unique(at.astype(np.int64), return_inverse=True)
    w = np.zeros(len(used))
    # Both sides count alike, however rare junk is.
    good = y >= 0.5
    share = np.where(good, good.mean(), 1 - good.mean())
    weigh = 1 / share / len(np.unique(good)) / len(y)
    for _ in range(EPOCHS * 20):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, x * w[at], len(y)) + bias, -30, 30)))
        off = (p - y) * weigh
        w -= 2.0 * (np.bincount(at, x * off[row], len(used)) + 1e-4 * w)
        bias -= 2.0 * off.sum()
    weights[used] = w
    return weights, bias


def learn_quality(docs: DataFrame) -> Scorer | None:
    """The votes of all rows, weighed by expectation-maximisation, and a scorer fitted on SAMPLE_ROWS rows of them.

    At most 3**7 vote patterns reach the driver. The sample has the same number of rows of either side, in the order of
    their hash. None for an empty table.
    """
    def vote(batches):
        for batch in slices(batches, "text", owner=__name__):
            rows = [votes(Words(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("mark"), pa.array(rows, pa.list_(pa.int8()))], ["mark", "v"])

    spark = ship(docs.sparkSession)
    base = docs.select(F.xxhash64("text").alias("mark"), "text")
    voted = stored(base.mapInArrow(vote, "mark long, v array<tinyint>"), "votes")
    counted = [(tuple(r["v"]), r["n"]) for r in voted.groupBy("v").agg(F.count("*").alias("n")).collect()]
    if not counted:
        return None
    _, post = em(counted)
    belief = {p: float(x) for (p, _), x in zip(counted, post)}
    bad = [list(p) for p, x in belief.items() if x < 0.5]
    is_bad = F.col("v").cast("string").isin([str(p) for p in bad]) if bad else F.lit(False)
    marks = voted.select("mark", is_bad.alias("bad")).distinct()
    half = SAMPLE_ROWS // 2
    picked = [r["mark"] for side in (True, False) for r in marks.where(F.col("bad") == side).orderBy(F.xxhash64("mark"), "mark").limit(half).collect()]
    chosen = spark.createDataFrame([(m,) for m in picked], "mark long")

    def gather(batches):
        for batch in slices(batches, "text", owner=__name__):
            index, value, label = [], [], []
            for t in batch.column("text").to_pylist():
                words = Words(t)
                i, x = features(words)
                index.append(i), value.append(x), label.append(belief[tuple(votes(words))])
            yield pa.RecordBatch.from_arrays([batch.column("mark"), pa.array(index, pa.list_(pa.int64())), pa.array(value, pa.list_(pa.float64())), pa.array(label)], ["mark", "i", "x", "y"])

    # Rows become features where they lie, so that equal texts are found by their mark without shuffling any text.
    sample = base.join(F.broadcast(chosen), "mark", "left_semi").mapInArrow(gather, "mark long, i array<long>, x array<double>, y double")
    rows = sorted(sample.dropDuplicates(["mark"]).collect(), key=lambda r: r["mark"])
    return Scorer(belief, *_fit([np.array(r["i"], np.int64) for r in rows], [np.array(r["x"]) for r in rows], np.array([r["y"] for r in rows])))


@lru_cache(maxsize=1 << 17)
def _word(part: str) -> int:
    """Hash of a word without outer marks; -1 if nothing is left of it."""
    word = part.strip(MARKS)
    return crc32(word.encode()) if word else -1


keeps(__name__, _word.cache_clear)


def terms(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the different words and word pairs of a text, without case and outer marks."""
    hashes = np.array(list(map(_word, (text or "").lower().split())), np.int64)
    hashes, mask = hashes[hashes >= 0], (1 << WORD_BITS) - 1
    pairs = (hashes[:-1] * 0x9E3779B1 + hashes[1:] * 0x85EBCA6B) & ((1 << 62) - 1)
    return np.unique(hashes & mask), np.unique((pairs >> 17 ^ pairs >> 37) & mask)


@dataclass(frozen=True)
class Toxic:
    """What is learnt of toxicity: marked words, marked pairs (hash, weight), and the weight from which a text is toxic."""

    words: tuple[np.ndarray, np.ndarray]
    pairs: tuple[np.ndarray, np.ndarray]
    level: float

    def weigh(self, found: tuple[np.ndarray, np.ndarray]) -> list[float]:
        return [float(weight[np.isin(at, x, assume_unique=True)].sum()) for (at, weight), x in zip((self.words, self.pairs), found, strict=True)]

    def vote(self, text: str | None) -> list[int]:
        held = self.weigh(terms(text))
        return [0 if held[0] >= self.level else 1, 0 if held[1] >= self.level else -1, 0 if sum(held) >= self.level else 1]


def learn_toxic(docs: DataFrame, labels: DataFrame) -> Toxic | None:
    """Marks of toxicity from at most TOXIC_ROWS rows of each side of labels.toxic, in the order of their hash.

    Terms are counted for each side in Spark; only those that stand in LEAST toxic rows or more, ODDS times likelier
    there, reach the driver, and one number for each row of the sample. None without toxic rows.
    """
    spark = ship(docs.sparkSession)
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc")).agg(F.max("toxic").alias("toxic"))
    picked = [tuple(r) for side in (0, 1) for r in known.where(F.col("toxic") == side).orderBy(F.xxhash64("doc"), "doc").limit(TOXIC_ROWS).collect()]
    if not any(x for _, x in picked):
        return None

    def gather(batches):
        for batch in slices(batches, "text", owner=__name__):
            found = [terms(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(pa.array([f[k] for f in found], pa.list_(pa.int64())) for k in (0, 1)), batch.column("toxic")], ["words", "pairs", "toxic"])

    chosen = F.broadcast(spark.createDataFrame(picked, "doc long, toxic int"))
    sample = stored(docs.select(F.col("doc_id").cast("long").alias("doc"), "text").join(chosen, "doc").select("text", "toxic")
                    .mapInArrow(gather, "words array<long>, pairs array<long>, toxic int"), "toxic-sample")
    sides = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    nt, nc = max(sides.get(1, 0), 1), max(sides.get(0, 0), 1)
    if not sides.get(1):
        return None

    def marked(kind: str) -> tuple[np.ndarray, np.ndarray]:
        counts = sample.select("toxic", F.explode(kind).alias("at")).groupBy("at").agg(F.count_if(F.col("toxic") == 1).alias("t"), F.count_if(F.col("toxic") == 0).alias("c"))
        often = (F.col("t") >= LEAST) & ((F.col("t") + 0.5) / (nt + 1) >= ODDS * (F.col("c") + 0.5) / (nc + 1))
        rows = counts.where(often).orderBy("at").collect()
        at, t, c = (np.array([r[k] for r in rows], np.int64) for k in ("at", "t", "c"))
        p = (t + c) / (nt + nc)
        with np.errstate(divide="ignore", invalid="ignore"):
            g = 2 * (t * np.log(t / nt / p) + np.where(c > 0, c * np.log(c / nc / p), 0))
        odds = np.log((t + 0.5) / (nt + 1)) - np.log((c + 0.5) / (nc + 1))
        return at[g >= G], odds[g >= G]

    found = Toxic(marked("words"), marked("pairs"), 0.0)

    def weigh(batches):
        for batch in batches:
            total = [sum(found.weigh((np.array(w, np.int64), np.array(p, np.int64)))) for w, p in zip(batch.column("words").to_pylist(), batch.column("pairs").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(total, pa.float64()), batch.column("toxic")], ["total", "toxic"])

    # The weight from which a row of the sample is rather toxic than clean, both sides counting alike.
    levels = (sample.mapInArrow(weigh, "total double, toxic int").groupBy("total").agg(F.count_if(F.col("toxic") == 1).alias("t"), F.count_if(F.col("toxic") == 0).alias("c"))
              .orderBy("total").collect())
    t, c = (np.array([r[k] for r in levels], np.float64) for k in "tc")
    errors = (np.cumsum(t) - t) / nt + (c.sum() - (np.cumsum(c) - c)) / nc
    return Toxic(found.words, found.pairs, max(levels[int(np.argmin(errors))]["total"], float(np.log(ODDS))))


def unused(names: list[str], wanted: str) -> str:
    """A column name that none of the names is."""
    while wanted.lower() in {n.lower() for n in names}:
        wanted += "_"
    return wanted


def judged(docs: DataFrame, labels: DataFrame | None = None, columns: list[str] | None = None) -> tuple[DataFrame, str]:
    """The rows with a struct (posterior, score, toxic, kept), and its name; only `columns` of the rows, if given.

    All texts are split once more for score and toxic votes together. Whether a text holds toxic words, toxic pairs, and
    the weight of both are three votes, which expectation-maximisation over all rows weighs. Without labels or toxic
    rows nothing is toxic. Null and wordless texts have no votes and score by the bias.
    """
    spark, kept = ship(docs.sparkSession), columns or docs.columns
    name = unused(docs.columns, "judged")
    quality = learn_quality(docs)
    toxic = learn_toxic(docs, labels) if quality and labels is not None else None
    kind = "struct<posterior: double, score: double, toxic: double, kept: boolean>"
    if quality is None:
        return docs.select(*kept).withColumn(name, F.lit(None).cast(kind)), name

    def judge(batches):
        for batch in slices(batches, "text", owner=__name__):
            out = []
            for t in batch.column("text").to_pylist():
                words = Words(t)
                out.append({"posterior": quality.belief.get(tuple(votes(words)), 0.5), "score": quality.score(words), "v": toxic.vote(t) if toxic else []})
            made = pa.array(out, pa.struct([("posterior", pa.float64()), ("score", pa.float64()), ("v", pa.list_(pa.int8()))]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), made], [*kept, name])

    more = T.StructField(name, T._parse_datatype_string("struct<posterior: double, score: double, v: array<tinyint>>"))
    schema = T.StructType([*(docs.schema[c] for c in kept), more])
    found = docs.select(*dict.fromkeys([*kept, "text"])).mapInArrow(judge, schema)
    likely = F.lit(0.0)
    if toxic:
        found = stored(found, "judged")
        counted = [(tuple(r["v"]), r["n"]) for r in found.groupBy(F.col(name)["v"].alias("v")).agg(F.count("*").alias("n")).collect()]
        _, post = em(counted)
        likely = F.create_map(*[x for (p, _), y in zip(counted, post) for x in (F.lit(",".join(map(str, p))), F.lit(float(1 - y)))])[
            F.concat_ws(",", F.col(name)["v"].cast("array<string>"))]
    found = found.withColumn(name, F.struct(F.col(name)["posterior"].alias("posterior"), F.col(name)["score"].alias("score"), likely.alias("toxic")))
    accepted = (F.col(name)["score"] >= REJECT) & (F.col(name)["toxic"] < REJECT)
    return found.withColumn(name, F.col(name).withField("kept", accepted)), name


def scored(docs: DataFrame) -> DataFrame:
    """The rows with their verdict on quality alone."""
    return judged(docs)[0]


def keep(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """The documents that both the quality classifier and, with labels, the toxicity classifier accept.

    Repeated rows are judged alike; other columns pass through, whatever their names; an empty table gives no rows.
    """
    found, name = judged(docs, labels)
    return found.where(F.col(name)["kept"]).select(*docs.columns)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, name = judged(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), ["doc_id"])
    j = F.col(name)
    return found.select("doc_id", F.round(j["posterior"], 6).alias("posterior"), F.round(j["score"], 6).alias("score"),
                        F.round(j["toxic"], 6).alias("toxic"), j["kept"].alias("kept"))
