"""Minimum bin slack packing of token pieces."""

from __future__ import annotations

import os
import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import keeps, ranked, slices, table, unit
from plumbline.session import ship, stored

CAPACITY = 4096
END = 1
# Bytes of words and ids that a Python worker remembers, how many times the text cut into words at a time, words encoded at a time.
CACHE_BYTES, CACHE_PARTS, LOT = 96 << 20, 48, 8000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


# How the vocabulary's pre-tokenizer cuts lower-case ASCII (fixed pattern of the vocabulary). Literal special tokens, which
# begin with SPECIAL, come first and keep their part whole.
CUT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9 \t\n\x0b\f\r]+")
SPECIAL = "<|"
# Marks and digits behind a letter are pieces of their own, whatever letters stand before them.
TAIL = re.compile(r"[!#-&(-;=-@\[-`{-~]+$")


class Memory:
    """Ids of strings in two generations of about half of `most` bytes each: what is in use survives, the rest goes."""

    def __init__(self, most: int):
        self.known, self.older, self.held, self.most = {}, {}, 0, most

    def add(self, keys: list[str], ids: list[bytes]) -> None:
        self.known.update(zip(keys, ids, strict=True))
        self.held += sum(map(len, keys)) + sum(map(len, ids)) + 160 * len(keys)

    def turn(self) -> None:
        """Drops the older generation if the younger one is full."""
        if self.held > self.most // 2:
            self.known, self.older, self.held = {}, self.known, 0

    def lacking(self, wanted: set[str]) -> list[str]:
        """Those of the strings that are in neither generation; the others are in the younger one now."""
        new = wanted.difference(self.known)
        again = [key for key in new if key in self.older]
        self.add(again, [self.older[key] for key in again])
        return list(new.difference(again))


def parts(text: str | None) -> list[str]:
    """A text's strings between spaces and line breaks; case only matters to special tokens."""
    text = text or ""
    if text.isascii() and SPECIAL not in text:
        text = text.lower()
    return text.replace("\n", " ").split(" ")


def pieces(part: str) -> list[str]:
    """Strings that one after another have the ids of a part; each is independent of its neighbours."""
    if SPECIAL in part:
        return [part]
    if part.isascii():
        return CUT.findall(part.lower())
    tail = None if part[-1].isalnum() else TAIL.search(part)
    # The letter must stay one in lower case, which gives some letters a mark.
    if tail and tail.start() and part[tail.start() - 1].isalpha() and len(part[tail.start() - 1].lower()) == 1:
        return [part[:tail.start()], *CUT.findall(tail[0])]
    return [part]


@lru_cache(maxsize=1)
def _coder(vocabulary: str, cache: int):
    """The tokenizer, once for each Python worker and without threads of its own, and the ids of pieces met."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary)
    names = tokenizer.get_vocab(with_added_tokens=True)
    ends = np.zeros(max(names.values()) + 1, bool)
    ends[[at for name, at in names.items() if name.endswith("</w>")]] = True
    return tokenizer, Memory(cache), ends


keeps(__name__, _coder.cache_clear)


def _encode(tokenizer, ends: np.ndarray, lot: list[str], memory: Memory) -> None:
    """Ids of pieces. ASCII ones and such of letters only go through the tokenizer as one text: each ends with the one
    token that marks an end. The others, and all if there are more ends than pieces, go one by one."""
    plain = [p for p in lot if p.isalpha() or p.isascii() and SPECIAL not in p]
    if plain:
        ids = np.array(tokenizer.encode_batch_fast([" ".join(plain)], add_special_tokens=False)[0].ids, "<u4")
        data, stops = ids.tobytes(), (4 * np.flatnonzero(ends[ids]) + 4).tolist()
        if len(stops) == len(plain):
            memory.add(plain, [data[start:stop] for start, stop in zip([0, *stops], stops, strict=False)])
        else:
            plain = []
    other = [p for p in lot if not p.isalpha() and (not p.isascii() or SPECIAL in p)] if plain else lot
    if other:
        coded = tokenizer.encode_batch_fast(other, add_special_tokens=False)
        memory.add(other, [struct.pack(f"<{len(c.ids)}I", *c.ids) for c in coded])


def _learn(tokenizer, ends: np.ndarray, new: list[str], memory: Memory) -> None:
    """Ids of parts: letters are one piece, others get those of their pieces, of which only such not met before are encoded."""
    for at in range(0, len(new), LOT):
        lot = new[at:at + LOT]
        rest = [p for p in lot if not p.isalpha()]
        cuts = [pieces(p) for p in rest]
        unknown = memory.lacking(set(lot).difference(rest).union(*cuts))
        if unknown:
            _encode(tokenizer, ends, unknown, memory)
        ids = memory.known.__getitem__
        memory.add(rest, [b"".join(map(ids, cut)) for cut in cuts])


def token_pieces(vocabulary: str, capacity: int, end_id: int, cache: int = CACHE_BYTES):
    """Arrow function from (doc_id, text) to the pieces of each text.

    White space always separates tokens in this vocabulary, also the special ones. A part between spaces that was met
    before keeps its ids, new ones are encoded by the tokenizer.
    """
    def run(batches):
        tokenizer, memory, ends = _coder(vocabulary, cache)
        end = np.array([end_id], "<u4").tobytes()
        for batch in slices(batches, "text", cache // CACHE_PARTS, __name__):
            rows = []
            texts = [parts(t) for t in batch.column("text").to_pylist()]
            memory.turn()
            _learn(tokenizer, ends, memory.lacking(set().union(*texts)), memory)
            for doc, cut in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                ids = b"".join(map(memory.known.__getitem__, cut)) + end
                n = len(ids) // 4
                for piece, start in enumerate(range(0, n, capacity)):
                    body = ids[4 * start:4 * (start + capacity)]
                    rows.append((doc, piece, start, len(body) // 4, zlib.crc32(body)))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                             ["doc_id", "piece", "start", "length", "ids_crc32"])
    return run


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """Lengths (with repeats) whose sum comes closest to `room`: subset sums as bits of one integer."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, unit_ = min(counts[length], room // length), 1
        while left:
            take = min(unit_, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left, unit_ = left - take, unit_ * 2
        if reach >> room:
            break
    total, chosen = reach.bit_length() - 1, []
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            chosen += [length] * take
            total -= length * take
    return chosen


def bin_plan(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Bins as (lengths, times), each around the longest length left and as full as the rest allows.

    A combination is used as often as the counts allow, so the number of different bins depends on the capacity only.
    """
    counts, plan = dict(histogram), []
    while counts:
        longest = max(counts)
        rest = counts | {longest: counts[longest] - 1}
        bin_ = [longest, *fullest({k: v for k, v in rest.items() if v}, capacity - longest)]
        need = {x: bin_.count(x) for x in set(bin_)}
        times = min(counts[x] // n for x, n in need.items())
        plan.append((bin_, times))
        for x, n in need.items():
            counts[x] -= n * times
            if not counts[x]:
                del counts[x]
    return plan


def place(plan: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first rank of each use, bins' first number, uses in a bin, offset in the bin."""
    spans: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    first = 0
    for bin_, times in plan:
        offset = 0
        for length in sorted(set(bin_), reverse=True):
            n = bin_.count(length)
            spans.setdefault(length, []).append((used.get(length, 0), first, n, offset))
            used[length] = used.get(length, 0) + n * times
            offset += n * length
        first += times
    return {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in spans.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds `sequence_id` and `offset`. The driver sees one count for each length, at most `capacity` of them."""
    histogram = {int(r["length"]): r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    where = place(bin_plan(histogram, capacity))
    order = [F.col(c) for c in ("doc_id", "piece", "start", "ids_crc32")]
    rows = ranked(pieces, ["length"], unit(*order), [unit(*order), *order], "_rank")

    def put(batches):
        for batch in batches:
            length = np.asarray(batch.column("length"), dtype=np.int64)
            rank = np.asarray(batch.column("_rank"), dtype=np.int64)
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                at = np.flatnonzero(length == x)
                start, first, n, off = where[int(x)]
                k = np.searchsorted(start, rank[at], "right") - 1
                inside = rank[at] - start[k]
                sequence[at] = first[k] + inside // n[k]
                offset[at] = off[k] + inside % n[k] * x
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)],
                                             [*batch.schema.names[:-1], "sequence_id", "offset"])

    return rows.select(*pieces.columns, "_rank").mapInArrow(put, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str | None = None, cache: int = CACHE_BYTES) -> DataFrame:
    """Pieces of all documents with their places. Null and empty texts are one end id; other columns are ignored.

    A Python worker remembers about `cache` bytes of words and ids.
    """
    path = vocabulary or public_tokenizers.path("word_bpe_49k.json")
    ship(docs.sparkSession)
    pieces = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(token_pieces(path, CAPACITY, END, cache), PIECES)
    return pack(stored(pieces, "pieces"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
