"""License scans by conditional compression, confirmed by the differing words."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import slices, table
from plumbline.session import ship

# Short license statements, as they stand in works.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD": "Use of this source code is governed by a BSD-style license.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
CUES = re.compile(r"licen[sc]|copyright|public domain|\bcc[ -](?:by|0)", re.IGNORECASE)
WORD = re.compile(r"[a-z0-9.]*[a-z0-9]")
# Words of a block compared at a time around a cue, least share of the size saved, most differing words of a template.
AROUND, SAVED, DIFFERING = 24, 0.25, 0.15


class Scanner:
    def __init__(self, templates: dict[str, str] = TEMPLATES):
        import zstandard

        raw = zstandard.DICT_TYPE_RAWCONTENT
        self.words = {n: WORD.findall(t.lower()) for n, t in templates.items()}
        self.plain = zstandard.ZstdCompressor(level=3)
        self.packers = {n: zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(" ".join(w).encode(), dict_type=raw))
                        for n, w in self.words.items()}

    def line(self, text: str) -> list[tuple[str, float, int]]:
        """(license, share saved, differing words) of each block of a line that a template explains."""
        words = WORD.findall(text.lower())
        out, at = [], 0
        marks = [m.start() for m in CUES.finditer(text)]
        while marks:
            k = len(WORD.findall(text[:marks[0]].lower()))
            block = words[max(at, k - AROUND):k + AROUND]
            best = self.block(block)
            if best:
                out.append(best[:3])
                at = max(at, k - AROUND) + best[3]
                marks = [m for m in marks[1:] if len(WORD.findall(text[:m].lower())) >= at]
            else:
                marks = marks[1:]
        return out

    def block(self, words: list[str]) -> tuple[str, float, int, int] | None:
        body = " ".join(words).encode()
        if not body:
            return None
        size = len(self.plain.compress(body))
        ranks = sorted((len(p.compress(body)), n) for n, p in self.packers.items())
        for small, name in ranks[:3]:
            wanted = self.words[name]
            blocks = [b for b in SequenceMatcher(None, wanted, words, autojunk=False).get_matching_blocks() if b.size]
            missing = len(wanted) - sum(b.size for b in blocks)
            extra = blocks[-1].b + blocks[-1].size - blocks[0].b - sum(b.size for b in blocks) if blocks else 0
            if missing + extra <= DIFFERING * len(wanted) and size - small >= SAVED * len(" ".join(wanted)):
                return name, round((size - small) / size, 6), missing + extra, blocks[-1].b + blocks[-1].size
        return None


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_candidates, licenses) of each row; a license has its line, name, share saved and differing words.

    Candidate lines hold a cue word. Null and empty texts have none; repeated lines are each listed.
    """
    def run(batches):
        scanner = Scanner()
        for batch in slices(batches, "text"):
            counts, found = [], []
            for text in batch.column("text").to_pylist():
                lines = [(i, x) for i, x in enumerate((text or "").split("\n")) if CUES.search(x)]
                counts.append(len(lines))
                found.append([dict(zip(("line", "name", "saved", "differing"), (i, *x))) for i, t in lines for x in scanner.line(t)])
            kind = pa.list_(pa.struct([("line", pa.int32()), ("name", pa.string()), ("saved", pa.float64()), ("differing", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(found, kind)],
                                             ["doc_id", "n_candidates", "licenses"])

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_candidates long, licenses array<struct<line:int,name:string,saved:double,differing:int>>")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    listed = F.transform("licenses", lambda x: F.concat_ws(":", x["line"].cast("string"), x["name"], x["differing"].cast("string")))
    return found.select("doc_id", "n_candidates", F.size("licenses").cast("long").alias("n_licenses"), F.array_join(listed, ",").alias("licenses"))
