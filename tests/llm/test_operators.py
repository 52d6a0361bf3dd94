"""Corpus operators beside brute force on small tables with nulls, empties, repeats and long texts."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from compare import differences, duck
from plumbline.llm import common, decontaminate, licenses, packing, pii, quality, rules, sharding, simhash, suffixes, warc
from plumbline.llm.registry import ORACLES, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string"


@pytest.fixture(scope="module")
def rows():
    pick = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    prose = [" ".join(pick.choices(words, k=pick.randint(1, 200))) for _ in range(40)]
    texts = [None, "", " ", prose[0], prose[0], prose[0][:-2] + "x", "a" * 3000, "ab " * 2000, "lead " + prose[1], prose[1] + " tail", "é" * 400] + prose
    texts += ["mail x@b.org or 1.2.3.4 or 4111 1111 1111 1111 or +1 (555) 123-4567", "1.2.3.999 a@b a@b@c.d e@f.g@h.i " + "7" * 500]
    return [(i, t, None, None if i % 5 == 0 else "s" if i % 2 else "t", len(t or ""), "x") for i, t in enumerate(texts)] + [(3, prose[0], None, "t", 1, "y")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_shards_are_even_and_gapless(docs, nothing, rows):
    out = sharding.interleave(docs.drop("row"), "doc_id", "source", 7).toPandas()
    slots = out.groupby("shard")["slot"].apply(sorted)
    assert len(out) == len(rows) and max(map(len, slots)) - min(map(len, slots)) <= 1
    assert all(s == list(range(len(s))) for s in slots)
    assert sharding.interleave(nothing, "doc_id", "source", 7).count() == 0


def test_packing_places_every_token_once(docs, nothing, rows):
    from tokenizers import Tokenizer
    import public_tokenizers
    coder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = packing.pack_documents(docs).toPandas()
    wanted = Counter()
    for doc, text, *_ in rows:
        ids = [*coder.encode(text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            wanted[doc, k, at, zlib.crc32(np.array(ids[at:at + 4096], "<u4").tobytes())] += 1
    assert Counter(zip(out.doc_id, out.piece, out.start, out.ids_crc32)) == wanted
    for _, one in out.sort_values("offset").groupby("sequence_id"):
        assert one.length.sum() <= 4096 and list(one.offset) == list(one.length.cumsum() - one.length)
    assert packing.pack_documents(nothing).count() == 0


def test_a_worker_drops_what_the_stage_before_kept():
    import pyarrow as pa
    import public_tokenizers
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["some words here", None]})
    pack = packing.token_pieces(public_tokenizers.path("word_bpe_49k.json"), 4096, 1)
    first = [b.to_pydict() for b in pack([batch])]
    quality.terms("some words")
    assert packing._coder.cache_info().currsize == 1 and quality._word.cache_info().currsize
    assert [b.to_pydict() for b in pack([batch])] == first and packing._coder.cache_info().hits == 1
    assert not quality._word.cache_info().currsize
    assert sum(b.num_rows for b in common.slices([batch], "text", owner=quality.__name__)) == 2
    assert not packing._coder.cache_info().currsize


def test_packing_encodes_letters_together_and_forgets():
    from tokenizers import Tokenizer
    import pyarrow as pa
    import public_tokenizers
    path = public_tokenizers.path("word_bpe_49k.json")
    coder, asked = Tokenizer.from_file(path), []
    _, _, ends = packing._coder(path, 4000)

    class Counted:
        def encode_batch_fast(self, texts, **kw):
            asked.append(len(texts))
            return coder.encode_batch_fast(texts, **kw)

    memory = packing.Memory(4000)
    packing._encode(Counted(), ends, ["\u00e9t\u00e9", "na\u00efve", "word", "\u00c8re"], memory)
    assert asked == [1] and memory.known["na\u00efve"] == np.array(coder.encode("na\u00efve", add_special_tokens=False).ids, "<u4").tobytes()
    texts = [f"{w}{i} {w.upper()}, I\u0307{w} \u0130{w} {w}\u00e9!!\n{w}-{w}\u00e9 it's  {w}\t5" for i, w in enumerate(["word", "\u00e9t\u00e9", "e\u0301l", "\u4e2d\u6587", "\u00df"] * 40)]
    out = packing.token_pieces(path, 4096, 1, 4000)([pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})])
    rows = [r for b in out for r in b.to_pylist()]
    assert [r["ids_crc32"] for r in rows] == [zlib.crc32(np.array([*coder.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()) for t in texts]
    kept = packing._coder(path, 4000)[1]
    assert kept.held < 2 * 4000 + 160 * 2000 and kept.older


def test_packing_keeps_special_tokens(spark):
    from tokenizers import Tokenizer
    import public_tokenizers
    coder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["a b<|endoftext|> c", "<|startoftext|>Word<|endoftext|>", "x <|endoftext|>\n<|startoftext|> y", "<|endoftext|> " * 5000, "<|endof text|>"]
    out = packing.pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    wanted = Counter()
    for doc, text in enumerate(texts):
        ids = [*coder.encode(text, add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            wanted[doc, k, at, zlib.crc32(np.array(ids[at:at + 4096], "<u4").tobytes())] += 1
    assert 49407 in coder.encode(texts[0], add_special_tokens=False).ids
    assert Counter((r["doc_id"], r["piece"], r["start"], r["ids_crc32"]) for r in out) == wanted


def test_fullest_combination_equals_brute_force():
    pick = random.Random(1)
    for _ in range(60):
        counts, room = Counter(pick.choices(range(1, 15), k=6)), pick.randint(1, 40)
        sums = {0}
        for x in counts.elements():
            sums |= {s + x for s in sums if s + x <= room}
        got = packing.fullest(dict(counts), room)
        assert sum(got) == max(sums) and not Counter(got) - counts


def fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    codes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 4]), 42) for i in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if codes and 2 * sum(c >> b & 1 for c in codes) > len(codes))


def test_simhash_components(docs, nothing, rows, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 8)
    out = simhash.near_duplicates(docs).toPandas()
    prints = np.array([fingerprint(t) for _, t, *_ in rows], np.uint64)
    least = np.array([r[0] for r in rows])
    near = np.bitwise_count(prints[:, None] ^ prints) <= 4
    for _ in rows:
        least = np.array([least[n].min() for n in near])
    assert sorted(zip(out.doc_id, out.component_id)) == sorted(zip([r[0] for r in rows], least))
    kept = [r["doc_id"] for r in simhash.deduplicate(docs).collect()]
    assert sorted(kept) == sorted(set(least.tolist()))
    assert simhash.near_duplicates(nothing).count() == 0


def test_rows_that_share_an_id_do_not_go_together(spark):
    pick = random.Random(9)
    near, alone, other = (" ".join(pick.choices("abcdefghijklmnopqrstuvwxyz", k=80)) for _ in range(3))
    rows = [(1, near), (5, near.upper()), (5, alone), (5, other), (5, other), (None, near)]
    out = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, out)) == Counter([(1, near), (5, alone), (5, other), (None, near)])


def test_pipeline_stage_finds_all_similar_texts(spark, docs, nothing, monkeypatch):
    import corpus_pipeline
    pick = random.Random(4)
    rows = []
    for k in range(30):
        base = [f"v{pick.randrange(3000)}" for _ in range(pick.choice((8, 40, 60, 200, 600)))]
        for _ in range(4):
            copy = list(base)
            for at in pick.sample(range(len(copy)), min(len(copy) // 4, pick.choice((0, 1, 2, 4, 12)))):
                copy[at] = f"x{pick.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows), None), (len(rows) + 1, " "), (len(rows) + 2, "one two"), (len(rows) + 3, "One  two")]
    sets = [frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if (w := (t or "").lower().split()) else frozenset() for _, t in rows]
    near = np.array([[a == b or len(a & b) >= 0.8 * len(a | b) for b in sets] for a in sets])
    least = np.arange(len(rows))
    for _ in rows:
        least = np.array([least[n].min() for n in near])
    assert 30 < len(set(least.tolist())) < len(rows) - 20
    for frequent in (20, 0):
        monkeypatch.setattr(simhash, "FREQUENT", frequent), monkeypatch.setattr(simhash, "SAMPLED", 1 if not frequent else 16)
        kept = corpus_pipeline.distinct(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
        assert sorted(r["doc_id"] for r in kept) == sorted(set(least.tolist()))
    assert corpus_pipeline.distinct(spark, nothing, "").count() == 0


def test_pipeline_stage_meets_texts_by_their_fingerprints(spark, monkeypatch):
    import corpus_pipeline
    found, by = [], simhash._by_fingerprint
    monkeypatch.setattr(simhash, "_by_fingerprint", lambda sets: found.append(by(sets)) or found[-1])
    pick = random.Random(6)
    base = [f"v{pick.randrange(3000)}" for _ in range(400)]
    # Three copies that differ in their last word, and a text that none is like.
    rows = [(k, " ".join([*base, f"x{k}"])) for k in range(3)] + [(3, " ".join(reversed(base)))]
    kept = corpus_pipeline.distinct(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(r["doc_id"] for r in kept) == [0, 3] and len(found) == 1
    assert 0 < found[0].count() <= 2


def test_suffix_removal_equals_brute_force(docs, nothing, rows, monkeypatch):
    for group in (4096, 2):
        monkeypatch.setattr(suffixes, "GROUP", group)
        seen = Counter(d[i:i + 200] for _, t, *_ in rows for d in [(t or "").encode()] for i in range(len(d) - 199))
        wanted = Counter()
        for doc, text, *_ in rows:
            data = (text or "").encode()
            gone = {j for i in range(len(data) - 199) if seen[data[i:i + 200]] > 1 for j in range(i, i + 200)}
            runs = sum(j - 1 not in gone for j in gone)
            wanted[doc, len(data), len(gone), runs, bytes(b for j, b in enumerate(data) if j not in gone)] += 1
        got = suffixes.deduplicate(docs).collect()
        assert Counter((r[0], r[1], r[2], r[3], bytes(r[4])) for r in got) == wanted
    assert suffixes.deduplicate(nothing).count() == 0


def test_one_text_of_each_kind_is_found_without_reading_all_anchors_again(docs, monkeypatch):
    made = {}
    keep = suffixes.stored
    monkeypatch.setattr(suffixes, "stored", lambda df, name: made.setdefault(name, df) is None or keep(df, name))
    suffixes.mark(docs.select("doc_id", "text"))
    assert "doc_id" not in made["anchors"].columns
    assert not any("/anchors-" in f for f in made["wanted"].inputFiles())


def test_deep_shallow_sorts():
    pick = random.Random(5)
    strings = ["".join(pick.choices("ab", k=pick.randint(0, 60))).encode().rjust(90, b"a") for _ in range(300)]
    order = suffixes.deep_shallow(strings)
    assert [strings[i] for i in order] == sorted(strings)


def test_pii_base_and_masks(docs, nothing):
    out = {r["doc_id"]: r for r in pii.extract(docs).collect()}
    line = next(r for r in out.values() if len(r["base"]) == 4)
    assert [x["k"] for x in line["base"]] == ["email", "ip", "card", "phone"]
    assert pii.base_spans("1.2.3.999 a@b a@b@c.d e@f.g@h.i") == [(16, 21, "email"), (22, 27, "email")]
    assert "<EMAIL> or <IP> or <CARD> or <PHONE>" in "".join(r["text"] or "" for r in pii.mask(docs).collect())
    assert pii.mask(docs).count() == docs.count() and pii.extract(nothing).count() == 0


def test_pii_contexts_find_unseen_identifiers(spark):
    rows = [(i, f"reach me: m{i}@x.org soon") for i in range(9)] + [(99, "reach me: AB-12345-Z soon")]
    out = {r["doc_id"]: r for r in pii.extract(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [x["k"] for x in out[99]["spans"]] == ["context"] and out[99]["spans"][0]["s"] == 10


def test_decontamination_cuts_passages(spark, docs, nothing, rows):
    passage = rows[12][1].split()[:15] if len(rows[12][1].split()) > 14 else rows[13][1].split()[:15]
    items = spark.createDataFrame([(1, " ".join(passage)), (2, None), (3, ""), (None, "w1 w1"), (1, " ".join(passage))], "item_id long, text string")
    out = decontaminate.find(docs, items).collect()
    assert any("1" in r["_items"] for r in out) and len(out) == len(rows)
    assert all(" ".join(passage) not in (r["text"] or "") for r in decontaminate.clean(docs, items).collect())
    assert decontaminate.find(nothing, items).count() == 0


def test_rules_are_monotone_and_base_is_exact(docs, nothing, spark, rows):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (41, None, 0)], "doc_id long, quality int, toxic int")
    for r in rules.judge(docs, labels).collect():
        words = re.findall("[^\x20\x09-\x0d]+", r["text"] or "")
        windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
        again = {j for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for j in range(i, i + 5)}
        assert (r["_n_words"], r["_word_chars"], r["_n_repeat_words"]) == (len(words), sum(map(len, words)), len(again))
    pick = np.random.default_rng(1)
    x = pick.random((500, len(rules.FEATURES)))
    trees = rules.Trees(x, (pick.random(500) < 0.9 - 0.6 * x[:, 2]).astype(float), list(rules.FEATURES.values()))
    for f, sign in enumerate(rules.FEATURES.values()):
        grid = np.repeat(x[:1], 50, 0)
        grid[:, f] = np.linspace(0, 1, 50)
        assert sign == 0 or (sign * np.diff(trees.predict(grid)) >= -1e-12).all()
    assert rules.judge(nothing, labels).count() == 0


def test_classifier_separates_junk(spark, nothing):
    good = [(i, " ".join(f"Word{i * k % 97}".lower() for k in range(60))) for i in range(1, 60)]
    junk = [(100 + i, "SHOUT!! " * 40) for i in range(10)]
    frame = spark.createDataFrame([*good, *junk, (None, None), (500, "")], "doc_id long, text string")
    kept = {r["doc_id"] for r in quality.keep(frame).collect()}
    assert not kept & {d for d, _ in junk} and {d for d, _ in good} <= kept
    assert quality.scored(nothing).count() == 0


def test_toxic_texts_of_good_form_and_repeated_phrases_are_rejected(spark):
    pick = random.Random(6)
    def prose(*extra):
        words = [f"{a}{b}{c}" for a, b, c in zip(*(pick.choices(x, k=80) for x in ("bdfglm", "aeiou", ("nd", "st", "re"))))]
        for x in extra:
            words.insert(pick.randrange(80), x)
        return " ".join(words)
    rows = [(i, prose(pick.choice(("idiot", "moron"))) if i % 5 == 0 else prose()) for i in range(400)] + [(1000 + i, f"buy now cheap{i} " * 30) for i in range(12)]
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(200)], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"] for r in quality.keep(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()}
    assert kept == {i for i in range(400) if i % 5}


def test_licenses_by_wording(spark, nothing):
    frame = spark.createDataFrame([(1, "x\nReleased under the MIT License."), (2, "a licence to speak"), (3, None),
                                   (4, "This work is licensed under the GNU General Public License, version 3.")], "doc_id long, text string")
    out = {r["doc_id"]: [x["name"] for x in r["licenses"]] for r in licenses.scan(frame).collect()}
    assert out == {1: ["MIT"], 2: [], 3: [], 4: ["GPL-3.0"]}
    assert licenses.scan(nothing).count() == 0


def test_archives_round_trip(spark, tmp_path):
    rows = [(1, "http://a/\r\nx", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (5, "u", "long" * 50_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    names = warc.write_archives(warc.with_revisits(pages), str(tmp_path))
    out = {r["page_id"]: r for r in warc.read_archives(spark, str(tmp_path), names).collect()}
    assert {k: r["refers_to"] for k, r in out.items()} == {1: None, 2: 1, 3: None, 4: 3, 5: None}
    assert bytes(out[5]["payload"]) == b"long" * 50_000 and out[2]["payload_bytes"] == 4
    data = bytearray(next(tmp_path.glob("*.zst")).read_bytes())
    data[-6] ^= 1
    with pytest.raises(Exception):
        list(warc.read(bytes(data)))


def test_queries_equal_their_sql(spark):
    folder = "/root/testdata/sf0.001"
    for name, sql in ORACLES.items():
        assert not differences(QUERIES[name](spark, folder).toPandas(), duck(folder).execute(sql).df()), name


def test_pipeline_keeps_columns(spark):
    import corpus_pipeline
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "/root/testdata/sf0.001").columns == docs.columns
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
