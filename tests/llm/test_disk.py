"""What operators leave in the shared folder and in Spark's own folders."""

import os
import random

import numpy as np

from plumbline.llm import simhash, suffixes
from plumbline.session import shared_dir

SCHEMA = "doc_id long, text string"


def tables(spark):
    folder = f"{shared_dir(spark).removeprefix('file:')}/plumbline"
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def shuffled(spark):
    """Bytes of shuffle files of the session."""
    tops = [str(p) for p in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    return sum(os.path.getsize(f"{d}/{f}") for top in tops for d, _, names in os.walk(top) for f in names if f.startswith("shuffle_"))


def texts(spark):
    pick = random.Random(8)
    base = [" ".join(f"w{pick.randrange(400)}" for _ in range(120)) for _ in range(20)]
    rows = [(k, base[k % 20] + f" tail {k} " + base[(k * 7 + 1) % 20]) for k in range(60)]
    return spark.createDataFrame(rows, SCHEMA)


def test_suffix_removal_leaves_its_spans_only(spark):
    docs, before, held = texts(spark), tables(spark), shuffled(spark)
    _, cover = suffixes.mark(docs)
    left = tables(spark) - before
    assert {name.split("-")[0] for name in left} == {"cover"} and len(left) == 1
    assert shuffled(spark) <= held
    assert cover.count() == 60


def test_pipeline_stage_leaves_no_sets(spark):
    docs, before, held = texts(spark), tables(spark), shuffled(spark)
    found = simhash.distinct_by_similarity(docs)
    left = {name.rsplit("-", 1)[0] for name in tables(spark) - before}
    assert not left & {"prefixes", "distinct-sets", "drawn-sets", "met", "open", "pairs", "sets", "similar"}
    assert shuffled(spark) <= held
    assert 0 < found.count() <= 20


def test_signatures_rule_out_only_what_cannot_be_similar():
    pick = np.random.default_rng(3)
    ruled_out = 0
    for _ in range(400):
        n = int(pick.choice([1, 3, 16, 17, 60, 300, 2000]))
        base = pick.integers(-(1 << 63), 1 << 63, n)
        kept = base[pick.random(n) < pick.choice([0.5, 0.8, 0.95, 1.0])]
        other = np.unique(np.r_[kept, pick.integers(-(1 << 63), 1 << 63, int(n * pick.choice([0, 0.05, 0.3, 1.2])) + 1)])
        base = np.unique(base)
        shared = len(np.intersect1d(base, other))
        most = simhash.most_shared(len(base), simhash.signature(base), len(other), simhash.signature(other))
        assert shared <= most <= min(len(base), len(other))
        ruled_out += most < 0.8 * max(len(base), len(other))
    assert ruled_out > 100
