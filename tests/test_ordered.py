"""Split and plain mode give the same rows, also when one key holds most of them."""

import random

import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from plumbline.operators.ordered import Ordered, percentile_columns, percentiles


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(3)
    rows = [("hot" if i % 3 else f"k{i % 7}", i // 4, i, None if rng.random() < 0.4 else rng.randint(0, 50)) for i in range(900)]
    return spark.createDataFrame(rows, "key string, t long, id long, v int")


def rows(df, order=("id",)):
    return df.orderBy(*order).toPandas().reset_index(drop=True)


@pytest.mark.parametrize("keys", [["key"], []])
@pytest.mark.parametrize("reverse", [False, True])
@pytest.mark.parametrize("exclusive", [False, True])
def test_running_is_the_same_when_keys_are_split(skewed, keys, reverse, exclusive):
    columns = dict(s=("sum", F.col("v")), m=("max", F.col("v")), n=("min", F.col("v")), last=("last", F.col("v")))
    plain = Ordered(skewed, keys, ["t", "id"])
    split = Ordered(skewed, keys, ["t", "id"], split_rows=60)
    assert not plain.is_split and split.is_split
    a, b = (rows(x.running(exclusive, reverse, **columns).df) for x in (plain, split))
    pd.testing.assert_frame_equal(a, b[a.columns])


@pytest.mark.parametrize("before", [1, 4, 59])
def test_look_back_reaches_over_chunks(skewed, before):
    def steps(w):
        return F.sum("v").over(w.rowsBetween(-before, 0))

    plain, split = (Ordered(skewed, ["key"], ["t", "id"], split_rows=s).within(
        before, total=steps, first=lambda w: F.lag("id", before).over(w)) for s in (None, 25))
    pd.testing.assert_frame_equal(rows(plain.df), rows(split.df))


def test_look_back_over_chunks_shorter_than_it(spark):
    data = spark.range(40).select(F.lit("a").alias("key"), F.col("id"), (F.col("id") % 5).alias("v"))
    split = Ordered(data, ["key"], ["id"], split_rows=3).within(30, s=lambda w: F.sum("v").over(w.rowsBetween(-30, 0)))
    assert split.is_split
    wanted = Ordered(data, ["key"], ["id"]).within(30, s=lambda w: F.sum("v").over(w.rowsBetween(-30, 0)))
    pd.testing.assert_frame_equal(rows(wanted.df), rows(split.df))


def test_steps_can_follow_each_other(skewed):
    def chain(seq):
        seq.within(1, prev=lambda w: F.lag("t").over(w))
        seq.map(lambda d: d.withColumn("open", F.when(F.col("prev") == F.col("t"), 0).otherwise(1)))
        seq.running(group=("sum", F.col("open")))
        return seq.number("pos").df

    plain, split = (chain(Ordered(skewed, ["key"], ["t", "id"], split_rows=s)) for s in (None, 40))
    pd.testing.assert_frame_equal(rows(plain), rows(split)[plain.columns])


def test_number_matches_row_number_over_null_keys(spark):
    data = spark.createDataFrame([(None if i % 2 else i % 3, i) for i in range(60)], "key int, id long")
    wanted = data.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("id")).cast("long"))
    split = Ordered(data, ["key"], ["id"], split_rows=5).number("n")
    assert split.is_split
    pd.testing.assert_frame_equal(rows(wanted), rows(split.df))


@pytest.mark.parametrize("keys", [["key"], []])
def test_percentiles_by_rank_equal_the_aggregate(skewed, keys):
    wanted = {"p0": 0.0, "p10": 0.1, "mid": 0.5, "p99": 0.999, "p1": 1.0}
    plain, split = (percentiles(skewed, keys, "v", wanted, split_rows=s).toPandas() for s in (None, 30))
    if keys:
        plain, split = (x.sort_values(keys).reset_index(drop=True) for x in (plain, split))
    pd.testing.assert_frame_equal(plain, split, check_dtype=False)


def test_percentile_of_no_values_is_missing(spark):
    data = spark.createDataFrame([("a", None), ("a", None), ("b", 1.0), ("b", 2.0)], "key string, v double")
    got = percentile_columns(data, ["key"], {"m": ("v", 0.5)}, split_rows=1).orderBy("key").collect()
    assert [r["m"] for r in got] == [None, 1.5]
