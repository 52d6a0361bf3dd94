"""Assignment of whole recordings to folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import portable_hash
from .ordered import Ordered


def round_robin(runs: DataFrame, kind: str, run: str, folds: int, seed: int, split_rows=None) -> DataFrame:
    """Spread the recordings of each kind evenly after a seeded shuffle."""
    shuffled = runs.withColumn("_h", portable_hash(F.lit(seed), run))
    numbered = Ordered(shuffled, [kind], ["_h", run], split_rows).number("_i").df
    return numbered.withColumn("fold", F.pmod(F.col("_i") - 1, F.lit(folds)).cast("int")).drop("_h", "_i")


def by_size(rows: DataFrame, run: str, folds: int) -> DataFrame:
    """Recordings in folds of similar row counts, dealt in snake order from the largest down."""
    sizes = rows.groupBy(run).agg(F.count(F.lit(1)).alias("n")).withColumn("_down", -F.col("n"))
    numbered = Ordered(sizes, [], ["_down", run]).number("_i").df
    turn = F.pmod(F.col("_i") - 1, F.lit(2 * folds))
    return numbered.withColumn("fold", F.least(turn, 2 * folds - 1 - turn).cast("int")).drop("_down", "_i")
