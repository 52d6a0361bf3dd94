"""Classifier training, grouped out-of-fold scoring, calibration and persistence on Spark ML."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..constants import THRESHOLD
from ..functions.columns import portable_hash, severity, verdict
from ..session import fresh_path, stored
from . import forest
from .ordered import percentile_columns

# Columns of a feature table that a model must not see (fixed values).
EXCLUDED = (
    "iTOW", "real_time", "lat", "lon", "height", "clock_drift_proxy_s", "attack", "scenario_id", "attack_type",
    "rover_state", "power_w_max", "bands", "n_attack_windows", "window_start_in_range", "run_id",
)


@dataclass
class Scorer:
    """A fitted pipeline with everything needed to read its scores."""

    pipeline: PipelineModel
    features: list[str]
    threshold: float = THRESHOLD
    floor: float = 0.0
    ceiling: float = 1.0
    version: str = "1"
    facts: dict = field(default_factory=dict)

    @property
    def tag(self) -> str:
        """Names the model: version, content, threshold and ordered features, each by the start of its hash."""
        content, features = self.facts.get("content_sha256", "unknown"), _digest("\n".join(self.features))
        return f"{self.version}+{content[:12]}+t{self.threshold:.4f}+f{features[:8]}"


def stamped(scorer: Scorer, spark: SparkSession) -> Scorer:
    """The scorer with a hash of its contents: all nodes or weights of the fitted model and the values filled in for gaps.

    Rows are hashed where they lie and joined without order, so equal models have equal hashes however they are stored.
    """
    if "content_sha256" not in scorer.facts:
        path = fresh_path(spark, "stamp")
        scorer.pipeline.stages[-1].save(path)
        rows = spark.read.parquet(f"{path}/data")
        parts = rows.select(F.xxhash64(F.to_json(F.struct(*rows.columns))).alias("h")).agg(
            F.bit_xor("h").alias("x"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n")).first()
        filled = [s.getStatement() for s in scorer.pipeline.stages if hasattr(s, "getStatement")]
        scorer.facts["content_sha256"] = _digest("\n".join([str(parts["x"]), str(parts["s"]), str(parts["n"]), *filled]))
    return scorer


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def feature_columns(df: DataFrame, excluded=EXCLUDED) -> list[str]:
    """Every column that is not excluded, in table order."""
    return [c for c in df.columns if c not in excluded]


def short_hash(parts: Column, digits: int = 12) -> Column:
    """Prefix of the SHA-256 of the parts joined by newlines."""
    return F.substring(F.sha2(F.array_join(parts, "\n"), 256), 1, digits)


def hash_sample(df: DataFrame, keys: list[str], rows: int, seed: int) -> DataFrame:
    """The same `rows` rows for the same seed, whatever the partitioning."""
    return df.withColumn("_h", portable_hash(F.lit(seed), *keys)).orderBy("_h", *keys).limit(rows).drop("_h")


def hash_sample_with_replacement(df: DataFrame, keys: list[str], fraction: float, seed: int) -> DataFrame:
    return df.sample(withReplacement=True, fraction=fraction, seed=seed)


def class_weights(df: DataFrame, label: str) -> dict[int, float]:
    """rows / (2 * rows of the class) for each class."""
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    return {value: sum(counts.values()) / (2.0 * n) for value, n in counts.items()}


def balanced(df: DataFrame, label: str) -> DataFrame:
    """Adds `weight`, that of the row's class."""
    weight = F.lit(None).cast("double")
    for value, w in class_weights(df, label).items():
        weight = F.when(F.col(label) == value, F.lit(w)).otherwise(weight)
    return df.withColumn("weight", weight)


def positive_weight(df: DataFrame, label: str) -> DataFrame:
    """Adds `weight`: attack rows count clean/attack times."""
    row = df.agg(F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1")).first()
    return df.withColumn("weight", F.when(F.col(label) == 1, F.lit(row["n0"] / max(row["n1"], 1))).otherwise(1.0))


def _prepare(df: DataFrame, features: list[str]) -> list:
    """Stages that fill missing values with the exact training median and assemble a vector."""
    medians = percentile_columns(df, [], {f: (f, 0.5) for f in features}).first()
    filled = ", ".join(f"coalesce(nanvl(CAST(`{f}` AS DOUBLE), NULL), {medians[f] or 0.0!r}D) AS `_x_{f}`" for f in features)
    return [SQLTransformer(statement=f"SELECT *, {filled} FROM __THIS__"),
            VectorAssembler(inputCols=[f"_x_{f}" for f in features], outputCol="_features")]


def _prepared(df: DataFrame, stages: list) -> DataFrame:
    for stage in stages:
        df = stage.transform(df)
    return df


def fit_forest(df: DataFrame, features: list[str], label: str, trees: int = 300, depth: int = 20,
               seed: int = 42) -> PipelineModel:
    weights, stages = class_weights(df, label), _prepare(df, features)
    sides = tuple(weights.get(side, 1.0) for side in (0, 1))
    return PipelineModel([*stages, forest.fit(_prepared(df, stages), features, label, sides, trees, depth, seed)])


def fit_boosted(df: DataFrame, features: list[str], label: str, rounds: int = 300, depth: int = 6, step: float = 0.1,
                sample: float = 0.8, seed: int = 42) -> PipelineModel:
    boosted = GBTClassifier(featuresCol="_features", labelCol=label, weightCol="weight", maxIter=rounds, maxDepth=depth,
                            stepSize=step, subsamplingRate=sample, seed=seed)
    weighted = positive_weight(df, label)
    stages = _prepare(weighted, features)
    return PipelineModel([*stages, boosted.fit(_prepared(weighted, stages))])


def probability(model: PipelineModel, df: DataFrame, out: str = "probability") -> DataFrame:
    scored = model.transform(df)
    added = [c for c in scored.columns if c not in df.columns]
    return scored.withColumn("_p", vector_to_array("probability")[1]).drop(*added).withColumnRenamed("_p", out)


def score(scorer: Scorer, df: DataFrame) -> DataFrame:
    """Adds probability, predicted_label and severity."""
    p = F.col("probability")
    return probability(scorer.pipeline, df).withColumns({
        "predicted_label": verdict(p, scorer.threshold), "severity": severity(p, scorer.floor, scorer.ceiling)})


def _side_by_side(fits: list[Callable], width: int = 4) -> list:
    """Models fitted or applied at the same time: that is many short jobs, which leave executors idle between them."""
    wrap = inheritable_thread_target(SparkSession.getActiveSession())
    with ThreadPool(min(width, len(fits))) as pool:
        return pool.map(lambda run: run(), [wrap(f) for f in fits])


def out_of_fold(df: DataFrame, fold: str, folds: int, fit: Callable[[DataFrame], PipelineModel],
                out: str = "probability") -> DataFrame:
    """Score every row with a model that saw none of its fold; one row in, one row out."""
    parts = _side_by_side([lambda i=i: probability(fit(df.filter(F.col(fold) != i)), df.filter(F.col(fold) == i), out) for i in range(folds)])
    return reduce(DataFrame.unionByName, parts)


def once_per_row(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that were scored never or more than once; empty when all is well."""
    counts = after.groupBy(*keys).agg(F.count("probability").alias("scores"))
    return before.select(*keys).join(counts, keys, "left").filter(F.coalesce("scores", F.lit(0)) != 1)


def inner_fits(df: DataFrame, fold: str, folds: int, fit: Callable[[DataFrame], PipelineModel]) -> dict[frozenset[int], PipelineModel]:
    """A model for each two folds that it has not seen; which of the two is the outer one makes no difference to it."""
    pairs = [(i, j) for i in range(folds) for j in range(i)]
    found = _side_by_side([lambda i=i, j=j: fit(df.filter((F.col(fold) != i) & (F.col(fold) != j))) for i, j in pairs])
    return {frozenset(p): m for p, m in zip(pairs, found, strict=True)}


def inner_scores(df: DataFrame, fold: str, folds: int, label: str, fit: Callable[[DataFrame], PipelineModel]) -> tuple[DataFrame, DataFrame]:
    """The rows with a number `_at`, and the score `_raw` of each row by each inner model that has not seen it.

    An inner model scores its two folds once; `_other` is the one that the row is not in.
    """
    rows = stored(df.withColumn("_at", F.monotonically_increasing_id()), "rows")

    def score_pair(pair: frozenset[int], model: PipelineModel) -> DataFrame:
        other = F.lit(sum(pair)) - F.col(fold)
        return stored(probability(model, rows.filter(F.col(fold).isin(*pair)), "_raw").select("_at", F.col(fold).alias("_fold"), other.cast("int").alias("_other"), F.col(label).alias("_label"), "_raw"), "inner")

    parts = _side_by_side([lambda p=p, m=m: score_pair(p, m) for p, m in inner_fits(rows, fold, folds, fit).items()])
    return rows, reduce(DataFrame.unionByName, parts)


def calibrated(df: DataFrame, fold: str, folds: int, label: str, fit: Callable[[DataFrame], PipelineModel],
               method: str = "sigmoid", out: str = "calibrated", scored: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Out-of-fold calibrated scores with an inner loop over the remaining folds.

    Each inner model is calibrated on the fold it left out; the outer fold gets their mean. `scored` are `inner_scores`
    made before, so that several methods share them.
    """
    rows, scores = scored or inner_scores(df, fold, folds, label, fit)

    def one(i: int, j: int) -> DataFrame:
        known = scores.filter((F.col("_fold") == j) & (F.col("_other") == i)).select("_raw", F.col("_label").alias(label))
        held = scores.filter((F.col("_fold") == i) & (F.col("_other") == j)).select("_at", "_raw")
        return _apply(_calibrator(known, label, method), held, method, "_c").select("_at", F.lit(j).alias("_j"), "_c")

    parts = _side_by_side([lambda i=i, j=j: one(i, j) for i in range(folds) for j in range(folds) if i != j])
    each = reduce(DataFrame.unionByName, parts).groupBy("_at").agg(*[F.max(F.when(F.col("_j") == j, F.col("_c"))).alias(f"_c{j}") for j in range(folds)])
    mean = sum((F.coalesce(f"_c{j}", F.lit(0.0)) for j in range(1, folds)), F.coalesce("_c0", F.lit(0.0))) / (folds - 1)
    return rows.join(each.select("_at", mean.alias(out)), "_at").drop("_at")


def _calibrator(df: DataFrame, label: str, method: str):
    if method == "isotonic":
        return IsotonicRegression(featuresCol="_raw", labelCol=label, predictionCol="_cal").fit(df)
    # Targets drawn in by the size of their class; a row counts for both sides, each by its share.
    counts = df.agg(F.count_if(F.col(label) == 1).alias("n1"), F.count_if(F.col(label) == 0).alias("n0")).first()
    high, low = (counts["n1"] + 1) / (counts["n1"] + 2), 1 / (counts["n0"] + 2)
    target = F.when(F.col(label) == 1, F.lit(high)).otherwise(F.lit(low))
    sides = F.explode(F.array(F.struct(F.lit(1.0).alias("y"), target.alias("w")), F.struct(F.lit(0.0).alias("y"), (1 - target).alias("w"))))
    both = df.select("_raw", sides.alias("_s")).select("_raw", F.col("_s.y").alias("_y"), F.col("_s.w").alias("_w"))
    ready = VectorAssembler(inputCols=["_raw"], outputCol="_v").transform(both)
    return LogisticRegression(featuresCol="_v", labelCol="_y", weightCol="_w", probabilityCol="_pc", rawPredictionCol="_rc",
                              predictionCol="_cal", maxIter=100, tol=1e-8).fit(ready)


def _apply(model, df: DataFrame, method: str, out: str) -> DataFrame:
    if method == "isotonic":
        return model.transform(df).withColumnRenamed("_cal", out).drop("_raw")
    scored = model.transform(VectorAssembler(inputCols=["_raw"], outputCol="_v").transform(df))
    return scored.withColumn(out, vector_to_array("_pc")[1]).drop("_raw", "_v", "_rc", "_pc", "_cal")


def ablation(df: DataFrame, sets: dict[str, list[str]], fold: str, folds: int, label: str,
             fit: Callable[[DataFrame, list[str]], PipelineModel], threshold: float = 0.5) -> DataFrame:
    """Fold metrics of several feature sets, stacked."""
    from .metrics import confusion

    result = None
    for name, columns in sets.items():
        scored = out_of_fold(df, fold, folds, lambda part, columns=columns: fit(part, columns))
        rows = scored.withColumn("predicted", (F.col("probability") >= threshold).cast("int"))
        part = confusion(rows, label, "predicted", [fold]).withColumn("feature_set", F.lit(name))
        result = part if result is None else result.unionByName(part)
    return result


def importances(model: PipelineModel, features: list[str], spark: SparkSession) -> DataFrame:
    """Feature importances, one row per feature."""
    values = model.stages[-1].featureImportances.toArray()
    rows = [(f, float(v)) for f, v in zip(features, values)]
    return spark.createDataFrame(rows, "feature string, importance double")


def same_scores(model: PipelineModel, df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that score differently when scored twice; empty for a deterministic model."""
    first, second = (probability(model, df).select(*keys, "probability") for _ in range(2))
    return first.exceptAll(second)


def save(scorer: Scorer, path: str) -> None:
    """Model and facts side by side; the facts are one JSON row."""
    scorer.pipeline.write().overwrite().save(f"{path}/pipeline")
    facts = {"features": scorer.features, "threshold": scorer.threshold, "floor": scorer.floor,
             "ceiling": scorer.ceiling, "version": scorer.version, "facts": json.dumps(scorer.facts)}
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/facts")


def load(spark: SparkSession, *paths: str) -> Scorer:
    """The first artifact that can be read."""
    for path in paths:
        try:
            facts = json.loads(spark.read.text(f"{path}/facts").first()["value"])
            pipeline = PipelineModel.load(f"{path}/pipeline")
        except Exception:  # noqa: BLE001 - a missing artifact falls through to the next
            continue
        return Scorer(pipeline, facts["features"], facts["threshold"], facts["floor"], facts["ceiling"],
                      facts["version"], json.loads(facts["facts"]))
    raise FileNotFoundError(f"no model under {', '.join(paths)}")
