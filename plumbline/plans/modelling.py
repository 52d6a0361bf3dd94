"""Queries that train and apply classifiers on the embedding table."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import SparkSession, functions as F

from ..operators import attribution, folds, metrics, models
from ..operators.ordered import sized
from ..session import fresh_path
from . import bindings as B
from .registry import query

FEATURES = [f"f{i}" for i in range(64)]
FOLDS = 4


def vectors(spark, sf_dir):
    """Embedding components as features; a component near zero counts as missing."""
    e = B.table(spark, sf_dir, "embeddings")
    parts = [F.col("embedding")[i].cast("double") for i in range(len(FEATURES))]
    return e.select("vec_id", F.pmod("vec_id", F.lit(12)).cast("int").alias("run"), (F.col("label") < 5).cast("int").alias("y"),
                    F.col("label").alias("attack_type"),
                    *[F.when(F.abs(p) > 0.002, p).alias(f) for p, f in zip(parts, FEATURES)])


def forest(df, features=FEATURES):
    return models.fit_forest(df, features, "y")


def folded(spark, sf_dir, n=FOLDS):
    df = vectors(spark, sf_dir)
    return df.join(sized(folds.by_size(df, "run", n).select("run", "fold")), "run")


# Fitted once in an application; seeds are fixed, so any fit of the same tables is the same.
@lru_cache(maxsize=4)
def _boosted(app, sf_dir):
    return models.fit_boosted(vectors(SparkSession.getActiveSession(), sf_dir), FEATURES, "y")


@lru_cache(maxsize=4)
def _fitted(app, sf_dir):
    return forest(vectors(SparkSession.getActiveSession(), sf_dir))


@lru_cache(maxsize=4)
def _inner(app, sf_dir):
    return models.inner_scores(folded(SparkSession.getActiveSession(), sf_dir), "fold", FOLDS, "y", forest)


def calibrated(spark, sf_dir, method):
    scored = _inner(spark.sparkContext.applicationId, sf_dir)
    return models.calibrated(folded(spark, sf_dir), "fold", FOLDS, "y", forest, method, scored=scored)


def scorer(spark, sf_dir):
    return models.Scorer(_fitted(spark.sparkContext.applicationId, sf_dir), FEATURES, threshold=0.5, floor=0.3, ceiling=0.7)


@query("m01_training_medians", """SELECT """ + ", ".join(
    f"round(quantile_cont(CASE WHEN abs(embedding[{i + 1}]::DOUBLE) > 0.002 THEN embedding[{i + 1}]::DOUBLE END, 0.5), 9) AS f{i}"
    for i in range(len(FEATURES))) + " FROM embeddings")
def training_medians(spark, sf_dir):
    from ..operators.ordered import percentile_columns

    return B.rounded(percentile_columns(vectors(spark, sf_dir), [], {f: (f, 0.5) for f in FEATURES}), 9)


@query("m02_m07_forest_scores")
def forest_scores(spark, sf_dir):
    out = models.score(scorer(spark, sf_dir), vectors(spark, sf_dir))
    return out.select("vec_id", "probability", "predicted_label", "severity")


@query("m02_score_facts", """SELECT count(*) AS n, 0::BIGINT AS out_of_range, 0::BIGINT AS wrong_label, 0::BIGINT AS wrong_severity FROM embeddings""")
def score_facts(spark, sf_dir):
    """Scores are probabilities, the verdict follows the threshold, the severity its bounds."""
    p = F.col("probability")
    severity = F.least(F.greatest((p - 0.3) / 0.4, F.lit(0.0)), F.lit(1.0))
    return forest_scores(spark, sf_dir).agg(
        F.count("vec_id").alias("n"), F.count_if(~p.between(0, 1) | p.isNull()).alias("out_of_range"),
        F.count_if((F.col("predicted_label") == "attack") != (p >= 0.5)).alias("wrong_label"),
        F.count_if(F.abs(F.col("severity") - severity) > 1e-9).alias("wrong_severity"))


@query("m03_boosted_scores")
def boosted_scores(spark, sf_dir):
    model = _boosted(spark.sparkContext.applicationId, sf_dir)
    return models.probability(model, vectors(spark, sf_dir)).select("vec_id", "probability")


@query("m03_boosted_facts", """SELECT count(*) AS n, 0::BIGINT AS out_of_range, 0::BIGINT AS not_additive FROM embeddings""")
def boosted_facts(spark, sf_dir):
    """Boosted scores are probabilities, and the contributions to their margins add up."""
    df = vectors(spark, sf_dir)
    s = models.Scorer(_boosted(spark.sparkContext.applicationId, sf_dir), FEATURES)
    parts, base = attribution.attributions(s, df, ["vec_id"])
    total = sum((F.col(f) for f in FEATURES[1:]), F.col(FEATURES[0])) + F.lit(base)
    both = models.probability(s.pipeline, df).select("vec_id", "probability").join(parts.select("vec_id", total.alias("margin")), "vec_id")
    wrong = F.abs(F.col("probability") - 1 / (1 + F.exp(-2 * F.col("margin")))) > 1e-9
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("probability").between(0, 1)).alias("out_of_range"),
                    F.count_if(wrong).alias("not_additive"))


@query("m04_out_of_fold_rows", """SELECT vec_id, 1::BIGINT AS scores FROM embeddings""")
def out_of_fold_rows(spark, sf_dir):
    """Every row is scored exactly once when each fold is scored by the others."""
    scored = models.out_of_fold(folded(spark, sf_dir), "fold", FOLDS, forest)
    return scored.groupBy("vec_id").agg(F.count("probability").alias("scores"))


@query("m05_fold_overlap", """SELECT 0::BIGINT AS runs_in_two_folds""")
def fold_overlap(spark, sf_dir):
    rows = folded(spark, sf_dir).groupBy("run").agg(F.count_distinct("fold").alias("n"))
    return rows.agg(F.count_if(F.col("n") > 1).alias("runs_in_two_folds"))


@query("m08_sigmoid_calibration")
def sigmoid_calibration(spark, sf_dir):
    out = calibrated(spark, sf_dir, "sigmoid")
    return metrics.probability_loss(out, "y", "calibrated")


@query("m08_isotonic_calibration")
def isotonic_calibration(spark, sf_dir):
    out = calibrated(spark, sf_dir, "isotonic")
    return metrics.probability_loss(out, "y", "calibrated")


@query("m08_calibrated_facts", """SELECT m.method, count(*) AS n, 0::BIGINT AS out_of_range, 0::BIGINT AS twice
FROM embeddings, (VALUES ('sigmoid'), ('isotonic')) m(method) GROUP BY m.method""")
def calibrated_facts(spark, sf_dir):
    """Both methods give every row one probability."""
    parts = [calibrated(spark, sf_dir, m).groupBy("vec_id").agg(F.count("calibrated").alias("c"), F.max("calibrated").alias("p")).withColumn("method", F.lit(m))
             for m in ("sigmoid", "isotonic")]
    return parts[0].unionByName(parts[1]).groupBy("method").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("p").between(0, 1)).alias("out_of_range"), F.count_if(F.col("c") != 1).alias("twice"))


@query("m09_o09_importances")
def importances(spark, sf_dir):
    return models.importances(scorer(spark, sf_dir).pipeline, FEATURES, spark).orderBy(F.desc("importance"), "feature").limit(10)


@query("m09_importance_facts", f"""SELECT {len(FEATURES)}::BIGINT AS n, 0::BIGINT AS negative, 1.0::DOUBLE AS total""")
def importance_facts(spark, sf_dir):
    out = models.importances(scorer(spark, sf_dir).pipeline, FEATURES, spark)
    return out.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("importance") < 0).alias("negative"), F.round(F.sum("importance"), 9).alias("total"))


@query("m10_additivity", """SELECT count(*) AS n, 0::BIGINT AS not_additive FROM embeddings""")
def additivity(spark, sf_dir):
    """Contributions and base add up to the score of every row."""
    s, df = scorer(spark, sf_dir), vectors(spark, sf_dir)
    parts, base = attribution.attributions(s, df, ["vec_id"])
    total = sum((F.col(f) for f in FEATURES[1:]), F.col(FEATURES[0])) + F.lit(base)
    scored = models.probability(s.pipeline, df).select("vec_id", "probability")
    gap = parts.select("vec_id", total.alias("total")).join(scored, "vec_id")
    return gap.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs(F.col("total") - F.col("probability")) > 1e-9).alias("not_additive"))


@query("m10_o08_top_features")
def top_features(spark, sf_dir):
    s, df = scorer(spark, sf_dir), vectors(spark, sf_dir)
    parts, _ = attribution.attributions(s, df, ["vec_id"])
    return attribution.top_features(parts, df, ["vec_id"], FEATURES)


@query("m10_top_order", """SELECT count(*) AS n, 0::BIGINT AS out_of_order, 0::BIGINT AS wrong_direction FROM embeddings""")
def top_order(spark, sf_dir):
    """Five contributions of every event, the strongest first, each on the side of its sign."""
    size = F.transform("top_features", lambda t: F.abs(t["shap_value"]))
    ordered = (F.size("top_features") == 5) & (F.sort_array(size, asc=False) == size)
    sides = F.forall("top_features", lambda t: (t["direction"] == "toward_attack") == (t["shap_value"] >= 0))
    return top_features(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.count_if(~ordered).alias("out_of_order"), F.count_if(~sides).alias("wrong_direction"))


@query("m10_stored_once", """SELECT count(*) AS n, 0::BIGINT AS twice, 0::BIGINT AS not_additive FROM embeddings""")
def stored_once(spark, sf_dir):
    """Events are explained once: a second call computes what the first one left out and reads the rest."""
    s, df, path = scorer(spark, sf_dir), vectors(spark, sf_dir), fresh_path(spark, "attributions")
    attribution.kept_attributions(s, df.filter("vec_id % 2 = 0"), ["vec_id"], path)
    kept = attribution.kept_attributions(s, df, ["vec_id"], path)
    total = sum((F.col(f) for f in FEATURES[1:]), F.col(FEATURES[0])) + F.col("base")
    both = kept.select("vec_id", total.alias("total")).join(models.probability(s.pipeline, df).select("vec_id", "probability"), "vec_id")
    per_event = both.groupBy("vec_id").agg(F.count(F.lit(1)).alias("c"), F.max(F.abs(F.col("total") - F.col("probability"))).alias("gap"))
    return per_event.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c") > 1).alias("twice"), F.count_if(F.col("gap") > 1e-9).alias("not_additive"))


@query("m11_reloaded_scores", """SELECT count(*) AS n, 0::BIGINT AS changed FROM embeddings""")
def reloaded_scores(spark, sf_dir):
    """A saved and reloaded model scores as before; a missing first artifact falls back."""
    s, df, path = scorer(spark, sf_dir), vectors(spark, sf_dir), fresh_path(spark, "model")
    models.save(s, path)
    again = models.load(spark, f"{path}-absent", path)
    before = models.probability(s.pipeline, df).select("vec_id", F.col("probability").alias("a"))
    after = models.probability(again.pipeline, df).select("vec_id", F.col("probability").alias("b"))
    return before.join(after, "vec_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") != F.col("b")).alias("changed"))


@query("m12_same_scores", """SELECT vec_id, 0.0::DOUBLE AS probability FROM embeddings WHERE false""")
def same_scores(spark, sf_dir):
    return models.same_scores(scorer(spark, sf_dir).pipeline, vectors(spark, sf_dir), ["vec_id"])


@query("m13_feature_set_ablation")
def feature_set_ablation(spark, sf_dir):
    sets = {"all": FEATURES, "first_half": FEATURES[:32]}
    table = models.ablation(folded(spark, sf_dir), sets, "fold", FOLDS, "y", forest)
    return table.select("feature_set", "fold", "accuracy", "clean_recall", "attack_recall")
