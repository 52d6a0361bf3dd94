"""Classifier metrics over (truth, score) rows, optionally per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import ratio
from .ordered import Ordered, percentile_columns, percentiles


def confusion(df: DataFrame, truth: str = "truth", predicted: str = "predicted", by: list[str] | None = None) -> DataFrame:
    """Counts and rates; a rate without a base is NULL."""
    t, p, c = F.col(truth) == 1, F.col(predicted) == 1, F.col
    counts = df.groupBy(*(by or [])).agg(
        F.count_if(~t & ~p).alias("tn"), F.count_if(~t & p).alias("fp"),
        F.count_if(t & ~p).alias("fn"), F.count_if(t & p).alias("tp"))
    return counts.withColumns({
        "accuracy": ratio(c("tn") + c("tp"), c("tn") + c("fp") + c("fn") + c("tp")),
        "attack_recall": ratio(c("tp"), c("tp") + c("fn")), "clean_recall": ratio(c("tn"), c("tn") + c("fp")),
        "false_alarm_rate": ratio(c("fp"), c("fp") + c("tn")), "missed_rate": ratio(c("fn"), c("fn") + c("tp")),
        "attack_precision": ratio(c("tp"), c("tp") + c("fp")), "clean_precision": ratio(c("tn"), c("tn") + c("fn")),
        "clean_support": c("tn") + c("fp"), "attack_support": c("tp") + c("fn")})


def class_report(df: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """Precision, recall, F1 and support per class, plus macro and weighted means."""
    pairs = df.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))
    sides = pairs.select(F.explode(F.array(
        F.struct(F.col(truth).alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("called"),
                 F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col(predicted).alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("called"),
                 F.lit(0).cast("long").alias("hit")))).alias("s")).select("s.*")
    per = sides.groupBy("label").agg(*[F.sum(x).alias(x) for x in ("support", "called", "hit")])
    c = F.col
    per = per.withColumns({"precision": F.coalesce(ratio(c("hit"), c("called")), F.lit(0.0)),
                           "recall": F.coalesce(ratio(c("hit"), c("support")), F.lit(0.0))})
    per = per.withColumn("f1", F.coalesce(ratio(2 * c("precision") * c("recall"), c("precision") + c("recall")), F.lit(0.0)))
    parts = ["precision", "recall", "f1"]
    macro = per.agg(*[F.avg(x).alias(x) for x in parts], F.sum("support").alias("support"))
    heavy = per.agg(*[ratio(F.sum(c(x) * c("support")), F.sum("support")).alias(x) for x in parts],
                    F.sum("support").alias("support"))
    rows = per.select(c("label").cast("string").alias("label"), *parts, "support")
    return rows.unionByName(macro.withColumn("label", F.lit("macro avg"))).unionByName(
        heavy.withColumn("label", F.lit("weighted avg")))


def recall_by(df: DataFrame, kind: str, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """Recall per kind of attack, over true attacks."""
    return df.filter(F.col(truth) == 1).groupBy(kind).agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg(predicted).alias("recall"))


def _by_score(df: DataFrame, truth: str, score: str, by: list[str]) -> DataFrame:
    hit = F.col(truth) == 1
    return df.groupBy(*by, score).agg(F.count_if(hit).alias("_pos"), F.count_if(~hit).alias("_neg"))


def ranking_quality(df: DataFrame, truth: str = "truth", score: str = "probability", by: list[str] | None = None,
                    split_rows=None) -> DataFrame:
    """ROC-AUC (ties count half) and average precision (step sum), per group.

    Rows are reduced to distinct scores first; the running sums over them split if they are many.
    """
    by, c = by or [], F.col
    seq = Ordered(_by_score(df, truth, score, by), by, [score], split_rows)
    seq.running(exclusive=True, _below=("sum", c("_neg")))
    seq.running(reverse=True, _tp=("sum", c("_pos")), _fp=("sum", c("_neg")))
    rows = seq.df.withColumns({
        "_won": c("_pos") * (F.coalesce(c("_below"), F.lit(0)) + c("_neg") / F.lit(2.0)),
        "_step": c("_pos") * ratio(c("_tp"), c("_tp") + c("_fp"))})
    sums = rows.groupBy(*by).agg(F.sum("_won").alias("won"), F.sum("_step").alias("step"),
                                 F.sum("_pos").alias("p"), F.sum("_neg").alias("n"))
    return sums.select(*by, F.try_divide(c("won"), c("p").cast("double") * c("n")).alias("roc_auc"),
                       ratio(c("step"), c("p")).alias("pr_auc"))


def probability_loss(df: DataFrame, truth: str = "truth", score: str = "probability",
                     by: list[str] | None = None) -> DataFrame:
    y, p = F.col(truth).cast("double"), F.col(score)
    safe = F.least(F.greatest(p, F.lit(1e-7)), F.lit(1 - 1e-7))
    return df.groupBy(*(by or [])).agg(
        F.avg((p - y) * (p - y)).alias("brier"),
        F.avg(-(y * F.log(safe) + (1 - y) * F.log(1 - safe))).alias("log_loss"))


def reliability(df: DataFrame, truth: str = "truth", score: str = "probability", bins: int = 10,
                split_rows=None) -> DataFrame:
    """Mean score and observed share per quantile bin of the score."""
    marks = percentiles(df, [], score, {f"_q{i}": i / bins for i in range(bins + 1)}, split_rows)
    edges = marks.select(F.array(*[f"_q{i}" for i in range(1, bins)]).alias("_edges"), F.lit(1).alias("_j"))
    placed = df.withColumn("_j", F.lit(1)).join(F.broadcast(edges), "_j")
    # A score equal to an inner edge belongs to the bin below it.
    number = F.size(F.filter("_edges", lambda e: e < F.col(score)))
    return placed.groupBy(number.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.avg(truth).alias("observed"))


def threshold_counts(df: DataFrame, thresholds: list[float], truth: str, score: str, kind: str) -> DataFrame:
    """Clean and per-kind attack recall at every threshold, from one count per score bucket."""
    cuts = F.array(*[F.lit(float(t)) for t in sorted(thresholds)])
    bucket = F.size(F.filter(cuts, lambda t: t <= F.col(score)))
    group = F.when(F.col(truth) == 1, F.col(kind).cast("string")).otherwise("clean")
    counts = df.groupBy(group.alias("group"), bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_c"))
    totals = counts.groupBy("group").agg(F.sum("_c").alias("n"))
    # A bucket counts for every threshold up to it; buckets are as few as thresholds.
    above = counts.filter("_b > 0").select("group", "_c", F.explode(F.slice(cuts, F.lit(1), F.col("_b"))).alias("threshold"))
    hits = above.groupBy("group", "threshold").agg(F.sum("_c").alias("hits"))
    grid = totals.select("group", "n", F.explode(cuts).alias("threshold"))
    out = grid.join(hits, ["group", "threshold"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return out.withColumn("recall", F.when(F.col("group") == "clean", 1 - ratio(F.col("hits"), F.col("n"))).otherwise(
        ratio(F.col("hits"), F.col("n"))))


def choose_threshold(df: DataFrame, thresholds: list[float], held: str, slack: float = 0.01, start: float = 0.5,
                     truth: str = "truth", score: str = "probability", kind: str = "attack_type") -> DataFrame:
    """Threshold with the best clean recall whose recall on `held` stays near that at `start`.

    The start wins unless another one is strictly better; among equals the lowest wins.
    """
    cuts = sorted({*thresholds, start})
    table = threshold_counts(df, cuts, truth, score, kind)
    wide = table.groupBy("threshold").agg(
        F.max(F.when(F.col("group") == "clean", F.col("recall"))).alias("clean_recall"),
        F.max(F.when(F.col("group") == held, F.col("recall"))).alias("held_recall"))
    base = wide.filter(F.col("threshold") == start).select(F.col("held_recall").alias("_ref"), F.lit(1).alias("_j"))
    ok = wide.withColumn("_j", F.lit(1)).join(F.broadcast(base), "_j").filter(
        F.col("held_recall") >= F.col("_ref") - slack)
    return ok.orderBy(F.desc("clean_recall"), (F.col("threshold") != start), "threshold").limit(1).drop("_ref", "_j")


def severity_anchors(df: DataFrame, truth: str = "truth", score: str = "probability", split_rows=None) -> DataFrame:
    """Median score of clean rows and 90th percentile of attack rows."""
    split = df.select(F.when(F.col(truth) == 0, F.col(score)).alias("c"), F.when(F.col(truth) == 1, F.col(score)).alias("a"))
    return percentile_columns(split, [], {"severity_floor": ("c", 0.5), "severity_ceiling": ("a", 0.9)}, split_rows)


def across_folds(folds: DataFrame, columns: list[str]) -> DataFrame:
    """Mean and sample deviation of fold metrics."""
    return folds.agg(*[f(x).alias(f"{x}_{n}") for x in columns for n, f in (("mean", F.avg), ("std", F.stddev_samp))])


def side_by_side(df: DataFrame, key: str, variant: str, value: str, base: str, other: str) -> DataFrame:
    out = df.groupBy(key).pivot(variant, [base, other]).agg(F.first(value))
    return out.withColumn("delta", F.col(other) - F.col(base))


def error_breakdown(df: DataFrame, run: str, wrong: str, score: str) -> DataFrame:
    """Errors per recording, its share of all errors, and which one is worst."""
    per = df.groupBy(run).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(wrong).cast("long")).alias("n_wrong"),
                              F.avg(F.col(wrong).cast("double")).alias("error_rate"), F.avg(score).alias("mean_score"))
    whole = per.agg(F.sum("n_wrong").alias("_all"), F.max_by(
        run, F.struct("error_rate", F.col(run))).alias("_worst")).withColumn("_j", F.lit(1))
    return per.withColumn("_j", F.lit(1)).join(F.broadcast(whole), "_j").withColumns({
        "share_of_errors": ratio(F.col("n_wrong"), F.col("_all")), "is_worst": F.col(run) == F.col("_worst")}).drop(
        "_j", "_all", "_worst")


def cohorts(df: DataFrame, cohort: Column, features: list[str], split_rows=None) -> DataFrame:
    """Mean and median of features per cohort, long form."""
    from .profile import to_long

    long = to_long(df.withColumn("cohort", cohort).filter(F.col("cohort").isNotNull()), features, ["cohort"])
    means = long.groupBy("cohort", "feature").agg(F.avg("value").alias("mean"))
    mids = percentiles(long, ["cohort", "feature"], "value", {"median": 0.5}, split_rows)
    return means.join(mids, ["cohort", "feature"])


def recall_at(df: DataFrame, run: str, thresholds: list[float], truth: str = "truth",
              score: str = "probability") -> DataFrame:
    """Clean and attack recall of every recording at a few thresholds, in one aggregate."""
    over = [F.avg(F.when(F.col(truth) == 1, (F.col(score) >= t).cast("double"))).alias(f"attack_{i}")
            for i, t in enumerate(thresholds)]
    under = [F.avg(F.when(F.col(truth) == 0, (F.col(score) < t).cast("double"))).alias(f"clean_{i}")
             for i, t in enumerate(thresholds)]
    wide = df.groupBy(run).agg(*over, *under)
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"attack_{i}").alias("attack_recall"),
                              F.col(f"clean_{i}").alias("clean_recall")) for i, t in enumerate(thresholds)])
    return wide.select(run, F.inline(rows))


def attribution_ranking(df: DataFrame, features: list[str], importances: DataFrame) -> DataFrame:
    """Mean absolute attribution beside model importance, with both ranks. One row per feature."""
    wide = df.agg(*[F.avg(F.abs(f)).alias(f) for f in features])
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("mean_abs")) for f in features])
    joined = wide.select(F.inline(pairs)).join(F.broadcast(importances), "feature")
    # As many rows as features.
    return joined.withColumns({
        "attribution_rank": F.rank().over(Window.orderBy(F.desc("mean_abs"))),
        "importance_rank": F.rank().over(Window.orderBy(F.desc("importance")))})
