"""Queries that judge verdicts against labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import folds, metrics, summaries
from . import bindings as B
from .registry import query


def judged(spark, sf_dir, threshold: float = 0.1):
    return B.events(spark, sf_dir).withColumn("predicted", (F.col("probability") >= threshold).cast("int"))


JUDGED = f"""WITH {B.EVENTS}, ju AS (SELECT *, CASE WHEN probability >= 0.1 THEN 1 ELSE 0 END AS predicted FROM ev)"""
RATES = """count(*) FILTER (truth = 0 AND predicted = 0) AS tn, count(*) FILTER (truth = 0 AND predicted = 1) AS fp,
  count(*) FILTER (truth = 1 AND predicted = 0) AS fn, count(*) FILTER (truth = 1 AND predicted = 1) AS tp"""


@query("a15_confusion", JUDGED + f""", c AS (SELECT {RATES} FROM ju)
SELECT tn, fp, fn, tp, round((tn + tp) / (tn + fp + fn + tp), 6) AS accuracy, round(tp / (tp + fn), 6) AS attack_recall, round(tn / (tn + fp), 6) AS clean_recall,
  round(fp / (fp + tn), 6) AS false_alarm_rate, round(fn / (fn + tp), 6) AS missed_rate, round(tp / (tp + fp), 6) AS attack_precision,
  round(tn / (tn + fn), 6) AS clean_precision, tn + fp AS clean_support, tp + fn AS attack_support FROM c""")
def confusion(spark, sf_dir):
    return B.rounded(metrics.confusion(judged(spark, sf_dir)))


@query("a16_class_report", JUDGED + """, p AS (
  SELECT l AS label, count(*) FILTER (truth = l) AS support, count(*) FILTER (truth = l AND predicted = l) / nullif(count(*) FILTER (predicted = l), 0) AS precision,
    count(*) FILTER (truth = l AND predicted = l) / count(*) FILTER (truth = l) AS recall FROM ju, (VALUES (0), (1)) v(l) GROUP BY l), f AS (
  SELECT *, 2 * precision * recall / (precision + recall) AS f1 FROM p)
SELECT CAST(label AS VARCHAR) AS label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM f
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f""")
def class_report(spark, sf_dir):
    return B.rounded(metrics.class_report(judged(spark, sf_dir)))


@query("a17_recall_by_type", JUDGED + " SELECT attack_type, count(*) AS n_rows, round(avg(predicted), 6) AS recall FROM ju WHERE truth = 1 GROUP BY attack_type")
def recall_by_type(spark, sf_dir):
    return B.rounded(metrics.recall_by(judged(spark, sf_dir), "attack_type"))


@query("a18_a19_ranking_quality", JUDGED + """, g AS (SELECT probability, count(*) FILTER (truth = 1) AS pos, count(*) FILTER (truth = 0) AS neg FROM ju GROUP BY probability), c AS (
  SELECT *, coalesce(sum(neg) OVER (ORDER BY probability ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
    sum(pos) OVER (ORDER BY probability DESC) AS tp, sum(neg) OVER (ORDER BY probability DESC) AS fp FROM g)
SELECT round(sum(pos * (below + neg / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * sum(neg)), 6) AS roc_auc, round(sum(pos * (tp / (tp + fp))) / sum(pos), 6) AS pr_auc FROM c""")
def ranking_quality(spark, sf_dir):
    return B.rounded(metrics.ranking_quality(judged(spark, sf_dir)))


FOLDED = JUDGED + ", fo AS (SELECT *, site % 4 AS fold FROM ju)"


def _folded(spark, sf_dir):
    return judged(spark, sf_dir).withColumn("fold", F.pmod("site", F.lit(4)))


@query("a20_across_folds", FOLDED + f""", c AS (SELECT fold, {RATES} FROM fo GROUP BY fold), m AS (
  SELECT (tn + tp) / (tn + fp + fn + tp) AS accuracy, tn / (tn + fp) AS clean_recall, tp / (tp + fn) AS attack_recall FROM c)
SELECT round(avg(accuracy), 6) AS accuracy_mean, round(stddev_samp(accuracy), 6) AS accuracy_std, round(avg(clean_recall), 6) AS clean_recall_mean,
  round(stddev_samp(clean_recall), 6) AS clean_recall_std, round(avg(attack_recall), 6) AS attack_recall_mean, round(stddev_samp(attack_recall), 6) AS attack_recall_std FROM m""")
def across_folds(spark, sf_dir):
    per_fold = metrics.confusion(_folded(spark, sf_dir), by=["fold"])
    return B.rounded(metrics.across_folds(per_fold, ["accuracy", "clean_recall", "attack_recall"]))


@query("a20_ranking_by_fold", FOLDED + """, g AS (SELECT fold, probability, count(*) FILTER (truth = 1) AS pos, count(*) FILTER (truth = 0) AS neg FROM fo GROUP BY ALL), c AS (
  SELECT *, coalesce(sum(neg) OVER (PARTITION BY fold ORDER BY probability ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
    sum(pos) OVER (PARTITION BY fold ORDER BY probability DESC) AS tp, sum(neg) OVER (PARTITION BY fold ORDER BY probability DESC) AS fp FROM g)
SELECT fold, round(sum(pos * (below + neg / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * sum(neg)), 6) AS roc_auc, round(sum(pos * (tp / (tp + fp))) / sum(pos), 6) AS pr_auc FROM c GROUP BY fold""")
def ranking_by_fold(spark, sf_dir):
    return B.rounded(metrics.ranking_quality(_folded(spark, sf_dir), by=["fold"]))


@query("a21_probability_loss", JUDGED + """
SELECT round(avg((probability - truth) * (probability - truth)), 6) AS brier,
  round(avg(-(truth * ln(least(greatest(probability, 1e-7), 1 - 1e-7)) + (1 - truth) * ln(1 - least(greatest(probability, 1e-7), 1 - 1e-7)))), 6) AS log_loss FROM ju""")
def probability_loss(spark, sf_dir):
    return B.rounded(metrics.probability_loss(judged(spark, sf_dir)))


@query("a22_reliability", JUDGED + """, q AS (SELECT quantile_cont(probability, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM ju)
SELECT len(list_filter(e, lambda x: x < probability)) AS bin, count(*) AS n, round(avg(probability), 6) AS mean_score, round(avg(truth), 6) AS observed FROM ju, q GROUP BY bin""")
def reliability(spark, sf_dir):
    return B.rounded(metrics.reliability(judged(spark, sf_dir)).withColumn("bin", F.col("bin").cast("long")))


GRID = [round(0.05 * i, 2) for i in range(1, 15)]


@query("a23_threshold_choice", JUDGED + """, t(threshold) AS (SELECT round(0.05 * i, 2)::DOUBLE FROM range(1, 15) r(i)), m AS (
  SELECT threshold, avg(CASE WHEN probability < threshold THEN 1.0::DOUBLE ELSE 0 END) FILTER (truth = 0) AS clean_recall,
    avg(CASE WHEN probability >= threshold THEN 1.0::DOUBLE ELSE 0 END) FILTER (truth = 1 AND attack_type = 1) AS held_recall FROM ju, t GROUP BY threshold)
SELECT threshold, round(clean_recall, 6) AS clean_recall, round(held_recall, 6) AS held_recall FROM m
WHERE held_recall >= (SELECT held_recall FROM m WHERE threshold = 0.1) - 0.05 ORDER BY m.clean_recall DESC, threshold <> 0.1, threshold LIMIT 1""")
def threshold_choice(spark, sf_dir):
    best = metrics.choose_threshold(judged(spark, sf_dir), GRID, held="1", slack=0.05, start=0.1)
    return B.rounded(best.select("threshold", "clean_recall", "held_recall"))


@query("a23_threshold_table", JUDGED + """, t(threshold) AS (SELECT round(0.05 * i, 2)::DOUBLE FROM range(1, 15) r(i)), g AS (
  SELECT CASE WHEN truth = 1 THEN CAST(attack_type AS VARCHAR) ELSE 'clean' END AS grp, probability FROM ju)
SELECT grp AS "group", threshold, count(*) AS n, count(*) FILTER (probability >= threshold) AS hits FROM g, t GROUP BY ALL""")
def threshold_table(spark, sf_dir):
    out = metrics.threshold_counts(judged(spark, sf_dir), GRID, "truth", "probability", "attack_type")
    return out.select("group", "threshold", "n", "hits")


@query("a24_severity_anchors", JUDGED + """
SELECT round(quantile_cont(probability, 0.5) FILTER (truth = 0), 6) AS severity_floor, round(quantile_cont(probability, 0.9) FILTER (truth = 1), 6) AS severity_ceiling FROM ju""")
def severity_anchors(spark, sf_dir):
    return B.rounded(metrics.severity_anchors(judged(spark, sf_dir)))


@query("p15_severity", JUDGED + """, a AS (SELECT quantile_cont(probability, 0.5) FILTER (truth = 0) AS f, quantile_cont(probability, 0.9) FILTER (truth = 1) AS c FROM ju)
SELECT event_id, round(least(greatest((probability - f) / greatest(c - f, 1e-9), 0), 1), 6) AS severity FROM ju, a""")
def severity(spark, sf_dir):
    rows = judged(spark, sf_dir)
    anchors = metrics.severity_anchors(rows).withColumn("_j", F.lit(1))
    joined = rows.select("event_id", "probability").withColumn("_j", F.lit(1)).join(F.broadcast(anchors), "_j")
    span = F.greatest(F.col("severity_ceiling") - F.col("severity_floor"), F.lit(1e-9))
    scaled = F.least(F.greatest((F.col("probability") - F.col("severity_floor")) / span, F.lit(0.0)), F.lit(1.0))
    return joined.select("event_id", B.r(scaled).alias("severity"))


@query("a08_summary_tables", JUDGED + """
SELECT attack_type, truth, count(*) AS n, round(avg(value), 6) AS value_mean, round(stddev_samp(value), 6) AS value_std, round(avg(k), 6) AS k_mean, round(stddev_samp(k), 6) AS k_std
FROM ju GROUP BY GROUPING SETS ((attack_type, truth), (attack_type), (truth), ())""")
def summary_tables(spark, sf_dir):
    return B.rounded(summaries.by_groups(judged(spark, sf_dir), ["attack_type", "truth"], ["value", "k"]))


@query("a09_run_catalogue", JUDGED + """
SELECT site, min(attack_type) AS attack_type, count(*) AS n_rows, CAST(sum(truth) AS BIGINT) AS n_attack FROM ju GROUP BY site""")
def run_catalogue(spark, sf_dir):
    return summaries.catalogue(judged(spark, sf_dir), "site", ["attack_type"], "truth")


HELD_OUT = [(f"Customer#{i:09d}",) for i in (1, 2, 3, 5, 8, 9, 11, 13)]
HELD_OUT_SQL = ", ".join(f"('{name}')" for (name,) in HELD_OUT)


@query("p32_j16_m06_held_out_rows", JUDGED + f""", h(site_name) AS (VALUES {HELD_OUT_SQL})
SELECT site_name, event_id, predicted FROM ju JOIN customer ON c_custkey = site JOIN h ON h.site_name = c_name""")
def held_out_rows(spark, sf_dir):
    rows = judged(spark, sf_dir).join(B.sites(spark, sf_dir).select("site", "site_name"), "site")
    chosen = summaries.select_runs(rows, HELD_OUT, ["site_name"], "site")
    return rows.join(F.broadcast(chosen.select("site")), "site", "left_semi").select("site_name", "event_id", "predicted")


@query("a37_error_breakdown", JUDGED + """, p AS (
  SELECT site, count(*) AS n, CAST(sum(CASE WHEN predicted <> truth THEN 1 ELSE 0 END) AS BIGINT) AS n_wrong, avg(CASE WHEN predicted <> truth THEN 1.0::DOUBLE ELSE 0 END) AS error_rate, avg(probability) AS mean_score FROM ju GROUP BY site)
SELECT site, n, n_wrong, round(error_rate, 6) AS error_rate, round(mean_score, 6) AS mean_score, round(n_wrong / sum(n_wrong) OVER (), 6) AS share_of_errors,
  site = (SELECT arg_max(site, (error_rate, site)) FROM p) AS is_worst FROM p""")
def error_breakdown(spark, sf_dir):
    rows = judged(spark, sf_dir).withColumn("wrong", F.col("predicted") != F.col("truth"))
    return B.rounded(metrics.error_breakdown(rows, "site", "wrong", "probability"))


@query("a38_cohorts", JUDGED + """, c AS (SELECT CASE WHEN truth = 1 THEN NULL WHEN predicted = 1 THEN 'wrong' WHEN site % 4 = 3 THEN 'right' ELSE 'other' END AS cohort, value, k FROM ju), l AS (
  SELECT cohort, 'value' AS feature, value AS v FROM c UNION ALL SELECT cohort, 'k', k FROM c)
SELECT cohort, feature, round(avg(v), 6) AS mean, round(median(v), 6) AS median FROM l WHERE cohort IS NOT NULL GROUP BY ALL""")
def cohorts(spark, sf_dir):
    cohort = F.when(F.col("truth") == 1, None).when(F.col("predicted") == 1, "wrong").when(
        F.pmod("site", F.lit(4)) == 3, "right").otherwise("other")
    return B.rounded(metrics.cohorts(judged(spark, sf_dir), cohort, ["value", "k"]))


@query("a44_side_by_side", JUDGED + """, r AS (SELECT attack_type, avg(CASE WHEN probability >= 0.1 THEN 1.0::DOUBLE ELSE 0 END) AS a, avg(CASE WHEN probability >= 0.2 THEN 1.0::DOUBLE ELSE 0 END) AS b FROM ju WHERE truth = 1 GROUP BY attack_type)
SELECT attack_type, round(a, 6) AS base, round(b, 6) AS strict, round(b - a, 6) AS delta FROM r""")
def side_by_side(spark, sf_dir):
    base = metrics.recall_by(judged(spark, sf_dir), "attack_type").withColumn("variant", F.lit("base"))
    strict = metrics.recall_by(judged(spark, sf_dir, 0.2), "attack_type").withColumn("variant", F.lit("strict"))
    return B.rounded(metrics.side_by_side(base.unionByName(strict), "attack_type", "variant", "recall", "base", "strict"))


@query("a45_recall_at_thresholds", JUDGED + """, t(threshold) AS (VALUES (0.1::DOUBLE), (0.2::DOUBLE))
SELECT site, threshold, round(avg(CASE WHEN probability >= threshold THEN 1 ELSE 0 END) FILTER (truth = 1), 6) AS attack_recall,
  round(avg(CASE WHEN probability < threshold THEN 1 ELSE 0 END) FILTER (truth = 0), 6) AS clean_recall FROM ju, t GROUP BY site, threshold""")
def recall_at_thresholds(spark, sf_dir):
    return B.rounded(metrics.recall_at(judged(spark, sf_dir), "site", [0.1, 0.2]))


@query("a43_attribution_ranking", f"""WITH {B.EVENTS}, a AS (SELECT 'value' AS feature, avg(abs(severity - 0.3)) AS mean_abs, stddev_samp(value) AS importance FROM ev
  UNION ALL SELECT 'k', avg(abs(k / 100.0::DOUBLE - 0.5)), stddev_samp(k) FROM ev)
SELECT feature, round(mean_abs, 6) AS mean_abs, round(importance, 6) AS importance, rank() OVER (ORDER BY mean_abs DESC) AS attribution_rank, rank() OVER (ORDER BY importance DESC) AS importance_rank FROM a""")
def attribution_ranking(spark, sf_dir):
    e = B.events(spark, sf_dir)
    spread = e.agg(F.stddev_samp("value").alias("value"), F.stddev_samp("k").alias("k")).select(F.inline(F.array(
        F.struct(F.lit("value").alias("feature"), F.col("value").alias("importance")),
        F.struct(F.lit("k").alias("feature"), F.col("k").alias("importance")))))
    parts = e.select((F.col("severity") - 0.3).alias("value"), (F.col("k") / 100.0 - 0.5).alias("k"))
    out = B.rounded(metrics.attribution_ranking(parts, ["value", "k"], spread))
    return out.withColumns({c: F.col(c).cast("long") for c in ("attribution_rank", "importance_rank")})


@query("w28_balanced_folds", JUDGED + """
SELECT site, attack_type, CAST((row_number() OVER (PARTITION BY attack_type ORDER BY substr(md5('42:' || site), 1, 15), site) - 1) % 4 AS INTEGER) AS fold
FROM (SELECT DISTINCT site, attack_type FROM ju)""")
def balanced_folds(spark, sf_dir):
    """Every recording in one of four folds, round-robin within its type after a seeded shuffle."""
    runs = judged(spark, sf_dir).select("site", "attack_type").distinct()
    return folds.round_robin(runs, "attack_type", "site", 4, seed=42)


@query("w28_fold_sizes", JUDGED + """, t AS (SELECT attack_type, count(DISTINCT site) AS n FROM ju GROUP BY attack_type)
SELECT attack_type, CAST(f AS INTEGER) AS fold, n // 4 + CASE WHEN f < n % 4 THEN 1 ELSE 0 END AS n_runs FROM t, range(4) r(f) WHERE f < n""")
def fold_sizes(spark, sf_dir):
    out = balanced_folds(spark, sf_dir)
    return out.groupBy("attack_type", "fold").agg(F.count(F.lit(1)).alias("n_runs"))
