"""Analyst labels: history, current label, summary and export."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import ratio
from .ordered import Ordered


def history(log: DataFrame, event_id: str = "event_id", order: str = "log_id", split_rows=None) -> DataFrame:
    """Every submission with its revision, the label before it and when the event was first labelled."""
    seq = Ordered(log, [event_id], [order], split_rows)
    seq.within(1, previous_label=lambda w: F.lag("label").over(w))
    seq.running(revision=("sum", F.lit(1).cast("long")), first_labeled_at=("min", F.col("created_at")))
    return seq.df


def current(log: DataFrame, event_id: str = "event_id", order: str = "log_id") -> DataFrame:
    """Label in force per event, from map-side aggregates of the log."""
    return log.groupBy(event_id).agg(
        F.max_by("label", order).alias("label"), F.min("created_at").alias("first_labeled_at"),
        F.max_by("created_at", order).alias("labeled_at"), F.max_by("analyst", order).alias("analyst"),
        F.max_by("note", order).alias("note"), F.count(F.lit(1)).alias("revision"))


def labeled_events(labels: DataFrame, events: DataFrame, event_id: str = "event_id") -> DataFrame:
    """Labels with their events; a label whose event is gone is left out."""
    return labels.withColumnRenamed("label", "feedback_label").join(events, event_id)


def summary(events: DataFrame, log: DataFrame, event_id: str = "event_id") -> DataFrame:
    """Counts and precision over labelled events, one row. Not a model accuracy: analysts choose."""
    labels = current(log, event_id).withColumnRenamed("label", "feedback_label")
    joined = events.join(labels, event_id, "left")
    confirmed, labelled = F.col("feedback_label") == "confirmed", F.col("feedback_label").isNotNull()
    attack, alerting = F.col("predicted_label") == "attack", F.col("alert_state") == "alerting"
    on_events = joined.agg(
        F.count(F.lit(1)).alias("total_events"),
        F.count_if(labelled & attack).alias("predicted_attack_labeled"),
        F.count_if(confirmed & attack).alias("predicted_attack_confirmed"),
        F.count_if(labelled & alerting).alias("hysteresis_alerting_labeled"),
        F.count_if(confirmed & alerting).alias("hysteresis_alerting_confirmed"))
    on_labels = labels.agg(
        F.count_if(F.col("feedback_label") == "confirmed").alias("confirmed"),
        F.count_if(F.col("feedback_label") == "dismissed").alias("dismissed"),
        F.count_if(F.col("revision") > 1).alias("relabeled_events"), F.sum("revision").alias("total_submissions"))
    people = labels.filter("analyst IS NOT NULL AND analyst <> ''").agg(
        F.count_distinct("analyst").alias("distinct_analysts"))
    c, one = F.col, F.lit(1)
    out = on_events.withColumn("_j", one).join(on_labels.withColumn("_j", one), "_j").join(
        people.withColumn("_j", one), "_j").drop("_j")
    return out.withColumns({
        "total_labeled": c("confirmed") + c("dismissed"),
        "unlabeled": c("total_events") - (c("confirmed") + c("dismissed")),
        "predicted_attack_precision": ratio(c("predicted_attack_confirmed"), c("predicted_attack_labeled")),
        "hysteresis_alert_precision": ratio(c("hysteresis_alerting_confirmed"), c("hysteresis_alerting_labeled"))})


def labeled_by_source(events: DataFrame, log: DataFrame, event_id: str = "event_id") -> DataFrame:
    return current(log, event_id).join(events.select(event_id, "source"), event_id).groupBy("source").agg(
        F.count(F.lit(1)).alias("n"))


def export(labeled: DataFrame, meta: list[str], features: list[str]) -> DataFrame:
    """Flat export: meta columns, then one `feature_` column per feature."""
    return labeled.select(*meta, *[F.col(f).alias(f"feature_{f}") for f in features])
