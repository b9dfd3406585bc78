"""Functions behind an API: analyse, compare, health and drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriscope.operators import drift, model


def health(spark: SparkSession, registry: model.Registry) -> dict:
    """Whether the session answers and which models have a scorer."""
    return {"status": "ok" if spark.range(1).count() == 1 else "error", "spark": spark.version, "models": {n: n in registry._made for n in registry.names}}


def analyze(df: DataFrame, registry: model.Registry, name: str = "baseline", threshold: float = 0.5) -> DataFrame:
    """Full predictions of the rows' texts by one model; blank texts have an ``error`` and no prediction."""
    blank = F.coalesce(F.trim("text"), F.lit("")) == ""
    made = model.predictions(registry.get(name)(df.where(~blank)), threshold, name).withColumn("error", F.lit(None).cast("string"))
    return made.unionByName(df.where(blank).withColumn("error", F.lit("LOI_DOC_FILE: empty text")), allowMissingColumns=True)


def compare(df: DataFrame, registry: model.Registry, key: str) -> DataFrame:
    """Every registered model's score of every row, in long form; comparisons aren't recorded for drift."""
    return registry.compare(df, key)


def prediction_events(predicted: DataFrame, key: str, model_name: str) -> DataFrame:
    """Log rows of predictions: what ``drift`` reads. Ids are the row's key, so late labels find them."""
    return predicted.select(F.col(key).alias("event_id"), F.lit(model_name).alias("model"), F.current_timestamp().alias("ts"), F.current_timestamp().alias("received_at"), F.length("text").alias("text_length"), F.col("fraud_probability").alias("fraud_prob"), F.col("label_int").alias("label"), "threshold_used", F.size("red_flags").alias("red_flag_count"), "red_flags", F.lit(None).cast("int").alias("true_label"))


def drift_alerts(events: DataFrame) -> DataFrame:
    """(model, alert, level): what the report over each model's last events warns of."""
    return drift.alerts_of(drift_status(events), ["model"])


def ground_truth(events: DataFrame, truth: DataFrame) -> DataFrame:
    """The log with labels that came later, by event id; no event and no earlier report is lost."""
    return drift.with_ground_truth(drift.once(events), truth)


def update_baseline(spark: SparkSession, events: DataFrame, metrics: dict[str, float], path: str) -> None:
    """Stores the scored events' shares and an evaluation's metrics as what later reports compare with."""
    drift.save_baseline(spark, path, drift.new_baseline(events), metrics)


def drift_status(events: DataFrame) -> DataFrame:
    """The report over each model's last events."""
    return drift.drift_report(drift.last_window(drift.once(events), ["model"], ["ts", "event_id"]), ["model"])
