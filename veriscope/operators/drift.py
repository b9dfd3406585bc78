"""Monitoring of scores: histograms, stability index, concept metrics, alerts, count windows and late labels."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veriscope.functions import lexicons as lx
from veriscope.functions import text as tx
from veriscope.operators.metrics import evaluate
from veriscope.operators.prep import blocked

EPSILON, WARNING, CRITICAL = 1e-6, 0.10, 0.20
WINDOW, LEAST_EVENTS, LEAST_LABELS = 200, 10, 20
F2_DROP, RECALL_DROP = 0.05, 0.03


def once(events: DataFrame, key: str = "event_id", order: Sequence[str] = ("received_at",)) -> DataFrame:
    """One row per event: the last received one, so repeated deliveries count once and late labels win."""
    w = Window.partitionBy(key).orderBy(F.expr("true_label is not null").desc() if "true_label" in events.columns else F.lit(1), *(F.desc(o) for o in order))
    return events.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def bin_of(value: Column, bins: int = 10, lo: float = 0.0, hi: float = 1.0) -> Column:
    """0-based bin of a value, null for null; values outside fall into the outer bins."""
    return F.when(value.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((value - lo) / ((hi - lo) / bins)).cast("int"))))


def _counts(value: Column, bins: int) -> list[Column]:
    b = bin_of(value, bins)
    return [F.count_if(b == i).alias(f"_b{i}") for i in range(bins)]


def histogram(df: DataFrame, group: Sequence[str], value: str, bins: int = 10) -> DataFrame:
    """(group..., n, shares): shares of the bins, uniform for a group without values; nulls are left out."""
    by = df.groupBy(*group).agg(F.count(value).alias("n"), *_counts(F.col(value), bins))
    return by.select(*group, "n", F.array(*(F.when(F.col("n") > 0, F.col(f"_b{i}") / F.nullif(F.col("n"), F.lit(0))).otherwise(1.0 / bins) for i in range(bins))).alias("shares"))


def psi(shares: Column, baseline: Sequence[float]) -> Column:
    """Population stability index of an array of shares against constant ones of the same length."""
    out = F.lit(0.0)
    for i, b in enumerate(baseline):
        c, b = F.greatest(shares[i], F.lit(EPSILON)), max(b, EPSILON)
        out = out + (c - F.lit(b)) * F.log(c / F.lit(b))
    return F.when(F.size(shares) == len(baseline), out).otherwise(F.raise_error(F.lit("the numbers of bins differ")))


def drift_level(index: Column) -> Column:
    return F.when(index < WARNING, "none").when(index < CRITICAL, "warning").otherwise("critical")


def drift_report(events: DataFrame, group: Sequence[str], baseline: Sequence[float] = lx.BASELINE_BINS, metrics: Mapping[str, float] = lx.BASELINE_METRICS) -> DataFrame:
    """One row per group: size, means, stability index and level, concept metrics and alerts.

    Groups under ``LEAST_EVENTS`` scored events have a null index and level ``none``; concept metrics need
    ``LEAST_LABELS`` labelled events, and are measured at each event's own threshold.
    """
    by = histogram(events, group, "fraud_prob", len(baseline)).withColumnRenamed("n", "scored")
    means = events.groupBy(*group).agg(F.count("*").alias("events"), F.avg("fraud_prob").alias("mean_prob"), F.avg("text_length").alias("mean_length"), F.avg("red_flag_count").alias("mean_flags"), F.avg((F.col("label") > 0).cast("double")).alias("fraud_rate"), F.count("true_label").alias("labelled"))
    concept = evaluate(events.where("true_label is not null"), group, "true_label", "fraud_prob", "threshold_used").select(*group, F.col("precision").alias("precision"), "recall", "f1", "f2")
    out = means.join(by, list(group), "left").join(concept, list(group), "left")
    enough = F.col("scored") >= LEAST_EVENTS
    out = out.withColumn("psi", F.when(enough, psi(F.col("shares"), baseline))).withColumn("level", F.when(enough, drift_level(F.col("psi"))).otherwise("none"))
    judged = F.col("labelled") >= LEAST_LABELS
    f2_drop, recall_drop = F.when(judged, F.lit(metrics["f2"]) - F.col("f2")), F.when(judged, F.lit(metrics["recall"]) - F.col("recall"))
    alerts = F.filter(F.array(F.when(F.col("level") != "none", F.concat(F.lit("data_drift_"), F.col("level"))), F.when(f2_drop > F2_DROP, F.lit("concept_drift_f2")), F.when(recall_drop > RECALL_DROP, F.lit("concept_drift_recall"))), lambda x: x.isNotNull())
    advice = F.when(F.exists("alerts", lambda a: a.startswith("concept")), "retrain").when(F.col("level") == "critical", "investigate").when(F.col("level") == "warning", "watch").otherwise("none")
    out = out.withColumns({"f2_drop": f2_drop, "recall_drop": recall_drop, "alerts": alerts})
    return out.select(*group, "events", "scored", "mean_prob", "mean_length", "mean_flags", "fraud_rate", "psi", "level", "labelled", *(F.when(judged, F.col(c)).alias(c) for c in ("precision", "recall", "f1", "f2")), "f2_drop", "recall_drop", "alerts", advice.alias("advice"))


def alerts_of(report: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group..., alert, level): the alerts of a report, a row each."""
    return report.select(*group, F.explode("alerts").alias("alert"), "level")


def rolling(events: DataFrame, partition: Sequence[str], order: Sequence[str], value: str = "fraud_prob", size: int = WINDOW, block: int = 100_000) -> DataFrame:
    """Adds count, mean and greatest value of the last ``size`` rows of each partition in ``order`` (a unique one).

    Computed in overlapping blocks, so one busy partition isn't one task.
    """
    w = Window.partitionBy(*partition, "_block").orderBy("_position").rowsBetween(1 - size, 0)
    rows = blocked(events, partition, order, size - 1, block)
    return rows.withColumns({"window_n": F.count(value).over(w), "window_mean": F.avg(value).over(w), "window_max": F.max(value).over(w)}).where("_own").drop("_position", "_block", "_own")


def last_window(events: DataFrame, partition: Sequence[str], order: Sequence[str], size: int = WINDOW) -> DataFrame:
    """The last ``size`` events of each partition: what the monitor holds after a restart."""
    w = Window.partitionBy(*partition).orderBy(*(F.desc(o) for o in order))
    return events.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= size).drop("_n")


def with_ground_truth(events: DataFrame, truth: DataFrame, key: str = "event_id") -> DataFrame:
    """Events with late labels by id: the newest label wins, an event without one keeps its own; no event is lost."""
    newest = truth.where("true_label is not null").groupBy(key).agg(F.max(F.struct("labelled_at", "true_label"))["true_label"].alias("_late"))
    return events.join(newest, key, "left").withColumn("true_label", F.coalesce("_late", "true_label")).drop("_late")


def event_windows(events: DataFrame, ts: str, key: str, value: str, size: str = "1 day", slide: str | None = None) -> DataFrame:
    """(key, start, n, total) of tumbling or sliding windows over event time."""
    return events.groupBy(F.window(ts, size, slide) if slide else F.window(ts, size), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(key, F.col("window.start").alias("start"), "n", "total")


def sessions(events: DataFrame, ts: str, key: str, gap: str = "30 minutes") -> DataFrame:
    """(key, start, end, n): sessions that a gap ends."""
    return events.groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def new_baseline(events: DataFrame, bins: int = 10) -> list[float]:
    """Shares of the bins over all scored events, to store as the next baseline; one row reaches the driver."""
    shares = list(histogram(events, [], "fraud_prob", bins).first().shares)
    if abs(sum(shares) - 1) > 1e-6:
        raise ValueError("a baseline needs shares that sum to 1")
    return shares


def save_baseline(spark: SparkSession, path: str, shares: Sequence[float], metrics: Mapping[str, float]) -> None:
    """Writes what later reports compare with: shares of ten bins and the metrics of the last evaluation."""
    spark.createDataFrame([(json.dumps({"metrics": dict(metrics), "prob_dist": list(shares)}),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_baseline(spark: SparkSession, path: str) -> tuple[list[float], dict[str, float]]:
    """(shares, metrics) as saved; shares that aren't ten, or a store that isn't there, give the default ones."""
    try:
        stored = json.loads(spark.read.text(path).first().value)
    except (AnalysisException, ValueError, AttributeError):
        stored = {}
    shares = stored.get("prob_dist") or []
    return (list(shares) if len(shares) == len(lx.BASELINE_BINS) else list(lx.BASELINE_BINS)), {**lx.BASELINE_METRICS, **stored.get("metrics", {})}


def simulated(spark: SparkSession, n: int, shift_at: int | None = None, seed: int = 42, model: str = "baseline") -> DataFrame:
    """Events whose scores follow Beta(1, 3) and, from event ``shift_at`` on, Beta(2, 2): the least and the middle of three
    uniform numbers, made from hashes of the event's number, so the same for every run and partitioning."""
    u = F.array_sort(F.array(*(F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(1 << 52)) / F.lit(float(1 << 52)) for k in range(3))))
    at = spark.range(n)
    p = F.element_at(u, F.when(F.col("id") >= (n if shift_at is None else shift_at), 2).otherwise(1))
    ts = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id"))
    return at.select(F.col("id").alias("event_id"), F.lit(model).alias("model"), ts.alias("ts"), ts.alias("received_at"), F.lit(100).alias("text_length"), p.alias("fraud_prob"), (p >= 0.5).cast("int").alias("label"), F.lit(0.5).alias("threshold_used"), F.lit(0).alias("red_flag_count"), F.array().cast("array<string>").alias("red_flags"), F.lit(None).cast("int").alias("true_label"))


def term_drift(df: DataFrame, partition: str, order: Sequence[str], text_col: str = "text", block: int = 20_000, keep_text: bool = False) -> DataFrame:
    """Adds ``drift_score``: 1 minus the Jaccard similarity of a text's terms and those of the one before in its partition;
    0 for the first. The text itself is left out unless ``keep_text``: its terms travel as hashes. Computed in overlapping blocks, so one busy
    partition isn't one task.
    """
    kept = [c for c in df.columns if keep_text or c != text_col]
    hashed = F.array_distinct(F.transform(tx.terms(F.coalesce(F.col(text_col), F.lit(""))), lambda x: F.xxhash64(x)))
    rows = blocked(df.select(*kept, hashed.alias("_terms")), [partition], order, 1, block)
    rows = rows.withColumn("_prev", F.lag("_terms").over(Window.partitionBy(partition, "_block").orderBy("_position"))).where("_own")
    both = F.size(F.array_intersect("_terms", "_prev"))
    union = F.size("_terms") + F.size("_prev") - both
    return rows.select(*kept, F.when(F.col("_prev").isNull(), 0.0).otherwise(F.lit(1.0) - both / F.greatest(union, F.lit(1))).alias("drift_score"))
