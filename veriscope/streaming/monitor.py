"""Score monitoring on streams: event-time windows, a window of the last events per model, late labels."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from veriscope.functions import lexicons as lx
from veriscope.operators import drift

STATE = "model string, events long, mean_prob double, psi double, level string"


def windowed_drift(events: DataFrame, delay: str = "2 days", size: str = "1 day", group: Sequence[str] = ("model",), baseline: Sequence[float] = lx.BASELINE_BINS) -> DataFrame:
    """Per event-time window and group: events, mean, stability index and level; repeated events of a window count once.

    Events later than ``delay`` behind the newest are left out by the watermark.
    """
    fresh = events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])
    by = fresh.groupBy(F.window("ts", size), *group).agg(F.count("*").alias("events"), F.count("fraud_prob").alias("n"), F.avg("fraud_prob").alias("mean_prob"), *drift._counts(F.col("fraud_prob"), len(baseline)))
    shares = F.array(*(F.when(F.col("n") > 0, F.col(f"_b{i}") / F.nullif(F.col("n"), F.lit(0))).otherwise(1.0 / len(baseline)) for i in range(len(baseline))))
    out = by.withColumn("psi", F.when(F.col("n") >= drift.LEAST_EVENTS, drift.psi(shares, baseline)))
    return out.select(F.col("window.start").alias("start"), *group, "events", "mean_prob", "psi", F.when(F.col("psi").isNull(), "none").otherwise(drift.drift_level(F.col("psi"))).alias("level"))


class LastEvents(StatefulProcessor):
    """Keeps the last ``size`` scores of each model and reports the window after each batch."""

    def __init__(self, size: int = drift.WINDOW, baseline: Sequence[float] = tuple(lx.BASELINE_BINS)):
        self.size, self.baseline = size, list(baseline)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.scores = handle.getListState("scores", "ts timestamp, prob double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        kept = [(t, p) for t, p in self.scores.get()] if self.scores.exists() else []
        for b in rows:
            kept += [(t.to_pydatetime(), float(p)) for t, p in zip(b["ts"], b["fraud_prob"], strict=True) if pd.notna(p)]
            kept = sorted(kept)[-self.size :]  # bounded however large the batch is
        if kept:
            self.scores.put(kept)
        yield self.report(key[0], [p for _, p in kept])

    def report(self, model: str, scores: list[float]) -> pd.DataFrame:
        import math

        bins = len(self.baseline)
        index = level = None
        if len(scores) >= drift.LEAST_EVENTS:
            counts = [0] * bins
            for p in scores:
                counts[max(0, min(bins - 1, int(p * bins)))] += 1
            pairs = [(max(c / len(scores), drift.EPSILON), max(b, drift.EPSILON)) for c, b in zip(counts, self.baseline, strict=True)]
            index = sum((c - b) * math.log(c / b) for c, b in pairs)
            level = "none" if index < drift.WARNING else "warning" if index < drift.CRITICAL else "critical"
        mean = sum(scores) / len(scores) if scores else None
        return pd.DataFrame({"model": [model], "events": [len(scores)], "mean_prob": [mean], "psi": [index], "level": [level or "none"]})

    def close(self) -> None:
        pass


def last_events(events: DataFrame, size: int = drift.WINDOW) -> DataFrame:
    """A row per model and batch for its last ``size`` events (state in RocksDB, so it survives the loss of an executor)."""
    rows = events.select("model", "ts", "fraud_prob")
    return rows.groupBy("model").transformWithStateInPandas(LastEvents(size), STATE, "Update", "None")


def with_late_labels(events: DataFrame, truth: DataFrame, delay: str = "30 days") -> DataFrame:
    """Stream-stream join of events and later labels; an event whose label never comes leaves with its own after the delay."""
    e = events.withWatermark("ts", delay).alias("e")
    t = truth.select(F.col("event_id").alias("_id"), F.col("true_label").alias("_late"), "labelled_at").withWatermark("labelled_at", delay).alias("t")
    late = e.join(t, F.expr(f"event_id = _id and labelled_at >= ts and labelled_at <= ts + interval {delay}"), "left_outer")
    return late.withColumn("true_label", F.coalesce("_late", "true_label")).drop("_id", "_late", "labelled_at")


def write_monitor(stream: DataFrame, report_path: str, alert_path: str, checkpoint: str):
    """Two sinks per batch: all reports, and those with a drift level; starts the query."""

    def sink(batch: DataFrame, number: int) -> None:
        batch = batch.withColumn("batch", F.lit(number)).persist()
        batch.write.mode("append").parquet(report_path)
        batch.where("level <> 'none'").write.mode("append").parquet(alert_path)
        batch.unpersist()

    return stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(sink)
