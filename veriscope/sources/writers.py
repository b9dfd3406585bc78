"""Writing splits, records, predictions and small reports."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_splits(df: DataFrame, path: str, fmt: str = "json", split: str = "split") -> None:
    """One folder per split, so that a reader of one prunes the others; each task writes what it holds."""
    df.write.mode("overwrite").partitionBy(split).format(fmt).save(path)


def split_cache(model: str, dataset: str) -> str:
    """The name under which a model's split of a dataset is kept: it changes with the dataset's path."""
    return f"{model}_split_{Path(dataset).stem or 'dataset'}_{hashlib.md5(dataset.encode()).hexdigest()[:8]}"


def cached_splits(spark: SparkSession, folder: str, model: str, dataset: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The rows of a split with their ``split``: as written by an earlier run for the same model and dataset, or made and
    written now."""
    path = f"{folder.rstrip('/')}/{split_cache(model, dataset)}"
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        write_splits(make(), path, "parquet")
    return spark.read.parquet(path)


def read_split(spark: SparkSession, path: str, name: str, fmt: str = "json", split: str = "split") -> DataFrame:
    return spark.read.format(fmt).load(path).where(F.col(split) == name)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def append_results(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    df.write.mode("append").format(fmt).save(path)


def write_report(df: DataFrame, path: str, most: int = 10_000) -> list[dict]:
    """A small result as one JSON document, with a table in Markdown beside it; more than ``most`` rows raise."""
    rows = [r.asDict(recursive=True) for r in df.limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"a report has at most {most} rows")
    Path(path).write_text(json.dumps(rows, ensure_ascii=False, indent=2, default=str), encoding="utf-8")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)] + ["| " + " | ".join(str(r[c]) for c in df.columns) + " |" for r in rows]
    Path(path).with_suffix(".md").write_text("\n".join(lines) + "\n", encoding="utf-8")
    return rows


def scan_summary(df: DataFrame) -> DataFrame:
    """One row: documents, failures and risk bands of a scored folder (columns ``error`` and ``muc_do_rui_ro``)."""
    band = F.col("muc_do_rui_ro")
    return df.agg(F.count("*").alias("documents"), F.count("error").alias("failed"), *(F.count_if(F.col("error").isNull() & (band == b)).alias(n) for b, n in (("Cao", "high"), ("Trung bình", "medium"), ("Thấp", "low"))))
