"""Audit of a labelled corpus: coverage, personal data, agreement of annotators, readiness for training."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriscope.functions.rules import personal_data

FIELDS = ("source", "doc_id", "version", "collected_at", "anonymized", "privacy_reviewed")
ANNOTATORS = (("labeler_a", "labeler_b"), ("label_manual", "label_ai"), ("label_manual", "label_reviewer"))


def filled(c: Column) -> Column:
    return F.trim(F.coalesce(c.cast("string"), F.lit(""))) != ""


def coverage(df: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """One row: share of rows in which each field isn't blank; a field the frame lacks has 0, as all have without rows."""
    return df.agg(*((F.coalesce(F.avg(filled(F.col(f)).cast("double")), F.lit(0.0)) if f in df.columns else F.lit(0.0)).alias(f) for f in fields))


def cohen_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row (n, agreement, chance, kappa) over rows that both annotators labelled; kappa 1 where chance is 1.

    The contingency table has one row per pair of labels; marginals come from it.
    """
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count("*").alias("c"))
    rows, cols = cells.groupBy("a").agg(F.sum("c").alias("ra")), cells.groupBy("b").agg(F.sum("c").alias("cb"))
    chance = rows.join(cols, F.col("a") == F.col("b")).agg(F.coalesce(F.sum(F.col("ra").cast("double") * F.col("cb")), F.lit(0.0)).alias("e"))
    whole = cells.agg(F.sum("c").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("c")).otherwise(0)).alias("same"))
    po, pe = F.col("same") / F.nullif(F.col("n"), F.lit(0)), F.col("e") / F.nullif(F.col("n").cast("double") * F.col("n"), F.lit(0.0))
    return whole.join(chance).select(F.coalesce("n", F.lit(0)).alias("n"), po.alias("agreement"), pe.alias("chance"), F.when(pe == 1, 1.0).otherwise((po - pe) / F.nullif(1 - pe, F.lit(0.0))).alias("kappa"))


def annotator_pair(df: DataFrame) -> tuple[str, str] | None:
    """The first pair of annotator columns that the frame has."""
    return next(((a, b) for a, b in ANNOTATORS if a in df.columns and b in df.columns), None)


def governance_report(df: DataFrame, text: str = "text", label: str = "label", max_duplicates: float = 0.1, min_minority: float = 0.1, min_coverage: float = 0.5) -> DataFrame:
    """One row with the four steps of the audit. A null text counts as empty.

    ``ready`` needs rows, a label on each, at most a tenth of duplicates, no personal data, and a minority of a tenth.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    pii = personal_data(t)
    y = F.col(label).cast("double")
    have = lambda f: F.avg(filled(F.col(f)).cast("double")) if f in df.columns else F.lit(0.0)
    per = df.agg(
        F.count("*").alias("total"), F.count(label).alias("labels"), F.coalesce(F.sum((y > 0).cast("int")), F.lit(0)).alias("fraud"),
        *(F.coalesce(F.sum(c), F.lit(0)).alias(f"pii_{k}") for k, c in pii.items()), *(F.coalesce(have(f), F.lit(0.0)).alias(f"coverage_{f}") for f in FIELDS),
    )
    # distinct texts are counted by 128 bits of hash, so whole texts aren't shuffled
    distinct = df.select(F.xxhash64(t).alias("h"), F.hash(t).alias("k")).distinct().agg(F.count("*").alias("distinct_texts"))
    both = per.join(distinct).withColumn("duplicates", F.col("total") - F.col("distinct_texts")).drop("distinct_texts")
    total = F.greatest(F.col("total"), F.lit(1))
    both = both.withColumns({"fraud_ratio": F.col("fraud") / total, "minority_ratio": F.least(F.col("fraud"), F.col("total") - F.col("fraud")) / total})
    clean = F.col("pii_email") + F.col("pii_phone") + F.col("pii_long_id") == 0
    return both.withColumns({
        "step_1": F.when((F.col("coverage_source") >= min_coverage) | (F.col("coverage_doc_id") >= min_coverage), "ok").otherwise("warning"),
        "step_2": F.when(clean, "ok").otherwise("warning"),
        "step_3": F.when(F.col("total") > 0, "ok").otherwise("warning"),
        "ready": (F.col("total") > 0) & (F.col("labels") == F.col("total")) & (F.col("duplicates") / total <= max_duplicates) & clean & (F.col("minority_ratio") >= min_minority),
    })
