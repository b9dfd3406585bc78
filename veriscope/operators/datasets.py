"""Canonical records of the two corpora and the training sets built from them."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriscope.functions import features as ft
from veriscope.functions import lexicons as lx
from veriscope.functions import rules as rl
from veriscope.functions import text as tx
from veriscope.operators import prep, retrieval
from veriscope.operators.drift import term_drift
from veriscope.sources import writers


def _opt(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def _numbered(df: DataFrame, order: str) -> DataFrame:
    """Adds a 1-based number in ``order`` without one task sorting everything."""
    return prep.with_position(df, [order], "_n").withColumn("_n", F.col("_n") + 1)


def canonical_m1(df: DataFrame, order: str, version: str = "v1.0") -> DataFrame:
    """Audit findings with every field filled: id, text, label, label_int, risk_level, standard_ref, finding, source,
    company_id, dataset_version. Given values win over inferred ones; a null text counts as empty; ids that are missing
    are numbered in ``order``.
    """
    rows = _numbered(df, order)
    raw = F.coalesce(_opt(df, "label"), _opt(df, "risk_label"), F.lit("0"))
    x = rows.select(
        F.coalesce(_opt(df, "id"), F.format_string("AV-%04d", "_n")).alias("id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), rl.label_name(raw).alias("label"),
        F.coalesce(_opt(df, "company_id"), _opt(df, "ticker"), F.format_string("CTY_ANON_%04d", "_n")).alias("company_id"), F.coalesce(_opt(df, "source"), F.lit("unknown")).alias("source"),
        _opt(df, "risk_level").alias("_risk"), _opt(df, "finding").alias("_finding"), (F.col("standard_ref") if "standard_ref" in df.columns else F.lit(None)).cast("array<string>").alias("_refs"),
    )
    x = x.withColumn("_fold", tx.fold(F.col("text"))).withColumns({"_f": rl.red_flags(F.col("_fold")), "_t": F.array_join(tx.terms(F.col("text")), " ")})
    x = x.withColumn("standard_ref", F.coalesce(F.when(F.size("_refs") > 0, F.col("_refs")), rl.standard_refs(F.col("_t"), F.col("label"))))
    return x.select("id", "text", "label", rl.label_number(F.col("label")).alias("label_int"), F.coalesce("_risk", rl.risk_level(F.col("label"), F.col("_f"))).alias("risk_level"), "standard_ref", F.coalesce("_finding", rl.finding(F.col("label"), F.col("_f"), F.col("standard_ref"))).alias("finding"), "source", "company_id", F.lit(version).alias("dataset_version"))


def canonical_m3(df: DataFrame, order: str) -> DataFrame:
    """Statement records: id, company_id, year, doc_section, text, risk_label, risk_label_int, signals, drift_score.

    An explicit label of 0 stays 0. ``drift_score`` compares a company's text with the one before it in time.
    """
    rows = _numbered(df, order)
    number = F.coalesce(_opt(df, "risk_label_int", "int"), F.when(_opt(df, "label", "int") > 0, F.lit(lx.RISKS["HIGH_RISK"])), F.lit(0))
    name = F.lit(None).cast("string")
    for k, v in lx.RISKS.items():
        name = F.when(number == v, k).otherwise(name)
    x = rows.select(
        F.coalesce(_opt(df, "id"), F.format_string("FS-%04d", "_n")).alias("id"), F.coalesce(_opt(df, "company_id"), F.format_string("CTY_ANON_%04d", "_n")).alias("company_id"),
        F.coalesce(_opt(df, "year", "int"), _opt(df, "report_year", "int")).alias("year"), F.coalesce(_opt(df, "doc_section"), F.lit("full_text")).alias("doc_section"), F.coalesce(F.col("text"), F.lit("")).alias("text"),
        F.coalesce(_opt(df, "risk_label"), name).alias("risk_label"), number.alias("risk_label_int"),
    )
    made = []
    low = F.lower("text")
    for kind in ("vague_r", "hedge_r", "neg_r", "passive_r"):
        made += [F.when(low.contains(p), F.struct(F.lit(kind.removesuffix("_r")).alias("type"), F.lit(p).alias("span"), F.lit(1.0).alias("weight"))) for p in lx.SIGNALS[kind]]
    x = x.withColumn("signals", F.filter(F.array(*made), lambda s: s.isNotNull()))
    drift = term_drift(x, "company_id", ["year", "id"], keep_text=True)
    return drift.withColumn("drift_from_prev", F.col("drift_score") > 0)


def build(spark: SparkSession, records: DataFrame, order: str, path: str, shares: dict[str, float] | None = None) -> dict:
    """Writes the corpus with its splits and every training set below ``path``; returns the manifest.

    Splits are held within labels; the TF-IDF of the baseline is learnt on train only.
    """
    from veriscope.operators.model import builder_tfidf

    shares = shares or {"train": 0.7, "dev": 0.15, "test": 0.15}
    rows = prep.stratified_split(canonical_m1(records, order), "label", F.md5(F.concat("id", F.lit(":42"))), shares)
    writers.write_splits(rows, f"{path}/corpus", "parquet")
    corpus = spark.read.parquet(f"{path}/corpus")
    kb = spark.createDataFrame([(*r, i) for i, r in enumerate(lx.STANDARDS)], "chunk_id string, source string, article string, title string, text string, position int")
    writers.write_jsonl(kb, f"{path}/kb_chunks")
    positives = retrieval.first_standard(corpus.select("id", F.try_element_at("standard_ref", F.lit(1)).alias("ref")), kb, "id", "ref")
    negatives = retrieval.hard_negatives(positives, kb, "id")
    sets = {
        "embedding_triples": retrieval.embedding_triples(corpus, positives, negatives.where("position = 0"), kb, "id"),
        "reranker_pairs": retrieval.reranker_pairs(corpus, positives, negatives, kb, "id"),
        "chat": retrieval.chat_rows(corpus, lx.SYSTEM_PROMPT),
        "lexical_tokens": retrieval.lexical_tokens(corpus, "id"),
        "tfidf": builder_tfidf(corpus.where("split = 'train'"), corpus, "id"),
        "rules": rl.rule_table(spark),
        "encoder_inputs": retrieval.encoder_rows(corpus),
        "prompts": retrieval.prompt_rows(corpus.where("split = 'test'"), lx.SYSTEM_PROMPT, lx.PROMPTS["retrieval"], positives.join(F.broadcast(retrieval.few(kb)), "chunk_id").select("id", F.lit(1).alias("rank"), F.col("text").alias("passage"))),
        "prompts_direct": retrieval.prompt_rows(corpus.where("split = 'test'"), lx.SYSTEM_PROMPT, lx.PROMPTS["direct"]),
        "linguistic": ft.with_linguistic_features(corpus.select("id", "text", "split")).drop("text"),
    }
    for name, df in sets.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    stats = [r.asDict(recursive=True) for r in prep.split_statistics(corpus).collect()]  # one row per split
    manifest = {"splits": stats, "sets": sorted(sets), "retrieval": retrieval.RETRIEVAL_CONFIG, "policy": "models and statistics are learnt on train only"}
    spark.createDataFrame([(json.dumps(manifest, ensure_ascii=False),)], "manifest string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return manifest
