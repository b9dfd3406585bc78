"""Queries of the engine's operators over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriscope.functions import features as ft
from veriscope.functions import lexicons as lx
from veriscope.functions import parse
from veriscope.functions import rules as rl
from veriscope.functions import text as tx
from veriscope.operators import drift, explain, governance, metrics, model, prep, retrieval
from veriscope.session import staged, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


#: Bytes up to which a table is spread over the cores.
SMALL_TABLE = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """A table that the planner knows to be small, and that is one file, in as many partitions as cores. Larger tables come in
    the partitions that the reader cuts, and aren't shuffled; no files are listed here."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= SMALL_TABLE else df


def docs(s: SparkSession, d: str) -> DataFrame:
    return spread(table(s, d, "documents").select("doc_id", "lang", "source", "company_id", "report_year", F.coalesce("text", F.lit("")).alias("text")))


def folded(df: DataFrame, *keep: str) -> DataFrame:
    """The rows with ``_fold``, a column of its own, so that every phrase test reads it instead of folding again."""
    return df.select(*keep, tx.fold(T()).alias("_fold"))


def rounded(df: DataFrame, *keys: str, places: int = 6) -> DataFrame:
    """Fractions to so many places, so that sums in another order compare equal."""
    return df.select(*(F.round(c, places).alias(c) if t == "double" and c not in keys else F.col(c) for c, t in df.dtypes))


def T() -> Column:  # noqa: N802
    return F.col("text")


@query
def risk_bands(s, d):
    f = folded(docs(s, d), "lang").select(F.lower(F.coalesce("lang", F.lit("unknown"))).alias("lang"), rl.red_flags(F.col("_fold")).alias("f"))
    x = f.select("lang", rl.risk_band(rl.boosted(F.lit(0.4), F.col("f"))).alias("band"), F.size("f").alias("n"))
    return x.groupBy("lang", "band").agg(F.count("*").alias("documents"), F.sum("n").alias("flags"))


@query
def text_tokens(s, d):
    return docs(s, d).select("doc_id", F.size(tx.word_tokens(T())).alias("tokens"), F.size(tx.kept_tokens(tx.word_tokens(T()))).alias("kept"), F.size(tx.ws_tokens(T())).alias("ws"))


@query
def text_fold(s, d):
    return docs(s, d).select("doc_id", F.md5(tx.fold(T())).alias("folded"), F.md5(tx.collapse(T())).alias("collapsed"))


@query
def text_clean(s, d):
    return docs(s, d).select("doc_id", F.md5(tx.clean(T())).alias("cleaned"))


@query
def text_terms(s, d):
    return docs(s, d).select("doc_id", F.md5(F.array_join(tx.terms(T()), " ")).alias("terms"))


@query
def text_quality(s, d):
    return docs(s, d).withColumn("k", tx.terms(T())).select("doc_id", F.round(tx.quality(T(), F.col("k")), 6).alias("quality"))


@query
def text_english(s, d):
    return docs(s, d).select("doc_id", tx.is_english(T()).alias("english"))


@query
def text_segments(s, d):
    x = docs(s, d).select("doc_id", tx.segments(T()).alias("s"))
    return x.select("doc_id", F.size("s").alias("segments"), F.md5(F.array_join("s", "|")).alias("content"))


@query
def text_windows(s, d):
    x = docs(s, d).select("doc_id", tx.windows(T()).alias("w")).where(F.size("w") > 0)
    return x.select("doc_id", F.size("w").cast("long").alias("windows"), F.aggregate("w", F.lit(0), lambda a, c: a + F.length(c)).cast("long").alias("chars"), F.md5(F.array_join("w", "|")).alias("content"))


@query
def text_numbers(s, d):
    x = docs(s, d).select("doc_id", tx.numbers(T()).alias("n"))
    return x.select("doc_id", F.size("n").alias("numbers"), F.coalesce(F.array_max("n"), F.lit(0.0)).alias("largest"))


@query
def text_denoised(s, d):
    return docs(s, d).select("doc_id", tx.denoise(T()).alias("text"), tx.mask_leaks(T()).alias("masked"))


@query
def rule_flags(s, d):
    return folded(docs(s, d), "doc_id").select("doc_id", F.array_join(rl.red_flags(F.col("_fold")), ",").alias("flags"))


@query
def rule_flag_counts(s, d):
    return folded(docs(s, d)).select(F.explode(rl.red_flags(F.col("_fold"))).alias("flag")).groupBy("flag").agg(F.count("*").alias("documents"))


@query
def suspicious_segments(s, d):
    return docs(s, d).select("doc_id", F.posexplode(rl.suspicious_segments(T())).alias("position", "x")).select("doc_id", "position", "x.snippet", "x.flags")


@query
def declared_rules(s, d):
    return rl.declared_hits(spread(table(s, d, "mini_samples").select("sample_id", "text")), id_col="sample_id")


@query
def standard_matches(s, d):
    return rl.standard_matches(spread(table(s, d, "mini_samples").select("sample_id", "text")), id_col="sample_id")


@query
def fraud_signals(s, d):
    x = docs(s, d).select("doc_id", T(), rl.fraud_signals(T()).alias("f"))
    return x.select("doc_id", F.array_join("f", ",").alias("signals"), rl.auto_label(T(), F.col("f")).alias("label"))


@query
def pii_emails(s, d):
    return docs(s, d).select("doc_id", rl.personal_data(T())["email"].alias("emails"))


@query
def pii_scan(s, d):
    return docs(s, d).select("doc_id", *(c.alias(k) for k, c in rl.personal_data(T()).items()))


@query
def pii_ids(s, d):
    return docs(s, d).select("doc_id", rl.personal_data(T())["long_id"].alias("long_ids"))


@query
def parsed_documents(s, d):
    x = parse.parse_documents(docs(s, d).select("doc_id", "text")).withColumn("ocr_quality", F.round("ocr_quality", 6))
    return x.select("doc_id", F.size("pages").alias("pages"), F.array_join(F.sort_array(F.map_keys("sections")), ",").alias("sections"), *(f"{k}_raw" for k in parse.FIELDS[1:]), tx.fold(F.col("ten_cong_ty_raw")).alias("ten_cong_ty"), "doanh_thu_num", "loi_nhuan_sau_thue_num", "ocr_quality", F.array_join("fraud_signals", ",").alias("fraud_signals"), F.array_join("distress_signals", ",").alias("distress_signals"), "auto_label", "suggested_review", "char_count")


@query
def metadata_features(s, d):
    return rounded(ft.with_metadata_features(docs(s, d).select("doc_id", "text")).drop("text"))


@query
def feature_vectors(s, d):
    x = metadata_features(s, d).select("doc_id", F.posexplode(ft.vector()).alias("position", "value"))
    return x.where("value <> 0")


@query
def bias_flags(s, d):
    x = metadata_features(s, d)
    f = rl.bias_flags(F.col("ocr_quality"), F.col("digit_ratio"), F.col("log_char_len"), F.col("red_flag_count"), F.col("english_keyword_ratio"))
    return x.select("doc_id", F.array_join(f, ",").alias("flags"))


@query
def score_breakdown(s, d):
    x = events(s, d).where("fraud_prob is not null").withColumn("h", F.when(F.col("event_id") % 3 > 0, F.sqrt("fraud_prob")))
    b = rl.score_breakdown(F.col("fraud_prob"), F.col("h"), F.coalesce("red_flags", F.array().cast("array<string>")), F.coalesce("threshold_used", F.lit(0.5)))
    return rounded(x.select("event_id", b.alias("b")).select("event_id", "b.hybrid_metadata_score", "b.final_score", "b.rule_increment", "b.predicted_label", "b.decision_layer"))


@query
def accounting_numbers(s, d):
    found = F.regexp_extract_all(T(), F.lit(r"(\(?-?[0-9][0-9.,]*[0-9]\)?)"), F.lit(1))
    x = docs(s, d).select("doc_id", F.explode(found).alias("raw")).distinct()
    return x.select("doc_id", "raw", tx.accounting_number(F.col("raw")).alias("value")).where("value is not null")


@query
def lexical_tokens(s, d):
    return retrieval.lexical_tokens(docs(s, d), "doc_id").select("doc_id", F.md5(F.array_join("tokens", " ")).alias("tokens"))


@query
def rule_table(s, d):
    return rl.rule_table(s)


@query
def split_strategy(s, d):
    x = prep.time_mark(table(s, d, "mini_samples"), "2026-01-01")
    return s.createDataFrame([(prep.choose_strategy(x),)], "strategy string")


@query
def folder_summary(s, d):
    from veriscope.sources.writers import scan_summary

    f = folded(docs(s, d), "doc_id").select(rl.risk_band(rl.boosted(F.lit(0.42), rl.red_flags(F.col("_fold")))).alias("muc_do_rui_ro"), F.when(F.col("_fold") == "", "empty").alias("error"))
    return scan_summary(f)


@query
def drift_alerts(s, d):
    x = drift.drift_report(drift.last_window(events(s, d), ["model"], ["ts", "event_id"]), ["model"])
    return drift.alerts_of(x, ["model"])


@query
def best_chunks(s, d):
    c = docs(s, d).select("doc_id", F.posexplode(tx.windows(T())).alias("i", "c"))
    x = c.select("doc_id", "i", "c", tx.count_of(F.col("c"), ",").alias("v"))
    return model.best_chunk(x, "doc_id", "v", "i", "c").select("doc_id", F.md5("c").alias("chunk"))


@query
def embedding_triples(s, d):
    x, p = m1_positives(s, d)
    return retrieval.embedding_triples(x, p, retrieval.hard_negatives(p, standards(s), "id").where("position = 0"), standards(s), "id")


@query
def feature_schema(s, d):
    return ft.schema(s)


@query
def explanation_terms(s, d):
    x = docs(s, d).select("doc_id", F.explode(F.array_distinct(tx.ws_tokens(F.lower(T())))).alias("term"))
    return x.where(explain.explainable(F.col("term"))).groupBy("doc_id").agg(F.count("*").alias("terms"), F.min("term").alias("first"), F.max("term").alias("last"))


@query
def linguistic_features(s, d):
    x = ft.with_linguistic_features(docs(s, d).select("doc_id", "text"))
    return rounded(x.drop("text"))


@query
def benford(s, d):
    return rounded(ft.benford(table(s, d, "lineitem"), "l_returnflag", "l_extendedprice"))


@query
def term_drift(s, d):
    return rounded(drift.term_drift(docs(s, d).where("company_id is not null"), "company_id", ["report_year", "doc_id"]).select("doc_id", "drift_score"))


@query
def dedup_first(s, d):
    return prep.first_of_duplicates(table(s, d, "mini_samples").select("sample_id", "text")).select("sample_id")


@query
def time_marks(s, d):
    x = prep.time_mark(table(s, d, "mini_samples"), "2026-01-01")
    return x.select("sample_id", "mark.date", "mark.year", "mark.source", "mark.known")


@query
def temporal_split(s, d):
    return prep.temporal_split(table(s, d, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "split")


@query
def temporal_manifest(s, d):
    x = prep.time_mark(table(s, d, "mini_samples").select("sample_id", "text", "label", "doc_id", "collected_at", "published_at"), "2026-01-01")
    x = x.select("sample_id", "label", "mark", F.col("mark.date").alias("_date"))
    return prep.split_manifest(prep.temporal_split(x, ["_date", "sample_id"]))


@query
def stratified_split(s, d):
    x = table(s, d, "mini_samples").select("sample_id", "label")
    return prep.stratified_split(x, "label", F.md5(F.concat(F.col("sample_id").cast("string"), F.lit(":42"))), {"train": 0.8, "val": 0.1, "test": 0.1}).select("sample_id", "split")


@query
def expanding_folds(s, d):
    x = prep.expanding_folds(table(s, d, "events").select("event_id", "ts"), ["ts", "event_id"])
    return x.groupBy("fold", "role").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query
def tail_validation(s, d):
    return prep.tail_validation(table(s, d, "events").select("event_id", "ts"), ["ts", "event_id"]).select("event_id", "split")


@query
def split_statistics(s, d):
    x = prep.split_statistics(table(s, d, "m1_records"))
    return x.select("split", "records", "companies", F.array_join(F.transform(F.map_entries("label_distribution"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("labels"))


@query
def m1_canonical(s, d):
    x = spread(table(s, d, "m1_records")).select("id", F.coalesce("text", F.lit("")).alias("text"), rl.label_name(F.col("label")).alias("label"))
    x = x.withColumn("_fold", tx.fold(T())).withColumns({"_f": rl.red_flags(F.col("_fold")), "_t": F.array_join(tx.terms(T()), " ")})
    x = x.withColumn("_r", rl.standard_refs(F.col("_t"), F.col("label")))
    return x.select("id", "label", rl.label_number(F.col("label")).alias("label_int"), rl.risk_level(F.col("label"), F.col("_f")).alias("risk_level"), F.array_join("_r", ",").alias("standard_ref"), rl.finding(F.col("label"), F.col("_f"), F.col("_r")).alias("finding"))


@query
def governance_coverage(s, d):
    return rounded(governance.coverage(table(s, d, "mini_samples")))


@query
def governance_report(s, d):
    return governance.governance_report(table(s, d, "mini_samples")).select("total", "labels", "fraud", "duplicates", "pii_email")


@query
def governance_steps(s, d):
    return governance.governance_report(table(s, d, "mini_samples"))


@query
def cohen_kappa(s, d):
    return rounded(governance.cohen_kappa(table(s, d, "mini_samples"), "labeler_a", "labeler_b"))


def events(s, d) -> DataFrame:
    return drift.once(table(s, d, "prediction_events"))


def measured(s, d) -> DataFrame:
    return metrics.evaluate(events(s, d), ["model"], "true_label", "fraud_prob", 0.5)


@query
def eval_metrics(s, d):
    return rounded(measured(s, d).select("model", "support", "positives", "tp", "fp", "fn", "tn", "precision", "recall", "f1", "f0_5", "f2", "accuracy", "auc_roc", "auprc", "mcc"))


@query
def score_summary(s, d):
    return rounded(measured(s, d).select("model", "support", "score_mean", "score_std", "score_min", "score_max", "predicted_rate"))


@query
def best_threshold(s, d):
    return rounded(metrics.best_threshold(events(s, d), ["model"], "true_label", "fraud_prob"))


@query
def pr_curve(s, d):
    x = metrics.curve(events(s, d), ["model"], "true_label", "fraud_prob")
    return x.select("model", F.round("threshold", 9).alias("threshold"), F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query
def bias_slices(s, d):
    x = events(s, d).withColumn("red_flags", F.coalesce("red_flags", F.array().cast("array<string>")))
    return rounded(metrics.bias_report(x, "red_flags", "true_label", "fraud_prob").drop("f2"))


@query
def mcnemar_pairs(s, d):
    x = events(s, d).where("fraud_prob is not null and threshold_used is not null and sample_id is not null and model is not null").select("sample_id", "model", (F.col("true_label") > 0).cast("int").alias("y"), (F.col("fraud_prob") >= F.col("threshold_used")).cast("int").alias("p"))
    return rounded(metrics.with_p_value(metrics.mcnemar(x, "sample_id", "model", "y", "p")))


@query
def ablation(s, d):
    return rounded(metrics.ablation_deltas(rounded(measured(s, d)), "model"))


@query
def best_models(s, d):
    return metrics.best_models(rounded(measured(s, d)), "model", ("f2", "auc_roc", "recall"))


@query
def layer_evidence(s, d):
    x = events(s, d).withColumn("h", rl.boosted(F.col("fraud_prob"), F.coalesce("red_flags", F.array().cast("array<string>"))))
    return rounded(metrics.layer_evidence(x, "fraud_prob", "h", 0.5))


@query
def both_layers(s, d):
    x = events(s, d).withColumn("h", rl.boosted(F.col("fraud_prob"), F.coalesce("red_flags", F.array().cast("array<string>"))))
    return rounded(metrics.both_layers(x, "true_label", "fraud_prob", "h", 0.5))


@query
def changed_decisions(s, d):
    x = events(s, d).withColumn("h", rl.boosted(F.col("fraud_prob"), F.coalesce("red_flags", F.array().cast("array<string>"))))
    return rounded(metrics.changed_decisions(x, "event_id", "fraud_prob", "h", 0.5))


@query
def class_weights(s, d):
    return rounded(metrics.class_weights(table(s, d, "mini_samples")))


@query
def rolling_window(s, d):
    return rounded(drift.rolling(events(s, d), ["model"], ["ts", "event_id"]).select("event_id", "window_n", "window_mean", "window_max"))


@query
def drift_by_month(s, d):
    x = events(s, d).withColumn("month", F.date_trunc("month", "ts"))
    return rounded(drift.drift_report(x, ["model", "month"]).select("model", "month", "events", "scored", "mean_prob", "psi", "level"))


@query
def drift_reports(s, d):
    x = drift.drift_report(drift.last_window(events(s, d), ["model"], ["ts", "event_id"]), ["model"])
    return rounded(x.withColumn("alerts", F.array_join("alerts", ",")))


@query
def late_labels(s, d):
    every = table(s, d, "prediction_events")
    truth = every.where("true_label is not null").select("event_id", "true_label", F.col("received_at").alias("labelled_at"))
    unlabelled = events(s, d).withColumn("true_label", F.lit(None).cast("int"))  # as logged: every label comes later
    return drift.with_ground_truth(unlabelled, truth).groupBy("model").agg(F.count("*").alias("events"), F.count("true_label").alias("labelled"), F.sum("true_label").alias("positives"))


@query
def event_days(s, d):
    return rounded(drift.event_windows(table(s, d, "events"), "ts", "event_type", "value"), places=4)


@query
def event_sessions(s, d):
    return drift.sessions(table(s, d, "events").where("user_id is not null and ts is not null"), "ts", "user_id")


@query
def tfidf_terms(s, d):
    return rounded(model.top_terms(model.tfidf(docs(s, d), "doc_id", tx.word_tokens(T())), "doc_id"))


@query
def builder_tfidf(s, d):
    x = table(s, d, "m1_records").where("id is not null").select("id", "text", "split").dropDuplicates(["id"])
    return rounded(model.builder_tfidf(x.where("split = 'train'"), x.where("split = 'test'"), "id"))


@query
def bm25_top(s, d):
    q = table(s, d, "eval_items").where("item_id % 20 = 0").select("item_id", F.coalesce("text", F.lit("")).alias("query"))
    return rounded(retrieval.bm25(q, docs(s, d), "item_id", "doc_id", tx.word_tokens(F.col("query")), tx.word_tokens(T())), places=5)


@query
def cosine_top(s, d):
    v = table(s, d, "embeddings")
    return rounded(retrieval.cosine_top(v.where("vec_id % 20 = 0"), v, "vec_id", "embedding"))


def standards(s: SparkSession) -> DataFrame:
    return s.createDataFrame([(*r, i) for i, r in enumerate(lx.STANDARDS)], "chunk_id string, source string, article string, title string, text string, position int")


@query
def first_standards(s, d):
    x = table(s, d, "m1_records").where("id is not null").select("id", F.try_element_at("standard_ref", F.lit(1)).alias("ref")).distinct()
    return retrieval.first_standard(x, standards(s), "id", "ref")


def m1_positives(s, d) -> tuple[DataFrame, DataFrame]:
    """The records by id with their text, and each record's own standard: that of its first reference, given or inferred."""
    x = table(s, d, "m1_records").where("id is not null").dropDuplicates(["id"]).select("id", F.coalesce("text", F.lit("")).alias("text"), "label", "standard_ref")
    known = F.size(F.coalesce("standard_ref", F.array())) > 0
    # the terms and the references are columns of their own, so that each is made once
    y = x.withColumn("_t", F.when(known, F.lit("")).otherwise(F.array_join(tx.terms(T()), " "))).withColumn("_r", rl.standard_refs(F.col("_t"), rl.label_name(F.col("label"))))
    refs = y.select("id", F.try_element_at(F.when(known, F.col("standard_ref")).otherwise(F.col("_r")), F.lit(1)).alias("ref"))
    return x.select("id", "text"), retrieval.first_standard(refs, standards(s), "id", "ref")


@query
def hard_negatives(s, d):
    _, p = m1_positives(s, d)
    return retrieval.hard_negatives(p, standards(s), "id")


@query
def retrieval_sets(s, d):
    x, p = m1_positives(s, d)
    return retrieval.reranker_pairs(x, p, retrieval.hard_negatives(p, standards(s), "id"), standards(s), "id")


@query
def chat_rows(s, d):
    x = m1_canonical(s, d).join(table(s, d, "m1_records").select("id", "text").dropDuplicates(["id"]), "id")
    return retrieval.chat_rows(x, lx.SYSTEM_PROMPT)


@query
def knowledge_base(s, d):
    x = retrieval.knowledge_base(table(s, d, "kb_chunks"))
    return x.select("chunk_id", "source", "article", "title", F.md5("text").alias("text"), "chunk_index", "total_chunks")


def passages(s, d) -> DataFrame:
    """The passages of the knowledge base that come closest to each evaluation item of the stated set."""
    kb = retrieval.knowledge_base(table(s, d, "kb_chunks"))
    q = table(s, d, "eval_items").where("item_id % 20 = 0").select("item_id", F.coalesce("text", F.lit("")).alias("query"))
    return retrieval.bm25(q, kb, "item_id", "chunk_id", tx.word_tokens(F.col("query")), tx.word_tokens(T()))


@query
def kb_search(s, d):
    return rounded(passages(s, d), places=5)


@query
def prompt_rows(s, d):
    kb = retrieval.knowledge_base(table(s, d, "kb_chunks"))
    found = passages(s, d).join(kb.select("chunk_id", "title"), "chunk_id").select("item_id", "rank", F.col("title").alias("passage"))
    items = table(s, d, "eval_items").where("item_id % 20 = 0")
    x = retrieval.prompt_rows(items, lx.SYSTEM_PROMPT, lx.PROMPTS["retrieval"], found, "item_id")
    return x.select("item_id", F.md5("user").alias("user"), "gold_label", "char_count")


@query
def encoder_rows(s, d):
    x = retrieval.encoder_rows(table(s, d, "mini_samples"), "sample_id", "text", "label", "split")
    return x.select("sample_id", "part", F.md5("text").alias("text"), "label_int", "split")


@query
def rolled_up_scores(s, d):
    c = docs(s, d).select("doc_id", F.explode(tx.windows(T())).alias("c"))
    x = c.select("doc_id", F.length("c").alias("n"), F.least(F.lit(1.0), tx.count_of(F.col("c"), ",") / 20.0).alias("v"))
    return rounded(model.rolled_up(x, "doc_id", "v", "n"))


@query
def ingest_new(s, d):
    from veriscope.sources.readers import new_files

    return new_files(table(s, d, "documents").where("source is not null").select("source").distinct(), table(s, d, "mini_samples").where("source is not null"), "source")


def labelled(s, d) -> DataFrame:
    x = table(s, d, "mini_samples").where("label is not null and text is not null").select("sample_id", "text", "label")
    return prep.stratified_split(x, "label", F.md5(F.col("sample_id").cast("string")), {"train": 0.8, "val": 0.1, "test": 0.1})


def trained(s, d) -> tuple[model.TextModel, DataFrame]:
    x = staged(spread(labelled(s, d)), "labelled")  # both the model and its users read it
    return model.TextModel().fit(x.where("split = 'train'"), x.where("split = 'val'")), x


@query
def text_model_metrics(s, d):
    m, x = trained(s, d)
    return metrics.evaluate(m.score(x.where("split = 'test'")), (), "label", "raw_score", m.threshold)


@query
def predictions(s, d):
    m, x = trained(s, d)
    out = model.full_predictions(m, x.where("split = 'test'").select("sample_id", "text"), "sample_id")
    return out.select("sample_id", "label_int", "muc_do_rui_ro", "fraud_probability", "threshold_used", F.array_join("red_flags", ",").alias("red_flags"), F.array_join("top_terms", ",").alias("top_terms"), "explanation_method", F.array_join("explanation", " | ").alias("explanation"))


@query
def descent_model_metrics(s, d):
    x = spread(labelled(s, d))
    m = model.DescentModel().fit(x.where("split = 'train'"))
    return metrics.evaluate(m.score(x.where("split = 'test'").select("sample_id", "text", "label"), "sample_id"), (), "label", "raw_score", 0.5)


@query
def metadata_model_metrics(s, d):
    x = spread(labelled(s, d))
    return metrics.evaluate(model.metadata_only(x.where("split = 'train'"), x.where("split = 'test'")), (), "label", "raw_score", 0.5)


@query
def drift_simulated(s, d):
    x = drift.simulated(s, 4000, 2000).withColumn("half", F.floor(F.col("event_id") / 2000))
    return rounded(drift.drift_report(x, ["half"]).select("half", "events", "mean_prob", "psi", "level"))


def _scorer(df: DataFrame) -> DataFrame:
    """A transparent score that SQL can follow: the digits of a text, up to twenty."""
    return df.withColumn("raw_score", F.least(F.lit(1.0), F.length(F.regexp_replace("text", "[^0-9]", "")) / F.lit(20.0)))


@query
def leave_one_out(s, d):
    return rounded(explain.leave_one_out(docs(s, d), "doc_id", _scorer))


@query
def model_explanations(s, d):
    """What the fitted text model's score rests on, by leaving out each of the first tokens of the test texts."""
    m, x = trained(s, d)
    return rounded(explain.leave_one_out(x.where("split = 'test'").select("sample_id", "text"), "sample_id", m.score))


@query
def local_surrogates(s, d):
    return explain.local_surrogate(docs(s, d), "doc_id", _scorer)
