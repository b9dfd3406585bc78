"""Numeric features of documents as Columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriscope.functions import lexicons as lx
from veriscope.functions import rules as rl
from veriscope.functions import text as tx

#: Names of the twenty metadata features, in order of the feature vector.
METADATA = (
    "log_char_len log_token_count avg_token_len ocr_quality digit_ratio uppercase_ratio newline_density red_flag_count"
    " suspicious_segment_count english_keyword_ratio has_related_party has_invoice_risk has_cashflow_risk has_off_balance_risk"
    " financial_term_density_vn financial_term_density_en round_number_ratio accounting_code_count loss_keyword_count abnormal_profit_signal"
).split()
TOPICS = 8
LINGUISTIC = [*"vague_r hedge_r neg_r passive_r fog_idx avg_len len_var num_den".split(), *(f"topic_{i}" for i in range(TOPICS)), *"sent_pos sent_neg sent_neu time_r excl_r quest_r drift_sc".split()]


def _sum(cols: Sequence[Column]) -> Column:
    out = cols[0]
    for c in cols[1:]:
        out = out + c
    return out


def _share(tokens: Column, words: Sequence[str], marks: str, n: Column) -> Column:
    """Share of tokens that are one of the words once ``marks`` are stripped."""
    known = F.array(*map(F.lit, words))
    return F.size(F.filter(tokens, lambda x: F.array_contains(known, F.btrim(x, F.lit(marks))))) / n


def with_metadata_features(df: DataFrame, text_col: str = "text", rules: Sequence[rl.Rule] = rl.DEFAULT_RULES) -> DataFrame:
    """Adds the twenty features; a null text counts as empty. Shared steps are columns of their own, computed once."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    base = df.withColumn("_t", t).withColumn("_terms", tx.terms(F.col("_t"))).withColumn("_fold", tx.fold(F.col("_t"))).withColumn("_low", F.lower("_t"))
    base = base.withColumn("_flags", rl.red_flags(F.col("_fold"), rules)).withColumn("_ws", tx.ws_tokens(F.col("_low"))).withColumn("_numbers", F.regexp_extract_all("_t", F.lit(r"(?<![\p{L}\p{N}_])(\p{Nd}+)(?![\p{L}\p{N}_])"), F.lit(1)))
    x, low, fold, terms, ws, nums = (F.col(c) for c in ("_t", "_low", "_fold", "_terms", "_ws", "_numbers"))
    stripped, n_ws = F.length(tx.strip(x)), F.greatest(F.size(ws), F.lit(1))
    flag = lambda phrases: rl.has_any(fold, phrases).cast("double")
    made = {
        "log_char_len": F.log1p(stripped.cast("double")),
        "log_token_count": F.log1p(F.size(terms).cast("double")),
        "avg_token_len": F.aggregate(terms, F.lit(0), lambda a, w: a + F.length(w)) / F.greatest(F.size(terms), F.lit(1)),
        "ocr_quality": tx.quality(x, terms),
        "digit_ratio": tx.matching(x, r"\p{Nd}") / F.greatest(stripped, F.lit(1)),
        "uppercase_ratio": tx.matching(x, r"\p{Lu}") / F.greatest(tx.matching(x, r"\p{L}"), F.lit(1)),
        "newline_density": tx.count_of(x, "\n") / F.greatest(stripped, F.lit(1)),
        "red_flag_count": F.size("_flags").cast("double"),
        "suspicious_segment_count": F.size(rl.suspicious_segments(x, rules, F.col("_flags"))).cast("double"),
        "english_keyword_ratio": _share(ws, lx.ENGLISH_KEYWORDS, ".,:;!?", n_ws),
        "has_related_party": flag(lx.RELATED_PARTY),
        "has_invoice_risk": flag(lx.INVOICE_RISK),
        "has_cashflow_risk": flag(lx.CASHFLOW_RISK),
        "has_off_balance_risk": flag(lx.OFF_BALANCE_RISK),
        "financial_term_density_vn": _sum([low.contains(k).cast("int") for k in lx.FINANCIAL_TERMS_VN]) / n_ws,
        "financial_term_density_en": _share(ws, lx.FINANCIAL_WORDS_EN, ".,;", n_ws),
        "round_number_ratio": F.size(F.filter(nums, lambda v: v.endswith("000") & (F.length(v) >= 6))) / F.greatest(F.size(nums), F.lit(1)),
        "accounting_code_count": F.size(F.array_distinct(F.filter(nums, lambda v: v.rlike("^[1-7][0-9]{2}$")))).cast("double"),
        "loss_keyword_count": _sum([tx.count_of(low, k) for k in lx.LOSS_WORDS]).cast("double"),
        "abnormal_profit_signal": flag(lx.ABNORMAL_PROFIT),
    }
    return base.select(*df.columns, *(made[k].alias(k) for k in METADATA))


# The group of every metadata feature.
GROUPS = {
    "length": ["log_char_len", "log_token_count", "avg_token_len"], "quality": ["ocr_quality", "digit_ratio", "uppercase_ratio", "newline_density"],
    "rules": ["red_flag_count", "suspicious_segment_count"], "language": ["english_keyword_ratio"], "risk": ["has_related_party", "has_invoice_risk", "has_cashflow_risk", "has_off_balance_risk"],
    "finance": ["financial_term_density_vn", "financial_term_density_en", "round_number_ratio", "accounting_code_count", "loss_keyword_count", "abnormal_profit_signal"],
}


def schema(spark: SparkSession) -> DataFrame:
    """(position, name, group, dtype) of the metadata features in the order of the feature vector."""
    of = {n: g for g, names in GROUPS.items() for n in names}
    return spark.createDataFrame([(i, n, of[n], "double") for i, n in enumerate(METADATA)], "position int, name string, group string, dtype string")


def vector(names: Sequence[str] = METADATA) -> Column:
    """The features as an array in order; a missing one is 0."""
    return F.array(*(F.coalesce(F.col(n), F.lit(0.0)) for n in names))


def hybrid_score(features: Sequence[Column], mean: Sequence[float], scale: Sequence[float], coefficients: Sequence[float], intercept: float) -> Column:
    """Logistic score of standardised features, all coefficients constants of the plan; a scale of 0 counts as 1."""
    z = F.lit(float(intercept))
    for x, m, s, c in zip(features, mean, scale, coefficients, strict=True):
        if c:
            z = z + (x - F.lit(float(m))) / F.lit(float(s or 1.0)) * F.lit(float(c))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))


def phrase_ratio(low: Column, phrases: Sequence[str], words: Column) -> Column:
    """Occurrences of phrases per white-space token."""
    return _sum([tx.count_of(low, p) for p in phrases]) / F.greatest(words, F.lit(1))


def with_linguistic_features(df: DataFrame, text_col: str = "text", fold: bool = False, signals: Mapping[str, Sequence[str]] = lx.SIGNALS) -> DataFrame:
    """Adds the linguistic features; a null text counts as empty; ``fold`` matches the lexicons against unaccented text.

    Topics share flags over buckets by a stable hash. ``drift_sc`` is 0 unless the frame has a column ``drift_score``.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    base = df.withColumn("_t", t).withColumn("_low", tx.fold_accents(F.lower(t)) if fold else F.lower(t))
    base = base.withColumn("_segments", tx.segments(F.col("_t"))).withColumn("_words", tx.ws_tokens(F.col("_t"))).withColumn("_fold", tx.fold(F.col("_t"))).withColumn("_flags", rl.red_flags(F.col("_fold")))
    base = base.withColumn("_lens", F.filter(F.transform(F.when(F.size("_segments") > 0, F.col("_segments")).otherwise(F.array("_t")), lambda s: F.size(tx.ws_tokens(s))), lambda n: n > 0))
    x, low, words, lens, flags = (F.col(c) for c in ("_t", "_low", "_words", "_lens", "_flags"))
    n, k = F.greatest(F.size(words), F.lit(1)), F.greatest(F.size(lens), F.lit(1))
    base = base.withColumn("_avg", F.aggregate(lens, F.lit(0), lambda a, v: a + v) / k)
    avg = F.col("_avg")
    syllables = F.aggregate(words, F.lit(0), lambda a, w: a + F.greatest(F.lit(1), F.floor(F.length(w) / 3).cast("int")))
    made = {name: phrase_ratio(low, phrases, F.size(words)) for name, phrases in signals.items()}
    made |= {
        "fog_idx": F.lit(0.4) * (avg + F.lit(100.0) * syllables / n),
        "avg_len": avg,
        "len_var": F.aggregate(lens, F.lit(0.0), lambda a, v: a + (v - avg) * (v - avg)) / k,
        "num_den": F.size(tx.numbers(x)) / n,
        "time_r": F.regexp_count(x, F.lit(r"(?<![\p{L}\p{N}_])20[0-9]{2}(?![\p{L}\p{N}_])")) / n,
        "excl_r": tx.count_of(x, "!") / F.greatest(F.length(x), F.lit(1)),
        "quest_r": tx.count_of(x, "?") / F.greatest(F.length(x), F.lit(1)),
        "drift_sc": F.coalesce(F.col("drift_score").cast("double"), F.lit(0.0)) if "drift_score" in df.columns else F.lit(0.0),
    }
    made["sent_neu"] = F.greatest(F.lit(0.0), F.lit(1.0) - made["sent_pos"] - made["sent_neg"])
    for i in range(TOPICS):
        bucket = lambda f: F.conv(F.left(F.md5(f), F.lit(8)), 16, 10).cast("long") % TOPICS
        made[f"topic_{i}"] = F.size(F.filter(flags, lambda f, i=i: bucket(f) == i)) / F.greatest(F.size(flags), F.lit(1))
    return base.select(*df.columns, *(made[c].alias(c) for c in LINGUISTIC))


def benford(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, deviation): how far first digits of whole parts of at least 1 are from Benford's law, on proportions."""
    whole = F.floor(F.abs(F.col(value).cast("double"))).cast("long")
    digits = df.where(F.abs(F.col(value)) >= 1).select(F.col(key), F.left(whole.cast("string"), F.lit(1)).cast("int").alias("digit"))
    counts = digits.groupBy(key).agg(F.count("*").alias("n"), *(F.count_if(F.col("digit") == d).alias(f"_d{d}") for d in range(1, 10)))
    expected = {d: F.log10(F.lit(1.0) + F.lit(1.0) / d) for d in range(1, 10)}
    return counts.select(key, "n", _sum([F.pow(F.col(f"_d{d}") / F.col("n") - expected[d], 2) / expected[d] for d in range(1, 10)]).alias("deviation"))
