"""The rule engine: rules are data and compile to one Column over the folded text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriscope.functions import lexicons as lx
from veriscope.functions import text as tx


@dataclass(frozen=True)
class Rule:
    """Fires if every group of phrases has a member in the text."""

    id: str
    groups: tuple[tuple[str, ...], ...]
    #: Adds ``id`` after all others, only where no rule of the same id has fired.
    late: bool = False


def _rule(id_: str, *groups: Sequence[str], late: bool = False) -> Rule:
    return Rule(id_, tuple(map(tuple, groups)), late)


# Ids of the document rules, in order.
DEFAULT_RULES = (
    _rule("doanh_thu_khong_di_kem_dong_tien", lx.GROWTH, lx.WEAK_CASH),
    _rule("doanh_thu_tang_nhung_loi_nhuan_giam", lx.FALLING_PROFIT),
    _rule("hoa_don_gia_hoac_thoi_phong_doanh_thu", lx.FALSE_INVOICES),
    _rule("che_giau_no_phai_tra", lx.HIDDEN_DEBT),
    _rule("dau_hieu_quan_tri_rui_ro", lx.GOVERNANCE_RISK),
    _rule("window_dressing_cuoi_ky", lx.YEAR_END),
    _rule("che_giau_no_phai_tra", lx.OFF_BALANCE, lx.CONCEALMENT, late=True),
)


def has_any(folded: Column, phrases: Sequence[str]) -> Column:
    """Whether the folded text holds one of the phrases; phrases are folded at plan time."""
    made = [folded.contains(p) for p in dict.fromkeys(" ".join(tx.fold_literal(p).lower().split()) for p in phrases)]
    out = made[0]
    for m in made[1:]:
        out = out | m
    return out


def _all(folded: Column, groups: Sequence[Sequence[str]]) -> Column:
    out = F.lit(True)
    for g in groups:
        out = out & has_any(folded, g)
    return out


def red_flags(folded: Column, rules: Sequence[Rule] = DEFAULT_RULES) -> Column:
    """Ids of the rules that fire, in order."""
    early = [(r.id, _all(folded, r.groups)) for r in rules if not r.late]
    made = [F.when(c, F.lit(i)) for i, c in early]
    for r in rules:
        if r.late:
            before = F.lit(False)
            for i, c in early:
                before = before | c if i == r.id else before
            made.append(F.when(_all(folded, r.groups) & ~before, F.lit(r.id)))
    return F.filter(F.array(*made), lambda x: x.isNotNull())


def suspicious_segments(t: Column, rules: Sequence[Rule] = DEFAULT_RULES, flags: Column | None = None) -> Column:
    """Segments with flags: array of (snippet of 300 characters, flags).

    ``flags``: the flags of the whole text, if known. A segment's folded text lies within the text's, so a text without
    flags has no such segment and its segments aren't looked at.
    """
    # folded once per segment: the inner array is made before the outer lambda reads it many times
    both = F.transform(tx.segments(t), lambda s: F.struct(F.left(s, F.lit(300)).alias("s"), tx.fold(s).alias("f")))
    made = F.transform(both, lambda x: F.struct(x["s"].alias("snippet"), F.array_join(red_flags(x["f"], rules), ", ").alias("flags")))
    found = F.filter(made, lambda x: x["flags"] != "")
    whole = tx.let(tx.fold(t), lambda f: red_flags(f, rules)) if flags is None else flags
    return F.when(F.size(whole) > 0, found).otherwise(F.array().cast("array<struct<snippet:string,flags:string>>"))


def risk_band(score: Column) -> Column:
    return F.when(score >= 0.75, "Cao").when(score >= 0.45, "Trung bình").otherwise("Thấp")


def boosted(score: Column, flags: Column, bonus: float = 0.05) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score) + F.lit(bonus) * F.size(flags))


def score_breakdown(raw: Column, hybrid: Column, flags: Column, threshold: Column, bonus: float = 0.05) -> Column:
    """Scores of every layer, what the rules added, which layer decided, and the predicted label."""
    base = F.coalesce(hybrid, raw)
    final = boosted(base, flags, bonus)
    layer = F.when(F.size(flags) > 0, "rule_based_postprocessing").when(hybrid.isNotNull(), "hybrid_metadata_head").otherwise("raw_model")
    return F.struct(raw.alias("raw_model_score"), base.alias("hybrid_metadata_score"), final.alias("final_score"), (final - base).alias("rule_increment"), threshold.alias("threshold_used"), (final >= threshold).cast("int").alias("predicted_label"), layer.alias("decision_layer"), flags.alias("red_flags"))


def bias_flags(ocr_quality: Column, digit_ratio: Column, log_char_len: Column, flag_count: Column, english_ratio: Column) -> Column:
    made = [F.when(ocr_quality < 0.55, "low_ocr_quality"), F.when(digit_ratio > 0.12, "digit_heavy_text"), F.when(log_char_len <= 5.0, "short_text"), F.when(flag_count >= 2, "many_rule_flags"), F.when(english_ratio > 0.08, "english_heavy_text")]
    return F.filter(F.array(*made), lambda x: x.isNotNull())


def label_name(raw: Column) -> Column:
    """A label of the audit domain from a string or number."""
    v = F.upper(F.trim(raw.cast("string")))
    number = v.try_cast("int")
    return F.when(v.isin(*lx.LABELS), v).when(v.isin("1", "RISK", "HIGH_RISK") | (number > 0), "CANH_BAO").otherwise("BINH_THUONG")


def label_number(name: Column) -> Column:
    out = F.lit(0)
    for k, v in lx.LABELS.items():
        out = F.when(name == k, v).otherwise(out)
    return out


def risk_level(label: Column, flags: Column) -> Column:
    return F.when(label == "BINH_THUONG", "THAP").when((F.size(flags) >= 2) | (label == "VI_PHAM"), "CAO").otherwise("TRUNG_BINH")


# Words that point to a standard.
_REFERENCES = (
    (("du_phong", "du phong", "kho_doi", "no_phai_thu"), ("TT48/2019 Dieu 6", "TT200/2014 TK2293")),
    (("doanh_thu", "doanh thu", "hoa_don", "hoa don"), ("VAS 14",)),
    (("ben_lien_quan", "ngoai_bang", "che_giau"), ("VAS 01",)),
)


def standard_refs(joined_terms: Column, label: Column) -> Column:
    """Standards that a preprocessed text points to; VAS 01 for a finding that points to none."""
    made = []
    for words, refs in _REFERENCES:
        hit = F.lit(False)
        for w in words:
            hit = hit | joined_terms.contains(w)
        made += [F.when(hit, F.lit(r)) for r in refs]
    found = F.filter(F.array(*made), lambda x: x.isNotNull())
    return F.when((F.size(found) == 0) & (label != "BINH_THUONG"), F.array(F.lit("VAS 01"))).otherwise(found)


def finding(label: Column, flags: Column, refs: Column) -> Column:
    return (
        F.when(label == "BINH_THUONG", "Khong phat hien canh bao rui ro trong doan van.")
        .when(F.size(flags) > 0, F.concat(F.lit("Phat hien tin hieu rui ro: "), F.array_join(flags, ", ")))
        .when(F.size(refs) > 0, F.concat(F.lit("Can doi chieu them voi "), F.array_join(refs, ", ")))
        .otherwise("Canh bao rui ro sai lech trong yeu can kiem tra bo sung.")
    )


def rule_table(spark: SparkSession, rules: Sequence[tuple] = tuple(lx.DECLARED_RULES)) -> DataFrame:
    return spark.createDataFrame(list(rules), "rule_id string, name string, standard string, trigger string, context string, label string, risk string")


def declared_hits(docs: DataFrame, rules: Sequence[tuple] = tuple(lx.DECLARED_RULES), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, rule_id, standard, label, risk): documents whose folded text matches trigger and context of a rule.

    The rules are a parameter of the plan, so each compiles to two constant patterns and the text is read once.
    """
    made = [F.when(F.col("_fold").rlike(t) & F.col("_fold").rlike(c), F.struct(F.lit(i).alias("rule_id"), F.lit(s).alias("standard"), F.lit(lb).alias("label"), F.lit(r).alias("risk"))) for i, _, s, t, c, lb, r in rules]
    hits = docs.select(id_col, tx.fold(F.col(text_col)).alias("_fold")).select(id_col, F.explode(F.filter(F.array(*made), lambda x: x.isNotNull())).alias("h"))
    return hits.select(id_col, "h.*")


def standard_matches(docs: DataFrame, patterns: Mapping[str, str] = lx.STANDARD_PATTERNS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, standard): documents whose folded text matches a standard's pattern."""
    made = [F.when(F.col("_fold").rlike(p), F.lit(k)) for k, p in patterns.items()]
    hits = docs.select(id_col, tx.fold(F.col(text_col)).alias("_fold")).select(id_col, F.explode(F.filter(F.array(*made), lambda x: x.isNotNull())).alias("standard"))
    return hits


def personal_data(t: Column) -> dict[str, Column]:
    """Counts of e-mail addresses, phone numbers and long ids."""
    return {"email": F.regexp_count(t, F.lit(lx.EMAIL)), "phone": F.regexp_count(t, F.lit(lx.PHONE)), "long_id": F.regexp_count(t, F.lit(lx.LONG_ID))}


def mentions(t: Column, phrases: Sequence[str], accents: bool = True) -> Column:
    """Whether the text holds one of the phrases, in any case and with any white space between its words."""
    return t.rlike("(?iu)" + tx.any_phrase(phrases, accents))


def near(t: Column, first: str, within: int, then: Sequence[str]) -> Column:
    """Whether one of ``then`` follows ``first`` on its line with at most so many characters between."""
    return t.rlike(f"(?iu){tx.phrase(first)}.{{0,{within}}}{tx.any_phrase(then)}")


def fraud_signals(t: Column, signals: Sequence[tuple[str, Sequence[str]]] = tuple(lx.FRAUD_SIGNALS)) -> Column:
    """Names of fraud signals in order: many round amounts, the phrases of each signal, related parties."""
    rounds = F.size(F.filter(F.regexp_extract_all(t, F.lit(r"\b(\d+)(?:,000){2,}\b"), F.lit(1)), lambda x: x.endswith("000")))
    made = [F.when(rounds > 5, F.concat(F.lit("so_tien_tron_bat_thuong_"), rounds.cast("string"), F.lit("_lan")))]
    made += [F.when(mentions(t, phrases), F.lit(f"tu_khoa_{name}")) for name, phrases in signals]
    made.append(F.when(mentions(t, lx.RELATED_PARTIES), F.lit("co_giao_dich_ben_lien_quan")))
    return F.filter(F.array(*made), lambda x: x.isNotNull())


def distress_signals(t: Column, profit: Column, revenue: Column, lasting: Column | None = None, provision: Column | None = None) -> Column:
    """Names of distress signals from the text and two fields.

    ``lasting``, ``provision``: whether the text tells of lasting losses, and its provision as written or empty, if known.
    """
    ratio = F.abs(profit) / F.nullif(revenue, F.lit(0.0))
    word, within = lx.PROVISION
    amount = F.regexp_extract(t, f"(?iu){tx.phrase(word)}.{{0,{within}}}([0-9.]{{8,}})", 1) if provision is None else provision
    value = tx.accounting_number(F.nullif(amount, F.lit("")))
    made = [
        F.when((revenue > 0) & (profit < 0) & (ratio > 0.3), F.concat(F.lit("lo_nang_"), F.format_string("%.1f%%", ratio * 100), F.lit("_doanh_thu"))),
        F.when(near(t, *lx.LASTING_LOSS) if lasting is None else lasting, F.lit("lo_lien_tiep")),
        F.when((revenue > 0) & (value / F.nullif(revenue, F.lit(0.0)) > 0.1), F.lit("du_phong_lon_hon_10pct_dt")),
    ]
    return F.filter(F.array(*made), lambda x: x.isNotNull())


def auto_label(t: Column, signals: Column, adverse: Column | None = None) -> Column:
    """1 for an adverse, qualified or withheld opinion (``adverse``, if known) or any fraud signal, else 0."""
    first, within, then = lx.REFUSED
    opinion = mentions(t, lx.ADVERSE_OPINIONS) | near(t, first, within, [then]) if adverse is None else adverse
    return F.when(opinion | (F.size(signals) > 0), 1).otherwise(0)
