"""DuckDB SQL of the queries, written from the definitions rather than from the Spark plans."""

from __future__ import annotations

from veriscope.functions import lexicons as lx
from veriscope.functions import rules as rl
from veriscope.functions import text as tx

WS, WORD = tx.WS, tx.WORD


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sub(t: str, pattern: str, by: str = "", flags: str = "g") -> str:
    return f"regexp_replace({t}, {q(pattern)}, {q(by)}, '{flags}')"


def accents(t: str) -> str:
    return f"replace(replace(strip_accents({t}), 'đ', 'd'), 'Đ', 'D')"


def strip(t: str) -> str:
    return sub(t, f"^{WS}+|{WS}+$")


def collapse(t: str) -> str:
    return f"trim({sub(f'lower({t})', WS + '+', ' ')})"


def fold(t: str) -> str:
    return collapse(accents(t))


def clean(t: str) -> str:
    s = f"replace(nfc_normalize({sub(t, '<[^>]+>', ' ')}), chr(160), ' ')"
    s = sub(s, f"https?://{tx.NOT_WS}+", " ")
    s = sub(s, "&[a-z]+;", " ")
    return collapse(sub(s, f"[^0-9A-Za-zÀ-ỹ_{WS[1:]}", " "))


def words(t: str) -> str:
    return f"regexp_extract_all(lower({t}), {q(WORD + '+')})"


def ws_tokens(t: str) -> str:
    return f"list_filter(regexp_split_to_array({t}, {q(WS + '+')}), lambda x: x <> '')"


def listed(xs) -> str:
    return "[" + ", ".join(map(q, xs)) + "]"


def kept(tokens: str) -> str:
    return f"list_filter({tokens}, lambda x: length(x) > 1 AND NOT list_contains({listed(lx.STOP_WORDS)}, x))"


def terms(t: str) -> str:
    s = clean(t)
    for c in lx.COMPOUNDS:
        s = f"replace({s}, {q(c)}, {q(c.replace(' ', '_'))})"
    return kept(words(s))


def segments(t: str) -> str:
    s = sub(t, rf"([.?!]){WS}+", r"\1" + "\x01")
    return f"list_filter(list_transform(string_split({sub(s, '[\n\r]+', chr(1))}, chr(1)), lambda s: {strip('s')}), lambda x: x <> '')"


def has(folded: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({folded}, {q(' '.join(tx.fold_literal(p).lower().split()))})" for p in dict.fromkeys(phrases)) + ")"


def flags(folded: str, rules=rl.DEFAULT_RULES) -> str:
    made = []
    for r in rules:
        cond = " AND ".join(has(folded, g) for g in r.groups)
        if r.late:
            cond += " AND NOT (" + " OR ".join("(" + " AND ".join(has(folded, g) for g in e.groups) + ")" for e in rules if e.id == r.id and not e.late) + ")"
        made.append(f"CASE WHEN {cond} THEN {q(r.id)} END")
    return f"list_filter([{', '.join(made)}], lambda x: x IS NOT NULL)"


def count_of(t: str, k: str) -> str:
    return f"((length({t}) - length(replace({t}, {q(k)}, ''))) / {len(k)}.0::DOUBLE)"


def matching(t: str, c: str) -> str:
    return f"length({sub(t, f'[^{c}]')})"


def quality(t: str, k: str) -> str:
    raw = ws_tokens(t)
    noisy = f"len(list_filter({raw}, lambda x: regexp_matches(x, '\\p{{Nd}}') AND length(x) > 6))"
    n, m = f"len({raw})", f"len({k})"
    s = f"0.6::DOUBLE * {m} / greatest({n}, 1) + 0.5::DOUBLE * len(list_filter({k}, lambda x: length(x) >= 3)) / greatest({m}, 1) - 0.3::DOUBLE * {noisy} / greatest({n}, 1)"
    return f"CASE WHEN {n} = 0 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, {s})) END"


T = "coalesce(text, '')"
DOCS = f"docs AS (SELECT doc_id, lang, source, company_id, report_year, {T} AS t FROM documents)"
#: One row per prediction event: labelled deliveries before unlabelled ones, then the last received.
EVENTS = "ev AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY (true_label IS NOT NULL) DESC, received_at DESC NULLS LAST) AS n FROM (SELECT DISTINCT * FROM prediction_events)) WHERE n = 1)"


def evaluate(source: str, group: list[str], label: str, score: str, threshold: str) -> str:
    g = "".join(f"{c}, " for c in group)
    by = f"PARTITION BY {', '.join(group)} " if group else ""
    end = f"GROUP BY {', '.join(group)}" if group else ""
    return f"""
    r AS (SELECT {g} CASE WHEN {label} > 0 THEN 1 ELSE 0 END AS y, {score}::DOUBLE AS s, CASE WHEN {score} >= {threshold} THEN 1 ELSE 0 END AS p FROM {source} WHERE {label} IS NOT NULL AND {score} IS NOT NULL),
    k AS (SELECT *, avg(rk) OVER (PARTITION BY {g} s) AS mid FROM (SELECT *, row_number() OVER ({by}ORDER BY s) AS rk FROM r)),
    c AS (SELECT {g} s, sum(y) AS pos, count(*) AS n FROM r GROUP BY {g} s),
    a AS (SELECT {g} sum(pos * ctp / cn::DOUBLE) / nullif(sum(pos), 0) AS ap FROM (SELECT *, sum(pos) OVER ({by}ORDER BY s DESC) AS ctp, sum(n) OVER ({by}ORDER BY s DESC) AS cn FROM c) {end}),
    m AS (SELECT {g} count(*) AS support, sum(y)::BIGINT AS positives, sum(y * p)::BIGINT AS tp, sum((1 - y) * p)::BIGINT AS fp, sum(y * (1 - p))::BIGINT AS fn, sum((1 - y) * (1 - p))::BIGINT AS tn,
        CASE WHEN sum(y) > 0 AND sum(1 - y) > 0 THEN (sum(y * mid) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * sum(1 - y)) ELSE 0 END AS auc_roc,
        avg(s) AS score_mean, stddev_pop(s) AS score_std, min(s) AS score_min, max(s) AS score_max, avg(p) AS predicted_rate FROM k {end}),
    e AS (SELECT *, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS precision, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS recall FROM m)"""


def _fb(b: float) -> str:
    return f"coalesce({1 + b * b}::DOUBLE * precision * recall / nullif({b * b}::DOUBLE * precision + recall, 0), 0)"


METRICS = f"support, positives, tp, fp, fn, tn, round(precision, 6) AS precision, round(recall, 6) AS recall, round({_fb(1)}, 6) AS f1, round({_fb(0.5)}, 6) AS f0_5, round({_fb(2)}, 6) AS f2, round((tp + tn) / support::DOUBLE, 6) AS accuracy, round(auc_roc, 6) AS auc_roc, round(coalesce(ap, 0), 6) AS auprc, round(coalesce((tp * tn - fp * fn)::DOUBLE / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 6) AS mcc"

SQL: dict[str, str] = {
    "risk_bands": f"""WITH {DOCS}, f AS (SELECT lang, {flags('f')} AS fl FROM (SELECT lang, {fold('t')} AS f FROM docs)),
        s AS (SELECT lower(coalesce(lang, 'unknown')) AS lang, least(1.0::DOUBLE, 0.4::DOUBLE + 0.05::DOUBLE * len(fl)) AS score, len(fl) AS n FROM f)
        SELECT lang, CASE WHEN score >= 0.75 THEN 'Cao' WHEN score >= 0.45 THEN 'Trung bình' ELSE 'Thấp' END AS band, count(*) AS documents, sum(n)::BIGINT AS flags FROM s GROUP BY ALL""",
    "text_tokens": f"WITH {DOCS} SELECT doc_id, len({words('t')}) AS tokens, len({kept(words('t'))}) AS kept, len({ws_tokens('t')}) AS ws FROM docs",
    "text_fold": f"WITH {DOCS} SELECT doc_id, md5({fold('t')}) AS folded, md5({collapse('t')}) AS collapsed FROM docs",
    "text_clean": f"WITH {DOCS} SELECT doc_id, md5({clean('t')}) AS cleaned FROM docs",
    "text_terms": f"WITH {DOCS} SELECT doc_id, md5(array_to_string({terms('t')}, ' ')) AS terms FROM docs",
    "text_quality": f"WITH {DOCS}, k AS (SELECT doc_id, t, {terms('t')} AS k FROM docs) SELECT doc_id, round({quality('t', 'k')}, 6) AS quality FROM k",
    "text_english": f"WITH {DOCS} SELECT doc_id, (length(regexp_replace(t, '[^\\x00-\\x7F]', '', 'g')) / greatest(length(t), 1)::DOUBLE > 0.9 AND len(list_filter({words('t')}, lambda x: list_contains({listed(lx.ENGLISH_KEYWORDS)}, x))) >= 3) AS english FROM docs",
    "text_segments": f"WITH {DOCS}, s AS (SELECT doc_id, {segments('t')} AS s FROM docs) SELECT doc_id, len(s) AS segments, md5(array_to_string(s, '|')) AS content FROM s",
    "text_windows": f"""WITH {DOCS}, s AS (SELECT doc_id, {strip('t')} AS s FROM docs),
        w AS (SELECT doc_id, unnest(generate_series(0, greatest(ceil((length(s) - 120) / 648.0::DOUBLE) - 1, 0)::BIGINT)) AS i, s FROM s),
        p AS (SELECT doc_id, i, {strip('substring(s, (i * 648 + 1)::BIGINT, 768)')} AS c FROM w)
        SELECT doc_id, count(*) AS windows, sum(length(c))::BIGINT AS chars, md5(string_agg(c, '|' ORDER BY i)) AS content FROM p WHERE c <> '' GROUP BY doc_id""",
    "text_numbers": f"""WITH {DOCS}, n AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(t, '\\d+(?:[.,]\\d+)*'), lambda x: TRY_CAST(replace(replace(x, '.', ''), ',', '.') AS DOUBLE)), lambda x: x IS NOT NULL) AS n FROM docs)
        SELECT doc_id, len(n) AS numbers, coalesce(list_max(n), 0) AS largest FROM n""",
    "text_denoised": "",
    "rule_flags": f"WITH {DOCS}, f AS (SELECT doc_id, {fold('t')} AS f FROM docs) SELECT doc_id, array_to_string({flags('f')}, ',') AS flags FROM f",
    "rule_flag_counts": f"WITH {DOCS}, f AS (SELECT {fold('t')} AS f FROM docs), x AS (SELECT unnest({flags('f')}) AS flag FROM f) SELECT flag, count(*) AS documents FROM x GROUP BY flag",
    "suspicious_segments": f"WITH {DOCS}, s AS (SELECT doc_id, list_filter(list_transform({segments('t')}, lambda s: {{'snippet': left(s, 300), 'flags': array_to_string({flags(fold('s'))}, ', ')}}), lambda x: x.flags <> '') AS s FROM docs), u AS (SELECT doc_id, unnest(s) AS x, generate_subscripts(s, 1) - 1 AS position FROM s) SELECT doc_id, position, x.snippet AS snippet, x.flags AS flags FROM u",
    "metadata_features": "",
    "linguistic_features": "",
    "benford": """WITH d AS (SELECT l_returnflag, left(floor(abs(l_extendedprice))::BIGINT::VARCHAR, 1)::INT AS digit FROM lineitem WHERE abs(l_extendedprice) >= 1),
        n AS (SELECT l_returnflag, count(*) AS n FROM d GROUP BY 1), g AS (SELECT range AS digit, log10(1 + 1.0::DOUBLE / range) AS e FROM range(1, 10)),
        c AS (SELECT l_returnflag, digit, count(*) AS c FROM d GROUP BY 1, 2)
        SELECT n.l_returnflag, n.n, round(sum(power(coalesce(c, 0) / n.n::DOUBLE - e, 2) / e), 6) AS deviation FROM n CROSS JOIN g LEFT JOIN c ON c.l_returnflag = n.l_returnflag AND c.digit = g.digit GROUP BY 1, 2""",
    "term_drift": f"""WITH {DOCS}, k AS (SELECT doc_id, company_id, list_distinct({terms('t')}) AS k, report_year FROM docs WHERE company_id IS NOT NULL),
        p AS (SELECT doc_id, k, lag(k) OVER (PARTITION BY company_id ORDER BY report_year NULLS FIRST, doc_id) AS p FROM k)
        SELECT doc_id, round(CASE WHEN p IS NULL THEN 0 ELSE 1 - len(list_intersect(k, p)) / greatest(len(k) + len(p) - len(list_intersect(k, p)), 1)::DOUBLE END, 6) AS drift_score FROM p""",
    "dedup_first": "SELECT min(sample_id) AS sample_id FROM mini_samples GROUP BY text",
    "temporal_split": "WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders) SELECT o_orderkey, CASE WHEN i < floor(n * 0.8) THEN 'train' WHEN i < floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split FROM o",
    "stratified_split": "WITH o AS (SELECT sample_id, label, (row_number() OVER (PARTITION BY label ORDER BY md5(sample_id::VARCHAR || ':42')) - 1) / (count(*) OVER (PARTITION BY label))::DOUBLE AS p FROM mini_samples) SELECT sample_id, CASE WHEN p < 0.8 THEN 'train' WHEN p < 0.9 THEN 'val' ELSE 'test' END AS split FROM o",
    "expanding_folds": "WITH o AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, (count(*) OVER ())::BIGINT AS n FROM events), b AS (SELECT *, floor(n * 0.5)::BIGINT AS a, (n - floor(n * 0.5)::BIGINT) // 4 AS k FROM o), f AS (SELECT b.*, range AS fold FROM b CROSS JOIN range(1, 4)) SELECT fold, CASE WHEN i < a + (fold - 1) * k THEN 'train' ELSE 'val' END AS role, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM f WHERE i < a + fold * k GROUP BY ALL",
    "tail_validation": "WITH o AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () AS n FROM events) SELECT event_id, CASE WHEN i < n - greatest(1, floor(n * 0.1)) THEN 'train' ELSE 'val' END AS split FROM o",
    "split_statistics": "WITH s AS (SELECT split, count(*) AS records, count(DISTINCT company_id) AS companies FROM m1_records GROUP BY 1), l AS (SELECT split, string_agg(l || '=' || c, ',' ORDER BY l) AS labels FROM (SELECT split, coalesce(label, 'null') AS l, count(*) AS c FROM m1_records GROUP BY 1, 2) GROUP BY 1) SELECT s.split, records, companies, labels FROM s JOIN l ON s.split IS NOT DISTINCT FROM l.split",
    "governance_coverage": "SELECT " + ", ".join(f"round(avg(CASE WHEN trim(coalesce({f}::VARCHAR, '')) <> '' THEN 1.0::DOUBLE ELSE 0 END), 6) AS {f}" for f in ("source", "doc_id", "version", "collected_at", "anonymized", "privacy_reviewed")) + " FROM mini_samples",
    "governance_report": "SELECT count(*) AS total, count(label) AS labels, sum(CASE WHEN label > 0 THEN 1 ELSE 0 END)::BIGINT AS fraud, count(*) - count(DISTINCT coalesce(text, '')) AS duplicates, sum(len(regexp_extract_all(coalesce(text, ''), " + q(lx.EMAIL) + ")))::BIGINT AS pii_email FROM mini_samples",
    "pii_emails": f"WITH {DOCS} SELECT doc_id, len(regexp_extract_all(t, {q(lx.EMAIL)})) AS emails FROM docs",
    "cohen_kappa": """WITH x AS (SELECT labeler_a AS a, labeler_b AS b FROM mini_samples WHERE labeler_a IS NOT NULL AND labeler_b IS NOT NULL), n AS (SELECT count(*)::DOUBLE AS n, avg(CASE WHEN a = b THEN 1.0::DOUBLE ELSE 0 END) AS po FROM x),
        e AS (SELECT sum(ra * cb)::DOUBLE AS e FROM (SELECT a, count(*) AS ra FROM x GROUP BY 1) JOIN (SELECT b, count(*) AS cb FROM x GROUP BY 1) ON a = b)
        SELECT n::BIGINT AS n, round(po, 6) AS agreement, round(e / (n * n), 6) AS chance, round((po - e / (n * n)) / (1 - e / (n * n)), 6) AS kappa FROM n, e""",
    "eval_metrics": f"WITH {EVENTS}, {evaluate('ev', ['model'], 'true_label', 'fraud_prob', '0.5')} SELECT e.model, {METRICS} FROM e JOIN a USING (model)",
    "score_summary": f"WITH {EVENTS}, {evaluate('ev', ['model'], 'true_label', 'fraud_prob', '0.5')} SELECT model, support, round(score_mean, 6) AS score_mean, round(score_std, 6) AS score_std, round(score_min, 6) AS score_min, round(score_max, 6) AS score_max, round(predicted_rate, 6) AS predicted_rate FROM e",
    "best_threshold": f"""WITH {EVENTS}, r AS (SELECT model, fraud_prob AS s, CASE WHEN true_label > 0 THEN 1 ELSE 0 END AS y FROM ev WHERE true_label IS NOT NULL AND fraud_prob IS NOT NULL),
        c AS (SELECT model, s, sum(y) AS pos, count(*) AS n FROM r GROUP BY 1, 2), w AS (SELECT *, sum(pos) OVER d AS tp, sum(n) OVER d AS pp, sum(pos) OVER (PARTITION BY model) AS al FROM c WINDOW d AS (PARTITION BY model ORDER BY s DESC)),
        f AS (SELECT model, s, coalesce(5.0::DOUBLE * (tp / pp::DOUBLE) * (tp / nullif(al, 0)::DOUBLE) / nullif(4.0::DOUBLE * (tp / pp::DOUBLE) + tp / nullif(al, 0)::DOUBLE, 0), 0) AS v, al FROM w),
        o AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY round(v, 12) DESC, s) AS k FROM f)
        SELECT model, round(CASE WHEN al > 0 THEN s ELSE 0.5 END, 6) AS threshold, round(CASE WHEN al > 0 THEN v ELSE 0 END, 6) AS value FROM o WHERE k = 1""",
    "pr_curve": f"""WITH {EVENTS}, r AS (SELECT model, fraud_prob AS s, CASE WHEN true_label > 0 THEN 1 ELSE 0 END AS y FROM ev WHERE true_label IS NOT NULL AND fraud_prob IS NOT NULL)
        SELECT model, round(s, 9) AS threshold, round(sum(sum(y)) OVER d / (sum(count(*)) OVER d)::DOUBLE, 6) AS precision, round(coalesce(sum(sum(y)) OVER d / nullif(sum(sum(y)) OVER (PARTITION BY model), 0)::DOUBLE, 0), 6) AS recall FROM r GROUP BY model, s WINDOW d AS (PARTITION BY model ORDER BY s DESC)""",
    "bias_slices": f"""WITH {EVENTS}, x AS (SELECT *, unnest(CASE WHEN len(coalesce(red_flags, [])) > 0 THEN red_flags ELSE ['default_population'] END) AS slice FROM ev), {evaluate('x', ['slice'], 'true_label', 'fraud_prob', '0.5')},
        w AS (SELECT sum(y * p) / nullif(sum(p), 0)::DOUBLE AS pp, sum(y * p) / nullif(sum(y), 0)::DOUBLE AS rr FROM (SELECT CASE WHEN true_label > 0 THEN 1 ELSE 0 END AS y, CASE WHEN fraud_prob >= 0.5 THEN 1 ELSE 0 END AS p FROM ev WHERE true_label IS NOT NULL AND fraud_prob IS NOT NULL))
        SELECT slice, support, positives, round(precision, 6) AS precision, round(recall, 6) AS recall, round(abs(precision - pp), 6) AS precision_gap, round(abs(recall - rr), 6) AS recall_gap FROM e, w WHERE support >= 5""",
    "mcnemar_pairs": f"""WITH {EVENTS}, r AS (SELECT sample_id, model, max(CASE WHEN (true_label > 0) = (fraud_prob >= threshold_used) THEN 1 ELSE 0 END) AS ok FROM ev WHERE true_label IS NOT NULL AND fraud_prob IS NOT NULL AND threshold_used IS NOT NULL AND sample_id IS NOT NULL AND model IS NOT NULL GROUP BY 1, 2)
        SELECT a.model AS model_a, b.model AS model_b, sum(CASE WHEN a.ok = 0 AND b.ok = 0 THEN 1 ELSE 0 END)::BIGINT AS n00, sum(CASE WHEN a.ok = 0 AND b.ok = 1 THEN 1 ELSE 0 END)::BIGINT AS n01, sum(CASE WHEN a.ok = 1 AND b.ok = 0 THEN 1 ELSE 0 END)::BIGINT AS n10, sum(CASE WHEN a.ok = 1 AND b.ok = 1 THEN 1 ELSE 0 END)::BIGINT AS n11,
        round(coalesce(power(abs(sum(CASE WHEN a.ok = 0 AND b.ok = 1 THEN 1 ELSE 0 END) - sum(CASE WHEN a.ok = 1 AND b.ok = 0 THEN 1 ELSE 0 END)) - 1, 2)::DOUBLE / nullif(sum(CASE WHEN a.ok <> b.ok THEN 1 ELSE 0 END), 0), 0), 6) AS statistic FROM r a JOIN r b ON a.sample_id = b.sample_id AND a.model < b.model GROUP BY 1, 2""",
    "ablation": f"WITH {EVENTS}, {evaluate('ev', ['model'], 'true_label', 'fraud_prob', '0.5')}, z AS (SELECT model, {METRICS} FROM e JOIN a USING (model)), b AS (SELECT * FROM z ORDER BY f2 DESC, model LIMIT 1) SELECT z.model, b.model AS full, round(b.f2 - z.f2, 6) AS delta_f2, round(b.auc_roc - z.auc_roc, 6) AS delta_auc_roc, round(b.mcc - z.mcc, 6) AS delta_mcc FROM z, b WHERE z.model <> b.model",
    "best_models": f"WITH {EVENTS}, {evaluate('ev', ['model'], 'true_label', 'fraud_prob', '0.5')}, z AS (SELECT model, round({_fb(2)}, 6) AS f2, round(auc_roc, 6) AS auc_roc, round(recall, 6) AS recall FROM e), l AS (SELECT 'f2' AS metric, model, f2 AS value FROM z UNION ALL SELECT 'auc_roc', model, auc_roc FROM z UNION ALL SELECT 'recall', model, recall FROM z), o AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value DESC, model) AS k FROM l) SELECT metric, model, value FROM o WHERE k = 1",
    "layer_evidence": f"WITH {EVENTS}, x AS (SELECT fraud_prob AS r, least(1.0::DOUBLE, greatest(0.0::DOUBLE, fraud_prob) + 0.05::DOUBLE * len(coalesce(red_flags, []))) AS h FROM ev WHERE fraud_prob IS NOT NULL) SELECT count(*) AS n, round(avg(abs(h - r)), 6) AS mean_shift, round(max(abs(h - r)), 6) AS max_shift, sum(CASE WHEN (r >= 0.5) <> (h >= 0.5) THEN 1 ELSE 0 END)::BIGINT AS changed FROM x",
    "class_weights": "WITH c AS (SELECT label, count(*) AS n FROM mini_samples WHERE label IS NOT NULL GROUP BY 1) SELECT label, n, round(sum(n) OVER () / (count(*) OVER () * n)::DOUBLE, 6) AS weight, round(1 - n / (sum(n) OVER ())::DOUBLE, 6) AS alpha FROM c",
    "rolling_window": f"WITH {EVENTS} SELECT event_id, count(fraud_prob) OVER w AS window_n, round(avg(fraud_prob) OVER w, 6) AS window_mean, round(max(fraud_prob) OVER w, 6) AS window_max FROM ev WINDOW w AS (PARTITION BY model ORDER BY ts, event_id ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)",
    "drift_by_month": "",
    "late_labels": "WITH e AS (SELECT event_id, min(model) AS model FROM (SELECT DISTINCT * FROM prediction_events) GROUP BY 1), t AS (SELECT event_id, true_label, row_number() OVER (PARTITION BY event_id ORDER BY received_at DESC NULLS LAST, true_label DESC) AS k FROM prediction_events WHERE true_label IS NOT NULL) SELECT e.model, count(*) AS events, count(t.true_label) AS labelled, sum(t.true_label)::BIGINT AS positives FROM e LEFT JOIN t ON e.event_id = t.event_id AND k = 1 GROUP BY 1",
    "event_days": "SELECT event_type, date_trunc('day', ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "event_sessions": "WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS brk FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL), g AS (SELECT user_id, ts, sum(brk) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM x) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS n FROM g GROUP BY user_id, s",
    "tfidf_terms": f"""WITH {DOCS}, k AS (SELECT doc_id, unnest({words('t')}) AS term FROM docs), tf AS (SELECT doc_id, term, count(*) AS tf FROM k GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), n AS (SELECT count(*) AS n FROM docs),
        w AS (SELECT doc_id, term, tf * (ln((1.0::DOUBLE + n) / (1.0::DOUBLE + df)) + 1) AS w FROM tf JOIN df USING (term), n), u AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM w),
        o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 9) DESC, term) AS rank FROM u) SELECT doc_id, term, round(weight, 6) AS weight, rank FROM o WHERE rank <= 5""",
    "bm25_top": f"""WITH {DOCS}, d AS (SELECT doc_id, {words('t')} AS k FROM docs), l AS (SELECT doc_id, k, len(k) AS len FROM d), s AS (SELECT count(*) AS n, avg(len) AS avgl FROM l),
        qs AS (SELECT item_id, list_distinct({words("coalesce(text, '')")}) AS k FROM eval_items WHERE item_id % 20 = 0), qt AS (SELECT item_id, unnest(k) AS term FROM qs),
        tf AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len, unnest(k) AS term FROM l) WHERE term IN (SELECT term FROM qt) GROUP BY 1, 2, 3), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
        w AS (SELECT doc_id, term, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avgl)) AS w FROM tf JOIN df USING (term), s),
        o AS (SELECT item_id, doc_id, sum(w) AS score FROM qt JOIN w USING (term) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM o) SELECT item_id, doc_id, round(score, 5) AS score, rank FROM r WHERE rank <= 5""",
    "cosine_top": """WITH v AS (SELECT vec_id, embedding FROM embeddings WHERE embedding IS NOT NULL), p AS (SELECT a.vec_id AS query, b.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, vec_id) AS rank FROM p) SELECT query, vec_id, round(score, 6) AS score, rank FROM r WHERE rank <= 5""",
    "rolled_up_scores": f"""WITH {DOCS}, s AS (SELECT doc_id, {strip('t')} AS s FROM docs), w AS (SELECT doc_id, unnest(generate_series(0, greatest(ceil((length(s) - 120) / 648.0::DOUBLE) - 1, 0)::BIGINT)) AS i, s FROM s), p AS (SELECT doc_id, {strip('substring(s, (i * 648 + 1)::BIGINT, 768)')} AS c FROM w),
        z AS (SELECT doc_id, length(c) AS l, least(1.0::DOUBLE, {count_of('c', ',')} / 20.0::DOUBLE) AS v FROM p WHERE c <> '') SELECT doc_id, round(0.6::DOUBLE * max(v) + 0.4::DOUBLE * sum(v * l) / sum(l), 6) AS score FROM z GROUP BY 1""",
    "ingest_new": "SELECT DISTINCT source FROM documents WHERE source IS NOT NULL AND source NOT IN (SELECT source FROM mini_samples WHERE source IS NOT NULL)",
}


def _feature_sql() -> str:
    low, x, k, wsx, f, nums = "lo", "t", "k", "ws", "f", "nu"
    n_ws = f"greatest(len({wsx}), 1)"

    def share(words_: list[str], marks: str) -> str:
        return f"len(list_filter({wsx}, lambda x: list_contains({listed(words_)}, {sub('x', f'^[{marks}]+|[{marks}]+$')}))) / {n_ws}::DOUBLE"

    stripped = f"length({strip(x)})"
    seg = f"list_filter({segments(x)}, lambda s: len({flags(fold('s'))}) > 0)"
    cols = {
        "log_char_len": f"ln(1 + {stripped})",
        "log_token_count": f"ln(1 + len({k}))",
        "avg_token_len": f"coalesce(list_sum(list_transform({k}, lambda w: length(w))), 0) / greatest(len({k}), 1)::DOUBLE",
        "ocr_quality": quality(x, k),
        "digit_ratio": f"{matching(x, r'\p{Nd}')} / greatest({stripped}, 1)::DOUBLE",
        "uppercase_ratio": f"{matching(x, r'\p{Lu}')} / greatest({matching(x, r'\p{L}')}, 1)::DOUBLE",
        "newline_density": f"{count_of(x, chr(10))} / greatest({stripped}, 1)",
        "red_flag_count": f"len({flags(f)})::DOUBLE",
        "suspicious_segment_count": f"len({seg})::DOUBLE",
        "english_keyword_ratio": share(lx.ENGLISH_KEYWORDS, ".,:;!?"),
        "has_related_party": f"({has(f, lx.RELATED_PARTY)})::INT::DOUBLE",
        "has_invoice_risk": f"({has(f, lx.INVOICE_RISK)})::INT::DOUBLE",
        "has_cashflow_risk": f"({has(f, lx.CASHFLOW_RISK)})::INT::DOUBLE",
        "has_off_balance_risk": f"({has(f, lx.OFF_BALANCE_RISK)})::INT::DOUBLE",
        "financial_term_density_vn": "(" + " + ".join(f"contains({low}, {q(p)})::INT" for p in lx.FINANCIAL_TERMS_VN) + f") / {n_ws}::DOUBLE",
        "financial_term_density_en": share(lx.FINANCIAL_WORDS_EN, ".,;"),
        "round_number_ratio": f"len(list_filter({nums}, lambda v: v LIKE '%000' AND length(v) >= 6)) / greatest(len({nums}), 1)::DOUBLE",
        "accounting_code_count": f"len(list_distinct(list_filter({nums}, lambda v: regexp_full_match(v, '[1-7][0-9]{{2}}'))))::DOUBLE",
        "loss_keyword_count": "(" + " + ".join(count_of(low, p) for p in lx.LOSS_WORDS) + ")",
        "abnormal_profit_signal": f"({has(f, lx.ABNORMAL_PROFIT)})::INT::DOUBLE",
    }
    numbers = f"list_filter(regexp_extract_all(t, '[\\p{{L}}\\p{{N}}_]+'), lambda v: regexp_full_match(v, '\\p{{Nd}}+'))"
    return f"WITH {DOCS}, b AS (SELECT doc_id, t, {terms('t')} AS k, {fold('t')} AS f, lower(t) AS lo, {ws_tokens('lower(t)')} AS ws, {numbers} AS nu FROM docs) SELECT doc_id, " + ", ".join(f"round({e}, 6) AS {c}" for c, e in cols.items()) + " FROM b"


def _linguistic_sql() -> str:
    n = "greatest(len(w), 1)"
    ratio = {k: "(" + " + ".join(count_of("lo", p) for p in ps) + f") / {n}" for k, ps in lx.SIGNALS.items()}
    nums = "list_filter(list_transform(regexp_extract_all(t, '\\d+(?:[.,]\\d+)*'), lambda x: TRY_CAST(replace(replace(x, '.', ''), ',', '.') AS DOUBLE)), lambda x: x IS NOT NULL)"
    years = "list_filter(regexp_extract_all(t, '[\\p{L}\\p{N}_]+'), lambda v: regexp_full_match(v, '20[0-9]{2}'))"
    cols = ratio | {
        "fog_idx": f"0.4::DOUBLE * (av + 100.0::DOUBLE * coalesce(list_sum(list_transform(w, lambda x: greatest(1, length(x) // 3))), 0) / {n})",
        "avg_len": "av",
        "len_var": "coalesce(list_sum(list_transform(ls, lambda v: (v - av) * (v - av))), 0) / greatest(len(ls), 1)",
        "num_den": f"len({nums}) / {n}::DOUBLE",
        "time_r": f"len({years}) / {n}::DOUBLE",
        "excl_r": f"{count_of('t', '!')} / greatest(length(t), 1)",
        "quest_r": f"{count_of('t', '?')} / greatest(length(t), 1)",
        "sent_neu": f"greatest(0, 1 - {ratio['sent_pos']} - {ratio['sent_neg']})",
        "drift_sc": "0.0::DOUBLE",
    }
    cols |= {f"topic_{i}": f"len(list_filter(fl, lambda x: ('0x' || left(md5(x), 8))::BIGINT % 8 = {i})) / greatest(len(fl), 1)::DOUBLE" for i in range(8)}
    seg = f"CASE WHEN len({segments('t')}) > 0 THEN {segments('t')} ELSE [t] END"
    return f"WITH {DOCS}, a AS (SELECT doc_id, t, lower(t) AS lo, {fold('t')} AS f, {ws_tokens('t')} AS w, list_filter(list_transform({seg}, lambda s: len({ws_tokens('s')})), lambda n: n > 0) AS ls FROM docs), b AS (SELECT *, coalesce(list_sum(ls), 0) / greatest(len(ls), 1)::DOUBLE AS av, " + flags("f") + " AS fl FROM a) SELECT doc_id, " + ", ".join(f"round({e}, 6) AS {c}" for c, e in cols.items()) + " FROM b"


def _drift_sql() -> str:
    bins = ", ".join(f"sum(CASE WHEN b = {i} THEN 1 ELSE 0 END) / nullif(count(b), 0)::DOUBLE" for i in range(10))
    base = ", ".join(f"{x}::DOUBLE" for x in lx.BASELINE_BINS)
    return f"""WITH {EVENTS}, x AS (SELECT model, date_trunc('month', ts) AS month, fraud_prob, CASE WHEN fraud_prob IS NOT NULL THEN greatest(0, least(9, floor(fraud_prob / 0.1::DOUBLE)::INT)) END AS b FROM ev),
        h AS (SELECT model, month, count(*) AS events, count(b) AS scored, avg(fraud_prob) AS mean_prob, [{bins}] AS c FROM x GROUP BY 1, 2),
        p AS (SELECT *, CASE WHEN scored >= 10 THEN list_sum(list_transform(list_zip(c, [{base}]), lambda z: (greatest(z[1], 1e-6::DOUBLE) - z[2]) * ln(greatest(z[1], 1e-6::DOUBLE) / z[2]))) END AS psi FROM h)
        SELECT model, month, events, scored, round(mean_prob, 6) AS mean_prob, round(psi, 6) AS psi, CASE WHEN psi IS NULL OR psi < 0.1 THEN 'none' WHEN psi < 0.2 THEN 'warning' ELSE 'critical' END AS level FROM p"""


def _date_sql() -> str:
    made = []
    for f in ("collected_at", "published_at", "doc_id", "text"):
        v = f"coalesce({f}, '')"
        g = lambda p, i, v=v: f"TRY_CAST(nullif(regexp_extract({v}, {q(p)}, {i}), '') AS INT)"
        quarter = lx.DATE_QUARTER.replace("(?iu)", "(?i)")
        day = lambda y, m, d: f"make_date({y}, least(greatest({m}, 1), 12), least(greatest({d}, 1), 28))"
        shapes = [
            (lx.DATE_YMD, g(lx.DATE_YMD, 1), g(lx.DATE_YMD, 2), g(lx.DATE_YMD, 3), ""),
            (lx.DATE_DMY, g(lx.DATE_DMY, 3), g(lx.DATE_DMY, 2), g(lx.DATE_DMY, 1), ""),
            (quarter, g(quarter, 4), f"coalesce({g(quarter, 1)}, {g(quarter, 2)}, {g(quarter, 3)}) * 3", "28", ":quarter"),
            (lx.DATE_YEAR, g(lx.DATE_YEAR, 1), "12", "28", ":year"),
        ]
        cases = " ".join(f"WHEN regexp_matches({v}, {q(p)}) THEN CASE WHEN {y} BETWEEN 2000 AND 2027 THEN {{'date': {day(y, m, d)}, 'year': {y}, 'source': {q(f + s)}, 'known': true}} END" for p, y, m, d, s in shapes)
        made.append(f"CASE {cases} END")
    unknown = "{'date': make_date(1900, 1, 1), 'year': 0, 'source': 'unknown', 'known': false}"
    return f"SELECT sample_id, x.date AS date, x.year AS year, x.source AS source, x.known AS known FROM (SELECT sample_id, coalesce({', '.join(made)}, {unknown}) AS x FROM mini_samples)"


def _m1_sql() -> str:
    label = "CASE WHEN upper(trim(label)) IN ('BINH_THUONG', 'CANH_BAO', 'VI_PHAM', 'KHONG') THEN upper(trim(label)) WHEN upper(trim(label)) IN ('1', 'RISK', 'HIGH_RISK') OR TRY_CAST(upper(trim(label)) AS INT) > 0 THEN 'CANH_BAO' ELSE 'BINH_THUONG' END"
    hit = lambda ws: "(" + " OR ".join(f"contains(k, {q(w)})" for w in ws) + ")"
    a, b, c = (hit(ws) for ws, _ in rl._REFERENCES)
    refs = f"list_filter([CASE WHEN {a} THEN 'TT48/2019 Dieu 6' END, CASE WHEN {a} THEN 'TT200/2014 TK2293' END, CASE WHEN {b} THEN 'VAS 14' END, CASE WHEN {c} THEN 'VAS 01' END], lambda x: x IS NOT NULL)"
    return f"""WITH b AS (SELECT id, {label} AS label, {flags(fold(T))} AS f, array_to_string({terms(T)}, ' ') AS k FROM m1_records), r AS (SELECT *, CASE WHEN len({refs}) = 0 AND label <> 'BINH_THUONG' THEN ['VAS 01'] ELSE {refs} END AS refs FROM b)
        SELECT id, label, CASE label WHEN 'CANH_BAO' THEN 1 WHEN 'VI_PHAM' THEN 2 WHEN 'KHONG' THEN 3 ELSE 0 END AS label_int, CASE WHEN label = 'BINH_THUONG' THEN 'THAP' WHEN len(f) >= 2 OR label = 'VI_PHAM' THEN 'CAO' ELSE 'TRUNG_BINH' END AS risk_level, array_to_string(refs, ',') AS standard_ref,
        CASE WHEN label = 'BINH_THUONG' THEN 'Khong phat hien canh bao rui ro trong doan van.' WHEN len(f) > 0 THEN 'Phat hien tin hieu rui ro: ' || array_to_string(f, ', ') WHEN len(refs) > 0 THEN 'Can doi chieu them voi ' || array_to_string(refs, ', ') ELSE 'Canh bao rui ro sai lech trong yeu can kiem tra bo sung.' END AS finding FROM r"""


def denoise(t: str) -> str:
    s = sub(t, f"{tx.BLANK}+", " ")
    s = sub(s, r"[_\-.]{5,}", " ")
    s = sub(s, rf"(?m)^{WS}*[^a-zA-Z0-9À-ỹ\n]{{5,}}{WS}*$", "")
    s = sub(s, rf"(?mi)^{WS}*(?:[-–—]?{WS}*\d+{WS}*[-–—]?|Trang{WS}*\d+(?:/\d+)?|Page{WS}*\d+){WS}*$", "")
    return strip(sub(s, r"\n{3,}", "\n\n"))


def _denoised_sql() -> str:
    s, m = denoise("t"), "t"
    for p in lx.LEAKING_PHRASES:
        m = sub(m, f"(?i){p}", "[MASK]")
    return f"WITH {DOCS} SELECT doc_id, {s} AS text, {m} AS masked FROM docs"


def _report_sql() -> str:
    bins = ", ".join(f"sum(CASE WHEN b = {i} THEN 1 ELSE 0 END) / nullif(count(b), 0)::DOUBLE" for i in range(10))
    base = ", ".join(f"{x}::DOUBLE" for x in lx.BASELINE_BINS)
    judged = lambda e: f"CASE WHEN labelled >= 20 THEN {e} END"
    f2d, rd = f"({lx.BASELINE_METRICS['f2']}::DOUBLE - f2)", f"({lx.BASELINE_METRICS['recall']}::DOUBLE - recall)"
    return f"""WITH {EVENTS}, w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY ts DESC, event_id DESC) AS k FROM ev) WHERE k <= 200), {evaluate('w', ['model'], 'true_label', 'fraud_prob', 'threshold_used')},
        x AS (SELECT *, CASE WHEN fraud_prob IS NOT NULL THEN greatest(0, least(9, floor(fraud_prob / 0.1::DOUBLE)::INT)) END AS b FROM w),
        h AS (SELECT model, count(*) AS events, count(b) AS scored, avg(fraud_prob) AS mean_prob, avg(text_length) AS mean_length, avg(red_flag_count) AS mean_flags, avg(CASE WHEN label > 0 THEN 1.0::DOUBLE WHEN label IS NOT NULL THEN 0 END) AS fraud_rate, count(true_label) AS labelled, [{bins}] AS c FROM x GROUP BY 1),
        p AS (SELECT h.*, e.precision, e.recall, {_fb(1)} AS f1, {_fb(2)} AS f2, CASE WHEN scored >= 10 THEN list_sum(list_transform(list_zip(c, [{base}]), lambda z: (greatest(z[1], 1e-6::DOUBLE) - z[2]) * ln(greatest(z[1], 1e-6::DOUBLE) / z[2]))) END AS psi FROM h LEFT JOIN e ON h.model IS NOT DISTINCT FROM e.model),
        l AS (SELECT *, CASE WHEN psi IS NULL OR psi < 0.1 THEN 'none' WHEN psi < 0.2 THEN 'warning' ELSE 'critical' END AS level FROM p),
        al_ AS (SELECT *, list_filter([CASE WHEN level <> 'none' THEN 'data_drift_' || level END, CASE WHEN labelled >= 20 AND {f2d} > 0.05 THEN 'concept_drift_f2' END, CASE WHEN labelled >= 20 AND {rd} > 0.03 THEN 'concept_drift_recall' END], lambda x: x IS NOT NULL) AS al FROM l)
        SELECT model, events, scored, round(mean_prob, 6) AS mean_prob, round(mean_length, 6) AS mean_length, round(mean_flags, 6) AS mean_flags, round(fraud_rate, 6) AS fraud_rate, round(psi, 6) AS psi, level, labelled, round({judged('precision')}, 6) AS precision, round({judged('recall')}, 6) AS recall, round({judged('f1')}, 6) AS f1, round({judged('f2')}, 6) AS f2, round({judged(f2d)}, 6) AS f2_drop, round({judged(rd)}, 6) AS recall_drop, array_to_string(al, ',') AS alerts,
        CASE WHEN len(list_filter(al, lambda x: x LIKE 'concept%')) > 0 THEN 'retrain' WHEN level = 'critical' THEN 'investigate' WHEN level = 'warning' THEN 'watch' ELSE 'none' END AS advice FROM al_"""


SQL["drift_reports"] = _report_sql()
SQL["text_denoised"] = _denoised_sql()
SQL |= {"time_marks": _date_sql(), "m1_canonical": _m1_sql()}
SQL |= {
    "first_standards": "WITH k(chunk_id, hay, position) AS (VALUES " + ", ".join(f"({q(s[0])}, {q(' '.join(s[1:4]).lower())}, {i})" for i, s in enumerate(lx.STANDARDS)) + f"), r AS (SELECT DISTINCT id, {ws_tokens('lower(coalesce(standard_ref[1], ' + q('') + '))')} AS w FROM m1_records WHERE id IS NOT NULL), h AS (SELECT r.id, min_by(k.chunk_id, k.position) AS c FROM r JOIN k ON len(list_filter(r.w, lambda x: contains(k.hay, x))) > 0 GROUP BY 1) SELECT r.id, coalesce(h.c, {q(lx.STANDARDS[0][0])}) AS chunk_id FROM r LEFT JOIN h ON r.id = h.id",
    "leave_one_out": f"""WITH {DOCS}, k AS (SELECT doc_id, t, (regexp_extract_all(t, '[A-Za-zÀ-ỹ0-9_]+'))[1:12] AS w FROM docs), u AS (SELECT doc_id, t, w, unnest(range(1, len(w) + 1)) AS i FROM k),
        s AS (SELECT doc_id, i, w[i] AS term, least(1.0::DOUBLE, length(regexp_replace(t, '[^0-9]', '', 'g')) / 20.0::DOUBLE) - least(1.0::DOUBLE, length(regexp_replace(array_to_string(list_filter(w, lambda x, j: j <> i), ' '), '[^0-9]', '', 'g')) / 20.0::DOUBLE) AS contribution FROM u),
        o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(abs(contribution), 9) DESC, i) AS rank FROM s) SELECT doc_id, term, round(contribution, 6) AS contribution, rank FROM o WHERE rank <= 5""",
}
SQL["metadata_features"], SQL["linguistic_features"], SQL["drift_by_month"] = _feature_sql(), _linguistic_sql(), _drift_sql()
SQL = {k: v for k, v in SQL.items() if v}

from veriscope.plans import sql_documents  # noqa: E402

SQL |= sql_documents.SQL
