"""DuckDB SQL of the document and audit queries, from literal lists of its own."""

from __future__ import annotations

from veriscope.plans import sql as base

WS = base.WS
GAP = "[,." + WS[1:-1] + "]+"


def words(text: str) -> str:
    return f"{WS}*".join(text.split())


def one(*texts: str) -> str:
    return "(?:" + "|".join(map(words, texts)) + ")"


def found(t: str, *patterns: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({t}, {base.q('(?i)' + p)})" for p in patterns) + ")"


def caught(t: str, pattern: str, group: int = 1) -> str:
    return f"nullif({base.strip(f'regexp_extract({t}, {base.q(chr(40) + "?im" + chr(41) + pattern)}, {group})')}, '')"


def _names() -> str:
    made = {
        "hoa\\s*hồng\\s*(?:lớn|": ("hoa hồng lớn", "hoa hồng cao", "hoa hồng bất thường"), "chi\\s*phí\\s*không\\s*": ("chi phí không rõ nguồn gốc",), "quà\\s*biếu": ("quà biếu",),
        "chi\\s*phí\\s*tiếp\\s*k": ("chi phí tiếp khách lớn", "chi phí tiếp khách bất thường"), "related\\s*party\\s*tr": ("related party transaction",), "(?:không|chưa)\\s*có\\": ("không có chứng từ", "chưa có chứng từ"),
        "hóa\\s*đơn\\s*giả": ("hóa đơn giả",), "doanh\\s*thu\\s*khống": ("doanh thu khống",), "gian\\s*lận": ("gian lận",), "gian\\s*dối": ("gian dối",), "làm\\s*giả": ("làm giả",),
    }
    rounds = "len(list_filter(regexp_extract_all(t, '\\b(\\d+)(?:,000){2,}\\b', 1), lambda x: x LIKE '%000'))"
    cases = [f"CASE WHEN {rounds} > 5 THEN 'so_tien_tron_bat_thuong_' || {rounds} || '_lan' END"]
    cases += [f"CASE WHEN {found('t', one(*v))} THEN {base.q('tu_khoa_' + k)} END" for k, v in made.items()]
    cases.append(f"CASE WHEN {found('t', one('related party', 'bên liên quan'))} THEN 'co_giao_dich_ben_lien_quan' END")
    return f"list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL)"


OPINION = found("t", one("ý kiến ngoại trừ", "ý kiến trái ngược", "từ chối ý kiến", "từ chối đưa ra ý kiến", "ý kiến có điều kiện", "ý kiến chấp nhận có điều kiện"), words("kiểm toán viên") + ".{0,60}" + words("không chấp nhận"))


def _amount(groups: list[tuple[str, ...] | int], signed: bool) -> str:
    digits = r"\d{1,3}(?:" + GAP + r"\d{3}){2,}"
    figure = rf"(\(?{digits}\)?)" if signed else f"({digits})"
    tries = []
    for g in groups:
        head = rf"\b(?:{words('ma so')}{WS}*)?{g}\b" if isinstance(g, int) else one(*g)
        tries.append(caught("g", rf"{head}[^\n]*?[^0-9]{{0,{80 if isinstance(g, int) else 120}}}?{figure}"))
    return f"coalesce({', '.join(tries)})"


def _number(raw: str) -> str:
    return f"(CASE WHEN {raw} LIKE '(%)' THEN -1 ELSE 1 END) * TRY_CAST(regexp_replace({raw}, '[^0-9]', '', 'g') AS DOUBLE)"


def _parsed() -> str:
    heads = {"bang_cdkt": ("bang can doi ke toan", "balance sheet", "b 01"), "kqkd": ("ket qua hoat dong", "kq hdkd", "income statement", "b 02"), "lctt": ("luu chuyen tien te", "cash flow", "b 03"), "thuyet_minh": ("thuyet minh", "note to the", "notes to the", "b 09")}
    parts = ", ".join(f"CASE WHEN {found('g', one(*v))} THEN '{k}' END" for k, v in heads.items())
    fields = {
        "doanh_thu": ([("doanh thu thuan", "doanh thu ban hang", "doanh thu hoat dong"), ("net revenue",), ("revenue from sales",)], False),
        "loi_nhuan_truoc_thue": ([("loi nhuan truoc thue", "loi nhuan ke toan truoc thue"), ("accounting profit before tax",), 50], True),
        "loi_nhuan_sau_thue": ([("loi nhuan sau thue",), ("profit after tax",), 60], True),
        "tong_tai_san": ([("tai san",), ("total assets",), 270], False),
        "von_chu_so_huu": ([("von chu so huu",), ("equity",), 400], False),
        "tien_va_tuong_duong": ([("tien va cac khoan tuong duong",), ("cash and cash equivalents",), 110], False),
    }
    amounts = ", ".join(f"{_amount(*v)} AS {k}_raw" for k, v in fields.items())
    quarter = rf"{one('quy', 'qui', 'quarter', 'q')}{WS}*(\d){WS}*(?:{one('nam', 'year')})?{WS}*(\d{{4}})"
    period = f"coalesce({caught('g', quarter)} || ' ' || {caught('g', quarter, 2)}, {caught('g', one('nam tai chinh', 'nam', 'year') + WS + r'+(\d{4})')}, {caught('g', one('ket thuc ngay', 'cho ky ke') + r'[^\n]*?(\d{4})')})"
    company = rf"(?:^|\n){words('cong ty')}{WS}+(?:{one('cp', 'tnhh', 'co phan', 'cong ty')})?{WS}*(.{{5,120}}?)(?:\n|{one('mst', 'ma so', 'dia')}|$)"
    english = f"nullif({base.strip(f'regexp_extract(t, {base.q("(?m)^([A-Z][A-Z&,." + WS[1:-1] + "]{10,120}" + one("COMPANY", "JSC", "CORPORATION", "CO., LTD", "CO LTD").replace(".", chr(92) + ".") + ")")}, 1)')}, '')"
    provision = f"regexp_extract(t, {base.q('(?i)' + words('dự phòng') + '.{0,50}([0-9.]{8,})')}, 1)"
    value = f"TRY_CAST(list_reduce(string_split({provision}, '.'), lambda a, x: CASE WHEN regexp_full_match(x, '[0-9]{{3}}') THEN a || x ELSE a || '.' || x END) AS DOUBLE)"
    distress = f"""list_filter([CASE WHEN doanh_thu_num > 0 AND loi_nhuan_sau_thue_num < 0 AND abs(loi_nhuan_sau_thue_num) / doanh_thu_num > 0.3 THEN 'lo_nang_' || printf('%.1f', abs(loi_nhuan_sau_thue_num) / doanh_thu_num * 100) || '%_doanh_thu' END,
        CASE WHEN {found('t', 'lỗ.{0,20}' + one('liên tiếp', 'nhiều quý', 'kéo dài'))} THEN 'lo_lien_tiep' END, CASE WHEN doanh_thu_num > 0 AND {value} / doanh_thu_num > 0.1 THEN 'du_phong_lon_hon_10pct_dt' END], lambda x: x IS NOT NULL)"""
    return f"""WITH {base.DOCS}, c AS (SELECT doc_id, t AS raw, {base.denoise('nfc_normalize(t)')} AS t FROM docs), g AS (SELECT *, replace(strip_accents(lower(t)), 'đ', 'd') AS g, {base.terms('t')} AS k, {_names()} AS f FROM c),
        a AS (SELECT *, {amounts} FROM g), n AS (SELECT *, {_number('doanh_thu_raw')} AS doanh_thu_num, {_number('loi_nhuan_sau_thue_raw')} AS loi_nhuan_sau_thue_num, {base.quality('t', 'k')} AS ocr_quality FROM a)
        SELECT doc_id, greatest(1, len(regexp_extract_all(raw, '(?i)-{{2,}}[ \\t]*TRANG[ \\t]*\\d+[ \\t]*-{{2,}}'))) AS pages, coalesce(nullif(array_to_string(list_sort(list_filter([{parts}], lambda x: x IS NOT NULL)), ','), ''), 'full_text') AS sections,
        {base.collapse(f"coalesce({caught('g', company)}, {base.accents(english)})")} AS ten_cong_ty, {period} AS ky_bao_cao_raw, {', '.join(f'{k}_raw' for k in fields)}, doanh_thu_num, loi_nhuan_sau_thue_num, round(ocr_quality, 6) AS ocr_quality,
        array_to_string(f, ',') AS fraud_signals, array_to_string({distress}, ',') AS distress_signals, CASE WHEN {OPINION} OR len(f) > 0 THEN 1 ELSE 0 END AS auto_label, ocr_quality < 0.5 OR len(f) > 0 AS suggested_review, length(t) AS char_count FROM n"""


# A mark before every number that no digit precedes stands in for looking back; the character after a match may be the one
# before the next mark, but never the mark.
MARKED = r"regexp_replace({t}, '([^0-9+])(\+?[0-9])', '\1§\2', 'g')"
PHONE = "len(regexp_extract_all(" + MARKED + r", '(?:^|§)(?:\+?84|0)(?:[0-9][\t\n\x0B\f\r .-]?§?){{8,10}}(?:[^0-9]|$)'))"
LONG_ID = "len(list_filter(regexp_extract_all({t}, '[0-9]+'), lambda x: length(x) BETWEEN 10 AND 14))"
EMAIL = "len(regexp_extract_all({t}, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}'))"
# the numerical tail of the chi-square distribution: 1 less the integral of its density in the root of the statistic
TAIL = "CASE WHEN statistic = 0 THEN 1.0::DOUBLE ELSE 1 - 2 * list_sum(list_transform(range(0, 2000), lambda i: exp(-power(sqrt(statistic) * (i + 0.5::DOUBLE) / 2000, 2) / 2) / sqrt(2 * pi()) * sqrt(statistic) / 2000)) END"


def _governance() -> str:
    t = "coalesce(text, '')"
    share = lambda f: f"avg(CASE WHEN trim(coalesce({f}::VARCHAR, '')) <> '' THEN 1.0::DOUBLE ELSE 0 END)"
    fields = ["source", "doc_id", "version", "collected_at", "anonymized", "privacy_reviewed"]
    return f"""WITH a AS (SELECT count(*) AS total, count(label) AS labels, sum(CASE WHEN label > 0 THEN 1 ELSE 0 END)::BIGINT AS fraud, sum({EMAIL.format(t=t)})::BIGINT AS pii_email, sum({PHONE.format(t=t)})::BIGINT AS pii_phone, sum({LONG_ID.format(t=t)})::BIGINT AS pii_long_id,
        {', '.join(f'{share(f)} AS coverage_{f}' for f in fields)}, count(*) - count(DISTINCT {t}) AS duplicates FROM mini_samples),
        b AS (SELECT *, fraud / greatest(total, 1)::DOUBLE AS fraud_ratio, least(fraud, total - fraud) / greatest(total, 1)::DOUBLE AS minority_ratio, pii_email + pii_phone + pii_long_id = 0 AS clean FROM a)
        SELECT * EXCLUDE (clean), CASE WHEN coverage_source >= 0.5 OR coverage_doc_id >= 0.5 THEN 'ok' ELSE 'warning' END AS step_1, CASE WHEN clean THEN 'ok' ELSE 'warning' END AS step_2, CASE WHEN total > 0 THEN 'ok' ELSE 'warning' END AS step_3,
        total > 0 AND labels = total AND duplicates / greatest(total, 1)::DOUBLE <= 0.1 AND clean AND minority_ratio >= 0.1 AS ready FROM b"""


def _manifest() -> str:
    return f"""WITH m AS ({base.SQL['time_marks']}), n AS (SELECT m.*, label, row_number() OVER (ORDER BY m.date NULLS FIRST, sample_id) - 1 AS i, count(*) OVER () AS n FROM m JOIN mini_samples USING (sample_id)),
        s AS (SELECT *, CASE WHEN i < floor(n * 0.8) THEN 'train' WHEN i < floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split FROM n)
        SELECT split, count(*) AS total, sum(CASE WHEN label > 0 THEN 1 ELSE 0 END)::BIGINT AS fraud, sum(CASE WHEN label <= 0 THEN 1 ELSE 0 END)::BIGINT AS non_fraud, round(avg(CASE WHEN label > 0 THEN 1.0::DOUBLE WHEN label IS NOT NULL THEN 0 END), 4) AS fraud_ratio, round(avg(CASE WHEN known THEN 1.0::DOUBLE ELSE 0 END), 4) AS known_ratio, min(CASE WHEN known THEN date END) AS start, max(CASE WHEN known THEN date END) AS "end" FROM s GROUP BY split"""


KB = f"""kb AS (SELECT DISTINCT ON (chunk_id) chunk_id, trim(coalesce(source, '')) AS source, trim(coalesce(article, '')) AS article, trim(coalesce(title, '')) AS title, {base.strip("coalesce(text, '')")} AS text, chunk_index, total_chunks FROM kb_chunks WHERE chunk_id IS NOT NULL AND {base.strip("coalesce(text, '')")} <> '' ORDER BY chunk_id)"""
SEARCH = f"""{KB}, d AS (SELECT chunk_id, {base.words('text')} AS k FROM kb), l AS (SELECT chunk_id, k, len(k) AS len FROM d), s AS (SELECT count(*) AS n, avg(len) AS avgl FROM l),
        qt AS (SELECT item_id, unnest(list_distinct({base.words("coalesce(text, '')")})) AS term FROM eval_items WHERE item_id % 20 = 0), tf AS (SELECT chunk_id, len, term, count(*) AS tf FROM (SELECT chunk_id, len, unnest(k) AS term FROM l) WHERE term IN (SELECT term FROM qt) GROUP BY 1, 2, 3), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
        w AS (SELECT chunk_id, term, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avgl)) AS w FROM tf JOIN df USING (term), s),
        o AS (SELECT item_id, chunk_id, sum(w) AS score FROM qt JOIN w USING (term) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM o)"""
FEATURES = "log_char_len length,log_token_count length,avg_token_len length,ocr_quality quality,digit_ratio quality,uppercase_ratio quality,newline_density quality,red_flag_count rules,suspicious_segment_count rules,english_keyword_ratio language,has_related_party risk,has_invoice_risk risk,has_cashflow_risk risk,has_off_balance_risk risk,financial_term_density_vn finance,financial_term_density_en finance,round_number_ratio finance,accounting_code_count finance,loss_keyword_count finance,abnormal_profit_signal finance"
BOOSTED = f"{base.EVENTS}, x AS (SELECT *, least(1.0::DOUBLE, greatest(0.0::DOUBLE, fraud_prob) + 0.05::DOUBLE * len(coalesce(red_flags, []))) AS h FROM ev WHERE fraud_prob IS NOT NULL)"
SYSTEM = "Bạn hỗ trợ kiểm toán báo cáo tài chính. Dựa vào đoạn văn được cung cấp, trả về một đối tượng JSON gồm các trường label, risk_level, standard_ref, finding và confidence; không suy đoán khi thiếu bằng chứng."


def _layers() -> str:
    one = lambda c: f"SELECT round(auc_roc, 6) AS auc_roc, round(coalesce(ap, 0), 6) AS auprc, round({base._fb(2)}, 6) AS f2 FROM (WITH {base.evaluate('x', [], 'true_label', c, '0.5')} SELECT * FROM e, a)"
    return f"""WITH {BOOSTED}, p AS ({one('fraud_prob')}), q AS ({one('h')}), z AS (SELECT count(*) AS n, round(avg(abs(h - fraud_prob)), 6) AS mean_shift, round(max(abs(h - fraud_prob)), 6) AS max_shift, sum(CASE WHEN (fraud_prob >= 0.5) <> (h >= 0.5) THEN 1 ELSE 0 END)::BIGINT AS changed FROM x WHERE true_label IS NOT NULL)
        SELECT z.*, p.auc_roc AS raw_auc_roc, p.auprc AS raw_auprc, p.f2 AS raw_f2, q.auc_roc AS hybrid_auc_roc, q.auprc AS hybrid_auprc, q.f2 AS hybrid_f2 FROM z, p, q"""


def _positives() -> str:
    """The records by id, the first reference of each, given or else inferred, and the first standard that holds a word of it."""
    label = "CASE WHEN upper(trim(label)) IN ('BINH_THUONG', 'CANH_BAO', 'VI_PHAM', 'KHONG') THEN upper(trim(label)) WHEN upper(trim(label)) IN ('1', 'RISK', 'HIGH_RISK') OR TRY_CAST(upper(trim(label)) AS INT) > 0 THEN 'CANH_BAO' ELSE 'BINH_THUONG' END"
    hit = lambda *ws: "(" + " OR ".join(f"contains(k, '{w}')" for w in ws) + ")"
    inferred = f"CASE WHEN {hit('du_phong', 'du phong', 'kho_doi', 'no_phai_thu')} THEN 'TT48/2019 Dieu 6' WHEN {hit('doanh_thu', 'doanh thu', 'hoa_don', 'hoa don')} THEN 'VAS 14' WHEN {hit('ben_lien_quan', 'ngoai_bang', 'che_giau')} OR {label} <> 'BINH_THUONG' THEN 'VAS 01' END"
    rows = ", ".join(f"({base.q(r[0])}, {base.q(' '.join(r[1:4]).lower())}, {base.q(r[4])}, {i})" for i, r in enumerate(base.lx.STANDARDS))
    return f"""c(chunk_id, hay, passage, position) AS (VALUES {rows}), m AS (SELECT DISTINCT ON (id) id, coalesce(text, '') AS text, label, standard_ref, array_to_string({base.terms("coalesce(text, '')")}, ' ') AS k FROM m1_records WHERE id IS NOT NULL),
        f AS (SELECT id, text, CASE WHEN len(coalesce(standard_ref, [])) > 0 THEN standard_ref[1] ELSE {inferred} END AS ref FROM m), g AS (SELECT id, text, {base.ws_tokens("lower(coalesce(ref, ''))")} AS w FROM f),
        h AS (SELECT g.id, min_by(c.chunk_id, c.position) AS own FROM g JOIN c ON len(list_filter(g.w, lambda x: contains(c.hay, x))) > 0 GROUP BY 1), p AS (SELECT g.id, g.text, coalesce(h.own, (SELECT chunk_id FROM c WHERE position = 0)) AS own FROM g LEFT JOIN h ON g.id = h.id),
        n AS (SELECT p.id, c.chunk_id, row_number() OVER (PARTITION BY p.id ORDER BY md5(p.id || ':' || c.chunk_id || ':42')) - 1 AS position FROM p JOIN c ON c.chunk_id <> p.own)"""


COMMAS = "(length(c) - length(replace(c, ',', '')))"
WINDOWS = f"s AS (SELECT doc_id, {base.strip('t')} AS s FROM docs), w AS (SELECT doc_id, unnest(generate_series(0, greatest(ceil((length(s) - 120) / 648.0::DOUBLE) - 1, 0)::BIGINT)) AS i, s FROM s), p AS (SELECT doc_id, i, {base.strip('substring(s, (i * 648 + 1)::BIGINT, 768)')} AS c FROM w)"
RULES = """(VALUES ('R001', 'Khong trich du phong no kho doi', 'TT48/2019 Dieu 6', 'du phong.{0,30}(0 dong|khong co|chua trich)', 'no phai thu|khoan phai thu|kho doi', 'CANH_BAO', 'CAO'),
    ('R002', 'Doanh thu ghi nhan sai ky', 'VAS 14', 'ghi nhan doanh thu.{0,50}(truoc|sai ky|khong du dieu kien)', 'doanh thu|hop dong|hoa don', 'VI_PHAM', 'CAO'),
    ('R003', 'Rui ro ben lien quan hoac ngoai bang', 'VAS 01', 'ben lien quan|ngoai bang can doi|che giau no', 'thuyet minh|giao dich|no phai tra', 'CANH_BAO', 'TRUNG_BINH'))"""
STANDARDS = "(VALUES ('TT48/2019', '(du phong).{0,50}(no phai thu|khoan phai thu)'), ('VAS14', 'ghi nhan doanh thu.{0,80}(sai ky|truoc|khong du dieu kien)'), ('VAS01', 'ben lien quan|ngoai bang can doi|che giau'))"
SAMPLES = f"x AS (SELECT sample_id, {base.fold("coalesce(text, '')")} AS f FROM mini_samples)"
VECTOR = [x.split(" ")[0] for x in FEATURES.split(",")]


def _accounting(raw: str) -> str:
    """Brackets and a leading minus are negative; a point or comma before three digits and no more groups, a comma else is decimal."""
    bare = f"regexp_replace(regexp_replace({raw}, '[()]', '', 'g'), '^-+', '')"
    # no look-ahead: each part between marks keeps its mark unless it is of three digits
    marked = f"regexp_replace({bare}, '([.,])', '|\\1', 'g')"
    joined = f"list_reduce(string_split({marked}, '|'), lambda a, x: CASE WHEN regexp_full_match(x, '[.,][0-9]{{3}}') THEN a || x[2:] ELSE a || x END)"
    return f"(CASE WHEN ({raw} LIKE '(%' AND {raw} LIKE '%)') OR {raw} LIKE '-%' THEN -1 ELSE 1 END) * TRY_CAST(replace({joined}, ',', '.') AS DOUBLE)"


SQL: dict[str, str] = {
    "builder_tfidf": f"""WITH x AS (SELECT DISTINCT ON (id) id, split, list_filter({base.words("coalesce(text, '')")}, lambda t: length(t) >= 2) AS k FROM m1_records WHERE id IS NOT NULL), tf AS (SELECT id, split, term, count(*) AS tf FROM (SELECT id, split, unnest(k) AS term FROM x) GROUP BY 1, 2, 3), n AS (SELECT count(*) AS n FROM x WHERE split = 'train'),
        v AS (SELECT term, count(*) AS df FROM tf WHERE split = 'train' GROUP BY 1 ORDER BY sum(tf) DESC, term LIMIT 5000), w AS (SELECT id, term, tf * (ln((1.0::DOUBLE + n) / (1.0::DOUBLE + df)) + 1) AS w FROM tf JOIN v USING (term), n WHERE split = 'test') SELECT id, term, round(round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 8), 6) AS weight FROM w""",
    "declared_rules": f"WITH {SAMPLES}, r(rule_id, name, standard, trig, ctx, label, risk) AS {RULES} SELECT sample_id, rule_id, standard, label, risk FROM x JOIN r ON regexp_matches(f, trig) AND regexp_matches(f, ctx)",
    "standard_matches": f"WITH {SAMPLES}, r(standard, p) AS {STANDARDS} SELECT sample_id, standard FROM x JOIN r ON regexp_matches(f, p)",
    "rule_table": f"WITH r(rule_id, name, standard, \"trigger\", context, label, risk) AS {RULES} SELECT * FROM r",
    "feature_vectors": f"WITH m AS ({base.SQL['metadata_features']}), v AS (SELECT doc_id, [{', '.join(f'{n}::DOUBLE' for n in VECTOR)}] AS v FROM m), u AS (SELECT doc_id, unnest(v) AS value, generate_subscripts(v, 1) - 1 AS position FROM v) SELECT doc_id, position, value FROM u WHERE value <> 0",
    "bias_flags": f"WITH m AS ({base.SQL['metadata_features']}) SELECT doc_id, array_to_string(list_filter([CASE WHEN ocr_quality < 0.55 THEN 'low_ocr_quality' END, CASE WHEN digit_ratio > 0.12 THEN 'digit_heavy_text' END, CASE WHEN log_char_len <= 5 THEN 'short_text' END, CASE WHEN red_flag_count >= 2 THEN 'many_rule_flags' END, CASE WHEN english_keyword_ratio > 0.08 THEN 'english_heavy_text' END], lambda x: x IS NOT NULL), ',') AS flags FROM m",
    "score_breakdown": f"WITH {base.EVENTS}, x AS (SELECT event_id, coalesce(CASE WHEN event_id % 3 > 0 THEN sqrt(fraud_prob) END, fraud_prob) AS b, event_id % 3 > 0 AS hy, len(coalesce(red_flags, [])) AS n, coalesce(threshold_used, 0.5) AS th FROM ev WHERE fraud_prob IS NOT NULL), y AS (SELECT *, least(1.0::DOUBLE, greatest(0.0::DOUBLE, b) + 0.05::DOUBLE * n) AS f FROM x) SELECT event_id, round(b, 6) AS hybrid_metadata_score, round(f, 6) AS final_score, round(f - b, 6) AS rule_increment, (f >= th)::INT AS predicted_label, CASE WHEN n > 0 THEN 'rule_based_postprocessing' WHEN hy THEN 'hybrid_metadata_head' ELSE 'raw_model' END AS decision_layer FROM y",
    "accounting_numbers": f"WITH {base.DOCS}, x AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(t, '\\(?-?[0-9][0-9.,]*[0-9]\\)?')) AS raw FROM docs), v AS (SELECT doc_id, raw, {_accounting('raw')} AS value FROM x) SELECT * FROM v WHERE value IS NOT NULL",
    "lexical_tokens": f"WITH {base.DOCS} SELECT doc_id, md5(array_to_string({base.ws_tokens('lower(t)')}, ' ')) AS tokens FROM docs",
    "split_strategy": f"SELECT CASE WHEN avg(CASE WHEN known THEN 1.0 ELSE 0 END) >= 0.5 AND count(DISTINCT CASE WHEN known THEN year END) >= 2 THEN 'temporal' ELSE 'random' END AS strategy FROM ({base.SQL['time_marks']})",
    "folder_summary": f"WITH {base.DOCS}, f AS (SELECT {base.fold('t')} AS f FROM docs), x AS (SELECT f = '' AS bad, least(1.0::DOUBLE, 0.42::DOUBLE + 0.05::DOUBLE * len({base.flags('f')})) AS s FROM f) SELECT count(*) AS documents, sum(bad::INT)::BIGINT AS failed, sum((NOT bad AND s >= 0.75)::INT)::BIGINT AS high, sum((NOT bad AND s >= 0.45 AND s < 0.75)::INT)::BIGINT AS medium, sum((NOT bad AND s < 0.45)::INT)::BIGINT AS low FROM x",
    "drift_alerts": f"SELECT model, unnest(string_split(alerts, ',')) AS alert, level FROM ({base.SQL['drift_reports']}) WHERE alerts <> ''",
    "best_chunks": f"WITH {base.DOCS}, {WINDOWS}, o AS (SELECT doc_id, c, row_number() OVER (PARTITION BY doc_id ORDER BY {COMMAS} DESC, i) AS k FROM p WHERE c <> '') SELECT doc_id, md5(c) AS chunk FROM o WHERE k = 1",
    "embedding_triples": f"WITH {_positives()} SELECT p.id, p.text AS query, a.passage AS positive, b.passage AS negative FROM p JOIN c a ON p.own = a.chunk_id JOIN n ON n.id = p.id AND n.position = 0 JOIN c b ON n.chunk_id = b.chunk_id",
    "hard_negatives": f"WITH {_positives()} SELECT id, chunk_id, position FROM n WHERE position < 3",
    "retrieval_sets": f"WITH {_positives()} SELECT p.id, p.text AS query, c.passage, 1 AS label FROM p JOIN c ON p.own = c.chunk_id UNION ALL SELECT n.id, p.text, c.passage, 0 FROM n JOIN c USING (chunk_id) JOIN p ON n.id = p.id WHERE n.position < 3",
    "parsed_documents": _parsed(),
    "fraud_signals": f"WITH {base.DOCS}, f AS (SELECT doc_id, t, {_names()} AS f FROM docs) SELECT doc_id, array_to_string(f, ',') AS signals, CASE WHEN {OPINION} OR len(f) > 0 THEN 1 ELSE 0 END AS label FROM f",
    "pii_ids": f"WITH {base.DOCS} SELECT doc_id, {LONG_ID.format(t='t')} AS long_ids FROM docs",
    "pii_scan": f"WITH {base.DOCS} SELECT doc_id, {EMAIL.format(t='t')} AS email, {PHONE.format(t='t')} AS phone, {LONG_ID.format(t='t')} AS long_id FROM docs",
    "governance_steps": _governance(),
    "temporal_manifest": _manifest(),
    "mcnemar_pairs": f"SELECT *, round({TAIL}, 6) AS p_value FROM ({base.SQL['mcnemar_pairs']})",
    "both_layers": _layers(),
    "changed_decisions": f"WITH {BOOSTED} SELECT event_id, round(fraud_prob, 6) AS fraud_prob, round(h, 6) AS h FROM x WHERE (fraud_prob >= 0.5) <> (h >= 0.5) ORDER BY event_id LIMIT 10",
    "feature_schema": "SELECT i::INT AS position, split_part(x, ' ', 1) AS name, split_part(x, ' ', 2) AS \"group\", 'double' AS dtype FROM (SELECT unnest(string_split('" + FEATURES + "', ',')) AS x, generate_subscripts(string_split('" + FEATURES + "', ','), 1) - 1 AS i)",
    "explanation_terms": f"WITH {base.DOCS}, k AS (SELECT doc_id, unnest(list_distinct({base.ws_tokens('lower(t)')})) AS term FROM docs) SELECT doc_id, count(*) AS terms, min(term) AS first, max(term) AS last FROM k WHERE length(term) BETWEEN 2 AND 30 AND regexp_matches(term, '[\\p{{L}}]') AND NOT contains(term, '@@') GROUP BY 1",
    "knowledge_base": f"WITH {KB} SELECT chunk_id, source, article, title, md5(text) AS text, chunk_index, total_chunks FROM kb",
    "kb_search": f"WITH {SEARCH} SELECT item_id, chunk_id, round(score, 5) AS score, rank FROM r WHERE rank <= 5",
    "prompt_rows": f"WITH {SEARCH}, c AS (SELECT item_id, string_agg(title, chr(10) ORDER BY rank, title) AS c FROM r JOIN kb USING (chunk_id) WHERE rank <= 5 GROUP BY 1) SELECT e.item_id, md5('Đoạn văn:' || chr(10) || coalesce(text, '') || chr(10) || chr(10) || 'Chuẩn mực liên quan:' || chr(10) || coalesce(c, '')) AS \"user\", label AS gold_label, length(coalesce(text, '')) AS char_count FROM eval_items e LEFT JOIN c ON e.item_id = c.item_id WHERE e.item_id % 20 = 0",
    "encoder_rows": f"SELECT sample_id, 0 AS part, md5(t) AS text, label AS label_int, split FROM (SELECT sample_id, label, split, {base.strip("coalesce(text, '')")} AS t FROM mini_samples WHERE label IS NOT NULL AND split IS NOT NULL) WHERE t <> ''",
    "chat_rows": f"""WITH m AS ({base.SQL['m1_canonical']}), x AS (SELECT id, min(text) AS text FROM m1_records GROUP BY 1) SELECT m.id, to_json([{{'role': 'system', 'content': {base.q(SYSTEM)}}}, {{'role': 'user', 'content': coalesce(x.text, '')}}, {{'role': 'assistant', 'content': to_json({{'label': label, 'risk_level': risk_level, 'standard_ref': standard_ref, 'finding': finding, 'confidence': CASE WHEN label = 'BINH_THUONG' THEN 0.82::DOUBLE ELSE 0.76::DOUBLE END}})::VARCHAR}}])::VARCHAR AS messages FROM m JOIN x ON m.id = x.id""",
}
