"""DuckDB SQL of the queries that SQL can express over whole tables."""

_SPACE = r"[\t\n\x0B\f\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _wide_digits(t: str) -> str:
    return f"translate({t}, '０１２３４５６７８９', '0123456789')"


def _company(t: str) -> str:
    return f"CASE WHEN regexp_matches(upper(trim({_wide_digits(t)})), '^CTY[\\W_]*ANON[\\W_]*[0-9]+$') THEN 'CTY_ANON_' || lpad((regexp_extract({_wide_digits(t)}, '([0-9]+)\\s*$', 1)::BIGINT)::VARCHAR, 7, '0') END"


_GROUPS = f"""WITH RECURSIVE tick AS (SELECT t, c FROM (SELECT t, c, row_number() OVER (PARTITION BY t ORDER BY age, c) AS k FROM (SELECT upper(trim(ticker)) AS t, company_id AS c, 0 AS age FROM companies UNION ALL SELECT upper(trim(former_ticker)), company_id, 1 FROM companies) WHERE t <> '') WHERE k = 1),
    named AS (SELECT DISTINCT r.id, coalesce({_company('r.company_id')}, tick.c) AS company, CASE WHEN regexp_matches(trim(lower(r.source)), '\\.[a-z0-9]{{1,5}}$') THEN 'file:' || regexp_extract(trim(lower(r.source)), '([^/\\\\]*)$', 1) END AS file FROM m1_records r LEFT JOIN tick ON upper(trim(r.company_id)) = tick.t WHERE r.id IS NOT NULL),
    ent AS (SELECT id, company AS e FROM named WHERE company IS NOT NULL UNION SELECT id, file FROM named WHERE file IS NOT NULL),
    edge AS (SELECT DISTINCT a.e AS u, b.e AS v FROM ent a JOIN ent b ON a.id = b.id),
    reach(u, v) AS (SELECT u, v FROM edge UNION SELECT r.u, e.v FROM reach r JOIN edge e ON r.v = e.u),
    lab AS (SELECT u, min(v) AS g FROM reach GROUP BY u), member AS (SELECT DISTINCT ent.id, lab.g FROM ent JOIN lab ON ent.e = lab.u),
    size AS (SELECT g, count(*) AS n FROM member GROUP BY g)"""


def _folded(t: str) -> str:
    return f"replace(strip_accents(lower({t})), 'đ', 'd')"


def _spans(table: str, key: str, where: str = "") -> str:
    """Sequences of twelve words and the place of each."""
    return f"""(SELECT {key}, i, array_to_string(w[i : i + 11], ' ') AS s FROM (SELECT {key}, w, unnest(range(1, greatest(len(w) - 10, 1))) AS i FROM (SELECT {key}, regexp_extract_all({_folded("coalesce(text, '')")}, '[\\p{{L}}\\p{{N}}]+') AS w FROM {table})) {where})"""


SQL: dict[str, str] = {
    "p3_found": f"{_GROUPS} SELECT member.id, CASE WHEN member.g NOT LIKE 'file:%' THEN member.g END AS group_company FROM member JOIN size ON member.g = size.g WHERE n > 1",
    "p5_found": f"SELECT chunk_id FROM kb_chunks WHERE text IS NOT NULL AND chunk_size_tokens IS NOT NULL AND len(list_filter(regexp_split_to_array(text, '{_SPACE}+'), lambda x: x <> '')) > chunk_size_tokens",
    "p8_leaks": f"WITH m AS (SELECT DISTINCT d.doc_id, e.item_id, d.i, d.i - e.i AS shift FROM {_spans('documents', 'doc_id')} d JOIN {_spans('eval_items', 'item_id')} e ON d.s = e.s), r AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, shift ORDER BY i) AS run FROM m), n AS (SELECT doc_id, item_id, count(*) + 11 AS words FROM r GROUP BY doc_id, item_id, shift, run) SELECT doc_id, item_id, max(words)::INT AS words FROM n GROUP BY 1, 2",
    "p8_found": f"SELECT DISTINCT d.doc_id, e.item_id FROM {_spans('documents', 'doc_id')} d JOIN {_spans('eval_items', 'item_id')} e ON d.s = e.s",
}
