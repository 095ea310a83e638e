"""DuckDB SQL of the same rows, for the training-data queries that SQL can express."""

from __future__ import annotations

from .url_filter import DAMPING, ROUNDS, RULES, THRESHOLD

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_lower = f"translate(%s, '{_UP}', '{_LOW}')"

OP2 = f"""
WITH RECURSIVE w AS (SELECT doc_id, [x FOR x IN string_split_regex({_lower % "coalesce(text, '')"}, '[\\x20\\x09-\\x0D]+') IF x <> ''] AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 4 THEN [array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * n_both >= 80 * (x.n + y.n - n_both)),
both_ways AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS other FROM n UNION SELECT r.doc_id, b FROM r JOIN both_ways ON a = other)
SELECT doc_id, n::BIGINT AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept FROM r JOIN n USING (doc_id) GROUP BY doc_id, n"""

_W = "[x FOR x IN string_split_regex(%s, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') IF x <> '']"
OP6 = f"""
WITH d AS (SELECT doc_id, {_W % (_lower % "coalesce(text, '')")} AS w FROM documents),
b AS (SELECT item_id, {_W % (_lower % "coalesce(text, '')")} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS x FROM b, unnest(range(1, greatest(1, len(w) - 9) + 1)) t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS x FROM d, sizes, unnest(range(1, len(w) - n + 2)) t(i)),
m AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, x)),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM m) GROUP BY doc_id),
items AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM m GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)"""


def _op9() -> str:
    after = "CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END"
    fits = [(v, h + p, f"(host = '{h}' OR suffix(host, '.{h}')) AND starts_with(path, '{p}')") for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))]
    rule = "CASE " + " ".join(f"WHEN {c} THEN '{r}'" for _, r, c in fits) + " END"
    verdict = "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for v, _, c in fits) + " END"
    ctes = [
        f"u0 AS (SELECT page_id, html, coalesce({after}, '') AS a FROM pages)",
        f"u AS (SELECT page_id, html, {_lower % "regexp_extract(a, '^[^/?#]*')"} AS host, regexp_extract(substr(a, length(regexp_extract(a, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u0)",
        f"j AS (SELECT page_id, host, path, {rule} AS rule, {verdict} AS by_rule FROM u)",
        f"l0 AS (SELECT host AS o, {_lower % "unnest(regexp_extract_all(html, '(?i)\\bhref\\s*=\\s*[\"'']?\\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"''\\s>]+)', 1))"} AS t FROM u)",
        "l AS (SELECT o, t, count(*)::DOUBLE AS n FROM l0 WHERE o <> t AND o <> '' GROUP BY o, t)",
        "h AS (SELECT string_split(host, '.') AS p FROM (SELECT host FROM j WHERE host <> '' UNION SELECT t FROM l))",
        "a AS (SELECT DISTINCT array_to_string(p[i:], '.') AS o, array_to_string(p[i + 1:], '.') AS t FROM h, unnest(range(1, len(p) - 1)) r(i))",
        "e AS (SELECT o, t, sum(n) AS n FROM (SELECT o, t, n FROM l UNION ALL SELECT o, t, 1.0::DOUBLE FROM a UNION ALL SELECT t, o, 1.0::DOUBLE FROM a) GROUP BY o, t)",
        "f AS MATERIALIZED (SELECT o, t, n / sum(n) OVER (PARTITION BY o) AS s FROM e)",
        "g AS MATERIALIZED (SELECT t AS o, o AS t, n / sum(n) OVER (PARTITION BY t) AS s FROM e)",
        "seeds AS (SELECT host, avg((by_rule IS NOT DISTINCT FROM 'allow')::INT) AS good, avg((by_rule IS NOT DISTINCT FROM 'block')::INT) AS bad FROM j WHERE host <> '' GROUP BY host)",
        f"t0 AS MATERIALIZED (SELECT host, good * {1 - DAMPING} AS m FROM seeds WHERE good > 0)",
        f"b0 AS MATERIALIZED (SELECT host, bad * {1 - DAMPING} AS m FROM seeds WHERE bad > 0)",
    ]
    for k in range(ROUNDS):
        for x, e in (("t", "f"), ("b", "g")):
            ctes.append(f"{x}{k + 1} AS MATERIALIZED (SELECT host, sum(m) AS m FROM (SELECT host, m FROM {x}0 UNION ALL SELECT {e}.t, {DAMPING} * m * s FROM {x}{k} JOIN {e} ON {e}.o = host) GROUP BY host)")
    ctes.append(f"against AS (SELECT host FROM (SELECT host, m FROM b{ROUNDS} UNION ALL SELECT host, -m FROM t{ROUNDS}) GROUP BY host HAVING round(sum(m), 9) > {THRESHOLD})")
    return f"WITH {', '.join(ctes)} SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN host IN (SELECT host FROM against) THEN 'block' END, 'allow') AS verdict FROM j"


def _op10(control: str) -> str:
    role, text = "coalesce(role, '')", "coalesce(text, '')"
    escaped = lambda c: f"replace(replace({c}, '\\', '\\\\'), '<|', '<\\|')"
    length = f"(12 + length(replace({escaped(role)}, chr(10), '\\n')) + 1 + length({escaped(text)}) + 11)"
    order = "ORDER BY turn NULLS FIRST, role, text"
    return f"""
WITH c AS (SELECT conv_id, turn, {role} AS role, {text} AS text, {length} AS n FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -1, 0, 'user', '{control}' UNION ALL SELECT -1, 1, 'assistant', '{control}'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
sha256(coalesce(string_agg(text, '' {order}) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(n)::BIGINT AS formatted_chars FROM c GROUP BY conv_id"""


OP9 = _op9()


def sql(control: str) -> dict[str, str]:
    return {"op2_minhash_near_dedup": OP2, "op6_suffix_array_decontamination": OP6, "op9_host_trust_urls": OP9, "op10_prefix_tree_chat": _op10(control)}
