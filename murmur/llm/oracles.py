"""DuckDB SQL that gives the same rows as the operators' queries."""

from __future__ import annotations

CHAT_FORMAT = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), escaped AS (
  SELECT *, length(replace(replace(replace(text, '\', '\0'), '<|', '\1'), '|>', '\2')) AS n_text,
    length(replace(replace(replace(role, '\', '\0'), '<|', '\1'), '|>', '\2')) AS n_role,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n_text + CASE WHEN before IS NULL OR before <> role THEN n_role + 20 ELSE 5 END)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""


def url_rules_sql(host_rules: list[tuple[str, str, str]], labels: list[str], segments: list[str], extensions: list[str]) -> str:
    """One pattern for each kind of rule, tried in the rules' order."""
    book = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in host_rules)
    own = [rf"^([^/]*\.)?({'|'.join(labels)})[0-9]*\.[^/]*(/|$)", rf"/({'|'.join(segments)})(/|$)", rf"/[^/]*\.({'|'.join(extensions)})$"]
    hit = " OR ".join(f"regexp_matches(host || path, '(?i){p}')" for p in own)
    return rf"""
WITH rest AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r, row_number() OVER () AS n FROM pages
), parts AS (
  SELECT page_id, n, translate(regexp_extract(r, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest
), book(v, h, p) AS (VALUES {book}), best AS (
  SELECT n, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS v
  FROM parts JOIN book ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY n
)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN {hit} THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN best USING (n)
"""


NEAR_DEDUP = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i + 1:i + 4], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(greatest(len(ws) - 3, 1))) AS i FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS low FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(low, w.doc_id)) AS component_id, w.doc_id = least(w.doc_id, coalesce(low, w.doc_id)) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.a = w.doc_id
"""


def quality_sql(rules: tuple[tuple[str, tuple[float, ...]], ...], alpha: float = 0.02, delta: float = 0.05, cost: float = 1.0) -> str:
    """Figures, base rules and the cutoffs that the exact binomial tail admits."""
    figure = {
        "symbol_share": "n_symbols / greatest(n_words, 1)",
        "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
        "word_length_excess": "abs(word_chars / greatest(n_words, 1) - 5.5)",
    }
    cuts = ", ".join(f"({r}, {c})" for r, (_, own) in enumerate(rules) for c in own)
    total = sum(len(own) for _, own in rules)
    value = "CASE rule " + " ".join(f"WHEN {r} THEN {figure[name]}" for r, (name, _) in enumerate(rules)) + " END"
    p = alpha / len(rules)
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), g AS (SELECT row, i, array_to_string(ws[i + 1:i + 8], ' ') AS gram FROM (SELECT row, ws, unnest(range(len(ws) - 7)) AS i FROM d WHERE len(ws) > 7)),
twice AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, gram) AS c FROM g) WHERE c > 1),
rep AS (SELECT row, count(DISTINCT i + j) AS n FROM twice, (SELECT unnest(range(8)) AS j) GROUP BY row),
f AS (
  SELECT row, doc_id, lang, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM d LEFT JOIN rep USING (row)
), b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f),
cuts(rule, cut) AS (VALUES {cuts}),
known AS (SELECT doc_id, max(quality) AS good FROM labels WHERE quality IN (0, 1) GROUP BY doc_id),
m AS (SELECT lang, rule, cut, count(*) FILTER (good = 1) AS n, count(*) FILTER (good = 1 AND {value} > cut) AS k, count(*) FILTER (good = 0 AND {value} > cut) AS bad FROM b JOIN known USING (doc_id), cuts WHERE NOT base_failed GROUP BY ALL),
z AS (SELECT count(DISTINCT coalesce(lang, chr(0))) AS strata FROM m),
tail AS (SELECT *, CASE WHEN k >= n * {p} THEN 1.0 ELSE list_sum(list_transform(range(k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p}) + (n - i) * ln(1 - {p})))) END AS tail FROM m, z),
chosen AS (SELECT lang, rule, max(struct_pack(gain := bad - {cost} * k, cut := cut)).cut AS cut FROM tail WHERE n > 0 AND tail <= {delta} / (strata * {total}) GROUP BY lang, rule),
gone AS (SELECT DISTINCT row FROM b JOIN chosen ON b.lang IS NOT DISTINCT FROM chosen.lang WHERE {value} > cut)
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND row NOT IN (SELECT row FROM gone) AS kept FROM b
"""


def pii_sql(near: int = 6, reach: int = 120, support: int = 3, generalise: float = 0.9) -> str:
    """Pattern spans by the plain patterns of the contract, and the terms that disclose an entity."""
    term = r"[\p{L}\p{N}]+"
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
        ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"),
        ("card", r"[0-9](?:[ -]?[0-9])+"),
        ("phone", r"\+[0-9][ ().0-9-]+[0-9]"),
        ("secret", r"""(?i)\b(?:password|passwd|token|secret|api[_-]?key) ?[=:] ?["'']?[A-Za-z0-9+/_-]{12,}["'']?"""),
    ]
    digits = "regexp_replace(v, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(length({digits})), lambda i: CASE WHEN i % 2 = 0 THEN substr({digits}, (length({digits}) - i)::INT, 1)::INT ELSE list_value(0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[substr({digits}, (length({digits}) - i)::INT, 1)::INT + 1] END)) % 10 = 0"
    fine = f"""CASE kind WHEN 'ip' THEN list_bool_and(list_transform(string_split(v, '.'), lambda x: length(ltrim(x, '0')) <= 3 AND coalesce(try_cast(right('000' || x, 3) AS INT), 999) <= 255))
      WHEN 'card' THEN length({digits}) BETWEEN 12 AND 19 AND {luhn} WHEN 'phone' THEN length({digits}) BETWEEN 9 AND 15 ELSE true END"""
    matches = " UNION ALL ".join(f"SELECT r, t, {no} AS no, '{kind}' AS kind, regexp_extract_all(t, '{p}') AS ms, string_split_regex(t, '{p}') AS gaps FROM d" for no, (kind, p) in enumerate(kinds))
    entity = f"kind || ':' || CASE WHEN kind IN ('card', 'phone') THEN {digits} ELSE lower(v) END"
    words = lambda x: f"regexp_extract_all(lower({x}), '{term}')"
    told = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, no, e)"
    counts = ", ".join(f"(SELECT count(*) FROM spans x WHERE x.r = d.r AND kind = '{k}')::BIGINT AS n_{k}" for k, _ in kinds[:4])
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({matches}),
u AS (SELECT r, t, no, kind, i, ms[i] AS v, list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS s FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM m WHERE len(ms) > 0)),
spans AS (SELECT r, t, no, kind, v, s::BIGINT AS s, (s + length(v))::BIGINT AS e FROM u WHERE {fine}),
sides AS (
  SELECT r, t, {entity} AS entity,
    CASE WHEN s > {reach} THEN regexp_replace(substr(t, s - {reach}, {reach} + 1), '^{term}', '') ELSE substr(t, 1, s) END AS l,
    CASE WHEN length(t) - e > {reach} THEN regexp_replace(substr(t, e + 1, {reach} + 1), '{term}$', '') ELSE substr(t, e + 1) END AS g
  FROM spans
), mentions AS (
  SELECT DISTINCT r, t, entity, unnest(list_concat(list_reverse({words("l")})[1:{near}], {words("g")}[1:{near}], [NULL])) AS term FROM sides
), ent AS (SELECT entity, count(DISTINCT r) AS ne FROM mentions GROUP BY 1 HAVING count(DISTINCT t) >= {support}),
pairs AS (SELECT entity, term, any_value(ne) AS ne, count(*) AS nte FROM mentions JOIN ent USING (entity) WHERE length(term) > 2 GROUP BY 1, 2 HAVING count(DISTINCT t) >= {support}),
spoken AS (SELECT term, count(*) AS nt FROM (SELECT DISTINCT r, unnest({words("t")}) AS term FROM d) WHERE term IN (SELECT term FROM pairs) GROUP BY 1),
size AS (SELECT count(*) AS n FROM d),
revealing AS (SELECT DISTINCT term FROM pairs JOIN spoken USING (term), size WHERE n > ne AND ln(n * nte / (nt * ne)) / ln(n / ne) >= {generalise}),
w AS (SELECT r, regexp_extract_all(t, '{term}') AS ms, string_split_regex(t, '{term}') AS gaps FROM d WHERE list_has_any({words("t")}, (SELECT coalesce(list(term), []) FROM revealing))),
terms AS (SELECT r, {len(kinds)} AS no, 'term' AS kind, ms[i] AS v, (list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM w)),
every AS (SELECT r, no, kind, s, e FROM spans UNION ALL SELECT r, no, kind, s, s + length(v) FROM terms WHERE lower(v) IN (SELECT term FROM revealing))
SELECT doc_id, {counts},
  sha256(coalesce((SELECT {told} FROM every x WHERE x.r = d.r AND no < 4), '')) AS base_sha256,
  coalesce((SELECT {told} FROM every x WHERE x.r = d.r), '') AS spans
FROM d
"""
