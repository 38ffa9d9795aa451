"""DuckDB SQL of the queries that SQL can express, written apart from the operators."""

from __future__ import annotations

from corpusloom.llm.imatch import IMatchConfig
from corpusloom.llm.queries import URL_RULES
from corpusloom.llm.urls import GraphConfig

_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_MINHASH = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' ')) END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * common >= 80 * (nx.n + ny.n - common)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.reach = e.x),
c AS (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY 1)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)"""


def _urls() -> str:
    cfg = GraphConfig()
    ranked = sorted(URL_RULES, key=lambda r: (-len(r.name), r.name))
    cases = {
        of: " ".join(
            f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{getattr(r, of)}'" for r in ranked
        )
        for of in ("name", "action")
    }
    host = _FOLD.format("regexp_extract(coalesce({}, ''), '://([^/?#]*)', 1)")
    parts = [
        f"u AS (SELECT page_id, html, {host.format('url')} AS host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages)",
        f"j AS (SELECT *, CASE {cases['name']} END AS rule, CASE {cases['action']} END AS action FROM u)",
        """links AS (SELECT host AS src, unnest(regexp_extract_all(coalesce(html, ''), '(?i)href\\s*=\\s*["'']?((?:https?:)?//[^"''\\s>]*)', 1)) AS t FROM u)""",
        f"hl AS (SELECT src, {host.format('CASE WHEN starts_with(t, ' + chr(39) + '//' + chr(39) + ') THEN ' + chr(39) + 'x:' + chr(39) + ' || t ELSE t END')} AS dst FROM links)",
        "le AS (SELECT src, dst, count(*) AS n FROM hl WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY ALL)",
        "edges AS MATERIALIZED (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS w FROM le)",
        "turned AS MATERIALIZED (SELECT dst AS src, src AS dst, w / sum(w) OVER (PARTITION BY dst) AS w FROM edges)",
        "own AS (SELECT host, avg(CASE WHEN action = 'allow' THEN 1.0 ELSE 0 END) AS good, avg(CASE WHEN action = 'block' THEN 1.0 ELSE 0 END) AS bad FROM j GROUP BY 1)",
        "hosts AS MATERIALIZED (SELECT * FROM own UNION ALL SELECT DISTINCT h, 0, 0 FROM (SELECT src AS h FROM edges UNION SELECT dst FROM edges) WHERE h NOT IN (SELECT host FROM own))",
    ]
    for name, seed, links in (("t", "good", "edges"), ("d", "bad", "turned")):
        parts.append(f"{name}s AS (SELECT host, {seed} / coalesce(nullif((SELECT sum({seed}) FROM hosts), 0), 1) AS seed FROM hosts)")
        parts.append(f"{name}0 AS (SELECT host, seed AS r FROM {name}s)")
        for i in range(cfg.iterations):
            parts.append(
                f"{name}{i + 1} AS MATERIALIZED (SELECT s.host, seed * {1 - cfg.damping} + coalesce(f, 0) * {cfg.damping} AS r FROM {name}s s LEFT JOIN "
                f"(SELECT dst AS host, sum(r * w) AS f FROM {links} JOIN {name}{i} ON src = host GROUP BY 1) USING (host))"
            )
    end = cfg.iterations
    parts.append(
        f"v AS (SELECT t{end}.host, CASE WHEN d{end}.r > t{end}.r AND d{end}.r > {cfg.floor} * (SELECT sum(r) FROM d{end}) / (SELECT count(*) FROM hosts) THEN 'block' ELSE 'allow' END AS graph "
        f"FROM t{end} JOIN d{end} USING (host))"
    )
    return "WITH " + ",\n".join(parts) + "\nSELECT page_id, host, path, rule, coalesce(action, graph) AS verdict FROM j JOIN v USING (host)"


def _secrets() -> str:
    value = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    kinds = [
        ("assign", value, 2, 6),
        ("access", "AKIA[A-Z0-9]+", 0, 20),
        ("hex", "[0-9a-f]+", 0, 24),
        ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
        ("github", "gh[pousr]_[A-Za-z0-9]+", 0, 40),
        ("slack", "xox[abprs]-[A-Za-z0-9-]+", 0, 15),
        # What stands before a run is part of the match here, as its first group, and taken off again.
        ("jwt", r"(^|[^A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)", 2, 40),
    ]
    parts = ["d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)"]
    for i, (kind, pattern, group, least) in enumerate(kinds):
        lead = f"regexp_extract_all(text, '{pattern}', 1)" if kind == "jwt" else "[]::VARCHAR[]"
        parts.append(
            f"m{i} AS (SELECT doc_id, {lead} AS lead, regexp_extract_all(text, '{pattern}') AS m, regexp_extract_all(text, '{pattern}', {group}) AS v, string_split_regex(text, '{pattern}') AS p "
            f"FROM d WHERE regexp_matches(text, '{pattern.replace('[0-9a-f]+', '[0-9a-f]{24}')}'))"
        )
        parts.append(
            f"""s{i} AS (SELECT doc_id, {i} AS k, '{kind}' AS kind, list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) + coalesce(length(lead[i]), 0) AS a, length(m[i]) - coalesce(length(lead[i]), 0) AS n
 FROM (SELECT *, unnest(list_filter(range(1, len(m) + 1), lambda i: length(v[i]) >= {least})) AS i FROM m{i}))"""
        )
    every = " UNION ALL ".join(f"SELECT * FROM s{i}" for i in range(len(kinds)))
    parts.append(f"f AS (SELECT doc_id, k, a, kind || ':' || cast(a AS BIGINT) || ':' || cast(a + n AS BIGINT) AS span FROM ({every}))")
    return (
        "WITH "
        + ",\n".join(parts)
        + """
SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
 sha256(coalesce(string_agg(span, ',' ORDER BY a, k) FILTER (k < 3), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY a, k), '') AS spans
FROM d LEFT JOIN f USING (doc_id) GROUP BY doc_id"""
    )


def _warc() -> str:
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
    five = [f"cast('0x' || substr(h, {5 * k + 1}, 5) AS BIGINT)" for k in range(8)]
    code = " || ".join(f"substr({letters}, cast((({v} >> {s}) & 31) + 1 AS INTEGER), 1)" for v in five for s in (15, 10, 5, 0))
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, octet_length(encode(html)) AS payload_bytes, {code} AS payload_digest,
 CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM q"""


def _imatch() -> str:
    cfg = IMatchConfig()
    terms = "list_distinct(list_filter(string_split_regex(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''))"
    bar = "0123456789abcdef"[: cfg.sixteenths]

    def marked(name: str, source: str, column: str) -> str:
        parts = " || '-' || ".join(f"coalesce(max(h) FILTER (k = {k}), '')" for k in range(1, cfg.subsets + 1))
        alone = " || '-' || ".join(["own"] * cfg.subsets)
        every = f"array_to_string(list_sort({terms.format(column)}), ' ')"
        return f"""{name}t AS (SELECT doc_id, unnest({terms.format(column)}) AS term FROM {source}),
{name}s AS (SELECT doc_id, term, unnest(list_filter(range(1, {cfg.subsets + 1}), lambda k: contains('{bar}', substr(md5('{cfg.seed}:' || term), k, 1)))) AS k FROM {name}t JOIN lex USING (term)),
{name}h AS (SELECT doc_id, k, substr(md5(string_agg(term, ' ' ORDER BY term)), 1, 8) AS h FROM {name}s GROUP BY ALL),
{name}g AS (SELECT doc_id, {parts} AS fp FROM {name}h GROUP BY doc_id),
{name}o AS (SELECT doc_id, substr(md5(CASE WHEN {every} <> '' THEN {every} ELSE {column} END), 1, 8) AS own FROM {source}),
{name} AS (SELECT doc_id, coalesce(fp, {alone}) AS fp FROM {name}o LEFT JOIN {name}g USING (doc_id))"""

    def like(a: str, b: str) -> str:
        x, y = f"string_split({a}, '-')", f"string_split({b}, '-')"
        used = f"len(list_filter(range(1, {cfg.subsets + 1}), lambda i: {x}[i] <> '' OR {y}[i] <> ''))"
        same = f"len(list_filter(range(1, {cfg.subsets + 1}), lambda i: {x}[i] <> '' AND {x}[i] = {y}[i]))"
        return f"{same} / {used}"

    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), size AS (SELECT count(*) AS n FROM d),
df AS (SELECT term, count(*) AS df FROM (SELECT unnest({terms.format("text")}) AS term FROM d) GROUP BY 1),
lex AS (SELECT term FROM df, size WHERE df >= {cfg.low} * n AND df <= {cfg.high} * n),
o AS (SELECT doc_id, text, coalesce(lead(doc_id) OVER (ORDER BY doc_id DESC), (SELECT max(doc_id) FROM d)) AS next_id FROM d),
e AS (SELECT o.doc_id, o.next_id, o.text, left(o.text, length(o.text) - length(o.text) // 2) || left(x.text, length(o.text) // 2) AS edited FROM o JOIN d x ON x.doc_id = o.next_id),
{marked("fa", "d", "text")},
{marked("fb", "e", "edited")}
SELECT e.doc_id, length(e.text) AS n_chars, sha256(edited) AS edited_sha256, fa.fp AS fingerprint, fb.fp AS edited_fingerprint,
 {like("fa.fp", "fb.fp")} AS near_edited, {like("fa.fp", "c.fp")} AS near_next
FROM e JOIN fa USING (doc_id) JOIN fb USING (doc_id) JOIN fa c ON c.doc_id = e.next_id"""


def _chat() -> str:
    escaped = r"replace(replace(replace({}, '\', '\s'), '<', '\l'), '|>', '\p')"
    return f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM t),
b AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY k) IS NOT DISTINCT FROM role AS joins FROM o)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
 cast(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
 cast(sum(length({escaped.format("text")}) + CASE WHEN joins THEN 3 ELSE 12 + length({escaped.format("role")}) END) AS BIGINT) AS formatted_chars
FROM b GROUP BY conv_id"""


ORACLES: dict[str, str] = {
    "op1_minhash": _MINHASH,
    "op4_urls": _urls(),
    "op6_secrets": _secrets(),
    "op7_warc": _warc(),
    "op9_imatch": _imatch(),
    "op10_chat": _chat(),
}
