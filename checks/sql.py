"""Building blocks of the oracle SQL.

An independent formulation in DuckDB's dialect: relations of lines, references and
findings instead of arrays inside a document row.  Patterns run in RE2 directly.
"""

from __future__ import annotations

from checks import seeds
from corpusguard import fixed_values as V
from corpusguard.functions import urls


def lit(text: str) -> str:
    """SQL literal; control characters are spelled as chr()."""
    parts, plain = [], ""
    for c in text:
        if ord(c) < 32 or c in V.WHITESPACE.replace(" ", "") or c == V.BOM:
            if plain:
                parts.append("'" + plain.replace("'", "''") + "'")
                plain = ""
            parts.append(f"chr({ord(c)})")
        else:
            plain += c
    if plain or not parts:
        parts.append("'" + plain.replace("'", "''") + "'")
    return parts[0] if len(parts) == 1 else "(" + " || ".join(parts) + ")"


def strings(values: list[str]) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def found(column: str, name: str) -> str:
    return f"regexp_matches({column}, {lit(V.PATTERNS[name])})"


def trim(expr: str) -> str:
    return f"trim({expr}, {lit(V.WHITESPACE)})"


NUL = "chr(0)"
LF = "chr(10)"
CRLF = "(chr(13) || chr(10))"


def with_(ctes: list[tuple[str, str]], final: str) -> str:
    body = ",\n".join(f"{name} AS ({sql})" for name, sql in ctes)
    return f"WITH {body}\n{final}"


# --- paths ---------------------------------------------------------------------------


def fold(path: str) -> str:
    """List of the components of a relative path with ``.`` and ``..`` folded."""
    return (
        f"list_reduce(list_filter(string_split({path}, '/'), lambda x: x <> '' AND x <> '.'), "
        "lambda acc, x: CASE WHEN x = '..' AND len(acc) > 0 AND acc[len(acc)] <> '..' "
        "THEN acc[1:len(acc)-1] ELSE acc || [x] END, []::VARCHAR[])"
    )


def clean(path: str) -> str:
    return f"CASE WHEN len({fold(path)}) = 0 THEN '.' ELSE array_to_string({fold(path)}, '/') END"


def directory(path: str) -> str:
    """Directory of a clean relative path."""
    return f"(CASE WHEN contains({path}, '/') THEN regexp_replace({path}, '/[^/]*$', '') ELSE '.' END)"


def extension(path: str) -> str:
    return f"regexp_extract({path}, '\\.[^./]*$')"


def base(path: str) -> str:
    return f"regexp_extract({path}, '[^/]*$')"


DOC_PATH = lit(r"^(?:[^./\\][^/\\]*/)*[^./\\][^/\\]*\.md$")
SHA = lit(V.SHA256_PATTERN)
RULE_ID = lit(V.RULE_ID_PATTERN)

# --- inputs ----------------------------------------------------------------------------

DOCS = [
    (
        "docs",
        "SELECT *, sha256(text) AS sha256 FROM (SELECT doc_id, "
        "CASE WHEN doc_id % 97 = 0 THEN 's' || (doc_id % 5) || '/d' || doc_id || '/_index.md' "
        "ELSE 's' || (doc_id % 5) || '/t' || (doc_id % 3) || '/d' || doc_id || '.md' END AS path, "
        f"{strings(seeds.PREFIXES)}[doc_id % 7 + 1] || text || {LF} || {strings(seeds.SEEDS)}[doc_id % 24 + 1] AS text, "
        "TIMESTAMP '2026-01-01 00:00:00' + (doc_id % 5000) * INTERVAL 1 MINUTE AS modified_at FROM documents)",
    )
]


def lines(source: str, name: str, text: str = "text") -> tuple[str, str]:
    return (
        name,
        f"SELECT path, unnest(range(1, len(l) + 1))::BIGINT AS line, unnest(l) AS text FROM "
        f"(SELECT path, string_split(replace({text}, {CRLF}, {LF}), {LF}) AS l FROM {source})",
    )


LINE_RULES = [
    (V.PRIVATE_KEY, ["private_key"]),
    (V.TOKEN, ["token"]),
    (V.CREDENTIAL, ["credential_assignment", "credential_url"]),
    (V.PRIVATE_NETWORK, ["private_ipv4", "private_ipv6", "private_host"]),
    (V.ABSOLUTE_PATH, ["unix_path", "windows_path"]),
    (V.FILE_URL, ["file_url"]),
    (V.WIKI_LINK, ["wiki_link"]),
    (V.DANGEROUS_HTML, ["html_tag", "html_attribute"]),
]


def fires(rule: str) -> str:
    return "(" + " OR ".join(found("text", p) for p in dict(LINE_RULES)[rule]) + ")"


_FIRST = "coalesce(nullif(g2, ''), nullif(g3, ''), g4, '')"


def references(line_table: str, name: str) -> tuple[str, str]:
    """Targets of the three reference kinds with their position on the line."""

    def groups(pattern: str, *numbers: int) -> str:
        p = lit(V.PATTERNS[pattern])
        return ", ".join(f"unnest(regexp_extract_all(text, {p}, {n})) AS g{n}" for n in numbers)

    def count(pattern: str) -> str:
        return f"unnest(range(0, len(regexp_extract_all(text, {lit(V.PATTERNS[pattern])}))))::BIGINT AS position"

    definition = lit(V.PATTERNS["reference_definition"])
    return (
        name,
        f"SELECT path, line, 1 AS kind, position, g1 = '!' AS is_image, {trim('g2')} AS target FROM "
        f"(SELECT path, line, {count('markdown_link')}, {groups('markdown_link', 1, 2)} FROM {line_table}) "
        f"UNION ALL SELECT path, line, 2, 0, false, {trim(f'regexp_extract(text, {definition}, 1)')} FROM {line_table} "
        f"WHERE regexp_matches(text, {definition}) "
        f"UNION ALL SELECT path, line, 3, position, length(g1) = 3, "
        f"{trim(_FIRST)} FROM "
        f"(SELECT path, line, {count('html_resource')}, {groups('html_resource', 1, 2, 3, 4)} FROM {line_table})",
    )


def bad_escape(expr: str) -> str:
    return f"contains(regexp_replace({expr}, '%[0-9A-Fa-f]{{2}}', '', 'g'), '%')"


def split_urls(source: str, raw: str, prefix: str) -> list[tuple[str, str]]:
    """CTEs adding scheme, authority, url_path and valid to a relation of references."""
    return [
        (f"{prefix}u1", f"SELECT *, split_part({raw}, '#', 1) AS head FROM {source}"),
        (
            f"{prefix}u2",
            f"SELECT *, substr({raw}, length(head) + 2) AS fragment, "
            f"lower(regexp_extract(head, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme FROM {prefix}u1",
        ),
        (
            f"{prefix}u3",
            "SELECT *, split_part(CASE WHEN scheme <> '' THEN substr(head, length(scheme) + 2) ELSE head END, "
            f"'?', 1) AS hier FROM {prefix}u2",
        ),
        (
            f"{prefix}u4",
            "SELECT *, starts_with(hier, '//') AND (scheme <> '' OR NOT starts_with(hier, '///')) AS has_authority, "
            f"scheme <> '' AND NOT starts_with(hier, '/') AS opaque FROM {prefix}u3",
        ),
        (
            f"{prefix}u5",
            "SELECT *, CASE WHEN has_authority THEN regexp_extract(hier, '^//([^/]*)', 1) ELSE '' END AS authority, "
            "CASE WHEN opaque THEN '' WHEN has_authority THEN regexp_replace(hier, '^//[^/]*', '') ELSE hier END "
            f"AS raw_path FROM {prefix}u4",
        ),
        (
            f"{prefix}u6",
            "SELECT * , NOT regexp_matches(head, '[\\x00-\\x1F\\x7F]') AND NOT starts_with(head, ':') "
            "AND NOT (scheme = '' AND NOT starts_with(hier, '/') AND contains(split_part(hier, '/', 1), ':')) "
            f"AND NOT {bad_escape('fragment')} AND NOT {bad_escape('raw_path')} "
            "AND (authority = '' OR (regexp_matches(coalesce(regexp_extract(authority, '(?s)^(.*)@', 1), ''), "
            f"{lit(urls._USERINFO)}) AND NOT {bad_escape('regexp_extract(authority, ' + lit('(?s)^(.*)@') + ', 1)')} "
            f"AND regexp_matches(regexp_extract(authority, '[^@]*$'), {lit(urls._HOST)}))) AS valid, "
            f"CASE WHEN {bad_escape('raw_path')} THEN '' ELSE url_decode(raw_path) END AS url_path FROM {prefix}u5",
        ),
    ]


_IN_DIRECTORY = f"{directory('path')} || '/' || replace(local, chr(92), '/')"


def classify(refs: str, prefix: str) -> list[tuple[str, str]]:
    """CTEs ending in ``{prefix}hits``: rule, level and reason of each harmful reference."""
    mailed = "scheme IN ('mailto', 'tel')"
    return [
        (f"{prefix}wanted", f"SELECT * FROM {refs} WHERE target <> '' AND NOT starts_with(target, '#')"),
        *split_urls(f"{prefix}wanted", "target", prefix),
        (
            f"{prefix}decoded",
            f"SELECT *, {bad_escape('url_path')} AS bad_twice, "
            f"CASE WHEN {bad_escape('url_path')} THEN '' ELSE url_decode(url_path) END AS local FROM {prefix}u6",
        ),
        (
            f"{prefix}joined",
            f"SELECT *, {clean(_IN_DIRECTORY)} AS joined, "
            f"lower({extension('local')}) AS ext FROM {prefix}decoded",
        ),
        (
            f"{prefix}hits",
            "SELECT path, line, kind, position, r.rule_id, r.level, r.reason FROM (SELECT *, CASE "
            + " ".join(
                f"WHEN {test} THEN {{'rule_id': {lit(rule)}, 'level': {lit(level)}, 'reason': {lit(reason)}}}"
                if rule
                else f"WHEN {test} THEN NULL"
                for test, rule, level, reason in (
                    ("NOT valid", V.LOCAL_RESOURCE, V.BLOCK, V.REASON_UNPARSEABLE),
                    ("scheme IN ('http', 'https') AND is_image", V.REMOTE_IMAGE, V.WARNING, V.REASONS[V.REMOTE_IMAGE]),
                    ("scheme IN ('http', 'https')", None, None, None),
                    (f"{mailed} AND NOT is_image", None, None, None),
                    ("scheme = 'file'", V.FILE_URL, V.BLOCK, V.REASONS[V.FILE_URL]),
                    (f"scheme <> '' AND NOT {mailed}", V.LOCAL_RESOURCE, V.BLOCK, V.REASON_SCHEME),
                    ("bad_twice", V.LOCAL_RESOURCE, V.BLOCK, V.REASON_BAD_PATH),
                    ("local = ''", None, None, None),
                    ("local[1] IN ('/', '~')", V.ABSOLUTE_PATH, V.BLOCK, V.REASONS[V.ABSOLUTE_PATH]),
                    (
                        "joined = '..' OR starts_with(joined, '../')",
                        V.RELATIVE_ESCAPE,
                        V.BLOCK,
                        V.REASONS[V.RELATIVE_ESCAPE],
                    ),
                    ("is_image", V.LOCAL_RESOURCE, V.BLOCK, V.REASON_LOCAL_IMAGE),
                    ("ext NOT IN ('', '.md')", V.LOCAL_RESOURCE, V.BLOCK, V.REASON_LOCAL_FILE),
                )
            )
            + f" END AS r FROM {prefix}joined) WHERE r IS NOT NULL",
        ),
    ]


FENCE = "CASE WHEN starts_with({0}, '```') THEN '```' WHEN starts_with({0}, '~~~') THEN '~~~' ELSE '' END"


def fence_line(line_list: str) -> str:
    marks = (
        f"list_filter(list_transform({line_list}, lambda x, i: {{'line': i::BIGINT, 'marker': "
        f"{FENCE.format(trim('x'))}}}), lambda m: m.marker <> '')"
    )
    return (
        f"list_reduce({marks}, lambda s, m: CASE WHEN s.marker = '' THEN m "
        "WHEN s.marker = m.marker THEN {'line': 0::BIGINT, 'marker': ''} ELSE s END, "
        "{'line': 0::BIGINT, 'marker': ''}).line"
    )


def open_front_matter(line_list: str) -> str:
    first = trim(f"CASE WHEN {line_list}[1][1] = {lit(V.BOM)} THEN {line_list}[1][2:] ELSE {line_list}[1] END")
    return (
        f"{first} = '---' AND len(list_filter({line_list}[2:], lambda x: {trim('x')} IN ('---', '...'))) = 0"
    )


def structural(source: str, name: str, text: str = "text") -> tuple[str, str]:
    split = f"string_split(replace({text}, {CRLF}, {LF}), {LF})"
    return (
        name,
        f"SELECT path, line, rule_id FROM (SELECT path, unnest([{{'line': (CASE WHEN contains({text}, {NUL}) THEN "
        f"1 + length(regexp_replace(split_part({text}, {NUL}, 1), '[^\\n]', '', 'g')) END)::BIGINT, "
        f"'rule_id': {lit(V.BINARY)}}}, "
        f"{{'line': (CASE WHEN {open_front_matter('l')} THEN 1 END)::BIGINT, 'rule_id': {lit(V.FRONT_MATTER)}}}, "
        f"{{'line': nullif({fence_line('l')}, 0), 'rule_id': {lit(V.UNCLOSED_FENCE)}}}], recursive := true) "
        f"FROM (SELECT path, {text}, {split} AS l FROM {source})) WHERE line IS NOT NULL",
    )


def reason_case(column: str) -> str:
    return "CASE " + " ".join(f"WHEN {column} = {lit(r)} THEN {lit(t)}" for r, t in V.REASONS.items()) + " END"


def fingerprint(alias: str = "") -> str:
    return (
        f"sha256(concat_ws({NUL}, {alias}path, {alias}rule_id, {alias}level, {alias}line::VARCHAR, "
        f"{alias}reason, CASE WHEN {alias}approvable THEN 'true' ELSE 'false' END))"
    )


def scan(source: str, prefix: str, text: str = "text") -> list[tuple[str, str]]:
    """CTEs ending in ``{prefix}findings`` with fingerprints, for ``path, sha256, <text>`` rows."""
    p = prefix
    direct = " UNION ALL ".join(
        f"SELECT path, line, {lit(rule)} AS rule_id, {seq}::BIGINT AS seq FROM {p}lines WHERE {fires(rule)}"
        for seq, (rule, _) in enumerate(LINE_RULES)
    )
    approvable = f"rule_id = {lit(V.PRIVATE_NETWORK)}"
    return [
        lines(source, f"{p}lines", text),
        (f"{p}direct", direct),
        references(f"{p}lines", f"{p}refs"),
        *classify(f"{p}refs", p),
        structural(source, f"{p}structural", text),
        (
            f"{p}emitted",
            f"SELECT path, line, rule_id, 'block' AS level, {reason_case('rule_id')} AS reason, "
            f"{approvable} AS approvable, seq FROM {p}direct "
            f"UNION ALL SELECT path, line, rule_id, level, reason, false, 1000000 * kind + position FROM {p}hits "
            f"UNION ALL SELECT path, line, rule_id, 'block', {reason_case('rule_id')}, false, -1 FROM {p}structural",
        ),
        (
            f"{p}findings",
            f"SELECT e.*, d.sha256, {fingerprint('e.')} AS fingerprint FROM (SELECT path, line, rule_id, "
            "arg_min(level, seq) AS level, arg_min(reason, seq) AS reason, arg_min(approvable, seq) AS approvable "
            f"FROM {p}emitted GROUP BY path, line, rule_id) e JOIN {source} d ON d.path = e.path",
        ),
    ]


# --- transform ---------------------------------------------------------------------------


def quote_yaml(expr: str) -> str:
    for raw, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        expr = f"replace({expr}, {lit(raw)}, {lit(escaped)})"
    return f"('\"' || {expr} || '\"')"


def front_matter(text: str) -> str:
    left = f"ltrim({text}, {lit(chr(13) + chr(10) + chr(9) + ' ')})"
    return "(" + " OR ".join(
        f"starts_with({left}, {lit(m)})" for m in ("---\n", "---\r\n", "+++\n", "{\n")
    ) + ")"


def _title(trimmed: str) -> str:
    inner = trim(f"substr({trimmed}, 3)")
    return trim(f"regexp_replace({inner}, '(?s)^(.*[ \\t])#+$', '\\1')")


def heading(line_list: str) -> str:
    """Struct (found, title) of the first heading; ``found`` counts from 1, 0 if none."""
    marks = (
        f"list_transform({line_list}, lambda x, i: {{'found': i::BIGINT, 'marker': {FENCE.format(trim('x'))}, "
        f"'title': CASE WHEN starts_with({trim('x')}, '# ') THEN {_title(trim('x'))} ELSE '' END}})"
    )
    start = "{'found': 0::BIGINT, 'marker': '', 'title': ''}"
    return (
        f"list_reduce(list_filter({marks}, lambda m: m.marker <> '' OR m.title <> ''), lambda s, m: CASE "
        "WHEN s.found > 0 THEN s "
        "WHEN m.marker <> '' AND s.marker = '' THEN {'found': 0::BIGINT, 'marker': m.marker, 'title': ''} "
        f"WHEN m.marker <> '' AND m.marker = s.marker THEN {start} "
        f"WHEN m.marker = '' AND s.marker = '' THEN m ELSE s END, {start})"
    )


def transform(source: str, prefix: str) -> list[tuple[str, str]]:
    """CTEs ending in ``{prefix}out``: path, doc_id, output, sha256 of transformable documents."""
    p = prefix
    body = (
        "CASE WHEN h.found = 0 THEN c ELSE array_to_string(l[1:h.found-1], chr(10)) || "
        "CASE WHEN h.found > 1 THEN chr(10) ELSE '' END || coalesce(array_to_string("
        f"l[h.found + 1 + (CASE WHEN h.found < len(l) AND {trim('l[h.found+1]')} = '' THEN 1 ELSE 0 END):], chr(10)), '') END"
    )
    return [
        (
            f"{p}stripped",
            f"SELECT *, CASE WHEN text[1] = {lit(V.BOM)} THEN text[2:] ELSE text END AS c FROM {source}",
        ),
        (
            f"{p}parsed",
            f"SELECT *, string_split(c, chr(10)) AS l, {heading('string_split(c, chr(10))')} AS h FROM {p}stripped "
            f"WHERE regexp_matches(path, {lit('^(?:[^./][^/]*/)*[^./][^/]*[.]md$')}) AND NOT {front_matter('c')}",
        ),
        (
            f"{p}parts",
            f"SELECT *, {body} AS body, CASE WHEN h.found > 0 THEN h.title ELSE "
            f"regexp_replace({base('path')}, '[.]md$', '') END AS title FROM {p}parsed",
        ),
        (
            f"{p}out",
            "SELECT path, doc_id, output, sha256(output) AS sha256, title, lastmod FROM (SELECT path, doc_id, title, "
            "modified_at AS lastmod, "
            f"'---' || chr(10) || 'title: ' || {quote_yaml('title')} || chr(10) || 'lastmod: ' || "
            "chr(34) || strftime(modified_at, '%Y-%m-%dT%H:%M:%SZ') || chr(34) || chr(10) || '---' || chr(10) || chr(10) || body || "
            f"CASE WHEN body <> '' AND NOT suffix(body, chr(10)) THEN chr(10) ELSE '' END AS output FROM {p}parts)",
        ),
    ]


# --- approvals -----------------------------------------------------------------------------

AT = "TIMESTAMP '2026-06-01 00:00:00'"


def nth(findings: str, name: str) -> tuple[str, str]:
    return (
        name,
        "SELECT *, row_number() OVER (PARTITION BY path, rule_id, level, reason, approvable ORDER BY line) AS rank, "
        f"count(*) OVER (PARTITION BY path, rule_id, level, reason, approvable) AS total FROM {findings}",
    )


def pairs(source: str, output: str, name: str, prefix: str) -> list[tuple[str, str]]:
    return [
        nth(source, f"{prefix}ns"),
        nth(output, f"{prefix}no"),
        (
            name,
            "SELECT s.path, s.rule_id, s.level, s.reason, s.approvable, s.rank, s.total, "
            "s.sha256 AS source_sha256, s.line AS source_line, s.fingerprint AS source_fingerprint, "
            "o.sha256 AS output_sha256, o.line AS output_line, o.fingerprint AS output_fingerprint "
            f"FROM {prefix}ns s JOIN {prefix}no o USING (path, rule_id, level, reason, approvable, rank, total)",
        ),
    ]


ALLOWLIST_COLUMNS = (
    "path, source_sha256, source_finding_fingerprint, source_line, output_sha256, output_finding_fingerprint, "
    "output_line, rule, level, reason, approved_at, expires_at"
)


def allowlist() -> list[tuple[str, str]]:
    zeros = "repeat('0', 64)"
    approvable = "SELECT * FROM {0} WHERE level = 'block' AND approvable AND rule_id = 'network.private-address'"
    return [
        ("al_s", approvable.format("s_findings")),
        ("al_o", approvable.format("o_findings")),
        *pairs("al_s", "al_o", "al_pairs", "al_"),
        (
            "al_rows",
            "SELECT *, unnest(CASE WHEN kind = 3 THEN ['as is', 'output behind', 'source behind'] ELSE ['as is'] END) "
            "AS variant FROM (SELECT p.*, (d.doc_id // 24) % 4 AS kind FROM al_pairs p JOIN docs d ON d.path = p.path)",
        ),
        (
            "allowlist",
            f"SELECT path, CASE WHEN kind = 2 OR variant = 'source behind' THEN {zeros} ELSE source_sha256 END AS source_sha256, "
            "source_fingerprint AS source_finding_fingerprint, source_line, "
            f"CASE WHEN kind = 2 THEN {zeros} ELSE output_sha256 END AS output_sha256, "
            f"CASE WHEN variant = 'output behind' THEN {zeros} ELSE output_fingerprint END AS output_finding_fingerprint, "
            "output_line, rule_id AS rule, level, 'reviewed test address' AS reason, "
            "CASE WHEN kind = 1 OR variant <> 'as is' THEN TIMESTAMP '2025-01-01' ELSE TIMESTAMP '2026-01-01' END AS approved_at, "
            "CASE WHEN kind = 1 OR variant <> 'as is' THEN TIMESTAMP '2026-01-01' ELSE TIMESTAMP '2027-01-01' END AS expires_at "
            "FROM al_rows",
        ),
    ]


def approved(findings: str, side: str, name: str) -> tuple[str, str]:
    """Findings with ``approved``: the first entry of the identity in sort order decides."""
    return (
        name,
        f"SELECT f.*, coalesce(a.active, false) AND f.approvable AND f.level = 'block' AND f.line > 0 AS approved "
        f"FROM {findings} f LEFT JOIN (SELECT path, rule, level, sha, fp, line, approved_at <= {AT} AND {AT} < expires_at AS active "
        f"FROM (SELECT *, {side}_sha256 AS sha, {side}_finding_fingerprint AS fp, {side}_line AS line, row_number() OVER ("
        f"PARTITION BY path, rule, level, {side}_sha256, {side}_finding_fingerprint, {side}_line ORDER BY source_sha256, rule, "
        "source_finding_fingerprint, output_finding_fingerprint) AS rn FROM allowlist) WHERE rn = 1) a "
        "ON a.path = f.path AND a.rule = f.rule_id AND a.level = f.level AND a.sha = f.sha256 AND a.fp = f.fingerprint AND a.line = f.line",
    )


SCAN = DOCS + scan("docs", "s_")
OUTPUT = SCAN + transform("docs", "t_") + scan("t_out", "o_", "output")
APPROVALS = OUTPUT + allowlist()
MARKED = APPROVALS + [approved("s_findings", "source", "s_marked"), approved("o_findings", "output", "o_marked")]

OUTCOMES = MARKED + [
    (
        "outcomes",
        "SELECT d.doc_id, d.path, d.sha256, CASE "
        "WHEN d.path IN (SELECT path FROM s_marked WHERE level = 'block' AND NOT approved) THEN 'blocked' "
        f"WHEN {base('d.path')} = '_index.md' THEN 'path.reserved-index' "
        "WHEN t.path IS NULL THEN 'content.transform-error' "
        "WHEN d.path IN (SELECT path FROM o_marked WHERE level = 'block' AND NOT approved) THEN 'content.output-safety-mismatch' "
        "ELSE 'published' END AS outcome, t.output, t.sha256 AS output_sha256, t.title, t.lastmod "
        "FROM docs d LEFT JOIN t_out t ON t.path = d.path",
    ),
    (
        "final_findings",
        "SELECT path, line, rule_id, level, reason, approvable, sha256, fingerprint, approved FROM s_marked UNION ALL "
        f"SELECT path, line, rule_id, level, reason, approvable, sha256, {fingerprint()}, false FROM (SELECT path, 0::BIGINT AS line, "
        f"outcome AS rule_id, 'block' AS level, {lit(V.REASON_TRANSFORM)} AS reason, false AS approvable, sha256 FROM outcomes "
        "WHERE outcome NOT IN ('blocked', 'published'))",
    ),
    (
        "approved_rules",
        "SELECT path, string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) AS rules FROM o_marked WHERE approved GROUP BY path",
    ),
]

DIRECTORIES = [
    (
        "directories",
        "SELECT DISTINCT array_to_string(p[1:n], '/') AS directory FROM (SELECT p, unnest(range(1, len(p))) AS n FROM "
        "(SELECT string_split(path, '/') AS p FROM docs)) UNION SELECT '.'",
    ),
    (
        "indexes",
        "SELECT directory, CASE WHEN directory = '.' THEN '_index.md' ELSE directory || '/_index.md' END AS path, "
        f"'---' || chr(10) || 'title: ' || {quote_yaml('(CASE WHEN directory = ' + lit('.') + ' THEN ' + lit(V.ROOT_SECTION_TITLE) + ' ELSE ' + base('directory') + ' END)')} "
        "|| chr(10) || '---' || chr(10) || chr(10) AS data FROM directories",
    ),
]

MANIFEST = (
    OUTCOMES
    + DIRECTORIES
    + [
        (
            "manifest",
            "SELECT kind, row_number() OVER (ORDER BY kind, path) AS ordinal, path, source_sha256, sha256, approved_rules FROM ("
            "SELECT 'document' AS kind, o.path, o.sha256 AS source_sha256, o.output_sha256 AS sha256, coalesce(r.rules, '') AS approved_rules "
            "FROM outcomes o LEFT JOIN approved_rules r ON r.path = o.path WHERE outcome = 'published' "
            "UNION ALL SELECT 'index', path, NULL, sha256(data), '' FROM indexes)",
        ),
        (
            "files",
            "SELECT path, output AS data FROM outcomes WHERE outcome = 'published' UNION ALL SELECT path, data FROM indexes",
        ),
    ]
)

SAFE_REASON = (
    "CASE "
    + " ".join(f"WHEN rule_id = {lit(r)} THEN {lit(t)}" for r, t in V.SAFE_REASONS.items())
    + f" WHEN starts_with(rule_id, 'gitleaks.') THEN {lit(V.SAFE_REASON_EXTERNAL)} ELSE {lit(V.SAFE_REASON_OTHER)} END"
)


def report(findings: str) -> list[tuple[str, str]]:
    return [
        (
            "report_findings",
            f"SELECT path, sha256, fingerprint, rule_id AS rule, level, line, {SAFE_REASON} AS reason FROM {findings} "
            "WHERE level = 'block' AND NOT approved",
        ),
        (
            "report_documents",
            f"SELECT path, any_value(sha256) AS sha256, sha256(path || {NUL} || any_value(sha256) || {NUL} || string_agg(concat_ws({NUL}, "
            f"fingerprint, rule, level, line::VARCHAR, reason), {NUL} ORDER BY rule, line, fingerprint)) AS document_fingerprint "
            "FROM report_findings GROUP BY path",
        ),
    ]


# --- pages ------------------------------------------------------------------------------------

PAGES = [
    (
        "site_pages",
        "SELECT page_id, CASE WHEN page_id % 50 = 0 THEN 'home' || page_id || '.example.org' ELSE 'docs.example.org' END AS site, "
        "CASE WHEN page_id % 50 = 0 THEN 'index.html' WHEN page_id % 3 = 0 THEN 'docs/p' || (page_id % 7) || '/' || page_id || '/index.html' "
        "ELSE 'docs/p' || (page_id % 7) || '/' || page_id || '.html' END AS file, "
        "html || '<a href=\"/docs/p' || ((page_id + 1) % 7) || '/' || (page_id + 1) || '\">next</a>' || "
        "CASE WHEN page_id % 5 = 0 THEN '<a href=../../../../x>up</a>' ELSE '' END || "
        "CASE WHEN page_id % 4 = 0 THEN '<a href=''?q=1''>q</a><a HREF = \"a%zz\">bad</a><img src=//cdn/x.png>' ELSE '' END || "
        "CASE WHEN page_id % 12 = 0 THEN regexp_extract(html, '(?s)(<h1>.*?</h1>)', 1) ELSE '' END || "
        "CASE WHEN page_id % 50 = 0 THEN '<div data-knowledge-stats data-published-documents=' || page_id || "
        "' data-published-categories=\"7\"></div>' || repeat('<a class=\"hextra-feature-card\" href=\"/\">c</a>', (2 + (page_id // 50) % 2)::INTEGER) "
        "ELSE '' END AS html FROM pages",
    )
]


def unescape(expr: str) -> str:
    for entity, text in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        expr = f"replace({expr}, {lit(entity)}, {lit(text)})"
    return expr


_JOINED = "coalesce(g1, '') || coalesce(g2, '') || coalesce(g3, '')"
_ATTRIBUTE = lit(V.PAGE_PATTERNS["attribute"])
LINKS = PAGES + [
    (
        "links",
        f"SELECT DISTINCT site, file, {unescape(trim('coalesce(g1, chr(32)[2:]) || coalesce(g2, chr(32)[2:]) || coalesce(g3, chr(32)[2:])'))} AS raw FROM "
        f"(SELECT site, file, unnest(regexp_extract_all(html, {_ATTRIBUTE}, 1)) AS g1, unnest(regexp_extract_all(html, {_ATTRIBUTE}, 2)) AS g2, "
        f"unnest(regexp_extract_all(html, {_ATTRIBUTE}, 3)) AS g3 FROM site_pages)",
    )
]
_HOSTNAME = (
    "lower(regexp_replace(regexp_replace(regexp_extract(authority, '[^@]*$'), ':[0-9]*$', ''), '^\\[|\\]$', '', 'g'))"
)
RESOLVED = (
    LINKS
    + split_urls("links", "raw", "k_")
    + [
        (
            "k_located",
            f"SELECT *, raw = '' OR raw[1] = '#' OR starts_with(raw, '//') AS outside, "
            f"(scheme <> '' AND (scheme NOT IN ('http', 'https') OR {_HOSTNAME} <> lower(site))) OR url_path = '' AS elsewhere, "
            "CASE WHEN url_path[1] = '/' THEN url_path ELSE "
            f"({directory('file')}) || '/' || url_path END AS joined FROM k_u6",
        ),
        (
            "resolved",
            "SELECT site, file, raw, status, CASE WHEN status = 'internal' THEN cleaned END AS target FROM (SELECT *, CASE "
            "WHEN outside THEN 'external' WHEN NOT valid THEN 'invalid' WHEN elsewhere THEN 'external' "
            "WHEN cleaned = '..' OR starts_with(cleaned, '../') THEN 'invalid' ELSE 'internal' END AS status FROM "
            f"(SELECT *, {clean('joined')} AS cleaned FROM k_located))",
        ),
    ]
)
TARGETS = RESOLVED + [
    (
        "site_directories",
        "SELECT DISTINCT site, array_to_string(p[1:n], '/') AS directory FROM (SELECT site, p, unnest(range(1, len(p))) AS n "
        "FROM (SELECT site, string_split(file, '/') AS p FROM site_pages)) UNION SELECT DISTINCT site, '.' FROM site_pages",
    ),
    ("targets", "SELECT DISTINCT site, target FROM resolved WHERE status = 'internal'"),
    (
        "existing",
        "SELECT t.site, t.target, CASE WHEN d.directory IS NOT NULL THEN i.file ELSE coalesce(x.file, h.file) END AS found FROM targets t "
        "LEFT JOIN site_directories d ON d.site = t.site AND d.directory = t.target "
        "LEFT JOIN site_pages i ON i.site = t.site AND i.file = CASE WHEN t.target = '.' THEN 'index.html' ELSE t.target || '/index.html' END "
        "LEFT JOIN site_pages x ON x.site = t.site AND x.file = t.target "
        "LEFT JOIN site_pages h ON h.site = t.site AND h.file = t.target || '.html'",
    ),
    (
        "broken",
        "SELECT DISTINCT r.site, r.file, r.target FROM resolved r JOIN existing e ON e.site = r.site AND e.target = r.target "
        "WHERE r.status = 'internal' AND e.found IS NULL",
    ),
]
_HEADING = lit(V.PAGE_PATTERNS["heading"])
_TAG = lit(V.PAGE_PATTERNS["tag"])


def normalized(expr: str) -> str:
    plain = unescape(f"regexp_replace({expr}, {_TAG}, '', 'g')")
    return trim(f"regexp_replace({plain}, '[' || {lit(V.WHITESPACE)} || ']+', ' ', 'g')")


HEADINGS = PAGES + [
    (
        "headings",
        f"SELECT site, file, list_transform(regexp_extract_all(html, {_HEADING}, 1)[1:2], lambda x: {normalized('x')}) AS h FROM site_pages "
        "WHERE starts_with(file, 'docs/') AND regexp_matches(file, '(^|/)index[.]html$')",
    )
]


def positive(pattern: str) -> str:
    return f"coalesce(try_cast(regexp_extract(html, {lit(V.PAGE_PATTERNS[pattern])}, 1) AS BIGINT) > 0, false)"
