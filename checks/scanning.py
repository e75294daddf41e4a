"""Queries over documents, lines, rules and scalar functions."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from checks import seeds
from checks import sql as S
from checks.base import check
from corpusguard import fixed_values as V
from corpusguard.functions import paths, text as text_fns
from corpusguard.operators import approvals, findings, rules, transform
from corpusguard.operators.manifest import hash_tree
from corpusguard.session import new_folder
from corpusguard.sources import discover, external

STAMP = "yyyy-MM-dd HH:mm:ss"


def scanned(spark, sf_dir, *keep):
    return rules.scan_documents(seeds.documents(spark, sf_dir)).select("path", "sha256", "findings", *keep)


def source_findings(spark, sf_dir):
    return findings.with_fingerprint(rules.flatten_findings(scanned(spark, sf_dir)))


def seeded_lines(spark, sf_dir):
    return rules.split_lines(seeds.documents(spark, sf_dir))


# --- sources ---------------------------------------------------------------------------


@check(
    "discover_documents",
    S.with_(
        S.DOCS,
        "SELECT path, sha256, octet_length(encode(text))::BIGINT AS size, "
        "strftime(modified_at, '%Y-%m-%d %H:%M:%S') AS modified_at FROM docs",
    ),
)
def discover_documents(spark, sf_dir):
    found = discover.discover_documents(seeds.documents(spark, sf_dir), "text")
    return found.withColumn("modified_at", F.date_format("modified_at", STAMP))


_TREE_NAMES = ["a/d{}.md", "_drafts/_d{}.md", ".hid/d{}.md", "b/d{}.txt", "x/y z/ü{}.md", "_index{}.md", "x/.d{}.md"]


def write_tree(spark, sf_dir):
    """Every document as a file of its own, under names of all kinds, written by tasks."""
    root = new_folder(spark, "tree")
    base = root.removeprefix("file:")
    name = F.replace(seeds.pick(_TREE_NAMES, F.col("doc_id") % len(_TREE_NAMES)), F.lit("{}"), F.col("doc_id").cast("string"))
    named = seeds.documents(spark, sf_dir).select(name.alias("path"), "text")

    def write(batches):
        for batch in batches:
            for path, text in zip(batch["path"], batch["text"]):
                os.makedirs(os.path.dirname(f"{base}/{path}"), exist_ok=True)
                with open(f"{base}/{path}", "wb") as file:
                    file.write(text.encode())
            yield batch[["path"]]

    return root, named.mapInPandas(write, "path string").count()


@check(
    "discover_tree",
    S.with_(
        S.DOCS,
        f"SELECT replace({S.strings(_TREE_NAMES)}[doc_id % {len(_TREE_NAMES)} + 1], '{{}}', doc_id::VARCHAR) AS path, "
        "sha256, octet_length(encode(text))::BIGINT AS size FROM docs WHERE doc_id % 7 IN (0, 1, 4, 5)",
    ),
)
def discover_tree(spark, sf_dir):
    """The documents written out as files, then discovered: names with a leading underscore count, hidden ones don't."""
    root, count = write_tree(spark, sf_dir)
    tree = discover.read_tree(spark, root)
    if tree.count() != count or discover.skipped_paths(tree).count() + discover.discover_documents(tree).count() != count:
        raise AssertionError("files were lost in the listing")
    return discover.discover_documents(tree).drop("modified_at")


PATH_VARIANTS = [
    "{p}",
    ".hidden/{p}",
    "{p}.txt",
    "draft.tmp.{p}",
    "{p}~",
    "#{p}#",
    "x.BAK/{p}",
    "UPPER{p}.MD",
    "a.swp.b/{p}",
    "note",
    "back.backup/{p}",
    "a.b/{p}",
    "/{p}",
    "../{p}",
    "a/../{p}",
    "a//{p}",
    "./{p}",
    "a\\{p}",
    "",
    ".",
    "..",
    "{p}/",
    ".md",
    "a/.md",
    "{p}/_index.md",
    "a\tb/{p}",
    "a/../../{p}",
    "/../{p}",
    "a/b/../../c/./{p}",
]


def path_variants(spark, sf_dir):
    """Paths of all documents, each bent in one of the listed ways."""
    n = F.col("doc_id")
    shaped = [
        F.concat(F.lit(v.split("{p}")[0]), "path", F.lit(v.split("{p}")[1])) if "{p}" in v else F.lit(v)
        for v in PATH_VARIANTS
    ]
    docs = seeds.documents(spark, sf_dir)
    return docs.select("doc_id", F.get(F.array(*shaped), (n % len(shaped)).cast("int")).alias("path"))


_SHAPED = ", ".join(
    f"{S.lit(v.split('{p}')[0])} || path || {S.lit(v.split('{p}')[1])}" if "{p}" in v else S.lit(v)
    for v in PATH_VARIANTS
)
VARIANTS = S.DOCS + [
    ("variants", f"SELECT doc_id, [{_SHAPED}][doc_id % {len(PATH_VARIANTS)} + 1] AS path FROM docs"),
    ("parts", "SELECT doc_id, path, unnest(string_split(path, '/')) AS part FROM variants"),
]
_MARKERS = " OR ".join(f"suffix(lower(part), '{m}') OR contains(lower(part), '{m}.')" for m in V.TEMPORARY_MARKERS)


@check(
    "classify_paths",
    S.with_(
        VARIANTS,
        "SELECT path, CASE WHEN doc_id IN (SELECT doc_id FROM parts WHERE starts_with(part, '.') OR starts_with(part, '#') "
        f"OR suffix(part, '#') OR suffix(part, '~') OR {_MARKERS}) THEN 'hidden-or-temporary' "
        f"WHEN coalesce({S.extension('path')}, '') <> '.md' THEN 'not-markdown' END AS reason FROM variants",
    ),
)
def classify_paths(spark, sf_dir):
    return discover.classify_paths(path_variants(spark, sf_dir))


@check("read_stable", S.with_(S.DOCS, "SELECT path, sha256 FROM docs WHERE doc_id % 10 <> 0 AND doc_id % 13 <> 0"))
def read_stable(spark, sf_dir):
    docs = seeds.documents(spark, sf_dir)
    before = discover.discover_documents(docs, "text")
    edited = docs.withColumn(
        "text", F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    ).withColumn(
        "modified_at",
        F.when(F.col("doc_id") % 13 == 0, F.timestamp_seconds(F.lit(0))).otherwise(F.col("modified_at")),
    )
    return discover.read_stable(edited, before, "text").select("path", "sha256")


_SANITIZED = (
    "coalesce(nullif(trim(regexp_replace({0}, '[^A-Za-z0-9._-]', '-', 'g'), '-'), ''), 'unknown')".format(S.trim("rule_id"))
)
EXTERNAL = S.DOCS + [
    (
        "external_rows",
        "SELECT path, CASE WHEN doc_id % 2 = 0 THEN ' aws key/' WHEN doc_id % 3 = 0 THEN '--' ELSE 'generic.key' END AS rule_id, "
        "unnest([doc_id % 4 - 1, doc_id % 4 - 1, doc_id % 4])::BIGINT AS line FROM docs WHERE doc_id % 11 = 0",
    ),
    (
        "external_findings",
        f"SELECT path, greatest(line, 0) AS line, 'gitleaks.' || {_SANITIZED} AS rule_id, 'block' AS level, "
        f"{S.lit(V.REASON_EXTERNAL)} AS reason, false AS approvable FROM external_rows",
    ),
]


@check("external_findings", S.with_(EXTERNAL, "SELECT * FROM external_findings"))
def external_findings(spark, sf_dir):
    return findings.external_findings(seeds.external(spark, sf_dir))


@check(
    "union_findings",
    S.with_(
        S.SCAN + EXTERNAL[1:],
        "SELECT path, line, rule_id, level, reason, approvable FROM s_findings UNION SELECT * FROM external_findings",
    ),
)
def union_findings(spark, sf_dir):
    own = rules.flatten_findings(scanned(spark, sf_dir))
    return findings.union_findings(own, seeds.external(spark, sf_dir))


def _length_scanner():
    """A stand-in outside scanner: reports documents of an even number of bytes."""
    return lambda path, data: [("even size", 1 + data.count(b"\n"))] if len(data) % 2 == 0 else []


@check(
    "external_scanner",
    S.with_(
        S.DOCS,
        f"SELECT path, 'even size' AS rule_id, (1 + length(regexp_replace(text, '[^\\n]', '', 'g')))::BIGINT AS line FROM docs "
        "WHERE octet_length(encode(text)) % 2 = 0",
    ),
)
def external_scanner(spark, sf_dir):
    return external.run_external_scanner(seeds.documents(spark, sf_dir), _length_scanner, "text")


# --- rules ----------------------------------------------------------------------------------


@check(
    "rule_invalid_utf8",
    S.with_(
        S.DOCS, "SELECT path, 0::BIGINT AS line, 'content.invalid-utf8' AS rule_id, 1::BIGINT AS findings FROM docs WHERE doc_id % 10 = 0"
    ),
)
def rule_invalid_utf8(spark, sf_dir):
    docs = seeds.documents(spark, sf_dir)
    damaged = docs.select(
        "path",
        F.when(F.col("doc_id") % 10 == 0, F.concat(F.unhex(F.lit("FFFE")), F.col("text").cast("binary")))
        .otherwise(F.col("text").cast("binary"))
        .alias("content"),
    )
    results = rules.scan_documents(damaged, "content")
    return (
        rules.flatten_findings(results.withColumn("n", F.size("findings").cast("long")), "n")
        .where(F.col("rule_id") == V.INVALID_UTF8)
        .select("path", "line", "rule_id", F.col("n").alias("findings"))
    )


def _structural(rule_id):
    return S.with_(
        S.DOCS + [S.structural("docs", "structural")],
        f"SELECT path, line FROM structural WHERE rule_id = {S.lit(rule_id)}",
    )


@check("rule_binary", _structural(V.BINARY))
def rule_binary(spark, sf_dir):
    docs = seeds.documents(spark, sf_dir)
    return docs.where(F.contains("text", F.lit("\0"))).select("path", rules.binary_line(F.col("text")).alias("line"))


@check("rule_unclosed_front_matter", _structural(V.FRONT_MATTER))
def rule_unclosed_front_matter(spark, sf_dir):
    docs = seeds.documents(spark, sf_dir).where(F.contains("text", F.lit("---")))
    opened = text_fns.let(text_fns.lines(F.col("text")), rules.unclosed_front_matter)
    return docs.where(opened).select("path", F.lit(1).cast("long").alias("line"))


@check("rule_unclosed_fence", _structural(V.UNCLOSED_FENCE))
def rule_unclosed_fence(spark, sf_dir):
    docs = seeds.documents(spark, sf_dir).where(text_fns.contains_any(F.col("text"), "```", "~~~"))
    line = text_fns.let(text_fns.lines(F.col("text")), rules.unclosed_fence_line)
    return text_fns.compute_once(docs.select("path", "text"), "line", line).where("line > 0").select("path", "line")


RULE_QUERIES = {
    "rule_private_key": V.PRIVATE_KEY,
    "rule_token": V.TOKEN,
    "rule_credential": V.CREDENTIAL,
    "rule_private_network": V.PRIVATE_NETWORK,
    "rule_absolute_path": V.ABSOLUTE_PATH,
    "rule_file_url": V.FILE_URL,
    "rule_wiki_link": V.WIKI_LINK,
    "rule_dangerous_html": V.DANGEROUS_HTML,
}
LINES = S.DOCS + [S.lines("docs", "s_lines")]
for _name, _rule in RULE_QUERIES.items():
    check(
        _name,
        S.with_(
            LINES,
            f"SELECT path, line, {S.lit(_rule)} AS rule_id, 'block' AS level, {str(_rule == V.PRIVATE_NETWORK).lower()} AS approvable "
            f"FROM s_lines WHERE {S.fires(_rule)}",
        ),
    )(lambda spark, sf_dir, rule=_rule: rules.rule_lines(seeded_lines(spark, sf_dir), rule))

REFERENCES = LINES + [S.references("s_lines", "s_refs")]
REFERENCE_QUERIES = {
    "extract_markdown_links": ("markdown_link", 1),
    "extract_reference_definitions": ("reference_definition", 2),
    "extract_html_resources": ("html_resource", 3),
}
for _name, (_kind, _number) in REFERENCE_QUERIES.items():
    check(
        _name,
        S.with_(REFERENCES, f"SELECT path, line, position, is_image, target FROM s_refs WHERE kind = {_number}"),
    )(lambda spark, sf_dir, kind=_kind: rules.reference_rows(seeded_lines(spark, sf_dir), kind))


@check(
    "classify_reference",
    S.with_(
        REFERENCES + S.classify("s_refs", "s_"), "SELECT path, line, kind::BIGINT AS kind, position, rule_id, level, reason FROM s_hits"
    ),
)
def classify_reference(spark, sf_dir):
    lines = seeded_lines(spark, sf_dir)
    parts = [
        rules.reference_rows(lines, kind).withColumn("kind", F.lit(number).cast("long"))
        for kind, number in REFERENCE_QUERIES.values()
    ]
    hit = rules.classify_reference(paths.directory(F.col("path")), F.col("target"), F.col("is_image"))
    return (
        text_fns.compute_once(parts[0].unionByName(parts[1]).unionByName(parts[2]), "hit", hit)
        .where("hit is not null")
        .select("path", "line", "kind", "position", "hit.rule_id", "hit.level", "hit.reason")
    )


@check(
    "normalize_findings",
    S.with_(S.SCAN, "SELECT path, line, rule_id, level, reason, approvable FROM s_findings"),
)
def normalize_findings(spark, sf_dir):
    """The flat form: every emitted hit with its sequence number, then one per key."""
    lines = seeded_lines(spark, sf_dir)
    direct = [
        rules.rule_lines(lines, rule).select(
            "path",
            "line",
            "rule_id",
            "level",
            F.lit(V.REASONS[rule]).alias("reason"),
            "approvable",
            F.lit(number).cast("long").alias("seq"),
        )
        for number, rule in enumerate(rules.LINE_RULES)
    ]
    references = classify_reference(spark, sf_dir).select(
        "path",
        "line",
        "rule_id",
        "level",
        "reason",
        F.lit(False).alias("approvable"),
        (F.col("kind") * 1000000 + F.col("position")).alias("seq"),
    )
    whole = [
        frame.select(
            "path",
            "line",
            F.lit(rule).alias("rule_id"),
            F.lit(V.BLOCK).alias("level"),
            F.lit(V.REASONS[rule]).alias("reason"),
            F.lit(False).alias("approvable"),
            F.lit(-1).cast("long").alias("seq"),
        )
        for frame, rule in (
            (rule_binary(spark, sf_dir), V.BINARY),
            (rule_unclosed_front_matter(spark, sf_dir), V.FRONT_MATTER),
            (rule_unclosed_fence(spark, sf_dir), V.UNCLOSED_FENCE),
        )
    ]
    emitted = references
    for frame in direct + whole:
        emitted = emitted.unionByName(frame)
    return findings.normalize_findings(emitted)


@check(
    "scan_findings",
    S.with_(S.SCAN, "SELECT path, line, rule_id, level, reason, approvable, fingerprint FROM s_findings"),
)
def scan_findings(spark, sf_dir):
    """The one-pass scan of whole documents, flattened."""
    return source_findings(spark, sf_dir).drop("sha256")


@check(
    "scan_conversations",
    S.with_(
        [
            (
                "turns",
                "SELECT *, sha256(text) AS sha256 FROM (SELECT 'c' || conv_id || '/t' || turn || '.md' AS path, "
                f"text || {S.LF} || {S.strings(seeds.SEEDS)}[(conv_id + turn) % 24 + 1] AS text FROM conversations)",
            ),
            *S.scan("turns", "c_"),
        ],
        "SELECT path, line, rule_id, level, reason FROM c_findings",
    ),
)
def scan_conversations(spark, sf_dir):
    """The same rules over a second text table."""
    turns = seeds.table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("c"), "conv_id", F.lit("/t"), "turn", F.lit(".md")).alias("path"),
        F.concat("text", F.lit("\n"), seeds.pick(seeds.SEEDS, (F.col("conv_id") + F.col("turn")) % 24)).alias("text"),
    )
    found = rules.flatten_findings(rules.scan_documents(turns))
    return found.select("path", "line", "rule_id", "level", "reason")


# --- scalar projections ---------------------------------------------------------------------


@check("content_digest", S.with_(S.DOCS, "SELECT path, sha256 FROM docs"))
def content_digest(spark, sf_dir):
    return seeds.documents(spark, sf_dir).select("path", text_fns.digest(F.col("text")).alias("sha256"))


@check("hash_tree", S.with_(S.DOCS, "SELECT path, sha256 FROM docs"))
def hash_tree_query(spark, sf_dir):
    return hash_tree(seeds.documents(spark, sf_dir), "text")


@check("split_lines", S.with_(LINES, "SELECT path, line, sha256(text) AS sha256 FROM s_lines"))
def split_lines(spark, sf_dir):
    return seeded_lines(spark, sf_dir).select("path", "line", text_fns.digest(F.col("text")).alias("sha256"))


@check(
    "clean_path",
    S.with_(
        VARIANTS,
        f"SELECT path, CASE WHEN path[1] = '/' THEN '/' || array_to_string(list_filter({S.fold('path')}, lambda x: x <> '..'), '/') "
        f"ELSE {S.clean('path')} END AS cleaned, coalesce({S.extension('path')}, '') AS extension FROM variants",
    ),
)
def clean_path(spark, sf_dir):
    path = F.col("path")
    return path_variants(spark, sf_dir).select(
        "path", paths.clean(path).alias("cleaned"), paths.extension(path).alias("extension")
    )


@check("finding_fingerprint", S.with_(S.SCAN, "SELECT path, line, rule_id, fingerprint FROM s_findings"))
def finding_fingerprint(spark, sf_dir):
    return source_findings(spark, sf_dir).select("path", "line", "rule_id", "fingerprint")


_RAW_RULE = "' ' || lang || '/' || source || CASE WHEN doc_id % 3 = 0 THEN ' é-' WHEN doc_id % 3 = 1 THEN '--' ELSE '_x. ' END"
_RULE_CASE = f"CASE WHEN doc_id % 17 = 0 THEN '-é ' ELSE {_RAW_RULE} END"


@check(
    "sanitize_rule_id",
    S.with_(
        [("raw", f"SELECT doc_id, {_RULE_CASE} AS rule_id FROM documents")],
        f"SELECT doc_id, rule_id, {_SANITIZED} AS sanitized FROM raw",
    ),
)
def sanitize_rule_id(spark, sf_dir):
    raw = seeds.table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_RULE_CASE} as rule_id")
    return raw.select("doc_id", "rule_id", findings.sanitize_rule_id(F.col("rule_id")).alias("sanitized"))


@check(
    "safe_reason",
    S.with_(
        S.SCAN + EXTERNAL[1:],
        f"SELECT rule_id, {S.SAFE_REASON} AS reason, count(*) AS n FROM (SELECT rule_id FROM s_findings UNION ALL "
        "SELECT rule_id FROM external_findings) GROUP BY rule_id",
    ),
)
def safe_reason(spark, sf_dir):
    own = rules.flatten_findings(scanned(spark, sf_dir)).select("rule_id")
    other = findings.external_findings(seeds.external(spark, sf_dir)).select("rule_id")
    return (
        own.unionByName(other)
        .groupBy("rule_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("rule_id", findings.safe_reason(F.col("rule_id")).alias("reason"), "n")
    )


_PARTS = "string_split(path, '/')"
_EMPTY = f"len(list_filter({_PARTS}, lambda x: x = '')) > 0"
_DOTS = f"len(list_filter({_PARTS}, lambda x: x IN ('.', '..'))) > 0"
_HIDDEN = f"len(list_filter({_PARTS}, lambda x: starts_with(x, '.'))) > 0"
_SNAPSHOT_OK = f"(path <> '' AND NOT contains(path, chr(92)) AND NOT {_EMPTY} AND NOT {_DOTS})"
_VISIBLE = f"(NOT {_EMPTY} AND NOT {_HIDDEN} AND NOT regexp_matches(path, '\\pC'))"


@check(
    "validate_document_path",
    S.with_(
        VARIANTS,
        f"SELECT path, NOT {_EMPTY} AND NOT {_HIDDEN} AND suffix(path, '.md') AND NOT contains(path, chr(92)) AS review_ok, "
        f"NOT {_EMPTY} AND NOT {_HIDDEN} AND suffix(path, '.md') AS transform_ok FROM variants",
    ),
)
def validate_document_path(spark, sf_dir):
    path = F.col("path")
    return path_variants(spark, sf_dir).select(
        "path",
        paths.valid_document_path(path).alias("review_ok"),
        paths.valid_document_path(path, allow_backslash=True).alias("transform_ok"),
    )


@check(
    "validate_snapshot_path",
    S.with_(
        VARIANTS,
        f"SELECT path, {_SNAPSHOT_OK} AS file_ok, {_SNAPSHOT_OK} AND {_VISIBLE} AND suffix(path, '.md') AND "
        f"{S.base('path')} <> '_index.md' AS document_ok, {_SNAPSHOT_OK} AND {_VISIBLE} AND {S.base('path')} = '_index.md' AS index_ok "
        "FROM variants",
    ),
)
def validate_snapshot_path(spark, sf_dir):
    path = F.col("path")
    return path_variants(spark, sf_dir).select(
        "path",
        paths.valid_snapshot_path(path).alias("file_ok"),
        paths.valid_manifest_document(path).alias("document_ok"),
        paths.valid_manifest_index(path).alias("index_ok"),
    )


_BENT_HASH = (
    "CASE doc_id % 6 WHEN 0 THEN sha256 WHEN 1 THEN upper(sha256) WHEN 2 THEN substr(sha256, 2) WHEN 3 THEN concat(sha256, chr(10)) "
    "WHEN 4 THEN replace(sha256, 'a', 'g') ELSE concat('sha256:', sha256) END"
)


@check(
    "validate_sha256",
    S.with_(S.DOCS, f"SELECT doc_id, regexp_matches({_BENT_HASH}, {S.SHA}) AS valid FROM docs"),
)
def validate_sha256(spark, sf_dir):
    docs = seeds.documents(spark, sf_dir).withColumn("sha256", text_fns.digest(F.col("text")))
    bent = docs.selectExpr("doc_id", f"{_BENT_HASH} as sha256")
    return bent.select("doc_id", paths.valid_sha256(F.col("sha256")).alias("valid"))


_BENT_RULE = (
    "CASE doc_id % 6 WHEN 0 THEN concat(lang, '.', source) WHEN 1 THEN concat('-', source) WHEN 2 THEN concat(source, ' ') "
    "WHEN 3 THEN '' WHEN 4 THEN concat(source, chr(10)) ELSE concat(source, '_', lang, '-9') END"
)


@check(
    "validate_rule_id",
    f"SELECT doc_id, regexp_matches({_BENT_RULE}, {S.RULE_ID}) AS valid FROM documents",
)
def validate_rule_id(spark, sf_dir):
    bent = seeds.table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_BENT_RULE} as rule")
    return bent.select("doc_id", paths.valid_rule_id(F.col("rule")).alias("valid"))


UNSAFE_REASONS = [
    "",
    " ",
    "to" + "ken: x",
    "api key = abc",
    "x AKIA" + "A" * 16,
    "deadbeef" * 4,
    "Zm9v" * 10 + "==",
    "-----BEGIN " + "PRIVATE KEY-----",
    "\u3000",
    "ok",
]


@check(
    "validate_review_reason",
    "SELECT conv_id, turn, reason <> '' AND "
    + S.trim("reason")
    + f" = reason AND length(reason) <= {V.REVIEW_REASON_LIMIT} AND NOT regexp_matches(reason, '\\p{{Cc}}') AND "
    + " AND ".join(f"NOT regexp_matches(reason, {S.lit(p)})" for p in V.UNSAFE_REASON_PATTERNS)
    + f" AS valid FROM (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text ELSE text || {S.strings(UNSAFE_REASONS)}"
    + f"[conv_id % {len(UNSAFE_REASONS)} + 1] END AS reason FROM conversations)",
)
def validate_review_reason(spark, sf_dir):
    turns = seeds.table(spark, sf_dir, "conversations")
    ending = F.get(F.array(*map(F.lit, UNSAFE_REASONS)), (F.col("conv_id") % len(UNSAFE_REASONS)).cast("int"))
    reason = F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise(F.concat("text", ending))
    return turns.select("conv_id", "turn", approvals.valid_review_reason(reason).alias("valid"))


FRONT = ["", "\n \t", "+++\n", "\r\n{\n", "---\r\n", "--- \n", "\u3000---\n"]


@check(
    "has_front_matter",
    S.with_(
        S.DOCS,
        f"SELECT path, {S.front_matter('bent')} AS found FROM (SELECT path, {S.strings(FRONT)}[(doc_id // 7) % {len(FRONT)} + 1] || text AS bent FROM docs)",
    ),
)
def has_front_matter(spark, sf_dir):
    docs = seeds.documents(spark, sf_dir)
    start = F.get(F.array(*map(F.lit, FRONT)), (F.floor(F.col("doc_id") / 7) % len(FRONT)).cast("int"))
    return docs.select("path", transform.has_front_matter(F.concat(start, "text")).alias("found"))


@check(
    "first_heading",
    S.with_(
        S.DOCS,
        "SELECT path, h.found AS line, h.title FROM "
        f"(SELECT path, {S.heading('string_split(text, chr(10))')} AS h FROM docs) WHERE h.found > 0",
    ),
)
def first_heading(spark, sf_dir):
    docs = seeds.documents(spark, sf_dir).where(F.contains("text", F.lit("# "))).select("path", "text")
    heading = text_fns.let(text_fns.raw_lines(F.col("text")), transform.first_heading)
    return (
        text_fns.compute_once(docs, "h", heading)
        .where("h.index is not null")
        .select("path", (F.col("h.index") + 1).cast("long").alias("line"), "h.title")
    )


@check(
    "transform_document",
    S.with_(S.OUTPUT, "SELECT path, sha256 AS output_sha256, title FROM t_out"),
)
def transform_document(spark, sf_dir):
    docs = transform.transform_documents(seeds.documents(spark, sf_dir)).select("path", "output")
    quoted = F.regexp_extract("output", r'^---\ntitle: "([^"\\]*)"\n', 1)
    return docs.where("output is not null").select(
        "path", text_fns.digest(F.col("output")).alias("output_sha256"), quoted.alias("title")
    )


@check(
    "transform_error",
    S.with_(S.DOCS, f"SELECT path, 'front_matter' AS transform_error FROM docs WHERE {S.front_matter('text')}"),
)
def transform_error(spark, sf_dir):
    docs = transform.transform_documents(seeds.documents(spark, sf_dir))
    return docs.where("transform_error is not null").select("path", "transform_error")


@check("quote_yaml", S.with_(S.DOCS, f"SELECT path, sha256({S.quote_yaml('text')}) AS quoted_sha256 FROM docs"))
def quote_yaml(spark, sf_dir):
    quoted = text_fns.quote_yaml(F.col("text"))
    return seeds.documents(spark, sf_dir).select("path", text_fns.digest(quoted).alias("quoted_sha256"))


@check("section_index", S.with_(S.DOCS + S.DIRECTORIES, "SELECT path, sha256(data) AS sha256 FROM indexes"))
def section_index(spark, sf_dir):
    return transform.build_indexes(seeds.documents(spark, sf_dir)).select("path", "sha256")


@check("section_directories", S.with_(S.DOCS + S.DIRECTORIES, "SELECT directory FROM directories"))
def section_directories(spark, sf_dir):
    return transform.section_directories(seeds.documents(spark, sf_dir))


# --- filters -----------------------------------------------------------------------------------


@check("blocking_findings", S.with_(S.SCAN, "SELECT path, line, rule_id FROM s_findings WHERE level = 'block'"))
def blocking_findings(spark, sf_dir):
    found = rules.flatten_findings(scanned(spark, sf_dir))
    return findings.blocking_findings(found).select("path", "line", "rule_id")


@check(
    "approvable_findings",
    S.with_(
        S.SCAN,
        "SELECT path, line, rule_id FROM s_findings WHERE level = 'block' AND approvable AND rule_id = 'network.private-address'",
    ),
)
def approvable_findings(spark, sf_dir):
    found = rules.flatten_findings(scanned(spark, sf_dir))
    return findings.approvable_findings(found).select("path", "line", "rule_id")


def bent_findings(spark, sf_dir):
    """Findings with planted faults, by document number and line."""
    number = F.regexp_extract("path", r"d([0-9]+)(?:/_index)?\.md$", 1).cast("long")
    n = (number + F.col("line")) % 9
    return rules.flatten_findings(scanned(spark, sf_dir)).select(
        F.when(n == 1, F.concat(F.lit("x"), "path")).otherwise(F.col("path")).alias("path"),
        F.col("path").alias("result_path"),
        F.when(n == 2, F.upper("sha256")).otherwise(F.col("sha256")).alias("sha256"),
        (n != 3).alias("completed"),
        F.when(n == 4, F.lit("-bad")).otherwise(F.col("rule_id")).alias("rule_id"),
        F.when(n == 5, F.lit(0)).otherwise(F.col("line")).cast("long").alias("line"),
        F.when(n == 6, F.lit("info")).otherwise(F.col("level")).alias("level"),
    )


@check(
    "valid_result_findings",
    S.with_(
        S.SCAN,
        "SELECT f.path, f.line, f.rule_id FROM s_findings f JOIN docs d ON d.path = f.path "
        "WHERE (d.doc_id + f.line) % 9 NOT IN (1, 2, 3, 4, 5) AND f.line > 0",
    ),
)
def valid_result_findings(spark, sf_dir):
    return findings.valid_result_findings(bent_findings(spark, sf_dir)).select("path", "line", "rule_id")
