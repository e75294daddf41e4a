"""Queries over manifests, published files, verification and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import seeds
from checks import sql as S
from checks.base import check
from corpusguard import fixed_values as V
from corpusguard.functions.text import digest
from corpusguard.operators import manifest, rules, stats
from corpusguard.plans import publish, verify
from corpusguard.session import new_folder
from corpusguard.sources import commit, discover, sinks, snapshot, strict

AT = seeds.AT
RULESET = "a" * 64


def outcomes(spark, sf_dir):
    return publish.decide_outcomes(
        seeds.documents(spark, sf_dir), seeds.allowlist(spark, sf_dir), AT
    )


def built(spark, sf_dir):
    decided = seeds.written(spark, sf_dir, "outcomes", lambda: outcomes(spark, sf_dir))
    return publish.build_snapshot(decided, decided.select("path"), seeds.SCANNER_VERSION, RULESET, AT)


def stored_manifest(spark, sf_dir):
    return seeds.written(
        spark, sf_dir, "manifest", lambda: manifest.encode_manifest(built(spark, sf_dir).manifest)
    )


# --- publishing -----------------------------------------------------------------------------


@check(
    "publish_outcomes",
    S.with_(
        S.OUTCOMES,
        "SELECT o.path, outcome, CASE WHEN outcome = 'published' THEN output_sha256 END AS output_sha256, "
        "CASE WHEN outcome = 'published' THEN coalesce(r.rules, '') END AS rules FROM outcomes o LEFT JOIN approved_rules r ON r.path = o.path",
    ),
)
def publish_outcomes(spark, sf_dir):
    return outcomes(spark, sf_dir).select(
        "path", "outcome", "output_sha256", F.array_join("approved_rules", ",").alias("rules")
    )


@check(
    "publish_findings",
    S.with_(S.OUTCOMES, "SELECT path, line, rule_id, fingerprint, approved FROM final_findings"),
)
def publish_findings(spark, sf_dir):
    """Source findings with the failures of the transform added."""
    return rules.flatten_findings(outcomes(spark, sf_dir)).select("path", "line", "rule_id", "fingerprint", "approved")


_FINAL_REPORT = S.OUTCOMES + S.report("final_findings")


@check(
    "publish_exclusions",
    S.with_(_FINAL_REPORT, "SELECT path, document_fingerprint FROM report_documents"),
)
def publish_exclusions(spark, sf_dir):
    return built(spark, sf_dir).scan.exclusions.select("path", F.col("fingerprint").alias("document_fingerprint"))


@check(
    "encode_manifest",
    S.with_(S.MANIFEST, "SELECT kind, ordinal, path, source_sha256, sha256, approved_rules FROM manifest"),
)
def encode_manifest(spark, sf_dir):
    encoded = manifest.encode_manifest(built(spark, sf_dir).manifest)
    return encoded.select(
        "kind", "ordinal", "path", "source_sha256", "sha256", F.array_join("approved_rules", ",").alias("approved_rules")
    )


@check("load_manifest", S.with_(S.MANIFEST, "SELECT kind, ordinal, path, source_sha256, sha256 FROM manifest"))
def load_manifest(spark, sf_dir):
    target = new_folder(spark, "stored-manifest")
    sinks.write_manifest(stored_manifest(spark, sf_dir), target)
    return strict.load_manifest(spark, target).select("kind", "ordinal", "path", "source_sha256", "sha256")


@check("publish_snapshot", S.with_(S.MANIFEST, "SELECT path, sha256(data) AS sha256 FROM files"))
def publish_snapshot(spark, sf_dir):
    """Publish twice, the second time unchanged, and read what is visible."""
    root = new_folder(spark, "snapshot")
    files = built(spark, sf_dir).files
    first = snapshot.publish_snapshot(files, root)
    second = snapshot.publish_snapshot(files, root)
    if first != second:
        raise AssertionError("publishing the same tree twice moved the pointer")
    return manifest.hash_tree(snapshot.read_snapshot(spark, root))


def rule_table(spark):
    return spark.createDataFrame(
        [(f"rules/{name}", pattern) for name, pattern in V.PATTERNS.items()], "path string, content string"
    )


def published_site(spark, sf_dir):
    """Root of a whole publication, made once per session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _SITES:
        root = new_folder(spark, "corpus")
        docs, listed = seeds.documents(spark, sf_dir), seeds.allowlist(spark, sf_dir)
        publish.publish_corpus(docs, listed, AT, root, seeds.SCANNER_VERSION, RULESET)
        _SITES[key] = root
    return f"{_SITES[key]}/content"


_SITES: dict[tuple, str] = {}


@check("publish_after_crash", S.with_(S.MANIFEST, "SELECT path, sha256(data) AS sha256 FROM files"))
def publish_after_crash(spark, sf_dir):
    """A publisher died with its pointer file empty; the next one goes past it, and of two one fails."""
    root = new_folder(spark, "crashed")
    files = built(spark, sf_dir).files
    snapshot.publish_snapshot(files.where("path < 's3'"), root)
    location = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/pointer/sequence-{2:012d}.json")
    location.getFileSystem(spark._jsc.hadoopConfiguration()).create(location, False).close()
    if snapshot.current(spark, root)["sequence"] != 1:
        raise AssertionError("an empty pointer file hides the snapshot")
    last, _ = commit.state(spark, root)
    snapshot.publish_snapshot(files, root)
    try:
        commit.advance(spark, root, last, {"version": "late"})
    except strict.InvalidTable:
        return manifest.hash_tree(snapshot.read_snapshot(spark, root))
    raise AssertionError("two publishers of one state both succeeded")


@check("publish_corpus", S.with_(S.MANIFEST, "SELECT kind, ordinal, path, sha256 FROM manifest"))
def publish_corpus(spark, sf_dir):
    """The whole job: reports, snapshot, manifest; reads the visible manifest back."""
    root = new_folder(spark, "corpus")
    docs = seeds.documents(spark, sf_dir)
    publish.publish_corpus(
        docs,
        seeds.allowlist(spark, sf_dir),
        AT,
        root,
        seeds.SCANNER_VERSION,
        lambda: rule_table(spark),
        unchanged=discover.discover_documents(docs, "text").select("path", "sha256"),
    )
    stored = strict.load_manifest(spark, publish.published_manifest_path(spark, root))
    return stored.select("kind", "ordinal", "path", "sha256")


# --- reconciliation -----------------------------------------------------------------------------

# A published tree after tampering, by the first digit of each file's digest.
_D = "substr(sha256, 1, 1)"
TAMPERED = S.MANIFEST + [
    ("hashed", "SELECT path, data, sha256(data) AS sha256 FROM files"),
    (
        "tampered",
        f"SELECT path, CASE WHEN {_D} = '1' THEN data || 'host 10.9.8.7' || chr(10) ELSE data END AS data FROM hashed WHERE {_D} <> '0' "
        f"UNION ALL SELECT 'extra/' || path, data FROM hashed WHERE {_D} = '2'",
    ),
]


def tampered(spark, sf_dir):
    files = built(spark, sf_dir).files
    first = F.substring("sha256", 1, 1)
    data = F.when(first == "1", F.concat("data", F.lit("host 10.9.8.7\n"))).otherwise(F.col("data"))
    return (
        files.where(first != "0")
        .select("path", data.alias("data"))
        .unionByName(files.where(first == "2").select(F.concat(F.lit("extra/"), "path").alias("path"), "data"))
    )


@check(
    "verify_manifest",
    S.with_(
        TAMPERED,
        f"SELECT path, CASE WHEN {_D} = '0' THEN 'missing' ELSE 'changed' END AS status FROM hashed WHERE {_D} IN ('0', '1') "
        f"UNION ALL SELECT 'extra/' || path, 'extra' FROM hashed WHERE {_D} = '2'",
    ),
)
def verify_manifest(spark, sf_dir):
    return manifest.verify_manifest(manifest.hash_tree(tampered(spark, sf_dir)), stored_manifest(spark, sf_dir))


@check(
    "detect_drift",
    S.with_(
        S.DOCS,
        "SELECT path, CASE doc_id % 12 WHEN 0 THEN 'removed' WHEN 1 THEN 'changed' WHEN 2 THEN 'changed' END AS status FROM docs "
        "WHERE doc_id % 12 IN (0, 1, 2) UNION ALL SELECT 'new/' || path, 'added' FROM docs WHERE doc_id % 12 = 3",
    ),
)
def detect_drift(spark, sf_dir):
    docs = seeds.documents(spark, sf_dir)
    n = F.col("doc_id") % 12
    later = docs.where(n != 0).select(
        "path",
        F.when(n == 1, F.concat("text", F.lit("x"))).otherwise(F.col("text")).alias("text"),
        F.when(n == 2, F.timestamp_seconds(F.lit(0))).otherwise(F.col("modified_at")).alias("modified_at"),
    )
    added = docs.where(n == 3).select(F.concat(F.lit("new/"), "path").alias("path"), "text", "modified_at")
    return manifest.detect_drift(
        discover.discover_documents(docs, "text"),
        discover.discover_documents(later.unionByName(added), "text"),
    )


@check(
    "verify_boundary",
    S.with_(
        TAMPERED,
        f"SELECT path, 'absent_file' AS problem FROM hashed WHERE {_D} = '0' UNION ALL SELECT 'extra/' || path, 'unexpected_file' FROM hashed WHERE {_D} = '2' "
        "UNION ALL SELECT DISTINCT array_to_string(p[1:n], '/'), 'unexpected_directory' FROM (SELECT p, unnest(range(1, len(p))) AS n FROM "
        f"(SELECT string_split('extra/' || path, '/') AS p FROM hashed WHERE {_D} = '2'))",
    ),
)
def verify_boundary(spark, sf_dir):
    files = tampered(spark, sf_dir)
    return manifest.verify_boundary(files, verify.directories_of(files), stored_manifest(spark, sf_dir))


_VERIFY_DOCUMENTS = TAMPERED + [
    ("t_files", "SELECT path, data AS text, sha256(data) AS sha256 FROM tampered"),
    *S.scan("t_files", "v_"),
    S.approved("v_findings", "output", "v_marked"),
    (
        "rescanned",
        "SELECT t.path, coalesce(bool_or(level = 'block' AND NOT approved), false) AS unapproved, coalesce(bool_or(level = 'block'), false) AS blocking, "
        "coalesce(string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) FILTER (approved), '') AS rules FROM t_files t LEFT JOIN v_marked f ON f.path = t.path GROUP BY t.path",
    ),
    (
        "document_problems",
        "SELECT * FROM (SELECT coalesce(m.path, r.path) AS path, CASE WHEN r.path IS NULL THEN 'not_verified' WHEN m.path IS NULL THEN 'not_registered' "
        "WHEN kind = 'index' AND blocking THEN 'index_blocked' WHEN kind = 'document' AND unapproved THEN 'document_blocked' "
        "WHEN kind = 'document' AND rules <> approved_rules THEN 'approved_rules' END AS problem "
        "FROM manifest m FULL JOIN rescanned r ON r.path = m.path) WHERE problem IS NOT NULL",
    ),
]


@check("verify_documents", S.with_(_VERIFY_DOCUMENTS, "SELECT path, problem FROM document_problems"))
def verify_documents(spark, sf_dir):
    scanned = verify.rescan(tampered(spark, sf_dir), seeds.allowlist(spark, sf_dir), AT)
    return manifest.verify_documents(scanned, stored_manifest(spark, sf_dir))


@check(
    "verify_corpus",
    S.with_(
        _VERIFY_DOCUMENTS,
        "SELECT 'document' AS \"check\", count(*) AS n FROM document_problems HAVING count(*) > 0 UNION ALL "
        f"SELECT 'digest', count(*) FROM hashed WHERE {_D} IN ('0', '1', '2') UNION ALL SELECT 'header', 1 UNION ALL "
        f"SELECT 'boundary', (SELECT count(*) FROM hashed WHERE {_D} IN ('0', '2')) + (SELECT count(DISTINCT array_to_string(p[1:n], '/')) FROM "
        f"(SELECT p, unnest(range(1, len(p))) AS n FROM (SELECT string_split('extra/' || path, '/') AS p FROM hashed WHERE {_D} = '2')))",
    ),
)
def verify_corpus(spark, sf_dir):
    """All checks over the tampered tree, against another ruleset."""
    violations = verify.verify_corpus(
        tampered(spark, sf_dir),
        stored_manifest(spark, sf_dir),
        seeds.allowlist(spark, sf_dir),
        AT,
        seeds.SCANNER_VERSION,
        "b" * 64,
    )
    return violations.groupBy("check").agg(F.count(F.lit(1)).alias("n"))


@check("verify_untouched", S.with_(S.MANIFEST, "SELECT path, '' AS problem FROM manifest WHERE false"))
def verify_untouched(spark, sf_dir):
    """The published tree as it is: no violation."""
    violations = verify.verify_corpus(
        built(spark, sf_dir).files.select("path", "data"),
        stored_manifest(spark, sf_dir),
        seeds.allowlist(spark, sf_dir),
        AT,
        seeds.SCANNER_VERSION,
        RULESET,
    )
    return violations.select("path", "problem")


def published_receipts(spark, sf_dir):
    """Receipts of the published files: some report a finding, some are missing, of other bytes or unfinished."""
    first = F.substring("sha256", 1, 2)
    finding = F.array(F.struct(F.lit("late key").alias("rule_id"), F.lit(2).cast("long").alias("line")))
    return built(spark, sf_dir).files.where(first != "00").select(
        "path",
        F.when(first == "11", F.reverse("sha256")).otherwise(F.col("sha256")).alias("sha256"),
        (first != "22").alias("completed"),
        F.when(F.startswith(first, F.lit("3")), finding).otherwise(F.slice(finding, 1, 0)).alias("findings"),
    )


@check(
    "verify_with_external",
    S.with_(
        S.MANIFEST,
        "SELECT 'external' AS \"check\", path, CASE substr(sha256, 1, 2) WHEN '00' THEN 'unscanned' WHEN '11' THEN 'stale' ELSE 'incomplete' END AS problem "
        "FROM (SELECT path, sha256(data) AS sha256 FROM files) WHERE substr(sha256, 1, 2) IN ('00', '11', '22') UNION ALL "
        "SELECT 'document', path, CASE WHEN path = '_index.md' OR path LIKE '%/_index.md' THEN 'index_blocked' ELSE 'document_blocked' END "
        "FROM (SELECT path, sha256(data) AS sha256 FROM files) WHERE substr(sha256, 1, 1) = '3'",
    ),
)
def verify_with_external(spark, sf_dir):
    """The published tree as it is, against an outside scan with findings and gaps."""
    violations = verify.verify_corpus(
        built(spark, sf_dir).files.select("path", "data"),
        stored_manifest(spark, sf_dir),
        seeds.allowlist(spark, sf_dir),
        AT,
        seeds.SCANNER_VERSION,
        RULESET,
        external=published_receipts(spark, sf_dir),
    )
    return violations.select("check", "path", "problem")


def bent_manifest(spark, sf_dir):
    """A manifest of all documents in order, with planted faults by document number."""
    docs = seeds.documents(spark, sf_dir)
    n = F.col("doc_id") % 12
    padded = F.concat(F.lit("s/"), F.lpad(F.col("doc_id").cast("string"), 10, "0"))
    sha = digest(F.col("text"))
    return docs.select(
        F.when(n == 1, 1).otherwise(V.MANIFEST_VERSION).alias("version"),
        F.when(n == 2, F.lit(" ")).otherwise(F.lit(seeds.SCANNER_VERSION)).alias("scanner_version"),
        F.lit(RULESET).alias("ruleset_sha256"),
        F.lit("document").alias("kind"),
        (F.col("doc_id") + 1).alias("ordinal"),
        F.when(n == 3, F.concat(padded, F.lit(".txt")))
        .when(n == 4, F.concat(padded, F.lit("/_index.md")))
        .when(n == 5, F.lit("s/0.md"))
        .otherwise(F.concat(padded, F.lit(".md")))
        .alias("path"),
        F.when(n == 6, F.lit("x")).otherwise(sha).alias("source_sha256"),
        sha.alias("sha256"),
        F.when(n == 7, F.array(F.lit("b"), F.lit("a")))
        .when(n == 8, F.array(F.lit("a"), F.lit("a")))
        .when(n == 9, F.array(F.lit(" ")))
        .otherwise(F.array(F.lit("a"), F.lit("b")))
        .alias("approved_rules"),
    )


_BENT_PATH = (
    "CASE doc_id % 12 WHEN 3 THEN p || '.txt' WHEN 4 THEN p || '/_index.md' WHEN 5 THEN 's/0.md' ELSE p || '.md' END"
)


@check(
    "validate_manifest",
    S.with_(
        [("bent", f"SELECT doc_id, {_BENT_PATH} AS path FROM (SELECT doc_id, 's/' || lpad(doc_id::VARCHAR, 10, '0') AS p FROM documents)")],
        "SELECT path, CASE doc_id % 12 WHEN 1 THEN 'version' WHEN 2 THEN 'scanner_version' WHEN 3 THEN 'path' WHEN 4 THEN 'path' "
        "WHEN 6 THEN 'source_sha256' ELSE 'approved_rules' END AS problem FROM bent WHERE doc_id % 12 IN (1, 2, 3, 4, 6, 7, 8, 9) "
        "UNION ALL SELECT path, 'duplicate' FROM bent GROUP BY path HAVING count(*) > 1 UNION ALL "
        "SELECT path, 'unordered' FROM (SELECT path, path <= lag(path) OVER (ORDER BY doc_id) AS bad FROM bent) WHERE bad",
    ),
)
def validate_manifest(spark, sf_dir):
    return manifest.validate_manifest(bent_manifest(spark, sf_dir))


_RULE_FILES = ", ".join(f"({S.lit('rules/' + n)}, {S.lit(p)})" for n, p in V.PATTERNS.items())
_ROW_HASH = f"sha256(concat_ws({S.NUL}, {', '.join(f'coalesce({c}::VARCHAR, {chr(39) * 2})' for c in ('path', 'sha256'))}))"


@check(
    "ruleset_fingerprint",
    S.with_(
        S.DOCS
        + [
            ("level0", f"SELECT h AS k, count(*)::VARCHAR AS v FROM (SELECT {_ROW_HASH} AS h FROM docs) GROUP BY h"),
            *(
                (
                    f"level{n + 1}",
                    f"SELECT substr(k, 1, {digits}) AS k, sha256(string_agg(k || '=' || v, ',' ORDER BY k || '=' || v)) AS v FROM level{n} GROUP BY 1",
                )
                for n, digits in enumerate((6, 3, 0))
            ),
            (
                "rule_files",
                f"SELECT * FROM (VALUES {_RULE_FILES}) v(path, content) UNION ALL "
                "SELECT 'config/documents', v FROM level3",
            ),
        ],
        f"SELECT sha256(string_agg(path || {S.NUL} || content || {S.NUL}, '' ORDER BY path)) AS ruleset_sha256 FROM rule_files",
    ),
)
def ruleset_fingerprint(spark, sf_dir):
    """Rule patterns and the digest of a growing table as one configuration."""
    docs = seeds.documents(spark, sf_dir).select("path", digest(F.col("text")).alias("sha256"))
    grown = manifest.table_digest(docs, ["path", "sha256"]).select(
        F.lit("config/documents").alias("path"), F.col("sha256").alias("content")
    )
    return manifest.ruleset_fingerprint(rule_table(spark).unionByName(grown))


# --- statistics -------------------------------------------------------------------------------------


_PUBLISHED = S.OUTCOMES + [("shown", "SELECT path, title, lastmod FROM outcomes WHERE outcome = 'published'")]


def published(spark, sf_dir):
    """Title and time of the documents on show, as the publication staged them."""
    return snapshot.read_published(spark, published_site(spark, sf_dir))


@check(
    "read_published",
    S.with_(_PUBLISHED, "SELECT path, title, lastmod::VARCHAR AS lastmod FROM shown"),
)
def read_published(spark, sf_dir):
    return published(spark, sf_dir).withColumn("lastmod", F.col("lastmod").cast("string"))


@check(
    "corpus_stats",
    S.with_(
        _PUBLISHED + S.DIRECTORIES,
        "SELECT (SELECT count(*) FROM shown) AS documents, (SELECT count(*) FROM directories WHERE directory <> '.') AS sections",
    ),
)
def corpus_stats(spark, sf_dir):
    return stats.corpus_stats(published(spark, sf_dir), snapshot.read_candidates(spark, published_site(spark, sf_dir)))


@check(
    "category_wall",
    S.with_(
        _PUBLISHED,
        "SELECT section, count(*) AS documents, max(latest) AS latest_title FROM (SELECT split_part(path, '/', 1) AS section, "
        "first_value(title) OVER (PARTITION BY split_part(path, '/', 1) ORDER BY lastmod DESC, path) AS latest FROM shown) "
        "GROUP BY section ORDER BY documents DESC, section",
    ),
)
def category_wall(spark, sf_dir):
    return stats.category_wall(published(spark, sf_dir))


@check(
    "recent_documents",
    S.with_(
        _PUBLISHED,
        f"SELECT path, title, {S.base(S.directory('path'))} AS section, left(lastmod::VARCHAR, 10) AS date FROM shown "
        "ORDER BY lastmod DESC, path LIMIT 6",
    ),
)
def recent_documents(spark, sf_dir):
    return stats.recent_documents(published(spark, sf_dir))
