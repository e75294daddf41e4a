"""Queries over approvals, reports, inventories and their stored forms."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime

from pyspark.sql import functions as F

from checks import seeds
from checks import sql as S
from checks.base import check
from checks.scanning import EXTERNAL, source_findings
from corpusguard import fixed_values as V
from corpusguard.functions import text as text_fns
from corpusguard.operators import approvals, findings, receipts, reports, rules, transform
from corpusguard.plans import approve, publish, scan
from corpusguard.schemas import ALLOWLIST
from corpusguard.session import materialize, new_folder
from corpusguard.sources import commit, sinks, strict

AT = seeds.AT


def output_findings(spark, sf_dir):
    """Fingerprinted findings of the transformed documents."""
    docs = seeds.documents(spark, sf_dir)
    output = docs.select("path", transform.transformed("text", "modified_at").alias("output"))
    scanned = rules.scan_documents(output.where("output is not null"), "output").drop("output")
    return findings.with_fingerprint(rules.flatten_findings(scanned))


def marked_results(spark, sf_dir):
    return scan.scan_corpus(seeds.documents(spark, sf_dir), seeds.allowlist(spark, sf_dir), AT).results


def section():
    return F.substring_index("path", "/", 1).alias("section")


# --- approvals ---------------------------------------------------------------------------

_KEY = "path, line, rule_id, fingerprint"


@check("allowlist_entries", S.with_(S.APPROVALS, f"SELECT {S.ALLOWLIST_COLUMNS.replace(', approved_at, expires_at', '')} FROM allowlist"))
def allowlist_entries(spark, sf_dir):
    return seeds.allowlist_entries(spark, sf_dir).drop("approved_at", "expires_at")


@check(
    "active_at",
    S.with_(
        S.APPROVALS,
        "SELECT path, source_sha256, output_sha256, source_line, output_finding_fingerprint FROM allowlist "
        f"WHERE approved_at <= {S.AT} AND {S.AT} < expires_at",
    ),
)
def active_at(spark, sf_dir):
    return approvals.active_at(seeds.allowlist(spark, sf_dir), AT).select(
        "path", "source_sha256", "output_sha256", "source_line", "output_finding_fingerprint"
    )


@check("apply_source_approvals", S.with_(S.MARKED, f"SELECT {_KEY}, approved FROM s_marked"))
def apply_source_approvals(spark, sf_dir):
    marked = approvals.apply_approvals(source_findings(spark, sf_dir), seeds.allowlist(spark, sf_dir), AT)
    return marked.select("path", "line", "rule_id", "fingerprint", "approved")


@check("apply_output_approvals", S.with_(S.MARKED, f"SELECT {_KEY}, approved FROM o_marked"))
def apply_output_approvals(spark, sf_dir):
    marked = approvals.apply_approvals(
        output_findings(spark, sf_dir), seeds.allowlist(spark, sf_dir), AT, "output"
    )
    return marked.select("path", "line", "rule_id", "fingerprint", "approved")


@check(
    "unapproved_blocking",
    S.with_(S.MARKED, f"SELECT {_KEY} FROM s_marked WHERE level = 'block' AND NOT approved"),
)
def unapproved_blocking(spark, sf_dir):
    kept = approvals.unapproved_blocking(source_findings(spark, sf_dir), seeds.allowlist(spark, sf_dir), AT)
    return kept.select("path", "line", "rule_id", "fingerprint").orderBy("path", "rule_id", "line", "fingerprint")


@check(
    "unapproved_output_blocking",
    S.with_(S.MARKED, f"SELECT {_KEY} FROM o_marked WHERE level = 'block' AND NOT approved"),
)
def unapproved_output_blocking(spark, sf_dir):
    kept = approvals.unapproved_blocking(
        output_findings(spark, sf_dir), seeds.allowlist(spark, sf_dir), AT, "output"
    )
    return kept.select("path", "line", "rule_id", "fingerprint")


@check(
    "pair_findings",
    S.with_(
        S.OUTPUT + S.pairs("s_findings", "o_findings", "paired", "p_"),
        "SELECT path, rule_id, reason, rank, source_line, output_line, output_fingerprint FROM paired",
    ),
)
def pair_findings(spark, sf_dir):
    paired = findings.pair_findings(source_findings(spark, sf_dir), output_findings(spark, sf_dir))
    return paired.select("path", "rule_id", "reason", "rank", "source_line", "output_line", "output_fingerprint")


def named_findings(spark, sf_dir):
    """What a reviewer names: every allowlisted source finding, some misspelled."""
    entries = seeds.allowlist(spark, sf_dir)
    return entries.select(
        "path",
        F.when(F.col("source_line") % 3 == 0, F.reverse("source_finding_fingerprint"))
        .otherwise(F.col("source_finding_fingerprint"))
        .alias("fingerprint"),
    ).distinct()


_NAMED = [
    (
        "named",
        "SELECT DISTINCT path, CASE WHEN source_line % 3 = 0 THEN reverse(source_finding_fingerprint) "
        "ELSE source_finding_fingerprint END AS fingerprint FROM allowlist",
    )
]


@check(
    "lookup_finding",
    S.with_(S.APPROVALS + _NAMED, f"SELECT {_KEY} FROM s_findings WHERE (path, fingerprint) IN (SELECT (path, fingerprint) FROM named)"),
)
def lookup_finding(spark, sf_dir):
    named = named_findings(spark, sf_dir)
    return approvals.lookup_findings(source_findings(spark, sf_dir), named).select("path", "line", "rule_id", "fingerprint")


@check(
    "missing_named_findings",
    S.with_(
        S.APPROVALS + _NAMED,
        "SELECT path, fingerprint FROM named WHERE (path, fingerprint) NOT IN (SELECT (path, fingerprint) FROM s_findings)",
    ),
)
def missing_named_findings(spark, sf_dir):
    return approvals.missing_findings(source_findings(spark, sf_dir), named_findings(spark, sf_dir))


@check(
    "finding_present",
    S.with_(
        S.APPROVALS,
        "SELECT path, source_sha256, source_finding_fingerprint, output_finding_fingerprint FROM allowlist WHERE "
        "(path, source_sha256, source_finding_fingerprint) IN (SELECT (path, sha256, fingerprint) FROM s_findings)",
    ),
)
def finding_present(spark, sf_dir):
    entries = approvals.findings_present(seeds.allowlist(spark, sf_dir), source_findings(spark, sf_dir))
    return entries.select("path", "source_sha256", "source_finding_fingerprint", "output_finding_fingerprint")


@check(
    "approved_rules",
    S.with_(S.OUTCOMES, "SELECT path, rules FROM approved_rules"),
)
def approved_rules(spark, sf_dir):
    docs = seeds.documents(spark, sf_dir)
    output = docs.select("path", transform.transformed("text", "modified_at").alias("output"))
    scanned = rules.scan_documents(output.where("output is not null"), "output").select("path", "sha256", "findings")
    marked = approvals.mark_approved(scanned, seeds.allowlist(spark, sf_dir), AT, "output")
    return marked.select("path", F.array_join(approvals.approved_rules(), ",").alias("rules")).where("rules <> ''")


# Faults planted into allowlist entries, by the first digit of the source finding's fingerprint.
_FAULT = "substr(source_finding_fingerprint, 1, 1)"
_BENT = {
    "path": f"CASE WHEN {_FAULT} = '0' THEN concat('.', path) ELSE path END",
    "source_sha256": f"CASE WHEN {_FAULT} = '1' THEN upper(source_sha256) ELSE source_sha256 END",
    "rule": f"CASE WHEN {_FAULT} = '2' THEN 'path.file-url' WHEN {_FAULT} = '3' THEN '-x' ELSE rule END",
    "level": f"CASE WHEN {_FAULT} = '4' THEN 'warning' ELSE level END",
    "output_line": f"CASE WHEN {_FAULT} = '5' THEN 0 ELSE output_line END",
    "reason": f"CASE WHEN {_FAULT} = '6' THEN concat(reason, ' ') WHEN {_FAULT} = '7' THEN '' ELSE reason END",
    "expires_at": f"CASE WHEN {_FAULT} = '8' THEN approved_at ELSE expires_at END",
}


def bent_allowlist(spark, sf_dir):
    entries = seeds.allowlist(spark, sf_dir)
    bent = entries.selectExpr(*(f"{_BENT[c]} AS {c}" if c in _BENT else c for c in ALLOWLIST.names))
    return bent.unionByName(entries.where("substr(source_finding_fingerprint, 1, 1) = 'f'"))


_BENT_SQL = ", ".join(f"{_BENT[c]} AS {c}" if c in _BENT else c for c in ALLOWLIST.names)
_ENTRY_KEY = "path, source_sha256, source_finding_fingerprint, output_sha256, output_finding_fingerprint, rule"


@check(
    "validate_allowlist",
    S.with_(
        S.APPROVALS
        + [
            ("bent", f"SELECT {_BENT_SQL} FROM allowlist UNION ALL SELECT {S.ALLOWLIST_COLUMNS} FROM allowlist WHERE {_FAULT} = 'f'"),
        ],
        "SELECT * FROM (SELECT path, rule, CASE "
        f"WHEN NOT regexp_matches(path, {S.DOC_PATH}) THEN 'path' WHEN NOT regexp_matches(source_sha256, {S.SHA}) THEN 'source_sha256' "
        f"WHEN NOT regexp_matches(output_sha256, {S.SHA}) THEN 'output_sha256' WHEN NOT regexp_matches(rule, {S.RULE_ID}) THEN 'rule' "
        "WHEN rule <> 'network.private-address' THEN 'rule_not_approvable' WHEN level <> 'block' THEN 'level' "
        f"WHEN source_line <= 0 OR output_line <= 0 THEN 'line' WHEN reason = '' OR {S.trim('reason')} <> reason THEN 'reason' "
        "WHEN expires_at <= approved_at THEN 'expires_at' END AS problem FROM bent) WHERE problem IS NOT NULL UNION ALL "
        f"SELECT path, rule, 'duplicate' FROM bent GROUP BY {_ENTRY_KEY} HAVING count(*) > 1",
    ),
)
def validate_allowlist(spark, sf_dir):
    return approvals.validate_allowlist(bent_allowlist(spark, sf_dir))


@check(
    "upsert_approval",
    S.with_(
        S.APPROVALS,
        f"SELECT {_ENTRY_KEY}, source_line, CASE WHEN source_line % 2 = 0 THEN 'second review' ELSE reason END AS reason FROM allowlist "
        "UNION ALL SELECT 'new/' || path, source_sha256, source_finding_fingerprint, output_sha256, output_finding_fingerprint, rule, "
        f"source_line, 'new' FROM allowlist WHERE {_FAULT} < '8'",
    ),
)
def upsert_approval(spark, sf_dir):
    entries = seeds.allowlist(spark, sf_dir)
    again = entries.where("source_line % 2 = 0")
    additions = (
        again.withColumn("reason", F.lit("second review"))
        .withColumn("batch", F.lit(2))
        .unionByName(again.withColumn("reason", F.lit("first review")).withColumn("batch", F.lit(1)))
        .unionByName(
            entries.where(f"{_FAULT} < '8'")
            .withColumns({"path": F.concat(F.lit("new/"), "path"), "reason": F.lit("new")})
            .withColumn("batch", F.lit(1))
        )
    )
    merged = approvals.upsert_approvals(entries, additions)
    return merged.selectExpr(*_ENTRY_KEY.split(", "), "source_line", "reason")


def review_requests(spark, sf_dir):
    return seeds.written(spark, sf_dir, "requests", lambda: derived_requests(spark, sf_dir))


def derived_requests(spark, sf_dir):
    """One request per document finding a reviewer might name, with planted faults."""
    found = source_findings(spark, sf_dir).where(F.col("level") == V.BLOCK)
    n = F.col("line") % 5
    return found.select(
        "path",
        F.when(n == 0, F.reverse("fingerprint")).otherwise(F.col("fingerprint")).alias("fingerprint"),
        F.when(n == 1, F.lit(" untrimmed")).otherwise(F.lit("reviewed")).alias("reason"),
        F.lit(datetime(2026, 5, 1)).alias("approved_at"),
        F.when(n == 2, F.lit(datetime(2026, 5, 1))).otherwise(F.lit(datetime(2026, 9, 1))).alias("expires_at"),
        F.lit(1).alias("batch"),
    )


_REQUESTS = S.APPROVALS + S.pairs("s_findings", "o_findings", "paired", "p_") + [
    (
        "requests",
        "SELECT path, CASE WHEN line % 5 = 0 THEN reverse(fingerprint) ELSE fingerprint END AS fingerprint, "
        "CASE WHEN line % 5 = 1 THEN ' untrimmed' ELSE 'reviewed' END AS review, line % 5 AS n FROM s_findings WHERE level = 'block'",
    ),
    (
        "checked",
        "SELECT r.path, r.fingerprint, CASE WHEN p.path IS NULL THEN 'finding_missing' WHEN p.source_line <= 0 THEN 'finding_invalid' "
        f"WHEN NOT regexp_matches(r.path, {S.DOC_PATH}) THEN 'finding_invalid' "
        "WHEN NOT (p.level = 'block' AND p.approvable AND p.rule_id = 'network.private-address') THEN 'not_approvable' "
        "WHEN n = 2 THEN 'expires_at' WHEN n = 1 THEN 'reason' END AS problem, p.source_sha256, p.source_line, p.output_sha256, p.output_fingerprint, "
        "p.output_line, p.rule_id FROM requests r LEFT JOIN paired p ON p.path = r.path AND p.source_fingerprint = r.fingerprint",
    ),
]


@check("validate_approval_request", S.with_(_REQUESTS, "SELECT path, fingerprint, problem FROM checked"))
def validate_approval_request(spark, sf_dir):
    checked = approve.paired_requests(
        seeds.documents(spark, sf_dir), review_requests(spark, sf_dir), "text", "modified_at"
    )
    return checked.select("path", "fingerprint", "problem")


@check(
    "approve_findings",
    S.with_(
        _REQUESTS,
        f"SELECT {_ENTRY_KEY}, max(source_line) AS source_line, max_by(reason, b) AS reason FROM (SELECT {_ENTRY_KEY}, source_line, reason, 0 AS b FROM allowlist "
        "UNION ALL SELECT path, source_sha256, fingerprint, output_sha256, output_fingerprint, rule_id, source_line, 'reviewed', 1 "
        f"FROM checked WHERE problem IS NULL) GROUP BY {_ENTRY_KEY}",
    ),
)
def approve_findings(spark, sf_dir):
    outcome = approve.approve_findings(
        seeds.documents(spark, sf_dir), review_requests(spark, sf_dir), seeds.allowlist(spark, sf_dir)
    )
    return outcome.allowlist.selectExpr(*_ENTRY_KEY.split(", "), "source_line", "reason")


# --- reports -------------------------------------------------------------------------------


_SECTION = "split_part(path, '/', 1)"
_COUNTS = (
    f"SELECT {_SECTION} AS section, count(*) AS candidates, count(*) FILTER (NOT blocked) AS passed, count(*) FILTER (blocked) AS excluded, "
    "sum(warnings)::BIGINT AS warnings FROM (SELECT d.path, coalesce(bool_or(f.level = 'block' AND NOT f.approved), false) AS blocked, "
    "count(*) FILTER (f.level = 'warning') AS warnings FROM docs d LEFT JOIN s_marked f ON f.path = d.path GROUP BY d.path) GROUP BY 1"
)


@check("scan_counts", S.with_(S.MARKED, _COUNTS))
def scan_counts(spark, sf_dir):
    return reports.scan_counts(marked_results(spark, sf_dir).withColumn("section", section()), "section")


@check("scan_corpus", S.with_(S.SCAN + [("allowlist", "SELECT '' AS path, '' AS rule, '' AS level, '' AS source_sha256, '' AS source_finding_fingerprint, 0 AS source_line, '' AS output_finding_fingerprint, TIMESTAMP '2000-01-01' AS approved_at, TIMESTAMP '2000-01-01' AS expires_at WHERE false"), S.approved("s_findings", "source", "s_marked")], _COUNTS))
def scan_corpus(spark, sf_dir):
    """Counts per section of a scan without approvals."""
    nothing = spark.createDataFrame([], ALLOWLIST)
    outcome = scan.scan_corpus(seeds.documents(spark, sf_dir), nothing, AT)
    return reports.scan_counts(outcome.results.withColumn("section", section()), "section")


_REPORT = S.MARKED + S.report("s_marked")
_FLAT_REPORT = (
    "SELECT f.path, f.sha256, document_fingerprint, rule, line, fingerprint, level, reason, 'pending' AS status "
    "FROM report_findings f JOIN report_documents d ON d.path = f.path"
)


@check("exclusion_report", S.with_(_REPORT, _FLAT_REPORT))
def exclusion_report(spark, sf_dir):
    return reports.report_findings(reports.exclusion_report(marked_results(spark, sf_dir), AT))


@check("document_fingerprint", S.with_(_REPORT, "SELECT path, document_fingerprint FROM report_documents"))
def document_fingerprint(spark, sf_dir):
    report = reports.exclusion_report(marked_results(spark, sf_dir), AT)
    return report.select("path", F.col("fingerprint").alias("document_fingerprint"))


@check(
    "sort_outputs",
    S.with_(_REPORT, "SELECT path, string_agg(rule || ':' || line, ',' ORDER BY rule, line, fingerprint) AS ordered FROM report_findings GROUP BY path"),
)
def sort_outputs(spark, sf_dir):
    """Canonical orders: findings inside each report row, rows by path."""
    report = reports.sort_documents(reports.exclusion_report(marked_results(spark, sf_dir), AT))
    named = F.transform("findings", lambda f: F.concat(f["rule"], F.lit(":"), f["line"].cast("string")))
    return report.select("path", F.array_join(named, ",").alias("ordered"))


_INVENTORY = (
    "SELECT d.path, d.sha256, CASE WHEN d.path IN (SELECT path FROM s_marked WHERE level = 'block' AND NOT approved) "
    "THEN 'excluded' ELSE 'passed' END AS status, f.rule_id AS rule, f.line, f.fingerprint, f.level, f.approved "
    "FROM docs d LEFT JOIN s_marked f ON f.path = d.path"
)


@check("inventory", S.with_(S.MARKED, _INVENTORY))
def inventory(spark, sf_dir):
    return reports.inventory_findings(reports.inventory_documents(marked_results(spark, sf_dir)))


@check(
    "inventory_header",
    S.with_(
        S.MARKED,
        "SELECT count(*) AS candidate_count, count(*) FILTER (NOT excluded) AS passed_count, count(*) FILTER (excluded) AS excluded_count "
        "FROM (SELECT path IN (SELECT path FROM s_marked WHERE level = 'block' AND NOT approved) AS excluded FROM docs)",
    ),
)
def inventory_header(spark, sf_dir):
    documents = reports.inventory_documents(marked_results(spark, sf_dir))
    return reports.inventory_header(documents, AT).drop("version", "generated_at")


def bent_report(spark, sf_dir):
    """The exclusion report with faults by the first digit of the document digest."""
    report = reports.exclusion_report(marked_results(spark, sf_dir), AT)
    fault = F.substring("sha256", 1, 1)
    bent = report.select(
        F.when(fault == "0", F.lit(9)).otherwise(F.col("version")).alias("version"),
        "generated_at",
        F.when(fault == "1", F.concat(F.lit("../"), "path")).otherwise(F.col("path")).alias("path"),
        F.when(fault == "2", F.upper("sha256")).otherwise(F.col("sha256")).alias("sha256"),
        F.when(fault == "3", F.lit(seeds.ZEROS)).otherwise(F.col("fingerprint")).alias("fingerprint"),
        F.when(fault == "4", F.slice("findings", 1, 0)).otherwise(F.col("findings")).alias("findings"),
        F.when(fault == "5", F.lit(datetime(2020, 1, 1))).otherwise(F.col("detected_at")).alias("detected_at"),
        F.when(fault == "6", F.lit("done")).otherwise(F.col("status")).alias("status"),
    )
    return bent.unionByName(report.where(F.substring("sha256", 1, 1) == "f"))


_DIGIT = "substr(sha256, 1, 1)"


@check(
    "validate_report",
    S.with_(
        _REPORT,
        f"SELECT CASE WHEN {_DIGIT} = '1' THEN '../' ELSE '' END || path AS path, CASE {_DIGIT} WHEN '0' THEN 'version' WHEN '1' THEN 'path' "
        "WHEN '3' THEN 'fingerprint_mismatch' WHEN '4' THEN 'findings' WHEN '5' THEN 'status' WHEN '6' THEN 'status' WHEN 'f' THEN 'duplicate' "
        f"WHEN '2' THEN 'sha256' END AS problem FROM report_documents WHERE {_DIGIT} IN ('0', '1', '3', '4', '5', '6', 'f') "
        f"OR ({_DIGIT} = '2' AND upper(sha256) <> sha256)",
    ),
)
def validate_report(spark, sf_dir):
    return reports.validate_report(bent_report(spark, sf_dir))


@check(
    "validate_results",
    S.with_(
        S.SCAN,
        "SELECT CASE WHEN doc_id % 9 = 2 THEN '.' ELSE '' END || path AS path, CASE doc_id % 9 WHEN 1 THEN 'incomplete' WHEN 2 THEN 'path' "
        "WHEN 3 THEN 'sha256' WHEN 4 THEN 'finding' WHEN 5 THEN 'level' WHEN 6 THEN 'duplicate' END AS problem FROM docs "
        "WHERE doc_id % 9 IN (1, 2, 6) OR (doc_id % 9 = 3 AND upper(sha256) <> sha256) "
        "OR (doc_id % 9 IN (4, 5) AND path IN (SELECT path FROM s_findings))",
    ),
)
def validate_results(spark, sf_dir):
    n = F.col("doc_id") % 9
    results = rules.scan_documents(seeds.documents(spark, sf_dir))
    shaped = F.transform(
        "findings",
        lambda f: F.struct(
            F.when(n == 4, F.lit("elsewhere.md")).otherwise(F.col("path")).alias("path"),
            f["line"].alias("line"),
            f["rule_id"].alias("rule_id"),
            F.when(n == 5, F.lit("info")).otherwise(f["level"]).alias("level"),
        ),
    ).cast("array<struct<path:string,line:bigint,rule_id:string,level:string>>")
    bent = results.select(
        F.explode(F.array_repeat(F.lit(1), F.when(n == 6, 2).otherwise(1))).alias("copy"),
        F.when(n == 2, F.concat(F.lit("."), "path")).otherwise(F.col("path")).alias("path"),
        F.when(n == 3, F.upper("sha256")).otherwise(F.col("sha256")).alias("sha256"),
        (n != 1).alias("completed"),
        shaped.alias("findings"),
    ).drop("copy")
    return reports.validate_results(bent)


# --- stored forms -----------------------------------------------------------------------------


@check("write_exclusion_report", S.with_(_REPORT, _FLAT_REPORT))
def write_exclusion_report(spark, sf_dir):
    target = new_folder(spark, "exclusions")
    results = materialize(marked_results(spark, sf_dir), "results")
    sinks.write_exclusion_report(reports.exclusion_report(results, AT), target)
    return reports.report_findings(strict.load_report(spark, target))


@check("write_inventory", S.with_(S.MARKED, _INVENTORY.replace("LEFT JOIN", "JOIN")))
def write_inventory(spark, sf_dir):
    target = new_folder(spark, "inventory")
    documents = reports.inventory_documents(materialize(marked_results(spark, sf_dir), "results"))
    sinks.write_inventory(documents, AT, target)
    stored = spark.read.schema(documents.schema).json(f"{target}/documents")
    return reports.inventory_findings(stored).where("rule is not null")


@check(
    "save_allowlist",
    S.with_(S.APPROVALS, f"SELECT {S.ALLOWLIST_COLUMNS.replace(', approved_at, expires_at', '')} FROM allowlist"),
)
def save_allowlist(spark, sf_dir):
    target = new_folder(spark, "saved")
    sinks.save_allowlist(seeds.allowlist(spark, sf_dir), target)
    return spark.read.schema(ALLOWLIST).json(target).drop("approved_at", "expires_at")


@check(
    "load_strict",
    S.with_(S.APPROVALS, f"SELECT {S.ALLOWLIST_COLUMNS.replace(', approved_at, expires_at', '')} FROM allowlist"),
)
def load_strict(spark, sf_dir):
    target = new_folder(spark, "strict")
    sinks.save_allowlist(seeds.allowlist(spark, sf_dir), target)
    return strict.load_allowlist(spark, target).drop("approved_at", "expires_at")


@check(
    "strict_violations",
    S.with_(
        S.APPROVALS,
        f"SELECT CASE WHEN {_FAULT} < '4' THEN 'unknown_field' ELSE 'malformed' END AS problem FROM allowlist WHERE {_FAULT} < '8'",
    ),
)
def strict_violations(spark, sf_dir):
    """Stored lines with an added field or cut short are named, the others accepted."""
    entries = seeds.allowlist(spark, sf_dir)
    line = F.to_json(F.struct(*ALLOWLIST.names))
    fault = F.substring("source_finding_fingerprint", 1, 1)
    bent = entries.select(
        F.when(fault < "4", F.regexp_replace(line, r"^\{", '{"extra":1,'))
        .when(fault < "8", F.regexp_replace(line, r"\}$", ""))
        .otherwise(line)
        .alias("value")
    )
    return strict.shape_violations(bent, ALLOWLIST, {})


@check(
    "select_publishable",
    S.with_(
        S.MARKED,
        "SELECT path, sha256 FROM docs WHERE path NOT IN (SELECT path FROM s_marked WHERE level = 'block' AND NOT approved)",
    ),
)
def select_publishable(spark, sf_dir):
    docs = seeds.documents(spark, sf_dir)
    unapproved = approvals.unapproved_blocking(source_findings(spark, sf_dir), seeds.allowlist(spark, sf_dir), AT)
    # Digests only: the text stays out of the join.
    candidates = docs.select("path", text_fns.digest(F.col("text")).alias("sha256"))
    return publish.select_publishable(candidates, unapproved)


@check(
    "scan_with_external",
    S.with_(
        S.MARKED
        + EXTERNAL[1:]
        + [
            (
                "merged",
                "SELECT path, level, approved FROM s_marked UNION ALL SELECT path, level, false FROM (SELECT DISTINCT * FROM external_findings)",
            )
        ],
        _COUNTS.replace("s_marked", "merged"),
    ),
)
def scan_with_external(spark, sf_dir):
    """Counts per section with an outside scanner's findings merged in."""
    outcome = scan.scan_corpus(
        seeds.documents(spark, sf_dir), seeds.allowlist(spark, sf_dir), AT, seeds.receipts(spark, sf_dir)
    )
    return reports.scan_counts(outcome.results.withColumn("section", section()), "section")


_GAPS = (
    "SELECT path, CASE doc_id % 29 WHEN 0 THEN 'unscanned' WHEN 1 THEN 'stale' WHEN 4 THEN 'repeated' ELSE 'incomplete' END AS problem "
    "FROM docs WHERE doc_id % 29 IN (0, 1, 2, 3, 4) UNION ALL SELECT 'gone/' || path, 'unknown' FROM docs WHERE doc_id % 29 = 5"
)


@check("external_incomplete", S.with_(S.DOCS, _GAPS))
def external_incomplete(spark, sf_dir):
    """Gaps of an outside scan: they are in the outcome of the scan, and no report can be written from it."""
    root = new_folder(spark, "refused")
    run = scan.scan_corpus(
        seeds.documents(spark, sf_dir), seeds.allowlist(spark, sf_dir), AT, seeds.faulty_receipts(spark, sf_dir)
    )
    run = replace(run, results=materialize(run.results, "results"))
    try:
        scan.store_reports(run, root)
    except strict.InvalidTable:
        if commit.current(spark, root) is not None:
            raise AssertionError("a refused report is on show") from None
        return run.gaps
    raise AssertionError("reports were written over an incomplete scan")


@check("receipt_gaps", S.with_(S.DOCS, _GAPS))
def receipt_gaps(spark, sf_dir):
    docs = seeds.documents(spark, sf_dir).select("path", text_fns.digest(F.col("text")).alias("sha256"))
    return receipts.receipt_gaps(docs, seeds.faulty_receipts(spark, sf_dir))


@check(
    "reports_commit",
    S.with_(
        _REPORT,
        "SELECT 'exclusions' AS stored, count(*) AS n FROM report_documents UNION ALL SELECT 'documents', count(*) FROM docs "
        "UNION ALL SELECT 'candidates', count(*) FROM docs UNION ALL SELECT 'excluded', count(*) FROM report_documents",
    ),
)
def reports_commit(spark, sf_dir):
    """Two scans committed and one writer that fails: the set of the second is on show, all of it."""
    root = new_folder(spark, "reports")
    results = materialize(marked_results(spark, sf_dir).withColumns({"scan_problem": F.lit(None).cast("string"), "completed": F.lit(True)}), "results")
    few = scan.Scan(results.where("path < 's2'"), AT)
    scan.store_reports(few, root)
    second = scan.store_reports(scan.Scan(results, AT), root)
    broken = reports.exclusion_report(results, AT).withColumn("status", F.lit("closed"))
    try:
        sinks.commit_reports(broken, reports.inventory_documents(results), AT, root)
    except strict.InvalidTable:
        pass
    if commit.current(spark, root) != second:
        raise AssertionError("a failed writer moved the reports")
    stored = sinks.read_reports(spark, root)
    tally = lambda name, frame: frame.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("stored"), "n")
    header = stored.header.selectExpr("stack(2, 'candidates', candidate_count, 'excluded', excluded_count) as (stored, n)")
    return tally("exclusions", stored.exclusions).unionByName(tally("documents", stored.documents)).unionByName(header)


@check(
    "record_approvals",
    S.with_(
        _REQUESTS,
        f"SELECT DISTINCT path, source_sha256, fingerprint AS source_finding_fingerprint, output_sha256, "
        "output_fingerprint AS output_finding_fingerprint, rule_id AS rule FROM checked WHERE problem IS NULL",
    ),
)
def record_approvals(spark, sf_dir):
    """Accepted requests saved in two reviews, the later one from the allowlist that the first one saved."""
    root = new_folder(spark, "allowlists")
    docs = seeds.documents(spark, sf_dir)
    checked = materialize(approve.paired_requests(docs, review_requests(spark, sf_dir), "text", "modified_at"), "requests")
    accepted = checked.where("problem is null").select(*review_requests(spark, sf_dir).columns)
    now = docs.select("path", text_fns.digest(F.col("text")).alias("sha256"))
    for part in ("path < 's3'", "path >= 's3'"):
        approve.record_approvals(docs, accepted.where(part), root, unchanged=now)
    return sinks.read_allowlist(spark, root).selectExpr(*_ENTRY_KEY.split(", "))
