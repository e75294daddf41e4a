"""Exact, time-bounded, hash-bound approvals.

The allowlist is reduced to one deciding entry per finding identity before any
join, so findings are never ranked against it, and a join key occurs once per side.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusguard import fixed_values as V
from corpusguard.functions import paths
from corpusguard.functions.fingerprints import finding_fingerprint
from corpusguard.functions.regex import matches_re2
from corpusguard.functions.text import let, trim_space
from corpusguard.operators.findings import is_approvable
from corpusguard.schemas import ALLOWLIST, ENTRY_KEY, ENTRY_ORDER
from corpusguard.session import broadcast_if_measured_small, broadcast_if_small

_DECIDED_BY = ["path", "rule_id", "level", "sha256", "fingerprint", "line"]


def valid_review_reason(reason: Column) -> Column:
    """Non-empty, trimmed, short, printable and free of secret-like text."""
    unsafe = reduce(lambda a, b: a | b, (matches_re2(reason, p) for p in V.UNSAFE_REASON_PATTERNS))
    return (
        (reason != "")
        & (trim_space(reason) == reason)
        & (F.length(reason) <= V.REVIEW_REASON_LIMIT)
        & ~F.rlike(reason, F.lit(r"\p{Cc}"))
        & ~unsafe
    )


def entry_problem(check_reason: bool = True) -> Column:
    """First problem of an allowlist row, null if the row is valid.  Expiry is none."""
    c = F.col
    problem = (
        F.when(~paths.valid_document_path(c("path")), "path")
        .when(~paths.valid_sha256(c("source_sha256")), "source_sha256")
        .when(~paths.valid_sha256(c("output_sha256")), "output_sha256")
        .when(~paths.valid_rule_id(c("rule")), "rule")
        .when(~c("rule").isin(*V.APPROVABLE_RULES), "rule_not_approvable")
        .when(~paths.valid_sha256(c("source_finding_fingerprint")), "source_finding_fingerprint")
        .when(~paths.valid_sha256(c("output_finding_fingerprint")), "output_finding_fingerprint")
        .when(c("level") != V.BLOCK, "level")
        .when((c("source_line") <= 0) | (c("output_line") <= 0), "line")
    )
    if check_reason:
        problem = problem.when(~valid_review_reason(c("reason")), "reason")
    return (
        problem.when(c("approved_at").isNull(), "approved_at")
        .when(F.coalesce(c("expires_at") <= c("approved_at"), F.lit(True)), "expires_at")
        # A null in any checked column makes its test unknown.
        .when(reduce(lambda a, b: a | b, (c(n).isNull() for n in ALLOWLIST.names)), "missing")
    )


def validate_allowlist(allowlist: DataFrame) -> DataFrame:
    """Violations: invalid rows and repeated exact keys."""
    rows = allowlist.select("path", "rule", entry_problem().alias("problem")).where("problem is not null")
    repeated = (
        allowlist.groupBy(*ENTRY_KEY)
        .count()
        .where("count > 1")
        .select("path", "rule", F.lit("duplicate").alias("problem"))
    )
    return rows.unionByName(repeated)


def active_at(entries: DataFrame, at: datetime | Column) -> DataFrame:
    return entries.where(_active(at))


def _active(at: datetime | Column) -> Column:
    instant = at if isinstance(at, Column) else F.lit(at)
    return (F.col("approved_at") <= instant) & (instant < F.col("expires_at"))


def deciding_entries(allowlist: DataFrame, side: str) -> DataFrame:
    """First valid entry in sort order per finding identity on one side.

    An expired first match is not rescued by a later active one.  ``side`` is
    "source" or "output"; the two identities never interchange.
    """
    order = F.struct(*ENTRY_ORDER, "source_line", "output_sha256", "output_line", "approved_at", "expires_at")
    return (
        allowlist.where(entry_problem().isNull())
        .groupBy(
            "path",
            F.col("rule").alias("rule_id"),
            "level",
            F.col(f"{side}_sha256").alias("sha256"),
            F.col(f"{side}_finding_fingerprint").alias("fingerprint"),
            F.col(f"{side}_line").alias("line"),
        )
        .agg(F.min_by(F.struct("approved_at", "expires_at"), order).alias("d"))
        .select(*_DECIDED_BY, "d.approved_at", "d.expires_at")
    )


def active_approvals(allowlist: DataFrame, at: datetime | Column, side: str) -> DataFrame:
    """Finding identities that are approved at the given instant."""
    return deciding_entries(allowlist, side).where(_active(at)).select(*_DECIDED_BY)


def apply_approvals(
    findings: DataFrame, allowlist: DataFrame, at: datetime | Column, side: str = "source"
) -> DataFrame:
    """Add ``approved`` to fingerprinted finding rows of completed scans."""
    allowed = active_approvals(allowlist, at, side).withColumn("_allowed", F.lit(True))
    eligible = (
        F.col("_allowed").isNotNull()
        & is_approvable(F.struct("level", "approvable", "rule_id"))
        & paths.valid_document_path(F.col("path"))
        & (F.col("line") > 0)
    )
    return (
        findings.join(broadcast_if_small(allowed), _DECIDED_BY, "left")
        .withColumn("approved", eligible)
        .drop("_allowed")
    )


def unapproved_blocking(
    findings: DataFrame, allowlist: DataFrame, at: datetime | Column, side: str = "source"
) -> DataFrame:
    """Blocking findings that still exclude their document."""
    blocking = findings.where(F.col("level") == V.BLOCK)
    return apply_approvals(blocking, allowlist, at, side).where(~F.col("approved")).select(findings.columns)


def _identity(sha256: Column, fingerprint: Column, line: Column, rule_id: Column, level: Column) -> Column:
    return F.concat_ws("\0", sha256, fingerprint, F.coalesce(line.cast("string"), F.lit("")), rule_id, level)


def approved_identities(allowlist: DataFrame, at: datetime | Column, side: str) -> DataFrame:
    """``path, identity`` of the findings approved at the given instant."""
    identity = _identity(*(F.col(c) for c in ("sha256", "fingerprint", "line", "rule_id", "level")))
    return active_approvals(allowlist, at, side).select("path", identity.alias("identity"))


def marked(findings: Column, sha256: Column, approved: Column) -> Column:
    """The findings of the row's ``path`` with ``fingerprint`` and ``approved``.

    ``approved`` holds the identities approved for the path (null: none).  Both lists are
    sorted together, and a finding is approved if an approval comes right before it:
    n log n however many there are of both.  Findings of a document differ in line or rule.
    """
    path = F.col("path")
    fields = ("line", "rule_id", "level", "reason", "approvable")

    def fingerprinted(f: Column) -> Column:
        return F.struct(*(f[c].alias(c) for c in fields), finding_fingerprint(path, f).alias("fingerprint"))

    def decided(f: Column, hit: Column) -> Column:
        approves = hit & is_approvable(f) & (f["line"] > 0) & paths.valid_document_path(path)
        return F.struct(*(f[c].alias(c) for c in (*fields, "fingerprint")), approves.alias("approved"))

    def entry(identity: Column, finding: bool, at: Column) -> Column:
        return F.struct(identity.alias("identity"), F.lit(finding).alias("finding"), at.alias("at"))

    def looked_up(own: Column) -> Column:
        asked = F.transform(
            own,
            lambda f, i: entry(_identity(sha256, f["fingerprint"], f["line"], f["rule_id"], f["level"]), True, i),
        )
        given = F.transform(approved, lambda identity: entry(identity, False, F.lit(-1)))
        first = F.array(entry(F.lit(""), True, F.lit(-1)))
        hits = lambda rows: F.zip_with(
            rows,
            F.concat(first, rows),
            lambda row, before: F.struct(
                row["at"].alias("at"), (~before["finding"] & (before["identity"] == row["identity"])).alias("hit")
            ),
        )
        in_order = F.sort_array(F.filter(let(F.sort_array(F.concat(given, asked)), hits), lambda h: h["at"] >= 0))
        return F.zip_with(own, in_order, lambda f, h: decided(f, h["hit"]))

    return let(
        F.transform(findings, fingerprinted),
        lambda own: F.when(F.size(approved) > 0, looked_up(own)).otherwise(
            F.transform(own, lambda f: decided(f, F.lit(False)))
        ),
    )


def mark_approved(
    results: DataFrame,
    allowlist: DataFrame,
    at: datetime | Column,
    side: str = "source",
    sha256: str = "sha256",
    findings: str = "findings",
) -> DataFrame:
    """Add ``fingerprint`` and ``approved`` to each finding inside scan results.

    One join per document instead of one per finding; with active approvals small
    enough to broadcast, their size checked, the documents are not shuffled at all.
    """
    by_path = approved_identities(allowlist, at, side).groupBy("path").agg(F.collect_set("identity").alias("_approved"))
    joined = results.join(broadcast_if_measured_small(by_path, "approved"), "path", "left")
    return joined.withColumn(findings, marked(F.col(findings), F.col(sha256), F.col("_approved"))).drop("_approved")


def has_unapproved(findings: str = "findings") -> Column:
    return F.exists(F.col(findings), lambda f: (f["level"] == V.BLOCK) & ~f["approved"])


def approved_rules(findings: str = "findings") -> Column:
    """Distinct sorted rules with an active approval."""
    approved = F.filter(F.col(findings), lambda f: f["approved"])
    return F.array_sort(F.array_distinct(F.transform(approved, lambda f: f["rule_id"])))


def lookup_findings(findings: DataFrame, named: DataFrame) -> DataFrame:
    """Findings a reviewer names by path and fingerprint."""
    return findings.join(broadcast_if_small(named.select("path", "fingerprint").distinct()), ["path", "fingerprint"], "left_semi")


def missing_findings(findings: DataFrame, named: DataFrame) -> DataFrame:
    """Named findings that the current scan does not hold."""
    return named.join(findings.select("path", "fingerprint"), ["path", "fingerprint"], "left_anti")


def findings_present(entries: DataFrame, findings: DataFrame, side: str = "source") -> DataFrame:
    """Entries whose fingerprint is really among the document's findings."""
    present = findings.select("path", "sha256", "fingerprint").toDF(
        "path", f"{side}_sha256", f"{side}_finding_fingerprint"
    )
    return entries.join(present, present.columns, "left_semi")


def upsert_approvals(allowlist: DataFrame, additions: DataFrame) -> DataFrame:
    """Add or replace by exact key.  ``additions`` carries a ``batch`` number; the later wins.

    Of one batch the entry with the greatest remaining columns wins.  The maximum keeps
    one row per key on the map side already.
    """
    columns = ALLOWLIST.names
    both = allowlist.select(*columns, F.lit(-1).cast("long").alias("batch")).unionByName(
        additions.select(*columns, F.col("batch").cast("long").alias("batch"))
    )
    rest = [c for c in columns if c not in ENTRY_KEY]
    return (
        both.groupBy(*ENTRY_KEY)
        .agg(F.max(F.struct("batch", *rest)).alias("e"))
        .select(*(c if c in ENTRY_KEY else f"e.{c}" for c in columns))
    )


def validate_requests(requests: DataFrame) -> DataFrame:
    """Problems of approval requests joined with both findings.

    Columns ``source_*`` and ``output_*`` hold the two findings (null where the scan
    has none); ``reason`` is the reviewer's text.
    """
    c = F.col

    def bad_side(side: str) -> Column:
        return ~(
            c(f"{side}_completed")
            & paths.valid_document_path(c(f"{side}_path"))
            & paths.valid_sha256(c(f"{side}_sha256"))
            & paths.valid_rule_id(c(f"{side}_rule_id"))
            & (c(f"{side}_line") > 0)
        )

    def not_approvable(side: str) -> Column:
        return ~(
            (c(f"{side}_level") == V.BLOCK)
            & c(f"{side}_approvable")
            & c(f"{side}_rule_id").isin(*V.APPROVABLE_RULES)
        )

    differs = reduce(
        lambda a, b: a | b,
        (
            ~c(f"source_{n}").eqNullSafe(c(f"output_{n}"))
            for n in ("path", "rule_id", "level", "reason", "approvable")
        ),
    )
    return requests.withColumn(
        "problem",
        F.when(c("source_fingerprint").isNull() | c("output_fingerprint").isNull(), "finding_missing")
        .when(F.coalesce(bad_side("source") | bad_side("output"), F.lit(True)), "finding_invalid")
        .when(F.coalesce(not_approvable("source") | not_approvable("output"), F.lit(True)), "not_approvable")
        .when(differs, "findings_differ")
        .when(c("approved_at").isNull(), "approved_at")
        .when(F.coalesce(c("expires_at") <= c("approved_at"), F.lit(True)), "expires_at")
        .when(F.coalesce(~valid_review_reason(c("reason")), F.lit(True)), "reason"),
    )


def sort_entries(allowlist: DataFrame) -> DataFrame:
    return allowlist.orderBy(*ENTRY_ORDER)
