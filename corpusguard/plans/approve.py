"""Record reviewed approvals in a new allowlist."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusguard.functions.text import compute_once, trim_space
from corpusguard.operators import approvals, findings as finding_ops, rules, transform
from corpusguard.plans.publish import Ruleset, require_same_rules, ruleset_digest
from corpusguard.schemas import ALLOWLIST
from corpusguard.session import broadcast_if_measured_small, materialize
from corpusguard.sources import commit, sinks
from corpusguard.sources.strict import raise_if_any


@dataclass(frozen=True)
class Approval:
    requests: DataFrame
    allowlist: DataFrame

    @property
    def problems(self) -> DataFrame:
        return self.requests.where("problem is not null").select("path", "fingerprint", "problem")


def document_pairs(documents: DataFrame, content: str, modified: str) -> DataFrame:
    """``path, source_sha256, output_sha256, pair``: findings before and after the transform, aligned in the document's row.

    The text is read once: both scans and the transform between them are one narrow stage.
    """
    scanned = rules.scan_documents(documents, content)
    output = transform.transformed(content, modified).alias("output")
    both = rules.scan_documents(
        scanned.select("path", "sha256", "findings", output), "output", "output_sha256", "output_findings"
    )
    paired = compute_once(both, "pairs", finding_ops.aligned_pairs(F.col("path"), F.col("findings"), F.col("output_findings")))
    exploded = paired.select("path", "sha256", "output_sha256", F.explode_outer("pairs").alias("pair"))
    return exploded.where("pair is not null").withColumnRenamed("sha256", "source_sha256")


def paired_requests(documents: DataFrame, requests: DataFrame, content: str, modified: str) -> DataFrame:
    """Requests with both sides of the finding they name, and the problem if there is one.

    Only documents that a request names are scanned.
    """
    named = documents.join(broadcast_if_measured_small(requests.select("path").distinct(), "requested"), "path", "left_semi")
    pairs = document_pairs(named, content, modified).select(
        "path",
        F.col("pair.source_fingerprint").alias("fingerprint"),
        *(
            column.alias(f"{side}_{name}")
            for side in ("source", "output")
            for name, column in (
                ("completed", F.lit(True)),
                ("path", F.col("path")),
                ("sha256", F.col(f"{side}_sha256")),
                ("line", F.col(f"pair.{side}_line")),
                ("rule_id", F.col("pair.rule_id")),
                ("level", F.col("pair.level")),
                ("reason", F.col("pair.reason")),
                ("approvable", F.col("pair.approvable")),
                ("fingerprint", F.col(f"pair.{side}_fingerprint")),
            )
        ),
    )
    return approvals.validate_requests(requests.join(pairs, ["path", "fingerprint"], "left"))


def approve_findings(
    documents: DataFrame,
    requests: DataFrame,
    allowlist: DataFrame,
    content: str = "text",
    modified: str = "modified_at",
) -> Approval:
    """Requests ``path, fingerprint, reason, approved_at, expires_at, batch`` -> new allowlist.

    Refused requests are listed in ``problems`` and leave the allowlist as it is.
    """
    return _approval(paired_requests(documents, requests, content, modified), allowlist)


def _approval(checked: DataFrame, allowlist: DataFrame) -> Approval:
    entries = checked.where("problem is null").select(
        "path",
        "source_sha256",
        F.col("source_fingerprint").alias("source_finding_fingerprint"),
        "source_line",
        "output_sha256",
        F.col("output_fingerprint").alias("output_finding_fingerprint"),
        "output_line",
        F.col("source_rule_id").alias("rule"),
        F.col("source_level").alias("level"),
        trim_space(F.col("reason")).alias("reason"),
        "approved_at",
        "expires_at",
        "batch",
    )
    return Approval(checked, approvals.upsert_approvals(allowlist, entries).select(*ALLOWLIST.names))


def require_accepted(approval: Approval) -> None:
    raise_if_any(approval.problems, "approval requests were refused")


def record_approvals(
    documents: DataFrame,
    requests: DataFrame,
    root: str,
    content: str = "text",
    modified: str = "modified_at",
    unchanged: DataFrame | None = None,
    ruleset: Ruleset | None = None,
) -> dict:
    """Check the requests and save the new allowlist under ``root``; all of them or none.

    ``unchanged`` is a second discovery ``path, sha256``: a named document that is gone or
    reads differently by now stops the save, as does a ``ruleset`` that changed.  Of two
    reviews that started from the same allowlist one fails and has to be run again.
    """
    spark = documents.sparkSession
    last, _ = commit.state(spark, root)
    before = ruleset_digest(ruleset) if ruleset is not None else None
    allowlist = sinks.read_allowlist(spark, root) if last else spark.createDataFrame([], ALLOWLIST)
    # Written once: the text is not scanned again for the problems, the drift and the entries.
    approval = _approval(materialize(paired_requests(documents, requests, content, modified), "requests"), allowlist)
    require_accepted(approval)
    if unchanged is not None:
        reviewed = approval.requests.select("path", F.col("source_sha256").alias("sha256")).distinct()
        now = unchanged.select("path", F.col("sha256").alias("now"))
        drift = reviewed.join(now, "path", "left").where(~F.col("sha256").eqNullSafe(F.col("now")))
        raise_if_any(drift.select("path"), "documents changed during the review")
    if ruleset is not None:
        require_same_rules(ruleset, before)
    return sinks.commit_allowlist(approval.allowlist, root, last)
