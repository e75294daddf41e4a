"""Receipts of an outside scanner: proof that a document, in these bytes, was scanned to the end.

A receipt is ``path, sha256, completed, findings``.  A finding of an outside scanner counts
only through the receipt of the document it was found in, and a document without exactly
one completed receipt of its present content is not decided on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusguard.functions.text import let
from corpusguard.operators.findings import external_finding
from corpusguard.schemas import FINDINGS

UNSCANNED, REPEATED, STALE, INCOMPLETE, UNKNOWN = "unscanned", "repeated", "stale", "incomplete", "unknown"


def receipt_problem(sha256: Column, receipts: Column) -> Column:
    """Why the receipts of a document's path prove no scan of this content, null if they do."""
    one = F.get(receipts, F.lit(0))
    return (
        F.when(F.coalesce(F.size(receipts), F.lit(0)) <= 0, UNSCANNED)
        .when(F.size(receipts) > 1, REPEATED)
        .when(~one["sha256"].eqNullSafe(sha256), STALE)
        .when(~F.coalesce(one["completed"], F.lit(False)), INCOMPLETE)
    )


def with_external(findings: Column, receipts: Column) -> Column:
    """A document's own findings and those of its receipts, in order.

    External identifiers carry their own prefix and cannot collide with own rules, so each
    side is de-duplicated alone.
    """
    reported = F.flatten(F.transform(receipts, lambda r: r["findings"]))
    extra = F.transform(reported, lambda f: external_finding(f["rule_id"], f["line"]))
    merged = lambda own: F.sort_array(F.concat(own, F.array_distinct(extra).cast(FINDINGS)))
    return let(findings, lambda own: F.when(F.size(reported) > 0, merged(own)).otherwise(own))


def unknown_receipts(documents: DataFrame, receipts: DataFrame) -> DataFrame:
    """Receipts of paths that hold no document; only paths are compared."""
    return (
        receipts.select("path")
        .distinct()
        .join(documents.select("path"), "path", "left_anti")
        .select("path", F.lit(UNKNOWN).alias("problem"))
    )


def receipt_gaps(documents: DataFrame, receipts: DataFrame) -> DataFrame:
    """``path, problem``: documents ``path, sha256`` and receipts that do not prove one another."""
    own = F.struct("sha256", "completed")
    grouped = receipts.groupBy("path").agg(F.collect_list(own).alias("_receipts"))
    proved = documents.select("path", "sha256").join(grouped, "path", "left")
    problems = proved.select("path", receipt_problem(F.col("sha256"), F.col("_receipts")).alias("problem"))
    return problems.where("problem is not null").unionByName(unknown_receipts(documents, receipts))
