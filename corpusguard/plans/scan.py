"""Scan a corpus: results, exclusion report, inventory and counts."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusguard.operators import receipts, reports, rules, sides
from corpusguard.session import materialize
from corpusguard.sources import sinks
from corpusguard.sources.strict import raise_if_any


@dataclass(frozen=True)
class Scan:
    """Lazy outcome of one scan; every frame is a projection of ``results``."""

    results: DataFrame
    at: datetime | Column
    external: DataFrame | None = None

    @property
    def findings(self) -> DataFrame:
        return rules.flatten_findings(self.results)

    @property
    def exclusions(self) -> DataFrame:
        return reports.exclusion_report(self.results, self.at)

    @property
    def inventory(self) -> DataFrame:
        return reports.inventory_documents(self.results)

    @property
    def gaps(self) -> DataFrame:
        """``path, problem``: documents that the outside scanner did not prove to have scanned, and receipts of none."""
        own = self.results.where("scan_problem is not null").select("path", F.col("scan_problem").alias("problem"))
        if self.external is None:
            return own
        return own.unionByName(receipts.unknown_receipts(self.results, self.external))

    def counts(self, *by: str) -> DataFrame:
        return reports.scan_counts(self.results, *by)


def write_reports(scan: Scan, root: str) -> dict:
    """Store the exclusion report and the inventory of a scan.

    The results are written first: the text is scanned once for all checks and reports.
    """
    return store_reports(replace(scan, results=materialize(scan.results, "results")), root)


def store_reports(scan: Scan, root: str) -> dict:
    """Check stored results, then commit both reports from them in one step."""
    raise_if_any(scan.gaps, "the external scan does not cover the documents")
    raise_if_any(reports.validate_results(scan.results), "scan results are not usable")
    return sinks.commit_reports(scan.exclusions, scan.inventory, scan.at, root)


def scan_corpus(
    documents: DataFrame,
    allowlist: DataFrame,
    at: datetime | Column,
    external: DataFrame | None = None,
    content: str = "text",
    keep: tuple[str, ...] = (),
) -> Scan:
    """Scan ``path, <content>`` rows and mark approved findings.

    The text is read once and dropped in the same stage; only digests and findings
    go on.  ``external`` holds the receipts of an outside scanner: a document without one
    completed receipt of its content is not ``completed``, and no report is written then.
    Write ``results`` once if several of the outcomes are wanted.
    """
    scanned = rules.scan_documents(documents, content).select("path", "sha256", "findings", *keep)
    given = {} if external is None else {sides.SOURCE: external}
    joined = sides.join_sides(scanned, sides.side_table(allowlist, at, given, (sides.SOURCE,)))
    decided = sides.decide_side(joined, sides.SOURCE, "sha256", "findings", external is not None)
    problem = F.col(sides.problem_column(sides.SOURCE))
    results = decided.select("path", "sha256", "findings", *keep, problem.alias("scan_problem"), problem.isNull().alias("completed"))
    return Scan(results, at, external)
