"""Stable identities derived from redacted metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusguard.functions.text import digest

_NUL = "\0"


def finding_fingerprint(path: Column, finding: Column) -> Column:
    """SHA-256 over path, rule, level, line, reason and the approvable flag."""
    return digest(
        F.concat_ws(
            _NUL,
            path,
            finding["rule_id"],
            finding["level"],
            finding["line"].cast("string"),
            finding["reason"],
            finding["approvable"].cast("string"),
        )
    )


def document_fingerprint(path: Column, sha256: Column, findings: Column) -> Column:
    """SHA-256 over the document identity and its ordered report findings."""
    parts = F.transform(
        findings,
        lambda f: F.concat_ws(
            _NUL, f["fingerprint"], f["rule"], f["level"], f["line"].cast("string"), f["reason"]
        ),
    )
    return digest(F.concat_ws(_NUL, path, sha256, F.array_join(parts, _NUL)))
