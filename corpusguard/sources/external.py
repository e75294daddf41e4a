"""Hook for an independent scanner."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusguard.schemas import RECEIPT

# Returns a scanner for one task: path and content bytes of a document -> (rule id, line) pairs, or None if it
# could not finish the document.
ScannerFactory = Callable[[], Callable[[str, bytes], list[tuple[str, int]] | None]]


def scan_externally(documents: DataFrame, factory: ScannerFactory, content: str = "content") -> DataFrame:
    """One receipt ``path, sha256, completed, findings`` per document of a pluggable scanner.

    The digest is that of the very bytes the scanner was given.  The scanner is created once
    per task.  An exception fails the whole run: an unavailable scanner never turns into a
    per-document exclusion.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = factory()
        for batch in batches:
            rows = []
            for path, data in zip(batch["path"], batch["content"]):
                data = b"" if data is None else bytes(data)
                found = find(path, data)
                findings = [{"rule_id": rule, "line": int(line)} for rule, line in found or ()]
                rows.append((path, hashlib.sha256(data).hexdigest(), found is not None, findings))
            yield pd.DataFrame(rows, columns=RECEIPT.names)

    source = documents.selectExpr("path", f"cast({content} as binary) as content")
    return source.mapInPandas(scan, RECEIPT)


def run_external_scanner(documents: DataFrame, factory: ScannerFactory, content: str = "content") -> DataFrame:
    """``path, rule_id, line`` found by a pluggable scanner, without its receipts."""
    receipts = scan_externally(documents, factory, content)
    return receipts.select("path", F.explode("findings").alias("f")).select("path", "f.rule_id", "f.line")
