"""Scanning documents as they arrive.

The content rules are stateless per document, so the scan runs unchanged on a
streaming frame: no state, no watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from corpusguard.operators.rules import flatten_findings, scan_documents


def stream_findings(documents: DataFrame, content: str = "text") -> DataFrame:
    return flatten_findings(scan_documents(documents, content))


def write_findings(documents: DataFrame, target: str, checkpoint: str, content: str = "text") -> StreamingQuery:
    """Append findings of new documents to a parquet folder, exactly once."""
    return (
        stream_findings(documents, content)
        .writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
