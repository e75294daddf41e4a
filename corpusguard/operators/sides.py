"""What is known from outside about each document, as one narrow row per path.

Approvals and receipts of both sides (source and output) meet in this table first, so a
document meets them in one join, and text moves at most once.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusguard.operators import approvals, receipts as proofs
from corpusguard.schemas import RECEIPT
from corpusguard.session import broadcast_if_measured_small

SOURCE, OUTPUT = "source", "output"
_RECEIPT = RECEIPT.simpleString().replace("path:string,", "")


def approved_column(side: str) -> str:
    return f"_{side}_approved"


def receipts_column(side: str) -> str:
    return f"_{side}_receipts"


def problem_column(side: str) -> str:
    return f"_{side}_problem"


def side_table(
    allowlist: DataFrame, at: datetime | Column, receipts: dict[str, DataFrame], sides: tuple[str, ...] = (SOURCE, OUTPUT)
) -> DataFrame:
    """``path`` with the approved identities and the receipts of each side.

    A group is what one document was approved for and scanned as; sets are combined on the map side.
    """
    none = F.lit(None)
    rows = [
        approvals.approved_identities(allowlist, at, side).select(
            "path", F.lit(side).alias("side"), "identity", none.cast(_RECEIPT).alias("receipt")
        )
        for side in sides
    ] + [
        frame.select(
            "path",
            F.lit(side).alias("side"),
            none.cast("string").alias("identity"),
            F.struct(*(c for c in RECEIPT.names if c != "path")).cast(_RECEIPT).alias("receipt"),
        )
        for side, frame in receipts.items()
    ]
    collected = [F.collect_set(F.when(F.col("side") == side, F.col("identity"))).alias(approved_column(side)) for side in sides]
    collected += [F.collect_list(F.when(F.col("side") == side, F.col("receipt"))).alias(receipts_column(side)) for side in receipts]
    return reduce(DataFrame.unionByName, rows).groupBy("path").agg(*collected)


def join_sides(documents: DataFrame, table: DataFrame) -> DataFrame:
    """The documents with their row of the side table: broadcast if its measured size allows, one shuffle otherwise."""
    return documents.join(broadcast_if_measured_small(table, "sides"), "path", "left")


def decide_side(documents: DataFrame, side: str, sha256: str, findings: str, proved: bool) -> DataFrame:
    """Mark the findings of one side and add ``_<side>_problem``, why its outside scan proves nothing.

    Without an outside scanner (``proved`` false) there is no problem.
    """
    own, problem = F.col(findings), F.lit(None).cast("string")
    if proved:
        receipts = F.col(receipts_column(side))
        own = proofs.with_external(own, receipts)
        problem = proofs.receipt_problem(F.col(sha256), receipts)
    approved = F.col(approved_column(side))
    return documents.withColumns(
        {findings: approvals.marked(own, F.col(sha256), approved), problem_column(side): problem}
    )
