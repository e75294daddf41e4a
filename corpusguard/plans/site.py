"""Check the links and the presentation of a built site."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusguard import fixed_values as V
from corpusguard.operators import links
from corpusguard.session import materialize


def check_site(
    pages: DataFrame,
    files: DataFrame | None = None,
    contract: links.PageContract = links.PageContract(),
) -> DataFrame:
    """Distinct problems ``site, file, kind, target, message`` of ``site, file, html`` pages.

    ``files`` lists every file of the sites if some are not pages.  Links are
    extracted and resolved once; the checks work on the written target table.
    """
    html_pages = links.page_files(pages)
    all_files = (files if files is not None else pages).select("site", "file")
    targets = materialize(links.page_targets(html_pages), "targets")
    none = F.lit(None).cast("string")

    def problem(frame: DataFrame, kind: str, message, target=none) -> DataFrame:
        return frame.select("site", "file", F.lit(kind).alias("kind"), target.alias("target"), message.alias("message"))

    def text(value: str):
        return F.concat("file", F.lit(": " + value))

    outcome = links.page_contract(html_pages, contract)
    failed = outcome.where(
        ~reduce(lambda a, b: a & b, (F.col(c) for c in outcome.columns if c.endswith("_ok")))
    )
    return (
        # Targets are distinct per page already: at most one invalid row each.
        problem(targets.where("status = 'invalid'"), "invalid_link", text(V.PROBLEM_INVALID_LINK))
        .unionByName(
            problem(
                links.broken_links(targets, all_files),
                "missing_target",
                F.concat("file", F.lit(f": {V.PROBLEM_MISSING_TARGET} "), "target"),
                F.col("target"),
            )
        )
        .unionByName(problem(failed, "page_contract", text(V.PROBLEM_HOME_MARKERS)))
        .unionByName(
            problem(links.duplicate_leading_h1(html_pages), "repeated_title", text(V.PROBLEM_REPEATED_TITLE))
        )
    )
