"""Internal links and page presentation of a built site.

Pages are ``site, file, html``; ``site`` is the host the page tree is served from,
so a table may hold many sites.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusguard import fixed_values as V
from corpusguard.functions import paths, urls
from corpusguard.functions.html import collapse_space, positive_attribute, strip_tags, unescape_all
from corpusguard.functions.regex import extract_all, java_pattern
from corpusguard.functions.text import compute_once, contains_any, count_of, let, trim_space

# Tasks that share the links to one hot missing target.
_SALTS = 16


def page_files(pages: DataFrame) -> DataFrame:
    return pages.where(F.lower(paths.extension(F.col("file"))) == ".html")


def _attribute_values(page: Column) -> Column:
    """Distinct href and src values of a page, trimmed, still escaped.

    One pass finds the attributes; their values are cut from the short matches.
    """
    pattern = java_pattern(V.PAGE_PATTERNS["attribute"])
    value = lambda match: F.concat(*(F.regexp_extract(match, pattern, g) for g in (1, 2, 3)))
    return F.array_distinct(
        F.transform(F.array_distinct(extract_all(page, "attribute", 0)), lambda m: trim_space(value(m)))
    )


def page_link_arrays(pages: DataFrame) -> DataFrame:
    """Pages with the ``links`` array; repeated links of a page are dropped in its row."""
    raw = compute_once(pages.select("site", "file", "html"), "raw", _attribute_values(F.col("html"))).select(
        "site", "file", "raw"
    )
    needed = F.exists("raw", lambda v: F.contains(v, F.lit("&")))
    return raw.select("site", "file", unescape_all(F.col("raw"), needed).alias("links"))


def extract_page_links(pages: DataFrame) -> DataFrame:
    """One row per distinct link of each page."""
    return page_link_arrays(pages).select("site", "file", F.explode_outer("links").alias("raw")).where(
        F.col("raw").isNotNull()
    )


def resolve_link(site: Column, file: Column, raw: Column) -> Column:
    """``struct(status, target)`` with status external, invalid or internal.

    ``target`` is relative to the site root.
    """

    def located(decoded: Column) -> Column:
        rooted = F.startswith(decoded, F.lit("/"))
        joined = F.when(rooted, paths.clean_relative(decoded)).otherwise(
            paths.clean_relative(F.concat(paths.directory(file), F.lit("/"), decoded))
        )
        return let(
            joined,
            lambda target: F.when(paths.escapes(target), _resolved("invalid")).otherwise(
                _resolved("internal", target)
            ),
        )

    def by_url(url: Column) -> Column:
        other_host = (url["scheme"] != "") & (
            ~url["scheme"].isin("http", "https") | (urls.hostname(url["authority"]) != F.lower(site))
        )
        return (
            F.when(~url["valid"], _resolved("invalid"))
            .when(other_host | (url["path"] == ""), _resolved("external"))
            .otherwise(located(url["path"]))
        )

    outside = (raw == "") | F.startswith(raw, F.lit("#")) | F.startswith(raw, F.lit("//"))
    return F.when(outside, _resolved("external")).otherwise(let(urls.split_url(raw), by_url))


def _resolved(status: str, target: Column | None = None) -> Column:
    return F.struct(
        F.lit(status).alias("status"),
        (F.lit(None).cast("string") if target is None else target).alias("target"),
    )


def resolve_links(links: DataFrame) -> DataFrame:
    resolved = compute_once(links, "r", resolve_link(F.col("site"), F.col("file"), F.col("raw")))
    return resolved.select("site", "file", "raw", "r.status", "r.target")


def site_directories(files: DataFrame) -> DataFrame:
    """Directories of a site: the ancestors of its files and the root."""
    direct = files.select("site", paths.directory(F.col("file")).alias("target")).distinct()
    return direct.select(
        "site",
        F.explode(F.concat(F.array(F.lit("."), "target"), paths.ancestors(F.col("target")))).alias("target"),
    ).distinct()


def existing_targets(targets: DataFrame, files: DataFrame) -> DataFrame:
    """Distinct targets with ``found``, the file each resolves to, or null.

    A directory counts only through its ``index.html``; otherwise the exact file,
    then the file with ``.html`` appended.  Every alternative is a row keyed by the
    name it needs, so one join with the site's names answers all of them.
    """
    target = F.col("target")
    index = F.when(target == ".", F.lit("index.html")).otherwise(F.concat(target, F.lit("/index.html")))
    options = (
        targets.select("site", "target")
        .distinct()
        .select(
            "site",
            "target",
            F.posexplode(F.array(index, target, F.concat(target, F.lit(".html")))).alias("rank", "name"),
        )
    )
    names = files.select("site", F.col("file").alias("name"), F.lit(False).alias("is_directory")).unionByName(
        site_directories(files).select("site", F.col("target").alias("name"), F.lit(True).alias("is_directory"))
    )
    file_of = lambda rank: F.max(
        F.when((F.col("rank") == rank) & ~F.col("is_directory"), F.col("name"))
    )
    looked_up = (
        options.join(names, ["site", "name"], "left")
        .groupBy("site", "target")
        .agg(
            file_of(0).alias("index"),
            file_of(1).alias("exact"),
            file_of(2).alias("page"),
            F.max(F.when((F.col("rank") == 1) & F.col("is_directory"), True)).alias("is_directory"),
        )
    )
    plain = F.when(F.col("is_directory").isNull(), F.coalesce("exact", "page"))
    return looked_up.select("site", "target", F.coalesce("index", plain).alias("found"))


def page_targets(pages: DataFrame) -> DataFrame:
    """Distinct ``site, file, status, target`` of every page's links.

    Links are resolved and de-duplicated inside the page's row, so nothing is shuffled.
    """
    resolved = compute_once(
        page_link_arrays(pages),
        "resolved",
        F.array_distinct(
            F.transform("links", lambda raw: resolve_link(F.col("site"), F.col("file"), raw))
        ),
    )
    return (
        resolved.select("site", "file", F.explode_outer("resolved").alias("r"))
        .where("r is not null")
        .select("site", "file", "r.status", "r.target")
    )


def broken_links(targets: DataFrame, files: DataFrame) -> DataFrame:
    """Page and target pairs of ``page_targets`` whose target does not exist.

    Targets are checked once each.  Only those without a file meet the links again,
    and a missing target linked from very many pages is spread over salted keys: the
    repeated side is the short list of missing targets.
    """
    internal = targets.where("status = 'internal'").select("site", "file", "target")
    missing = existing_targets(internal, files).where("found is null").select("site", "target")
    salted = internal.withColumn("salt", F.pmod(F.xxhash64("file"), F.lit(_SALTS)).cast("int"))
    every_salt = missing.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    return salted.join(every_salt, ["site", "target", "salt"], "left_semi").select("site", "file", "target")


@dataclass(frozen=True)
class PageContract:
    """What a named page must hold."""

    file: str = "index.html"
    marker: str = V.STATS_MARKER
    positive: Sequence[str] = field(default=("document_count", "category_count"))
    counted: str = V.FEATURE_MARKER
    count: int = V.FEATURE_COUNT


def page_contract(pages: DataFrame, contract: PageContract = PageContract()) -> DataFrame:
    """Named pages with the outcome of each part of the contract."""
    html = F.col("html")
    parts = [F.contains(html, F.lit(contract.marker)).alias("marker_ok")]
    parts += [positive_attribute(html, name).alias(f"{name}_ok") for name in contract.positive]
    parts.append((count_of(html, contract.counted) == contract.count).alias("count_ok"))
    return pages.where(F.col("file") == contract.file).select("site", "file", *parts)


def page_headings(pages: DataFrame) -> DataFrame:
    """Section index pages with their first two normalised headings."""
    in_docs = F.startswith("file", F.lit("docs/")) & (paths.base(F.col("file")) == "index.html")
    found = compute_once(
        pages.where(in_docs & contains_any(F.lower("html"), "<h1")),
        "h",
        F.slice(F.filter(extract_all(F.col("html"), "heading", 1), lambda h: h != ""), 1, 2),
    ).select("site", "file", "h")
    closing = len("</h1>")
    plain = F.transform("h", lambda h: strip_tags(F.left(h, F.length(h) - closing)))
    needed = F.exists("h", lambda v: F.contains(v, F.lit("&")))
    texts = found.select("site", "file", unescape_all(plain, needed).alias("h"))
    return texts.select("site", "file", F.transform("h", collapse_space).alias("headings"))


def duplicate_leading_h1(pages: DataFrame) -> DataFrame:
    """Section pages whose first two headings are equal and not empty."""
    headings = F.col("headings")
    first, second = F.get(headings, F.lit(0)), F.get(headings, F.lit(1))
    return page_headings(pages).where((first != "") & (first == second)).select("site", "file", first.alias("heading"))
