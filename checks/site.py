"""Queries over the seeded HTML site."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import seeds
from checks import sql as S
from checks.base import check
from corpusguard import fixed_values as V
from corpusguard.functions.html import positive_attribute
from corpusguard.operators import links
from corpusguard.plans.site import check_site as check_site_job


@check("page_files", S.with_(S.PAGES, "SELECT site, file FROM (SELECT site, CASE WHEN page_id % 4 = 1 THEN file || '.HTML' WHEN page_id % 4 = 2 THEN file || '.css' ELSE file END AS file FROM site_pages) WHERE lower(regexp_extract(file, '\\.[^./]*$')) = '.html'"))
def page_files(spark, sf_dir):
    n = F.col("page_id") % 4
    named = F.when(n == 1, F.concat("file", F.lit(".HTML"))).when(n == 2, F.concat("file", F.lit(".css")))
    pages = seeds.pages(spark, sf_dir).withColumn("file", F.coalesce(named, "file"))
    return links.page_files(pages).select("site", "file")


@check("extract_page_links", S.with_(S.LINKS, "SELECT site, file, raw FROM links"))
def extract_page_links(spark, sf_dir):
    return links.extract_page_links(seeds.pages(spark, sf_dir))


@check("html_unescape", S.with_(S.LINKS, "SELECT site, count(*) AS links, count(*) FILTER (contains(raw, '&')) AS with_ampersand FROM links GROUP BY site"))
def html_unescape(spark, sf_dir):
    found = links.extract_page_links(seeds.pages(spark, sf_dir))
    ampersand = F.contains("raw", F.lit("&")).cast("long")
    return found.groupBy("site").agg(F.count(F.lit(1)).alias("links"), F.sum(ampersand).alias("with_ampersand"))


@check("resolve_link", S.with_(S.RESOLVED, "SELECT site, file, raw, status, target FROM resolved"))
def resolve_link(spark, sf_dir):
    return links.resolve_links(links.extract_page_links(seeds.pages(spark, sf_dir)))


@check("existing_target", S.with_(S.TARGETS, "SELECT site, target, found FROM existing"))
def existing_target(spark, sf_dir):
    pages = seeds.pages(spark, sf_dir)
    internal = links.page_targets(pages).where("status = 'internal'")
    return links.existing_targets(internal, pages)


@check("broken_links", S.with_(S.TARGETS, "SELECT site, file, target FROM broken"))
def broken_links(spark, sf_dir):
    pages = seeds.pages(spark, sf_dir)
    return links.broken_links(links.page_targets(pages), pages)


_CONTRACT = (
    f"contains(html, {S.lit(V.STATS_MARKER)}) AS marker_ok, {S.positive('document_count')} AS document_count_ok, "
    f"{S.positive('category_count')} AS category_count_ok, "
    f"(length(html) - length(replace(html, {S.lit(V.FEATURE_MARKER)}, ''))) = {V.FEATURE_COUNT * len(V.FEATURE_MARKER)} AS count_ok"
)


@check("page_contract", S.with_(S.PAGES, f"SELECT site, file, {_CONTRACT} FROM site_pages WHERE file = 'index.html'"))
def page_contract(spark, sf_dir):
    return links.page_contract(seeds.pages(spark, sf_dir))


@check(
    "positive_attribute",
    S.with_(
        S.PAGES,
        f"SELECT site, file, {S.positive('document_count')} AS documents, {S.positive('category_count')} AS categories FROM site_pages",
    ),
)
def positive_attribute_query(spark, sf_dir):
    html = F.col("html")
    return seeds.pages(spark, sf_dir).select(
        "site",
        "file",
        positive_attribute(html, "document_count").alias("documents"),
        positive_attribute(html, "category_count").alias("categories"),
    )


@check("normalize_heading", S.with_(S.HEADINGS, "SELECT site, file, h[1] AS first, h[2] AS second FROM headings WHERE len(h) > 0"))
def normalize_heading(spark, sf_dir):
    headings = F.col("headings")
    return links.page_headings(seeds.pages(spark, sf_dir)).select(
        "site", "file", F.get(headings, F.lit(0)).alias("first"), F.get(headings, F.lit(1)).alias("second")
    ).where("first is not null")


@check("duplicate_leading_h1", S.with_(S.HEADINGS, "SELECT site, file, h[1] AS heading FROM headings WHERE h[1] = h[2] AND h[1] <> ''"))
def duplicate_leading_h1(spark, sf_dir):
    return links.duplicate_leading_h1(seeds.pages(spark, sf_dir))


@check(
    "check_site",
    S.with_(
        S.TARGETS + S.HEADINGS[1:],
        f"SELECT DISTINCT site, file, 'invalid_link' AS kind, NULL AS target, file || ': ' || {S.lit(V.PROBLEM_INVALID_LINK)} AS message FROM resolved WHERE status = 'invalid' "
        f"UNION ALL SELECT site, file, 'missing_target', target, file || ': ' || {S.lit(V.PROBLEM_MISSING_TARGET)} || ' ' || target FROM broken "
        f"UNION ALL SELECT site, file, 'page_contract', NULL, file || ': ' || {S.lit(V.PROBLEM_HOME_MARKERS)} FROM (SELECT site, file, {_CONTRACT} FROM site_pages "
        "WHERE file = 'index.html') WHERE NOT (marker_ok AND document_count_ok AND category_count_ok AND count_ok) "
        f"UNION ALL SELECT site, file, 'repeated_title', NULL, file || ': ' || {S.lit(V.PROBLEM_REPEATED_TITLE)} FROM headings WHERE h[1] = h[2] AND h[1] <> ''",
    ),
)
def check_site(spark, sf_dir):
    return check_site_job(seeds.pages(spark, sf_dir))
