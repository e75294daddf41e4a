"""Seeded inputs: the given tables with deterministic additions.

The given documents hardly touch the rules.  Every document and page is kept whole
and gets text appended by its number; ``oracle.py`` applies the same additions.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusguard.functions.text import compute_once, digest
from corpusguard.operators import findings as finding_ops, rules, transform
from corpusguard.session import broadcast_if_measured_small, fill_cores, materialize

AT = datetime(2026, 6, 1)
SCANNER_VERSION = "8.0.0"
ZEROS = "0" * 64

PREFIXES = ["", "", "", "# Titel ###\r\n\r\n", "---\ntitle: t\n---\n", "---\nopen\n", "a\0\n"]

# Secret-like seeds are put together here so that no scanner flags this file.
SEEDS = [
    "nothing to report in this line",
    "tok" + "en: " + "'seven blue lanterns'",
    "mysql://reader:" + "quiet-harbour" + "@store.example.net/reports",
    "AK" + "IA" + "Q7" * 8,
    "-----BEGIN " + "EC PRIVATE KEY-----",
    "ping 172.20.4.9 twice",
    "route via fd12:3::7",
    "printer.lan is off",
    "copied to /opt/tools/bin yesterday",
    "kept in E:\\reports\\may.csv",
    "open file://host/share/doc",
    "see [[Other page]] first",
    "<form>x</form>",
    "<p onmouseover=hint()>",
    "![chart](https://static.example.org/c/1.svg)",
    "![map](maps/north.png)",
    "[up](../../../../../outside/notes.md)",
    "[data]: ../tables/sums.csv",
    "<img src='/Library/pics/e.png'>",
    "~~~ sh\nls",
    "```\n~~~\n```",
    "# Notes on F#\n\ntext",
    "[p](q%2525r.md) [s](5%25.md) [t](gopher://old/x)",
    "[near](../d4/page.md) [find](?term=x) [write](mailto:desk@example.org)",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return fill_cores(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def pick(values: list[str], index: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), index.cast("int"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, path, text, modified_at`` of the seeded corpus."""
    n = F.col("doc_id")
    section = F.concat(F.lit("s"), n % 5)
    plain = F.concat(section, F.lit("/t"), n % 3, F.lit("/d"), n, F.lit(".md"))
    reserved = F.concat(section, F.lit("/d"), n, F.lit("/_index.md"))
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(n % 97 == 0, reserved).otherwise(plain).alias("path"),
        F.concat(pick(PREFIXES, n % 7), "text", F.lit("\n"), pick(SEEDS, n % 24)).alias("text"),
        F.timestamp_seconds(F.lit(1767225600) + (n % 5000) * 60).alias("modified_at"),
    )


def _approvable(scanned: DataFrame) -> DataFrame:
    return finding_ops.with_fingerprint(finding_ops.approvable_findings(rules.flatten_findings(scanned)))


def allowlist_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries for the approvable findings of the seeded corpus, by ``(doc_id div 24) % 4``.

    0 active, 1 expired, 2 wrong digests, 3 an active entry behind expired ones that
    sort before it, one on each side.
    """
    docs = documents(spark, sf_dir)
    left = materialize(_approvable(rules.scan_documents(docs).drop("text")), "approvable")
    # A pair needs a finding on either side, so only paths with one before the transform are scanned after it.
    paths = broadcast_if_measured_small(left.select("path").distinct(), "paths")
    found = docs.join(paths, "path", "left_semi")
    output = compute_once(found, "output", transform.transformed("text", "modified_at")).select("path", "output")
    right = _approvable(rules.scan_documents(output.where("output is not null"), "output"))
    number = F.regexp_extract("path", r"d([0-9]+)(?:/_index)?\.md$", 1).cast("long")
    pairs = finding_ops.pair_findings(left, right).withColumn("kind", F.floor(number / 24) % 4)
    variants = F.when(F.col("kind") == 3, F.array(*map(F.lit, ("as is", "output behind", "source behind"))))
    rows = pairs.withColumn("variant", F.explode(F.coalesce(variants, F.array(F.lit("as is")))))
    wrong, variant = F.col("kind") == 2, F.col("variant")
    expired = (F.col("kind") == 1) | (variant != "as is")

    def zeros_if(test: Column, column: str) -> Column:
        return F.when(test, F.lit(ZEROS)).otherwise(F.col(column))

    return rows.select(
        "path",
        zeros_if(wrong | (variant == "source behind"), "source_sha256").alias("source_sha256"),
        F.col("source_fingerprint").alias("source_finding_fingerprint"),
        "source_line",
        zeros_if(wrong, "output_sha256").alias("output_sha256"),
        zeros_if(variant == "output behind", "output_fingerprint").alias("output_finding_fingerprint"),
        "output_line",
        F.col("rule_id").alias("rule"),
        "level",
        F.lit("reviewed test address").alias("reason"),
        F.when(expired, F.lit(datetime(2025, 1, 1))).otherwise(F.lit(datetime(2026, 1, 1))).alias("approved_at"),
        F.when(expired, F.lit(datetime(2026, 1, 1))).otherwise(F.lit(datetime(2027, 1, 1))).alias("expires_at"),
    )


_WRITTEN: dict[tuple, DataFrame] = {}


def written(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """A derived input written once per session, as a real run would find it stored."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _WRITTEN:
        _WRITTEN[key] = materialize(build(), name)
    return _WRITTEN[key]


def allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(spark, sf_dir, "allowlist", lambda: allowlist_entries(spark, sf_dir))


def external(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of an outside scanner: some repeated, some with odd identifiers and lines."""
    n = F.col("doc_id")
    rows = documents(spark, sf_dir).where(n % 11 == 0)
    return rows.select(
        "path",
        F.when(n % 2 == 0, " aws key/").when(n % 3 == 0, "--").otherwise("generic.key").alias("rule_id"),
        F.explode(F.array(n % 4 - 1, n % 4 - 1, n % 4)).alias("line"),
    ).select("path", "rule_id", F.col("line").cast("long").alias("line"))


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One completed receipt per document, with the reports above."""
    found = external(spark, sf_dir).groupBy("path").agg(F.collect_list(F.struct("rule_id", "line")).alias("findings"))
    scanned = documents(spark, sf_dir).select("path", digest(F.col("text")).alias("sha256"), F.lit(True).alias("completed"))
    none = F.array().cast("array<struct<rule_id:string,line:bigint>>")
    return scanned.join(found, "path", "left").withColumn("findings", F.coalesce("findings", none))


def faulty_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts with faults by document number: none, of other bytes, unfinished, twice, of no document."""
    n = F.regexp_extract("path", r"d([0-9]+)(?:/_index)?\.md$", 1).cast("long") % 29
    given = receipts(spark, sf_dir).withColumn("n", n).where("n <> 0")
    bent = given.withColumns(
        {
            "sha256": F.when(F.col("n") == 1, F.reverse("sha256")).otherwise(F.col("sha256")),
            "completed": F.when(F.col("n") == 2, F.lit(None)).when(F.col("n") == 3, F.lit(False)).otherwise(F.col("completed")),
        }
    )
    twice = bent.where("n = 4")
    elsewhere = bent.where("n = 5").withColumn("path", F.concat(F.lit("gone/"), "path"))
    return bent.unionByName(twice).unionByName(elsewhere).drop("n")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_id, site, file, html`` of the seeded site."""
    n = F.col("page_id")
    folder = F.concat(F.lit("docs/p"), n % 7, F.lit("/"), n)
    file = F.when(n % 3 == 0, F.concat(folder, F.lit("/index.html"))).otherwise(F.concat(folder, F.lit(".html")))
    following = F.concat(F.lit("/docs/p"), (n + 1) % 7, F.lit("/"), n + 1)
    heading = F.regexp_extract("html", r"(?s)(<h1>.*?</h1>)", 1)
    added = F.concat(
        F.lit('<a href="'),
        following,
        F.lit('">next</a>'),
        F.when(n % 5 == 0, F.lit("<a href=../../../../x>up</a>")).otherwise(F.lit("")),
        F.when(n % 4 == 0, F.lit("<a href='?q=1'>q</a><a HREF = \"a%zz\">bad</a><img src=//cdn/x.png>")).otherwise(
            F.lit("")
        ),
        F.when(n % 12 == 0, heading).otherwise(F.lit("")),
    )
    home = F.when(n % 50 == 0, F.lit("index.html"))
    marks = F.when(
        n % 50 == 0,
        F.concat(
            F.lit("<div data-knowledge-stats data-published-documents="),
            n,
            F.lit(' data-published-categories="7"></div>'),
            F.repeat(F.lit('<a class="hextra-feature-card" href="/">c</a>'), F.lit(2) + (n / 50).cast("int") % 2),
        ),
    ).otherwise(F.lit(""))
    # Home pages belong to a site of their own, so that each site has one.
    site = F.when(n % 50 == 0, F.concat(F.lit("home"), n, F.lit(".example.org"))).otherwise(F.lit("docs.example.org"))
    return table(spark, sf_dir, "pages").select(
        "page_id", site.alias("site"), F.coalesce(home, file).alias("file"), F.concat("html", added, marks).alias("html")
    )
