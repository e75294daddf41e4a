"""Random text through the Spark scan, the transform and the oracle SQL."""

import random
import time
from datetime import datetime

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from checks import sql as S
from corpusguard import fixed_values as V
from corpusguard.functions import regex
from corpusguard.functions.text import digest
from corpusguard.operators import links, rules, transform

# No bare percent sign: DuckDB's decoder fails on escapes that are not UTF-8.
PIECES = [
    *"abKkſK19_- \t\x0b\x0c\r.,:;=/\\'\"()[]<>!#@&?~|",
    *["\r\n", "\n", "\u00a0", "\u3000", "\u2028", "\x85", "é", "中", "\ufeff", "\u0130", "\u0131", "😀"],
    *["password", "PASSWD", "to" + "ken", "ſecret", "api_key", "api-key", "://", "http", "https://", "HTTP://h/", "mailto:", "tel:"],
    *["file://", "FILE:", "ftp:", "10.", "192.168.", "172.16.", "127.0.0.1", "::1", "fe80:", "fd00::", "localhost", "LOCALHOST", "localhoſt"],
    *[".local", ".internal", ".lan", "/Users/", "/srv/", "/tmp/x", "C:\\", "c:/", "K:\\x", "[[", "]]", "](", "]: ", "![", "<script", "</form", "<base>"],
    *[" onclick=", "javascript:", "javascrıpt:", "<scrİpt>", "ſrc=a.zip", "fıle://", "tel:+1", ".ınternal", "javaſcript :", "src=", "href =", "SRC='", 'href="', "%41", "%2", "%zz", "%2525", "%2e%2e", "../", "./", "a.md", "b.zip"],
    *["```", "~~~", "---", "...", "# ", " #", "##", "user:pass@", "[::1]", ":80", "x" * 5, "AK" + "IA" + "A" * 16, "gh" + "p_" + "B" * 20, "xoxb-" + "c" * 10],
    "-----BEGIN " + "RSA PRIVATE KEY-----",
]
TEMPLATES = ["[{}]({})", "![{}]({} {})", "[{}]: {}", "<img src={}>", "<a HREF=\"{}\">", "[x](<{}>{})", "{}", "{}{}"]


def make(seed: int, documents: int, size: int) -> pd.DataFrame:
    draw = random.Random(seed)

    def some(n):
        return "".join(draw.choice(PIECES) for _ in range(draw.randint(0, n)))

    def line():
        shape = draw.choice(TEMPLATES)
        return shape.format(*(some(size) for _ in range(shape.count("{}"))))

    folders = ["", "a/", "a/b/"]
    rows = []
    for i in range(documents):
        text = "\n".join(line() for _ in range(draw.randint(1, 12)))
        if i % 7 == 0:
            text = draw.choice(["---\n", "\ufeff---\n", "---\r\n", " ---\n", "+++\n"]) + text
        rows.append((i, f"{draw.choice(folders)}d{i}.md", text, datetime(2026, 1, 1)))
    return pd.DataFrame(rows, columns=["doc_id", "path", "text", "modified_at"])


@pytest.fixture(scope="module")
def both(spark):
    frame = make(20260101, 1500, 5)
    connection = duckdb.connect()
    connection.register("made", frame)
    docs = spark.createDataFrame(frame).repartition(4).cache()
    return docs, connection, [("docs", "SELECT *, sha256(text) AS sha256 FROM made")]


def test_findings_agree(both):
    docs, connection, ctes = both
    actual = rules.flatten_findings(rules.scan_documents(docs)).select("path", "line", "rule_id", "level", "reason")
    expected = connection.execute(
        S.with_(ctes + S.scan("docs", "s_"), "SELECT path, line, rule_id, level, reason FROM s_findings")
    ).fetchall()
    got = {tuple(r) for r in actual.collect()}
    assert len(expected) > 2000
    assert got == set(expected)


def test_transform_agrees(both):
    docs, connection, ctes = both
    done = docs.select("path", transform.transformed("text", "modified_at").alias("output"))
    actual = done.where("output is not null").select("path", digest(F.col("output")))
    expected = connection.execute(
        S.with_(ctes + S.transform("docs", "t_"), "SELECT path, sha256 FROM t_out")
    ).fetchall()
    assert {tuple(r) for r in actual.collect()} == set(expected)


def test_links_agree(spark):
    draw = random.Random(7)
    parts = [*"abK#?:/%.&;@ +", "//", "../", "%20", "%2F", "%zz", "http://", "https://h.x", "h.x", "mailto:", ":80", "é", "\\", "[::1]"]
    raws = sorted({"".join(draw.choice(parts) for _ in range(draw.randint(0, 7))) for _ in range(4000)})
    frame = pd.DataFrame({"site": "h.x", "file": ["d/e/p.html" if i % 2 else "p.html" for i in range(len(raws))], "raw": raws})
    connection = duckdb.connect()
    connection.register("links", frame)
    expected = connection.execute(
        S.with_(S.RESOLVED[len(S.LINKS):], "SELECT site, file, raw, status, target FROM resolved")
    ).fetchall()
    actual = links.resolve_links(spark.createDataFrame(frame)).collect()
    assert {tuple(r) for r in actual} == set(expected)


@pytest.mark.parametrize(
    "name, alphabet, groups",
    [
        ("markdown_link", "[]]()(!!a <>\t", (1, 2)),
        ("markdown_link", "[]()!a <>", (1, 2)),
        ("markdown_link", "[](a>)", (1, 2)),
        ("wiki_link", "[[]]a ", ()),
        ("credential_url", "a1-+.:://@@_b kK ", ()),
        ("html_tag", "<<//  \tx>", ()),
    ],
)
def test_linear_forms_find_the_same(spark, name, alphabet, groups):
    """Patterns rewritten for long lines, on short strings dense in their delimiters."""
    draw = random.Random(name)
    pieces = [*alphabet, "](", "[](", "](a", "://", "[[", "aa:bbbb@", "form", "ba\u017Fe"]
    texts = sorted({"".join(draw.choice(pieces) for _ in range(draw.randint(1, 16))) for _ in range(12000)})
    connection = duckdb.connect()
    connection.register("made", pd.DataFrame({"text": texts}))
    pattern = S.lit(V.PATTERNS[name])
    frame = spark.createDataFrame(pd.DataFrame({"text": texts}))
    text = F.col("text")
    found = frame.select(
        "text", regex.matches(text, name).alias("m"), *(regex.extract_all(text, name, g).alias(f"g{g}") for g in groups)
    )
    if name == "markdown_link":
        found = found.withColumn("links", rules.markdown_links(text)).select(
            "text",
            "m",
            F.transform("links", lambda x: F.when(x["is_image"], "!").otherwise("")).alias("g1"),
            F.transform("links", lambda x: x["target"]).alias("g2"),
        )
    columns = "".join(
        f", list_transform(regexp_extract_all(text, {pattern}, {g}), lambda x: coalesce(x, ''))" for g in groups
    )
    expected = connection.execute(f"SELECT text, regexp_matches(text, {pattern}){columns} FROM made").fetchall()
    got = {r["text"]: tuple(r)[1:] for r in found.collect()}
    assert sum(r[1] for r in expected) > 50
    assert [t for t, *rest in expected if got[t] != tuple(rest)] == []


def test_headings_and_tags_agree(spark):
    """Headings of pages dense in tags, closed or not, and what is left of them without tags."""
    draw = random.Random(11)
    pieces = ["<h1>", "<H1 a='b'>", "</h1>", "</H1>", "<h1", "<h1x>", "<", ">", "<b>", "</b>", "a", " ", "&amp;", "\n", "<>", "K", "é"]
    pages = sorted({"".join(draw.choice(pieces) for _ in range(draw.randint(1, 18))) for _ in range(8000)})
    frame = pd.DataFrame({"site": "s", "file": [f"docs/{i}/index.html" for i in range(len(pages))], "html": pages})
    connection = duckdb.connect()
    connection.register("site_pages", frame)
    expected = connection.execute(S.with_(S.HEADINGS[len(S.PAGES):], "SELECT file, h FROM headings")).fetchall()
    found = {r["file"]: r["headings"] for r in links.page_headings(spark.createDataFrame(frame)).collect()}
    assert sum(len(h) > 1 for _, h in expected) > 300
    assert [f for f, h in expected if found.get(f, []) != h] == []


def test_long_lines_take_linear_time(spark):
    """Without the rewritten forms each of these needs minutes."""
    rows = [("a.md", "[" * 60000 + "](a b"), ("b.md", "a-" * 60000 + "://x"), ("c.md", "[[a " * 30000)]
    rows += [("d.md", "<" + " " * 400_000), ("e.md", "[x](a" + " " * 400_000), ("f.md", "< / " * 60_000)]
    rows += [("g.md", "[](a" * 200_000), ("h.md", "[](a b " * 100_000), ("i.md", "[](a>" * 100_000), ("j.md", "[x](a[" * 100_000 + ">y")]
    docs = spark.createDataFrame(rows, "path string, text string")
    assert rules.flatten_findings(rules.scan_documents(docs)).count() == 0


def test_long_pages_take_linear_time(spark):
    """Headings and tags that nothing closes: four times the text may not take much more than four times as long."""

    def seconds(size):
        bodies = ["<h1>" * size, "<h1 " * size, "<h1>a</h1><h1>" + "<" * size + "</h1>", "<h1>" + "<b" * size]
        pages = spark.createDataFrame([("s", f"docs/{i}/index.html", b) for i, b in enumerate(bodies)], "site string, file string, html string")
        started = time.perf_counter()
        assert links.duplicate_leading_h1(pages).count() == 0
        return time.perf_counter() - started

    seconds(1000)
    assert seconds(400_000) < 12 * seconds(100_000) + 2
