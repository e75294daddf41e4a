from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from corpusguard.functions.text import utc_time
from corpusguard.operators import transform

TIME = datetime(2026, 7, 18, 9, 30)
MOD = 'lastmod: "2026-07-18T09:30:00Z"\n'

# path, body, time, expected output
CASES = [
    ("guide.md", "# Title\n\nbody\n", TIME, f'---\ntitle: "Title"\n{MOD}---\n\nbody\n'),
    ("guide.md", "intro\n# 标题 ###\r\n\r\nbody\r\n", TIME, f'---\ntitle: "标题"\n{MOD}---\n\nintro\nbody\r\n'),
    ("a/中文 x.md", "no heading", TIME, f'---\ntitle: "中文 x"\n{MOD}---\n\nno heading\n'),
    ("c.md", "# C#\ntext", None, '---\ntitle: "C#"\n---\n\ntext\n'),
    ("f.md", "```\n# no\n```\n# yes\nbody\n", None, '---\ntitle: "yes"\n---\n\n```\n# no\n```\nbody\n'),
    ("g.md", "~~~\n```\n# no\n~~~\n# yes\n", None, '---\ntitle: "yes"\n---\n\n~~~\n```\n# no\n~~~\n'),
    ("h.md", "# only", None, '---\ntitle: "only"\n---\n\n'),
    ("i.md", "# a\n \n\nb\n", None, '---\ntitle: "a"\n---\n\n\nb\n'),
    ("j.md", "\ufeff# bom\nb\n", None, '---\ntitle: "bom"\n---\n\nb\n'),
    ("k.md", '# q "x" \\ y\n', None, '---\ntitle: "q \\"x\\" \\\\ y"\n---\n\n'),
    ("l.md", "", None, '---\ntitle: "l"\n---\n\n'),
    ("m.md", "# ###\nb", None, '---\ntitle: "###"\n---\n\nb\n'),
    ("n.md", "x\n# a ##b##\n", None, '---\ntitle: "a ##b##"\n---\n\nx\n'),
    ("../x.md", "b", None, None),
    ("x.MD", "b", None, None),
    (".x.md", "b", None, None),
    ("a/../x.md", "b", None, None),
    ("y.md", "---\na: b\n---\n", None, None),
    ("y.md", "\n+++\nx", None, None),
    ("y.md", "{\n}", None, None),
]


@pytest.fixture(scope="module")
def outputs(spark):
    rows = [(i, path, body, time) for i, (path, body, time, _) in enumerate(CASES)]
    docs = spark.createDataFrame(rows, "id int, path string, text string, modified_at timestamp")
    done = transform.transform_documents(docs).select("id", "output", "transform_error").collect()
    return {r["id"]: r for r in done}


@pytest.mark.parametrize("index", range(len(CASES)))
def test_exact_output(outputs, index):
    expected = CASES[index][3]
    assert outputs[index]["output"] == expected
    assert (outputs[index]["transform_error"] is None) == (expected is not None)


def test_invalid_utf8_is_refused(spark):
    docs = spark.createDataFrame(
        [("a.md", bytearray(b"\xff"), None)], "path string, text binary, modified_at timestamp"
    )
    row = transform.transform_documents(docs).first()
    assert row["output"] is None and row["transform_error"] == "encoding"


def test_section_index_and_directories(spark):
    paths = [("top.md",), ("a/x.md",), ("a/b/c/y.md",), ("z/_index.md",)]
    docs = spark.createDataFrame(paths, "path string")
    built = {r["path"]: r["data"] for r in transform.build_indexes(docs).collect()}
    assert set(built) == {"_index.md", "a/_index.md", "a/b/_index.md", "a/b/c/_index.md", "z/_index.md"}
    assert built["_index.md"] == '---\ntitle: "文档"\n---\n\n'
    assert built["a/b/_index.md"] == '---\ntitle: "b"\n---\n\n'
    outside = spark.createDataFrame([("../x",), ("/abs",), ("..",)], "d string")
    assert outside.where(transform.section_index(F.col("d")).isNotNull()).isEmpty()


def test_times_are_utc_in_any_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    moments = [-1, 0, 1711846799, 1711846800, 1729994400, 1784367000]
    expected = [datetime.fromtimestamp(s, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ") for s in moments]
    try:
        for other in ("UTC", "Europe/Berlin", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", other)
            rows = spark.createDataFrame([(s,) for s in moments], "s long")
            seen = rows.select(utc_time(F.timestamp_seconds("s")).alias("t"), utc_time(F.lit(None).cast("timestamp")).alias("n"))
            assert [tuple(r) for r in seen.collect()] == [(t, None) for t in expected]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
