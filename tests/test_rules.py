import pytest
from pyspark.sql import functions as F

from corpusguard import fixed_values as V
from corpusguard.operators import receipts, rules

TOKEN = "gh" + "p_" + "A" * 24
SECRET = "x" * 12

# path, body, rules that must be found.  Each pattern is met at its edges: the shortest text
# that fires next to the longest that does not, several rules on a line, and late lines.
CASES = [
    ("a", "api_key: " + "k" * 6 + "\napi_key: kkk", {V.CREDENTIAL}),
    ("b", "access via https://u:" + "abcd@h.example/ and https://u:" + "abc@h.example/", {V.CREDENTIAL}),
    ("c", "https://u:" + "ab cd@h.example/", set()),
    ("d", "gh" + "p_" + "B" * 3 + " is short", set()),
    ("e", TOKEN + " beside 172.16.0.9", {V.TOKEN, V.PRIVATE_NETWORK}),
    ("f", "\n" * 40 + "-----BEGIN RSA " + "PRIVATE KEY-----", {V.PRIVATE_KEY}),
    ("g", "172.15.0.1 172.32.0.1 11.0.0.1 192.169.0.1", set()),
    ("h", "172.31.255.254", {V.PRIVATE_NETWORK}),
    ("i", "x=/opt/tool/bin z:/tool", {V.ABSOLUTE_PATH}),
    ("j", "F:\\a\\b and [[p]]", {V.ABSOLUTE_PATH, V.WIKI_LINK}),
    ("k", "[[]] [[ ]", set()),
    ("l", "a <scripture> and < scripts >", set()),
    ("m", "text</ IFRAME >", {V.DANGEROUS_HTML}),
    ("n", "<b onload = 'x'>", {V.DANGEROUS_HTML}),
    ("o", "![](http://h.example/p.svg) ![](p.svg)", {V.REMOTE_IMAGE, V.LOCAL_RESOURCE}),
    ("p", "[in](../b.md) [out](../../b.md)", {V.RELATIVE_ESCAPE}),
    ("q", "[f]( <FILE:///x> )", {V.FILE_URL}),
    ("r", "[one](x.md) [two](y.bin \"title\")", {V.LOCAL_RESOURCE}),
    ("s", "[ref]: y.bin", {V.LOCAL_RESOURCE}),
    ("t", "see [ref] and (y.bin)", set()),
    ("u", "[m](mailto:a@b.example) [h](#top) [w](https://h.example/y.bin)", set()),
    ("v", "\0", {V.BINARY}),
    ("w", "---\r\na: b\r\n", {V.FRONT_MATTER}),
    ("x", "text\n  ~~~ sh\n```\n", {V.UNCLOSED_FENCE}),
    ("y", "```\n~~~\n```\n~~~ x\n~~~", set()),
    ("z", "[x](a%2525.md)", set()),
    ("aa", "[y](100%25.md)", {V.LOCAL_RESOURCE}),
    ("ab", "[z](ftp://h/x)", {V.LOCAL_RESOURCE}),
    ("ac", "[z](//host/x)", {V.ABSOLUTE_PATH}),
    ("ad", "[z](a%zz.md)", {V.LOCAL_RESOURCE}),
    ("ae", "[z](?q=1)", set()),
    ("af", "[z](a:b/c.md)", {V.LOCAL_RESOURCE}),
    ("ag", "[z](b/a:b.md)", set()),
    ("ah", "[z](http://host:8o/x)", {V.LOCAL_RESOURCE}),
    ("ai", "[z](http://[::1]:80/x)", {V.PRIVATE_NETWORK}),
    ("aj", "LOCALHOST and Db.InTernal", {V.PRIVATE_NETWORK}),
    ("ak", "pa\u017f\u017fword: abcdef", {V.CREDENTIAL}),
    ("al", "to\u212aen= abcdef", {V.CREDENTIAL}),
    ("am", "\u212a:\\temp", {V.ABSOLUTE_PATH}),
    ("an", "\ufeff---\na\n...", set()),
    ("ao", "\u3000---\u3000\nopen", {V.FRONT_MATTER}),
    ("ap", "plain text, nothing to see", set()),
    ("aq", "10.1.2.3\r", {V.PRIVATE_NETWORK}),
]


@pytest.fixture(scope="module")
def scanned(spark):
    docs = spark.createDataFrame([(f"guide/{n}.md", body) for n, body, _ in CASES], "path string, text string")
    rows = rules.flatten_findings(rules.scan_documents(docs)).collect()
    found = {}
    for row in rows:
        found.setdefault(row["path"], []).append(row)
    return found


@pytest.mark.parametrize("name, body, expected", CASES, ids=[c[0] for c in CASES])
def test_rule_cases(scanned, name, body, expected):
    assert {r["rule_id"] for r in scanned.get(f"guide/{name}.md", [])} == expected


def test_levels_and_flags(scanned):
    for rows in scanned.values():
        for row in rows:
            assert row["level"] == ("warning" if row["rule_id"] == V.REMOTE_IMAGE else "block")
            assert row["approvable"] == (row["rule_id"] == V.PRIVATE_NETWORK)


def test_no_matched_text_in_findings(scanned):
    text = repr(scanned)
    for forbidden in (TOKEN, SECRET, "10.20.30.40"):
        assert forbidden not in text


def test_one_finding_per_line_and_rule_first_reason_wins(spark):
    body = "[a](100%25.md) [b](ftp://h/x) ![c](i.png)\n/Users/a/b <img src='/Users/e/p.png'>"
    docs = spark.createDataFrame([("n.md", body)], "path string, text string")
    rows = rules.flatten_findings(rules.scan_documents(docs)).orderBy("line").collect()
    assert [(r["line"], r["rule_id"], r["reason"]) for r in rows] == [
        (1, V.LOCAL_RESOURCE, V.REASON_BAD_PATH),
        (2, V.ABSOLUTE_PATH, V.REASONS[V.ABSOLUTE_PATH]),
    ]


def test_invalid_utf8_skips_other_rules(spark):
    docs = spark.createDataFrame(
        [("n.md", bytearray(b"\xff\xfe 10.1.2.3")), ("m.md", bytearray("ok 10.1.2.3".encode()))],
        "path string, content binary",
    )
    rows = rules.flatten_findings(rules.scan_documents(docs, "content")).collect()
    assert {(r["path"], r["rule_id"], r["line"]) for r in rows} == {
        ("n.md", V.INVALID_UTF8, 0),
        ("m.md", V.PRIVATE_NETWORK, 1),
    }


def test_binary_line_and_crlf_lines(spark):
    docs = spark.createDataFrame([("n.md", "a\r\nb\r\n\0c\r\n10.1.2.3")], "path string, text string")
    rows = rules.flatten_findings(rules.scan_documents(docs)).orderBy("line").collect()
    assert [(r["line"], r["rule_id"]) for r in rows] == [(3, V.BINARY), (4, V.PRIVATE_NETWORK)]
    lines = rules.split_lines(docs).orderBy("line").collect()
    assert [r["text"] for r in lines] == ["a", "b", "\0c", "10.1.2.3"]


def test_scan_plan_is_narrow(spark):
    """No exchange, and the scan expression occurs once."""
    docs = spark.range(10).select(F.col("id").cast("string").alias("path"), F.lit("x 10.1.2.3").alias("text"))
    found = rules.flatten_findings(rules.scan_documents(docs)).where("level = 'block'")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert plan.count("sort_array(") == 1


def test_scan_is_repeatable(spark):
    docs = spark.createDataFrame([(f"d/{n}.md", body) for n, body, _ in CASES], "path string, text string")
    first = rules.scan_documents(docs).select("path", "sha256", "findings")
    second = rules.scan_documents(docs.repartition(5)).select("path", "sha256", "findings")
    assert first.exceptAll(second).isEmpty() and second.exceptAll(first).isEmpty()


def test_external_findings_join_and_prefix(spark):
    docs = spark.createDataFrame([("n.md", "10.1.2.3"), ("m.md", "ok")], "path string, text string")
    reported = {"m.md": [(" aws key ", -3), (" aws key ", -3)], "n.md": [("--", 1)]}
    proofs = spark.createDataFrame([(p, [("0" * 64, True, found)]) for p, found in reported.items()],
                                   "path string, r array<struct<sha256:string,completed:boolean,findings:array<struct<rule_id:string,line:bigint>>>>")
    joined = rules.scan_documents(docs).drop("text").join(proofs, "path")
    merged = joined.withColumn("findings", receipts.with_external(F.col("findings"), F.col("r")))
    rows = rules.flatten_findings(merged).collect()
    assert {(r["path"], r["line"], r["rule_id"]) for r in rows} == {
        ("m.md", 0, "gitleaks.aws-key"),
        ("n.md", 1, "gitleaks.unknown"),
        ("n.md", 1, V.PRIVATE_NETWORK),
    }
    assert len(rows) == 3
