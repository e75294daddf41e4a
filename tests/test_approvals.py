import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corpusguard import fixed_values as V
from corpusguard.functions.text import digest
from corpusguard.operators import approvals, findings, reports, rules
from corpusguard.plans import approve, scan
from corpusguard.schemas import ALLOWLIST
from corpusguard.session import materialize
from corpusguard.sources import commit, sinks, strict

AT = datetime(2026, 7, 18, 9, 0)
BODY = "# Title\n\nhost 10.1.2.3\nother 10.1.2.4\n"
OPEN = datetime(2026, 7, 1)


def documents(spark, body=BODY, path="team/hosts.md"):
    return spark.createDataFrame(
        [(path, body, datetime(2026, 1, 1)), ("team/clean.md", "nothing", None)],
        "path string, text string, modified_at timestamp",
    )


def requests(spark, docs, **changes):
    found = findings.with_fingerprint(rules.flatten_findings(rules.scan_documents(docs)))
    values = {"reason": "internal lab address", "approved_at": OPEN, "expires_at": AT + timedelta(hours=24), "batch": 1}
    values.update(changes)
    return found.where("line = 3").select(
        "path",
        "fingerprint",
        F.lit(values["reason"]).alias("reason"),
        F.lit(values["approved_at"]).alias("approved_at"),
        F.lit(values["expires_at"]).alias("expires_at"),
        F.lit(values["batch"]).alias("batch"),
    )


def empty(spark):
    return spark.createDataFrame([], ALLOWLIST)


@pytest.fixture(scope="module")
def approved(spark):
    docs = documents(spark)
    outcome = approve.approve_findings(docs, requests(spark, docs), empty(spark))
    assert outcome.problems.isEmpty()
    return spark.createDataFrame(outcome.allowlist.collect(), ALLOWLIST)


def unapproved_lines(spark, docs, allowlist, at=AT, side="source"):
    found = findings.with_fingerprint(rules.flatten_findings(rules.scan_documents(docs)))
    return sorted(r["line"] for r in approvals.unapproved_blocking(found, allowlist, at, side).collect())


def test_approval_covers_exactly_one_finding(spark, approved):
    row = approved.first()
    assert (row["source_line"], row["output_line"]) == (3, 6)
    assert unapproved_lines(spark, documents(spark), approved) == [4]


def test_any_changed_byte_voids_the_approval(spark, approved):
    assert unapproved_lines(spark, documents(spark, BODY + " "), approved) == [3, 4]


def test_moved_line_voids_the_approval(spark, approved):
    assert unapproved_lines(spark, documents(spark, "\n" + BODY), approved) == [4, 5]


def test_interval_is_half_open(spark, approved):
    docs = documents(spark)
    assert unapproved_lines(spark, docs, approved, OPEN) == [4]
    assert unapproved_lines(spark, docs, approved, OPEN - timedelta(seconds=1)) == [3, 4]
    assert unapproved_lines(spark, docs, approved, AT + timedelta(hours=24)) == [3, 4]


def test_source_identity_is_no_output_identity(spark, approved):
    assert unapproved_lines(spark, documents(spark), approved, side="output") == [3, 4]


def test_expired_first_match_is_not_rescued(spark, approved):
    old = approved.withColumns(
        {
            "output_finding_fingerprint": F.lit("0" * 64),
            "approved_at": F.lit(datetime(2020, 1, 1)),
            "expires_at": F.lit(datetime(2020, 2, 1)),
        }
    )
    assert unapproved_lines(spark, documents(spark), approved.unionByName(old)) == [3, 4]
    # An invalid entry in front is passed over.
    invalid = old.withColumn("reason", F.lit(" untrimmed"))
    assert unapproved_lines(spark, documents(spark), approved.unionByName(invalid)) == [4]


def test_in_row_marking_equals_the_join(spark, approved):
    docs = documents(spark)
    marked = rules.flatten_findings(
        approvals.mark_approved(rules.scan_documents(docs).drop("text"), approved, AT)
    ).select("path", "line", "approved")
    flat = approvals.apply_approvals(
        findings.with_fingerprint(rules.flatten_findings(rules.scan_documents(docs))), approved, AT
    ).select("path", "line", "approved")
    assert sorted(map(tuple, marked.collect())) == sorted(map(tuple, flat.collect()))


def test_bad_requests_are_refused(spark):
    later = AT + timedelta(hours=24)
    bad = [
        ("", later, "reason"),
        (" x", later, "reason"),
        ("x" * 241, later, "reason"),
        ("tok" + "en: abc", later, "reason"),
        ("fine", OPEN, "expires_at"),
        ("fine", later, None),
    ]
    names = [f"team/r{i}.md" for i in range(len(bad))]
    docs = spark.createDataFrame(
        [(name, BODY, None) for name in names], "path string, text string, modified_at timestamp"
    )
    changes = spark.createDataFrame(
        [(name, reason, expires) for name, (reason, expires, _) in zip(names, bad)],
        "path string, reason string, expires_at timestamp",
    )
    asked = requests(spark, docs).drop("reason", "expires_at").join(changes, "path")
    outcome = approve.approve_findings(docs, asked, empty(spark))
    refused = {r["path"]: r["problem"] for r in outcome.problems.collect()}
    assert refused == {name: problem for name, (_, _, problem) in zip(names, bad) if problem}
    assert [r["path"] for r in outcome.allowlist.collect()] == [names[-1]]
    with pytest.raises(strict.InvalidTable):
        approve.require_accepted(outcome)


def test_only_low_risk_rules_can_be_approved(spark):
    docs = documents(spark, "a\nb\nfile:///x 1\n")
    outcome = approve.approve_findings(docs, requests(spark, docs), empty(spark))
    assert [r["problem"] for r in outcome.problems.collect()] == ["not_approvable"]


def test_upsert_replaces_by_key_and_later_batch_wins(spark, approved):
    again = approved.withColumn("batch", F.explode(F.array(F.lit(2), F.lit(1)))).withColumn(
        "reason", F.concat(F.lit("review "), F.col("batch").cast("string"))
    )
    merged = approvals.upsert_approvals(approved, again)
    assert [r["reason"] for r in merged.collect()] == ["review 2"]


def test_upsert_of_equal_batches_takes_the_greatest_entry(spark, approved):
    again = approved.withColumn("batch", F.lit(1)).withColumn(
        "reason", F.explode(F.array(F.lit("review b"), F.lit("review c"), F.lit("review a")))
    )
    for order in (again, again.orderBy("reason"), again.orderBy(F.desc("reason"))):
        merged = approvals.upsert_approvals(approved, order).collect()
        assert [r["reason"] for r in merged] == ["review c"]


def test_report_and_inventory(spark, approved, tmp_path):
    docs = documents(spark, BODY + "![i](https://example.com/a.png)\n")
    run = scan.scan_corpus(docs, empty(spark), AT)
    counts = run.counts().first().asDict()
    assert counts == {"candidates": 2, "passed": 1, "excluded": 1, "warnings": 1}
    report = run.exclusions.collect()
    assert [r["path"] for r in report] == ["team/hosts.md"]
    assert {f["reason"] for f in report[0]["findings"]} == {V.SAFE_REASONS[V.PRIVATE_NETWORK]}
    assert [f["line"] for f in report[0]["findings"]] == [3, 4]
    assert reports.validate_report(run.exclusions).isEmpty()
    inventory = {r["path"]: r for r in run.inventory.collect()}
    assert inventory["team/clean.md"]["status"] == "passed"
    assert len(inventory["team/hosts.md"]["findings"]) == 3
    scan.write_reports(run, str(tmp_path / "reports"))
    first = sinks.read_reports(spark, str(tmp_path / "reports")).exclusions
    assert first.drop("version").exceptAll(run.exclusions.drop("version")).isEmpty()
    # Save, load and save again: same rows.
    sinks.write_exclusion_report(first, str(tmp_path / "again"))
    assert strict.load_report(spark, str(tmp_path / "again")).collect() == first.collect()


def test_report_fingerprint_binds_metadata(spark):
    run = scan.scan_corpus(documents(spark), empty(spark), AT)
    bent = run.exclusions.withColumn(
        "findings",
        F.transform(
            "findings",
            lambda f: F.struct(
                f["rule"].alias("rule"),
                (f["line"] + 1).alias("line"),
                f["fingerprint"].alias("fingerprint"),
                f["level"].alias("level"),
                f["reason"].alias("reason"),
            ),
        ).cast(run.exclusions.schema["findings"].dataType),
    )
    assert [r["problem"] for r in reports.validate_report(bent).collect()] == ["fingerprint_mismatch"]


def test_allowlist_is_loaded_strictly(spark, approved, tmp_path):
    stored = str(tmp_path / "allowlist")
    sinks.save_allowlist(approved, stored)
    loaded = strict.load_allowlist(spark, stored)
    assert loaded.collect() == approved.collect()
    line = spark.read.text(stored).first()["value"]

    def reject(text, name):
        folder = tmp_path / name
        folder.mkdir()
        (folder / "part.json").write_text(text + "\n", encoding="utf8")
        with pytest.raises(strict.InvalidTable):
            strict.load_allowlist(spark, str(folder))

    reject(line[:-1] + ',"extra":1}', "unknown")
    reject(line[:-1], "cut")
    reject(line + "\n" + line, "duplicate")
    reject(line.replace('"level":"block"', '"level":"warning"'), "level")
    reject(line.replace('"version":1', '"version":2'), "later")
    reject(line.replace('"version":1,', ""), "unversioned")
    with pytest.raises(strict.InvalidTable):
        sinks.save_allowlist(approved.unionByName(approved), str(tmp_path / "twice"))


def test_many_approvals_of_many_findings(spark):
    """10,000 findings and as many approvals of one document take linear time, and each meets its own."""

    def seconds(n):
        lines = "\n".join(f"host 10.1.{i // 200}.{i % 200}" for i in range(n))
        docs = spark.createDataFrame([("many.md", lines)], "path string, text string")
        found = findings.with_fingerprint(rules.flatten_findings(rules.scan_documents(docs)))
        entries = found.where("line % 3 <> 0").select(
            "path", F.col("sha256").alias("source_sha256"), F.col("fingerprint").alias("source_finding_fingerprint"),
            F.col("line").alias("source_line"), F.col("sha256").alias("output_sha256"),
            F.col("fingerprint").alias("output_finding_fingerprint"), F.col("line").alias("output_line"),
            F.col("rule_id").alias("rule"), "level", F.lit("reviewed").alias("reason"),
            F.lit(datetime(2026, 1, 1)).alias("approved_at"), F.lit(datetime(2027, 1, 1)).alias("expires_at"),
        )
        stored = materialize(entries, "many")
        results = materialize(rules.scan_documents(docs).drop("text"), "results")
        started = time.perf_counter()
        marked = approvals.mark_approved(results, stored, AT).select(F.explode("findings").alias("f")).select("f.*").collect()
        took = time.perf_counter() - started
        assert len(marked) == n and all(r["approved"] == (r["line"] % 3 != 0) for r in marked)
        return took

    seconds(100)
    assert seconds(10_000) < 15 * seconds(1_000) + 3


def test_pairs_in_the_row_equal_pairs_by_join(spark):
    """The n-th finding of a kind on both sides; kinds that differ in number are refused."""
    rng = random.Random(4)
    kinds = ["10.1.2.3", "password = abcdefgh", "see fe80::1", "[[x]]", "file:///x", "ok", "db.internal"]
    rows = [(f"p{i}.md", "\n".join(rng.choice(kinds) for _ in range(rng.randrange(12))), "\n".join(rng.choice(kinds) for _ in range(rng.randrange(12))))
            for i in range(300)]
    docs = spark.createDataFrame(rows, "path string, text string, output string")
    both = rules.scan_documents(rules.scan_documents(docs), "output", "output_sha256", "output_findings")
    aligned = both.select("path", F.explode(findings.aligned_pairs(F.col("path"), F.col("findings"), F.col("output_findings"))).alias("p"))
    columns = ["path", "rule_id", "source_line", "source_fingerprint", "output_line", "output_fingerprint"]
    in_row = aligned.select("path", "p.*").select(*columns)
    sides = [findings.with_fingerprint(rules.flatten_findings(rules.scan_documents(docs.select("path", F.col(c).alias("text"))))) for c in ("text", "output")]
    joined = findings.pair_findings(*sides).select(*columns)
    assert joined.count() > 100 and in_row.exceptAll(joined).isEmpty() and joined.exceptAll(in_row).isEmpty()


def test_review_reads_text_once_and_stops_on_drift(spark, tmp_path):
    root = str(tmp_path / "allowlists")
    documents(spark).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    asked = materialize(requests(spark, docs), "requests")
    plan = approve.paired_requests(docs, asked, "text", "modified_at")._jdf.queryExecution().executedPlan().toString()
    assert plan.count(str(tmp_path / "docs")) == 1
    accepted = asked.join(approve.approve_findings(docs, asked, empty(spark)).problems, ["path", "fingerprint"], "left_anti")
    now = docs.select("path", digest(F.col("text")).alias("sha256"))
    with pytest.raises(strict.InvalidTable, match="changed during the review"):
        approve.record_approvals(docs, accepted, root, unchanged=now.withColumn("sha256", F.reverse("sha256")))
    with pytest.raises(strict.InvalidTable, match="changed during the review"):
        approve.record_approvals(docs, accepted, root, unchanged=now.limit(0))
    assert commit.current(spark, root) is None
    approve.record_approvals(docs, accepted, root, unchanged=now)
    first = sinks.read_allowlist(spark, root)
    assert first.count() == accepted.count() > 0
    # A review that started from the same state as one saved meanwhile fails.
    with pytest.raises(strict.InvalidTable, match="faster"):
        sinks.commit_allowlist(first, root, 0)
