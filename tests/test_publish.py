from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from corpusguard.operators import findings, manifest, receipts, rules, sides, stats, transform
from corpusguard.plans import approve, publish, scan, verify
from corpusguard.schemas import ALLOWLIST
from corpusguard.sources import commit, discover, external, sinks, snapshot, strict

AT = datetime(2026, 7, 18)
RULESET = "a" * 64
VERSION = "1.0"


def corpus(spark, extra=()):
    return spark.createDataFrame(
        [
            ("a/good.md", "# Good\n\n![i](https://example.com/a.png)\n", datetime(2026, 1, 1)),
            ("a/local.md", "![i](i.png)\n", datetime(2026, 1, 1)),
            ("b/escape.md", "![i](../../x.png)\n", datetime(2026, 1, 1)),
            ("c/_index.md", "hand-made index\n", datetime(2026, 1, 1)),
            ("c/front.md", "---\na: b\n---\nx\n", datetime(2026, 1, 1)),
            # A wiki link needs both brackets on one line.
            ("d/late.md", "# [[x]\nbody]]\n", datetime(2026, 1, 1)),
            *extra,
        ],
        "path string, text string, modified_at timestamp",
    )


def empty(spark):
    return spark.createDataFrame([], ALLOWLIST)


@pytest.fixture(scope="module")
def site(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("site"))
    publish.publish_corpus(corpus(spark), empty(spark), AT, root, VERSION, RULESET)
    return root


def check(spark, root, files=None, allowlist=None, ruleset=RULESET):
    files = snapshot.read_snapshot(spark, f"{root}/content") if files is None else files
    stored = strict.load_manifest(spark, publish.published_manifest_path(spark, root))
    found = verify.verify_corpus(files.select("path", "data"), stored, empty(spark), AT, VERSION, ruleset)
    return sorted(map(tuple, found.collect()))


def test_outcomes(spark):
    decided = publish.decide_outcomes(corpus(spark), empty(spark), AT)
    assert {r["path"]: r["outcome"] for r in decided.collect()} == {
        "a/good.md": "published",
        "a/local.md": "blocked",
        "b/escape.md": "blocked",
        "c/_index.md": "path.reserved-index",
        "c/front.md": "content.transform-error",
        "d/late.md": "published",
    }


def test_output_that_becomes_unsafe_is_held_back(spark):
    """An approved source finding without an approved output finding stays back."""
    docs = corpus(spark, [("e/host.md", "# h\n10.1.2.3\n", None)])
    named = docs.where("path = 'e/host.md'")
    found = findings.with_fingerprint(rules.flatten_findings(rules.scan_documents(named)))
    asked = found.select(
        "path", "fingerprint", F.lit("reviewed").alias("reason"), F.lit(datetime(2026, 1, 1)).alias("approved_at"),
        F.lit(datetime(2027, 1, 1)).alias("expires_at"), F.lit(1).alias("batch"),
    )
    allowlist = approve.approve_findings(named, asked, empty(spark)).allowlist
    outcome = lambda a: publish.decide_outcomes(named, a, AT).first()
    assert outcome(allowlist)["outcome"] == "published"
    assert outcome(allowlist)["approved_rules"] == ["network.private-address"]
    row = outcome(allowlist.withColumn("output_sha256", F.lit("0" * 64)))
    assert row["outcome"] == "content.output-safety-mismatch"
    assert [(f["line"], f["rule_id"], f["approved"]) for f in row["findings"]] == [
        (2, "network.private-address", True), (0, "content.output-safety-mismatch", False),
    ]


def test_one_stage_of_text(spark):
    """With a small allowlist no document text is exchanged."""
    docs = spark.range(20).select(
        F.concat(F.lit("d"), "id", F.lit(".md")).alias("path"),
        F.lit("x").alias("text"),
        F.lit(None).cast("timestamp").alias("modified_at"),
    )
    plan = publish.decide_outcomes(docs, empty(spark), AT)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "rangepartitioning" not in plan


def test_published_tree_and_manifest(spark, site):
    files = {r["path"]: r["data"] for r in snapshot.read_snapshot(spark, f"{site}/content").collect()}
    assert set(files) == {
        "a/good.md", "d/late.md", "_index.md", "a/_index.md", "b/_index.md", "c/_index.md", "d/_index.md",
    }
    stored = strict.load_manifest(spark, publish.published_manifest_path(spark, site))
    assert [r["ordinal"] for r in stored.orderBy("kind", "path").collect()] == list(range(1, 8))
    stored = sinks.read_reports(spark, f"{site}/reports")
    assert [r["path"] for r in stored.exclusions.collect()] == ["a/local.md", "b/escape.md", "c/_index.md", "c/front.md"]
    assert stored.header.first()["candidate_count"] == 6 and stored.documents.count() == 6
    shown = snapshot.read_published(spark, f"{site}/content").orderBy("path").collect()
    assert [tuple(r) for r in shown] == [("a/good.md", "Good", datetime(2026, 1, 1)), ("d/late.md", "[[x]", datetime(2026, 1, 1))]
    assert snapshot.read_candidates(spark, f"{site}/content").count() == 6
    plan = snapshot.read_published(spark, f"{site}/content")._jdf.queryExecution().executedPlan().toString()
    assert "data" not in plan.split("ReadSchema")[1]
    assert check(spark, site) == []


def test_second_run_changes_nothing(spark, site):
    before = snapshot.current(spark, f"{site}/content")
    again = publish.publish_corpus(corpus(spark), empty(spark), AT, site, VERSION, RULESET)
    assert again == before


def test_new_ruleset_is_a_new_publication(spark, tmp_path):
    """Equal files under another ruleset: the manifest on show names the new one."""
    root = str(tmp_path)
    first = publish.publish_corpus(corpus(spark), empty(spark), AT, root, VERSION, RULESET)
    second = publish.publish_corpus(corpus(spark), empty(spark), AT, root, VERSION, "c" * 64)
    assert second["sequence"] == first["sequence"] + 1
    assert check(spark, root, ruleset="c" * 64) == []


def test_refused_manifest_keeps_the_old_snapshot(spark, tmp_path):
    """A path the snapshot takes and the manifest doesn't must fail before anything shows."""
    root = str(tmp_path)
    first = publish.publish_corpus(corpus(spark), empty(spark), AT, root, VERSION, RULESET)
    odd = corpus(spark).withColumn("path", F.when(F.col("path") == "a/good.md", "a/go\tod.md").otherwise(F.col("path")))
    with pytest.raises(strict.InvalidTable):
        publish.publish_corpus(odd, empty(spark), AT, root, VERSION, RULESET)
    assert snapshot.current(spark, f"{root}/content") == first
    assert check(spark, root) == []


def test_second_writer_of_a_pointer_fails(spark, tmp_path):
    snapshot.create_once(spark, f"{tmp_path}/pointer/one.json", "{}")
    with pytest.raises(strict.InvalidTable):
        snapshot.create_once(spark, f"{tmp_path}/pointer/one.json", "{}")


def test_tampering_is_found(spark, site):
    files = snapshot.read_snapshot(spark, f"{site}/content").select("path", "data")
    edited = files.withColumn(
        "data", F.when(F.col("path") == "a/good.md", F.concat("data", F.lit("host 10.0.0.1\n"))).otherwise(F.col("data"))
    )
    assert {(c, p) for c, _, p in check(spark, site, edited)} == {("digest", "changed"), ("document", "document_blocked")}
    extra = files.unionByName(spark.createDataFrame([("new/x.md", "x")], "path string, data string"))
    assert {(c, p) for c, _, p in check(spark, site, extra)} == {
        ("digest", "extra"), ("boundary", "unexpected_file"), ("boundary", "unexpected_directory"), ("document", "not_registered"),
    }
    missing = files.where("path <> 'd/late.md'")
    assert {(c, p) for c, _, p in check(spark, site, missing)} == {
        ("digest", "missing"), ("boundary", "absent_file"), ("document", "not_verified"),
    }
    assert check(spark, site, ruleset="b" * 64) == [("header", None, "ruleset_changed")]


def test_failed_validation_keeps_the_old_snapshot(spark, tmp_path):
    root = str(tmp_path / "snap")
    files = spark.createDataFrame([("a.md", "one")], "path string, data string")
    first = snapshot.publish_snapshot(files, root)

    def refuse(staged):
        raise RuntimeError("sources changed")

    with pytest.raises(RuntimeError):
        snapshot.publish_snapshot(files.withColumn("data", F.lit("two")), root, refuse)
    assert snapshot.current(spark, root) == first
    assert [r["data"] for r in snapshot.read_snapshot(spark, root).collect()] == ["one"]
    second = snapshot.publish_snapshot(spark.createDataFrame([("b.md", "two")], "path string, data string"), root)
    assert second["sequence"] == 2
    assert [r["path"] for r in snapshot.read_snapshot(spark, root).collect()] == ["b.md"]


@pytest.mark.parametrize("paths", [["../x.md"], ["/x.md"], ["a//b"], ["a.md", "a.md"], ["a\\b"]])
def test_bad_snapshot_paths_are_refused(spark, tmp_path, paths):
    files = spark.createDataFrame([(p, "x") for p in paths], "path string, data string")
    with pytest.raises(strict.InvalidTable):
        snapshot.publish_snapshot(files, str(tmp_path / "bad"))


def test_wrong_digest_is_refused(spark, tmp_path):
    files = spark.createDataFrame([("a.md", "x", "0" * 64)], "path string, data string, sha256 string")
    with pytest.raises(strict.InvalidTable):
        snapshot.publish_snapshot(files, str(tmp_path / "bad"))


def test_drift_stops_publishing(spark, tmp_path):
    changed = discover.discover_documents(
        corpus(spark).withColumn("text", F.concat("text", F.lit("!"))), "text"
    ).select("path", "sha256")
    with pytest.raises(strict.InvalidTable):
        publish.publish_corpus(
            corpus(spark), empty(spark), AT, str(tmp_path / "s"), VERSION, RULESET, unchanged=changed
        )
    assert snapshot.current(spark, str(tmp_path / "s/content")) is None


def test_ordinals_are_consecutive_in_key_order(spark):
    numbered = manifest.with_ordinal(
        spark.range(5000).select(F.sha2(F.col("id").cast("string"), 256).alias("k")).repartition(7), "k"
    ).collect()
    ordered = sorted(numbered, key=lambda r: r["ordinal"])
    assert [r["ordinal"] for r in ordered] == list(range(1, 5001))
    assert [r["k"] for r in ordered] == sorted(r["k"] for r in numbered)


def test_table_digest_ignores_order_and_sees_every_row(spark):
    table = spark.range(500).select(F.col("id").cast("string").alias("a"), F.lit("x").alias("b"))
    digest = lambda t: manifest.table_digest(t, ["a", "b"]).first()["sha256"]
    assert digest(table) == digest(table.orderBy(F.desc("a")))
    assert digest(table) != digest(table.unionByName(table.limit(1)))
    assert digest(table) != digest(table.where("a <> '7'"))


def test_manifest_problems(spark):
    rows = spark.range(3).select(F.concat(F.lit("d"), "id", F.lit(".md")).alias("path"), F.lit("0" * 64).alias("s"))
    docs = rows.select("path", F.col("s").alias("source_sha256"), F.col("s").alias("output_sha256"),
                       F.array(F.lit("b"), F.lit("a")).alias("approved_rules"))
    built = manifest.encode_manifest(
        manifest.manifest_rows(docs, transform.build_indexes(docs), F.lit("1"), F.lit("0" * 64))
    )
    assert manifest.validate_manifest(built).isEmpty()
    assert built.where("kind = 'document'").first()["approved_rules"] == ["a", "b"]
    swapped = built.withColumn("ordinal", 5 - F.col("ordinal"))
    assert {r["problem"] for r in manifest.validate_manifest(swapped).collect()} == {"unordered"}
    for ordinal in (F.col("ordinal") * 2, F.lit(None).cast("long"), F.col("ordinal") - 1):
        faulty = manifest.validate_manifest(built.withColumn("ordinal", ordinal))
        assert {r["problem"] for r in faulty.collect()} == {"ordinals"}
    assert manifest.validate_manifest(built.limit(0)).isEmpty()


def test_statistics(spark):
    published = spark.createDataFrame(
        [("a/x.md", "X", datetime(2026, 1, 2)), ("a/b/y.md", "Y", datetime(2026, 1, 3)), ("a/b/z.md", "Z", datetime(2026, 1, 3)),
         ("c/w.md", "W", datetime(2026, 1, 1)), ("r.md", "R", datetime(2026, 1, 4))],
        "path string, title string, lastmod timestamp",
    )
    candidates = published.select("path").unionByName(spark.createDataFrame([("empty/q.md",)], "path string"))
    assert stats.corpus_stats(published, candidates).first().asDict() == {"documents": 5, "sections": 4}
    assert [tuple(r) for r in stats.category_wall(published).collect()] == [("a", 3, "Y"), ("c", 1, "W")]
    assert [tuple(r) for r in stats.recent_documents(published, 3).collect()] == [
        ("r.md", "R", "文档", "2026-01-04"), ("a/b/y.md", "Y", "b", "2026-01-03"), ("a/b/z.md", "Z", "b", "2026-01-03"),
    ]


# --- commits ----------------------------------------------------------------------------------


def empty_pointer(spark, root, sequence):
    location = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/pointer/sequence-{sequence:012d}.json")
    location.getFileSystem(spark._jsc.hadoopConfiguration()).create(location, False).close()


def test_publisher_that_died_is_passed_over(spark, tmp_path):
    """A pointer file without content neither hides the snapshot nor stops later publishers."""
    root = str(tmp_path)
    files = spark.createDataFrame([("a.md", "one")], "path string, data string")
    empty_pointer(spark, root, 1)
    assert snapshot.current(spark, root) is None
    first = snapshot.publish_snapshot(files, root)
    assert first["sequence"] == 2
    empty_pointer(spark, root, 3)
    (tmp_path / "pointer" / "sequence-000000000004.json").write_text('{"sequence": 4, "ver')
    (tmp_path / "pointer" / ".pending-x").write_text("{}")
    assert snapshot.current(spark, root) == first
    second = snapshot.publish_snapshot(files.withColumn("data", F.lit("two")), root)
    assert second["sequence"] == 5 and snapshot.read_snapshot(spark, root).first()["data"] == "two"


def test_of_two_publishers_one_fails(spark, tmp_path):
    root = str(tmp_path)
    commit.advance(spark, root, 0, {"version": "a"})
    last, _ = commit.state(spark, root)
    assert commit.advance(spark, root, last, {"version": "b"})["sequence"] == 2
    with pytest.raises(strict.InvalidTable, match="faster"):
        commit.advance(spark, root, last, {"version": "c"})
    assert commit.current(spark, root)["version"] == "b"
    assert not [p.name for p in (tmp_path / "pointer").iterdir() if p.name.startswith(".pending")]


def test_folders_of_failed_writers_are_removed(spark, tmp_path):
    root = str(tmp_path)
    files = spark.createDataFrame([("a.md", "one")], "path string, data string")
    first = snapshot.publish_snapshot(files, root)
    second = snapshot.publish_snapshot(files.withColumn("data", F.lit("two")), root)
    left = snapshot.stage(files.select("path", "data", F.lit("x").alias("sha256"), F.lit("document").alias("kind")), root)
    now = datetime.now(timezone.utc)
    assert commit.remove_abandoned(spark, root, now - timedelta(hours=1)) == []
    assert commit.remove_abandoned(spark, root, now + timedelta(hours=1)) == [left]
    assert {p.name for p in tmp_path.glob("version=*")} == {f"version={row['version']}" for row in (first, second)}
    assert snapshot.read_snapshot(spark, root).first()["data"] == "two"
    assert commit.remove_abandoned(spark, str(tmp_path / "none"), now) == []


def test_reports_are_shown_together_or_not_at_all(spark, tmp_path):
    root = str(tmp_path)
    run = scan.scan_corpus(corpus(spark), empty(spark), AT)
    first = scan.write_reports(run, root)
    broken = run.exclusions.withColumn("status", F.lit("closed"))
    with pytest.raises(strict.InvalidTable):
        sinks.commit_reports(broken, run.inventory, AT, root)
    with pytest.raises(strict.InvalidTable, match="disagree"):
        sinks.commit_reports(run.exclusions.where("path <> 'a/local.md'"), run.inventory, AT, root)
    assert commit.current(spark, root) == first
    fewer = scan.scan_corpus(corpus(spark).where("path < 'b'"), empty(spark), AT)
    scan.write_reports(fewer, root)
    stored = sinks.read_reports(spark, root)
    assert [r["path"] for r in stored.exclusions.collect()] == ["a/local.md"]
    assert stored.documents.count() == 2 and tuple(stored.header.first())[2:] == (2, 1, 1)


# --- receipts of an outside scanner -------------------------------------------------------------


def scanner(needle, rule="key"):
    return lambda: lambda path, data: [(rule, 1 + data[: data.index(needle)].count(b"\n"))] if needle in data else []


def test_outside_findings_hold_back_sources_and_outputs(spark):
    docs = corpus(spark)
    source = external.scan_externally(docs, scanner(b"example.com"), "text")
    decided = publish.decide_outcomes(docs, empty(spark), AT, source)
    assert {r["path"]: r["outcome"] for r in decided.collect()}["a/good.md"] == "blocked"
    assert decided.where("scan_problem is not null").isEmpty()
    clean = external.scan_externally(docs, scanner(b"nothing at all"), "text")
    outputs = publish.outputs_to_scan(docs, empty(spark), AT, clean)
    assert {r["path"] for r in outputs.collect()} == {"a/good.md", "d/late.md"}
    seen = external.scan_externally(outputs, scanner(b"lastmod"), "output")
    late = {r["path"]: r for r in publish.decide_outcomes(docs, empty(spark), AT, clean, seen).collect()}
    assert late["a/good.md"]["outcome"] == "content.output-safety-mismatch"
    assert late["a/local.md"]["outcome"] == "blocked" and late["a/local.md"]["scan_problem"] is None


@pytest.mark.parametrize(
    "fault, problem",
    [
        (lambda r: r.where("path <> 'b/escape.md'"), "unscanned"),
        (lambda r: r.withColumn("sha256", F.when(F.col("path") == "b/escape.md", F.lit("0" * 64)).otherwise(F.col("sha256"))), "stale"),
        (lambda r: r.withColumn("completed", F.col("path") != "b/escape.md"), "incomplete"),
        (lambda r: r.unionByName(r.where("path = 'b/escape.md'")), "repeated"),
        (lambda r: r.unionByName(r.where("path = 'b/escape.md'").withColumn("path", F.lit("z.md"))), "unknown"),
    ],
)
def test_a_gap_in_the_outside_scan_stops_every_job(spark, tmp_path, site, fault, problem):
    docs = corpus(spark)
    whole = external.scan_externally(docs, scanner(b"nothing at all"), "text")
    faulty = fault(whole)
    path = "z.md" if problem == "unknown" else "b/escape.md"
    run = scan.scan_corpus(docs, empty(spark), AT, faulty)
    assert [tuple(r) for r in run.gaps.collect()] == [(path, problem)]
    assert [tuple(r) for r in receipts.receipt_gaps(discover.discover_documents(docs, "text"), faulty).collect()] == [(path, problem)]
    with pytest.raises(strict.InvalidTable):
        scan.write_reports(run, str(tmp_path / "r"))
    with pytest.raises(strict.InvalidTable):
        publish.publish_corpus(docs, empty(spark), AT, str(tmp_path / "p"), VERSION, RULESET, external=faulty)
    assert commit.current(spark, str(tmp_path / "r")) is None
    assert commit.current(spark, str(tmp_path / "p/content")) is None and commit.current(spark, str(tmp_path / "p/reports")) is None
    files = snapshot.read_snapshot(spark, f"{site}/content").select("path", "data")
    stored = strict.load_manifest(spark, publish.published_manifest_path(spark, site))
    seen = external.scan_externally(files, scanner(b"nothing at all"), "data")
    verified = lambda given: verify.verify_corpus(files, stored, empty(spark), AT, VERSION, RULESET, external=given)
    assert verified(seen).isEmpty()
    bent = fault(seen.withColumn("path", F.when(F.col("path") == "a/good.md", F.lit("b/escape.md")).otherwise(F.col("path"))))
    bent = bent.withColumn("path", F.when(F.col("path") == "b/escape.md", F.lit("a/good.md")).otherwise(F.col("path")))
    expected = ("external", "z.md" if problem == "unknown" else "a/good.md", problem)
    assert [tuple(r) for r in verified(bent).collect()] == [expected]


def test_unfinished_outside_scan_is_no_clean_one(spark):
    docs = corpus(spark)
    given_up = lambda: lambda path, data: None if path == "a/good.md" else []
    run = scan.scan_corpus(docs, empty(spark), AT, external.scan_externally(docs, given_up, "text"))
    assert [tuple(r) for r in run.gaps.collect()] == [("a/good.md", "incomplete")]


def test_text_moves_once_at_most(spark):
    """With nothing broadcast, approvals and receipts of both sides reach the text by one join."""
    docs = corpus(spark)
    proof = external.scan_externally(docs, scanner(b"nothing at all"), "text")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    limit = sides.broadcast_if_measured_small
    sides.broadcast_if_measured_small = lambda frame, name: frame
    try:
        plan = publish.decide_outcomes(docs, empty(spark), AT, proof, proof)._jdf.queryExecution().executedPlan().toString()
    finally:
        sides.broadcast_if_measured_small = limit
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("SortMergeJoin") == 1


def test_rules_that_change_during_the_job_stop_it(spark, tmp_path):
    reads = iter(["one", "one", "one", "two"])
    table = lambda: spark.createDataFrame([("rules/a", next(reads))], "path string, content string")
    first = publish.publish_corpus(corpus(spark), empty(spark), AT, str(tmp_path), VERSION, table)
    stored = strict.load_manifest(spark, publish.published_manifest_path(spark, str(tmp_path)))
    assert {r["ruleset_sha256"] for r in stored.collect()} == {publish.ruleset_digest(
        lambda: spark.createDataFrame([("rules/a", "one")], "path string, content string"))}
    more = corpus(spark, [("e/new.md", "new\n", datetime(2026, 1, 1))])
    with pytest.raises(strict.InvalidTable, match="changed during the run"):
        publish.publish_corpus(more, empty(spark), AT, str(tmp_path), VERSION, table)
    assert snapshot.current(spark, f"{tmp_path}/content") == first
