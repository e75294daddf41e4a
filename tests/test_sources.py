from datetime import datetime

import pytest
from pyspark.sql import functions as F

from corpusguard.operators.manifest import detect_drift
from corpusguard.sources import discover, external
from corpusguard.streaming.incremental import write_findings


def test_read_tree_and_discovery(spark, tmp_path):
    for name in ("one.md", "目录/两 词.md", "LOUD.MD", "list.txt", "old.bak.md", "x%20y/z+1.md", "_index.md", "_drafts/y.md", ".hid/in.md"):
        target = tmp_path / "tree" / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(f"# {name}", encoding="utf8")
    tree = discover.read_tree(spark, str(tmp_path / "tree"))
    found = discover.discover_documents(tree).orderBy("path").collect()
    assert [r["path"] for r in found] == ["_drafts/y.md", "_index.md", "one.md", "x%20y/z+1.md", "目录/两 词.md"]
    assert found[2]["size"] == len("# one.md")
    assert {r["path"]: r["reason"] for r in discover.skipped_paths(tree).collect()} == {
        ".hid/in.md": "hidden-or-temporary",
        "LOUD.MD": "not-markdown",
        "list.txt": "not-markdown",
        "old.bak.md": "hidden-or-temporary",
    }


def test_wide_and_deep_trees_are_listed_by_tasks(spark, tmp_path, monkeypatch):
    """Each level is one table of directories; links are not followed, so that a loop of links ends."""
    monkeypatch.setattr(discover, "LISTED_ROWS", 7)
    monkeypatch.setattr(discover, "READ_BYTES", 10)
    root = tmp_path / "tree"
    deep = root / "/".join(f"l{k}" for k in range(9))
    deep.mkdir(parents=True)
    for k in range(40):
        (root / f"_w{k}.md").write_text("x" * k)
        (deep / f"f{k}.md").write_text(f"deep {k}")
    (deep / "empty").mkdir()
    (deep / "loop").symlink_to(root)
    (deep / "link.md").symlink_to(root / "_w1.md")
    found = {r["path"]: r["content"] for r in discover.read_tree(spark, str(root)).collect()}
    assert len(found) == 80 and found["_w3.md"] == b"xxx" and found["_w0.md"] == b""
    assert found["/".join(f"l{k}" for k in range(9)) + "/f7.md"] == b"deep 7"
    empty = tmp_path / "nothing"
    empty.mkdir()
    assert discover.read_tree(spark, str(empty)).count() == 0


def test_changed_files_are_seen(spark):
    then = datetime(2026, 1, 1)
    docs = spark.createDataFrame(
        [("a.md", "one", then), ("b.md", "two", then), ("c.md", "three", then)],
        "path string, text string, modified_at timestamp",
    )
    before = discover.discover_documents(docs, "text")
    later = docs.where("path <> 'c.md'").withColumn(
        "text", F.when(F.col("path") == "a.md", "uno").otherwise(F.col("text"))
    ).unionByName(docs.where("path = 'c.md'").withColumn("path", F.lit("d.md")))
    after = discover.discover_documents(later, "text")
    assert sorted(map(tuple, detect_drift(before, after).collect())) == [
        ("a.md", "changed"), ("c.md", "removed"), ("d.md", "added"),
    ]
    assert [r["path"] for r in discover.read_stable(later, before, "text").collect()] == ["b.md"]


def test_external_scanner_runs_per_task_and_failure_is_global(spark):
    docs = spark.createDataFrame([("a.md", "key"), ("b.md", "none")], "path string, text string")
    factory = lambda: lambda path, data: [("generic key", 1)] if b"key" in data else []
    rows = external.run_external_scanner(docs, factory, "text").collect()
    assert [tuple(r) for r in rows] == [("a.md", "generic key", 1)]

    def unavailable():
        raise RuntimeError("scanner unavailable")

    with pytest.raises(Exception, match="scanner unavailable"):
        external.run_external_scanner(docs, unavailable, "text").collect()


def test_scan_runs_on_a_stream(spark, tmp_path):
    docs = spark.createDataFrame([("a.md", "10.1.2.3"), ("b.md", "ok")], "path string, text string")
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    write_findings(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r["path"], r["rule_id"]) for r in rows] == [("a.md", "network.private-address")]
