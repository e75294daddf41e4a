"""Seeded inputs of the queries."""

from pyspark.sql import functions as F

from checks import seeds
from corpusguard.operators import findings as finding_ops, rules, transform


def test_allowlist_scans_again_only_what_may_pair(spark, tmp_path):
    """Copies, several texts of one id, null ids and texts; findings before the transform only, and after it only."""
    body = "plain words\nping 10.0.0.1 and 192.168.3.4\n"
    rows = [(k, "some words\n") for k in range(60)]
    rows += [(5, body), (5, body), (5, "nothing here"), (7, "# Title 10.0.0.9\n\n" + body), (77, None), (None, body), (78, body), (78, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    entries = seeds.allowlist_entries(spark, str(tmp_path))
    plan = entries._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ReadSchema: struct<doc_id:bigint,text:string>") == 1 and "LeftSemi" in plan

    docs = seeds.documents(spark, str(tmp_path))
    source = rules.scan_documents(docs)
    outputs = docs.select("path", transform.transformed("text", "modified_at").alias("output")).where("output is not null")
    left, right = (
        finding_ops.with_fingerprint(finding_ops.approvable_findings(rules.flatten_findings(side)))
        for side in (source, rules.scan_documents(outputs, "output"))
    )
    columns = ["path", "source_line", "output_line"]
    expected = finding_ops.pair_findings(left, right).select(*columns).distinct()
    found = entries.select(*columns).distinct()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))
    assert found.where(F.endswith("path", F.lit("d78.md"))).count() == 2
