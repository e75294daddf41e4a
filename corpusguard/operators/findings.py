"""Findings as a relation: filters, external findings, de-duplication."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusguard import fixed_values as V
from corpusguard.functions import paths
from corpusguard.functions.fingerprints import finding_fingerprint
from corpusguard.functions.text import let, trim_space


def sanitize_rule_id(value: Column) -> Column:
    cleaned = F.regexp_replace(trim_space(value), "[^A-Za-z0-9._-]", "-")
    return F.coalesce(F.nullif(F.btrim(cleaned, F.lit("-")), F.lit("")), F.lit("unknown"))


def external_finding(rule_id: Column, line: Column) -> Column:
    """A report of an independent scanner as a finding."""
    return F.struct(
        F.greatest(line, F.lit(0)).cast("long").alias("line"),
        F.concat(F.lit(V.EXTERNAL_PREFIX), sanitize_rule_id(rule_id)).alias("rule_id"),
        F.lit(V.BLOCK).alias("level"),
        F.lit(V.REASON_EXTERNAL).alias("reason"),
        F.lit(False).alias("approvable"),
    )


def external_findings(external: DataFrame) -> DataFrame:
    """``path, rule_id, line`` of an independent scanner as finding rows."""
    return external.select("path", external_finding(F.col("rule_id"), F.col("line")).alias("f")).select("path", "f.*")


def normalize_findings(emitted: DataFrame) -> DataFrame:
    """Keep the first emitted finding (lowest ``seq``) per path, line and rule.

    ``min_by`` combines on the map side, so repeats of one hot key never travel.
    """
    first = F.struct("level", "reason", "approvable")
    return (
        emitted.groupBy("path", "line", "rule_id")
        .agg(F.min_by(first, "seq").alias("f"))
        .select("path", "line", "rule_id", "f.level", "f.reason", "f.approvable")
    )


def union_findings(own: DataFrame, external: DataFrame) -> DataFrame:
    """Own and external findings, own emitted first."""
    columns = ("path", "line", "rule_id", "level", "reason", "approvable")
    return normalize_findings(
        own.select(*columns)
        .withColumn("seq", F.lit(0))
        .unionByName(external_findings(external).select(*columns).withColumn("seq", F.lit(1)))
    )


def blocking_findings(findings: DataFrame) -> DataFrame:
    return findings.where(F.col("level") == V.BLOCK)


def is_approvable(finding: Column) -> Column:
    """The flag alone never suffices: the rule must be in the closed low-risk set."""
    return (
        (finding["level"] == V.BLOCK)
        & finding["approvable"]
        & finding["rule_id"].isin(*V.APPROVABLE_RULES)
    )


def approvable_findings(findings: DataFrame) -> DataFrame:
    return findings.where(is_approvable(F.struct("level", "approvable", "rule_id")))


def valid_result_findings(findings: DataFrame) -> DataFrame:
    """Findings an approval may refer to; ``result_path`` is the scanned document."""
    return findings.where(
        F.col("completed")
        & paths.valid_document_path(F.col("result_path"))
        & paths.valid_sha256(F.col("sha256"))
        & (F.col("path") == F.col("result_path"))
        & paths.valid_rule_id(F.col("rule_id"))
        & (F.col("line") > 0)
    )


def with_fingerprint(findings: DataFrame) -> DataFrame:
    finding = F.struct("rule_id", "level", "line", "reason", "approvable")
    return findings.withColumn("fingerprint", finding_fingerprint(F.col("path"), finding))


def safe_reason(rule_id: Column) -> Column:
    """Canonical report text; scanner-supplied reasons never reach a report."""
    texts: dict[str, list[str]] = {}
    for rule, text in V.SAFE_REASONS.items():
        texts.setdefault(text, []).append(rule)
    result = F
    for text, rules in texts.items():
        result = result.when(rule_id.isin(*rules), F.lit(text))
    return result.when(
        F.startswith(rule_id, F.lit(V.EXTERNAL_PREFIX)), F.lit(V.SAFE_REASON_EXTERNAL)
    ).otherwise(F.lit(V.SAFE_REASON_OTHER))


def nth_of_kind(findings: DataFrame, prefix: str) -> DataFrame:
    """Rank and size of a finding among those of its kind in one document."""
    kind = Window.partitionBy("path", "rule_id", "level", "reason", "approvable")
    return findings.select(
        "path",
        "rule_id",
        "level",
        "reason",
        "approvable",
        F.row_number().over(kind.orderBy("line")).cast("long").alias("rank"),
        F.count(F.lit(1)).over(kind).alias("of"),
        F.col("sha256").alias(f"{prefix}_sha256"),
        F.col("line").alias(f"{prefix}_line"),
        F.col("fingerprint").alias(f"{prefix}_fingerprint"),
    )


def pair_findings(source: DataFrame, output: DataFrame) -> DataFrame:
    """n-th finding of a kind before the transform with the n-th after it.

    Refused (no row) unless both documents hold equally many of that kind.
    """
    keys = ["path", "rule_id", "level", "reason", "approvable", "rank", "of"]
    return nth_of_kind(source, "source").join(nth_of_kind(output, "output"), keys)


_KIND = ("rule_id", "level", "reason", "approvable")


def aligned_pairs(path: Column, source: Column, output: Column) -> Column:
    """The same within one row: pairs of the n-th findings of a kind of two arrays.

    Kinds are as few as the rules have reasons, so a document of any number of findings
    takes a few passes over its own arrays.
    """

    def of_kind(findings: Column, kind: Column) -> Column:
        same = lambda f: reduce(lambda a, b: a & b, (f[c].eqNullSafe(kind[c]) for c in _KIND))
        return F.filter(findings, same)

    def pair(a: Column, b: Column) -> Column:
        return F.struct(
            *(a[c].alias(c) for c in _KIND),
            a["line"].alias("source_line"),
            finding_fingerprint(path, a).alias("source_fingerprint"),
            b["line"].alias("output_line"),
            finding_fingerprint(path, b).alias("output_fingerprint"),
        )

    def aligned(sides: Column) -> Column:
        return F.when(F.size(sides["a"]) == F.size(sides["b"]), F.zip_with(sides["a"], sides["b"], pair))

    def all_kinds(sides: Column) -> Column:
        kinds = F.array_distinct(F.transform(sides["a"], lambda f: F.struct(*(f[c].alias(c) for c in _KIND))))
        per_kind = F.transform(
            kinds, lambda k: let(F.struct(of_kind(sides["a"], k).alias("a"), of_kind(sides["b"], k).alias("b")), aligned)
        )
        return F.flatten(F.filter(per_kind, lambda pairs: pairs.isNotNull()))

    return let(F.struct(F.sort_array(source).alias("a"), F.sort_array(output).alias("b")), all_kinds)
