"""Strict loading of stored JSON tables.

A line with an unknown field, a wrong type or a failed check rejects the whole
table: the loaders raise after one distributed pass and never drop rows silently.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusguard import fixed_values as V
from corpusguard.operators.approvals import sort_entries, validate_allowlist
from corpusguard.operators.manifest import validate_manifest
from corpusguard.operators.reports import validate_report
from corpusguard.schemas import MANIFEST, REPORT, REPORT_FINDING, STORED_ALLOWLIST


class InvalidTable(ValueError):
    """A stored table breaks its contract."""


def raise_if_any(violations: DataFrame, what: str) -> None:
    """Fail with a few examples; at most five rows reach the driver."""
    examples = violations.limit(5).collect()
    if examples:
        raise InvalidTable(f"{what}: {[tuple(r) for r in examples]}")


def shape_violations(text_lines: DataFrame, schema: T.StructType, nested: dict[str, T.StructType]) -> DataFrame:
    """Lines of JSON text that do not have exactly the fields of a schema."""
    value = F.col("value")

    def beyond(keys, allowed: T.StructType):
        return F.size(F.array_except(keys, F.array(*map(F.lit, allowed.names)))) > 0

    def nested_unknown(column: str, inner: T.StructType):
        items = F.from_json(F.get_json_object(value, f"$.{column}"), "array<map<string,string>>")
        return F.exists(items, lambda item: beyond(F.map_keys(item), inner))

    unknown = beyond(F.json_object_keys(value), schema)
    problem = F.when(F.json_object_keys(value).isNull(), "malformed").when(unknown, "unknown_field")
    for column, inner in nested.items():
        problem = problem.when(nested_unknown(column, inner), f"unknown_field_in_{column}")
    return text_lines.select(problem.alias("problem")).where("problem is not null")


def load_strict(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    validate: Callable[[DataFrame], DataFrame],
    nested: dict[str, T.StructType] | None = None,
) -> DataFrame:
    raise_if_any(shape_violations(spark.read.text(path), schema, nested or {}), f"{path} has a bad shape")
    table = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    raise_if_any(validate(table), f"{path} is not valid")
    return table


def stored_allowlist_problems(stored: DataFrame) -> DataFrame:
    """Violations of a stored allowlist: rows of another format version, then those of its entries."""
    other = ~F.col("version").eqNullSafe(F.lit(V.ALLOWLIST_VERSION))
    versions = stored.where(other).select("path", "rule", F.lit("version").alias("problem"))
    return versions.unionByName(validate_allowlist(stored.where(~other)))


def load_allowlist(spark: SparkSession, path: str) -> DataFrame:
    return sort_entries(load_strict(spark, path, STORED_ALLOWLIST, stored_allowlist_problems).drop("version"))


def load_report(spark: SparkSession, path: str) -> DataFrame:
    return load_strict(spark, path, REPORT, validate_report, {"findings": REPORT_FINDING}).orderBy("path")


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    return load_strict(spark, path, MANIFEST, validate_manifest)
