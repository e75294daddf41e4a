"""Manifests: encoding, validation and reconciliation with published files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusguard import fixed_values as V
from corpusguard.functions import paths
from corpusguard.functions.text import digest, trim_space
from corpusguard.schemas import MANIFEST
from corpusguard.session import materialize

_NUL = "\0"


def hash_tree(files: DataFrame, data: str = "data") -> DataFrame:
    """Path and digest of every published file."""
    return files.select("path", digest(F.col(data)).alias("sha256"))


def table_digest(table: DataFrame, columns: list[str], levels: tuple[int, ...] = (6, 3, 0)) -> DataFrame:
    """One digest for a table of any size, independent of row order.

    Rows are hashed where they are and equal rows are counted, never collected.  Row
    hashes are then folded level by level along their hexadecimal prefix: 16^6
    groups, 16^3 groups, one.  Hashes spread evenly, so no group grows hot, and above
    the first level no group holds more than 4096 digests.
    """
    row = digest(F.concat_ws(_NUL, *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)))
    folded = table.select(row.alias("key")).groupBy("key").agg(F.count(F.lit(1)).cast("string").alias("value"))
    for digits in levels:
        entry = F.concat_ws("=", "key", "value")
        folded = folded.groupBy(F.substring("key", 1, digits).alias("key")).agg(
            digest(F.array_join(F.array_sort(F.collect_list(entry)), ",")).alias("value")
        )
    return folded.select(F.col("value").alias("sha256"))


def ruleset_fingerprint(files: DataFrame) -> DataFrame:
    """One digest over the scanner's configuration, ordered by path.

    ``files`` holds the handful of configuration entries (path, content).  A table
    that grows, such as the allowlist, enters as its ``table_digest``.
    """
    entry = F.concat(F.col("path"), F.lit(_NUL), F.col("content"), F.lit(_NUL))
    ordered = F.array_sort(F.collect_list(F.struct("path", entry.alias("entry"))))
    return files.agg(digest(F.array_join(F.transform(ordered, lambda e: e["entry"]), "")).alias("ruleset_sha256"))


def with_ordinal(table: DataFrame, key: str, name: str = "ordinal") -> DataFrame:
    """Number rows 1..n in key order without one task seeing them all.

    Rows are range-partitioned, sorted and numbered inside their partition; the
    partition offsets are a table of one row per partition.
    """
    ranged = (
        table.repartitionByRange(key)
        .sortWithinPartitions(key)
        .withColumn("_id", F.monotonically_increasing_id())
    )
    # Written once: range bounds are sampled and must not be drawn twice.
    ranged = materialize(ranged, "ordinal")
    part = F.shiftright("_id", 33)
    # One row per partition: small whatever the table's size.
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(part.alias("_part"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    )
    inside = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        ranged.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, (F.col("_before") + inside + 1).cast("long"))
        .drop("_part", "_id", "_before")
    )


def manifest_rows(
    documents: DataFrame, indexes: DataFrame, scanner_version: Column, ruleset_sha256: Column
) -> DataFrame:
    """Unordered manifest entries of published documents and section indexes."""
    columns = MANIFEST.names
    body = documents.select(
        F.lit("document").alias("kind"),
        "path",
        "source_sha256",
        F.col("output_sha256").alias("sha256"),
        F.array_sort("approved_rules").alias("approved_rules"),
    ).unionByName(
        indexes.select(
            F.lit("index").alias("kind"),
            "path",
            F.lit(None).cast("string").alias("source_sha256"),
            "sha256",
            F.array().cast("array<string>").alias("approved_rules"),
        )
    )
    return body.select(
        F.lit(V.MANIFEST_VERSION).alias("version"),
        scanner_version.alias("scanner_version"),
        ruleset_sha256.alias("ruleset_sha256"),
        "kind",
        F.lit(None).cast("long").alias("ordinal"),
        "path",
        "source_sha256",
        "sha256",
        "approved_rules",
    ).select(*columns)


def encode_manifest(rows: DataFrame) -> DataFrame:
    """Manifest rows numbered in canonical order: documents, then indexes, by path."""
    keyed = rows.drop("ordinal").withColumn("_order", F.concat_ws(_NUL, "kind", "path"))
    return with_ordinal(keyed, "_order").select(*MANIFEST.names)


def _ascending_rules(rules: Column) -> Column:
    return F.forall(rules, lambda r: trim_space(r) != "") & (F.array_sort(F.array_distinct(rules)) == rules)


def manifest_problem() -> Column:
    """First problem of a single manifest row, null if there is none."""
    c = F.col
    document = c("kind") == "document"
    return (
        F.when(F.coalesce(c("version") != V.MANIFEST_VERSION, F.lit(True)), "version")
        .when(F.coalesce(trim_space(c("scanner_version")) == "", F.lit(True)), "scanner_version")
        .when(F.coalesce(~paths.valid_sha256(c("ruleset_sha256")), F.lit(True)), "ruleset_sha256")
        .when(F.coalesce(~c("kind").isin("document", "index"), F.lit(True)), "kind")
        .when(document & ~paths.valid_manifest_document(c("path")), "path")
        .when(~document & ~paths.valid_manifest_index(c("path")), "path")
        .when(document & F.coalesce(~paths.valid_sha256(c("source_sha256")), F.lit(True)), "source_sha256")
        .when(F.coalesce(~paths.valid_sha256(c("sha256")), F.lit(True)), "sha256")
        .when(document & ~_ascending_rules(c("approved_rules")), "approved_rules")
    )


def validate_manifest(manifest: DataFrame) -> DataFrame:
    """Violations: bad rows, repeated paths, ordinals other than 1 to n, and rows out of order.

    Order is checked against the predecessor found by an equi-join on the ordinal,
    not by a window over the whole table.
    """
    rows = manifest.select("path", manifest_problem().alias("problem")).where("problem is not null")
    repeated = (
        manifest.groupBy("path").count().where("count > 1").select("path", F.lit("duplicate").alias("problem"))
    )
    previous = manifest.select(
        (F.col("ordinal") + 1).alias("ordinal"),
        F.col("kind").alias("_kind"),
        F.col("path").alias("_path"),
    )
    unordered = (
        manifest.select("ordinal", "kind", "path")
        .join(previous, "ordinal")
        .where(
            ((F.col("kind") == F.col("_kind")) & (F.col("path") <= F.col("_path")))
            | (F.col("kind") < F.col("_kind"))
        )
        .select("path", F.lit("unordered").alias("problem"))
    )
    # One row of sums: ordinals are 1 to n exactly if none is null or repeated and the ends fit.
    numbers = manifest.select("ordinal").agg(
        F.count("*").alias("n"), F.countDistinct("ordinal").alias("different"), F.min("ordinal").alias("low"), F.max("ordinal").alias("high")
    )
    gapped = numbers.where("n > 0 and not (different = n and coalesce(low, 0) = 1 and coalesce(high, 0) = n)").select(
        F.lit(None).cast("string").alias("path"), F.lit("ordinals").alias("problem")
    )
    return rows.unionByName(repeated).unionByName(unordered).unionByName(gapped)


def reconcile(expected: DataFrame, actual: DataFrame, names: tuple[str, str, str], *values: str) -> DataFrame:
    """Full outer comparison by path; ``names`` label only-expected, only-actual and differing rows."""
    left = expected.select("path", F.struct(*values).alias("_e"))
    right = actual.select("path", F.struct(*values).alias("_a"))
    missing, extra, changed = names
    status = (
        F.when(F.col("_a").isNull(), missing)
        .when(F.col("_e").isNull(), extra)
        .when(~F.col("_e").eqNullSafe(F.col("_a")), changed)
    )
    return (
        left.join(right, "path", "full_outer").select("path", status.alias("status")).where("status is not null")
    )


def verify_manifest(published: DataFrame, manifest: DataFrame) -> DataFrame:
    """Published digests must equal the manifest exactly: missing, extra, changed."""
    return reconcile(manifest, published, ("missing", "extra", "changed"), "sha256")


def detect_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """Two discoveries compared: added, removed, changed."""
    return reconcile(before, after, ("removed", "added", "changed"), "sha256", "size", "modified_at")


def _with_directories(files: DataFrame) -> DataFrame:
    return (
        files.select(paths.directory(F.col("path")).alias("path"))
        .distinct()
        .where("path <> '.'")
        .select(F.explode(F.concat(F.array("path"), paths.ancestors(F.col("path")))).alias("path"))
        .distinct()
    )


def verify_boundary(present_files: DataFrame, present_directories: DataFrame, manifest: DataFrame) -> DataFrame:
    """Every file and directory present is expected and every expected file is present."""
    expected = manifest.select("path")
    unknown_files = present_files.select("path").join(expected, "path", "left_anti")
    absent_files = expected.join(present_files.select("path"), "path", "left_anti")
    unknown_directories = present_directories.where("path <> '.'").join(
        _with_directories(expected), "path", "left_anti"
    )
    return (
        unknown_files.select("path", F.lit("unexpected_file").alias("problem"))
        .unionByName(absent_files.select("path", F.lit("absent_file").alias("problem")))
        .unionByName(unknown_directories.select("path", F.lit("unexpected_directory").alias("problem")))
    )


def verify_documents(rescanned: DataFrame, manifest: DataFrame) -> DataFrame:
    """Re-scanned published files against their manifest rows.

    ``rescanned`` holds ``path``, ``unapproved`` (any unapproved output finding),
    ``blocking`` (any blocking finding) and ``rules`` (approved output rules).
    """
    registered = manifest.select(
        "path", "kind", F.coalesce("approved_rules", F.array().cast("array<string>")).alias("approved_rules")
    )
    is_index = paths.base(F.col("path")) == V.INDEX_FILE
    joined = rescanned.join(registered, "path", "full_outer")
    problem = (
        F.when(F.col("unapproved").isNull(), "not_verified")
        .when(F.col("kind").isNull(), "not_registered")
        .when((F.col("kind") == "index") != is_index, "wrong_kind")
        .when(is_index & F.col("blocking"), "index_blocked")
        .when(~is_index & F.col("unapproved"), "document_blocked")
        .when(~is_index & (F.col("approved_rules") != F.col("rules")), "approved_rules")
    )
    return joined.select("path", problem.alias("problem")).where("problem is not null")
