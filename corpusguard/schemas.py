"""Row types shared by the operators."""

from pyspark.sql import types as T

FINDING = T.StructType(
    [
        T.StructField("line", T.LongType()),
        T.StructField("rule_id", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("approvable", T.BooleanType()),
    ]
)
FINDINGS = T.ArrayType(FINDING)

RECEIPT = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("sha256", T.StringType()),
        T.StructField("completed", T.BooleanType()),
        T.StructField(
            "findings",
            T.ArrayType(T.StructType([T.StructField("rule_id", T.StringType()), T.StructField("line", T.LongType())])),
        ),
    ]
)

ALLOWLIST = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("source_sha256", T.StringType()),
        T.StructField("source_finding_fingerprint", T.StringType()),
        T.StructField("source_line", T.LongType()),
        T.StructField("output_sha256", T.StringType()),
        T.StructField("output_finding_fingerprint", T.StringType()),
        T.StructField("output_line", T.LongType()),
        T.StructField("rule", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("approved_at", T.TimestampType()),
        T.StructField("expires_at", T.TimestampType()),
    ]
)
# As stored: every row says which version of the format it has.
STORED_ALLOWLIST = T.StructType([T.StructField("version", T.IntegerType()), *ALLOWLIST.fields])
# A document cannot hold two entries with these six equal.
ENTRY_KEY = (
    "path",
    "source_sha256",
    "source_finding_fingerprint",
    "output_sha256",
    "output_finding_fingerprint",
    "rule",
)
ENTRY_ORDER = ("path", "source_sha256", "rule", "source_finding_fingerprint", "output_finding_fingerprint")

REPORT_FINDING = T.StructType(
    [
        T.StructField("rule", T.StringType()),
        T.StructField("line", T.LongType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("reason", T.StringType()),
    ]
)
REPORT = T.StructType(
    [
        T.StructField("version", T.IntegerType()),
        T.StructField("generated_at", T.TimestampType()),
        T.StructField("path", T.StringType()),
        T.StructField("sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("findings", T.ArrayType(REPORT_FINDING)),
        T.StructField("detected_at", T.TimestampType()),
        T.StructField("status", T.StringType()),
    ]
)

INVENTORY_FINDING = T.StructType(
    [
        T.StructField("rule", T.StringType()),
        T.StructField("line", T.LongType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("approved", T.BooleanType()),
    ]
)

INVENTORY = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("sha256", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("findings", T.ArrayType(INVENTORY_FINDING)),
    ]
)
INVENTORY_HEADER = T.StructType(
    [
        T.StructField("version", T.IntegerType()),
        T.StructField("generated_at", T.TimestampType()),
        T.StructField("candidate_count", T.LongType()),
        T.StructField("passed_count", T.LongType()),
        T.StructField("excluded_count", T.LongType()),
    ]
)

# One row per manifest entry; ``kind`` is "document" or "index" and ``sha256``
# is the digest of the published text.
MANIFEST = T.StructType(
    [
        T.StructField("version", T.IntegerType()),
        T.StructField("scanner_version", T.StringType()),
        T.StructField("ruleset_sha256", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("ordinal", T.LongType()),
        T.StructField("path", T.StringType()),
        T.StructField("source_sha256", T.StringType()),
        T.StructField("sha256", T.StringType()),
        T.StructField("approved_rules", T.ArrayType(T.StringType())),
    ]
)
