"""Content rules.

Every rule is a Column expression, so the same definition serves the per-line
relations and the one-pass scan.  The scan keeps a document's findings in one
array column: no shuffle is needed to order, de-duplicate or report them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusguard import fixed_values as V
from corpusguard.functions import paths, urls
from corpusguard.functions.regex import extract_all, java_pattern, matches
from corpusguard.functions.text import built_once, compute_once, contains_any, digest, let, lines, trim_space
from corpusguard.schemas import FINDINGS

_LINE_HIT = "array<struct<rule_id:string,level:string,reason:string,approvable:boolean>>"

# A rule's pattern cannot match a line without one of its literals.  Byte search
# is far cheaper than decoding the line for the regex engine.
_LITERALS = {
    "private_key": ("-----BEGIN ",),
    "credential_assignment": (":", "="),
    "credential_url": ("://",),
    "private_ipv4": ("10.", "172.", "192.168.", "127."),
    "private_ipv6": (":",),
    "unix_path": ("/",),
    "windows_path": (":\\", ":/"),
    "file_url": ("://",),
    "wiki_link": ("[[",),
    "html_tag": ("<",),
    "html_attribute": ("=", ":"),
    "markdown_link": ("](",),
    "reference_definition": ("]:",),
    "html_resource": ("=",),
}
_HOST_LITERALS = ("local", ".internal", ".lan")
_DASHED_TOKENS = ("xox", "sk-")
_UNDERSCORED_TOKENS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_")

# Rule -> patterns, in emission order.
LINE_RULES = {
    V.PRIVATE_KEY: ("private_key",),
    V.TOKEN: ("token",),
    V.CREDENTIAL: ("credential_assignment", "credential_url"),
    V.PRIVATE_NETWORK: ("private_ipv4", "private_ipv6", "private_host"),
    V.ABSOLUTE_PATH: ("unix_path", "windows_path"),
    V.FILE_URL: ("file_url",),
    V.WIKI_LINK: ("wiki_link",),
    V.DANGEROUS_HTML: ("html_tag", "html_attribute"),
}


def _guard(line: Column, pattern: str) -> Column:
    """Necessary condition for one pattern; a shared character is looked for first."""
    if pattern == "private_host":
        return let(F.lower(line), lambda lowered: contains_any(lowered, *_HOST_LITERALS))
    if pattern == "private_ipv4":
        return F.contains(line, F.lit("1")) & contains_any(line, *_LITERALS[pattern])
    if pattern == "token":
        return _dashed(line, *_DASHED_TOKENS) | _underscored_token(line) | F.contains(line, F.lit("AKIA"))
    return contains_any(line, *_LITERALS[pattern])


def _dashed(line: Column, *literals: str) -> Column:
    return F.contains(line, F.lit("-")) & contains_any(line, *literals)


def _underscored_token(line: Column) -> Column:
    return F.contains(line, F.lit("_")) & contains_any(line, *_UNDERSCORED_TOKENS)


def _guarded_match(line: Column, pattern: str) -> Column:
    return _guard(line, pattern) & matches(line, pattern)


def line_rule(line: Column, rule_id: str) -> Column:
    """True where a line rule fires; several matches still give one finding."""
    return reduce(lambda a, b: a | b, (_guarded_match(line, p) for p in LINE_RULES[rule_id]))


def _may_fire(line: Column) -> Column:
    """Cheap necessary condition for any line rule or reference, commonest literals first."""
    return (
        contains_any(line, ":", "/", "=", "[", "<")
        | _guard(line, "private_ipv4")
        | _dashed(line, *_DASHED_TOKENS, *_LITERALS["private_key"])
        | _underscored_token(line)
        | F.contains(line, F.lit("AKIA"))
        | _guard(line, "private_host")
    )


# --- whole-document rules -------------------------------------------------------


def binary_line(text: Column) -> Column:
    """Line of the first NUL, or null."""
    before = F.substring_index(text, "\0", 1)
    line = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
    return F.when(F.contains(text, F.lit("\0")), line.cast("long"))


def unclosed_front_matter(document_lines: Column) -> Column:
    first = F.get(document_lines, F.lit(0))
    opened = trim_space(
        F.when(F.startswith(first, F.lit(V.BOM)), F.substr(first, F.lit(2))).otherwise(first)
    )
    closes = lambda line: trim_space(line).isin("---", "...")
    return F.contains(first, F.lit("---")) & (opened == "---") & ~F.exists(
        F.slice(document_lines, F.lit(2), F.size(document_lines)), closes
    )


def fence_marker(trimmed: Column) -> Column:
    return F.when(F.startswith(trimmed, F.lit("```")), F.lit("```")).when(
        F.startswith(trimmed, F.lit("~~~")), F.lit("~~~")
    )


def unclosed_fence_line(document_lines: Column) -> Column:
    """Line of the fence still open at the end, 0 if none.

    A fold over the fence lines only: an open fence is closed by its own marker,
    the other marker inside it is text.
    """
    marks = F.filter(
        F.transform(
            document_lines,
            lambda line, i: F.when(
                contains_any(line, "```", "~~~"),
                F.struct((i + 1).cast("long").alias("line"), fence_marker(trim_space(line)).alias("marker")),
            ),
        ),
        lambda m: m["marker"].isNotNull(),
    )
    start = F.struct(F.lit(0).cast("long").alias("line"), F.lit("").alias("marker"))
    end = F.aggregate(
        marks,
        start,
        lambda state, m: F.when(state["marker"] == "", m)
        .when(state["marker"] == m["marker"], start)
        .otherwise(state),
    )
    return end["line"]


# --- references ------------------------------------------------------------------


def markdown_links(line: Column) -> Column:
    """``array<struct<is_image, target>>`` of inline links, left to right."""
    found = F.arrays_zip(
        extract_all(line, "markdown_link", 1).alias("mark"), extract_all(line, "markdown_link", 2).alias("target")
    )
    return F.transform(
        F.filter(found, lambda m: m["target"] != ""),
        lambda m: F.struct((m["mark"] == "!").alias("is_image"), trim_space(m["target"]).alias("target")),
    )


def reference_definitions(line: Column) -> Column:
    target = F.regexp_extract(line, java_pattern(V.PATTERNS["reference_definition"]), 1)
    return F.when(
        target != "", F.array(F.struct(F.lit(False).alias("is_image"), trim_space(target).alias("target")))
    ).otherwise(F.array().cast("array<struct<is_image:boolean,target:string>>"))


def html_resources(line: Column) -> Column:
    groups = [extract_all(line, "html_resource", g) for g in (1, 2, 3, 4)]
    return F.transform(
        F.arrays_zip(*(g.alias(n) for g, n in zip(groups, ("name", "double", "single", "bare")))),
        lambda m: F.struct(
            # Of the two names only "src" has three letters, in whatever case.
            (F.length(m["name"]) == 3).alias("is_image"),
            trim_space(
                F.coalesce(
                    *(F.nullif(m[n], F.lit("")) for n in ("double", "single", "bare")), F.lit("")
                )
            ).alias("target"),
        ),
    )


def _hit(rule_id: str, reason: str, level: str = V.BLOCK, approvable: bool = False) -> Column:
    return F.struct(
        F.lit(rule_id).alias("rule_id"),
        F.lit(level).alias("level"),
        F.lit(reason).alias("reason"),
        F.lit(approvable).alias("approvable"),
    )


def classify_reference(directory: Column, target: Column, is_image: Column) -> Column:
    """Finding struct for one reference target, null if it is harmless.

    ``directory`` is the directory of the document holding the reference.
    """

    def local(unescaped: Column) -> Column:
        absolute = F.startswith(unescaped, F.lit("/")) | F.startswith(unescaped, F.lit("~"))
        joined = paths.join(directory, F.replace(unescaped, F.lit("\\"), F.lit("/")))
        extension = F.lower(paths.extension(unescaped))
        return (
            F.when(unescaped == "", F.lit(None))
            .when(absolute, _hit(V.ABSOLUTE_PATH, V.REASONS[V.ABSOLUTE_PATH]))
            .when(let(joined, paths.escapes), _hit(V.RELATIVE_ESCAPE, V.REASONS[V.RELATIVE_ESCAPE]))
            .when(is_image, _hit(V.LOCAL_RESOURCE, V.REASON_LOCAL_IMAGE))
            .when(~extension.isin("", ".md"), _hit(V.LOCAL_RESOURCE, V.REASON_LOCAL_FILE))
        )

    def by_scheme(url: Column) -> Column:
        scheme = url["scheme"]
        web = scheme.isin("http", "https")
        mail = scheme.isin("mailto", "tel")
        return (
            F.when(~url["valid"], _hit(V.LOCAL_RESOURCE, V.REASON_UNPARSEABLE))
            .when(web & is_image, _hit(V.REMOTE_IMAGE, V.REASONS[V.REMOTE_IMAGE], V.WARNING))
            .when(web | (mail & ~is_image), F.lit(None))
            .when(scheme == "file", _hit(V.FILE_URL, V.REASONS[V.FILE_URL]))
            .when((scheme != "") & ~mail, _hit(V.LOCAL_RESOURCE, V.REASON_SCHEME))
            # The split decoded the path once; stored references are decoded again.
            .when(~urls.decodes(url["path"]), _hit(V.LOCAL_RESOURCE, V.REASON_BAD_PATH))
            .otherwise(let(urls.percent_decode(url["path"]), local))
        )

    ignored = (target == "") | F.startswith(target, F.lit("#"))
    return F.when(~ignored, let(urls.split_url(target), by_scheme))


def _reference_hits(directory: Column, line: Column) -> Column:
    """Hits of a line's references in emission order."""
    none = F.array().cast("array<struct<is_image:boolean,target:string>>")
    found = F.concat(
        F.when(_guard(line, "markdown_link"), markdown_links(line)).otherwise(none),
        F.when(_guard(line, "reference_definition"), reference_definitions(line)).otherwise(none),
        F.when(_guard(line, "html_resource"), html_resources(line)).otherwise(none),
    )
    return F.transform(found, lambda r: classify_reference(directory, r["target"], r["is_image"]))


# --- one pass over a document ------------------------------------------------------


def first_per_rule(hits: Column) -> Column:
    """Keep the first emitted hit of each rule; the result never exceeds the rule count."""
    return F.aggregate(
        hits,
        F.array().cast(_LINE_HIT),
        lambda kept, hit: F.when(
            hit.isNull() | F.exists(kept, lambda k: k["rule_id"] == hit["rule_id"]), kept
        ).otherwise(F.concat(kept, F.array(hit))),
    )


def _line_hits(directory: Column, line: Column) -> Column:
    direct = [
        F.when(line_rule(line, rule), _hit(rule, V.REASONS[rule], approvable=rule in V.APPROVABLE_RULES))
        for rule in LINE_RULES
    ]
    return first_per_rule(F.concat(F.array(*direct), _reference_hits(directory, line)))


def scan_text(document_path: Column, text: Column) -> Column:
    """Findings of one valid UTF-8 document, sorted by line and rule."""

    def whole(document: Column) -> Column:
        document_lines = document["lines"]
        fence = F.when(contains_any(text, "```", "~~~"), unclosed_fence_line(document_lines)).otherwise(
            F.lit(0).cast("long")
        )
        at = lambda line, rule: F.struct(
            line.alias("line"),
            F.lit(rule).alias("rule_id"),
            F.lit(V.BLOCK).alias("level"),
            F.lit(V.REASONS[rule]).alias("reason"),
            F.lit(False).alias("approvable"),
        )
        front_matter = F.when(unclosed_front_matter(document_lines), F.lit(1).cast("long"))
        structural = F.filter(
            F.array(
                at(binary_line(text), V.BINARY),
                at(front_matter, V.FRONT_MATTER),
                at(fence, V.UNCLOSED_FENCE),
            ),
            lambda f: f["line"] > 0,
        )
        by_line = F.transform(
            document_lines,
            lambda line, i: F.when(
                _may_fire(line),
                F.transform(
                    _line_hits(document["directory"], line),
                    lambda h: F.struct(
                        (i + 1).cast("long").alias("line"),
                        h["rule_id"].alias("rule_id"),
                        h["level"].alias("level"),
                        h["reason"].alias("reason"),
                        h["approvable"].alias("approvable"),
                    ),
                ),
            ),
        )
        return F.concat(structural, F.flatten(F.filter(by_line, lambda x: x.isNotNull())))

    document = F.struct(lines(text).alias("lines"), paths.directory(document_path).alias("directory"))
    return F.sort_array(let(document, whole)).cast(FINDINGS)


@built_once
def content_findings(content: str) -> Column:
    """Findings of the named text or binary column of the row's ``path``.

    Undecodable content yields a single finding and skips every other rule.
    """
    text = F.col(content).cast("string")
    invalid = F.array(
        F.struct(
            F.lit(0).cast("long").alias("line"),
            F.lit(V.INVALID_UTF8).alias("rule_id"),
            F.lit(V.BLOCK).alias("level"),
            F.lit(V.REASONS[V.INVALID_UTF8]).alias("reason"),
            F.lit(False).alias("approvable"),
        )
    ).cast(FINDINGS)
    return F.when(~F.is_valid_utf8(text), invalid).otherwise(scan_text(F.col("path"), text))


def scan_documents(
    documents: DataFrame, content: str = "text", sha256: str = "sha256", findings: str = "findings"
) -> DataFrame:
    """``path, content`` -> adds the content digest and the findings array.

    Narrow: one row in, one row out, nothing shuffled.
    """
    with_digest = documents.withColumn(sha256, digest(F.col(content)))
    return compute_once(with_digest, findings, content_findings(content))


def flatten_findings(results: DataFrame, *keep: str) -> DataFrame:
    """One row per finding, with the document's path and digest."""
    columns = dict.fromkeys(("path", "sha256", *keep))
    # The outer form: an inner explode would first filter on the whole scan expression.
    exploded = results.select(*columns, F.explode_outer("findings").alias("f"))
    return exploded.where(F.col("f").isNotNull()).select(*columns, "f.*")


# --- line relations ------------------------------------------------------------------


def split_lines(documents: DataFrame, content: str = "text") -> DataFrame:
    """One row per line, numbered from 1."""
    return documents.select("path", F.posexplode(lines(F.col(content))).alias("p", "text")).select(
        "path", (F.col("p") + 1).cast("long").alias("line"), "text"
    )


def rule_lines(line_table: DataFrame, rule_id: str) -> DataFrame:
    """Lines on which one rule fires, without the matched text."""
    return line_table.where(line_rule(F.col("text"), rule_id)).select(
        "path",
        "line",
        F.lit(rule_id).alias("rule_id"),
        F.lit(V.BLOCK).alias("level"),
        F.lit(rule_id in V.APPROVABLE_RULES).alias("approvable"),
    )


def reference_rows(line_table: DataFrame, kind: str) -> DataFrame:
    """Reference targets of one kind with their position on the line."""
    extract = {
        "markdown_link": markdown_links,
        "reference_definition": reference_definitions,
        "html_resource": html_resources,
    }[kind]
    text = F.col("text")
    return (
        line_table.where(_guarded_match(text, kind))
        .select("path", "line", F.posexplode(extract(text)).alias("position", "r"))
        .select("path", "line", F.col("position").cast("long").alias("position"), "r.is_image", "r.target")
    )
