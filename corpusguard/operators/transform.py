"""Markdown -> published document, as string expressions over the line array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusguard import fixed_values as V
from corpusguard.functions import paths
from corpusguard.functions.text import (
    built_once,
    contains_any,
    digest,
    let,
    quote_yaml,
    raw_lines,
    strip_bom,
    trim_space,
    utc_time,
)
from corpusguard.operators.rules import fence_marker

_HEADING = "struct<index:int,marker:string,title:string>"


def has_front_matter(text: Column) -> Column:
    start = F.ltrim(text, F.lit("\r\n\t "))
    tests = [F.startswith(start, F.lit(m)) for m in ("---\n", "---\r\n", "+++\n", "{\n")]
    return tests[0] | tests[1] | tests[2] | tests[3]


def heading_title(trimmed_line: Column) -> Column:
    """Title of a ``# `` line; a closing run of ``#`` goes only after a blank."""
    title = trim_space(F.substr(trimmed_line, F.lit(3)))
    return trim_space(F.regexp_replace(title, r"(?s)^(.*[ \t])#+\z", "$1"))


def first_heading(document_lines: Column) -> Column:
    """``struct(index, marker, title)`` of the first heading outside fences.

    ``index`` counts from 0 and is null if there is none.  The fold visits fence
    and heading lines only.
    """
    marks = F.filter(
        F.transform(
            document_lines,
            lambda line, i: F.when(
                contains_any(line, "# ", "```", "~~~"),
                let(
                    trim_space(line),
                    lambda t: F.struct(
                        i.alias("index"),
                        F.coalesce(fence_marker(t), F.lit("")).alias("marker"),
                        F.when(F.startswith(t, F.lit("# ")), heading_title(t))
                        .otherwise(F.lit(""))
                        .alias("title"),
                    ),
                ),
            ),
        ),
        lambda m: (m["marker"] != "") | (m["title"] != ""),
    )

    def heading(index: Column, marker: Column, title: Column) -> Column:
        return F.struct(index.alias("index"), marker.alias("marker"), title.alias("title")).cast(_HEADING)

    nowhere, empty = F.lit(None).cast("int"), F.lit("")
    none = heading(nowhere, empty, empty)

    def step(state: Column, m: Column) -> Column:
        open_fence = state["marker"] != ""
        return (
            F.when(state["index"].isNotNull(), state)
            .when((m["marker"] != "") & ~open_fence, heading(nowhere, m["marker"], empty))
            .when((m["marker"] != "") & (m["marker"] == state["marker"]), none)
            .when((m["marker"] == "") & ~open_fence, m.cast(_HEADING))
            .otherwise(state)
        )

    return F.aggregate(marks, none, step)


def _publishable(path: Column, text: Column) -> Column:
    return (
        paths.valid_document_path(path, allow_backslash=True)
        & F.is_valid_utf8(text)
        & ~has_front_matter(strip_bom(text))
    )


@built_once
def published_form(text_name: str, modified_name: str) -> Column:
    """``title``, ``output`` (the published text) of the row, or null where the document is refused.

    The first heading becomes the title and leaves the body with one blank line
    after it; without a heading the file name is the title.
    """
    path, text = F.col("path"), F.col(text_name).cast("string")
    modified = F.col(modified_name)
    lastmod = F.when(
        modified.isNotNull(),
        F.concat(
            F.lit("lastmod: "),
            quote_yaml(utc_time(modified)),
            F.lit("\n"),
        ),
    ).otherwise(F.lit(""))

    def body_without(d: Column) -> Column:
        rows, at = d["lines"], d["heading"]["index"]
        after = F.get(rows, at + 1)
        skip = at + 1 + F.when(trim_space(after) == "", F.lit(1)).otherwise(F.lit(0))
        tail = F.slice(rows, skip + 1, F.greatest(F.size(rows) - skip, F.lit(0)))
        head = F.array_join(F.slice(rows, F.lit(1), at), "\n")
        return F.concat(head, F.when(at > 0, F.lit("\n")).otherwise(F.lit("")), F.array_join(tail, "\n"))

    def document(d: Column) -> Column:
        found = d["heading"]["index"].isNotNull()
        file_title = F.regexp_replace(paths.base(path), r"\.md\z", "")
        return F.struct(
            F.when(found, d["heading"]["title"]).otherwise(file_title).alias("title"),
            F.when(found, body_without(d)).otherwise(strip_bom(text)).alias("body"),
        )

    def emit(d: Column) -> Column:
        unfinished = (d["body"] != "") & ~F.endswith(d["body"], F.lit("\n"))
        output = F.concat(
            F.lit("---\ntitle: "),
            quote_yaml(d["title"]),
            F.lit("\n"),
            lastmod,
            F.lit("---\n\n"),
            d["body"],
            F.when(unfinished, F.lit("\n")).otherwise(F.lit("")),
        )
        return F.when(d["title"] != "", F.struct(d["title"].alias("title"), output.alias("output")))

    parsed = let(
        raw_lines(strip_bom(text)),
        lambda rows: F.struct(rows.alias("lines"), first_heading(rows).alias("heading")),
    )
    return F.when(_publishable(path, text), let(let(parsed, document), emit))


def transformed(text_name: str, modified_name: str) -> Column:
    """Published text of the row, or null where the document is refused."""
    return published_form(text_name, modified_name)["output"]


def transform_error(path: Column, text: Column) -> Column:
    """Why a document is refused, null if it is not."""
    return (
        F.when(~paths.valid_document_path(path, allow_backslash=True), "path")
        .when(~F.is_valid_utf8(text), "encoding")
        .when(has_front_matter(strip_bom(text)), "front_matter")
    )


def transform_documents(
    documents: DataFrame, content: str = "text", modified: str = "modified_at"
) -> DataFrame:
    """Add ``output`` (null where refused) and ``transform_error``."""
    return documents.select(
        "*",
        transformed(content, modified).alias("output"),
        transform_error(F.col("path"), F.col(content).cast("string")).alias("transform_error"),
    )


def section_index(relative_directory: Column) -> Column:
    """Index document of a section directory; null for a path outside the tree."""
    cleaned = paths.clean(relative_directory)
    title = F.when(cleaned == ".", F.lit(V.ROOT_SECTION_TITLE)).otherwise(paths.base(cleaned))
    text = F.concat(F.lit("---\ntitle: "), quote_yaml(title), F.lit("\n---\n\n"))
    return F.when(~paths.escapes(cleaned) & ~F.startswith(cleaned, F.lit("/")), text)


def section_directories(candidates: DataFrame) -> DataFrame:
    """All ancestor directories of all candidates, and the root.

    Directories are made distinct before their ancestors are expanded, so a hot
    directory costs one row per task.
    """
    direct = candidates.select(paths.directory(F.col("path")).alias("directory")).distinct()
    expanded = direct.select(
        F.explode(
            F.concat(
                F.array(F.lit(".")),
                F.when(F.col("directory") == ".", F.array().cast("array<string>")).otherwise(
                    F.concat(F.array("directory"), paths.ancestors(F.col("directory")))
                ),
            )
        ).alias("directory")
    )
    root = candidates.sparkSession.range(1).select(F.lit(".").alias("directory"))
    return expanded.unionByName(root).distinct()


def build_indexes(candidates: DataFrame) -> DataFrame:
    """One ``_index.md`` per section directory."""
    directory = F.col("directory")
    return section_directories(candidates).select(
        F.when(directory == ".", F.lit(V.INDEX_FILE))
        .otherwise(F.concat(directory, F.lit("/" + V.INDEX_FILE)))
        .alias("path"),
        section_index(directory).alias("data"),
    ).withColumn("sha256", digest(F.col("data")))
