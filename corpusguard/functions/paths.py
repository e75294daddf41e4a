"""Lexical path functions and the path, hash and identifier validators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusguard.fixed_values import (
    INDEX_FILE,
    RULE_ID_PATTERN,
    SHA256_PATTERN,
    TEMPORARY_MARKERS,
)
from corpusguard.functions.regex import matches_re2
from corpusguard.functions.text import let

# A component that is empty, "." or "..": only such paths need folding.
_UNCLEAN = r"(?:^|/)\.{0,2}(?:/|\z)"
_STRINGS = "array<string>"


def _folded(path: Column, rooted: Column | bool) -> Column:
    keep_root = F.lit(rooted) if isinstance(rooted, bool) else rooted
    parts = F.filter(F.split(path, "/", -1), lambda x: (x != "") & (x != "."))

    def step(done: Column, part: Column) -> Column:
        can_drop = (part == "..") & (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1)) != "..")
        return (
            F.when(can_drop, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
            .when((part == "..") & keep_root, done)
            .otherwise(F.concat(done, F.array(part)))
        )

    return F.array_join(F.aggregate(parts, F.array().cast(_STRINGS), step), "/")


def clean(path: Column) -> Column:
    """Fold ``.`` and ``..`` lexically; leading ``..`` survive in relative paths."""

    def fold(p: Column) -> Column:
        rooted = F.startswith(p, F.lit("/"))
        return F.when(~F.rlike(p, F.lit(_UNCLEAN)), p).otherwise(
            let(
                _folded(p, rooted),
                lambda joined: F.when(rooted, F.concat(F.lit("/"), joined))
                .when(joined == "", F.lit("."))
                .otherwise(joined),
            )
        )

    return let(path, fold)


def clean_relative(path: Column) -> Column:
    """As ``clean`` but a leading slash means the root of the tree itself."""

    def fold(p: Column) -> Column:
        return F.when(~F.rlike(p, F.lit(_UNCLEAN)), p).otherwise(
            let(_folded(p, False), lambda joined: F.when(joined == "", F.lit(".")).otherwise(joined))
        )

    return let(path, fold)


def join(directory: Column, relative: Column) -> Column:
    return clean(F.concat(directory, F.lit("/"), relative))


def escapes(cleaned: Column) -> Column:
    return (cleaned == "..") | F.startswith(cleaned, F.lit("../"))


def base(path: Column) -> Column:
    last = F.substring_index(F.rtrim(path, F.lit("/")), "/", -1)
    return F.when(path == "", F.lit(".")).when(last == "", F.lit("/")).otherwise(last)


def directory(path: Column) -> Column:
    last = F.substring_index(path, "/", -1)
    head = F.substr(path, F.lit(1), F.length(path) - F.length(last) - 1)
    return F.when(~F.contains(path, F.lit("/")), F.lit(".")).otherwise(
        clean(F.coalesce(F.nullif(head, F.lit("")), F.lit("/")))
    )


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"\.[^./]*\z", 0)


def ancestors(path: Column) -> Column:
    """All ancestor directories of a clean relative path, without the root."""
    parts = F.split(path, "/", -1)
    count = F.size(parts)
    return F.when(
        count > 1,
        F.transform(
            F.sequence(F.lit(1), F.greatest(count - 1, F.lit(1))),
            lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"),
        ),
    ).otherwise(F.array().cast(_STRINGS))


def hidden_or_temporary(path: Column) -> Column:
    def is_hidden(part: Column) -> Column:
        test = (
            F.startswith(part, F.lit("."))
            | F.startswith(part, F.lit("#"))
            | F.endswith(part, F.lit("#"))
            | F.endswith(part, F.lit("~"))
        )
        lowered = F.lower(part)
        for marker in TEMPORARY_MARKERS:
            test = test | F.endswith(lowered, F.lit(marker)) | F.contains(lowered, F.lit(marker + "."))
        return test

    return F.exists(F.split(path, "/", -1), is_hidden)


def valid_document_path(path: Column, allow_backslash: bool = False) -> Column:
    """Relative, clean, lower-case ``.md``, no hidden component."""
    excluded = "/" if allow_backslash else r"/\\"
    part = f"[^.{excluded}][^{excluded}]*"
    return F.rlike(path, F.lit(rf"^(?:{part}/)*{part}\.md\z"))


def valid_snapshot_path(path: Column) -> Column:
    return (path != "") & ~F.contains(path, F.lit("\\")) & ~F.rlike(path, F.lit(_UNCLEAN))


def visible_path(path: Column) -> Column:
    return ~F.rlike(path, F.lit(r"(?:^|/)(?:\.|/|\z)|\p{Cc}"))


def valid_manifest_document(path: Column) -> Column:
    return (
        valid_snapshot_path(path)
        & visible_path(path)
        & (extension(path) == ".md")
        & (base(path) != INDEX_FILE)
    )


def valid_manifest_index(path: Column) -> Column:
    return valid_snapshot_path(path) & visible_path(path) & (base(path) == INDEX_FILE)


def valid_sha256(value: Column) -> Column:
    return matches_re2(value, SHA256_PATTERN)


def valid_rule_id(value: Column) -> Column:
    return matches_re2(value, RULE_ID_PATTERN)
