"""HTML text helpers."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusguard.fixed_values import PAGE_PATTERNS, WHITESPACE
from corpusguard.functions.regex import java_pattern
from corpusguard.functions.text import trim_space


@F.pandas_udf(T.ArrayType(T.StringType()))
def _unescape_all(values: pd.Series) -> pd.Series:
    return values.map(
        lambda items: None if items is None else [html.unescape(v) if "&" in v else v for v in items]
    )


def unescape_all(values: Column, needed: Column) -> Column:
    """Decode HTML entities in an array; rows where none occurs send nothing to Python."""
    return F.coalesce(_unescape_all(F.when(needed, values)), values)


def strip_tags(fragment: Column) -> Column:
    """Without tags; what follows the last "<" that no ">" closes is kept in one step, not tried from every "<"."""
    return F.regexp_replace(fragment, F.lit(r"<[^>]++>|(<[^>]++\z)"), F.lit("$1"))


def collapse_space(text: Column) -> Column:
    """Words separated by single blanks, Unicode white space included."""
    return trim_space(F.regexp_replace(text, F.lit(f"[{WHITESPACE}]+"), F.lit(" ")))


def positive_attribute(page: Column, pattern: str) -> Column:
    """True if the first integer captured by a pattern is positive."""
    digits = F.regexp_extract(page, java_pattern(PAGE_PATTERNS[pattern]), 1)
    return F.coalesce(digits.try_cast("bigint") > 0, F.lit(False))
