"""String helpers shared by the rules, the transform and the link checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusguard.fixed_values import BOM, WHITESPACE


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside one expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def compute_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add an expensive column that later filters and projections do not repeat.

    The optimizer copies an expression into every filter that reads it; it does not
    push filters through a generator, so the value is produced by one.
    """
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def built_once(build: Callable[..., Column]) -> Callable[..., Column]:
    """Cache a large expression over named columns for the life of the session.

    Building one costs thousands of driver calls; the Column itself is only a tree
    of unresolved names and can be used in any number of queries.
    """
    built: dict[tuple, Column] = {}

    def cached(*names: str) -> Column:
        key = (id(SparkContext._gateway), *names)
        if key not in built:
            built[key] = build(*names)
        return built[key]

    return cached


def trim_space(value: Column) -> Column:
    """Unicode trim; Spark's plain ``trim`` removes U+0020 only."""
    return F.btrim(value, F.lit(WHITESPACE))


def contains_any(value: Column, *needles: str) -> Column:
    test = F.contains(value, F.lit(needles[0]))
    for needle in needles[1:]:
        test = test | F.contains(value, F.lit(needle))
    return test


def raw_lines(text: Column) -> Column:
    """Lines as stored, a carriage return kept at the end of its line."""
    return F.split(text, "\n", -1)


def lines(text: Column) -> Column:
    """Lines after CRLF normalisation; a trailing newline gives a last empty line."""
    return raw_lines(F.replace(text, F.lit("\r\n"), F.lit("\n")))


def digest(value: Column) -> Column:
    return F.sha2(value, 256)


def strip_bom(text: Column) -> Column:
    return F.when(F.startswith(text, F.lit(BOM)), F.substr(text, F.lit(2))).otherwise(text)


def quote_yaml(value: Column) -> Column:
    quoted = value
    for raw, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        quoted = F.replace(quoted, F.lit(raw), F.lit(escaped))
    return F.concat(F.lit('"'), quoted, F.lit('"'))


def utc_time(moment: Column) -> Column:
    """ISO text in UTC to the second, whatever the session's zone."""
    epoch = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00"))
    at = epoch + F.make_dt_interval(secs=F.unix_seconds(moment))
    return F.concat(F.replace(at.cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))


def count_of(value: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    removed = F.length(value) - F.length(F.replace(value, F.lit(needle), F.lit("")))
    return (removed / F.lit(len(needle))).cast("long")
