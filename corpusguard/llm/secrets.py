"""Operator 4: secret scan by patterns and sliding-window entropy."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusguard.llm.common import ddl, kept_columns

# The base patterns with the least length of what they must hold.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
# What sums of logarithms may lack by rounding.
ROUNDING = 1e-9
KINDS = ("assign", "access", "hex", "entropy")


@dataclass(frozen=True)
class CharClass:
    """Alphabet of candidate strings, window length and the entropy (bits) that makes a window suspicious."""

    name: str
    members: str
    window: int
    bits: float


LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
CLASSES = (
    CharClass("hex", DIGITS + "abcdefABCDEF", 24, 3.0),
    CharClass("base32", UPPER + DIGITS, 20, 3.3),
    CharClass("base64", LOWER + UPPER + DIGITS + "+/_=-", 20, 3.5),
)
# One part of a path, file name or slug: a word or a number, or a word with a number after it.
_PART = r"(?:[A-Z]?[a-z]+[0-9]{0,8}|[A-Z]+[0-9]{0,8}|[0-9]{1,8})"
# Candidates that are known to be harmless: one-case words and numbers (with hyphens, underlines
# or slashes), identifiers in camel case, paths and slugs, UUIDs.
ALLOWED = (
    re.compile(r"[a-z/_=+-]*|[A-Z/_=+-]*|[0-9/_=+-]*"),
    re.compile(r"(?:(?:[A-Z]{2,5}(?=[A-Z][a-z]))?[A-Z]?[a-z]{2,}+[/_=+-]*+)++[0-9]{0,4}"),
    re.compile(rf"[/_=+-]*+{_PART}(?:[/_=+-]++{_PART})*+[/_=+-]*+"),
    re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}"),
)
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")


@cache
def _member_table(members: str) -> np.ndarray:
    inside = np.zeros(129, dtype=bool)
    inside[[ord(c) for c in members]] = True
    return inside


def runs(points: np.ndarray, members: str, least: int) -> list[tuple[int, int]]:
    """Maximal runs of members, of `least` characters or more; points over 128 are stored as 128."""
    inside = _member_table(members)[points]
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    starts, ends = edges[::2], edges[1::2]
    wide = ends - starts >= least
    return list(zip(starts[wide].tolist(), ends[wide].tolist()))


def suspicious(text: str, char_class: CharClass) -> list[tuple[int, int]]:
    """Unions of the windows of a candidate whose entropy reaches the class's bound.

    Counts change by one character in and one out; sum(n log n) is kept up to date, so
    a window costs constant time whatever its length.
    """
    width = char_class.window
    gain = [0.0] + [n * log2(n) for n in range(1, width + 1)]
    counts: dict[str, int] = {}
    total, found = 0.0, []
    for end, char in enumerate(text):
        n = counts.get(char, 0)
        counts[char] = n + 1
        total += gain[n + 1] - gain[n] if n + 1 <= width else 0.0
        if end >= width:
            old = text[end - width]
            n = counts[old]
            counts[old] = n - 1
            total += gain[n - 1] - gain[n] if n <= width else 0.0
        if end >= width - 1 and log2(width) - total / width >= char_class.bits - ROUNDING:
            start = end - width + 1
            if found and start <= found[-1][1]:
                found[-1] = (found[-1][0], end + 1)
            else:
                found.append((start, end + 1))
    return found


def scan(text: str, classes: tuple[CharClass, ...] = CLASSES) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all spans, sorted; kind is a place in KINDS."""
    found: list[tuple[int, int, int]] = []
    low = text.lower()
    if (":" in text or "=" in text) and any(word in low for word in _KEYWORDS):
        found += [
            (m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST
        ]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    points = np.minimum(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32), 128)
    found += [(start, 2, end) for start, end in runs(points, DIGITS + "abcdef", HEX_LEAST)]
    covered = sorted((start, end) for start, _, end in found)
    extra: list[tuple[int, int]] = []
    for char_class in classes:
        for start, end in runs(points, char_class.members, char_class.window):
            candidate = text[start:end]
            if any(pattern.fullmatch(candidate) for pattern in ALLOWED):
                continue
            extra += [(start + a, start + b) for a, b in suspicious(candidate, char_class)]
    for start, end in _merge(extra):
        if not any(a < end and start < b for a, b in covered):
            found.append((start, 3, end))
    return sorted(found)


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((start, end))
    return merged


def find_secrets(df: DataFrame, text: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """`keep` columns (default: all of df) with secrets: array<struct<kind, start, end>>.

    Positions are code points, the end is exclusive; order is start, then kind as in
    KINDS.  Null counts as empty and has no spans.  A text of any length is scanned
    whole; rows are independent, so repeated rows repeat their result and an empty table
    gives an empty one.  A column of df named secrets is replaced.
    """
    kept = kept_columns(df, text, keep, ("secrets",))
    names = [c for c in kept.columns if c != "__text"]
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                [{"kind": KINDS[kind], "start": start, "end": end} for start, kind, end in scan(value.as_py() or "")]
                for value in batch.column("__text")
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names] + [pa.array(found, pa.list_(span))], [*names, "secrets"]
            )

    return kept.mapInArrow(look, ddl(kept) + "secrets array<struct<kind:string,start:bigint,end:bigint>>")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    parts = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    return F.array_join(parts, ",")

