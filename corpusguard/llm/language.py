"""Operator 1: language identification by error-correcting output codes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusguard.llm.common import ddl, kept_columns

UNDETERMINED = "und"
# n-gram features are hashed to this many buckets (a power of two) for each order.
BITS = 15
ORDERS = (2, 3)
# A decision whose lead over the second codeword is smaller is flagged.
AMBIGUITY = 0.05
# Evidence of this many n-grams counts in full; more doesn't make a bit surer.
FULL_EVIDENCE = 64
# Texts are hashed in slices of this many characters.
SLICE = 1 << 20

_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)


@cache
def _letters() -> np.ndarray:
    """Lower-cased code point of each letter; everything else becomes a blank."""
    fold = np.full(0x110000, 32, dtype=np.uint32)
    for point in range(0x110000):
        char = chr(point)
        if char.isalpha():
            lower = char.lower()
            fold[point] = ord(lower) if len(lower) == 1 else point
    return fold


def letters_of(text: str) -> np.ndarray:
    """Letters with runs of anything else as one blank, and a blank at either end; empty without letters."""
    points = _letters()[np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)]
    if not len(points):
        return points
    blank = points == 32
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    points = points[keep]
    if not (points != 32).any():
        return points[:0]
    return np.concatenate(([32], points, [32])).astype(np.uint32)


def buckets_of(points: np.ndarray) -> Iterator[np.ndarray]:
    """Hashed n-grams of all orders, slice by slice."""
    size = 1 << BITS
    for place, order in enumerate(ORDERS):
        for start in range(0, max(1, len(points) - order + 1), SLICE):
            part = points[start : start + SLICE + order - 1]
            count = len(part) - order + 1
            if count <= 0:
                continue
            mixed = np.zeros(count, dtype=np.uint32)
            for k in range(order):
                mixed = (mixed ^ part[k : k + count]) * _MULTIPLIERS[k]
                mixed ^= mixed >> np.uint32(15)
            yield (mixed & np.uint32(size - 1)).astype(np.int64) + place * size


@dataclass(frozen=True)
class Model:
    """Languages in order of name, their codewords (+1/-1), n-gram weights per bit, trust per bit."""

    languages: tuple[str, ...]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray


def codewords(count: int) -> np.ndarray:
    """One row of +1/-1 per language; any two rows differ in many bits.

    Up to six languages get the exhaustive code (each split of the languages once), more
    get rows drawn by a fixed seed, of a length that grows with the logarithm of the
    count, kept only if far enough from all earlier rows.
    """
    if count <= 1:
        return np.ones((count, 0), dtype=np.int8)
    if count <= 6:
        splits = np.arange(1, 1 << (count - 1))
        bits = (splits[None, :] >> np.arange(count)[:, None]) & 1
        return (1 - 2 * bits).astype(np.int8)
    length = 8 * int(np.ceil(np.log2(count))) + 7
    random = np.random.default_rng(20_011)
    apart = length // 3
    rows = np.empty((0, length), dtype=np.int8)
    while len(rows) < count:
        row = random.choice(np.array([-1, 1], dtype=np.int8), length)
        if not len(rows) or (rows != row).sum(axis=1).min() >= apart:
            rows = np.vstack([rows, row])
    return rows[:, (rows.min(axis=0) < rows.max(axis=0))]


def count_ngrams(labelled: DataFrame, text: str, lang: str) -> DataFrame:
    """lang, bucket, n over all labelled rows.  Each task counts densely before anything is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(ORDERS) << BITS
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for value, name in zip(batch.column(0), batch.column(1).to_pylist()):
                own = counts.setdefault(name, np.zeros(size, dtype=np.int64))
                for buckets in buckets_of(letters_of(value.as_py())):
                    own += np.bincount(buckets, minlength=size) if len(buckets) > 4096 else 0
                    if len(buckets) <= 4096:
                        np.add.at(own, buckets, 1)
        for name, own in sorted(counts.items()):
            found = np.flatnonzero(own)
            for start in range(0, max(1, len(found)), 20_000):
                part = found[start : start + 20_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(part), pa.string()), pa.array(part), pa.array(own[part])],
                    ["lang", "bucket", "n"],
                )

    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(
        F.col(text).alias("text"), F.col(lang).alias("lang")
    )
    return (
        rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    )


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Fit one binary n-gram classifier per bit of the codewords.

    What reaches the driver is one count per language and bucket: its size depends on
    the languages, not on the rows.
    """
    counted = count_ngrams(labelled, text, lang).toPandas()
    languages = tuple(sorted(counted["lang"].unique()))
    counts = np.zeros((len(languages), len(ORDERS) << BITS))
    place = {name: k for k, name in enumerate(languages)}
    counts[counted["lang"].map(place).to_numpy(int), counted["bucket"].to_numpy(int)] = counted["n"].to_numpy()
    return from_counts(languages, counts)


def from_counts(languages: tuple[str, ...], counts: np.ndarray) -> Model:
    code = codewords(len(languages))
    share = np.empty_like(counts)
    size = 1 << BITS
    for order in range(len(ORDERS)):
        part = counts[:, order * size : (order + 1) * size]
        share[:, order * size : (order + 1) * size] = (part + 0.1) / (part.sum(axis=1, keepdims=True) + 0.1 * size)
    weights = np.empty((counts.shape[1], code.shape[1]), dtype=np.float32)
    trust = np.empty(code.shape[1])
    for bit in range(code.shape[1]):
        yes, no = share[code[:, bit] > 0].mean(axis=0), share[code[:, bit] < 0].mean(axis=0)
        ratio = np.log(yes) - np.log(no)
        weights[:, bit] = ratio
        trust[bit] = ((yes - no) * ratio).sum()
    return Model(languages, code, weights, trust / trust.sum() if len(trust) and trust.sum() > 0 else trust)


def decide(model: Model, text: str) -> tuple[str, float, bool]:
    """Language, score and ambiguity of one text."""
    points = letters_of(text)
    if not len(points) or not model.languages:
        return UNDETERMINED, 0.0, False
    if len(model.languages) == 1:
        return model.languages[0], 1.0, False
    total, count = np.zeros(model.code.shape[1]), 0
    for buckets in buckets_of(points):
        count += len(buckets)
        if len(buckets) < 30_000:
            total += model.weights[buckets].sum(axis=0, dtype=np.float64)
        else:
            total += np.bincount(buckets, minlength=len(model.weights)) @ model.weights.astype(np.float64)
    margin = total / max(count, 1) * min(count, FULL_EVIDENCE)
    loss = np.logaddexp(0.0, -model.code * margin) @ model.trust
    odds = np.exp(-(loss - loss.min()))
    odds /= odds.sum()
    order = np.argsort(loss, kind="stable")
    return model.languages[order[0]], float(odds[order[0]]), bool(odds[order[0]] - odds[order[1]] < AMBIGUITY)


def identify(df: DataFrame, model: Model, text: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """`keep` columns (default: all of df) with lang_pred, score, ambiguous.

    Null, empty and letterless texts are `und` with score 0.  A text of any length is
    judged whole.  Ties go to the language whose name sorts first.  Repeated rows are
    judged each for itself; an empty table gives an empty result.  Columns of df named
    like an output column are replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    own = ("lang_pred", "score", "ambiguous")
    kept = kept_columns(df, text, keep, own)
    names = [c for c in kept.columns if c != "__text"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [decide(shared.value, value.as_py() or "") for value in batch.column("__text")]
            langs, scores, flags = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names]
                + [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(flags, pa.bool_())],
                [*names, *own],
            )

    return kept.mapInArrow(judge, ddl(kept) + "lang_pred string, score double, ambiguous boolean")
