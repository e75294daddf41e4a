"""Operator 9: benchmark decontamination by greedy string tiling."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusguard.llm.common import ddl, kept_columns

# Words of a seed and of the shortest tile, and the share of an item's words that tiles must cover.
SEED, COVERAGE = 4, 0.6
# Tokens of benchmark items that tasks hold at once; a larger benchmark is worked off in blocks.
BLOCK_TOKENS = 2_000_000

WORD = re.compile(r"\w+")
_PRIME, _BASE = (1 << 61) - 1, 1_000_003


def tokens_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


@dataclass(frozen=True)
class Items:
    """A block of benchmark items: number of each word, items' tokens as numbers, (item, place) by
    seed, and by seed length the sorted hashes of seeds."""

    words: dict[str, int]
    ids: tuple
    tokens: tuple[tuple[int, ...], ...]
    seeds: dict[tuple[int, ...], tuple[tuple[int, int], ...]]
    hashes: dict[int, np.ndarray]


def items_of(rows: list[tuple], length: int) -> Items:
    words: dict[str, int] = {}
    ids, tokens = [], []
    seeds: dict[tuple[int, ...], list[tuple[int, int]]] = {}
    for item_id, text in rows:
        own = tuple(words.setdefault(word, len(words)) for word in tokens_of(text or ""))
        if not own:
            continue
        size = min(length, len(own))
        for k in range(len(own) - size + 1):
            seeds.setdefault(own[k : k + size], []).append((len(ids), k))
        ids.append(item_id)
        tokens.append(own)
    hashes = {
        size: np.unique([_seed_hashes(np.array(seed), size)[0] for seed in seeds if len(seed) == size])
        for size in {len(seed) for seed in seeds}
    }
    return Items(words, tuple(ids), tuple(tokens), {seed: tuple(found) for seed, found in seeds.items()}, hashes)


def _seed_hashes(numbers: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` numbers, by its start."""
    count = max(0, len(numbers) - size + 1)
    total = np.zeros(count, dtype=np.int64)
    for k in range(size):
        total = total * _BASE + numbers[k : k + count]
    return total


def _rolling(values: tuple[int, ...], size: int) -> Iterator[tuple[int, int]]:
    """(start, Karp-Rabin hash) of runs of `size` values; the hash drops one value and takes in the next."""
    power = pow(_BASE, size - 1, _PRIME)
    code = 0
    for at, value in enumerate(values):
        if at >= size:
            code = (code - (values[at - size] + 1) * power) % _PRIME
        code = (code * _BASE + value + 1) % _PRIME
        if at + 1 >= size:
            yield at - size + 1, code


def _matches(pattern: tuple[int, ...], text: tuple[int, ...], least: int) -> list[tuple[int, int, int]]:
    """(-length, start in pattern, start in text) of the longest common stretches.

    Equal hashes of `least` tokens are compared in full; seeds that follow one another in
    both sequences grow into one match.
    """
    by_hash: dict[int, list[int]] = {}
    for start, code in _rolling(pattern, least):
        by_hash.setdefault(code, []).append(start)
    seeds = [
        (t - p, p)
        for t, code in (_rolling(text, least) if by_hash else ())
        for p in by_hash.get(code, ())
        if pattern[p : p + least] == text[t : t + least]
    ]
    found: list[tuple[int, int, int]] = []
    before = None
    for shift, p in sorted(seeds):
        if before == (shift, p - 1):
            length, start, at = found[-1]
            found[-1] = (length - 1, start, at)
        else:
            found.append((-least, p, p + shift))
        before = (shift, p)
    return found


def tiles(pattern: tuple[int, ...], text: tuple[int, ...], least: int) -> list[tuple[int, int, int]]:
    """Greedy tiling: (start in pattern, start in text, length), the longest free matches first.

    Matches wait in order of length, equal ones by position.  One that marked tokens
    reach into goes back with its free pieces, so what comes next is always the longest
    match of free tokens.
    """
    if len(pattern) < least or least < 1:
        return []
    taken_p, taken_t = bytearray(len(pattern)), bytearray(len(text))
    waiting = _matches(pattern, text, least)
    heapq.heapify(waiting)
    found: list[tuple[int, int, int]] = []
    while waiting:
        length, p, t = heapq.heappop(waiting)
        size = -length
        if taken_p.find(1, p, p + size) < 0 and taken_t.find(1, t, t + size) < 0:
            taken_p[p : p + size] = taken_t[t : t + size] = b"\1" * size
            found.append((p, t, size))
            continue
        free = 0
        for k in range(size + 1):
            if k < size and not taken_p[p + k] and not taken_t[t + k]:
                free += 1
                continue
            if free >= least:
                heapq.heappush(waiting, (-free, p + k - free, t + k - free))
            free = 0
    return found


def overlaps(text: str, items: Items, length: int, coverage: float) -> list[tuple[int, float]]:
    """(item number, share of its tokens in tiles) of the items whose shared seeds can reach the coverage."""
    get = items.words.get
    known = [get(word, -1) for word in tokens_of(text)]
    candidates: dict[int, tuple[list[int], set[int]]] = {}
    numbers = np.array(known, dtype=np.int64)
    for size, hashes in items.hashes.items():
        own = _seed_hashes(numbers, size)
        places = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
        for k in np.flatnonzero(hashes[places] == own).tolist():
            for item, at in items.seeds.get(tuple(known[k : k + size]), ()):
                starts, covered = candidates.setdefault(item, ([], set()))
                starts.append(k)
                covered.update(range(at, at + size))
    found = []
    for item, (places, reachable) in sorted(candidates.items()):
        pattern = items.tokens[item]
        if len(reachable) < coverage * len(pattern):
            continue
        near = _surroundings(places, len(pattern), len(known))
        part = tuple(value for a, b in near for value in (*known[a:b], -1))
        covered = sum(size for _, _, size in tiles(pattern, part, min(length, len(pattern))))
        found.append((item, covered / len(pattern)))
    return found


def _surroundings(seeds: list[int], reach: int, count: int) -> list[tuple[int, int]]:
    """Stretches of text around seeds; a tile holds a seed, so it lies within."""
    found: list[tuple[int, int]] = []
    for at in sorted(seeds):
        a, b = max(0, at - reach), min(count, at + 2 * reach)
        if found and a <= found[-1][1]:
            found[-1] = (found[-1][0], max(b, found[-1][1]))
        else:
            found.append((a, b))
    return found


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    length: int = SEED,
    coverage: float = COVERAGE,
    block_tokens: int = BLOCK_TOKENS,
    keep: list[Column] | None = None,
) -> DataFrame:
    """`keep` columns (default: all of docs) with contaminated and benchmark_ids (of the items found, sorted).

    A row is contaminated if tiles of `length` words or more cover `coverage` of an item,
    in any order.  Items shorter than that must be there whole; items without words and
    null items are left out.  Null and empty texts are clean; a text of any length is read
    whole; repeated rows repeat their result and an empty table gives an empty one.
    Columns of docs named like an output are replaced.  The benchmark is a stated query set: blocks of
    bounded size of it are sent to all tasks, one block after another.
    """
    own = ("contaminated", "benchmark_ids")
    queries = benchmark.select(F.col(item_id).alias("id"), F.col(item_text).alias("body")).where("body is not null")
    size = queries.agg(F.sum(F.size(F.split("body", r"\W+")))).first()[0] or 0
    blocks = -(-size // block_tokens)
    kind = queries.schema["id"].dataType.simpleString()
    found = kept_columns(docs, text, keep, own).withColumn("benchmark_ids", F.array().cast(f"array<{kind}>"))
    for block in range(blocks):
        mine = queries.where(F.pmod(F.xxhash64("id", "body"), F.lit(blocks)) == block).collect()
        items = items_of(sorted(((r["id"], r["body"]) for r in mine), key=str), length)
        found = _mark(found, items, length, coverage)
    return found.withColumns(
        {"benchmark_ids": F.array_sort("benchmark_ids"), "contaminated": F.size("benchmark_ids") > 0}
    ).select(*(f"`{c}`" for c in found.columns if c not in (*own, "__text")), *own)


def _mark(found: DataFrame, items: Items, length: int, coverage: float) -> DataFrame:
    shared = found.sparkSession.sparkContext.broadcast(items)
    names = found.columns

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = []
            for body, before in zip(batch.column("__text").to_pylist(), batch.column("benchmark_ids").to_pylist()):
                hits = overlaps(body, shared.value, length, coverage) if body else []
                ids.append(sorted({*before, *(shared.value.ids[k] for k, share in hits if share >= coverage)}, key=str))
            place = names.index("benchmark_ids")
            columns = batch.columns
            columns[place] = pa.array(ids, columns[place].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return found.mapInArrow(mark, ddl(found, "").removesuffix(", "))
