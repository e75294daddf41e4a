"""Operator 13: near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

A rotation learned on a bounded sample turns directions into balanced binary codes.  The
code is cut into substrings; each is the key of one table, so codes that differ in fewer
bits than there are tables meet in one of them.  What meets and is close in Hamming
distance forms candidate classes, and all vectors of a class are compared by cosine.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusguard.llm.common import store, whole_groups
from corpusguard.llm.graph import components
from corpusguard.llm.hashing import mix
from corpusguard.session import broadcast_if_measured_small

LEAST_COSINE = 0.98
# Rows the rotation is learned from, and rounds of learning.
SAMPLE, LEARNING = 10_000, 30
# Share of pairs at the least cosine that may meet in no table.
MISSED = 0.002
# Rows that an entry of a table should have besides copies, and bits of a code that Hamming distances use.
ENTRY_ROWS, CHECKED = 64, 128
# Components of a block of rows, and of a side of a comparison.
BLOCK_COMPONENTS, SIDE_COMPONENTS = 1 << 22, 1 << 18
SHARES = 1_000_000


@dataclass(frozen=True)
class Index:
    """Centre and rotations (dimensions by bits), thresholds, tables, bits of a substring, and Hamming distances."""

    centre: np.ndarray
    rotation: np.ndarray
    thresholds: np.ndarray
    tables: int
    bits: int
    near: int
    cosine: float

    def codes(self, units: np.ndarray) -> np.ndarray:
        """Bits (rows by code) of unit vectors of any length: longer ones by their first components."""
        size = len(self.centre)
        fitted = np.zeros((len(units), size))
        fitted[:, : units.shape[1]] = units[:, :size]
        return (fitted - self.centre) @ self.rotation > self.thresholds


def _rotation(spread: np.ndarray, rng: np.random.Generator, rounds: int) -> np.ndarray:
    """Iterative quantisation: turn the axes until the signs of the turned rows lie closest to them."""
    turn = np.linalg.qr(rng.standard_normal((spread.shape[1], spread.shape[1])))[0]
    for _ in range(rounds):
        left, _, right = np.linalg.svd(np.where(spread @ turn >= 0, 1.0, -1.0).T @ spread)
        turn = (left @ right).T
    return turn


def learn_index(sample: np.ndarray, rows: int, cosine: float, seed: int = 13) -> Index:
    """Fit on unit vectors (sample by dimensions); `rows` decides how long substrings are.

    Substrings grow with the logarithm of the rows, and tables with them, so that entries
    stay small and all but MISSED of the pairs at the least cosine share a substring.
    """
    rng = np.random.default_rng(seed)
    size = max(1, sample.shape[1])
    sample = sample if len(sample) else np.zeros((1, size))
    same = 1 - math.acos(min(1.0, max(-1.0, cosine))) / math.pi
    bits = min(48, max(8, math.ceil(math.log2(max(2, rows) / ENTRY_ROWS)) if rows > ENTRY_ROWS else 8))
    tables = max(2, math.ceil(math.log(MISSED) / math.log(max(1e-12, 1 - same**bits))))
    centre = sample.mean(axis=0)
    centred = sample - centre
    axes = np.linalg.eigh(centred.T @ centred)[1][:, ::-1][:, : min(64, size)]
    spread = centred @ axes
    turns = [axes @ _rotation(spread, rng, LEARNING) for _ in range(-(-max(tables * bits, CHECKED) // axes.shape[1]))]
    rotation = np.concatenate(turns, axis=1)
    differ = CHECKED * (1 - same)
    near = math.ceil(differ + 5 * math.sqrt(differ * same))
    return Index(centre, rotation, np.median(centred @ rotation, axis=0), tables, bits, near, cosine)


def units_of(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(rows of a length, directions) for each length; rows that are null, zero or not finite are in none."""
    lengths = np.array([len(v) if v.is_valid else 0 for v in vectors])
    rows, found = [], []
    for length in np.unique(lengths[lengths > 0]).tolist():
        own = np.flatnonzero(lengths == length)
        values = vectors.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, length)
        largest = np.abs(values).max(axis=1)
        usable = np.isfinite(largest) & (largest > 0)
        values = values[usable] / largest[usable, None]
        rows.append(own[usable])
        found.append(values / np.linalg.norm(values, axis=1)[:, None])
    return rows, found


def hamming(codes: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes ^ one).sum(axis=1)


def leaders(codes: np.ndarray, radius: int) -> tuple[list[int], list[tuple[int, int]]]:
    """Rows that stand for those within `radius` of them, and (row, leader) of the others."""
    left = np.arange(len(codes))
    found, members = [], []
    while len(left):
        first = int(left[0])
        found.append(first)
        close = hamming(codes[left], codes[first]) <= radius
        close[0] = True
        members += [(row, first) for row in left[close][1:].tolist()]
        left = left[~close]
    return found, members


def spanning(codes: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the rows within `distance` of one another."""
    left = np.arange(len(codes))
    edges: list[tuple[int, int]] = []
    while len(left):
        waiting, left = [int(left[0])], left[1:]
        while waiting and len(left):
            one = waiting.pop()
            close = hamming(codes[left], codes[one]) <= distance
            reached = left[close].tolist()
            edges += [(one, row) for row in reached]
            waiting += reached
            left = left[~close]
    return edges


_FIELDS = {
    "id": None,
    "node": pa.binary(),
    "key": pa.int64(),
    "code": pa.binary(),
    "a": pa.binary(),
    "b": pa.binary(),
}
_DDL = "node binary, key long, code binary, a binary, b binary"


def _rows(kind: pa.DataType, **columns: pa.Array) -> pa.RecordBatch:
    count = len(next(iter(columns.values())))
    fields = _FIELDS | {"id": kind}
    return pa.RecordBatch.from_arrays(
        [columns[c] if c in columns else pa.nulls(count, t) for c, t in fields.items()], list(fields)
    )


def _names(labels: list, rows: np.ndarray, units: np.ndarray, batch: pa.RecordBatch) -> list[bytes]:
    """128-bit names of equal vectors of equal label."""
    values = batch.column("vector").take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    values = (values + 0.0).reshape(len(rows), -1)
    return [xxhash.xxh3_128_digest(f"{labels[row]}\x00".encode() + own.tobytes()) for row, own in zip(rows.tolist(), values)]


def index_rows(vectors: DataFrame, index: Index) -> DataFrame:
    """Write names and table entries.

    Name rows: id, node (null if the vector links with nothing).  Entry rows: key, node,
    code, for the leaders of what shares a key within a block of rows.  Edge rows: a, b of members
    and leaders.  A key that a third of all rows share leaves a block a few times only.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(index)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        kind = None
        held: dict[bytes, tuple[str, int, np.ndarray]] = {}
        size = 0
        for batch in batches:
            kind = batch.column("id").type
            labels = batch.column("label").to_pylist()
            nodes: list[bytes | None] = [None] * batch.num_rows
            for rows, units in zip(*units_of(batch.column("vector"))):
                given = np.array([labels[row] is not None for row in rows.tolist()], dtype=bool)
                rows, units = rows[given], units[given]
                if not len(rows):
                    continue
                bits = index.codes(units)
                for row, name, own in zip(rows.tolist(), _names(labels, rows, units, batch), bits):
                    nodes[row] = name
                    if name not in held:
                        held[name] = (labels[row], units.shape[1], np.packbits(own))
                        size += units.shape[1]
            yield _rows(kind, id=batch.column("id"), node=pa.array(nodes, pa.binary()))
            if size >= BLOCK_COMPONENTS:
                yield from _entries(kind, held, index)
                held, size = {}, 0
        if held:
            yield from _entries(kind, held, index)

    kind = vectors.schema["id"].dataType.simpleString()
    return store(vectors.mapInArrow(build, f"id {kind}, " + _DDL), "hamming-index")


def _entries(kind: pa.DataType, held: dict, index: Index) -> Iterator[pa.RecordBatch]:
    names = list(held)
    packed = np.stack([code for _, _, code in held.values()])
    bits = np.unpackbits(packed, axis=1)[:, : index.tables * index.bits].reshape(len(names), index.tables, index.bits)
    places = bits @ (np.uint64(1) << np.arange(index.bits, dtype=np.uint64))
    group = np.array([xxhash.xxh3_64_intdigest(f"{length}\x00{label}") for label, length, _ in held.values()], dtype=np.uint64)
    tables = np.arange(1, index.tables + 1, dtype=np.uint64) << np.uint64(56)
    keys = mix(mix(places + tables[None, :]) + group[:, None]).view(np.int64).reshape(-1)
    checked = np.ascontiguousarray(packed[:, : CHECKED // 8]).view(np.uint64)
    owners = np.repeat(np.arange(len(names)), index.tables)
    order = np.argsort(keys, kind="stable")
    cuts = np.flatnonzero(np.diff(keys[order], prepend=keys[order[:1]] - 1))
    alone = np.diff(np.append(cuts, len(order))) == 1
    sent = [order[cuts[alone]]]
    pairs: list[tuple[int, int]] = []
    for start, end in zip(cuts[~alone].tolist(), np.append(cuts, len(order))[1:][~alone].tolist()):
        places = order[start:end]
        own = owners[places]
        first, members = leaders(checked[own], index.near // 3)
        sent.append(places[first])
        pairs += [(int(own[a]), int(own[b])) for a, b in members]
    sent = np.concatenate(sent)
    codes = checked[owners[sent]]
    yield _rows(
        kind,
        key=pa.array(keys[sent], pa.int64()),
        node=pa.array([names[k] for k in owners[sent].tolist()], pa.binary()),
        code=pa.array([row.tobytes() for row in codes], pa.binary()),
    )
    if pairs:
        once = sorted(set(pairs))
        yield _rows(
            kind,
            a=pa.array([names[a] for a, _ in once], pa.binary()),
            b=pa.array([names[b] for _, b in once], pa.binary()),
        )


def candidate_edges(entries: DataFrame, index: Index) -> DataFrame:
    """a, b: a spanning forest of the leaders of each key that may have members close to one another."""
    reach = index.near + 2 * (index.near // 3)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, cuts in whole_groups(batches, ["key"]):
            nodes = rows.column("node").combine_chunks()
            codes = np.frombuffer(b"".join(rows.column("code").to_pylist()), dtype=np.uint64).reshape(rows.num_rows, -1)
            ones, others = [], []
            for start, end in zip(cuts, cuts[1:]):
                if end - start > 1:
                    for a, b in spanning(codes[start:end], reach):
                        ones.append(start + a)
                        others.append(start + b)
            yield pa.RecordBatch.from_arrays(
                [nodes.take(pa.array(side, pa.int64())) for side in (ones, others)], ["a", "b"]
            )

    dealt = entries.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(meet, "a binary, b binary").distinct()


def compare(sides: DataFrame, cosine: float) -> DataFrame:
    """node, n, a, b: links of a node within one comparison, weighted by copies, and a spanning forest of the links.

    Rows are (label, low, high, chunk, node, kind, copies, vector): within (label, low, high) the rows of
    chunk `low` meet those of chunk `high`.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, cuts in whole_groups(batches, ["label", "low", "high"]):
            kinds, chunks, copies = (rows.column(c).to_numpy() for c in ("kind", "chunk", "copies"))
            vectors = rows.column("vector").combine_chunks()
            nodes = rows.column("node").combine_chunks()
            counted, numbers, ones, others = [], [], [], []
            for start, end in zip(cuts, cuts[1:]):
                at = np.arange(start, end)
                for kind in set(kinds[start:end]):
                    own = at[kinds[start:end] == kind]
                    low, high = rows.column("low")[start].as_py(), rows.column("high")[start].as_py()
                    left, right = own[chunks[own] == low], own[chunks[own] == high]
                    if not len(left) or not len(right):
                        continue
                    one, two = (units_of(vectors.take(pa.array(side)))[1][0] for side in (left, right))
                    linked = one @ two.T >= cosine
                    if low == high:
                        np.fill_diagonal(linked, False)
                    for side, times in ((left, linked @ copies[right]), (right, copies[left] @ linked))[: 1 if low == high else 2]:
                        counted += side[times > 0].tolist()
                        numbers += times[times > 0].tolist()
                    for a, b in _forest(linked):
                        ones.append(int(left[a]))
                        others.append(int(right[b]))
            for taken, other, n in ((counted, None, numbers), (ones, others, None)):
                if taken:
                    node = nodes.take(pa.array(taken, pa.int64()))
                    none = pa.nulls(len(taken), pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [
                            node if other is None else none,
                            pa.nulls(len(taken), pa.int64()) if n is None else pa.array(n, pa.int64()),
                            none if other is None else node,
                            none if other is None else nodes.take(pa.array(other, pa.int64())),
                        ],
                        ["node", "n", "a", "b"],
                    )

    dealt = sides.repartition("label", "low", "high").sortWithinPartitions("label", "low", "high")
    return store(dealt.mapInArrow(meet, "node binary, n long, a binary, b binary"), "links")


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """(row, column) links that connect whatever the matrix connects."""
    rows, columns = linked.any(axis=1), linked.any(axis=0)
    edges = []
    while (starts := np.flatnonzero(rows)).size:
        waiting = [int(starts[0])]
        rows[waiting[0]] = False
        while waiting:
            row = waiting.pop()
            for column in np.flatnonzero(linked[row] & columns).tolist():
                columns[column] = False
                edges.append((row, column))
                more = np.flatnonzero(linked[:, column] & rows).tolist()
                rows[more] = False
                edges += [(other, column) for other in more]
                waiting += more
    return edges


def fit(vectors: DataFrame, cosine: float) -> Index:
    """Learn on at most 2 * SAMPLE usable vectors, picked by hash of their content."""
    rows = vectors.count()
    share = max(1, SHARES * SAMPLE // max(1, rows))
    picked = vectors.where(F.pmod(F.xxhash64("vector"), F.lit(SHARES)) < share).select("vector").limit(2 * SAMPLE)
    column = picked.toArrow().column("vector").combine_chunks()
    found = units_of(column)[1]
    size = max((units.shape[1] for units in found), default=1)
    sample = np.zeros((sum(map(len, found)), size))
    start = 0
    for units in found:
        sample[start : start + len(units), : units.shape[1]] = units
        start += len(units)
    return learn_index(sample, rows, cosine)


def join_vectors(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    cosine: float = LEAST_COSINE,
) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of `vectors`.

    Rows link if their labels are equal and their cosine, in double precision, is at least
    `cosine` (above 0); n_links counts other rows, component_id is the least id that links
    reach, the row's own included, and kept tells rows whose id that is.  Rows whose label
    is null, or whose vector is null, empty, zero or holds null or non-finite components,
    link with nothing, as do vectors of different lengths.  Repeated rows link with one another and are
    all kept if they have the least id; a null id is greater than all others.  An empty table
    gives an empty result; other columns play no part.  Every row is indexed; the index is fitted on a sample.
    """
    rows = vectors.select(
        F.col(f"`{vec_id}`").alias("id"),
        F.col(f"`{label}`").cast("string").alias("label"),
        F.when(F.forall(f"`{vector}`", lambda x: x.isNotNull()), F.col(f"`{vector}`")).alias("vector"),
    )
    index = fit(rows, cosine)
    indexed = index_rows(rows, index)
    named = indexed.where(F.col("key").isNull() & F.col("a").isNull()).select("id", "node")
    edges = indexed.where(F.col("a").isNotNull()).select("a", "b")
    found = candidate_edges(indexed.where(F.col("key").isNotNull()).select("key", "node", "code"), index)
    classes = components(store(edges.union(found), "candidates"))

    # Equal vectors are compared once.
    held = named.where(F.col("node").isNotNull()).groupBy("node").agg(F.count("*").alias("copies"), F.min("id").alias("least"))
    held = store(held, "nodes")
    links = compare(_sides(rows, classes, held), cosine)
    counts = links.where(F.col("n").isNotNull()).groupBy("node").agg(F.sum("n").alias("n"))
    linked = components(links.where(F.col("a").isNotNull()).select("a", "b"))

    least = linked.join(held, "node").groupBy("label").agg(F.min("least").alias("reached"))
    reached = linked.join(least, "label").select("node", "reached")
    known = held.join(counts, "node", "left").join(reached, "node", "left")
    known = known.select(
        F.col("node").alias("own"),
        (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("reached", "least").alias("component_id"),
    )
    answered = named.where(F.col("node").isNotNull()).join(known, F.col("node") == F.col("own"))
    alone = named.where(F.col("node").isNull()).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    every = answered.select("id", "n_links", "component_id").union(alone)
    return every.select(
        F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def _sides(rows: DataFrame, classes: DataFrame, held: DataFrame) -> DataFrame:
    """The vectors of candidate classes, dealt into comparisons of bounded size.

    A class of more vectors than a side may have is cut into chunks, and each pair of chunks is one comparison.
    """

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column("label").to_pylist()
            for own, units in zip(*units_of(batch.column("vector"))):
                own = own[[labels[row] is not None for row in own.tolist()]]
                taken = pa.array(own, pa.int64())
                kinds = [f"{units.shape[1]} {labels[row]}" for row in own.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(_names(labels, own, units, batch) if len(own) else [], pa.binary()),
                        pa.array(kinds, pa.string()),
                        batch.column("vector").take(taken),
                    ],
                    ["name", "kind", "vector"],
                )

    kind = rows.schema["vector"].dataType.simpleString()
    vectors = rows.mapInArrow(name, f"name binary, kind string, vector {kind}")
    wanted = classes.join(held.select("node", "copies"), "node")
    once = vectors.join(wanted, F.col("name") == F.col("node")).drop("name").dropDuplicates(["node"])
    sizes = classes.groupBy("label").count()
    width = rows.agg(F.max(F.size("vector"))).first()[0] or 1
    side = max(256, SIDE_COMPONENTS // max(1, width))
    # At most one class in so many nodes is large.
    large = sizes.where(F.col("count") > side).select(
        F.col("label").alias("class"), F.ceil(F.col("count") / side).cast("int").alias("chunks")
    )
    large = broadcast_if_measured_small(large, "large")
    cut = once.join(large, F.col("label") == F.col("class"), "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    cut = cut.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    met = cut.select("label", "chunk", "node", "kind", "copies", "vector", other.alias("other"))
    return met.select("label", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "chunk", "node", "kind", "copies", "vector")
