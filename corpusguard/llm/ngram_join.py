"""Operator 6: n-gram Jaccard join as a blocked sparse product.

Rows of the matrix are documents, columns are hashed n-grams.  Columns are dealt into
blocks.  Two linked documents differ in few columns (a bound that follows from their
sizes), so with more blocks than that they agree on a whole block.  Only rows that agree
on a block are multiplied, in blocks of bounded size: a row's overlaps with all rows of a
block are summed up over its n-grams, and pairs below the size-derived bound are discarded.
Before texts move, sketches of a few bytes do: a row that by sizes and sketches can't link with
any row it would meet stays behind.
Each row is multiplied first by the first row that shares a block with it, its centre; then
all rows of a centre that are not connected by then, so that no link between any two is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusguard.llm.common import BLOCK_CHARS, block_buckets, discard, numbered_blocks, store, store_bucketed, whole_groups
from corpusguard.llm.graph import components
from corpusguard.llm.hashing import WordHashes, mix, run_hashes
from corpusguard.llm.word_blocks import pack, unpack
from corpusguard.session import broadcast_if_measured_small

# Two documents link if PERCENT of the union is shared.
WORDS, PERCENT = 4, 85
# Keys that one bucket of the product should get, and keys a character of text gives at most.
BUCKET_KEYS, KEYS_PER_CHAR = 2_000_000, 0.08
# Rows of a block that a key names one by one.
HOLDERS = 64
# N-grams of the rows of one side of a block product.
SIDE_GRAMS = 1_000_000
# Counts of a sketch; sets smaller than a part of this on average are told apart by their texts.
SKETCH, SKETCHED_FROM = 256, 64
# Places of a block of documents.
SLOT_BITS, SEQUENCE_BITS = 20, 20


def shingle_set(text: str, hashes: WordHashes, length: int = WORDS) -> np.ndarray:
    """Sorted hashes of the distinct n-grams; a shorter text is one n-gram, one without words none."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) < length:
        return run_hashes(hashes.of(words), len(words)) + np.uint64(len(words))
    return np.unique(run_hashes(hashes.of(words), length))


def sketch_of(members: np.ndarray) -> bytes:
    """Size of a set, and how many of its members fall into each column of a fixed number (255 at most)."""
    counts = np.bincount((members >> np.uint64(40)).astype(np.int64) % SKETCH, minlength=SKETCH)
    return np.array([len(members)], dtype="<u4").tobytes() + np.minimum(counts, 255).astype(np.uint8).tobytes()


def opened(sketches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and counts."""
    table = np.frombuffer(b"".join(sketches), dtype=np.uint8).reshape(-1, 4 + SKETCH)
    return np.ascontiguousarray(table[:, :4]).view("<u4")[:, 0].astype(np.int64), table[:, 4:].astype(np.int16)


def promising(left: list[bytes], right: list[bytes], labels: list, others: list, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Flags of the rows of either side that may link with one of the other side with another label.

    Sets differ at least in as many members as their counts differ by, and sets that link
    differ in (100 - percent) / (100 + percent) of both sizes at most.  Where sets are so small
    that sketches cost more than texts, all rows are flagged.
    """
    sizes, counts = opened(left)
    own_sizes, own_counts = opened(right)
    if min(sizes.mean(), own_sizes.mean()) < SKETCHED_FROM:
        return np.ones(len(left), dtype=bool), np.ones(len(right), dtype=bool)
    label = np.array(labels)
    flags, own_flags = np.zeros(len(left), dtype=bool), np.zeros(len(right), dtype=bool)
    for place, (size, own) in enumerate(zip(own_sizes, own_counts)):
        possible = (label != others[place]) & (100 * np.minimum(sizes, size) >= percent * np.maximum(sizes, size))
        for rows in (np.flatnonzero(possible & ~flags), np.flatnonzero(possible & flags)):
            if own_flags[place] or not len(rows):
                continue
            apart = np.abs(counts[rows] - own).sum(axis=1, dtype=np.int64)
            near = rows[(100 + percent) * apart <= (100 - percent) * (sizes[rows] + size)]
            flags[near] = True
            own_flags[place] = len(near) > 0
    return flags, own_flags


@cache
def levels(percent: int, reach: int) -> tuple[tuple[int, int, int], ...]:
    """(largest size, blocks, empty blocks allowed for) of each level up to a size.

    A set links with sets of its own or the neighbouring level only.  Sets of at most s
    members that link differ in at most 2 s (100 - percent) / (100 + percent) of them.
    """
    found, size = [], 1
    while not found or found[-2 if len(found) > 1 else -1][0] < reach:
        differ = 2 * size * (100 - percent) // (100 + percent)
        spare = 0 if differ == 0 else max(1, (differ + 49) // 50)
        found.append((size, differ + 1 + spare, spare))
        size = max(size + 1, -(-size * 100 // percent))
    return tuple(found)


def block_keys(members: np.ndarray, percent: int) -> np.ndarray:
    """Keys of a set: one per block of columns and level; sets that link share one.

    Empty blocks give no key, unless there are more than the level allows for.
    """
    size = len(members)
    steps = levels(percent, 1 << max(4, int(size - 1).bit_length() + 1))
    own = next(k for k, (largest, _, _) in enumerate(steps) if size <= largest)
    mixed = mix(members)
    found = []
    for level in (own, own + 1):
        _, blocks, spare = steps[level]
        seed = np.uint64(level + 1) << np.uint64(40)
        if blocks == 1:
            found.append(mix(np.array([mixed.sum(dtype=np.uint64)]) + seed))
            continue
        place = (members >> np.uint64(20)) % np.uint64(blocks)
        order = np.argsort(place, kind="stable")
        sorted_place = place[order]
        starts = np.flatnonzero(np.diff(sorted_place, prepend=np.uint64(blocks)))
        sums = np.add.reduceat(mixed[order], starts)
        filled = sorted_place[starts]
        found.append(mix(sums + seed + (filled << np.uint64(8))))
        if blocks - len(filled) > spare:
            empty = np.setdiff1d(np.arange(blocks, dtype=np.uint64), filled)
            found.append(mix(seed + (empty << np.uint64(8)) + np.uint64(3)))
    return np.concatenate(found)


def _grouped(keys: np.ndarray, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by key, then ref; first of each key in that order (flags); place of its key's first for each."""
    order = np.lexsort((refs, keys))
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[order][1:] != keys[order][:-1]
    return order, new, np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))


def stars(keys: np.ndarray, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, centre) without repetition: each ref of a key and the first one, where they differ."""
    order, _, start = _grouped(keys, refs)
    member, centre = refs[order], refs[order][start]
    apart = member != centre
    pairs = np.unique(np.stack([member[apart], centre[apart]], axis=1), axis=0) if apart.any() else np.zeros((0, 2), np.int64)
    return pairs[:, 0], pairs[:, 1]


def sent_holders(keys: np.ndarray, refs: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the holders that go to the key's bucket, and (member, centre) of those that don't.

    Of a key that more than `most` rows of the block hold, the first one goes alone.
    """
    order, new, start = _grouped(keys, refs)
    heavy = np.bincount(start, minlength=len(keys))[start] > most
    members, centres = stars(keys[order][heavy], refs[order][heavy])
    return order[new | ~heavy], members, centres


def incidence(docs: DataFrame, buckets: int, percent: int, length: int) -> DataFrame:
    """Write the blocked matrix.

    Document rows: block, doc_id, t1, n_shingles, ref (of the distinct set within the block of
    documents), leader, and a leader's sketch and text.  Key rows: bucket, block, keys, slots (of the
    keys' holders).  Edge rows: members, centres of rows of one block that share a very common key.
    The table is bucketed by block, so that texts stay where they are until they are multiplied.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for block, held in numbered_blocks(batches, "text", BLOCK_CHARS):
            base = ((block >> 32) << (SLOT_BITS + SEQUENCE_BITS)) | ((block & 0xFFFFFFFF) << SLOT_BITS)
            slots: dict[bytes, int] = {}
            keys: list[np.ndarray] = []
            for batch in held:
                sizes, refs, leaders, sketches, texts = [], [], [], [], []
                for text in batch.column("text").to_pylist():
                    members = shingle_set(text or "", hashes, length)
                    name = xxhash.xxh3_128_digest(members.tobytes())
                    new = name not in slots
                    slot = slots.setdefault(name, len(slots))
                    if new:
                        keys.append(block_keys(members, percent) if len(members) else members)
                    sizes.append(len(members))
                    refs.append(base | slot)
                    leaders.append(new)
                    sketches.append(sketch_of(members) if new and len(members) else None)
                    texts.append(text if new and len(members) else None)
                yield _rows(
                    doc_id=batch.column("doc_id"),
                    t1=batch.column("t1"),
                    n_shingles=pa.array(sizes, pa.int64()),
                    ref=pa.array(refs, pa.int64()),
                    leader=pa.array(leaders, pa.bool_()),
                    block=pa.array([base] * batch.num_rows, pa.int64()),
                    sketch=pa.array(sketches, pa.binary()),
                    text=pa.array(texts, pa.string()),
                    kind=held[0].column("doc_id").type,
                )
            every = np.concatenate(keys) if keys else np.zeros(0, dtype=np.uint64)
            owners = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
            first, members, centres = sent_holders(every, owners, HOLDERS)
            if len(members):
                yield _rows(
                    members=pa.array([(members + base).tolist()], pa.list_(pa.int64())),
                    centres=pa.array([(centres + base).tolist()], pa.list_(pa.int64())),
                    kind=held[0].column("doc_id").type,
                )
            bucket = (every[first] % np.uint64(buckets)).astype(np.int64)
            part = first[np.argsort(bucket, kind="stable")]
            bucket = np.sort(bucket)
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
            groups = [part[a:b] for a, b in zip(cuts, [*cuts[1:], len(part)])]
            if groups:
                yield _rows(
                    bucket=pa.array(bucket[cuts], pa.int64()),
                    block=pa.array([base] * len(groups), pa.int64()),
                    keys=pa.array([(every[g] >> np.uint64(32)).astype("<u4").tobytes() for g in groups], pa.binary()),
                    slots=pa.array([pack(owners[g]) for g in groups], pa.binary()),
                    kind=held[0].column("doc_id").type,
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return store_bucketed(docs.mapInArrow(build, f"doc_id {kind}, " + _DDL), "incidence", block_buckets(docs), ["block"])


_FIELDS = {
    "t1": pa.int64(),
    "n_shingles": pa.int64(),
    "ref": pa.int64(),
    "leader": pa.bool_(),
    "bucket": pa.int64(),
    "block": pa.int64(),
    "keys": pa.binary(),
    "slots": pa.binary(),
    "members": pa.list_(pa.int64()),
    "centres": pa.list_(pa.int64()),
    "sketch": pa.binary(),
    "text": pa.string(),
}
_DEALT = "block long, group long, i int, j int, side int, ref long, label long"
_DDL = (
    "t1 long, n_shingles long, ref long, leader boolean, bucket long, block long, "
    "keys binary, slots binary, members array<bigint>, centres array<bigint>, sketch binary, text string"
)


def _rows(kind: pa.DataType, **columns: pa.Array) -> pa.RecordBatch:
    count = len(next(iter(columns.values())))
    fields = {"doc_id": kind, **_FIELDS}
    return pa.RecordBatch.from_arrays(
        [columns[name] if name in columns else pa.nulls(count, t) for name, t in fields.items()], list(fields)
    )


def _keys_of(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys, refs = [], []
    for own, slots, block in zip(*(group.column(c).to_pylist() for c in ("keys", "slots", "block"))):
        keys.append(np.frombuffer(own, dtype="<u4"))
        refs.append(unpack(slots).astype(np.int64) + block)
    return np.concatenate(keys), np.concatenate(refs)


def candidate_stars(matrix: DataFrame) -> DataFrame:
    """a, b: each row that shares a key with others, and the first row with that key.

    Of a key that a third of all documents hold, a block sends one holder; the others come in by
    their own centre's centres.
    """

    def meet(group: pa.Table) -> pa.Table:
        members, centres = stars(*_keys_of(group))
        return pa.table({"a": pa.array(members, pa.int64()), "b": pa.array(centres, pa.int64())})

    across = matrix.where(F.col("bucket").isNotNull()).select("bucket", "block", "keys", "slots").groupBy("bucket").applyInArrow(meet, "a long, b long")
    inside = matrix.where(F.col("members").isNotNull()).select(F.explode(F.arrays_zip("members", "centres")).alias("e"))
    inside = inside.select(F.col("e.members").alias("a"), F.col("e.centres").alias("b"))
    across = store(across.distinct(), "centres")
    beyond = inside.join(across.select(F.col("a").alias("b"), F.col("b").alias("far")), "b").select("a", F.col("far").alias("b"))
    return across.union(inside).union(beyond.where("a <> b")).distinct()


def dealt(uses: DataFrame, matrix: DataFrame) -> DataFrame:
    """block, group, i, j, side, ref, label: uses (group, side, ref, label) in blocks of bounded size.

    Each block of a group's side 0 meets each block of its side 1 once; only a group beyond SIDE_GRAMS is cut.
    """
    sizes = matrix.where("leader").select("ref", "n_shingles")
    blocks = [F.ceil(F.sum(F.when(F.col("side") == side, F.col("n_shingles"))) / SIDE_GRAMS).cast("int") for side in (0, 1)]
    sized = uses.join(sizes, "ref").groupBy("group").agg(*(n.alias(f"n{side}") for side, n in enumerate(blocks)))
    large = sized.where("n0 > 1 or n1 > 1").withColumnRenamed("group", "large")
    large = broadcast_if_measured_small(large, "large")
    cut = uses.join(large, F.col("group") == F.col("large"), "left")
    own, others = (
        F.coalesce(F.when(F.col("side") == 0, F.col(first)).otherwise(F.col(second)), F.lit(1))
        for first, second in (("n0", "n1"), ("n1", "n0"))
    )
    cut = cut.select("group", "side", "ref", "label", F.pmod(F.xxhash64("ref"), own).cast("int").alias("own"), others.alias("others"))
    met = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    i = F.when(F.col("side") == 0, F.col("own")).otherwise(F.col("other"))
    j = F.when(F.col("side") == 0, F.col("other")).otherwise(F.col("own"))
    block = F.shiftleft(F.shiftright("ref", SLOT_BITS), SLOT_BITS)
    return met.select(block.alias("block"), "group", i.alias("i"), j.alias("j"), "side", "ref", "label")


def brought(placed: DataFrame, matrix: DataFrame, what: str) -> DataFrame:
    """Dealt uses with their `what`, text or sketch.  Uses go to it, block by block; only what is in use moves on."""
    values = matrix.where("text is not null").select("block", "ref", what)
    names = ["block", "group", "i", "j", "side", "ref", "label"]

    def bring(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({name: pa.array([], kind) for name, kind in zip([*names, what], kinds)})
        places = {ref: row for row, ref in enumerate(left.column("ref").to_pylist())}
        taken = pa.array([places[ref] for ref in right.column("ref").to_pylist()], pa.int64())
        return pa.table([*(right.column(c) for c in names), left.column(what).take(taken)], [*names, what])

    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), _FIELDS[what]]
    both = values.groupBy("block").cogroup(placed.groupBy("block"))
    return both.applyInArrow(bring, f"{_DEALT}, {what} {values.schema[what].dataType.simpleString()}")


def sides_of(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows by group and block of it, side 0 first."""
    return rows.select(*columns).repartition("group", "i", "j").sortWithinPartitions("group", "i", "j", "side")


def sieve(rows: DataFrame, percent: int) -> DataFrame:
    """The dealt uses that by their sketches may link with one of the other side."""
    names = rows.columns[:-1]

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, cuts in whole_groups(batches, ["group", "i", "j"]):
            sides, labels, sketches = (group.column(c).to_pylist() for c in ("side", "label", "sketch"))
            kept = np.zeros(group.num_rows, dtype=bool)
            for start, end in zip(cuts, cuts[1:]):
                middle = start + sides[start:end].count(0)
                if middle not in (start, end):
                    kept[start:middle], kept[middle:end] = promising(
                        sketches[start:middle], sketches[middle:end], labels[start:middle], labels[middle:end], percent
                    )
            yield from group.select(names).filter(pa.array(kept)).to_batches()

    return sides_of(rows, rows.columns).mapInArrow(sift, _DEALT)


class Incidence:
    """A block of rows by columns, stored by column: the rows that hold each n-gram."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(own) for own in sets], dtype=np.int64)
        grams = np.concatenate(sets)
        order = np.argsort(grams, kind="stable")
        self.rows = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.grams, self.starts = np.unique(grams[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(grams))

    def overlaps(self, one: np.ndarray) -> np.ndarray:
        """Columns that each row shares with one set: one row of the product, summed up over its n-grams."""
        at = np.minimum(np.searchsorted(self.grams, one), len(self.grams) - 1)
        at = at[self.grams[at] == one]
        starts, counts = self.starts[at], self.ends[at] - self.starts[at]
        shift = np.cumsum(counts) - counts
        held = self.rows[np.repeat(starts - shift, counts) + np.arange(counts.sum())]
        return np.bincount(held, minlength=len(self.sizes))


def links_of_blocks(left: list[np.ndarray], right: list[np.ndarray], labels: list, others: list, percent: int) -> list[tuple[int, int]]:
    """(left, right) places of links between sets, enough to connect all labels that links connect.

    Rows whose labels are connected by now are not multiplied any more, nor are those whose sizes rule a link out.
    """
    sizes = np.array([len(own) for own in left])
    names, known = np.unique(np.array([*labels, *others]), return_inverse=True)
    label, own_labels = known[: len(labels)].copy(), known[len(labels) :]
    owner = np.arange(len(names))
    block = Incidence(left)
    found = []
    for place, one in enumerate(right):
        mine = owner[own_labels[place]]
        possible = (label != mine) & (100 * np.minimum(sizes, len(one)) >= percent * np.maximum(sizes, len(one)))
        if not possible.any():
            continue
        shared = block.overlaps(one)
        near = np.flatnonzero(possible & (100 * shared >= percent * (sizes + len(one) - shared)))
        joined, first = np.unique(label[near], return_index=True)
        found += [(int(near[k]), place) for k in first]
        label[np.isin(label, joined)] = mine
        owner[np.isin(owner, joined)] = mine
    return found


def product(uses: DataFrame, matrix: DataFrame, percent: int, length: int) -> DataFrame:
    """a, b: links between the two sides of each (group, i, j) that connect different labels."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for group, cuts in whole_groups(batches, ["group", "i", "j"]):
            sides, refs, labels = (group.column(c).to_pylist() for c in ("side", "ref", "label"))
            texts = group.column("text")
            ones, others = [], []
            for start, end in zip(cuts, cuts[1:]):
                middle = start + sides[start:end].count(0)
                if middle in (start, end):
                    continue
                sets = [shingle_set(value.as_py(), hashes, length) for value in texts[start:end]]
                own = links_of_blocks(
                    sets[: middle - start], sets[middle - start :], labels[start:middle], labels[middle:end], percent
                )
                ones += [refs[start + a] for a, _ in own]
                others += [refs[middle + b] for _, b in own]
            yield pa.RecordBatch.from_arrays([pa.array(ones, pa.int64()), pa.array(others, pa.int64())], ["a", "b"])

    placed = sieve(brought(dealt(uses, matrix), matrix, "sketch"), percent)
    rows = brought(placed, matrix, "text")
    blocks = sides_of(rows, ["group", "i", "j", "side", "ref", "label", "text"])
    return blocks.mapInArrow(multiply, "a long, b long")


def star_uses(nearest: DataFrame) -> DataFrame:
    """Each row (a) meets its first centre (b); every row is a label of its own."""
    members = nearest.select(F.col("b").alias("group"), F.lit(0).alias("side"), F.col("a").alias("ref"))
    centres = nearest.select(F.col("b").alias("group"), F.lit(1).alias("side"), F.col("b").alias("ref")).distinct()
    return members.union(centres).withColumn("label", F.col("ref"))


def centre_uses(candidates: DataFrame, labels: DataFrame) -> DataFrame:
    """All rows of a centre, itself included, where they have several labels so far.

    Rows that share a key have its first holder as a common centre, so any two that may link
    meet here, though they don't link with the centre.  Rows of a centre (side 0) meet those outside its
    largest label (side 1): within that label nothing is left to find.
    """
    members = candidates.select(F.col("b").alias("group"), F.col("a").alias("ref"))
    members = members.union(candidates.select("b", "b").distinct())
    known = labels.select(F.col("node").alias("ref"), "label")
    named = members.join(known, "ref", "left").select("group", "ref", F.coalesce("label", "ref").alias("label"))
    sizes = store(named, "centres")
    counted = sizes.groupBy("group", "label").count()
    most = counted.groupBy("group").agg(F.max(F.struct("count", "label")).alias("most"), F.count("*").alias("labels"))
    apart = most.where("labels > 1").select("group", F.col("most.label").alias("main"))
    rows = sizes.join(apart, "group")
    others = rows.where("label <> main").select("group", F.lit(1), "ref", "label")
    return rows.select("group", F.lit(0).alias("side"), "ref", "label").union(others)


def join_near(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, length: int = WORDS
) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, stays: one row per row of docs.

    component_id is the least id that links lead to, the row's own included; of its rows
    the one with that id stays (of several, the one with the least text_hash).  Null, empty
    and wordless texts have no n-grams and link with nothing, each row being its own component.
    Rows with equal sets are one; a text of any length is one set.  A null id is greater
    than all others.  Other columns of docs play no part; an empty table gives an empty
    result.  Hashes of 64 bits stand for n-grams.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = rows.withColumn("t1", F.xxhash64("text"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(2 * docs.sparkSession.sparkContext.defaultParallelism, int(chars * KEYS_PER_CHAR / BUCKET_KEYS) + 1)
    matrix = incidence(rows, buckets, percent, length)
    found = matrix.where(F.col("ref").isNotNull()).select("doc_id", "t1", "n_shingles", "ref", "leader")
    candidates = store(candidate_stars(matrix), "candidates")
    # First each row by its least centre, then all rows of a centre whose labels are still apart.
    nearest = candidates.groupBy("a").agg(F.min("b").alias("b"))
    linked = store(product(star_uses(nearest), matrix, percent, length), "links")
    labels = components(linked)
    uses = store(centre_uses(candidates, labels), "uses")
    rest = store(product(uses, matrix, percent, length), "links")
    discard(candidates)
    labels = components(linked.union(rest))

    labelled = found.join(labels.withColumnRenamed("node", "ref"), "ref", "left").withColumn(
        "class", F.coalesce("label", "ref")
    )
    named = labelled.where("n_shingles > 0")
    rank = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "t1")
    least = named.groupBy("class").agg(F.min(rank).alias("least"))
    same = F.col("least.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("least.t1") == F.col("t1"))
    joined = named.join(least, "class").select(
        "doc_id", F.col("t1").alias("text_hash"), "n_shingles", F.col("least.doc_id").alias("component_id"), same.alias("stays")
    )
    alone = labelled.where("n_shingles = 0").select(
        "doc_id", F.col("t1").alias("text_hash"), "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("stays")
    )
    return joined.union(alone)
