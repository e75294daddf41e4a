"""Operator 8: exact deduplication by an extendible-hash index on shared files."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusguard.llm.common import BLOCK_CHARS, numbered_blocks, store
from corpusguard.session import broadcast_if_measured_small

# Entries a bucket of the index may hold before it is split.
CAPACITY = 50_000
# The directory has at most 2 ** this entries, whatever the input's size.
DEPTH_LIMIT = 16

# Fixed value: the white space that does not count.
_WHITE = b" \t\n\x0b\x0c\r"


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_hash, n_chars, n_bytes, sha256, key, block, row, slot, body per row.

    Equal texts of a block get the same slot: their bytes are compared where they are, so
    a text with very many copies sends one entry per block to the index.  body is the text
    without white space, on the first row of each slot.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, held in numbered_blocks(batches, "text", BLOCK_CHARS):
            slots: dict[bytes, tuple[int, bytes]] = {}
            first = 0
            for batch in held:
                rows = []
                for value in batch.column("text").to_pylist():
                    value = value or ""
                    raw = value.encode().translate(None, _WHITE)
                    new = raw not in slots
                    if new:
                        slots[raw] = len(slots), hashlib.sha256(raw).digest()
                    slot, sha = slots[raw]
                    key = int.from_bytes(sha[:8], "big", signed=True)
                    rows.append((len(value), len(raw), sha, key, slot, raw if new else None))
                chars, sizes, shas, keys, places, bodies = zip(*rows) if rows else [()] * 6
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        batch.column("text_hash"),
                        pa.array(chars, pa.int64()),
                        pa.array(sizes, pa.int64()),
                        pa.array(shas, pa.binary()),
                        pa.array(keys, pa.int64()),
                        pa.array([block] * len(rows), pa.int64()),
                        pa.array(range(first, first + len(rows)), pa.int64()),
                        pa.array(places, pa.int64()),
                        pa.array(bodies, pa.binary()),
                    ],
                    ["doc_id", "text_hash", "n_chars", "n_bytes", "sha256", "key", "block", "row", "slot", "body"],
                )
                first += len(rows)

    schema = (
        "doc_id {}, text_hash long, n_chars long, n_bytes long, sha256 binary, key long, block long, row long, slot long, "
        "body binary"
    )
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    return rows.mapInArrow(digest, schema.format(rows.schema["doc_id"].dataType.simpleString()))


def grow_directory(counts: np.ndarray, capacity: int) -> np.ndarray:
    """Bucket of each directory entry, from entry counts by leading key bits.

    Starts with one bucket; a bucket over capacity is split by its next bit, and the
    directory doubles whenever a split needs a bit it does not have yet.
    """
    limit = len(counts).bit_length() - 1
    sums = np.concatenate(([0], np.cumsum(counts)))
    depth, directory, local, buckets = 0, np.zeros(1, dtype=np.int64), [0], 1
    waiting = [(0, 0)]  # bucket, its leading bits
    while waiting:
        bucket, bits = waiting.pop()
        width = 1 << (limit - local[bucket])
        held = sums[(bits + 1) * width] - sums[bits * width]
        if held <= capacity or local[bucket] == limit:
            continue
        if local[bucket] == depth:
            directory, depth = np.repeat(directory, 2), depth + 1
        local[bucket] += 1
        local.append(local[bucket])
        span = 1 << (depth - local[bucket])
        upper = (2 * bits + 1) * span
        directory[upper : upper + span] = buckets
        waiting += [(bucket, 2 * bits), (buckets, 2 * bits + 1)]
        buckets += 1
    return np.repeat(directory, 1 << (limit - depth))


def leading_bits(key: Column, bits: int = DEPTH_LIMIT) -> Column:
    """The first bits of a 64-bit key, 0 up to 2 ** bits - 1."""
    return F.shiftrightunsigned(key, 64 - bits)


def build_index(entries: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The index: entries with their bucket, written to shared files in order of bucket and key.

    Only a fixed number of counts (one per leading-bits value) and the directory made of
    them pass through the driver.
    """
    bits = leading_bits(F.col("key"))
    counts = np.zeros(1 << DEPTH_LIMIT, dtype=np.int64)
    for row in entries.groupBy(bits.alias("bits")).count().collect():
        counts[row["bits"]] = row["count"]
    directory = entries.sparkSession.sparkContext.broadcast(grow_directory(counts, capacity))

    @F.pandas_udf("long")
    def bucket_of(leading: pd.Series) -> pd.Series:
        return pd.Series(directory.value[leading.to_numpy()])

    placed = entries.withColumn("bucket", bucket_of(bits))
    return store(placed.repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key"), "hash-index")


def shared_chains(index: DataFrame) -> DataFrame:
    """bucket, key, block, slot: the entries whose chain has several, the only ones with bytes to compare."""
    chains = index.groupBy("bucket", "key").count().where("count > 1").select("bucket", "key")
    return index.select("bucket", "key", "block", "slot").join(chains, ["bucket", "key"])


def walk(entries: DataFrame, bodies: DataFrame) -> DataFrame:
    """bucket, key, block, slot, text: number of the entry's text within its chain.

    Each owner task takes a range of buckets and walks the chains of their keys: an
    entry's bytes are compared with those of each text met in the chain so far.  A task
    holds the different texts of one chain, whatever the number of their copies.
    """
    names = ["bucket", "key", "block", "slot"]
    owned = bodies.join(broadcast_if_measured_small(entries, "chains"), ["block", "slot"]).select(*names, "body")
    owned = owned.repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key", "block", "slot")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, met = None, []
        for batch in batches:
            texts = []
            for bucket, key, body in zip(*(batch.column(c) for c in ("bucket", "key", "body"))):
                own = bucket.as_py(), key.as_py()
                if own != chain:
                    chain, met = own, []
                text = body.as_py()
                place = next((k for k, other in enumerate(met) if other == text), len(met))
                if place == len(met):
                    met.append(text)
                texts.append(place)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(texts, pa.int64())], [*names, "text"]
            )

    return owned.mapInArrow(number, "bucket long, key long, block long, slot long, text long")


def resolve(index: DataFrame, bodies: DataFrame) -> DataFrame:
    """block, slot, keep, group_size: entries of a chain are one group if their bytes are equal.

    Entries with one key form a chain.  A chain has at most one entry per block and text,
    so copies by the million stay short.  An entry alone in its chain equals no other.
    """
    walked = walk(store(shared_chains(index), "chains"), bodies)
    numbered = index.join(walked.select("block", "slot", "text"), ["block", "slot"], "left")
    same = Window.partitionBy("bucket", "key", "text")
    return numbered.select(
        "block", "slot", F.min("best").over(same).alias("keep"), F.sum("copies").over(same).alias("group_size")
    )


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """doc_id, text_hash, keep_id, group_size, kept, text_sha256 and n_chars, one row per row of docs.

    Texts are equal if their bytes without white space are; null counts as empty, and all
    empty texts are one group.  The longest original stays, then the smallest id (null ids
    last); of rows that repeat one another in full, the first read stays.  A text of any
    length is compared whole.  Other columns of docs play no part; an empty table gives an
    empty result.
    """
    rows = store(digests(docs, doc_id, text), "digests")
    rank = F.struct(
        (-F.col("n_chars")).alias("chars"), F.col("doc_id").isNull().alias("nameless"), "doc_id", "block", "row"
    )
    entries = rows.groupBy("block", "slot", "key").agg(F.min(rank).alias("best"), F.count("*").alias("copies"))
    bodies = rows.where("body is not null").select("block", "slot", "body")
    answers = resolve(build_index(entries, capacity), bodies)
    here = rows.join(answers, ["block", "slot"])
    return here.select(
        "doc_id",
        "text_hash",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        ((F.col("keep.block") == F.col("block")) & (F.col("keep.row") == F.col("row"))).alias("kept"),
        F.lower(F.hex("sha256")).alias("text_sha256"),
        "n_chars",
    )
