"""Work on distinct words instead of words: documents are cut into blocks, and each block
names its distinct words once.

A block's documents become sequences of slots (places in the block's word list).  Only
word lists are spread by word over the cluster, answered once per distinct word, and sent
back to their blocks, where answers are put in place of slots.  A word that a third of all
texts hold travels once per block, so no word is hot.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusguard.llm.common import (
    BLOCK_CHARS,
    block_buckets,
    ddl,
    keep_batches_small,
    kept_columns,
    numbered_blocks,
    store,
    store_bucketed,
)

# Words of a row of the block table.
ROW_WORDS = 50_000
# Entries (distinct words of a block) that one bucket of words should get.
BUCKET_ENTRIES = 1_000_000

def pack(numbers: list[int]) -> bytes:
    """Numbers as compressed planes of bytes; most high bytes are nil."""
    planes = np.array(numbers, dtype="<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


class Numbering(dict):
    """Slots in order of first use."""

    def __missing__(self, word: bytes) -> int:
        slot = self[word] = len(self)
        return slot


def block_table(
    docs: DataFrame, text: str, keep: list, slots_of: Callable[[], Callable], counted: str | None = None, bucketed: bool = False
) -> DataFrame:
    """Write and reread the block table; `bucketed` by block, so that documents stay where they are later on.

    Document rows have the `keep` columns, block, row and slots; word rows have block,
    first, words and uses (occurrences in rows whose `counted` column is true; 0 without
    one).  `slots_of()` is called once per task and gives a function of (text, numbering)
    that returns a document's slots.
    """
    keep_batches_small(docs.sparkSession)
    kept = kept_columns(docs, text, keep, ())
    names = [c for c in kept.columns if c != "__text"]
    plain = pa.schema(
        [
            ("block", pa.int64()),
            ("row", pa.int64()),
            ("slots", pa.binary()),
            ("first", pa.int64()),
            ("words", pa.list_(pa.binary())),
            ("uses", pa.list_(pa.int64())),
        ]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = slots_of()
        for block, held in numbered_blocks(batches, "__text", BLOCK_CHARS):
            numbering = Numbering()
            uses = np.zeros(0, dtype=np.int64)
            first = 0
            kept_types = [(c, held[0].column(c).type) for c in names]
            for batch in held:
                packed = []
                flags = batch.column(counted).to_pylist() if counted else None
                for row, value in enumerate(batch.column("__text").to_pylist()):
                    numbers = slots(value or "", numbering)
                    packed.append(pack(numbers))
                    if flags and flags[row] and numbers:
                        if len(uses) < len(numbering):
                            uses = np.concatenate([uses, np.zeros(len(numbering) + 4096 - len(uses), dtype=np.int64)])
                        places, times = np.unique(np.array(numbers), return_counts=True)
                        uses[places] += times
                count = batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c) for c in names]
                    + [
                        pa.array([block] * count, pa.int64()),
                        pa.array(range(first, first + count), pa.int64()),
                        pa.array(packed, pa.binary()),
                        *(pa.nulls(count, plain.field(k).type) for k in (3, 4, 5)),
                    ],
                    [*names, *plain.names],
                )
                first += count
            words = list(numbering)
            uses = np.concatenate([uses, np.zeros(max(0, len(words) - len(uses)), dtype=np.int64)])
            for start in range(0, len(words), ROW_WORDS):
                part = words[start : start + ROW_WORDS]
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(1, kind) for _, kind in kept_types]
                    + [
                        pa.array([block], pa.int64()),
                        pa.nulls(1, pa.int64()),
                        pa.nulls(1, pa.binary()),
                        pa.array([start], pa.int64()),
                        pa.array([part], pa.list_(pa.binary())),
                        pa.array([uses[start : start + len(part)].tolist()], pa.list_(pa.int64())),
                    ],
                    [*names, *plain.names],
                )

    schema = ddl(kept) + "block long, row long, slots binary, first long, words array<binary>, uses array<bigint>"
    cut_up = kept.mapInArrow(cut, schema)
    if not bucketed:
        return store(cut_up, "word-blocks")
    return store_bucketed(cut_up, "word-blocks", block_buckets(docs), ["block"])


def documents_of(table: DataFrame) -> DataFrame:
    return table.where(F.col("slots").isNotNull()).drop("first", "words", "uses")


def deal_words(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Word lists cut up by bucket.  A batch may hold the lists of many blocks, so they are opened one by one."""
    for batch in batches:
        for row in range(batch.num_rows):
            block, first, words, uses = (batch.column(c)[row].as_py() for c in ("block", "first", "words", "uses"))
            owners = np.fromiter((xxhash.xxh3_64_intdigest(w) % buckets for w in words), dtype=np.int64, count=len(words))
            order = np.argsort(owners, kind="stable")
            cuts = np.flatnonzero(np.diff(owners[order], prepend=-1))
            parts = [order[a:b] for a, b in zip(cuts, [*cuts[1:], len(order)])]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(owners[order][cuts], pa.int64()),
                    pa.array([block] * len(parts), pa.int64()),
                    pa.array([pack((part + first).tolist()) for part in parts], pa.binary()),
                    pa.array([[words[k] for k in part] for part in parts], pa.list_(pa.binary())),
                    pa.array([[uses[k] for k in part] for part in parts], pa.list_(pa.int64())),
                ],
                ["bucket", "block", "slots", "words", "uses"],
            )


def spread_words(table: DataFrame) -> DataFrame:
    """bucket, block, slots, words, uses: word lists dealt by hash of the word.

    The number of buckets follows from the number of entries, so a bucket's share stays
    about BUCKET_ENTRIES at any size; the share of one word is an entry per block.
    """
    rows = table.where(F.col("words").isNotNull()).select("block", "first", "words", "uses")
    entries = rows.agg(F.sum(F.size("words"))).first()[0] or 0
    cores = table.sparkSession.sparkContext.defaultParallelism
    buckets = max(2 * cores, -(-entries // BUCKET_ENTRIES))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return deal_words(batches, buckets)

    return rows.mapInArrow(deal, "bucket long, block long, slots binary, words array<binary>, uses array<bigint>")
