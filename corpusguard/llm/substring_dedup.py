"""Operator 10: substring deduplication by super-k-mer partitioning."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusguard.llm.common import store
from corpusguard.llm.hashing import WordHashes, run_hashes

# Words of a window, and of the n-grams whose least hash is a window's minimiser.
WINDOW, GRAM = 50, 8
# A minimiser with more windows is hot: they travel one by one, by their own digest.
HOT = 50_000
# Stands for a null id: greater than all others.
LAST = (1 << 63) - 1


def minimisers(words: np.ndarray, window: int, gram: int) -> np.ndarray:
    """The least n-gram hash of each window, by the window's start; none if there are too few words."""
    if len(words) < window:
        return np.zeros(0, dtype=np.uint64)
    least, have = run_hashes(words, gram), 1
    span = window - gram + 1
    while 2 * have <= span:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    return np.minimum(least[: len(least) - (span - have)], least[span - have :]) if span > have else least


def super_k_mers(least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end (exclusive) window of each stretch of windows that share a minimiser."""
    if not len(least):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    cuts = np.flatnonzero(least[1:] != least[:-1]) + 1
    return np.concatenate(([0], cuts)), np.concatenate((cuts, [len(least)]))


def spans_of(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Word ranges covered by windows at sorted starts."""
    found: list[tuple[int, int]] = []
    for start in starts.tolist():
        if found and start <= found[-1][1]:
            found[-1] = (found[-1][0], start + window)
        else:
            found.append((start, start + window))
    return found


def shared_minimisers(rows: DataFrame, window: int, gram: int, hot: int) -> DataFrame:
    """doc_id, t1, shared: array of (key, hot) of minimisers that rows of another id hold as well.

    A window whose minimiser no other document holds has no copy elsewhere and need not travel.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            empty = np.zeros(0, dtype=np.int64)
            keys, windows = [empty], [empty]
            for text in batch.column("text").to_pylist():
                least = minimisers(hashes.of((text or "").encode().split()), window, gram).view(np.int64)
                found = np.unique(least, return_counts=True)
                keys.append(found[0])
                windows.append(found[1])
            places = pa.array(np.repeat(np.arange(batch.num_rows), [len(k) for k in keys[1:]]))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c).take(places) for c in ("doc_id", "t1")),
                    pa.array(np.concatenate(keys), pa.int64()),
                    pa.array(np.concatenate(windows), pa.int64()),
                ],
                ["doc_id", "t1", "key", "windows"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    found = store(rows.mapInArrow(find, f"doc_id {kind}, t1 long, key long, windows long"), "minimisers")
    order = F.coalesce("doc_id", F.lit(LAST))
    used = found.groupBy("key").agg(F.min(order).alias("least"), F.max(order).alias("most"), F.sum("windows").alias("n"))
    several = used.where("least <> most").select("key", (F.col("n") > hot).alias("hot"))
    return found.drop("windows").join(several, "key").groupBy("doc_id", "t1").agg(F.collect_set(F.struct("key", "hot")).alias("shared"))


def remove_repeats(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    window: int = WINDOW,
    gram: int = GRAM,
    hot: int = HOT,
    digest: bool = False,
) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by blanks), one row per row of docs.

    A word goes if a window over it also starts in a row with a smaller id.  Null and
    empty texts, and texts of fewer words than a window, lose nothing.  Rows of equal id
    don't clean one another; a null id is greater than all others.  A text of any length
    is read whole.  Other columns of docs play no part; an empty table gives an empty
    result.  With `digest`, kept_sha256 takes the place of kept.
    """
    gram = min(gram, window)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("t1", F.xxhash64("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    shared = shared_minimisers(rows, window, gram, hot)
    same = rows["doc_id"].eqNullSafe(shared["doc_id"]) & rows["t1"].eqNullSafe(shared["t1"])
    marked = rows.join(shared, same, "left").select(rows["*"], shared["shared"])

    def result(words: list[bytes]) -> str:
        kept = b" ".join(words)
        return hashlib.sha256(kept).hexdigest() if digest else kept.decode()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents that share no minimiser are done; only the others keep their text."""
        for batch in batches:
            counts, kept = [], []
            clean = batch.column("shared").is_null()
            for body, done in zip(batch.column("text").to_pylist(), clean.to_pylist()):
                words = (body or "").encode().split()
                counts.append(len(words))
                kept.append(result(words) if done else None)
            texts = pa.compute.if_else(clean, pa.scalar(None, pa.string()), batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("t1"), texts, batch.column("shared"), pa.array(counts, pa.int64()), pa.array(kept, pa.string())],
                ["doc_id", "t1", "text", "shared", "n_words", "kept"],
            )

    pairs = "shared array<struct<key:bigint,hot:boolean>>"
    marked = store(marked.mapInArrow(settle, f"doc_id {kind}, t1 long, text string, {pairs}, n_words long, kept string"), "marked")
    suspects = marked.where(F.col("shared").isNotNull())

    def packer(hot_ones: bool):
        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = WordHashes()
            for batch in batches:
                places, keys, starts, runs = [], [], [], []
                for row, (body, own) in enumerate(zip(batch.column("text").to_pylist(), batch.column("shared").to_pylist())):
                    wanted = {pair["key"] for pair in own if pair["hot"] == hot_ones}
                    words = body.encode().split() if wanted else []
                    least = minimisers(hashes.of(words), window, gram).view(np.int64)
                    for first, end in zip(*(part.tolist() for part in super_k_mers(least))):
                        key = int(least[first])
                        if key not in wanted:
                            continue
                        for a, b in ((k, k + 1) for k in range(first, end)) if hot_ones else ((first, end),):
                            run = b" ".join(words[a : b + window - 1])
                            places.append(row)
                            keys.append(key)
                            starts.append(a)
                            runs.append(xxhash.xxh3_128_digest(run) if hot_ones else run)
                    if len(runs) > 20_000 or row == batch.num_rows - 1:
                        taken = pa.array(places, pa.int64())
                        yield pa.RecordBatch.from_arrays(
                            [
                                *(batch.column(c).take(taken) for c in ("doc_id", "t1")),
                                pa.array(keys, pa.int64()),
                                pa.array(starts, pa.int64()),
                                pa.array(runs, pa.binary()),
                            ],
                            ["doc_id", "t1", "key", "start", "run"],
                        )
                        places, keys, starts, runs = [], [], [], []

        wanted_rows = suspects.where(F.exists("shared", lambda pair: pair["hot"] == hot_ones)).select("doc_id", "t1", "text", "shared")
        sent = wanted_rows.mapInArrow(pack, f"doc_id {kind}, t1 long, key long, start long, run binary")
        return sent.withColumn("order", F.coalesce("doc_id", F.lit(LAST)))

    # Cold buckets: the strings of a minimiser meet in one task, windows are sorted and equal ones counted.
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("key").to_numpy()
            # The bucket at the batch's end may go on in the next one.
            last = int(np.searchsorted(keys, keys[-1]))
            if last:
                yield from _repeats([*held, batch.slice(0, last)], window)
                held = [batch.slice(last)]
            elif held and held[-1].column("key")[0].as_py() != keys[0]:
                yield from _repeats(held, window)
                held = [batch]
            else:
                held.append(batch)
        if held:
            yield from _repeats(held, window)

    owned = packer(False).repartition("key").sortWithinPartitions("key")
    cold = owned.mapInArrow(count, f"doc_id {kind}, t1 long, first long, end long")

    # Hot minimisers: a window is its digest; the least id is found with partial sums, and the join can be split.
    single = packer(True).withColumnRenamed("run", "digest")
    least = single.groupBy("digest").agg(F.min("order").alias("least"))
    again = single.join(least, "digest").where(F.col("order") > F.col("least"))
    spans = cold.union(again.select("doc_id", "t1", F.col("start").alias("first"), (F.col("start") + window).alias("end")))

    gone = spans.groupBy("doc_id", "t1").agg(F.collect_set(F.struct("first", "end")).alias("gone"))
    match = suspects["doc_id"].eqNullSafe(gone["doc_id"]) & suspects["t1"].eqNullSafe(gone["t1"])
    joined = suspects.join(gone, match, "left").select(suspects["doc_id"], suspects["text"], gone["gone"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, kept = [], [], []
            for body, ranges in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist()):
                words = body.encode().split()
                keep = np.ones(len(words), dtype=bool)
                for span in ranges or ():
                    keep[span["first"] : span["end"]] = False
                counts.append(len(words))
                removed.append(int((~keep).sum()))
                kept.append(result([word for word, stays in zip(words, keep.tolist()) if stays]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept"],
            )

    cleaned = joined.mapInArrow(finish, f"doc_id {kind}, n_words long, n_removed long, kept string")
    clean = marked.where(F.col("shared").isNull()).select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept")
    return cleaned.union(clean).withColumnRenamed("kept", "kept_sha256" if digest else "kept")


def _repeats(held: list[pa.RecordBatch], window: int) -> list[pa.RecordBatch]:
    """Word ranges (doc_id, t1, first, end) of windows that a smaller id holds too, of whole buckets."""
    table = pa.Table.from_batches(held)
    windows: list[tuple[bytes, int, int, int]] = []
    for row, (order, start, packed) in enumerate(zip(*(table.column(c).to_pylist() for c in ("order", "start", "run")))):
        cuts = np.flatnonzero(np.frombuffer(packed, dtype=np.uint8) == 32)
        begins = [0, *(cuts + 1).tolist()]
        ends = [*cuts.tolist(), len(packed)]
        for k in range(len(begins) - window + 1):
            windows.append((packed[begins[k] : ends[k + window - 1]], order, row, start + k))
    windows.sort()
    repeats: dict[int, list[int]] = {}
    content, least = None, 0
    for own, order, row, start in windows:
        if own != content:
            content, least = own, order
        elif order > least:
            repeats.setdefault(row, []).append(start)
    rows, firsts, ends = [], [], []
    for row, starts in repeats.items():
        for first, end in spans_of(np.sort(np.array(starts)), window):
            rows.append(row)
            firsts.append(first)
            ends.append(end)
    taken = pa.array(rows, pa.int64())
    names = ("doc_id", "t1")
    columns = [table.column(c).take(taken).combine_chunks() for c in names]
    return pa.table([*columns, pa.array(firsts, pa.int64()), pa.array(ends, pa.int64())], [*names, "first", "end"]).to_batches()
