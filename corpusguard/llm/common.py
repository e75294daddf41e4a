"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusguard.session import broadcast_if_measured_small, estimated_bytes, new_folder

# Rows of a batch handed to Python; texts are long, so the default of 10,000 is too many.
BATCH_ROWS = 2000
# Bytes of such a batch; a row of the tables of words is a list of thousands.
BATCH_BYTES = 8 * 1024 * 1024

# Characters that one block of documents holds at most (a longer text is a block of its own).
BLOCK_CHARS = 32 * 1024 * 1024
# Documents of a block at most, however short.
BLOCK_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole input table; batches for Python are kept small."""
    keep_batches_small(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_batches_small(spark: SparkSession) -> None:
    """A batch is held twice, by the executor and by the Python worker, beside what the worker makes of it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def store(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder, closely packed, and read back; lineage ends there."""
    target = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(target)
    stored = df.sparkSession.read.schema(df.schema).parquet(target)
    stored._folder = target
    return stored


def store_bucketed(df: DataFrame, name: str, buckets: int, by: list[str]) -> DataFrame:
    """Write a table of the catalog, under the shared folder, whose rows are dealt by hash of `by`; later groups need no shuffle.

    Each task writes a file for each bucket it holds rows of, so rows that share a key
    should be in few tasks.
    """
    spark = df.sparkSession
    folder = new_folder(spark, name)
    table = folder.rsplit("/", 1)[1].replace("-", "_")
    writer = df.write.format("parquet").option("compression", "zstd").option("path", folder)
    writer.bucketBy(buckets, *by).sortBy(*by).saveAsTable(table)
    stored = spark.table(table)
    stored._folder, stored._table = folder, table
    return stored


def remove_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def discard(*stored: DataFrame) -> None:
    """Remove tables that `store` wrote, once all that was read from them is itself stored."""
    for df in stored:
        if getattr(df, "_table", None):
            df.sparkSession.sql(f"DROP TABLE {df._table}")
        remove_folder(df.sparkSession, df._folder)


def whole_groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[pa.Table, list[int]]]:
    """Tables of complete groups of rows sorted by `by`, with the first row of each group and the end.

    Only the group that a batch leaves open is held, so the memory is that of the largest group.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([*held, batch])
        cuts = _group_starts(rows, by)
        if len(cuts) == 1:
            held.append(batch)
            continue
        yield rows.slice(0, cuts[-1]), cuts
        held = rows.slice(cuts[-1]).combine_chunks().to_batches()
    if held:
        rows = pa.Table.from_batches(held)
        yield rows, [*_group_starts(rows, by), rows.num_rows]


def _group_starts(rows: pa.Table, by: list[str]) -> list[int]:
    changed = np.zeros(max(0, rows.num_rows - 1), dtype=bool)
    for name in by:
        column = rows.column(name).combine_chunks()
        changed |= pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False).astype(bool)
    return [0, *(np.flatnonzero(changed) + 1).tolist()]


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo the divisor; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor


def block_buckets(docs: DataFrame) -> int:
    """Buckets for a table of blocks: about one block each, and work for all cores."""
    size = estimated_bytes(docs)
    known = size if size < 1 << 50 else 0  # the optimizer's size of the unknown is enormous
    return max(docs.sparkSession.sparkContext.defaultParallelism, known // BLOCK_CHARS)


def numbered_blocks(
    batches: Iterator[pa.RecordBatch], text: str, limit: int
) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Cut a task's rows into blocks of about `limit` characters.

    The number is unique over all tasks and the same when a lost task runs again:
    task partition in the high bits, sequence in the low ones.
    """
    first = TaskContext.get().partitionId() << 32
    held: list[pa.RecordBatch] = []
    size = rows = sequence = 0
    for batch in batches:
        start = 0
        for row, value in enumerate(batch.column(text)):
            size += len(value.as_buffer() or b"") if value.is_valid else 0
            rows += 1
            if size >= limit or rows >= BLOCK_ROWS:
                held.append(batch.slice(start, row + 1 - start))
                yield first + sequence, held
                held, size, rows, sequence, start = [], 0, 0, sequence + 1, row + 1
        if start < batch.num_rows:
            held.append(batch.slice(start))
    if held:
        yield first + sequence, held


def kept_columns(df: DataFrame, text: str, keep: list[Column] | None, replaced: tuple[str, ...]) -> DataFrame:
    """The columns a result carries on, and the text as __text."""
    own = keep or [F.col(f"`{c}`") for c in df.columns if c not in replaced and c != "__text"]
    return df.select(*own, F.col(f"`{text}`").alias("__text"))


def ddl(df: DataFrame, without: str = "__text") -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema if f.name != without)



def keep_named(docs: DataFrame, named: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text, ...) that `named` (doc_id, text_hash) lists; of rows that repeat one another, one.

    Names are small beside texts and are broadcast if their measured size allows;
    otherwise both sides are shuffled.
    """
    hashed = docs.withColumn("__hash", F.xxhash64("text"))
    names = named.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__name")).distinct()
    names = broadcast_if_measured_small(names, "names")
    twice = hashed.groupBy("doc_id", "__hash").count().where("count > 1").select(
        F.col("doc_id").alias("__id"), F.col("__hash").alias("__name")
    )
    twice = broadcast_if_measured_small(twice, "names")
    same = hashed["doc_id"].eqNullSafe(F.col("__id")) & (hashed["__hash"] == F.col("__name"))
    kept = hashed.join(names, same, "left_semi")
    once = kept.join(twice, same, "left_anti")
    again = kept.join(twice, same, "left_semi").dropDuplicates(["doc_id", "__hash"])
    return once.union(again).select(docs.columns)
