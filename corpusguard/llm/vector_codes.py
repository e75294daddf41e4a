"""Operator 12: vector code compression by Lloyd's rounds whose members stay where their entry lives.

Vectors are cut into parts, and each part position has its own codebook.  A table bucketed
by (position, entry, salt) holds the parts as members of their entry's owner.  In a round
the owner reads its resident members in place and receives those that changed to its entry in
the round before; only these are shuffled.  Owners sum up their members for the
next codebook, which is a few thousand numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusguard.llm.common import ddl, discard, store, store_bucketed

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
# Components of vectors that one salt covers at most, so no owner holds more of them.
SALT_COMPONENTS = 1 << 22
# Largest absolute component after scaling; squared distances then fit 64 bits.
LARGEST = 1 << 25
OWNER = ["position", "entry", "salt"]

Codebooks = list[list[list[int]]]


@dataclass(frozen=True)
class Codes:
    """`rows`: the kept columns with code and error; `codebooks`: components by part, entry and place."""

    rows: DataFrame
    codebooks: Codebooks

    def digest(self) -> str:
        numbers = (str(x) for book in self.codebooks for entry in book for x in entry)
        return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def distances(members: np.ndarray, book: list[list[int]]) -> np.ndarray:
    """Squared distance of each member to each entry (entries by members), in whole numbers."""
    found = np.empty((len(book), len(members)), dtype=np.int64)
    for k, entry in enumerate(book):
        apart = members.astype(np.int64) - np.array(entry, dtype=np.int64)
        found[k] = np.einsum("ij,ij->i", apart, apart)
    return found


def whole_numbers(vectors: np.ndarray, scale: int) -> np.ndarray:
    scaled = np.floor(vectors * float(scale))
    if scaled.size and np.abs(scaled).max() > LARGEST:
        raise ValueError(f"a vector component is beyond {LARGEST / scale:g}; its squared distances would not fit 64 bits")
    return scaled.astype(np.int32)


_MEMBERS = pa.schema(
    [
        ("position", pa.int32()),
        ("entry", pa.int32()),
        ("salt", pa.int64()),
        ("target", pa.int32()),
        ("n", pa.int64()),
        ("places", pa.binary()),
        ("members", pa.binary()),
        ("sums", pa.list_(pa.int64())),
    ]
)
_MEMBERS_DDL = "position int, entry int, salt long, target int, n long, places binary, members binary, sums array<bigint>"


def _dealt(position: int, entry: int | None, salt: int, places: np.ndarray, members: np.ndarray, nearest: np.ndarray) -> list[dict]:
    """One packed row per entry that some of the members are nearest to; without an owner so far they start at it."""
    rows = []
    for target in np.unique(nearest).tolist():
        own = np.flatnonzero(nearest == target)
        rows.append(
            {
                "position": position,
                "entry": target if entry is None else entry,
                "salt": salt,
                "target": target,
                "n": len(own),
                "places": places[own].astype("<u4").tobytes(),
                "members": members[own].astype("<i4").tobytes(),
                "sums": members[own].sum(axis=0, dtype=np.int64).tolist(),
            }
        )
    return rows


def kept_vectors(vectors: DataFrame, vector: str, parts: int) -> tuple[DataFrame, int]:
    """Rows whose vector is complete, finite and as long as that of the first id, and that length."""
    finite = F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    complete = vectors.where(finite & (F.size(vector) > 0) & (F.size(vector) % parts == 0))
    first = complete.agg(F.min_by(F.size(vector), F.struct(F.col("__id").isNull(), "__id", vector))).first()[0]
    return complete.where(F.size(vector) == (first or 0)), first or 0


def compress(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    keep: list[Column] | None = None,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> Codes:
    """`keep` columns (default: all but the vector) with code (two hex digits per part) and error.

    Components become floor(scale * x).  A codebook starts as the parts of the vectors of
    the `entries` smallest ids (ties: smallest vector, null ids last; fewer rows give fewer
    entries); each round assigns every part to the nearest entry, the lower of equals, and
    replaces entries by the floored means of their parts; unused ones stay.  Dropped are
    vectors that are null, empty, hold null or non-finite components, or have another
    length than that of the smallest id among lengths that `parts` divides.  Each repeated
    row gets its own code; an empty table gives an empty result and empty codebooks.  A
    component too large for whole 64-bit distances raises.  Columns of the input named
    code or error are replaced.
    """
    spark = vectors.sparkSession
    own = keep or [F.col(f"`{c}`") for c in vectors.columns if c not in (vector, "code", "error")]
    named = vectors.select(*own, F.col(f"`{vec_id}`").alias("__id"), F.col(f"`{vector}`").cast("array<double>").alias("__vector"))
    results = [*named.columns[:-2], "code", "error"]
    # Own names for the kept columns, so that none clashes with those used on the way.
    names = [f"__{k}" for k in range(len(own))]
    kept, size = kept_vectors(named.toDF(*names, "__id", "__vector"), "__vector", parts)
    first = kept.orderBy(F.col("__id").asc_nulls_last(), "__vector").limit(entries).select("__vector").collect() if size else []
    width = size // parts
    seeds = whole_numbers(np.array([row[0] for row in first], dtype=np.float64).reshape(len(first), size), scale)
    books: Codebooks = [[row[p * width : (p + 1) * width] for row in seeds.tolist()] for p in range(parts)]
    if not first:
        return Codes(kept.select(*names, F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).toDF(*results), books)

    rows, table = _place(kept.drop("__id"), names, books, width, scale)
    # The first migration: every part goes to the owner of its entry.
    components = (table.agg(F.sum("n")).first()[0] or 0) * width
    buckets = max(spark.sparkContext.defaultParallelism, -(-components // SALT_COMPONENTS))
    table = store_bucketed(table.repartition(buckets, *OWNER), "members", buckets, OWNER)
    for _ in range(rounds - 1):
        books = _updated(table, books, width)
        older, table = table, store_bucketed(_assigned(table, books, width), "members", buckets, OWNER)
        discard(older)
    books = _updated(table, books, width)
    return Codes(_encoded(rows, names, table, books, width, parts).toDF(*results), books)


def _place(kept: DataFrame, names: list[str], books: Codebooks, width: int, scale: int) -> tuple[DataFrame, DataFrame]:
    """Number the rows, cut their vectors and find each part's first entry.

    Rows of a task are counted off into salts; place is the row's number within its salt.
    """
    limit = max(1, SALT_COMPONENTS // (width * len(books)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = TaskContext.get().partitionId() << 32
        waiting: list[np.ndarray] = []
        used = 0

        def parted() -> pa.RecordBatch:
            whole = np.concatenate(waiting)
            found = []
            for position, book in enumerate(books):
                members = whole[:, position * width : (position + 1) * width]
                nearest = distances(members, book).argmin(axis=0)
                found += _dealt(position, None, salt, np.arange(len(whole)), members, nearest)
            packed = pa.RecordBatch.from_pylist(found, schema=_MEMBERS)
            return pa.RecordBatch.from_arrays(
                [*(pa.nulls(len(found), kind) for kind in types), pa.nulls(len(found), pa.int64()), *packed.columns],
                [*names, "place", *_MEMBERS.names],
            )

        types: list[pa.DataType] = []
        for batch in batches:
            types = [batch.column(c).type for c in names]
            start = 0
            while start < batch.num_rows:
                part = batch.slice(start, limit - used)
                column = part.column("__vector")
                values = column.flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                waiting.append(whole_numbers(values, scale))
                count = part.num_rows
                empty = {name: pa.nulls(count, kind) for name, kind in zip(_MEMBERS.names, _MEMBERS.types)}
                empty["salt"] = pa.array([salt] * count, pa.int64())
                places = pa.array(range(used, used + count), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in names), places, *empty.values()], [*names, "place", *empty]
                )
                start, used = start + count, used + count
                if used == limit:
                    yield parted()
                    salt, used = salt + 1, 0
                    waiting.clear()
        if waiting:
            yield parted()

    both = store(kept.mapInArrow(cut, ddl(kept.select(names)) + "place long, " + _MEMBERS_DDL), "parts")
    return (
        both.where(F.col("place").isNotNull()).select(*names, "salt", "place"),
        both.where(F.col("position").isNotNull()).select(*_MEMBERS.names),
    )


def _updated(table: DataFrame, books: Codebooks, width: int) -> Codebooks:
    """Entries replaced by the floored means of their members; at most parts x entries rows reach the driver."""
    sums = [F.sum(F.element_at("sums", k + 1)).alias(f"s{k}") for k in range(width)]
    found = table.groupBy("position", "target").agg(F.sum("n").alias("n"), *sums).collect()
    books = [list(book) for book in books]
    for row in found:
        books[row["position"]][row["target"]] = [row[f"s{k}"] // row["n"] for k in range(width)]
    return books


def _owners(table: DataFrame):
    """Resident members, read where they are, and arrivals, the only ones that move."""
    resident = table.where("entry = target")
    # Each column is named anew: one table on both sides of a cogroup inside another loses columns otherwise.
    named = [F.col("target" if c == "entry" else c).alias(c) for c in _MEMBERS.names]
    return resident.groupBy(*OWNER).cogroup(table.where("entry <> target").select(*named).groupBy(*OWNER))


def _members_of(left: pa.Table, right: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    places, members = [], []
    for side in (left, right):
        if not side.num_rows:  # a side without the group has no columns either
            continue
        places += side.column("places").to_pylist()
        members += side.column("members").to_pylist()
    return (
        np.frombuffer(b"".join(places), dtype="<u4"),
        np.frombuffer(b"".join(members), dtype="<i4").reshape(-1, width),
    )


def _assigned(table: DataFrame, books: Codebooks, width: int) -> DataFrame:
    """Members by their nearest entry; they stay at their owner until the next round's shuffle."""

    def assign(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        position, entry, salt = (part.as_py() for part in key)
        places, members = _members_of(left, right, width)
        nearest = distances(members, books[position]).argmin(axis=0)
        return pa.Table.from_pylist(_dealt(position, entry, salt, places, members, nearest), schema=_MEMBERS)

    return _owners(table).applyInArrow(assign, _MEMBERS_DDL)


def _encoded(rows: DataFrame, names: list[str], table: DataFrame, books: Codebooks, width: int, parts: int) -> DataFrame:
    """The last assignment, brought back to the rows of each salt."""

    def choose(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        position, _, salt = (part.as_py() for part in key)
        places, members = _members_of(left, right, width)
        apart = distances(members, books[position])
        nearest = apart.argmin(axis=0)
        return pa.table(
            {
                "salt": pa.array([salt], pa.int64()),
                "position": pa.array([position], pa.int32()),
                "places": pa.array([places.tobytes()], pa.binary()),
                "chosen": pa.array([nearest.astype(np.uint8).tobytes()], pa.binary()),
                "apart": pa.array([apart.min(axis=0).astype("<i8").tobytes()], pa.binary()),
            }
        )

    chosen = _owners(table).applyInArrow(choose, "salt long, position int, places binary, chosen binary, apart binary")

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        count = left.num_rows
        codes = np.zeros((count, parts), dtype=np.uint8)
        error = np.zeros(count, dtype=np.int64)
        for position, places, entries, apart in zip(
            *(right.column(c).to_pylist() for c in ("position", "places", "chosen", "apart"))
        ):
            at = np.frombuffer(places, dtype="<u4")
            codes[at, position] = np.frombuffer(entries, dtype=np.uint8)
            error[at] += np.frombuffer(apart, dtype="<i8")
        place = left.column("place").to_numpy()
        texts = [row.tobytes().hex() for row in codes[place]]
        return pa.table(
            [*(left.column(c) for c in names), pa.array(texts, pa.string()), pa.array(error[place], pa.int64())],
            [*names, "code", "error"],
        )

    both = rows.groupBy("salt").cogroup(chosen.groupBy("salt"))
    return both.applyInArrow(assemble, ddl(rows.select(names)) + "code string, error long")
