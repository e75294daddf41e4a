"""Operator 3: byte-level BPE over a global table of distinct words."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame

from corpusguard.llm.common import ddl
from corpusguard.llm.word_blocks import Numbering, block_table, documents_of, spread_words, unpack

# Fixed value: Unicode white space, spelled out because engines differ on \s.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Words longer than this are merged with a heap.
LONG_WORD = 64
# Encoded words that a task remembers before it starts afresh.
REMEMBERED = 500_000
# Runs of a block whose slots a task remembers before it starts afresh; most rare ones don't come again.
REMEMBERED_RUNS = 50_000
# Columns that the digests of ids add.
DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


@dataclass(frozen=True)
class Vocabulary:
    """Ranks of byte strings and the pattern that cuts texts into words."""

    ranks: dict[bytes, int]
    pattern: str

    def tokens(self) -> list[bytes]:
        table = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            table[rank] = token
        return table


def load_vocabulary(path: str, pattern: str) -> Vocabulary:
    """A rank file (base64 token, blank, rank per line) of the driver; its size is fixed by the file."""
    with open(path, "rb") as lines:
        pairs = (line.split() for line in lines if line.strip())
        return Vocabulary({base64.b64decode(token): int(rank) for token, rank in pairs}, pattern)


def chunker(pattern: str) -> Callable[[], Callable[[str, Numbering], list[int]]]:
    """Slots of a text's words by the pattern, chunk by chunk.

    No match goes on from a character that is no white space into white space, so a text may
    first be cut into runs (with the blank before them) and stretches of white space; runs
    that come often are cut by the pattern once per block.
    """
    spelled = pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]")

    def start() -> Callable[[str, Numbering], list[int]]:
        chunks = regex.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
        words = regex.compile(spelled)
        known: dict[str, tuple[int, ...]] = {}
        owner: list[Numbering] = []

        def slots(text: str, numbering: Numbering) -> list[int]:
            if not owner or owner[0] is not numbering:
                known.clear()
                owner[:] = [numbering]
            found: list[int] = []
            for chunk in chunks.findall(text):
                own = known.get(chunk)
                if own is None:
                    if len(known) >= REMEMBERED_RUNS:
                        known.clear()
                    own = known[chunk] = tuple(numbering[word.encode()] for word in words.findall(chunk))
                found += own
            return found

        return slots

    return start


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one word: the pair of lowest rank is joined first, the leftmost of equals."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    if len(word) > LONG_WORD:
        return _merge_long(word, ranks)
    parts = [word[k : k + 1] for k in range(len(word))]
    pairs = [ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
    while pairs and (best := min(pairs)) != 1 << 60:
        at = pairs.index(best)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del pairs[at]
        if at:
            pairs[at - 1] = ranks.get(parts[at - 1] + parts[at], 1 << 60)
        if at < len(pairs):
            pairs[at] = ranks.get(parts[at] + parts[at + 1], 1 << 60)
    return [ranks[part] for part in parts]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap over a linked list, for words without end."""
    count = len(word)
    parts: list[bytes | None] = [word[k : k + 1] for k in range(count)]
    after, before = list(range(1, count + 1)), list(range(-1, count - 1))
    waiting = [(rank, k, 2) for k in range(count - 1) if (rank := ranks.get(word[k : k + 2])) is not None]
    heapq.heapify(waiting)
    while waiting:
        _, left, size = heapq.heappop(waiting)
        right = after[left] if parts[left] is not None else count
        if right >= count or len(parts[left]) + len(parts[right]) != size:
            continue
        parts[left], parts[right] = parts[left] + parts[right], None
        after[left] = after[right]
        if after[left] < count:
            before[after[left]] = left
        for a, b in ((before[left], left), (left, after[left])):
            if a >= 0 and b < count and (rank := ranks.get(parts[a] + parts[b])) is not None:
                heapq.heappush(waiting, (rank, a, len(parts[a]) + len(parts[b])))
    return [ranks[part] for part in parts if part is not None]


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """`keep` columns (default: all but the text) with ids: little-endian unsigned 32-bit token ids.

    Words are cut out with their positions, distinct ones are dealt over the cluster by hash
    and encoded once, ids are joined back by block and put in order of position.  Null
    and empty texts have no ids.  A text of any length stays in one block; repeated rows
    each get their ids; an empty table gives an empty result.  A column of docs named ids
    is replaced.
    """
    return _encode(docs, vocabulary, text, keep, digested=False)


def encode_with_digests(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """`with_digests` of `encode`, where ids are put in order: one Python worker does both, instead of two side by side."""
    return _encode(docs, vocabulary, text, keep, digested=True)


def _encode(docs: DataFrame, vocabulary: Vocabulary, text: str, keep: list[Column] | None, digested: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    added = ["ids", *(_names(DIGESTS) if digested else [])]
    keep = keep or [docs[f"`{c}`"] for c in docs.columns if c not in (*added, text)]
    # Private names, so that no kept column clashes with those used on the way.
    results = [c for c in docs.select(*keep).columns]
    names = [f"__{k}" for k in range(len(results))]
    docs = docs.select(*(c.alias(name) for c, name in zip(keep, names)), docs[f"`{text}`"].alias("__text"))
    table = block_table(docs, "__text", [docs[name] for name in names], chunker(vocabulary.pattern), bucketed=True)
    words = spread_words(table).repartition("bucket")

    def encode_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Word lists one by one; a word is encoded when it is first met in its bucket."""
        ranks = shared.value.ranks
        known: dict[bytes, bytes] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                parts = []
                for word in batch.column("words")[row].as_py():
                    code = known.get(word)
                    if code is None:
                        if len(known) > REMEMBERED:
                            known.clear()
                        code = known[word] = np.array(merge(word, ranks), dtype="<u4").tobytes()
                    parts.append(code)
                sizes = np.fromiter(map(len, parts), dtype="<u4", count=len(parts)).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("block").slice(row, 1),
                        batch.column("slots").slice(row, 1),
                        pa.array([sizes], pa.binary()),
                        pa.array([b"".join(parts)], pa.binary()),
                    ],
                    ["block", "places", "sizes", "codes"],
                )

    codes = words.mapInArrow(encode_words, "block long, places binary, sizes binary, codes binary")
    rows = documents_of(table)

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        # A block without words has no codes, and then no columns of them.
        codes = [right.column(c).to_pylist() if right.num_rows else [] for c in ("places", "sizes", "codes")]
        join = joined_codes(*codes)
        ids = [join(unpack(s)) for s in left.column("slots").to_pylist()]
        columns = [*(left.column(c) for c in names), pa.array(ids, pa.binary())]
        if digested:
            tokens = shared.value.tokens()
            columns += _arrays([_digests(own, tokens) for own in ids], DIGESTS)
        return pa.table(columns, [*names, *added])

    both = rows.groupBy("block").cogroup(codes.groupBy("block"))
    schema = ddl(rows.select(names)) + "ids binary" + (f", {DIGESTS}" if digested else "")
    return both.applyInArrow(assemble, schema).toDF(*results, *added)


def joined_codes(places: list[bytes], sizes: list[bytes], codes: list[bytes]) -> Callable[[np.ndarray], bytes]:
    """The ids of a sequence of slots, given the lists of a block: where words belong, how long their codes are, the codes.

    All codes are one array, and slots are looked up in arrays: a block has words by the hundred thousand.
    """
    at = np.concatenate([np.zeros(0, dtype="<u4"), *map(unpack, places)])
    lengths = np.frombuffer(b"".join(sizes), dtype="<u4").astype(np.int64) // 4
    every = np.frombuffer(b"".join(codes), dtype="<u4")
    own, starts = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64)
    own[at] = lengths
    starts[at] = np.cumsum(lengths) - lengths

    def join(slots: np.ndarray) -> bytes:
        counts = own[slots]
        shift = np.cumsum(counts) - counts
        return every[np.repeat(starts[slots] - shift, counts) + np.arange(counts.sum())].tobytes()

    return join


def decode(ids: bytes, tokens: list[bytes]) -> bytes:
    """Bytes of packed ids, by the table of token bytes."""
    return b"".join(map(tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def with_decoded(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Adds decoded (bytes) by looking up each id in the token table, which is as large as the vocabulary file."""
    return _with(encoded, vocabulary, "decoded binary", lambda ids, tokens: (decode(ids, tokens),))


def with_digests(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Adds n_tokens, ids_sha256 and decoded_sha256, without moving decoded texts through the JVM."""

    return _with(encoded, vocabulary, DIGESTS, _digests)


def _digests(ids: bytes, tokens: list[bytes]) -> tuple:
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decode(ids, tokens)).hexdigest()


def _names(added: str) -> list[str]:
    return [part.split()[0] for part in added.split(", ")]


def _arrays(rows: list[tuple], added: str) -> list[pa.Array]:
    """Columns of rows, as `added` declares them."""
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    types = [kinds[part.split()[1]] for part in added.split(", ")]
    return [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * len(types), types)]


def _with(encoded: DataFrame, vocabulary: Vocabulary, added: str, function: Callable) -> DataFrame:
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)
    new = _names(added)
    names = [c for c in encoded.columns if c not in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = shared.value.tokens()
        for batch in batches:
            found = [function(value.as_py() or b"", tokens) for value in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + _arrays(found, added), [*names, *new])

    return encoded.select(names).mapInArrow(run, ddl(encoded.select(names)) + added)
