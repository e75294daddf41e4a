"""Operator 5: document probability by a subword lattice over an existing vocabulary."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusguard.llm.common import ddl, store
from corpusguard.llm.word_blocks import Numbering, block_table, documents_of, spread_words, unpack

# Passes of expectation and maximization over all distinct words of the training texts.
PASSES = 3
# Weight, in pieces, of the vocabulary's own scores beside the counts.
PRIOR = 1000.0
# Words of a row of the table of distinct words.
ROW_WORDS = 50_000
# Characters of words of one length that are worked on at once; longer words go one by one.
BATCH_CHARS, LONG_WORD = 100_000, 64
# Places of a hash table of the vocabulary, as a power of two.
TABLE_BITS = 19
# Fixed value: the sign that starts a word in the vocabulary.
WORD_START = "▁"


@dataclass(frozen=True)
class Pieces:
    """Natural log-probabilities of pieces, of the 256 bytes and of the end of a text."""

    logs: dict[str, float]
    byte_logs: tuple[float, ...]
    end: float
    longest: int


@dataclass(frozen=True)
class Existing:
    """An existing vocabulary: pieces and byte pieces with the probabilities that its scores stand for."""

    pieces: tuple[str, ...]
    shares: np.ndarray  # pieces, then 256 bytes, then the end


def load_existing(path: str) -> Existing:
    """Pieces of a model file.  Scores of a merge vocabulary are ranks, read as shares that fall with the rank."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [
        (model.id_to_piece(k), model.get_score(k))
        for k in range(model.get_piece_size())
        if not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k) or model.is_unused(k))
    ]
    best = max(score for _, score in plain)
    shares = np.array([1.0 / (best - score + 10.0) for _, score in plain] + [1e-5] * 256 + [1e-3])
    return Existing(tuple(piece for piece, _ in plain), shares / shares.sum())


def with_shares(existing: Existing, shares: np.ndarray) -> Pieces:
    logs = np.log(shares).tolist()
    count = len(existing.pieces)
    return Pieces(
        dict(zip(existing.pieces, logs)), tuple(logs[count : count + 256]), logs[-1], max(map(len, existing.pieces))
    )


def edges(word: str, pieces: Pieces) -> list[list[tuple[int, float]]]:
    """For each start, the (end, log-probability) of pieces there; a character without any is spelled in bytes."""
    logs, longest, count = pieces.logs, pieces.longest, len(word)
    found = []
    for start in range(count):
        own = []
        for end in range(start + 1, min(start + longest, count) + 1):
            value = logs.get(word[start:end])
            if value is not None:
                own.append((end, value))
        if not own or own[0][0] != start + 1:
            own.insert(0, (start + 1, sum(pieces.byte_logs[b] for b in word[start].encode())))
        found.append(own)
    return found


def forward(lattice: list[list[tuple[int, float]]]) -> list[float]:
    """Log-probability of reaching each position, over all ways there; the last one is the word's."""
    reached = [-1e300] * (len(lattice) + 1)
    reached[0] = 0.0
    for start, own in enumerate(lattice):
        here = reached[start]
        for end, value in own:
            ahead, old = here + value, reached[end]
            if old <= -1e299:
                reached[end] = ahead
            elif ahead > old:
                reached[end] = ahead + log(1.0 + exp(old - ahead))
            else:
                reached[end] = old + log(1.0 + exp(ahead - old))
    return reached


def word_log(word: bytes, pieces: Pieces) -> float:
    """Natural log of the marginal probability of one word, all segmentations together."""
    return forward(edges(WORD_START + word.decode(), pieces))[-1]


def add_expected(word: bytes, times: int, pieces: Pieces, places: dict[str, int], counts: np.ndarray) -> None:
    """Add the expected uses of each piece in `times` occurrences of a word."""
    text = WORD_START + word.decode()
    lattice = edges(text, pieces)
    ahead = forward(lattice)
    total = ahead[-1]
    back = [0.0] * (len(text) + 1)
    for start in range(len(text) - 1, -1, -1):
        own = lattice[start]
        ways = [value + back[end] for end, value in own]
        top = max(ways)
        back[start] = top + log(sum(exp(way - top) for way in ways)) if len(ways) > 1 else top
        for (end, _), way in zip(own, ways):
            share = ahead[start] + way - total
            if share > -30.0:
                place = places.get(text[start:end])
                if place is not None:
                    counts[place] += times * exp(share)
                else:
                    for b in text[start].encode():
                        counts[len(places) + b] += times * exp(share)


class Batch:
    """Lattices of many words of one length at once: the same recursions over arrays.

    Substrings are found in the vocabulary by a 64-bit rolling hash, kept in two tables of
    places; a place counts only if its whole hash agrees.
    """

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.logs = np.array([*pieces.logs.values(), -np.inf])
        self.missing = len(pieces.logs)
        self.hashes = np.zeros(self.missing + 1, dtype=np.uint64)
        for own, points in by_length(list(pieces.logs)):
            hashes = np.zeros(len(own), dtype=np.uint64)
            for row in points:
                hashes = _roll(hashes, row)
            self.hashes[own] = hashes
        self.tables = [np.full(1 << TABLE_BITS, self.missing, dtype=np.int32) for _ in range(2)]
        left = np.arange(self.missing)
        for table, spots in zip(self.tables, _spots(self.hashes)):
            free = table[spots[left]] == self.missing
            taken, first = np.unique(spots[left[free]], return_index=True)
            table[taken] = left[free][first]
            left = np.setdiff1d(left, table)
        self.rest = {int(self.hashes[place]): int(place) for place in left}
        self.places = {piece: place for place, piece in enumerate(pieces.logs)}

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        found = np.full(len(hashes), self.missing, dtype=np.int32)
        for table, spots in zip(self.tables, _spots(hashes)):
            places = table[spots]
            good = (self.hashes[places] == hashes) & (places != self.missing)
            found[good] = places[good]
        for key, place in self.rest.items():
            found[hashes == np.uint64(key)] = place
        return found

    def edges(self, points: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Places and log-probabilities of all substrings, by length less one; each has a row per start."""
        width, count = points.shape
        places, values = [], []
        rolled = np.zeros((width, count), dtype=np.uint64)
        for length in range(1, min(self.pieces.longest, width) + 1):
            starts = width - length + 1
            rolled = _roll(rolled[:starts], points[length - 1 :])
            found = self.lookup(rolled.reshape(-1)).reshape(starts, count)
            places.append(found)
            values.append(self.logs[found])
        bare = places[0] == self.missing
        if bare.any():
            chars, back = np.unique(points[bare], return_inverse=True)
            spelled = [sum(self.pieces.byte_logs[b] for b in chr(int(c)).encode()) for c in chars]
            values[0][bare] = np.array(spelled)[back]
        return places, values

    def forward(self, values: list[np.ndarray], width: int) -> np.ndarray:
        reached = np.zeros((width + 1, values[0].shape[1]))
        for end in range(1, width + 1):
            ways = [reached[end - k - 1] + values[k][end - k - 1] for k in range(min(len(values), end))]
            reached[end] = _log_sum(ways)
        return reached

    def word_logs(self, points: np.ndarray) -> np.ndarray:
        return self.forward(self.edges(points)[1], len(points))[-1]

    def add_expected(self, points: np.ndarray, times: np.ndarray, counts: np.ndarray) -> None:
        width = len(points)
        places, values = self.edges(points)
        ahead = self.forward(values, width)
        back = np.zeros_like(ahead)
        shares: list[list[np.ndarray]] = [[] for _ in values]
        for start in range(width - 1, -1, -1):
            reach = min(len(values), width - start)
            ways = [values[k][start] + back[start + k + 1] for k in range(reach)]
            back[start] = _log_sum(ways)
            for k, way in enumerate(ways):
                share = np.exp(ahead[start] + way - ahead[-1]) * times
                shares[k].append(share)
                if k == 0 and (bare := places[0][start] == self.missing).any():
                    for point, part in zip(points[start][bare].tolist(), share[bare].tolist()):
                        for b in chr(point).encode():
                            counts[self.missing + 1 + b] += part
        found = np.concatenate([place.reshape(-1) for place in places])
        weights = np.concatenate([share for own in shares for share in reversed(own)])
        counts[: self.missing + 1] += np.bincount(found, weights, self.missing + 1)


_latest: list[Batch] = []


def batch_of(pieces: Pieces) -> Batch:
    """The lattices of a vocabulary, made once per Python process."""
    if not _latest or _latest[0].pieces is not pieces:
        _latest[:] = [Batch(pieces)]
    return _latest[0]


def _roll(hashes: np.ndarray, points: np.ndarray) -> np.ndarray:
    return (hashes + points + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ (hashes >> np.uint64(29))


def _spots(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << TABLE_BITS) - 1)
    return (hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64), (hashes >> np.uint64(20) & mask).astype(np.int64)


def _log_sum(ways: list[np.ndarray]) -> np.ndarray:
    if len(ways) == 1:
        return ways[0]
    stacked = np.stack(ways)
    top = stacked.max(axis=0)
    return top + np.log(np.exp(stacked - top).sum(axis=0))


def word_texts(words: list[bytes]) -> list[str]:
    return [WORD_START + word.decode() for word in words]


def by_length(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in the list, code points by position) of texts of one length, in handy numbers."""
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order], prepend=-1))
    for start, end in zip(cuts, [*cuts[1:], len(order)]):
        length = int(lengths[order[start]])
        step = max(1, BATCH_CHARS // length)
        for at in range(start, end, step):
            own = order[at : min(end, at + step)]
            joined = "".join([texts[k] for k in own]).encode("utf-32-le")
            points = np.frombuffer(joined, dtype=np.uint32).reshape(len(own), length)
            yield own, np.ascontiguousarray(points.T).astype(np.uint64)


def word_logs(words: list[bytes], batch: Batch) -> np.ndarray:
    """Natural logs of the marginal probabilities of words."""
    logs = np.zeros(len(words))
    for places, points in by_length(word_texts(words)):
        if len(points) > LONG_WORD:
            logs[places] = [word_log(words[k], batch.pieces) for k in places]
        else:
            logs[places] = batch.word_logs(points)
    return logs


def lower_words(text: str) -> list[bytes]:
    """A-Z in lower case; words are parted by ASCII white space alone."""
    return text.encode().lower().split()


def _slots_of() -> Callable[[str, Numbering], list[int]]:
    return lambda text, numbering: [numbering[word] for word in lower_words(text)]


def count_words(words: DataFrame) -> DataFrame:
    """bucket, words, counts: the distinct words of the training texts, each in one row only."""

    def count(group: pa.Table) -> pa.Table:
        totals = _totals(group)
        known = [(word, n) for word, n in totals.items() if n]
        parts = [known[k : k + ROW_WORDS] for k in range(0, len(known), ROW_WORDS)]
        return pa.table(
            {
                "words": pa.array([[w for w, _ in part] for part in parts], pa.list_(pa.binary())),
                "counts": pa.array([[n for _, n in part] for part in parts], pa.list_(pa.int64())),
            }
        )

    return words.groupBy("bucket").applyInArrow(count, "words array<binary>, counts array<bigint>")


def _totals(group: pa.Table) -> dict[bytes, int]:
    totals: dict[bytes, int] = {}
    for words, uses in zip(group.column("words").to_pylist(), group.column("uses").to_pylist()):
        for word, n in zip(words, uses):
            totals[word] = totals.get(word, 0) + n
    return totals


def expect(counted: DataFrame, existing: Existing, shares: np.ndarray) -> np.ndarray:
    """Expected uses of all pieces over the counted words; a fixed number of sums reaches the driver."""
    shared = counted.sparkSession.sparkContext.broadcast((with_shares(existing, shares), existing.pieces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, names = shared.value
        lattices = batch_of(pieces)
        # Beside the sums of pieces and bytes, Batch counts what has no place of its own.
        sums, apart = np.zeros(len(names) + 257), np.zeros(len(names) + 257)
        for batch in batches:
            for words, times in zip(batch.column("words").to_pylist(), batch.column("counts").to_pylist()):
                weights = np.array(times, dtype=np.float64)
                for own, points in by_length(word_texts(words)):
                    if len(points) > LONG_WORD:
                        for k in own:
                            add_expected(words[k], times[k], pieces, lattices.places, sums)
                    else:
                        lattices.add_expected(points, weights[own], apart)
        counts = np.concatenate((apart[: len(names)], apart[len(names) + 1 :], [0.0])) + sums
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["piece", "n"])

    sums = np.zeros(len(shares))
    summed = counted.mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n"))
    for row in summed.collect():
        sums[row["piece"]] = row["n"]
    return sums


def score_documents(
    docs: DataFrame, existing: Existing, training: str, text: str = "text", keep: list[Column] | None = None,
    passes: int = PASSES,
) -> DataFrame:
    """`keep` columns (default: all but the text) with n_tokens, n_known, train_tokens, base_score, score.

    Rows whose boolean `training` column is true are learned from, all are scored.  score
    is log10 of the probability of the text as a chain of words, each the sum over all
    its segmentations, and an end; base_score is the add-one word model beside it.  Null and empty texts hold the
    end alone.  A text of any length is one sum; repeated rows count and are scored
    repeatedly; without training rows the vocabulary's own scores hold; an empty table
    gives an empty result.  Columns of docs named like an output are replaced.
    """
    own = ("n_tokens", "n_known", "train_tokens", "base_score", "score", "block", "row", "slots", "first", "words", "uses", text)
    keep = keep or [docs[f"`{c}`"] for c in docs.columns if c not in own]
    table = block_table(docs, text, keep, _slots_of, counted=training)
    words = spread_words(table)
    counted = store(count_words(words), "words")
    found = counted.agg(
        F.sum(F.size("words")), F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b))
    ).first()
    ends = documents_of(table).where(F.col(training)).count()
    known_words, tokens = (found[0] or 0) + (ends > 0), (found[1] or 0) + ends
    shares = existing.shares
    for _ in range(passes if tokens else 0):
        sums = expect(counted, existing, shares)
        sums[-1] = ends
        shares = (sums + PRIOR * existing.shares) / (sums.sum() + PRIOR)
    shared = docs.sparkSession.sparkContext.broadcast(with_shares(existing, shares))

    def answer(group: pa.Table) -> pa.Table:
        totals = _totals(group)
        distinct = list(totals)
        logs = dict(zip(distinct, word_logs(distinct, batch_of(shared.value)).tolist()))
        columns = group.column("words").to_pylist()
        return pa.table(
            {
                "block": group.column("block"),
                "places": group.column("slots"),
                "counts": pa.array([np.array([totals[w] for w in own], dtype="<i8").tobytes() for own in columns], pa.binary()),
                "logs": pa.array([np.array([logs[w] for w in own], dtype="<f8").tobytes() for own in columns], pa.binary()),
            }
        )

    answers = words.groupBy("bucket").applyInArrow(
        answer, "block long, places binary, counts binary, logs binary"
    )
    rows = documents_of(table)
    names = [c for c in rows.columns if c not in ("block", "row", "slots")]
    divisor = np.log10(tokens + known_words + 1.0)

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = [
            (unpack(places), np.frombuffer(counts, dtype="<i8"), np.frombuffer(logs, dtype="<f8"))
            for places, counts, logs in zip(*(right.column(c).to_pylist() for c in ("places", "counts", "logs")))
        ]
        size = 1 + max((int(places.max()) for places, _, _ in parts), default=-1)
        counts, logs = np.zeros(size, dtype=np.int64), np.zeros(size)
        for places, own_counts, own_logs in parts:
            counts[places], logs[places] = own_counts, own_logs
        bases = np.log10(counts + 1.0) - divisor
        end_base, end_score = np.log10(ends + 1.0) - divisor, shared.value.end
        results = []
        for packed in left.column("slots").to_pylist():
            slots = unpack(packed)
            results.append(
                (
                    len(slots) + 1,
                    int((counts[slots] > 0).sum()) + (ends > 0),
                    tokens,
                    float(bases[slots].sum() + end_base),
                    float((logs[slots].sum() + end_score) / np.log(10.0)),
                )
            )
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        columns = list(zip(*results)) or [()] * 5
        return pa.table(
            [*(left.column(c) for c in names), *(pa.array(c, k) for c, k in zip(columns, kinds))],
            [*names, "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    schema = ddl(rows.select(names)) + "n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(assemble, schema)
