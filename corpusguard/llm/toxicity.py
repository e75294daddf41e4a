"""Operator 7: toxicity by Levenshtein automata intersected with a lexicon trie."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import exp, log

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusguard.llm.common import ddl, kept_columns, store

# Labelled documents used for fitting at most (chosen by hash of the id, so always the same).
FIT_ROWS = 20_000
# Log-likelihood ratio that a word or a word beginning must reach to enter the lexicon.
WORD_EVIDENCE, STEM_EVIDENCE = 32.0, 60.0
# Share of documents with the word that must be toxic.
PRECISION = 0.9
# A longer beginning takes the place of a shorter one that has hardly more words.
SAME_STEM = 0.85
# Fitting rows that share the least hash of their word triples and the label are copies; one of them counts.
FAMILY_WORDS = 3
# A beginning needs this length and this many different words.
STEM_LENGTHS, STEM_WORDS = range(4, 8), 8
# Edits allowed from these lengths of a lexicon word on.
ONE_EDIT, TWO_EDITS = 5, 9
# Words on either side that are searched for quotation marks.
CONTEXT = 8
# Weight of a quoted or misspelled hit for which the labels hold no evidence, as a share of the plain one's.
QUOTED_SHARE, MISSPELLED_SHARE = 0.5, 0.6
# Automaton states and words remembered by a task before it starts afresh.
REMEMBERED = 500_000

WORD = re.compile(r"\w+")
_OPENING, _CLOSING = "\"'“„«‘‚»", "\"'”“»’‘«"


def allowed_edits(length: int) -> int:
    return 2 if length >= TWO_EDITS else 1 if length >= ONE_EDIT else 0


@dataclass
class Node:
    children: dict[str, int] = field(default_factory=dict)
    term: int = -1
    stem: bool = False
    edits: int = 0


class Automaton:
    """The product of the lexicon's trie and Levenshtein automata, made deterministic as words ask for it.

    A state is a set of (trie node, edits so far) and the best stem already passed.  Each
    state's moves are kept, so a word costs one look-up per character.
    """

    def __init__(self, terms: tuple[tuple[str, bool], ...]):
        self.nodes = [Node()]
        for number, (term, stem) in enumerate(terms):
            at, edits = 0, 0 if stem else allowed_edits(len(term))
            self.nodes[0].edits = max(self.nodes[0].edits, edits)
            for char in term:
                step = self.nodes[at].children.get(char)
                if step is None:
                    step = self.nodes[at].children[char] = len(self.nodes)
                    self.nodes.append(Node())
                at = step
                self.nodes[at].edits = max(self.nodes[at].edits, edits)
            self.nodes[at].term, self.nodes[at].stem = number, stem
        self.allowed = [0 if stem else allowed_edits(len(term)) for term, stem in terms]
        self._forget()

    def _forget(self) -> None:
        self.states: list[tuple[tuple[tuple[int, int], ...], int]] = []
        self.numbers: dict[tuple, int] = {}
        self.moves: list[dict[str, int]] = []
        self.ends: list[tuple[int, int] | None] = []
        self.words: dict[str, tuple[int, int] | None] = {}
        self.start = self._number({0: 0}, -1)

    def _number(self, edits: dict[int, int], stem: int) -> int:
        """Close under skipped lexicon characters, and name the state."""
        open_nodes = list(edits)
        while open_nodes:
            node = open_nodes.pop()
            used = edits[node] + 1
            for child in self.nodes[node].children.values():
                if used <= self.nodes[child].edits and used < edits.get(child, 99):
                    edits[child] = used
                    open_nodes.append(child)
        for node, used in edits.items():
            if self.nodes[node].stem and used == 0 and stem < 0:
                stem = self.nodes[node].term
        key = (tuple(sorted(edits.items())), stem)
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
            hits = [
                (used, self.nodes[node].term)
                for node, used in edits.items()
                if self.nodes[node].term >= 0 and used <= self.allowed[self.nodes[node].term]
            ]
            if stem >= 0:
                hits.append((0, stem))
            best = min(hits, default=None)
            self.ends.append((best[1], best[0]) if best else None)
        return number

    def _move(self, state: int, char: str) -> int:
        edits: dict[int, int] = {}
        pairs, stem = self.states[state]
        for node, used in pairs:
            here = self.nodes[node]
            if used + 1 <= here.edits:
                edits[node] = min(edits.get(node, 99), used + 1)
            for label, child in here.children.items():
                cost = used + (label != char)
                if cost <= self.nodes[child].edits:
                    edits[child] = min(edits.get(child, 99), cost)
        number = self._number(edits, stem)
        self.moves[state][char] = number
        return number

    def match(self, word: str) -> tuple[int, int] | None:
        """(term, edits) of the nearest lexicon term, or None; ties go to the smaller number."""
        if word in self.words:
            return self.words[word]
        if len(self.words) + len(self.states) > REMEMBERED:
            self._forget()
        state = self.start
        for char in word:
            step = self.moves[state].get(char)
            state = self._move(state, char) if step is None else step
        hit = self.words[word] = self.ends[state]
        return hit


def quoted(text: str, start: int, end: int) -> bool:
    """Whether a quotation opens and closes within the context window around a hit."""
    before = " ".join(text[max(0, start - 40 * CONTEXT) : start].split()[-CONTEXT:])
    after = " ".join(text[end : end + 40 * CONTEXT].split()[:CONTEXT])
    opened = any(re.search(rf"(?:^|[\s(]){re.escape(mark)}\S?[^{re.escape(mark)}]*$", before + " x") for mark in set(_OPENING))
    closed = any(mark in after for mark in _CLOSING)
    return opened and closed


def hits_of(automaton: Automaton, text: str) -> set[tuple[int, int, bool]]:
    """Distinct (term, edits, quoted) of a text; a term met outside a quotation is not quoted."""
    low = text.lower()
    bad = {word: hit for word in set(WORD.findall(low)) if (hit := automaton.match(word))}
    if not bad:
        return set()
    found: dict[tuple[int, int], bool] = {}
    for m in re.finditer(r"\b(?:" + "|".join(map(re.escape, sorted(bad, key=len, reverse=True))) + r")\b", low):
        hit = bad.get(m[0])
        if hit and found.get(hit, True):
            found[hit] = quoted(low, m.start(), m.end())
    return {(term, edits, inside) for (term, edits), inside in found.items()}


@dataclass(frozen=True)
class Model:
    """Lexicon of (term, is a beginning), weight of each kind of hit, log-odds without hits and with any."""

    terms: tuple[tuple[str, bool], ...]
    weights: dict[tuple[int, int, bool], float]
    base: float
    clean: float

    def weight(self, hit: tuple[int, int, bool]) -> float:
        if hit in self.weights:
            return self.weights[hit]
        term, edits, inside = hit
        plain = self.weights.get((term, 0, False), 0.0)
        share = (MISSPELLED_SHARE if edits else 1.0) * (QUOTED_SHARE if inside else 1.0)
        return plain * share

    def score(self, hits: set[tuple[int, int, bool]]) -> float:
        """Between 0 and 1, by the gravest hit: hits of one text are far from independent."""
        worst = max(map(self.weight, hits), default=0.0)
        odds = self.base + worst if worst > 0 else self.clean
        return 1 / (1 + exp(-max(-50.0, min(50.0, odds))))


def _evidence(toxic: Column, clean: Column, all_toxic: int, all_clean: int) -> Column:
    """Log-likelihood ratio against equal rates, for words of mostly toxic documents; else 0."""
    total = toxic + clean
    rate = all_toxic / max(1, all_toxic + all_clean)
    part = lambda n, share: F.when(n > 0, 2 * n * F.log(n / (total * share))).otherwise(F.lit(0.0))
    return F.when(
        toxic >= PRECISION * total, part(toxic, max(rate, 1e-9)) + part(clean, max(1 - rate, 1e-9))
    ).otherwise(F.lit(0.0))


def learn_lexicon(rows: DataFrame, all_toxic: int, all_clean: int) -> tuple[tuple[str, bool], ...]:
    """Words, and beginnings shared by many words, that mark toxic documents.

    Counted over all fitting rows (text, toxic); only entries with significant evidence
    reach the driver.
    """

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, list[int]] = {}
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for word in set(WORD.findall((text or "").lower())):
                    counts.setdefault(word, [0, 0])[toxic] += 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(counts), pa.string()),
                    pa.array([n[1] for n in counts.values()], pa.int64()),
                    pa.array([n[0] for n in counts.values()], pa.int64()),
                ],
                ["word", "toxic", "clean"],
            )

    summed = (F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counted = rows.mapInArrow(words, "word string, toxic long, clean long").groupBy("word").agg(*summed)
    evidence = _evidence(F.col("toxic"), F.col("clean"), all_toxic, all_clean)
    whole = counted.where(evidence >= WORD_EVIDENCE).select(F.col("word").alias("term"))
    lengths = F.array(*map(F.lit, STEM_LENGTHS))
    beginnings = (
        counted.select("*", F.explode(lengths).alias("length"))
        .where(F.length("word") >= F.col("length"))
        .groupBy(F.substring("word", F.lit(1), F.col("length")).alias("term"))
        .agg(*summed, F.count("*").alias("words"))
        .where((F.col("words") >= STEM_WORDS) & (evidence >= STEM_EVIDENCE))
        .select("term", "words")
    )
    stems = narrowest({r["term"]: r["words"] for r in beginnings.collect()})
    kept = sorted(r["term"] for r in whole.collect())
    return tuple([(t, False) for t in kept if not t.startswith(tuple(stems))] + [(t, True) for t in stems])


def narrowest(words: dict[str, int]) -> list[str]:
    """Beginnings without those that go on from another, each made as long as it keeps its words."""
    stems: list[str] = []
    for term in sorted(words, key=lambda t: (len(t), t)):
        if any(term.startswith(stem) or stem.startswith(term) for stem in stems):
            continue
        longer = term
        while longer:
            term = longer
            longer = max(
                (t for t in words if len(t) == len(term) + 1 and t[:-1] == term and words[t] >= SAME_STEM * words[term]),
                default="",
            )
        stems.append(term)
    return sorted(stems)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = FIT_ROWS) -> Model:
    """Learn lexicon and weights from at most `limit` labelled documents.

    `labels` holds ids and toxic (0/1); an id with several labels counts as toxic if any
    says so, null ids and labels are left out.  The chosen labels are few by the limit, so
    they are broadcast; document texts aren't moved.
    """
    chosen = (
        labels.where(F.col(doc_id).isNotNull() & F.col("toxic").isNotNull())
        .groupBy(doc_id)
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .orderBy(F.xxhash64(doc_id), doc_id)
        .limit(limit)
    )
    labelled = docs.select(doc_id, text).join(F.broadcast(chosen), doc_id).select(F.col(text).alias("text"), "toxic")
    rows = one_of_each_family(store(labelled, "toxicity-fit"))
    totals = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    all_toxic, all_clean = totals.get(1, 0), totals.get(0, 0)
    terms = learn_lexicon(rows, all_toxic, all_clean) if all_toxic and all_clean else ()
    counted = count_hits(rows, terms)
    prior = log((all_toxic + 0.5) / (all_clean + 0.5))
    # Clean documents get more benefit of the doubt, so that a few chance hits don't condemn.
    odds = lambda toxic, clean, doubt: log((toxic + 0.5) / (all_toxic + 1) * (all_clean + 1) / (clean + doubt))
    weights = {hit: odds(*found, 2.0) for hit, found in counted.items() if hit[0] >= 0}
    no_hits = prior + odds(*counted.get((-1, 0, False), (0, 0)), 0.5) if terms else prior
    return Model(terms, weights, prior, min(no_hits, -0.01) if all_clean >= all_toxic else no_hits)


def one_of_each_family(rows: DataFrame) -> DataFrame:
    """Rows (text, toxic) without near copies, which would count a chance word many times."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            families = []
            for text in batch.column("text").to_pylist():
                words = WORD.findall((text or "").lower())
                count = max(1, len(words) - FAMILY_WORDS + 1)
                families.append(min(xxhash.xxh64_intdigest(" ".join(words[k : k + FAMILY_WORDS])) for k in range(count)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("text"), batch.column("toxic"), pa.array([f - (1 << 63) for f in families], pa.int64())],
                ["text", "toxic", "family"],
            )

    sketched = rows.mapInArrow(sketch, "text string, toxic int, family long")
    return store(sketched.groupBy("family", "toxic").agg(F.min("text").alias("text")), "toxicity-fit").select(
        "text", "toxic"
    )


def count_hits(rows: DataFrame, terms: tuple[tuple[str, bool], ...]) -> dict[tuple[int, int, bool], tuple[int, int]]:
    """Toxic and clean documents by kind of hit; (-1, 0, False) stands for documents without any."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(terms)
        counts: dict[tuple[int, int, bool], list[int]] = {}
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for hit in hits_of(automaton, text or "") or {(-1, 0, False)}:
                    counts.setdefault(hit, [0, 0])[toxic] += 1
        columns = list(zip(*((*hit, n[1], n[0]) for hit, n in sorted(counts.items())))) or [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(values, kind) for values, kind in zip(columns, kinds)], ["term", "edits", "inside", "toxic", "clean"]
        )

    schema = "term long, edits long, inside boolean, toxic long, clean long"
    summed = rows.mapInArrow(count, schema).groupBy("term", "edits", "inside").agg(F.sum("toxic"), F.sum("clean"))
    return {(r[0], r[1], r[2]): (r[3], r[4]) for r in summed.collect()}


def score_toxicity(df: DataFrame, model: Model, text: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """`keep` columns (default: all of df) with score, predicted, toxic_terms.

    predicted is 1 from a score of 0.5 on.  Null and empty texts have no hits and get the
    score of such documents.  A text of any length is read whole; rows are independent,
    so repeated rows repeat their score and an empty table gives an empty result.
    Columns of df named like an output column are replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    own = ("score", "predicted", "toxic_terms")
    kept = kept_columns(df, text, keep, own)
    names = [c for c in kept.columns if c != "__text"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(shared.value.terms)
        for batch in batches:
            hits = [hits_of(automaton, value or "") for value in batch.column("__text").to_pylist()]
            scores = [shared.value.score(found) for found in hits]
            terms = [sorted({shared.value.terms[term][0] for term, _, _ in found}) for found in hits]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names]
                + [
                    pa.array(scores, pa.float64()),
                    pa.array([int(s >= 0.5) for s in scores], pa.int32()),
                    pa.array(terms, pa.list_(pa.string())),
                ],
                [*names, *own],
            )

    return kept.mapInArrow(judge, ddl(kept) + "score double, predicted int, toxic_terms array<string>")
