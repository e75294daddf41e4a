"""Operators against brute force and on odd inputs: nulls, empty and long texts, repeated rows, no rows, clashing names."""

import base64
import hashlib
import random
import tracemalloc
from collections import Counter
from math import exp, log, log10

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusguard.llm import (
    bpe,
    decontaminate,
    exact_dedup,
    html,
    language,
    lattice_lm,
    ngram_join,
    secrets,
    substring_dedup,
    toxicity,
    word_blocks,
)
from corpusguard.llm.common import keep_named

tiktoken = pytest.importorskip("tiktoken")
public_tokenizers = pytest.importorskip("public_tokenizers")

SCHEMA = "doc_id long, text string, lang string, score string, block string, n_chars string, kept string"


def odd_rows():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)] + ["the", "of", "Ñandú", "straße", "中文"]
    body = " ".join(rng.choice(words) for _ in range(400))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, body), (5, body), (5, body), (6, body.replace(" ", "\n")), (None, body)]
    near = body.split()
    near[200] = "changed"
    rows += [(7, " ".join(near)), (8, "a b"), (9, "a  b"), (10, "x" * 5000), (11, "long " * 30_000), (12, "é   ,,, 's 12")]
    return [(i, t, "en", "s", "b", "n", "k") for i, t in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def groups(rows, key):
    return Counter(tuple(row[k] for k in key) for row in rows)


# --- exact copies ---------------------------------------------------------------------------


def test_exact_copies(odd, nothing):
    found = exact_dedup.deduplicate(odd, capacity=2).collect()
    expected = {}
    for i, t, *_ in odd_rows():
        body = "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
        expected.setdefault(body, []).append((-len(t or ""), i is None, i))
    assert len(found) == len(odd_rows())
    for row in found:
        own = [v for b, v in expected.items() if hashlib.sha256(b.encode()).hexdigest() == row["text_sha256"]][0]
        assert row["group_size"] == len(own) and row["keep_id"] == min(own, key=lambda v: (v[0], v[1], v[2] or 0))[2]
    assert sum(row["kept"] for row in found) == len(expected)
    assert exact_dedup.deduplicate(nothing).count() == 0
    kept = keep_named(odd, exact_dedup.deduplicate(odd).where("kept"))
    assert kept.count() == len(expected) and kept.columns == odd.columns


def test_chains_compare_bytes(spark):
    bodies = [b"ab", b"cd", b"ab", b"cd", b"alone", b"ab"]
    keys = [7, 7, 7, 7, 8, 9]
    rows = [(0, key, block, 0, 1, (block,)) for block, key in enumerate(keys)]
    index = spark.createDataFrame(rows, "bucket long, key long, block long, slot long, copies long, best struct<block:long>")
    index = index.withColumns({"n_bytes": F.lit(2), "sha256": F.lit(b"same")})
    texts = spark.createDataFrame([(block, 0, body) for block, body in enumerate(bodies)], "block long, slot long, body binary")
    found = {r["block"]: (r["keep"]["block"], r["group_size"]) for r in exact_dedup.resolve(index, texts).collect()}
    assert found == {0: (0, 2), 1: (1, 2), 2: (0, 2), 3: (1, 2), 4: (4, 1), 5: (5, 1)}


def test_directory_splits_only_what_is_overfull():
    counts = np.zeros(16, dtype=np.int64)
    counts[5], counts[4], counts[12] = 9, 3, 4
    directory = exact_dedup.grow_directory(counts, 5)
    held = Counter()
    for place, bucket in enumerate(directory):
        held[bucket] += counts[place]
    assert max(n for b, n in held.items() if b != directory[5]) <= 5 and held[directory[5]] == 9
    assert len(set(directory[8:])) == 1


# --- near copies ----------------------------------------------------------------------------


def brute_components(rows, percent=85, length=4):
    sets = []
    for _, text, *_ in rows:
        words = (text or "").encode().lower().split()
        grams = {tuple(words[k : k + length]) for k in range(len(words) - length + 1)} or ({tuple(words)} if words else set())
        sets.append(grams)
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * len(sets[a] | sets[b]):
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    least = {}
    for (i, *_), own, name in zip(rows, sets, label):
        least[name] = min(least.get(name, 1 << 62), 1 << 62 if i is None else i)
    return Counter((i, len(s), i if not s else least[name]) for (i, *_), s, name in zip(rows, sets, label))


def test_near_copies_of_odd_rows(odd, nothing):
    found = ngram_join.join_near(odd)
    assert groups(found.collect(), ("doc_id", "n_shingles", "component_id")) == brute_components(odd_rows())
    assert ngram_join.join_near(nothing).count() == 0


def test_near_copies_of_drifting_chains(spark):
    """Chains of texts that drift apart, so that links join what no centre links."""
    rng = random.Random(11)
    rows = []
    for chain in range(8):
        words = [f"c{chain}x{rng.randrange(9999)}" for _ in range(rng.choice([5, 9, 14, 40, 130]))]
        for step in range(25):
            words[rng.randrange(len(words))] = f"d{rng.randrange(10**6)}"
            rows.append((rng.randrange(10**6), " ".join(words)))
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = ngram_join.join_near(frame)
    assert groups(found.collect(), ("doc_id", "n_shingles", "component_id")) == brute_components(rows)


def test_members_link_though_their_first_holder_links_with_neither(spark):
    words = [f"38w{k}" for k in range(13)]
    rows = [(1, " ".join(words[:12] + ["z0"])), (2, " ".join(words)), (3, " ".join(words + ["p"]))]
    found = ngram_join.join_near(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in found) == [(1, 1), (2, 2), (3, 2)]


@pytest.mark.parametrize("seed, side", [(1, 1_000_000), (2, 1_000_000), (4, 300)])
def test_near_copies_of_short_templates(spark, monkeypatch, seed, side):
    """Families of short variants: many share a key with a row that they don't link with."""
    monkeypatch.setattr(ngram_join, "SIDE_GRAMS", side)
    rng = random.Random(seed)
    rows = []
    for family in range(60):
        words = [f"{family}w{k}" for k in range(rng.randrange(8, 30))]
        for _ in range(25):
            own = list(words)
            for _ in range(rng.randrange(3)):
                change = rng.choice(["put", "drop", "add"])
                at = rng.choice([0, len(own) - 1, rng.randrange(len(own))])
                if change == "put":
                    own[at] = f"z{rng.randrange(6)}"
                elif change == "drop":
                    del own[at]
                else:
                    own.insert(at + 1, f"p{rng.randrange(6)}")
            rows.append((rng.randrange(10**6), " ".join(own)))
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    found = ngram_join.join_near(frame)
    assert groups(found.collect(), ("doc_id", "n_shingles", "component_id")) == brute_components(rows)


def test_blocks_give_all_links_that_connect():
    """A block product against all pairs: links only, and enough of them to connect what links connect."""
    rng = random.Random(6)
    for _ in range(200):
        bases = [rng.sample(range(60), rng.randrange(5, 25)) for _ in range(4)]

        def some(count):
            found = []
            for _ in range(count):
                own = set(rng.choice(bases))
                for _ in range(rng.randrange(3)):
                    own.discard(rng.choice(sorted(own)))
                    own.add(rng.randrange(60))
                found.append(np.array(sorted(own), dtype=np.uint64))
            return found

        left, right = some(rng.randrange(1, 20)), some(rng.randrange(1, 20))
        near = {
            (a, b)
            for a, x in enumerate(left)
            for b, y in enumerate(right)
            if 100 * len(np.intersect1d(x, y)) >= 85 * len(np.union1d(x, y))
        }
        found = ngram_join.links_of_blocks(left, right, list(range(len(left))), list(range(100, 100 + len(right))), 85)

        def connected(links):
            label = list(range(200))
            for a, b in links:
                label = [label[100 + b] if x == label[a] else x for x in label]
            return {frozenset(k for k in range(200) if label[k] == x) for x in set(label)}

        assert set(found) <= near and connected(found) == connected(near)


def test_sketches_keep_all_rows_that_may_link_and_few_others():
    rng = np.random.default_rng(3)
    base = [rng.integers(0, 1 << 63, 300, dtype=np.uint64) for _ in range(12)]
    near = [np.concatenate([own[:cut], rng.integers(0, 1 << 63, 300 - cut, dtype=np.uint64)]) for own in base for cut in (150, 270, 276, 290)]
    left, right = [np.unique(own) for own in base], [np.unique(own) for own in near]
    labels, others = list(range(12)), [100 + k % 5 for k in range(len(right))]
    others[3] = 0
    share = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    links = {(i, j) for i, a in enumerate(left) for j, b in enumerate(right) if labels[i] != others[j] and share(a, b) >= 0.85}
    flags, own = ngram_join.promising([ngram_join.sketch_of(a) for a in left], [ngram_join.sketch_of(b) for b in right], labels, others, 85)
    assert links and all(flags[i] and own[j] for i, j in links)
    assert not own[3] and not any(own[j] for j in range(0, len(right), 4)) and own.sum() < len(right)
    small = [ngram_join.sketch_of(a[:5]) for a in left]
    assert all(flag.all() for flag in ngram_join.promising(small, small, labels, labels, 85))


def test_linked_sets_share_a_key():
    rng = np.random.default_rng(3)
    for size in (1, 6, 7, 8, 11, 20, 60, 300):
        for _ in range(40):
            base = rng.integers(0, 1 << 63, size + 60, dtype=np.uint64)
            one = np.unique(base[:size])
            drop = rng.integers(0, max(1, size // 10) + 1)
            two = np.unique(np.concatenate([one[drop:], base[size : size + rng.integers(0, max(1, size // 10) + 1)]]))
            shared = len(np.intersect1d(one, two))
            if 100 * shared >= 85 * (len(one) + len(two) - shared):
                assert np.intersect1d(ngram_join.block_keys(one, 85), ngram_join.block_keys(two, 85)).size


# --- repeated passages ----------------------------------------------------------------------


def brute_removed(rows, window):
    least = {}
    texts = [((1 << 63) - 1 if i is None else i, i, (t or "").encode().split()) for i, t, *_ in rows]
    for order, _, words in texts:
        for k in range(len(words) - window + 1):
            own = tuple(words[k : k + window])
            least[own] = min(least.get(own, order), order)
    found = []
    for order, i, words in texts:
        gone = set()
        for k in range(len(words) - window + 1):
            if least[tuple(words[k : k + window])] < order:
                gone.update(range(k, k + window))
        found.append((i, len(words), len(gone), b" ".join(w for k, w in enumerate(words) if k not in gone).decode()))
    return Counter(found)


@pytest.mark.parametrize("hot", [0, 3, 50_000])
def test_repeated_passages(spark, odd, nothing, hot):
    rng = random.Random(2)
    passage = [f"p{k}" for k in range(14)]
    rows = odd_rows()
    for i in range(40):
        words = [f"v{rng.randrange(60)}" for _ in range(rng.randrange(30))]
        cut = rng.randrange(len(words) + 1)
        rows.append((100 + i, " ".join(words[:cut] + passage[rng.randrange(4) :] + words[cut:]), "", "", "", "", ""))
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = substring_dedup.remove_repeats(frame, window=8, gram=3, hot=hot)
    assert groups(found.collect(), ("doc_id", "n_words", "n_removed", "kept")) == brute_removed(rows, 8)
    if hot:
        assert substring_dedup.remove_repeats(nothing).count() == 0


# --- byte-level BPE -------------------------------------------------------------------------


def test_bpe_equals_the_library(spark, odd, nothing):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    vocabulary = bpe.load_vocabulary(path, public_tokenizers.PATTERN)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    odd_texts = ["I'll  go\n\n now\x1c's 'Re", "  x", "　 a", "👩‍👩‍👧 ŉ ǆ", "a" * 3000 + "b!" * 900, "<|endoftext|> 12,345.6"]
    frame = odd.select("doc_id", "text").union(spark.createDataFrame([(50, t) for t in odd_texts], "doc_id long, text string"))
    encoded = bpe.encode(frame, vocabulary, keep=[F.col("doc_id"), F.col("text").alias("original")])
    rows = bpe.with_decoded(encoded, vocabulary).collect()
    assert len(rows) == frame.count()
    for row in rows:
        text = row["original"] or ""
        assert np.frombuffer(row["ids"], dtype="<u4").tolist() == library.encode_ordinary(text)
        assert bytes(row["decoded"]).decode() == text
    assert bpe.with_digests(bpe.encode(nothing, vocabulary), vocabulary).count() == 0


def test_bpe_digests_take_no_second_worker(spark, odd):
    """A task with two Python steps in a row has two workers, and each keeps the memory it once took."""
    docs = odd.select("doc_id", "text")
    encoded = corpus_pipeline.encode(spark, docs, "")
    plan = encoded._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan.split(" MapInArrow")[0]
    vocabulary = bpe.load_vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    apart = bpe.with_digests(bpe.encode(docs, vocabulary, keep=[F.col("doc_id")]), vocabulary)
    assert encoded.columns == apart.columns
    assert Counter(map(tuple, encoded.collect())) == Counter(map(tuple, apart.collect()))


def test_bpe_batches_hold_few_word_lists(spark, odd):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    bpe.encode(odd.select("doc_id", "text"), bpe.Vocabulary({bytes([k]): k for k in range(256)}, r"\S+|\s+"))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 8 * 1024 * 1024


def test_bpe_remembers_few_rare_runs():
    slots, numbering = bpe.chunker(r"\S+|\s+")(), word_blocks.Numbering()
    numbers = [slots(" ".join(f"word{k}" for k in range(start, start + 1000)), numbering) for start in range(0, 150_000, 1000)]
    assert len(numbering) == 150_001
    known = next(c.cell_contents for c in slots.__closure__ if isinstance(c.cell_contents, dict))
    assert len(known) <= bpe.REMEMBERED_RUNS
    back = {slot: word for word, slot in numbering.items()}
    assert b"".join(back[n] for n in numbers[-1]).decode() == " ".join(f"word{k}" for k in range(149_000, 150_000))


# --- lattice likelihood ---------------------------------------------------------------------


def toy(words=("▁", "▁a", "a", "b", "ab", "▁ab", "ba", "bab")):
    shares = np.arange(1.0, len(words) + 258.0)
    return lattice_lm.Existing(tuple(words), shares / shares.sum())


def all_ways(text, pieces):
    if not text:
        return 1.0
    total = 0.0
    for end in range(1, len(text) + 1):
        if text[:end] in pieces.logs:
            total += exp(pieces.logs[text[:end]]) * all_ways(text[end:], pieces)
    if text[0] not in pieces.logs:
        total += exp(sum(pieces.byte_logs[b] for b in text[0].encode())) * all_ways(text[1:], pieces)
    return total


def test_word_lists_are_opened_one_by_one():
    words = [b"word %d" % k for k in range(4000)]
    fields = {"block": range(30), "first": [0] * 30, "words": [words] * 30, "uses": [[0] * 4000] * 30}
    batch = pa.RecordBatch.from_pydict(fields)
    tracemalloc.start()
    dealt = sum(len(own) for part in word_blocks.deal_words(iter([batch]), 4) for own in part.column("words"))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert dealt == 30 * 4000 and peak < 4 * 4000 * 200


def test_forward_sums_all_segmentations():
    existing = toy()
    pieces = lattice_lm.with_shares(existing, existing.shares)
    words = [b"ab", b"babab", b"", "aéb".encode(), b"bbbb", b"ab" * 60]
    vector = lattice_lm.word_logs(words, lattice_lm.Batch(pieces))
    for word, found in zip(words[:-1], vector):
        assert abs(log(all_ways("▁" + word.decode(), pieces)) - found) < 1e-9
        assert abs(lattice_lm.word_log(word, pieces) - found) < 1e-9


def test_document_scores(odd, nothing):
    existing = toy(tuple("▁abcdefghijklmnopqrstuvwxyz0123456789") + ("▁the", "▁w"))
    marked = odd.withColumn("training", F.coalesce(F.col("doc_id") % 2 == 0, F.lit(True)))
    found = lattice_lm.score_documents(marked, existing, "training", keep=[F.col("doc_id"), F.col("training")], passes=1)
    texts = [(i, (t or "").encode().lower().split() + [None]) for i, t, *_ in odd_rows()]
    counts = Counter()
    for i, words in texts:
        counts.update(words if i is None or i % 2 == 0 else [])
    tokens, known = sum(counts.values()), len(counts)
    expected = Counter(
        (i, len(w), sum(x in counts for x in w), tokens, round(sum(log10((counts[x] + 1) / (tokens + known + 1)) for x in w), 5))
        for i, w in texts
    )
    rows = found.collect()
    assert Counter((r[0], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in rows) == expected
    assert all(r["score"] < 0 for r in rows)
    empty = nothing.withColumn("training", F.lit(True))
    assert lattice_lm.score_documents(empty, existing, "training").count() == 0


# --- language -------------------------------------------------------------------------------


def test_language_of_odd_rows(spark, odd, nothing):
    rows = [("der die das und nicht ein schön über", "de"), ("the of and that with which from", "en")] * 6
    rows += [("el la que por ñandú una corazón", "es"), ("le les une être où avec ça", "fr"), ("没有 东西 可以", "zh")] * 6
    rows += [("это не так что", "ru"), ("não uma você está", "pt"), (None, "pt"), ("x", None)] * 6
    model = language.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert model.languages == ("de", "en", "es", "fr", "pt", "ru", "zh")
    for text, lang in rows:
        if text and lang:
            assert language.decide(model, text)[0] == lang
    found = language.identify(odd, model)
    assert found.columns == [c for c in odd.columns if c != "score"] + ["lang_pred", "score", "ambiguous"]
    got = {r["doc_id"]: r for r in found.collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1, 2, 3))
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language.identify(nothing, model).count() == 0
    none = language.fit(nothing.select("text", "lang"))
    assert {r["lang_pred"] for r in language.identify(odd, none).collect()} == {"und"}
    code = language.codewords(7)
    assert min((code[a] != code[b]).sum() for a in range(7) for b in range(a)) >= code.shape[1] // 4


# --- secrets --------------------------------------------------------------------------------


def entropy(text):
    return -sum(n / len(text) * log(n / len(text), 2) for n in Counter(text).values())


def test_entropy_windows_equal_brute_force():
    rng = random.Random(1)
    for char_class in secrets.CLASSES:
        for _ in range(60):
            text = "".join(rng.choice(char_class.members[: rng.randrange(3, 30)]) for _ in range(rng.randrange(20, 70)))
            width = char_class.window
            inside = set()
            for k in range(len(text) - width + 1):
                if entropy(text[k : k + width]) >= char_class.bits - 1e-9:
                    inside.update(range(k, k + width))
            found = {k for a, b in secrets.suspicious(text, char_class) for k in range(a, b)}
            assert found == inside


def test_window_exactly_at_the_bound_is_found():
    assert secrets.suspicious("0123ABCD" * 3, secrets.CLASSES[0]) == [(0, 24)]


@pytest.mark.parametrize("alphabet, least", [("0123456789abcdef", 24), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 20), ("+/", 20)])
def test_planted_secrets_are_found(alphabet, least):
    """Random strings of each kind: 98 of 100 at least, from the length that the method can judge."""
    rng = random.Random(alphabet)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/" if alphabet == "+/" else alphabet
    caught = 0
    for _ in range(600):
        size = rng.choice([least, 32, 40, 64])
        text = f"see {''.join(rng.choice(letters) for _ in range(size))} there"
        caught += any(start < 4 + size and end > 4 for start, _, end in secrets.scan(text))
    assert caught >= 588


def test_paths_and_names_are_no_secrets():
    rng = random.Random(9)
    words = "docs release notes for usr local lib python dist packages img holiday archive report IMG DSC README data".split()
    for _ in range(4000):
        parts = [
            rng.choice([w := rng.choice(words), w.title(), f"{w}{rng.randrange(100)}", rng.choice(["2023", "20230415", "7"]), f"v{rng.randrange(20)}"])
            for _ in range(rng.randrange(3, 9))
        ]
        text = rng.choice("/_-").join(parts)
        assert secrets.scan(f"open {text} now") == [], text
    for text in ("getHTMLElementFromClassName", "internationalizationSupport2", "123e4567-e89b-12d3-a456-426614174000"):
        assert secrets.scan(text) == []


def test_secret_spans(odd, nothing):
    hidden = "Zq8" + "kT2vR9xLp4Wm7" + "Yb3NcH6s"
    text = f"é password: abc123 Token=x api_key='abcdef' ſecret=abcdefgh AKIA{'A1' * 9} {'0f' * 12} {hidden} {'word' * 9}"
    found = [(secrets.KINDS[k], text[a:b]) for a, k, b in secrets.scan(text)]
    assert found == [
        ("assign", "password: abc123"),
        ("assign", "api_key='abcdef"),
        ("access", "AKIA" + "A1" * 9),
        ("hex", "0f" * 12),
        ("entropy", hidden),
    ]
    assert {r["doc_id"]: r["secrets"] for r in secrets.find_secrets(odd).collect()}[1] == []
    assert secrets.find_secrets(nothing).count() == 0


# --- toxicity -------------------------------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


def test_automaton_equals_edit_distance():
    rng = random.Random(4)
    terms = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(3, 12))) for _ in range(12)})
    automaton = toxicity.Automaton(tuple((t, False) for t in terms))
    for _ in range(3000):
        word = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 13)))
        near = min(((distance(word, t), k) for k, t in enumerate(terms) if distance(word, t) <= toxicity.allowed_edits(len(t))), default=None)
        assert automaton.match(word) == (None if near is None else (near[1], near[0]))
    stems = toxicity.Automaton((("abca", True),))
    assert stems.match("abcazzz") == (0, 0) and stems.match("xabca") is None


def test_toxicity_of_odd_rows(spark, odd, nothing):
    rng = random.Random(8)
    bad = ["grumbly", "snarkface", "poltroon"]
    rows = []
    for i in range(600):
        words = [f"w{rng.randrange(3000)}" for _ in range(30)]
        if i % 5 == 0:
            words[rng.randrange(30)] = rng.choice(bad)
        rows.append((i, " ".join(words), int(i % 5 == 0)))
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(frame, frame.select("doc_id", "toxic").union(spark.createDataFrame([(None, 1), (3, None)], "doc_id long, toxic int")))
    assert {t for t, _ in model.terms} >= set(bad)
    score = lambda text: model.score(toxicity.hits_of(toxicity.Automaton(model.terms), text))
    assert score("you grumbly thing") > 0.5 and score("you snarkfase thing") > 0.5 and score("nothing here") < 0.5
    assert score('they said "you grumbly thing" again') < score("they said you grumbly thing again")
    found = toxicity.score_toxicity(odd, model).collect()
    assert len(found) == len(odd_rows()) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in found)
    assert toxicity.score_toxicity(nothing, model).count() == 0
    blank = toxicity.fit(nothing, nothing.select("doc_id", F.lit(1).alias("toxic")))
    assert {r["predicted"] for r in toxicity.score_toxicity(odd, blank).collect()} <= {0, 1}


# --- web pages ------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/x">Menu</a></li></ul></nav><div class="cookie-notice">We use cookies on this site, accept?</div>
<main><article><h1>Head &amp; line</h1><p>First   paragraph
with <b>bold</b>&nbsp;text.<p>Second<br>part.</p><aside>Aside</aside><div class="ad">Buy</div>
<form><input><button>Send</button></form><p>Third &lt;b&gt; 1 < 2.</p></article>
<section id="comments"><p>Reader says something rather long about all of this, and goes on and on.</p></section></main>
<footer>&copy; 2020</footer></body></html>"""


def test_pages(spark, nothing):
    want = "Head & line\nFirst paragraph with bold text.\nSecond part.\nThird <b> 1 < 2."
    plain = "<div><a href=a>Home</a></div><div><a href=b>News</a></div>" + "<p>" + "long text here " * 20 + "</p><p>Short.</p><p>" + "more of it " * 20 + "</p><div><a href=c>About us</a></div>"
    rows = [(1, PAGE), (2, None), (3, ""), (4, plain), (4, plain), (5, "<p>" + "x " * 200_000), (6, "<script>never closed"), (7, "just text")]
    found = html.extract(spark.createDataFrame(rows, "page_id long, html string").withColumn("text", F.lit(1))).collect()
    got = {r["page_id"]: r["text"] for r in found}
    assert len(found) == len(rows) and got[1] == want and got[2] == got[3] == got[6] == "" and got[7] == "just text"
    assert got[4].split("\n")[1] == "Short." and "Home" not in got[4] and "About" not in got[4]
    assert len(got[5]) == 399_999 and all(r["n_chars"] == len(r["text"]) for r in found)
    assert html.extract(nothing.select("doc_id", F.col("text").alias("html"))).count() == 0


def test_distribution_chooses_among_articles():
    menu = "".join(f"<li><a href=/{k}>Topic {k}</a></li>" for k in range(4))
    teaser = "<article><h2>Teaser</h2><p>In short.</p></article>"
    body = "".join(f"<p>{'plain words follow here ' * 12}</p>" for _ in range(3))
    text = "\n".join(["plain words follow here " * 11 + "plain words follow here"] * 3)
    linked = "<h1><a href=/t>Title</a></h1>"
    # The text stands out: teasers beyond a menu are not part of it, whether it is named or not.
    assert html.main_text(f"<article>{linked}{body}</article>{menu}{teaser}") == "Title\n" + text
    assert html.main_text(f"{teaser}{menu}<div>{body}</div>") == text
    # A short article is taken whole, links and all, and the text right beside it is not.
    short = "<article><h1>Short</h1><ul>" + menu + "</ul><p>End.</p></article>"
    assert html.main_text(f"<div>Some words beside.</div>{short}") == "Short\nTopic 0\nTopic 1\nTopic 2\nTopic 3\nEnd."
    assert html.main_text(teaser + menu + teaser) == "Teaser\nIn short.\nTeaser\nIn short."


# --- benchmark leaks ------------------------------------------------------------------------


def brute_tiles(pattern, text, least):
    free_p, free_t, found = set(range(len(pattern))), set(range(len(text))), []
    while True:
        best = None
        for p in range(len(pattern)):
            for t in range(len(text)):
                n = 0
                while p + n in free_p and t + n in free_t and pattern[p + n] == text[t + n]:
                    n += 1
                if n >= least and (best is None or n > best[2]):
                    best = (p, t, n)
        if best is None:
            return found
        found.append(best)
        free_p -= set(range(best[0], best[0] + best[2]))
        free_t -= set(range(best[1], best[1] + best[2]))


def test_tiling_equals_brute_force():
    rng = random.Random(6)
    for _ in range(120):
        pattern = tuple(rng.randrange(4) for _ in range(rng.randrange(1, 16)))
        text = tuple(rng.randrange(5) for _ in range(rng.randrange(1, 30)))
        assert sorted(decontaminate.tiles(pattern, text, 3)) == sorted(brute_tiles(pattern, text, 3))


def test_leaks(spark, odd, nothing):
    item = "one two three four five six seven eight nine ten eleven twelve"
    items = spark.createDataFrame([(1, item), (2, "Tiny item"), (3, None), (4, "...")], "item_id long, text string")
    turned = "x seven eight nine ten eleven twelve y, One two THREE four five six z"
    rows = [(1, turned), (2, "one two three four and no more"), (3, "a tiny item here"), (4, None), (5, ""), (6, "f " * 9000 + item), (6, "f " * 9000 + item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("contaminated", F.lit("clash"))
    for block_tokens in (2_000_000, 3):
        found = decontaminate.find_contamination(docs, items, block_tokens=block_tokens).collect()
        got = groups([(r["doc_id"], tuple(r["benchmark_ids"]), r["contaminated"]) for r in found], (0, 1, 2))
        assert got == Counter({(1, (1,), True): 1, (2, (), False): 1, (3, (2,), True): 1, (4, (), False): 1, (5, (), False): 1, (6, (1,), True): 2})
    assert decontaminate.find_contamination(nothing, items).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.find_contamination(odd, items.limit(0)).collect())
