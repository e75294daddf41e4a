"""The whole pipeline over odd rows against brute force, stage by stage."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import brute_components, brute_tiles

import corpus_pipeline
from corpusguard.llm import decontaminate

tiktoken = pytest.importorskip("tiktoken")
public_tokenizers = pytest.importorskip("public_tokenizers")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, contaminated string, predicted string, block string"


def some_rows(rng):
    """Rows (id, text, toxic): clean ones, toxic ones, copies, near copies, chains, leaks, empty and repeated ones."""
    words = [f"w{k}" for k in range(300)] + ["the", "Ñandú", "straße", "中文"]
    bad = ["zurglefump", "blortnagger", "krantzwibble"]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(k, " ".join(say(25))) for k in range(6)] + [(9, None), (10, "")]
    rows = []
    for k in range(160):
        body = say(rng.randrange(20, 70))
        if k % 4 == 0:
            for _ in range(9):
                body.insert(rng.randrange(len(body)), rng.choice(bad))
        rows.append((k, " ".join(body), int(k % 4 == 0)))
    clean = [row for row in rows if not row[2]]
    for k in range(30):
        rows.append((1000 + k, clean[k % 7][1] + " \n" * (k % 3), 0))
        near = clean[10 + k % 5][1].split()
        near[rng.choice([0, len(near) - 1])] = f"n{k}"
        rows.append((2000 - k, " ".join(near), 0))
    for k in range(6):
        one, two = items[k][1].split()[:12], items[k][1].split()[12:]
        rows.append((3000 + k, " ".join(say(30) + two + say(5) + one), 0))
        rows.append((3100 + k, " ".join(say(30) + two[:6] + say(20)), 0))
    rows += [(4000, None, 0), (4001, "", 0), (4002, " \t", 0), (None, " ".join(say(40)), 0), (4003, "a b", 0), (4003, "a b", 0)]
    rows += [(4004, "x" * 4000, 0), (4005, " ".join(say(6000)), 0)]
    rng.shuffle(rows)
    return rows, items


def rank(i):
    return (i is None, i or 0)


def after_exact(rows):
    best = {}
    for i, text in rows:
        body = "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")
        own = (-len(text or ""), rank(i), i, text)
        if body not in best or own[:2] < best[body][:2]:
            best[body] = own
    return [(i, text) for _, _, i, text in best.values()]


def after_near(rows):
    groups = [(i, component) for i, _, component in brute_components(rows).elements()]
    return [(i, text) for i, text in rows if (i, i) in groups or i is None and (None, 1 << 62) in groups]


def is_leak(text, items):
    for _, body in items:
        own = decontaminate.tokens_of(body or "")
        if own:
            least = min(decontaminate.SEED, len(own))
            covered = sum(n for _, _, n in brute_tiles(tuple(own), tuple(decontaminate.tokens_of(text or "")), least))
            if covered >= decontaminate.COVERAGE * len(own):
                return True
    return False


def test_pipeline_equals_brute_force(spark, tmp_path):
    rows, items = some_rows(random.Random(17))
    frame = spark.createDataFrame([(i, t, "de", "s", 1, "own", "mine", "p", "b") for i, t, _ in rows], SCHEMA)
    frame.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, toxic) for i, _, toxic in rows if i is not None and i < 160]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    folder, stages = str(tmp_path), dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    expected = sorted([(i, t) for i, t, toxic in rows if not toxic], key=repr)
    for name, after in (
        ("toxicity", None),
        ("exact_dedup", after_exact),
        ("near_dedup", after_near),
        ("decontamination", lambda own: [row for row in own if not is_leak(row[1], items)]),
    ):
        stages[name](spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        assert docs.columns == frame.columns
        assert {(r["score"], r["contaminated"], r["predicted"], r["block"]) for r in docs.collect()} == {("own", "mine", "p", "b")}
        before = len(expected)
        expected = after(expected) if after else expected
        assert sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=repr) == sorted(expected, key=repr), name
        assert after is None or len(expected) < before
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = corpus_pipeline.byte_vocabulary().ranks
    tokenizer = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = corpus_pipeline.run(spark, folder).collect()
    sha = lambda data: hashlib.sha256(data).hexdigest()
    coded = []
    for i, text in expected:
        ids = tokenizer.encode_ordinary(text or "")
        coded.append((i, len(ids), sha(np.array(ids, dtype="<u4").tobytes()), sha((text or "").encode())))
    assert path and sorted(repr((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"])) for r in found) == sorted(map(repr, coded))


def test_pipeline_of_no_rows(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).where(F.lit(True)).count() == 0
