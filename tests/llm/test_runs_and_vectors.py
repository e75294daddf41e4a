"""Periodic runs, vector codes and near-duplicate vectors against brute force and on odd inputs."""

import hashlib
import math
import random
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusguard.llm import periodic_runs, queries, vector_codes, vector_join
from corpusguard.llm.common import whole_groups

# --- periodic runs --------------------------------------------------------------------------


def plain_runs(words, least_words, least_periods):
    """Every maximal stretch for every period; those with a smaller period go."""
    found = []
    for q in range(1, len(words) // least_periods + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            part = words[i : i + length]
            if length >= max(least_words, least_periods * q) and not any(part[r:] == part[:-r] for r in range(1, q)):
                found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda run: (run[0], run[2]))


def random_words(rng):
    words = [rng.randrange(rng.choice([1, 2, 3, 40])) for _ in range(rng.randrange(110))]
    for _ in range(rng.randrange(4)):
        if len(words) > 4:
            first = rng.randrange(len(words))
            period = rng.randrange(1, max(2, (len(words) - first) // 3 + 1))
            for i in range(first, rng.randrange(first, len(words) + 1)):
                words[i] = words[first + (i - first) % period]
    return words


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(400):
        words = random_words(rng)
        least, periods = rng.choice([(24, 3), (9, 3), (1, 3), (12, 4)])
        found = periodic_runs.runs_of(np.array(words, dtype=np.int64), least, periods)
        assert found == plain_runs(words, least, periods), (words, least, periods)


def test_runs_of_long_sequences_and_ordered_sets():
    rng = random.Random(3)
    base = [rng.randrange(9) for _ in range(4000)]
    words = np.array([7, 8] + [base[i % 4000] for i in range(20_000)] + [9] + [5] * 30_000, dtype=np.int64)
    found = periodic_runs.runs_of(words)
    whole = [run for run in found if run[1] > 5000]
    assert (20_003, 30_000, 1) in whole and any(run[2] == 4000 and run[0] + run[1] <= 20_003 for run in whole)
    members = rng.sample(range(10**6), 5000)
    ordered = periodic_runs.Positions(members[0])
    for k, position in enumerate(members[1:], 1):
        if k % 500 == 0:
            known = sorted(members[:k])
            before = max((m for m in known if m < position), default=-1)
            after = min((m for m in known if m > position), default=-1)
            assert ordered.around(position) == (before, after)
        ordered.add(position)
    assert list(ordered) == sorted(members)
    with pytest.raises(ValueError):
        periodic_runs.runs_of(words, 24, 2)


def described(text):
    words = text.encode().split()
    runs = plain_runs(words, 24, 3)
    best = min(runs, key=lambda run: (-Fraction(run[1], run[2]), run[0], run[2]), default=None)
    covered = {i for start, length, q in runs for i in range(start + q, start + length)}
    lines = "".join("%d,%d,%d\n" % run for run in runs)
    kept = b" ".join(word for i, word in enumerate(words) if i not in covered)
    return (
        len(runs),
        *(best or (None,) * 3),
        best and 1000 * best[1] // best[2],
        hashlib.sha256(lines.encode()).hexdigest(),
        hashlib.sha256(kept).hexdigest(),
    )


def with_tail(doc_id, text):
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    words, g = (text or "").encode().split(), h // 10
    if h % 10 == 0 and words:
        first = g % len(words)
        period = 1 + (len(words) - first) // (3 + g % 8)
        words = [w if i < first else words[first + (i - first) % period] for i, w in enumerate(words)]
    return b" ".join(words).decode()


def test_query_of_runs(spark, tmp_path):
    rng = random.Random(8)
    rows = [(k, " ".join(f"w{rng.randrange(30)}" for _ in range(rng.randrange(160))), "de") for k in range(150)]
    rows += [(k, " ".join(map(str, random_words(rng))), None) for k in range(150, 300)]
    rows += [(None, "a " * 40, "x"), (300, None, "x"), (301, "", "x"), (302, " \t\n\x0b", "x"), (5, "b\x1cc d " * 30, "x")]
    rows += [(303, "ha " * 60, "x"), (303, "ha " * 60, "x")]
    spark.createDataFrame(rows, "doc_id long, text string, period string").write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.op11_periodic_runs(spark, str(tmp_path))
    assert found.columns[:6] == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli"]
    expected = sorted(map(repr, ((i, *described(with_tail(i, t))) for i, t, _ in rows)))
    assert sorted(repr(tuple(row)) for row in found.collect()) == expected
    assert sum(row["n_runs"] for row in found.collect()) > 30


def test_general_form_of_runs(spark):
    docs = spark.createDataFrame([(1, "x " + "a b " * 20, 7), (2, None, 8)], "doc_id long, text string, length long")
    first, second = periodic_runs.find_runs(docs, least_words=6).orderBy("doc_id").collect()
    assert [tuple(run) for run in first["runs"]] == [(1, 40, 2)] and first["collapsed"] == "x a b"
    assert first["length"] == 40 and second["length"] is None and second["runs"] == [] and second["collapsed"] == ""
    assert periodic_runs.find_runs(docs.limit(0)).count() == 0


# --- vector codes ---------------------------------------------------------------------------


def plain_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    """(id, code, error) of each kept row, and the codebooks, one vector after the other."""
    usable = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    usable = [r for r in usable if len(r[1]) and len(r[1]) % parts == 0]
    order = sorted(usable, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    usable = [r for r in usable if order and len(r[1]) == len(order[0][1])]
    order = [r for r in order if len(r[1]) == len(order[0][1])]
    whole = lambda vector: [math.floor(scale * x) for x in vector]
    cut = lambda v: [v[p * len(v) // parts : (p + 1) * len(v) // parts] for p in range(parts)]
    members = [cut(whole(r[1])) for r in usable]
    seeds = [cut(whole(r[1])) for r in order[:entries]]
    books = [[seed[p] for seed in seeds] for p in range(parts)]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def assign():
        return [[min((apart(m[p], e), k) for k, e in enumerate(books[p])) for p in range(parts)] for m in members]

    for _ in range(rounds):
        chosen = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                own = [m[p] for m, c in zip(members, chosen) if c[p][1] == k]
                if own:
                    books[p][k] = [sum(x) // len(own) for x in zip(*own)]
    coded = [(r[0], "".join("%02x" % c[1] for c in ch), sum(c[0] for c in ch)) for r, ch in zip(usable, assign())]
    return coded, books


def some_vectors(rng, count, size, label=lambda k: k % 3):
    return [(k, [rng.uniform(-1, 1) for _ in range(size)], label(k)) for k in range(count)]


VECTORS = "vec_id long, embedding array<float>, label int"


def test_codes_equal_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_codes, "SALT_COMPONENTS", 16 * 23)  # several salts
    rng = random.Random(4)
    rows = some_vectors(rng, 150, 16, lambda k: None if k % 5 == 0 else k % 3)
    rows = [(i, [float(np.float32(x)) for x in v], label) for i, v, label in rows]
    rows += [(-5, None, 1), (-4, [], 1), (-3, [None] + [0.5] * 15, 1), (-2, [math.nan] * 16, 2), (-1, [math.inf] * 16, 2)]
    rows += [(7, rows[7][1], 1), (9, rows[11][1], 1), (None, rows[12][1], 2), (500, [0.25] * 24, 0), (501, [0.25] * 3, 0)]
    spark.createDataFrame(rows, VECTORS).repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    found = queries.op12_vector_codes(spark, str(tmp_path)).collect()
    coded, books = plain_codes([(i, v) for i, v, _ in rows])
    assert sorted(repr((r["vec_id"], r["code"], r["error"])) for r in found) == sorted(map(repr, coded))
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    assert {r["codebooks_sha256"] for r in found} == {digest}
    labels = spark.read.parquet(str(tmp_path / "embeddings.parquet"))
    both = vector_codes.compress(labels, keep=[F.col("label")]).rows.groupBy("label").sum("error").collect()
    assert {r["label_error"] for r in found} == {row[1] for row in both}


def test_codes_of_odd_inputs(spark):
    rng = random.Random(6)
    schema = "vec_id long, embedding array<double>, salt string, place string, code string, position int"
    rows = [(i, v, "s", "p", "c", 3) for i, v, _ in some_vectors(rng, 5, 8)]
    found = vector_codes.compress(spark.createDataFrame(rows, schema), rounds=2)
    assert found.rows.columns == ["vec_id", "salt", "place", "position", "code", "error"]
    coded, books = plain_codes([(r[0], r[1]) for r in rows], rounds=2)
    assert sorted((r["vec_id"], r["code"], r["error"]) for r in found.rows.collect()) == sorted(coded)
    assert found.codebooks == books and found.rows.first()["salt"] == "s"
    none = vector_codes.compress(spark.createDataFrame([], schema))
    assert none.rows.count() == 0 and none.rows.columns == found.rows.columns and none.digest() == hashlib.sha256(b"").hexdigest()
    far = spark.createDataFrame([(1, [1e9] * 8, "", "", "", 1)], schema)
    with pytest.raises(Exception, match="would not fit"):
        vector_codes.compress(far).rows.collect()


def test_only_members_that_change_entry_are_shuffled(spark):
    rows = some_vectors(random.Random(2), 60, 16)
    found = vector_codes.compress(spark.createDataFrame(rows, VECTORS), rounds=2)
    plan = found.rows._jdf.queryExecution().executedPlan().toString()
    resident, arrivals = plan.split("FlatMapCoGroupsInArrow [position")[1].split("+- Exchange")[:2]
    assert "Bucketed: true" in resident and "entry" in resident and "NOT (entry" in arrivals


# --- near-duplicate vectors -----------------------------------------------------------------


def plain_links(rows, cosine=0.98):
    """(id, links, least id reached) of each row, pair by pair."""
    units = []
    for _, vector, label in rows:
        usable = label is not None and vector and all(x is not None and math.isfinite(x) for x in vector) and any(vector)
        units.append(np.array(vector) / np.linalg.norm(vector) if usable else None)
    near = [[] for _ in rows]
    for i in range(len(rows)):
        for j in range(i):
            if units[i] is not None and units[j] is not None and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]):
                if units[i] @ units[j] >= cosine:
                    near[i].append(j)
                    near[j].append(i)
    found = []
    for i, row in enumerate(rows):
        seen, waiting = {i}, [i]
        while waiting:
            for j in near[waiting.pop()]:
                if j not in seen:
                    seen.add(j)
                    waiting.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        found.append((row[0], len(near[i]), min(ids, default=None)))
    return found


def clustered(rng, count, size):
    """Families around a centre at several distances, chains, and rows on their own."""
    rows = []
    for k in range(count):
        kind = k % 4
        if kind == 0 or not rows:
            vector = [rng.gauss(0, 1) for _ in range(size)]
        else:
            of = rng.choice(rows)[1] if kind == 3 else rows[(k // 40) * 40 % len(rows)][1]
            noise = rng.choice([0.02, 0.1, 0.18, 0.2])
            vector = [x + noise * rng.gauss(0, 1) for x in of]
        rows.append((1000 - k, vector, rng.choice([1, 1, 2])))
    return rows


@pytest.mark.parametrize("side, block", [(1 << 18, 1 << 22), (1, 900)])
def test_vector_links_equal_brute_force(spark, monkeypatch, side, block):
    monkeypatch.setattr(vector_join, "SIDE_COMPONENTS", side)
    monkeypatch.setattr(vector_join, "BLOCK_COMPONENTS", block)
    rows = clustered(random.Random(side), 700, 32)
    rows += [(2000, None, 1), (2001, [0.0] * 32, 1), (2002, [math.nan] + [1.0] * 31, 1), (2003, [None] + [1.0] * 31, 1)]
    rows += [(2004, rows[3][1], None), (None, rows[3][1], rows[3][2]), (2005, rows[3][1], rows[3][2]), (2005, rows[3][1], rows[3][2])]
    rows += [(2006, [1.0, 2.0], 1), (2007, [2.0, 4.0], 1), (2008, [], 1), (2009, [math.inf] * 32, 2), (2010, [-x for x in rows[3][1]], rows[3][2])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    found = vector_join.join_vectors(frame.withColumn("kept", F.lit("x")).withColumn("node", F.lit(1))).collect()
    expected = plain_links(rows)
    assert sorted(map(repr, ((r["vec_id"], r["n_links"], r["component_id"]) for r in found))) == sorted(map(repr, expected))
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found)
    assert sum(n for _, n, _ in expected) > 500


def test_vectors_without_rows_or_use(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert vector_join.join_vectors(empty).count() == 0
    unusable = spark.createDataFrame([(1, None, 1), (None, [1.0], None)], VECTORS)
    assert sorted(map(repr, map(tuple, vector_join.join_vectors(unusable).collect()))) == sorted(
        map(repr, [(1, 0, 1, True), (None, 0, None, True)])
    )


def test_recall_of_the_tables():
    """Pairs exactly at the least cosine meet in a table at least as often as promised, and come near enough."""
    rng = np.random.default_rng(1)
    for rows in (1_000, 10**6, 10**9):
        index = vector_join.learn_index(rng.standard_normal((2000, 64)) / 8, rows, 0.98)
        one = rng.standard_normal((3000, 64))
        one /= np.linalg.norm(one, axis=1)[:, None]
        other = rng.standard_normal((3000, 64))
        other -= (other * one).sum(axis=1)[:, None] * one
        two = 0.98 * one + math.sqrt(1 - 0.98**2) * other / np.linalg.norm(other, axis=1)[:, None]
        a, b = index.codes(one), index.codes(two)
        assert np.abs(a.mean(axis=0) - 0.5).max() < 0.15
        shape = (len(a), index.tables, index.bits)
        used = index.tables * index.bits
        meet = (a[:, :used].reshape(shape) == b[:, :used].reshape(shape)).all(axis=2).any(axis=1)
        near = (a[:, :128] != b[:, :128]).sum(axis=1) <= index.near
        assert (meet & near).mean() > 0.985


def test_whole_groups():
    keys = [1] * 3 + [2] + [3] * 7 + [4, 5, 5]
    rows = pa.record_batch({"key": keys, "row": list(range(len(keys)))})
    for size in (1, 2, 5, 20):
        groups = []
        for part, cuts in whole_groups((rows.slice(k, size) for k in range(0, len(keys), size)), ["key"]):
            groups += [part.slice(a, b - a).column("key").to_pylist() for a, b in zip(cuts, cuts[1:])]
        assert groups == [[1] * 3, [2], [3] * 7, [4], [5, 5]], size
