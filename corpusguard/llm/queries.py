"""Registered queries of the operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusguard.llm import (
    bpe,
    decontaminate,
    exact_dedup,
    html,
    language,
    lattice_lm,
    ngram_join,
    periodic_runs,
    secrets,
    substring_dedup,
    toxicity,
    vector_codes,
    vector_join,
)
from corpusguard.llm.common import remainder, store, table
from corpusguard.session import broadcast_if_measured_small

Query = Callable[[SparkSession, str], DataFrame]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 4) == 2
    model = language.fit(docs.where(~held_out))
    return language.identify(docs, model, keep=[F.col("doc_id"), held_out.alias("held_out")])


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"), keep=[F.col("page_id"), F.col("url")])


def byte_vocabulary() -> bpe.Vocabulary:
    return bpe.load_vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.encode_with_digests(docs, byte_vocabulary(), keep=[F.col("doc_id")]).drop("ids")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"), keep=[F.col("doc_id")])
    base = F.filter("secrets", lambda s: s["kind"] != "entropy")

    def count(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *map(count, ("assign", "access", "hex")),
        F.sha2(secrets.joined(base), 256).alias("base_sha256"),
        secrets.joined(F.col("secrets")).alias("spans"),
    )


def op5_lattice_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = remainder(F.col("doc_id"), 7) == 2
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out.alias("held_out"), (~held_out).alias("training"))
    existing = lattice_lm.load_existing(public_tokenizers.path("piece_bpe_32k.model"))
    return lattice_lm.score_documents(docs, existing, "training").drop("training")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.join_near(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    """Learned from the labels that are not held out."""
    labels = table(spark, sf_dir, "labels")
    return toxicity.fit(docs, labels.where(remainder(F.col("doc_id"), 5) != 0))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 5) == 0
    model = toxicity_model(spark, docs, sf_dir)
    scored = toxicity.score_toxicity(docs, model, keep=[F.col("doc_id"), held_out.alias("held_out")])
    return scored.select("doc_id", "held_out", "score", "predicted", "toxic_terms")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.deduplicate(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=[F.col("doc_id")]
    )


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), digest=True)


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """doc_id, text: texts of every tenth crc32 of the id go on periodically from some word on."""
    hashed = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda word: word != "")
    named = docs.select("doc_id", "text", hashed.alias("h"), F.floor(hashed / 10).alias("g"))
    cut = named.withColumn("words", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("words"))
    first = F.col("g") % F.col("n")
    period = 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))
    cut = cut.withColumn("a", F.when(F.col("n") > 0, first).cast("int")).withColumn("p", period.cast("int"))
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    tail = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), times))
    joined = F.array_join(F.slice(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), F.lit(1), F.col("n")), " ")
    return cut.select("doc_id", F.when(F.col("n") > 0, joined).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_periodic_tails(table(spark, sf_dir, "documents"))
    return periodic_runs.find_runs(docs, keep=[F.col("doc_id")], digest=True)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    found = vector_codes.compress(vectors, keep=[F.col("vec_id"), F.col("label")])
    coded = store(found.rows, "codes")
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "same")
    totals = broadcast_if_measured_small(totals, "label-errors")
    joined = coded.join(totals, F.col("label").eqNullSafe(F.col("same")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(found.digest()).alias("codebooks_sha256"))


def op13_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_join.join_vectors(table(spark, sf_dir, "embeddings"))


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE
           WHEN len(words) = 0 THEN []
           WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
           ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) END) AS gram
  FROM w
), n AS (
  SELECT w.doc_id, count(gram) AS n_shingles FROM w LEFT JOIN s ON s.doc_id = w.doc_id GROUP BY w.doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
  FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), e AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * shared >= 85 * (na.n_shingles + nb.n_shingles - shared)
), r AS (
  SELECT doc_id, doc_id AS reached FROM n
  UNION
  SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reached
)
SELECT n.doc_id, n.n_shingles, min(r.reached) AS component_id
FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY n.doc_id, n.n_shingles
"""

OP8_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
  FROM documents
), g AS (
  SELECT doc_id, body, first_value(doc_id) OVER (PARTITION BY body ORDER BY n_chars DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY body) AS group_size
  FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM g
"""

OP10_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), s AS (
  SELECT doc_id, unnest(list_transform(range(1, len(words) - 48),
           lambda i: struct_pack(p := i, body := array_to_string(words[i:i + 49], ' ')))) AS x
  FROM w WHERE len(words) >= 50
), f AS (
  SELECT x.body AS body, min(doc_id) AS least FROM s GROUP BY x.body
), g AS (
  SELECT DISTINCT doc_id, x.p + o AS q
  FROM s JOIN f ON f.body = s.x.body AND s.doc_id > f.least, (SELECT unnest(range(50)) AS o)
), c AS (
  SELECT doc_id, count(*) AS n_removed, list(q) AS gone FROM g GROUP BY doc_id
)
SELECT w.doc_id, len(words) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN words
         ELSE list_filter(words, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN c ON c.doc_id = w.doc_id
"""



def _lloyd_sql(parts: int, entries: int, rounds: int, scale: int) -> str:
    """Rounds of assignment and floored means, one pair of steps each."""
    steps = [
        f"""WITH k AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0
), m AS (
  SELECT vec_id, label, part, v[part * len(v) // {parts} + 1 : (part + 1) * len(v) // {parts}] AS v
  FROM k, (SELECT unnest(range({parts})) AS part)
), b0 AS (
  SELECT part, v, dense_rank() OVER (ORDER BY vec_id) - 1 AS entry FROM m
  QUALIFY dense_rank() OVER (ORDER BY vec_id) <= {entries}
)"""
    ]
    for r in range(rounds + 1):
        steps.append(
            f"""a{r} AS MATERIALIZED (
  SELECT vec_id, label, part, v, arg_min(entry, d * {entries} + entry) AS entry, min(d) AS d FROM (
    SELECT m.vec_id, m.label, m.part, m.v, b.entry,
           list_sum(list_transform(list_zip(m.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d
    FROM m JOIN b{r} b ON b.part = m.part)
  GROUP BY vec_id, label, part, v
)"""
        )
        if r < rounds:
            steps.append(
                f"""b{r + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(u.v, b.v) AS v FROM b{r} b LEFT JOIN (
    SELECT part, entry, list(mean ORDER BY place) AS v FROM (
      SELECT part, entry, place, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS mean
      FROM (SELECT part, entry, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM a{r})
      GROUP BY part, entry, place)
    GROUP BY part, entry) u ON u.part = b.part AND u.entry = b.entry
)"""
            )
    return (
        ", ".join(steps)
        + f""", c AS (
  SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM a{rounds} GROUP BY vec_id, label
), h AS (
  SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds}
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c, h"""
    )


OP12_SQL = _lloyd_sql(vector_codes.PARTS, vector_codes.ENTRIES, vector_codes.ROUNDS, vector_codes.SCALE)

OP13_SQL = r"""
WITH RECURSIVE k AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), e AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM k a JOIN k b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), r AS (
  SELECT vec_id, vec_id AS reached FROM embeddings
  UNION
  SELECT r.vec_id, e.b FROM r JOIN e ON e.a = r.reached
), n AS (
  SELECT a AS vec_id, count(*) AS n FROM e GROUP BY a
)
SELECT r.vec_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_links, min(r.reached) AS component_id,
       r.vec_id = min(r.reached) AS kept
FROM r LEFT JOIN n ON n.vec_id = r.vec_id GROUP BY r.vec_id
"""

QUERIES: dict[str, Query] = {
    "op1_language_id": op1_language_id,
    "op2_html_extraction": op2_html_extraction,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_secret_scan": op4_secret_scan,
    "op5_lattice_score": op5_lattice_score,
    "op6_ngram_join": op6_ngram_join,
    "op7_toxicity": op7_toxicity,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_decontamination": op9_decontamination,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_vector_codes": op12_vector_codes,
    "op13_vector_dedup": op13_vector_dedup,
}

SQL: dict[str, str] = {
    "op6_ngram_join": OP6_SQL,
    "op8_exact_dedup": OP8_SQL,
    "op10_substring_dedup": OP10_SQL,
    "op12_vector_codes": OP12_SQL,
    "op13_vector_dedup": OP13_SQL,
}
