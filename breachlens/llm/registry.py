"""The operators as named queries over the test tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from breachlens.llm import (
    bpe, clustering, hpylm, jaccard, licenses, packing, quality, spelling, suffix_dedup, toxicity, urls, vafile, wordpiece,
)
from breachlens.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


OP1_RULES = [
    urls.Rule("net/", "block"), urls.Rule("example.net/en/", "allow"),
    urls.Rule("example.com/de/", "block"), urls.Rule("org/fr/", "allow"),
]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's label is that of the document its path names by number: bad if it is toxic or
    of low quality."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    bad = labels.groupBy("doc_id").agg(
        F.max(F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).otherwise(0)).alias("bad")
    )
    number = F.try_to_number(F.regexp_extract(F.col("url"), r"://[^/?#]*/[a-z]*/([0-9]{1,18})", 1), F.lit("9" * 18))
    labelled = pages.select("url", number.cast("long").alias("doc_id")).join(bad, "doc_id").select("url", "bad")
    return urls.judge(pages, labelled, OP1_RULES)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(table(spark, sf_dir, "documents"))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20, scale=64)


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""


def packed_digests(pieces: DataFrame) -> DataFrame:
    """Pieces with a checksum in place of their ids."""
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset",
    )


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digests(packing.pack(table(spark, sf_dir, "documents")))


def op5_hierarchical_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpylm.score(table(spark, sf_dir, "documents"))


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("detections")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without the name of the rejecting rule, which depends on the order of the cascade."""
    return quality.judge(table(spark, sf_dir, "documents")).drop("rejected_by")


_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

# Distinct words are those of each block of 1,000 words, added up.
OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
), twice AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, shingle) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(5)) AS k) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, t, lines, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars,
         len(t) - len(translate(t, '#*$%&|<>', '')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
         coalesce(list_sum(list_transform(range(0, len(w), 1000), lambda i: len(list_distinct(w[i + 1:i + 1000])))), 0) AS n_distinct, len(regexp_replace(t, '[^\p{L}]', '', 'g')) AS letters,
         len(regexp_replace(t, '[^\p{Lu}]', '', 'g')) AS capitals
  FROM d LEFT JOIN covered c ON c.doc_id = d.doc_id
), b AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR n_symbols * 10 > n_words * 3 OR word_chars < 2 * n_words OR word_chars > 25 * n_words
            OR (len(lines) >= 3 AND n_dup_lines * 2 > len(lines)) OR letters * 2 < word_chars
            OR capitals * 2 > letters OR n_distinct * 5 < n_words - 20
            OR (len(lines) >= 3 AND len(list_filter(lines, lambda x: regexp_matches(trim(x), '^[-*•●]'))) * 10 > len(lines) * 9)
            OR (len(lines) >= 3 AND len(list_filter(lines, lambda x: regexp_matches(trim(x), '(\.\.\.|…)$'))) * 10 > len(lines) * 3)
           ) AS kept
FROM b
"""


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), words=4, percent=85)


OP10_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), {_LETTERS}), '[\x20\x09-\x0D]+'),
                             lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
  FROM d
), u AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM s
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY 1, 2 HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))
), reach AS (
  SELECT doc_id, doc_id AS c FROM s UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.c = links.a
)
SELECT s.doc_id, len(s) AS n_shingles, min(c) AS component_id FROM s JOIN reach ON reach.doc_id = s.doc_id GROUP BY 1, 2
"""


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents"), least_length=6, least_n=5, times=5)


# A crc32 by its definition, a table of 256 steps of eight bits; near words by what is left of them
# without one code point.
OP12_SQL = rf"""
WITH RECURSIVE steps AS MATERIALIZED (
  SELECT list(list_reduce(range(8), lambda c, k: xor(c >> 1, (c & 1) * 3988292384), b) ORDER BY b) AS t
  FROM (SELECT unnest(range(256)) AS b)
), found AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, {_LETTERS}), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents
), runs AS (
  SELECT doc_id, run, count(*) AS n FROM found WHERE length(run) >= 6 GROUP BY ALL
), points AS (
  SELECT *, list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda x: unicode(x)) AS p
  FROM runs
), hashed AS (
  SELECT run, n, xor(list_reduce(
           flatten(list_transform(p, lambda x: CASE WHEN x < 128 THEN [x] ELSE [192 + (x >> 6), 128 + (x & 63)] END)),
           lambda c, b: xor(c >> 8, steps.t[1 + (xor(c, b) & 255)]), CAST(4294967295 AS BIGINT)), 4294967295) AS h
  FROM points, steps
), w AS (
  SELECT CASE WHEN h % 199 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM hashed
), v AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM w WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), cut AS MATERIALIZED (
  SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)
), near AS (
  SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    AND length(a.word) = length(b.word)
  UNION SELECT a.word, v.word, v.n FROM cut a JOIN v ON a.rest = v.word
  UNION SELECT v.word, a.word, a.n FROM cut a JOIN v ON a.rest = v.word
), best AS (
  SELECT word, count(*) AS n_near, arg_min(other, (-n, encode(other))) AS other, max(n) AS n FROM near GROUP BY word
), formed AS MATERIALIZED (
  SELECT v.word, v.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.n >= 5 * v.n THEN b.other END AS form,
         CASE WHEN b.n >= 5 * v.n THEN b.n END AS form_n
  FROM v LEFT JOIN best b ON b.word = v.word
), leads AS (
  SELECT word, word AS goal, 0 AS step FROM formed
  UNION ALL SELECT l.word, f.form, step + 1 FROM leads l JOIN formed f ON f.word = l.goal WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, l.root, f.n, f.n_near, f.form_n
FROM formed f JOIN (SELECT word, arg_max(goal, step) AS root FROM leads GROUP BY word) l ON l.word = f.word
"""


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(table(spark, sf_dir, "embeddings"), k=40, rounds=5, scale=256, dims=64, seed="2")


def _op13_sql(k: int = 40, rounds: int = 5, scale: int = 256, dims: int = 64, seed: str = "2") -> str:
    """Every round is an assignment to the nearest centroid, by all distances, and the floors of means."""
    steps = [f"""
v AS MATERIALIZED (
  SELECT row_number() OVER () AS i, vec_id,
         list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')), e) - 1 AS c, e
  FROM v ORDER BY c LIMIT {k}
)"""]
    for t in range(rounds + 1):
        steps.append(f"""a{t} AS MATERIALIZED (
  SELECT i, arg_min(c, (d, c)) AS c, min(d) AS d
  FROM (SELECT v.i, m.c, list_sum(list_transform(list_zip(v.e, m.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d
        FROM v, c{t} AS m) GROUP BY i
)""")
        if t < rounds:
            steps.append(f"""s{t} AS (
  SELECT a.c, j, sum(v.e[j]) AS s, count(*) AS n
  FROM a{t} AS a JOIN v ON v.i = a.i, (SELECT unnest(range(1, {dims + 1})) AS j) GROUP BY a.c, j
), m{t} AS (
  SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS e FROM s{t} GROUP BY c
), c{t + 1} AS MATERIALIZED (
  SELECT c{t}.c, coalesce(m{t}.e, c{t}.e) AS e FROM c{t} LEFT JOIN m{t} ON m{t}.c = c{t}.c
)""")
    return f"""WITH {", ".join(steps)}
SELECT v.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance,
       CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(m.e, ',')) AS centroid_sha256
FROM a{rounds} AS a JOIN v ON v.i = a.i JOIN c{rounds} AS m ON m.c = a.c
"""


OP13_SQL = _op13_sql()


OPERATORS: dict[str, Query] = {
    "op1_url_filter": op1_url_filter,
    "op2_token_counts": op2_token_counts,
    "op3_exact_top_k": op3_exact_top_k,
    "op4_packing": op4_packing,
    "op5_hierarchical_pitman_yor": op5_hierarchical_pitman_yor,
    "op6_bpe_round_trip": op6_bpe_round_trip,
    "op7_license_scan": op7_license_scan,
    "op8_quality_rules": op8_quality_rules,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_ngram_jaccard": op10_ngram_jaccard,
    "op11_toxicity": op11_toxicity,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_centroid_clustering": op13_centroid_clustering,
}


def queries(pipeline) -> dict[str, Query]:
    return {**OPERATORS, "pipeline": pipeline.run}


def oracle_sql(pipeline) -> dict[str, str]:
    known = {"op3_exact_top_k": OP3_SQL, "op8_quality_rules": OP8_SQL, "op10_ngram_jaccard": OP10_SQL,
             "op12_spelling_variants": OP12_SQL, "op13_centroid_clustering": OP13_SQL}
    if pipeline.ORACLE_SQL is not None:
        known["pipeline"] = pipeline.ORACLE_SQL
    return known
