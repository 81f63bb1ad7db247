"""Registered queries of the text operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowloom.llm import (
    collocations,
    licenses,
    linededup,
    mixing,
    sentencepiece,
    simhash,
    sketch,
    spelling,
    substringdedup,
    suffixdedup,
    topk,
    toxicity,
    urlfilter,
)
from flowloom.llm.common import small_batches, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op10_toxicity")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.toxicity_scores(docs, model)


@query("op1_line_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    cleaned = linededup.dedup_lines(table(spark, sf_dir, "documents"), n_lines="n_lines", removed="removed_lines")
    return cleaned.select(
        "doc_id", "n_lines", F.size("removed_lines").alias("n_removed"), "removed_lines",
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


@query("op2_simhash")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


@query(
    "op3_source_mixing",
    """
WITH RECURSIVE rates AS (
  SELECT source, (SELECT count(*) FROM documents)::DOUBLE / ((SELECT count(*) FROM
    (SELECT DISTINCT source FROM documents)) * count(*)) AS rate
  FROM documents GROUP BY source
), steps AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM rates
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM steps WHERE k < 200
), drawn AS (
  SELECT doc_id, text, lang, source, n_chars,
    ('0x' || substr(md5('42:' || doc_id || ':1'), 1, 13))::BIGINT::DOUBLE / 4503599627370496 AS u
  FROM documents
), copies AS (
  SELECT d.doc_id, any_value(d.text) AS text, any_value(d.lang) AS lang, any_value(d.source) AS source,
    any_value(d.n_chars) AS n_chars, count(*) FILTER (s.c <= d.u) AS n
  FROM drawn d JOIN steps s ON d.source IS NOT DISTINCT FROM s.source GROUP BY d.doc_id
), repeated AS (
  SELECT doc_id, text, lang, source, n_chars, unnest(generate_series(1, n))::INTEGER AS copy FROM copies
)
SELECT *, substr(md5('42:order:' || doc_id || ':' || copy), 1, 16) AS shuffle_key FROM repeated
""",
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), copy="copy", key="shuffle_key")


@query("op4_sentencepiece")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    model = sentencepiece.compile_model()
    return sentencepiece.encode_documents(table(spark, sf_dir, "documents"), model)


@query("op6_suffix_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    cleaned = suffixdedup.remove_repeats(table(spark, sf_dir, "documents"))
    return cleaned.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


@query("op5_document_fingerprints")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.document_fingerprints(table(spark, sf_dir, "documents"))


@query("op7_url_filters", urlfilter.filter_sql())
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(table(spark, sf_dir, "pages"))


@query(
    "op8_topk_search",
    """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


@query("op9_license_scan")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licenses.license_scan(docs, licenses.fit(docs))


LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op11_collocations",
    f"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(regexp_split_to_array({LOWER.format("text")}, '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p
), g AS (
  SELECT lang, k, unnest(list_transform(generate_series(1, len(w) - k + 1), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM w, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k
), f AS (
  SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM g GROUP BY ALL
), n AS (
  SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
), c AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10
), cuts AS (
  SELECT c.lang, c.k, c.phrase, c.a, i, x.f AS l, y.f AS r, (1000000 * a * a) // (x.f * y.f) AS score
  FROM (SELECT *, unnest(generate_series(1, k - 1)) AS i FROM c) c
  JOIN f x ON x.lang = c.lang AND x.k = i AND x.phrase = array_to_string(w[1:i], ' ')
  JOIN f y ON y.lang = c.lang AND y.k = c.k - i AND y.phrase = array_to_string(w[i + 1:], ' ')
), s AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1
), longer AS (
  SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM c WHERE k = 3
), kept AS (
  SELECT s.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM s
  WHERE NOT EXISTS (SELECT 1 FROM longer o WHERE o.lang = s.lang AND o.phrase = s.phrase AND 100 * o.a >= 50 * s.a)
)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM kept JOIN n USING (lang) WHERE rank <= 2000
""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query(
    "op12_substring_dedup",
    """
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM d)
), first AS (
  SELECT h, min(doc_id) AS first FROM win GROUP BY h
), gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS i FROM win JOIN first USING (h) WHERE doc_id > first
), lost AS (
  SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id
), kept AS (
  SELECT doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN lost USING (doc_id)
)
SELECT doc_id, len(w)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed,
  sha256(array_to_string(list_filter(w, lambda x, i: NOT list_contains(gone, i)), ' ')) AS kept_sha256
FROM kept
""",
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    cleaned = substringdedup.remove_earlier_strings(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query(
    "op13_spelling_variants",
    f"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t
  FROM (SELECT unnest(generate_series(0::BIGINT, 255::BIGINT)) AS i)
), runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all({LOWER.format("text")}, '[A-Za-zÀ-ÿ]+')) AS run FROM documents
  ) WHERE length(run) >= 7 GROUP BY ALL
), bytes AS (
  SELECT doc_id, run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM runs
), hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(generate_series(1, length(x), 2), lambda i: ('0x' || x[i:i + 1])::BIGINT)),
    lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295::BIGINT) AS h
  FROM bytes, crc
), cut AS (
  SELECT n, CASE WHEN h % 31 = 0 THEN run[:(h % length(run))] || run[(h % length(run)) + 2:] ELSE run END AS word FROM hashed
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), less AS (
  SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest FROM (SELECT *, unnest(generate_series(1, length(word))) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS form, max(other_n) AS form_n FROM near GROUP BY word
), told AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * w.n THEN form END AS form,
    CASE WHEN form_n >= 10 * w.n THEN form_n END AS form_n
  FROM words w LEFT JOIN best USING (word)
), chain AS (
  SELECT word, word AS root, form AS next FROM told
  UNION ALL
  SELECT c.word, t.word, t.form FROM chain c JOIN told t ON c.next = t.word
)
SELECT t.word, t.form, c.root, t.n, t.n_near, t.form_n FROM told t JOIN chain c ON c.word = t.word AND c.next IS NULL
""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))
