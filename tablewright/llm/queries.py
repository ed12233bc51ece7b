"""The registered queries of the training-data operators: each applied to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewright.llm import bpe, conversations, divergence, hamming_search, licenses, personal_data, quality, toxicity
from tablewright.llm.line_duplicates import dedup_lines
from tablewright.llm.main_text import extract
from tablewright.llm.near_duplicates import near_duplicates
from tablewright.llm.packing import pack
from tablewright.llm.vectors import near_equal

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark, sf_dir):
    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_minhash(spark, sf_dir):
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op3_personal_data(spark, sf_dir):
    return personal_data.find(_table(spark, sf_dir, "documents"))


def _held_out():
    """A fifth of the documents, whose labels nothing learns from."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0


def op4_toxicity(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").where(~_held_out())
    model = toxicity.fit(docs.withColumnRenamed("doc_id", "id"), labels.select(F.col("doc_id").alias("id"), "toxic"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", F.coalesce(_held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_main_text(spark, sf_dir):
    return extract(_table(spark, sf_dir, "pages"))


def op6_licenses(spark, sf_dir):
    """Documents as files of a tree source/lang; a text that is mostly license lines is the licence file of its folder."""
    docs = _table(spark, sf_dir, "documents")
    file = F.concat(F.when(licenses.mostly_license(F.col("text")), F.lit("LICENSE-")).otherwise(F.lit("")), F.col("doc_id").cast("string"), F.lit(".txt"))
    tree = docs.select("doc_id", F.concat_ws("/", "source", "lang", file).alias("path"), "text")
    return licenses.scan(tree, "path", "text")


def op7_vectors(spark, sf_dir):
    return near_equal(_table(spark, sf_dir, "embeddings"))


def op8_lines(spark, sf_dir):
    """Per document what line deduplication leaves: counts and the text."""
    return dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")


def op9_top_k(spark, sf_dir):
    """The ten nearest sign codes of every vector whose id is divisible by 50, among all vectors."""
    codes = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), hamming_search.sign_code("embedding").alias("code"))
    return hamming_search.top_k(codes, codes.where("id % 50 = 0"), 10)


def op10_bpe(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(_table(spark, sf_dir, "documents").select("doc_id", "text"), path)


def op11_quality(spark, sf_dir):
    judged = quality.judge(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return judged.select("doc_id", *quality.COUNTS, "base_failed", "kept")


def op12_divergence(spark, sf_dir):
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op13_conversations(spark, sf_dir):
    return conversations.repair(conversations.damage(_table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Query] = {
    "op1_packing": op1_packing,
    "op2_minhash": op2_minhash,
    "op3_personal_data": op3_personal_data,
    "op4_toxicity": op4_toxicity,
    "op5_main_text": op5_main_text,
    "op6_licenses": op6_licenses,
    "op7_vectors": op7_vectors,
    "op8_lines": op8_lines,
    "op9_top_k": op9_top_k,
    "op10_bpe": op10_bpe,
    "op11_quality": op11_quality,
    "op12_divergence": op12_divergence,
    "op13_conversations": op13_conversations,
}


def _quality_sql() -> str:
    """The rules with thresholds from the same histograms: they are exact counts, whatever the order of merging."""
    measures = {m: f"coalesce(({top} * 10000) // nullif({below} + {more}, 0), 0)" for m, (top, below, more, _, _) in quality.MEASURES.items()}
    values = " UNION ALL ".join(f"SELECT r, lang, source, '{m}' AS measure, {e} AS v, {quality.MEASURES[m][3]} AS least, {quality.MEASURES[m][4]} AS low_counts FROM c" for m, e in measures.items())

    def level(i: int, keys: str) -> str:
        by = f"{keys}, " if keys else ""
        return f"""
        s{i} AS (SELECT {by}measure, bin, count(*) AS n FROM b GROUP BY ALL),
        t{i} AS (SELECT {by}measure, bin, sum(n) OVER (PARTITION BY {by}measure ORDER BY bin) AS reached, sum(n) OVER (PARTITION BY {by}measure) AS rows FROM s{i}),
        q{i} AS (SELECT {by}measure, any_value(rows) AS rows, min(bin) FILTER (WHERE 4 * reached >= rows) AS quartile, min(bin) FILTER (WHERE 2 * reached >= rows) AS median FROM t{i} GROUP BY ALL)"""

    picked = {c: f"CASE WHEN q0.rows >= {quality.MIN_ROWS} THEN q0.{c} WHEN q1.rows >= {quality.MIN_ROWS} THEN q1.{c} ELSE q2.{c} END" for c in ("quartile", "median")}
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
         w AS (SELECT *, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
                      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
         i AS (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w),
         x AS (SELECT r, i, count(*) OVER (PARTITION BY r, array_to_string(w[i:i + 4], ' ')) AS times FROM i),
         y AS (SELECT r, least(5, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 5)) AS n FROM x WHERE times > 1),
         z AS (SELECT r, CAST(sum(n) AS BIGINT) AS n FROM y GROUP BY r),
         c AS (SELECT r, doc_id, lang, source, len(w) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
                      CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                      CAST(length(regexp_replace(t, '[^A-Z]', '', 'g')) AS BIGINT) AS n_capitals, len(l) AS n_lines,
                      len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(z.n, 0) AS n_repeat_words
               FROM w LEFT JOIN z USING (r)),
         v AS ({values}),
         b AS (SELECT *, (v >> greatest(len(bin(v)) - {quality.BITS}, 0)) << greatest(len(bin(v)) - {quality.BITS}, 0) AS bin FROM v),
         {level(0, "lang, source")}, {level(1, "lang")}, {level(2, "")},
         h AS (SELECT v.r, bool_and(v.v <= m + {quality.REACH} * greatest(m - q, least) AND (NOT low_counts OR v.v >= m - {quality.REACH} * greatest(m - q, least))) AS fine
               FROM (SELECT v.*, {picked["median"]} AS m, {picked["quartile"]} AS q FROM v
                     JOIN q0 ON q0.lang IS NOT DISTINCT FROM v.lang AND q0.source IS NOT DISTINCT FROM v.source AND q0.measure = v.measure
                     JOIN q1 ON q1.lang IS NOT DISTINCT FROM v.lang AND q1.measure = v.measure JOIN q2 ON q2.measure = v.measure) v
               GROUP BY v.r)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
           n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
           NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND fine AS kept
    FROM c JOIN h USING (r)
    """


DIVERGENCE = """
    WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
         o AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
         k AS (SELECT lang, term, count(*) AS n FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
         l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
         g AS (SELECT lang, source, coalesce(l.v, 0) AS v FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN l USING (lang)),
         c AS (SELECT o.lang, o.source, o.term, count(*) AS n FROM o SEMI JOIN k USING (lang, term) GROUP BY ALL),
         t AS (SELECT g.*, coalesce((SELECT sum(n) FROM c WHERE c.lang = g.lang AND c.source = g.source), 0) AS total FROM g),
         p AS (SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n,
                      1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (t.total + t.v) AS p,
                      1 + (1000000000::HUGEINT * (k.n + 1)) // (l.total + l.v) AS q
               FROM t JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
         pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce((
                          SELECT sum(((x.p - y.p) * (x.p - y.p)) // y.p) FROM p x JOIN p y ON y.lang = x.lang AND y.term = x.term
                          WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
                   FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
         terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // q AS value FROM p WHERE n > 0 AND p > q),
         f AS (SELECT *, 'pair' AS part FROM pairs UNION ALL SELECT *, 'term' AS part FROM terms),
         ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM f)
    SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""

# Results in SQL, where SQL can express them.
ORACLE: dict[str, str] = {
    "op11_quality": _quality_sql(),
    "op12_divergence": DIVERGENCE,
    "op9_top_k": """
        WITH pairs AS (
            SELECT q.vec_id AS query_id, d.vec_id AS neighbor_id,
                   CAST(list_sum(list_transform(range(1, 65), lambda i: CAST((q.embedding[i] > 0) <> (d.embedding[i] > 0) AS INTEGER))) AS INTEGER) AS distance
            FROM embeddings q JOIN embeddings d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, neighbor_id, distance
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM pairs)
        WHERE rank <= 10
    """,
}
