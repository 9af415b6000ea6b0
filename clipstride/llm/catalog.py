"""The queries of the operators, by contract name, and the SQL of those that SQL can say."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from clipstride.llm import (
    block_max,
    bpe,
    collocations,
    context_mixing,
    html_text,
    language_id,
    packing,
    quality_ranking,
    quality_rules,
    simhash,
    substring_dedup,
    tensored_minhash,
    topk_search,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, *tables: str, sql: str | None = None):
    """Register a function of whole tables, of ``documents`` if none is named."""

    def register(fn: Callable[..., DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(*[spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables or ("documents",)])
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


@query("op1_quality_rules", sql=r"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS body,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
lined AS (
  SELECT *, len(words) AS n,
         list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
         list_transform(range(1, greatest(len(words) - 3, 1)), lambda i: array_to_string(words[i:i + 4], ' ')) AS windows
  FROM split),
placed AS (
  SELECT doc_id, unnest(windows) AS w, unnest(range(1, len(windows) + 1)) AS place FROM lined
  WHERE len(list_distinct(windows)) < len(windows)),
twice AS (
  SELECT doc_id, place FROM placed QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1),
gaps AS (
  SELECT doc_id, least(5, coalesce(lead(place) OVER (PARTITION BY doc_id ORDER BY place) - place, 5)) AS g FROM twice),
repeated AS (SELECT doc_id, sum(g)::BIGINT AS n_repeat_words FROM gaps GROUP BY doc_id),
measures AS (
  SELECT l.doc_id, n::BIGINT AS n_words,
         length(regexp_replace(body, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(body, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(lines)::BIGINT AS n_lines,
         length(regexp_replace(body, '[^\p{Lu}]+', '', 'g'))::BIGINT AS n_upper,
         length(regexp_replace(body, '[^!]+', '', 'g'))::BIGINT AS n_bangs
  FROM lined l LEFT JOIN repeated r USING (doc_id)),
rules AS (
  SELECT *,
    (CASE WHEN n_words < 10 THEN 1 ELSE 0 END
     + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
     + CASE WHEN 100 * n_symbols > 25 * n_words THEN 4 ELSE 0 END
     + CASE WHEN n_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END
     + CASE WHEN n_words > 0 AND word_chars < 2 * n_words THEN 16 ELSE 0 END
     + CASE WHEN word_chars > 16 * n_words THEN 32 ELSE 0 END
     + CASE WHEN 100 * n_upper > 50 * word_chars THEN 64 ELSE 0 END
     + CASE WHEN 100 * n_bangs > 30 * n_words THEN 128 ELSE 0 END)::BIGINT AS fail_bits
  FROM measures)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits
FROM rules""")
def op1(docs: DataFrame) -> DataFrame:
    return quality_rules.judged(docs.select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")


@query("op10_simhash_near_dedup")
def op10(docs: DataFrame) -> DataFrame:
    return simhash.near_copies(docs)


@query("op2_topk_search", "embeddings", sql="""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q::DOUBLE[], b.q::DOUBLE[])::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM pairs QUALIFY rank <= 5""")
def op2(embeddings: DataFrame) -> DataFrame:
    rows = topk_search.usable(embeddings)
    return topk_search.search(rows, rows.where("vec_id % 50 = 0"))


@query("op3_substring_dedup", sql=r"""
WITH split AS (
  SELECT row_number() OVER () AS row, doc_id,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
windows AS (
  SELECT row, unnest(range(1, len(words) - 33)) AS start, unnest(list_transform(
           range(1, len(words) - 33), lambda i: array_to_string(words[i:i + 34], ' '))) AS w
  FROM split WHERE len(words) >= 35),
twice AS (SELECT row, start FROM windows QUALIFY count(*) OVER (PARTITION BY w) > 1),
covered AS (SELECT DISTINCT row, start + o AS place FROM twice, (SELECT unnest(range(35)) AS o)),
worded AS (SELECT row, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM split),
kept AS (
  SELECT row, string_agg(word, ' ' ORDER BY place) AS rest, count(*) AS n
  FROM worded ANTI JOIN covered USING (row, place) GROUP BY row)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(rest, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (row)""")
def op3(docs: DataFrame) -> DataFrame:
    return substring_dedup.digests(docs)


@query("op4_language_id")
def op4(docs: DataFrame) -> DataFrame:
    return language_id.predictions(docs)


@query("op5_packing")
def op5(docs: DataFrame) -> DataFrame:
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json")).drop("ids")


@query("op6_lm_scoring")
def op6(docs: DataFrame) -> DataFrame:
    return context_mixing.scored(docs)


@query("op7_bpe_round_trip")
def op7(docs: DataFrame) -> DataFrame:
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


@query("op8_html_text", "pages")
def op8(pages: DataFrame) -> DataFrame:
    return html_text.extracted(pages)


@query("op9_quality_classifier", "documents", "labels")
def op9(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return quality_ranking.predictions(docs, labels)


@query("op11_phrase_collocations", sql=r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
split AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
runs AS (
  SELECT lang, unnest(list_concat(
           w, list_transform(range(1, greatest(len(w), 1)), lambda i: array_to_string(w[i:i + 1], ' ')),
           list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: array_to_string(w[i:i + 2], ' ')))) AS phrase
  FROM split),
f AS (SELECT lang, phrase, count(*) AS f, len(string_split(phrase, ' ')) AS size FROM runs GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
cuts AS (
  SELECT lang, phrase, f AS a, size, unnest(range(1, size)) AS k, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= 10),
scored AS (
  SELECT c.lang, c.phrase, a, c.size, k, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[:k], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[k + 1:], ' ')),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM cuts WHERE size = 3 AND k = 1),
held AS (SELECT lang, phrase, max(a) AS longest FROM longer GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM lowest LEFT JOIN held USING (lang, phrase) JOIN totals USING (lang)
WHERE longest IS NULL OR 100 * longest < 50 * a
QUALIFY rank <= 2000""")
def op11(docs: DataFrame) -> DataFrame:
    return collocations.collocations(docs)


@query("op12_lexical_search", "documents", "benchmark", sql=r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents WHERE text IS NOT NULL),
totals AS (SELECT count(*) FILTER (len(w) > 0)::BIGINT AS nd, coalesce(sum(len(w)), 0)::BIGINT AS nt FROM docs),
post AS (SELECT row, term, count(*)::BIGINT AS tf FROM (SELECT row, unnest(w) AS term FROM docs) GROUP BY ALL),
held AS (SELECT term, count(*)::BIGINT AS df FROM post GROUP BY term),
asked AS (
  SELECT item_id, unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark WHERE text IS NOT NULL),
q AS (
  SELECT item_id, term, count(*)::BIGINT AS times, any_value(floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)))::BIGINT) AS weight
  FROM asked JOIN held USING (term), totals GROUP BY item_id, term),
scored AS (
  SELECT item_id, row, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(w) * nd) // nt))))::BIGINT AS score
  FROM q JOIN post USING (term) JOIN docs USING (row), totals GROUP BY item_id, row)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scored JOIN docs USING (row) WHERE score > 0 QUALIFY rank <= 20""")
def op12(docs: DataFrame, items: DataFrame) -> DataFrame:
    return block_max.search(block_max.index(docs), items)


@query("op13_minhash_near_dedup")
def op13(docs: DataFrame) -> DataFrame:
    return tensored_minhash.near_copies(docs)


def load() -> None:
    """Register the pipeline too; it lies beside the package."""
    import corpus_pipeline

    QUERIES["pipeline"] = corpus_pipeline.run
    if corpus_pipeline.ORACLE_SQL is not None:
        SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
