"""Registered queries of the training-data operators, with their oracle SQL where SQL can express them."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import checkpoint_root
from . import (
    alignment, jaccard_join, lexical_search, log_templates, metric_tree, packing, plane_store, quality, suffix_pieces, token_counts, toxicity, url_filters,
    warc_revisits,
)

BASE_VOCABULARY = "word_bpe_49k.json"
RANKS = "byte_bpe_50k.tiktoken"
PIECES = "piece_bpe_32k.model"
BYTES = "byte_bpe_50k.json"

_TOP_PRODUCTS = """
WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS x FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len([y for y in embedding if y IS NULL OR isnan(y) OR isinf(y)]) = 0),
q AS (SELECT vec_id AS query_id, unnest(x) AS a, generate_subscripts(x, 1) AS i FROM v WHERE vec_id % 50 = 0),
c AS (SELECT vec_id, unnest(x) AS b, generate_subscripts(x, 1) AS i FROM v),
s AS (SELECT query_id, vec_id, sum(a * b)::BIGINT AS score FROM q JOIN c USING (i) WHERE query_id <> vec_id GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

_REVISITS = r"""
WITH parts AS (
  SELECT *, regexp_extract(url, '^(?i:https?)://([^/?#]+)([^?#]*)(\?[^#]*)?', 1) AS host,
         regexp_extract(url, '^(?i:https?)://([^/?#]+)([^?#]*)(\?[^#]*)?', 2) AS path,
         regexp_extract(url, '^(?i:https?)://([^/?#]+)([^?#]*)(\?[^#]*)?', 3) AS ask FROM pages),
named AS (
  SELECT *, regexp_replace(regexp_replace(lower(host), ':(80|443)$', ''), '^www\.', '') AS site,
         list_sort([p for p in string_split(ltrim(ask, '?'), '&') if p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|fbclid|gclid|sessionid)(=|$)')]) AS kept
  FROM parts),
pages2 AS (
  SELECT *, site || regexp_replace(path, '/+$', '') || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canon FROM named),
responses AS (
  SELECT canon, 1700000000 + page_id * 60 AS at, 'r' || page_id AS id, md5(html) AS digest, length(html) AS n, '"' || md5(html) || '"' AS etag, 'day ' || page_id AS modified,
         ['content-type: text/html'] AS rest, 'etag: "' || md5(html) || '"' AS h_etag, 'last-modified: day ' || page_id AS h_modified FROM pages2 WHERE html IS NOT NULL
  UNION ALL
  SELECT site || '/robots.txt', 1700000000 + page_id * 60, 'h' || page_id, md5('rules ' || page_id), length('rules ' || page_id), '"' || ((page_id // 100) % 3) || '"', NULL,
         NULL, NULL, NULL FROM pages2 WHERE page_id % 100 = 0),
revisits AS (
  SELECT canon, 1700000000 + page_id * 60 + CASE WHEN page_id % 5 = 0 THEN -864000 ELSE 86400 END AS at, 'v' || page_id AS id,
         CASE WHEN page_id % 13 = 0 OR page_id % 11 = 0 THEN NULL WHEN page_id % 7 = 0 THEN '"other"' ELSE 'W/"' || md5(html) || '"' END AS etag,
         CASE WHEN page_id % 13 <> 0 AND page_id % 11 = 0 THEN 'day ' || page_id END AS modified, page_id FROM pages2
  UNION ALL
  SELECT site || '/robots.txt', 1700000000 + page_id * 60, 'h' || page_id, '"' || ((page_id // 100) % 3) || '"', NULL, page_id FROM pages2 WHERE page_id % 100 <> 0),
found AS (
  SELECT v.id AS record_id, v.canon AS url, v.at AS seconds, v.etag AS own, v.modified AS own_modified, v.page_id, r.id AS response, r.digest, r.n, r.etag, r.modified, r.rest, r.h_etag, r.h_modified,
         row_number() OVER (PARTITION BY v.id ORDER BY r.at DESC, r.id DESC, r.digest DESC) AS k
  FROM revisits v LEFT JOIN responses r ON r.canon = v.canon AND r.at < v.at),
judged AS (
  SELECT *, CASE WHEN response IS NULL THEN 'no_response'
                 WHEN own IS NOT NULL AND etag IS NOT NULL THEN CASE WHEN ltrim(own, 'W/') = etag THEN 'resolved' ELSE 'validator_mismatch' END
                 WHEN own_modified IS NOT NULL AND modified IS NOT NULL THEN CASE WHEN own_modified = modified THEN 'resolved' ELSE 'validator_mismatch' END
                 ELSE 'no_validator' END AS resolution FROM found WHERE k = 1)
SELECT record_id, url, seconds, resolution, CASE WHEN resolution = 'resolved' THEN response END AS response_id,
       CASE WHEN resolution = 'resolved' THEN digest END AS payload_digest, CASE WHEN resolution = 'resolved' THEN n END AS payload_length,
       CASE WHEN resolution <> 'resolved' THEN NULL
            WHEN record_id LIKE 'h%' THEN 'etag: ' || own || chr(10) || 'vary: ' || page_id
            WHEN own IS NOT NULL THEN h_modified || chr(10) || 'content-type: text/html' || chr(10) || 'etag: ' || own || chr(10) || 'cache-control: max-age=' || (page_id % 100)
            ELSE h_etag || chr(10) || 'content-type: text/html' || chr(10) || 'last-modified: ' || own_modified || chr(10) || 'cache-control: max-age=' || (page_id % 100) END AS headers
FROM judged
"""

_LEXICAL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL),
size AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
asked AS (SELECT item_id, term, count(*) AS times FROM (
            SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
held AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d) SEMI JOIN asked USING (term) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
            FROM (SELECT term, count(*) AS df FROM held GROUP BY term), size),
impacts AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))) AS impact
            FROM held JOIN weights USING (term), size),
scores AS (SELECT item_id, doc_id, sum(impact * times)::BIGINT AS score FROM impacts JOIN asked USING (term) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""

_HITS = ", ".join(f"('{t}', {k})" for k, terms in (("true", url_filters.STRICT), ("false", url_filters.SOFT)) for t in terms)
_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in url_filters.RULES)
_URLS = rf"""
WITH p AS (SELECT page_id, coalesce(url, '') AS u FROM pages),
parts AS (SELECT page_id, u, translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(u, '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM p),
rules(h, s, v) AS (VALUES {_RULES}),
fits AS (SELECT page_id, h || s AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || s) DESC) AS k
         FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s)),
vocabulary(term, strict) AS (VALUES {_HITS}),
hits AS (SELECT page_id, count(*) FILTER (WHERE strict)::INTEGER AS n_strict, count(*) FILTER (WHERE NOT strict)::INTEGER AS n_soft
         FROM p JOIN vocabulary ON regexp_matches(translate(u, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                  '(^|[\x00-\x60\x7B-\x7F])' || term || '([\x00-\x60\x7B-\x7F]|$)') GROUP BY page_id)
SELECT page_id, host, path, rule,
       coalesce(v, CASE WHEN coalesce(n_strict, 0) > 0 OR coalesce(n_soft, 0) > 1 THEN 'block' ELSE 'allow' END) AS verdict,
       coalesce(n_strict, 0) AS n_strict, coalesce(n_soft, 0) AS n_soft
FROM parts LEFT JOIN (SELECT * FROM fits WHERE k = 1) USING (page_id) LEFT JOIN hits USING (page_id)
"""

_LINE_FREQUENCY = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
b AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS l FROM d),
runs AS (SELECT t, w, unnest(range(1, len(w) - 6)) AS i FROM (SELECT DISTINCT t, w FROM b) WHERE len(w) >= 8),
named AS (SELECT t, i, array_to_string(w[i : i + 7], ' ') AS run FROM runs),
twice AS (SELECT t, i FROM (SELECT t, i, count(*) OVER (PARTITION BY t, run) AS c FROM named) WHERE c > 1),
steps AS (SELECT t, least(8, coalesce(lead(i) OVER (PARTITION BY t ORDER BY i) - i, 8)) AS n FROM twice),
repeated AS (SELECT t, sum(n)::BIGINT AS n_repeat_words FROM steps GROUP BY t),
measured AS (
  SELECT doc_id, host, t, len(w) AS n_words, coalesce(list_sum([length(x) for x in w]), 0)::BIGINT AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM b LEFT JOIN repeated USING (t)),
lines AS (SELECT host, t, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words,
                 trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '[^\p{L}0-9]+', ' ', 'g')) AS normal
          FROM (SELECT host, t, unnest(l) AS line FROM (SELECT DISTINCT host, t, l FROM b))),
hosts AS (SELECT host, count(DISTINCT t) AS host_docs FROM lines GROUP BY host),
frequent AS (SELECT host, normal FROM (SELECT host, normal, count(DISTINCT t) AS n FROM lines GROUP BY host, normal)
             JOIN hosts USING (host) WHERE n > 10 AND n > 0.05 * host_docs),
gone AS (SELECT host, t, sum(words)::BIGINT AS n FROM lines SEMI JOIN frequent USING (host, normal) GROUP BY host, t),
judged AS (
  SELECT m.*, coalesce(gone.n, 0) AS n_removed_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed
  FROM measured m LEFT JOIN gone USING (host, t))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_removed_words,
       NOT base_failed AND NOT (n_removed_words > 0 AND (n_words - n_removed_words < 20 OR n_words - n_removed_words < 0.5 * n_words)) AS kept
FROM judged
"""


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(docs: DataFrame) -> DataFrame:
    """Places of all pieces of the documents in sequences of 2,048 tokens."""
    return packing.pack_documents(docs, _vocabulary(BASE_VOCABULARY)).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(_table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    lengths = token_counts.encoded_lengths(_table(spark, sf_dir, "documents"), _vocabulary(RANKS), public_tokenizers.PATTERN)
    return token_counts.suffix_sums(token_counts.histogram(lengths))


def op9_plane_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{checkpoint_root(spark)}/strandgraph/planes-{uuid.uuid4().hex}"
    plane_store.write(_table(spark, sf_dir, "documents"), path, _vocabulary(BASE_VOCABULARY))
    return plane_store.read_checksums(spark, path)


def op5_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_words", "kept")


def op6_noisy_or_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(toxicity.training_rows(docs, _table(spark, sf_dir, "labels")))
    return toxicity.score_documents(docs.select("doc_id", "text"), model).select(
        "doc_id", (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_log_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = log_templates.drop_recurring(_table(spark, sf_dir, "documents").select("doc_id", "text"), **log_templates.RULE)
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "n_dropped_lines", F.length(text).cast("long").alias("n_chars_left"), F.md5(text).alias("text_md5"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_documents(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def captures(pages: DataFrame) -> DataFrame:
    """Archive records made of `pages`: each page's response, a later (or too early) revisit of it with matching,
    differing or missing validators, and a capture of its host's robots.txt, mostly a revisit."""
    page, second = F.col("page_id"), lambda s: F.timestamp_seconds(F.lit(1_700_000_000) + s)
    tag = F.concat(F.lit('"'), F.md5("html"), F.lit('"'))
    host_tag = F.concat(F.lit('"'), (F.floor(page / 100) % 3).cast("string"), F.lit('"'))
    pair = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
    number = lambda p: F.concat(F.lit(p), page.cast("string"))
    robots = F.concat(F.regexp_extract("url", "^[a-zA-Z]+://[^/?#]+", 0), F.lit("/robots.txt"))
    stored = F.array(pair("ETag", tag), pair("Last-Modified", number("day ")), pair("Content-Type", F.lit("text/html")), pair("Cache-Control", F.lit("no-cache")))
    shown = F.when(page % 13 == 0, F.array(pair("X-Seen", number("")))).when(page % 11 == 0, F.array(pair("last-modified", number("day ")))).otherwise(
        F.array(pair("etag", F.when(page % 7 == 0, F.lit('"other"')).otherwise(F.concat(F.lit("W/"), tag))), pair("Content-Length", F.lit("0"))))
    update = F.concat(shown, F.array(pair("cache-control", F.concat(F.lit("max-age="), (page % 100).cast("string")))))
    first = page % 100 == 0
    columns = ["record_id", "warc_type", "target_uri", "warc_date", "status", "headers", "payload"]
    kinds = [
        (number("r"), F.lit("response"), F.col("url"), second(page * 60), F.lit(200), stored, F.col("html")),
        (number("v"), F.lit("revisit"), F.col("url"), second(page * 60 + F.when(page % 5 == 0, -864_000).otherwise(86_400)), F.lit(304), update, F.lit(None).cast("string")),
        (number("h"), F.when(first, "response").otherwise("revisit"), robots, second(page * 60), F.when(first, 200).otherwise(304),
         F.array(pair("ETag", host_tag), pair("Vary", number(""))), F.when(first, number("rules "))),
    ]
    parts = [pages.select(*[c.alias(n) for n, c in zip(columns, kind)]) for kind in kinds]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.array_join(F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"])), "\n")
    return warc_revisits.resolve(captures(_table(spark, sf_dir, "pages"))).select(
        "record_id", "url", F.unix_timestamp("date").alias("seconds"), "resolution", "response_id", "payload_digest", "payload_length",
        text.alias("headers"))


def op4_suffix_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = _table(spark, sf_dir, "documents"), _vocabulary(PIECES)
    out = suffix_pieces.decode_documents(suffix_pieces.encode_documents(docs, path), path)
    return out.select("doc_id", "n_ids", "ids_crc32", F.md5("text").alias("decoded_md5"))


def op7_metric_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = metric_tree.integer_vectors(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return metric_tree.top_inner_products(vectors, F.col("id") % 50 == 0, 5)


def op11_impact_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_table(spark, sf_dir, "documents"), _vocabulary(BYTES), _vocabulary(PIECES))


def op13_url_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(_table(spark, sf_dir, "pages").select("page_id", "url")).drop("url", "terms")


QUERIES = {f.__name__: f for f in (
    op1_warc_revisits, op2_jaccard_join, op3_best_fit_packing, op4_suffix_pieces, op5_line_frequency, op6_noisy_or_toxicity,
    op7_metric_tree, op8_token_counts, op9_plane_store, op10_log_templates, op11_impact_lists, op12_token_alignment, op13_url_vocabulary)}
ORACLES = {"op1_warc_revisits": _REVISITS, "op5_line_frequency": _LINE_FREQUENCY, "op7_metric_tree": _TOP_PRODUCTS, "op11_impact_lists": _LEXICAL, "op13_url_vocabulary": _URLS}
