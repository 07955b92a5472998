"""The registered queries of the operators and the DuckDB texts of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from shelfwise.llm import (
    bpe,
    curves,
    decontaminate,
    neardup,
    negatives,
    packing,
    pii,
    prefixes,
    quality,
    ring,
    spotsigs,
    substrings,
    urls,
)
from shelfwise.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_near_duplicates(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), size=4)


@query
def op2_best_fit_packing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


@query
def op3_byte_bpe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return bpe.digest_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


@query
def op4_hilbert_neighbours(spark, sf_dir):
    return curves.nearest(table(spark, sf_dir, "embeddings"))


@query
def op5_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return urls.filter_urls(pages, urls.contract_rules(spark), urls.listed_sites(pages))


@query
def op6_substring_dedup(spark, sf_dir):
    return substrings.dedup_digest(table(spark, sf_dir, "documents"))


@query
def op7_spot_signatures(spark, sf_dir):
    return spotsigs.compare_neighbours(table(spark, sf_dir, "documents"))


@query
def op8_ring_shards(spark, sf_dir):
    return ring.shard_documents(table(spark, sf_dir, "documents"))


@query
def op9_personal_data(spark, sf_dir):
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


@query
def op10_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


@query
def op11_hard_negatives(spark, sf_dir):
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


@query
def op12_benchmark_hits(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.hit_report(docs, items)


@query
def op13_conversation_trie(spark, sf_dir):
    return prefixes.prefix_trie(table(spark, sf_dir, "conversations"))


ORACLES["op5_url_filter"] = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0
                       THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, coalesce(rest, '') AS rest FROM cut)
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/')
      THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/')
      THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/'
    END AS rule
  FROM split
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
  WHEN rule IS NOT NULL THEN 'allow'
  WHEN list_has_any(string_split(host, '.'),
    ['adult', 'adult-x', 'bets', 'free-bets', 'casino', 'poker', 'xxx']) THEN 'block'
  ELSE 'allow' END AS verdict
FROM ruled
"""

ORACLES["op1_near_duplicates"] = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
    lambda x: x <> '') AS words FROM documents
), shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 3], ' ') AS s
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, 2))) AS i
        FROM texts WHERE len(words) > 0)
), sizes AS MATERIALIZED (
  SELECT doc_id, count(s) AS n FROM documents LEFT JOIN shingles USING (doc_id) GROUP BY doc_id
), links AS MATERIALIZED (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM shingles x
                        JOIN shingles y USING (s) WHERE x.doc_id < y.doc_id GROUP BY ALL) p
  JOIN sizes m ON m.doc_id = p.a JOIN sizes n ON n.doc_id = p.b
  WHERE 100 * k >= 80 * (m.n + n.n - k)
), reach AS (
  SELECT doc_id AS id, doc_id AS other FROM sizes
  UNION
  SELECT r.id, CASE WHEN l.a = r.other THEN l.b ELSE l.a END
  FROM reach r JOIN links l ON l.a = r.other OR l.b = r.other
)
SELECT id AS doc_id, any_value(n) AS n_shingles, min(other) AS component_id, id = min(other) AS kept
FROM reach JOIN sizes ON doc_id = id GROUP BY id
"""

ORACLES["op6_substring_dedup"] = r"""
WITH texts AS MATERIALIZED (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'),
    lambda x: x <> '') AS words FROM documents
), windows AS (
  SELECT doc_id, i, row_number() OVER (
    PARTITION BY array_to_string(words[i:i + 19], ' ') ORDER BY doc_id, i) AS nth
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i
        FROM texts WHERE len(words) >= 20)
), gone AS MATERIALIZED (
  SELECT DISTINCT doc_id, i + k AS i FROM windows, range(0, 20) t(k) WHERE nth > 1
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM (
    SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM texts)
  ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
), lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, coalesce(n, 0) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM texts LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

ORACLES["op12_benchmark_hits"] = r"""
WITH texts AS MATERIALIZED (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'),
    lambda x: x <> '') AS words FROM documents
), asked AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'),
    lambda x: x <> '') AS words FROM benchmark
), windows AS MATERIALIZED (
  SELECT DISTINCT item_id, least(len(words), 10) AS n, array_to_string(words[i:i + 9], ' ') AS w
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 8, 2))) AS i
        FROM asked WHERE len(words) > 0)
), places AS MATERIALIZED (
  SELECT doc_id, n, i, array_to_string(words[i:i + n - 1], ' ') AS w
  FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i
        FROM texts, (SELECT DISTINCT n FROM windows) WHERE len(words) >= n)
), found AS MATERIALIZED (SELECT doc_id, i, n, item_id FROM places JOIN windows USING (n, w)),
hits AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM found, range(0, 10) t(k) WHERE k < n GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items
  FROM (SELECT DISTINCT doc_id, item_id FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM texts LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""

ORACLES["op11_hard_negatives"] = r"""
WITH taking AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
    list_dot_product(a.v, b.v)::BIGINT AS score
  FROM taking a JOIN taking b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, id, score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.id AS positive_id, p.score AS positive_score, n.id AS negative_id,
  n.score AS negative_score, (row_number() OVER w)::INT AS rank
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
  AND 80 * p.score <= 100 * n.score AND n.score <= p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id)
QUALIFY row_number() OVER w <= 5
"""

ORACLES["op13_conversation_trie"] = r"""
WITH RECURSIVE bits AS (
  SELECT i, i::BIGINT AS v, 0 AS k FROM range(256) t(i)
  UNION ALL
  SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8
), crc_table AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
turns AS MATERIALIZED (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos,
    coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS MATERIALIZED (
  SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM turns), crc_table
), parts AS (
  SELECT c.conv_id, 0 AS part, t.pos, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.pos <= c.h
  UNION ALL
  SELECT c.conv_id, 1, t.pos, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > c.h
), rebuilt AS MATERIALIZED (
  SELECT c.conv_id, list(sha256(length(p.role) || ':' || p.role || p.text) ORDER BY p.part, p.pos)
    FILTER (p.pos IS NOT NULL) AS s,
    list(p.text ORDER BY p.part, p.pos) FILTER (p.pos IS NOT NULL) AS texts
  FROM convs c LEFT JOIN parts p USING (conv_id) GROUP BY c.conv_id
), passing AS MATERIALIZED (
  SELECT conv_id, d, coalesce(array_to_string(s[1:d], ','), '') AS k,
    CASE WHEN d = 0 THEN NULL ELSE coalesce(array_to_string(s[1:d - 1], ','), '') END AS parent,
    d = coalesce(len(s), 0) AS ends, CASE WHEN d = 0 THEN '' ELSE texts[d] END AS text
  FROM (SELECT *, unnest(range(0, coalesce(len(s), 0) + 1)) AS d FROM rebuilt)
), nodes AS MATERIALIZED (
  SELECT k, any_value(d) AS depth, any_value(parent) AS parent, count(*) AS n_convs, min(conv_id) AS conv_id,
    len(regexp_extract_all(any_value(text), '[^\x20\x09-\x0D]+')) AS words,
    coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS ends
  FROM passing GROUP BY k
), children AS MATERIALIZED (SELECT parent AS k, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
up AS (
  SELECT n.k, n.k AS top, n.parent, CASE WHEN c.n IS NULL THEN 1 ELSE 0 END AS leaf, (n.n_convs - 1) * n.words AS saved
  FROM nodes n LEFT JOIN children c USING (k)
  UNION ALL
  SELECT u.k, p.k, p.parent, u.leaf, u.saved FROM up u JOIN nodes p ON p.k = u.parent
), sums AS (SELECT top AS k, sum(leaf)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM up GROUP BY top)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, s.n_leaves,
  s.saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n LEFT JOIN nodes p ON p.k = n.parent LEFT JOIN children c ON c.k = n.k JOIN sums s ON s.k = n.k
"""
