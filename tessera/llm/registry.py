"""Queries of the numbered operators: each applies its operator, with production parameters, to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import table


def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from tessera.llm.packing import pack_documents

    return pack_documents(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tessera.llm.mixing import TARGETS, mix

    rows = mix(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return rows.select("doc_id", "tokens", *[F.element_at("p", i + 1).alias(f"p_{d}") for i, d in enumerate(sorted(TARGETS))], "rate", "copies")


def op3_topk(spark: SparkSession, folder: str) -> DataFrame:
    from tessera.llm.topk import exact_topk, integer_vectors

    return exact_topk(integer_vectors(table(spark, folder, "embeddings")), "vec_id % 20 = 0", 20)


def op4_language(spark: SparkSession, folder: str) -> DataFrame:
    from tessera.llm.language import identify_held_out

    return identify_held_out(table(spark, folder, "documents"))


def op5_substrings(spark: SparkSession, folder: str) -> DataFrame:
    from tessera.llm.substrings import removal_digest

    return removal_digest(table(spark, folder, "documents"))


def op6_sharding(spark: SparkSession, folder: str) -> DataFrame:
    from tessera.llm.sharding import shard_documents

    return shard_documents(table(spark, folder, "documents"))


def op7_media(spark: SparkSession, folder: str) -> DataFrame:
    from tessera.llm.media import media_rows

    return media_rows(table(spark, folder, "documents"))


def op8_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    from tessera.llm.nearjoin import near_duplicates

    return near_duplicates(table(spark, folder, "documents"))


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    from tessera.llm.toxicity import toxicity_held_out

    return toxicity_held_out(table(spark, folder, "documents"), table(spark, folder, "labels"))


RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def op10_urls(spark: SparkSession, folder: str) -> DataFrame:
    from tessera.llm.urlrules import judge_urls, rule_table

    return judge_urls(table(spark, folder, "pages").select("page_id", "url"), rule_table(spark, RULES)).drop("url")


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    from tessera.llm.whitening import whitened_components

    return whitened_components(table(spark, folder, "embeddings"))


def op12_trie(spark: SparkSession, folder: str) -> DataFrame:
    from tessera.llm.trie import conversation_trie

    return conversation_trie(table(spark, folder, "conversations"))


def op13_quality(spark: SparkSession, folder: str) -> DataFrame:
    from tessera.llm.quality import quality_verdicts

    return quality_verdicts(table(spark, folder, "documents"), table(spark, folder, "labels"))


QUERIES = {"op1_packing": op1_packing, "op2_mixing": op2_mixing, "op3_topk": op3_topk, "op4_language": op4_language, "op5_substrings": op5_substrings, "op6_sharding": op6_sharding, "op7_media": op7_media, "op8_jaccard": op8_jaccard, "op9_toxicity": op9_toxicity, "op10_urls": op10_urls, "op11_whitening": op11_whitening, "op12_trie": op12_trie, "op13_quality": op13_quality}

OP3_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
) SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

OP5_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), b AS (
  SELECT r, doc_id, 500 * j AS base, substr(h, 1000 * j + 1, 1098) AS h FROM (SELECT r, doc_id, h, unnest(range((length(h) + 999) // 1000)) AS j FROM d)
), w AS (
  SELECT r, doc_id, base + i AS i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT r, doc_id, base, h, unnest(range(least(500, length(h) // 2 - 49))) AS i FROM b)
), m AS (
  SELECT s, min(doc_id) AS least FROM w GROUP BY s
), gone AS (
  SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 50 THEN 0 ELSE 1 END AS opens FROM w JOIN m USING (s) WHERE least < doc_id
), spans AS (
  SELECT r, min(i) AS low, max(i) + 50 AS high FROM (SELECT r, i, sum(opens) OVER (PARTITION BY r ORDER BY i) AS span FROM gone) GROUP BY r, span
), cut AS (
  SELECT r, low, high, coalesce(lag(high) OVER (PARTITION BY r ORDER BY low), 0) AS kept_from FROM spans
), kept AS (
  SELECT r, string_agg(substr(h, 2 * kept_from + 1, 2 * (low - kept_from)), '' ORDER BY low) || substr(any_value(h), 2 * max(high) + 1) AS k, sum(high - low) AS removed, count(*) AS n
  FROM cut JOIN d USING (r) GROUP BY r
) SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
  FROM d LEFT JOIN kept USING (r)
"""

OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\x{80}-\x{10FFFF}]+') AS words FROM documents WHERE doc_id IS NOT NULL
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))
                                      WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingle FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE k / (x.n + y.n - k) >= 0.8
), reach AS (
  SELECT doc_id AS id, doc_id AS other FROM documents UNION SELECT id, b FROM reach JOIN links ON other = a
), class AS (
  SELECT id, min(other) AS class_id FROM reach GROUP BY id
), degree AS (
  SELECT a, count(*) AS n_links FROM links GROUP BY a
) SELECT doc_id, class_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links FROM documents LEFT JOIN class ON id = doc_id LEFT JOIN degree ON a = doc_id
"""

OP10_SQL = """
WITH r(verdict, rhost, rpath) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
p AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), q AS (
  SELECT row_number() OVER () AS i, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p
), m AS (
  SELECT i, page_id, host, path, rhost || rpath AS rule, verdict, row_number() OVER (PARTITION BY i ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS n
  FROM q LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
) SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE n = 1
"""

OP12_SQL = """
WITH ids AS (
  SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL
), sums AS (
  SELECT c, list_reduce(list_transform(range(1, length(CAST(c AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(c AS VARCHAR), CAST(i AS INTEGER), 1)) AS BIGINT)),
    lambda crc, b: list_reduce(range(8), lambda y, z: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384) ELSE y // 2 END, xor(crc, b)), 4294967295) AS crc FROM ids
), heads AS (
  SELECT c, c - c % 5 AS base, xor(crc, 4294967295) % 9 AS h FROM sums
), t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, ''))) AS rank,
         struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) AS said FROM conversations WHERE conv_id IS NOT NULL
), rebuilt AS (
  SELECT c, 0 AS own, rank, said FROM heads JOIN (SELECT c AS base, rank, said FROM t) USING (base) WHERE rank <= h
  UNION ALL SELECT c, 1, rank, said FROM heads JOIN t USING (c) WHERE rank > h
), whole AS (
  SELECT c, coalesce(list(said ORDER BY own, rank) FILTER (WHERE said IS NOT NULL), []) AS said FROM ids LEFT JOIN rebuilt USING (c) GROUP BY c
), prefixes AS (
  SELECT c, d, said[:d] AS prefix, d = len(said) AS ends FROM (SELECT c, said, unnest(range(len(said) + 1)) AS d FROM whole)
), named AS (
  SELECT c, d, ends, prefix, min(c) OVER (PARTITION BY d, prefix) AS node FROM prefixes
), nodes AS (
  SELECT node, d, count(*) AS n, coalesce(sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends)), sha256('')) AS ends_sha256,
         (count(*) - 1) * CASE WHEN d > 0 THEN octet_length(encode(any_value(prefix)[d].text)) ELSE 0 END AS saved FROM named GROUP BY node, d
), parents AS (
  SELECT m.node, m.d, p.node AS parent FROM nodes m JOIN named p ON p.c = m.node AND p.d = m.d - 1
), kids AS (
  SELECT parent AS node, d - 1 AS d, count(*) AS n_children FROM parents GROUP BY ALL
), subtrees AS (
  SELECT a.node, a.d, sum(m.saved) AS saved_tokens, count(*) FILTER (WHERE k.node IS NULL) AS n_leaves
  FROM nodes m JOIN named a ON a.c = m.node AND a.d <= m.d LEFT JOIN kids k ON k.node = m.node AND k.d = m.d GROUP BY ALL
) SELECT node AS conv_id, CAST(d AS BIGINT) AS depth, parent AS parent_conv_id, n AS n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
  FROM nodes JOIN subtrees USING (node, d) LEFT JOIN parents USING (node, d) LEFT JOIN kids USING (node, d)
"""

ORACLES: dict[str, str] = {"op3_topk": OP3_SQL, "op5_substrings": OP5_SQL, "op8_jaccard": OP8_SQL, "op10_urls": OP10_SQL, "op12_trie": OP12_SQL}
