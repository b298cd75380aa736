"""Queries of the subpackage and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm import chat_format, decontaminate, embedding_dedup, license_scan, mixing, quality, simhash_dedup, suffix_dedup, url_filter, warc


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_t(spark, sf_dir, "embeddings"), threshold=0.98)


URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(_t(spark, sf_dir, "documents"), length=50)


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _t(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (F.col("toxic") == 1).alias("blocked"))
    return url_filter.judge(_t(spark, sf_dir, "pages").select("page_id", "url"), labels, URL_RULES)


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = _t(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_format.read_back(chat_format.segments(turns))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_t(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("row.doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(_t(spark, sf_dir, "documents"), radius=4, shingle=4)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_t(spark, sf_dir, "pages"), least=1000)


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_t(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark"))


QUERIES = [op5_warc, op2_suffix_array_dedup, op6_license_scans, op7_quality_classifier, op10_benchmark_decontamination, op1_embedding_near_dedup, op3_url_filters, op4_chat_formatting, op8_source_mixing, op9_simhash_near_dedup]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


OP1_SQL = """
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
       AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b
          ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
          WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (
  WITH RECURSIVE r(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM r JOIN links l ON r.b = l.a)
  SELECT a, min(b) AS low FROM r GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(v.vec_id, coalesce(reach.low, v.vec_id)) AS component_id,
       v.vec_id = least(v.vec_id, coalesce(reach.low, v.vec_id)) AS kept, v.label
FROM v LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON n.a = v.vec_id
LEFT JOIN reach ON reach.a = v.vec_id
"""


OP4_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, regexp_replace(regexp_replace(replace(text, '␛', '␛␛'),
    '(<)((?:[|]turn[|]>)|(?:[|]text[|]>)|(?:[|]end[|]>)|(?:s>)|(?:/s>)|(?:<SYS>>)|(?:</SYS>>)|(?:[|]im_start[|]>)|(?:[|]im_end[|]>)|(?:[|]endoftext[|]>)|(?:[|]system[|]>)|(?:[|]user[|]>)|(?:[|]assistant[|]>)|(?:[|]begin_of_text[|]>)|(?:[|]eot_id[|]>)|(?:[|]start_header_id[|]>)|(?:[|]end_header_id[|]>))',
    '\\1␛\\2', 'g'), '(\\[)((?:INST\\])|(?:/INST\\]))', '\\1␛\\2', 'g') AS body FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, body)) AS turns_sha256,
  count(*) FILTER (role = 'assistant') AS n_examples,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, body) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(role) + length(body) + 23)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

# No URL token goes with the labels of the test tables, so mined rules judge no page; planted labels are tested apart.
OP3_SQL = """
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(rule, verdict, h, p) AS (VALUES ('com/', 'allow', 'com', '/'), ('example.com/en/', 'block', 'example.com', '/en/'),
  ('www.example.com/en/', 'allow', 'www.example.com', '/en/'), ('net/es/', 'block', 'net', '/es/'), ('net/fr/', 'block', 'net', '/fr/'))
SELECT page_id, host, path, r.rule, coalesce(r.verdict, 'allow') AS verdict, NULL::VARCHAR AS mined_items, NULL::DOUBLE AS mined_confidence
FROM u LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(r.rule) DESC NULLS LAST) = 1
"""

OP5_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to FROM m
"""

OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('8|' || coalesce(doc_id::VARCHAR, 'null|' || md5(text), 'null')) AS ord, md5(text) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS rank FROM s),
w AS (SELECT *, (((rank - 1) % 3) + 1)::DOUBLE AS weight, 3.0::DOUBLE * source_size AS cap FROM r),
l AS (SELECT *, cap / weight AS level, sum(source_size) OVER () AS total FROM w),
f AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY level, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY level, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM l),
g AS (SELECT *, max(CASE WHEN share <= level THEN share END) OVER () AS fill FROM f),
p AS (SELECT source, source_size, least(cap, coalesce(fill * weight, cap)) AS target FROM g),
q AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM p),
x AS (SELECT *, round(target - whole * source_size)::BIGINT AS extra FROM q),
o AS (SELECT d.*, x.source_size, x.target, x.whole, x.extra,
        coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.ord, d.size, d.h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source)
SELECT doc_id, size, source_size, round(target, 6) AS target, (whole * size + greatest(0, least(size, extra - before)))::BIGINT AS taken FROM o
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_embedding_near_dedup": OP1_SQL, "op3_url_filters": OP3_SQL, "op4_chat_formatting": OP4_SQL, "op5_warc": OP5_SQL, "op8_source_mixing": OP8_SQL}
