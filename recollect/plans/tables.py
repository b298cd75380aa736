"""Memory tables derived from the driver's tables by fixed expressions, for queries and their DuckDB twins.

`TABLES` are SQL bodies that both engines read; timestamps are without time zone. `frames` builds the same tables as
DataFrames, so operators only ever see schemas of the memory model.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.operators import retrieval as rt

NOW = "2024-02-10 00:00:00"
BASE = "2024-01-01 00:00:00"


def _hours(n: str) -> str:
    """BASE plus n hours; @h is replaced per engine."""
    return f"@h({n})"


FACTS = f"""
SELECT d.doc_id AS id, d.text AS content, @sha(d.text) AS content_hash, e.embedding AS embedding,
  CASE d.doc_id % 3 WHEN 0 THEN 'Episodic' WHEN 1 THEN 'Semantic' ELSE 'Procedural' END AS fact_type,
  {_hours('d.doc_id % 960')} AS t_created,
  CASE WHEN d.doc_id % 11 = 0 THEN {_hours('d.doc_id % 960 + 48')} END AS t_expired,
  CASE WHEN d.doc_id % 4 <> 0 THEN {_hours('(d.doc_id * 2) % 1900')} END AS t_valid,
  CASE WHEN d.doc_id % 7 = 0 THEN {_hours('(d.doc_id * 2) % 1900 + 300')} END AS t_invalid,
  CASE WHEN d.doc_id % 3 <> 0 THEN (d.doc_id * 7) % 1000 END AS source_event_id,
  CAST((d.doc_id * 37) % 100 AS DOUBLE) / 100 AS importance,
  d.doc_id % 50 AS access_count,
  {_hours('(d.doc_id * 3) % 950')} AS last_accessed,
  CASE WHEN d.doc_id % 5 = 0 THEN '{{"dream_cycle":true}}' WHEN d.doc_id % 6 = 0 THEN '{{"k":null}}' ELSE concat('{{"k":', CAST(d.doc_id % 10 AS STRING), '}}') END AS metadata,
  CASE WHEN d.doc_id % 50 = 0 THEN 1 WHEN d.doc_id % 9 = 0 THEN 2 + d.doc_id % 5 ELSE 10 + d.doc_id % 25 END AS scope_id,
  d.doc_id % 23 = 0 AS is_pinned,
  CAST((d.doc_id * 53) % 1000 AS DOUBLE) / 1000 AS importance_score,
  CASE WHEN d.doc_id % 17 = 0 THEN {_hours('d.doc_id % 960 + 5')} END AS surfaced_at
FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id
"""
EDGES = f"""
SELECT doc_id AS id, doc_id AS source_fact_id, doc_id - doc_id % 40 + (doc_id * 17 + 3) % 40 AS target_fact_id,
  CASE doc_id % 3 WHEN 0 THEN 'supports' WHEN 1 THEN 'contradicts' ELSE 'relates' END AS relation_type,
  CAST(0.5 AS DOUBLE) AS weight, {_hours('doc_id % 960')} AS t_created,
  CASE WHEN doc_id % 13 = 0 THEN {_hours('doc_id % 960 + 9')} END AS t_expired, CAST(1 AS BIGINT) AS scope_id
FROM documents WHERE doc_id % 4 <> 1
"""
SCOPES = """
SELECT CAST(1 AS BIGINT) AS id, CAST(NULL AS BIGINT) AS parent_id, '' AS label, CAST(0 AS BIGINT) AS depth
UNION ALL SELECT CAST(2 + r_regionkey AS BIGINT), CAST(1 AS BIGINT), r_name, CAST(1 AS BIGINT) FROM region
UNION ALL SELECT CAST(10 + n_nationkey AS BIGINT), CAST(2 + n_regionkey AS BIGINT), n_name, CAST(2 AS BIGINT) FROM nation
"""
EVENT_LOG = """
SELECT event_id AS id, ts AS timestamp, event_type, props AS payload, concat('s', CAST(user_id % 200 AS STRING)) AS session_id,
  CAST(1 AS BIGINT) AS scope_id, event_id AS sequence_id, value FROM events
"""
ACTIVITY_EVENTS = """
SELECT event_id AS id, ts, concat('s', CAST(user_id % 200 AS STRING)) AS session_id, event_type AS tool_name, @sha(CAST(event_id % 2 AS STRING)) AS args_hash,
  CASE WHEN value > 50 THEN 'success' ELSE 'failure' END AS outcome_class, CAST(1 AS BIGINT) AS scope_id, props AS result_summary FROM events
"""
OUTCOMES = """
SELECT event_id AS id, CAST((event_id - event_id % 10) / 10 AS BIGINT) AS fact_id,
  CASE (CAST((event_id - event_id % 10) / 10 AS BIGINT) + event_id % 2) % 4 WHEN 0 THEN 'Positive' WHEN 1 THEN 'Negative' WHEN 2 THEN 'Neutral' ELSE 'Other' END AS outcome FROM events
"""
TOMBSTONES = f"""
SELECT doc_id AS id, doc_id AS fact_id, @sha(text) AS content_hash, 'asked' AS reason, {_hours('900')} AS forgotten_at, doc_id AS record_event_id,
  CAST(NULL AS TIMESTAMP_NTZ) AS prior_t_expired, CASE WHEN doc_id % 7 = 0 THEN {_hours('(doc_id * 2) % 1900 + 300')} END AS prior_t_invalid FROM documents WHERE doc_id % 33 = 0
"""
SUMMARIES = """
SELECT doc_id AS id, text AS content, CASE doc_id % 3 WHEN 0 THEN 'local' WHEN 1 THEN 'cluster' ELSE 'global' END AS level, CAST(1 AS BIGINT) AS scope_id FROM documents WHERE doc_id % 10 = 0
"""
LINEAGE = """
SELECT doc_id AS lineage_id, doc_id AS wisdom_fact_id, CAST((doc_id - doc_id % 2) / 2 AS BIGINT) AS source_fact_id FROM documents WHERE doc_id >= 2 AND doc_id % 3 <> 2
"""
QUEUE = f"""
SELECT doc_id AS fact_id, {_hours('doc_id % 960')} AS enqueued_at, doc_id % 8 AS attempts, {_hours('doc_id % 960 + doc_id % 8')} AS next_attempt_at,
  CASE WHEN doc_id % 9 = 0 THEN {_hours('doc_id % 960 + 20')} END AS failed_at FROM documents WHERE doc_id % 6 = 0
"""
CHECKPOINTS = """
SELECT concat('s', CAST(user_id % 200 AS STRING)) AS session_id, CASE user_id % 3 WHEN 0 THEN '/' ELSE concat('/p', CAST(user_id % 5 AS STRING)) END AS scope_path,
  ts AS checkpoint_at, event_id AS last_activity_id FROM events WHERE event_id % 3 = 0
"""
VECTORS = "SELECT vec_id AS fact_id, CASE WHEN vec_id % 5 = 0 THEN 'old' ELSE 'new' END AS space_id, embedding FROM embeddings"
TABLES = {
    "facts": FACTS, "edges": EDGES, "scopes": SCOPES, "event_log": EVENT_LOG, "activity_events": ACTIVITY_EVENTS, "outcomes": OUTCOMES, "tombstones": TOMBSTONES,
    "summaries": SUMMARIES, "lineage": LINEAGE, "embed_queue": QUEUE, "checkpoints": CHECKPOINTS, "fact_vectors": VECTORS,
}
_SOURCES = ("documents", "embeddings", "region", "nation", "events", "conversations", "labels")


def _hash(sql: str, of: str) -> str:
    """@sha(x) as an engine's content hash."""
    return re.sub(r"@sha\(((?:[^()]|\([^()]*\))*)\)", of, sql)


def _spark(sql: str) -> str:
    sql = _hash(sql, r"substring(sha2(\1, 256), 1, 32)")
    return re.sub(r"@h\(((?:[^()]|\([^()]*\))*)\)", rf"(timestamp_ntz'{BASE}' + make_dt_interval(0, cast(\1 as int)))", sql)


def duck(sql: str, *names: str) -> str:
    """sql behind the WITH list of the derived tables that it names."""
    def fix(s: str) -> str:
        s = _hash(s, r"substr(sha256(\1), 1, 32)")
        s = re.sub(r"@h\(((?:[^()]|\([^()]*\))*)\)", rf"(timestamp '{BASE}' + to_hours(CAST(\1 AS INTEGER)))", s)
        return s.replace("AS STRING)", "AS VARCHAR)").replace("TIMESTAMP_NTZ", "TIMESTAMP")

    used = [n for n in TABLES if re.search(rf"\b{n}\b", sql)]
    if not used:
        return fix(sql)
    head = "RECURSIVE " if "RECURSIVE" in sql else ""
    sql = sql.replace("WITH RECURSIVE", ",").replace("@now", f"timestamp '{NOW}'")
    sql = re.sub(r"^\s*WITH\b", ",", sql)
    return fix(f"WITH {head}" + ", ".join(f"{n} AS ({TABLES[n]})" for n in used) + " " + sql)


class Frames:
    """Lazily built derived tables of one directory: Frames(spark, dir).facts and so on."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def source(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        sql = _spark(TABLES[name])
        used = {s: self.source(s) for s in _SOURCES if f" {s}" in sql.replace("\n", " ")}
        for s in used:
            sql = sql.replace(f"FROM {s}", f"FROM {{{s}}}").replace(f"JOIN {s}", f"JOIN {{{s}}}")
        sql = sql.replace('{"', '{{"').replace("}'", "}}'")
        return self.spark.sql(sql, **used)


_WRITTEN: dict[tuple[str, str, str], rt.LexicalIndex] = {}


def _index(t: Frames, kind: str, make: Callable[[DataFrame], rt.LexicalIndex]) -> rt.LexicalIndex:
    """An index is written once for a directory and session, and read by every search after that."""
    key = (t.spark.sparkContext.applicationId, t.dir, kind)
    if key not in _WRITTEN:
        _WRITTEN[key] = make(t.facts)
    return _WRITTEN[key]


def words(t: Frames) -> rt.LexicalIndex:
    return _index(t, "words", rt.word_index)


def stemmed(t: Frames) -> rt.LexicalIndex:
    return _index(t, "stems", rt.lexical_index)


def now() -> Column:
    return F.expr(f"timestamp_ntz'{NOW}'")
