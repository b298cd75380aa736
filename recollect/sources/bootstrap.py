"""Bootstrap of a memory from session logs and notes in one call, and helpers of the project it belongs to."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollect.functions import redaction as rd
from recollect.operators import cycle as cy
from recollect.operators import store as st
from recollect.operators.shared import materialize
from recollect.sources import sessions as ss

c = F.col
LINE_BYTES, FILE_ENTRIES, FILE_BYTES = 1 << 20, 100_000, 256 << 20


class SessionExtractor(Protocol):
    """Turns and outcomes of sessions to facts (session_id, content, fact_type, importance, at); a turn may give several."""

    def extract(self, turns: DataFrame, outcomes: DataFrame) -> DataFrame: ...


class KeywordExtractor:
    """A fact for each keyword category that a turn meets."""

    def extract(self, turns: DataFrame, outcomes: DataFrame) -> DataFrame:
        return ss.extract_facts(turns, outcomes).select("session_id", "content", "fact_type", "importance", "at")


def capped(entries: DataFrame, most_entries: int = FILE_ENTRIES) -> DataFrame:
    """Entries of read_sessions, of each file the first `most_entries`."""
    n = F.row_number().over(Window.partitionBy("file").orderBy("position"))
    return entries.withColumn("_n", n).where(c("_n") <= most_entries).drop("_n")


def _files(spark: SparkSession, path: str, most: int) -> list[str]:
    """The files of at most `most` bytes, so that one log cannot take a whole run."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").load(path)
    return [r.path for r in found.where(c("length") <= most).select("path").collect()]


def _ingest(facts: DataFrame, events: DataFrame, tombstones: DataFrame, found: DataFrame, scope: int, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(facts, events, report) with the facts found (session_id, content, fact_type, importance, at) of sessions without a marker."""
    seen = events.where("event_type = 'SessionBootstrapped'").select("session_id").distinct()
    fresh = found.join(seen, "session_id", "left_anti")
    clean = fresh.withColumn("content", rd.redact_column(c("content"))).where("content is not null")
    batch = st._numbered(clean, ["session_id", "at", "content"]).select(
        c("_at").alias("idx"), "content", "fact_type", "importance", F.lit(scope).cast("long").alias("scope_id"), c("at").cast("timestamp_ntz").alias("t_valid"), F.lit(None).cast("timestamp_ntz").alias("t_invalid")
    )
    batch, _ = materialize(batch, "bootstrap")
    after, results = st.reinforce_batch(facts, batch, tombstones, now)
    results, _ = materialize(results, "bootstrap-results")
    marks = fresh.select("session_id").distinct().select(F.lit("SessionBootstrapped").alias("event_type"), F.lit("{}").alias("payload"), "session_id", F.lit(scope).cast("long").alias("scope_id"), now.alias("timestamp"))
    return after, st.append_events(events, marks), cy.created_report(results, after)


def bootstrap_sessions(spark: SparkSession, path: str, facts: DataFrame, events: DataFrame, tombstones: DataFrame, now: Column, scope: int = st.ROOT_SCOPE, extractor: SessionExtractor | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(facts, events, report) after all session logs under a file or folder: read within the caps, joined to turns, judged,
    extracted, redacted, and reinforced or created. Sessions with a marker event are skipped, new ones get one, so
    another call adds nothing. report: (created, reinforced, blocked, mean_importance).
    """
    files = _files(spark, path, FILE_BYTES)
    if not files:
        return facts, events, cy.created_report(spark.createDataFrame([], "idx long, id long, status string"), facts)
    entries = capped(ss.read_sessions(spark, files, LINE_BYTES))
    turns, _ = materialize(ss.reconstruct(entries), "turns")
    found = (extractor or KeywordExtractor()).extract(turns, ss.session_outcomes(turns))
    return _ingest(facts, events, tombstones, found, scope, now)


def bootstrap_notes(spark: SparkSession, path: str, facts: DataFrame, events: DataFrame, tombstones: DataFrame, now: Column, scope: int = st.ROOT_SCOPE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(facts, events, report) after all notes under a folder; a note's file is its session, so it comes in once."""
    notes = ss.read_notes(spark, path).where("body <> ''")
    found = notes.select(c("file").alias("session_id"), c("body").alias("content"), "fact_type", F.lit(0.5).alias("importance"), c("date").alias("at"))
    return _ingest(facts, events, tombstones, found, scope, now)


def without_userinfo(url: Column) -> Column:
    """A URL without user name and password before its host."""
    return F.regexp_replace(url, r"^([A-Za-z][A-Za-z0-9+.-]*://)[^/?#@]*@", "$1")


def project_key(remote: Column, folder: Column) -> Column:
    """host/owner/name of a remote URL or scp-like address, lower-cased and without `.git`; else the folder's last part."""
    plain = F.regexp_replace(without_userinfo(F.trim(remote)), r"^[^/@:]+@([^:/]+):", "ssh://$1/")
    key = F.regexp_replace(F.lower(F.regexp_extract(plain, r"^[A-Za-z][A-Za-z0-9+.-]*://([^?#]+)", 1)), r"(\.git)?/*$", "")
    name = F.element_at(F.filter(F.split(F.translate(folder, "\\", "/"), "/"), lambda x: x != ""), -1)
    return F.coalesce(F.nullif(key, F.lit("")), F.lower(name))
