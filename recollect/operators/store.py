"""Writes. Every function gives the next version of the tables it changes; `Store` publishes versions atomically."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from recollect.operators import facts as fa
from recollect.operators.graph import scope_paths
from recollect.operators.ingest import MAX_PAYLOAD, content_hash, entry_status, merge_metadata
from recollect.operators.shared import materialize

c = F.col
ROOT_SCOPE = 1


class NotFound(LookupError):
    """A row that was asked for by its key is not there."""


class Conflict(RuntimeError):
    """Another writer has published a version since the one this write starts from."""


def get(table: DataFrame, key: object, column: str = "id") -> Row:
    """The row with the key; NotFound without one."""
    found = table.where(c(column) == F.lit(key)).limit(1).collect()
    if not found:
        raise NotFound(f"{column} {key}")
    return found[0]


def get_config(config: DataFrame, key: str) -> str | None:
    """The value of a key of (key, value), or None."""
    found = config.where(c("key") == key).select("value").limit(1).collect()
    return found[0].value if found else None


def set_config(config: DataFrame, values: dict[str, str]) -> DataFrame:
    new = config.sparkSession.createDataFrame(list(values.items()) or [], "key string, value string")
    return config.join(new.select("key"), "key", "left_anti").select("key", "value").unionByName(new)


def stream(table: DataFrame) -> Iterator[Row]:
    """Rows one by one, a partition at a time, the next one fetched meanwhile: the driver holds two partitions."""
    return table.toLocalIterator(prefetchPartitions=True)


# Facts
def _rows_of(facts: DataFrame, batch: DataFrame, now: Column, vectors: bool = True) -> DataFrame:
    """Rows of the facts table for a batch (idx, content, ...); ids go on from the largest one, in the order of idx."""
    base = facts.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_base"))  # one row
    prior = F.coalesce(c("importance"), F.lit(0.5)) if "importance" in batch.columns else F.lit(0.5)
    given = {
        "id": c("_base") + 1 + c("idx"),
        "content_hash": content_hash(c("content")),
        "importance": prior,
        "importance_score": prior,
        "access_count": F.lit(0),
        "t_created": now,
        "last_accessed": now,
        "scope_id": F.coalesce(c("scope_id"), F.lit(ROOT_SCOPE)) if "scope_id" in batch.columns else F.lit(ROOT_SCOPE),
        "is_pinned": F.coalesce(c("is_pinned"), F.lit(False)) if "is_pinned" in batch.columns else F.lit(False),
        "metadata": F.coalesce(c("metadata"), F.lit("{}")) if "metadata" in batch.columns else F.lit("{}"),
    }
    if not vectors:
        given["embedding"] = F.array()
    kinds = {f.name: f.dataType for f in facts.schema.fields}
    value = lambda n: given[n] if n in given else c(n) if n in batch.columns else F.lit(None)
    return batch.crossJoin(F.broadcast(base)).select(*[value(n).cast(kinds[n]).alias(n) for n in facts.columns])


def insert(facts: DataFrame, batch: DataFrame, tombstones: DataFrame, now: Column, asserted: bool = False, vectors: bool = True) -> tuple[DataFrame, DataFrame]:
    """(facts, results) after a batch (idx, content, importance, t_valid, t_invalid, ...), each entry for itself.

    results: (idx, id, status). Invalid entries and, unless asserted, content of a tombstone get no row and a null id. A
    new fact's score starts at its prior importance. Without vectors the embedding is empty.
    """
    status = entry_status(batch, tombstones, asserted)
    rows = _rows_of(facts, status.where("status = 'created'").drop("status"), now, vectors)
    base = facts.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_base"))
    results = status.select("idx", "status").crossJoin(F.broadcast(base)).select("idx", F.when(c("status") == "created", c("_base") + 1 + c("idx")).alias("id"), "status")
    return facts.unionByName(rows), results


def insert_all(facts: DataFrame, batch: DataFrame, tombstones: DataFrame, now: Column) -> DataFrame:
    """facts after the whole batch, or as they were if one entry fails."""
    bad = entry_status(batch, tombstones).where("status <> 'created'").limit(1).agg(F.count(F.lit(1)).alias("_bad"))  # one row
    return facts.unionByName(_rows_of(facts, batch.crossJoin(F.broadcast(bad)).where("_bad = 0").drop("_bad"), now))


def insert_deferred(facts: DataFrame, queue: DataFrame, batch: DataFrame, tombstones: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(facts, queue, results): facts without a vector, each with a queue row that is due at once."""
    after, results = insert(facts, batch, tombstones, now, vectors=False)
    new = results.where("id is not null").select(c("id").alias("fact_id"), now.alias("enqueued_at"), F.lit(0).alias("attempts"), now.alias("next_attempt_at"), F.lit(None).alias("failed_at"))
    kinds = {f.name: f.dataType for f in queue.schema.fields}
    return after, queue.unionByName(new.select(*[c(n).cast(kinds[n]).alias(n) if n in new.columns else F.lit(None).cast(kinds[n]).alias(n) for n in queue.columns])), results


def _change(table: DataFrame, keys: DataFrame, changes: dict[str, Column], key: str = "id") -> DataFrame:
    """table with changes in the rows whose key is among keys; further columns of keys are named `new_...`."""
    marked = keys.withColumn("_hit", F.lit(True)).withColumnRenamed(key, "_key")
    met = table.join(marked, table[key] == marked["_key"], "left")
    hit = F.coalesce("_hit", F.lit(False))
    return met.select(*[F.when(hit, changes[n].cast(table.schema[n].dataType)).otherwise(c(n)).alias(n) if n in changes else c(n) for n in table.columns])


def touch(facts: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Counts an access of the facts ids (id)."""
    return _change(facts, ids.select("id").distinct(), {"access_count": c("access_count") + 1, "last_accessed": now})


def set_pin(facts: DataFrame, ids: DataFrame, pinned: bool) -> DataFrame:
    return _change(facts, ids.select("id").distinct(), {"is_pinned": F.lit(pinned)})


def set_importance(facts: DataFrame, values: DataFrame) -> DataFrame:
    """Prior importances (id, importance); one outside [0, 1] fails the job."""
    fine = c("importance").between(0, 1) & ~F.isnan("importance")
    checked = values.select("id", F.when(fine, c("importance")).otherwise(F.raise_error(F.lit("importance must be in [0, 1]"))).alias("new_importance"))
    return _change(facts, checked, {"importance": c("new_importance")})


def set_scores(facts: DataFrame, scores: DataFrame) -> DataFrame:
    """Importance scores (id, score) of any number of facts at once."""
    return _change(facts, scores.select("id", c("score").alias("new_score")), {"importance_score": c("new_score")})


def patch_metadata(facts: DataFrame, patches: DataFrame) -> DataFrame:
    """Merges JSON objects (id, patch) over the facts' metadata."""
    return _change(facts, patches.select("id", c("patch").alias("new_patch")), {"metadata": merge_metadata(c("metadata"), c("new_patch"))})


def stamp_surfaced(facts: DataFrame, ids: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(facts, stamps (id, surfaced_at)): the first stamp of a fact stays."""
    after = _change(facts, ids.select("id").distinct(), {"surfaced_at": F.coalesce("surfaced_at", now)})
    return after, after.join(ids.select("id").distinct(), "id", "left_semi").select("id", "surfaced_at")


def move_scope(facts: DataFrame, events: DataFrame, moves: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(facts, events) after moves (id, from_scope, to_scope): only live facts still in from_scope move, each with an event."""
    done = facts.where(fa.active()).select("id", "scope_id").join(moves, "id").where("scope_id = from_scope").select("id", "from_scope", "to_scope")
    after = _change(facts, done.select("id", c("to_scope").alias("new_scope")), {"scope_id": c("new_scope")})
    audit = done.select(F.lit("ScopeMoved").alias("event_type"), F.to_json(F.struct(c("id").alias("fact_id"), "from_scope", "to_scope")).alias("payload"), c("to_scope").alias("scope_id"), now.alias("timestamp"))
    return after, append_events(events, audit)


def reinforce_batch(facts: DataFrame, batch: DataFrame, tombstones: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(facts, results (idx, id, status)): equal active content of a scope is reinforced, new content created.

    Entries that repeat each other reinforce the first of them. status: created, reinforced, blocked or invalid.
    """
    status = entry_status(batch, tombstones).withColumn("_hash", content_hash(c("content"))).withColumn("scope_id", F.coalesce("scope_id", F.lit(ROOT_SCOPE)))
    base = facts.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_base"))
    fine = status.where("status = 'created'")
    # One row a content and scope: the entry that would create it, how many there are, and what they bring.
    per = fine.groupBy("_hash", c("scope_id").alias("_scope")).agg(F.min("idx").alias("_first"), F.count(F.lit(1)).alias("_n"), F.max(F.coalesce("importance", F.lit(0.5))).alias("_prior"))
    old = facts.where(fa.active()).groupBy(c("content_hash").alias("_old_hash"), c("scope_id").alias("_old_scope")).agg(F.min("id").alias("_old"))
    met = per.join(old, (c("_hash") == c("_old_hash")) & (c("_scope") == c("_old_scope")), "left").crossJoin(F.broadcast(base))
    met = met.select("_hash", "_scope", "_first", "_n", "_prior", "_old", F.coalesce("_old", c("_base") + 1 + c("_first")).alias("_id"))
    rows = _rows_of(facts, fine.join(met.where("_old is null").select(c("_first").alias("idx"), c("_n").alias("_times"), "_prior"), "idx"), now)
    again = met.select(c("_id").alias("id"), (c("_n") - F.when(c("_old").isNull(), 1).otherwise(0)).alias("new_times"), c("_prior").alias("new_prior")).where("new_times > 0")
    changes = {"access_count": c("access_count") + c("new_times"), "last_accessed": now, "importance": F.greatest("importance", "new_prior")}
    after = _change(facts.unionByName(rows), again, changes)
    results = status.join(met.select("_hash", c("_scope").alias("scope_id"), "_first", "_old", "_id"), ["_hash", "scope_id"], "left")
    created = (c("status") == "created") & c("_old").isNull() & (c("idx") == c("_first"))
    return after, results.select("idx", F.when(c("status") == "created", c("_id")).alias("id"), F.when(created, "created").when(c("status") == "created", "reinforced").otherwise(c("status")).alias("status"))


def bootstrap_batch(facts: DataFrame, events: DataFrame, batch: DataFrame, tombstones: DataFrame, session: str, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(facts, events, results) of one session's facts, or nothing new if the session has a marker event already."""
    seen = events.where((c("event_type") == "SessionBootstrapped") & (c("session_id") == session)).limit(1).agg(F.count(F.lit(1)).alias("_seen"))  # one row
    fresh = batch.crossJoin(F.broadcast(seen)).where("_seen = 0").drop("_seen")
    after, results = reinforce_batch(facts, fresh, tombstones, now)
    marker = seen.where("_seen = 0").select(F.lit("SessionBootstrapped").alias("event_type"), F.lit("{}").alias("payload"), F.lit(session).alias("session_id"), F.lit(ROOT_SCOPE).alias("scope_id"), now.alias("timestamp"))
    return after, append_events(events, marker), results


def delete_facts(facts: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts, edges) without the facts ids (id) and their edges; for archives and erasure only."""
    gone = ids.select("id").distinct()
    kept = edges.join(gone.select(c("id").alias("source_fact_id")), "source_fact_id", "left_anti").join(gone.select(c("id").alias("target_fact_id")), "target_fact_id", "left_anti")
    return facts.join(gone, "id", "left_anti").select(*facts.columns), kept.select(*edges.columns)


# Events and counters
def append_events(events: DataFrame, batch: DataFrame) -> DataFrame:
    """events and the batch (event_type, payload, timestamp[, session_id, scope_id]); a payload over 1 MiB fails the job.

    Ids and sequence numbers go on from the largest ones, in the order of timestamp and payload.
    """
    base = events.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_base"))  # one row
    fine = F.coalesce(F.octet_length("payload") <= MAX_PAYLOAD, F.lit(True))
    checked = batch.withColumn("payload", F.when(fine, c("payload")).otherwise(F.raise_error(F.lit("an event's payload is over 1 MiB"))))
    numbered = _numbered(checked, ["timestamp", "payload"]).crossJoin(F.broadcast(base)).withColumn("id", c("_base") + 1 + c("_at"))
    given = {"sequence_id": c("id")}
    kinds = {f.name: f.dataType for f in events.schema.fields}
    value = lambda n: given[n] if n in given else c(n) if n in numbered.columns else F.lit(None)
    return events.unionByName(numbered.select(*[value(n).cast(kinds[n]).alias(n) for n in events.columns]))


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with `_at`, 0, 1, 2 ... in the order: ranges are sorted by themselves, and only their sizes meet."""
    ranged, _ = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_own": F.monotonically_increasing_id()}), "ranges")
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_own").alias("_least"))
    other = sizes.select(c("_part").alias("_before"), c("_n").alias("_m"))
    starts = sizes.join(F.broadcast(other), c("_before") < c("_part"), "left").groupBy("_part", "_least").agg(F.coalesce(F.sum("_m"), F.lit(0)).alias("_start"))  # a row per partition
    return ranged.join(F.broadcast(starts), "_part").withColumn("_at", c("_start") + c("_own") - c("_least")).drop("_part", "_own", "_least", "_start")


def append_event_at(events: DataFrame, scopes: DataFrame, path: str, batch: DataFrame) -> DataFrame:
    """append_events in the scope of a path; NotFound if no scope has it."""
    scope = scope_paths(scopes).where(c("path") == path).select("id").limit(1).collect()
    if not scope:
        raise NotFound(path)
    return append_events(events, batch.withColumn("scope_id", F.lit(scope[0].id)))


OUTCOMES = ("Positive", "Negative", "Neutral")


def record_outcomes(events: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """events and an OutcomeSignal for each (fact_id, outcome); an unknown outcome fails the job."""
    known = enum(c("outcome"), OUTCOMES)
    signal = outcomes.select(F.lit("OutcomeSignal").alias("event_type"), F.to_json(F.struct("fact_id", F.coalesce(known, F.raise_error(F.lit("unknown outcome"))).alias("outcome"))).alias("payload"), F.lit(ROOT_SCOPE).alias("scope_id"), now.alias("timestamp"))
    return append_events(events, signal)


def add_counts(counters: DataFrame, new: DataFrame) -> DataFrame:
    """(rule, n): counters with the new ones added."""
    return counters.select("rule", "n").unionByName(new.select("rule", "n")).groupBy("rule").agg(F.sum("n").alias("n"))


def enum(value: Column, names: tuple[str, ...]) -> Column:
    """The name that the value spells, whatever its case; null for any other."""
    by = F.create_map(*[x for n in names for x in (F.lit(n.lower()), F.lit(n))])
    return F.try_element_at(by, F.lower(value))


class Store:
    """Versions of a memory's tables in one folder.

    A version is a small JSON file that names each table's data folder. It is created once its data are written, and
    creating it fails if it exists, so readers see whole versions and of two writers one gets a Conflict. Tables that a
    write does not name keep their folder. Data of failed writes is named by no version; `vacuum` deletes it.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self._path(f"{self.root}/{folder}")
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def version(self) -> int:
        """The newest version, 0 before the first."""
        return max((int(n) for n in self._names("versions") if n.isdigit()), default=0)

    def tables(self, version: int | None = None) -> dict[str, str]:
        version = self.version() if version is None else version
        if not version:
            return {}
        at = f"{self.root}/versions/{version}"
        return json.loads(self.spark.read.text(at, wholetext=True).first()[0])

    def read(self, name: str, version: int | None = None) -> DataFrame:
        tables = self.tables(version)
        if name not in tables:
            raise NotFound(name)
        return self.spark.read.parquet(f"{self.root}/data/{tables[name]}")

    def publish(self, tables: dict[str, DataFrame], base: int | None = None) -> int:
        """Writes the tables and makes them the version after `base` (the newest one); Conflict if that exists by then."""
        base = self.version() if base is None else base
        names = dict(self.tables(base))
        for name, table in tables.items():
            names[name] = f"{name}-{uuid.uuid4().hex}"
            table.write.parquet(f"{self.root}/data/{names[name]}")
        self._fs.mkdirs(self._path(f"{self.root}/versions"))
        draft, final = self._path(f"{self.root}/drafts/{uuid.uuid4().hex}"), self._path(f"{self.root}/versions/{base + 1}")
        out = self._fs.create(draft, False)
        out.write(json.dumps(names).encode())
        out.close()
        # A rename does not replace a file, so the first writer's version stays.
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise Conflict(f"version {base + 1} is there")
        return base + 1

    def vacuum(self, keep: int = 2) -> int:
        """Deletes versions but the newest `keep`, and data that none of those names; the number of folders deleted."""
        versions = sorted(int(n) for n in self._names("versions") if n.isdigit())
        kept = {f for v in versions[-keep:] for f in self.tables(v).values()}
        for v in versions[:-keep]:
            self._fs.delete(self._path(f"{self.root}/versions/{v}"), False)
        gone = [n for n in self._names("data") if n not in kept]
        for n in gone:
            self._fs.delete(self._path(f"{self.root}/data/{n}"), True)
        return len(gone)
