"""Batch inserts, upcasting, metadata patches, embedding spaces, erasure and the maintenance cycle's plans."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.operators.facts import key_present

c = F.col
MAX_PAYLOAD = 1 << 20


# Extension points: what callers plug in. Batch methods run inside pandas UDFs, the others on the driver.
class EmbeddingProvider(Protocol):
    def fingerprint(self) -> tuple[str, int]: ...
    def embed_batch(self, texts: list[str]) -> list[list[float]]: ...


class SummaryGenerator(Protocol):
    def summarize(self, items: list[str]) -> str: ...


class ConflictArbiter(Protocol):
    def arbitrate(self, old: str, new: str) -> str: ...


class PersistenceClassifier(Protocol):
    def should_pin(self, content: str) -> bool: ...


class Reranker(Protocol):
    def rerank(self, query: str, candidates: list[str]) -> list[tuple[int, float]]: ...


class DeltaProposer(Protocol):
    def propose(self, window: pd.DataFrame) -> pd.DataFrame: ...


def content_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 32)


def entry_status(batch: DataFrame, tombstones: DataFrame, asserted: bool = False) -> DataFrame:
    """batch with status: created, invalid or blocked for each entry (idx, content, importance, t_valid, t_invalid, ...)."""
    prior = F.coalesce("importance", F.lit(0.5))
    sized = (F.octet_length("content") <= MAX_PAYLOAD) & (F.coalesce(F.octet_length("metadata"), F.lit(0)) <= MAX_PAYLOAD if "metadata" in batch.columns else F.lit(True))
    valid = c("content").isNotNull() & sized & ~F.isnan(prior) & prior.between(0, 1) & (c("t_valid").isNull() | c("t_invalid").isNull() | (c("t_valid") < c("t_invalid")))
    gone = tombstones.select(c("content_hash").alias("_h"), F.lit(True).alias("_gone")).distinct()
    met = batch.withColumn("_c", content_hash(c("content"))).join(gone, c("_c") == c("_h"), "left")
    blocked = F.lit(False) if asserted else F.coalesce("_gone", F.lit(False))
    return met.withColumn("status", F.when(~F.coalesce(valid, F.lit(False)), "invalid").when(blocked, "blocked").otherwise("created")).select(*batch.columns, "status")


def insert_results(batch: DataFrame, tombstones: DataFrame, asserted: bool = False) -> DataFrame:
    """(idx, status) of each entry, one by one."""
    return entry_status(batch, tombstones, asserted).select("idx", "status")


def all_or_nothing(batch: DataFrame, results: DataFrame) -> DataFrame:
    """The batch if every entry was created, else none of it."""
    bad = results.where("status <> 'created'").limit(1).agg(F.count(F.lit(1)).alias("bad"))
    return batch.crossJoin(F.broadcast(bad)).where("bad = 0").drop("bad")  # one row


def merge_metadata(metadata: Column, patch: Column) -> Column:
    """Shallow merge of JSON objects; values keep their types, and a base or patch that is no object counts as {}."""
    members = lambda x: F.coalesce(F.try_variant_get(F.try_parse_json(x), F.lit("$"), "map<string,variant>"), F.expr("map()").cast("map<string,variant>"))
    kept = F.map_filter(members(metadata), lambda k, v: ~F.array_contains(F.map_keys(members(patch)), k))
    return F.to_json(F.to_variant_object(F.map_concat(kept, members(patch))))


@dataclass
class Upcasters:
    """Steps that bring an event payload from one revision to the next, per event type."""

    steps: dict[tuple[str, int], Callable[[Column], Column]] = field(default_factory=dict)

    def register(self, event_type: str, revision: int, step: Callable[[Column], Column]) -> None:
        self.steps[event_type, revision] = step

    def latest(self, event_type: str) -> int:
        return max((r + 1 for t, r in self.steps if t == event_type), default=1)

    def apply(self, events: DataFrame) -> DataFrame:
        """events with payload and event_revision brought to the latest; a missing step fails the job."""
        for revision in range(1, max((r for _, r in self.steps), default=0) + 1):
            payload, after = c("payload"), c("event_revision")
            for (kind, r), step in self.steps.items():
                if r == revision:
                    here = (c("event_type") == kind) & (c("event_revision") == r)
                    payload, after = F.when(here, step(c("payload"))).otherwise(payload), F.when(here, r + 1).otherwise(after)
            events = events.withColumns({"payload": payload, "event_revision": after})
        wanted = F.coalesce(F.element_at(F.create_map(*[x for t in {t for t, _ in self.steps} for x in (F.lit(t), F.lit(self.latest(t)))]), c("event_type")), F.lit(1)) if self.steps else F.lit(1)
        late = F.raise_error(F.concat(F.lit("no step from revision "), c("event_revision").cast("string"), F.lit(" of "), c("event_type")))
        return events.withColumn("payload", F.when(c("event_revision") < wanted, late).otherwise(c("payload")))


def embed(facts: DataFrame, provider: EmbeddingProvider, dim: int, batch: int = 128) -> DataFrame:
    """(fact_id, embedding) of facts (id, content), `batch` texts a call; a wrong length fails the job."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), batch):
                some = part.iloc[at : at + batch]
                vectors = provider.embed_batch(some["content"].tolist())
                if any(len(v) != dim for v in vectors):
                    raise ValueError(f"the provider's vectors are not of length {dim}")
                yield pd.DataFrame({"fact_id": some["id"], "embedding": vectors})

    return facts.select("id", "content").mapInPandas(run, "fact_id long, embedding array<float>")


def space_status(vectors: DataFrame, facts: DataFrame, space: str) -> DataFrame:
    """(space_id, vectors, pending): a space can be promoted once pending is 0."""
    own = vectors.where(c("space_id") == space)
    pending = facts.join(own.select(c("fact_id").alias("id")), "id", "left_anti").agg(F.count(F.lit(1)).alias("pending"))
    return own.agg(F.lit(space).alias("space_id"), F.count(F.lit(1)).alias("vectors")).crossJoin(pending)


def rerank(results: DataFrame, reranker: Reranker, query: str, depth: int = 30) -> list[tuple[int, float]]:
    """Reorders the `depth` best (id, content, score): every index known and used once, scores finite."""
    top = results.orderBy(c("score").desc(), "id").limit(depth).collect()
    order = reranker.rerank(query, [r.content for r in top])
    if len({i for i, _ in order}) != len(order) or any(not 0 <= i < len(top) or s != s or abs(s) == float("inf") for i, s in order):
        raise ValueError("the reranker's answer is not valid")
    return [(top[i].id, s) for i, s in order]


def erase(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """The tables without the facts `ids` (id) and what refers to them: edges, vectors, queue rows, lineage, tombstones."""
    out = dict(tables)
    for name, columns in {"facts": ["id"], "edges": ["source_fact_id", "target_fact_id"], "fact_vectors": ["fact_id"], "embed_queue": ["fact_id"], "lineage": ["wisdom_fact_id", "source_fact_id"], "tombstones": ["fact_id"]}.items():
        for column in columns if name in out else []:
            out[name] = out[name].join(ids.select(c("id").alias(column)), column, "left_anti")
    return out


def promote(facts: DataFrame, members: DataFrame, chosen: DataFrame) -> DataFrame:
    """(wisdom of, source_count, first_at, last_at, confidence): provenance of clusters whose medoid is promoted."""
    own = members.join(facts.select("id", "t_created"), "id").join(chosen.select("cluster", "medoid"), "cluster")
    return own.groupBy("medoid").agg(F.count(F.lit(1)).alias("source_count"), F.min("t_created").alias("first_at"), F.max("t_created").alias("last_at"), F.round(1 - 1 / F.count(F.lit(1)), 6).alias("confidence"))


def adjust_scores(facts: DataFrame, plan: DataFrame, step: float = 0.05) -> DataFrame:
    """(id, importance_score) after outcome steps, within [0, 1]."""
    met = facts.select("id", "importance_score").join(plan.select(c("fact_id").alias("id"), "steps"), "id", "left")
    return met.select("id", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), c("importance_score") + F.coalesce("steps", F.lit(0)) * step)), 6).alias("importance_score"))


def cycle_due(facts: DataFrame, cursor: int) -> bool:
    """False if a caller has written a fact above the cursor since the last cycle."""
    last = facts.where(~key_present("dream_cycle")).agg(F.max("id")).first()[0]
    return last is None or last <= cursor


def new_sessions(sessions: DataFrame, markers: DataFrame) -> DataFrame:
    """Sessions without a bootstrap marker, each once."""
    return sessions.dropDuplicates(["session_id"]).join(markers, "session_id", "left_anti")


def project_context(facts: DataFrame, activities: DataFrame, checkpoints: DataFrame, scopes: DataFrame, k: int = 10) -> dict[str, DataFrame]:
    """Last checkpoint, recent activities and recent facts of the scopes (id)."""
    here = scopes.select(c("id").alias("scope_id"))
    return {
        "checkpoint": checkpoints.orderBy(c("checkpoint_at").desc(), "session_id").limit(1),
        "activities": activities.join(here, "scope_id", "left_semi").orderBy(c("last_seen").desc(), "session_id").limit(k),
        "facts": facts.where("t_expired is null").join(here, "scope_id", "left_semi").orderBy(c("t_created").desc(), "id").limit(k),
    }
