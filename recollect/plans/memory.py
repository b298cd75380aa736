"""A memory over a Store: what an assistant asks of it, and the work between. Every change is one published version."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.operators import apply as ap
from recollect.operators import facts as fa
from recollect.operators import graph as gr
from recollect.operators import retrieval as rt
from recollect.operators import store as st
from recollect.operators.ingest import EmbeddingProvider
from recollect.plans.memory_query import MemoryQuery, execute, resolve

c = F.col
RESULTS = 10
FACTS = "id long, content string, content_hash string, embedding array<float>, fact_type string, t_created timestamp_ntz, t_expired timestamp_ntz, t_valid timestamp_ntz, t_invalid timestamp_ntz, source_event_id long, importance double, access_count long, last_accessed timestamp_ntz, metadata string, scope_id long, is_pinned boolean, importance_score double, surfaced_at timestamp_ntz"
EMPTY = {
    "facts": FACTS,
    "edges": "id long, source_fact_id long, target_fact_id long, relation_type string, weight double, t_created timestamp_ntz, t_expired timestamp_ntz, scope_id long",
    "event_log": "id long, timestamp timestamp_ntz, event_type string, payload string, session_id string, scope_id long, sequence_id long",
    "tombstones": "id long, fact_id long, content_hash string, reason string, forgotten_at timestamp_ntz, record_event_id long, prior_t_expired timestamp_ntz, prior_t_invalid timestamp_ntz",
    "lineage": "lineage_id long, wisdom_fact_id long, source_fact_id long",
    "embed_queue": "fact_id long, enqueued_at timestamp_ntz, attempts int, next_attempt_at timestamp_ntz, failed_at timestamp_ntz",
    "config": "key string, value string",
}


@dataclass
class Memory:
    """user and project are scope paths: the two homes of what is remembered."""

    store: st.Store
    user: str = "/user"
    project: str = "/project"

    @classmethod
    def create(cls, spark: SparkSession, root: str, user: str = "/user", project: str = "/project") -> Memory:
        """An empty memory with its root scope and homes."""
        store = st.Store(spark, root)
        scopes = spark.createDataFrame([(st.ROOT_SCOPE, None, "", 0)], "id long, parent_id long, label string, depth long")
        scopes = gr.ensure_paths(scopes, spark.createDataFrame([(user,), (project,)], "path string"))
        store.publish({n: spark.createDataFrame([], s) for n, s in EMPTY.items()} | {"scopes": scopes}, base=0)
        return cls(store, user, project)

    @property
    def spark(self) -> SparkSession:
        return self.store.spark

    def _now(self) -> Column:
        return F.lit(datetime.now(timezone.utc).replace(tzinfo=None)).cast("timestamp_ntz")

    def _home(self, level: str) -> int:
        path = {"user": self.user, "project": self.project}.get(level)
        if path is None:
            raise ValueError(f"no level {level}")
        found = resolve(self.store.read("scopes"), path)
        if found is None:
            raise st.NotFound(path)
        return found

    def remember(self, contents: list[str], level: str = "project", fact_type: str = "Semantic") -> list[tuple[int | None, str]]:
        """(id, status) of each text, in order: created facts wait for their vector in the queue."""
        base, home, now = self.store.version(), self._home(level), self._now()
        batch = self.spark.createDataFrame([(i, x, fact_type, home) for i, x in enumerate(contents)], "idx long, content string, fact_type string, scope_id long")
        batch = batch.withColumns({"importance": F.lit(0.5), "t_valid": F.lit(None).cast("timestamp_ntz"), "t_invalid": F.lit(None).cast("timestamp_ntz")})
        t = lambda n: self.store.read(n, base)
        facts, queue, results = st.insert_deferred(t("facts"), t("embed_queue"), batch, t("tombstones"), now)
        out = [(r.id, r.status) for r in results.orderBy("idx").collect()]
        self.store.publish({"facts": facts, "embed_queue": queue}, base)
        return out

    def recall(self, text: str, embedding: list[float] | None = None, limit: int = RESULTS) -> tuple[list[tuple[int, str, float]], bool]:
        """((id, content, score) of both homes, best first; whether vectors were left out): without a vector of the
        question, or of any fact, only words count."""
        facts, scopes = self.store.read("facts"), self.store.read("scopes")
        degraded = embedding is None or facts.where(fa.active() & fa.has_vector()).isEmpty()
        q = MemoryQuery(text=rt.any_word(text), embedding=None if degraded else embedding, scope=("set", (self.user, self.project)), limit=limit)
        hits = execute(q, facts, scopes, rt.lexical_index(facts), self._now())
        rows = hits.join(facts.select("id", "content"), "id").orderBy(c("score").desc(), "id").collect()
        return [(r.id, r.content, r.score) for r in rows], degraded

    def forget(self, ids: list[int], reason: str) -> int:
        """Forgets facts and the copies of their texts in the same homes; how many rows that are. NotFound for an unknown id."""
        base, now = self.store.version(), self._now()
        facts, tombstones = self.store.read("facts", base), self.store.read("tombstones", base)
        for i in ids:
            st.get(facts, i)
        events = st.append_events(self.store.read("event_log", base), self.spark.createDataFrame([("FactsForgotten", reason)], "event_type string, payload string").withColumn("timestamp", now))
        record = events.agg(F.max("id")).first()[0]
        plan, _ = st.materialize(fa.forget(facts, self.spark.createDataFrame([(i,) for i in ids], "id long"), now), "forget")
        gone = plan.join(facts.select("id", "content_hash"), "id")
        rows = gone.select(c("id"), c("id").alias("fact_id"), "content_hash", F.lit(reason).alias("reason"), now.alias("forgotten_at"), F.lit(record).cast("long").alias("record_event_id"), "prior_t_expired", "prior_t_invalid")
        after = st._change(facts, plan.select("id", c("t_expired").alias("new_expired"), c("t_invalid").alias("new_invalid")), {"t_expired": c("new_expired"), "t_invalid": c("new_invalid")})
        edges = fa.expire_edges(self.store.read("edges", base), plan.select("id"), now)
        n = plan.count()
        self.store.publish({"facts": after, "edges": edges, "tombstones": tombstones.unionByName(rows), "event_log": events}, base)
        return n

    def set_level(self, fact_id: int, level: str) -> str:
        """Moves a live fact of one home to the other's level; the path where it is now."""
        base, now, to = self.store.version(), self._now(), self._home(level)
        facts = self.store.read("facts", base)
        fact = st.get(facts.where(fa.active() & (c("t_invalid").isNull() | (c("t_invalid") > now))), fact_id)
        if fact.scope_id not in (self._home("user"), self._home("project")):
            raise st.NotFound(f"id {fact_id}")
        if fact.scope_id != to:
            move = self.spark.createDataFrame([(fact_id, fact.scope_id, to)], "id long, from_scope long, to_scope long")
            after, events = st.move_scope(facts, self.store.read("event_log", base), move, now)
            self.store.publish({"facts": after, "event_log": events}, base)
        return self.user if level == "user" else self.project

    def drain(self, provider: EmbeddingProvider, most: int = 100) -> int:
        """Embeds due queue rows one after the other, one in flight, and publishes each answer; how many were embedded.

        A failing provider leaves the row to be tried again later, by the queue's delays, and ends the drain.
        """
        done = 0
        for _ in range(most):
            base, now = self.store.version(), self._now()
            queue, facts = self.store.read("embed_queue", base), self.store.read("facts", base)
            due = queue.where(c("failed_at").isNull() & (c("next_attempt_at") <= now)).join(facts.select(c("id").alias("fact_id"), "content"), "fact_id").orderBy("next_attempt_at", "fact_id").limit(1).collect()
            if not due:
                break
            error, vector = None, None
            try:
                vector = [float(x) for x in provider.embed_batch([due[0].content])[0]]
            except Exception as e:  # noqa: BLE001  the answer is kept with the row
                error = str(e)
            answer = self.spark.createDataFrame([(due[0].fact_id, "embedded" if error is None else "no_answer", error, vector)], "fact_id long, answer string, error string, embedding array<float>")
            queue, vectors = ap.settle(queue, answer, now)
            after = st._change(facts, vectors.select(c("fact_id").alias("id"), c("embedding").alias("new_embedding")), {"embedding": c("new_embedding")})
            self.store.publish({"embed_queue": queue, "facts": after}, base)
            if error is not None:
                break
            done += 1
        return done

    def statistics(self) -> DataFrame:
        return fa.statistics(self.store.read("facts"), self._now())
