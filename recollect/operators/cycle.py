"""The maintenance cycle: consolidation passes and summaries, cycles that propose reports, and applying them whole."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from enum import Enum
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.operators import consolidate as co
from recollect.operators import facts as fa
from recollect.operators.ingest import MAX_PAYLOAD, ConflictArbiter, DeltaProposer, EmbeddingProvider, PersistenceClassifier, SummaryGenerator, content_hash, merge_metadata
from recollect.operators.shared import materialize
from recollect.operators.store import ROOT_SCOPE, _change, _rows_of, append_events

c = F.col
MOST_VECTORS = 50_000  # active facts with a vector, beyond which a consolidation pass of the reference's size is skipped
STEP, MOST_STEPS = 0.05, 2
HISTORY = 8
REPRESENTATIVES = 5
REPORT = "seq long, kind string, fact_id long, new_id long, adjustment int, reason string, outcome string, sources array<long>, provenance string"
NEW_FACTS = "seq long, content string, embedding array<float>, fact_type string, importance double, scope_id long, metadata string"


class CycleError(ValueError):
    """A report that may not be applied."""


class CrudDecision(Enum):
    ADD, UPDATE, DELETE, NOOP = "add", "update", "delete", "noop"


@dataclass(frozen=True)
class MergeGroup:
    """Facts that a proposer wants to become one, and the text of that one."""

    source_ids: tuple[int, ...]
    summary: str


@dataclass
class CycleReport:
    """What a cycle proposes: deltas (REPORT) in the order of seq, the facts (NEW_FACTS) of AddFact and Synthesize
    deltas, and the facts (id) that it has looked at."""

    deltas: DataFrame
    new_facts: DataFrame
    processed: DataFrame
    cycle_id: int = 0
    method: str = ""
    window: tuple[str, str] = ("", "")


@dataclass
class CycleContext:
    """What a cycle may read."""

    facts: DataFrame
    signals: DataFrame
    window: tuple[Column, Column]
    history: list[dict] = field(default_factory=list)

    def undreamt(self) -> DataFrame:
        """Active facts of the window with a vector that no cycle has looked at."""
        return self.facts.where(fa.overlaps(*self.window) & fa.has_vector() & fa.key_absent("dream_cycle"))

    def next_id(self) -> int:
        return max((h["cycle_id"] + 1 for h in self.history), default=0)


class DreamCycle(Protocol):
    def run(self, ctx: CycleContext) -> CycleReport: ...


class InsightStream(Protocol):
    def record(self, insight: dict) -> None: ...


# Consolidation
def new_pairs(facts: DataFrame, last: Column | None, threshold: float = 0.9, similar: Callable[[DataFrame, float], DataFrame] | None = None) -> DataFrame:
    """(a, b, cos) of active, unpinned facts with vectors that are at least so similar, one of them newer than `last`.

    similar gives the pairs; by default they are exact (consolidate.similar_pairs).
    """
    open_ = facts.where(fa.active() & fa.has_vector() & ~c("is_pinned"))
    pairs = (similar or (lambda rows, t: co.similar_pairs(rows, t)))(open_, threshold - 1e-6)
    if last is None:
        return pairs
    fresh = open_.where(c("t_created") > last).select("id")
    return pairs.join(fresh.select(c("id").alias("a")), "a", "left_semi").unionByName(pairs.join(fresh.select(c("id").alias("b")), "b", "left_semi").join(fresh.select(c("id").alias("a")), "a", "left_anti"))


def passes(facts: DataFrame, dedup: int = MOST_VECTORS, cluster: int = MOST_VECTORS) -> dict[str, bool]:
    """Which passes run: a pass is skipped above its cap of active facts with vectors. None skips nothing."""
    n = facts.where(fa.active() & fa.has_vector()).limit(max(dedup, cluster) + 1).count()
    return {"dedup": n <= dedup, "cluster": n <= cluster}


def cluster_summaries(members: DataFrame, facts: DataFrame, generator: SummaryGenerator | None = None, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """(summaries (cluster, scope_id, members, content), sources (cluster, id)) of clusters (id, cluster) of `least` facts or more.

    The scope is the one most members are in. Without a generator content is null; with one, it reads a cluster's texts
    in the order of ids, a cluster in one task.
    """
    big = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).where(c("n") >= least).select("cluster")
    sources = members.join(big, "cluster", "left_semi").select("cluster", "id")
    out = co.majority_scope(sources, facts).select("cluster", "scope_id", "members")
    if generator is None:
        return out.withColumn("content", F.lit(None).cast("string")), sources

    def write(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"cluster": [g["cluster"].iloc[0]], "content": [generator.summarize(g.sort_values("id")["content"].tolist())]})

    texts = sources.join(facts.select("id", "content"), "id").groupBy("cluster").applyInPandas(write, "cluster long, content string")
    return out.join(texts, "cluster", "left"), sources


def global_summary(summaries: DataFrame, sources: DataFrame, generator: SummaryGenerator | None = None) -> tuple[DataFrame, DataFrame]:
    """(summary (scope_id, members, content), sources (id)) over all cluster summaries, in the root scope; no row without any."""
    out = summaries.agg(F.lit(ROOT_SCOPE).cast("long").alias("scope_id"), F.sum("members").alias("members")).where("members > 0")
    content = F.lit(None).cast("string")
    if generator is not None:
        texts = [r.content for r in summaries.where("content is not null").orderBy("cluster").select("content").toLocalIterator()]
        content = F.lit(generator.summarize(texts)) if texts else content
    return out.withColumn("content", content), sources.select("id").distinct()


def replace_summaries(summaries: DataFrame, new: DataFrame, level: str) -> DataFrame:
    """summaries (id, content, level, scope_id) with those of a level replaced by new (content, scope_id)."""
    base = summaries.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_base"))  # one row
    rows = new.crossJoin(F.broadcast(base)).select((c("_base") + F.row_number().over(Window.orderBy("scope_id", "content"))).alias("id"), "content", F.lit(level).alias("level"), "scope_id")  # summaries are few
    return summaries.where(c("level") != level).select("id", "content", "level", "scope_id").unionByName(rows)


LEVELS = ("local", "cluster", "global")


def summaries_per_level(summaries: DataFrame) -> DataFrame:
    """(level, n); an unknown level fails the job."""
    known = F.when(c("level").isin(*LEVELS), c("level")).otherwise(F.raise_error(F.concat(F.lit("unknown level "), c("level"))))
    return summaries.select(known.alias("level")).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


def merge_reports(reports: DataFrame) -> DataFrame:
    """(created, reinforced, blocked, mean_importance) over bootstrap reports (created, reinforced, blocked, mean_importance):
    counts add up, means weigh by what was created."""
    n = F.sum("created")
    return reports.agg(n.alias("created"), F.sum("reinforced").alias("reinforced"), F.sum("blocked").alias("blocked"), F.when(n > 0, F.sum(c("created") * F.coalesce("mean_importance", F.lit(0.0))) / n).alias("mean_importance"))


def created_report(results: DataFrame, facts: DataFrame) -> DataFrame:
    """(created, reinforced, blocked, mean_importance) of one batch's results (idx, id, status)."""
    met = results.join(facts.select("id", "importance"), "id", "left")
    return met.agg(F.count_if(c("status") == "created").alias("created"), F.count_if(c("status") == "reinforced").alias("reinforced"), F.count_if(c("status") == "blocked").alias("blocked"), F.avg(F.when(c("status") == "created", c("importance"))).alias("mean_importance"))


# Cycles
def provenance(members: DataFrame, facts: DataFrame) -> DataFrame:
    """(cluster, source_count, first_at, last_at, confidence, representatives): the first five ids by score, then id."""
    met = members.join(facts.select("id", "t_created", "importance_score"), "id")
    rank = Window.partitionBy("cluster").orderBy(c("importance_score").desc(), "id")
    first = met.withColumn("r", F.row_number().over(rank)).where(c("r") <= REPRESENTATIVES).groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "id"))), lambda x: x["id"]).alias("representatives"))
    n = F.count(F.lit(1))
    sums = met.groupBy("cluster").agg(n.alias("source_count"), F.min("t_created").alias("first_at"), F.max("t_created").alias("last_at"), F.round(1 - 1 / n, 6).alias("confidence"))
    return sums.join(first, "cluster")


@dataclass
class DefaultCycle:
    """Per fact type with `least` facts or more: clusters, whose medoid is promoted if its score reaches the type's
    percentile; and each fact's outcomes, which adjust or quarantine it."""

    threshold: float = 0.3
    least: int = 3
    percentile: float = 0.75
    method: str = "default-v1"

    def run(self, ctx: CycleContext) -> CycleReport:
        facts = ctx.undreamt()
        spark = facts.sparkSession
        many = facts.groupBy("fact_type").agg(F.count(F.lit(1)).alias("n")).where(c("n") >= self.least).select("fact_type")
        rows = facts.join(many, "fact_type", "left_semi")
        pairs, _ = materialize(co.similar_pairs(rows, self.threshold, on="fact_type"), "cycle-pairs")
        order = rows.select("id", (-c("importance_score")).alias("s")).select("id", F.struct("s", "id").alias("position"))
        members = co.dbscan(pairs, order, self.least)
        medoids = co.medoid(members, facts)
        cut = co.nearest_rank(rows, "fact_type", "importance_score", self.percentile)
        chosen = medoids.join(rows.select(c("id").alias("medoid"), "fact_type"), "medoid").join(cut, "fact_type").where(c("score") >= c("p")).select("cluster", "medoid")
        why = F.to_json(F.struct("source_count", "first_at", "last_at", "confidence", "representatives", F.lit(self.method).alias("method")))
        promoted = chosen.join(provenance(members, facts), "cluster").select(F.lit("Promote").alias("kind"), c("medoid").alias("fact_id"), F.lit(None).cast("int").alias("adjustment"), F.lit(None).cast("string").alias("reason"), why.alias("provenance"))
        plan = co.adjustments(co.outcome_counts(ctx.signals)).join(facts.select(c("id").alias("fact_id")), "fact_id", "left_semi")
        judged = plan.where("action = 'quarantine' or steps <> 0").select(
            F.when(c("action") == "quarantine", "Quarantine").otherwise("AdjustScore").alias("kind"), "fact_id", c("steps").cast("int").alias("adjustment"),
            F.when(c("action") == "quarantine", "negative outcomes only").alias("reason"), F.lit(None).cast("string").alias("provenance"),
        )
        # Promotions come first, so that a fact is copied before it is quarantined.
        both = promoted.unionByName(judged).withColumn("seq", F.row_number().over(Window.orderBy(F.col("kind") != "Promote", "fact_id", "kind")).cast("long"))
        deltas, _ = materialize(both.select("seq", "kind", "fact_id", F.lit(None).cast("long").alias("new_id"), "adjustment", "reason", F.lit(None).cast("string").alias("outcome"), F.lit(None).cast("array<long>").alias("sources"), "provenance"), "cycle-deltas")
        return CycleReport(deltas, spark.createDataFrame([], NEW_FACTS), facts.select("id"), ctx.next_id(), self.method)


@dataclass
class ProposerCycle:
    """A model proposes merges of facts; they become Synthesize deltas.

    Sources outside the window, taken by an earlier group or named twice are dropped; groups that are empty then, or
    span scopes, are skipped. A merged fact has the largest importance of its sources. The window's facts go to the
    proposer on the driver, `most` at a time by keyset pages.
    """

    proposer: DeltaProposer
    embedder: EmbeddingProvider
    most: int = 1000
    method: str = "llm-v1"

    def run(self, ctx: CycleContext) -> CycleReport:
        facts = ctx.undreamt().select("id", "content", "fact_type", "scope_id", "importance", "t_created")
        spark, deltas, new, taken, after = facts.sparkSession, [], [], set(), None
        while True:
            page = (facts if after is None else facts.where(c("id") > after)).orderBy("id").limit(self.most).toPandas()
            if page.empty:
                break
            after = int(page["id"].iloc[-1])
            by_id = page.set_index("id")
            for group in _groups(self.proposer.propose(page)):
                sources = [i for i in dict.fromkeys(group.source_ids) if i in by_id.index and i not in taken]
                own = by_id.loc[sources]
                if not sources or own["scope_id"].nunique() != 1:
                    continue
                taken.update(sources)
                seq = len(deltas) + 1
                deltas.append((seq, "Synthesize", None, None, None, None, None, [int(i) for i in sources], None))
                new.append((seq, group.summary, [float(x) for x in self.embedder.embed_batch([group.summary])[0]], "Semantic", float(own["importance"].max()), int(own["scope_id"].iloc[0]), None))
        return CycleReport(spark.createDataFrame(deltas, REPORT), spark.createDataFrame(new, NEW_FACTS), facts.select("id"), ctx.next_id(), self.method)


def _groups(answer: pd.DataFrame | Iterable[MergeGroup]) -> Iterable[MergeGroup]:
    if isinstance(answer, pd.DataFrame):
        return [MergeGroup(tuple(int(i) for i in r.source_ids), r.summary) for r in answer.itertuples()]
    return answer


def faults(report: CycleReport, facts: DataFrame, dim: int) -> DataFrame:
    """(seq, fault) of deltas that may not be applied: facts that are not there or have expired, before or earlier in the
    report; steps, vectors, importances and sizes out of bounds; unknown kinds."""
    d = report.deltas
    known = F.when(~c("kind").isin("AddFact", "AdjustScore", "Quarantine", "Promote", "TagOutcome", "Supersede", "Synthesize"), "unsupported delta")
    shape = known.when((c("kind") == "AdjustScore") & (F.abs("adjustment") > MOST_STEPS), "adjustment out of range").when((c("kind") == "Synthesize") & (F.coalesce(F.size("sources"), F.lit(0)) < 1), "no sources")
    own = d.select("seq", shape.alias("fault"))
    n = report.new_facts
    bad = F.when(F.coalesce(F.size("embedding"), F.lit(0)) != dim, "wrong embedding dimension").when(~F.coalesce(c("importance").between(0, 1), F.lit(False)) | F.isnan("importance"), "importance out of [0, 1]")
    bad = bad.when((F.octet_length("content") > MAX_PAYLOAD) | (F.octet_length("metadata") > MAX_PAYLOAD), "too large")
    fresh = d.where(c("kind").isin("AddFact", "Synthesize")).select("seq").join(n, "seq", "left").select("seq", bad.alias("fault"))
    # Every mention of a fact, in order: whether it must be active, and whether it expires there.
    one = lambda column, active, ends, *kinds: d.where(c("kind").isin(*kinds)).select("seq", F.lit(0).alias("at"), c(column).alias("id"), F.lit(active).alias("active"), F.lit(ends).alias("ends"))
    many = d.where(c("kind") == "Synthesize").select("seq", F.posexplode("sources").alias("at", "id"), F.lit(True).alias("active"), F.lit(True).alias("ends"))
    told = one("fact_id", True, False, "AdjustScore", "Promote").unionByName(one("fact_id", True, True, "Quarantine", "Supersede")).unionByName(one("new_id", True, False, "Supersede")).unionByName(one("fact_id", False, False, "TagOutcome")).unionByName(many)
    looked = report.processed.select(F.lit(None).cast("long").alias("seq"), F.lit(0).alias("at"), "id", F.lit(False).alias("active"), F.lit(False).alias("ends"))
    before = Window.partitionBy("id").orderBy("seq", "at").rowsBetween(Window.unboundedPreceding, -1)
    told = told.withColumn("gone", F.coalesce(F.max(c("ends").cast("int")).over(before), F.lit(0)) == 1).unionByName(looked.withColumn("gone", F.lit(False)))
    met = told.join(facts.select("id", fa.active().alias("_live")), "id", "left")
    missing = F.when(c("_live").isNull(), "unknown fact").when(c("active") & (~c("_live") | c("gone")), "already expired")
    return own.unionByName(fresh).unionByName(met.select("seq", missing.alias("fault"))).where("fault is not null")


def apply_report(report: CycleReport, tables: dict[str, DataFrame], dim: int, now: Column) -> tuple[dict[str, DataFrame], dict[str, int]]:
    """(tables, counts) after a whole report, or a CycleError and nothing.

    tables has facts, edges, event_log, lineage and tombstones. New facts whose text is forgotten are blocked, and a
    blocked Synthesize leaves its sources alone. What was looked at or made is marked `dream_cycle`.
    """
    facts, edges, d = tables["facts"], tables["edges"], report.deltas
    fault = faults(report, facts, dim).orderBy(c("seq").asc_nulls_last(), "fault").limit(1).collect()
    if fault:
        raise CycleError(f"delta {fault[0].seq}: {fault[0].fault}")
    gone = tables["tombstones"].select(c("content_hash").alias("_h")).distinct()
    made = d.where(c("kind").isin("AddFact", "Synthesize")).select("seq", "kind", "sources").join(report.new_facts, "seq")
    copies = d.where(c("kind") == "Promote").select("seq", "kind", c("fact_id").alias("_from"), "provenance").join(facts.select(c("id").alias("_from"), "content", "embedding", "fact_type", "importance", "metadata"), "_from")
    made = made.withColumns({"_from": F.lit(None).cast("long"), "is_pinned": F.lit(False), "embedding": c("embedding").cast("array<float>")})
    patch = F.concat(F.lit('{"promotion_provenance":'), F.coalesce("provenance", F.lit("null")), F.lit("}"))
    copies = copies.withColumns({"sources": F.array("_from"), "scope_id": F.lit(ROOT_SCOPE).cast("long"), "is_pinned": F.lit(True), "metadata": merge_metadata(c("metadata"), patch), "embedding": c("embedding").cast("array<float>")}).drop("provenance")
    both = made.unionByName(copies).withColumn("_c", content_hash(c("content"))).join(gone, c("_c") == c("_h"), "left")
    both = both.withColumns({"blocked": c("_h").isNotNull(), "idx": c("seq")}).drop("_c", "_h")
    both, _ = materialize(both, "cycle-new")
    base = facts.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_base"))
    new, _ = materialize(both.where("not blocked").crossJoin(F.broadcast(base)).withColumn("id", c("_base") + 1 + c("idx")).drop("_base"), "cycle-ids")

    ended = d.where(c("kind") == "Quarantine").select(c("fact_id").alias("id"), "reason")
    ended = ended.unionByName(d.where(c("kind") == "Supersede").select(c("fact_id").alias("id"), F.lit(None).cast("string").alias("reason")))
    ended = ended.unionByName(new.where(c("kind") == "Synthesize").select(F.explode("sources").alias("id"), F.lit(None).cast("string").alias("reason")))
    quarantine = F.to_json(F.struct(F.struct(c("new_reason").alias("reason"), now.cast("string").alias("at")).alias("quarantine")))
    after = _change(facts, ended.select("id", c("reason").alias("new_reason")), {"t_expired": F.coalesce("t_expired", now), "metadata": F.when(c("new_reason").isNotNull(), merge_metadata(c("metadata"), quarantine)).otherwise(c("metadata"))})
    steps = d.where(c("kind") == "AdjustScore").groupBy(c("fact_id").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "adjustment"))), lambda x: x["adjustment"]).alias("new_steps"))
    clamp = F.aggregate("new_steps", c("importance"), lambda x, s: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x + s * STEP)))
    after = _change(after, steps, {"importance": clamp})
    after = after.unionByName(_rows_of(facts, new.select("idx", "content", "embedding", "fact_type", "importance", "scope_id", "metadata", "is_pinned"), now))
    seen = report.processed.select("id").unionByName(new.select("id")).unionByName(d.where(c("kind") == "Supersede").select(c("new_id").alias("id"))).distinct()
    stamp = F.to_json(F.struct(F.struct(F.lit(report.cycle_id).alias("cycle_id"), now.cast("string").alias("at")).alias("dream_cycle")))
    after = _change(after, seen, {"metadata": merge_metadata(c("metadata"), stamp)})

    links = d.where(c("kind") == "Supersede").select(c("new_id").alias("source_fact_id"), c("fact_id").alias("target_fact_id")).join(facts.select(c("id").alias("source_fact_id"), "scope_id"), "source_fact_id")
    links = links.unionByName(new.where(c("kind") == "Synthesize").select(c("id").alias("source_fact_id"), F.explode("sources").alias("target_fact_id"), "scope_id"))
    born = new.where("kind <> 'AddFact'").select(c("id").alias("wisdom_fact_id"), F.explode("sources").alias("source_fact_id"))
    signals = d.where(c("kind") == "TagOutcome").select(F.lit("OutcomeSignal").alias("event_type"), F.to_json(F.struct("fact_id", "outcome")).alias("payload"), F.lit(ROOT_SCOPE).alias("scope_id"), now.alias("timestamp"))
    out = dict(tables) | {
        "facts": after,
        "edges": add_edges(edges, links, "supersedes", 1.0, now),
        "event_log": append_events(tables["event_log"], signals),
        "lineage": tables["lineage"].unionByName(born.select((c("wisdom_fact_id")).alias("lineage_id"), "wisdom_fact_id", "source_fact_id")),
    }
    counted = {r["kind"]: r["n"] for r in d.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    blocked = {r["kind"]: r["n"] for r in both.where("blocked").groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    return out, {k: n - blocked.get(k, 0) for k, n in counted.items()} | {"blocked": sum(blocked.values())}


def add_edges(edges: DataFrame, links: DataFrame, relation: str | Column, weight: float, now: Column) -> DataFrame:
    """edges and links (source_fact_id, target_fact_id, scope_id); ids go on from the largest one."""
    base = edges.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_base"))
    given = {"id": c("_base") + F.row_number().over(Window.orderBy("source_fact_id", "target_fact_id")), "relation_type": F.lit(relation) if isinstance(relation, str) else relation, "weight": F.lit(weight), "t_created": now, "t_expired": F.lit(None)}
    kinds = {f.name: f.dataType for f in edges.schema.fields}
    rows = links.crossJoin(F.broadcast(base))
    return edges.unionByName(rows.select(*[(given[n] if n in given else c(n)).cast(kinds[n]).alias(n) for n in edges.columns]))


def remember_cycle(config: dict[str, str], report: CycleReport) -> dict[str, str]:
    """The config's values after a report: when the window ended, and what is known of the last eight cycles."""
    history = [*json.loads(config.get("dream_cycle_history", "[]")), {"cycle_id": report.cycle_id, "method": report.method, "window": list(report.window)}]
    return config | {"last_dream_cycle_at": report.window[1], "dream_cycle_history": json.dumps(history[-HISTORY:])}


def promote_with_lineage(facts: DataFrame, lineage: DataFrame, chosen: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(facts, lineage) with a pinned copy in the root scope of each chosen fact (id), and where it came from."""
    base = facts.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_base"))
    rows = facts.join(chosen.select("id"), "id", "left_semi").withColumn("idx", F.row_number().over(Window.orderBy("id")) - 1)  # chosen facts are few
    rows = rows.withColumns({"_from": c("id"), "scope_id": F.lit(ROOT_SCOPE).cast("long"), "is_pinned": F.lit(True)})
    born = rows.crossJoin(F.broadcast(base)).select((c("_base") + 1 + c("idx")).alias("wisdom_fact_id"), c("_from").alias("source_fact_id"))
    new = _rows_of(facts, rows.select("idx", "content", "embedding", "fact_type", "importance", "scope_id", "metadata", "is_pinned"), now)
    return facts.unionByName(new), lineage.unionByName(born.select(c("wisdom_fact_id").alias("lineage_id"), "wisdom_fact_id", "source_fact_id"))


# Conflicts, pins, pruning
def resolve(facts: DataFrame, edges: DataFrame, decisions: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(facts, edges, results) under decisions (idx, old_id, decision, content, ...), one for each old fact.

    add inserts the new fact and links it `supplements`, if the old one is active, else its status is not_found; update
    and delete expire and invalidate the old fact and expire its edges; update inserts the new one and links it
    `contradicts`; noop changes nothing. Links have weight 1 and the new fact's scope. results: (idx, old_id, id, status).
    """
    met = decisions.join(facts.select(c("id").alias("old_id"), fa.active().alias("_live")), "old_id", "left").withColumn("_live", F.coalesce("_live", F.lit(False)))
    met = met.withColumn("status", F.when((c("decision") == "add") & ~c("_live"), "not_found").otherwise(c("decision")))
    met, _ = materialize(met, "decisions")
    ended = met.where(c("status").isin("update", "delete")).select(c("old_id").alias("id")).distinct()
    fresh = met.where(c("status").isin("add", "update"))
    rows = _rows_of(facts, fresh.drop("old_id", "decision", "status", "_live"), now)
    base = facts.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_base"))
    ids = fresh.crossJoin(F.broadcast(base)).select("idx", (c("_base") + 1 + c("idx")).alias("id"))
    links = fresh.join(ids, "idx").select(c("id").alias("source_fact_id"), c("old_id").alias("target_fact_id"), F.coalesce("scope_id", F.lit(ROOT_SCOPE)).cast("long").alias("scope_id"), F.when(c("status") == "add", "supplements").otherwise("contradicts").alias("relation"))
    after = add_edges(fa.expire_edges(edges, ended, now), links, c("relation"), 1.0, now)
    return fa.expire(facts, ended, now, True).unionByName(rows), after, met.select("idx", "old_id", "status").join(ids, "idx", "left").select("idx", "old_id", "id", "status")


def arbitrate(pairs: DataFrame, arbiter: ConflictArbiter) -> DataFrame:
    """pairs (idx, old_id, old, content, ...) with the arbiter's decision on each old and new text; an unknown one fails the job."""
    known = {d.value for d in CrudDecision}

    def decide(old: pd.Series, new: pd.Series) -> pd.Series:
        out = [str(getattr(x, "value", x)) for x in (arbiter.arbitrate(a, b) for a, b in zip(old, new))]
        if not set(out) <= known:
            raise ValueError(f"unknown decision among {sorted(set(out))}")
        return pd.Series(out)

    return pairs.withColumn("decision", F.pandas_udf(decide, "string")("old", "content"))


def pin_persistent(facts: DataFrame, classifier: PersistenceClassifier) -> DataFrame:
    """facts with those pinned whose content the classifier wants kept; pinned ones stay pinned."""
    ask = F.pandas_udf(lambda s: pd.Series([bool(classifier.should_pin(x)) if x is not None else False for x in s]), "boolean")
    return facts.withColumn("is_pinned", c("is_pinned") | ask("content")).select(*facts.columns)


def prune_apply(facts: DataFrame, edges: DataFrame, now: Column, least: float = co.LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(facts, edges, stats): all active facts scored, the scores kept, and the weak ones expired with their edges.

    stats: (scored, pruned, pinned_kept, exempt_kept, edges_expired).
    """
    scored, _ = materialize(co.importance(facts, edges, now), "scores")
    weak = co.prune(scored, least).select("id")
    after = _change(facts, scored.select("id", c("score").alias("new_score")), {"importance_score": c("new_score")})
    cut = fa.expire_edges(edges, weak, now)
    low, exempt = c("score") < least, c("fact_type").isin(*co.EXEMPT)
    ends = edges.where(fa.active())
    lost = ends.join(weak.select(c("id").alias("source_fact_id")), "source_fact_id", "left_semi").select("id").union(ends.join(weak.select(c("id").alias("target_fact_id")), "target_fact_id", "left_semi").select("id")).distinct()
    stats = scored.agg(F.count(F.lit(1)).alias("scored"), F.count_if(low & ~c("is_pinned") & ~exempt).alias("pruned"), F.count_if(low & c("is_pinned")).alias("pinned_kept"), F.count_if(low & ~c("is_pinned") & exempt).alias("exempt_kept"))
    return fa.expire(after, weak, now), cut, stats.crossJoin(lost.agg(F.count(F.lit(1)).alias("edges_expired")))


def run_cycle(cycle: DreamCycle, ctx: CycleContext, tables: dict[str, DataFrame], dim: int, now: Column, insights: InsightStream | None = None) -> tuple[dict[str, DataFrame], dict[str, int], CycleReport]:
    """(tables, counts, report) of one cycle: it proposes, the report is applied whole, and insights are told of it."""
    report = cycle.run(ctx)
    after, counts = apply_report(report, tables, dim, now)
    if insights is not None:
        insights.record({"cycle_id": report.cycle_id, "method": report.method, **counts})
    return after, counts, report
