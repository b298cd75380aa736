"""Cycles, reports, summaries and conflicts against the rules they follow."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from recollect.operators import consolidate as co
from recollect.operators import cycle as cy
from recollect.operators import facts as fa
from recollect.plans import writes
from recollect.plans.tables import Frames, now

DIR = "/root/testdata/sf0.001"


def tables(t):
    return {n: getattr(t, n) for n in ("facts", "edges", "event_log", "lineage", "tombstones")}


def report(spark, deltas, new=(), processed=()):
    rows = [(i + 1, *[d.get(k) for k in ("kind", "fact_id", "new_id", "adjustment", "reason", "outcome", "sources", "provenance")]) for i, d in enumerate(deltas)]
    return cy.CycleReport(spark.createDataFrame(rows, cy.REPORT), spark.createDataFrame(list(new), cy.NEW_FACTS), spark.createDataFrame([(i,) for i in processed], "id long"), 1, "test")


def fact(seq, content="made", importance=0.5, dim=64, scope=1):
    return (seq, content, [1.0] * dim, "Semantic", importance, scope, "{}")


def test_faulty_reports_change_nothing(spark):
    t = Frames(spark, DIR)
    live = [r.id for r in t.facts.where(fa.active()).select("id").orderBy("id").limit(6).collect()]
    dead = t.facts.where(~fa.active()).select("id").first().id
    cases = {
        "unknown fact": [{"kind": "AdjustScore", "fact_id": 10**9, "adjustment": 1}],
        "already expired": [{"kind": "Promote", "fact_id": dead}],
        "adjustment out of range": [{"kind": "AdjustScore", "fact_id": live[0], "adjustment": 3}],
        "unsupported delta": [{"kind": "Explode", "fact_id": live[0]}],
        "delta 2: already expired": [{"kind": "Quarantine", "fact_id": live[0], "reason": "x"}, {"kind": "AdjustScore", "fact_id": live[0], "adjustment": 1}],
        "delta 2: already expired ": [{"kind": "Supersede", "fact_id": live[0], "new_id": live[1]}, {"kind": "Supersede", "fact_id": live[1], "new_id": live[0]}],
    }
    for fault, deltas in cases.items():
        with pytest.raises(cy.CycleError, match=fault.strip()):
            cy.apply_report(report(spark, deltas), tables(t), 64, now())
    for fault, deltas, new in (
        ("no sources", [{"kind": "Synthesize", "sources": []}], [fact(1)]),
        ("wrong embedding dimension", [{"kind": "AddFact"}], [fact(1, dim=3)]),
        ("wrong embedding dimension", [{"kind": "AddFact"}], []),
        (r"importance out of \[0, 1\]", [{"kind": "AddFact"}], [fact(1, importance=1.5)]),
        ("already expired", [{"kind": "Synthesize", "sources": [live[0], live[0]]}], [fact(1)]),
        ("too large", [{"kind": "AddFact"}], [fact(1, "x" * ((1 << 20) + 1))]),
    ):
        with pytest.raises(cy.CycleError, match=fault):
            cy.apply_report(report(spark, deltas, new), tables(t), 64, now())
    with pytest.raises(cy.CycleError, match="unknown fact"):
        cy.apply_report(report(spark, [], processed=[10**9]), tables(t), 64, now())


def test_a_report_applies_whole(spark):
    t = Frames(spark, DIR)
    a, b, d, e, f, g = [r.id for r in t.facts.where(fa.active() & ~F.col("is_pinned") & F.col("embedding").isNotNull()).select("id").orderBy("id").limit(6).collect()]
    gone = t.facts.join(t.tombstones.select(F.col("fact_id").alias("id")), "id").where("content is not null").first().content
    deltas = [
        {"kind": "AddFact"}, {"kind": "AddFact"}, {"kind": "AdjustScore", "fact_id": a, "adjustment": 2}, {"kind": "AdjustScore", "fact_id": a, "adjustment": -1},
        {"kind": "Promote", "fact_id": b, "provenance": '{"source_count":3}'}, {"kind": "Quarantine", "fact_id": b, "reason": "bad"}, {"kind": "TagOutcome", "fact_id": a, "outcome": "Positive"},
        {"kind": "Supersede", "fact_id": d, "new_id": e}, {"kind": "Synthesize", "sources": [f]}, {"kind": "Synthesize", "sources": [g]},
    ]
    new = [fact(1), fact(2, gone), fact(9, "merged"), fact(10, gone)]
    out, counts = cy.apply_report(report(spark, deltas, new, [a]), tables(t), 64, now())
    assert counts == {"AddFact": 1, "AdjustScore": 2, "Promote": 1, "Quarantine": 1, "TagOutcome": 1, "Supersede": 1, "Synthesize": 1, "blocked": 2}
    before = {r.id: r for r in t.facts.collect()}
    after = {r.id: r for r in out["facts"].collect()}
    made = {i: r for i, r in after.items() if i not in before}
    assert sorted((r.content, r.is_pinned) for r in made.values()) == sorted([("made", False), (before[b].content, True), ("merged", False)])
    assert after[a].importance == pytest.approx(min(1, before[a].importance + 0.1) - 0.05)
    assert json.loads(after[b].metadata)["quarantine"]["reason"] == "bad" and after[b].t_expired is not None
    # The blocked Synthesize leaves its source alone.
    assert after[d].t_expired and after[f].t_expired and after[g].t_expired is None and after[e].t_expired is None
    copy = next(r for r in made.values() if r.is_pinned)
    assert json.loads(copy.metadata)["promotion_provenance"] == {"source_count": 3} and copy.scope_id == 1
    dreamt = {i for i, r in after.items() if "dream_cycle" in json.loads(r.metadata) and json.loads(r.metadata)["dream_cycle"] is not True}
    assert dreamt == {a, e, *made}
    links = out["edges"].where("relation_type = 'supersedes'").select("source_fact_id", "target_fact_id").collect()
    merged = next(i for i, r in made.items() if r.content == "merged")
    assert sorted(map(tuple, links)) == sorted([(e, d), (merged, f)])
    assert out["event_log"].where("event_type = 'OutcomeSignal'").count() == 1
    born = {(r.wisdom_fact_id, r.source_fact_id) for r in out["lineage"].where(F.col("wisdom_fact_id") > max(before)).collect()}
    assert born == {(copy.id, b), (merged, f)}


def test_default_cycle(spark):
    t = Frames(spark, DIR)
    ctx = cy.CycleContext(t.facts, t.outcomes, (F.expr("timestamp_ntz'2024-01-01 00:00:00'"), now()), [{"cycle_id": 4}])
    got = cy.DefaultCycle().run(ctx)
    deltas = got.deltas.collect()
    looked = {r.id: r for r in ctx.undreamt().collect()}
    assert got.cycle_id == 5 and {r.id for r in got.processed.collect()} == set(looked)
    plan = {r.fact_id: r for r in co.adjustments(co.outcome_counts(t.outcomes)).collect() if r.fact_id in looked}
    assert {d.fact_id for d in deltas if d.kind == "Quarantine"} == {i for i, r in plan.items() if r.action == "quarantine"}
    assert {(d.fact_id, d.adjustment) for d in deltas if d.kind == "AdjustScore"} == {(i, r.steps) for i, r in plan.items() if r.action == "adjust" and r.steps}
    for d in deltas:
        if d.kind == "Promote":
            scores = sorted(r.importance_score for r in looked.values() if r.fact_type == looked[d.fact_id].fact_type)
            assert looked[d.fact_id].importance_score >= scores[round(0.75 * (len(scores) - 1))]
            assert len(json.loads(d.provenance)["representatives"]) <= 5
    # The ones first promoted are then quarantined, never the other way round.
    assert [d.kind for d in sorted(deltas, key=lambda d: d.seq)] == sorted((d.kind for d in deltas), key=lambda k: k != "Promote") or {d.kind for d in deltas} <= {"Promote", "Quarantine", "AdjustScore"}
    seen = []
    after, counts, _ = cy.run_cycle(cy.DefaultCycle(), ctx, tables(t), 64, now(), insights=type("S", (), {"record": lambda self, x: seen.append(x)})())
    assert seen[0]["cycle_id"] == 5 and sum(counts.values()) == len(deltas)
    # What was looked at is not looked at again.
    assert cy.CycleContext(after["facts"], t.outcomes, ctx.window).undreamt().count() == 0


class Proposer:
    def propose(self, window: pd.DataFrame):
        ids = window["id"].tolist()
        one = window[window["scope_id"] == window["scope_id"].iloc[0]]["id"].tolist()
        other = window[window["scope_id"] != window["scope_id"].iloc[0]]["id"].tolist()
        return [cy.MergeGroup((one[0], one[0], -5), "first"), cy.MergeGroup((one[0],), "taken"), cy.MergeGroup((ids[0], other[0]) if ids[0] not in one[:1] else (one[1], other[0]), "two scopes"), cy.MergeGroup((), "none")]


class Embedder:
    def fingerprint(self):
        return "x", 64

    def embed_batch(self, texts):
        return [[1.0] * 64 for _ in texts]


def test_proposals_are_filtered(spark):
    t = Frames(spark, DIR)
    ctx = cy.CycleContext(t.facts, t.outcomes, (F.expr("timestamp_ntz'2024-01-01 00:00:00'"), now()))
    got = cy.ProposerCycle(Proposer(), Embedder()).run(ctx)
    deltas, new = got.deltas.collect(), got.new_facts.collect()
    assert len(deltas) == 1 and len(deltas[0].sources) == 1 and new[0].content == "first"
    source = t.facts.where(F.col("id") == deltas[0].sources[0]).first()
    assert (new[0].importance, new[0].scope_id) == (source.importance, source.scope_id)
    out, counts = cy.apply_report(got, tables(t), 64, now())
    assert counts["Synthesize"] == 1 and out["facts"].where("content = 'first'").count() == 1


class Writer:
    def summarize(self, items):
        return f"{len(items)} items"


def test_summaries(spark):
    facts = spark.createDataFrame([(i, f"text {i}", 7 if i < 4 else 8) for i in range(9)], "id long, content string, scope_id long")
    members = spark.createDataFrame([(i, i // 4) for i in range(9)], "id long, cluster long")
    rows, sources = cy.cluster_summaries(members, facts, Writer())
    assert {(r.cluster, r.scope_id, r.members, r.content) for r in rows.collect()} == {(0, 7, 4, "4 items"), (1, 8, 4, "4 items")}
    whole, of = cy.global_summary(rows, sources, Writer())
    r = whole.first()
    assert (r.scope_id, r.members, r.content) == (1, 8, "2 items") and of.count() == 8
    assert cy.global_summary(rows.limit(0), sources.limit(0), Writer())[0].count() == 0
    with pytest.raises(Exception, match="unknown level odd"):
        cy.summaries_per_level(spark.createDataFrame([("odd",)], "level string")).collect()


def test_histories_are_kept_short():
    config = {}
    for i in range(12):
        config = cy.remember_cycle(config, cy.CycleReport(None, None, None, i, "m", ("a", f"end {i}")))
    assert [h["cycle_id"] for h in json.loads(config["dream_cycle_history"])] == list(range(4, 12)) and config["last_dream_cycle_at"] == "end 11"


class Arbiter:
    def arbitrate(self, old, new):
        return cy.CrudDecision.UPDATE if old == new else "add"


def test_arbiter_and_classifier(spark):
    pairs = spark.createDataFrame([(0, 1, "a", "a"), (1, 2, "a", "b")], "idx long, old_id long, old string, content string")
    assert [r.decision for r in cy.arbitrate(pairs, Arbiter()).orderBy("idx").collect()] == ["update", "add"]
    with pytest.raises(Exception, match="unknown decision"):
        cy.arbitrate(pairs, type("A", (), {"arbitrate": lambda self, a, b: "burn"})()).collect()
    facts = spark.createDataFrame([(1, "keep me", False), (2, "x", True), (3, None, False)], "id long, content string, is_pinned boolean")
    keep = type("P", (), {"should_pin": lambda self, s: "keep" in s})()
    assert [r.is_pinned for r in cy.pin_persistent(facts, keep).orderBy("id").collect()] == [True, True, False]


def test_reports_of_the_catalogue_have_every_kind(spark):
    kinds = {r.kind for r in writes._report(Frames(spark, DIR)).deltas.select("kind").distinct().collect()}
    assert kinds == {"AdjustScore", "Quarantine", "Promote", "TagOutcome", "Synthesize"}


def test_queries_are_reranked(spark):
    from recollect.plans import memory_query as mq
    from recollect.plans.tables import words

    t = Frames(spark, DIR)
    seen = []

    class Reverse:
        def rerank(self, query, candidates):
            seen.append((query, len(candidates)))
            return [(i, float(i)) for i in range(len(candidates) - 1, 0, -1)]

    plain = [(r.id, r.score) for r in mq.execute(mq.MemoryQuery(text="the", limit=6), t.facts, t.scopes, words(t), now()).collect()]
    got = mq.execute_reranked(mq.MemoryQuery(text="the", limit=6), t.facts, t.scopes, words(t), now(), Reverse())
    assert seen == [("the", 6)] and [i for i, _ in got] == [i for i, _ in plain][:0:-1]
    assert len(mq.execute_reranked(mq.MemoryQuery(limit=4), t.facts, t.scopes, words(t), now(), Reverse())) == 4 and len(seen) == 1
    twice = type("R", (), {"rerank": lambda self, q, x: [(0, 1.0), (0, 2.0)]})()
    with pytest.raises(ValueError):
        mq.execute_reranked(mq.MemoryQuery(text="the"), t.facts, t.scopes, words(t), now(), twice)
