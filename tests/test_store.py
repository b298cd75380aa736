"""Versions, the memory over them, spaces, snapshots, archives, bootstrap and the command line."""

import gzip
import json
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect import __main__ as cli
from recollect.operators import ann
from recollect.operators import facts as fa
from recollect.operators import filters as fi
from recollect.operators import ingest as ig
from recollect.operators import spaces as sp
from recollect.operators import store as st
from recollect.plans.memory import Memory
from recollect.plans.tables import Frames, now
from recollect.sources import bootstrap as bo
from recollect.sources import snapshots as sn

DIR = "/root/testdata/sf0.001"


class Embedder:
    """A vector of letter counts."""

    def fingerprint(self):
        return "letters", 26

    def embed_batch(self, texts):
        return [[float(t.lower().count(chr(97 + i))) + 0.01 for i in range(26)] for t in texts]


class Broken(Embedder):
    def embed_batch(self, texts):
        raise ConnectionError("no network")


def test_versions_are_whole_and_exclude_each_other(spark, tmp_path):
    store = st.Store(spark, f"file://{tmp_path}/s")
    a, b = spark.range(3), spark.range(5)
    assert store.version() == 0 and store.publish({"a": a, "b": b}) == 1
    assert store.publish({"a": b}, base=1) == 2
    assert store.read("a").count() == 5 and store.read("a", 1).count() == 3 and store.tables()["b"] == store.tables(1)["b"]
    with pytest.raises(st.Conflict):
        store.publish({"a": a}, base=1)
    with pytest.raises(st.NotFound):
        store.read("c")
    assert store.read("a").count() == 5
    assert store.vacuum(keep=1) == 2 and store.read("a").count() == 5 and store.read("b").count() == 5


def test_rows_by_key(spark):
    t = spark.range(5)
    assert st.get(t, 3).id == 3 and len(list(st.stream(t))) == 5
    with pytest.raises(st.NotFound):
        st.get(t, 9)
    config = st.set_config(spark.createDataFrame([], "key string, value string"), {"a": "1"})
    assert st.get_config(config, "a") == "1" and st.get_config(config, "b") is None


def test_forgotten_content_is_refused(spark):
    gone = spark.createDataFrame([("secret",)], "t string").select(ig.content_hash(F.col("t")).alias("content_hash"))
    batch = spark.createDataFrame([(0, "secret", 0.5, None, None), (1, "fine", 0.5, None, None)], "idx long, content string, importance double, t_valid timestamp_ntz, t_invalid timestamp_ntz")
    assert {r.idx: r.status for r in ig.insert_results(batch, gone).collect()} == {0: "blocked", 1: "created"}
    assert {r.idx: r.status for r in ig.insert_results(batch, gone, asserted=True).collect()} == {0: "created", 1: "created"}


def test_metadata_keeps_types(spark):
    rows = [('{"k":7,"dream_cycle":true,"n":{"a":1}}', '{"z":[1,"x"]}'), ("[1]", '{"a":null}'), (None, '{"a":1}'), ('{"a":1}', "5"), ("not json", '{"b":"2"}'), ('{"a":{"x":1}}', '{"a":{"y":2}}')]
    got = [json.loads(r.m) for r in spark.createDataFrame(rows, "metadata string, patch string").select(ig.merge_metadata(F.col("metadata"), F.col("patch")).alias("m")).collect()]
    assert got == [{"k": 7, "dream_cycle": True, "n": {"a": 1}, "z": [1, "x"]}, {"a": None}, {"a": 1}, {"a": 1}, {"b": "2"}, {"a": {"y": 2}}]
    patched = spark.createDataFrame(rows[:1], "metadata string, patch string").select(ig.merge_metadata(F.col("metadata"), F.col("patch")).alias("metadata"))
    assert patched.where(fa.key_equals("k", "7")).count() == 1


def test_limits_fail_the_job(spark):
    t = Frames(spark, DIR)
    big = spark.range(1).select(F.lit("view").alias("event_type"), F.repeat(F.lit("x"), (1 << 20) + 1).alias("payload"), now().alias("timestamp"))
    with pytest.raises(Exception, match="over 1 MiB"):
        st.append_events(t.event_log, big).collect()
    with pytest.raises(Exception, match=r"importance must be in \[0, 1\]"):
        st.set_importance(t.facts, spark.createDataFrame([(1, 1.5)], "id long, importance double")).collect()
    with pytest.raises(Exception, match="unknown outcome"):
        st.record_outcomes(t.event_log, spark.createDataFrame([(1, "meh")], "fact_id long, outcome string"), now()).collect()
    with pytest.raises(st.NotFound):
        st.append_event_at(t.event_log, t.scopes, "/no/where", big)
    up = ig.Upcasters()
    up.register("view", 2, lambda p: p)
    with pytest.raises(Exception, match="no step from revision 1"):
        fi.replay(t.event_log, fi.EventFilter(limit=50, event_types=("view",)), up).collect()


def test_bootstrap_batch_runs_once(spark):
    t = Frames(spark, DIR)
    batch = spark.createDataFrame([(0, "one", None, None, None, 4), (1, "one", 0.9, None, None, 4), (2, "two", None, None, None, 4)], "idx long, content string, importance double, t_valid timestamp_ntz, t_invalid timestamp_ntz, scope_id long")
    facts, events, results = st.bootstrap_batch(t.facts, t.event_log, batch, t.tombstones, "new-session", now())
    assert [r.status for r in results.orderBy("idx").collect()] == ["created", "reinforced", "created"]
    assert facts.count() == t.facts.count() + 2 and facts.where("content = 'one'").first().importance == 0.9
    again = st.bootstrap_batch(facts, events, batch, t.tombstones, "new-session", now())
    assert again[0].count() == facts.count() and again[2].count() == 0 and again[1].count() == events.count()


def test_memory(spark, tmp_path):
    m = Memory.create(spark, f"file://{tmp_path}/m")
    got = m.remember(["the cat sleeps on the mat", "dogs bark at night", "cats chase mice"])
    assert [s for _, s in got] == ["created"] * 3
    user = m.remember(["my cat likes tuna"], "user")
    hits, degraded = m.recall("cat")
    assert degraded and {h[0] for h in hits} == {got[0][0], got[2][0], user[0][0]}
    assert m.drain(Broken()) == 0 and m.store.read("embed_queue").agg(F.max("attempts")).first()[0] == 1
    assert m.drain(Embedder(), most=2) == 2
    hits, degraded = m.recall("cat", Embedder().embed_batch(["cat"])[0])
    assert not degraded and len(hits) >= 3
    assert m.set_level(got[0][0], "user") == "/user" and m.store.read("event_log").where("event_type = 'ScopeMoved'").count() == 1
    assert m.forget([got[2][0]], "asked") == 1
    assert got[2][0] not in {h[0] for h in m.recall("cat mice")[0]}
    assert m.remember(["cats chase mice"]) == [(None, "blocked")]
    with pytest.raises(st.NotFound):
        m.set_level(got[2][0], "user")
    with pytest.raises(st.NotFound):
        m.forget([999], "x")


def test_command_line(spark, tmp_path, capsys):
    folder = f"file://{tmp_path}/m"
    cli.main([folder, "remember", "a fact of the shell", "user"])
    cli.main([folder, "recall", "shell"])
    cli.main([folder, "stats"])
    out = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert out[0]["results"][0][1] == "created" and out[1]["results"][0][1] == "a fact of the shell" and out[2]["active"] == 1
    cli.main([folder, "dump", f"{tmp_path}/x.db", "sqlite"])
    cli.main([folder, "forget", str(out[0]["results"][0][0]), "asked"])
    cli.main([folder, "restore", f"{tmp_path}/x.db", "sqlite"])
    cli.main([folder, "active", "5"])
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["content"] == "a fact of the shell"


def test_approximate_search_recall(spark):
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((40, 24))
    x = np.concatenate([c + 0.35 * rng.standard_normal((75, 24)) for c in centres])
    vectors = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, embedding array<float>").cache()
    index = ann.HyperplaneIndex.build(vectors, 24, bits=8, tables=12)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    recalls = []
    for q in (centres[:8] + 0.35 * rng.standard_normal((8, 24))):
        want = set(np.argsort(-(unit @ (q / np.linalg.norm(q))))[:10].tolist())
        got = {r.id for r in index.search(vectors, q.tolist(), 10).collect()}
        recalls.append(len(want & got) / 10)
    assert min(recalls) >= 0.7 and np.mean(recalls) >= 0.9
    # Fewer candidates than k: everything is scored.
    assert index.search(vectors.where("id < 4"), x[0].tolist(), 10).count() == 4
    assert index.notify_expire(vectors.where("id >= 10").select("id")).cells.select("id").distinct().count() == 10
    with pytest.raises(ValueError):
        index.search(vectors, [1.0], 3)


def test_dispatch_rule():
    assert ann.use_index(fi.FactFilter(fact_types=("Semantic",), scopes=(1,)), 50_000)
    assert not ann.use_index(fi.FactFilter(), 49_999)
    for which in (fi.FactFilter(pinned=True), fi.FactFilter("all"), fi.FactFilter(present=("k",)), fi.FactFilter(ids=(1,))):
        assert not ann.use_index(which, 10**6)


def test_wrong_dimension_is_an_error(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0])], "id long, embedding array<float>")
    with pytest.raises(Exception, match="length is not 3 but 2"):
        ann.BruteForce().search(rows, [1.0, 2.0, 3.0], 5).collect()


def test_spaces(spark):
    facts = spark.createDataFrame([(i, f"text {i}", [1.0, 2.0]) for i in range(6)], "id long, content string, embedding array<float>")
    vectors = spark.createDataFrame([], "fact_id long, space_id string, embedding array<float>")
    spaces = spark.createDataFrame([("old", "m1", 2, "active")], "space_id string, name string, dim int, status string").withColumn("created_at", now())
    queue = spark.createDataFrame([(1,), (9,)], "fact_id long")
    half = sp.backfill(facts.where("id < 3"), vectors, "new", Embedder(), 26)
    begun = sp.begin_space(spaces, "new", "letters", 26, now())
    with pytest.raises(ValueError, match="lacks 3"):
        sp.promote_space(begun, half, facts, queue, "new")
    with pytest.raises(ValueError):
        sp.begin_space(begun, "third", "x", 1, now())
    s, v, f, q = sp.reconstruct(spaces, half, facts, queue, "new", Embedder(), now())
    assert {r.space_id: r.status for r in s.collect()} == {"old": "deprecated", "new": "active"}
    assert all(len(r.embedding) == 26 for r in f.collect()) and v.where("space_id = 'old'").count() == 6 and [r.fact_id for r in q.collect()] == [9]
    with pytest.raises(ValueError):
        sp.drop_space(s, v, "new")
    assert sp.drop_space(s, v, "old")[1].count() == 6
    meta = sp.check_identity({}, Embedder())
    assert meta == {"embedding_name": "letters", "embedding_dim": "26"} and sp.check_identity(meta, Embedder()) == meta
    with pytest.raises(sp.IdentityMismatch):
        sp.check_identity({"embedding_name": "other", "embedding_dim": "26"}, Embedder())


def test_snapshots(spark, tmp_path):
    t = Frames(spark, DIR)
    tables = {"facts": t.facts.where("id < 40"), "edges": t.edges.where("id < 40")}
    want = sorted(map(str, tables["facts"].collect()))
    for codec in sn.CODECS:
        sn.dump(tables, f"{tmp_path}/{codec}", codec)
        back = sn.restore(spark, f"{tmp_path}/{codec}")
        assert back["facts"].dtypes == tables["facts"].dtypes and sorted(map(str, back["facts"].collect())) == want
    part = next((tmp_path / "gzip" / "facts").glob("*.gz"))
    assert "content_hash" in json.loads(gzip.open(part, "rt").readline())
    sn.dump_sqlite(tables, f"{tmp_path}/x.db")
    assert sorted(map(str, sn.restore_sqlite(spark, f"{tmp_path}/x.db")["facts"].collect())) == want
    assert sqlite3.connect(f"{tmp_path}/x.db").execute("SELECT count(*) FROM facts").fetchall() == [(40,)]
    with pytest.raises(ValueError, match="no whole dump"):
        sn.restore(spark, f"{tmp_path}/nothing")
    (tmp_path / "json" / "head.json").write_text('{"version": 9, "codec": "json", "tables": {}}')
    (tmp_path / "json" / ".head.json.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError, match="version 9"):
        sn.restore(spark, f"{tmp_path}/json")


def test_archives(spark, tmp_path):
    t = Frames(spark, DIR)
    empty = spark.createDataFrame([], sn.MANIFEST)
    assert sn.archive(t.facts, t.edges, t.tombstones, empty, f"{tmp_path}/a", now(), days=10, least=10_000)[2].count() == 0
    facts, edges, manifest = sn.archive(t.facts, t.edges, t.tombstones, empty, f"{tmp_path}/a", now(), days=10, least=1)
    row = manifest.first()
    assert facts.count() + row.fact_count == t.facts.count() and row.fact_count > 0
    gone = t.facts.join(facts.select("id"), "id", "left_anti").select("id")
    assert edges.join(gone, edges.source_fact_id == gone.id, "left_semi").count() == 0
    assert sn.verify(spark, manifest, f"{tmp_path}/a") == [(row.id, None)]
    bad = spark.createDataFrame([("1", "../x.pak", "", 1, 1, 1, None, None), ("2", "y.pak", "", 1, 1, 1, None, None), ("3", row.pak_path, "0-0-0", 1, 1, 1, None, None)], sn.MANIFEST)
    assert [e for _, e in sn.verify(spark, bad, f"{tmp_path}/a")] == ["path leaves the archive", "not found", "content differs"]
    back, left = sn.restore_archive(spark, facts, manifest, f"{tmp_path}/a", row.id)
    assert sorted(map(str, back.collect())) == sorted(map(str, t.facts.collect())) and left.count() == 0


def _turn(kind, uuid, parent, at, text):
    return json.dumps({"type": kind, "sessionId": "s1", "timestamp": f"2026-03-19T14:00:{at:02d}Z", "uuid": uuid, "parentUuid": parent, "message": {"role": kind, "content": text}})


def test_bootstrap_of_a_folder(spark, tmp_path):
    logs, notes = tmp_path / "logs" / "deep", tmp_path / "notes"
    logs.mkdir(parents=True)
    notes.mkdir()
    lines = [_turn("user", "a", None, 1, "we decided to use postgres because of a bug"), _turn("assistant", "b", "a", 2, "the fix: always use transactions"), "broken {", _turn("user", "c", "b", 3, "thanks")]
    (logs / "x.jsonl").write_text("\n".join(lines))
    (notes / "n.md").write_text("---\ntype: feedback\n---\nPrefer short answers.\n")
    t = Frames(spark, DIR)
    facts, events, report = bo.bootstrap_sessions(spark, str(tmp_path / "logs"), t.facts, t.event_log, t.tombstones, now())
    r = report.first()
    assert r.created > 0 and facts.count() == t.facts.count() + r.created and 0 < r.mean_importance <= 1
    again = bo.bootstrap_sessions(spark, str(tmp_path / "logs"), facts, events, t.tombstones, now())
    assert again[2].first().created == 0 and again[0].count() == facts.count()
    noted = bo.bootstrap_notes(spark, str(notes), facts, events, t.tombstones, now())
    assert noted[2].first().created == 1 and noted[0].where("content = 'Prefer short answers.'").count() == 1
    assert bo.bootstrap_sessions(spark, str(notes), facts, events, t.tombstones, now())[2].first().created == 0


def test_project_keys(spark):
    rows = [("git@github.com:Own/Repo.git", "/x"), ("https://me:pw@host.org/a/b.git/", "/x"), (None, "C:\\w\\Proj\\"), ("", "/home/y/Thing")]
    got = [r.k for r in spark.createDataFrame(rows, "u string, f string").select(bo.project_key(F.col("u"), F.col("f")).alias("k")).collect()]
    assert got == ["github.com/own/repo", "host.org/a/b", "proj", "thing"]
