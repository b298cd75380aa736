"""Operators that SQL does not express, against direct models; text functions on golden cases."""

import hashlib
import json
import math
import sqlite3

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recollect.functions import paths as pa
from recollect.functions import redaction as rd
from recollect.functions import stems as sm
from recollect.functions import text as tx
from recollect.operators import apply as ap
from recollect.operators import consolidate as co
from recollect.operators import facts as fa
from recollect.operators import retrieval as rt
from recollect.plans import catalog
from recollect.plans import memory_query as mq
from recollect.plans.tables import Frames, now
from recollect.sources import sessions as ss
from recollect.streaming import activity as ac


PAT, HEX, ODD = "ghp_" + "0123456789abcdefghij" * 2, "a3f1b2c4d5e6f7a8" * 2, "aGVsbG8x9Zk3Qw7Lp2Rt5Yv8Bn1Cx4Df6"


def test_redaction_cases():
    cases = {
        f"api_key={HEX}": "api_key=[REDACTED:hex-secret]",
        f"api_key:\n{HEX}": None,
        f"monkey {HEX}": None,
        f"commit {HEX} merged": None,
        f"the {ODD} here": "the [REDACTED:high-entropy] here",
        "amqp://guest:p@ss@rabbit/x": "amqp://guest:[REDACTED:connection-string-password]@rabbit/x",
        f"https://x:{PAT}@host/r": "https://x:[REDACTED:github-pat]@host/r",
        f"see https://e.org/x?token={PAT} now": None,
        f"svc,https://e.org,{PAT}": "svc,https://e.org,[REDACTED:github-pat]",
        "key me_" + "A" * 32: "key [REDACTED:machine-token]",
        "https://h/x?t=me_" + "0" * 32: "https://h/x?t=[REDACTED:machine-token]",
        "x -----BEGIN RSA KEY-----\r\ny": "x [REDACTED:private-key-header]\r\ny",
        "x sk-" + "é" * 8 + " y": None,
        "x sk-" + "é" * 9 + " y": "x [REDACTED:openai-key] y",
        "Region: SG.1 ok, eyJournal": None,
        "task-sk-nope npm_config_user_agent_name": None,
        "mail a.b@example.com stays": None,
    }
    for text, want in cases.items():
        assert rd.redact_once(text)[0] == (text if want is None else want)
    assert rd.redact(f"api_key={HEX}qWeRtYuIoPaSdFgHjKl9876") == "api_key=[REDACTED:hex-secret][REDACTED:high-entropy]"
    assert rd.redact("some words x", ("words", "x")) == "some [REDACTED:denylist] x"
    assert rd.redact_json({"api_key": HEX, "n": [1, HEX]}) == {"api_key": "[REDACTED:hex-secret]", "n": [1, HEX]}


def test_captured_calls():
    assert rd.capture('{"a":1}', "x" * 600) == ('{"a":1}', "x" * 512, False)
    assert rd.capture('{"a":1}', "out", "~/.kube/config") == ('{"sensitive_path": "~/.kube/config"}', None, True)
    assert rd.capture(None, "x" * (1 << 20) + "y") == ("null", "[omitted: 1048577 bytes]", False)


def test_sensitive_paths(spark):
    secret = (".ENV", "host.env", "~/.kube/config", "a/../.aws/credentials", "/x/.ssh/work", "/etc/shadow", "secrets/db.yaml", "C:\\x\\id_rsa", "tls.crt", "token.json")
    plain = (".env.example", "/x/.ssh/config", "/x/.ssh/id_rsa.pub", "src/token.ts", "secrets/readme.md", "", "/etc/passwd")
    rows = spark.createDataFrame([(p,) for p in (*secret, *plain, None)], "p string")
    got = {r.p: r.hit for r in rows.select("p", pa.sensitive_path(F.col("p")).alias("hit")).collect()}
    assert all(got[p] for p in secret) and not any(got[p] for p in plain) and got[None] is None
    own = spark.createDataFrame([("/home/x/.config/Keys/a.md",), ("/home/x/.config/keys2/a.md",)], "p string").select(pa.sensitive_path(F.col("p"), (".config/keys",)).alias("hit")).collect()
    assert [r.hit for r in own] == [True, False]


def _entry(kind, uuid, parent, at, content=None, result=None):
    return {"type": kind, "sessionId": "s", "timestamp": f"2026-03-19T14:00:{at:02d}Z", "uuid": uuid, "parentUuid": parent, "message": {"role": kind, "content": content or []}, **({"toolUseResult": result} if result else {})}


def test_session_logs(spark, tmp_path):
    said = lambda x: [{"type": "text", "text": x}]
    use = [{"type": "tool_use", "name": "Bash", "input": {"command": "cargo test"}}]
    log = [
        _entry("user", "u1", None, 0, said("Fix the parser")),
        _entry("assistant", "a1", "u1", 1, said("I chose a bound") + use),
        _entry("user", "r1", "a1", 2, None, {"stdout": "test result: ok. 42 passed", "stderr": ""}),
        _entry("user", "u2", "zz", 3, said("thanks")),
        _entry("progress", "x", None, 4),
        _entry("assistant", "a2", "lost", 5, said("done")),
        _entry("user", "u3", None, 6, said("no reply")),
    ]
    (tmp_path / "log.jsonl").write_text("\n".join([*map(json.dumps, log), "{broken"]))
    turns = ss.reconstruct(ss.read_sessions(spark, str(tmp_path)))
    got = [(r.user_text, r.assistant_text, [(x.tool, x.command, x.stdout) for x in r.calls]) for r in turns.orderBy("at").collect()]
    assert got == [("Fix the parser", "I chose a bound", [("Bash", "cargo test", "test result: ok. 42 passed")]), ("thanks", "done", [])]
    out = ss.session_outcomes(turns)
    r = out.first()
    assert (r.outcome, r.has_commit, r.tests_passed, r.error_loop, r.interrupted, r.mood) == ("success", False, True, False, False, "positive")
    facts = {(r.category, r.fact_type, r.importance, tuple(r.matched_keywords)) for r in ss.extract_facts(turns, out).collect()}
    assert facts == {("bug", "Procedural", 0.7, ("fix",)), ("decision", "Semantic", 0.6, ("chose",))}


def test_error_loops(spark):
    call = lambda e, i=False: ("Bash", "x", "", e, i)
    rows = [("a", 0, 0, "go", [call("boom"), call(" boom")]), ("a", 1, 1, "go", [call("boom")]), ("b", 0, 0, "undo it", [call("boom"), call(""), call("boom"), call("boom")]), ("c", 0, 0, "go", [call("", True)]), ("c", 1, 1, "go", [])]
    turns = spark.createDataFrame(rows, f"session_id string, at int, position int, user_text string, calls array<{ss.CALL}>")
    got = {r.session_id: (r.outcome, r.error_loop, r.interrupted) for r in ss.session_outcomes(turns).collect()}
    assert got == {"a": ("failure", True, False), "b": ("failure", False, False), "c": ("failure", False, True)}


def test_notes(spark, tmp_path):
    (tmp_path / "project_x_2026_06_14.md").write_text('---\nname: "N"\nmetadata:\n  type: Feedback\n---\n body \n')
    (tmp_path / "plain.md").write_text("---\nnot closed\n")
    got = {r.file.rsplit("/", 1)[1]: r for r in ss.read_notes(spark, str(tmp_path)).collect()}
    a, b = got["project_x_2026_06_14.md"], got["plain.md"]
    assert (a.name, a.type, a.fact_type, str(a.date)[:10], a.body) == ("N", "feedback", "Procedural", "2026-06-14", "body")
    assert (b.name, b.fact_type, b.body) == (None, "Semantic", "---\nnot closed")


@settings(max_examples=50, deadline=None)
@given(st.text(max_size=80))
def test_redaction_is_a_fixed_point(s):
    once = rd.redact(s)
    assert rd.redact(once) == once


def _fts(rows):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(content, tokenize = 'porter unicode61')")
    con.executemany("INSERT INTO f(rowid, content) VALUES (?, ?)", rows)
    return con


WORDS = "caresses ponies ties agreed eed plastered motoring conflated sized hopping falling hissing failing happy sky relational conditional hesitancy digitizer radically vilely predication feudalism decisiveness hopefulness sensibility formative electricity goodness revival inference adjustable adoption homologous probate rate cease control roll straße naïve bus dying generalizations"


def test_stems_are_those_of_a_full_text_index():
    con = _fts([(1, WORDS)])
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(f, 'row')")
    assert sorted(r[0] for r in con.execute("SELECT term FROM v")) == sorted(set(sm.stems(WORDS)))


def test_lexical_search_is_that_of_a_full_text_index(spark):
    rng = np.random.default_rng(4)
    vocabulary = WORDS.split()[:12]
    rows = [(i, " ".join(rng.choice(vocabulary, int(rng.integers(0, 14))))) for i in range(80)]
    con = _fts(rows)
    index = rt.lexical_index(spark.createDataFrame(rows, "id long, content string"))
    queries = ["pony", "happy sizing", "happy OR tied", "(pony AND happi) OR sky", "pony NOT happy sky", '"ponies ties"', 'motor* "sized hopping"', "hop*", "pony + tie OR sky", "a AND", "zzz", '""', '"ponies ties" OR tie', rt.any_word("Ponies, ponies or sky?")]
    for q in queries:
        try:
            want = {r: round(-s, 5) for r, s in con.execute("SELECT rowid, bm25(f) FROM f WHERE f MATCH ?", (q,))}
        except sqlite3.OperationalError:
            want = {}
        assert {r.id: round(r.score, 5) for r in rt.lexical_search(index, q).collect()} == want, q


def test_queries_that_do_not_fit_are_refused():
    for parts in ({"mode": "hybrid", "text": "x"}, {"mode": "vector"}, {"scope": ("near", "/")}, {"mode": "fuzzy", "text": "x"}, {"valid_at": 1, "period": (1, 2)}):
        with pytest.raises(ValueError):
            mq.MemoryQuery(**parts).checked_mode()
    assert mq.MemoryQuery(text="x", embedding=[1.0]).checked_mode() == "hybrid" and mq.MemoryQuery().checked_mode() is None


def test_text_queries_rank_valid_facts_first(spark):
    t = Frames(spark, "/root/testdata/sf0.001")
    got = catalog.QUERIES["query_by_text"](spark, t.dir).collect()
    scored = rt.lexical_search(rt.word_index(t.facts), rt.any_word(" ".join(catalog.WORDS)))
    asia = mq.scope_set(t.scopes, "inherited", "/ASIA")
    want = rt.ranked(scored.join(t.facts.where(fa.active()).join(asia, "scope_id", "left_semi").select("id"), "id", "left_semi"), 30)
    live = {r.id for r in t.facts.where(fa.as_of(now())).select("id").collect()}
    assert [(r.id, r.score) for r in got] == [(r.id, r.score) for r in want.orderBy("rank").collect() if r.id in live][:10]
    both = catalog.QUERIES["query_hybrid_with_archives"](spark, t.dir).collect()
    assert len(both) == 10 and {r.match_type for r in both} <= {"both", "fts", "vector", "archive"}


def test_archives_are_verified(spark, tmp_path):
    for name in ("a.pak", "b.pak"):
        (tmp_path / name).write_bytes(name.encode())
    sha = hashlib.sha256(b"a.pak").hexdigest()
    manifest = spark.createDataFrame([(1, "a.pak", sha), (2, "b.pak", sha), (3, "c.pak", sha), (4, "../a.pak", sha), (5, "/a.pak", sha)], "id long, pak_path string, sha256 string")
    got = {r.id: r.error for r in ap.verify_archives(manifest, ss.verify_archive(spark, str(tmp_path))).collect()}
    assert got == {1: None, 2: "hash differs", 3: "file not found", 4: "path leaves the archive", 5: "path leaves the archive"}


def test_skipped_pairs_keep_their_edges(spark):
    now_ = F.expr("timestamp_ntz'2024-02-10 00:00:00'")
    old = "timestamp_ntz'2024-01-01 00:00:00'"
    facts = spark.sql(f"SELECT id, 0.5D AS importance_score, IF(id = 4, {old}, NULL) AS t_expired FROM range(1, 5)")
    edges = spark.sql("SELECT id, id AS source_fact_id, 99L AS target_fact_id, CAST(NULL AS timestamp_ntz) AS t_expired FROM range(1, 5)")
    plan = spark.createDataFrame([(1, 2, 0.9), (3, 4, 0.9)], "loser long, survivor long, score double")
    f, e, done = ap.apply_dedup(facts, edges, plan, now_)
    assert {r.id for r in f.where("t_expired = " + "timestamp_ntz'2024-02-10 00:00:00'").collect()} == {1}
    assert {r.id for r in e.where("t_expired is not null").collect()} == {1}
    assert {(r.loser, r.done) for r in done.collect()} == {(1, True), (3, False)}


def test_bytes_are_cut_between_characters():
    assert tx.cut_bytes("éé", 3) == "é"
    assert tx.cut_bytes("abc", 2, "...") == "ab..."


def test_entropy():
    assert rd.entropy("aaaa") == 0 and math.isclose(rd.entropy("abcd"), 2.0)


def _pairs(spark, x, threshold):
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, embedding array<float>")
    return co.similar_pairs(df, threshold), df


def test_dedup_plan_follows_the_greedy_order(spark):
    rng = np.random.default_rng(1)
    x = np.repeat(rng.standard_normal((6, 16)), 4, axis=0) + rng.standard_normal((24, 16)) * 0.15
    pairs, _ = _pairs(spark, x, 0.9)
    found = {(r.a, r.b) for r in pairs.collect()}
    prior = {i: round((i * 7 % 10) / 10, 1) for i in range(24)}
    facts = spark.createDataFrame([(i, prior[i], i / 24) for i in range(24)], "id long, importance double, importance_score double")
    got = {(r.loser, r.survivor) for r in co.dedup_plan(pairs, facts).collect()}
    gone, want = set(), set()
    for new in range(24):
        for old in range(24):
            if new in gone:
                break
            if old in gone or (min(new, old), max(new, old)) not in found:
                continue
            lose, win = (new, old) if (prior[new], -new) < (prior[old], -old) else (old, new)
            gone.add(lose)
            want.add((lose, win))
    assert got == want and want


def test_hyperplane_buckets_find_most_pairs(spark):
    rng = np.random.default_rng(2)
    x = np.repeat(rng.standard_normal((40, 32)), 2, axis=0) + rng.standard_normal((80, 32)) * 0.1
    exact, df = _pairs(spark, x, 0.95)
    want = {(r.a, r.b) for r in exact.collect()}
    got = {(r.a, r.b) for r in co.similar_pairs(df, 0.95, exact=False).collect()}
    assert got <= want and len(got) >= 0.9 * len(want) and len(want) >= 30


def test_empty_query_finds_nothing(spark):
    facts = spark.createDataFrame([(1, "a b")], "id long, content string")
    assert rt.bm25(rt.word_index(facts), []).count() == 0
    assert rt.terms("The the, cat!") == ["the", "cat"]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{(i * 7) % 60:02d}:00", "s", "t", "h", "ok", 1) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, ts string, session_id string, tool_name string, args_hash string, outcome_class string, scope_id long").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    batch = {(r.first_seen, r.last_seen, r.occurrence_count) for r in ac.fold(df, 100).collect()}
    src = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = ac.stream(src, 100).writeStream.outputMode("update").format("memory").queryName("folded").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.first_seen, r.last_seen, r.occurrence_count) for r in spark.table("folded").collect()} == batch
    # With a bound on lateness the same runs come out, and their state ends once the watermark has passed them.
    q = ac.stream(src, 100, "2 hours").writeStream.outputMode("update").format("memory").queryName("bounded").option("checkpointLocation", str(tmp_path / "cp2")).start()
    q.processAllAvailable()
    last = df.limit(1).select((F.col("id") + 99).alias("id"), F.expr("timestamp'2024-01-02 00:00:00'").alias("ts"), F.lit("z").alias("session_id"), *df.columns[3:])
    for _ in range(2):
        last.write.mode("append").parquet(str(tmp_path / "in"))
        q.processAllAvailable()
    left = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    q.stop()
    assert {(r.first_seen, r.last_seen, r.occurrence_count) for r in spark.table("bounded").where("session_id = 's'").collect()} == batch and left <= 1


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"type":"user","sessionId":"s","message":{"role":"user","content":"hi"}}\nbroken\n')
    assert [r.sessionId for r in ss.read_sessions(spark, str(tmp_path)).collect()] == ["s"]
    (tmp_path / "n.md").write_text("---\nname: x\ndescription: y\n---\nbody\n")
    assert [(r.name, r.body) for r in ss.read_notes(spark, str(tmp_path)).collect()] == [("x", "body")]
    (tmp_path / "f.json").write_text('{"content":"a","base_importance":0.4}\n{"content":"b","base_importance":3}\n')
    ok, bad = ss.read_facts(spark, str(tmp_path / "f.json"))
    assert (ok.count(), bad.count()) == (1, 1)
    ss.write_snapshot({"facts": spark.range(3)}, str(tmp_path / "snap"))
    assert ss.read_snapshot(spark, str(tmp_path / "snap"))["facts"].count() == 3
    assert ss.verify_archive(spark, str(tmp_path / "snap/facts")).count() >= 1
