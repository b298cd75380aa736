"""Queries of filters, writes, graph upkeep, the maintenance cycle, spaces and snapshots, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.operators import ann
from recollect.operators import consolidate as co
from recollect.operators import cycle as cy
from recollect.operators import facts as fa
from recollect.operators import filters as fi
from recollect.operators import graph as gr
from recollect.operators import ingest as ig
from recollect.operators import inspect as ins
from recollect.operators import spaces as sp
from recollect.operators import store as st
from recollect.operators.shared import shared_path
from recollect.plans.catalog import _CL, _DEG, _IMP, _Q, ACTIVE, ASOF, QUERY_VECTOR, _ids, query
from recollect.plans.tables import Frames, now
from recollect.sources import bootstrap as bo
from recollect.sources import snapshots as sn
from recollect.streaming import activity as ac

c = F.col
_ntz = lambda x: F.expr(f"timestamp_ntz'{x}'")
_MAX = "(SELECT max(id) FROM facts)"
_SHA = lambda x: f"substr(sha256({x}), 1, 32)"


def _table(t: Frames, rows: list[tuple], schema: str) -> DataFrame:
    return t.spark.createDataFrame(rows, schema)


# Filters
query(
    "facts_filtered",
    f"SELECT id FROM facts WHERE {ASOF} AND fact_type IN ('Semantic', 'Episodic') AND scope_id BETWEEN 10 AND 20 AND NOT is_pinned AND len(embedding) > 0 AND NOT json_exists(metadata, '$.dream_cycle') AND json_extract_string(metadata, '$.k') IS NOT NULL",
    lambda t: fi.FactFilter("as_of", now(), fact_types=("Semantic", "Episodic"), scopes=tuple(range(10, 21)), pinned=False, has_vector=True, absent=("dream_cycle",), present=("k",)).apply(t.facts).select("id"),
)
query(
    "facts_filtered_by_tables",
    f"{_CL} SELECT id FROM facts WHERE {ACTIVE} AND scope_id IN (SELECT id FROM cl WHERE ancestor = 4) AND id IN (SELECT vec_id FROM embeddings) AND json_extract_string(metadata, '$.k') = '7'",
    lambda t: fi.FactFilter(scopes=gr.scope_ids(t.scopes, 4, "subtree"), ids=t.source("embeddings").select(c("vec_id").alias("id")), equals={"k": "7"}).apply(t.facts).select("id"),
)
_EVENTS = lambda: fi.EventFilter(event_types=("view", "purchase", "click"), since=_ntz("2024-01-02 00:00:00"), after_id=40, order="timestamp", descending=True, limit=40)
_EVENTS_SQL = "event_type IN ('view', 'purchase', 'click') AND timestamp >= timestamp '2024-01-02' AND id > 40"
query("events_by_filter", f"SELECT id, timestamp, event_type FROM event_log WHERE {_EVENTS_SQL} ORDER BY timestamp DESC, id DESC LIMIT 40", lambda t: _EVENTS().apply(t.event_log).select("id", "timestamp", "event_type"))
query("event_filter_count", f"SELECT count(*) AS n FROM event_log WHERE {_EVENTS_SQL}", lambda t: _EVENTS().count(t.event_log))
_UP = ig.Upcasters()
_UP.register("view", 1, lambda p: F.concat(F.lit("2|"), p))
_UP.register("view", 2, lambda p: F.concat(F.lit("3|"), p))
_UP.register("click", 1, lambda p: F.upper(p))
query(
    "replay_upcast",
    "SELECT id, event_type, CASE event_type WHEN 'view' THEN '3|2|' || payload WHEN 'click' THEN upper(payload) ELSE payload END AS payload, CASE event_type WHEN 'view' THEN 3 WHEN 'click' THEN 2 ELSE 1 END AS event_revision FROM event_log WHERE session_id IN ('s1', 's2', 's3') ORDER BY timestamp, id LIMIT 500",
    lambda t: fi.replay(t.event_log, fi.EventFilter(sessions=("s1", "s2", "s3"), order="timestamp", limit=500), _UP).select("id", "event_type", "payload", "event_revision"),
)
query("over_limit", "SELECT id, 'content' AS field, strlen(content)::INTEGER AS bytes FROM facts WHERE strlen(content) > 3000 UNION ALL SELECT id, 'metadata', strlen(metadata)::INTEGER FROM facts WHERE strlen(metadata) > 10", lambda t: fi.over_limit(t.facts, {"content": 3000, "metadata": 10}))
query("enum_parse", "SELECT id, CASE WHEN upper(fact_type) = 'EPISODIC' THEN 'Episodic' WHEN upper(fact_type) = 'SEMANTIC' THEN 'Semantic' END AS kind FROM facts", lambda t: t.facts.select("id", st.enum(F.upper("fact_type"), ("Episodic", "Semantic")).alias("kind")))
query("config_after_write", "SELECT * FROM (VALUES ('a', '1'), ('b', '9'), ('d', '4')) AS t(key, value)", lambda t: st.set_config(_table(t, [("a", "1"), ("b", "2")], "key string, value string"), {"b": "9", "d": "4"}))

# Writes of facts
_NEW = "SELECT doc_id AS idx, CASE WHEN doc_id % 19 = 0 THEN NULL ELSE concat('new ', CAST(doc_id - doc_id % 3 AS STRING), ' ', substr(text, 1, 20)) END AS content, CASE WHEN doc_id % 14 = 0 THEN CAST(1.5 AS DOUBLE) WHEN doc_id % 4 = 0 THEN NULL ELSE CAST(0.25 AS DOUBLE) END AS importance, CAST(NULL AS @ts) AS t_valid, CAST(NULL AS @ts) AS t_invalid, 'Semantic' AS fact_type, CAST(10 + doc_id % 4 AS BIGINT) AS scope_id FROM "
_new = lambda t: t.spark.sql(_NEW.replace("@ts", "TIMESTAMP_NTZ") + "{d}", d=t.source("documents"))
_B = "WITH b AS (" + _NEW.replace("@ts", "TIMESTAMP") + f"documents), s AS (SELECT *, CASE WHEN content IS NULL OR importance NOT BETWEEN 0 AND 1 THEN 'invalid' WHEN {_SHA('content')} IN (SELECT content_hash FROM tombstones) THEN 'blocked' ELSE 'created' END AS status FROM b)"
query("insert_facts", f"{_B} SELECT {_MAX} + 1 + idx AS id, {_SHA('content')} AS content_hash, coalesce(importance, 0.5) AS importance, coalesce(importance, 0.5) AS importance_score, 0::BIGINT AS access_count, @now AS t_created, scope_id, false AS is_pinned FROM s WHERE status = 'created'", lambda t: st.insert(t.facts, _new(t), t.tombstones, now())[0].join(t.facts.select("id"), "id", "left_anti").select("id", "content_hash", "importance", "importance_score", c("access_count").cast("long").alias("access_count"), "t_created", "scope_id", "is_pinned"))
query("insert_results", f"{_B} SELECT idx, CASE WHEN status = 'created' THEN {_MAX} + 1 + idx END AS id, status FROM s", lambda t: st.insert(t.facts, _new(t), t.tombstones, now())[1])
query("insert_deferred_queue", f"{_B} SELECT fact_id, attempts::BIGINT AS attempts, next_attempt_at FROM embed_queue UNION ALL SELECT {_MAX} + 1 + idx, 0, @now FROM s WHERE status = 'created'", lambda t: st.insert_deferred(t.facts, t.embed_queue, _new(t), t.tombstones, now())[1].select("fact_id", c("attempts").cast("long").alias("attempts"), "next_attempt_at"))
query("insert_deferred_vectors", f"{_B} SELECT count(*) AS n FROM s WHERE status = 'created'", lambda t: st.insert_deferred(t.facts, t.embed_queue, _new(t), t.tombstones, now())[0].join(t.facts.select("id"), "id", "left_anti").where("size(embedding) = 0").agg(F.count(F.lit(1)).alias("n")))
_REINFORCED = f"{_B}, o AS (SELECT content_hash, scope_id, min(id) AS old FROM facts WHERE {ACTIVE} GROUP BY ALL), f AS (SELECT *, {_SHA('content')} AS h, min(CASE WHEN status = 'created' THEN idx END) OVER (PARTITION BY {_SHA('content')}, scope_id) AS first FROM s)"
_again = lambda t: _new(t).unionByName(t.facts.where("id % 10 = 4 and content is not null").select((c("id") + 100_000).alias("idx"), "content", F.lit(0.75).alias("importance"), F.lit(None).cast("timestamp_ntz").alias("t_valid"), F.lit(None).cast("timestamp_ntz").alias("t_invalid"), "fact_type", "scope_id"))
_AGAIN = _B.replace("documents), s AS", "documents UNION ALL SELECT id + 100000, content, 0.75::DOUBLE, NULL, NULL, fact_type, scope_id FROM facts WHERE id % 10 = 4 AND content IS NOT NULL), s AS")
_REINFORCED = _REINFORCED.replace(_B, _AGAIN)
query("reinforce_results", f"{_REINFORCED} SELECT idx, CASE WHEN status = 'created' THEN coalesce(old, {_MAX} + 1 + first) END AS id, CASE WHEN status <> 'created' THEN status WHEN old IS NULL AND idx = first THEN 'created' ELSE 'reinforced' END AS status FROM f LEFT JOIN o ON o.content_hash = f.h AND o.scope_id = f.scope_id", lambda t: st.reinforce_batch(t.facts, _again(t), t.tombstones, now())[1])
query("reinforce_facts", f"{_REINFORCED}, n AS (SELECT coalesce(old, {_MAX} + 1 + first) AS id, count(*) - CASE WHEN old IS NULL THEN 1 ELSE 0 END AS times, max(coalesce(importance, 0.5)) AS prior FROM f LEFT JOIN o ON o.content_hash = f.h AND o.scope_id = f.scope_id WHERE status = 'created' GROUP BY 1, old), r AS (SELECT id, access_count, importance FROM facts UNION ALL SELECT {_MAX} + 1 + f.idx, 0, coalesce(f.importance, 0.5) FROM f LEFT JOIN o ON o.content_hash = f.h AND o.scope_id = f.scope_id WHERE f.status = 'created' AND o.old IS NULL AND f.idx = f.first) SELECT r.id, (r.access_count + coalesce(times, 0))::BIGINT AS access_count, CASE WHEN times > 0 THEN greatest(r.importance, prior) ELSE r.importance END AS importance FROM r LEFT JOIN n USING (id)", lambda t: st.reinforce_batch(t.facts, _again(t), t.tombstones, now())[0].select("id", c("access_count").cast("long").alias("access_count"), "importance"))
_third = lambda t: t.facts.where("id % 3 = 1").select("id")
query("touch_facts", "SELECT id, (access_count + CASE WHEN id % 3 = 1 THEN 1 ELSE 0 END)::BIGINT AS access_count, CASE WHEN id % 3 = 1 THEN @now ELSE last_accessed END AS last_accessed FROM facts", lambda t: st.touch(t.facts, _third(t), now()).select("id", c("access_count").cast("long").alias("access_count"), "last_accessed"))
query("pin_facts", "SELECT id, is_pinned OR id % 3 = 1 AS is_pinned FROM facts", lambda t: st.set_pin(t.facts, _third(t), True).select("id", "is_pinned"))
query("unpin_facts", "SELECT id, is_pinned AND id % 3 <> 1 AS is_pinned FROM facts", lambda t: st.set_pin(t.facts, _third(t), False).select("id", "is_pinned"))
query("importance_updates", "SELECT id, CASE WHEN id % 3 = 1 THEN (id % 8) / 8.0::DOUBLE ELSE importance END AS importance FROM facts", lambda t: st.set_importance(t.facts, _third(t).select("id", ((c("id") % 8) / 8.0).alias("importance"))).select("id", "importance"))
query("score_updates", f"WITH {_DEG}, {_IMP} SELECT f.id, coalesce(imp.score, f.importance_score) AS importance_score FROM facts f LEFT JOIN imp ON imp.id = f.id", lambda t: st.set_scores(t.facts, co.importance(t.facts, t.edges, now()).select("id", "score")).select("id", "importance_score"))
query("metadata_patches", """SELECT id, CASE WHEN id % 3 <> 1 THEN metadata WHEN id % 5 = 0 THEN '{"dream_cycle":true,"seen":[1]}' WHEN id % 6 = 0 THEN '{"k":null,"seen":[1]}' ELSE concat('{"k":', id % 10, ',"seen":[1]}') END AS metadata FROM facts""", lambda t: st.patch_metadata(t.facts, _third(t).withColumn("patch", F.lit('{"seen":[1]}'))).select("id", "metadata"))
query("surfaced_stamps", "SELECT id, coalesce(surfaced_at, @now) AS surfaced_at FROM facts WHERE id % 3 = 1", lambda t: st.stamp_surfaced(t.facts, _third(t), now())[1])
query("surfaced_facts", "SELECT id, CASE WHEN id % 3 = 1 THEN coalesce(surfaced_at, @now) ELSE surfaced_at END AS surfaced_at FROM facts", lambda t: st.stamp_surfaced(t.facts, _third(t), now())[0].select("id", "surfaced_at"))
_moves = lambda t: t.facts.where("id % 3 = 1").select("id", F.lit(13).alias("from_scope"), F.lit(2).alias("to_scope"))
query("scope_moves", "SELECT id, CASE WHEN id % 3 = 1 AND scope_id = 13 AND t_expired IS NULL THEN 2 ELSE scope_id END::BIGINT AS scope_id FROM facts", lambda t: st.move_scope(t.facts, t.event_log, _moves(t), now())[0].select("id", "scope_id"))
query("scope_move_events", """SELECT concat('{"fact_id":', id, ',"from_scope":13,"to_scope":2}') AS payload, 2::BIGINT AS scope_id, @now AS timestamp FROM facts WHERE id % 3 = 1 AND scope_id = 13 AND t_expired IS NULL""", lambda t: st.move_scope(t.facts, t.event_log, _moves(t), now())[1].where("event_type = 'ScopeMoved'").select("payload", "scope_id", "timestamp"))
query("hard_deleted_facts", "SELECT id FROM facts WHERE id % 3 <> 1", lambda t: st.delete_facts(t.facts, t.edges, _third(t))[0].select("id"))
query("hard_deleted_edges", "SELECT id FROM edges WHERE source_fact_id NOT IN (SELECT id FROM facts WHERE id % 3 = 1) AND target_fact_id NOT IN (SELECT id FROM facts WHERE id % 3 = 1)", lambda t: st.delete_facts(t.facts, t.edges, _third(t))[1].select("id"))
# Events and counters
_more = lambda t: t.event_log.where("id % 7 = 3").select("event_type", F.concat(F.lit("x"), F.lpad(c("id").cast("string"), 9, "0")).alias("payload"), "session_id", "scope_id", (c("timestamp") + F.expr("INTERVAL 1 YEAR")).alias("timestamp"))
query("append_events", "WITH m AS (SELECT max(id) AS top FROM event_log), n AS (SELECT *, row_number() OVER (ORDER BY timestamp, lpad(id::VARCHAR, 9, '0')) AS r FROM event_log WHERE id % 7 = 3) SELECT top + r AS id, event_type, 'x' || lpad(id::VARCHAR, 9, '0') AS payload, session_id, top + r AS sequence_id FROM n, m", lambda t: st.append_events(t.event_log, _more(t)).join(t.event_log.select("id"), "id", "left_anti").select("id", "event_type", "payload", "session_id", "sequence_id"))
query("append_event_at_path", "SELECT 4::BIGINT AS scope_id, count(*) AS n FROM event_log WHERE id % 7 = 3", lambda t: st.append_event_at(t.event_log, t.scopes, "/ASIA", _more(t).drop("scope_id")).join(t.event_log.select("id"), "id", "left_anti").groupBy("scope_id").agg(F.count(F.lit(1)).alias("n")))
query("record_outcomes", """SELECT concat('{"fact_id":', fact_id, ',"outcome":"', outcome, '"}') AS payload FROM outcomes WHERE outcome <> 'Other' AND id % 9 = 0""", lambda t: st.record_outcomes(t.event_log, t.outcomes.where("outcome <> 'Other' and id % 9 = 0").select("fact_id", F.lower("outcome").alias("outcome")), now()).where("event_type = 'OutcomeSignal'").select("payload"))
query("counters_added", "SELECT event_type AS rule, (count(*) + CASE WHEN event_type = 'view' THEN 5 ELSE 0 END)::BIGINT AS n FROM event_log GROUP BY event_type UNION ALL SELECT 'fresh', 2", lambda t: st.add_counts(t.event_log.groupBy(c("event_type").alias("rule")).agg(F.count(F.lit(1)).alias("n")), _table(t, [("view", 5), ("fresh", 2)], "rule string, n long")))
query("recent_activities", "SELECT session_id, tool_name, ts AS last_seen FROM activity_events ORDER BY ts DESC, id DESC LIMIT 25", lambda t: ac.recent(t.activity_events, 25).select("session_id", "tool_name", c("ts").alias("last_seen")))
query("activities_of_session", "SELECT id, tool_name FROM activity_events WHERE session_id = 's7' ORDER BY ts DESC, id DESC LIMIT 25", lambda t: ac.recent(t.activity_events, 25, "s7").select("id", "tool_name"))
query("recent_checkpoints", "SELECT session_id, scope_path, checkpoint_at FROM checkpoints ORDER BY checkpoint_at DESC, last_activity_id DESC LIMIT 12", lambda t: ac.recent_checkpoints(t.checkpoints, 12).select("session_id", "scope_path", "checkpoint_at"))

# Scopes and graph
query("ensured_scopes", "SELECT * FROM (SELECT id, parent_id, label, depth FROM scopes UNION ALL SELECT (SELECT max(id) FROM scopes) + n, CASE n WHEN 1 THEN 1 WHEN 2 THEN 4 WHEN 3 THEN (SELECT max(id) FROM scopes) + 1 END, l, d FROM (VALUES (1, 'new', 1), (2, 'MOON', 2), (3, 'deep', 2)) AS v(n, l, d))", lambda t: gr.ensure_paths(t.scopes, _table(t, [("/ASIA",), ("/new/deep/",), ("/ASIA//MOON",), ("/",), ("/new",)], "path string")))
query("graph_counts", "SELECT (SELECT count(DISTINCT x) FROM (SELECT source_fact_id AS x FROM edges WHERE t_expired IS NULL UNION ALL SELECT target_fact_id FROM edges WHERE t_expired IS NULL)) AS nodes, count(*) AS edges FROM edges WHERE t_expired IS NULL", lambda t: gr.counts(t.edges))
_BOTH = "bo(a, b) AS (SELECT source_fact_id, target_fact_id FROM edges WHERE t_expired IS NULL UNION SELECT target_fact_id, source_fact_id FROM edges WHERE t_expired IS NULL), rr(a, b) AS (SELECT a, a FROM bo UNION SELECT rr.a, bo.b FROM rr JOIN bo ON rr.b = bo.a), sz AS (SELECT a AS id, count(*) AS n FROM rr GROUP BY a)"
query("graph_context", f"WITH RECURSIVE {_BOTH}, {_DEG} SELECT f.id, coalesce(deg.degree, 0) AS degree, list_sort(coalesce((SELECT list(DISTINCT b) FROM bo WHERE bo.a = f.id AND b <> f.id), []::BIGINT[])) AS neighbours, coalesce(sz.n, 0) AS component_size FROM facts f LEFT JOIN deg ON deg.id = f.id LEFT JOIN sz ON sz.id = f.id", lambda t: gr.context(t.edges, t.facts.select("id")))
_LINKED = "a.id AS source_fact_id, b.id AS target_fact_id FROM facts a JOIN event_log x ON a.source_event_id = x.id JOIN event_log y ON y.session_id = x.session_id JOIN facts b ON b.source_event_id = y.id WHERE x.session_id = 's7' AND a.id <> b.id AND a.t_expired IS NULL AND b.t_expired IS NULL AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.t_expired IS NULL AND e.source_fact_id = a.id AND e.target_fact_id = b.id)"
query("link_session", f"SELECT id, source_fact_id, target_fact_id, relation_type, weight, scope_id FROM edges UNION ALL SELECT (SELECT max(id) FROM edges) + row_number() OVER (ORDER BY source_fact_id, target_fact_id), source_fact_id, target_fact_id, 'co_session', 0.5, 1 FROM (SELECT {_LINKED})", lambda t: gr.link_session(t.facts, t.event_log, t.edges, "s7", now()).select("id", "source_fact_id", "target_fact_id", "relation_type", "weight", "scope_id"))
query("lineage_full", "WITH RECURSIVE r(id) AS (SELECT 99::BIGINT UNION SELECT l.source_fact_id FROM r JOIN lineage l ON l.wisdom_fact_id = r.id) SELECT id FROM r", lambda t: gr.lineage_full(t.lineage, 99))
query("lineage_deleted", "SELECT wisdom_fact_id, source_fact_id FROM lineage WHERE wisdom_fact_id NOT IN (SELECT id FROM facts WHERE id % 3 = 1)", lambda t: gr.lineage_delete(t.lineage, _third(t)).select("wisdom_fact_id", "source_fact_id"))
query("insights_in_subtree", f"{_CL} SELECT id, t_created FROM facts WHERE {ACTIVE} AND json_exists(metadata, '$.dream_cycle') AND scope_id IN (SELECT id FROM cl WHERE ancestor = 2) ORDER BY t_created DESC, id LIMIT 10", lambda t: fa.recent_insights(t.facts, gr.scope_ids(t.scopes, 2, "subtree"), 10).select("id", "t_created"))
query("fact_counts", f"SELECT count(*) FILTER ({ACTIVE}) AS active, count(*) FILTER (len(embedding) > 0) AS vectors, bool_or(id = 42) AS has_42, coalesce(bool_or(id = -1), false) AS has_none FROM facts", lambda t: t.facts.agg(F.count_if(fa.active()).alias("active"), F.count_if(fa.has_vector()).alias("vectors"), F.bool_or(c("id") == 42).alias("has_42"), F.coalesce(F.bool_or(c("id") == -1), F.lit(False)).alias("has_none")))

_STATE = "CASE WHEN f.id IN (SELECT fact_id FROM tombstones) THEN 'Forgotten' WHEN f.t_expired IS NOT NULL THEN 'Expired' WHEN f.t_invalid <= @now THEN 'Invalidated' WHEN f.is_pinned THEN 'Pinned' WHEN f.t_valid <= @now THEN 'Due' ELSE 'Active' END"
_PATH = "(SELECT '/' || coalesce(string_agg(a.label, '/' ORDER BY cl.d DESC), '') FROM cl JOIN scopes a ON a.id = cl.ancestor WHERE cl.id = f.scope_id AND a.parent_id IS NOT NULL)"
query("facts_explained", f"{_CL}, {_BOTH}, {_DEG} SELECT f.id, {_STATE} AS state, CASE WHEN f.t_expired IS NOT NULL THEN CASE WHEN f.id % 2 = 0 THEN 'Quarantined' ELSE 'Unknown' END END AS reason, {_PATH} AS path, e.session_id, coalesce(deg.degree, 0) AS degree, list_sort(coalesce((SELECT list(DISTINCT b) FROM bo WHERE bo.a = f.id AND b <> f.id), []::BIGINT[])) AS neighbours, coalesce(sz.n, 0) AS component_size FROM facts f LEFT JOIN deg ON deg.id = f.id LEFT JOIN sz ON sz.id = f.id LEFT JOIN event_log e ON e.id = f.source_event_id", lambda t: ins.explain(st.patch_metadata(t.facts, t.facts.where("id % 2 = 0").select("id", F.lit('{"quarantine":{"reason":"x"}}').alias("patch"))), t.tombstones, t.event_log, t.edges, t.scopes, t.facts.select("id"), now()))
_ERASED = "er(id) AS (SELECT id FROM facts WHERE scope_id IN (SELECT id FROM cl WHERE ancestor = 3) UNION SELECT l.wisdom_fact_id FROM er JOIN lineage l ON l.source_fact_id = er.id)"
_erased = lambda t: ins.erase_scope({n: getattr(t, n) for n in ("facts", "edges", "lineage", "fact_vectors", "embed_queue")}, t.scopes, 3)
query("erased_facts", f"{_CL}, {_ERASED} SELECT id FROM facts WHERE id NOT IN (SELECT id FROM er)", lambda t: _erased(t)["facts"].select("id"))
query("erased_edges", f"{_CL}, {_ERASED} SELECT id FROM edges WHERE source_fact_id NOT IN (SELECT id FROM er) AND target_fact_id NOT IN (SELECT id FROM er)", lambda t: _erased(t)["edges"].select("id"))
query("erased_vectors", f"{_CL}, {_ERASED} SELECT fact_id, space_id FROM fact_vectors WHERE fact_id NOT IN (SELECT id FROM er)", lambda t: _erased(t)["fact_vectors"].select("fact_id", "space_id"))
_project = lambda t: ig.project_context(t.facts, ac.fold(t.activity_events), t.checkpoints, gr.scope_ids(t.scopes, 1, "subtree"))
query("project_checkpoint", "SELECT session_id, scope_path, checkpoint_at FROM checkpoints ORDER BY checkpoint_at DESC, session_id LIMIT 1", lambda t: _project(t)["checkpoint"].select("session_id", "scope_path", "checkpoint_at"))
query("project_activities", "WITH g AS (SELECT session_id, tool_name, args_hash, outcome_class, scope_id, ts, CASE WHEN date_diff('microsecond', lag(ts) OVER w, ts) < 300000000 THEN 0 ELSE 1 END AS nw, id FROM activity_events WINDOW w AS (PARTITION BY session_id, tool_name, args_hash, outcome_class, scope_id ORDER BY ts, id)), r AS (SELECT *, sum(nw) OVER (PARTITION BY session_id, tool_name, args_hash, outcome_class, scope_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS run FROM g) SELECT session_id, max(ts) AS last_seen FROM r GROUP BY session_id, tool_name, args_hash, outcome_class, scope_id, run ORDER BY last_seen DESC, session_id LIMIT 10", lambda t: _project(t)["activities"].select("session_id", "last_seen"))

# Consolidation and cycle
_groups = lambda t: t.facts.where("id % 4 < 3").select("id", F.expr("id div 6").alias("cluster"))
_G = "g AS (SELECT id, id // 6 AS cluster FROM facts WHERE id % 4 < 3)"
query("summaries_per_level", "SELECT level, count(*) AS n FROM summaries GROUP BY level", lambda t: cy.summaries_per_level(t.summaries))
query("cluster_summaries", f"WITH {_G}, k AS (SELECT cluster FROM g GROUP BY cluster HAVING count(*) >= 4), n AS (SELECT cluster, scope_id, count(*) AS n FROM g JOIN facts USING (id) WHERE cluster IN (SELECT cluster FROM k) GROUP BY ALL) SELECT cluster, first(scope_id ORDER BY n DESC, scope_id) AS scope_id, sum(n)::BIGINT AS members FROM n GROUP BY cluster", lambda t: cy.cluster_summaries(_groups(t), t.facts, least=4)[0].select("cluster", "scope_id", "members"))
query("global_summary", f"WITH {_G}, k AS (SELECT cluster, count(*) AS n FROM g GROUP BY cluster HAVING count(*) >= 4) SELECT 1::BIGINT AS scope_id, sum(n)::BIGINT AS members FROM k", lambda t: cy.global_summary(*cy.cluster_summaries(_groups(t), t.facts, least=4))[0].select("scope_id", "members"))
query("summaries_replaced", f"WITH {_G}, k AS (SELECT cluster FROM g GROUP BY cluster HAVING count(*) >= 4) SELECT level, count(*) AS n FROM summaries WHERE level <> 'cluster' GROUP BY level UNION ALL SELECT 'cluster', count(*) FROM k", lambda t: cy.replace_summaries(t.summaries, cy.cluster_summaries(_groups(t), t.facts, least=4)[0], "cluster").groupBy("level").agg(F.count(F.lit(1)).alias("n")))
query("passes_within_caps", f"SELECT count(*) <= 100 AS dedup, count(*) <= 100000 AS cluster FROM facts WHERE {ACTIVE} AND len(embedding) > 0", lambda t: _table(t, [tuple(cy.passes(t.facts, 100, 100_000).values())], "dedup boolean, cluster boolean"))
query("provenance", f"WITH {_G}, m AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY importance_score DESC, id) AS r FROM g JOIN facts USING (id)) SELECT cluster, count(*) AS source_count, min(t_created) AS first_at, max(t_created) AS last_at, round(1 - 1.0::DOUBLE / count(*), 6) AS confidence, list(id ORDER BY r) FILTER (r <= 5) AS representatives FROM m GROUP BY cluster", lambda t: cy.provenance(_groups(t), t.facts))
query("reports_merged", "WITH r AS (SELECT doc_id % 7 AS created, doc_id % 3 AS reinforced, doc_id % 2 AS blocked, (doc_id % 10) / 10.0::DOUBLE AS m FROM documents) SELECT sum(created)::BIGINT AS created, sum(reinforced)::BIGINT AS reinforced, sum(blocked)::BIGINT AS blocked, round(sum(created * m) / sum(created), 9) AS mean_importance FROM r", lambda t: cy.merge_reports(t.source("documents").select((c("doc_id") % 7).alias("created"), (c("doc_id") % 3).alias("reinforced"), (c("doc_id") % 2).alias("blocked"), ((c("doc_id") % 10) / 10.0).alias("mean_importance"))).withColumn("mean_importance", F.round("mean_importance", 9)))
_OPEN = f"{ACTIVE} AND len(embedding) > 0 AND NOT is_pinned"
query("near_duplicates_since", f"WITH o AS (SELECT id, t_created, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM facts WHERE {_OPEN}) SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.e, b.e), 6) AS cos FROM o a JOIN o b ON a.id < b.id WHERE round(list_cosine_similarity(a.e, b.e), 6) >= 0.3 - 0.000001 AND (a.t_created > timestamp '2024-01-20' OR b.t_created > timestamp '2024-01-20')", lambda t: cy.new_pairs(t.facts, _ntz("2024-01-20 00:00:00"), 0.3))
query("prune_stats", f"WITH {_DEG}, {_IMP}, p AS (SELECT id FROM imp WHERE NOT is_pinned AND fact_type = 'Episodic' AND score < 0.45) SELECT count(*) AS scored, count(*) FILTER (score < 0.45 AND NOT is_pinned AND fact_type = 'Episodic') AS pruned, count(*) FILTER (score < 0.45 AND is_pinned) AS pinned_kept, count(*) FILTER (score < 0.45 AND NOT is_pinned AND fact_type <> 'Episodic') AS exempt_kept, (SELECT count(*) FROM edges WHERE t_expired IS NULL AND (source_fact_id IN (SELECT id FROM p) OR target_fact_id IN (SELECT id FROM p))) AS edges_expired FROM imp", lambda t: cy.prune_apply(t.facts, t.edges, now(), 0.45)[2])
query("prune_facts", f"WITH {_DEG}, {_IMP} SELECT f.id, CASE WHEN imp.id IS NOT NULL AND NOT imp.is_pinned AND imp.fact_type = 'Episodic' AND imp.score < 0.45 THEN @now ELSE f.t_expired END AS t_expired, coalesce(imp.score, f.importance_score) AS importance_score FROM facts f LEFT JOIN imp ON imp.id = f.id", lambda t: cy.prune_apply(t.facts, t.edges, now(), 0.45)[0].select("id", "t_expired", "importance_score"))
_decided = lambda t: t.facts.where("id % 9 = 5").select(c("id").alias("idx"), c("id").alias("old_id"), F.when(c("id") % 4 == 0, "add").when(c("id") % 4 == 1, "update").when(c("id") % 4 == 2, "delete").otherwise("noop").alias("decision"), F.concat(F.lit("resolved "), "id").alias("content"), F.lit("Semantic").alias("fact_type"), F.lit(0.5).alias("importance"), "scope_id")
_D = f"WITH d AS (SELECT id, scope_id, t_expired, CASE id % 4 WHEN 0 THEN CASE WHEN t_expired IS NULL THEN 'add' ELSE 'not_found' END WHEN 1 THEN 'update' WHEN 2 THEN 'delete' ELSE 'noop' END AS status FROM facts WHERE id % 9 = 5), e AS (SELECT id FROM d WHERE status IN ('update', 'delete'))"
query("conflict_results", f"{_D} SELECT id AS idx, id AS old_id, CASE WHEN status IN ('add', 'update') THEN {_MAX} + 1 + id END AS id, status FROM d", lambda t: cy.resolve(t.facts, t.edges, _decided(t), now())[2])
query("conflict_facts", f"{_D} SELECT id, CASE WHEN t_expired IS NULL AND id IN (SELECT id FROM e) THEN @now ELSE t_expired END AS t_expired, CASE WHEN t_expired IS NULL AND id IN (SELECT id FROM e) THEN @now ELSE t_invalid END AS t_invalid FROM facts UNION ALL SELECT {_MAX} + 1 + id, NULL, NULL FROM d WHERE status IN ('add', 'update')", lambda t: cy.resolve(t.facts, t.edges, _decided(t), now())[0].select("id", "t_expired", "t_invalid"))
query("conflict_edges", f"{_D} SELECT source_fact_id, target_fact_id, relation_type, weight, CASE WHEN t_expired IS NULL AND (source_fact_id IN (SELECT id FROM e) OR target_fact_id IN (SELECT id FROM e)) THEN @now ELSE t_expired END AS t_expired FROM edges UNION ALL SELECT {_MAX} + 1 + id, id, CASE status WHEN 'add' THEN 'supplements' ELSE 'contradicts' END, 1.0, NULL FROM d WHERE status IN ('add', 'update')", lambda t: cy.resolve(t.facts, t.edges, _decided(t), now())[1].select("source_fact_id", "target_fact_id", "relation_type", "weight", "t_expired"))
query("promoted_with_lineage", f"SELECT {_MAX} + row_number() OVER (ORDER BY id) AS wisdom_fact_id, id AS source_fact_id, content_hash, 1::BIGINT AS scope_id, true AS is_pinned FROM facts WHERE id % 50 = 7", lambda t: (lambda f, l: f.where("is_pinned and scope_id = 1").join(l.withColumnRenamed("wisdom_fact_id", "id"), "id").select(c("id").alias("wisdom_fact_id"), "source_fact_id", "content_hash", "scope_id", "is_pinned").join(t.facts.select(c("id").alias("wisdom_fact_id")), "wisdom_fact_id", "left_anti"))(*cy.promote_with_lineage(t.facts, t.lineage, t.facts.where("id % 50 = 7").select("id"), now())))


def _report(t: Frames) -> cy.CycleReport:
    """One delta of each kind for each block of 40 facts that are active, as far as its facts are."""
    live = t.facts.where(fa.active() & (c("id") > 0)).select("id", "scope_id")
    k = F.expr("id div 40")
    pick = lambda m, kind: live.where(c("id") % 40 == m).select((k * 8 + m % 8 + 1).alias("seq"), F.lit(kind).alias("kind"), c("id").alias("fact_id"))
    rows = [pick(1, "AdjustScore"), pick(2, "Quarantine"), pick(3, "Promote"), pick(4, "TagOutcome")]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    synth = live.where(c("id") % 40 == 5).select((k * 8 + 6).alias("seq"), F.lit("Synthesize").alias("kind"), F.lit(None).cast("long").alias("fact_id"), c("id").alias("src"))
    out = out.withColumn("src", F.lit(None).cast("long")).unionByName(synth)
    deltas = out.select("seq", "kind", "fact_id", F.lit(None).cast("long").alias("new_id"), F.when(c("kind") == "AdjustScore", F.lit(2)).cast("int").alias("adjustment"), F.when(c("kind") == "Quarantine", "bad").alias("reason"), F.when(c("kind") == "TagOutcome", "Positive").alias("outcome"), F.when(c("src").isNotNull(), F.array("src")).alias("sources"), F.lit(None).cast("string").alias("provenance"))
    new = synth.join(live.withColumnRenamed("id", "src"), "src").select("seq", F.concat(F.lit("merged "), "src").alias("content"), F.expr("transform(sequence(1, 64), x -> float(x))").alias("embedding"), F.lit("Semantic").alias("fact_type"), F.lit(0.5).alias("importance"), "scope_id", F.lit("{}").alias("metadata"))
    return cy.CycleReport(deltas, new, live.where("id % 40 = 6").select("id"), 3, "test")


_tables = lambda t: {n: getattr(t, n) for n in ("facts", "edges", "event_log", "lineage", "tombstones")}
_LIVE = f"lv AS (SELECT * FROM facts WHERE {ACTIVE} AND id > 0), made AS (SELECT {_MAX} + 1 + (id // 40) * 8 + 4 AS id, id AS src, 'Promote' AS kind FROM lv WHERE id % 40 = 3 AND content_hash NOT IN (SELECT content_hash FROM tombstones) UNION ALL SELECT {_MAX} + 1 + (id // 40) * 8 + 6, id, 'Synthesize' FROM lv WHERE id % 40 = 5)"
query("cycle_facts", f"WITH {_LIVE} SELECT id, CASE WHEN {ACTIVE} AND id > 0 AND id % 40 IN (2, 5) THEN @now ELSE t_expired END AS t_expired, round(CASE WHEN {ACTIVE} AND id > 0 AND id % 40 = 1 THEN least(1, importance + 0.1) ELSE importance END, 9) AS importance, is_pinned, CASE WHEN {ACTIVE} AND id > 0 AND id % 40 = 6 THEN true ELSE json_exists(metadata, '$.dream_cycle') END AS dreamt FROM facts UNION ALL SELECT m.id, NULL, CASE WHEN kind = 'Promote' THEN f.importance ELSE 0.5 END, kind = 'Promote', true FROM made m JOIN facts f ON f.id = m.src", lambda t: cy.apply_report(_report(t), _tables(t), 64, now())[0]["facts"].select("id", "t_expired", F.round("importance", 9).alias("importance"), "is_pinned", (~fa.key_absent("dream_cycle")).alias("dreamt")))
query("cycle_edges", f"WITH {_LIVE} SELECT id, source_fact_id, target_fact_id, relation_type FROM edges UNION ALL SELECT (SELECT max(id) FROM edges) + row_number() OVER (ORDER BY id), id, src, 'supersedes' FROM made WHERE kind = 'Synthesize'", lambda t: cy.apply_report(_report(t), _tables(t), 64, now())[0]["edges"].select("id", "source_fact_id", "target_fact_id", "relation_type"))
query("cycle_lineage", f"WITH {_LIVE} SELECT wisdom_fact_id, source_fact_id FROM lineage UNION ALL SELECT id, src FROM made", lambda t: cy.apply_report(_report(t), _tables(t), 64, now())[0]["lineage"].select("wisdom_fact_id", "source_fact_id"))
query("cycle_proposed", None, lambda t: cy.DefaultCycle().run(cy.CycleContext(t.facts, t.outcomes, (_ntz("2024-01-01 00:00:00"), now()))).deltas)

# Vectors, spaces, files
query("ann_dispatch_exact", f"SELECT id, round(list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), {_Q}), 6) AS score FROM facts WHERE {ACTIVE} AND NOT is_pinned AND len(embedding) > 0 ORDER BY 2 DESC, 1 LIMIT 10", lambda t: ann.vector_search(t.facts, QUERY_VECTOR, 10, fi.FactFilter(pinned=False), ann.HyperplaneIndex.build(t.facts, 64, 6, 8), threshold=1).select("id", "score"))
query("ann_search", None, lambda t: ann.vector_search(t.facts, QUERY_VECTOR, 10, fi.FactFilter(), ann.HyperplaneIndex.build(t.facts, 64, 6, 16), threshold=1))
_spaces = lambda t: _table(t, [("old", "m1", 64, "active"), ("new", "m2", 64, "populating")], "space_id string, name string, dim int, status string").withColumn("created_at", now())
query("spaces_status", "SELECT 'old' AS space_id, 'active' AS status, (SELECT count(*) FROM fact_vectors WHERE space_id = 'old') AS vectors, 0::BIGINT AS pending UNION ALL SELECT 'new', 'populating', (SELECT count(*) FROM fact_vectors WHERE space_id = 'new'), (SELECT count(*) FROM facts WHERE id NOT IN (SELECT fact_id FROM fact_vectors WHERE space_id = 'new'))", lambda t: sp.status(_spaces(t), t.fact_vectors, t.facts))


def _promoted(t: Frames) -> tuple[DataFrame, ...]:
    own = t.fact_vectors.where("space_id = 'new'")
    return sp.promote_space(_spaces(t), t.fact_vectors, t.facts.join(own.select(c("fact_id").alias("id")), "id", "left_semi").withColumn("embedding", F.slice("embedding", 1, 8)), t.embed_queue, "new")


_IN = "id IN (SELECT fact_id FROM fact_vectors WHERE space_id = 'new')"
query("space_promoted", f"SELECT id, len(embedding)::INTEGER AS n FROM facts WHERE {_IN}", lambda t: _promoted(t)[2].select("id", F.size("embedding").alias("n")))
query("space_promoted_vectors", f"SELECT 'new' AS space_id, count(*) AS n FROM fact_vectors WHERE space_id = 'new' UNION ALL SELECT 'old', count(*) FROM facts WHERE {_IN} AND len(embedding) > 0", lambda t: _promoted(t)[1].groupBy("space_id").agg(F.count(F.lit(1)).alias("n")))
query("space_promoted_queue", "SELECT fact_id FROM embed_queue WHERE fact_id NOT IN (SELECT fact_id FROM fact_vectors WHERE space_id = 'new')", lambda t: _promoted(t)[3].select("fact_id"))


def _round_trip(t: Frames, codec: str) -> DataFrame:
    path = shared_path(t.spark, "dump")
    sn.dump({"facts": t.facts, "edges": t.edges}, path, codec)
    return sn.restore(t.spark, path)["facts"]


_KEPT = ["id", "content_hash", "t_created", "t_expired", "importance", "metadata", "is_pinned"]
for _codec in ("json", "gzip", "zstd"):
    query(f"snapshot_{_codec}", f"SELECT {', '.join(_KEPT)}, strlen(content)::INTEGER AS bytes FROM facts", lambda t, k=_codec: _round_trip(t, k).select(*_KEPT, F.octet_length("content").alias("bytes")))


def _archived(t: Frames) -> tuple[DataFrame, ...]:
    return sn.archive(t.facts, t.edges, t.tombstones, t.spark.createDataFrame([], sn.MANIFEST), shared_path(t.spark, "archive"), now(), days=10, least=2)


_GONE = "(SELECT id FROM facts WHERE NOT is_pinned AND t_expired < @now - INTERVAL 10 DAY AND len(embedding) > 0 AND id NOT IN (SELECT fact_id FROM tombstones))"
query("archive_facts_left", f"SELECT id FROM facts WHERE id NOT IN {_GONE}", lambda t: _archived(t)[0].select("id"))
query("archive_edges_left", f"SELECT id FROM edges WHERE source_fact_id NOT IN {_GONE} AND target_fact_id NOT IN {_GONE}", lambda t: _archived(t)[1].select("id"))
query("archive_written", f"SELECT count(*) AS fact_count, min(id) AS fact_id_min, max(id) AS fact_id_max, min(t_created) AS t_created_min, max(t_created) AS t_created_max FROM facts WHERE id IN {_GONE}", lambda t: _archived(t)[2].select("fact_count", "fact_id_min", "fact_id_max", "t_created_min", "t_created_max"))
query("project_keys", "SELECT page_id, CASE WHEN url IS NULL THEN 'x' ELSE lower(regexp_replace(regexp_replace(regexp_extract(replace(url, '://', '://me:pw@'), '^[A-Za-z]+://(?:[^/?#@]*@)?([^?#]+)', 1), '/+$', ''), '\\.git$', '')) END AS key FROM pages", lambda t: t.source("pages").select("page_id", bo.project_key(F.replace("url", F.lit("://"), F.lit("://me:pw@")), F.lit("/home/y/X")).alias("key")))
