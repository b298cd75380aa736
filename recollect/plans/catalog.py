"""Queries over the derived memory tables, each with its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions import paths as pa
from recollect.functions import redaction as rd
from recollect.functions import text as tx
from recollect.operators import apply as ap
from recollect.operators import consolidate as co
from recollect.operators import facts as fa
from recollect.operators import graph as gr
from recollect.operators import ingest as ig
from recollect.operators import retrieval as rt
from recollect.plans import memory_query as mq
from recollect.plans.tables import Frames, duck, now, words
from recollect.sources import sessions as ss
from recollect.streaming import activity as ac

c = F.col
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
ACTIVE = "t_expired IS NULL"
ASOF = "t_expired IS NULL AND (t_valid IS NULL OR t_valid <= @now) AND (t_invalid IS NULL OR t_invalid > @now)"
WORDS = ["the", "thereon", "anthe", "haonnt", "de"]
QUERY_VECTOR = [round(((i * 37) % 19 - 9) / 10, 1) for i in range(64)]
_Q = "[" + ", ".join(f"{x}::DOUBLE" for x in QUERY_VECTOR) + "]"


def query(name: str, sql: str | None, plan: Callable[[Frames], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: plan(Frames(spark, sf_dir))
    if sql:
        SQL[name] = duck(sql)


def _ids(t: Frames, *ids: int) -> DataFrame:
    return t.spark.createDataFrame([(i,) for i in ids], "id long")


# Scans and temporal predicates
query("facts_get", "SELECT id, content_hash, scope_id FROM facts WHERE id = 42", lambda t: t.facts.where("id = 42").select("id", "content_hash", "scope_id"))
query("facts_by_ids", "SELECT id, fact_type FROM facts WHERE id IN (3, 5, 8, 13, 21, 34)", lambda t: fa.among(t.facts, _ids(t, 3, 5, 8, 13, 21, 34)).select("id", "fact_type"))
query("facts_excluding_ids", "SELECT id FROM facts WHERE id NOT IN (3, 5, 8)", lambda t: fa.without(t.facts, _ids(t, 3, 5, 8)).select("id"))
query("facts_all", "SELECT id, t_created FROM facts", lambda t: t.facts.orderBy("id").select("id", "t_created"))
query("facts_active", f"SELECT id FROM facts WHERE {ACTIVE} ORDER BY id LIMIT 100", lambda t: fa.top(t.facts.where(fa.active()), 100).select("id"))
query("facts_active_with_vector", f"SELECT id FROM facts WHERE {ACTIVE} AND len(embedding) > 0", lambda t: t.facts.where(fa.active() & fa.has_vector()).select("id"))
query("facts_scoring_rows", f"SELECT id, fact_type, last_accessed, access_count, importance, is_pinned FROM facts WHERE {ACTIVE}", lambda t: t.facts.where(fa.active()).select("id", "fact_type", "last_accessed", "access_count", "importance", "is_pinned"))
query("facts_as_of", f"SELECT id FROM facts WHERE {ASOF}", lambda t: t.facts.where(fa.as_of(now())).select("id"))
query("facts_due", f"SELECT id, t_valid FROM facts WHERE {ASOF} AND t_valid IS NOT NULL", lambda t: t.facts.where(fa.due(now())).select("id", "t_valid"))
query("facts_next_due", f"SELECT min(t_valid) AS next_due FROM facts WHERE {ACTIVE} AND t_valid > @now", lambda t: t.facts.where(fa.active() & (c("t_valid") > now())).agg(F.min("t_valid").alias("next_due")))
_PERIOD = f"{ACTIVE} AND (t_valid IS NULL OR t_valid < @now) AND (t_invalid IS NULL OR t_invalid > timestamp '2024-01-20')"
_period = lambda: fa.overlaps(F.expr("timestamp_ntz'2024-01-20 00:00:00'"), now())
query("facts_in_period", f"SELECT id, importance_score FROM facts WHERE {_PERIOD}", lambda t: t.facts.where(_period()).select("id", "importance_score"))
query("facts_undreamt", f"SELECT id FROM facts WHERE {_PERIOD} AND len(embedding) > 0 AND NOT json_exists(metadata, '$.dream_cycle')", lambda t: t.facts.where(_period() & fa.key_absent("dream_cycle") & fa.has_vector()).select("id"))
query("facts_include_expired", "SELECT fact_type, count(*) AS n FROM facts GROUP BY fact_type", lambda t: t.facts.groupBy("fact_type").agg(F.count(F.lit(1)).alias("n")))
query("facts_by_type_scope", f"SELECT id FROM facts WHERE {ACTIVE} AND fact_type IN ('Semantic', 'Episodic') AND scope_id IN (1, 2, 11, 12)", lambda t: t.facts.where(fa.active() & c("fact_type").isin("Semantic", "Episodic") & c("scope_id").isin(1, 2, 11, 12)).select("id"))
query("facts_metadata_absent", "SELECT id FROM facts WHERE NOT json_exists(metadata, '$.k')", lambda t: t.facts.where(fa.key_absent("k")).select("id"))
query("facts_metadata_present", "SELECT id FROM facts WHERE json_extract_string(metadata, '$.k') IS NOT NULL", lambda t: t.facts.where(fa.key_present("k")).select("id"))
query("facts_metadata_equals", "SELECT id FROM facts WHERE json_extract_string(metadata, '$.k') = '7'", lambda t: t.facts.where(fa.key_equals("k", "7")).select("id"))
query("facts_marker_recent", "SELECT id, t_created FROM facts WHERE json_exists(metadata, '$.dream_cycle') AND t_expired IS NULL ORDER BY t_created DESC, id LIMIT 10", lambda t: fa.top(t.facts.where(fa.key_present("dream_cycle") & fa.active()), 10, c("t_created").desc()).select("id", "t_created"))
query("facts_dormant", f"SELECT id, importance_score FROM facts WHERE {ASOF} AND NOT is_pinned AND importance_score < 0.5 AND len(embedding) > 0", lambda t: fa.dormant(t.facts, now()).select("id", "importance_score"))
query("archive_candidates", "SELECT id FROM facts WHERE NOT is_pinned AND t_expired < @now AND len(embedding) > 0 AND id NOT IN (SELECT fact_id FROM tombstones)", lambda t: fa.archive_candidates(t.facts, t.tombstones, now()).select("id"))
# Rankings
query("top_importance", f"SELECT id, importance_score FROM facts WHERE {ACTIVE} ORDER BY importance_score DESC, id LIMIT 20", lambda t: fa.top(t.facts.where(fa.active()), 20, c("importance_score").desc()).select("id", "importance_score"))
query("top_prior_importance", f"SELECT id, importance FROM facts WHERE {ACTIVE} AND scope_id IN (11, 12, 13) ORDER BY importance DESC, id LIMIT 20", lambda t: fa.top(t.facts.where(fa.active() & c("scope_id").isin(11, 12, 13)), 20, c("importance").desc()).select("id", "importance"))
query("top_pinned", f"SELECT id FROM facts WHERE {ACTIVE} AND is_pinned ORDER BY importance_score DESC, id LIMIT 10", lambda t: fa.top(t.facts.where(fa.active() & c("is_pinned")), 10, c("importance_score").desc()).select("id"))
query("recent_facts", f"SELECT id, t_created FROM facts WHERE {ACTIVE} ORDER BY t_created DESC, id LIMIT 15", lambda t: fa.top(t.facts.where(fa.active()), 15, c("t_created").desc()).select("id", "t_created"))
query("keyset_page", "SELECT id FROM facts WHERE id > 50 ORDER BY id LIMIT 25", lambda t: fa.page(t.facts, 50, 25).select("id"))
# Scopes
_CL = "WITH RECURSIVE cl(ancestor, id, d) AS (SELECT id, id, 0 FROM scopes UNION ALL SELECT s.parent_id, cl.id, d + 1 FROM cl JOIN scopes s ON s.id = cl.ancestor WHERE s.parent_id IS NOT NULL)"
for kind, where in {"exact": "SELECT id FROM scopes WHERE id = 3", "subtree": f"{_CL} SELECT id FROM cl WHERE ancestor = 3", "ancestors": f"{_CL} SELECT ancestor AS id FROM cl WHERE id = 12", "inherited": f"{_CL} SELECT ancestor AS id FROM cl WHERE id = 3 UNION SELECT id FROM cl WHERE ancestor = 3"}.items():
    query(f"scope_{kind}", where, lambda t, kind=kind: gr.scope_ids(t.scopes, 12 if kind == "ancestors" else 3, kind))
query("scope_paths", f"{_CL} SELECT s.id, '/' || coalesce((SELECT string_agg(a.label, '/' ORDER BY cl.d DESC) FROM cl JOIN scopes a ON a.id = cl.ancestor WHERE cl.id = s.id AND a.parent_id IS NOT NULL), '') AS path FROM scopes s", lambda t: gr.scope_paths(t.scopes))
query("facts_in_subtree", f"{_CL} SELECT f.id FROM facts f WHERE f.t_expired IS NULL AND f.scope_id IN (SELECT id FROM cl WHERE ancestor = 3)", lambda t: t.facts.where(fa.active()).join(gr.scope_ids(t.scopes, 3, "subtree").select(c("id").alias("scope_id")), "scope_id", "left_semi").select("id"))
query("scope_stats", "SELECT count(*) AS total, coalesce(max(depth), 0) AS max_depth FROM scopes", lambda t: t.scopes.agg(F.count(F.lit(1)).alias("total"), F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth")))
# Joins
query("session_facts", "SELECT f.id, e.session_id FROM facts f JOIN event_log e ON f.source_event_id = e.id WHERE e.session_id = 's7'", lambda t: t.facts.join(t.event_log.select(c("id").alias("source_event_id"), "session_id"), "source_event_id").where("session_id = 's7'").select("id", "session_id"))
query("unbackfilled_facts", "SELECT id FROM facts WHERE id NOT IN (SELECT fact_id FROM fact_vectors WHERE space_id = 'new') AND id > 10 ORDER BY id LIMIT 100", lambda t: fa.page(t.facts.join(t.fact_vectors.where("space_id = 'new'").select(c("fact_id").alias("id")), "id", "left_anti"), 10, 100).select("id"))
query("vectors_per_space", "SELECT space_id, count(*) AS n FROM fact_vectors GROUP BY space_id", lambda t: t.fact_vectors.groupBy("space_id").agg(F.count(F.lit(1)).alias("n")))
query("next_embedding", "SELECT q.fact_id, q.next_attempt_at FROM embed_queue q JOIN facts f ON f.id = q.fact_id WHERE q.failed_at IS NULL AND q.next_attempt_at <= @now ORDER BY q.next_attempt_at, q.fact_id LIMIT 1", lambda t: t.embed_queue.join(t.facts.select(c("id").alias("fact_id")), "fact_id").where(c("failed_at").isNull() & (c("next_attempt_at") <= now())).orderBy("next_attempt_at", "fact_id").limit(1).select("fact_id", "next_attempt_at"))
query("internal_edges", "SELECT id FROM edges WHERE t_expired IS NULL AND source_fact_id IN (SELECT id FROM facts WHERE scope_id BETWEEN 10 AND 20) AND target_fact_id IN (SELECT id FROM facts WHERE scope_id BETWEEN 10 AND 20)", lambda t: gr.internal(t.edges, t.facts.where(c("scope_id").between(10, 20)).select("id")).select("id"))
query("orphaned_facts", "SELECT DISTINCT f.id FROM edges e JOIN facts f ON f.id = e.target_fact_id WHERE e.source_fact_id IN (7, 11, 15, 19) AND f.id NOT IN (7, 11, 15, 19)", lambda t: fa.without(t.edges.join(_ids(t, 7, 11, 15, 19).withColumnRenamed("id", "source_fact_id"), "source_fact_id", "left_semi").select(c("target_fact_id").alias("id")).join(t.facts.select("id"), "id", "left_semi"), _ids(t, 7, 11, 15, 19)).distinct())
query("same_content_copies", "SELECT f.id FROM facts f WHERE f.content_hash IN (SELECT content_hash FROM facts GROUP BY content_hash HAVING count(*) > 1)", lambda t: t.facts.select("id", "content_hash").join(t.facts.groupBy("content_hash").count().where("count > 1"), "content_hash", "left_semi").select("id"))
query("cosession_edges", "SELECT a.id AS source_fact_id, b.id AS target_fact_id FROM facts a JOIN event_log x ON a.source_event_id = x.id JOIN event_log y ON y.session_id = x.session_id JOIN facts b ON b.source_event_id = y.id WHERE x.session_id = 's7' AND a.id <> b.id AND a.t_expired IS NULL AND b.t_expired IS NULL AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.t_expired IS NULL AND e.source_fact_id = a.id AND e.target_fact_id = b.id)", lambda t: gr.session_links(t.facts, t.event_log, t.edges, "s7"))
# Aggregates
query("fact_stats", f"SELECT count(*) AS total, count(*) FILTER ({ACTIVE}) AS active, count(*) FILTER (t_expired IS NOT NULL) AS expired, count(*) FILTER ({ACTIVE} AND is_pinned) AS pinned, count(*) FILTER ({ASOF} AND t_valid IS NOT NULL) AS due FROM facts", lambda t: fa.statistics(t.facts, now()))
query("edge_stats", "SELECT count(*) AS total, count(*) FILTER (t_expired IS NULL) AS active FROM edges", lambda t: t.edges.agg(F.count(F.lit(1)).alias("total"), F.count_if(fa.active()).alias("active")))
query("summary_levels", "SELECT level, count(*) AS n FROM summaries GROUP BY level", lambda t: t.summaries.groupBy("level").agg(F.count(F.lit(1)).alias("n")))
query("event_counts", "SELECT event_type, count(*) AS n FROM event_log WHERE session_id <> 's3' GROUP BY event_type", lambda t: t.event_log.where("session_id <> 's3'").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")))
query("outcome_counts", "SELECT fact_id, count(*) FILTER (outcome = 'Positive') AS positive, count(*) FILTER (outcome = 'Negative') AS negative, count(*) FILTER (outcome = 'Neutral') AS neutral FROM outcomes WHERE outcome IN ('Positive', 'Negative', 'Neutral') GROUP BY fact_id", lambda t: co.outcome_counts(t.outcomes))
query("queue_status", "SELECT count(*) FILTER (failed_at IS NULL) AS pending, count(*) FILTER (failed_at IS NOT NULL) AS failed, min(CASE WHEN failed_at IS NULL THEN next_attempt_at END) AS next_at FROM embed_queue", lambda t: t.embed_queue.agg(F.count_if(c("failed_at").isNull()).alias("pending"), F.count_if(c("failed_at").isNotNull()).alias("failed"), F.min(F.when(c("failed_at").isNull(), c("next_attempt_at"))).alias("next_at")))
query("queue_oldest", "SELECT min(enqueued_at) AS oldest FROM embed_queue WHERE failed_at IS NULL", lambda t: t.embed_queue.where("failed_at IS NULL").agg(F.min("enqueued_at").alias("oldest")))
_ANSWER = "CASE fact_id % 4 WHEN 0 THEN 'embedded' WHEN 1 THEN 'unreachable' WHEN 2 THEN 'input_rejected' ELSE 'no_answer' END"
query("queue_settled", f"SELECT fact_id, CASE WHEN fact_id % 4 >= 2 THEN attempts + 1 ELSE attempts END::BIGINT AS attempts, CASE WHEN fact_id % 4 = 3 THEN @now + to_seconds(least(pow(2, attempts), 60)::INTEGER) ELSE next_attempt_at END AS next_attempt_at, CASE WHEN fact_id % 4 = 2 THEN @now ELSE failed_at END AS failed_at FROM embed_queue WHERE {_ANSWER} <> 'embedded'", lambda t: ap.settle(t.embed_queue, t.embed_queue.select("fact_id", F.expr(_ANSWER).alias("answer"), F.lit("e").alias("error"), F.lit(None).cast("array<float>").alias("embedding")), now())[0].select("fact_id", "attempts", "next_attempt_at", "failed_at"))
_PLAN = "SELECT id AS loser, id + 1 AS survivor, CAST(0.75 AS DOUBLE) AS score FROM facts WHERE id % 10 = 9"
query("dedup_applied", f"WITH p AS ({_PLAN}), g AS (SELECT loser FROM p JOIN facts s ON s.id = p.survivor WHERE s.t_expired IS NULL) SELECT f.id, CASE WHEN f.t_expired IS NULL AND f.id IN (SELECT loser FROM g) THEN @now ELSE f.t_expired END AS t_expired, CASE WHEN f.id IN (SELECT survivor FROM p) THEN greatest(f.importance_score, 0.75::DOUBLE) ELSE f.importance_score END AS importance_score FROM facts f", lambda t: ap.apply_dedup(t.facts, t.edges, t.facts.where("id % 10 = 9").select(c("id").alias("loser"), (c("id") + 1).alias("survivor"), F.lit(0.75).alias("score")), now())[0].select("id", "t_expired", "importance_score"))
query("consolidation_watermark", f"SELECT CASE WHEN EXISTS (SELECT 1 FROM facts WHERE {ACTIVE} AND coalesce(len(embedding), 0) = 0) THEN timestamp '2024-01-01' ELSE @now END AS last_consolidated_at", lambda t: ap.watermark(t.facts, F.expr("timestamp_ntz'2024-01-01 00:00:00'"), now()))
query("queue_backoff", "SELECT fact_id, least(pow(2, greatest(attempts - 1, 0)), 60)::BIGINT AS delay FROM embed_queue", lambda t: t.embed_queue.select("fact_id", tx.backoff_seconds(c("attempts")).alias("delay")))
query("max_caller_id", "SELECT max(id) AS id FROM facts WHERE NOT json_exists(metadata, '$.dream_cycle')", lambda t: t.facts.where(fa.key_absent("dream_cycle")).agg(F.max("id").alias("id")))
query("nearest_rank_percentile", "SELECT fact_type, p FROM (SELECT fact_type, importance_score AS p, row_number() OVER w AS r, count(*) OVER (PARTITION BY fact_type) AS n FROM facts WINDOW w AS (PARTITION BY fact_type ORDER BY importance_score)) WHERE r = round(0.75 * (n - 1)) + 1", lambda t: co.nearest_rank(t.facts, "fact_type", "importance_score", 0.75))
_DEG = "deg AS (SELECT id, count(*) AS degree FROM (SELECT source_fact_id AS id FROM edges WHERE t_expired IS NULL UNION ALL SELECT target_fact_id FROM edges WHERE t_expired IS NULL) GROUP BY id)"
query("graph_degree", f"WITH {_DEG} SELECT id, degree FROM deg", lambda t: gr.degree(t.edges))
query("neighbors", "SELECT target_fact_id AS id FROM edges WHERE t_expired IS NULL AND source_fact_id = 7", lambda t: gr.neighbours(t.edges, 7))
query("neighbors_undirected", "SELECT target_fact_id AS id FROM edges WHERE t_expired IS NULL AND source_fact_id = 7 AND target_fact_id <> 7 UNION SELECT source_fact_id FROM edges WHERE t_expired IS NULL AND target_fact_id = 7 AND source_fact_id <> 7", lambda t: gr.neighbours(t.edges, 7, True))
_EP = "ep(a, b) AS (SELECT source_fact_id, target_fact_id FROM edges WHERE t_expired IS NULL UNION SELECT target_fact_id, source_fact_id FROM edges WHERE t_expired IS NULL)"
_pairs = lambda t: gr.live(t.edges).select(c("source_fact_id").alias("a"), c("target_fact_id").alias("b"))
query("component_sizes", f"WITH RECURSIVE {_EP}, r(a, b) AS (SELECT a, a FROM ep UNION SELECT r.a, ep.b FROM r JOIN ep ON r.b = ep.a), m AS (SELECT a, min(b) AS root FROM r GROUP BY a) SELECT root, count(*) AS n FROM m GROUP BY root", lambda t: gr.components(_pairs(t)).groupBy("root").agg(F.count(F.lit(1)).alias("n")))
query("component_of", f"WITH RECURSIVE {_EP}, r(b) AS (SELECT 7 UNION SELECT ep.b FROM r JOIN ep ON r.b = ep.a) SELECT b::BIGINT AS id FROM r", lambda t: gr.component_of(t.edges, 7))
query("lineage_closure", "WITH RECURSIVE r(id) AS (SELECT 3::BIGINT UNION SELECT l.wisdom_fact_id FROM r JOIN lineage l ON l.source_fact_id = r.id) SELECT id FROM r", lambda t: gr.reach(_ids(t, 3), t.lineage.select(c("source_fact_id").alias("a"), c("wisdom_fact_id").alias("b"))))
# Retrieval
_words = "(VALUES " + ", ".join(f"('{w}')" for w in WORDS) + ") AS q(w)"
_LEX = (
    "tok AS (SELECT id, regexp_extract_all(lower(coalesce(content, '')), '[\\p{L}\\p{N}]+') AS t FROM facts), "
    f"cnt AS (SELECT id, len(t) AS len, w, len(list_filter(t, lambda x: x = w)) AS n FROM tok, {_words}), "
    "st AS (SELECT w, count(*) AS nn, avg(len) AS av, count(*) FILTER (n > 0) AS df FROM cnt GROUP BY w), "
    "lex AS (SELECT id, sum(CASE WHEN nn - df > df THEN ln((nn - df + 0.5) / (df + 0.5)) ELSE 0.000001::DOUBLE END * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len / av))) AS score, max(n) AS hit FROM cnt JOIN st USING (w) GROUP BY id), "
    f"vec AS (SELECT id, list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), {_Q}) AS score FROM facts WHERE {ASOF} AND len(embedding) > 0)"
)


def _hybrid_sql(keep: str, k: int) -> str:
    return (
        f"l AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) - 1 AS r FROM (SELECT id, round(score, 6) AS score FROM lex WHERE hit > 0 AND id IN (SELECT id FROM facts WHERE {keep}) ORDER BY 2 DESC, 1 LIMIT {3 * k})), "
        f"v AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) - 1 AS r FROM (SELECT id, round(score, 6) AS score FROM vec WHERE id IN (SELECT id FROM facts WHERE {keep}) ORDER BY 2 DESC, 1 LIMIT {3 * k})), "
        "u AS (SELECT id, r, 1 AS l, 0 AS v FROM l UNION ALL SELECT id, r, 0, 1 FROM v), "
        f"hy AS (SELECT id, round(sum(1.0::DOUBLE / (61 + r)), 6) AS score, CASE WHEN max(l) = 1 AND max(v) = 1 THEN 'both' WHEN max(l) = 1 THEN 'fts' ELSE 'vector' END AS match_type FROM u GROUP BY id ORDER BY 2 DESC, 1 LIMIT {k})"
    )


query("lexical_bm25", f"WITH {_LEX} SELECT id, round(score, 6) AS score FROM lex WHERE hit > 0 AND id IN (SELECT id FROM facts WHERE {ACTIVE}) ORDER BY 2 DESC, 1 LIMIT 20", lambda t: rt.ranked(rt.bm25(words(t), WORDS).join(t.facts.where(fa.active()).select("id"), "id", "left_semi"), 20).select("id", "score"))
_MATCH = (
    "tk AS (SELECT id, t_expired, regexp_extract_all(lower(coalesce(content, '')), '[\\p{L}\\p{N}]+') AS t FROM facts), "
    "pc AS (SELECT id, t_expired, len(t) AS len, len(list_filter(t, lambda x: x = 'the')) AS a, len(list_filter(t, lambda x: starts_with(x, 'dans'))) AS b, len(list_filter(range(1, len(t)), lambda i: t[i] = 'de' AND t[i + 1] = 'la')) AS d, len(list_filter(t, lambda x: x = 'und')) AS u FROM tk), "
    "ps AS (SELECT count(*) AS nn, avg(len) AS av, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db, count(*) FILTER (d > 0) AS dd FROM pc), "
)
_W = lambda n, d: f"CASE WHEN {n} > 0 THEN CASE WHEN nn - {d} > {d} THEN ln((nn - {d} + 0.5) / ({d} + 0.5)) ELSE 0.000001::DOUBLE END * {n} * 2.2 / ({n} + 1.2 * (0.25 + 0.75 * len / av)) ELSE 0 END"
query("lexical_match", f"WITH {_MATCH} m AS (SELECT id, {_W('a', 'da')} + {_W('b', 'db')} + {_W('d', 'dd')} AS score FROM pc, ps WHERE a > 0 AND (b > 0 OR d > 0) AND u = 0 AND t_expired IS NULL) SELECT id, round(score, 6) AS score FROM m ORDER BY 2 DESC, 1 LIMIT 20", lambda t: rt.ranked(rt.lexical_search(words(t), 'the AND (dans* OR "de la") NOT und').join(t.facts.where(fa.active()).select("id"), "id", "left_semi"), 20).select("id", "score"))
query("lexical_expired_probe", f"WITH {_LEX} SELECT count(*) AS n FROM lex WHERE hit > 0 AND id IN (SELECT id FROM facts WHERE t_expired IS NOT NULL)", lambda t: rt.bm25(words(t), WORDS).join(t.facts.where(~fa.active()).select("id"), "id", "left_semi").agg(F.count(F.lit(1)).alias("n")))
query("vector_topk", f"WITH {_LEX} SELECT id, round(score, 6) AS score FROM vec ORDER BY 2 DESC, 1 LIMIT 10", lambda t: rt.ranked(rt.vector_scores(t.facts.where(fa.as_of(now())), QUERY_VECTOR), 10).select("id", "score"))
query("hybrid_rrf", f"WITH {_LEX}, {_hybrid_sql(ASOF, 10)} SELECT * FROM hy", lambda t: rt.hybrid(t.facts, words(t), WORDS, QUERY_VECTOR, fa.as_of(now()), 10))
query("hybrid_scoped", f"WITH {_LEX}, {_hybrid_sql(ASOF + ' AND scope_id BETWEEN 10 AND 20', 10)} SELECT * FROM hy", lambda t: rt.hybrid(t.facts, words(t), WORDS, QUERY_VECTOR, fa.as_of(now()) & c("scope_id").between(10, 20), 10))
query("hybrid_post_filtered", f"WITH {_LEX}, {_hybrid_sql(ASOF, 10)} SELECT * FROM hy WHERE score >= 0.016 AND id IN (SELECT id FROM facts WHERE NOT is_pinned)", lambda t: rt.hybrid(t.facts, words(t), WORDS, QUERY_VECTOR, fa.as_of(now()), 10).where("score >= 0.016").join(t.facts.where("not is_pinned").select("id"), "id", "left_semi"))
query("store_path_query", f"SELECT id FROM (SELECT * FROM facts WHERE {ACTIVE} ORDER BY importance_score DESC, id LIMIT 30) WHERE {ASOF} ORDER BY importance_score DESC, id LIMIT 10", lambda t: fa.top(fa.top(t.facts.where(fa.active()), 30, c("importance_score").desc()).where(fa.as_of(now())), 10, c("importance_score").desc()).select("id"))
query("archive_search", f"SELECT id, round(CASE WHEN contains(lower(coalesce(content, '')), 'thereon') THEN 1.0::DOUBLE ELSE 0 END + CASE WHEN len(embedding) > 0 THEN greatest(list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), {_Q}), 0) ELSE 0 END, 6) AS score FROM facts WHERE t_expired IS NOT NULL AND round(CASE WHEN contains(lower(coalesce(content, '')), 'thereon') THEN 1.0::DOUBLE ELSE 0 END + CASE WHEN len(embedding) > 0 THEN greatest(list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), {_Q}), 0) ELSE 0 END, 6) > 0 ORDER BY 2 DESC, 1 LIMIT 10", lambda t: rt.archive_search(t.facts.where(~fa.active()), "thereon", QUERY_VECTOR, 10))
query("dormant_sample", f"SELECT id, round(list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), {_Q}), 6) AS score FROM facts WHERE {ASOF} AND NOT is_pinned AND importance_score < 0.5 AND len(embedding) > 0 ORDER BY 2 DESC, 1 LIMIT 5", lambda t: rt.ranked(rt.vector_scores(fa.dormant(t.facts, now()), QUERY_VECTOR), 5).select("id", "score"))
_tier = lambda name, cond, order, k, seen: f"{name} AS (SELECT '{name}' AS tier, row_number() OVER (ORDER BY {order}, id) AS rank, id FROM (SELECT * FROM facts WHERE {ASOF} AND {cond} {''.join(f' AND id NOT IN (SELECT id FROM {s})' for s in seen)} ORDER BY {order}, id LIMIT {k}))"
_H = "scope_id IN (1, 3, 12)"
query("resume_tiers", "WITH " + ", ".join([_tier("pinned", "is_pinned", "importance_score DESC", 50, []), _tier("important", f"{_H} AND importance_score >= 0.7", "importance_score DESC", 20, ["pinned"]), _tier("due", f"{_H} AND t_valid IS NOT NULL", "t_valid", 10, ["pinned", "important"]), _tier("recent", _H, "t_created DESC", 10, ["pinned", "important", "due"])]) + " SELECT * FROM pinned UNION ALL SELECT * FROM important UNION ALL SELECT * FROM due UNION ALL SELECT * FROM recent", lambda t: fa.resume_tiers(t.facts, [1, 3, 12], now()))
_resumed = lambda t: mq.resume_context(t.facts, t.scopes, "/ASIA", now())
_H = "scope_id IN (1, 4)"
query("resume_context", "WITH " + ", ".join([_tier("pinned", "is_pinned", "importance_score DESC", 50, []), _tier("important", f"{_H} AND importance_score >= 0.7", "importance_score DESC", 20, ["pinned"]), _tier("due", f"{_H} AND t_valid IS NOT NULL", "t_valid", 10, ["pinned", "important"]), _tier("recent", _H, "t_created DESC", 10, ["pinned", "important", "due"])]) + " SELECT * FROM pinned UNION ALL SELECT * FROM important UNION ALL SELECT * FROM due UNION ALL SELECT * FROM recent", lambda t: _resumed(t)[0])
query("retrieval_metrics", "WITH res AS (SELECT doc_id % 5 AS query_id, doc_id AS id, row_number() OVER (PARTITION BY doc_id % 5 ORDER BY (doc_id * 31) % 97, doc_id) - 1 AS rank FROM documents), rel AS (SELECT doc_id % 5 AS query_id, doc_id AS id, doc_id % 3 AS grade FROM documents WHERE doc_id % 3 > 0), g AS (SELECT rel.query_id, rank, (pow(2, grade) - 1) / log2(rank + 2) AS gain FROM res JOIN rel USING (query_id, id) WHERE rank < 10), h AS (SELECT query_id, count(*) AS hits, min(rank) AS f, sum(gain) AS dcg FROM g GROUP BY query_id), i AS (SELECT query_id, count(*) AS relevant, sum(CASE WHEN r < 10 THEN (pow(2, grade) - 1) / log2(r + 2) END) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, id) - 1 AS r FROM rel) GROUP BY query_id) SELECT query_id, round(coalesce(hits / 10, 0), 6) AS precision, round(coalesce(hits / relevant, 0), 6) AS recall, round(coalesce(1.0::DOUBLE / (f + 1), 0), 6) AS rr, round(coalesce(dcg / ideal, 0), 6) AS ndcg FROM i LEFT JOIN h USING (query_id)", lambda t: rt.retrieval_metrics(t.spark.sql("SELECT doc_id % 5 AS query_id, doc_id AS id, row_number() OVER (PARTITION BY doc_id % 5 ORDER BY (doc_id * 31) % 97, doc_id) - 1 AS rank FROM {d}", d=t.source("documents")), t.source("documents").select((c("doc_id") % 5).alias("query_id"), c("doc_id").alias("id"), (c("doc_id") % 3).alias("grade")), 10))
_run = lambda t, archived=None, **parts: mq.execute(mq.MemoryQuery(**parts), t.facts, t.scopes, words(t), now(), archived)
_since = "timestamp '2024-01-20'"
query("query_by_importance", f"SELECT id, importance_score AS score, 'store' AS match_type FROM (SELECT * FROM facts WHERE {ACTIVE} AND importance_score >= 0.2 ORDER BY importance_score DESC, id LIMIT 60) WHERE {ASOF} AND fact_type = 'Semantic' ORDER BY 2 DESC, 1 LIMIT 20", lambda t: _run(t, limit=20, least_score=0.2, fact_type="Semantic"))
query("query_by_period", f"{_CL} SELECT id, importance_score AS score, 'store' AS match_type FROM facts WHERE {_PERIOD} AND is_pinned AND scope_id IN (SELECT id FROM cl WHERE ancestor = 1) ORDER BY 2 DESC, 1 LIMIT 20", lambda t: _run(t, limit=20, pinned_only=True, scope=("subtree", "/"), period=(F.expr("timestamp_ntz'2024-01-20 00:00:00'"), now())))
query("query_by_vector", f"{_CL}, v AS (SELECT id, t_valid, t_invalid, t_expired, importance_score, round(list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), {_Q}), 6) AS score FROM facts WHERE {ACTIVE} AND fact_type = 'Episodic' AND len(embedding) > 0 AND scope_id IN (SELECT cl.id FROM cl JOIN scopes s ON s.id = cl.ancestor WHERE s.label = 'EUROPE') ORDER BY score DESC, id LIMIT 30), k AS (SELECT * FROM v WHERE {ASOF} ORDER BY score DESC, id LIMIT 10) SELECT id, score, 'vector' AS match_type FROM k WHERE importance_score >= 0.1", lambda t: _run(t, limit=10, embedding=QUERY_VECTOR, fact_type="Episodic", scope=("subtree", " EUROPE /"), least_score=0.1))
_ASIA = "(SELECT ancestor FROM cl WHERE id = 4 UNION SELECT id FROM cl WHERE ancestor = 4)"
query("query_by_text", f"{_CL}, {_LEX}, k AS (SELECT id, round(score, 6) AS score FROM lex WHERE hit > 0 AND id IN (SELECT id FROM facts WHERE {ACTIVE} AND scope_id IN {_ASIA}) ORDER BY 2 DESC, 1 LIMIT 30) SELECT k.id, k.score, 'fts' AS match_type FROM k WHERE k.id IN (SELECT id FROM facts WHERE {ASOF}) ORDER BY 2 DESC, 1 LIMIT 10", lambda t: _run(t, limit=10, text=rt.any_word(" ".join(WORDS)), scope=("inherited", "/ASIA")))
_ONE = _LEX.replace(_words, "(VALUES ('the')) AS q(w)")
_OLD = f"CASE WHEN contains(lower(coalesce(content, '')), 'the') THEN 1.0::DOUBLE ELSE 0 END + CASE WHEN len(embedding) > 0 THEN greatest(list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), {_Q}), 0) ELSE 0 END"
_LIVE = f"round(list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), {_Q}), 6)"
query("query_hybrid_with_archives", f"WITH {_ONE}, l AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) - 1 AS r FROM (SELECT id, round(score, 6) AS score FROM lex WHERE hit > 0 AND id IN (SELECT id FROM facts WHERE {ACTIVE}) ORDER BY 2 DESC, 1 LIMIT 30)), v AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) - 1 AS r FROM (SELECT id, {_LIVE} AS score FROM facts WHERE {ACTIVE} AND len(embedding) > 0 ORDER BY 2 DESC, 1 LIMIT 30)), u AS (SELECT id, r, 1 AS l, 0 AS v FROM l UNION ALL SELECT id, r, 0, 1 FROM v), hy AS (SELECT id, round(sum(1.0::DOUBLE / (61 + r)), 6) AS score, CASE WHEN max(l) = 1 AND max(v) = 1 THEN 'both' WHEN max(l) = 1 THEN 'fts' ELSE 'vector' END AS match_type FROM u GROUP BY id), live_ AS (SELECT * FROM hy WHERE id IN (SELECT id FROM facts WHERE {ASOF}) ORDER BY score DESC, id LIMIT 10), old_ AS (SELECT id, round({_OLD}, 6) AS score, 'archive' AS match_type FROM facts WHERE t_expired IS NOT NULL AND round({_OLD}, 6) > 0 ORDER BY 2 DESC, 1 LIMIT 10) SELECT * FROM (SELECT * FROM live_ UNION ALL SELECT * FROM old_) ORDER BY score DESC, id LIMIT 10", lambda t: _run(t, t.facts.where(~fa.active()), limit=10, text="the", embedding=QUERY_VECTOR))
query("query_scope_set", f"SELECT id, importance_score AS score, 'store' AS match_type FROM (SELECT * FROM facts WHERE {ACTIVE} AND scope_id IN (4, 5) ORDER BY importance_score DESC, id LIMIT 60) WHERE {ASOF} ORDER BY 2 DESC, 1 LIMIT 20", lambda t: _run(t, limit=20, scope=("set", ("/ASIA", "/EUROPE", "/ASIA", "/nowhere"))))
query("query_unknown_scope", "SELECT id FROM facts WHERE FALSE", lambda t: _run(t, scope=("set", ("/nowhere", "/no/where"))).select("id"))
# Maintenance
_IMP = f"imp AS (SELECT f.id, fact_type, is_pinned, round(0.3 * CASE WHEN fact_type IN ('Semantic', 'Procedural') THEN 1 ELSE pow(2, -greatest(0, date_diff('second', last_accessed, @now) / 86400.0::DOUBLE) / 69.0) END + 0.2 * least(1, ln(1 + access_count) / ln(101)) + 0.3 * least(1, ln(1 + coalesce(degree, 0)) / ln(51)) + 0.2 * importance, 6) AS score FROM facts f LEFT JOIN deg ON deg.id = f.id WHERE {ACTIVE})"
query("importance_scores", f"WITH {_DEG}, {_IMP} SELECT * FROM imp", lambda t: co.importance(t.facts, t.edges, now()))
query("prune_candidates", f"WITH {_DEG}, {_IMP} SELECT id, score FROM imp WHERE NOT is_pinned AND fact_type = 'Episodic' AND score < 0.45", lambda t: co.prune(co.importance(t.facts, t.edges, now()), 0.45).select("id", "score"))
query("prune_plan", f"WITH {_DEG}, {_IMP}, p AS (SELECT id FROM imp WHERE NOT is_pinned AND fact_type = 'Episodic' AND score < 0.45) SELECT id, CASE WHEN t_expired IS NULL AND (source_fact_id IN (SELECT id FROM p) OR target_fact_id IN (SELECT id FROM p)) THEN @now ELSE t_expired END AS t_expired FROM edges", lambda t: fa.expire_edges(t.edges, co.prune(co.importance(t.facts, t.edges, now()), 0.45).select("id"), now()).select("id", "t_expired"))
query("expire_facts", "SELECT id, CASE WHEN t_expired IS NULL AND id IN (2, 4, 11, 22) THEN @now ELSE t_expired END AS t_expired, CASE WHEN t_expired IS NULL AND id IN (2, 4, 11, 22) THEN @now ELSE t_invalid END AS t_invalid FROM facts", lambda t: fa.expire(t.facts, _ids(t, 2, 4, 11, 22), now(), True).select("id", "t_expired", "t_invalid"))
query("reinforce_upsert", f"SELECT content_hash, scope_id, min(id) AS id, arg_min(access_count, id) + count(*) - 1 AS access_count, min(t_created) AS t_created, max(last_accessed) AS last_accessed, max(is_pinned) AS is_pinned, max(importance) AS importance FROM (SELECT * FROM facts WHERE {ACTIVE} AND id < 500 UNION ALL SELECT * FROM facts WHERE id >= 500 AND content_hash NOT IN (SELECT content_hash FROM tombstones)) GROUP BY content_hash, scope_id", lambda t: fa.reinforce(t.facts.where("id < 500"), t.facts.where("id >= 500"), t.tombstones))
_SIM = "sim AS (SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(list_transform(a.embedding, lambda x: x::DOUBLE), list_transform(b.embedding, lambda x: x::DOUBLE)), 6) AS cos FROM facts a JOIN facts b ON a.id < b.id AND a.fact_type = b.fact_type WHERE a.t_expired IS NULL AND b.t_expired IS NULL AND len(a.embedding) > 0 AND len(b.embedding) > 0), sp AS (SELECT * FROM sim WHERE cos >= 0.3)"
_CC = "both_(a, b) AS (SELECT a, b FROM sp UNION SELECT b, a FROM sp), rr(a, b) AS (SELECT a, a FROM both_ UNION SELECT rr.a, both_.b FROM rr JOIN both_ ON rr.b = both_.a), cc AS (SELECT a AS id, min(b) AS cluster FROM rr GROUP BY a)"
_sim = lambda t: co.similar_pairs(t.facts.where(fa.active()), 0.3, on="fact_type")
query("near_duplicate_pairs", f"WITH {_SIM} SELECT * FROM sp", _sim)
query("similarity_clusters", f"WITH RECURSIVE {_SIM}, {_CC} SELECT id, cluster FROM cc", lambda t: co.clusters(_sim(t)))
query("cluster_summary_scope", f"WITH RECURSIVE {_SIM}, {_CC}, n AS (SELECT cluster, scope_id, count(*) AS n FROM cc JOIN facts USING (id) GROUP BY ALL) SELECT cluster, sum(n)::BIGINT AS members, first(scope_id ORDER BY n DESC, scope_id) AS scope_id FROM n GROUP BY cluster", lambda t: co.majority_scope(co.clusters(_sim(t)), t.facts))
query("medoid_per_cluster", f"WITH RECURSIVE {_SIM}, {_CC} SELECT cluster, first(id ORDER BY importance_score DESC, id) AS medoid, max(importance_score) AS score FROM cc JOIN facts USING (id) GROUP BY cluster", lambda t: co.medoid(co.clusters(_sim(t)), t.facts))
query("dbscan_clusters", f"WITH RECURSIVE {_SIM}, nb(a, b) AS (SELECT a, b FROM sp UNION ALL SELECT b, a FROM sp), co AS (SELECT a AS id FROM nb GROUP BY a HAVING count(*) >= 2), ce(a, b) AS (SELECT a, b FROM nb WHERE a IN (SELECT id FROM co) AND b IN (SELECT id FROM co)), rr(a, b) AS (SELECT id, id FROM co UNION SELECT rr.a, ce.b FROM rr JOIN ce ON rr.b = ce.a), cl AS (SELECT a AS id, min(b) AS cluster FROM rr GROUP BY a), fi AS (SELECT cluster, min((1 - importance_score) * 1000000 + id / 100000.0) AS f FROM cl JOIN facts USING (id) GROUP BY cluster) SELECT id, cluster FROM cl UNION ALL SELECT nb.a, first(cluster ORDER BY f) FROM nb JOIN cl ON cl.id = nb.b JOIN fi USING (cluster) WHERE nb.a NOT IN (SELECT id FROM co) GROUP BY nb.a", lambda t: co.dbscan(_sim(t), t.facts.select("id", ((1 - c("importance_score")) * 1000000 + c("id") / 100000.0).alias("position"))))
query("dedup_plan", None, lambda t: co.dedup_plan(_sim(t), t.facts))
query("outcome_adjustments", "WITH o AS (SELECT fact_id, count(*) FILTER (outcome = 'Positive') AS p, count(*) FILTER (outcome = 'Negative') AS n FROM outcomes WHERE outcome <> 'Other' GROUP BY fact_id) SELECT fact_id, CASE WHEN p = 0 AND n >= 3 THEN 'quarantine' ELSE 'adjust' END AS action, CASE WHEN p = 0 AND n >= 3 THEN 0 ELSE greatest(-2, least(2, p - n)) END::BIGINT AS steps FROM o", lambda t: co.adjustments(co.outcome_counts(t.outcomes)))
query("conflict_apply", "SELECT id, decision, CASE WHEN t_expired IS NULL AND decision IN ('update', 'delete') THEN @now ELSE t_expired END AS t_expired, CASE WHEN t_expired IS NULL AND decision IN ('update', 'delete') THEN @now ELSE t_invalid END AS t_invalid, CASE WHEN decision = 'update' THEN 'contradicts' WHEN decision = 'add' AND t_expired IS NULL THEN 'supplements' END AS edge FROM (SELECT *, CASE id % 4 WHEN 0 THEN 'add' WHEN 1 THEN 'update' WHEN 2 THEN 'delete' ELSE 'noop' END AS decision FROM facts)", lambda t: co.conflict_apply(t.facts, t.facts.select("id", F.expr("CASE id % 4 WHEN 0 THEN 'add' WHEN 1 THEN 'update' WHEN 2 THEN 'delete' ELSE 'noop' END").alias("decision")), now()))
# Mutations
query("forget_plan", "WITH ch AS (SELECT * FROM facts WHERE id IN (5, 9, 14)) SELECT DISTINCT f.id, coalesce(f.t_expired, @now) AS t_expired, least(coalesce(f.t_invalid, @now), @now) AS t_invalid, f.t_expired AS prior_t_expired, f.t_invalid AS prior_t_invalid FROM facts f WHERE f.id IN (5, 9, 14) OR (f.t_expired IS NULL AND EXISTS (SELECT 1 FROM ch WHERE ch.content_hash = f.content_hash AND ch.scope_id = f.scope_id))", lambda t: fa.forget(t.facts, _ids(t, 5, 9, 14), now()))
query("unforget_plan", "SELECT f.id, f.scope_id, t.prior_t_expired AS t_expired, t.prior_t_invalid AS t_invalid FROM facts f JOIN tombstones t ON t.fact_id = f.id WHERE t.record_event_id = 33", lambda t: fa.unforget(t.facts, t.tombstones, 33))
query("erase_closure", f"WITH RECURSIVE cl(ancestor, id, d) AS (SELECT id, id, 0 FROM scopes UNION ALL SELECT s.parent_id, cl.id, d + 1 FROM cl JOIN scopes s ON s.id = cl.ancestor WHERE s.parent_id IS NOT NULL), r(id) AS (SELECT id FROM facts WHERE scope_id IN (SELECT id FROM cl WHERE ancestor = 3) UNION SELECT l.wisdom_fact_id FROM r JOIN lineage l ON l.source_fact_id = r.id) SELECT id FROM r", lambda t: gr.reach(t.facts.join(gr.scope_ids(t.scopes, 3, "subtree").select(c("id").alias("scope_id")), "scope_id", "left_semi").select("id"), t.lineage.select(c("source_fact_id").alias("a"), c("wisdom_fact_id").alias("b"))))
query("move_scope", "SELECT id, CASE WHEN id IN (3, 4, 7) AND scope_id = 13 AND t_expired IS NULL THEN 2 ELSE scope_id END::BIGINT AS scope_id FROM facts", lambda t: t.facts.select("id", F.when(c("id").isin(3, 4, 7) & (c("scope_id") == 13) & fa.active(), F.lit(2)).otherwise(c("scope_id")).cast("long").alias("scope_id")))
query("stamp_surfaced", f"SELECT id, coalesce(surfaced_at, @now) AS surfaced_at FROM facts WHERE {ASOF} AND t_valid IS NOT NULL", lambda t: t.facts.where(fa.due(now())).select("id", F.coalesce("surfaced_at", now()).alias("surfaced_at")))
query("archive_manifest", "SELECT count(*) AS fact_count, min(id) AS fact_id_min, max(id) AS fact_id_max, min(t_created) AS t_created_min, max(t_created) AS t_created_max FROM facts WHERE NOT is_pinned AND t_expired < @now AND len(embedding) > 0 AND id NOT IN (SELECT fact_id FROM tombstones) HAVING count(*) >= 5", lambda t: ss.archive_manifest(fa.archive_candidates(t.facts, t.tombstones, now()), 5))
# Activity and events
_KEY = ", ".join(ac.KEY)
query("activity_dedup", f"WITH g AS (SELECT *, CASE WHEN date_diff('microsecond', lag(ts) OVER w, ts) < 3600000000 THEN 0 ELSE 1 END AS nw FROM activity_events WINDOW w AS (PARTITION BY {_KEY} ORDER BY ts, id)), r AS (SELECT *, sum(nw) OVER (PARTITION BY {_KEY} ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS run FROM g) SELECT {_KEY}, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS occurrence_count, CASE WHEN count(*) > 1 THEN 'deduplicated' ELSE 'raw' END AS status FROM r GROUP BY {_KEY}, run", lambda t: ac.fold(t.activity_events, 3600))
query("activity_filter", "SELECT id, CASE WHEN contains(lower(tool_name), 'view') THEN 'ignore' WHEN contains(lower(tool_name), 'purchase') THEN 'promote' ELSE 'keep' END AS decision FROM activity_events", lambda t: ac.filter_class(t.activity_events, ["View"], ["PURCHASE"]).select("id", "decision"))
query("activities_per_session", "SELECT session_id, count(*) AS n FROM activity_events GROUP BY session_id", lambda t: t.activity_events.groupBy("session_id").agg(F.count(F.lit(1)).alias("n")))
query("checkpoints_latest", "SELECT session_id, scope_path, checkpoint_at, last_activity_id FROM checkpoints QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY checkpoint_at DESC, last_activity_id DESC) = 1", lambda t: ac.latest_checkpoints(t.checkpoints))
query("events_filtered", "SELECT id, event_type FROM event_log WHERE session_id IN ('s1', 's2') AND CAST(json_extract_string(payload, '$.k') AS INTEGER) >= 50", lambda t: t.event_log.where(c("session_id").isin("s1", "s2") & (F.get_json_object("payload", "$.k").cast("int") >= 50)).select("id", "event_type"))
query("replay_order", "SELECT id, timestamp FROM event_log ORDER BY timestamp, id LIMIT 50", lambda t: t.event_log.orderBy("timestamp", "id").limit(50).select("id", "timestamp"))
# Text
_hex_rule = rd.HEX_RULE.replace("'", "''")
query("redact_hex_context", rf"""SELECT doc_id, regexp_replace(text, '{_hex_rule}', '\1[REDACTED:hex-secret]', 'g') AS text FROM documents""", lambda t: t.source("documents").select("doc_id", rd.redact_hex(c("text")).alias("text")))
query("redact_full", None, lambda t: t.source("documents").select("doc_id", rd.redact_column(c("text")).alias("text")))
query("redaction_counters", None, lambda t: t.source("documents").select(F.explode(rd.rules_column(c("text"))).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n")))
query("token_entropy", r"""WITH tk AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[0-9a-f]{32,64}')) AS token FROM documents), ch AS (SELECT token, unnest(string_split(token, '')) AS x FROM tk), n AS (SELECT token, x, count(*) AS n FROM ch GROUP BY ALL) SELECT token, round(-sum(n / length(token)::DOUBLE * log2(n / length(token)::DOUBLE)), 6) AS entropy FROM n GROUP BY token""", lambda t: t.source("documents").select(F.explode(F.regexp_extract_all("text", F.lit("[0-9a-f]{32,64}"), F.lit(0))).alias("token")).distinct().select("token", F.round(tx.token_entropy(c("token")), 6).alias("entropy")))
query("session_turns", "SELECT conv_id, turn, text AS user_text, reply FROM (SELECT *, first(CASE WHEN role = 'assistant' THEN coalesce(text, '') END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS reply FROM conversations) WHERE role = 'user' AND reply IS NOT NULL", lambda t: ss.paired_turns(t.source("conversations")))
_tables = ", ".join(f"('{k}', [{', '.join(repr(w) for w in ws)}])" for k, ws in tx.KEYWORDS.items())
_error = f"contains(a, '{tx.ERROR}') AND (" + " OR ".join(f"contains(a, '{w}')" for w in tx.ERROR_CONTEXT) + ")"
_of = lambda role: F.when(c("role") == role, c("text"))
query("keyword_episodes", f"WITH x AS (SELECT conv_id, turn, lower(coalesce(CASE WHEN role = 'user' THEN text END, '')) AS u, lower(coalesce(CASE WHEN role = 'assistant' THEN text END, '')) AS a FROM conversations), k(category, words) AS (VALUES {_tables}), m AS (SELECT conv_id, turn, category, list_concat(list_filter(words, lambda w: contains(u || chr(10) || a, w)), CASE WHEN category = 'bug' AND {_error} THEN ['{tx.ERROR}'] ELSE [] END) AS w FROM x, k) SELECT conv_id, turn, category, array_to_string(w, ',') AS words FROM m WHERE len(w) > 0", lambda t: t.source("conversations").select("conv_id", "turn", F.explode(tx.keywords(_of("user"), _of("assistant"), F.lit(None).cast("string"))).alias("category", "w")).select("conv_id", "turn", "category", F.array_join("w", ",").alias("words")))
_reply_calls = lambda: F.array(F.struct(F.lit("Bash").alias("tool"), c("user_text").alias("command"), c("reply").alias("stdout"), F.lit(None).cast("string").alias("stderr"), F.lit(False).alias("interrupted")))
_mood = "CASE WHEN " + " OR ".join(f"contains(u, '{w}')" for w in tx.POSITIVE) + " THEN 'positive' WHEN " + " OR ".join("contains(u, '" + w.replace("'", "''") + "')" for w in tx.NEGATIVE) + " THEN 'negative' ELSE 'neutral' END"
query("session_outcome", f"WITH p AS (SELECT conv_id, turn, role, lower(coalesce(text, '')) AS u, lower(first(CASE WHEN role = 'assistant' THEN coalesce(text, '') END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) AS r FROM conversations), s AS (SELECT conv_id AS session_id, bool_or(contains(u, 'git commit') OR contains(r, '[main') OR contains(r, '[master') OR regexp_matches(r, '[0-9a-f]{{7}}')) AS g, bool_or(contains(r, 'test result: ok') OR (contains(r, 'passed') AND contains(r, 'test')) OR (contains(r, 'pytest') AND contains(r, ' ok'))) AS k, arg_max({_mood}, turn) AS mood FROM p WHERE role = 'user' AND r IS NOT NULL GROUP BY conv_id) SELECT session_id, mood, CASE WHEN g OR k THEN 'success' WHEN mood = 'negative' THEN 'failure' ELSE 'indeterminate' END AS outcome FROM s", lambda t: ss.session_outcomes(ss.paired_turns(t.source("conversations")).select(c("conv_id").alias("session_id"), F.lit(0).alias("at"), c("turn").alias("position"), "user_text", _reply_calls().alias("calls"))).select("session_id", "mood", "outcome"))
query("text_chunks", "WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents), p AS (SELECT doc_id, w, unnest(range(0, ((len(w) + 127) // 128)::BIGINT)) AS n FROM w) SELECT doc_id, n::INTEGER AS at, array_to_string(w[n * 128 + 1 : (n + 1) * 128], ' ') AS chunk FROM p", lambda t: t.source("documents").select("doc_id", F.posexplode(tx.chunks(c("text"))).alias("at", "chunk")))
query("matryoshka", "SELECT vec_id, list_transform(embedding[1:16], lambda x: round(x::DOUBLE / sqrt(list_sum(list_transform(embedding[1:16], lambda y: y::DOUBLE * y::DOUBLE))), 6)) AS v FROM embeddings", lambda t: t.source("embeddings").select("vec_id", tx.matryoshka(c("embedding"), 16).alias("v")))
# Inspection
_STATE = "CASE WHEN id IN (SELECT fact_id FROM tombstones) THEN 'Forgotten' WHEN t_expired IS NOT NULL THEN 'Expired' WHEN t_invalid <= @now THEN 'Invalidated' WHEN is_pinned THEN 'Pinned' WHEN t_valid <= @now THEN 'Due' ELSE 'Active' END AS state"
_state = lambda t: t.facts.join(t.tombstones.select(c("fact_id").alias("id"), F.lit(True).alias("forgotten")).distinct(), "id", "left").withColumn("forgotten", F.coalesce("forgotten", F.lit(False))).withColumn("state", fa.state(now()))
query("fact_state", f"SELECT id, {_STATE} FROM facts", lambda t: _state(t).select("id", "state"))
query("fact_timeline", "SELECT id, moment, what FROM (" + " UNION ALL ".join(f"SELECT id, {n} AS moment, '{n}' AS what FROM facts" for n in ("t_created", "t_valid", "t_invalid", "t_expired", "surfaced_at")) + ") WHERE moment IS NOT NULL", lambda t: fa.timeline(t.facts))
query("explain_fact", f"WITH {_DEG} SELECT f.id, {_STATE.replace('id IN', 'f.id IN')}, e.session_id, coalesce(d.degree, 0) AS degree FROM facts f LEFT JOIN event_log e ON e.id = f.source_event_id LEFT JOIN deg d ON d.id = f.id WHERE f.id BETWEEN 10 AND 40", lambda t: _state(t).where("id between 10 and 40").join(t.event_log.select(c("id").alias("source_event_id"), "session_id"), "source_event_id", "left").join(gr.degree(t.edges), "id", "left").select("id", "state", "session_id", F.coalesce("degree", F.lit(0)).alias("degree")))
# Ingest and cycle
_BATCH = "SELECT doc_id AS idx, CASE WHEN doc_id % 19 = 0 THEN NULL ELSE text END AS content, CASE WHEN doc_id % 14 = 0 THEN CAST(1.5 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS importance, CAST(NULL AS @ts) AS t_valid, CAST(NULL AS @ts) AS t_invalid FROM "
_batch = lambda t: t.spark.sql(_BATCH.replace("@ts", "TIMESTAMP_NTZ") + "{d}", d=t.source("documents"))
query("batch_insert_results", "WITH b AS (" + _BATCH.replace("@ts", "TIMESTAMP") + "documents) SELECT idx, CASE WHEN content IS NULL OR octet_length(encode(content)) > 1048576 OR importance NOT BETWEEN 0 AND 1 THEN 'invalid' WHEN substr(sha256(content), 1, 32) IN (SELECT content_hash FROM tombstones) THEN 'blocked' ELSE 'created' END AS status FROM b", lambda t: ig.insert_results(_batch(t), t.tombstones))
_FINE = "idx % 19 <> 0 AND idx % 14 <> 0"
query("batch_insert_atomic", "WITH b AS (" + _BATCH.replace("@ts", "TIMESTAMP") + f"documents) SELECT idx FROM b WHERE {_FINE} AND substr(sha256(content), 1, 32) NOT IN (SELECT content_hash FROM tombstones)", lambda t: (lambda b: ig.all_or_nothing(b, ig.insert_results(b, t.tombstones)))(fa.without_hashes(_batch(t).where(_FINE), t.tombstones)).select("idx"))
query("batch_insert_atomic_refused", "SELECT doc_id AS idx FROM documents WHERE FALSE", lambda t: ig.all_or_nothing(_batch(t), ig.insert_results(_batch(t), t.tombstones)).select("idx"))
query("content_hashes", "SELECT doc_id, substr(sha256(text), 1, 32) AS h FROM documents", lambda t: t.source("documents").select("doc_id", ig.content_hash(c("text")).alias("h")))
query("metadata_patch", """SELECT id, CASE WHEN id % 5 = 0 THEN '{"dream_cycle":true,"k":{"a":[1,"x",null]}}' ELSE '{"k":{"a":[1,"x",null]}}' END AS m FROM facts""", lambda t: t.facts.select("id", ig.merge_metadata(c("metadata"), F.lit('{"k":{"a":[1,"x",null]}}')).alias("m")))
query("metadata_patch_keeps_types", """SELECT id, CASE WHEN id % 5 = 0 THEN '{"dream_cycle":true,"z":1.5}' WHEN id % 6 = 0 THEN '{"k":null,"z":1.5}' ELSE concat('{"k":', id % 10, ',"z":1.5}') END AS m FROM facts""", lambda t: t.facts.select("id", ig.merge_metadata(c("metadata"), F.lit('{"z":1.5}')).alias("m")))
query("space_status", "SELECT 'new' AS space_id, (SELECT count(*) FROM fact_vectors WHERE space_id = 'new') AS vectors, (SELECT count(*) FROM facts WHERE id NOT IN (SELECT fact_id FROM fact_vectors WHERE space_id = 'new')) AS pending", lambda t: ig.space_status(t.fact_vectors, t.facts, "new"))
query("erase_edges", "SELECT id FROM edges WHERE source_fact_id NOT IN (7, 11) AND target_fact_id NOT IN (7, 11)", lambda t: ig.erase({"edges": t.edges}, _ids(t, 7, 11))["edges"].select("id"))
query("promotion_candidates", f"WITH RECURSIVE {_SIM}, {_CC}, md AS (SELECT cluster, first(id ORDER BY importance_score DESC, id) AS medoid, max(importance_score) AS score FROM cc JOIN facts USING (id) GROUP BY cluster HAVING count(*) >= 2) SELECT medoid, count(*) AS source_count, min(t_created) AS first_at, max(t_created) AS last_at, round(1 - 1.0::DOUBLE / count(*), 6) AS confidence FROM cc JOIN facts USING (id) JOIN md USING (cluster) WHERE score >= 0.75 GROUP BY medoid", lambda t: (lambda m: ig.promote(t.facts, m, co.medoid(m, t.facts).where("score >= 0.75")))(co.clusters(_sim(t))))
query("adjusted_scores", "WITH o AS (SELECT fact_id, count(*) FILTER (outcome = 'Positive') AS p, count(*) FILTER (outcome = 'Negative') AS n FROM outcomes WHERE outcome <> 'Other' GROUP BY fact_id) SELECT id, round(least(1, greatest(0, importance_score + CASE WHEN p IS NULL OR (p = 0 AND n >= 3) THEN 0 ELSE greatest(-2, least(2, p - n)) END * 0.05)), 6) AS importance_score FROM facts LEFT JOIN o ON fact_id = id", lambda t: ig.adjust_scores(t.facts, co.adjustments(co.outcome_counts(t.outcomes))))
query("bootstrap_sessions", "SELECT DISTINCT session_id FROM event_log WHERE session_id NOT IN (SELECT session_id FROM checkpoints WHERE scope_path = '/')", lambda t: ig.new_sessions(t.event_log.select("session_id"), t.checkpoints.where("scope_path = '/'").select("session_id")))
query("project_facts", f"{_CL} SELECT f.id, f.t_created FROM facts f WHERE t_expired IS NULL AND scope_id IN (SELECT id FROM cl WHERE ancestor = 3) ORDER BY t_created DESC, f.id LIMIT 10", lambda t: ig.project_context(t.facts, ac.fold(t.activity_events), t.checkpoints, gr.scope_ids(t.scopes, 3, "subtree"))["facts"].select("id", "t_created"))
_PATHS = {
    "/home/x/.ssh/id_work": True, "/home/x/.ssh/config": False, "/home/x/.ssh/known_hosts.old": False, "/home/x/.ssh/id.pub": False, "/home/x/.ssh/authorized_keys2": False, ".SSH/Work": True,
    ".env": True, ".env.local": True, ".env.example": False, "host.env": True, "env": False, "a/.ENV": True, "x.env.sample": False, "etc/shadow": True, "/etc/gshadow": True, "/etc/shadow/readme": False, "shadow": False,
    "~/.aws/credentials": True, "a/../.aws/./credentials": True, ".aws/credentials.bak/x": False, "C:\\Users\\x\\.kube\\config": True, "kube/config": False, "~/.docker//config.json": True, ".npmrc": True, "npmrc": False,
    "deploy.key": True, "deploy.key.template": False, "cert.PEM": True, "key": False, "secrets/db.yaml": True, "secrets/readme.md": False, "vault/plain": True, "credentials.toml": True, "credentials.ts": False,
    "password.txt": True, "passwords.txt": False, "my_api_key.ini": True, "my_api_key.py": False, "private_key": True, "token.json": True, "tokens.json": False, "": False, "..": False, "../../id_rsa": True, "src/main.rs": False,
}
query("sensitive_paths", "SELECT * FROM (VALUES " + ", ".join(f"('{p}', {str(hit).upper()})" for p, hit in _PATHS.items()) + ") AS p(path, hit)", lambda t: t.spark.createDataFrame([(p,) for p in _PATHS], "path string").select("path", pa.sensitive_path(c("path")).alias("hit")))
query("lineage_of", "SELECT lineage_id, source_fact_id FROM lineage WHERE wisdom_fact_id = 45", lambda t: t.lineage.where("wisdom_fact_id = 45").select("lineage_id", "source_fact_id"))
query("archived_union", f"SELECT id, importance_score, 'live' AS origin FROM facts WHERE {ACTIVE} AND importance_score > 0.9 UNION ALL SELECT id, importance_score, 'archive' FROM facts WHERE t_expired IS NOT NULL AND importance_score > 0.9 ORDER BY importance_score DESC, id LIMIT 25", lambda t: fa.top(t.facts.where(fa.active()).select("id", "importance_score", F.lit("live").alias("origin")).unionByName(t.facts.where(~fa.active()).select("id", "importance_score", F.lit("archive").alias("origin"))).where("importance_score > 0.9"), 25, c("importance_score").desc()))
