"""The one query over memory: by text, vector or both, or by importance; scoped, timed and filtered."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.operators import facts as fa
from recollect.operators import graph as gr
from recollect.operators import retrieval as rt
from recollect.operators import store as st
from recollect.operators.ingest import Reranker, rerank

c = F.col
OVER = 3  # candidates fetched for each row wanted
SCOPES = ("exact", "subtree", "ancestors", "inherited", "set")


@dataclass(frozen=True)
class MemoryQuery:
    """scope: (kind of SCOPES, path or paths). Times are columns or literals of timestamps; a period is half open."""

    text: str | None = None
    embedding: Sequence[float] | None = None
    mode: str | None = None
    scope: tuple[str, str | tuple[str, ...]] | None = None
    fact_type: str | None = None
    period: tuple[Column, Column] | None = None
    valid_at: Column | None = None
    least_score: float | None = None
    pinned_only: bool = False
    limit: int = 50

    def checked_mode(self) -> str | None:
        """lexical, vector, hybrid, or None for the ranking by importance; a ValueError where the parts do not fit."""
        if self.valid_at is not None and self.period is not None:
            raise ValueError("an instant and a period exclude each other")
        if self.scope and self.scope[0] not in SCOPES:
            raise ValueError(f"no scope is {self.scope[0]}")
        has = (self.text is not None, self.embedding is not None)
        if self.mode is None:
            return {(True, True): "hybrid", (True, False): "lexical", (False, True): "vector"}.get(has)
        needs = {"lexical": has[0], "vector": has[1], "hybrid": all(has)}
        if self.mode not in needs or not needs[self.mode]:
            raise ValueError(f"the query has not what mode {self.mode} needs")
        return self.mode if any(has) else None


def resolve(scopes: DataFrame, path: str) -> int | None:
    """The scope of a path, parts trimmed; None where there is none."""
    plain = "/" + "/".join(p.strip() for p in path.split("/") if p.strip())
    row = gr.scope_paths(scopes).where(c("path") == plain).first()
    return row.id if row else None


def scope_set(scopes: DataFrame, kind: str, paths: str | tuple[str, ...]) -> DataFrame:
    """(scope_id) of a scope query; paths that lead nowhere give no rows."""
    wanted = (paths,) if isinstance(paths, str) else paths
    ids = [i for i in dict.fromkeys(resolve(scopes, p) for p in wanted) if i is not None]
    if not ids:
        return scopes.limit(0).select(c("id").alias("scope_id"))
    found = [gr.scope_ids(scopes, i, "exact" if kind == "set" else kind) for i in ids]
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.distinct().select(c("id").alias("scope_id"))


def execute(q: MemoryQuery, facts: DataFrame, scopes: DataFrame, index: DataFrame, now: Column, archived: DataFrame | None = None) -> DataFrame:
    """(id, score, match_type), best first, ties by id. Scores are BM25, cosine, fused ranks or importance by the mode.

    A search ranks all active facts of the scope and type, takes OVER times the limit from each channel, cuts to what is
    valid, and to the limit; period, score and pin are looked at after that, so fewer rows may come. Without an instant
    or a period, facts have to be valid now; a search by period takes only facts that were never invalidated.
    `archived` joins archive hits to a search.
    """
    mode = q.checked_mode()
    kept = facts.where(fa.active())
    if q.scope:
        kept = kept.join(scope_set(scopes, *q.scope), "scope_id", "left_semi")
    instant = q.valid_at if q.valid_at is not None else now
    overlap = fa.overlaps(*q.period) if q.period else F.lit(True)
    least = c("importance_score") >= q.least_score if q.least_score is not None else F.lit(True)
    pinned = c("is_pinned") if q.pinned_only else F.lit(True)
    of_type = c("fact_type") == q.fact_type if q.fact_type else F.lit(True)
    if mode is None:
        if q.period:
            rows = kept.where(overlap & of_type & least & pinned)
        else:
            rows = fa.top(kept.where(least), OVER * q.limit, c("importance_score").desc()).where(fa.valid_at(instant) & of_type & pinned)
        return fa.top(rows, q.limit, c("importance_score").desc()).select("id", c("importance_score").alias("score"), F.lit("store").alias("match_type"))
    kept = kept.where(of_type)
    channels = {}
    if mode != "vector":
        channels["fts"] = rt.ranked(rt.lexical_search(index, q.text).join(kept.select("id"), "id", "left_semi"), OVER * q.limit)
    if mode != "lexical":
        channels["vector"] = rt.ranked(rt.vector_scores(kept, list(q.embedding)), OVER * q.limit)
    if mode == "hybrid":
        found = rt.fuse(channels["fts"], channels["vector"])
    else:
        name, rows = next(iter(channels.items()))
        found = rows.select("id", "score", F.lit(name).alias("match_type"))
    valid = c("t_invalid").isNull() if q.period else fa.valid_at(instant)
    narrow = kept.select("id", "t_valid", "t_invalid", "t_expired", "importance_score", "is_pinned")
    met = narrow.where(valid).join(F.broadcast(found), "id")  # as many rows as both channels hold
    out = met.orderBy(c("score").desc(), "id").limit(q.limit).where(overlap & least & pinned).select("id", "score", "match_type")
    if archived is not None:
        old = rt.archive_search(archived, q.text or "", list(q.embedding or []), q.limit).select("id", "score", F.lit("archive").alias("match_type"))
        out = out.unionByName(old)
    return out.orderBy(c("score").desc(), "id").limit(q.limit)


def resume_context(facts: DataFrame, scopes: DataFrame, path: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """(tiers, facts): resume tiers of the scope of a path and its ancestors, and the facts with what was due stamped.

    NotFound if no scope has the path.
    """
    scope = resolve(scopes, path)
    if scope is None:
        raise st.NotFound(path)
    own = [r.id for r in gr.scope_ids(scopes, scope, "ancestors").collect()]  # as many as the path has parts
    tiers = fa.resume_tiers(facts, own, now)
    return tiers, st.stamp_surfaced(facts, tiers.where("tier = 'due'").select("id"), now)[0]


def execute_reranked(q: MemoryQuery, facts: DataFrame, scopes: DataFrame, index: rt.LexicalIndex, now: Column, reranker: Reranker, depth: int = 30) -> list[tuple[int, float]]:
    """(id, score) of a query, its `depth` best reordered by a reranker, which may leave some out; cut to the limit.

    Only a query with a text is reranked. A reranker whose answer names a row twice or one that is not there is an error.
    """
    found = execute(q, facts, scopes, index, now)
    if q.text is None:
        return [(r.id, r.score) for r in found.collect()]  # the limit's rows
    return rerank(found.join(facts.select("id", "content"), "id"), reranker, q.text, depth)[: q.limit]
