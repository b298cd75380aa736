"""Embedding identity, and the life of embedding spaces: active, populating, deprecated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.operators import facts as fa
from recollect.operators.ingest import EmbeddingProvider, embed
from recollect.operators.store import NotFound

c = F.col
STATES = ("active", "populating", "deprecated")


class IdentityMismatch(ValueError):
    """The provider is not the one that the stored vectors come from."""


def check_identity(meta: dict[str, str], provider: EmbeddingProvider) -> dict[str, str]:
    """The stored identity (name, dim), recorded from the provider if there is none; IdentityMismatch if they differ.

    To be called before any vector is written or searched.
    """
    name, dim = provider.fingerprint()
    own = {"embedding_name": name, "embedding_dim": str(dim)}
    if not meta.get("embedding_name"):
        return meta | own
    if any(meta.get(k) != v for k, v in own.items()):
        raise IdentityMismatch(f"vectors are of {meta.get('embedding_name')} ({meta.get('embedding_dim')}), the provider is {name} ({dim})")
    return meta


def begin_space(spaces: DataFrame, space: str, name: str, dim: int, now: Column) -> DataFrame:
    """spaces (space_id, name, dim, status, created_at) with a populating one; an error if one is populating or has the id."""
    if not spaces.where((c("status") == "populating") | (c("space_id") == space)).isEmpty():
        raise ValueError(f"space {space} is there, or another one is populating")
    row = spaces.sparkSession.range(1).select(F.lit(space).alias("space_id"), F.lit(name).alias("name"), F.lit(dim).cast("int").alias("dim"), F.lit("populating").alias("status"), now.alias("created_at"))
    return spaces.unionByName(row.select(*spaces.columns))


def status(spaces: DataFrame, vectors: DataFrame, facts: DataFrame) -> DataFrame:
    """(space_id, status, vectors, pending): facts that a populating space has no vector of; 0 pending for the others."""
    n = vectors.groupBy("space_id").agg(F.count(F.lit(1)).alias("vectors"))
    has = vectors.select("space_id", c("fact_id").alias("id"))
    filling = spaces.where("status = 'populating'").select("space_id")  # at most one
    missing = facts.select("id").crossJoin(F.broadcast(filling)).join(has, ["space_id", "id"], "left_anti").groupBy("space_id").agg(F.count(F.lit(1)).alias("pending"))
    return spaces.select("space_id", "status").join(n, "space_id", "left").join(missing, "space_id", "left").na.fill(0, ["vectors", "pending"])


def backfill(facts: DataFrame, vectors: DataFrame, space: str, provider: EmbeddingProvider, dim: int, batch: int = 128) -> DataFrame:
    """vectors (fact_id, space_id, embedding) with those that the space lacks, `batch` texts a call of the provider."""
    left = facts.join(vectors.where(c("space_id") == space).select(c("fact_id").alias("id")), "id", "left_anti")
    new = embed(left, provider, dim, batch).withColumn("space_id", F.lit(space))
    return vectors.unionByName(new.select(*[c(n).cast(vectors.schema[n].dataType).alias(n) for n in vectors.columns]))


def promote_space(spaces: DataFrame, vectors: DataFrame, facts: DataFrame, queue: DataFrame, space: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(spaces, vectors, facts, queue): the populating space becomes active, its vectors those of the facts.

    Refused while a fact has no vector in it. The former active space is deprecated and keeps the facts' old vectors
    under its name; queue rows of facts that have a vector now are gone.
    """
    row = spaces.where((c("space_id") == space) & (c("status") == "populating")).limit(1).collect()
    if not row:
        raise NotFound(f"no populating space {space}")
    own = vectors.where(c("space_id") == space)
    pending = facts.join(own.select(c("fact_id").alias("id")), "id", "left_anti").count()
    if pending:
        raise ValueError(f"space {space} lacks {pending} vectors")
    old = [r.space_id for r in spaces.where("status = 'active'").select("space_id").collect()]
    kept = vectors.where(c("space_id") != space)
    if old:
        was = facts.where(fa.has_vector()).select(c("id").alias("fact_id"), F.lit(old[0]).alias("space_id"), "embedding")
        kept = kept.where(c("space_id") != old[0]).unionByName(was.select(*vectors.columns))
    moved = facts.join(own.select(c("fact_id").alias("_id"), c("embedding").alias("_new")), c("id") == c("_id"), "left")
    after = moved.select(*[F.coalesce("_new", "embedding").alias(n) if n == "embedding" else c(n) for n in facts.columns])
    states = spaces.withColumn("status", F.when(c("space_id") == space, "active").when(c("status") == "active", "deprecated").otherwise(c("status")))
    return states, kept.unionByName(own), after, queue.join(own.select("fact_id"), "fact_id", "left_anti").select(*queue.columns)


def drop_space(spaces: DataFrame, vectors: DataFrame, space: str) -> tuple[DataFrame, DataFrame]:
    """(spaces, vectors) without a deprecated space or one that populates; the active one may not go."""
    if not spaces.where((c("space_id") == space) & (c("status") == "active")).isEmpty():
        raise ValueError("the active space may not be dropped")
    return spaces.where(c("space_id") != space), vectors.where(c("space_id") != space)


def reconstruct(spaces: DataFrame, vectors: DataFrame, facts: DataFrame, queue: DataFrame, space: str, provider: EmbeddingProvider, now: Column) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(spaces, vectors, facts, queue) after a change of the embedder: begin the space, fill it, and promote it at once.

    Facts that are written meanwhile are not in `facts`; call backfill and promote_space again on the newer table.
    """
    name, dim = provider.fingerprint()
    if spaces.where(c("space_id") == space).isEmpty():
        spaces = begin_space(spaces, space, name, dim, now)
    return promote_space(spaces, backfill(facts, vectors, space, provider, dim), facts, queue, space)
