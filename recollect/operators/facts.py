"""Filters, rankings, statistics and mutations of the bi-temporal fact table.

Mutations are functions from tables to tables: they return the new version and leave publishing it to the caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col


def active() -> Column:
    return c("t_expired").isNull()


def valid_at(t: Column) -> Column:
    """Half-open valid time; a null bound is open."""
    return (c("t_valid").isNull() | (c("t_valid") <= t)) & (c("t_invalid").isNull() | (c("t_invalid") > t))


def as_of(t: Column) -> Column:
    return active() & valid_at(t)


def due(t: Column) -> Column:
    return as_of(t) & c("t_valid").isNotNull()


def overlaps(start: Column, end: Column) -> Column:
    return active() & (c("t_valid").isNull() | (c("t_valid") < end)) & (c("t_invalid").isNull() | (c("t_invalid") > start))


def has_vector() -> Column:
    return F.coalesce(F.size("embedding") > 0, F.lit(False))


def _variant(key: str) -> Column:
    return F.try_variant_get(F.try_parse_json("metadata"), F.lit(f"$.{key}"), "variant")


def key_absent(key: str) -> Column:
    """The key is not there at all; a JSON null is there."""
    return _variant(key).isNull()


def key_present(key: str) -> Column:
    return _variant(key).isNotNull() & ~F.is_variant_null(_variant(key))


def key_equals(key: str, json: str) -> Column:
    return F.to_json(_variant(key)) == json


def top(facts: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows by the order, ties by id: one TakeOrdered, no full sort."""
    return facts.orderBy(*order, "id").limit(k)


def among(facts: DataFrame, ids: DataFrame) -> DataFrame:
    return facts.join(ids, "id", "left_semi")


def without(facts: DataFrame, ids: DataFrame) -> DataFrame:
    return facts.join(ids, "id", "left_anti")


def without_hashes(batch: DataFrame, tombstones: DataFrame) -> DataFrame:
    """The batch (content, ...) without content that was forgotten."""
    hashed = batch.withColumn("_c", F.substring(F.sha2("content", 256), 1, 32))
    return hashed.join(tombstones.select(c("content_hash").alias("_c")), "_c", "left_anti").drop("_c")


def page(facts: DataFrame, after: int, k: int) -> DataFrame:
    return facts.where(c("id") > after).orderBy("id").limit(k)


def recent_insights(facts: DataFrame, scopes: DataFrame, k: int, marker: str = "dream_cycle") -> DataFrame:
    """The newest k active facts of the scopes (id) that carry the marker; no scopes give none."""
    own = facts.where(active() & ~key_absent(marker)).join(scopes.select(c("id").alias("scope_id")), "scope_id", "left_semi")
    return top(own, k, c("t_created").desc())


def dormant(facts: DataFrame, now: Column, below: float = 0.5) -> DataFrame:
    return facts.where(as_of(now) & ~c("is_pinned") & (c("importance_score") < below) & has_vector())


def archive_candidates(facts: DataFrame, tombstones: DataFrame, before: Column) -> DataFrame:
    found = facts.where(~c("is_pinned") & (c("t_expired") < before) & has_vector())
    return found.join(tombstones.select(c("fact_id").alias("id")), "id", "left_anti")


def statistics(facts: DataFrame, now: Column) -> DataFrame:
    return facts.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(active()).alias("active"), F.count_if(~active()).alias("expired"), F.count_if(active() & c("is_pinned")).alias("pinned"), F.count_if(due(now)).alias("due")
    )


def reinforce(facts: DataFrame, new: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Upsert: equal active content in a scope is counted up and keeps the best of each side; tombstoned content of new is refused."""
    open_new = new.join(tombstones.select("content_hash").distinct(), "content_hash", "left_anti")
    cols = ["id", "content_hash", "scope_id", "access_count", "t_created", "last_accessed", "is_pinned", "importance"]
    both = facts.where(active()).select(*cols, F.lit(0).alias("again")).unionByName(open_new.select(*cols, F.lit(1).alias("again")))
    return both.groupBy("content_hash", "scope_id").agg(
        F.min("id").alias("id"),
        (F.max_by("access_count", F.struct(-c("again"), -c("id"))) + F.count(F.lit(1)) - 1).alias("access_count"),
        F.min("t_created").alias("t_created"),
        F.max("last_accessed").alias("last_accessed"),
        F.max("is_pinned").alias("is_pinned"),
        F.max("importance").alias("importance"),
    )


def expire(facts: DataFrame, ids: DataFrame, now: Column, invalidate: bool = False) -> DataFrame:
    """Closes system time, and valid time if asked, of the given facts where they are still active."""
    hit = facts.join(ids.select(c("id").alias("_id"), F.lit(True).alias("_hit")), c("id") == c("_id"), "left").withColumn("_hit", c("_hit").isNotNull() & active())
    if invalidate:
        hit = hit.withColumn("t_invalid", F.when(c("_hit"), now).otherwise(c("t_invalid")))
    return hit.withColumn("t_expired", F.when(c("_hit"), now).otherwise(c("t_expired"))).drop("_id", "_hit")


def expire_edges(edges: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    ends = edges.where(active()).select("id", F.explode(F.array("source_fact_id", "target_fact_id")).alias("end"))
    return expire(edges, ends.join(ids.select(c("id").alias("end")), "end", "left_semi").select("id").distinct(), now)


def forget(facts: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """(id, t_expired, t_invalid, prior_t_expired, prior_t_invalid) of the chosen facts and active copies in their scope."""
    chosen = facts.join(ids, "id", "left_semi")
    homes = chosen.select("content_hash", "scope_id").distinct()
    copies = facts.where(active()).join(homes, ["content_hash", "scope_id"], "left_semi")
    hit = chosen.select("id", "t_expired", "t_invalid").unionByName(copies.select("id", "t_expired", "t_invalid")).distinct()
    return hit.select("id", F.coalesce("t_expired", now).alias("t_expired"), F.least(F.coalesce("t_invalid", now), now).alias("t_invalid"), c("t_expired").alias("prior_t_expired"), c("t_invalid").alias("prior_t_invalid"))


def unforget(facts: DataFrame, tombstones: DataFrame, record: int) -> DataFrame:
    """Facts of one retraction with the bounds they had before."""
    t = tombstones.where(c("record_event_id") == record).select(c("fact_id").alias("id"), "prior_t_expired", "prior_t_invalid")
    return facts.select("id", "scope_id").join(t, "id").select("id", "scope_id", c("prior_t_expired").alias("t_expired"), c("prior_t_invalid").alias("t_invalid"))


def state(now: Column) -> Column:
    """Tombstone, then expired, invalidated, pinned, due, active; needs `forgotten` on the rows."""
    return (
        F.when(c("forgotten"), "Forgotten").when(c("t_expired").isNotNull(), "Expired").when(c("t_invalid") <= now, "Invalidated").when(c("is_pinned"), "Pinned").when(due(now), "Due").otherwise("Active")
    )


def timeline(facts: DataFrame) -> DataFrame:
    names = ("t_created", "t_valid", "t_invalid", "t_expired", "surfaced_at")
    steps = F.array(*[F.struct(c(n).alias("moment"), F.lit(n).alias("what")) for n in names])
    return facts.select("id", F.explode(steps).alias("s")).select("id", "s.*").where("moment is not null")


def resume_tiers(facts: DataFrame, scopes: list[int], now: Column, sizes: tuple[int, int, int, int] = (50, 20, 10, 10), high: float = 0.7) -> DataFrame:
    """(tier, rank, id): pinned of all scopes, then important, due and recent facts of the scopes, each without earlier ones."""
    cols = ["id", "scope_id", "is_pinned", "importance_score", "t_valid", "t_invalid", "t_created", "t_expired"]
    live = facts.where(as_of(now)).select(*cols)
    here = live.where(c("scope_id").isin(scopes))
    steps = [
        ("pinned", live.where("is_pinned"), c("importance_score").desc()),
        ("important", here.where(c("importance_score") >= high), c("importance_score").desc()),
        ("due", here.where(due(now)), c("t_valid").asc()),
        ("recent", here, c("t_created").desc()),
    ]
    # A tier's rows are among its first k and as many as the tiers before hold, so each reads the facts once, and what
    # is taken is settled among those few rows.
    few = None
    for n, ((_, rows, order), k) in enumerate(zip(steps, sizes)):
        got = top(rows, sum(sizes[: n + 1]), order).withColumn("at", F.row_number().over(Window.orderBy(order, "id"))).select(F.lit(n).alias("n"), "at", "id")
        few = got if few is None else few.unionByName(got)
    most = F.array(*map(F.lit, sizes))

    def take(done: Column, x: Column) -> Column:
        own = F.size(F.filter(done, lambda y: y["n"] == x["n"]))
        fits = ~F.exists(done, lambda y: y["id"] == x["id"]) & (own < F.get(most, x["n"]))
        return F.when(fits, F.array_append(done, F.struct(x["n"].alias("n"), (own + 1).cast("long").alias("rank"), x["id"].alias("id")))).otherwise(done)

    taken = few.agg(F.sort_array(F.collect_list(F.struct("n", "at", "id"))).alias("x")).select(F.inline(F.aggregate("x", F.array().cast("array<struct<n: int, rank: bigint, id: bigint>>"), take)))
    return taken.select(F.get(F.array(*[F.lit(t) for t, _, _ in steps]), c("n")).alias("tier"), "rank", "id")
