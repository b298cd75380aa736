"""What is known of facts: their state and why, where they are, what they touch; and erasing all that came from a place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.operators import facts as fa
from recollect.operators import graph as gr
from recollect.operators.ingest import erase

c = F.col


def expiry_reason() -> Column:
    """Why an expired fact is: Quarantined if a cycle said so, else Unknown; null for others."""
    return F.when(c("t_expired").isNotNull(), F.when(fa.key_present("quarantine"), "Quarantined").otherwise("Unknown"))


def explain(facts: DataFrame, tombstones: DataFrame, events: DataFrame, edges: DataFrame, scopes: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """(id, state, reason, path, session_id, degree, neighbours, component_size) of the facts ids (id)."""
    forgotten = tombstones.select(c("fact_id").alias("id"), F.lit(True).alias("forgotten")).distinct()
    own = facts.join(ids.select("id").distinct(), "id", "left_semi").join(forgotten, "id", "left").withColumn("forgotten", F.coalesce("forgotten", F.lit(False)))
    told = own.select("id", fa.state(now).alias("state"), expiry_reason().alias("reason"), "scope_id", "source_event_id")
    told = told.join(gr.scope_paths(scopes).withColumnRenamed("id", "scope_id"), "scope_id", "left").join(events.select(c("id").alias("source_event_id"), "session_id"), "source_event_id", "left")
    return told.join(gr.context(edges, own.select("id")), "id").select("id", "state", "reason", "path", "session_id", "degree", "neighbours", "component_size")


def made_from(facts: DataFrame, lineage: DataFrame, ids: DataFrame) -> DataFrame:
    """(id) of the facts ids (id) and all that was made from them, over any number of steps."""
    return gr.reach(facts.join(ids.select("id"), "id", "left_semi").select("id"), lineage.select(c("source_fact_id").alias("a"), c("wisdom_fact_id").alias("b")))


def erase_facts(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """The tables (facts, lineage, and any of edges, fact_vectors, embed_queue, tombstones) without the facts and what was made from them."""
    return erase(tables, made_from(tables["facts"], tables["lineage"], ids))


def erase_scope(tables: dict[str, DataFrame], scopes: DataFrame, scope: int) -> dict[str, DataFrame]:
    """erase_facts of a scope's whole subtree, such as a machine's."""
    own = tables["facts"].join(gr.scope_ids(scopes, scope, "subtree").select(c("id").alias("scope_id")), "scope_id", "left_semi")
    return erase_facts(tables, own.select("id"))
