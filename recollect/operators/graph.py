"""Scopes and the fact graph: closures by rounds of equi-joins, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.operators.shared import materialize, release

c = F.col


def scope_closure(scopes: DataFrame, rounds: int = 64) -> DataFrame:
    """(ancestor, id, distance), itself included.

    One equi-join a level, as many as the deepest scope needs by its `depth`; without that column, until a level is empty.
    """
    step = scopes.select(c("id").alias("ancestor"), c("id"), F.lit(0).alias("distance"))
    out = step
    parents = scopes.select(c("id").alias("ancestor"), "parent_id").where("parent_id is not null")
    deepest = scopes.agg(F.max("depth")).first()[0] or 0 if "depth" in scopes.columns else None
    for n in range(rounds):
        if n == deepest:
            return out
        step = step.join(parents, "ancestor").select(c("parent_id").alias("ancestor"), "id", (c("distance") + 1).alias("distance"))
        if deepest is None and step.isEmpty():
            return out
        out = out.unionByName(step)
    raise RuntimeError("the scope tree is deeper than the rounds allow, or has a cycle")


def scope_paths(scopes: DataFrame) -> DataFrame:
    """(id, path): labels from the root down; the root is `/`."""
    closure = scope_closure(scopes).join(scopes.select(c("id").alias("ancestor"), "label", "parent_id"), "ancestor").where("parent_id is not null")
    joined = closure.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(-c("distance"), "label"))), lambda x: x["label"]), "/").alias("p"))
    return scopes.select("id").join(joined, "id", "left").select("id", F.concat(F.lit("/"), F.coalesce("p", F.lit(""))).alias("path"))


def scope_ids(scopes: DataFrame, scope: int | tuple[int, ...], kind: str) -> DataFrame:
    """(id) of exact, subtree, ancestors, inherited (ancestors and subtree) or set (several scopes, each once).

    Scopes that are not there give none.
    """
    if kind == "set":
        return scopes.where(c("id").isin(*scope)).select("id").distinct()
    closure = scope_closure(scopes)
    down = closure.where(c("ancestor") == scope).select("id")
    up = closure.where(c("id") == scope).select(c("ancestor").alias("id"))
    return {"exact": scopes.where(c("id") == scope).select("id"), "subtree": down, "ancestors": up, "inherited": up.union(down).distinct()}[kind]


def ensure_paths(scopes: DataFrame, paths: DataFrame) -> DataFrame:
    """scopes with a scope for each prefix of the paths (path); those that are there stay as they are.

    New ids go on from the largest one, in the order of depth and path. `/` and empty parts name no scope.
    """
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    each = paths.where(F.size(parts) > 0).select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.slice(parts, F.lit(1), n))).alias("p")).distinct()
    wanted = each.select(F.concat(F.lit("/"), F.array_join("p", "/")).alias("path"), F.element_at("p", -1).alias("label"), F.size("p").cast("long").alias("depth"), F.concat(F.lit("/"), F.array_join(F.slice("p", F.lit(1), F.size("p") - 1), "/")).alias("parent"))
    known = scope_paths(scopes)
    new = wanted.join(known.select("path"), "path", "left_anti")
    base = scopes.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_base"))  # one row
    new, _ = materialize(new.crossJoin(F.broadcast(base)).withColumn("id", c("_base") + F.row_number().over(Window.orderBy("depth", "path"))).drop("_base"), "scopes")  # as many rows as new scopes
    ids = known.unionByName(new.select("id", "path"))
    placed = new.join(ids.select(c("path").alias("parent"), c("id").alias("parent_id")), "parent")
    return scopes.unionByName(placed.select(*scopes.columns))


def live(edges: DataFrame) -> DataFrame:
    return edges.where("t_expired is null")


def degree(edges: DataFrame) -> DataFrame:
    """(id, degree): in and out, parallel edges each, a loop twice."""
    return live(edges).select(F.explode(F.array("source_fact_id", "target_fact_id")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def neighbours(edges: DataFrame, node: int, undirected: bool = False) -> DataFrame:
    out = live(edges).where(c("source_fact_id") == node).select(c("target_fact_id").alias("id"))
    if not undirected:
        return out
    back = live(edges).where(c("target_fact_id") == node).select(c("source_fact_id").alias("id"))
    return out.union(back).where(c("id") != node).distinct()


def components(pairs: DataFrame, rounds: int = 40) -> DataFrame:
    """(id, root) of undirected pairs (a, b): smallest-label rounds with pointer jumping."""
    both, _ = materialize(pairs.select("a", "b").union(pairs.select(c("b").alias("a"), c("a").alias("b"))).distinct(), "edges")
    labels, path = materialize(both.groupBy(c("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("root")), "labels")
    for _ in range(rounds):
        near = both.join(labels.select(c("id").alias("b"), "root"), "b").groupBy(c("a").alias("id")).agg(F.min("root").alias("m"))
        step = labels.join(near, "id").select("id", F.least("root", "m").alias("root"))
        jump = step.join(labels.select(c("id").alias("root"), c("root").alias("up")), "root", "left").select("id", F.least("root", F.coalesce("up", "root")).alias("root"))
        after, after_path = materialize(jump, "labels")
        settled = after.join(labels, ["id", "root"], "left_anti").isEmpty()
        release(labels, path)
        labels, path = after, after_path
        if settled:
            return labels
    raise RuntimeError("components did not settle")


def internal(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Live edges with both ends among ids (id)."""
    own = ids.select("id").distinct()
    return live(edges).join(own.select(c("id").alias("source_fact_id")), "source_fact_id", "left_semi").join(own.select(c("id").alias("target_fact_id")), "target_fact_id", "left_semi")


def counts(edges: DataFrame) -> DataFrame:
    """(nodes, edges): facts that a live edge touches, and live edges."""
    ends = live(edges).select(F.explode(F.array("source_fact_id", "target_fact_id")).alias("id"), F.lit(0).alias("e"))
    return ends.agg(F.count_distinct("id").alias("nodes"), F.expr("count(1) div 2").alias("edges"))


def has_node(edges: DataFrame, node: int) -> bool:
    return not live(edges).where((c("source_fact_id") == node) | (c("target_fact_id") == node)).isEmpty()


def component_of(edges: DataFrame, node: int) -> DataFrame:
    """(id) of the facts that live edges connect with the node, in any direction; none for a fact without edges.

    Labels of all components are computed at once, in rounds by the logarithm of their size, so a long path is no worse
    than a star.
    """
    pairs = live(edges).select(c("source_fact_id").alias("a"), c("target_fact_id").alias("b"))
    labels = components(pairs)
    return labels.join(labels.where(c("id") == node).select("root"), "root", "left_semi").select("id")


def context(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, degree, neighbours, component_size) of the facts ids (id): 0, none and 0 for a fact without edges."""
    pairs = live(edges).select(c("source_fact_id").alias("a"), c("target_fact_id").alias("b"))
    labels = components(pairs)
    sizes = labels.join(labels.groupBy("root").agg(F.count(F.lit(1)).alias("component_size")), "root").select("id", "component_size")
    both = pairs.union(pairs.select("b", "a")).where("a <> b").join(ids.select(c("id").alias("a")), "a", "left_semi")
    near = both.groupBy(c("a").alias("id")).agg(F.sort_array(F.collect_set("b")).alias("neighbours"))
    found = ids.join(degree(edges), "id", "left").join(near, "id", "left").join(sizes, "id", "left")
    return found.select("id", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("neighbours", F.array().cast("array<long>")).alias("neighbours"), F.coalesce("component_size", F.lit(0)).alias("component_size"))


def reach(start: DataFrame, steps: DataFrame, rounds: int = 1000) -> DataFrame:
    """(id) reachable from start (id) along steps (a, b), itself included.

    A round joins what the last one found and writes only what is new; every 16 rounds those tables become one.
    """
    found, path = materialize(start.select("id").distinct(), "reach")
    written, seen, fresh = [path], found, found
    for n in range(1, rounds + 1):
        fresh, path = materialize(fresh.join(steps, c("id") == c("a")).select(c("b").alias("id")).distinct().join(seen, "id", "left_anti"), "reach")
        written.append(path)
        if fresh.isEmpty():
            return seen
        seen = seen.union(fresh)
        if n % 16 == 0:
            old = written
            seen, path = materialize(seen, "reach")
            fresh, fresh_path = materialize(fresh, "reach")
            written = [path, fresh_path]
            for p in old:
                release(seen, p)
    raise RuntimeError("the closure did not settle")


def session_links(facts: DataFrame, events: DataFrame, edges: DataFrame, session: str) -> DataFrame:
    """(source_fact_id, target_fact_id) of new edges between all active facts of a session, both ways."""
    own = facts.where("t_expired is null").join(events.where(c("session_id") == session).select(c("id").alias("source_event_id")), "source_event_id", "left_semi").select("id")
    pairs = own.select(c("id").alias("source_fact_id")).join(own.select(c("id").alias("target_fact_id")), c("source_fact_id") != c("target_fact_id"))
    return pairs.join(live(edges).select("source_fact_id", "target_fact_id"), ["source_fact_id", "target_fact_id"], "left_anti")


def link_session(facts: DataFrame, events: DataFrame, edges: DataFrame, session: str, now: Column, relation: str = "co_session") -> DataFrame:
    """edges with the session's links, of weight 0.5 in the root scope; linking again adds none."""
    new = session_links(facts, events, edges, session)
    base = edges.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_base"))  # one row
    given = {"id": c("_base") + F.row_number().over(Window.orderBy("source_fact_id", "target_fact_id")), "relation_type": F.lit(relation), "weight": F.lit(0.5), "t_created": now, "t_expired": F.lit(None), "scope_id": F.lit(1)}
    rows = new.crossJoin(F.broadcast(base)).select("source_fact_id", "target_fact_id", *[v.cast(edges.schema[n].dataType).alias(n) for n, v in given.items()])  # one session's links
    return edges.unionByName(rows.select(*edges.columns))


def lineage_sources(lineage: DataFrame, wisdom: int) -> DataFrame:
    """(source_fact_id) that a fact was made from."""
    return lineage.where(c("wisdom_fact_id") == wisdom).select("source_fact_id")


def lineage_full(lineage: DataFrame, fact: int) -> DataFrame:
    """(id) of a fact and all that it was made from, over any number of steps."""
    start = lineage.sparkSession.createDataFrame([(fact,)], "id long")
    return reach(start, lineage.select(c("wisdom_fact_id").alias("a"), c("source_fact_id").alias("b")))


def lineage_delete(lineage: DataFrame, wisdom: DataFrame) -> DataFrame:
    """lineage without the records of the facts wisdom (id)."""
    return lineage.join(wisdom.select(c("id").alias("wisdom_fact_id")), "wisdom_fact_id", "left_anti").select(*lineage.columns)
