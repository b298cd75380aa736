"""Importance, pruning, near-duplicates, clusters, DBSCAN and promotion. Plans come first; applying them is a join."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.operators.graph import components, degree

c = F.col
WEIGHTS = (0.3, 0.2, 0.3, 0.2)  # recency, frequency, connectivity, prior
HALF_LIFE_DAYS, LEAST = 69.0, 0.1
EXEMPT = ("Semantic", "Procedural")


def decay(age_days: Column, half_life: float = HALF_LIFE_DAYS) -> Column:
    return F.pow(F.lit(2.0), -age_days / half_life)


def importance(facts: DataFrame, edges: DataFrame, now: Column) -> DataFrame:
    """(id, fact_type, is_pinned, score) of active facts; the degree comes by one join on an aggregate."""
    age = F.greatest(F.lit(0.0), F.timestamp_diff("SECOND", c("last_accessed"), now) / 86400.0)
    recency = F.when(c("fact_type").isin(*EXEMPT), 1.0).otherwise(decay(age))
    frequency = F.least(F.lit(1.0), F.log1p("access_count") / F.log(F.lit(101.0)))
    connected = F.least(F.lit(1.0), F.log1p(F.coalesce("degree", F.lit(0))) / F.log(F.lit(51.0)))
    score = WEIGHTS[0] * recency + WEIGHTS[1] * frequency + WEIGHTS[2] * connected + WEIGHTS[3] * c("importance")
    rows = facts.where("t_expired is null").select("id", "fact_type", "last_accessed", "access_count", "importance", "is_pinned")
    return rows.join(degree(edges), "id", "left").select("id", "fact_type", "is_pinned", F.round(score, 6).alias("score"))


def prune(scored: DataFrame, least: float = LEAST) -> DataFrame:
    return scored.where(~c("is_pinned") & ~c("fact_type").isin(*EXEMPT) & (c("score") < least))


def _tables(dim: int, bits: int, tables: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((tables, bits, dim))


def similar_pairs(vectors: DataFrame, threshold: float, on: str | None = None, strict: bool = False, exact: bool = True, bits: int = 8, tables: int = 16, block: int = 2048) -> DataFrame:
    """(a, b, cos) with a < b and cosine at least (strict: above) the threshold among rows (id, embedding[, on]).

    Vectors are of one length; cosines are rounded to 6 places before they are compared. Exact: every pair with equal
    `on` (or every pair) in blocks. Else hyperplane buckets in several tables bring candidates together; that loses a
    pair with chance (1 - p^bits)^tables, p = 1 - angle / pi.
    """
    rows = vectors.where("size(embedding) > 0").select("id", "embedding", (c(on).cast("string") if on else F.lit("")).alias("key"))
    if not exact:

        def buckets(x: pd.Series) -> pd.Series:
            v = np.stack(x.to_numpy())
            signs = np.einsum("tbd,nd->ntb", _tables(v.shape[1], bits, tables, 5), v) > 0
            return pd.Series(list((signs * (1 << np.arange(bits))).sum(axis=2) + (np.arange(tables) << bits)))

        cells = rows.withColumn("cell", F.explode(F.pandas_udf(buckets, "array<long>")("embedding")))
        rows = cells.select("id", "embedding", F.concat_ws("|", "key", "cell").alias("key"))
    n = rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("n"))
    own = rows.join(n, "key").withColumn("own", F.pmod(F.xxhash64("id"), c("n")).cast("int"))
    # Every pair of a key's chunks is a task of its own, so neither all rows nor a hot key are gathered.
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), c("n") - 1))).select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "id", "embedding")

    def near(g: pd.DataFrame) -> pd.DataFrame:
        ids, chunk = g["id"].to_numpy(), g["own"].to_numpy()
        m = np.stack(g["embedding"].to_numpy()).astype(float)
        norm = np.sqrt((m * m).sum(axis=1))
        unit = m / np.where(norm > 0, norm, 1)[:, None]
        same = g["x"].iloc[0] == g["y"].iloc[0]
        left = np.arange(len(ids)) if same else np.flatnonzero(chunk == g["x"].iloc[0])
        right = left if same else np.flatnonzero(chunk != g["x"].iloc[0])
        i, j = np.nonzero(unit[left] @ unit[right].T >= threshold - 1e-6)
        i, j = left[i], right[j]
        keep = ids[i] < ids[j] if same else ids[i] != ids[j]
        i, j = i[keep], j[keep]
        return pd.DataFrame({"a": np.minimum(ids[i], ids[j]), "b": np.maximum(ids[i], ids[j]), "cos": (unit[i] * unit[j]).sum(axis=1)})

    scored = dealt.groupBy("key", "x", "y").applyInPandas(near, "a long, b long, cos double").withColumn("cos", F.round("cos", 6))
    return (scored if exact else scored.dropDuplicates(["a", "b"])).where(c("cos") > threshold if strict else c("cos") >= threshold)


def dedup_plan(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """(loser, survivor, score): the greedy order of each group, replayed in ascending ids.

    Groups are independent, so each is folded by itself. In a pair the lower prior loses, on a tie the larger id; who
    lost leaves the pool, and a fact that loses ends its own round. Survivors inherit the largest score of their chain.
    """
    groups = components(pairs.select("a", "b"))
    info = facts.select("id", "importance", "importance_score")
    full = (
        pairs.join(groups.select(c("id").alias("a"), "root"), "a")
        .join(info.select(c("id").alias("a"), c("importance").alias("pa"), c("importance_score").alias("sa")), "a")
        .join(info.select(c("id").alias("b"), c("importance").alias("pb"), c("importance_score").alias("sb")), "b")
    )

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        prior, score, near = {}, {}, {}
        for r in g.itertuples():
            prior |= {r.a: r.pa, r.b: r.pb}
            score |= {r.a: r.sa, r.b: r.sb}
            near.setdefault(r.a, set()).add(r.b)
            near.setdefault(r.b, set()).add(r.a)
        gone: set[int] = set()
        out = []
        for new in sorted(near):
            for old in sorted(near[new]):
                if new in gone:
                    break
                if old in gone:
                    continue
                lose, win = (new, old) if (prior[new], -new) < (prior[old], -old) else (old, new)
                gone.add(lose)
                score[win] = max(score[win], score[lose])
                out.append((lose, win))
        return pd.DataFrame([(a, b, score[b]) for a, b in out], columns=["loser", "survivor", "score"])

    return full.groupBy("root").applyInPandas(fold, "loser long, survivor long, score double")


def clusters(pairs: DataFrame, least: int = 2) -> DataFrame:
    """(id, cluster): connected components of similar pairs with `least` members or more."""
    found = components(pairs.select("a", "b"))
    sizes = found.groupBy("root").count().where(c("count") >= least).select("root")
    return found.join(sizes, "root", "left_semi").select("id", c("root").alias("cluster"))


def majority_scope(members: DataFrame, facts: DataFrame) -> DataFrame:
    n = members.join(facts.select("id", "scope_id"), "id").groupBy("cluster", "scope_id").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("cluster").agg(F.sum("n").alias("members"), F.max_by("scope_id", F.struct("n", -c("scope_id"))).alias("scope_id"))


def dbscan(pairs: DataFrame, order: DataFrame, least: int = 3) -> DataFrame:
    """(id, cluster) out of neighbour pairs (a, b): cores have least - 1 neighbours; a border point joins the cluster
    whose smallest core position in `order` (id, position) is lowest."""
    both = pairs.select("a", "b").union(pairs.select(c("b").alias("a"), c("a").alias("b")))
    cores = both.groupBy("a").count().where(c("count") >= least - 1).select(c("a").alias("id"))
    inner = pairs.select("a", "b").join(cores.select(c("id").alias("a")), "a", "left_semi").join(cores.select(c("id").alias("b")), "b", "left_semi")
    linked = components(inner)
    of_core = cores.join(linked, "id", "left").select("id", F.coalesce("root", "id").alias("root"))
    first = of_core.join(order, "id").groupBy("root").agg(F.min("position").alias("first"))
    placed = of_core.join(first, "root")
    border = both.join(cores.select(c("id").alias("a")), "a", "left_anti").join(placed.select(c("id").alias("b"), "root", "first"), "b")
    joined = border.groupBy(c("a").alias("id")).agg(F.min_by("root", "first").alias("cluster"))
    return placed.select("id", c("root").alias("cluster")).unionByName(joined)


def nearest_rank(values: DataFrame, by: str, value: str, p: float) -> DataFrame:
    """(by, p): the value at round(p * (n - 1)) of each group's order."""
    w = Window.partitionBy(by)
    n = values.select(by, value, F.row_number().over(w.orderBy(value)).alias("r"), F.count(F.lit(1)).over(w).alias("n"))
    return n.where(c("r") == F.round(F.lit(p) * (c("n") - 1)) + 1).select(by, c(value).alias("p"))


def medoid(members: DataFrame, facts: DataFrame) -> DataFrame:
    return members.join(facts.select("id", "importance_score"), "id").groupBy("cluster").agg(F.max_by("id", F.struct("importance_score", -c("id"))).alias("medoid"), F.max("importance_score").alias("score"))


def outcome_counts(signals: DataFrame) -> DataFrame:
    known = signals.where(c("outcome").isin("Positive", "Negative", "Neutral"))
    return known.groupBy("fact_id").agg(*[F.count_if(c("outcome") == o).alias(o.lower()) for o in ("Positive", "Negative", "Neutral")])


def adjustments(counts: DataFrame) -> DataFrame:
    """(fact_id, action, steps): quarantine at three negatives without a positive, else the net, at most 2 either way."""
    net = F.greatest(F.lit(-2), F.least(F.lit(2), c("positive") - c("negative")))
    q = (c("positive") == 0) & (c("negative") >= 3)
    return counts.select("fact_id", F.when(q, "quarantine").otherwise("adjust").alias("action"), F.when(q, 0).otherwise(net).cast("long").alias("steps"))


def conflict_apply(facts: DataFrame, decisions: DataFrame, now: Column) -> DataFrame:
    """(id, t_expired, t_invalid, edge) of old facts under decisions (id, decision): update and delete expire and
    invalidate, update links `contradicts`, add links `supplements` if the old one is active, noop changes nothing."""
    both = facts.select("id", "t_expired", "t_invalid").join(decisions, "id")
    live = c("t_expired").isNull()
    return both.select(
        "id",
        "decision",
        F.when(live & c("decision").isin("update", "delete"), now).otherwise(c("t_expired")).alias("t_expired"),
        F.when(live & c("decision").isin("update", "delete"), now).otherwise(c("t_invalid")).alias("t_invalid"),
        F.when(c("decision") == "update", "contradicts").when((c("decision") == "add") & live, "supplements").alias("edge"),
    )
