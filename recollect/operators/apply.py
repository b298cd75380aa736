"""Applying what was planned: consolidation plans, embedding answers, archive checks. Each gives the tables' next versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.operators import facts as fa

c = F.col


def apply_dedup(facts: DataFrame, edges: DataFrame, plan: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(facts, edges, applied) under a plan (loser, survivor, score) of dedup_plan.

    Pairs whose survivor had expired before are skipped; other losers expire with their edges, unless they had expired
    before, and survivors keep the largest score planned. applied: (loser, survivor, done); if any is not done, summaries must not be replaced.
    """
    alive = facts.where(fa.active()).select(c("id").alias("survivor"), F.lit(True).alias("_alive"))
    applied = plan.join(alive, "survivor", "left").select("loser", "survivor", "score", F.coalesce("_alive", F.lit(False)).alias("done"))
    gone = applied.where("done").select(c("loser").alias("id")).distinct()
    best = applied.groupBy(c("survivor").alias("id")).agg(F.max("score").alias("_score"))
    kept = fa.expire(facts, gone, now).join(best, "id", "left")
    kept = kept.withColumn("importance_score", F.greatest("importance_score", "_score")).drop("_score").select(*facts.columns)
    fresh = gone.join(facts.where(fa.active()).select("id"), "id", "left_semi")
    return kept, fa.expire_edges(edges, fresh, now), applied.select("loser", "survivor", "done")


def watermark(facts: DataFrame, last: Column, now: Column, skipped: bool = False) -> DataFrame:
    """(last_consolidated_at): moves to now unless the pass was skipped or an active fact still has no vector."""
    bare = facts.where(fa.active() & ~fa.has_vector()).limit(1).agg(F.count(F.lit(1)).alias("bare"))
    return bare.select(F.when((c("bare") == 0) & ~F.lit(skipped), now).otherwise(last).alias("last_consolidated_at"))


def settle(queue: DataFrame, answers: DataFrame, now: Column, most_seconds: int = 60) -> tuple[DataFrame, DataFrame]:
    """(queue, vectors) after answers (fact_id, answer, error, embedding), one a fact.

    `embedded` leaves the queue with its vector. `unreachable` and `key_rejected` hold the row as it is. `input_rejected`
    fails it for good. Anything else is tried again after 1, 2, 4 ... seconds, at most most_seconds.
    """
    met = queue.join(answers.select("fact_id", "answer", c("error").alias("_error"), c("embedding").alias("_vector")), "fact_id", "left")
    vectors = met.where("answer = 'embedded'").select("fact_id", c("_vector").alias("embedding"))
    kind = F.coalesce("answer", F.lit("unreachable"))
    fail, again = kind == "input_rejected", ~kind.isin("embedded", "unreachable", "key_rejected", "input_rejected")
    delay = F.least(F.pow(F.lit(2.0), c("attempts").cast("double")), F.lit(float(most_seconds)))  # before attempts + 1
    after = {
        "next_attempt_at": F.when(again, now + F.make_dt_interval(secs=delay.cast("decimal(18, 6)"))).otherwise(c("next_attempt_at")),
        "failed_at": F.when(fail, now).otherwise(c("failed_at")),
        "attempts": F.when(fail | again, c("attempts") + 1).otherwise(c("attempts")),
    }
    if "last_error" in queue.columns:
        after["last_error"] = F.when(fail | again, c("_error")).otherwise(c("last_error"))
    return met.where(kind != "embedded").withColumns(after).select(*queue.columns), vectors


def verify_archives(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(id, pak_path, ok, error) of manifest rows (id, pak_path, sha256), held against files (file, bytes, sha256).

    A path that is absolute or climbs out of the archive's folder fails before its file is looked at. A manifest path
    names the file whose path ends with it.
    """
    parts = F.split("pak_path", r"[/\\]")
    safe = (c("pak_path") != "") & ~F.startswith("pak_path", F.lit("/")) & ~F.regexp_like("pak_path", F.lit(r"^[A-Za-z]:")) & ~F.array_contains(parts, "..")
    named = files.select(F.element_at(F.split("file", "/"), -1).alias("_name"), "file", c("sha256").alias("_found"))
    rows = manifest.select("id", "pak_path", "sha256", safe.alias("_safe"), F.element_at(F.split("pak_path", "/"), -1).alias("_name"))
    met = rows.join(named, (rows["_name"] == named["_name"]) & rows["_safe"] & F.endswith("file", F.concat(F.lit("/"), "pak_path")), "left")
    error = F.when(~c("_safe"), "path leaves the archive").when(c("_found").isNull(), "file not found").when(~c("sha256").eqNullSafe(c("_found")), "hash differs")
    return met.select("id", "pak_path", error.isNull().alias("ok"), error.alias("error"))
