"""Mixing sources to target weights by capped water-filling.

The mix has as many words as the corpus. Sources share them by weight, but none may exceed `max_epochs` times its own
size; what is above is shared again among the others by weight until none is above. The levels follow in closed form:
sources are capped in the order of cap / weight, so one sorted pass over the (few) sources finds the first one whose
share fits. Documents are then taken whole `floor(target / size)` times, and once more in a seeded order until the
remaining words are used up; the document at the cut gives its first words only.

The seeded order of a source is never sorted as a whole: documents are added up in BINS ranges of their hash before
any shuffle, and only the documents of the range that holds the cut are dealt and put in order. All others are decided
where they are read, against one row for each source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.llm._runtime import materialize, release, salted_join

BINS = 4096
FEW = 10_000  # sources whose plan is broadcast; more are joined, hot ones salted
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _order(seed: int, doc_id: Column, text: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.concat(F.lit("null|"), F.md5(text)), F.lit("null"))))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """(source, source_size, target) of sizes (source, source_size): one row per source, in one task as sources are few.

    A source without words has target 0. Weights repeat over the sources in code point order, null last.
    """
    named = Window.orderBy(F.col("source").isNull(), F.col("source"))
    by_level = Window.orderBy("level", "rank")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = (
        sizes.withColumn("rank", F.row_number().over(named))
        .withColumn("weight", w)
        .withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
        .withColumn("level", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(Window.partitionBy()))
        .withColumn("capped_before", F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("share", (F.col("total") - F.col("capped_before")) / F.col("weight_left"))
        # The first source in this order whose cap holds its share sets the level; from there on the shares only fall.
        .withColumn("fill", F.max(F.when(F.col("share") <= F.col("level"), F.col("share"))).over(Window.partitionBy()))
    )
    return ranked.select("source", "source_size", F.least("cap", F.coalesce(F.col("fill") * F.col("weight"), F.col("cap"))).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: int = 8) -> DataFrame:
    """(row, size, source_size, target, whole, extra, taken): the row of docs, its words, its source's words and target,
    whole repetitions, words of one more, and the words taken in all.

    Null texts have size 0 and are taken 0 times in words; null sources are one source; repeated rows are taken each by
    itself, in an order fixed by doc_id, size and text. A source without words yields nothing. An empty table gives an
    empty result. docs may have columns of any name, as they stay inside `row`.
    """
    text, source = F.col("row.text").cast("string"), F.col("row.source").cast("string")
    order = _order(seed, F.col("row.doc_id"), text)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).select(
        "row",
        F.coalesce(F.concat(F.lit("="), source), F.lit("null")).alias("key"),
        F.floor(F.conv(F.substring(order, 1, 8), 16, 10).cast("long") * BINS / 2**32).cast("int").alias("bin"),
    )
    bins = rows.groupBy(source.alias("source"), "key", "bin").agg(F.sum(words(text)).alias("bin_size"), F.count(F.lit(1)).alias("n"))
    bins, path = materialize(bins, "mix-bins")
    plan = (
        targets(bins.groupBy("source").agg(F.sum("bin_size").alias("source_size")), weights, max_epochs)
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
        .withColumn("words_left", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
        .withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")))
        .drop("source")
    )
    up_to = Window.partitionBy("key").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    # The cut is in the first range that is not taken whole.
    met = bins.select("key", "bin", "bin_size", "n", F.coalesce(F.sum("bin_size").over(up_to), F.lit(0)).alias("before")).join(plan, "key")
    cut = F.min(F.when(F.col("before") + F.col("bin_size") > F.col("words_left"), F.struct("bin", (F.col("words_left") - F.col("before")).alias("left"))))
    plan, plan_path = materialize(met.groupBy("key", "source_size", "target", "whole").agg(cut.alias("cut"), F.sum("n").alias("_n")).select("key", "source_size", "target", "whole", "_n", F.coalesce("cut.bin", F.lit(BINS)).alias("at"), F.coalesce("cut.left", F.lit(0)).alias("left")), "mix-plan")
    if plan.count() <= FEW:
        dealt = rows.join(F.broadcast(plan.drop("_n")), "key")
    else:
        dealt = salted_join(rows, plan.drop("_n"), ["key"], F.col("bin"), plan.select("key", "_n"))
    release(docs.sparkSession, path)
    outside = dealt.where(F.col("bin") != F.col("at")).withColumn("size", words(text)).withColumn("extra", F.when(F.col("bin") < F.col("at"), F.col("size")).otherwise(F.lit(0).cast("long")))
    inside = dealt.where(F.col("bin") == F.col("at")).withColumns({"size": words(text), "order": order, "tie": F.xxhash64(text)})
    here = Window.partitionBy("key").orderBy("order", "size", "tie", F.monotonically_increasing_id()).rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("left", F.col("left") - F.coalesce(F.sum("size").over(here), F.lit(0))).withColumn("extra", F.greatest(F.lit(0), F.least("size", "left")))
    names = ["row", "size", "source_size", "target", "whole", "extra"]
    return outside.select(*names).unionByName(inside.select(*names)).withColumn("taken", (F.col("whole") * F.col("size") + F.col("extra")).cast("long"))


def repetitions(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: int = 8) -> DataFrame:
    """The mix itself: docs' columns and `repetition`, a row per repetition taken; a cut one has its first words only.

    An input column `repetition` gives way to the new one; all others stay, whatever their names.
    """
    partial = (F.col("extra") > 0) & (F.col("extra") < F.col("size"))
    last = F.col("whole") + F.when(F.col("extra") > 0, 1).otherwise(0)
    out = mix(docs, weights, max_epochs, seed).where(last > 0).withColumn("at", F.explode(F.sequence(F.lit(1), last)))
    head = F.concat_ws(" ", F.slice(F.regexp_extract_all("row.text", F.lit(f"({WORD})"), F.lit(1)), F.lit(1), F.col("extra").cast("int")))
    text = F.when(partial & (F.col("at") > F.col("whole")), head).otherwise(F.col("row.text"))
    return out.select(*[text.alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns if c != "repetition"], F.col("at").alias("repetition"))
