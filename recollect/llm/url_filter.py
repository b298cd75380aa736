"""URL filters: fixed host and path rules, then association rules over URL tokens.

Everything runs as DataFrame operations. Spark's FP-growth mines which combinations of URL tokens go with blocked rows;
rules are pruned by support and confidence and found again through an inverted index: each rule is filed under its
rarest token, so a page meets a rule only if it has that token, and the match is confirmed with the whole token set.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.llm._runtime import salted_join

LEAST_ROWS = 20  # labelled rows that must have a rule's tokens, whatever the support
BLOCKED = "label=block"


def host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://` or for null."""
    raw = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host_col: Column, path_col: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest (verdict, host/path) rule that fits, null if none; the rules are a short list.

    A rule fits its host and its subdomains where the path starts with the rule's path. Of equally long rules the
    smaller text wins.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        h, _, p = text.partition("/")
        fits = ((host_col == h) | host_col.endswith("." + h)) & path_col.startswith("/" + p)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def tokens(host_col: Column, path_col: Column) -> Column:
    """Distinct tokens: each host label, the host's last two labels, the first path part and the other parts' shapes."""
    labels = F.filter(F.split(host_col, r"\."), lambda x: x != "")
    parts = F.filter(F.split(path_col, "/"), lambda x: x != "")
    shape = F.transform(parts, lambda x: F.regexp_replace(x, "[0-9]+", "0"))
    return F.array_distinct(
        F.concat(
            F.transform(labels, lambda x: F.concat(F.lit("h="), x)),
            F.array(F.concat(F.lit("d="), F.substring_index(host_col, ".", -2))),
            F.transform(shape, lambda x: F.concat(F.lit("p="), x)),
        )
    )


def mine(labelled: DataFrame, min_support: float = 0.002, min_confidence: float = 0.5) -> DataFrame:
    """(rule_id, items, confidence, support, key): pruned rules out of labelled (tokens, blocked boolean) rows.

    A rule survives if no shorter rule inside it is as confident; all that survive are kept. No labelled rows, or none
    blocked, give no rules; tokens of fewer than LEAST_ROWS rows make none. All labelled rows are mined.
    """
    marked = F.when(F.col("blocked"), F.array_append(F.col("tokens"), F.lit(BLOCKED))).otherwise(F.col("tokens"))
    rows = labelled.where("blocked is not null and size(tokens) > 0")
    support = max(min_support, LEAST_ROWS / max(1, rows.count()))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, support), minConfidence=min_confidence).fit(rows.select(marked.alias("items")))
    counts = model.freqItemsets
    single = counts.where("size(items) = 1").select(F.col("items")[0].alias("token"), "freq")
    rules = model.associationRules.where(F.array_contains("consequent", BLOCKED)).select(F.array_sort("antecedent").alias("items"), "confidence", "support")
    # A shorter rule inside a rule is met through one of its own tokens, so rules are joined by token and not all with all.
    inner = rules.select(F.explode("items").alias("token"), F.col("items").alias("less"), F.col("confidence").alias("less_confidence"))
    shorter = (F.size("less") < F.size("items")) & (F.size(F.array_except("less", "items")) == 0) & (F.col("less_confidence") >= F.col("confidence"))
    worse = rules.select("items", "confidence", F.explode("items").alias("token")).join(inner, "token").where(shorter).select("items").distinct()
    kept = rules.join(worse, "items", "left_anti")
    rarest = kept.select("items", F.explode("items").alias("token")).join(single, "token").groupBy("items").agg(F.min_by("token", F.struct("freq", "token")).alias("key"))
    return kept.join(rarest, "items").select(F.xxhash64(F.col("items")).alias("rule_id"), "items", "confidence", "support", "key")


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]], min_support: float = 0.002, min_confidence: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, verdict, mined_items, mined_confidence): one row per page row.

    The verdict is that of the longest fixed rule that fits; otherwise block if a mined rule's tokens are all in the
    URL, else allow. Null and host-less URLs have empty host and path, fit no rule and are allowed. labels (page_id,
    blocked) teach the mined rules. Repeated pages keep their rows; no pages give no rows. Other columns are ignored.
    """
    h, p = host(F.col("url")), path(F.col("url"))
    seen = pages.select("page_id", h.alias("host"), p.alias("path")).withColumn("tokens", F.when(F.col("host") != "", tokens(F.col("host"), F.col("path"))).otherwise(F.array().cast("array<string>")))
    taught = seen.join(labels.select(F.col("page_id").alias("_page"), "blocked"), F.col("page_id") == F.col("_page")).select("tokens", "blocked")
    mined = mine(taught, min_support, min_confidence)
    # Pages repeat token sets, so the index is searched once for each distinct set.
    sets = seen.groupBy("tokens").agg(F.count(F.lit(1)).alias("_n"))
    hits = (
        sets.select("tokens", F.explode("tokens").alias("key"))
        .join(mined, "key")
        .where(F.forall("items", lambda x: F.array_contains(F.col("tokens"), x)))
        .groupBy("tokens")
        .agg(F.max_by(F.struct("items", "confidence"), F.struct("confidence", "support", F.col("items").cast("string"))).alias("best"))
    )
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return (
        salted_join(seen, hits, ["tokens"], F.xxhash64("page_id", "path"), sets)
        .select("page_id", "host", "path", rule.alias("rule"), verdict.alias("_fixed"), F.array_join("best.items", " ").alias("mined_items"), F.col("best.confidence").alias("mined_confidence"))
        .select("page_id", "host", "path", "rule", F.coalesce("_fixed", F.when(F.col("mined_confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "mined_items", "mined_confidence")
    )
