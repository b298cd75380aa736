"""Mined URL rules: every blocked host keeps its rule, and all labelled rows are read."""

from pyspark.sql import functions as F

from recollect.llm import url_filter


def test_every_blocked_host_has_a_rule(spark):
    # 60 blocked hosts of 7 tokens give 127 sets each, thousands of rules before pruning.
    rows = [(i, f"http://a{i % 120}.b{i % 120}.c{i % 120}.com/p{chr(97 + i % 5)}/q{chr(97 + i % 3)}") for i in range(2640)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = pages.select("page_id", (F.col("page_id") % 120 < 60).alias("blocked"))
    got = {r.page_id: r.verdict for r in url_filter.judge(pages, labels, [], 0.002, 0.9).collect()}
    assert all((got[i] == "block") == (i % 120 < 60) for i, _ in rows)


def test_all_labelled_rows_are_mined(spark):
    # One host of more rows than the former sample held; the other hosts are rarer but blocked.
    hot = spark.range(230_000).select(F.array(F.lit("h=hot"), F.lit("d=hot.com")).alias("tokens"), (F.col("id") % 10 == 0).alias("blocked"))
    rare = spark.range(3_000).select(F.array(F.concat(F.lit("h=r"), (F.col("id") % 3).cast("string"))).alias("tokens"), F.lit(True).alias("blocked"))
    rules = {tuple(r["items"]): r for r in url_filter.mine(hot.unionByName(rare), 0.002, 0.05).collect()}
    assert all(rules[(f"h=r{k}",)].confidence == 1.0 for k in range(3))
    assert abs(rules[("h=hot",)].confidence - 0.1) < 1e-9 and abs(rules[("h=hot",)].support - 23_000 / 233_000) < 1e-9
