"""The corpus pipeline, stage by stage, against what brute force says about its stage's own input."""

import hashlib

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from recollect.llm._runtime import materialize
from tests.llm.test_llm import brute_repeats, roots

DIR = "/root/testdata/sf0.001"


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b)


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").withColumn("n_chars", F.col("n_chars").cast("long"))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs, _ = materialize(stage(spark, docs, DIR), "test")
        after = {r.doc_id: r for r in docs.collect()}
        assert set(after) <= set(before)
        if name != "source_mixing":
            assert docs.columns == columns and docs.count() == len(after)
        if name == "quality_classifier":
            assert 0.6 * len(before) < len(after) < len(before)
        if name == "simhash_near_dedup":
            ids = sorted(before)
            sets = [shingles(before[i].text) for i in ids]
            near = [(i, j) for i in range(len(ids)) for j in range(i) if similar(sets[i], sets[j])]
            root = roots(len(ids), near)
            assert set(after) == {ids[k] for k in range(len(ids)) if root[k] == k}
        if name == "suffix_array_dedup":
            kept = {d: h for d, *_, h in brute_repeats([(i, r.text) for i, r in before.items()], 50)}
            assert all(hashlib.sha256(after[i].text.encode()).hexdigest() == kept[i] for i in after if "�" not in after[i].text)
            assert all(not (before[i].text or "").strip() or i in after or len(before[i].text.encode()) >= 50 for i in before)
        if name == "benchmark_decontamination":
            items = [r.text.lower().split() for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
            whole = [i for i, r in before.items() if any(" ".join(x) in " ".join(r.text.lower().split()) for x in items)]
            assert not set(whole) & set(after) and len(after) >= 0.9 * len(before)
        if name == "source_mixing":
            words = docs.select(F.sum(F.size(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")))).first()[0]
            total = sum(len(r.text.split()) for r in before.values())
            assert abs(words - total) <= 0.01 * total and docs.columns == [*columns, "repetition"]


def test_run(spark):
    """The whole run is the stages one after the other, and gives the same rows again."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs, _ = materialize(stage(spark, docs, DIR), "test")
    want = sorted((r.doc_id, r.repetition, r.text) for r in docs.collect())
    got = corpus_pipeline.run(spark, DIR)
    assert got.columns == docs.columns and sorted((r.doc_id, r.repetition, r.text) for r in got.collect()) == want and want


ODD = [(1, None, "en", "a", 0), (1, "", "en", "a", 0), (2, "one two", None, None, 7), (2, "three four", "en", "b", 10), (None, "five six seven", "en", "b", 14), (None, "five six seven", "en", "b", 14), (3, "  \n", "en", "b", 4)]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("_doc", "_kept", "_score", "_gone", "key", "row", "size", "g", "c0", "fp", "sig", "repetition")


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_odd_rows(spark, name, stage):
    docs = spark.createDataFrame(ODD, COLUMNS)
    for c in CLASHING:
        docs = docs.withColumn(c, F.lit(f"own {c}"))
    got = stage(spark, docs, DIR)
    kept = [c for c in docs.columns if not (name == "source_mixing" and c == "repetition")]
    assert [c for c in got.columns if c != "repetition" or name != "source_mixing"] == kept
    rows = got.collect()
    assert all(r[c] == f"own {c}" for r in rows for c in CLASHING if c in kept)
    texts = sorted(((r.doc_id or 0, r.text or "") for r in rows))
    every = sorted((d or 0, t or "") for d, t, *_ in ODD)
    if name == "simhash_near_dedup":
        # The word-less rows of documents 1 and 3 are alike; rows without doc_id stay.
        assert texts == [x for x in every if x[0] != 3]
    elif name in ("suffix_array_dedup", "benchmark_decontamination"):
        assert texts == every
    elif name == "source_mixing":
        assert all(t.strip() for _, t in texts) and sum(len(t.split()) for _, t in texts) == 10
    else:
        assert len(texts) in (0, len(every)) or set(texts) <= set(every)
    empty = stage(spark, docs.limit(0), DIR)
    assert empty.count() == 0 and empty.columns == got.columns
