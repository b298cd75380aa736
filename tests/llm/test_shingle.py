"""The pipeline's near-duplicate stage against all pairs of word-shingle sets."""

import random

import corpus_pipeline
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from recollect.llm import shingle_dedup
from tests.llm.test_llm import roots

DIR = "/root/testdata/sf0.001"


def brute_groups(rows, k=5):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    n = range(len(rows))
    alike = [(i, j) for i in n for j in range(i) if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    return dict(zip([r[0] for r in rows], [rows[x][0] for x in roots(len(rows), alike)]))


def test_stage_matches_all_pairs(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    want = brute_groups(sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()))
    assert want[177] == 1  # similarity 0.83, fingerprints 9 bits apart
    kept = corpus_pipeline.simhash_near_dedup(spark, docs, DIR)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {i for i, low in want.items() if i == low}


def test_groups_of_copies(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(60)] for _ in range(6)]
    texts = ["", None, " \n", "one", "One ", "a b c d e"]
    for b in base:
        for _ in range(12):
            t = list(b)
            for _ in range(rng.randrange(4)):
                t[rng.randrange(60)] = rng.choice(words)
            texts.append(" ".join(t))
    rows = list(enumerate(texts))
    df = spark.createDataFrame([*rows, (None, "one")], "doc_id long, text string")
    want = brute_groups(rows)
    for block, big in ((1024, 64), (4, 3)):
        monkeypatch.setattr(shingle_dedup, "BIG", big)
        got = {r.doc_id: r.component_id for r in shingle_dedup.near_duplicates(df, block=block).collect()}
        assert got == want
    assert shingle_dedup.drop_near_duplicates(df).where(F.col("doc_id").isNull()).count() == 1
    assert shingle_dedup.near_duplicates(df.limit(0)).count() == 0


def test_large_groups_give_a_pair_once(spark):
    # Copies of one text with edits of their own: many share most of their prefixes, and some are alike enough.
    rng = random.Random(7)
    base = [f"w{rng.randrange(900)}" for _ in range(120)]
    texts = []
    for _ in range(150):
        t = list(base)
        for at in rng.sample(range(120), rng.randrange(5)):
            t[at] = f"new{rng.randrange(10**6)}"
        texts.append(" ".join(t))
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    asked = []
    whole = shingle_dedup.candidates

    def counted(*args):
        out = whole(*args)
        asked.append(out.count())
        return out

    shingle_dedup.candidates = counted
    try:
        got = {r.doc_id: r.component_id for r in shingle_dedup.near_duplicates(df).collect()}
    finally:
        shingle_dedup.candidates = whole
    assert got == brute_groups(rows)
    assert asked[0] <= 150 * 149 // 2


def test_overlaps_count_common_values(monkeypatch):
    rng = np.random.default_rng(3)
    lists = [rng.choice(40, rng.integers(0, 30), replace=False).tolist() for _ in range(25)]
    left, right = np.arange(10), np.arange(7, 25)
    want = [[len({*lists[i]} & {*lists[j]}) for j in right] for i in left]
    for product in (0, 30, 10**6):
        monkeypatch.setattr(shingle_dedup, "PRODUCT", product)
        assert shingle_dedup.overlaps(pa.array(lists, pa.list_(pa.int64())), left, right).tolist() == want


def test_large_groups_give_links_not_pairs(spark, monkeypatch):
    # 200 copies whose own edits leave most pairs at about 0.65: pairs that no prefix bound can leave out.
    rng = random.Random(11)
    base = [f"w{rng.randrange(900)}" for _ in range(160)]
    texts = []
    for k in range(200):
        t = list(base)
        for at in rng.sample(range(160), 4 if k % 4 else 1):
            t[at] = f"own{rng.randrange(10**6)}"
        texts.append(" ".join(t))
    rows = list(enumerate(texts))
    made, whole = [], shingle_dedup.map_arrow

    def counted(df, f, schema):
        out = whole(df, f, schema)
        if schema.startswith("a long, b long"):
            made.append(out.count())
        return out

    monkeypatch.setattr(shingle_dedup, "map_arrow", counted)
    for block in (1024, 64):
        got = {r.doc_id: r.component_id for r in shingle_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect()}
        assert got == brute_groups(rows)
    assert len(set(got.values())) > 100
    assert max(made) < 10000  # of 19900 pairs; groups of up to 104 texts still give theirs
