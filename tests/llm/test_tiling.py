"""Greedy tiling and the leak search against brute force, and its defined results on odd rows."""

import numpy as np

from recollect.llm import decontaminate


def brute_tiles(doc, item, seed):
    free_d, free_i, out = [x >= 0 for x in doc], [True] * len(item), []
    while True:
        best = None
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and free_d[d + n] and free_i[i + n] and doc[d + n] == item[i + n]:
                    n += 1
                if n >= seed and (best is None or n > best[2]):
                    best = (d, i, n)
        if best is None:
            return out
        for k in range(best[2]):
            free_d[best[0] + k] = free_i[best[1] + k] = False
        out.append(best)


def test_tiles_match_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(300):
        doc, item, seed = rng.integers(-1, 4, rng.integers(0, 50)), rng.integers(0, 4, rng.integers(1, 30)), int(rng.integers(1, 6))
        assert decontaminate.tile(doc, item, seed) == brute_tiles(doc.tolist(), item.tolist(), seed)


def test_leaks_match_tiling_of_every_pair(spark):
    # Few words, so that phrases repeat in items and documents: no bound may skip a pair that tiles cover.
    rng = np.random.default_rng(2)
    words = "a b c d".split()
    phrase = "p q r s t".split()
    items, docs = [], []
    for k in range(12):
        fill = lambda n: [f"u{k}{i}{rng.integers(99)}" for i in range(n)]  # noqa: E731, B023
        items.append(sum([phrase + fill(int(rng.integers(0, 6))) for _ in range(int(rng.integers(1, 9)))], []) + rng.choice(words, 12).tolist())
    for k in range(30):
        docs.append(sum([phrase + [f"x{k}{i}"] for i in range(int(rng.integers(0, 9)))], []) + rng.choice(words, 60).tolist())
    vocabulary = {w: i for i, w in enumerate({w for x in items + docs for w in x})}
    want = set()
    for d, doc in enumerate(docs):
        for i, item in enumerate(items):
            tiles = brute_tiles([vocabulary[w] for w in doc], [vocabulary[w] for w in item], 5)
            if sum(t[2] for t in tiles) >= 0.5 * len(item):
                want.add((d, i, len(tiles)))
    df = spark.createDataFrame([(d, " ".join(x)) for d, x in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.tiles) for r in decontaminate.matches(df, bench).collect()}
    assert got == want and len(want) > 3


def test_repeats_nulls_long_texts_and_names(spark):
    item = " ".join(f"w{i}" for i in range(30))
    long = "filler words of no use " * 40_000 + item
    rows = [(1, item, "a", 1), (1, "clean", "b", 2), (1, item, "c", 3), (None, item, "d", 4), (2, None, "e", 5), (3, "", "f", 6), (4, long, "g", 7), (5, item.upper() + "!", "h", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, item_id string, coverage int")
    bench = spark.createDataFrame([(9, item, 1.0), (9, item, 2.0)], "item_id long, text string, coverage double")
    got = sorted((r.doc_id or 0, r.item_id) for r in decontaminate.matches(df, bench).collect())
    assert got == [(d, 9) for d in (0, 0, 1, 1, 1, 1, 4, 4, 5, 5)]
    kept = decontaminate.drop_contaminated(df, bench)
    # A clean row stays though another row of its doc_id goes.
    assert kept.columns == df.columns and sorted(r.coverage for r in kept.collect()) == [2, 5, 6]
    assert decontaminate.drop_contaminated(df, bench.limit(0)).count() == 8 and decontaminate.drop_contaminated(df.limit(0), bench).count() == 0


def test_slices_of_the_benchmark(spark, monkeypatch):
    items = [" ".join(f"w{k}_{i}" for i in range(20)) for k in range(8)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(items)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(items)], "item_id long, text string")
    monkeypatch.setattr(decontaminate, "SLICE_WORDS", 60)
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.matches(df, bench).collect()) == [(k, k) for k in range(8)]
    assert decontaminate.drop_contaminated(df, bench).count() == 0
