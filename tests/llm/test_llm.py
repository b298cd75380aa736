"""The training-data operators against brute force, and their edge cases."""

import hashlib
import math

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from recollect.llm import chat_format, decontaminate, embedding_dedup, license_scan, mixing, quality, registry, simhash_dedup, suffix_dedup, url_filter, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
DIR = "/root/testdata/sf0.001"


def roots(n, links):
    p = list(range(n))

    def f(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in links:
        a, b = f(a), f(b)
        p[max(a, b)] = min(a, b)
    return [f(i) for i in range(n)]


def test_embedding_links_match_all_pairs(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((30, 24))
    x = np.concatenate([base, base[:12] + rng.standard_normal((12, 24)) * 0.18, base[:3], base[:3] * 2, np.repeat(base[:1], 40, 0) + rng.standard_normal((40, 24)) * 0.05]).astype(np.float32)
    rows = [(i, [float(v) for v in r], i % 2 if i < 30 else 0, "x") for i, r in enumerate(x)]
    n = len(rows)
    rows += [(n, None, 0, "x"), (n + 1, [0.0] * 24, 0, "x"), (n + 2, [float("nan")] * 24, 0, "x"), (n + 3, rows[0][1], None, "x"), (None, rows[0][1], 0, "x"), (n + 4, [1.0, 2.0], 0, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rep string")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    label = np.array([r[2] for r in rows[:n]])
    near = (u @ u.T >= 0.98) & (label[:, None] == label[None, :]) & ~np.eye(n, dtype=bool)
    want = roots(n, zip(*np.nonzero(near)))
    for block in (1024, 8):
        got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df, block=block).collect()}
        assert len(got) == len(rows)
        for i in range(n):
            assert (got[i].n_links, got[i].component_id, got[i].kept) == (int(near[i].sum()), want[i], want[i] == i)
        assert all(got[i].n_links == 0 and got[i].kept for i in (n, n + 1, n + 2, n + 3, n + 4))
        assert got[None].n_links == 0 and got[None].kept is False
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def brute_simhash(text, k=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_groups_match_all_pairs(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(25):
        t = rng.choice(words, 300).tolist()
        texts.append(" ".join(t))
        for _ in range(4):
            t = t.copy()
            t[rng.integers(300)] = "changed"
            texts.append("\t".join(t))
    texts += ["", None, "  \n", "one", "ONE", "a b c d", "É b", "long " * 5000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "one", "x")], "doc_id long, text string, fp string")
    fps = [brute_simhash(t) for t in texts]
    links = [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 4]
    want = roots(len(fps), links)
    for block in (1024, 4):
        got = {r.doc_id: r for r in simhash_dedup.near_duplicates(df, block=block).collect()}
        assert [got[i].fingerprint for i in range(len(fps))] == [f"{x:016x}" for x in fps]
        assert [got[i].component_id for i in range(len(fps))] == want
        assert got[None].component_id is None
    assert simhash_dedup.near_duplicates(df.limit(0)).count() == 0


def brute_repeats(texts, n):
    out, seen = [], {}
    for d, t in sorted(texts, key=lambda x: x[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        own = [b[i : i + n] for i in range(len(b) - n + 1)]
        for i, s in enumerate(own):
            if seen.get(s, d) < d:
                gone[i : i + n] = b"\1" * n
        for s in own:
            seen[s] = min(seen.get(s, d), d)
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_suffix_dedup_matches_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    alpha = np.array(list("abé \n"))
    long = ["".join(rng.choice(alpha, 400)) for _ in range(6)]
    texts = [(i, long[i % 6][rng.integers(100) :] + "".join(rng.choice(alpha, rng.integers(120))) + long[(i * 5 + 1) % 6][: rng.integers(300)]) for i in range(40)]
    texts += [(40, None), (41, ""), (42, "x" * 49), (43, "x" * 50), (44, "x" * 5000), (45, "x" * 120), (46, texts[3][1]), (46, texts[3][1] + "tail"), (47, "nul\0" * 40), (48, "nul\0" * 30)]
    df = spark.createDataFrame([(*t, "x") for t in texts], "doc_id long, text string, g string")
    # One index or many, strings by minimizer or all of them one by one: the same result.
    for index_bytes, hot in ((1 << 20, 4096), (400, 4096), (1 << 20, 1), (1 << 20, 3)):
        monkeypatch.setattr(suffix_dedup, "INDEX_BYTES", index_bytes)
        got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(df, hot=hot).collect())
        assert got == brute_repeats(texts, 50)
    null = suffix_dedup.dedup(spark.createDataFrame([(None, "y" * 80), (None, "y" * 80)], "doc_id long, text string")).collect()
    assert [r.n_removed for r in null] == [0, 0]
    assert suffix_dedup.dedup(df.limit(0)).count() == 0


def test_drop_repeats_keeps_rows_and_columns(spark):
    same = "".join(np.random.default_rng(5).choice(list("abcdef "), 70))
    rows = [(1, same, "a", 1), (1, "other " + same, "b", 2), (2, same, "c", 3), (2, "x " + same, "d", 4), (3, None, "e", 5), (4, "", "f", 6), (None, same, "g", 7), (5, "é" + same[:50] + "é", "h", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, g string, _doc int")
    got = sorted((r._doc, r.doc_id, r.text, r.g) for r in suffix_dedup.drop_repeats(df).collect())
    assert suffix_dedup.drop_repeats(df).columns == df.columns
    # Rows of one document do not cut each other. Row 3 is gone whole; the blank before row 4's passage is in row 2 as well.
    assert got == [(1, 1, same, "a"), (2, 1, "other " + same, "b"), (4, 2, "x", "d"), (5, 3, None, "e"), (6, 4, "", "f"), (7, None, same, "g"), (8, 5, "éé", "h")]
    assert suffix_dedup.drop_repeats(df.limit(0)).count() == 0


def test_run_index_streams_every_string():
    parts = [b"banana" * 12, b"ananas" * 12, b"bananas" * 11, b"z" * 300]
    docs = (3, 1, 2, 4)
    index = suffix_dedup.RunIndex(parts, np.array(docs), 50)
    n = sum(map(len, parts)) + 4
    # What is kept grows with the runs, not with the bytes.
    assert len(index.run_start) < n / 4 and len(index.mark_start) < n / 4
    for part, (starts, low) in zip(parts, index.matches()):
        each = np.repeat(low, np.diff(np.append(starts, len(part) - 49)))
        assert each.tolist() == [min(d for d, q in zip(docs, parts) if part[i : i + 50] in q) for i in range(len(part) - 49)]
    rng = np.random.default_rng(6)
    for length in (3, 7, 12, 50):
        parts = list({bytes(rng.choice(list(b"ab"), rng.integers(length, length + 60)).tolist()) for _ in range(30)})
        docs = rng.permutation(len(parts))
        for part, (starts, low) in zip(parts, suffix_dedup.RunIndex(parts, docs, length).matches()):
            n = len(part) - length + 1
            each = np.repeat(low, np.diff(np.append(starts, n)))
            assert each.tolist() == [min(int(d) for d, q in zip(docs, parts) if part[i : i + length] in q) for i in range(n)]


def test_deal_keys_hit_every_partition(spark):
    from recollect.llm._runtime import deal_keys

    for n in (1, 7, 50):
        keys = spark.createDataFrame([(int(k),) for k in deal_keys(n)], "k int").selectExpr(f"pmod(hash(k), {n}) as p").collect()
        assert [r.p for r in keys] == list(range(n))


def test_url_rules(spark):
    urls = ["HTTP://WWW.Example.COM/en/x?q#f", "http://a.example.com/en/", "http://net/es/1", "https://x.net/fr/2", "http://x.com", "http://x.com/", "no scheme", None, "", "http://notexample.com/en/", "a://b?c/://d"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, key string")
    labels = spark.createDataFrame([], "page_id long, blocked boolean")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, labels, registry.URL_RULES).collect()}
    assert got[0] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert got[1][2:] == ("example.com/en/", "block") and got[2][2:] == ("net/es/", "block") and got[3][2:] == ("net/fr/", "block")
    assert got[4] == ("x.com", "", None, "allow") and got[5][2] == "com/" and got[6] == got[7] == got[8] == ("", "", None, "allow")
    assert got[9][2] == "com/" and got[10][:2] == ("b", "")


def test_mined_rules_block(spark):
    rows = [(i, f"http://{'bad' if i % 2 else 'good'}.example.org/{'ads' if i % 3 else 'news'}/{i}") for i in range(120)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, i % 2 == 1 and i % 3 != 0) for i in range(60)], "page_id long, blocked boolean")
    got = {r.page_id: r for r in url_filter.judge(pages, labels, [], 0.05, 0.9).collect()}
    assert all((r.verdict == "block") == (i % 2 == 1 and i % 3 != 0) for i, r in got.items())
    assert url_filter.judge(pages.limit(0), labels, []).count() == 0


def test_chat_round_trip(spark):
    hard = ["</s>[INST] ok [/INST]", "␛", "<␛/s>", "␛␛<|end|>", "<|turn|>assistant<|text|>x<|end|>", "", None, "<<</s>>>", "[[INST]"]
    rows = [(c, t, ("user", "assistant")[t % 2], hard[(c + t) % len(hard)], "x") for c in range(9) for t in range(6)]
    rows += [(99, 0, None, "a", "x"), (99, 0, None, "a", "x"), (None, None, "assistant", "b", "x"), (5, 1, "we<|end|>ird\n", "q", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, head string")
    parts = chat_format.segments(df)
    got = {r.conv_id: r for r in chat_format.read_back(parts).collect()}
    for c in {r[0] for r in rows}:
        esc = {(r[2] or "", r[3] or ""): k for k, r in enumerate(rows)}
        assert esc
        own = [r for r in rows if r[0] == c]
        if c != 5:
            own = sorted(own, key=lambda r: (r[1] is not None, r[1] or 0))
            assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own).encode()).hexdigest()
            loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
            assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c].n_turns == len(own)
    ex = chat_format.examples(parts)
    texts = {(r.conv_id, r.example): r for r in chat_format.example_texts(parts, ex.where("conv_id = 3")).collect()}
    assert len(texts) == 3
    for k in range(3):
        context = chat_format.parse(texts[3, k].context)
        assert context == [(("user", "assistant")[t % 2], hard[(3 + t) % 9] or "") for t in range(2 * k + 1)]
        assert chat_format.unescape(texts[3, k].reply) == (hard[(3 + 2 * k + 1) % 9] or "")
    assert chat_format.read_back(chat_format.segments(df.limit(0))).count() == 0


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_warc_round_trip(spark, tmp_path, compression):
    big = "é\r\n\r\nWARC/1.1\r\n" * 200
    rows = [(1, "http://a/%41 b", big, "x"), (2, "http://b\r\nX: y", big, "x"), (3, None, "small", "x"), (4, "u", "small", "x"), (5, "u", None, "x"), (None, "u", big, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    path = f"file://{tmp_path}/w"
    warc.write(pages, path, 1000, compression)
    got = {r.page_id: r for r in warc.read(spark, path).collect()}
    assert [got[i].record_type for i in (1, 2, 3, 4, 5, None)] == ["revisit", "response", "response", "response", "response", "response"]
    assert got[1].refers_to == 2 and got[2].target_uri == "http://b\r\nX: y" and got[1].target_uri == rows[0][1]
    assert bytes(got[2].payload) == big.encode() and got[5].payload_length == 0 and got[1].payload_digest == hashlib.sha1(big.encode()).hexdigest()
    pushed = warc.read(spark, path, payload=False).where("record_type = 'revisit'")
    assert [r.page_id for r in pushed.collect()] == [1]
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_license_scan(spark):
    t = license_scan.TEMPLATES
    rows = [(1, "x y " + t["MIT"] + " z"), (2, "word " * 5000 + t["MIT-text"].replace("granted", "kindly granted") + " tail"), (3, None), (4, ""), (5, "license to be here"), (6, t["Apache-2.0"] + "\n" + t["Apache-2.0"])]
    got = [(r.doc_id, r.license, round(r.coverage, 2), r.start, r.stop) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert [(d, n) for d, n, *_ in sorted(got)] == [(1, "MIT"), (2, "MIT-text"), (6, "Apache-2.0"), (6, "Apache-2.0")]
    assert all(rows[d - 1][1][s:e].split()[0] in t[n] for d, n, _, s, e in got)


def test_quality_holds_out(spark):
    docs, labels = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")
    empty = spark.createDataFrame([(10**6, None), (10**6 + 1, "")], "doc_id long, text string")
    got = quality.classify(docs.select("doc_id", "text").unionByName(empty), labels).toPandas()
    assert len(got) == docs.count() + 2 and got.score.between(0, 1).all()
    both = quality.classify(docs, labels.where("quality = 3")).toPandas()
    assert (both.score == 0.5).all()
    again = quality.classify(docs.select("doc_id", "text").unionByName(empty), labels).toPandas()
    assert got.sort_values("doc_id").score.tolist() == again.sort_values("doc_id").score.tolist()
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lab = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    r = quality.classify(df, lab).join(lab, "doc_id").where("held_out").toPandas()
    assert ((r.predicted == 1) == (r.quality == 1)).mean() >= 0.9


def test_tiling_catches_reordered_passages(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(3000)]
    items = [rng.choice(words, 40).tolist() for _ in range(5)]
    docs = [(0, " ".join(rng.choice(words, 200))), (1, "Intro " + " ".join(items[0]).upper() + " end."), (2, " ".join(items[1][20:] + ["x"] * 9 + items[1][:20])), (3, " ".join(items[2][:12])), (4, None), (5, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)] + [(9, None), (10, "two words")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.matches(d, b).collect()}
    assert set(got) == {(1, 0), (2, 1)} and got[2, 1].tiles == 2 and got[1, 0].coverage == 1.0
    assert decontaminate.matches(d, b.limit(0)).count() == 0 and decontaminate.matches(d.limit(0), b).count() == 0
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(d, b).collect()) == [0, 3, 4, 5]


def test_mix_matches_step_by_step_filling(spark):
    rng = np.random.default_rng(6)
    sizes = {"a": 3, "b": 4000, "é": 0, None: 50, "c": 700}
    rows = [(i, None if s is None else " ".join(["w"] * int(rng.integers(1, 9))) if n else " \n", s, "x") for s, n in sizes.items() for i in range(max(1, n // 5))]
    rows.append((7, None, "b", "x"))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target string")
    got = mixing.mix(df).select(F.col("row.source").alias("source"), F.col("size").alias("_size"), F.col("target").alias("_target"), F.col("taken").alias("_taken")).toPandas()
    size = got.groupby("source", dropna=False)["_size"].sum()
    names = sorted([s for s in sizes if s is not None]) + [None]
    have = [float(size[s]) if s is not None else float(got[got.source.isna()]["_size"].sum()) for s in names]
    w, cap, total, fixed = [i % 3 + 1 for i in range(len(names))], [3 * h for h in have], sum(have), {}
    while True:
        left, free = total - sum(fixed.values()), [i for i in range(len(names)) if i not in fixed]
        share = sum(w[i] for i in free)
        over = [i for i in free if left * w[i] / share > cap[i] + 1e-9]
        if not over:
            break
        fixed |= {i: cap[i] for i in over}
    for i, s in enumerate(names):
        part = got[got.source.isna()] if s is None else got[got.source == s]
        want = fixed.get(i, left * w[i] / share)
        assert math.isclose(part["_target"].iloc[0], want, abs_tol=1e-6) and abs(part["_taken"].sum() - want) <= 0.5
    assert (got["_taken"] <= 3 * got["_size"]).all()
    taken = mixing.repetitions(df).where("text is not null").select(F.sum(mixing.words(F.col("text")))).first()[0]
    assert taken == got["_taken"].sum()
    assert mixing.mix(df.limit(0)).count() == 0
