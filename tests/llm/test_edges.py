"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names, operator by operator."""

import base64
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.llm import chat_format, embedding_dedup, license_scan, mixing, quality, simhash_dedup, url_filter, warc


def put(path, data):
    path.mkdir(exist_ok=True)
    (path / "x.warc").write_bytes(data)
    return f"file://{path}"


def warc_record(body, *headers):
    return "\r\n".join(["WARC/1.0", *headers, f"Content-Length: {len(body)}"]).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def test_warc_of_other_programs(spark, tmp_path):
    body = b"hello"
    hexed, sha = hashlib.sha1(body).hexdigest(), base64.b32encode(hashlib.sha1(body).digest()).decode()
    data = warc_record(body, "WARC-Type: response", "WARC-Target-URI: http://a/", f"WARC-Payload-Digest: sha1:{hexed.upper()}")
    data += warc_record(body, "WARC-Type: resource", "WARC-Target-URI: http://b/", " folded", f"WARC-Payload-Digest: sha1:{sha}")
    data += warc_record(b"", "WARC-Type: metadata", "WARC-Payload-Digest: sha256:abc")
    got = {r.record_type: r for r in warc.read(spark, put(tmp_path / "a", data)).collect()}
    assert got["response"].payload_digest == got["resource"].payload_digest == hexed
    assert got["metadata"].payload_digest == "sha256:abc" and got["resource"].target_uri == "http://b/ folded" and bytes(got["response"].payload) == body


@pytest.mark.parametrize("payload", [True, False])
def test_warc_faults_raise(spark, tmp_path, payload):
    whole = warc_record(b"x" * 500, "WARC-Type: response")
    for k, data in enumerate((whole[:-200], whole.replace(b"Content-Length: 500\r\n", b"X: 1\r\n"), b"no archive\r\n\r\n")):
        with pytest.raises(Exception, match="archive ends|no Content-Length|no record starts"):
            warc.read(spark, put(tmp_path / f"w{k}{payload}", data), payload).collect()


def test_warc_ignores_unfinished_writes(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "x" * 2000), (1, "u", "x" * 2000), (0, "u", "x" * 2000), (2, None, None)], "page_id long, url string, html string")
    path = f"file://{tmp_path}/w"
    warc.write(pages, path, compression="gzip")
    (tmp_path / "w" / "left-over.warc").write_bytes(warc_record(b"lost attempt", "WARC-Type: response"))
    got = sorted((r.page_id, r.record_type, r.refers_to) for r in warc.read(spark, path).collect())
    # The rows that repeat the largest page_id are all responses.
    assert got == [(0, "revisit", 1), (1, "response", None), (1, "response", None), (2, "response", None)]
    warc.write(pages.where("page_id = 2"), path)
    assert warc.read(spark, path).count() == 5


def test_license_edges(spark):
    text = license_scan.TEMPLATES["MIT-text"]
    rows = [(1, text, "a", 1), (1, text, "a", 1), (None, text, "b", 2), (2, "", "c", 3), (3, None, "d", 4), (4, "word " * 60_000 + text, "e", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, license string, start int")
    got = sorted((r.doc_id or 0, r.license) for r in license_scan.scan(df).collect())
    assert got == [(0, "MIT-text"), (1, "MIT-text"), (1, "MIT-text"), (4, "MIT-text")]
    assert license_scan.scan(df.limit(0)).count() == 0


def test_license_alignment_matches_full_table():
    rng = np.random.default_rng(3)
    for _ in range(60):
        doc, item = rng.integers(0, 5, rng.integers(1, 16)), rng.integers(0, 5, rng.integers(1, 12))
        best = np.zeros((len(item) + 1, len(doc) + 1), int)
        for i in range(1, len(item) + 1):
            for j in range(1, len(doc) + 1):
                best[i, j] = best[i - 1, j - 1] + 1 if item[i - 1] == doc[j - 1] else max(best[i - 1, j], best[i, j - 1])
        pairs = license_scan.align(doc, item, band=32)
        assert len(pairs) == best[-1, -1] and all(doc[d] == item[i] for d, i in pairs)
        assert pairs == sorted(pairs) and len({d for d, _ in pairs}) == len({i for _, i in pairs}) == len(pairs)


def test_quality_edges(spark):
    good, bad = "A sentence of plain words that reads well. " * 30, "$$ ## @@ 12 99 | | <> " * 60
    rows = [(i, good if i % 2 else bad, "x", 0.5) for i in range(120)] + [(7, good, "again", 0.5), (None, good, "n", 0.5), (200, None, "e", 0.5), (201, "", "e", 0.5), (202, good * 400, "long", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality string, _score double")
    labels = spark.createDataFrame([(i, i % 2, "y") for i in range(120)] + [(5, 1, "twice"), (9999, 1, "unknown"), (6, None, "null")], "doc_id long, quality int, text string")
    got = quality.classify(docs, labels).toPandas()
    assert len(got) == len(rows) and got.score.between(0, 1).all() and not got[got.doc_id.isna()].held_out.any()
    assert got[got.doc_id == 7].score.nunique() == 1 and len(got[got.doc_id == 7]) == 2
    by_id = got.dropna(subset="doc_id").groupby("doc_id").score.first()
    assert all((by_id[i] > 0.5) == bool(i % 2) for i in range(120)) and by_id[202] > 0.5 and by_id[200] == by_id[201]
    assert quality.classify(docs.limit(0), labels).count() == 0
    kept = quality.keep(docs, quality.fit(docs, labels), 0.3)
    assert kept.columns == docs.columns and kept.where("doc_id is null").count() == 1


def test_attention_gradient_is_numeric_gradient():
    rng = np.random.default_rng(4)
    bags = [rng.normal(size=(n, quality.WIDTH)) for n in (1, 3, 5, 2)]
    labels = np.array([0.0, 1.0, 1.0, 0.0])
    p = quality.start(8, 0.0, rng)
    grads = quality.gradient(p, bags, labels)

    def loss(q):
        z = [quality.forward(q, b) for b in bags]
        return float(np.mean([np.log1p(np.exp(-x)) if y else np.log1p(np.exp(x)) for x, y in zip(z, labels)]))

    for k, grad in enumerate(grads):
        for _ in range(6):
            at = tuple(int(rng.integers(s)) for s in p[k].shape)
            up, down = [x.copy() for x in p], [x.copy() for x in p]
            up[k][at] += 1e-5
            down[k][at] -= 1e-5
            assert abs((loss(up) - loss(down)) / 2e-5 - grad[at]) < 1e-6


def test_mix_edges(spark, monkeypatch):
    rows = [(1, "a b c", "s", 1), (1, "a b c", "s", 2), (None, "d e", "s", 3), (None, "d e", "s", 4), (2, "w " * 50_000, None, 5), (3, None, "t", 6), (4, "", "t", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _order int")
    got = mixing.mix(df).select("row.*", F.col("size").alias("words"), F.col("taken").alias("took")).toPandas()
    assert len(got) == len(rows) and (got.took <= 3 * got.words).all() and got["_order"].sum() == 28
    again = mixing.mix(df).select("row.*", F.col("taken").alias("took")).toPandas()
    assert got.sort_values("_order").took.tolist() == again.sort_values("_order").took.tolist()
    assert mixing.repetitions(df).columns == [*df.columns, "repetition"]
    few = sorted(map(tuple, mixing.mix(df).select("row._order", "taken").collect()))
    monkeypatch.setattr(mixing, "FEW", 0)
    assert sorted(map(tuple, mixing.mix(df).select("row._order", "taken").collect())) == few


def test_embedding_repeats(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 0, "x"), (1, v, 0, "x"), (2, v, 0, "x"), (3, v, 1, "x"), (4, [0.0] * 3, 0, "x"), (5, None, 0, "x"), (6, [1.0, None, 2.0], 0, "x"), (7, [float("nan")] * 3, 0, "x"), (8, v, None, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rep string")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df).collect())
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)] + [(k, 0, k, True) for k in range(3, 9)]


def test_url_repeats_and_long_urls(spark):
    long = "http://x.org/" + "a/" * 20_000
    rows = [(1, "http://a.net/es/1", "h", 1), (1, "http://a.net/es/1", "h", 2), (2, long, "h", 3), (None, long, "h", 4), (3, None, "h", 5)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, tokens int")
    labels = spark.createDataFrame([(1, True)], "page_id long, blocked boolean")
    got = url_filter.judge(df, labels, [("block", "net/es/")]).collect()
    assert sorted((r.page_id or 0, r.verdict) for r in got) == [(0, "allow"), (1, "block"), (1, "block"), (2, "allow"), (3, "allow")]
    assert {len(r.path) for r in got if r.host == "x.org"} == {len(long) - len("http://x.org")}


def test_chat_repeats_and_long_texts(spark):
    long = "</s>[INST] " * 30_000
    rows = [(1, 0, "user", "q", "x"), (1, 0, "user", "q", "x"), (1, 1, "assistant", long, "x"), (2, 0, "assistant", "", "x")]
    parts = chat_format.segments(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, body string"))
    got = {r.conv_id: r for r in chat_format.read_back(parts).collect()}
    assert got[1].n_turns == 3 and got[1].loss_chars == len(long) and got[1].loss_sha256 == hashlib.sha256(long.encode()).hexdigest()
    assert got[2].n_examples == 1 and got[2].loss_chars == 0
    assert got[1].formatted_chars == sum(len(r["head"]) + len(r["body"]) + len(chat_format.CLOSE) for r in parts.where("conv_id = 1").collect())


def test_simhash_bands_grow_with_the_rows():
    for n, trees in ((10_000, 5), (10_000_000, 15), (10_000_000_000, 35)):
        masks = simhash_dedup.band_masks(n, 4)
        assert len(masks) == trees
    rng = np.random.default_rng(5)
    for n in (10_000, 10_000_000, 10_000_000_000, 10**12):
        masks = simhash_dedup.band_masks(n, 4)
        for _ in range(200):
            diff = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
            assert any(not diff & m for m in masks)


@pytest.mark.parametrize("n", [10**7, 10**10])
def test_simhash_links_with_more_bands(spark, monkeypatch, n):
    rng = np.random.default_rng(6)
    base = [int(x) for x in rng.integers(0, 2**63, 40)]
    fps = list({b ^ sum(1 << int(k) for k in rng.choice(64, d, replace=False)) for b in base for d in (0, 2, 4, 6)})
    masks = simhash_dedup.band_masks(n, 4)
    monkeypatch.setattr(simhash_dedup, "band_masks", lambda *_: masks)
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)), i) for i, f in enumerate(fps)], "fp long, rep long")
    near = {frozenset((r.a, r.b)) for r in simhash_dedup.links(df).collect()}
    root = {i: i for i in range(len(fps))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in map(tuple, near):
        assert bin(fps[a] ^ fps[b]).count("1") <= 8
        root[find(a)] = find(b)
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                assert find(i) == find(j)


def test_hot_keys_are_dealt_over_salts(spark):
    from recollect.llm._runtime import salted_join

    left = spark.range(5000).select(F.col("id"), F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id")).alias("k"))
    right = left.select("k").distinct().where("k <> 9").withColumn("v", F.col("k") * 10)
    got = salted_join(left, right, ["k"], F.col("id"), left.groupBy("k").agg(F.count("*").alias("_n")))
    assert got.columns == ["id", "k", "v"] or set(got.columns) == {"id", "k", "v"}
    assert got.count() == 5000 and got.where("v is null").count() == 1 and got.where("k = 1 and v = 10").count() == left.where("k = 1").count()


def test_scratch_tables_go(spark, tmp_path):
    from recollect.llm._runtime import materialize, scratch

    def there(path):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)

    with scratch(spark) as outer:
        with scratch(spark) as made:
            _, a = materialize(spark.range(2), "a")
            _, b = materialize(spark.range(2), "b")
            made.keep(b)
        assert not there(a) and there(b) and list(outer) == [b]
        _, c = materialize(spark.range(2), "c")
        outer.keep(c)
    assert not there(b) and there(c)
