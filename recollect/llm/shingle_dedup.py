"""Near-duplicate texts by the Jaccard similarity of their word shingles, without misses.

Two sets of similarity t share a shingle among the first n - ceil(t n) + 1 of each, whatever the order of shingles
(prefix filter). The order here puts shingles that a sample of the documents repeats last, so prefixes are of rare ones;
the sample decides the speed only. Pairs that share prefix shingles are held against bounds on their overlap by lengths,
positions and the number of shared prefix shingles, and what is left is verified on whole sets. Before that, the links of
the SimHash trees are verified, and each prefix group against one of its members. Groups of more texts than a block that
hold several components then are held against further members in turn, as long as that links half of what it asks: a
round is one pair a text and shingle, and pairs of one component are never asked. Prefix groups whose pairs would take more
than their texts do not give them out: blocks hold the whole sets, decide every pair in place and give only the links that join components.
So what is sent grows with the texts times the blocks of their group; the comparisons inside still grow with the square of
a group whose texts share much and are not similar.

SimHash alone cannot find these pairs: at similarity 0.8 fingerprints differ in about 10 of 64 bits and often in 15,
which no tree keeps apart from chance at scale. So its trees give the first links and the prefix filter the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.llm import simhash_dedup
from recollect.llm._runtime import components, groups, local_roots, map_arrow, materialize, pair_blocks, release, salted_join, scratch

STAR_KEYS = 8  # prefix shingles by which a text is held against a centre in a round
BIG = 64  # texts with one prefix shingle, beyond which blocks may decide pairs in place
ROUNDS = 4  # of further centres, at most
SHINGLES = 256  # a text, on average, that a chunk of a block holds; fewer texts if they have more
PRODUCT = 4096  # pairs that have a shingle, beyond which a block counts it by a matrix product
SAMPLE_SHARE = 0.02  # of the documents, for the order of shingles
SAMPLE_ROWS = 4000  # at least
COMMON = 1_000_000  # repeated shingles of the sample that the order knows, at most


def shingle_set(text: bytes, shingle: int, seed: int = 42) -> np.ndarray:
    """Distinct 64-bit shingle hashes of one UTF-8 text, sorted; words as in simhash_dedup, a shorter text is one shingle."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    grams = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    return np.unique(np.array([digest(g, seed) for g in grams], np.uint64))


def signature(found: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes())).view(np.int64))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _common(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles sorted, their sampled frequency) of those that three sampled documents have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(1).cast(pa.large_binary()):
                yield pa.record_batch([pa.array(shingle_set(t.as_py() or b"", shingle).view(np.int64))], ["s"])

    n = max(1, docs.count())
    part = int(1e6 * min(1.0, max(SAMPLE_SHARE, SAMPLE_ROWS / n)))
    sample = _texts(docs).where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < part)
    top = map_arrow(sample, run, "s long").groupBy("s").agg(F.count(F.lit(1)).alias("f")).where("f >= 3").orderBy(F.desc("f"), "s").limit(COMMON).toArrow()
    s, f = top.column("s").to_numpy().view(np.uint64), top.column("f").to_numpy()
    by = np.argsort(s)
    return s[by], f[by]


def prefixes(docs: DataFrame, threshold: float, shingle: int) -> DataFrame:
    """(doc_id, sig, n, keys): signature and size of each document's set, and its prefix in the common order."""
    known = docs.sparkSession.sparkContext.broadcast(_common(docs, shingle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, freq = known.value
        for batch in batches:
            sig, size, keys = [], [], []
            for t in batch.column(1).cast(pa.large_binary()):
                found = shingle_set(t.as_py() or b"", shingle)
                n = len(found)
                rank = np.zeros(n, np.int64)
                if len(common) and n:
                    at = np.minimum(np.searchsorted(common, found), len(common) - 1)
                    rank = np.where(common[at] == found, freq[at], 0)
                length = n - int(np.ceil(threshold * n - 1e-9)) + 1 if n else 0
                sig.append(signature(found))
                size.append(n)
                keys.append(found[np.lexsort((found, rank))][:length].view(np.int64))
            ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            flat = np.concatenate([*keys, np.zeros(0, np.int64)])
            yield pa.record_batch([batch.column(0), pa.array(sig, pa.int64()), pa.array(size, pa.int32()), pa.ListArray.from_arrays(ends, flat)], ["doc_id", "sig", "n", "keys"])

    return map_arrow(_texts(docs), run, "doc_id long, sig long, n int, keys array<long>")


def _sets(sigs: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int, texts: int) -> tuple[DataFrame, str]:
    """(sig, s): the whole shingle sets of the signatures, sorted, and the written table's path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py() or b"", shingle) for t in batch.column(1).cast(pa.large_binary())]
            yield pa.record_batch([pa.array([signature(x) for x in sets], pa.int64()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], ["sig", "s"])

    ids = nodes.join(sigs, "sig", "left_semi").select("doc_id").distinct()
    return materialize(map_arrow(_texts(docs).join(ids, "doc_id", "left_semi"), run, "sig long, s array<long>").dropDuplicates(["sig"]), "shingle-sets", texts)


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, threshold: float, shingle: int, texts: int) -> DataFrame:
    """The pairs (a, b) of signatures whose whole sets have the similarity."""
    spark = docs.sparkSession
    pairs, pairs_at = materialize(pairs, "shingle-pairs", texts)
    sets, sets_at = _sets(pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct(), nodes, docs, shingle, texts)
    both = pairs.join(sets.select(F.col("sig").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("sig").alias("b"), F.col("s").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    links, _ = materialize(both.where(shared / (F.size("sa") + F.size("sb") - shared) >= threshold).select("a", "b"), "shingle-links", texts)
    for path in (pairs_at, sets_at):
        release(spark, path)
    return links


def _sides(g: pa.Table) -> tuple[bool, np.ndarray, np.ndarray]:
    """Whether a block is of one chunk, and its rows to compare with each other."""
    own, first = g.column("blk_own").to_numpy(), int(g.column("blk_a")[0].as_py())
    if first == int(g.column("blk_b")[0].as_py()):
        return True, np.arange(len(own)), np.arange(len(own))
    return False, np.flatnonzero(own == first), np.flatnonzero(own != first)


def _blocks(batches: Iterator[pa.RecordBatch], share: float) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """(block, i, j): rows of different roots that their lengths and the place of the block's shingle leave."""
    for g in groups(batches, ["key", "blk_a", "blk_b"]):
        sig, n, pos, root = (g.column(x).to_numpy() for x in ("sig", "n", "pos", "root"))
        same, left, right = _sides(g)
        for at in range(0, len(left), 256):
            i, j = left[at : at + 256][:, None], right[None, :]
            most = np.minimum(pos[i], pos[j]) + np.minimum(n[i] - pos[i], n[j] - pos[j])
            i, j = np.nonzero((root[i] != root[j]) & (most >= share * (n[i] + n[j]) - 1e-9) & ((sig[i] < sig[j]) if same else True))
            yield g, left[at : at + 256][i], right[j]


def overlaps(sets: pa.ListArray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Number of common values of each set of left with each of right, as a table; values of a set are distinct.

    Values that many sets have are counted by a product of 0-1 matrices, the others by listing the pairs that have them.
    """
    values = sets.flatten().to_numpy()
    _, value = np.unique(values, return_inverse=True)
    row = np.repeat(np.arange(len(sets)), pa.compute.list_value_length(sets).to_numpy())
    at = np.full(len(sets), -1)
    sides = []
    for side in (left, right):
        at[:] = -1
        at[side] = np.arange(len(side))
        mine = at[row] >= 0
        by = np.argsort(value[mine], kind="stable")
        sides.append((at[row[mine]][by], value[mine][by]))
    (i, u), (j, v) = sides
    n = int(value.max(initial=-1)) + 1
    in_left, in_right = np.bincount(u, minlength=n), np.bincount(v, minlength=n)
    many = in_left * in_right > PRODUCT
    out = np.zeros((len(left), len(right)), np.float32)
    dense = np.flatnonzero(many)
    place = np.full(n, -1)
    for s in range(0, len(dense), 1024):
        place[:] = -1
        part = dense[s : s + 1024]
        place[part] = np.arange(len(part))
        x, y = np.zeros((len(left), len(part)), np.float32), np.zeros((len(right), len(part)), np.float32)
        here, there = place[u] >= 0, place[v] >= 0
        x[i[here], place[u[here]]] = 1
        y[j[there], place[v[there]]] = 1
        out += x @ y.T
    rest = np.flatnonzero(~many[u] & (in_right[u] > 0))
    first, times = (np.cumsum(in_right) - in_right)[u[rest]], in_right[u[rest]]
    done = np.cumsum(times)
    s = 0
    while s < len(rest):
        e = max(s + 1, int(np.searchsorted(done, (done[s - 1] if s else 0) + (1 << 20), side="right")))
        k = times[s:e]
        other = j[np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(first[s:e], k)]
        out += np.bincount(np.repeat(i[rest[s:e]], k) * len(right) + other, minlength=out.size).reshape(out.shape)
        s = e
    return out


_PAIR = "a long, b long, na int, nb int"


def _pairs(g: pa.Table, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    sig, n = g.column("sig").to_numpy(), g.column("n").to_numpy()
    swap = sig[i] > sig[j]
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    return pa.record_batch([pa.array(x) for x in (sig[i], sig[j], n[i], n[j])], ["a", "b", "na", "nb"])


def _asked(rows: DataFrame, large: bool) -> DataFrame:
    """The rows (key, pos, sig, n, root) of prefix groups with several roots, the large or the small ones.

    A group is large if it has over BIG texts and its pairs, at 24 bytes, take more than its whole sets, at 8 a shingle.
    """
    size = rows.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.avg("n").alias("_mean"), F.min("root").alias("_lo"), F.max("root").alias("_hi"))
    is_large = (F.col("_n") > BIG) & (1.5 * F.col("_n") > F.col("_mean"))
    return rows.join(size.where((F.col("_lo") < F.col("_hi")) & (is_large == F.lit(large))).select("key"), "key", "left_semi")


def candidates(rows: DataFrame, threshold: float, block: int) -> DataFrame:
    """(a, b): pairs of different roots in small prefix groups that the bounds leave.

    Each shared shingle gives a row. The number of them bounds pairs that share small groups only; others are decided in
    a large one.
    """
    share = threshold / (1 + threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, i, j in _blocks(batches, share):
            if len(i):
                yield _pairs(g, i, j)

    pairs = map_arrow(pair_blocks(_asked(rows, False), ["key"], F.col("sig"), block), run, _PAIR)
    rest = lambda n: F.ceil(F.lit(threshold) * F.col(n) - 1e-9) - 1  # noqa: E731  # shingles after the prefix
    counted = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    return counted.where(F.col("c") + F.greatest(rest("na"), rest("nb")) >= F.lit(share) * (F.col("na") + F.col("nb")) - 1e-9).select("a", "b")


def decided(rows: DataFrame, nodes: DataFrame, docs: DataFrame, threshold: float, shingle: int, block: int, n_texts: int) -> DataFrame:
    """(a, b): links between roots that connect what all similar pairs in the large prefix groups connect.

    Blocks carry the whole sets and decide their pairs in place, so pairs are never given out: a block gives fewer links
    than it has roots. Of groups of the same texts one is asked.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, ["key", "blk_a", "blk_b"]):
            roots, root = np.unique(g.column("root").to_numpy(), return_inverse=True)
            n = g.column("n").to_numpy().astype(np.int64)
            _, left, right = _sides(g)
            if len(roots) < 2 or not len(left) or not len(right):
                continue
            shared = overlaps(g.column("s").combine_chunks(), left, right).astype(np.float64)
            i, j = np.nonzero(shared / (n[left][:, None] + n[right][None, :] - shared) >= threshold)
            a, b = root[left[i]], root[right[j]]
            a, b = a[a != b], b[a != b]
            to = local_roots(len(roots), a, b)
            inner = np.flatnonzero(to != np.arange(len(roots)))
            if len(inner):
                yield pa.record_batch([pa.array(roots[inner]), pa.array(roots[to[inner]])], ["a", "b"])

    large, large_at = materialize(_asked(rows, True), "shingle-large", n_texts)
    who = F.xxhash64("sig")
    texts = large.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.bit_xor(who).alias("_x"), F.bit_xor(F.xxhash64(who)).alias("_y"))
    one = texts.groupBy("_n", "_x", "_y").agg(F.min("key").alias("key")).select("key")
    sets, sets_at = _sets(large.select("sig").distinct(), nodes, docs, shingle, n_texts)
    dealt = pair_blocks(large.join(one, "key", "left_semi").select("key", "sig", "n", "root"), ["key"], F.col("sig"), block, sets, ["sig"], F.col("n") / SHINGLES)
    links, _ = materialize(map_arrow(dealt, run, "a long, b long").distinct(), "shingle-links", n_texts)
    for path in (large_at, sets_at):
        release(docs.sparkSession, path)
    return links


def _rooted(rows: DataFrame, links: DataFrame, texts: int) -> tuple[DataFrame, str]:
    """rows with the root of their component under the links, and the written table's path."""
    roots = components(links, "shingle-components").withColumnRenamed("node", "sig")
    return materialize(rows.join(roots, "sig", "left").withColumn("root", F.coalesce("root", "sig")), "shingle-rooted", texts)


def centred(rows: DataFrame, threshold: float, n: int, least: int) -> DataFrame:
    """(a, b): texts of prefix groups of over `least` texts and several roots, each with the group's n-th centre if that has another root."""
    size = rows.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.min("root").alias("_lo"), F.max("root").alias("_hi"))
    own = rows.join(size.where((F.col("_n") > least) & (F.col("_lo") < F.col("_hi"))).select("key"), "key", "left_semi")
    turn = F.xxhash64(F.lit(n), "key", "sig")
    centres = own.groupBy("key").agg(F.min(F.struct(turn, F.col("sig"), F.col("n"), F.col("root"))).alias("m")).select("key", F.col("m.sig").alias("c"), F.col("m.n").alias("cn"), F.col("m.root").alias("cr"))
    few = own.withColumn("_r", F.row_number().over(Window.partitionBy("sig").orderBy(turn))).where(F.col("_r") <= STAR_KEYS)
    close = F.least("n", "cn") >= F.lit(threshold) * F.greatest("n", "cn") - 1e-9
    return few.join(centres, "key").where((F.col("root") != F.col("cr")) & close).select(F.least("sig", "c").alias("a"), F.greatest("sig", "c").alias("b")).distinct()


def near_duplicates(docs: DataFrame, threshold: float = 0.8, shingle: int = 5, radius: int = 4, block: int = 1024) -> DataFrame:
    """(doc_id, component_id): the groups that pairs of at least the similarity connect; rows without a doc_id are left out.

    Null, empty and word-less texts are alike. component_id is the smallest doc_id of the group. A repeated doc_id has a
    row for each of its rows, which may be of several groups. Only `doc_id` and `text` are read; no rows give no rows.
    """
    with scratch(docs.sparkSession) as made:
        table, _ = materialize(prefixes(docs, threshold, shingle), "shingle-prefixes")
        texts = table.count()
        nodes = table.groupBy("sig").agg(F.min(F.struct("doc_id", "n", "keys")).alias("x")).select("sig", "x.*")
        rows = nodes.select("sig", "n", F.posexplode("keys").alias("pos", "key"))
        several = rows.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("key")
        rows, _ = materialize(rows.join(several, "key", "left_semi"), "shingle-rows", texts)
        owners = table.groupBy("sig").agg(F.min("doc_id").alias("doc_id"))
        lead = rows.where(F.col("pos") < STAR_KEYS)
        centres = lead.groupBy("key").agg(F.min(F.struct(F.xxhash64("sig", "key"), F.col("sig"), F.col("n"))).alias("m")).select("key", F.col("m.sig").alias("c"), F.col("m.n").alias("cn"))
        close = F.least("n", "cn") >= F.lit(threshold) * F.greatest("n", "cn") - 1e-9
        stars = lead.join(centres, "key").where((F.col("sig") != F.col("c")) & close).select(F.least("sig", "c").alias("a"), F.greatest("sig", "c").alias("b")).distinct()
        prints, _ = materialize(simhash_dedup.fingerprints(docs.where("doc_id is not null"), shingle).groupBy("fp").agg(F.min("doc_id").alias("rep")), "shingle-prints", texts)
        owner = table.select("doc_id", "sig").distinct()
        near = simhash_dedup.links(prints, radius, block).join(owner.toDF("a", "s"), "a").join(owner.toDF("b", "t"), "b").where("s <> t").select(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b"))
        first = verified(stars.unionByName(near).distinct(), owners, docs, threshold, shingle, texts)
        found, (rooted, rooted_at) = first, _rooted(rows, first, texts)
        for n in range(ROUNDS):
            asked, asked_at = materialize(centred(rooted, threshold, n, block), "shingle-centred", texts)
            if many := asked.count():
                fresh = verified(asked, owners, docs, threshold, shingle, texts)
                found = found.union(fresh)
                release(docs.sparkSession, rooted_at)
                rooted, rooted_at = _rooted(rows, found, texts)
            release(docs.sparkSession, asked_at)
            if not many or 2 * fresh.count() < many:
                break
        second = verified(candidates(rooted, threshold, block), owners, docs, threshold, shingle, texts)
        third = decided(rooted, owners, docs, threshold, shingle, block, texts)
        roots = components(found.union(second).union(third), "shingle-components").withColumnRenamed("node", "sig")
        member, _ = materialize(table.select("doc_id", "sig").join(roots, "sig", "left").select("doc_id", F.coalesce("root", "sig").alias("root")), "shingle-members", texts)
        least = member.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("_n"))
        groups_of = salted_join(member, least.drop("_n"), ["root"], F.col("doc_id"), least.select("root", "_n"))
        out, path = materialize(groups_of.select("doc_id", "component_id"), "shingle-groups", texts)
        made.keep(path)
    return out


def drop_near_duplicates(docs: DataFrame, threshold: float = 0.8, shingle: int = 5) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its group; rows without a doc_id stay.

    Rows of one doc_id stand and fall together: they go if one of them is near a smaller document. Columns are kept as
    they are, whatever their names; no rows give no rows.
    """
    gone = near_duplicates(docs, threshold, shingle).where("component_id < doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
