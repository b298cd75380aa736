"""SimHash near-duplicates through vantage-point trees.

A fingerprint is the majority vote of the 64-bit hashes of a document's word shingles. Fingerprints link when they
differ in at most `radius` bits. The search tree is laid out as shuffle keys, so its leaves are shards:

* The 64 bits are cut into more than `radius` bands. A linked pair has at least bands - radius bands without any
  difference (pigeonhole), so there is a tree for each choice of that many bands, in which its radius is 0. Each inner
  level partitions by the Hamming distance of the chosen bands to a vantage point; the triangle bound
  |d(x, v) - d(y, v)| <= 0 prunes every branch but one.
* The last level uses the distance of the whole fingerprint to a vantage point, cut into shells of width radius + 1.
  The triangle bound is the radius there, so a fingerprint is stored in its own shell and also queries the next one
  if its ball crosses the boundary.

How many bands follows from the number of fingerprints: one more band squares the leaves of a tree or more, for a few
more trees, so leaves stay small as the fingerprints grow and the work near to their number.

Rows of a leaf are compared exactly, in blocks of bounded size, and linked groups are closed over by components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm._runtime import components, groups, local_roots, map_arrow, materialize, pair_blocks, salted_join, scratch

BITS = 64
LEAF = 512  # fingerprints a leaf should have at most, if they spread evenly


def _vantage(seed: int, n: int) -> list[int]:
    return [int(x) for x in np.random.default_rng(seed).integers(-(2**63), 2**63 - 1, n, dtype=np.int64)]


def fingerprint_bytes(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """SimHash of one UTF-8 text: ASCII lower-cased, words split at ASCII white space, shingles joined by one space."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - shingle + 1]
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[s:e], seed) for s, e in zip(starts.tolist(), ends[shingle - 1 :].tolist())]
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 8192):
        part = np.array(hashes[at : at + 8192], dtype=">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp long): one row per row of docs. Null and word-less texts have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(1).cast(pa.large_binary())
            fps = [fingerprint_bytes(t.as_py() or b"", shingle, seed) for t in text]
            yield pa.record_batch([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, fp long")


def band_masks(n: int, radius: int) -> list[int]:
    """The bits of each tree's chosen bands, for n fingerprints; any two within the radius agree on one of them."""
    bands = radius + 1
    while bands < radius + 4 and n / 2 ** (BITS * (bands - radius) / bands) > LEAF:
        bands += 1
    cuts = [t * BITS // bands for t in range(bands + 1)]
    each = [(1 << hi) - (1 << lo) for lo, hi in zip(cuts, cuts[1:])]
    return [sum(chosen) for chosen in combinations(each, bands - radius)]


def tree_rows(fps: DataFrame, masks: list[int], radius: int = 4, seed: int = 7) -> DataFrame:
    """(shard, path, query boolean, fp, rep): a row per tree for the home leaf, and one more where the ball crosses it."""
    width = radius + 1
    trees = []
    whole = _vantage(seed, 1)[0]
    for t, mask in enumerate(masks):
        bits = mask.bit_count()
        signed = mask - 2**64 if mask >= 2**63 else mask
        # A distance tells about two bits and a half; path numbers are distinct within a tree and fit 63 bits.
        levels = min(int(62 / np.log2(bits + 1)), -(-bits // 2))
        path = F.lit(0).cast("long")
        for v in _vantage(seed + 1 + t, levels):
            path = path * F.lit(bits + 1) + F.bit_count(F.col("fp").bitwiseXOR(F.lit(v)).bitwiseAND(F.lit(signed)))
        trees.append(F.struct(F.lit(t).alias("tree"), path.cast("long").alias("path")))
    far = F.bit_count(F.col("fp").bitwiseXOR(F.lit(whole)))
    shell = F.floor(far / width)
    crosses = F.floor((far + radius) / width) > shell
    shells = F.when(crosses, F.array(F.struct(shell.alias("shell"), F.lit(False).alias("query")), F.struct((shell + 1).alias("shell"), F.lit(True).alias("query")))).otherwise(
        F.array(F.struct(shell.alias("shell"), F.lit(False).alias("query")))
    )
    return (
        fps.select("fp", "rep", F.explode(F.array(*trees)).alias("t"), shells.alias("s"))
        .select("fp", "rep", "t.*", F.explode("s").alias("s"))
        .select((F.col("tree") * (BITS + 1) + F.col("s.shell")).cast("int").alias("shard"), "path", F.col("s.query").alias("query"), "fp", "rep")
    )


def links(fps: DataFrame, radius: int = 4, block: int = 1024, seed: int = 7) -> DataFrame:
    """(a, b): for distinct fingerprints (fp, rep), links that connect the same reps as all pairs within the radius."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, ["shard", "path", "blk_a", "blk_b"]):
            fp = g.column("fp").to_numpy().view(np.uint64)
            rep = g.column("rep").to_numpy()
            own = g.column("blk_own").to_numpy()
            query = g.column("query").to_numpy()
            first = int(g.column("blk_a")[0].as_py())
            same = first == int(g.column("blk_b")[0].as_py())
            left = np.arange(len(fp)) if same else np.flatnonzero(own == first)
            right = left if same else np.flatnonzero(own != first)
            found_a, found_b = [], []
            for at in range(0, len(left), 256):
                rows = left[at : at + 256]
                i, j = np.nonzero(np.bitwise_count(fp[rows][:, None] ^ fp[right][None, :]) <= radius)
                i, j = rows[i], right[j]
                keep = ((i < j) if same else np.ones(len(i), bool)) & ~(query[i] & query[j])
                found_a.append(i[keep])
                found_b.append(j[keep])
            a, b = np.concatenate(found_a), np.concatenate(found_b)
            if not len(a):
                continue
            root = local_roots(len(fp), a, b)
            inner = np.flatnonzero(root != np.arange(len(fp)))
            yield pa.record_batch([pa.array(rep[inner]), pa.array(rep[root[inner]])], ["a", "b"])

    rows = pair_blocks(tree_rows(fps, band_masks(fps.count(), radius), radius, seed), ["shard", "path"], F.col("fp"), block)
    return map_arrow(rows, run, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 4, shingle: int = 4, block: int = 1024) -> DataFrame:
    """(doc_id, fingerprint, component_id): near-duplicate groups of documents.

    One row per input row. Word-less texts share fingerprint zero and link like any other. Repeated rows keep their
    rows; rows with a null doc_id carry a fingerprint and link nothing (component_id null). Only `doc_id` and `text`
    are read, so further columns of any name are ignored; an empty table gives an empty result.
    """
    with scratch(docs.sparkSession) as made:
        fps, _ = materialize(fingerprints(docs, shingle), "simhash")
        distinct, _ = materialize(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("_n")), "simhash-distinct")
        roots = components(links(distinct.select("fp", "rep"), radius, block), "simhash-components")
        by_fp = distinct.join(roots, distinct.rep == roots.node, "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
        met = salted_join(fps, by_fp, ["fp"], F.col("doc_id"), distinct.select("fp", "_n"))
        group = F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
        out, path = materialize(met.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), group), "simhash-groups")
        made.keep(path)
    return out
