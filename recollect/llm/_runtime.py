"""Session settings, shared tables and block-wise grouping that the operators have in common."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from recollect.operators.shared import shared_path, spread

FILE_ROWS = 20_000  # a file, at least, of tables whose rows are about known


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session; the operators size their own deals by it, so set it to the data's size."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


class _Made(list):
    """Paths of the tables that were written inside a scratch scope."""

    def keep(self, path: str) -> None:
        """Leaves a table to the scope around this one, or to the caller."""
        self.remove(path)
        if len(_SCOPES) > 1:
            _SCOPES[-2].append(path)


_SCOPES: list[_Made] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[_Made]:
    """Tables that materialize writes inside are deleted at the end, but for those that are kept."""
    _SCOPES.append(_Made())
    try:
        yield _SCOPES[-1]
    finally:
        for path in _SCOPES.pop():
            release(spark, path)


def materialize(df: DataFrame, name: str, rows: int | None = None) -> tuple[DataFrame, str]:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors.

    With `rows`, about the number that the table grows with, there are no more files than that needs: on a local file
    system Hadoop starts a process for each file that it creates.
    """
    path = shared_path(df.sparkSession, name)
    if rows is not None:
        df = df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))
    df.write.parquet(path)
    if _SCOPES:
        _SCOPES[-1].append(path)
    free_shuffles(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def bucketed(df: DataFrame, name: str, n: int, key: str) -> tuple[DataFrame, tuple[str, str]]:
    """Write df as a table of n buckets by key and read it back; (name, path) of the table to drop and release.

    Grouping it by key needs no shuffle, however often.
    """
    spark = df.sparkSession
    path, table = shared_path(spark, name), f"recollect_{uuid.uuid4().hex}"
    df.repartition(n, key).write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(n, key).saveAsTable(table)
    free_shuffles(spark)
    return spark.table(table), (table, path)


def deal_keys(n: int) -> np.ndarray:
    """n integers, the i-th of which hash partitioning (Murmur3 of an int, seed 42) sends to partition i of n."""
    out = np.full(n, -1, np.int32)
    at, step = 0, max(1024, 16 * n)
    while (out < 0).any():
        key = np.arange(at, at + step, dtype=np.uint32)
        k = key * np.uint32(0xCC9E2D51)
        k = (k << np.uint32(15)) | (k >> np.uint32(17))
        h = np.uint32(42) ^ (k * np.uint32(0x1B873593))
        h = ((h << np.uint32(13)) | (h >> np.uint32(19))) * np.uint32(5) + np.uint32(0xE6546B64)
        h ^= np.uint32(4)
        for shift, by in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
            h = (h ^ (h >> np.uint32(shift))) * np.uint32(by)
        part = np.mod(h.view(np.int32).astype(np.int64), n)
        for p, i in zip(*np.unique(part, return_index=True)):
            if out[p] < 0:
                out[p] = at + i
        at += step
    return out


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of finished writes, which wait for a collection of the driver's heap."""
    spark._jvm.System.gc()


def release(spark: SparkSession, path: str) -> None:
    """Delete a table written by materialize that nothing reads any more; once more does no harm."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def salted_join(left: DataFrame, right: DataFrame, key: list[str], spread: Column, counts: DataFrame) -> DataFrame:
    """left.join(right, key, "left") for a right side with one row a key, with hot keys dealt over many tasks.

    counts (key columns, _n) are the rows of left per key. A key with more than a thousandth of all rows is hot: there
    are fewer than a thousand such keys, so their list is broadcast, and the right row of each is repeated for every
    thousandth. Rows of left are dealt by the hash of `spread`. Null keys meet nothing.
    """
    total = counts.agg(F.sum("_n")).first()[0] or 0
    share = max(100, total // 1000)
    hot = F.broadcast(counts.where(F.col("_n") > share).select(*[F.col(k).alias(f"_hot_{k}") for k in key], F.ceil(F.col("_n") / share).cast("int").alias("_salts")))

    def salts(side: DataFrame) -> DataFrame:
        on = [F.col(k) == F.col(f"_hot_{k}") for k in key]
        return side.join(hot, on, "left").drop(*[f"_hot_{k}" for k in key])

    dealt = salts(left).withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(spread), F.col("_salts")), F.lit(0)).cast("int")).drop("_salts")
    copies = salts(right).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return dealt.join(copies, [*key, "_salt"], "left").drop("_salt")


def pair_blocks(df: DataFrame, key: list[str], spread: Column, block: int, carried: DataFrame | None = None, on: list[str] | None = None, weight: Column | None = None) -> DataFrame:
    """Deal rows so that any two rows of a key meet in exactly one block, in blocks of about 2 x block rows at most.

    Keys with one row are dropped, as they have no pairs. A key with more than `block` rows is cut into chunks by the
    hash of `spread`, and each pair of chunks becomes a block of its own, so no key is gathered into one task. Adds
    `blk_a` <= `blk_b` (the block's chunks) and `blk_own` (the row's chunk); rows come sorted by key and block. Wide
    columns can stay in `carried`, joined by `on` to the rows that are left. Rows of more than `weight` 1 make chunks of
    fewer rows.
    """
    n = F.count(F.lit(1))
    size = n if weight is None else F.least(F.lit(block) * n, F.greatest(n, F.sum(weight)))
    counts = df.groupBy(*key).agg(n.alias("_n"), size.alias("_size")).where("_n > 1")
    dealt = (
        df.join(counts, key)
        .withColumn("_chunks", F.ceil(F.col("_size") / F.lit(block)).cast("int"))
        .withColumn("blk_own", F.pmod(F.xxhash64(spread), F.col("_chunks")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
        .withColumn("blk_a", F.least("blk_own", "_other"))
        .withColumn("blk_b", F.greatest("blk_own", "_other"))
        .drop("_n", "_size", "_chunks", "_other")
    )
    if carried is not None:
        dealt = dealt.join(carried, on)
    cols = [*key, "blk_a", "blk_b"]
    return dealt.repartition(partitions(df.sparkSession), *cols).sortWithinPartitions(*cols)


def groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Tables of consecutive rows with equal integer keys, out of sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in key]
        cuts = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1
        bounds = [0, *cuts.tolist(), batch.num_rows]
        for s, e in zip(bounds, bounds[1:]):
            this = tuple(int(c[s]) for c in cols)
            if held and this != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(s, e - s))
            last = this
    if held:
        yield pa.Table.from_batches(held)


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member index of each node's component, for the undirected links a-b between nodes 0..n-1."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while True:
            jump = new[new]
            if np.array_equal(jump, new):
                break
            new = jump
        if np.array_equal(new, root):
            break
        root = new
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


def components(edges: DataFrame, name: str = "components", rounds: int = 50) -> DataFrame:
    """Connected components of the undirected edges (a long, b long): (node, root), root the smallest node.

    Alternating large-star and small-star rounds: each is a map-side combined minimum by node and an equi-join that
    AQE may split at hubs. Every round is written to the shared folder, so lineage stays short and nothing but two
    counters reaches the driver. Nodes without an edge are not in the result; no edges give an empty result.
    """
    spark = edges.sparkSession
    start = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    # Settled when a round changes nothing.
    shape = ["count(1) n", "bit_xor(xxhash64(a, b)) x"]
    now, path = materialize(start, name)
    was = now.selectExpr(*shape).first()
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(
            F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")
        )
        small = small.select("e.*").where("a <> b").distinct()
        nxt, nxt_path = materialize(small, name, was.n)
        release(spark, path)
        now, path, last = nxt, nxt_path, was
        was = now.selectExpr(*shape).first()
        if was == last:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow over the cores there are, where the input is a scan with fewer splits."""
    return spread(df).mapInArrow(f, schema)
