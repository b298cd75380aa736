"""Embedding near-duplicates by collision-counting projections.

Unit vectors are projected on many random lines. Two vectors at distance r differ on a line by a normal value of
deviation r, so at the threshold's distance they fall into one query-centred window of a line with a known chance, and
unrelated vectors do much more rarely. The method counts in how many windows a pair collides and verifies by exact
cosine the pairs that pass a count calibrated for recall:

1. `tables` deals: each sorts the vectors along `lines` lines at once (cells of the projections, at random offsets) and
   so brings together vectors that are near on all of them. How many lines and deals follows from the number of
   vectors in the largest label and from `miss`, the chance to lose a pair that lies exactly at the threshold.
2. Within a deal's cell, rows are sorted along one line, the query-centred window gives the pairs, and the collisions on
   `COUNTED` further lines are counted; pairs that cannot reach the calibrated count any more are dropped on the way.
3. Pairs that pass are verified by cosine in double precision.

Equal vectors of a label are one class throughout: copies are counted, never paired.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm._runtime import components, groups, local_roots, map_arrow, materialize, pair_blocks, salted_join, scratch

COUNTED = 48
CELL = 10.0  # width of a cell in distances at the threshold
WINDOW = 2.0  # half width of a counted window, likewise


def calibrate(n: int, threshold: float, miss: float) -> tuple[int, int, int]:
    """(lines, tables, count): for n vectors, so that a pair exactly at the threshold is lost with chance `miss` at most."""
    r = math.sqrt(2 - 2 * threshold)
    near = 1 - math.sqrt(2 / math.pi) / CELL
    x = np.linspace(0, CELL * r, 2001)
    far = float(np.mean(np.exp(-((x / math.sqrt(2)) ** 2) / 2) * (1 - x / (CELL * r))) * 2 * CELL * r / math.sqrt(4 * math.pi))
    lines = max(4, math.ceil(math.log(8 * max(n, 2)) / -math.log(min(far, 0.9))))  # about an eighth of the rows share a cell by chance
    tables = math.ceil(math.log(miss / 2) / math.log1p(-(near**lines)))
    p = math.erf(WINDOW / math.sqrt(2))
    lost, count = 0.0, 0
    while count < COUNTED:
        lost += math.comb(COUNTED, count) * p**count * (1 - p) ** (COUNTED - count)
        if lost > miss / 2:
            break
        count += 1
    return lines, tables, count


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = pa.compute.list_flatten(column)
    return np.asarray(flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat).reshape(-1, dim)


def classes(vectors: DataFrame) -> DataFrame:
    """(label, embedding, rep, copies): distinct usable vectors of each label with their smallest id and row count."""
    e = F.col("embedding")
    usable = (
        F.col("vec_id").isNotNull()
        & F.col("label").isNotNull()
        & (F.size(e) > 0)
        & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists(e, lambda x: x != 0)
    )
    return vectors.where(usable).groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))


def _cells(dim: int, lines: int, tables: int, width: float, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, dim])
    mix = rng.integers(1, 2**62, (tables, lines), dtype=np.int64) | 1
    return rng.standard_normal((dim, tables * lines)), rng.uniform(0, width, tables * lines), mix


def cells(found: DataFrame, threshold: float, lines: int, tables: int, seed: int = 11) -> DataFrame:
    """The classes with `cells`: the cell of each table, a hash of the cells of its lines."""
    width = CELL * math.sqrt(2 - 2 * threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple] = {}
        for whole in batches:
            sizes = pa.compute.list_value_length(whole.column(1)).to_numpy()
            for dim in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == dim)
                for at in range(0, len(rows), 1000):
                    batch = whole.take(pa.array(rows[at : at + 1000]))
                    n = batch.num_rows
                    if dim not in known:
                        known[dim] = _cells(dim, lines, tables, width, seed)
                    a, shift, mix = known[dim]
                    grid = np.floor((_unit(_matrix(batch.column(1), dim)) @ a + shift) / width).astype(np.int64)
                    h = (grid.reshape(n, tables, lines) * mix).sum(axis=2) + dim
                    h ^= h >> 29
                    cell = ((h * 0x5851F42D4C957F2D) >> 32).astype(np.int32)
                    offsets = pa.array(np.arange(n + 1, dtype=np.int32) * tables)
                    yield pa.record_batch([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(cell.ravel()))], [*batch.schema.names, "cells"])

    kinds = dict(found.dtypes)
    rows = found.select(F.col("label").cast("long").alias("label"), "embedding", F.col("rep").cast("long").alias("rep"), "copies")
    return map_arrow(rows, run, f"label long, embedding {kinds['embedding']}, rep long, copies long, cells array<int>")


def _passing(p: np.ndarray, q: np.ndarray, same: bool, w: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs (of p, of q) whose window collisions over the columns reach the count."""
    order = np.argsort(q[:, 0], kind="stable")
    line = q[order, 0]
    wide = 3.5 * w  # the sorted line may not lose a pair that the count would pass
    lo, hi = np.searchsorted(line, p[:, 0] - wide), np.searchsorted(line, p[:, 0] + wide, side="right")
    out_i, out_j = [], []
    step = max(1, 400_000 // max(1, len(q)))
    for at in range(0, len(p), step):
        n = (hi - lo)[at : at + step]
        i = np.repeat(np.arange(at, at + len(n)), n)
        j = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[at : at + step], n)]
        if same:
            keep = i < j
            i, j = i[keep], j[keep]
        hits = np.zeros(len(i), np.int16)
        for c in range(1, p.shape[1], 8):
            part = slice(c, min(c + 8, p.shape[1]))
            hits += (np.abs(p[i, part] - q[j, part]) <= w).sum(axis=1, dtype=np.int16)
            keep = hits + (p.shape[1] - part.stop) >= count
            i, j, hits = i[keep], j[keep], hits[keep]
        out_i.append(i)
        out_j.append(j)
    return np.concatenate(out_i), np.concatenate(out_j)


def block_links(found: DataFrame, threshold: float, count: int, block: int, seed: int = 12) -> DataFrame:
    """Per class and block: (rep, label, links long, root): vectors linked there and the smallest row of its group."""
    w = WINDOW * math.sqrt(2 - 2 * threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for g in groups(batches, ["deal", "cell", "label", "blk_a", "blk_b"]):
            n = g.num_rows
            sizes = pa.compute.list_value_length(g.column("embedding")).to_numpy()
            dim = int(sizes[0])
            if (sizes != dim).any():  # a hash met another dimension's cell
                rest = [g.filter(pa.array(sizes == d)) for d in np.unique(sizes)]
            else:
                rest = [g]
            for part in rest:
                n = part.num_rows
                if n < 2:
                    continue
                x = _matrix(part.column("embedding"), int(pa.compute.list_value_length(part.column("embedding"))[0].as_py()))
                unit = _unit(x)
                a = known.setdefault(x.shape[1], np.random.default_rng([seed, x.shape[1]]).standard_normal((x.shape[1], COUNTED + 1)))
                p = unit @ a
                deal = int(part.column("deal")[0].as_py())
                first = int(part.column("blk_a")[0].as_py())
                same = first == int(part.column("blk_b")[0].as_py())
                own = part.column("blk_own").to_numpy()
                left = np.arange(n) if same else np.flatnonzero(own == first)
                right = left if same else np.flatnonzero(own != first)
                if not len(left) or not len(right):
                    continue
                i, j = _passing(p[left], p[right], same, w, count)
                i, j = left[i], right[j]
                cell = _matrix(part.column("cells"), len(part.column("cells")[0]))
                links = np.zeros(n, np.int64)
                found = []
                copies = part.column("copies").to_numpy()
                for at in range(0, len(i), 50_000):
                    s, t = i[at : at + 50_000], j[at : at + 50_000]
                    keep = np.einsum("ij,ij->i", unit[s], unit[t]) >= threshold
                    s, t = s[keep], t[keep]
                    if deal:  # counted in the first deal that brings the two together
                        keep = ~(cell[s, :deal] == cell[t, :deal]).any(axis=1)
                        s, t = s[keep], t[keep]
                    np.add.at(links, s, copies[t])
                    np.add.at(links, t, copies[s])
                    found.append((s, t))
                if not links.any():
                    continue
                s, t = (np.concatenate([f[k] for f in found]) for k in (0, 1))
                root = local_roots(n, s, t)
                hit = np.flatnonzero(links)
                rep = part.column("rep").to_numpy()
                yield pa.record_batch(
                    [pa.array(rep[hit]), part.column("label").combine_chunks().take(pa.array(hit)), pa.array(links[hit]), pa.array(rep[root[hit]])],
                    ["rep", "label", "links", "root"],
                )

    # Only narrow rows are dealt; vectors join the rows that share a cell with another.
    dealt = found.select("label", "rep", F.posexplode("cells").alias("deal", "cell"))
    rows = pair_blocks(dealt, ["deal", "cell", "label"], F.col("rep"), block, found, ["label", "rep"])
    return map_arrow(rows, run, "rep long, label long, links long, root long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, miss: float = 1e-6, block: int = 1024) -> DataFrame:
    """(vec_id, n_links, component_id, kept, label): cosine near-duplicates among vectors of equal label.

    One row per input row; equal vectors link to each other. Null or zero vectors, vectors with null or non-finite
    components and vectors without label link with nothing, and so do rows without vec_id (component_id null, kept
    false). Vectors of different length never link. Repeated rows count as further vectors. Only vec_id, embedding and
    label are read, so other columns may have any name; an empty table gives an empty result.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding"), F.col("label").cast("long").alias("label"))
    with scratch(vectors.sparkSession) as made:
        found, _ = materialize(classes(rows), "vector-classes")
        most = found.groupBy("label").count().agg(F.max("count")).first()[0] or 0
        lines, tables, count = calibrate(int(most), threshold, miss)
        dealt, _ = materialize(cells(found, threshold, lines, tables), "vector-cells")
        seen, _ = materialize(block_links(dealt, threshold, count, block), "vector-links")
        roots = components(seen.select(F.col("rep").alias("a"), F.col("root").alias("b")), "vector-components")
        sums = seen.groupBy("rep", "label").agg(F.sum("links").alias("links"))
        per_class = (
            found.join(sums, ["rep", "label"], "left")
            .join(roots, F.col("rep") == F.col("node"), "left")
            .select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
        )
        has_id = F.col("vec_id").isNotNull()
        met = salted_join(rows, per_class, ["label", "embedding"], F.col("vec_id"), found.select("label", "embedding", F.col("copies").alias("_n")))
        answer = met.select(
            "vec_id",
            F.when(has_id, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
            F.when(has_id, F.coalesce("component_id", "vec_id")).alias("component_id"),
            F.when(has_id, F.col("vec_id") == F.coalesce("component_id", "vec_id")).otherwise(False).alias("kept"),
            F.col("label").cast("int").alias("label"),
        )
        out, path = materialize(answer, "vector-groups")
        made.keep(path)
    return out
