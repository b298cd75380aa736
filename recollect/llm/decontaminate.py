"""Benchmark decontamination by greedy string tiling.

Shared `seed`-word shingles join a document to benchmark items. For each joined pair, tiling repeats: find the longest
match of unmarked words on both sides by Karp-Rabin hashes, mark it, and go on until no match of `seed` words is left.
Hashes run by doubling: those of 2 n words come out of two of n words, so they are computed once a pair, and the hash of
any length is put together from two of them that overlap. Tiles may come in any order, so reordered passages count as
well. An item leaks into a document if tiles cover at least `coverage` of its words.

The index of the items' shingles is broadcast in slices of SLICE_WORDS words at most, one scan of the documents each.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm import _tokens
from recollect.llm._runtime import map_arrow

SLICE_WORDS = 1_000_000
_BASE, _MIX, _SPREAD = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9), np.uint64(0xD6E8FEB86659FD93)


class _Windows:
    """Hashes of the windows of x, of any length, and which of them are free of marked words."""

    def __init__(self, x: np.ndarray, longest: int):
        self.x, self.marked = x, x < 0
        h, size = (x.astype(np.uint64) + np.uint64(1)) * _SPREAD, 1
        self.levels = [h]
        while 2 * size <= min(longest, len(x)):
            h = h[: len(h) - size] * np.uint64(pow(_BASE, size, 2**64)) + h[size:]
            size *= 2
            self.levels.append(h)

    def free(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, hashes) of the unmarked windows of `size` words."""
        n = len(self.x) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        before = np.concatenate([[0], np.cumsum(self.marked)])
        at = np.flatnonzero(before[size:] == before[:n])
        k = size.bit_length() - 1
        h = self.levels[k]
        return at, h[at] * _MIX + h[at + size - (1 << k)]

    def mark(self, at: int, size: int) -> None:
        self.marked[at : at + size] = True


def _match(doc: _Windows, item: _Windows, size: int) -> tuple[int, int] | None:
    """The leftmost place in the item, and there in the document, of a match of `size` unmarked words."""
    at_d, h_d = doc.free(size)
    at_i, h_i = item.free(size)
    if not len(at_d) or not len(at_i):
        return None
    known, first = np.unique(h_d, return_index=True)
    near = np.minimum(np.searchsorted(known, h_i), len(known) - 1)
    for k in np.flatnonzero(known[near] == h_i).tolist():
        d, i = int(at_d[first[near[k]]]), int(at_i[k])
        if (doc.x[d : d + size] == item.x[i : i + size]).all():
            return d, i
    return None


def tile(doc: np.ndarray, item: np.ndarray, seed: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (start in doc, start in item, words): longest first, then leftmost in the item and the document."""
    tiles = []
    most = min(len(doc), len(item))
    left, right = _Windows(doc, most), _Windows(item, most)
    while most >= seed and (hit := _match(left, right, seed)):
        size, above = seed, most + 1  # the longest match is at least `size` and below `above`
        step = seed
        while size + 1 < above:
            probe = min(size + step, (size + above) // 2) if above <= most else min(size + step, most)
            if found := _match(left, right, probe):
                hit, size, step = found, probe, 2 * step
            else:
                above = probe
        left.mark(hit[0], size)
        right.mark(hit[1], size)
        tiles.append((*hit, size))
        most = size  # no later match is longer
    return tiles


def _finder(part: list[tuple[int, str]], coverage: float, seed: int) -> Callable[[str], list[tuple]]:
    """The search of one slice: a text's (item_id, coverage, tiles, longest) for each item that leaks."""
    vocabulary: dict[str, int] = {}
    words = []
    for item_id, text in part:
        words.append((item_id, np.array([vocabulary.setdefault(w, len(vocabulary)) for w in _tokens.spans(text)[0]], np.int64)))
    index = sorted((h, n) for n, (_, w) in enumerate(words) for h in set(_tokens.rolling(w, seed).tolist()))
    index_h, index_n = np.array([h for h, _ in index], np.uint64), np.array([n for _, n in index], np.int64)

    def find(text: str) -> list[tuple]:
        doc = _tokens.ids(text, vocabulary)
        h = _tokens.rolling(doc, seed)
        if not len(index_h) or not len(h):
            return []
        at = np.minimum(np.searchsorted(index_h, h), len(index_h) - 1)
        hit = np.flatnonzero((index_h[at] == h) & (h != 0))
        if not len(hit):
            return []
        near: dict[int, list[int]] = defaultdict(list)
        lo, hi = np.searchsorted(index_h, h[hit]), np.searchsorted(index_h, h[hit], side="right")
        for p, s, e in zip(hit.tolist(), lo.tolist(), hi.tolist()):
            for n in index_n[s:e].tolist():
                near[n].append(p)
        out = []
        for n, places in near.items():
            item_id, item = words[n]
            # Every window of a tile is a seed that the document has, so tiles cover no more than those seeds.
            reach = np.zeros(len(item), bool)
            for q in np.flatnonzero(np.isin(_tokens.rolling(item, seed), h[places])).tolist():
                reach[q : q + seed] = True
            if reach.sum() < coverage * len(item):
                continue
            # Only words within reach of a seed can be part of a tile.
            keep = np.zeros(len(doc), bool)
            for p in places:
                keep[p : p + seed] = True
            region = np.flatnonzero(keep)
            gaps = np.flatnonzero(np.diff(region) > 1) + 1
            tiles = tile(np.insert(doc[region], gaps, -1), item, seed)
            covered = sum(t[2] for t in tiles) / len(item)
            if tiles and covered >= coverage:
                out.append((item_id, covered, len(tiles), tiles[0][2]))
        return out

    return find


def _slices(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in bounded slices, cut by their running number of words; an empty benchmark is one empty slice."""
    part: list[tuple[int, str]] = []
    held = 0
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    for row in items.toLocalIterator():
        n = len(row.text) // 4 + 1
        if part and held + n > SLICE_WORDS:
            yield part
            part, held = [], 0
        part.append((row.item_id, row.text))
        held += n
    yield part


def matches(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.5, seed: int = 5) -> DataFrame:
    """(doc_id, item_id, coverage, tiles, longest): a row per document row and leaked item.

    Items of fewer than `seed` words, null texts and empty texts match nothing. Repeated rows give repeated matches;
    rows with a null doc_id are reported with it; no documents or no items give no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("coverage", pa.float64()), ("tiles", pa.int64()), ("longest", pa.int64())])

    def scan(part: list[tuple[int, str]]) -> DataFrame:
        table = spark.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            find = _finder(table.value, coverage, seed)
            for batch in batches:
                rows = [(doc_id, *m) for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)) for m in find(text.as_py())]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

        return map_arrow(source, run, "doc_id long, item_id long, coverage double, tiles long, longest long")

    return reduce(DataFrame.unionByName, [scan(part) for part in _slices(benchmark)])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.5, seed: int = 5) -> DataFrame:
    """The rows of docs into which no benchmark item leaks, judged row by row by their own text.

    Null and empty texts stay; repeated rows are judged alike; no items drop nothing, no rows give none. All columns are
    kept, whatever their names. Rows are filtered where they are read: nothing is shuffled.
    """
    spark = docs.sparkSession
    at = docs.columns.index("text")

    def clean(rows: DataFrame, part: list[tuple[int, str]]) -> DataFrame:
        table = spark.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            find = _finder(table.value, coverage, seed)
            for batch in batches:
                yield batch.filter(pa.array([not find(t.as_py() or "") for t in batch.column(at)], pa.bool_()))

        return map_arrow(rows, run, docs.schema)

    return reduce(clean, _slices(benchmark), docs)
