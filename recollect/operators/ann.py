"""Approximate vector search: hyperplane buckets, several probes, exact rescoring; and the rule when to use it."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.operators.filters import FactFilter
from recollect.operators.retrieval import ranked, vector_scores
from recollect.operators.shared import materialize

c = F.col
THRESHOLD = 50_000  # fact count from which the approximate index is used
OVER, WIDENINGS = 3, 3


class VectorSearchStrategy(Protocol):
    def search(self, facts: DataFrame, query: list[float], k: int) -> DataFrame: ...
    def notify_insert(self, new: DataFrame) -> VectorSearchStrategy: ...
    def notify_expire(self, ids: DataFrame) -> VectorSearchStrategy: ...


@dataclass(frozen=True)
class BruteForce:
    """Every vector is scored; nothing has to be kept up to date."""

    def search(self, facts: DataFrame, query: list[float], k: int) -> DataFrame:
        return ranked(vector_scores(facts, query), k)

    def notify_insert(self, new: DataFrame) -> BruteForce:
        return self

    def notify_expire(self, ids: DataFrame) -> BruteForce:
        return self


def _planes(dim: int, bits: int, tables: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim, bits, tables]).standard_normal((tables, bits, dim))


@dataclass(frozen=True)
class HyperplaneIndex:
    """cells (cell, id), sorted by cell: each table has a cell of `bits` signs for each vector.

    A search probes, in every table, the cells whose signs differ from the query's where its margin is least; it asks
    for OVER times k candidates, doubles the probes up to WIDENINGS times while they are fewer, scores the candidates
    exactly, and scores everything if they are fewer than k even then. Expired facts need no notice, as candidates meet
    the facts given to the search.
    """

    cells: DataFrame
    dim: int
    bits: int
    tables: int
    seed: int = 9

    @staticmethod
    def cells_of(vectors: DataFrame, dim: int, bits: int, tables: int, seed: int) -> DataFrame:
        def cells(x: pd.Series) -> pd.Series:
            m = np.stack(x.to_numpy()).astype(float)
            signs = np.einsum("tbd,nd->ntb", _planes(dim, bits, tables, seed), m) > 0
            return pd.Series(list((signs * (1 << np.arange(bits))).sum(axis=2) + (np.arange(tables) << bits)))

        rows = vectors.where("size(embedding) > 0").select("id", F.pandas_udf(cells, "array<long>")("embedding").alias("c"))
        return rows.select(F.explode("c").alias("cell"), "id")

    @classmethod
    def build(cls, vectors: DataFrame, dim: int, bits: int = 12, tables: int = 16, seed: int = 9) -> HyperplaneIndex:
        """The index of vectors (id, embedding), written to the shared folder; more bits suit more vectors (about 2^bits of 16)."""
        cells, _ = materialize(cls.cells_of(vectors, dim, bits, tables, seed).repartitionByRange("cell").sortWithinPartitions("cell"), "ann-cells")
        return cls(cells, dim, bits, tables, seed)

    def notify_insert(self, new: DataFrame) -> HyperplaneIndex:
        return HyperplaneIndex(self.cells.unionByName(self.cells_of(new, self.dim, self.bits, self.tables, self.seed)), self.dim, self.bits, self.tables, self.seed)

    def notify_expire(self, ids: DataFrame) -> HyperplaneIndex:
        return HyperplaneIndex(self.cells.join(ids.select("id"), "id", "left_anti").select("cell", "id"), self.dim, self.bits, self.tables, self.seed)

    def probes(self, query: list[float], n: int) -> list[int]:
        """The n likeliest cells of each table: by the sum of squared margins of the signs that differ, three at most."""
        margin = np.einsum("tbd,d->tb", _planes(self.dim, self.bits, self.tables, self.seed), np.asarray(query, float))
        flips = [f for k in range(4) for f in combinations(range(self.bits), k)]
        out = []
        for t, row in enumerate(margin):
            own = int(((row > 0) * (1 << np.arange(self.bits))).sum())
            best = sorted(flips, key=lambda f: sum(row[i] ** 2 for i in f))[:n]
            out += [(own ^ sum(1 << i for i in f)) + (t << self.bits) for f in best]
        return out

    def search(self, facts: DataFrame, query: list[float], k: int, probes: int = 16) -> DataFrame:
        """(id, score, rank) of the k best of facts."""
        if len(query) != self.dim:
            raise ValueError(f"the query's length is not {self.dim} but {len(query)}")
        for step in range(WIDENINGS + 1):
            near = self.cells.where(c("cell").isin(*self.probes(query, probes << step))).select("id").distinct()
            found = facts.join(near, "id", "left_semi")
            n = found.limit(OVER * k).count()
            if n >= OVER * k or (step == WIDENINGS and n >= k):
                return ranked(vector_scores(found, query), k)
        return BruteForce().search(facts, query, k)


def use_index(which: FactFilter, count: int, threshold: int = THRESHOLD) -> bool:
    """Whether the approximate index may answer: enough facts, and no filter but active, type and scope."""
    plain = FactFilter(fact_types=which.fact_types, scopes=which.scopes)
    same = all(getattr(plain, n) is getattr(which, n) or (not isinstance(getattr(which, n), DataFrame) and getattr(plain, n) == getattr(which, n)) for n in ("time", "ids", "pinned", "has_vector", "absent", "present", "equals"))
    return same and count >= threshold


def vector_search(facts: DataFrame, query: list[float], k: int, which: FactFilter, index: HyperplaneIndex | None = None, threshold: int = THRESHOLD) -> DataFrame:
    """(id, score, rank): the filter, then the index where the rule allows it, else every vector."""
    kept = which.apply(facts)
    if index is not None and use_index(which, facts.count(), threshold):
        return index.search(kept, query, k)
    return BruteForce().search(kept, query, k)
