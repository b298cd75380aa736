"""License scans: winnowed template fingerprints pick candidates, banded alignment reports coverage and spans.

Templates are hashed by K-word shingles and winnowed (the smallest of each WINDOW neighbours), into an inverted index
that is small by construction (the template list) and broadcast. A document is winnowed alike; shared fingerprints give
candidate diagonals. Around each cluster of diagonals a banded alignment matches the words in order, so inserted,
changed or missing words cost coverage but do not end a match.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm import _tokens
from recollect.llm._runtime import map_arrow

K, WINDOW, BAND = 3, 2, 8

# Public license notices, as they are usually written.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "All-rights-reserved": "All rights reserved.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
    "Apache-2.0-header": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
}


def winnow(h: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions of the smallest hash of each window, the rightmost of equal ones; short inputs keep their smallest."""
    if len(h) <= window:
        return np.flatnonzero(h == h.min())[-1:] if len(h) else np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(h, window)[:, ::-1]
    return np.unique(np.arange(len(views)) + window - 1 - views.argmin(axis=1))


def align(doc: np.ndarray, item: np.ndarray, band: int = BAND) -> list[tuple[int, int]]:
    """(place in doc, place in item) of a longest common subsequence with at most `band` words off the diagonal."""
    n, m = len(doc), len(item)
    best = np.zeros((m + 1, n + 1), np.int32)
    for i in range(1, m + 1):
        lo, hi = max(1, i - band), min(n, i + n - m + band if n > m else i + band)
        for j in range(lo, hi + 1):
            best[i, j] = best[i - 1, j - 1] + 1 if item[i - 1] == doc[j - 1] else max(best[i - 1, j], best[i, j - 1])
        best[i, hi + 1 :] = best[i, hi]
    i, j, out = m, n, []
    while i and j:
        if item[i - 1] == doc[j - 1] and best[i, j] == best[i - 1, j - 1] + 1:
            i, j = i - 1, j - 1
            out.append((j, i))
        elif best[i - 1, j] >= best[i, j - 1]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = 0.8) -> DataFrame:
    """(doc_id, license, coverage, matched, start, stop): a row per place where a template matches.

    start and stop are character offsets of the matched words. Of overlapping places of one template the best covered,
    then the first, is reported. Null and empty texts match nothing; repeated rows give repeated matches; no rows give
    no rows. Other columns are ignored.
    """
    named = templates or TEMPLATES
    vocabulary: dict[str, int] = {}
    items = [(name, np.array([vocabulary.setdefault(w, len(vocabulary)) for w in _tokens.spans(text)[0]], np.int64)) for name, text in named.items()]
    index: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for n, (_, w) in enumerate(items):
        h = _tokens.rolling(w, K)
        for p in winnow(h).tolist():
            index[int(h[p])].append((n, p))
    marks = np.array(sorted(index), np.uint64)
    # A template shorter than K + WINDOW - 1 words fills no window, so its one shingle counts wherever it is.
    short = np.array([int(_tokens.rolling(w, K)[0]) for _, w in items if K <= len(w) < K + WINDOW - 1], np.uint64)
    schema = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("coverage", pa.float64()), ("matched", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])

    def found(text: str) -> list[tuple]:
        doc = _tokens.ids(text, vocabulary)
        h = _tokens.rolling(doc, K)
        if not np.isin(h, marks).any():
            return []
        # Words in no template never match, so winnowing runs over the whole document with them as gaps of hash 0.
        places = winnow(np.where(h == 0, np.uint64(2**64 - 1), h))
        places = np.union1d(places, np.flatnonzero(np.isin(h, short)))
        diagonals: dict[int, set[int]] = defaultdict(set)
        for p in places[np.isin(h[places], marks)].tolist():
            for n, q in index[int(h[p])]:
                diagonals[n].add(p - q)
        spans = None
        out = []
        for n, starts in diagonals.items():
            name, item = items[n]
            done: list[tuple] = []
            for s in sorted(starts):
                lo, hi = max(0, s - BAND // 2), min(len(doc), s + len(item) + BAND // 2)
                pairs = align(doc[lo:hi], item)
                if not pairs or len(pairs) / len(item) < coverage:
                    continue
                spans = spans or _tokens.spans(text)[1]
                done.append((-len(pairs), lo + pairs[0][0], lo + pairs[-1][0]))
            taken: list[tuple[int, int]] = []
            for score, a, b in sorted(done):
                if all(b < x or a > y for x, y in taken):
                    taken.append((a, b))
                    out.append((name, -score / len(item), -score, spans[a][0], spans[b][1]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(doc_id, *m) for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)) for m in found(text.as_py() or "")]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(source, run, "doc_id long, license string, coverage double, matched long, start long, stop long")
