"""Suffix-array dedup over a run-length (BWT) index, sharded by minimizers.

Task: remove every byte that a `length`-byte string covers which also starts in a document with a smaller doc_id.

One index over the whole corpus does not fit a machine, so strings are first routed to shards. The minimizer of a
`length`-byte string is its smallest K-byte hash; equal strings have equal minimizers. Documents are dealt into groups
once, into a table bucketed by group, and three passes read that table without another shuffle of texts:

1. Each group sends the distinct minimizers of its strings, packed, to the shard of their hash. Shards answer with
   those that more than one text has, and with those that more than `hot` texts have. Everything else is unique and
   never leaves its group.
2. Each group cuts its texts into segments, runs of strings with one shared minimizer, and sends each distinct segment
   once with its smallest doc_id. A shard collapses equal segments, compared byte by byte. Segments that share a
   minimizer but differ go into a RunIndex, and are streamed through it: the matching statistics say for each string
   whether the match with another document's text reaches `length`, and which smallest document has it.
   Strings of a hot minimizer are sent one by one instead, as 128-bit digests, and so are spread over all shards:
   no task holds all segments of a passage that a third of the documents share.
3. Groups get, for each segment, the smallest doc_id of its strings as runs, and mark what they cover.

Copies collapse in every group before anything is sent, so a hot passage costs a shard one row per group. A group sends
one packed row to each shard, as many as the shuffle has blocks; so partitions of a GB, not of MBs, suit 100 TB.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm._runtime import bucketed, deal_keys, materialize, partitions, release

K = 20
HOT = 4096  # different texts with one minimizer, beyond which its strings are dealt one by one
CHUNK = 1 << 18  # bytes of text hashed at a time
LONGEST = 2048  # strings in a segment
INDEX_BYTES = 1 << 18  # text at which a run index takes no further minimizers
_FACTORS = np.random.default_rng(20).integers(1, 2**62, 7, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
NONE = np.iinfo(np.int64).max
_ZSTD = pa.Codec("zstd", compression_level=1)


def _grams(b: np.ndarray) -> np.ndarray:
    """A mixed 48-bit hash of each K-byte window, out of overlapping 8-byte words."""
    n = len(b) - K + 1
    word = np.ndarray(len(b) - 7, "<u8", np.ascontiguousarray(b), 0, (1,))
    h = word[:n] * _FACTORS[0]
    for at, factor in zip((*range(8, K - 8, 8), K - 8), _FACTORS[1:]):
        h += word[at : at + n] * factor
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(29))) >> np.uint64(16)


def minimizers(b: np.ndarray, length: int) -> np.ndarray:
    """The smallest mixed K-byte hash, of 48 bits, of each `length`-byte window of b."""
    h = _grams(b)
    w, size = length - K + 1, 1
    while size * 2 <= w:
        h = np.minimum(h[: len(h) - size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (w - size)], h[w - size :]) if w > size else h


def segments(b: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows, minimizer) of the runs of windows with one minimizer, LONGEST windows at most."""
    n = len(b) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    heads, values, last = [], [], None
    for at in range(0, n, CHUNK):
        m = minimizers(b[at : min(at + CHUNK, n) + length - 1], length)
        cut = np.flatnonzero(np.concatenate([[last is None or m[0] != last], m[1:] != m[:-1]]))
        heads.append(cut + at)
        values.append(m[cut])
        last = m[-1]
    start, value = np.concatenate(heads), np.concatenate(values)
    size = np.diff(np.append(start, n))
    if size.max() > LONGEST:
        parts = -(-size // LONGEST)
        step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        start, value = np.repeat(start, parts) + step * LONGEST, np.repeat(value, parts)
        size = np.minimum(np.repeat(size, parts) - step * LONGEST, LONGEST)
    return start, size, value


class RunIndex:
    """Run-compressed BWT of different segments, with samples where runs end.

    Suffixes are sorted once to build it. What is kept grows with the runs: each run's first row, character and LF
    step, and the samples. A class is the interval of rows whose suffixes start with one `length`-byte string. Where a
    class lies inside a run and the step back leads to no further occurrence, the class of the longer match has the same
    documents, one place to the left; so only classes at run ends and branches are sampled, with their smallest
    document and the place of the string in it.
    """

    def __init__(self, parts: list[bytes], docs: np.ndarray, length: int):
        self.length = length
        self.sizes = np.array([len(p) for p in parts], np.int64)
        self.text = b"\0".join(parts) + b"\0"
        self.ends = np.cumsum(self.sizes + 1) - 1
        t = np.frombuffer(self.text, np.uint8).astype(np.int64) + 1
        t[self.ends] = 0
        n = len(t)
        h = min(7, length)
        padded = np.concatenate([t, np.zeros(h, np.int64)])
        key = np.zeros(n, np.int64)
        for j in range(h):
            key = key * 257 + padded[j : j + n]
        # A suffix's rank is the first row of those that start with the same h characters; h doubles, and only rows of
        # which several are alike are sorted again.
        sa = np.argsort(key)
        ordered = key[sa]
        head = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        rank = np.empty(n, np.int64)
        rank[sa] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        near = rank.copy(), h  # exact for strings of h characters
        open_ = np.flatnonzero(~(head & np.append(head[1:], True)))
        while len(open_):
            suffix = sa[open_]
            after = suffix + h
            key = rank[suffix] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
            order = np.argsort(key)
            suffix, key = suffix[order], key[order]
            sa[open_] = suffix
            head = np.concatenate([[True], key[1:] != key[:-1]])
            rank[suffix] = np.maximum.accumulate(np.where(head, open_, 0))
            open_ = open_[~(head & np.append(head[1:], True))]
            h *= 2
            if h <= length:
                near = rank.copy(), h
        bwt = t[sa - 1]
        self.run_start = np.flatnonzero(np.concatenate([[True], bwt[1:] != bwt[:-1]]))
        run_char = bwt[self.run_start]
        run_size = np.diff(np.append(self.run_start, n))
        # LF of a run's first row: rows of smaller characters, then of this one in earlier runs.
        by_char = np.argsort(run_char, kind="stable")
        self.back = np.empty(len(by_char), np.int64)
        self.back[by_char] = np.cumsum(run_size[by_char]) - run_size[by_char]
        self.back -= self.run_start
        self.end_row = rank[self.ends]
        self._sample(sa, rank, *near, docs, n)

    def _sample(self, sa: np.ndarray, rank: np.ndarray, near: np.ndarray, h: int, docs: np.ndarray, n: int) -> None:
        length = self.length
        whole = np.repeat(self.ends, self.sizes + 1) - np.arange(n) >= length  # places where a string starts
        tail = np.minimum(sa + length - h, n - 1)
        ok = whole[sa]
        same = (near[sa[1:]] == near[sa[:-1]]) & (near[tail[1:]] == near[tail[:-1]]) & ok[1:] & ok[:-1]
        start = np.flatnonzero(np.concatenate([[True], ~same]))
        size = np.diff(np.append(start, n))
        cls = np.repeat(np.arange(len(start)), size)
        of = np.repeat(docs, self.sizes + 1)
        known, doc_rank = np.unique(docs, return_inverse=True)
        low = np.minimum.reduceat(np.repeat(doc_rank, self.sizes + 1)[sa] * n + sa, start)
        # The class of the next place: one run, as many rows, and so the same occurrences one to the right?
        first = sa[start]
        right = np.minimum(first + 1, n - 1)
        right_class = cls[rank[right]]
        run = np.searchsorted(self.run_start, start, side="right")
        run_last = np.searchsorted(self.run_start, start + size - 1, side="right")
        follows = whole[right] & (size[right_class] == size) & (run[right_class] == run_last[right_class])
        marked = whole[first] & ~follows
        self.mark_start, self.mark_end = start[marked], (start + size)[marked]
        self.mark_place = low[marked] % n
        self.mark_doc = of[self.mark_place]

    def matches(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each segment (starts, docs): the smallest document of the strings from each start to the next one.

        All segments step backward through the runs at once. A step makes the match one longer and moves its place
        along; where the row lies in a sampled class, the match goes on in the smallest document of that class.
        """
        lanes = np.argsort(-self.sizes, kind="stable")  # longest first, so that those still running are a prefix
        row, ends, sizes = self.end_row[lanes], self.ends[lanes], self.sizes[lanes]
        heads: list[tuple[np.ndarray, ...]] = []
        for made in range(1, int(sizes[0]) + 1):
            live = int(np.searchsorted(-sizes, -made, side="right"))
            row = row[:live]
            row = row + self.back[np.searchsorted(self.run_start, row, side="right") - 1]
            if made >= self.length:
                mark = np.searchsorted(self.mark_start, row, side="right") - 1
                hit = np.flatnonzero((mark >= 0) & (row < self.mark_end[mark]))
                mark = mark[hit]
                heads.append((lanes[hit], ends[hit] - made, self.mark_place[mark], self.mark_doc[mark]))
        found = [np.concatenate(c) for c in zip(*heads)]
        order = np.lexsort((-found[1], found[0]))  # of each segment, from its last string backward
        seg, where, source, docs = (c[order] for c in found)
        first = self.ends - self.sizes
        last_of = np.concatenate([[True], seg[1:] != seg[:-1]])
        next_where = np.where(np.concatenate([seg[1:] == seg[:-1], [False]]), np.append(where[1:], 0) + 1, first[seg])
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for a, b, s, n in zip(next_where.tolist(), where.tolist(), source.tolist(), (where + self.length - next_where).tolist()):
            if self.text[a : a + n] != self.text[s - (b - a) : s - (b - a) + n]:
                raise RuntimeError("the run index matched strings that differ")
        bounds = np.flatnonzero(last_of)
        for s, e in zip(bounds, [*bounds[1:], len(seg)]):
            starts, d = (next_where[s:e] - first[seg[s]])[::-1], docs[s:e][::-1]
            keep = np.concatenate([[True], d[1:] != d[:-1]])
            out.append((starts[keep], d[keep]))
        return out


def smallest_docs(parts: list[bytes], docs: np.ndarray, length: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each of the different segments, its strings' smallest doc_id as (starts, docs) of runs."""
    return RunIndex(parts, docs, length).matches()


def _pack(x: np.ndarray) -> bytes:
    """Minimizers in 6 bytes each."""
    return np.ascontiguousarray(x, np.uint64).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _joined(column: pa.ChunkedArray) -> np.ndarray:
    return np.sort(np.concatenate([_unpack(x) for x in column.to_pylist()] or [np.zeros(0, np.uint64)]))


def _among(x: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    """Whether the sorted array has each value of x."""
    if not len(sorted_):
        return np.zeros(len(x), bool)
    at = np.searchsorted(sorted_, x)
    at[at == len(sorted_)] = 0
    return sorted_[at] == x


def _digests(part: bytes, length: int) -> list[bytes]:
    digest = xxhash.xxh3_128_digest
    return [digest(part[i : i + length]) for i in range(len(part) - length + 1)]


class _Asked:
    """What a group asks the shards, in an order that its own texts fix: segments, and strings of hot minimizers."""

    def __init__(self, low: dict[bytes, int], shared: np.ndarray, hot: np.ndarray, length: int, shards: int):
        self.places: dict[bytes, tuple[list, list]] = {}  # of each text: (start, stop) of segments, and of hot ones
        doc_of: dict[bytes, int] = {}
        value_of: dict[bytes, int] = {}
        strings: dict[bytes, int] = {}
        for t, doc in low.items():
            start, size, value = segments(np.frombuffer(t, np.uint8), length)
            stop = start + size + length - 1
            hit, burning = _among(value, shared), _among(value, hot)
            plain = list(zip(start[hit].tolist(), stop[hit].tolist()))
            several = list(zip(start[burning].tolist(), stop[burning].tolist()))
            if plain or several:
                self.places[t] = plain, several
            for (s, e), v in zip(plain, value[hit].tolist()):
                part = t[s:e]
                if doc < doc_of.get(part, NONE):
                    doc_of[part] = doc
                    value_of[part] = v
            for s, e in several:
                for x in _digests(t[s:e], length):
                    if doc < strings.get(x, NONE):
                        strings[x] = doc
        value = np.fromiter(value_of.values(), np.uint64, len(value_of))
        content = np.fromiter(map(xxhash.xxh3_64_intdigest, value_of), np.uint64, len(value_of))
        shard = (value % np.uint64(shards)).astype(np.int64)
        order = np.lexsort((content, value, shard))
        texts = list(value_of)
        self.parts, self.shard, self.value = [texts[i] for i in order.tolist()], shard[order], value[order]
        self.doc = np.array([doc_of[t] for t in self.parts], np.int64)
        self.strings = sorted(strings)
        self.string_doc = np.array([strings[x] for x in self.strings], np.int64)
        # Digests are spread evenly, so equal ranges of their first 4 bytes are the shards, in order.
        first = np.array([int.from_bytes(x[:4], "big") for x in self.strings], np.int64)
        self.string_shard = first * shards >> 32

    def rows(self, keys: np.ndarray, own: int) -> pa.Table:
        """One packed row for each shard and kind (0: segments, 1: strings)."""
        cols: dict[str, list] = {k: [] for k in ("shard", "g", "kind", "h", "doc", "size", "text")}
        for kind, shard in enumerate((self.shard, self.string_shard)):
            where = np.unique(shard)
            cuts = np.searchsorted(shard, np.append(where, NONE))
            for w, s, e in zip(where.tolist(), cuts.tolist(), cuts[1:].tolist()):
                parts = self.strings[s:e] if kind else self.parts[s:e]
                row = (
                    int(keys[w]), own, kind,
                    b"" if kind else _pack(self.value[s:e]),
                    (self.string_doc if kind else self.doc)[s:e].tobytes(),
                    b"" if kind else np.array([len(t) for t in parts], np.int32).tobytes(),
                    b"".join(parts) if kind else _ZSTD.compress(b"".join(parts), asbytes=True),
                )
                for c, v in zip(cols.values(), row):
                    c.append(v)
        kinds = (pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 4)
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(cols.items(), kinds)})


def _answer_strings(rows: list[dict]) -> list[tuple[bytes, bytes]]:
    docs = [np.frombuffer(r["doc"], np.int64) for r in rows]
    digest = np.concatenate([np.frombuffer(r["text"], "S16") for r in rows])
    # numpy compares S16 without trailing zeros, which cannot make two digests of 16 bytes alike.
    _, which = np.unique(digest, return_inverse=True)
    low = np.full(which.max() + 1, NONE)
    np.minimum.at(low, which, np.concatenate(docs))
    cuts = np.cumsum([0, *map(len, docs)])
    return [(low[which[s:e]].tobytes(), b"") for s, e in zip(cuts, cuts[1:])]


def _answer_segments(rows: list[dict], length: int) -> list[tuple[bytes, bytes]]:
    """For each row the smallest document of each segment, NONE for segments of several, and the runs of those."""
    found: dict[bytes, int] = {}
    low: list[int] = []
    value: list[int] = []
    which: list[list[int]] = []
    for r in rows:
        at, own, sizes = 0, [], np.frombuffer(r["size"], np.int32)
        text = _ZSTD.decompress(r["text"], int(sizes.sum(dtype=np.int64)), asbytes=True)
        for v, size, doc in zip(_unpack(r["h"]).tolist(), sizes.tolist(), np.frombuffer(r["doc"], np.int64).tolist()):
            part = text[at : at + size]
            at += size
            k = found.setdefault(part, len(found))
            if k == len(low):
                low.append(doc)
                value.append(v)
            elif doc < low[k]:
                low[k] = doc
            own.append(k)
        which.append(own)
    parts, of, docs = list(found), np.array(value, np.uint64), np.array(low, np.int64)
    _, group, count = np.unique(of, return_inverse=True, return_counts=True)
    mixed = np.flatnonzero(count[group] > 1)
    mixed = mixed[np.argsort(group[mixed], kind="stable")]
    runs: dict[int, np.ndarray] = {}
    at = 0
    while at < len(mixed):
        batch, held = [], 0
        while at < len(mixed) and (held < INDEX_BYTES or group[mixed[at]] == group[batch[-1]]):
            batch.append(int(mixed[at]))
            held += len(parts[batch[-1]])
            at += 1
        for k, (starts, each) in zip(batch, smallest_docs([parts[k] for k in batch], docs[batch], length)):
            if len(each) > 1:
                runs[k] = np.column_stack([starts, each])
            docs[k] = each[0] if len(each) == 1 else NONE
    out = []
    for own in which:
        mine = [np.column_stack([np.full(len(runs[k]), i), runs[k]]).ravel() for i, k in enumerate(own) if k in runs]
        out.append((docs[own].tobytes(), np.concatenate(mine).astype(np.int64).tobytes() if mine else b""))
    return out


def _covered(t: bytes, doc_id: int, length: int, places: tuple[list, list], answers: dict, strings: dict[bytes, int]) -> np.ndarray:
    """Which bytes of a text strings of smaller documents cover."""
    cover = np.zeros(len(t) + 1, np.int32)
    first, last = [], []
    for s, e in places[0]:
        found = answers[t[s:e]]
        if isinstance(found, int):
            if found < doc_id:
                first.append(s)
                last.append(e)
            continue
        for (a, d), b in zip(found, [*(x[0] for x in found[1:]), e - s - length + 1]):
            if d < doc_id:
                first.append(s + a)
                last.append(s + b + length - 1)
    for s, e in places[1]:
        for i, x in enumerate(_digests(t[s:e], length), s):
            if strings[x] < doc_id:
                first.append(i)
                last.append(i + length)
    np.add.at(cover, np.array(first, np.int64), 1)
    np.add.at(cover, np.array(last, np.int64), -1)
    return np.cumsum(cover[:-1]) > 0


def _run(docs: DataFrame, length: int, hot: int, mark_rows, schema: str) -> DataFrame:
    """Deals docs, finds the covered bytes of each row, and gives mark_rows(group's table, covered) for each group."""
    spark = docs.sparkSession
    n = partitions(spark)
    keys = deal_keys(n)
    doc, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    # Null ids all hash alike; they take no part, so they are spread by their text.
    which = F.when(doc.isNull(), F.pmod(F.xxhash64(text), F.lit(n))).otherwise(F.pmod(F.xxhash64(doc), F.lit(n))).cast("int")
    own = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")]
    dealt, table = bucketed(docs.select(F.element_at(F.array(*[F.lit(int(k)) for k in keys]), which + 1).alias("g"), doc.alias("doc"), text.alias("text"), *own), "texts", n, "g")

    def low_of(g: pa.Table) -> dict[bytes, int]:
        """Distinct texts of a group with their smallest doc_id."""
        low: dict[bytes, int] = {}
        for doc_id, t in zip(g.column("doc").to_pylist(), g.column("text").cast(pa.large_binary()).to_pylist()):
            if doc_id is not None and t and doc_id < low.get(t, NONE):
                low[t] = doc_id
        return low

    def send_minimizers(g: pa.Table) -> pa.Table:
        each = [np.unique(segments(np.frombuffer(t, np.uint8), length)[2]) for t in low_of(g)] or [np.zeros(0, np.uint64)]
        h, count = np.unique(np.concatenate(each), return_counts=True)
        shard = (h % np.uint64(n)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        h, count = h[order], count[order]
        where = np.unique(shard)
        cuts = np.searchsorted(shard[order], np.append(where, n)).tolist()
        many = [np.column_stack([m := np.flatnonzero(count[s:e] > 1), count[s:e][m]]).astype(np.int32).tobytes() for s, e in zip(cuts, cuts[1:])]
        mine = int(g.column("g")[0].as_py())
        return pa.table({"shard": pa.array(keys[where], pa.int32()), "g": pa.array([mine] * len(where), pa.int32()), "h": pa.array([_pack(h[s:e]) for s, e in zip(cuts, cuts[1:])], pa.binary()), "many": pa.array(many, pa.binary())})

    def answer_shared(rows: pa.Table) -> pa.Table:
        hs = [_unpack(x) for x in rows.column("h").to_pylist()]
        value, inverse, count = np.unique(np.concatenate(hs), return_inverse=True, return_counts=True)
        cuts = np.cumsum([0, *map(len, hs)])
        for s, raw in zip(cuts.tolist(), rows.column("many").to_pylist()):
            at, more = np.frombuffer(raw, np.int32).reshape(-1, 2).astype(np.int64).T
            np.add.at(count, inverse[s + at], more - 1)
        of = count[inverse]
        out = [[_pack(x[keep[s:e]]) for x, s, e in zip(hs, cuts, cuts[1:])] for keep in ((of > 1) & (of <= hot), of > hot)]
        return pa.table({"g": rows.column("g").cast(pa.int32()), "h": pa.array(out[0], pa.binary()), "hot": pa.array(out[1], pa.binary())})

    packed = dealt.select("g", "doc", "text").groupBy("g").applyInArrow(send_minimizers, "shard int, g int, h binary, many binary").groupBy("shard").applyInArrow(answer_shared, "g int, h binary, hot binary")
    shared, shared_at = materialize(packed.where("length(h) > 0 or length(hot) > 0"), "minimizers")

    def send(g: pa.Table, rows: pa.Table) -> pa.Table:
        some = g.num_rows and rows.num_rows
        asked = _Asked(low_of(g) if some else {}, _joined(rows.column("h")), _joined(rows.column("hot")), length, n)
        return asked.rows(keys, int(g.column("g")[0].as_py()) if some else 0)

    def answer(rows: pa.Table) -> pa.Table:
        got = rows.to_pylist()
        out: list[dict] = []
        for kind, answered in ((0, lambda r: _answer_segments(r, length)), (1, _answer_strings)):
            asked = [r for r in got if r["kind"] == kind]
            out += [{"g": r["g"], "shard": r["shard"], "kind": kind, "low": low, "runs": runs} for r, (low, runs) in zip(asked, answered(asked) if asked else [])]
        return pa.Table.from_pylist(out, pa.schema([("g", pa.int32()), ("shard", pa.int32()), ("kind", pa.int32()), ("low", pa.binary()), ("runs", pa.binary())]))

    answers, answers_at = materialize(
        dealt.select("g", "doc", "text")
        .groupBy("g")
        .cogroup(shared.groupBy("g"))
        .applyInArrow(send, "shard int, g int, kind int, h binary, doc binary, size binary, text binary")
        .groupBy("shard")
        .applyInArrow(answer, "g int, shard int, kind int, low binary, runs binary"),
        "segments",
    )
    none = F.lit(None).cast("binary")
    both = shared.select("g", "h", "hot", F.lit(None).cast("int").alias("shard"), F.lit(-1).alias("kind"), none.alias("low"), none.alias("runs")).unionByName(
        answers.select("g", none.alias("h"), none.alias("hot"), "shard", "kind", "low", "runs")
    )
    rank = {int(k): i for i, k in enumerate(keys)}

    def mark(g: pa.Table, rows: pa.Table) -> pa.Table:
        found: dict[bytes, object] = {}
        strings: dict[bytes, int] = {}
        got = rows.to_pylist()
        shared_h, hot_h = (np.sort(np.concatenate([_unpack(r[c]) for r in got if r["kind"] < 0] or [np.zeros(0, np.uint64)])) for c in ("h", "hot"))
        low, places = low_of(g), {}
        if got and g.num_rows:
            asked = _Asked(low, shared_h, hot_h, length, n)
            places = asked.places
            at = [0, 0]
            for r in sorted((r for r in got if r["kind"] >= 0), key=lambda r: (r["kind"], rank[r["shard"]])):
                docs_, mixed, kind = np.frombuffer(r["low"], np.int64).tolist(), {}, r["kind"]
                for i, s, d in np.frombuffer(r["runs"], np.int64).reshape(-1, 3).tolist():
                    mixed.setdefault(i, []).append((s, d))
                names, table = ((asked.parts, found), (asked.strings, strings))[kind]
                for i, d in enumerate(docs_):
                    table[names[at[kind] + i]] = mixed[i] if d == NONE else d
                at[kind] += len(docs_)
        done: dict[bytes, np.ndarray] = {}

        def covered(doc_id: int | None, t: bytes) -> np.ndarray:
            if doc_id is None or len(t) < length:
                return np.zeros(len(t), bool)
            if doc_id > low[t]:  # a copy of a smaller document's text
                return np.ones(len(t), bool)
            if t not in places:
                return np.zeros(len(t), bool)
            if t not in done:
                done[t] = _covered(t, doc_id, length, places[t], found, strings)
            return done[t]

        return mark_rows(g, covered)

    out, out_at = materialize(dealt.groupBy("g").cogroup(both.groupBy("g")).applyInArrow(mark, schema), "cut-texts")
    spark.sql(f"DROP TABLE {table[0]}")
    for path in (table[1], shared_at, answers_at):
        release(spark, path)
    return out


def _rows(g: pa.Table, covered) -> list[tuple]:
    """(bytes, removed, spans, kept bytes) of each row."""
    out = []
    for doc_id, t in zip(g.column("doc").to_pylist(), g.column("text").cast(pa.large_binary()).to_pylist()):
        t = t or b""
        gone = covered(doc_id, t)
        removed = int(gone.sum())
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0]) if removed else 0
        out.append((len(t), removed, spans, np.frombuffer(t, np.uint8)[~gone].tobytes() if removed else t))
    return out


def dedup(docs: DataFrame, length: int = 50, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256): one row per row of docs, repeated rows included.

    Texts are UTF-8 bytes, null is empty; texts shorter than `length` stay whole. Rows with equal doc_id do not remove
    each other's text; rows with a null doc_id neither remove nor lose anything. Other columns are ignored; an empty
    table gives no rows.
    """

    def mark(g: pa.Table, covered) -> pa.Table:
        rows = _rows(g, covered)
        cols = list(zip(*[(*r[:3], hashlib.sha256(r[3]).hexdigest()) for r in rows])) or [()] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.table([g.column("doc"), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _run(docs.select("doc_id", "text"), length, hot, mark, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def drop_repeats(docs: DataFrame, length: int = 50, hot: int = HOT) -> DataFrame:
    """The rows of docs with such bytes cut out of `text`; rows of which no word is left go, unless they had none.

    Every row keeps its own columns (doc_id as a long), whatever their names and however often its doc_id is repeated. A character that
    loses a part of its bytes is lost. Rows that lose nothing keep their text as it is, null included. Rows with equal
    doc_id do not cut each other; rows without doc_id stay; an empty table gives an empty table.
    """
    names, at = docs.columns, docs.columns.index("text")

    def mark(g: pa.Table, covered) -> pa.Table:
        rows = _rows(g, covered)
        cut = [kept.decode("utf-8", "ignore") if removed else None for _, removed, _, kept in rows]
        keep = pa.array([c is None or bool(c.strip(" \t\n\v\f\r")) for c in cut], pa.bool_())
        cols = [g.column("doc" if name == "doc_id" else "text" if name == "text" else f"c{i}") for i, name in enumerate(names)]
        cols[at] = pa.array([w if c is None else c for w, c in zip(cols[at].to_pylist(), cut)], pa.string())
        return pa.table(cols, names=[f"c{i}" for i in range(len(names))]).filter(keep)

    schema = ", ".join(f"c{i} {'long' if f.name == 'doc_id' else 'string' if i == at else f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))
    return _run(docs, length, hot, mark, schema).toDF(*names)
