"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE_WORDS words, each encoded by character and word statistics. Gated attention
gives every passage a weight, the weighted sum represents the document, and a logistic unit scores it. The weights are
learnt from document labels only. Training reads a bounded sample of the labelled rows, every passage of each: TRAIN_ROWS
documents in a seeded order, as far as they have TRAIN_PASSAGES passages together. Scoring streams whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.llm._runtime import map_arrow

PASSAGE_WORDS = 64
TRAIN_ROWS = 4000  # labelled documents that are learnt from, at most
TRAIN_PASSAGES = 400_000  # and their passages, which the driver holds
SEEN = 256  # passages back in which a word counts as seen before
_KINDS = np.full(256, 15, np.int64)
for _n, _chars in enumerate([b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".", b",", b"|", b"%", b"$", b"#", b"&*", b"<>/\\", b"@:=_-", b"\"'()[]{}!?;"]):
    _KINDS[list(_chars)] = _n
_KINDS[128:] = 0
WIDTH = 16 + 7


def passages(text: str) -> np.ndarray:
    """A row of WIDTH statistics per passage; a text without words is one row of zeros."""
    words = text.encode("utf-8", "replace").split(b" ")
    out = []
    last: dict[bytes, int] = {}  # the passage that had a word last
    for n, at in enumerate(range(0, len(words), PASSAGE_WORDS)):
        part = words[at : at + PASSAGE_WORDS]
        raw = b" ".join(part)
        if not raw:
            continue
        kinds = np.bincount(_KINDS[np.frombuffer(raw, np.uint8)], minlength=16) / len(raw)
        distinct = set(part)
        again = sum(a == b for a, b in zip(part, part[1:])) / len(part)
        old = sum(last.get(w, -SEEN) > n - SEEN for w in distinct) / len(distinct)
        lines = raw.split(b"\n")
        out.append([*np.sqrt(kinds), len(distinct) / len(part), again, old, min(len(raw) / len(part) / 16, 4), 1 - len(set(lines)) / len(lines), np.log1p(len(part)) / 4, sum(not w[-1:].isalpha() for w in part) / len(part)])
        last.update(dict.fromkeys(distinct, n))
        if len(last) > 4 * SEEN * PASSAGE_WORDS:  # forget what is too far back to count
            last = {w: k for w, k in last.items() if k > n - SEEN}
    return np.array(out or [[0.0] * WIDTH])


@dataclass
class Model:
    """mean, scale: of the inputs; v, u, a: gated attention; w, b: the classifier on the weighted passage."""

    mean: np.ndarray
    scale: np.ndarray
    e: np.ndarray
    v: np.ndarray
    u: np.ndarray
    a: np.ndarray
    w: np.ndarray
    b: float

    def score(self, bag: np.ndarray) -> float:
        logit = forward([self.e, self.v, self.u, self.a, self.w, np.array([self.b])], (bag - self.mean) / self.scale)
        return float(1 / (1 + np.exp(-np.clip(logit, -30, 30))))


def start(hidden: int, bias: float, rng: np.random.Generator) -> list[np.ndarray]:
    """First values of e, v, u, a, w and b."""
    return [rng.normal(0, 0.3, s) for s in ((WIDTH, hidden), (hidden, hidden), (hidden, hidden), (hidden,), (hidden,))] + [np.array([bias])]


def forward(p: list[np.ndarray], bag: np.ndarray) -> float:
    """The logit of one bag of scaled passages."""
    e, v, u, a, w, b = p
    h = np.tanh(bag @ e)
    s = (np.tanh(h @ v) / (1 + np.exp(-(h @ u)))) @ a
    k = np.exp(s - s.max())
    return float((k / k.sum()) @ h @ w + b[0])


def gradient(p: list[np.ndarray], bags: list[np.ndarray], labels: np.ndarray) -> list[np.ndarray]:
    """Of the mean log loss by the parameters, all bags at once."""
    n = np.array([len(x) for x in bags])
    first = np.cumsum(n) - n
    of = np.repeat(np.arange(len(bags)), n)
    x = np.concatenate(bags)
    e, v, u, a, w, b = p
    h = np.tanh(x @ e)
    f, g = np.tanh(h @ v), 1 / (1 + np.exp(-(h @ u)))
    s = (f * g) @ a
    k = np.exp(s - np.maximum.reduceat(s, first)[of])
    k /= np.add.reduceat(k, first)[of]
    z = np.add.reduceat(k[:, None] * h, first)
    d = (1 / (1 + np.exp(-(z @ w + b[0]))) - labels) / len(bags)
    dz = d[:, None] * w
    dk = (dz[of] * h).sum(axis=1)
    ds = k * (dk - np.add.reduceat(k * dk, first)[of])
    df, dg = ds[:, None] * a * g * (1 - f * f), ds[:, None] * a * f * g * (1 - g)
    dh = k[:, None] * dz[of] + df @ v.T + dg @ u.T
    return [x.T @ (dh * (1 - h * h)), h.T @ df, h.T @ dg, (f * g).T @ ds, z.T @ d, np.array([d.sum()])]


def train(bags: list[np.ndarray], labels: np.ndarray, hidden: int = 24, epochs: int = 40, seed: int = 3) -> Model:
    """Adam on the mean log loss. Without labels of both kinds the model scores their mean (0.5 without any)."""
    rng = np.random.default_rng(seed)
    flat = np.concatenate(bags) if bags else np.zeros((1, WIDTH))
    mean, scale = flat.mean(axis=0), flat.std(axis=0) + 1e-3
    share = float(np.clip(labels.mean(), 0.02, 0.98)) if len(labels) else 0.5
    p = start(hidden, float(np.log(share / (1 - share))), rng)
    if len(set(labels.tolist())) < 2:
        p[4][:] = 0
        return Model(mean, scale, *p[:5], float(p[5][0]))
    scaled = [(x - mean) / scale for x in bags]
    m, q, t = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p], 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), 64):
            rows = order[at : at + 64]
            t += 1
            for i, grad in enumerate(gradient(p, [scaled[r] for r in rows], labels[rows])):
                grad = grad + 1e-4 * p[i]
                m[i] = 0.9 * m[i] + 0.1 * grad
                q[i] = 0.999 * q[i] + 0.001 * grad * grad
                p[i] = p[i] - 0.01 * (0.97**epoch) * (m[i] / (1 - 0.9**t)) / (np.sqrt(q[i] / (1 - 0.999**t)) + 1e-8)
    return Model(mean, scale, *p[:5], float(p[5][0]))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, most: int = TRAIN_PASSAGES) -> Model:
    """Learns from `rows` labelled documents outside the held-out fold and `most` passages, at most.

    They are the first by a seeded hash of the id that docs has, each whole and with all its passages; a document that
    would go beyond `most` is passed over. Repeated rows are learnt from once. Ids with several labels count as good if
    one is.
    """
    taught = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = taught.select(F.col("doc_id").cast("long").alias("_doc"), F.col("quality").cast("long").alias("quality"), F.xxhash64(F.lit("quality"), "doc_id").alias("_order")).orderBy("_order", "_doc").limit(rows)
    own = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "_doc")  # `rows` ids at most
    own = own.withColumn("_text", F.xxhash64("text"))
    blanks = F.length("text") - F.length(F.replace("text", F.lit(" ")))
    sizes = own.groupBy("_order", "_doc", "_text").agg(F.max(F.floor(blanks / PASSAGE_WORDS) + 1).alias("n")).orderBy("_order", "_doc", "_text").limit(rows).collect()
    held, keys = 0, []
    for r in sizes:
        if held + r.n <= most:
            held += r.n
            keys.append((r._doc, r._text))
    if not keys:
        return train([], np.zeros(0))
    picked = F.broadcast(docs.sparkSession.createDataFrame(keys, "_doc long, _text long"))  # `rows` keys at most
    texts = own.join(picked, ["_doc", "_text"], "left_semi").dropDuplicates(["_doc", "_text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, quality, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                yield pa.record_batch([pa.array([doc_id]), pa.array([quality]), pa.array([passages(text.as_py()).astype(np.float32).tobytes()])], ["doc_id", "quality", "bag"])

    got = map_arrow(texts.select("_doc", "quality", "text"), run, "doc_id long, quality long, bag binary").collect()
    got = sorted(got, key=lambda r: (r.doc_id, bytes(r.bag)))
    return train([np.frombuffer(r.bag, np.float32).reshape(-1, WIDTH).astype(float) for r in got], np.array([r.quality for r in got], float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score): of each whole text; null and empty texts are a bag of one zero passage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(passages(t.as_py() or "")) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return map_arrow(docs.select("doc_id", F.col("text").cast("string").alias("text")), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def keep(docs: DataFrame, model: Model, threshold: float) -> DataFrame:
    """The rows of docs that score at least the threshold, with their own columns, whatever the names.

    Rows are judged by their own text, repeated rows alike; null and empty texts by the score of an empty one.
    """
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([model.score(passages(t.as_py() or "")) >= threshold for t in batch.column(at)], pa.bool_()))

    return map_arrow(docs, run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row per row of docs; labels of unknown ids are ignored.

    Repeated rows are scored alike; null ids are never held out; an empty table gives no rows. labels, lang, source
    and doc_id are no inputs of a score. Other columns are ignored.
    """
    model = fit(docs, labels)
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
