"""Lexical, vector and hybrid retrieval as lazy plans.

A text index is written once: postings (term, id, len, positions), sorted by term, so that a search reads the files of its
own terms only, and one row of totals. A search never sees the texts.
"""

from __future__ import annotations

import math
import operator
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions.stems import stems, stems_column
from recollect.operators.shared import materialize, spread

c = F.col
TOKEN = r"[\p{L}\p{N}]+"
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6  # fixed values: the usual constants of BM25 and the floor of a full-text index


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def plain_words(query: str) -> list[str]:
    return re.findall(r"[^\W_]+", query.lower())


def terms(query: str) -> list[str]:
    """Distinct lower-cased words of a query in order."""
    return list(dict.fromkeys(plain_words(query)))


def _weight(n: Column, df: Column) -> Column:
    """BM25 of a phrase that a row has n times and df of N rows have; common phrases keep the least weight."""
    idf = F.log((c("N") - df + 0.5) / (df + 0.5))
    return F.when(idf > 0, idf).otherwise(LEAST_IDF) * n * (K1 + 1) / (n + K1 * (1 - B + B * c("len") / c("avg")))


@dataclass(frozen=True)
class LexicalIndex:
    """postings (term, id, len, positions from 0): a row for each row's term; totals (N, avg): rows and their mean length;
    analyze: the terms of a query's word or phrase."""

    postings: DataFrame
    totals: DataFrame
    analyze: Callable[[str], list[str]]


POSTING = "term string, id long, len int, positions array<int>"


def index_terms(rows: DataFrame, analyze: Callable[[str], list[str]]) -> LexicalIndex:
    """The index of rows (id, terms array), written to the shared folder; rows without terms count in the totals."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.list_(pa.int32()))
        for batch in batches:
            found: list[tuple] = []
            for id_, terms in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at: dict[str, list[int]] = {}
                for i, t in enumerate(terms or ()):
                    at.setdefault(t, []).append(i)
                found.append((None, id_, len(terms or ()), None))
                found += [(t, id_, len(terms), p) for t, p in at.items()]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*found), kinds)], names=["term", "id", "len", "positions"])

    posted = spread(rows.select(c("id").cast("long").alias("id"), "terms")).mapInArrow(post, POSTING)
    # Null terms carry the lengths; they are dealt by id, so that they do not make one range.
    table, _ = materialize(posted.repartitionByRange(F.coalesce("term", F.concat(F.lit("\0"), c("id").cast("string")))).sortWithinPartitions("term", "id"), "postings")
    totals, _ = materialize(table.where("term is null").agg(F.count(F.lit(1)).alias("N"), F.avg("len").alias("avg")), "postings-totals")
    return LexicalIndex(table.where("term is not null"), totals, analyze)


def word_index(facts: DataFrame) -> LexicalIndex:
    """Of the lower-cased words of facts (id, content), expired ones too."""
    return index_terms(facts.select("id", tokens(F.coalesce("content", F.lit(""))).alias("terms")), plain_words)


def lexical_index(facts: DataFrame) -> LexicalIndex:
    """Of the folded and stemmed words of facts (id, content), expired ones too."""
    return index_terms(spread(facts.select("id", "content")).select("id", stems_column(c("content")).alias("terms")), stems)


def bm25(index: LexicalIndex, words: list[str]) -> DataFrame:
    """(id, score): any-word match in a word_index. Statistics are of all rows, expired ones too, so filter afterwards."""
    own = index.postings.where(c("term").isin(*words)).select("term", "id", "len", F.size("positions").alias("times"))
    df = own.groupBy("term").agg(F.count(F.lit(1)).alias("d"))
    met = own.join(F.broadcast(df), "term").crossJoin(F.broadcast(index.totals))  # a row a word of the query, and one row
    return met.groupBy("id").agg(F.sum(_weight(c("times"), c("d"))).alias("score"))


def parse(query: str, analyze: Callable[[str], list[str]] = stems) -> tuple | None:
    """Tree of a full-text query: ("phrase", terms, prefix), ("and" | "or" | "not", left, right); None if it has no word.

    Words side by side all have to match, "..." is a phrase, `+` joins phrases, a trailing `*` makes a prefix; NOT binds
    before AND, AND before OR, brackets group. Bad syntax is a ValueError, and so is NEAR, which is not built.
    """
    marks = [m.groupdict() for m in re.finditer(r'(?P<text>"(?:[^"]|"")*")|(?P<mark>[()*+])|(?P<bare>[\w\x1a]+)|(?P<bad>\S)', query)]
    at = 0

    def peek(kind: str, *values: str) -> bool:
        return at < len(marks) and marks[at][kind] is not None and (not values or marks[at][kind] in values)

    def take() -> str:
        nonlocal at
        at += 1
        return next(v for v in marks[at - 1].values() if v is not None)

    def word() -> list[str]:
        if peek("text"):
            return analyze(take()[1:-1].replace('""', '"'))
        if peek("bare") and not peek("bare", "AND", "OR", "NOT", "NEAR"):
            return analyze(take())
        raise ValueError(f"a word is missing in {query!r}")

    def phrase() -> tuple | None:
        found = word()
        while peek("mark", "+"):
            take()
            found = found + word()
        prefix = peek("mark", "*") and bool(take())
        return ("phrase", found, prefix) if found else None

    def join(kind: str, left: tuple | None, right: tuple | None) -> tuple | None:
        return (kind, left, right) if left and right else left or (right if kind != "not" else None)

    def group() -> tuple | None:
        if peek("mark", "("):
            take()
            out = either()
            if not peek("mark", ")"):
                raise ValueError(f"a bracket is open in {query!r}")
            take()
        else:
            out = phrase()
        while peek("text") or peek("mark", "(") or (peek("bare") and not peek("bare", "AND", "OR", "NOT")):
            out = join("and", out, group())
        return out

    def chain(kind: str, inner: Callable[[], tuple | None]) -> tuple | None:
        out = inner()
        while peek("bare", kind):
            take()
            out = join(kind.lower(), out, inner())
        return out

    def either() -> tuple | None:
        return chain("OR", lambda: chain("AND", lambda: chain("NOT", group)))

    if not marks:
        return None
    out = either()
    if at < len(marks):
        raise ValueError(f"bad syntax in {query!r}")
    return out


def any_word(query: str) -> str:
    """A question as a full-text query: its words, each once, any of which may match."""
    return " OR ".join(f'"{w}"' for w in terms(query))


def _times(words: list[str], prefix: bool) -> Column:
    """How often the positions p0, p1 ... of a phrase's words follow each other; `_places` names them."""
    names = _places(words, prefix)
    here = lambda x: reduce(operator.and_, [F.array_contains(c(n), x + k) for k, n in enumerate(names[1:], 1)], F.lit(True))
    return F.size(F.filter(c(names[0]), here))


def _places(words: list[str], prefix: bool) -> list[str]:
    return [f"{'q' if prefix and i == len(words) - 1 else 'p'}_{w}" for i, w in enumerate(words)]


def lexical_search(index: LexicalIndex, query: str) -> DataFrame:
    """(id, score): rows of a lexical_index that match the query, by BM25 over all rows; bad syntax matches none.

    Only postings of the query's words, or of those that a prefix begins, are read; they meet by id.
    """
    empty = index.postings.select("id", F.lit(0.0).alias("score")).limit(0)
    try:
        tree = parse(query, index.analyze)
    except ValueError:
        if "NEAR" in query:
            raise
        tree = None
    if tree is None:
        return empty
    phrases: list[tuple] = []

    def plan(node: tuple) -> tuple[Column, Column]:
        """(matches, score); a phrase counts only where the expression around it matches."""
        if node[0] == "phrase":
            i = len(phrases)
            phrases.append(node[1:])
            return c(f"n{i}") > 0, F.when(c(f"n{i}") > 0, _weight(c(f"n{i}"), c(f"d{i}"))).otherwise(0.0)
        (a, x), (b, y) = plan(node[1]), plan(node[2])
        hit = {"and": a & b, "or": a | b, "not": a & ~b}[node[0]]
        return hit, x + y if node[0] == "or" else F.when(hit, x if node[0] == "not" else x + y).otherwise(0.0)

    hit, score = plan(tree)
    names = dict.fromkeys(n for words, prefix in phrases for n in _places(words, prefix))
    is_of = {n: c("term").startswith(n[2:]) if n[0] == "q" else c("term") == n[2:] for n in names}
    own = index.postings.where(reduce(operator.or_, is_of.values()))
    by_id = own.groupBy("id").agg(F.max("len").alias("len"), *[F.flatten(F.collect_list(F.when(test, c("positions")))).alias(n) for n, test in is_of.items()])
    counted = by_id.select("id", "len", *[_times(*p).alias(f"n{i}") for i, p in enumerate(phrases)])
    stats = counted.agg(*[F.count_if(c(f"n{i}") > 0).alias(f"d{i}") for i in range(len(phrases))]).crossJoin(index.totals)
    return counted.where(hit).crossJoin(F.broadcast(stats)).select("id", score.alias("score"))  # stats is one row


def cosine(a: Column, b: Column) -> Column:
    """In double; over the shorter length; 0 if a norm is 0."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: F.coalesce(p.cast("double") * q.cast("double"), F.lit(0.0))), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def vector_scores(facts: DataFrame, query: list[float]) -> DataFrame:
    """(id, score): cosine with a query vector that travels as a literal; rows without a vector are left out.

    A vector of another length than the query's fails the job.
    """
    length = math.sqrt(sum(x * x for x in query)) or 1.0
    q = F.array(*[F.lit(x / length) for x in query])
    fits = F.when(F.size("embedding") == len(query), c("embedding")).otherwise(F.raise_error(F.concat(F.lit(f"a vector's length is not {len(query)} but "), F.size("embedding").cast("string"))))
    return facts.where("size(embedding) > 0").select("id", cosine(fits, q).alias("score"))


def ranked(scores: DataFrame, k: int) -> DataFrame:
    """(id, score, rank from 0) of the k best; the rank runs over k rows only."""
    best = scores.select("id", F.round("score", 6).alias("score")).orderBy(c("score").desc(), "id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(c("score").desc(), "id")) - 1)


def fuse(lexical: DataFrame, vector: DataFrame, k: int = 60) -> DataFrame:
    """(id, score, match_type): reciprocal ranks summed over both channels."""
    both = lexical.select("id", "rank", F.lit(1).alias("l"), F.lit(0).alias("v")).unionByName(vector.select("id", "rank", F.lit(0).alias("l"), F.lit(1).alias("v")))
    return both.groupBy("id").agg(
        F.round(F.sum(1.0 / (F.lit(k) + c("rank") + 1)), 6).alias("score"),
        F.when((F.max("l") == 1) & (F.max("v") == 1), "both").when(F.max("l") == 1, "fts").otherwise("vector").alias("match_type"),
    )


def hybrid(facts: DataFrame, index: LexicalIndex, words: list[str], query: list[float], keep: Column, k: int, over: int = 3) -> DataFrame:
    """(id, score, match_type) of the k best. `keep` filters before each channel's limit; the index spans all facts."""
    kept = facts.where(keep).select("id")
    lex = ranked(bm25(index, words).join(kept, "id", "left_semi"), over * k)
    vec = ranked(vector_scores(facts.where(keep), query), over * k)
    return fuse(lex, vec).orderBy(c("score").desc(), "id").limit(k)


def archive_search(archived: DataFrame, text: str, query: list[float], k: int) -> DataFrame:
    """(id, score): 1 for a contained text plus a positive cosine; what is empty adds nothing."""
    has = near = F.lit(0.0)
    if text:
        has = F.when(F.contains(F.lower(F.coalesce("content", F.lit(""))), F.lit(text.lower())), 1.0).otherwise(0.0)
    if query:
        length = math.sqrt(sum(x * x for x in query)) or 1.0
        near = F.when(F.size("embedding") > 0, F.greatest(cosine(c("embedding"), F.array(*[F.lit(x / length) for x in query])), F.lit(0.0))).otherwise(0.0)
    scored = archived.select("id", F.round(has + near, 6).alias("score")).where("score > 0")
    return scored.orderBy(c("score").desc(), "id").limit(k)


def retrieval_metrics(results: DataFrame, relevance: DataFrame, k: int) -> DataFrame:
    """(query_id, precision, recall, rr, ndcg) at k; results (query_id, id, rank from 0), relevance (query_id, id, grade)."""
    rel = relevance.where("grade > 0")
    got = results.where(c("rank") < k).join(rel, ["query_id", "id"])
    gain = lambda rank: (F.pow(F.lit(2.0), c("grade")) - 1) / F.log2(rank + 2)
    hit = got.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"), F.min("rank").alias("first"), F.sum(gain(c("rank"))).alias("dcg"))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(c("grade").desc(), "id")) - 1
    ideal = rel.withColumn("r", order).groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant"), F.sum(F.when(c("r") < k, gain(c("r")))).alias("ideal"))
    zero = lambda x: F.round(F.coalesce(x, F.lit(0.0)), 6)
    return ideal.join(hit, "query_id", "left").select(
        "query_id", zero(c("hits") / k).alias("precision"), zero(c("hits") / c("relevant")).alias("recall"), zero(1.0 / (c("first") + 1)).alias("rr"), zero(c("dcg") / c("ideal")).alias("ndcg")
    )
