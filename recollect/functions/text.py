"""Text functions: entropy, chunks, keywords, byte cuts and vectors."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of the episode categories, of the error rule and of a session's last mood.
KEYWORDS = {
    "bug": ("root cause", "fix", "traceback", "exception"),
    "decision": ("switched from", "chose", "decided", "went with"),
    "convention": ("always use", "never use", "rule", "convention"),
    "learning": ("discovered", "til", "turns out", "reason is"),
}
ERROR, ERROR_CONTEXT = "error", ("fix", "bug", "issue")
POSITIVE = ("thanks", "great", "perfect", "works", "awesome", "good", "nice")
NEGATIVE = ("wrong", "broken", "revert", "undo", "doesn't work", "failed")


def token_entropy(token: Column) -> Column:
    """Entropy of an ASCII token's characters, as an expression."""
    chars = F.filter(F.split(token, ""), lambda x: x != "")
    n = F.size(chars).cast("double")
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda s, x: s - (F.size(F.filter(chars, lambda y: y == x)) / n) * F.log2(F.size(F.filter(chars, lambda y: y == x)) / n))


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))


def keywords(user: Column, assistant: Column, stderr: Column) -> Column:
    """map<category, words met> of a turn; tool output is left out, and `error` counts for bugs only in stderr or beside
    a word of ERROR_CONTEXT in the assistant's text."""
    said, err = F.lower(F.coalesce(assistant, F.lit(""))), F.lower(F.coalesce(stderr, F.lit("")))
    low = F.concat_ws("\n", F.lower(F.coalesce(user, F.lit(""))), said, err)
    error = F.contains(err, F.lit(ERROR)) | (F.contains(said, F.lit(ERROR)) & has_any(said, ERROR_CONTEXT))
    out = []
    for name, words in KEYWORDS.items():
        met = [F.when(F.contains(low, F.lit(w)), F.lit(w)) for w in words] + ([F.when(error, F.lit(ERROR))] if name == "bug" else [])
        out += [F.lit(name), F.array_compact(F.array(*met))]
    return F.map_filter(F.create_map(*out), lambda _, v: F.size(v) > 0)


def mood(text: Column) -> Column:
    """positive, negative or neutral; a positive word goes before a negative one."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(has_any(low, POSITIVE), "positive").when(has_any(low, NEGATIVE), "negative").otherwise("neutral")


def cut_bytes(text: str, most: int, mark: str = "") -> str:
    """The first `most` bytes, cut between characters; `mark` is added if something was cut."""
    raw = text.encode()
    return text if len(raw) <= most else raw[:most].decode("utf-8", "ignore") + mark


def promoted_content(tool: Column, text: Column, most: int = 200) -> Column:
    cut = F.pandas_udf(lambda s: s.map(lambda t: t if t is None else cut_bytes(t, most)), "string")
    return F.concat(F.lit("["), tool, F.lit("] "), cut(text))


def chunks(text: Column, words: int = 128) -> Column:
    """Pieces of at most `words` words."""
    w = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    starts = F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0)), F.lit(words))
    return F.when(F.size(w) > 0, F.transform(starts, lambda s: F.array_join(F.slice(w, s + 1, words), " "))).otherwise(F.array().cast("array<string>"))


def pooled(rows: pd.DataFrame) -> list[float]:
    """Weighted mean of vectors (weight, vector), scaled to length one."""
    total = sum(w * pd.Series(v) for w, v in zip(rows["weight"], rows["vector"]))
    norm = math.sqrt(float((total * total).sum())) or 1.0
    return (total / norm).tolist()


def matryoshka(vector: Column, dim: int) -> Column:
    """The first dim components, scaled to length one."""
    head = F.transform(F.slice(vector, 1, dim), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(head, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(head, lambda x: F.round(x / norm, 6))


def backoff_seconds(attempts: Column, most: int = 60) -> Column:
    return F.least(F.pow(F.lit(2.0), F.greatest(attempts - 1, F.lit(0))), F.lit(float(most))).cast("long")


def fact_class(category: Column, outcome: Column) -> Column:
    """struct<fact_type, importance> of an extracted episode."""
    bug = category == "bug"
    kind = F.when((bug & (outcome == "success")) | (category == "convention"), "Procedural").when(bug, "Episodic").otherwise("Semantic")
    prior = F.when(bug, F.when(outcome == "success", 0.7).when(outcome == "failure", 0.4).otherwise(0.5)).when(category == "convention", 0.8).otherwise(0.6)
    return F.struct(kind.alias("fact_type"), prior.alias("importance"))


def note_class(kind: Column) -> Column:
    """struct<fact_type, knowledge> of a note's type: feedback, project, reference, else a lasting fact."""
    low = F.lower(F.coalesce(kind, F.lit("")))
    return F.struct(F.when(low == "feedback", "Procedural").when(low == "project", "Episodic").otherwise("Semantic").alias("fact_type"), (low == "reference").alias("knowledge"))


def file_date(path: Column) -> Column:
    """The first real date in a file's name, parts split by - or _; else null."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")
    parts = F.split(stem, "[-_]")
    at = F.sequence(F.lit(1), F.greatest(F.size(parts) - 2, F.lit(1)))
    made = F.transform(at, lambda i: F.array_join(F.slice(parts, i, 3), "-"))
    shaped = F.filter(made, lambda d: F.regexp_like(d, F.lit(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$")) & F.try_to_timestamp(d, F.lit("yyyy-MM-dd")).isNotNull())
    return F.to_date(F.get(shaped, F.lit(0)))
