"""Chat formatting by prefix-target expansion.

A conversation is formatted once, turn after turn, with marks around each turn. Control strings inside roles and texts
are broken by an escape character, reversibly, so no text can open or close a turn. Every assistant turn then becomes a
training example of its own: its context is the formatted conversation before its reply, and only the reply is
trainable. Examples refer to the shared formatted conversation by character offsets, so a conversation of n turns takes
n segments and not n * n / 2; `example_texts` writes them out where a trainer needs plain text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.llm._runtime import map_arrow, partitions

# The marks of this template, and control strings of common chat templates.
OPEN, MIDDLE, CLOSE = "<|turn|>", "<|text|>", "<|end|>"
CONTROL = (
    OPEN, MIDDLE, CLOSE, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
    "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>",
    "<|begin_of_text|>", "<|eot_id|>", "<|start_header_id|>", "<|end_header_id|>",
)
ESC = "␛"

_INSIDE = "(?<=[<\\[])(?=(?:" + "|".join(re.escape(c[1:]) for c in CONTROL) + "))"
_PART = re.compile(f"{re.escape(OPEN)}(.*?){re.escape(MIDDLE)}(.*?){re.escape(CLOSE)}", re.DOTALL)


def escape(text: Column) -> Column:
    """Doubles the escape character, then puts one behind the first character of each control string."""
    return F.regexp_replace(F.replace(text, F.lit(ESC), F.lit(ESC + ESC)), _INSIDE, ESC)


def unescape(text: str) -> str:
    return re.sub(f"{ESC}({ESC}?)", r"\1", text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation or a part of it."""
    return [(unescape(r), unescape(t)) for r, t in _PART.findall(formatted)]


def segments(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, trainable, head, body): the formatted turns; head + body + CLOSE is a turn's part.

    Null texts and roles are empty. Rows with null conv_id form one conversation; null turns come first; rows with
    equal turn are in the order of role and text; repeated rows are repeated turns. Other columns are ignored.
    """
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    return turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        (role == "assistant").alias("trainable"),
        F.concat(F.lit(OPEN), escape(role), F.lit(MIDDLE)).alias("head"),
        escape(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("body"),
    )


def _in_order(parts: DataFrame) -> DataFrame:
    key = F.struct("conv_id")
    n = partitions(parts.sparkSession)
    return parts.repartition(n, key).sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "head", "body")


def _batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


EXAMPLE = "conv_id long, example long, turn long, context_chars long, loss_start long, loss_end long"
_EXAMPLE = pa.schema([(x.split()[0], pa.int64()) for x in EXAMPLE.split(", ")])


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, str, tuple | None]]:
    """(conv_id, formatted part, example or None): every turn in order, and the example that an assistant turn becomes."""
    last, at, n = object(), 0, 0
    for batch in batches:
        for conv, turn, trainable, head, body in zip(*(c.to_pylist() for c in batch.columns)):
            if conv != last:
                last, at, n = conv, 0, 0
            start = at + len(head)
            yield conv, head + body + CLOSE, (conv, n, turn, start, start, start + len(body)) if trainable else None
            n += trainable
            at = start + len(body) + len(CLOSE)


def examples(parts: DataFrame) -> DataFrame:
    """(conv_id, example, turn, context_chars, loss_start, loss_end): one row per assistant turn of segments.

    Offsets count characters of the formatted conversation: [0, loss_start) is context, [loss_start, loss_end) is the
    trainable reply. A conversation is streamed turn by turn; nothing of it is gathered.
    """
    return map_arrow(_in_order(parts), lambda b: _batched((e for _, _, e in _expand(b) if e), _EXAMPLE), EXAMPLE)


def example_texts(parts: DataFrame, chosen: DataFrame) -> DataFrame:
    """(conv_id, example, context, reply): plain texts of the chosen examples; grows with the square of a conversation."""
    whole = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "head", "body"))).alias("t")).select(
        "conv_id", F.array_join(F.transform("t", lambda x: F.concat(x["head"], x["body"], F.lit(CLOSE))), "").alias("s")
    )
    picked = chosen.join(whole.withColumnRenamed("conv_id", "_c"), F.col("conv_id").eqNullSafe(F.col("_c")))
    return picked.select(
        "conv_id",
        "example",
        F.substring("s", F.lit(1), F.col("loss_start").cast("int")).alias("context"),
        F.substring("s", (F.col("loss_start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int")).alias("reply"),
    )


class _Reader:
    """Reads one formatted conversation back, as its characters come in: turns by the marks, the loss by the masks.

    It sees characters and masks only, not where a part began, so a text that broke a neighbour's marks would show.
    """

    def __init__(self, conv: int | None):
        self.conv, self.n_turns, self.made, self.loss_chars = conv, 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.held, self.base, self.masks = "", 0, []

    def feed(self, chars: str, example: tuple | None) -> None:
        self.held += chars
        if example:
            self.made += 1
            self.masks.append(example[4:])
        done = 0
        while m := _PART.match(self.held, done):
            self.n_turns += 1
            self.turns.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
            done = m.end()
        while self.masks and self.masks[0][1] <= self.base + len(self.held):
            start, end = self.masks.pop(0)
            reply = unescape(self.held[start - self.base : end - self.base])
            self.loss_chars += len(reply)
            self.loss.update(reply.encode())
        self.held, self.base = self.held[done:], self.base + done

    def row(self) -> tuple:
        return self.conv, self.n_turns, self.turns.hexdigest(), self.made, self.loss_chars, self.loss.hexdigest(), self.base + len(self.held)


def read_back(parts: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, n_examples, loss_chars, loss_sha256, formatted_chars), read from the output.

    The conversation is expanded into its examples; turns are parsed out of the formatted characters, and the loss is
    what the examples' masks cover of them. Hashes run along the stream, so a conversation may have any number of turns,
    with one held at a time. An empty table gives no rows.
    """
    schema = pa.schema(
        [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("n_examples", pa.int64()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
    )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        reader = None
        for conv, chars, example in _expand(batches):
            if reader is None or reader.conv != conv:
                if reader:
                    yield reader.row()
                reader = _Reader(conv)
            reader.feed(chars, example)
        if reader:
            yield reader.row()

    return map_arrow(_in_order(parts), lambda b: _batched(rows(b), schema), "conv_id long, n_turns long, turns_sha256 string, n_examples long, loss_chars long, loss_sha256 string, formatted_chars long")
