"""Composite filters of facts and events, and the size limits of what is stored."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.operators import facts as fa
from recollect.operators.ingest import MAX_PAYLOAD

c = F.col


@dataclass(frozen=True)
class FactFilter:
    """What facts must all be; parts that are None or empty do not filter.

    time: active, all, as of an instant, due by an instant, or over a period (start, end). absent, present, equals: of
    metadata keys. ids and scopes may be tables (id), then they are joined.
    """

    time: str = "active"
    instant: Column | None = None
    period: tuple[Column, Column] | None = None
    fact_types: tuple[str, ...] = ()
    scopes: tuple[int, ...] | DataFrame | None = None
    ids: tuple[int, ...] | DataFrame | None = None
    pinned: bool | None = None
    has_vector: bool | None = None
    absent: tuple[str, ...] = ()
    present: tuple[str, ...] = ()
    equals: dict[str, str] = field(default_factory=dict)

    def condition(self) -> Column:
        """The part that is an expression of a fact's own columns, and so reaches the scan."""
        at = {
            "active": lambda: fa.active(),
            "all": lambda: F.lit(True),
            "as_of": lambda: fa.as_of(self.instant),
            "due": lambda: fa.due(self.instant),
            "period": lambda: fa.overlaps(*self.period),
        }[self.time]()
        tests = [at]
        if self.fact_types:
            tests.append(c("fact_type").isin(*self.fact_types))
        for column, values in (("scope_id", self.scopes), ("id", self.ids)):
            if values is not None and not isinstance(values, DataFrame):
                tests.append(c(column).isin(*values) if values else F.lit(False))
        if self.pinned is not None:
            tests.append(c("is_pinned") == F.lit(self.pinned))
        if self.has_vector is not None:
            tests.append(fa.has_vector() == F.lit(self.has_vector))
        tests += [fa.key_absent(k) for k in self.absent] + [fa.key_present(k) for k in self.present] + [fa.key_equals(k, v) for k, v in self.equals.items()]
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out

    def apply(self, facts: DataFrame) -> DataFrame:
        out = facts.where(self.condition())
        for column, values in (("scope_id", self.scopes), ("id", self.ids)):
            if isinstance(values, DataFrame):
                out = out.join(values.select(c("id").alias(column)).distinct(), column, "left_semi").select(*facts.columns)
        return out


@dataclass(frozen=True)
class EventFilter:
    """What events must all be, their order (id or timestamp, ties by id) and how many."""

    event_types: tuple[str, ...] = ()
    sessions: tuple[str, ...] = ()
    scopes: tuple[int, ...] = ()
    since: Column | None = None
    until: Column | None = None
    after_id: int | None = None
    order: str = "id"
    descending: bool = False
    limit: int | None = None

    def apply(self, events: DataFrame) -> DataFrame:
        for column, values in (("event_type", self.event_types), ("session_id", self.sessions), ("scope_id", self.scopes)):
            if values:
                events = events.where(c(column).isin(*values))
        if self.since is not None:
            events = events.where(c("timestamp") >= self.since)
        if self.until is not None:
            events = events.where(c("timestamp") < self.until)
        if self.after_id is not None:
            events = events.where(c("id") > self.after_id)
        if self.order not in ("id", "timestamp"):
            raise ValueError(f"no order by {self.order}")
        keys = [c(k).desc() if self.descending else c(k).asc() for k in dict.fromkeys((self.order, "id"))]
        return events.orderBy(*keys).limit(self.limit) if self.limit is not None else events.orderBy(*keys)

    def count(self, events: DataFrame) -> DataFrame:
        """(n): how many events pass, whatever the limit."""
        return EventFilter(self.event_types, self.sessions, self.scopes, self.since, self.until, self.after_id).apply(events).agg(F.count(F.lit(1)).alias("n"))


def replay(events: DataFrame, which: EventFilter, upcasters) -> DataFrame:
    """The events that pass, in order, their payloads brought to the latest revision."""
    revised = events if "event_revision" in events.columns else events.withColumn("event_revision", F.lit(1))
    return which.apply(upcasters.apply(revised))


def over_limit(table: DataFrame, columns: dict[str, int] | None = None) -> DataFrame:
    """(id, field, bytes) of texts and JSON that are longer than their limit in UTF-8 bytes, 1 MiB if none is given."""
    limits = columns or {n: MAX_PAYLOAD for n in ("content", "metadata", "payload") if n in table.columns}
    sizes = F.array(*[F.struct(F.lit(n).alias("field"), F.octet_length(n).alias("bytes"), F.lit(most).alias("most")) for n, most in limits.items()])
    return table.select("id", F.inline(sizes)).where("bytes > most").select("id", "field", "bytes")
