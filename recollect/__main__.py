"""python -m recollect FOLDER COMMAND ...: a memory from the shell; each command prints JSON lines."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.operators import facts as fa
from recollect.operators import graph as gr
from recollect.operators import store as st
from recollect.operators.filters import EventFilter
from recollect.plans.memory import Memory
from recollect.sources import bootstrap as bo
from recollect.sources import snapshots as sn

c = F.col


def _show(rows: DataFrame) -> None:
    for line in rows.toJSON().toLocalIterator():
        print(line)


def _say(**what: object) -> None:
    print(json.dumps(what, ensure_ascii=False))


def _bootstrap(m: Memory, path: str, kind: str) -> None:
    base = m.store.version()
    t = {n: m.store.read(n, base) for n in ("facts", "event_log", "tombstones")}
    run = bo.bootstrap_sessions if kind == "sessions" else bo.bootstrap_notes
    facts, events, report = run(m.spark, path, t["facts"], t["event_log"], t["tombstones"], m._now())
    lines = report.toJSON().collect()
    m.store.publish({"facts": facts, "event_log": events}, base)
    print(*lines, sep="\n")


def _restore(m: Memory, path: str, kind: str) -> None:
    m.store.publish(sn.restore_sqlite(m.spark, path) if kind == "sqlite" else sn.restore(m.spark, path))
    _say(version=m.store.version())


COMMANDS = {
    "stats": (lambda m, a: _show(m.statistics()), []),
    "scopes": (lambda m, a: _show(gr.scope_paths(m.store.read("scopes"))), []),
    "graph": (lambda m, a: _show(gr.counts(m.store.read("edges"))), []),
    "get": (lambda m, a: _say(**json.loads(m.store.read("facts").where(c("id") == int(a.id)).toJSON().first() or "{}")), ["id"]),
    "active": (lambda m, a: _show(m.store.read("facts").where(fa.active()).orderBy("id").limit(int(a.limit))), ["limit"]),
    "due": (lambda m, a: _show(m.store.read("facts").where(fa.due(m._now()))), []),
    "events": (lambda m, a: _show(EventFilter(order="timestamp", limit=int(a.limit)).apply(m.store.read("event_log"))), ["limit"]),
    "timeline": (lambda m, a: _show(fa.timeline(m.store.read("facts").where(c("id") == int(a.id)))), ["id"]),
    "lineage": (lambda m, a: _show(gr.lineage_full(m.store.read("lineage"), int(a.id))), ["id"]),
    "queue": (lambda m, a: _show(m.store.read("embed_queue")), []),
    "config": (lambda m, a: _say(value=st.get_config(m.store.read("config"), a.key)), ["key"]),
    "remember": (lambda m, a: _say(results=m.remember([a.text], a.level)), ["text", "level"]),
    "recall": (lambda m, a: _say(results=m.recall(a.text)[0]), ["text"]),
    "forget": (lambda m, a: _say(forgotten=m.forget([int(a.id)], a.reason)), ["id", "reason"]),
    "set-level": (lambda m, a: _say(path=m.set_level(int(a.id), a.level)), ["id", "level"]),
    "bootstrap": (lambda m, a: _bootstrap(m, a.path, a.kind), ["path", "kind"]),
    "dump": (lambda m, a: (sn.dump_sqlite if a.kind == "sqlite" else lambda t, p: sn.dump(t, p, a.kind))({n: m.store.read(n) for n in m.store.tables()}, a.path), ["path", "kind"]),
    "restore": (lambda m, a: _restore(m, a.path, a.kind), ["path", "kind"]),
    "vacuum": (lambda m, a: _say(deleted=m.store.vacuum()), []),
}


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="recollect", description=__doc__)
    parser.add_argument("folder")
    sub = parser.add_subparsers(dest="command", required=True)
    for name, (_, words) in COMMANDS.items():
        one = sub.add_parser(name)
        for w in words:
            one.add_argument(w)
    a = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    store = st.Store(spark, a.folder)
    memory = Memory(store) if store.version() else Memory.create(spark, a.folder)
    COMMANDS[a.command][0](memory, a)


if __name__ == "__main__":
    main()
