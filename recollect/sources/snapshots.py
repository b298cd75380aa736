"""Snapshots as JSON (plain, gzip, zstd), parquet or SQLite, and archives of expired facts."""

from __future__ import annotations

import json
import os
import sqlite3
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from recollect.operators import facts as fa
from recollect.sources.sessions import archive_manifest

c = F.col
VERSION = 1
CODECS = ("json", "gzip", "zstd")
_TIMES = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
DAYS, LEAST = 30, 100  # facts expired for so long go to an archive, if there are so many
MOST_BYTES = 4 << 30  # of an archive file
MANIFEST = "id string, pak_path string, sha256 string, fact_count long, fact_id_min long, fact_id_max long, t_created_min timestamp_ntz, t_created_max timestamp_ntz"


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _put(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written beside its place and renamed, so that it is there whole or not at all."""
    fs, at = _fs(spark, path)
    draft = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.draft")
    out = fs.create(draft, False)
    out.write(text.encode())
    out.close()
    if fs.exists(at) or not fs.rename(draft, at):
        fs.delete(draft, False)
        raise FileExistsError(path)


def dump(tables: dict[str, DataFrame], path: str, codec: str = "json") -> None:
    """A folder of JSON rows for each table, compressed by the codec, and a head file that is written last.

    Plain and gzip are files of JSON lines. Spark's text files know no zstd without native libraries, so with zstd the
    same JSON rows are the one column of parquet files. Dates keep microseconds. A dump that fails has no head, and no
    restore reads it.
    """
    if codec not in CODECS:
        raise ValueError(f"no codec {codec}")
    spark = next(iter(tables.values())).sparkSession
    for name, table in tables.items():
        rows = table.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false", **_TIMES}).alias("row"))
        if codec == "zstd":
            rows.write.mode("errorifexists").option("compression", "zstd").parquet(f"{path}/{name}")
        else:
            rows.write.mode("errorifexists").option("compression", "gzip" if codec == "gzip" else "none").text(f"{path}/{name}")
    _put(spark, f"{path}/head.json", json.dumps({"version": VERSION, "codec": codec, "tables": {n: t.schema.jsonValue() for n, t in tables.items()}}))


def restore(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a dump, by the schemas of its head; a ValueError without a head or for another version.

    A row that does not fit its schema fails the job.
    """
    fs, at = _fs(spark, f"{path}/head.json")
    if not fs.exists(at):
        raise ValueError(f"{path} is no whole dump")
    head = json.loads(spark.read.text(f"{path}/head.json", wholetext=True).first()[0])
    if head["version"] != VERSION:
        raise ValueError(f"dump version {head['version']}")
    read = spark.read.schema("row string").parquet if head["codec"] == "zstd" else spark.read.schema("row string").text
    return {n: _parsed(read(f"{path}/{n}"), StructType.fromJson(s)) for n, s in head["tables"].items()}


def _parsed(rows: DataFrame, kind: StructType) -> DataFrame:
    return rows.select(F.from_json("row", kind, {"mode": "FAILFAST", **_TIMES}).alias("r")).select("r.*")


def dump_sqlite(tables: dict[str, DataFrame], path: str, rows: int = 10_000) -> None:
    """One SQLite file, streamed a partition at a time through the driver and renamed when it is whole.

    Arrays and structs are JSON, dates ISO texts. Meant for a user's own memory, not for a cluster's tables.
    """
    draft = f"{path}.{uuid.uuid4().hex}.draft"
    try:
        with sqlite3.connect(draft) as db:
            db.execute("CREATE TABLE head (version INTEGER, name TEXT, schema TEXT)")
            for name, table in tables.items():
                db.execute("INSERT INTO head VALUES (?, ?, ?)", (VERSION, name, table.schema.json()))
                db.execute(f'CREATE TABLE "{name}" (row TEXT)')
                batch: list[tuple[str]] = []
                for r in table.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false", **_TIMES}).alias("row")).toLocalIterator(True):
                    batch.append((r.row,))
                    if len(batch) == rows:
                        db.executemany(f'INSERT INTO "{name}" VALUES (?)', batch)
                        batch = []
                db.executemany(f'INSERT INTO "{name}" VALUES (?)', batch)
        db.close()
        os.link(draft, path)  # fails if the path is taken
    finally:
        if os.path.exists(draft):
            os.unlink(draft)


def restore_sqlite(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of dump_sqlite, read through the driver."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        head = db.execute("SELECT version, name, schema FROM head").fetchall()
        if any(v != VERSION for v, _, _ in head):
            raise ValueError(f"dump version {head[0][0]}")
        out = {}
        for _, name, schema in head:
            lines = spark.createDataFrame(db.execute(f'SELECT row FROM "{name}"').fetchall(), "row string")
            out[name] = _parsed(lines, StructType.fromJson(json.loads(schema)))
    return out


# Archives
def archive(facts: DataFrame, edges: DataFrame, tombstones: DataFrame, manifest: DataFrame, folder: str, now: Column, days: int = DAYS, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(facts, edges, manifest) after unpinned facts with vectors that expired `days` ago moved to one archive (.pak).

    Below `least` of them nothing happens. The archive is one zstd parquet folder with its version in each row, and is
    verified by reading it before the facts go; edges of archived facts go with them. What the caller publishes last is
    the returned tables, so a failure leaves an archive that no manifest names.
    """
    spark = facts.sparkSession
    chosen = fa.archive_candidates(facts, tombstones, now - F.make_dt_interval(days=F.lit(days)))
    row = archive_manifest(chosen, least).collect()
    if not row:
        return facts, edges, manifest
    name = f"{uuid.uuid4().hex}.pak"
    chosen.withColumn("pak_version", F.lit(VERSION)).write.option("compression", "zstd").parquet(f"{folder}/{name}")
    back = read_archive(spark, f"{folder}/{name}")
    digest = content_digest(back)
    if back.count() != row[0].fact_count or digest != content_digest(chosen):
        raise RuntimeError(f"archive {name} does not hold what was written")
    line = spark.createDataFrame([(name[:-4], name, digest, *row[0])], MANIFEST)
    gone = back.select("id")
    kept = edges.join(gone.select(c("id").alias("source_fact_id")), "source_fact_id", "left_anti").join(gone.select(c("id").alias("target_fact_id")), "target_fact_id", "left_anti")
    return facts.join(gone, "id", "left_anti").select(*facts.columns), kept.select(*edges.columns), manifest.unionByName(line)


def content_digest(facts: DataFrame) -> str:
    """A digest of a set of facts, whatever their order: SHA-256 of each id and content hash, added up by two halves."""
    h = F.sha2(F.concat_ws("|", "id", "content_hash"), 256)
    part = lambda at: F.sum(F.conv(F.substring(h, at, 14), 16, 10).cast("decimal(38,0)"))
    r = facts.agg(part(1).alias("a"), part(15).alias("b"), F.count(F.lit(1)).alias("n")).first()
    return f"{int(r.a or 0):x}-{int(r.b or 0):x}-{r.n:x}"


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The facts of an archive; a ValueError if a file is over 4 GiB or the version is not known."""
    fs, at = _fs(spark, path)
    if any(s.getLen() > MOST_BYTES for s in fs.listStatus(at)):
        raise ValueError(f"{path} has a file over {MOST_BYTES} bytes")
    rows = spark.read.parquet(path)
    if "pak_version" not in rows.columns or not rows.where(c("pak_version") != VERSION).isEmpty():
        raise ValueError(f"{path} is no archive of version {VERSION}")
    return rows.drop("pak_version")


def verify(spark: SparkSession, manifest: DataFrame, folder: str) -> list[tuple[str, str | None]]:
    """(id, error) of each archive of the manifest: a path that leaves the folder, a missing one, another content."""
    out = []
    for r in manifest.orderBy("id").collect():  # one row an archive
        parts = r.pak_path.replace("\\", "/").split("/")
        if not r.pak_path or r.pak_path.startswith("/") or ".." in parts or ":" in parts[0]:
            out.append((r.id, "path leaves the archive"))
            continue
        fs, at = _fs(spark, f"{folder}/{r.pak_path}")
        if not fs.exists(at):
            out.append((r.id, "not found"))
        else:
            out.append((r.id, None if content_digest(read_archive(spark, f"{folder}/{r.pak_path}")) == r.sha256 else "content differs"))
    return out


def restore_archive(spark: SparkSession, facts: DataFrame, manifest: DataFrame, folder: str, archive_id: str) -> tuple[DataFrame, DataFrame]:
    """(facts, manifest) with an archive's facts back; ids that are there already stay as they are."""
    row = manifest.where(c("id") == archive_id).first()
    if row is None:
        raise ValueError(f"no archive {archive_id}")
    old = read_archive(spark, f"{folder}/{row.pak_path}").join(facts.select("id"), "id", "left_anti")
    return facts.unionByName(old.select(*facts.columns)), manifest.where(c("id") != archive_id)
