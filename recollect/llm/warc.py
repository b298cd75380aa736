"""WARC archives as a PySpark Python data source, read and written.

Reading plans one partition per archive file, largest first. Filters on the record type and on header columns are pushed
into the scan: a record's header lines are parsed first, and where they fail a pushed filter, or where no payload column
is asked for (option `payload` = false), the payload is skipped by its Content-Length without being read or decoded.
Gzip archives (.gz, a member per record) are inflated in bounded blocks and skipped likewise. An archive that ends
within a record raises, with and without payloads, and so does a record without Content-Length. SHA-1 digests may be
base32 or hex; other digests stay as they are written.

Writing publishes at once: files get their final names, but a reader takes only those that a list of a finished write
(`_committed-*`) names, or all where a folder has no list, as with archives of other programs. Paths may be of any file
system that pyarrow opens; Python workers do not reach Hadoop's own file systems.
"""

from __future__ import annotations

import base64
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage

from recollect.llm._runtime import free_shuffles, materialize, release, shared_path

SCHEMA = "record_id string, record_type string, target_uri string, page_id long, payload_digest string, payload_length long, refers_to long, payload binary"
HEADERS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "page_id": "X-Page-ID", "payload_digest": "WARC-Payload-Digest", "payload_length": "X-Payload-Length", "refers_to": "X-Refers-To-Page-ID"}
BLOCK, FEED = 1 << 20, 1 << 14  # bytes read, and inflated, at a time
ROLL = 256 << 20  # bytes after which a writer starts the next archive
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else path.replace("file:/", "file:///", 1) if path.startswith("file:/") else f"file://{path}")


def _clean(value: object) -> str:
    """A header value on one line: control characters and % are percent-encoded."""
    return "".join(f"%{b:02X}" if b < 32 or b in (37, 127) else chr(b) for b in str(value).encode()) if value is not None else ""


def _plain(value: str) -> str:
    out, raw, i = bytearray(), value.encode("latin-1"), 0
    while i < len(raw):
        if raw[i] == 37:
            out.append(int(raw[i + 1 : i + 3], 16))
            i += 3
        else:
            out.append(raw[i])
            i += 1
    return out.decode("utf-8", "replace")


def record(row: dict) -> tuple[bytes, bytes]:
    """Header and payload bytes of one record; a revisit has no payload."""
    payload = b"" if row["record_type"] == "revisit" else row["payload"] or b""
    digest = base64.b32encode(bytes.fromhex(row["payload_digest"])).decode()
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {row['record_id']}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if row["target_uri"] is not None:
        lines.append(f"WARC-Target-URI: {_clean(row['target_uri'])}")
    if row["page_id"] is not None:
        lines.append(f"X-Page-ID: {row['page_id']}")
    if row["record_type"] == "revisit":
        lines += [f"WARC-Profile: {REVISIT}", f"X-Refers-To-Page-ID: {row['refers_to']}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {row['payload_length']}", f"Content-Length: {len(payload)}"]
    return "\r\n".join(lines).encode("latin-1", "replace") + b"\r\n\r\n", payload


def _digest(value: str) -> str:
    """Lower-case hex of a SHA-1 digest in base32 or hex; any other digest as it is."""
    bare = value.removeprefix("sha1:")
    if re.fullmatch("[A-Z2-7a-z]{32}", bare):
        return base64.b32decode(bare.upper()).hex()
    return bare.lower() if re.fullmatch("[0-9A-Fa-f]{40}", bare) else value


class _Stream:
    """Lines, bytes and skips over a plain or gzip file, a block at a time; an offset moves over the block."""

    def __init__(self, file: pa.NativeFile, packed: bool):
        self.file, self.packed, self.size = file, packed, file.size()
        self.held, self.at = b"", 0
        self.raw, self.raw_at, self.inflate = b"", 0, None

    def _inflated(self) -> bytes:
        while True:
            if self.raw_at == len(self.raw):
                self.raw, self.raw_at = self.file.read(BLOCK), 0
                if not self.raw:
                    if self.inflate:
                        raise EOFError("the archive ends within a gzip member")
                    return b""
            self.inflate = self.inflate or zlib.decompressobj(31)
            fed = self.raw[self.raw_at : self.raw_at + FEED]
            out = self.inflate.decompress(fed, BLOCK)
            self.raw_at += len(fed) - len(self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail)
            if self.inflate.eof:
                self.inflate = None
            if out:
                return out

    def _more(self) -> bool:
        block = self._inflated() if self.packed else self.file.read(BLOCK)
        self.held, self.at = self.held[self.at :] + block, 0
        return bool(block)

    def line(self) -> bytes | None:
        while (end := self.held.find(b"\r\n", self.at)) < 0:
            if not self._more():
                if self.held[self.at :].strip():
                    raise EOFError("the archive ends within a line")
                return None
        out, self.at = self.held[self.at : end], end + 2
        return out

    def take(self, n: int) -> bytes:
        parts = []
        while n:
            if self.at == len(self.held) and not self._more():
                raise EOFError("the archive ends within a record")
            part = self.held[self.at : self.at + n]
            self.at += len(part)
            n -= len(part)
            parts.append(part)
        return b"".join(parts)

    def skip(self, n: int) -> None:
        while n:
            if self.at == len(self.held):
                if not self.packed:
                    if self.file.tell() + n > self.size:
                        raise EOFError("the archive ends within a record")
                    self.file.seek(self.file.tell() + n)
                    return
                if not self._more():
                    raise EOFError("the archive ends within a record")
            part = min(n, len(self.held) - self.at)
            self.at += part
            n -= part


class WarcPartition(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payload, self.tests = options["path"], options.get("payload", "true").lower() != "false", []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if name in HEADERS and isinstance(f, EqualTo):
                self.tests.append((name, {f.value}))
            elif name in HEADERS and isinstance(f, In):
                self.tests.append((name, set(f.value)))
            elif name in HEADERS and isinstance(f, IsNotNull):
                self.tests.append((name, None))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        fs, path = _fs(self.path)
        found = fs.get_file_info(pafs.FileSelector(path, recursive=True, allow_not_found=True))
        lists = [f.path for f in found if f.is_file and f.base_name.startswith("_committed-")]
        named = {name for at in lists for name in fs.open_input_file(at).read().decode().split()}
        files = sorted((f for f in found if f.is_file and f.path.endswith((".warc", ".warc.gz")) and (not lists or f.base_name in named)), key=lambda f: (-f.size, f.path))
        prefix = self.path.split("://")[0] + "://" if "://" in self.path else ""
        return [WarcPartition(prefix + f.path) for f in files] or [WarcPartition("")]

    def read(self, partition: WarcPartition) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, path = _fs(partition.path)
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        names = [*HEADERS, "payload"]
        rows: list[tuple] = []
        size = 0
        with fs.open_input_file(path) as file:
            stream = _Stream(file, path.endswith(".gz"))
            while (first := stream.line()) is not None:
                if not first:
                    continue
                if not first.startswith(b"WARC/"):
                    raise ValueError(f"{path}: no record starts with {first[:40]!r}")
                head: dict[str, str] = {}
                last = ""
                while line := stream.line():
                    if line[:1] in b" \t" and last:  # a folded line goes on with the header before it
                        head[last] += " " + line.decode("latin-1").strip()
                        continue
                    k, _, v = line.decode("latin-1").partition(":")
                    last = k.strip().lower()
                    head[last] = v.strip()
                if not head.get("content-length", "").isdigit():
                    raise ValueError(f"{path}: record {head.get('warc-record-id')} has no Content-Length")
                n = int(head["content-length"])
                row = self._columns(head)
                if any((row[k] is None) if v is None else row[k] not in v for k, v in self.tests):
                    stream.skip(n)
                    continue
                body = None
                if self.payload:
                    body = stream.take(n)
                else:
                    stream.skip(n)
                rows.append((*row.values(), body))
                size += len(body or b"") + 200
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    @staticmethod
    def _columns(head: dict[str, str]) -> dict:
        got = {k: head.get(h.lower()) for k, h in HEADERS.items()}
        for k in ("page_id", "payload_length", "refers_to"):
            got[k] = None if got[k] is None else int(got[k])
        if got["target_uri"] is not None:
            got["target_uri"] = _plain(got["target_uri"])
        if got["payload_digest"] is not None:
            got["payload_digest"] = _digest(got["payload_digest"])
        return got


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.packed = options["path"], options.get("compression", "none") == "gzip"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = _fs(self.path)
        fs.create_dir(root, recursive=True)
        out, size = None, 0
        message = WriterCommitMessage()
        message.files = []
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None or size > ROLL:
                        if out:
                            out.close()
                        message.files.append(f"{uuid.uuid4().hex}.warc" + ".gz" * self.packed)
                        out, size = fs.open_output_stream(f"{root}/{message.files[-1]}", compression=None), 0
                    head, payload = record(row)
                    data = head + payload + b"\r\n\r\n"
                    if self.packed:
                        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                        data = pack.compress(data) + pack.flush()
                    size += out.write(data)
            if out:
                out.close()
        except BaseException:  # no list names these files; they only take space
            if out and not out.closed:
                out.close()
            self._delete(message.files)
            raise
        return message

    def _delete(self, names: list[str]) -> None:
        fs, root = _fs(self.path)
        for name in names:
            fs.delete_file(f"{root}/{name}")

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = _fs(self.path)
        fs.create_dir(root, recursive=True)
        names = [name for m in messages if m for name in m.files]
        done = f"{root}/_committed-{uuid.uuid4().hex}"
        with fs.open_output_stream(f"{root}/.{done.rsplit('/', 1)[1]}", compression=None) as out:
            out.write("\n".join(names).encode())
        fs.move(f"{root}/.{done.rsplit('/', 1)[1]}", done)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._delete([name for m in messages if m for name in m.files])


class WarcDataSource(DataSource):
    """format("warc"); options: path, payload (true), compression (none or gzip, for writing)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def records(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Record rows of pages (page_id, url, html): equal payloads of `least` bytes or more become revisits of the one
    with the largest page_id.

    Null html is an empty payload, shorter payloads are all responses. Rows with a null page_id are responses and are
    referred to by none. If the largest page_id itself is repeated, its rows are all responses. Other columns are ignored.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("target_uri"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"payload_digest": F.sha1("payload"), "payload_length": F.octet_length("payload").cast("long")})
    # Short payloads meet nothing; their keys are their own, so that many empty pages do not land in one task.
    own = F.concat_ws("|", F.lit("short"), "page_id", "target_uri", "payload_digest")
    rows = rows.withColumn("_key", F.when(F.col("payload_length") >= least, F.concat_ws("|", "payload_digest", "payload_length")).otherwise(own))
    last = rows.where(F.col("payload_length") >= least).groupBy(F.col("_key").alias("_of")).agg(F.max("page_id").alias("_last"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    met = rows.join(last, F.col("_key") == F.col("_of"), "left")
    revisit = F.coalesce(F.col("page_id") != F.col("_last"), F.lit(False))
    seed = F.md5(F.concat_ws("|", "page_id", "target_uri", "payload_digest", F.when(revisit, "revisit").otherwise("response")))
    return met.select(
        F.concat(F.lit("<urn:uuid:"), F.regexp_replace(seed, "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"), F.lit(">")).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        "page_id",
        "payload_digest",
        "payload_length",
        F.when(revisit, F.col("_last")).alias("refers_to"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def write(pages: DataFrame, path: str, least: int = 1000, compression: str = "none") -> None:
    register(pages.sparkSession)
    records(pages, least).write.format("warc").mode("append").option("compression", compression).save(path)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def round_trip(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Writes gzip archives into the shared folder and reads them back, digests of responses taken from their payloads."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write(pages, path, least, compression="gzip")
    free_shuffles(spark)
    got = read(spark, path)
    has = F.col("record_type") == "response"
    out, _ = materialize(got.select(
        "page_id",
        F.when(has, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(has, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    ), "warc-records")
    release(spark, path)
    return out
