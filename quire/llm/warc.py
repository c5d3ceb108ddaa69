"""WARC archives as a Spark data source: format("warc") reads and writes them.

Records are gzip members of their own, and a sidecar index holds each member's offset, so files are
planned into partitions by byte ranges at record bounds. A reader inflates the head of a member,
tests the pushed-down predicates on its headers, and inflates the payload only of records that pass
and only if payloads are asked for: a member's gzip header tells its length, so others are gone past. Members
of other writers are inflated to find their end. Each write task writes files of its own name; a manifest written
at commit lists those that count, so files of failed or repeated tasks are never read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualNullSafe, EqualTo, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from .common import new_folder, pick, spread_join, stored

#: Beside each file stands one of this name, with the places of members a megabyte apart.
INDEX = "_index-"

SCHEMA = "record_id string, record_type string, target_uri string, record_date string, content_length bigint, payload_digest string, payload_length bigint, refers_to string, source_id bigint, refers_to_source bigint, payload binary"
WRITE_SCHEMA = "source_id bigint, url string, payload binary, record_type string, refers_to_source bigint"
#: Header of each column that a header can fill.
HEADERS = {
    "record_id": "warc-record-id",
    "record_type": "warc-type",
    "target_uri": "warc-target-uri",
    "record_date": "warc-date",
    "payload_digest": "warc-payload-digest",
    "refers_to": "warc-refers-to",
}
NUMBERS = {"content_length": "content-length", "payload_length": "x-payload-length", "source_id": "x-source-id", "refers_to_source": "x-refers-to-source"}
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), path)


def digest(payload: bytes) -> str:
    """Base32 SHA-1 of a payload."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_name(source_id: int | None, url: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{source_id}|{url}')}>"


def record(source_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP head alone, the payload's digest and its length."""
    body = HTTP_HEAD if kind == "revisit" else HTTP_HEAD + payload
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_name(source_id, url)), ("WARC-Date", date), ("WARC-Target-URI", url), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", "sha1:" + digest(payload)), ("X-Payload-Length", len(payload)), ("X-Source-Id", source_id)]
    if kind == "revisit":
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Source", refers_to)]
    head.append(("Content-Length", len(body)))
    lines = "".join(f"{k}: {''.join(' ' if ord(c) < 32 else c for c in str(v))}\r\n" for k, v in head if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + body + b"\r\n\r\n"


class _Span(InputPartition):
    def __init__(self, path: str, start: int, stop: int | None, index: str = ""):
        self.path, self.start, self.stop, self.index = path, start, stop, index


class _Commit(WriterCommitMessage):
    def __init__(self, files: list[str]):
        self.files = files


class WarcSource(DataSource):
    """Options: path; payloads (true: decode them); splitBytes (64 MB); rollBytes (256 MB); date; filters, as pushed down."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return WarcWriter(dict(self.options), overwrite)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.schema, self.tests = options, schema, []

    def pushFilters(self, filters):
        """Takes predicates on header columns; hands back the rest."""
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if column not in HEADERS and column not in NUMBERS:
                yield f
            elif isinstance(f, (EqualTo, EqualNullSafe)) and f.value is not None:
                self.tests.append((column, "in", (f.value,)))
            elif isinstance(f, In):
                self.tests.append((column, "in", tuple(f.value)))
            elif isinstance(f, StringStartsWith):
                self.tests.append((column, "starts", f.value))
            elif isinstance(f, IsNotNull):
                self.tests.append((column, "there", None))
            else:
                yield f

    def partitions(self) -> list[_Span]:
        store, root = _open(self.options["path"])
        step = int(self.options.get("splitbytes", 64_000_000))
        out = []
        for info in store.get_file_info(pafs.FileSelector(root)):
            if not info.base_name.startswith("_manifest"):
                continue
            with store.open_input_stream(info.path) as f:
                for name, size in json.loads(f.read()):
                    out += [_Span(f"{root}/{name}", at, at + step if at + step < size else None, f"{root}/{INDEX}{name}.json") for at in range(0, size, step)]
        if not out:
            out = [_Span(i.path, 0, None) for i in store.get_file_info(pafs.FileSelector(root)) if i.base_name.endswith(".warc.gz")]
        return out or [_Span("", 0, 0)]

    def read(self, partition: _Span) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        names = [f.name for f in self.schema.fields]
        types = {"payload": pa.binary()} | dict.fromkeys(NUMBERS, pa.int64())
        store, _ = _open(self.options["path"])
        start, stop = partition.start, partition.stop
        if partition.index:
            # The members whose begin is in the index nearest to the stretch; the driver knows sizes of files alone.
            with store.open_input_stream(partition.index) as f:
                offsets = json.loads(f.read())
            start = next((o for o in offsets if o >= start), None)
            stop = next((o for o in offsets if stop is not None and o >= stop), None)
            if start is None:
                return
        payloads = self.options.get("payloads", "true").lower() == "true" and "payload" in names
        rows, held = [], 0
        make = lambda: pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], types.get(n, pa.string())) for n in names], names=names)
        with store.open_input_file(partition.path) as f:
            for row in scan(f, start, stop, self.tests, payloads):
                rows.append(row)
                held += 500 + len(row.get("payload") or b"")
                if held > 8_000_000:
                    yield make()
                    rows, held = [], 0
        if rows:
            yield make()


def passes(row: dict, tests: list[tuple]) -> bool:
    for column, how, value in tests:
        x = row.get(column)
        if x is None or how == "in" and x not in value or how == "starts" and not x.startswith(value):
            return False
    return True


#: The subfield of a gzip header's extra field that tells the length of the whole member.
_LENGTH = b"QL\x08\x00"


def member(data: bytes) -> bytes:
    """A gzip member with its own length in its header, so that a reader can go past it without inflating it."""
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    plain = z.compress(data) + z.flush()
    extra = _LENGTH + (len(plain) + 14).to_bytes(8, "little")
    return plain[:3] + bytes([plain[3] | 4]) + plain[4:10] + len(extra).to_bytes(2, "little") + extra + plain[10:]


class _Members:
    """The gzip members of a file, inflated piece by piece from `at` on. inflated: how many bytes that gave."""

    def __init__(self, f, at: int):
        f.seek(at)
        self.f, self.at, self.buffer, self.inflated = f, at, b"", 0

    def begin(self) -> None:
        while len(self.buffer) < 24 and (more := self.f.read(1 << 20)):
            self.buffer += more
        told = self.buffer[3:4] and self.buffer[3] & 4 and self.buffer[12:16] == _LENGTH
        self.next = self.at + int.from_bytes(self.buffer[16:24], "little") if told else None
        self.z = zlib.decompressobj(31)
        self.rest = self.buffer

    def skip(self) -> bool:
        """Goes on to the next member without inflating the rest of this one; not where its header does not tell its length."""
        if self.next is None:
            return False
        ahead = self.next - self.at
        if ahead <= len(self.buffer):
            self.buffer = self.buffer[ahead:]
        else:
            self.f.seek(self.next)
            self.buffer = b""
        self.at = self.next
        return True

    def pull(self, most: int) -> bytes:
        """Up to `most` bytes more of the member; none at its end."""
        while not self.z.eof:
            out = self.z.decompress(self.rest, most)
            self.rest = self.z.unconsumed_tail
            if out:
                self.inflated += len(out)
                return out
            if not self.rest and not self.z.eof:
                self.at += len(self.buffer)
                self.buffer = self.rest = self.f.read(1 << 20)
                if not self.buffer:
                    raise EOFError("the archive ends within a record")
        return b""

    def end(self) -> None:
        left = self.z.unused_data
        self.at += len(self.buffer) - len(left)
        self.buffer = left


def scan(f, start: int, stop: int | None, tests: list[tuple], payloads: bool) -> Iterator[dict]:
    """Records whose gzip members begin in [start, stop): headers first, payloads of those that pass alone; the rest of others is gone past."""
    yield from records(_Members(f, start), f.size() if stop is None else stop, tests, payloads)


def records(members: _Members, stop: int, tests: list[tuple], payloads: bool) -> Iterator[dict]:
    """The records of members that begin before stop, as `scan` gives them."""
    while members.at < stop:
        members.begin()
        text = b""
        while b"\r\n\r\n" not in text and (more := members.pull(4096)):
            text += more
        head, _, body = text.partition(b"\r\n\r\n")
        said = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:]))
        row: dict = {c: said.get(h) for c, h in HEADERS.items()} | {c: int(said[h]) if h in said else None for c, h in NUMBERS.items()}
        if row["payload_digest"]:
            row["payload_digest"] = row["payload_digest"].removeprefix("sha1:")
        wanted = passes(row, tests)
        keep = wanted and payloads and row["record_type"] != "revisit"
        parts = [body]
        if keep or not members.skip():
            # Members of other writers don't tell their length: they are inflated to their end.
            while more := members.pull(1 << 20):
                if keep:
                    parts.append(more)
            members.end()
        if keep:
            block = b"".join(parts)[: row["content_length"]]
            row["payload"] = block.partition(b"\r\n\r\n")[2] if said.get("content-type", "").startswith("application/http") else block
            if row["payload_digest"] and digest(row["payload"]) != row["payload_digest"]:
                raise ValueError(f"payload of {row['record_id']} does not have the digest its header states")
        if wanted:
            yield row


class WarcWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.options, self.overwrite = options, overwrite

    def write(self, iterator: Iterator[Row]) -> _Commit:
        store, root = _open(self.options["path"])
        store.create_dir(root, recursive=True)
        roll, date = int(self.options.get("rollbytes", 256_000_000)), self.options.get("date", "2024-01-01T00:00:00Z")
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex[:12]
        made: list[tuple[str, list[int]]] = []
        sizes: list[tuple[str, int]] = []
        out, at = None, 0

        def close() -> None:
            out.close()
            name, offsets = made[-1]
            with store.open_output_stream(f"{root}/{INDEX}{name}.json", compression=None) as f:
                f.write(json.dumps(offsets).encode())
            sizes.append((name, at))

        for row in iterator:
            if out is None or at >= roll:
                if out:
                    close()
                made.append((f"part-{part:05d}-{len(made):03d}-{attempt}.warc.gz", []))
                out, at = store.open_output_stream(f"{root}/{made[-1][0]}", compression=None), 0
            data = member(record(row["source_id"], row["url"], bytes(row["payload"] or b""), row["record_type"], row["refers_to_source"], date))
            if not made[-1][1] or at - made[-1][1][-1] >= 1_000_000:
                made[-1][1].append(at)
            out.write(data)
            at += len(data)
        if out:
            close()
        return _Commit([json.dumps(sizes)])

    def commit(self, messages) -> None:
        store, root = _open(self.options["path"])
        store.create_dir(root, recursive=True)
        files = [f for m in messages if m for x in m.files for f in json.loads(x)]
        old = [i.path for i in store.get_file_info(pafs.FileSelector(root)) if i.base_name.startswith("_manifest")] if self.overwrite else []
        with store.open_output_stream(f"{root}/_manifest-{uuid.uuid4().hex}.json", compression=None) as f:
            f.write(json.dumps(files).encode())
        for path in old:
            store.delete_file(path)

    def abort(self, messages) -> None:
        store, root = _open(self.options["path"])
        for m in messages:
            for x in m.files if m else ():
                for name, _ in json.loads(x):
                    store.delete_file(f"{root}/{name}")
                    store.delete_file(f"{root}/{INDEX}{name}.json")


def register(spark: SparkSession) -> None:
    """Makes format("warc") known to the session, with the filter pushdown that the reader needs."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """WRITE_SCHEMA rows of (page_id, url, html): which records hold their payload and which revisit another.

    Of the rows with equal payloads of at least least_bytes, those with the largest page_id are
    responses and the others revisit it; null html is an empty payload. Repeated rows of the largest
    page_id are all responses, and so are rows without any page_id in their group; a null page_id
    otherwise revisits. Rows are never joined in pairs: one row per payload decides, and a payload with many copies is dealt over tasks.
    """
    rows = pick(pages, "page_id", "url", "html").select(F.col("page_id").cast("bigint").alias("source_id"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("sum", F.sha2("payload", 256)).withColumn("n", F.octet_length("payload"))
    first = rows.where(F.col("n") >= least_bytes).groupBy("sum").agg(F.max("source_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    rows = spread_join(rows, stored(first, "copies"), ["sum"], "copies", "source_id", "left")
    again = F.col("first").isNotNull() & (F.col("n") >= least_bytes) & ~F.col("source_id").eqNullSafe(F.col("first"))
    return rows.select("source_id", "url", "payload", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to_source"))


def write_archive(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Writes the pages to path as WARC files, payloads that repeat as revisits."""
    register(pages.sparkSession)
    with_revisits(pages, least_bytes).write.format("warc").mode("append").save(path)


def read_archive(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of the archives under path."""
    register(spark)
    return spark.read.format("warc").option("payloads", str(payloads).lower()).load(path)


def op10_warc(spark, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, written and read back."""
    path = new_folder(spark, "warc")
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    back = read_archive(spark, path)
    size = F.when(F.col("record_type") == "response", F.octet_length("payload").cast("bigint")).otherwise(F.col("payload_length"))
    return back.select(F.col("source_id").alias("page_id"), size.alias("payload_bytes"), "payload_digest", "record_type", F.col("refers_to_source").alias("refers_to"))
