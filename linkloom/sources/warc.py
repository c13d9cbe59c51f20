"""Web archives as a Spark data source: one partition for each file; and as ranges of files, many tasks to one.

A file is read forward, whatever its size; only one record is held at a time, and one that is larger than
``maxRecordBytes`` is passed over. What could not be read, such a record or a damaged end of a file, is a row with
``error`` and without a type. Local paths are opened directly, others through pyarrow's file systems.

Where a compressed file can be cut, only one who has gone through it knows. ``members`` does that once, inflating and parsing
nothing else, and gives a table that can be kept; ``split`` makes ranges of it, and ``read_ranges`` reads these as rows are
dealt out. An index of captures is such a table too: ``near`` puts its records that lie close together into one read."""

from __future__ import annotations

import gzip
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from contextlib import suppress
from itertools import islice
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

MAX_INFLATED = 200 << 20
RECORD = (
    "filename string, position long, record_type string, target_uri string, content_type string, headers map<string,string>, http_status int, "
    "http_headers map<string,string>, payload binary, error string"
)


class InflatedTooLarge(ValueError):
    """Compressed bytes that inflate beyond the bound."""


def inflate(data: bytes, most: int = MAX_INFLATED) -> bytes:
    """Gzip bytes of one or more members, inflated; an error beyond the bound, before more is held."""
    out = bytearray()
    while data:
        member = zlib.decompressobj(wbits=31)
        out += member.decompress(data, most - len(out) + 1)
        if len(out) > most:
            raise InflatedTooLarge(f"more than {most} bytes")
        if not member.eof:
            raise EOFError("cut off")
        data = member.unused_data.lstrip(b"\0")
    return bytes(out)


_START = re.compile(rb"^WARC/[^\n]*\n", re.M)
_BLANK = re.compile(rb"^\r?\n", re.M)
_FIELD = re.compile(rb"^([^:\n]*):([^\n]*)", re.M)
_STATUS = re.compile(rb"\s*HTTP\S*\s+([+-]?[0-9]+)(?:\s|\Z)")


def fields(block: bytes) -> dict[str, str]:
    """Names in lower case and values of a header block; of a name that comes twice the last holds."""
    return {n.strip().decode("ascii", "replace").lower(): v.strip().decode("utf-8", "replace") for n, v in _FIELD.findall(block)}


def split_http(block: bytes) -> tuple[int | None, dict[str, str], bytes]:
    """Status, headers and body of a response; a block without a blank line is all body."""
    gap = re.search(rb"\r\n\r\n", block) or re.search(rb"\n\n", block)
    if gap is None:
        return None, {}, block
    first, _, rest = block[: gap.start()].partition(b"\n")
    status = _STATUS.match(first)
    return int(status[1]) if status else None, fields(rest), block[gap.end() :]


class Cursor:
    """A place in a stream, and what has been read ahead of it. The place counts as the start of a line."""

    STEP = 1 << 16

    def __init__(self, stream: BinaryIO) -> None:
        # what there is, without waiting for more: of a damaged file all that stands before the damage
        self.more = getattr(stream, "read1", stream.read)
        self.ahead, self.seen, self.found_at = b"", 0, 0

    def _read(self) -> bool:
        more = self.more(self.STEP)
        self.ahead += more
        self.seen += len(more)
        return bool(more)

    def after(self, pattern: re.Pattern) -> bytes | None:
        """Moves behind the next match; what stood before it, or None at the end. The match lies within lines."""
        passed = []
        while (found := pattern.search(self.ahead)) is None:
            lines, end, rest = self.ahead.rpartition(b"\n")  # the last line may go on
            passed.append(lines + end if pattern is _BLANK else b"")
            long = len(rest) > 4 * self.STEP and not rest.startswith(b"WARC/")
            self.ahead = b"\0" if long and pattern is _START else rest  # a line that can be no start
            if not self._read():
                passed.append(self.ahead)
                self.ahead = b""
                return b"".join(passed) if pattern is _BLANK else None
        passed.append(self.ahead[: found.start()])
        self.found_at = self.seen - len(self.ahead) + found.start()
        self.ahead = self.ahead[found.end() :]
        return b"".join(passed)

    def take(self, size: int) -> bytes:
        """So many bytes, or what there is."""
        parts, held = [self.ahead[:size]], len(self.ahead[:size])
        self.ahead = self.ahead[size:]
        while held < size and (more := self.more(min(size - held, 1 << 20))):
            parts.append(more)
            held += len(more)
            self.seen += len(more)
        return b"".join(parts)

    def skip(self, size: int) -> None:
        while size > 0 and (gone := len(self.take(min(size, 1 << 20)))):
            size -= gone


def records(stream: BinaryIO, most: int = MAX_INFLATED) -> Iterator[tuple]:
    """(position, type, uri, content type, headers, status, http headers, payload, error). The position is the record's in the
    inflated stream. What stands between records is passed over; a length that is no number is none."""
    cursor = Cursor(stream)
    while cursor.after(_START) is not None:
        at = cursor.found_at
        headers = fields(cursor.after(_BLANK) or b"")
        kind, uri = headers.get("warc-type", ""), headers.get("warc-target-uri", "")
        length = headers.get("content-length", "")
        size = int(length) if length.isascii() and length.isdigit() else 0
        if size > most:
            cursor.skip(size + 4)
            yield at, None, uri, None, headers, None, {}, None, f"a record of {size} bytes"
            continue
        payload = cursor.take(size)
        cursor.skip(4)
        if len(payload) < size:
            yield at, None, uri, None, headers, None, {}, None, f"{len(payload)} of {size} bytes"
            continue
        status, http, body = split_http(payload) if kind == "response" else (None, {}, payload)
        yield at, kind, uri, headers.get("content-type", ""), headers, status, http, body, None


def _opened(path: str) -> BinaryIO:
    if "://" in path and not path.startswith("file:"):
        import pyarrow.fs

        fs, inner = pyarrow.fs.FileSystem.from_uri(path)
        return fs.open_input_file(inner)
    return open(path.removeprefix("file://").removeprefix("file:"), "rb")  # noqa: SIM115


class Part(io.RawIOBase):
    """A range of a file."""

    def __init__(self, raw: BinaryIO, offset: int, length: int) -> None:
        self.raw, self.left = raw, length
        raw.seek(offset)

    def readable(self) -> bool:
        return True

    def readinto(self, into: memoryview) -> int:
        data = self.raw.read(min(len(into), self.left))
        into[: len(data)] = data
        self.left -= len(data)
        return len(data)

    def close(self) -> None:
        self.raw.close()
        super().close()


def open_stream(path: str, offset: int = 0, length: int | None = None) -> BinaryIO:
    """A file, or a range of it, inflated; gzip by its first bytes."""
    raw = _opened(path)
    raw.seek(offset)
    magic = raw.read(2)
    raw.seek(offset)
    stream = raw if length is None else io.BufferedReader(Part(raw, offset, length), 1 << 16)
    return gzip.GzipFile(fileobj=stream) if magic == b"\x1f\x8b" else stream


#: What a file that is no whole archive raises while it is read.
DAMAGE = (EOFError, zlib.error, gzip.BadGzipFile)


def _rows_of(path: str, stream: BinaryIO, most: int, kinds: set) -> Iterator[tuple]:
    name, at = path.rpartition("/")[2], -1
    try:
        for record in records(stream, most):
            at = record[0]
            if record[1] in kinds:
                yield (name, *record)
    except DAMAGE as damage:  # what was whole until there counts
        yield name, at + 1, None, None, None, None, None, None, None, str(damage)


class File(InputPartition):
    """A file from a position of its inflated stream on, and so many records of it."""

    def __init__(self, path: str, first: int, count: int | None) -> None:
        self.path, self.first, self.count = path, first, count


class WarcReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.files = [p for p in options.get("files", "").split("\n") if p]
        self.most = int(options.get("maxrecordbytes", MAX_INFLATED))
        self.kinds = {None, *filter(None, options.get("types", "response").split(","))}
        self.first, self.count = int(options.get("first", 0)), int(options["count"]) if "count" in options else None

    def partitions(self) -> list[File]:
        return [File(f, self.first, self.count) for f in self.files]

    def read(self, part: File) -> Iterator[tuple]:
        with open_stream(part.path) as stream:
            rows = (r for r in _rows_of(part.path, stream, self.most, self.kinds) if r[1] >= part.first)
            yield from rows if part.count is None else islice(rows, part.count)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "linkloom_warc"

    def schema(self) -> str:
        return RECORD

    def reader(self, schema) -> WarcReader:
        return WarcReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"])


class Written(WriterCommitMessage):
    def __init__(self, name: str | None) -> None:
        self.name = name


class WarcWriter(DataSourceWriter):
    """Responses (uri, html, id) as archives, one a task, a gzip member a record. A file gets its name when all are written, so those
    of lost tasks are never read."""

    def __init__(self, path: str) -> None:
        self.path = path

    def _fs(self):
        import pyarrow.fs

        return pyarrow.fs.FileSystem.from_uri(self.path) if "://" in self.path else (pyarrow.fs.LocalFileSystem(), self.path.removeprefix("file:"))

    def write(self, iterator: Iterator) -> Written:
        fs, folder = self._fs()
        name, rows = f"{uuid.uuid4().hex}.warc.gz", 0
        fs.create_dir(f"{folder}/_pending")
        with fs.open_output_stream(f"{folder}/_pending/{name}", compression=None) as out:
            for row in iterator:
                out.write(gzip.compress(response(*row), mtime=0))
                rows += 1
        return Written(name if rows else None)

    def commit(self, messages: list) -> None:
        fs, folder = self._fs()
        for k, name in enumerate(m.name for m in messages if m is not None and m.name):
            fs.move(f"{folder}/_pending/{name}", f"{folder}/part-{k:05d}-{name}")
        self.abort(messages)

    def abort(self, messages: list) -> None:
        fs, folder = self._fs()
        with suppress(OSError):
            fs.delete_dir(f"{folder}/_pending")


def response(uri: str, html: str, record: str | None = None) -> bytes:
    """An archived page, with the id of its record if it has one."""
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + (html or "").encode("utf-8", "surrogatepass")
    known = f"WARC-Record-ID: {record}\r\n" if record else ""
    head = f"WARC/1.0\r\nWARC-Type: response\r\n{known}WARC-Target-URI: {uri or ''}\r\nContent-Type: application/http\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode("utf-8", "surrogatepass") + body + b"\r\n\r\n"


def write_warc(pages: DataFrame, folder: str, url: str = "url", html: str = "html", record: Column | None = None) -> str:
    """Pages as archives in a folder. record: the ids of the records, by which captures of one url are told apart."""
    pages.sparkSession.dataSource.register(WarcSource)
    named = (F.lit(None) if record is None else record).cast("string").alias("record")
    pages.select(F.col(url).cast("string").alias("uri"), F.col(html).cast("string").alias("html"), named).write.format("linkloom_warc").mode("append").save(folder)
    return folder


def list_files(spark: SparkSession, path: str) -> list[str]:
    """The files that a path, folder or pattern means, in order; folders are not descended into."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = []
    for status in fs.globStatus(where) or []:
        inner = fs.listStatus(status.getPath()) if status.isDirectory() else [status]
        out += [str(s.getPath().toString()) for s in inner if not s.isDirectory()]
    return sorted(out)


def scan(spark: SparkSession, files: list[str], types: str = "response", max_record: int = MAX_INFLATED, first: int = 0, count: int | None = None) -> DataFrame:
    """All rows of these files, errors with the records; or of each those from a position on, and so many."""
    spark.dataSource.register(WarcSource)
    if not files:
        return spark.createDataFrame([], RECORD)
    options = {"files": "\n".join(files), "types": types, "maxRecordBytes": str(max_record), "first": str(first)}
    return spark.read.format("linkloom_warc").options(**options, **({} if count is None else {"count": str(count)})).load()


def read_warc(spark: SparkSession, path: str, types: str = "response", max_record: int = MAX_INFLATED) -> DataFrame:
    return scan(spark, list_files(spark, path), types, max_record).where("error is null").drop("error")


def read_damage(spark: SparkSession, path: str, max_record: int = MAX_INFLATED) -> DataFrame:
    """(filename, target_uri, error) of what could not be read."""
    return scan(spark, list_files(spark, path), "", max_record).where("error is not null").select("filename", "target_uri", "error")


# ranges of files

MEMBER = "path string, offset long, length long, start long"


def _members(path: str) -> Iterator[tuple[int, int, int]]:
    """(offset, length, position in the inflated stream) of each gzip member, or of each record of a plain archive."""
    with _opened(path) as raw:
        magic = raw.read(2)
        raw.seek(0)
        if magic != b"\x1f\x8b":
            at = None
            cursor = Cursor(raw)
            while cursor.after(_START) is not None:
                if at is not None:
                    yield at, cursor.found_at - at, at
                at = cursor.found_at
                length = fields(cursor.after(_BLANK) or b"").get("content-length", "")
                cursor.skip(int(length) if length.isascii() and length.isdigit() else 0)
            if at is not None:
                yield at, cursor.seen - at, at
            return
        offset, start, ahead = 0, 0, raw.read(1 << 20)
        while ahead:
            member, used, size = zlib.decompressobj(wbits=31), 0, 0
            try:
                while ahead and not member.eof:
                    size += len(member.decompress(ahead, 1 << 20))
                    rest = member.unused_data if member.eof else member.unconsumed_tail
                    used += len(ahead) - len(rest)
                    ahead = rest or (b"" if member.eof else raw.read(1 << 20))
            except zlib.error:
                used, ahead = used + len(ahead) + len(raw.read()), b""  # the rest is one range, whose reader says what is wrong
            ahead = ahead or raw.read(1 << 20)
            while ahead and not (kept := ahead.lstrip(b"\0")):  # padding between members
                used, ahead = used + len(ahead), raw.read(1 << 20)
            if ahead:
                used, ahead = used + len(ahead) - len(kept), kept
            yield offset, used, start
            offset, start = offset + used, start + size


def members(spark: SparkSession, files: list[str]) -> DataFrame:
    """(path, offset, length, start) of the places at which these archives can be cut; start is the position in the inflated
    stream. A file is gone through once, in one task, and nothing of it is parsed."""
    schema = to_arrow_schema(T.StructType.fromDDL(MEMBER))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                found = _members(path)
                while rows := list(islice(found, 10_000)):
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (path, *r), strict=True)) for r in rows], schema=schema)

    if not files:
        return spark.createDataFrame([], MEMBER)
    listed = spark.createDataFrame([(f,) for f in files], "path string")
    return listed.repartitionByRange(len(files), "path").mapInArrow(run, MEMBER)


def split(found: DataFrame, size: int = 64 << 20) -> DataFrame:
    """Ranges (path, offset, length, start) of about this size that begin and end with members."""
    along = Window.partitionBy("path").orderBy("offset")
    runs = found.withColumn("_run", F.floor((F.sum("length").over(along) - F.col("length")) / size))
    first = F.min(F.struct("offset", "start"))
    return runs.groupBy("path", "_run").agg(first.alias("f"), F.sum("length").alias("length")).select("path", "f.offset", "length", "f.start")


def near(captures: DataFrame, gap: int = 256 << 10, most: int = 8 << 20) -> DataFrame:
    """Ranges (path, offset, length, parts) from single records (path, offset, length), each once: those with less than ``gap`` between
    them are read at once, as long as they begin within ``most`` bytes of each other."""
    along = Window.partitionBy("path").orderBy("offset")
    rows = captures.select("path", "offset", "length").distinct()
    rows = rows.withColumn("_new", F.coalesce(F.col("offset") > F.lag(F.col("offset") + F.col("length")).over(along) + gap, F.lit(True)))
    rows = rows.withColumn("_run", F.sum(F.col("_new").cast("long")).over(along))
    rows = rows.withColumn("_cut", F.floor((F.col("offset") - F.min("offset").over(Window.partitionBy("path", "_run"))) / most))
    ranges = rows.groupBy("path", "_run", "_cut").agg(
        F.min("offset").alias("offset"), F.max(F.col("offset") + F.col("length")).alias("end"), F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("parts")
    )
    return ranges.select("path", "offset", (F.col("end") - F.col("offset")).alias("length"), "parts")


def scan_ranges(ranges: DataFrame, types: str = "response", max_record: int = MAX_INFLATED, tasks: int | None = None) -> DataFrame:
    """All rows of ranges of files, errors with the records, dealt out over tasks. A range with ``parts`` is read at once and gives the
    records of these; each has the offset and the length of its part."""
    spark = ranges.sparkSession
    schema = T.StructType.fromDDL(f"{RECORD}, record_offset long, record_length long")
    arrow, kinds = to_arrow_schema(schema), {None, *filter(None, types.split(","))}
    ranges = ranges.select("path", "offset", "length", *(F.col(c) if c in ranges.columns else F.lit(None).cast(t).alias(c) for c, t in (("start", "long"), ("parts", "array<struct<offset:long,length:long>>"))))

    def rows_of(path: str, offset: int, length: int, start: int | None, parts: list | None) -> Iterator[tuple]:
        if parts is None:
            with open_stream(path, offset, length) as stream:
                for name, at, *rest in _rows_of(path, stream, max_record, kinds):
                    yield name, (offset if start is None else start) + at, *rest, None, None
            return
        with _opened(path) as raw:
            raw.seek(offset)
            data = raw.read(length)
        for part in parts:
            own = data[part["offset"] - offset :][: part["length"]]
            stream = gzip.GzipFile(fileobj=io.BytesIO(own)) if own[:2] == b"\x1f\x8b" else io.BytesIO(own)
            for name, at, *rest in _rows_of(path, stream, max_record, kinds):
                yield name, part["offset"] + at, *rest, part["offset"], part["length"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                held, size = [], 0
                for record in rows_of(**row):
                    held.append(dict(zip(arrow.names, record, strict=True)))
                    size += len(record[8] or b"")
                    if size > 4 << 20 or len(held) >= 1000:
                        yield pa.RecordBatch.from_pylist(held, schema=arrow)
                        held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, schema=arrow)

    tasks = tasks or spark.sparkContext.defaultParallelism
    return ranges.repartition(tasks, "path", "offset").mapInArrow(run, schema)


def read_ranges(spark: SparkSession, ranges: DataFrame | list[tuple[str, int, int]], types: str = "response", max_record: int = MAX_INFLATED) -> DataFrame:
    """Single records by (path, offset, length), as an index of captures names them."""
    if isinstance(ranges, list):
        ranges = spark.createDataFrame(ranges, "path string, offset long, length long")
    return scan_ranges(near(ranges), types, max_record).where("error is null").drop("error")


def text_of(payload: Column) -> Column:
    """Bytes as text; what is malformed in them becomes U+FFFD."""
    return F.make_valid_utf8(payload.cast("string"))


_LINKS = "array<string>"
_ENVELOPE = (
    "Envelope struct<`WARC-Header-Metadata`:struct<`WARC-Target-URI`:string>,`Payload-Metadata`:struct<`HTTP-Response-Metadata`:"
    f"struct<`HTML-Metadata`:struct<Head:struct<Title:string>,Links:{_LINKS}>>>>"
)
_LINK = "url string, href string, text string, rel string, alt string, path string"


def wat_pages(metadata: DataFrame, *keep: str, whole: bool = False) -> DataFrame:
    """(filename, source_url, title, links) from a column ``json``, and columns to keep: pages that have an address; of their links
    those that have a url, whatever element they come from. With ``whole`` other rows stay too, without links, and what is no JSON
    object has that as its ``error``."""
    doc = F.from_json("json", _ENVELOPE)
    keep = ("filename", *keep)
    error = F.coalesce("error", F.when(F.col("json").isNotNull() & (F.col("d").isNull() | ~F.col("json").rlike(r"^\s*\{")), "no JSON object")) if whole else F.lit(None)
    page = metadata.withColumn("d", doc).select(
        *keep, error.alias("error"), F.col("d.Envelope.`WARC-Header-Metadata`.`WARC-Target-URI`").alias("source_url"),
        F.col("d.Envelope.`Payload-Metadata`.`HTTP-Response-Metadata`.`HTML-Metadata`").alias("m"),
    )
    empty = lambda c: F.coalesce(c, F.lit(""))
    links = F.transform(F.coalesce("m.Links", F.array().cast(_LINKS)), lambda x: F.from_json(x, _LINK))
    links = F.transform(links, lambda x: F.struct(
        empty(F.coalesce(F.nullif(x["url"], F.lit("")), x["href"])).alias("url"), empty(x["text"]).alias("text"),
        empty(x["rel"]).alias("rel"), empty(x["alt"]).alias("alt"), empty(x["path"]).alias("path"),
    ))
    links = F.filter(links, lambda x: x["url"] != "")
    if whole:
        links = F.when(F.col("source_url") != "", links)
    page = page if whole else page.where("source_url <> ''").drop("error")
    return page.select(*keep, *(["error"] if whole else []), "source_url", empty(F.col("m.Head.Title")).alias("title"), links.alias("links"))


def read_wat(spark: SparkSession, path: str, max_record: int = MAX_INFLATED) -> DataFrame:
    rows = read_warc(spark, path, "metadata", max_record)
    return wat_pages(rows.select("filename", text_of(F.col("payload")).alias("json")))
