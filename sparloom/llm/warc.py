"""WARC archives as a Python data source.

Writing: each task writes files of gzip members, one member a record, and the
driver's commit lists the files that count in a manifest, so files of failed or
repeated attempts are never read.  A member's header carries its length (extra
field "sl"), so a reader can step over records without inflating them.

Reading: files are listed and packed into partitions by size.  Predicates on the
record type and on header columns are pushed down and decided on the header
block alone: of a record that fails them, and of every record when the schema
asked for has no payload column, the payload is neither inflated nor decoded.
Plain .warc files and .gz files of other writers are read too, members one by one.

Files are reached through pyarrow file systems by the path's scheme, not through
the machine's own folders.

Defined cases: a null payload is empty; a null key has the record id <urn:page:>
and is never another's original; pages of equal keys and payloads are responses
each; records without a header of a column
have null there; unknown record types pass through; an empty folder has no rows.
"""

from __future__ import annotations

import base64
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from .common import materialize, read_table, shared_dir

#: Header of each column; payload and headers come from the record itself.
HEADER_OF = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "record_date": "WARC-Date",
    "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest",
    "payload_length": "X-Payload-Length",
}
SCHEMA = "record_type string, record_id string, target_uri string, record_date string, refers_to string, payload_digest string, payload_length long, headers map<string,string>, payload binary"
WRITTEN = ("record_type", "record_id", "target_uri", "refers_to", "payload_digest", "payload_length", "payload")
FILE_BYTES = 128 << 20
PARTITION_BYTES = 64 << 20
BATCH_BYTES, BATCH_ROWS = 4 << 20, 2_000
EPOCH = "1970-01-01T00:00:00Z"


# ---------------------------------------------------------------- one record


def member(record: bytes, level: int = 1) -> bytes:
    """One gzip member whose extra field tells its own length and the record's; without it from 4 GB on."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    size = 10 + 2 + 12 + len(body) + 8
    if max(size, len(record)) >= 1 << 32:
        return b"\x1f\x8b\x08\0" + b"\0" * 4 + b"\0\xff" + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)
    head = b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<HII", 8, size, len(record))
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def record(record_type: str, record_id: str, payload: bytes | None, target_uri: str | None = None, refers_to: str | None = None, payload_digest: str | None = None, payload_length: int | None = None) -> bytes:
    """A WARC/1.1 record; responses and revisits have an HTTP head, revisits no payload."""
    payload = payload or b""
    http = record_type in ("response", "revisit")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" if http else b""
    block += b"" if record_type == "revisit" else payload
    lines = [("WARC-Type", record_type), ("WARC-Record-ID", record_id), ("WARC-Date", EPOCH)]
    lines += [("WARC-Target-URI", target_uri.replace("\r", "%0D").replace("\n", "%0A"))] if target_uri else []
    if record_type == "revisit":
        lines += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    lines += [("WARC-Refers-To", refers_to)] if refers_to else []
    lines += [("WARC-Payload-Digest", payload_digest)] if payload_digest else []
    lines += [("X-Payload-Length", str(len(payload) if payload_length is None else payload_length))]
    lines += [("Content-Type", "application/http; msgtype=response" if http else "application/octet-stream"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_head(raw: bytes) -> dict[str, str]:
    """Headers of the block before the first empty line; names keep their case."""
    first, *lines = raw.decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no WARC record here: {first[:40]!r}")
    out, last = {}, None
    for line in lines:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            last, value = line.split(":", 1)
            out[last] = value.strip()
    return out


def payload_of(headers: dict[str, str], block: bytes) -> bytes:
    """What follows the HTTP head, where the block has one."""
    if "application/http" in headers.get("Content-Type", ""):
        head, found, rest = block.partition(b"\r\n\r\n")
        return rest if found else b""
    return block


class Source:
    """Bytes of one file with look-ahead; what was consumed is dropped a megabyte at a time."""

    PIECE = 1 << 20

    def __init__(self, file) -> None:
        self.file, self.held, self.at, self.over = file, bytearray(), 0, False

    def need(self, n: int) -> memoryview:
        """The next n bytes, or all that are left; they stay."""
        while len(self.held) - self.at < n and not self.over:
            if self.at >= self.PIECE:
                del self.held[: self.at]
                self.at = 0
            more = self.file.read(max(self.PIECE, n - len(self.held) + self.at))
            self.over = not more
            self.held += more
        return memoryview(bytes(self.held[self.at : self.at + n]))

    def take(self, n: int) -> bytes:
        """The next n bytes or fewer, consumed."""
        got = self.need(n).tobytes()
        self.at += len(got)
        return got

    def back(self, n: int) -> None:
        """Gives the last n consumed bytes back."""
        self.at -= n

    def drop(self, n: int) -> None:
        left = len(self.held) - self.at
        if n <= left:
            self.at += n
        else:
            self.file.seek(self.file.tell() + n - left)
            self.held, self.at = bytearray(), 0


def _head_end(raw) -> int:
    i = raw.find(b"\r\n\r\n")
    return -1 if i < 0 else i + 4


def _plain(source: Source, wanted) -> Iterator[tuple[dict, bytes | None]]:
    while True:
        n = 1 << 12
        while (end := _head_end(head := source.need(n).tobytes())) < 0:
            if len(head) < n:
                if head.strip():
                    raise ValueError("a WARC record is cut off")
                return
            n *= 2
        headers = parse_head(head[: end - 4])
        size = int(headers.get("Content-Length", 0))
        take, payload = wanted(headers)
        source.drop(end)
        if take and payload:
            block = source.take(size)
            yield headers, payload_of(headers, block)
        else:
            source.drop(size)
            if take:
                yield headers, None
        lead = source.need(4).tobytes()
        source.drop(4 if lead == b"\r\n\r\n" else len(lead) - len(lead.lstrip(b"\r\n")))


def _members(source: Source, wanted) -> Iterator[tuple[dict, bytes | None]]:
    """Members are inflated piece by piece; one whose payload is not wanted only until its headers end."""
    while len(lead := source.need(24).tobytes()) >= 18:
        known = lead[3] == 4 and lead[12:14] == b"sl"
        size = struct.unpack("<I", lead[16:20])[0] if known else 0
        inflate, used, take, payload, headers = zlib.decompressobj(31), 0, None, False, {}
        head, body = bytearray(), []
        skip = False
        while not inflate.eof and not skip:
            first = take is None
            piece = source.take(1 << 13 if first else 1 << 16)
            if not piece:
                raise ValueError("a gzip member is cut off")
            used += len(piece)
            got = inflate.decompress(piece)
            if first:
                head += got
                if (end := _head_end(head)) >= 0:
                    headers = parse_head(bytes(head[: end - 4]))
                    take, payload = wanted(headers)
                    body.append(bytes(head[end:]))
            elif take and payload:
                body.append(got)
            skip = known and take is not None and not (take and payload)
        if skip and not inflate.eof:
            source.drop(size - used) if size >= used else source.back(used - size)
        else:
            source.back(len(inflate.unused_data))
        if take:
            yield headers, payload_of(headers, b"".join(body)[: int(headers.get("Content-Length", 0))]) if payload else None


def records(file, wanted) -> Iterator[tuple[dict, bytes | None]]:
    """(headers, payload or None) of the records that wanted(headers) -> (take, payload) takes."""
    source = Source(file)
    return (_members if source.need(2).tobytes() == b"\x1f\x8b" else _plain)(source, wanted)


# -------------------------------------------------------------- the data source


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    path = path.replace("s3a://", "s3://", 1).replace("s3n://", "s3://", 1)  # the same store under the scheme that pyarrow knows
    return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))


@dataclass
class Files(InputPartition):
    paths: list[str]


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.schema, self.path, self.tests = schema, options["path"], []

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) else None
            if len(getattr(f, "attribute", ())) == 1 and name in HEADER_OF and name != "payload_length" and isinstance(f, EqualTo | In | StringStartsWith):
                said = [f.value] if isinstance(f, EqualTo | StringStartsWith) else list(f.value)
                self.tests.append((HEADER_OF[name], isinstance(f, StringStartsWith), said))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        system, root = _open(self.path)
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
        manifests = [f.path for f in found if f.base_name.startswith("_manifest-")]
        sizes = {f.path: f.size for f in found if f.is_file and f.base_name.endswith((".warc", ".warc.gz"))}
        if manifests:
            listed = {name for m in manifests for name in json.loads(system.open_input_file(m).readall())}
            sizes = {p: n for p, n in sizes.items() if p.rsplit("/", 1)[-1] in listed}
        out, held, total = [], [], 0
        for p in sorted(sizes):
            if held and total + sizes[p] > PARTITION_BYTES:
                out.append(Files(held))
                held, total = [], 0
            held.append(p)
            total += sizes[p]
        return [*out, Files(held)]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        system, _ = _open(self.path)
        kind = to_arrow_schema(self.schema)
        names = [f.name for f in self.schema]
        decode = "payload" in names

        def wanted(headers: dict) -> tuple[bool, bool]:
            for header, prefix, said in self.tests:
                value = headers.get(header)
                if value is None or not (any(value.startswith(s) for s in said) if prefix else value in said):
                    return False, False
            return True, decode

        def cell(name: str, headers: dict, payload: bytes | None):
            if name == "payload":
                return payload
            if name == "headers":
                return list(headers.items())
            value = headers.get(HEADER_OF[name])
            return int(value) if name == "payload_length" and value is not None else value

        rows, size = [], 0
        for path in partition.paths:
            with system.open_input_file(path) as file:
                for headers, payload in records(file, wanted):
                    rows.append([cell(n, headers, payload) for n in names])
                    size += len(payload or b"")
                    if size >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t.type) for i, t in enumerate(kind)], schema=kind)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t.type) for i, t in enumerate(kind)], schema=kind)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = _open(self.path)
        system.create_dir(root, recursive=True)
        names, file, size = [], None, 0
        try:
            for batch in iterator:
                for i in range(batch.num_rows):
                    said = {n: batch.column(n)[i].as_py() for n in WRITTEN}
                    if file is None or size > FILE_BYTES:
                        if file is not None:
                            file.close()
                        names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                        file, size = system.open_output_stream(f"{root}/{names[-1]}", compression=None), 0
                    piece = member(record(**said))
                    file.write(piece)
                    size += len(piece)
        finally:
            if file is not None:
                file.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _open(self.path)
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/_manifest-{uuid.uuid4().hex}.json", compression=None) as file:
            file.write(json.dumps([n for m in messages if m for n in m.files]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """Files that no manifest lists are not read; they may be deleted at leisure."""


class WarcDataSource(DataSource):
    """format("warc"): load a folder of archives, or append records to one."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        if overwrite:
            raise ValueError("archives are appended to; choose another folder instead of overwriting")
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


# ----------------------------------------------------------------- deduplication


def base32_of_hex(digest: Column) -> Column:
    """Upper-case base32 of 40 hex digits: four letters for each five digits."""
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")

    def letters(i: Column) -> Column:
        v = F.conv(F.substring(digest, i * 5 + 1, F.lit(5)), 16, 10).cast("int")
        return F.concat(*[F.substring(alphabet, F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)])

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), letters), "")


def to_records(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0) -> DataFrame:
    """Records to write: of equal payloads of least_bytes or more, the smallest key is a response, others revisit it.

    Payloads are compared by SHA-1 and length, counted with map-side sums; pages
    meet the verdict by key and payload, so a payload that a third of all pages
    share is no hot key for the pages themselves, and pages of one key but
    different payloads are judged apart.
    """
    raw = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    own = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), raw.alias("payload"))
    own = own.withColumns({"sha1": F.sha1("payload"), "n": F.octet_length("payload").cast("long")})
    narrow = materialize(own.select("key", "sha1", "n"), "warc-digests")
    first = narrow.where(F.col("n") >= least_bytes).groupBy("sha1", "n").agg(F.min("key").alias("first"), F.count("*").alias("c")).where("c > 1").drop("c")
    later = narrow.join(first, ["sha1", "n"]).where("key > first").select("key", "sha1", "n", "first").distinct()
    joined = own.join(later, ["key", "sha1", "n"], "left")  # a page without key is no later one
    again = F.col("first").isNotNull()
    urn = lambda c: F.when(c.isNotNull(), F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">")))
    return joined.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.coalesce(urn(F.col("key")), F.lit("<urn:page:>")).alias("record_id"),
        F.col("url").alias("target_uri"),
        urn(F.col("first")).alias("refers_to"),
        F.concat(F.lit("sha1:"), base32_of_hex(F.col("sha1"))).alias("payload_digest"),
        F.col("n").alias("payload_length"),
        F.when(again, F.lit(b"")).otherwise(F.col("payload")).alias("payload"),
    )


def write(records_df: DataFrame, path: str) -> None:
    register(records_df.sparkSession)
    records_df.select(*WRITTEN).write.format("warc").mode("append").save(path)


def read(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    register(spark)
    return spark.read.format("warc").schema(schema).load(path)


def digest_of(text: bytes) -> str:
    import hashlib

    return base64.b32encode(hashlib.sha1(text).digest()).decode()


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(to_records(read_table(spark, sf_dir, "pages")), path)
    page = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")
    responses = read(spark, path, "record_type string, record_id string, payload binary").where("record_type = 'response'")
    responses = responses.select(page("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), base32_of_hex(F.sha1("payload")).alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    revisits = read(spark, path, "record_type string, record_id string, refers_to string, payload_digest string, payload_length long").where("record_type = 'revisit'")
    revisits = revisits.select(page("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"), "record_type", page("refers_to").alias("refers_to"))
    return responses.unionByName(revisits)


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT html, min(page_id) AS first FROM p GROUP BY html),
h AS (SELECT p.page_id, strlen(p.html) AS n, sha1(p.html) AS x, g.first FROM p JOIN g USING (html)),
b AS (SELECT page_id, n, first, list_transform(range(8), lambda i: ('0x' || substr(x, (5 * i + 1)::INT, 5))::BIGINT) AS v FROM h)
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(v, lambda w: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((w >> 15) & 31) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((w >> 10) & 31) + 1, 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((w >> 5) & 31) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (w & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM b
"""
