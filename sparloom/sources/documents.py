"""A folder of mixed files as a Python data source: one row a document, with where it stood in its file.

    spark.read.format("documents").load(folder)      after register(spark)

Rows are (path, suffix, file_idx, text, meta).  Files are listed once, in order of
names, filtered by a glob, dealt to ranks (file_idx modulo world) and packed into
partitions by their sizes; a filter on `suffix` is pushed down, so other files are
not opened.  A file is read as a stream in one task.

.json, .jsonl   more than one line and all begin with `{`: an object a line, numbered
                by `line` among lines that are not blank; else one object, or a list of
                objects by `index`; the text field is the text, all others are metadata
.csv, .tsv      with a header; the text column, or the first one, is the text; `row`
all others      the whole file, UTF-8, undecodable bytes dropped; empty ones left out

A faulty line ends its file and the rows before it stay (bad=stop), or is left out
(bad=skip).  An empty cell of a table reads `nan`.
"""

from __future__ import annotations

import csv
import fnmatch
import io
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

SCHEMA = "path string, suffix string, file_idx long, text string, meta map<string,string>"
#: Bytes of files that a partition is meant to read; characters and rows of a batch.
PARTITION_BYTES, BATCH_CHARS, BATCH_ROWS = 32 << 20, 1 << 20, 1_000
JSON, TABLES = {"json", "jsonl"}, {"csv": ",", "tsv": "\t"}

Row = tuple[str, dict[str, str]]


@dataclass
class Files(InputPartition):
    """(path, suffix, place among all files) of one partition."""

    files: list[tuple[str, str, int]]

    def __init__(self, files: list[tuple[str, str, int]]) -> None:
        super().__init__(None)
        self.files = files


def _suffix(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[-1].lower() if "." in name else ""


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _fields(record: dict, keys: list[str], place: dict[str, str]) -> Row:
    """The first text field that says something, and all fields that are no text field."""
    text = next((str(record[k]) for k in keys if str(record.get(k) or "").strip()), str(record.get(keys[0]) or ""))
    return text, {str(k): str(v) for k, v in record.items() if k not in keys} | place


def json_rows(lines: Iterator[str], again, keys: list[str], skip: bool) -> Iterator[Row]:
    """Rows of a JSON file; lines: its lines, again(): them once more."""
    n, objects = 0, True
    for line in lines:
        line = line.strip()
        if line:
            n, objects = n + 1, objects and line.startswith("{")
    if n > 1 and objects:
        for i, line in enumerate(x for x in map(str.strip, again()) if x):
            try:
                record = json.loads(line)
            except ValueError:
                if skip:
                    continue
                return
            yield _fields(record, keys, {"line": str(i)})
        return
    try:
        held = json.loads("".join(again()))
    except ValueError:
        return
    if isinstance(held, dict):
        yield _fields(held, keys, {})
    for i, record in enumerate(held if isinstance(held, list) else []):
        if isinstance(record, dict):
            yield _fields(record, keys, {"index": str(i)})


def table_rows(lines: Iterator[str], sep: str, column: str) -> Iterator[Row]:
    rows = csv.reader(lines, delimiter=sep)
    header = next(rows, None)
    if not header:
        return
    at = header.index(column) if column in header else 0
    for i, row in enumerate(rows):
        cells = [c if c != "" else "nan" for c in row] + ["nan"] * (len(header) - len(row))
        if row:
            yield cells[at], {h: c for h, c in zip(header, cells, strict=False) if h != header[at]} | {"row": str(i)}


class DocumentReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        get = lambda k, d: options.get(k.lower(), options.get(k, d))
        self.path, self.glob = options["path"], get("glob", "*")
        self.keys, self.column = get("textKey", "text").split(","), get("textColumn", "text")
        self.rank, self.world = int(get("rank", "0")), max(1, int(get("world", "1")))
        self.recursive, self.skip = get("recursive", "false") == "true", get("bad", "stop") == "skip"
        self.separator = get("separator", None)
        self.wanted: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  Spark's name
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("suffix",):
                told = {f.value}
            elif isinstance(f, In) and f.attribute == ("suffix",):
                told = set(f.value)
            else:
                yield f
                continue
            self.wanted = told if self.wanted is None else self.wanted & told

    def listed(self) -> list[tuple[str, str, int, int]]:
        """(path, suffix, place, bytes) of this rank's files."""
        system, root = _open(self.path)
        info = system.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(f"input path does not exist: {self.path}")
        if info.type == fs.FileType.Directory:
            held = system.get_file_info(fs.FileSelector(root, recursive=self.recursive))
            inner = lambda p: p.removeprefix(root).lstrip("/")
            held = [x for x in held if x.type == fs.FileType.File and not any(s.startswith(("_", ".")) for s in inner(x.path).split("/"))]
            held = sorted((x for x in held if fnmatch.fnmatch(x.path.rsplit("/", 1)[-1], self.glob)), key=lambda x: x.path)
        else:
            held = [info]
        found = [(x.path, _suffix(x.path), i, max(x.size or 0, 1)) for i, x in enumerate(held) if i % self.world == self.rank]
        return [x for x in found if self.wanted is None or x[1] in self.wanted]

    def partitions(self) -> list[Files]:
        out, size = [Files([])], 0
        for path, suffix, place, n in self.listed():
            if out[-1].files and size + n > PARTITION_BYTES:
                out.append(Files([]))
                size = 0
            out[-1].files.append((path, suffix, place))
            size += n
        return out

    def rows(self, system: fs.FileSystem, path: str, suffix: str) -> Iterator[Row]:
        def lines(newline: str | None = None) -> Iterator[str]:
            with system.open_input_stream(path) as raw, io.TextIOWrapper(io.BufferedReader(raw, 1 << 16), "utf-8", "ignore", newline) as text:
                yield from text

        if suffix in JSON:
            yield from json_rows(lines(), lines, self.keys, self.skip)
        elif suffix in TABLES:
            yield from table_rows(lines(""), self.separator or TABLES[suffix], self.column)
        elif text := "".join(lines()):
            yield text, {}

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.string())]
        schema = pa.schema([pa.field(f.split()[0], k) for f, k in zip(SCHEMA.split(", "), kinds, strict=True)])
        system, _ = _open(self.path)
        held: list[tuple] = []
        size = 0

        def ready() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], schema=schema)

        for path, suffix, place in partition.files:
            for text, meta in self.rows(system, path, suffix):
                held.append((path, suffix, place, text, list((meta | {"source_file": path}).items())))
                size += len(text)
                if size >= BATCH_CHARS or len(held) >= BATCH_ROWS:
                    yield ready()
                    held, size = [], 0
        if held:
            yield ready()


class DocumentSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DocumentReader:
        return DocumentReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DocumentSource)


def read_documents(spark: SparkSession, path: str, **options) -> DataFrame:
    """The folder's documents; options: glob, recursive, textKey, textColumn, separator (of tables, whatever their suffix), rank, world, bad."""
    register(spark)
    return spark.read.format("documents").options(**{k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items()}).load(path)


def read_question_files(spark: SparkSession, path: str, **options) -> DataFrame:
    """(query_id, query): a text file is one question, a JSON record its `query`, else its `text`; blank ones and faulty lines are left out.

    Ids are the file's path with #lineN or #idxN where a file has several.
    """
    rows = read_documents(spark, path, textKey="query,text", bad="skip", **options)
    place = F.coalesce(F.concat(F.lit("#line"), F.col("meta")["line"]), F.concat(F.lit("#idx"), F.col("meta")["index"]), F.lit(""))
    return rows.select(F.concat("path", place).alias("query_id"), F.trim("text").alias("query")).where("query <> ''")
