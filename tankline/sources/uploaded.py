"""A Spark data source for uploaded CSV files, for batches and streams.

Every file is read under its own header. The files are cut into ranges of ``block`` bytes; the task
that reads a range first reads the header from the beginning of the file (at least HEAD bytes), then the
lines that begin in its range. So all bytes are read once, by many tasks, whatever the headers are, and
no pass over the data comes before. Fields may not hold line breaks. Compressed files (by the end of their
name) have one range.

Rows are text: the wanted columns, ``_corrupt_record`` (the line, where it has too many or too few
fields; the others are NULL then), ``_seq`` (number of the file by time of change and path, then the
place in it), ``_file`` and ``_changed`` (microseconds). Paths are files, folders (read with all below
them, but names that begin with ``_`` or ``.``) or patterns, in any store Arrow knows (STORES).

As a stream the source takes every file once. The driver lists the folder and writes the new files to a
log in the shared folder, one entry for each batch, before the batch begins: an offset is a number of
entries, so a batch that runs again reads the same files, and a file that arrives late or with an
old time is not missed. A file must be whole when it gets its name.
"""

from __future__ import annotations

import csv
import fnmatch
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.csv as pacsv
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

HEAD = 64 << 10  # bytes read at first to find the header
CHUNK = 8 << 20  # bytes parsed at once
BLOCK = 128 << 20  # bytes of a range
#: schemes of paths that tasks can open themselves
STORES = ("file", "hdfs", "s3", "s3a", "s3n", "gs", "gcs", "abfs", "abfss")
MISSING = "missing columns:"
_PACKED = {".gz": "gzip", ".bz2": "bz2", ".zst": "zstd", ".lz4": "lz4"}
ROW = ("_corrupt_record", "_seq", "_file", "_changed")


def readable(path: str) -> bool:
    scheme, found, _ = path.partition(":")
    return not found or "/" in scheme or scheme in STORES


def store_of(path: str) -> tuple[pafs.FileSystem, str, str]:
    """File system, path in it, and what to put before such a path to name it again."""
    scheme, _, rest = path.partition(":")
    if "/" in scheme or not rest:
        return pafs.LocalFileSystem(), path, ""
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/"), "file://"
    host = rest.lstrip("/").partition("/")[0]
    if scheme == "hdfs":
        return pafs.HadoopFileSystem.from_uri(f"hdfs://{host}"), "/" + rest.lstrip("/").partition("/")[2], f"hdfs://{host}"
    system, _ = pafs.FileSystem.from_uri(f"{ {'s3a': 's3', 's3n': 's3'}.get(scheme, scheme)}://{host}")
    return system, rest.lstrip("/"), f"{scheme}://"


@dataclass(frozen=True)
class File:
    path: str
    size: int
    changed: int  # microseconds


def listed(paths: list[str], lenient: bool = False) -> list[File]:
    """Files that are not empty, by time of change and path. A path that is not there raises, unless ``lenient``."""
    out = []
    for path in paths:
        system, inner, before = store_of(path.rstrip("/") or "/")
        wild = next((k for k, part in enumerate(inner.split("/")) if any(c in part for c in "*?[")), None)
        if wild is None:
            info = system.get_file_info(inner)
            if info.type == pafs.FileType.NotFound:
                if lenient:
                    continue
                raise FileNotFoundError(path)
            # names below the path that the caller gave may not be hidden
            root, found = inner, [info] if info.is_file else system.get_file_info(pafs.FileSelector(inner, recursive=True))
        else:
            root = "/".join(inner.split("/")[:wild])
            depth = len(inner.split("/"))
            match = lambda p: all(map(fnmatch.fnmatchcase, p.split("/")[:depth], inner.split("/"))) and len(p.split("/")) >= depth
            found = [i for i in system.get_file_info(pafs.FileSelector(root or "/", recursive=True, allow_not_found=True)) if match(i.path)]
        for i in found:
            hidden = any(part[:1] in "_." for part in i.path[len(root) :].split("/") if part)
            if i.is_file and i.size and not hidden:
                out.append(File(before + i.path, i.size, i.mtime_ns // 1000))
    return sorted(set(out), key=lambda f: (f.changed, f.path))


@dataclass(frozen=True)
class Range(InputPartition):
    file: File
    number: int
    start: int
    end: int


def ranges(files: list[File], block: int, first: int = 0) -> list[Range]:
    out = []
    for number, f in enumerate(files, first):
        step = f.size if packing(f.path) else block
        out += [Range(f, number, at, min(at + step, f.size)) for at in range(0, f.size, step)]
    return out


def packing(path: str) -> str | None:
    return next((kind for end, kind in _PACKED.items() if path.endswith(end)), None)


def _header(head: bytes, columns: list[str]) -> tuple[int, list[int], str | None]:
    """Fields of the header line, which of them are the wanted columns, and what is wrong."""
    names = next(csv.reader([head.decode("utf-8-sig", "replace").rstrip("\r\n")]), [])
    missing = [c for c in columns if c not in names]
    return len(names), [names.index(c) for c in columns if c in names], f"{MISSING} {', '.join(missing)}" if missing else None


def read_range(part: Range, columns: list[str], lenient: bool = False) -> Iterator[pa.RecordBatch]:
    """The rows of the lines that begin in a range. A file without the wanted columns raises; if ``lenient`` it
    gives one row that says so in ``_corrupt_record``."""
    system, inner, _ = store_of(part.file.path)
    kind = packing(part.file.path)
    with system.open_input_file(inner) as plain, pa.CompressedInputStream(plain, kind) if kind else plain as f:
        head = _upto_break(f)
        line, _, data = head.partition(b"\n")
        width, place, wrong = _header(line, columns)
        if wrong and not lenient:
            raise ValueError(f"{wrong} in {part.file.path}")
        if wrong:
            if part.start == 0:
                yield _batch([pa.nulls(1, pa.string()) for _ in columns], pa.array([wrong]), pa.array([part.number << 42], pa.int64()), columns, part)
            return
        at, stop = len(line) + 1, None if kind else part.end
        if part.start > at:
            # skip to the first line break from the byte before: a line belongs to the range of its first byte
            f.seek(part.start - 1)
            head = _upto_break(f)
            line, _, data = head.partition(b"\n")
            at = part.start + len(line)
        for place_of, lines in _whole_lines(f, data, at, stop):
            yield from _parsed(lines, width, place, columns, part, place_of)


def _upto_break(f) -> bytes:
    data = b""
    while b"\n" not in data and (more := f.read(HEAD)):
        data += more
    return data


def _whole_lines(f, data: bytes, at: int, stop: int | None) -> Iterator[tuple[int, bytes]]:
    """(place, lines) from byte ``at`` to the line that holds byte ``stop - 1``, or to the end. data: what is read of them already."""
    more = b"."
    while more and (stop is None or at < stop):
        cut = 0 if stop is None or len(data) < stop - at else data.find(b"\n", stop - at - 1) + 1
        if not cut:
            more = f.read(CHUNK if stop is None else min(CHUNK, max(stop - at - len(data), HEAD)))
            data += more
            last = stop is not None and len(data) >= stop - at
            cut = (data.find(b"\n", stop - at - 1) if last else data.rfind(b"\n")) + 1
            if not more and not (last and cut):
                cut = len(data)
        if cut:
            yield at, data[:cut]
            at, data = at + cut, data[cut:]


def _parsed(data: bytes, width: int, place: list[int], columns: list[str], part: Range, at: int) -> Iterator[pa.RecordBatch]:
    bad: list[str] = []

    def keep(row) -> str:
        bad.append(row.text)
        return "skip"

    try:
        data.decode()
    except UnicodeDecodeError:
        data = data.decode("utf-8", "replace").encode()
    names = [f"c{k}" for k in range(width)]
    table = None
    if data.strip(b"\r\n"):
        table = pacsv.read_csv(
            pa.BufferReader(data),
            pacsv.ReadOptions(column_names=names, block_size=len(data) + 1, use_threads=False),
            pacsv.ParseOptions(invalid_row_handler=keep),
            pacsv.ConvertOptions(column_types=dict.fromkeys(names, pa.string()), strings_can_be_null=True, null_values=[""], quoted_strings_can_be_null=False, include_columns=[names[k] for k in dict.fromkeys(place)]),
        )
    base = (part.number << 42) + at
    for lo in range(0, table.num_rows if table else 0, 100_000):
        some = table.slice(lo, 100_000).combine_chunks()
        n = some.num_rows
        yield _batch([some.column(names[k]).combine_chunks() for k in place], pa.nulls(n, pa.string()), pa.array(range(base + lo, base + lo + n), pa.int64()), columns, part)
    if bad:
        n = len(bad)
        yield _batch([pa.nulls(n, pa.string()) for _ in place], pa.array(bad, pa.string()), pa.array(range(base, base + n), pa.int64()), columns, part)


def _batch(values: list[pa.Array], corrupt: pa.Array, seq: pa.Array, columns: list[str], part: Range) -> pa.RecordBatch:
    values = [v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v for v in values]
    n = len(seq)
    return pa.RecordBatch.from_arrays([*values, corrupt, seq, pa.array([part.file.path] * n, pa.string()), pa.array([part.file.changed] * n, pa.int64())], names=[*columns, *ROW])


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.paths, self.columns, self.block = json.loads(options["paths"]), json.loads(options["columns"]), int(options.get("block", BLOCK))
        self.lenient = options.get("lenient", "false") == "true"

    def partitions(self):
        return ranges(listed(self.paths, self.lenient), self.block)

    def read(self, partition):
        if partition is not None:
            yield from read_range(partition, self.columns, self.lenient)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options):
        self.paths, self.columns, self.block = json.loads(options["paths"]), json.loads(options["columns"]), int(options.get("block", BLOCK))
        self.system, self.log, _ = store_of(options["log"])
        self.seen: set[File] | None = None

    def _entry(self, n: int) -> str:
        return f"{self.log}/{n:012d}.json"

    def _read(self, n: int) -> list[File]:
        with self.system.open_input_file(self._entry(n)) as f:
            return [File(*x) for x in json.loads(f.read())]

    def initialOffset(self) -> dict:
        return {"entries": 0}

    def latestOffset(self) -> dict:
        if self.seen is None:
            self.system.create_dir(self.log, recursive=True)
            names = sorted(i.path.rsplit("/", 1)[1] for i in self.system.get_file_info(pafs.FileSelector(self.log)))
            self.entries = sum(n.endswith(".json") for n in names)
            self.seen = {f for n in range(self.entries) for f in self._read(n)}
        try:
            new = [f for f in listed(self.paths) if f not in self.seen]
        except FileNotFoundError:
            new = []
        if new:
            with self.system.open_output_stream(self._entry(self.entries) + ".tmp") as f:
                f.write(json.dumps([[x.path, x.size, x.changed] for x in new]).encode())
            self.system.move(self._entry(self.entries) + ".tmp", self._entry(self.entries))
            self.seen.update(new)
            self.entries += 1
        return {"entries": self.entries}

    def partitions(self, start: dict, end: dict):
        return ranges([f for n in range(start["entries"], end["entries"]) for f in self._read(n)], self.block)

    def read(self, partition):
        yield from read_range(partition, self.columns)

    def commit(self, end: dict) -> None:
        pass


class UploadedCsv(DataSource):
    """Options: paths and columns (JSON lists), block (bytes of a range), of a batch lenient, of a stream log (a folder)."""

    @classmethod
    def name(cls) -> str:
        return "uploaded_csv"

    def schema(self) -> T.StructType:
        return row_schema(json.loads(self.options["columns"]))

    def reader(self, schema):
        return _Reader(self.options)

    def streamReader(self, schema):
        return _StreamReader(self.options)


def row_schema(columns: list[str]) -> T.StructType:
    kinds = dict.fromkeys(("_seq", "_changed"), T.LongType())
    return T.StructType([T.StructField(c, kinds.get(c, T.StringType())) for c in (*columns, *ROW)])


def read_uploaded(spark: SparkSession, paths: list[str], columns: list[str], block: int = BLOCK, lenient: bool = False) -> DataFrame:
    spark.dataSource.register(UploadedCsv)
    return spark.read.format("uploaded_csv").options(paths=json.dumps(paths), columns=json.dumps(columns), block=block, lenient=lenient).load()


def stream_uploaded(spark: SparkSession, path: str, columns: list[str], log: str, block: int = BLOCK) -> DataFrame:
    spark.dataSource.register(UploadedCsv)
    return spark.readStream.format("uploaded_csv").options(paths=json.dumps([path]), columns=json.dumps(columns), log=log, block=block).load()
