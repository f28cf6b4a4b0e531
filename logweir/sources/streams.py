"""Log files as a data source: opened as streams, known as gzip by their bytes, hashed and counted in the pass that reads them."""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..plans.stage import once
from .lines import BLOCK, FREE, MAX_INPUTS, MAX_LINE, SOURCE_STEP, ExpansionError

#: Bytes of lines in a batch.
BATCH = 4 << 20

_SCHEMA = pa.schema([
    ("source_ordinal", pa.int32()), ("path", pa.string()), ("line_no", pa.int64()), ("line", pa.string()), ("line_code", pa.string()), ("compressed", pa.bool_()),
    ("bytes", pa.int64()), ("expanded_bytes", pa.int64()), ("lines", pa.int64()), ("sha256", pa.string()), ("error", pa.string()),
])
LIMIT = "expansion limit exceeded"


@dataclass
class File(InputPartition):
    ordinal: int
    path: str
    size: int
    limit: int


def located(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path within it; a path without a scheme is local to the machine."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (fs.LocalFileSystem(), path)


class Stream:
    """A file's expanded content in blocks of at most BLOCK bytes. Beside the block only what gzip keeps is held, however
    large the file; `bytes`, `expanded` and `digest` grow with what was read."""

    def __init__(self, path: str, limit: int, ratio: int):
        self.path, self.limit, self.ratio = path, limit, ratio
        self.compressed, self.bytes, self.expanded, self.digest = False, 0, 0, hashlib.sha256()

    def _raw(self) -> Iterator[bytes]:
        system, path = located(self.path)
        with system.open_input_stream(path, compression=None) as f:
            while block := f.read(BLOCK):
                self.bytes += len(block)
                self.digest.update(block)
                yield block

    def _checked(self, block: bytes) -> bytes:
        """Counts a block that is within the limits; no other is handed on."""
        grown = self.expanded + len(block)
        if grown > self.limit or self.compressed and grown > max(FREE, self.ratio * self.bytes):
            raise ExpansionError(LIMIT)
        self.expanded = grown
        return block

    def blocks(self) -> Iterator[bytes]:
        """Streams of one file follow each other; one that is cut off or followed by anything else is invalid."""
        raw = self._raw()
        left = next(raw, b"")
        while 0 < len(left) < 2 and (more := next(raw, b"")):
            left += more
        self.compressed = left[:2] == b"\x1f\x8b"
        if not self.compressed:
            while left:
                yield self._checked(left)
                left = next(raw, b"")
            return
        while left or (left := next(raw, b"")):
            stream = zlib.decompressobj(31)
            while not stream.eof:
                left = left or next(raw, b"")
                if not left:
                    raise ValueError("invalid gzip stream")
                try:
                    block = stream.decompress(left, BLOCK)
                except zlib.error:
                    raise ValueError("invalid gzip stream") from None
                left = stream.unconsumed_tail
                if block:
                    yield self._checked(block)
            left = stream.unused_data


def split_lines(blocks: Iterator[bytes], max_line: int) -> Iterator[tuple[str, str | None]]:
    """(line, code) of each line. Lines end with LF, one CR before it goes; of a line longer than `max_line` nothing is kept."""
    rest, skipping = b"", False
    for block in blocks:
        *whole, rest = (rest + block).split(b"\n")
        if skipping and whole:
            whole, skipping = whole[1:], False
        for x in whole:
            yield _line(x, max_line)
        if len(rest) > max_line + 1:
            if not skipping:
                yield "", "line_too_long"
            rest, skipping = b"", True
    if rest and not skipping:
        yield _line(rest, max_line)


def _line(x: bytes, max_line: int) -> tuple[str, str | None]:
    x = x.removesuffix(b"\r")
    return ("", "line_too_long") if len(x) > max_line else (x.decode("utf-8", "replace"), None if x else "empty_line")


def planned(paths: list[str], max_bytes: int) -> list[File]:
    """A partition for each file. What plain files take of the cap is known before anything is read."""
    out = []
    for i, path in enumerate(paths):
        system, inside = located(path)
        info = system.get_file_info(inside)
        if info.type != fs.FileType.File or isinstance(system, fs.LocalFileSystem) and os.path.islink(inside):
            raise ValueError(f"source {i}: input must be a regular file")
        with system.open_input_stream(inside, compression=None) as f:
            plain = f.read(2) != b"\x1f\x8b"
        out.append((i, path, info.size, plain))
    left = max_bytes - sum(size for _, _, size, plain in out if plain)
    if left < 0:
        raise ExpansionError(LIMIT)
    return [File(i, path, size, size if plain else left) for i, path, size, plain in out]


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths, self.max_bytes = json.loads(options["files"]), int(options["max_bytes"])
        self.ratio, self.max_line = int(options["max_ratio"]), int(options["max_line"])

    def partitions(self) -> list[File]:
        return planned(self.paths, self.max_bytes)

    def read(self, file: File) -> Iterator[pa.RecordBatch]:
        """The file's lines, then one row of facts under a null line number."""
        stream, n, error = Stream(file.path, file.limit, self.ratio), 0, None
        kept: list[tuple[str, str | None]] = []
        size = 0

        def batch() -> pa.RecordBatch:
            columns = {"source_ordinal": [file.ordinal] * len(kept), "line_no": range(n - len(kept), n), "line": [x for x, _ in kept], "line_code": [c for _, c in kept]}
            return pa.record_batch([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(len(kept), f.type) for f in _SCHEMA], schema=_SCHEMA)

        try:
            for one in split_lines(stream.blocks(), self.max_line):
                kept.append(one)
                n, size = n + 1, size + len(one[0]) + 16
                if size >= BATCH:
                    yield batch()
                    kept, size = [], 0
            if stream.bytes != file.size:
                raise ValueError("input changed while it was read")
        except ValueError as e:
            error = str(e)
        if kept:
            yield batch()
        facts = (file.ordinal, file.path, None, None, None, stream.compressed, stream.bytes, stream.expanded, n, stream.digest.hexdigest(), error)
        yield pa.record_batch([pa.array([v], f.type) for v, f in zip(facts, _SCHEMA, strict=True)], schema=_SCHEMA)


class LogFiles(DataSource):
    """`format("logfiles")` with the options files (a JSON list of paths), max_bytes, max_ratio and max_line."""

    @classmethod
    def name(cls) -> str:
        return "logfiles"

    def schema(self) -> str:
        return "source_ordinal int, path string, line_no bigint, line string, line_code string, compressed boolean, bytes bigint, expanded_bytes bigint, lines bigint, sha256 string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def _files(path: str) -> list[str]:
    """The path itself, or a folder's files in the order of their names; names with a leading dot or underscore are no data."""
    system, inside = located(path)
    if system.get_file_info(inside).type != fs.FileType.Directory:
        return [path]
    names = sorted(x.base_name for x in system.get_file_info(fs.FileSelector(inside)) if x.type == fs.FileType.File and x.base_name[0] not in "._")
    return [f"{path.rstrip('/')}/{name}" for name in names]


def _read(spark: SparkSession, paths: list[str], max_bytes: int, max_ratio: int, max_line: int) -> DataFrame:
    files = [f for path in paths for f in _files(path)]
    if not 1 <= len(files) <= MAX_INPUTS:
        raise ValueError(f"{len(files)} inputs; 1 to {MAX_INPUTS} are read at a time")
    planned(files, max_bytes)  # what is refused before a job runs is raised here
    spark.dataSource.register(LogFiles)
    options = {"files": json.dumps(files), "max_bytes": str(max_bytes), "max_ratio": str(max_ratio), "max_line": str(max_line)}
    return once(spark.read.format("logfiles").options(**options).load(), "sources")


def read_sources(spark: SparkSession, paths: list[str], max_bytes: int = 1 << 34, max_ratio: int = 200, max_line: int = MAX_LINE) -> tuple[DataFrame, DataFrame]:
    """Lines (seq, source_ordinal, line, line_code) and facts (source_ordinal, path, compressed, bytes, expanded_bytes,
    lines, sha256) of the files at `paths` and in folders there, in this order; each is plain or gzip by its first two bytes, whatever its name.

    One pass reads, hashes, counts and writes the lines to the shared folder, where they are split as Spark likes: a gzip
    file is one task in that pass only. `max_bytes` holds for all files together. What plain files take is left out of what
    a gzip file may expand to; the sum is held against the cap before any line is handed on. Until then no file expands
    beyond the cap or `max_ratio` times what was read of it, so what is written is bounded as well. A file that is cut off,
    has changed or grows beyond its limits is an error, and no lines come back."""
    rows = _read(spark, paths, max_bytes, max_ratio, max_line)
    facts = rows.where("line_no IS NULL").select("source_ordinal", "path", "compressed", "bytes", "expanded_bytes", "lines", "sha256", "error")
    total = 0
    for r in facts.orderBy("source_ordinal").collect():  # at most MAX_INPUTS
        total += r["expanded_bytes"]
        if r["error"] == LIMIT or total > max_bytes:
            raise ExpansionError(f"source {r['source_ordinal']}: {LIMIT}")
        if r["error"]:
            raise ValueError(f"source {r['source_ordinal']}: {r['error']}")
    seq = (F.col("source_ordinal") * F.lit(SOURCE_STEP) + F.col("line_no")).alias("seq")
    return rows.where("line_no IS NOT NULL").select(seq, "source_ordinal", "line", "line_code"), facts.drop("error")


def source_facts(spark: SparkSession, paths: list[str], max_bytes: int = 1 << 34, max_ratio: int = 200) -> DataFrame:
    """Facts of each file as in `read_sources`, with error in place of an exception: what can't be read to its end is told
    of, for each file by itself."""
    rows = _read(spark, paths, max_bytes, max_ratio, MAX_LINE)
    return rows.where("line_no IS NULL").select("source_ordinal", "path", "compressed", "bytes", "expanded_bytes", "lines", "sha256", "error")
