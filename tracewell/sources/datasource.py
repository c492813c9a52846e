"""Transcripts as a data source of Spark: ``spark.read`` and ``spark.readStream`` with ``.format("transcripts")``.

Rows are lines as ``transcripts.numbered_lines`` takes them: path, block (where in
the file the reading task began), nth (byte at which the line begins) and value.
In batch a file is cut into blocks of ``blockBytes``, each a partition. As a
stream, a file that is new or has changed is read again up to the size it had when
the batch was planned: transcripts grow while their session runs, and the usual
file stream reads a file only once. The offset is the size and time of each file
below the roots. Options: ``path`` (roots, comma-separated), ``suffix`` and
``blockBytes``. Files are opened by pyarrow, so any of its file systems will do;
all executors must reach them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tracewell.sources import transcripts as T

SCHEMA = "path string, block long, nth long, value string"
BLOCK, CHUNK, ROWS = 128 << 20, 1 << 20, 4096


class Block(InputPartition):
    def __init__(self, path: str, start: int, end: int, size: int):
        self.path, self.start, self.end, self.size = path, start, end, size


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def listed(options: dict[str, str]) -> dict[str, list[int]]:
    """path -> size and time of change of every file below the roots."""
    from pyarrow import fs

    out = {}
    for root in options["path"].split(","):
        files, path = _opened(root)
        scheme = root.split("://")[0] + "://" if "://" in root else ""
        for f in files.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True)):
            if f.is_file and f.path.endswith(options.get("suffix", ".jsonl")):
                out[scheme + f.path] = [f.size, f.mtime_ns or 0]
    return out


def blocks(files: dict[str, list[int]], options: dict[str, str]) -> list[Block]:
    step = int(options.get("blockBytes", BLOCK))
    return [Block(path, at, min(at + step, size), size) for path, (size, _) in sorted(files.items()) for at in range(0, size, step)]


def lines_of(block: Block) -> Iterator[tuple[int, bytes]]:
    """(byte, line) of the lines that begin in the block; the last one may end beyond it, but not beyond the size that was planned."""
    files, path = _opened(block.path)
    with files.open_input_file(path) as f:
        at = block.start - 1 if block.start else 0
        f.seek(at)
        held, skip = b"", bool(block.start)  # a block that doesn't begin a line leaves its first piece to the one before
        while at < block.end:
            more = f.read(min(CHUNK, block.size - at - len(held)))
            *whole, held = (held + more).split(b"\n")
            if not more:
                whole, held = [held], b""
            for line in whole:
                if not skip and at < block.end and (line or more):
                    yield at, line
                skip = False
                at += len(line) + 1
            if not more:
                return


def read(block: Block) -> Iterator[pa.RecordBatch]:
    names, rows = ["path", "block", "nth", "value"], []

    def packed() -> pa.RecordBatch:
        at, text = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array([block.path] * len(rows), pa.string()), pa.array([block.start] * len(rows), pa.int64()), pa.array(at, pa.int64()), pa.array(text, pa.string())], names=names)

    held = 0
    for at, line in lines_of(block):
        rows.append((at, line.decode("utf-8", "replace")))
        held += len(line)
        if len(rows) == ROWS or held > CHUNK:
            yield packed()
            rows, held = [], 0
    if rows:
        yield packed()


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> Sequence[Block]:
        return blocks(listed(self.options), self.options)

    def read(self, partition: Block) -> Iterator[pa.RecordBatch]:
        return read(partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return listed(self.options)

    def partitions(self, start: dict, end: dict) -> Sequence[Block]:
        return blocks({path: f for path, f in end.items() if start.get(path) != f}, self.options)

    def read(self, partition: Block) -> Iterator[pa.RecordBatch]:
        return read(partition)


class Transcripts(DataSource):
    @classmethod
    def name(cls) -> str:
        return "transcripts"

    def schema(self) -> str:
        return SCHEMA

    def _given(self) -> dict[str, str]:
        # Option names come in lower case.
        return {k: self.options[k] for k in ("path", "suffix", "blockBytes") if self.options.get(k) is not None}

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self._given())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self._given())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Transcripts)


def parsed(spark: SparkSession, source: str, root: str, **options: str) -> tuple[DataFrame, DataFrame]:
    """(sessions, events) of the files below ``root`` by the parser that is registered as ``source``."""
    register(spark)
    return T.parse(source, T.numbered_lines(spark.read.format("transcripts").options(path=root, **options).load()))
