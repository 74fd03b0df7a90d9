"""A data source of log lines with their places: ``spark.read.format("timberline_lines")``, also as a stream.

Files are cut into blocks, each a partition that is read once, on an executor. A line belongs to the block in which its first
byte lies. Rows: file_id, block (where the block begins), in_block (the line's number in it), at (the line's first byte), raw.
A stream reads what was added to files since the last batch, whole lines only; its offsets are the bytes taken of each file.

Options: ``path`` (a file or a folder, read with its subfolders), ``glob`` (of file names), ``blockBytes`` (64 MB),
``unterminated`` (for streams: ``wait``, the default, leaves a last line without a line end until that comes; ``take`` reads
it, for files that are complete).

Defined results: ``\\r`` before a line end is dropped, other ones are content, also at the end of an unterminated line. Empty
files give no lines. Bytes that aren't UTF-8 become U+FFFD. A file that became shorter than what was read gives no more lines
until it is longer again.
"""

from __future__ import annotations

import fnmatch
import json
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

BLOCK = 64 << 20
CHUNK = 4 << 20
SCHEMA = "file_id string, block long, in_block long, at long, raw string"


@dataclass
class Block(InputPartition):
    uri: str
    low: int
    high: int


NOTHING = Block("", 0, 0)


def _opened(uri: str):
    """(file system, path in it) of a URI or a local path."""
    from pyarrow import fs

    if uri.startswith("file:") or "://" not in uri:
        return fs.LocalFileSystem(), "/" + unquote(uri[5:].lstrip("/")) if uri.startswith("file:") else uri
    return fs.FileSystem.from_uri(uri)


def _listed(path: str, glob: str | None) -> list[tuple[str, int]]:
    """(URI, bytes) of the files that aren't empty, by name."""
    from pyarrow import fs

    system, inner = _opened(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    infos = system.get_file_info(fs.FileSelector(inner, recursive=True)) if info.type == fs.FileType.Directory else [info]
    local = isinstance(system, fs.LocalFileSystem)
    head = "file:" if local else path[: path.index("://") + 3]
    return sorted(
        (head + (quote(i.path) if local else i.path), i.size) for i in infos
        if i.type == fs.FileType.File and i.size and not i.base_name.startswith((".", "_")) and fnmatch.fnmatch(i.base_name, glob or "*")
    )


def lines_between(handle, low: int, high: int, whole: int | None = None) -> Iterator[tuple[int, bytes]]:
    """(first byte, text) of the lines that begin in ``low`` to ``high``; nothing behind byte ``whole`` is read."""
    at = max(low - 1, 0)
    handle.seek(at)
    rest, skip = b"", low > 0  # the line that runs into the block isn't its own
    while True:
        chunk = handle.read(CHUNK if whole is None else min(CHUNK, whole - at - len(rest)))
        parts = (rest + chunk).split(b"\n")
        rest = parts.pop()
        for part in parts:
            if not skip:
                if at >= high:
                    return
                yield at, part[:-1] if part.endswith(b"\r") else part
            skip = False
            at += len(part) + 1
        if not chunk:
            if rest and not skip and at < high:
                yield at, rest
            return
        if at >= high and not skip:
            return


def _batches(block: Block) -> Iterator:
    import pyarrow as pa

    if block == NOTHING:
        return
    system, path = _opened(block.uri)
    names = ["file_id", "block", "in_block", "at", "raw"]

    def made(first: int, ats: list[int], raws: list[str]) -> pa.RecordBatch:
        n = len(ats)
        return pa.RecordBatch.from_arrays([pa.array([block.uri] * n), pa.array([block.low] * n, pa.int64()), pa.array(range(first, first + n), pa.int64()), pa.array(ats, pa.int64()), pa.array(raws)], names=names)

    with system.open_input_file(path) as handle:
        first, ats, raws, held = 0, [], [], 0
        for at, text in lines_between(handle, block.low, block.high):
            ats.append(at)
            raws.append(text.decode("utf-8", "replace"))
            held += len(text)
            if len(ats) == 10_000 or held > CHUNK:
                yield made(first, ats, raws)
                first, ats, raws, held = first + len(ats), [], [], 0
        if ats:
            yield made(first, ats, raws)


def _cut(uri: str, low: int, high: int, size: int) -> list[Block]:
    return [Block(uri, k, min(k + size, high)) for k in range(low, high, size)]


class _Lines(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[Block]:
        size = int(self.options.get("blockBytes", BLOCK))
        return [b for uri, n in _listed(self.options["path"], self.options.get("glob")) for b in _cut(uri, 0, n, size)] or [NOTHING]

    def read(self, partition: Block) -> Iterator:
        return _batches(partition)


def _last_end(uri: str, size: int) -> int:
    """Where the last line end lies, looking back from the end in steps."""
    system, path = _opened(uri)
    with system.open_input_file(path) as handle:
        high = size
        while high > 0:
            low = max(0, high - (1 << 16))
            handle.seek(low)
            found = handle.read(high - low).rfind(b"\n")
            if found >= 0:
                return low + found + 1
            high = low
    return 0


class _Tail(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        take = self.options.get("unterminated", "wait") == "take"
        return {"files": json.dumps({uri: n if take else _last_end(uri, n) for uri, n in _listed(self.options["path"], self.options.get("glob"))}, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Block]:
        size = int(self.options.get("blockBytes", BLOCK))
        before = json.loads(start["files"])
        return [b for uri, n in json.loads(end["files"]).items() if n > before.get(uri, 0) for b in _cut(uri, before.get(uri, 0), n, size)] or [NOTHING]

    def read(self, partition: Block) -> Iterator:
        return _batches(partition)

    def commit(self, end: dict) -> None:
        pass


class LogLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "timberline_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Lines(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Tail(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LogLines)
