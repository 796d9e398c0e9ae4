"""A streaming data source that follows growing, rotated logs by (file, byte).

A log file is known by its head: its header lines and its first row. So a file that is renamed when the log rotates stays
the same file, and the one that takes its name is a new one. An offset says how many bytes of each file have been read,
always up to the end of a line: a line that is still being written waits. Rows carry the field names of their file's
header, which may be megabytes before them. A file that shrinks is an error, not silence.
"""

from __future__ import annotations

import fnmatch
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

HEAD = 1 << 20  # bytes within which the header and the first row must end
CHUNK = 1 << 20
SPLIT = 32 << 20  # bytes of one partition


def opened(path: str):
    """(file system, path) of a folder or file by plain path or URI."""
    from pyarrow import fs

    if "://" not in path:
        path = path.replace("file:", "file://", 1) if path.startswith("file:") else f"file://{path}"
    return fs.FileSystem.from_uri(path)


def head_of(data: bytes) -> tuple[str, list[str]] | None:
    """(identity, field names) of a file by its first bytes; None before its first row is whole."""
    at, names = 0, []
    while (end := data.find(b"\n", at)) >= 0:
        line = data[at:end]
        if line.strip() and not line.startswith(b"#"):
            return hashlib.sha1(data[:end]).hexdigest()[:20], names
        if line.startswith(b"#fields"):
            names = line.decode("utf-8", "replace").rstrip("\r").split("\t")[1:]
        at = end + 1
    if at == 0 and len(data) >= HEAD or len(data) >= HEAD:
        raise ValueError("no row within the first megabyte of a log file")
    return None


def files(where, folder: str, pattern: str) -> Iterator[tuple[str, str, int]]:
    """(identity, path, size) of the files of a folder that hold a row."""
    from pyarrow import fs

    for info in where.get_file_info(fs.FileSelector(folder)):
        if info.type == fs.FileType.File and fnmatch.fnmatch(info.base_name, pattern):
            with where.open_input_file(info.path) as f:
                found = head_of(f.read(HEAD))
            if found:
                yield found[0], info.path, info.size


def whole_lines(where, path: str, begin: int, end: int) -> int:
    """The last byte position up to end, from begin, that ends a line."""
    with where.open_input_file(path) as f:
        while end > begin:
            at = max(begin, end - CHUNK)
            f.seek(at)
            cut = f.read(end - at).rfind(b"\n")
            if cut >= 0:
                return at + cut + 1
            end = at
    return begin


@dataclass
class Range(InputPartition):
    """Bytes of a file, from a line's start to a line's end."""

    identity: str
    path: str
    begin: int
    end: int


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder, self.pattern = options["path"], options.get("pattern", "*")

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        where, folder = opened(self.folder)
        found = {}
        for identity, path, size in files(where, folder, self.pattern):
            found[identity] = [path, whole_lines(where, path, 0, size)]
        return {"files": found}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        where, _ = opened(self.folder)
        out = []
        for identity, (path, upto) in sorted(end["files"].items()):
            at = start["files"].get(identity, [path, 0])[1]
            if upto < at:
                raise ValueError(f"{path} has shrunk from {at} to {upto} bytes")
            while at < upto:
                to = upto if upto - at <= SPLIT else whole_lines(where, path, at, at + SPLIT)
                to = upto if to == at else to  # a line longer than a split
                out.append(Range(identity, path, at, to))
                at = to
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        where, folder = opened(self.folder)
        path, names = self.located(where, folder, partition)
        with where.open_input_file(path) as f:
            f.seek(partition.begin)
            left, rest = partition.end - partition.begin, b""
            while left:
                data = f.read(min(CHUNK, left))
                left -= len(data)
                *lines, rest = (rest + data).split(b"\n")
                for line in lines:
                    if line.strip() and not line.startswith(b"#"):
                        yield line.decode("utf-8", "replace").rstrip("\r"), names, partition.identity

    def located(self, where, folder: str, partition: Range) -> tuple[str, list[str]]:
        """Where the file is now, as it may have been renamed since, and its field names."""
        from pyarrow import fs

        paths = [partition.path, *[i.path for i in where.get_file_info(fs.FileSelector(folder)) if i.type == fs.FileType.File and i.path != partition.path]]
        for path in paths:
            try:
                with where.open_input_file(path) as f:
                    found = head_of(f.read(HEAD))
            except FileNotFoundError:
                continue
            if found and found[0] == partition.identity:
                return path, found[1]
        raise FileNotFoundError(f"{partition.path} is gone before it was read")


class LogTail(DataSource):
    """Options: path (folder) and pattern (of file names)."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "value string, names array<string>, file string"

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)


def src_log_tail(spark, folder: str, *, pattern: str = "*"):
    """Stream of (value, names, file): rows of logs that grow and rotate in a folder, each once."""
    spark.dataSource.register(LogTail)
    return spark.readStream.format("log_tail").option("path", folder).option("pattern", pattern).load()
