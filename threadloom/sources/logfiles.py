"""Session files as a data source of Spark's: lines byte for byte, in splits, as a stream, and back by commit.

``spark.read.format("session_logs").load(folder)`` has a row for each line of every ``*.jsonl`` below the folder:
session_id (the file's path below the folder), pos (the byte at which the line begins), raw (its bytes without
the line feed) and ended (whether it has one; only a last line may not). Large files are cut into splits; a line
belongs to the split in which it begins. As a stream the source reads what is appended, up to the last line
feed that is there.

``df.write.format("session_logs").mode("overwrite").save(folder)`` writes each session to a temporary file beside
its place. Only when all tasks are done are the files renamed, one after another, each old one kept as ``.bak`` if
there is none yet; a failed job leaves all old files and no temporary ones. A session's rows must be in one
task and in order (``laid_out``). Lines that aren't JSON fail the job if ``validate`` is set.

Files are reached by pyarrow's file systems, from driver and executors alike, so the folder must be shared. For
stores that only Spark reads there is ``jsonl.read_sessions``.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from threadloom.sources.jsonl import entries

NAME = "session_logs"
SCHEMA = "session_id string, pos long, raw binary, ended boolean"
#: Bytes of a split, and of what is read at once.
SPLIT, CHUNK = 64 << 20, 4 << 20


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(path))


def _files(path: str) -> dict[str, int]:
    """Session files below a folder and their sizes."""
    files, root = _opened(path)
    found = files.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    return {f.path[len(root.rstrip("/")) + 1 :]: f.size for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and f.path.endswith(".jsonl") and not f.base_name.startswith(".")}


@dataclass
class Split(InputPartition):
    name: str
    start: int
    end: int


def _splits(ranges: dict[str, tuple[int, int]], size: int) -> list[Split]:
    return [Split(name, at, min(at + size, end)) for name, (start, end) in ranges.items() for at in range(start, end, size)]


def _lines(path: str, split: Split) -> Iterator[tuple[int, bytes, bool]]:
    """(place, bytes, whether a line feed follows) of the lines that begin in a split."""
    files, root = _opened(path)
    with files.open_input_file(f"{root}/{split.name}") as f:
        at = split.start
        if at:  # the line that is under way began before, unless the byte before is a line feed
            f.seek(at - 1)
            at -= 1
        else:
            f.seek(0)
        skipping, held = bool(split.start), b""
        while at < split.end or held:
            chunk = f.read(CHUNK)
            if not chunk:
                if held and not skipping:
                    yield at, held, False
                return
            held += chunk
            *whole, held = held.split(b"\n")
            for line in whole:
                if not skipping:
                    if at >= split.end:
                        return
                    yield at, line, True
                skipping = False
                at += len(line) + 1
            if skipping:
                at, held = at + len(held), b""
            elif at >= split.end:
                return


class _Reading:
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def read(self, partition: Split) -> Iterator[tuple]:
        for pos, raw, ended in _lines(self.path, partition):
            yield (partition.name, pos, raw, ended)


class LogReader(_Reading, DataSourceReader):
    def partitions(self) -> list[Split]:
        return _splits({name: (0, size) for name, size in _files(self.path).items()}, self.size)


class LogStreamReader(_Reading, DataSourceStreamReader):
    """Offsets are the bytes of each file that are read, always up to a line feed."""

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {name: self._complete(name, size) for name, size in _files(self.path).items()}

    def _complete(self, name: str, size: int) -> int:
        files, root = _opened(self.path)
        with files.open_input_file(f"{root}/{name}") as f:
            end = size
            while end > 0:
                start = max(0, end - CHUNK)
                f.seek(start)
                found = f.read(end - start).rfind(b"\n")
                if found >= 0:
                    return start + found + 1
                end = start
        return 0

    def partitions(self, start: dict, end: dict) -> list[Split]:
        return _splits({name: (start.get(name, 0), to) for name, to in end.items() if to > start.get(name, 0)}, self.size)

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # session, temporary file


class LogWriter(DataSourceWriter):
    def __init__(self, path: str, backup: bool, validate: bool):
        self.path, self.backup, self.validate, self.job = path, backup, validate, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Written:
        files, root = _opened(self.path)
        made, session, out = [], None, None
        try:
            for row in iterator:
                if row.session_id != session:
                    if out is not None:
                        out.close()
                    session = row.session_id
                    folder, name = os.path.split(f"{root}/{session}")
                    files.create_dir(folder, recursive=True)
                    made.append((session, f"{folder}/.{name}.{self.job}-{uuid.uuid4().hex}.tmp"))
                    out = files.open_output_stream(made[-1][1])
                raw = bytes(row.raw)
                if self.validate and raw.strip():
                    json.loads(raw)
                out.write(raw + (b"\n" if row.ended else b""))
        except BaseException:
            for _, temporary in made:
                if out is not None:
                    out.close()
                files.delete_file(temporary)
            raise
        if out is not None:
            out.close()
        return Written(made)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = _opened(self.path)
        made = [f for m in messages if m is not None for f in m.files]
        names = [name for name, _ in made]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("a session's lines came from several tasks: lay them out by session_id first")
        for name, temporary in made:
            place = f"{root}/{name}"
            there = files.get_file_info(place).type == fs.FileType.File
            if self.backup and there and files.get_file_info(f"{place}.bak").type == fs.FileType.NotFound:
                files.copy_file(place, f"{place}.bak")
            files.move(temporary, place)
        self._swept(files, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._swept(*_opened(self.path))

    def _swept(self, files: fs.FileSystem, root: str) -> None:
        """Temporary files of this job, also those that lost tasks have left."""
        for f in files.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            if f.type == fs.FileType.File and f".{self.job}-" in f.base_name and f.base_name.endswith(".tmp"):
                files.delete_file(f.path)


class SessionLogs(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def _size(self) -> int:
        return int(self.options.get("splitbytes", SPLIT))

    def reader(self, schema) -> LogReader:
        return LogReader(self.options["path"], self._size())

    def streamReader(self, schema) -> LogStreamReader:
        return LogStreamReader(self.options["path"], self._size())

    def writer(self, schema, overwrite: bool) -> LogWriter:
        on = lambda name, default: self.options.get(name, default).lower() == "true"
        return LogWriter(self.options["path"], on("backup", "true"), on("validate", "false"))


def use_session_logs(spark: SparkSession) -> None:
    spark.dataSource.register(SessionLogs)


def log_entries(lines: DataFrame) -> DataFrame:
    """``sources.jsonl.entries`` of the source's lines, blank ones left out."""
    text = F.col("raw").cast("string")
    return entries(lines.select("session_id", "pos", text.alias("raw")).where(F.trim("raw") != ""))


def laid_out(lines: DataFrame) -> DataFrame:
    """Lines as the writer wants them: a session in one task, in order."""
    return lines.select("session_id", "pos", "raw", "ended").repartition("session_id").sortWithinPartitions("session_id", "pos")


def with_lines(lines: DataFrame, changed: DataFrame) -> DataFrame:
    """The source's lines with those of ``changed`` (session_id, pos, raw text) in place of their own; all others
    keep their bytes."""
    new = changed.select("session_id", "pos", F.col("raw").alias("_new"))
    out = lines.join(new, ["session_id", "pos"], "left")
    same = F.col("_new").isNull() | (F.col("_new") == F.col("raw").cast("string"))
    return out.select("session_id", "pos", F.when(same, F.col("raw")).otherwise(F.encode("_new", "UTF-8")).alias("raw"), "ended")
