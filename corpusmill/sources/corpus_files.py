"""Document folders as a data source of its own: tasks of equal size, long text files in ranges, a stream that resumes.

`spark.read.format("corpus_files").load(root)` lists a folder once, on any file system that pyarrow reads, drops files by
pushed filters before a byte is read, and deals the rest to tasks by size: many small files are one task, and a text
file longer than range_bytes is several, each with the lines that begin in its range. Other kinds are read whole. As a
stream its offset is the time and path of the newest file that was taken, which is what a restart goes on from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from ..session import ship

SCHEMA = "path string, suffix string, begin long, size long, modified long, content binary"
#: Bytes of a range of a text file, and of what a task reads.
RANGE, TASK = 64 << 20, 128 << 20
#: Kinds of files that may be read from the middle, at a line's beginning.
LINES = ("txt", "json", "jsonl")


@dataclass
class Part:
    path: str
    begin: int
    end: int
    size: int
    modified: int


@dataclass
class Task(InputPartition):
    parts: list[Part]


def suffix_of(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[-1].lower() if "." in name else ""


class _Folder:
    def __init__(self, options):
        self.fs, self.root = pyarrow.fs.FileSystem.from_uri(options["path"])
        self.kinds = tuple(options.get("kinds", "pdf,docx,txt").lower().split(","))
        self.range, self.task = int(options.get("range_bytes", RANGE)), int(options.get("task_bytes", TASK))
        self.filters: list = []

    def files(self) -> list[pyarrow.fs.FileInfo]:
        """The files of these kinds that pass the filters; hidden ones, and those in hidden folders, are left out."""
        found = self.fs.get_file_info(pyarrow.fs.FileSelector(self.root, recursive=True))
        below = lambda f: f.path[len(self.root.rstrip("/")) + 1 :].split("/")
        shown = [f for f in found if f.is_file and suffix_of(f.path) in self.kinds and not any(p[:1] in "._" for p in below(f))]
        return [f for f in shown if all(test({"path": f.path, "suffix": suffix_of(f.path)}[c]) for c, test in self.filters)]

    def tasks(self, files: list[pyarrow.fs.FileInfo]) -> list[Task]:
        """Ranges in the order of their files, as many to a task as it has room for."""
        parts = []
        for f in sorted(files, key=lambda f: f.path):
            step = self.range if suffix_of(f.path) in LINES else max(f.size, 1)
            parts += [Part(f.path, b, min(b + step, f.size), f.size, f.mtime_ns) for b in range(0, max(f.size, 1), step)]
        tasks, held = [], 0
        for p in parts:
            if not tasks or held + p.end - p.begin > self.task:
                tasks, held = [*tasks, Task([])], 0
            tasks[-1].parts.append(p)
            held += p.end - p.begin
        return tasks

    def rows(self, task: Task) -> Iterator[tuple]:
        for p in task.parts:
            with self.fs.open_input_file(p.path) as file:
                yield p.path, suffix_of(p.path), p.begin, p.size, p.modified, self._content(file, p)

    def _content(self, file, p: Part) -> bytes:
        """The bytes of a range; in a file of several, the lines that begin in it."""
        if p.begin == 0 and p.end == p.size:
            return file.read()
        begin = self._line_from(file, p.begin, p.size)
        end = self._line_from(file, p.end, p.size)
        file.seek(begin)
        return file.read(end - begin)

    @staticmethod
    def _line_from(file, at: int, size: int) -> int:
        """Where the first line that begins at `at` or later begins."""
        if at == 0 or at >= size:
            return min(at, size)
        at -= 1
        while at < size:
            file.seek(at)
            piece = file.read(1 << 16)
            found = piece.find(b"\n")
            if found >= 0:
                return at + found + 1
            at += len(piece)
        return size


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.folder = _Folder(options)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column not in ("path", "suffix") or not isinstance(f, EqualTo | In | StringStartsWith):
                yield f
            elif isinstance(f, StringStartsWith):
                self.folder.filters.append((column, lambda x, v=f.value: x.startswith(v)))
            else:
                self.folder.filters.append((column, lambda x, v=tuple(f.value) if isinstance(f, In) else (f.value,): x in v))

    def partitions(self) -> list[Task]:
        tasks, self.folder.filters = self.folder.tasks(self.folder.files()), []  # tasks have passed them
        return tasks or [Task([])]

    def read(self, partition: Task) -> Iterator[tuple]:
        return self.folder.rows(partition)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options):
        self.folder, self.most = _Folder(options), int(options.get("files_per_batch", 0))
        self.at = None

    def initialOffset(self) -> dict:
        return {"modified": 0, "path": ""}

    def latestOffset(self) -> dict:
        new = self._after(self.at or self.initialOffset())
        if self.most and self.at is not None:
            new = new[: self.most]
        if new:
            self.at = {"modified": new[-1].mtime_ns, "path": new[-1].path}
        return self.at or self.initialOffset()

    def _after(self, start: dict, end: dict | None = None) -> list[pyarrow.fs.FileInfo]:
        place = lambda f: (f.mtime_ns, f.path)
        bound = lambda o: (o["modified"], o["path"])
        found = [f for f in self.folder.files() if place(f) > bound(start) and (end is None or place(f) <= bound(end))]
        return sorted(found, key=place)

    def partitions(self, start: dict, end: dict) -> list[Task]:
        self.at = end
        return self.folder.tasks(self._after(start, end))

    def read(self, partition: Task) -> Iterator[tuple]:
        return self.folder.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class CorpusFiles(DataSource):
    """Options: path, kinds (comma-separated suffixes), range_bytes, task_bytes, and files_per_batch for streams."""

    @classmethod
    def name(cls) -> str:
        return "corpus_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)

    def streamReader(self, schema) -> _StreamReader:
        return _StreamReader(self.options)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CorpusFiles)


def corpus_files(spark: SparkSession, root: str, **options: str | int) -> DataFrame:
    """(path, suffix, begin, size, modified, content): a row for each range. A file is put in place whole, by a rename. An
    empty file has one row of no bytes, an empty folder gives no rows; a line longer than a range stands in the range it
    begins in."""
    register(spark)
    return spark.read.format("corpus_files").options(**{k: str(v) for k, v in options.items()}).load(root)


def corpus_stream(spark: SparkSession, root: str, **options: str | int) -> DataFrame:
    """The same rows as a stream. Each file is taken once, in the order of its time and path; a file must not appear with
    a time before that of files that were taken."""
    register(spark)
    return spark.readStream.format("corpus_files").options(**{k: str(v) for k, v in options.items()}).load(root)
