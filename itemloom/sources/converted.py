"""Files behind an outside converter as a format of Spark's own, in batch and as a stream (inventory S1, S20, S21).

``register(spark, "osra_files", ["osra", "{file}"])`` makes a format whose
rows are the spans that the converter finds; then

    spark.read.format("osra_files").option("glob", "*.png").load(folder)
    spark.readStream.format("osra_files").load(folder)

Options: ``path``; ``glob`` of the file's name ("*"); ``recursive`` ("true");
``timeout``, seconds that one file may take ("30"); ``partition_bytes``, files
that a task reads one after the other ("0": each file is a partition of its
own); ``lag``, seconds that a stream waits for files that turn up with an
older time than others already seen ("60").

Files are listed and read through ``pyarrow.fs``, so ``path`` may name any
file system that it knows (a plain path or ``file:`` is a shared folder).
"""

from __future__ import annotations

import datetime
import fnmatch
import json
import multiprocessing
import subprocess
import tempfile
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "path string, modified timestamp, pos int, page int, text string, error string"
#: (pos, page, text) spans of a file's name and content.
Convert = Callable[[str, bytes], Iterable[tuple[int, int, str]]]
_FORK = multiprocessing.get_context("fork")


@dataclass
class File:
    path: str
    modified: int  # nanoseconds
    size: int


@dataclass
class Files(InputPartition):
    """Files that one task reads."""

    files: list[File]


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


def listed(options: dict) -> list[File]:
    """Files below the path whose name fits, by time and path; hidden ones (``_`` or ``.`` first, or in such a folder) are left out."""
    store, root = file_system(options["path"])
    root = root.rstrip("/")
    selector = fs.FileSelector(root, recursive=options.get("recursive", "true").lower() == "true", allow_not_found=True)
    one = store.get_file_info(root)
    found = [one] if one.type == fs.FileType.File else [i for i in store.get_file_info(selector) if i.type == fs.FileType.File]
    seen = lambda p: not any(x[:1] in "_." for x in p.removeprefix(root).split("/") if x)
    files = [File(i.path, i.mtime_ns or 0, i.size or 0) for i in found if seen(i.path) and fnmatch.fnmatchcase(i.base_name, options.get("glob", "*"))]
    return sorted(files, key=lambda f: (f.modified, f.path))


def dealt(files: list[File], limit: int) -> list[Files]:
    """Partitions of about ``limit`` bytes, one file at least."""
    out: list[list[File]] = []
    size = 0
    for f in files:
        if not out or size + f.size > limit:
            out.append([])
            size = 0
        out[-1].append(f)
        size += f.size
    return [Files(x) for x in out]


def within(seconds: float, work: Callable[[], list]) -> list:
    """What ``work`` returns in a process of its own, which is ended after some seconds: a converter that hangs can't hold a task."""
    ours, theirs = _FORK.Pipe(duplex=False)

    def run() -> None:
        try:
            theirs.send((work(), None))
        except Exception as e:  # noqa: BLE001  whatever goes wrong in a converter is its file's error
            theirs.send((None, f"{type(e).__name__}: {e}"))
        theirs.close()

    child = _FORK.Process(target=run, daemon=True)
    child.start()
    theirs.close()
    try:
        if not ours.poll(seconds):
            raise TimeoutError(f"no result after {seconds:g} s")
        found, error = ours.recv()
    except EOFError:
        child.join()
        raise RuntimeError(f"the converter ended without a result (exit code {child.exitcode})") from None
    finally:
        if child.is_alive():
            child.kill()
        child.join()
        ours.close()
    if error is not None:
        raise RuntimeError(error)
    return found


def by_command(command: list[str], content: bytes, seconds: float) -> list[tuple[int, int, str]]:
    """Lines that a program prints, blank ones left out; the content goes to ``{file}`` if the command names it, else to standard input."""
    with tempfile.NamedTemporaryFile() as at:  # this task's own
        if any("{file}" in c for c in command):
            at.write(content)
            at.flush()
            command, content = [c.replace("{file}", at.name) for c in command], b""
        try:
            done = subprocess.run(command, input=content, capture_output=True, timeout=seconds, check=False)
        except subprocess.TimeoutExpired:
            raise TimeoutError(f"no result after {seconds:g} s") from None
    if done.returncode:
        raise RuntimeError(f"exit code {done.returncode}: {done.stderr.decode(errors='replace').strip()[-300:]}")
    return [(i, 1, x.strip()) for i, x in enumerate(done.stdout.decode(errors="replace").splitlines()) if x.strip()]


class Reading:
    """What the batch and the stream reader share."""

    def __init__(self, options: dict, convert: Convert | list[str]):
        self.options, self.convert = dict(options), convert
        self.seconds = float(self.options.get("timeout", 30))

    def read(self, partition: Files) -> Iterator[tuple]:
        store, _ = file_system(self.options["path"])
        for f in partition.files:
            modified = datetime.datetime.fromtimestamp(f.modified / 1e9)
            try:
                with store.open_input_stream(f.path) as source:
                    content = source.read()
                if callable(self.convert):
                    spans = within(self.seconds, lambda f=f, content=content: list(self.convert(f.path, content)))
                else:
                    spans = by_command(self.convert, content, self.seconds)
                for pos, page, text in spans:
                    yield f.path, modified, pos, page, text, None
            except Exception as e:  # noqa: BLE001  one bad file must not end the scan
                yield f.path, modified, None, None, None, str(e) or type(e).__name__


class BatchReader(Reading, DataSourceReader):
    def partitions(self) -> Sequence[InputPartition]:
        return dealt(listed(self.options), int(self.options.get("partition_bytes", 0))) or [Files([])]


class StreamReader(Reading, DataSourceStreamReader):
    """Offsets are the latest time seen, and the files seen within ``lag`` of it.

    A file is new if it is not among those and its time is not further back
    than ``lag``; so what a batch holds follows from its two offsets alone, and
    a restart reads the same.  A file that is changed later is a new one.
    """

    def __init__(self, options: dict, convert: Convert | list[str]):
        super().__init__(options, convert)
        self.lag = int(float(self.options.get("lag", 60)) * 1e9)

    def initialOffset(self) -> dict:
        return {"upto": 0, "seen": "{}"}

    def latestOffset(self) -> dict:
        files = listed(self.options)
        upto = max((f.modified for f in files), default=0)
        return {"upto": upto, "seen": json.dumps({f.path: f.modified for f in files if f.modified >= upto - self.lag}, sort_keys=True)}

    def between(self, start: dict, end: dict) -> list[File]:
        before, after = json.loads(start["seen"]), json.loads(end["seen"])
        new = lambda f: before.get(f.path) != f.modified and f.modified >= start["upto"] - self.lag
        held = lambda f: after.get(f.path) == f.modified or f.modified < end["upto"] - self.lag
        return [f for f in listed(self.options) if new(f) and held(f)]

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return dealt(self.between(start, end), int(self.options.get("partition_bytes", 0)))


def format_of(name: str, convert: Convert | list[str]) -> type[DataSource]:
    """A data source class of that name; ``convert`` is a function or a command line."""

    class ConvertedFiles(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:  # noqa: ARG002
            return BatchReader(self.options, convert)

        def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: ARG002
            return StreamReader(self.options, convert)

    return ConvertedFiles


def register(spark: SparkSession, name: str, convert: Convert | list[str]) -> None:
    """Make ``spark.read.format(name)`` and ``spark.readStream.format(name)`` read files through ``convert``."""
    from ..shipping import by_value, ship

    ship(spark)
    with by_value():
        spark.dataSource.register(format_of(name, convert))


def failures(rows: DataFrame) -> DataFrame:
    """The files that gave an error instead of spans."""
    return rows.where("error is not null").select("path", "modified", "error")
