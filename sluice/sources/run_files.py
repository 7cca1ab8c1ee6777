"""A data source for trees of result files and for logs that grow: keys come from the path, and what a filter on them rules out is never listed or opened.

``read_files`` gives a row a file, ``read_lines`` a row a line, ``stream_lines`` the same lines as they are written. Folders
are read with Arrow's file systems (local and shared disks, HDFS, object stores), in tasks of ``split`` bytes.
"""

from __future__ import annotations

import io
import re
import sys
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds

#: Bytes of files that are a task's share, and of rows that are an Arrow batch.
SPLIT, BATCH = 64 << 20, 4 << 20
#: Bytes that opening a file counts as, so that many small files are many tasks.
OPENING = 64 << 10
#: The folder name of a null key in partitioned tables (fixed value).
NO_KEY = "__HIVE_DEFAULT_PARTITION__"
#: Filters that are decided on a key's text. Texts compare by code points, as UTF-8 does.
TESTS: dict[type, Callable[[str, object], bool]] = {
    ds.EqualTo: lambda x, v: x == v,
    ds.In: lambda x, v: x in v,
    ds.StringStartsWith: lambda x, v: x.startswith(v),
    ds.StringEndsWith: lambda x, v: x.endswith(v),
    ds.StringContains: lambda x, v: v in x,
    ds.GreaterThan: lambda x, v: x > v,
    ds.GreaterThanOrEqual: lambda x, v: x >= v,
    ds.LessThan: lambda x, v: x < v,
    ds.LessThanOrEqual: lambda x, v: x <= v,
}


class Share(ds.InputPartition):
    """A task's share: (path below the root, first byte, byte after the last) of files or of their parts."""

    def __init__(self, pieces: list[tuple[str, int, int]]):
        super().__init__(len(pieces))
        self.pieces = pieces


def line_pieces(f: io.BufferedReader, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines that begin in [start, stop); the last one may end behind it."""
    f.seek(max(0, start - 1))
    if start:
        f.readline()  # what began before; nothing but the line's end if ``start`` begins a line
    at = f.tell()
    while at < stop and (line := f.readline()):
        yield at, line
        at += len(line)


class Tree:
    """Files below a root, in as many levels of folders as there are keys."""

    def __init__(self, options: dict[str, str]):
        self.root = re.sub(r"^file:/(?!/)", "file:///", options["path"])
        self.keys = [k.strip() for k in options.get("keys", "").split(",") if k.strip()]
        self.lines = options.get("mode", "files") == "lines"
        self.suffix, self.split = options.get("suffix", ""), max(1, int(options.get("split", SPLIT)))
        self.tests: list[tuple[str, type, object]] = []
        if {"file", "offset", "value"} & set(self.keys) or len(set(self.keys)) < len(self.keys):
            raise ValueError(f"keys must differ from each other and from file, offset and value: {self.keys}")

    def system(self) -> tuple[fs.FileSystem, str]:
        system, at = fs.FileSystem.from_uri(self.root)
        return system, at.rstrip("/")

    def named(self, key: str, name: str) -> str | None:
        """A folder's value of a key: its name, or what stands behind ``key=``."""
        value = unquote(name[len(key) + 1 :]) if name.startswith(f"{key}=") else name
        return None if value == NO_KEY else value

    def fits(self, key: str, value: str | None) -> bool:
        return all(value is not None and TESTS[kind](value, v) for k, kind, v in self.tests if k == key)

    def stem(self, name: str) -> str:
        return name[: len(name) - len(self.suffix)]

    def files(self) -> Iterator[tuple[str, int]]:
        """(path below the root, bytes), by name; folders and files whose keys no filter keeps, hidden ones and marks are left out."""
        system, root = self.system()
        level = [""]
        for key in self.keys:
            found = [x for at in level for x in system.get_file_info(fs.FileSelector(f"{root}/{at}", allow_not_found=not at)) if x.type == fs.FileType.Directory]
            level = [x.path[len(root) + 1 :] for x in found if x.base_name[0] not in "_." and self.fits(key, self.named(key, x.base_name))]
        for at in sorted(level):
            for x in sorted(system.get_file_info(fs.FileSelector(f"{root}/{at}", allow_not_found=not at)), key=lambda x: x.base_name):
                name = x.base_name
                if x.type != fs.FileType.Directory and name[0] not in "_." and name.endswith(self.suffix) and self.fits("file", self.stem(name)):
                    yield x.path[len(root) + 1 :], x.size or 0

    def shares(self, pieces: Iterator[tuple[str, int, int]]) -> list[Share]:
        """Pieces in shares of at most ``split`` bytes; lines let a file be cut, whole files stay whole."""
        out, held, size = [], [], 0
        for path, first, stop in pieces:
            start = first
            while True:
                upto = min(stop, start + max(1, self.split - size)) if self.lines else stop
                held.append((path, start, upto))
                size += upto - start + (OPENING if start == first else 0)
                if size >= self.split:
                    out.append(Share(held))
                    held, size = [], 0
                start = upto
                if start >= stop:
                    break
        return [*out, Share(held)] if held else out

    def rows(self, share: Share) -> Iterator[tuple]:
        system, root = self.system()
        for path, start, stop in share.pieces:
            *folders, name = path.split("/")
            head = (*[self.named(k, x) for k, x in zip(self.keys, folders)], self.stem(name))
            with io.BufferedReader(system.open_input_file(f"{root}/{path}"), 1 << 20) as f:
                found = line_pieces(f, start, stop) if self.lines else [(0, f.read())]
                for at, data in found:
                    if self.lines:
                        data = data.removesuffix(b"\n").removesuffix(b"\r")
                    yield (*head, at, data.decode("utf-8", "replace"))

    def batches(self, share: Share) -> Iterator[pa.RecordBatch]:
        types = pa.schema([*[(k, pa.string()) for k in self.keys], ("file", pa.string()), ("offset", pa.int64()), ("value", pa.string())])
        held, size = [], 0
        for row in self.rows(share):
            held.append(row)
            size += len(row[-1]) + 64
            if size >= BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), types)], schema=types)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), types)], schema=types)


class TreeReader(ds.DataSourceReader):
    def __init__(self, tree: Tree):
        self.tree = tree

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        """Takes filters on keys and on the file's name; the others are Spark's."""
        for f in filters:
            if type(f) in TESTS and len(f.attribute) == 1 and f.attribute[0] in (*self.tree.keys, "file"):
                self.tree.tests.append((f.attribute[0], type(f), f.value))
            else:
                yield f

    def partitions(self) -> list[Share]:
        return self.tree.shares((path, 0, size) for path, size in self.tree.files())

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        return self.tree.batches(partition) if partition is not None else iter(())


class GrowthReader(ds.DataSourceStreamReader):
    """Offsets are, by file, the end of its last whole line."""

    def __init__(self, tree: Tree):
        self.tree, self.known = tree, {}

    def initialOffset(self) -> dict:
        return {}

    def _end(self, system: fs.FileSystem, path: str, size: int) -> int:
        """The byte after the last line end, sought from the file's end."""
        with system.open_input_file(path) as f:
            while size > 0:
                low = max(0, size - (1 << 16))
                f.seek(low)
                at = f.read(size - low).rfind(b"\n")
                if at >= 0:
                    return low + at + 1
                size = low
        return 0

    def latestOffset(self) -> dict:
        system, root = self.tree.system()
        out = {}
        for path, size in self.tree.files():
            if self.known.get(path, (None,))[0] != size:
                self.known[path] = size, self._end(system, f"{root}/{path}", size)
            out[path] = self.known[path][1]
        return out

    def partitions(self, start: dict, end: dict) -> list[Share]:
        short = [p for p in end if end[p] < start.get(p, 0)]
        if short:
            raise ValueError(f"logs got shorter: {short[:3]}")
        return self.tree.shares((p, start.get(p, 0), end[p]) for p in sorted(end) if end[p] > start.get(p, 0))

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        return self.tree.batches(partition)

    def commit(self, end: dict) -> None:
        """Nothing to let go of: files are the log."""


class RunFiles(ds.DataSource):
    """Format ``run_files``; options path, keys (comma-separated), suffix, mode (files or lines) and split."""

    @classmethod
    def name(cls) -> str:
        return "run_files"

    def schema(self) -> str:
        return ", ".join([*[f"`{k}` string" for k in Tree(self.options).keys], "file string, offset bigint, value string"])

    def reader(self, schema) -> TreeReader:  # noqa: ANN001
        return TreeReader(Tree(self.options))

    def streamReader(self, schema) -> GrowthReader:  # noqa: ANN001
        tree = Tree(self.options)
        if not tree.lines:
            raise ValueError("streams are of lines")
        return GrowthReader(tree)


def register_run_files(spark: SparkSession) -> None:
    """Makes the format known to the session, with pushed filters; its code travels with the plan."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RunFiles)


def _options(source, keys: tuple[str, ...], suffix: str, mode: str, split: int):  # noqa: ANN001, ANN202
    return source.format("run_files").option("keys", ",".join(keys)).option("suffix", suffix).option("mode", mode).option("split", split)


def read_files(spark: SparkSession, path: str, *, keys: tuple[str, ...] = (), suffix: str = "", split: int = SPLIT) -> DataFrame:
    """(keys, file, offset, value): a row a file, value its whole text and offset 0.

    Files lie as many folders deep as there are keys; others are no part of the tree. A folder is named by the value or as
    key=value; the null key of partitioned tables is null. ``file`` is the name without ``suffix``. Names that begin with
    ``_`` or ``.`` are left out. A missing or empty root gives no row; bytes that aren't UTF-8 are replaced.
    """
    register_run_files(spark)
    return _options(spark.read, keys, suffix, "files", split).load(path)


def read_lines(spark: SparkSession, path: str, *, keys: tuple[str, ...] = (), suffix: str = "", split: int = SPLIT) -> DataFrame:
    """(keys, file, offset, value): a row a line, offset its first byte; see ``read_files``. Large files are many tasks; a line stays whole."""
    register_run_files(spark)
    return _options(spark.read, keys, suffix, "lines", split).load(path)


def stream_lines(spark: SparkSession, path: str, *, keys: tuple[str, ...] = (), suffix: str = "", split: int = SPLIT) -> DataFrame:
    """The rows of ``read_lines`` as they are written, each once; a line is read when its end is written.

    The offset is one number a file. New files and folders join in, files that went away are no loss, one that got
    shorter is an error.
    """
    register_run_files(spark)
    return _options(spark.readStream, keys, suffix, "lines", split).load(path)
