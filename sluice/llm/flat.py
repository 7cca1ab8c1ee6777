"""Flat files of numbers in a folder that all tasks share: written whole, renamed into place, memory-mapped to read."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession

from ..scratch import hadoop_path


def qualified(spark: SparkSession, at: str) -> str:
    """A folder's full address by the session's Hadoop configuration, as tasks need it."""
    system, path = hadoop_path(spark, at)
    return system.makeQualified(path).toString()


class Folder:
    """A folder by its address (file, hdfs, s3, gs). Local and mounted ones are memory-mapped, of others only the wanted bytes are read."""

    def __init__(self, address: str):
        local = address.removeprefix("file://").removeprefix("file:") if address.startswith("file:") else address
        if local.startswith("/"):
            self.system, self.path = fs.LocalFileSystem(), local
        else:
            self.system, self.path = fs.FileSystem.from_uri(address)
        self.local = isinstance(self.system, fs.LocalFileSystem)

    @contextmanager
    def new(self, name: str) -> Iterator[BinaryIO]:
        """A file that appears under its name when it is whole; of two attempts of one task the later stays, with the same bytes."""
        self.system.create_dir(self.path, recursive=True)
        rough = f"{self.path}/.{name}.{uuid.uuid4().hex}"
        try:
            with self.system.open_output_stream(rough) as out:
                yield out
            self.system.move(rough, f"{self.path}/{name}")
        except BaseException:
            if self.has(rough.removeprefix(f"{self.path}/")):
                self.system.delete_file(rough)
            raise

    def has(self, name: str) -> bool:
        return self.system.get_file_info(f"{self.path}/{name}").type == fs.FileType.File

    def size(self, name: str) -> int:
        return self.system.get_file_info(f"{self.path}/{name}").size

    def text(self, name: str) -> str:
        with self.system.open_input_stream(f"{self.path}/{name}") as f:
            return f.read().decode("utf-8")

    def numbers(self, name: str, dtype: str, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Numbers ``start`` to ``stop`` of a flat file."""
        item = np.dtype(dtype).itemsize
        if stop is None:
            stop = self.size(name) // item
        if stop <= start:
            return np.zeros(0, dtype)
        if self.local:
            return np.memmap(f"{self.path}/{name}", dtype, "r", start * item, (stop - start,))
        with self.system.open_input_file(f"{self.path}/{name}") as f:
            return np.frombuffer(f.read_at((stop - start) * item, start * item), dtype)

    def arrow(self, name: str) -> pa.Table:
        """An Arrow file, mapped where it is local."""
        if self.local:
            return pa.ipc.open_file(pa.memory_map(f"{self.path}/{name}")).read_all()
        with self.system.open_input_file(f"{self.path}/{name}") as f:
            return pa.ipc.open_file(f).read_all()
