"""Tables in the folder that driver and executors share: scratch tables that end with their job, and results that outlive it."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Bytes up to which an estimate may decide on a broadcast. Sizes of compressed files and of exploded arrays are estimated
#: a hundred times too small, and what is broadcast lies whole in the driver.
GUESSED = 256 << 10
#: Bytes up to which a measured side is broadcast in jobs of many joins: the driver holds each relation of a plan, three times
#: the measured bytes and more, as table and as blocks.
MEASURED = 1 << 20
STATIC, ADAPTIVE = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
_guard = threading.Lock()
_within: dict[int, list] = {}


def _bytes(spark: SparkSession, value: str) -> int:
    """A size setting in bytes; -1 is none."""
    return int(value) if value.lstrip("-").isdigit() else spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(value)


@contextmanager
def measured_broadcasts(spark: SparkSession, most: int | None = None) -> Iterator[None]:
    """Jobs in it broadcast, beyond ``GUESSED`` bytes, only what adaptive execution has measured as below the session's threshold and ``most``.

    Threads of one session may be in it at once; the first one changes the settings and the last one puts them back. The
    least ``most`` of those within holds for all.
    """
    key = spark._jsparkSession.hashCode()

    def put() -> None:
        own = held[1] if held[2] is None else held[2]
        spark.conf.set(ADAPTIVE, str(min(_bytes(spark, own), *bounds)) if (bounds := [m for m in held[0] if m is not None]) else own)

    with _guard:
        held = _within.setdefault(key, [[], spark.conf.get(STATIC), spark.conf.get(ADAPTIVE, None)])
        if not held[0]:
            spark.conf.set(STATIC, str(min(GUESSED, _bytes(spark, held[1]))))
        held[0].append(most)
        put()
    try:
        yield
    finally:
        with _guard:
            held[0].remove(most)
            if held[0]:
                put()
            else:
                del _within[key]
                spark.conf.set(STATIC, held[1])
                if held[2] is None:
                    spark.conf.unset(ADAPTIVE)
                else:
                    spark.conf.set(ADAPTIVE, held[2])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where it is unset a temporary folder serves local sessions; on a cluster it is an error.
    """
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at is None and sc._jsc.sc().getCheckpointDir().isDefined():
        return sc._jsc.sc().getCheckpointDir().get()
    if at is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="sluice-")
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def hadoop_path(spark: SparkSession, at: str):
    """(file system, path) of a place, by the session's Hadoop configuration."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def names_in(spark: SparkSession, at: str) -> list[str]:
    """Names in a folder; none if it isn't there."""
    fs, path = hadoop_path(spark, at)
    return sorted(x.getPath().getName() for x in fs.listStatus(path)) if fs.exists(path) else []


class Scratch:
    """Parquet tables in the shared folder that end with the job that needs them.

    A written table cuts lineage, survives lost executors and, unlike a cached one, needs no memory. ``most`` bounds what
    the jobs that write them broadcast (``measured_broadcasts``).
    """

    def __init__(self, spark: SparkSession, most: int | None = None):
        self.spark, self.most, self.root = spark, most, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
        self.n = 0

    def place(self) -> str:
        """A new folder's name."""
        self.n += 1
        return f"{self.root}/{self.n}"

    def keep(self, df: DataFrame) -> DataFrame:
        at = self.place()
        with measured_broadcasts(df.sparkSession, self.most):
            df.write.parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self) -> None:
        fs, path = hadoop_path(self.spark, self.root)
        fs.delete(path, True)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.drop()


def final(df: DataFrame, most: int | None = None) -> DataFrame:
    """An eagerly computed copy in the checkpoint folder, independent of scratch tables."""
    shared_dir(df.sparkSession)
    with measured_broadcasts(df.sparkSession, most):
        return df.checkpoint(eager=True)
