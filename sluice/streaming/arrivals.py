"""Prompts and responses that arrive late, twice and out of order: watermarked joins, deduplication and sessions."""

from __future__ import annotations

import threading
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DayTimeIntervalType, TimestampType

from .replay import STORE

DAY = 86_400_000_000
#: Rows of a share of the state, about.
SHARE = 1_000_000
_guard = threading.RLock()


@contextmanager
def state_on_disk(spark: SparkSession, rows: int | None = None, *, trailing: bool = True) -> Iterator[None]:
    """Queries that start in it keep their state on the executors' disks, with memory of bounded size; the session's settings come back.

    ``rows`` that the state will hold, if known: it is dealt into shares of ``SHARE`` rows, two a core at least and never more than
    the session's shuffle partitions, since every share of every operator is committed with each micro-batch. ``trailing`` False: no
    micro-batch without rows follows the last one; without outer joins such a batch only forgets what the next one would.
    """
    conf = {
        "spark.sql.streaming.stateStore.providerClass": STORE,
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else a share of no rows takes megabytes a version
        "spark.sql.streaming.join.stateFormatVersion": "3",  # one store of a share of a join, not four
        "spark.sql.streaming.noDataMicroBatches.enabled": str(trailing).lower(),
    }
    if rows is not None:
        most = int(spark.conf.get("spark.sql.shuffle.partitions"))
        conf["spark.sql.shuffle.partitions"] = str(min(most, max(2 * spark.sparkContext.defaultParallelism, -(-rows // SHARE))))
    with _guard:
        before = {k: spark.conf.get(k, None) for k in conf}
        try:
            for k, v in conf.items():
                spark.conf.set(k, v)
            yield
        finally:
            for k, v in before.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def once(rows: DataFrame, keys: list[str], *, time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Rows without repeats of ``keys`` that come within ``late`` of the first; the state forgets a key after that."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def answered(prompts: DataFrame, responses: DataFrame, *, key: str, within: str, prompt_time: str = "prompt_ts", response_time: str = "response_ts", late: str | None = "1 hour", how: str = "inner") -> DataFrame:
    """Each prompt with the responses of its ``key`` from its own time to ``within`` later (both ends included).

    On streams both sides wait in state no longer than ``within`` and ``late`` ask for, and with ``how="left"`` a prompt without a
    response comes out, once, when none can come any more. ``late`` None: the times have watermarks already (as after ``once``, since a
    watermark can't be set anew behind a stateful step). ``key`` has the same name on both sides; the result has it once.

    Rows meet by key and slot of time, not by key alone, so that a row isn't compared with all that its key ever had, and a key with
    many rows is many tasks: a response is in its prompt's slot or the next one, and the side that may come out once only (prompts
    with ``how="left"``, else responses) is in one slot, the other one in two.
    """
    left = prompts.withWatermark(prompt_time, late) if prompts.isStreaming and late else prompts
    right = responses.withColumnRenamed(key, "_key")
    right = right.withWatermark(response_time, late) if right.isStreaming and late else right
    on = (F.col(key) == F.col("_key")) & F.col(response_time).between(F.col(prompt_time), F.col(prompt_time) + F.expr(f"INTERVAL {within}"))
    if width := _slot_width(left.schema[prompt_time].dataType, right.schema[response_time].dataType, left.sparkSession, within, how):
        ours, theirs = (F.unix_micros(t) - F.pmod(F.unix_micros(t), F.lit(width)) for t in (prompt_time, response_time))
        if how.startswith("left"):
            theirs = F.explode(F.array(theirs, theirs - width))
        else:
            ours = F.explode(F.array(ours, ours + width))
        left, right, on = left.withColumn("_slot", ours), right.withColumn("_in", theirs), on & (F.col("_slot") == F.col("_in"))
    return left.join(right, on, how).drop("_key", "_slot", "_in")


def _slot_width(prompt_time, response_time, spark: SparkSession, within: str, how: str) -> int:
    """Microseconds that no response is behind its prompt by more than; 0 where slots don't serve: months, times without a zone, full joins."""
    span = spark.sql(f"SELECT INTERVAL {within} AS span")
    kinds = (prompt_time, TimestampType), (response_time, TimestampType), (span.schema["span"].dataType, DayTimeIntervalType)
    if how.startswith(("full", "outer")) or not all(isinstance(x, kind) for x, kind in kinds):
        return 0
    micros = span.first()["span"] // timedelta(microseconds=1)
    return max(0, micros) + DAY * (micros >= DAY)  # a day of the session's zone may have more than 24 hours


def with_age(rows: DataFrame, *, prompt_time: str = "prompt_ts", response_time: str = "response_ts") -> DataFrame:
    """``rows`` with ``age``: the seconds by which the response is behind its prompt's policy."""
    return rows.withColumn("age", F.col(response_time).cast("double") - F.col(prompt_time).cast("double"))


def sessions(rows: DataFrame, *, key: str, gap: str, time: str = "ts", late: str = "1 hour", value: str = "value") -> DataFrame:
    """(key, start, end, n, total) of runs of a key's rows with less than ``gap`` between neighbours; end is the last row's time plus the gap.

    On a stream a session comes out when the watermark has passed its end.
    """
    rows = rows.withWatermark(time, late) if rows.isStreaming else rows
    out = rows.groupBy(key, F.session_window(time, gap).alias("_w")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(key, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "n", "total")
