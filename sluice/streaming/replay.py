"""A replay buffer as streaming state: prompts wait by domain until a batch's quota is there, go out once, and are forgotten."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.sampling import sampleable
from ..session import ship_package

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of a frame that goes out.
OUT = 100_000
BATCHES = "domain string, shard int, batch long, step long, uid long, complete boolean"


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state with maps and timers needs this store; it spills to disk, so that waiting prompts needn't fit in memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class _Waiting(StatefulProcessor):
    """State of one (domain, shard): a map of waiting prompts, how many there are, and the number of the next batch."""

    def __init__(self, targets: dict[str, int], shards: int, max_lag: int | None, patience: int | None):
        self.targets, self.shards, self.max_lag, self.patience = targets, shards, max_lag, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ready = handle.getMapState("ready", "step long, uid long", "seen long")
        self.place = handle.getValueState("place", "batch long, waiting long, newest long, timer long")

    def quota(self, domain: str, shard: int) -> int:
        n = self.targets[domain]
        return n // self.shards + (shard < n % self.shards)

    def out(self, key: tuple, order: np.ndarray, batch: int, quota: int) -> pd.DataFrame:
        """Rows (step, uid), oldest first, as shares from number ``batch`` on; the last one may be short."""
        n = len(order)
        nth = np.arange(n) // quota
        return pd.DataFrame({"domain": key[0], "shard": key[1], "batch": batch + nth, "step": order[:, 0], "uid": order[:, 1], "complete": (nth + 1) * quota <= n})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        """Whole shares go out at once, so that less than one is read and left behind; a micro-batch's rows of one key are held as two numbers each."""
        batch, _, newest, timer = self.place.get() or (0, 0, -(1 << 62), 0)
        before = np.array([tuple(k) for k in self.ready.keys()], np.int64).reshape(-1, 2)
        come = [f[["step", "uid"]].to_numpy(np.int64) for f in rows]
        newest = max(newest, *(int(x[:, 0].max()) for x in come if len(x)))
        order = np.concatenate([before, *come])
        if self.max_lag is not None:
            order = order[newest - order[:, 0] <= self.max_lag]
        order = order[np.lexsort((order[:, 1], order[:, 0]))]
        order = order[np.concatenate([[True], (order[1:] != order[:-1]).any(axis=1)])[: len(order)]]  # what came twice waits once
        quota = self.quota(*key)
        full = len(order) // quota
        left = order[full * quota :]
        had, have = set(map(tuple, before.tolist())), set(map(tuple, left.tolist()))
        for k in had - have:
            self.ready.removeKey(k)
        for k in have - had:
            self.ready.updateValue(k, (k[0],))
        if full:
            for i in range(0, full, step := max(1, OUT // quota)):
                yield self.out(key, order[i * quota : min(full, i + step) * quota], batch + i, quota)
            batch += full
            if timer:
                self.handle.deleteTimer(timer)
                timer = 0
        if len(left) and self.patience is not None and not timer:
            timer = timerValues.getCurrentProcessingTimeInMs() + self.patience
            self.handle.registerTimer(timer)
        self.place.update((batch, len(left), newest, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """A batch that has waited long enough goes out short."""
        batch, waiting, newest, _ = self.place.get()
        order = np.array(sorted(tuple(k) for k in self.ready.keys()), np.int64).reshape(-1, 2)
        for k in order.tolist():
            self.ready.removeKey(tuple(k))
        if waiting:
            yield self.out(key, order, batch, self.quota(*key))
        self.place.update((batch + (waiting > 0), 0, newest, 0))

    def close(self) -> None:
        pass


def replay_batches(pool: DataFrame, targets: dict[str, int], *, shards: int = 1, max_lag: int | None = None, patience: int | None = None) -> DataFrame:
    """A stream of (domain, shard, batch, step, uid, complete): each domain's share of batch 0, 1, ... as soon as it is ready.

    ``pool`` is a stream of prompts (uid, domain, step, status). Finished and failed ones wait; those of domains without a
    target, or with 0, don't enter. A share is the ``targets[domain]`` oldest prompts by (step, uid) that wait, and a batch is whole when all
    shares with its number are there. ``max_lag``: waiting prompts that many steps behind the domain's newest are forgotten.
    ``patience``: a share that has waited so many milliseconds goes out short, ``complete`` being false.
    ``shards``: a domain's prompts are dealt by a hash of their uid to so many queues, each with its part of the target (as much as they
    divide it), so that a domain that holds most prompts isn't one task; oldest then means oldest of its queue.
    A prompt that comes twice while it waits waits once. State is the waiting prompts alone, on disk where they are many.
    """
    spark = pool.sparkSession
    ship_package(spark)
    use_rocksdb(spark)
    wanted = {d: int(n) for d, n in targets.items() if n > 0}
    if not wanted or shards < 1 or min(wanted.values()) < shards:
        raise ValueError("a target must give each shard a prompt")
    rows = sampleable(pool).where(F.col("domain").isin(*wanted) & F.col("uid").isNotNull())
    rows = rows.select("domain", F.pmod(F.xxhash64("uid"), F.lit(shards)).cast("int").alias("shard"), F.col("step").cast("long"), F.col("uid").cast("long"))
    mode = "ProcessingTime" if patience is not None else "None"
    return rows.groupBy("domain", "shard").transformWithStateInPandas(_Waiting(wanted, shards, max_lag, patience), BATCHES, "Append", mode)
