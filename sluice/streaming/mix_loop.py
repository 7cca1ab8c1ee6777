"""The live mixing loop: keyed windows of observations as streaming state, proportions refreshed batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from ..operators.mixers import domain_windows
from ..scratch import Scratch
from ..sources import kv

STATS = "domain string, step long, mean double, slope double, count long"
STATE = "values array<double>, seen long"


def domain_stats_stream(obs: DataFrame, *, window: int = 50) -> DataFrame:
    """Statistics of each domain's last ``window`` observations after every micro-batch.

    ``obs``: (step, row_id, domain, value). A domain's state is its window, so state grows with domains alone.
    Rows of a micro-batch enter in the order of (step, row_id), as in the batch form. Each task cuts its rows to a domain's
    last ``window`` before they are shuffled, so that a domain of any size sends a window a task.
    """
    order = ["step", "row_id"]

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The last rows of each domain in a task; ``rows`` of the first of them counts all that there were."""
        last: dict[str | None, tuple[pd.DataFrame, int]] = {}
        for frame in frames:
            for domain, new in frame.groupby("domain", dropna=False):
                domain = None if pd.isna(domain) else domain
                before, n = last.get(domain, (new[:0], 0))
                last[domain] = pd.concat([before, new]).sort_values(order).tail(window), n + len(new)
        for rows, n in last.values():
            yield rows.assign(rows=[n] + [0] * (len(rows) - 1))

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, seen = state.get if state.exists else ([], 0)
        new = None
        for frame in frames:
            seen += int(frame["rows"].sum())
            new = (frame if new is None else pd.concat([new, frame])).sort_values(order).tail(window)
        held = [*held, *new["value"].astype(float)][-window:]
        state.update((held, seen))
        s = pd.Series(held)
        x = pd.Series(range(len(held)), dtype=float)
        slope = float(((x - x.mean()) * (s - s.mean())).sum() / ((x - x.mean()) ** 2).sum()) if len(held) > 1 else 0.0
        yield pd.DataFrame([{"domain": key[0], "step": int(new["step"].max()), "mean": float(s.mean()), "slope": slope, "count": seen}])

    few = obs.select("step", "row_id", "domain", F.col("value").cast("double").alias("value"))
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in few.schema)
    few = few.mapInPandas(cut, f"{kind}, rows long")
    return few.groupBy("domain").applyInPandasWithState(update, STATS, STATE, "update", GroupStateTimeout.NoTimeout)


#: What the loop keeps of a domain: its latest statistics and its last observations, at most a window of them.
DOMAIN = "domain string, step long, mean double, slope double, count long, tail array<struct<step: long, row_id: {row_id}, value: double>>"


def _refreshed(batch: DataFrame, before: DataFrame, window: int) -> DataFrame:
    """(step, and the columns of DOMAIN) for each domain and each step of the batch in which it has rows; tail in its last step alone.

    The tails of ``before`` stand ahead of the batch's rows, so that windows reach back over batches. Windows, ranks and
    counts run over ranges of the rows, and a domain of any size is many tasks.
    """
    new = batch.select("domain", F.col("step").cast("long").alias("step"), "row_id", F.col("value").cast("double").alias("value"), F.lit(1).alias("_gen"))
    old = before.select("domain", F.inline("tail")).withColumn("_gen", F.lit(0))
    rows = domain_windows(old.unionByName(new), order=("_gen", "step", "row_id"), window=window).where("_gen = 1")
    each = rows.groupBy("domain", "step").agg(F.max_by(F.struct("mean", "slope"), F.struct("row_id", "n_obs")).alias("_s"), F.count("*").alias("_rows"))
    upto = Window.partitionBy("domain").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)  # a row a step of the batch
    each = each.withColumns({"_seen": F.sum("_rows").over(upto), "_last": F.max("step").over(Window.partitionBy("domain"))})
    each = each.join(before.select("domain", F.col("count").alias("_had")), "domain", "left")
    # the last rows: of each domain's newest ones, as many as the window has, cut in each task before they meet
    both = old.unionByName(new)
    latest = both.withColumn("_rn", F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("_gen"), F.desc("step"), F.desc("row_id")))).where(F.col("_rn") <= window)
    tail = latest.groupBy("domain").agg(F.sort_array(F.collect_list(F.struct((-F.col("_rn")).alias("r"), "step", "row_id", "value"))).alias("_t"))
    tail = tail.select("domain", F.transform("_t", lambda t: F.struct(t["step"].alias("step"), t["row_id"].alias("row_id"), t["value"].alias("value"))).alias("_tail"))
    out = each.join(tail, "domain")
    count = (F.coalesce("_had", F.lit(0)) + F.col("_seen")).alias("count")
    return out.select("domain", "step", F.col("_s.mean").alias("mean"), F.col("_s.slope").alias("slope"), count, F.when(F.col("step") == F.col("_last"), F.col("_tail")).alias("tail"))


def start_mix_loop(obs: DataFrame, mixer, publish: Callable[[DataFrame, int], None], checkpoint: str, *, window: int = 50, warmup_step: int = 0, update_step: int = 1, **trigger):
    """Starts the loop; ``publish(proportions, step)`` gets a table of one row a domain for every refresh step of a micro-batch, in order.

    A refresh step's statistics are those after its last row: of domains without rows in it, their latest ones before.
    They and each domain's last ``window`` observations are a keyed table beside the checkpoint, one row a domain, so that a
    loop that starts again goes on with what it knows. A repeated batch publishes the same again; a loop with a new checkpoint starts
    from nothing. A step must not be split between micro-batches for its first publication to be its last.
    ``trigger``: as in ``DataStreamWriter.trigger``.
    """
    table = f"{checkpoint}/domains"

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number == 0:
            kv.clear(spark, table)
        before = kv.get(spark, table, below=number)
        before = spark.createDataFrame([], DOMAIN.format(row_id=batch.schema["row_id"].dataType.simpleString())) if before is None else before
        with Scratch(spark) as scratch:
            stats = scratch.keep(_refreshed(batch, before, window))
            steps = [r.step for r in stats.select("step").distinct().orderBy("step").collect() if r.step is not None and r.step >= warmup_step and r.step % max(1, update_step) == 0]
            known = scratch.keep(stats.drop("tail").unionByName(before.drop("tail").withColumn("step", F.lit(None).cast("long"))))
            for step in steps:  # the refresh steps of one micro-batch
                now = known.where(F.coalesce(F.col("step") <= step, F.lit(True)))
                now = now.groupBy("domain").agg(F.max_by(F.struct("step", "mean", "slope", "count"), F.coalesce("step", F.lit(-(1 << 62)))).alias("s")).select("domain", "s.*")
                publish(mixer.mix(now), step)
            kv.put(stats.where("tail is not null"), table, "domain", number)

    out = obs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (out.trigger(**trigger) if trigger else out).start()


def windowed_event_stats(events: DataFrame, *, time: str = "ts", late: str = "10 minutes", window: str = "5 minutes", by: str = "event_type") -> DataFrame:
    """Counts and sums by event-time window; rows later than ``late`` are dropped by the watermark."""
    e = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return e.groupBy(F.window(time, window), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
