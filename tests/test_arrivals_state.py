"""Late prompts and responses: rows meet by key and slot of time, and state is held once, on disk."""

import datetime
import glob
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from sluice import scratch
from sluice.plans.queries import QUERIES
from sluice.streaming.arrivals import answered, state_on_disk

D = "/root/testdata/sf0.001"
T0 = datetime.datetime(1969, 12, 31, 12)  # slots before 1970 too
HOUR = 3600


def rows(n, users, seed=3, start=T0):
    r = random.Random(seed)
    return [(i, r.randrange(users), start + datetime.timedelta(seconds=r.choice([r.randrange(40 * HOUR), HOUR * r.randrange(40)]))) for i in range(n)]


def brute(prompts, responses, seconds, how):
    pairs = [(p, r) for p, u, at in prompts for r, v, then in responses if u == v and 0 <= (then - at).total_seconds() <= seconds]
    if how == "left":
        pairs += [(p, None) for p in {x[0] for x in prompts} - {p for p, _ in pairs}]
    if how == "right":
        pairs += [(None, r) for r in {x[0] for x in responses} - {r for _, r in pairs}]
    return sorted(map(repr, pairs))


@pytest.mark.parametrize("how", ["inner", "left", "right"])
@pytest.mark.parametrize("within, seconds", [("1 hour", HOUR), ("90 seconds", 90), ("1 day", 24 * HOUR)])
def test_pairs_are_those_of_all_against_all(spark, how, within, seconds):
    p, r = rows(120, 3), rows(150, 3, seed=4)
    left, right = spark.createDataFrame(p, "p long, user long, prompt_ts timestamp"), spark.createDataFrame(r, "r long, user long, response_ts timestamp")
    got = answered(left, right, key="user", within=within, how=how)
    assert got.columns == ["p", "user", "prompt_ts", "r", "response_ts"]
    assert sorted(repr((x.p, x.r)) for x in got.collect()) == brute(p, r, seconds, how)


def test_a_key_with_many_rows_is_many_tasks(spark):
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        left, right = spark.createDataFrame(rows(300, 1), "p long, user long, prompt_ts timestamp"), spark.createDataFrame(rows(300, 1, seed=4), "r long, user long, response_ts timestamp")
        got = answered(left, right, key="user", within="1 hour")
        assert got.select(F.spark_partition_id().alias("t")).distinct().count() > 1
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_unanswered_prompts_of_a_stream_come_out_once(spark, tmp_path):
    end = (datetime.datetime(1980, 1, 1), datetime.datetime(1981, 1, 1))
    start = datetime.datetime(1975, 1, 1)  # a stream's watermark begins in 1970
    p, r = rows(60, 2, start=start), rows(40, 2, seed=4, start=start)
    for name, part in (("p", p[:30]), ("r", r[:20]), ("p", p[30:]), ("r", r[20:]), *[(k, [(9999 + i, 99, t)]) for i, t in enumerate(end) for k in "pr"]):
        spark.createDataFrame(part, f"{name} long, user long, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    prompts, responses = (spark.readStream.schema(f"{k} long, user long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / k)).withColumnRenamed("ts", t) for k, t in (("p", "prompt_ts"), ("r", "response_ts")))
    out = answered(prompts, responses, key="user", within="1 hour", late="3 days", how="left")
    with state_on_disk(spark, rows=100):
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(repr((x.p, x.r)) for x in spark.read.parquet(str(tmp_path / "o")).where("user < 99").collect())
    assert got == brute(p, r, HOUR, "left")


def test_settings_of_state_come_back(spark):
    names = "spark.sql.streaming.stateStore.providerClass", "spark.sql.streaming.noDataMicroBatches.enabled", "spark.sql.shuffle.partitions"
    before = [spark.conf.get(k, None) for k in names]
    with pytest.raises(KeyError), state_on_disk(spark, rows=10_000_000, trailing=False):
        assert spark.conf.get("spark.sql.streaming.stateStore.rocksdb.allowFAllocate") == "false"  # a share without rows took megabytes
        assert "RocksDB" in spark.conf.get(names[0]) and spark.conf.get(names[1]) == "false" and spark.conf.get(names[2]) == "4"
        raise KeyError
    assert [spark.conf.get(k, None) for k in names] == before


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
def test_a_part_is_one_batch_and_an_event_waits_in_one_state(spark, monkeypatch):
    roots = []
    monkeypatch.setattr(scratch.Scratch, "drop", lambda self: roots.append(self.root))
    QUERIES["stream_prompt_responses"](spark, D)
    check = next(x for x in (f"{r.removeprefix('file://')}/1/check" for r in roots) if os.path.isdir(x))
    assert sorted(os.path.basename(x) for x in glob.glob(f"{check}/offsets/[0-9]*")) == ["0", "1", "2", "3"]
    conf = json.loads(open(f"{check}/offsets/0").read().splitlines()[1])["conf"]
    assert "RocksDB" in conf["spark.sql.streaming.stateStore.providerClass"]
    held = [spark.read.format("statestore").option("operatorId", i).load(check).select("key.event_id") for i in (1, 2)]
    events = spark.read.parquet(f"{D}/events.parquet").select("event_id")
    assert held[0].unionAll(held[1]).exceptAll(events).count() == 0 and sum(x.count() for x in held) == events.count()
