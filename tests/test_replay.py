"""The waiting buffer and late arrivals as streams, against batch operators and loops."""

import random
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sluice.operators.sampling import quota_sample, quota_targets
from sluice.streaming.arrivals import answered, once, sessions, with_age
from sluice.streaming.replay import replay_batches

POOL = "uid long, domain string, step long, status string"


def files(spark, at, parts, schema):
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(at)


def stream(spark, at, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(at)


def run(df, out, check, mode="append"):
    df.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()


def pool(n=400, seed=2):
    r = random.Random(seed)
    return [(i, r.choice("aaaabc"), i // 10, r.choice(["finished", "failed", "running"])) for i in range(n)]


def test_batches_wait_across_a_restart(spark, tmp_path):
    rows, targets = pool(), {"a": 20, "b": 10, "c": 0}
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    files(spark, src, [rows[:150], rows[150:260]], POOL)
    run(replay_batches(stream(spark, src, POOL), targets), out, check)
    first = spark.read.parquet(out).count()
    files(spark, src, [rows[260:] + rows[300:310]], POOL)  # some twice
    run(replay_batches(stream(spark, src, POOL), targets), out, check)
    got = spark.read.parquet(out).collect()
    assert 0 < first < len(got) and all(r.complete for r in got)
    for d, n in (("a", 20), ("b", 10)):
        ready = [r[0] for r in rows if r[1] == d and r[3] != "running"]
        mine = defaultdict(list)
        for r in got:
            if r.domain == d:
                mine[r.batch].append(r.uid)
        assert {k: sorted(v) for k, v in mine.items()} == {k: ready[k * n : (k + 1) * n] for k in range(len(ready) // n)}
    df = spark.createDataFrame(rows, POOL).where("status <> 'running'")
    t = quota_targets(spark.createDataFrame([(0, "a", 2 / 3), (1, "b", 1 / 3)], "domain_ord int, domain string, p double"), 30)
    assert {r.uid for r in quota_sample(df, t, 30).collect() if r.phase == 0} == {r.uid for r in got if r.batch == 0}


def test_shards_lag_and_patience(spark, tmp_path):
    rows = [(i, "a", i // 10, "finished") for i in range(200)]
    src = str(tmp_path / "in")
    files(spark, src, [rows[:100], rows[100:]], POOL)
    run(replay_batches(stream(spark, src, POOL), {"a": 7}, shards=3), str(tmp_path / "o1"), str(tmp_path / "c1"))
    got = spark.read.parquet(str(tmp_path / "o1")).collect()
    sizes = defaultdict(int)
    for r in got:
        sizes[r.shard, r.batch] += 1
    assert {s for s, _ in sizes} == {0, 1, 2} and all(n == (3 if s == 0 else 2) for (s, _), n in sizes.items()) and len({r.uid for r in got}) == len(got)
    run(replay_batches(stream(spark, src, POOL), {"a": 150}, max_lag=4), str(tmp_path / "o2"), str(tmp_path / "c2"))
    assert spark.read.schema("uid long").parquet(str(tmp_path / "o2")).count() == 0  # never so many within five steps
    q = replay_batches(stream(spark, src, POOL), {"a": 150}, patience=1).writeStream.format("memory").queryName("short_batches").option("checkpointLocation", str(tmp_path / "c3")).start()
    n, until = (0, 0), time.monotonic() + 60
    try:  # timers keep such a query busy, so that it never says that it is done
        while not n[1] and time.monotonic() < until and q.isActive:
            time.sleep(1)
            n = spark.sql("select count(*), count_if(not complete) from short_batches").first()
    finally:
        q.stop()
    assert n[0] and n[1]
    with pytest.raises(ValueError, match="shard"):
        replay_batches(stream(spark, src, POOL), {"a": 1}, shards=2)


E = "id long, user long, kind string, ts timestamp_ntz, value double"


@pytest.fixture(scope="module")
def events(spark):
    import datetime

    r, t0 = random.Random(5), datetime.datetime(2024, 1, 1)
    rows = sorted((t0 + datetime.timedelta(seconds=r.randrange(86400))) for _ in range(500))
    rows = [(i, r.randrange(8), r.choice("pr"), t, 1.0) for i, t in enumerate(rows)]
    late = [x for x in rows if x[0] % 9 == 0]
    early = [x for x in rows if x[0] % 9]
    flush = [(9999 + i, 99, k, datetime.datetime(2025, 1, 1), 0.0) for i, k in enumerate("pr")]  # moves the watermark past all
    parts = [early[:200], early[200:] + late[:10], late[10:] + early[:20]]
    return rows, parts, flush


def arriving(spark, at, parts):
    files(spark, at, parts, "id long, user long, kind string, ts timestamp, value double")
    return stream(spark, at, "id long, user long, kind string, ts timestamp, value double")


def test_prompts_meet_their_responses(spark, tmp_path, events):
    rows, parts, flush = events
    e = once(arriving(spark, str(tmp_path / "in"), [*parts, flush]), ["id"], late="2 days")
    prompts = e.where("kind = 'p'").select("user", F.col("id").alias("p"), F.col("ts").alias("prompt_ts"))
    responses = e.where("kind = 'r'").select("user", F.col("id").alias("r"), F.col("ts").alias("response_ts"))
    want = {(a[0], b[0], float((b[3] - a[3]).total_seconds())) for a in rows if a[2] == "p" for b in rows if b[2] == "r" and a[1] == b[1] and 0 <= (b[3] - a[3]).total_seconds() <= 3600}
    run(with_age(answered(prompts, responses, key="user", within="1 hour", late=None)).select("p", "r", "age"), str(tmp_path / "o"), str(tmp_path / "c"))
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "o")).where("p < 9999").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_sessions(spark, tmp_path, events):
    rows, parts, flush = events
    s = arriving(spark, str(tmp_path / "in"), [*parts[:2], parts[2][: len(parts[2]) - 20], flush, [(10_001, 99, "p", flush[0][3].replace(year=2026), 0.0)]])
    run(sessions(s, key="user", gap="30 minutes", late="2 days"), str(tmp_path / "o"), str(tmp_path / "c"))
    want = []
    for u in range(8):
        ts = sorted(r[3] for r in rows if r[1] == u)
        while ts:
            n = 1
            while n < len(ts) and (ts[n] - ts[n - 1]).total_seconds() < 1800:
                n += 1
            want.append((u, n))
            ts = ts[n:]
    assert sorted((r.user, r.n) for r in spark.read.parquet(str(tmp_path / "o")).where("user < 99").collect()) == sorted(want)
