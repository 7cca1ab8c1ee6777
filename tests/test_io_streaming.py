import json

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from sluice.functions.tables import register_tables
from sluice.operators import datasets, mixers, reports
from sluice.plans.schedule import observed
from sluice.sources import kv, readers, sinks
from sluice.streaming.mix_loop import domain_stats_stream, start_mix_loop, windowed_event_stats


def test_readers(spark, tmp_path):
    (tmp_path / "people3_x.jsonl").write_text(json.dumps({"quiz": "q", "solution_text": "s"}) + "\n\n")
    assert readers.read_people(spark, str(tmp_path / "people*.jsonl")).first().n_people == 3
    (tmp_path / "p.jsonl").write_text('{"prompt":[{"role":"user","content":"c"}],"answer":" 4 "}\n')
    r = readers.read_prompts(spark, str(tmp_path / "p.jsonl")).first()
    assert r.ground_truth == "4" and r.prompt[0].content == "c"
    d = tmp_path / "7b" / "topk_s2"
    d.mkdir(parents=True)
    (d / "gsm8k.json").write_text(json.dumps({"model": "m", "benchmark": "gsm8k", "n": 2, "acc": 0.5, "per_row": [{"acc": 1, "score": 1, "resp_len": 3}]}))
    r = readers.read_evals(spark, str(tmp_path / "*" / "*" / "*.json")).first()
    assert (r.scale, r.run, r.file_benchmark, r.acc) == ("7b", "topk_s2", "gsm8k", 0.5)
    (tmp_path / "m1.metrics").write_text('{"acc": 0, "accuracy": 5}')
    (tmp_path / "m2.metrics").write_text('{"overall": {"score": 0.25}}')
    assert sorted(x.value for x in readers.read_metrics(spark, str(tmp_path / "*.metrics")).collect()) == [0.0, 0.25]
    (tmp_path / "jobs.txt").write_text("# c\n\n7b|topk|1|a=1 b|c\n")
    j = readers.read_jobs(spark, str(tmp_path / "jobs.txt")).collect()
    assert [tuple(x) for x in j] == [("7b", "topk", 1, "a=1 b|c")]
    (tmp_path / "tool.csv").write_text("x,1\ngpqa,main,0.5\ngpqa,bad,\n")
    assert [x.number for x in readers.read_marked_lines(spark, str(tmp_path / "tool.csv"), "gpqa").collect()] == [0.5, None]
    log = spark.createDataFrame([("a df_kept:0.25 df_m1:2 x",)], "value string")
    assert {tuple(x) for x in readers.log_metrics(log, "df_").collect()} == {("df_kept", 0.25), ("df_m1", 2.0)}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.26, None), ("b", None, 2)], "k string, v double, n int")
    sinks.write_csv(df, str(tmp_path / "c"), ["n", "k"])
    assert readers.read_csv(spark, str(tmp_path / "c"), "n int, k string").count() == 2
    sinks.write_parquet(df, str(tmp_path / "p"))
    sinks.write_parquet(df.limit(0), str(tmp_path / "p"), skip_existing=True)
    assert readers.read_parquet(spark, str(tmp_path / "p")).count() == 2
    sinks.write_json(df, str(tmp_path / "j"))
    assert sinks.text_table(df) == "| k | v | n |\n|---|---|---|\n| a | 1.3 | -- |\n| b | -- | 2 |"
    assert sinks.text_table(df, "latex").splitlines()[1] == r"a & 1.3 & -- \\"
    assert sinks.text_table(df, "text").splitlines()[0] == "k  v    n"


def test_reports(spark):
    df = spark.createDataFrame([("s", "baseline", 1, 1.0, None), ("s", "m", 1, 2.0, 4.0), ("s", "m", 2, 4.0, None)], "scale string, method string, seed int, a double, b double")
    r = {x.method: x for x in reports.mean_std(df, ["method"], ["a", "b"]).collect()}
    assert r["baseline"].std_a == 0 and r["baseline"].mean_b is None and r["baseline"].std_b is None and r["m"].n_b == 1
    assert {x.method: x.macro for x in reports.macro_over_runs(df, ["method"], ["a", "b"]).collect()} == {"baseline": 1.0, "m": 3.5}
    m = reports.macro_of_means(df, ["scale", "method"], ["a", "b"])
    d = {x.method: x.delta for x in reports.against_baseline(m, ["scale"], "macro").collect()}
    assert d == {"baseline": 0.0, "m": 2.5}
    assert [x.method for x in reports.ranked(m, "macro", "method").collect()] == ["m", "baseline"]
    assert [x.method for x in reports.display_order(m, "method", ["m"]).collect()] == ["m", "baseline"]
    assert df.select(reports.complete_mean(["a", "b"]).alias("x")).collect()[0].x is None
    c = reports.completeness(df, ["a", "b"]).first()
    assert tuple(c) == (1, 3, 3)


def test_datasets(spark):
    df = spark.createDataFrame([("q  Let's think step by step. x", "(B)", "n_s12"), ("plain ", "raw", "odd")], "q string, t string, name string")
    got = df.select(datasets.strip_tail(F.col("q"), "Let's think step by step", "I").alias("a"), datasets.bracket_letter(F.col("t")).alias("b"), datasets.parse_run(F.col("name")).alias("r")).collect()
    assert [x.a for x in got] == ["q\n\nI", "plain \n\nI"] and [x.b for x in got] == ["B", "raw"]
    assert tuple(got[0].r) == ("n", 12) and got[1].r is None
    n = spark.createDataFrame([("",), (" 2.5 ",), ("x",)], "v string").select(datasets.number(F.col("v")).alias("n")).collect()
    assert [x.n for x in n] == [None, 2.5, None]


def test_streaming_mix_loop_equals_batch(spark, tmp_path):
    src, schema = tmp_path / "in", "step long, row_id long, domain string, value double"
    rows = [(s, i, d, float((s * 7 + i * 3) % 5)) for s in range(6) for i in range(4) for d in "ab"]
    for s in range(6):
        spark.createDataFrame([r for r in rows if r[0] == s], schema).coalesce(1).write.mode("append").parquet(str(src))
    got = {}
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    q = start_mix_loop(stream, mixers.RewardGap(["a", "b"]), lambda p, step: got.update({step: {r.domain: r.p for r in p.collect()}}), str(tmp_path / "cp"), window=5)
    q.processAllAvailable()
    q.stop()
    stats = mixers.domain_windows(spark.createDataFrame(rows, schema), window=5).where("step = 5")
    want = {r.domain: r.p for r in mixers.RewardGap(["a", "b"]).mix(mixers.latest(stats)).collect()}
    assert set(got) == set(range(6)) and all(abs(got[5][d] - want[d]) < 1e-9 for d in want)


def test_mix_loop_goes_on_after_a_restart(spark, tmp_path):
    """Domains that only the first run saw still count in the second, which has new objects and the checkpoint alone."""
    src, schema = tmp_path / "in", "step long, row_id long, domain string, value double"
    rows = [(s, i, d, float((s * 5 + i + ord(d)) % 7)) for s in range(4) for i in range(3) for d in ("abc" if s < 2 else "a")]
    got = {}
    for steps in ((0, 1), (2, 3)):
        for s in steps:
            spark.createDataFrame([r for r in rows if r[0] == s], schema).coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
        start_mix_loop(stream, mixers.RewardGap(["a", "b", "c"]), lambda p, step: got.update({step: {r.domain: r.p for r in p.collect()}}), str(tmp_path / "cp"), window=5, availableNow=True).awaitTermination()
    for step in range(4):
        seen = spark.createDataFrame([r for r in rows if r[0] <= step], schema)
        want = {r.domain: r.p for r in mixers.RewardGap(["a", "b", "c"]).mix(mixers.latest(mixers.domain_windows(seen, window=5))).collect()}
        assert got[step] == pytest.approx(want)


def test_keyed_table(spark, tmp_path):
    at, rows = str(tmp_path / "kv"), lambda *r: spark.createDataFrame(list(r), "k string, v int, w int")
    assert kv.get(spark, at) is None
    for version, put in enumerate([rows(("a", 1, 1), ("b", 2, 2)), rows(("b", 3, 3), ("c", 4, 4)), rows(("b", 3, 3), ("c", 4, 4)), rows(("a", 9, 9))]):
        kv.put(put, at, "k", version if version < 2 else version - 1)
    assert {tuple(r) for r in kv.get(spark, at).collect()} == {("a", 9, 9), ("b", 3, 3), ("c", 4, 4)}
    assert [tuple(r) for r in kv.get(spark, at, rows(("c", 0, 0), ("z", 0, 0)).select("k"), ["v"]).collect()] == [(4,)]
    assert kv.versions(spark, at) == [1, 2]


def test_table_function_and_function_mixer(spark):
    register_tables(spark)
    got = spark.sql("SELECT metric, number FROM metric_rows('x:1 m_a:2.5 m_b:1.2.3 m_:7', 'm_')").collect()
    assert [tuple(r) for r in got] == [("m_a", 2.5), ("m_", 7.0)]
    assert spark.sql("SELECT * FROM metric_rows(CAST(NULL AS STRING), 'm_')").count() == 0
    stats = spark.createDataFrame([("a", 2.0)], "domain string, mean double")
    p = {r.domain: r.p for r in mixers.FunctionMixer(["b", "a"], lambda rows: -rows["mean"], {"mean": 0.0}, floor=0.0).mix(stats).collect()}
    assert p["b"] > p["a"] and p["a"] + p["b"] == pytest.approx(1)


def test_event_windows(spark, tmp_path):
    e = spark.createDataFrame([(f"2024-01-01 00:0{i}:00", "a", 1.0) for i in range(8)], "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    e.write.parquet(str(tmp_path / "e"))
    q = windowed_event_stats(spark.readStream.schema(e.schema).parquet(str(tmp_path / "e"))).writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n for r in spark.sql("select n from w").collect()) == [3, 5]


def test_metrics_of_unknown_keys(spark):
    said = [
        '{"a": {"b c": 0, "d\'e": "1.5", "x": null, "t": true, "w": "word"}, "n": -2e3}',
        '{"a": 7, "list": [1], "deep": {"deep": {"deep": 1}}}',
        "not json", None, "3", "[1]", "{}",
    ]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "id int, said string")
    got = {tuple(r) for r in readers.metric_leaves(df, "said", ("id",)).collect()}
    assert got == {(0, "a.b c", 0.0), (0, "a.d'e", 1.5), (0, "n", -2000.0), (1, "a", 7.0), (1, "deep.deep.deep", 1.0)}
    for none in (df.where("id > 1"), df.limit(0)):
        assert readers.metric_leaves(none, "said", ("id",)).collect() == []


def test_levels_tell_a_null_key_from_a_total(spark):
    df = spark.createDataFrame([("a", None, 1.0), ("a", "x", 3.0), ("b", "x", None)], "k string, m string, v double")
    got = {(r.k, r.m, r.level): (r.n, r["mean"]) for r in reports.levels(df, ["k", "m"], "v").collect()}
    assert got == {("a", None, 0): (1, 1.0), ("a", "x", 0): (1, 3.0), ("b", "x", 0): (0, None), ("a", None, 1): (2, 2.0), ("b", None, 1): (0, None), (None, None, 2): (2, 2.0)}


def test_metrics_are_gathered_in_the_pass_that_writes(spark, tmp_path):
    rows = [(1, [1.0, 2.0, 9.0], [1, 1, 0]), (2, [4.0], [1]), (3, [], [])]
    df = spark.createDataFrame(rows, "step int, weight_tok array<double>, response_mask array<int>")
    seen = Observation()
    observed(df, seen).write.parquet(str(tmp_path / "w"))
    assert seen.get == {"first_step": 1, "last_step": 3, "n": 3, "weight_mean": pytest.approx(7 / 3), "weight_std": pytest.approx(1.5275252), "kept_frac": None}
    seen = Observation()
    observed(df.select("step", F.lit(1.0).alias("weight"), (F.col("step") > 2).alias("kept")), seen).count()
    assert seen.get["kept_frac"] == pytest.approx(1 / 3) and seen.get["weight_std"] == 0


def test_domain_stats_of_hot_domains_in_many_frames(spark, tmp_path):
    rows = [(i // 40, i, ("hot", "hot", "hot", "b", None)[i % 5], float(i * 37 % 101)) for i in range(600)]
    schema, src, got = "step int, row_id long, domain string, value double", str(tmp_path / "in"), {}
    for lo in (0, 360):  # two micro-batches of four files each
        spark.createDataFrame([r for r in rows if lo <= r[1] < (360 if lo == 0 else 600)][::-1], schema).repartition(4).write.mode("append").parquet(src)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        try:
            stats = domain_stats_stream(spark.readStream.schema(schema).parquet(src), window=20)
            each = lambda b, _: got.update({r.domain: r for r in b.collect()})
            stats.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for d in ("hot", "b", None):
        values = [r[3] for r in rows if r[2] == d]
        slope = np.polyfit(range(20), values[-20:], 1)[0]
        assert got[d]["count"] == len(values)
        assert got[d].step == 14 and got[d].mean == pytest.approx(np.mean(values[-20:])) and got[d].slope == pytest.approx(slope)
