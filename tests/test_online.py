import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sluice.functions.tables import register_tables
from sluice.operators import sketches
from sluice.operators.scorers import FunctionGroupScorer
from sluice.scratch import Scratch


@pytest.fixture(scope="module")
def rows(spark):
    # step 0 holds most rows; equal scores in step 1; null and NaN scores beside them
    s = F.when(F.col("id") % 7 < 5, 0).when(F.col("id") % 7 == 5, 1)
    score = F.when(F.col("id") % 500 == 0, F.lit(float("nan"))).when(F.col("id") % 501 == 0, F.lit(None)).when(s == 1, F.lit(2.0)).otherwise((F.hash("id") % 10_007).cast("double"))
    return spark.range(0, 60_000, numPartitions=8).select(s.alias("step"), score.alias("score"), F.col("id").alias("n"), F.lit("mine").alias("cut")).cache()


def _ranks(spark, path, rows, q):
    cut = {r.step: r for r in sketches.thresholds(spark, path, q).collect()}
    p = rows.where("step is not null and score is not null and not isnan(score)").select("step", "score").toPandas()
    out = {}
    for step, g in p.groupby("step"):
        assert cut[step].n == len(g)
        out[step] = ((g.score > cut[step].cut).mean(), (g.score >= cut[step].cut).mean())
    assert set(out) == set(cut)
    return out


@pytest.mark.parametrize("k", [200, 1_600])
def test_thresholds_of_batches_in_any_order(spark, rows, k):
    for i, order in enumerate(itertools.islice(itertools.permutations(range(3)), 3)):
        with Scratch(spark) as scratch:
            at = scratch.place()
            for version, part in enumerate(order):
                for _ in range(2 if version == 2 else 1):  # a repeated batch counts once
                    sketches.absorb(rows.where(F.col("n") % 3 == part), at, version, k=k)
            for q in (0.05, 0.3, 0.9):
                for above, upto in _ranks(spark, at, rows, q).values():
                    assert above - sketches.rank_error(k) <= q <= upto + sketches.rank_error(k), (i, q)


def test_online_selection_of_odd_rows(spark, rows):
    with Scratch(spark) as scratch:
        at = scratch.place()
        with pytest.raises(ValueError):
            sketches.thresholds(spark, at, 0.5)
        sketches.absorb(rows.limit(0), at, 0)
        assert sketches.thresholds(spark, at, 0.5).count() == 0
        sketches.absorb(rows, at, 1)
        out = sketches.select_online(rows, sketches.thresholds(spark, at, 0.5))
        assert out.columns == [*rows.columns, "kept"] and out.count() == 60_000
        assert out.where("kept and (step is null or score is null or isnan(score))").count() == 0
        assert out.where("step = 1 and score = 2 and not kept").count() == 0  # ties with the cut are in
        assert {r.cut for r in out.select("cut").distinct().collect()} == {"mine"}


def test_group_scores_by_functions(spark):
    """A group over many batches, null keys, and a group of one row, against pandas."""
    d = spark.range(0, 9_000, numPartitions=6).select(
        F.when(F.col("id") % 3 > 0, F.lit("hot")).when(F.col("id") == 0, F.lit("one")).when(F.col("id") % 2 == 0, F.lit("b")).alias("uid"),
        (F.col("id") % 101).cast("double").alias("x"),
        F.lit(1).alias("state"),
    )
    spread = FunctionGroupScorer(lambda b: [b.x.max(), b.x.min(), len(b)], lambda v: float(v[:, 0].max() - v[:, 1].min() + v[:, 2].sum()), ("x",))
    got = {(r.uid, r.score, r.n) for r in spread.score(d).groupBy("uid", "score").agg(F.count("*").alias("n")).collect()}
    p = d.toPandas()
    want = {(None if pd.isna(u) else u, float(g.x.max() - g.x.min() + len(g)), len(g)) for u, g in p.groupby("uid", dropna=False)}
    assert got == want and spread.score(d).columns == ["uid", "x", "state", "score"]
    assert spread.score(d.limit(0)).count() == 0
    numbers = spark.createDataFrame([(1, 2.0), (None, 3.0), (None, 5.0)], "uid long, x double")
    assert sorted((r.uid or 0, r.score) for r in spread.score(numbers).collect()) == [(0, 4.0), (0, 4.0), (1, 1.0)]
    assert np.isnan(FunctionGroupScorer(lambda b: [0.0], lambda v: float("nan"), ("x",)).score(numbers).first().score)


def test_columns_that_a_query_names(spark):
    register_tables(spark)
    lines = spark.createDataFrame([("a:1 b:-2.5 a:9",), ("xa:3",), ("",), (None,)], "line string")
    got = spark.sql("SELECT line, a, b FROM {t}, LATERAL metric_columns(line, 'a,b')", t=lines).collect()
    assert [(r.a, r.b) for r in got] == [(1.0, -2.5), (None, None), (None, None), (None, None)]
    with pytest.raises(Exception, match="constant list"):
        spark.sql("SELECT * FROM {t}, LATERAL metric_columns(line, line)", t=lines).collect()
