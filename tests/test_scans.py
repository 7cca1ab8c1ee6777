"""Groups of any size: ranks, prefix sums and carries over ranges against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sluice.operators import mixers, selectors
from sluice.operators.ranges import in_ranges
from sluice.scratch import Scratch
from sluice.streaming.mix_loop import start_mix_loop


@pytest.fixture(scope="module")
def wide(spark):
    """Sixteen shuffle partitions, so that one group is many ranges."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def rows_of(n, groups=1, seed=1, ties=0):
    r = random.Random(seed)
    return [(0, r.randrange(groups), i, float(r.randrange(ties)) if ties else r.random(), [1] * r.randrange(1, 9)) for i in range(n)]


SCHEMA = "step int, uid int, row int, score double, response_mask array<int>"


def test_one_group_is_many_ranges(wide):
    with Scratch(wide) as scratch:
        _, ranges = in_ranges(wide.createDataFrame(rows_of(2000), SCHEMA), ["step", "uid"], ["score"], scratch)
        assert ranges.count() >= 8


def best_split(scores, n):
    """(variance, low rows) of the best split, by trying all; with equal variances the fewest low rows."""
    s = sorted(scores)
    if n >= len(s):
        return None
    def var(x):
        return round(sum(a * a for a in x) / n - (sum(x) / n) ** 2, 9)
    return max(((var(s[:a] + s[len(s) - (n - a):]), -a) for a in range(n + 1)))


@pytest.fixture(params=[10_000, 100], ids=["windows", "ranges"])
def form(request, monkeypatch):
    monkeypatch.setattr(selectors, "WINDOW", request.param)


@pytest.mark.parametrize("n,groups,ties,tie", [(1500, 1, 0, ("row",)), (600, 5, 7, ("row",)), (600, 2, 3, ()), (40, 40, 2, ("row",)), (300, 1, 1, ())])
def test_max_variance(wide, form, n, groups, ties, tie):
    rows = rows_of(n, groups, ties=ties)
    df = wide.createDataFrame(rows, SCHEMA)
    got = selectors.MaxVariance(0.4, tie=tie).select(df).collect()
    assert len(got) == n
    for g in range(groups):
        scores = [r[3] for r in rows if r[1] == g]
        kept = sorted(r.score for r in got if r.uid == g and r.kept)
        if not scores:
            continue
        want = max(1, round(0.4 * len(scores)))
        assert len(kept) == want
        best = best_split(scores, want)
        if best:
            s = sorted(scores)
            assert kept == sorted(s[: -best[1]] + s[len(s) - (want + best[1]) :])


@pytest.mark.parametrize("metric", ["short", "efficiency"])
@pytest.mark.parametrize("ties,tie", [(0, ("row",)), (3, ()), (3, ("row",))])
def test_gfpo(wide, form, metric, ties, tie):
    rows = rows_of(900, 3, ties=ties)
    got = selectors.Gfpo(50, metric, tie=tie).select(wide.createDataFrame(rows, SCHEMA)).collect()
    worth = lambda r: -len(r[4]) if metric == "short" else r[3] / len(r[4])
    for g in range(3):
        mine = [r for r in rows if r[1] == g]
        order = sorted(mine, key=lambda r: (-worth(r), r[2]))[:50]
        kept = [r for r in got if r.uid == g and r.kept]
        assert len(kept) == 50
        if tie:
            assert {r.row for r in kept} == {r[2] for r in order}
        else:
            assert sorted(worth(tuple(r)) for r in kept) == sorted(map(worth, order))


def test_topk_of_equal_rows(wide):
    rows = [(s, 0, 0, 1.0, [1]) for s in range(2) for _ in range(501)]
    got = selectors.TopkFraction(0.5, tie=()).select(wide.createDataFrame(rows, SCHEMA)).where("kept").groupBy("step").count().collect()
    assert {r["count"] for r in got} == {250}


def test_selectors_without_rows(wide):
    none = wide.createDataFrame([], SCHEMA)
    for s in (selectors.MaxVariance(0.5, tie=()), selectors.Gfpo(2, "short", tie=()), selectors.TopkFraction(0.5, tie=())):
        got = s.select(none)
        assert got.columns == [*none.columns, "kept"] and not got.collect()


def test_null_scores_are_lowest(wide):
    rows = [(0, 0, i, s, [1]) for i, s in enumerate([None, 1.0, 2.0, 9.0])]
    got = {r.row for r in selectors.MaxVariance(0.5, tie=("row",)).select(wide.createDataFrame(rows, SCHEMA)).where("kept").collect()}
    assert got == {0, 3}


@pytest.mark.parametrize("beta", [0.0, 0.1, 0.5, 0.9, 0.999])
def test_ewma(wide, beta):
    r = random.Random(3)
    rows = [("a" if r.random() < 0.9 else None, i, None if r.random() < 0.05 else r.uniform(-1, 1), "x") for i in range(3000)]
    df = wide.createDataFrame(rows, "domain string, step int, value double, ewma string").drop("ewma").repartition(5)
    want, s = {}, {}
    for d, i, v, _ in rows:
        s[d] = beta * s.get(d, 0.0) + (1 - beta) * (v or 0.0)
        want[i] = s[d]
    path = {x.step: x.ewma for x in mixers.ewma_path(df, beta=beta).collect()}
    assert path == pytest.approx(want, abs=1e-12)
    assert {x.domain: x.ewma for x in mixers.ewma(df, beta=beta).collect()} == pytest.approx(s, abs=1e-12)


def test_no_window_by_domain_alone(wide, capsys):
    df = wide.range(100).select(F.lit("a").alias("domain"), F.col("id").alias("step"), F.col("id").cast("double").alias("value"))
    for f in (mixers.ewma, mixers.ewma_path):
        f(df).explain()
        assert "Window" not in capsys.readouterr().out  # what is left is a checkpoint


def test_asof_join(wide):
    r = random.Random(9)
    keys = ["a"] * 8 + ["b", None, "only events"]
    events = [(i, r.choice(keys), r.choice([None, *range(200)]), "e") for i in range(1500)]
    updates = [(r.choice(["a"] * 8 + ["b", None, "only updates"]), r.choice([None, *range(200)]), r.random()) for _ in range(150)]
    want = {}
    for i, k, t, _ in events:
        known = [(u[1], u[2]) for u in updates if u[0] == k and u[1] is not None and t is not None and u[1] <= t]
        want[i] = max(known)[1] if known else None
    e = wide.createDataFrame(events, "id int, k string, ts int, _u string").withColumnRenamed("_u", "other")
    got = mixers.asof_join(e, wide.createDataFrame(updates, "k string, ts int, p double"), ["k"], ["p"])
    assert got.columns == ["id", "k", "ts", "other", "p"]
    rows = got.collect()
    assert len(rows) == 1500 and {x.id: x.p for x in rows} == want
    none = wide.createDataFrame([], "k string, ts int, p double")
    assert mixers.asof_join(e, none, ["k"], ["p"]).where("p is null").count() == 1500


def test_exp3_over_steps_equals_its_steps(wide):
    r = random.Random(2)
    domains, gamma = ["a", "b", "c"], 0.3
    rewards = [(s * 2, d, r.random()) for s in range(130) for d in "abc" if r.random() < 0.7] + [(5, "unlisted", 1.0), (None, "a", 1.0)]
    before = wide.conf.get("spark.sql.cteRecursionLevelLimit")
    got = {(x.step, x.domain): (x.p, x.log_weight) for x in mixers.Exp3(domains, gamma).over_steps(wide.createDataFrame(rewards, "step int, domain string, reward double")).collect()}
    assert wide.conf.get("spark.sql.cteRecursionLevelLimit") == before
    lw = dict.fromkeys(domains, 0.0)
    for s in sorted({x[0] for x in rewards if x[0] is not None and x[1] in domains}):
        e = {d: math.exp(lw[d] - max(lw.values())) for d in domains}
        p = {d: (1 - gamma) * e[d] / sum(e.values()) + gamma / 3 for d in domains}
        for d in domains:
            assert got[s, d] == pytest.approx((p[d], lw[d]))
        for t, d, x in rewards:
            if t == s and d in lw:
                lw[d] += gamma * x / (3 * p[d])
    assert len(got) == 3 * len({x[0] for x in rewards if x[0] is not None and x[1] in domains})


def test_live_loop_publishes_every_refresh_step(wide, tmp_path):
    r, schema = random.Random(4), "step long, row_id long, domain string, value double"
    rows = [(s, i, d, r.random()) for s in range(12) for i in range(15) for d in "ab" if d == "a" or s < 3]
    got = {}
    for steps in ((0, 5), (5, 12)):
        wide.createDataFrame([x for x in rows if steps[0] <= x[0] < steps[1]], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = wide.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        start_mix_loop(stream, mixers.RewardGap(["a", "b"]), lambda p, step: got.update({step: {x.domain: x.p for x in p.collect()}}), str(tmp_path / "c"), window=40, update_step=3, availableNow=True).awaitTermination()
    assert sorted(got) == [0, 3, 6, 9]
    for step in got:
        seen = wide.createDataFrame([x for x in rows if x[0] <= step], schema)
        want = {x.domain: x.p for x in mixers.RewardGap(["a", "b"]).mix(mixers.latest(mixers.domain_windows(seen, window=40))).collect()}
        assert got[step] == pytest.approx(want)
