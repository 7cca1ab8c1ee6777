import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.functions.arrays import array_total
from sluice.operators import mixers, reweighters, sampling, scorers, selectors
from sluice.plans.schedule import MixReplay, Schedule, selection_mask, weight_metrics

SCHEMA = "step int, row_id int, uid string, score double, response_mask array<int>, rm_scores array<double>, advantages array<double>, old_log_probs array<double>"


def batch(spark, values, uids=None, lengths=None, step=0):
    n = len(values)
    rows = []
    for i, v in enumerate(values):
        k = (lengths or [4] * n)[i]
        tok = [0.0] * (k - 1) + [float(v)]
        rows.append((step, i, (uids or ["u"] * n)[i], float(v), [1] * k, tok, tok, [math.log(0.5)] * k))
    return spark.createDataFrame(rows, SCHEMA)


def col(df, c="score"):
    return [r[0] for r in df.orderBy("row_id").select(c).collect()]


def kept(df):
    return [r[0] for r in df.where("kept").orderBy("row_id").select("row_id").collect()]


def drawn(spark, seed, size=40):
    """Random responses of several steps and prompts, and the same as plain rows."""
    r = random.Random(seed)
    rows = []
    for i in range(size):
        n = r.randint(1, 6)
        mask = [int(j < r.randint(1, n)) for j in range(n)]
        tok = [round(r.uniform(-2, 2), 3) for _ in range(n)]
        rows.append((r.randint(0, 2), i, r.choice("PQRST"), round(r.uniform(-3, 3), 3), mask, tok, [round(r.uniform(-2, 2), 3) for _ in range(n)], [-r.random() for _ in range(n)]))
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return spark.createDataFrame(rows, SCHEMA), [dict(zip(names, x)) for x in rows]


def by(rows, *keys):
    out = {}
    for x in rows:
        out.setdefault(tuple(x[k] for k in keys), []).append(x)
    return out


def total(x, column):
    return sum(v * m for v, m in zip(x[column], x["response_mask"]))


@pytest.mark.parametrize("seed", range(3))
def test_scorers_against_loops(spark, seed):
    df, rows = drawn(spark, seed)
    near = lambda got, want: all(a == pytest.approx(b, abs=1e-9) for a, b in zip(got, want, strict=True))
    assert near(col(scorers.RewardDifficulty().score(df)), [total(x, "rm_scores") for x in rows])
    size = lambda x: [abs(v) * m for v, m in zip(x["advantages"], x["response_mask"])]
    assert near(col(scorers.AdvantageMagnitude("sum").score(df)), [sum(size(x)) for x in rows])
    assert near(col(scorers.AdvantageMagnitude("max").score(df)), [max(size(x)) for x in rows])
    assert near(col(scorers.AdvantageMagnitude().score(df)), [sum(size(x)) / max(1, sum(x["response_mask"])) for x in rows])
    for cut in (-0.5, 0.0, 0.5):
        rate = {k: sum(total(x, "rm_scores") > cut for x in g) / len(g) for k, g in by(rows, "step", "uid").items()}
        assert near(col(scorers.GroupSolveRate(cut).score(df)), [rate[x["step"], x["uid"]] for x in rows])
    for got, x in zip(col(scorers.TokenProb().score(df)), rows):
        assert near(got, [math.exp(v) for v in x["old_log_probs"]])


def test_missing_columns(spark):
    with pytest.raises(KeyError):
        scorers.RewardDifficulty().score(batch(spark, [1]).drop("rm_scores"))
    with pytest.raises(KeyError, match="uid"):
        scorers.GroupSolveRate().score(batch(spark, [1]).drop("uid"))


def test_rm_scores_win(spark):
    b = batch(spark, [1.0]).withColumn("token_level_scores", F.array(F.lit(9.0)))
    assert col(scorers.RewardDifficulty().score(b)) == [1.0]
    assert col(scorers.RewardDifficulty().score(b.drop("rm_scores"))) == [9.0]


@pytest.mark.parametrize("seed", range(3))
def test_reweighters_against_loops(spark, seed):
    df, rows = drawn(spark, seed)

    def scaled(raw):
        mean = {k: sum(raw[x["row_id"]] for x in g) / len(g) for k, g in by(rows, "step").items()}
        return [raw[x["row_id"]] / mean[x["step"],] for x in rows]

    def check(w, raw):
        assert col(w.reweight(df), "weight") == pytest.approx(scaled({x["row_id"]: raw(x) for x in rows}), rel=1e-6)

    for t in (0.5, 3.0):
        check(reweighters.Softmax(t), lambda x: math.exp(x["score"] / t))
    for alpha in (0.0, 0.7, 1.0):
        check(reweighters.PerAdvantage(alpha), lambda x: (abs(x["score"]) + 1e-8) ** alpha)
    for low, high, focus in ((0.1, 0.6, 5.0), (0.25, 0.75, 2.0), (0.0, 1.0, 3.0), (0.5, 0.5, 4.0)):
        ends = {k: np.quantile([x["score"] for x in g], (low, high)) for k, g in by(rows, "step").items()}
        inside = lambda x: ends[x["step"],][0] - 1e-12 <= x["score"] <= ends[x["step"],][1] + 1e-12  # noqa: E731, B023
        check(reweighters.DifficultyBand(low, high, focus), lambda x: focus if inside(x) else 1.0)
    alpha = 0.3
    tok = {x["row_id"]: [alpha * math.exp(v) + 1 - alpha for v in x["old_log_probs"]] for x in rows}
    scale = {k: sum(sum(x["response_mask"]) for x in g) / sum(sum(a * b for a, b in zip(tok[x["row_id"]], x["response_mask"])) for x in g) for k, g in by(rows, "step").items()}
    for got, x in zip(col(reweighters.AdvantageReweight(alpha).reweight(scorers.TokenProb().score(df)), "weight_tok"), rows):
        assert got == pytest.approx([v * scale[x["step"],] for v in tok[x["row_id"]]])
    assert col(reweighters.DifficultyBand().reweight(df.where("row_id = 7")), "weight") == [1.0]


def test_reweighters_without_a_score(spark):
    """A null score is in no band and has no part in its quantiles."""
    df = batch(spark, [1, 2, 3, 4]).withColumn("score", F.when(F.col("row_id") < 3, F.col("score")))
    assert col(reweighters.DifficultyBand(0.5, 1.0, 3.0).reweight(df), "weight") == pytest.approx([0.5, 1.5, 1.5, 0.5])
    none = df.withColumn("score", F.lit(None).cast("double"))
    assert col(reweighters.DifficultyBand().reweight(none), "weight") == [1.0] * 4
    assert sorted(col(selectors.TopkFraction().select(none), "kept")) == [False, False, True, True]


@pytest.mark.parametrize("make,value", [(reweighters.AdvantageReweight, -0.1), (reweighters.Softmax, -1), (selectors.TopkFraction, 1.01), (selectors.TopkFraction, -1), (selectors.MaxVariance, 0), (selectors.Gfpo, 0), (reweighters.MediumBump, 1)])
def test_options_out_of_range(make, value):
    with pytest.raises(ValueError):
        make(value) if make is not reweighters.MediumBump else make(0.5, 0.0)


@pytest.mark.parametrize("seed", range(4))
def test_selectors_against_loops(spark, seed):
    df, rows = drawn(spark, seed, 70)
    df, rows = df.withColumn("score", F.round("score", seed % 2)), [x | {"score": float(round(x["score"], seed % 2))} for x in rows]
    rounded = {r.row_id: r.score for r in df.collect()}
    rows = [x | {"score": rounded[x["row_id"]]} for x in rows]
    chosen = lambda sel: set(kept(sel.select(df)))
    for low, high in ((-1.0, 1.0), (0.0, 2.0)):
        assert chosen(selectors.ThresholdBand(low, high)) == {x["row_id"] for x in rows if low < x["score"] < high}
        assert chosen(selectors.ThresholdBand(low, high, inclusive=True)) == {x["row_id"] for x in rows if low <= x["score"] <= high}
    for share in (0.07, 0.5, 1.0):
        for sign in (1, -1):
            want = set()
            for g in by(rows, "step").values():
                g = sorted(g, key=lambda x: (-sign * x["score"], x["row_id"]))
                want |= {x["row_id"] for x in g[: max(1, round(share * len(g)))]}
            assert chosen(selectors.TopkFraction(share, sign > 0)) == want
    for k in (1, 3):
        for metric in ("short", "efficiency"):
            want = set()
            for g in by(rows, "step", "uid").values():
                key = lambda x: (sum(x["response_mask"]) or 1) if metric == "short" else -x["score"] / (sum(x["response_mask"]) or 1)  # noqa: E731, B023
                want |= {x["row_id"] for x in sorted(g, key=lambda x: (key(x), x["row_id"]))[:k]}
            assert chosen(selectors.Gfpo(k, metric)) == want


@pytest.mark.parametrize("seed", range(4))
def test_max_variance_brute_force(spark, seed):
    r = random.Random(seed)
    groups = {f"g{i}": [round(r.random(), 2) for _ in range(r.randint(1, 7))] for i in range(12)}
    vals = [v for g in groups.values() for v in g]
    uids = [u for u, g in groups.items() for _ in g]
    out = selectors.MaxVariance(0.6).select(batch(spark, vals, uids)).where("kept").groupBy("uid").agg(F.collect_list("score").alias("s"), F.var_pop("score").alias("v")).collect()
    var = lambda s: sum(x * x for x in s) / len(s) - (sum(s) / len(s)) ** 2
    for row in out:
        g = groups[row.uid]
        n = max(1, round(0.6 * len(g)))
        assert len(row.s) == n
        if n < len(g):
            assert row.v == pytest.approx(max(var(c) for c in itertools.combinations(g, n)), abs=1e-8)


def test_functions_as_components(spark):
    b = batch(spark, [1, 2, 3, 4], list("AABB"))
    doubled = scorers.FunctionScorer(lambda s: s * 2, ("score",)).score(b)
    assert col(doubled) == [2, 4, 6, 8]
    best = selectors.FunctionSelector(lambda rows: rows["score"] == rows["score"].max()).select(b)
    assert kept(best) == [1, 3]
    with pytest.raises(KeyError):
        scorers.FunctionScorer(lambda s: s, ("nothing",)).score(b)


def test_optional_components(spark):
    w = col(reweighters.MediumBump().reweight(batch(spark, [0, 0.5, 1])), "weight")
    assert w[1] > w[0] == pytest.approx(w[2]) and sum(w) == pytest.approx(3)
    m = mixers.Exp3(["a", "b"], 0.2)
    s = spark.createDataFrame([("a", 0.0), ("b", 0.0)], "domain string, log_weight double")
    assert props(m.mix(s)) == {"a": 0.5, "b": 0.5}
    s = m.updated(s, spark.createDataFrame([("a", 1.0)], "domain string, reward double"))
    assert {r.domain: r.log_weight for r in s.collect()} == {"a": pytest.approx(0.2), "b": 0.0} and props(m.mix(s))["a"] > 0.5
    s = spark.createDataFrame([("a", 0.9, 5), ("b", 0.1, 1)], "domain string, mean double, last_step int")
    p = props(mixers.ReplayPriority(["a", "b"], 0.5).mix(s))
    assert p["a"] == pytest.approx(0.5 * 2 / 3) and p["b"] == pytest.approx(0.5 / 3 + 0.5)
    b = batch(spark, [1, 1, 0, 1], list("AABB")).union(batch(spark, [1, 1, 1, 1], list("AABB"), step=1))
    z = {r.uid: r.zero_streak for r in selectors.zero_variance_streak(b).collect()}
    assert z == {"A": 2, "B": 1}


def test_needed_columns(spark):
    s = Schedule.named("gfpo", runtime={"tie": ("row_id",)})
    assert set(s.needed(batch(spark, [1.0])).columns) == {"response_mask", "step", "row_id", "uid", "rm_scores"}


def test_empty_batch(spark):
    b = batch(spark, [1.0]).limit(0)
    for s in (selectors.TopkFraction(), selectors.Gfpo(), selectors.MaxVariance(), selectors.ThresholdBand()):
        assert s.select(b).count() == 0
    for w in (reweighters.Softmax(), reweighters.DifficultyBand(), reweighters.PerAdvantage()):
        assert w.reweight(b).count() == 0


def props(df):
    rows = df.orderBy("domain_ord").collect()
    assert sum(r.p for r in rows) == pytest.approx(1)
    return {r.domain: r.p for r in rows}


@pytest.mark.parametrize("seed", range(4))
def test_mixers_against_loops(spark, seed):
    r = random.Random(seed)
    names = [f"m{i}" for i in range(r.randint(1, 6))]
    known = {d: (round(r.uniform(-1, 1), 3), round(r.uniform(-1, 1), 3), r.randint(0, 60)) for d in [*names, "other"] if d == "other" or r.random() < 0.8}
    of = lambda d: known.get(d, (0.0, 0.0, 0))
    heat, floor = r.choice([0.3, 1.0, 2.0]), r.choice([0.0, 0.05, 0.2])
    rows = spark.createDataFrame([(d, *map(float, v)) for d, v in known.items()], "domain string, mean double, slope double, count double")

    def check(mixer, signal):
        x = [signal(d) for d in names]
        e = [math.exp((v - max(x)) / heat) for v in x]
        p = [max(v / sum(e), floor) for v in e]
        assert list(props(mixer.mix(rows)).values()) == pytest.approx([v / sum(p) for v in p])

    best, n = max(of(d)[0] for d in names), sum(of(d)[2] for d in names)
    check(mixers.RewardGap(names, heat, floor), lambda d: best - of(d)[0])
    check(mixers.DumpUcb(names, 0.7, temperature=heat, floor=floor), lambda d: of(d)[0] + 0.7 * math.sqrt(2 * math.log(n + 1) / (of(d)[2] + 1)))
    check(mixers.Tscl(names, temperature=heat, floor=floor), lambda d: abs(of(d)[1]))
    check(mixers.Tscl(names, signed=True, temperature=heat, floor=floor), lambda d: max(0.0, of(d)[1]))
    assert props(mixers.Static(names).mix(rows)) == {d: pytest.approx(1 / len(names)) for d in names}
    shares = [r.randint(1, 9) for _ in names]
    assert list(props(mixers.Static(names, shares).mix(rows)).values()) == pytest.approx([v / sum(shares) for v in shares])
    with pytest.raises(ValueError):
        mixers.Static([]).mix(rows)


@pytest.mark.parametrize("window", [1, 2, 7, 500])
def test_windows_against_loops(spark, window):
    r = random.Random(window)
    rows = [(r.randint(0, 30), i, r.choice("xxxxyz"), round(r.uniform(0, 9), 2) if r.random() < 0.9 else None) for i in range(300)]
    rows += [(40, 1000, None, 1.0), (41, 1001, "w", None)]
    want = {}
    for name in "xyzw":
        held = sorted(x for x in rows if x[2] == name)
        for i, x in enumerate(held):
            part = [(j, y[3]) for j, y in enumerate(held) if i - window < j <= i and y[3] is not None]
            n = len(part)
            mx, my = (sum(c) / n for c in zip(*part)) if n else (0, 0.0)
            sxx = sum((a - mx) ** 2 for a, _ in part)
            want[x[1]] = n, my, sum((a - mx) * (b - my) for a, b in part) / sxx if sxx else 0.0
    obs = spark.createDataFrame(rows, "step int, row_id int, domain string, value double").repartition(5)
    got = {x.row_id: (x.n_obs, x["mean"], x.slope) for x in mixers.domain_windows(obs, window=window).collect()}
    assert got.keys() == want.keys() | {1000}
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-7)
    last = {x.domain: x.row_id for x in mixers.latest(mixers.domain_windows(obs, window=window)).collect()}
    assert last["x"] == max((x[:2] for x in rows if x[2] == "x"))[1]
    assert mixers.domain_windows(obs.limit(0)).count() == 0


def test_schedule_weights(spark):
    df, rows = drawn(spark, 5, 90)
    out = Schedule.named("difffilter", adv_estimator="grpo").weights(df)
    rate = {k: sum(total(x, "rm_scores") > 0.5 for x in g) / len(g) for k, g in by(rows, "step", "uid").items()}
    keep = {x["row_id"] for x in rows if 0.2 < rate[x["step"], x["uid"]] < 0.8}
    assert set(kept(out)) == keep and 0 < len(keep) < 90
    for got, x in zip(col(out, "rollout_is_weights"), rows):
        assert got == [m * float(x["row_id"] in keep) for m in x["response_mask"]]
    for m in weight_metrics(out).collect():
        w = [float(x["row_id"] in keep) for x in rows if x["step"] == m.step]
        assert (m.weight_mean, m.kept_frac) == pytest.approx((np.mean(w),) * 2) and m.weight_std == pytest.approx(np.std(w, ddof=1))
    warm = Schedule({"mechanism": "reweight", "scorer": {"name": "advantage_magnitude"}, "actuator": {"name": "softmax"}, "warmup_step": 2}).weights(df)
    for got, x in zip(col(warm, "rollout_is_weights"), rows):
        assert x["step"] == 2 or got == x["response_mask"]
    assert Schedule.named("baseline") is None
    assert set(col(selection_mask(df, df.limit(0), ["row_id"]), "weight")) == {0.0}


def test_mix_replay(spark):
    rows = [(s, i, d, [float(v)], [1]) for s in range(4) for i, (d, v) in enumerate([("a", 1), ("b", 0)])]
    b = spark.createDataFrame(rows, "step int, row_id int, domain string, rm_scores array<double>, response_mask array<int>")
    r = MixReplay({"mechanism": "mix", "scorer": {"name": "reward_difficulty"}, "actuator": {"name": "reward_gap", "params": {"floor": 0.0}}, "warmup_step": 1, "update_step": 2}, ["a", "b"])
    for obs in (r.observations(b), r.observations(b, compat="reward_only")):
        p = {(x.step, x.domain): x.p for x in r.proportions(obs).collect()}
        assert p[0, "a"] == 0.5 and p[1, "a"] == 0.5 and p[2, "b"] > 0.5 and p[3, "b"] == p[2, "b"]


def test_apportionment(spark):
    p = spark.createDataFrame([(0, "a", 0.34), (1, "b", 0.33), (2, "c", 0.33)], "domain_ord int, domain string, p double")
    assert [r.target for r in sampling.quota_targets(p, 10).orderBy("domain_ord").collect()] == [4, 3, 3]


@pytest.mark.parametrize("seed", range(3))
def test_quota_sample_loop(spark, seed):
    r = random.Random(seed)
    pool = [(i, r.choice("abcx"), r.randint(0, 5)) for i in range(r.randint(5, 40))]
    p = [("a", 0.5), ("b", 0.3), ("c", 0.2)]
    size = r.randint(3, 30)
    t = sampling.quota_targets(spark.createDataFrame([(i, d, v) for i, (d, v) in enumerate(p)], "domain_ord int, domain string, p double"), size)
    want = {x.domain: x.target for x in t.collect()}
    assert sum(want.values()) == size
    age = sorted(pool, key=lambda x: (x[2], x[0]))
    chosen = [x for d, _ in p for x in [y for y in age if y[1] == d][: want[d]]]
    for source in ([y for d, _ in p for y in age if y[1] == d], [y for y in age if y[1] == "x"]):
        chosen += [y for y in source if y not in chosen][: max(0, size - len(chosen))]
    got = sampling.quota_sample(spark.createDataFrame(pool, "uid int, domain string, step int"), t, size)
    assert sorted(x.uid for x in got.collect()) == sorted(x[0] for x in chosen)
