"""One query an operator over the driver's tables, each with the same result in plain SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import grading
from ..functions.arrays import array_total
from ..operators import datasets, mixers, reports, reweighters, sampling, scorers, selectors
from ..sources.readers import log_metrics
from . import bindings
from .schedule import MixReplay, Schedule, selection_mask, weight_metrics

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
T = bindings.TIE
ROW = ("step", "uid", "l_linenumber", "l_partkey")

# what the queries' bindings are in SQL
R = """r AS (SELECT l_orderkey % 16 AS step, l_orderkey AS uid, l_returnflag AS domain,
  CAST(CASE WHEN l_discount >= 0.05 THEN 1 ELSE 0 END AS DOUBLE) AS reward, l_quantity AS resp_len,
  l_extendedprice / 1000 - l_quantity AS adv, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax FROM lineitem)"""
E = """e AS (SELECT vec_id, vec_id % 4 AS step, label AS uid, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v,
  list_transform(embedding[1:1 + vec_id % 64], lambda x: CAST(x AS DOUBLE)) AS m FROM embeddings)"""
OBS = """o AS (SELECT date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS step, ts, event_id, event_type AS domain, value FROM events)"""
POOL = """pool AS (SELECT o_orderkey AS uid, o_orderpriority AS domain, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS step,
  CASE o_orderstatus WHEN 'O' THEN 'finished' WHEN 'F' THEN 'failed' ELSE 'running' END AS status FROM orders)"""
RUNS = """runs AS (SELECT o_orderstatus AS scale, o_orderpriority AS method, year(o_orderdate) AS seed, p_brand AS benchmark,
  avg(CASE WHEN l_discount >= 0.05 THEN 1.0 ELSE 0.0 END) AS acc
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""
TIES = ", ".join(T)
ROWS = ", ".join(ROW)


def query(name: str, sql: str | None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def r6(c, name: str):
    return F.round(c, 6).alias(name)


def big(c, name: str):
    return c.cast("long").alias(name)


# ---- scorers

KEPT = "step, count(*) AS n, round(avg(CASE WHEN {} THEN 1.0 ELSE 0.0 END), 6) AS kept_frac"
RATE = "s AS (SELECT *, avg(CASE WHEN reward > 0.5 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY step, uid) AS score FROM r)"


@query("schedule_select_band", f"WITH {R}, {RATE} SELECT {KEPT.format('score > 0.2 AND score < 0.8')} FROM s GROUP BY step")
def _(s, d):
    out = Schedule.named("difffilter", adv_estimator="grpo", runtime={"tie": T}).weights(bindings.rollouts(s, d))
    return out.groupBy("step").agg(F.count("*").alias("n"), r6(F.avg(F.col("kept").cast("double")), "kept_frac"))


def _adv(agg: str, sql: str):
    @query(f"score_adv_{agg}", f"WITH {E} SELECT vec_id, round({sql}, 6) AS score FROM e")
    def _(s, d):
        return scorers.AdvantageMagnitude(agg).score(bindings.tokens(s, d)).select("vec_id", r6(F.col("score"), "score"))


ABS = "list_transform(m, lambda x: abs(x))"
_adv("mean", f"list_sum({ABS}) / greatest(len(m), 1)")
_adv("sum", f"list_sum({ABS})")
_adv("max", f"list_max({ABS})")


@query("score_reward", f"WITH {R} SELECT step, domain, count(*) AS n, round(sum(reward), 6) AS total FROM r GROUP BY ALL")
def _(s, d):
    out = scorers.RewardDifficulty().score(bindings.rollouts(s, d))
    return out.groupBy("step", "domain").agg(F.count("*").alias("n"), r6(F.sum("score"), "total"))


@query("score_solve_rate", f"WITH {R}, {RATE} SELECT step, uid, round(max(score), 6) AS score, count(*) AS n FROM s GROUP BY step, uid")
def _(s, d):
    out = scorers.GroupSolveRate().score(bindings.rollouts(s, d))
    return out.groupBy("step", "uid").agg(r6(F.max("score"), "score"), F.count("*").alias("n"))


@query("score_token_prob", f"WITH {E} SELECT vec_id, round(list_sum(list_transform(v, lambda x: exp(-abs(x)))), 6) AS total, round(list_min(list_transform(v, lambda x: exp(-abs(x)))), 6) AS least FROM e")
def _(s, d):
    out = scorers.TokenProb().score(bindings.tokens(s, d))
    return out.select("vec_id", r6(array_total(F.col("score")), "total"), r6(F.array_min("score"), "least"))


@query("score_distill_gap", f"WITH {E} SELECT vec_id, round(list_sum(list_transform(m, lambda x: -abs(x) - x)) / greatest(len(m), 1), 6) AS score FROM e")
def _(s, d):
    b = bindings.tokens(s, d).withColumn("teacher_log_probs", F.col("advantages"))
    return scorers.DistillGap().score(b).select("vec_id", r6(F.col("score"), "score"))


@query("score_distill_kl", f"WITH {E} SELECT vec_id, round(list_sum(list_transform(v, lambda x: exp(x + abs(x)) - abs(x) - x - 1)), 6) AS total FROM e")
def _(s, d):
    b = bindings.tokens(s, d).withColumn("teacher_log_probs", F.col("advantages"))
    return scorers.DistillKl("k3").score(b).select("vec_id", r6(array_total(F.col("score")), "total"))


# ---- reweighters


def _rw(name: str, make: Callable, sql: str):
    @query(f"rw_{name}", f"WITH {R}, {sql} SELECT {ROWS}, round(w / greatest(avg(w) OVER (PARTITION BY step), 1e-8), 6) AS weight FROM w")
    def _(s, d):
        b = bindings.rollouts(s, d).withColumn("score", F.col("adv"))
        return make().reweight(b).select(*ROW, r6(F.col("weight"), "weight"))


_rw("softmax", lambda: reweighters.Softmax(temperature=10.0), "w AS (SELECT *, exp((adv - max(adv) OVER (PARTITION BY step)) / 10) AS w FROM r)")
_rw("difficulty_band", reweighters.DifficultyBand, "q AS (SELECT step AS st, quantile_cont(adv, 0.25) AS a, quantile_cont(adv, 0.75) AS b FROM r GROUP BY step), w AS (SELECT r.*, CASE WHEN adv BETWEEN a AND b THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM r JOIN q ON step = st)")
_rw("per_advantage", reweighters.PerAdvantage, "w AS (SELECT *, pow(abs(adv) + 1e-8, 0.5) AS w FROM r)")
_rw("reward_power", lambda: reweighters.RewardPower(p=2.0), "w AS (SELECT *, pow(greatest(adv, 0.0), 2) AS w FROM r)")


@query("rw_exp_tilt", f"WITH {R} SELECT {ROWS}, round(least(exp(adv / 5), 20.0), 6) AS weight FROM r")
def _(s, d):
    b = bindings.rollouts(s, d).withColumn("score", F.col("adv"))
    return reweighters.ExpTilt(beta=5.0).reweight(b).select(*ROW, r6(F.col("weight"), "weight"))


@query("rw_logistic_difficulty", f"WITH {R}, {RATE} SELECT {ROWS}, round(0.4 + 1.1 / (1 + exp(10.0 * (score - 0.75))), 6) AS weight FROM s")
def _(s, d):
    return reweighters.LogisticDifficulty().reweight(scorers.GroupSolveRate().score(bindings.rollouts(s, d))).select(*ROW, r6(F.col("weight"), "weight"))


_rw("medium_bump", lambda: reweighters.MediumBump(20.0, 10.0), "w AS (SELECT *, exp(-pow((adv - 20) / 10, 2) / 2) AS w FROM r)")

TOK = f"""WITH {E}, t AS (SELECT vec_id, step, list_transform(v, lambda x: 0.5 * exp(-abs(x)) + 0.5) AS w, 1 + vec_id % 64 AS n FROM e),
  s AS (SELECT step AS st, sum(list_sum(w[1:n])) AS sw, sum(n) AS sn FROM t GROUP BY step)"""


@query("rw_advantage_token", f"{TOK} SELECT vec_id, round(list_sum(w) * greatest(sn, 1) / greatest(sw, 1e-8), 6) AS total FROM t JOIN s ON step = st")
def _(s, d):
    out = reweighters.AdvantageReweight().reweight(scorers.TokenProb().score(bindings.tokens(s, d)))
    return out.select("vec_id", r6(array_total(F.col("weight_tok")), "total"))


@query("rw_truncated_importance", f"WITH {E} SELECT vec_id, round(list_sum(list_transform(v, lambda x: least(exp(x + abs(x)), 1.2))), 6) AS total FROM e")
def _(s, d):
    b = bindings.tokens(s, d).withColumn("log_probs", F.col("advantages"))
    return reweighters.TruncatedImportance(clip=1.2).reweight(b).select("vec_id", r6(array_total(F.col("weight_tok")), "total"))


# ---- selectors


@query("sel_band_dapo", f"WITH {R}, {RATE} SELECT {KEPT.format('score > 0 AND score < 1')} FROM s GROUP BY step")
def _(s, d):
    out = selectors.ThresholdBand().select(scorers.GroupSolveRate().score(bindings.rollouts(s, d)))
    return out.groupBy("step").agg(F.count("*").alias("n"), r6(F.avg(F.col("kept").cast("double")), "kept_frac"))


@query("sel_band_rows", f"WITH {R}, {RATE} SELECT {ROWS}, round(score, 6) AS score FROM s WHERE score > 0.2 AND score < 0.8")
def _(s, d):
    out = selectors.ThresholdBand(0.2, 0.8).select(scorers.GroupSolveRate().score(bindings.rollouts(s, d)))
    return out.where("kept").select(*ROW, r6(F.col("score"), "score"))


def _topk(name: str, largest: bool, fraction: float):
    o = "DESC" if largest else "ASC"

    @query(name, f"WITH {R}, k AS (SELECT *, row_number() OVER (PARTITION BY step ORDER BY adv {o}, {TIES}) AS rk, count(*) OVER (PARTITION BY step) AS g FROM r) SELECT {ROWS}, round(adv, 6) AS score FROM k WHERE rk <= greatest(1, round_even({fraction} * g, 0))")
    def _(s, d):
        b = bindings.rollouts(s, d).withColumn("score", F.col("adv"))
        return selectors.TopkFraction(fraction, largest, tie=T).select(b).where("kept").select(*ROW, r6(F.col("score"), "score"))


_topk("sel_topk_large", True, 0.5)
_topk("sel_topk_small", False, 0.1)


def _gfpo(name: str, metric: str, key: str):
    @query(name, f"WITH {R}, k AS (SELECT *, row_number() OVER (PARTITION BY step, uid ORDER BY {key} DESC, {TIES}) AS rk FROM r) SELECT {ROWS}, resp_len FROM k WHERE rk <= 2")
    def _(s, d):
        b = bindings.rollouts(s, d).withColumn("score", F.col("reward"))
        return selectors.Gfpo(2, metric, tie=T).select(b).where("kept").select(*ROW, "resp_len")


_gfpo("sel_gfpo_short", "short", "-greatest(resp_len, 1)")
_gfpo("sel_gfpo_efficiency", "efficiency", "reward / greatest(resp_len, 1)")

MAXVAR = f"""WITH {R}, k AS (SELECT *, row_number() OVER (PARTITION BY step, uid ORDER BY reward, {TIES}) AS rk, count(*) OVER (PARTITION BY step, uid) AS g FROM r),
 n AS (SELECT *, CAST(greatest(1, round_even(0.5 * g, 0)) AS INT) AS n FROM k),
 c AS (SELECT *, unnest(range(0, n + 1)) AS a FROM n),
 v AS (SELECT step, uid, a, round(sum(reward * reward) / max(n) - pow(sum(reward) / max(n), 2), 9) AS var FROM c WHERE rk <= a OR rk > g - (n - a) GROUP BY step, uid, a),
 b AS (SELECT step, uid, arg_min(a, row(-var, a)) AS a FROM v GROUP BY step, uid)
 SELECT {", ".join("n." + c for c in ROW)}, reward FROM n JOIN b ON n.step = b.step AND n.uid = b.uid WHERE n >= g OR rk <= b.a OR rk > g - (n - b.a)"""


@query("sel_max_variance", MAXVAR)
def _(s, d):
    b = bindings.rollouts(s, d).withColumn("score", F.col("reward"))
    return selectors.MaxVariance(0.5, tie=T).select(b).where("kept").select(*ROW, "reward")


@query("sel_max_min", f"WITH {R}, k AS (SELECT *, row_number() OVER (PARTITION BY step, uid ORDER BY adv DESC, {TIES}) AS a, row_number() OVER (PARTITION BY step, uid ORDER BY adv, {TIES}) AS b FROM r) SELECT {ROWS}, round(adv, 6) AS score FROM k WHERE a = 1 OR b = 1")
def _(s, d):
    b = bindings.rollouts(s, d).withColumn("score", F.col("adv"))
    return selectors.MaxMin(tie=T).select(b).where("kept").select(*ROW, r6(F.col("score"), "score"))


@query("sel_high_entropy_tokens", f"WITH {E}, t AS (SELECT vec_id, v, list_sort(v)[len(v) - CAST(greatest(1, round_even(len(v) * 0.2, 0)) AS INT) + 1] AS cut FROM e) SELECT vec_id, len(list_filter(v, lambda x: x >= cut)) AS n_kept FROM t")
def _(s, d):
    b = bindings.tokens(s, d).withColumn("score", F.col("advantages"))
    return selectors.HighEntropyTokens().select(b).select("vec_id", big(F.size(F.filter("token_kept", lambda x: x)), "n_kept"))


STREAK = f"{R}, v AS (SELECT uid, l_linenumber AS step, var_pop(reward) AS v FROM r GROUP BY ALL), z AS (SELECT *, max(CASE WHEN v > 0 THEN step END) OVER (PARTITION BY uid) AS last FROM v), k AS (SELECT uid, count(*) FILTER (WHERE last IS NULL OR step > last) AS zero_streak FROM z GROUP BY uid)"


@query("sel_history_skip", f"WITH {STREAK} SELECT uid, zero_streak FROM k WHERE zero_streak < 1 OR ((uid * 31 + 7) * 2654435761 % 4294967296) / 4294967296.0 < 0.1")
def _(s, d):
    b = bindings.rollouts(s, d).select("uid", F.col("l_linenumber").alias("step"), F.col("reward").alias("score"))
    z = selectors.zero_variance_streak(b).withColumn("step", F.lit(7))
    return selectors.HistorySkip(0.1).select(z).where("kept").select("uid", "zero_streak")


@query("mask_from_selection", f"WITH {R} SELECT step, uid, CAST(max(CASE WHEN domain = 'R' THEN 1 ELSE 0 END) OVER (PARTITION BY step, uid) AS DOUBLE) AS weight FROM r")
def _(s, d):
    b = bindings.rollouts(s, d)
    return selection_mask(b, b.where("domain = 'R'"), ["step", "uid"]).select("step", "uid", "weight")


@query("metrics_weights", f"WITH {R}, {RATE}, k AS (SELECT step, CASE WHEN score > 0.2 AND score < 0.8 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS w FROM s) SELECT step, round(avg(w), 6) AS weight_mean, round(stddev_samp(w), 6) AS weight_std, round(avg(w), 6) AS kept_frac FROM k GROUP BY step")
def _(s, d):
    m = weight_metrics(Schedule.named("difffilter", runtime={"tie": T}).weights(bindings.rollouts(s, d)))
    return m.select("step", *[r6(F.col(c), c) for c in m.columns[1:]])


@query("metrics_tokens", f"{TOK}, x AS (SELECT step, unnest(w[1:n]) * greatest(sn, 1) / greatest(sw, 1e-8) AS w FROM t JOIN s ON step = st) SELECT step, round(avg(w), 6) AS weight_mean, round(stddev_samp(w), 6) AS weight_std FROM x GROUP BY step")
def _(s, d):
    m = weight_metrics(Schedule.named("ar").weights(bindings.tokens(s, d)))
    return m.select("step", *[r6(F.col(c), c) for c in m.columns[1:]])


@query("weights_to_tokens", f"WITH {R}, k AS (SELECT *, pow(abs(adv) / greatest(resp_len, 1) + 1e-8, 0.5) AS w FROM r) SELECT {ROWS}, round(CASE WHEN step < 3 THEN 1.0 ELSE w / greatest(avg(w) OVER (PARTITION BY step), 1e-8) END * resp_len, 5) AS total FROM k")
def _(s, d):
    cfg = {"mechanism": "reweight", "scorer": {"name": "advantage_magnitude"}, "actuator": {"name": "per_advantage"}, "warmup_step": 3}
    out = Schedule(cfg).weights(bindings.rollouts(s, d))
    return out.select(*ROW, F.round(array_total(F.col("rollout_is_weights")), 5).alias("total"))


# ---- domain statistics and mixers

WIN = "WINDOW w AS (PARTITION BY domain ORDER BY ts, event_id ROWS 49 PRECEDING)"
STAT = f"{OBS}, i AS (SELECT *, CAST(row_number() OVER (PARTITION BY domain ORDER BY ts, event_id) AS DOUBLE) AS i FROM o), w AS (SELECT *, avg(value) OVER w AS mean, CASE WHEN count(*) OVER w < 2 THEN 0 ELSE regr_slope(value, i) OVER w END AS slope, count(*) OVER w AS n FROM i {WIN})"
LAST = "l AS (SELECT domain, arg_max(mean, row(ts, event_id)) AS mean, arg_max(slope, row(ts, event_id)) AS slope FROM w GROUP BY domain)"
DOMAINS = ["click", "error", "purchase", "refund", "signup", "view"]
DOM = "d AS (SELECT unnest(range(6)) AS domain_ord, unnest(['click','error','purchase','refund','signup','view']) AS domain)"


def _stats(s, d):
    return mixers.domain_windows(bindings.observations(s, d))


@query("tracker_mean", f"WITH {STAT} SELECT event_id, domain, round(mean, 9) AS mean, n AS n_obs FROM w")
def _(s, d):
    return _stats(s, d).select("event_id", "domain", F.round("mean", 9).alias("mean"), "n_obs")


@query("tracker_slope", f"WITH {STAT} SELECT event_id, domain, round(slope, 6) AS slope FROM w")
def _(s, d):
    return _stats(s, d).select("event_id", "domain", r6(F.col("slope"), "slope"))


def _mix(name: str, make: Callable, signal: str, extra: str = "", counts: bool = False):
    sql = f"""WITH {STAT}, {LAST}, {DOM}, c AS (SELECT domain, count(*) AS n FROM o GROUP BY domain),
  j AS (SELECT d.*, coalesce(l.mean, 0) AS mean, coalesce(l.slope, 0) AS slope, coalesce(c.n, 0) AS n FROM d LEFT JOIN l USING (domain) LEFT JOIN c USING (domain)),
  x AS (SELECT domain_ord, domain, {signal} AS x FROM j), e AS (SELECT *, exp((x - max(x) OVER ()) / 1.0) AS e FROM x),
  p AS (SELECT *, greatest(e / sum(e) OVER (), 0.05) AS p FROM e) SELECT domain_ord, domain, round(p / sum(p) OVER (), 6) AS p FROM p"""

    @query(name, sql)
    def _(s, d):
        stats = mixers.latest(_stats(s, d))
        if counts:
            n = bindings.observations(s, d).groupBy("domain").agg(F.count("*").alias("count"))
            stats = stats.join(n, "domain")
        return make().mix(stats).select(big(F.col("domain_ord"), "domain_ord"), "domain", r6(F.col("p"), "p"))


_mix("mix_reward_gap", lambda: mixers.RewardGap(DOMAINS), "max(mean) OVER () - mean")
_mix("mix_dump_ucb", lambda: mixers.DumpUcb(DOMAINS), "mean + 1.0 * sqrt(2 * ln(sum(n) OVER () + 1.0) / (n + 1))", counts=True)
_mix("mix_tscl", lambda: mixers.Tscl(DOMAINS), "abs(slope)")
_mix("mix_tscl_signed", lambda: mixers.Tscl(DOMAINS, signed=True), "greatest(slope, 0)")


@query("mix_static", f"WITH {OBS}, {DOM}, s AS (SELECT DISTINCT step FROM o) SELECT CAST(step AS BIGINT) AS step, domain_ord, domain, round(CASE domain_ord WHEN 0 THEN 3 ELSE 1 END / 8.0, 6)::DOUBLE AS p FROM s, d")
def _(s, d):
    m = mixers.Static(DOMAINS, [3, 1, 1, 1, 1, 1], by=("step",)).mix(bindings.observations(s, d))
    return m.select(big(F.col("step"), "step"), big(F.col("domain_ord"), "domain_ord"), "domain", r6(F.col("p"), "p"))


@query("mix_exp3", f"WITH {OBS}, {DOM}, m AS (SELECT domain, avg(value) / 100 AS lw FROM o GROUP BY domain), j AS (SELECT d.*, coalesce(lw, 0) AS lw FROM d LEFT JOIN m USING (domain)), e AS (SELECT *, exp(lw - max(lw) OVER ()) AS e FROM j) SELECT domain_ord, domain, round(0.9 * e / sum(e) OVER () + 0.1 / 6, 6) AS p FROM e")
def _(s, d):
    w = bindings.observations(s, d).groupBy("domain").agg((F.avg("value") / 100).alias("log_weight"))
    return mixers.Exp3(DOMAINS, 0.1).mix(w).select(big(F.col("domain_ord"), "domain_ord"), "domain", r6(F.col("p"), "p"))


@query("mix_replay_priority", f"WITH {OBS}, {DOM}, m AS (SELECT domain, avg(value) AS mean, max(step) - length(domain) AS last_step FROM o GROUP BY domain), j AS (SELECT d.*, coalesce(mean, 0) AS mean, coalesce(last_step, 19000) AS ls FROM d LEFT JOIN m USING (domain)), k AS (SELECT *, 1.0 / row_number() OVER (ORDER BY mean DESC, domain_ord) AS r, max(ls) OVER () - ls AS s FROM j) SELECT domain_ord, domain, round(CAST(0.8 * r / sum(r) OVER () + 0.2 * s / sum(s) OVER () AS DOUBLE), 6) AS p FROM k")
def _(s, d):
    w = bindings.observations(s, d).groupBy("domain").agg(F.avg("value").alias("mean"), (F.max("step") - F.length("domain")).alias("last_step"))
    w = w.union(s.createDataFrame([("refund", 0.0, 19000)], "domain string, mean double, last_step int"))
    return mixers.ReplayPriority(DOMAINS, 0.2).mix(w).select(big(F.col("domain_ord"), "domain_ord"), "domain", r6(F.col("p"), "p"))


REPLAY = f"""WITH {STAT}, {DOM}, a AS (SELECT step, domain, arg_max(mean, row(ts, event_id)) AS mean FROM w GROUP BY step, domain),
  g AS (SELECT s.step, x.domain FROM (SELECT DISTINCT step FROM o) s CROSS JOIN (SELECT DISTINCT domain FROM a) x),
  f AS (SELECT g.step, g.domain, last_value(mean IGNORE NULLS) OVER (PARTITION BY g.domain ORDER BY g.step) AS mean FROM g LEFT JOIN a ON g.step = a.step AND g.domain = a.domain),
  u AS (SELECT DISTINCT step FROM o WHERE step >= 19725 AND step % 3 = 0),
  j AS (SELECT u.step, d.domain_ord, d.domain, coalesce(f.mean, 0) AS mean FROM u CROSS JOIN d LEFT JOIN f ON u.step = f.step AND d.domain = f.domain),
  x AS (SELECT *, max(mean) OVER (PARTITION BY step) - mean AS x FROM j), e AS (SELECT *, exp(x - max(x) OVER (PARTITION BY step)) AS e FROM x),
  p AS (SELECT *, greatest(e / sum(e) OVER (PARTITION BY step), 0.05) AS p FROM e), q AS (SELECT step, domain, p / sum(p) OVER (PARTITION BY step) AS p FROM p),
  h AS (SELECT s.step, d.domain_ord, d.domain FROM (SELECT DISTINCT step FROM o) s CROSS JOIN d)
  SELECT h.step, h.domain_ord, h.domain, round(coalesce(last_value(p IGNORE NULLS) OVER (PARTITION BY h.domain ORDER BY h.step), 1.0 / 6), 6) AS p FROM h LEFT JOIN q ON h.step = q.step AND h.domain = q.domain"""


@query("mix_replay_asof", REPLAY)
def _(s, d):
    cfg = {"mechanism": "mix", "scorer": {"name": "static_meta", "params": {"column": "value"}}, "actuator": {"name": "reward_gap"}, "warmup_step": 19725, "update_step": 3}
    replay = MixReplay(cfg, DOMAINS)
    out = replay.proportions(replay.observations(bindings.observations(s, d)))
    return out.select(big(F.col("step"), "step"), big(F.col("domain_ord"), "domain_ord"), "domain", r6(F.col("p"), "p"))


@query("domain_ewma", f"WITH {OBS}, v AS (SELECT domain, step, avg(value) AS v FROM o GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY step) AS i, count(*) OVER (PARTITION BY domain) AS n FROM v) SELECT domain, round(sum(0.1 * pow(0.9, n - i) * v), 6) AS ewma FROM k GROUP BY domain")
def _(s, d):
    daily = bindings.observations(s, d).groupBy("domain", "step").agg(F.avg("value").alias("value"))
    return mixers.ewma(daily).select("domain", r6(F.col("ewma"), "ewma"))


@query("domain_group_variance", f"WITH {R}, g AS (SELECT domain, uid, var_pop(reward) AS v FROM r GROUP BY ALL) SELECT domain, round(avg(v), 6) AS mean_variance FROM g GROUP BY domain")
def _(s, d):
    out = mixers.group_variance(bindings.rollouts(s, d), score="reward")
    return out.select("domain", r6(F.col("mean_variance"), "mean_variance"))


# ---- quota sampling

PRIO = ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"]
PROP = [0.5, 0.25, 0.125, 0.125]
TARGET = """d AS (SELECT unnest(range(4)) AS domain_ord, unnest(['1-URGENT','2-HIGH','3-MEDIUM','5-LOW']) AS domain, unnest([0.5, 0.25, 0.125, 0.125]) AS p),
  b AS (SELECT *, floor(p * 2003) AS b, round(p * 2003 - floor(p * 2003), 12) AS f FROM d),
  t AS (SELECT domain_ord, domain, CAST(b + CASE WHEN row_number() OVER (ORDER BY f DESC, domain_ord) <= 2003 - sum(b) OVER () THEN 1 ELSE 0 END AS BIGINT) AS target FROM b)"""
READY = "ready AS (SELECT * FROM pool WHERE status <> 'running')"
QUOTA = f"""{POOL}, {READY}, {TARGET}, k AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY step, uid) AS rn FROM ready),
  j AS (SELECT k.*, t.domain_ord, CASE WHEN target IS NULL THEN 2 WHEN rn <= target THEN 0 ELSE 1 END AS phase FROM k LEFT JOIN t USING (domain)),
  q AS (SELECT * FROM j ORDER BY phase, CASE WHEN phase < 2 THEN domain_ord ELSE 0 END, step, uid LIMIT 2003)"""


def _targets(s):
    rows = s.createDataFrame([(i, n, p) for i, (n, p) in enumerate(zip(PRIO, PROP))], "domain_ord int, domain string, p double")
    return sampling.quota_targets(rows, 2003)


def _quota(s, d):
    return sampling.quota_sample(sampling.sampleable(bindings.prompt_pool(s, d)), _targets(s), 2003)


@query(
    "quota_targets",
    """WITH c AS (SELECT o_orderpriority AS domain, count(*) AS n FROM orders GROUP BY 1),
  p AS (SELECT row_number() OVER (ORDER BY domain) - 1 AS domain_ord, domain, n / sum(n) OVER () AS p FROM c),
  b AS (SELECT *, CAST(floor(p * 1001) AS BIGINT) AS base, round(p * 1001 - floor(p * 1001), 12) AS frac FROM p),
  k AS (SELECT *, row_number() OVER (ORDER BY frac DESC, domain_ord) AS rk, 1001 - sum(base) OVER () AS rest FROM b)
  SELECT domain_ord, domain, CAST(base + CASE WHEN rk <= rest THEN 1 ELSE 0 END AS BIGINT) AS target FROM k""",
)
def _(s, d):
    """Quotas in proportion to how many prompts each domain has."""
    n = bindings.prompt_pool(s, d).groupBy("domain").agg(F.count("*").alias("n"))
    every = Window.partitionBy(F.lit(0))  # a row a domain
    p = n.select((F.row_number().over(every.orderBy("domain")) - 1).alias("domain_ord"), "domain", (F.col("n") / F.sum("n").over(every)).alias("p"))
    return sampling.quota_targets(p, 1001).select(big(F.col("domain_ord"), "domain_ord"), "domain", "target")


@query("quota_sample", f"WITH {QUOTA} SELECT uid, domain, step, CAST(phase AS BIGINT) AS phase FROM q")
def _(s, d):
    return _quota(s, d).select("uid", "domain", big(F.col("step"), "step"), big(F.col("phase"), "phase"))


@query("sample_oldest", f"WITH {POOL}, {READY} SELECT uid, step FROM ready ORDER BY step, uid LIMIT 500")
def _(s, d):
    return sampling.oldest(sampling.sampleable(bindings.prompt_pool(s, d)), 500).select("uid", big(F.col("step"), "step"))


@query("selected_semi", f"WITH {QUOTA} SELECT l_orderkey || '_' || l_linenumber AS key, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT uid FROM q)")
def _(s, d):
    li = bindings.table(s, d, "lineitem").select(F.concat_ws("_", "l_orderkey", "l_linenumber").alias("key"), "l_quantity")
    return sampling.rows_of(li, _quota(s, d))


@query("consume_anti", f"WITH {QUOTA} SELECT uid, domain FROM pool WHERE uid NOT IN (SELECT uid FROM q)")
def _(s, d):
    return sampling.consume(bindings.prompt_pool(s, d), _quota(s, d)).select("uid", "domain")


@query("drop_stale", f"WITH {POOL} SELECT uid, step FROM pool WHERE 11000 - step <= 1000")
def _(s, d):
    return sampling.drop_stale(bindings.prompt_pool(s, d), 11000, 1000).select("uid", big(F.col("step"), "step"))


H = "((({}) * 2654435761) % 4294967296)"


@query("ds_shuffle_sample", f"SELECT p_partkey, p_name FROM part ORDER BY {H.format('p_partkey + 7')}, p_partkey LIMIT 300")
def _(s, d):
    return sampling.sample_k(bindings.table(s, d, "part").select("p_partkey", "p_name"), 300, "p_partkey", seed=7, keep_order=True)


@query("ds_split_holdout", f"WITH k AS (SELECT o_orderkey, row_number() OVER (ORDER BY {H.format('o_orderkey + 3')}, o_orderkey) AS rn, count(*) OVER () AS n FROM orders) SELECT o_orderkey, CASE WHEN rn <= least(500, n // 10) THEN 'test' ELSE 'train' END AS split FROM k")
def _(s, d):
    return sampling.holdout_split(bindings.table(s, d, "orders").select("o_orderkey"), 500, "o_orderkey", seed=3)


# ---- graders

KIND = "CASE WHEN {} THEN 'knight' ELSE 'knave' END"
RESP = f"""p AS (SELECT p_partkey, p_size, CAST(floor(p_retailprice) AS BIGINT) AS price, {KIND.format('p_partkey % 2 = 0')} AS al, {KIND.format('p_partkey % 3 = 0')} AS bo,
   'Al is a ' || {KIND.format('p_partkey % 2 = 0')} || ', BO is a ' || {KIND.format('p_size % 3 = 0')} AS said FROM part),
 k AS (SELECT *, CASE p_size % 5 WHEN 0 THEN 'Al is a knave. Final answer: ' || said WHEN 1 THEN 'Bo is a knight, Therefore ' || said
   WHEN 2 THEN said || ' so the answer: none' WHEN 3 THEN 'no idea' ELSE said || '. al is a KNIGHT' END AS kk FROM p)"""
KK = f"""{RESP}, t AS (SELECT *, lower(CASE WHEN contains(lower(kk), 'final answer') THEN string_split(lower(kk), 'final answer')[-1]
   WHEN contains(lower(kk), 'answer:') THEN string_split(lower(kk), 'answer:')[-1] WHEN contains(lower(kk), 'therefore') THEN string_split(lower(kk), 'therefore')[-1] ELSE kk END) AS tail FROM k),
 u AS (SELECT *, CASE WHEN regexp_matches(tail, '[a-z]+ is a kn(ight|ave)') THEN tail ELSE lower(kk) END AS x FROM t),
 g AS (SELECT p_partkey, CASE WHEN regexp_extract_all(x, '\\bal is a (knight|knave)', 1)[-1] = al AND regexp_extract_all(x, '\\bbo is a (knight|knave)', 1)[-1] = bo THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM u)"""


@query("grade_kk", f"WITH {KK} SELECT * FROM g")
def _(s, d):
    return bindings.responses(s, d).select("p_partkey", grading.grade_kk(F.col("kk"), F.col("kk_truth")).alias("score"))


def _mcq(n: int) -> str:
    s = "ABCDEFGHIJ"[:n]
    a, t = f"substr('{s}', CAST(price % {n} + 1 AS INT), 1)", f"substr('{s}', CAST(p_partkey % {n} + 1 AS INT), 1)"
    said = f"CASE p_size % 5 WHEN 0 THEN {a} WHEN 1 THEN {a} WHEN 2 THEN '' WHEN 3 THEN '' ELSE {t} END"
    # form 2 has its marker after the letter: the tail has none, so the whole text is read
    return f"CASE WHEN (CASE WHEN p_size % 5 = 2 THEN {a} ELSE {said} END) = {t} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"


for _n in (4, 10):

    def _f(s, d, n=_n):
        return bindings.responses(s, d).select("p_partkey", grading.grade_mcq(F.col(f"s{n}"), F.col(f"t{n}"), "ABCDEFGHIJ"[:n]).alias("score"))

    query(f"grade_mcq{_n}", f"WITH {RESP} SELECT p_partkey, {_mcq(_n)} AS score FROM k")(_f)

MATH = "CASE WHEN p_size % 3 <> 2 AND p_partkey % 4 <> 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"


@query("grade_math", f"WITH {RESP} SELECT p_partkey, {MATH} AS score FROM k")
def _(s, d):
    return bindings.responses(s, d).select("p_partkey", grading.grade_math(F.col("math"), F.col("m_truth")).alias("score"))


@query("grade_dispatch", f"WITH {KK} SELECT CAST(p_partkey % 4 AS BIGINT) AS kind, round(avg(CASE p_partkey % 4 WHEN 0 THEN g.score WHEN 1 THEN {_mcq(4)} WHEN 2 THEN {_mcq(10)} ELSE {MATH} END), 6) AS score, count(*) AS n FROM k JOIN g USING (p_partkey) GROUP BY 1")
def _(s, d):
    r = bindings.responses(s, d).withColumn("kind", F.col("p_partkey") % 4)
    pick = lambda a, b, c, e: F.when(F.col("kind") == 0, a).when(F.col("kind") == 1, b).when(F.col("kind") == 2, c).otherwise(e)
    row = grading.safe_row(pick(F.lit("kk_logic"), F.lit("gpqa"), F.lit("mmlu_pro_physics"), F.lit("other")), pick(*map(F.col, ("kk", "s4", "s10", "math"))), pick(*map(F.col, ("kk_truth", "t4", "t10", "m_truth"))))
    return r.select("kind", row["score"].alias("s")).groupBy("kind").agg(r6(F.avg("s"), "score"), F.count("*").alias("n"))


# ---- data sets


@query("ds_median_split", "WITH m AS (SELECT median(length(text)) AS m FROM documents) SELECT CASE WHEN length(text) <= m THEN 'short' ELSE 'long' END AS domain, lang, count(*) AS n FROM documents, m GROUP BY ALL")
def _(s, d):
    return datasets.length_label(bindings.table(s, d, "documents").select("lang", "text"), "text").groupBy("domain", "lang").agg(F.count("*").alias("n"))


@query("ds_anti_benchmark", "SELECT doc_id, lang FROM documents WHERE text NOT IN (SELECT text FROM benchmark WHERE text IS NOT NULL)")
def _(s, d):
    return datasets.without(bindings.table(s, d, "documents"), bindings.table(s, d, "benchmark"), "text").select("doc_id", "lang")


@query("ds_union_domains", "SELECT 'docs' AS part, count(*) AS n, count(lang) AS n_lang, count(url) AS n_url FROM (SELECT text, lang, NULL AS url FROM documents) UNION ALL SELECT 'pages', count(*), 0, count(url) FROM pages")
def _(s, d):
    a = bindings.table(s, d, "documents").select(F.lit("docs").alias("part"), "text", "lang")
    b = bindings.table(s, d, "pages").select(F.lit("pages").alias("part"), "url")
    return datasets.union_domains(a, b).groupBy("part").agg(F.count("*").alias("n"), F.count("lang").alias("n_lang"), F.count("url").alias("n_url"))


@query("ds_prompt_nest", "SELECT conv_id, count(*) AS n, string_agg(role || ':' || length(text), ',' ORDER BY turn, role, text) AS shape, arg_min(text, turn) AS first FROM conversations GROUP BY conv_id")
def _(s, d):
    p = datasets.nested_prompts(bindings.table(s, d, "conversations"))
    shape = F.concat_ws(",", F.transform("prompt", lambda m: F.concat_ws(":", m["role"], F.length(m["content"]).cast("string"))))
    return p.select("conv_id", big(F.size("prompt"), "n"), shape.alias("shape"), datasets.first_content().alias("first"))


@query("ds_records", "SELECT lang AS domain, source AS data_source, count(*) AS n, CAST(sum(length(text) + 2 + 14) AS BIGINT) AS chars FROM documents GROUP BY ALL")
def _(s, d):
    q = datasets.strip_tail(F.col("text"), "Let's think step by step", "Answer briefly")
    x = bindings.table(s, d, "documents").select(*datasets.record(F.col("source"), q, F.lit("?"), F.lit("text"), F.col("lang"), F.create_map(F.lit("n"), F.col("n_chars").cast("string"))))
    return x.groupBy("domain", "data_source").agg(F.count("*").alias("n"), F.sum(F.length(datasets.first_content())).alias("chars"))


OPT = "SELECT p_partkey, [p_name, p_brand, CASE WHEN p_size % 3 = 0 THEN 'N/A' ELSE p_type END, 'size ' || p_size] AS o FROM part"


def _options(s, d):
    third = F.when(F.col("p_size") % 3 == 0, "N/A").otherwise(F.col("p_type"))
    return bindings.table(s, d, "part").select("p_partkey", F.array("p_name", "p_brand", third, F.concat(F.lit("size "), F.col("p_size").cast("string"))).alias("o"))


@query("ds_option_lines", f"WITH o AS ({OPT}) SELECT p_partkey, 'A. ' || o[1] || chr(10) || 'B. ' || o[2] || CASE WHEN o[3] = 'N/A' THEN '' ELSE chr(10) || 'C. ' || o[3] END || chr(10) || 'D. ' || o[4] AS lines FROM o")
def _(s, d):
    return _options(s, d).select("p_partkey", datasets.option_lines(F.col("o")).alias("lines"))


@query("ds_mcq_letter", f"WITH o AS ({OPT}), x AS (SELECT p_partkey, o, unnest(range(4)) AS i FROM o), h AS (SELECT *, ((p_partkey * 31 + i * 17) * 2654435761) % 4294967296 AS h FROM x), k AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY h, i) AS rk FROM h) SELECT p_partkey, substr('ABCD', CAST(max(CASE WHEN i = 0 THEN rk END) AS INT), 1) AS letter, string_agg(o[i + 1], '|' ORDER BY rk) AS options FROM k GROUP BY p_partkey")
def _(s, d):
    x = datasets.shuffled_options(F.col("o"), F.col("p_partkey"))
    return _options(s, d).select("p_partkey", x["letter"].alias("letter"), F.array_join(x["options"], "|").alias("options"))


@query("ds_choice_letter", f"WITH o AS ({OPT}) SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'B' WHEN p_partkey % 3 = 1 THEN 'D' ELSE '?' END AS letter, CASE WHEN p_partkey % 2 = 0 THEN 'C' ELSE 'raw' END AS bracket FROM o")
def _(s, d):
    k = F.col("p_partkey") % 3
    answer = F.when(k == 0, F.get("o", F.lit(1))).when(k == 1, F.lit("D")).otherwise(F.lit("none of them"))
    target = F.when(F.col("p_partkey") % 2 == 0, " (C) ").otherwise("raw")
    return _options(s, d).select("p_partkey", datasets.choice_letter(F.col("o"), answer).alias("letter"), datasets.bracket_letter(target).alias("bracket"))


@query("ds_run_names", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS method, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey END AS seed, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'done' END AS label FROM orders")
def _(s, d):
    o = bindings.table(s, d, "orders")
    name = F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderpriority")).otherwise(F.concat_ws("_s", "o_orderpriority", F.col("o_custkey").cast("string")))
    p = datasets.parse_run(name)
    return o.select("o_orderkey", p["method"].alias("method"), big(p["seed"], "seed"), datasets.lookup(F.col("o_orderstatus"), {"O": "open", "F": "done"}).alias("label"))


@query("job_grid", "SELECT scale, method, seed, scale || '|' || method || '_s' || seed || '|' || seed AS job FROM (SELECT DISTINCT o_orderstatus AS scale FROM orders) a, (SELECT DISTINCT o_orderpriority AS method FROM orders) b, (SELECT unnest([1, 2, 3])::BIGINT AS seed) c")
def _(s, d):
    o = bindings.table(s, d, "orders")
    return datasets.job_grid(o.select(F.col("o_orderstatus").alias("scale")).distinct(), o.select(F.col("o_orderpriority").alias("method")).distinct(), s.range(1, 4).toDF("seed"))


@query("log_metric_extract", "SELECT event_id, 'm_' || event_type AS metric, round(value, 2) AS number FROM events")
def _(s, d):
    e = bindings.table(s, d, "events")
    line = F.concat(F.lit("step 1 m_"), "event_type", F.lit(":"), F.col("value").cast("string"), F.lit(" other:1"))
    out = log_metrics(e.select("event_id", line.alias("value")), "m_", keep=("event_id",))
    return out.withColumn("number", F.round("number", 2))


# ---- evaluation reports

BRANDS = [f"Brand#{i}" for i in (1, 2, 3, 4, 5, 6)]
COLS = [f"b{i}" for i in (1, 2, 3, 4, 5, 6)]
WIDE = f"{RUNS}, x AS (SELECT scale, method, seed, " + ", ".join(f"avg(CASE WHEN benchmark = '{b}' THEN acc END) AS {c}" for b, c in zip(BRANDS, COLS)) + " FROM runs GROUP BY scale, method, seed)"


def _wide(s, d):
    w = reports.wide(bindings.runs(s, d), ["scale", "method", "seed"], "benchmark", "acc", BRANDS)
    return w.select("scale", "method", "seed", *[F.col(f"`{b}`").alias(c) for b, c in zip(BRANDS, COLS)])


def _rounded(df, by):
    return df.select(*by, *[r6(F.col(c), c) if t == "double" else F.col(c) for c, t in df.dtypes if c not in by])


NNM = "(" + " + ".join(f"coalesce({c}, 0)" for c in COLS) + ") / nullif(" + " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE 1 END" for c in COLS) + ", 0)"


@query("eval_wide", f"WITH {WIDE} SELECT scale, method, CAST(seed AS BIGINT) AS seed, " + ", ".join(f"round({c}, 6) AS {c}" for c in COLS) + " FROM x")
def _(s, d):
    return _wide(s, d).select("scale", "method", big(F.col("seed"), "seed"), *[r6(F.col(c), c) for c in COLS])


def _std(name: str, fn: str, ddof: int):
    @query(name, f"WITH {WIDE} SELECT scale, method, " + ", ".join(f"count({c}) AS n_{c}, round(avg({c}), 6) AS mean_{c}, CASE WHEN count({c}) > 0 THEN round(coalesce({fn}({c}), 0), 6) END AS std_{c}" for c in COLS[:2]) + " FROM x GROUP BY scale, method")
    def _(s, d):
        return _rounded(reports.mean_std(_wide(s, d), ["scale", "method"], COLS[:2], ddof), ["scale", "method"])


_std("eval_mean_std", "stddev_samp", 1)
_std("eval_popstd", "stddev_pop", 0)


@query("eval_macro_available", f"WITH {WIDE}, m AS (SELECT scale, method, {NNM} AS m FROM x) SELECT scale, method, count(m) AS n_runs, round(avg(m), 6) AS macro, round(coalesce(stddev_samp(m), 0), 6) AS macro_std FROM m WHERE m IS NOT NULL GROUP BY scale, method")
def _(s, d):
    return _rounded(reports.macro_over_runs(_wide(s, d), ["scale", "method"], COLS), ["scale", "method"])


MEANS = f"{WIDE}, x2 AS (SELECT scale, method, " + ", ".join(f"avg({c}) AS {c}" for c in COLS) + " FROM x GROUP BY scale, method)"


@query("eval_macro_of_means", f"WITH {MEANS} SELECT scale, method, " + ", ".join(f"round({c}, 6) AS {c}" for c in COLS) + f", round({NNM}, 6) AS macro FROM x2")
def _(s, d):
    return _rounded(reports.macro_of_means(_wide(s, d), ["scale", "method"], COLS), ["scale", "method"])


@query("eval_domain_complete", f"WITH {WIDE} SELECT scale, method, CAST(seed AS BIGINT) AS seed, round((b1 + b2 + b3) / 3, 6) AS low, round((b4 + b5 + b6) / 3, 6) AS high FROM x")
def _(s, d):
    return _wide(s, d).select("scale", "method", big(F.col("seed"), "seed"), r6(reports.complete_mean(COLS[:3]), "low"), r6(reports.complete_mean(COLS[3:]), "high"))


@query("eval_domain_macro", f"WITH {RUNS}, a AS (SELECT scale, method, benchmark, count(*) AS n, avg(acc) AS a FROM runs GROUP BY ALL) SELECT scale, method, CAST(sum(n) AS BIGINT) AS n_total, count(*) AS n_domains, round(avg(a), 6) AS macro_avg FROM a GROUP BY scale, method")
def _(s, d):
    return _rounded(reports.domain_accuracy(bindings.runs(s, d), ["scale", "method"], "benchmark"), ["scale", "method"])


@query("eval_delta_baseline", f"WITH {MEANS}, m AS (SELECT scale, method, {NNM} AS macro FROM x2), b AS (SELECT scale, coalesce(max(CASE WHEN method = 'baseline' THEN macro END), max(CASE WHEN method = '5-LOW' THEN macro END)) AS base FROM m GROUP BY scale) SELECT m.scale, m.method, round(macro, 6) AS macro, round(base, 6) AS base, round(macro - base, 6) AS delta FROM m LEFT JOIN b USING (scale)")
def _(s, d):
    m = reports.macro_of_means(_wide(s, d), ["scale", "method"], COLS).select("scale", "method", "macro")
    return _rounded(reports.against_baseline(m, ["scale"], "macro", baselines=("baseline", "5-LOW")), ["scale", "method"])


@query("eval_minmax", f"WITH {MEANS}, m AS (SELECT scale, method, {NNM} AS macro FROM x2) SELECT scale, round(min(macro), 6) AS lowest, round(max(macro), 6) AS highest, round(max(CASE WHEN method = '5-LOW' THEN macro END), 6) AS baseline FROM m GROUP BY scale")
def _(s, d):
    m = reports.macro_of_means(_wide(s, d), ["scale", "method"], COLS)
    return _rounded(reports.method_range(m, ["scale"], "macro", baseline="5-LOW"), ["scale"])


@query("eval_completeness", f"WITH {WIDE} SELECT count(*) FILTER (WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in COLS) + ") AS n_full, count(*) FILTER (WHERE " + " OR ".join(f"{c} IS NOT NULL" for c in COLS) + ") AS n_any, count(*) AS n_rows FROM x")
def _(s, d):
    return reports.completeness(_wide(s, d), COLS)


@query("eval_merge", f"WITH {WIDE} SELECT a.scale, a.method, CAST(a.seed AS BIGINT) AS seed, round(a.b1, 6) AS b1, round(b.b2, 6) AS b2 FROM x a LEFT JOIN (SELECT * FROM x WHERE seed % 2 = 0) b ON a.scale = b.scale AND a.method = b.method AND a.seed = b.seed")
def _(s, d):
    w, on = _wide(s, d), ["scale", "method", "seed"]
    m = reports.merge_metrics(w.select(*on, "b1"), w.where("seed % 2 = 0").select(*on, "b2"), on)
    return m.select("scale", "method", big(F.col("seed"), "seed"), r6(F.col("b1"), "b1"), r6(F.col("b2"), "b2"))


@query("eval_distinct_runs", f"WITH {RUNS} SELECT scale, count(DISTINCT method || '_s' || seed) AS n FROM runs GROUP BY scale")
def _(s, d):
    return bindings.runs(s, d).groupBy("scale").agg(F.countDistinct(F.concat_ws("_s", "method", F.col("seed").cast("string"))).alias("n"))


@query("event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _(s, d):
    e = bindings.table(s, d, "events")
    g = e.groupBy(F.window(F.col("ts"), "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


from . import io_queries, online_queries, source_queries, state_queries  # noqa: E402, F401  (they add their queries to the catalogue)
