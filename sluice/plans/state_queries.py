"""Queries of answers as formulas, of values carried along steps and time, and of streams that wait, with their SQL."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import symbolic
from ..operators import mixers, reports
from ..scratch import hadoop_path, names_in
from ..streaming import arrivals, mix_loop, replay
from . import bindings
from .io_queries import _arriving, _observed, _stream, scratched
from .queries import DOM, DOMAINS, OBS, POOL, PRIO, PROP, R, RATE, READY, REPLAY, RUNS, T, big, query, r6
from .schedule import METRICS, Schedule

_t = bindings.table

# ---- answers as formulas: eight forms of the same value, every third one changed


def _formulas(s, d) -> DataFrame:
    p = _t(s, d, "part").select("p_partkey", F.col("p_size").cast("long").alias("n"), (F.col("p_partkey") % 9 + 2).cast("long").alias("m"))
    text = lambda form, *cols: F.format_string(form, *[c.cast("long") for c in cols])
    n, m, off = F.col("n"), F.col("m"), (F.col("p_partkey") % 3 == 0).cast("long")
    pairs = [
        (text(r"\frac{%d}{%d}", n, m), text(r"\dfrac{%d}{%d}", 2 * n + off, 2 * m)),
        (text(r"\sqrt{%d}", n * m * m), text(r"%d\sqrt{%d}", m + off, n)),
        (text(r"(x+%d)^2", n), text(r"x^2+%dx+%d", 2 * n, n * n + off)),
        (text(r"(%d, %d]", n, n + m), text(r"\left( %d ,\frac{%d}{2} \right]", n + off, 2 * (n + m))),
        (text(r"\{%d,%d,%d\}", n, n + 1, n + 2), text(r"\{%d, %d,%d\}", n + 2, n + off, n + 1)),
        (text(r"%d\text{ cm}", n), text(r"%d.0 \text{ cm}", n + off)),
        (text(r"x^{%d}", n + m), text(r"x^{%d} \cdot x^{%d}", n, m + off)),
        (text(r"2^{%d}", n), text(r"\frac{4^{%d}}{2^{%d}}", n, n + off)),
    ]
    form = F.col("p_partkey") % len(pairs)
    pick = lambda k: F.coalesce(*[F.when(form == i, x[k]) for i, x in enumerate(pairs)])
    said = F.when(n % 7 == 6, F.lit("unclear")).otherwise(F.concat(F.lit(r"Hence \boxed{"), pick(1), F.lit("}.")))
    return p.select("p_partkey", said.alias("said"), pick(0).alias("truth"))


@query("grade_symbolic", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 OR p_size % 7 = 6 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS score FROM part")
def _(s, d):
    answers = _formulas(s, d).repartition(int(s.conf.get("spark.sql.shuffle.partitions")))  # small rows with much work: a file of them is many tasks
    return answers.select("p_partkey", symbolic.grade_symbolic(F.col("said"), F.col("truth")).alias("score"))


# ---- values carried along steps and time


@query(
    "domain_ewma_path",
    f"""WITH {OBS}, v AS (SELECT domain, step, avg(value) AS v FROM o GROUP BY ALL),
  k AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY step) AS i FROM v)
  SELECT a.domain, CAST(a.step AS BIGINT) AS step, round(sum(0.1 * pow(0.9, a.i - b.i) * b.v), 6) AS ewma
  FROM k a JOIN k b ON a.domain = b.domain AND b.i <= a.i GROUP BY ALL""",
)
def _(s, d):
    daily = bindings.observations(s, d).groupBy("domain", "step").agg(F.avg("value").alias("value"))
    return mixers.ewma_path(daily).select("domain", big(F.col("step"), "step"), r6(F.col("ewma"), "ewma"))


EXP3 = "exp(l - list_max(lw))"
SUM = f"list_sum(list_transform(lw, lambda l: {EXP3}))"


@query(
    "mix_exp3_steps",
    f"""WITH RECURSIVE {OBS}, v AS (SELECT step, domain, avg(value) / 100 AS x FROM o GROUP BY ALL),
  d AS (SELECT unnest(range(6)) AS domain_ord, unnest(['click','error','purchase','refund','signup','view']) AS domain),
  s AS (SELECT step, row_number() OVER (ORDER BY step) AS i FROM (SELECT DISTINCT step FROM v)),
  r AS (SELECT s.i, s.step, list(coalesce(x, 0.0) ORDER BY domain_ord) AS x FROM s CROSS JOIN d LEFT JOIN v ON v.step = s.step AND v.domain = d.domain GROUP BY ALL),
  w(i, lw) AS (SELECT CAST(1 AS BIGINT), [0.0::DOUBLE, 0, 0, 0, 0, 0] UNION ALL
    SELECT w.i + 1, list_transform(range(1, 7), lambda j: lw[j] + 0.2 * x[j] / (6 * (0.8 * exp(lw[j] - list_max(lw)) / {SUM} + 0.2 / 6))) FROM w JOIN r ON r.i = w.i)
  SELECT CAST(r.step AS BIGINT) AS step, CAST(d.domain_ord AS BIGINT) AS domain_ord, d.domain,
    round(0.8 * exp(lw[d.domain_ord + 1] - list_max(lw)) / {SUM} + 0.2 / 6, 6) AS p FROM w JOIN r ON r.i = w.i CROSS JOIN d""",
)
def _(s, d):
    rewards = bindings.observations(s, d).select("step", "domain", (F.col("value") / 100).alias("reward"))
    out = mixers.Exp3(DOMAINS, 0.2).over_steps(rewards)
    return out.select(big(F.col("step"), "step"), big(F.col("domain_ord"), "domain_ord"), "domain", r6(F.col("p"), "p"))


@query(
    "asof_proportions",
    """WITH u AS (SELECT event_type, ts, max(value) AS p FROM events WHERE event_id % 97 = 0 GROUP BY ALL)
  SELECT e.event_id, round(u.p, 6) AS p FROM events e ASOF LEFT JOIN u ON e.event_type = u.event_type AND e.ts >= u.ts""",
)
def _(s, d):
    """Each event with the last value that its type published."""
    e = _t(s, d, "events").select("event_id", "event_type", "ts", "value")
    updates = e.where("event_id % 97 = 0").select("event_type", "ts", F.col("value").alias("p"))
    return mixers.asof_join(e.drop("value"), updates, ["event_type"], ["p"]).select("event_id", r6(F.col("p"), "p"))


@query(
    "metrics_refresh",
    f"""WITH {OBS}, a AS (SELECT step, domain, avg(value) AS mean FROM o GROUP BY ALL), {DOM}, j AS (SELECT t.step, d.*, coalesce(mean, 0) AS mean FROM (SELECT DISTINCT step FROM a) t CROSS JOIN d LEFT JOIN a ON a.step = t.step AND a.domain = d.domain),
  x AS (SELECT *, max(mean) OVER (PARTITION BY step) - mean AS x FROM j), e AS (SELECT *, exp(x - max(x) OVER (PARTITION BY step)) AS e FROM x),
  p AS (SELECT *, greatest(e / sum(e) OVER (PARTITION BY step), 0.05) AS p FROM e)
  SELECT CAST(step AS BIGINT) AS step, 'prop_' || domain AS metric, round(p / sum(p) OVER (PARTITION BY step), 6) AS value FROM p
  UNION ALL SELECT CAST(step AS BIGINT), 'reward_' || domain, round(mean, 6) FROM a""",
)
def _(s, d):
    stats = bindings.observations(s, d).groupBy("step", "domain").agg(F.avg("value").alias("mean"))
    out = mixers.refresh_metrics(mixers.RewardGap(DOMAINS, by=("step",)).mix(stats), stats, ("step",))
    return out.select(big(F.col("step"), "step"), "metric", r6(F.col("value"), "value"))


@query(
    "eval_levels",
    f"""WITH {RUNS} SELECT scale, method, CAST(seed AS BIGINT) AS seed, CAST(grouping(scale) + grouping(method) + grouping(seed) AS BIGINT) AS level, count(acc) AS n, round(avg(acc), 6) AS mean, round(min(acc), 6) AS low, round(max(acc), 6) AS high
  FROM runs GROUP BY ROLLUP (scale, method, seed)""",
)
def _(s, d):
    out = reports.levels(bindings.runs(s, d), ["scale", "method", "seed"], "acc")
    return out.select("scale", "method", big(F.col("seed"), "seed"), big(F.col("level"), "level"), "n", *[r6(F.col(c), c) for c in ("mean", "low", "high")])


# ---- streams that wait


@scratched("metrics_observed", f"WITH {R}, {RATE}, k AS (SELECT *, CASE WHEN score > 0.2 AND score < 0.8 THEN 1.0 ELSE 0.0 END AS w FROM s) SELECT step, count(*) AS n, round(avg(w), 6) AS weight_mean, round(stddev_samp(w), 6) AS weight_std, round(avg(w), 6) AS kept_frac FROM k GROUP BY step")
def _(s, d, at):
    """A step a micro-batch; its metrics are gathered while its weights are written."""
    b = bindings.rollouts(s, d)
    b.withColumn("part", F.col("step")).write.partitionBy("part").parquet(f"{at}/all")
    fs, to = hadoop_path(s, f"{at}/in")
    fs.mkdirs(to)
    for part in names_in(s, f"{at}/all"):  # a step is as many files as tasks held rows of it, and arrives as a folder
        if part.startswith("part="):
            fs.rename(hadoop_path(s, f"{at}/all/{part}")[1], hadoop_path(s, f"{at}/in/{part}")[1])
            Schedule.named("difffilter", runtime={"tie": T}).write_stream(_stream(s, f"{at}/in", b.schema), f"{at}/out", f"{at}/check", metrics=f"{at}/metrics", availableNow=True).awaitTermination()
    got = s.read.schema(", ".join(f"{c} {k}" for c, k in METRICS.items())).json(f"{at}/metrics")
    return got.select(F.col("last_step").alias("step"), "n", *[r6(F.col(c), c) for c in ("weight_mean", "weight_std", "kept_frac")])

TARGETS = dict(zip(PRIO, (int(200 * p) for p in PROP)))


@scratched(
    "stream_replay_quota",
    f"""WITH {POOL}, {READY}, t AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {v})" for k, v in TARGETS.items())}) v(domain, target)),
  k AS (SELECT r.*, target, row_number() OVER (PARTITION BY domain ORDER BY step, uid) - 1 AS rn, count(*) OVER (PARTITION BY domain) AS n FROM ready r JOIN t USING (domain))
  SELECT uid, domain, CAST(rn // target AS BIGINT) AS batch FROM k WHERE rn // target < n // target""",
)
def _(s, d, at):
    """The buffer gets the prompts in three parts of rising steps, stops after each, and goes on from its checkpoint."""
    pool = bindings.prompt_pool(s, d)
    cut = pool.agg(F.percentile_approx("step", 0.7)).first()[0]
    for part, files in ((pool.where(F.col("step") <= cut), 2), (pool.where(F.col("step") > cut), 1)):
        for _ in _arriving(part, f"{at}/in", files):
            out = replay.replay_batches(_stream(s, f"{at}/in", pool.schema), TARGETS)
            out.writeStream.outputMode("append").option("path", f"{at}/out").option("checkpointLocation", f"{at}/check").trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(f"{at}/out").select("uid", "domain", "batch")


@scratched(
    "stream_prompt_responses",
    """SELECT p.event_id AS prompt, r.event_id AS response, round(epoch(r.ts) - epoch(p.ts), 3) AS age
  FROM events p JOIN events r ON p.user_id = r.user_id AND p.event_type = 'view' AND r.event_type <> 'view' AND r.ts BETWEEN p.ts AND p.ts + INTERVAL 6 HOUR""",
)
def _(s, d, at):
    """Every seventh event arrives again or late, a part after its time; pairs and ages are those of the table.

    Views and other events are told apart before repeats are dropped, so that each of the two states holds its own events alone.
    """
    e = _t(s, d, "events").select("event_id", "user_id", "event_type", "ts").withColumn("step", F.unix_date(F.to_date("ts")))
    again, n = e.where("event_id % 7 = 0 or event_id % 7 = 1"), e.count()
    for _ in chain(_arriving(e.where("event_id % 7 <> 0"), f"{at}/in"), _arriving(again, f"{at}/in", 1)):
        rows = _stream(s, f"{at}/in", e.schema).withColumn("ts", F.col("ts").cast("timestamp"))
        views, others = (arrivals.once(rows.where(x), ["event_id"], late="400 days") for x in ("event_type = 'view'", "event_type <> 'view'"))
        prompts = views.select("user_id", F.col("event_id").alias("prompt"), F.col("ts").alias("prompt_ts"))
        responses = others.select("user_id", F.col("event_id").alias("response"), F.col("ts").alias("response_ts"))
        out = arrivals.with_age(arrivals.answered(prompts, responses, key="user_id", within="6 hours", late=None))
        with arrivals.state_on_disk(s, n, trailing=False):
            run = out.writeStream.outputMode("append").option("path", f"{at}/out").option("checkpointLocation", f"{at}/check").trigger(availableNow=True).start()
        run.awaitTermination()
    return s.read.parquet(f"{at}/out").select("prompt", "response", F.round("age", 3).alias("age"))


@scratched("stream_mix_steps", REPLAY)
def _(s, d, at):
    """The live loop with several steps in a micro-batch, a refresh every third one, and a restart: proportions at each step as in the replay."""
    e = _observed(s, d)
    src, out = f"{at}/in", f"{at}/out"
    half = e.agg(F.percentile_approx("step", 0.5)).first()[0]

    def publish(p: DataFrame, step: int) -> None:
        p.withColumn("step", F.lit(step)).write.mode("overwrite").parquet(f"{out}/at={step}")

    for part in (e.where(F.col("step") <= half), e.where(F.col("step") > half)):
        for _ in _arriving(part, src, 2):
            loop = mix_loop.start_mix_loop(_stream(s, src, e.schema), mixers.RewardGap(DOMAINS), publish, f"{at}/check", warmup_step=19725, update_step=3, availableNow=True)
            loop.awaitTermination()
    got = mixers.carry_forward(e, s.read.parquet(out), DOMAINS)
    return got.select(big(F.col("step"), "step"), big(F.col("domain_ord"), "domain_ord"), "domain", r6(F.col("p"), "p"))
