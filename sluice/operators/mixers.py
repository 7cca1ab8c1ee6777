"""Domain statistics over sliding windows of observations, and mixers that turn them into proportions.

Mixers work on a table with one row a domain (for each value of the ``by`` columns, such as a step), so their windows
hold a handful of rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..plans.contracts import Mixer
from ..scratch import Scratch, final
from .ranges import beside, in_ranges, ranked


def domain_windows(obs: DataFrame, *, domain: str = "domain", value: str = "value", order: tuple[str, ...] = ("step", "row_id"), window: int = 50) -> DataFrame:
    """``obs`` with n_obs, mean and slope of the domain's last ``window`` observations, its own row included.

    slope is the least-squares slope over the observations' numbers; 0 with fewer than two. A domain's history is cut into
    ranges, each a task, and a range begins with a copy of the ``window - 1`` observations before it. The ranges are
    written, so this runs jobs; the result is a table of its own.
    """
    with Scratch(obs.sparkSession) as scratch:
        rows, ranges = in_ranges(obs, [domain], list(order), scratch)
        if window > 1:
            # for each range those that come soon after it, and how many observations lie between
            ends = ranges.select(domain, "_part", "_first", "_n", (F.col("_before") + F.col("_n")).alias("_end"))
            later = ranges.select(F.col(domain).alias("_d"), F.col("_part").alias("_to"), F.col("_before").alias("_begin"))
            soon = ends.join(later, F.col(domain).eqNullSafe(F.col("_d")) & (F.col("_to") > F.col("_part")) & (F.col("_begin") - F.col("_end") < window - 1))
            soon = soon.select(domain, "_part", "_to", (F.col("_first") + F.col("_n") - (window - 1) + F.col("_begin") - F.col("_end")).alias("_from"))
            halo = beside(rows, scratch.keep(soon), [domain, "_part"]).where("_i >= _from").drop("_from")
            halo = halo.withColumn("_part", F.col("_to")).drop("_to").withColumn("_own", F.lit(False))
            rows = rows.withColumn("_own", F.lit(True)).unionByName(halo)
        else:
            rows = rows.withColumn("_own", F.lit(True))
        ordered = Window.partitionBy(domain, "_part").orderBy("_i")
        frame = ordered.rowsBetween(-(window - 1), 0)
        out = rows.withColumn("_x", F.row_number().over(ordered).cast("double"))
        out = out.withColumns({"n_obs": F.count(value).over(frame), "mean": F.coalesce(F.avg(value).over(frame), F.lit(0.0)), "slope": F.coalesce(F.regr_slope(F.col(value), F.col("_x")).over(frame), F.lit(0.0))})
        return final(out.where("_own").drop("_own", "_part", "_i", "_x"))


def domains_seen(obs: DataFrame, *, domain: str = "domain") -> DataFrame:
    """The distinct domains with an observation."""
    return obs.select(domain).where(F.col(domain).isNotNull()).distinct()


def latest(stats: DataFrame, *, domain: str = "domain", order: tuple[str, ...] = ("step", "row_id")) -> DataFrame:
    """The last row of each domain, by an aggregate that combines before it shuffles."""
    rest = [c for c in stats.columns if c != domain]
    last = stats.groupBy(domain).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return last.select(domain, "_r.*")


def domain_table(spark: SparkSession, domains: list[str]) -> DataFrame:
    """The configured domains with their order."""
    if not domains:
        raise ValueError("a mixer needs at least one domain")
    return spark.createDataFrame([(i, d) for i, d in enumerate(domains)], "domain_ord int, domain string")


class _Mixer(Mixer):
    def __init__(self, domains: list[str], temperature: float = 1.0, floor: float = 0.05, by: tuple[str, ...] = (), **kw):
        super().__init__(**kw)
        self.domains, self.temperature, self.floor, self.by = list(domains), temperature, floor, tuple(by)

    def all_domains(self, stats: DataFrame, **defaults: float) -> DataFrame:
        """Each group's statistics for every configured domain, with defaults for those without any."""
        d = domain_table(stats.sparkSession, self.domains)
        if self.by:
            d = stats.select(*self.by).distinct().crossJoin(d)
        return d.join(stats.select(*self.by, "domain", *defaults), [*self.by, "domain"], "left").fillna(defaults)

    def softmax(self, df: DataFrame, signal: Column) -> DataFrame:
        """softmax, floor and renormalisation within each group; the floor may be undercut by the last step."""
        by = Window.partitionBy(*self.by) if self.by else Window.partitionBy(F.lit(0))
        df = df.withColumn("_x", signal)
        df = df.withColumn("_e", F.exp((F.col("_x") - F.max("_x").over(by)) / max(self.temperature, 1e-6)))
        df = df.withColumn("_p", F.greatest(F.col("_e") / F.sum("_e").over(by), F.lit(float(self.floor))))
        return df.select(*self.by, "domain_ord", "domain", (F.col("_p") / F.sum("_p").over(by)).alias("p"))


class RewardGap(_Mixer, name="reward_gap"):
    """softmax of how far a domain's mean is below the best."""

    def mix(self, stats: DataFrame) -> DataFrame:
        by = Window.partitionBy(*self.by) if self.by else Window.partitionBy(F.lit(0))
        df = self.all_domains(stats, mean=0.0)
        return self.softmax(df, F.max("mean").over(by) - F.col("mean"))


class Static(_Mixer, name="static"):
    """Given proportions, or equal ones; statistics don't matter."""

    def __init__(self, domains: list[str], proportions: list[float] | None = None, **kw):
        super().__init__(domains=domains, **kw)
        p = [1.0] * len(domains) if proportions is None else [float(x) for x in proportions]
        if len(p) != len(domains) or sum(p) <= 0:
            raise ValueError("proportions must be one positive-sum list for the domains")
        self.proportions = [x / sum(p) for x in p]

    def mix(self, stats: DataFrame) -> DataFrame:
        d = domain_table(stats.sparkSession, self.domains)
        d = d.withColumn("p", F.element_at(F.array(*[F.lit(x) for x in self.proportions]), F.col("domain_ord") + 1))
        return (stats.select(*self.by).distinct().crossJoin(d) if self.by else d).select(*self.by, "domain_ord", "domain", "p")


class DumpUcb(_Mixer, name="dump_ucb"):
    """softmax of value + c * sqrt(2 ln(N + 1) / (n + 1)); value is the ``mean`` column, n the domain's ``count``."""

    def __init__(self, domains: list[str], c: float = 1.0, **kw):
        super().__init__(domains=domains, **kw)
        self.c = c

    def mix(self, stats: DataFrame) -> DataFrame:
        by = Window.partitionBy(*self.by) if self.by else Window.partitionBy(F.lit(0))
        df = self.all_domains(stats, mean=0.0, count=0)
        bonus = F.sqrt(2 * F.ln(F.sum("count").over(by) + F.lit(1.0)) / (F.col("count") + 1))
        return self.softmax(df.withColumn("_b", bonus), F.col("mean") + self.c * F.col("_b"))


class Tscl(_Mixer, name="tscl"):
    """softmax of learning progress: |slope|, or the positive part of the slope if ``signed``."""

    def __init__(self, domains: list[str], signed: bool = False, **kw):
        super().__init__(domains=domains, **kw)
        self.signed = signed

    def mix(self, stats: DataFrame) -> DataFrame:
        s = F.greatest("slope", F.lit(0.0)) if self.signed else F.abs("slope")
        return self.softmax(self.all_domains(stats, slope=0.0), s)


class Exp3(_Mixer, name="exp3"):
    """(1 - gamma) * w / sum(w) + gamma / K from the domains' ``log_weight``; ``updated`` gives the next weights from rewards."""

    def __init__(self, domains: list[str], gamma: float = 0.1, **kw):
        super().__init__(domains=domains, **kw)
        if not 0 < gamma <= 1:
            raise ValueError("gamma must be above 0 and at most 1")
        self.gamma = gamma

    def mix(self, stats: DataFrame) -> DataFrame:
        by = Window.partitionBy(*self.by) if self.by else Window.partitionBy(F.lit(0))
        df = self.all_domains(stats, log_weight=0.0).withColumn("_e", F.exp(F.col("log_weight") - F.max("log_weight").over(by)))
        p = (1 - self.gamma) * F.col("_e") / F.sum("_e").over(by) + self.gamma / len(self.domains)
        return df.select(*self.by, "domain_ord", "domain", p.alias("p"))

    def updated(self, stats: DataFrame, rewards: DataFrame) -> DataFrame:
        """(domain, log_weight) after one step's (domain, reward), rewards scaled to 0..1; domains without a reward keep theirs."""
        now = self.all_domains(stats, log_weight=0.0).join(self.mix(stats).select("domain", "p"), "domain").join(rewards.select("domain", "reward"), "domain", "left")
        return now.select("domain", (F.col("log_weight") + F.coalesce(self.gamma * F.col("reward") / (len(self.domains) * F.col("p")), F.lit(0.0))).alias("log_weight"))

    def over_steps(self, rewards: DataFrame, *, step: str = "step") -> DataFrame:
        """(step, domain_ord, domain, p, log_weight): proportions in force at each step and the weights that they come from, from equal ones on.

        ``rewards``: (step, domain, reward), rewards scaled to 0..1; several of a domain in a step count as their mean, and a domain without one keeps its weight.
        Each step's weights follow from the last step's proportions, so this is a recursive query over one row a step,
        which holds a number a domain. It runs a small job a step.
        """
        spark, k = rewards.sparkSession, len(self.domains)
        names = F.array(*[F.lit(d) for d in self.domains])
        each = rewards.where(F.col(step).isNotNull() & F.col("domain").isin(*self.domains)).groupBy(step, "domain").agg(F.avg("reward").alias("x"))
        table = each.groupBy(step).agg(F.map_from_entries(F.collect_list(F.struct("domain", "x"))).alias("m"))  # at most a row a domain
        table = table.select(F.col(step).alias("at"), F.transform(names, lambda d: F.coalesce(F.try_element_at("m", d), F.lit(0.0))).alias("x"))
        table = table.withColumn("i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("at")))  # a row a step
        with Scratch(spark) as scratch:
            table = scratch.keep(table)
            limits = {"spark.sql.cteRecursionLevelLimit": table.count() + 2, "spark.sql.cteRecursionRowLimit": -1}
            old = {c: spark.conf.get(c, None) for c in limits}
            try:
                for c, v in limits.items():
                    spark.conf.set(c, v)
                got = spark.sql(
                    f"""WITH RECURSIVE w(i, lw) AS (
                      SELECT 1, array_repeat(0.0D, {k})
                      UNION ALL
                      SELECT i + 1, zip_with(zip_with(lw, x, (l, y) -> struct(l, y)), p, (a, q) -> a.l + {self.gamma}D * a.y / ({k} * q))
                      FROM (SELECT i, lw, x, transform(e, v -> {1 - self.gamma}D * v / aggregate(e, 0.0D, (s, u) -> s + u) + {self.gamma / k}D) AS p
                            FROM (SELECT w.i, w.lw, t.x, transform(w.lw, l -> exp(l - array_max(w.lw))) AS e FROM w JOIN {{table}} t ON t.i = w.i)))
                    SELECT t.at, w.lw, transform(w.lw, l -> exp(l - array_max(w.lw))) AS e FROM w JOIN {{table}} t ON t.i = w.i""",
                    table=table,
                )
                got = got.select("at", F.posexplode("lw").alias("domain_ord", "log_weight"), "e")
                total = F.aggregate("e", F.lit(0.0), lambda s, v: s + v)
                p = (1 - self.gamma) * F.get("e", F.col("domain_ord")) / total + self.gamma / k
                return final(got.select(F.col("at").alias(step), "domain_ord", F.get(names, F.col("domain_ord")).alias("domain"), p.alias("p"), "log_weight"))
            finally:
                for c, v in old.items():
                    spark.conf.unset(c) if v is None else spark.conf.set(c, v)


class ReplayPriority(_Mixer, name="replay_priority"):
    """(1 - rho) * rank ** (-1 / beta) + rho * staleness, each as a share; ranks by ``mean``, staleness since ``last_step``."""

    def __init__(self, domains: list[str], rho: float = 0.1, beta: float = 1.0, **kw):
        super().__init__(domains=domains, **kw)
        self.rho, self.beta = rho, beta

    def mix(self, stats: DataFrame) -> DataFrame:
        by = Window.partitionBy(*self.by) if self.by else Window.partitionBy(F.lit(0))
        df = self.all_domains(stats, mean=0.0, last_step=0)
        df = df.withColumn("_r", F.pow(F.row_number().over(by.orderBy(F.col("mean").desc(), "domain_ord")).cast("double"), F.lit(-1.0 / self.beta)))
        df = df.withColumn("_s", (F.max("last_step").over(by) - F.col("last_step")).cast("double"))
        stale = F.coalesce(F.try_divide(F.col("_s"), F.sum("_s").over(by)), F.lit(1.0 / len(self.domains)))
        return df.select(*self.by, "domain_ord", "domain", ((1 - self.rho) * F.col("_r") / F.sum("_r").over(by) + self.rho * stale).alias("p"))


class FunctionMixer(_Mixer):
    """A mixer from a function of one group's rows: ``fn(pandas rows of domain_ord, domain and the ``using`` columns) -> signal``.

    The way out for signals that no column expression gives. A group is one row a domain; softmax and floor follow.
    """

    def __init__(self, domains: list[str], fn: Callable, using: dict[str, float], **kw):
        super().__init__(domains=domains, **kw)
        self.fn, self.using = fn, dict(using)

    def mix(self, stats: DataFrame) -> DataFrame:
        df, fn = self.all_domains(stats, **self.using), self.fn
        schema = T.StructType([*df.schema.fields, T.StructField("_signal", T.DoubleType())])

        def run(rows):
            rows = rows.sort_values("domain_ord")
            return rows.assign(_signal=fn(rows))

        return self.softmax(df.groupBy(*self.by).applyInPandas(run, schema), F.col("_signal"))


def ewma(obs: DataFrame, *, domain: str = "domain", value: str = "value", order: tuple[str, ...] = ("step",), beta: float = 0.9) -> DataFrame:
    """(domain, ewma) with s = beta * s + (1 - beta) * value from 0 over all observations of a domain; null values count as 0.

    Ranks come from ranges of the narrow sorted rows, and the weights beta ** (n - rank) add up in each task before anything
    is shuffled. Runs jobs.
    """
    with Scratch(obs.sparkSession) as scratch:
        rows, ranges = in_ranges(obs.select(domain, *order, F.col(value).alias("_v")), [domain], list(order), scratch)
        size = ranges.groupBy(domain).agg(F.sum("_n").alias("_size"))
        at = beside(ranked(rows, ranges, [domain]), size, [domain])
        weight = F.pow(F.lit(float(beta)), F.col("_size") - F.col("_rank"))
        return final(at.groupBy(domain).agg(F.sum((1 - beta) * weight * F.coalesce("_v", F.lit(0.0))).alias("ewma")))


def ewma_path(obs: DataFrame, *, domain: str = "domain", value: str = "value", order: tuple[str, ...] = ("step",), beta: float = 0.9) -> DataFrame:
    """``obs`` with ``ewma`` after each observation: s = beta * s + (1 - beta) * value from 0; null values count as 0.

    A segmented scan of affine maps. Observations of a domain are cut by rank into blocks so short that beta ** -block stays
    a plain number; within a block a window of powers gives s from 0, and a block hands on the map s -> beta ** block * s + its own
    sum. Its image reaches the next few blocks alone, beyond which beta's power is 0 in double precision, so carries are an
    aggregate by (domain, block), and no domain is ordered in one task. Runs jobs.
    """
    if not 0 <= beta < 1:
        raise ValueError("beta must be at least 0 and below 1")
    block = max(1, min(4096, int(12 / -math.log10(beta)))) if beta > 0 else 1
    reach = max(1, math.ceil(330 / (block * -math.log10(beta)))) if beta > 0 else 1
    b = F.lit(float(beta))
    with Scratch(obs.sparkSession) as scratch:
        rows, ranges = in_ranges(obs, [domain], list(order), scratch)
        rows = ranked(rows, ranges, [domain]).withColumns({"_block": F.floor((F.col("_rank") - 1) / block), "_at": (F.col("_rank") - 1) % block})
        here = Window.partitionBy(domain, "_block").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
        share = (1 - beta) * F.coalesce(F.col(value).cast("double"), F.lit(0.0))
        own = F.sum(share / F.pow(b, "_at")).over(here) * F.pow(b, "_at") if beta > 0 else share
        rows = scratch.keep(rows.withColumn("_own", own))
        sums = rows.groupBy(domain, "_block").agg(F.max_by("_own", "_at").alias("_sum"))
        sent = sums.withColumn("_later", F.explode(F.sequence(F.lit(1), F.lit(reach)))).withColumn("_sum", F.col("_sum") * F.pow(b, (F.col("_later") - 1) * block))
        carry = sent.groupBy(domain, (F.col("_block") + F.col("_later")).alias("_block")).agg(F.sum("_sum").alias("_carry"))
        out = beside(rows, carry, [domain, "_block"], "left").withColumn("ewma", F.col("_own") + F.pow(b, F.col("_at") + 1) * F.coalesce("_carry", F.lit(0.0)))
        return final(out.select(*obs.columns, "ewma"))


def refresh_metrics(proportions: DataFrame, stats: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, metric, value) of a refresh: prop_<domain> of every configured domain, and reward_<domain>, its mean, of those that have been seen."""
    name = lambda kind: F.concat(F.lit(kind), F.col("domain"))
    return proportions.select(*by, name("prop_").alias("metric"), F.col("p").alias("value")).unionByName(stats.where("mean is not null").select(*by, name("reward_").alias("metric"), F.col("mean").alias("value")))


def group_variance(batch: DataFrame, *, domain: str = "domain", group: str = "uid", score: str = "score") -> DataFrame:
    """(domain, mean_variance): the mean over prompts of the population variance of their scores."""
    return batch.groupBy(domain, group).agg(F.var_pop(score).alias("_v")).groupBy(domain).agg(F.avg("_v").alias("mean_variance"))


def asof_join(events: DataFrame, updates: DataFrame, keys: list[str], values: list[str], *, time: str = "ts") -> DataFrame:
    """``events`` with ``values`` of the latest update of their key at or before their time; nulls where there is none.

    Events and updates are sorted together in ranges, and a range starts with the last update of the key's earlier ranges, so
    that a key of any size is many tasks and nothing is paired. Of updates of one key and time the one with the greatest values counts.
    Null keys meet; events without a time get none. Runs jobs.
    """
    spark = events.sparkSession
    at = lambda df, kind, u, row: df.select(*keys, time, F.lit(kind).alias("_kind"), u.alias("_u"), row.alias("_row"))
    one = at(updates.where(F.col(time).isNotNull()), 0, F.struct(*values), F.lit(None))
    two = at(events, 1, F.lit(None), F.struct(*events.columns))
    with Scratch(spark) as scratch:
        rows, _ = in_ranges(one.unionByName(two), keys, [time, "_kind", "_u"], scratch)
        last = rows.where("_kind = 0").groupBy(*keys, "_part").agg(F.max_by("_u", "_i").alias("_latest"))
        parts = rows.select(*keys, "_part").distinct()
        upto = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
        carry = scratch.keep(beside(parts, last, [*keys, "_part"], "left").select(*keys, "_part", F.last("_latest", ignorenulls=True).over(upto).alias("_carry")))
        here = F.last("_u", ignorenulls=True).over(Window.partitionBy(*keys, "_part").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0))
        out = beside(rows.withColumn("_here", here).where("_kind = 1"), carry, [*keys, "_part"])
        got = F.coalesce("_here", "_carry")
        return final(out.select("_row.*", *[got[v].alias(v) for v in values]))


def carry_forward(steps: DataFrame, updates: DataFrame, domains: list[str], *, step: str = "step") -> DataFrame:
    """(step, domain_ord, domain, p): for each step the latest proportions published at or before it, uniform before the first."""
    grid = steps.select(step).distinct().crossJoin(domain_table(steps.sparkSession, domains))
    joined = grid.join(updates.select(step, "domain", "p"), [step, "domain"], "left")
    upto = Window.partitionBy("domain").orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    return joined.select(step, "domain_ord", "domain", F.coalesce(F.last("p", ignorenulls=True).over(upto), F.lit(1.0 / len(domains))).alias("p"))
