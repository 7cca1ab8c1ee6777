"""A configured schedule as one lazy plan: score, act, weights, metrics."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.arrays import masked_sum, reward_column
from ..operators.mixers import carry_forward, domain_windows
from .config import METHODS, Plan


def domain_tag(df: DataFrame, domain_key: str = "domain") -> Column:
    """The domain column, else data_source, else "default"; a choice by column."""
    for c in (domain_key, "data_source"):
        if c in df.columns:
            return F.col(c)
    return F.lit("default")


def stable_uid(*keys: str) -> Column:
    """A prompt id that is the same in every run."""
    return F.sha2(F.concat_ws("\x1f", *[F.col(k).cast("string") for k in keys]), 256)


class Schedule:
    """Score and act on batches; rows of steps before ``warmup_step`` pass with weight 1."""

    def __init__(self, cfg: Any, *, adv_estimator: str | None = None, runtime: dict | None = None):
        self.plan = Plan.resolve(cfg, estimator=adv_estimator, given=runtime)
        self.scorer, self.actuator = self.plan.scorer, self.plan.actuator

    @classmethod
    def named(cls, method: str, **kw) -> Schedule | None:
        """A preset pipeline; None for the baseline."""
        cfg = METHODS[method]
        return None if cfg is None else cls(cfg, **kw)

    def needed(self, batch: DataFrame) -> DataFrame:
        """Only the columns that scoring and acting read, so that a scan of the batch reads no others."""
        want = [*self.scorer.requires, "response_mask", "step", *self.actuator.tie, *(["uid"] if "uid" in batch.columns else []), *[c for c in ("rm_scores", "token_level_scores") if c in batch.columns]]
        return batch.select(*dict.fromkeys(c for c in want if c in batch.columns))

    def weights(self, batch: DataFrame) -> DataFrame:
        """``batch`` with score, kept or weight, and ``rollout_is_weights``: the weight of each token, 0 where masked."""
        out = self.scorer.score(batch)
        mask = F.col("response_mask")
        if self.plan.mechanism == "select":
            out = self.actuator.select(out)
            out = out.withColumn("weight", F.col("kept").cast("double"))
        else:
            out = self.actuator.reweight(out)
        warm = F.col("step") >= self.plan.warmup_step
        if "weight_tok" in out.columns:
            tok = F.zip_with("weight_tok", mask, lambda w, m: F.when(warm, w).otherwise(1.0) * m)
        else:
            tok = F.transform(mask, lambda m: F.when(warm, F.col("weight")).otherwise(1.0) * m)
        return out.withColumn("rollout_is_weights", tok)

    def write_stream(self, batches: DataFrame, path: str, checkpoint: str, *, metrics: str | None = None, **trigger):
        """Starts a stream that writes each micro-batch with its weights to ``path``; a step must come within one micro-batch.

        A repeated micro-batch replaces what it wrote before. ``metrics``: a folder for a row a micro-batch, as ``observed`` says, gathered while
        the weights are written. ``trigger``: as in ``DataStreamWriter.trigger``.
        """

        def each(batch: DataFrame, number: int) -> None:
            out = self.weights(batch)
            if metrics is None:
                out.write.mode("overwrite").parquet(f"{path}/batch={number}")
                return
            seen = Observation()
            observed(out, seen).write.mode("overwrite").parquet(f"{path}/batch={number}")
            got = seen.get
            row = batch.sparkSession.createDataFrame([tuple(got[c] for c in METRICS)], ", ".join(f"{c} {k}" for c, k in METRICS.items()))
            row.write.mode("overwrite").json(f"{metrics}/batch={number}")

        out = batches.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
        return (out.trigger(**trigger) if trigger else out).start()


#: What ``observed`` gathers.
METRICS = {"first_step": "long", "last_step": "long", "n": "long", "weight_mean": "double", "weight_std": "double", "kept_frac": "double"}


def observed(weighted: DataFrame, observation: Observation | str, step: str = "step") -> DataFrame:
    """``weighted``, which tells its metrics when it is computed, without a scan of its own: to an Observation, or by name to query listeners.

    Weights of valid tokens count at token level, else those of rows; ``kept_frac`` is null without ``kept``.
    """
    if "weight_tok" in weighted.columns:
        valid = F.filter(F.arrays_zip(F.col("weight_tok").alias("w"), F.col("response_mask").alias("m")), lambda t: t["m"] == 1)
        total = lambda f: F.aggregate(valid, F.lit(0.0), lambda s, t: s + f(t["w"].cast("double")))
        k, s1, s2 = F.sum(F.size(valid)), F.sum(total(lambda w: w)), F.sum(total(lambda w: w * w))
        mean, std = F.try_divide(s1, k), F.when(k > 1, F.sqrt(F.greatest(F.lit(0.0), (s2 - s1 * s1 / k) / (k - 1))))
    else:
        mean, std = F.avg("weight"), F.stddev_samp("weight")
    kept = F.avg(F.col("kept").cast("double")) if "kept" in weighted.columns else F.max(F.lit(None).cast("double"))
    at = F.col(step).cast("long")
    made = [F.min(at), F.max(at), F.count(F.lit(1)), mean, std, kept]
    return weighted.observe(observation, *[x.alias(c) for x, c in zip(made, METRICS)])


def weight_metrics(weighted: DataFrame, step: str = "step") -> DataFrame:
    """By step: mean and sample deviation of the weights (of valid tokens at token level), and the kept share."""
    if "weight_tok" in weighted.columns:
        tokens = weighted.select(step, F.explode(F.arrays_zip(F.col("weight_tok").alias("w"), F.col("response_mask").alias("m"))).alias("t")).where("t.m = 1")
        return tokens.groupBy(step).agg(F.avg("t.w").alias("weight_mean"), F.stddev_samp("t.w").alias("weight_std"))
    kept = [F.avg(F.col("kept").cast("double")).alias("kept_frac")] if "kept" in weighted.columns else []
    return weighted.groupBy(step).agg(F.avg("weight").alias("weight_mean"), F.stddev_samp("weight").alias("weight_std"), *kept)


def selection_mask(batch: DataFrame, kept: DataFrame, on: list[str]) -> DataFrame:
    """``batch`` with ``weight`` 1 for kept rows and 0 for the rest; an empty selection gives all 0."""
    return batch.join(kept.select(*on).distinct().withColumn("_k", F.lit(1.0)), on, "left").withColumn("weight", F.coalesce("_k", F.lit(0.0))).drop("_k")


class MixReplay:
    """The mixing loop over recorded batches: what the mixer would have published at each step.

    ``value``: the observation of a row, by default its masked reward; pass the scorer's ``score`` to mix on that.
    """

    def __init__(self, cfg: Any, domains: list[str], window: int = 50):
        if not domains:
            raise ValueError("mixing needs at least one domain")
        self.domains, self.window = list(domains), window
        self.plan = Plan.resolve(cfg, given={"domains": domains, "by": ("step",)})
        self.scorer, self.mixer = self.plan.scorer, self.plan.actuator

    def observations(self, batch: DataFrame, compat: str | None = None) -> DataFrame:
        """(step, row_id, domain, value); ``compat="reward_only"`` ignores the configured scorer."""
        if compat == "reward_only":
            v = masked_sum(F.col(reward_column(batch)), F.col("response_mask"))
        else:
            batch, v = self.scorer.score(batch), F.col("score")
        return batch.select("step", "row_id", domain_tag(batch).alias("domain"), v.alias("value"))

    def updates(self, obs: DataFrame) -> DataFrame:
        """(step, domain_ord, domain, p) at the steps on which the mixer refreshes."""
        stats = domain_windows(obs, window=self.window).withColumnRenamed("n_obs", "count")
        at = stats.groupBy("step", "domain").agg(F.max_by(F.struct("mean", "slope", "count"), "row_id").alias("s")).select("step", "domain", "s.*")
        steps = obs.select("step").distinct().where((F.col("step") >= self.plan.warmup_step) & (F.col("step") % max(1, self.plan.update_step) == 0))
        # a domain without rows in a step keeps its latest statistics
        grid = obs.select("step").distinct().crossJoin(at.select("domain").distinct())
        upto = Window.partitionBy("domain").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
        full = grid.join(at, ["step", "domain"], "left")
        full = full.select("step", "domain", *[F.last(c, ignorenulls=True).over(upto).alias(c) for c in ("mean", "slope", "count")]).where("mean is not null")
        return self.mixer.mix(full.join(steps, "step", "left_semi"))

    def proportions(self, obs: DataFrame) -> DataFrame:
        return carry_forward(obs, self.updates(obs), self.domains)
