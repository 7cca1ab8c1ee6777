"""Reweighters: weights with mean 1 over a batch.

Batch statistics are an aggregate by step joined back; the aggregate combines before its shuffle and has one row a
step, so adaptive execution broadcasts it while it is small and joins by key beyond that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import array_total, masked_sum
from ..plans.contracts import Reweighter
from ..scratch import Scratch, final
from .ranges import beside, in_ranges, ranked

TINY = 1e-8


class _ByStep(Reweighter):
    def with_stats(self, df: DataFrame, **aggs: Column) -> DataFrame:
        """``df`` with the aggregates of its step; null steps are a batch too."""
        stats = df.groupBy(F.col(self.step).alias("_at")).agg(*[c.alias(n) for n, c in aggs.items()])
        return df.join(stats, df[self.step].eqNullSafe(stats["_at"])).drop("_at")

    def mean_one(self, df: DataFrame, raw: Column) -> DataFrame:
        df = self.with_stats(df.withColumn("_w", raw), _m=F.avg("_w"))
        return df.withColumn("weight", F.col("_w") / F.greatest(F.col("_m"), F.lit(TINY))).drop("_w", "_m")


class Softmax(_ByStep, name="softmax"):
    """n * softmax(score / temperature), normalised to mean 1."""

    def __init__(self, temperature: float = 1.0, **kw):
        super().__init__(**kw)
        if temperature <= 0:
            raise ValueError("temperature must be positive")
        self.temperature = temperature

    def reweight(self, df: DataFrame) -> DataFrame:
        df = self.with_stats(df, _top=F.max("score"))
        return self.mean_one(df, F.exp((F.col("score") - F.col("_top")) / self.temperature)).drop("_top")


class DifficultyBand(_ByStep, name="difficulty_band"):
    """``focus_weight`` for scores between two quantiles of the batch, both included, and 1 elsewhere; mean 1."""

    def __init__(self, low_q: float = 0.25, high_q: float = 0.75, focus_weight: float = 2.0, **kw):
        super().__init__(**kw)
        self.low_q, self.high_q, self.focus_weight = low_q, high_q, focus_weight

    def reweight(self, df: DataFrame) -> DataFrame:
        """The quantiles are exact, interpolated between neighbours, and read from ranges of (step, score) by jobs of their own."""
        with Scratch(df.sparkSession) as scratch:
            rows, ranges = in_ranges(df.where("score is not null").select(F.col(self.step).alias("_at"), F.col("score").cast("double").alias("_s")), ["_at"], ["_s"], scratch)
            size = ranges.groupBy("_at").agg(F.sum("_n").alias("_of"))
            at, pick = beside(ranked(rows, ranges, ["_at"]), size, ["_at"]), []
            for n, q in (("low", self.low_q), ("high", self.high_q)):
                place = (F.col("_of") - 1) * F.lit(float(q))
                near = F.greatest(F.lit(0.0), 1 - F.abs(F.col("_rank") - 1 - place))  # 1 on the place, shared between two neighbours
                pick.append(F.sum(F.when(near > 0, near * F.col("_s"))).alias(f"_{n}"))
            ends = final(at.groupBy("_at").agg(*pick))
        df = beside(self.with_stats(df, _n=F.count("*")).withColumn("_at", F.col(self.step)), ends, ["_at"], "left")
        inside = F.col("score").between(F.col("_low"), F.col("_high"))
        raw = F.when(F.col("_n") <= 1, 1.0).when(inside, float(self.focus_weight)).otherwise(1.0)
        return self.mean_one(df, raw).drop("_low", "_high", "_n", "_at")


class AdvantageReweight(_ByStep, name="advantage_reweight"):
    """alpha * probability + 1 - alpha for each token, scaled so that masked tokens of the batch have mean 1."""

    takes = ("token",)

    def __init__(self, alpha: float = 0.5, **kw):
        super().__init__(**kw)
        if not 0 <= alpha <= 1:
            raise ValueError("alpha must be between 0 and 1")
        self.alpha = alpha

    def reweight(self, df: DataFrame) -> DataFrame:
        df = df.withColumn("_w", F.transform("score", lambda p: p * self.alpha + (1 - self.alpha)))
        mask = F.col("response_mask")
        df = self.with_stats(df, _s=F.sum(masked_sum(F.col("_w"), mask)), _n=F.sum(array_total(mask)))
        scale = F.greatest(F.col("_n"), F.lit(1.0)) / F.greatest(F.col("_s"), F.lit(TINY))
        return df.withColumn("weight_tok", F.transform("_w", lambda w: w * scale)).drop("_w", "_s", "_n")


class PerAdvantage(_ByStep, name="per_advantage"):
    """(|score| + 1e-8) ** alpha with mean 1."""

    def __init__(self, alpha: float = 0.5, **kw):
        super().__init__(**kw)
        self.alpha = alpha

    def reweight(self, df: DataFrame) -> DataFrame:
        return self.mean_one(df, F.pow(F.abs("score") + TINY, F.lit(float(self.alpha))))


class RewardPower(_ByStep, name="reward_power"):
    """score ** p with mean 1; negative scores count as 0."""

    def __init__(self, p: float = 1.0, **kw):
        super().__init__(**kw)
        self.p = p

    def reweight(self, df: DataFrame) -> DataFrame:
        return self.mean_one(df, F.pow(F.greatest("score", F.lit(0.0)), F.lit(float(self.p))))


class ExpTilt(_ByStep, name="exp_tilt"):
    """min(exp(score / beta), clip), not normalised."""

    def __init__(self, beta: float = 1.0, clip: float = 20.0, **kw):
        super().__init__(**kw)
        self.beta, self.clip = beta, clip

    def reweight(self, df: DataFrame) -> DataFrame:
        return df.withColumn("weight", F.least(F.exp(F.col("score") / self.beta), F.lit(float(self.clip))))


class LogisticDifficulty(_ByStep, name="logistic_difficulty"):
    """low + (high - low) / (1 + exp(k * (score - centre))) for a solve rate as score, not normalised."""

    def __init__(self, low: float = 0.4, high: float = 1.5, k: float = 10.0, centre: float = 0.75, **kw):
        super().__init__(**kw)
        self.low, self.high, self.k, self.centre = low, high, k, centre

    def reweight(self, df: DataFrame) -> DataFrame:
        return df.withColumn("weight", self.low + (self.high - self.low) / (1 + F.exp(self.k * (F.col("score") - self.centre))))


class TruncatedImportance(_ByStep, name="truncated_importance"):
    """min(exp(log p - log b), clip) for each token, from ``log_probs`` and ``old_log_probs``."""

    takes = ("token",)

    def __init__(self, clip: float = 2.0, **kw):
        super().__init__(**kw)
        self.clip = clip

    def reweight(self, df: DataFrame) -> DataFrame:
        return df.withColumn("weight_tok", F.zip_with("log_probs", "old_log_probs", lambda a, b: F.least(F.exp(a - b), F.lit(float(self.clip)))))


class MediumBump(_ByStep, name="medium_bump"):
    """A Gaussian bump of a solve rate around ``centre``, with mean 1."""

    def __init__(self, centre: float = 0.5, width: float = 0.25, **kw):
        super().__init__(**kw)
        if width <= 0:
            raise ValueError("width must be positive")
        self.centre, self.width = centre, width

    def reweight(self, df: DataFrame) -> DataFrame:
        return self.mean_one(df, F.exp(-F.pow((F.col("score") - self.centre) / self.width, 2) / 2))
