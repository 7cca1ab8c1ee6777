"""Scorers: masked array reductions and group rates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import array_total, masked, masked_sum, reward_column
from ..plans.contracts import Scorer
from .ranges import beside


class AdvantageMagnitude(Scorer, name="advantage_magnitude"):
    """|advantage| over the masked tokens: their mean, sum or maximum (masked tokens count as 0)."""

    requires = ("advantages", "response_mask")
    timing, granularity = "post_advantage", "prompt"

    def __init__(self, agg: str = "mean"):
        if agg not in ("mean", "sum", "max"):
            raise ValueError(f"agg {agg!r} is none of mean, sum, max")
        self.agg = agg

    def score(self, df: DataFrame) -> DataFrame:
        self.check(df)
        mask = F.col("response_mask")
        a = masked(F.transform("advantages", F.abs), mask)
        out = {"sum": array_total(a), "max": F.array_max(a), "mean": array_total(a) / F.greatest(array_total(mask), F.lit(1.0))}
        return df.withColumn("score", out[self.agg])


class RewardDifficulty(Scorer, name="reward_difficulty"):
    """The masked sum of token rewards: the outcome reward of a response."""

    requires = ("response_mask",)
    timing, granularity = "post_reward", "prompt"

    def score(self, df: DataFrame) -> DataFrame:
        self.check(df)
        return df.withColumn("score", masked_sum(F.col(reward_column(df)), F.col("response_mask")))


class GroupSolveRate(Scorer, name="group_solve_rate"):
    """The share of a prompt's responses whose reward is above the threshold, on each of its rows.

    An aggregate that combines before its shuffle, joined back, so that a prompt of any size is no hot group.
    """

    requires = ("response_mask",)
    timing, granularity, needs_groups = "post_reward", "prompt", True

    def __init__(self, success_threshold: float = 0.5):
        self.success_threshold = success_threshold

    def score(self, df: DataFrame) -> DataFrame:
        self.check(df)
        won = masked_sum(F.col(reward_column(df)), F.col("response_mask")) > self.success_threshold
        keys = [c for c in ("step", "uid") if c in df.columns]
        rates = df.groupBy(*keys).agg(F.avg(won.cast("double")).alias("_rate"))
        return beside(df.drop("score"), rates, keys).withColumnRenamed("_rate", "score")


class TokenProb(Scorer, name="token_prob"):
    """exp of the old log-probabilities, token by token and unmasked."""

    requires = ("old_log_probs", "response_mask")
    timing, granularity = "post_advantage", "token"

    def score(self, df: DataFrame) -> DataFrame:
        self.check(df)
        return df.withColumn("score", F.transform("old_log_probs", lambda x: F.exp(x.cast("double"))))


class StaticMeta(Scorer, name="static_meta"):
    """A column of the data set as it is."""

    timing, granularity = "pre_rollout", "prompt"

    def __init__(self, column: str):
        self.requires = (column,)

    def score(self, df: DataFrame) -> DataFrame:
        self.check(df)
        return df.withColumn("score", F.col(self.requires[0]).cast("double"))


class DistillGap(Scorer, name="distill_gap"):
    """Mean over masked tokens of old log-probability minus teacher log-probability."""

    requires = ("old_log_probs", "teacher_log_probs", "response_mask")
    timing, granularity = "post_advantage", "prompt"

    def score(self, df: DataFrame) -> DataFrame:
        self.check(df)
        gap = F.zip_with("old_log_probs", "teacher_log_probs", lambda a, b: a.cast("double") - b.cast("double"))
        return df.withColumn("score", masked_sum(gap, F.col("response_mask")) / F.greatest(array_total(F.col("response_mask")), F.lit(1.0)))


class DistillKl(Scorer, name="distill_kl"):
    """Token divergence from a teacher at the sampled tokens: k1 is old - teacher, abs its size, k3 exp(-k1) + k1 - 1."""

    requires = ("old_log_probs", "teacher_log_probs", "response_mask")
    timing, granularity = "post_advantage", "token"

    def __init__(self, estimator: str = "k1"):
        if estimator not in ("k1", "k3", "abs"):
            raise ValueError(f"estimator {estimator!r} is none of k1, k3, abs")
        self.estimator = estimator

    def score(self, df: DataFrame) -> DataFrame:
        self.check(df)
        of = {"k1": lambda k: k, "abs": F.abs, "k3": lambda k: F.exp(-k) + k - 1}[self.estimator]
        return df.withColumn("score", F.zip_with("old_log_probs", "teacher_log_probs", lambda a, b: of(a.cast("double") - b.cast("double"))))


class FunctionScorer(Scorer):
    """A scorer from a vectorised function of pandas columns; Arrow batches carry only the columns that it names.

    The way out for scores that no column expression gives. ``fn(*series) -> series`` must not look across rows.
    """

    def __init__(self, fn: Callable[..., pd.Series], requires: tuple[str, ...]):
        self.fn, self.requires = fn, tuple(requires)

    def score(self, df: DataFrame) -> DataFrame:
        self.check(df)
        fn = self.fn

        @F.pandas_udf("double")
        def run(*cols: pd.Series) -> pd.Series:
            return fn(*cols).astype("float64")

        return df.withColumn("score", run(*self.requires))


class FunctionGroupScorer(Scorer):
    """A score of a whole prompt from functions that no column expression gives, for groups of any size.

    ``partial(frame) -> numbers`` sums up some rows of one group as a fixed number of doubles, and ``final(states) -> float`` makes
    the score of all of a group's states, a matrix with a row each, in any order. A state is made of a group's rows in each Arrow batch
    before the shuffle, so that a hot group sends a row a batch, not its rows. Null keys are a group of their own. The functions
    travel to the workers by value.
    """

    timing, granularity, needs_groups = "post_reward", "prompt", True

    def __init__(self, partial: Callable[[pd.DataFrame], list[float]], final: Callable[[np.ndarray], float], requires: tuple[str, ...], keys: tuple[str, ...] = ("step", "uid")):
        self.partial, self.final, self.requires, self.keys = partial, final, tuple(requires), tuple(keys)

    def score(self, df: DataFrame) -> DataFrame:
        self.check(df)
        partial, final, takes = self.partial, self.final, list(self.requires)
        keys = [c for c in self.keys if c in df.columns]
        at = [f"key {i}" for i in range(len(keys))]

        def states(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                of = b.groupby(at, dropna=False, sort=False).ngroup()
                firsts = b[at].loc[~of.duplicated()]  # groups are numbered as they come
                yield firsts.assign(state=[[float(x) for x in partial(rows)] for _, rows in b[takes].groupby(of)])

        @F.arrow_udf("double")
        def whole(v: pa.Array) -> float:
            return float(final(np.array(v.to_pylist(), dtype="float64")))

        types = ", ".join(f"`{a}` {df.schema[k].dataType.simpleString()}" for a, k in zip(at, keys))
        parts = df.select(*[F.col(k).alias(a) for a, k in zip(at, keys)], *takes).mapInPandas(states, f"{types}, state array<double>")
        scores = parts.groupBy(*at).agg(whole("state").alias("score of group"))
        scores = scores.select(*[F.col(a).alias(k) for a, k in zip(at, keys)], "score of group")
        return beside(df.drop("score"), scores, keys).withColumnRenamed("score of group", "score")
