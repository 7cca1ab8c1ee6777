"""Thresholds of scores that arrive batch by batch: mergeable quantile sketches of each step, kept from batch to batch.

``topk_fraction`` and ``threshold_band`` need a whole step at hand. Here a step's scores are summed up as a KLL sketch of a few
kilobytes; sketches of batches merge in any order, and the sketch of all batches gives a threshold whose rank is wrong by
at most ``rank_error(k)`` of the step's rows, with 99 % probability. Sketches combine before their shuffle, so that a step of any
size is no hot group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import kv


def rank_error(k: int) -> float:
    """Bound on the rank error of a sketch of size ``k`` as a share of its rows (99 %): 0.0051 at 400, 0.0014 at 1,600."""
    return 2.296 / k**0.9021


def sketched(df: DataFrame, *, score: str = "score", step: str = "step", k: int = 1_600) -> DataFrame:
    """(step, sketch) of the scores; rows with a null step, and null and NaN scores, count in none."""
    known = df.where(F.col(step).isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    return known.groupBy(step).agg(F.kll_sketch_agg_double(F.col(score).cast("double"), F.lit(k)).alias("sketch"))


def merged(*parts: DataFrame, step: str = "step", k: int = 1_600) -> DataFrame:
    """(step, sketch) of all parts' rows, whatever their order."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy(step).agg(F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))


def absorb(batch: DataFrame, path: str, version: int, *, score: str = "score", step: str = "step", k: int = 1_600) -> None:
    """Adds a batch's scores to the keyed table of sketches as snapshot ``version``; a batch that is repeated counts once."""
    new = sketched(batch, score=score, step=step, k=k)
    old = kv.get(batch.sparkSession, path, keys=new.select(step), below=version)
    kv.put(new if old is None else merged(old, new, step=step, k=k), path, step, version)


def thresholds(spark: SparkSession, path: str, fraction: float, *, step: str = "step") -> DataFrame:
    """(step, n, cut): the rows that a step has so far, and the score that about ``fraction`` of them reach."""
    if not 0 < fraction <= 1:
        raise ValueError("fraction must be above 0 and at most 1")
    rows = kv.get(spark, path)
    if rows is None:
        raise ValueError(f"no sketches in {path}")
    return rows.select(step, F.kll_sketch_get_n_double("sketch").alias("n"), F.kll_sketch_get_quantile_double("sketch", F.lit(1.0 - fraction)).alias("cut"))


def select_online(df: DataFrame, cuts: DataFrame, *, score: str = "score", step: str = "step") -> DataFrame:
    """``df`` with ``kept``: the score reaches its step's cut. Null and NaN scores and steps without a cut are not kept."""
    few = cuts.select(F.col(step).alias("cut of step"), F.col("cut").alias("cut of score"))
    s = F.col(score).cast("double")
    rows = df.drop("kept").join(few, F.col(step) == F.col("cut of step"), "left")
    return rows.withColumn("kept", F.coalesce((s >= F.col("cut of score")) & ~F.isnan(s), F.lit(False))).drop("cut of step", "cut of score")
