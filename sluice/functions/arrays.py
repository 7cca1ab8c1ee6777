"""Masked reductions of token arrays, as column expressions (no explode, no shuffle)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def masked(values: Column, mask: Column) -> Column:
    """values * mask, element by element; a null element or mask counts as 0."""
    return F.zip_with(values, mask, lambda v, m: F.coalesce(v.cast("double") * m.cast("double"), F.lit(0.0)))


def array_total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v.cast("double"))


def masked_sum(values: Column, mask: Column) -> Column:
    return array_total(masked(values, mask))


def reward_column(df: DataFrame) -> str:
    """rm_scores if the batch has it, else token_level_scores; a choice by column, not by row."""
    for name in ("rm_scores", "token_level_scores"):
        if name in df.columns:
            return name
    raise KeyError("the batch has neither rm_scores nor token_level_scores")
