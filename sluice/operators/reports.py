"""Evaluation reports: means over seeds, macro averages, deltas, ranges, pivots and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def non_null_mean(cols: list[str]) -> Column:
    """The mean of the columns that aren't null; null if all are."""
    n = sum((F.col(c).isNotNull().cast("int") for c in cols), F.lit(0))
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in cols), F.lit(0.0))
    return F.try_divide(total, n)


def complete_mean(cols: list[str]) -> Column:
    """The mean of the columns, null unless all are there."""
    return sum((F.col(c) for c in cols[1:]), F.col(cols[0])) / len(cols)


def mean_std(df: DataFrame, by: list[str], cols: list[str], ddof: int = 1) -> DataFrame:
    """By group: n_, mean_ and std_ of each column, nulls skipped; the deviation of one value is 0."""
    std = F.stddev_samp if ddof else F.stddev_pop
    aggs = [a for c in cols for a in (F.count(c).alias(f"n_{c}"), F.avg(c).alias(f"mean_{c}"), F.when(F.count(c) > 0, F.coalesce(std(c), F.lit(0.0))).alias(f"std_{c}"))]
    return df.groupBy(*by).agg(*aggs)


def macro_over_runs(df: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    """By group: mean and deviation over runs of each run's mean over its available columns."""
    runs = df.withColumn("_macro", non_null_mean(cols)).where("_macro is not null")
    return runs.groupBy(*by).agg(F.count("*").alias("n_runs"), F.avg("_macro").alias("macro"), F.coalesce(F.stddev_samp("_macro"), F.lit(0.0)).alias("macro_std"))


def macro_of_means(df: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    """By group: each column's mean, and the mean of those that exist."""
    return df.groupBy(*by).agg(*[F.avg(c).alias(c) for c in cols]).withColumn("macro", non_null_mean(cols))


def levels(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, level, n, mean, low, high) for every prefix of ``by`` at once, from single groups (level 0) to the total: one scan, one shuffle.

    ``level`` says how many of the last columns are summed over, so that a null there is told from a null key.
    """
    out = df.rollup(*by).agg(F.grouping_id().alias("_id"), F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))
    return out.select(*by, F.bit_count("_id").alias("level"), "n", "mean", "low", "high")


def domain_accuracy(df: DataFrame, by: list[str], domain: str = "domain", acc: str = "acc") -> DataFrame:
    """By group: n, the unweighted mean over domains of their accuracy."""
    each = df.groupBy(*by, domain).agg(F.count("*").alias("_n"), F.avg(acc).alias("_a"))
    return each.groupBy(*by).agg(F.sum("_n").alias("n_total"), F.count("*").alias("n_domains"), F.avg("_a").alias("macro_avg"))


def against_baseline(df: DataFrame, by: list[str], value: str, method: str = "method", baselines: tuple[str, ...] = ("baseline", "static")) -> DataFrame:
    """``df`` with ``base`` and ``delta``: the group's first existing baseline, null without one. One small aggregate, joined back."""
    bases = df.where(F.col(method).isin(*baselines)).groupBy(*by).agg(*[F.max(F.when(F.col(method) == b, F.col(value))).alias(f"_b{i}") for i, b in enumerate(baselines)])
    bases = bases.select(*by, F.coalesce(*[f"_b{i}" for i in range(len(baselines))]).alias("base"))
    return df.join(bases, by, "left").withColumn("delta", F.col(value) - F.col("base"))


def method_range(df: DataFrame, by: list[str], value: str, method: str = "method", baseline: str = "baseline") -> DataFrame:
    """By group: smallest and largest value over methods and the baseline's."""
    return df.groupBy(*by).agg(F.min(value).alias("lowest"), F.max(value).alias("highest"), F.max(F.when(F.col(method) == baseline, F.col(value))).alias("baseline"))


def completeness(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row: rows with all of the columns, with any, and rows."""
    there = [F.col(c).isNotNull() for c in cols]
    every, some = there[0], there[0]
    for t in there[1:]:
        every, some = every & t, some | t
    return df.agg(F.count_if(every).alias("n_full"), F.count_if(some).alias("n_any"), F.count("*").alias("n_rows"))


def wide(df: DataFrame, by: list[str], benchmark: str, acc: str, names: list[str]) -> DataFrame:
    """One row a run with a column for each named benchmark."""
    return df.groupBy(*by).pivot(benchmark, names).agg(F.avg(acc))


def display_order(df: DataFrame, column: str, order: list[str], *then: str) -> DataFrame:
    """Rows in a given order of names, unknown names last."""
    at = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(column))
    return df.orderBy(F.when(at > 0, at).otherwise(len(order) + 1), column, *then)


def ranked(df: DataFrame, by: str, *then: str) -> DataFrame:
    """Rows from the best on; a missing value counts as 0."""
    return df.orderBy(F.coalesce(F.col(by), F.lit(0.0)).desc(), *then)


def in_order(df: DataFrame, *keys: str) -> DataFrame:
    """Rows by several keys, such as model, method and seed; missing keys first."""
    return df.orderBy(*[F.col(k).asc_nulls_first() for k in keys])


def progress(runs: DataFrame, wanted: int, done: str = "run") -> DataFrame:
    """(n_done, finished): the number of distinct finished runs against the number wanted; one row."""
    return runs.agg(F.countDistinct(done).alias("n_done")).withColumn("finished", F.col("n_done") >= wanted)


def merge_metrics(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """All runs of ``left`` with the metrics of ``right`` where there are any."""
    return left.join(right, on, "left")


def with_outputs(rows: DataFrame, outputs: DataFrame, on: str = "row_id") -> DataFrame:
    """Rows beside their generated outputs, by an explicit row id."""
    return rows.join(outputs, on)
