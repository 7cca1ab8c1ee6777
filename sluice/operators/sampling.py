"""Quota sampling of prompts by domain proportions, and hash-ordered sampling, splitting and shuffling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def sampleable(pool: DataFrame, statuses: tuple[str, ...] = ("finished", "failed")) -> DataFrame:
    """Finished and failed prompts; a missing step counts as 0."""
    return pool.where(F.col("status").isin(*statuses)).withColumn("step", F.coalesce("step", F.lit(0)))


def oldest(pool: DataFrame, batch_size: int, order: tuple[str, ...] = ("step", "uid")) -> DataFrame:
    """The cold start: the oldest prompts, by a top-k that each task cuts first."""
    return pool.orderBy(*order).limit(batch_size)


def quota_targets(proportions: DataFrame, batch_size: int) -> DataFrame:
    """(domain_ord, domain, target) by largest remainders; equal remainders go by domain order. One row a domain."""
    share = F.col("p") * batch_size
    t = proportions.withColumns({"_base": F.floor(share).cast("long"), "_frac": F.round(share - F.floor(share), 12)})
    everyone = Window.partitionBy(F.lit(0))
    t = t.withColumn("_left", F.lit(batch_size) - F.sum("_base").over(everyone))
    extra = F.row_number().over(everyone.orderBy(F.col("_frac").desc(), "domain_ord")) <= F.col("_left")
    return t.select("domain_ord", "domain", (F.col("_base") + F.when(extra, 1).otherwise(0)).cast("long").alias("target"))


def quota_sample(pool: DataFrame, targets: DataFrame, batch_size: int, order: tuple[str, ...] = ("step", "uid")) -> DataFrame:
    """``pool`` rows of one batch with their ``phase``: 0 within quota, 1 other rows of listed domains by domain order and
    age, 2 rows of unlisted domains by age.

    At most ``batch_size`` rows of a domain can matter, and a rank against that constant is cut in each task before the
    shuffle, so a domain of any size costs a task ``batch_size`` rows.
    """
    ranked = pool.withColumn("_rn", F.row_number().over(Window.partitionBy("domain").orderBy(*order))).where(F.col("_rn") <= batch_size)
    j = ranked.join(targets.select("domain", "domain_ord", "target"), "domain", "left")
    phase = F.when(F.col("target").isNull(), 2).when(F.col("_rn") <= F.col("target"), 0).otherwise(1)
    j = j.withColumn("phase", phase).withColumn("_d", F.when(F.col("phase") < 2, F.col("domain_ord")).otherwise(0))
    return j.orderBy("phase", "_d", *order).limit(batch_size).select(*pool.columns, "phase")


def rows_of(rows: DataFrame, selected: DataFrame, key: str = "key", uid: str = "uid") -> DataFrame:
    """All rows whose key's part before "_" is a selected uid."""
    return rows.join(selected.select(F.col(uid).cast("string").alias("_u")), F.split(F.col(key), "_")[0] == F.col("_u"), "left_semi")


def consume(pool: DataFrame, selected: DataFrame, uid: str = "uid") -> DataFrame:
    """The pool without the selected prompts."""
    return pool.join(selected.select(uid), uid, "left_anti")


def drop_stale(pool: DataFrame, current_step: int, max_lag: int) -> DataFrame:
    """Prompts at most ``max_lag`` steps old."""
    return pool.where(F.lit(current_step) - F.coalesce("step", F.lit(0)) <= max_lag)


def hash_order(key: str, seed: int = 0) -> Column:
    """A reproducible shuffle order of an integer key, in arithmetic that any SQL engine can repeat."""
    return F.pmod((F.col(key).cast("long") + seed) * F.lit(2654435761), F.lit(4294967296))


def shuffled(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    return df.orderBy(hash_order(key, seed), key)


def sample_k(df: DataFrame, k: int, key: str, seed: int = 0, keep_order: bool = False) -> DataFrame:
    """k rows without replacement, in shuffled or in the original order of the key."""
    out = shuffled(df, key, seed).limit(k)
    return out.orderBy(key) if keep_order else out


def holdout_split(df: DataFrame, n_test: int, key: str, seed: int = 0) -> DataFrame:
    """``df`` with ``split``: "test" for the first min(n_test, n // 10) rows in shuffled order, else "train".

    The test keys come from a top-k and a count, so no row is ranked in one task.
    """
    test = df.select(key).orderBy(hash_order(key, seed), key).limit(n_test)
    n = df.agg(F.floor(F.count("*") / 10).alias("_n"))
    ranked = test.withColumn("_rn", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(hash_order(key, seed), key)))
    test = ranked.crossJoin(n).where("_rn <= _n").select(F.col(key).alias("_k"), F.lit("test").alias("_s"))
    return df.join(test, df[key] == test["_k"], "left").select(*df.columns, F.coalesce("_s", F.lit("train")).alias("split"))
