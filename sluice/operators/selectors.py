"""Selectors: bands, top-k and subsets, each as a ``kept`` column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.arrays import array_total
from ..plans.contracts import Selector
from ..scratch import Scratch, final
from .ranges import beside, between, in_ranges, ranked, running


def _half_even(x: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(x).cast("int"))


#: Groups of at most so many rows are ranked in one task each, by a window; larger ones in ranges, with the same result.
WINDOW = 10_000


def _fits(df: DataFrame, keys: list[str]) -> bool:
    """Whether no group has more than WINDOW rows: a count by key alone."""
    return df.groupBy(*keys).count().where(F.col("count") > WINDOW).isEmpty()


class _Grouped(Selector):
    def keys(self, df: DataFrame) -> list[str]:
        """Step and prompt; one group a step where there is no uid."""
        return [c for c in (self.step, "uid") if c in df.columns]


class ThresholdBand(Selector, name="threshold_band"):
    """low < score < high, both strict unless ``inclusive``."""

    def __init__(self, low: float = 0.0, high: float = 1.0, inclusive: bool = False, **kw):
        super().__init__(**kw)
        self.low, self.high, self.inclusive = low, high, inclusive

    def select(self, df: DataFrame) -> DataFrame:
        s = F.col("score")
        inside = s.between(self.low, self.high) if self.inclusive else (s > self.low) & (s < self.high)
        return df.withColumn("kept", F.coalesce(inside, F.lit(False)))


class TopkFraction(Selector, name="topk_fraction"):
    """The max(1, round-half-even(fraction * n)) best rows of each step."""

    def __init__(self, fraction: float = 0.5, largest: bool = True, **kw):
        super().__init__(**kw)
        if not 0 < fraction <= 1:
            raise ValueError("fraction must be above 0 and at most 1")
        self.fraction, self.largest = fraction, largest

    def select(self, df: DataFrame) -> DataFrame:
        """The last row that is in is found among ranges of (step, score, tie) alone, by jobs of its own; whole rows are compared
        with it where they are and not shuffled."""
        s = F.col("score").cast("double")
        key = F.struct(s.isNull().alias("n"), (F.isnan(s) != F.lit(self.largest)).alias("nan"), (-s if self.largest else s).alias("s"), *[F.col(t).alias(f"t{i}") for i, t in enumerate(self.tie)])
        with Scratch(df.sparkSession) as scratch:
            rows, ranges = in_ranges(df.select(F.col(self.step).alias("_at"), key.alias("_key")), ["_at"], ["_key"], scratch)
            size = ranges.groupBy("_at").agg(_half_even(F.sum("_n") * self.fraction).alias("_want"))
            at = beside(ranked(rows, ranges, ["_at"]), size, ["_at"])
            last = scratch.keep(at.where("_rank = _want").select(F.col("_at"), F.col("_key").alias("_low"), "_want"))
            ends = final(_one_end(rows, last, ["_at"]))
        return between(df, [self.step], key, ends.withColumnRenamed("_at", self.step))


def _one_end(rows: DataFrame, last: DataFrame, keys: list[str]) -> DataFrame:
    """Ends for ``between`` from each key's last row (``_low``) and how many it takes (``_want``)."""
    met = beside(rows, last, keys).where("_key <= _low").groupBy(*keys).agg(F.count_if(F.col("_key") < F.col("_low")).alias("_less"), F.count("*").alias("_upto"))
    out = beside(last, met, keys).withColumns({"_low_room": F.col("_want") - F.col("_less"), "_low_count": F.col("_upto") - F.col("_less")})
    none = F.lit(0).cast("long")
    return out.select(*keys, "_low", "_low_room", "_low_count", F.when(F.lit(False), F.col("_low")).alias("_high"), none.alias("_high_room"), none.alias("_high_count"))


class Gfpo(_Grouped, name="gfpo"):
    """The k shortest, or most efficient (score / length), responses of each prompt."""

    def __init__(self, k: int = 8, metric: str = "efficiency", **kw):
        super().__init__(**kw)
        if metric not in ("short", "efficiency") or k < 1:
            raise ValueError("metric must be short or efficiency, and k positive")
        self.k, self.metric = k, metric

    def select(self, df: DataFrame) -> DataFrame:
        """The k best keys of each prompt come from (prompt, key) alone, cut to k a prompt in every task before they meet, so that
        a prompt of any size is no hot group; whole rows are compared with the last of them. Runs jobs."""
        size = F.greatest(array_total(F.col("response_mask")), F.lit(1.0))
        worth = -size if self.metric == "short" else F.col("score") / size
        key = F.struct(worth.isNull().alias("n"), (-worth).alias("w"), *[F.col(t).alias(f"t{i}") for i, t in enumerate(self.tie)])
        keys = self.keys(df)
        if _fits(df, keys):
            return df.withColumn("kept", F.row_number().over(Window.partitionBy(*keys).orderBy(worth.desc_nulls_last(), *self.tie)) <= self.k)
        with Scratch(df.sparkSession) as scratch:
            rows = scratch.keep(df.select(*keys, key.alias("_key")))
            best = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy("_key"))).where(F.col("_rank") <= self.k)
            last = scratch.keep(best.groupBy(*keys).agg(F.max("_key").alias("_low"), F.count("*").alias("_want")))
            ends = final(_one_end(rows, last, keys))
        return between(df, keys, key, ends)


class MaxVariance(_Grouped, name="max_variance"):
    """The n = max(1, round-half-even(fraction * size)) rows of each prompt whose scores have the largest variance.

    The best subset takes some lowest and some highest rows, so n + 1 splits suffice. Prefix sums give each split's
    variance from two rows of the ranked group; each row is sent to the splits that it bounds, two at most, so work is
    linear in the group. Ranks and sums run over ranges of the narrow sorted rows, with carries from range to range, so that a
    group of any size is many tasks; whole rows are only compared with the ends of the best split. Of equal
    variances the split with fewest low rows wins. Runs jobs.
    """

    def __init__(self, keep_fraction: float = 0.5, **kw):
        super().__init__(**kw)
        if not 0 < keep_fraction <= 1:
            raise ValueError("keep_fraction must be above 0 and at most 1")
        self.keep_fraction = keep_fraction

    def _in_windows(self, df: DataFrame) -> DataFrame:
        """The same with one shuffle of whole rows, where a group fits a task."""
        keys = self.keys(df)
        by = Window.partitionBy(*keys)
        order = by.orderBy(F.col("score").asc_nulls_first(), *self.tie)
        upto = order.rowsBetween(Window.unboundedPreceding, 0)
        r = df.withColumns({"_rk": F.row_number().over(order), "_s1": F.sum("score").over(upto), "_s2": F.sum(F.col("score") * F.col("score")).over(upto)})
        r = r.withColumns({"_g": F.count("*").over(by), "_t1": F.sum("score").over(by), "_t2": F.sum(F.col("score") * F.col("score")).over(by)})
        r = r.withColumn("_n", _half_even(F.col("_g") * self.keep_fraction))
        # a split takes the _a lowest rows (the prefix up to rank _a) and the highest (what follows rank _g - _n + _a)
        ends = F.array(F.struct(F.lit(False).alias("high"), F.col("_rk").cast("long").alias("a")), F.struct(F.lit(True).alias("high"), (F.col("_rk") - F.col("_g") + F.col("_n")).alias("a")))
        r = r.withColumn("_e", F.explode(ends)).withColumns({"_a": F.col("_e.a"), "_high": F.col("_e.high")}).where("not _high or (_n < _g and _a >= 0)")
        split = Window.partitionBy(*keys, "_a")
        s1 = F.sum(F.when(F.col("_high"), F.col("_t1") - F.col("_s1")).otherwise(F.col("_s1"))).over(split)
        s2 = F.sum(F.when(F.col("_high"), F.col("_t2") - F.col("_s2")).otherwise(F.col("_s2"))).over(split)
        r = r.withColumn("_v", F.round(s2 / F.col("_n") - F.pow(s1 / F.col("_n"), 2), 9)).withColumn("_real", F.max("_high").over(split))
        best = F.min(F.when(F.col("_real"), F.struct((-F.col("_v")).alias("v"), F.col("_a").alias("a")))).over(by)["a"]
        r = r.withColumn("_best", best).where("not _high")
        kept = (F.col("_n") >= F.col("_g")) | (F.col("_rk") <= F.col("_best")) | (F.col("_rk") > F.col("_g") - F.col("_n") + F.col("_best"))
        return r.withColumn("kept", F.coalesce(kept, F.lit(False))).select(*df.columns, "kept")

    def select(self, df: DataFrame) -> DataFrame:
        keys, x = self.keys(df), F.col("_x")
        if _fits(df, keys):
            return self._in_windows(df)
        score = F.col("score").cast("double")
        key = F.struct(score.isNotNull().alias("n"), score.alias("s"), *[F.col(t).alias(f"t{i}") for i, t in enumerate(self.tie)])
        with Scratch(df.sparkSession) as scratch:
            rows, ranges = in_ranges(df.select(*keys, key.alias("_key"), score.alias("_x")), keys, ["_key"], scratch)
            r = scratch.keep(running(rows, ranges, keys, {"_s1": F.coalesce(x, F.lit(0.0)), "_s2": F.coalesce(x * x, F.lit(0.0))}, scratch))
            group = r.groupBy(*keys).agg(F.count("*").alias("_g"), F.max_by(F.struct("_s1", "_s2"), "_rank").alias("_t"))
            group = scratch.keep(group.withColumn("_n", _half_even(F.col("_g") * self.keep_fraction)))
            # a split takes the _a lowest rows (the prefix up to rank _a) and the highest (what follows rank _g - _n + _a)
            r = beside(r, group, keys)
            ends = F.array(F.struct(F.lit(False).alias("high"), F.col("_rank").alias("a")), F.struct(F.lit(True).alias("high"), (F.col("_rank") - F.col("_g") + F.col("_n")).alias("a")))
            e = r.where("_n < _g").withColumn("_e", F.explode(ends)).withColumns({"_a": F.col("_e.a"), "_high": F.col("_e.high")}).where("_a between 0 and _n")
            part = lambda i: F.sum(F.when(F.col("_high"), F.col(f"_t._s{i}") - F.col(f"_s{i}")).otherwise(F.col(f"_s{i}")))
            v = e.groupBy(*keys, "_a", "_n").agg(part(1).alias("_p1"), part(2).alias("_p2"), F.max("_high").alias("_real")).where("_real")
            v = v.withColumn("_v", F.round(F.col("_p2") / F.col("_n") - F.pow(F.col("_p1") / F.col("_n"), 2), 9))
            best = scratch.keep(v.groupBy(*keys).agg(F.min(F.struct((-F.col("_v")).alias("v"), F.col("_a").alias("a")))["a"].alias("_best")))
            best = beside(group.select(*keys, "_g", "_n"), best, keys, "left").withColumn("_best", F.coalesce("_best", "_g"))  # a group that stays whole
            upper = F.col("_g") - F.col("_n") + F.col("_best") + 1
            at = beside(r.select(*keys, "_rank", "_key"), best, keys).groupBy(*keys, "_g", "_n", "_best")
            at = scratch.keep(at.agg(F.max(F.when(F.col("_rank") == F.col("_best"), F.col("_key"))).alias("_low"), F.max(F.when((F.col("_rank") == upper) & (F.col("_n") < F.col("_g")), F.col("_key"))).alias("_high")))
            count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
            met = beside(r.select(*keys, "_rank", "_key"), at, keys).groupBy(*keys).agg(
                count(F.col("_key") < F.col("_low")).alias("_less"),
                count(F.col("_key") == F.col("_low")).alias("_low_count"),
                count(F.col("_key") <= F.col("_high")).alias("_upto"),
                count(F.col("_key") == F.col("_high")).alias("_high_count"),
            )
            out = beside(at, met, keys)
            low, high = F.when(F.col("_low").isNotNull(), F.col("_best") - F.col("_less")).otherwise(0), F.when(F.col("_high").isNotNull(), F.col("_upto") - upper + 1).otherwise(0)
            out = final(out.select(*keys, "_low", low.alias("_low_room"), "_low_count", "_high", high.alias("_high_room"), "_high_count"))
        return between(df, keys, key, out)


class MaxMin(_Grouped, name="max_min"):
    """The best and the worst row of each prompt."""

    def select(self, df: DataFrame) -> DataFrame:
        by = Window.partitionBy(*self.keys(df))
        top, low = (F.row_number().over(by.orderBy(o, *self.tie)) == 1 for o in (F.col("score").desc(), F.col("score").asc()))
        return df.withColumn("kept", top | low)


class HighEntropyTokens(Selector, name="high_entropy_tokens"):
    """Rows stay; ``token_kept`` marks tokens whose entropy is in the top ``fraction`` of their response."""

    takes = ("token",)

    def __init__(self, fraction: float = 0.2, **kw):
        super().__init__(**kw)
        self.fraction = fraction

    def select(self, df: DataFrame) -> DataFrame:
        ordered = F.array_sort("score")
        cut = F.get(ordered, F.size("score") - _half_even(F.size("score") * self.fraction))
        return df.withColumn("token_kept", F.transform("score", lambda x: x >= cut)).withColumn("kept", F.lit(True))


def zero_variance_streak(batch: DataFrame, step: str = "step", group: str = "uid", score: str = "score") -> DataFrame:
    """(uid, zero_streak): the number of a prompt's latest steps, without a break, in which all its scores were equal."""
    each = batch.groupBy(group, step).agg(F.var_pop(score).alias("_v"))
    last = F.max(F.when(F.col("_v") > 0, F.col(step))).over(Window.partitionBy(group))
    return each.withColumn("_last", last).groupBy(group).agg(F.count_if(F.col("_last").isNull() | (F.col(step) > F.col("_last"))).alias("zero_streak"))


class HistorySkip(Selector, name="history_skip"):
    """Before the rollout: prompts with a ``zero_streak`` of at least one stay with probability ``explore``, drawn from a hash of
    prompt and step, so that a rerun decides alike."""

    def __init__(self, explore: float = 0.1, **kw):
        super().__init__(**kw)
        if not 0 <= explore <= 1:
            raise ValueError("explore must be between 0 and 1")
        self.explore = explore

    def select(self, df: DataFrame) -> DataFrame:
        draw = F.pmod((F.col("uid").cast("long") * 31 + F.col(self.step)) * F.lit(2654435761), F.lit(4294967296)) / F.lit(4294967296.0)
        return df.withColumn("kept", (F.coalesce("zero_streak", F.lit(0)) < 1) | (draw < self.explore))


class FunctionSelector(_Grouped):
    """A selector from a function of one prompt's rows: ``fn(pandas rows) -> boolean array``.

    The way out for rules that no window gives. The rows of one prompt meet in a task; they are the rollouts of a batch.
    """

    def __init__(self, fn: Callable, **kw):
        super().__init__(**kw)
        self.fn = fn

    def select(self, df: DataFrame) -> DataFrame:
        fn, tie = self.fn, list(self.tie)
        schema = T.StructType([*df.schema.fields, T.StructField("kept", T.BooleanType())])

        def run(rows):
            rows = rows.sort_values(tie)
            return rows.assign(kept=fn(rows))

        return df.groupBy(*self.keys(df)).applyInPandas(run, schema)
