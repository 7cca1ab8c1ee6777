"""Ranks within groups of any size: ranges of the sorted rows are tasks, so that no group is sorted in one.

The ranges are written once, because their bounds are sampled when they are made; what is counted in them and what is joined
to them later must see the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import Scratch, final


def in_ranges(df: DataFrame, keys: list[str], order: list[str], scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(rows, ranges). Rows are ``df`` with ``_part``, the number of the range, and ``_i``, rising by one within it; ranges have a row
    for each key and part: ``_first`` (its smallest ``_i``), ``_n`` rows and ``_before`` rows of the key in earlier ranges."""
    by = [*keys, *order, "_tie"]
    rows = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    rows = scratch.keep(rows.drop("_tie").withColumns({"_part": F.spark_partition_id(), "_i": F.monotonically_increasing_id()}))
    ranges = rows.groupBy(*keys, "_part").agg(F.min("_i").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return rows, scratch.keep(ranges.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))))


def beside(rows: DataFrame, few: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``rows`` with the columns of a table of one row a key; null keys meet."""
    other = few.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in few.columns if c not in keys])
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(other, on, how).drop(*[f"_k{i}" for i in range(len(keys))])


def ranked(rows: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with ``_rank``, from 1 on in each key."""
    return beside(rows, ranges, [*keys, "_part"]).withColumn("_rank", F.col("_before") + F.col("_i") - F.col("_first") + 1).drop("_first", "_n", "_before")


def running(rows: DataFrame, ranges: DataFrame, keys: list[str], sums: dict[str, Column], scratch: Scratch) -> DataFrame:
    """``rows`` with ``_rank`` and, for each of ``sums``, the sum of its values over the key's rows up to this one.

    Sums run within ranges; each range starts with what the key's earlier ranges add up to, of which there is one row a range.
    """
    inside = rows.groupBy(*keys, "_part").agg(*[F.sum(x).alias(f"_carry{i}") for i, x in enumerate(sums.values())])
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.select(*keys, "_part", *[F.coalesce(F.sum(f"_carry{i}").over(earlier), F.lit(0)).alias(f"_carry{i}") for i in range(len(sums))])
    start = scratch.keep(beside(ranges, inside, [*keys, "_part"]))
    order = Window.partitionBy(*keys, "_part").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({f"_run{i}": F.sum(x).over(order) for i, x in enumerate(sums.values())})
    out = beside(out, start, [*keys, "_part"]).withColumn("_rank", F.col("_before") + F.col("_i") - F.col("_first") + 1)
    out = out.withColumns({name: F.col(f"_run{i}") + F.col(f"_carry{i}") for i, name in enumerate(sums)})
    return out.drop("_first", "_n", "_before", *[f"_{c}{i}" for c in ("run", "carry") for i in range(len(sums))])


def between(df: DataFrame, keys: list[str], key: Column, ends: DataFrame) -> DataFrame:
    """``df`` with ``kept``: rows of a key below its ``_low`` or above its ``_high``, and as many of those at an end as ``_low_room`` and ``_high_room`` say.

    ``ends`` has one row a key, also with ``_low_count`` and ``_high_count``, the rows at each end. Rows are compared where they are.
    Where an end takes a part of its rows, which are as good as each other, those rows alone are numbered, in ranges.
    """
    got = beside(df.withColumn("_key", key), ends, keys)
    low, high = F.coalesce(F.col("_key") == F.col("_low"), F.lit(False)), F.coalesce(F.col("_key") == F.col("_high"), F.lit(False))
    room = F.when(low & high, F.col("_low_room") + F.col("_high_room")).when(low, F.col("_low_room")).when(high, F.col("_high_room")).otherwise(0)
    count = F.when(low, F.col("_low_count")).when(high, F.col("_high_count")).otherwise(1)
    inside = F.coalesce(F.col("_key") < F.col("_low"), F.lit(False)) | F.coalesce(F.col("_key") > F.col("_high"), F.lit(False))
    cut = "_low_room > 0 and _low_room < _low_count or _high_room > 0 and _high_room < _high_count"
    if ends.where(cut).isEmpty():
        return got.withColumn("kept", inside | (room >= count)).select(*df.columns, "kept")
    got = got.withColumns({"_room": room, "_count": count})
    part = (F.col("_room") > 0) & (F.col("_room") < F.col("_count"))
    rest = got.where(~part).withColumn("kept", inside | (F.col("_room") >= F.col("_count")))
    with Scratch(df.sparkSession) as scratch:
        even = scratch.keep(got.where(part).select(*df.columns, "_key", "_room", F.monotonically_increasing_id().alias("_row")))
        by = [*keys, "_key"]
        rows, ranges = in_ranges(even.select(*by, "_room", "_row"), by, ["_row"], scratch)
        taken = ranked(rows, ranges, by).select("_row", (F.col("_rank") <= F.col("_room")).alias("kept"))
        even = final(even.join(taken, "_row").select(*df.columns, "kept"))
    return rest.select(*df.columns, "kept").unionByName(even)
