"""A small keyed table as snapshots: puts replace rows by key, gets read the latest snapshot.

Each put writes ``<path>/<version>`` from the newest snapshot of a lower version, so that a batch that is repeated after
a failure writes the same again. It suits tables of one row a domain or a prompt, such as a loop's state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..scratch import hadoop_path, names_in


def versions(spark: SparkSession, path: str) -> list[int]:
    """Versions of complete snapshots, in order."""
    return sorted(int(n) for n in names_in(spark, path) if n.isdigit() and "_SUCCESS" in names_in(spark, f"{path}/{n}"))


def get(spark: SparkSession, path: str, keys: DataFrame | None = None, columns: list[str] | None = None, below: int | None = None) -> DataFrame | None:
    """Rows of the latest snapshot (of a version below ``below``), those of ``keys`` alone if given; None if there is none."""
    known = [v for v in versions(spark, path) if below is None or v < below]
    if not known:
        return None
    rows = spark.read.parquet(f"{path}/{known[-1]}")
    if keys is not None:
        rows = rows.join(keys.distinct(), keys.columns, "left_semi")
    return rows.select(*columns) if columns else rows


def put(df: DataFrame, path: str, key: str, version: int) -> None:
    """Adds ``df``'s rows, one a key, in place of those with the same keys, as snapshot ``version``; of the older ones only the last stays."""
    spark = df.sparkSession
    before = get(spark, path, below=version)
    rows = df if before is None else before.join(df.select(key), key, "left_anti").unionByName(df)
    rows.write.mode("overwrite").parquet(f"{path}/{version}")
    for old in [v for v in versions(spark, path) if v < version][:-1]:
        fs, at = hadoop_path(spark, f"{path}/{old}")
        fs.delete(at, True)


def clear(spark: SparkSession, path: str) -> None:
    """Drops the table with all its snapshots."""
    fs, at = hadoop_path(spark, path)
    fs.delete(at, True)
