"""Table functions for SQL, in Arrow batches: one row in, any number of rows out."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..session import ship_package


class MetricRows:
    """(metric, number) of each name:number in a line whose name begins with the prefix."""

    def eval(self, line: str, prefix: str) -> Iterator[tuple[str, float]]:
        for m in re.finditer(rf"{re.escape(prefix or '')}([a-z0-9_]*):([0-9.]+)", line or ""):
            try:
                yield (prefix or "") + m[1], float(m[2])
            except ValueError:
                continue


class MetricColumns:
    """One row a line with a column for each of the names, a constant list: the number after ``name:``, null where there is none."""

    @staticmethod
    def analyze(line: AnalyzeArgument, names: AnalyzeArgument) -> AnalyzeResult:
        if not names.isConstantExpression or not names.value:
            raise ValueError("metric_columns needs a constant list of names, such as 'loss,acc'")
        schema = StructType()
        for n in names.value.split(","):
            schema = schema.add(n.strip(), "double")
        return AnalyzeResult(schema)

    def eval(self, line: str, names: str) -> Iterator[tuple[float | None, ...]]:
        said: dict[str, float] = {}
        for m in re.finditer(r"(?<![A-Za-z0-9_])([A-Za-z0-9_]+):(-?[0-9]+(?:\.[0-9]+)?)", line or ""):
            said.setdefault(m[1], float(m[2]))
        yield tuple(said.get(n.strip()) for n in names.split(","))


def register_tables(spark: SparkSession) -> None:
    """Makes ``metric_rows(line, prefix)`` and ``metric_columns(line, names)`` table functions of the session's SQL."""
    ship_package(spark)
    spark.udtf.register("metric_rows", udtf(MetricRows, returnType="metric string, number double"))
    spark.udtf.register("metric_columns", udtf(MetricColumns))
