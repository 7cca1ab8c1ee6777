"""Sinks: parquet, JSON and CSV in a fixed column order, and text tables of small results."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import hadoop_path, names_in
from ..session import ship_package
from .run_files import NO_KEY


def write_parquet(df: DataFrame, path: str, skip_existing: bool = False) -> None:
    """``skip_existing``: an output that is there already stays as it is."""
    df.write.mode("ignore" if skip_existing else "overwrite").parquet(path)


def write_json(df: DataFrame, path: str, skip_existing: bool = False) -> None:
    df.write.mode("ignore" if skip_existing else "overwrite").json(path)


def write_csv(df: DataFrame, path: str, columns: list[str], skip_existing: bool = False) -> None:
    df.select(*columns).write.mode("ignore" if skip_existing else "overwrite").csv(path, header=True)


def write_lines(df: DataFrame, path: str) -> None:
    """The one text column of a small result as one file of that name, such as ``people3_a.jsonl`` or ``gsm8k.json``."""
    spark, part = df.sparkSession, f"{path}.{uuid.uuid4().hex}"
    df.coalesce(1).write.text(part)
    disk, to = hadoop_path(spark, path)
    (name,) = (n for n in names_in(spark, part) if n.startswith("part-"))
    disk.delete(to, False)
    disk.rename(hadoop_path(spark, f"{part}/{name}")[1], to)
    disk.delete(hadoop_path(spark, part)[1], True)


def write_files(rows: DataFrame, path: str, keys: tuple[str, ...], column: str = "value") -> int:
    """A file a row with its text, in folders key=value, a level a key; rows of equal keys are files beside each other. Returns how many.

    Tasks write with Arrow's file systems, ``spark.sql.shuffle.partitions`` of them; for many small files that costs a fraction
    of a partitioned table, whose commit moves each file. A file is written under a hidden name and moved, so that a repeated
    task writes the same files again.
    """
    ship_package(rows.sparkSession)
    root = re.sub(r"^file:/(?!/)", "file:///", path)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(column)).cast("string")
    named = rows.where(F.col(column).isNotNull()).repartition(n, *keys).select(*[F.col(k).cast("string") for k in keys], nth.alias("_n"), F.col(column).alias("_text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = fs.FileSystem.from_uri(root)
        escape = {c: f"%{c:02X}" for c in [*range(32), 127, *map(ord, "\"#%'*/:=?\\{[]^")]}
        done = 0
        for b in batches:
            for *at, i, text in zip(*[c.to_pylist() for c in b.columns]):
                folder = "/".join([top.rstrip("/"), *[f"{k}={NO_KEY if v is None or v == '' else v.translate(escape)}" for k, v in zip(keys, at)]])
                system.create_dir(folder, recursive=True)
                hidden = f"{folder}/.{i}-{uuid.uuid4().hex}"
                with system.open_output_stream(hidden) as f:
                    f.write(text.encode())
                system.move(hidden, f"{folder}/part-{i}.txt")
                done += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([done], pa.int64())})

    return named.mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def text_table(df: DataFrame, style: str = "markdown", digits: int = 1, most: int = 1000) -> str:
    """A report table as markdown, LaTeX or plain text; missing cells are dashes. For results of at most ``most`` rows, more is an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a text table holds at most {most} rows")
    show = lambda v: "--" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    cells = [list(df.columns), *[[show(v) for v in r] for r in rows]]
    if style == "latex":
        return "\n".join(" & ".join(r) + r" \\" for r in cells)
    if style == "markdown":
        lines = ["| " + " | ".join(r) + " |" for r in cells]
        return "\n".join([lines[0], "|" + "---|" * len(df.columns), *lines[1:]])
    width = [max(len(r[i]) for r in cells) for i in range(len(df.columns))]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(r, width)).rstrip() for r in cells)
