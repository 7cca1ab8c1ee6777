"""Sources: data sets, run directories, metrics, job lists and logs. Schemas are given, never inferred from data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MESSAGE = "struct<role:string,content:string>"
#: Benchmarks of the run table (fixed values).
BENCHMARKS = "math500 aime24 olympiadbench minerva_math gsm8k kk_hard bbh_logical_deduction bbh_tracking zebra_logic_mc gpqa_diamond mmlu_pro_chemistry mmlu_pro_physics".split()
RUNS = "run_id string, campaign string, model string, method string, seed int, steps int, regime string, " + ", ".join(f"{b} double" for b in BENCHMARKS)
EVAL = "model string, benchmark string, data_path string, n bigint, acc double, per_row array<struct<acc:double,score:double,resp_len:bigint>>"


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines give no row."""
    return spark.read.schema(schema).json(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header; empty cells are null."""
    return spark.read.schema(schema).option("header", True).csv(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, RUNS)


def read_people(spark: SparkSession, path: str) -> DataFrame:
    """Puzzles from files named people<N>_*.jsonl, with N as n_people."""
    rows = spark.read.schema("quiz string, solution_text string").json(path)
    return rows.withColumn("n_people", F.regexp_extract(F.col("_metadata.file_name"), r"people(\d+)", 1).try_cast("int"))


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """(prompt, ground_truth): the label, or the answer where there is no label, without blanks around."""
    rows = spark.read.schema(f"prompt array<{MESSAGE}>, label string, answer string").json(path)
    return rows.select("prompt", F.trim(F.coalesce("label", "answer", F.lit(""))).alias("ground_truth"))


def read_evals(spark: SparkSession, glob: str) -> DataFrame:
    """Result JSON of a directory tree .../<scale>/<run>/<benchmark>.json, keys taken from the path."""
    rows = spark.read.schema(EVAL).option("multiLine", True).json(glob).withColumn("path", F.col("_metadata.file_path"))
    rx = r"([^/]+)/([^/]+)/([^/]+)\.json$"
    return rows.select(*[F.regexp_extract("path", rx, i + 1).alias(n) for i, n in enumerate(("scale", "run", "file_benchmark"))], "model", "benchmark", "n", "acc", "per_row")


def read_metrics(spark: SparkSession, glob: str) -> DataFrame:
    """(path, value): a metric under acc, accuracy or score, at the top or under "overall"; 0 is a value, not a gap."""
    raw = spark.read.text(glob, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    keys = [f"$.{p}{k}" for p in ("", "overall.") for k in ("acc", "accuracy", "score")]
    return raw.select("path", F.coalesce(*[F.get_json_object("value", k).try_cast("double") for k in keys]).alias("value"))


def _leaves(kind: T.DataType, path: tuple[str, ...] = ()) -> list[tuple[str, ...]]:
    """Paths to all that is neither an object nor a list nor true or false."""
    if isinstance(kind, T.StructType):
        return [x for f in kind for x in _leaves(f.dataType, (*path, f.name))]
    return [] if isinstance(kind, (T.ArrayType, T.BooleanType, T.NullType)) or not path else [path]


def metric_leaves(rows: DataFrame, column: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(kept columns, metric, value) of every number in JSON texts of unknown keys, at any depth; the metric is its keys joined by dots.

    Numbers as text count, and 0 is a value; null, other text, lists, and texts that aren't JSON give nothing. Where a key holds a
    number here and an object there both are found. One pass gathers the distinct shapes of the texts, a second reads them: keys are names, so shapes are few.
    """
    parsed = rows.select(*keep, F.try_parse_json(column).alias("_json"))
    shapes = parsed.select(F.schema_of_variant("_json").alias("s")).where(F.startswith("s", F.lit("OBJECT<"))).distinct()
    found = sorted({p for r in shapes.toLocalIterator() for p in _leaves(T._parse_datatype_string(r.s.replace("OBJECT<", "STRUCT<")))})
    path = lambda p: "$" + "".join(f"['{k}']" if "'" not in k else f'["{k}"]' for k in p)
    each = [F.struct(F.lit(".".join(p)).alias("metric"), F.try_variant_get("_json", path(p), "string").try_cast("double").alias("value")) for p in found]
    if not each:
        return parsed.select(*keep, F.lit("").alias("metric"), F.lit(0.0).alias("value")).limit(0)
    return parsed.select(*keep, F.inline(F.array(*each))).where("value is not null")


def read_marked_lines(spark: SparkSession, path: str, marker: str) -> DataFrame:
    """(line, value): the last comma-separated cell, as a number, of lines that hold the marker."""
    lines = spark.read.text(path).where(F.col("value").contains(marker))
    return lines.select(F.col("value").alias("line"), F.trim(F.element_at(F.split("value", ","), -1)).try_cast("double").alias("number"))


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """scale|name|seed|args lines; comments and blank lines go."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)"))
    p = F.split("value", r"\|", 4)
    return lines.select(F.get(p, F.lit(0)).alias("scale"), F.get(p, F.lit(1)).alias("name"), F.get(p, F.lit(2)).try_cast("int").alias("seed"), F.get(p, F.lit(3)).alias("args"))


def log_metrics(lines: DataFrame, prefix: str, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """(kept columns, metric, number) of each prefix<name>:<number> in log lines."""
    found = lines.select(*keep, F.explode(F.regexp_extract_all(column, F.lit(rf"{prefix}[a-z0-9_]*:[0-9.]+"), F.lit(0))).alias("m"))
    return found.select(*keep, F.substring_index("m", ":", 1).alias("metric"), F.substring_index("m", ":", -1).try_cast("double").alias("number"))
