"""Building of training and evaluation sets: records, prompts, options, labels by length, exclusions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import Scratch, final
from .ranges import in_ranges, ranked


def record(data_source: Column, prompt: Column, truth: Column, ability: Column, domain: Column, extra: Column) -> list[Column]:
    """The columns of a dataset row; ``extra`` is a map, so rows of different domains union cleanly."""
    return [
        data_source.alias("data_source"),
        F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content"))).alias("prompt"),
        ability.alias("ability"),
        F.struct(F.lit("rule").alias("style"), truth.alias("ground_truth")).alias("reward_model"),
        extra.alias("extra_info"),
        domain.alias("domain"),
    ]


def first_content(prompt: str = "prompt") -> Column:
    return F.get(prompt, F.lit(0))["content"]


def strip_tail(text: Column, marker: str, instruction: str) -> Column:
    """The text before the marker without trailing white space (whole if there is no marker), a blank line, the instruction."""
    cut = F.when(F.instr(text, marker) > 0, F.regexp_replace(F.substring_index(text, marker, 1), r"\s+$", "")).otherwise(text)
    return F.concat(cut, F.lit("\n\n"), F.lit(instruction))


def length_label(df: DataFrame, text: str, name: str = "domain") -> DataFrame:
    """"short" up to the exact median length, else "long"; the median is one row, joined back."""
    med = df.agg(F.median(F.length(text)).alias("_med"))
    return df.crossJoin(F.broadcast(med)).withColumn(name, F.when(F.length(text) <= F.col("_med"), "short").otherwise("long")).drop("_med")


def option_lines(options: Column, letters: str = "ABCDEFGHIJ", missing: str = "N/A") -> Column:
    """"A. x" lines; missing options go but the others keep their letters."""
    labelled = F.transform(options, lambda o, i: F.when(o != missing, F.concat(F.substr(F.lit(letters), i + 1, F.lit(1)), F.lit(". "), o)))
    return F.array_join(F.filter(labelled, lambda x: x.isNotNull()), "\n")


def shuffled_options(options: Column, key: Column, seed: int = 0) -> Column:
    """The options (first one correct) in an order fixed by key and seed: struct(options, letter)."""
    order = F.transform(options, lambda o, i: F.struct(F.pmod((key * 31 + i * 17 + seed) * F.lit(2654435761), F.lit(4294967296)).alias("h"), i.alias("i"), o.alias("o")))
    s = F.array_sort(order)
    at = F.array_position(F.transform(s, lambda e: e["i"]), 0)
    return F.struct(F.transform(s, lambda e: e["o"]).alias("options"), F.substr(F.lit("ABCDEFGHIJ"), at.cast("int"), F.lit(1)).alias("letter"))


def bracket_letter(target: Column) -> Column:
    """"(A)" to "A"; anything else trimmed."""
    t = F.trim(target)
    m = F.regexp_extract(t, r"^\(([A-Z])\)$", 1)
    return F.when(m != "", m).otherwise(t)


def choice_letter(choices: Column, answer: Column, letters: str = "ABCDEFGHIJ") -> Column:
    """The letter of the answer among the choices, the answer itself if it is a letter, else "?"."""
    at = F.array_position(choices, answer)
    own = (F.length(answer) == 1) & F.lit(letters).contains(answer)
    return F.when(at > 0, F.substr(F.lit(letters), at.cast("int"), F.lit(1))).when(own, answer).otherwise("?")


def without(df: DataFrame, other: DataFrame, on: str) -> DataFrame:
    """Rows of ``df`` whose text key isn't in ``other``."""
    return df.join(other.select(F.col(on).cast("string").alias(on)), on, "left_anti")


def union_domains(*parts: DataFrame) -> DataFrame:
    """All rows of all parts by column name; a column that a part lacks is null there."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def union_distinct(*parts: DataFrame) -> DataFrame:
    """The distinct rows of all parts."""
    return union_domains(*parts).distinct()


def nested_prompts(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", most: int = 10_000) -> DataFrame:
    """(conv, prompt): the conversation's messages as one ordered array. The array is the record itself, so a conversation
    must fit a row; one of more than ``most`` messages is an error, not a silent cut. ``message_rows`` has no bound."""
    ranked = messages.withColumn("_n", F.row_number().over(Window.partitionBy(conv).orderBy(turn, "role", "text")))
    checked = ranked.withColumn("_n", F.when(F.col("_n") <= most, F.col("_n")).otherwise(F.raise_error(F.lit(f"a conversation of more than {most} messages"))))
    got = checked.groupBy(conv).agg(F.array_sort(F.collect_list(F.struct("_n", "role", F.col("text").alias("content")))).alias("_m"))
    return got.select(conv, F.transform("_m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("prompt"))


def message_rows(messages: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(conv, seq, role, content): the same order with one row a message, for conversations of any length; runs jobs of its own."""
    with Scratch(messages.sparkSession) as scratch:
        rows, ranges = in_ranges(messages.select(conv, turn, "role", "text"), [conv], [turn, "role", "text"], scratch)
        return final(ranked(rows, ranges, [conv]).select(conv, (F.col("_rank") - 1).alias("seq"), "role", F.col("text").alias("content")))


def parse_run(name: Column, strict: bool = False) -> Column:
    """struct(method, seed) of "method_s12"; null for other names, or an error if ``strict``."""
    rx = r"^(.+)_s(\d+)$"
    ok = name.rlike(rx)
    out = F.when(ok, F.struct(F.regexp_extract(name, rx, 1).alias("method"), F.regexp_extract(name, rx, 2).try_cast("int").alias("seed")))
    return out if not strict else F.when(ok, out).otherwise(F.raise_error(F.concat(F.lit("no method and seed in "), name)))


def lookup(code: Column, labels: dict[str, str]) -> Column:
    """The label of a code by a literal map; null for unknown codes."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]), code) if labels else F.lit(None).cast("string")


def number(text: Column) -> Column:
    """DOUBLE, or null for empty and unreadable text."""
    return F.nullif(F.trim(text.cast("string")), F.lit("")).try_cast("double")


def epochs(df: DataFrame, n: int) -> DataFrame:
    """``df`` n times over, with the number of the ``epoch`` from 0."""
    return df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))) if n > 0 else df.withColumn("epoch", F.lit(0)).limit(0)


def percent(df: DataFrame, *columns: str) -> DataFrame:
    """Shares as percentages."""
    return df.withColumns({c: F.col(c) * 100 for c in columns})


def where_equal(df: DataFrame, **wanted: object) -> DataFrame:
    """Equality filters; None is no filter."""
    for c, v in wanted.items():
        if v is not None:
            df = df.where(F.col(c) == F.lit(v))
    return df


def job_grid(scales: DataFrame, methods: DataFrame, seeds: DataFrame) -> DataFrame:
    """Every combination of three short lists, with the job line scale|name|seed."""
    out = scales.crossJoin(methods).crossJoin(seeds)
    return out.withColumn("job", F.concat_ws("|", "scale", F.concat("method", F.lit("_s"), F.col("seed").cast("string")), F.col("seed").cast("string")))
