"""The driver's tables as the engine's relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: (orderkey, linenumber) isn't unique; rows that agree on all of these are interchangeable.
TIE = ("l_linenumber", "l_partkey", "l_suppkey", "resp_len", "l_extendedprice", "l_discount", "l_tax")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as responses: 16 steps, a prompt an order; one reward token, a mask as long as the quantity."""
    li = table(spark, sf_dir, "lineitem")
    reward = (F.col("l_discount") >= 0.05).cast("double")
    adv = F.col("l_extendedprice") / 1000 - F.col("l_quantity")
    return li.select(
        (F.col("l_orderkey") % 16).alias("step"),
        F.col("l_orderkey").alias("uid"),
        F.col("l_returnflag").alias("domain"),
        F.array(reward).alias("rm_scores"),
        F.array(adv).alias("advantages"),
        F.array_repeat(F.lit(1), F.col("l_quantity").cast("int")).alias("response_mask"),
        reward.alias("reward"),
        adv.alias("adv"),
        F.col("l_quantity").alias("resp_len"),
        *[c for c in TIE if c != "resp_len"],
    )


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as token arrays with a prefix mask; four steps."""
    e = table(spark, sf_dir, "embeddings")
    v = F.transform("embedding", lambda x: x.cast("double"))
    mask = F.transform("embedding", lambda x, i: (i < 1 + F.col("vec_id") % 64).cast("int"))
    return e.select("vec_id", (F.col("vec_id") % 4).alias("step"), F.col("label").alias("uid"), v.alias("advantages"), F.transform(v, lambda x: -F.abs(x)).alias("old_log_probs"), mask.alias("response_mask"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as domain observations in the order of (ts, event_id), a step a day."""
    e = table(spark, sf_dir, "events")
    day = F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date"))
    return e.select(day.alias("step"), F.struct("ts", "event_id").alias("row_id"), F.col("event_type").alias("domain"), "value", "event_id")


def prompt_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as waiting prompts: domain by priority, age by date."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("uid"), F.col("o_orderpriority").alias("domain"), F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date")).alias("step"), F.when(F.col("o_orderstatus") == "O", "finished").when(F.col("o_orderstatus") == "F", "failed").otherwise("running").alias("status"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as graded responses: puzzles, options and numbers with markers in several forms."""
    p = table(spark, sf_dir, "part")
    key, size = F.col("p_partkey"), F.col("p_size")
    kind = lambda c: F.when(c, "knight").otherwise("knave")
    truth = F.concat(F.lit("Al is a "), kind(key % 2 == 0), F.lit(", and Bo is a "), kind(key % 3 == 0), F.lit("."))
    said = F.concat(F.lit("Al is a "), kind(key % 2 == 0), F.lit(", BO is a "), kind(size % 3 == 0))
    kk = F.when(size % 5 == 0, F.concat(F.lit("Al is a knave. Final answer: "), said)).when(size % 5 == 1, F.concat(F.lit("Bo is a knight, Therefore "), said)).when(size % 5 == 2, F.concat(said, F.lit(" so the answer: none"))).when(size % 5 == 3, F.lit("no idea")).otherwise(F.concat(said, F.lit(". al is a KNIGHT")))
    letter = lambda x, n, s: F.substr(F.lit(s), (x % n + 1).cast("int"), F.lit(1))
    price = F.floor("p_retailprice").cast("long")
    mcq = lambda n, s: F.when(size % 5 == 0, F.concat(F.lit("A guess. The answer is: ("), letter(price, n, s), F.lit(")"))).when(size % 5 == 1, F.concat(F.lit("Answer: B then final answer "), letter(price, n, s))).when(size % 5 == 2, F.concat(letter(price, n, s), F.lit(" it is; correct option unclear"))).when(size % 5 == 3, F.lit("no letter")).otherwise(F.concat(F.lit("the ANSWER IS "), letter(price, n, s), F.lit(" or "), letter(key, n, s)))
    math = F.when(size % 3 == 0, F.concat(F.lit("so \\boxed{"), price.cast("string"), F.lit("}"))).when(size % 3 == 1, F.concat(F.lit("Answer: "), price.cast("string"), F.lit(".0"))).otherwise(F.lit("unclear"))
    ten = "ABCDEFGHIJ"
    return p.select("p_partkey", "p_size", truth.alias("kk_truth"), kk.alias("kk"), letter(key, 4, "ABCD").alias("t4"), mcq(4, "ABCD").alias("s4"), letter(key, 10, ten).alias("t10"), mcq(10, ten).alias("s10"), F.concat((price - F.when(key % 4 == 0, 1).otherwise(0)).cast("string")).alias("m_truth"), math.alias("math"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders with their lines as runs: (scale, method, seed, benchmark, acc)."""
    o, li, p = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "part"))
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(p.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    run = j.groupBy(F.col("o_orderstatus").alias("scale"), F.col("o_orderpriority").alias("method"), F.year("o_orderdate").alias("seed"), F.col("p_brand").alias("benchmark"))
    return run.agg(F.avg((F.col("l_discount") >= 0.05).cast("double")).alias("acc"))
