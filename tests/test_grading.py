import pytest
from pyspark.sql import functions as F

from sluice.functions import grading as g

TRUTH = "Al is a knight, and Bo is a knight."


def run(spark, f, solution, truth, *a):
    df = spark.createDataFrame([(solution, truth)], "s string, t string")
    return df.select(f(F.col("s"), F.col("t"), *a)).first()[0]


@pytest.mark.parametrize(
    "solution,truth,want",
    [
        ("Final answer: Al is a knave, bo is a Knight, AL is a knight", TRUTH, 1),
        ("Final answer: Al is a knave, bo is a Knight", TRUTH, 0),
        ("Al is a knight and Bo is a knight. Therefore: none", TRUTH, 1),
        ("Al is a knight, Bo is a knight, Zed is a knave", TRUTH, 1),
        ("Al is a knight", TRUTH, 0),
        ("anything", "no roles", 0),
        (None, TRUTH, 0),
        ("x", None, 0),
    ],
)
def test_kk(spark, solution, truth, want):
    assert run(spark, g.grade_kk, solution, truth) == want


@pytest.mark.parametrize(
    "solution,truth,letters,want",
    [
        ("blah A. The answer is: (C)", "C", "ABCD", 1),
        ("Answer: B then final answer D", "D", "ABCD", 1),
        ("no letter", "A", "ABCD", 0),
        ("E", "E", "ABCD", 0),
        ("E", "E", "ABCDEFGHIJ", 1),
        ("C. the answer is unclear", " c", "ABCD", 1),
        (None, "A", "ABCD", 0),
        ("A", None, "ABCD", 0),
    ],
)
def test_mcq(spark, solution, truth, letters, want):
    assert run(spark, g.grade_mcq, solution, truth, letters) == want


@pytest.mark.parametrize("solution,truth,want", [(r"so \boxed{1,234}", "1234", 1), ("Answer: 3.0", "3", 1), (r"\boxed{x} \boxed{y}", "y", 1), ("none", "3", 0), (None, "3", 0)])
def test_math(spark, solution, truth, want):
    assert run(spark, g.grade_math, solution, truth) == want


def test_dispatch(spark):
    rows = [("kk_logic", TRUTH, TRUTH), ("gpqa", "C", "C"), ("mmlu_pro_x", "J", "J"), ("bbh_tracking", "G", "G"), ("other", "Answer: 7", "7"), ("sciq", "J", "J")]
    df = spark.createDataFrame(rows, "d string, s string, t string")
    assert [r[0] for r in df.select(g.compute_score(F.col("d"), F.col("s"), F.col("t"))["score"]).collect()] == [1, 1, 1, 1, 1, 0]
    row = df.limit(1).select(g.safe_row(F.col("d"), F.col("s"), F.col("t")).alias("r")).first().r
    assert (row.acc, row.resp_len) == (1.0, len(TRUTH))
