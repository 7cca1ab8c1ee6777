"""Rule-based graders as column expressions; any failure to read an answer scores 0."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The markers of a final answer by task, in the order in which they are tried.
KK_MARKERS = ("final answer", "answer:", "conclusion", "therefore")
MCQ_MARKERS = ("final answer", "answer is:", "answer:", "the answer is", "correct option")
# Data sources by grader.
KK_SOURCES = ("kk_logic", "knights-and-knaves", "logic", "kk_logic_hard")
MCQ4_SOURCES = ("sciq", "science", "gpqa", "gpqa_diamond", "gpqa_main")
MCQ10_SOURCES = ("bbh_logical_deduction", "bbh_tracking", "zebra_logic_mc")
# Fixed value: how a role is said.
ROLE = r"(?i)\b([A-Z][a-zA-Z]+)\b\s+is\s+a\s+(knight|knave)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it and in whichever branches."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def answer_tail(text: Column, markers: tuple[str, ...]) -> Column:
    """The text from the last occurrence of the first marker that occurs, in any case; else the whole text."""

    def cut(low: Column) -> Column:
        tail = lambda m: F.when(F.contains(low, F.lit(m)), F.right(text, F.length(F.substring_index(low, m, -1)) + len(m)))
        return F.coalesce(*[tail(m) for m in markers], text)

    return let(F.lower(text), cut)


def roles(text: Column) -> Column:
    """Array of (name, role), lower-cased, in order of mention."""
    names, kinds = (F.regexp_extract_all(text, F.lit(ROLE), F.lit(i)) for i in (1, 2))
    return F.zip_with(names, kinds, lambda n, k: F.struct(F.lower(n).alias("name"), F.lower(k).alias("role")))


def _last_role(of: Column, name: Column) -> Column:
    return F.try_element_at(F.filter(of, lambda e: e["name"] == name), F.lit(-1))["role"]


def grade_kk(solution: Column, truth: Column) -> Column:
    """1 if the answer gives every person of the truth the right role; later mentions replace earlier ones."""

    def judge(want: Column, got: Column) -> Column:
        ok = F.forall(want, lambda e: F.coalesce(_last_role(got, e["name"]) == _last_role(want, e["name"]), F.lit(False)))
        return F.when((F.size(want) > 0) & ok, 1.0).otherwise(0.0)

    def read(said: Column) -> Column:
        got = let(roles(answer_tail(said, KK_MARKERS)), lambda tail: F.when(F.size(tail) > 0, tail).otherwise(roles(said)))
        return let(F.struct(roles(F.coalesce(truth, F.lit(""))).alias("want"), got.alias("got")), lambda x: judge(x["want"], x["got"]))

    return let(F.coalesce(solution, F.lit("")), read)


def grade_mcq(solution: Column, truth: Column, letters: str = "ABCD") -> Column:
    """1 if the last standalone option letter after the answer marker, or else of the whole text, is the truth's first letter."""
    want = F.upper(F.left(F.regexp_replace(F.coalesce(truth, F.lit("")), r"^\s+", ""), F.lit(1)))
    rx = F.lit(rf"\b([{letters[0]}-{letters[-1]}])\b")
    last = lambda t: F.try_element_at(F.regexp_extract_all(t, rx, F.lit(1)), F.lit(-1))
    got = let(F.coalesce(solution, F.lit("")), lambda said: F.coalesce(last(answer_tail(said, MCQ_MARKERS)), last(said)))
    return let(want, lambda w: F.when((w != "") & F.contains(F.lit(letters), w) & F.coalesce(got == w, F.lit(False)), 1.0).otherwise(0.0))


def boxed(text: Column) -> Column:
    """The last \\boxed{...} without nested braces, else the text after the last "answer:", trimmed; null if neither."""
    box = F.try_element_at(F.regexp_extract_all(text, F.lit(r"\\boxed\{([^{}]*)\}"), F.lit(1)), F.lit(-1))
    after = F.regexp_extract(text, r"(?is).*answer:\s*([^\n]*)", 1)
    return let(F.trim(F.coalesce(F.nullif(box, F.lit("")), after)), lambda x: F.nullif(x, F.lit("")))


def _clean(x: Column) -> Column:
    """Without blanks, dollar signs, thousands commas and a final period."""
    return F.regexp_replace(F.regexp_replace(F.lower(x), r"[\s$]|(?<=\d),(?=\d{3})", ""), r"\.$", "")


def grade_math(solution: Column, truth: Column) -> Column:
    """1 if the final answers agree as numbers, or as text without blanks, dollar signs, thousands commas and a final period."""

    def judge(x: Column) -> Column:
        same = (x["got"] == x["want"]) | (F.abs(x["got"].try_cast("double") - x["want"].try_cast("double")) < 1e-9)
        return F.when(F.coalesce(same, F.lit(False)) & (x["want"] != ""), 1.0).otherwise(0.0)

    said = let(F.coalesce(solution, F.lit("")), boxed)
    return let(F.struct(_clean(said).alias("got"), _clean(F.coalesce(truth, F.lit(""))).alias("want")), judge)


def compute_score(source: Column, solution: Column, truth: Column, math: Callable[[Column, Column], Column] = grade_math) -> Column:
    """struct(score, acc, pred) by data source; ``math`` grades what no other grader takes (``symbolic.grade_symbolic`` reads formulas too)."""
    ten = "ABCDEFGHIJ"
    score = (
        F.when(source.isin(*KK_SOURCES), grade_kk(solution, truth))
        .when(source.isin(*MCQ4_SOURCES), grade_mcq(solution, truth))
        .when(source.startswith("mmlu_pro") | source.isin(*MCQ10_SOURCES), grade_mcq(solution, truth, ten))
        .otherwise(math(solution, truth))
    )
    return let(score, lambda x: F.struct(x.alias("score"), (x >= 1.0).alias("acc"), F.lit("").alias("pred")))


def safe_row(source: Column, solution: Column, truth: Column) -> Column:
    """struct(acc, score, resp_len) of a response; a null response has length 0."""
    size = F.coalesce(F.length(solution), F.lit(0)).alias("resp_len")
    return let(compute_score(source, solution, truth), lambda s: F.struct(s["acc"].cast("double").alias("acc"), s["score"].alias("score"), size))
