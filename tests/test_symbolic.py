"""Equality of answers in LaTeX."""

from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sluice.functions.grading import compute_score
from sluice.functions.symbolic import PRIME, equal, grade_symbolic

SAME = [
    (r"\frac{1}{2}", "0.5"), (r"\frac12", r"\dfrac{2}{4}"), (r"\frac{1}{\sqrt{2}}", r"\frac{\sqrt 2}{2}"), (r"\sqrt{8}", r"2\sqrt{2}"), (r"\sqrt{12}+\sqrt{27}", r"5\sqrt3"),
    (r"\sqrt[3]{54}", r"3\sqrt[3]{2}"), (r"8^{1/3}", "2"), (r"2^{-1}", "1/2"), (r"2^{x+1}", r"2\cdot 2^x"), ("4^{n}", "2^{2n}"), ("(x+1)^2", "x^2+2x+1"), (r"\frac{x^2-1}{x-1}", "x+1"),
    ("-x(1-x)", "x^2 - x"), (r"3\frac{1}{2}", "3.5"), (r"50\%", "50"), ("1,234,567", "1234567"), (r"5\text{ cm}", "5"), (r"90^\circ", "90"), ("x=7", "7"), (r"\$10", "10"), (r"\left(1,2\right)", "(1, 2)"),
    (r"\{1,2,3\}", r"\{3,1,2\}"), ("1 \\pm \\sqrt{5}", r"\{1-\sqrt5, 1+\sqrt5\}"), (r"(-\infty,\frac{3}{6}]", r"(-\infty, 0.5]"), (r"[0,1]\cup(2,3)", r"(2,3) \cup [0,1]"), (r"\text{Monday}", r"\text{monday}"),
    (r"2\pi r", r"r \cdot 2 \pi"), (r"\sin(x+1)+1", r"1+\sin(1+x)"), (r"i^2", "-1"), (r"\sqrt{-4}", "2i"), (r"(1+i)(1-i)", "2"), ("|-3|", "3"), ("2^{10}", "1024"), ("10^{100}/10^{99}", "10"), (r"\sqrt{2+\sqrt 3}", r"\frac{\sqrt{6}+\sqrt{2}}{2}"),
    ("--2", "2"), ("a_1+a_2", "a_2+a_1"), ("6 \\div 3", "2"), (r"x \in [1,2]", "[1,2]"), (".5", "0.50"), ("7.", "7"), (r"\frac{\frac{1}{2}}{3}", r"\frac16"), ("f(x)=x^2", "x^2"), ("5!", "5!"),
]
OTHER = [
    ("(1,2)", "[1,2)"), ("(1,2)", "(2,1)"), (r"\{1,2\}", r"\{1,2,2\}"), ("x+1", "x-1"), ("2^x", "x^2"), (r"\sqrt{2}", "1.41421356"), (r"\sin x", r"\cos x"), ("1,2", "12"), ("x", "y"), (r"\frac{1}{3}", "0.333"), (r"\text{yes}", r"\text{no}"),
    ("", ""), (None, "1"), ("1", None), ("1/0", "1/0"), ("x+", "x+"), ("((", "(("), ("\\undefined{3}", "\\undefined{3}"), ("3 4", "34"), ("{", "{"), ("(" * 4000, "(" * 4000), ("1,2", "(1,2)"), ("-1", "1"), ("5", "5x"), (r"\sqrt[0]{2}", r"\sqrt[0]{2}"),
]


@pytest.mark.parametrize("a,b", SAME)
def test_same(a, b):
    assert equal(a, b) and equal(b, a)


@pytest.mark.parametrize("a,b", OTHER)
def test_other(a, b):
    assert not equal(a, b) and not equal(b, a)


@settings(max_examples=300, deadline=None)
@given(st.fractions(-1000, 1000, max_denominator=10**12), st.fractions(-1000, 1000, max_denominator=10**12))
def test_rationals_as_exact_arithmetic_says(a, b):
    tex = lambda q: rf"{'-' if q < 0 else ''}\frac{{{abs(q.numerator)}}}{{{q.denominator}}}"
    assert equal(f"{tex(a)}+({tex(b)})", tex(a + b)) and equal(f"({tex(a)})({tex(b)})", tex(a * b))
    assert equal(tex(a), tex(b)) == (a == b)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-9, 9), min_size=1, max_size=6), st.lists(st.integers(-9, 9), min_size=1, max_size=6))
def test_products_of_polynomials(a, b):
    said = lambda c: "+".join(f"({k})x^{{{i}}}" for i, k in enumerate(c))
    product = [sum(a[i] * b[n - i] for i in range(len(a)) if 0 <= n - i < len(b)) for n in range(len(a) + len(b) - 1)]
    assert equal(f"({said(a)})({said(b)})", said(product))
    product[0] += 1
    assert not equal(f"({said(a)})({said(b)})", said(product))


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 500), st.integers(1, 500), st.integers(2, 7))
def test_roots(a, b, n):
    assert equal(rf"\sqrt{{{a}}}\cdot\sqrt{{{b}}}", rf"\sqrt{{{a * b}}}") and equal(rf"\sqrt{{\frac{{{a}}}{{{b}}}}}", rf"\frac{{\sqrt{{{a * b}}}}}{{{b}}}")
    if n in (2, 3, 4, 6):
        assert equal(rf"\sqrt[{n}]{{{a**n}}}", str(a))


@settings(max_examples=300, deadline=None)
@given(st.text("\\{}()[]0123456789xyi+-*/^_,.!|=< fracsqrtpm", max_size=40))
def test_nothing_raises(text):
    assert equal(text, text) in (True, False)


def test_the_field():
    assert PRIME % 24 == 5 and all(pow(a, PRIME - 1, PRIME) == 1 for a in (2, 3, 5, 7, 11, 13)) and Fraction(1, 3) == Fraction(2, 6)


@pytest.mark.parametrize(
    "said,truth,want",
    [
        (r"so \boxed{\frac{1}{\sqrt{2}}} it is", r"\frac{\sqrt{2}}{2}", 1),
        (r"first \boxed{1}, no: \boxed {\frac{2}{4}}", "0.5", 1),
        (r"first \boxed{0.5}, no: \boxed{\frac{1}{4}}", "0.5", 0),
        (r"\boxed{(x+1)^2}", "x^2+2x+1", 1),
        ("Answer: 1/2\nthanks", "0.5", 1),
        (r"\boxed{\frac{1}{2}", "0.5", 0),
        ("no answer", "0.5", 0),
        (r"\boxed{Paris}", "paris", 1),
        (r"\boxed{}", "", 0),
        (None, "1", 0),
        (r"\boxed{1}", None, 0),
    ],
)
def test_column(spark, said, truth, want):
    df = spark.createDataFrame([(said, truth)], "s string, t string")
    assert df.select(grade_symbolic(F.col("s"), F.col("t"))).first()[0] == want
    assert df.select(compute_score(F.lit("math"), F.col("s"), F.col("t"), grade_symbolic)["score"]).first()[0] == want
