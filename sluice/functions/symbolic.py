"""Equality of mathematical answers: LaTeX is parsed and two answers are compared by values at random points of a prime field.

Two different rational functions agree at a random point of a field of 2^61 elements with a chance of about their degree
over 2^61, so agreement at three points counts as equality, and no algebra system is needed. The field has unique cube
roots and a root of -1 (fractions over the prime itself have no value). Roots of positive rationals are products of the roots of their primes, so that sqrt(8) is
2 sqrt(2). Functions such as sin are drawn from a hash of their argument's value. Lists, sets and intervals are
compared part by part. What can't be read equals nothing.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass
from fractions import Fraction
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ..session import ship_package
from .grading import _clean, boxed, let

#: A prime that leaves 5 when divided by 24: unique cube roots, -1 a square and 2 not one, so that with a root of 2 beside it every number has a root.
PRIME = 2305843009213693613
POINTS, TRIES = 3, 40
#: Exact powers are kept up to this exponent, others only as field elements.
EXACT = 64
FUNCTIONS = ("sin", "cos", "tan", "cot", "sec", "csc", "arcsin", "arccos", "arctan", "ln", "log", "exp")
CONSTANTS = ("pi", "theta", "alpha", "beta", "gamma", "lambda", "mu", "phi", "omega", "infty", "emptyset", "varnothing")
TOKEN = re.compile(r"\\[a-zA-Z]+|\\.|\d+(?:\.\d+)?|\.\d+|[a-zA-Z]|[^\s]")


class Unreadable(ValueError):
    """An answer outside the grammar."""


class NoValue(ArithmeticError):
    """No value at this point, such as a root that the field lacks."""


#: x + y sqrt(2), x and y modulo PRIME.
Pair = tuple[int, int]
#: Exponents count modulo the order of that field's units.
ORDER = PRIME * PRIME - 1


def _mul(a: Pair, b: Pair) -> Pair:
    return (a[0] * b[0] + 2 * a[1] * b[1]) % PRIME, (a[0] * b[1] + a[1] * b[0]) % PRIME


def _inverse(a: Pair) -> Pair:
    n = (a[0] * a[0] - 2 * a[1] * a[1]) % PRIME
    if n == 0:
        raise NoValue
    n = pow(n, -1, PRIME)
    return a[0] * n % PRIME, -a[1] * n % PRIME


def _pow(a: Pair, n: int) -> Pair:
    if not a[1]:
        return pow(a[0], n, PRIME), 0
    out = (1, 0)
    while n:
        if n & 1:
            out = _mul(out, a)
        a, n = _mul(a, a), n >> 1
    return out


@dataclass(frozen=True)
class Value:
    """A field element; as an exponent (modulo ORDER) where it is made of integers and letters; and exactly where it is a rational."""

    v: Pair
    w: int | None = None
    q: Fraction | None = None


def _number(q: Fraction) -> Value:
    if q.denominator % PRIME == 0:
        raise NoValue
    return Value((q.numerator * pow(q.denominator, -1, PRIME) % PRIME, 0), q.numerator % ORDER if q.denominator == 1 else None, q)


def _drawn(seed: int, *parts: object) -> int:
    x = repr((seed, *parts)).encode()
    return (zlib.crc32(x) << 32 | zlib.crc32(b"~" + x)) * 0x9E3779B97F4A7C15 % PRIME


def _is_square(v: int) -> bool:
    return v == 0 or pow(v, (PRIME - 1) // 2, PRIME) == 1


def _root_of_square(v: int) -> int:
    r = pow(v, (PRIME + 3) // 8, PRIME)
    if r * r % PRIME != v:
        r = r * pow(2, (PRIME - 1) // 4, PRIME) % PRIME
    return min(r, PRIME - r)


def _square_root(v: Pair) -> Pair:
    """A square root; numbers without sqrt(2) all have one, of the rest half."""
    x, y = v
    half = (PRIME + 1) // 2
    if not y:
        return (_root_of_square(x), 0) if _is_square(x) else (0, _root_of_square(x * half % PRIME))
    n = (x * x - 2 * y * y) % PRIME
    if not _is_square(n):
        raise NoValue
    n = _root_of_square(n)
    t = next(t for t in ((x + n) * half % PRIME, (x - n) * half % PRIME) if _is_square(t))
    t = _root_of_square(t)
    if t == 0:
        raise NoValue
    return t, y * half * pow(t, -1, PRIME) % PRIME


def _prime_parts(n: int) -> list[tuple[int, int]]:
    """(factor, times); what is left after small primes counts as one."""
    out, p = [], 2
    while p * p <= n and p < 5000:
        k = 0
        while n % p == 0:
            n, k = n // p, k + 1
        if k:
            out.append((p, k))
        p += 1
    return [*out, (n, 1)] if n > 1 else out


class Point:
    """Values of letters, and arithmetic, at one random point."""

    def __init__(self, seed: int):
        self.seed = seed

    def letter(self, name: str) -> Value:
        if name == "i":
            return Value((_root_of_square(PRIME - 1), 0))
        x = _drawn(self.seed, "letter", name)
        return Value((x, 0), x)

    def add(self, a: Value, b: Value, sign: int = 1) -> Value:
        w = None if a.w is None or b.w is None else (a.w + sign * b.w) % ORDER
        v = (a.v[0] + sign * b.v[0]) % PRIME, (a.v[1] + sign * b.v[1]) % PRIME
        return Value(v, w, None if a.q is None or b.q is None else a.q + sign * b.q)

    def times(self, a: Value, b: Value) -> Value:
        w = None if a.w is None or b.w is None else a.w * b.w % ORDER
        return Value(_mul(a.v, b.v), w, None if a.q is None or b.q is None else a.q * b.q)

    def over(self, a: Value, b: Value) -> Value:
        if a.q is not None and b.q:
            return _number(a.q / b.q)
        return Value(_mul(a.v, _inverse(b.v)))

    def root(self, a: Value, n: int) -> Value:
        if n % 2 == 0:
            half = self.root(a, 2) if n > 2 else a
            if n > 2:
                return self.root(half, n // 2)
            if a.q is None:
                return Value(_square_root(a.v))
            if a.q < 0:
                return self.times(self.letter("i"), self.root(_number(-a.q), 2))
            if a.q == 0:
                return a
            whole, rest = Fraction(1, a.q.denominator), (1, 0)
            for p, k in _prime_parts(a.q.numerator * a.q.denominator):
                whole *= p ** (k // 2)
                if k % 2:
                    rest = _mul(rest, _square_root((p % PRIME, 0)))
            whole = _number(whole)
            return whole if rest == (1, 0) else Value(_mul(whole.v, rest))
        if a.v[1] or math.gcd(n, PRIME - 1) > 1:
            raise NoValue
        return Value((pow(a.v[0], pow(n, -1, PRIME - 1), PRIME), 0), q=self._exact_root(a.q, n))

    @staticmethod
    def _exact_root(q: Fraction | None, n: int) -> Fraction | None:
        if q is None:
            return None
        near = lambda x: next((r for r in (round(abs(x) ** (1 / n)) + d for d in (-1, 0, 1)) if r >= 0 and r**n == abs(x)), None) if abs(x) < 1 << 200 else None
        a, b = near(q.numerator), near(q.denominator)
        return None if a is None or b is None else Fraction(a, b) * (-1 if q < 0 else 1)

    def power(self, a: Value, b: Value) -> Value:
        if b.q is not None and b.q.denominator == 1:
            n = b.q.numerator
            if n < 0:
                return self.over(_number(Fraction(1)), self.power(a, _number(Fraction(-n))))
            exact = a.q**n if a.q is not None and n <= EXACT else None
            return Value(_pow(a.v, n), None if a.w is None else pow(a.w, n, ORDER), exact)
        if b.q is not None:
            return self.power(self.root(a, b.q.denominator), _number(Fraction(b.q.numerator)))
        if b.w is not None:
            return Value(_pow(a.v, b.w))
        return Value((_drawn(self.seed, "power", a.v, b.v), 0))

    def call(self, name: str, a: Value) -> Value:
        return Value((_drawn(self.seed, name, a.v), 0))


class Reader:
    """Recursive descent over the tokens of one answer; an expression is a function of a point."""

    def __init__(self, text: str):
        self.tokens = TOKEN.findall(text)
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, *any_of: str) -> str:
        t = self.peek()
        if not t or any_of and t not in any_of:
            raise Unreadable(t)
        self.at += 1
        return t

    def sum(self):
        sign = 1
        while self.peek() in ("+", "-"):
            sign = -sign if self.take() == "-" else sign
        out = self.product()
        if sign < 0:
            out = lambda p, x=out: p.times(_number(Fraction(-1)), x(p))
        while self.peek() in ("+", "-"):
            s, y = (1 if self.take() == "+" else -1), self.product()
            out = lambda p, x=out, y=y, s=s: p.add(x(p), y(p), s)
        return out

    def product(self):
        out = self.factor()
        while t := self.peek():
            if t in ("*", "\\cdot", "\\times", "/", "\\div", ":"):
                self.take()
                y = self.signed()
                over = t in ("/", "\\div", ":")
                out = (lambda p, x=out, y=y: p.over(x(p), y(p))) if over else (lambda p, x=out, y=y: p.times(x(p), y(p)))
            elif t in ("(", "{", "|", "\\frac", "\\sqrt") or t.isalnum() or t[1:] in FUNCTIONS + CONSTANTS:
                if t == "|" and self.tokens[: self.at].count("|") % 2:
                    break
                if t[0].isdigit() and self.tokens[self.at - 1][0].isdigit():
                    raise Unreadable("two numbers")
                y = self.factor()
                out = lambda p, x=out, y=y: p.times(x(p), y(p))
            else:
                break
        return out

    def signed(self):
        if self.peek() in ("+", "-"):
            s, y = self.take(), self.signed()
            return (lambda p: p.times(_number(Fraction(-1)), y(p))) if s == "-" else y
        return self.factor()

    def factor(self):
        out = self.atom()
        while self.peek() in ("^", "!"):
            if self.take() == "!":
                out = lambda p, x=out: p.call("factorial", x(p))
                continue
            y = self.signed() if self.peek() in ("+", "-") else self.atom(True)
            out = lambda p, x=out, y=y: p.power(x(p), y(p))
        return out

    def group(self, close: str):
        out = self.sum()
        self.take(close)
        return out

    def argument(self):
        """{...}, or one token, of which a number gives its first digit (\\frac12)."""
        if self.peek() == "{":
            self.take()
            return self.group("}")
        t = self.peek()
        if t.isdigit() and len(t) > 1:
            self.tokens[self.at] = t[1:]
            return lambda p: _number(Fraction(t[0]))
        return self.atom()

    def atom(self, exponent: bool = False):
        t = self.peek()
        if exponent and t.isdigit():
            return self.argument()
        self.take()
        if t[0].isdigit() or t[0] == ".":
            q = Fraction("0" + t if t[0] == "." else t)
            if t.isdigit() and self.peek() == "\\frac" and not exponent:  # a mixed number
                y = self.atom()
                return lambda p: p.add(_number(q), y(p))
            return lambda p: _number(q)
        if t in ("(", "{"):
            return self.group({"(": ")", "{": "}"}[t])
        if t == "|":
            x = self.group("|")
            return lambda p: p.root(p.power(x(p), _number(Fraction(2))), 2)
        if t == "\\frac":
            a, b = self.argument(), self.argument()
            return lambda p: p.over(a(p), b(p))
        if t == "\\sqrt":
            n = _number(Fraction(2))
            if self.peek() == "[":
                self.take()
                n = self.group("]")(Point(0))
            if n.q is None or n.q.denominator != 1 or not 2 <= n.q <= 99:
                raise Unreadable(t)
            x = self.argument()
            return lambda p: p.root(x(p), int(n.q))
        name = t.removeprefix("\\")
        if name in FUNCTIONS:
            k = None
            if self.peek() in ("^", "_"):
                k = self.take() + "".join(self.tokens[self.at : self.at + 1])
                if self.peek() == "{":
                    raise Unreadable(k)
                self.take()
            x = self.factor()
            return lambda p: p.call(name + (k or ""), x(p))
        if name in CONSTANTS or len(t) == 1 and t.isalpha():
            if self.peek() == "_":
                self.take()
                name += "_" + (self.take() if self.peek() != "{" else "".join(iter(lambda: self.take(), "}")))
            return lambda p: p.letter(name)
        raise Unreadable(t)


#: Spellings that mean the same or nothing (fixed values of the notation).
SAME = (("\\dfrac", "\\frac"), ("\\tfrac", "\\frac"), ("\\cfrac", "\\frac"), ("\\left", ""), ("\\right", ""), ("\\displaystyle", ""), ("\\lbrack", "["), ("\\rbrack", "]"), ("\\%", ""), ("%", ""), ("^{\\circ}", ""), ("^\\circ", ""), ("\\degree", ""), ("\\$", ""), ("$", ""), ("−", "-"), ("π", "\\pi "), ("∞", "\\infty "), ("√", "\\sqrt "), ("\\leq", "\\le"), ("\\geq", "\\ge"), ("**", "^"))
BLANKS = re.compile(r"\\[,;:!> ]|\\q?quad|~|\s+")
WORDS = re.compile(r"\\(?:text|mathrm|textrm|mbox|operatorname)\s*\{([^{}]*)\}")
THOUSANDS = re.compile(r"(?<![\d.,])\d{1,3}(?:,\d{3})+(?![\d,])")
EQUATION = re.compile(r"^[a-zA-Z](?:_\w|\([a-z]\))?\s*(?:=|\\in(?![a-z]))")


def _split(text: str, mark: str = ",") -> list[str]:
    """Parts between marks outside all brackets."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "({[") - (c in ")}]")
        if c == mark and depth <= 0:
            out.append(text[start:i])
            start = i + 1
    return [*out, text[start:]]


def read(text: str):
    """An answer as (kind, parts); raises Unreadable."""
    for a, b in SAME:
        text = text.replace(a, b)
    text = text.strip().rstrip(".").strip()
    bare = WORDS.sub(" ", text)  # units and remarks
    if WORDS.search(text) and not re.search(r"[0-9a-zA-Z\\]", bare):
        return "word", " ".join(WORDS.sub(r"\1", text).lower().split())
    text = BLANKS.sub(" ", EQUATION.sub("", bare.strip())).strip()
    return _form(THOUSANDS.sub(lambda m: m[0].replace(",", ""), text) if text[:1] not in "([" and text[:2] != "\\{" else text)


def _form(text: str):
    if "\\cup" in text:
        return "union", [_form(x.strip()) for x in text.split("\\cup")]
    if text[:2] == "\\{" and text[-2:] == "\\}":
        return "set", [_form(x.strip()) for x in _split(text[2:-2])] if text[2:-2].strip() else []
    parts = _split(text)
    if len(parts) > 1:
        return "list", [_form(x.strip()) for x in parts]
    if text[:1] in ("(", "[") and text[-1:] in (")", "]"):
        inner = _split(text[1:-1])
        if len(inner) > 1:
            return "span" + text[0] + text[-1], [_form(x.strip()) for x in inner]
    if "\\pm" in text and text.count("\\pm") == 1:
        return "set", [_form(text.replace("\\pm", s)) for s in "+-"]
    r = Reader(text)
    out = r.sum()
    if r.peek():
        raise Unreadable(r.peek())
    return "value", out


def _agree(a, b) -> bool:
    if a[0] != b[0] or a[0] != "value" and a[0] != "word" and len(a[1]) != len(b[1]):
        return False
    if a[0] == "word":
        return a[1] == b[1]
    if a[0] == "value":
        met = 0
        for seed in range(1, TRIES):
            try:
                x, y = (e[1](Point(seed)) for e in (a, b))
            except NoValue:
                continue
            if x.v != y.v:
                return False
            met += 1
            if met == POINTS:
                return True
        return False
    if a[0] in ("set", "union"):  # in any order
        rest = list(b[1])
        for x in a[1]:
            hit = next((i for i, y in enumerate(rest) if _agree(x, y)), None)
            if hit is None:
                return False
            del rest[hit]
        return True
    return all(map(_agree, a[1], b[1]))


def equal(a: str | None, b: str | None) -> bool:
    """Whether two answers in LaTeX or plain notation are equal; what can't be read equals nothing."""
    if not a or not b:
        return False
    try:
        return _agree(read(a), read(b))
    except (ValueError, ArithmeticError, RecursionError):
        return False


#: Responses to a prompt repeat its truth and one another's answers: pairs of texts that a worker keeps the verdict of, and their characters at most.
MEMO, LONG = 1 << 16, 200
_kept = lru_cache(MEMO)(equal)


def _known(a: str | None, b: str) -> bool:
    return _kept(a, b) if a is not None and len(a) + len(b) <= LONG else equal(a, b)


def _braced(text: str) -> str | None:
    """What stands between the first brace and the one that closes it."""
    depth = 0
    for i, c in enumerate(text):
        depth += (c == "{") - (c == "}")
        if depth == 0:
            return text[1:i] if text[:1] == "{" else None
    return None


@F.arrow_udf(BooleanType())
def _same(boxes: pa.Array, plain: pa.Array, wants: pa.Array) -> pa.Array:
    rows = zip(boxes.to_pylist(), plain.to_pylist(), wants.to_pylist())
    return pa.array([w is not None and _known(_braced(x.lstrip()) if x is not None else p, w) for x, p, w in rows], pa.bool_())


def grade_symbolic(solution: Column, truth: Column) -> Column:
    """1 if the last boxed answer, with braces of any depth, or else the text after the last "answer:", equals the truth as text, number or mathematics.

    Rows that agree as text or number never leave the JVM with more than nulls.
    """
    ship_package(SparkSession.active())
    said, mark = F.coalesce(solution, F.lit("")), "\\boxed"
    box = F.when(F.contains(said, F.lit(mark)), F.substring_index(said, mark, -1))
    plain = F.when(box.isNull(), boxed(said))
    simple = let(F.struct(_clean(boxed(said)).alias("got"), _clean(F.coalesce(truth, F.lit(""))).alias("want")), lambda x: F.coalesce((x["want"] != "") & (x["got"] == x["want"]), F.lit(False)))
    simple = simple & (box.isNull() | F.coalesce(F.regexp_like(box, F.lit(r"^\s*\{[^{}]*\}")), F.lit(False)))
    hard = lambda c: F.when(~simple, c)
    return F.when(simple | F.coalesce(_same(hard(box), hard(plain), hard(truth)), F.lit(False)), 1.0).otherwise(0.0)
