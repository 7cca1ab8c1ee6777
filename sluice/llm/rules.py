"""Quality rules: fixed text statistics, and robust multivariate outliers.

Each text becomes a vector of transformed statistics. For each language and source the minimum covariance
determinant gives a centre and a scatter: of all subsets of three quarters of the rows, the one whose covariance has the
smallest determinant is sought by concentration steps from several fixed starts, all in one pass over the rows, until
no determinant falls further. The winner is reweighted over the rows that it finds near, and a row whose Mahalanobis
distance is beyond a chi-squared bound is rejected. Steps run over all rows: distances are counted, with their
moments, in narrow bins by group and start, so that the closest part of a group is a range of bins (of the last one a
fraction) and no group ever has to meet in one task.

Squares of fixed floors are added to every covariance, since most statistics are constant over clean text; a
concentration step lowers the determinant of such a regularised covariance as it does a plain one's.
"""

from __future__ import annotations

import functools
from collections import Counter
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .arrow import map_columns
from .common import Scratch, final

SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Spread below which a transformed statistic counts as constant: log words, log word length, and the angles
#: of symbols a word, repeated lines and repeated words.
FLOORS = (0.25, 0.06, 0.07, 0.2, 0.2)
P = len(FLOORS)


def counts(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the number of lines with a word."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    chars = len(b"".join(words).decode("utf-8", "surrogatepass"))
    lines = [x for x in raw.split(b"\n") if x.split(None, 1)] if b"\n" in raw else [raw] * (n > 0)
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        times, hit = Counter(windows), bytearray(n)
        for i, w in enumerate(windows):
            if times[w] > 1:
                hit[i] = hit[i + 1] = hit[i + 2] = 1
        repeated = sum(hit)
    return n, chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines)


def statistics(docs: DataFrame, *, text: str = "text", key: str = "doc_id", by: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """(id, by..., the five counts, n_lines, x1 to x5) of every whole text."""
    kind = docs.schema[key].dataType.simpleString()

    def run(keys: list, texts: list, *groups: list) -> dict:
        got = np.array([counts(t) for t in texts], np.int64).reshape(-1, 6)
        n = np.maximum(got[:, 0], 1)
        angle = lambda part, whole: np.arcsin(np.sqrt(np.minimum(1.0, part / np.maximum(whole, 1))))
        xs = (np.log(n), np.log(np.maximum(got[:, 1], 1) / n), angle(got[:, 2], 2 * n), angle(got[:, 3], got[:, 5]), angle(got[:, 4], n))
        out = {"id": keys} | {f"g{i}": g for i, g in enumerate(groups)}
        out |= {c: got[:, i] for i, c in enumerate((*COUNTS, "n_lines"))}
        return out | {f"x{i}": x for i, x in enumerate(xs)}

    cols = [F.col(c).cast("string") for c in by]
    fields = [f"id {kind}", *(f"g{i} string" for i in range(len(by))), *(f"{c} long" for c in (*COUNTS, "n_lines")), *(f"x{i} double" for i in range(P))]
    return map_columns(docs, [key, text, *cols], run, ", ".join(fields))


def chi2_quantile(share: float, freedom: int = P) -> float:
    """By Wilson and Hilferty's approximation."""
    a = 2 / (9 * freedom)
    return freedom * (1 - a + NormalDist().inv_cdf(share) * a**0.5) ** 3


def _xs() -> list[Column]:
    return [F.col(f"x{i}") for i in range(P)]


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


_PAIRS = [(i, j) for i in range(P) for j in range(i, P)]


def _distance() -> Column:
    """Squared Mahalanobis distance of x0.. from mu with inverse scatter inv."""
    c = [x - F.col("mu")[i] for i, x in enumerate(_xs())]
    return sum(((1 if i == j else 2) * F.col("inv")[i * P + j] * c[i] * c[j] for i, j in _PAIRS), F.lit(0.0))


def chi2_share(x: float, freedom: int = P) -> float:
    """The share of a chi-squared distribution below x, by the same approximation."""
    a = 2 / (9 * freedom)
    return NormalDist().cdf(((x / freedom) ** (1 / 3) - (1 - a)) / a**0.5)


def _matrix(upper) -> np.ndarray:
    c = np.zeros((P, P))
    for (i, j), v in zip(_PAIRS, upper):
        c[i, j] = c[j, i] = v
    return c


def _form(key, start, mu, scatter, reach) -> tuple:
    return key, start, mu, np.linalg.inv(scatter).ravel(), float(np.linalg.slogdet(scatter)[1]), reach


FORM = "key string, start int, mu array<double>, inv array<double>, det double, reach double"


def _rows(got: list[tuple]) -> dict:
    return dict(zip(("key", "start", "mu", "inv", "det", "reach"), zip(*got))) if got else {c.split()[0]: [] for c in FORM.split(", ")}


def _solve(moments: DataFrame, inflate: float = 1.0) -> DataFrame:
    """FORM from a row of sums for each key and start; det is the logarithm of the determinant."""

    def run(keys: list, starts: list, ns: list, sums: list, products: list, reach: list) -> dict:
        out = []
        for k, t, n, s, q, r in zip(keys, starts, ns, sums, products, reach):
            mu = np.array(s) / n
            out.append(_form(k, t, mu, inflate * (_matrix(q) / n - np.outer(mu, mu)) + np.diag(np.square(FLOORS)), r))
        return _rows(out)

    return map_columns(moments, ["key", "start", "n", "s", "q", "reach"], run, FORM)


def _sums(weight: Column) -> list[Column]:
    s = F.array(*[F.sum(weight * F.col(f"s{i}")) for i in range(P)]).alias("s")
    return [F.sum(weight * F.col("n")).alias("n"), s, F.array(*[F.sum(weight * F.col(f"q{i}{j}")) for i, j in _PAIRS]).alias("q")]


#: Bins of squared distances an octave, and the smallest and largest bin.
FINE, LOW, HIGH = 8, -80, 240
#: Starts: scatters of medians and quartiles with no correlation, with that of the hyperbolic tangents, of the directions and
#: of the clipped values of standardised rows.
STARTS = 4


def starts(x: DataFrame) -> DataFrame:
    """FORM of every key's starts."""
    quart = x.groupBy("key").agg(*[F.percentile_approx(c, [0.25, 0.5, 0.75], 10_000).alias(f"p{i}") for i, c in enumerate(_xs())])
    scale = [F.sqrt(F.pow((F.col(f"p{i}")[2] - F.col(f"p{i}")[0]) / 1.349, 2) + f * f) for i, f in enumerate(FLOORS)]
    at = quart.select("key", *[F.col(f"p{i}")[1].alias(f"m{i}") for i in range(P)], *[c.alias(f"d{i}") for i, c in enumerate(scale)])
    z = x.join(at, "key").select("key", *[((c - F.col(f"m{i}")) / F.col(f"d{i}")).alias(f"z{i}") for i, c in enumerate(_xs())])
    size = F.sqrt(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(P)), F.lit(1e-12)))
    kinds = (F.tanh, lambda c: c / size, lambda c: F.greatest(F.lit(-1.5), F.least(F.lit(1.5), c)))
    sums = [F.array(*[F.sum(f(F.col(f"z{i}")) * f(F.col(f"z{j}"))) for i, j in _PAIRS]).alias(f"r{t}") for t, f in enumerate(kinds)]
    at = at.join(z.groupBy("key").agg(*sums), "key")

    def run(keys: list, ms: list, ds: list, *products: list) -> dict:
        out = []
        for k, m, d, *qs in zip(keys, ms, ds, *products):
            out.append(_form(k, 0, m, np.diag(np.square(d)), 0.0))
            for t, q in enumerate(qs):
                c = _matrix(q)
                e = np.sqrt(np.maximum(np.diag(c), 1e-12))
                r = 0.95 * c / np.outer(e, e)
                np.fill_diagonal(r, 1.0)
                out.append(_form(k, t + 1, m, r * np.outer(d, d), 0.0))
        return _rows(out)

    return map_columns(at, ["key", F.array(*[f"m{i}" for i in range(P)]), F.array(*[f"d{i}" for i in range(P)]), *[f"r{t}" for t in range(STARTS - 1)]], run, FORM)


def concentrate(x: DataFrame, at: DataFrame, share: float) -> DataFrame:
    """FORM after one step: mean and covariance of the ``share`` of each key's rows that are closest by ``at``; reach is the largest
    squared distance among them."""
    d = x.join(at, "key").withColumn("bin", F.least(F.greatest(F.floor(F.log2(_distance() + 1e-12) * FINE), F.lit(LOW)), F.lit(HIGH)))
    bins = d.groupBy("key", "start", "bin").agg(F.count("*").alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(_xs())], *[F.sum(_xs()[i] * _xs()[j]).alias(f"q{i}{j}") for i, j in _PAIRS])
    of = Window.partitionBy("key", "start")
    upto = of.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    want = F.ceil(share * F.sum("n").over(of)) - F.coalesce(F.sum("n").over(upto), F.lit(0))
    part = bins.withColumn("part", F.least(F.lit(1.0), want / F.col("n"))).where("part > 0")
    sums = part.groupBy("key", "start").agg(*_sums(F.col("part")), F.max(F.pow(F.lit(2.0), (F.col("bin") + F.col("part")) / F.lit(float(FINE)))).alias("reach"))
    return _solve(sums)


def _best(at: DataFrame, n: int) -> DataFrame:
    """Of each key the ``n`` starts with the smallest determinants; there are at most ``STARTS`` rows a key."""
    return at.withColumn("rk", F.row_number().over(Window.partitionBy("key").orderBy("det", "start"))).where(F.col("rk") <= n).drop("rk")


def estimates(x: DataFrame, scratch: Scratch, *, share: float = 0.75, most_rounds: int = 15) -> DataFrame:
    """FORM of the smallest determinant found for each key's rows x0 to x4.

    A round is two steps. All starts take one, then the two best of each key go on until a round lowers no determinant
    by a hundredth, or ``most_rounds``.
    """
    step = lambda at: concentrate(x, concentrate(x, at, share), share)
    first = scratch.keep(_best(step(scratch.keep(starts(x))), 2))
    seen, moving = [first], first
    for _ in range(most_rounds):
        was = moving.select("key", "start", F.col("det").alias("was"))
        moving = scratch.keep(step(moving).join(was, ["key", "start"]).where("det < was - 1e-2").drop("was"))
        if moving.isEmpty():
            break
        seen.append(moving)
    return scratch.keep(_best(functools.reduce(DataFrame.unionByName, seen), 1))


def reweighted(x: DataFrame, at: DataFrame, share: float, near: float = 0.975) -> DataFrame:
    """FORM of mean and covariance of the rows within the ``near`` bound of ``at``, made consistent for normal rows."""
    cut = chi2_quantile(near)
    d = x.join(at, "key").where(_distance() <= F.lit(cut) * stretch(share))
    sums = d.groupBy("key", "start").agg(F.count("*").alias("n"), F.array(*[F.sum(c) for c in _xs()]).alias("s"), F.array(*[F.sum(_xs()[i] * _xs()[j]) for i, j in _PAIRS]).alias("q"), F.lit(0.0).alias("reach"))
    return _solve(sums, near / chi2_share(cut, P + 2))


def stretch(share: float) -> Column:
    """By how much squared distances exceed those of normal rows: the largest within the subset over its chi-squared quantile, at least 1."""
    return F.greatest(F.lit(1.0), F.col("reach") / chi2_quantile(share))


def judge(docs: DataFrame, *, text: str = "text", key: str = "doc_id", by: tuple[str, str] = ("lang", "source"), least_rows: int = 50, share: float = 0.75, level: float = 0.9999) -> DataFrame:
    """(key, five counts, base_failed, distance, kept), one row a row of ``docs``.

    Rows that fail the fixed rules don't enter the estimates. A language and source with fewer than
    ``least_rows`` other rows is judged with its language's other small sources; where those are still too few, by
    its whole language, and else by all rows. Only where these are too few too is nothing more rejected, and the
    distance null. Null groups are groups of their own. Null and empty texts have no words and fail. Repeated rows
    count each and are judged alike; statistics that are constant in a group have the floors as their spread.
    """
    cut = chi2_quantile(level)
    with Scratch(docs.sparkSession) as scratch:
        rows = statistics(docs, text=text, key=key, by=by).withColumn("base_failed", base_failed())
        rows = scratch.keep(rows.withColumn("fine", F.to_json(F.struct("g0", "g1"))))
        # each group's own key, its language's small sources, its language, all: the first with enough rows judges it
        sized = rows.where("not base_failed").groupBy("fine", "g0").agg(F.count("*").alias("n"))
        small = F.col("n") < least_rows
        keys = F.array(F.col("fine"), F.when(small, F.concat(F.lit("small"), F.to_json(F.struct("g0")))), F.concat(F.lit("lang"), F.to_json(F.struct("g0"))), F.lit("all"))
        feeds = scratch.keep(sized.select("fine", "n", F.posexplode(keys).alias("rank", "key")).where("key is not null"))
        enough = feeds.groupBy("key").agg(F.sum("n").alias("m")).where(F.col("m") >= least_rows).select("key")
        name = scratch.keep(feeds.join(enough, "key").groupBy("fine").agg(F.min_by("key", "rank").alias("key")))
        feeds = feeds.select("fine", "key").join(name.select("key").distinct(), "key", "left_semi")
        x = scratch.keep(rows.where("not base_failed").join(feeds, "fine").select("key", *_xs()))
        raw = estimates(x, scratch, share=share)
        at = reweighted(x, raw, share).drop("reach").join(raw.select("key", "reach"), "key")
        at = name.join(at, "key").select("fine", "mu", "inv", "reach")
        # groups all of whose rows fail the fixed rules have no estimate and need none
        scored = rows.join(at, "fine", "left").withColumn("distance", _distance() / stretch(share))
        kept = ~F.col("base_failed") & (F.col("distance").isNull() | (F.col("distance") <= cut))
        return final(scored.select(F.col("id").alias(key), *COUNTS, "base_failed", "distance", kept.alias("kept")))


def op5(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance, kept of every whole text."""
    return judge(docs)
