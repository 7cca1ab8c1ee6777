"""Whitening of vectors by an exact covariance.

Entries become integers, and the scatter matrix (with a column of ones behind the entries, so that it holds sums and
count too) is computed exactly: every partition multiplies residues modulo several primes with floating-point matrix
products too small to round, what is shuffled and added are residues, and Chinese remaindering gives the integers. Only
the eigenvectors are computed in floating point, from correctly rounded covariances.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..session import ship_package
from .arrow import slices
from .common import Scratch, final

#: An entry c becomes floor(SCALE * c) + SHIFT. Beyond EDGE it is cut, so that integers stay in 64 bits.
SCALE, SHIFT, EDGE = 1024, 100_000, 1 << 61
#: Primes are below this; as many rows are multiplied at once as keep a sum of products below 2^53.
BELOW = 1 << 22
STEP = (1 << 53) // BELOW**2
#: Numbers that a task holds in residue matrices before it hands them on.
HELD = 1 << 24
#: Eigenvalues up to this share of the trace, times the dimension, are rounding errors of a covariance without rank.
NIL = 2.0**-50


def primes(least: int) -> list[int]:
    """The largest primes below BELOW whose product is more than ``least``."""
    out, p, product = [], BELOW - 1, 1
    while product <= least:
        if all(p % q for q in range(3, math.isqrt(p) + 1, 2)):
            out.append(p)
            product *= p
        p -= 2
    return out


def from_residues(residues: list[int], ps: list[int]) -> int:
    """The integer of least absolute value with these residues."""
    x, m = 0, 1
    for r, p in zip(residues, ps):
        x += m * ((r - x) * pow(m, -1, p) % p)
        m *= p
    return x - m if 2 * x > m else x


def gram(x: np.ndarray, p: int) -> np.ndarray:
    """x^T x modulo p of a matrix of 64-bit integers, exactly."""
    r = (x % p).astype(np.float64)
    out = np.zeros((x.shape[1],) * 2, np.int64)
    for a in range(0, len(r), STEP):
        part = r[a : a + STEP]
        out = (out + (part.T @ part).astype(np.int64)) % p
    return out


def _rows(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) for each length of the lists of an Arrow column."""
    at, flat = np.asarray(column.offsets), np.asarray(column.values)
    size = np.diff(at)
    for d in np.unique(size).tolist():
        i = np.flatnonzero(size == d)
        yield i, flat[at[i][:, None] + np.arange(d)]


def _batches(df: DataFrame, fn, schema: str) -> DataFrame:
    ship_package(df.sparkSession)
    kind = _parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(kind)
        for got in fn(b for whole in batches for b in slices(whole)):
            yield pa.RecordBatch.from_arrays([pa.array(got[x.name], type=x.type) for x in out], schema=out)

    return df.mapInArrow(run, kind)


def integers(vectors: DataFrame, *, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(key, x array<long>) of the vectors that are neither null nor empty nor hold null or non-finite entries."""
    v = F.transform(F.col(vector), lambda c: c.cast("double"))
    edge = float(EDGE)
    x = F.transform("v", lambda c: F.floor(F.least(F.greatest(c * F.lit(float(SCALE)), F.lit(-edge)), F.lit(edge))).cast("long") + F.lit(SHIFT))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.select(F.col(key).alias("key"), v.alias("v")).where(F.size("v") > 0).where(~F.coalesce(bad, F.lit(True))).select("key", x.alias("x"))


def scatter(x: DataFrame, ps: dict[int, list[int]]) -> DataFrame:
    """(d, i, sums): row i of the scatter of all vectors of length d, with ones behind them, modulo each prime, the residues of one prime behind
    those of the other. A task hands on one matrix a length; what meets by row is added as it comes."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: dict[int, np.ndarray] = {}

        def out() -> Iterator[dict]:
            for d, m in held.items():
                yield {"d": [d] * (d + 1), "i": range(d + 1), "part": list(m.transpose(1, 0, 2).reshape(d + 1, -1))}
            held.clear()

        for b in batches:
            for _, m in _rows(b.column(0)):
                d = m.shape[1]
                m = np.concatenate([m, np.ones((len(m), 1), np.int64)], axis=1)
                got = np.stack([gram(m, p) for p in ps[d]])
                held[d] = (held[d] + got) % np.array(ps[d])[:, None, None] if d in held else got
            if sum(m.size for m in held.values()) > HELD:
                yield from out()
        yield from out()

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, i = (k.as_py() for k in key)
        mod = np.repeat(np.array(ps[d], np.int64), d + 1)
        total = np.zeros(len(mod), np.int64)
        for b in batches:
            for s in slices(b):
                total = (total + np.asarray(s.column("part").flatten()).reshape(len(s), -1).sum(axis=0)) % mod
        yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([i], pa.int32()), pa.array([total], pa.list_(pa.int64()))], names=["d", "i", "sums"])

    parts = _batches(x.select("x"), products, "d int, i int, part array<long>")
    add.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return parts.groupBy("d", "i").applyInArrow(add, "d int, i int, sums array<long>")


class Fit:
    """The whitening of vectors of one length: count, exact sums, trace and the leading eigenvectors, numbered by falling eigenvalue."""

    def __init__(self, n: int, sums: list[int], covariance: np.ndarray, most: int):
        self.n, self.sums, d = n, sums, len(sums)
        values, vectors = np.linalg.eigh(covariance)
        self.k = min(most, d)
        self.values, basis = values[::-1][: self.k], vectors[:, ::-1][:, : self.k]
        basis = basis * np.where(basis[np.abs(basis).argmax(axis=0), np.arange(self.k)] < 0, -1.0, 1.0)
        self.trace = float(np.trace(covariance))
        self.live = self.values > NIL * d * self.trace
        self.values = np.where(self.live, self.values, 0.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            self.turn = np.where(self.live, basis / np.sqrt(self.values), 0.0)
        whole = [s // n for s in sums]
        self.whole = np.array(whole, np.int64)
        self.rest = [s - n * w for s, w in zip(sums, whole)]
        self.share = np.array([r / n for r in self.rest])
        self.explained = [v / self.trace if self.trace > 0 else 0.0 for v in self.values.tolist()]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.whole).astype(np.float64) - self.share) @ self.turn

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sums of (n x - S)^2, exact: with y = x less the whole part of the mean and r what is left of S, n^2 y^2 - 2 n y r + r^2."""
        n, y, d = self.n, x - self.whole, x.shape[1]
        far = int(np.abs(y).max(initial=0))
        if far * far * d >= 1 << 62 or far * n * d >= 1 << 62:
            y = y.astype(object)
            yy, yr = (y * y).sum(axis=1).tolist(), (y * np.array(self.rest, object)).sum(axis=1).tolist()
        else:
            yy, yr = (y * y).sum(axis=1).tolist(), (y @ np.array(self.rest, np.int64)).tolist()
        rr = sum(r * r for r in self.rest)
        return [n * n * int(a) - 2 * n * int(b) + rr for a, b in zip(yy, yr)]


def fit(x: DataFrame, scratch: Scratch, components: int = 8) -> dict[int, Fit]:
    """By length of vectors their whitening. The driver sees a count, a bound, and the square of the length in numbers."""
    bounds = x.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("x", F.abs))).alias("far")).collect()
    ps = {r.d: primes(4 * r.n * max(r.far, 1) ** 2) for r in bounds}
    sums = scratch.keep(scatter(x, ps))
    whole: dict[int, list[int]] = {}  # the last row: sums, and the count
    for r in sums.where(F.col("i") == F.col("d")).collect():
        one = np.array(r.sums).reshape(len(ps[r.d]), -1).T.tolist()
        whole[r.d] = [from_residues(v, ps[r.d]) for v in one]

    def covariance(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            got: dict[str, list] = {"d": [], "i": [], "row": []}
            for r in b.to_pylist():
                d, i = r["d"], r["i"]
                one = np.array(r["sums"]).reshape(len(ps[d]), -1).T.tolist()
                *s, n = whole[d]
                got["d"].append(d)
                got["i"].append(i)
                got["row"].append([(n * from_residues(v, ps[d]) - s[i] * s[j]) / (n * n) for j, v in enumerate(one[:d])])  # rounded once
            yield got

    matrices = {d: np.zeros((d, d)) for d in whole}
    for r in _batches(sums.where(F.col("i") < F.col("d")), covariance, "d int, i int, row array<double>").toLocalIterator():
        matrices[r.d][r.i] = r.row
    return {d: Fit(w[-1], w[:-1], matrices[d], components) for d, w in whole.items()}


def whiten(vectors: DataFrame, *, vector: str = "embedding", key: str = "vec_id", components: int = 8) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error, deviation_exact), a row for each vector and component.

    Rows whose vector is null or empty or holds null or non-finite entries go. Repeated rows are vectors of their own,
    and a null key is a key. Vectors of each length have a fit of their own (n counts those). A component without
    variance has whitened and explained 0 and doesn't count in identity_error. ``deviation`` is null where it exceeds
    a long; ``deviation_exact`` has it in decimal digits at any size. Entries beyond 2^61 / SCALE count as that.
    """
    kind = vectors.schema[key].dataType.simpleString()
    with Scratch(vectors.sparkSession) as scratch:
        x = scratch.keep(integers(vectors, vector=vector, key=key))
        fits = fit(x, scratch, components)

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            for b in batches:
                for i, m in _rows(b.column(1)):
                    f = fits[m.shape[1]]
                    far = f.deviations(m)
                    yield {
                        "key": b.column(0).take(pa.array(i)),
                        "d": [m.shape[1]] * len(i),
                        "w": list(f.whitened(m)),
                        "deviation": [v if v < 1 << 63 else None for v in far],
                        "deviation_exact": [str(v) for v in far],
                    }

        rows = scratch.keep(_batches(x, apply, f"key {kind}, d int, w array<double>, deviation long, deviation_exact string"))
        pairs = [(i, j) for i in range(components) for j in range(i, components)]
        moments = rows.groupBy("d").agg(*[F.covar_pop(F.get("w", F.lit(i)), F.get("w", F.lit(j))).alias(f"c{i}_{j}") for i, j in pairs]).collect()
        off = {r.d: max([abs(r[f"c{i}_{j}"] - (i == j)) for i, j in pairs if j < fits[r.d].k and fits[r.d].live[i] and fits[r.d].live[j]], default=0.0) for r in moments}
        model = vectors.sparkSession.createDataFrame([(d, f.n, f.explained, off[d]) for d, f in fits.items()], "d int, n long, explained array<double>, identity_error double")
        out = rows.join(F.broadcast(model), "d")  # a row a length
        out = out.select("*", F.posexplode("w").alias("at", "whitened"))
        return final(out.select(F.col("key").alias(key), (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", F.get("explained", F.col("at")).alias("explained"), "identity_error", "deviation_exact"))


def op13(vectors: DataFrame) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error, deviation_exact; see ``whiten``."""
    return whiten(vectors)
