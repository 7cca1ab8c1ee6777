"""Near-duplicate vectors by spherical-cap filters.

Filter directions form a structured code: each is a concatenation of one short random direction for each of
four blocks of (rotated) dimensions, so that millions of them need only a small table, and the filters that a
vector exceeds are list-decoded from four short lists of inner products. Vectors that share a filter are
compared in double precision. A pair counts once, however many filters it shares.

Several such codes, each turned by a rotation of its own, serve together. A rotation drawn uniformly makes the
chance that a pair shares no filter depend on its cosine alone, whatever the data, and the chances of the codes
multiply. That chance is measured on drawn pairs of cosine ``least`` and gives the number of codes (``plan``).
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_columns
from .common import Scratch, final
from .components import components

BLOCKS = 4
#: Vectors of a filter that a task compares at once, and the size up to which pairs of a filter are joined as rows.
CELL, SMALL = 256, 48
#: Filter numbers of vectors of one length lie below this bit; the length is above it.
LENGTH_SHIFT = 40
#: The chance with which a pair whose cosine is the bound itself may share no filter.
MISS = 1e-5


class ProductCode:
    """``width`` short directions a block; decodes a vector to its ``list_size`` best filters.

    A vector's bound is its own: the inner product that ``list_size`` filters reach. (One bound for all gives a
    tenth of real vectors no filter at all and others a thousand.)
    """

    def __init__(self, dim: int, width: int, list_size: int, seed: int = 5):
        r = np.random.default_rng(seed)
        self.size = -(-dim // BLOCKS) * BLOCKS
        q, u = np.linalg.qr(r.standard_normal((self.size, self.size)))
        self.turn = (q * np.where(np.diag(u) < 0, -1.0, 1.0))[:dim]  # signs that make the rotation uniform
        c = r.standard_normal((BLOCKS, width, self.size // BLOCKS))
        self.words = c / np.linalg.norm(c, axis=2, keepdims=True)
        self.width, self.list_size = width, list_size

    def _pairs(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ranks (i, j) in two sorted lists whose sum can be among the ``list_size`` best: no other (i + 1) * (j + 1) - 1 sums are smaller."""
        i, j = np.divmod(np.arange(k * k), k)
        fit = (i + 1) * (j + 1) <= self.list_size
        return i[fit], j[fit]

    def _joined(self, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], times: int) -> tuple[np.ndarray, np.ndarray]:
        """(sums, numbers) of the best combinations of two lists, best first; a number is a's times ``times`` plus b's."""
        i, j = self._pairs(min(a[0].shape[1], b[0].shape[1]))
        sums, numbers = a[0][:, i] + b[0][:, j], a[1][:, i] * times + b[1][:, j]
        return self._first(sums, numbers)

    def _first(self, sums: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = min(self.list_size, sums.shape[1])
        at = np.argpartition(-sums, k - 1, axis=1)[:, :k]
        s = np.take_along_axis(sums, at, 1)
        at = np.take_along_axis(at, np.argsort(-s, axis=1, kind="stable"), 1)
        return np.take_along_axis(sums, at, 1), np.take_along_axis(numbers, at, 1)

    def decode(self, v: np.ndarray) -> np.ndarray:
        """By vector the sorted numbers of its filters. The best sums of lists use only the best of each, so few are formed."""
        p = np.einsum("nbd,bwd->bnw", (v @ self.turn).reshape(len(v), BLOCKS, -1), self.words, optimize=True)
        numbers = np.broadcast_to(np.arange(self.width, dtype=np.int64), p[0].shape)
        one = [self._first(x, numbers) for x in p]
        x, y = (self._joined(one[i], one[i + 1], self.width) for i in (0, 2))
        return np.sort(self._joined(x, y, self.width**2)[1], axis=1)


@functools.lru_cache(128)
def _code(dim: int, width: int, list_size: int, seed: int) -> ProductCode:
    return ProductCode(dim, width, list_size, seed)


def _width(n: int, list_size: int) -> int:
    """Words a block, a power of two, so that unrelated vectors rarely meet: four filters for each list entry."""
    w = 8
    while w**BLOCKS < 4 * n * list_size and w < 512:
        w *= 2
    return w


def decode(v: np.ndarray, width: int, list_size: int, codes: int) -> np.ndarray:
    """By unit vector the sorted numbers of its filters in all codes."""
    step = max(256, (1 << 18) // width)
    of = lambda k: np.concatenate([_code(v.shape[1], width, list_size, 5 + k).decode(v[at : at + step]) for at in range(0, len(v), step)])
    return np.concatenate([of(k) + k * width**BLOCKS for k in range(codes)], axis=1)


@functools.lru_cache(64)
def _missed(dim: int, width: int, list_size: int, least: float) -> float:
    """An upper bound, by about two standard errors, of the chance that a pair of cosine ``least`` shares no filter of one code."""
    n = 20_000
    r = np.random.default_rng(dim)
    a, b = r.standard_normal((2, n, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = least * a + math.sqrt(max(0.0, 1 - least**2)) * b / np.linalg.norm(b, axis=1, keepdims=True)
    x, y = (decode(v, width, list_size, 1) for v in (a, b))
    m = sum(not np.intersect1d(i, j, assume_unique=True).size for i, j in zip(x, y))
    return min(0.99, (m + 2 * math.sqrt(m) + 2) / n)


@functools.lru_cache(64)
def plan(dim: int, n: int, list_size: int, least: float) -> tuple[int, int]:
    """Words a block and number of codes: of all widths the one with the least work for ``n`` vectors, each with as many codes as keep a pair's chance of sharing no filter below ``MISS``."""
    if dim < 2:
        return 8, 1
    widths, best = [8], None
    while widths[-1] < _width(n, list_size):
        widths.append(2 * widths[-1])
    for w in widths:
        codes = max(1, math.ceil(math.log(MISS) / math.log(_missed(dim, w, list_size, least))))
        # microseconds: a list entry and those that it meets by chance, and decoding
        work = codes * (list_size * (2 + n * list_size / w**BLOCKS) + 40 + 0.04 * w)
        best = min(best or (work, w, codes), (work, w, codes))
    return best[1:]


def _labels(near: np.ndarray) -> np.ndarray:
    """For each row of a symmetric boolean matrix the first row that a path leads to."""
    at = np.arange(len(near))
    while True:
        low = np.minimum(at, np.where(near, at[None, :], len(near)).min(axis=1, initial=len(near)))
        low = low[low]
        if (low == at).all():
            return at
        at = low


def _cell(f: int, crossing: bool, pdf: pd.DataFrame, least: float) -> pd.DataFrame:
    """Links of one cell: for each vector the weight of its new partners and a label that linked vectors share."""
    pdf = pdf.drop_duplicates("rid").sort_values("rid")
    v, w = np.stack(pdf["v"].to_numpy()), pdf["w"].to_numpy(np.int64)
    near = v @ v.T >= least
    np.fill_diagonal(near, False)
    if crossing:  # two blocks: pairs within one of them belong to another cell
        block = pdf["block"].to_numpy()
        near &= block[:, None] != block
    if near.any():
        ids = [np.asarray(x) for x in pdf["fl"]]
        flat = np.concatenate(ids)
        row = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
        row, flat = row[flat < f], flat[flat < f]
        if len(flat):
            _, col, times = np.unique(flat, return_inverse=True, return_counts=True)
            twice = times > 1
            met = np.zeros((len(ids), twice.sum()), np.float32)
            met[row[twice[col]], (np.cumsum(twice) - 1)[col[twice[col]]]] = 1
            near &= met @ met.T == 0
    rid = pdf["rid"].to_numpy()
    return pd.DataFrame({"rid": rid, "n": near @ w, "label": rid[_labels(near)]})


def links(vectors: DataFrame, *, vector: str = "embedding", key: str = "vec_id", least: float = 0.95, list_size: int = 32) -> DataFrame:
    """(key, n_links, component_id, kept), one row a row of ``vectors``.

    Two vectors link if they share a filter and their cosine in double precision is at least ``least``; a pair
    shares none with a chance below ``MISS`` at that cosine and less above, and equal vectors always share one.
    Vectors of different lengths never link, and each length has codes of its own. Vectors that are null, empty or zero,
    or with null or non-finite components link with nothing. Repeated rows are vectors of their own that link. The
    smallest key of a component names it; a null key is never smallest.
    """
    kind = vectors.schema[key].dataType.simpleString()
    col = F.transform(F.col(vector), lambda x: x.cast("double"))
    fine = F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    with Scratch(vectors.sparkSession) as scratch:
        rows = vectors.select(F.col(key).alias("id"), col.alias("v"))
        rows = scratch.keep(rows.withColumn("v", F.when(F.coalesce(fine, F.lit(False)), F.col("v"))).withColumn("row", F.monotonically_increasing_id()))
        good = rows.where("v is not null")
        total = good.agg(F.approx_count_distinct(F.xxhash64("v")).alias("n")).first().n
        # the plans of the most frequent lengths are made here; a task makes those of others, and the same ones
        usual = [r.d for r in good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(8).collect()]
        plans = {d: plan(d, total, list_size, least) for d in usual}
        same = good.groupBy("v").agg(F.min("row").alias("rid"), F.count("*").alias("w"), F.min("id").alias("low"))

        def filters(rids: list, vs: list, ws: list, lows: list) -> dict:
            unit, fl = [None] * len(vs), [None] * len(vs)
            sizes = np.fromiter(map(len, vs), np.int64, len(vs))
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                v = np.array([vs[i] for i in at], float)
                v /= np.abs(v).max(axis=1, keepdims=True)
                v /= np.linalg.norm(v, axis=1, keepdims=True)
                f = decode(v, *chosen(dim)) + (dim << LENGTH_SHIFT)
                for i, x, y in zip(at.tolist(), v, f):
                    unit[i], fl[i] = x, y
            return {"rid": rids, "u": unit, "w": ws, "low": lows, "fl": fl}

        def chosen(dim: int) -> tuple[int, int, int]:
            width, codes = plans.get(dim) or plan(dim, total, list_size, least)
            return width, list_size, codes

        same = scratch.keep(map_columns(same, ["rid", "v", "w", "low"], filters, f"rid long, u array<double>, w long, low {kind}, fl array<long>"))

        # filters with two vectors or more; each vector goes with those of its filters that many share
        f = same.select("rid", F.explode("fl").alias("f"))
        f = scratch.keep(f.join(f.groupBy("f").agg(F.count("*").alias("m")).where("m > 1"), "f"))
        shared = f.where(F.col("m") > SMALL).groupBy("rid").agg(F.sort_array(F.collect_list("f")).alias("fl"))  # at most a vector's own list
        unit = scratch.keep(same.select("rid", "u", "w").join(shared, "rid", "left"))

        # a pair counts once: in the first filter that many share, else here
        few = f.where(F.col("m") <= SMALL).select("f", "rid")
        pairs = few.toDF("f", "a").join(few.toDF("f", "b"), "f").where("a < b").select("a", "b").distinct()
        pairs = pairs.join(unit.toDF("a", "ua", "wa", "fa"), "a").join(unit.toDF("b", "ub", "wb", "fb"), "b").where("not coalesce(arrays_overlap(fa, fb), false)")
        dot = F.aggregate(F.zip_with("ua", "ub", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        pairs = scratch.keep(pairs.where(dot >= least).select("a", "b", "wa", "wb"))

        many = f.where(F.col("m") > SMALL).join(unit, "rid").withColumn("blocks", F.ceil(F.col("m") / CELL).cast("int"))
        many = many.withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
        many = many.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        many = many.select("f", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rid", F.col("u").alias("v"), "w", "fl")
        cells = many.groupBy("f", "i", "j").applyInPandas(lambda k, pdf: _cell(k[0], k[1] != k[2], pdf, least), "rid long, n long, label long")
        cells = scratch.keep(cells.where("n > 0 or label <> rid"))

        edges = pairs.select("a", "b").union(cells.where("rid <> label").select(F.col("rid").alias("a"), F.col("label").alias("b"))).distinct()
        comp = components(edges, scratch).withColumnRenamed("node", "rid")
        n = pairs.select(F.col("a").alias("rid"), F.col("wb").alias("n")).union(pairs.select("b", "wa")).union(cells.select("rid", "n")).groupBy("rid").agg(F.sum("n").alias("n"))
        cls = same.select("rid", "w", "low").join(n, "rid", "left").join(comp, "rid", "left")
        cls = scratch.keep(cls.select("rid", "low", F.coalesce("root", "rid").alias("root"), (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links")))
        named = cls.join(cls.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("rid", "n_links", "component_id")
        member = good.select("id", "row", "v").join(good.groupBy("v").agg(F.min("row").alias("rid")), "v").select("id", "row", "rid")
        some = member.join(named, "rid").select("id", "n_links", "component_id")
        none = rows.where("v is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
        out = some.unionByName(none)
        kept = F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull())
        return final(out.select(F.col("id").alias(key), "n_links", "component_id", kept.alias("kept")))


def op9(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept; see ``links``."""
    return links(vectors)
