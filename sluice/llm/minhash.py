"""Near duplicates by circulant MinHash, banding and exact verification.

1. Every text becomes its set of word shingles; equal sets are one class from here on, so groups of copies
   shrink to one row before anything is joined.
2. Classes that share a band key are candidates. Pairs within a bucket are not spelled out: each class is
   compared with one hub, the best connected class of its buckets, on full sets.
3. Buckets whose classes are one component after that are settled. For the rest an exact join finds every
   link between different components: two sets of that similarity must share one of their first shingles in
   any fixed order (prefix and positional filters), and the smaller set of the two even among its first ninth or so.
   Shingles of one component alone can't matter and come first in that order, so members that differ by shingles
   of their own drop out without being paired. Rows of a frequent shingle are dealt over blocks.
4. The components of all verified links give each document its group.
"""

from __future__ import annotations

import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import MEASURED
from .arrow import map_columns
from .common import Scratch, final, narrowed
from .components import components
from .shingles import band_keys, shingle_set, signature


#: Rows of one shingle that are a task's share when candidates are paired.
BLOCK = 512


def _row_digest(key: str, text: str) -> Column:
    """128 bits of a row's key and text; equal for repeated rows."""
    said = F.when(F.col(text).isNull(), "n").otherwise(F.concat(F.lit("t"), F.col(text)))
    return F.unhex(F.md5(F.concat(F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.lit("n")), F.lit("\x1f"), said)))


def _sketch(docs: DataFrame, text: str, key: str, size: int, bands: int, rows: int) -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()

    def run(keys: list, digests: list, texts: list) -> dict:
        out = {"id": keys, "r": digests, "n": [], "k": [], "bands": []}
        last: dict[bytes, list] = {}
        for t in texts:
            s = shingle_set(t, size)
            k = xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None
            if k and k not in last:  # copies in a batch are sketched once
                last[k] = band_keys(signature(s, bands * rows), bands)
            out["n"].append(len(s))
            out["k"].append(k)
            out["bands"].append(last[k] if k else None)
        return out

    return map_columns(docs, [key, _row_digest(key, text), text], run, f"id {kind}, r binary, n long, k binary, bands array<long>")


def _sets(rows: DataFrame, size: int) -> DataFrame:
    """(rid, n, s) of the classes whose text is at hand."""

    def run(rids: list, texts: list) -> dict:
        sets = [shingle_set(t, size) for t in texts]
        return {"rid": rids, "n": [len(s) for s in sets], "s": [s.view(np.int64) for s in sets]}

    return map_columns(rows, ["rid", "t"], run, "rid long, n long, s array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union."""
    left = sets.select(F.col("rid").alias("a"), F.col("n").alias("na"), F.col("s").alias("sa"))
    right = sets.select(F.col("rid").alias("b"), F.col("n").alias("nb"), F.col("s").alias("sb"))
    sized = pairs.join(left.select("a", "na"), "a").join(right.select("b", "nb"), "b")
    sized = sized.where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)").select("a", "b")
    met = sized.join(left, "a").join(right, "b").withColumn("i", F.size(F.array_intersect("sa", "sb")))
    return met.where(f"100 * i >= {percent} * (na + nb - i)").select("a", "b")


def _open_pairs(sets: DataFrame, open_: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(a, b): pairs of classes of different components that may be ``percent`` similar, among those in ``open_`` (rid, c)."""
    token = sets.join(open_, "rid").select("rid", "c", "n", F.explode("s").alias("t"))
    shared = token.groupBy("t").agg(F.count("*").alias("f"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("t", "f")
    of = Window.partitionBy("rid")
    # shingles of one component come first: they are counted, not kept
    token = token.join(shared, "t").withColumn("pos", F.col("n") - F.count("*").over(of) + F.row_number().over(of.orderBy("f", "t")) - 1)
    first = lambda share: f"pos < n - ceil({share} * n - 1e-9D) + 1"
    # the larger of two such sets shares one of its first n - ceil(p n) + 1, and the smaller of its first n - ceil(2 p n / (1 + p)) + 1
    prefix = scratch.keep(token.where(first(f"{percent / 100!r}D")).select("rid", "c", "n", "t", "pos", F.expr(first(f"{2 * percent / (100 + percent)!r}D")).alias("low")))
    # where many smaller sets meet: blocks of them, by size first
    hot = prefix.where("low").groupBy("t").agg(F.count("*").alias("m")).where(F.col("m") > BLOCK)
    prefix = scratch.keep(prefix.join(hot, "t", "left").withColumn("blocks", F.ceil(F.coalesce("m", F.lit(1)) / BLOCK).cast("int")).drop("m"))
    band = F.when(F.col("blocks") > 1, F.floor(F.ln("n") / float(np.log(100 / percent)) + 1e-9)).otherwise(0).cast("int")
    x = prefix.where("low").select("t", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int").alias("block"), band.alias("band"), *[F.col(c).alias(f"{c}1") for c in ("rid", "c", "n", "pos")])
    y = prefix.withColumn("band", F.explode(F.when(F.col("blocks") > 1, F.array(band, band - 1)).otherwise(F.array(F.lit(0)))))
    y = y.select("t", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "band", *[F.col(c).alias(f"{c}2") for c in ("rid", "c", "n", "pos")])
    pairs = x.join(y, ["t", "block", "band"]).where(
        f"(n1 < n2 or (n1 = n2 and rid1 < rid2)) and c1 <> c2 and 100 * n1 >= {percent} * n2"
        f" and (100 + {percent}) * least(n1 - pos1, n2 - pos2) >= {percent} * (n1 + n2)"
    )
    return pairs.select(F.col("rid1").alias("a"), F.col("rid2").alias("b")).distinct()


def _grouped(docs: DataFrame, scratch: Scratch, text: str, key: str, size: int, percent: int, bands: int, rows: int) -> DataFrame:
    """(id, r, n, root, component_id), one row a row of ``docs``; root is null for rows without words."""
    sketch = scratch.keep(_sketch(docs, text, key, size, bands, rows).withColumn("rid", F.monotonically_increasing_id()))
    filled = sketch.where("k is not null")
    classes = filled.groupBy("k").agg(F.min(F.struct("rid", "r", "bands")).alias("m"), F.min("id").alias("low"))
    classes = scratch.keep(classes.select("k", "m.rid", "m.r", "m.bands", "low"))

    # buckets of two classes or more
    e = classes.select("rid", F.explode("bands").alias("b"))
    e = scratch.keep(e.join(e.groupBy("b").agg(F.count("*").alias("m")).where("m > 1"), "b"))
    score = scratch.keep(e.groupBy("rid").agg(F.sum("m").alias("w")))
    e = scratch.keep(e.drop("m").join(score, "rid"))
    hub = e.groupBy("b").agg(F.max(F.struct("w", (-F.col("rid")).alias("x"))).alias("h"))
    star = e.join(hub, "b").groupBy("rid").agg(F.max("h").alias("h")).select(F.col("rid").alias("a"), (-F.col("h.x")).alias("b")).where("a <> b")
    star = scratch.keep(star)

    # the texts of those classes: of repeated rows one
    want = scratch.keep(score.join(classes, "rid").select("rid", "r"))
    texts = narrowed(docs.select(_row_digest(key, text).alias("r"), F.col(text).alias("t")), want, "r", scratch)
    sets = scratch.keep(_sets(texts.join(want, "r").dropDuplicates(["r"]), size))

    links = scratch.keep(_verified(star, sets, percent))
    comp = components(links, scratch)

    # what the stars leave open: buckets with more than one component
    e = scratch.keep(e.select("rid", "b").join(comp.withColumnRenamed("node", "rid"), "rid", "left").select("rid", "b", F.coalesce("root", "rid").alias("c")))
    mixed = e.groupBy("b").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("b")
    open_ = scratch.keep(e.join(mixed, "b", "left_semi").select("rid", "c").distinct())
    more = scratch.keep(_verified(scratch.keep(_open_pairs(sets, open_, percent, scratch)), sets, percent))

    # links between components, named by the components' roots
    at = comp.select(F.col("node").alias("a"), F.col("root").alias("ra"))
    bridge = more.join(at, "a", "left").join(at.toDF("b", "rb"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    top = components(scratch.keep(bridge), scratch).select(F.col("node").alias("root"), F.col("root").alias("top"))
    cls = classes.select("k", "rid", "low").join(comp.withColumnRenamed("node", "rid"), "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    cls = scratch.keep(cls.join(top, "root", "left").select("k", "low", F.coalesce("top", "root").alias("root")))
    named = cls.join(cls.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("k", "root", "component_id")
    some = filled.join(named, "k").select("id", "r", "n", "root", "component_id")
    return some.unionByName(sketch.where("k is null").select("id", "r", "n", F.lit(None).cast("long").alias("root"), F.col("id").alias("component_id")))


def groups(docs: DataFrame, *, text: str = "text", key: str = "doc_id", size: int = 5, percent: int = 80, bands: int = 30, rows: int = 5) -> DataFrame:
    """(key, n_shingles, component_id, kept), one row a row of ``docs``.

    Links join texts with 100 * intersection >= percent * union of their shingle sets. component_id is the
    smallest key reachable over links, the row's own included. Texts that are null, empty or without words have
    an empty set, are linked with nothing and stay. Repeated rows are linked with each other. Rows of one key
    with different texts are different nodes. A null key is never the smallest; a component of null keys alone
    has a null id and its rows are kept.
    """
    with Scratch(docs.sparkSession, MEASURED) as scratch:
        out = _grouped(docs, scratch, text, key, size, percent, bands, rows)
        kept = F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull())
        return final(out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id", kept.alias("kept")), MEASURED)


def drop_duplicates(docs: DataFrame, *, text: str = "text", key: str = "doc_id", size: int = 5, percent: int = 80, bands: int = 30, rows: int = 5) -> DataFrame:
    """``docs`` with one row of each group, all columns as they are: the smallest key's, null keys last.

    Decided by row, not by key: rows of one key with different texts are different documents. Repeated rows are
    one; which of them stays, if further columns differ, is open. Rows without words are linked with nothing and stay.
    """
    with Scratch(docs.sparkSession, MEASURED) as scratch:
        out = _grouped(docs, scratch, text, key, size, percent, bands, rows)
        one = out.where("root is not null").groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "r")).alias("m")).select("m.r")
        kept = final(one.unionByName(out.where("root is null").select("r").distinct()), MEASURED)
    mark = f"_{uuid.uuid4().hex}"
    # a row for each document that stays: never a table in the driver, whatever the caller's job may broadcast
    kept = kept.withColumnRenamed("r", mark).hint("merge")
    return docs.withColumn(mark, _row_digest(key, text)).join(kept, mark, "left_semi").dropDuplicates([mark]).select(*docs.columns)


def op8(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for three-word shingles and 85 percent; see ``groups``."""
    return groups(docs, size=3, percent=85)
