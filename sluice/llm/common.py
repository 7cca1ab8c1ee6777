"""What the training-data operators share: folds, the shared folder, numpy hashing."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Hashable
from typing import Any

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch, final, shared_dir

__all__ = ["Scratch", "final", "shared_dir", "U64", "block_of", "chunks_of", "crc_fold", "give_back", "hash_share", "mix64", "model", "narrowed"]

U64 = np.uint64


def crc_fold(col: str, m: int) -> Column:
    """crc32(col as text) mod m; null for a null id."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % F.lit(m)


def hash_share(col: str, share: float, seed: int = 7) -> Column:
    """True for about ``share`` of the ids, the same ids on every table."""
    space = 1 << 30
    return F.pmod(F.xxhash64(F.lit(seed), F.col(col).cast("string")), F.lit(space)) < F.lit(int(min(1.0, share) * space))


def block_of(text: str, key: str, chars: int, seed: int) -> Column:
    """At most ``chars`` characters of a text from a place that a hash of the key chooses, so that a sample sees all parts of long texts."""
    room = F.greatest(F.length(text) - F.lit(chars - 1), F.lit(1))
    return F.substring(F.col(text), (F.pmod(F.xxhash64(F.lit(seed), F.col(key).cast("string")), room) + 1).cast("int"), F.lit(chars))


_models: dict[tuple[str, Hashable], list] = {}


def model(owner: str, key: Hashable, build: Callable[[], Any]) -> Any:
    """``build()``, kept in this process for later batches and tasks under (owner, key).

    Workers are reused from stage to stage; a new model sends away those that the present stage hasn't used.
    """
    task = TaskContext.get()
    stage = task.stageId() if task else -1
    got = _models.get((owner, key))
    if got is None:
        for k in [k for k, v in _models.items() if v[1] != stage]:
            del _models[k]
        give_back()
        got = _models[owner, key] = [build(), stage]
    got[1] = stage
    return got[0]


def give_back() -> None:
    """Returns freed memory to the system, where the C library can."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        return


#: Bits for each wanted value of a filter before a join, and the most bits (a broadcast table of at most a million rows).
FILTER_BITS, MOST_BITS = 16, 1 << 26


def narrowed(rows: DataFrame, want: DataFrame, on: str, scratch: Scratch) -> DataFrame:
    """``rows`` without most of those whose value of ``on`` isn't in ``want``: a filter before a join, so that fewer large rows are shuffled.

    A bitmap of hashes, as a table of 64-bit words that is broadcast. Its size is bounded; of more values it lets more
    rows through, which the join then drops.
    """
    n = want.count()
    bits = 1 << 10
    while bits < MOST_BITS and bits < FILTER_BITS * n:
        bits *= 2
    at = F.pmod(F.xxhash64(on), F.lit(bits))
    words = want.select(F.shiftright(at, 6).alias("_word"), at.bitwiseAND(F.lit(63)).cast("int").alias("_bit"))
    words = scratch.keep(words.groupBy("_word").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_bit"))).alias("_bits")))
    hit = F.call_function("shiftright", F.col("_bits"), F.pmod(F.xxhash64(on), F.lit(64)).cast("int")).bitwiseAND(F.lit(1)) == 1
    return rows.withColumn("_word", F.shiftright(at, 6)).join(F.broadcast(words), "_word").where(hit).select(*rows.columns)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers with good avalanche (splitmix finaliser)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def chunks_of(texts: list, weight: int = 1_000_000):
    """Runs of whole texts of about ``weight`` characters, so that a task's memory doesn't follow the batch size."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t) if t else 0
        if held >= weight:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
