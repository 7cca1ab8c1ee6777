"""Quality scores from compressed sizes.

Two zstandard dictionaries are built, from text labelled good and from text labelled bad. A text is compressed
in whole blocks with each. The difference of the sizes, over their sum, is the evidence, beside the smaller size
over the text's own (a text that repeats itself is small with either); a logistic curve fitted on other
labelled rows turns both into a probability that the label is 1.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import map_columns, row_filter
from .common import block_of, crc_fold, hash_share, model as kept_model

#: Bytes compressed at once: small enough that the dictionary, not the text's own start, is what matches.
BLOCK = 1024
LEVEL = 3


def _compressor(dictionary: bytes) -> zstd.ZstdCompressor:
    d = zstd.ZstdCompressionDict(dictionary)
    d.precompute_compress(level=LEVEL)
    return zstd.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False)


def _compressors(good: bytes, bad: bytes) -> tuple[zstd.ZstdCompressor, zstd.ZstdCompressor]:
    return kept_model("quality", (good, bad), lambda: (_compressor(good), _compressor(bad)))


def _dictionary(blocks: list[bytes], room: int) -> bytes:
    """A dictionary trained on the blocks; of too little text for that, the text itself serves as one."""
    try:
        return zstd.train_dictionary(room, blocks, k=256, d=8, level=LEVEL).as_bytes()
    except zstd.ZstdError:
        return b"".join(blocks)[-2 * room :]


class Model(NamedTuple):
    """Two dictionaries and the curve; without dictionaries every text scores 0.5."""

    good: bytes = b""
    bad: bytes = b""
    centre: tuple[float, ...] = ()
    scale: tuple[float, ...] = ()
    weights: tuple[float, ...] = ()


def evidence(texts: list[str | None], good: bytes, bad: bytes) -> np.ndarray:
    """By text: (bad - good) / (bad + good) of the compressed sizes, the log of the smaller over the text's size, its square
    below the usual and the product of the first two; zeros for empty texts."""
    g, b = (c.compress for c in _compressors(good, bad))
    out = np.zeros((len(texts), 4))
    for i, t in enumerate(texts):
        if t:
            raw = t.encode("utf-8", "surrogatepass")
            x = y = 0
            for j in range(0, len(raw), BLOCK):
                part = raw[j : j + BLOCK]
                x += len(g(part))
                y += len(b(part))
            d, r = (y - x) / (x + y), np.log(min(x, y) / len(raw))
            out[i] = d, r, min(0.0, r + 1.0) ** 2, d * r
    return out


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 50) -> np.ndarray:
    """Weights, the intercept last, by Newton's method; slightly regularised, so that separable samples stay finite."""
    a = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w, ridge = np.zeros(a.shape[1]), np.full(a.shape[1], 0.1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge)
        w = w + np.linalg.solve(h, a.T @ (y - p) - ridge * w)
    return w


def learn(docs: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", label: str = "quality", where: Column | None = None, sample_rows: int = 3_000, row_chars: int = 16_000, dict_bytes: int = 64_000) -> Model:
    """Two dictionaries and a calibration from a bounded sample of labelled rows.

    About ``sample_rows`` rows a class, chosen by a hash of the id on both tables before they meet, and of each a block
    of at most ``row_chars`` characters at a place that the hash chooses too. Never more than twice ``sample_rows`` a
    class reach the driver, however many rows an id has: those first by a hash of id and block. Of every four sampled
    rows three build the dictionaries and one calibrates. Ids with both labels count as neither; rows with a null id,
    null and empty texts teach nothing.
    Without text of either class every text scores 0.5.
    """
    lab = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull())
    lab = lab if where is None else lab.where(where)
    counts = {r[0]: r[1] for r in lab.groupBy(label).count().collect()}
    if len(counts) < 2:
        return Model()
    share = {c: sample_rows / n for c, n in counts.items()}
    picked = lab.where(((F.col(label) == 0) & hash_share(key, share[0])) | ((F.col(label) == 1) & hash_share(key, share[1])))
    picked = picked.groupBy(key).agg(F.min(label).alias("lo"), F.max(label).alias("hi")).where("lo = hi").select(key, F.col("lo").alias("y"))
    near = docs.where(F.col(text).isNotNull() & hash_share(key, max(share.values()))).select(key, block_of(text, key, row_chars, 17).alias("t"))
    drawn = near.join(picked, key).select("y", F.xxhash64(F.lit(3), F.col(key)).alias("h"), "t", F.xxhash64(F.lit(5), F.col(key), F.col("t")).alias("r"))
    tops = [drawn.where(F.col("y") == c).orderBy("r", "h", "t").limit(2 * sample_rows) for c in (0, 1)]
    rows = sorted((r.h, r.y, r.t) for r in tops[0].union(tops[1]).select("y", "h", "t").collect())
    parts: dict[int, list[bytes]] = {0: [], 1: []}
    for h, y, t in rows:
        if h % 4:
            raw = t.encode("utf-8", "surrogatepass")
            parts[y] += [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
    room = min(dict_bytes, *(sum(map(len, p)) // 2 for p in parts.values()))
    if room < 1:
        return Model()
    dicts = [_dictionary(parts[c], room) for c in (1, 0)]
    rest = [(y, t) for h, y, t in rows if h % 4 == 0]
    y = np.array([r[0] for r in rest], float)
    if not 0 < y.sum() < len(y):
        return Model(*dicts, (0.0,) * 4, (1.0,) * 4, (40.0, 0.0, 0.0, 0.0, 0.0))
    x = evidence([r[1] for r in rest], *dicts)
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    w = _logistic((x - centre) / scale, y)
    # classes are sampled unevenly; the prior goes back into the intercept
    w[-1] += np.log(counts[1] / counts[0]) - np.log(y.sum() / (1 - y).sum())
    return Model(*dicts, *(tuple(v.tolist()) for v in (centre, scale, w)))


def probability(texts: list, model: Model) -> np.ndarray:
    """The probability that the label is 1: 0 for null and empty texts, 0.5 without a model."""
    s = np.full(len(texts), 0.5)
    if model.good:
        x = (evidence(texts, model.good, model.bad) - model.centre) / model.scale
        s = 1 / (1 + np.exp(-np.clip(x @ model.weights[:-1] + model.weights[-1], -30, 30)))
    return np.where([not t for t in texts], 0.0, s)


def accepted(docs: DataFrame, model: Model, *, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, all columns as they are; nothing is shuffled.

    Null and empty texts score 0 and go; repeated rows are decided on alike.
    """
    return row_filter(docs, text, lambda texts: probability(texts, model) >= threshold)


def score(docs: DataFrame, model: Model, *, text: str = "text", key: str = "doc_id", threshold: float = 0.3) -> DataFrame:
    """(key, score, predicted) of every document's whole text.

    Null and empty texts have no evidence and score 0: there is nothing to learn from. Repeated rows each give one.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(keys: list, texts: list) -> dict:
        s = probability(texts, model)
        return {key: keys, "score": s, "predicted": (s >= threshold).astype(np.int32)}

    return map_columns(docs, [key, text], run, f"`{key}` {kind}, score double, predicted int")


def op1(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; labels of fold 0 of 5 are never read."""
    model = learn(docs, labels, where=F.coalesce(crc_fold("doc_id", 5) != 0, F.lit(False)))
    out = score(docs, model)
    return out.select("doc_id", F.coalesce(crc_fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
