"""Alignment of the tokens of two tokenizers over the bytes of a text.

The ends of each tokenizer's tokens are bits of packed words, one bit a byte. Their AND has the cuts that both share;
popcounts up to a cut say which tokens lie before it, so that consecutive cuts give groups of token ranges. The OR has
the ends of all overlaps: each of its bits is the last byte that one token of either side has in common with one of the other.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..session import ship_package
from .arrow import map_columns, slices
from .common import Scratch, chunks_of, final, model
from .flat import Folder, qualified
from .packing import ByteBpe

#: Characters of texts that are aligned at once; pairs that a task counts before it hands them on; pairs of a block of the table of counts.
CHARS, HELD, BLOCK = 1_000_000, 4 << 20, 1 << 20
#: Blocks of that table that a worker keeps at hand.
BLOCKS = 16


class Pieces:
    """A byte-level BPE file: the ids of a text, and the bytes of each."""

    def __init__(self, path: str):
        bpe = ByteBpe(path)
        self.enc = bpe.enc
        self.library = bpe.library
        self.library.encode_special_tokens = True
        table: dict[int, bytes] = {}
        for b in self.enc.token_byte_values():
            table[self.enc.encode_single_token(b)] = b
        self.bytes = [table.get(i, b"") for i in range(self.enc.n_vocab)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for t in texts:
            try:
                out.append(self.enc.encode_to_numpy(t, allowed_special=set(), disallowed_special=()))
            except ValueError:  # its pattern gives up on hundreds of thousands of blanks in a row
                out.append(np.array(self.library.encode(t, add_special_tokens=False).ids, np.uint32))
        return out


class Sentence:
    """A sentencepiece model, likewise. It puts a blank before a text by itself."""

    def __init__(self, path: str):
        self.enc = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.enc.vocab_size()
        self.bytes = [bytes([int(p[3:5], 16)]) if self.enc.is_byte(i) else b"" if self.enc.is_control(i) or self.enc.is_unknown(i) else p.replace("▁", " ").encode("utf-8") for i in range(n) for p in [self.enc.id_to_piece(i)]]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.uint32) for x in self.enc.encode(texts, num_threads=1)] if texts else []


def _decimals(n: int, inner: str) -> tuple[np.ndarray, np.ndarray]:
    """ASCII rows of "id<inner>" (row 2 id) and "id<outer>" (row 2 id + 1), filled up with zero bytes; outer is "|" after A tokens, ";" after B tokens."""
    rows = np.array([f"{i}{c}".encode() for i in range(n) for c in inner], "S")
    flat = rows.view(np.uint8).reshape(len(rows), -1)
    return flat, (flat != 0).sum(axis=1)


class Pair:
    """Two tokenizers with what alignment needs of their vocabularies."""

    def __init__(self, a: str, b: str):
        self.a, self.b = Pieces(a), Sentence(b)
        self.size_a, self.size_b = (np.array(list(map(len, x.bytes)), np.int64) for x in (self.a, self.b))
        self.times = len(self.b.bytes)
        if len(self.a.bytes) * self.times > 1 << 32:
            raise ValueError("the vocabularies are too large for pairs of 32 bits")
        width = max(len(str(len(self.a.bytes))), len(str(self.times))) + 1
        pad = lambda x: np.pad(x, ((0, 0), (0, width - x.shape[1])))
        self.text_a, self.long_a = _decimals(len(self.a.bytes), ",|")
        self.text_b, self.long_b = _decimals(self.times, ",;")
        self.text_a, self.text_b = pad(self.text_a), pad(self.text_b)

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of both sides of each text; None where a text is null or empty or a side's bytes aren't those of a blank and the text."""
        some = [i for i, t in enumerate(texts) if t]
        whole = [f" {texts[i]}" for i in some]
        out: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(texts)
        piece_a, piece_b = self.a.bytes.__getitem__, self.b.bytes.__getitem__
        for i, w, x, y in zip(some, whole, self.a.encode(whole), self.b.encode([texts[i] for i in some])):
            raw = w.encode("utf-8", "surrogatepass")
            if b"".join(map(piece_a, x.tolist())) == raw == b"".join(map(piece_b, y.tolist())):
                out[i] = x, y
        return out


def pair_of(a: str, b: str) -> Pair:
    return model("pair", (a, b), lambda: Pair(a, b))


class Bits:
    """A packed bitset with rank and select."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @classmethod
    def of(cls, places: np.ndarray, size: int) -> Bits:
        row = np.zeros(-(-size // 64) * 64, np.uint8)
        row[places] = 1
        return cls(np.packbits(row, bitorder="little").view("<u8"))

    def select(self) -> np.ndarray:
        """The places of all bits."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many bits lie before each place."""
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at >> 6] + np.bitwise_count(self.words[at >> 6] & below)


class Aligned(NamedTuple):
    """Of texts behind one another: first A and B token of each group and one past the last, links as token numbers, and where each text ends in all of them."""

    group_a: np.ndarray
    group_b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    groups: np.ndarray
    links: np.ndarray


def align(size_a: np.ndarray, size_b: np.ndarray, size_texts: np.ndarray) -> Aligned:
    """From the byte lengths of both sides' tokens of texts that lie behind one another, and those of the texts."""
    end_a, end_b, end_t = (np.cumsum(x) for x in (size_a, size_b, size_texts))
    n = int(end_t[-1]) if len(end_t) else 0
    a, b = Bits.of(end_a - 1, n), Bits.of(end_b - 1, n)
    cuts, ends = Bits(a.words & b.words), Bits(a.words | b.words)
    at, last = cuts.select(), ends.select()
    zero = np.zeros(1, np.int64)
    return Aligned(
        np.concatenate([zero, a.rank(at) + 1]),
        np.concatenate([zero, b.rank(at) + 1]),
        a.rank(last),
        b.rank(last),
        np.concatenate([zero, cuts.rank(end_t - 1) + 1]),
        np.concatenate([zero, ends.rank(end_t - 1) + 1]),
    )


def _written(p: Pair, a: np.ndarray, b: np.ndarray, got: Aligned) -> list[bytes]:
    """The groups of each text, as ``a1,a2|b1;a3|b2,b3``."""
    n_a, n_b = np.diff(got.group_a), np.diff(got.group_b)
    of_a, of_b = np.repeat(np.arange(len(n_a)), n_a), np.repeat(np.arange(len(n_b)), n_b)
    last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    last_a[got.group_a[1:] - 1], last_b[got.group_b[1:] - 1] = 1, 1
    row_a, row_b = 2 * a.astype(np.int64) + last_a, 2 * b.astype(np.int64) + last_b
    to_a, to_b = np.arange(len(a)) + got.group_b[of_a], np.arange(len(b)) + got.group_a[of_b + 1]
    cells = np.empty((len(a) + len(b), p.text_a.shape[1]), np.uint8)
    cells[to_a], cells[to_b] = p.text_a[row_a], p.text_b[row_b]
    width = np.empty(len(cells), np.int64)
    width[to_a], width[to_b] = p.long_a[row_a], p.long_b[row_b]
    at = np.concatenate([[0], np.cumsum(width)])[(got.group_a + got.group_b)[got.groups]].tolist()
    cells = cells.reshape(-1)
    flat = cells[cells != 0].tobytes()
    return [flat[i : j - 1] for i, j in zip(at, at[1:])]


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, sorted, and how often each is there."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def _texts(p: Pair, texts: list) -> Iterator[tuple]:
    """By text: tokens of A and of B, groups, links, their digest, its distinct pairs and how often each is linked."""
    for i, j in chunks_of(texts, CHARS):
        ids = p.encode(texts[i:j])
        some = [x for x in ids if x is not None]
        if some:
            a, b = (np.concatenate([x[k] for x in some]) for k in (0, 1))
            n_a, n_b = (np.array([len(x[k]) for x in some]) for k in (0, 1))
            size_a = p.size_a[a]
            got = align(size_a, p.size_b[b], np.add.reduceat(size_a, np.cumsum(n_a) - n_a))
            codes = a[got.link_a].astype(np.uint64) * np.uint64(p.times) + b[got.link_b].astype(np.uint64)
            n_links = np.diff(got.links)
            pairs, times = _distinct(np.repeat(np.arange(len(some), dtype=np.uint64), n_links) << np.uint64(32) | codes)
            of = np.searchsorted(pairs, np.arange(len(some) + 1, dtype=np.uint64) << np.uint64(32)).tolist()
            pairs, times = (pairs & np.uint64(0xFFFFFFFF)).astype("<u4"), times.astype("<u4")
            text = iter(zip(n_a.tolist(), n_b.tolist(), np.diff(got.groups).tolist(), n_links.tolist(), _written(p, a, b, got), zip(of, of[1:])))
        for x in ids:
            if x is None:
                yield 0, 0, 0, 0, "", b"", b""
            else:
                *n, s, (u, v) = next(text)
                yield *n, hashlib.sha256(s).hexdigest(), pairs[u:v].tobytes(), times[u:v].tobytes()


def groups(docs: DataFrame, a: str, b: str, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, groups array<struct<a array<int>, b array<int>>>): the shortest runs of tokens of both sides that cover the same bytes, in order.

    Null where the text is null or empty or a side's bytes aren't those of a blank and the text. Repeated rows each give one.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(keys: list, texts: list) -> dict:
        p = pair_of(a, b)
        out = []
        for t in texts:
            (x,) = p.encode([t])
            if x is None:
                out.append(None)
                continue
            size = p.size_a[x[0]]
            got = align(size, p.size_b[x[1]], size.sum(keepdims=True))
            ga, gb = got.group_a.tolist(), got.group_b.tolist()
            va, vb = x[0].tolist(), x[1].tolist()
            out.append([{"a": va[i:j], "b": vb[k:m]} for i, j, k, m in zip(ga, ga[1:], gb, gb[1:])])
        return {"key": keys, "groups": out}

    got = map_columns(docs, [key, text], run, f"key {kind}, groups array<struct<a: array<int>, b: array<int>>>")
    return got.withColumnRenamed("key", key)


def _batches(df: DataFrame, fn, schema: str) -> DataFrame:
    ship_package(df.sparkSession)
    kind = _parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(kind)
        for got in fn(b for whole in batches for b in slices(whole)):
            yield pa.RecordBatch.from_arrays([pa.array(got[x.name], type=x.type) for x in out], schema=out)

    return df.mapInArrow(run, kind)


def _flat(column: pa.Array, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all cells of a binary column, and where each cell starts."""
    whole = column.to_pylist()
    return np.frombuffer(b"".join(whole), dtype), np.concatenate([[0], np.cumsum([len(x) for x in whole], dtype=np.int64) // np.dtype(dtype).itemsize])


def pair_counts(texts: DataFrame, times: int) -> DataFrame:
    """(a, code, n, best): in how many texts each pair of ids is linked, and whether no other pair of its A id is in more.

    Tasks add up what they have, so that a frequent pair is one row a task.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        codes, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        wait: list[np.ndarray] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            new, m = _distinct(np.concatenate([np.zeros(0, "<u4"), *wait]))
            wait.clear()
            both, at = np.unique(np.concatenate([codes, new.astype(np.int64)]), return_inverse=True)
            total = np.zeros(len(both), np.int64)
            np.add.at(total, at, np.concatenate([n, m]))
            return both, total

        for b in batches:
            wait.append(_flat(b.column(0), "<u4")[0])
            if sum(map(len, wait)) > HELD:
                codes, n = merged()
                if len(codes) > HELD:
                    yield {"code": codes, "n": n}
                    codes, n = codes[:0], n[:0]
        codes, n = merged()
        yield {"code": codes, "n": n}

    got = _batches(texts.select("pairs"), count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    got = got.withColumn("a", F.floor(F.col("code") / F.lit(times)))
    top = got.groupBy("a").agg(F.max("n").alias("top"))
    return got.join(top, "a").select("a", "code", "n", (F.col("n") == F.col("top")).alias("best"))


class Counts:
    """The table of pair counts as sorted flat files of bounded blocks, of which a worker maps or reads those that it needs."""

    def __init__(self, root: str, blocks: list[tuple[int, int]]):
        self.folder, self.number, self.first = Folder(root), [b for _, b in blocks], np.array([f for f, _ in blocks], np.int64)
        self.block = functools.lru_cache(BLOCKS)(self._block)

    def _block(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return tuple(self.folder.numbers(f"{self.number[k]}.{name}", kind) for name, kind in (("code", "<u4"), ("n", "<u8"), ("best", "<u1")))  # type: ignore[return-value]

    def get(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n, best) of sorted codes, all of which are there."""
        n, best = np.empty(len(codes), np.int64), np.empty(len(codes), np.int64)
        cuts = [*np.searchsorted(codes, self.first).tolist(), len(codes)]
        for k, (i, j) in enumerate(zip(cuts, cuts[1:])):
            if i < j:
                known, ns, bests = self.block(k)
                at = np.searchsorted(known, codes[i:j].astype("<u4"))
                if (known[np.minimum(at, len(known) - 1)] != codes[i:j]).any():
                    raise ValueError("a pair has no count")
                n[i:j], best[i:j] = ns[at], bests[at]
        return n, best

    @staticmethod
    def write(table: DataFrame, root: str, block: int, rows: int) -> list[tuple[int, int]]:
        """(first code, number) of each block, in order; ``table`` has so many rows."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            from pyspark import TaskContext

            to, k = Folder(root), 0
            part, wait, held = TaskContext.get().partitionId(), [], 0

            def out() -> tuple[int, int]:
                t = pa.Table.from_batches(wait)
                name = (part << 20) + k
                for c, kind in (("code", "<u4"), ("n", "<u8"), ("best", "<u1")):
                    with to.new(f"{name}.{c}") as f:
                        f.write(t[c].to_numpy().astype(kind).tobytes())
                return t["code"][0].as_py(), name

            for b in batches:
                wait.append(b)
                held += len(b)
                if held >= block:
                    first, name = out()
                    yield {"first": [first], "name": [name]}
                    wait, held, k = [], 0, k + 1
            if held:
                first, name = out()
                yield {"first": [first], "name": [name]}

        n = max(1, -(-rows // block))
        ranges = table.select("code", "n", F.col("best").cast("int").alias("best")).repartitionByRange(n, "code").sortWithinPartitions("code")
        return sorted((r.first, r.name) for r in _batches(ranges, run, "first long, name long").toLocalIterator())


def alignment(docs: DataFrame, a: str, b: str, *, text: str = "text", key: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row a row of ``docs``.

    Texts that are null or empty, or of which a side's joined bytes aren't those of a blank and the text, have no tokens: zeros and an
    empty digest. Repeated rows count as documents of their own. Texts are encoded once; their distinct pairs are
    written, counted, and looked up in sorted blocks of the counts, so that neither pairs nor counts need to fit anywhere.
    """
    spark, kind = docs.sparkSession, docs.schema[key].dataType.simpleString()
    cols = ["key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
    times = sentencepiece.SentencePieceProcessor(model_file=b).vocab_size()

    def run(keys: list, texts: list) -> dict:
        return dict(zip(cols, [keys, *map(list, zip(*_texts(pair_of(a, b), texts)))]))

    with Scratch(spark) as scratch:
        got = map_columns(docs, [key, text], run, f"key {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary")
        got = scratch.keep(got)
        table = scratch.keep(pair_counts(got, times))
        at = qualified(spark, scratch.place())
        blocks = Counts.write(table, at, block, table.count())

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            for x in batches:
                codes, start = _flat(x.column("pairs"), "<u4")
                often = _flat(x.column("times"), "<u4")[0].astype(np.int64)
                known, back = np.unique(codes, return_inverse=True)
                n, best = model("counts", at, lambda: Counts(at, blocks)).get(known.astype(np.int64))
                sums = [np.concatenate([[0], np.cumsum(often * v[back])]) for v in (n, best)]
                out = {c: x.column(c) for c in cols[:6]}
                yield out | {"count_sum": np.diff(sums[0][start]), "n_best": np.diff(sums[1][start])}

        out = _batches(got, look, f"key {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
        return final(out.withColumnRenamed("key", key))


def op12(docs: DataFrame, a: str, b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; see ``alignment``."""
    return alignment(docs, a, b)
