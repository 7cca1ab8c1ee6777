"""Packing of token pieces into sequences: bounded-space online best fit.

A partition is packed on its own and in one pass: pieces go, the longest of each thousand documents first, to the
fullest open sequence that has room. Open sequences lie on stacks keyed by free space, and a bitset marks the stacks in use, so that a
piece costs a few integer operations. When all places for open sequences are taken, the fullest closes.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import tiktoken
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from tokenizers import Tokenizer

from .arrow import map_columns
from .common import model

#: The end-of-document id.
END = 2
#: How byte-level BPE files of this kind split text before merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level BPE files, and back to the byte."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteBpe:
    """A byte-level BPE file of the tokenizers library, run by tiktoken, which gives the same ids several times as fast."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = byte_alphabet()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(back[c] for c in tok): i for tok, i in spec["model"]["vocab"].items() if tok not in special}
        self.enc = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        try:
            got = self.enc.encode_to_numpy(text, allowed_special="all")
        except ValueError:  # tiktoken's pattern gives up on hundreds of thousands of blanks in a row
            got = np.array(self.library.encode(text, add_special_tokens=False).ids)
        return got.astype("<u4").tobytes()

    @functools.cached_property
    def library(self) -> Tokenizer:
        t = Tokenizer.from_file(self.path)
        t.no_truncation()
        t.no_padding()
        return t


def byte_bpe(path: str) -> ByteBpe:
    return model("byte_bpe", path, lambda: ByteBpe(path))


class Packer:
    """Online best fit with at most ``places`` open sequences of ``room`` tokens."""

    def __init__(self, room: int, places: int):
        self.room, self.places = room, places
        self.by_free: list[list[int]] = [[] for _ in range(room + 1)]
        self.bits = self.open = self.made = 0

    def put(self, size: int) -> tuple[int, int]:
        """(sequence, place in it) for a piece of 1 to ``room`` tokens."""
        fit = self.bits >> size
        if fit:
            free = size + (fit & -fit).bit_length() - 1
            stack = self.by_free[free]
            at = stack.pop()
            if not stack:
                self.bits ^= 1 << free
            self.open -= 1
        else:
            free, at = self.room, self.made
            self.made += 1
        left = free - size
        if left:
            if self.open >= self.places:
                full = (self.bits & -self.bits).bit_length() - 1
                if full <= left:
                    self.by_free[full].pop()
                    if not self.by_free[full]:
                        self.bits ^= 1 << full
                    self.open -= 1
                else:  # the new one is the fullest and closes at once
                    return at, self.room - free
            self.by_free[left].append(at)
            self.bits |= 1 << left
            self.open += 1
        return at, self.room - free


def pieces(n: int, room: int) -> Iterator[tuple[int, int]]:
    """(start, length) of a document of ``n`` ids: whole if it fits, else full pieces after a first that may be shorter."""
    at = 0
    if n > room and n % room:
        yield 0, n % room
        at = n % room
    while at < n:
        yield at, min(room, n - at)
        at += room


def pack(docs: DataFrame, tokenizer: str, *, text: str | Column = "text", key: str = "doc_id", room: int = 1024, places: int = 2048) -> DataFrame:
    """One row a piece: key, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is an empty one and gives a piece with the end id alone. Repeated rows are packed each. A
    sequence holds pieces of one partition of ``docs`` only, so nothing is shuffled and a lost task is redone
    alone; its number is unique in the result.
    """
    kind = docs.schema[key].dataType.simpleString()
    end = END.to_bytes(4, "little")

    def make():
        enc, packer, base = byte_bpe(tokenizer), Packer(room, places), TaskContext.get().partitionId() << 36

        def run(keys: list, texts: list) -> dict:
            rows = []
            for k, t in zip(keys, texts):
                ids = enc.ids(t) + end
                rows += [[k, i, a, n, zlib.crc32(ids[4 * a : 4 * (a + n)])] for i, (a, n) in enumerate(pieces(len(ids) // 4, room))]
            for r in sorted(rows, key=lambda r: -r[3]):
                at, off = packer.put(r[3])
                r += [base + at, off]
            return dict(zip((key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"), map(list, zip(*rows))))

        return run

    return map_columns(docs, [key, text], make, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long", per_task=True)


def op2(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Every piece of every document, with its place."""
    return pack(docs, tokenizer)
