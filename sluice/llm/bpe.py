"""Exact BPE encoding by dynamic programming over prefixes, for a word-level BPE file with an end-of-word suffix.

Merging a word greedily and looking at its prefixes has a useful property: the encoding of every prefix ends in
one token that, with what precedes it, is already final. So one pass suffices. A suffix automaton of the
vocabulary yields, at each prefix, the tokens that end there, longest first; the first that is compatible with
the last token before it is the prefix's last token. Following these back from the end gives the ids.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata

import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .arrow import map_columns
from .common import model
from .packing import byte_alphabet

MEMO = 150_000
#: Chunks with more characters are not kept, so that a memo's size is bounded in bytes too.
LONG = 64
#: How files of this kind split text into words (fixed values of the format).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SUFFIX = "</w>"
_NEVER = 1 << 60


class SuffixAutomaton:
    """Of many strings of small integers. ``token[s]``: the string that state s stands for, or -1; ``up[s]``: the nearest shorter one."""

    def __init__(self, strings: list[tuple[int, ...]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.token = [-1], [0], [-1]
        for i, s in enumerate(strings):
            last = 0
            for c in s:
                last = self._extend(last, c)
            self.token[last] = i
        self.up = [0] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            p = self.link[s]
            self.up[s] = p if self.token[p] >= 0 else self.up[p]

    def _add(self, length: int, link: int, nxt: dict[int, int]) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        self.token.append(-1)
        return len(self.next) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """The state of p's longest string followed by c, cut out of q if q also holds longer ones."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._add(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, self.next[last][c], c)
        cur, p = self._add(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            self.link[cur] = self._split(p, self.next[p][c], c)
        return cur


class WordBpe(dict):
    """Chunk without blanks to (ids in decimal, token strings), each joined by spaces, with a memo of two bounded generations."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        back = byte_alphabet()
        self.shown = {b: c for c, b in back.items()}
        self.names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.find = regex.compile(WORDS).findall
        n = 1 + max(vocab.values())
        #: merge rank of each token (-1: a single byte), the two tokens it comes from, and the rank of each pair
        self.rank, self.left, self.right, self.pair = [-1] * n, [-1] * n, [-1] * n, {}
        for r, m in enumerate(merges):
            a, b = m if isinstance(m, list) else m.split(" ")
            x, y = vocab[a], vocab[b]
            t = vocab[a + b]
            if self.rank[t] >= 0 or max(self.rank[x], self.rank[y]) >= r:
                raise ValueError(f"merge {r} makes a token that another makes, or comes before its parts")
            self.rank[t], self.left[t], self.right[t], self.pair[x, y] = r, x, y, r
        valid = [True] * n
        for r, m in enumerate(merges):
            a, b = m if isinstance(m, list) else m.split(" ")
            t = vocab[a + b]
            valid[t] = valid[self.left[t]] and valid[self.right[t]] and self._compatible(self.left[t], self.right[t], r)
        self.ids_of, strings = [], []
        for t, i in vocab.items():
            if t not in self.special and valid[i]:
                word = t.endswith(SUFFIX) and t != SUFFIX
                s = [back[c] for c in (t[: -len(SUFFIX)] if word else t)]
                if word:
                    s[-1] += 256
                self.ids_of.append(i)
                strings.append(tuple(s))
        if n >= 1 << 24 or len({c for x in strings for c in x if len(x) == 1}) < 512:
            raise ValueError("the vocabulary is too large or lacks a byte")
        sam = self.sam = SuffixAutomaton(strings)
        #: by state the (id, length) of the tokens that end where its longest string does, longest first; part: without that string
        self.full: list[tuple] = [()] * len(sam.next)
        self.part: list[tuple] = [()] * len(sam.next)
        for u in sorted(range(1, len(sam.next)), key=sam.length.__getitem__):
            self.part[u] = self.full[sam.up[u]]
            self.full[u] = ((self.ids_of[sam.token[u]], sam.length[u]), *self.part[u]) if sam.token[u] >= 0 else self.part[u]
        self.known: dict[int, bool] = {}
        self.old: dict[str, tuple[str, str]] = {}
        self.get = self.__getitem__

    def _compatible(self, a: int, b: int, before: int = _NEVER) -> bool:
        """Whether tokens a and b stay apart when their text is merged as one.

        The merges inside both are taken back from the last on. A pair that meets at the border would have been
        joined if its rank came before that of the merge taken back: strictly before on the left side, and also
        at the same rank on the right side, since equal merges go from left to right.
        """
        rank, pair = self.rank, self.pair
        while True:
            if pair.get((a, b), _NEVER) < before:
                return False
            x, y = rank[a], rank[b]
            if x > y:
                before, a = x, self.right[a]
            elif y >= 0:
                before, b = y + 1, self.left[b]
            else:
                return True

    def word(self, text: str) -> list[int]:
        """The ids of one word."""
        s = list(text.encode("utf-8", "surrogatepass"))
        s[-1] += 256
        known, full, part = self.known, self.full, self.part
        nxt, link, length = self.sam.next, self.sam.link, self.sam.length
        last, size = [-1], [0]
        state = held = 0
        for i, c in enumerate(s, 1):
            row = nxt[state]
            while c not in row:  # ends at the root, which has every symbol
                state = link[state]
                held, row = length[state], nxt[state]
            state, held = row[c], held + 1
            for t, n in full[state] if held == length[state] else part[state]:
                p = i - n
                if not p:
                    break
                q = last[p] << 24 | t
                ok = known.get(q)
                if ok is None:
                    if len(known) >= MEMO:
                        known.clear()
                    ok = known[q] = self._compatible(last[p], t)
                if ok:
                    break
            else:
                raise ValueError(f"no token ends at {i} of {text!r}")
            last.append(t)
            size.append(n)
        out, i = [], len(s)
        while i:
            out.append(last[i])
            i -= size[i]
        return out[::-1]

    def __missing__(self, chunk: str) -> tuple[str, str]:
        out = self.old.get(chunk)
        if out is None:
            mark = chunk[-1] if chunk[-1] in ",." else ""
            body = chunk[: len(chunk) - len(mark)]
            if body.isalpha() and max(body) < "\u0250" and "\u0130" not in body:  # Latin letters, then a mark at most: no pattern is needed
                words = [body.lower(), mark] if mark else [body.lower()]
            else:
                words = self.words(chunk)
            if words == [chunk]:
                ids = self.word(chunk)
                out = " ".join(map(str, ids)), " ".join([self.names[i] for i in ids])
            elif len(words) == 1:
                return self[words[0]]
            else:
                parts = [self[w] for w in words]
                out = " ".join([p[0] for p in parts]), " ".join([p[1] for p in parts])
                if len(chunk) > 6:  # mostly a word with a mark; its words are kept
                    return out
        if len(chunk) > LONG:
            return out
        if len(self) >= MEMO:  # what was used since the last time stays at hand
            self.old = dict(self)
            self.clear()
        self[chunk] = out
        return out

    @functools.cached_property
    def library(self) -> Tokenizer:
        """The file's own normaliser and splitter, for characters that are newer than this Python's tables."""
        return Tokenizer.from_file(self.path)

    def words(self, chunk: str) -> list[str]:
        """The words of a chunk, lower-cased and in composed form."""
        if not chunk.isascii():
            if any(unicodedata.category(c) == "Cn" for c in chunk):
                chunk = self.library.normalizer.normalize_str(chunk)
                return [chunk[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(chunk)]
            if not unicodedata.is_normalized("NFC", chunk):
                chunk = unicodedata.normalize("NFC", chunk)
        return self.find(chunk.lower() if "Σ" not in chunk else "".join([c.lower() for c in chunk]))

    def encode(self, text: str | None) -> tuple[str, str]:
        """(ids, tokens) of a text, each joined by spaces; tokens so joined are the decoded text, as the file names no decoder."""
        ids, names = [], []
        for part in self.cut.split(text) if text and self.cut else [text]:
            if part in self.special:
                ids.append(str(self.special[part]))
                names.append(part)
            elif part:
                got = [g for g in map(self.get, filter(None, part.replace("\n", " ").split(" "))) if g[0]]
                ids += [g[0] for g in got]
                names += [g[1] for g in got]
        return " ".join(ids), " ".join(names)


def word_bpe(path: str) -> WordBpe:
    return model("word_bpe", path, lambda: WordBpe(path))


def encode(docs: DataFrame, tokenizer: str, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ids array<int>, decoded) of every whole text. Null and empty texts: no ids, an empty string. Repeated rows each give one."""
    kind = docs.schema[key].dataType.simpleString()

    def run(keys: list, texts: list) -> dict:
        enc = word_bpe(tokenizer).encode
        got = [enc(t) for t in texts]
        return {key: keys, "ids": [[int(i) for i in g[0].split()] for g in got], "decoded": [g[1] for g in got]}

    return map_columns(docs, [key, text], run, f"`{key}` {kind}, ids array<int>, decoded string")


def digest(docs: DataFrame, tokenizer: str, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): what ``encode`` gives, reduced where it is made."""
    kind = docs.schema[key].dataType.simpleString()
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()

    def run(keys: list, texts: list) -> dict:
        enc = word_bpe(tokenizer).encode
        got = [enc(t) for t in texts]
        return {key: keys, "n_tokens": [g[0].count(" ") + 1 if g[0] else 0 for g in got], "ids_sha256": [sha(g[0]) for g in got], "decoded_sha256": [sha(g[1]) for g in got]}

    return map_columns(docs, [key, text], run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text; null and empty texts have no tokens."""
    return digest(docs, tokenizer)
