"""Language identification by cross-parsing entropy.

For each language a bounded sample of labelled text gives a suffix automaton. A text is parsed greedily into
the longest phrases that occur in that sample; a phrase costs log2(sample length) bits, and the language with
the fewest bits a symbol wins. Every letter of every sample is a symbol, whatever the script; the automata's sparse rows
lie interleaved in one array, and numpy steps through many text segments at once.
"""

from __future__ import annotations

import functools
import math
import random

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import map_columns, row_filter
from .common import block_of, chunks_of, crc_fold, model

#: Symbols of the parse: 0 is any run of characters that aren't letters, 1 is a letter that no sample holds.
OTHER, UNSEEN = 0, 1
#: Texts are parsed in segments of so many symbols; each segment starts a phrase of its own.
SEGMENT = 1024
#: Languages that step together, which bounds a task's state, not the number of languages.
TOGETHER = 16


@functools.lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def automaton(s: np.ndarray) -> list[dict[int, int]]:
    """By state the transitions of the suffix automaton of ``s``; state 0 is the start."""
    nxt, link, length = [{}], [-1], [0]
    last = 0
    for c in s.tolist():
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


def interleaved(nxt: list[dict[int, int]], symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, target, restart) of an automaton; a state is known by the place where its row starts, and all places differ.

    A transition of state s by symbol c lies at s + c, where owner is s if there is one. Rows go to free places from a
    drawn one on, long rows first. The start has no row: ``restart`` has its transitions by symbol, 0 where it has none.
    States without transitions are the start, which is at 0, since both can only begin anew.
    """
    rows = sorted((i for i in range(1, len(nxt)) if nxt[i]), key=lambda i: -len(nxt[i]))
    places = max(64, 2 * sum(len(nxt[i]) for i in rows))
    draw = random.Random(places).randrange
    taken, begins = bytearray(places + symbols), bytearray(places)
    begins[0] = 1
    at = [0] * len(nxt)
    for i in rows:
        p, row = draw(places), list(nxt[i])
        while begins[p] or any(taken[p + c] for c in row):
            p = p + 1 if p + 1 < places else 0
        at[i] = p
        begins[p] = 1
        for c in row:
            taken[p + c] = 1
    owner, target, restart = np.full(places + symbols, -1, np.int32), np.zeros(places + symbols, np.int32), np.zeros(symbols, np.int32)
    for i in rows:
        for c, t in nxt[i].items():
            owner[at[i] + c], target[at[i] + c] = at[i], at[t]
    for c, t in nxt[0].items():
        restart[c] = at[t]
    return owner, target, restart


class CrossParser:
    """Parses texts against the samples of all languages. ``samples``: (language, text) pairs."""

    def __init__(self, samples: tuple[tuple[str, str], ...]):
        self.langs = [lang for lang, _ in samples]
        letters = _letters()
        coded = [_codes(t.lower()) for _, t in samples]
        known = np.unique(np.concatenate([c[letters[c]] for c in coded])) if coded else np.empty(0, np.uint32)
        self.lut = np.where(letters, UNSEEN, OTHER).astype(np.uint16 if len(known) < 65_000 else np.int32)
        self.lut[known] = np.arange(2, 2 + len(known))
        owners, targets, restarts, self.roots, self.bits, base = [], [], [], [], [], 0
        for c in coded:
            sym = self.symbols(c)
            owner, target, restart = interleaved(automaton(sym), 2 + len(known))
            owners.append(np.where(owner < 0, -1, owner + base))
            targets.append(target + base)
            restarts.append(restart + base)
            self.roots.append(base)
            self.bits.append(math.log2(max(2, len(sym))))
            base += len(owner)
        join = lambda x: np.concatenate(x) if x else np.empty(0, np.int32)
        self.owner, self.target, self.restart = join(owners), join(targets), np.stack(restarts) if restarts else np.empty((0, 2), np.int32)

    def symbols(self, codes: np.ndarray) -> np.ndarray:
        s = self.lut[codes]
        return s[~((s == OTHER) & np.concatenate([[False], s[:-1] == OTHER]))] if len(s) else s

    def costs(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Bits a symbol for each text and language; whether the text has a letter."""
        m = len(texts)
        raw = [(t or "").lower() for t in texts]
        lens = np.fromiter(map(len, raw), np.int64, m)
        codes = self.lut[_codes("".join(raw))].astype(np.int32)
        owner = np.repeat(np.arange(m, dtype=np.int32), lens)
        first = np.ones(len(owner), bool)
        first[1:] = owner[1:] != owner[:-1]
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != OTHER) | (codes[:-1] != OTHER) | first[1:]
        has = np.bincount(owner[codes != OTHER], minlength=m) > 0
        codes, lens = codes[keep], np.bincount(owner[keep], minlength=m)
        starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
        parts = -(-lens // SEGMENT)
        seg_doc = np.repeat(np.arange(m), parts)
        nth = np.arange(len(seg_doc)) - np.repeat(np.concatenate([[0], np.cumsum(parts)[:-1]]), parts)
        at = starts[seg_doc] + nth * SEGMENT
        size = np.minimum(SEGMENT, lens[seg_doc] - nth * SEGMENT)
        order = np.argsort(-size, kind="stable")
        at, size, seg_doc = at[order], size[order], seg_doc[order]
        phrases = np.concatenate([self._phrases(slice(i, i + TOGETHER), codes, at, size, seg_doc, m) for i in range(0, len(self.langs), TOGETHER)])
        return (phrases * np.array(self.bits)[:, None] / np.maximum(1, lens)).T, has

    def _phrases(self, langs: slice, codes: np.ndarray, at: np.ndarray, size: np.ndarray, seg_doc: np.ndarray, m: int) -> np.ndarray:
        """Phrases of each text against some languages, which step together; segments come the longest first."""
        owner, target, restart = self.owner, self.target, self.restart[langs]
        state = np.repeat(np.array(self.roots[langs], np.int32)[:, None], len(at), axis=1)
        begun = np.zeros(state.shape, np.int32)
        steps = np.arange(int(size[0]) if len(size) else 0)
        for t, live in zip(steps.tolist(), np.searchsorted(-size, -steps, side="left").tolist()):
            c, now = codes.take(at[:live] + t, mode="clip"), state[:, :live]
            cell = now + c
            miss = owner.take(cell, mode="clip") != now
            begun[:, :live] += miss
            after = target.take(cell, mode="clip")
            np.copyto(after, restart.take(c, axis=1, mode="clip"), where=miss)
            state[:, :live] = after
        return np.array([np.bincount(seg_doc, e, minlength=m) for e in begun])


def parser(samples: tuple[tuple[str, str], ...]) -> CrossParser:
    return model("langid", samples, lambda: CrossParser(samples))


def learn(docs: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id", where=None, sample_docs: int = 200, sample_chars: int = 24_000, block_chars: int = 4_000, most_langs: int = 1_000) -> tuple[tuple[str, str], ...]:
    """(language, sample text) pairs from labelled documents.

    The only bounded read of the engine's language ID: about twice ``sample_docs`` rows a language, chosen by a
    hash of id and text, of each a block of at most ``block_chars`` characters at a place that the id's hash chooses, and
    ``sample_chars`` in all, so that what the driver and a worker hold is bounded (about 1 MB a language). Rows with one
    id or a null id are drawn each by itself; of equal rows, drawn together, at most four times ``sample_docs`` a language
    reach the driver. Samples are
    the same size whatever the number of languages; more than ``most_langs`` are an error, not a cut. Rows with a null
    text or language teach nothing; texts that are empty or hold no letter add none.
    """
    rows = docs if where is None else docs.where(where)
    rows = rows.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("l"), F.col(key).alias("k"), F.col(text).alias("t"))
    counts = rows.groupBy("l").count()
    n = {r[0]: r[1] for r in counts.limit(most_langs + 1).collect()}
    if len(n) > most_langs:
        raise ValueError(f"more than {most_langs} languages in the labels")
    if not n:
        return ()
    share = F.element_at(F.create_map(*[F.lit(x) for name, m in n.items() for x in (name, min(1.0, 2 * sample_docs / m))]), F.col("l"))
    draw = F.pmod(F.xxhash64(F.lit(7), F.col("k").cast("string"), F.col("t")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = rows.where(draw < share).select("l", F.xxhash64(F.lit(11), F.col("k"), F.col("t")).alias("h"), block_of("t", "k", block_chars, 13).alias("t"))
    nth = F.row_number().over(Window.partitionBy("l").orderBy("h"))  # cut in every task before the shuffle
    got: dict[str, list] = {}
    for r in drawn.withColumn("nth", nth).where(F.col("nth") <= 4 * sample_docs).drop("nth").collect():
        got.setdefault(r.l, []).append((r.h, r.t))
    return tuple((name, "\n".join(t for _, t in sorted(got[name]))[:sample_chars]) for name in sorted(got))


def predictions(texts: list, samples: tuple[tuple[str, str], ...], sharpness: float = 12.0) -> tuple[list[str], np.ndarray]:
    """Language and score of each text; ``und`` and 0 without a letter or without samples.

    The score is the softmax of the costs' differences; ties go to the language that sorts first.
    """
    pred, score = ["und"] * len(texts), np.zeros(len(texts))
    if samples:
        p = parser(samples)
        for a, b in chunks_of(texts):
            cost, has = p.costs(texts[a:b])
            best = cost.argmin(axis=1)
            s = 1 / np.exp(-sharpness * (cost - cost.min(axis=1, keepdims=True))).sum(axis=1)
            score[a:b] = np.where(has, s, 0.0)
            pred[a:b] = [p.langs[j] if h else "und" for j, h in zip(best, has)]
    return pred, score


def accepted(docs: DataFrame, samples: tuple[tuple[str, str], ...], *, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` in a learned language with a score of at least ``least``, all columns as they are; nothing is shuffled.

    Null and empty texts and those without a letter are in none and go; repeated rows are decided on alike.
    """

    def known(texts: list) -> list:
        pred, score = predictions(texts, samples)
        return [p != "und" and s >= least for p, s in zip(pred, score)]

    return row_filter(docs, text, known)


def identify(docs: DataFrame, samples: tuple[tuple[str, str], ...], *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, lang_pred, score) of every document, over its whole text.

    Null texts and texts without a letter: ``und`` with score 0. Without samples all are ``und``. Repeated rows each give one.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(keys: list, texts: list) -> dict:
        pred, score = predictions(texts, samples)
        return {key: keys, "lang_pred": pred, "score": score}

    return map_columns(docs, [key, text], run, f"`{key}` {kind}, lang_pred string, score double")


def op10(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from folds other than 2 of 4."""
    samples = learn(docs, where=F.coalesce(crc_fold("doc_id", 4) != 2, F.lit(False)))
    out = identify(docs, samples)
    return out.select("doc_id", F.coalesce(crc_fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
