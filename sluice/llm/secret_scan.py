"""Secret scans: three fixed patterns, and sliding-window Shannon entropy over candidate strings.

A candidate is a run of key-like characters with a letter, cut where a span of the fixed patterns or an assigned value
begins or ends, so that a key is judged by itself whether a pattern has it or not. Its parts between ``/ _ - =`` each have
their own class, so that a prefix, a path or a slug doesn't decide for what stands beside it. A window moves over a part, its
character counts kept by one addition and one removal a step; where the entropy of a window reaches its class's bound, the
window belongs to a span, if letters and digits alternate in it as in random keys or its letter pairs are unlike those of
words; hexadecimal digits need neither. A second pass over the whole run finds keys that hold the separators themselves:
what it finds needs a window with small and capital letters and digits as well, and is taken to the ends of its parts. An
allow-list keeps known harmless forms out.
"""

from __future__ import annotations

import bisect
import functools
import math
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .arrow import map_columns, slices

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Maximal runs; those under 32 characters fail and can be left out of the pattern, as no other match starts in them.
HEX = re.compile(r"[0-9a-f]{32,}")
HINTS = ("password", "passwd", "secret", "token", "api_key", "apikey")
KINDS = ("assign", "access", "hex", "entropy")

RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
PART = re.compile(r"[^/_=-]+")
#: Class: characters, window, and bits of entropy from which a window counts (the 0.1 % quantile of random windows over 16,
#: 22, 36 and 62 characters). The first that fits counts.
CLASSES = (
    ("hex", re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)"), 24, 2.86),
    ("hex", re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)"), 20, 2.72),
    ("hex", re.compile(r"[0-9a-fA-F]+"), 20, 2.8),
    ("one case", re.compile(r"(?:[a-z0-9]+|[A-Z0-9]+)"), 20, 3.14),
    ("alnum", re.compile(r"[A-Za-z0-9]+"), 20, 3.48),
    ("base64", re.compile(r"[A-Za-z0-9+/_=-]+"), 20, 3.48),
)
#: Frequent letter pairs of words.
PAIRS = frozenset(
    "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur "
    "ei ie un ge ic sc da di us ns em au eu el la ai qu ue ui ux ta tr pr pe po pa no na ni ss tt et ir il ol ul ut am im id ad os so su sh wh ho "
    "we wa wi ke ki ct ec ac ca ci cr do du ee ef fi fo fr ff ga gr gl gu ht ig gh iv ja ka kl ko lo lu ly mi mo mu nc nu oo op ot ow pl pp rt rs rd sp ts tu "
    "ty ul um up va vi vo za zu ze ry ld lt be bl bo br bi ba bu ev ex ey ep em ab ag ap av ay ob od og ov ub ud ug ip".split()
)
#: Forms that look random and are public by nature.
ALLOW = (
    re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", re.I),  # UUID
    re.compile(r"sha(1|256|384|512)-[A-Za-z0-9+/=]+"),  # subresource integrity
    re.compile(r"(?i).*(example|sample|placeholder|changeme|dummy|xxxx)"),
    re.compile(r"[0-9_/+=-]+"),  # numbers, dates and paths of numbers
    # paths, slugs and identifiers: short words, numbers, and words with a number behind
    re.compile(r"(?:(?:[A-Za-z][a-z]{0,14}|[A-Z]{1,12})?[0-9]{0,4}(?:[/_+=-]+|$))+"),
)
_CLOG = [0.0] + [c * math.log2(c) for c in range(1, 257)]


def entropy_spans(s: str, width: int, bound: float) -> list[tuple[int, int]]:
    """Merged windows of ``s`` of ``width`` characters whose Shannon entropy is at least ``bound`` bits."""
    n, counts, total, out = len(s), {}, 0.0, []
    need = (math.log2(width) - bound) * width + 1e-9  # H = log2 w - sum(c log2 c) / w
    for i, c in enumerate(s):
        k = counts.get(c, 0)
        total += _CLOG[k + 1] - _CLOG[k]
        counts[c] = k + 1
        if i >= width:
            o = s[i - width]
            k = counts[o]
            total += _CLOG[k - 1] - _CLOG[k]
            counts[o] = k - 1
        if i >= width - 1 and total <= need:
            a = i - width + 1
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((a, i + 1))
    return out if n >= width else []


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and non-overlapping within a kind."""
    out = []
    low = text.lower()
    if any(h in low for h in HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


_LETTER = re.compile(r"[A-Za-z]")


def unlike_words(s: str, width: int, changes: int = 4) -> list[tuple[int, int]]:
    """Merged windows of ``s`` in which fewer than 45 % of the letter pairs, three or more, are frequent in words, or in
    which letters and digits meet ``changes`` times or more."""
    pairs = [x.isalpha() and y.isalpha() for x, y in zip(s, s[1:])]
    # a capital after a small letter is as in words if two small letters follow
    known = [p and (s[i + 2 : i + 4].islower() if s[i].islower() and s[i + 1].isupper() else s[i : i + 2].lower() in PAIRS) for i, p in enumerate(pairs)]
    meet = [x.isalnum() and y.isalnum() and x.isalpha() != y.isalpha() for x, y in zip(s, s[1:])]
    out: list[tuple[int, int]] = []
    n, k, m = sum(pairs[: width - 1]), sum(known[: width - 1]), sum(meet[: width - 1])
    for a in range(len(s) - width + 1):
        if m >= changes or n >= 3 and k < 0.45 * n:
            out[-1:] = [(out[-1][0], a + width)] if out and a <= out[-1][1] else [*out[-1:], (a, a + width)]
        if a + width < len(s):
            n += pairs[a + width - 1] - pairs[a]
            k += known[a + width - 1] - known[a]
            m += meet[a + width - 1] - meet[a]
    return out


def is_mixed(s: str, width: int) -> bool:
    """Whether a window of ``s`` has a small letter, a capital and a digit."""
    last = [-width, -width, -width]
    for i, c in enumerate(s):
        if c.isalnum():
            last[0 if c.islower() else 1 if c.isupper() else 2] = i
        if i >= width - 1 and min(last) > i - width:
            return True
    return False


def _inside(s: str, spans: list[tuple[int, int]], width: int, test: Callable[[str, int], list[tuple[int, int]]]) -> list[tuple[int, int]]:
    """What ``test`` finds in each span, in the places of ``s``."""
    return [(a + x, a + y) for a, b in spans for x, y in test(s[a:b], width)]


def _whole(parts: list[re.Match], starts: list[int], a: int, b: int) -> tuple[int, int]:
    """The span from where its first part begins, with the separators before it, to where its last part ends."""
    i, j = bisect.bisect_right(starts, a) - 1, bisect.bisect_left(starts, b) - 1
    if i < 0:
        a = 0
    elif parts[i].end() <= a:
        a = parts[i].end()
    else:
        a = parts[i - 1].end() if i else 0
    return a, max(b, parts[j].end())


def _random(s: str) -> list[tuple[int, int]]:
    """High-entropy spans of what the fixed patterns leave of a run."""
    if len(s) < 20 or not _LETTER.search(s) or any(r.fullmatch(s) or (r.pattern.startswith("(?i)") and r.match(s)) for r in ALLOW):
        return []
    found, parts = [], list(PART.finditer(s))
    for m in parts:
        t, at = m.group(), m.start()
        if len(t) >= 20 and _LETTER.search(t):
            name, _, width, bound = next(c for c in CLASSES if len(t) >= c[2] and c[1].fullmatch(t))
            spans = entropy_spans(t, width, bound)
            if name != "hex":
                spans = _inside(t, spans, width, unlike_words)
            found += [(at + a, at + b) for a, b in spans]
    if len(parts) > 1:
        _, _, width, bound = CLASSES[-1]
        starts = [m.start() for m in parts]
        spans = _inside(s, entropy_spans(s, width, bound), width, functools.partial(unlike_words, changes=5))
        found += [_whole(parts, starts, a, b) for a, b in spans if is_mixed(s[a:b], width)]
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def added_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the high-entropy spans, those inside base spans too; only the allow-list keeps a candidate out."""
    cuts = {x for a, k, b in base for x in ((a, b) if k else (a, ASSIGN.match(text, a, b).start(2), b))}
    order, k, out = sorted(cuts), 0, []
    for m in RUN.finditer(text):
        at, end = m.span()
        while k < len(order) and order[k] <= at:
            k += 1
        while at < end:
            stop = end
            if k < len(order) and order[k] < end:
                stop, k = order[k], k + 1
            out += [(at + x, 3, at + y) for x, y in _random(text[at:stop])]
            at = stop
    return out


def spans_of(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    if not text:
        return [], []
    base = base_spans(text)
    return base, sorted(base + added_spans(text, base))


def _say(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, spans): all spans of every whole text as array of struct(kind, start, end), in code points, end exclusive.

    Null and empty texts have none. Repeated rows each give one.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(keys: list, texts: list) -> dict:
        return {key: keys, "spans": [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans_of(t)[1]] for t in texts]}

    return map_columns(docs, [key, text], run, f"`{key}` {kind}, spans array<struct<kind:string,start:int,end:int>>")


def redact_text(text: str | None, mark: str = "<{}>") -> str | None:
    """The text with each span, overlapping ones joined, replaced by its first kind's name."""
    if not text:
        return text
    spans = spans_of(text)[1]
    if not spans:
        return text
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], mark.format(KINDS[k])]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, *, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """``docs`` with secrets in ``text`` replaced; other columns stay, but for a length column that follows the text.

    Null and empty texts stay as they are, and no row goes; repeated rows are each treated alike.
    """
    ship_package(docs.sparkSession)

    @F.arrow_udf("string")
    def clean(values: pa.Array) -> pa.Array:
        return pa.array([redact_text(t) for part in slices(values) for t in part.to_pylist()], pa.string())

    out = docs.withColumn(text, clean(F.col(text)))
    if n_chars and n_chars in docs.columns:
        out = out.withColumn(n_chars, F.when(F.col(text).isNotNull(), F.length(text)).otherwise(F.col(n_chars)).cast(docs.schema[n_chars].dataType))
    return out


def op3(docs: DataFrame) -> DataFrame:
    """doc_id, counts by base kind, digest of the base spans and all spans; null and empty texts have none."""

    def digest(spans):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))

    found = scan(docs)
    base = F.filter("spans", lambda s: s["kind"] != "entropy")
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(digest(base).cast("binary"), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"))
