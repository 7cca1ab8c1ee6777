"""Surrogates for personal data.

A detected entity is replaced by another of its type and format. Each format's values are numbered, and a keyed
permutation E of those numbers gives the surrogate D(E(x) + 1): a bijection without fixed points. So equal
entities get equal surrogates in all documents (coreference), different ones stay different, and none keeps its
value; no table of entities is needed and every task can work alone. ``collisions`` checks this over a corpus.
"""

from __future__ import annotations

import functools
import hashlib
import ipaddress
import os
import re
import secrets
from collections.abc import Callable, Iterator

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import map_columns
from .common import model

TYPES = ("email", "card", "ip", "ssn", "phone", "iban", "name")

# Given names by script and gender, and titles by gender.
GIVEN = {
    ("latin", "f"): (
        "Alice Amelie Andrea Angela Anna Anne Barbara Beatrice Carla Carmen Charlotte Claire Clara Claudia Diana Elena Elisabeth Emily Emma Eva Fatima Greta Hanna Heike Helena Ines Ingrid Irene "
        "Isabel Jane Jennifer Jessica Johanna Julia Karen Katharina Laura Lea Lena Linda Lisa Lucia Maria Marie Marta Mary Monika Nina Nora Olivia Patricia Paula Petra Sabine Sara Sarah Sofia Sophie Susan Ursula Vera"
    ).split(),
    ("latin", "m"): (
        "Adam Alex Alexander Andreas Anton Antonio Bruno Carlos Charles Christian Daniel David Dieter Emil Felix Francesco Frank Fritz George Hans Henri Henry Hugo Ivan Jack Jakob James Jan Jean "
        "Johannes John Jonas Jorge José Juan Karl Klaus Leo Lucas Luis Manuel Marco Mark Markus Martin Max Michael Miguel Mohammed Oliver Otto Paul Pedro Peter Pierre Robert Stefan Thomas Tom Walter William"
    ).split(),
    ("cyrillic", "f"): "Александра Анастасия Анна Валентина Вера Виктория Дарья Екатерина Елена Ирина Людмила Мария Наталья Нина Ольга Светлана Софья Татьяна Юлия".split(),
    ("cyrillic", "m"): "Александр Алексей Андрей Борис Виктор Владимир Дмитрий Евгений Иван Игорь Константин Максим Михаил Николай Олег Павел Пётр Сергей Юрий".split(),
    ("greek", "f"): "Αγγελική Βασιλική Δήμητρα Ειρήνη Ελένη Κατερίνα Μαρία Σοφία".split(),
    ("greek", "m"): "Αλέξανδρος Αντώνης Γιάννης Γιώργος Δημήτρης Κώστας Νίκος Παναγιώτης".split(),
}
# Given names of both genders, and as many names of either gender that stand for them.
UNISEX = "Alex Andrea Jan Jean Kim Nicola Robin Sascha".split()
STANDS = {"f": "Agnes Bettina Cecilia Dorothea Edith Flora Gisela Hedwig".split(), "m": "Albert Berthold Conrad Edgar Ferdinand Gustav Herbert Isidor".split()}
# Frequent surnames by script.
SURNAMES = {
    "latin": (
        "Smith Johnson Brown Jones Miller Davis Wilson Anderson Taylor Moore Jackson White Harris Clark Lewis Walker Hall Young King Wright "
        "Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Schulz Hoffmann Koch Bauer Richter Klein Wolf Neumann Schwarz Krüger "
        "García Fernández González López Martínez Sánchez Pérez Gómez Bernard Dubois Durand Leroy Moreau Laurent Rossi Russo Ferrari Bianchi Romano Ricci"
    ).split(),
    "greek": "Παπαδόπουλος Παππάς Βασιλείου Γεωργίου Ιωάννου Κωνσταντίνου".split(),
}
#: Script and gender of every listed given name; a title decides for names of both genders alone.
LISTED = {n: k for k, ns in GIVEN.items() for n in ns} | {n: ("latin", "f" if n == "Andrea" else "m") for n in UNISEX}
_SURNAME = {n: k for k, ns in SURNAMES.items() for n in ns}
#: Words that no spelled-out surrogate may become, as they are surrogates of others.
_TAKEN = frozenset({*LISTED, *_SURNAME, *STANDS["f"], *STANDS["m"]})
TITLES = {
    "f": "Mrs Ms Miss Frau Madame Mme Mademoiselle Señora Sra госпожа г-жа κυρία".split(),
    "m": "Mr Mister Herr Monsieur Señor Sr господин г-н κύριος".split(),
    "": "Dr Prof".split(),
}
#: Endings that carry a gender and stay.
ENDINGS = ("ская", "ский", "цкая", "цкий", "ова", "ева", "ина", "ов", "ев", "ин")
#: Letters that stand for each other, by script: vowels and the rest.
LETTERS = ("aeiou", "bdfglmnprst", "ckz", "hjvw", "qxy", "äöü", "áéíóú", "àèìòù", "âêîôû", "ãåëïõ", "çñ", "āąăēęěīįōőūůűų", "ćčďđğłńňřśšşťţźżž", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ")
_CLASS = {c: s for s in LETTERS for c in s}

_GENDER = {t: g for g, ts in TITLES.items() for t in ts}
#: A name's word: a capital and small letters with marks, again after inner capitals or an apostrophe (McDonald, O'Brien), or capitals alone.
_CASED = r"\p{Lu}(?:[\p{Ll}\p{M}]++(?:['’]?\p{Lu}[\p{Ll}\p{M}]++)*+|['’]\p{Lu}[\p{Ll}\p{M}]++)"
_CAPITALS = r"\p{Lu}(?:['’]?\p{Lu})++"
_ANY = rf"(?:{_CASED}|{_CAPITALS})(?!\w)"
#: Small words inside a name, which stay.
_PARTICLE = r"(?:(?:van|von|vom|zu|zum|zur|der|den|dem|de|del|della|di|da|dos|du|la|le|ter|ten|bin|ibn|al|el)\x20){0,3}"
_TITLE = "|".join(map(re.escape, sorted(_GENDER, key=len, reverse=True)))
TITLED = re.compile(rf"(?<![\w-])({_TITLE})\.?\x20")
#: What follows a title and its blank.
NAME = regex.compile(rf"(?:(?:{_TITLE})\.?\x20)?+(?:\p{{Lu}}\.\x20?){{0,3}}{_PARTICLE}{_ANY}(?:(?:\x20{_PARTICLE}|-){_ANY}){{0,2}}")
#: A listed given name, and the one or two capitalised words after it that make a name without a title.
FIRST = re.compile(rf"(?<![\w-])({'|'.join(sorted(LISTED, key=len, reverse=True))})(?!\w)")
BARE = regex.compile(rf"(?:(?:\x20{_PARTICLE}|-){_CASED}(?!\w)){{1,2}}")
#: Two or three words in capitals that stand between others, likewise.
BARE_CAPITALS = regex.compile(rf"(?<![\w-])(?<!\p{{Lu}}\p{{Lu}}[\x20-])({_CAPITALS}(?!\w))((?:[\x20-]{_CAPITALS}(?!\w)){{1,2}})(?![\x20-]\p{{Lu}}\p{{Lu}})")
_PART = regex.compile(rf"{_CASED}|{_CAPITALS}")
_WORD = regex.compile(rf"(?<!\w)(?:{_CASED}|{_CAPITALS})(?!\w)")
#: An address is [A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9_%+-])?@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}; see ``emails``.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
HOST = re.compile(r"(?:[A-Za-z0-9-]++\.)+[A-Za-z]{2,}")
IBAN = re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?!\w)")
NUMBER = re.compile(
    r"(?<![\w.])(?P<ip>(?:[0-9]{1,3}\.){3}[0-9]{1,3})(?!\.?[0-9]|\w)"
    r"|(?<!\w)(?P<card>[0-9]{4}([ -])[0-9]{4}\3[0-9]{4}\3[0-9]{4}|[0-9]{13,19})(?!\w)"
    r"|(?<![\w-])(?P<ssn>[0-9]{3}-[0-9]{2}-[0-9]{4})(?![\w-])"
    r"|(?<![\w+])(?P<phone>\+[0-9]{8,15}|\+[0-9]{1,3}(?:[ .-]?\(0\))?[ .-]?[0-9]{1,4}(?:[ .-][0-9]{2}){3,5}|0[0-9](?:[ .-][0-9]{2}){4}|(?:\+[0-9]{1,3}[ .-]?\(?[0-9]{2,5}|\(?0[0-9]{1,4})\)?\x20?/\x20?[0-9]{5,8}|(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-]?[0-9]{3,4})(?!\w)"
)
_IP6 = re.compile(r"(?<![\w:.])(?=[0-9A-Fa-f:]*:[0-9A-Fa-f:]*:)[0-9A-Fa-f:]{3,39}+(?![\w:])")
_NUMERIC = re.compile(r"[+(]?[0-9][0-9 ().+/-]{5,}")


#: Address blocks with a use of their own; surrogates stay in theirs, and those of public addresses stay public.
_BLOCKS = [
    ipaddress.ip_network(b)
    for b in "0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.2.0/24 192.168.0.0/16 198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 224.0.0.0/4 240.0.0.0/4".split()
]
_RANGES = [(int(b.network_address), int(b.broadcast_address)) for b in _BLOCKS]


def _block(x: int) -> int:
    return next((i for i, (a, b) in enumerate(_RANGES) if a <= x <= b), -1)


def _block_public(x: int) -> bool:
    return _block(x) < 0


def _ssn_valid(x: int) -> bool:
    area, group, serial = x // 1_000_000, x // 10_000 % 100, x % 10_000
    return 0 < area < 900 and area != 666 and group > 0 and serial > 0


def _luhn(digits: str) -> int:
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10


class Surrogates:
    """Keyed surrogates of entities."""

    def __init__(self, key: bytes):
        self.key = key
        self.of = functools.lru_cache(50_000)(self._of)  # (type, text, gender)

    def _round(self, tweak: str, n: int, i: int, x: int) -> int:
        return int.from_bytes(hashlib.blake2b(f"{tweak}|{n}|{i}|{x}".encode(), key=self.key, digest_size=16).digest(), "big")

    def _permute(self, tweak: str, n: int, x: int, back: bool) -> int:
        """A keyed permutation of 0..n-1: an unbalanced Feistel network on a*b >= n, walked until it is back inside."""
        a = max(1, int(n**0.5))
        b = -(-n // a)
        while True:
            hi, lo = divmod(x, b)
            for i in range(7, -1, -1) if back else range(8):
                s = -1 if back else 1
                if i % 2:
                    hi = (hi + s * self._round(tweak, n, i, lo)) % a
                else:
                    lo = (lo + s * self._round(tweak, n, i, hi)) % b
            x = hi * b + lo
            if x < n:
                return x

    def number(self, tweak: str, n: int, x: int) -> int:
        """Another number below n; a bijection without fixed points for n > 1."""
        return x if n < 2 else self._permute(tweak, n, (self._permute(tweak, n, x, False) + 1) % n, True)

    def within(self, tweak: str, n: int, x: int, same: Callable[[int], object]) -> int:
        """Another number below n of x's class: the next one of that class in the cycle of ``number``, a bijection of each class."""
        kind, y = same(x), self.number(tweak, n, x)
        while same(y) != kind:
            y = self.number(tweak, n, y)
        return y

    def shaped(self, tweak: str, text: str) -> str:
        """Letters for letters of their kind and case, digits for digits, all else kept; case doesn't change the choice."""
        low = text.lower() if len(text.lower()) == len(text) else text
        sets = ["0123456789" if c.isascii() and c.isdigit() else _CLASS.get(c) for c in low]
        n, x = 1, 0
        for c, s in zip(low, sets):
            if s:
                n, x = n * len(s), x * len(s) + s.index(c)
        if n < 2:
            return text
        shape = "".join(s[0] if s else c for c, s in zip(low, sets))
        x = self.number(f"{tweak}:{shape}", n, x)
        out = []
        for c, s in zip(reversed(text), reversed(sets)):
            if s:
                x, i = divmod(x, len(s))
                c = s[i].upper() if c.isupper() and len(s[i].upper()) == 1 else s[i]
            out.append(c)
        return "".join(reversed(out))

    def _digits(self, tweak: str, text: str) -> str:
        """Digits permuted as one number, whatever the separators."""
        d = re.sub(r"\D", "", text)
        y = iter(str(self.number(f"{tweak}:{len(d)}", 10 ** len(d), int(d))).zfill(len(d)))
        return re.sub(r"\d", lambda _: next(y), text)

    def _of(self, kind: str, text: str, gender: str = "") -> str:
        if kind == "email":
            local, _, host = text.partition("@")
            *labels, tld = host.split(".")
            return f"{self.shaped('local', local)}@{'.'.join([self.shaped('host', x) for x in labels] + [tld])}"
        if kind == "ip" and ":" in text:  # the first group, which says what the address is for, stays
            x = int(ipaddress.IPv6Address(text))
            head, low = divmod(x, 1 << 112)
            return str(ipaddress.IPv6Address((head << 112) + self.number(f"ip6:{head}", 1 << 112, low)))
        if kind == "ip":  # in its block; the small ones have a permutation of their own
            x = int.from_bytes(bytes(int(q) for q in text.split(".")), "big")
            at = _block(x)
            a, b = _RANGES[at] if at >= 0 else (0, (1 << 32) - 1)
            y = a + self.number(f"ip:{at}", b - a + 1, x - a) if at >= 0 else self.within("ip", 1 << 32, x, _block_public)
            return ".".join(map(str, y.to_bytes(4, "big")))
        if kind == "card":  # the issuer stays, and the check digit follows, so that valid numbers stay valid and invalid ones invalid
            d = re.sub(r"\D", "", text)
            head, body = d[:6], d[6:-1]
            off = _luhn(d)
            y = head + str(self.number(f"card:{head}:{len(d)}:{off}", 10 ** len(body), int(body))).zfill(len(body))
            it = iter(y + str((off - _luhn(y + "0")) % 10))
            return re.sub(r"\d", lambda _: next(it), text)
        if kind == "phone":  # a country code stays
            m = re.match(r"\+\d{1,3}(?=\D)|\+1(?=\d{10}$)|\+\d\d", text)
            head = m.group() if m else ""
            return head + self._digits(f"phone{head}", text[len(head) :])
        if kind == "ssn":
            x = str(self.within("ssn", 10**9, int(text.replace("-", "")), _ssn_valid)).zfill(9)
            return f"{x[:3]}-{x[3:5]}-{x[5:]}"
        if kind == "iban":
            plain = text.replace(" ", "")
            body = self.shaped(f"iban{plain[:2]}", plain[4:]).upper()
            it = iter(f"{plain[:2]}{98 - int(''.join(str(int(c, 36)) for c in body + plain[:2] + '00')) % 97:02d}{body}")
            return re.sub(r"\S", lambda _: next(it), text)
        return _PART.sub(lambda m: self._name(m.group(), gender), text)

    def _name(self, word: str, gender: str) -> str:
        """A given name or surname of the same list if it is one, else letters of the same kinds before a kept ending; titles stay."""
        if word in _GENDER:
            return word
        plain = word.capitalize() if word.isupper() and len(word) > 1 else word
        out = self._plain(plain, gender)
        return out.upper() if plain is not word and len(out.upper()) == len(out) else out

    def _plain(self, word: str, gender: str) -> str:
        if word in UNISEX:
            return STANDS[gender or LISTED[word][1]][self.number(f"unisex:{gender or LISTED[word][1]}", len(UNISEX), UNISEX.index(word))]
        for lists, listed, kind in ((GIVEN, LISTED, "given"), (SURNAMES, _SURNAME, "surname")):
            if word in listed:
                names = [n for n in lists[listed[word]] if n not in UNISEX]
                return names[self.number(f"{kind}:{listed[word]}", len(names), names.index(word))]
        tail = next((e for e in ENDINGS if word.lower().endswith(e) and len(word) > len(e) + 1), "")
        stem = word[: len(word) - len(tail)]
        out = self.shaped(f"name:{tail}", stem) + tail
        # a word must not become one that stands for another: walk on
        while out in _TAKEN:
            out = self.shaped(f"name:{tail}", out[: len(out) - len(tail)]) + tail
        return out


def surrogates(key: bytes) -> Surrogates:
    return model("surrogates", key, lambda: Surrogates(key))


_session_keys: dict[str, bytes] = {}


def session_key(spark: SparkSession) -> bytes:
    """The secret of the surrogates: the session's ``sluice.surrogate.key``, else the variable SLUICE_SURROGATE_KEY, else one drawn
    for this application, which nobody can use to take surrogates back, nor to give the same ones in another run."""
    given = spark.conf.get("sluice.surrogate.key", None) or os.environ.get("SLUICE_SURROGATE_KEY")
    if given:
        return hashlib.blake2b(given.encode(), digest_size=32).digest()
    return _session_keys.setdefault(spark.sparkContext.applicationId, secrets.token_bytes(32))


def _ip6_ok(text: str) -> bool:
    """An address whose first group has four digits, as all global, local and multicast ones have; others may be times or names in code."""
    if len(text.partition(":")[0]) != 4:
        return False
    try:
        return ipaddress.IPv6Address(text) is not None
    except ValueError:
        return False


def _iban_ok(text: str) -> bool:
    p = text.replace(" ", "")
    return 15 <= len(p) <= 34 and int("".join(str(int(c, 36)) for c in p[4:] + p[:4])) % 97 == 1


def entities(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, type, gender) of all entities, in order and without overlap; where two overlap the earlier, then the longer, stays."""
    if not text:
        return []
    found = list(_found(text))
    found.sort(key=lambda x: (x[0], -x[1]))
    out: list[tuple[int, int, str, str]] = []
    for e in found:
        if not out or e[0] >= out[-1][1]:
            out.append(e)
    return _mentions(text, out)


def _mentions(text: str, found: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """The entities with all later whole-word mentions of the name parts among them, each with the gender of the first."""
    parts: dict[str, tuple[int, str]] = {}
    for a, b, kind, gender in found:
        if kind == "name":
            for m in _PART.finditer(text, a, b):
                if m.group() not in _GENDER:
                    parts.setdefault(m.group(), (m.end(), gender))
    if not parts:
        return found
    out, rest = [], iter([*found, (len(text), len(text), "", "")])
    at = 0
    for e in rest:  # between the entities that are there already
        out += [(m.start(), m.end(), "name", parts[m.group()][1]) for m in _WORD.finditer(text, at, e[0]) if m.group() in parts and m.start() >= parts[m.group()][0]]
        at = e[1]
        if e[2]:
            out.append(e)
    return out


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses without overlap. From each @ the local part grows to the left and the host to the right, so that a
    character is looked at a fixed number of times, however long its run."""
    free, at = 0, text.find("@")
    while at >= 0:
        run = len(text[free:at].rstrip(_LOCAL)) + free
        start = at - len(text[run:at].lstrip("._%+-"))
        nxt = at + 1
        if start < at and (at - start == 1 or text[at - 1] != ".") and (m := HOST.match(text, at + 1)):
            yield start, m.end()
            nxt = m.end()
        free, at = nxt, text.find("@", nxt)


def _found(text: str) -> Iterator[tuple[int, int, str, str]]:
    yield from ((a, b, "email", "") for a, b in emails(text))
    past = 0
    for block in _NUMERIC.finditer(text):
        at = max(past, block.start())
        while at < block.end() and (m := NUMBER.search(text, at, min(len(text), block.end() + 20))) and m.start() < block.end():
            at = past = m.end()
            if m.lastgroup != "ip" or all(int(x) < 256 for x in m.group().split(".")):
                yield m.start(), m.end(), next(k for k in ("ip", "card", "ssn", "phone") if m[k]), ""
    if text.count(":") > 1:
        for m in _IP6.finditer(text):
            if _ip6_ok(m.group()):
                yield m.start(), m.end(), "ip", ""
    past = 0
    for t in TITLED.finditer(text):
        if t.start() >= past and (m := NAME.match(text, t.end())):
            past = m.end()
            yield m.start(), past, "name", _GENDER[t[1]]
    past = 0
    for f in FIRST.finditer(text):
        if f.start() >= past and (m := BARE.match(text, f.end())):
            past = m.end()
            yield f.start(), past, "name", "" if f[1] in UNISEX else LISTED[f[1]][1]
    for m in BARE_CAPITALS.finditer(text):
        first = m[1].capitalize()
        if first in LISTED:
            yield m.start(), m.end(2), "name", "" if first in UNISEX else LISTED[first][1]
    yield from ((m.start(), m.end(), "iban", "") for m in IBAN.finditer(text) if _iban_ok(m.group()))


def replace(text: str | None, key: bytes) -> tuple[str | None, list[dict]]:
    """The text with surrogates, and (type, start, end, surrogate) of each entity; places are those in the new text."""
    got = entities(text)
    if not got:
        return text, []
    of, out, at, size, said = surrogates(key).of, [], 0, 0, []
    for a, b, kind, gender in got:
        s = of(kind, text[a:b], gender)
        size += a - at
        said.append({"type": kind, "start": size, "end": size + len(s), "surrogate": s})
        out += [text[at:a], s]
        size, at = size + len(s), b
    return "".join(out) + text[at:], said


def pseudonymise(docs: DataFrame, secret: bytes, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, text, entities) with every whole text's entities replaced. Null texts stay null; repeated rows each give one."""
    kind = docs.schema[key].dataType.simpleString()

    def run(keys: list, texts: list) -> dict:
        got = [replace(t, secret) for t in texts]
        return {key: keys, "text": [g[0] for g in got], "entities": [g[1] for g in got]}

    return map_columns(docs, [key, text], run, f"`{key}` {kind}, text string, entities array<struct<type:string,start:int,end:int,surrogate:string>>")


def _entity(text: str, kind: str, gender: str) -> str:
    """What an entity is, whatever its case; a given name of both genders is another one with each."""
    unisex = kind == "name" and any(w.capitalize() in UNISEX for w in text.split())
    return f"{text.lower()} {gender}" if unisex else str(ipaddress.ip_address(text)) if kind == "ip" and ":" in text else text.lower()


def collisions(docs: DataFrame, secret: bytes, *, text: str = "text") -> DataFrame:
    """(type, n_entities, n_surrogates, n_shared): distinct entities by type, distinct surrogates, and surrogates that two entities share (none)."""

    def run(texts: list) -> dict:
        rows = {(k, re.sub(r"\D", "", t[a:b]) if k in ("card", "phone", "ssn") else _entity(t[a:b], k, g), s) for t in texts for a, b, k, g in entities(t) for s in [surrogates(secret).of(k, t[a:b], g)]}
        rows = {(k, x, re.sub(r"\D", "", s) if k in ("card", "phone", "ssn") else s.lower()) for k, x, s in rows}
        return {"type": [r[0] for r in rows], "entity": [r[1] for r in rows], "surrogate": [r[2] for r in rows]}

    pairs = map_columns(docs, [text], run, "type string, entity string, surrogate string").distinct()
    by = pairs.groupBy("type", "surrogate").agg(F.countDistinct("entity").alias("m"), F.sum(F.lit(1)).alias("n"))
    return by.groupBy("type").agg(F.sum("m").alias("n_entities"), F.count("*").alias("n_surrogates"), F.count_if(F.col("m") > 1).alias("n_shared"))


def op4(docs: DataFrame, secret: bytes | None = None) -> DataFrame:
    """doc_id, the new text, the number of entities and the number of each type; without a secret the session's (``session_key``)."""
    out = pseudonymise(docs, session_key(docs.sparkSession) if secret is None else secret)
    of_type = lambda t: F.size(F.filter("entities", lambda e: e["type"] == t)).cast("long").alias(f"n_{t}")
    n = [of_type(t) for t in TYPES]
    return out.select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"), *n)
