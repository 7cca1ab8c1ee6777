"""Alignment against plain loops over bytes."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sluice.llm import align as m
from sluice.llm.align import Bits, alignment, groups, op12, pair_of
from sluice.llm.packing import byte_alphabet

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
D = "/root/testdata/sf0.001"
TEXTS = ["", None, "a", " ", "  ", "x  y   z", "Hello, World!! don't\n\n\tq", "<|endoftext|> <s></s><unk>", "▁", "a▁b", "naïve 日本語 𝒳 नमस्ते é", "\x00\x1f", "ab " * 3000, "q" * 5000, "<0x41>"]


@pytest.fixture(scope="module")
def plain():
    """The tokens of a text as the libraries say, with their bytes; none where they aren't those of the text."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    shown = byte_alphabet()

    def of(text):
        if not text:
            return [], []
        x = a.encode(" " + text, add_special_tokens=False)
        left = [(i, bytes(shown[c] for c in t)) for i, t in zip(x.ids, x.tokens)]
        right = []
        for i in b.encode(text):
            p = b.id_to_piece(i)
            right.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
        whole = (" " + text).encode()
        return (left, right) if b"".join(t for _, t in left) == whole == b"".join(t for _, t in right) else ([], [])

    return of


def by_bytes(tokens):
    """The number of the token at each byte."""
    return [k for k, (_, t) in enumerate(tokens) for _ in t]


def brute(rows, plain):
    docs = []
    for key, text in rows:
        a, b = plain(text)
        links = sorted(set(zip(by_bytes(a), by_bytes(b))))
        ends = [set(np.cumsum([len(t) for _, t in x]).tolist()) for x in (a, b)]
        cuts = sorted(ends[0] & ends[1])
        said, i, j, at_a, at_b = [], 0, 0, 0, 0
        for c in cuts:
            left, right = [], []
            while at_a < c:
                left.append(str(a[i][0]))
                at_a, i = at_a + len(a[i][1]), i + 1
            while at_b < c:
                right.append(str(b[j][0]))
                at_b, j = at_b + len(b[j][1]), j + 1
            said.append(",".join(left) + "|" + ",".join(right))
        docs.append((key, len(a), len(b), len(cuts), [(a[x][0], b[y][0]) for x, y in links], hashlib.sha256(";".join(said).encode()).hexdigest() if a else ""))
    n = Counter(p for d in docs for p in set(d[4]))
    top = defaultdict(int)
    for (x, _), k in n.items():
        top[x] = max(top[x], k)
    return sorted((k, na, nb, g, len(ls), sum(n[p] == top[p[0]] for p in ls), sum(n[p] for p in ls), s) for k, na, nb, g, ls, s in docs)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def rows_of(df):
    assert df.columns == COLUMNS
    return sorted(tuple(r) for r in df.collect())


def test_hard_texts(spark, plain, monkeypatch):
    r = random.Random(4)
    texts = TEXTS + ["".join(r.choice(list("ab  \n'<>é日𝒳.1") + ["the ", " of"]) for _ in range(r.randint(0, 60))) for _ in range(200)] + ["the same text"] * 5
    rows = list(enumerate(texts))
    want = brute(rows, plain)
    assert sum(w[1] == 0 for w in want) >= 4
    docs = spark.createDataFrame([(i, t, 0, "p") for i, t in rows], "doc_id long, text string, n_a int, pairs string").repartition(6)
    assert rows_of(op12(docs, A, B)) == want
    assert rows_of(alignment(docs, A, B, block=100)) == want  # many blocks


def test_a_table(spark, plain):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    assert rows_of(op12(docs, A, B)) == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], plain)


def test_repeated_rows_and_null_keys(spark, plain):
    rows = [(1, "one two"), (1, "one two"), (1, "three"), (2, "one")]
    assert rows_of(op12(spark.createDataFrame(rows, "doc_id int, text string"), A, B)) == brute(rows, plain)
    (r,) = op12(spark.createDataFrame([(None, "x")], "doc_id string, text string"), A, B).collect()
    assert (r.doc_id, r.n_links, r.count_sum) == (None, 1, 1)


def test_groups_cover_the_same_bytes(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id int, text string")
    p = pair_of(A, B)
    for r in groups(docs, A, B).collect():
        if r.groups is not None:
            both = [(b"".join(p.a.bytes[i] for i in g.a), b"".join(p.b.bytes[i] for i in g.b)) for g in r.groups]
            assert all(x == y and x for x, y in both) and b"".join(x for x, _ in both).decode() == " " + TEXTS[r.doc_id]
        else:
            assert TEXTS[r.doc_id] in ("", None, "▁", "a▁b")


def test_blanks_by_the_hundred_thousand(spark):
    (r,) = op12(spark.createDataFrame([(1, "x" + " " * 300_000 + "y")], "doc_id int, text string"), A, B).collect()
    assert r.n_a > 2 and r.n_links >= r.n_groups > 0


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 500)), st.lists(st.integers(0, 500)))
def test_rank_and_select(places, at):
    b = Bits.of(np.array(sorted(places), np.int64), 501)
    assert b.select().tolist() == sorted(places)
    assert b.rank(np.array(at, np.int64)).tolist() == [sum(p < x for p in places) for x in at]


def test_task_hands_on_counts_when_it_holds_many(spark, plain, monkeypatch):
    rows = [(i, f"word{i} other{i * 7} text") for i in range(300)]
    monkeypatch.setattr(m, "HELD", 50)
    assert rows_of(op12(spark.createDataFrame(rows, "doc_id int, text string").coalesce(1), A, B)) == brute(rows, plain)


def test_no_documents(spark):
    got = op12(spark.createDataFrame([], "doc_id long, text string"), A, B)
    assert got.columns == COLUMNS and not got.collect()
