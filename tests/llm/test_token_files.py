"""Token files against the tokenizers library."""

import os
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sluice.llm import token_files
from sluice.llm.flat import Folder
from sluice.llm.token_files import WordIds, op11, read, write
from sluice.scratch import Scratch

VOCAB = public_tokenizers.path("word_bpe_49k.json")
D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(VOCAB)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


TEXTS = ["", None, "a", "Hello, World!! don't", "<|endoftext|>x<|startoftext|>", "é É İ ΣΑΣ", "\x1c\t\x85 x\n\n  y", "€€€ 123456 ½", "word " * 50_000, "x" * 30_000, "日本語 नमस्ते", "<|", "</w>"]


def want(rows, library):
    out, at = {}, 0
    for k, t in rows:
        ids = [*library(t), 2]
        out.setdefault(k, []).append((at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    return out


def test_ids_are_those_of_the_library(library, monkeypatch):
    for memo in (500_000, 3):  # with and without room in the memo
        monkeypatch.setattr(token_files, "MEMO", memo)
        w = WordIds(VOCAB)
        for _ in range(2):
            assert [np.frombuffer(i, w.kind).tolist() for i in w.encode(TEXTS)] == [library(t) for t in TEXTS]


def test_files_give_back_every_document(spark, library):
    rows = list(enumerate(TEXTS * 7))
    docs = spark.createDataFrame([(i, t, "k", 0) for i, t in rows], "doc_id long, text string, key string, ids int").orderBy(F.rand(3)).repartition(5)
    got = op11(docs, VOCAB)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert {r.doc_id: [tuple(r)[1:]] for r in got.collect()} == want(rows, library)


def test_files_of_a_table(spark, library):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    assert {r.doc_id: [tuple(r)[1:]] for r in op11(docs, VOCAB).collect()} == want(rows, library)


def test_repeated_null_and_text_keys(spark, library):
    rows = [(None, "one two"), ("a", "three"), ("a", "three"), ("a", "four five six"), ("b", None)]
    with Scratch(spark) as scratch:
        at = scratch.place()
        m = write(spark.createDataFrame(rows, "name string, body string").coalesce(1), VOCAB, at, text="body", key="name")
        got = sorted(read(spark, at, key="name", ids=2).collect(), key=lambda r: r.start)
        assert [r["name"] for r in got] == [k for k, _ in rows]
        assert sorted((str(r["name"]), r.ids) for r in got) == sorted((str(k), [*library(t), 2]) for k, t in rows)
        assert [r.start for r in got] == np.cumsum([0] + [len(r.ids) for r in got])[:-1].tolist() and m["ids"] == sum(len(r.ids) for r in got)
        with pytest.raises(FileExistsError):
            write(spark.createDataFrame(rows, "name string, body string"), VOCAB, at, text="body", key="name")


def test_one_key_spreads_over_shards(spark):
    docs = spark.range(4000).select(F.lit(7).alias("doc_id"), F.concat(F.lit("t "), F.col("id")).alias("text"))
    with Scratch(spark) as scratch:
        m = write(docs, VOCAB, scratch.place(), shard=200)
        assert m["docs"] == 4000 and len(m["shards"]) > 4 and max(s["docs"] for s in m["shards"]) < 1500
        assert [s["base"] for s in m["shards"]] == np.cumsum([0] + [s["ids"] for s in m["shards"]])[:-1].tolist()


def test_flat_files_lie_as_the_manifest_says(spark):
    with Scratch(spark) as scratch:
        at = scratch.place()
        m = write(spark.createDataFrame([(3, "c d"), (1, "a"), (2, "b")], "doc_id int, text string"), VOCAB, at)
        f = Folder(at)
        ids = np.concatenate([f.numbers(f"{s['shard']}.bin", m["kind"]) for s in m["shards"]])
        starts = [f.numbers(f"{s['shard']}.idx", "<u8").tolist() for s in m["shards"]]
        assert len(ids) == m["ids"] == 7 and ids[[1, 3, 6]].tolist() == [2, 2, 2]
        assert [x for s in starts for x in s[:-1]] == [0, 2, 4] and starts[-1][-1] == 7
        name = f"{f.path}/{m['shards'][0]['shard']}.bin"
        with open(name, "ab") as out:
            out.write(b"xx")
        with pytest.raises(Exception, match="hasn't the size"):
            read(spark, at).collect()
        assert not [n for n in os.listdir(f.path) if n.startswith(".") and not n.endswith(".crc")]


def test_no_documents(spark):
    got = op11(spark.createDataFrame([], "doc_id long, text string"), VOCAB)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and not got.collect()
