"""Token ids in flat binary files: unsigned integers of every document behind one another, and 64-bit document offsets.

A folder holds shards in ascending order of the key. Shard k is ``k.bin`` (ids, little-endian, 16 bits where the
vocabulary allows, else 32), ``k.idx`` (one 64-bit offset a document and a last one: ids before it in the whole
folder) and ``k.key`` (keys, an Arrow file). Tasks write shards without knowing of each other; the prefix sums of their
sizes are the bases from which a second pass turns lengths into offsets. ``manifest.json`` comes last and makes the
folder valid. A reader maps a shard and sees any document without reading what is before it.
"""

from __future__ import annotations

import bisect
import functools
import gc
import json
import os
import re
import string
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string
from tokenizers import Tokenizer

from ..session import ship_package
from .arrow import map_columns, slices
from .bpe import WORDS
from .common import Scratch, chunks_of, final, model
from .flat import Folder, qualified
from .packing import END, byte_alphabet

#: Chunks in one of the two generations of a worker's memo, and characters of texts that are encoded at once.
MEMO, BATCH = 800_000, 100_000
#: Chunks with more characters aren't kept, so that the memo's size is bounded in bytes too.
LONG = 64
#: Words that the model gets as one text.
RUN = 500
#: Printable ASCII characters that are neither letters nor digits.
MARKS = string.punctuation
#: Documents of a shard that the writer aims at, and ids that one task of a reader takes.
SHARD, READ = 100_000, 8 << 20


class WordIds:
    """Ids of texts by the tokenizers library, which sees every distinct chunk between blanks once as long as the memo has it.

    The file's normaliser drops blanks and its words never span them, so that a text's ids are those of its chunks. The
    strings of special tokens are found inside chunks by the library itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if any(not t["content"] or set(t["content"]) & {" ", "\n"} or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("a special token is empty or takes blanks")
        self.whole.no_truncation()
        self.whole.no_padding()
        self.special = [t["content"] for t in spec["added_tokens"]]
        #: the model alone, for words that are normalised and split already
        self.bare = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": [], "truncation": None, "padding": None}))
        self.shown = {b: c for c, b in byte_alphabet().items() if b != ord("\n")}
        self.kind = "<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4"
        self.find = regex.compile(WORDS).findall
        suffix = spec["model"]["end_of_word_suffix"]
        self.closes = np.zeros(self.bare.get_vocab_size(), bool)
        self.closes[[i for t, i in spec["model"]["vocab"].items() if t.endswith(suffix)]] = True
        self.mark = os.path.commonprefix(self.special) if self.special else "\n"
        self.odd = re.compile("[^\n!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]|" + re.escape(self.mark)).search
        self.memo: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}

    def _learn(self, chunks: list[str]) -> None:
        """Puts distinct chunks into the memo.

        Those of printable ASCII and composed Latin letters are lower-cased and split here, and the model gets the words
        that it hasn't seen; others are texts of their own for the whole tokenizer.
        """
        memo, find = self.memo, self.find
        hard: set[str] = set()
        if self.odd("\n".join(chunks)):
            hard = {c for c in chunks if self.odd(c) or self.mark in c}
            for c, e in zip(hard, self.whole.encode_batch_fast(list(hard), add_special_tokens=False)):
                memo[c] = np.array(e.ids, self.kind).tobytes()
            chunks = [c for c in chunks if c not in hard]
        low = "\n".join(chunks).lower().split("\n")
        body = [c.rstrip(MARKS) for c in low]  # a run of marks behind letters is one word
        parts = [(b, c[len(b) :]) if b.isalpha() else find(c) for b, c in zip(body, low)]
        words = [w for w in set(chain.from_iterable(parts)) if w not in memo]  # (a difference with keys would walk the memo)
        drawn = "\n".join(words)
        if not drawn.isascii():
            drawn = drawn.encode("utf-8").decode("latin-1").translate(self.shown)
        lines = drawn.split("\n") if words else []
        coded = self.bare.encode_batch_fast([" ".join(lines[i : i + RUN]) for i in range(0, len(lines), RUN)], add_special_tokens=False)
        ids = np.array(list(chain.from_iterable([e.ids for e in coded])), self.kind)
        ends = np.flatnonzero(self.closes[ids]) + 1  # the last token of a word, and no other, has the suffix
        if len(ends) != len(words):
            raise ValueError("the model leaves out characters")
        flat, at = ids.tobytes(), (ends * ids.itemsize).tolist()
        memo.update([(w, flat[a:b]) for w, a, b in zip(words, [0, *at], at)])
        get = memo.__getitem__
        memo.update([(c, b"".join(map(get, p))) for c, p in zip(chunks, parts)])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian integers of ``kind``."""
        collects = gc.isenabled()
        gc.disable()  # what is made here is free of cycles
        try:
            return self._encode(texts)
        finally:
            if collects:
                gc.enable()

    def _encode(self, texts: list[str | None]) -> list[bytes]:
        out = []
        for a, b in chunks_of(texts, BATCH):
            memo = self.memo
            cut = [t.replace("\n", " ").split(" ") if t else [] for t in texts[a:b]]
            got = [list(map(memo.get, c)) for c in cut]
            new = {c for x, y in zip(cut, got) if None in y for c, g in zip(x, y) if g is None}
            if self.old:
                kept = [c for c in new if c in self.old]
                memo.update([(c, self.old[c]) for c in kept])
                new.difference_update(kept)
            self._learn(list(new))
            out += [b"".join(map(memo.__getitem__, x) if None in y else y) for x, y in zip(cut, got)]
            for c in [c for c in new if len(c) > LONG]:
                del memo[c]
            if len(memo) > MEMO:  # what is used again comes back from there
                self.old, self.memo = memo, {"": b""}
        return out


def word_ids(path: str) -> WordIds:
    return model("word_ids", path, lambda: WordIds(path))


def _tasks(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """``fn`` on each partition's batches; it yields columns."""
    ship_package(df.sparkSession)
    kind = _parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(kind)
        for got in fn(b for whole in batches for b in slices(whole)):
            yield pa.RecordBatch.from_arrays([pa.array(got[x.name], type=x.type) for x in out], schema=out)

    return df.mapInArrow(run, kind)


def _place(key: object) -> tuple:
    """What keys are ordered by: null first."""
    return (0,) if key is None else (1, key)


def _bounds(docs: DataFrame, key: str, n: int) -> list[tuple]:
    """The first place of each of about ``n`` even ranges of the keys, from the key column alone; a key that fills ranges is there as often."""
    rows = docs.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("row")).repartitionByRange(n, "key", "row")
    first = rows.groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct("key", "row"))["key"].alias("key"))
    return [_place(r.key) for r in first.orderBy("part").collect()]


def write(docs: DataFrame, tokenizer: str, root: str, *, text: str = "text", key: str = "doc_id", end: int = END, shard: int = SHARD) -> dict:
    """Encodes every whole text, ``end`` behind each, into a new folder ``root``; returns its manifest.

    Documents are in ascending order of ``key``, null keys first, rows of one key in no particular order. A null text is an
    empty one. Ranges of keys, found in a pass over the keys alone, are shards of about ``shard`` documents, as many as the session has
    shuffle partitions at least; a task encodes its texts and sends ids to their range, and those of a key that fills several ranges to each in
    turn. The driver sees one row a shard. A task that runs twice writes its shard anew under the same name.
    """
    spark = docs.sparkSession
    at = qualified(spark, root)
    folder, kind = Folder(at), docs.schema[key].dataType.simpleString()
    if folder.has("manifest.json"):
        raise FileExistsError(f"{root} holds token files")
    size = Tokenizer.from_file(tokenizer).get_vocab_size()
    item = 2 if max(size, end + 1) <= 1 << 16 else 4
    last = end.to_bytes(item, "little")

    def make():
        seen = TaskContext.get().partitionId()

        def encode(keys: list, texts: list) -> dict:
            nonlocal seen
            parts = []
            for p in map(_place, keys):
                low, high = bisect.bisect_left(bounds, p), bisect.bisect_right(bounds, p)
                # the ranges that begin with this key, else the one that it lies in
                low = max(low - 1, 0) if low == high else low
                parts.append(low + seen % (high - low) if high > low else low)
                seen += 1
            return {"key": keys, "ids": [i + last for i in word_ids(tokenizer).encode(texts)], "part": parts}

        return encode

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        first = next(batches, None)
        if first is None:
            return
        k, to = TaskContext.get().partitionId(), Folder(at)
        n = ids = 0
        with to.new(f"{k}.bin") as out, to.new(f"{k}.len") as sizes, to.new(f"{k}.key") as names, pa.ipc.new_file(names, pa.schema([("key", first.schema.field(0).type)])) as index:
            b: pa.RecordBatch | None = first
            while b is not None:
                if len(b):
                    whole = b.column(1).to_pylist()
                    lengths = np.fromiter(map(len, whole), "<u8", len(whole)) // item
                    out.write(b"".join(whole))
                    sizes.write(lengths.tobytes())
                    index.write_batch(pa.RecordBatch.from_arrays([b.column(0)], names=["key"]))
                    n, ids = n + len(whole), ids + int(lengths.sum())
                b = next(batches, None)
        if n:
            yield {"shard": [k], "docs": [n], "ids": [ids]}

    def offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        to = Folder(at)
        for b in batches:
            for k, base in zip(b["shard"].to_pylist(), b["base"].to_pylist()):
                ends = base + np.cumsum(to.numbers(f"{k}.len", "<u8"), dtype="<u8")
                with to.new(f"{k}.idx") as out:
                    out.write(np.concatenate([np.array([base], "<u8"), ends]).tobytes())
            yield {"shard": b["shard"].to_pylist()}

    with Scratch(spark) as scratch:
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // shard))
        bounds = _bounds(docs, key, n)
        coded = map_columns(docs, [key, text], make, f"key {kind}, ids binary, part int", per_task=True)
        ranges = coded.repartitionById(max(1, len(bounds)), "part").sortWithinPartitions("key").select("key", "ids")
        made = scratch.keep(_tasks(ranges, shards, "shard int, docs long, ids long")).orderBy("shard").collect()
        base, table, docs_before = 0, [], 0
        for r in made:
            table.append({"shard": r.shard, "docs": r.docs, "ids": r.ids, "first_doc": docs_before, "base": base})
            base, docs_before = base + r.ids, docs_before + r.docs
        if table:
            rows = spark.createDataFrame([(x["shard"], x["base"]) for x in table], "shard int, base long")
            _tasks(rows.repartition(min(len(table), n), "shard"), offsets, "shard int").count()
    manifest = {"kind": f"<u{item}", "docs": docs_before, "ids": base, "key": kind, "shards": table}
    with folder.new("manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    return manifest


def manifest_of(root: str) -> dict:
    return json.loads(Folder(root).text("manifest.json"))


class Shard:
    """One shard, mapped. ``ids(i)``: the ids of its i-th document; ``starts``: the offsets, a last one included."""

    def __init__(self, root: str, kind: str, shard: int, docs: int, ids: int, base: int):
        self.folder, self.kind, self.shard, self.base = Folder(root), kind, shard, base
        for name, size in (("bin", ids * np.dtype(kind).itemsize), ("idx", 8 * (docs + 1))):
            if self.folder.size(f"{shard}.{name}") != size:
                raise ValueError(f"{shard}.{name} of {root} hasn't the size that the manifest says")
        self.starts = self.folder.numbers(f"{shard}.idx", "<u8")
        if self.starts[0] != base or self.starts[-1] != base + ids:
            raise ValueError(f"{shard}.idx of {root} doesn't lie where the manifest says")

    def part(self, i: int, j: int) -> Iterator[np.ndarray]:
        """The ids of documents i to j, each as a view of the file."""
        at = self.starts[i : j + 1].astype(np.int64) - self.base
        flat = self.folder.numbers(f"{self.shard}.bin", self.kind, int(at[0]), int(at[-1]))
        at -= at[0]
        return (flat[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist()))

    @functools.cached_property
    def keys(self) -> pa.Table:
        return self.folder.arrow(f"{self.shard}.key")


def _scan(spark: SparkSession, root: str, fn: Callable[[np.ndarray], object], field: str, ids: int) -> DataFrame:
    """(key, start, n_tokens, a column by ``fn``), read from the files; a task takes runs of documents of about ``ids`` ids."""
    at = qualified(spark, root)
    m = manifest_of(at)
    rows = []
    for s in m["shards"]:
        pieces = max(1, min(s["docs"], -(-s["ids"] // ids)))
        cuts = [s["docs"] * i // pieces for i in range(pieces + 1)]
        rows += [(s["shard"], s["docs"], s["ids"], s["base"], a, b) for a, b in zip(cuts, cuts[1:])]
    if not rows:
        return spark.createDataFrame([], f"key {m['key']}, start long, n_tokens long, {field}")
    plan = spark.createDataFrame(rows, "shard int, docs long, ids long, base long, a long, b long").repartition(len(rows), "shard", "a")
    name, kind = field.split()[0], m["kind"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for r in b.to_pylist():
                s = Shard(at, kind, r["shard"], r["docs"], r["ids"], r["base"])
                for i in range(r["a"], r["b"], 1000):
                    j = min(i + 1000, r["b"])
                    start = s.starts[i : j + 1].astype(np.int64)
                    got = [fn(x) for x in s.part(i, j)]
                    yield {"key": s.keys["key"][i:j].combine_chunks(), "start": start[:-1], "n_tokens": np.diff(start), name: got}

    return _tasks(plan, read, f"key {m['key']}, start long, n_tokens long, {field}")


def read(spark: SparkSession, root: str, *, key: str = "doc_id", ids: int = READ) -> DataFrame:
    """(key, start, n_tokens, ids array<long>) of every document of a folder."""
    return _scan(spark, root, lambda x: x.astype(np.int64), "ids array<long>", ids).withColumnRenamed("key", key)


def digests(spark: SparkSession, root: str, *, key: str = "doc_id", ids: int = READ) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document of a folder; the sum is of its ids as little-endian unsigned 32-bit integers."""
    return _scan(spark, root, lambda x: zlib.crc32(x.astype("<u4").tobytes()), "ids_crc32 long", ids).withColumnRenamed("key", key)


def op11(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, read back from the files that ``write`` makes. Repeated rows are documents of their own."""
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        at = scratch.place()
        write(docs, tokenizer, at)
        return final(digests(spark, at))
