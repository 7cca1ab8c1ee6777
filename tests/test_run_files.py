import io
import os
import random
import socket

import pytest
from pyspark.sql import functions as F

from sluice.sources.run_files import line_pieces, read_files, read_lines, stream_lines


def plant(root, path, text):
    p = root / path
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_bytes(text.encode() if isinstance(text, str) else text)


def test_lines_of_any_cuts_are_the_lines():
    r = random.Random(3)
    for _ in range(300):
        blob = bytes(r.choice(b"a\n\xc3\r") for _ in range(r.randrange(30)))
        cuts = [0, *sorted(r.randrange(len(blob) + 1) for _ in range(r.randrange(4))), len(blob)]
        got = [x for a, b in zip(cuts, cuts[1:]) for x in line_pieces(io.BufferedReader(io.BytesIO(blob)), a, b)]
        want = [x + b"\n" for x in blob.split(b"\n")]
        want[-1] = want[-1][:-1]
        want = [x for x in want if x]
        assert [x for _, x in got] == want and [a for a, _ in got] == [sum(map(len, want[:i])) for i in range(len(want))]


def test_files_that_the_keys_rule_out_are_not_opened(spark, tmp_path):
    plant(tmp_path, "7b/topk/gsm8k.json", '{"acc": 0.5}')
    plant(tmp_path, "7b/topk/math.json", '{"acc": 0}')
    plant(tmp_path, "scale=1b/run=a b%2Fc/gsm8k.json", "")
    plant(tmp_path, f"scale={'__HIVE_DEFAULT_PARTITION__'}/r/gsm8k.json", "n")
    plant(tmp_path, "7b/stray.json", "x")
    plant(tmp_path, "7b/topk/_SUCCESS", "x")
    plant(tmp_path, "7b/topk/notes.txt", "x")
    here = os.getcwd()
    (tmp_path / "0b" / "lost").mkdir(parents=True)
    os.chdir(tmp_path / "0b" / "lost")  # a socket's path must be short
    with socket.socket(socket.AF_UNIX) as s:
        s.bind("gsm8k.json")  # opening it as a file fails, for any user
    os.chdir(here)
    rows = read_files(spark, str(tmp_path), keys=("scale", "run"), suffix=".json")
    assert rows.columns == ["scale", "run", "file", "offset", "value"]
    with pytest.raises(Exception, match="Failed to open local file"):
        rows.collect()
    got = lambda where: sorted(tuple(x) for x in rows.where(where).collect())
    whole = [("7b", "topk", "gsm8k", 0, '{"acc": 0.5}'), ("7b", "topk", "math", 0, '{"acc": 0}')]
    assert got("scale = '7b'") == got("scale > '1z'") == got("run in ('topk', 'x')") == whole
    assert got("scale <> '0b' and file like 'ma%'") == got("file like 'ma%' and value like '%acc%'") == whole[1:]
    assert got("scale = '1b'") == [("1b", "a b/c", "gsm8k", 0, "")]
    assert [x.run for x in rows.where("scale is null and run = 'r'").collect()] == ["r"]
    assert got("scale = 'none'") == [] and read_files(spark, str(tmp_path / "missing"), keys=("a",)).count() == 0
    with pytest.raises(Exception, match="keys must differ"):
        read_files(spark, str(tmp_path), keys=("value",)).count()


@pytest.mark.parametrize("split", [5000, 1 << 20])
def test_lines_in_small_tasks_equal_the_text_reader(spark, tmp_path, split):
    r = random.Random(split)
    for n in range(4):
        lines = ["".join(r.choice("abé\t ") for _ in range(r.choice((0, 3, 40, 3000)))) for _ in range(30)]
        plant(tmp_path, f"h{n % 2}/{n}.log", "\n".join(lines) + ("\n" if n else ""))
    plant(tmp_path, "h0/empty.log", "")
    got = read_lines(spark, str(tmp_path), keys=("host",), suffix=".log", split=split)
    want = spark.read.text(str(tmp_path / "*")).select(F.regexp_extract(F.col("_metadata.file_path"), r"/(\w+)/\w+\.log$", 1).alias("host"), "value")
    assert sorted(map(tuple, got.select("host", "value").collect())) == sorted(map(tuple, want.collect()))
    assert got.select("file", "offset").distinct().count() == got.count()


def test_stream_reads_each_whole_line_once(spark, tmp_path):
    root, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")

    def run():
        lines = stream_lines(spark, f"file://{root}", keys=("host",), suffix=".log", split=5)
        lines.writeStream.option("checkpointLocation", check).trigger(availableNow=True).start(out).awaitTermination()
        return sorted(tuple(x) for x in spark.read.parquet(out).select("host", "file", "offset", "value").collect())

    plant(root, "a/x.log", "one\ntwo\nthr")
    assert run() == [("a", "x", 0, "one"), ("a", "x", 4, "two")]
    with open(root / "a" / "x.log", "a") as f:
        f.write("ee\n\nlast\n")
    plant(root, "b/y.log", "new\n")
    got = run()  # a new query on the same checkpoint
    assert got == run() == sorted(tuple(x) for x in read_lines(spark, str(root), keys=("host",), suffix=".log").collect())
    os.remove(root / "b" / "y.log")
    assert run() == got
    plant(root, "a/x.log", "one\n")
    with pytest.raises(Exception, match="shorter"):
        run()
