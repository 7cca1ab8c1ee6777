"""Many small files and small rows with much work are many tasks."""

import os

import pandas as pd
import pytest

from sluice.plans.queries import QUERIES
from sluice.sources.run_files import OPENING, Tree, read_files
from sluice.sources.sinks import write_files
from sluice.streaming.replay import _Waiting

D = "/root/testdata/sf0.001"


def test_written_files_are_read_again(spark, tmp_path):
    rows = [("a/b", 1, "x"), ("a/b", 1, "y"), (None, 2, "é\n"), ("c d", 3, ""), ("e", 4, None)]
    assert write_files(spark.createDataFrame(rows, "k string, n int, value string"), f"{tmp_path}/t", ("k", "n")) == 4
    got = read_files(spark, f"{tmp_path}/t", keys=("k", "n")).select("k", "n", "value").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((k, str(n), v)) for k, n, v in rows if v is not None)
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/t", wholetext=True).where("k = 'a/b'").collect()) == ["x", "y"]


def test_small_files_are_many_tasks():
    shares = Tree({"path": "/nowhere"}).shares((str(i), 0, 50) for i in range(4000))
    assert len(shares) > 3 and max(len(s.pieces) for s in shares) <= (64 << 20) // OPENING


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
def test_grading_is_spread(spark):
    assert QUERIES["grade_symbolic"](spark, D).rdd.getNumPartitions() == 4


def test_shares_that_go_out_at_once_are_no_state():
    class Place:
        value = None

        def get(self):
            return self.value

        def update(self, v):
            self.value = v

    class Ready(dict):
        writes = 0

        def updateValue(self, k, v):
            self[k], self.writes = v, self.writes + 1

        def removeKey(self, k):
            del self[k]

    w = _Waiting({"a": 10}, 1, None, None)
    w.place, w.ready = Place(), Ready()
    frame = pd.DataFrame({"step": range(1005), "uid": range(1005)})
    out = pd.concat(w.handleInputRows(("a", 0), iter([frame[::-1], frame[:3]]), None))
    assert out["uid"].tolist() == list(range(1000)) and out["batch"].tolist() == [i // 10 for i in range(1000)] and out["complete"].all()
    assert w.ready.writes == 5 and w.place.value[:3] == (100, 5, 1004)
