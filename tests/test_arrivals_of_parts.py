"""Streams of parts: no task writes or reads a part whole, and a part is one micro-batch."""

import glob
import os

import pytest

from sluice import scratch
from sluice.plans import bindings
from sluice.plans.queries import QUERIES

D = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
@pytest.mark.parametrize("name, batches", [("stream_weights", 3), ("metrics_observed", 16)])
def test_parts_are_many_files_and_one_batch(spark, monkeypatch, name, batches):
    rollouts, roots = bindings.rollouts, []
    monkeypatch.setattr(bindings, "rollouts", lambda s, d: rollouts(s, d).repartition(4))
    monkeypatch.setattr(scratch.Scratch, "drop", lambda self: roots.append(self.root))
    assert QUERIES[name](spark, D).count() == 16
    root = next(r.removeprefix("file://") for r in roots if glob.glob(f"{r.removeprefix('file://')}/1/in"))
    assert len(glob.glob(f"{root}/1/in/**/*.parquet", recursive=True)) == 4 * batches
    assert len(glob.glob(f"{root}/1/out/batch=*")) == batches
