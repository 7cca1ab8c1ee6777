"""What the near-duplicate stage broadcasts: the driver's memory mustn't follow the number of documents."""

import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from sluice.llm import minhash
from sluice.scratch import ADAPTIVE, MEASURED, STATIC, measured_broadcasts

def since(spark, n=0):
    store = spark._jsparkSession.sharedState().statusStore().executionsList()
    return store.size() if not n else [store.apply(i).physicalPlanDescription() for i in range(n, store.size())]


@pytest.fixture
def docs(spark, tmp_path):
    """60,000 different texts: 2 MB of digests, well below the usual threshold of 10 MB; each tenth has a near copy."""
    words = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.concat(F.lit("w"), F.pmod(F.xxhash64(i, F.when(F.col("id") % 10 == 1, F.col("id") - 1).otherwise(F.col("id"))), F.lit(1 << 40))))
    text = F.concat_ws(" ", words, F.when(F.col("id") % 10 == 1, F.lit("more")))
    spark.range(60_000).select(F.col("id").alias("doc_id"), text.alias("text")).write.parquet(at := str(tmp_path / "documents"))
    return spark.read.parquet(at)


@pytest.mark.parametrize("stage", ["pipeline", "op8"])
def test_no_table_of_documents_is_broadcast(spark, docs, tmp_path, stage):
    before = spark.conf.get(STATIC)
    spark.conf.set(STATIC, "10m")
    try:
        n = since(spark)
        got = corpus_pipeline.near_duplicate_stage(spark, docs, "") if stage == "pipeline" else minhash.op8(docs).where("kept")
        got.write.parquet(str(tmp_path / "out"))  # the caller's own job, under the caller's settings
        made = since(spark, n)
    finally:
        spark.conf.set(STATIC, before)
    if stage == "pipeline":
        assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("doc_id"), F.count("*")).first() == (sum(i for i in range(60_000) if i % 10 != 1), 54_000)
        assert "SortMergeJoin LeftSemi" in made[-1] and "BroadcastHashJoin" not in made[-1]
    # by rows, of 16 bytes at least: tables with keys that are no numbers take whole pages of the driver's heap
    rows = [float(x) for p in made for x in re.findall(r"BroadcastQueryStage \(\d+\), Statistics\(sizeInBytes=[^,)]+, rowCount=([^,)]+)\)", p)]
    assert rows and max(rows) <= MEASURED / 16


def test_least_bound_holds(spark):
    assert spark.conf.get(ADAPTIVE, None) is None
    spark.conf.set(ADAPTIVE, "5m")
    try:
        with measured_broadcasts(spark):
            assert spark.conf.get(ADAPTIVE) == "5m"
            with measured_broadcasts(spark, MEASURED):
                assert int(spark.conf.get(ADAPTIVE)) == MEASURED
            assert spark.conf.get(ADAPTIVE) == "5m"
        assert spark.conf.get(ADAPTIVE) == "5m"
        spark.conf.set(ADAPTIVE, "-1")
        with measured_broadcasts(spark, MEASURED):
            assert int(spark.conf.get(ADAPTIVE)) == -1
        assert spark.conf.get(ADAPTIVE) == "-1"
    finally:
        spark.conf.unset(ADAPTIVE)
