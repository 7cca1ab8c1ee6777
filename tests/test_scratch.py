"""Scratch tables: what the jobs that write them may broadcast."""

from pyspark.sql import functions as F

from sluice.scratch import ADAPTIVE, STATIC, Scratch, final, measured_broadcasts


def plans(spark, since):
    store = spark._jsparkSession.sharedState().statusStore()
    return [store.executionsList().apply(i).physicalPlanDescription() for i in range(since, store.executionsList().size())]


def test_exploded_rows_are_no_broadcast(spark, tmp_path):
    """An array counts as one element in an estimate: 1.2 million rows that seemed a few megabytes lay whole in the driver."""
    at = str(tmp_path / "classes")
    spark.range(4000).select("id", F.transform(F.sequence(F.lit(1), F.lit(300)), lambda i: F.xxhash64("id", i)).alias("bands")).write.parquet(at)
    e = spark.read.parquet(at).select("id", F.explode("bands").alias("b"))
    before = spark.conf.get(STATIC)
    spark.conf.set(STATIC, "12m")
    try:
        since = spark._jsparkSession.sharedState().statusStore().executionsList().size()
        with Scratch(spark) as scratch:
            kept = scratch.keep(e.join(e.groupBy("b").agg(F.count("*").alias("m")).where("m > 0"), "b"))
            assert kept.count() == 1_200_000
            final(e.join(e.withColumnRenamed("id", "other"), "b").groupBy("id").count())
        made = [p for p in plans(spark, since) if "Join" in p]
        assert len(made) == 2 and not any("BroadcastHashJoin" in p for p in made)
        assert spark.conf.get(STATIC) == "12m" and spark.conf.get(ADAPTIVE, None) is None
    finally:
        spark.conf.set(STATIC, before)


def test_settings_come_back(spark):
    before = spark.conf.get(STATIC)
    with measured_broadcasts(spark):
        with measured_broadcasts(spark):
            pass
        assert int(spark.conf.get(STATIC)) <= 256 << 10 and spark.conf.get(ADAPTIVE) == before
    assert spark.conf.get(STATIC) == before and spark.conf.get(ADAPTIVE, None) is None
    spark.conf.set(STATIC, "-1")
    try:
        with measured_broadcasts(spark):
            assert spark.conf.get(STATIC) == spark.conf.get(ADAPTIVE) == "-1"
    finally:
        spark.conf.set(STATIC, before)
