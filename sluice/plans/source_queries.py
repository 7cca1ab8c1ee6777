"""Queries of the run-file data source, over trees and logs written from the tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import readers, sinks
from ..sources.run_files import read_files, read_lines, stream_lines
from . import bindings
from .io_queries import scratched
from .queries import big

_t = bindings.table


@scratched(
    "io_run_lines",
    """SELECT o_orderstatus AS status, o_orderpriority AS priority, CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS total,
  CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY ALL""",
)
def _(s, d, at):
    """Orders as JSON lines in folders by status and priority, read back with their keys from the path."""
    o = _t(s, d, "orders")
    said = F.to_json(F.struct("o_totalprice", "o_orderkey"))
    o.select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), said.alias("line")).write.partitionBy("status", "priority").text(at)
    got = read_lines(s, at, keys=("status", "priority"), suffix=".txt").withColumn("o", F.from_json("value", "o_totalprice double, o_orderkey long"))
    return got.groupBy("status", "priority").agg(
        big(F.count("*"), "n"), F.round(F.sum("o.o_totalprice"), 2).alias("total"), big(F.sum("o.o_orderkey"), "keys")
    )


@scratched(
    "io_run_tree",
    """SELECT CAST(s_nationkey AS VARCHAR) AS nation, CAST(s_suppkey AS VARCHAR) AS run, unnest([{'metric': 'acc', 'value': s_suppkey / 4.0::DOUBLE},
  {'metric': 'overall.kept', 'value': 0.0::DOUBLE}], recursive := true) FROM supplier WHERE s_nationkey IN (3, 7, 11) OR s_nationkey > 15""",
)
def _(s, d, at):
    """A result file a supplier, of which the filter's folders alone are listed and opened, with metrics of any key."""
    said = F.concat(F.lit('{"acc": '), (F.col("s_suppkey") / 4).cast("string"), F.lit(', "overall": {"kept": "0", "note": null}}'))
    tree = _t(s, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("run"), said.alias("value"))
    sinks.write_files(tree, at, ("nation", "run"))
    wanted = [str(n) for n in (3, 7, 11, *range(16, 25))]
    got = read_files(s, at, keys=("nation", "run")).where(F.col("nation").isin(wanted))
    return readers.metric_leaves(got, "value", ("nation", "run"))


@scratched(
    "stream_run_logs",
    """SELECT event_type AS kind, metric, CAST(count(*) AS BIGINT) AS n, round(sum(number), 2) AS total
  FROM (SELECT event_type, 'm_value' AS metric, value AS number FROM events UNION ALL SELECT event_type, 'm_user', user_id FROM events) GROUP BY ALL""",
)
def _(s, d, at):
    """Logs by event type that grow while the stream is away: it goes on where it was, and every line counts once."""
    e = _t(s, d, "events")
    line = F.concat(F.lit("step m_value:"), F.col("value").cast("string"), F.lit(" m_user:"), F.col("user_id").cast("string"))
    half = e.agg(F.percentile_approx("event_id", 0.5)).first()[0]
    for part in ("event_id <= {0}", "event_id > {0}"):
        new = e.where(part.format(half)).select(F.col("event_type").alias("kind"), line.alias("value"))
        new.write.mode("append").partitionBy("kind").text(f"{at}/in")
        lines = readers.log_metrics(stream_lines(s, f"{at}/in", keys=("kind",), suffix=".txt"), "m_", keep=("kind",))
        lines.writeStream.option("checkpointLocation", f"{at}/check").trigger(availableNow=True).start(f"{at}/out").awaitTermination()
    got = s.read.schema("kind string, metric string, number double").parquet(f"{at}/out")
    return got.groupBy("kind", "metric").agg(big(F.count("*"), "n"), F.round(F.sum("number"), 2).alias("total"))
