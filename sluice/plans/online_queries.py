"""Queries of thresholds kept from batch to batch, of group scores by functions, and of tables whose columns a query names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.tables import register_tables
from ..operators import scorers, sketches
from . import bindings
from .io_queries import scratched
from .queries import R, query, r6

_t = bindings.table


@scratched(
    "sel_topk_online",
    f"""WITH {R} SELECT step, count(*) AS n, true AS close FROM r GROUP BY step""",
)
def _(s, d, at):
    """Scores in three batches, the last one sent twice: of each step the rows seen, and whether the share that reaches the cut is within
    the sketch's bound of what was asked for (rows that tie with the cut may go either way)."""
    rows = bindings.rollouts(s, d).select("step", "uid", F.col("adv").alias("score"))
    for version in (0, 1, 2, 2):
        sketches.absorb(rows.where(F.pmod("uid", F.lit(3)) == version), f"{at}/sketches", version)
    cuts = sketches.thresholds(s, f"{at}/sketches", 0.3)
    kept = sketches.select_online(rows, cuts)
    seen = kept.join(cuts.withColumnRenamed("n", "known"), "step").groupBy("step").agg(
        F.first("known").alias("n"), F.count("*").alias("all"), F.count_if("kept").alias("kept"), F.count_if(F.col("score") == F.col("cut")).alias("ties")
    )
    off = sketches.rank_error(1_600) * F.col("all") + 1
    close = (F.col("kept") >= 0.3 * F.col("all") - off) & (F.col("kept") - F.col("ties") <= 0.3 * F.col("all") + off) & (F.col("n") == F.col("all"))
    return seen.select("step", "n", close.alias("close"))


@query(
    "score_function_group",
    f"""WITH {R}, g AS (SELECT step, domain, stddev_pop(resp_len) / avg(resp_len) + max(reward) AS score FROM r GROUP BY ALL)
  SELECT step, domain, count(*) AS n, round(min(score), 6) AS score FROM r JOIN g USING (step, domain) GROUP BY step, domain""",
)
def _(s, d):
    """Spread of the lengths and the best reward of each step's domain, by functions of partial states."""

    def partial(b):
        x = b["resp_len"].to_numpy("float64")
        return [len(x), x.sum(), (x * x).sum(), b["reward"].max()]

    def whole(v):
        n, total, squares = v[:, 0].sum(), v[:, 1].sum(), v[:, 2].sum()
        mean = total / n
        return max(squares / n - mean * mean, 0.0) ** 0.5 / mean + v[:, 3].max()

    made = scorers.FunctionGroupScorer(partial, whole, ("resp_len", "reward"), keys=("step", "domain")).score(bindings.rollouts(s, d))
    return made.groupBy("step", "domain").agg(F.count("*").alias("n"), r6(F.min("score"), "score"))


@query(
    "log_columns_udtf",
    "SELECT event_id, round(value, 2) AS loss, CASE WHEN event_id % 3 = 0 THEN CAST(event_id AS DOUBLE) END AS acc, CAST(NULL AS DOUBLE) AS kl FROM events",
)
def _(s, d):
    """Log lines of events as a table with the columns that the query names."""
    register_tables(s)
    acc = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" acc:"), F.col("event_id").cast("string"))).otherwise(F.lit(""))
    line = F.concat(F.lit("step 1 loss:"), F.format_string("%.2f", F.round("value", 2)), acc, F.lit(" loss:7 other:1"))
    lines = _t(s, d, "events").select("event_id", line.alias("line"))
    return s.sql("SELECT event_id, round(loss, 2) AS loss, acc, kl FROM {lines}, LATERAL metric_columns(line, 'loss, acc,kl')", lines=lines)
