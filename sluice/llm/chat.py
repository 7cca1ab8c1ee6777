"""Chat formatting by perspective rotation, in DataFrame operations alone.

For every participant of a conversation the dialogue is rendered with that speaker as the assistant and all
others as named users; the mask covers what the assistant says. A rendering is kept as one row a message with its
place in the whole, so that a conversation of any length is never gathered in one task. Places need lengths, not
texts: they are running sums over short rows, first over ranges of the sorted messages, then within a range, and the
texts join them at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, final

END = "<|end|>\n"


def _said(c: Column) -> Column:
    """Marks that a text holds itself are broken up, so that nobody can end a turn or begin another's."""
    return F.replace(c, F.lit("<|"), F.lit("< |"))


def rotate(messages: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", narrator: str = "system") -> DataFrame:
    """One row for each conversation, participant and message: (conv, perspective, seq, turn, role, name, rendered,
    start, end, mask_start, mask_end).

    Participants are the distinct roles other than ``narrator``; its messages are the same for all. ``seq`` counts
    from 0 by (turn, role, text), nulls first; equal rows are messages of their own. ``rendered`` in the order of
    ``seq`` is the whole dialogue; places are in its characters, ends exclusive. The mask covers an assistant's text
    and end mark and is null elsewhere. "<|" in a text or role is rendered as "< |". A null role is a participant of
    its own, null as perspective and name and rendered as "unknown"; a null text is empty, and rows with a null
    conversation form one. Conversations of the narrator alone have no participant and no row.
    """
    with Scratch(messages.sparkSession) as scratch:
        m = messages.select(F.col(conv).alias("c"), F.col(turn).alias("t"), F.col(role).alias("r"), F.coalesce(text, F.lit("")).alias("x"))
        m = m.withColumn("tie", F.monotonically_increasing_id())
        # ranges of the sorted messages, and each message's number; both are fixed here, before anything depends on them
        order = ["c", "t", "r", "x", "tie"]
        m = m.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")
        m = scratch.keep(m.withColumns({"x": _said(F.col("x")), "part": F.spark_partition_id(), "i": F.monotonically_increasing_id()}))
        short = m.select("c", "r", "part", "i", F.length("x").alias("n"))
        told = F.col("r").eqNullSafe(narrator)
        who = short.where(~told).select(F.col("c").alias("c2"), F.col("r").alias("p")).distinct()
        short = short.join(who, F.col("c").eqNullSafe(F.col("c2"))).drop("c2")
        own = F.col("r").eqNullSafe(F.col("p"))
        as_role = F.when(own, "assistant").when(told, narrator).otherwise("user")
        head = F.concat(F.lit("<|"), as_role, F.lit("|>\n"), F.when(own | told, "").otherwise(F.concat(_said(F.coalesce("r", F.lit("unknown"))), F.lit(": "))))
        short = short.withColumn("size", (F.length(head) + F.col("n") + len(END)).cast("long")).drop("n")

        sums = short.groupBy("c", "p", "part").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
        before = Window.partitionBy("c", "p").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.select(F.col("c").alias("c2"), F.col("p").alias("p2"), F.col("part").alias("part2"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("off"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("nth"))
        within = Window.partitionBy("c", "p", "part").orderBy("i")
        short = short.withColumns({"end": F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)), "seq": F.row_number().over(within) - 1})
        short = short.join(sums, F.col("c").eqNullSafe(F.col("c2")) & F.col("p").eqNullSafe(F.col("p2")) & (F.col("part") == F.col("part2")))
        short = short.select("i", "p", "size", (F.col("off") + F.col("end")).alias("end"), (F.col("nth") + F.col("seq")).alias("seq"))
        out = short.join(m.drop("part"), "i").withColumns({"head": head, "start": F.col("end") - F.col("size")})
        out = out.select(
            F.col("c").alias(conv),
            F.col("p").alias("perspective"),
            F.col("seq").cast("long").alias("seq"),
            F.col("t").alias(turn),
            as_role.alias("role"),
            F.col("r").alias("name"),
            F.concat("head", "x", F.lit(END)).alias("rendered"),
            F.col("start").cast("long").alias("start"),
            F.col("end").cast("long").alias("end"),
            F.when(own, F.col("start") + F.length("head")).cast("long").alias("mask_start"),
            F.when(own, F.col("end") - 1).cast("long").alias("mask_end"),
        )
        return final(out)


def op6(messages: DataFrame) -> DataFrame:
    """conv_id, perspective, seq, turn, role, name, rendered, start, end, mask_start, mask_end; see ``rotate``."""
    return rotate(messages)


OP6_SQL = """
WITH m AS (SELECT conv_id, turn, role AS name, coalesce(text, '') AS x FROM conversations),
w AS (SELECT DISTINCT conv_id, name AS perspective FROM m WHERE name IS DISTINCT FROM 'system'),
j AS (SELECT m.*, w.perspective,
        CASE WHEN m.name IS NOT DISTINCT FROM w.perspective THEN 'assistant' WHEN m.name = 'system' THEN 'system' ELSE 'user' END AS role
      FROM m JOIN w ON m.conv_id IS NOT DISTINCT FROM w.conv_id),
h AS (SELECT *, replace(x, '<|', '< |') AS said,
        '<|' || role || '|>' || chr(10) || CASE WHEN role = 'user' THEN replace(coalesce(name, 'unknown'), '<|', '< |') || ': ' ELSE '' END AS head FROM j),
s AS (SELECT *, CAST(length(head) + length(said) + 8 AS BIGINT) AS size FROM h),
o AS (SELECT *, sum(size) OVER win AS e, row_number() OVER win - 1 AS seq FROM s
      WINDOW win AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, name NULLS FIRST, x ROWS UNBOUNDED PRECEDING))
SELECT conv_id, perspective, CAST(seq AS BIGINT) AS seq, turn, role, name, head || said || '<|end|>' || chr(10) AS rendered,
  CAST(e - size AS BIGINT) AS "start", CAST(e AS BIGINT) AS "end",
  CASE WHEN role = 'assistant' THEN CAST(e - size + length(head) AS BIGINT) END AS mask_start,
  CASE WHEN role = 'assistant' THEN CAST(e - 1 AS BIGINT) END AS mask_end
FROM o
"""
