"""Loops, positions and roles of ordered records as window operators.

All windows are partitioned by session: the data of one session is one order by nature, and sorting spills. Boundaries are
running counts, so there is no self-join and one shuffle serves every column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def partition_loops(rows: DataFrame, session: str, order: str, opens: Column) -> DataFrame:
    """`rows` with loop_no (1 on, null before the first opening row) and loop_position (0 on, null without a loop)."""
    ordered = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    numbered = rows.withColumn("loop_no", F.nullif(F.sum(opens.cast("int")).over(ordered), F.lit(0)).cast("long"))
    within = Window.partitionBy(session, "loop_no").orderBy(order)
    return numbered.withColumn("loop_position", F.when(F.col("loop_no").isNotNull(), F.row_number().over(within) - 1).cast("long"))


def request_or_steering(rows: DataFrame, session: str, order: str, human: Column, agent: Column) -> DataFrame:
    """The human rows with `role`: the first of its loop, with no agent row before it there, is a request, others steer."""
    within = Window.partitionBy(session, "loop_no").orderBy(order)
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.max(human.cast("int")).over(before), F.lit(0)) + F.coalesce(F.max(agent.cast("int")).over(before), F.lit(0)) == 0
    return rows.withColumn("semantic_role", F.when(human, F.when(first, F.lit("human.request")).otherwise(F.lit("human.steering"))))


def final_answers(rows: DataFrame, session: str, order: str, agent: Column) -> Column:
    """True for the last agent row of a loop if nothing follows it there."""
    within = Window.partitionBy(session, "loop_no").orderBy(order)
    return agent & F.lead(F.lit(1)).over(within).isNull()


def session_spine(loops: DataFrame, session: str, keys: list[Column]) -> DataFrame:
    """`loops` with session_position, 0 on, in the order of `keys` (time with missing last, source, ordinal)."""
    return loops.withColumn("session_position", (F.row_number().over(Window.partitionBy(session).orderBy(*keys)) - 1).cast("long"))


def record_ranges(rows: DataFrame, source: str, order: str, text: str) -> DataFrame:
    """`rows` with the half-open range of bytes [start, end) of each record; a line end of one byte follows every record."""
    before = Window.partitionBy(source).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.octet_length(text) + 1).over(before), F.lit(0)).cast("long")
    return rows.withColumn("start", start).withColumn("end", F.col("start") + F.octet_length(text))


def neighbourhood(rows: DataFrame, anchors: DataFrame, group: list[str], position: str, before: int, after: int) -> DataFrame:
    """The rows within `before` and `after` places of an anchor of their group, with the anchor's place.

    Every anchor row names its window of places, so the join is an equi-join on group and place, not a band join.
    """
    windows = anchors.select(*group, F.col(position).alias("anchor_position"), F.explode(F.sequence(F.col(position) - before, F.col(position) + after)).alias(position))
    return rows.join(windows, [*group, position])


def previous_gap(rows: DataFrame, key: str, order: list[str], stamp_ms: str) -> DataFrame:
    """`rows` with gap_ms to the previous row of the key."""
    return rows.withColumn("gap_ms", F.col(stamp_ms) - F.lag(stamp_ms).over(Window.partitionBy(key).orderBy(*order)))
