"""Links between items and sessions: calls and outputs, parents, lineage, metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def link_outputs(outputs: DataFrame, calls: DataFrame, source: str = "source_id", call: str = "native_call_id", item: str = "item_id") -> DataFrame:
    """`outputs` with call_item_id: the last call of the source with the same native id, or null."""
    last = calls.where(F.col(call).isNotNull()).groupBy(source, call).agg(F.max(item).alias("call_item_id"))
    return outputs.drop("call_item_id").join(last, [source, call], "left")


def next_of_kind(rows: DataFrame, session: str, order: str, kind: str, first: str, second: str, item: str) -> DataFrame:
    """(call, output) for every `first` row and the next row of its session, if that is a `second` row; else a null output."""
    ordered = Window.partitionBy(session).orderBy(order)
    following = rows.withColumn("_kind", F.lead(kind).over(ordered)).withColumn("_item", F.lead(item).over(ordered))
    return following.where(F.col(kind) == first).select(session, F.col(item).alias("call_item"), F.when(F.col("_kind") == second, F.col("_item")).alias("output_item"))


def resolve_parents(candidates: DataFrame, sessions: DataFrame, sources: DataFrame) -> DataFrame:
    """(session_id, kind, parent_session_id, record_id) from parent candidates, resolved when they are read.

    A candidate has a native id or a locator. The native id is looked up among sessions of the runtime, else the locator among
    sources; a session is never its own parent; of several candidates the lowest source wins.
    """
    by_native = sessions.select("runtime", F.col("native_id").alias("parent_native_id"), F.col("session_id").alias("_by_native"))
    by_locator = sources.select(F.col("locator").alias("parent_locator"), F.col("session_id").alias("_by_locator")).dropDuplicates(["parent_locator"])
    found = (
        candidates.join(by_native, ["runtime", "parent_native_id"], "left")
        .join(by_locator, ["parent_locator"], "left")
        .withColumn("parent_session_id", F.coalesce("_by_native", "_by_locator"))
        .where(F.col("parent_session_id").isNotNull() & (F.col("parent_session_id") != F.col("session_id")))
    )
    return found.groupBy("session_id", "kind").agg(F.min_by(F.struct("parent_session_id", "record_id"), "source_id").alias("p")).select("session_id", "kind", "p.*")


def with_metadata(sessions: DataFrame, metadata: DataFrame) -> DataFrame:
    """Metadata rows with the session they describe, matched by runtime and native id; unmatched rows stay."""
    return metadata.join(sessions.select("session_id", "runtime", "native_id"), ["runtime", "native_id"], "left")


def lineage(spark, edges_view: str, roots_view: str, most_levels: int | None = None) -> DataFrame:
    """(root, id, depth) reachable along parent links, by a recursive common table expression.

    No path is longer than the edges are many, which bounds the levels; a cycle ends there with an error. The session's limit of
    rows of such expressions is lifted, as the result grows with the edges.
    """
    levels = spark.table(edges_view).count() + 1 if most_levels is None else most_levels
    spark.conf.set("spark.sql.cteRecursionRowLimit", -1)
    return spark.sql(
        f"""WITH RECURSIVE line(root, id, depth) MAX RECURSION LEVEL {min(levels, 2**31 - 1)} AS (
              SELECT id, id, 0 FROM {roots_view}
              UNION ALL SELECT line.root, e.id, line.depth + 1 FROM line JOIN {edges_view} e ON e.parent = line.id)
            SELECT root, id, depth FROM line"""
    )
