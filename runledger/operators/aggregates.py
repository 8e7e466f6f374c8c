"""Aggregates with the rules of sparse facts: unknown is not zero, snapshots replace, repeats count once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def null_poisoned_sum(value: Column) -> Column:
    """The sum, or null if one value is unknown."""
    return F.when(F.count(value) == F.count(F.lit(1)), F.sum(value))


def last_snapshot_sums(rows: DataFrame, key: list[str], owner: str, order: str, value: str) -> DataFrame:
    """Sums by owner of the last value of each key, attributed to the owner that saw the key first."""
    per_key = rows.groupBy(*key).agg(F.max_by(value, order).alias("_last"), F.min_by(owner, order).alias("_owner"))
    return per_key.groupBy(F.col("_owner").alias(owner)).agg(F.sum("_last").cast("long").alias("total"))


def first_seen(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row for each key: cumulative counters that were seen before are dropped."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def coverage(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Population, contributors and missing values by group."""
    return rows.groupBy(*by).agg(F.count("*").alias("population"), F.count(value).alias("contributors"), (F.count("*") - F.count(value)).alias("missing"))


def observed_roles(items: DataFrame, role: str, runtime: str) -> DataFrame:
    """Items by role, and the runtimes that have the role, in order."""
    return items.groupBy(role).agg(F.count("*").alias("items"), F.array_join(F.sort_array(F.collect_set(runtime)), ",").alias("runtimes"))
