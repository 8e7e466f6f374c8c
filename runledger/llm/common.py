"""What the operators of this subpackage share: word patterns, reading, and materialised tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger import ship
from runledger.batched import release_memory

#: White space between words, as Java, Python and RE2 patterns write it.
WHITE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` below `sf_dir`, which may be any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_python(df: DataFrame, f, schema) -> DataFrame:
    """`df.mapInArrow(f, schema)`, with this package at hand on the executors."""
    ship(df.sparkSession)

    def run(batches):
        yield from f(batches)
        release_memory()

    return df.mapInArrow(run, schema)


def of_group(f):
    """`f` of one group's table, for applyInArrow; memory is released after each group."""

    def run(table):
        out = f(table)
        release_memory()
        return out

    return run


def of_groups(f):
    """`f` of two cogrouped tables, for applyInArrow; memory is released after each group."""

    def run(left, right):
        out = f(left, right)
        release_memory()
        return out

    return run


def words_of(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text in order; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{WHITE}+"), "")


def crc32_of(text: Column) -> Column:
    """Unsigned CRC-32 of a text's UTF-8 bytes; null counts as empty."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def fold_of(key: Column, folds: int) -> Column:
    """The fold 0..folds-1 of a key: CRC-32 of its decimal text modulo folds."""
    return F.pmod(crc32_of(key.cast("string")), F.lit(folds))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one where it is unset (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if at is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="shared-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        at = f"file://{own}"
        spark.sparkContext.setCheckpointDir(at)
    return at


def materialised(df: DataFrame, name: str = "part") -> DataFrame:
    """`df`, written as a table in the shared folder and read again: lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    at = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)
