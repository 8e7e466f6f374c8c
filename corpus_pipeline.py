"""The corpus pipeline: toxic documents go, one document of each group of near copies stays, repeated passages go, documents
with benchmark items go, and what is left is packed into sequences.

Every stage takes (spark, docs, sf_dir) and returns documents with the same columns, the last the pieces of the packing.
Rows with one doc_id are one document: they stay or go together. Rows with a null doc_id can't be told apart, so only the
toxicity stage, which looks at each text by itself, removes them.

Only doc_id, text and, where there is one, n_chars mean something to the stages; columns of any other name are carried as they
are. Texts of any length are read whole, empty tables give empty ones, and of tied copies the smallest doc_id stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.llm import decontam, ngram_join, packing, registry, suffix_dedup, toxicity
from runledger.llm.common import materialised, table


#: Words of a shingle and percent of Jaccard similarity that make near copies (the query op3 has its own: 3 and 90).
NEAR_SHINGLE, NEAR_PERCENT = 5, 80


def _free(docs: DataFrame, name: str) -> str:
    """A column name like `name` that `docs` doesn't have, in any case."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go; null and empty texts have no hits and stay."""
    read, score = _free(docs, "read"), _free(docs, "toxicity")
    scored = toxicity.scored(docs.withColumn(read, F.col("text")), registry.toxicity_model(spark, sf_dir), read, score)
    return scored.where(F.col(score) < registry.TOXIC_FROM).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each component of similar documents stays; texts without words stay."""
    found = ngram_join.similar_components(docs.select("doc_id", "text"), percent=NEAR_PERCENT, size=NEAR_SHINGLE)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes that an earlier document holds in a 50-byte string go; a document goes if no word of it is left.

    A character that loses some of its bytes goes as a whole, since texts are strings; n_chars is counted again.
    """
    carried = F.struct(*[c for c in docs.columns if c != "text"]).alias("row")
    out = suffix_dedup.remove_repeats(docs.select("doc_id", "text", carried), decoded=True)
    left = (F.size("spans") == 0) | F.col("kept").rlike(r"[^\x20\x09-\x0D]")
    kind = {f.name: f.dataType for f in docs.schema}
    columns = {"text": F.col("kept"), "n_chars": F.length("kept")}
    return out.where(left).select(*[(columns[c].cast(kind[c]) if c in columns else F.col("row")[c]).alias(c) for c in docs.columns])


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item, or one with other numbers, names or units, go."""
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    gone = materialised(decontam.matches(docs.select("doc_id", "text"), items).select("doc_id").distinct(), "leaks")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 ids."""
    return packing.packed_digests(docs.select("doc_id", "text"), registry.tokenizer_file())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("repeats", drop_repeats),
    ("decontamination", drop_benchmark),
    ("packing", pack),
]
#: SQL can express neither the tokenizer nor the learned scores.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; each result is written in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialised(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
