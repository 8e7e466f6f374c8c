"""Text search: trigram candidates with an exact check, and ranked terms with phrases.

Two tables of postings serve an index: sorted by gram or term, so that a search reads the files and row groups of its few grams or
terms only. Without postings a search scans the texts once and explodes nothing but what matches.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger import ship
from runledger.functions import terms as T
from runledger.functions.text import contains_all, trigram_query, trigrams

#: Fixed values of the ranking function.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def term_list(text: Column) -> Column:
    """The folded search terms of texts, Arrow batch by batch."""
    ship(SparkSession.active())

    @F.pandas_udf("array<string>")
    def listed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [T.folded(x) for x in T.terms(t)])

    return listed(text)


def gram_postings(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """(gram, item): one row for each distinct trigram of a text."""
    return items.select(F.explode(trigrams(F.col(text))).alias("gram"), item)


def gram_candidates(postings: DataFrame, literal: str, item: str = "item_id") -> DataFrame:
    """Items that hold every trigram of the literal. Candidates, not matches: confirm them with `confirmed`."""
    grams = sorted(set(trigram_query(literal)))
    return postings.where(F.col("gram").isin(*grams)).groupBy(item).agg(F.count_distinct("gram").alias("_n")).where(F.col("_n") == len(grams)).select(item)


def holds_grams(text: Column, literal: str) -> Column:
    """What `gram_candidates` finds, as a predicate over texts that have no postings."""
    return contains_all(text, sorted(set(trigram_query(literal))))


def confirmed(text: Column, literal: str, fold: bool = False) -> Column:
    """The exact check of a candidate."""
    return F.instr(F.lower(text), literal.lower()) > 0 if fold else F.instr(text, literal) > 0


def density(postings: DataFrame, items: DataFrame, literals: list[str], item: str = "item_id", session: str = "session_id") -> DataFrame:
    """(term, candidate_items, candidate_sessions) for each literal, without reading texts."""
    hits = None
    for x in literals:
        own = gram_candidates(postings, x, item).select(F.lit(x).alias("term"), item)
        hits = own if hits is None else hits.union(own)
    return _density(hits.join(items.select(item, session), item), item, session)


def scanned_density(items: DataFrame, literals: list[str], item: str = "item_id", session: str = "session_id", text: str = "text") -> DataFrame:
    """What `density` counts, from one scan of texts that have no postings."""
    held = F.array(*[F.when(holds_grams(F.col(text), x), F.lit(x)) for x in literals])
    return _density(items.select(F.explode(F.array_compact(held)).alias("term"), item, session), item, session)


def _density(hits: DataFrame, item: str, session: str) -> DataFrame:
    return hits.groupBy("term").agg(F.count_distinct(item).alias("candidate_items"), F.count_distinct(session).alias("candidate_sessions"))


def term_postings(items: DataFrame, terms: Column, item: str = "item_id") -> DataFrame:
    """(term, item, positions, item_terms) from an array of terms."""
    listed = items.select(item, terms.alias("_terms")).select(item, F.size("_terms").alias("item_terms"), F.posexplode("_terms").alias("position", "term"))
    return listed.groupBy("term", item, "item_terms").agg(F.sort_array(F.collect_list("position")).alias("positions"))


def phrase_hits(postings: DataFrame, phrases: list[list[str]], item: str = "item_id") -> DataFrame:
    """(item, item_terms, phrase_no, hits): places where a phrase's terms follow each other. One read of the postings of all phrases."""
    places = F.array(*[F.struct(F.lit(t).alias("term"), F.lit(n).alias("phrase_no"), F.lit(i).alias("off")) for n, p in enumerate(phrases) for i, t in enumerate(p)])
    sizes = F.array(*[F.lit(len(p)) for p in phrases])
    starts = (
        postings.where(F.col("term").isin(*{t for p in phrases for t in p}))
        .select(item, "item_terms", "positions", F.explode(F.filter(places, lambda p: p["term"] == F.col("term"))).alias("_p"))
        .select(item, "item_terms", F.col("_p.phrase_no").alias("phrase_no"), F.col("_p.off").alias("_off"), F.explode("positions").alias("_at"))
        .groupBy(item, "item_terms", "phrase_no", (F.col("_at") - F.col("_off")).alias("_start"))
        .agg(F.count("*").alias("_n"))  # a start and an offset give one place, which holds one term
        .where(F.col("_n") == F.get(sizes, F.col("phrase_no")))
    )
    return starts.groupBy(item, "item_terms", "phrase_no").agg(F.count("*").alias("hits"))


def ranked(postings: DataFrame, query: str, n_items: int, mean_terms: float, item: str = "item_id") -> DataFrame:
    """(item, score) of items that hold every phrase of the query; lower is better, to be ordered by the caller.

    The idf is that of a phrase: ln((N - n + 0.5) / (n + 0.5)), at least a tiny positive value. The counts n are a row for each
    phrase of the query, and the hits that they come from are exchanged once.
    """
    phrases = T.search_query(query)
    hits = phrase_hits(postings, phrases, item)
    counts = hits.groupBy("phrase_no").agg(F.count("*").alias("_n"))
    idf = F.greatest(F.log((F.lit(n_items) - F.col("_n") + 0.5) / (F.col("_n") + 0.5)), F.lit(LEAST_IDF))
    weight = F.col("hits") * (K1 + 1) / (F.col("hits") + K1 * (1 - B + B * F.col("item_terms") / F.lit(float(mean_terms))))
    scored = hits.join(F.broadcast(counts), "phrase_no").groupBy(item).agg(F.sum(-idf * weight).alias("score"), F.count("*").alias("_phrases"))
    return scored.where(F.col("_phrases") == len(phrases)).select(item, "score")
