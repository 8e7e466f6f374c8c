"""Language identification with a word-first backoff.

A known word adds its log frequency in each language. A word never seen in training adds the mean log frequency of its
longest character n-grams that were seen, from five characters down to one. Counts come from a bounded sample of the
training documents, which bounds the model that is sent to the executors; all texts are scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runledger.llm import textblocks as tb
from runledger.llm.common import in_python

#: About how many documents of each language are learned from, and the fewest times a word must occur in them.
SAMPLE_DOCS, LEAST_COUNT = 1000, 2
LONGEST_GRAM = 5
#: Marks of a word's ends in n-grams; the words of this count weigh in full in `score`.
OPEN, CLOSE = 2, 3
FULL_WORDS = 50


@dataclass
class Model:
    """Sorted hashes with log frequencies by language: of words, and of n-grams by their length."""

    langs: list[str]
    words: tuple[np.ndarray, np.ndarray]
    grams: dict[int, tuple[np.ndarray, np.ndarray]]


def _logs(counts: np.ndarray) -> np.ndarray:
    """Smoothed log frequencies of the rows of `counts` in each column."""
    return np.log((counts + 0.1) / (counts.sum(0) + 0.1 * len(counts) + 1)).astype(np.float32)


def _sorted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unique, of = np.unique(keys, return_inverse=True)
    total = np.zeros((len(unique), counts.shape[1]))
    np.add.at(total, of, counts)
    return unique, _logs(total)


def _gram_windows(code: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs with OPEN before and CLOSE after, joined, and the run of each code point."""
    whole = size + 2
    of = np.repeat(np.arange(len(start)), whole)
    inside = np.arange(len(of)) - np.repeat(np.cumsum(whole) - whole, whole)
    out = code[np.clip(start[of] + inside - 1, 0, max(0, len(code) - 1))].copy() if len(of) else np.zeros(0, np.uint32)
    out[inside == 0] = OPEN
    out[inside == whole[of] - 1] = CLOSE
    return out, of


def _gram_hashes(code: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams inside runs, and their runs."""
    if len(code) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keep = np.flatnonzero(of[: len(of) - n + 1] == of[n - 1 :])
    return tb.hash_runs(code, keep, np.full(len(keep), n)), of[keep]


def fit(docs: DataFrame, train: F.Column, text: str = "text", lang: str = "lang", key: str = "doc_id", sample_docs: int = SAMPLE_DOCS) -> Model:
    """Learns from about `sample_docs` documents of each language among those where `train` is true."""
    known = docs.where(train & F.col(lang).isNotNull() & F.col(text).isNotNull())
    share = {r[0]: min(1.0, sample_docs / r[1]) for r in known.groupBy(lang).agg(F.count("*")).collect()}
    langs = sorted(share)
    if not langs:
        return Model([], (np.zeros(0, np.uint64), np.zeros((0, 0), np.float32)), {})
    draw = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 30)) / float(1 << 30)
    rate = F.element_at(F.create_map(*[F.lit(x) for pair in share.items() for x in pair]), F.col(lang))
    words = known.where(draw < rate).select(lang, F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), F.lit(1))).alias("word"))
    rows = words.groupBy(lang, "word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT).collect()
    at = {x: i for i, x in enumerate(langs)}
    total: dict[str, np.ndarray] = {}
    for r in rows:
        total.setdefault(r["word"].lower(), np.zeros(len(langs)))[at[r[lang]]] += r["n"]
    own = sorted(total)
    counts = np.array([total[w] for w in own]).reshape(len(own), len(langs))
    size = np.fromiter(map(len, own), np.int64, len(own))
    code = np.frombuffer("".join(own).encode("utf-32-le"), np.uint32)
    padded, of = _gram_windows(code, np.cumsum(size) - size, size)
    grams = {}
    for n in range(1, LONGEST_GRAM + 1):
        h, word = _gram_hashes(padded, of, n)
        grams[n] = _sorted(h, np.sqrt(counts)[word])  # words that occur often don't drown the others' n-grams
    return Model(langs, _sorted(tb.hash_words(own), counts), grams)


def score_texts(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """The language and its share of belief for each text; `und` and 0 without a letter or a model."""
    n_langs = len(model.langs)
    words = tb.Letters(texts)
    if not n_langs or not len(words.start):
        return ["und"] * len(texts), np.zeros(len(texts))
    unique, first, of = np.unique(words.hashes(), return_index=True, return_inverse=True)
    value = np.zeros((len(unique), n_langs), np.float32)
    at, found = tb.lookup(model.words[0], unique)
    value[found] = model.words[1][at[found]]
    rest = np.flatnonzero(~found)
    for n in range(LONGEST_GRAM, 0, -1):
        if not len(rest):
            break
        code, run = _gram_windows(words.code, words.start[first[rest]], words.size[first[rest]])
        h, run = _gram_hashes(code, run, n)
        at, hit = tb.lookup(model.grams[n][0], h)
        hits = np.bincount(run[hit], minlength=len(rest))
        seen = hits > 0
        for k in range(n_langs):
            mean = np.bincount(run[hit], model.grams[n][1][at[hit], k], len(rest))[seen] / hits[seen]
            value[rest[seen], k] = mean
        rest = rest[~seen]
    n_words = np.bincount(words.doc, minlength=len(texts))
    total = np.stack([np.bincount(words.doc, value[of, k], len(texts)) for k in range(n_langs)], 1)
    total *= np.minimum(1, FULL_WORDS / np.maximum(1, n_words))[:, None]
    belief = np.exp(total - total.max(1, keepdims=True))
    belief /= belief.sum(1, keepdims=True)
    best = belief.argmax(1)
    return [model.langs[b] if n else "und" for b, n in zip(best, n_words, strict=True)], np.where(n_words > 0, belief[np.arange(len(texts)), best], 0.0)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` without its text, with lang_pred and score.

    Null texts and texts without a letter are `und` with score 0; ties go to the first language in order.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in docs.schema if f.name not in (text, "lang_pred", "score")]
    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in tb.blocks(batch, len(kept)):
                langs, score = score_texts(shared.value, texts)
                own = [batch.column(i).slice(at, len(texts)) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*own, pa.array(langs, pa.string()), pa.array(score, pa.float64())], schema.fieldNames())

    return in_python(docs.select(*[f.name for f in kept], text), run, schema)
