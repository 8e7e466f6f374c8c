"""Toxicity by Levenshtein automata over a lexicon trie, with context windows that part quotation from abuse.

The lexicon is learned from labelled documents: words of any length and word stems that are much likelier in toxic ones. Its
trie is intersected with Levenshtein automata of distance one, for whole words and, from a greater length on, for stems, which
any ending may follow. The product is compiled to a table-driven automaton that reads all distinct words of a block at once. Each hit is weighed by its context: within
quotation marks or after a reporting word it counts as quoted. A logistic model over the counts gives the score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runledger.llm import textblocks as tb
from runledger.llm.common import in_python, materialised

#: About how many labelled documents are learned from; what an entry of the lexicon needs.
SAMPLE_DOCS = 6000
LEAST_COUNT, LEAST_SHARE, LEAST_SURPRISE = 4, 0.75, 5.0
SHORTEST, LONGEST_STEM = 4, 10
#: Words of this length at least may be misspelled by one edit, and stems of this length.
FUZZY_LENGTH, FUZZY_STEM = 5, 6
#: Characters on either side of a hit that its context is judged by.
CONTEXT = 80
REPORTING = re.compile(r"\b(?:said|says|quote[ds]?|wrote|writes|called|term|word|phrase|reported|alleged|accused)\b", re.I)
QUOTES = {'"': '"', "“": "”", "«": "»", "„": "“", "‘": "’"}
MISS, EXACT, FUZZY = 0, 1, 2
#: Prior weights of the features (bias, plain, misspelled, quoted) and how firmly each is held.
PRIOR, HOLD = np.array([-3.0, 4.0, 2.0, 0.5]), np.array([0.01, 0.3, 2.0, 20.0])


@dataclass
class Automaton:
    """`step[state, symbol]` with state 0 dead and 1 first; `accept` by state; `symbol` by code point, 0 for others."""

    step: np.ndarray
    accept: np.ndarray
    symbol: np.ndarray

    def classes(self, code: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """MISS, EXACT or FUZZY for each run of code points."""
        state = np.ones(len(start), np.int32)
        live, k = np.arange(len(start)), 0
        while len(live := live[(size[live] > k) & (state[live] > 0)]):
            state[live] = self.step[state[live], self.symbol[np.minimum(code[start[live] + k], len(self.symbol) - 1)]]
            k += 1
        return self.accept[state]


def compile_lexicon(words: list[str], stems: list[str], edits: int = 1) -> Automaton:
    """The product of the lexicon's trie with Levenshtein automata, made deterministic."""
    children: list[dict[str, int]] = [{}]
    is_word, is_stem, fuzzy, fuzzy_stem = set(), set(), set(), set()
    for entry, kind in [(w, "word") for w in words] + [(s, "stem") for s in stems]:
        path = [0]
        for c in entry:
            if c not in children[path[-1]]:
                children[path[-1]][c] = len(children)
                children.append({})
            path.append(children[path[-1]][c])
        (is_word if kind == "word" else is_stem).add(path[-1])
        if len(entry) >= (FUZZY_LENGTH if kind == "word" else FUZZY_STEM):
            fuzzy.update(path)
            if kind == "stem":
                fuzzy_stem.add(path[-1])
    long_words = {n for n in is_word if n in fuzzy}

    def closed(items: set[tuple[int, int]]) -> frozenset[tuple[int, int]]:
        todo, out = list(items), set(items)
        while todo:
            node, e = todo.pop()
            if node in fuzzy and e < edits:  # a letter of the entry is missing in the text
                for child in children[node].values():
                    if child in fuzzy and (child, e + 1) not in out:
                        out.add((child, e + 1))
                        todo.append((child, e + 1))
        best: dict[int, int] = {}
        for node, e in out:
            best[node] = min(e, best.get(node, e))
        return frozenset(best.items())

    def after(items: frozenset[tuple[int, int]], c: str) -> frozenset[tuple[int, int]] | str:
        out = set()
        for node, e in items:
            if node < 0:
                continue
            child = children[node].get(c)
            if child is not None and (e == 0 or child in fuzzy):
                out.add((child, e))
                if e == 0 and child in is_stem:
                    return "stem"
            if e < edits and node in fuzzy:
                out.add((node, e + 1))  # a letter too many
                out.update((x, e + 1) for x in children[node].values() if x in fuzzy)  # another letter
        out = closed(out)
        misspelled = any(n in fuzzy_stem for n, _ in out) or any(n < 0 for n, _ in items)
        return out | {(-1, edits)} if misspelled else out  # node -1: any ending of a misspelled stem

    alphabet = sorted({c for node in children for c in node})
    first = closed({(0, 0)})
    ids: dict = {frozenset(): 0, first: 1, "stem": 2}
    order, table = [first], {}
    while order:
        here = order.pop()
        row = []
        for c in ["", *alphabet]:
            to = after(here, c)
            if to not in ids:
                ids[to] = len(ids)
                order.append(to)
            row.append(ids[to])
        table[ids[here]] = row
    step = np.zeros((len(ids), len(alphabet) + 1), np.int32)
    step[2] = 2
    for s, row in table.items():
        step[s] = row
    accept = np.zeros(len(ids), np.int8)
    accept[2] = EXACT
    for items, s in ids.items():
        if not isinstance(items, str) and s:
            accept[s] = EXACT if any(n in is_word and e == 0 for n, e in items) else FUZZY if any(n in long_words or n < 0 for n, _ in items) else MISS
    symbol = np.zeros(max([0, *map(ord, alphabet)]) + 2, np.int32)
    for i, c in enumerate(alphabet):
        symbol[ord(c)] = i + 1
    return Automaton(step, accept, symbol)


def quoted(text: str, start: int, end: int) -> bool:
    """True if text[start:end] stands within quotation marks, or soon after a reporting word, in its context window."""
    before, behind = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    for opening, closing in QUOTES.items():
        if opening == closing:
            if before.count(opening) % 2 and closing in behind:
                return True
        elif before.rfind(opening) > before.rfind(closing) and closing in behind:
            return True
    return bool(REPORTING.search(before[-CONTEXT // 2 :]))


def features(automaton: Automaton, texts: list[str | None]) -> np.ndarray:
    """Bias and log counts of plain, misspelled and quoted hits, a row for each text."""
    words = tb.Letters(texts)
    counts = np.zeros((len(texts), 3))
    if len(words.start):
        _, first, of = np.unique(words.hashes(), return_index=True, return_inverse=True)
        kinds = automaton.classes(words.code, words.start[first], words.size[first])[of]
        lowered: dict[int, str] = {}
        for i in np.flatnonzero(kinds):
            d = int(words.doc[i])
            t = lowered.setdefault(d, (texts[d] or "").lower())
            at = int(words.start[i] - words.at[d])
            counts[d, 2 if quoted(t, at, at + int(words.size[i])) else int(kinds[i]) - 1] += 1
    return np.concatenate([np.ones((len(texts), 1)), np.log1p(counts)], 1)


def choose_entries(counts: dict[str, tuple[int, int]], whole: dict[str, int], entire: dict[str, tuple[int, int]], base: float) -> tuple[list[str], list[str]]:
    """(words, stems) from the (toxic, clean) counts of prefixes and of `entire` words; `whole` has how often a
    prefix was the whole word.

    The shortest telling prefixes are taken, and lengthened as long as one longer prefix has nearly all of their counts. Whole
    words that tell by themselves are taken besides, so that they may be misspelled anywhere.
    """

    def telling(pair: tuple[int, int]) -> bool:
        t, c = pair
        n = t + c
        return t >= LEAST_COUNT and t >= LEAST_SHARE * n and t - n * base >= LEAST_SURPRISE * (n * base * (1 - base)) ** 0.5

    longer: dict[str, list[str]] = {}
    for p in counts:
        longer.setdefault(p[:-1], []).append(p)
    words, stems, taken = [], [], set()
    for p in sorted(counts, key=lambda p: (len(p), p)):
        if not telling(counts[p]) or any(p[:i] in taken for i in range(len(p))):
            continue
        taken.add(p)
        while (more := max(longer.get(p, []), key=lambda x: counts[x][0], default=None)) and counts[more][0] >= 0.95 * counts[p][0]:
            p = more
        (words if whole.get(p, 0) >= 0.9 * sum(counts[p]) else stems).append(p)
    return sorted({*words, *(w for w in entire if telling(entire[w]))}), stems


def logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray = PRIOR, hold: np.ndarray = HOLD) -> np.ndarray:
    """Weights of a logistic model, held near `prior`, by Newton's method."""
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + hold * (w - prior)
        change = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(hold), gradient)
        w = w - np.clip(change, -2, 2)
        if np.abs(change).max() < 1e-9:
            break
    return w


@dataclass
class Model:
    automaton: Automaton
    weights: np.ndarray


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id", sample_docs: int = SAMPLE_DOCS) -> Model:
    """Learns lexicon and weights from about `sample_docs` documents with a row in `labels` (training rows only, label 0 or 1).

    Null labels don't count; of several labels of one key the highest does. The sample is drawn by hash of the key from the
    labels alone, so its rows are few and are broadcast to the documents; it is written once in the shared folder.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).cast("int").alias("y"))
    draw = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 30)) / float(1 << 30)
    chosen = known.where(draw < min(1.0, sample_docs / max(1, known.count())))
    sample = materialised(docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("t")).join(F.broadcast(chosen), key).select("y", "t"), "labelled")
    totals = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("toxic")).first()
    if not totals["toxic"] or totals["toxic"] == totals["n"]:
        return Model(compile_lexicon([], []), PRIOR)
    words = sample.select("y", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("t"), F.lit(r"(\p{L}+)"), F.lit(1)))).alias("w"))
    by_word = words.groupBy("w").agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("clean"))
    by_word = materialised(by_word.where(F.length("w") >= SHORTEST), "words")
    may_tell = (F.col("toxic") >= LEAST_COUNT) & (F.col("toxic") >= LEAST_SHARE * (F.col("toxic") + F.col("clean")))
    lengths = F.sequence(F.lit(SHORTEST), F.least(F.length("w"), F.lit(LONGEST_STEM)))
    whole = F.sum(F.when(F.length("w") == F.col("n"), F.col("toxic") + F.col("clean")).otherwise(0)).alias("whole")
    prefixes = by_word.select("toxic", "clean", "w", F.explode(lengths).alias("n")).groupBy(F.substring("w", F.lit(1), F.col("n")).alias("p"))
    telling = prefixes.agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), whole).where(may_tell).collect()
    entire = {r["w"]: (r["toxic"], r["clean"]) for r in by_word.where(may_tell).collect()}
    chosen = choose_entries({r["p"]: (r["toxic"], r["clean"]) for r in telling}, {r["p"]: r["whole"] for r in telling}, entire, totals["toxic"] / totals["n"])
    automaton = compile_lexicon(*chosen)
    rows = scored(sample, Model(automaton, PRIOR), "t", features_to="features").select("y", "features").collect()
    return Model(automaton, logistic(np.array([r["features"] for r in rows]), np.array([r["y"] for r in rows], float)))


def scored(docs: DataFrame, model: Model, text: str = "text", score: str = "score", features_to: str | None = None) -> DataFrame:
    """`docs` with its text replaced by the column `score` (0 to 1), and `features_to` if named; columns of these names are replaced.

    Null and empty texts have no hits and all get the same score; texts of any length are read whole. Each row is scored by
    itself, so repeated rows and ties get equal scores; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in docs.schema if f.name not in (text, score, features_to)]
    schema = T.StructType([*kept, T.StructField(score, T.DoubleType()), *([T.StructField(features_to, T.ArrayType(T.DoubleType()))] if features_to else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in tb.blocks(batch, len(kept)):
                x = features(shared.value.automaton, texts)
                value = 1 / (1 + np.exp(-np.clip(x @ shared.value.weights, -30, 30)))
                own = [batch.column(i).slice(at, len(texts)) for i in range(len(kept))] + [pa.array(value, pa.float64())]
                yield pa.RecordBatch.from_arrays([*own, *([pa.array(x.tolist(), pa.list_(pa.float64()))] if features_to else [])], schema.fieldNames())

    return in_python(docs.select(*[F.col(f"`{f.name}`") for f in kept], text), run, schema)
