"""Language-model scoring with a weighted backoff automaton.

States are the contexts of n-grams that the training texts have, arcs carry smoothed probabilities, and a state that lacks an
arc falls back by its weighted failure arc to the next shorter context, up to the empty one, which has arcs for all words.
Smoothing interpolates: p(w | u) = (c(u w) + m(u) p(w | u')) / (c(u) + m(u)), with m(u) = c(u) ** SPREAD, so a failure arc weighs
m(u) / (c(u) + m(u)); the empty context has add-one probabilities. All statistics are plain counts.

Counts are too many to send to every executor. Documents are dealt to groups; a group sends its distinct n-grams, as sorted
64-bit hashes in ranges, to be summed over all groups, and gets back the totals of exactly its own n-grams, in order. Each
group then builds the part of the automaton that its texts can reach, and one traversal from left to right scores them.

The ranges grow in number with the groups, so that each can be summed in bounded memory. A group sends no empty block, so there
are never more blocks than n-grams; from some hundred GB on they get small, and rows of n-grams would cost as much.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runledger import ship
from runledger.llm import textblocks as tb
from runledger.llm.common import materialised, of_group, of_groups

ORDER, SPREAD = 2, 0.95
#: Bytes of text in a group of documents, ranges of hashes at least, and tokens of a text that are traversed in a row.
GROUP_BYTES, LEAST_PARTS, SEGMENT = 8_000_000, 128, 256
START, END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)

BLOCK = T.StructType([T.StructField("level", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("group", T.IntegerType()), T.StructField("keys", T.BinaryType()), T.StructField("counts", T.BinaryType())])
TOTAL = T.StructType([T.StructField("level", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("group", T.IntegerType()), T.StructField("totals", T.BinaryType()), T.StructField("tokens", T.LongType()), T.StructField("distinct", T.LongType())])


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of the tokens of texts: words, then one END each, in order."""
    words = tb.Words(texts)
    doc = np.concatenate((words.doc, np.arange(len(texts))))
    order = np.argsort(doc, kind="stable")
    return np.concatenate((words.hashes(), np.full(len(texts), END)))[order], doc[order]


def contexts(token: np.ndarray, doc: np.ndarray, order: int) -> list[np.ndarray]:
    """By level 1..order, the hash of the n-gram of that level that ends at each token; START stands before a text."""
    levels, first = [token], np.concatenate(([True], doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, bool)
    back = token
    gram = token
    for _ in range(1, order):
        back = np.concatenate(([START], back[:-1])) if len(back) else back
        back = np.where(first, START, back)
        gram = tb.mix(gram * np.uint64(0x9E3779B97F4A7C15) ^ tb.mix(back + np.uint64(len(levels))))
        levels.append(gram)
    return levels


def group_blocks(texts: list[str | None], train: np.ndarray, order: int, parts: int) -> Iterator[tuple[int, int, bytes, bytes]]:
    """(level, part, keys, counts) of a group: its distinct n-grams and their counts in the training texts."""
    token, doc = tokens(texts)
    weight = train[doc].astype(np.float64)
    for level, keys in enumerate(contexts(token, doc, order)):
        unique, of = np.unique(keys, return_inverse=True)
        counts = np.bincount(of, weight, len(unique)).astype(np.int64)
        for p, some in tb.part_slices(unique, 64, parts):
            yield level, p, tb.pack_sorted(unique[some]), tb.pack_counts(counts[some])


def sum_blocks(blocks: pa.Table) -> pa.Table:
    """The blocks of one level and part, summed: each group's totals in the order of its keys."""
    keys = [tb.unpack_sorted(k) for k in blocks["keys"].to_pylist()]
    unique, of = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(of, np.concatenate([tb.unpack_counts(c) for c in blocks["counts"].to_pylist()]).astype(np.float64), len(unique)).astype(np.int64)
    ends = np.cumsum([len(k) for k in keys])
    totals = [tb.pack_counts(total[of[e - len(k) : e]]) for k, e in zip(keys, ends, strict=True)]
    one = [0] * (len(keys) - 1)
    return pa.table(
        {
            "level": blocks["level"], "part": blocks["part"], "group": blocks["group"], "totals": pa.array(totals, pa.binary()),
            "tokens": pa.array([int(total.sum()), *one], pa.int64()), "distinct": pa.array([int((total > 0).sum()), *one], pa.int64()),
        }
    )


class Automaton:
    """The part of the backoff automaton that some texts can reach.

    State 0 is the empty context. `arc` has the sorted keys state * words + word of the other states' arcs, `arc_log` and `arc_to`
    their weights (log10) and targets; `empty_log` and `empty_to` are the arcs of state 0 by word; `fail` and `fail_log` are the
    failure arcs by state. `word` has the number of the word of each token; `first` is the state before a text.
    """

    def __init__(self, token: np.ndarray, doc: np.ndarray, counts: list[np.ndarray], train_tokens: int, vocabulary: int, train_docs: int, spread: float):
        """`counts` by level: the training counts of the texts' distinct n-grams in the order of their hashes."""
        order = len(counts)
        grams = contexts(token, doc, order)
        unique, self.word = np.unique(grams[0], return_inverse=True)
        n_words = len(unique)
        before = np.concatenate(([0], self.word[:-1])) if len(token) else self.word
        starts = np.concatenate(([True], doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, bool)
        # a state for each word, one for the start of a text, and from order 3 on one for each n-gram and more for the start
        self.known = counts[0]
        p = (counts[0] + 1) / (train_tokens + vocabulary + 1)
        self.empty_log = np.log10(p)
        states = 1 + np.arange(n_words)
        self.empty_to = np.where(counts[0] > 0, states, 0)
        total = [np.array([0]), counts[0], np.array([train_docs])]  # the counts of the contexts, by state
        fail = [np.array([0]), np.zeros(n_words, np.int64), np.array([0])]
        self.first, n_states = 1 + n_words, 2 + n_words
        state = np.where(starts, self.first, states[before]) if len(token) else before  # the context of each token, one level at a time
        lower, at_word = p[self.word], self.word
        keys, logs, to = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, np.int64)]
        for level in range(1, order):
            _, place, of = np.unique(grams[level], return_index=True, return_inverse=True)
            c, context, word = counts[level], state[place] if len(place) else place, at_word[place] if len(place) else place
            of_context = np.concatenate(total)[context]
            mass = of_context.astype(float) ** spread
            arc_p = (c + mass * (lower[place] if len(place) else 0)) / np.maximum(of_context + mass, 1e-300)
            last = level == order - 1
            target = self.empty_to[word] if last and level == 1 else shorter[place] if last else n_states + np.arange(len(c))
            seen = c > 0
            keys.append(context[seen] * n_words + word[seen])
            logs.append(np.log10(arc_p[seen]))
            to.append(target[seen])
            if not last:  # the n-grams of this level are contexts of the next, and one more stands before a text
                total += [c, np.array([train_docs])]
                fail += [self.empty_to[word], np.array([self.first])]
                own = n_states + of
                shorter = np.where(c[of] > 0, own, self.empty_to[self.word])
                state = np.where(starts, n_states + len(c), np.concatenate(([0], own[:-1])) if len(own) else own)
                self.first, n_states = n_states + len(c), n_states + len(c) + 1
                lower = arc_p[of] if len(of) else lower
        sort = np.argsort(np.concatenate(keys), kind="stable")
        self.arc, self.arc_log, self.arc_to = (np.concatenate(x)[sort] for x in (keys, logs, to))
        total, self.fail = np.concatenate(total).astype(float), np.concatenate(fail)
        mass = total**spread
        self.fail_log = np.log10(np.where(total > 0, mass / np.maximum(total + mass, 1e-300), 1))  # a context without counts costs nothing
        self.order, self.doc, self.starts = order, doc, starts

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log10 weight, state) after reading a word in each state, over failure arcs where need be."""
        weight, todo, state = np.zeros(len(state)), np.arange(len(state)), state.copy()
        while len(todo):
            s, w = state[todo], word[todo]
            empty = s == 0
            at, found = tb.lookup(self.arc, s * len(self.empty_to) + w)
            found &= ~empty
            done = todo[found]
            weight[done] += self.arc_log[at[found]]
            state[done] = self.arc_to[at[found]]
            done = todo[empty]
            weight[done] += self.empty_log[w[empty]]
            state[done] = self.empty_to[w[empty]]
            todo = todo[~found & ~empty]
            weight[todo] += self.fail_log[state[todo]]
            state[todo] = self.fail[state[todo]]
        return weight, state

    def traverse(self) -> np.ndarray:
        """The log10 weights of all tokens, reading the texts from left to right.

        Texts are read side by side in segments. A segment within a text first reads the order - 1 tokens before it from the empty
        state, which leads to the state that the whole text before it leads to: the longest context that the automaton has.
        """
        out = np.zeros(len(self.word))
        place = np.arange(len(self.word)) - np.flatnonzero(self.starts)[np.cumsum(self.starts) - 1]
        begin = np.flatnonzero(place % SEGMENT == 0)
        size = np.diff(begin, append=len(self.word))
        by_size = np.argsort(-size, kind="stable")
        begin, size = begin[by_size], size[by_size]
        state = np.where(place[begin] == 0, self.first, 0)
        inner = np.flatnonzero(place[begin] > 0)
        for back in range(self.order - 1, 0, -1):
            _, state[inner] = self.step(state[inner], self.word[begin[inner] - back])
        for k in range(int(size.max(initial=0))):
            live = int(np.searchsorted(-size, -k, "left"))  # segments of more than k tokens come first
            out[begin[:live] + k], state[:live] = self.step(state[:live], self.word[begin[:live] + k])
        return out


def score_documents(docs: DataFrame, train: F.Column, key: str = "doc_id", text: str = "text", order: int = ORDER, spread: float = SPREAD, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row, learning from rows where `train` is true.

    Null texts count as empty: one end token. Without training rows all probabilities are those of an unknown token. Rows with
    one key are scored each by itself. `order` is 2 or 3. Repeated rows lie in one group and get equal scores; other rows are dealt
    by hash. A text of any length lies in one group whole. An empty table gives an empty one; other columns are not read.
    """
    if order not in (2, 3):
        raise ValueError("order must be 2 or 3")
    ship(docs.sparkSession)
    own = docs.select(F.col(key).alias("_key"), F.coalesce(train, F.lit(False)).alias("_train"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    size = own.agg(F.sum(F.octet_length("_text") + 1).alias("b"), F.count(F.when(F.col("_train"), 1)).alias("docs")).first()
    groups = max(8, -(-(size["b"] or 0) // group_bytes))
    parts = max(LEAST_PARTS, groups // 2)
    dealt = own.withColumn("_group", F.pmod(F.xxhash64("_key", "_text"), F.lit(groups)).cast("int"))

    def count(rows: pa.Table) -> pa.Table:
        found = list(zip(*group_blocks(rows["_text"].to_pylist(), rows["_train"].to_numpy(zero_copy_only=False), order, parts), strict=True)) or [()] * 4
        level, part, keys, counts = (pa.array(x, kind) for x, kind in zip(found, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True))
        return pa.table({"level": level, "part": part, "group": pa.array([rows["_group"][0].as_py()] * len(level), pa.int32()), "keys": keys, "counts": counts})

    blocks = dealt.select("_train", "_text", "_group").groupBy("_group").applyInArrow(of_group(count), BLOCK)
    totals = materialised(blocks.groupBy("level", "part").applyInArrow(of_group(sum_blocks), TOTAL), "counts")
    sums = totals.where("level = 0").agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n"), F.coalesce(F.sum("distinct"), F.lit(0)).alias("v")).first()
    n, v, train_docs = int(sums["n"]), int(sums["v"]), int(size["docs"])
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("train_tokens", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])

    def score(texts: pa.Table, own_totals: pa.Table) -> pa.Table:
        rows = texts["_text"].to_pylist()
        token, doc = tokens(rows)
        where = {(a, b): c for a, b, c in zip(own_totals["level"].to_pylist(), own_totals["part"].to_pylist(), own_totals["totals"].to_pylist(), strict=True)}
        counts = [np.concatenate([np.zeros(0, np.int64), *(tb.unpack_counts(where[x]) for x in sorted(where) if x[0] == level)]) for level in range(order)]
        automaton = Automaton(token, doc, counts, n, v, train_docs, spread)
        logs, known = automaton.traverse(), automaton.known[automaton.word]
        base = automaton.empty_log[automaton.word]
        per = lambda x: np.bincount(doc, x, len(rows))
        return pa.table(
            {
                key: texts["_key"], "held_out": pc.invert(texts["_train"]), "n_tokens": pa.array(np.bincount(doc, minlength=len(rows)), pa.int64()),
                "n_known": pa.array(per(known > 0).astype(np.int64)), "train_tokens": pa.array(np.full(len(rows), n), pa.int64()),
                "base_score": pa.array(per(base)), "score": pa.array(per(logs)),
            }
        )

    return dealt.groupBy("_group").cogroup(totals.groupBy("group")).applyInArrow(of_groups(score), schema)
