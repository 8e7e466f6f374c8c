"""Packing documents into fixed windows by non-negative least squares.

Documents become token ids and are cut into full windows and one remainder. Remainders fall into length classes; all
combinations of at most three classes that fill a window exactly are columns of a matrix, whose non-negative least-squares
solution against the class histogram gives repeat counts. Counts are rounded down to what the histogram holds, and the rest
is packed greedily, longest class first. Very short pieces are strung together to nearly a window first, since a class would
round them up. The plan depends on the histogram alone (a number per class), so it is made on the
driver; pieces are numbered within their class in a distributed way and looked up in the plan.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runledger.llm.common import in_python, materialised

WINDOW, GRAIN, DEPTH = 4096, 16, 3
#: Words whose ids a Python worker remembers; the memory is emptied beyond it.
CACHE_WORDS = 400_000
#: Pieces that are numbered in one sorted group; classes of pieces that are strung together; windows of text that one group of them fills.
GROUP_ROWS, TINY_CLASSES, GROUP_WINDOWS = 500, 8, 16


#: Marks the end of a word where merges are looked up; tokenizers with word ends have tokens that carry it.
_END = b"\x01"
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def _byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 itself, the rest from 256 on."""
    printable = [b for b in range(256) if chr(b).isprintable() and b not in (32, 160, 173)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def _ranked(path: str):
    """An encoder of marked words by merge rank and its flags of word-ending ids.

    None if the file has no vocabulary with word ends whose ids stand in the order of its merges.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, special = file["model"], {t["id"] for t in file["added_tokens"]}
    suffix = model.get("end_of_word_suffix")
    if model["type"] != "BPE" or not suffix or not {"Lowercase"} <= {n["type"] for n in (file["normalizer"] or {}).get("normalizers", [])}:
        return None
    merged = [model["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]]
    if any(a >= b for a, b in zip([-1, *merged], merged, strict=False)):
        return None
    byte_of, ranks = _byte_of_char(), {}
    for token, i in model["vocab"].items():
        if i not in special:
            core = token.removesuffix(suffix)
            if any(c not in byte_of for c in core):
                return None
            ranks[bytes(byte_of[c] for c in core) + _END * (core != token)] = i
    ends = np.zeros(max(ranks.values()) + 1, bool)
    ends[[i for token, i in ranks.items() if len(token) > 1 and token.endswith(_END)]] = True
    if len(ranks) != len(ends) or ends.sum() < 256:
        return None
    return tiktoken.Encoding("words", pat_str="[^ ]+", mergeable_ranks=ranks, special_tokens={}), ends


class WordEncoder:
    """Token ids of texts as little-endian unsigned 32-bit numbers, remembered word by word.

    For tokenizers that drop white space and never join across it, a text's ids are those of its words in order. Words are
    parted at blanks, tabs and line ends only. A run of letters, and marks after it, are pre-tokens of their own; runs of
    letters are merged by rank in bulk, which gives the tokenizer's ids at a fraction of its time. All other words are left to
    the tokenizer, as are whole texts that hold the string of a special token: it gets that token's id.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ranked = _ranked(path)
        self.known: dict[str, bytes] = {"": b""}

    def _learn_letters(self, words: list[str]) -> None:
        encoding, ends = self.ranked
        ids = np.array(encoding.encode_ordinary(" ".join(w.lower() + "\x01" for w in words)), np.uint32)
        raw, cuts = ids.tobytes(), [0, *((np.flatnonzero(ends[ids]) + 1) * 4).tolist()]
        self.known.update(zip(words, map(raw.__getitem__, map(slice, cuts, cuts[1:])), strict=True))

    def _learn(self, words: list[str]) -> None:
        known, letters, rest, parted = self.known, set(), set(), []
        for w in words:
            core = w.rstrip(_MARKS)
            if self.ranked and core.isalpha() and (core.isascii() or (unicodedata.is_normalized("NFC", core) and len(core.lower()) == len(core) and "Σ" not in core)):
                letters.add(core)
                if core != w:
                    rest.add(w[len(core) :])
                    parted.append((w, core))
            else:
                rest.add(w)
        if letters := [w for w in letters if w not in known]:
            self._learn_letters(letters)
        rest = [w for w in rest if w not in known]
        known.update((w, array("I", e.ids).tobytes()) for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True))
        known.update((w, known[core] + known[w[len(core) :]]) for w, core in parted)

    def __call__(self, given: list[str]) -> list[bytes]:
        if len(self.known) > CACHE_WORDS:
            self.known = {"": b""}
        known, whole = self.known, {}
        texts = [t.lower() if t.isascii() else t for t in given]
        for i, t in enumerate(texts):
            if any(x in t for x in self.special):
                whole[i] = array("I", self.tokenizer.encode(given[i], add_special_tokens=False).ids).tobytes()
        parts = ["" if i in whole else t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for i, t in enumerate(texts)]
        if missing := [w for w in set().union(*parts) if w not in known]:
            self._learn(missing)
        return [whole[i] if i in whole else b"".join(map(known.__getitem__, p)) for i, p in enumerate(parts)]


_ENCODERS: dict[str, WordEncoder] = {}


def cut_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = 2) -> DataFrame:
    """Pieces (key, start, length, ids, doc_tokens) of all documents: full windows, then the remainder.

    `ids` are little-endian unsigned 32-bit numbers in a binary. Every document ends with `end_id`, so null and empty texts
    give one piece of one id. Repeated rows give repeated pieces; the file `tokenizer` must lie on every executor.
    """
    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("doc_tokens", T.LongType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _ENCODERS:
            _ENCODERS[tokenizer] = WordEncoder(tokenizer)
        encode, end, width = _ENCODERS[tokenizer], array("I", [end_id]).tobytes(), 4 * window
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                of, start, ids, total = [], [], [], []
                for i, own in enumerate(encode([t or "" for t in some.column(1).to_pylist()])):
                    own += end
                    for a in range(0, len(own), width):
                        of.append(i)
                        start.append(a // 4)
                        ids.append(own[a : a + width])
                        total.append(len(own) // 4)
                lengths = pa.array([len(x) // 4 for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [some.column(0).take(pa.array(of, pa.int32())), pa.array(start, pa.int64()), lengths, pa.array(ids, pa.binary()), pa.array(total, pa.int64())],
                    [key, "start", "length", "ids", "doc_tokens"],
                )

    return in_python(docs.select(key, text), cut, schema)


def combinations(classes: int, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """All falling tuples of at most `depth` classes 1..classes whose sum is `classes`."""
    out: list[tuple[int, ...]] = []

    def fill(rest: int, most: int, slots: int, head: tuple[int, ...]) -> None:
        if rest == 0:
            out.append(head)
        elif slots:
            for c in range(min(rest, most), 0, -1):
                if c * slots >= rest:
                    fill(rest - c, c, slots - 1, (*head, c))

    fill(classes, classes, depth, ())
    return out


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Non-negative x that minimises |a x - b|, by the active-set method of Lawson and Hanson."""
    rows, cols = a.shape
    x, passive = np.zeros(cols), np.zeros(cols, bool)
    for _ in range(3 * rows):
        gain = a.T @ (b - a @ x)
        gain[passive] = -np.inf
        if (best := int(gain.argmax())) < 0 or gain[best] <= 1e-7 * max(1.0, b.max(initial=0)):
            break
        passive[best] = True
        while True:
            at = np.flatnonzero(passive)
            own = a[:, at]
            z = np.linalg.solve(own.T @ own + 1e-9 * np.eye(len(at)), own.T @ b)  # columns may depend on each other
            if (z > 0).all():
                x[:] = 0
                x[at] = z
                break
            low = z <= 0
            old = x[at]
            step = (old[low] / np.maximum(old[low] - z[low], 1e-30)).min()
            x[at] = old + step * (z - old)
            drop = at[(x[at] <= 1e-9) & low] if ((x[at] <= 1e-9) & low).any() else at[low][:1]
            x[drop] = 0
            passive[drop] = False
            if not passive.any():
                break
    return x


def plan(histogram: dict[int, int], classes: int, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """(combination of classes, repeats) that use up the histogram exactly; no combination exceeds `classes`."""
    left = np.zeros(classes + 1, np.int64)
    for c, n in histogram.items():
        left[c] = n
    out = [((classes,), int(left[classes]))] if left[classes] else []
    left[classes] = 0
    if left.any():
        options = [c for c in combinations(classes, depth) if len(c) > 1 and all(left[x] for x in c)]
        if options:
            matrix = np.zeros((classes, len(options)))
            for j, option in enumerate(options):
                for c in option:
                    matrix[c, j] += 1
            x = nnls(matrix, left[:classes].astype(float))
            for j in np.argsort(-x, kind="stable"):
                if (n := int(min(round(x[j]), *(left[c] // options[j].count(c) for c in set(options[j]))))) > 0:
                    out.append((options[j], n))
                    for c in options[j]:
                        left[c] -= n
    while left.any():  # greedy: the longest, then the longest that still fits
        bin_, room = [], classes
        rest = left.copy()
        while room and (fits := np.flatnonzero(rest[: room + 1])).size:
            c = int(fits[-1])
            bin_.append(c)
            rest[c] -= 1
            room -= c
        n = min(int(left[c]) // bin_.count(c) for c in set(bin_))
        out.append((tuple(bin_), n))
        for c in bin_:
            left[c] -= n
    return out


def place(pieces: DataFrame, key: str = "doc_id", window: int = WINDOW, grain: int = GRAIN, depth: int = DEPTH, tiny: int = TINY_CLASSES) -> DataFrame:
    """`pieces` (with key, start, length and any more columns) with sequence_id and offset, which replace columns of these names.

    Lengths are 1..window. The pieces are written once in the shared folder; only the histogram of classes and the number
    of groups reach the driver. Pieces that are equal in all columns take places in any order, and lie in one group. Names that
    begin with `_` are kept for this operator.
    """
    if window % grain:
        raise ValueError("the window must be a multiple of the grain")
    own = pieces.drop("sequence_id", "offset")
    columns, classes = own.columns, window // grain
    of_length = F.ceil(F.col("length") / grain).cast("int").alias("_class")
    own = materialised(own.select("*", of_length, F.xxhash64(*[F.col(f"`{c}`") for c in columns]).alias("_hash")), "pieces")
    histogram = {r["_class"]: (r["n"], r["ids"]) for r in own.groupBy("_class").agg(F.count("*").alias("n"), F.sum("length").alias("ids")).collect()}
    counts = {c: n for c, (n, _) in histogram.items() if c > tiny}
    if len(counts) == len(histogram):
        return _placed(own, counts, key, classes, depth).select(*columns, "sequence_id", "offset")

    # strings of tiny pieces: a string begins where the running length passes a multiple of the window less the longest tiny piece
    groups = 1 + sum(ids for c, (_, ids) in histogram.items() if c <= tiny) // (GROUP_WINDOWS * window)
    small = own.where(F.col("_class") <= tiny).withColumn("_group", F.pmod(F.col("_hash"), F.lit(groups)))
    order = Window.partitionBy("_group").orderBy("_hash", key, "start").rowsBetween(Window.unboundedPreceding, -1)
    small = small.withColumn("_ahead", F.coalesce(F.sum("length").over(order), F.lit(0))).withColumn("_string", F.floor(F.col("_ahead") / (window - tiny * grain)))
    small = materialised(small, "tiny")
    strings = small.groupBy("_group", "_string").agg(F.sum("length").alias("length"), F.min("_ahead").alias("_first"))
    strings = materialised(strings.select("*", of_length, F.xxhash64("_group", "_string").alias("_hash"), F.lit(0).cast("long").alias("start")), "strings")
    for r in strings.groupBy("_class").agg(F.count("*").alias("n")).collect():
        counts[r["_class"]] = counts.get(r["_class"], 0) + r["n"]
    units = own.where(F.col("_class") > tiny).unionByName(strings, allowMissingColumns=True)
    placed = materialised(_placed(units, counts, key, classes, depth), "placed")
    at = placed.where("_group IS NOT NULL").select("_group", "_string", "_first", "sequence_id", F.col("offset").alias("_offset"))
    inside = small.join(at, ["_group", "_string"]).withColumn("offset", F.col("_offset") + F.col("_ahead") - F.col("_first"))
    return placed.where("_group IS NULL").select(*columns, "sequence_id", "offset").unionByName(inside.select(*columns, "sequence_id", "offset"))


def _placed(units: DataFrame, counts: dict[int, int], key: str, classes: int, depth: int) -> DataFrame:
    """`units` (with key, start, length, _class, _hash) with sequence_id and offset; `counts` has how many there are of each class."""
    spark = units.sparkSession
    # places of the plan: ranks lo..hi-1 of a class go to slot `slot` of sequences from `first` on
    rows, used, first = [], dict.fromkeys(counts, 0), 0
    for option, n in plan(counts, classes, depth):
        for slot, c in enumerate(option):
            rows.append((c, used[c], used[c] + n, first, slot))
            used[c] += n
        first += n
    places = spark.createDataFrame(rows, "_class int, _lo long, _hi long, _seq long, _slot int")

    groups = spark.createDataFrame([(c, 1 + n // GROUP_ROWS) for c, n in counts.items()], "_class int, _groups long")
    grouped = units.join(F.broadcast(groups), "_class").withColumn("_in_class", F.pmod(F.col("_hash"), F.col("_groups"))).drop("_groups")
    sizes = grouped.groupBy("_class", "_in_class").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_class").orderBy("_in_class").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_class", "_in_class", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    in_group = F.row_number().over(Window.partitionBy("_class", "_in_class").orderBy("_hash", key, "start"))
    ranked = grouped.withColumn("_in", in_group).join(offsets, ["_class", "_in_class"]).withColumn("_rank", F.col("_before") + F.col("_in") - 1)
    placed = ranked.join(F.broadcast(places), "_class").where("_rank >= _lo AND _rank < _hi").withColumn("sequence_id", F.col("_seq") + F.col("_rank") - F.col("_lo"))
    ahead = Window.partitionBy("sequence_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0))).select(*units.columns, "sequence_id", "offset")


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """All documents' pieces with their ids, placed in sequences of at most `window` ids."""
    return place(cut_documents(docs, tokenizer, key, text, window), key, window)


def packed_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The pieces of `pack` with CRC-32 in place of the ids."""
    pieces = cut_documents(docs, tokenizer)
    pieces = pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return place(pieces).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
