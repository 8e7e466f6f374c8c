"""Removal of byte strings that an earlier document holds, by interval expansion on a Burrows-Wheeler transform.

Every byte covered by a 50-byte window that also starts in a document with a smaller key goes. Equal windows must meet first:
each window is known by its minimizer, the least hash of the 24-byte strings in it, and consecutive windows with one minimizer
make a run. Minimizers that one document alone has are dropped; the runs of the others are brought together by minimizer,
equal runs as one. Where a minimizer has different runs, their texts are joined into one text whose Burrows-Wheeler
transform is searched breadth first: from the intervals of single bytes, every backward step splits the intervals by one more
byte, so common prefixes appear by increasing length, and the search stops at 50. What is still undivided then is a class of
equal windows, and its smallest key decides. A part is searched by ranges of its minimizers, and a minimizer with more runs than
a range may hold by ranges of its windows' hashes, so memory follows neither the input nor the most frequent string.

Documents are dealt to groups of some megabytes once and written as a bucketed table, a file for some groups; the later passes
read it without a shuffle. Equal texts are found first and take no part but for the smallest key.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runledger import ship
from runledger.llm import textblocks as tb
from runledger.llm.common import materialised, of_group, of_groups, shared_folder

LENGTH, ANCHOR = 50, 24
#: Bytes of text in a group, and bits of a minimizer.
GROUP_BYTES, MINIMIZER_BITS = 4_000_000, 48
#: Groups that share a bucket of their table, and buckets up to which each group has its own; Spark takes 100,000 buckets at most.
BUCKET_GROUPS, OWN_BUCKETS, MOST_BUCKETS = 8, 64, 50_000
#: Bytes of a composed backward step, and windows that are hashed at a time.
STRIDE = 7
SLICE = 1 << 16
#: Of a part: bytes of runs that are searched at once, minimizers that are sorted at once, and hashes of windows of one minimizer.
SEARCHED_BYTES, SORTED, HASHED = 2_000_000, 500_000, 2_000_000
NO_KEY = np.iinfo(np.int64).max

_BLOCK = "part int, grp int, mu binary, n binary, size binary, data binary"
_ANSWER = "kind int, part int, grp int, state binary, mask binary"


def equal_windows(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(class, start) over the joined texts: `class[start[i] + k]` is the class of the window at k of text i.

    Equal windows of `length` bytes inside texts share a class. Places without a whole window have classes too, of no meaning.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    start = np.cumsum(sizes + 1) - sizes - 1
    symbol = np.zeros(int(sizes.sum()) + len(texts), np.int16)
    inside = np.ones(len(symbol), bool)
    inside[start + sizes] = False
    symbol[inside] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int16) + 1  # 0 parts the texts
    del inside
    order = _sorted_suffixes(symbol, length)
    n, places = len(order), order.dtype
    transform = symbol[order - 1]  # the symbol before each suffix in order
    back = np.argsort(transform, kind="stable").astype(places)  # place j holds c X where place back[j] holds X
    first = symbol[order]
    divided = np.ones(n, bool)
    divided[1:] = first[1:] != first[:-1]
    del symbol, transform, first
    # Every step extends all intervals backward: a border between two places stays undivided as long as the places that they
    # came from lie in one interval. The first steps are of one byte; seven of them composed make the strides that follow.
    stride_back = back
    for _ in range(STRIDE - 1):
        stride_back = back[stride_back]
    border, reached = np.flatnonzero(~divided).astype(places), 1
    while reached < length and len(border):
        stride = STRIDE if STRIDE <= reached and reached + STRIDE <= length else 1
        origin = stride_back if stride > 1 else back
        interval = np.cumsum(divided, dtype=np.int32)
        apart = interval[origin[border - 1]] != interval[origin[border]]
        divided[border[apart]] = True
        border = border[~apart]
        reached += stride
    classes = np.empty(n, np.int32)
    classes[order] = np.cumsum(divided, dtype=np.int32) - 1
    return classes, start


def _sorted_suffixes(symbol: np.ndarray, length: int) -> np.ndarray:
    """The suffixes in the order of their first `length` symbols (0..256); places have 32 bits as long as they fit."""
    n, known = len(symbol), 7
    places = np.int32 if n < 1 << 31 else np.int64
    padded = np.concatenate((symbol, np.zeros(known, symbol.dtype)))
    key = np.zeros(n, np.int64)
    for k in range(known):
        key <<= 9
        key |= padded[k : k + n]
    del padded
    order = np.argsort(key).astype(places)
    while known < length:
        rank, new = np.empty(n, places), np.zeros(n, bool)
        ranked = key[order]
        new[1:] = ranked[1:] != ranked[:-1]
        del ranked
        rank[order] = np.cumsum(new, dtype=places)
        del order
        step = min(known, length - known)
        key[:] = rank
        key *= n + 2
        if n > step:
            key[: n - step] += rank[step:]
            key[: n - step] += 1
        order = np.argsort(key).astype(places)
        known += step
    return order


def _minimizer_runs(text: bytes, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first window, minimizer) of the runs of all windows of a text; a run also begins at each of `breaks`.

    The text is read in slices that fit a processor's cache; only runs are kept.
    """
    data = np.frombuffer(text + bytes(8), np.uint8)
    eights = np.ndarray(len(data) - 7, np.uint64, data, strides=(1,))
    n, width = len(text) - LENGTH + 1, LENGTH - ANCHOR + 1
    forced = np.zeros(n, bool)
    forced[breaks] = True
    firsts, mus, before = [], [], None
    for at in range(0, n, SLICE):
        size = min(SLICE, n - at)
        many = size + width - 1  # strings of ANCHOR bytes in these windows
        h = tb.mix(eights[at : at + many])
        for k in range(8, ANCHOR, 8):
            h ^= eights[at + k : at + k + many]
            h = tb.mix(h)
        h >>= np.uint64(64 - MINIMIZER_BITS)
        step = 1
        while 2 * step <= width:
            h = np.minimum(h[:-step], h[step:])
            step *= 2
        if width > step:
            h = np.minimum(h[: step - width], h[width - step :])
        change = forced[at : at + size]
        change[1:] |= h[1:] != h[:-1]
        change[0] |= before is None or h[0] != before
        before = h[-1]
        own = np.flatnonzero(change)
        firsts.append(own + at)
        mus.append(tb.mix(h[own]) >> np.uint64(64 - MINIMIZER_BITS))  # least hashes are small numbers; hashed again they spread evenly
    return np.concatenate(firsts), np.concatenate(mus)


class Group:
    """The runs of a group of documents: text, and for each run its minimizer, first window, windows and document."""

    def __init__(self, texts: list[str | None], keys: np.ndarray):
        parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        self.at = np.cumsum(self.sizes) - self.sizes
        self.text, self.keys = b"".join(parts), keys
        n = len(self.text) - LENGTH + 1
        none = np.zeros(0, np.int64)
        self.mu, self.first, self.windows, self.doc = none.astype(np.uint64), none, none, none
        if n < 1:
            return
        last = np.maximum(self.sizes - LENGTH + 1, 0)  # windows of each document
        first, mu = _minimizer_runs(self.text, self.at[(self.at < n) & (self.sizes > 0)])
        windows = np.diff(first, append=n)
        doc = np.searchsorted(self.at + self.sizes, first, "right")
        windows = np.minimum(windows, self.at[doc] + last[doc] - first)  # windows that leave the document don't count
        keep = windows > 0
        self.first, self.windows, self.doc = first[keep], windows[keep], doc[keep]
        self.mu = mu[keep]

    def blocks(self, parts: int) -> Iterator[tuple[int, bytes, bytes]]:
        """(part, minimizers, documents that have each, two at most), by range of the minimizers."""
        order = np.lexsort((self.doc, self.mu))
        mu, doc = self.mu[order], self.doc[order]
        new = np.ones(len(mu), bool)
        new[1:] = (mu[1:] != mu[:-1]) | (doc[1:] != doc[:-1])
        unique, count = np.unique(mu[new], return_counts=True)
        for p, some in tb.part_slices(unique, MINIMIZER_BITS, parts):
            yield p, tb.pack_sorted(unique[some]), tb.pack_counts(np.minimum(count[some], 2))

    def shared_runs(self, flags: dict[int, bytes], parts: int) -> np.ndarray:
        """The runs whose minimizers are flagged; flags by part are in the order of `blocks`."""
        unique = np.unique(self.mu)
        own = ((flags[p], s.stop - s.start) for p, s in tb.part_slices(unique, MINIMIZER_BITS, parts))
        flagged = np.concatenate([np.zeros(0, bool), *(np.unpackbits(np.frombuffer(bits, np.uint8))[:n].astype(bool) for bits, n in own)])
        return np.flatnonzero(flagged[np.searchsorted(unique, self.mu)]) if len(unique) else np.zeros(0, np.int64)

    def distinct_runs(self, flags: dict[int, bytes], parts: int) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray, np.ndarray]:
        """(shared runs, minimizers and texts of the distinct runs by minimizer, number of each shared run, least key of each distinct run).

        Runs with one minimizer stand in the order in which they occur, so the same documents in the same order give the same numbers.
        """
        runs = self.shared_runs(flags, parts)
        text, found = self.text, {}
        spans = zip(self.first[runs].tolist(), (self.first[runs] + self.windows[runs] + LENGTH - 1).tolist(), strict=True)
        number = np.fromiter((found.setdefault(text[a:b], len(found)) for a, b in spans), np.int64, len(runs))
        mu = np.empty(len(found), np.uint64)
        mu[number] = self.mu[runs]  # a text has one minimizer
        order = np.argsort(mu, kind="stable")
        rank = np.empty(len(found), np.int64)
        rank[order] = np.arange(len(found))
        texts = list(found)
        least = np.full(len(found), NO_KEY)
        np.minimum.at(least, rank[number], self.keys[self.doc[runs]])
        return runs, mu[order], [texts[i] for i in order.tolist()], rank[number], least


def decide_runs(strings: list[bytes], mus: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[int, bytes]]:
    """For runs with their minimizers and keys: the number of each run's text, the least key of each text, and by number a byte
    for each window where a window also starts under a smaller key."""
    place: dict[bytes, int] = {}
    number = np.fromiter((place.setdefault(s, len(place)) for s in strings), np.int64, len(strings))
    texts = list(place)
    owner, mu = np.full(len(texts), NO_KEY), np.empty(len(texts), np.uint64)
    np.minimum.at(owner, number, keys)
    mu[number] = mus
    _, kind, kinds = np.unique(mu, return_inverse=True, return_counts=True)
    mixed = np.flatnonzero(kinds[kind] > 1)  # minimizers with different runs
    masks: dict[int, bytes] = {}
    if len(mixed):
        some = [texts[i] for i in mixed.tolist()]
        classes, start = equal_windows(some)
        size = np.fromiter(map(len, some), np.int64, len(some)) - LENGTH + 1
        of = np.repeat(np.arange(len(some)), size)
        at = start[of] + np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
        own = owner[mixed][of]
        smallest = np.full(int(classes.max()) + 1, NO_KEY)
        np.minimum.at(smallest, classes[at], own)
        gone = smallest[classes[at]] < own
        ends = np.cumsum(size)
        for i in np.unique(of[gone]).tolist():
            masks[int(mixed[i])] = gone[ends[i] - size[i] : ends[i]].astype(np.uint8).tobytes()
    return number, owner, masks


def _answers(kind: int, blocks: pa.Table, states: list[bytes], masks: list[bytes | None]) -> pa.Table:
    n = blocks.num_rows
    return pa.table({"kind": pa.array([kind] * n, pa.int32()), "part": blocks["part"], "grp": blocks["grp"], "state": pa.array(states, pa.binary()), "mask": pa.array(masks, pa.binary())})


def _ranges(mu: np.ndarray, weight: np.ndarray, most: int, some: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """The places of `mu` by ranges of its values, in order inside each: ranges of weight `most` at most, or of one value."""
    some = np.arange(len(mu)) if some is None else some
    own = mu[some]
    if weight[some].sum() <= most or own.min() == own.max():
        yield some
        return
    low = own <= own.min() + (own.max() - own.min()) // np.uint64(2)
    halves = [some[low], some[~low]]
    del some, own, low
    while halves:
        yield from _ranges(mu, weight, most, halves.pop())


def _buffers(column: pa.ChunkedArray) -> list[pa.Buffer]:
    """The binary values of a column, not copied."""
    return [x.as_buffer() for x in column]


def _flag_minimizers(blocks: pa.Table, most: int = SORTED) -> pa.Table:
    """For the blocks of a part: a bit for each minimizer that two documents have."""
    mu = np.concatenate([tb.unpack_sorted(x) for x in _buffers(blocks["mu"])])
    counts = [tb.unpack_counts(x).astype(np.uint8) for x in _buffers(blocks["n"])]  # two at most
    count, ends = np.concatenate(counts), np.cumsum([len(c) for c in counts]).tolist()
    two = np.zeros(len(mu), bool)
    for some in _ranges(mu, np.ones(len(mu), np.uint8), most):
        _, of = np.unique(mu[some], return_inverse=True)
        two[some] = (np.bincount(of, count[some]) >= 2)[of]
    return _answers(0, blocks, [np.packbits(two[a:b]).tobytes() for a, b in zip([0, *ends], ends, strict=False)], [None] * len(ends))


def _window_hashes(data: np.ndarray, at: int, many: int) -> np.ndarray:
    """64-bit hashes of the windows from `at` on; `data` has eight bytes more than the windows."""
    eights = np.ndarray(len(data) - 7, np.uint64, data, strides=(1,))
    h = tb.mix(eights[at : at + many])
    for k in (*range(8, LENGTH - 8, 8), LENGTH - 8):
        h ^= eights[at + k : at + k + many]
        h = tb.mix(h)
    return h


def _least_owners(text: bytes, at: np.ndarray, owner: np.ndarray, most: int) -> np.ndarray:
    """For the windows at `at` of the text: the least owner of an equal one. `most` windows are searched at once."""
    least, offset = [], 0
    of = np.empty(len(at), np.int64)
    for a in range(0, len(at), most):
        some = slice(a, a + most)
        classes, start = equal_windows([text[i : i + LENGTH] for i in at[some].tolist()])
        _, of[some] = np.unique(classes[start], return_inverse=True)
        n = int(of[some].max()) + 1
        order = np.lexsort((owner[some], of[some]))
        least.append(a + order[np.searchsorted(of[some][order], np.arange(n))])  # of each class the window of the least owner
        of[some] += offset
        offset += n
    chosen = np.concatenate(least)
    if len(least) == 1:
        return owner[chosen][of]
    wider = most if 2 * len(chosen) <= len(at) else 2 * most  # windows that are all different must be searched at once in the end
    return _least_owners(text, at[chosen], owner[chosen], wider)[of]


def decide_windows(text: bytes, size: np.ndarray, keys: np.ndarray, most: int = HASHED, searched: int = SEARCHED_BYTES) -> np.ndarray:
    """For runs of `size` bytes that follow each other in the text: True where a window starts that also starts under a smaller key.

    Equal windows meet by hashes, range by range; hashes that occur once are dropped, and the others' windows are searched.
    """
    data = np.frombuffer(text + bytes(8), np.uint8)
    start, n = np.cumsum(size) - size, len(text) - LENGTH + 1
    change = np.zeros(len(text) + 1, np.int8)
    change[start] += 1
    change[start + size - LENGTH + 1] -= 1
    whole = np.cumsum(change, dtype=np.int8).astype(bool)
    gone = np.zeros(len(text), bool)
    ranges = -(-int(whole.sum()) // most)
    for r in range(ranges):
        places, hashes = [], []
        for a in range(0, n, SLICE):
            many = min(SLICE, n - a)
            h = _window_hashes(data, a, many)
            own = np.flatnonzero(whole[a : a + many] & (((h >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32) == r))
            places.append(own + a)
            hashes.append(h[own])
        at, h = np.concatenate(places), np.concatenate(hashes)
        order = np.argsort(h)
        at, h = at[order], h[order]
        same = h[1:] == h[:-1]
        again = np.zeros(len(h), bool)
        again[1:] |= same
        again[:-1] |= same
        at, h = at[again], h[again]
        owner = keys[np.searchsorted(start, at, "right") - 1]
        borders = np.flatnonzero(np.concatenate((h[1:] != h[:-1], [True]))) + 1  # where the windows of a hash end
        a, windows = 0, max(1, searched // (LENGTH + 1))
        while a < len(at):
            within = borders[(borders > a) & (borders <= a + windows)]
            b = int(within[-1]) if len(within) else int(borders[np.searchsorted(borders, a, "right")])
            gone[at[a:b]] = _least_owners(text, at[a:b], owner[a:b], windows) < owner[a:b]
            a = b
    return gone


def _decide_blocks(blocks: pa.Table, searched: int = SEARCHED_BYTES, most: int = HASHED) -> pa.Table:
    """For the blocks of a part: a state for each run (1: under a smaller key elsewhere, 2: a mask follows) and the masks."""
    mus = [tb.unpack_sorted(x) for x in _buffers(blocks["mu"])]
    ends = np.cumsum([len(m) for m in mus])
    mu, block = np.concatenate(mus), np.repeat(np.arange(len(mus)), np.diff(ends, prepend=0))
    keys = np.concatenate([tb.unpack_counts(x) for x in _buffers(blocks["n"])])
    sizes = [tb.unpack_counts(x) for x in _buffers(blocks["size"])]
    start, size = np.concatenate([np.cumsum(x) - x for x in sizes]), np.concatenate(sizes)
    data = [memoryview(x) for x in _buffers(blocks["data"])]
    del mus, sizes
    state, mask = np.zeros(len(mu), np.uint8), {}
    for some in _ranges(mu, size, searched):
        places = zip(block[some].tolist(), start[some].tolist(), (start[some] + size[some]).tolist(), strict=True)
        strings = [data[i][a:b].tobytes() for i, a, b in places]
        if size[some].sum() > searched:  # of one minimizer
            text = b"".join(strings)
            del strings
            gone = decide_windows(text, size[some], keys[some], most, searched)
            windows_end = np.cumsum(size[some]) - LENGTH + 1
            for i, a, b in zip(some.tolist(), (np.cumsum(size[some]) - size[some]).tolist(), windows_end.tolist(), strict=True):
                if gone[a:b].any():
                    state[i], mask[i] = 2, gone[a:b].tobytes()
            continue
        number, owner, masks = decide_runs(strings, mu[some], keys[some])
        masked = np.zeros(len(owner), bool)
        masked[list(masks)] = True
        state[some] = np.where(owner[number] < keys[some], 1, np.where(masked[number], 2, 0))
        follows = state[some] == 2
        mask.update(zip(some[follows].tolist(), (masks[k] for k in number[follows].tolist()), strict=True))
    states, out = [], []
    for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False):
        states.append(state[a:b].tobytes())
        out.append(b"".join(mask[i] for i in (a + np.flatnonzero(state[a:b] == 2)).tolist()))
    return _answers(1, blocks, states, out)


def _removed(group: Group, flags: dict[int, bytes], answers: dict[int, tuple[bytes, bytes]], parts: int) -> np.ndarray:
    """True for each byte of the group's text that goes."""
    change = np.zeros(len(group.text) + 1, np.int32)
    runs, mu, texts, number, least = group.distinct_runs(flags, parts)
    if len(runs):
        own_parts = [p for p, _ in tb.part_slices(mu, MINIMIZER_BITS, parts)]
        state = np.concatenate([np.frombuffer(answers[p][0], np.uint8) for p in own_parts])
        whole = (state[number] == 1) | (group.keys[group.doc[runs]] > least[number])
        np.add.at(change, group.first[runs[whole]], 1)
        np.add.at(change, group.first[runs[whole]] + group.windows[runs[whole]] + LENGTH - 1, -1)
        masks, at = b"".join(answers[p][1] for p in own_parts), 0
        mask_at, some = {}, [np.zeros(0, np.int64)]
        for i in np.flatnonzero(state == 2).tolist():
            mask_at[i] = at
            at += len(texts[i]) - LENGTH + 1
        for r, i in zip(runs[~whole].tolist(), number[~whole].tolist(), strict=True):
            if i in mask_at:
                some.append(group.first[r] + np.flatnonzero(np.frombuffer(masks, np.uint8, int(group.windows[r]), mask_at[i])))
        gone = np.concatenate(some)
        np.add.at(change, gone, 1)
        np.add.at(change, gone + LENGTH, -1)
    return np.cumsum(change[:-1]) > 0


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", group_bytes: int = GROUP_BYTES, decoded: bool = False, most_buckets: int = MOST_BUCKETS) -> DataFrame:
    """`docs` with its text replaced by n_bytes, kept (the bytes that stay) and spans (removed byte ranges, start and end).

    With `decoded`, `kept` is a string without the pieces of characters that a range has cut.

    Keys are integers. Null texts count as empty; texts of fewer than 50 bytes stay whole, longer ones are read whole. Rows with
    one key don't remove from each other. Rows with a null key stay whole and remove nothing. Equal texts of different keys are
    ties that the smallest key wins. An empty table gives an empty one. Columns named like the results are replaced; any others
    are carried, whatever their names.
    """
    spark = docs.sparkSession
    ship(spark)
    rest = [c for c in docs.columns if c not in (key, text, "n_bytes", "kept", "spans")]
    body = F.coalesce(F.col(text), F.lit("")).alias("_text")
    # the members of _rest go by number, so that no name of the caller's can clash
    others = F.struct(F.lit(None).cast("int").alias("c"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)])
    own = docs.select(F.col(key).cast("long").alias("_key"), body, others.alias("_rest")).withColumn("_name", F.md5(F.col("_text").cast("binary")))
    size = own.agg(F.sum(F.octet_length("_text")).alias("b")).first()["b"] or 0
    groups = max(8, -(-size // group_bytes))
    parts = max(128, groups // 8)
    grp = F.pmod(F.xxhash64("_key", "_name"), F.lit(groups)).cast("int")  # rows with one key or none are not one group

    # equal texts: all but those of the smallest key go whole, if they hold a window at all
    long_ = own.where((F.octet_length("_text") >= LENGTH) & F.col("_key").isNotNull()).select("_key", "_name")
    named = long_.groupBy("_name").agg(F.min("_key").alias("_least"), F.max("_key").alias("_most")).where("_least < _most")
    copies = materialised(long_.join(named.select("_name", "_least"), "_name").where("_key > _least").select(F.col("_key"), "_name").withColumn("grp", grp), "copies")

    kept_types = own.schema["_rest"].dataType  # as it is, since Arrow tells columns without nulls apart
    inner = T.StructType([T.StructField("_key", T.LongType()), T.StructField("_text", T.StringType()), T.StructField("_rest", kept_types), T.StructField("copy", T.BooleanType()), T.StructField("grp", T.IntegerType())])

    def mark(rows: pa.Table, gone: pa.Table) -> pa.Table:
        names = set(zip(gone["_key"].to_pylist(), gone["_name"].to_pylist(), strict=True))
        copy = [x in names for x in zip(rows["_key"].to_pylist(), rows["_name"].to_pylist(), strict=True)]
        return rows.append_column("copy", pa.array(copy, pa.bool_())).select(["_key", "_text", "_rest", "copy", "grp"])

    # Some groups share a bucket, and both sides are dealt by bucket: one task writes one file, and the passes have as many tasks.
    # Each file costs processes where Hadoop sets permissions by commands, and the smaller the files the more requests elsewhere.
    buckets = min(most_buckets, max(min(groups, OWN_BUCKETS), -(-groups // BUCKET_GROUPS)))
    by_bucket = own.withColumn("grp", grp).repartition(buckets, "grp").groupBy("grp")
    dealt = by_bucket.cogroup(copies.repartition(buckets, "grp").groupBy("grp")).applyInArrow(of_groups(mark), inner)
    name = f"repeats_{uuid.uuid4().hex}"
    dealt.write.format("parquet").bucketBy(buckets, "grp").option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # from the catalog only: the files stay in the shared folder, and `table` knows them

    def group_of(rows: pa.Table) -> Group:
        """The group without copies and null keys; `rows` are `in_order`, so that every pass numbers its runs alike."""
        rows = rows.filter(pc.and_(pc.invert(rows["copy"]), pc.is_valid(rows["_key"])))
        return Group(rows["_text"].to_pylist(), rows["_key"].to_numpy().astype(np.int64))

    def in_order(rows: pa.Table) -> pa.Table:
        return rows.sort_by([("_key", "ascending"), ("_text", "ascending")])

    def rows_of(number: int, rows: list[tuple]) -> pa.Table:
        columns = list(zip(*rows, strict=True)) or [()] * 5
        kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        part, mu, n, size_, data = (pa.array(c, k) for c, k in zip(columns, kinds, strict=True))
        return pa.table({"part": part, "grp": pa.array([number] * len(rows), pa.int32()), "mu": mu, "n": n, "size": size_, "data": data})

    def count(rows: pa.Table) -> pa.Table:
        return rows_of(rows["grp"][0].as_py(), [(p, mu, n, None, None) for p, mu, n in group_of(rows).blocks(parts)])

    flags = materialised(table.select("_key", "_text", "copy", "grp").groupBy("grp").applyInArrow(of_group(count), _BLOCK).groupBy("part").applyInArrow(of_group(_flag_minimizers), _ANSWER), "flags")

    def flags_in(side: pa.Table, kind: int = 0) -> dict[int, tuple[bytes, bytes]]:
        side = side.filter(pc.equal(side["kind"], kind))
        return dict(zip(side["part"].to_pylist(), zip(side["state"].to_pylist(), side["mask"].to_pylist(), strict=True), strict=True))

    def gather(rows: pa.Table, side: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return rows_of(0, [])
        rows = in_order(rows)
        _, mu, texts, _, least = group_of(rows).distinct_runs({p: s for p, (s, _) in flags_in(side).items()}, parts)
        out = []
        for p, own in tb.part_slices(mu, MINIMIZER_BITS, parts):
            sizes = np.fromiter(map(len, texts[own]), np.int64, own.stop - own.start)
            out.append((p, tb.pack_sorted(mu[own]), tb.pack_counts(least[own]), tb.pack_counts(sizes), b"".join(texts[own])))
        return rows_of(rows["grp"][0].as_py(), out)

    gathered = table.select("_key", "_text", "copy", "grp").groupBy("grp").cogroup(flags.groupBy("grp")).applyInArrow(of_groups(gather), _BLOCK)
    answers = materialised(gathered.groupBy("part").applyInArrow(of_group(_decide_blocks), _ANSWER), "answers")
    result = T.StructType([T.StructField("_key", T.LongType()), T.StructField("_rest", table.schema["_rest"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("kept", T.StringType() if decoded else T.BinaryType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def apply(rows: pa.Table, side: pa.Table) -> pa.Table:
        rows = in_order(rows)
        group = group_of(rows)
        gone = _removed(group, {p: s for p, (s, _) in flags_in(side).items()}, flags_in(side, 1), parts)
        texts = rows["_text"].to_pylist()
        taken = np.flatnonzero(~np.array(rows["copy"].to_pylist(), bool) & rows["_key"].is_valid().to_numpy(zero_copy_only=False))
        place = dict(zip(taken.tolist(), range(len(taken)), strict=True))
        sizes, kept, spans = [], [], []
        for i, (t, copy) in enumerate(zip(texts, rows["copy"].to_pylist(), strict=True)):
            data = (t or "").encode("utf-8", "surrogatepass")
            sizes.append(len(data))
            if copy:
                kept.append(b"")
                spans.append([{"start": 0, "end": len(data)}])
                continue
            own_gone = gone[group.at[place[i]] : group.at[place[i]] + len(data)] if i in place else np.zeros(len(data), bool)
            edges = np.flatnonzero(np.diff(own_gone.astype(np.int8), prepend=0, append=0)).tolist()
            spans.append([{"start": a, "end": b} for a, b in zip(edges[::2], edges[1::2], strict=True)])
            kept.append(b"".join(data[a:b] for a, b in zip([0, *edges[1::2]], [*edges[::2], len(data)], strict=True)))
        return pa.table({"_key": rows["_key"], "_rest": rows["_rest"], "n_bytes": pa.array(sizes, pa.int64()), "kept": pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if decoded else pa.array(kept, pa.binary()), "spans": pa.array(spans, span_type)})

    side = flags.unionByName(answers)
    out = table.groupBy("grp").cogroup(side.groupBy("grp")).applyInArrow(of_groups(apply), result)
    return out.select(F.col("_key").cast(docs.schema[key].dataType).alias(key), *[F.col(f"_rest.c{i}").alias(c) for i, c in enumerate(rest)], "n_bytes", "kept", "spans")
