"""Similarity self-join on word shingles with rare-first prefix filtering.

Texts with the same words are one class. Shingles are ordered by a fixed-size sketch of their counts, rarest first; two sets
can only be similar if their prefixes in that order share a shingle. Prefix shingles are joined, with length, positional and
suffix filters, and each pair that passes is verified once, on whole sets of 64-bit hashes.

The suffix filter bounds how much two sets differ beyond what the matching place tells: every set has a bitmap of parities
(bit b is flipped by each shingle whose hash begins with b), and sets whose bitmaps differ in d bits differ in d shingles at
least. It is sharp for sets that are nearly similar, so what a bucket sends on are its links and few pairs more. Long sets fill
a bitmap; for those the counts of shingles in more ranges bound the difference of each pair once more, before any set is moved.

A shingle that many texts share doesn't make all their pairs. First every bucket compares its members with its most central
one, the one with the fewest rarer shingles, in one pass over the sorted bucket; texts that turn out similar become one
component. Then members of a bucket meet across components only. The filters look at all such pairs inside the join, which is
square in the members of a bucket, but only pairs that pass them leave it. No link between different components is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runledger import ship
from runledger.llm import textblocks as tb
from runledger.llm.common import in_python, materialised
from runledger.llm.components import components

SHINGLE, PERCENT = 3, 90
#: Counters of the sketch (a power of two), in chunks.
SKETCH_BITS, CHUNK = 18, 4096
#: Bits of the filter of texts to compare, and of a set's bitmap of parities (2 ** PARITY_BITS bits in longs).
FILTER_BITS, PARITY_BITS = 24, 9
#: Sets of more shingles than this are long; ranges that their shingles are counted in, up to 255 a range.
LONG, RANGE_BITS = 1000, 10
PARITIES = [f"p{i}" for i in range((1 << PARITY_BITS) // 64)]


def shingle_sets(texts: list[str | None], size: int = SHINGLE) -> tuple[list[np.ndarray], list[bytes]]:
    """For each text, its distinct shingles as sorted 64-bit hashes, and 16 bytes that name its sequence of words."""
    words = tb.Words(texts)
    h = words.hashes()
    at = np.searchsorted(words.doc, np.arange(len(texts) + 1))
    gram = h
    for k in range(1, size):
        gram = tb.mix(gram[: len(h) - k] * np.uint64(0x9E3779B97F4A7C15) + h[k:]) if len(h) > k else h[:0]
    sets, names = [], []
    for i in range(len(texts)):
        own = h[at[i] : at[i + 1]]
        names.append(hashlib.md5(own.tobytes()).digest() if len(own) else b"")
        if len(own) >= size:
            sets.append(np.unique(gram[at[i] : at[i + 1] - size + 1]))
        elif len(own):
            sets.append(np.frombuffer(hashlib.md5(b"short" + own.tobytes()).digest()[:8], np.uint64))
        else:
            sets.append(own)
    return sets, names


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """Shingles of a set of n of which a similar set must share one."""
    return n - -(-percent * n // 100) + 1


def similar(inter: int, a: int, b: int, percent: int = PERCENT) -> bool:
    return 100 * inter >= percent * (a + b - inter)


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """A row of longs for each set: bit b is set if an odd number of its 64-bit shingles begin with b."""
    width = 1 << PARITY_BITS
    of = np.repeat(np.arange(len(sets)), np.fromiter(map(len, sets), np.int64, len(sets)))
    first = np.concatenate([np.zeros(0, np.uint64), *sets]) >> np.uint64(64 - PARITY_BITS)
    counts = np.bincount(of * width + first.astype(np.int64), minlength=len(sets) * width).reshape(len(sets), width)
    return np.packbits(counts & 1, axis=1).view(np.int64)


def range_counts(shingles: np.ndarray) -> bytes | None:
    """How many of a long set's shingles lie in each of 2 ** RANGE_BITS equal ranges, a byte each; None for other sets."""
    if len(shingles) <= LONG:
        return None
    first = (shingles >> np.uint64(64 - RANGE_BITS)).astype(np.int64)
    return np.bincount(first, minlength=1 << RANGE_BITS).clip(max=255).astype(np.uint8).tobytes()


def may_be_similar(a: bytes | None, b: bytes | None, n_a: int, n_b: int, percent: int = PERCENT) -> bool:
    """False if the counts of two long sets show that they are not similar."""
    if a is None or b is None:
        return True
    apart = np.abs(np.frombuffer(a, np.uint8).astype(np.int16) - np.frombuffer(b, np.uint8)).sum()
    return apart <= n_a + n_b - 2 * -(-percent * (n_a + n_b) // (100 + percent))


def compare(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """True if two sorted sets are similar."""
    return similar(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b), percent)


def _describe(docs: DataFrame, size: int) -> DataFrame:
    """Rows of kind 0: key, class name, its first eight bytes, set size, parities; of kind 1: a chunk of a partition's sketch."""
    fields = [("kind", T.IntegerType()), ("_key", docs.schema["_key"].dataType), ("name", T.BinaryType()), ("class", T.LongType()), ("n", T.LongType()), *((p, T.LongType()) for p in PARITIES), ("ranges", T.BinaryType()), ("chunk", T.IntegerType()), ("counts", T.BinaryType())]
    schema = T.StructType([T.StructField(*f) for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, kind = np.zeros(1 << SKETCH_BITS, np.int64), None
        for batch in batches:
            kind = batch.schema.field(0).type
            for at, texts in tb.blocks(batch, 1):
                sets, names = shingle_sets(texts, size)
                sketch += np.bincount(np.concatenate([np.zeros(0, np.uint64), *sets]) >> np.uint64(64 - SKETCH_BITS), minlength=len(sketch))
                n = len(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([0] * n, pa.int32()), batch.column(0).slice(at, n), pa.array(names, pa.binary()), pa.array(map(_class, names), pa.int64()), pa.array(map(len, sets), pa.int64()),
                        *(pa.array(p) for p in np.ascontiguousarray(parities(sets).T)), pa.array(map(range_counts, sets), pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()),
                    ],
                    schema.fieldNames(),
                )
        if kind is not None:
            n = len(sketch) // CHUNK
            counts = [tb.pack_counts(c) for c in sketch.reshape(n, CHUNK)]
            none = pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([1] * n, pa.int32()), pa.nulls(n, kind), pa.nulls(n, pa.binary()), none, none, *[none] * len(PARITIES), pa.nulls(n, pa.binary()), pa.array(range(n), pa.int32()), pa.array(counts, pa.binary())],
                schema.fieldNames(),
            )

    return in_python(docs.select("_key", "_text"), run, schema)


def _class(name: bytes) -> int:
    return int.from_bytes(name[:8], "little", signed=True)


def _sum_chunks(chunks: pa.Table) -> pa.Table:
    total = np.sum([tb.unpack_counts(c) for c in chunks["counts"].to_pylist()], axis=0)
    return pa.table({"chunk": chunks["chunk"][:1], "counts": pa.array([tb.pack_counts(total)], pa.binary())})


def _postings(docs: DataFrame, sketch: np.ndarray, percent: int, size: int) -> DataFrame:
    """(token, class, n, place) for the prefix of every class, once for each partition that has the class."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, sketch = set(), shared.value
        for batch in batches:
            for _, texts in tb.blocks(batch, 0):
                token, of, n, place = [], [], [], []
                for own, name in zip(*shingle_sets(texts, size), strict=True):
                    if len(own) and name not in seen:
                        seen.add(name)
                        p = prefix_length(len(own), percent)
                        order = np.lexsort((own, sketch[own >> np.uint64(64 - SKETCH_BITS)]))[:p]
                        token.append(own[order])
                        of.append(np.full(p, _class(name)))
                        n.append(np.full(p, len(own)))
                        place.append(np.arange(p))
                if token:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(token).view(np.int64)), pa.array(np.concatenate(of), pa.int64()), pa.array(np.concatenate(n), pa.int32()), pa.array(np.concatenate(place), pa.int32())],
                        ["token", "class", "n", "place"],
                    )

    return in_python(docs.select("_text"), run, "token long, class long, n int, place int")


def _sets(docs: DataFrame, wanted: np.ndarray, size: int) -> DataFrame:
    """(key, set) of the texts whose hashed key is in the filter `wanted` (a bit for each hash value)."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)
    schema = T.StructType([T.StructField("_key", docs.schema["_key"].dataType), T.StructField("set", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((shared.value[slot >> 3] >> (slot & 7)) & 1 == 1))
            for at, texts in tb.blocks(batch, 1):
                sets = [tb.pack_sorted(s) for s in shingle_sets(texts, size)[0]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(sets, pa.binary())], schema.fieldNames())

    slot = F.pmod(F.xxhash64("_key"), F.lit(1 << FILTER_BITS)).cast("long").alias("slot")
    return in_python(docs.select("_key", "_text", slot), run, schema)


def _bits(keys: DataFrame) -> np.ndarray:
    """The fixed-size filter of `keys` (column _key), gathered as at most 2 ** FILTER_BITS / 8 bytes."""
    slot = F.pmod(F.xxhash64("_key"), F.lit(1 << FILTER_BITS))
    bytes_ = keys.select(slot.alias("s")).groupBy((F.col("s") / 8).cast("int").alias("at")).agg(F.expr("bit_or(shiftleft(1, CAST(s % 8 AS INT)))").alias("bits"))
    out = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    got = bytes_.toArrow()
    out[got["at"].to_numpy()] = got["bits"].to_numpy()
    return out


def _plausible(pairs: DataFrame, wide: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) without those whose range counts, where both have some in `wide`, show that they are not similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                keep = [may_be_similar(*x, percent) for x in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True)]
                yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    side = lambda s: wide.select(F.col("_key").alias(s), F.col("ranges").alias(f"ranges_{s}"), F.col("n").alias(f"n_{s}"))
    both = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return in_python(both.select("a", "b", "ranges_a", "ranges_b", "n_a", "n_b"), run, pairs.schema)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                x, y = (batch.column(i).to_pylist() for i in (2, 3))
                keep = [compare(tb.unpack_sorted(a), tb.unpack_sorted(b), percent) for a, b in zip(x, y, strict=True)]
                yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(sets.select(F.col("_key").alias("b"), F.col("set").alias("set_b")), "b").join(sets.select(F.col("_key").alias("a"), F.col("set").alias("set_a")), "a")
    kind = sets.schema["_key"].dataType
    return in_python(both.select("a", "b", "set_a", "set_b"), run, T.StructType([T.StructField("a", kind), T.StructField("b", kind)]))


def _may_link(x: str, y: str, percent: int) -> Column:
    """Length, positional and suffix filters of postings x and y of one token."""
    of = lambda side, c: F.col(f"{side}.{c}")
    both = of(x, "n") + of(y, "n")
    least = F.ceil(F.lit(percent) * both / (100 + percent))
    lengths = 100 * F.least(of(x, "n"), of(y, "n")) >= percent * F.greatest(of(x, "n"), of(y, "n"))
    positions = F.least(of(x, "n") - of(x, "place"), of(y, "n") - of(y, "place")) >= least
    apart = sum((F.bit_count(of(x, p).bitwiseXOR(of(y, p))) for p in PARITIES), F.lit(0))
    return lengths & positions & (apart <= both - 2 * least)


def similar_components(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, size: int = SHINGLE, leaders: bool = True) -> DataFrame:
    """(key, n_shingles, component_id) for every row; component_id is the smallest key reachable by links, itself included.

    Texts are linked if their sets of `size`-word shingles have a Jaccard similarity of `percent` percent at least. `leaders`
    may be false to leave out the first pass, which changes the cost only.

    Null and empty texts and texts without words have no shingles and no links. Rows with one key are one vertex. A row with a
    null key takes part with its words, but a component is named by a key that isn't null where there is one. Equal texts and
    ties take part as one class, whatever their order; texts of any length are taken whole, and an empty table gives an empty
    one. Other columns of `docs` are not read, whatever their names.
    """
    spark = docs.sparkSession
    ship(spark)
    own = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    described = materialised(_describe(own, size), "described")
    rows = described.where("kind = 0").select("_key", "name", "n")
    chunks = described.where("kind = 1").select("chunk", "counts").groupBy("chunk").applyInArrow(_sum_chunks, "chunk int, counts binary").collect()
    sketch = np.zeros((1 << SKETCH_BITS) // CHUNK * CHUNK, np.int64)
    for r in chunks:
        sketch[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = tb.unpack_counts(bytes(r["counts"]))
    firsts = [F.first(c).alias(c) for c in ("class", "n", *PARITIES, "ranges")]
    classes = materialised(described.where("kind = 0 AND n > 0").groupBy("name").agg(F.min("_key").alias("_key"), *firsts), "classes")

    # of a bucket, only members with a neighbour in the order of sizes that passes the length filter
    members = _postings(own, sketch, percent, size).repartition("token").dropDuplicates(["token", "class"])
    by_size = Window.partitionBy("token").orderBy("n", "class")
    near = F.coalesce(100 * F.lag("n").over(by_size) >= percent * F.col("n"), F.lit(False)) | F.coalesce(100 * F.col("n") >= percent * F.lead("n").over(by_size), F.lit(False))
    members = members.withColumn("_near", near).where("_near").drop("_near")
    # classes that agree in the first eight bytes of their names all get the posting
    by_class = classes.where("_key IS NOT NULL").select("_key", "class", *PARITIES)
    shared = materialised(members.join(by_class, "class").select("token", "_key", "n", "place", *PARITIES), "shared")

    wide = classes.where("ranges IS NOT NULL").select("_key", "ranges", "n")
    kind = docs.schema[key].dataType
    none = spark.createDataFrame([], T.StructType([T.StructField("a", kind), T.StructField("b", kind)]))
    tried, found = none, none.select(F.col("a").alias("v"), F.col("b").alias("root"))

    def linked(pairs: DataFrame, found: DataFrame) -> DataFrame:
        """(v, root) of the components of `found` and of the similar ones of `pairs`."""
        pairs = materialised(_plausible(pairs, wide, percent), "plausible")
        if pairs.isEmpty():
            return found
        sets = _sets(own, _bits(pairs.select(F.col("a").alias("_key")).union(pairs.select("b"))), size)
        return components(materialised(_verified(pairs, materialised(sets, "sets"), percent), "links").union(found.select("v", "root")))

    each = F.struct("_key", "n", "place", *PARITIES)
    if leaders:
        central = Window.partitionBy("token").orderBy("y.place", F.xxhash64("y._key"), "y._key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        led = shared.select("token", each.alias("y")).select("token", "y", F.first("y").over(central).alias("x"))
        tried = materialised(_pairs(led.where((F.col("x._key") != F.col("y._key")) & _may_link("x", "y", percent))), "pairs")
        found = linked(tried, found)
    open_ = shared.join(found.withColumnRenamed("v", "_key"), "_key", "left").withColumn("root", F.coalesce("root", "_key"))
    x, y = open_.alias("x"), open_.alias("y")
    across = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.root") < F.col("y.root")) & _may_link("x", "y", percent))
    pairs = materialised(_pairs(across).join(tried, ["a", "b"], "left_anti"), "pairs")
    found = linked(pairs, found)
    named = classes.select("name", "_key").join(found.withColumnRenamed("v", "_key"), "_key", "left").select("name", F.coalesce("root", "_key").alias("root"))
    out = rows.join(named, "name", "left")
    return out.select(F.col("_key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("root", "_key").alias("component_id"))


def _pairs(both: DataFrame) -> DataFrame:
    return both.select(F.least("x._key", "y._key").alias("a"), F.greatest("x._key", "y._key").alias("b")).distinct()
