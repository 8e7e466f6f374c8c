"""Benchmark decontamination by template canonicalisation.

Words become templates: numbers, names and units are replaced by typed placeholders, the rest is lower-cased and stripped of
punctuation. Windows of template words of documents and of benchmark items meet in a hash join. Along each alignment (the
distance between the places in document and item) slot values must map one to one between item and document: of values in
conflict the pair at most places stays, and windows that hold another pair don't count. So a re-parameterised question counts
and a chance mixture does not. Windows of the bare words meet too, so a copy word for word counts whatever its case and type.
Native DataFrame code.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.llm.common import materialised, words_of

#: Words of a window, words in it that must not be placeholders, and windows of an item that must be found (13 words in a row).
WINDOW, LEAST_LITERALS, LEAST_WINDOWS = 8, 5, 6
#: Benchmark windows, and documents with a window in common with an item, up to this count are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 200_000
#: Units that follow a number.
UNITS = (
    "kg", "g", "mg", "lb", "lbs", "km", "m", "cm", "mm", "mi", "ft", "in", "l", "ml", "s", "ms", "h", "hr", "hrs", "min", "mins",
    "seconds", "minutes", "hours", "days", "weeks", "months", "years", "miles", "meters", "metres", "feet", "inches", "grams",
    "kilograms", "liters", "litres", "dollars", "euros", "cents", "percent", "degrees", "mph", "km/h", "gb", "mb", "kb", "%",
)
PUNCTUATION = ".,;:!?()[]{}\"'"
NUMBER = r"^[+-]?[$€£]?[0-9][0-9.,]*%?$"
NAME = r"^[(\[{\"']?\p{Lu}\p{Ll}"
NUM_SLOT, UNIT_SLOT, NAME_SLOT = "<num>", "<unit>", "<name>"
SLOTS = (NUM_SLOT, UNIT_SLOT, NAME_SLOT)


def bare(words: Column) -> Column:
    """The words in lower case without punctuation at their ends."""
    return F.transform(words, lambda w: F.btrim(F.lower(w), F.lit(PUNCTUATION)))


def template(words: str, bare: str) -> Column:
    """The template of the column `words`, of the same length; `bare` has its bare words.

    A number is a number without its punctuation, a name a word with a capital and a small letter at its start, a unit one of
    UNITS after a number. The first comparisons decide most words without a pattern.
    """

    def slot(w: Column, i: Column) -> Column:
        own, prior = F.get(bare, i), F.get(bare, i - 1)
        number = lambda x: ((x < ":") | (x >= "£")) & x.rlike(NUMBER)
        unit = F.when(F.coalesce(number(prior), F.lit(False)) & own.isin(*UNITS), F.lit(UNIT_SLOT)).otherwise(own)
        small = (w >= "a") & (w < "{")
        return F.when(small, unit).when(number(own), F.lit(NUM_SLOT)).when((w != own) & w.rlike(NAME), F.lit(NAME_SLOT)).otherwise(unit)

    return F.transform(words, slot)


def _templates(df: DataFrame, *keys: str) -> DataFrame:
    """The keys, and the bare words and the template of the column _text."""
    own = df.select(*keys, words_of(F.col("_text")).alias("words"))
    own = own.withColumn("bare", bare(F.col("words")))
    return own.select(*keys, "bare", template("words", "bare").alias("template"))


def _windows(own: DataFrame, size: int, *keys: str) -> DataFrame:
    """A row (keys, at, typed, hash) for each window of `size` words: of the template, and of the bare words where they differ."""
    # no filter on the arrays: Spark would move it below and work them out a second time, inside its lambda functions
    each = lambda a: F.transform(a, lambda w: F.xxhash64(w))
    hashed = own.select(*keys, each("template").alias("t"), each("bare").alias("b"))
    of = lambda a: F.transform(F.sequence(F.lit(0), F.size(a) - size), lambda i: F.xxhash64(*[F.get(a, i + k) for k in range(size)]))
    hashed = hashed.select(*keys, F.when(F.size("t") >= size, of("t")).alias("t"), F.when((F.size("t") >= size) & (F.col("t") != F.col("b")), of("b")).alias("b"))
    other = F.coalesce(F.zip_with("b", "t", lambda b, t: F.when(b != t, b)), F.slice("t", 1, 0))
    rows = hashed.select(*keys, F.size("t").alias("_n"), F.posexplode(F.concat("t", other)).alias("_at", "hash")).where("hash IS NOT NULL")
    typed = F.col("_at") < F.col("_n")
    return rows.select(*keys, F.when(typed, F.col("_at")).otherwise(F.col("_at") - F.col("_n")).alias("at"), typed.alias("typed"), "hash")


def _slots(own: DataFrame, *keys: str) -> DataFrame:
    """A row (keys, place, value) for each placeholder."""
    rows = own.select(*keys, F.posexplode(F.arrays_zip("template", "bare")).alias("place", "_w"))
    return rows.where(F.col("_w.template").isin(*SLOTS)).select(*keys, "place", F.col("_w.bare").alias("value"))


def _small(df: DataFrame) -> DataFrame:
    """`df`, marked for broadcast if it has BROADCAST_ROWS rows at most."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def matches(docs: DataFrame, items: DataFrame, key: str = "doc_id", item: str = "item_id", text: str = "text", item_text: str = "text") -> DataFrame:
    """(key, item, n_windows, n_literal_windows, n_item_windows, same_values) for each document that contains an item.

    The windows of an item are its runs of WINDOW words, or its whole text where it has fewer. One is found literally if its bare
    words stand in the document, or by its template if it has LEAST_LITERALS literal words (or as many as it has words) and its
    slots are consistent. An item is contained if LEAST_WINDOWS of its windows are found, or all where it has fewer, or as many of
    those that can be found by template. `same_values` is true if all were found literally.

    Null and empty texts match nothing and items without words are in no document; texts of any length are taken whole; repeated
    rows with one key count as one document, as do rows with a null key. Other columns are not read, whatever their names.
    """
    of_items = _templates(items.where(F.col(item_text).isNotNull()).select(F.col(item).alias("_item"), F.col(item_text).alias("_text")), "_item")
    of_items = of_items.withColumn("size", F.least(F.size("template"), F.lit(WINDOW))).where("size > 0")
    doc_rows = docs.select(F.col(key).alias("_key"), F.xxhash64(F.col(text)).alias("_row"), F.col(text).alias("_text")).where("_text IS NOT NULL")
    of_docs = _templates(doc_rows, "_key", "_row")
    sizes = sorted(r[0] for r in of_items.select("size").distinct().collect()) or [WINDOW]  # 1..WINDOW
    hits, able = [], []
    for size in sizes:
        own = of_items.where(F.col("size") == size)
        windows = _windows(own, size, "_item").join(own.select("_item", "template"), "_item")
        slots = F.size(F.filter(F.slice("template", F.col("at") + 1, size), lambda w: w.isin(*SLOTS)))
        windows = windows.select("_item", F.col("at").alias("item_at"), F.col("typed").alias("item_typed"), "hash", (~F.col("typed") | (slots == 0)).alias("literal"), slots.alias("slots"))
        windows = windows.where(F.col("literal") | (size - F.col("slots") >= min(LEAST_LITERALS, size))).drop("slots").distinct()
        able.append(windows.where("item_typed"))
        both = _windows(of_docs, size, "_key", "_row").join(_small(windows), "hash")
        hits.append(both.select("_key", "_row", "_item", (F.col("at") - F.col("item_at")).alias("shift"), "item_at", "literal", F.lit(size).alias("size")))
    hits = materialised(reduce(DataFrame.unionByName, hits).groupBy("_key", "_row", "_item", "shift", "item_at", "size").agg(F.max("literal").alias("literal")), "hits")

    # values of the slots of windows that were found by template only
    alignment = ["_key", "_row", "_item", "shift"]
    item_slots = _slots(of_items, "_item").withColumnRenamed("value", "item_value")
    held = hits.where("NOT literal").join(_small(item_slots), "_item").where("place >= item_at AND place < item_at + size")
    held = held.select(*alignment, "item_at", "place", "item_value")
    wanted = _small(held.select(F.col("_key").alias("_k"), F.col("_row").alias("_r")).distinct())
    there = _templates(doc_rows.join(wanted, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_row") == F.col("_r")), "left_semi").dropDuplicates(["_key", "_row"]), "_key", "_row")
    doc_slots = _slots(there, "_key", "_row").select(F.col("_key").alias("_k"), F.col("_row").alias("_r"), F.col("place").alias("doc_place"), F.col("value").alias("doc_value"))
    here = F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_row") == F.col("_r")) & (F.col("place") + F.col("shift") == F.col("doc_place"))
    held = materialised(held.join(doc_slots, here).select(*alignment, "item_at", "place", "item_value", "doc_value"), "slots")
    pairs = held.select(*alignment, "place", "item_value", "doc_value").distinct().groupBy(*alignment, "item_value", "doc_value").agg(F.count("*").alias("n"))
    first = lambda one, other: F.row_number().over(Window.partitionBy(*alignment, one).orderBy(F.desc("n"), other)) == 1
    pairs = pairs.withColumn("kept", first("item_value", "doc_value")).withColumn("kept", F.col("kept") & first("doc_value", "item_value"))
    same = reduce(Column.__and__, [F.col(f"h.{c}").eqNullSafe(F.col(f"p.{c}")) for c in [*alignment, "item_value", "doc_value"]])
    wrong = held.alias("h").join(pairs.where("NOT kept").alias("p"), same, "left_semi").select(*alignment, "item_at").distinct()
    same = reduce(Column.__and__, [F.col(f"h.{c}").eqNullSafe(F.col(f"w.{c}")) for c in [*alignment, "item_at"]]) & ~F.col("h.literal")
    good = hits.alias("h").join(wrong.alias("w"), same, "left_anti")

    found = good.groupBy("_key", "_item", "item_at").agg(F.max("literal").alias("literal"))
    found = found.groupBy("_key", "_item").agg(F.count("*").alias("n"), F.count(F.when(F.col("literal"), 1)).alias("n_literal"))
    counts = of_items.groupBy("_item").agg(F.max(F.size("template") - F.col("size") + 1).cast("long").alias("n_item"))
    can = reduce(DataFrame.unionByName, able).groupBy("_item").agg(F.count_distinct("item_at").alias("n_able"))
    least = F.least(F.lit(LEAST_WINDOWS), F.col("n_item"), F.col("n_able"))  # n_able is null where no window can be found by template
    return (
        found.join(_small(counts.join(can, "_item", "left")), "_item")
        .where(F.col("n") >= least)
        .select(F.col("_key").alias(key), F.col("_item").alias(item), F.col("n").alias("n_windows"), F.col("n_literal").alias("n_literal_windows"), F.col("n_item").alias("n_item_windows"), (F.col("n") == F.col("n_literal")).alias("same_values"))
    )
