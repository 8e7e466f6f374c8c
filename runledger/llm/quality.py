"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each text; the ledger keeps the measurements and one failure bit per rule. Policies are
versioned sets of rules that are applied to the stored bits, and ablations count the bits again without touching texts.
Native DataFrame code.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.llm.common import words_of

#: Window of words whose repetition counts, and its share of the words (percent) that fails.
WINDOW, MOST_REPEATED = 3, 50
LEAST_WORDS = 50

#: The rules in the order of their bits; append only.
RULES = ("few_words", "repeated_words", "symbols", "repeated_lines", "capitals", "exclamations", "word_length")


def _rules() -> dict[str, Column]:
    """By rule: true for a ledger row that fails it."""
    n = F.col("n_words")
    return {
        "few_words": n < LEAST_WORDS,
        "repeated_words": 100 * F.col("n_repeat_words") > MOST_REPEATED * n,
        "symbols": 10 * F.col("n_symbols") > n,
        "repeated_lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
        "capitals": 10 * F.col("n_upper") > 3 * F.col("word_chars"),
        "exclamations": 10 * F.col("n_exclaim") > 3 * n,
        "word_length": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n),
    }


#: Versioned policies: the rules that reject a text.
POLICIES: Mapping[str, tuple[str, ...]] = {
    "v1": ("few_words", "repeated_words"),
    "v2": ("few_words", "repeated_words", "symbols", "repeated_lines", "capitals", "exclamations", "word_length"),
}


def mask_of(rules: tuple[str, ...]) -> int:
    """The bits of these rules."""
    return sum(1 << RULES.index(r) for r in rules)


def repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window which occurs twice or more, the first included.

    Windows become 64-bit hashes, sorted with their places; equal neighbours give the repeated places, and the union of
    [place, place + 3) is counted: n log n for any text.
    """
    n = F.size(words)
    hashes = F.when(
        n >= WINDOW,
        F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))),
    )

    def covered(h: Column) -> Column:
        ranked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))

        def places(s: Column) -> Column:
            same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(s, lambda x, i: same(x, i + 1) | same(x, i - 1)), lambda x: x["p"]))

        def union(p: Column) -> Column:
            steps = F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW))))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

        # one-element arrays bind an intermediate result, so that it is computed once
        return F.get(F.transform(F.transform(F.array(ranked), places), union), F.lit(0))

    total = F.get(F.transform(F.array(hashes), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h))), F.lit(0))
    return F.coalesce(total, F.lit(0).cast("long"))


def ledger(df: DataFrame, text: str = "text") -> DataFrame:
    """`df` without its text, with the measurements and `failure_bits`; one row for each row.

    Null and empty texts have no words and fail `few_words`. Columns named like the measurements are replaced.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_exclaim", "failure_bits"]
    kept = [F.col(c) for c in df.columns if c not in names and c != text]
    split = df.select(*kept, t.alias("_text"), words_of(t).alias("_words"), F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"))
    count = lambda pattern: F.regexp_count("_text", F.lit(pattern)).cast("long")
    measured = split.select(
        *kept,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        count(r"[#*$%&|<>]").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_words")).alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        count(r"[A-Z]").alias("n_upper"),
        count("!").alias("n_exclaim"),
    )
    bits = [F.when(failed, F.lit(1 << i)).otherwise(F.lit(0)) for i, failed in enumerate(_rules()[r] for r in RULES)]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask.bitwiseOR(b)
    return measured.withColumn("failure_bits", mask.cast("long"))


def verdict(policy: str) -> Column:
    """True for ledger rows that the policy keeps."""
    return F.col("failure_bits").bitwiseAND(F.lit(mask_of(POLICIES[policy]))) == 0


def ablations(rows: DataFrame) -> DataFrame:
    """For every policy and rule of it: rows, rows kept, rows kept without the rule, rows that only the rule rejects.

    The ledger is first counted by failure bits: a group for each pattern of the rules, 128 at most.
    """
    patterns = rows.groupBy("failure_bits").agg(F.count("*").alias("n"))
    cases = [
        F.struct(F.lit(v).alias("policy"), F.lit(r).alias("rule"), F.lit(mask_of(rules)).cast("long").alias("policy_bits"), F.lit(mask_of((r,))).cast("long").alias("rule_bit"))
        for v, rules in POLICIES.items()
        for r in rules
    ]
    hit = F.col("failure_bits").bitwiseAND(F.col("case.policy_bits"))
    total = lambda kept: F.coalesce(F.sum(F.when(kept, F.col("n"))), F.lit(0))
    return (
        patterns.withColumn("case", F.explode(F.array(*cases)))
        .groupBy("case.policy", "case.rule")
        .agg(
            F.sum("n").alias("n_rows"),
            total(hit == 0).alias("n_kept"),
            total(hit.bitwiseAND(F.bitwise_not("case.rule_bit")) == 0).alias("n_kept_without"),
            total(hit == F.col("case.rule_bit")).alias("n_only_this"),
        )
    )
