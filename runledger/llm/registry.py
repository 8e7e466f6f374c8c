"""The queries of this subpackage and their DuckDB counterparts, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.llm import chat, decontam, langid, lm, ngram_join, packing, quality, sharding, suffix_dedup, toxicity
from runledger.llm.common import crc32_of, fold_of, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers the decorated function as a query, with its SQL if SQL can express it."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


LEDGER_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT rid, doc_id, t,
        list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, i AS p, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c
        FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM s)),
r AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM g) WHERE n > 1),
u AS (SELECT rid, CAST(sum(least(3, coalesce(nxt - p, 3))) AS BIGINT) AS n_repeat_words
        FROM (SELECT rid, p, lead(p) OVER (PARTITION BY rid ORDER BY p) AS nxt FROM r) GROUP BY rid),
m AS (SELECT s.rid, doc_id, CAST(len(ws) AS BIGINT) AS n_words,
        CAST(coalesce(length(array_to_string(ws, '')), 0) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words, CAST(len(ls) AS BIGINT) AS n_lines,
        CAST(length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS BIGINT) AS n_upper,
        CAST(length(t) - length(replace(t, '!', '')) AS BIGINT) AS n_exclaim
      FROM s LEFT JOIN u ON s.rid = u.rid),
f AS (SELECT *, CAST((CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
        + (CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END) + (CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END)
        + (CASE WHEN 10 * n_upper > 3 * word_chars THEN 16 ELSE 0 END) + (CASE WHEN 10 * n_exclaim > 3 * n_words THEN 32 ELSE 0 END)
        + (CASE WHEN word_chars < 2 * n_words OR word_chars > 15 * n_words THEN 64 ELSE 0 END) AS BIGINT) AS failure_bits FROM m)
"""


@query(
    "op2_quality_rules",
    LEDGER_SQL
    + """SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failure_bits & 3) <> 0 AS base_failed,
         failure_bits = 0 AS kept, n_lines, n_upper, n_exclaim, failure_bits, 'v2' AS policy FROM f""",
)
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of all documents and the verdict of policy v2."""
    base_failed = F.col("failure_bits").bitwiseAND(F.lit(quality.mask_of(quality.POLICIES["v1"]))) != 0
    return quality.ledger(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"),
        (~base_failed & quality.verdict("v2")).alias("kept"), "n_lines", "n_upper", "n_exclaim", "failure_bits", F.lit("v2").alias("policy"),
    )


_POLICIES_SQL = ", ".join(f"('{v}', '{r}', {quality.mask_of(rules)}, {1 << quality.RULES.index(r)})" for v, rules in quality.POLICIES.items() for r in rules)


@query(
    "quality_ablations",
    LEDGER_SQL
    + f"""SELECT policy, rule, CAST(count(*) AS BIGINT) AS n_rows, CAST(count_if(failure_bits & pb = 0) AS BIGINT) AS n_kept,
          CAST(count_if(failure_bits & pb & ~rb = 0) AS BIGINT) AS n_kept_without, CAST(count_if(failure_bits & pb = rb) AS BIGINT) AS n_only_this
          FROM f CROSS JOIN (VALUES {_POLICIES_SQL}) v(policy, rule, pb, rb) GROUP BY policy, rule""",
)
def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy costs."""
    return quality.ablations(quality.ledger(table(spark, sf_dir, "documents").select("doc_id", "text")))


_SCORE = "-ln((CAST(('0x' || substr(md5(k || ':' || s), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0)"


def _key_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), crc32_of(text).alias("text_crc32"), F.lit("key").alias("law"))
    return sharding.shard_records(docs, "doc_id", dict.fromkeys(range(16), 1.0), dict.fromkeys(range(17), 1.0), ["size", "text_crc32"])


@query("op6_sharding")
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 15 by doc_id."""
    return _key_shards(spark, sf_dir).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


@query(
    "sharding_layout",
    f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS k, octet_length(encode(coalesce(text, ''))) + 1 AS size, coalesce(text, '') AS t FROM documents),
x AS (SELECT rid, s, {_SCORE} AS score FROM d, range(17) r(s)),
a AS (SELECT rid, CAST(min_by(s, score) FILTER (WHERE s < 16) AS INTEGER) AS shard, CAST(min_by(s, score) AS INTEGER) AS grown_shard FROM x GROUP BY rid),
b AS (SELECT d.rid, doc_id, CAST(size AS BIGINT) AS size, 'key' AS law, shard, grown_shard,
        CAST(('0x' || substr(md5(k || ':slot'), 1, 13)) AS BIGINT) % {sharding.BUCKETS} AS bucket FROM d JOIN a ON d.rid = a.rid)
SELECT doc_id, size, law, shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id, size) - 1 AS BIGINT) AS slot, grown_shard FROM b""",
)
def sharding_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op6_sharding that DuckDB can compute (it has no CRC-32)."""
    return _key_shards(spark, sf_dir).select("doc_id", "size", "law", "shard", "slot", "grown_shard")


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    """The path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_packing")
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 ids."""
    return packing.packed_digests(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_file())


#: Documents whose label counts as toxic from this score on.
TOXIC_FROM = 0.3


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    """Learned from the labelled documents outside fold 2 of 4."""
    labels = table(spark, sf_dir, "labels").where(fold_of(F.col("doc_id"), 4) != 2).select("doc_id", "toxic")
    return toxicity.fit(table(spark, sf_dir, "documents").select("doc_id", "text"), labels)


@query("op8_toxicity")
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", (fold_of(F.col("doc_id"), 4) == 2).alias("held_out"), "text")
    out = toxicity.scored(docs, toxicity_model(spark, sf_dir))
    return out.withColumn("predicted", (F.col("score") >= TOXIC_FROM).cast("int"))


@query("op9_language_id")
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents."""
    docs = table(spark, sf_dir, "documents")
    held_out = fold_of(F.col("doc_id"), 3) == 1
    model = langid.fit(docs, ~held_out)
    return langid.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model)


@query("op4_chat")
def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted and read back."""
    said = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.digests(chat.format_messages(rows.withColumn("parts", chat.text_part(F.col("text"))).drop("text")))


_UNITS = ", ".join(f"'{u}'" for u in decontam.UNITS)
_PUNCTUATION = decontam.PUNCTUATION.replace("'", "''")
_SLOTS = "('<num>', '<unit>', '<name>')"


def _template_sql(table_name: str, key: str) -> str:
    number = lambda x: f"regexp_matches(trim({x}, '{_PUNCTUATION}'), '{decontam.NUMBER}')"
    name = decontam.NAME.replace("'", "''")
    return rf"""SELECT {key}, i, n, trim(lower(w), '{_PUNCTUATION}') AS v,
        CASE WHEN {number("lower(w)")} THEN '<num>'
             WHEN regexp_matches(w, '{name}') THEN '<name>'
             WHEN trim(lower(w), '{_PUNCTUATION}') IN ({_UNITS}) AND coalesce({number("lower(p)")}, false) THEN '<unit>'
             ELSE trim(lower(w), '{_PUNCTUATION}') END AS t
      FROM (SELECT {key}, CAST(i AS BIGINT) AS i, len(ws) AS n, ws[i + 1] AS w, CASE WHEN i > 0 THEN ws[i] END AS p
        FROM (SELECT {key}, ws, unnest(range(len(ws))) AS i
          FROM (SELECT {key}, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM {table_name})))"""


def _windows_sql(name: str, key: str, size: str) -> str:
    """A row for each window: place, template, bare words, number of words, and number of placeholders."""
    return f"""SELECT a.{key}, a.i, {size} AS size, string_agg(b.t, ' ' ORDER BY b.i) AS tw, string_agg(b.v, ' ' ORDER BY b.i) AS vw,
        count_if(b.t IN {_SLOTS}) AS slots
      FROM {name} a JOIN {name} b ON a.{key} = b.{key} AND b.i >= a.i AND b.i < a.i + {size}
      WHERE a.i + {size} <= a.n GROUP BY ALL"""


@query(
    "op10_decontamination",
    f"""
WITH dt AS MATERIALIZED ({_template_sql("documents", "doc_id")}), bt AS MATERIALIZED ({_template_sql("benchmark", "item_id")}),
bw AS MATERIALIZED ({_windows_sql("bt", "item_id", "least(a.n, 8)")}),
sizes AS (SELECT DISTINCT size FROM bw),
ds AS (SELECT * FROM dt CROSS JOIN sizes),
dw AS MATERIALIZED ({_windows_sql("dt", "doc_id", "8")}
  UNION ALL SELECT a.doc_id, a.i, a.size, string_agg(b.t, ' ' ORDER BY b.i), string_agg(b.v, ' ' ORDER BY b.i), count_if(b.t IN {_SLOTS})
      FROM ds a JOIN dt b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.i < a.i + a.size WHERE a.size < 8 AND a.i + a.size <= a.n GROUP BY a.doc_id, a.i, a.size),
h AS MATERIALIZED (SELECT doc_id, item_id, dw.i - bw.i AS shift, bw.i AS item_at, bw.size, bool_or(dw.vw = bw.vw) AS literal
   FROM dw JOIN bw ON dw.size = bw.size AND dw.vw = bw.vw GROUP BY ALL
   UNION ALL SELECT doc_id, item_id, dw.i - bw.i, bw.i, bw.size, false
   FROM dw JOIN bw ON dw.size = bw.size AND dw.tw = bw.tw WHERE dw.vw <> bw.vw AND bw.size - bw.slots >= least(5, bw.size)),
s AS MATERIALIZED (SELECT h.doc_id, h.item_id, shift, item_at, bt.i AS place, bt.v AS bv, dt.v AS dv
   FROM h JOIN bt ON bt.item_id = h.item_id AND bt.i >= item_at AND bt.i < item_at + size AND bt.t IN {_SLOTS}
   JOIN dt ON dt.doc_id = h.doc_id AND dt.i = bt.i + shift WHERE NOT literal),
p AS (SELECT doc_id, item_id, shift, bv, dv, count(DISTINCT place) AS n FROM s GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id, shift, bv ORDER BY n DESC, dv) AS rb,
   row_number() OVER (PARTITION BY doc_id, item_id, shift, dv ORDER BY n DESC, bv) AS rd FROM p),
x AS (SELECT DISTINCT s.doc_id, s.item_id, s.shift, s.item_at FROM s JOIN r USING (doc_id, item_id, shift, bv, dv) WHERE rb > 1 OR rd > 1),
f AS (SELECT doc_id, item_id, item_at, bool_or(literal) AS literal FROM h
   WHERE literal OR NOT EXISTS (SELECT 1 FROM x WHERE x.doc_id = h.doc_id AND x.item_id = h.item_id AND x.shift = h.shift AND x.item_at = h.item_at) GROUP BY ALL),
g AS (SELECT doc_id, item_id, count(*) AS n_windows, CAST(count_if(literal) AS BIGINT) AS n_literal_windows FROM f GROUP BY ALL),
k AS (SELECT item_id, count(*) AS n_item_windows, count(CASE WHEN size - slots >= least(5, size) THEN 1 END) AS n_able FROM bw GROUP BY item_id)
SELECT doc_id, item_id, n_windows, n_literal_windows, n_item_windows, n_windows = n_literal_windows AS same_values FROM g JOIN k USING (item_id)
WHERE n_windows >= least(6, n_item_windows, CASE WHEN n_able > 0 THEN n_able ELSE 6 END)""",
)
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain benchmark items, with the items."""
    return decontam.matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


@query("op5_lm_scoring")
def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents, learned from those outside fold 2 of 7."""
    return lm.score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), fold_of(F.col("doc_id"), 7) != 2)


@query(
    "op3_ngram_jaccard_join",
    r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, ws[i:i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d WHERE len(ws) > 2)
    UNION ALL SELECT doc_id, ws FROM d WHERE len(ws) BETWEEN 1 AND 2)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * inter >= 90 * (x.n + y.n - inter)),
r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT b, c FROM r JOIN l ON a = r.doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, min(c) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id, n"""
)
def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 3-word shingles have a Jaccard similarity of 0.9 at least."""
    return ngram_join.similar_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op7_suffix_dedup")
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of all documents without 50-byte strings that a document with a smaller doc_id holds."""
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
