"""The queries over the driver's tables and their DuckDB counterparts, by name.

Conversations stand for sessions, their turns for records and items, documents for text blobs, events for timed records.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runledger.functions import classify, text, times
from runledger.operators import aggregates, links, search, spine
from runledger.tables import table

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


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def _item_id() -> Column:
    return (F.col("conv_id") * 1000 + F.col("turn")).alias("item_id")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select(_item_id(), F.col("conv_id").alias("session_id"), "turn", "role", "text")


def _loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spine.partition_loops(_turns(spark, sf_dir), "conv_id", "turn", F.col("role") == "user")


_LOOPS = "loops AS (SELECT *, nullif(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn), 0) AS loop_no FROM conversations)"


# --- roles, loops and positions ---


@query(
    "role_counts",
    """SELECT CASE role WHEN 'user' THEN 'human.request' WHEN 'assistant' THEN 'agent.commentary'
              WHEN 'system' THEN 'runtime.instructions' ELSE 'runtime.unknown' END AS semantic_role,
              CAST(count(*) AS BIGINT) AS items FROM conversations GROUP BY 1""",
)
def role_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items for each semantic role."""
    role = (
        F.when(F.col("role") == "user", "human.request")
        .when(F.col("role") == "assistant", "agent.commentary")
        .when(F.col("role") == "system", "runtime.instructions")
        .otherwise("runtime.unknown")
    )
    return _turns(spark, sf_dir).groupBy(role.alias("semantic_role")).agg(F.count("*").alias("items"))


@query(
    "loop_partition",
    f"""WITH {_LOOPS} SELECT conv_id, turn, CAST(loop_no AS BIGINT) AS loop_no,
        CASE WHEN loop_no IS NOT NULL THEN row_number() OVER (PARTITION BY conv_id, loop_no ORDER BY turn) - 1 END AS loop_position FROM loops""",
)
def loop_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loops and the place of each turn in its loop."""
    return _loops(spark, sf_dir).select("conv_id", "turn", "loop_no", "loop_position")


@query(
    "request_steering",
    f"""WITH {_LOOPS} SELECT conv_id, turn, CASE WHEN row_number() OVER (PARTITION BY conv_id, loop_no ORDER BY turn) = 1
        THEN 'human.request' ELSE 'human.steering' END AS semantic_role FROM loops WHERE role = 'user'""",
)
def request_steering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests open a loop, further human turns steer it."""
    human, agent = F.col("role") == "user", F.col("role") == "assistant"
    return spine.request_or_steering(_loops(spark, sf_dir), "conv_id", "turn", human, agent).where("semantic_role IS NOT NULL").select("conv_id", "turn", "semantic_role")


@query(
    "final_answers",
    f"""WITH {_LOOPS}, n AS (SELECT *, lead(1) OVER (PARTITION BY conv_id, loop_no ORDER BY turn) AS nxt FROM loops)
        SELECT conv_id, turn, CASE WHEN nxt IS NULL AND loop_no IS NOT NULL THEN 'agent.final_answer' ELSE 'agent.commentary' END AS semantic_role
        FROM n WHERE role = 'assistant'""",
)
def final_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last turn of a loop answers, earlier agent turns comment."""
    rows = _loops(spark, sf_dir)
    final = spine.final_answers(rows, "conv_id", "turn", F.col("role") == "assistant")
    rows = rows.withColumn("semantic_role", F.when(final & F.col("loop_no").isNotNull(), "agent.final_answer").otherwise("agent.commentary"))
    return rows.where("role = 'assistant'").select("conv_id", "turn", "semantic_role")


@query(
    "session_spine",
    """SELECT user_id, event_id, CAST((epoch_us(ts) // 1000) AS BIGINT) AS at_ms, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS session_position FROM events""",
)
def session_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of a session's parts."""
    rows = table(spark, sf_dir, "events").withColumn("at_ms", times.epoch_ms(F.col("ts")))
    return spine.session_spine(rows, "user_id", [F.col("at_ms").asc_nulls_last(), F.col("event_id")]).select("user_id", "event_id", "at_ms", "session_position")


@query(
    "record_ranges",
    """SELECT conv_id, turn, CAST(coalesce(sum(strlen(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
        CAST(coalesce(sum(strlen(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + strlen(text) AS BIGINT) AS "end" FROM conversations""",
)
def record_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-open byte ranges of records."""
    return spine.record_ranges(_turns(spark, sf_dir), "conv_id", "turn", "text").select("conv_id", "turn", "start", "end")


@query(
    "neighbourhood",
    """SELECT a.conv_id, a.turn AS anchor_position, b.turn, b.role FROM conversations a JOIN conversations b
        ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 2 AND a.turn + 1 WHERE a.role = 'assistant'""",
)
def neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two turns before and one after every agent turn."""
    rows = _turns(spark, sf_dir).select("conv_id", "turn", "role")
    anchors = rows.where("role = 'assistant'")
    return spine.neighbourhood(rows, anchors, ["conv_id"], "turn", 2, 1).select("conv_id", "anchor_position", "turn", "role")


@query(
    "duration_over",
    """SELECT event_id, user_id, gap_ms FROM (SELECT *, (epoch_us(ts) // 1000) - lag((epoch_us(ts) // 1000)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap_ms FROM events) WHERE gap_ms > 60000""",
)
def duration_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps of more than a minute; unknown gaps aren't zero."""
    rows = table(spark, sf_dir, "events").withColumn("at_ms", times.epoch_ms(F.col("ts")))
    return spine.previous_gap(rows, "user_id", ["at_ms", "event_id"], "at_ms").where("gap_ms > 60000").select("event_id", "user_id", "gap_ms")


# --- texts ---


@query(
    "bounded_text",
    """SELECT doc_id, substr(text, 1, list_max(list_filter(range(65), lambda k: strlen(substr(text, 1, k)) <= 64))) AS prefix,
        CAST(strlen(text) AS BIGINT) AS full_bytes, strlen(text) <= 64 AS complete FROM documents""",
)
def bounded_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefixes of all documents of at most 64 bytes, cut between characters."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", text.bounded_prefix(t, 64).alias("prefix"), text.utf8_bytes(t).alias("full_bytes"), text.is_complete(t, 64).alias("complete"))


@query("bounded_bytes", "SELECT doc_id, substr(text, 1, list_max(list_filter(range(102), lambda k: strlen(substr(text, 1, k)) <= 101))) AS prefix FROM documents")
def bounded_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounded prefixes of all documents, cut at a character's start."""
    return table(spark, sf_dir, "documents").select("doc_id", text.bounded_prefix(F.col("text"), 101).alias("prefix"))


@query(
    "estimated_tokens",
    r"""SELECT doc_id, CAST(ceil((length(text) - length(regexp_replace(text, '[\x00-\x7F]', '', 'g'))) / 4.0) + length(regexp_replace(text, '[\x00-\x7F]', '', 'g')) AS BIGINT) AS tokens FROM documents""",
)
def estimated_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token estimates of texts."""
    return table(spark, sf_dir, "documents").select("doc_id", text.estimated_tokens(F.col("text")).alias("tokens"))


@query(
    "blob_dedup",
    """SELECT sha256(text) AS blob_id, CAST(count(*) AS BIGINT) AS uses, CAST(min(doc_id) AS BIGINT) AS first_doc, CAST(min(strlen(text)) AS BIGINT) AS full_bytes FROM documents GROUP BY 1""",
)
def blob_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One blob for each complete text. Texts become digests before the shuffle."""
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("blob_id"), text.utf8_bytes(F.col("text")).alias("n"))
    return rows.groupBy("blob_id").agg(F.count("*").alias("uses"), F.min("doc_id").alias("first_doc"), F.min("n").alias("full_bytes"))


_LITERALS = ("the th", "queau", "heitlich")


@query(
    "trigram_search",
    "SELECT doc_id, instr(lower(text), 'heitlich') AS place FROM documents WHERE instr(lower(text), 'heitlich') > 0",
)
def trigram_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by trigram, then the exact check on the candidates' texts; documents have no postings, so both in one scan."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = docs.where(search.holds_grams(F.col("text"), "heitlich") & search.confirmed(F.col("text"), "heitlich", fold=True))
    return rows.select("doc_id", F.instr(F.lower("text"), "heitlich").cast("long").alias("place"))


def _grams_sql(x: str) -> str:
    return " AND ".join(f"contains(lower(text), '{g}')" for g in sorted(set(text.trigram_query(x))))


@query(
    "trigram_density",
    " UNION ALL ".join(
        f"SELECT '{x}' AS term, CAST(count(*) AS BIGINT) AS candidate_items, CAST(count(DISTINCT source) AS BIGINT) AS candidate_sessions FROM documents WHERE {_grams_sql(x)}" for x in _LITERALS
    ),
)
def trigram_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many items and sessions each anchor recalls."""
    return search.scanned_density(table(spark, sf_dir, "documents"), list(_LITERALS), "doc_id", "source")


_TERMS_SQL = """t AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda w: length(w) >= 2) AS ws FROM documents),
p AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS term, unnest(range(len(ws))) AS pos FROM t)"""


@query("term_tokens", f"WITH {_TERMS_SQL} SELECT term, CAST(count(*) AS BIGINT) AS uses, CAST(count(DISTINCT doc_id) AS BIGINT) AS docs FROM p GROUP BY term HAVING count(*) > 5")
def term_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that occur more than five times."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(text.words(F.col("text"))).alias("term"))
    return rows.groupBy("term").agg(F.count("*").alias("uses"), F.count_distinct("doc_id").alias("docs")).where("uses > 5")


def _term_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), text.words(F.col("text")).alias("terms"))
    return search.term_postings(docs, F.col("terms"))


@query(
    "term_search_bm25",
    f"""WITH {_TERMS_SQL}, s AS (SELECT count(*) AS total, avg(len(ws)) AS mean FROM t),
    f AS (SELECT doc_id, n, term, count(*) AS f FROM p WHERE term IN ('with', 'only') GROUP BY ALL),
    d AS (SELECT term, count(*) AS df FROM f GROUP BY term),
    w AS (SELECT doc_id, term, -greatest(ln((total - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / mean)) AS x FROM f JOIN d USING (term) CROSS JOIN s)
    SELECT doc_id AS item_id, round(sum(x), 6) AS score FROM w GROUP BY doc_id HAVING count(*) = 2""",
)
def term_search_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that hold two terms, ranked."""
    words = F.regexp_count(F.lower("text"), F.lit("[a-z0-9_]{2,}"))
    stats = table(spark, sf_dir, "documents").agg(F.count("*").alias("n"), F.avg(words).alias("mean")).first()
    return search.ranked(_term_index(spark, sf_dir), "with only", stats["n"], stats["mean"] or 1.0).select("item_id", F.round("score", 6).alias("score"))


@query(
    "phrase_adjacency",
    f"""WITH {_TERMS_SQL} SELECT a.doc_id AS item_id, CAST(count(*) AS BIGINT) AS hits FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1
        WHERE a.term = 'of' AND b.term = 'the' GROUP BY 1""",
)
def phrase_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items in which two terms follow each other."""
    return search.phrase_hits(_term_index(spark, sf_dir), [["of", "the"]]).select("item_id", "hits")


def _tags_sql() -> str:
    cases = [f"WHEN starts_with(b, '{h}') THEN '{r}'" for h, r in classify.HEADERS.items()]
    cases += [f"WHEN tag = '{t}' THEN '{r}'" for t, r in classify.TAGS.items()] + ["WHEN tag <> '' THEN 'runtime.unknown'"]
    cases += [f"WHEN starts_with(b, '{p}') THEN '{r}'" for p, r in classify.PREFIXES.items()]
    return "CASE " + " ".join(cases) + " ELSE 'runtime.unknown' END"


@query(
    "injection_classify",
    rf"""WITH x AS (SELECT doc_id, ltrim(CASE doc_id % 5 WHEN 0 THEN '<' || lang || '>' || text WHEN 1 THEN '<system-reminder>' || text || '</system-reminder>'
            WHEN 2 THEN '## Memory' || text WHEN 3 THEN 'Network rule saved: ' || text ELSE '<image name=[1]>' || text END) AS b FROM documents),
        y AS (SELECT doc_id, b, regexp_extract(b, '^<([A-Za-z0-9_:/-]+)(?:>|\s[^>]*>)', 1) AS tag FROM x) SELECT doc_id, {_tags_sql()} AS semantic_role FROM y""",
)
def injection_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of injected texts."""
    kind, t = F.col("doc_id") % 5, F.col("text")
    body = (
        F.when(kind == 0, F.concat(F.lit("<"), F.col("lang"), F.lit(">"), t))
        .when(kind == 1, F.concat(F.lit("<system-reminder>"), t, F.lit("</system-reminder>")))
        .when(kind == 2, F.concat(F.lit("## Memory"), t))
        .when(kind == 3, F.concat(F.lit("Network rule saved: "), t))
        .otherwise(F.concat(F.lit("<image name=[1]>"), t))
    )
    return table(spark, sf_dir, "documents").select("doc_id", classify.injection_column(body).alias("semantic_role"))


@query(
    "tagged_value",
    "SELECT doc_id, trim(split_part(text, '</task-id>', 1)) AS value FROM documents",
)
def tagged_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value of a tag that holds a whole text."""
    wrapped = F.concat(F.lit("x<task-id>"), F.col("text"), F.lit("</task-id>y<task-id>z</task-id>"))
    return table(spark, sf_dir, "documents").select("doc_id", text.tagged_value(wrapped, "task-id").alias("value"))


@query("file_paths", "SELECT doc_id, CASE WHEN doc_id % 4 <> 3 THEN '/' || source || ' é+' || doc_id END AS path FROM documents")
def file_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of local file URIs; other schemes have none."""
    scheme = F.element_at(F.array(*map(F.lit, ("file:///", "file:/", "file://localhost/", "https://h/"))), (F.col("doc_id") % 4 + 1).cast("int"))
    uri = F.concat(scheme, F.col("source"), F.lit("%20%C3%A9+"), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", text.path_of_uri(uri).alias("path"))


@query("complete_arguments", "SELECT event_id, CASE WHEN strlen(props) <= 9 AND event_id % 2 = 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events")
def complete_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arguments are whole or absent: too long or broken JSON gives null."""
    given = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.expr("left(props, 6)"))
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(text.complete_or_null(given, 9), "$.k", "bigint").alias("k"))


# --- links, snapshots, coverage ---


@query(
    "call_output_link",
    """WITH n AS (SELECT conv_id, conv_id * 1000 + turn AS item, role, lead(role) OVER w AS r, lead(conv_id * 1000 + turn) OVER w AS nxt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
        SELECT conv_id, CAST(count(item) AS BIGINT) AS calls, CAST(count(CASE WHEN r = 'assistant' THEN nxt END) AS BIGINT) AS outputs FROM n WHERE role = 'user' GROUP BY conv_id""",
)
def call_output_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and the outputs that point back at them."""
    rows = _items(spark, sf_dir)
    pairs = links.next_of_kind(rows, "session_id", "turn", "role", "user", "assistant", "item_id")
    return pairs.groupBy(F.col("session_id").alias("conv_id")).agg(F.count_distinct("call_item").alias("calls"), F.count("output_item").alias("outputs"))


@query(
    "output_resolution",
    """WITH c AS (SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, max(event_id) AS call_item_id FROM events WHERE event_type = 'click' GROUP BY ALL)
        SELECT event_id, call_item_id FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type <> 'click') e LEFT JOIN c USING (user_id, k)""",
)
def output_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs resolved to the last call with the same native id in their source."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    calls = rows.where("event_type = 'click'")
    return links.link_outputs(rows.where("event_type <> 'click'"), calls, "user_id", "k", "event_id").select("event_id", "call_item_id")


@query(
    "coverage_triple",
    "SELECT lang, CAST(count(*) AS BIGINT) AS population, CAST(count(quality) AS BIGINT) AS contributors, CAST(count(*) - count(quality) AS BIGINT) AS missing FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang",
)
def coverage_triple(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Population, contributors and missing values of an optional fact."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return aggregates.coverage(rows, ["lang"], "quality")


@query(
    "usage_last_snapshot",
    """WITH k AS (SELECT user_id, event_type, max_by(event_id % 97, event_id) AS v, min_by(event_id % 7, event_id) AS loop_id FROM events GROUP BY ALL)
        SELECT CAST(loop_id AS BIGINT) AS loop_id, CAST(sum(v) AS BIGINT) AS total FROM k GROUP BY loop_id""",
)
def usage_last_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last snapshot of each response counts, for the loop that saw it first."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", (F.col("event_id") % 97).alias("v"), (F.col("event_id") % 7).alias("loop_id"))
    return aggregates.last_snapshot_sums(rows, ["user_id", "event_type"], "loop_id", "event_id", "v")


@query(
    "null_poison_sum",
    "SELECT source, lang, CASE WHEN count(quality) = count(*) THEN CAST(sum(quality) AS BIGINT) END AS total, count(quality) AS known FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source, lang",
)
def null_poison_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One unknown part makes a sum unknown."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.groupBy("source", "lang").agg(aggregates.null_poisoned_sum(F.col("quality")).cast("long").alias("total"), F.count("quality").alias("known"))


@query(
    "seen_total_dedup",
    """SELECT user_id, CAST(count(*) AS BIGINT) AS kept, CAST(sum(event_id) AS BIGINT) AS first_events FROM
        (SELECT *, row_number() OVER (PARTITION BY user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) ORDER BY event_id) AS n FROM events) WHERE n = 1 GROUP BY user_id""",
)
def seen_total_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative totals that were seen before are dropped."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return aggregates.first_seen(rows, ["user_id", "k"], ["event_id"]).groupBy("user_id").agg(F.count("*").alias("kept"), F.sum("event_id").alias("first_events"))


@query(
    "source_ids_array",
    "SELECT lang, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, min_by(source, doc_id) AS first_source FROM documents GROUP BY lang",
)
def source_ids_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered distinct sources of a session, and the first known by order."""
    rows = table(spark, sf_dir, "documents")
    return rows.groupBy("lang").agg(F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"), F.min_by("source", "doc_id").alias("first_source"))


@query("explode_witnesses", "SELECT conv_id, turn, unnest([turn, turn + 1, turn * 2]) AS record_id FROM conversations")
def explode_witnesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each witness of an item."""
    return _turns(spark, sf_dir).select("conv_id", "turn", F.explode(F.array(F.col("turn"), F.col("turn") + 1, F.col("turn") * 2)).alias("record_id"))


@query(
    "explode_outer_witnesses",
    "SELECT conv_id, turn, w AS record_id FROM conversations LEFT JOIN LATERAL (SELECT unnest(CASE WHEN turn % 2 = 0 THEN [turn, -turn] ELSE [] END) AS w) ON true",
)
def explode_outer_witnesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items without a witness stay, with a null."""
    listed = F.when(F.col("turn") % 2 == 0, F.array(F.col("turn"), -F.col("turn"))).otherwise(F.array().cast("array<bigint>"))
    return _turns(spark, sf_dir).select("conv_id", "turn", F.explode_outer(listed).alias("record_id"))


@query(
    "json_props_extract",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
)
def json_props_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A typed member of open JSON, by VARIANT."""
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query(
    "time_bounds",
    """WITH b AS (SELECT epoch_ms(min(date_trunc('day', ts))) + 86400000 AS lo FROM events)
        SELECT event_type, CAST(count(*) AS BIGINT) AS events, CAST(min((epoch_us(ts) // 1000)) AS BIGINT) AS first_ms FROM events, b WHERE (epoch_us(ts) // 1000) >= lo AND (epoch_us(ts) // 1000) < lo + 86400000 GROUP BY event_type""",
)
def time_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-open bounds of a day, from a one-row parameter relation."""
    rows = table(spark, sf_dir, "events").withColumn("at_ms", times.epoch_ms(F.col("ts")))
    day = F.lit(86_400_000)
    bounds = rows.agg((F.min(F.col("at_ms") - F.pmod(F.col("at_ms"), day)) + day).alias("lo"))
    inside = rows.crossJoin(F.broadcast(bounds)).where((F.col("at_ms") >= F.col("lo")) & (F.col("at_ms") < F.col("lo") + day))
    return inside.groupBy("event_type").agg(F.count("*").alias("events"), F.min("at_ms").alias("first_ms"))


@query(
    "instant_parse",
    "SELECT event_id, CAST((epoch_us(ts) // 1000) AS BIGINT) AS at_ms, CAST((epoch_us(ts) // 1000) - 19800000 AS BIGINT) AS shifted_ms FROM events",
)
def instant_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RFC 3339 texts as epoch milliseconds."""
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS")
    ms = times.instant_ms_column(F.concat(stamp, F.lit("Z")))
    return table(spark, sf_dir, "events").select("event_id", ms.alias("at_ms"), times.instant_ms_column(F.concat(stamp, F.lit("+05:30"))).alias("shifted_ms"))


@query(
    "status_roles",
    "SELECT event_type AS role, CAST(count(*) AS BIGINT) AS items, string_agg(DISTINCT CAST(user_id % 4 AS VARCHAR), ',' ORDER BY CAST(user_id % 4 AS VARCHAR)) AS runtimes FROM events GROUP BY 1",
)
def status_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed roles and the runtimes that have them."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("role"), (F.col("user_id") % 4).cast("string").alias("runtime"))
    return aggregates.observed_roles(rows, "role", "runtime")


@query(
    "fork_lineage",
    """WITH RECURSIVE e AS (SELECT DISTINCT conv_id AS id, conv_id // 2 AS parent FROM conversations WHERE conv_id > 0),
        line(root, id, depth) AS (SELECT id, id, 0 FROM e WHERE id <= 3 UNION ALL SELECT line.root, e.id, line.depth + 1 FROM line JOIN e ON e.parent = line.id)
        SELECT root, id, depth FROM line""",
)
def fork_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that descend from some sessions, by a recursive query."""
    edges = _turns(spark, sf_dir).where("conv_id > 0").select(F.col("conv_id").alias("id"), F.floor(F.col("conv_id") / 2).cast("long").alias("parent")).distinct()
    edges.createOrReplaceTempView("_lineage_edges")
    edges.where("id <= 3").createOrReplaceTempView("_lineage_roots")
    return links.lineage(spark, "_lineage_edges", "_lineage_roots")


@query(
    "parent_resolution",
    """WITH s AS (SELECT DISTINCT conv_id FROM conversations), c AS (SELECT conv_id, conv_id // 3 AS parent FROM s)
        SELECT c.conv_id AS session_id, s.conv_id AS parent_session_id FROM c JOIN s ON s.conv_id = c.parent WHERE c.conv_id <> s.conv_id""",
)
def parent_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents looked up by native id when they are read."""
    sessions = _turns(spark, sf_dir).select(F.col("conv_id").alias("session_id")).distinct()
    sessions = sessions.withColumn("runtime", F.lit("r")).withColumn("native_id", F.col("session_id").cast("string"))
    sources = sessions.select(F.concat(F.lit("/"), "native_id").alias("locator"), "session_id")
    wanted = sessions.select(
        "session_id", "runtime", F.lit("forked").alias("kind"), F.floor(F.col("session_id") / 3).cast("string").alias("parent_native_id"),
        F.lit(None).cast("string").alias("parent_locator"), F.col("session_id").alias("source_id"), F.lit(0).alias("record_id"),
    )
    return links.resolve_parents(wanted, sessions, sources).select("session_id", "parent_session_id")


@query(
    "metadata_by_identity",
    """WITH s AS (SELECT DISTINCT conv_id FROM conversations) SELECT m.doc_id AS native_id, s.conv_id AS session_id, m.quality AS metadata FROM labels m LEFT JOIN s ON s.conv_id = m.doc_id""",
)
def metadata_by_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata finds its session by runtime and native id, and stays without one."""
    sessions = _turns(spark, sf_dir).select(F.col("conv_id").alias("session_id"), F.lit("r").alias("runtime"), F.col("conv_id").alias("native_id")).distinct()
    given = table(spark, sf_dir, "labels").select(F.lit("r").alias("runtime"), F.col("doc_id").alias("native_id"), F.col("quality").alias("metadata"))
    return links.with_metadata(sessions, given).select("native_id", "session_id", "metadata")


# --- generic relational operators ---


@query(
    "select_filter_case",
    """SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'large' ELSE 'small' END AS size FROM orders
        WHERE o_orderstatus IN ('F', 'P') AND o_totalprice BETWEEN 1000 AND 200000 AND o_orderpriority ILIKE '1-%' AND o_custkey IS NOT NULL""",
)
def select_filter_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projection, predicates and CASE."""
    rows = table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("F", "P") & F.col("o_totalprice").between(1000, 200000) & F.col("o_orderpriority").ilike("1-%") & F.col("o_custkey").isNotNull())
    return rows.select("o_orderkey", F.when(F.col("o_totalprice") > 100000, "large").otherwise("small").alias("size"))


@query(
    "boolean_sums",
    "SELECT o_orderpriority, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS finished, CAST(count(o_custkey) AS BIGINT) AS known, round(avg(o_custkey), 1) AS mean_customer FROM orders GROUP BY 1",
)
def boolean_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of conditions, counts of known values, rounded means."""
    rows = table(spark, sf_dir, "orders")
    return rows.groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "F").alias("finished"), F.count("o_custkey").alias("known"), F.round(F.avg("o_custkey"), 1).alias("mean_customer"))


@query(
    "joins_using",
    "SELECT r_name, CAST(count(*) AS BIGINT) AS customers, CAST(count(DISTINCT n_nationkey) AS BIGINT) AS nations FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
)
def joins_using(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inner joins along a star."""
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_name").agg(F.count("*").alias("customers"), F.count_distinct("n_nationkey").alias("nations"))


@query(
    "semi_anti",
    """SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'has' ELSE 'none' END AS orders FROM customer""",
)
def semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with and without orders."""
    customers, orders = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    has = customers.join(orders, "c_custkey", "left_semi").withColumn("orders", F.lit("has"))
    return has.union(customers.join(orders, "c_custkey", "left_anti").withColumn("orders", F.lit("none")))


@query("union_all_hits", "SELECT 'customer' AS term, c_nationkey AS nation FROM customer UNION ALL SELECT 'supplier', s_nationkey FROM supplier")
def union_all_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All hits of several searches."""
    own = table(spark, sf_dir, "customer").select(F.lit("customer").alias("term"), F.col("c_nationkey").alias("nation"))
    return own.unionByName(table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("term"), F.col("s_nationkey").alias("nation")))


@query(
    "set_ops",
    """(SELECT 'union' AS op, * FROM (SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier))
        UNION ALL (SELECT 'intersect', * FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier))
        UNION ALL (SELECT 'except', * FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier))""",
)
def set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union, intersection and difference of sets."""
    a, b = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"))
    named = lambda op, df: df.select(F.lit(op).alias("op"), "nation")
    return named("union", a.union(b).distinct()).union(named("intersect", a.intersect(b))).union(named("except", a.subtract(b)))


@query("topk", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem ORDER BY l_quantity DESC, l_orderkey, l_linenumber LIMIT 25")
def topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of an order, without a full sort."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity").orderBy(F.desc("l_quantity"), "l_orderkey", "l_linenumber").limit(25)


@query("having", "SELECT l_suppkey, CAST(count(*) AS BIGINT) AS lines, CAST(max(l_quantity) AS DOUBLE) AS most FROM lineitem GROUP BY l_suppkey HAVING count(*) > 500")
def having(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups by a condition on their aggregate."""
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("lines"), F.max("l_quantity").alias("most")).where("lines > 500")


@query(
    "materialized_cte",
    "WITH scoped AS MATERIALIZED (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') SELECT o_orderkey, o_custkey FROM scoped JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'O'",
)
def materialized_cte(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A selective set first, in SQL as the query runner takes it."""
    from runledger.plans import runner

    for name in ("customer", "orders"):
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    return runner.prepare(spark, "WITH scoped AS MATERIALIZED (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') SELECT o_orderkey, o_custkey FROM scoped JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'O'")


@query(
    "scalar_subquery",
    "SELECT n_name, (SELECT CAST(count(*) AS BIGINT) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers FROM nation",
)
def scalar_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A correlated scalar subquery, as the join that Catalyst makes of it."""
    counts = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("suppliers"))
    return table(spark, sf_dir, "nation").join(counts, "n_nationkey", "left").select("n_name", F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


@query(
    "scalar_functions",
    "SELECT doc_id, instr(text, 'the') AS place, substr(text, 2, 5) AS part, length(text) AS chars, greatest(doc_id, 50) AS most, abs(doc_id - 100) AS distance, doc_id // 7 AS seventh FROM documents",
)
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar functions over texts and numbers."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.instr("text", "the").cast("long").alias("place"), F.substring("text", 2, 5).alias("part"), F.length("text").cast("long").alias("chars"),
        F.greatest("doc_id", F.lit(50)).alias("most"), F.abs(F.col("doc_id") - 100).alias("distance"), F.expr("doc_id div 7").alias("seventh"),
    )


@query(
    "calendar_format",
    "SELECT event_id, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M') AS local FROM events",
)
def calendar_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An instant in a reader's fixed offset."""
    return table(spark, sf_dir, "events").select("event_id", F.date_format(F.from_utc_timestamp(F.col("ts").cast("timestamp"), "+08:00"), "yyyy-MM-dd HH:mm").alias("local"))


@query(
    "loop_totals",
    f"""WITH {_LOOPS} SELECT CAST(loop_no AS BIGINT) AS loop_no, CAST(count(*) AS BIGINT) AS turns, CAST(sum(strlen(text)) AS BIGINT) AS bytes, CAST(count(DISTINCT conv_id) AS BIGINT) AS sessions FROM loops GROUP BY loop_no""",
)
def loop_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by number of loop; turns outside loops under null."""
    rows = _loops(spark, sf_dir)
    return rows.groupBy("loop_no").agg(F.count("*").alias("turns"), F.sum(F.octet_length("text")).alias("bytes"), F.count_distinct("conv_id").alias("sessions"))


@query(
    "events_per_session_window",
    """WITH g AS (SELECT *, CASE WHEN (epoch_us(ts) // 1000) - lag((epoch_us(ts) // 1000)) OVER w > 1800000 OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        n AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM g)
        SELECT user_id, CAST(no AS BIGINT) AS visit, CAST(count(*) AS BIGINT) AS events FROM n GROUP BY ALL""",
)
def events_per_session_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits: a pause of half an hour opens a new one."""
    rows = table(spark, sf_dir, "events").withColumn("at_ms", times.epoch_ms(F.col("ts")))
    rows = spine.previous_gap(rows, "user_id", ["at_ms", "event_id"], "at_ms")
    opens = F.coalesce(F.col("gap_ms") > 1_800_000, F.lit(True)).cast("int")
    ordered = Window.partitionBy("user_id").orderBy("at_ms", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("visit", F.sum(opens).over(ordered)).groupBy("user_id", "visit").agg(F.count("*").alias("events"))
