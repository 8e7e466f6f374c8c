"""Functions and spellings that queries over the public relations may use besides Spark's own."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

from runledger.functions.terms import folded, search_query
from runledger.functions.text import trigram_query

#: SQL functions by signature. `json_extract` gives JSON booleans as 1 and 0; `strftime` takes seconds and a fixed offset.
FUNCTIONS = (
    """json_extract(j STRING, p STRING) RETURNS STRING RETURN
       CASE WHEN schema_of_variant(try_variant_get(try_parse_json(j), p, 'variant')) = 'BOOLEAN'
            THEN CAST(CAST(try_variant_get(try_parse_json(j), p, 'boolean') AS INT) AS STRING) ELSE get_json_object(j, p) END""",
    "json_valid(j STRING) RETURNS INT RETURN CAST(try_parse_json(j) IS NOT NULL AS INT)",
    "blob_text(t STRING) RETURNS STRING RETURN t",
    "unixepoch(t STRING) RETURNS BIGINT RETURN unix_seconds(to_timestamp(t))",
    """strftime(f STRING, t BIGINT, kind STRING DEFAULT 'unixepoch', zone STRING DEFAULT '+00:00') RETURNS STRING RETURN
       date_format(from_utc_timestamp(timestamp_seconds(t), zone), replace(replace(replace(replace(replace(replace(replace(regexp_replace(f, '(?<!%)[A-Za-z]+', "'$0'"),
         '%Y', 'yyyy'), '%m', 'MM'), '%d', 'dd'), '%H', 'HH'), '%M', 'mm'), '%S', 'ss'), '%j', 'DDD'))""",
    "json_each(j STRING) RETURNS TABLE (value STRING) RETURN SELECT explode(from_json(j, 'array<string>'))",
    """item_search(q ARRAY<STRING>) RETURNS TABLE (rowid BIGINT) RETURN
       SELECT item_id FROM item_search WHERE array_contains(q, gram) GROUP BY item_id HAVING count(DISTINCT gram) = max(size(array_distinct(q)))""",
    "item_search_totals() RETURNS TABLE (total BIGINT, mean DOUBLE) RETURN SELECT count(*), avg(item_terms) FROM item_term_counts",
    """item_search_terms(q ARRAY<ARRAY<STRING>>) RETURNS TABLE (rowid BIGINT, score DOUBLE) RETURN
       WITH t AS (SELECT phrase_no, size(phrase) AS n, off, term FROM (SELECT posexplode(q) AS (phrase_no, phrase)) LATERAL VIEW posexplode(phrase) AS off, term),
       h AS (SELECT item_id, item_terms, phrase_no, n, off, explode(positions) AS at FROM item_search_terms JOIN t USING (term)),
       s AS (SELECT item_id, item_terms, phrase_no, at - off AS start FROM h GROUP BY item_id, item_terms, phrase_no, at - off, n HAVING count(DISTINCT off) = n),
       f AS (SELECT item_id, item_terms, phrase_no, count(*) AS f FROM s GROUP BY item_id, item_terms, phrase_no),
       d AS (SELECT phrase_no, count(*) AS df FROM f GROUP BY phrase_no),
       a AS (SELECT count(*) AS total, avg(item_terms) AS mean FROM item_term_counts)
       SELECT item_id, sum(-greatest(ln((total - df + 0.5D) / (df + 0.5D)), 1e-6D) * f * 2.2D / (f + 1.2D * (0.25D + 0.75D * item_terms / mean)))
       FROM f JOIN d USING (phrase_no) CROSS JOIN a GROUP BY item_id HAVING count(*) = max(size(q))""",
)

#: The two searches with literal grams and terms, which reach the scan of the postings as filters; the functions above take any array.
_CANDIDATES = "(SELECT item_id AS rowid FROM item_search WHERE gram IN ({grams}) GROUP BY item_id HAVING count(DISTINCT gram) = {n})"
_RANKED = """(WITH h AS (SELECT item_id, item_terms, p.phrase_no, p.n, explode(transform(positions, x -> x - p.off)) AS start FROM
         (SELECT item_id, item_terms, positions, explode(filter({places}, q -> q.term = term)) AS p FROM item_search_terms WHERE term IN ({terms}))),
       f AS (SELECT item_id, item_terms, phrase_no, count(*) AS f FROM (SELECT item_id, item_terms, phrase_no FROM h GROUP BY item_id, item_terms, phrase_no, n, start HAVING count(*) = n) GROUP BY item_id, item_terms, phrase_no),
       d AS (SELECT phrase_no, count(*) AS df FROM f GROUP BY phrase_no)
       SELECT item_id AS rowid, sum(-greatest(ln((total - df + 0.5D) / (df + 0.5D)), 1e-6D) * f * 2.2D / (f + 1.2D * (0.25D + 0.75D * item_terms / mean))) AS score
       FROM f JOIN d USING (phrase_no) CROSS JOIN item_search_totals() GROUP BY item_id HAVING count(*) = {n})"""


def register(spark: SparkSession) -> None:
    """Creates the functions for this session; the relations that they read must exist."""
    for f in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {f}")


def _literal(text: str) -> str:
    """A literal without a quote inside, so that `_QUOTED` finds its end."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\u0027") + "'"


def _array(values: list[str]) -> str:
    return f"array({', '.join(map(_literal, values))})"


def _candidates(text: str) -> str:
    grams = sorted(set(trigram_query(text)))
    return _CANDIDATES.format(grams=", ".join(map(_literal, grams)), n=len(grams))


def _ranked(text: str) -> str:
    phrases = [[folded(t) for t in p] for p in search_query(text)]
    places = [f"named_struct('term', {_literal(t)}, 'phrase_no', {no}, 'off', {off}, 'n', {len(p)})" for no, p in enumerate(phrases) for off, t in enumerate(p)]
    return _RANKED.format(places=f"array({', '.join(places)})", terms=", ".join(_literal(t) for t in sorted({t for p in phrases for t in p})), n=len(phrases))


_SEARCH = re.compile(r"\b(?:item_search\s*\(\s*trigram_query|(item_search_terms)\s*\(\s*search_query)\s*\(\s*'((?:[^']|'')*)'\s*\)\s*\)", re.I)
_CALL = re.compile(r"\b(trigram_query|search_query)\s*\(\s*'((?:[^']|'')*)'\s*\)", re.I)
_SPELLINGS = (
    (re.compile(r"\bAS\s+(?:NOT\s+)?MATERIALIZED\b", re.I), "AS"),
    (re.compile(r"\bbm25\s*\(\s*item_search_terms\s*\)", re.I), "score"),
    (re.compile(r"\b(JOIN)\s+(json_each)\s*\(", re.I), r"\1 LATERAL \2("),
    (re.compile(r",\s*(json_each)\s*\(", re.I), r", LATERAL \1("),
    (re.compile(r"\bAS\s+BLOB\s*\)", re.I), "AS BINARY)"),
    (re.compile(r"\bSUM\s*\(\s*([\w.]+\s+IS\s+(?:NOT\s+)?NULL|[\w.]+\s*=\s*\w+)\s*\)", re.I), r"sum(CAST((\1) AS INT))"),
)
_QUOTED = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", re.S)


def rewrite(sql: str) -> str:
    """SQL in Spark's spelling. Search queries become arrays of their parts; quotes and comments stay as they are.

    ValueError for search queries that have nothing to search for.
    """

    def query(m: re.Match) -> str:
        text = m[2].replace("''", "'")
        if m[1].lower() == "trigram_query":
            return _array(trigram_query(text))
        return f"array({', '.join(_array([folded(t) for t in phrase]) for phrase in search_query(text))})"

    sql = _SEARCH.sub(lambda m: (_ranked if m[1] else _candidates)(m[2].replace("''", "'")), sql)
    sql = _CALL.sub(query, sql)
    out, at = [], 0
    kept: list[str] = []
    for m in _QUOTED.finditer(sql):
        out.append(sql[at : m.start()])
        out.append(f"\x00{len(kept)}\x00")
        kept.append(m[0])
        at = m.end()
    text = "".join(out) + sql[at:]
    for pattern, new in _SPELLINGS:
        text = pattern.sub(new, text)
    return re.sub("\x00(\\d+)\x00", lambda m: kept[int(m[1])], text)
