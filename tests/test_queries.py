"""Scalar functions, the SQL runner, and every driver query against DuckDB."""

import glob
import os
import random
import tracemalloc

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from runledger import batched
from runledger.functions import classify, terms, text, times
from runledger.plans import registry, runner, trace_queries  # noqa: F401  (it adds its queries)
from runledger.sources import framing

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    ("given", "ms"),
    [
        ("1999-03-04T05:06:07Z", 920_523_967_000),
        ("2020-02-29t23:30:00.1239+02:30", 1_583_010_000_123),
        ("2012-06-30 23:59:60Z", 1_341_100_799_000),
        ("2023-02-29T08:00:00Z", None),
        ("2021-11-05T07:15:00+24:00", None),
        ("2021-11-05T07:15:00.Z", None),
        ("2021-11-05", None),
    ],
)
def test_instants(spark, given, ms):
    assert times.instant_ms(given) == ms
    assert spark.range(1).select(times.instant_ms_column(F.lit(given))).first()[0] == ms


def test_terms_and_queries():
    assert terms.terms("loadRowCount") == ["loadrowcount", "load", "row", "count"]
    assert terms.terms("XMLFeed") == ["xmlfeed", "xml", "feed"]
    assert terms.terms("数据流水线 y") == ["数据", "据流", "流水", "水线"]
    assert terms.search_query("DuckDB 表格 lib/plan_v2.py") == [["duckdb"], ["表格"], ["lib"], ["plan_v2"], ["py"]]
    with pytest.raises(ValueError):
        terms.search_query(" -> ")
    with pytest.raises(ValueError):
        text.trigram_query("ab")


@pytest.mark.parametrize("most", [1, 2, 3, 4, 5, 7])
def test_bounded_prefix_ends_with_a_whole_character(spark, most):
    given = ["", "a", "é", "aé", "漢字", "😀b", "ab😀"]
    rows = spark.createDataFrame([(t,) for t in given], "t string").select("t", text.bounded_prefix(F.col("t"), most).alias("p")).collect()
    assert {r["t"]: r["p"] for r in rows} == {t: t.encode()[:most].decode("utf-8", "ignore") for t in given}


def test_injections(spark):
    for given, role in [("<permissions instructions>x", "runtime.permissions"), ("  ## Memory", "runtime.memory"), ("<nothing>", "runtime.unknown"), ("Network rule saved: a", "runtime.permissions"), ("plain", "runtime.unknown"), ("<image", "runtime.unknown")]:
        assert classify.injection(given)[0] == role
        assert spark.range(1).select(classify.injection_column(F.lit(given))).first()[0] == role
    assert classify.strength("origin_kind+tag_prefix") == "heuristic"


@pytest.mark.parametrize("sql", ["DROP TABLE x", "INSERT INTO x SELECT 1", "SELECT * FROM json.`/etc/passwd`", "SELECT reflect('java.lang.System', 'getenv')", "SET a=b", "SELECT 1; SELECT 2", "", "SELECT * FROM (SELECT * FROM parquet.`/x`)", "WITH a AS (SELECT * FROM csv.`/x`) SELECT * FROM a", "SELECT (SELECT max(a) FROM text.`/x`)", "CACHE TABLE t", "ADD JAR x"])
def test_runner_refuses(spark, sql):
    with pytest.raises(runner.QueryError):
        runner.prepare(spark, sql)


def test_runner_budgets(spark):
    report = runner.run(spark, "SELECT id, repeat('é', 10) AS t, CAST('ab' AS BINARY) AS b FROM range(10)", row_limit=3, cell_bytes=5)
    assert (len(report.rows), report.complete, report.limit_reason, report.cells_truncated) == (3, False, "row_limit", 3)
    assert report.rows[0]["t"] == "éé" and report.rows[0]["b"] == {"type": "blob", "bytes": 2, "hex": "6162"}
    assert runner.run(spark, "SELECT id FROM range(3)", row_limit=3).complete
    assert runner.run(spark, "SELECT repeat('x', 50) AS t FROM range(9)", output_bytes=150).limit_reason == "output_budget"
    with pytest.raises(runner.QueryError):
        runner.prepare(spark, "SELECT 1 AS a, 2 AS a")
    assert runner.run(spark, "WITH c AS MATERIALIZED (SELECT 1 AS x) SELECT x, ' AS MATERIALIZED ' AS q FROM c").rows == [{"x": 1, "q": " AS MATERIALIZED "}]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for at in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(at)[:-8]} AS SELECT * FROM '{at}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_duckdb(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    theirs = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(theirs.columns) == columns
    own = sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect())))
    at = [theirs.columns.index(c) for c in columns]
    assert own == sorted(map(repr, (tuple(r[i] for i in at) for r in theirs.fetchall())))


RUNTIMES = ["pi", "claude", "codex", "antigravity"]


@pytest.mark.parametrize("runtime", RUNTIMES)
def test_projector_over_many_and_long_conversations(spark, tmp_path, runtime):
    """Sources go through the projector together; one that spans Arrow batches stays whole, and a null id is a source too."""
    draw, long = random.Random(7), {None: 3, -5: 2, 1000: 11_000}
    role = lambda t: "user" if t % 2 else "assistant" if t else draw.choice(["user", "system"])
    rows = [(c, t, role(t), "é" * draw.choice([0, 1, 900][t < 2 or t % 2 :]) + f"{c} {t}" * draw.randint(0, 2)) for c in [*range(300), *long] for t in range(long.get(c, 3))]
    draw.shuffle(rows)
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    df = registry.QUERIES[f"projector_{runtime}"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    theirs = con.sql(registry.ORACLE_SQL[f"projector_{runtime}"])
    own = sorted(map(repr, (tuple(r[c] for c in theirs.columns) for r in df.collect())))
    assert own == sorted(map(repr, theirs.fetchall()))


MAPPED = ["record_display", "mixed_terms"]


@pytest.mark.parametrize("name", MAPPED)
def test_python_memory_does_not_follow_the_batch(spark, monkeypatch, name):
    class Stepped:
        """Runs the Python step of a query in this process."""

        sparkSession = spark  # noqa: N815
        where = select = lambda self, *_: self
        mapInArrow = lambda self, run, _: lambda batch: sum(b.num_rows for b in run(iter([batch])))  # noqa: N815, E731
        mapInPandas = lambda self, run, _: lambda batch: sum(map(len, run(map(pa.RecordBatch.to_pandas, [batch]))))  # noqa: N815, E731

    monkeypatch.setattr(trace_queries, "table", lambda *_: Stepped())
    step = registry.QUERIES[name](None, "")
    batch = pa.RecordBatch.from_pydict({"doc_id": range(5000), "text": [f"{i} é" + ("w" * 99 + " ") * 40 for i in range(5000)]})
    tracemalloc.start()
    rows, (_, peak) = step(batch), tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert rows == 5000 and peak < 10_000_000, peak  # the batch has 20 MB


def test_slices_of_batches():
    batch = pa.RecordBatch.from_pydict({"k": [1, 1, None, None, 4, 4, 4], "t": ["ab", None, "", "x" * 500, "é", "b", "c"]})
    assert [len(s) for s in batched.slices(batch, 150)] == [2, 1, 3, 1]
    assert [r for s in batched.slices(batch, 150) for r in s] == list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
    assert [len(s) for s in batched.slices(batch)] == [7] and list(batched.slices(batch.slice(0, 0))) == [[]]


def test_hashes_of_many_sessions_are_mixed_together(monkeypatch):
    from runledger.functions import blake3
    from runledger.sources import model, project

    def session(n):
        records = [framing.Record(i, 0, 0, b"", value=v) for i, v in enumerate(trace_queries._pi(n, [(0, "user", f"ask {n}"), (1, "assistant", "é" * n), (2, "user", "same")]))]
        return project.project("pi", "/x.jsonl", records)

    sessions = [session(n) for n in range(1, 150)]
    each = [model.publish(s) for s in sessions]
    mixed, real = [], blake3._compress
    monkeypatch.setattr(blake3, "_compress", lambda *a: mixed.append(a[1].shape[1]) or real(*a))
    assert model.publish_all(sessions) == each
    assert len(mixed) < 20 and max(mixed) <= blake3.CHUNKS  # a session took 2 calls at least


def _terms_by_character(given):
    """The terms of a text, read character by character."""
    kind = lambda c: "pair" if any(a <= c <= b for a, b in zip(terms.PAIRED[::3], terms.PAIRED[2::3], strict=True)) else "name" if c == "_" or c.isascii() and c.isalnum() else "word" if c.isalnum() and not c.isdecimal() else ""
    out, i = [], 0
    while i < len(given):
        k, j = kind(given[i]), i + 1
        while j < len(given) and k and (kind(given[j]) == k or k == "word" and given[j].isascii() and given[j].isalpha()):
            j += 1
        run, i = given[i:j], j
        if k == "pair":
            out += [run[n : n + 2] for n in range(len(run) - 1)]
        elif k == "word" and len(run.lower()) >= 2:
            out.append(run.lower())
        elif k == "name":
            parts, now = [], ""
            for n, c in enumerate(run):
                before, after = run[n - 1 : n] if n else "", run[n + 1 : n + 2]
                cut = c == "_" or c.isdigit() != before.isdigit() or before == "_" or before.islower() and c.isupper() or before.isupper() and c.isupper() and after.islower()
                if cut and now:
                    parts, now = [*parts, now], ""
                now += c if c != "_" else ""
            parts += [now] if now else []
            out += [x for x in (run.lower(), *(p.lower() for p in parts if p.lower() != run.lower())) if len(x) >= 2]
    return out


def test_mixed_terms_of_whole_documents(spark, tmp_path):
    odd = ["loadRowCount XMLFeed v2_max 数据流水线caféNoir ΑΒγ x², _a_ 12ab3", None, "", "한국어 カタカナ A1B2c3"]
    prose = [r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    rows = list(enumerate([*odd, *prose]))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["terms"], r["distinct_terms"]) for r in registry.QUERIES["mixed_terms"](spark, str(tmp_path)).collect()}
    expected = {i: _terms_by_character(x or "") for i, x in rows}
    assert terms.terms(odd[0]) == expected[0] and terms.terms(odd[3]) == expected[3]
    assert got == {i: (len(x), len(set(x))) for i, x in expected.items()}


def test_lineage_of_any_depth(spark):
    from runledger.operators import links

    spark.range(1, 121).selectExpr("id", "id - 1 AS parent").createOrReplaceTempView("_deep_edges")
    spark.range(0, 1).createOrReplaceTempView("_deep_roots")
    rows = links.lineage(spark, "_deep_edges", "_deep_roots").collect()
    assert sorted((r["root"], r["id"], r["depth"]) for r in rows) == [(0, n, n) for n in range(121)]
