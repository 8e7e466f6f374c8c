"""The command line from end to end, and streams."""

import json

import pytest

from runledger import cli, streaming
from tests.test_sources import codex_records, write


@pytest.fixture
def run(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setenv("RUNLEDGER_CONFIG", str(tmp_path / "config.json"))

    def call(*args, status=0):
        assert cli.main(["--index", str(tmp_path / "index"), *args], spark) == status
        out = capsys.readouterr()
        return json.loads(out.out)["data"] if status == 0 else out.err

    return call


def test_commands(run, tmp_path, capsys):
    write(tmp_path / "traces" / "a.jsonl", codex_records())
    assert [r["action"] for r in run("index", "sync", str(tmp_path / "traces"), "--progress", "ndjson")] == ["indexed"]
    assert [r["action"] for r in run("index", "sync", str(tmp_path / "traces"))] == ["unchanged"]
    assert run("index", "status")["items"] == 4
    report = run("query", "run", "SELECT item_id, loop_position FROM items ORDER BY item_id", "--limit", "2")
    assert (report["row_count"], report["complete"], report["limit_reason"]) == (2, False, "row_limit")
    assert "hint" in run("query", "run", "DROP TABLE items", status=1)
    assert "no relation" in run("query", "run", "SELECT * FROM secret", status=1)
    record = run("query", "run", "SELECT min(record_id) AS r FROM records")["rows"][0]["r"]
    assert run("record", "verify", str(record))["status"] == "verified"
    assert run("record", "export", str(record), str(tmp_path / "out"))["bytes"] == len(json.dumps(codex_records()[0]))
    run("record", "export", str(record), str(tmp_path / "out"), status=1)
    assert run("metadata", "set", "codex", "s-1", '{"k": 1}') == {"version": 1}
    assert run("query", "run", "SELECT metadata, session_id IS NOT NULL AS known FROM session_metadata")["rows"] == [{"metadata": '{"k": 1}', "known": True}]
    assert "version 1" in run("metadata", "delete", "codex", "s-1", "--expected-version", "5", status=1)
    assert run("schema", "list")[0] == "sources" and run("schema", "get", "blobs")[0]["name"] == "blob_id"
    assert "search" in run("docs", "list") and run("docs", "search", "TRIGRAMS candidates")[0]["topic"] == "search"
    assert run("config", "show")["index"]["from"] == "flag"
    assert run("config", "init")["bytes"] > 0 and run("config", "check")[-1]["ok"]


def test_stream_counts(spark, tmp_path):
    rows = [("2026-01-01 00:00:01", "a"), ("2026-01-01 00:04:59", "a"), ("2026-01-01 00:05:00", "b")]
    spark.createDataFrame(rows, "ts string, kind string").selectExpr("cast(ts AS timestamp) AS ts", "kind").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, kind string").parquet(str(tmp_path / "in"))
    query = streaming.windowed_counts(stream, "ts", "kind").writeStream.outputMode("complete").format("memory").queryName("counts").start()
    query.processAllAvailable()
    query.stop()
    assert sorted((str(r["start"])[11:16], r["kind"], r["n"]) for r in spark.table("counts").collect()) == [("00:00", "a", 2), ("00:05", "b", 1)]
