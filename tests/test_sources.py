"""Framing, projection, the index and its relations, over small traces written here."""

import json
import os

import pytest

from runledger.functions.blake3 import blake3_hex
from runledger.plans import runner
from runledger.sources import evidence, framing, metadata, store, views
from runledger.sources.framing import Record
from runledger.sources.model import UsageLedger, publish, usage
from runledger.sources.project import project
from runledger.sources.shell import parse_shell

AT = "2026-09-07T13:40:0{}Z"


def codex_records():
    given = [
        ("session_meta", {"id": "s-1", "cwd": "/work", "timestamp": AT.format(0)}),
        ("event_msg", {"type": "task_started", "turn_id": "t-1"}),
        ("turn_context", {"turn_id": "t-1", "model": "m-1", "effort": "high"}),
        ("response_item", {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "find the bug please"}]}),
        ("event_msg", {"type": "user_message", "message": "find the bug please"}),
        ("response_item", {"type": "function_call", "call_id": "c-1", "name": "shell", "arguments": json.dumps({"command": ["bash", "-lc", "ls | wc -l"]})}),
        ("response_item", {"type": "function_call_output", "call_id": "c-1", "output": "Exit code: 0\nWall time: 1.5 s\nOutput:\n3"}),
        ("response_item", {"type": "message", "role": "assistant", "phase": "final_answer", "content": [{"type": "output_text", "text": "it is in line three"}]}),
        ("event_msg", {"type": "agent_message", "message": "it is in line three", "phase": "final_answer"}),
        ("event_msg", {"type": "task_complete", "turn_id": "t-1", "last_agent_message": "it is in line three"}),
    ]
    return [{"type": k, "payload": p, "timestamp": AT.format(i)} for i, (k, p) in enumerate(given)]


def as_records(values):
    return [Record(i, 0, 0, b"", "ok", v) for i, v in enumerate(values)]


def write(path, values, tail=b""):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"".join(json.dumps(v).encode() + b"\n" for v in values) + tail)
    return str(path)


def test_frames_only_ended_records_with_their_bytes():
    data = b'{"a": 1}\r\nnot json\n{"tail"'
    records = list(framing.frame(data))
    assert [(r.position, r.start, r.end, r.status) for r in records] == [(0, 0, 9, "ok"), (1, 10, 18, "malformed")]
    assert records[0].data == b'{"a": 1}\r'
    assert framing.complete_prefix(data) == 19
    assert [r.status for r in framing.frame(b'{"x": "long"}\n', most=5)] == ["oversized"]


def test_discovery_prefers_plain_and_full_files(tmp_path):
    for name in ("a.jsonl", "a.jsonl.zst", "b.jsonl.zst", "x/transcript.jsonl", "x/transcript_full.jsonl", "skip.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"")
    os.symlink(tmp_path / "a.jsonl", tmp_path / "link.jsonl")
    assert [os.path.relpath(p, tmp_path) for p in framing.discover([str(tmp_path)])] == ["a.jsonl", "b.jsonl.zst", "x/transcript_full.jsonl"]


@pytest.mark.parametrize(
    ("size", "start"),
    [(0, "af1349b9f5f9a1a6"), (1, "2d3adedff11b61f1"), (1023, "10108970eeda3eb9"), (1024, "42214739f095a406"), (1025, "d00278ae47eb27b3"), (2048, "e776b6028c7cd22a"), (31744, "62b6960e1a44bcc1"), (102400, "bc3e3d41a1146b06")],
)
def test_hash_has_the_published_values(size, start):
    assert blake3_hex(bytes(i % 251 for i in range(size))).startswith(start)


def test_two_tracks_become_one_item_with_two_witnesses():
    out = publish(project("codex", "/x.jsonl", as_records(codex_records())))
    assert [(i["role"], i["records"]) for i in out["items"]] == [("human.request", [3, 4]), ("agent.tool_call.shell", [5]), ("tool.output", [6]), ("agent.final_answer", [7, 8])]
    assert [i["loop_position"] for i in out["items"]] == [0, 1, 2, 3]
    assert out["items"][2]["call_ordinal"] == out["items"][1]["ordinal"]
    facts = json.loads(out["items"][2]["value"])
    assert (facts["exit_code"], facts["duration_ms"], facts["failed"]) == (0, 1500, False)
    (loop,) = out["loops"]
    assert (loop["native_id"], loop["end"], loop["outcome"], json.loads(loop["model"])) == ("t-1", 9, "completed", {"id": "m-1", "effort": "high"})


def test_claude_usage_counts_the_last_snapshot_of_a_response():
    def reply(n, key, i, o, stop=None):
        return {"type": "assistant", "sessionId": "s", "timestamp": AT.format(n), "message": {"id": key, "model": "m", "stop_reason": stop, "usage": {"input_tokens": i, "cache_read_input_tokens": 20, "output_tokens": o}, "content": [{"type": "text", "text": f"t{n}"}]}}

    ask = {"type": "user", "sessionId": "s", "promptId": "p", "origin": {"kind": "human"}, "timestamp": AT.format(0), "message": {"role": "user", "content": "hello"}}
    out = publish(project("claude", "/x.jsonl", as_records([ask, reply(1, "r1", 5, 1), reply(2, "r1", 10, 7), reply(3, "r2", 1, 2, "end_turn")])))
    assert [i["role"] for i in out["items"]] == ["human.request", "agent.commentary", "agent.commentary", "agent.final_answer"]
    assert json.loads(out["loops"][0]["usage"]) == {"input": 51, "cached": 40, "output": 9}
    assert (out["loops"][0]["end"], out["loops"][0]["outcome"]) == (3, None)


def test_pi_loops_end_by_stop_reason_and_usage_is_normalised():
    values = [
        {"type": "session", "id": "p-1", "cwd": "/w", "timestamp": AT.format(0)},
        {"type": "model_change", "id": "1", "modelId": "m-2"},
        {"type": "message", "id": "2", "message": {"role": "user", "content": "do it"}},
        {"type": "message", "id": "3", "message": {"role": "assistant", "stopReason": "toolUse", "content": [{"type": "toolCall", "id": "c", "name": "bash", "arguments": {"command": "ls"}}], "usage": {"input": 10, "cacheRead": 20, "cacheWrite": 3, "output": 7, "reasoning": 2}}},
        {"type": "message", "id": "4", "message": {"role": "toolResult", "toolCallId": "c", "isError": False, "content": [{"type": "text", "text": "a"}]}},
        {"type": "message", "id": "5", "message": {"role": "assistant", "stopReason": "stop", "content": [{"type": "text", "text": "done"}]}},
    ]
    out = publish(project("pi", "/x.jsonl", as_records(values)))
    assert [i["role"] for i in out["items"]] == ["human.request", "agent.tool_call.shell", "tool.output", "agent.final_answer"]
    (loop,) = out["loops"]
    assert (loop["outcome"], json.loads(loop["usage"])) == ("completed", {"input": 33, "cached": 20, "cache_write": 3, "output": 7, "reasoning": 2})
    assert json.loads(loop["model"]) == {"id": "m-2"}


def test_antigravity_shell_call():
    path = "/brain/0a1b2c3d-0000-4000-8000-000000000001/.system_generated/logs/transcript.jsonl"
    values = [
        {"step_index": 0, "source": "USER_EXPLICIT", "type": "USER_INPUT", "content": "go", "created_at": AT.format(0)},
        {"step_index": 1, "source": "MODEL", "type": "PLANNER_RESPONSE", "thinking": "hm", "tool_calls": [{"name": "run_command", "args": {"CommandLine": "printf ok | cat; printf err 2>errors.log"}}]},
    ]
    assert framing.runtime_of(path, values[0]) == "antigravity"
    out = publish(project("antigravity", path, as_records(values)))
    statements = json.loads(out["items"][2]["value"])["shell_fragments"][0]["statements"]
    assert (statements[1]["invocations"][0]["name"], statements[1]["pipeline"]["position"]) == ("cat", 1)
    assert statements[2]["redirects"][0]["target"]["text"] == "errors.log"
    assert out["loops"][0]["end"] is None and out["loops"][0]["usage"] is None


def test_usage_rules():
    assert usage(10, 20, 3, 7, 2, False) == {"input": 33, "cached": 20, "cache_write": 3, "output": 7, "reasoning": 2}
    assert usage(10, 20, None, 7, 9, True) == {"input": 10, "cached": None, "cache_write": None, "output": 7, "reasoning": None}
    assert usage(None, 1, 1, 1, 1, True) is None
    ledger = UsageLedger()
    ledger.observe("a", 0, usage(1, 1, None, 1, None, True))
    ledger.observe("b", 0, usage(1, None, None, 1, None, True))
    assert ledger.totals() == {0: {"input": 2, "cached": None, "cache_write": None, "output": 2, "reasoning": None}}


def test_shell_limits_and_partial_scripts():
    assert parse_shell("echo 'open")[0]["status"] == "partial"
    assert parse_shell("x", "powershell") == [{"text": "x", "language": "powershell", "status": "partial", "statements": []}]
    nested = parse_shell("nice -n 5 bash -c 'cd a && make'")
    assert [f.get("parent") for f in nested] == [None, {"fragment": 0, "statement": 0}]
    assert [s.get("connector") for s in nested[1]["statements"]] == [None, "and"]
    assert len(parse_shell("a;" * 600)[0]["statements"]) == 512


def test_index_life(spark, tmp_path):
    index, root = str(tmp_path / "index"), tmp_path / "traces"
    path = write(root / "one.jsonl", codex_records(), b'{"partial')
    write(root / "none.jsonl", [{"type": "session_meta", "payload": {}}])
    report = {os.path.basename(r["locator"]): r for r in store.sync(spark, index, [str(root)])}
    assert report["one.jsonl"]["action"] == "indexed" and report["none.jsonl"]["action"] == "skipped"
    views.register(spark, index)
    row = runner.run(spark, "SELECT runtime, native_id, working_directory FROM sessions", set(views.PUBLIC)).rows
    assert row == [{"native_id": "s-1", "runtime": "codex", "working_directory": "/work"}]
    roles = runner.run(spark, "SELECT get_json_object(semantic, '$.role') AS role, count(*) AS n FROM items GROUP BY 1 ORDER BY 1", set(views.PUBLIC)).rows
    assert [r["role"] for r in roles] == ["agent.final_answer", "agent.tool_call.shell", "human.request", "tool.output"]
    text = runner.run(spark, "SELECT b.text FROM items i JOIN blobs b ON b.blob_id = get_json_object(i.semantic, '$.value.text.blob_id') WHERE get_json_object(i.semantic, '$.role') = 'human.request'", set(views.PUBLIC)).rows
    assert text == [{"text": "find the bug please"}]
    linked = runner.run(spark, "SELECT c.item_id = get_json_object(o.semantic, '$.value.call_item_id') AS same FROM items c JOIN items o ON o.item_id > c.item_id WHERE get_json_object(o.semantic, '$.role') = 'tool.output' AND get_json_object(c.semantic, '$.role') = 'agent.tool_call.shell'").rows
    assert linked == [{"same": True}]
    assert runner.run(spark, "SELECT DISTINCT item_id FROM item_search_terms WHERE term = 'bug'", set(views.PUBLIC)).rows[0]["item_id"] > 0

    ask = lambda sql: runner.run(spark, sql, set(views.PUBLIC)).rows
    assert len(ask("SELECT rowid FROM item_search(trigram_query('the bug'))")) == 1
    (hit,) = ask("WITH c AS MATERIALIZED (SELECT rowid AS item_id, bm25(item_search_terms) AS score FROM item_search_terms(search_query('bug find')) ORDER BY score LIMIT 5) SELECT json_extract(i.semantic, '$.role') AS role, score < 0 AS better FROM c JOIN items i USING (item_id)")
    assert hit == {"role": "human.request", "better": True}
    assert ask("SELECT rowid FROM item_search_terms(search_query('absent'))") == []
    witnesses = ask("SELECT i.item_id, w.value FROM items i JOIN json_each(i.record_ids) AS w WHERE json_extract(i.semantic, '$.role') = 'human.request'")
    assert len(witnesses) == 2
    (facts,) = ask("SELECT SUM(failed IS NOT NULL) AS known, SUM(failed = 1) AS failures, length(CAST(max(t) AS BLOB)) AS n FROM (SELECT json_extract(semantic, '$.value.failed') AS failed, 'é' AS t FROM items)")
    assert facts == {"known": 1, "failures": 0, "n": 2}
    assert ask("SELECT strftime('%Y-%m-%d %H:%M', unixepoch('2026-09-07T13:40:00Z'), 'unixepoch', '+08:00') AS t") == [{"t": "2026-09-07 21:40"}]
    with pytest.raises(runner.QueryError):
        ask("SELECT * FROM item_search(trigram_query('ab'))")

    record_id = runner.run(spark, "SELECT min(record_id) AS r FROM records").rows[0]["r"]
    record = evidence.locate(spark, record_id)
    assert evidence.verify(record) == "verified"
    assert evidence.exact_bytes(record) == json.dumps(codex_records()[0]).encode()
    assert evidence.inspect(record)["value"]["type"] == "session_meta"

    again = {os.path.basename(r["locator"]): r["action"] for r in store.sync(spark, index, [str(root)])}
    assert again["one.jsonl"] == "appended" or again["one.jsonl"] == "unchanged"
    more = {"type": "event_msg", "payload": {"type": "error", "message": "late"}, "timestamp": AT.format(9)}
    write(root / "one.jsonl", [*codex_records(), more])
    assert {os.path.basename(r["locator"]): r["action"] for r in store.sync(spark, index, [str(root)])}["one.jsonl"] == "appended"
    manifest = views.register(spark, index)
    assert spark.table("records").count() == 11
    assert evidence.verify(evidence.locate(spark, record_id)) == "verified"
    write(root / "one.jsonl", [codex_records()[0]])
    assert evidence.verify(evidence.Located(1, path, 10**6, 10**6 + 5, "")) == "source_short"
    assert evidence.verify(evidence.Located(1, path + "x", 0, 5, "")) == "source_missing"
    assert store.load(index).number == manifest.number
    with pytest.raises(store.PolicyError):
        store.sync(spark, index, [str(root)], text_bytes=10)


def test_assets_and_references(tmp_path):
    value = {"a": [{"b/c": "data:image/png;base64,aGk="}], "long": "x" * 3000}
    path = write(tmp_path / "r.jsonl", [value])
    data = open(path, "rb").read()[:-1]
    record = evidence.Located(7, path, 0, len(data), blake3_hex(data))
    shown = evidence.inspect(record)["value"]
    assert shown["a"][0]["b/c"]["$trace_ref"] == "7#/a/0/b~1c" and shown["long"]["kind"] == "text"
    assert evidence.asset(record, "/a/0/b~1c") == ("image/png", b"hi")
    out = str(tmp_path / "out.bin")
    evidence.write_private(out, b"hi")
    with pytest.raises(FileExistsError):
        evidence.write_private(out, b"hi")
    assert os.stat(out).st_mode & 0o777 == 0o600
    assert evidence.parse_reference("12#/a") == (12, "/a")


def test_metadata_versions(tmp_path):
    path = str(tmp_path / "m.json")
    assert metadata.get(path, "codex", "s") is None
    assert metadata.put(path, "codex", "s", "null") == 1
    assert metadata.get(path, "codex", "s")["metadata"] == "null"
    with pytest.raises(metadata.Conflict):
        metadata.put(path, "codex", "s", "{}", expected=0)
    assert metadata.delete(path, "codex", "s", expected=1) == 2
    assert metadata.get(path, "codex", "s")["metadata"] is None and metadata.put(path, "codex", "s", '{"a": 1.0}', expected=2) == 3


def test_compressed_source_replaces_the_plain_one(spark, tmp_path):
    import zstandard

    index, root = str(tmp_path / "index"), tmp_path / "with space 100% [a]"
    path = write(root / "one.jsonl", codex_records())
    store.sync(spark, index, [str(root)])
    before = store.load(index).sources[path]
    packed = zstandard.ZstdCompressor().compress(open(path, "rb").read())
    os.remove(path)
    (root / "one.jsonl.zst").write_bytes(packed[:40])
    assert [r["action"] for r in store.sync(spark, index, [str(root)])] == ["failed"]
    assert store.load(index).sources[path]["source_id"] == before["source_id"]
    (root / "one.jsonl.zst").write_bytes(packed)
    assert [r["action"] for r in store.sync(spark, index, [str(root)])] == ["unchanged"]
    (moved,) = store.load(index).sources.items()
    assert moved[0] == path + ".zst" and moved[1]["source_id"] == before["source_id"]
    views.register(spark, index)
    record = evidence.locate(spark, spark.sql("SELECT max(record_id) AS r FROM records").first()["r"])
    assert evidence.verify(record) == "verified"
    write(root / "one.jsonl", codex_records()[:4])
    assert [r["action"] for r in store.sync(spark, index, [str(root)])] == ["skipped"]
    assert [r["action"] for r in store.sync(spark, index, [str(root)], rebuild=True)] == ["rebuilt"]
    assert store.prune(index)
    views.register(spark, index)
    assert spark.table("records").count() == 4


def test_two_sources_of_one_session_and_a_fork(spark, tmp_path):
    def trace(name, start, ident, parent=None):
        meta = {"id": ident, "timestamp": AT.format(start), "cwd": "/w"} | ({"forked_from_id": parent} if parent else {})
        body = [("session_meta", meta), ("event_msg", {"type": "task_started", "turn_id": f"{name}-t"}), ("event_msg", {"type": "user_message", "message": f"ask {name}"})]
        write(tmp_path / "t" / f"{name}.jsonl", [{"type": k, "payload": p, "timestamp": AT.format(start)} for k, p in body])

    index = str(tmp_path / "index")
    trace("child", 5, "c", "p")
    store.sync(spark, index, [str(tmp_path / "t")])
    views.register(spark, index)
    assert spark.sql("SELECT forked_from FROM sessions").first()[0] is None  # the parent isn't known yet
    trace("a", 3, "p")
    trace("b", 1, "p")
    store.sync(spark, index, [str(tmp_path / "t")])
    views.register(spark, index)
    rows = {r["native_id"]: r for r in spark.sql("SELECT * FROM sessions").collect()}
    assert len(json.loads(rows["p"]["source_ids"])) == 2
    assert json.loads(rows["c"]["forked_from"])["session_id"] == rows["p"]["session_id"]
    spine = spark.sql(f"SELECT session_position, native_id FROM loops WHERE session_id = {rows['p']['session_id']} ORDER BY session_position").collect()
    assert [(r["session_position"], r["native_id"]) for r in spine] == [(0, "b-t"), (1, "a-t")]


def test_output_facts_of_every_line_and_nested_result():
    from runledger.sources.codex import output_facts

    late = "a\nb\nc\nd\n" + '[{"chunk": {"exit_code": 3, "wall_time_seconds": 0.25, "original_token_count": 7}}]'
    assert output_facts(late) == {"exit_code": 3, "failed": True, "duration_ms": 250, "runtime_output_tokens": 7, "runtime_truncated": False}
    assert output_facts('{"exit_code": 0}\n{"exit_code": 2}') == {"failed": True}
    assert output_facts('{"output": "", "metadata": {"exit_code": 1, "duration_seconds": 0.1}}') == {"exit_code": 1, "failed": True, "duration_ms": 100}
    assert output_facts("x\n" + '{"success": false}') == {"failed": True} and output_facts('{"isError": false}') == {"failed": False}
    assert output_facts(["Script completed\nOutput:\n", '{"exit_code": true}', "{broken"]) == {} and output_facts(None) == {}
    long_header = "Chunk ID: 1\n" + "x" * 3000 + "\nProcess exited with code 4\nOutput:\nok"
    assert output_facts(long_header) == {"exit_code": 4, "failed": True}


def test_searches_read_the_postings_of_their_grams_and_terms(spark, tmp_path):
    index, root = str(tmp_path / "index"), tmp_path / "traces"
    write(root / "one.jsonl", codex_records())
    store.sync(spark, index, [str(root)])
    views.register(spark, index)
    for sql, column in (("SELECT rowid FROM item_search(trigram_query('the bug'))", "gram"), ("SELECT rowid, score FROM item_search_terms(search_query('bug find'))", "term")):
        df = runner.prepare(spark, sql, set(views.PUBLIC))
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert f"In({column}, [" in plan and "MapInPandas" not in plan and "ArrowEvalPython" not in plan
        assert df.count() == 1
    whole = spark.sql("SELECT rowid FROM item_search(array('the', 'he ', 'bug'))").collect()  # any array of grams, without the rewriting
    assert len(whole) == 1
    by_function = spark.sql("SELECT score FROM item_search_terms(array(array('bug'), array('find')))").first()["score"]
    assert df.first()["score"] == pytest.approx(by_function)
    assert runner.prepare(spark, "SELECT rowid FROM item_search_terms(search_query('bug bug')) AS s", set(views.PUBLIC)).count() == 1
    counts = {r["item_id"]: r["item_terms"] for r in spark.table("item_term_counts").collect()}
    assert counts == {r["item_id"]: r["item_terms"] for r in spark.sql("SELECT DISTINCT item_id, item_terms FROM item_search_terms").collect()}


@pytest.mark.parametrize(
    ("command", "programs"),
    [
        ("nice -12 make all", ["nice", "make"]),
        ("nice --unheard 3 make", ["nice"]),
        ("timeout --foreground -k 2 9 env -i HOME=/ make", ["timeout", "env", "make"]),
        ("timeout -q 5 make", ["timeout"]),
        ("env -S 'make all'", ["env"]),
        ("env A=1 -- make", ["env", "make"]),
        ("nohup -x make", ["nohup"]),
        ("nohup -- make", ["nohup", "make"]),
        ("command -p make", ["command", "make"]),
        ("command -v make", ["command"]),
        ("env $OPTIONS make", ["env"]),
        ("timeout 5", ["timeout"]),
    ],
)
def test_programs_behind_wrappers(command, programs):
    (statement,) = parse_shell(command)[0]["statements"]
    assert [i["name"] for i in statement["invocations"]] == programs


@pytest.mark.parametrize(
    ("command", "script"),
    [("bash -o pipefail -c 'make all'", "make all"), ("bash -c -l 'make'", "make"), ("sh --norc -ec 'make'", "make"), ("zsh -c -- 'make'", "make"), ("bash build.sh -c make", None), ("bash -c \"$X\"", None), ("bash -3c make", None), ("sh -c ' '", None)],
)
def test_scripts_of_shells(command, script):
    nested = [f["text"] for f in parse_shell(command)[1:] if "parent" in f]
    assert nested == ([] if script is None else [script])


def test_a_request_before_its_task_is_carried_into_the_new_loop():
    say = lambda text: ("event_msg", {"type": "user_message", "message": text})
    given = [
        ("session_meta", {"id": "s-2", "timestamp": AT.format(0)}),
        ("event_msg", {"type": "task_started", "turn_id": "t-1"}),
        ("turn_context", {"turn_id": "t-1", "model": "m"}),
        say("first"),
        ("event_msg", {"type": "agent_message", "message": "answer"}),
        say("second"),
        ("turn_context", {"turn_id": "t-2", "model": "m"}),
        say("third"),
    ]
    out = publish(project("codex", "/x.jsonl", as_records([{"type": k, "payload": p, "timestamp": AT.format(i)} for i, (k, p) in enumerate(given)])))
    assert [(i["role"], i["loop"], i["loop_position"]) for i in out["items"]] == [
        ("human.request", 0, 0), ("agent.final_answer", 0, 1), ("human.request", 1, 0), ("human.steering", 1, 1),
    ]


def test_results_find_the_loop_of_their_call():
    call = lambda n, key: {"type": "assistant", "sessionId": "s", "timestamp": AT.format(n), "message": {"id": f"r{n}", "model": "m", "content": [{"type": "tool_use", "id": key, "name": "Bash", "input": {"command": "ls"}}]}}
    ask = lambda n: {"type": "user", "sessionId": "s", "promptId": f"p{n}", "origin": {"kind": "human"}, "timestamp": AT.format(n), "message": {"role": "user", "content": f"ask {n}"}}
    result = lambda n, key: {"type": "user", "sessionId": "s", "timestamp": AT.format(n), "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": key, "content": f"out {n}"}]}}
    out = publish(project("claude", "/x.jsonl", as_records([ask(0), call(1, "c-1"), call(2, "c-2"), result(3, "c-2"), result(4, "c-1"), result(5, "unseen")])))
    outputs = [i for i in out["items"] if i["role"] == "tool.output"]
    by = {n: i["ordinal"] for n, i in enumerate(out["items"])}
    assert [i["call_ordinal"] for i in outputs] == [by[2], by[1], None] and {i["loop"] for i in outputs} == {0}


def test_spellings_keep_nulls_and_letters(spark):
    from runledger.sources import dialect

    spark.sql("SELECT 1L AS item_id, 1 AS item_terms, 'a' AS gram, 'a' AS term, array(0) AS positions").createOrReplaceTempView("item_search")
    for name in ("item_search_terms", "item_term_counts"):
        spark.table("item_search").createOrReplaceTempView(name)
    dialect.register(spark)
    ask = lambda sql: spark.sql(dialect.rewrite(sql)).first().asDict()
    assert ask("SELECT SUM(x = 1) AS a, SUM(x IS NULL) AS b FROM VALUES (CAST(NULL AS INT)) AS t(x)") == {"a": None, "b": 1}
    assert ask("SELECT SUM(x = 1) AS a FROM VALUES (1), (1), (2), (NULL) AS t(x)") == {"a": 2}
    given = "unixepoch('2026-09-07T13:40:05Z'), 'unixepoch'"
    assert ask(f"SELECT strftime('%Y-%m-%dT%H:%M:%SZ', {given}) AS t, strftime('day %j', {given}, '+01:00') AS d") == {"t": "2026-09-07T13:40:05Z", "d": "day 250"}
    quoted = dialect.rewrite("WITH c AS MATERIALIZED (SELECT rowid FROM item_search(trigram_query('it''s'))) SELECT SUM(x = 1) AS a FROM c, json_each('[1]') AS w")
    assert "t\\u0027s" in quoted and "MATERIALIZED" not in quoted and "LATERAL json_each" in quoted
    assert spark.sql(f"SELECT {dialect._literal(chr(39) + chr(92) + 'a')} AS t").first()["t"] == chr(39) + chr(92) + "a"
