"""Queries that run the trace projectors, framing, shell parser and evidence functions over the driver's tables.

Conversations are written as trace records of each runtime, framed from bytes, and projected on the executors, a source in a
group; the SQL states what the roles, loops and positions must be.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.batched import mapped, over_groups
from runledger.functions import terms
from runledger.plans.registry import query
from runledger.sources import evidence, framing, shell
from runledger.sources.model import bounded_all, publish_all
from runledger.sources.project import project
from runledger.tables import table

_AT = "2026-01-01T00:00:{:02d}Z"
_ITEMS = "conv_id long, item long, role string, loop_no long, loop_position long, text_bytes long, witnesses long"


def _codex(conv: int, turns: list[tuple[int, str, str]]) -> list[dict]:
    out = [{"type": "session_meta", "payload": {"id": f"s{conv}", "cwd": "/w"}}]
    for turn, role, text in turns:
        if role == "user":
            out.append({"type": "event_msg", "payload": {"type": "task_started", "turn_id": f"t{turn}"}})
            out.append({"type": "turn_context", "payload": {"turn_id": f"t{turn}", "model": "m"}})
            out.append({"type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": text}]}})
            out.append({"type": "event_msg", "payload": {"type": "user_message", "message": text}})
        elif role == "assistant":
            out.append({"type": "event_msg", "payload": {"type": "agent_message", "message": text}})
            out.append({"type": "response_item", "payload": {"type": "message", "role": "assistant", "phase": "final_answer", "content": [{"type": "output_text", "text": text}]}})
            out.append({"type": "event_msg", "payload": {"type": "task_complete"}})
        else:
            out.append({"type": "response_item", "payload": {"type": "message", "role": "developer", "content": [{"type": "input_text", "text": f"<user_instructions>{text}</user_instructions>"}]}})
    return out


def _claude(conv: int, turns: list[tuple[int, str, str]]) -> list[dict]:
    out = []
    for turn, role, text in turns:
        common = {"sessionId": f"s{conv}", "uuid": f"{conv}-{turn}"}
        if role == "user":
            out.append(common | {"type": "user", "promptId": f"p{turn}", "promptSource": "typed", "message": {"role": "user", "content": text}})
        elif role == "assistant":
            out.append(common | {"type": "assistant", "message": {"role": "assistant", "id": f"m{turn}", "model": "m", "stop_reason": "end_turn", "content": [{"type": "text", "text": text}]}})
        else:
            out.append(common | {"type": "attachment", "attachment": {"type": "invoked_skills", "skills": [{"content": text}]}})
    return out


def _pi(conv: int, turns: list[tuple[int, str, str]]) -> list[dict]:
    out = [{"type": "session", "id": f"s{conv}", "cwd": "/w"}]
    for turn, role, text in turns:
        more = {"stopReason": "stop"} if role == "assistant" else {}
        out.append({"type": "message", "id": str(turn), "message": {"role": role, "content": [{"type": "text", "text": text}], **more}})
    return out


def _antigravity(conv: int, turns: list[tuple[int, str, str]]) -> list[dict]:
    kinds = {"user": ("USER_EXPLICIT", "USER_INPUT"), "assistant": ("MODEL", "PLANNER_RESPONSE")}
    return [{"step_index": turn, "source": kinds.get(role, ("SYSTEM", "SYSTEM_MESSAGE"))[0], "type": kinds.get(role, ("SYSTEM", "SYSTEM_MESSAGE"))[1], "content": f"<user_instructions>{text}" if role == "system" else text} for turn, role, text in turns]


_WRITERS = {"codex": _codex, "claude": _claude, "pi": _pi, "antigravity": _antigravity}


def _path(runtime: str, conv: int | None) -> str:
    return f"/brain/{(conv or 0) % 2**32:08x}-0000-4000-8000-000000000000/.system_generated/logs/transcript.jsonl" if runtime == "antigravity" else f"/traces/{conv}.jsonl"


def projected(spark: SparkSession, sf_dir: str, runtime: str) -> DataFrame:
    """The items of all conversations, written, framed and projected as traces of a runtime."""

    def run(sources: list[tuple]):
        sessions = []
        for conv, turns in sources:
            data = b"".join(json.dumps(v, ensure_ascii=False).encode() + b"\n" for v in _WRITERS[runtime](conv, turns))
            records = list(framing.frame(data))
            if framing.runtime_of(_path(runtime, conv), records[0].value) != runtime:
                raise ValueError(f"not told as {runtime}")
            sessions.append(project(runtime, _path(runtime, conv), records))
        for (conv, _), out in zip(sources, publish_all(sessions), strict=True):
            sizes = {b["blob_hash"]: b["full_bytes"] for b in out["blobs"]}
            for n, i in enumerate(out["items"]):
                yield conv, n, i["role"], None if i["loop"] is None else i["loop"] + 1, i["loop_position"], sizes.get(i["blob_hash"]), len(i["records"])

    rows = table(spark, sf_dir, "conversations").where("text IS NOT NULL AND text <> ''").select("conv_id", "turn", "role", "text")
    return over_groups(rows, "conv_id", "turn", run, _ITEMS)


_SPINE = """t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS item, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations WHERE text <> ''),
l AS (SELECT *, nullif(sum(CASE WHEN role = 'user' AND {opens} THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn), 0) AS loop_no FROM t),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id, loop_no ORDER BY turn) - 1 AS place, row_number() OVER (PARTITION BY conv_id, loop_no, role ORDER BY turn) AS nth FROM l)"""


def _spine_sql(opens: str, answer: str, system: str, extra: str, witnesses: str) -> str:
    return f"""WITH {_SPINE.format(opens=opens)} SELECT conv_id, CAST(item AS BIGINT) AS item,
        CASE role WHEN 'user' THEN CASE WHEN nth = 1 THEN 'human.request' ELSE 'human.steering' END WHEN 'assistant' THEN '{answer}' ELSE '{system}' END AS role,
        CAST(loop_no AS BIGINT) AS loop_no, CASE WHEN loop_no IS NOT NULL THEN CAST(place AS BIGINT) END AS loop_position,
        CAST(strlen(text) + CASE WHEN role = 'system' THEN {extra} ELSE 0 END AS BIGINT) AS text_bytes, CAST({witnesses} AS BIGINT) AS witnesses FROM p"""


_ENDED = "coalesce(before, 'assistant') <> 'user'"


@query("projector_codex", _spine_sql("true", "agent.final_answer", "runtime.instructions", "39", "CASE WHEN role = 'system' THEN 1 ELSE 2 END"))
def projector_codex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-track traces: every text has two witnesses, every task is a loop."""
    return projected(spark, sf_dir, "codex")


@query("projector_claude", _spine_sql(_ENDED, "agent.final_answer", "runtime.instructions", "0", "1"))
def projector_claude(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts steer a running loop and open one after an ending."""
    return projected(spark, sf_dir, "claude")


@query("projector_pi", _spine_sql(_ENDED, "agent.final_answer", "runtime.instructions", "0", "1"))
def projector_pi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A human message opens a loop unless one is running."""
    return projected(spark, sf_dir, "pi")


@query("projector_antigravity", _spine_sql("true", "agent.commentary", "runtime.instructions", "19", "1"))
def projector_antigravity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every explicit input opens a loop; nothing is declared final."""
    return projected(spark, sf_dir, "antigravity")


@query(
    "framed_records",
    """WITH r AS (SELECT conv_id, turn, strlen(text) AS n, row_number() OVER w - 1 AS position, count(*) OVER (PARTITION BY conv_id) AS total,
            coalesce(sum(strlen(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
            FROM (SELECT conv_id, turn, replace(text, chr(10), ' ') AS text FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
        SELECT conv_id, CAST(position AS BIGINT) AS position, CAST(start AS BIGINT) AS start, CAST(start + n AS BIGINT) AS "end" FROM r WHERE position < total - 1""",
)
def framed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte framing: the last line of each source has no end and is no record."""

    def run(sources: list[tuple]):
        for conv, turns in sources:
            for r in framing.frame("\n".join(text.replace("\n", " ") for _, text in turns).encode()):
                yield conv, r.position, r.start, r.end

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return over_groups(rows, "conv_id", "turn", run, "conv_id long, position long, start long, end long")


def _mapped(df: DataFrame, f, schema: str) -> DataFrame:
    """Rows of `f(*values)` for each row."""
    return mapped(df, lambda rows: (out for row in rows for out in f(*row)), schema)


@query(
    "shell_parse",
    """WITH e AS (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
        SELECT event_id, CAST(s AS BIGINT) AS statement, ['cat', event_type, 'tool' || k, 'echo'][s + 1] AS program, ['first', 'pipe', 'and', 'sequence'][s + 1] AS connector,
            CAST([0, 0, 1, 2][s + 1] AS BIGINT) AS pipeline, CAST([0, 1, 0, 0][s + 1] AS BIGINT) AS position, CAST(CASE WHEN s = 3 THEN 1 ELSE 0 END AS BIGINT) AS redirects FROM e, range(4) r(s)""",
)
def shell_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements, pipelines, connectors and redirects of commands made from events."""

    def run(event_id: int, kind: str, k: int):
        command = f"cat 'a b' | /bin/{kind} -n {k} && tool{k} \"$HOME\"; echo done 2> /tmp/{k}.log"
        for s in shell.parse_shell(command)[0]["statements"]:
            yield event_id, s["id"], s["invocations"][0]["name"], s.get("connector", "first"), s["pipeline"]["id"], s["pipeline"]["position"], len(s["redirects"])

    rows = table(spark, sf_dir, "events").select("event_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return _mapped(rows, run, "event_id long, statement long, program string, connector string, pipeline long, position long, redirects long")


@query(
    "shell_wrappers",
    """WITH e AS (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
        p AS (SELECT *, ['nice', 'timeout', 'env', 'bash', 'nohup', 'command'][event_id % 6 + 1] AS wrapper FROM e)
        SELECT event_id, CAST(0 AS BIGINT) AS fragment, CAST(0 AS BIGINT) AS place, wrapper AS program, CAST([4, 4, 3, 4, 2, 2][event_id % 6 + 1] AS BIGINT) AS arguments, 'literal' AS basis FROM p
        UNION ALL SELECT event_id, 0, 1, event_type, 1, 'quoted' FROM p WHERE event_id % 6 IN (0, 1, 2)
        UNION ALL SELECT event_id, 1, 0, event_type, 1, 'literal' FROM p WHERE event_id % 6 = 3""",
)
def shell_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs behind wrappers and in scripts of shells; options that aren't known hide the program."""

    def run(event_id: int, kind: str, k: int):
        command = (
            f"nice -n {k} '{kind}' {k}", f"timeout --foreground {k} '{kind}' {k}", f"env K={k} '{kind}' {k}", f"bash -o pipefail -c '{kind} {k}'", f"nohup --unheard {kind}", f"command -v {kind}",
        )[event_id % 6]
        for n, fragment in enumerate(shell.parse_shell(command)):
            for place, call in enumerate(fragment["statements"][0]["invocations"]):
                yield event_id, n, place, call["name"], len(call["arguments"]), call["program"]["basis"]

    rows = table(spark, sf_dir, "events").select("event_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return _mapped(rows, run, "event_id long, fragment long, place long, program string, arguments long, basis string")


@query("blob_identity", "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_doc, CAST(strlen(text) AS BIGINT) AS full_bytes, strlen(text) > 4096 AS cut FROM documents")
def blob_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blobs by the hash of the whole text, with bounded prefixes."""

    def run(some: list[tuple]):
        for (doc_id, _), b in zip(some, bounded_all([text for _, text in some], 4096), strict=True):
            yield doc_id, b["blob_hash"], b["full_bytes"], len(b["text"].encode()) < b["full_bytes"]

    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text")
    rows = mapped(docs, run, "doc_id long, blob string, full_bytes long, cut boolean")
    first = rows.groupBy("blob").agg(F.min("doc_id").alias("first_doc"))
    return rows.join(first, "blob").select("doc_id", "first_doc", "full_bytes", "cut")


@query("record_display", "SELECT doc_id, strlen(text) > 2048 AS referenced, 'image/png' AS media_type, CAST(strlen(text) AS BIGINT) AS asset_bytes FROM documents")
def record_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long texts and inline assets become references; an asset decodes to its own bytes."""
    import base64

    def run(doc_id: int, text: str):
        value = {"text": text, "parts": [{"url": "data:image/png;base64," + base64.b64encode(text.encode()).decode()}]}
        shown = evidence.displayed(value, doc_id)
        number, pointer = evidence.parse_reference(shown["parts"][0]["url"]["$trace_ref"])
        uri = evidence.at_pointer(value, pointer)
        yield number, isinstance(shown["text"], dict), shown["parts"][0]["url"]["media_type"], len(base64.b64decode(uri.partition(",")[2]))

    return _mapped(table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text"), run, "doc_id long, referenced boolean, media_type string, asset_bytes long")


@query("mixed_terms")
def mixed_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many terms of the index each whole text has; null texts have none."""

    def run(doc_id: int, text: str):
        found = terms.terms(text)
        yield doc_id, len(found), len(set(found))

    return _mapped(table(spark, sf_dir, "documents").select("doc_id", "text"), run, "doc_id long, terms long, distinct_terms long")
