"""Command line: index sync and status, schema, query, record, asset, session metadata."""

from __future__ import annotations

import argparse
import json
import os
import sys

from runledger.plans import runner
from runledger.sources import evidence, metadata, store, views


def _config_path() -> str:
    return os.environ.get("RUNLEDGER_CONFIG", os.path.expanduser("~/.config/runledger.json"))


def _checked(settings: dict[str, tuple[object, str]]) -> list[dict[str, object]]:
    """What would keep a sync or query from working: a row for each root and for the index."""
    out = [{"check": f"root {r}", "ok": os.path.isdir(r) or os.path.isfile(r)} for r in settings["roots"][0]]
    index = settings["index"][0]
    out.append({"check": f"index {index}", "ok": not os.path.exists(index) or os.access(index, os.W_OK)})
    try:
        out.append({"check": "index format", "ok": store.load(index).number >= 0})
    except ValueError as error:
        out.append({"check": "index format", "ok": False, "error": str(error)})
    return out


#: Short texts on what the commands are about, by topic.
TOPICS = {
    "evidence": "Every item names the records it rests on. record verify compares a record's bytes with its fingerprint; record inspect shows it with long values as references; asset extract follows record#/pointer.",
    "query": "query run takes one SELECT over the public relations (schema list). Results stop at the row and output limits; complete=false says so, with a hint. MATERIALIZED is accepted.",
    "search": "item_search holds trigrams and item_search_terms holds terms with positions. Both give candidates: confirm literals with instr on blobs.text.",
    "sync": "index sync reads new and changed traces. A source is unchanged, indexed, appended, rebuilt, skipped or failed; a failed one keeps its last state.",
    "usage": "loops.usage has input with cached parts, and output with reasoning. A missing part is unknown, not zero.",
}


def _docs(args) -> object:
    """Topics, one topic, or the topics that hold all words, in any case."""
    if args.verb == "list":
        return sorted(TOPICS)
    if args.verb == "get":
        if args.topic_name not in TOPICS:
            raise KeyError(f"no topic {args.topic_name}")
        return {"topic": args.topic_name, "text": TOPICS[args.topic_name]}
    words = args.words.lower().split()
    return [{"topic": t, "text": x} for t, x in sorted(TOPICS.items()) if all(w in f"{t} {x}".lower() for w in words)]


def _settings(args: argparse.Namespace) -> dict[str, tuple[object, str]]:
    """(value, where it comes from) by name: flag, environment, file, default."""
    given: dict = {}
    path = _config_path()
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
    out = {}
    for name, default in (("index", os.path.expanduser("~/.local/share/runledger")), ("metadata", None), ("roots", [])):
        flag, env = getattr(args, name, None), os.environ.get(f"RUNLEDGER_{name.upper()}")
        if flag:
            out[name] = (flag, "flag")
        elif env:
            out[name] = (env.split(os.pathsep) if name == "roots" else env, "environment")
        elif name in given:
            out[name] = (given[name], "file")
        else:
            out[name] = (default, "default")
    if out["metadata"][0] is None:
        out["metadata"] = (f"{out['index'][0]}-metadata.json", "default")
    return out


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="runledger")
    p.add_argument("--index")
    p.add_argument("--metadata")
    top = p.add_subparsers(dest="topic", required=True)

    def sub(topic: str, *names: str) -> dict[str, argparse.ArgumentParser]:
        inner = top.add_parser(topic).add_subparsers(dest="verb", required=True)
        return {n: inner.add_parser(n) for n in names}

    index = sub("index", "sync", "status")
    index["sync"].add_argument("roots", nargs="*")
    index["sync"].add_argument("--rebuild", action="store_true")
    index["sync"].add_argument("--progress", choices=("off", "human", "ndjson"), default="off")
    schema = sub("schema", "list", "get")
    schema["get"].add_argument("relation")
    query = sub("query", "run")["run"]
    query.add_argument("sql", nargs="?")
    query.add_argument("--file")
    query.add_argument("--stdin", action="store_true")
    query.add_argument("--limit", type=int, default=runner.ROW_LIMIT)
    query.add_argument("--max-cell-bytes", type=int, default=runner.CELL_BYTES)
    query.add_argument("--max-output-bytes", type=int, default=runner.OUTPUT_BYTES)
    query.add_argument("--timeout", type=float, default=runner.TIMEOUT_S)
    record = sub("record", "inspect", "verify", "export")
    for r in record.values():
        r.add_argument("record_id", type=int)
    record["export"].add_argument("output")
    record["export"].add_argument("--force", action="store_true")
    asset = sub("asset", "extract")["extract"]
    asset.add_argument("reference")
    asset.add_argument("output")
    asset.add_argument("--force", action="store_true")
    meta = sub("metadata", "set", "get", "delete")
    for verb, m in meta.items():
        m.add_argument("runtime")
        m.add_argument("native_id")
        if verb == "set":
            m.add_argument("document")
        if verb != "get":
            m.add_argument("--expected-version", type=int)
    config = sub("config", "show", "init", "check")
    config["init"].add_argument("--force", action="store_true")
    docs = sub("docs", "list", "get", "search")
    docs["get"].add_argument("topic_name")
    docs["search"].add_argument("words")
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    """Runs a command; JSON on standard output, errors on standard error with exit status 1."""
    args = parser().parse_args(argv)
    settings = _settings(args)
    index, meta = settings["index"][0], settings["metadata"][0]
    try:
        print(json.dumps({"data": _run(args, settings, index, meta, spark)}, ensure_ascii=False, separators=(",", ":"), default=str))
        return 0
    except (ValueError, KeyError, OSError) as error:
        hint = getattr(error, "hint", None)
        print(f"error: {error}" + (f"\nhint: {hint}" if hint else ""), file=sys.stderr)
        return 1


def _reporter(kind: str):
    """What a sync calls with (phase, sources, seconds): nothing, a line to read, or a line of JSON on standard error."""
    if kind == "off":
        return None
    if kind == "human":
        return lambda phase, sources, seconds: print(f"{phase}: {sources} sources, {seconds:.1f} s", file=sys.stderr)
    return lambda phase, sources, seconds: print(json.dumps({"phase": phase, "sources": sources, "seconds": round(seconds, 3)}), file=sys.stderr)


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def _run(args, settings, index: str, meta: str, spark):
    if args.topic == "docs":
        return _docs(args)
    if args.topic == "config" and args.verb == "init":
        body = json.dumps({name: v for name, (v, _) in settings.items()}, indent=2) + "\n"
        os.makedirs(os.path.dirname(_config_path()) or ".", exist_ok=True)
        return {"path": _config_path(), "bytes": evidence.write_private(_config_path(), body.encode(), args.force)}
    if args.topic == "config" and args.verb == "check":
        return _checked(settings)
    if args.topic == "config":
        return {name: {"value": v, "from": origin} for name, (v, origin) in settings.items()}
    if args.topic == "schema":
        if args.verb == "list":
            return list(views.PUBLIC)
        if args.relation not in views.PUBLIC:
            raise KeyError(f"no relation {args.relation}")
        return [{"name": n, "type": t, "nullable": o} for n, t, o in views.PUBLIC[args.relation]]
    if args.topic == "metadata":
        if args.verb == "get":
            return metadata.get(meta, args.runtime, args.native_id)
        change = (meta, args.runtime, args.native_id)
        return {"version": metadata.put(*change, args.document, args.expected_version) if args.verb == "set" else metadata.delete(*change, args.expected_version)}
    spark = spark or _session()
    if args.topic == "index" and args.verb == "sync":
        return store.sync(spark, index, args.roots or settings["roots"][0], args.rebuild, progress=_reporter(args.progress))
    views.register(spark, index, meta)
    if args.topic == "index":
        return views.status(spark, index)
    if args.topic == "query":
        sql = sys.stdin.read() if args.stdin else open(args.file, encoding="utf-8").read() if args.file else args.sql or ""
        return json.loads(runner.run(spark, sql, set(views.PUBLIC), args.limit, args.max_cell_bytes, args.max_output_bytes, args.timeout).as_json())["data"]
    if args.topic == "asset":
        number, pointer = evidence.parse_reference(args.reference)
        media, data = evidence.asset(evidence.locate(spark, number), pointer)
        return {"media_type": media, "bytes": evidence.write_private(args.output, data, args.force), "output": args.output}
    record = evidence.locate(spark, args.record_id)
    if args.verb == "verify":
        return {"record_id": args.record_id, "status": evidence.verify(record)}
    if args.verb == "export":
        return {"bytes": evidence.write_private(args.output, evidence.exact_bytes(record), args.force), "output": args.output}
    return evidence.inspect(record)


if __name__ == "__main__":
    sys.exit(main())
