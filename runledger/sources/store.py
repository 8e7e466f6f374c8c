"""The index: immutable Parquet generations and a manifest that names the generation of each source.

A sync reads changed sources only, in parallel on the executors, and writes their rows as a new generation. The manifest is
replaced at the end, so readers see all of a sync or nothing, and a reader that has pinned a manifest keeps its snapshot.
A source that fails keeps its last generation. Ids follow the place of a row: source_id * 2**32 + place.
"""

from __future__ import annotations

import glob
import json
import os
import re
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runledger import ship
from runledger.functions.blake3 import blake3_all, blake3_hex
from runledger.functions.times import instant_ms
from runledger.operators import search
from runledger.sources import framing
from runledger.sources.model import MOST_TEXT_BYTES, publish
from runledger.sources.project import PROJECTORS, project

FORMAT = 2
SCHEMAS = {
    "records": "source_id long, source_position long, start long, end long, fingerprint string, occurred_at long, native_type string, status string",
    "sessions": "source_id long, runtime string, native_id string, identity long, created_at long, name string, working_directory string, parents array<struct<kind:string,native_id:string,locator:string,record:long>>",
    "loops": "source_id long, ordinal long, native_id string, start long, end long, outcome string, started_at long, model string, usage string",
    "items": "source_id long, ordinal long, loop long, loop_position long, occurred_at long, records array<long>, role string, evidence_strength string, searchable boolean, value string, tool_name string, blob_hash string, call_ordinal long, child_native_id string, child_kind string",
    "blobs": "source_id long, blob_hash string, text string, full_bytes long, estimated_tokens long",
}
#: What searches read, derived from the items and texts of a generation.
POSTINGS = {
    "item_grams": "gram string, item_id long, source_id long",
    "item_terms": "term string, item_id long, item_terms int, positions array<int>, source_id long",
    "item_term_counts": "item_id long, item_terms int, source_id long",
}
_OUT = "source_id long, relation string, body string, error string"


class PolicyError(ValueError):
    """The index was made with other limits."""


@dataclass
class Manifest:
    """One published state."""

    number: int = 0
    policy: dict[str, int] = field(default_factory=dict)
    sources: dict[str, dict[str, Any]] = field(default_factory=dict)  # by locator

    def as_json(self) -> str:
        return json.dumps({"format": FORMAT, "number": self.number, "policy": self.policy, "sources": self.sources}, ensure_ascii=False, sort_keys=True)


def load(index: str) -> Manifest:
    """The newest manifest of an index folder; an empty one where there is none."""
    names = glob.glob(os.path.join(glob.escape(index), "manifest-*.json"))
    if not names:
        return Manifest()
    with open(max(names, key=lambda n: int(n.rpartition("-")[2].removesuffix(".json"))), encoding="utf-8") as f:
        body = json.load(f)
    if body["format"] != FORMAT:
        raise PolicyError(f"the index has format {body['format']}, not {FORMAT}")
    return Manifest(body["number"], body["policy"], body["sources"])


def _commit(index: str, manifest: Manifest) -> None:
    manifest.number += 1
    at = os.path.join(index, f"manifest-{manifest.number}.json")
    part = os.path.join(index, f".part-{uuid.uuid4().hex}")
    with open(part, "w", encoding="utf-8") as f:
        f.write(manifest.as_json())
    os.chmod(part, 0o600)
    os.replace(part, at)


def _rows(batches: Iterator, limits: dict[str, int]) -> Iterator:
    """For each file (source_id, path, runtime, complete length, content): its rows as JSON, or an error."""
    import pandas as pd

    for batch in batches:
        for row in batch.itertuples(index=False):
            out = []
            try:
                data = framing.decode(row.path, bytes(row.content))[: row.length]
                records = list(framing.frame(data, limits["record_bytes"]))
                session = project(row.runtime, row.path, records)
                if not session.confirmed:
                    raise LookupError("the trace doesn't say which session it belongs to")
                for r, name in zip(records, blake3_all([r.data for r in records]), strict=True):
                    body = {"source_position": r.position, "start": r.start, "end": r.end, "fingerprint": name, "status": r.status}
                    body |= {"occurred_at": instant_ms((r.value or {}).get("timestamp") or (r.value or {}).get("created_at")), "native_type": framing.native_type(row.runtime, r.value)}
                    out.append(("records", json.dumps(body, ensure_ascii=False), None))
                for relation, bodies in publish(session, limits["text_bytes"]).items():
                    out += [(relation, json.dumps(b, ensure_ascii=False), None) for b in bodies]
            except LookupError as error:
                out = [("skipped", None, str(error))]
            except Exception as error:  # one source's failure doesn't stop the others
                out = [("failed", None, f"{type(error).__name__}: {error}"[:500])]
            for at in range(0, len(out), 5000):
                yield pd.DataFrame([(row.source_id, *o) for o in out[at : at + 5000]], columns=["source_id", "relation", "body", "error"])


def sync(spark: SparkSession, index: str, roots: list[str], rebuild: bool = False, record_bytes: int = framing.MOST_RECORD_BYTES, text_bytes: int = MOST_TEXT_BYTES, progress: Callable[[str, int, float], None] | None = None) -> list[dict[str, Any]]:
    """Brings an index up to date; returns a row (locator, action, error) for each source.

    Actions are indexed, appended, rebuilt, unchanged, skipped and failed. The limits can't change while sources exist.
    """
    began = time.monotonic()
    tell = progress or (lambda phase, sources, seconds: None)
    os.makedirs(index, mode=0o700, exist_ok=True)
    manifest, limits = load(index), {"record_bytes": record_bytes, "text_bytes": text_bytes}
    if manifest.sources and manifest.policy != limits:
        raise PolicyError(f"the index was made with {manifest.policy}")
    manifest.policy = limits
    report, work, moved = [], [], {}
    ids = {c["source_id"] for c in manifest.sources.values()}
    by_stem = {_stem(p): p for p in manifest.sources}
    changed = []
    for path in framing.discover(roots):
        stat = os.stat(path)
        known_as = path if path in manifest.sources else by_stem.get(_stem(path))
        old = manifest.sources.get(known_as) if known_as else None
        if old and not rebuild and known_as == path and (old["file_size"], old["modified_ns"]) == (stat.st_size, stat.st_mtime_ns) and old["complete"]:
            report.append({"locator": path, "action": "unchanged", "error": None})
        else:
            changed.append((path, known_as, stat.st_size, stat.st_mtime_ns))
    found = _compare(spark, [(path, manifest.sources[known]["indexed_bytes"] if known else 0) for path, known, _, _ in changed])
    for path, known_as, size, modified in changed:
        state, old = found.get(path, {"error": "no result"}), manifest.sources.get(known_as) if known_as else None
        if state["error"]:
            report.append({"locator": path, "action": "failed", "error": state["error"]})
            continue
        runtime, length = state["runtime"], state["length"]
        if runtime not in PROJECTORS or (path.endswith(".zst") and runtime != "codex"):
            report.append({"locator": path, "action": "skipped", "error": "not a known trace"})
            continue
        entry = {"runtime": runtime, "file_size": size, "modified_ns": modified, "indexed_bytes": length, "fingerprint": state["fingerprint"], "complete": state["complete"]}
        action = "indexed"
        if old:
            kept = old["runtime"] == runtime and length >= old["indexed_bytes"] and state["old_fingerprint"] == old["fingerprint"]
            if kept and length == old["indexed_bytes"] and not rebuild:
                manifest.sources.pop(known_as)
                manifest.sources[path] = old | entry
                moved[path] = True
                report.append({"locator": path, "action": "unchanged", "error": None})
                continue
            if not kept and known_as != path and not rebuild:
                report.append({"locator": path, "action": "skipped", "error": "the other encoding has other bytes; rebuild to accept it"})
                continue
            action = "rebuilt" if rebuild or not kept else "appended"
        source_id = old["source_id"] if old else max(ids, default=0) + 1
        ids.add(source_id)
        work.append((path, known_as, source_id, action, entry))
    tell("compared", len(work) + len(report), time.monotonic() - began)
    if work:
        generation = uuid.uuid4().hex
        outcome = _write(spark, index, generation, work, limits)
        for path, known_as, source_id, action, entry in work:
            relation, error = outcome.get(source_id, ("failed", "no result"))
            if error is None:
                if known_as:
                    manifest.sources.pop(known_as, None)
                manifest.sources[path] = entry | {"source_id": source_id, "generation": generation}
            report.append({"locator": path, "action": action if error is None else relation, "error": error})
        tell("projected", len(work), time.monotonic() - began)
    if work or moved:
        _commit(index, manifest)
        tell("published", len(manifest.sources), time.monotonic() - began)
    return sorted(report, key=lambda r: r["locator"])


_STATE = "path string, error string, runtime string, length long, complete boolean, fingerprint string, old_fingerprint string"


def _files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(uri, content) of local trace files, read where tasks run."""
    literal = [re.sub(r"([\\{}\[\]*?,])", r"\\\1", p) for p in paths]  # file names aren't patterns
    uri = F.regexp_replace("path", "^file:/+", "file:/")
    return spark.read.format("binaryFile").load([f"file://{p}" for p in literal]).select(uri.alias("uri"), "content")


def _compare(spark: SparkSession, sources: list[tuple[str, int]]) -> dict[str, dict[str, Any]]:
    """What changed files hold, by path, found by tasks: runtime, complete bytes, and fingerprints of all and of the known prefix."""
    if not sources:
        return {}
    ship(spark)

    def look(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            rows = []
            for path, content, known in batch.itertuples(index=False):
                try:
                    data = framing.decode(path, bytes(content))
                    length = framing.complete_prefix(data)
                    first = next(framing.frame(data[: data.find(b"\n") + 1]), None)
                    whole, old = framing.prefix_fingerprint(data, length), framing.prefix_fingerprint(data, known) if known <= length else None
                    rows.append((path, None, framing.runtime_of(path, first.value if first else None), length, length == len(data), whole, old))
                except Exception as error:  # a damaged archive
                    rows.append((path, f"{type(error).__name__}: {error}"[:500], None, None, None, None, None))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _STATE.split(", ")])

    wanted = spark.createDataFrame([(f"file:{p}", p, n) for p, n in sources], "uri string, path string, known long")
    files = _files(spark, [p for p, _ in sources]).join(F.broadcast(wanted), "uri").select("path", "content", "known")
    return {r["path"]: r.asDict() for r in files.mapInPandas(look, _STATE).collect()}


def _stem(path: str) -> str:
    return path.removesuffix(".zst").replace("transcript_full.jsonl", "transcript.jsonl")


def _write(spark: SparkSession, index: str, generation: str, work: list[tuple], limits: dict[str, int]) -> dict[int, tuple[str, str | None]]:
    """Writes the rows of changed sources as one generation; (relation, error) by source id."""
    ship(spark)
    facts = spark.createDataFrame([(f"file:{p}", p, s, e["runtime"], e["indexed_bytes"]) for p, _, s, _, e in work], "uri string, locator string, source_id long, runtime string, length long")
    files = _files(spark, [p for p, *_ in work])
    joined = files.join(F.broadcast(facts), "uri").select("source_id", F.col("locator").alias("path"), "runtime", "length", "content")
    at = os.path.join(index, f"raw-{generation}")
    parallel = min(len(work), max(1, spark.sparkContext.defaultParallelism * 4))
    joined.repartition(parallel, "source_id").mapInPandas(lambda b: _rows(b, limits), _OUT).write.partitionBy("relation").parquet(f"file://{at}")
    raw = spark.read.schema(_OUT).parquet(f"file://{at}")
    for name, schema in SCHEMAS.items():
        shape = T.StructType([f for f in T._parse_datatype_string(schema).fields if f.name != "source_id"])
        rows = raw.where(F.col("relation") == name).select("source_id", F.from_json("body", shape).alias("r")).select("source_id", "r.*")
        rows.repartitionByRange(max(1, parallel // 4), "source_id").sortWithinPartitions("source_id").withColumn("generation", F.lit(generation)).write.option("compression", "zstd").parquet(f"file://{os.path.join(index, name, generation)}")
    _write_postings(spark, index, generation)
    problems = raw.where(F.col("relation").isin("skipped", "failed")).select("source_id", "relation", "error").collect()
    done: dict[int, tuple[str, str | None]] = {s: ("indexed", None) for _, _, s, _, _ in work}
    return done | {r["source_id"]: (r["relation"], r["error"]) for r in problems}


def _write_postings(spark: SparkSession, index: str, generation: str) -> None:
    """Postings of a generation's searchable items.

    They are dealt by ranges of (gram or term, item), so a frequent one spreads over tasks, and sorted, so that a search for a few
    prunes files and row groups by their bounds.
    """

    def stored(name: str) -> DataFrame:
        return spark.read.parquet(f"file://{os.path.join(index, name, generation)}")

    def write(name: str, rows: DataFrame, *order: str) -> None:
        rows = rows.withColumn("source_id", F.shiftright("item_id", 32)).withColumn("generation", F.lit(generation))
        at = os.path.join(index, name, generation)
        rows.repartitionByRange(*order).sortWithinPartitions(*order).write.option("compression", "zstd").parquet(f"file://{at}")

    places = stored("items").where("searchable AND blob_hash IS NOT NULL").select("source_id", "blob_hash", (F.shiftleft("source_id", 32) + F.col("ordinal")).alias("item_id"))
    texts = places.join(stored("blobs").select("source_id", "blob_hash", "text"), ["source_id", "blob_hash"]).select("item_id", "text")
    write("item_grams", search.gram_postings(texts), "gram", "item_id")
    write("item_terms", search.term_postings(texts.select("item_id", search.term_list(F.col("text")).alias("terms")), F.col("terms")), "term", "item_id")
    write("item_term_counts", stored("item_terms").groupBy("item_id").agg(F.first("item_terms").alias("item_terms")), "item_id")


def relation(spark: SparkSession, index: str, name: str, manifest: Manifest) -> DataFrame:
    """The rows of a relation that a manifest publishes.

    Only generations that are still named are read, and rows of replaced generations go by a join with the manifest.
    """
    live = spark.createDataFrame([(c["source_id"], c["generation"]) for c in manifest.sources.values()], "source_id long, generation string")
    paths = [f"file://{os.path.join(index, name, g)}" for g in sorted({c["generation"] for c in manifest.sources.values()})]
    schema = T._parse_datatype_string((SCHEMAS | POSTINGS)[name] + ", generation string")
    rows = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    return rows.join(F.broadcast(live), ["source_id", "generation"]).drop("generation")


def prune(index: str) -> list[str]:
    """Removes generations and manifests that the newest manifest doesn't name; returns what went."""
    import shutil

    manifest, gone = load(index), []
    live = {c["generation"] for c in manifest.sources.values()}
    for at in [*glob.glob(os.path.join(glob.escape(index), "raw-*")), *(p for n in SCHEMAS | POSTINGS for p in glob.glob(os.path.join(glob.escape(index), n, "*")))]:
        if at.rpartition("/")[2] not in live:
            shutil.rmtree(at)
            gone.append(at)
    for at in glob.glob(os.path.join(glob.escape(index), "manifest-*.json")):
        if not at.endswith(f"-{manifest.number}.json"):
            os.remove(at)
    return gone


def content_id(value: str) -> int:
    """A positive 63-bit id of a text."""
    return int(blake3_hex(value.encode())[:16], 16) >> 1
