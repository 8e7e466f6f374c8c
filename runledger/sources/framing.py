"""Trace files: discovery, byte framing into records, compressed inputs, positional reads."""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from runledger.functions.blake3 import blake3_hex

MOST_RECORD_BYTES = 16 << 20
_FULL = re.compile(r"^(?P<head>.*/)?transcript(?P<full>_full)?\.jsonl$")


def discover(roots: list[str]) -> list[str]:
    """All *.jsonl and *.jsonl.zst files below the roots, canonical and sorted.

    Symbolic links are skipped; a plain file hides its compressed sibling; of a short and a full transcript in one folder the
    full one counts.
    """
    found: set[str] = set()
    for root in roots:
        if os.path.islink(root):
            continue
        paths = [root] if os.path.isfile(root) else (os.path.join(d, n) for d, dirs, names in os.walk(root) for n in names)
        found.update(os.path.realpath(p) for p in paths if p.endswith((".jsonl", ".jsonl.zst")) and not os.path.islink(p))
    kept = {p for p in found if not (p.endswith(".zst") and p[:-4] in found)}
    return sorted(p for p in kept if not ((m := _FULL.match(p)) and not m["full"] and f"{m['head'] or ''}transcript_full.jsonl" in kept))


def read_source(path: str) -> bytes:
    """The decoded bytes of a trace file."""
    data = Path(path).read_bytes()
    return decode(path, data)


def decode(path: str, data: bytes) -> bytes:
    if not path.endswith(".zst"):
        return data
    import zstandard

    out = []
    while data:
        frame_ = zstandard.ZstdDecompressor().decompressobj()
        out.append(frame_.decompress(data))
        if not frame_.eof:
            raise ValueError("the archive ends inside a frame")
        data = frame_.unused_data
    return b"".join(out)


@dataclass
class Record:
    """One line without its end: bytes [start, end) of the decoded source."""

    position: int
    start: int
    end: int
    data: bytes
    status: str = "ok"
    value: dict | None = None

    @property
    def fingerprint(self) -> str:
        return blake3_hex(self.data)


def frame(data: bytes, most: int = MOST_RECORD_BYTES) -> Iterator[Record]:
    """Records ended by a line feed; a tail without one isn't a record. Carriage returns belong to the content.

    Records beyond `most` bytes are `oversized` and not parsed; those that aren't a JSON object are `malformed`.
    """
    start = position = 0
    while (end := data.find(b"\n", start)) >= 0:
        record = Record(position, start, end, data[start:end])
        if end - start > most:
            record.status = "oversized"
        else:
            try:
                value = json.loads(record.data.decode())
                record.value, record.status = (value, "ok") if isinstance(value, dict) else (None, "malformed")
            except ValueError:
                record.status = "malformed"
        yield record
        start, position = end + 1, position + 1


def complete_prefix(data: bytes) -> int:
    """Bytes up to and with the last line end."""
    return data.rfind(b"\n") + 1


def prefix_fingerprint(data: bytes, length: int) -> str:
    """Hash of a source's first `length` bytes, with the length in front."""
    return blake3_hex(struct.pack("<Q", length) + data[:length])


def read_at(path: str, start: int, end: int) -> bytes | None:
    """Decoded bytes [start, end), or None if the source ends before."""
    if not path.endswith(".zst"):
        with open(path, "rb") as f:
            f.seek(start)
            data = f.read(end - start)
    else:
        data = read_source(path)[start:end]
    return data if len(data) == end - start else None


# Record kinds by which a runtime's trace is told.
_CODEX = {"session_meta", "turn_context", "response_item", "event_msg", "compacted", "token_usage_record", "inter_agent_communication"}
_PI = {"session", "message", "model_change", "thinking_level_change", "compaction", "branch_summary", "custom_message", "custom", "session_info", "context_edit", "label"}
_CONVERSATION = re.compile(r"/([0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})/\.system_generated/logs/transcript(?:_full)?\.jsonl(?:\.zst)?$")


def conversation_id(path: str) -> str | None:
    """The conversation that a path names."""
    m = _CONVERSATION.search(path)
    return m[1].lower() if m else None


def runtime_of(path: str, first: dict | None) -> str | None:
    """The runtime that wrote a trace, by its first record and its path; None if unknown."""
    if first is None:
        return None
    kind = first.get("type")
    if "step_index" in first and conversation_id(path):
        return "antigravity"
    if kind in _CODEX and isinstance(first.get("payload"), dict):
        return "codex"
    if kind == "session" and "sessionId" not in first and "id" in first:
        return "pi"
    if "sessionId" in first or kind in {"summary", "file-history-snapshot", "queue-operation", "fork-context-ref", "started", "result"}:
        return "claude"
    return "pi" if kind in _PI and "id" in first else None


def native_type(runtime: str | None, value: dict | None) -> str | None:
    """The kind of a record as `kind/refinement`."""
    if value is None:
        return None
    kind = value.get("type")
    if not isinstance(kind, str):
        return None
    inner = {"codex": ("payload", "type"), "claude": ("message", "role"), "pi": ("message", "role")}.get(runtime or "")
    more = None
    if inner and isinstance(value.get(inner[0]), dict):
        more = value[inner[0]].get(inner[1])
    elif runtime == "claude":
        more = value.get("subtype") or (value.get("attachment") or {}).get("type") if isinstance(value.get("attachment") or {}, dict) else value.get("subtype")
    elif runtime == "antigravity":
        more = value.get("source")
    return f"{kind}/{more}" if isinstance(more, str) else kind
