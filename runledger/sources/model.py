"""What a projector makes of one source: a session, its loops and items, in the public vocabulary."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field
from typing import Any

from runledger.functions.blake3 import blake3_all
from runledger.functions.classify import strength

MOST_TEXT_BYTES = 64 << 10

# How fine roles appear in public, with the category of instructions and contexts. Lifecycle items don't appear.
PUBLIC = {
    "runtime.project_instructions": ("runtime.instructions", "project"),
    "runtime.user_instructions": ("runtime.instructions", "user"),
    "runtime.skill_instructions": ("runtime.instructions", "skill"),
    "runtime.permissions": ("runtime.instructions", "permissions"),
    "runtime.collab_mode": ("runtime.instructions", "collaboration"),
    "runtime.personality": ("runtime.instructions", "personality"),
    "runtime.tool_catalog": ("runtime.instructions", "tools"),
    "runtime.memory": ("runtime.context", "memory"),
    "runtime.env_context": ("runtime.context", "environment"),
    "runtime.ide_context": ("runtime.context", "ide"),
    "runtime.file_context": ("runtime.context", "file"),
    "runtime.image_attachment": ("runtime.context", "image"),
    "runtime.internal_context": ("runtime.context", None),
    "runtime.session_reference": ("runtime.context", None),
    "runtime.plugins": ("runtime.context", None),
    "runtime.apps": ("runtime.context", None),
    "runtime.abort_notice": ("runtime.notice", None),
    "runtime.hook_output": ("runtime.notice", None),
    "runtime.budget": ("runtime.notice", None),
    "runtime.file_change": ("runtime.notice", None),
    "runtime.slash_command": ("runtime.state", None),
    "runtime.bash_command": ("runtime.state", None),
}
# The public roles.
ROLES = (
    "human.request", "human.steering", "agent.commentary", "agent.final_answer", "agent.reasoning", "agent.tool_call",
    "agent.tool_call.shell", "agent.delegation", "tool.output", "subagent.activity", "subagent.report", "runtime.instructions",
    "runtime.context", "runtime.state", "runtime.notice", "runtime.compaction_summary", "runtime.unknown",
)
LIFECYCLE = "runtime.lifecycle"


def bounded(text: str, most: int = MOST_TEXT_BYTES) -> dict[str, Any]:
    """The blob of one text."""
    return bounded_all([text], most)[0]


def bounded_all(texts: list[str], most: int = MOST_TEXT_BYTES) -> list[dict[str, Any]]:
    """Blobs: the longest prefix of whole characters, size, token estimate, and the hash of the whole text as identity."""
    encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
    out = []
    for text, data, name in zip(texts, encoded, blake3_all(encoded), strict=True):
        others = 0 if text.isascii() else sum(c > "\x7f" for c in text)
        prefix = text if len(data) <= most else data[:most].decode("utf-8", "ignore")
        out.append({"blob_hash": name, "text": prefix, "full_bytes": len(data), "estimated_tokens": math.ceil((len(text) - others) / 4) + others})
    return out


@dataclass
class Item:
    """An item while it is being built; `loop` is the place of its loop in the session, or None."""

    seq: int
    role: str
    basis: str
    ts_ms: int | None = None
    text: str | None = None
    records: list[int] = field(default_factory=list)
    loop: int | None = None
    value: dict[str, Any] = field(default_factory=dict)
    call_key: str | None = None
    answers: str | None = None
    child: tuple[str, str] | None = None
    searchable: bool | None = None

    def __post_init__(self):
        self.records = self.records or [self.seq]


@dataclass
class Loop:
    start: int
    native_id: str | None = None
    last: int = 0
    ts_ms: int | None = None
    end: int | None = None
    outcome: str | None = None
    model: dict[str, Any] = field(default_factory=dict)
    usage: dict[str, int] | None = None


@dataclass
class Session:
    """The facts of a source; `confirmed` once its identity is known."""

    runtime: str
    native_id: str | None = None
    identity: int | None = None
    created_at: int | None = None
    name: str | None = None
    working_directory: str | None = None
    parents: dict[str, tuple[str | None, str | None, int]] = field(default_factory=dict)  # kind: native id or locator, record
    loops: list[Loop] = field(default_factory=list)
    items: list[Item] = field(default_factory=list)

    @property
    def confirmed(self) -> bool:
        return self.native_id is not None


def usage(input_: Any, cached: Any, cache_write: Any, output: Any, reasoning: Any, includes_cache: bool) -> dict[str, int] | None:
    """Normalised usage, or None unless input and output are known. Parts that exceed their total are left out."""
    whole = lambda x: x if isinstance(x, int) and not isinstance(x, bool) and x >= 0 else None
    input_, cached, cache_write, output, reasoning = map(whole, (input_, cached, cache_write, output, reasoning))
    if input_ is None or output is None:
        return None
    total = input_ if includes_cache else input_ + (cached or 0) + (cache_write or 0)
    out = {"input": total, "cached": cached, "cache_write": cache_write, "output": output, "reasoning": reasoning}
    if (cached or 0) + (cache_write or 0) > total:
        out["cached"] = out["cache_write"] = None
    if (reasoning or 0) > output:
        out["reasoning"] = None
    return out


def add_usage(a: dict | None, b: dict) -> dict:
    """Sums of two usages; an unknown part of either makes the sum's part unknown."""
    return dict(b) if a is None else {k: a[k] + b[k] if a[k] is not None and b[k] is not None else None for k in b}


class UsageLedger:
    """The last snapshot of each response counts, for the loop in which it was first seen; snapshots without an id add up."""

    def __init__(self):
        self.first: dict[Any, int] = {}
        self.last: dict[Any, dict] = {}

    def observe(self, key: str | None, loop: int | None, value: dict | None) -> None:
        key = key if key is not None else object()
        if loop is not None:
            self.first.setdefault(key, loop)
        if value is not None and key in self.first:
            self.last[key] = value

    def totals(self) -> dict[int, dict]:
        out: dict[int, dict] = {}
        for key, value in self.last.items():
            out[self.first[key]] = add_usage(out.get(self.first[key]), value)
        return out


def public_semantic(item: Item) -> dict[str, Any] | None:
    """{role, value, evidence_strength, searchable}; None for lifecycle items. Unknown members are left out."""
    if item.role == LIFECYCLE:
        return None
    role, category = PUBLIC.get(item.role, (item.role, None))
    value = {k: v for k, v in item.value.items() if v is not None}
    if role == "agent.tool_call" and value.get("shell_fragments"):
        role = "agent.tool_call.shell"
    if role not in ROLES:
        role = "runtime.unknown"
    if role in ("runtime.instructions", "runtime.context") and category:
        value["category"] = category
    if role == "agent.reasoning":
        value.setdefault("representation", "unavailable" if not item.text else "full")
    if role in ("human.request", "human.steering", "agent.commentary", "agent.final_answer", "agent.delegation", "subagent.activity", "subagent.report", "runtime.context", "runtime.state", "runtime.notice", "runtime.unknown"):
        value.setdefault("has_images", False)
    searchable = item.searchable if item.searchable is not None else item.role.split(".")[0] in ("human", "agent")
    return {"role": role, "value": value, "evidence_strength": strength(item.basis), "searchable": bool(searchable and item.text)}


def publish(session: Session, most_text: int = MOST_TEXT_BYTES) -> dict[str, list[dict]]:
    """Rows of a finished session, with places in the source instead of ids: sessions, loops, items and blobs.

    Positions are dense and skip what doesn't appear. Outputs point at the last call of the same key; blobs are one for each
    complete text.
    """
    return publish_all([session], most_text)[0]


def publish_all(sessions: list[Session], most_text: int = MOST_TEXT_BYTES) -> list[dict[str, list[dict]]]:
    """`publish` of each session; the texts of all are hashed together, which costs short ones much less."""
    texts = [list(dict.fromkeys(i.text for i in s.items if i.text and i.role != LIFECYCLE)) for s in sessions]
    blobs = iter(bounded_all([t for own in texts for t in own], most_text))
    return [_published(s, {t: next(blobs) for t in own}) for s, own in zip(sessions, texts, strict=True)]


def _published(session: Session, by_text: dict[str, dict[str, Any]]) -> dict[str, list[dict]]:
    calls = {i.call_key: n for n, i in enumerate(session.items) if i.call_key and i.role in ("agent.tool_call", "agent.delegation")}
    items, positions = [], {}
    for n, item in enumerate(session.items):
        semantic = public_semantic(item)
        if semantic is None:
            continue
        if item.text:
            blob = by_text[item.text]
            semantic["value"]["summary" if semantic["role"] == "runtime.compaction_summary" else "text"] = {"blob_hash": blob["blob_hash"]}
        position = None
        if item.loop is not None:
            position = positions[item.loop] = positions.get(item.loop, -1) + 1
        items.append(
            {
                "ordinal": n, "loop": item.loop, "loop_position": position, "occurred_at": item.ts_ms, "records": sorted(set(item.records)), "role": semantic["role"],
                "evidence_strength": semantic["evidence_strength"], "searchable": semantic["searchable"], "value": json.dumps(semantic["value"], ensure_ascii=False),
                "tool_name": semantic["value"].get("tool_name"), "blob_hash": blob["blob_hash"] if item.text else None,
                "call_ordinal": calls.get(item.answers) if item.answers else None, "child_native_id": item.child[1] if item.child else None, "child_kind": item.child[0] if item.child else None,
            }
        )
    loops = [
        {
            "ordinal": n, "native_id": x.native_id, "start": x.start, "end": x.end, "outcome": x.outcome if x.end is not None else None, "started_at": x.ts_ms,
            "model": json.dumps({k: v for k, v in x.model.items() if v is not None}) if x.model.get("id") else None,
            "usage": json.dumps({k: v for k, v in x.usage.items() if v is not None}) if x.usage else None,
        }
        for n, x in enumerate(session.loops)
    ]
    facts = {
        "runtime": session.runtime, "native_id": session.native_id, "identity": session.identity, "created_at": session.created_at, "name": session.name, "working_directory": session.working_directory,
        "parents": [{"kind": k, "native_id": a, "locator": b, "record": r} for k, (a, b, r) in session.parents.items()],
    }
    return {"sessions": [facts], "loops": loops, "items": items, "blobs": list(by_text.values())}


class Fold:
    """What the projectors share: a session in the making, with a current loop."""

    runtime = ""

    def __init__(self, path: str = ""):
        self.path = path
        self.session = Session(self.runtime)
        self.current: int | None = None
        self.ledger = UsageLedger()
        self.by_loop: dict[int | None, list[Item]] = {}  # the session's items in order, by loop
        self.by_call: dict[str, list[Item]] = {}  # and by the native id of a call

    @property
    def loop(self) -> Loop | None:
        return self.session.loops[self.current] if self.current is not None else None

    def open_loop(self, seq: int, native_id: str | None = None, ts_ms: int | None = None) -> Loop:
        self.session.loops.append(Loop(seq, native_id, seq, ts_ms))
        self.current = len(self.session.loops) - 1
        return self.session.loops[-1]

    def add(self, seq: int, role: str, basis: str, ts_ms: int | None = None, text: str | None = None, loop: int | None | str = "current", **more: Any) -> Item:
        value = {k: more.pop(k) for k in list(more) if k not in Item.__dataclass_fields__}
        item = Item(seq, role, basis, ts_ms, text or None, loop=self.current if loop == "current" else loop, value=value, **more)
        self.session.items.append(item)
        self.by_loop.setdefault(item.loop, []).append(item)
        if item.call_key:
            self.by_call.setdefault(item.call_key, []).append(item)
        if item.loop is not None:
            own = self.session.loops[item.loop]
            own.last = max(own.last, seq)
        return item

    def push(self, seq: int, value: dict) -> None:
        raise NotImplementedError

    def finish(self) -> Session:
        for at, value in self.ledger.totals().items():
            self.session.loops[at].usage = value
        return self.session


def text_at(value: Any, *path: str) -> str | None:
    """The string at a path of members, or None."""
    for name in path:
        value = value.get(name) if isinstance(value, dict) else None
    return value if isinstance(value, str) and value else None


def member(value: Any, *path: str) -> Any:
    for name in path:
        value = value.get(name) if isinstance(value, dict) else None
    return value
