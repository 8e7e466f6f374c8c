"""Projector of tree-shaped traces with typed messages; a human message opens a loop unless one is running."""

from __future__ import annotations

import re
from typing import Any

from runledger.functions.classify import EXTENSION_TYPES
from runledger.functions.times import instant_ms
from runledger.sources.model import Fold, member, text_at, usage
from runledger.sources.shell import declared_command, parse_shell

# Stop reasons that end a loop.
OUTCOMES = {"stop": "completed", "aborted": "interrupted", "error": "failed", "length": "failed"}
_SKILL = re.compile(r"(?s)^\s*<skill\b[^>]*>.*?</skill>\s*")


def parts_of(content: Any) -> list[dict]:
    if isinstance(content, str):
        return [{"type": "text", "text": content}]
    return [p for p in content if isinstance(p, dict)] if isinstance(content, list) else []


def joined(parts: list[dict]) -> str:
    return "\n".join(p["text"] for p in parts if p.get("type") == "text" and isinstance(p.get("text"), str))


class Pi(Fold):
    runtime = "pi"

    def __init__(self, path: str = ""):
        super().__init__(path)
        self.running = False
        self.pending: dict[str, Any] = {}

    def push(self, seq: int, value: dict) -> None:
        ts = instant_ms(value.get("timestamp"))
        handler = getattr(self, f"on_{value.get('type')}", None)
        if handler:
            handler(seq, value, ts)

    def on_session(self, seq: int, value: dict, ts: int | None) -> None:
        s = self.session
        if s.confirmed:
            return
        s.native_id, s.identity, s.created_at, s.working_directory = text_at(value, "id"), seq, ts, text_at(value, "cwd")
        if parent := text_at(value, "parentSession"):
            s.parents["forked_from"] = (None, parent, seq)

    def on_session_info(self, seq: int, value: dict, ts: int | None) -> None:
        if name := text_at(value, "name"):
            self.session.name = name

    def settings(self, **given: Any) -> None:
        known = {k: v for k, v in given.items() if v is not None}
        self.pending |= known
        if self.loop is not None and self.running:
            self.loop.model |= known

    def on_model_change(self, seq: int, value: dict, ts: int | None) -> None:
        self.settings(id=text_at(value, "modelId"))

    def on_thinking_level_change(self, seq: int, value: dict, ts: int | None) -> None:
        self.settings(effort=text_at(value, "thinkingLevel"))

    def on_message(self, seq: int, value: dict, ts: int | None) -> None:
        message = value.get("message") if isinstance(value.get("message"), dict) else {}
        role, parts = message.get("role"), parts_of(message.get("content"))
        if role == "user":
            self.human(seq, ts, joined(parts), any(p.get("type") == "image" for p in parts))
        elif role == "assistant":
            self.answer(seq, ts, message, parts, text_at(value, "id"))
        elif role == "toolResult":
            failed, took = message.get("isError"), message.get("durationMs")
            cut = member(message, "details", "truncation", "truncated")
            self.add(
                seq, "tool.output", "record_kind", ts, joined(parts), answers=text_at(message, "toolCallId"), searchable=False,
                failed=failed if isinstance(failed, bool) else None, duration_ms=took if isinstance(took, int) else None, runtime_truncated=cut if isinstance(cut, bool) else None,
            )
        elif role == "system":
            self.system_prompt(seq, ts, message)

    def human(self, seq: int, ts: int | None, text: str, images: bool) -> None:
        skill = _SKILL.match(text)
        opens = not self.running
        if opens:
            self.open_loop(seq, None, ts).model |= self.pending
            self.running = True
        if skill:
            self.add(seq, "runtime.skill_instructions", "tag_prefix", ts, skill[0].strip())
            text = text[skill.end() :]
        if text.strip() or images or not skill:
            self.add(seq, "human.request" if opens else "human.steering", f"record_kind+{'first_in_loop' if opens else 'subsequent_in_loop'}", ts, text, has_images=images)

    def answer(self, seq: int, ts: int | None, message: dict, parts: list[dict], key: str | None) -> None:
        stop = text_at(message, "stopReason")
        last_text = max((i for i, p in enumerate(parts) if p.get("type") == "text"), default=None)
        for i, part in enumerate(parts):
            kind = part.get("type")
            if kind == "text" and part.get("text"):
                final = stop in OUTCOMES and OUTCOMES[stop] == "completed" and i == last_text
                self.add(seq, "agent.final_answer" if final else "agent.commentary", "stop_reason_end_loop" if final else "stop_reason_continues", ts, part["text"])
            elif kind == "thinking":
                self.add(seq, "agent.reasoning", "block_type", ts, text_at(part, "thinking"), representation="full" if part.get("thinking") else "unavailable")
            elif kind == "toolCall":
                given, name = part.get("arguments"), text_at(part, "name")
                item = self.add(seq, "agent.tool_call", "block_type", ts, None, tool_name=name, arguments=given, call_key=text_at(part, "id"))
                if declared := declared_command(name, given):
                    item.value["shell_fragments"] = parse_shell(*declared)
        u = message.get("usage")
        self.ledger.observe(None, self.current, usage(member(u, "input"), member(u, "cacheRead"), member(u, "cacheWrite"), member(u, "output"), member(u, "reasoning"), False))
        if self.loop is not None:
            if model := text_at(message, "model"):
                self.loop.model["id"] = model
            if level := text_at(message, "thinkingLevel"):
                self.loop.model["effort"] = level
            if stop in OUTCOMES:
                self.loop.end, self.loop.outcome, self.running = seq, OUTCOMES[stop], False

    def system_prompt(self, seq: int, ts: int | None, value: dict) -> None:
        """Sections and tools of a system prompt, each an instruction."""
        text = joined(parts_of(value.get("content")))
        if text:
            self.add(seq, "runtime.instructions", "wire_role_system", ts, text, loop=None)
        for section in value.get("sections") or []:
            if body := text_at(section, "text") or text_at(section, "content"):
                self.add(seq, "runtime.instructions", "native_subtype", ts, body, loop=None)
        for tool in value.get("tools") or []:
            if name := text_at(tool, "name"):
                self.add(seq, "runtime.tool_catalog", "native_subtype", ts, "\n".join(x for x in (name, text_at(tool, "description")) if x), loop=None)

    def on_custom_message(self, seq: int, value: dict, ts: int | None) -> None:
        declared = text_at(value, "customType") or ""
        role, basis = (EXTENSION_TYPES[declared], "native_subtype") if declared in EXTENSION_TYPES else ("runtime.unknown", "record_kind")
        parts = parts_of(value.get("content"))
        self.add(seq, role, basis, ts, joined(parts), has_images=any(p.get("type") == "image" for p in parts), searchable=False)

    def on_context_edit(self, seq: int, value: dict, ts: int | None) -> None:
        text = value.get("replacement") if isinstance(value.get("replacement"), str) else joined(parts_of(member(value, "replacement", "content")))
        self.add(seq, "runtime.state", "record_kind", ts, text, searchable=False)

    def on_compaction(self, seq: int, value: dict, ts: int | None) -> None:
        if summary := text_at(value, "summary"):
            self.add(seq, "runtime.compaction_summary", "record_kind", ts, summary)
        if isinstance(value.get("systemMessage"), dict):
            self.system_prompt(seq, ts, value["systemMessage"])

    on_branch_summary = on_compaction
