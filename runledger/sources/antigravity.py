"""Projector of transcripts by step: an explicit user input opens a loop, which has no declared end."""

from __future__ import annotations

from runledger.functions.classify import injection
from runledger.functions.times import instant_ms
from runledger.sources.framing import conversation_id
from runledger.sources.model import Fold, text_at
from runledger.sources.shell import declared_command, parse_shell


class Antigravity(Fold):
    runtime = "antigravity"

    def push(self, seq: int, value: dict) -> None:
        s, ts = self.session, instant_ms(value.get("created_at"))
        if not s.confirmed and (native := conversation_id(self.path)):
            s.native_id, s.identity, s.created_at = native, seq, ts
        kind, source, text = text_at(value, "type"), text_at(value, "source"), text_at(value, "content")
        images = any(str((m or {}).get("mime_type", "")).startswith("image/") for m in value.get("media") or [] if isinstance(m, dict))
        if kind == "USER_INPUT" and source in ("USER_EXPLICIT", "USER", None):
            self.open_loop(seq, None, ts)
            self.add(seq, "human.request", "origin_kind+first_in_loop", ts, text, has_images=images)
        elif kind == "PLANNER_RESPONSE":
            if model := text_at(value, "model"):
                if self.loop is not None:
                    self.loop.model["id"] = model
            if thinking := text_at(value, "thinking"):
                self.add(seq, "agent.reasoning", "record_kind", ts, thinking, representation="full")
            if text:
                self.add(seq, "agent.commentary", "record_kind", ts, text, has_images=images)
            for n, call in enumerate(c for c in value.get("tool_calls") or [] if isinstance(c, dict)):
                name, given = text_at(call, "name"), call.get("args")
                item = self.add(seq, "agent.tool_call", "block_type", ts, None, tool_name=name, arguments=given, call_key=f"{seq}/{n}")
                if isinstance(given, dict):
                    item.value["working_directory"] = text_at(given, "Cwd") or text_at(given, "cwd")
                if declared := declared_command(name, given):
                    item.value["shell_fragments"] = parse_shell(*declared)
        elif text and source == "SYSTEM":
            role, basis = injection(text)
            self.add(seq, role, basis, ts, text, has_images=images, searchable=False)
        elif text:
            self.add(seq, "tool.output", "record_kind", ts, text, searchable=False)
