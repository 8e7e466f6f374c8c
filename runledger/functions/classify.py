"""Purpose of texts that a runtime injected, by leading header, tag or opening words."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tags that runtimes write around injected texts, and the role of each.
TAGS = {
    "environment_context": "runtime.env_context",
    "environments_instructions": "runtime.env_context",
    "user_instructions": "runtime.user_instructions",
    "skills_instructions": "runtime.skill_instructions",
    "skill": "runtime.skill_instructions",
    "permissions": "runtime.permissions",
    "collaboration_mode": "runtime.collab_mode",
    "multi_agent_mode": "runtime.collab_mode",
    "realtime_conversation": "runtime.collab_mode",
    "realtime_delegation": "runtime.collab_mode",
    "plugins_instructions": "runtime.plugins",
    "recommended_plugins": "runtime.plugins",
    "apps_instructions": "runtime.apps",
    "personality_spec": "runtime.personality",
    "turn_aborted": "runtime.abort_notice",
    "model_switch": "runtime.notice",
    "codex_internal_context": "runtime.internal_context",
    "goal_context": "runtime.internal_context",
    "tools": "runtime.tool_catalog",
    "context_window": "runtime.budget",
    "context_window_guidance": "runtime.budget",
    "rollout_budget": "runtime.budget",
    "user_shell_command": "runtime.bash_command",
    "image": "runtime.image_attachment",
    "/image": "runtime.image_attachment",
    "subagent_notification": "subagent.report",
    "system-reminder": "runtime.notice",
    "command-name": "runtime.slash_command",
    "command-message": "runtime.slash_command",
    "command-args": "runtime.slash_command",
    "local-command-stdout": "runtime.slash_command",
    "local-command-stderr": "runtime.slash_command",
    "local-command-caveat": "runtime.slash_command",
    "bash-input": "runtime.bash_command",
    "bash-stdout": "runtime.bash_command",
    "bash-stderr": "runtime.bash_command",
    "user-prompt-submit-hook": "runtime.hook_output",
    "ide_selection": "runtime.ide_context",
    "task-notification": "subagent.report",
}
# Opening words without a tag.
PREFIXES = {
    "Approved command prefix saved:": "runtime.permissions",
    "Network rule saved:": "runtime.permissions",
    "You are an agent in a team of agents collaborating to complete a task.": "runtime.collab_mode",
    "You are `/root`, the primary agent in a team of agents": "runtime.collab_mode",
    "Generated images are saved to ": "runtime.notice",
    "Warning: apply_patch was requested via ": "runtime.notice",
    "Warning: The maximum number of unified exec processes you can keep open is": "runtime.notice",
    "Warning: Your account was flagged for potentially high-risk cyber activity": "runtime.notice",
}
# Leading headers.
HEADERS = {"# AGENTS.md instructions": "runtime.project_instructions", "## Memory": "runtime.memory"}
# Declared types of extension messages.
EXTENSION_TYPES = {
    "skill-recall": "runtime.skill_instructions",
    "pi-space-memory-recall": "runtime.memory",
    "lark-auth-check": "runtime.notice",
    "onboarding": "runtime.notice",
    "todo-context": "runtime.state",
    "subagent-notify": "subagent.report",
    "subagent_control_notice": "subagent.activity",
}
# Evidence terms that make a judgement heuristic.
HEURISTIC = {
    "prompt_source_sdk",
    "wire_role_user",
    "phase_fallback_task_complete",
    "phase_fallback_commentary",
    "tag_prefix",
    "markdown_header",
    "text_prefix",
    "no_marker",
}
_TAG = r"^<([A-Za-z0-9_:/-]+)(?:>|\s[^>]*>)"
UNKNOWN = "runtime.unknown"


def injection(text: str) -> tuple[str, str]:
    """(role, evidence) of an injected text."""
    body = text.lstrip()
    for start, role in HEADERS.items():
        if body.startswith(start):
            return role, "markdown_header"
    if tag := re.match(_TAG, body, re.A):
        return TAGS.get(tag[1], UNKNOWN), "tag_prefix"
    for start, role in PREFIXES.items():
        if body.startswith(start):
            return role, "text_prefix"
    return UNKNOWN, "no_marker"


def injection_column(text: Column) -> Column:
    """The role of `injection`, natively: prefixes by CASE, tags by a literal map."""
    body = F.ltrim(text)
    out = None
    for start, role in HEADERS.items():
        out = (F if out is None else out).when(body.startswith(start), F.lit(role))
    tags = F.create_map(*[F.lit(x) for pair in TAGS.items() for x in pair])
    tag = F.regexp_extract(body, _TAG, 1)
    out = out.when(tag != "", F.coalesce(F.element_at(tags, tag), F.lit(UNKNOWN)))
    for start, role in PREFIXES.items():
        out = out.when(body.startswith(start), F.lit(role))
    return out.otherwise(F.lit(UNKNOWN))


def strength(basis: str) -> str:
    """`heuristic` if one evidence term joined by `+` is heuristic, else `structural`."""
    return "heuristic" if HEURISTIC.intersection(basis.split("+")) else "structural"


def strength_column(basis: Column) -> Column:
    return F.when(F.exists(F.split(basis, "[+]"), lambda t: t.isin(*sorted(HEURISTIC))), F.lit("heuristic")).otherwise(F.lit("structural"))
