"""Runs the projector of a source over its records."""

from __future__ import annotations

from collections.abc import Iterable

from runledger.sources.antigravity import Antigravity
from runledger.sources.claude import Claude
from runledger.sources.codex import Codex
from runledger.sources.framing import Record
from runledger.sources.model import Fold, Session
from runledger.sources.pi import Pi

PROJECTORS: dict[str, type[Fold]] = {c.runtime: c for c in (Codex, Claude, Pi, Antigravity)}


def project(runtime: str, path: str, records: Iterable[Record]) -> Session:
    """The session of a source's well-formed records, in their order."""
    fold = PROJECTORS[runtime](path)
    for record in records:
        if record.value is not None:
            fold.push(record.position, record.value)
    return fold.finish()
