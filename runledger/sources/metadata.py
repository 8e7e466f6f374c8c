"""Caller-owned metadata of sessions: whole documents with versions, kept beside the index and not rebuilt with it."""

from __future__ import annotations

import contextlib
import fcntl
import json
import os
import time
from typing import Any

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "runtime string, native_id string, metadata string, version long, updated_at long"


class Conflict(ValueError):
    """The stored version isn't the expected one."""


@contextlib.contextmanager
def _locked(path: str):
    with open(f"{path}.lock", "w") as lock:
        fcntl.flock(lock, fcntl.LOCK_EX)
        entries: dict[str, Any] = {}
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                entries = json.load(f)
        yield entries
        part = f"{path}.part"
        with open(part, "w", encoding="utf-8") as f:
            json.dump(entries, f, ensure_ascii=False)
        os.chmod(part, 0o600)
        os.replace(part, path)


def _change(path: str, runtime: str, native_id: str, text: str | None, expected: int | None) -> int:
    with _locked(path) as entries:
        key = json.dumps([runtime, native_id])
        version = entries.get(key, {}).get("version", 0)
        if expected is not None and expected != version:
            raise Conflict(f"version {version} is stored, not {expected}")
        entries[key] = {"metadata": text, "version": version + 1, "updated_at": int(time.time() * 1000)}
        return version + 1


def put(path: str, runtime: str, native_id: str, text: str, expected: int | None = None) -> int:
    """Replaces a session's whole document; returns its version. The text is kept as it is; `null` is a document too."""
    json.loads(text)
    return _change(path, runtime, native_id, text, expected)


def delete(path: str, runtime: str, native_id: str, expected: int | None = None) -> int:
    """Removes the document; the version goes on, so a later expected version can't match by chance."""
    return _change(path, runtime, native_id, None, expected)


def get(path: str, runtime: str, native_id: str) -> dict[str, Any] | None:
    """{metadata, version, updated_at}; metadata is None after a removal; None if there never was a document."""
    if not os.path.exists(path):
        return None
    with open(path, encoding="utf-8") as f:
        return json.load(f).get(json.dumps([runtime, native_id]))


def table(spark: SparkSession, path: str | None) -> DataFrame:
    """All documents that exist."""
    rows = []
    if path and os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            rows = [(*json.loads(k), e["metadata"], e["version"], e["updated_at"]) for k, e in json.load(f).items() if e["metadata"] is not None]
    return spark.createDataFrame(rows, SCHEMA)
