"""Records as evidence: inspection with bounded output, verification, exact export, and embedded assets."""

from __future__ import annotations

import base64
import json
import os
import re
from dataclasses import dataclass
from typing import Any

from runledger.functions.blake3 import blake3_hex
from runledger.sources import framing

MOST_VALUE_BYTES, MOST_OUTPUT_BYTES, MOST_ASSET_BYTES = 2048, 65_536, 32 << 20
_DATA = re.compile(r"^data:([^;,]*)((?:;[^;,]*)*?)(;base64)?,(.*)$", re.S)


@dataclass
class Located:
    """What the index knows of one record."""

    record_id: int
    locator: str
    start: int
    end: int
    fingerprint: str


def locate(spark, record_id: int) -> Located:
    """Looks a record up in the registered views."""
    row = spark.sql(f"SELECT r.content_range, r.fingerprint, s.locator FROM records r JOIN sources s USING (source_id) WHERE r.record_id = {int(record_id)}").first()
    if row is None:
        raise KeyError(f"no record {record_id}")
    span = json.loads(row["content_range"])
    return Located(record_id, row["locator"], span["start"], span["end"], row["fingerprint"])


def verify(record: Located) -> str:
    """verified, source_missing, source_short or hash_mismatch: a result, not an error."""
    if not os.path.exists(record.locator):
        return "source_missing"
    try:
        data = framing.read_at(record.locator, record.start, record.end)
    except Exception:  # a damaged archive can't be read up to the record
        return "source_short"
    if data is None:
        return "source_short"
    return "verified" if blake3_hex(data) == record.fingerprint else "hash_mismatch"


def exact_bytes(record: Located, most: int = framing.MOST_RECORD_BYTES) -> bytes:
    """The record's own bytes; ValueError unless they verify."""
    if record.end - record.start > most:
        raise ValueError(f"the record has {record.end - record.start} bytes, more than {most}")
    if (state := verify(record)) != "verified":
        raise ValueError(state)
    return framing.read_at(record.locator, record.start, record.end)


def write_private(path: str, data: bytes, force: bool = False) -> int:
    """Writes a file that only its owner can read; an existing one is replaced only by force."""
    flags = os.O_WRONLY | os.O_CREAT | (os.O_TRUNC if force else os.O_EXCL)
    with os.fdopen(os.open(path, flags, 0o600), "wb") as f:
        f.write(data)
    os.chmod(path, 0o600)
    return len(data)


def _child(pointer: str, name: str | int) -> str:
    return f"{pointer}/{str(name).replace('~', '~0').replace('/', '~1')}"


def displayed(value: Any, record_id: int, most: int = MOST_VALUE_BYTES, pointer: str = "") -> Any:
    """The value with data URIs and long texts replaced by references that `asset` and `at_pointer` follow."""
    if isinstance(value, dict):
        return {k: displayed(v, record_id, most, _child(pointer, k)) for k, v in value.items()}
    if isinstance(value, list):
        return [displayed(v, record_id, most, _child(pointer, i)) for i, v in enumerate(value)]
    if isinstance(value, str):
        size = len(value.encode("utf-8", "surrogatepass"))
        if m := _DATA.match(value):
            return {"$trace_ref": f"{record_id}#{pointer}", "kind": "asset", "media_type": m[1] or "text/plain", "bytes": size}
        if size > most:
            return {"$trace_ref": f"{record_id}#{pointer}", "kind": "text", "bytes": size, "preview": value[:200]}
    return value


def inspect(record: Located, most_value: int = MOST_VALUE_BYTES, most_output: int = MOST_OUTPUT_BYTES) -> dict[str, Any]:
    """The record for display; a body beyond the output budget is left out, with its size."""
    data = exact_bytes(record)
    try:
        body, malformed = displayed(json.loads(data), record.record_id, most_value), False
    except ValueError:
        body, malformed = data.decode("utf-8", "replace")[:most_value], True
    out = {"record_id": record.record_id, "locator": record.locator, "content_range": {"start": record.start, "end": record.end}, "malformed": malformed}
    size = len(json.dumps(body, ensure_ascii=False).encode("utf-8", "surrogatepass"))
    return out | ({"value": body} if size <= most_output else {"value": None, "omitted_bytes": size})


def at_pointer(value: Any, pointer: str) -> Any:
    """The member at a JSON pointer; KeyError if there is none."""
    for part in pointer.split("/")[1:]:
        name = part.replace("~1", "/").replace("~0", "~")
        if isinstance(value, list) and name.isdigit() and int(name) < len(value):
            value = value[int(name)]
        elif isinstance(value, dict) and name in value:
            value = value[name]
        else:
            raise KeyError(pointer)
    return value


def parse_reference(reference: str) -> tuple[int, str]:
    """(record, pointer) of `record#/pointer`."""
    number, found, pointer = reference.partition("#")
    if not found or not number.isdigit() or (pointer and not pointer.startswith("/")):
        raise ValueError("a reference is record#/json/pointer")
    return int(number), pointer


def asset(record: Located, pointer: str, most: int = MOST_ASSET_BYTES) -> tuple[str, bytes]:
    """(media type, bytes) of an inline data URI in base64."""
    value = at_pointer(json.loads(exact_bytes(record)), pointer)
    m = _DATA.match(value) if isinstance(value, str) else None
    if m is None or not m[3]:
        raise ValueError("not an inline asset in base64")
    if len(m[4]) * 3 // 4 > most + 2:
        raise ValueError(f"the asset is larger than {most} bytes")
    return m[1] or "text/plain", base64.b64decode(m[4], validate=True)
