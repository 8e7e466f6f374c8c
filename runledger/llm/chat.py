"""Chat formatting over typed content parts.

A visitor flattens the parts of each message in order: texts are escaped, and images, audio and documents become numbered
placeholders whose references and expanded token counts are recorded. A turn is `<turn>role`, a line end, the content and
`</turn>` with a line end. In texts a backslash is doubled and a control string gets a backslash in front, which reverses
without loss. Rows are dealt by conversation, sorted, and formatted in one pass that keeps a few counters, so a conversation
of any length takes little memory.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runledger.llm.common import in_python

OPEN, CLOSE, PART = "<turn>", "</turn>\n", "<part:"
_CONTROL = re.compile(r"\\|<(?=/?turn>|part:)")
_ESCAPED = re.compile(r"\\(.)", re.S)
#: Expanded tokens: of a square image tile of PATCH pixels, a second of audio, a page of a document.
PATCH, TILE_TOKENS, SECOND_TOKENS, PAGE_TOKENS = 28, 1, 25, 600

PART_TYPE = T.StructType([T.StructField("type", T.StringType()), T.StructField("text", T.StringType()), T.StructField("ref", T.StringType()), T.StructField("width", T.LongType()), T.StructField("height", T.LongType()), T.StructField("seconds", T.DoubleType()), T.StructField("pages", T.LongType())])
ATTACHMENT_TYPE = T.StructType([T.StructField("kind", T.StringType()), T.StructField("ordinal", T.LongType()), T.StructField("ref", T.StringType()), T.StructField("tokens", T.LongType())])
ATTACHMENTS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("ordinal", pa.int64()), ("ref", pa.string()), ("tokens", pa.int64())]))


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


@dataclass
class Visitor:
    """Flattens the parts of one conversation's messages; ordinals count by kind from 1."""

    ordinals: dict[str, int] = field(default_factory=dict)

    def content(self, parts: list[dict | None]) -> tuple[str, list[dict]]:
        out, attachments = [], []
        for part in parts:
            if part is not None:
                visit = getattr(self, f"visit_{part['type'] or 'text'}", self.visit_other)
                text, attachment = visit(part)
                out.append(text)
                if attachment:
                    attachments.append(attachment)
        return "".join(out), attachments

    def visit_text(self, part: dict) -> tuple[str, None]:
        return escape(part["text"] or ""), None

    def visit_image(self, part: dict) -> tuple[str, dict]:
        return self._placeholder("image", part, TILE_TOKENS * math.ceil((part["width"] or 0) / PATCH) * math.ceil((part["height"] or 0) / PATCH))

    def visit_audio(self, part: dict) -> tuple[str, dict]:
        return self._placeholder("audio", part, math.ceil((part["seconds"] or 0) * SECOND_TOKENS))

    def visit_document(self, part: dict) -> tuple[str, dict]:
        return self._placeholder("document", part, (part["pages"] or 0) * PAGE_TOKENS)

    def visit_other(self, part: dict) -> tuple[str, dict]:
        return self._placeholder("other", part, 0)

    def _placeholder(self, kind: str, part: dict, tokens: int) -> tuple[str, dict]:
        n = self.ordinals[kind] = self.ordinals.get(kind, 0) + 1
        return f"{PART}{kind}:{n}>", {"kind": kind, "ordinal": n, "ref": part["ref"], "tokens": tokens}


def text_part(text: F.Column) -> F.Column:
    """The parts of a message that is one text; null counts as empty."""
    values = {"type": F.lit("text"), "text": F.coalesce(text, F.lit(""))}
    return F.array(F.struct(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in PART_TYPE]))


def format_messages(messages: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """A row for each message of (conv, turn, role, parts), dealt by conversation and sorted in each partition.

    `formatted` is its piece of the conversation's text, from character `at` on; `loss_start` and `loss_end` are the characters
    of the conversation under the loss mask (the content of assistant turns; equal for others). Messages of equal turn
    stand in the order of role and parts; null roles count as empty; null conversations are one conversation.
    """
    kind = messages.schema[conv].dataType
    order = [F.col(conv), F.col(turn), F.col("role"), F.to_json("parts")]
    dealt = messages.select(conv, turn, F.coalesce("role", F.lit("")).alias("role"), "parts").repartition(conv).sortWithinPartitions(*order)
    schema = T.StructType([T.StructField(conv, kind), T.StructField("at", T.LongType()), T.StructField("formatted", T.StringType()), T.StructField("loss_start", T.LongType()), T.StructField("loss_end", T.LongType()), T.StructField("attachments", T.ArrayType(ATTACHMENT_TYPE)), T.StructField("expanded_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, visitor, at = object(), Visitor(), 0
        for whole in batches:
            for first in range(0, whole.num_rows, 512):
                batch, rows = whole.slice(first, 512), []
                for conv_id, role, parts in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    if conv_id != last:
                        last, visitor, at = conv_id, Visitor(), 0
                    head = OPEN + escape(role).replace("\n", "\\\n") + "\n"
                    content, attachments = visitor.content(parts or [])
                    text = head + content + CLOSE
                    start = at + len(head)
                    rows.append((at, text, start, start + len(content) * (role == "assistant"), attachments, sum(a["tokens"] for a in attachments)))
                    at += len(text)
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *(pa.array(columns[i], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64(), ATTACHMENTS_ARROW, pa.int64())))],
                    schema.fieldNames(),
                )

    return in_python(dealt, run, schema)


_HEAD = re.compile(r"<turn>((?:[^\\\n]|\\.)*)\n", re.S)


def read_turn(formatted: str) -> tuple[str, str]:
    """(role, text) of a formatted turn of texts."""
    head = _HEAD.match(formatted)
    if head is None or not formatted.endswith(CLOSE):
        raise ValueError(f"not a turn: {formatted[:80]!r}")
    return unescape(head[1]), unescape(formatted[head.end() : -len(CLOSE)])


def digests(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """A row for each conversation, read back from the rows of `format_messages` in the order in which they stand."""
    schema = T.StructType([formatted.schema[conv], T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, done = object(), None, []

        def flush() -> Iterator[pa.RecordBatch]:
            columns = zip(*done, strict=True)
            kinds = (None, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k or pa_type) for c, k in zip(columns, kinds, strict=True)], schema.fieldNames())
            done.clear()

        def close() -> None:
            if state:
                done.append((last, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        pa_type = None
        for batch in batches:
            pa_type = batch.schema.field(0).type
            for first in range(0, batch.num_rows, 512):
                some = batch.slice(first, 512)
                for conv_id, at, text, start, end in zip(*(some.column(i).to_pylist() for i in range(5)), strict=True):
                    if state is None or conv_id != last:
                        close()
                        last, state = conv_id, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                    role, said = read_turn(text)
                    learned = unescape(text[start - at : end - at])
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                    state[2] += len(learned)
                    state[3].update(learned.encode("utf-8", "surrogatepass"))
                    state[4] += len(text)
                if len(done) > 2000:
                    yield from flush()
        close()
        if done:
            yield from flush()

    return in_python(formatted.select(conv, "at", "formatted", "loss_start", "loss_end"), run, schema)
