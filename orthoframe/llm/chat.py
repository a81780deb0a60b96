"""Chat formatting over typed content parts.

A message has a role and parts: text, image, audio or document. A visitor flattens the parts of
each message in order: text is escaped; any other part becomes a placeholder ``<|kind:k|>``, where
k counts the conversation's attachments, with a reference and the number of tokens that the
placeholder expands to. The template marks turns::

    <|turn role|>text<|end|>      for any role; the role is escaped like a text

Control strings begin with ``<``, and escaping leaves no ``<`` in a text, so no text can look like
a control string: ``&`` becomes ``&a``, and ``<`` becomes ``&l``. Unescaping reverses that exactly.
The loss mask covers an assistant's escaped text, without markers and placeholders.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import groupby
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

END = "<|end|>"
_TURN = re.compile(r"<\|turn ([^<|]*)\|>((?:[^<]+|<\|(?:image|audio|document):[0-9]+\|>)*)<\|end\|>")
_PLACEHOLDER = re.compile(r"<\|(image|audio|document):([0-9]+)\|>")


def escape(text: str) -> str:
    return text.replace("&", "&a").replace("<", "&l")


def unescape(text: str) -> str:
    return text.replace("&l", "<").replace("&a", "&")


def escape_role(role: str) -> str:
    """Also free of the bar that ends a role."""
    return escape(role).replace("|", "&b")


def unescape_role(role: str) -> str:
    return unescape(role.replace("&b", "|"))


@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Image:
    ref: str
    width: int
    height: int


@dataclass(frozen=True)
class Audio:
    ref: str
    seconds: float


@dataclass(frozen=True)
class Document:
    ref: str
    pages: int


Part = Text | Image | Audio | Document


@dataclass
class Formatter:
    """The visitor: takes messages in order and holds the conversation's formatted form."""

    patch: int = 14  # pixels of an image's side for a token
    audio_rate: float = 25.0  # tokens of a second
    page_tokens: int = 256
    loss_roles: tuple[str, ...] = ("assistant",)
    out: list[str] = field(default_factory=list)
    length: int = 0
    loss: list[tuple[int, int]] = field(default_factory=list)
    attachments: list[dict[str, Any]] = field(default_factory=list)
    n_turns: int = 0

    def _write(self, text: str) -> None:
        self.out.append(text)
        self.length += len(text)

    def message(self, role: str | None, parts: Iterable[Part]) -> None:
        self._write(f"<|turn {escape_role(role or '')}|>")
        for part in parts:
            getattr(self, f"visit_{type(part).__name__.lower()}")(role or "", part)
        self._write(END)
        self.n_turns += 1

    def visit_text(self, role: str, part: Text) -> None:
        start = self.length
        self._write(escape(part.text or ""))
        if role in self.loss_roles and self.length > start:
            self.loss.append((start, self.length))

    def _attach(self, kind: str, ref: str, tokens: int) -> None:
        k = len(self.attachments)
        self.attachments.append({"kind": kind, "ref": ref, "position": self.length, "turn": self.n_turns, "tokens": tokens})
        self._write(f"<|{kind}:{k}|>")

    def visit_image(self, role: str, part: Image) -> None:
        self._attach("image", part.ref, math.ceil(part.width / self.patch) * math.ceil(part.height / self.patch))

    def visit_audio(self, role: str, part: Audio) -> None:
        self._attach("audio", part.ref, math.ceil(part.seconds * self.audio_rate))

    def visit_document(self, role: str, part: Document) -> None:
        self._attach("document", part.ref, part.pages * self.page_tokens)

    def result(self) -> tuple[str, list[tuple[int, int]], list[dict[str, Any]]]:
        return "".join(self.out), self.loss, self.attachments


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a formatted conversation; placeholders stay in the text."""
    turns, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError(f"not a formatted conversation at {at}")
        turns.append((unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"not a formatted conversation at {at}")
    return turns


def to_part(value: dict[str, Any]) -> Part:
    """A part from a row of type, text, ref, width, height, seconds, pages (null: empty or zero)."""
    kind = value.get("type") or "text"
    if kind == "text":
        return Text(value.get("text") or "")
    ref = value.get("ref") or ""
    if kind == "image":
        return Image(ref, value.get("width") or 0, value.get("height") or 0)
    if kind == "audio":
        return Audio(ref, value.get("seconds") or 0.0)
    if kind == "document":
        return Document(ref, value.get("pages") or 0)
    raise ValueError(f"unknown kind of part: {kind}")


_ATTACHMENT = pa.struct([("kind", pa.string()), ("ref", pa.string()), ("position", pa.int64()), ("turn", pa.int64()), ("tokens", pa.int64())])
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
FORMATTED = "formatted string, loss array<struct<start: bigint, `end`: bigint>>, attachments array<struct<kind: string, ref: string, position: bigint, turn: bigint, tokens: bigint>>"


def format_conversations(rows: DataFrame, **options) -> DataFrame:
    """Rows (conv_id, turn, role, and text or parts) -> (conv_id, formatted, loss, attachments).

    Turns go by turn (null first), then role and text, so ties have an order. Null roles, texts
    and parts count as empty. Rows without a conversation form one. Repeated rows are turns each.
    Rows stream sorted through a task, which holds one conversation at a time.
    """
    has_parts = "parts" in rows.columns
    content = F.to_json("parts") if has_parts else F.coalesce("text", F.lit(""))
    kept = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce(content, F.lit("")).alias("content"))
    ordered = kept.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "content")
    schema = f"conv_id {kept.schema['conv_id'].dataType.simpleString()}, {FORMATTED}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        kind = None

        def turns() -> Iterator[tuple]:
            nonlocal kind
            for batch in batches:
                kind = batch.column("conv_id").type
                yield from zip(batch.column("conv_id").to_pylist(), batch.column("role").to_pylist(), batch.column("content").to_pylist(), strict=True)

        def write(done: list[tuple]) -> pa.RecordBatch:
            ids, texts, losses, files = zip(*done, strict=True)
            spans = [[{"start": a, "end": b} for a, b in x] for x in losses]
            return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(texts, pa.string()), pa.array(spans, pa.list_(_SPAN)), pa.array(files, pa.list_(_ATTACHMENT))], ["conv_id", "formatted", "loss", "attachments"])

        done, size = [], 0
        for conv, group in groupby(turns(), key=lambda x: x[0]):
            form = Formatter(**options)
            for _, role, text in group:
                form.message(role, map(to_part, json.loads(text or "[]")) if has_parts else [Text(text)])
            done.append((conv, *form.result()))
            size += form.length
            if size > 4_000_000 or len(done) >= 2000:
                yield write(done)
                done, size = [], 0
        if done:
            yield write(done)

    return ordered.mapInArrow(run, schema)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted conversations hold, by parsing them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, loss in zip(batch.column("formatted").to_pylist(), batch.column("loss").to_pylist(), strict=True):
                turns = parse(text)
                whole, masked, n = hashlib.sha256(), hashlib.sha256(), 0
                for role, said in turns:
                    whole.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                for span in loss:
                    own = unescape(text[span["start"] : span["end"]])
                    n += len(own)
                    masked.update(own.encode("utf-8", "surrogatepass"))
                out.append((len(turns), whole.hexdigest(), n, masked.hexdigest(), len(text)))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = formatted.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select("conv_id", "formatted", "loss").mapInArrow(run, schema)


#: Fixed by the query's contract.
EXTRA_CONVERSATION = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: all conversations and one more, formatted and read back."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame(EXTRA_CONVERSATION, "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(rows.unionByName(more)))


OP6_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|turn |><|end|>') + length(replace(replace(replace(role, '&', '&a'), '<', '&l'), '|', '&b'))
    + length(replace(replace(text, '&', '&a'), '<', '&l')))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""
