"""Chat formatting: typed content parts are flattened by a visitor into marked turns.

A message is a list of parts (text, image, audio, document). Text is escaped; every other part becomes
an ordered placeholder, and its attachment (order, kind, reference, expanded tokens) is recorded beside
the text. An assistant turn is `<s>text</s>`, any other `[INST]role, line break, text[/INST]`. Inside
texts and roles a backslash is doubled and every control string is broken by a backslash after its
first character, so control strings stand only where the template put them and `unescape` restores the
text exactly. The loss mask covers the text between `<s>` and `</s>`.

Turns are formatted where they lie; only then are rows brought together by conversation and sorted. A
conversation of any length is read in a stream with constant memory. Order within a conversation:
turn, role, text (nulls first); repeated rows are repeated turns. Null role or text is empty; rows with
a null conversation id form one conversation. Columns besides those named are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The template's control strings.
TURN, END_TURN, SAY, END_SAY = "[INST]", "[/INST]", "<s>", "</s>"
PLACES = {"image": "<image>", "audio": "<audio>", "document": "<document>"}
CONTROLS = (TURN, END_TURN, SAY, END_SAY, *PLACES.values())
_BREAK = re.compile("(?=" + "|".join(map(re.escape, CONTROLS)) + ")(.)")
_ESCAPED = re.compile(r"\\(\\|n|)")
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))

PARTS = "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
ATTACHMENTS = "array<struct<position:int,kind:string,ref:string,tokens:long>>"


def escape(text: str) -> str:
    return _BREAK.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: {"\\": "\\", "n": "\n", "": ""}[m[1]], text)


class Visitor:
    """Flattens the parts of one message."""

    def __init__(self, patch: int = 14, audio_rate: float = 25.0, page_tokens: int = 512):
        self.patch, self.audio_rate, self.page_tokens = patch, audio_rate, page_tokens

    def flatten(self, parts: list[dict] | None) -> tuple[str, list[tuple]]:
        out, attachments = [], []
        for part in parts or []:
            kind = (part or {}).get("kind")
            if kind == "text":
                out.append(escape(part["text"] or ""))
            elif kind in PLACES:
                attachments.append((len(attachments), kind, part["ref"], getattr(self, kind)(part)))
                out.append(PLACES[kind])
            elif part is not None:
                raise ValueError(f"unknown content part: {kind}")
        return "".join(out), attachments

    def image(self, part: dict) -> int:
        return max(1, math.ceil((part["width"] or 0) / self.patch) * math.ceil((part["height"] or 0) / self.patch))

    def audio(self, part: dict) -> int:
        return max(1, math.ceil((part["seconds"] or 0) * self.audio_rate))

    def document(self, part: dict) -> int:
        return max(1, part["pages"] or 1) * self.page_tokens


def render(role: str | None, parts: list[dict] | None, visitor: Visitor) -> tuple[str, int, int, list[tuple]]:
    """Segment, start and length of its loss mask in code points, and attachments."""
    body, attachments = visitor.flatten(parts)
    if role == "assistant":
        return SAY + body + END_SAY, len(SAY), len(body), attachments
    # an escaped role holds no line break of its own, so the first one ends it
    head = escape(role or "").replace("\n", "\\n")
    return TURN + head + "\n" + body + END_TURN, 0, 0, attachments


def parse(segment: str) -> tuple[str, str]:
    """Role and text of a segment, placeholders left out."""
    if segment.startswith(SAY):
        role, body = "assistant", segment[len(SAY) : -len(END_SAY)]
    else:
        role, _, body = segment[len(TURN) : -len(END_TURN)].partition("\n")
        role = unescape(role)
    return role, "".join(unescape(x) for x in _CONTROL.split(body))


def as_parts(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with the text as the only content part."""
    part = F.struct(F.lit("text").alias("kind"), F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), *(F.lit(None).cast(t).alias(n) for n, t in (("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))))
    return rows.select("conv_id", "turn", "role", F.array(part).alias("parts"))


def format_turns(messages: DataFrame, **tokens) -> DataFrame:
    """Messages (conv_id, turn, role, parts) as segments in order.

    conv_id, turn, segment, start (code points before it in its conversation), loss_start and
    loss_length within the segment, attachments, expanded_tokens. A conversation's formatted text is
    its segments one after the other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        visitor = Visitor(**tokens)
        for batch in batches:
            done = [render(role.as_py(), parts.as_py(), visitor) for role, parts in zip(batch.column(2), batch.column(3), strict=True)]
            kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))
            attachments = pa.array([[dict(zip(("position", "kind", "ref", "tokens"), a, strict=True)) for a in d[3]] for d in done], kind)
            columns = [pa.array([d[0] for d in done], pa.string()), pa.array([len(d[0]) for d in done], pa.int64()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64()), attachments, pa.array([sum(a[3] for a in d[3]) for d in done], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], names=["conv_id", "turn", "role", "segment", "chars", "loss_start", "loss_length", "attachments", "expanded_tokens"])

    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "parts")
    segments = rows.mapInArrow(run, f"conv_id long, turn long, role string, segment string, chars long, loss_start long, loss_length long, attachments {ATTACHMENTS}, expanded_tokens long")
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "segment").rowsBetween(Window.unboundedPreceding, -1)
    return segments.withColumn("start", F.coalesce(F.sum("chars").over(before), F.lit(0))).drop("chars")


def digests(turns: DataFrame) -> DataFrame:
    """Reads formatted turns back: one row per conversation, streamed in order."""
    columns = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row():
            return (conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars)

        conv, n, out = None, 0, []
        for batch in batches:
            for key, segment, start, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not n or key != conv:
                    if n:
                        out.append(row())
                    conv, n, turns, loss, loss_chars, chars = key, 0, hashlib.sha256(), hashlib.sha256(), 0, 0
                role, text = parse(segment)
                turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                masked = "".join(unescape(x) for x in _CONTROL.split(segment[start : start + length]))
                loss.update(masked.encode("utf-8", "surrogatepass"))
                n, loss_chars, chars = n + 1, loss_chars + len(masked), chars + len(segment)
            if len(out) > 1000:
                yield _digest_batch(out, columns)
                out = []
        if n:
            out.append(row())
        if out:
            yield _digest_batch(out, columns)

    ordered = turns.select("conv_id", "segment", "loss_start", "loss_length", "start", "turn", "role")
    ordered = ordered.repartition("conv_id").sortWithinPartitions("conv_id", "start", "turn", "role", "segment").select("conv_id", "segment", "loss_start", "loss_length")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _digest_batch(rows: list[tuple], columns: tuple[str, ...]) -> pa.RecordBatch:
    kinds = [pa.string() if name.endswith("sha256") else pa.int64() for name in columns]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(columns))
