"""Chat formatting with typed content parts.

A turn is `<|start|>role<|text|>content<|end|>` and a newline. Control strings inside roles and texts get a backslash after
their first character (and one more where there are some already), so they never stand in the output by accident and
reading takes exactly one away again. A visitor flattens a turn's parts in order: texts are escaped, images, audio and documents
become placeholders, with a reference to the attachment and the number of tokens that it will take up.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, pieces

START, TEXT, END = "<|start|>", "<|text|>", "<|end|>\n"
# Control strings of chat templates in public use, as first character and rest; "<|" begins all of this template's own.
CONTROL = r"([<\[])(\\*)(\||s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)"
_ESCAPE, _UNESCAPE = re.compile(CONTROL), re.compile(CONTROL.replace(r"(\\*)", r"\\(\\*)"))
_SEGMENT = re.compile(r"<\|start\|>(.*?)<\|text\|>(.*)<\|end\|>\n", re.S)
_PLACEHOLDER = re.compile(r"<\|(image|audio|document|other)\|>")
#: Tokens: of an image, one for each square of 28 x 28 pixels; of audio, 25 a second; of a document, 600 a page.
PIXELS, PER_SECOND, PER_PAGE = 28, 25, 600

PARTS = "array<struct<type:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>>"
ATTACHMENTS = "array<struct<position:int,type:string,uri:string,tokens:long>>"


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


class Flatten:
    """Visits parts in order, by type; holds the content so far, attachments by position, and tokens that placeholders take up."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.attachments: list[dict] = []

    def visit(self, part: dict | None) -> None:
        kind = (part or {}).get("type") or "text"
        VISITS.get(kind, Flatten.visit_unknown)(self, part or {})

    def visit_text(self, part: dict) -> None:
        # texts that touch are escaped as one, or a control string could be split over two
        if self.out and self.out[-1][0] == "text":
            self.out[-1] = ("text", self.out[-1][1] + (part.get("text") or ""))
        else:
            self.out.append(("text", part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        self.attach("image", part, math.ceil(max(part.get("width") or 0, 0) / PIXELS) * math.ceil(max(part.get("height") or 0, 0) / PIXELS))

    def visit_audio(self, part: dict) -> None:
        s = part.get("seconds") or 0.0
        self.attach("audio", part, math.ceil(s * PER_SECOND) if math.isfinite(s) and s > 0 else 0)

    def visit_document(self, part: dict) -> None:
        self.attach("document", part, max(part.get("pages") or 0, 0) * PER_PAGE)

    def visit_unknown(self, part: dict) -> None:
        """A part of a type that isn't known: its text, if it has any, else a placeholder with its reference, which takes one token."""
        if part.get("text"):
            self.visit_text(part)
        else:
            self.attach("other", part, 1)

    def attach(self, kind: str, part: dict, tokens: int) -> None:
        self.attachments.append({"position": len(self.attachments), "type": kind, "uri": part.get("uri"), "tokens": max(1, tokens)})
        self.out.append(("placeholder", f"<|{kind}|>"))

    def content(self) -> str:
        return "".join(escape(x) if kind == "text" else x for kind, x in self.out)


VISITS = {"text": Flatten.visit_text, "image": Flatten.visit_image, "audio": Flatten.visit_audio, "document": Flatten.visit_document}


def format_turn(role: str | None, parts: list[dict] | None) -> tuple[str, int, int, list[dict], int]:
    """Segment, start and end of its content where it is under the loss mask (else 0, 0), attachments, tokens they take up."""
    f = Flatten()
    for p in parts or []:
        f.visit(p)
    head, body = START + escape(role or "") + TEXT, f.content()
    loss = (len(head), len(head) + len(body)) if role == "assistant" else (0, 0)
    return head + body + END, *loss, f.attachments, sum(a["tokens"] for a in f.attachments)


def read_turn(segment: str) -> tuple[str, str]:
    """Role and text of a formatted turn, placeholders left out."""
    m = _SEGMENT.fullmatch(segment)
    if not m:
        raise ValueError("not a formatted turn")
    return unescape(m[1]), unescape(_PLACEHOLDER.sub("", m[2]))


def text_parts(text: str = "text"):
    """A text column as one part."""
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    return F.array(F.struct(F.lit("text").alias("type"), F.col(text).alias("text"), null("string", "uri"), null("int", "width"), null("int", "height"), null("double", "seconds"), null("int", "pages")))


def format_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, parts) to (conv_id, turn, segment, loss_start, loss_end, attachments, attachment_tokens), a row per turn.

    A conversation's output is its segments by turn. Null roles and texts are empty; a turn without parts has no content; parts of unknown type are
    their text, or a placeholder.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            rows = [format_turn(r, p) for r, p in zip(b.column("role").to_pylist(), b.column("parts").to_pylist())]
            s, lo, hi, at, n = zip(*rows) if rows else ([], [], [], [], [])
            kind = pa.list_(pa.struct([("position", pa.int32()), ("type", pa.string()), ("uri", pa.string()), ("tokens", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("turn"), pa.array(s, pa.string()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.array(at, kind), pa.array(n, pa.int64())], ["conv_id", "turn", "segment", "loss_start", "loss_end", "attachments", "attachment_tokens"])

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), "parts")
    return rows.mapInArrow(run, f"conv_id long, turn long, segment string, loss_start long, loss_end long, attachments {ATTACHMENTS}, attachment_tokens long")


def digests(segments: DataFrame) -> DataFrame:
    """What formatted conversations say when read back: one row per conv_id (nulls are one).

    Turns are in order of turn, nulls first, then of the segment. A conversation passes through one task as a stream, of which only running digests
    are held, however long it is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        open_, out = None, []

        def close() -> None:
            out.append((open_[0], open_[1], open_[2].hexdigest(), open_[3], open_[4].hexdigest(), open_[5]))

        def batch() -> pa.RecordBatch:
            cols = [list(c) for c in zip(*out)]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n.endswith("256") else pa.int64()) for c, n in zip(cols, names)], names)

        for b in pieces(batches):
            for i, s, lo, hi in zip(*(b.column(c).to_pylist() for c in ("conv_id", "segment", "loss_start", "loss_end"))):
                if open_ is None or open_[0] != i:
                    if open_ is not None:
                        close()
                    open_ = [i, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = read_turn(s)
                open_[1] += 1
                open_[2].update(f"{role}\n{text}\n".encode())
                if hi:
                    trained = unescape(_PLACEHOLDER.sub("", s[lo:hi]))
                    open_[3] += len(trained)
                    open_[4].update(trained.encode())
                open_[5] += len(s)
            if out:
                yield batch()
        if open_ is not None:
            close()
            yield batch()

    rows = segments.select("conv_id", "turn", "segment", "loss_start", "loss_end").repartition(partitions(segments.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "segment")
    return rows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: A conversation whose texts are control strings, which the query adds.
HOSTILE = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def query(conversations: DataFrame) -> DataFrame:
    own = conversations.sparkSession.createDataFrame(HOSTILE, "conv_id long, turn long, role string, text string")
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")).union(own)
    return digests(format_turns(rows.select("conv_id", "turn", "role", text_parts().alias("parts"))))


_ESC = r"regexp_replace(%s, '([<\[])(\\*)(\||s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)', '\1\\\2\3', 'g')"
ORACLE = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
s AS (SELECT *, '<|start|>' || {_ESC % "role"} || '<|text|>' || {_ESC % "text"} || '<|end|>' || chr(10) AS segment FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, segment)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, segment) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(segment)) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
"""
