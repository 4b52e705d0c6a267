r"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to a string. For each conversation the
successive turn prefixes are rendered and consecutive outputs are compared: where an output continues
the one before, the new part is the turn's span; where it doesn't, the template rewrites history,
which is reported with the first turn that shows it. Rendering the same prefix once more with a probe
in place of the turn's text finds where in its span the text stands. The loss mask is the text of the
assistant turns.

The built-in template marks turns with control strings. Texts are escaped first: a backslash goes
behind the first character of each control string and of each backslash, so no text can close
a turn, and ``unescape`` gets every text back. ``read_back`` parses the output alone.

Rows are dealt by conversation and sorted within the task, which holds one conversation at a time: its
formatted text is a single value of the result in any case.

Cases: null text is empty, a null role is the empty role; rows of equal turn number are ordered by
role, then text; repeated rows are repeated turns; a null conv_id is a conversation of its own; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

# The control strings of the built-in template.
CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]"]
_marks = re.compile("|".join(map(re.escape, ["\\", *CONTROLS])))
_escape = re.compile(r"\\(\\?)")
PROBE = "\ue000"


def escape(text: str) -> str:
    return _marks.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _escape.sub(r"\1", text)


def bracket_template(turns: list[Turn]) -> str:
    """The built-in template; expects escaped texts and roles."""
    out = []
    for role, text in turns:
        if role == "user":
            out.append(f"<s>[INST] {text} [/INST]")
        elif role == "assistant":
            out.append(f" {text} </s>")
        elif role == "system":
            out.append(f"<<SYS>>\n{text}\n<</SYS>>\n")
        else:
            out.append(f"[ROLE]{role}[ROLE] {text} [/ROLE]")
    return "".join(out)


_turn = re.compile(
    r"<s>\[INST\] (?P<user>.*?) \[/INST\]| (?P<assistant>.*?) </s>|<<SYS>>\n(?P<system>.*?)\n<</SYS>>\n|"
    r"\[ROLE\](?P<role>.*?)\[ROLE\] (?P<text>.*?) \[/ROLE\]",
    re.DOTALL,
)


def read_back(formatted: str) -> list[Turn]:
    """The turns of the built-in template's output."""
    turns, at = [], 0
    while at < len(formatted):
        m = _turn.match(formatted, at)
        if not m:
            raise ValueError(f"no turn starts at character {at}")
        if m["role"] is not None:
            turns.append((unescape(m["role"]), unescape(m["text"])))
        else:
            turns.append((m.lastgroup, unescape(m[m.lastgroup])))
        at = m.end()
    return turns


def locate(turns: list[Turn], template: Template) -> tuple[str, list[tuple[int, int, int, int]], int | None]:
    """Output, spans (start, end, text start, text end) per turn, and the first turn that rewrites history.

    A turn that rewrites history starts where its output leaves the one before; positions of earlier
    spans beyond that point no longer hold.
    """
    spans, before, broken = [], template([]) if turns else "", None
    for k in range(len(turns)):
        now = template(turns[: k + 1])
        start = len(before)
        if not now.startswith(before):
            start = next((i for i, (a, b) in enumerate(zip(before, now, strict=False)) if a != b), min(len(before), len(now)))
            broken = k if broken is None else broken
        role, text = turns[k]
        probed = template([*turns[:k], (role, PROBE)])
        head = probed.find(PROBE, start)
        tail = len(probed) - head - 1
        if head < 0 or probed[:head] != now[:head] or now[head : len(now) - tail] != text:
            head, tail = len(now), 0  # the template drops or changes the text
        spans.append((start, len(now), head, len(now) - tail))
        before = now
    return before, spans, broken


def formatted_chats(rows: DataFrame, template: Template = bracket_template, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, spans, rewrites_at (null: never)."""
    span = pa.struct([("role", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text_start", pa.int64()), ("text_end", pa.int64()), ("loss", pa.bool_())])
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("spans", pa.list_(span)), ("rewrites_at", pa.int64())])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        size = 0
        for conv_id, group in groupby(stream(batches), key=lambda r: r[0]):
            turns = [(r[1], r[2]) for r in group]
            text, spans, broken = locate([(escape(a), escape(b)) for a, b in turns], template)
            marked = [
                {"role": role, "start": a, "end": b, "text_start": c, "text_end": d, "loss": role in loss_roles}
                for (role, _), (a, b, c, d) in zip(turns, spans, strict=True)
            ]
            out.append({"conv_id": conv_id, "n_turns": len(turns), "formatted": text, "spans": marked, "rewrites_at": broken})
            size += len(text)
            if size > 4_000_000 or len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    asked = rows.select(
        F.col("conv_id").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "turn"
    )
    return (
        asked.repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .select("conv_id", "role", "text")
        .mapInArrow(run, "conv_id long, n_turns long, formatted string, spans array<struct<role: string, start: long, end: long, text_start: long, text_end: long, loss: boolean>>, rewrites_at long")
    )


def digests(formatted: DataFrame) -> DataFrame:
    """The contract's columns, read back from the output alone and from the mask on it."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for conv_id, text, spans in zip(*(c.to_pylist() for c in b.columns), strict=True):
                turns = read_back(text)
                whole = "".join(f"{role}\n{said}\n" for role, said in turns)
                loss = "".join(unescape(text[s["text_start"] : s["text_end"]]) for s in spans if s["loss"])
                sha = [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in (whole, loss)]
                rows.append((conv_id, len(turns), sha[0], len(loss), sha[1], len(text)))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return formatted.select("conv_id", "formatted", "spans").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
