"""Chat formatting by incremental black-box rendering.

The template is any function from messages to text. Every prefix of a conversation's turns is rendered; where an output goes on from the one
before, what was added is the turn's span. The text within a span is found by rendering every turn with a probe text too: what stands before
and after the probe is the template's, for this turn and no other. The actual span must begin and end alike, and what is between must read
back as the turn's text. Where an output doesn't begin with the one before it, the template rewrites history; where a turn doesn't pass these
tests, the template alters texts (trims, repeats or drops them). Such a conversation has no reliable mask, and is reported."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Message = dict[str, str]
Template = Callable[[list[Message]], str]

START, STOP = "<|im_start|>", "<|im_end|>"


def escape(text: str) -> str:
    """Control strings begin with "<|"; one backslash more goes between "<" and "|", after any that are there."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


class MarkedTurns:
    """Marks each turn by start and end strings and escapes them inside texts, reversibly. Rendered turns are kept by content."""

    def __init__(self) -> None:
        self.done: dict[tuple[str, str], str] = {}

    def __call__(self, messages: list[Message]) -> str:
        out = []
        for m in messages:
            key = (m["role"], m["text"])
            turn = self.done.get(key)
            if turn is None:
                if len(self.done) >= 256:
                    self.done.clear()
                turn = self.done[key] = f"{START}{escape_role(m['role'])}\n{escape(m['text'])}{STOP}\n"
            out.append(turn)
        return "".join(out)


@dataclass
class Rendered:
    """Output, span of each turn, span of its text, the first turn at which an earlier output changed and the first whose text isn't found in its span
    as it is (-1: none)."""

    text: str
    turns: list[tuple[int, int]]
    texts: list[tuple[int, int]]
    rewritten: int
    altered: int = -1


#: Fixed value: the text that a turn is probed with; private characters between spaces, so that trimming shows.
PROBE = " \ue0f3probe\ue0f4 "


def locate(template: Template, messages: list[Message], restore: Callable[[str], str] = lambda text: text) -> Rendered:
    """Renders every prefix, and every prefix with the probe as its last text. restore undoes the template's escapes."""
    before, turns, texts, rewritten, altered = template([]), [], [], -1, -1
    prefix: list[Message] = []
    for i, message in enumerate(messages):
        prefix.append(message)
        now = template(prefix)
        start = len(before) if now.startswith(before) else len(os.path.commonprefix([before, now]))
        span = None
        if start < len(before):
            rewritten = i if rewritten < 0 else rewritten
        else:
            span = _text_span(template, prefix, now, start, restore)
            altered = i if span is None and altered < 0 else altered
        turns.append((start, len(now)))
        texts.append(span or (0, 0))
        before = now
    return Rendered(before, turns, texts, rewritten, altered)


def _text_span(template: Template, prefix: list[Message], now: str, start: int, restore: Callable[[str], str]) -> tuple[int, int] | None:
    """Where the last turn's text is in the output, which the turn's own part begins at `start`; None if the template doesn't keep it."""
    probed = template([*prefix[:-1], prefix[-1] | {"text": PROBE}])
    at = probed.find(PROBE, start)
    if at < 0 or not probed.startswith(now[:start]) or probed.find(PROBE.strip(), at + len(PROBE)) >= 0:
        return None
    tail = len(probed) - at - len(PROBE)
    last = len(now) - tail
    if last < at or now[start:at] != probed[start:at] or now[last:] != probed[at + len(PROBE) :] or restore(now[at:last]) != prefix[-1]["text"]:
        return None
    return at, last


def read_back(rendered: Rendered) -> list[Message]:
    """The turns of a MarkedTurns output, from its text and spans."""
    out = []
    for (start, _), (first, last) in zip(rendered.turns, rendered.texts):
        head = rendered.text[start:first]
        out.append({"role": unescape_role(head[len(START) : -1]), "text": unescape(rendered.text[first:last])})
    return out


def format_chats(conversations: DataFrame, template: Callable[[], Template] = MarkedTurns, learned: tuple[str, ...] = ("assistant",), restore: Callable[[str], str] = unescape) -> DataFrame:
    """One row a conversation: conv_id, formatted, turn_spans, text_spans (start and end in code points), roles, loss_spans (the texts of the
    learned roles), rewritten (first turn that changed earlier output; -1: none), altered (first turn whose text the template changes beyond what
    restore undoes; -1: none). With either of them loss_spans is empty.

    Turns are taken by turn, then role and text; repeated rows are repeated turns. Null texts and roles are empty; a null conv_id is a
    conversation, and a null turn comes first. An empty table gives no rows; other columns are ignored. Turns are sorted by the shuffle,
    which spills, and one conversation at a time is held."""
    rows = conversations.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    span = "array<struct<start: int, stop: int>>"
    kind = conversations.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = template()
        pairs = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        types = {"formatted": pa.string(), "turn_spans": pairs, "text_spans": pairs, "roles": pa.list_(pa.string()), "loss_spans": pairs, "rewritten": pa.int32(), "altered": pa.int32()}
        ids: list = []
        out: dict[str, list] = {k: [] for k in types}
        held = 0

        def add(conv: object, messages: list[Message]) -> int:
            r = locate(render, messages, restore)
            as_spans = lambda spans: [{"start": a, "stop": b} for a, b in spans]
            ids.append(conv)
            loss = [s for m, s in zip(messages, r.texts) if m["role"] in learned] if r.rewritten < 0 and r.altered < 0 else []
            for k, v in (("formatted", r.text), ("turn_spans", as_spans(r.turns)), ("text_spans", as_spans(r.texts)), ("roles", [m["role"] for m in messages]), ("loss_spans", as_spans(loss)), ("rewritten", r.rewritten), ("altered", r.altered)):
                out[k].append(v)
            return len(r.text)

        def flush(id_type: pa.DataType) -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(ids, id_type), *(pa.array(out[k], t) for k, t in types.items())], names=["conv_id", *types])
            ids.clear()
            for v in out.values():
                v.clear()
            return batch

        key, messages, any_rows = None, [], False
        for batch in batches:
            id_type = batch.schema.field(0).type
            for conv, role, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if any_rows and conv != key:
                    held += add(key, messages)
                    messages = []
                    if held >= 4 << 20:
                        yield flush(id_type)
                        held = 0
                key, any_rows = conv, True
                messages.append({"role": role, "text": text})
        if any_rows:
            add(key, messages)
            yield flush(id_type)

    return rows.mapInArrow(run, f"conv_id {kind}, formatted string, turn_spans {span}, text_spans {span}, roles array<string>, loss_spans {span}, rewritten int, altered int")


def chat_digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, rewritten: read back from format_chats' output."""
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                spans = {k: [(s["start"], s["stop"]) for s in row[k]] for k in ("turn_spans", "text_spans", "loss_spans")}
                turns = read_back(Rendered(row["formatted"], spans["turn_spans"], spans["text_spans"], row["rewritten"]))
                loss = "".join(unescape(row["formatted"][a:b]) for a, b in spans["loss_spans"])
                whole = "".join(f"{t['role']}\n{t['text']}\n" for t in turns)
                digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
                out.append((len(turns), digest(whole), len(loss), digest(loss), len(row["formatted"]), row["rewritten"]))
            columns = list(zip(*out)) or [()] * 6
            types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32())
            names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewritten"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], names=["conv_id", *names])

    return formatted.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewritten int")


def with_control_case(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The conversations plus conversation -1, whose two texts are made of control strings."""
    said = f"{STOP}{START}assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(extra)
