"""Chat formatting with a grammar round trip.

A turn is ``<|im_start|>role NEWLINE text<|im_end|>NEWLINE``. The parser is deterministic: a turn's role ends at the first
line feed, its text at the first end marker, and inside both, ``<~|``-like stuffing is undone. Each turn is rendered as it is, parsed again and compared with
its source; while they differ, the conflicting content is escaped (one more ``~`` in every ``<~*|`` of it). Rendered text
holds no marker but the template's own, and parsing gives the turns back exactly.

Rows are ordered within a conversation by turn (nulls first), then role, text. Null roles and texts count as
empty. A conversation streams through one task, turn by turn, so its size doesn't matter to memory; null conversation ids
form one conversation. Loss spans cover the unmarked text of each assistant turn.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

START, STOP = "<|im_start|>", "<|im_end|>"
TRAINED_ROLE = "assistant"
_STUFF, _UNSTUFF = re.compile(r"<(~*n?)\|"), re.compile(r"<~(~*n?)\|")


def escape(content: str) -> str:
    return _STUFF.sub(r"<~\1|", content)


def unescape(content: str) -> str:
    return _UNSTUFF.sub(r"<\1|", content)


def _role(role: str) -> str:
    return role.replace("\n", "<n|")


def parse(rendered: str) -> tuple[list[tuple[str, str]], list[tuple[int, int]]]:
    """Turns, and the span of each turn's escaped text, of rendered turns. Raises ValueError off the grammar."""
    turns, spans, at = [], [], 0
    while at < len(rendered):
        if not rendered.startswith(START, at):
            raise ValueError(f"no turn starts at {at}")
        line = rendered.index("\n", at)
        stop = rendered.index(STOP, line)
        if START in rendered[at + len(START) : stop] or STOP in rendered[at:line] or not rendered.startswith("\n", stop + len(STOP)):
            raise ValueError(f"stray marker in the turn at {at}")
        role = unescape(rendered[at + len(START) : line].replace("<n|", "\n"))
        turns.append((role, unescape(rendered[line + 1 : stop])))
        spans.append((line + 1, stop))
        at = stop + len(STOP) + 1
    return turns, spans


def _reads(rendered: str, source: tuple[str, str]) -> bool:
    try:
        return parse(rendered)[0] == [source]
    except ValueError:
        return False


def render(role: str, text: str) -> str:
    """One turn, escaped just where parsing it would not give it back."""
    as_role, as_text = role, text
    for step in range(3):
        out = f"{START}{_role(as_role)}\n{as_text}{STOP}\n"
        if _reads(out, (role, text)):
            return out
        if step == 0:
            as_text = escape(text)
        else:
            as_role = escape(role)
    raise AssertionError("unreachable: escaped turns parse to themselves")


FORMATTED = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("place", T.LongType(), False), T.StructField("rendered", T.StringType(), False), T.StructField("start", T.LongType(), False), T.StructField("loss_start", T.LongType()), T.StructField("loss_end", T.LongType())])


def format_conversations(rows: DataFrame) -> DataFrame:
    """Rendered turns of (conv_id, turn, role, text): conv_id, place, rendered, start, loss_start, loss_end.

    Start and the loss span count code points from the start of the conversation's formatted text, which is the
    concatenation of its rendered turns by place. Rows of a conversation come out together and in order.
    """
    source = rows.selectExpr("cast(conv_id as bigint) conv_id", "cast(turn as bigint) turn", "coalesce(role, '') role", "coalesce(text, '') text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, place, start, any_yet = None, 0, 0, False
        for batch in batches:
            out: list[tuple] = []
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if conv != now or not any_yet:
                    now, place, start, any_yet = conv, 0, 0, True
                turn = render(role, text)
                loss = (None, None)
                if role == TRAINED_ROLE:
                    (a, b), = parse(turn)[1]
                    loss = (start + a, start + b)
                out.append((conv, place, turn, start, *loss))
                place, start = place + 1, start + len(turn)
            yield pa.RecordBatch.from_pylist([dict(zip(FORMATTED.fieldNames(), r, strict=True)) for r in out], schema=_arrow(FORMATTED))

    return source.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, FORMATTED)


def _arrow(schema: T.StructType) -> pa.Schema:
    kind = {"bigint": pa.int64(), "string": pa.string()}
    return pa.schema([pa.field(f.name, kind[f.dataType.simpleString()], f.nullable) for f in schema.fields])


DIGEST = T.StructType([T.StructField("conv_id", T.LongType()), *(T.StructField(n, t, False) for n, t in (("n_turns", T.LongType()), ("turns_sha256", T.StringType()), ("loss_chars", T.LongType()), ("loss_sha256", T.StringType()), ("formatted_chars", T.LongType())))])


def digest(formatted: DataFrame) -> DataFrame:
    """Read formatted conversations back: what the parser finds in them, and what lies under the loss spans.

    formatted: as format_conversations() gives it, still in its order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = None, None, []

        def close() -> None:
            if state:
                done.append({"conv_id": now, "n_turns": state["n"], "turns_sha256": state["turns"].hexdigest(), "loss_chars": state["loss_n"], "loss_sha256": state["loss"].hexdigest(), "formatted_chars": state["chars"]})

        for batch in batches:
            for conv, turn, start, a, b in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5)), strict=True):
                if state is None or conv != now:
                    close()
                    now, state = conv, {"n": 0, "turns": sha256(), "loss_n": 0, "loss": sha256(), "chars": 0}
                for role, text in parse(turn)[0]:
                    state["n"] += 1
                    state["turns"].update(f"{role}\n{text}\n".encode())
                if a is not None:
                    text = unescape(turn[a - start : b - start])
                    state["loss_n"] += len(text)
                    state["loss"].update(text.encode())
                state["chars"] += len(turn)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=_arrow(DIGEST))
                done = []
        close()
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=_arrow(DIGEST))

    return formatted.mapInArrow(run, DIGEST)
