"""Chat formatting with a grammar round trip.

A turn is rendered as

    <|im_start|>role NEWLINE text <|im_end|> NEWLINE

and read again at once by the same deterministic parser that later reads the
whole stream. If the parser does not give back the same role and text, a level
of escaping is added and the turn is rendered again, until both agree. Escaping
puts one backslash before the bar of every `<|`, `<\\|`, `<\\\\|` ...; reading
takes one away, so it is reversible for every text.

Cases: a null text or role is empty; a null conv_id is a conversation of its
own and a null turn comes first; rows with the same turn go by role, then text,
and repeated rows are repeated turns; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

START, END = "<|im_start|>", "<|im_end|>"
_PLAIN = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<(\\*)\\\|")
_ROLE = re.compile(r"\\(.)", re.DOTALL)

FORMATTED = "conv_id long, position long, piece string, loss_start long, loss_end long"
DIGEST = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
    "loss_sha256 string, formatted_chars long"
)


def escape(text: str) -> str:
    return _PLAIN.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def _escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unescape_role(role: str) -> str:
    return _ROLE.sub(lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def parse_turns(stream: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start and end of the escaped text) for each turn of a stream."""
    at = 0
    while at < len(stream):
        if not stream.startswith(START, at):
            raise ValueError(f"no turn begins at character {at}")
        line = stream.find("\n", at)
        end = stream.find(END, line) if line >= 0 else -1
        if end < 0 or not stream.startswith("\n", end + len(END)):
            raise ValueError(f"the turn at character {at} does not end")
        role = _unescape_role(stream[at + len(START) : line])
        yield role, unescape(stream[line + 1 : end]), line + 1, end
        at = end + len(END) + 1


def _reads_back(piece: str, role: str, text: str) -> bool:
    try:
        return [turn[:2] for turn in parse_turns(piece)] == [(role, text)]
    except ValueError:
        return False


def render_turn(role: str, text: str) -> str:
    """The turn with as little escaping as the parser needs to give it back."""
    for head, body in ((role, text), (role, escape(text)), (_escape_role(role), escape(text))):
        piece = f"{START}{head}\n{body}{END}\n"
        if _reads_back(piece, role, text):
            return piece
    raise ValueError("a turn does not survive its round trip")


def _batches(batch: pa.RecordBatch, rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns to pieces; keeps only the number of the current turn."""
    schema = pa.schema(
        [("conv_id", pa.int64()), ("position", pa.int64()), ("piece", pa.string())]
        + [("loss_start", pa.int64()), ("loss_end", pa.int64())]
    )
    current, position = object(), 0
    for batch in batches:
        rows = []
        for conv, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            position = position + 1 if conv == current else 0
            current = conv
            piece = render_turn(role, text)
            ((_, _, start, end),) = parse_turns(piece)
            loss = (start, end) if role == "assistant" else (None, None)
            rows.append((conv, position, piece, *loss))
        yield _batches(batch, rows, schema)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation, hashed piece by piece: texts are never put together."""
    schema = pa.schema(
        [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string())]
        + [("loss_chars", pa.int64()), ("loss_sha256", pa.string())]
        + [("formatted_chars", pa.int64())]
    )
    current, open_ = None, False
    n = loss_chars = chars = 0
    turns, loss = hashlib.sha256(), hashlib.sha256()

    def row() -> tuple:
        return current, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars

    for batch in batches:
        rows = []
        for conv, piece, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not open_ or conv != current:
                if open_:
                    rows.append(row())
                current, open_ = conv, True
                n = loss_chars = chars = 0
                turns, loss = hashlib.sha256(), hashlib.sha256()
            for role, text, _, _ in parse_turns(piece):
                turns.update(f"{role}\n{text}\n".encode())
                n += 1
            if start is not None:
                masked = unescape(piece[start:end])
                loss.update(masked.encode())
                loss_chars += len(masked)
            chars += len(piece)
        yield _batches(batch, rows, schema)
    if open_:
        yield _batches(None, [row()], schema)


def format_conversations(turns: DataFrame) -> DataFrame:
    """Rendered pieces of `turns` (conv_id, turn, role, text), one row per turn.

    `loss_start` and `loss_end` bound the assistant's text inside the piece, in
    code points; both are null elsewhere. The pieces of a conversation, by
    `position`, put end to end are its formatted text. Sorting is Spark's, which
    spills; a conversation of any length passes as a stream of batches.
    """
    text = F.coalesce("text", F.lit(""))
    role = F.coalesce("role", F.lit(""))
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text")
    )
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(_render, FORMATTED)


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse what `format_conversations` wrote and digest each conversation."""
    dealt = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "position")
    return dealt.select("conv_id", "piece", "loss_start", "loss_end").mapInArrow(_digest, DIGEST)
