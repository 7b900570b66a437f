"""Chat formatting with a grammar that reads its own output back.

    conversation = "<s>" turn*
    turn         = "[INST] " text " [/INST]"          user
                 | "<<SYS>>" text "<</SYS>>"          system
                 | "<<ROLE " name ">>" text "<</ROLE>>"  any other role, null as the empty name
                 | " " text " </s>"                   assistant

No control string may show inside a text: it gets a backslash after its first character (one more than it had), which
the parser takes away. Each turn is parsed again as soon as it is written and compared with its source, and escaped where
it doesn't come back identical. Turns go in the order of (turn, role, text); null text is empty. The rows of a conversation pass one parser
in order, which reads their text as one stream and knows nothing of the borders of rows, so a conversation of any length
needs the memory of one turn. The digests of a conversation are taken in its order, so one task streams it; rendering and
escaping are done before, wherever the rows are.

Null roles are empty; rows that repeat stay; a null conv_id is a conversation; an empty table has none. Other columns than
the four named are ignored."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A control string, or one with backslashes after its first character.
CONFLICT = re.compile(r"([\[<])(\\*)(/?INST\]|/?s>|</?SYS>>|</?ROLE[ >])")
FIRST = "<s>"
_KINDS = {"user": ("[INST] ", " [/INST]"), "system": ("<<SYS>>", "<</SYS>>"), "assistant": (" ", " </s>")}


def escape(text: str) -> str:
    return CONFLICT.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return CONFLICT.sub(lambda m: m[1] + m[2][1:] + m[3], text)


def frame(role: str) -> tuple[str, str]:
    return _KINDS.get(role) or (f"<<ROLE {role.encode().hex()}>>", "<</ROLE>>")


class Mismatch(ValueError):
    """Text that the grammar doesn't take."""


def parse_turn(text: str, at: int) -> tuple[str, int, int, int]:
    """The turn that starts there: role, start and end of its text as written, end of the turn."""
    if text.startswith("<<ROLE ", at):
        close = text.find(">>", at)
        if close < 0:
            raise Mismatch("open role")
        role, start, stop = bytes.fromhex(text[at + 7 : close]).decode(), close + 2, "<</ROLE>>"
    else:
        role = next((k for k in ("user", "system", "assistant") if text.startswith(_KINDS[k][0], at)), None)
        if role is None:
            raise Mismatch(f"no turn starts with {text[at : at + 20]!r}")
        start, stop = at + len(_KINDS[role][0]), _KINDS[role][1]
    end = text.find(stop, start)
    if end < 0:
        raise Mismatch(f"{role} turn without end")
    return role, start, end, end + len(stop)


def render_turn(role: str | None, text: str | None) -> str:
    """The turn as the template writes it, escaped only where it doesn't read back the same otherwise."""
    role, text = role or "", text or ""
    head, tail = frame(role)
    for written in [escape(text)] if CONFLICT.search(text) else [text, escape(text)]:
        out = head + written + tail
        try:
            got, start, end, stop = parse_turn(out, 0)
        except (Mismatch, ValueError):
            continue
        if stop == len(out) and got == role and unescape(out[start:end]) == text:
            return out
    raise Mismatch(f"a {role!r} turn doesn't read back")


class Stream:
    """Parses a conversation that comes in pieces, cut anywhere."""

    def __init__(self) -> None:
        self.rest, self.started, self.size = "", False, 0

    def feed(self, piece: str) -> Iterator[tuple[str, str]]:
        """Role and text of the turns that the piece completes."""
        self.size += len(piece)
        self.rest += piece
        if not self.started:
            if len(self.rest) < len(FIRST):
                return
            if not self.rest.startswith(FIRST):
                raise Mismatch("no start")
            self.rest, self.started = self.rest[len(FIRST) :], True
        at = 0
        while at < len(self.rest):
            try:
                role, start, end, stop = parse_turn(self.rest, at)
            except Mismatch:
                break  # perhaps the turn goes on in the next piece
            yield role, unescape(self.rest[start:end])
            at = stop
        self.rest = self.rest[at:]

    def close(self) -> None:
        if self.rest or not self.started:
            raise Mismatch(f"what is left is no turn: {self.rest[:20]!r}")


def parse(text: str) -> list[tuple[str, str, tuple[int, int] | None]]:
    """The turns of a formatted conversation: role, text, and for an assistant the range of its text under the loss mask."""
    if not text.startswith(FIRST):
        raise Mismatch("no start")
    at, turns = len(FIRST), []
    while at < len(text):
        role, start, end, at = parse_turn(text, at)
        turns.append((role, unescape(text[start:end]), (start, end) if role == "assistant" else None))
    return turns


def format_turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text and segment, the turn as written. A conversation is "<s>" and its segments in order of
    (turn, role, text)."""
    rows = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            written = [render_turn(r.as_py(), t.as_py()) for r, t in zip(batch.column("role"), batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(written, pa.string())], names=[*batch.schema.names, "segment"])

    return rows.mapInArrow(run, ", ".join(f"{k} {v}" for k, v in kinds.items()) + ", segment string")


def read_back(turns: DataFrame) -> DataFrame:
    """For each conversation of format_turns(): what a parser finds in the written text alone."""
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()
        conv, state, stream, done = none, None, None, []

        def row() -> dict:
            stream.close()
            return {"conv_id": conv, "n_turns": state[0], "turns_sha256": state[1].hexdigest(), "loss_chars": state[2], "loss_sha256": state[3].hexdigest(), "formatted_chars": stream.size}

        def take(piece: str) -> None:
            for role, text in stream.feed(piece):
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                if role == "assistant":
                    state[2] += len(text)
                    state[3].update(text.encode())

        for batch in batches:
            done = []
            for c, written in zip(batch.column("conv_id").to_pylist(), batch.column("segment")):
                if conv is none or c != conv:
                    if conv is not none:
                        done.append(row())
                    conv, state, stream = c, [0, hashlib.sha256(), 0, hashlib.sha256()], Stream()
                    take(FIRST)
                take(written.as_py())
            yield pa.RecordBatch.from_pylist(done, schema=out)
        if conv is not none:
            yield pa.RecordBatch.from_pylist([row()], schema=out)

    out = pa.schema([("conv_id", _arrow(turns, "conv_id")), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    ordered = turns.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "segment")
    return ordered.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _arrow(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def formatted(turns: DataFrame) -> DataFrame:
    """conv_id and text of whole conversations, for those that fit a task."""
    parts = F.array_sort(F.collect_list(F.struct("turn", "role", "text", "segment")))
    return turns.groupBy("conv_id").agg(F.concat(F.lit(FIRST), F.array_join(F.transform(parts, lambda x: x["segment"]), "")).alias("text"))
