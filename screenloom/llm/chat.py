"""Chat formatting by event-sourced reconstruction of conversations."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turn: <|role|>\n text <|end|>\n. Every control string starts with an unescaped < or [.
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
TURN = re.compile(r"<\|((?:[^\\<\[|]|\\.)*)\|>\n((?:[^\\<\[|]|\\.)*)<\|end\|>\n", re.DOTALL)
RESETS = ("start", "edit", "regenerate")
#: Characters of finished messages that leave a task at a time.
MESSAGE_CHARS = 1 << 22


def escape(text: Column) -> Column:
    r"""A backslash goes before every \, <, [ and |, so no control string can stand inside a text."""
    return F.regexp_replace(text, r"([\\<\[|])", r"\\$1")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def turn_events(turns: DataFrame, delta_chars: int = 256) -> DataFrame:
    """Finished turns (conv_id, turn, role, text) as the log of their making: a start, then deltas of at most delta_chars.

    Turns are messages in order of turn (nulls first), then role and text; repeated rows are messages of their own.
    The log is partitioned by conversation.
    """
    same = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").withColumn("copy", F.row_number().over(same))
    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{delta_chars}}}"), F.lit(0))
    deltas = F.transform(pieces, lambda p, i: F.struct((i + 1).alias("seq"), F.lit("delta").alias("kind"), p.alias("text")))
    start = F.array(F.struct(F.lit(0).alias("seq"), F.lit("start").alias("kind"), F.lit("").alias("text")))
    return rows.select("conv_id", "turn", "copy", "role", F.explode(F.concat(start, deltas)).alias("e")).select("conv_id", "turn", "copy", "role", "e.*")


def fold(events: DataFrame, together: bool = False) -> DataFrame:
    """(conv_id, turn, copy, role, text): the final message of each (conv_id, turn, copy), in order.

    The log is partitioned by conversation (together: it is already) and sorted by turn, message and seq; deltas
    append; start, edit and regenerate replace all text so far by their own; the last role that is not null counts.
    Events of one seq apply by kind, then text. A message without events of text is empty; null texts are empty. A
    task holds one message at a time, so messages take memory for themselves only, and conversations none. An empty
    log gives no rows; further columns are ignored, whatever their names.
    """
    kinds = dict(events.dtypes)
    names = ("conv_id", "turn", "copy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, role, parts = None, "", []
        done: list[tuple] = []
        size = 0
        types: list[pa.DataType] = []
        for b in batches:
            types = [b.column(i).type for i in range(3)]
            for conv, turn, copy, kind, text, who in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if (conv, turn, copy) != key:
                    if key is not None:
                        done.append((*key, role, "".join(parts)))
                        size += len(done[-1][-1])
                    key, role, parts = (conv, turn, copy), "", []
                    if size > MESSAGE_CHARS:
                        yield _messages(done, types)
                        done, size = [], 0
                if kind in RESETS:
                    parts = []
                parts.append(text or "")
                role = role if who is None else who
        if key is not None:
            done.append((*key, role, "".join(parts)))
            yield _messages(done, types)

    rows = events.select(*names, "kind", "text", "role", "seq")
    rows = rows if together else rows.repartition("conv_id")
    rows = rows.sortWithinPartitions(*names, "seq", "kind", "text")
    return rows.drop("seq").mapInArrow(run, ", ".join(f"{n} {kinds[n]}" for n in names) + ", role string, text string")


def _messages(done: list[tuple], types: list[pa.DataType]) -> pa.RecordBatch:
    cols = zip(*done, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [*types, pa.string(), pa.string()], strict=True)], names=["conv_id", "turn", "copy", "role", "text"])


def render(messages: DataFrame, trained: str = "assistant") -> DataFrame:
    """(conv_id, turn, copy, segment, mask_start, mask_chars): a conversation is its segments in order.

    The loss mask of a segment covers its escaped text if the role is the trained one, else nothing.
    """
    role, text = escape(F.col("role")), escape(F.col("text"))
    own = F.col("role") == trained
    return messages.select("conv_id", "turn", "copy", F.concat(F.lit(OPEN), role, F.lit(CLOSE), text, F.lit(END)).alias("segment"), F.when(own, F.length(role) + len(OPEN + CLOSE)).otherwise(0).cast("long").alias("mask_start"), F.when(own, F.length(text)).otherwise(0).cast("long").alias("mask_chars"))


def read_back(segments: DataFrame, together: bool = False) -> DataFrame:
    """Per conversation, parsed from the rendered segments: turns, their digest, the text under the mask, its digest.

    together: the segments are partitioned by conversation already. A conversation's segments stream through one task in order; only digests and counts are held, so a conversation
    of any length needs constant memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        out: list[tuple] = []

        def close() -> None:
            if state:
                out.append((now[0], state["n"], state["turns"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["all"]))

        for b in batches:
            for conv, segment, start, length in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if now != (conv,):
                    close()
                    now, state = (conv,), {"n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "all": 0}
                m = TURN.fullmatch(segment)
                if not m:
                    raise ValueError(f"a segment of conversation {conv} cannot be parsed")
                role, text = unescape(m[1]), unescape(m[2])
                state["n"] += 1
                state["all"] += len(segment)
                state["turns"].update(f"{role}\n{text}\n".encode())
                if length:
                    masked = unescape(segment[start : start + length])
                    state["chars"] += len(masked)
                    state["loss"].update(masked.encode())
            if len(out) > 4096:
                yield _rows(out)
                out = []
        close()
        yield _rows(out)

    rows = segments.select("conv_id", "segment", "mask_start", "mask_chars", "turn", "copy")
    ordered = (rows if together else rows.repartition("conv_id")).sortWithinPartitions("conv_id", "turn", "copy")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True)) or [[]] * 6
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=list(names))
