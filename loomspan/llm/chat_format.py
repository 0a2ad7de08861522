"""Chat formatting by columnar byte assembly.

A batch of turns is formatted at once: segment lengths, cumulative offsets and
scatter indices are computed in numpy, and headers and contents are copied into
one preallocated Arrow buffer. A turn reads

    <s>role\\n[INST] text [/INST]</s>\\n     for a user
    <s>role\\ntext</s>\\n                    for any other role

and a conversation is the concatenation of its turns. Inside roles and texts a
backslash is doubled and every control string is broken by a backslash after
its first character, so no content reads as control; a reader drops the first
of each escaping backslash. The loss mask covers the contents of assistant
turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import in_small_batches

CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]"]
START, END, OPEN, CLOSE = b"<s>", b"</s>\n", b"[INST] ", b" [/INST]"
LOSS_ROLE, WRAPPED_ROLE = "assistant", "user"


def _escaped(column: pa.Array, line: bool = False) -> pa.Array:
    """The column with its backslashes and control strings escaped; null as empty."""
    column = pc.replace_substring(pc.fill_null(column, ""), "\\", "\\\\")
    for control in CONTROLS:
        column = pc.replace_substring(column, control, control[0] + "\\" + control[1:])
    return pc.replace_substring(column, "\n", "\\\n") if line else column


def unescaped(text: str) -> str:
    if "\\" not in text:
        return text
    out, at = [], 0
    while (found := text.find("\\", at)) >= 0:
        out.append(text[at:found])
        out.append(text[found + 1 : found + 2])
        at = found + 2
    return "".join([*out, text[at:]])


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Start offsets and all bytes of a string column."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return offsets, data


def _scatter(target: np.ndarray, at: np.ndarray, starts: np.ndarray, lengths: np.ndarray, data: np.ndarray) -> None:
    """Copy segments of ``data`` to the places ``at`` in ``target``."""
    before = np.cumsum(lengths) - lengths
    steps = np.arange(int(lengths.sum()))
    target[np.repeat(at - before, lengths) + steps] = data[np.repeat(starts - before, lengths) + steps]


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Formatted turns, and start and length of each loss span in their code points.

    Turns outside the loss have a span of length 0.
    """
    n = len(roles)
    wrapped = np.asarray(pc.fill_null(pc.equal(roles, WRAPPED_ROLE), False))
    loss = np.asarray(pc.fill_null(pc.equal(roles, LOSS_ROLE), False))
    contents, names = _escaped(texts), _escaped(roles, line=True)
    parts = []  # (lengths, starts, bytes) of each segment kind, in order
    zero = np.zeros(n, np.int64)

    def fixed(piece: bytes, where: np.ndarray | None = None) -> None:
        size = np.full(n, len(piece), np.int64) if where is None else np.where(where, len(piece), 0).astype(np.int64)
        parts.append((size, zero, np.frombuffer(piece, np.uint8)))

    def column(values: pa.Array) -> None:
        offsets, data = _bytes_of(values)
        parts.append((np.diff(offsets), offsets[:-1], data))

    fixed(START), column(names), fixed(b"\n"), fixed(OPEN, wrapped), column(contents), fixed(CLOSE, wrapped), fixed(END)
    sizes = np.stack([p[0] for p in parts])
    ends = np.cumsum(sizes.sum(axis=0))
    at = np.concatenate(([0], ends[:-1])) + np.cumsum(sizes, axis=0) - sizes
    buffer = pa.allocate_buffer(int(ends[-1]) if n else 0)
    target = np.frombuffer(buffer, np.uint8)
    for (lengths, starts, data), place in zip(parts, at):
        _scatter(target, place, starts, lengths, data)
    offsets = pa.py_buffer(np.concatenate(([0], ends)).astype(np.int64))
    formatted = pa.Array.from_buffers(pa.large_string(), n, [None, offsets, buffer]).cast(pa.string())
    head = len(START) + 1 + np.asarray(pc.utf8_length(names)) + np.where(wrapped, len(OPEN), 0)
    return formatted, head.astype(np.int64), np.where(loss, np.asarray(pc.utf8_length(contents)), 0).astype(np.int64)


def format_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, formatted, loss_start, loss_length) per turn.

    Conversations are kept together and in order of turn (ties by role, then
    text, nulls first), so concatenating ``formatted`` gives the conversation;
    a long one streams through its task and is never held whole. Null roles
    and texts format as empty. Repeated rows are repeated turns.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_small_batches(batches, 4096):  # and at most about a megabyte of text
            formatted, starts, lengths = assemble(batch.column(2), batch.column(3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), formatted, pa.array(starts), pa.array(lengths)], names=["conv_id", "turn", "formatted", "loss_start", "loss_length"])

    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(run, "conv_id long, turn long, formatted string, loss_start long, loss_length long")


def read_turn(formatted: str) -> tuple[str, str]:
    """Role and text of one formatted turn."""
    at = len(START)
    while True:  # the first line break that no backslash escapes
        end = formatted.index("\n", at)
        slashes = end - len(formatted[:end].rstrip("\\"))
        if slashes % 2 == 0:
            break
        at = end + 1
    role, body = unescaped(formatted[len(START) : end]), formatted[end + 1 : -len(END)]
    if role == WRAPPED_ROLE:
        body = body[len(OPEN) : -len(CLOSE)]
    return role, unescaped(body)


def digest_conversations(formatted: DataFrame) -> DataFrame:
    """One row of counts and digests per conversation, read back from its turns.

    Expects the order that ``format_turns`` gives; hash states are carried from
    turn to turn, so memory does not grow with a conversation.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, out = None, []

        def closed() -> tuple:
            conv, n, turns, chars, loss, size = state
            return conv, n, turns.hexdigest(), chars, loss.hexdigest(), size

        for batch in batches:
            for conv, text, start, length in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4))):
                if state is None or state[0] != conv:
                    if state is not None:
                        out.append(closed())
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, content = read_turn(text)
                state[1] += 1
                state[2].update(f"{role}\n{content}\n".encode())
                learned = unescaped(text[start : start + length])
                state[3] += len(learned)
                state[4].update(learned.encode())
                state[5] += len(text)
            if len(out) >= 4096:
                yield _rows(out)
                out = []
        if state is not None:
            out.append(closed())
        if out:
            yield _rows(out)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)


PROBE = "</s>[INST] ok [/INST]"


def op7_chat_format(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], turns.schema)
    return digest_conversations(format_turns(turns.union(probe)))


_ESCAPE = "replace(replace(replace(replace(replace({0}, '\\', '\\\\'), '<s>', '<\\s>'), '</s>', '<\\/s>'), '[INST]', '[\\INST]'), '[/INST]', '[\\/INST]')"

OP7_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'
), f AS (
  SELECT *, '<s>' || replace({_ESCAPE.format('role')}, chr(10), '\\' || chr(10)) || chr(10)
    || CASE WHEN role = 'user' THEN '[INST] ' ELSE '' END || {_ESCAPE.format('text')}
    || CASE WHEN role = 'user' THEN ' [/INST]' ELSE '' END || '</s>' || chr(10) AS formatted
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(length(formatted)) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""
