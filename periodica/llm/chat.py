"""Chat formatting by columnar byte assembly.

Every turn becomes ``<|im_start|>role\\ntext<|im_end|>\\n``; a conversation is its turns in order.
A batch of turns is laid out at once: the lengths of all segments give cumulative offsets, those
give the place of every byte, and markers and contents are copied into one preallocated Arrow
buffer. The loss mask of an assistant's turn is the span of its text, in code points of the piece.

Control strings inside a text are escaped reversibly: between ``<`` and ``|``, with any number of
backslashes between them, one more backslash is put, so ``<|`` stands nowhere but in markers. In a
role backslashes and line ends are written ``\\\\`` and ``\\n`` before.

Formatting needs no shuffle and no conversation as a whole, so one that holds a third of all rows is
formatted in pieces like any other. Only its digest is a chain over its turns in order: rows are
sorted within partitions and streamed, in the memory of one batch.

Nulls: NULL roles and texts are empty, NULL conversations are one, NULL turns come first; rows equal
in conversation and turn are ordered by what they look like. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from periodica.llm.common import PIECE, runs

START, AFTER_ROLE, END = b"<|im_start|>", b"\n", b"<|im_end|>\n"

TRAINED = "assistant"

_LESS, _BAR, _SLASH = b"<|\\"

_SOME = 4096  # turns read from a batch at once


def _escapes(data: np.ndarray, row_start: np.ndarray) -> np.ndarray:
    """Places of the bars before which a backslash is due; ``row_start`` by byte is asked lazily."""
    bars = np.flatnonzero(data == _BAR)
    at = bars - 1
    first = row_start[np.searchsorted(row_start, bars, side="right") - 1]
    while True:
        inside = at >= first
        step = inside & (data[np.maximum(at, 0)] == _SLASH)
        if not step.any():
            return bars[inside & (data[np.maximum(at, 0)] == _LESS)]
        at = at - step


def _text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column one after the other, and where each value begins and ends."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[
        column.offset : column.offset + len(column) + 1
    ]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _copy(out: np.ndarray, data: np.ndarray, ends: np.ndarray, to: np.ndarray, extra: np.ndarray):
    """Copies each value of ``data`` to its place ``to``, with a backslash at each of ``extra``."""
    for a in range(0, len(data), PIECE):
        b = min(a + PIECE, len(data))
        here = np.arange(a, b)
        row = np.searchsorted(ends, here, side="right") - 1
        before_row = np.searchsorted(extra, ends[row])
        shift = np.searchsorted(extra, here, side="right") - before_row
        out[to[row] + (here - ends[row]) + shift] = data[a:b]
    row = np.searchsorted(ends, extra, side="right") - 1
    before = np.arange(len(extra)) - np.searchsorted(extra, ends[row])
    out[to[row] + (extra - ends[row]) + before] = _SLASH


def _constant(out: np.ndarray, to: np.ndarray, piece: bytes) -> None:
    out[to[:, None] + np.arange(len(piece))] = np.frombuffer(piece, np.uint8)


def _code_points(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    first = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=first[1:])
    return first[ends[1:]] - first[ends[:-1]]


def _assembled(roles: pa.Array, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The formatted pieces, and per piece the code points before the text and in it."""
    n = len(roles)
    role, role_ends = _text_bytes(roles)
    text, text_ends = _text_bytes(texts)
    role_extra, text_extra = _escapes(role, role_ends), _escapes(text, text_ends)
    role_more = np.diff(np.searchsorted(role_extra, role_ends))
    text_more = np.diff(np.searchsorted(text_extra, text_ends))
    lengths = np.empty((n, 5), np.int64)
    lengths[:, 0] = len(START)
    lengths[:, 1] = np.diff(role_ends) + role_more
    lengths[:, 2] = len(AFTER_ROLE)
    lengths[:, 3] = np.diff(text_ends) + text_more
    lengths[:, 4] = len(END)
    offsets = np.zeros(n * 5 + 1, np.int64)
    np.cumsum(lengths.ravel(), out=offsets[1:])
    starts = offsets[:-1].reshape(n, 5)
    buffer = pa.allocate_buffer(int(offsets[-1]))
    out = np.frombuffer(buffer, np.uint8)
    _constant(out, starts[:, 0], START)
    _copy(out, role, role_ends, starts[:, 1], role_extra)
    _constant(out, starts[:, 2], AFTER_ROLE)
    _copy(out, text, text_ends, starts[:, 3], text_extra)
    _constant(out, starts[:, 4], END)
    pieces = pa.Array.from_buffers(
        pa.large_string(), n, [None, pa.py_buffer(offsets[::5].copy()), buffer]
    )
    header = len(START) + len(AFTER_ROLE) + _code_points(role, role_ends) + role_more
    return pieces.cast(pa.string()), header, _code_points(text, text_ends) + text_more


def _format(trained: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles, texts = batch.column("role"), batch.column("text")
            plain = pa.array(
                [(r or "").replace("\\", "\\\\").replace("\n", "\\n") for r in roles.to_pylist()],
                pa.string(),
            )
            sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_pylist()
            for a, b in runs([size + 64 for size in sizes], 4 * PIECE):
                part = batch.slice(a, b - a)
                pieces, header, body = _assembled(plain.slice(a, b - a), part.column("text"))
                mask = np.array([r != trained for r in part.column("role").to_pylist()], bool)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("conv_id"),
                        part.column("turn"),
                        pieces,
                        pa.array(header, pa.int64(), mask=mask),
                        pa.array(header + body, pa.int64(), mask=mask),
                    ],
                    ["conv_id", "turn", "piece", "loss_start", "loss_end"],
                )

    return run


def format_turns(turns: DataFrame, trained: str = TRAINED) -> DataFrame:
    """Per row of ``turns`` (conv_id, turn, role, text) its ``piece`` of the formatted conversation
    and the span ``loss_start`` to ``loss_end`` within it, NULL where nothing is to be learnt."""
    rows = turns.select(
        "conv_id", "turn", F.col("role").cast("string"), F.col("text").cast("string")
    )
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(
        _format(trained),
        f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, piece string, "
        "loss_start long, loss_end long",
    )


# --- reading back -----------------------------------------------------------------------------

_PIECE = re.compile(r"<\|im_start\|>([^\n]*)\n(.*)<\|im_end\|>\n", re.S)
_ESCAPED = re.compile(r"<(\\*)\\\|")
_ROLE = re.compile(r"\\(.)")


def _plain(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def parse(piece: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    match = _PIECE.fullmatch(piece)
    if not match:
        raise ValueError("no formatted turn")
    role = _ROLE.sub(lambda m: "\n" if m[1] == "n" else m[1], _plain(match[1]))
    return role, _plain(match[2])


class _Chain:
    """What is known of a conversation so far."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def add(self, piece: str, start: int | None, end: int | None) -> None:
        role, text = parse(piece)
        self.n_turns += 1
        self.chars += len(piece)
        self.turns.update(f"{role}\n{text}\n".encode())
        if start is not None:
            learnt = _plain(piece[start:end])
            self.loss_chars += len(learnt)
            self.loss.update(learnt.encode())

    def row(self) -> tuple:
        return (
            self.conv_id,
            self.n_turns,
            self.turns.hexdigest(),
            self.loss_chars,
            self.loss.hexdigest(),
            self.chars,
        )


_DIGEST = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digest(id_type: pa.DataType):
    schema = pa.schema(
        [
            ("conv_id", id_type),
            ("n_turns", pa.int64()),
            ("turns_sha256", pa.string()),
            ("loss_chars", pa.int64()),
            ("loss_sha256", pa.string()),
            ("formatted_chars", pa.int64()),
        ]
    )

    def out(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = None
        for batch in batches:
            done = []
            for a in range(0, batch.num_rows, _SOME):
                rows = batch.slice(a, _SOME).to_pydict()
                for conv, *turn in zip(
                    rows["conv_id"],
                    rows["piece"],
                    rows["loss_start"],
                    rows["loss_end"],
                    strict=True,
                ):
                    if chain is None or chain.conv_id != conv:
                        if chain:
                            done.append(chain.row())
                        chain = _Chain(conv)
                    chain.add(*turn)
            if done:
                yield out(done)
        if chain:
            yield out([chain.row()])

    return run


def digests(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read back from the pieces of ``format_turns``: the number of turns,
    the digest of roles and texts, code points and digest of the text under the loss mask, and the
    code points of the formatted conversation."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = dict(formatted.dtypes)["conv_id"]
    id_type = to_arrow_type(formatted.schema["conv_id"].dataType)
    return (
        formatted.repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "piece")
        .select("conv_id", "piece", "loss_start", "loss_end")
        .mapInArrow(_digest(id_type), f"conv_id {kind}, {_DIGEST}")
    )
