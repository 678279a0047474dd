"""Packing by concatenating and cutting: fixed windows over the corpus as one row of tokens.

First pass: tasks encode documents, end each with ``end_id`` and store their tokens in rows of
bounded size, each with the number of tokens that its partition has before it. The partitions'
totals, one row each, are summed up to give every partition its offset in the whole. Second pass:
each token now has its place, in window ``place // width``. The windows that lie within a stored row
are cut from it where it is read; what stands at the two ends of a row is a boundary record, and
those alone are shuffled and merged by window. Which is which depends on the stored rows only, so it
doesn't matter how they are dealt to tasks. A window holds ``width`` tokens wherever its documents
come from, so no group can grow. Only the last window of all is not full; it is padded, unless its
length is a power of two.

Encoding: a blank between two characters that are no white space always starts a new pre-token in
byte-level BPE, so a text is cut there, where it allows also around line breaks and before commas
and stops that end a Latin word, and every distinct stretch is encoded once, as long as it
stays in a worker's bounded memory. Texts go through the same way at any length. The vocabulary is
read by the driver and broadcast; its size is fixed. The offsets are broadcast too, a row of two
numbers for each partition of the input. A text and its ids are in a task's memory once.

Nulls: a NULL text is empty and so packed as ``end_id`` alone; ids may be NULL and may repeat, each
row is packed for itself. An empty table gives an empty result, further columns are ignored. Special
tokens written in a text are ordinary text.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from periodica.llm.common import stored

#: stretches that a worker remembers, and characters that they may have together
REMEMBERED, REMEMBERED_CHARS = 1 << 20, 1 << 25

#: stretches that are encoded as one text
TOGETHER = 1 << 11

#: characters whose stretches are encoded together
BLOCK = 1 << 22

#: tokens of a row of the first pass; longer documents go on in further rows
ROW = 1 << 18

_APART = re.compile(r"(?<=\S) (?=\S)")
_OTHER_BLANK = re.compile(r" (?:(?=\s)|(?<=\s ))")
#: a comma or stop after anything but a Latin letter, with which it may be one pre-token
_LOOSE = re.compile(r"[.,] (?<![A-Za-zÀ-ÖØ-öø-ÿ][.,] )")


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def stretches(text: str) -> list[str]:
    """The parts of a text between blanks that have solid characters on both sides."""
    if text[:1] == " " or text[-1:] == " " or _OTHER_BLANK.search(text):
        return _APART.split(text)
    return text.split(" ")


def _led(part: str) -> str:
    """A part with what leads it in its text: a blank, or nothing where a line break marks it."""
    return part[1:] if part[0] == "\n" else f" {part}"


def parts_of(text: str) -> list[str]:
    """Its stretches, or shorter parts: line breaks begin new ones, and commas and stops that end
    a word are parts of their own. A line break in front marks a part without a blank."""
    flat = text.replace("\n", " ")
    # other white space is not printable, and blanks must have solid characters on both sides
    if "  " in flat or flat[:1] in " " or flat[-1] == " " or not flat.isprintable() or _LOOSE.search(flat):
        return stretches(text)
    lines = text.replace("\n", " \n\n") if "\n" in text else text
    return lines.replace(", ", " \n, ").replace(". ", " \n. ").split(" ")


class Encoder:
    """Ids of texts by a tokenizer of the ``tokenizers`` library, each part encoded once.

    A part within a text is known as text, with its blank left out, and encoded next to others,
    as it would be there; where one ends is seen from the bytes of the tokens. The first part of
    a text, which has no blank, and a last one that ends in white space are encoded alone; these
    are known as bytes.
    """

    def __init__(self, vocabulary: bytes):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(vocabulary)
        self.tokenizer.encode_special_tokens = True
        tokens = self.tokenizer.get_vocab(with_added_tokens=False)
        self.token_bytes = np.zeros(max(tokens.values(), default=-1) + 1, np.int64)
        for token, i in tokens.items():  # a character stands for a byte
            self.token_bytes[i] = len(token)
        self._forget()

    def _forget(self) -> None:
        self.number: defaultdict = defaultdict()
        self.number.default_factory = self.number.__len__
        self.chars = 0
        self.ids = np.empty(0, np.uint32)
        self.starts, self.sizes = np.empty(0, np.int64), np.empty(0, np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.number) > REMEMBERED or self.chars > REMEMBERED_CHARS:
            self._forget()
        known, number = len(self.number), self.number.__getitem__
        keys = []
        for text in texts:
            parts: list = parts_of(text)
            if len(parts) > 1 and parts[-1][-1].isspace():
                parts[-1] = _led(parts[-1]).encode()
            parts[0] = parts[0].encode()
            keys.append(np.fromiter(map(number, parts), np.int64, len(parts)))
        self._learn(list(islice(reversed(self.number), len(self.number) - known))[::-1])
        return [self._gather(k) for k in keys]

    def _learn(self, new: list[str | bytes]) -> None:
        inside = [w for w in new if isinstance(w, str)]
        alone = [w.decode() for w in new if isinstance(w, bytes)]
        self.chars += sum(map(len, new))
        among = [self._together(inside[a : a + TOGETHER]) for a in range(0, len(inside), TOGETHER)]
        single = [np.array(e.ids, np.uint32) for e in self._encoded(alone)]
        ids = [i for i, _ in among] + single
        sizes = [n for _, n in among] + [np.array([len(i) for i in single], np.int64)]
        if not new:
            return
        sizes = np.concatenate(sizes)
        starts = len(self.ids) + np.cumsum(sizes) - sizes
        # back in the order of their numbers
        order = np.argsort([isinstance(w, bytes) for w in new], kind="stable")
        place = np.empty(len(new), np.int64)
        place[order] = np.arange(len(new))
        self.ids = np.concatenate([self.ids, *ids])
        self.starts = np.append(self.starts, starts[place])
        self.sizes = np.append(self.sizes, sizes[place])

    def _together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of neighbouring stretches, and how many each has."""
        led = [_led(w) for w in words]
        (found,) = self._encoded(["".join(led)])
        ids = np.array(found.ids, np.uint32)
        reached = np.cumsum(self.token_bytes[ids])
        ends = np.cumsum([len(w) if w.isascii() else len(w.encode()) for w in led])
        last = np.searchsorted(reached, ends)
        return ids, np.diff(last, prepend=-1)

    def _encoded(self, texts: list[str]) -> list:
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)

    def _gather(self, keys: np.ndarray) -> np.ndarray:
        lengths = self.sizes[keys]
        shift = np.repeat(self.starts[keys] - (np.cumsum(lengths) - lengths), lengths)
        return self.ids[shift + np.arange(len(shift))]


_encoders: dict[int, Encoder] = {}


def _encoder(vocabulary: bytes) -> Encoder:
    """One encoder a worker, which outlives its tasks."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    key = hash(vocabulary)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(vocabulary)
    return _encoders[key]


def _pieces(text: str, limit: int) -> Iterator[str]:
    """A text in pieces of about ``limit`` characters, cut before a blank that starts a stretch."""
    start = 0
    while len(text) - start > limit:
        cut = _APART.search(text, start + limit)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Runs of (id, piece, whether the text ends here) of bounded size."""
    block, size = [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            pieces = list(_pieces(text.as_py() or "", BLOCK))
            for i, piece in enumerate(pieces):
                if block and size + len(piece) > BLOCK:
                    yield block
                    block, size = [], 0
                block.append((doc_id.as_py(), piece, i == len(pieces) - 1))
                size += len(piece) + 64
    if block:
        yield block


def _piece(id_type: pa.DataType, *more: str) -> pa.DataType:
    fields = [pa.field(n, pa.int64()) for n in ("start", "length", "doc_tokens", *more)]
    return pa.list_(pa.struct([pa.field("id", id_type), *fields]))


def _piece_sql(kind: str, *more: str) -> str:
    names = ("start", "length", "doc_tokens", *more)
    return f"array<struct<id:{kind},{','.join(f'{n}:bigint' for n in names)}>>"


def _pieces_array(kind: pa.DataType, lists: list[tuple]) -> pa.Array:
    """Lists of (ids, arrays of numbers) as one column."""
    offsets = np.zeros(len(lists) + 1, np.int32)
    np.cumsum([len(x[0]) for x in lists], out=offsets[1:])
    fields = list(kind.value_type)
    ids = pa.array([i for x in lists for i in x[0]], fields[0].type)
    numbers = [pa.array(np.concatenate([x[k] for x in lists])) for k in range(1, len(fields))]
    structs = pa.StructArray.from_arrays([ids, *numbers], fields=fields)
    return pa.ListArray.from_arrays(pa.array(offsets), structs)


def _tokens(
    docs: DataFrame, vocabulary: bytes, end_id: int, row: int, id_col: str, text_col: str
) -> DataFrame:
    """Rows of at most ``row`` tokens of one or several documents, in the partition's order."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType
    pieces = _piece(to_arrow_type(kind))
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Documents as (id, tokens)."""
        encoder, held = _encoder(sent.value), []
        for block in _blocks(batches):
            texts = [piece for _, piece, _ in block]
            for (doc_id, _, last), ids in zip(block, encoder.encode(texts), strict=True):
                held.append(ids)
                if last:
                    yield doc_id, np.concatenate([*held, np.array([end_id], np.uint32)])
                    held = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        found: list[tuple] = []
        tokens: list[np.ndarray] = []
        n = 0

        def full() -> pa.RecordBatch:
            ids, *numbers = zip(*found, strict=True)
            flat = np.concatenate(tokens)
            # two bytes a token where they are enough
            kept = flat.astype("<u2" if flat.max() < 1 << 16 else "<u4")
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([before], pa.int64()),
                    pa.array([n], pa.int64()),
                    pa.array([kept.tobytes()], pa.binary()),
                    _pieces_array(pieces, [(ids, *[np.array(x, np.int64) for x in numbers])]),
                ],
                ["part", "before", "n", "tokens", "pieces"],
            )

        for doc_id, ids in encoded(batches):
            start = 0
            while start < len(ids):
                size = min(row - n, len(ids) - start)
                found.append((doc_id, start, size, len(ids)))
                tokens.append(ids[start : start + size])
                start += size
                n += size
                if n == row:
                    yield full()
                    before += n
                    found, tokens, n = [], [], 0
        if n:
            yield full()

    return rows.mapInArrow(
        run,
        "part int, before long, n long, tokens binary, "
        f"pieces {_piece_sql(kind.simpleString())}",
    )


def _cut(place: int, starts: np.ndarray, lengths: np.ndarray, width: int) -> tuple:
    """Cuts the pieces of a row that begins at ``place`` where windows end.

    Per new piece the number of its old one, its start there, its length, its window and offset.
    """
    n = int(lengths.sum())
    begins = np.cumsum(lengths) - lengths
    at = np.union1d(begins, np.arange(-place % width, n, width))
    old = np.searchsorted(begins, at, side="right") - 1
    size = np.diff(at, append=n)
    window, offset = np.divmod(place + at, width)
    return old, starts[old] + at - begins[old], size, window, offset


def _cutter(width: int, whole: bool, id_type: pa.DataType):
    """The windows that lie within a row, or the boundary records at its ends."""
    kind = _piece(id_type, "offset")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in ("place", "n", "head", "skip", "tokens")}
                listed = batch.column("pieces").slice(i, 1).flatten()
                ids = listed.field(0)
                starts, lengths, totals = (
                    listed.field(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3)
                )
                head, skip = row["head"], row["skip"]
                stored_as = f"<u{len(row['tokens']) // (row['n'] - skip)}"
                tokens = np.frombuffer(row["tokens"], stored_as).astype("<u4")
                old, start, size, window, offset = _cut(row["place"], starts, lengths, width)
                firsts = np.flatnonzero(np.diff(window, prepend=-1))
                ends = np.append(firsts[1:], len(window))
                to = np.cumsum(size)
                out = []
                for a, b in zip(firsts.tolist(), ends.tolist(), strict=True):
                    if (int(to[b - 1] - to[a] + size[a]) == width) != whole:
                        continue
                    begin, end = int(to[a] - size[a]), int(to[b - 1])
                    gone = skip if begin >= head else 0
                    data = tokens[begin - gone : end - gone].tobytes()
                    some = ids.take(pa.array(old[a:b])).to_pylist()
                    numbers = (start[a:b], size[a:b], totals[old[a:b]], offset[a:b])
                    out.append((int(window[a]), int(offset[a]), data, (some, *numbers)))
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([r[0] for r in out], pa.int64()),
                            pa.array([r[1] for r in out], pa.int64()),
                            pa.array([r[2] for r in out], pa.binary()),
                            _pieces_array(kind, [r[3] for r in out]),
                        ],
                        ["sequence_id", "at", "tokens", "pieces"],
                    )

    return cut


def _outer(placed: DataFrame, width: int) -> DataFrame:
    """Rows with their first ``head`` tokens and those after the last window that ends in them.

    ``skip`` tokens between the two are left out, whole windows; rows of nothing else go.
    """
    width, n = F.lit(width).cast("long"), F.col("n")
    head = F.pmod(-F.col("place"), width)
    tail = F.pmod(F.col("place") + n, width)
    size = (F.octet_length("tokens") / n).cast("long")
    ends = F.concat(
        F.substring("tokens", F.lit(1), (head * size).cast("int")),
        F.substring("tokens", ((n - tail) * size + 1).cast("int"), (tail * size).cast("int")),
    )
    skip = F.greatest(n - head - tail, F.lit(0).cast("long"))
    rows = placed.withColumns({"head": head, "skip": skip}).where("skip < n")
    return rows.withColumn("tokens", F.when(F.col("skip") > 0, ends).otherwise(F.col("tokens")))


def _merged(fragments: DataFrame, width: int, pad_id: int) -> DataFrame:
    """Boundary records put together by window; the last window of all is padded."""
    listed = F.array_sort(F.collect_list(F.struct("at", "tokens", "pieces")))
    joined = fragments.groupBy("sequence_id").agg(listed.alias("parts")).select(
        "sequence_id",
        F.expr("aggregate(parts, x'', (all, p) -> concat(all, p.tokens))").alias("tokens"),
        F.expr("flatten(transform(parts, p -> p.pieces))").alias("pieces"),
    )
    n = F.octet_length("tokens") / 4
    short = (n < width) & (F.log2(n) != F.floor(F.log2(n)))
    pad = F.unhex(F.repeat(F.lit(pad_id.to_bytes(4, "little").hex()), (width - n).cast("int")))
    return joined.withColumn("n_tokens", n.cast("long")).withColumn(
        "tokens", F.when(short, F.concat("tokens", pad)).otherwise(F.col("tokens"))
    )


def pack(
    docs: DataFrame,
    vocabulary: bytes,
    width: int = 2048,
    end_id: int = 1,
    pad_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    row: int = ROW,
) -> DataFrame:
    """Per sequence ``sequence_id``, ``n_tokens``, ``tokens`` and ``pieces``.

    ``tokens`` holds ids as little-endian 32 bits, padded after the first ``n_tokens``. ``pieces``
    lists, in order, the document (``id``), the ``start`` of the piece in it, its ``length``, the
    document's ``doc_tokens`` and the ``offset`` here.
    """
    rows = stored(_tokens(docs, vocabulary, end_id, row, id_col, text_col), "packing-tokens")
    kind = docs.schema[id_col].dataType
    # one row per partition
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("part").agg(F.sum("n").alias("total"))
    offsets = totals.select(
        "part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("offset")
    )
    placed = rows.join(F.broadcast(offsets), "part").select(
        (F.col("before") + F.col("offset")).alias("place"), "n", "tokens", "pieces"
    )
    form = (
        "sequence_id long, at long, tokens binary, "
        f"pieces {_piece_sql(kind.simpleString(), 'offset')}"
    )
    all_tokens = placed.withColumns({"head": F.col("n"), "skip": F.lit(0).cast("long")})
    inner, ends = (
        rows.mapInArrow(_cutter(width, whole, to_arrow_type(kind)), form)
        for rows, whole in ((all_tokens, True), (_outer(placed, width), False))
    )
    columns = ("sequence_id", "n_tokens", "tokens", "pieces")
    complete = inner.withColumn("n_tokens", F.lit(width).cast("long"))
    return complete.select(*columns).unionByName(_merged(ends, width, pad_id).select(*columns))


def pieces(sequences: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per piece its document, ``start``, ``length``, ``ids`` (as bytes), ``doc_tokens``,
    ``sequence_id`` and ``offset``."""
    each = sequences.select("sequence_id", "tokens", F.explode("pieces").alias("piece"))
    first, size = (F.col("piece.offset") * 4 + 1).cast("int"), (F.col("piece.length") * 4).cast("int")
    return each.select(
        F.col("piece.id").alias(id_col),
        "piece.start",
        "piece.length",
        F.substring("tokens", first, size).alias("ids"),
        "piece.doc_tokens",
        "sequence_id",
        "piece.offset",
    )
