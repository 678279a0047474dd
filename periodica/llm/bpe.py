"""Byte-level BPE: each distinct word is encoded once for the whole corpus, and decoded by a join.

Tasks take documents in blocks of bounded size, split them into pre-tokens and keep each word of a
block once, with the places where it stands. The distinct words are shuffled by their hash, so all
blocks' copies of a word meet, and it is encoded once. A bucket of words is read in batches, so it may
grow with the corpus: its task remembers words up to a bound (``REMEMBERED``); words not met for long
are then forgotten, and encoded again if they come back. The ids of a word go back to the blocks that
hold it,
and the documents are put together by position. The places themselves don't move: they lie in a
table bucketed by block, next to which the ids of the block's words are dealt. Decoding joins ids
with the table of the tokens' bytes, whose size the vocabulary fixes.

Words and places are kept packed (numbers by falling frequency, Zstandard), about 1.5 bytes a
pre-token. A word is as long as its text lets it be; merging takes n log n steps. The vocabulary's
ranks come from a file read by the driver; its 50,000 or so entries are the only broadcast.

Nulls: a NULL text is empty and gives no ids; ids of documents may be NULL and may repeat, each row
is encoded for itself. An empty table gives an empty result, further columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
import uuid
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from periodica.llm.common import give_back, runs, shared_dir

#: characters of a block; a longer text is a block of its own
BLOCK = 1 << 25

#: pre-tokens packed together
RUN = 1 << 17

#: pre-tokens of a block that are counted and numbered at once
STEP = 1 << 20

#: bytes of words and ids that a task remembers in a bucket; as much again of older ones
REMEMBERED = 1 << 27
_ENTRY = 200  # bytes of a remembered word besides

#: bytes of words whose ids are given back together
_AT_ONCE = 1 << 24


def read_ranks(path: str) -> bytes:
    """The vocabulary file, lines of a token in base64 and its rank."""
    with open(path, "rb") as file:
        return file.read()


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    rows = (line.split() for line in raw.splitlines() if line.strip())
    return {base64.b64decode(token): int(rank) for token, rank in rows}


# --- merging ----------------------------------------------------------------------------------


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token: of neighbours the pair of lowest rank, leftmost first, is merged."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    if len(word) > 48:
        return _encode_long(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    none = len(ranks) + (1 << 40)
    rank = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
    while rank:
        best = min(rank)
        if best == none:
            break
        i = rank.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del rank[i]
        if i < len(rank):
            rank[i] = ranks.get(parts[i] + parts[i + 1], none)
        if i:
            rank[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
    return [ranks[p] for p in parts]


def _encode_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a queue of pairs over a linked list, for words of any length."""
    n = len(word)
    end = list(range(1, n + 1))  # of the part that starts here
    before = list(range(-1, n - 1))  # start of the part before
    gone = bytearray(n)
    queue: list[tuple[int, int, int, int]] = []

    def offer(start: int) -> None:
        middle = end[start]
        if middle < n:
            rank = ranks.get(word[start : end[middle]])
            if rank is not None:
                heapq.heappush(queue, (rank, start, middle, end[middle]))

    for i in range(n - 1):
        offer(i)
    while queue:
        _, start, middle, stop = heapq.heappop(queue)
        if gone[start] or end[start] != middle or gone[middle] or end[middle] != stop:
            continue
        end[start] = stop
        gone[middle] = 1
        if stop < n:
            before[stop] = start
        offer(start)
        if before[start] >= 0:
            offer(before[start])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


# --- packing ----------------------------------------------------------------------------------


def _pack(numbers: np.ndarray) -> bytes:
    """Four planes of bytes, compressed; small numbers leave the upper ones empty."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def _unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


def _ends(lengths: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def _gather(values: np.ndarray, offsets: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The variable-length entries of ``keys`` one after the other."""
    lengths = np.diff(offsets)[keys]
    shift = np.repeat(offsets[keys] - (np.cumsum(lengths) - lengths), lengths)
    return values[shift + np.arange(len(shift))]


# --- tasks ------------------------------------------------------------------------------------


def _tokeniser(pattern: str, buckets: int, block_chars: int, id_type: pa.DataType) -> Callable:
    """Splits documents: per block rows of places (ids, counts, places) and rows of words."""

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern).findall
        for ids, texts in _blocks(batches, block_chars):
            block = uuid.uuid4().int >> 65
            numbers: defaultdict = defaultdict()
            numbers.default_factory = numbers.__len__
            number = numbers.__getitem__
            # one text at a time is a Python string
            places = [np.fromiter(map(number, find(t.as_py() or "")), np.uint32) for t in texts]
            counts = np.fromiter(map(len, places), np.int64, len(places))
            words = np.array(list(numbers), object)
            numbers.clear()
            flat = np.concatenate(places) if places else np.empty(0, np.uint32)
            del places
            parts = [flat[a : a + STEP] for a in range(0, len(flat), STEP)]
            times = np.zeros(len(words), np.int64)
            for part in parts:
                times += np.bincount(part, minlength=len(words))
            order = np.argsort(-times, kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            for part in parts:
                part[:] = rank[part]
            ends = _ends(counts)
            # many empty texts make no run too long either
            for a, b in runs((counts + 1).tolist(), RUN):
                yield _rows(
                    id_type,
                    block=[block],
                    ids=[ids[a:b]],
                    counts=[counts[a:b].tolist()],
                    places=[_pack(flat[ends[a] : ends[b]])],
                )
            del flat, parts, times, rank
            words = [w.encode() for w in words[order]]
            yield _word_rows(id_type, block, words, buckets)
            del words, order
            give_back()

    return tokenise


def _blocks(
    batches: Iterator[pa.RecordBatch], limit: int
) -> Iterator[tuple[list, list[pa.StringScalar]]]:
    """Ids and texts, still in Arrow, with at most ``limit`` characters in sum; a longer text alone."""
    ids: list = []
    texts: list[pa.StringScalar] = []
    size = 0
    for batch in batches:
        chars = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_pylist()
        for doc_id, text, n in zip(
            batch.column(0).to_pylist(), batch.column(1), chars, strict=True
        ):
            if texts and size + n > limit:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(doc_id)
            texts.append(text)
            size += n + 16
    if texts:
        yield ids, texts


def _schema(id_type: pa.DataType) -> pa.Schema:
    return pa.schema(
        [
            ("block", pa.int64()),
            ("ids", pa.list_(id_type)),
            ("counts", pa.list_(pa.int64())),
            ("places", pa.binary()),
            ("bucket", pa.int32()),
            ("words", pa.binary()),
            ("lengths", pa.binary()),
            ("numbers", pa.binary()),
        ]
    )


def _rows(id_type: pa.DataType, **columns: list) -> pa.RecordBatch:
    n = len(columns["block"])
    schema = _schema(id_type)
    return pa.RecordBatch.from_arrays(
        [pa.array(columns.get(f.name, [None] * n), f.type) for f in schema], schema=schema
    )


def _word_rows(id_type: pa.DataType, block: int, words: list[bytes], buckets: int):
    of = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
    order = np.argsort(of, kind="stable")
    cuts = np.searchsorted(of[order], np.arange(buckets + 1))
    lengths = np.fromiter(map(len, words), np.uint32, len(words))
    pack = zstandard.ZstdCompressor(level=3).compress
    out = defaultdict(list)
    for bucket in np.flatnonzero(np.diff(cuts)):
        mine = order[cuts[bucket] : cuts[bucket + 1]]
        out["block"].append(block)
        out["bucket"].append(int(bucket))
        out["words"].append(pack(b"".join([words[i] for i in mine])))
        out["lengths"].append(_pack(lengths[mine]))
        out["numbers"].append(_pack(np.diff(mine, prepend=0)))
    if not out:
        out["block"] = []
    return _rows(id_type, **out)


_IDS_ROWS = "block long, numbers binary, lengths binary, word_ids binary"
_IDS_SCHEMA = pa.schema(
    [("block", pa.int64())]
    + [(n, pa.binary()) for n in ("numbers", "lengths", "word_ids")]
)


def _encoder(vocabulary, remembered: int = REMEMBERED) -> Callable:
    """Encodes the words of a bucket, each distinct one once while it is remembered, and gives each
    block its ids. A bucket comes in batches and is never held as a whole."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = _ranks(vocabulary)
        known, older, room = {}, {}, remembered
        unpack = zstandard.ZstdDecompressor().decompress
        out, held = defaultdict(list), 0
        for batch in batches:
            for row in (dict(zip(batch.schema.names, r, strict=True)) for r in _by_row(batch)):
                data, ends = unpack(row["words"]), _ends(_unpack(row["lengths"])).tolist()
                found = []
                for a, b in zip(ends, ends[1:], strict=False):
                    word = data[a:b]
                    ids = known.get(word)
                    if ids is None:
                        ids = older.pop(word, None)
                        if ids is None:
                            ids = encode_word(word, ranks)
                        if room <= 0:
                            known, older, room = {}, known, remembered
                        known[word] = ids
                        room -= _ENTRY + len(word) + 8 * len(ids)
                    found.append(ids)
                flat = np.fromiter(chain.from_iterable(found), np.uint32)
                out["block"].append(row["block"])
                out["numbers"].append(row["numbers"])
                out["lengths"].append(_pack(np.fromiter(map(len, found), np.uint32, len(found))))
                out["word_ids"].append(_pack(flat))
                held += len(data)
                if held > _AT_ONCE:
                    yield pa.RecordBatch.from_pydict(out, _IDS_SCHEMA)
                    out, held = defaultdict(list), 0
        if out:
            yield pa.RecordBatch.from_pydict(out, _IDS_SCHEMA)
        known, older, out, found = {}, {}, {}, []
        give_back()

    return encode


def _by_row(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Rows one after the other, without a copy of all of them."""
    for i in range(batch.num_rows):
        yield tuple(column[i].as_py() for column in batch.columns)


_parsed: dict[int, dict[bytes, int]] = {}


def _ranks(vocabulary) -> dict[bytes, int]:
    """The broadcast ranks, parsed once in a worker."""
    raw = vocabulary.value
    key = hash(raw)
    if key not in _parsed:
        _parsed[key] = parse_ranks(raw)
    return _parsed[key]


def _assembler(id_type: pa.DataType) -> Callable:
    """Puts a block's documents together from the places and the ids of its words."""
    schema = pa.schema([("id", id_type), ("ids", pa.list_(pa.int32()))])

    def assemble(documents: pa.Table, words: pa.Table) -> pa.Table:
        parts = [
            (np.cumsum(_unpack(r["numbers"])), _unpack(r["lengths"]), _unpack(r["word_ids"]))
            for r in words.to_pylist()
        ]
        lengths = np.zeros(sum(len(p[0]) for p in parts), np.int64)
        for numbers, own, _ in parts:
            lengths[numbers] = own
        offsets = _ends(lengths)
        values = np.empty(offsets[-1], np.int32)
        for numbers, own, ids in parts:
            target = np.repeat(offsets[numbers] - (np.cumsum(own, dtype=np.int64) - own), own)
            values[target + np.arange(len(ids))] = ids
        tables = []
        for row in documents.to_pylist():
            places = _unpack(row["places"])
            flat = _gather(values, offsets, places)
            at = _ends(lengths[places])[_ends(np.array(row["counts"], np.int64))]
            lists = pa.LargeListArray.from_arrays(pa.array(at), pa.array(flat))
            tables.append(
                pa.table(
                    [pa.array(row["ids"], id_type), lists.cast(pa.list_(pa.int32()))],
                    schema=schema,
                )
            )
        return pa.concat_tables(tables) if tables else schema.empty_table()

    return assemble


# --- operators --------------------------------------------------------------------------------


def encode(
    docs: DataFrame,
    vocabulary: bytes,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_chars: int = BLOCK,
    buckets: int | None = None,
) -> DataFrame:
    """Per row of ``docs`` its id and ``ids``, an array of ints.

    ``buckets`` deals out the distinct words; it defaults to the number of shuffle partitions.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    id_type = to_arrow_type(rows.schema["id"].dataType)
    split = rows.mapInArrow(
        _tokeniser(pattern, n, block_chars, id_type),
        f"block long, ids array<{kind}>, counts array<long>, places binary, "
        "bucket int, words binary, lengths binary, numbers binary",
    )
    name = f"periodica_words_{uuid.uuid4().hex}"
    (
        split.write.option("path", f"{shared_dir(spark)}/{name}")
        .option("compression", "none")  # packed already
        .bucketBy(n, "block")
        .saveAsTable(name)
    )
    split = spark.table(name)
    ranks = spark.sparkContext.broadcast(vocabulary)
    words = split.where("bucket is not null").select(
        "block", "bucket", "words", "lengths", "numbers"
    )
    word_ids = words.groupBy("bucket").applyInArrow(_encoder(ranks), _IDS_ROWS)
    places = split.where("bucket is null").select("block", "ids", "counts", "places")
    return (
        places.groupBy("block")
        .cogroup(word_ids.groupBy("block"))
        .applyInArrow(_assembler(id_type), f"id {kind}, ids array<int>")
        .withColumnRenamed("id", id_col)
    )


def _decoder(vocabulary, with_ids: bool = False) -> Callable:
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = _ranks(vocabulary)
        tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        table = np.frombuffer(b"".join(tokens), np.uint8)
        offsets = _ends(np.fromiter(map(len, tokens), np.int64, len(tokens)))
        sizes = np.diff(offsets)
        for batch in batches:
            lists = batch.column(1)
            at = lists.offsets.to_numpy().astype(np.int64)
            flat = lists.values.to_numpy()
            for a, b in runs(np.diff(at).tolist(), RUN):
                ids = flat[at[a] : at[b]]
                data = _gather(table, offsets, ids)
                ends = _ends(sizes[ids])[at[a : b + 1] - at[a]]
                columns = {
                    "id": batch.column(0).slice(a, b - a),
                    "token_bytes": _binary((at[a : b + 1] - at[a]) * 4, ids.astype("<u4")),
                    "decoded": _binary(ends, data),
                }
                if with_ids:
                    columns["ids"] = lists.slice(a, b - a)
                yield pa.RecordBatch.from_pydict(columns)
        give_back()

    return decode


def _binary(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    """A binary column over one buffer; a value longer than 2 GB does not fit a row anyway."""
    return pa.Array.from_buffers(
        pa.binary(),
        len(offsets) - 1,
        [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))],
    )


def decode(
    encoded: DataFrame, vocabulary: bytes, id_col: str = "doc_id", with_ids: bool = False
) -> DataFrame:
    """Per row its id, ``token_bytes`` (ids as little-endian 32 bits) and the ``decoded`` bytes.

    ``with_ids`` adds the row's ``ids``. A NULL array counts as one without ids; ids outside the
    vocabulary end the job.
    """
    rows = encoded.select(
        F.col(id_col).alias("id"), F.coalesce("ids", F.array().cast("array<int>")).alias("ids")
    )
    kind = rows.schema["id"].dataType.simpleString()
    ranks = encoded.sparkSession.sparkContext.broadcast(vocabulary)
    form = f"id {kind}, token_bytes binary, decoded binary" + ", ids array<int>" * with_ids
    return rows.mapInArrow(_decoder(ranks, with_ids), form).withColumnRenamed("id", id_col)
