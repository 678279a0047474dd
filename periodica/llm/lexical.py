"""Ranked lexical search by bit-sliced Bloom signatures, with exact scores for what they can't rule out.

Index: tasks take documents in blocks and put each into a Bloom filter of its terms. The filters of a
block's documents of like size lie side by side, cut into slices: one row of bits, a bit a document,
for each place of the filter. A term that a document has t times is entered once for each step of
``STEPS`` up to t, so that a filter also bounds how often it occurs. Next to the filters stand the
documents' lengths and largest counts, and how many documents hold each term.

Search, a round of items at a time: the rows at a term's places, and-ed, are a bitmap of documents
that may hold it. It has every document that does, and some more. Sums over the bitmaps, weighted by
the terms, give each document an upper bound of its score. The k highest bounds of an item are scored
exactly on their texts; the k-th best of these scores is reached by k documents, so only documents
whose bound is at least that can be among the first k. All of those are scored exactly.

Scores are those of the contract of the query: ``weight * (10**9 * tf div (1000 * tf + 8 * m))``
summed up, with m = 25 + (75 * n * N div L). They are whole numbers, so bounds and scores compare
exactly. Texts are found again by a hash of id and text; a clash of hashes costs a needless exact
score, no result.

Bounds: a round has ``ENTRIES`` terms of items (an item with more makes a round of its own); its
weights, thresholds and first k documents per item are what goes through the driver or is broadcast.
How many documents are rescored is not bounded, they are joined. Before that join a bitmap of
``KEY_BITS`` bits, built from the hashes, takes out nearly all texts that no item asks for.

Nulls: a NULL text has no terms and is never found; NULL ids may be found and come last among equal
scores. Rows that repeat are documents of their own. Rows of one item id, which may be NULL, make up
one item. Without documents, items or common terms the result is empty. Further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from periodica.llm.common import FOLD, PIECE, mixed, stored

#: counts of a term that a filter tells apart: 1 to 8, then four for each doubling
STEPS = np.array([1, 2, 3, *[b << i for i in range(30) for b in (4, 5, 6, 7)]], np.int64)

#: places that an entry sets, of so many for each entry that the filter is made for
HASHES, BITS_PER_ENTRY = 4, 12

#: bits of the longest filter, and documents and bits of the filters that lie side by side
MOST_BITS, SIDE_BY_SIDE, SIDE_BITS = 1 << 24, 4096, 1 << 25

#: terms of an item whose bitmaps are summed up at once
AT_ONCE = 1024

#: bytes of text that are indexed together
BLOCK = 1 << 22

#: terms that a task counts before it hands the counts on
COUNTED = 1 << 19

#: terms of items in a round
ENTRIES = 1 << 16

#: bits of the map of wanted documents
KEY_BITS = 1 << 24

_SIDES = "keys array<long>, lengths array<long>, most array<long>, places long, slices binary"


def term_lists(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, in lists of bounded size."""
    data = text.translate(FOLD)
    start = 0
    while start < len(data):
        end = data.find(b" ", start + PIECE)
        end = len(data) if end < 0 else end
        yield data[start:end].split()
        start = end


def _places(codes: np.ndarray, step: np.ndarray | int, places: int) -> np.ndarray:
    """The places of terms at a step, a row for each hash."""
    h = mixed((codes.astype(np.uint64) << np.uint64(8)) + np.asarray(step, np.uint64))
    low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    turns = np.arange(HASHES, dtype=np.uint64)[:, None]
    return ((low + turns * high) % np.uint64(places)).astype(np.int64)


# --- index ------------------------------------------------------------------------------------


def _sliced(docs: list[tuple]) -> Iterator[dict]:
    """Filters side by side, of documents (key, length, largest count, codes, steps) of like size."""
    classes: dict[int, list[tuple]] = {}
    for doc in docs:
        classes.setdefault(max(4, (len(doc[3]) - 1).bit_length()), []).append(doc)
    for size, members in sorted(classes.items()):
        places = min(BITS_PER_ENTRY << size, MOST_BITS)
        at_once = max(8, min(SIDE_BY_SIDE, SIDE_BITS // places // 8 * 8))
        for a in range(0, len(members), at_once):
            some = members[a : a + at_once]
            width = -(-len(some) // 8) * 8
            bits = np.zeros((places, width), bool)
            own = np.repeat(np.arange(len(some)), [len(d[3]) for d in some])
            codes, steps = (np.concatenate([d[i] for d in some]) for i in (3, 4))
            bits[_places(codes, steps, places), own] = True
            yield {
                "keys": [d[0] for d in some],
                "lengths": [d[1] for d in some],
                "most": [d[2] for d in some],
                "places": places,
                "slices": np.packbits(bits, axis=1).tobytes(),
            }


def _entries(numbers: np.ndarray, codes: np.ndarray) -> tuple:
    """Distinct terms of a document, its entries as codes and steps, and the largest count."""
    terms, counts = np.unique(numbers, return_counts=True)
    n = np.searchsorted(STEPS, counts, side="right")
    steps = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return terms, np.repeat(codes[terms], n), steps, int(counts.max())


class _Block:
    """Documents until their bytes are enough, with their terms numbered."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {}
        self.docs: list[tuple[int, np.ndarray]] = []
        self.size = 0

    def add(self, key: int, text: bytes) -> None:
        number, found = self.number, []
        for terms in term_lists(text):
            for term in terms:
                if term not in number:
                    number[term] = len(number)
            found.append(np.fromiter(map(number.__getitem__, terms), np.uint32, len(terms)))
        self.size += len(text) + 64
        numbers = np.concatenate(found) if found else np.empty(0, np.uint32)
        if len(numbers):
            self.docs.append((key, numbers))

    def done(self) -> tuple[list[dict], np.ndarray]:
        """Rows of filters, and for each numbered term the documents that hold it."""
        codes = np.fromiter(map(crc32, self.number), np.uint32, len(self.number))
        holding = np.zeros(len(codes), np.int64)
        docs = []
        for key, numbers in self.docs:
            terms, entered, steps, most = _entries(numbers, codes)
            holding[terms] += 1
            docs.append((key, len(numbers), most, entered, steps))
        return list(_sliced(docs)), holding


_SCHEMA = pa.schema(
    [
        *[pa.field(n, pa.list_(pa.int64())) for n in ("keys", "lengths", "most")],
        pa.field("places", pa.int64()),
        pa.field("slices", pa.binary()),
        pa.field("terms", pa.list_(pa.binary())),
        pa.field("holding", pa.list_(pa.int64())),
    ]
)


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block, counts = _Block(), Counter()

    def close() -> Iterator[pa.RecordBatch]:
        rows, holding = block.done()
        for row in rows:
            yield pa.RecordBatch.from_pylist([row], _SCHEMA)
        counts.update(dict(zip(block.number, holding.tolist(), strict=True)))

    def hand_on() -> Iterator[pa.RecordBatch]:
        terms = list(counts)
        for a in range(0, len(terms), 1 << 16):
            some = terms[a : a + (1 << 16)]
            row = {"terms": some, "holding": [counts[t] for t in some]}
            yield pa.RecordBatch.from_pylist([row], _SCHEMA)
        counts.clear()

    for batch in batches:
        for key, text in zip(batch.column(0), batch.column(1), strict=True):
            block.add(key.as_py(), text.as_py())
            if block.size > BLOCK:
                yield from close()
                block = _Block()
                if len(counts) > COUNTED:
                    yield from hand_on()
    yield from close()
    yield from hand_on()


@dataclass
class Index:
    """``signatures`` (filters side by side), ``terms`` (with partial counts of documents), the
    documents, the number of those with a term, and the number of all their terms."""

    signatures: DataFrame
    terms: DataFrame
    docs: DataFrame
    n_docs: int
    n_terms: int


def _key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col))


def _bytes(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """All documents, in one pass over their texts."""
    rows = docs.select(
        F.col(id_col).alias("id"),
        _key(id_col, text_col).alias("key"),
        _bytes(text_col).alias("text"),
    )
    made = rows.select("key", "text").mapInArrow(
        _indexed, f"{_SIDES}, terms array<binary>, holding array<long>"
    )
    made = stored(made, "lexical-index")
    signatures = made.where("keys is not null").select("keys", "lengths", "most", "places", "slices")
    terms = made.where("terms is not null").select(F.inline(F.arrays_zip("terms", "holding")))
    total = signatures.agg(
        F.sum(F.size("keys")).alias("docs"),
        F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("terms"),
    ).first()
    terms = terms.toDF("term", "holding")
    return Index(signatures, terms, rows, total["docs"] or 0, total["terms"] or 0)


# --- items ------------------------------------------------------------------------------------


def _item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per item and term how often it stands there: ``item``, ``term``, ``n``."""
    rows = items.select(F.col(id_col).alias("item"), _bytes(text_col).alias("text"))
    kind = rows.schema["item"].dataType
    item_type = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0), batch.column(1), strict=True):
                counts = Counter(t for terms in term_lists(text.as_py()) for t in terms)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([item.as_py()] * len(counts), item_type),
                        pa.array(list(counts), pa.binary()),
                        pa.array(list(counts.values()), pa.int64()),
                    ],
                    ["item", "term", "n"],
                )

    found = rows.mapInArrow(run, f"item {kind.simpleString()}, term binary, n long")
    return found.groupBy("item", "term").agg(F.sum("n").alias("n"))


def _weighted(index: Index, terms: DataFrame) -> DataFrame:
    """Terms of items that documents hold, with ``weight`` times their occurrences in the item."""
    asked = terms.select("term").distinct()
    holding = (
        index.terms.join(asked, "term").groupBy("term").agg(F.sum("holding").alias("holding"))
    )
    share = F.lit(2 * index.n_docs + 2).cast("double") / (2 * F.col("holding") + 1)
    weight = F.floor(1000 * F.log(share))
    return (
        terms.join(holding, "term")
        .select("item", "term", (weight * F.col("n")).alias("weight"))
        .where("weight > 0")
    )


class Round:
    """Items with their terms and weights, as tasks need them."""

    def __init__(self, rows: list, n_docs: int, n_terms: int):
        items: dict = {}
        number: dict[bytes, int] = {}
        for row in rows:
            term = number.setdefault(bytes(row["term"]), len(number))
            items.setdefault(row["item"], []).append((term, row["weight"]))
        self.items = list(items)
        self.terms = list(number)
        self.number = number
        self.codes = np.fromiter(map(crc32, self.terms), np.uint32, len(self.terms))
        self.parts = [
            (np.array([t for t, _ in own], np.int64), np.array([w for _, w in own], np.int64))
            for own in items.values()
        ]
        self.n_docs, self.n_terms = n_docs, n_terms

    def share(self, counts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
        """What a term counts for by its occurrences and the document's length."""
        m = 25 + 75 * lengths * self.n_docs // self.n_terms
        return 10**9 * counts // (1000 * counts + 8 * m)

    def bounds(self, row: dict) -> Iterator[tuple[int, np.ndarray]]:
        """Per item the upper bounds of the scores of all documents of one row of signatures."""
        lengths = np.array(row["lengths"], np.int64)
        most = np.array(row["most"], np.int64)
        slices = np.frombuffer(row["slices"], np.uint8).reshape(row["places"], -1)
        alive = np.arange(len(self.codes))
        held = None
        before = np.zeros(len(lengths), np.int64)
        levels = []
        for step in range(len(STEPS)):
            places = _places(self.codes[alive], step, row["places"])
            found = np.bitwise_and.reduce(slices[places], axis=0)
            if held is not None:
                found &= held
            some = np.flatnonzero(found.any(axis=1))
            if not len(some):
                break
            alive, held = alive[some], found[some]
            # as often as the next step would say it does not
            last = STEPS[step + 1] - 1 if step + 1 < len(STEPS) else most
            share = self.share(np.minimum(most, last), lengths)
            at = np.full(len(self.codes), -1)
            at[alive] = np.arange(len(alive))
            levels.append((at, held, share - before))
            before = share
        for i, (terms, weights) in enumerate(self.parts):
            bound = None
            for at, held, more in levels:
                own = at[terms]
                mine = own >= 0
                if not mine.any():
                    break
                bound = np.zeros(len(lengths), np.int64) if bound is None else bound
                some, by = held[own[mine]], weights[mine].astype(np.float64)
                for a in range(0, len(by), AT_ONCE):
                    bits = np.unpackbits(some[a : a + AT_ONCE], axis=1, count=len(lengths))
                    # whole numbers far below 2**53
                    sums = by[a : a + AT_ONCE] @ bits.astype(np.float64)
                    bound += sums.astype(np.int64) * more
            if bound is not None:
                yield i, bound

    def scores(self, text: bytes, asked: list[int]) -> list[int]:
        """Exact scores of a text for some items."""
        counts = np.zeros(len(self.terms), np.int64)
        length, number = 0, self.number
        for terms in term_lists(text):
            length += len(terms)
            known = [number[t] for t in terms if t in number]
            counts += np.bincount(np.array(known, np.int64), minlength=len(counts))
        shares = self.share(counts, length) if length else counts
        return [int(shares[self.parts[i][0]] @ self.parts[i][1]) for i in asked]


def _rounds(weighted: DataFrame, index: Index, entries: int) -> Iterator[Round]:
    weighted = stored(weighted, "lexical-items")
    n = max(1, -(-weighted.count() // entries))
    for i in range(n):
        rows = weighted.where(F.pmod(F.xxhash64("item"), F.lit(n)) == i).collect()
        if rows:
            yield Round(rows, index.n_docs, index.n_terms)


# --- search -----------------------------------------------------------------------------------


def _highest(sent: Broadcast, k: int):
    """Per item the k documents of a task with the highest bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                keys = np.array(row["keys"], np.int64)
                for i, bound in sent.value.bounds(row):
                    own = keys
                    if i in best:
                        bound, own = np.append(best[i][0], bound), np.append(best[i][1], own)
                    if len(bound) > k:
                        first = np.argpartition(-bound, k - 1)[:k]
                        bound, own = bound[first], own[first]
                    best[i] = bound, own
        for i, (bound, own) in best.items():
            yield _pairs(i, own, bound)

    return run


def _pairs(item: int, keys: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(keys), item, np.int32)),
            pa.array(keys, pa.int64()),
            pa.array(bounds, pa.int64()),
        ],
        ["item", "key", "bound"],
    )


_PAIRS = "item int, key long, bound long"


def _not_excluded(sent: Broadcast, least: Broadcast):
    """Pairs whose bound reaches the item's threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys = np.array(row["keys"], np.int64)
                for i, bound in sent.value.bounds(row):
                    kept = bound >= least.value[i]
                    if kept.any():
                        yield _pairs(i, keys[kept], bound[kept])

    return run


def _wanted(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """``rows`` without most of those whose key is not asked for, by a bitmap of ``KEY_BITS``."""
    place = F.pmod("key", F.lit(KEY_BITS))
    bits = asked.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")
    )
    at = F.bitmap_bit_position(place)
    byte = F.substring("bits", (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))
    byte = F.conv(F.hex(byte), 16, 10).cast("long")
    bit = F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(at, F.lit(8)))), F.lit(2))
    # KEY_BITS bits at most
    return (
        rows.withColumn("bucket", F.bitmap_bucket_number(place))
        .join(F.broadcast(bits), "bucket")
        .where(bit == 1)
        .drop("bucket", "bits")
    )


def _exact(index: Index, sent: Broadcast, pairs: DataFrame) -> DataFrame:
    """Exact scores (``item``, ``id``, ``score``) of the documents of ``pairs``, if above 0."""
    kind = index.docs.schema["id"].dataType
    asked = pairs.groupBy("key").agg(F.collect_set("item").alias("items"))
    rows = _wanted(index.docs, pairs).join(asked, "key").select("id", "text", "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text, items in zip(*batch.columns, strict=True):
                items = items.as_py()
                scores = sent.value.scores(text.as_py(), items)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(items, pa.int32()),
                        pa.array([doc_id.as_py()] * len(items), to_arrow_type(kind)),
                        pa.array(scores, pa.int64()),
                    ],
                    ["item", "id", "score"],
                )

    form = f"item int, id {kind.simpleString()}, score long"
    return rows.mapInArrow(run, form).where("score > 0")


def _first(scored: DataFrame, k: int) -> DataFrame:
    place = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return scored.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)


def search(
    index: Index,
    items: DataFrame,
    k: int = 10,
    item_col: str = "item_id",
    text_col: str = "text",
    id_col: str = "doc_id",
    entries: int = ENTRIES,
) -> DataFrame:
    """Per item the ``k`` documents of the highest scores above 0: ``rank`` from 1, equal scores by
    id; columns ``item_col``, ``rank``, ``id_col``, ``score``."""
    spark = index.docs.sparkSession
    kind = items.schema[item_col].dataType.simpleString()
    id_kind = index.docs.schema["id"].dataType.simpleString()
    found = []
    weighted = _weighted(index, _item_terms(items, item_col, text_col))
    for queries in _rounds(weighted, index, entries):
        sent = spark.sparkContext.broadcast(queries)
        place = Window.partitionBy("item").orderBy(F.desc("bound"), "key")
        highest = index.signatures.mapInArrow(_highest(sent, k), _PAIRS)
        highest = highest.withColumn("n", F.row_number().over(place)).where(F.col("n") <= k)
        highest = stored(highest.select("item", "key"), "lexical-highest")
        # at most one row an item, and there are at most ``entries`` items
        reached = _first(_exact(index, sent, highest), k).where(F.col("rank") == k)
        least = np.ones(len(queries.items), np.int64)
        for row in reached.select("item", "score").collect():
            least[row["item"]] = row["score"]
        kept = index.signatures.mapInArrow(
            _not_excluded(sent, spark.sparkContext.broadcast(least)), _PAIRS
        )
        kept = stored(kept.select("item", "key"), "lexical-kept")
        names = spark.createDataFrame(list(enumerate(queries.items)), f"item int, name {kind}")
        ranked = _first(_exact(index, sent, kept), k).join(names, "item")
        found.append(
            ranked.select(F.col("name").alias(item_col), "rank", F.col("id").alias(id_col), "score")
        )
    if not found:
        form = f"`{item_col}` {kind}, rank int, `{id_col}` {id_kind}, score long"
        return spark.createDataFrame([], form)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
