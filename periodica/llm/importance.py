"""Target-distribution importance resampling over hashed n-grams, by overlapped regex scans.

A text becomes its words, separated by single spaces; for each length one regular expression then
walks over it with ``overlapped=True``, from one word's boundary to the next, and hands out the
n-grams as they stand there. Their CRC modulo ``buckets`` counts them. Texts are scanned once: what
is stored per document are its buckets (two bytes a feature) or, for a document with more features
than there are buckets, one count a bucket, so that a text's length bounds neither rows nor memory.

Counts of both sides are sums per bucket, added up in each task before they are shuffled. The gains,
one whole number a bucket, are the only thing that is broadcast; ``buckets`` bounds them. A document
weighs the floored mean of its features' gains. Gumbel noise from a hash of ``seed`` and id makes the
``percent`` highest scores a sample without replacement, the same at every run.

Ranks need no order over all rows: scores are whole numbers of a bounded range (logarithms of 64-bit
counts, noise from 32 bits), so the rows above a score come from one count per distinct score, and
only rows of one score are put in order together.

Nulls: a NULL text has no words and no features and weighs 0; a NULL id hashes like an empty one and
comes last among ties. Rows that repeat count each time and each have a rank; equal ids are ranked
by weight and features, equal rows in any order. An empty target gives every bucket nearly the same
gain; empty documents give an empty result. Further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from periodica.llm.common import FOLD, stored

#: features hashed before they are counted
RUN = 1 << 16


def spaced(text: bytes) -> bytes:
    """The words of a text in UTF-8, lower-cased in A-Z, each with a space before and after it."""
    data = np.frombuffer(b" " + text.translate(FOLD) + b" ", np.uint8)
    solid = data != 0x20
    solid[1:] |= solid[:-1]
    solid[0] = True
    return data[solid].tobytes()


def patterns(longest: int) -> list[regex.Pattern]:
    """One expression for each number of words; a match reaches from boundary to boundary."""
    more = b" [^ ]++"
    return [regex.compile(b" ([^ ]++" + more * n + b")(?= )") for n in range(longest)]


def hashed(words: bytes, pattern: regex.Pattern, buckets: int) -> Iterator[np.ndarray]:
    """Buckets of the n-grams in order, in pieces of bounded size."""
    found = pattern.finditer(words, overlapped=True)
    while True:
        codes = np.fromiter((crc32(m[1]) for m in islice(found, RUN)), np.uint32)
        if not len(codes):
            return
        yield codes % np.uint32(buckets)


def _small(buckets: int) -> type:
    return np.uint16 if buckets <= 1 << 16 else np.uint32


def _features(text: bytes, finders: list[regex.Pattern], buckets: int) -> tuple:
    """Number of words and features, the buckets of a short text, the counts of a long one."""
    words = spaced(text)
    n_words = words.count(b" ") - 1
    if n_words <= 0:
        return 0, 0, b"", None
    total = sum(max(n_words - n, 0) for n in range(len(finders)))
    pieces = (piece for finder in finders for piece in hashed(words, finder, buckets))
    if total <= buckets:
        return n_words, total, np.concatenate([*pieces]).astype(_small(buckets)).tobytes(), None
    counts = np.zeros(buckets, np.int64)
    for piece in pieces:
        counts += np.bincount(piece, minlength=buckets)
    return n_words, total, None, counts.tobytes()


def scan(
    docs: DataFrame, longest: int, buckets: int, id_col: str | None, text_col: str
) -> DataFrame:
    """Per row ``id``, ``n_words``, ``n_features`` and its features as ``few`` or ``counts``."""
    doc_id = F.lit(None).cast("long") if id_col is None else F.col(id_col)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(doc_id.alias("id"), text.alias("text"))
    kind = rows.schema["id"].dataType
    id_type = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finders = patterns(longest)
        for batch in batches:
            # a row at a time, so that a task holds the features of few texts
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                found = [_features(t.as_py(), finders, buckets) for t in part.column(1)]
                columns = list(zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).cast(id_type),
                        pa.array(columns[0], pa.int64()),
                        pa.array(columns[1], pa.int64()),
                        pa.array(columns[2], pa.binary()),
                        pa.array(columns[3], pa.binary()),
                    ],
                    ["id", "n_words", "n_features", "few", "counts"],
                )

    return rows.mapInArrow(
        run,
        f"id {kind.simpleString()}, n_words long, n_features long, few binary, counts binary",
    )


def _tallies(few: bytes | None, counts: bytes | None, buckets: int) -> np.ndarray:
    """The buckets that a document's features fall into, or the counts of all buckets."""
    if counts is not None:
        return np.frombuffer(counts, np.int64)
    return np.frombuffer(few, _small(buckets))


def bucket_counts(scanned: DataFrame, buckets: int) -> np.ndarray:
    """Features of all rows by bucket: one row a task and bucket, summed up on Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for few, counts in zip(batch.column(0), batch.column(1), strict=True):
                if counts.is_valid:
                    total += _tallies(None, counts.as_py(), buckets)
                else:
                    total += np.bincount(_tallies(few.as_py(), None, buckets), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["bucket", "n"]
        )

    counted = scanned.select("few", "counts").mapInArrow(run, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for row in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most buckets
        out[row["bucket"]] = row["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket 1,000 times the logarithm of target's over corpus' share, floored."""
    n, all_corpus, all_target = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array(
        [
            math.floor(1000 * math.log((t + 1) * (all_corpus + n) / ((s + 1) * (all_target + n))))
            for s, t in zip(corpus.tolist(), target.tolist(), strict=True)
        ],
        np.int64,
    )


def weigh(scanned: DataFrame, gain: np.ndarray) -> DataFrame:
    """Per row ``id``, ``n_words``, ``n_features`` and ``weight``, the floored mean gain."""
    kind = scanned.schema["id"].dataType.simpleString()
    sent = scanned.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain, buckets = sent.value, len(sent.value)
        for batch in batches:
            weights = []
            sizes = batch.column(2).to_pylist()
            for n, few, counts in zip(sizes, batch.column(3), batch.column(4), strict=True):
                if not n:
                    weights.append(0)
                elif counts.is_valid:
                    weights.append(int(gain @ _tallies(None, counts.as_py(), buckets)) // n)
                else:
                    weights.append(int(gain[_tallies(few.as_py(), None, buckets)].sum()) // n)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(weights, pa.int64())],
                ["id", "n_words", "n_features", "weight"],
            )

    return scanned.mapInArrow(
        run, f"id {kind}, n_words long, n_features long, weight long"
    )


def noise(doc_id: str, seed: int) -> Column:
    """1,000 times a standard Gumbel number, floored, from a hash of seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def ranked(scored: DataFrame, percent: int) -> DataFrame:
    """Add ``rank`` to rows with ``score`` and ``able``: 1, 2, ... from the highest score on, for
    the ``percent`` of the able rows that come first."""
    able = scored.where("able")
    # one row per distinct score from here on, which its range bounds
    counts = able.groupBy("score").agg(F.count("*").alias("n"))
    higher = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    drawn = F.floor(F.sum("n").over(Window.partitionBy()) * percent / 100)
    steps = counts.select(
        F.col("score").alias("step"),
        F.coalesce(F.sum("n").over(higher), F.lit(0)).alias("above"),
        drawn.alias("drawn"),
    ).where("above < drawn")
    place = Window.partitionBy("score").orderBy(
        F.asc_nulls_last("id"), F.desc("weight"), F.desc("n_features")
    )
    placed = (
        able.join(steps, F.col("score") == F.col("step"), "left")
        .withColumn("rank", F.col("above") + F.row_number().over(place))
        .withColumn("rank", F.when(F.col("rank") <= F.col("drawn"), F.col("rank")))
    )
    others = scored.where("not able").withColumn("rank", F.lit(None).cast("long"))
    return placed.select(others.columns).unionByName(others).drop("able")


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 25,
    min_words: int = 20,
    longest: int = 2,
    buckets: int = 10_000,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per row of ``docs`` its id, ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank``.

    ``rank`` is NULL for rows that are not drawn. ``target`` holds texts in a column ``text_col``.
    """
    scanned = stored(scan(docs, longest, buckets, id_col, text_col), "importance-features")
    aim = scan(target, longest, buckets, None, text_col)
    gain = gains(bucket_counts(scanned, buckets), bucket_counts(aim, buckets))
    scored = weigh(scanned, gain).select(
        "*",
        (F.col("weight") + noise("id", seed)).alias("score"),
        (F.col("n_words") >= min_words).alias("able"),
    )
    return ranked(stored(scored, "importance-scores"), percent).withColumnRenamed("id", id_col)
