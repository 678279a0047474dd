"""What several operators share: tables, shared storage, pieces of bounded size, hashes of words."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: characters (or bytes) that a task works on at once; longer texts go alone
PIECE = 1 << 20

#: white space of the word pattern, as the body of a character class
BLANKS = r"\x20\x09-\x0D"

#: holds a session's own folder, as ``spark.checkpoint.dir`` can't be set once a session runs
_OWN_FOLDER = "spark.periodica.folder"

A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


#: bytes of UTF-8 as letters and digits, A-Z in lower case; every other ASCII byte is a space
FOLD = bytes(
    [ord(chr(b).lower()) if chr(b).isalnum() else 0x20 for b in range(128)] + list(range(128, 256))
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, ``spark.checkpoint.dir``.

    Where it is unset, one of this machine is taken if Spark runs here alone; a cluster must set it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_OWN_FOLDER, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='periodica-')}"
        spark.conf.set(_OWN_FOLDER, folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read from there, so that it is computed once
    and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held_out(doc_id: str | Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, modulo 4, is 2."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string")) % 4 == 2, F.lit(False))


def word_count(text: str | Column) -> Column:
    """Number of words between blanks; 0 for a NULL."""
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(column, F.lit(f"[^{BLANKS}]+")), F.lit(0)).cast("long")


def sampled(rows: DataFrame, group: str, n: int, seed: int) -> DataFrame:
    """At most ``n`` of the rows (group, id, text) of each group, by a hash of id and text.

    Only hashes are ranked and shuffled; the texts of the chosen rows are then picked out by a join
    with that list, whose size ``n`` and the number of groups bound. Repeated rows count once, rows
    without id are not chosen.
    """
    chosen = sampled_keys(rows.select(group, "id", F.xxhash64("text").alias("_text")), group, n, seed)
    return picked(rows, chosen.drop(group))


def sampled_keys(keys: DataFrame, group: str, n: int, seed: int) -> DataFrame:
    """The same on (group, id, _text), the last being the text's hash."""
    draw = F.xxhash64(F.lit(seed), "id", "_text").alias("_draw")
    ranked = keys.where("id is not null").select(group, "id", "_text", draw).distinct()
    by_draw = Window.partitionBy(group).orderBy("_draw", "id", "_text")
    ranked = ranked.withColumn("_n", F.row_number().over(by_draw))
    return ranked.where(F.col("_n") <= n).drop("_n", "_draw")


def picked(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows named by a bounded list of (id, _text, ...), each once."""
    found = rows.withColumn("_text", F.xxhash64("text")).join(F.broadcast(chosen), ["id", "_text"])
    return found.dropDuplicates(["id", "_text"])


def lower_ascii(text: Column) -> Column:
    return F.translate(text, A_TO_Z, A_TO_Z.lower())


def runs(sizes: Sequence[int], limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours with at most ``limit`` in sum; one that exceeds it stands alone."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def text_runs(texts: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, int, list[str]]]:
    """The same ranges of an array of texts by their bytes, each with its texts as Python strings.

    Only those of one range are taken out of Arrow at once; NULLs are empty.
    """
    sizes = pc.add(pc.fill_null(pc.binary_length(texts), 0), 1).to_pylist()
    for a, b in runs(sizes, limit):
        yield a, b, [t or "" for t in texts.slice(a, b - a).to_pylist()]


def give_back() -> None:
    """Returns freed memory to the system: a worker that waits for its next task keeps it otherwise,
    and an executor may have more workers than tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


# --- hashes of spans of a byte array ----------------------------------------------------------

_ODD = 0x9E3779B97F4A7C15 | 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out, out=out) if n else out


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_CODES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))


class Spans:
    """64-bit hashes of any spans of one byte array, from prefix sums of a polynomial."""

    _up = np.empty(0, np.uint64)
    _down = np.empty(0, np.uint64)

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        if len(Spans._up) < n:
            Spans._up = _powers(_ODD, max(n, PIECE + 1))
            Spans._down = _powers(pow(_ODD, -1, 1 << 64), max(n, PIECE + 1))
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(_BYTE_CODES[data] * Spans._up[: n - 1], out=self.sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.sums[ends] - self.sums[starts]) * Spans._down[starts]
        return mixed(raw + (ends - starts).astype(np.uint64))


_BLANK_BYTES = np.zeros(256, bool)
_BLANK_BYTES[[0x20, *range(0x09, 0x0E)]] = True


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are no blanks."""
    solid = np.zeros(len(data) + 2, np.int8)
    solid[1:-1] = ~_BLANK_BYTES[data]
    steps = np.diff(solid)
    return np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
