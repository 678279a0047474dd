"""Contiguous shards of nearly equal bytes, by global prefix sums from per-partition totals.

The rows are put in order by a hash of the text, then by id: equal texts stand side by side and are
split only where a cut falls among them, and ids are shuffled. The order is range-partitioned by
both columns, so a large group of equal texts spreads over tasks. Each partition sums up its own
sizes as it is written; the totals of the partitions, one row each, give every partition what lies
before it. A document belongs to the shard in which the middle of its bytes lies, so each shard is
within one document of ``total / shards``.

A size is the bytes of the text in UTF-8 (none for a NULL) plus ``overhead``. Rows equal in id and
text share their place in the order and are told apart by position only. NULL ids come first among
equal texts. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from periodica.llm.common import stored


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    rows = size = 0
    for batch in batches:
        sizes = batch.column("size").to_numpy(zero_copy_only=False)
        before = size + np.cumsum(sizes) - sizes
        place = np.arange(rows, rows + len(sizes))
        rows += len(sizes)
        size += int(sizes.sum())
        out = {name: batch.column(name) for name in batch.schema.names}
        out |= {
            "part": pa.array(np.full(len(sizes), part, np.int32)),
            "bytes_before": pa.array(before.astype(np.int64)),
            "rows_before": pa.array(place.astype(np.int64)),
        }
        yield pa.RecordBatch.from_pydict(out)


def shard(
    docs: DataFrame,
    shards: int = 40,
    id_col: str = "doc_id",
    text_col: str = "text",
    overhead: int = 16,
) -> DataFrame:
    """Per document its id, ``size``, ``text_crc32``, ``shard`` and ``slot``, its place in there."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("order"),
    )
    rows = stored(rows, "shard-sizes")
    kind = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    summed = (
        rows.repartitionByRange("order", "id")
        .sortWithinPartitions("order", "id")
        .mapInArrow(_summed, f"{kind}, part int, bytes_before long, rows_before long")
    )
    summed = stored(summed, "shard-sums")
    # one row per partition from here on
    totals = summed.groupBy("part").agg(
        F.sum("size").alias("bytes"), F.count("*").alias("rows")
    )
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes_offset"),
        F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_offset"),
        F.sum("bytes").over(Window.partitionBy()).alias("total"),
    )
    middle = F.col("bytes_before") + F.col("bytes_offset") + F.col("size") / 2
    placed = summed.join(offsets, "part").select(
        "id",
        "size",
        "text_crc32",
        F.least(F.floor(middle * shards / F.col("total")), F.lit(shards - 1))
        .cast("int")
        .alias("shard"),
        (F.col("rows_before") + F.col("rows_offset")).alias("place"),
    )
    # one row per shard
    firsts = placed.groupBy("shard").agg(F.min("place").alias("first"))
    return placed.join(firsts, "shard").select(
        F.col("id").alias(id_col),
        "size",
        "text_crc32",
        "shard",
        (F.col("place") - F.col("first")).alias("slot"),
    )
