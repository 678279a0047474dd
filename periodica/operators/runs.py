"""Longest runs of events that reach a floor, in the order of each entity's events.

What is known of a stretch of neighbouring events is four numbers: how many they are, how long the
run at their beginning is, the longest anywhere, and the one at their end. Two neighbouring stretches
merge into such a summary again, so an entity's events need not meet: rows are put in order over the
whole table (by entity, then by place), cut into ranges of about equal size wherever that falls, and
each range is read once in order. An entity with a third of all events spans many ranges. Its
summaries, one a range, are then merged in order.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SUMMARY = ("length", "head", "best", "tail")


def longest_runs(
    events: DataFrame,
    entity: str,
    order: Sequence[str],
    reached: Column,
    weight: str | None = None,
) -> DataFrame:
    """Per entity ``events`` (their number), ``longest_run`` and ``current_run`` (at the end).

    ``weight`` names a column that says for how many equal events a row stands; rows of no event
    count nothing. Events at the same place are taken misses first; NULL places come first, a NULL
    ``reached`` is a miss, rows without entity are left out.
    """
    times = F.lit(1) if weight is None else F.col(weight)
    rows = events.select(
        F.col(entity).alias("entity"),
        *[F.col(c).alias(f"place{i}") for i, c in enumerate(order)],
        F.coalesce(reached, F.lit(False)).alias("reached"),
        times.cast("bigint").alias("times"),
    ).where("entity is not null and times > 0")
    places = ["entity", *[f"place{i}" for i in range(len(order))], "reached"]
    # partitions are ranges in this order
    ordered = rows.repartitionByRange(*places).sortWithinPartitions(*places)
    kind = rows.schema["entity"].dataType.simpleString()
    fields = ", ".join(f"{name} bigint" for name in _SUMMARY)
    parts = (
        ordered.select("entity", "reached", "times", F.spark_partition_id().alias("part"))
        .mapInArrow(_summaries, f"entity {kind}, part int, {fields}")
        .groupBy("entity")
        .agg(F.sort_array(F.collect_list(F.struct("part", *_SUMMARY))).alias("parts"))
    )
    none = ", ".join(f"0L as {name}" for name in _SUMMARY)
    merged = F.expr(f"aggregate(parts, named_struct({_named(none)}), (a, b) -> {_MERGE})")
    return parts.select("entity", merged.alias("run")).select(
        F.col("entity").alias(entity),
        F.col("run.length").alias("events"),
        F.col("run.best").alias("longest_run"),
        F.col("run.tail").alias("current_run"),
    )


def _named(fields: str) -> str:
    """``x as a, y as b`` as the arguments of ``named_struct``."""
    pairs = [field.rsplit(" as ", 1) for field in fields.split(", ")]
    return ", ".join(f"'{name}', {value}" for value, name in pairs)


_MERGE = """named_struct(
    'length', a.length + b.length,
    'head', if(a.head < a.length, a.head, a.length + b.head),
    'best', greatest(a.best, b.best, a.tail + b.head),
    'tail', if(b.tail < b.length, b.tail, b.length + a.tail))"""


def _merged(a: Sequence[int], b: Sequence[int]) -> tuple[int, int, int, int]:
    return (
        a[0] + b[0],
        a[1] if a[1] < a[0] else a[0] + b[1],
        max(a[2], b[2], a[3] + b[1]),
        b[3] if b[3] < b[0] else b[0] + a[3],
    )


def _starts(column: pa.Array) -> np.ndarray:
    """Where the rows of a value begin."""
    changed = pc.not_equal(column.slice(1), column.slice(0, len(column) - 1))
    return np.concatenate([[0], np.flatnonzero(changed.to_numpy(zero_copy_only=False)) + 1])


def _in_batch(batch: pa.RecordBatch) -> tuple[list, np.ndarray]:
    """Entities of a batch in order, and their summaries as rows."""
    names = batch.column("entity")
    reached = batch.column("reached").to_numpy(zero_copy_only=False)
    first = _starts(names)
    runs = np.union1d(first, np.flatnonzero(np.diff(reached)) + 1)
    times = np.add.reduceat(batch.column("times").to_numpy(), runs)
    length = np.where(reached[runs], times, 0)
    here = np.searchsorted(runs, first)
    last = np.append(here[1:], len(runs)) - 1
    found = [np.add.reduceat(times, here), length[here], np.maximum.reduceat(length, here), length[last]]
    return names.take(pa.array(first)).to_pylist(), np.stack(found, axis=1)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a partition, in order, as a summary per entity; what goes on is carried over."""
    name, carried, kind, part = None, None, None, 0

    def out(names: list, rows: list) -> pa.RecordBatch:
        columns = np.array(rows, np.int64).reshape(-1, len(_SUMMARY)).T
        return pa.RecordBatch.from_arrays(
            [
                pa.array(names, kind),
                pa.array([part] * len(names), pa.int32()),
                *[pa.array(c) for c in columns],
            ],
            ["entity", "part", *_SUMMARY],
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        kind, part = batch.schema.field("entity").type, batch.column("part")[0].as_py()
        names, rows = _in_batch(batch)
        rows = [tuple(r) for r in rows.tolist()]
        if carried is not None and names[0] == name:
            rows[0] = _merged(carried, rows[0])
        elif carried is not None:
            names.insert(0, name)
            rows.insert(0, carried)
        name, carried = names.pop(), rows.pop()
        if names:
            yield out(names, rows)
    if carried is not None:
        yield out([name], [carried])
