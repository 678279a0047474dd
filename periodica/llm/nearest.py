"""Exact nearest neighbours of binary codes by incremental multi-index hashing.

The code of a vector is the signs of its components, cut into segments of about as many bits as the
number of distinct codes has, so that a value of a segment stands for a few codes. Codes that
differ in at most m(r+1)-1 bits, m being the number of segments, differ in at most r bits in one of
them. So in round r every query probes the index with all values at distance r from each of its
segments; candidates are verified by their full distance. A query is done as soon as its k-th
verified distance is within m(r+1)-1: nothing nearer can be left. The others go on with r+1.

Equal codes are searched once: of each code only the ids that can be among k answers are kept, the
smallest, so a code that a third of all rows share is a few rows. A pair is taken from the first of
its nearest segments only, which needs no removal of duplicates. Probes meet the index in an
merge join; a value of a segment that many codes share is split by the skew join, and none of
the tables is broadcast, however small a round makes it. Codes have 64 bits at most.

Vectors are told apart by id and code: repeated rows count once. Rows without id or vector are not
searched; missing or NULL components count as not positive. Ties go to the smaller id. An empty
table gives an empty result, further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from periodica.llm.common import stored


def code_of(vector: str, bits: int) -> Column:
    """The signs of the components as the bits of one long."""
    return F.expr(
        f"aggregate(sequence(0, {bits - 1}), 0L, (code, i) -> "
        f"if(get(`{vector}`, i) > 0, code | shiftleft(1L, i), code))"
    )


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def cuts(bits: int, codes: int, least: int = 16) -> list[tuple[int, int]]:
    """First bit and width of each segment: equal but for one bit, about log2(``codes``) wide.

    Below ``least`` bits, more segments would cost more candidates than they save probes.
    """
    width = max(least, (max(codes, 2) - 1).bit_length())
    segments = min(bits, max(1, round(bits / width)))
    ends = [bits * (i + 1) // segments for i in range(segments)]
    return [(a, b - a) for a, b in zip([0, *ends], ends)]


def _segment(code: Column, cut: tuple[int, int]) -> Column:
    first, width = cut
    if width == 64:
        return code
    return F.shiftrightunsigned(code, first).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _segments(code: str, at: list[tuple[int, int]]) -> Column:
    """Number, width and value of each segment of a code."""
    own = F.array(
        *[
            F.struct(F.lit(cut[1]).alias("width"), _segment(F.col(code), cut).alias("value"))
            for cut in at
        ]
    )
    return F.posexplode(own).alias("segment", "own")


def _probes(queries: DataFrame, radius: int, at: list[tuple[int, int]]) -> DataFrame:
    """Per query code and segment all values at exactly this distance: bits are flipped one after
    the other, each above the last, so every value comes up once."""
    rows = queries.select("query", _segments("query", at))
    rows = rows.selectExpr("query", "segment", "own.width", "own.value", "-1 as last")
    for _ in range(radius):
        above = F.sequence(F.col("last") + 1, F.col("width") - 1)
        rows = rows.where(F.col("last") < F.col("width") - 1)
        rows = rows.select("query", "segment", "width", "value", F.explode(above).alias("last"))
        flipped = F.expr("value ^ shiftleft(1L, last)").alias("value")
        rows = rows.select("query", "segment", "width", flipped, "last")
    return rows.drop("last", "width")


def _first_nearest(a: str, b: str, at: list[tuple[int, int]]) -> Column:
    """Which segment, of those in which two codes are nearest, comes first."""
    apart = [F.bit_count(_segment(F.col(a).bitwiseXOR(F.col(b)), cut)) for cut in at]
    return F.array_position(F.array(*apart), F.array_min(F.array(*apart))) - 1


def _best(rows: DataFrame, k: int) -> DataFrame:
    """The k nearest per query code, ties by id."""
    by_distance = Window.partitionBy("query").orderBy("distance", "id", "code")
    ranked = rows.withColumn("rank", F.row_number().over(by_distance))
    return ranked.where(F.col("rank") <= k)


def search(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    bits: int = 64,
    width: int | None = None,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """Per query ``query_id``, ``rank`` from 1 to k, the neighbour's id and their ``distance``.

    The query itself, by id and code, is not its own neighbour. ``width`` sets the segments' bits;
    without it they follow from the number of distinct codes.
    """
    there = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()

    def coded(rows: DataFrame) -> DataFrame:
        return rows.where(there).select(
            F.col(id_col).alias("id"), code_of(vector_col, bits).alias("code")
        )

    by_id = Window.partitionBy("code").orderBy("id")
    # one more than k, for the query itself; repeated rows go first
    members = coded(vectors).distinct().withColumn("_n", F.row_number().over(by_id))
    members = stored(members.where(F.col("_n") <= k + 1).drop("_n"), "nearest-members")
    codes = stored(members.select("code").distinct(), "nearest-codes")
    at = cuts(bits, codes.count()) if width is None else cuts(bits, 1 << width, width)
    segments, widest = len(at), max(cut[1] for cut in at)
    index = stored(
        codes.select("code", _segments("code", at)).selectExpr(
            "code", "segment", "own.value as value"
        ),
        "nearest-index",
    )
    asked = stored(coded(queries).distinct(), "nearest-queries")
    left = asked.select(F.col("code").alias("query")).distinct()
    best, done = None, None
    for radius in range(widest + 1):
        probes = _probes(left, radius, at)
        met = probes.join(index.hint("merge"), ["segment", "value"])
        met = met.where(F.col("segment") == _first_nearest("query", "code", at))
        met = met.select("query", "code", _distance("query", "code").alias("distance"))
        found = met.join(members.hint("merge"), "code").select("query", "id", "code", "distance")
        if best is not None:
            found = best.drop("rank").join(left.hint("merge"), "query").unionByName(found)
        best = stored(_best(found, k + 1), "nearest-best")
        covered = segments * (radius + 1) - 1
        state = best.groupBy("query").agg(
            F.count("*").alias("n"), F.max("distance").alias("far")
        )
        enough = (F.col("n") > k) & (F.col("far") <= covered)
        ready = state.where(enough).select("query") if radius < widest else state.select("query")
        part = best.join(ready.hint("merge"), "query", "left_semi")
        done = part if done is None else done.unionByName(part)
        left = stored(left.join(ready.hint("merge"), "query", "left_anti"), "nearest-left")
        if left.isEmpty():
            break
    answers = asked.select(F.col("id").alias("query_id"), F.col("code").alias("query")).join(
        done.hint("merge"), "query"
    )
    others = answers.where((F.col("id") != F.col("query_id")) | (F.col("code") != F.col("query")))
    # k + 1 rows per query at most
    place = Window.partitionBy("query_id", "query").orderBy("rank")
    return (
        others.withColumn("rank", F.row_number().over(place))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", F.col("id").alias(id_col), "distance")
    )
