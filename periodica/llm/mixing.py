"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

The size of a document is its number of words. A source's target is its share by weight of the
budget, at most ``most`` times its size; what exceeds that goes to the others by weight. Within a
source the expected copies of a document are ``min(most, c * preference)`` with the ``c`` that meets
the target; the preference is the number of binary digits of the size, so long documents are taken
a little more often. The whole part of the expected copies is certain. The rest is a probability p:
documents are ranked by random odds u/(1-u) over p/(1-p), u being a hash of the document, and taken
in that order until the words still due are reached, within half a document.

No source is ever ranked in one task. Ranks are cut into 2^12 ranges, the one that holds the cut
into 2^12 again, and only the rows in that one are put in order, rows of equal rank summed up first.
The cut is then a value per source which every document is compared with. Rows equal in id and text
share their place; a cut that falls among them takes as many of them as come nearest, found from
their number per task.

Nulls: a NULL text has size 0, NULL sources form the last source, a NULL id is hashed as such. Of
rows equal in id and text any may be the ones taken. Texts without words are never sampled, an empty
table gives an empty result, further columns are ignored by ``plan`` and kept by ``draw``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from periodica.llm.common import stored, word_count

_CUT = ["cut_rank", "cut_tie", "cut_rows", "cut_taken"]
_WAY = 12  # binary digits of a rank looked at in one pass


@dataclass(frozen=True)
class Mix:
    weights: Sequence[float] = (3, 1, 2)  # by rank of the source name, repeating
    budget: float = 1.5  # words of the mix, as a share of all words
    most: float = 2.0  # copies of a document at most
    seed: int = 7


def _filled(rows: DataFrame, due: Column, share: Column, cap: Column, within: list[str]):
    """Adds ``level``: min(cap, level * share) sums up to ``due`` (NULL if even the caps don't).

    With the rows in order of cap/share, a level is tried for each row as if all rows before it were
    capped and no later one; the right one is the largest that does not exceed its own row's ratio.
    """
    ordered = Window.partitionBy(*within).orderBy(F.col("_ratio"), *rows.columns)
    before, after = ordered.rowsBetween(Window.unboundedPreceding, -1), ordered.rowsBetween(
        0, Window.unboundedFollowing
    )
    return (
        rows.withColumn("_cap", cap)
        .withColumn("_share", share)
        .withColumn("_ratio", F.when(F.col("_share") > 0, F.col("_cap") / F.col("_share")))
        .withColumn(
            "_level",
            F.try_divide(
                due - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)),
                F.sum("_share").over(after),
            ),
        )
        .withColumn(
            "level",
            F.max(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level"))).over(
                Window.partitionBy(*within)
            ),
        )
        .drop("_cap", "_share", "_ratio", "_level")
    )


def targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """``target`` per source from ``source`` and ``source_size``, one row per source.

    The windows run over one row per source, which is all that is left by then.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in mix.weights])
    ranked = sizes.withColumn(
        "_weight", F.get(cycle, (F.row_number().over(by_name) - 1) % len(mix.weights))
    ).withColumn("_due", F.sum("source_size").over(Window.partitionBy()) * mix.budget)
    cap = F.col("source_size") * mix.most
    filled = _filled(ranked, F.col("_due"), F.col("_weight"), cap, [])
    return filled.select(
        "source",
        "source_size",
        F.least(F.coalesce(F.col("level") * F.col("_weight"), cap), cap).alias("target"),
    )


def _drawn(docs: DataFrame, id_col: str, text_col: str, source_col: str, mix: Mix) -> list[Column]:
    """Source, size, preference, random number and tie break of each document."""
    digest = F.xxhash64(F.lit(mix.seed), F.col(id_col), F.col(text_col))
    size = word_count(text_col)
    return [
        F.col(source_col).cast("string").alias("source"),
        size.alias("size"),
        F.length(F.bin(size)).cast("double").alias("preference"),
        ((F.shiftrightunsigned(digest, 11) + 0.5) / F.lit(float(1 << 53))).alias("u"),
        F.xxhash64(F.col(id_col), F.lit(mix.seed)).alias("tie"),
    ]


def _expected(level: Column, mix: Mix) -> tuple[Column, Column]:
    """Certain copies and the probability of one more, both of the columns at hand."""
    copies = F.least(
        F.coalesce(level * F.col("preference"), F.lit(mix.most)), F.lit(mix.most)
    )
    copies = F.round(copies, 9)  # a hair below a whole number is that number
    return F.floor(copies), copies - F.floor(copies)


def _rank(u: Column, p: Column) -> Column:
    """Random odds over inclusion odds, mapped onto 0 to 1 in order; NULL where p is 0."""
    odds = (u / (1 - u)) / (p / (1 - p))
    return F.when((p > 0) & (p < 1) & (F.col("size") > 0), odds / (1 + odds))


def _scored(rows: DataFrame, mix: Mix) -> DataFrame:
    """Adds ``certain`` and ``rank`` to rows joined with their source's ``level``."""
    certain, p = _expected(F.col("level"), mix)
    return (
        rows.withColumn("certain", certain)
        .withColumn("_p", p)
        .withColumn("rank", _rank(F.col("u"), F.col("_p")))
        .drop("_p")
    )


def _cuts(scored: DataFrame, due: DataFrame) -> DataFrame:
    """Where the words due are reached: ``source``, ``cut_rank``, ``cut_tie``, how many rows stand
    there (``cut_rows``) and how many of them are taken (``cut_taken``), which comes nearest.

    ``due`` has the words to be sampled per source; sources where all are taken get no row.
    """
    live = scored.where(F.col("rank").isNotNull())
    place = due
    for digits in (_WAY, 2 * _WAY):
        bucket = F.floor(F.col("rank") * float(1 << digits)).cast("long")
        sums = live.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("size"))
        place = _crossing(sums, place, ["bucket"]).select("source", "bucket", "due")
        live = (
            live.withColumn("_b", bucket)
            .join(
                place.select(F.col("source").alias("_s"), F.col("bucket").alias("_to")),
                F.col("source").eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_to")),
            )
            .drop("_s", "_b", "_to")
        )
        place = place.drop("bucket")
    sums = live.groupBy("source", "rank", "tie").agg(
        F.sum("size").alias("size"), F.count(F.lit(1)).alias("cut_rows")
    )
    # rows of one place are equal in text, so in size
    words_each = F.col("size") / F.col("cut_rows")
    return _crossing(sums, place, ["rank", "tie"]).select(
        "source",
        F.col("rank").alias("cut_rank"),
        F.col("tie").alias("cut_tie"),
        "cut_rows",
        F.floor(F.col("due") / words_each + 0.5).cast("long").alias("cut_taken"),
    )


def _crossing(sums: DataFrame, due: DataFrame, order: list[str]) -> DataFrame:
    """Per source the row at which the running sum passes what is due, with what is due from there."""
    running = Window.partitionBy("source").orderBy(*order)
    before = F.coalesce(
        F.sum("size").over(running.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    joined = sums.withColumn("before", before).join(
        due.select(F.col("source").alias("_s"), "due"), F.col("source").eqNullSafe(F.col("_s"))
    )
    passed = (F.col("before") <= F.col("due")) & (F.col("before") + F.col("size") > F.col("due"))
    return joined.drop("_s").where(passed).withColumn("due", F.col("due") - F.col("before"))


def _solve(rows: DataFrame, mix: Mix) -> DataFrame:
    """Per source its size, target, level and cut, from stored ``rows`` of ``_drawn``."""
    parts = rows.groupBy("source", "preference").agg(F.sum("size").alias("size"))
    sizes = parts.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(sizes, mix)
    parts = parts.join(
        goal.select(F.col("source").alias("_s"), "target"), F.col("source").eqNullSafe(F.col("_s"))
    ).drop("_s")
    levels = (
        _filled(
            parts,
            F.col("target"),
            F.col("preference") * F.col("size"),
            F.col("size") * mix.most,
            ["source"],
        )
        .groupBy("source")
        .agg(F.max("level").alias("level"))
    )
    plan = stored(
        goal.join(
            levels.select(F.col("source").alias("_s"), "level"),
            F.col("source").eqNullSafe(F.col("_s")),
            "left",
        ).drop("_s"),
        "mix-levels",
    )
    scored = _scored(_with(rows, plan, ["level"]), mix)
    certain = scored.groupBy("source").agg(F.sum(F.col("certain") * F.col("size")).alias("_c"))
    due = _with(plan, certain, ["_c"]).select("source", (F.col("target") - F.col("_c")).alias("due"))
    cuts = _cuts(scored, due)
    return stored(_with(plan, cuts, _CUT), "mix-cuts")


def _with(rows: DataFrame, small: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` with columns of the table that has one row per source."""
    return rows.join(
        small.select(F.col("source").alias("_s"), *columns),
        F.col("source").eqNullSafe(F.col("_s")),
        "left",
    ).drop("_s")


def _copies(rows: DataFrame, solved: DataFrame, mix: Mix) -> DataFrame:
    """Adds ``copies`` to rows that have the columns of ``_drawn``."""
    known = _with(rows, solved, ["source_size", "target", "level", *_CUT])
    scored = _scored(known, mix)
    at_cut = (F.col("rank") == F.col("cut_rank")) & (F.col("tie") == F.col("cut_tie"))
    below = (F.col("rank") < F.col("cut_rank")) | (
        (F.col("rank") == F.col("cut_rank")) & (F.col("tie") < F.col("cut_tie"))
    )
    below = below | (at_cut & (F.col("cut_taken") == F.col("cut_rows")))
    # no cut: the source's rows are all taken
    extra = F.col("rank").isNotNull() & F.coalesce(below, F.lit(True))
    copies = (F.col("certain") + extra.cast("long")).cast("long").alias("copies")
    columns = [f"`{c}`" for c in scored.columns]
    parted = (F.col("cut_taken") > 0) & (F.col("cut_taken") < F.col("cut_rows"))
    if solved.where(parted).isEmpty():
        return scored.select(*columns, copies)
    parted = F.coalesce(parted & at_cut, F.lit(False))
    whole = scored.where(~parted).select(*columns, copies)
    return whole.unionByName(_parted(scored.where(parted), columns))


def _parted(tied: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of one place of which ``cut_taken`` get one more copy.

    Equal rows are counted where they are, so a group of a third of all rows is one row per task,
    and those are numbered on: first the tasks, then the rows in a task.
    """
    counted = tied.groupBy(*columns, F.spark_partition_id().alias("_task"))
    counted = stored(counted.agg(F.count(F.lit(1)).alias("_n")), "mix-tied")
    so_far = "rows between unbounded preceding and 1 preceding"
    tasks = counted.groupBy("source", "_task").agg(F.sum("_n").alias("_held"))
    tasks = tasks.selectExpr(
        "source as _s",
        "_task as _t",
        f"coalesce(sum(_held) over (partition by source order by _task {so_far}), 0) as _before",
    )
    in_task = f"over (partition by source, _task order by xxhash64({', '.join(columns)}) {so_far})"
    numbered = counted.withColumn("_inside", F.expr(f"coalesce(sum(_n) {in_task}, 0)")).join(
        tasks, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_task") == F.col("_t"))
    )
    taken = "least(greatest(cut_taken - _before - _inside, 0), _n)"
    more = f"struct(certain + 1 as c, {taken} as n)"
    shares = f"inline(array({more}, struct(certain as c, _n - {taken} as n)))"
    shares = numbered.selectExpr(*columns, f"{shares} as (copies, _times)").where("_times > 0")
    copies = "cast(copies as long) as copies"
    single = shares.selectExpr(*columns, copies, "explode(sequence(1L, _times)) as _i")
    return single.drop("_i")


def plan(
    docs: DataFrame,
    mix: Mix = Mix(),
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Per document its id, source, size, source_size, target and copies."""
    rows = stored(
        docs.select(F.col(id_col).alias("id"), *_drawn(docs, id_col, text_col, source_col, mix)),
        "mix-sizes",
    )
    return _copies(rows, _solve(rows, mix), mix).select(
        F.col("id").alias(id_col),
        "source",
        "size",
        F.col("source_size").cast("long").alias("source_size"),
        "target",
        "copies",
    )


def draw(
    docs: DataFrame,
    mix: Mix = Mix(),
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken."""
    drawn = _drawn(docs, id_col, text_col, source_col, mix)
    rows = stored(docs.select(*drawn), "mix-sizes")
    solved = _solve(rows, mix)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *drawn)
    return (
        _copies(whole, solved, mix)
        .where("copies > 0")
        .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        .select("_row.*")
    )
