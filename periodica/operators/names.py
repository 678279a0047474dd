"""Resolving typed names against a dimension of known names, as a batch job.

Exact matches are an equi-join on the normalised name. What is left is matched by similarity, in
steps of which each sees only the names that the ones before left open. None compares all pairs,
none loses a pair that counts:

1. Names within one edit, then within two. A name's deletion neighbourhood is the name with one or
   two letters out. If two names are within that many edits, a letter out of either for every letter
   changed, and out of the longer one for every letter added, leaves the same text; where letters
   were only changed, at the same places of both. Hashes of these texts are the join keys, some
   l * l for a name of l letters and two edits. A typed name is settled if what it found beats all
   that more edits could reach, which its length tells.
2. Names that are still open. A similarity of at least ``cutoff`` needs a minimum number of letters
   in common (counting repeats), which depends only on the two lengths. Names are grouped by how many
   letters they have of each of ``CLASSES`` classes, made of about equal size from the letters
   counted in the known names. Both sides' groups form trees, by the length, then the first counts,
   then all of them. The trees are descended together, by equi-joins of nodes with their children,
   and a pair of nodes is left as soon as the letters it has in common, and the most that the others
   may add, are too few. Only names of groups that meet at the leaves are compared.

What a step finds is staged in the shared folder (``sources/staging.py``), so that the next one
starts from there, and later steps are left out when no name is open. Joins of names are merge joins
by a hint: Spark tells the size of a staged table by its compressed file, and of a neighbourhood by
that of its name, so it would broadcast millions of rows through the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from periodica.functions import normalize_name, sequence_ratio
from periodica.sources.staging import staged

#: edits that the first steps find
NEAR_EDITS = 2

#: classes of letters that the last step counts; the first half of them is the tree's first level
CLASSES = 12


def name_dimension(df: DataFrame, name: str, order: Column | None = None) -> DataFrame:
    """Distinct names by normalised form, columns ``norm_key`` and ``name``.

    Of several names with one normalised form the last in ``order`` wins (by default the order of
    the names themselves).
    """
    if order is None:
        names = df.select(F.col(name).alias("name")).distinct()
        rank = F.col("name")
    else:
        names = df.groupBy(F.col(name).alias("name")).agg(F.max(order).alias("rank"))
        rank = F.struct("rank", "name")
    known = names.filter(F.col("name").isNotNull())
    keyed = known.withColumn("norm_key", normalize_name("name"))
    return keyed.groupBy("norm_key").agg(F.max_by("name", rank).alias("name"))


def split_list(df: DataFrame, column: str, sep: str = ",", name: str = "raw") -> DataFrame:
    """One row per trimmed entry of a separated list, with its position."""
    entries = F.posexplode(F.split(F.col(column), F.lit(f"\\Q{sep}\\E")))
    return df.select("*", entries.alias("position", "__entry")).select(
        *[c for c in df.columns if c != column], "position", F.trim("__entry").alias(name)
    )


def resolve(
    raw: DataFrame,
    column: str,
    dimension: DataFrame,
    method: str | None = "ratio",
    cutoff: float = 0.6,
) -> DataFrame:
    """Add ``match``, ``score`` and ``status`` (exact, suggested or unmatched) to every row.

    ``method`` scores the names without an exact match: ``ratio`` by matching blocks, ``edit`` by
    edit distance over the longer length, None not at all. The best score wins, of equal ones the
    normalised name that sorts last. Each distinct typed name is resolved once.
    """
    typed = raw.select(F.col(column).alias("typed")).filter(F.col(column).isNotNull()).distinct()
    keyed = typed.withColumn("typed_key", normalize_name("typed"))
    if method is not None:
        dimension = staged(dimension.select("norm_key", "name"), "names-known")
    looked_up = keyed.join(dimension.hint("merge"), F.col("typed_key") == F.col("norm_key"), "left")
    found = looked_up.select(
        "typed",
        "typed_key",
        F.col("name").alias("match"),
        F.when(F.col("name").isNotNull(), F.lit(1.0)).alias("score"),
    )
    if method is None:
        answers = found.drop("typed_key")
    else:
        found = staged(found, "names-exact")
        open_keys = found.filter(F.col("match").isNull()).select("typed_key").distinct()
        best = best_matches(open_keys, dimension, method, cutoff)
        answers = found.join(
            best.withColumnRenamed("typed_key", "best_key").hint("merge"),
            F.col("typed_key") == F.col("best_key"),
            "left",
        ).select(
            "typed",
            F.coalesce("match", "best_name").alias("match"),
            F.coalesce("score", "best_score").alias("score"),
        )
    status = (
        F.when(F.col("match").isNull(), F.lit("unmatched"))
        .when(F.col("score") == 1.0, F.lit("exact"))
        .otherwise(F.lit("suggested"))
    )
    answers = answers.withColumn("status", status)
    return raw.join(answers.hint("merge"), F.col(column) == F.col("typed"), "left").select(
        *raw.columns,
        "match",
        "score",
        F.coalesce("status", F.lit("unmatched")).alias("status"),
    )


def first_rows(df: DataFrame, name: str, order: list[Column]) -> DataFrame:
    """The first row of each name in ``order``."""
    position = Window.partitionBy(name).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(position)).filter("__n = 1").drop("__n")


def best_matches(
    keys: DataFrame, dimension: DataFrame, method: str, cutoff: float
) -> DataFrame:
    """Per ``typed_key`` the closest known name at or above ``cutoff``, if there is one."""
    if not 0 < cutoff <= 1:
        raise ValueError("cutoff must be above 0 and at most 1")
    open_keys = staged(keys.filter(F.length("typed_key") > 0).distinct(), "names-open")
    done: list[DataFrame] = []
    for edits in range(1, NEAR_EDITS + 1):
        if open_keys.isEmpty():
            break
        near = _best(_near_pairs(open_keys, dimension, edits, method), method, cutoff)
        # the best that a pair with more edits can score
        more, length = F.lit(edits + 1), F.length("typed_key")
        longest = 2 * length + more if method == "ratio" else length + more
        settled = F.col("best_score") > F.lit(1.0) - more / longest + F.lit(1e-9)
        tried = open_keys.join(near.hint("merge"), "typed_key", "left")
        tried = staged(
            tried.withColumn("settled", F.coalesce(settled, F.lit(False))), f"names-{edits}-edits"
        )
        done.append(tried.filter("settled").drop("settled"))
        open_keys = tried.filter("not settled").select("typed_key")
    if not done or not _of_fitting_length(open_keys, dimension, method, cutoff).isEmpty():
        done.append(_best(_candidates(open_keys, dimension, method, cutoff), method, cutoff))
    return reduce(DataFrame.unionByName, done)


def _lengths(length: Column, method: str, cutoff: float) -> Column:
    """The lengths that a name must have to reach ``cutoff`` with one of ``length`` letters."""
    stretch = (2 - cutoff) / cutoff if method == "ratio" else 1 / cutoff
    shortest = F.ceil(length / stretch - 1e-9).cast("int")
    return F.sequence(shortest, F.floor(length * stretch + 1e-9).cast("int"))


def _of_fitting_length(
    keys: DataFrame, dimension: DataFrame, method: str, cutoff: float
) -> DataFrame:
    """The lengths of known names that any of ``keys`` could be matched with."""
    able = keys.select(F.explode(_lengths(F.length("typed_key"), method, cutoff)).alias("length"))
    known = dimension.select(F.length("norm_key").alias("length"))
    return able.distinct().join(known.distinct(), "length", "left_semi")


def _best(pairs: DataFrame, method: str, cutoff: float) -> DataFrame:
    """The best pair of each typed key; of equal scores the name that sorts last."""
    longest = F.greatest(F.length("norm_key"), F.length("typed_key"))
    if method == "edit":
        score = F.lit(1.0) - F.levenshtein("norm_key", "typed_key") / longest
    elif method == "ratio":
        score = sequence_ratio("norm_key", "typed_key")
    else:
        raise ValueError(f"unknown method: {method}")
    scored = pairs.withColumn("score", score).filter(F.col("score") >= cutoff)
    best = F.max(F.struct("score", "norm_key", "name"))
    return (
        scored.groupBy("typed_key")
        .agg(best.alias("best"))
        .select(
            "typed_key",
            F.col("best.name").alias("best_name"),
            F.col("best.score").alias("best_score"),
        )
    )


def _one_out(name: str) -> str:
    """SQL for the texts of ``name`` with one letter out, by the place of the letter."""
    rest = f"concat(substring({name}, 1, i - 1), substring({name}, i + 1))"
    return f"transform(sequence(1, length({name})), i -> {rest})"


def _two_out(name: str) -> str:
    """The same with two letters out; none for a single letter."""
    rest = (
        f"concat(substring({name}, 1, i - 1), substring({name}, i + 1, j - i - 1),"
        f" substring({name}, j + 1))"
    )
    inner = f"transform(sequence(i + 1, length({name})), j -> {rest})"
    return (
        f"if(length({name}) < 2, array(),"
        f" flatten(transform(sequence(1, length({name}) - 1), i -> {inner})))"
    )


def _placed(texts: str) -> str:
    """Texts with the number of their place, which stands for the letters that are out."""
    return f"transform({texts}, (t, n) -> concat(n, ' ', t))"


def _neighbourhood(name: str, edits: int, is_typed: bool) -> str:
    """SQL for an array of (kind, text): a typed and a known name within ``edits`` share one."""
    whole, one, two = f"array({name})", _one_out(name), _two_out(name)
    if edits == 1:
        shorter, longer, changed = whole, one, _placed(one)
        known = {"less": f"concat({shorter}, {longer})", "more": shorter, "same": changed}
        typed = {"less": shorter, "more": longer, "same": changed}
    else:
        up_to_one = f"concat({whole}, {one})"
        known = {"less": two, "more": up_to_one, "swap": one, "same": _placed(two)}
        typed = {"less": up_to_one, "more": two, "swap": one, "same": _placed(two)}
    parts = [
        f"transform(array_distinct({texts}), t -> xxhash64('{kind}', t))"
        for kind, texts in (typed if is_typed else known).items()
    ]
    return f"concat({', '.join(parts)})"


def near_join(keys: DataFrame, dimension: DataFrame, edits: int = NEAR_EDITS) -> DataFrame:
    """Rows of a near step's join: typed and known names that share a text of their
    neighbourhoods, once for each. Pairs within ``edits`` are among them.

    Known names that are too long or too short for all typed ones are left out beforehand, by a list
    of lengths, which the longest name bounds.
    """
    length = F.length("typed_key")
    lengths = keys.select(F.explode(F.sequence(length - edits, length + edits)).alias("length"))
    dimension = dimension.join(
        F.broadcast(lengths.distinct()), F.length("norm_key") == F.col("length"), "left_semi"
    )
    typed = keys.filter(F.length("typed_key") > 0).select(
        "typed_key", F.explode(F.expr(_neighbourhood("typed_key", edits, True))).alias("text")
    )
    known = dimension.filter(F.length("norm_key") > 0).select(
        "norm_key", "name", F.explode(F.expr(_neighbourhood("norm_key", edits, False))).alias("text")
    )
    return typed.join(known.hint("merge"), "text").drop("text")


def _near_pairs(keys: DataFrame, dimension: DataFrame, edits: int, method: str) -> DataFrame:
    pairs = near_join(keys, dimension, edits).filter(
        F.levenshtein("typed_key", "norm_key", edits) >= 0
    )
    # edits are counted in passing; matching blocks are worth finding pairs that met twice
    return pairs if method == "edit" else pairs.distinct()


def _needed(a: Column, b: Column, method: str, cutoff: float) -> Column:
    """Letters that two names of these lengths must share to reach the cutoff."""
    whole = (a + b) / 2 if method == "ratio" else F.greatest(a, b)
    return F.ceil(whole * cutoff - 1e-9).cast("int")


def letter_classes(dimension: DataFrame, classes: int = CLASSES) -> list[str]:
    """The letters of the known names, dealt to classes of about equal counts. Letters that no
    known name has belong to the last class.

    Normalised names are ASCII, so no more than 128 counts come to the driver.
    """
    letters = dimension.select(F.explode(F.split("norm_key", "")).alias("letter"))
    counts = letters.filter("letter <> ''").groupBy("letter").count().collect()
    held, size = [""] * classes, [0] * classes
    for row in sorted(counts, key=lambda r: (-r["count"], r["letter"])):
        lightest = size.index(min(size))
        held[lightest] += row["letter"]
        size[lightest] += row["count"]
    return held


def _counted(names: DataFrame, name: str, side: str, classes: list[str]) -> DataFrame:
    """``names`` with the length (``<side>_len``) and a count for each class (``<side>0``, ...)."""
    out = names.filter(F.length(name) > 0).withColumn(f"{side}_len", F.length(name))
    for i, letters in enumerate(classes[:-1]):
        rest = F.length(F.translate(name, letters, "")) if letters else F.length(name)
        out = out.withColumn(f"{side}{i}", F.length(name) - rest)
    others = reduce(Column.__add__, [F.col(f"{side}{i}") for i in range(len(classes) - 1)])
    return out.withColumn(f"{side}{len(classes) - 1}", F.col(f"{side}_len") - others)


def _node(side: str, classes: int) -> list[str]:
    return [f"{side}_len", *[f"{side}{i}" for i in range(classes)]]


def _reach(classes: int) -> Column:
    """The most letters that names of two nodes can share: those of the classes counted so far, and
    of the others as many as the shorter rest has."""
    both = [F.least(f"t{i}", f"k{i}") for i in range(classes)]
    rests = [
        F.col(f"{side}_len") - reduce(Column.__add__, [F.col(f"{side}{i}") for i in range(classes)])
        for side in ("t", "k")
    ]
    return reduce(Column.__add__, [*both, F.least(*rests)])


def _letters(key: str) -> Column:
    """The letters of a name as tokens, each repeat a token of its own."""
    chars = F.split(F.col(key), "")

    def token(char: Column, i: Column) -> Column:
        return F.concat_ws(":", char, F.size(F.filter(F.slice(chars, 1, i + 1), lambda c: c == char)))

    return F.transform(chars, token)


def _candidates(
    keys: DataFrame, dimension: DataFrame, method: str, cutoff: float
) -> DataFrame:
    """Pairs (``typed_key``, ``norm_key``, ``name``) that share enough letters."""
    shared = F.size(F.array_intersect("typed_letters", "name_letters"))
    typed = keys.withColumn("typed_letters", _letters("typed_key"))
    known = dimension.withColumn("name_letters", _letters("norm_key"))
    return (
        far_join(typed, known, method, cutoff)
        .filter(shared >= _needed(F.col("t_len"), F.col("k_len"), method, cutoff))
        .select("typed_key", "norm_key", "name")
    )


def far_join(
    keys: DataFrame, dimension: DataFrame, method: str, cutoff: float
) -> DataFrame:
    """Rows of the last step's join: pairs of names whose groups meet at the leaves of the trees.

    A typed group has a row for each length that known names may have, a known group has one row.
    """
    classes = letter_classes(dimension)
    half, full = len(classes) // 2, len(classes)
    typed = _counted(keys, "typed_key", "t", classes)
    known = _counted(dimension, "norm_key", "k", classes)
    needed = _needed(F.col("t_len"), F.col("k_len"), method, cutoff)
    # the first level of both trees
    pairs = (
        typed.select(*_node("t", half))
        .distinct()
        .withColumn("k_len", F.explode(_lengths(F.col("t_len"), method, cutoff)))
        .join(known.select(*_node("k", half)).distinct(), "k_len")
        .filter(_reach(half) >= needed)
    )
    # their children: first those of the typed groups, then those of the known ones
    pairs = (
        pairs.join(typed.select(*_node("t", full)).distinct(), _node("t", half))
        .join(known.select(*_node("k", full)).distinct(), _node("k", half))
        .filter(_reach(full) >= needed)
    )
    return pairs.join(typed.hint("merge"), _node("t", full)).join(
        known.hint("merge"), _node("k", full)
    )
