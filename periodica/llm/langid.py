"""Language identification by language-bitmask n-gram filters.

The letters of a text, with a mark at the edges of words, give overlapping trigrams. For every
language the trigrams that stand out in it are learnt, and all of them go into one bit-sliced Bloom
filter: each of its places holds words with one bit per language. Hashing a trigram to a few places
and combining them with AND tells, for all languages at once, which ones contain it. The bits are
counted per language over the whole text, and each count is corrected for the false positives that
the fill of that language's slice predicts. The largest corrected count decides; the score is its
share of all corrected counts.

Learning is bounded: of the ``languages`` with the most usable rows (of equal ones the first by name)
``sample`` documents each, chosen by a hash of id and text, with all of their text, and ``kept``
trigrams. A long text is looked at in pieces that together have just the trigrams of the whole. So the filter, which every task gets, has a size
that the number of languages fixes: 2^``digits`` places of one byte per eight languages, from 65
languages on of eight bytes for every 64.

``und`` with score 0 is the answer for a NULL text, one without a letter, or when nothing was
learnt. Of languages equal in count the first by name wins. Ids may be NULL or repeat, each row is
scored for itself; an empty table gives an empty result, further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from periodica.llm.common import PIECE, mixed, sampled

UNKNOWN = "und"

#: languages in one word of a place
WORD = 64


@dataclass(frozen=True)
class Learning:
    languages: int = 1000
    sample: int = 2000  # documents of a language
    kept: int = 20_000  # trigrams of a language
    least: int = 3  # times a trigram is seen in a language
    ratio: float = 0.5  # share of a trigram in a language against its largest share in any
    digits: int = 19
    probes: int = 3


@dataclass(frozen=True)
class Filter:
    """``places`` has a mask of languages per word and place; ``false`` the false positive rate of each."""

    languages: tuple[str, ...]
    places: np.ndarray
    false: np.ndarray
    probes: int

    def masks(self, grams: np.ndarray, word: int = 0) -> np.ndarray:
        """Which of the 64 languages of a word contain each n-gram, as bits."""
        return _combined(self.places[word], grams, self.probes)


_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """Whether each code point is a letter; made once in a worker."""
    if not _letters:
        flags = (chr(c).isalpha() for c in range(0x110000))
        _letters.append(np.fromiter(flags, bool, 0x110000))
    return _letters[0]


def _combined(places: np.ndarray, grams: np.ndarray, probes: int) -> np.ndarray:
    digits = np.uint64(len(places).bit_length() - 1)
    low = np.uint64(len(places) - 1)
    hashed = mixed(grams)
    out = places[hashed & low]
    for _ in range(probes - 1):
        hashed >>= digits
        out &= places[hashed & low]
    return out


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All trigrams of the texts, where each text's begin and end, and each text's letters."""
    low = [t.lower() for t in texts]
    lengths = np.fromiter(map(len, low), np.int64, len(low))
    joined = " ".join(["", *low, ""])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letter_table()[points]
    # one mark between words: the first that is no letter after a letter
    kept = letter.copy()
    kept[1:] |= letter[:-1]
    kept[0] = True
    starts = np.cumsum(lengths + 1) - lengths  # of the texts in ``points``
    ends = starts + lengths
    chars = np.where(letter, points, np.uint32(0))[kept]
    before = np.zeros(len(points) + 1, np.int64)
    np.cumsum(kept, out=before[1:])
    wide = chars.astype(np.uint64)
    grams = (wide[:-2] << np.uint64(42)) | (wide[1:-1] << np.uint64(21)) | wide[2:]
    whole = chars[1:-1] != 0
    place = np.zeros(len(whole) + 1, np.int64)
    np.cumsum(whole, out=place[1:])
    # a trigram belongs to the text of its middle letter
    first = np.clip(before[starts] - 1, 0, len(whole))
    last = np.clip(before[ends] - 1, 0, len(whole))
    letters = np.zeros(len(points) + 1, np.int64)
    np.cumsum(letter, out=letters[1:])
    return grams[whole], np.stack([place[first], place[last]]), letters[ends] - letters[starts]


def _split(text: str) -> Iterator[tuple[str, bool, bool]]:
    """A text in lower case, a long one in pieces that together have just its trigrams.

    Cuts are where no letter stands. Where there is none for half a piece, they part two letters:
    each piece then also has the other's letter, and says that its first or last letter is one.
    """
    text, start, before = text.lower(), 0, False
    while len(text) - start > PIECE:
        cut = start + PIECE
        while cut > start + PIECE // 2 and text[cut - 1].isalpha() and text[cut].isalpha():
            cut -= 1
        after = text[cut - 1].isalpha() and text[cut].isalpha()
        if after:
            cut = start + PIECE
        yield text[start - before : cut + after], before, after
        start, before = cut, after
    yield text[start - before :], before, False


def _pieces(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Trigrams of pieces of texts, a bounded number of characters at once: all of them in order,
    where each piece's begin and end, its letters, and the row it belongs to."""
    for parts in _bounded((i, *p) for i, t in enumerate(texts) for p in _split(t or "")):
        row, pieces, before, after = zip(*parts, strict=True)
        grams, (first, last), letters = trigrams(list(pieces))
        before, after = np.array(before, np.int64), np.array(after, np.int64)
        # a letter that another piece counts has the first or last trigram of its piece
        yield grams, np.stack([first + before, last - after]), letters - before - after, np.array(row)


def _bounded(parts: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Neighbouring pieces, with at most ``PIECE`` characters in sum or alone."""
    held, total = [], 0
    for part in parts:
        size = len(part[1]) + 1
        if held and total + size > PIECE:
            yield held
            held, total = [], 0
        held.append(part)
        total += size
    if held:
        yield held


# --- learning ---------------------------------------------------------------------------------


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        texts = batch.column("text").to_pylist()
        for lang in sorted(set(langs)):
            for found, (first, last), _, _ in _pieces([texts[i] for i in np.flatnonzero(langs == lang)]):
                own = np.zeros(len(found) + 1, np.int64)
                np.add.at(own, first, 1)
                np.add.at(own, last, -1)
                grams, times = np.unique(found[np.cumsum(own[:-1]) > 0], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(grams), pa.string()),
                        pa.array(grams.view(np.int64)),
                        pa.array(times.astype(np.int64)),
                    ],
                    ["lang", "gram", "times"],
                )


def learn(
    docs: DataFrame,
    usable: Column | bool = True,
    how: Learning = Learning(),
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> Filter:
    """The filter of the languages of the ``usable`` rows that have text and language."""
    rows = docs.where(F.lit(usable) if isinstance(usable, bool) else usable).select(
        F.col(lang_col).cast("string").alias("lang"),
        F.col(text_col).alias("text"),
        F.col(id_col).alias("id"),
    )
    rows = rows.where("lang is not null")
    most = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(how.languages)
    rows = rows.where("text is not null").join(F.broadcast(most.select("lang")), "lang", "left_semi")
    rows = sampled(rows, "lang", how.sample, 17)
    counts = rows.mapInArrow(_counted, "lang string, gram long, times long")
    counts = counts.groupBy("lang", "gram").agg(F.sum("times").alias("times"))
    share = F.col("times") / F.sum("times").over(Window.partitionBy("lang"))
    counts = counts.withColumn("share", share)
    most = F.max("share").over(Window.partitionBy("gram"))
    counts = counts.withColumn("most", most).where(
        (F.col("times") >= how.least) & (F.col("share") >= how.ratio * F.col("most"))
    )
    by_share = Window.partitionBy("lang").orderBy(F.desc("share"), "gram")
    best = counts.withColumn("_n", F.row_number().over(by_share)).where(F.col("_n") <= how.kept)
    # kept trigrams for each language
    table = best.select("lang", "gram").toArrow()
    return _filter(table, how)


def _filter(table: pa.Table, how: Learning) -> Filter:
    names, lang = np.unique(np.array(table.column("lang").to_pylist(), object), return_inverse=True)
    bits = min(len(names), WORD)
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if k(0).itemsize * 8 >= bits)
    places = np.zeros((-(-len(names) // WORD), 1 << how.digits), kind)
    grams = table.column("gram").to_numpy().view(np.uint64)[np.argsort(lang, kind="stable")]
    ends = np.cumsum(np.bincount(lang, minlength=len(names)))
    false = np.zeros(len(names))
    low, digits = np.uint64((1 << how.digits) - 1), np.uint64(how.digits)
    for n, mine in enumerate(np.split(grams, ends[:-1]) if len(names) else []):
        word, one = places[n // WORD], kind(1 << n % WORD)
        hashed = mixed(mine)
        for _ in range(how.probes):
            word[hashed & low] |= one
            hashed >>= digits
        false[n] = np.mean(word & one != 0) ** how.probes
    return Filter(tuple(names.tolist()), places, false, how.probes)


# --- deciding ---------------------------------------------------------------------------------


def corrected(hits: np.ndarray, grams: np.ndarray, false: np.ndarray) -> np.ndarray:
    """Hits per text and language without those that are expected by chance."""
    return np.maximum(0.0, (hits - grams[:, None] * false) / (1 - false))


def predict_texts(texts: list[str | None], known: Filter) -> tuple[list[str], np.ndarray]:
    size, languages = len(texts), len(known.languages)
    hits = np.zeros((size, languages))
    grams = np.zeros(size)
    letters = np.zeros(size, np.int64)
    one = known.places.dtype.type(1)
    for found, (first, last), here, row in _pieces(texts):
        np.add.at(letters, row, here)
        np.add.at(grams, row, last - first)
        total = np.zeros(len(found) + 1, np.int32)
        for n in range(languages):
            if n % WORD == 0:
                masks = known.masks(found, n // WORD)
            bit = known.places.dtype.type(n % WORD)
            np.cumsum((masks >> bit) & one, dtype=np.int32, out=total[1:])
            np.add.at(hits[:, n], row, total[last] - total[first])
    if not languages:
        return [UNKNOWN] * size, np.zeros(size)
    counts = corrected(hits, grams, known.false)
    best = counts.argmax(axis=1)
    total = counts.sum(axis=1)
    score = np.divide(counts[np.arange(size), best], total, out=np.zeros(size), where=total > 0)
    names = [known.languages[b] if k else UNKNOWN for b, k in zip(best, letters, strict=True)]
    return names, np.where(letters > 0, score, 0.0)


def predict(
    docs: DataFrame, known: Filter, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row its id, ``lang_pred`` and ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(known)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, score = predict_texts(batch.column("text").to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(names, pa.string()), pa.array(score)],
                ["id", "lang_pred", "score"],
            )

    return rows.mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed(
        "id", id_col
    )
