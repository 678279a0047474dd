"""Quality of documents from a linear-chain conditional random field over their lines.

Every line gets features of its own bytes and words, put into bins; the field sees the bins of the
line and of both neighbours. It labels lines good or bad, neighbours depending on each other.
Forward-backward gives each line's probability to be good, and the mean of these, weighted by the
length of the lines, is the document's quality, which a logistic curve brings onto the scale of the
labels.

Learning is bounded: at most ``sample`` labelled documents of each label, chosen by a hash of the id
among those with at most ``most_lines`` lines; their lines carry the document's label. Everything
else covers whole texts. Tasks take a bounded number of bytes and lines at once; a text with more goes
alone, in stretches of lines, with the messages between them carried on in both directions, so its
marginals are exact. What stays in memory of it is the text and a hash per line that isn't empty.

A NULL text counts as empty, and an empty text is one empty line. Ids may be NULL or repeat, each
row is scored for itself; where labels repeat, the lowest of a document counts, NULL labels don't.
Without labelled rows every score is 0.5. An empty table gives an empty result, further columns are
ignored by ``score`` and kept by ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from periodica.llm.common import PIECE, Spans, picked, runs, sampled_keys, words

#: documents with a score from here on are good
CUT = 0.7


@dataclass(frozen=True)
class Learning:
    sample: int = 2500  # documents of a label
    most_lines: int = 400  # lines of a document learnt from
    bins: int = 10  # of a feature
    rounds: int = 150
    rate: float = 0.1
    penalty: float = 1e-3


@dataclass(frozen=True)
class Field:
    """``edges`` of the bins per feature, weights of bins by neighbour, and of label changes."""

    edges: np.ndarray  # features x (bins - 1)
    weights: np.ndarray  # 3 x features x bins
    bias: float
    change: np.ndarray  # 2 x 2, score of a label after a label
    slope: float
    offset: float


# --- features ---------------------------------------------------------------------------------

#: kinds of bytes: lower, upper, digit, blank, end of sentence, other ASCII, letter beyond ASCII
_LOWER, _UPPER, _DIGIT, _BLANK, _STOP, _OTHER, _WIDE, _REST = range(8)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[97:123], _KIND[65:91], _KIND[48:58] = _LOWER, _UPPER, _DIGIT
_KIND[[32, *range(9, 14)]] = _BLANK
_KIND[[33, 44, 46, 58, 59, 63]] = _STOP  # ! , . : ; ?
_KIND[0x80:0xC0], _KIND[0xC0:] = _REST, _WIDE

FEATURES = 14

#: bytes of texts that ``keep`` takes out of a batch at once
TAKEN = 1 << 22

#: characters of a stretch of a long text, and lines from which on a text is long
STRETCH, LONG_LINES = 1 << 17, 1 << 14


def line_features(
    texts: list[str], times_of: tuple[np.ndarray, np.ndarray] | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features and lengths of all lines, and the number of lines of each text.

    ``times_of`` has the lines of a whole text, as sorted hashes, and how often each stands in it,
    if the texts are parts of that one.
    """
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(ends)
    lines = np.fromiter((p.count(b"\n") + 1 for p in parts), np.int64, len(parts))
    doc = np.repeat(np.arange(len(parts)), lines)
    length = (ends - starts).astype(np.float64)
    of = np.repeat(np.arange(n), ends - starts + 1)
    kinds = np.bincount(of * 8 + _KIND[data], minlength=n * 8).reshape(n, 8).astype(np.float64)
    kinds[:, _BLANK] -= 1  # the line's own end
    chars = np.maximum(kinds.sum(axis=1) - kinds[:, _REST], 1)
    spans = Spans(data)
    first, last = words(data)
    line_of_word = of[first] if len(first) else np.empty(0, np.int64)
    count = np.bincount(line_of_word, minlength=n)
    hashed = spans.hashes(first, last)
    order = np.lexsort((hashed, line_of_word))
    row, key = line_of_word[order], hashed[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    kinds_of_words = np.bincount(row[fresh], minlength=n)
    times = np.diff(np.append(np.flatnonzero(fresh), len(row)))
    commonest = np.zeros(n)
    np.maximum.at(commonest, row[fresh], times)
    # words that end in a sign which is neither stop nor letter nor digit
    closing = _KIND[data[last - 1]] if len(last) else np.empty(0, np.uint8)
    odd = np.bincount(line_of_word[closing == _OTHER], minlength=n)
    stopped = np.bincount(line_of_word[closing == _STOP], minlength=n)
    # how often the same line stands in the document
    line_key = spans.hashes(starts, ends)
    if times_of is None:
        order = np.lexsort((line_key, doc))
        by_doc, by_key = doc[order], line_key[order]
        fresh = np.ones(n, bool)
        fresh[1:] = (by_doc[1:] != by_doc[:-1]) | (by_key[1:] != by_key[:-1])
        same = np.diff(np.append(np.flatnonzero(fresh), n))
        repeats = np.empty(n)
        repeats[order] = np.repeat(same, same)
    else:
        repeats = np.ones(n)
        solid = length > 0
        repeats[solid] = times_of[1][np.searchsorted(times_of[0], line_key[solid])]
    known = np.maximum(count, 1)
    letters = kinds[:, _LOWER] + kinds[:, _UPPER] + kinds[:, _WIDE]
    table = [
        np.log1p(length),
        letters / chars,
        kinds[:, _UPPER] / np.maximum(letters, 1),
        kinds[:, _DIGIT] / chars,
        kinds[:, _BLANK] / chars,
        kinds[:, _STOP] / chars,
        kinds[:, _OTHER] / chars,
        count.astype(np.float64),
        length / known,
        kinds_of_words / known,
        commonest / known,
        odd / known,
        stopped / known,
        np.log1p((repeats - 1) * (length > 0)),
    ]
    return np.stack(table, axis=1), length, lines


def _pieces(texts: list[str | None]) -> Iterator[tuple[int, int, list[str]]]:
    full = [t or "" for t in texts]
    # a line takes as much memory as eight characters
    for a, b in runs([len(t) + 1 + 7 * t.count("\n") for t in full], PIECE):
        yield a, b, full[a:b]


# --- the field --------------------------------------------------------------------------------


def _binned(features: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.stack(
        [np.searchsorted(edges[f], features[:, f], side="right") for f in range(len(edges))], axis=1
    ).astype(np.int16)


def _seen(bins: np.ndarray, lines: np.ndarray, size: int) -> np.ndarray:
    """Indices into the flat weights of what each line sees: its own bins and both neighbours'.

    Beyond the ends of a document the index is one past the weights, which weighs nothing.
    """
    features = bins.shape[1]
    none = 3 * features * size
    kind = np.min_scalar_type(none)
    own = bins.astype(kind) + (np.arange(features) * size).astype(kind)
    begin = np.zeros(len(bins), bool)
    stop = np.zeros(len(bins), bool)
    ends = np.cumsum(lines)
    begin[ends - lines] = True
    stop[ends - 1] = True
    before = np.roll(own, 1, axis=0) + features * size
    after = np.roll(own, -1, axis=0) + 2 * features * size
    before[begin] = none
    after[stop] = none
    return np.concatenate([own, before, after], axis=1)


def _grid(lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents by falling length, and where their first lines are."""
    order = np.argsort(-lines, kind="stable")
    return order, (np.cumsum(lines) - lines)[order]


def marginals(
    good: np.ndarray, lines: np.ndarray, change: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Per line the probability of good, and of each pair of labels of it and the next line.

    ``good`` is the score of good against bad. Documents are taken together, one line after the
    other; those that have ended drop out.
    """
    n = len(good)
    forward = np.zeros((n, 2))
    backward = np.zeros((n, 2))
    pairs = np.zeros((n, 2, 2))
    order, first = _grid(lines)
    sizes = lines[order]
    local = np.zeros((n, 2))
    local[:, 1] = good
    longest = int(sizes[0]) if len(sizes) else 0
    active = [int(np.searchsorted(-sizes, -k, side="left")) for k in range(longest + 1)]
    forward[first] = local[first]
    for k in range(1, longest):
        at = first[: active[k]] + k
        step = forward[at - 1][:, :, None] + change
        forward[at] = np.logaddexp(step[:, 0], step[:, 1]) + local[at]
    for k in range(longest - 1, 0, -1):
        at = first[: active[k]] + k
        step = (backward[at] + local[at])[:, None, :] + change
        backward[at - 1] = np.logaddexp(step[:, :, 0], step[:, :, 1])
    both = forward + backward
    total = np.logaddexp(both[:, 0], both[:, 1])
    if longest > 1:
        inner = np.ones(n, bool)
        inner[np.cumsum(lines) - 1] = False
        at = np.flatnonzero(inner)
        score = (
            forward[at][:, :, None] + change + (local[at + 1] + backward[at + 1])[:, None, :]
        )
        pairs[at] = np.exp(score - total[at][:, None, None])
    return np.exp(both[:, 1] - total), pairs


def _weighed(seen: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    flat = np.append(weights.ravel(), 0.0)
    out = np.full(len(seen), bias)
    for column in range(seen.shape[1]):
        out += flat[seen[:, column]]
    return out


def _document_means(p: np.ndarray, length: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Mean over a document's lines, weighted by length; an empty line weighs a little, too."""
    doc = np.repeat(np.arange(len(lines)), lines)
    weight = length + 0.01
    return np.bincount(doc, p * weight, len(lines)) / np.bincount(doc, weight, len(lines))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit(
    features: np.ndarray,
    length: np.ndarray,
    lines: np.ndarray,
    label: np.ndarray,
    share: np.ndarray,
    how: Learning,
) -> Field:
    """The field that makes the lines' labels likeliest, by Adam on the exact gradient.

    ``share`` weighs documents, so that a label sampled less is not taken for a rarer one.
    """
    cuts = np.linspace(0, 1, how.bins + 1)[1:-1]
    edges = np.quantile(features, cuts, axis=0).T if len(features) else np.zeros((FEATURES, 9))
    seen = _seen(_binned(features, edges), lines, how.bins)
    doc = np.repeat(np.arange(len(lines)), lines)
    y = label[doc].astype(np.float64)
    # every document weighs the same, whatever the number of its lines
    weight = (share / lines)[doc]
    weight = weight / weight.sum()
    inner = np.ones(len(y), bool)
    inner[np.cumsum(lines) - 1] = False
    pair_weight = (weight * inner)[:, None, None]
    truth = np.zeros((2, 2))
    for v in (0, 1):
        truth[v, v] = (weight * inner * (y == v)).sum()
    n = 3 * features.shape[1] * how.bins
    state = np.zeros(n + 5)
    mean, square = np.zeros_like(state), np.zeros_like(state)
    for step in range(1, how.rounds + 1):
        change = state[n + 1 :].reshape(2, 2)
        p, pairs = marginals(_weighed(seen, state[:n], state[n]), lines, change)
        off = (y - p) * weight
        gradient = np.empty_like(state)
        gradient[:n] = 0
        for column in range(seen.shape[1]):
            gradient[:n] += np.bincount(seen[:, column], off, minlength=n + 1)[:n]
        gradient[n] = off.sum()
        gradient[n + 1 :] = (truth - (pairs * pair_weight).sum(axis=0)).ravel()
        gradient -= how.penalty * state
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        size = how.rate * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
        state = state + size * mean / (np.sqrt(square) + 1e-10)
    weights = state[:n].reshape(3, -1, how.bins)
    change = state[n + 1 :].reshape(2, 2)
    p, _ = marginals(_weighed(seen, weights, state[n]), lines, change)
    slope, offset = _curve(_logit(_document_means(p, length, lines)), label, share)
    return Field(edges, weights, float(state[n]), change, slope, offset)


def _curve(x: np.ndarray, y: np.ndarray, share: np.ndarray) -> tuple[float, float]:
    """Logistic regression of the label on one value, by Newton steps; never falling."""
    state = np.array([1.0, 0.0])
    design = np.stack([x, np.ones_like(x)], axis=1)
    share = share / share.sum()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ state, -30, 30)))
        gradient = design.T @ (share * (y - p)) - 1e-4 * (state - [1.0, 0.0])
        curvature = (design * (share * p * (1 - p))[:, None]).T @ design + 1e-4 * np.eye(2)
        state = state + np.clip(np.linalg.solve(curvature, gradient), -1, 1)
    return max(float(state[0]), 1e-3), float(state[1])


def score_texts(texts: list[str | None], field: Field | None) -> np.ndarray:
    out = np.full(len(texts), 0.5)
    if field is None:
        return out
    size = field.weights.shape[2]
    long = [i for i, t in enumerate(texts) if t and _is_long(t)]
    texts = list(texts)
    for i in long:
        out[i], texts[i] = _score_long(texts[i], field), None
    means = out[long]
    for a, b, part in _pieces(texts):
        features, length, lines = line_features(part)
        seen = _seen(_binned(features, field.edges), lines, size)
        p, _ = marginals(_weighed(seen, field.weights, field.bias), lines, field.change)
        x = _logit(_document_means(p, length, lines))
        out[a:b] = 1 / (1 + np.exp(-(field.slope * x + field.offset)))
    out[long] = 1 / (1 + np.exp(-(field.slope * _logit(means) + field.offset)))
    return out


# --- long texts -------------------------------------------------------------------------------


def _is_long(text: str) -> bool:
    breaks = text.count("\n")
    return breaks >= LONG_LINES or (breaks > 0 and len(text) > PIECE)


def _stretches(text: str) -> Iterator[tuple[int, int]]:
    """Starts and ends of stretches of whole lines; the line break between two is in neither."""
    start = 0
    while len(text) - start > STRETCH:
        end = text.rfind("\n", start, start + STRETCH)
        if end < 0:
            end = text.find("\n", start + STRETCH)
        if end < 0:
            break
        yield start, end
        start = end + 1
    yield start, len(text)


def _times(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lines that aren't empty, sorted, and how often each line stands in the text."""
    keys = []
    for a, b in _stretches(text):
        data = np.frombuffer(text[a:b].encode("utf-8", "surrogatepass") + b"\n", np.uint8)
        ends = np.flatnonzero(data == 10)
        starts = np.concatenate([[0], ends[:-1] + 1])
        keys.append(Spans(data).hashes(starts, ends)[ends > starts])
    return np.unique(np.concatenate(keys), return_counts=True)


def _scores(
    text: str, a: int, b: int, field: Field, times_of: tuple[np.ndarray, np.ndarray]
) -> tuple[np.ndarray, np.ndarray]:
    """Scores of good against bad, and lengths, of the lines of a stretch."""
    # with the line before and the one after, which its first and last line see
    low = text.rfind("\n", 0, a - 1) + 1 if a else 0
    high = text.find("\n", b + 1) if b < len(text) else b
    high = len(text) if high < 0 else high
    features, length, lines = line_features([text[low:high]], times_of)
    seen = _seen(_binned(features, field.edges), lines, field.weights.shape[2])
    own = slice(int(a > 0), len(length) - int(b < len(text)))
    return _weighed(seen[own], field.weights, field.bias), length[own]


def _chained(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of matrices of logarithms, summed over two labels."""
    return np.logaddexp(a[..., :1] + b[..., :1, :], a[..., 1:] + b[..., 1:, :])


def _blocks(n: int) -> np.ndarray:
    """Sizes of about as many blocks of lines as a block has lines."""
    size = max(1, int(np.sqrt(n)))
    sizes = np.full(-(-n // size), size)
    sizes[-1] = n - size * (len(sizes) - 1)
    return sizes


def _passes(good: np.ndarray, sizes: np.ndarray, change: np.ndarray) -> np.ndarray:
    """Per block the log sum over all labellings, by the label of its first and of its last line."""
    first = np.cumsum(sizes) - sizes
    local = np.stack([np.zeros(len(good)), good], axis=1)
    out = np.where(np.eye(2, dtype=bool), local[first][:, None, :], -np.inf)
    for k in range(1, int(sizes.max())):
        live = np.flatnonzero(sizes > k)
        out[live] = _chained(out[live], change) + local[first[live] + k][:, None, :]
    return out


def _messages(passes: list[np.ndarray], change, enter, leave) -> tuple[np.ndarray, np.ndarray]:
    """What the lines before say about the first label of each part, and those after about its last."""
    enters, leaves = np.empty((len(passes), 2)), np.empty((len(passes), 2))
    for i, through in enumerate(passes):
        enters[i] = enter
        enter = _chained(_chained(enter[None], through), change)[0]
    for i in range(len(passes) - 1, -1, -1):
        leaves[i] = leave
        leave = _chained(change, _chained(passes[i], leave[:, None]))[:, 0]
    return enters, leaves


def _part_marginals(good, change, enter, leave) -> np.ndarray:
    """Probabilities of good of a stretch's lines: its blocks side by side, messages at their ends."""
    sizes = _blocks(len(good))
    enters, leaves = _messages(list(_passes(good, sizes, change)), change, enter, leave)
    ends = np.cumsum(sizes)
    known = good.copy()
    known[ends - sizes] += enters[:, 1] - enters[:, 0]
    known[ends - 1] += leaves[:, 1] - leaves[:, 0]
    return marginals(known, sizes, change)[0]


def _score_long(text: str, field: Field) -> float:
    """The mean of a text's marginals by length, from two passes over its stretches."""
    times_of = _times(text)
    spans = list(_stretches(text))
    passes = []
    for a, b in spans:
        good, _ = _scores(text, a, b, field, times_of)
        blocks = _passes(good, _blocks(len(good)), field.change)
        whole = blocks[0]
        for block in blocks[1:]:
            whole = _chained(_chained(whole, field.change), block)
        passes.append(whole)
    enters, leaves = _messages(passes, field.change, np.zeros(2), np.zeros(2))
    total = weight = 0.0
    for (a, b), enter, leave in zip(spans, enters, leaves, strict=True):
        good, length = _scores(text, a, b, field, times_of)
        p = _part_marginals(good, field.change, enter, leave)
        total += float((p * (length + 0.01)).sum())
        weight += float((length + 0.01).sum())
    return total / weight


# --- on Spark ---------------------------------------------------------------------------------


def learn(
    docs: DataFrame,
    labels: DataFrame,
    usable: Column | bool = True,
    how: Learning = Learning(),
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> Field | None:
    """The field from a bounded sample of the ``usable`` documents that have a label."""
    rated = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
    rated = rated.agg(F.min(label_col).cast("int").alias("label"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.where(F.lit(usable) if isinstance(usable, bool) else usable).select(
        F.col(id_col).alias("id"), text.alias("text")
    )
    few = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"))) < how.most_lines
    keys = rows.where(few).select("id", F.xxhash64("text").alias("_text")).join(rated, "id")
    chosen = keys.select("label", "id", "_text")
    sizes = {r["label"]: r["count"] for r in chosen.groupBy("label").count().collect()}
    rows = picked(rows, sampled_keys(chosen, "label", how.sample, 23))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels_of = batch.column("label").to_numpy()
            for a, b, part in _pieces(batch.column("text").to_pylist()):
                table, length, lines = line_features(part)
                packed = np.concatenate([table, length[:, None]], axis=1).astype("<f4")
                ends = np.concatenate([[0], np.cumsum(lines)])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(labels_of[a:b].astype(np.int32)),
                        pa.array([packed[i:j].tobytes() for i, j in zip(ends, ends[1:])]),
                    ],
                    ["label", "lines"],
                )

    # at most 2 x sample documents of most_lines lines
    found = rows.select("label", "text").mapInArrow(features, "label int, lines binary")
    table = found.toArrow()
    label = table.column("label").to_numpy()
    if not len(label):
        return None
    parts = [
        np.frombuffer(b, "<f4").reshape(-1, FEATURES + 1) for b in table.column("lines").to_pylist()
    ]
    order = sorted(range(len(parts)), key=lambda i: (label[i], parts[i].tobytes()))
    parts, label = [parts[i] for i in order], label[order]
    lines = np.fromiter(map(len, parts), np.int64, len(parts))
    flat = np.concatenate(parts).astype(np.float64)
    drawn = {k: (label == k).sum() for k in sizes}
    share = np.array([sizes[k] / drawn[k] for k in label])
    return fit(flat[:, :-1], flat[:, -1], lines, label, share, how)


def _scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = score_texts(batch.column(1).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["id", "score"])

    return run


def _scored(texts: pa.Array, field: Field) -> np.ndarray:
    """Scores of an array of texts, of which a bounded number of bytes at once are Python strings."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    parts = (texts.slice(a, b - a).to_pylist() for a, b in runs(sizes, TAKEN))
    return np.concatenate([np.empty(0), *(score_texts(part, field) for part in parts)])


def score(
    docs: DataFrame, field: Field | None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row its id and ``score``, higher for better."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(field)
    return rows.mapInArrow(_scorer(shared), f"id {kind}, score double").withColumnRenamed(
        "id", id_col
    )


def keep(
    docs: DataFrame, field: Field | None, cut: float = CUT, text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``cut``; all if nothing was learnt.

    Only texts go to Python, once, and only scores come back.
    """
    if field is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(field)

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(_scored(texts, shared.value))

    return docs.where(scored(F.col(text_col).cast("string")) >= cut)
