"""Personal data by patterns and a skip-chain conditional random field.

Patterns give the base spans: email and IP addresses, card numbers, phone numbers. The field then
labels all tokens that have a digit or an at sign (no other token can be one of these kinds): each
has potentials from its shape and its neighbours' shapes, tokens next to each other share a
potential of their labels, and so do, over any distance, tokens of one document that repeat each
other or are similar: the same digits in other writing, the end of the digits of a base span, also
in groups between blanks and after zeros, the same address but for case and punctuation. Base spans are clamped. Loopy message passing carries
their labels along these links, so that a number found once is found again where it is written
differently. Tokens become spans if the field is sure and a link, direct or from the token beside,
leads to a base span of that kind; a document without base spans so stays clean.

The potentials are learnt piece by piece, with the base spans as labels, from at most ``sample``
documents chosen by a hash of id and text, and at most ``tokens`` of their tokens. Finding covers whole texts. All patterns take time
linear in the text. Offsets are code points, ends exclusive.

A NULL text is empty and has no spans; ids may be NULL or repeat, each row is searched for itself.
An empty table gives an empty result, further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from periodica.llm.common import sampled, stored

KINDS = ("email", "ip", "card", "phone")
NONE = len(KINDS)  # the label of other tokens
LABELS = NONE + 1

#: digits from which on equal digits mean the same number
SAME_DIGITS = 7


@dataclass(frozen=True)
class Learning:
    sample: int = 4000  # documents
    tokens: int = 200_000  # tokens learnt from
    digits: int = 14  # of the hashed features
    rounds: int = 120
    rate: float = 0.2
    penalty: float = 1e-5


@dataclass(frozen=True)
class Field:
    weights: np.ndarray  # features x labels
    beside: np.ndarray  # label x label, tokens next to each other
    alike: np.ndarray  # label x label, linked tokens


# --- patterns ---------------------------------------------------------------------------------

_MAY = re.compile(r"[0-9@]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """What the pattern of local part, at sign and domain finds, from the at signs outwards."""
    end = 0
    for match in _DOMAIN.finditer(text):
        start = match.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < match.start():
            end = match.end()
            yield start, end


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Start, end and kind of all that the patterns find, by start, then kind."""
    if not _MAY.search(text):
        return []
    out = [(a, b, 0) for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((*m.span(), 1))
    for m in _CARD.finditer(text):
        digits = _NO_DIGIT.sub("", m[0])
        if 14 <= len(digits) <= 19 and _luhn(digits):
            out.append((*m.span(), 2))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NO_DIGIT.sub("", m[0])) <= 15:
                out.append((*m.span(), 3))
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


# --- the graph of a document ------------------------------------------------------------------

_RUNS = (
    (re.compile(r"[0-9]"), "9"),
    (re.compile(r"[^\W\d_]"), "a"),
    (re.compile(r"(.)\1{3,}"), r"\1\1\1+"),
)
_NEAR = 48  # characters looked at for a neighbour's shape


def _shape(token: str) -> str:
    token = token[:64] + (f"~{len(token).bit_length()}" if len(token) > 64 else "")
    for pattern, by in _RUNS:
        token = pattern.sub(by, token)
    return token


def _tokens(text: str) -> list[tuple[int, int]]:
    """Tokens that have a digit or an at sign; each blank-free run is looked at once."""
    out, at = [], 0
    while match := _MAY.search(text, at):
        a, b = match.span()
        while a > at and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        out.append((a, b))
        at = b
    return out


def _features(text: str, a: int, b: int, digits: int) -> list[int]:
    token = text[a:b]
    before = text[max(0, a - _NEAR) : a].split()
    after = text[b : b + _NEAR].split()
    left = before[-1] if before else ""
    right = after[0] if after else ""
    count = min(sum(c in "0123456789" for c in token[:64]), 20)
    names = [
        "s" + _shape(token),
        f"d{count}",
        f"@{'@' in token}{count > 0}",
        f"f{token[:1] if not token[:1].isalnum() else ''}",
        "l" + _shape(left),
        "r" + _shape(right),
        "w" + left.lower()[:24],
        "b",
    ]
    return [zlib.crc32(n.encode("utf-8", "surrogatepass")) & ((1 << digits) - 1) for n in names]


def _is_word(char: str) -> bool:
    return char.isalnum() or char == "_"


def _key(token: str) -> str | None:
    """What a token has in common with those it repeats."""
    if "@" in token:
        # from both ends by index: a run of marks inside must not be tried from each of its places
        a, b = 0, len(token)
        while a < b and not _is_word(token[a]):
            a += 1
        while b > a and not _is_word(token[b - 1]):
            b -= 1
        return "@" + token[a:b].casefold()
    digits = _NO_DIGIT.sub("", token)
    return digits if len(digits) >= SAME_DIGITS else None


_GROUP = re.compile(r"[^\w\s@]*[0-9](?:[^\w\s@]*[0-9])*[^\w\s@]*")
_GROUP_CHARS = 64  # a group is no longer
_ZEROS = 3  # digits that a repeat may have in front beyond those of the base span


@dataclass
class _Graph:
    """Tokens of one document, their labels from base spans (NONE elsewhere), and the links."""

    spans: list[tuple[int, int]]
    label: list[int]
    keys: list[str | None]
    beside: list[tuple[int, int]]
    alike: list[tuple[int, int]]
    known: dict[str, set[int]]  # keys that base spans have, with their kinds
    repeats: dict[int, tuple[int, set[int]]]  # tokens of repeats: first token, kinds


def _graph(text: str, base: list[tuple[int, int, int]]) -> _Graph:
    spans = _tokens(text)
    label, own = [], []  # label and first base span of each token
    i = 0
    for a, b in spans:
        while i < len(base) and base[i][1] <= a:
            i += 1
        hit = next((k for k in range(i, len(base)) if base[k][1] > a), None)
        inside = hit is not None and base[hit][0] < b
        label.append(base[hit][2] if inside else NONE)
        own.append(hit if inside else None)
    keys = [_key(text[a:b]) for a, b in spans]
    beside = [
        (k, k + 1)
        for k in range(len(spans) - 1)
        if spans[k + 1][0] - spans[k][1] <= 4 and text[spans[k][1] : spans[k + 1][0]].isspace()
    ]
    # a key's tokens are linked one to the next; ends of a base span's digits link to its last token
    last: dict[str, int] = {}
    known: dict[str, set[int]] = {}
    ends: dict[str, tuple[int, set[int]]] = {}  # of numbers: last token, kinds
    alike = []
    for k, hit in enumerate(own):
        if hit is None:
            continue
        if keys[k]:
            known.setdefault(keys[k], set()).add(label[k])
        if label[k] != 0 and (k + 1 == len(own) or own[k + 1] != hit):
            digits = _NO_DIGIT.sub("", text[base[hit][0] : base[hit][1]])
            for n in range(SAME_DIGITS, len(digits) + 1):
                known.setdefault(digits[-n:], set()).add(label[k])
                last.setdefault(digits[-n:], k)
                if label[k] != KINDS.index("ip"):
                    ends.setdefault(digits[-n:], (k, set()))[1].add(label[k])
    repeats: dict[int, tuple[int, set[int]]] = {}
    for first, behind, (base_token, kinds) in _repeats(text, spans, label, set(beside), ends):
        for k in range(first, behind):
            repeats[k] = first, kinds
            if keys[k] not in known:
                alike.append((base_token, k))
    for k, key in enumerate(keys):
        if key:
            if key in last and last[key] != k:
                alike.append((last[key], k))
            last[key] = k
    return _Graph(spans, label, keys, beside, alike, known, repeats)


def _repeats(
    text: str,
    spans: list[tuple[int, int]],
    label: list[int],
    beside: set[tuple[int, int]],
    ends: dict[str, tuple[int, set[int]]],
) -> Iterator[tuple[int, int, tuple[int, set[int]]]]:
    """Runs of neighbouring groups of digits that make up the end of a known number, as they stand
    or without zeros in front: first token, the one behind the last, and what is known.

    The longest from each token on counts. Every token has a digit, so as many are looked at as a
    number has digits.
    """
    if not ends:
        return
    most = max(map(len, ends)) + _ZEROS
    groups = [
        _NO_DIGIT.sub("", text[a:b])
        if kind == NONE and b - a <= _GROUP_CHARS and _GROUP.fullmatch(text, a, b)
        else ""
        for (a, b), kind in zip(spans, label, strict=True)
    ]
    first = 0
    while first < len(groups):
        joined, at, found = groups[first], first + 1, None
        while joined and len(joined) <= most:
            hit = ends.get(joined) or ends.get(joined.lstrip("0"))
            if hit:
                found = first, at, hit
            if at == len(groups) or not groups[at] or (at - 1, at) not in beside:
                break
            joined += groups[at]
            at += 1
        if found:
            yield found
        first = found[1] if found else first + 1


# --- potentials and messages ------------------------------------------------------------------


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def _association(pairs: np.ndarray) -> np.ndarray:
    """How much more often two labels meet than by chance, as log potentials."""
    n = pairs + pairs.T + 0.5
    share = n / n.sum()
    alone = share.sum(axis=1)
    return np.clip(np.log(share / np.outer(alone, alone)), -4, 4)


def beliefs(
    local: np.ndarray, links: np.ndarray, potentials: np.ndarray, rounds: int = 30
) -> np.ndarray:
    """Marginals of the labels by loopy message passing, all links at once, damped.

    ``local`` has the log potentials per node, ``links`` pairs of nodes, ``potentials`` the log
    potentials of their labels (links x labels x labels). Without cycles this is exact.
    """
    if not len(links):
        return _softmax(local)
    source = np.concatenate([links[:, 0], links[:, 1]])
    target = np.concatenate([links[:, 1], links[:, 0]])
    table = np.exp(np.concatenate([potentials, potentials.transpose(0, 2, 1)]))
    back = np.roll(np.arange(len(source)), len(links))
    messages = np.full((len(source), local.shape[1]), 1.0 / local.shape[1])
    for _ in range(rounds):
        logs = np.log(np.maximum(messages, 1e-30))
        total = local.copy()
        np.add.at(total, target, logs)
        out = total[source] - logs[back]
        new = np.einsum("ea,eab->eb", _softmax(out), table)
        new = 0.5 * messages + 0.5 * new / new.sum(axis=1, keepdims=True)
        moved = np.abs(new - messages).max()
        messages = new
        if moved < 1e-4:
            break
    total = local.copy()
    np.add.at(total, target, np.log(np.maximum(messages, 1e-30)))
    return _softmax(total)


def fit(
    seen: np.ndarray, label: np.ndarray, beside: np.ndarray, alike: np.ndarray, how: Learning
) -> Field:
    """Potentials, piece by piece: logistic regression of labels on features (a row per token),
    and how often tokens with two labels were linked."""
    weights = np.zeros((1 << how.digits, LABELS))
    if len(seen):
        truth = np.eye(LABELS)[label]
        square = np.full_like(weights, 1e-8)
        for _ in range(how.rounds):
            off = (truth - _softmax(weights[seen].sum(axis=1))) / len(seen)
            gradient = -how.penalty * weights
            for column in range(seen.shape[1]):
                np.add.at(gradient, seen[:, column], off)
            square += gradient**2
            weights += how.rate * gradient / np.sqrt(square)
    # linked tokens agree: counts say how far, agreement is what is to be shared
    return Field(weights, _association(beside), np.maximum(_association(alike), 0) * np.eye(LABELS))


_CLAMPED = 40.0
_SURE = 0.8


def added_spans(
    text: str, base: list[tuple[int, int, int]], field: Field
) -> list[tuple[int, int, int]]:
    """Spans beyond the base, from the field over all of the document's tokens."""
    graph = _graph(text, base)
    if not graph.spans:
        return []
    digits = len(field.weights).bit_length() - 1
    seen = np.array([_features(text, a, b, digits) for a, b in graph.spans])
    local = field.weights[seen].sum(axis=1)
    label = np.array(graph.label)
    fixed = label != NONE
    local[fixed] = 0.0
    local[fixed, label[fixed]] = _CLAMPED
    links = np.array(graph.beside + graph.alike, np.int64).reshape(-1, 2)
    potentials = np.concatenate(
        [
            np.repeat(field.beside[None], len(graph.beside), axis=0),
            np.repeat(field.alike[None], len(graph.alike), axis=0),
        ]
    )
    # a link says as much as the clamped label is sure; alone it must outweigh the token's shape
    potentials[len(graph.beside) :] += np.eye(LABELS) * 12.0
    belief = beliefs(local, links, potentials)
    best = belief.argmax(axis=1)
    sure = (belief.max(axis=1) >= _SURE) & (best != NONE) & ~fixed
    linked = [
        bool(key) and int(b) in graph.known.get(key, ())
        or k in graph.repeats and int(b) in graph.repeats[k][1]
        for k, (key, b) in enumerate(zip(graph.keys, best, strict=True))
    ]
    found = sure & np.array(linked, bool)
    neighbours = set(graph.beside)
    for order in (range(1, len(found)), range(len(found) - 2, -1, -1)):
        for k in order:
            other = k - 1 if order.step > 0 else k + 1
            pair = (min(k, other), max(k, other))
            if sure[k] and found[other] and best[k] == best[other] and pair in neighbours:
                found[k] = True
    out: list[tuple[int, int, int]] = []
    end_token = -2
    for k in np.flatnonzero(found).tolist():
        a, b = graph.spans[k]
        while b > a and not (text[b - 1].isalnum() or text[b - 1] == ")"):
            b -= 1
        while a < b and not (text[a].isalnum() or text[a] in "+("):
            a += 1
        kind = int(best[k])
        joined = out and end_token == k - 1 and (k - 1, k) in neighbours and out[-1][2] == kind
        if k in graph.repeats and k - 1 in graph.repeats:
            joined = joined and graph.repeats[k][0] == graph.repeats[k - 1][0]
        if joined:
            out[-1] = (out[-1][0], b, kind)
        elif a < b:
            out.append((a, b, kind))
        end_token = k
    return out


def spans(text: str, field: Field | None) -> list[tuple[int, int, int, bool]]:
    """All spans by start, then kind: start, end, kind and whether the patterns gave it."""
    base = base_spans(text)
    out = [(*s, True) for s in base]
    if base and field is not None:
        out += [(*s, False) for s in added_spans(text, base, field)]
        out.sort(key=lambda s: (s[0], s[2], s[1]))
    return out


# --- on Spark ---------------------------------------------------------------------------------


_TOKENS = "doc long, place int, features array<int>, label int, beside array<int>, alike array<int>"
_AT_ONCE = 10_000  # tokens


def _examples(digits: int):
    """Tokens of texts: features, label, and the labels of their links as one number each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = pa.list_(pa.int32())
        for batch in batches:
            docs = batch.column("doc").to_pylist()
            for doc, text in zip(docs, batch.column("text").to_pylist(), strict=True):
                graph = _graph(text, base_spans(text))
                pairs: tuple[dict, dict] = {}, {}
                for links, of in zip((graph.beside, graph.alike), pairs, strict=True):
                    for i, j in links:
                        of.setdefault(i, []).append(graph.label[i] * LABELS + graph.label[j])
                for start in range(0, len(graph.spans), _AT_ONCE):
                    here = range(start, min(start + _AT_ONCE, len(graph.spans)))
                    rows = [_features(text, *graph.spans[k], digits) for k in here]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([doc] * len(here), pa.int64()),
                            pa.array(here, pa.int32()),
                            pa.array(rows, lists),
                            pa.array([graph.label[k] for k in here], pa.int32()),
                            *[pa.array([of.get(k, []) for k in here], lists) for of in pairs],
                        ],
                        ["doc", "place", "features", "label", "beside", "alike"],
                    )

    return run


def learn(
    docs: DataFrame, how: Learning = Learning(), id_col: str = "doc_id", text_col: str = "text"
) -> Field:
    """The field, learnt from what patterns find. Texts stay in the tasks: the driver gets
    ``how.tokens`` rows of feature numbers, in the order of a hash of their document, and how often
    each two labels were linked."""
    rows = docs.select(
        F.lit(0).alias("all"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")
    )
    rows = rows.where(F.col("text").rlike("[0-9@]"))
    texts = sampled(rows, "all", how.sample, 31).select(
        F.xxhash64("id", "text").alias("doc"), _around("text").alias("text")
    )
    tokens = stored(texts.mapInArrow(_examples(how.digits), _TOKENS), "pii-tokens")
    first = tokens.select("doc", "place", "features", "label").orderBy("doc", "place")
    first = first.limit(how.tokens).toArrow()
    width = len(first.column("features")[0]) if len(first) else 0
    features = first.column("features").combine_chunks().flatten().to_numpy()
    linked = {}
    for name in ("beside", "alike"):
        counts = np.zeros(LABELS * LABELS)
        pairs = tokens.select(F.explode(name).alias("pair")).groupBy("pair").count()
        for pair, count in pairs.collect():
            counts[pair] = count
        linked[name] = counts.reshape(LABELS, LABELS)
    label = first.column("label").to_numpy()
    return fit(features.reshape(-1, width or 1), label, linked["beside"], linked["alike"], how)


def _around(text: str):
    """The stretches of a text that have candidates, all that learning looks at."""
    pattern = r"(?s)(?:\S{1,24}\s{1,4}){0,2}\S{0,64}[0-9@].{0,160}"
    return F.concat_ws(" \n ", F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def find(
    docs: DataFrame, field: Field | None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row its id and ``spans``: kind, start, end and whether it is a base span."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(field)
    item = pa.struct(
        [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                [
                    {"kind": KINDS[k], "start": a, "end": b, "base": base}
                    for a, b, k, base in spans(text or "", shared.value)
                ]
                for text in batch.column("text").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(found, pa.list_(item))], ["id", "spans"]
            )

    return rows.mapInArrow(
        run, f"id {kind}, spans array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"
    ).withColumnRenamed("id", id_col)
