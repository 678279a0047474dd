"""N-gram Jaccard join by prefix trees.

A document is its set of word n-grams, as 64-bit hashes. Two documents link when their sets' Jaccard
similarity reaches the threshold; linked documents form groups.

1. Documents with equal sets are one node, so copies cost one row each and nothing more.
2. All n-grams have one global order, and sets that link share one of the first n - ceil(t n) + 1
   of each. First come the n-grams of a fixed third (by hash) that only one set has, found by one
   exchange of that third; then all others by hash; last the ``FREQUENT`` most frequent ones, which
   are counted in blocks and are left out of the exchange, so that none of its n-grams is hot.
   (Which n-grams are thought frequent only decides how fast the join is.) A set with enough
   n-grams of the first kind links with nothing, and most documents end here.
3. The first n-grams of the others are shuffled. What meets under an n-gram and is near enough in
   size is linked to the first of them, a row per node, never a pair of each with each. The
   connected parts of that candidate graph hold all links.
4. A part with more than ``room`` n-grams is candidates of candidates more than copies: the more
   documents, the more of them share an n-gram by chance. Its sets are cut into ranges of hashes, so
   many that sets that link have at least one range in common, all of its n-grams; these ranges take
   the place of the n-grams of step 3, and smaller parts come out.
5. A part's sets are stored in a trie, those n-grams first that most of its sets have. A set is
   compared with all others by one descent: the overlap with a path is counted once for all sets
   below, and a subtree is left as soon as what remains of the set and of the subtree's sets cannot
   reach the threshold. A descent goes only to sets that are not connected to its own already, and
   whose bitmaps (each n-gram turns one bit over) differ in no more bits than sets that link differ
   in n-grams; where there are none, it is left out. A part is done when at most one of its groups
   has sets that have not descended; near copies take few descents, and so do sets that are far apart.
6. A part that still has more than ``room`` n-grams is not brought into one task. A few of its sets,
   its pivots, are compared with all others, in as many tasks as its size asks for. All sets outside
   the largest group that results are then compared with all in the same way, in blocks of half a
   task's room. So each pair is either compared or connected through others, whatever the size of
   the part.

A document with fewer words than n has its whole sequence as its one n-gram. One without words, or
a NULL, has none, and links with nothing. Ids may be NULL or repeat: NULL is no component's id
unless nothing else is in there. An empty table gives an empty result. Further columns are ignored
by ``groups`` and kept by ``representatives``. Two different sets with one 64-bit hash of theirs
would be taken for one; for a billion documents the odds of any such pair are 1 in 36.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from periodica.llm.common import A_TO_Z, Spans, give_back, mixed, runs, stored, text_runs, words
from periodica.llm.graph import components
from periodica.operators.keys import possibly_in

#: n-grams ranked by frequency, all that is broadcast
FREQUENT = 1 << 18

#: of so many n-grams one is looked at for being in one set only
_THIN = 3

_BLOCK_GRAMS = 1 << 22  # n-grams counted together in a task
_SEEN = 4  # times in a block from which an n-gram is counted over all blocks
_BUCKET_GRAMS = 1 << 17  # thinned n-grams brought together in a task, and
_BUCKETS_MOST = 1 << 12, 1 << 20  # in more buckets than these so many
_SENT = 1 << 17  # thinned n-grams that a task holds before it sends them
_CHOSEN_BITS = 1 << 24  # of the map that tells which texts may be wanted
_PIVOTS = 32
_LEAST = 64  # n-grams that a set counts for at least in the room of a task


@dataclass(frozen=True)
class Join:
    width: int = 4  # words of an n-gram
    percent: int = 85  # of the union that the intersection must have
    room: int = 1 << 21  # n-grams of a part that one task takes

    def needed(self, n: int) -> int:
        """Overlap that a set of ``n`` must have with any it links with."""
        return -(-self.percent * n // 100)


# --- sets -------------------------------------------------------------------------------------

_LOWER = bytes.maketrans(A_TO_Z.encode(), A_TO_Z.lower().encode())
_FACTORS = mixed(np.arange(101, 165, dtype=np.uint64)) | np.uint64(1)


def gram_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Per text its sorted set of hashed n-grams."""
    parts = [(t or "").encode("utf-8", "surrogatepass").translate(_LOWER) for t in texts]
    out: list[np.ndarray] = []
    for a, b in runs([len(p) + 1 for p in parts]):
        data = np.frombuffer(b" ".join(parts[a:b]), np.uint8)
        starts, ends = words(data)
        hashed = Spans(data).hashes(starts, ends)
        lengths = np.fromiter((len(p) + 1 for p in parts[a:b]), np.int64, b - a)
        edge = np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths)]))
        grams = np.full(max(len(hashed) - width + 1, 0), width, np.uint64)
        for k in range(width):
            grams += hashed[k : len(hashed) - width + 1 + k] * _FACTORS[k]
        grams = mixed(grams)
        for i, j in zip(edge, edge[1:], strict=False):
            if j - i >= width:
                out.append(_distinct(np.sort(grams[i : j - width + 1])))
            elif j > i:
                whole = np.uint64(j - i) + (hashed[i:j] * _FACTORS[: j - i]).sum(dtype=np.uint64)
                out.append(mixed(np.array([whole], np.uint64)))
            else:
                out.append(np.empty(0, np.uint64))
    return out


def _distinct(numbers: np.ndarray) -> np.ndarray:
    """Of numbers in order each once."""
    fresh = np.ones(len(numbers), bool)
    fresh[1:] = numbers[1:] != numbers[:-1]
    return numbers[fresh]


def _node(grams: np.ndarray) -> int:
    digest = hashlib.blake2b(grams.astype("<u8").tobytes(), digest_size=8).digest()
    return int.from_bytes(digest, "little", signed=True)


# --- tasks ------------------------------------------------------------------------------------


def _profiler(width: int, id_type: pa.DataType):
    """A row per document, and rows of the n-grams that are frequent in a block of documents."""
    schema = pa.schema(
        [
            ("id", id_type),
            ("text_hash", pa.int64()),
            ("node", pa.int64()),
            ("n", pa.int64()),
            ("gram", pa.int64()),
            ("times", pa.int64()),
        ]
    )

    def out(rows: int, **columns) -> pa.RecordBatch:
        filled = [
            columns[f.name] if f.name in columns else pa.nulls(rows, f.type) for f in schema
        ]
        return pa.RecordBatch.from_arrays(filled, schema=schema)

    def frequent(sets: dict[int, np.ndarray]) -> pa.RecordBatch:
        grams, times = _often(sets)
        return out(
            len(grams),
            gram=pa.array(grams.view(np.int64)),
            times=pa.array(times.astype(np.int64)),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: dict[int, np.ndarray] = {}
        size = 0
        for batch in batches:
            for a, b, texts in text_runs(batch.column("text")):
                sets = gram_sets(texts, width)
                nodes = [_node(s) for s in sets]
                yield out(
                    b - a,
                    id=batch.column("id").slice(a, b - a),
                    text_hash=batch.column("text_hash").slice(a, b - a),
                    node=pa.array(nodes, pa.int64()),
                    n=pa.array([len(s) for s in sets], pa.int64()),
                )
                for node, grams in zip(nodes, sets, strict=True):
                    if node not in block:
                        block[node] = grams
                        size += len(grams)
                if size > _BLOCK_GRAMS:
                    yield frequent(block)
                    block, size = {}, 0
        if block:
            yield frequent(block)
        give_back()

    return run


def _often(sets: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """N-grams that at least ``_SEEN`` of the sets have, in order, and how many have them.

    Empties ``sets``: of all n-grams there is one sorted array, and bits beside it.
    """
    grams = np.concatenate(list(sets.values()))
    sets.clear()
    grams.sort()
    n = max(len(grams) - _SEEN + 1, 0)
    often = grams[:n] == grams[len(grams) - n :]
    often[1:] &= grams[1:n] != grams[: max(n - 1, 0)]
    found = grams[:n][often]
    return found, np.searchsorted(grams, found, "right") - np.searchsorted(grams, found)


_BUCKETS = "bucket int, grams binary, nodes binary, counts binary"


def _thinned(join: Join, order, buckets: int):
    """Blocks of the thinned n-grams without a rank and of the nodes that have them, by ranges of
    n-grams, and blocks of nodes and how many they have; a node comes once in a block."""
    types = [pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    schema = pa.schema(list(zip(("bucket", "grams", "nodes", "counts"), types, strict=True)))

    def sent(held: dict[int, np.ndarray]) -> pa.RecordBatch:
        nodes = np.fromiter(held, np.int64, len(held))
        counts = np.fromiter(map(len, held.values()), np.int64, len(held))
        grams = np.concatenate(list(held.values()))
        held.clear()
        by_gram = np.argsort(grams)
        owners = np.repeat(nodes, counts)[by_gram]
        grams = grams[by_gram]
        cuts = np.flatnonzero(np.diff(_bucket(grams, buckets), prepend=-1, append=-1))
        spans = [(int(a), int(b)) for a, b in zip(cuts, cuts[1:], strict=False)]
        # the counts go along with any bucket
        rows = [(int(nodes[0]) % buckets, None, nodes.tobytes(), counts.tobytes())]
        for a, b in spans:
            bucket = int(_bucket(grams[a : a + 1], buckets)[0])
            rows.append((bucket, grams[a:b].tobytes(), owners[a:b].tobytes(), None))
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranked, _ = order.value
        held: dict[int, np.ndarray] = {}
        size = 0
        for batch in batches:
            for _, _, texts in text_runs(batch.column("text")):
                for grams in gram_sets(texts, join.width):
                    if len(grams) and (node := _node(grams)) not in held:
                        held[node] = grams[_alone_maybe(grams, ranked)]
                        size += len(held[node])
                if size > _SENT:
                    yield sent(held)
                    size = 0
        if held:
            yield sent(held)
        give_back()

    return run


def _bucket(grams: np.ndarray, buckets: int) -> np.ndarray:
    """The range of n-grams that each is in, of so many."""
    high = grams >> np.uint64(32)
    return ((high * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _bucket_count(thinned: int) -> int:
    """Ranges for so many n-grams: what a task gets is bounded, and blocks do not get too small."""
    many, grams = _BUCKETS_MOST
    return 1 + max(min(thinned // _BUCKET_GRAMS, many), thinned // grams)


def _alone_maybe(grams: np.ndarray, ranked: np.ndarray) -> np.ndarray:
    """Which n-grams are thinned ones without a rank."""
    thin = grams % np.uint64(_THIN) == 0
    thin[thin] = ~_among(grams[thin], ranked)[0]
    return thin


def _shared(blocks: pa.Table) -> pa.Table:
    """Of a bucket's blocks rows (gram, node) of the n-grams that several nodes have, and (node, thin)
    of the counts."""

    def joined(rows: pa.Table, column: str, kind: type) -> np.ndarray:
        return np.frombuffer(b"".join(rows.column(column).to_pylist()), kind)

    counted = blocks.filter(blocks.column("counts").is_valid())
    found = blocks.filter(blocks.column("grams").is_valid())
    grams, nodes = joined(found, "grams", np.uint64), joined(found, "nodes", np.int64)
    by_gram = np.argsort(grams, kind="stable")  # blocks are in order already
    grams, nodes = _several(grams[by_gram], nodes[by_gram])
    # copies of a document come once from each block
    by_both = np.lexsort((nodes, grams))
    grams, nodes = grams[by_both], nodes[by_both]
    fresh = np.ones(len(grams), bool)
    fresh[1:] = (grams[1:] != grams[:-1]) | (nodes[1:] != nodes[:-1])
    grams, nodes = _several(grams[fresh], nodes[fresh])
    count_nodes, counts = joined(counted, "nodes", np.int64), joined(counted, "counts", np.int64)
    return pa.table(
        {
            "gram": pa.concat_arrays(
                [pa.array(grams.view(np.int64)), pa.nulls(len(counts), pa.int64())]
            ),
            "node": pa.array(np.concatenate([nodes, count_nodes])),
            "thin": pa.concat_arrays([pa.nulls(len(grams), pa.int64()), pa.array(counts)]),
        }
    )


def _several(grams: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of n-grams, in order, that are there more than once."""
    same = grams[1:] == grams[:-1]
    keep = np.zeros(len(grams), bool)
    keep[1:] |= same
    keep[:-1] |= same
    return grams[keep], nodes[keep]


def _prefixes(join: Join, order):
    """Rows (gram, node, n) of the first n-grams of each set in the global order.

    Those of one set only come first; they match nothing, so they count for the length of the prefix
    but are not given out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranked, rank = order.value
        for batch in batches:
            nodes, shared = batch.column("node").to_numpy(), batch.column("shared")
            for a, b, texts in text_runs(batch.column("text")):
                first, sizes = [], []
                for grams, others in zip(
                    gram_sets(texts, join.width), shared.slice(a, b - a), strict=True
                ):
                    n = len(grams)
                    known = np.sort(others.values.to_numpy().view(np.uint64))
                    alone = _alone_maybe(grams, ranked) & ~_among(grams, known)[0]
                    room = n - join.needed(n) + 1 - int(alone.sum())
                    first.append(_rare(grams[~alone], max(room, 0), ranked, rank))
                    sizes.append(n)
                counts = [len(f) for f in first]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(first).view(np.int64)),
                        pa.array(np.repeat(nodes[a:b], counts)),
                        pa.array(np.repeat(np.array(sizes, np.int64), counts)),
                    ],
                    ["gram", "node", "n"],
                )
        give_back()

    return run


def _among(grams: np.ndarray, ranked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which n-grams are in a sorted list, and where they would be."""
    if not len(ranked):
        return np.zeros(len(grams), bool), np.zeros(len(grams), np.int64)
    at = np.minimum(np.searchsorted(ranked, grams), len(ranked) - 1)
    return ranked[at] == grams, at


def _rare(grams: np.ndarray, n: int, ranked: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first ``n`` of a sorted set: those without a rank by hash, then the others by rank."""
    others, at = _among(grams, ranked)
    plain = grams[~others][:n]
    if len(plain) >= n or not others.any():
        return plain
    by_rank = np.argsort(rank[at[others]], kind="stable")
    return np.concatenate([plain, grams[others][by_rank[: n - len(plain)]]])


def _candidates(percent: int):
    """From rows in order of gram, n and node: each node linked to the first of those near in size.

    A step in size that no similar pair can span begins anew.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = size = node = leader = None
        for batch in batches:
            if not batch.num_rows:
                continue
            grams, nodes, sizes = (batch.column(i).to_numpy() for i in range(3))
            fresh = np.ones(len(grams), bool)
            fresh[1:] = (grams[1:] != grams[:-1]) | (100 * sizes[:-1] < percent * sizes[1:])
            if gram is not None:
                fresh[0] = grams[0] != gram or 100 * size < percent * sizes[0]
            begins = np.flatnonzero(fresh)
            group = np.cumsum(fresh) - 1
            first = np.where(group >= 0, nodes[begins[np.maximum(group, 0)]] if len(begins) else 0, leader or 0)
            if group[0] < 0:
                first[group < 0] = leader
            other = first != nodes
            yield pa.RecordBatch.from_arrays(
                [pa.array(first[other]), pa.array(nodes[other])], ["a", "b"]
            )
            gram, size, node, leader = grams[-1], sizes[-1], nodes[-1], first[-1]

    return run


@lru_cache(1 << 12)
def _band(n: int, percent: int) -> tuple[int, int, int]:
    """The band of sizes that ``n`` is in: its number, its least size and that of the next band.

    A set links with none of two bands below its own.
    """
    number, low, high = 0, 1, 100 // percent + 1
    while n >= high:
        number, low, high = number + 1, high, 100 * high // percent + 1
    return number, low, high


@lru_cache(1 << 12)
def _ranges(low: int, high: int, percent: int) -> tuple[int, int]:
    """Ranges of hashes into which sets are cut, and how many may be empty, so that two sets that
    link, the smaller one of ``low`` up to ``high`` n-grams, have one more than those in common."""
    differ = (high - 1) * (100 - percent) // percent
    spare = 0
    for _ in range(3 if differ else 0):
        empty = (differ + 1 + spare) * math.exp(-low / (differ + 1 + spare))
        spare = min(math.ceil(empty + 4 * math.sqrt(empty)), differ + 1)
    return differ + 1 + spare, spare


def signatures(grams: np.ndarray, join: Join) -> np.ndarray:
    """Hashes of the ranges of a sorted set; sets that link have one in common."""
    n = len(grams)
    number, low, high = _band(n, join.percent)
    bands = [(number, low, high)]
    if join.needed(n) < low:  # it may be the larger one of two
        bands.append(_band(low - 1, join.percent))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(grams))])
    out = []
    for number, low, high in bands:
        k, spare = _ranges(low, high, join.percent)
        edges = np.arange(1, k, dtype=np.uint64) * np.uint64(((1 << 64) - 1) // k)
        ends = np.concatenate([[0], np.searchsorted(grams, edges), [n]])
        place = (number << 32) + np.arange(k)
        keys = mixed((sums[ends[1:]] - sums[ends[:-1]]) ^ mixed(place.astype(np.uint64)))
        full = ends[1:] > ends[:-1]
        out.append(keys[full])
        if k - int(full.sum()) > spare:  # all ranges in common may be empty ones
            out.append(mixed(np.array([(number << 32) + k], np.uint64)))
    return np.concatenate(out)


def _signed(join: Join):
    """Rows (gram, node, n) of the ranges of each set, their hashes in place of n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, parts = (batch.column(c).to_numpy() for c in ("node", "part"))
            for a, b, texts in text_runs(batch.column("text")):
                sets = gram_sets(texts, join.width)
                keys = [signatures(s, join) for s in sets]
                counts = [len(k) for k in keys]
                own = mixed(np.repeat(parts[a:b].astype(np.uint64), counts))
                sizes = np.fromiter(map(len, sets), np.int64, len(sets))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((np.concatenate(keys) ^ own).view(np.int64)),
                        pa.array(np.repeat(nodes[a:b], counts)),
                        pa.array(np.repeat(sizes, counts)),
                    ],
                    ["gram", "node", "n"],
                )
        give_back()

    return run


# --- the trie ---------------------------------------------------------------------------------


class Trie:
    """Sets of numbers, each in rising order, with common beginnings stored once.

    Chains without branches are one node: ``depth`` n-grams lead to its end, its own are
    ``grams[offset[k] : offset[k + 1]]``. ``least`` and ``most`` bound the sizes of the sets below.
    """

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent = percent
        self.sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        keys = [s.astype(">u4").tobytes() for s in sets]
        order = sorted(range(len(sets)), key=keys.__getitem__)
        depth, parent, owner = [0], [-1], [-1]
        end = self.end = np.zeros(len(sets), np.int64)
        path = [0]
        before: np.ndarray = np.empty(0, np.int64)
        for i in order:
            now = sets[i]
            k = min(len(before), len(now))
            apart = np.flatnonzero(before[:k] != now[:k])
            common = int(apart[0]) if len(apart) else k
            below = -1
            while depth[path[-1]] > common:
                below = path.pop()
            if depth[path[-1]] < common:
                depth.append(common)
                parent.append(path[-1])
                owner.append(i)
                path.append(len(depth) - 1)
                parent[below] = path[-1]
            if len(now) > common:
                depth.append(len(now))
                parent.append(path[-1])
                owner.append(i)
                path.append(len(depth) - 1)
            end[i] = path[-1]
            before = now
        self.depth, self.parent = np.array(depth), np.array(parent)
        above = self.depth[np.maximum(self.parent, 0)]
        own = [sets[o][a:d] for o, a, d in zip(owner[1:], above[1:], depth[1:], strict=True)]
        lengths = np.array([0, *map(len, own)], np.int64)
        self.offset = np.concatenate([[0], np.cumsum(lengths)])
        self.grams = np.concatenate([np.empty(0, np.int64), *own]).astype(np.int64)
        self.last = np.array([-1, *[s[-1] for s in own]], np.int64)
        self.least = np.full(len(depth), np.iinfo(np.int64).max)
        self.most = np.zeros(len(depth), np.int64)
        np.minimum.at(self.least, end, self.sizes)
        np.maximum.at(self.most, end, self.sizes)
        for k in np.argsort(-self.depth, kind="stable"):
            if self.parent[k] >= 0:
                self.least[self.parent[k]] = min(self.least[self.parent[k]], self.least[k])
                self.most[self.parent[k]] = max(self.most[self.parent[k]], self.most[k])
        kids = np.argsort(self.parent[1:], kind="stable") + 1
        self.kids = kids
        self.first_kid = np.searchsorted(self.parent[kids], np.arange(len(depth) + 1))
        self.ends = np.argsort(end, kind="stable")
        self.first_end = np.searchsorted(end[self.ends], np.arange(len(depth) + 1))

    @staticmethod
    def _spread(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """All numbers of the ranges."""
        lengths = ends - starts
        return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())

    def _above(self, sets: np.ndarray) -> np.ndarray:
        """Which nodes lead to any of the sets."""
        above = np.zeros(len(self.depth), bool)
        level = np.unique(self.end[sets])
        while len(level):
            above[level] = True
            level = np.unique(self.parent[level])
            level = level[(level >= 0) & ~above[level]]
        return above

    def similar(
        self, probe: np.ndarray, mask: np.ndarray, among: np.ndarray | None = None
    ) -> np.ndarray:
        """Indices of the sets (of all, or of those ``among`` them) that link with ``probe``, whose
        numbers are marked in ``mask``."""
        t, n = self.percent, len(probe)
        wanted = None
        if among is not None:
            above, wanted = self._above(among), np.zeros(len(self.sizes), bool)
            wanted[among] = True
        level = np.zeros(1, np.int64)
        overlap = np.zeros(1, np.int64)
        found = []
        while len(level):
            here = self._spread(self.first_end[level], self.first_end[level + 1])
            if len(here):
                count = self.first_end[level + 1] - self.first_end[level]
                sets = self.ends[here]
                shared = np.repeat(overlap, count)
                links = 100 * shared >= t * (n + self.sizes[sets] - shared)
                found.append(sets[links if wanted is None else links & wanted[sets]])
            count = self.first_kid[level + 1] - self.first_kid[level]
            kids = self.kids[self._spread(self.first_kid[level], self.first_kid[level + 1])]
            overlap = np.repeat(overlap, count)
            if wanted is not None:
                kids, overlap = kids[above[kids]], overlap[above[kids]]
            if not len(kids):
                break
            # the kids' own n-grams, counted at once; every node but the root has some
            lengths = self.offset[kids + 1] - self.offset[kids]
            hits = mask[self.grams[self._spread(self.offset[kids], self.offset[kids + 1])]]
            overlap += np.add.reduceat(hits.astype(np.int64), np.cumsum(lengths) - lengths)
            left = n - np.searchsorted(probe, self.last[kids], side="right")
            size = np.clip(self.depth[kids] + left, self.least[kids], self.most[kids])
            reach = overlap + np.minimum(left, size - self.depth[kids])
            alive = reach * (100 + t) >= t * (n + size)
            level, overlap = kids[alive], overlap[alive]
        return np.concatenate(found) if found else np.empty(0, np.int64)


def _numbered(sets: list[np.ndarray]) -> tuple[list[np.ndarray], int]:
    """The sets with n-grams numbered by falling frequency among them, in rising order."""
    flat = np.concatenate(sets)
    grams, place, times = np.unique(flat, return_inverse=True, return_counts=True)
    number = np.empty(len(grams), np.int64)
    number[np.argsort(-times, kind="stable")] = np.arange(len(grams))
    ends = np.cumsum([len(s) for s in sets])[:-1]
    return [np.sort(s) for s in np.split(number[place], ends)], len(grams)


class _Linker:
    """Finds which of some sets a set links with."""

    def __init__(self, sets: list[np.ndarray], universe: int, percent: int):
        self.percent = percent
        self.trie = Trie(sets, percent)
        self.sizes = self.trie.sizes
        mean = int(self.sizes.mean()) if len(sets) else 0
        self.bits = 1 << min(max(2 * mean - 1, 1).bit_length(), 12)
        self.bits = max(self.bits, 64)
        self.maps = np.empty((len(sets), self.bits // 64), np.uint64)
        for i, numbers in enumerate(sets):
            self.maps[i] = self._bitmap(numbers)
        self.mask = np.zeros(universe, bool)

    def _bitmap(self, numbers: np.ndarray) -> np.ndarray:
        odd = np.bincount(numbers % self.bits, minlength=self.bits) & 1
        return np.packbits(odd.astype(bool)).view(np.uint64)

    def linked(self, probe: np.ndarray, among: np.ndarray) -> np.ndarray:
        """Those ``among`` the sets (their indices) that link with ``probe``."""
        n = len(probe) + self.sizes[among]
        least = -(-self.percent * n // (100 + self.percent))  # overlap of two that link
        sized = least <= np.minimum(len(probe), self.sizes[among])
        among, n, least = among[sized], n[sized], least[sized]
        apart = np.bitwise_count(self.maps[among] ^ self._bitmap(probe)).sum(axis=1, dtype=np.int64)
        among = among[apart <= n - 2 * least]
        if not len(among):
            return among
        self.mask[probe] = True
        found = self.trie.similar(probe, self.mask, among)
        self.mask[probe] = False
        return found


def connected(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """A label per set, equal for sets that links connect."""
    numbered, universe = _numbered(sets)
    linker = _Linker(numbered, universe, percent)
    label = np.arange(len(sets))
    waiting = {i: [i] for i in range(len(sets))}
    size = [1] * len(sets)
    order = [(1, i) for i in range(len(sets))]
    while len(waiting) > 1:
        # the smallest group descends next; what it doesn't meet, it doesn't link with
        held, mine = heapq.heappop(order)
        if mine not in waiting or size[mine] != held:
            continue
        probe = waiting[mine].pop()
        found = linker.linked(numbered[probe], np.flatnonzero(label != mine))
        met = np.unique(label[found])
        if len(met):
            label[np.isin(label, met)] = mine
        for other in met.tolist():
            size[mine] += size[other]
            waiting[mine] += waiting.pop(other, [])
        if waiting[mine]:
            heapq.heappush(order, (size[mine], mine))
        else:
            del waiting[mine]
    return label


def _links(nodes: np.ndarray, label: np.ndarray) -> pa.Table:
    """Each node linked to the first of its label."""
    _, first, place = np.unique(label, return_index=True, return_inverse=True)
    leader = nodes[first[place]]
    other = leader != nodes
    return pa.table({"a": pa.array(leader[other]), "b": pa.array(nodes[other])})


def _own_rows(table: pa.Table) -> pa.Table:
    """The rows of a table, each node once."""
    _, once = np.unique(table.column("node").to_numpy(), return_index=True)
    return table.take(pa.array(once))


def _own_sets(table: pa.Table, width: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Nodes and their sets, each once."""
    table = _own_rows(table)
    return table.column("node").to_numpy(), gram_sets(table.column("text").to_pylist(), width)


def _verifier(join: Join):
    def verify(part: pa.Table) -> pa.Table:
        nodes, sets = _own_sets(part, join.width)
        return _links(nodes, connected(sets, join.percent))

    return verify


def _comparer(join: Join):
    """Links between a block of a large part's sets and some of its sets, one for each group of
    linked sets that a set of the block meets."""

    def compare(members: pa.Table, block: pa.Table) -> pa.Table:
        block = block.rename_columns([c.removeprefix("b_") for c in block.column_names])
        members, block = _own_rows(members), _own_rows(block)
        nodes, sets = _own_sets(members, join.width)
        block_nodes, block_sets = _own_sets(block, join.width)
        if not len(nodes) or not len(block_nodes):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        numbered, universe = _numbered(block_sets + sets)
        linker = _Linker(numbered[len(block_sets) :], universe, join.percent)
        both = [block.column("label").to_numpy(), members.column("label").to_numpy()]
        label, n = np.concatenate(both), len(block_nodes)
        a, b = [], []
        for i, probe in enumerate(numbered[:n]):
            found = linker.linked(probe, np.flatnonzero(label[n:] != label[i]))
            met, first = np.unique(label[n:][found], return_index=True)
            a += [int(block_nodes[i])] * len(met)
            b += nodes[found[first]].tolist()
            if len(met):
                label[np.isin(label, met)] = label[i]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return compare


# --- on Spark ---------------------------------------------------------------------------------

_EDGES = "a long, b long"


def _ranking(profile: DataFrame):
    """The frequent n-grams in order of their hashes, and their ranks by frequency."""
    counts = profile.where("gram is not null").groupBy("gram").agg(F.sum("times").alias("times"))
    table = counts.orderBy(F.desc("times"), "gram").limit(FREQUENT).toArrow()
    grams = table.column("gram").to_numpy().view(np.uint64)
    times = table.column("times").to_numpy()
    by_times = np.lexsort((grams, times))
    rank = np.empty(len(grams), np.int64)
    rank[by_times] = np.arange(len(grams))
    order = np.argsort(grams)
    return grams[order], rank[order]


def _parts(prefixes: DataFrame, join: Join, name: str) -> DataFrame:
    """``part`` of each node that shares a prefix n-gram with one near in size."""
    rows = prefixes.repartition("gram").sortWithinPartitions("gram", "n", "node")
    pairs = rows.mapInArrow(_candidates(join.percent), _EDGES).distinct()
    return components(pairs, name).select("node", F.col("component").alias("part"))


def _weight() -> Column:
    """N-grams that a set counts for in the room of a task."""
    return F.greatest(F.col("n"), F.lit(_LEAST))


def _verified(found: DataFrame, join: Join) -> tuple[DataFrame, DataFrame]:
    """Links of the parts that one task takes, and the others with the number of their n-grams."""
    sizes = found.groupBy("part").agg(F.sum(_weight()).alias("grams"))
    large = stored(sizes.where(F.col("grams") > join.room), "jaccard-sizes")
    small = found.join(large, "part", "left_anti")
    return small.groupBy("part").applyInArrow(_verifier(join), _EDGES), large


def _finer(parts: DataFrame, join: Join) -> DataFrame:
    """The sets of too large parts in smaller ones, by ranges they share; without those that share none."""
    rows = parts.select("part", "node", "text").mapInArrow(_signed(join), "gram long, node long, n long")
    return parts.drop("part").join(_parts(rows, join, "jaccard-finer-parts"), "node")


def _large(parts: DataFrame, sizes: DataFrame, join: Join) -> DataFrame:
    """Links of the parts that are too large for one task, from rows (part, node, n, text)."""
    half = max(join.room // 2, 1)  # a task gets a share of a part and a block of it
    parts = parts.join(
        sizes.select("part", F.ceil(F.col("grams") / half).cast("int").alias("shares")), "part"
    )
    parts = parts.withColumn("share", F.pmod(F.xxhash64("node"), "shares"))
    parts = stored(parts, "jaccard-large")

    def against(rows: DataFrame, blocks: DataFrame) -> DataFrame:
        """Every set of a part with those of every block (part, block, node, label, text)."""
        keys = ["part", "block", "share"]
        listed = blocks.select("part", "block").distinct()
        members = rows.join(listed, "part").select(*keys, "node", "label", "text")
        each = F.sequence(F.lit(0).cast("long"), F.col("shares").cast("long") - 1)
        spread = blocks.join(parts.select("part", "shares").distinct(), "part").select(
            "part", "block", F.explode(each).alias("share"), "node", "label", "text"
        )
        # the two sides come from one table; new names for one of them tell them apart
        spread = spread.toDF(*[f"b_{c}" for c in spread.columns])
        return (
            members.groupBy(*keys)
            .cogroup(spread.groupBy(*[f"b_{k}" for k in keys]))
            .applyInArrow(_comparer(join), _EDGES)
        )

    by_hash = Window.partitionBy("part").orderBy(F.xxhash64("node", F.lit(5)), "node")
    own = parts.withColumn("label", F.col("node"))
    pivots = own.withColumn("_n", F.row_number().over(by_hash)).where(F.col("_n") <= _PIVOTS)
    pivots = pivots.select("part", F.lit(0).cast("long").alias("block"), "node", "label", "text")
    first = stored(against(own, pivots), "jaccard-pivots")
    found = components(first, "jaccard-pivot-groups")
    labelled = parts.join(found, "node", "left").withColumn("label", F.coalesce("component", "node"))
    labelled = stored(labelled.drop("component"), "jaccard-labelled")
    size = labelled.groupBy("part", "label").count()
    most = size.groupBy("part").agg(F.max(F.struct("count", "label")).alias("_most"))
    most = most.select("part", F.col("_most.label").alias("main"))
    outside = labelled.join(most, "part").where(F.col("label") != F.col("main"))
    # blocks by hash, about as large as they should be
    number = outside.groupBy("part").agg(F.ceil(F.sum(_weight()) / half).cast("int").alias("_b"))
    blocks = outside.join(number, "part").select(
        "part",
        F.pmod(F.xxhash64("node", F.lit(9)), "_b").cast("long").alias("block"),
        "node",
        "label",
        "text",
    )
    return first.unionByName(against(labelled, stored(blocks, "jaccard-outside")))


def groups(
    docs: DataFrame, join: Join = Join(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row its id, ``n_grams`` (the size of its set) and ``component_id``, the smallest id that
    it reaches by links."""
    profile, component = _solved(docs, join, id_col, text_col)
    ids = profile.where("node is not null")
    labelled = ids.join(component, "node", "left").withColumn(
        "group", F.coalesce("component", "node")
    )
    least = labelled.where("n > 0").groupBy("group").agg(F.min("id").alias("component_id"))
    full = labelled.where("n > 0").join(least, "group").select("id", "n", "component_id")
    empty = labelled.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return full.unionByName(empty).select(
        F.col("id").alias(id_col), F.col("n").alias("n_grams"), "component_id"
    )


def _solved(
    docs: DataFrame, join: Join, id_col: str, text_col: str
) -> tuple[DataFrame, DataFrame]:
    """Rows (id, text_hash, node, n) of the documents, and the component of each linked node."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    id_field = rows.schema["id"].dataType
    profile = stored(
        rows.mapInArrow(
            _profiler(join.width, to_arrow_type(id_field)),
            f"id {id_field.simpleString()}, text_hash long, node long, n long, gram long, times long",
        ),
        "jaccard-profile",
    )
    order = spark.sparkContext.broadcast(_ranking(profile))
    total = profile.agg(F.sum("n")).first()[0] or 0
    buckets = _bucket_count(total // _THIN)
    thin = (
        rows.select("text")
        .mapInArrow(_thinned(join, order, buckets), _BUCKETS)
        .groupBy("bucket")
        .applyInArrow(_shared, "gram long, node long, thin long")
    )
    # a node's shared n-grams are no more than its set
    per_node = thin.groupBy("node").agg(
        F.max("thin").alias("thin"), F.collect_set("gram").alias("shared")
    )
    # one text for each node
    texts = profile.where("n > 0").groupBy("node").agg(
        F.min(F.struct("id", "text_hash")).alias("_one"), F.max("n").alias("n")
    )
    needed = F.ceil(F.col("n") * join.percent / 100)
    open_ = F.col("thin") - F.size("shared") < F.col("n") - needed + 1
    chosen = per_node.join(texts, "node").where(open_)
    chosen = stored(
        chosen.select(
            "node", "n", "shared", F.col("_one.id").alias("_id"), F.col("_one.text_hash").alias("_text")
        ),
        "jaccard-chosen",
    )
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_text"))
    # the texts of these move here, those of repeated rows once, hardly any others
    wanted = possibly_in(rows, "text_hash", chosen.select("_text"), _CHOSEN_BITS)
    found = wanted.join(chosen, same).groupBy("node", "n").agg(
        F.first("text").alias("text"), F.first("shared").alias("shared")
    )
    found = stored(found, "jaccard-texts")
    first = found.mapInArrow(_prefixes(join, order), "gram long, node long, n long")
    found = found.drop("shared").join(_parts(first, join, "jaccard-parts"), "node")
    found = stored(found, "jaccard-in-parts")
    links, large = _verified(found, join)
    if not large.isEmpty():
        found = found.join(large.select("part"), "part", "left_semi")
        found = stored(_finer(found, join), "jaccard-in-finer-parts")
        more, large = _verified(found, join)
        links = links.unionByName(more)
        if not large.isEmpty():
            found = found.join(large.select("part"), "part", "left_semi")
            links = links.unionByName(_large(found, large, join))
    linked = components(stored(links, "jaccard-links"), "jaccard-groups")
    return profile, linked


def representatives(
    docs: DataFrame, join: Join = Join(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that stay: of each group the one with the smallest id.

    Documents without n-grams all stay. Of several rows with that id the smallest by its text's hash
    stays, and of repeated rows one.
    """
    profile, component = _solved(docs, join, id_col, text_col)
    nodes = profile.where("n > 0").join(component, "node", "left")
    one = nodes.groupBy(F.coalesce("component", "node").alias("group")).agg(
        F.min(F.struct(F.col("id").isNull(), "id", "text_hash")).alias("_one")
    )
    stay = one.select(F.col("_one.id").alias("_id"), F.col("_one.text_hash").alias("_text"))
    empty = profile.where("n = 0").select(F.col("id").alias("_id"), F.col("text_hash").alias("_text"))
    names = [f"`{c}`" for c in docs.columns]
    rows = docs.select(
        F.struct(*names).alias("_row"),
        F.col(id_col).alias("_doc"),
        F.xxhash64(F.col(text_col).cast("string")).alias("_hash"),
    )
    same = F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_text"))
    kept = rows.join(stay, same, "left_semi")
    repeated = stored(
        rows.groupBy("_doc", "_hash").count().where("count > 1").select(
            F.col("_doc").alias("_id"), F.col("_hash").alias("_text")
        ),
        "jaccard-repeated",
    )
    if not repeated.isEmpty():
        once = kept.join(repeated, same, "left_anti").select("_row")
        several = kept.join(repeated, same, "left_semi").groupBy("_doc", "_hash")
        kept = once.unionByName(several.agg(F.max("_row").alias("_row")).select("_row"))
    return kept.select("_row.*").unionByName(
        rows.join(empty, same, "left_semi").select("_row.*")
    )
