"""N-gram Jaccard join with a count-vector R-tree.

A document's set holds its distinct 5-word shingles as 64-bit hashes. Two sets link at a Jaccard
similarity of 0.75 or more. Documents with equal sets are one node from the start; equal means equal
in two 64-bit keys of the set.

Count vectors: the shingles of a set are dealt to G groups by hash, c_g is the number in group g;
|X & Y| <= sum_g min(c_g(X), c_g(Y)). Points c are indexed in R-trees: a box knows the largest
count of each group and its smallest set, and is skipped when the summed minima of the query and
the box are below the overlap that a link needs, 3/7 (|X| + |Y|). Pairs whose own bound is high
enough are verified on the sets.

One R-tree over all documents would be searched in one place, so trees are built in buckets that
lose no link: with the shingles of each set in one order (shingles of very many documents last, then
by hash), linked sets share a shingle among the first 1/7 of the smaller and the first 1/4 of the
larger set. A bucket is a shingle with the sets that have it there. What is frequent is read from a
sketch of all documents; as any order is right, its errors cost time only.

Large groups of copies are contracted before their pairs are looked at. In two rounds over a few
buckets of each set, dealt into blocks, a tree gives each set its best partner of another component;
these pairs are verified and the components joined. The trees of all buckets are then searched for
links between different components only. All such links count, so components are exact, and how
well the rounds contract changes the work alone.

No task holds a large bucket: one of more than BLOCK sets is dealt into blocks of points by a hash
of the set, and the sets outside the bucket's largest component are sent to each block as queries.

Defined results: a null, empty or wordless text has an empty set, links with nothing and is its own
component; a text of one to four words has one shingle, all its words; a very long text is one row
of one task; a null id takes part, passes links on, and gets the smallest id of its component (null
when there is none); of several texts under one id each is a row with its own set, and links of all
of them count; repeated rows are one node and each get its result; ties cannot arise, as links and
smallest ids don't depend on order; further columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import looked_up, of_ids_or_null, settled, table, text_blocks, without_ids
from tidelog.llm.components import components
from tidelog.llm.textkernels import Words, as_long, mix

SHINGLE = 5

#: A link: 100 * |X & Y| >= 75 * |X | Y|.
PERCENT = 75

#: Counters of the frequency sketch, in so many chunks.
SKETCH_BITS = 20
CHUNKS = 64

#: A shingle is frequent when its counter exceeds the mean counter by this share of all documents.
FREQUENT_SHARE = 1 / 5000
FREQUENT_LEAST = 30

#: Rounds of contraction, and the buckets of each set that they search: the first frequent ones and
#: the first others.
ROUNDS = 2
FIRST_BUCKETS = 2

#: Sets of a bucket that one task indexes at a time, and shares that a frequent bucket is cut into.
BLOCK = 128
SALTS = 1024

#: Copies of a set that are joined to their answer without a shuffle.
CROWD = 500

#: Sets that a task remembers so as not to give their signatures again.
REMEMBERED = 500_000

#: Points in a box of an R-tree, and groups of a count vector.
BOX = 16
FEWEST_GROUPS, MOST_GROUPS = 64, 8192

#: Counts that are compared at once.
COMPARED = 1 << 24

#: What a row of a bucket is.
NEAR, FIRST, LATE = 1, 2, 4
BOTH, POINT, QUERY = 0, 1, 2

_BUCKET = "signature long, node long, n int, flags byte"
_SECOND = np.uint64(0xA0761D6478BD642F)


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = Words(texts, "lower")
    hashes = words.window_hashes(SHINGLE)
    short = {w: words.window_hashes(w) for w in range(1, SHINGLE)}
    out = []
    for a, n in zip(words.first.tolist(), words.counts.tolist()):
        out.append(np.unique(hashes[a : a + n - SHINGLE + 1]) if n >= SHINGLE else short[n][a : a + 1] if n else hashes[:0])
    return out


def _keys(own: np.ndarray) -> tuple[int, int]:
    """Two 64-bit names of a set, independent of each other."""
    mixed = mix(own)
    with np.errstate(over="ignore"):
        n = np.uint64(len(own)) * np.uint64(0x9E3779B97F4A7C15)
        first = mixed.sum(dtype=np.uint64) + n ^ np.bitwise_xor.reduce(own)
        second = mix(mixed ^ _SECOND).sum(dtype=np.uint64) + n ^ np.bitwise_xor.reduce(mixed)
    return tuple(mix(np.array([first, second], dtype=np.uint64)).view(np.int64).tolist())


def _namer(keys: Callable[[np.ndarray], tuple[int, int]], collided: dict[int, int]) -> Callable[[np.ndarray], int]:
    """The node of a set: its first key, or its second where sets of another second key share the first."""

    def name(own: np.ndarray) -> int:
        key, other = keys(own)
        return other if collided.get(key, other) != other else key

    return name


def _nodes(keys: Callable[[np.ndarray], tuple[int, int]]):
    """A row for each document, then the task's sketch in chunks."""

    def nodes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "key", "other", "chunk", "counts"]
        sketch = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
        for batch in text_blocks(batches):
            sets = shingle_sets(batch.column("text").to_pylist())
            for own in sets:
                sketch[(own >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)] += 1
            own_keys = [keys(s) if len(s) else (None, None) for s in sets]
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([k for k, _ in own_keys], pa.int64()), pa.array([k for _, k in own_keys], pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
        if sketch.any():
            parts = [zlib.compress(x.tobytes(), 1) for x in np.split(sketch, CHUNKS)]
            none = pa.nulls(CHUNKS, pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(range(CHUNKS), pa.int32()), pa.array(parts, pa.binary())], names)

    return nodes


def _frequent(sketch: DataFrame, documents: int, shingles: int) -> np.ndarray:
    """True for each counter of a frequent shingle: one bit a counter comes to the driver. The tasks'
    sketches are added one row at a time."""
    limit = shingles / (1 << SKETCH_BITS) + max(FREQUENT_LEAST, FREQUENT_SHARE * documents)

    def united(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = defaultdict(lambda: np.zeros((1 << SKETCH_BITS) // CHUNKS, dtype=np.int64))
        for batch in batches:
            for chunk, counts in zip(batch.column("chunk").to_pylist(), batch.column("counts")):
                total[chunk] += np.frombuffer(zlib.decompress(counts.as_py()), dtype=np.uint32)
        bits = [np.packbits(x > limit).tobytes() for x in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(bits, pa.binary())], ["chunk", "bits"])

    out = np.zeros((CHUNKS, (1 << SKETCH_BITS) // CHUNKS), dtype=bool)
    for r in sketch.select("chunk", "counts").repartition(CHUNKS, "chunk").mapInArrow(united, "chunk int, bits binary").collect():
        out[r.chunk] = np.unpackbits(np.frombuffer(r.bits, dtype=np.uint8)).astype(bool)
    return out.reshape(-1)


def _signatures(shared, name: Callable[[np.ndarray], int]):
    """(signature, node, n, flags) of the buckets of each set."""

    def signatures(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, given = shared.value, set()
        for batch in text_blocks(batches):
            signature, node, size, flags = [], [], [], []
            for own in shingle_sets(batch.column("text").to_pylist()):
                n = len(own)
                if not n:
                    continue
                key = name(own)
                if key in given:
                    continue
                if len(given) == REMEMBERED:
                    given.clear()
                given.add(key)
                late = frequent[(own >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                far = n - -(-n * PERCENT // 100) + 1
                first = np.concatenate([own[~late], own[late]])[:far]
                early = min(n - int(late.sum()), far)
                kind = np.zeros(far, dtype=np.int8)
                # In a link with a set of at least this size, 6/7 of this set are shared.
                kind[: n - -(-n * 2 * PERCENT // (100 + PERCENT)) + 1] |= NEAR
                kind[early:] |= LATE
                kind[:FIRST_BUCKETS] |= FIRST
                kind[early : early + FIRST_BUCKETS] |= FIRST
                signature.append(first)
                node.append(np.full(far, key))
                size.append(np.full(far, n))
                flags.append(kind)
            if signature:
                yield pa.RecordBatch.from_arrays([pa.array(as_long(np.concatenate(signature))), pa.array(np.concatenate(node)), pa.array(np.concatenate(size).astype(np.int32)), pa.array(np.concatenate(flags))], ["signature", "node", "n", "flags"])

    return signatures


def _whole_buckets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by signature are cut so that each bucket lies within one."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column("signature").to_numpy()
        if held and held[0].column("signature")[0].as_py() == key[-1]:
            held.append(batch)
            continue
        cut = int(np.flatnonzero(key == key[-1])[0])
        whole = pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks()
        if whole.num_rows:
            yield whole.to_batches()[0]
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _open(key: np.ndarray, n: np.ndarray, near: np.ndarray, component: np.ndarray) -> np.ndarray:
    """For rows in order of (key, n): whether another component of the bucket has a set of a size that
    can link, where the smaller of the two has the shingle early enough."""
    bucket = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]])).astype(np.int64) << 32
    place = bucket + n
    low = np.searchsorted(place, bucket + -(-n * PERCENT // 100))
    high = np.searchsorted(place, bucket + n * 100 // PERCENT, side="right")
    changes = np.cumsum(np.concatenate([[0], component[1:] != component[:-1]]))
    nears = np.concatenate([[0], np.cumsum(near)])
    smaller_near = nears[np.searchsorted(place, place, side="right")] > nears[low]
    return (changes[high - 1] > changes[low]) & (near | smaller_near)


def _shared_buckets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (signature, n, node): each once, those that may be in a link of their bucket.
    Rows of frequent shingles all stay, as their buckets lie in several tasks."""
    for batch in _whole_buckets(batches):
        key, node = batch.column("signature").to_numpy(), batch.column("node").to_numpy()
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        rows = np.flatnonzero(new)
        flags = batch.column("flags").to_numpy()[rows]
        useful = _open(key[rows], batch.column("n").to_numpy()[rows].astype(np.int64), flags & NEAR > 0, node[rows]) | (flags & LATE > 0)
        if useful.any():
            yield batch.take(pa.array(rows[useful]))


_UNIT = "signature long, node long, n int, near boolean, component long, block int, role byte, parts int"


def _open_buckets(most: int):
    """Rows sorted by (signature, n) that may be in a link between components; a bucket of more than most
    rows is dealt into blocks."""

    def open_buckets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_buckets(batches):
            key, n, node, component = (batch.column(c).to_numpy() for c in ("signature", "n", "node", "component"))
            near = batch.column("near").to_numpy(zero_copy_only=False)
            rows = np.flatnonzero(_open(key, n.astype(np.int64), near, component))
            if not len(rows):
                continue
            block, role = np.zeros(len(rows), dtype=np.int32), np.full(len(rows), BOTH, dtype=np.int8)
            own = key[rows]
            cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
            queries, shares = [rows[:0]], [block[:0]]
            for a, b in zip(cuts, cuts[1:]):
                if b - a > most:
                    parts = -(-(b - a) // most)
                    block[a:b] = (mix(node[rows[a:b]].view(np.uint64)) % np.uint64(parts)).astype(np.int32)
                    role[a:b] = POINT
                    names, counts = np.unique(component[rows[a:b]], return_counts=True)
                    queries.append(rows[a:b][component[rows[a:b]] != names[counts.argmax()]])
                    shares.append(np.full(len(queries[-1]), parts, dtype=np.int32))
            more = np.concatenate(queries)
            found = batch.select(["signature", "node", "n", "near", "component"]).take(pa.array(np.concatenate([rows, more])))
            role = np.concatenate([role, np.full(len(more), QUERY, dtype=np.int8)])
            block = np.concatenate([block, np.zeros(len(more), dtype=np.int32)])
            parts = np.concatenate([np.ones(len(rows), dtype=np.int32), *shares])
            yield pa.RecordBatch.from_arrays([*found.columns, pa.array(block), pa.array(role), pa.array(parts)], [*found.schema.names, "block", "role", "parts"])

    return open_buckets


def groups_of(n: int) -> int:
    """Groups of a set's count vector: a power of two, one to two times its size."""
    return int(min(MOST_GROUPS, max(FEWEST_GROUPS, 1 << n.bit_length())))


def count_vector(own: np.ndarray) -> np.ndarray:
    groups = groups_of(len(own))
    return np.bincount((own & np.uint64(groups - 1)).astype(np.int64), minlength=groups)


def packed_vector(counts: np.ndarray) -> bytes:
    """Two bits a count; after them (group, count), 16 bits each, of the few counts above three."""
    low = np.minimum(counts, 3).astype(np.uint8).reshape(-1, 4)
    bits = low[:, 0] | low[:, 1] << 2 | low[:, 2] << 4 | low[:, 3] << 6
    high = np.flatnonzero(counts > 3)
    return bits.tobytes() + np.stack([high, counts[high]], axis=1).astype("<u2").tobytes()


def unpacked_vector(raw: bytes, n: int) -> np.ndarray:
    groups = groups_of(n)
    bits = np.frombuffer(raw, dtype=np.uint8, count=groups // 4)
    counts = (bits[:, None] >> np.arange(0, 8, 2, dtype=np.uint8) & 3).ravel()
    high = np.frombuffer(raw, dtype="<u2", offset=groups // 4).reshape(-1, 2)
    if len(high):
        counts = counts.astype(np.uint16) if high[:, 1].max() > 255 else counts
        counts[high[:, 0]] = high[:, 1]
    return counts


def _sets(name: Callable[[np.ndarray], int], form: Callable[[np.ndarray], bytes]):
    """(node, n, form of the set) of each text that has words."""

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches):
            found = [s for s in shingle_sets(batch.column("text").to_pylist()) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([name(s) for s in found], pa.int64()), pa.array([len(s) for s in found], pa.int32()), pa.array([form(s) for s in found], pa.binary())], ["node", "n", "form"])

    return sets


def _vector_form(own: np.ndarray) -> bytes:
    return packed_vector(count_vector(own))


def _member_form(own: np.ndarray) -> bytes:
    return own.tobytes()


def unpacked_vectors(raw: list[bytes], groups: int) -> np.ndarray:
    """A row for each of several vectors of so many groups."""
    width = groups // 4
    bits = np.frombuffer(b"".join([r[:width] for r in raw]), dtype=np.uint8)
    counts = (bits[:, None] >> np.arange(0, 8, 2, dtype=np.uint8) & 3).reshape(len(raw), groups)
    for k, r in enumerate(raw):
        if len(r) > width:
            high = np.frombuffer(r, dtype="<u2", offset=width).reshape(-1, 2)
            if high[:, 1].max() > np.iinfo(counts.dtype).max:
                counts = counts.astype(np.uint16)
            counts[k, high[:, 0]] = high[:, 1]
    return counts


def _fits(n: np.ndarray, near: np.ndarray, component: np.ndarray, m, near_m, component_m, any_bucket: bool) -> np.ndarray:
    """Whether sets of sizes n and m of different components may link in this bucket: the smaller one has
    the shingle early enough, or, in any_bucket, anywhere."""
    fit = (component != component_m) & (PERCENT * n <= 100 * m) & (PERCENT * m <= 100 * n)
    return fit if any_bucket else fit & np.where(n < m, near, np.where(n > m, near_m, near | near_m))


def _small_units(starts: np.ndarray, sizes: np.ndarray, n: np.ndarray, near: np.ndarray, component: np.ndarray, raw: list[bytes], any_bucket: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs (i, j, bound) of different components with a high enough bound in units of at most BOX
    rows, one box of a tree each, compared many at a time."""
    pairs = []
    for size in np.unique(sizes):
        i, j = np.triu_indices(size, 1)
        first = starts[sizes == size][:, None]
        pairs.append(np.stack([(first + i).ravel(), (first + j).ravel()]))
    i, j = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), dtype=np.int64)
    fit = _fits(n[i], near[i], component[i], n[j], near[j], component[j], any_bucket)
    i, j = i[fit], j[fit]
    rows = np.unique(np.concatenate([i, j]))
    group, place, matrix = np.zeros(len(n), dtype=np.int64), np.zeros(len(n), dtype=np.int64), {}
    group[rows] = [groups_of(x) for x in n[rows].tolist()]
    for g in np.unique(group[rows]).tolist():
        own = rows[group[rows] == g]
        place[own] = np.arange(len(own))
        matrix[g] = unpacked_vectors([raw[k] for k in own], g)
    # The one with fewer groups first; sets that can link have at most twice as many.
    few, many = np.where(group[i] <= group[j], i, j), np.where(group[i] <= group[j], j, i)
    bound = np.zeros(len(i), dtype=np.int64)
    for g in matrix:
        for h in (g, 2 * g):
            at = np.flatnonzero((group[few] == g) & (group[many] == h))
            for some in np.split(at, range(COMPARED // h, len(at), COMPARED // h)):
                if not len(some):
                    continue
                left, right = matrix[g][place[few[some]]], matrix[h][place[many[some]]]
                if h != g:
                    right = right.reshape(len(some), -1, g).sum(axis=1, dtype=np.uint16)
                bound[some] = np.minimum(left, right).sum(axis=1, dtype=np.int64)
    enough = (100 + PERCENT) * bound >= PERCENT * (n[i] + n[j])
    return i[enough], j[enough], bound[enough]


def _folded(vector: np.ndarray, groups: int) -> np.ndarray:
    return vector if len(vector) == groups else vector.reshape(-1, groups).sum(axis=0, dtype=np.uint16)


class RTree:
    """Points with equally many groups, in order of set size, in boxes of BOX points and boxes of boxes."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.points, self.sizes = points, sizes
        self.levels = []
        upper, least = points, sizes
        while len(upper) > BOX:
            cuts = np.arange(0, len(upper), BOX)
            upper, least = np.maximum.reduceat(upper, cuts), np.minimum.reduceat(least, cuts)
            self.levels.append((upper, least))

    def search(self, query: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Points that may have a large enough overlap with the query, and their bounds."""
        levels = [*reversed(self.levels), (self.points, self.sizes)]
        found = np.arange(len(levels[0][0]))
        for depth, (upper, least) in enumerate(levels):
            if depth:
                found = (found[:, None] * BOX + np.arange(BOX)).ravel()
                found = found[found < len(upper)]
            bound = np.minimum(upper[found], query).sum(axis=1, dtype=np.int64)
            enough = (100 + PERCENT) * bound >= PERCENT * (n + least[found])
            found, bound = found[enough], bound[enough]
        return found, bound


class Block:
    """The points of one block of a bucket: at most BLOCK sets."""

    def __init__(self, node: np.ndarray, n: np.ndarray, near: np.ndarray, component: np.ndarray, raw: list[bytes]):
        self.node, self.n, self.near, self.component, self.raw = node, n, near, component, raw
        self.vectors: list[np.ndarray | None] = [None] * len(raw)
        self.trees: dict[tuple[int, int], tuple[np.ndarray, RTree]] = {}
        self.groups: np.ndarray | None = None

    def vector(self, k: int) -> np.ndarray:
        if self.vectors[k] is None:
            self.vectors[k] = unpacked_vector(self.raw[k], int(self.n[k]))
        return self.vectors[k]

    def _tree(self, groups: int, folded: int) -> tuple[np.ndarray, RTree] | None:
        """The points of so many groups, folded to fewer, and their tree."""
        if self.groups is None:
            self.groups = np.array([groups_of(int(x)) for x in self.n])
        if (groups, folded) not in self.trees:
            own = np.flatnonzero(self.groups == groups)
            own = own[np.argsort(self.n[own], kind="stable")]
            self.trees[groups, folded] = (own, RTree(np.stack([_folded(self.vector(int(k)), folded) for k in own]), self.n[own])) if len(own) else None
        return self.trees[groups, folded]

    def partners(self, n: int, near: bool, component: int, vector: Callable[[], np.ndarray], any_bucket: bool) -> tuple[np.ndarray, np.ndarray]:
        """Points of other components that may link with a set, and their bounds. In any_bucket, the
        shingle of the bucket may stand anywhere in both."""
        fit = _fits(self.n, self.near, self.component, n, near, component, any_bucket)
        if not fit.any():
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        query, found, bounds = vector(), [], []
        # Sets that can link have at most twice as many groups.
        for groups in (len(query) // 2, len(query), 2 * len(query)):
            least = min(groups, len(query))
            if tree := self._tree(groups, least):
                place, bound = tree[1].search(_folded(query, least), n)
                place = tree[0][place]
                found.append(place[fit[place]])
                bounds.append(bound[fit[place]])
        return (np.concatenate(found), np.concatenate(bounds)) if found else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))


def _search(best_only: bool):
    """Candidate pairs of different components from an R-tree search in each block, whose rows come in
    order of (signature, block, role): for each set its best partner, or all partners of the sets
    outside the block's largest component and of the block's queries."""

    def found_in(block: Block, rows: Iterable[tuple], left: list, right: list) -> None:
        for node, n, near, component, vector in rows:
            place, bound = block.partners(n, near, component, vector, best_only)
            if best_only and len(place):
                place = place[[np.argmax(bound / (n + block.n[place]))]]
            left += [node] * len(place)
            right += block.node[place].tolist()

    def own_rows(block: Block) -> Iterator[tuple]:
        names, counts = np.unique(block.component, return_counts=True)
        if len(names) > 1:
            largest = None if best_only else names[counts.argmax()]
            for k in np.flatnonzero(block.component != largest) if largest is not None else range(len(block.node)):
                yield block.node[k], int(block.n[k]), bool(block.near[k]), block.component[k], lambda k=k: block.vector(int(k))

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held, block = None, [], None

        def taken() -> Block:
            columns = [np.concatenate(x) for x in zip(*(h[:4] for h in held))]
            return Block(*columns, [r for h in held for r in h[4]])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, where, role, node, component = (batch.column(c).to_numpy() for c in ("signature", "block", "role", "node", "component"))
            n, near, raw = batch.column("n").to_numpy().astype(np.int64), batch.column("near").to_numpy(zero_copy_only=False), batch.column("vector")
            new = (key[1:] != key[:-1]) | (where[1:] != where[:-1]) | (role[1:] != role[:-1])
            cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(key)]
            left, right = [], []
            # Small units that lie within the batch are compared together.
            begin, size = np.array(cuts[:-1]), np.diff(cuts)
            small = (size <= BOX) & (role[begin] == BOTH)
            small[0] &= (key[0], where[0]) != unit
            small[-1] = False
            if small.any():
                i, j, bound = _small_units(begin[small], size[small], n, near, component, raw.to_pylist(), best_only)
                if best_only and len(i):
                    # The best partner of each row.
                    x, y, share = np.concatenate([i, j]), np.concatenate([j, i]), np.tile(bound / (n[i] + n[j]), 2)
                    order = np.lexsort((-share, x))
                    first = order[np.concatenate([[True], np.diff(x[order]) != 0])]
                    i, j = x[first], y[first]
                left += node[i].tolist()
                right += node[j].tolist()
            for a, b, done in zip(cuts, cuts[1:], small.tolist()):
                if done:
                    continue
                if (key[a], where[a]) != unit:
                    if held and block is None:
                        whole = taken()
                        found_in(whole, own_rows(whole), left, right)
                    unit, held, block = (key[a], where[a]), [], None
                if role[a] == QUERY:
                    if block is None and held:
                        block = taken()
                    if block is not None:
                        found_in(block, ((node[k], int(n[k]), bool(near[k]), component[k], lambda k=k: unpacked_vector(raw[k].as_py(), int(n[k]))) for k in range(a, b)), left, right)
                else:
                    held.append((node[a:b], n[a:b], near[a:b], component[a:b], raw.slice(a, b - a).to_pylist()))
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])
        left, right = [], []
        if held and block is None:
            whole = taken()
            found_in(whole, own_rows(whole), left, right)
        if left:
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return search


def _links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose sets are similar enough."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("form_a"), batch.column("form_b")):
            x, y = np.frombuffer(x.as_py(), dtype=np.uint64), np.frombuffer(y.as_py(), dtype=np.uint64)
            common = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * common >= PERCENT * (len(x) + len(y) - common))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _with_component(rows: DataFrame, part: DataFrame | None) -> DataFrame:
    if part is None:
        return rows.withColumn("component", F.col("node"))
    return rows.join(part, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _merged(part: DataFrame | None, links: DataFrame) -> DataFrame:
    """The components after further links. Only the components that links touch are merged anew."""
    if part is None:
        return settled(components(links))
    for side in ("a", "b"):
        of = part.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}"))
        links = links.join(of, side, "left").withColumn(side, F.coalesce(f"of_{side}", side)).drop(f"of_{side}")
    joined = settled(components(links))
    moved = looked_up(part.withColumnRenamed("component", "before"), joined.select(F.col("node").alias("before"), "component"), "before", "left")
    new = joined.join(part, "node", "left_anti")
    return settled(moved.select("node", F.coalesce("component", "before").alias("component")).unionByName(new))


class _Sets:
    """The rows of docs(doc_id, text) with the nodes of their sets, and the texts of given nodes."""

    def __init__(self, docs: DataFrame):
        self.docs = docs
        found = settled(docs.mapInArrow(_nodes(_keys), "doc_id long, n long, key long, other long, chunk int, counts binary"))
        rows = found.where("chunk is null").select("doc_id", "n", "key", "other")
        self.sketch = found.where("chunk is not null")
        # Sets that share a first key only: none is to be expected.
        twice = rows.groupBy("key").agg(F.min("other").alias("least"), F.max("other").alias("most")).where("least != most")
        self.collided = {r.key: r.least for r in twice.collect()}
        node = F.col("key")
        for key, least in self.collided.items():
            node = F.when((F.col("key") == key) & (F.col("other") != least), F.col("other")).otherwise(node)
        self.rows = rows.select("doc_id", "n", node.alias("node"))
        self.name = _namer(_keys, self.collided)
        self.nodes = settled(self.rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")))

    def forms(self, nodes: DataFrame, form: Callable[[np.ndarray], bytes]) -> DataFrame:
        """(node, n, form) of each of the nodes(node), from one of the texts that have its set."""
        nodes = settled(nodes.distinct())
        texts = of_ids_or_null(self.docs, self.nodes.join(nodes, "node", "left_semi").select("doc_id"))
        every = texts.mapInArrow(_sets(self.name, form), "node long, n int, form binary")
        return settled(looked_up(every, nodes, "node", "left_semi").dropDuplicates(["node"]))

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that link."""
        pairs = settled(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        sets = self.forms(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))), _member_form)
        for side in ("a", "b"):
            pairs = pairs.join(sets.select(F.col("node").alias(side), F.col("form").alias(f"form_{side}")), side)
        return settled(pairs.mapInArrow(_links, "a long, b long"))


def _jaccard(docs: DataFrame) -> tuple[DataFrame, Callable[[np.ndarray], int]]:
    """For each row of docs(doc_id, text): doc_id, node, n, component_id; and what names the nodes."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = _Sets(docs)
    size = sets.rows.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("shingles")).first()
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(sets.sketch, size.documents, size.shingles))

    late = F.col("flags").bitwiseAND(LATE) > 0
    salt = F.when(late, F.pmod("node", F.lit(SALTS))).otherwise(0)
    ordered = docs.mapInArrow(_signatures(frequent, sets.name), _BUCKET).repartition("signature", salt).sortWithinPartitions("signature", "n", "node")
    buckets = settled(ordered.mapInArrow(_shared_buckets, _BUCKET))
    vectors = sets.forms(buckets.select("node"), _vector_form).select("node", F.col("form").alias("vector"))
    near = (F.col("flags").bitwiseAND(NEAR) > 0).alias("near")

    def candidates(units: DataFrame, best_only: bool) -> DataFrame:
        points = units.join(vectors, "node")
        return points.repartition("signature", "block").sortWithinPartitions("signature", "block", "role").mapInArrow(_search(best_only), "a long, b long")

    def first_pairs(part: DataFrame | None, turn: int) -> DataFrame:
        """A best partner for each set, from blocks of its first buckets."""
        rows = _with_component(buckets.where(F.col("flags").bitwiseAND(FIRST) > 0), part).select("signature", "node", "n", near, "component")
        parts = rows.groupBy("signature").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.ceil(F.count("*") / BLOCK).alias("parts")).where("low != high").select("signature", "parts")
        block = F.pmod(F.xxhash64("node", F.lit(turn)), F.col("parts")).cast("int")
        return candidates(looked_up(rows, parts, "signature").withColumn("block", block).withColumn("role", F.lit(BOTH).cast("byte")).drop("parts"), True)

    def all_pairs(part: DataFrame | None) -> DataFrame:
        """All pairs of different components that the trees leave over."""
        rows = _with_component(buckets, part)
        columns = ["signature", "node", "n", near, "component"]
        few = rows.where(~late).select(*columns).repartition("signature").sortWithinPartitions("signature", "n").mapInArrow(_open_buckets(BLOCK), _UNIT)
        many = settled(rows.where(late).select(*columns))
        of = many.groupBy("signature", "component").agg(F.count("*").alias("sets")).groupBy("signature").agg(F.count("*").alias("components"), F.max_by("component", "sets").alias("largest"), F.ceil(F.sum("sets") / BLOCK).cast("int").alias("parts"))
        own = looked_up(many, of.where("components > 1").select("signature", "largest", "parts"), "signature")
        points = own.withColumn("block", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("role", F.lit(POINT).cast("byte"))
        queries = own.where("component != largest").withColumn("block", F.lit(0)).withColumn("role", F.lit(QUERY).cast("byte"))
        units = few.unionByName(points.unionByName(queries).select(*few.columns))
        blocks = F.when(F.col("role") == QUERY, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("block"))
        return candidates(units.withColumn("block", F.explode(blocks)).drop("parts"), False)

    part = None
    for turn in range(ROUNDS):
        part = _merged(part, sets.verified(first_pairs(part, turn)))
    whole = _merged(part, sets.verified(all_pairs(part)))

    least = whole.join(sets.nodes, "node").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    member = looked_up(whole, least, "component").select("node", "component_id")
    answer = sets.nodes.join(member, "node", "left").select("node", "copies", F.coalesce("component_id", "doc_id").alias("component_id"))
    crowded = settled(answer.where(F.col("copies") > CROWD).drop("copies"))
    wordless = sets.rows.where("node is null").withColumn("component_id", F.lit(None).cast("long"))
    rows = sets.rows.where("node is not null")
    told = looked_up(rows, crowded, "node").unionByName(looked_up(rows, crowded.select("node"), "node", "left_anti").join(answer.drop("copies"), "node"))
    every = told.select("doc_id", "node", "n", "component_id").unionByName(wordless.select("doc_id", "node", "n", "component_id"))
    return every.withColumn("component_id", F.coalesce("component_id", "doc_id")), sets.name


def jaccard_components(docs: DataFrame) -> DataFrame:
    """For each row of docs(doc_id, text): doc_id, n_shingles, component_id."""
    return _jaccard(docs)[0].select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _named(name: Callable[[np.ndarray], int], text: str):
    """Adds the node of each text."""

    def named(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches, text):
            nodes = [name(s) if len(s) else None for s in shingle_sets(batch.column(text).to_pylist())]
            yield batch.append_column("node", pa.array(nodes, pa.int64()))

    return named


def near_dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each component those with the smallest id
    (repeated rows all), and rows without an id. Where several texts share an id, each is judged by
    its own component."""
    every, name = _jaccard(docs)
    found = settled(every.select("doc_id", "node", (F.col("doc_id") != F.col("component_id")).alias("goes")).where("doc_id is not null").distinct())
    gone = found.where("goes")
    both = settled(gone.join(found.where("not goes"), "doc_id", "left_semi"))
    kept = without_ids(docs, gone.select("doc_id").distinct().join(both.select("doc_id"), "doc_id", "left_anti"))
    if not both.count():
        return kept
    # Ids with a text that goes and one that stays. Columns go by number meanwhile.
    wide = kept.toDF(*(f"c{k}" for k in range(len(kept.columns))))
    text, doc_id = (f"c{docs.columns.index(c)}" for c in ("text", "doc_id"))
    shared = both.select(F.col("doc_id").alias(doc_id), "node")
    mixed = wide.join(shared.select(doc_id).distinct(), doc_id, "left_semi").select(*wide.columns)
    judged = mixed.mapInArrow(_named(name, text), mixed.withColumn("node", F.lit(None).cast("long")).schema).join(shared, [doc_id, "node"], "left_anti")
    others = wide.join(shared.select(doc_id).distinct(), doc_id, "left_anti")
    return others.unionByName(judged.select(*wide.columns)).toDF(*docs.columns)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
