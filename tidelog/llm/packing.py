"""Packing documents into sequences of at most 2048 tokens by multiway differencing.

Each task packs the documents of its own input split, so nothing is shuffled. A document gives
sequences of its own for each full 2048 tokens; what is left of it, or all of a shorter one, is one
piece. Pieces gather until 64 windows' worth is there (the last one is cut there), then Karmarkar-Karp
multiway differencing deals them out: every piece begins as a partial partition (its size in one
window, nothing in the others); the two partial partitions with the largest imbalances are merged,
the largest window of the one onto the smallest of the other, until one partition is left, whose
windows are nearly equal. While a window exceeds 2048 tokens by more than SPILL, the largest piece of
each such window is halved and the pieces are dealt out anew; when they are short already, with one
window more. A smaller excess is cut off the largest piece of its window and fills up windows that have
room. So most documents stay whole. At the end of a split the tokens beyond whole windows become sequences
whose lengths are powers of two.

Defined results: null and empty texts are the single end id; a very long text gives its own sequences
first; a null doc_id is carried along; repeated documents are packed each; among pieces of one size
the earlier one is dealt out first; other columns are not read; an empty table gives no pieces. A task
that runs again gives the same sequences: they depend on its split alone.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import table, text_blocks
from tidelog.llm.tokens import byte_bpe

CAPACITY = 2048
END_ID = 1
WINDOWS = 64

#: Pieces of at most so many tokens are never halved, and so many tokens of a window may move to others.
SHORTEST_PIECE = 32
SPILL = CAPACITY // 8

#: Tokens a window that are left free, on average, so that nearly equal windows fit.
SLACK = 8

#: Sequence ids of a task start at its number times this.
SEQUENCES_OF_TASK = 1 << 36

_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def differencing(sizes: list[int], windows: int) -> list[list[int]]:
    """Deals sizes out to so many windows with nearly equal sums; gives the positions in each.

    A partial partition is a list of (sum, members) in falling order of sums, without the windows
    that are still empty. Members are nested pairs, unfolded at the end."""
    heap = [(-size, k, [(size, k)]) for k, size in enumerate(sizes)]
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        alone = windows - len(b)
        if len(a) <= alone:
            merged = a + b
        else:
            both = [(x + y, (m, n)) for (x, m), (y, n) in zip(a[alone:], reversed(b))]
            merged = a[:alone] + both + b[: len(b) - len(both)]
        merged.sort(key=_sum, reverse=True)
        if len(merged) == windows and (least := merged[-1][0]):
            merged = [(x - least, m) for x, m in merged]
        gap = merged[0][0]
        heapq.heappush(heap, (-gap, serial, merged))
        serial += 1
    out = []
    for _, members in heap[0][2] if heap else []:
        found, todo = [], [members]
        while todo:
            x = todo.pop()
            if isinstance(x, tuple):
                todo += x
            else:
                found.append(x)
        out.append(sorted(found))
    return out


def _sum(entry: tuple) -> int:
    return entry[0]


class Packer:
    """Packs the documents of one task in the order in which they come. A piece is (document, start,
    length); documents are numbered, and their ids are held until their pieces are dealt out."""

    def __init__(self, task: int):
        self.next_id = task * SEQUENCES_OF_TASK
        self.pieces: list[tuple[int, int, int]] = []
        self.total = 0
        self.documents: dict[int, tuple[int | None, bytes]] = {}
        self.serial = 0
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.serial += 1
        self.documents[self.serial] = (doc_id, ids)
        tokens, start = len(ids) // 4, 0
        while tokens - start >= CAPACITY:
            self._sequence([(self.serial, start, CAPACITY)])
            start += CAPACITY
        target = WINDOWS * (CAPACITY - SLACK)
        while start < tokens:
            n = min(tokens - start, target - self.total)
            self.pieces.append((self.serial, start, n))
            self.total += n
            start += n
            if self.total == target:
                self._deal(WINDOWS)
        if not self.pieces:
            self.documents.clear()
        elif self.pieces[0][0] == self.serial:
            self.documents = {self.serial: (doc_id, ids)}

    def close(self) -> None:
        """Packs what is left: whole windows by differencing, the rest as powers of two."""
        windows = self.total // CAPACITY
        rest, tail = self.total - windows * (CAPACITY - SLACK), []
        while rest:
            doc, start, n = self.pieces.pop()
            cut = min(n, rest)
            if cut < n:
                self.pieces.append((doc, start, n - cut))
            tail.append((doc, start + n - cut, cut))
            rest -= cut
        if windows:
            self._deal(windows)
        tail.reverse()
        left = sum(n for _, _, n in tail)
        while left:
            room = min(CAPACITY, 1 << (left.bit_length() - 1))
            left -= room
            own = []
            while room:
                doc, start, n = tail.pop(0)
                cut = min(n, room)
                own.append((doc, start, cut))
                if cut < n:
                    tail.insert(0, (doc, start + cut, n - cut))
                room -= cut
            self._sequence(own)

    def _deal(self, windows: int) -> None:
        pieces = self.pieces
        while True:
            dealt = differencing([n for _, _, n in pieces], windows)
            full = [max(own, key=lambda k: pieces[k][2]) for own in dealt if sum(pieces[k][2] for k in own) > CAPACITY + SPILL]
            if not full and sum(n for _, _, n in pieces) <= windows * CAPACITY:
                break
            halved = {k for k in full if pieces[k][2] > SHORTEST_PIECE}
            if not halved:
                windows += 1
            pieces = [part for k, piece in enumerate(pieces) for part in (_halves(piece) if k in halved else [piece])]
        dealt += [[] for _ in range(windows - len(dealt))]
        for own in _levelled([[pieces[k] for k in own] for own in dealt]):
            self._sequence(_joined(own))
        self.pieces, self.total = [], 0

    def _sequence(self, pieces: list[tuple[int, int, int]]) -> None:
        offset = 0
        for doc, start, n in pieces:
            doc_id, ids = self.documents[doc]
            self.rows.append((doc_id, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), len(ids) // 4, self.next_id, offset))
            offset += n
        self.next_id += 1

    def taken(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows))
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], _COLUMNS)


def _halves(piece: tuple[int, int, int]) -> list[tuple[int, int, int]]:
    doc, start, n = piece
    return [(doc, start, n // 2), (doc, start + n // 2, n - n // 2)]


def _levelled(windows: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
    """What a window has too much is cut off its largest piece and goes to windows with room: to the one
    that it fills best, or to several."""
    size = lambda own: sum(n for _, _, n in own)
    cut = []
    for own in windows:
        while (excess := size(own) - CAPACITY) > 0:
            k = max(range(len(own)), key=lambda k: own[k][2])
            doc, start, n = own[k]
            part = min(excess, n - 1) if n > 1 else n
            own[k : k + 1] = [(doc, start, n - part)] if part < n else []
            cut.append((doc, start + n - part, part))
    for doc, start, n in sorted(cut, key=lambda piece: -piece[2]):
        while n:
            room = [CAPACITY - size(own) for own in windows]
            enough = [k for k, r in enumerate(room) if r >= n]
            k = min(enough, key=lambda k: room[k]) if enough else max(range(len(room)), key=room.__getitem__)
            part = min(n, room[k])
            windows[k].append((doc, start, part))
            start, n = start + part, n - part
    return [sorted(own) for own in windows if own]


def _joined(pieces: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Pieces of one window, in order; those that follow each other in a document are one again."""
    out: list[tuple[int, int, int]] = []
    for doc, start, n in pieces:
        if out and out[-1][0] == doc and out[-1][1] + out[-1][2] == start:
            out[-1] = (doc, out[-1][1], out[-1][2] + n)
        else:
            out.append((doc, start, n))
    return out


def _pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encode, end = byte_bpe(), END_ID.to_bytes(4, "little")
    packer = Packer(TaskContext.get().partitionId())
    for batch in text_blocks(batches):
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            packer.add(doc_id, encode(text or "") + end)
        if packer.rows:
            yield packer.taken()
    packer.close()
    if packer.rows:
        yield packer.taken()


def packed(docs: DataFrame) -> DataFrame:
    """One row for each piece of docs(doc_id, text): doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pack, _SCHEMA)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
