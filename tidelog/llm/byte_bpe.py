"""Byte-level BPE encoding and decoding, with a segment tree for the merges.

A text is cut into the matches of the vocabulary's pattern. A match that is a token as a whole is
that token. Of any other, the bytes are the first parts; a segment tree over the byte positions
holds, for each live part, the rank of the pair that it makes with its right neighbour, and its root
is the leftmost pair of least rank. A merge changes three leaves at most (the pair itself, its left
neighbour, the part that is gone), each in logarithmic time, so a match of n bytes takes
O(n log n) whatever it holds. Decoding looks each id's bytes up.

Words come again and again: a worker remembers the ids of short stretches between lone spaces and
line ends, where matches always part, in a table of bounded size.

Defined results: a null or empty text has no tokens and decodes to no bytes; rows are independent,
so repeated rows and null ids are carried through; a very long text is handled in stretches, each a
whole number of matches; ids that are null, or hold an id outside the vocabulary, decode to null; other
columns are not read when encoding, and kept when decoding; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from tidelog.llm.common import table, text_blocks
from tidelog.llm.tokens import Remembered

RANKS = "byte_bpe_50k.tiktoken"

#: Texts are matched in stretches of at least so many characters.
STRETCH = 1 << 20

#: Longer matches keep their tree in machine integers.
COMPACT = 1 << 16

#: Matches of up to so many bytes are merged side by side, at most so many at a time.
SHORT = 32
TOGETHER = 20_000

_NEVER = 1 << 62
_PLACE = (1 << 32) - 1

#: A lone space between two characters that are not white space: matches part in front of it.
_PARTS = re.compile(r"(?<=\S)(?= \S)")


def merged(piece: bytes, ranks: dict[bytes, int], longest: int) -> list[int]:
    """The ids of one match of the pattern.

    tree[size + k] is the leaf of the part that starts at byte k: rank << 32 | k of the pair that it
    makes with the next part, so that the least value is the leftmost pair of least rank; _NEVER where
    there is no such pair, or no part starts any more. after and before link the starts of live parts."""
    n, rank_of = len(piece), ranks.get
    pairs = [_NEVER if (rank := rank_of(piece[k : k + 2])) is None else rank << 32 | k for k in range(n - 1)]
    size = 1 << (n - 1).bit_length()
    tree = [_NEVER] * size + pairs + [_NEVER] * (size - len(pairs))
    low, high = size, 2 * size
    while low > 1:
        tree[low >> 1 : low] = map(min, tree[low:high:2], tree[low + 1 : high : 2])
        low, high = low >> 1, low
    after, before = list(range(1, n + 2)), list(range(-1, n))
    if n > COMPACT:
        tree, after, before = array("q", tree), array("q", after), array("q", before)
    while (least := tree[1]) < _NEVER:
        start = least & _PLACE
        gone = after[start]
        end = after[start] = after[gone]
        changes = [(gone, _NEVER), (start, _NEVER)]
        if end < n:
            before[end] = start
            if (stop := after[end]) - start <= longest and (rank := rank_of(piece[start:stop])) is not None:
                changes[1] = (start, rank << 32 | start)
        if start:
            left = before[start]
            rank = rank_of(piece[left:end]) if end - left <= longest else None
            changes.append((left, _NEVER if rank is None else rank << 32 | left))
        for place, value in changes:
            k = size + place
            if tree[k] == value:
                continue
            tree[k] = value
            while k > 1:
                other = tree[k ^ 1]
                k >>= 1
                if other < value:
                    value = other
                if tree[k] == value:
                    break
                tree[k] = value
    ids, at = [], 0
    while at < n:
        ids.append(ranks[piece[at : after[at]]])
        at = after[at]
    return ids


class ManyMatches:
    """The same trees for many short matches side by side: a row of each array is one match, and a step
    merges the leftmost pair of least rank of every match that still has one."""

    def __init__(self, ranks: dict[bytes, int]):
        self.single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        found = ((ranks[t[:k]] << 32 | ranks[t[k:]], rank) for t, rank in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks)
        pairs = np.array(sorted(found), dtype=np.int64)
        self.keys, self.values = pairs[:, 0].copy(), pairs[:, 1].copy()

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that two tokens make together, or _NEVER."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], _NEVER)

    def merged(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, as little-endian 32-bit integers."""
        n = np.array([len(p) for p in pieces])
        m, widest = len(pieces), int(n.max())
        size = 1 << (widest - 1).bit_length()
        inside = np.arange(size) < n[:, None]
        token = np.zeros((m, size), dtype=np.int64)
        token[inside] = self.single[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        place = np.arange(size, dtype=np.int64)
        leaves = np.full((m, size), _NEVER, dtype=np.int64)
        pair = inside[:, 1:].nonzero()
        rank = self._rank(token[pair], token[pair[0], pair[1] + 1])
        leaves[pair] = np.where(rank < _NEVER, rank << 32 | pair[1], _NEVER)
        levels = [leaves]
        while levels[-1].shape[1] > 1:
            levels.append(np.minimum(levels[-1][:, ::2], levels[-1][:, 1::2]))
        after = np.tile(np.arange(1, size + 1), (m, 1))
        before = np.tile(np.arange(-1, size - 1), (m, 1))

        def put(rows, where, value):
            levels[0][rows, where] = value
            for below, level in zip(levels, levels[1:]):
                where = where >> 1
                level[rows, where] = np.minimum(below[rows, 2 * where], below[rows, 2 * where + 1])

        rows = np.arange(m)
        while len(rows := rows[levels[-1][rows, 0] < _NEVER]):
            least = levels[-1][rows, 0]
            start = least & _PLACE
            gone = after[rows, start]
            end = after[rows, gone]
            token[rows, start] = least >> 32
            inside[rows, gone] = False
            after[rows, start] = end
            more = end < n[rows]
            value = np.full(len(rows), _NEVER)
            r, s, e = rows[more], start[more], end[more]
            before[r, e] = s
            rank = self._rank(token[r, s], token[r, e])
            value[more] = np.where(rank < _NEVER, rank << 32 | s, _NEVER)
            put(rows, gone, _NEVER)
            put(rows, start, value)
            more = start > 0
            r, s = rows[more], start[more]
            left = before[r, s]
            rank = self._rank(token[r, left], token[r, s])
            put(r, left, np.where(rank < _NEVER, rank << 32 | left, _NEVER))
        ids = token[inside].astype("<u4").tobytes()
        ends = (4 * np.cumsum(inside.sum(1))).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]


def stretches(text: str, least: int = STRETCH) -> Iterator[str]:
    """Cuts a text where matches always part; a stretch has at least so many characters."""
    at = 0
    while len(text) - at > least and (cut := _PARTS.search(text, at + least)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def _ranges(codes: Iterable[int]) -> str:
    """Code points in rising order as the inside of a character class."""
    runs: list[list[int]] = []
    for c in codes:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in runs)


def read_ranks(name: str) -> dict[bytes, int]:
    with open(public_tokenizers.path(name), "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Encoder:
    """Encodes with one file of ranks."""

    def __init__(self, ranks_name: str = RANKS):
        self.ranks = read_ranks(ranks_name)
        self.longest = max(map(len, self.ranks))
        self.usual = regex.compile(public_tokenizers.PATTERN)
        self.odd, self.exact = _library_classes(self.usual)
        self.many = ManyMatches(self.ranks)
        self.match_ids = Remembered(self._match_ids)
        self.opening = Remembered(self._ids)
        self.spaced = Remembered(self._spaced)

    def _match_ids(self, match: str) -> bytes:
        piece = match.encode("utf-8", "surrogatepass")
        rank = self.ranks.get(piece)
        return array("I", merged(piece, self.ranks, self.longest) if rank is None else [rank]).tobytes()

    def learn(self, texts: list[str | None]) -> None:
        """Merges the new short matches of many texts together; encode() then finds their ids."""
        words = [w for w in set().union(*(t.split() for t in texts if t)) if w not in self.spaced and len(w) < SHORT]
        matches = [x for x in set(self._matches(" " + " ".join(words))) if x not in self.match_ids]
        new = {x: piece for x in matches if len(piece := x.encode("utf-8", "surrogatepass")) <= SHORT and piece not in self.ranks}
        for width in (8, 16, SHORT):
            some = [x for x, piece in new.items() if width // 2 < len(piece) <= width or width == 8 and len(piece) <= 4]
            for k in range(0, len(some), TOGETHER):
                part = some[k : k + TOGETHER]
                for x, ids in zip(part, self.many.merged([new[x] for x in part])):
                    self.match_ids.add(x, ids)

    def _matches(self, text: str) -> list[str]:
        pattern = self.usual if text.isascii() or not self.odd.search(text) else self.exact
        return pattern.findall(text)

    def _ids(self, text: str) -> bytes:
        return b"".join(map(self.match_ids.__getitem__, self._matches(text)))

    def _spaced(self, word: str) -> bytes:
        if word.isalpha() and word.isascii():
            return self.match_ids[" " + word]
        return self._ids(" " + word)

    def encode(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers."""
        opening, spaced, out = self.opening, self.spaced.__getitem__, []
        for line in text.split("\n"):
            words = line.split(" ")
            if words != line.split():
                return b"".join(map(self._ids, stretches(text)))
            out.append(opening[words[0]] + b"".join(map(spaced, words[1:])))
        return opening["\n"].join(out)


class Decoder:
    """Decodes with one file of ranks."""

    def __init__(self, ranks_name: str = RANKS):
        ranks = read_ranks(ranks_name)
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token

    def decode(self, ids: bytes | None) -> bytes | None:
        """The bytes of ids; None when one of them is outside the vocabulary."""
        try:
            tokens = list(map(self.bytes_of.__getitem__, memoryview(ids).cast("I")))
        except (IndexError, TypeError):
            return None
        return b"".join(tokens) if all(tokens) else None


def _library_classes(usual: regex.Pattern) -> tuple[re.Pattern, re.Pattern]:
    """(characters that the reading library and this one class otherwise, the pattern with the library's
    classes). The two follow different versions of Unicode; the library is asked what it matches."""
    import tiktoken

    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    single = {bytes([b]): b for b in range(256)}
    classes, odd = {}, set()
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        found = bytes(tiktoken.Encoding("class", pat_str=name + "+", mergeable_ranks=single, special_tokens={}).encode_ordinary(every)).decode()
        classes[name] = _ranges(sorted(map(ord, found)))
        odd |= set(found) ^ set(regex.findall(name, every))
    letters, numbers, spaces = classes.values()
    exact = usual.pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{spaces}{letters}{numbers}]").replace(r"\p{L}", f"[{letters}]")
    exact = exact.replace(r"\p{N}", f"[{numbers}]").replace(r"\s", f"[{spaces}]").replace(r"\S", f"[^{spaces}]")
    return re.compile(f"[{_ranges(sorted(map(ord, odd)))}]" if odd else r"(?!)"), re.compile(exact)


@cache
def encoder(ranks_name: str = RANKS) -> Encoder:
    return Encoder(ranks_name)


@cache
def decoder(ranks_name: str = RANKS) -> Decoder:
    return Decoder(ranks_name)


def _encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = encoder()
    for batch in text_blocks(batches):
        texts = batch.column("text").to_pylist()
        own.learn(texts)
        ids = [own.encode(text) if text else b"" for text in texts]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])


def encoded(docs: DataFrame) -> DataFrame:
    """For each row of docs(doc_id, text): doc_id, n_tokens, and ids as little-endian unsigned 32-bit
    integers in one binary value."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encode, "doc_id long, n_tokens long, ids binary")


def _decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    decode = decoder().decode
    for batch in text_blocks(batches, "ids"):
        texts = [decode(ids) for ids in batch.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], [*batch.schema.names, "decoded"])


def decoded(tokens: DataFrame) -> DataFrame:
    """tokens(ids, ...) with the column decoded: the bytes of ids. A column of that name is replaced."""
    tokens = tokens.drop("decoded")
    return tokens.mapInArrow(_decode, StructType([*tokens.schema, StructField("decoded", BinaryType())]))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = decoded(encoded(table(spark, sf_dir, "documents")))
    return tokens.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
