"""Vectorised helpers for batches of whole texts, shared by the word-based operators.

A batch is a list of texts that one task works on at a time. Texts are handled as UTF-8
bytes: every class that the operators use (white space, ASCII letters and digits) is made of
ASCII bytes, which never occur inside a longer UTF-8 sequence, so words can be cut on bytes.
Word hashes are 64-bit polynomial hashes of a word's bytes through a random table.
"""

from __future__ import annotations

import numpy as np

_U64 = np.uint64
_RNG = np.random.default_rng(20240521)
_BYTE_VALUE = _RNG.integers(1, 2**64, 256, dtype=_U64) | _U64(1)
_ROOT = _U64(0x9E3779B97F4A7C15)
_WINDOW_ROOT = _U64(0xD1342543DE82EF95)


def _inverse(odd: np.uint64) -> np.uint64:
    """Of an odd number, modulo 2**64."""
    return _U64(pow(int(odd), -1, 2**64))


_WINDOW_INVERSE = _inverse(_WINDOW_ROOT)


def _classes(kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(byte after folding, 1 where the folded byte belongs to a word) for each byte."""
    fold = np.arange(256, dtype=np.uint8)
    if kind in ("lower", "alnum"):
        fold[65:91] += 32
    word = np.ones(256, dtype=np.uint8)
    if kind == "alnum":
        word[:128] = 0
        word[48:58] = 1
        word[97:123] = 1
    else:
        word[[32, 9, 10, 11, 12, 13]] = 0
    return fold, word[fold]


#: "exact": runs of other than ASCII white space, unchanged; "lower": the same with A-Z lowered;
#: "alnum": runs of 0-9, a-z (A-Z lowered) and characters beyond ASCII.
KINDS = {kind: _classes(kind) for kind in ("exact", "lower", "alnum")}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose result looks random (the finaliser of splitmix64)."""
    x = x.copy()
    x ^= x >> _U64(30)
    x *= _U64(0xBF58476D1CE4E5B9)
    x ^= x >> _U64(27)
    x *= _U64(0x94D049BB133111EB)
    x ^= x >> _U64(31)
    return x


def powers(root: np.uint64, n: int) -> np.ndarray:
    """root**0 … root**(n-1) modulo 2**64."""
    out = np.full(n, root, dtype=_U64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """The words of a block of texts: hashes in order, and where each text's words begin."""

    def __init__(self, texts: list[str | None], kind: str):
        fold, is_word = KINDS[kind]
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.raw = np.frombuffer(b" ".join([b"", *raw, b""]), dtype=np.uint8)
        sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        #: text k is raw[text_start[k] : text_start[k + 1] - 1]
        self.text_start = text_start = 1 + np.concatenate([[0], np.cumsum(sizes + 1)])
        inside = is_word[self.raw]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.starts, self.ends = edges[0::2], edges[1::2]
        #: words of text k are first[k] … first[k + 1] - 1
        self.first = np.searchsorted(self.starts, text_start)
        lengths = self.ends - self.starts
        if len(lengths):
            at = np.flatnonzero(inside)
            begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            place = np.arange(len(at), dtype=np.int64) - np.repeat(begin, lengths)
            self._value = _BYTE_VALUE[fold[self.raw[at]]] * powers(_ROOT, int(lengths.max()))[place]
            self._begin = begin
            self.hashes = mix(np.add.reduceat(self._value, begin))
        else:
            self._value, self._begin = np.zeros(0, dtype=_U64), np.zeros(0, dtype=np.int64)
            self.hashes = np.zeros(0, dtype=_U64)
        self.counts = np.diff(self.first)

    def window_hashes(self, width: int) -> np.ndarray:
        """Hash of the words i … i + width - 1 for each i where the block still has so many words;
        valid() says which of them lie within one text."""
        n = len(self.hashes)
        if n < width:
            return np.zeros(0, dtype=_U64)
        total = np.zeros(n + 1, dtype=_U64)
        np.cumsum(self.hashes * powers(_WINDOW_ROOT, n), out=total[1:])
        return mix((total[width:] - total[:-width]) * powers(_WINDOW_INVERSE, n - width + 1))

    def prefix_hashes(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the words of more than size bytes, hashes of their first size bytes)."""
        at = np.flatnonzero(self.ends - self.starts > size)
        total = np.zeros(len(at), dtype=_U64)
        for k in range(size):
            total += self._value[self._begin[at] + k]
        return at, mix(total ^ _U64(size << 56))

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def valid(self, width: int) -> np.ndarray:
        """True at each i where the words i … i + width - 1 belong to one text."""
        n = len(self.hashes)
        if n < width:
            return np.zeros(0, dtype=bool)
        left = np.repeat(self.first[1:], self.counts) - np.arange(n)
        return left[: n - width + 1] >= width

    def word(self, i: int) -> bytes:
        return self.raw[self.starts[i] : self.ends[i]].tobytes()


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """min(x[i : i + width]) for each i with so many values left, in about log2(width) passes."""
    if len(x) < width:
        return x[:0]
    step, out = 1, x
    while 2 * step <= width:
        out = np.minimum(out[:-step], out[step:])
        step *= 2
    if step < width:
        more = width - step
        out = np.minimum(out[: len(out) - more], out[more:])
    return out


def as_long(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark's signed longs."""
    return x.view(np.int64)
