"""Text to tokens of public vocabularies, by units that can be encoded one at a time.

A unit is a stretch of text at whose ends no token of the vocabulary can reach across, so a text's
tokens are its units' tokens one after the other. Most units are words that come again and again;
each worker remembers what they encode to, in a table of bounded size.
"""

from __future__ import annotations

import base64
from array import array
from functools import cache

import public_tokenizers

#: Units that a worker remembers; the table is emptied when it holds so many.
REMEMBERED = 500_000

#: Longer units are not remembered.
LONGEST = 64


class Remembered(dict):
    """unit -> what encode(unit) gave."""

    def __init__(self, encode, known: dict | None = None):
        super().__init__(known or {})
        self.encode, self.known = encode, known or {}

    def __missing__(self, unit: str):
        value = self.encode(unit)
        self.add(unit, value)
        return value

    def add(self, unit: str, value) -> None:
        if len(unit) <= LONGEST:
            if len(self) - len(self.known) >= REMEMBERED:
                self.clear()
                self.update(self.known)
            self[unit] = value


class ByteBpe:
    """Ids of the 50k byte-level BPE as little-endian 32-bit bytes, equal to what the tokenizers
    library gives for the .json file without added special tokens.

    A lone space or line end between two characters that are not white space is where byte-level
    pre-tokens part: the space opens the next one, the line end is one of its own. Texts with other
    white space, or with the string of a special token, go to the libraries whole.
    """

    def __init__(self, json_name: str = "byte_bpe_50k.json", ranks_name: str = "byte_bpe_50k.tiktoken"):
        import tiktoken
        from tokenizers import Tokenizer

        with open(public_tokenizers.path(ranks_name), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.whole = Tokenizer.from_file(public_tokenizers.path(json_name))
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.fast = lambda text: array("I", fast.encode_ordinary(text)).tobytes()
        self.opening = Remembered(self.fast)
        self.spaced = Remembered(lambda word: self.fast(" " + word))

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        opening, spaced, out = self.opening, self.spaced.__getitem__, []
        for line in text.split("\n"):
            words = line.split(" ")
            if words != line.split():
                return self.fast(text)
            out.append(opening[words[0]] + b"".join(map(spaced, words[1:])))
        return opening["\n"].join(out)


@cache
def byte_bpe() -> ByteBpe:
    return ByteBpe()


class PieceCounts:
    """Numbers of tokens of the 32k sentencepiece BPE model, equal to the library's.

    Proved from the vocabulary, once: no piece holds a space mark behind another character or a
    line end, so no merge reaches over the start of a word or over a line end; and each listed word
    encodes alone as one token. Listed words are counted at once, only the others are merged.
    """

    def __init__(self, model: str = "piece_bpe_32k.model"):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))
        self.encode = lambda text: len(self.model.encode(text, num_threads=1))
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size()) if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i))]
        self.line_end = self.encode("a\nb") - self.encode("a") - self.encode("b")
        self.parts = not any("\n" in p or MARK in p.lstrip(MARK) for p in pieces) and self.line_end == 1
        # A text gets a space in front: a listed word stands for itself with its space.
        words = [p[1:] for p in pieces if p[:1] == MARK and p[1:] and MARK not in p[1:]]
        self.whole_tokens = {w: 1 for w, ids in zip(words, self.model.encode(words, num_threads=1)) if len(ids) == 1}
        self.spaced = Remembered(self.encode, self.whole_tokens)
        # Behind a line end no space is put in front of a word.
        self.bare = Remembered(lambda word: self.encode("\n" + word) - self.encode("\n"))

    def __call__(self, text: str) -> int:
        if not self.parts or MARK in text:
            return self.encode(text)
        spaced, n = self.spaced.__getitem__, -1
        for k, line in enumerate(text.split("\n")):
            words = line.split(" ")
            if words != line.split():
                return self.encode(text)
            n += 1 + (self.bare[words[0]] if k else self.spaced[words[0]]) + sum(map(spaced, words[1:]))
        return n


#: What sentencepiece writes for a space.
MARK = "\u2581"


@cache
def piece_counts() -> PieceCounts:
    return PieceCounts()
