import base64
import hashlib
import random
from array import array
from functools import cache

import public_tokenizers
import pytest
import tiktoken

from tests.llm.helpers import TEXTS, frame, numbered
from tidelog.llm import byte_bpe


@cache
def library():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def expected(text):
    return array("I", library().encode_ordinary(text)).tobytes()


PARTS = [" ", "  ", "\n", "\n\n", "\t", "'s", "'ll", "'", "a", "B", "ing", "12", "½", "²", "é", "日本", "😀", "​", " ", "\x1c", "\x85", "--", "...", "<|endoftext|>", "Ɤ", "\U00011de0", "՘", "x" * 70, "un", "believ", "able"]


@pytest.mark.parametrize("learn", [False, True])
def test_encode_equals_the_library(learn):
    own, back, rng = byte_bpe.Encoder(), byte_bpe.decoder(), random.Random(11)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(8000)]
    texts += ["".join(chr(rng.choice([rng.randrange(0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(20)) for _ in range(500)]
    texts += ["".join(rng.choice("abcdeinst") for _ in range(n)) for n in (1, 2, 3, 7, 8, 9, 31, 32, 33, 500, 70_000)]
    if learn:
        own.learn(texts)
        assert len(own.match_ids) > 1000
    for t in texts:
        ids = own.encode(t)
        assert ids == expected(t), repr(t)
        assert back.decode(ids) == t.encode()


def test_stretches_part_only_between_matches():
    text = " ".join(t for _, t in TEXTS if t) * 3
    parts = list(byte_bpe.stretches(text, 50))
    assert len(parts) > 20 and "".join(parts) == text and b"".join(map(expected, parts)) == expected(text)


def test_decoding_of_ids_outside_the_vocabulary(spark):
    own = byte_bpe.decoder()
    assert own.decode(array("I", [50256]).tobytes()) is None and own.decode(array("I", [10**6]).tobytes()) is None and own.decode(b"abc") is None and own.decode(None) is None and own.decode(b"") == b""
    rows = byte_bpe.decoded(spark.createDataFrame([(1, bytearray(expected("so it goes")), "x"), (2, None, "y")], "key long, ids binary, decoded string")).collect()
    assert {(r.key, r.decoded and bytes(r.decoded)) for r in rows} == {(1, b"so it goes"), (2, None)}


def test_query_on_odd_rows(spark, tmp_path):
    texts = [*TEXTS, (20, numbered("word", 200_000)), (21, "a\n b"), (21, " ")]
    frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    digest = lambda b: hashlib.sha256(b).hexdigest()
    wanted = [(i, len(expected(t or "")) // 4, digest(expected(t or "")), digest((t or "").encode())) for i, t in texts]
    found = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.op11_byte_bpe(spark, str(tmp_path)).collect()]
    assert sorted(found, key=str) == sorted(wanted, key=str)
    assert byte_bpe.encoded(frame(spark, [])).count() == 0
