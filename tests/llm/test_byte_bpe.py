"""Byte-level BPE against the tiktoken library."""

import base64
import hashlib
import random

import public_tokenizers
import pytest
import regex
import tiktoken

from lathe.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def oracle():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rnd = random.Random(5)
    out = ["", " ", "a", "\n\n  x", "<|endoftext|>", "né " * 50, "日本語テキスト" * 30, "😀👍🏽" * 20, "é" * 30, "\x00\x01 \x7f"]
    out += ["".join(rnd.choice("abcdeé ñ日1 \n.!") for _ in range(rnd.randint(1, 400))) for _ in range(60)]
    out += ["".join(rnd.choice("ab") for _ in range(3000)), "a" * 5000, "!" * 3001, "7" * 777, " " * 900 + "x", "the" * 2000]
    out += ["".join(chr(rnd.choice([rnd.randint(32, 126), rnd.randint(160, 0x24F), rnd.randint(0x4E00, 0x9FFF)])) for _ in range(300)) for _ in range(20)]
    return out


@pytest.mark.parametrize("leaf", [2, 5, 48])
def test_matches_library(oracle, leaf):
    codec, splitter = byte_bpe.Codec(PATH, leaf), regex.compile(public_tokenizers.PATTERN)
    for t in texts():
        ids = codec.encode(t, splitter)
        assert ids.tolist() == oracle.encode_ordinary(t)
        assert codec.decode(byte_bpe.pa.array(ids))[0].tobytes() == t.encode()


def test_join_is_associative():
    codec = byte_bpe.Codec(PATH, 8)
    rnd = random.Random(2)
    for _ in range(300):
        a, b, c = (codec.tree("".join(rnd.choice("athenig") for _ in range(rnd.randint(0, 30))).encode()) for _ in range(3))
        assert codec.join(codec.join(a, b), c) == codec.join(a, codec.join(b, c)) == codec.tree(b"".join(codec.tokens[i] for i in a + b + c))


def test_frames(spark, oracle):
    rows = [(i, t, i, "x") for i, t in enumerate(texts())] + [(None, None, 1, None), (3, "twice", 1, "y"), (3, "twice", 1, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, `doc id` string")
    both = byte_bpe.decode(byte_bpe.encode(df, PATH, public_tokenizers.PATTERN), PATH)
    got = byte_bpe.digests(both).collect()
    assert len(got) == len(rows)
    want = sorted((r[0] is None, r[0], hashlib.sha256(",".join(map(str, oracle.encode_ordinary(r[1] or ""))).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows)
    assert sorted((r.doc_id is None, r.doc_id, r.ids_sha256, r.decoded_sha256) for r in got) == want
    once = byte_bpe.digests(byte_bpe.round_trip(df, PATH, public_tokenizers.PATTERN))
    assert sorted(map(str, once.collect())) == sorted(map(str, got)) and once.columns == byte_bpe.digests(both).columns
    odd = spark.createDataFrame([([0, 1],), (None,), ([],)], "ids array<int>")
    assert [bytes(r.decoded) for r in byte_bpe.decode(odd, PATH).collect()] == [oracle.decode_bytes([0, 1]), b"", b""]
    assert byte_bpe.encode(df.limit(0), PATH, public_tokenizers.PATTERN).collect() == []
    with pytest.raises(ValueError, match="already"):
        byte_bpe.encode(df, PATH, public_tokenizers.PATTERN, out="text")
