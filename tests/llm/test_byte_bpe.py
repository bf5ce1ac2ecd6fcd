"""Byte-level BPE against the tiktoken library, and exact round trips."""

import hashlib
import random
import struct

import public_tokenizers
import pytest
import tiktoken

from weftline.llm.byte_bpe import Encoder, _Known, codec, decoded, digest, encoded, joined, read_codec

NAMES = ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")
TEXTS = [
    "Hello world, it's 2024!\n\n  indented\ttext  ", "", None, " ", "\n", "a" * 5000, "ab" * 3000, "Käse ñandú 東京は夜   x\x1cy", "<|endoftext|> is text", "é‍👩‍👩‍👧 ½ ²",
    "we'll they'RE 'tis I'd", "\x00\x01\x7f" + chr(0x10FFFF), "x" * 40 + " " * 300 + "y",
]


def reference(name):
    own = read_codec(public_tokenizers.path(name), public_tokenizers.PATTERN)
    ranks = dict(zip(own.tokens, own.ranks, strict=True))
    return own, tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("name", NAMES)
def test_equals_tiktoken(spark, name):
    own, other = reference(name)
    rng = random.Random(7)
    alphabet = "aeiou tnsrhld,.!'\n\t 0123éßñ東" + "".join(map(chr, (0xA0, 0x1C, 0x85, 0x2003, 0x1F600)))
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 400))) for _ in range(300)]
    rows = [(i, t, 1, "x", b"") for i, t in enumerate(texts)] + [(None, "no id", 1, "x", b""), (3, "again", 1, "x", b""), (3, "again", 1, "x", b"")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, ids string, decoded binary")
    got = digest(decoded(encoded(docs, own), own))
    want = []
    for i, t, *_ in rows:
        ids = other.encode_ordinary(t or "")
        want.append((str(i), len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.collect()) == sorted(want)
    assert encoded(docs.limit(0), own).count() == 0


@pytest.mark.parametrize("name", NAMES)
def test_every_code_point_and_token(name):
    own, other = reference(name)
    encoder, table = Encoder(own), dict(zip(own.ranks, own.tokens, strict=True))
    for first in range(0, 0x110000, 512):
        text = "".join(f"a{chr(c)}b1 {chr(c)} " for c in range(first, first + 512) if not 0xD800 <= c <= 0xDFFF)
        ids = encoder.ids(text)
        assert ids == struct.pack(f"<{len(ids) // 4}I", *other.encode_ordinary(text)) and joined(ids, table) == text.encode()
    assert len(own.unmerged) < len(own.tokens)


def test_long_texts_in_parts():
    own, other = reference(NAMES[0])
    text = "one two  three, " * 2000 + "z" * 100_000
    assert Encoder(own).ids(text, longest=100, step=17) == Encoder(own).ids(text) == struct.pack(f"<{len(other.encode_ordinary(text))}I", *other.encode_ordinary(text))


def test_tokens_that_merges_miss_and_gaps_in_ids():
    """A pre-token that is a token is that token, as in the library; ids need not be dense."""
    ranks = {bytes([b]): 3 * b for b in range(256)} | {b"xyz": 5000, b"ab": 6000}
    own = codec(ranks, public_tokenizers.PATTERN)
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = "xyz ab xyzab abxyz"
    ids = Encoder(own).ids(text)
    assert ids == struct.pack(f"<{len(ids) // 4}I", *other.encode_ordinary(text))
    assert own.unmerged == (own.tokens.index(b"xyz"),)
    with pytest.raises(ValueError, match="byte 0"):
        codec({b"a": 0}, public_tokenizers.PATTERN)


def test_memory_of_words_is_bounded():
    own, _ = reference(NAMES[0])
    known = _Known(own, most=10)
    for i in range(100):
        known[f"word{i}"]
    assert len(known) <= 10 and known["word1"] == _Known(own)["word1"]


def test_ids_outside_the_vocabulary(spark):
    own, _ = reference(NAMES[0])
    rows = [(1, struct.pack("<I", 60000)), (2, b"abc"), (3, None), (4, b"")]
    got = {r.doc_id: r.decoded for r in decoded(spark.createDataFrame(rows, "doc_id long, ids binary"), own).collect()}
    assert got == {1: None, 2: None, 3: None, 4: b""}
