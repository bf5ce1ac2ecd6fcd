"""Byte-level BPE encoding and decoding through a sentencepiece model made from a rank file.

The vocabulary is no sentencepiece model: its tokens are byte strings, its merges are their ranks.  ``codec`` writes
the model directly, in the wire format of sentencepiece's protocol buffer: every byte becomes one printable
character (the usual byte alphabet), every token the piece of its characters, scored by its negative rank,
and the normaliser is the identity.  The best-scored merge is then the one of least rank, the leftmost of equal ones, so
a piece sequence is a rank sequence.  Pre-tokens (matches of the vocabulary's pattern) are encoded one by one, so no
merge crosses their borders; each worker remembers short ones, of which a bounded number is kept.  A pre-token
that is a token is that token, even if no merges lead to it.  Decoding joins the tokens' bytes, the inverse
mapping of the pieces.

Both directions are one narrow pass over Arrow batches in slices of 4 MB; nothing is shuffled and nothing grows with the
corpus.  The model (about 1 MB for 50,000 tokens) is made on the driver, where the rank file is, and travels with
the function.

Cases: a null or empty text has no ids and decodes to no bytes; very long texts are cut into pre-tokens piece by piece;
strings of special tokens are ordinary text; null ids (of rows or of texts) stay null rows; repeated rows
are encoded each; an empty table gives an empty result; columns other than id and text are ignored, whatever their
names.  Ids that are null, not whole, or outside the vocabulary decode to null.  A vocabulary without one
of the 256 bytes raises ``ValueError``.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import batched
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm._tokens import slices

#: Field numbers and types of the sentencepiece model format.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE, SCORE, KIND = 1, 2, 3
MODEL_KIND, UNK_ID, BOS_ID, EOS_ID, PAD_ID = 3, 40, 41, 42, 43
NAME, DUMMY_PREFIX, EXTRA_BLANKS, ESCAPE_BLANKS = 1, 3, 4, 5
BPE, UNKNOWN = 2, 2
VARINT, BYTES, FLOAT = 0, 2, 5


@dataclass(frozen=True)
class Codec:
    """A vocabulary ready for the workers; ``ranks`` are the tokens' ids in the order of the pieces."""

    model: bytes
    tokens: tuple[bytes, ...]
    ranks: tuple[int, ...]
    unmerged: tuple[int, ...]  # places of tokens that merges do not lead to
    pattern: str


def alphabet() -> dict[int, int]:
    """The character of each byte: itself if it is printable in Latin-1, else the next one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


ALPHABET = alphabet()


def spelled(token: bytes) -> str:
    return token.decode("latin-1").translate(ALPHABET)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, kind: int, value: bytes | int) -> bytes:
    head = _varint(number << 3 | kind)
    if kind == VARINT:
        return head + _varint(value % (1 << 64))
    return head + (_varint(len(value)) if kind == BYTES else b"") + value


def serialised(tokens: Iterable[bytes]) -> bytes:
    """The sentencepiece model of tokens in the order of their ranks; the unknown piece comes last."""
    out, n = [], 0
    for n, token in enumerate(tokens, 1):
        out.append(_field(PIECES, BYTES, _field(PIECE, BYTES, spelled(token).encode()) + _field(SCORE, FLOAT, struct.pack("<f", 1.0 - n))))
    out.append(_field(PIECES, BYTES, _field(PIECE, BYTES, b"<unk>") + _field(KIND, VARINT, UNKNOWN)))
    out.append(_field(TRAINER, BYTES, b"".join(_field(k, VARINT, v) for k, v in ((MODEL_KIND, BPE), (UNK_ID, n), (BOS_ID, -1), (EOS_ID, -1), (PAD_ID, -1)))))
    plain = b"".join(_field(k, VARINT, 0) for k in (DUMMY_PREFIX, EXTRA_BLANKS, ESCAPE_BLANKS))
    out.append(_field(NORMALIZER, BYTES, _field(NAME, BYTES, b"identity") + plain))
    return b"".join(out)


@lru_cache(maxsize=4)
def _processor(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def codec(ranks: dict[bytes, int], pattern: str) -> Codec:
    """The codec of a vocabulary (token to id); at most 2**24 tokens, whose places are exact as scores."""
    missing = [b for b in range(256) if bytes([b]) not in ranks]
    if missing:
        raise ValueError(f"the vocabulary has no token for byte {missing[0]}")
    if len(ranks) > 1 << 24:
        raise ValueError("more than 2**24 tokens")
    tokens = tuple(sorted(ranks, key=ranks.get))
    model = serialised(tokens)
    merged = _processor(model).encode([spelled(t) for t in tokens])
    return Codec(model, tokens, tuple(ranks[t] for t in tokens), tuple(i for i, ids in enumerate(merged) if ids != [i]), pattern)


def read_codec(path: str, pattern: str) -> Codec:
    """The codec of a rank file: a token in base 64 and its id on each line."""
    lines = (line.split() for line in Path(path).read_bytes().splitlines() if line.strip())
    return codec({base64.b64decode(token): int(rank) for token, rank in lines}, pattern)


class _Known(dict):
    """The ids of pre-tokens, as bytes; short ones are remembered, ``most`` at a time."""

    def __init__(self, own: Codec, most: int = 1 << 18, longest: int = 48):
        self.processor, self.most, self.longest = _processor(own.model), most, longest
        self.ranks = np.array(own.ranks, "<u4")
        self.fixed = {own.tokens[i].decode(): self.ranks[i].tobytes() for i in own.unmerged if _is_text(own.tokens[i])}
        super().__init__(self.fixed)

    def __missing__(self, word: str) -> bytes:
        found = self.ranks[self.processor.encode(spelled(word.encode()))].tobytes()
        if len(word) <= self.longest:
            if len(self) >= self.most + len(self.fixed):
                self.clear()
                self.update(self.fixed)
            self[word] = found
        return found


def _is_text(token: bytes) -> bool:
    try:
        token.decode()
    except UnicodeDecodeError:
        return False
    return True


class Encoder:
    def __init__(self, own: Codec):
        import regex

        self.pattern, self.known = regex.compile(own.pattern), _Known(own)

    def ids(self, text: str, longest: int = 1 << 20, step: int = 1 << 16) -> bytes:
        """The ids of a text, four bytes each; beyond ``longest`` characters its pre-tokens are not held at once."""
        if len(text) <= longest:
            return b"".join(map(self.known.__getitem__, self.pattern.findall(text)))
        found = (m.group() for m in self.pattern.finditer(text))
        return b"".join(b"".join(map(self.known.__getitem__, part)) for part in batched(found, step))


@lru_cache(maxsize=2)
def _encoder(own: Codec) -> Encoder:
    return Encoder(own)


@lru_cache(maxsize=2)
def _table(own: Codec) -> dict[int, bytes]:
    return dict(zip(own.ranks, own.tokens, strict=True))


def joined(ids: bytes | None, table: dict[int, bytes]) -> bytes | None:
    """The bytes of packed ids."""
    if ids is None or len(ids) % 4:
        return None
    try:
        return b"".join(map(table.__getitem__, np.frombuffer(ids, "<u4").tolist()))
    except KeyError:
        return None


def encoded(docs: DataFrame, own: Codec, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens (long), ids (binary: little-endian unsigned 32-bit integers) of every row."""
    kind = docs.schema[doc].dataType.simpleString()
    rows = docs.select(F.col(doc).alias("doc_id"), F.col(text).cast("string").alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(own)
        for batch in batches:
            for lo, hi in slices(batch["_t"]):
                part = batch.slice(lo, hi - lo)
                ids = [encoder.ids(t or "") for t in part["_t"].to_pylist()]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary")


def decoded(tokens: DataFrame, own: Codec, ids: str = "ids", doc: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids, decoded (binary) of rows with packed ids."""
    kind = tokens.schema[doc].dataType.simpleString()
    rows = tokens.select(F.col(doc).alias("doc_id"), F.col(ids).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(own)
        for batch in batches:
            for lo, hi in slices(batch["ids"]):
                part = batch.slice(lo, hi - lo)
                out = [joined(x, table) for x in part["ids"].to_pylist()]
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["ids"], pa.array(out, pa.binary())], ["doc_id", "ids", "decoded"])

    out = rows.mapInArrow(run, f"doc_id {kind}, ids binary, decoded binary")
    return out.select("doc_id", F.floor(F.length("ids") / 4).alias("n_tokens"), "ids", "decoded")


def digest(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
