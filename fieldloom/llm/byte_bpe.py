"""Byte-level BPE through sentencepiece.

A rank file (base64 token, rank) becomes a sentencepiece BPE model without any
training: each token's bytes are mapped to printable characters, its piece has
the score -rank, and the normaliser is the identity. Sentencepiece then merges
the best-scored adjacent pair first, leftmost first, which is the order of the
ranks. Each match of the splitting pattern is encoded by itself.

Defined results: null text counts as empty and gives no ids; extra columns are
ignored; repeated rows are each encoded.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct units and pre-tokens kept by a worker before their memo starts anew; this bounds memory and changes no result.
UNITS, PARTS = 500_000, 1_000_000
#: Texts are encoded in groups of about so many characters.
GROUP = 1 << 20
#: Longer units are not memorised.
MEMO_LENGTH = 64


def byte_alphabet() -> list[str]:
    """A printable character for each byte: itself where printable in Latin-1, else from 256 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value) -> bytes:
    """One protobuf field: int as varint, float as fixed32, bytes as length-delimited."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + np.float32(value).tobytes()
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out = [b""] * len(pairs)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


def serialise(tokens: list[bytes]) -> bytes:
    """A sentencepiece ModelProto whose piece i is token i; one unknown piece follows them."""
    letters = byte_alphabet()
    pieces = [_field(1, "".join(letters[b] for b in t).encode()) + _field(2, -float(i)) + _field(3, 1) for i, t in enumerate(tokens)]
    pieces.append(_field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(tokens)) + _field(41, (1 << 64) - 1) + _field(42, (1 << 64) - 1) + _field(43, (1 << 64) - 1)
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normaliser)


def ascii_pattern(pattern: str) -> re.Pattern:
    """The splitting pattern for texts of ASCII characters, for the faster standard engine."""
    inside = re.sub(r"\[[^]]*\]", lambda m: m[0].replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9"), pattern)
    return re.compile(inside.replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]"), re.ASCII)


class Codec:
    """Encodes and decodes texts with one rank file.

    A blank before anything but white space always starts a pre-token of the
    pattern, so a text falls apart there into units whose ids don't depend on
    what stands around them. Units and pre-tokens are memorised; a new unit is
    split by the pattern, and its new pre-tokens are encoded.
    """

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        tokens = read_ranks(path)
        self._model = sentencepiece.SentencePieceProcessor(model_proto=serialise(tokens))
        self._split = regex.compile(pattern).findall
        self._split_ascii = ascii_pattern(pattern).findall
        #: A blank that white space or the end follows starts no pre-token.
        self._wide = re.compile(r" (?:[\s\x1c-\x1f]|$)").search
        letters = byte_alphabet()
        self._to_letters = dict(enumerate(letters))
        self._plain = re.compile(r" ?[!-~]*").fullmatch
        self._blank = letters[ord(" ")]
        back = {c: b for b, c in enumerate(letters)}
        self._piece_bytes = [bytes(map(back.__getitem__, self._model.id_to_piece(i))) for i in range(len(tokens))]
        #: Ids of " " + unit, and ids of pre-tokens.
        self._units: dict[str, bytes] = {}
        self._parts: dict[str, bytes] = {}

    def _mapped(self, part: str) -> str:
        return part.replace(" ", self._blank) if self._plain(part) else part.encode().decode("latin-1").translate(self._to_letters)

    def _cut(self, text: str) -> list[str]:
        return (self._split_ascii if text.isascii() else self._split)(text)

    def _known(self, parts: list[str]) -> dict[str, bytes]:
        """The pre-tokens' memo, which now has all of parts."""
        if new := [*set(parts).difference(self._parts)]:
            ids = self._model.encode([*map(self._mapped, new)], num_threads=1)
            flat, ends = np.fromiter(chain.from_iterable(ids), "<u4").tobytes(), [0, *accumulate(4 * len(i) for i in ids)]
            self._parts.update((p, flat[ends[i] : ends[i + 1]]) for i, p in enumerate(new))
        return self._parts

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        if len(self._units) > UNITS:
            self._units.clear()
        if len(self._parts) > PARTS:
            self._parts.clear()
        split = [None if self._wide(t) else t.split(" ") for t in texts]
        new = [*set(chain.from_iterable(s for s in split if s)).difference(self._units)]
        # Units in place of texts that fall apart otherwise: the whole text, and each text's first unit, which no blank precedes.
        heads = [self._cut(t if s is None else s[0]) for t, s in zip(texts, split, strict=True)]
        cut = [self._cut(" " + u) for u in new]
        ids = self._known([*chain.from_iterable(heads), *chain.from_iterable(cut)]).__getitem__
        self._units.update((u, b"".join(map(ids, c))) for u, c in zip(new, cut, strict=True))
        units = self._units.__getitem__
        out = [b"".join(map(ids, h)) + (b"".join(map(units, s[1:])) if s else b"") for h, s in zip(heads, split, strict=True)]
        self._forget(self._units, new)
        self._forget(self._parts, chain.from_iterable(chain(heads, cut)))
        return out

    @staticmethod
    def _forget(memo: dict, keys) -> None:
        """Keys too long to be worth their memory."""
        for k in keys:
            if len(k) > MEMO_LENGTH:
                memo.pop(k, None)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self._piece_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def groups(texts: list[str | None]) -> Iterator[list[str]]:
    """Consecutive texts, about GROUP characters at a time; null becomes empty."""
    out, size = [], 0
    for t in texts:
        out.append(t or "")
        size += len(out[-1])
        if size >= GROUP:
            yield out
            out, size = [], 0
    if out:
        yield out


_CODECS: dict[tuple[str, str], Codec] = {}


def codec_of(path: str, pattern: str) -> Codec:
    """This process's codec for a rank file; tasks of one worker share its memo."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row per row of docs: id, n_tokens, ids_sha256, decoded_sha256, and the packed ids if with_ids.

    No shuffle; a task holds one Arrow batch and its memo.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path, pattern)
        for batch in batches:
            packed = [p for part in groups(batch.column(1).to_pylist()) for p in codec.encode_many(part)]
            columns = [
                batch.column(0),
                pa.array([len(p) // 4 for p in packed], pa.int64()),
                pa.array([hashlib.sha256(p).hexdigest() for p in packed]),
                pa.array([hashlib.sha256(codec.decode(p)).hexdigest() for p in packed]),
            ]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(packed, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    narrow = docs.select(F.col(id_column).cast("long").alias("id"), F.col("text"))
    return narrow.mapInArrow(run, schema).withColumnRenamed("id", id_column)


def decode_documents(encoded: DataFrame, path: str, pattern: str, id_column: str = "doc_id") -> DataFrame:
    """The bytes that packed ids (column ids) stand for: id, decoded; null ids decode to no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([codec.decode(x or b"") for x in batch.column(1).to_pylist()], pa.binary())], names=["id", "decoded"])

    return encoded.select(F.col(id_column).cast("long").alias("id"), "ids").mapInArrow(run, "id long, decoded binary").withColumnRenamed("id", id_column)
