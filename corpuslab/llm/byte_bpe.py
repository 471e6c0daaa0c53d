"""Byte-level BPE through a sentencepiece model that is written from the vocabulary (operator 8).

The rank file is the whole model: every token's bytes are mapped to printable characters, one for
each byte, and become a sentencepiece piece with score -rank. A sentencepiece BPE model merges the
adjacent pair of the best score first, the leftmost on ties; with these scores that is the pair of the
lowest rank, as byte-pair encoding by ranks does. The model is serialised here field by field (the
protocol-buffer wire format), with identity normalisation and without dummy prefix or escaped spaces.

Text is cut by the vocabulary's pattern and each match is encoded alone. A match that is itself a token
takes that token's id at once, as rank-based encoders do. Decoding looks every id up in the inverse
mapping; the bytes come back exactly.

A worker keeps the ids of matches, and of blank-separated units of matches, in bounded dictionaries.
They only save repeated work: what is not in them is encoded anew.

Defined cases: null text encodes to no ids; any Unicode text, long or empty, is encoded whole (a text
and its ids are the most that a task holds at a time, beside the dictionaries); repeated rows are encoded
alike; a null key stays; an empty table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpuslab.llm.common import PIECE_BYTES, pieces, utf8

#: Entries that a worker's dictionary holds before it is emptied.
CACHE = 100_000


def byte_alphabet() -> list[str]:
    """A printable character for each byte: printable Latin-1 stands for itself, the rest follow from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    kept = set(own)
    return [chr(b) if b in kept else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The token of each rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _message(field: int, body: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def serialise(tokens: list[bytes]) -> bytes:
    """A sentencepiece ModelProto: one NORMAL piece a token, in rank order, and an UNKNOWN piece behind them."""
    alphabet = byte_alphabet()
    out = bytearray()
    for rank, token in enumerate(tokens):
        piece = "".join(alphabet[b] for b in token).encode()
        out += _message(1, _message(1, piece) + _varint(2 << 3 | 5) + struct.pack("<f", -rank) + _number(3, 1))
    out += _message(1, _message(1, "⁇".encode()) + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _number(3, 2))
    absent = (1 << 64) - 1  # -1: no such id
    trainer = _number(3, 2) + _number(4, len(tokens) + 1) + _number(40, len(tokens)) + _number(41, absent) + _number(42, absent) + _number(43, absent)
    out += _message(2, trainer + _message(45, "⁇".encode()))
    out += _message(3, _message(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0))
    return bytes(out)


class ByteBpe:
    """Encode and decode texts by one rank file."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        tokens = read_ranks(path)
        self._model = sentencepiece.SentencePieceProcessor(model_proto=serialise(tokens))
        back = {c: b for b, c in enumerate(byte_alphabet())}
        #: the bytes of each id, by the inverse mapping of the model's own pieces
        self.table = [bytes(back[c] for c in self._model.id_to_piece(i)) for i in range(len(tokens))]
        self._alphabet = str.maketrans({b: c for b, c in enumerate(byte_alphabet())})
        self._matches = regex.compile(pattern).findall
        self._space = re.compile(r"\s[ ]|[ ]\s|\A[ ]|[ ]\Z")
        self._whole = {token.decode("latin-1"): struct.pack("<I", i) for i, token in enumerate(self.table)}
        self._tokens: dict[str, bytes] = {}
        self._units: dict[str, bytes] = {}

    def _encode_matches(self, matches: set[str]) -> None:
        if len(self._tokens) + len(matches) > CACHE:
            self._tokens.clear()
        new, mapped = [], []
        for match in matches:
            if match not in self._tokens:
                raw = match.encode("utf-8", "replace").decode("latin-1")
                if (known := self._whole.get(raw)) is not None:
                    self._tokens[match] = known
                else:
                    new.append(match)
                    mapped.append(raw.translate(self._alphabet))
        for match, ids in zip(new, self._model.encode(mapped, out_type=int, num_threads=1), strict=True):
            self._tokens[match] = struct.pack(f"<{len(ids)}I", *ids)

    def _units_of(self, text: str) -> list[str] | None:
        """Text cut before each blank, where all blanks stand alone between other characters: no match spans such a cut."""
        if self._space.search(text):
            return None
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Per text, its ids as little-endian unsigned 32-bit integers."""
        cut = [self._units_of(text) for text in texts]
        if len(self._units) > CACHE:
            self._units.clear()
        units = {u for x in cut if x for u in x}
        new = {u: self._matches(u) for u in units.difference(self._units)}
        whole = [self._matches(text) if x is None else None for text, x in zip(texts, cut, strict=True)]
        self._encode_matches({m for x in new.values() for m in x} | {m for x in whole if x for m in x})
        for unit, matches in new.items():
            self._units[unit] = b"".join([self._tokens[m] for m in matches])
        units_get, tokens_get = self._units.__getitem__, self._tokens.__getitem__
        return [b"".join(map(tokens_get, w)) if x is None else b"".join(map(units_get, x)) for x, w in zip(cut, whole, strict=True)]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_LOADED: dict[tuple[str, str], ByteBpe] = {}


def load(path: str, pattern: str) -> ByteBpe:
    """The encoder of a rank file, made once in each Python worker."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = ByteBpe(path, pattern)
    return _LOADED[path, pattern]


def encode(documents: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): ids as packed little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch in pieces(batches, weight=PIECE_BYTES):
            texts = [(x or b"").decode("utf-8", "replace") for x in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bpe.encode(texts), pa.binary())], [key, "ids"])

    rows = documents.select(key, text)
    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """(key, ids) to (key, ids, decoded): the bytes that the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch in pieces(batches, weight=PIECE_BYTES):
            ids = batch.column(1)
            decoded = [bpe.decode(x or b"") for x in ids.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(decoded, pa.binary())], [key, "ids", "decoded"])

    rows = encoded.select(key, "ids")
    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, ids binary, decoded binary")


def round_trip(documents: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids, decoded): encode and decode in one pass, so that a task has one Python worker and ids stay in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch in pieces(batches, weight=PIECE_BYTES):
            ids = bpe.encode([(x or b"").decode("utf-8", "replace") for x in utf8(batch.column(1))])
            decoded = list(map(bpe.decode, ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], [key, "ids", "decoded"])

    rows = documents.select(key, text)
    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, ids binary, decoded binary")
