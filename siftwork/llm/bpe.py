"""Byte-level BPE encoding and decoding with a sentencepiece model serialised straight from the vocabulary.

Every token's bytes are mapped to 256 printable characters, one for each byte, and become a piece whose score is its
negative rank; normalisation is the identity. sentencepiece then merges, within each pre-token, the pair of best rank,
leftmost first, which is what a rank file means. Decoding maps pieces back to bytes. No special tokens.

A null text is empty (no ids). Rows repeat as they come; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame

from siftwork.llm._shared import buffer_of, mapped, only

#: Pre-tokens that a worker remembers, of so many characters at most; at this many it starts anew, which costs time and
#: changes nothing.
REMEMBERED, SHORT = 400_000, 64
#: Bytes 0 to 255 as letters that no piece marker, white space or control character is among.
LETTERS = [chr(0x4E00 + b) for b in range(256)]
TO_LETTERS = {b: LETTERS[b] for b in range(256)}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _field(number: int, kind: int, body: bytes) -> bytes:
    return _varint(number << 3 | kind) + (_varint(len(body)) + body if kind == 2 else body)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def spell(b: bytes) -> str:
    return b.decode("latin-1").translate(TO_LETTERS)


def spelt(piece: str) -> bytes:
    """The bytes that spell() made a piece of."""
    return bytes(ord(c) - ord(LETTERS[0]) for c in piece)


def serialised(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece model: piece 0 is unknown, piece r + 1 is the r-th token in the order of ranks."""
    piece = lambda text, score, kind: _field(1, 2, _field(1, 2, text.encode()) + _field(2, 5, struct.pack("<f", score)) + _field(3, 0, _varint(kind)))
    out = [piece("<unk>", 0.0, 2)]
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        out.append(piece(spell(token), -float(rank), 1))
    trainer = _field(3, 0, _varint(2)) + _field(4, 0, _varint(len(ranks) + 1)) + b"".join(_field(k, 0, _varint(v)) for k, v in ((40, 0), (41, (1 << 64) - 1), (42, (1 << 64) - 1), (43, (1 << 64) - 1)))
    normaliser = _field(1, 2, b"identity") + b"".join(_field(k, 0, _varint(0)) for k in (3, 4, 5))
    return b"".join(out) + _field(2, 2, trainer) + _field(3, 2, normaliser)


#: Texts whose code points all lie at or below this are cut by a plain pattern with the same classes spelt out.
PLAIN = 0x17F


def spelt_out(pattern: str) -> str:
    """pattern with its Unicode classes replaced by their members up to PLAIN; for texts within PLAIN both cut alike."""
    members = {k: "".join(re.escape(chr(c)) for c in range(PLAIN + 1) if regex.match(k, chr(c))) for k in (r"\p{L}", r"\p{N}", r"\s")}
    out, i, inside = "", 0, False
    while i < len(pattern):
        step = next((k for k in members if pattern.startswith(k, i)), None)
        if step:
            out += members[step] if inside else f"[{members[step]}]"
        elif pattern.startswith(r"\S", i) and not inside:
            step, out = r"\S", f"{out}[^{members[chr(92) + 's']}]"
        else:
            step = pattern[i : i + 2] if pattern[i] == chr(92) else pattern[i]
            inside = step == "[" or inside and step != "]"
            out += step
        i += len(step)
    return out


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.cut = regex.compile(pattern)
        self.beyond = re.compile(f"[^\x00-{chr(PLAIN)}]").search
        self.plain = re.compile(spelt_out(pattern))
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialised(ranks))
        ordered = sorted(ranks.items(), key=lambda x: x[1])
        self.rank_of = [-1, *[r for _, r in ordered]]
        # the way back: a rank's piece as the model has it, its letters turned into bytes again
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes_of = {r: spelt(pieces[i]) for i, r in enumerate(self.rank_of) if i}
        self.seen: dict[str, bytes] = {}

    def _learn(self, pre: str) -> bytes:
        """A pre-token's ids, packed. A whole token is itself; all else is merged."""
        raw = pre.encode()
        whole = self.ranks.get(raw)
        ids = [whole] if whole is not None else [self.rank_of[i] for i in self.model.encode(spell(raw))]
        if -1 in ids:
            raise ValueError(f"the vocabulary lacks a byte of {pre!r}")
        packed = np.array(ids, "<u4").tobytes()
        if len(pre) <= SHORT:
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            self.seen[pre] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        seen, learn = self.seen.get, self._learn
        cut = self.cut if self.beyond(text) else self.plain
        return b"".join([seen(p) or learn(p) for p in cut.findall(text)])

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(packed, "<u4").tolist()))


@cache
def codec(path: str, pattern: str) -> Codec:
    """One for each worker process."""
    return Codec(read_ranks(path), pattern)


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """A row for each row of df: n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids themselves.

    path names a rank file that every executor has; pattern cuts a text into pre-tokens.
    """

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        own = codec(path, pattern)
        n, a, d, packed = [], [], [], []
        raw, at = buffer_of(b.column(1))
        whole = raw.tobytes()
        for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            p = own.encode(whole[i:j].decode())
            n.append(len(p) // 4)
            a.append(hashlib.sha256(p).hexdigest())
            d.append(hashlib.sha256(own.decode(p)).hexdigest())
            if ids:
                packed.append(p)
        cols = [b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())]
        if ids:
            cols.append(pa.array([np.frombuffer(p, "<u4").astype(np.int32) for p in packed], pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(cols, names=["id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(cols)])

    source = only(df, id_col, text_col, text=text_col)
    kind = source.schema[0].dataType.simpleString()
    return mapped(source, run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{', ids array<int>' if ids else ''}").withColumnRenamed("id", id_col)


def decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Texts from ids; bytes that aren't UTF-8 become replacement characters. Null ids give a null text."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        own = codec(path, pattern)
        texts = [None if x is None else own.decode(np.array(x, "<u4").tobytes()).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    source = df.select(id_col, ids_col)
    return mapped(source, run, f"id {source.schema[0].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)


def digest(df: DataFrame) -> DataFrame:
    """The columns of query op6, with the public multilingual vocabulary."""
    import public_tokenizers

    return encode(df, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ids=False)
