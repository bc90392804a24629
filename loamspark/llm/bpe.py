"""Byte-level BPE by prefix dynamic programming.

A vocabulary of ranked byte strings has, for every byte prefix of a piece, exactly one token that can end that
prefix's encoding. Storing it per prefix gives the encoding by tracing back, makes appending exact and lets an
edit recompute only as far as the stored tokens change.
"""

from __future__ import annotations

import base64
import functools
import struct

import ahocorasick
import numpy as np
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamspark.llm.common import read, with_arrow_columns

DEFAULT_VOCABULARY = "byte_bpe_50k.tiktoken"
CACHED_PIECES = 250_000
CACHED_PAIRS = 400_000


class Vocabulary:
    """Ranked tokens and the rule which two may stand next to each other in an encoding."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ids = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        #: Finds all tokens that end at each byte (bytes as characters 0 to 255).
        self.matches = ahocorasick.Automaton()
        for b, i in ranks.items():
            self.matches.add_word(b.decode("latin-1"), (i, len(b)))
        self.matches.make_automaton()
        self._halves: dict[bytes, tuple[bytes, bytes] | None] = {}
        self._left: dict[int, list] = {}
        self._right: dict[int, list] = {}
        self._fits: dict[int, bool] = {}

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})

    def halves(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two parts whose merge makes the token last; None for a single byte or a token that merging never makes."""
        if token not in self._halves:
            parts, found = [token[i : i + 1] for i in range(len(token))], None
            while len(parts) > 2:
                rank, i = min((self.ids.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
                if rank == 1 << 60:
                    break
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            if len(parts) == 2:
                found = (parts[0], parts[1])
            self._halves[token] = found
        return self._halves[token]

    def _spine(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """Parts of the token that touch its left (0) or right (1) edge while it is built, each with the rank that absorbs it."""
        piece, until, out = self.bytes_of[token], 1 << 60, []
        while True:
            out.append((piece, until))
            if len(piece) == 1 or (parts := self.halves(piece)) is None:
                return out
            until, piece = self.ids[piece], parts[side]

    def fits(self, a: int, b: int) -> bool:
        """Whether b may follow a: no merge across their border comes before the merges that absorb the parts at it."""
        key = a << 32 | b
        known = self._fits.get(key)
        if known is None and len(self.bytes_of[b]) > 1 and self.halves(self.bytes_of[b]) is None:
            known = self._fits[key] = False
        if known is None:
            if a not in self._right:
                self._right[a] = self._spine(a, 1)
            if b not in self._left:
                self._left[b] = self._spine(b, 0)
            known = not any(
                (rank := self.ids.get(x + y)) is not None and rank < x_until and rank <= y_until
                for x, x_until in self._right[a]
                for y, y_until in self._left[b]
            )
            if len(self._fits) >= CACHED_PAIRS:
                self._fits.clear()
            self._fits[key] = known
        return known

    def extend(self, piece: bytes, last: list[int], upto: int) -> None:
        """Append to last the unique valid last token of each prefix of piece from len(last)+1 to upto bytes."""
        known, done = self._fits, len(last)
        for end, (token, size) in self.matches.iter(piece[:upto].decode("latin-1"), max(0, done + 1 - self.longest)):
            if end < done:
                continue
            if end > done:
                raise ValueError("the vocabulary lacks a byte")
            if end >= size:
                before = last[end - size]
                ok = known.get(before << 32 | token)
                if not (self.fits(before, token) if ok is None else ok):
                    continue
            elif size > 1 and self.halves(piece[:size]) is None:
                continue
            last.append(token)
            done += 1

    def trace(self, last: list[int]) -> list[int]:
        out, at = [], len(last)
        while at:
            token = last[at - 1]
            out.append(token)
            at -= len(self.bytes_of[token])
        out.reverse()
        return out

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ids.get(piece)
        if whole is not None:
            return [whole]
        last: list[int] = []
        self.extend(piece, last, len(piece))
        return self.trace(last)


class Prefixes:
    """The stored last tokens of one piece; append and replace keep them exact."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b""):
        self.vocabulary, self.piece, self.last, self.recomputed = vocabulary, b"", [], 0
        self.append(piece)

    def append(self, more: bytes) -> None:
        self.piece += more
        self.vocabulary.extend(self.piece, self.last, len(self.piece))

    def replace(self, start: int, end: int, new: bytes) -> None:
        """Replace bytes start to end; tokens are recomputed until as many as the longest token's bytes agree with the stored ones."""
        old, shift = self.last, len(new) - (end - start)
        self.piece = self.piece[:start] + new + self.piece[end:]
        last, same, self.recomputed = old[:start], 0, 0
        while len(last) < len(self.piece) and same < self.vocabulary.longest:
            self.vocabulary.extend(self.piece, last, len(last) + 1)
            self.recomputed += 1
            at = len(last) - 1 - shift
            same = same + 1 if len(last) > start + len(new) and last[-1] == old[at] else 0
        self.last = last + old[len(last) - shift :] if len(last) < len(self.piece) else last

    def tokens(self) -> list[int]:
        whole = self.vocabulary.ids.get(self.piece)
        return [whole] if whole is not None else self.vocabulary.trace(self.last)


def packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class Encoder:
    """Whole texts: each match of the pattern is encoded separately, pieces seen before come from a bounded cache."""

    def __init__(self, vocabulary: Vocabulary, pattern: str = public_tokenizers.PATTERN):
        self.vocabulary = vocabulary
        self.find = regex.compile(pattern).findall
        outer = self

        class Pieces(dict):
            def __missing__(self, piece: str) -> bytes:
                found = packed(outer.vocabulary.encode_piece(piece.encode("utf-8", "replace")))
                if len(piece) <= 64:
                    if len(self) >= CACHED_PIECES:
                        self.clear()
                    self[piece] = found
                return found

        class Counts(dict):
            def __missing__(self, piece: str) -> int:
                found = len(outer.pieces[piece]) // 4
                if len(piece) <= 64:
                    if len(self) >= CACHED_PIECES:
                        self.clear()
                    self[piece] = found
                return found

        self.pieces, self.counts = Pieces(), Counts()

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.pieces.__getitem__, self.find(text or "")))

    def count(self, text: str | None) -> int:
        return sum(map(self.counts.__getitem__, self.find(text or "")))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder per Python process and vocabulary file."""
    return Encoder(Vocabulary.load(path))


def vocabulary_path(path: str | None) -> str:
    return path or public_tokenizers.path(DEFAULT_VOCABULARY)


def encode(docs: DataFrame, text: str = "text", path: str | None = None, decode: bool = False) -> DataFrame:
    """docs with n_tokens (long) and token_ids (binary, little-endian unsigned 32-bit ids) of each whole text.

    With decode, decoded (binary) holds the bytes that the ids give back. A null text counts as empty: no ids.
    Columns of these names that docs already has are replaced; all others pass through; repeated rows stay.
    """
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("token_ids", T.BinaryType())]
    fields += [T.StructField("decoded", T.BinaryType())] * decode

    def make():
        enc = encoder(vocabulary_path(path))

        def work(texts: list) -> list:
            ids = [enc.encode(x) for x in texts]
            return [[len(x) // 4 for x in ids], ids] + ([[enc.decode(x) for x in ids]] if decode else [])

        return work

    return with_arrow_columns(docs, text, fields, make)


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = encode(read(spark, sf_dir, "documents").select("doc_id", "text"), decode=True)
    return docs.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
