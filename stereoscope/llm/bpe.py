"""Byte-level BPE encoding and decoding.

The vocabulary's tokens, as Latin-1 strings of their bytes, are the keys of a pyahocorasick automaton. A
piece is encoded from its start by the longest token that matches and may follow the token before; where
no token fits, the last one is taken back for the next shorter one. Two tokens may stand side by side
exactly if the merges of their joined bytes give just these two again; that answer is kept per pair. A
list of tokens is what the merges give exactly if this holds for every neighbouring pair. So the tokens
up to a given byte are the only ones possible there, a byte that led nowhere is never tried again, and
the exact encoding is found in time linear in the piece.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import fresh, slices, text_or_empty, worker_state
from .units import UnitCache

# what a worker keeps: at most 2 x 2 x UNITS_KEPT units (about 200 bytes each) and so many pairs; an executor holds several workers
PAIRS_KEPT = 250_000
UNITS_KEPT = 100_000


class ByteBPE:
    """Encoder and decoder for a rank file (lines of base64 token and rank).

    ``pattern`` cuts a text into pieces; each is encoded separately and there are no special tokens.
    """

    def __init__(self, rank_file: bytes, pattern: str):
        import ahocorasick
        import regex

        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines()) if a}
        self.bytes_of = {i: t for t, i in self.ranks.items()}
        self.find = regex.compile(pattern).findall
        self.found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.id_of = {t.decode("latin-1"): i for t, i in self.ranks.items()}
        for token, i in self.id_of.items():
            self.found.add_word(token, i)
        self.found.make_automaton()
        self.longest = max(map(len, self.id_of))
        self.span = max(self.bytes_of) + 1
        self.fits: dict[int, bool] = {}  # (left + 1) * span + right
        self.cache = UnitCache(self._encode_unit, self._encode_piece, UNITS_KEPT)

    def merged(self, piece: bytes) -> list[int]:
        """The merges done one by one, lowest rank first: the definition, for short byte strings."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[k] + parts[k + 1], 1 << 60), k) for k in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def side_by_side(self, left: int, right: int) -> bool:
        """Whether ``right`` may follow ``left``; -1 stands for the start of the piece."""
        before = [] if left < 0 else [left]
        fits = self.merged((self.bytes_of[left] if before else b"") + self.bytes_of[right]) == [*before, right]
        if len(self.fits) >= PAIRS_KEPT:
            self.fits.clear()
        self.fits[(left + 1) * self.span + right] = fits
        return fits

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        text, size = piece.decode("latin-1"), len(piece)
        id_of, known, span, reach = self.id_of.get, self.fits.get, self.span, self.found.longest_prefix
        out, ends, dead = [], [0], set()  # tokens so far; where each begins; bytes that led nowhere
        left, at, n = -1, 0, reach(text[: self.longest])
        while at < size:
            while n:
                token = id_of(text[at : at + n])
                if token is not None and at + n not in dead:
                    fits = known((left + 1) * span + token)
                    if self.side_by_side(left, token) if fits is None else fits:
                        break
                n -= 1
            if n:
                out.append(token)
                left, at = token, at + n
                ends.append(at)
                n = reach(text[at : at + self.longest])
            else:
                dead.add(at)
                out.pop()
                n = ends.pop() - ends[-1] - 1
                left, at = out[-1] if out else -1, ends[-1]
        return out

    def _encode_piece(self, piece: str) -> bytes:
        return array("I", self.encode_piece(piece.encode("utf-8", "replace"))).tobytes()

    def _encode_unit(self, unit: str) -> bytes:
        return b"".join(map(self._encode_piece, self.find(unit)))

    def encode(self, text: str) -> array:
        ids = array("I")
        ids.frombytes(self.cache.text(text))
        return ids

    def decode(self, ids) -> bytes:
        """The bytes of the ids; an id outside the vocabulary raises KeyError."""
        return b"".join(map(self.bytes_of.__getitem__, ids))


def codec(rank_file: bytes, pattern: str) -> ByteBPE:
    """One per worker process and vocabulary."""
    state = worker_state("bpe")
    key = ("bpe", hash((rank_file, pattern)))
    if key not in state:
        state[key] = ByteBPE(rank_file, pattern)
    return state[key]


def token_bytes(rank_file: bytes) -> dict[int, bytes]:
    """Decoder: id -> bytes; one per worker process."""
    state = worker_state("bpe")
    key = ("token bytes", hash(rank_file))
    if key not in state:
        state[key] = {int(b): base64.b64decode(a) for a, b in map(bytes.split, rank_file.splitlines()) if a}
    return state[key]


def _ranks(df: DataFrame, rank_path: str):
    """The rank file, read on the driver (its size does not grow with the data) and sent to the workers."""
    with open(rank_path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encoded(docs: DataFrame, rank_path: str, pattern: str, text_col: str = "text", out: str = "ids", decoded_out: str | None = None,
            keep_text: bool = True) -> DataFrame:
    """``docs`` plus ``out``: the token ids of the text as array<int>. A null text has none.

    ``decoded_out`` names a column for the bytes that the ids decode to, made in the same pass;
    ``keep_text=False`` leaves the text out.
    """
    ranks = _ranks(docs, rank_path)
    names = [c for c in docs.columns if c not in (out, decoded_out, *([] if keep_text else [text_col]))]
    text = fresh(docs, "_text")
    frame = docs.select(*names, text_or_empty(text_col).alias(text))
    schema = docs.select(*names).schema.add(out, T.ArrayType(T.IntegerType()))
    schema = schema.add(decoded_out, T.BinaryType()) if decoded_out else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        bpe = codec(ranks.value, pattern)
        for batch in slices(batches):
            packed = [bpe.cache.text(t) for t in batch.column(text).to_pylist()]
            offsets = np.concatenate(([0], np.cumsum([len(p) // 4 for p in packed], dtype=np.int64))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), dtype="<i4")))
            more = [pa.array([bpe.decode(array("I", p)) for p in packed], pa.binary())] if decoded_out else []
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), lists, *more], names=[*names, out, *([decoded_out] if decoded_out else [])])

    return frame.mapInArrow(run, schema)


def decoded(df: DataFrame, rank_path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` plus ``out``: the bytes that the ids stand for. Null ids give empty bytes."""
    ranks = _ranks(df, rank_path)
    names = [c for c in df.columns if c != out]
    schema = df.select(*names).schema.add(out, T.BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = token_bytes(ranks.value)
        for batch in slices(batches):
            texts = [b"".join(map(known.__getitem__, ids or ())) for ids in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(texts, pa.binary())], names=[*names, out])

    return df.select(*names).mapInArrow(run, schema)
