"""Words, word hashes and window hashes of whole texts, computed on Arrow buffers with numpy.

A word is `[^\\x20\\x09-\\x0D]+`. Everything works on the UTF-8 bytes of a batch at once, in pieces of about
PIECE bytes (a longer text is a piece of its own), so memory follows the piece and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotscope.operators.store import lean

PIECE = 1 << 19
U = np.uint64

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_RANDOM = np.random.default_rng(20240611)
_BYTE = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = int(_RANDOM.integers(0, 2**63, dtype=np.uint64)) * 2 + 1
MIX = _RANDOM.integers(0, 2**63, 64, dtype=np.uint64) * U(2) + U(1)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64 bits, so that every bit of the result depends on every bit of h."""
    h = h ^ (h >> U(32))
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    h *= U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


@lru_cache(8)
def powers(base: int, room: int) -> tuple[np.ndarray, np.ndarray]:
    """base^0..base^room and their inverses modulo 2^64 (base is odd)."""

    def of(x: int) -> np.ndarray:
        out = np.full(room + 1, x, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return of(base), of(pow(base, -1, 2**64))


def room_for(n: int) -> int:
    return max(2 * PIECE, 1 << int(n).bit_length())


def prefix(values: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums P of values[i] * base^i modulo 2^64, and the inverse powers: the hash of [a, b) is (P[b] - P[a]) * inverse[a]."""
    up, down = powers(base, room_for(len(values)))
    p = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=p[1:])
    return p, down


class Piece:
    """Some consecutive texts of a batch: `lo`..`hi` are their rows; text t is bytes cuts[t]..cuts[t + 1], its words k in first[t]..first[t + 1] are bytes start[k]..end[k]."""

    __slots__ = ("lo", "hi", "bytes", "cuts", "start", "end", "first")

    def __init__(self, lo: int, hi: int, raw: np.ndarray, cuts: np.ndarray):
        self.lo, self.hi, self.bytes, self.cuts = lo, hi, raw, cuts
        ink = ~_SPACE[raw]
        opens, closes = ink.copy(), ink.copy()
        opens[1:] &= ~ink[:-1]
        closes[:-1] &= ~ink[1:]
        inner = cuts[(cuts > 0) & (cuts < len(raw))]
        opens[inner] = ink[inner]
        closes[inner - 1] = ink[inner - 1]
        self.start = np.flatnonzero(opens)
        self.end = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, cuts)

    def word_hashes(self, fold: bool) -> np.ndarray:
        """A 64-bit hash of each word; with `fold`, A-Z count as a-z."""
        raw = _FOLD[self.bytes] if fold else self.bytes
        p, down = prefix(_BYTE[raw], _BASE)
        h = (p[self.end] - p[self.start]) * down[self.start]
        return mixed(h + (self.end - self.start).astype(np.uint64) * MIX[0])

    def words(self, t: int) -> list[bytes]:
        a, b = self.first[t], self.first[t + 1]
        if a == b:
            return []
        return bytes(self.bytes[self.start[a] : self.end[b - 1]]).split()


def pieces(texts: pa.Array) -> Iterator[Piece]:
    """Pieces of an Arrow string column, in order; a null text has no words."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    _, at, data = texts.buffers()
    cuts = np.frombuffer(at, np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(cuts, cuts[lo] + PIECE, "right")) - 1)
        hi = min(hi, n)
        yield Piece(lo, hi, raw[cuts[lo] : cuts[hi]], cuts[lo : hi + 1] - cuts[lo])
        lo = hi


def shingle_sets(piece: Piece, k: int) -> list[np.ndarray]:
    """For each text the sorted hashes of its distinct k-word shingles (A-Z folded); of a text with fewer words, one hash of all; none without words."""
    w = piece.word_hashes(fold=True)
    m = len(w) - k + 1
    s = np.zeros(max(0, m), np.uint64)
    for j in range(k):
        s += w[j : j + len(s)] * MIX[j + 1]
    s = mixed(s)
    out = []
    for t in range(piece.hi - piece.lo):
        a, b = int(piece.first[t]), int(piece.first[t + 1])
        if b - a >= k:
            x = np.sort(s[a : b - k + 1])
            if len(x) > 1:
                new = np.empty(len(x), bool)
                new[0] = True
                np.not_equal(x[1:], x[:-1], out=new[1:])
                x = x[new]
        elif b > a:
            x = mixed(np.sum(w[a:b] * MIX[1 : b - a + 1], keepdims=True) + np.full(1, b - a, np.uint64) * MIX[40])
        else:
            x = np.zeros(0, np.uint64)
        out.append(x)
    return out


def digest(hashes: np.ndarray) -> int:
    """A 64-bit digest of a sequence of hashes, as a signed integer."""
    p = mixed(hashes + MIX[50] * np.arange(1, len(hashes) + 1, dtype=np.uint64))
    return int(mixed(np.sum(p, keepdims=True) + np.full(1, len(hashes), np.uint64)).view(np.int64)[0])


def zipped(df: DataFrame) -> DataFrame:
    """`df` with its last column, text, as body: whole texts compressed one by one, for texts that must travel. A null text has a null body."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3, write_content_size=True)
        for batch in batches:
            packed = [None if x is None else press.compress(x) for x in batch.columns[-1].cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(packed, pa.binary())], [*batch.schema.names[:-1], "body"])

    schema = T.StructType([*df.schema.fields[:-1], T.StructField("body", T.BinaryType())])
    return df.mapInArrow(lean(run), schema)


def unzipped(body: pa.Array) -> pa.Array:
    open_ = zstandard.ZstdDecompressor()
    return pa.array([None if x is None else open_.decompress(x) for x in body.to_pylist()], pa.large_binary()).cast(pa.large_string())


def bodies(docs: DataFrame) -> DataFrame:
    """(doc_id, body) of each row."""
    return zipped(docs.select(F.col("doc_id").cast("long"), "text"))


def texts_of(batch: pa.RecordBatch) -> pa.Array:
    """The texts of a batch, from its column text or body."""
    return batch.column("text") if "text" in batch.schema.names else unzipped(batch.column("body"))
