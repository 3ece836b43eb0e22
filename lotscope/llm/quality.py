"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader.

Tokens are runs of word characters (A-Z folded) and runs of symbols. Features are the hashed n-grams of tokens and of
token shapes (lower, capital, upper, mixed, digits, or the symbols themselves), as shares of the document's tokens. A
score is the sparse dot product of these shares with the weights; it's computed as sums over the whole text,
without ever building the vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotscope.llm.sample import labelled
from lotscope.operators.store import lean
from lotscope.llm.words import _BASE, _BYTE, _FOLD, MIX, mixed, pieces, prefix

#: A document's shares sum to this in each family of features.
SCALE = 10.0
_KIND = np.full(256, 2, np.uint8)  # 0 space, 1 symbol, 2 word
_KIND[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = 1
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_UPPER = np.zeros(256, np.int32)
_UPPER[65:91] = 1
_DIGIT = np.zeros(256, np.int32)
_DIGIT[48:58] = 1


def features(piece, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of every token of a piece, (tokens, families), and where each text's tokens begin and end."""
    raw = piece.bytes
    kind = _KIND[raw]
    edge = np.ones(len(raw) + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[piece.cuts] = True
    at = np.flatnonzero(edge)
    start, end = at[:-1], at[1:]
    ink = kind[start] > 0 if len(start) else np.zeros(0, bool)
    start, end = start[ink], end[ink]
    first = np.searchsorted(start, piece.cuts)
    word = kind[start] == 2
    p, down = prefix(_BYTE[_FOLD[raw]], _BASE)
    h = mixed((p[end] - p[start]) * down[start] + (end - start).astype(np.uint64) * MIX[2])
    n = end - start
    up = np.concatenate([[0], np.cumsum(_UPPER[raw])])
    dig = np.concatenate([[0], np.cumsum(_DIGIT[raw])])
    ups, digs = up[end] - up[start], dig[end] - dig[start]
    heads = _UPPER[raw[start]] if len(start) else ups
    shape = np.where(digs > 0, 4, np.where(ups == 0, 0, np.where((ups == 1) & (heads == 1), 1, np.where(ups * 2 > n, 2, 3)))).astype(np.uint64)
    s = np.where(word, mixed(shape + MIX[3]), h)
    out = np.empty((len(h), 5), np.int64)

    def gram(x: np.ndarray, size: int, salt: int) -> np.ndarray:
        y = x * MIX[salt]
        for j in range(1, size):
            y[: len(x) - j] += x[j:] * MIX[salt + j]
        return (mixed(y) % np.uint64(dims)).astype(np.int64)

    for c, (x, size, salt) in enumerate(((h, 1, 10), (h, 2, 12), (s, 1, 16), (s, 2, 18), (s, 3, 21))):
        out[:, c] = gram(x, size, salt) if len(x) else 0
        for j in range(1, size):  # an n-gram that would cross into the next text is its own feature
            last = first[1:] - j
            last = last[last >= first[:-1]]
            out[last, c] = salt
    return out, first


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        """The probability of label 1 for each text."""
        return np.concatenate([_sigmoid(z) for z in self._margins(texts)] or [np.zeros(0)])

    def _margins(self, texts: pa.Array) -> Iterator[np.ndarray]:
        for piece in pieces(texts):
            f, first = features(piece, len(self.weights))
            n = np.diff(first)
            total = np.zeros(len(n))
            if len(f):  # each text is summed by itself, so its score doesn't depend on its neighbours
                total[n > 0] = np.add.reduceat(self.weights[f].sum(axis=1, dtype=np.float64), first[:-1][n > 0])
            yield self.bias + total * (SCALE / np.maximum(n, 1))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(sample: pa.Table, dims: int = 1 << 18, epochs: int = 4, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.2, l2: float = 0.1) -> QualityModel:
    """FTRL-proximal over the sample's documents; without rows of both labels the model gives their share (0.5 without any)."""
    y = sample.column("label").to_numpy().astype(float)
    rows = []
    for piece in pieces(sample.column("text")):
        f, first = features(piece, dims)
        for t in range(piece.hi - piece.lo):
            ids, many = np.unique(f[first[t] : first[t + 1]], return_counts=True)
            rows.append((ids.astype(np.int32), (many * (SCALE / max(1, first[t + 1] - first[t]))).astype(np.float32)))
    base = np.clip(y.mean(), 1e-3, 1 - 1e-3) if len(y) else 0.5
    bias = float(np.log(base / (1 - base)))
    z, g2, zb, gb = np.zeros(dims), np.zeros(dims), 0.0, 0.0
    if len(y) and 0 < y.mean() < 1:
        order = np.random.default_rng(5)
        for _ in range(epochs):
            for i in order.permutation(len(rows)):
                ids, x = rows[i]
                zi = z[ids]
                w = np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(g2[ids])) / alpha + l2))
                wb = -zb / ((beta + np.sqrt(gb)) / alpha)
                miss = _sigmoid(bias + wb + w @ x) - y[i]
                g = miss * x
                step = (np.sqrt(g2[ids] + g * g) - np.sqrt(g2[ids])) / alpha
                z[ids] += g - step * w
                g2[ids] += g * g
                zb += miss - (np.sqrt(gb + miss * miss) - np.sqrt(gb)) / alpha * wb
                gb += miss * miss
    w = np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(g2)) / alpha + l2))
    return QualityModel(w.astype(np.float32), bias - zb / ((beta + np.sqrt(gb)) / alpha))


def train_quality(docs: DataFrame, labels: DataFrame, rows: int = 6000, octets: int = 24 << 20) -> QualityModel:
    """Fit on at most `rows` labelled rows and `octets` bytes of their whole texts, outside the held-out fold."""
    return fit(labelled(docs, labels, "quality", rows, octets))


def score_quality(docs: DataFrame, model: QualityModel, column: str = "quality_score") -> DataFrame:
    """`docs` with the model's score of each whole text in `column`, which replaces one of that name.

    Null and empty texts get the score of no evidence; equal texts get equal scores, whatever stands beside them; rows are kept as they
    are, repeated ones too; an empty table gives an empty result. Texts are read in pieces of a megabyte, a longer one by itself.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(held.value.scores(texts), pa.float64())

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from lean(scores)(batches)

    return docs.withColumn(column, F.arrow_udf(score, "double")("text"))
