"""Toxicity: a convolutional text classifier over hashed word embeddings.

A word's embedding is the sum of rows for the word itself and for two prefixes of it (A-Z folded), all hashed into
one table, so unseen forms of a stem are known by their stem. Filters of several widths run over the words, each keeps its largest response over
the whole text, and a logistic unit weighs these. Trained with numpy on a bounded sample of labelled rows; the gradient of a
maximum reaches one window only, so a step costs little more than reading the texts.

The language of a text is guessed from its function words. Each language has its own threshold, set on rows of the sample that were not
trained on, and the score is shifted so that 0.5 stands for the threshold.
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
from lotscope.llm.words import _BASE, _BYTE, _FOLD, MIX, Piece, mixed, pieces, prefix

# Frequent function words by which a language is guessed.
FUNCTION_WORDS = {
    "en": "the of and to in is that for it was on are as with at by this be from or".split(),
    "fr": "le la les de des du et un une est pour que qui dans sur pas au avec par il".split(),
    "de": "der die das und ist von mit dem den ein eine zu im nicht auf für sich es auch als".split(),
    "es": "el la los las de y que en un una es por con para su del se al lo como".split(),
}
LANGUAGES = [*FUNCTION_WORDS, "other"]
STEMS = (4, 5, 7)  # bytes of the prefixes


def word_ids(piece: Piece, dims: int) -> np.ndarray:
    """Rows of the embedding table for every word: (words, 1 + prefixes)."""
    raw = _FOLD[piece.bytes]
    p, down = prefix(_BYTE[raw], _BASE)
    out = np.empty((len(piece.start), 1 + len(STEMS)), np.int32)
    for c, size in enumerate((None, *STEMS)):
        end = piece.end if size is None else np.minimum(piece.end, piece.start + size)
        h = (p[end] - p[piece.start]) * down[piece.start] + (end - piece.start).astype(np.uint64) * MIX[24 + c]
        out[:, c] = mixed(h + MIX[28 + c]) % np.uint64(dims)
    return out


def language_votes(dims: int) -> np.ndarray:
    """For each row of the table the language whose function words it stands for, or -1; words of several languages count for none."""
    votes = np.full(dims, -1, np.int8)
    for i, words in enumerate(FUNCTION_WORDS.values()):
        for w in words:
            if sum(w in other for other in FUNCTION_WORDS.values()) == 1:
                votes[word_ids(next(pieces(pa.array([w]))), dims)[0, 0]] = i
    return votes


def guess(ids: np.ndarray, first: np.ndarray, votes: np.ndarray) -> np.ndarray:
    """The language of each text, as a place in LANGUAGES: the most votes, the last one without any."""
    v = votes[ids[:, 0]]
    has = np.flatnonzero(v >= 0)
    text = np.searchsorted(first, has, "right") - 1
    n, many = len(first) - 1, len(FUNCTION_WORDS)
    counts = np.bincount(text * many + v[has], minlength=n * many).reshape(n, many)
    return np.where(counts.max(axis=1) > 0, counts.argmax(axis=1), many)


@dataclass
class ToxicityModel:
    table: np.ndarray  # (dims, size)
    filters: list[np.ndarray]  # for each width: (width, size, filters)
    biases: list[np.ndarray]
    weights: np.ndarray
    bias: float
    shift: np.ndarray  # by language

    def pooled(self, ids: np.ndarray, first: np.ndarray, windows: bool = False):
        """The largest response of every filter in each text, at least 0, and with `windows` the word where it starts (-1: none above 0)."""
        x = self.table[ids].sum(axis=1) if len(ids) else np.zeros((0, self.table.shape[1]), np.float32)
        n = len(first) - 1
        outs, wheres = [], []
        full = np.flatnonzero(np.diff(first))
        for f, b in zip(self.filters, self.biases, strict=True):
            r = np.zeros((len(x), f.shape[2]), np.float32)
            m = len(x) - len(f) + 1
            if m > 0:
                y = x[:m] @ f[0] + b
                for j in range(1, len(f)):
                    y += x[j : j + m] @ f[j]
                r[:m] = np.maximum(y, 0, out=y)
                for j in range(1, len(f)):  # windows that would reach into the next text
                    last = first[1:] - j
                    r[last[(last >= first[:-1]) & (last < len(x))]] = 0
            best = np.zeros((n, f.shape[2]), np.float32)
            if len(full):
                best[full] = np.maximum.reduceat(r, first[full], axis=0)
            outs.append(best)
            if windows:
                at = np.full((n, f.shape[2]), -1)
                for t in full:
                    k = r[first[t] : first[t + 1]].argmax(axis=0) + first[t]
                    at[t] = np.where(best[t] > 0, k, -1)
                wheres.append(at)
        return (np.concatenate(outs, axis=1), wheres) if windows else np.concatenate(outs, axis=1)

    def margins(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.pooled(ids, first) @ self.weights + self.bias

    def scores(self, texts: pa.Array, votes: np.ndarray) -> np.ndarray:
        out = [np.zeros(0)]
        for piece in pieces(texts):
            ids = word_ids(piece, len(self.table))
            out.append(_sigmoid(self.margins(ids, piece.first) - self.shift[guess(ids, piece.first, votes)]))
        return np.concatenate(out).astype(float)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _threshold(z: np.ndarray, y: np.ndarray) -> float:
    """The margin that separates best, by F1; between two margins, half way."""
    if not 0 < y.sum() < len(y):
        return 0.0
    o = np.argsort(-z)
    hit = np.cumsum(y[o])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    k = int(np.argmax(f1))
    return float((z[o[k]] + z[o[min(k + 1, len(z) - 1)]]) / 2)


def fit(sample: pa.Table, dims: int = 1 << 16, size: int = 12, filters: int = 12, widths: tuple[int, ...] = (1, 2, 3), epochs: int = 8, rate: float = 0.05, batch: int = 32, scale: float = 0.1, seed: int = 3) -> ToxicityModel:
    """Adam on the logistic loss, classes weighed towards balance; a quarter of the sample sets the thresholds only. Without rows of both labels the model always gives their share (0.5 without any)."""
    y = sample.column("label").to_numpy().astype(np.float32)
    rng = np.random.default_rng(seed)
    draw = lambda *s: (rng.standard_normal(s) * scale).astype(np.float32)
    m = ToxicityModel(draw(dims, size), [draw(w, size, filters) for w in widths], [np.zeros(filters, np.float32) for _ in widths], np.abs(draw(filters * len(widths))) * rng.choice([1, -1], filters * len(widths), p=[0.75, 0.25]).astype(np.float32), 0.0, np.zeros(len(LANGUAGES)))
    if not 0 < y.sum() < len(y):
        share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
        m.weights[:] = 0
        m.bias = float(np.log(share / (1 - share)))
        return m
    docs = []
    for piece in pieces(sample.column("text")):
        ids = word_ids(piece, dims)
        docs += [ids[piece.first[t] : piece.first[t + 1]] for t in range(piece.hi - piece.lo)]
    test = np.zeros(len(y), bool)
    test[rng.permutation(len(y))[: len(y) // 4]] = True
    train = np.flatnonzero(~test)
    heavy = min(8.0, float((1 - y[train]).sum() / max(1.0, y[train].sum()))) ** 0.5
    params = [*m.filters, *m.biases, m.weights]
    moment = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    tm, tv = np.zeros_like(m.table), np.zeros_like(m.table)
    steps = 0
    bm = bv = 0.0
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = rng.permutation(train)
        for lo in range(0, len(order), batch):
            some = order[lo : lo + batch]
            first = np.concatenate([[0], np.cumsum([len(docs[i]) for i in some])])
            ids = np.concatenate([docs[i] for i in some])
            best, at = m.pooled(ids, first, windows=True)
            g = (_sigmoid(best @ m.weights + m.bias) - y[some]) * np.where(y[some] == 1, heavy, 1) / len(some)
            back = g[:, None] * m.weights[None, :]
            grads: list[np.ndarray] = []
            rows, vals = [], []
            bias_grads = []
            for w, f in enumerate(m.filters):
                gf, gb = np.zeros_like(f), np.zeros(filters, np.float32)
                k, c = np.nonzero(at[w] >= 0)
                where = at[w][k, c]
                up = back[k, w * filters + c].astype(np.float32)
                np.add.at(gb, c, up)
                for j in range(len(f)):
                    word = ids[where + j]
                    x = m.table[word].sum(axis=1)
                    np.add.at(gf[j].T, c, up[:, None] * x)
                    rows.append(word)
                    vals.append(np.repeat((up[:, None] * f[j][:, c].T)[:, None, :], word.shape[1], axis=1))
                grads.append(gf)
                bias_grads.append(gb)
            grads += [*bias_grads, (best * g[:, None]).sum(axis=0).astype(np.float32)]
            steps += 1
            fix = np.sqrt(1 - 0.999**steps) / (1 - 0.9**steps)
            for p, gp, (a, b) in zip(params, grads, moment, strict=True):
                a += 0.1 * (gp - a)
                b += 0.001 * (gp * gp - b)
                p -= step * fix * a / (np.sqrt(b) + 1e-7)
            bm += 0.1 * (g.sum() - bm)
            bv += 0.001 * (g.sum() ** 2 - bv)
            m.bias -= float(step * fix * bm / (np.sqrt(bv) + 1e-7))
            r = np.concatenate([x.ravel() for x in rows])
            if len(r):
                v = np.concatenate([x.reshape(-1, size) for x in vals])
                u, inv = np.unique(r, return_inverse=True)
                gt = np.zeros((len(u), size), np.float32)
                np.add.at(gt, inv, v)
                tm[u] += 0.1 * (gt - tm[u])
                tv[u] += 0.001 * (gt * gt - tv[u])
                m.table[u] -= step * fix * tm[u] / (np.sqrt(tv[u]) + 1e-7)
    votes = language_votes(dims)
    held = np.flatnonzero(test)
    first = np.concatenate([[0], np.cumsum([len(docs[i]) for i in held])])
    z, lang = np.zeros(len(held)), np.zeros(len(held), int)
    for i, h in enumerate(held):
        edge = np.array([0, len(docs[h])])
        z[i] = m.margins(docs[h], edge)[0]
        lang[i] = guess(docs[h], edge, votes)[0]
    overall = _threshold(z, y[held])
    for i in range(len(LANGUAGES)):
        mine = lang == i
        m.shift[i] = _threshold(z[mine], y[held][mine]) if y[held][mine].sum() >= 20 and (1 - y[held][mine]).sum() >= 20 else overall
    return m


def train_toxicity(docs: DataFrame, labels: DataFrame, rows: int = 8000, octets: int = 32 << 20) -> ToxicityModel:
    """Fit on at most `rows` labelled rows and `octets` bytes of their whole texts, outside the held-out fold."""
    return fit(labelled(docs, labels, "toxic", rows, octets))


def score_toxicity(docs: DataFrame, model: ToxicityModel, column: str = "toxicity_score") -> DataFrame:
    """`docs` with the model's score of each whole text in `column`, which replaces one of that name. Null and empty texts get the score of no evidence."""
    held = docs.sparkSession.sparkContext.broadcast((model, language_votes(len(model.table))))

    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model, votes = held.value
        for texts in batches:
            yield pa.array(model.scores(texts, votes), pa.float64())

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from lean(scores)(batches)

    return docs.withColumn(column, F.arrow_udf(score, "double")("text"))
