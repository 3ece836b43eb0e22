"""Approximate nearest neighbours by robust-pruned directed graphs, one for each shard.

Rows are dealt to shards of about `shard_rows` by a hash of their id. In a shard, greedy searches of the graph so far propose
neighbours for the next batch of rows; relaxed distance pruning keeps those that no kept one is much closer to
(d(kept, c) * alpha <= d(row, c) drops c), so edges stay diverse; each kept neighbour gets an edge back, pruned in turn.
Queries go in blocks to every shard, are answered there by beam search from many entry points, and the best of all shards stay.

A node is a direction, to about a millionth; it names its rows (of those with the same direction to the last bit the smallest
ids, as many as an answer can name), and all rows of all nodes that the beam ends with are ranked by their exact cosines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotscope.operators.store import lean, written
from lotscope.llm.vectors import rows, units

_INDEX = "shard long, dim int, first binary, edges binary, vectors binary, ids binary, starts binary"
#: Query blocks that one task answers from a shard.
_TURN = 32


def beam_search(x: np.ndarray, edges: np.ndarray, starts: np.ndarray, q: np.ndarray, beam: int, wide: int = 4) -> tuple[np.ndarray, np.ndarray, float]:
    """Ids and similarities of the `beam` best nodes found for each row of q, best first (-1 where there are fewer), and the share of all nodes that a row is compared with."""
    n, r = edges.shape
    m = len(q)
    seen = np.zeros((m, n), bool)
    first = q @ x[starts].T
    take = min(beam, len(starts))
    top = np.argpartition(-first, take - 1, axis=1)[:, :take]
    ids = np.full((m, beam), -1, np.int32)
    sims = np.full((m, beam), -np.inf, np.float32)
    ids[:, :take], sims[:, :take] = starts[top], np.take_along_axis(first, top, 1)
    seen[:, starts] = True
    order = np.argsort(-sims, axis=1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    fresh = ids >= 0
    live = np.arange(m)
    while len(live):
        some = fresh[live]
        nth = np.cumsum(some, axis=1)
        pick = some & (nth <= wide)
        row, col = np.nonzero(pick)
        slot = nth[row, col] - 1
        at = np.full((len(live), wide), -1, np.int64)
        at[row, slot] = ids[live[row], col]
        fresh[live[row], col] = False
        near = edges[at]
        near[at < 0] = -1
        for w in range(wide):
            nb = near[:, w]
            old = (nb < 0) | seen[live[:, None], nb]
            seen[live[:, None], np.where(nb < 0, 0, nb)] |= nb >= 0
            nb[old] = -1
        near = near.reshape(len(live), -1)
        got = np.matmul(x[near], q[live][:, :, None])[:, :, 0]
        got[near < 0] = -np.inf
        both_s = np.concatenate([sims[live], got], axis=1)
        both_i = np.concatenate([ids[live], near], axis=1)
        both_f = np.concatenate([fresh[live], near >= 0], axis=1)
        keep = np.argpartition(-both_s, beam - 1, axis=1)[:, :beam]
        s = np.take_along_axis(both_s, keep, 1)
        order = np.argsort(-s, axis=1, kind="stable")
        keep = np.take_along_axis(keep, order, 1)
        sims[live], ids[live], fresh[live] = np.take_along_axis(both_s, keep, 1), np.take_along_axis(both_i, keep, 1), np.take_along_axis(both_f, keep, 1)
        live = live[fresh[live].any(axis=1)]
    return ids, sims, float(seen.mean()) if seen.size else 0.0


def prune(x: np.ndarray, p: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each row p of x, up to `degree` of its candidates (-1 is none), by relaxed distance pruning."""
    cand = np.where(cand == p[:, None], -1, cand)
    v = x[cand]
    s = np.matmul(v, x[p][:, :, None])[:, :, 0]
    s[cand < 0] = -np.inf
    order = np.argsort(-s, axis=1, kind="stable")
    cand, s = np.take_along_axis(cand, order, 1), np.take_along_axis(s, order, 1)
    v = x[cand]
    apart = np.maximum(0, 2 - 2 * np.matmul(v, v.transpose(0, 2, 1)))
    own = np.maximum(0, 2 - 2 * s)
    live = cand >= 0
    live[:, 1:] &= cand[:, 1:] != cand[:, :-1]
    kept = np.full((len(p), degree), -1, np.int32)
    at = np.arange(len(p))
    for k in range(degree):
        best = live.argmax(axis=1)
        some = live[at, best]
        if not some.any():
            break
        kept[some, k] = cand[some, best[some]]
        live &= ~(alpha * alpha * apart[at, best] <= own) | ~some[:, None]
        live[at, best] = False
    return kept


def build(x: np.ndarray, degree: int, beam: int, alpha: float, entries: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (row, degree) of a graph over the unit vectors x, -1 where there are fewer, and its entry points."""
    n = len(x)
    order = np.random.default_rng(seed).permutation(n).astype(np.int32)
    edges = np.full((n + 1, degree), -1, np.int32)[:n]
    done = min(n, 2 * degree)
    head = order[:done]
    edges[head] = prune(x, head, np.broadcast_to(head, (done, done)), degree, alpha)
    while done < n:
        batch = order[done : done + max(64, min(512, done))]
        starts = order[: min(done, entries)]
        found, _, _ = beam_search(x, edges, starts, x[batch], beam)
        edges[batch] = prune(x, batch, found, degree, alpha)
        done += len(batch)
        # Edges back: every kept neighbour hears of the new row.
        src = np.repeat(batch, degree)
        dst = edges[batch].ravel()
        ok = dst >= 0
        src, dst = src[ok], dst[ok]
        o = np.argsort(dst, kind="stable")
        src, dst = src[o], dst[o]
        who, at, many = np.unique(dst, return_index=True, return_counts=True)
        for lo in range(0, len(who), 512):
            w, a, c = who[lo : lo + 512], at[lo : lo + 512], many[lo : lo + 512]
            new = np.full((len(w), min(2 * degree, c.max())), -1, np.int32)
            for j in range(new.shape[1]):
                has = c > j
                new[has, j] = src[a[has] + j]
            room = np.concatenate([edges[w], new], axis=1)
            over = (room >= 0).sum(axis=1) > degree
            if over.any():
                edges[w[over]] = prune(x, w[over], room[over], degree, alpha)
            if (~over).any():
                r = room[~over]
                edges[w[~over]] = np.take_along_axis(r, np.argsort(r < 0, axis=1, kind="stable"), 1)[:, :degree]
    return edges, order[: min(n, entries)]


def nodes_of(x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows that an index keeps, in order of node, and where each node's rows begin: of rows of one direction to the last bit the k + 1 smallest ids."""
    u = units(x) + 0.0  # so that -0.0 equals 0.0
    kind = lambda v: np.unique(np.ascontiguousarray(v).view(np.dtype((np.void, v.dtype.itemsize * v.shape[1]))).ravel(), return_inverse=True)[1]
    exact, node = kind(u), kind(np.rint(u * (1 << 20)).astype(np.int32))
    order = np.lexsort((ids, exact))
    e = exact[order]
    cut = np.flatnonzero(np.concatenate([[True], e[1:] != e[:-1]]))
    nth = np.arange(len(e)) - np.repeat(cut, np.diff(np.append(cut, len(e))))
    again = np.concatenate([[False], (e[1:] == e[:-1]) & (ids[order][1:] == ids[order][:-1])])
    nth -= np.cumsum(again) - np.repeat(np.cumsum(again)[cut] - again[cut], np.diff(np.append(cut, len(e))))
    kept = order[(nth <= k) & ~again]
    kept = kept[np.lexsort((ids[kept], exact[kept], node[kept]))]
    n = node[kept]
    return kept, np.flatnonzero(np.concatenate([[True], n[1:] != n[:-1]]))


def _grouped(key: str, make):
    """Runs `make` on the rows of each value of the column `key`, by which rows are sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            of = batch.column(key).to_numpy()
            edge = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                if a == b:
                    continue
                if of[a] != now and held:
                    yield make(now, pa.Table.from_batches(held).combine_chunks())
                    held = []
                now = int(of[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield make(now, pa.Table.from_batches(held).combine_chunks())

    return run


def index(vectors: DataFrame, id_col: str, vec_col: str, shards: int, k: int, degree: int, beam: int, alpha: float, entries: int) -> DataFrame:
    """One row for each shard and dimension: rows by node, edges and entry points."""

    def made(shard: int, t: pa.Table) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in range(7)]
        for d, (ids, x) in rows(t.column("id").combine_chunks(), t.column("vec").combine_chunks()).items():
            kept, first = nodes_of(x, ids, k)
            edges, starts = build(units(x[kept[first]]).astype(np.float32), degree, beam, alpha, entries, shard)
            for c, v in zip(cols, (shard, d, first.tobytes(), edges.tobytes(), x[kept].tobytes(), ids[kept].tobytes(), starts.tobytes()), strict=True):
                c.append(v)
        kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 5]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [f.split()[0] for f in _INDEX.split(", ")])

    dealt = vectors.select(F.pmod(F.xxhash64(id_col), F.lit(shards)).alias("shard"), F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).where("id is not null and vec is not null")
    return dealt.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(lean(_grouped("shard", made)), _INDEX)


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", shard_rows: int = 16384, degree: int = 32, build_beam: int = 64, beam: int = 48, alpha: float = 1.2, entries: int = 64, block_rows: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of `vectors` nearest to each row of `queries` by cosine, except the row of the query's own id.

    Ties go to the smaller id; scores are cosines of the original vectors in double precision. Vectors that are null, zero or
    hold null or non-finite numbers take no part, nor do null ids; rows that share an id count as one if their vectors are equal, and the
    best of them answers otherwise; of queries that share an id one is asked. Vectors are only compared with those of the same dimension.
    Other columns are ignored. Empty tables give an empty result, a single row no neighbours.
    """
    total = vectors.count()
    asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).where("id is not null and vec is not null").dropDuplicates(["id"])
    shards, blocks = max(1, -(-total // shard_rows)), max(1, -(-asked.count() // block_rows))
    table = written(index(vectors, id_col, vec_col, shards, k, degree, build_beam, alpha, entries), "index")

    def packed(block: int, t: pa.Table) -> pa.RecordBatch:
        got = rows(t.column("id").combine_chunks(), t.column("vec").combine_chunks())
        return pa.RecordBatch.from_arrays([pa.array([block] * len(got), pa.int64()), pa.array(list(got), pa.int32()), pa.array([x.tobytes() for _, x in got.values()], pa.binary()), pa.array([i.tobytes() for i, _ in got.values()], pa.binary())], ["block", "dim", "vectors", "ids"])

    asked = asked.select(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).alias("block"), "id", "vec")
    asked = written(asked.repartition(blocks, "block").sortWithinPartitions("block").mapInArrow(lean(_grouped("block", packed)), "block long, dim int, vectors binary, ids binary"), "queries")
    # A turn of a shard is read as a stream, its index first: that is held once, whatever the number of queries.
    turns = -(-blocks // _TURN)
    none = F.lit(None).cast("binary")
    ours = table.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(turns - 1).cast("long"))).alias("turn"), F.lit(0).alias("role"), "dim", "vectors", "ids", "first", "edges", "starts")
    theirs = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.expr(f"block div {_TURN}").alias("turn"), F.lit(1).alias("role"), "dim", "vectors", "ids", none.alias("first"), none.alias("edges"), none.alias("starts"))
    sent = ours.union(theirs).repartition(shards * turns, "shard", "turn").sortWithinPartitions("shard", "turn", "role")

    def answers(known: tuple, q: np.ndarray, qids: np.ndarray) -> pa.RecordBatch:
        u, small, first, edges, starts, ids = known
        uq = units(q)
        found, _, _ = beam_search(small, edges, starts, uq.astype(np.float32), beam)
        ends = np.append(first[1:], len(ids))
        a, b, c = [], [], []
        for i, near in enumerate(found):
            near = near[near >= 0]
            many = ends[near] - first[near]
            at = np.repeat(first[near] - np.cumsum(many) + many, many) + np.arange(many.sum())
            at = at[ids[at] != qids[i]]
            score = u[at] @ uq[i] if len(at) < 2 else np.einsum("ij,j->i", u[at], uq[i])
            best = at[o := np.lexsort((ids[at], -score))[: 2 * k]]
            a.append(np.full(len(best), qids[i])), b.append(ids[best]), c.append(score[o])
        flat = [np.concatenate(x) if x else np.zeros(0) for x in (a, b, c)]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(flat, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "score"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known = None, {}
        for batch in batches:
            for r in range(batch.num_rows):
                row = {n: batch.column(n)[r].as_py() for n in batch.schema.names}
                d = row["dim"]
                if (row["shard"], row["turn"]) != now:
                    now, known = (row["shard"], row["turn"]), {}
                x = np.frombuffer(row["vectors"], np.float64).reshape(-1, d)
                ids = np.frombuffer(row["ids"], np.int64)
                if row["role"] == 0:
                    first, u = np.frombuffer(row["first"], np.int64), units(x)
                    known[d] = u, u[first].astype(np.float32), first, np.frombuffer(row["edges"], np.int32).reshape(-1, degree), np.frombuffer(row["starts"], np.int32), ids
                elif d in known:
                    yield answers(known[d], x, ids)

    best = sent.mapInArrow(lean(search), "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
