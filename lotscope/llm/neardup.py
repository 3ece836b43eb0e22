"""Embedding near-dedup by a pivot-permutation index.

Vectors at an angle of at most half the threshold's from one of their own are linked with each other whatever they are, so
they form a ball: a row with its members' number and widest angle, whose inner links need no comparison. Rows are put into balls where they meet: in
the order of the pivots they are nearest to, dealt by ranges so that no key is in one task. Balls (most of them
single vectors) are described by their ordered nearest pivots. Inverted lists, one for each pair of pivots, bring
together balls that share pivots; a list that is long is compared in blocks. Those that share at least `shared`
pivots are verified by the cosine of their centres: far enough apart, no member is linked; near enough, all are; in
between, members are compared one by one, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotscope.operators.components import components
from lotscope.operators.store import lean, written
from lotscope.llm.vectors import rows, units

_ROW = "dim int, id long, perm string, unit binary"


def reference_points(vectors: DataFrame, id_col: str, vec_col: str, many: int) -> dict[int, np.ndarray]:
    """By dimension: `many` unit vectors to describe others by.

    They come from a bounded sample, the 4 * `many` rows first in the order of a hash, without those closer than 0.9 to
    another; where too few remain (small tables, many copies), directions drawn at random fill up.
    """
    some = vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).orderBy(F.xxhash64("id"), "id").limit(4 * many).toArrow()
    out = {}
    for d, (_, x) in rows(some.column("id").combine_chunks(), some.column("vec").combine_chunks()).items():
        u, kept = units(x), []
        for v in u:
            if len(kept) < many and (not kept or np.max(np.stack(kept) @ v) < 0.9):
                kept.append(v)
        fill = units(np.random.default_rng([7, d]).standard_normal((many, d)))
        out[d] = np.concatenate([np.stack(kept), fill])[:many]
    return out


def _nearest(u: np.ndarray, pivots: np.ndarray, m: int) -> np.ndarray:
    s = u @ pivots.T
    m = min(m, s.shape[1])
    near = np.argpartition(-s, m - 1, axis=1)[:, :m]
    return np.take_along_axis(near, np.argsort(-np.take_along_axis(s, near, 1), axis=1, kind="stable"), 1)


def described(vectors: DataFrame, id_col: str, vec_col: str, pivots: Broadcast, prefix: int) -> DataFrame:
    """(dim, id, perm, unit) of every vector that takes part; perm: its nearest pivots in order, as sortable text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, (ids, x) in rows(batch.column(0), batch.column(1)).items():
                u = units(x)
                near = _nearest(u, _known(pivots, d), prefix)
                perm = ["".join(f"{p:05d}" for p in r) for r in near.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([d] * len(ids), pa.int32()), pa.array(ids, pa.int64()), pa.array(perm, pa.string()), pa.array([r.tobytes() for r in u], pa.binary())], ["dim", "id", "perm", "unit"])

    return vectors.select(F.col(id_col).cast("long"), F.col(vec_col)).mapInArrow(lean(run), _ROW)


def _known(pivots: Broadcast, d: int) -> np.ndarray:
    """The reference points; a dimension that the sample has missed gets random ones."""
    if d not in pivots.value:
        pivots.value[d] = units(np.random.default_rng([7, d]).standard_normal((len(next(iter(pivots.value.values()), [0] * 64)), d)))
    return pivots.value[d]


def _units(column: pa.Array, d: int, kind=np.float64) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, d).astype(np.float64)


def _halved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Centres in single precision, to find out which pairs of balls need the members in full."""
    for batch in batches:
        small = [np.frombuffer(x, np.float64).astype(np.float32).tobytes() for x in batch.column("unit").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("dim"), batch.column("ball"), pa.array(small, pa.binary()), batch.column("wide")], batch.schema.names)


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    dims = batch.column("dim").to_numpy()
    for d in np.unique(dims):
        yield int(d), np.flatnonzero(dims == d)


def balls(rows_: DataFrame, half: float) -> DataFrame:
    """(dim, ball, id, unit, angle): each row's ball, named after the row at its centre, and its angle to it.

    Rows are read in stretches of a few thousand, neighbours in the order of their pivots; a stretch gathers around its first
    row, then around the first that is left, and so on, for as long as that gathers any.
    """

    def gather(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(u)
        centre, angle = np.arange(n), np.zeros(n)
        near = u @ u.T >= np.cos(half)
        order = np.argsort(-near.sum(axis=1), kind="stable")
        free = np.ones(n, bool)
        for c in order:
            if free[c]:
                mine = np.flatnonzero(near[c] & free)
                if len(mine) > 1:
                    mine = mine[mine != c]
                    centre[mine] = c
                    angle[mine] = np.arccos(np.clip(u[mine] @ u[c], -1, 1))
                    free[mine] = False
                free[c] = False
        return centre, angle

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                for d, at in _by_dim(part):
                    some = part.take(pa.array(at))
                    u = _units(some.column("unit"), d)
                    ids = some.column("id").to_numpy()
                    centre, angle = gather(u)
                    yield pa.RecordBatch.from_arrays([some.column("dim"), pa.array(ids[centre]), some.column("id"), some.column("unit"), pa.array(angle)], ["dim", "ball", "id", "unit", "angle"])

    return rows_.mapInArrow(lean(run), "dim int, ball long, id long, unit binary, angle double")


def _kinds(a: np.ndarray, b: np.ndarray, ra: np.ndarray, rb: np.ndarray, theta: float) -> tuple[np.ndarray, np.ndarray]:
    """For every pair of centres: may members be linked, are they all. The margin covers single precision."""
    t = np.arccos(np.clip(a @ b.T, -1, 1))
    slack = ra[:, None] + rb[None, :]
    return t - slack <= theta + 1e-4, t + slack <= theta - 1e-4


def ball_pairs(centres: DataFrame, theta: float, pivots: Broadcast, prefix: int, shared: int, block: int) -> DataFrame:
    """(dim, a, b, all) with a < b for balls that may be linked, and whether all their members are. centres: dim, ball, unit, wide (angle)."""

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, at in _by_dim(batch):
                some = batch.take(pa.array(at))
                near = _nearest(_units(some.column("unit"), d), _known(pivots, d), prefix)
                m = near.shape[1]
                i, j = np.triu_indices(m, 1) if m > 1 else (np.array([0]), np.array([0]))
                lo, hi = np.minimum(near[:, i], near[:, j]), np.maximum(near[:, i], near[:, j])
                key = (lo.astype(np.int64) << 32 | hi).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some.column("dim").to_numpy(), len(i)), pa.int32()), pa.array(key), pa.array(np.repeat(some.column("ball").to_numpy(), len(i)))], ["dim", "key", "ball"])

    posted = centres.mapInArrow(lean(lists), "dim int, key long, ball long")
    sizes = written(posted.groupBy("dim", "key").agg(F.count("*").alias("n")).where("n > 1"), "lists")
    # A list of n entries is split into parts of about `block`; entries go to every pair of parts that theirs is in.
    parts = F.ceil(F.col("n") / block).cast("int")
    held = posted.join(sizes, ["dim", "key"]).withColumn("parts", parts).withColumn("p", F.pmod(F.xxhash64("ball"), F.col("parts")).cast("int"))
    sent = held.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("dim", "key", "ball", "p", F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y"))
    full = centres.select("dim", "ball", "unit", "wide").mapInArrow(lean(_halved), "dim int, ball long, unit binary, wide double")
    sent = sent.join(full, ["dim", "ball"])
    sent = sent.select("dim", "key", "x", "y", "p", "ball", "unit", "wide").repartition("dim", "key", "x", "y").sortWithinPartitions("dim", "key", "x", "y")

    def compare(d: int, x: int, y: int, held_: pa.Table) -> pa.RecordBatch | None:
        u, ball, wide, p = _units(held_.column("unit"), d, np.float32), held_.column("ball").to_numpy(), held_.column("wide").to_numpy(), held_.column("p").to_numpy()
        a = np.flatnonzero(p == x)
        b = a if x == y else np.flatnonzero(p == y)
        if not len(a) or not len(b):
            return None
        may, sure = _kinds(u[a], u[b], wide[a], wide[b], theta)
        i, j = np.nonzero(may)
        ok = ball[a[i]] < ball[b[j]] if x == y else ball[a[i]] != ball[b[j]]
        i, j = i[ok], j[ok]
        if not len(i):
            return None
        near = _nearest(u, _known(pivots, d), prefix)
        common = np.array([len(np.intersect1d(near[a[m]], near[b[n]], assume_unique=True)) for m, n in zip(i, j, strict=True)])
        i, j = i[common >= min(shared, near.shape[1])], j[common >= min(shared, near.shape[1])]
        one, two = ball[a[i]], ball[b[j]]
        return pa.RecordBatch.from_arrays([pa.array([d] * len(i), pa.int32()), pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two)), pa.array(sure[i, j])], ["dim", "a", "b", "all"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held_ = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            if held_ and (out := compare(now[0], now[2], now[3], pa.Table.from_batches(held_).combine_chunks())) is not None:
                yield out

        for batch in batches:
            cols = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("dim", "key", "x", "y")])
            edge = [0, *(np.flatnonzero((cols[:, 1:] != cols[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for s, e in zip(edge[:-1], edge[1:], strict=True):
                if s == e:
                    continue
                if (k := tuple(cols[:, s].tolist())) != now:
                    yield from flush()
                    now, held_ = k, []
                held_.append(batch.slice(s, e - s))
        yield from flush()

    return sent.mapInArrow(lean(run), "dim int, a long, b long, all boolean").distinct()


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding", pivots: int = 1024, prefix: int = 8, shared: int = 2, block: int = 512) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of `vectors` (other columns are ignored).

    n_links: other rows found whose cosine with it is at least `threshold` (> 0), in double precision; component_id: the smallest id reachable
    by links; kept: whether it is that one. Rows whose vector is null, zero or holds null or non-finite numbers, and rows
    without an id, have no links and are kept; a null id gives a null component. Vectors of different dimensions are not compared. Ids should
    be unique: rows that share one are linked as different rows but share their answers. An empty table gives an empty result.
    """
    theta = float(np.arccos(threshold))
    refs = vectors.sparkSession.sparkContext.broadcast(reference_points(vectors, id_col, vec_col, pivots))
    base = described(vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()), id_col, vec_col, refs, prefix)
    member = written(balls(base.repartitionByRange("dim", "perm", "id").sortWithinPartitions("dim", "perm", "id"), theta / 2), "members")
    size = member.groupBy("dim", "ball").agg(F.count("*").alias("size"), F.max("angle").alias("wide"))
    centres = written(member.where("id = ball").dropDuplicates(["dim", "ball"]).select("dim", "ball", "unit").join(size, ["dim", "ball"]), "centres")
    pairs = written(ball_pairs(centres, theta, refs, prefix, shared, block), "pairs")
    sizes = centres.select("dim", "ball", "size")
    sure = pairs.where("all")
    both = sure.select("dim", F.col("a").alias("ball"), F.col("b").alias("other")).union(sure.select("dim", F.col("b").alias("ball"), F.col("a").alias("other")))
    more = both.join(sizes.withColumnsRenamed({"ball": "other"}), ["dim", "other"]).groupBy("dim", "ball").agg(F.sum("size").alias("more"))
    single = written(_members(member, pairs.where("not all"), sizes, threshold, block), "single")
    own = member.join(sizes, ["dim", "ball"]).join(more, ["dim", "ball"], "left").select("id", "ball", (F.col("size") - 1 + F.coalesce("more", F.lit(0))).alias("n"))
    extra = single.groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("extra"))
    links = own.select(F.col("id").alias("a"), F.col("ball").alias("b")).union(sure.select("a", "b")).union(single.select("a", "b"))
    part = components(links).withColumnRenamed("node", "id")
    counts = own.groupBy("id").agg(F.max("n").alias("n"))
    known = counts.join(extra, "id", "left").join(part, "id", "left").select(F.col("id").alias("_id"), (F.col("n") + F.coalesce("extra", F.lit(0))).alias("n_links"), "component")
    out = vectors.select(F.col(id_col).cast("long").alias("vec_id")).join(known, F.col("vec_id") == F.col("_id"), "left")
    where = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), where.alias("component_id"), F.coalesce(where == F.col("vec_id"), F.lit(True)).alias("kept"))


def _members(member: DataFrame, pairs: DataFrame, sizes: DataFrame, threshold: float, block: int) -> DataFrame:
    """For members of balls of which only some may be linked: (a, b, n), how many links a has here and one of those it is linked with. Rows follow the members, not their links."""
    parts = lambda s: F.ceil(F.col(s) / block).cast("int")
    known = pairs.join(sizes.withColumnsRenamed({"ball": "a", "size": "sa"}), ["dim", "a"]).join(sizes.withColumnsRenamed({"ball": "b", "size": "sb"}), ["dim", "b"])
    cells = known.withColumn("x", F.explode(F.sequence(F.lit(0), parts("sa") - 1))).withColumn("y", F.explode(F.sequence(F.lit(0), parts("sb") - 1))).withColumn("pa", parts("sa")).withColumn("pb", parts("sb"))
    side = lambda one, part, many, role: cells.select("dim", "a", "b", "x", "y", F.col(one).alias("ball"), F.col(part).alias("part"), F.col(many).alias("many"), F.lit(role).alias("role"))
    asked = side("a", "x", "pa", 0).union(side("b", "y", "pb", 1))
    sent = member.select("dim", "ball", "id", "unit").join(asked, ["dim", "ball"]).where(F.pmod(F.xxhash64("id"), F.col("many")) == F.col("part"))
    sent = sent.select("dim", "a", "b", "x", "y", "role", "id", "unit").repartition("dim", "a", "b", "x", "y").sortWithinPartitions("dim", "a", "b", "x", "y", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            t = pa.Table.from_batches(held).combine_chunks()
            role, ids, u = t.column("role").to_numpy(), t.column("id").to_numpy(), _units(t.column("unit"), now[0])
            i, j = np.nonzero(u[role == 0] @ u[role == 1].T >= threshold)
            if len(i):
                one, two = ids[role == 0], ids[role == 1]
                p, at, n = np.unique(i, return_index=True, return_counts=True)
                q, to, m = np.unique(j, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([one[p], two[q]])), pa.array(np.concatenate([two[j[at]], one[i[to]]])), pa.array(np.concatenate([n, m]).astype(np.int64))], ["a", "b", "n"])

        for batch in batches:
            cols = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("dim", "a", "b", "x", "y")])
            edge = [0, *(np.flatnonzero((cols[:, 1:] != cols[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for s, e in zip(edge[:-1], edge[1:], strict=True):
                if s == e:
                    continue
                if (k := tuple(cols[:, s].tolist())) != now:
                    yield from flush()
                    now, held = k, []
                held.append(batch.slice(s, e - s))
        yield from flush()

    return sent.mapInArrow(lean(run), "a long, b long, n long")
