"""N-gram Jaccard join: which documents share at least a given part of their word shingles.

Method: set-relation skipping over inverted index lists.

1. Every shingle of every set is counted: four bytes of its hash go to the bucket that the other four name, and the bucket
   answers with the shingle's frequency, as a power of two. A set with fewer than t n shingles that occur elsewhere
   has no partner and goes no further; of the others only the shingles that occur elsewhere do.
2. Equal sets are one set: their answers are the same, so only the one with the smallest id is joined.
3. Shingles are in order of frequency, then hash, those that occur nowhere else first. A set posts the first n - ceil(t n) + 1:
   a pair that reaches the threshold shares one of them, and none before its first common one.
4. A list is ordered by size class and, within it, by position. For each entry only the blocks of the next size classes
   are read, and of each only the positions up to which the threshold can still be reached; the rest is skipped. A
   parity sketch that travels with each set rules out nearly all pairs below the threshold.
5. Answers are derived from those of similar sets. In a first round each set meets a few neighbours in its lists and is
   verified against the most similar one; sets tied by that have one answer. Later rounds only compare sets with
   different answers, and in a list never the sets of its most frequent answer among themselves: the second verifies
   the most similar one again, the last all that are left. So rows follow the sets, not the pairs of a group.
6. Pairs are verified on whole sets of 64-bit shingle hashes with integers: 100 * shared >= t * union.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotscope.operators.components import components
from lotscope.operators.store import Table, lean
from lotscope.llm.words import digest, pieces, shingle_sets, unzipped, zipped

#: Shingles that one task counts: about 200 MB with what numpy needs beside them.
BUCKET = 3_000_000
#: Bytes of texts whose answers one task holds at a time.
GROUP = 4 << 20
#: Postings that one task turns into lists.
POSTS = 250_000
#: Pairs whose sketches are compared at a time.
PAIRS = 100_000
#: Sketches have 2^6 to 2^11 bits.
_LEAST, _MOST = 6, 11
_ASKED = np.dtype([("id", "<i8"), ("key", "<i8"), ("n", "<u4")])
_HEAD = np.dtype([("id", "<i8"), ("part", "<i8"), ("n", "<u4"), ("s", "<u4"), ("held", "<u4"), ("sketch", "<u8", 1 << _MOST - 6)])


def _need(na, nb, percent: int):
    """Least overlap of sets of these sizes at the threshold."""
    return -(-percent * (na + nb) // (100 + percent))


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """By the upper half of the hash, in its order, so that a sorted set falls into consecutive runs; the lower half is compared there."""
    return ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _group(ids: np.ndarray, groups: int) -> np.ndarray:
    return np.mod(ids ^ (ids >> 17), groups)


# 1. Frequencies


def _questions(docs: DataFrame, k: int, buckets: int) -> DataFrame:
    """(bucket, blob): for some documents, how many shingles of each fall into the bucket, and the lower halves of their hashes. Equal sets of a batch ask once, by the smallest id."""

    def pack(rows: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
        rows.sort(key=lambda r: r[:2])
        keys = np.array([r[1] for r in rows], np.int64)
        fresh = np.unique(keys, return_index=True)[1]
        fresh.sort()
        ids, keys, sets = np.array([rows[i][0] for i in fresh], np.int64), keys[fresh], [rows[i][2] for i in fresh]
        tok = np.concatenate(sets)
        own = np.repeat(np.arange(len(ids), dtype=np.int32), [len(x) for x in sets])
        to = _bucket(tok, buckets)
        order = np.argsort(to.astype(np.uint16 if buckets < 1 << 16 else np.uint64), kind="stable")
        ends = np.searchsorted(to[order], np.arange(buckets + 1, dtype=np.uint64))
        half = tok.astype("<u4")
        buckets_, blobs = [], []
        for b in np.flatnonzero(np.diff(ends)):
            at = order[ends[b] : ends[b + 1]]
            has = np.bincount(own[at], minlength=len(ids))
            some = np.flatnonzero(has)
            head = np.zeros(len(some), _ASKED)
            head["id"], head["key"], head["n"] = ids[some], keys[some], has[some]
            buckets_.append(int(b))
            blobs.append(np.array([len(some)], "<i8").tobytes() + head.tobytes() + half[at].tobytes())
        return pa.RecordBatch.from_arrays([pa.array(buckets_, pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for piece in pieces(batch.column("text")):
                for doc, x in zip(ids[piece.lo : piece.hi], shingle_sets(piece, k), strict=True):
                    if doc is not None and len(x):
                        rows.append((doc, digest(x), x))
                        held += len(x)
                if held > 1_000_000:
                    yield pack(rows)
                    rows, held = [], 0
        if rows:
            yield pack(rows)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), "bucket long, blob binary")


def _opened(blob: bytes, kind: str) -> tuple[np.ndarray, np.ndarray]:
    m = int(np.frombuffer(blob, "<i8", 1)[0])
    return np.frombuffer(blob, _ASKED, m, 8), np.frombuffer(blob, kind, -1, 8 + m * _ASKED.itemsize)


def _by_bucket(of: Callable[[int, list[bytes]], Iterator[pa.RecordBatch]]):
    """Runs `of` on the blobs of each bucket; rows are sorted by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs = None, []
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if bucket != now and blobs:
                    yield from of(now, blobs)
                    blobs = []
                now = bucket
                blobs.append(blob.as_py())
        if blobs:
            yield from of(now, blobs)

    return run


def _counted(groups: int):
    """Blobs of a bucket become (grp, bucket, blob): a byte for each shingle, 0 if nothing else has it, or else one more than the binary logarithm of its frequency."""

    def of(bucket: int, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        got = [_opened(b, "<u4") for b in blobs]
        blobs.clear()
        head, half = np.concatenate([x for x, _ in got]), np.concatenate([x for _, x in got])
        del got
        order = np.argsort(half)
        s = half[order]
        cut = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        many = np.diff(np.append(cut, len(s)))
        level = np.empty(len(s), np.uint8)
        level[order] = np.repeat(np.where(many > 1, np.frexp(many)[1], 0).astype(np.uint8), many)
        del order, s, half
        start = np.cumsum(head["n"], dtype=np.int64) - head["n"]
        some = np.flatnonzero(np.add.reduceat(level > 0, start))
        grp = _group(head["id"][some], groups)
        some, grp = some[np.argsort(grp, kind="stable")], np.sort(grp, kind="stable")
        ends = np.flatnonzero(np.concatenate([[True], grp[1:] != grp[:-1], [True]])) if len(grp) else [0]
        outs = []
        for lo, hi in zip(ends[:-1], ends[1:], strict=True):
            mine = some[lo:hi]
            n = head["n"][mine].astype(np.int64)
            at = np.repeat(start[mine] - np.cumsum(n) + n, n) + np.arange(n.sum())
            outs.append(np.array([len(mine)], "<i8").tobytes() + head[mine].tobytes() + level[at].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(grp[ends[:-1]], pa.int64()), pa.array([bucket] * len(outs), pa.int64()), pa.array(outs, pa.binary())], ["grp", "bucket", "blob"])

    return _by_bucket(of)


def _sets(docs: DataFrame, k: int, percent: int) -> Table:
    """(doc_id, n, d1, d2, blob) for each row: size of the shingle set, 128 bits that stand for it, and, if it can have a partner, those of its shingles that occur elsewhere, rare ones first."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    buckets = int(max(8, -(-size // 6 // BUCKET)))
    groups = int(max(16, -(-size // GROUP))) | 1
    asked = _questions(docs, k, buckets).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    answers = Table(asked.mapInArrow(lean(_counted(groups)), "grp long, bucket long, blob binary"), "answers")
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(0))
    texts = docs.select(F.pmod(key.bitwiseXOR(F.shiftright(key, 17)), F.lit(groups)).alias("grp"), F.lit(None).cast("long").alias("bucket"), F.lit(None).cast("binary").alias("blob"), F.col("doc_id").cast("long"), "text")
    texts = zipped(texts).withColumn("turn", F.lit(1))
    blobs = answers.df.select("grp", "bucket", "blob", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("body"), F.lit(0).alias("turn"))
    sent = texts.union(blobs).repartition(-(-groups // 4), "grp").sortWithinPartitions("grp", "turn")
    names = ["doc_id", "n", "d1", "d2", "blob"]

    def shared(x: np.ndarray, answer: dict[int, np.ndarray]) -> bytes | None:
        ends = np.searchsorted(_bucket(x, buckets), np.arange(buckets + 1, dtype=np.uint64))
        level = np.zeros(len(x), np.uint8)
        for b, got in answer.items():
            level[ends[b] : ends[b + 1]] = got
        some = np.flatnonzero(level)
        if 100 * len(some) < percent * len(x):
            return None
        return x[some[np.argsort(level[some], kind="stable")]].astype("<u8").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grp, answer = None, {}
        for batch in (b.slice(k, 1000) for b in batches for k in range(0, b.num_rows, 1000)):
            grps, bucket, ids = (batch.column(c).to_pylist() for c in ("grp", "bucket", "doc_id"))
            out: list[tuple] = []
            for piece in pieces(unzipped(batch.column("body"))):
                for t, x in zip(range(piece.lo, piece.hi), shingle_sets(piece, k), strict=True):
                    if grps[t] != grp:
                        grp, answer = grps[t], {}
                    if bucket[t] is not None:
                        head, level = _opened(batch.column("blob")[t].as_py(), "u1")
                        for (doc, key, n), end in zip(head.tolist(), np.cumsum(head["n"]).tolist(), strict=True):
                            answer.setdefault((doc, key), {})[bucket[t]] = level[end - n : end]
                        continue
                    d1 = digest(x)
                    got = answer.get((ids[t], d1)) if len(x) else None
                    out.append((ids[t], len(x), d1, digest(x[::-1]), shared(x, got) if got else None))
            cols = zip(*out, strict=True) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if name == "blob" else pa.int64()) for name, c in zip(names, cols, strict=True)], names)

    made = Table(sent.mapInArrow(lean(run), "doc_id long, n long, d1 long, d2 long, blob binary"), "sets")
    answers.drop()
    return made


# 2. Lists


def _sketch(x: np.ndarray) -> np.ndarray:
    """Whether an odd number of shingles fall on each of four bits a shingle or more; 2^11 at most."""
    b = _width(len(x))
    bits = np.zeros(1 << _MOST, np.uint8)
    bits[: 1 << b] = np.bincount((x >> np.uint64(64 - b)).astype(np.int64), minlength=1 << b) & 1
    return np.packbits(bits).view("<u8")


def _width(s: int) -> int:
    return min(_MOST, max(_LEAST, int(4 * s).bit_length()))


def _halved(sketch: np.ndarray) -> np.ndarray:
    """Sketches of half as many bits: the place in a shorter one is the upper part of the place in a longer one, so neighbouring bits merge."""
    bits = np.unpackbits(sketch.view(np.uint8), axis=1)
    half = np.zeros_like(bits)
    half[:, : bits.shape[1] // 2] = bits[:, ::2] ^ bits[:, 1::2]
    return np.packbits(half, axis=1).view("<u8")


def _postings(live: DataFrame, percent: int, buckets: int) -> DataFrame:
    """(bucket, blob): for some sets of `live` (id, n, blob, part) their heads, and the posted shingles of each with their positions."""

    def pack(rows: list[tuple[int, int, int, np.ndarray]]) -> pa.RecordBatch:
        sets = [r[3] for r in rows]
        n = np.array([r[1] for r in rows], np.int64)
        s = np.array([len(x) for x in sets], np.int64)
        posted = n - -(-percent * n // 100) + 1 - (n - s)
        tok = np.concatenate([x[:p] for x, p in zip(sets, posted, strict=True)])
        own = np.repeat(np.arange(len(rows)), posted)
        rank = np.arange(len(tok)) - np.repeat(np.cumsum(posted) - posted, posted) + (n - s)[own]
        whole = np.zeros(len(rows), _HEAD)
        whole["id"], whole["part"], whole["n"], whole["s"] = [r[0] for r in rows], [r[2] for r in rows], n, s
        whole["sketch"] = np.stack([_sketch(x) for x in sets])
        to = ((tok * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)) % np.uint64(buckets)
        order = np.argsort(to, kind="stable")
        ends = np.searchsorted(to[order], np.arange(buckets + 1, dtype=np.uint64))
        buckets_, blobs = [], []
        for b in np.flatnonzero(np.diff(ends)):
            at = order[ends[b] : ends[b + 1]]
            has = np.bincount(own[at], minlength=len(rows))
            head = whole[has > 0]
            head["held"] = has[has > 0]
            buckets_.append(int(b))
            blobs.append(np.array([len(head), len(at)], "<i8").tobytes() + head.tobytes() + tok[at].astype("<u8").tobytes() + rank[at].astype("<u4").tobytes())
        return pa.RecordBatch.from_arrays([pa.array(buckets_, pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for i, n, part, blob in zip(*(batch.column(c).to_pylist() for c in ("id", "n", "part")), batch.column("blob"), strict=True):
                x = np.frombuffer(blob.as_py(), "<u8")
                rows.append((i, n, part, x))
                held += len(x)
                if held > 1_000_000:
                    yield pack(rows)
                    rows, held = [], 0
        if rows:
            yield pack(rows)

    return live.select("id", "n", "part", "blob").mapInArrow(lean(run), "bucket long, blob binary")


def _lists(percent: int, near: int, best: bool):
    """Blobs of a bucket become rows (a, b, score) of sets with different parts that can reach the threshold by size, position and sketch.

    `near`: only so many next entries of a list are met; 0 for all. `best`: only the highest score of each a.
    """

    def windows(lst, size, rank, n, probes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of entries to compare, block by block. Entries are in order of (list, size class, position)."""
        key = (lst << 38) | (size << 27) | rank
        for step in (-1, 0, 1):
            base = (lst[probes] << 38) | ((size[probes] + step) << 27)
            a, b = np.searchsorted(key, base), np.searchsorted(key, base | (n[probes] * (100 - percent) // percent + 2), "right")
            many = np.maximum(0, b - a)
            total, done = np.cumsum(many), 0
            while done < len(probes):
                upto = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + PAIRS, "right")))
                m = many[done:upto]
                x = np.repeat(probes[done:upto], m)
                y = np.repeat(a[done:upto], m) + np.arange(len(x)) - np.repeat(np.cumsum(m) - m, m)
                for at in range(0, len(x), PAIRS):
                    yield x[at : at + PAIRS], y[at : at + PAIRS]
                done = upto

    def next_ones(lst) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for d in range(1, near + 1):
            x = np.flatnonzero(lst[d:] == lst[:-d])
            for at in range(0, len(x), PAIRS):
                yield x[at : at + PAIRS], x[at : at + PAIRS] + d

    def of(bucket: int, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        heads, toks, ranks = [], [], []
        for blob in blobs:
            m, p = (int(v) for v in np.frombuffer(blob, "<i8", 2))
            at = 16 + m * _HEAD.itemsize
            heads.append(np.frombuffer(blob, _HEAD, m, 16))
            toks.append(np.frombuffer(blob, "<u8", p, at))
            ranks.append(np.frombuffer(blob, "<u4", p, at + 8 * p))
        head, tok, rank = np.concatenate(heads), np.concatenate(toks), np.concatenate(ranks).astype(np.int64)
        blobs.clear()
        del heads, toks, ranks
        who = np.repeat(np.arange(len(head)), head["held"])
        ids, part, full, known = head["id"], head["part"], head["n"].astype(np.int64), head["s"].astype(np.int64)
        sketch = np.ascontiguousarray(head["sketch"])
        wide = np.array([_width(x) for x in known.tolist()])
        shorter = _halved(sketch) if len(np.unique(wide)) > 1 else sketch
        # Lists of one part have nothing to compare.
        order = np.argsort(tok, kind="stable")
        t, g = tok[order], part[who[order]]
        cut = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        lst = np.repeat(np.arange(len(cut)), np.diff(np.append(cut, len(t))))
        order = order[(np.minimum.reduceat(g, cut) < np.maximum.reduceat(g, cut))[lst]]
        if not len(order):
            return
        lst = np.unique(tok[order], return_inverse=True)[1].astype(np.int64)
        who, rank = who[order], rank[order]
        n, g = full[who], part[who]
        size = np.floor(np.log(n) / np.log(100 / percent) - 1e-9).astype(np.int64) + 1
        order = np.lexsort((ids[who], rank, size, lst))
        lst, who, rank, n, g, size = (v[order] for v in (lst, who, rank, n, g, size))
        found: list[np.ndarray] = []

        def keep(x: np.ndarray, y: np.ndarray) -> None:
            need = _need(n[x], n[y], percent)
            ok = (g[x] != g[y]) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])) & (n[x] - rank[x] >= need) & (n[y] - rank[y] >= need)
            a, b, need = who[x[ok]], who[y[ok]], need[ok]
            if len(a) > 64:  # a pair meets in many lists
                two = np.unique(np.minimum(a, b) * len(head) + np.maximum(a, b))
                a, b = two // len(head), two % len(head)
                need = _need(full[a], full[b], percent)
            differ = np.bitwise_count(np.where((wide[a] > wide[b])[:, None], shorter[a], sketch[a]) ^ np.where((wide[b] > wide[a])[:, None], shorter[b], sketch[b])).sum(axis=1, dtype=np.int64)
            room = known[a] + known[b] - 2 * need - differ
            a, b, score = a[room >= 0], b[room >= 0], (room / (full[a] + full[b]))[room >= 0]
            found.append(np.stack([np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([score, score])]) if best else np.stack([np.minimum(a, b), np.maximum(a, b), score]))

        def merged() -> None:
            """One row for each pair or, with `best`, for each set."""
            a, b, score = np.concatenate(found, axis=1)
            o = np.lexsort((ids[b.astype(np.int64)], -score, a)) if best else np.lexsort((b, a))
            a, b, score = a[o], b[o], score[o]
            new = np.ones(len(a), bool)
            new[1:] = a[1:] != a[:-1]
            if not best:
                new[1:] |= b[1:] != b[:-1]
            found[:] = [np.stack([a[new], b[new], score[new]])]

        def out() -> pa.RecordBatch:
            merged()
            a, b, score = found.pop()
            return pa.RecordBatch.from_arrays([pa.array(ids[a.astype(np.int64)], pa.int64()), pa.array(ids[b.astype(np.int64)], pa.int64()), pa.array(score, pa.float64())], ["a", "b", "score"])

        if near:
            pairs = next_ones(lst)
        else:
            o = np.lexsort((g, lst))
            run = np.flatnonzero(np.concatenate([[True], (lst[o][1:] != lst[o][:-1]) | (g[o][1:] != g[o][:-1])]))
            many = np.diff(np.append(run, len(o)))
            top = np.zeros(lst[-1] + 1, np.int64)
            by = np.argsort(many, kind="stable")
            top[lst[o][run][by]] = g[o][run][by]
            pairs = windows(lst, size, rank, n, np.flatnonzero(g != top[lst]))
        held = 0
        for x, y in pairs:
            keep(x, y)
            held += found[-1].shape[1]
            if held > 500_000:
                merged()
                held = found[0].shape[1]
                if held > 250_000:
                    yield out()
                    held = 0
        if found:
            yield out()

    return _by_bucket(of)


def _verified(live: DataFrame, pairs: DataFrame, percent: int, name: str) -> Table:
    """(a, b) of those pairs (a, b) whose whole sets reach the threshold.

    Each set goes once to each hub it is compared with; a hub's partners are dealt to as many parts as they
    need, and a part is read as a stream with the hub first, so neither grows with the group.
    """
    deg = pairs.groupBy("a").agg(F.count("*").alias("deg"))
    dealt = pairs.join(deg, "a").select(F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), (F.col("deg") / 500).cast("long") + 1).alias("part"), F.col("b").alias("id"), F.lit(1).alias("role"))
    asked = dealt.union(dealt.select("hub", "part", F.col("hub").alias("id"), F.lit(0).alias("role")).distinct())
    sent = live.select("id", "n", "blob").join(asked.hint("shuffle_hash"), "id").select("hub", "part", "role", "id", "n", "blob").repartition("hub", "part").sortWithinPartitions("hub", "part", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, mine = None, []
        for batch in batches:
            hubs, parts, roles, ids, n = (batch.column(c).to_pylist() for c in ("hub", "part", "role", "id", "n"))
            a, b = [], []
            for t, blob in enumerate(batch.column("blob")):
                x = np.frombuffer(blob.as_py(), "<u8")
                if roles[t] == 0:
                    mine = [*(mine if of == (hubs[t], parts[t]) else []), (n[t], np.sort(x))]
                    of = hubs[t], parts[t]
                    continue
                for m, y in mine if of == (hubs[t], parts[t]) else []:
                    at = np.searchsorted(y, x)
                    at[at == len(y)] = 0
                    shared = int(np.count_nonzero(y[at] == x))
                    if 100 * shared >= percent * (n[t] + m - shared):
                        a.append(hubs[t])
                        b.append(ids[t])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return Table(sent.mapInArrow(lean(run), "a long, b long").distinct(), name)


def jaccard_join(docs: DataFrame, k: int = 5, percent: int = 80, near: int = 8) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of `docs` (doc_id, text; other columns are ignored).

    n_shingles is the size of the row's set; component_id the smallest doc_id that it reaches through pairs whose
    Jaccard similarity is at least `percent` / 100. Null and empty texts have no shingles and reach only themselves;
    rows with equal texts are linked; a row whose doc_id is null takes no part and has a null component; rows that share a
    doc_id count as one. An empty table gives an empty result. `near`: neighbours that a set meets in a list in the first
    round; any number gives the same result. Shingles and sets are compared by 64 and 128 bits of hash.
    """
    if not 1 <= percent <= 100:
        raise ValueError(f"percent must be from 1 to 100, not {percent}")
    docs = docs.select("doc_id", "text")
    sets = _sets(docs, k, percent).df
    known = sets.where("doc_id is not null and n > 0").select("doc_id", "n", "d1", "d2")
    # Equal sets are tied in two steps, so that a large group of copies is dealt out: to the smallest id of their part, and that to the smallest of all.
    key = ["n", "d1", "d2"]
    dealt = known.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    near_ = dealt.groupBy(*key, "salt").agg(F.min("doc_id").alias("rep"))
    least = near_.groupBy(*key).agg(F.min("rep").alias("least"))
    links = dealt.join(near_, [*key, "salt"]).where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    links = links.union(near_.join(least, key).where("rep <> least").select(F.col("rep").alias("a"), F.col("least").alias("b")))
    if percent < 100:
        for found in _links(sets, percent, near):
            links = links.union(found)
    part = components(links)
    return sets.select("doc_id", F.col("n").alias("n_shingles")).join(part.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def _links(sets: DataFrame, percent: int, near: int) -> list[DataFrame]:
    """Enough of the true pairs (a, b) of different sets to tie together what all of them would: three rounds, as in 5. above."""
    one = sets.where("blob is not null").groupBy("n", "d1", "d2").agg(F.min(F.struct("doc_id", "blob")).alias("x"))
    live = Table(one.select(F.col("x.doc_id").alias("id"), "n", F.col("x.blob").alias("blob")), "live").df
    prefix = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100 - 1e-9) + 1 - (F.col("n") - F.length("blob") / 8)
    total = live.agg(F.sum(prefix).alias("p")).first()["p"]
    if not total:
        return []
    buckets = int(max(8, -(-int(total) // POSTS)))
    links: list[DataFrame] = []
    now = live.withColumn("part", F.col("id"))
    for meet, best in ((near, True), (0, True), (0, False)):
        posted = _postings(now, percent, buckets).repartition(buckets, "bucket").sortWithinPartitions("bucket")
        pairs = posted.mapInArrow(lean(_lists(percent, meet, best)), "a long, b long, score double")
        if best:
            pairs = pairs.groupBy("a").agg(F.max(F.struct("score", "b")).alias("x")).select("a", F.col("x.b").alias("b"))
        pairs = Table(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "pairs")
        links.append(_verified(live, pairs.df, percent, "links").df)
        pairs.drop()
        if best:
            tied = links[0]
            for x in links[1:]:
                tied = tied.union(x)
            part = components(tied).select(F.col("node").alias("id"), "component")
            now = live.join(part, "id", "left").select("id", "n", "blob", F.coalesce("component", "id").alias("part"))
    return links
