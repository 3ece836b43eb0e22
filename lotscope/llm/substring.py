"""Substring dedup: passages of a fixed number of words that a document shares with an earlier one go.

Method: Rabin-Karp hashes of every window of `width` words, counted in Spark; repeated windows merge into maximal
intervals. A window is repeated if its hash also starts in a document with a smaller doc_id.

The hashes travel packed, eight bytes for each distinct window of a document: a batch sends each hash only once, for the
smallest doc_id that it holds (the others of the batch are known to be repeats), to the bucket of that hash; the
bucket finds the smallest doc_id of all and answers with one bit for each window, in the order in which the document
has them. The answer meets the whole text again, where windows are hashed anew and bits become intervals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lotscope.operators.store import lean, written
from lotscope.llm.words import MIX, Piece, digest, mixed, pieces, prefix, zipped, unzipped

#: Windows that one task compares: about 100 MB with what numpy needs beside them.
BUCKET = 1_500_000
#: Windows that one task packs at a time.
UNIT = 700_000
_ROLL = int(MIX[60])
_HEAD = np.dtype([("id", "<i8"), ("text", "<i8"), ("n", "<u4")])


def _windows(piece: Piece, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """For each text of a piece: the hash of every window, where each distinct one first starts, which one each window is, and a digest of the words."""
    w = piece.word_hashes(fold=False)
    p, down = prefix(w, _ROLL)
    m = max(0, len(w) - width + 1)
    h = mixed((p[width : width + m] - p[:m]) * down[:m])
    for t in range(piece.hi - piece.lo):
        a, b = int(piece.first[t]), int(piece.first[t + 1])
        own = h[a : max(a, b - width + 1)]
        _, first, which = np.unique(own, return_index=True, return_inverse=True)
        order = np.argsort(first, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        yield own, first[order], place[which], digest(w[a:b])


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)  # by the upper half, so any number of buckets is filled evenly


def requests(docs: DataFrame, width: int, buckets: int) -> DataFrame:
    """(bucket, blob): documents with their number of distinct windows in the bucket, a bit for each that is sent, and the hashes sent."""

    def pack(rows: list[tuple[int, int, np.ndarray]]) -> Iterator[tuple[int, bytes]]:
        rows.sort(key=lambda r: (r[0], r[1]))
        ids = np.array([r[0] for r in rows], np.int64)
        keys = np.array([r[1] for r in rows], np.int64)
        many = np.array([len(r[2]) for r in rows])
        h = np.concatenate([r[2] for r in rows])
        own = np.repeat(np.arange(len(rows)), many)
        order = np.argsort(h, kind="stable")
        s = h[order]
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        leads = ids[own[order[new]]]
        sent = np.empty(len(h), bool)
        # Of equal hashes those of the smallest doc_id are sent: the bucket alone can judge them.
        sent[order] = ids[own[order]] == np.repeat(leads, np.diff(np.append(np.flatnonzero(new), len(s))))
        to = _bucket(h, buckets)
        order = np.argsort(to, kind="stable")
        ends = np.searchsorted(to[order], np.arange(buckets + 1, dtype=np.uint64))
        for b in np.flatnonzero(np.diff(ends)):
            at = order[ends[b] : ends[b + 1]]
            has = np.bincount(own[at], minlength=len(rows))
            live = np.flatnonzero(has)
            head = np.zeros(len(live), _HEAD)
            head["id"], head["text"], head["n"] = ids[live], keys[live], has[live]
            yield int(b), np.array([len(live), len(at)], "<i8").tobytes() + head.tobytes() + np.packbits(sent[at]).tobytes() + h[at[sent[at]]].astype("<u8").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list) -> pa.RecordBatch:
            got = list(pack(rows))
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.binary())], ["bucket", "blob"])

        rows, held = [], 0
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for piece in pieces(batch.column("text")):
                for doc, (own, first, _, key) in zip(ids[piece.lo : piece.hi], _windows(piece, width), strict=True):
                    if doc is not None and len(first):
                        rows.append((doc, key, own[first]))
                        held += len(first)
                if held > UNIT:
                    yield out(rows)
                    rows, held = [], 0
        if rows:
            yield out(rows)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), "bucket long, blob binary")


def _opened(blob: bytes, answers: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    m, k = (int(x) for x in np.frombuffer(blob, "<i8", 2))
    at = 16 + m * _HEAD.itemsize
    bits = np.unpackbits(np.frombuffer(blob, np.uint8, -(-k // 8), at), count=k).astype(bool)
    return np.frombuffer(blob, _HEAD, m, 16), bits, None if answers else np.frombuffer(blob, "<u8", -1, at + -(-k // 8))


def _judged(groups: int):
    """Blobs of a bucket become (group, bucket, blob): the bits now say which windows are repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(bucket: int, blobs: list[bytes]) -> pa.RecordBatch:
            got = [_opened(b, False) for b in blobs]
            h = np.concatenate([x[2] for x in got])
            ids = np.concatenate([np.repeat(head["id"], head["n"])[bits] for head, bits, _ in got])
            order = np.argsort(h, kind="stable")
            s = h[order]
            new = np.ones(len(s), bool)
            new[1:] = s[1:] != s[:-1]
            cut = np.flatnonzero(new)
            least = np.minimum.reduceat(ids[order], cut) if len(cut) else ids[:0]
            again = np.empty(len(h), bool)
            again[order] = ids[order] > np.repeat(least, np.diff(np.append(cut, len(s))))
            head, bits = np.concatenate([x[0] for x in got]), np.concatenate([x[1] for x in got])
            full = np.ones(len(bits), bool)
            full[bits] = again
            n = head["n"].astype(np.int64)
            start = np.cumsum(n) - n
            some = np.flatnonzero(np.add.reduceat(full, start)) if len(head) else start
            grp = _group(head["id"][some], groups)
            some, grp = some[np.argsort(grp, kind="stable")], np.sort(grp, kind="stable")
            ends = np.flatnonzero(np.concatenate([[True], grp[1:] != grp[:-1], [True]])) if len(grp) else np.zeros(1, np.int64)
            outs = []
            for lo, hi in zip(ends[:-1], ends[1:], strict=True):
                mine = some[lo:hi]
                at = np.repeat(start[mine] - np.cumsum(n[mine]) + n[mine], n[mine]) + np.arange(n[mine].sum())
                outs.append(np.array([len(mine), len(at)], "<i8").tobytes() + head[mine].tobytes() + np.packbits(full[at]).tobytes())
            return pa.RecordBatch.from_arrays([pa.array(grp[ends[:-1]], pa.int64()), pa.array([bucket] * len(outs), pa.int64()), pa.array(outs, pa.binary())], ["grp", "bucket", "blob"])

        now, blobs = None, []
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if bucket != now and blobs:
                    yield of(now, blobs)
                    blobs = []
                now = bucket
                blobs.append(blob.as_py())
        if blobs:
            yield of(now, blobs)

    return run


def _group(ids: np.ndarray, groups: int) -> np.ndarray:
    return np.mod(ids ^ (ids >> 17), groups)


def _cut(width: int, buckets: int, schema: T.StructType):
    """Documents of a group after its answers: what is left of each, and the removed intervals."""

    def removed(answer: dict[tuple[int, int], dict[int, np.ndarray]], doc: int, got: tuple, n: int) -> np.ndarray:
        own, first, which, key = got
        gone = np.zeros(n + 1, np.int64)
        bits = answer.get((doc, key))
        if bits:
            to = _bucket(own[first], buckets)
            again = np.zeros(len(first), bool)
            for b, x in bits.items():
                again[to == b] = x
            starts = np.flatnonzero(again[which])
            gone[starts] += 1
            gone[starts + width] -= 1
        return np.cumsum(gone)[:n] > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grp, answer = None, {}
        to = to_arrow_schema(schema)
        for batch in (b.slice(k, 1000) for b in batches for k in range(0, b.num_rows, 1000)):
            grps, bucket, blobs, docs = (batch.column(c) for c in ("grp", "bucket", "blob", "doc"))
            grps, bucket = grps.to_pylist(), bucket.to_pylist()
            ids = docs.field("doc_id").to_pylist()
            texts = unzipped(batch.column("body"))
            kept, n_words, n_removed, cuts, rows = [], [], [], [], []
            for piece in pieces(texts):
                for t, got in zip(range(piece.lo, piece.hi), _windows(piece, width), strict=True):
                    if grps[t] != grp:
                        grp, answer = grps[t], {}
                    if bucket[t] is not None:
                        head, bits, _ = _opened(blobs[t].as_py(), True)
                        for (doc, key, n), end in zip(head.tolist(), np.cumsum(head["n"]).tolist(), strict=True):
                            answer.setdefault((doc, key), {})[bucket[t]] = bits[end - n : end]
                        continue
                    words = piece.words(t - piece.lo)
                    gone = removed(answer, ids[t], got, len(words)) if len(got[1]) else np.zeros(len(words), bool)
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                    rows.append(t)
                    n_words.append(len(words))
                    n_removed.append(int(gone.sum()))
                    cuts.append([{"start": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2], strict=True)])
                    kept.append(b" ".join(w for w, g in zip(words, gone, strict=True) if not g) if len(edge) else b" ".join(words))
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([docs.take(at), texts.take(at).cast(pa.string()), pa.array([x.decode() for x in kept], pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(cuts, to.field("cuts").type)], ["doc", "text", "kept", "n_words", "n_removed", "cuts"])

    return run


def substring_dedup(docs: DataFrame, width: int = 50) -> DataFrame:
    """The columns of `docs` with kept (the words left, joined by one space), n_words, n_removed and cuts (removed intervals of words).

    A word goes if a window of `width` words that covers it also starts in a document with a smaller doc_id; windows are
    judged on the input. Null and empty texts have no words; texts shorter than a window lose nothing; rows
    that share a doc_id never remove each other's words; a row whose doc_id is null loses nothing and removes nothing.
    The added columns replace columns of the same name. Window hashes have 64 bits and are not compared word by word.
    """
    size = docs.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    buckets = int(max(8, -(-size // 6 // BUCKET)))
    groups = int(max(16, -(-size // (4 << 20)))) | 1
    asked = requests(docs, width, buckets).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    answers = written(asked.mapInArrow(lean(_judged(groups)), "grp long, bucket long, blob binary"), "answers")
    added = ["kept", "n_words", "n_removed", "cuts"]
    own = [c for c in docs.columns if c not in added]
    doc = F.struct(*(F.col(f"`{c}`").cast("long").alias(c) if c == "doc_id" else F.col(f"`{c}`") for c in own if c != "text"))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(0))
    texts = docs.select(F.pmod(key.bitwiseXOR(F.shiftright(key, 17)), F.lit(groups)).alias("grp"), F.lit(None).cast("long").alias("bucket"), F.lit(None).cast("binary").alias("blob"), doc.alias("doc"), "text")
    texts = zipped(texts).withColumn("turn", F.lit(1))
    blobs = answers.select("grp", "bucket", "blob", F.lit(None).cast(texts.schema["doc"].dataType).alias("doc"), F.lit(None).cast("binary").alias("body"), F.lit(0).alias("turn"))
    sent = texts.union(blobs).repartition(-(-groups // 4), "grp").sortWithinPartitions("grp", "turn")
    schema = T.StructType([texts.schema["doc"], T.StructField("text", T.StringType()), T.StructField("kept", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("cuts", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])
    out = sent.mapInArrow(lean(_cut(width, buckets, schema)), schema)
    return out.select(*("text" if c == "text" else F.col(f"doc.`{c}`") for c in own), *added)
