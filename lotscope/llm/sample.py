"""Labelled rows for fitting: a bounded, repeatable sample of the training folds."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: str = "doc_id") -> Column:
    """True in the fold that is never learned from: crc32 of the id as text leaves no remainder by 5 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 0


def labelled(docs: DataFrame, labels: DataFrame, target: str, rows: int, octets: int) -> pa.Table:
    """(text, label) of at most `rows` rows with a label of 0 or 1 and together at most `octets` bytes of whole texts, outside the held-out fold.

    Rows are taken in the order of a hash of their id, so the sample is the same in every run. Only the ids of
    those rows are broadcast, and only those texts reach the driver: both bounds are parameters.
    """
    ids = labels.where(F.col(target).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(target).alias("label"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    picked = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(ids), "doc_id")
    sizes = picked.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"), F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(rows).collect()
    some, total = [], 0
    for r in sizes:
        total += r["n"]
        if total > octets and some:
            break
        some.append(r["doc_id"])
    chosen = docs.sparkSession.createDataFrame([(x,) for x in sorted(set(some))], "doc_id long")
    got = picked.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", F.col("label").cast("int").alias("label")).limit(rows).toArrow()
    return got.sort_by([("doc_id", "ascending"), ("text", "ascending")]).select(["text", "label"])
