"""Connected components of a large edge table, by contraction and alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotscope.operators.store import Table

#: Nodes that one task holds; with so few edges left one task can end the search.
ROOM = 400_000


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The edges of some batches become (node, smallest node of its part of them): same components, fewer and flatter edges."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    def out() -> pd.DataFrame:
        return pd.DataFrame([(x, y) for x in up if (y := root(x)) != x], columns=["u", "v"], dtype="int64")

    for pdf in batches:
        for u, v in zip(pdf["u"].tolist(), pdf["v"].tolist(), strict=True):
            a, b = root(u), root(v)
            if a != b:
                up[max(a, b)] = min(a, b)
        if len(up) > 2 * ROOM:
            yield out()
            up.clear()
    yield out()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Every neighbour (larger than the node, or else not larger) is tied to the smallest of the neighbourhood.

    The smallest is found by an aggregate and joined back: no neighbourhood is ever held in one row,
    and a node with very many neighbours is dealt out by the adaptive skew join.
    """
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if large else both.where("v < u")
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    tied = near.join(least, "u")
    if large:
        out = tied.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", room: int = ROOM) -> DataFrame:
    """(node, component): for every node with an edge, the smallest node it can reach.

    Edges are undirected, may repeat, and may join a node with itself; rows with a null end are ignored. Each task contracts its own edges;
    up to `room` edges that are left end in one task, more are contracted further by star steps. Each round is written to the
    shared folder, so lineage stays short; only a count and a checksum of the edges reach the driver.
    """
    edges = edges.where(f"{a} <> {b}").select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
    now = Table(edges.mapInPandas(_contract, "u long, v long").distinct(), "edges")
    mark = None
    while True:
        seen = now.df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (seen["n"], seen["s"]) == mark or not seen["n"]:
            break
        mark = (seen["n"], seen["s"])
        last = seen["n"] <= room
        after = Table(now.df.coalesce(1).mapInPandas(_contract, "u long, v long") if last else _star(_star(now.df, large=True), large=False), "edges")
        now.drop()
        now = after
        if last:
            break
    member = now.df.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return member.union(now.df.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
