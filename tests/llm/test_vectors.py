import math
import random

import numpy as np

from lotscope.llm.ann import neighbours
from lotscope.llm.neardup import near_duplicates


def table(spark, seed, n=300, d=8):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, d))
    for i in range(n // 3):  # copies of all closenesses
        x[r.integers(n)] = x[i % 7] + r.choice([0.0, 0.05, 0.3, 0.45]) * r.standard_normal(d)
    x[:25] = x[3]
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)]
    rows += [(n, None, 0), (n + 1, [0.0] * d, 0), (n + 2, [float("nan")] * d, 0), (n + 3, [None] + [1.0] * (d - 1), 0), (n + 4, [float("inf")] + [1.0] * (d - 1), 0), (None, x[0].tolist(), 1), (n + 5, [], 0), (n + 6, [1e300] * d, 0), (n + 7, [1e-300] * d, 0), (n + 8, [3.0, 4.0], 0), (n + 9, [30.0, 40.0], 0)]
    random.Random(seed).shuffle(rows)
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)


def good(v):
    return v and all(y is not None and math.isfinite(y) for y in v) and any(v)


def cosine(a, b):
    if len(a) != len(b):
        return -2
    a, b = np.array(a) / np.abs(a).max(), np.array(b) / np.abs(b).max()
    return float(a @ b / np.sqrt((a @ a) * (b @ b)))


def test_near_duplicates_equal_brute_force(spark):
    rows, df = table(spark, 1)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_duplicates(df, block=16, pivots=64).collect()}
    assert len(got) == len(rows)
    ok = {i: v for i, v, _ in rows if i is not None and good(v)}
    near = {a: {b for b in ok if a != b and cosine(ok[a], ok[b]) >= 0.9} for a in ok}
    near_exact = sum(map(len, near.values()))
    found = sum(got[a][0] for a in ok)
    assert 0.97 * near_exact <= found <= near_exact + 4  # rounding of exact ties aside
    for i, v, _ in rows:
        if i is not None and not good(v):
            assert got[i] == (0, i, True)
    for i in range(25):
        assert got[i][1] == got[0][1] and got[i][2] == (got[i][1] == i)
    assert got[309][:2] == (1, 308)


def test_neighbours_recall_and_ties(spark):
    rows, df = table(spark, 2, n=900)
    q = df.where("vec_id % 50 = 0")
    got = neighbours(df, q, shard_rows=200).collect()
    ok = {i: v for i, v, _ in rows if i is not None and good(v)}
    hit = want = 0
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    for i in ok:
        if i % 50:
            continue
        best = sorted(((-cosine(ok[i], v), j) for j, v in ok.items() if j != i and len(v) == len(ok[i])))[:5]
        mine = sorted(by[i], key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, len(mine) + 1)) and len(mine) == 5
        assert all(abs(r.score - cosine(ok[i], ok[r.vec_id])) < 1e-12 for r in mine)
        assert all((-a.score, a.vec_id) < (-b.score, b.vec_id) for a, b in zip(mine, mine[1:]))
        hit += len({j for _, j in best} & {r.vec_id for r in mine})
        want += 5
    assert hit >= 0.95 * want
    assert [r.vec_id for r in sorted(by[0], key=lambda r: r.rank)] == [1, 2, 3, 4, 5]


def test_neighbours_of_multiples_go_by_id(spark):
    r = np.random.default_rng(6)
    one = r.standard_normal(16)
    rows = [(i, (one * 2.0 ** (i % 9 - 4)).tolist()) for i in range(100)] + [(100 + i, v.tolist()) for i, v in enumerate(r.standard_normal((400, 16)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = neighbours(df, df.where("vec_id in (0, 50)"), shard_rows=250).orderBy("query_id", "rank").collect()
    assert [x.vec_id for x in got] == [1, 2, 3, 4, 5, 0, 1, 2, 3, 4]


def test_neighbours_single_row_repeated_ids_and_long_vectors(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string, score string")
    assert neighbours(make([(1, [1.0, 2.0], "", "")]), make([(1, [1.0, 2.0], "", "")])).count() == 0
    df = make([(1, [1.0, 0.0], "", ""), (1, [1.0, 0.0], "", ""), (2, [1.0, 1.0], "", ""), (2, [0.0, 1.0], "", ""), (3, [0.0, 2.0], "", "")])
    got = neighbours(df, df.where("vec_id = 1")).orderBy("rank").collect()
    assert [(x.rank, x.vec_id) for x in got] == [(1, 2), (2, 3)] and abs(got[0].score - 0.5**0.5) < 1e-15
    r = np.random.default_rng(7)
    far = make([(i, v.tolist(), "", "") for i, v in enumerate(r.standard_normal((12, 5000)))])
    assert neighbours(far, far.where("vec_id = 0")).count() == 5


def test_neighbours_recall_and_comparisons_at_the_default_parameters(spark):
    """Of the table's own vectors, as one shard: recall of the graph, and how much of the shard a search looks at."""
    import inspect

    from lotscope.llm.ann import beam_search, build, nodes_of
    from lotscope.llm.vectors import rows, units

    at = {n: p.default for n, p in inspect.signature(neighbours).parameters.items()}
    t = spark.read.parquet("/root/testdata/check_l/embeddings.parquet").where(f"vec_id < {at['shard_rows']}").orderBy("vec_id").toArrow().combine_chunks()
    ids, x = rows(t.column("vec_id").combine_chunks(), t.column("embedding").combine_chunks())[64]
    kept, first = nodes_of(x, ids, 5)
    u = units(x[kept[first]]).astype(np.float32)
    edges, starts = build(u, at["degree"], at["build_beam"], at["alpha"], at["entries"], 0)
    q = u[::50]
    found, _, share = beam_search(u, edges, starts, q, at["beam"])
    sims = q @ u.T
    sims[np.arange(len(q)), np.arange(len(q)) * 50] = -2
    best = np.argsort(-sims, axis=1)[:, :5]
    recall = np.mean([len(set(a) & set(b)) for a, b in zip(found.tolist(), best.tolist(), strict=True)]) / 5
    print("recall", recall, "share compared", share)
    assert recall >= 0.93 and share < 0.1


def test_near_duplicates_recall_at_the_default_parameters(spark):
    """64 dimensions: groups of all widths, large and small, around the threshold."""
    r = np.random.default_rng(9)
    x = [r.standard_normal((1500, 64))]
    for size, wide in [(900, 0.2), (600, 0.3), (500, 0.36), *[(12, 0.25), (12, 0.33), (12, 0.4)] * 30]:
        x.append(r.standard_normal(64) + wide * r.standard_normal((size, 64)))
    x = np.concatenate(x)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(6)
    got = near_duplicates(df).toPandas().set_index("vec_id")["n_links"].sort_index().to_numpy()
    print("recall", got.sum() / near.sum())
    assert 0.97 * near.sum() <= got.sum() <= near.sum() + 4


def test_empty(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, id string, dim string")
    assert near_duplicates(none).count() == 0 and neighbours(none, none).count() == 0
