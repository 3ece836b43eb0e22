"""Queries that must do their whole table, against plain Python."""

import datetime

import numpy as np

from lotscope.plans import appraisal, registry
from tests.test_queries import D


def test_same_item_over_all_orders(spark, tmp_path):
    rows = [(i, i * 37 % 1000, f"{i % 3}-P", datetime.date(1995, 1, 1) + datetime.timedelta(i * i % 97)) for i in range(300)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderpriority string, o_orderdate date").write.parquet(f"{tmp_path}/orders.parquet")
    up = {r[0]: r[0] for r in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, c, p, day in rows:
        for j, c2, p2, day2 in rows[:i]:
            if c % 400 == c2 % 400 or (p, day) == (p2, day2):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    got = registry.QUERIES["linkage_same_item"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(i, root(i)) for i in up]


def test_comparables_of_all_makes(spark):
    rows = appraisal.halves(spark, D).select("listing_id", "model_key", "year", "mileage_km", "price", "side").collect()
    train, of = [r for r in rows if r.side == "train"], {}
    for r in train:
        of.setdefault(r.model_key, []).append(r)
    want = {}
    for t in rows:
        if t.side == "test":
            met = of.get(t.model_key, [])
            year = [c for c in met if abs(c.year - t.year) <= 1]
            km = lambda cs, t=t: [c for c in cs if t.mileage_km <= 0 or abs(c.mileage_km - t.mileage_km) <= 0.3 * t.mileage_km]
            tiers = {"strict": km(year), "relaxed_mileage": year, "relaxed_year": km(met), "model_only": met}
            tier = next((k for k, v in tiers.items() if len(v) >= 5), "global")
            got = tiers.get(tier, train)
            q = np.quantile([c.price for c in got], [*appraisal.TAU, 0.25, 0.75, 0.5])
            want[t.listing_id] = (tier, len(got), [(q[5] - q[4]) / q[6], *q[:4]])
    got = registry.QUERIES["estimator_comparables"](spark, D).collect()
    assert len(got) == len(want)
    for r in got:
        tier, n, q = want[r.listing_id]
        assert (r.tier, r.n) == (tier, n)
        np.testing.assert_allclose([r.dispersion, r.q1, r.q2, r.q3, r.q4], q, rtol=1e-6, atol=1e-6)


def test_reposts_of_another_trim(spark):
    rows = appraisal.listings(spark, D).where("model is not null").select("listing_id", "make", "model", "year", "seen_on").collect()
    of = {}
    for r in rows:
        of.setdefault((r.make, r.model, r.year), []).append(r)
    want = {(a.listing_id, b.listing_id) for g in of.values() for a in g for b in g if a.listing_id != b.listing_id and 1 <= (b.seen_on - a.seen_on).days <= 14}
    assert {(r.old_id, r.new_id) for r in registry.QUERIES["linkage_repost_score"](spark, D).collect()} == want
    assert {r.new_id for r in registry.QUERIES["linkage_repost_top1"](spark, D).collect()} == {b for _, b in want}


def test_shingles_of_whole_texts_far_apart(spark, tmp_path):
    head = "".join(chr(97 + i * i % 26) for i in range(200))
    rows = [(0, head + "wxyz" * 20), (1, head + "0123456789" * 8), (9, head + "wxyz" * 20), (50, "QQQQQ"), (60, "abc"), (61, None)]
    spark.createDataFrame(rows, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    sets = {i: {t.lower()[k : k + 4] for k in range(len(t) - 3)} for i, t in rows if t}
    want = {(a, b): round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6) for a in sets for b in sets if a < b and sets[a] & sets[b]}
    got = {(r.a, r.b): r.j for r in registry.QUERIES["linkage_shingle_jaccard"](spark, str(tmp_path)).collect()}
    assert got == want and got[0, 9] == 1 > got[0, 1]


def test_ranking_of_all_years(spark):
    want = {r.listing_id for r in appraisal.listings(spark, D).where("price is not null and model is not null").collect()}
    assert {r.listing_id for r in registry.QUERIES["ranking_score"](spark, D).collect()} == want
    assert {r.query for r in registry.QUERIES["ranking_win_rate"](spark, D).collect()} == {r.query for r in registry.QUERIES["ranking_diversify"](spark, D).collect()}
