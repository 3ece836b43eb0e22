import datetime as dt
import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotscope.functions import text
from lotscope.operators import estimators, linkage, quality, ranking, review, tracking
from lotscope.sources import catalog, tabular
from lotscope.streaming import watch


def values(spark, f, cases):
    rows = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], "i int, s string")
    got = [r[0] for r in rows.select("i", f(F.col("s")).alias("v")).orderBy("i").select("v").collect()]
    assert got == [want for _, want in cases]


def test_text_functions(spark):
    values(spark, text.normalize, [("كتاب  يك", "کتاب یک"), ("۱۲٣", "123"), ("ﷲ x", "الله x"), (None, ""), ("می‌خرم", "می خرم")])
    price = lambda s: text.parse_price(text.normalize(s))
    values(spark, price, [("۱٬۴۸۰٬۰۰۰٬۰۰۰ تومان", 1_480_000_000), ("۱ میلیارد و ۴۸۰ میلیون", 1_480_000_000), ("1.5 میلیارد", 1_500_000_000), ("۱۴۸۰ میلیون", 1_480_000_000), ("توافقی", None), ("تماس بگیرید", None), ("10,000,000 ریال", 1_000_000), ("", None), ("12", None)])
    km = lambda s: text.parse_mileage_km(text.normalize(s))
    values(spark, km, [("۸۰ هزار کیلومتر", 80_000), ("۱۲۰,۰۰۰ کیلومتر", 120_000), ("کارکرد صفر", 0), ("کارکرد ۸۰", 80_000), ("45000", 45_000), ("", None)])
    year = lambda s: text.parse_year_jalali(text.normalize(s))
    values(spark, year, [("مدل ۱۳۹۹", 1399), ("۹۹", 1399), ("مدل ۲۰۱۸", 1397), ("02", 1402), ("x", None)])
    values(spark, text.phone_canonical, [("+98 912 345 6789", "09123456789"), ("0912-3456789", "09123456789"), ("12", None)])
    values(spark, text.redacted, [("call 0912 345 6789 now", "call [contact] now"), ("a@b.com", "[contact]"), ("1234", "1234")])


def test_http_and_integrity(spark):
    codes = spark.createDataFrame([(c, r) for c, r in ((200, False), (404, False), (410, False), (403, False), (429, False), (500, False), (None, False), (200, True))], "c int, r boolean")
    got = [r[0] for r in codes.select(quality.classify_http(F.col("c"), F.col("r"))).collect()]
    assert got == ["ok", "absent", "absent", "unknown", "unknown", "unknown", "unknown", "absent"]
    day = dt.date(2024, 1, 1)
    rows = []
    for i, (p, a, u) in enumerate([(20, 0, 0), (5, 15, 0), (10, 0, 10), (3, 2, 0)]):
        rows += [(day + dt.timedelta(i), s) for s, n in (("present", p), ("absent", a), ("unknown", u)) for _ in range(n)]
    out = tracking.integrity(spark.createDataFrame(rows, "day date, status string")).orderBy("day").collect()
    assert [r.integrity for r in out] == ["ok", "suspect", "partial", "ok"]


def test_repost_score(spark):
    kind = "make string, model string, year int, mileage_km long, seller string, photos array<string>, trim string, color string, province string, price long"
    old = ("m", "x", 1399, 80_000, "s1", ["p1", "p2", "p3"], "t", "c", "r", 100)
    def score(**change):
        new = dict(zip([c.split()[0] for c in kind.split(", ")], old, strict=True)) | change
        df = spark.createDataFrame([(old, tuple(new.values()))], f"o struct<{kind.replace(' ', ':').replace(',:', ',')}>, n struct<{kind.replace(' ', ':').replace(',:', ',')}>")
        return df.select(linkage.repost_score(lambda c: F.col(f"o.{c}"), lambda c: F.col(f"n.{c}"))).first()[0]
    assert score(mileage_km=81_000) == 1.0
    assert score(mileage_km=95_000, seller="s2", photos=["z"]) < 0.70
    assert score(mileage_km=70_000) == 0 and score(make="other") == 0 and score(year=1400) == 0
    assert abs(score(photos=[], seller=None, mileage_km=None, trim=None, color=None, price=None, province=None) - 0) < 0.01


def test_same_item_equals_union_find(spark):
    r = np.random.default_rng(1)
    rows = [(int(i), int(r.integers(60)) if r.random() < 0.8 else None, int(r.integers(60))) for i in range(80)]
    got = dict(linkage.same_item(spark.createDataFrame(rows, "id long, a long, b long"), "id", [["a"], ["b"]]).collect())
    up = {i: i for i, _, _ in rows}
    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for i, a, b in rows:
        for j, c, e in rows[:i]:
            if (a is not None and a == c) or b == e:
                p, q = root(i), root(j)
                up[max(p, q)] = min(p, q)
    assert got == {i: root(i) for i in up}


def test_ridge_and_gate(spark):
    r = np.random.default_rng(2)
    x = r.standard_normal((400, 3))
    y = x @ [1.5, -2, 0.5] + 3 + 0.1 * r.standard_normal(400)
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y, strict=True)], "a double, b double, c double, y double")
    m = estimators.Ridge(["a", "b", "c"], 2.0).fit(df, "y")
    c = x - x.mean(0)
    assert np.allclose(m.coef, np.linalg.solve(c.T @ c + 2 * np.eye(3), c.T @ (y - y.mean())), atol=1e-9)
    with pytest.raises(ValueError):
        estimators.Ridge(["price_status"]).fit(df, "y")
    with pytest.raises(estimators.Refused):
        estimators.serve("rejected", lambda: 1)
    good = {"coverage1": 0.15, "coverage2": 0.35, "coverage3": 0.5, "coverage4": 0.85, "crossing": 0.0, "pinball": 1.0, "n": 500, "slice": "a"}
    assert estimators.Gate().verdict(good, [good], 2.0)[0] == "accepted"
    assert estimators.Gate().verdict(good, [good | {"n": 5}], 2.0)[0] == "unjudgeable"
    assert estimators.Gate().verdict(good, [good | {"coverage3": 0.8}], 2.0)[0] == "rejected"


def test_split_has_no_cluster_on_both_sides(spark):
    r = np.random.default_rng(3)
    df = spark.createDataFrame([(int(r.integers(50)), int(r.integers(100))) for _ in range(400)], "cluster_id long, ordinal long")
    out = estimators.temporal_split(df)
    assert out.groupBy("cluster_id").agg(F.countDistinct("side").alias("n")).where("n > 1").count() == 0
    assert out.count() == 400


def test_ladder_never_relaxes_a_breaker(spark):
    ask = ranking.Intent(budget_max=100, max_km=10, year_min=2000, breakers=("accident",), soft=True)
    rows = [("a", 105, 9, 2000, "intact", "m"), ("b", 100, 13, 2000, "intact", "m"), ("c", 100, 10, 1999, "unknown", "m"), ("d", 90, 1, 2001, "accident", "m"), ("e", 115, 10, 2000, "intact", "m")]
    got, steps = ranking.retrieve(spark.createDataFrame(rows, "listing_id string, price long, mileage_km long, year int, condition string, model string"), ask)
    assert {r.listing_id for r in got.collect()} == {"a", "b", "c"} and steps == ["budget +10%", "mileage +30%", "year -1"]
    assert sum(vars(ranking.Weights(0, 0, 0, 0, 0, 0).normalized()).values()) == pytest.approx(1)


def test_review_levels(spark):
    df = spark.createDataFrame([("HIGH", 1), ("MEDIUM", 5), ("LOW", 0)], "s string, n int")
    assert [r[0] for r in df.select(review.downgraded(F.col("s"), F.col("n"))).collect()] == ["MEDIUM", "INSUFFICIENT_EVIDENCE", "LOW"]


def test_sources_and_catalog(spark, tmp_path):
    (tmp_path / "a.csv").write_text('title,km,cost,who\nx,"120,000",1٬000,ali\ny,zz,,\n', encoding="utf-8")
    df = tabular.read_delimited(spark, str(tmp_path / "a.csv"), {"listing_id": "title", "mileage_km": "km", "asking_price_toman": "cost", "seller": "who", "make": "none"}, "s", "salt")
    got = {r.listing_id: r for r in df.collect()}
    assert (got["x"].mileage_km, got["x"].asking_price_toman, got["y"].mileage_km, got["y"].seller_fingerprint) == (120_000, 1_000, None, None)
    assert got["x"].seller_fingerprint == hashlib.sha256("saltali".encode()).hexdigest()[:24]
    both = tabular.collected(spark, {"good": lambda: df, "bad": lambda: spark.read.csv(str(tmp_path / "missing.csv"))})
    assert sorted(r.status for r in both.collect()) == ["ok", "ok", "unknown"]
    run = {"schema": "corpus/1", "run_id": "r1", "source": "s", "collected_on": "2024-01-01", "listings": [{"listing_id": "1", "model": " A ", "extra": 1}, {"listing_id": "2", "make": "m", "model": "A"}]}
    (tmp_path / "run.json").write_bytes(catalog.serialize(run))
    rows = tabular.read_runs(spark, str(tmp_path / "run.json"))
    assert [(r.position, r.listing_id) for r in rows.orderBy("position").collect()] == [(0, "1"), (1, "2")]
    assert tabular.identities(spark, str(tmp_path / "run.json")).first()["sha256"] == catalog.digest(run) == hashlib.sha256(catalog.serialize(json.loads(catalog.serialize(run)))).hexdigest()
    c = catalog.Catalog(spark, str(tmp_path / "cat"))
    assert [c.load("r1", "d1", rows), c.load("r1", "d1", rows), c.load("r1", "d2", rows), c.load("r2", "d1", rows)] == ["loaded", "unchanged", "replaced", "loaded"]
    assert c.of_model("A").count() == 4 and c.of_model("A", "m").count() == 2 and c.verify("r1", "d2")
    assert [catalog.write_snapshot(rows, str(tmp_path / "snap"), "x") for _ in range(2)] == ["x", "x-2"]
    bad = spark.createDataFrame([("1", "call 0912 345 6789")], "id string, note string")
    assert catalog.violations(bad, "id").count() == 1
    with pytest.raises(ValueError):
        catalog.violations(bad.withColumn("x", F.struct(F.lit("1").alias("phone"))), "id")
    html = spark.createDataFrame([('<script type="application/ld+json">{"@type":"Car","name":"z"}</script>',)], "h string")
    assert html.select(F.try_variant_get(tabular.vehicle_node(tabular.json_ld(F.col("h"))), "$.name", "string")).first()[0] == "z"
    rules = spark.createDataFrame([(False, "/a"), (True, "/a/b"), (False, "/a/b")], "allow boolean, path string")
    urls = spark.createDataFrame([("http://h/a/x",), ("http://h/a/b?c",), ("http://h",)], "url string")
    assert [r.allowed for r in tabular.robots_allowed(urls, rules).collect()] == [False, True, True]


def test_streams_equal_batches(spark, tmp_path):
    r = np.random.default_rng(4)
    day = dt.date(2024, 1, 1)
    rows = [(int(i), day + dt.timedelta(int(d)), r.choice(["present", "absent", "unknown"], p=[0.7, 0.2, 0.1]).item(), int(r.integers(3))) for d in range(6) for i in range(40)]
    df = spark.createDataFrame(rows, "item long, day date, status string, price long")
    want = sorted(map(str, tracking.events(df).collect()))
    for k in range(3):
        df.where(F.datediff("day", F.lit(day)).isin(2 * k, 2 * k + 1)).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in/*"))
    q = watch.tracked(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).select("item", "day", "event", "before", "after").collect())) == want
    fetches = df.withColumn("fetch_id", F.monotonically_increasing_id())
    fetches.write.parquet(str(tmp_path / "f"))
    g = watch.gated_snapshots(spark.readStream.schema(fetches.schema).parquet(str(tmp_path / "f")), str(tmp_path / "kept"), str(tmp_path / "cp2"))
    g.awaitTermination()
    want = sorted(map(str, tracking.daily(fetches, tracking.integrity(fetches)).collect()))
    assert sorted(map(str, watch.kept_days(spark, str(tmp_path / "kept")).collect())) == want
    # The same rows in many batches, so that days are spread over several: the last judgement is of all their rows.
    spark.read.parquet(str(tmp_path / "f")).repartition(4).write.parquet(str(tmp_path / "g"))
    stream = spark.readStream.schema(fetches.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "g"))
    watch.gated_snapshots(stream, str(tmp_path / "kept2"), str(tmp_path / "cp3")).awaitTermination()
    assert sorted(map(str, watch.kept_days(spark, str(tmp_path / "kept2")).collect())) == want
