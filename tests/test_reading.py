"""Readers of listings and pages, and reports, on hand-made cases."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from lotscope.functions import listing, text
from lotscope.operators import estimators, quality, reports, review
from lotscope.operators.components import components
from lotscope.sources import pages


def read(spark, f, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("s", text.normalize(F.col("t")))
    return [r.x for r in df.select("i", f(F.col("s")).alias("x")).orderBy("i").collect()]


def test_models_are_words_of_their_own(spark):
    got = read(spark, listing.make_model, "گرند ویتارا", "تارا تمیز", "سمندم", "پارس تندر", "تهران پارس", "206 و پراید", "وپراید", "PRIDE", "pride", "پرایدستان", "نو")
    assert [x.model for x in got] == [None, "Tara", "Samand", None, None, "206", "Pride", None, "Pride", None, None]


def test_condition_takes_the_worst_claim(spark):
    got = read(spark, listing.body_condition, "بدون خط و خش", "بدون رنگ ولی گلگیر تعویض", "چند لکه رنگ", "لکه رنگ", "تصادفی بدون رنگ", "سلام", "خط و خش")
    assert got == ["intact", "replaced_part", "multi_paint", "minor_paint", "accident", "unknown", "minor_paint"]


def test_prose_prices_and_distances(spark):
    assert read(spark, listing.price_in_prose, "پژو 206 تیپ 5", "۸۵۰٬۰۰۰٬۰۰۰ تومان", "تا ۲ میلیارد و ۱۰۰", "۲۵۰۰ تومان", "کارکرد ۸۰ هزار") == [None, 850_000_000, 2_100_000_000, None, None]
    assert read(spark, listing.mileage_in_prose, "کارکرد ۸۰ هزار", "پژو 206", "کارکرد صفر", "۱۲۰٬۰۰۰ کیلومتر") == [80_000, None, 0, 120_000]


def test_provinces(spark):
    lines = ("رباط کریم، تهران", "تهران، آذری", "کرمان", "گلستان", "کرج", "مشهد، خراسان رضوی، فلسطین", "", "خرم‌آباد", "یاسوج، کهکیلویه و بویراحمد")
    assert read(spark, listing.province_of, *lines) == ["تهران", None, None, "گلستان", None, "خراسان رضوی", None, None, "کهگیلویه و بویراحمد"]
    assert read(spark, listing.province_from_city, *lines) == [None, "تهران", "کرمان", None, "البرز", None, None, "لرستان", "کهگیلویه و بویراحمد"]


def test_calendar(spark):
    day = lambda *x: datetime.date(*x)
    rows = [("۱۴۰۵/۶/۲۲", day(2026, 9, 13)), ("یکشنبه ۲۲ شهریور", day(2026, 9, 13)), ("۲۲ شهریور", day(2026, 3, 25)), ("۱۴۰۴/۱/۱", day(2026, 9, 13)), ("۱۴۰۵/۱۳/۱", day(2026, 9, 13)), ("امروز", day(2026, 9, 13)), ("سلام", day(2026, 9, 13)), ("۵ مهر", day(2020, 1, 1))]
    df = listing.with_title_date(spark.createDataFrame(rows, "t string, d date"), "t", "d")
    got = {r.t: (r.title_date, r.title_date_source, r.title_date_status) for r in df.collect()}
    assert got["۱۴۰۵/۶/۲۲"] == (day(2026, 9, 13), "read", "present") and got["یکشنبه ۲۲ شهریور"] == (day(2026, 9, 13), "inferred", "present")
    assert got["۲۲ شهریور"][2] == "present_but_unparsed" and got["۱۴۰۴/۱/۱"][1:] == ("read", "malformed") and got["۱۴۰۵/۱۳/۱"][2] == "malformed"
    assert got["امروز"][2] == "present_but_unparsed" and got["سلام"][2] == "absent_in_source" and got["۵ مهر"][2] == "present_but_unparsed"
    assert read(spark, listing.phrase_days, "امروز", "دیروز", "۳ هفته پیش", "۵ دقیقه پیش", "۲ سال پیش", "به زودی") == [0, 1, 21, 0, 730, None]


def test_cards_nodes_rows_and_results(spark):
    html = '<div class="post-card x"><a href="/v/1">یک</a><script>no</script><div class="post-card">inner</div></div><br><div class="post-card"><p>two &amp; more</div>'
    assert pages.cards(html, "div", class_="post-card") == [("/v/1", "یک inner"), (None, "two & more")] and pages.cards(None, "div") == []
    ld = '<script type="application/ld+json">{"@graph": [{"@type": ["Product", "Car"], "name": "a", "offers": {"@type": "Offer"}}, 3]}</script><script type="application/ld+json">{bad</script>'
    assert [n["name"] for n in pages.jsonld_nodes(ld, {"Car", "Vehicle"})] == ["a"] and len(pages.jsonld_nodes(ld, {"Offer"})) == 1
    rsc = '<script>self.__next_f.push([1,"1:{\\"a\\": 2}\\n2:I[3"])</script><script>self.__next_f.push([1,"4]\\nzz:x\\n"])</script>'
    assert pages.stream_rows(rsc) == {"1": {"a": 2}, "2": "I[34]"}
    deep: dict = {"results": [{"slug": "s", "car_properties": {}}, {"slug": "t"}]}
    for _ in range(5000):
        deep = {"x": [deep]}
    assert pages.nested_results(deep) == [{"slug": "s", "car_properties": {}}]
    df = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    assert [(r.page_id, r.place) for r in pages.extracted(df, lambda h: pages.cards(h, "div", class_="post-card")).collect()] == [(1, 0), (1, 1)]


def test_urls_and_robots(spark):
    df = spark.createDataFrame([("https://a.ir/v/abc123x-peugeot-206?x=1",), ("https://a.ir/car",), ("/about",)], "u string")
    i, name = pages.slug(F.col("u"))
    assert [tuple(r) for r in df.select(pages.url_kind(F.col("u")), i, name).collect()][0] == ("listing", "abc123x", "peugeot-206")
    robots = "User-agent: *\nDisallow: /\n\nUser-agent: lot\nUser-agent: x\nDisallow: /p*/q$\nAllow: /p\nDisallow: /secret # no\n"
    paths = spark.createDataFrame([(p,) for p in ("/p1/q", "/p1/q/r", "/secret/a", "/other")], "p string")
    ask = lambda status, agent: [r[0] for r in paths.select(pages.robots_allow(F.col("p"), status, robots, agent)).collect()]
    assert ask(200, "lotbot") == [False, True, False, True] and ask(200, "else") == [False] * 4
    assert ask(404, "else") == [True] * 4 and ask(503, "lot") == [False] * 4 and ask(429, "lot") == [False] * 4


def test_smallest_corpus():
    assert reports.trim_profile([10, 3, 4, 8])["eligible"] == 25
    got = reports.smallest_corpus([2, 3, 6, 9, 4, 1, 12, 5], "broaden")
    assert got and min(got["thin"], got["held_out"]) >= 58 and got["k"] > 1
    assert reports.smallest_corpus([40] * 10, "mixed")["coverage"] >= 0.7 and reports.smallest_corpus([100], "deepen", 50) is None


def test_sources_fail_alone(spark):
    def broken():
        raise OSError("gone")

    got, failed = reports.union_isolated({"a": lambda: spark.range(2), "b": broken, "c": lambda: spark.range(1).withColumn("x", F.lit(1))})
    assert got.count() == 3 and failed == {"b": "OSError: gone"}


def test_hard_findings_outrank_scores(spark):
    case = dict(present_days=9, span=9, unknown_days=0, tier="strict", n=40, dispersion=0.1, reposts=0, served=True, q1=90.0, q4=110.0, price=100.0, p01=50.0, p99=200.0, n_market=50, weak_link=False, tracked=True)
    rows = [case, case | {"price": 300.0}, case | {"served": False}, case | {"n": 7}, case | {"q4": 200.0}, case | {"present_days": 0}]
    got = [(r.decision, r.status_before, r.status) for r in review.reviewed(spark.createDataFrame([{"i": i, **x} for i, x in enumerate(rows)])).orderBy("i").collect()]
    assert got[0] == ("approve", "HIGH", "HIGH") and got[1][0] == "reject" and got[2][0] == "reject"
    assert got[3][0] in ("downgrade", "insufficient_evidence") and got[4][0] == "downgrade" and got[5][0] == "reject"


def test_pooled_gate_prefers_proven_faults():
    ok = {"n": 100, "coverage": 0.7, "off": 0.0}
    all_ = [{"slice": s, **ok} for s in ("thin trim", "held-out trim", "well-observed trim")]
    gate = estimators.PooledGate()
    assert gate.verdict(all_, 1.0, 1.0)[0] == "ACCEPTED" and gate.verdict(all_[1:], 1.0, 1.0)[0] == "UNJUDGEABLE_SLICE"
    assert gate.verdict(all_[1:], 2.0, 1.0)[0] == "REJECTED" and gate.verdict(all_, 1.0, 1.0, population_weighted=True)[0] == "REJECTED"


def test_synthetic_corpus_repeats_and_pools(spark):
    a, b = (estimators.synthetic_corpus(spark, 400, 3).collect() for _ in range(2))
    assert a == b and len({r.model_key for r in a}) > 3
    df = estimators.synthetic_corpus(spark, 3000, 3)
    out = estimators.PartialPooling().fit(df).predict(df)
    inside = out.agg(F.avg(((F.col("price") >= F.col("q1")) & (F.col("price") <= F.col("q4"))).cast("int"))).first()[0]
    assert 0.62 < inside < 0.78 and out.where("q1 > q2 or q2 > q3 or q3 > q4").count() == 0


def test_bootstrap_covers_and_repeats(spark):
    r = random.Random(1)
    rows = [(f"t{i % 40}", 10 + r.random(), 10 + r.random()) for i in range(2000)]
    df = spark.createDataFrame(rows, "t string, a double, b double")
    one, two = (estimators.cluster_bootstrap(x, "t", "a", "b", 500) for x in (df, df.repartition(7)))
    assert all(abs(one[k] - two[k]) < 1e-9 for k in one) and one["low"] < 0.02 and one["high"] > -0.02
    assert estimators.cluster_bootstrap(df.withColumn("a", F.col("b") + 1), "t", "a", "b", 200)["worse"] == 1.0


def test_field_lookup_and_odometer(spark):
    assert quality.may("model", "facet") and not quality.may("model", "gate") and not quality.may("unheard", "card")
    df = spark.createDataFrame([(280, 280_000), (100_000, 101_500), (1, 90_000), (None, 5), (5, None), (None, None)], "a long, b long")
    km, code = quality.reconcile_odometer(F.col("a"), F.col("b"))
    assert [tuple(r) for r in df.select(km, code).collect()] == [(280_000, "in_thousands"), (100_000, "agree"), (None, "disagree"), (5, "shown_only"), (5, "structured_only"), (None, "none")]


@pytest.mark.parametrize("room", [0, 1000])
def test_components(spark, room):
    edges = [(5, 4), (4, 3), (9, 9), (8, 7), (3, 1), (7, 8)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), room=room).collect()}
    assert got == {5: 1, 4: 1, 3: 1, 1: 1, 8: 7, 7: 7}


def test_red_lines_and_provinces(spark):
    from lotscope.operators import ranking

    rows = [(1, "intact", False, "automatic", "تهران", 10, "ok"), (2, "minor_paint", None, None, None, 10, "ok"), (3, "intact", True, "automatic", "تهران", 10, "ok"), (4, "intact", False, "automatic", "یزد", 10, "ok"), (5, "intact", False, "automatic", "تهران", 10, "suspicious"), (6, "intact", False, "manual", "تهران", 10, "ok")]
    df = spark.createDataFrame(rows, "listing_id int, condition string, document_issue boolean, gearbox string, province string, mileage_km long, mileage_status string").withColumns({"price": F.lit(5), "year": F.lit(1400), "model": F.lit("Dena")})
    x = ranking.Intent(max_km=100, provinces=("تهران",), breakers=("unclear_documents", "manual", "repaint"))
    got = {r.listing_id: (r.shelf, list(r.unknown)) for r in ranking.evidence(df, x).collect()}
    assert got == {1: ("matched", []), 5: ("apart", ["mileage"])}
    got = {r.listing_id: list(r.unknown) for r in ranking.evidence(df, ranking.Intent(provinces=("تهران",), breakers=("manual", "unclear_documents"), models=("dena",))).collect()}
    assert got[2] == ["manual", "province", "unclear_documents"] and ranking.evidence(df, ranking.Intent(models=("tara",))).count() == 0


def test_keyed_hash(spark):
    import hashlib
    import hmac

    df = spark.createDataFrame([("سلام",), ("",), (None,)], "t string")
    for key in (b"k", b"x" * 100):
        want = [None if t is None else hmac.new(key, t.encode(), hashlib.sha256).hexdigest() for t in ("سلام", "", None)]
        assert [r[0] for r in df.select(text.hmac_sha256(F.col("t"), key)).collect()] == want


def test_reposts_chain_within_their_window(spark):
    from lotscope.operators import linkage

    day = lambda n: datetime.date(2024, 1, 1) + datetime.timedelta(n)
    base = dict(make="m", model="x", year=1400, trim="t", color="c", province="p", seller="s", mileage_km=1000, price=100, photos=["a", "b", "c"])
    row = lambda i, on, **x: {"listing_id": i, "seen_on": day(on), **base, **x}
    old = spark.createDataFrame([row("a", 0), row("z", 0, model="y"), row("b", 10)])
    new = spark.createDataFrame([row("b", 10), row("c", 20), row("late", 40), row("y2", 5, model="y", seller="o", photos=["q"], province="o")])
    got = {r.listing_id: (r.tracking_id, r.reposts) for r in linkage.reposts(old, new).collect()}
    assert got == {"a": ("a", 2), "b": ("a", 2), "c": ("a", 2), "late": ("late", 0), "z": ("z", 0), "y2": ("y2", 0)}


def test_answers_without_history_or_estimate(spark):
    listings = spark.createDataFrame([("l1", "m|x", 100, "i1"), ("l2", "m|x", 100, "i2")], "listing_id string, model_key string, price long, item string")
    days = spark.createDataFrame([("i1", 9, 8, 1)], "item string, span int, present_days long, unknown_days long")
    events = spark.createDataFrame([("i1", "reposted", 0.8), ("i1", "price_change", None)], "item string, event string, score double")
    comparables = spark.createDataFrame([("l1", "strict", 40, 0.1)], "listing_id string, tier string, n long, dispersion double")
    train = spark.createDataFrame([("m|x", p) for p in range(80, 121)], "model_key string, price long")
    packets = review.evidence_packet(days, events)
    estimates = spark.createDataFrame([("l1", 95.0, 105.0), ("l2", 95.0, 105.0)], "listing_id string, q1 double, q4 double")
    got = {r.listing_id: (r.decision, [f.code for f in r.findings]) for r in review.answers(listings, packets, comparables, estimates, train).collect()}
    assert "repost_link_uncertain" in got["l1"][1] and "weak_comparable_tier" in got["l2"][1] and got["l2"][0] == "insufficient_evidence"
    none = {r.listing_id: r.decision for r in review.answers(listings, packets, comparables, None, train).collect()}
    assert none == {"l1": "reject", "l2": "reject"}


def test_protocols(spark):
    from lotscope import protocols

    assert isinstance(estimators.PartialPooling(), protocols.Estimator) and isinstance(estimators.LogLinear("model_key"), protocols.Estimator)

    class Two:
        name = "two"

        def read(self):
            return spark.range(2)

    assert isinstance(Two(), protocols.SourceAdapter) and protocols.collected([Two()])[0].count() == 2
    df = estimators.synthetic_corpus(spark, 600, 1)
    got = {r.slice: r.n for r in protocols.benchmarked(estimators.PartialPooling(), df.where("listing_id % 5 > 0"), df.where("listing_id % 5 = 0")).collect()}
    assert got["overall"] == 120 and sum(n for s, n in got.items() if s.startswith("km")) == 120
