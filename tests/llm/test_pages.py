from pathlib import Path

import duckdb

from lotscope.llm.html import extract
from lotscope.llm.queries import RULES
from lotscope.llm.urls import url_filter, url_filter_sql

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">menu</a></ul></nav>
<div class="top-ad">Buy</div><article><h1>Head&amp;line</h1><p><b>One&nbsp;two<br><p>thr<i>ee</i> &lt;4&gt; &#233;
 x</p><!-- no <p>no</p> --><form><input value="q">no</form><aside>no</aside><ul><li>a<li>b</ul><div id="comments"><p>no</div></article><footer>&copy; f</footer>"""


def text(spark, page, url="http://h/1"):
    return extract(spark.createDataFrame([(1, url, page)], "page_id long, url string, html string")).first()["text"]


def test_article(spark):
    assert text(spark, PAGE) == "Head&line One two three <4> é x a b"
    assert text(spark, None) == "" and text(spark, "") == ""
    assert text(spark, "<p>a<p>b<div>c</div>d") == "a b c d"
    assert text(spark, "<main>x<script>if (a<b) {'</p>'}</script> y</main><p>z") == "x y"
    assert text(spark, "a <b title='>'>c</b> < d <3 & e") == "a c < d <3 & e"
    assert text(spark, "<article>" * 2000 + "deep") == "deep"
    assert text(spark, '<article><p title="open>a</p></article>') == "a"


def test_marked_parts(spark):
    assert text(spark, "<main><h1>Title</h1><p>Body one.</p><article class=card>teaser</article><p>Body two.</p></main>") == "Title Body one. teaser Body two."
    assert text(spark, "<main><p>x</p><article>The article, which is long</article></main>") == "The article, which is long"
    assert text(spark, '<p class="share-price">up</p><p class="social">club</p><div class="comments-list">no</div><div id="side sidebar_2">no</div><p>on</p>') == "up club on"
    assert text(spark, "a <!-- no > no") == "a" and text(spark, "a <b>c</b> d <e f") == "a c d <e f"


def test_hostile_pages_take_linear_time(spark):
    import time

    from lotscope.llm.html import _Page

    million = 1 << 20
    for page in ("<a " * (million // 3), "x<a '" * (million // 5), "<div>" * (million // 10) + "</x>" * (million // 8), "<!" * (million // 2), "<ul>" * 60_000 + "<hr>" * 60_000, "<b>" * 100_000 + "<p>" * 100_000, "<a ' \"" * (million // 6) + ">", "&" * million):
        began = time.process_time()
        _Page(page, frozenset()).result()
        assert time.process_time() - began < 5, page[:20]


def test_templates_alone_equal_brute_force(spark):
    """Pages without any tag or class that tells: only what recurs on a host goes, by counts taken here in plain Python."""
    import math
    import random
    from collections import Counter

    r = random.Random(3)
    rows, blocks, hosts = [], {}, {}
    for h in range(12):
        n = r.choice([1, 2, 3, 4, 6, 15, 40])
        frame = [(r.choice(["div", "section", "p"]), f"frame {h} {j}", r.choice([1.0, 0.9, 0.6, 0.3])) for j in range(8)]
        for k in range(n):
            i = len(rows)
            mine = [(tag, x) for tag, x, p in frame if r.random() < p] + [("p", f"own {i} {j}") for j in range(3)]
            r.shuffle(mine)
            blocks[i], hosts[i] = mine, h
            rows.append((i, f"http://h{h}.com/{k}", "<div>" + "".join(f"<{tag}>{x}</{tag}>" for tag, x in mine) + "</div>"))
    pages = Counter(hosts.values())
    seen = Counter((hosts[i], b) for i in blocks for b in set(blocks[i]))

    def low(k, n, z=1.96):
        p = k / n
        return (p + z * z / 2 / n - z * math.sqrt(p * (1 - p) / n + z * z / 4 / n / n)) / (1 + z * z / n)

    gone = {hb for hb, k in seen.items() if k > 1 and low(k, pages[hb[0]]) > 0.5}
    want = {i: " ".join(x for t, x in mine if (hosts[i], (t, x)) not in gone) for i, mine in blocks.items()}
    got = {x.page_id: x.text for x in extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    assert got == want and gone and sum(len(w) for w in want.values()) < sum(len(x) for m in blocks.values() for _, x in m)


def test_empty_table_and_clashing_columns(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string, host string, text string, template string")
    assert extract(none).count() == 0
    one = spark.createDataFrame([(1, "http://a/", "<p>x", "h", "t", "m"), (1, "http://a/", "<p>x", "h", "t", "m")], "page_id long, url string, html string, host string, text string, template string")
    assert [(x.host, x.text) for x in extract(one).collect()] == [("a", "x")] * 2


def test_templates_go_by_host(spark):
    rows = [(i, f"http://a.com/{i}", f"<div><p>Own words {i}</p><div>Read more at a</div><p>twice</p></div>") for i in range(20)]
    rows += [(100 + i, f"http://b.com/{i}", f"<div><p>Own words {i}</p><div>Read more at a</div></div>") for i in range(3)]
    rows += [(200, "http://c.com", "<p>same</p>")] * 30 + [(300, None, "<p>x</p>")]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    assert all(got[i] == f"Own words {i}" for i in range(20))
    assert got[101] == "Own words 1 Read more at a" and got[200] == "same" and got[300] == "x"


def test_url_filter_equals_sql(spark, tmp_path):
    link = lambda *h: "".join(f'<A hRef = "{x}">x</a>' for x in h)
    rows = [
        (1, "http://good.org/a?x://", link("https://One.net/x", "//two.net", "/local", "https://good.org/b")), (2, "https://m.example.org/es/1", link("http://two.net/")), (3, "http://example.org/en/12#f", None),
        (4, "http://one.net", link("http://three.net/?q")), (5, "http://two.net/p", link("http://x.com/de/1", "http://x.com")), (6, "http://x.com/de/1", ""), (7, "HTTP://X.com/fr/1", link("http://four.net")), (8, None, link("http://x.com")),
        (9, "nothing", None), (10, "://", None), (11, "http://three.net#://", ""), (12, "http://four.net/", "a"), (13, "http://notexample.org", None), (13, "http://notexample.org", None), (None, "http://org/", None), (15, "http://orgx/", None),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = url_filter(df, RULES)
    names = ["page_id", "host", "path", "rule", "verdict"]
    df.coalesce(1).write.parquet(str(tmp_path / "p"))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{next(Path(tmp_path / 'p').glob('*.parquet'))}'")
    want = con.execute(f"select {', '.join(names)} from ({url_filter_sql(RULES)})").fetchall()
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in got.select(names).collect()), key=key) == sorted(want, key=key)
    verdict = {r.page_id: (r.rule, r.verdict) for r in got.collect()}
    assert verdict[3] == ("example.org/en/1", "block") and verdict[2] == ("example.org/es/", "block") and verdict[13] == (None, "allow") and verdict[None] == ("org/", "allow")
    assert verdict[5] == (None, "block") and verdict[4] == (None, "allow") and verdict[15] == (None, "allow")
    assert url_filter(df.limit(0), RULES).count() == 0


def test_verdicts_of_long_chains(spark):
    rows = [(i, f"http://h{i}.net/", f'<a href="http://h{i + 1}.net/">x</a>') for i in range(12)] + [(12, "http://h12.net/", "")]
    got = url_filter(spark.createDataFrame(rows, "page_id long, url string, html string"), [("block", "h12.net", "/")]).collect()
    assert {r.verdict for r in got} == {"block"}


def test_url_filter_with_clashing_columns_and_long_pages(spark):
    page = '<a href="http://b.net/">x</a>' * 50_000
    df = spark.createDataFrame([(1, "http://a.net/", page, "h", "p", "r", "v"), (2, "http://b.net/", None, "h", "p", "r", "v")], "page_id long, url string, html string, host string, path string, rule string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter(df, [("block", "b.net", "/")]).collect()}
    assert got == {1: ("a.net", "/", None, "block"), 2: ("b.net", "/", "b.net/", "block")}
