"""Main text of web pages by removal of site templates.

Every element's subtree is hashed; Spark counts for each host on how many different pages a hash occurs, and subtrees that
recur on most pages of a host are its template: they go first, wherever they stand. Most means that the lower bound of the share's
confidence interval is above the parameter, so chance repeats on a host of few pages aren't its template: at one half, a
subtree must be on all of four pages, nine of twelve, or sixty of a hundred; a host of three pages or fewer loses nothing by this.
Then goes what HTML itself names as no part of an article (navigation, adverts, forms, scripts, comments of readers, ...). If a
page marks its article or main part, only that counts: the articles, if they hold most of what the main part says, or else that.
Reading takes time in proportion to the page, whatever it holds.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotscope.operators.store import lean, written
from lotscope.llm.urls import host_and_path

# Names of HTML's elements, and words by which pages mark what isn't their article.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var".split())
GONE = set("script style noscript template nav header footer aside form button select option optgroup textarea input iframe object embed svg canvas audio video dialog menu head title datalist fieldset map".split())
MARKED = set("ad ads advert adverts advertisement advertisements advertising banner promo sponsor sponsored notice notices cookie cookies consent gdpr sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments commentlist replies respond disqus".split())
HOLDERS = set("area bar block body box container content inner item items left list main right section slot widget wrap wrapper".split())
ROLES = set("navigation banner contentinfo complementary search form menu menubar toolbar dialog alertdialog alert".split())
CLOSES = {  # an opening tag ends these open ones, up to the nearest of its bounds
    "li": ({"li", "p"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd", "p"}, {"dl"}), "dd": ({"dt", "dd", "p"}, {"dl"}), "tr": ({"tr", "td", "th", "p"}, {"table"}), "td": ({"td", "th", "p"}, {"tr", "table"}), "th": ({"td", "th", "p"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"}),
}
ENDS_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
HOLDS_P = set("article aside blockquote body button caption dd details div dl dt fieldset figure footer form header html li main nav object section table td th ul ol".split())

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>", re.S)
NAMES = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
SPACE = re.compile(r"\s+")
#: Open elements that an opening tag looks through for those it ends; browsers don't nest deeper either.
DEEP = 512


def _marked(words: str) -> bool:
    """Whether one of the class names or ids ends, but for names of holders and numbers, with a word of MARKED: top-ad, comments-list, sidebar_2; not share-price."""
    for word in words.lower().split():
        parts = [x for x in re.split(r"[-_]+", word) if x and not x.isdigit()]
        while len(parts) > 1 and parts[-1] in HOLDERS:
            parts.pop()
        if parts and parts[-1] in MARKED:
            return True
    return False


class _Page:
    """Reads a page in one go: hashes of its subtrees, and its text without what is in `template`."""

    def __init__(self, page: str, template: frozenset[int]):
        self.out: list[str] = []  # texts and, between blocks, " "
        self.hashes: set[int] = set()
        self.template = template
        self.stack: list[list] = []  # tag, hash so far, where its text begins, text before it is no article, holds an article
        self.articles: list[tuple[int, int]] = []
        self.mains: list[tuple[int, int]] = []
        self.gone = 0
        self.names: Counter[str] = Counter()  # of the open elements
        self.core = -1  # where the last marked part begins
        self.read(page)
        while self.stack:
            self.close()

    def read(self, page: str) -> None:
        at, end = 0, page.rfind(">") + 1  # no tag ends behind that
        while at < end:
            m = TAG.search(page, at, end)
            if m is None:
                break
            if m.start() > at:
                self.text(page[at : m.start()])
            if m[2] is None and m[5] is None and m[0].startswith("<!--") and not m[0].endswith("-->"):
                return
            at = m.end()
            name = m[2] or m[5]
            if name is None:
                continue
            name = name.lower()
            if m[1] or m[4]:
                self.end(name)
                continue
            attrs = m[3] if m[2] else m[6]
            self.open(name, attrs)
            if name in RAW:
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
                stop = close.start() if close else len(page)
                if name == "textarea":
                    self.text(page[at:stop])
                elif name in ("script", "style"):
                    self.mix(page[at:stop])
                if close is None:
                    return
                at = stop
        if rest := page[at:].partition("<!--")[0]:
            self.text(rest)

    def mix(self, x: str) -> None:
        if self.stack:
            self.stack[-1][1].update(x)

    def text(self, x: str) -> None:
        x = SPACE.sub(" ", entities.unescape(x) if "&" in x else x)
        self.mix(x)
        if not self.gone:
            self.out.append(x)

    def open(self, name: str, attrs: str) -> None:
        if name in ENDS_P:
            self.until({"p"}, HOLDS_P)
        if name in CLOSES:
            self.until(*CLOSES[name])
        if name not in INLINE:
            self.out.append(" ")
        if name in VOID:
            self.mix(f"<{name}>")
            return
        marks = {a.lower(): b or c or d or "" for a, b, c, d in NAMES.findall(attrs)} if attrs else {}
        h = xxhash.xxh64(f"{name} {marks.get('class', '')} {marks.get('id', '')}")
        words = f"{marks.get('class', '')} {marks.get('id', '')}"
        role = marks.get("role", "").lower()
        core = name in ("article", "main", "body", "html") or role in ("main", "article")
        own_comment = name == "article" and re.search(r"comment|reply", words, re.I)
        bad = bool(name in GONE or own_comment or role in ROLES or "hidden" in marks or marks.get("aria-hidden", "").lower() == "true" or (not core and _marked(words)))
        kind = "article" if name == "article" or role == "article" or marks.get("itemprop", "").lower() == "articlebody" else "main" if name == "main" or role == "main" else ""
        self.stack.append([name, h, len(self.out), bad, kind])
        self.names[name] += 1
        self.gone += bad

    def close(self) -> None:
        name, h, start, bad, kind = self.stack.pop()
        self.names[name] -= 1
        digest = h.intdigest() - (1 << 63)
        self.gone -= bad
        if self.stack:
            self.stack[-1][1].update(f"<{digest}>")
        if name not in INLINE:
            self.out.append(" ")
        if not bad and kind and not self.gone:
            (self.articles if kind == "article" else self.mains).append((start, len(self.out)))
            self.core = max(self.core, start)
        elif name not in INLINE and name not in ("html", "body"):
            self.hashes.add(digest)
            if digest in self.template and self.core < start:
                self.out[start:] = [" "]

    def until(self, names: set[str], bounds: set[str]) -> None:
        """Close the innermost open element of these names, unless a bound stands in between."""
        if not any(self.names[x] for x in names):
            return
        for i in range(len(self.stack) - 1, max(-1, len(self.stack) - 1 - DEEP), -1):
            if self.stack[i][0] in names:
                while len(self.stack) > i:
                    self.close()
                return
            if self.stack[i][0] in bounds:
                return

    def end(self, name: str) -> None:
        for i in () if not self.names[name] else range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == name:
                while len(self.stack) > i:
                    self.close()
                return
        if name not in INLINE:
            self.out.append(" ")

    def result(self) -> str:
        def said(spans: list[tuple[int, int]]) -> str:
            parts, done = [], 0
            for a, b in sorted(spans):
                parts += [" ", *self.out[max(a, done) : b]]
                done = max(done, b)
            return SPACE.sub(" ", "".join(parts)).strip()

        articles, mains = said(self.articles), said(self.mains)
        if self.articles and 2 * len(articles) >= len(mains):
            return articles
        return mains if self.mains else said([(0, len(self.out))])


def subtrees(pages: DataFrame) -> DataFrame:
    """(host, page, hash): each different subtree of each page once; page stands for the page's html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, keys, hashes = [], [], []
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if (x := page.as_py()) is not None:
                    got = _Page(x, frozenset()).hashes
                    hosts += [host] * len(got)
                    keys += [xxhash.xxh64_intdigest(x) - (1 << 63)] * len(got)
                    hashes += got
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(keys, pa.int64()), pa.array(hashes, pa.int64())], ["host", "page", "hash"])

    return pages.select(host_and_path()[0].alias("host"), "html").mapInArrow(lean(run), "host string, page long, hash long")


def templates(pages: DataFrame, share: float, z: float) -> DataFrame:
    """(host, template): the hashes that recur on more than `share` of the host's different pages, by the lower end of Wilson's interval at `z`.

    As each stands on more than that share of the pages, a host has at most 1 / `share` times as many as an average page has subtrees.
    """
    found = written(subtrees(pages), "subtrees").distinct()
    counts = found.groupBy("host", "hash").agg(F.count("*").alias("n")).where("n > 1")
    hosts = found.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    p = F.col("n") / F.col("pages")
    low = (p + z * z / (2 * F.col("pages")) - z * F.sqrt(p * (1 - p) / F.col("pages") + z * z / (4 * F.col("pages") * F.col("pages")))) / (1 + z * z / F.col("pages"))
    return counts.join(hosts, "host").where(low > share).groupBy("host").agg(F.collect_list("hash").alias("template"))


def extract(pages: DataFrame, share: float = 0.5, z: float = 1.96) -> DataFrame:
    """(page_id, url, host, text) for each row of `pages` (page_id, url, html; other columns are ignored).

    Null and empty html has an empty text. White space becomes one space, blocks are joined by one space, references are decoded.
    Repeated rows count as one page of their host; urls that are null or have no host share the empty one. Very long pages are read as they are.
    An empty table gives an empty result.
    """
    known = written(templates(pages, share, z), "templates")
    urls = pages.select("page_id", "url", host_and_path()[0].alias("host"), "html").join(known, "host", "left").select("page_id", "url", "host", "template", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for page, template in zip(batch.column("html"), batch.column("template"), strict=True):
                x = page.as_py()
                texts.append(_Page(x, frozenset(template.as_py() or ())).result() if x else "")
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(texts, pa.string())], ["page_id", "url", "host", "text"])

    kinds = dict(urls.dtypes)
    return urls.mapInArrow(lean(run), f"page_id {kinds['page_id']}, url string, host string, text string")
