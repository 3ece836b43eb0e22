"""Listings out of web pages: cards, structured nodes, streamed rows and nested results; which urls are listings, and what robots files allow.

Pages are read in Arrow batches with the standard library's parser; everything after that is columns.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOID = set("area base br col embed hr img input link meta param source track wbr".split())


class _Cards(HTMLParser):
    """The text and first link of each element that `is_card` names; a card inside a card belongs to the outer one."""

    def __init__(self, is_card: Callable[[str, dict], bool]):
        super().__init__(convert_charrefs=True)
        self.is_card, self.cards = is_card, []
        self.open, self.within, self.mute = None, [], 0

    def handle_starttag(self, tag, attrs):
        at = dict(attrs)
        if self.open is None and self.is_card(tag, at):
            self.open, self.within, self.mute = {"url": None, "text": []}, [], 0
        if self.open is None:
            return
        if tag == "a" and self.open["url"] is None:
            self.open["url"] = at.get("href")
        if tag in ("script", "style"):
            self.mute += 1
        if tag not in VOID:
            self.within.append(tag)

    def handle_endtag(self, tag):
        if self.open is None or tag not in self.within:
            return
        if tag in ("script", "style"):
            self.mute = max(0, self.mute - 1)
        while self.within.pop() != tag:  # elements left open end with what holds them
            pass
        if not self.within:
            self.done()

    def done(self):
        if self.open is not None:
            self.cards.append((self.open["url"], " ".join(" ".join(self.open["text"]).split())))
            self.open = None

    def handle_data(self, data):
        if self.open is not None and not self.mute:
            self.open["text"].append(data)


def cards(html: str, tag: str, **attrs: str) -> list[tuple[str | None, str]]:
    """(url, text) of every element `tag` whose attributes hold the given words: class_="post-card" is one of its classes."""
    want = {k.rstrip("_").replace("_", "-"): v for k, v in attrs.items()}
    reader = _Cards(lambda t, at: t == tag and all(v in (at.get(k) or "").split() for k, v in want.items()))
    reader.feed(html or "")
    reader.close()
    reader.done()
    return reader.cards


def jsonld_nodes(html: str, types: set[str]) -> list[dict]:
    """Every node of the page's JSON-LD blocks, at any depth and in any graph or list, whose type or one of whose types is asked for. A block that is no JSON is skipped."""
    out: list[dict] = []
    for block in re.findall(r"<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>", html or "", re.S | re.I):
        try:
            todo = [json.loads(block)]
        except ValueError:
            continue
        while todo:
            x = todo.pop(0)
            if isinstance(x, dict):
                kind = x.get("@type")
                if types & set(kind if isinstance(kind, list) else [kind]):
                    out.append(x)
            todo[:0] = list(x.values()) if isinstance(x, dict) else x if isinstance(x, list) else []
    return out


def stream_rows(html: str) -> dict[str, object]:
    """The rows of a page whose data comes as pushes of text: pushes joined, split into lines id:payload, those that are JSON decoded."""
    text = ""
    for push in re.findall(r"self\.__next_f\.push\((\[.*?\])\)\s*</script>", html or "", re.S):
        try:
            got = json.loads(push)
        except ValueError:
            continue
        if len(got) > 1 and isinstance(got[1], str):
            text += got[1]
    rows: dict[str, object] = {}
    for line in text.split("\n"):
        name, colon, payload = line.partition(":")
        if not colon or not re.fullmatch(r"[0-9a-f]+", name):
            continue
        try:
            rows[name] = json.loads(payload)
        except ValueError:
            rows[name] = payload
    return rows


def nested_results(data: object, key: str = "results", needs: tuple[str, ...] = ("slug", "car_properties")) -> list[dict]:
    """The entries of every list under `key`, at any depth, that hold all of `needs`; without recursion, so depth is no limit."""
    out, todo = [], [data]
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            found = x.get(key)
            if isinstance(found, list):
                out += [e for e in found if isinstance(e, dict) and all(n in e for n in needs)]
            todo += list(x.values())
        elif isinstance(x, list):
            todo += x
    return out


def extracted(pages: DataFrame, reader: Callable[[str], list], key: str = "page_id") -> DataFrame:
    """(key, place, record): what a reader of this module finds on each page, each record as JSON. A null page has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, places, records = [], [], []
            for i, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for n, r in enumerate(reader(html.as_py()) if html.as_py() else []):
                    ids.append(i), places.append(n), records.append(json.dumps(r, ensure_ascii=False, sort_keys=True))
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(places, pa.int32()), pa.array(records, pa.string())], [key, "place", "record"])

    return pages.select(key, "html").mapInArrow(run, f"{key} {dict(pages.dtypes)[key]}, place int, record string")


def url_kind(url: Column, listing: str = r"/(?:car|detail|v)/[^/?#]+", category: str = r"/(?:car|s)/?$") -> Column:
    """listing, category or other, by the path."""
    path = F.regexp_extract(url, r"^(?:[a-z]+://[^/?#]+)?([^?#]*)", 1)
    return F.when(path.rlike(listing), "listing").when(path.rlike(category), "category").otherwise("other")


def slug(url: Column) -> tuple[Column, Column]:
    """(id, name) of a listing's url: the last part of its path, split at its first hyphen when what stands before is an id of letters and digits."""
    last = F.regexp_extract(url, r"([^/?#]+)/?(?:[?#].*)?$", 1)
    head = F.regexp_extract(last, r"^([a-z0-9]{6,12})(?:-|$)", 1)
    return F.nullif(head, F.lit("")), F.nullif(F.regexp_extract(last, r"^[a-z0-9]{6,12}-(.+)$", 1), F.lit(""))


def robots_rules(text: str, agent: str) -> list[tuple[str, str]]:
    """(allow or disallow, pattern) for an agent: of all groups that name it, or else of those that name everybody. Groups of the same agent are one."""
    groups: list[tuple[set[str], list[tuple[str, str]]]] = []
    naming = False
    for line in (text or "").splitlines():
        field, colon, value = line.split("#", 1)[0].partition(":")
        field, value = field.strip().lower(), value.strip()
        if not colon:
            continue
        if field == "user-agent":
            if not naming:
                groups.append((set(), []))
            groups[-1][0].add(value.lower())
            naming = True
        elif field in ("allow", "disallow"):
            naming = False
            if groups and value:
                groups[-1][1].append((field, value))
    own = [r for names, rules in groups if any(n != "*" and agent.lower().startswith(n) for n in names) for r in rules]
    named = any(n != "*" and agent.lower().startswith(n) for names, _ in groups for n in names)
    return own if named else [r for names, rules in groups if "*" in names for r in rules]


def _pattern(rule: str) -> str:
    end = rule.endswith("$")
    body = ".*".join(re.escape(x).replace("\\/", "/") for x in rule.removesuffix("$").split("*"))
    return f"^{body}{'$' if end else ''}"


def robots_allow(path: Column, status: int, text: str, agent: str) -> Column:
    """Whether a path may be fetched: the longest matching rule decides, allow where two are as long. A missing file allows all, one that can't be read now nothing."""
    if 400 <= status < 500 and status != 429:
        return F.lit(True)
    if status != 200:
        return F.lit(False)
    longest = {"allow": F.lit(-1), "disallow": F.lit(-1)}
    for kind, rule in robots_rules(text, agent):
        longest[kind] = F.greatest(longest[kind], F.when(path.rlike(_pattern(rule)), len(rule)).otherwise(-1))
    return longest["allow"] >= longest["disallow"]
