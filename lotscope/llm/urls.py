"""URL filter by link-graph propagation, in DataFrame operations only.

Rules judge urls by host and path. Hosts with allowed pages are trusted seeds, hosts with blocked pages distrusted ones, each by
its number of such pages. Trust flows along links from host to host (personalised PageRank); distrust flows against
them, to hosts that link to blocked ones. A url without a rule gets its host's verdict: block if distrust
is more than `block_at` of what reaches the host, else allow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotscope.operators.store import Table, written

#: Hosts that absolute links lead to.
LINK = r"""(?i)href[ \t\n\r\f]*=[ \t\n\r\f]*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'<> \t\n\r\f]+)"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    at = F.coalesce(F.locate("://", F.col(url)), F.lit(0))
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _judged(rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; both null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _spread(seeds: DataFrame, edges: DataFrame, rounds: int | None, damping: float) -> DataFrame:
    """(host, score): `rounds` steps of personalised PageRank from seeds (host, weight) over edges (src, dst, share); what hosts without links hold returns to the seeds."""
    total = seeds.agg(F.sum("weight").alias("w")).first()["w"]
    seeds = seeds.select("host", (F.col("weight") / F.lit(float(total or 1))).alias("seed"))
    now = Table(seeds.withColumnRenamed("seed", "score"), "rank")
    out = edges.select(F.col("src").alias("host")).distinct()
    done = 0
    while rounds is None or done < rounds:
        passed = now.df.join(out, "host", "left_semi").agg(F.sum("score").alias("s")).first()["s"] or 0.0
        back = 1 - damping + damping * (1 - passed)
        flow = now.df.join(edges, F.col("host") == F.col("src")).select(F.col("dst").alias("host"), (F.col("score") * F.col("share") * damping).alias("score"))
        after = Table(flow.union(seeds.select("host", (F.col("seed") * back).alias("score"))).groupBy("host").agg(F.sum("score").alias("score")), "rank")
        # Settled: no host is new, and what moves in a round is below 1e-9 of the mass.
        moved = None
        if rounds is None:
            both = after.df.join(now.df.withColumnRenamed("score", "old"), "host", "full")
            moved = both.agg(F.count_if(F.col("old").isNull()).alias("new"), F.sum(F.abs(F.coalesce("score", F.lit(0.0)) - F.coalesce("old", F.lit(0.0)))).alias("by")).first()
        now.drop()
        now, done = after, done + 1
        if moved is not None and not moved["new"] and (moved["by"] or 0.0) < 1e-9:
            break
    return now.df


def url_filter(pages: DataFrame, rules: list[tuple[str, str, str]], rounds: int | None = None, damping: float = 0.85, block_at: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for each row of `pages` (page_id, url, html; other columns are ignored).

    `rules`: (allow or block, host, path); they become one expression, so there should be at most some hundreds. Urls that are
    null or have no :// have an empty host and path, and the verdict of that host. Links inside a host, and of null html, count nothing.
    An empty table gives an empty result. Scores spread until they settle, or for so many `rounds`.
    """
    host, path = host_and_path()
    urls = pages.select("page_id", "html", host.alias("host"), path.alias("path"))
    rule, verdict = _judged(rules)
    urls = urls.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), "html")
    plain = urls.drop("html")
    links = urls.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("dst"))
    links = links.select("src", F.translate("dst", _UPPER, _LOWER).alias("dst")).where("src <> dst and src <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))
    links = written(links, "links")
    seeds = written(plain.where("ruled is not null").groupBy("host").agg(F.count_if(F.col("ruled") == "allow").alias("good"), F.count_if(F.col("ruled") == "block").alias("bad")), "seeds")

    def scores(column: str, edges: DataFrame) -> DataFrame:
        degree = edges.groupBy("src").agg(F.sum("n").alias("all"))
        shares = edges.join(degree, "src").select("src", "dst", (F.col("n") / F.col("all")).alias("share"))
        # Without links scores stay where they start.
        return _spread(seeds.where(F.col(column) > 0).select("host", F.col(column).alias("weight")), written(shares, "shares"), rounds if some else 0, damping)

    some = links.first() is not None
    trust = scores("good", links)
    distrust = scores("bad", links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    both = trust.withColumnRenamed("score", "trust").join(distrust.withColumnRenamed("score", "distrust"), "host", "full")
    both = both.select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
    out = plain.join(both, "host", "left").select("page_id", "host", "path", "rule", "ruled", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
    own = F.when(F.col("distrust") > block_at * (F.col("trust") + F.col("distrust")), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "trust", "distrust")


def url_filter_sql(rules: list[tuple[str, str, str]], rounds: int = 8, damping: float = 0.85, block_at: float = 0.5) -> str:
    """The same, without the scores, as one DuckDB statement over `pages`."""
    text = lambda x: "'" + x.replace("'", "''") + "'"
    low = f"translate({{}}, '{_UPPER}', '{_LOWER}')"
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = [f"when (host = {text(h)} or ends_with(host, {text('.' + h)})) and starts_with(path, {text(p)}) then " for _, h, p in ordered]
    rule = "case " + " ".join(f + text(h + p) for f, (_, h, p) in zip(fits, ordered, strict=True)) + " end"
    verdict = "case " + " ".join(f + text(v) for f, (v, _, _) in zip(fits, ordered, strict=True)) + " end"
    ctes = [
        "cut as (select page_id, html, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest from pages)",
        f"urls as (select page_id, html, {low.format("regexp_extract(rest, '^([^/?#]*)', 1)")} as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from cut)",
        f"judged as (select page_id, html, host, path, {rule} as rule, {verdict} as ruled from urls)",
        f"found as (select host as src, unnest(regexp_extract_all(html, {text(LINK)}, 1)) as dst from judged)",
        f"links as (select src, dst, count(*) as n from (select src, {low.format('dst')} as dst from found) where src <> dst and src <> '' group by all)",
    ]
    for name, what, a, b in (("t", "allow", "src", "dst"), ("d", "block", "dst", "src")):
        ctes += [
            f"{name}e as (select {a} as src, {b} as dst, n / sum(n) over (partition by {a}) as share from links)",
            f"{name}s as (select host, count(*) / sum(count(*)) over () as seed from judged where ruled = '{what}' group by host)",
            f"{name}0 as (select host, seed as score from {name}s)",
        ]
        for k in range(rounds):
            back = f"{1 - damping} + {damping} * (1 - coalesce((select sum(score) from {name}{k} where host in (select src from {name}e)), 0))"
            ctes.append(f"{name}{k + 1} as (select host, sum(score) as score from (select dst as host, score * share * {damping} as score from {name}{k} join {name}e on host = src union all select host, seed * ({back}) from {name}s) group by host)")
    own = f"case when coalesce(d.score, 0) > {block_at} * (coalesce(t.score, 0) + coalesce(d.score, 0)) then 'block' else 'allow' end"
    return f"with {', '.join(ctes)} select page_id, j.host as host, path, rule, coalesce(ruled, {own}) as verdict from judged j left join t{rounds} t on j.host = t.host left join d{rounds} d on j.host = d.host"
