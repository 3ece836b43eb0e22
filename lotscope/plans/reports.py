"""Registered queries of reports, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotscope.operators import quality, ranking, reports, summary
from lotscope.plans.market import GRADED, ROWS, graded, rounded
from lotscope.plans.views import listings, table
from lotscope.sources import pages

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def runs(spark, d):
    """Orders as a log of runs."""
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        k.alias("run_id"), F.col("o_orderstatus").alias("source"), F.to_date("o_orderdate").alias("day"), (F.floor("o_totalprice").cast("long") % 5000 - 10).alias("took"),
        F.when(k % 11 == 0, "robots").when(k % 13 == 0, "error").otherwise("collected").alias("outcome"), F.when(k % 4 != 0, F.col("o_orderpriority")).alias("robots"), (F.col("o_custkey") % 3).alias("pages"), F.when(k % 5 != 0, F.floor(F.col("o_totalprice") / 1000).cast("long")).alias("listings"),
    )


RUNS = """with runs as (select o_orderkey as run_id, o_orderstatus as source, cast(o_orderdate as date) as day, cast(floor(o_totalprice) as bigint) % 5000 - 10 as took, case when o_orderkey % 11 = 0 then 'robots' when o_orderkey % 13 = 0 then 'error' else 'collected' end as outcome,
case when o_orderkey % 4 <> 0 then o_orderpriority end as robots, o_custkey % 3 as pages, case when o_orderkey % 5 <> 0 then cast(floor(o_totalprice / 1000) as bigint) end as listings from orders)"""


@query(f"{RUNS}, p as (select day, source, max(took) as t from runs where outcome = 'collected' and took >= 0 group by all) select day, count(*) as sources, sum(t)::bigint as one_after_another, max(t) as side_by_side from p group by day")
def ops_run_days(spark, d):
    return reports.run_days(runs(spark, d))


ALERTS = f"""{RUNS}, s as (select *, last_value(robots ignore nulls) over (partition by source order by day, run_id rows between unbounded preceding and 1 preceding) as was from runs),
c as (select *, count(listings) over w as n, median(listings) over w as mid from runs where outcome = 'collected' and listings is not null window w as (partition by source, pages order by day, run_id rows between 7 preceding and 1 preceding)),
a as (select 'stopped' as kind, source, run_id from runs where outcome <> 'collected' union all select 'robots', source, run_id from s where robots is not null and was is not null and robots <> was union all select 'count', source, run_id from c where n >= 3 and not (listings between 0.5 * mid and 1.5 * mid)),
alerts as (select kind || ':' || run_id as key, source, cast(run_id as varchar) as run_id, kind from a)"""


@query(f"{ALERTS} select * from alerts")
def ops_run_alerts(spark, d):
    return reports.alerts(runs(spark, d))


@query(f"{ALERTS} select key, source, run_id, kind from alerts where key not in (select 'stopped:' || o_orderkey from orders where o_orderstatus = 'F')")
def ops_alerts_said_once(spark, d):
    """Alerts are reported twice here, and those of one source were said before."""
    found = reports.alerts(runs(spark, d))
    said = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.concat(F.lit("stopped:"), F.col("o_orderkey").cast("string")).alias("key"))
    return reports.unsaid(found.union(found), said)


@query(f"{RUNS}, e as (select distinct source from runs), t as (select distinct day from runs) select 'missing:' || e.source || ':' || t.day as key, e.source as source, t.day as day from e, t where not exists (select 1 from runs r where r.source = e.source and r.day = t.day)")
def ops_missing_runs(spark, d):
    r = runs(spark, d)
    return reports.missing(r, r.select("source").distinct(), r.select("day").distinct())


@query("with c as (select user_id, sum(value) as v, count(*) as n from events group by 1), p as (select a.user_id as a, b.user_id as b, a.v as va, b.v as vb, a.n as na, b.n as nb from c a join c b on b.user_id = a.user_id + 1 where a.n <> b.n) select a, case when va > 0 and vb > 0 then round(ln(vb / va) / ln(nb / na), 6) end as slope from p")
def ops_loglog_slope(spark, d):
    c = table(spark, d, "events").groupBy("user_id").agg(F.sum("value").alias("v"), F.count("*").alias("n"))
    x, y = c.select(F.col("user_id").alias("a"), F.col("v").alias("va"), F.col("n").alias("na")), c.select((F.col("user_id") - 1).alias("a"), F.col("v").alias("vb"), F.col("n").alias("nb"))
    both = x.join(y, "a").where("na <> nb")
    return rounded(both.select("a", reports.loglog_slope(F.col("va"), F.col("vb"), F.col("na"), F.col("nb")).alias("slope")), "slope")


@query(f"""with {GRADED}, a as (select listing_id, bool_or(len(reasons) = 0) as e from graded group by 1), b as (select listing_id, bool_or(coalesce(len(reasons) = 0 and mileage_km < 900000, false) or cluster_id % 29 = 0) as e from graded where cluster_id % 31 <> 0 group by 1)
select (select count_if(e) from a) as "before", (select count_if(a.e and not coalesce(b.e, false)) from a left join b using (listing_id)) as lost, (select count_if(not a.e and coalesce(b.e, false)) from a left join b using (listing_id)) as gained, (select count_if(e) from b) as "after\"""")
def tracking_eligibility_changes(spark, d):
    before = graded(spark, d)
    after = before.where("cluster_id % 31 <> 0").withColumn("eligible", (F.col("eligible") & (F.col("mileage_km") < 900_000)) | (F.col("cluster_id") % 29 == 0))
    return reports.eligibility_changes(before, after, "listing_id")


@query(f"""{ROWS}, a0 as (select listing_id as id, model, price, trim from listings), b0 as (select * from a0 where price is null or price % 3 <> 0), c0 as (select id, case when price % 2 = 0 then model end as model, price, null::varchar as trim from b0), a as (select id, max(model) as model, max(price) as price, max(trim) as trim from a0 group by 1), b as (select id, max(model) as model, max(price) as price, max(trim) as trim from b0 group by 1), c as (select id, max(model) as model, max(price) as price, max(trim) as trim from c0 group by 1), j as (select a.model as am, a.price as ap, a.trim as at_, b.model as bm, b.price as bp, b.trim as bt, c.model as cm, c.price as cp, c.trim as ct from a left join b using (id) left join c using (id))
select 'model' as field, count(am) as parsed, count(bm) as snapshot, count(cm) as published, count_if(am is not null and cm is null) as lost from j union all select 'price', count(ap), count(bp), count(cp), count_if(ap is not null and cp is null) from j union all select 'trim', count(at_), count(bt), count(ct), count_if(at_ is not null and ct is null) from j""")
def tracking_field_survival(spark, d):
    parsed = listings(spark, d).withColumn("listing_id", F.translate("listing_id", ":", "-"))
    snapshot = parsed.where("price is null or price % 3 <> 0").withColumn("listing_id", F.concat(F.lit("src:"), "listing_id"))
    published = snapshot.withColumn("model", F.when(F.col("price") % 2 == 0, F.col("model"))).withColumn("trim", F.lit(None).cast("string"))
    return reports.field_survival(parsed, snapshot, published, ["model", "price", "trim"])


@query(f"{ROWS}, k as (select cluster_id, count(distinct source) as n from listings group by 1), x as (select count(*) as in_any, count_if(n = (select count(distinct source) from listings)) as in_all from k) select in_any, in_all, round(in_all / in_any, 6) as share, in_all / in_any > 0.8 as same from x")
def tracking_arm_overlap(spark, d):
    return rounded(reports.arm_overlap(listings(spark, d), "source", "cluster_id"), "share")


@query(f"{ROWS} select cluster_id from listings group by 1 having count(distinct source) = (select count(distinct source) from listings)")
def tracking_in_every_arm(spark, d):
    return reports.intersect_all(listings(spark, d), "source", "cluster_id")


@query("""with x as (select cast(event_id % 17 as bigint) as age, case when event_id % 3 = 0 then event_id % 11 end as p from events where event_id % 7 <> 0), y as (select 'title age' as binned_by, case when age <= 6 then '0-6' else '7+' end as bin, p from x union all select 'phrase', case when coalesce(p, age) <= 6 then '0-6' else '7+' end, p from x)
select binned_by, bin, count(p) as shown, count(*) - count(p) as not_shown from y group by 1, 2""")
def tracking_date_tables(spark, d):
    n = F.col("event_id")
    return reports.date_tables(table(spark, d, "events").select(F.when(n % 7 != 0, n % 17).alias("age"), F.when(n % 3 == 0, n % 11).alias("phrase_days")))


@query(f"{ROWS} select 'value' as term, count(price) as present, count(distinct price) as \"distinct\", count(distinct price) > 1 as live from listings union all select 'mileage', count(mileage_km), count(distinct mileage_km), count(distinct mileage_km) > 1 from listings union all select 'liquidity', 0, 0, false union all select 'owning', count(*), 1, false from listings")
def ranking_term_liveness(spark, d):
    return reports.term_liveness(listings(spark, d), {"value": F.col("price"), "mileage": F.col("mileage_km"), "liquidity": F.lit(None).cast("double"), "owning": F.lit(0.5)})


@query(f"""{ROWS}, s as (select make, trim, count_if(year <= 1997) as a, count(*) as b from listings where trim is not null group by all)
select make, sum(a)::bigint as n_before, sum(b)::bigint as n_after, count_if(a > 0) as trims_before, count(*) as trims_after, round(coalesce(sum(case when a >= 5 then a else 0 end) / nullif(sum(a), 0), 0), 6) as covered_before, round(sum(case when b >= 5 then b else 0 end) / sum(b), 6) as covered_after,
sum(case when b >= 5 then b else 0 end) / sum(b) > coalesce(sum(case when a >= 5 then a else 0 end) / nullif(sum(a), 0), 0) + 0.005 as deeper from s group by make""")
def sampling_depth_change(spark, d):
    df = listings(spark, d)
    return rounded(reports.depth_change(df.where("year <= 1997"), df, "make", "trim"), "covered_before", "covered_after")


@query(f"{ROWS} select listing_id, price from listings order by price is null, price, listing_id limit 24 offset 48")
def ranking_price_page(spark, d):
    """The third page of the price list."""
    return reports.page(listings(spark, d).select("listing_id", "price"), reports.by_price(), 24, 2)


@query(f"with {GRADED} select reason, count(*) as n from (select unnest(reasons) as reason from graded) group by 1 order by n desc, reason limit 3")
def quality_top_reasons(spark, d):
    return reports.most_common(graded(spark, d).select(F.explode("reasons").alias("reason")), "reason", 3)


@query("with a(place, p_partkey) as (values (1, 7), (2, 3), (3, 999999999), (4, 3)) select place, a.p_partkey::bigint as p_partkey, p_name, p.p_partkey is not null as found from a left join part p on a.p_partkey = p.p_partkey")
def ranking_compare_requested(spark, d):
    return reports.in_request_order(table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey", [7, 3, 999_999_999, 3]).select("place", "p_partkey", "p_name", "found")


@query("select 'x' || p_partkey || '-' || i as source_id, p_partkey as tracking_id from part, range(3) t(i) where ('x' || p_partkey || '-' || i) in (select 'x' || l_partkey || '-' || l_linenumber from lineitem)")
def tracking_find_by_source_id(spark, d):
    ids = F.array(*(F.concat(F.lit("x"), F.col("p_partkey").cast("string"), F.lit(f"-{i}")) for i in range(3)))
    tracked = table(spark, d, "part").select(F.col("p_partkey").alias("tracking_id"), ids.alias("source_ids"))
    asked = table(spark, d, "lineitem").select(F.concat(F.lit("x"), F.col("l_partkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("source_id"))
    return reports.found_by_source_id(tracked, asked)


@query("""with x as (select l_orderkey, l_linenumber, case when l_linenumber <> 1 then cast(l_quantity * 1000 as bigint) end as s, case when l_linenumber = 2 then null when l_linenumber = 3 then cast(l_quantity as bigint) when l_linenumber = 4 then cast(l_quantity * 1000 + 900 as bigint) else cast(l_quantity * 1100 as bigint) end as g from lineitem),
y as (select *, greatest(1000, s * 0.02) as tol from x)
select l_orderkey, l_linenumber, case when s is null then g when g is null or abs(g - s) <= tol or (g > 0 and abs(g * 1000 - s) <= tol) then case when g is not null and abs(g - s) <= tol then g else s end end as km,
case when s is null and g is null then 'none' when s is null then 'structured_only' when g is null then 'shown_only' when abs(g - s) <= tol then 'agree' when g > 0 and abs(g * 1000 - s) <= tol then 'in_thousands' else 'disagree' end as code from y""")
def quality_reconciled_odometer(spark, d):
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    shown = F.when(n != 1, (q * 1000).cast("long"))
    given = F.when(n == 2, F.lit(None)).when(n == 3, q.cast("long")).when(n == 4, (q * 1000 + 900).cast("long")).otherwise((q * 1100).cast("long"))
    km, code = quality.reconcile_odometer(given, shown)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", km.alias("km"), code.alias("code"))


@query(f"with {GRADED} select listing_id, case when price > 0 and price_status = 'ok' and (price_kind is null or price_kind = 'cash') then price end as price from graded")
def quality_priced(spark, d):
    return graded(spark, d).select("listing_id", quality.priced(F.col("price"), F.col("price_status"), F.col("price_kind")).alias("price"))


@query(f"""{ROWS} select listing_id, case when condition is not null then case condition when 'intact' then 0.05 when 'minor_paint' then 0.2 when 'multi_paint' then 0.5 when 'replaced_part' then 0.65 when 'accident' then 0.85 else 0.35 end end::double as risk, case when condition is not null then case when condition = 'accident' then 1.0 else 0.0 end end::double as has_accident,
case when price_kind = 'negotiable' then 1.0 end::double as has_unclear_documents, case when condition = 'unknown' then 'risk' else '' end as imputed from listings""")
def ranking_features(spark, d):
    df = listings(spark, d).withColumn("document_issue", F.col("price_kind") == "negotiable")
    return ranking.features(df).select("listing_id", "risk", "has_accident", "has_unclear_documents", F.array_join("imputed", ",").alias("imputed"))


@query(f"""{ROWS}, x as (select *, case when cluster_id % 3 = 0 then 0.5::double end as owning, case when cluster_id % 2 = 0 then 7 else 0 end as seen, case when cluster_id % 5 = 0 then price * 1.1::double end as middle from listings)
select listing_id, array_to_string(list_filter([case when middle is null or price is null then 'price_delta_to_estimate' end, case when condition is null then 'risk_score' end, case when owning is null then 'running_cost_signals' end, 'reliability_signals', case when seen = 0 then 'recency' end], lambda v: v is not null), ',') as missing,
case when condition = 'unknown' then 'risk_score' else '' end as imputed, round((8 - 1 - case when middle is null or price is null then 1 else 0 end - case when condition is null then 1 else 0 end - case when owning is null then 1 else 0 end - case when seen = 0 then 1 else 0 end - case when condition = 'unknown' then 1 else 0 end) / 8.0, 6) as completeness,
round(middle - price, 2) as price_delta_to_estimate from x""")
def ranking_decision_ledger(spark, d):
    df = listings(spark, d).withColumns({"document_issue": F.lit(False), "ownership_risk": F.when(F.col("cluster_id") % 3 == 0, 0.5), "liquidity": F.lit(None).cast("double"), "first_seen_ordinal": F.when(F.col("cluster_id") % 2 == 0, 7).otherwise(0), "middle": F.when(F.col("cluster_id") % 5 == 0, F.col("price") * 1.1)})
    out = ranking.decision_ledger(ranking.features(df), ranking.Intent()).select("listing_id", F.array_join("missing", ",").alias("missing"), F.array_join("imputed_labels", ",").alias("imputed"), "completeness", "price_delta_to_estimate")
    return rounded(rounded(out, "completeness"), "price_delta_to_estimate", digits=2)


def _reweighted() -> str:
    from lotscope.plans.appraisal import SCORED

    w = [("opportunity", 0.30), ("risk", -0.25), ("owning", -0.22), ("liquidity", 0.08), ("mileage_km", -0.12), ("recency", 0.03)]
    terms = " + ".join(f"({v}) * case when hi_{c} - lo_{c} < 1e-9 then 0.5 else ({c} - lo_{c}) / (hi_{c} - lo_{c}) end" for c, v in w)
    return f"{ROWS}, {SCORED} select listing_id, round({terms}, 6) as score from o join e on query = q"


@query(_reweighted())
def ranking_reweighted(spark, d):
    """Scores under a preset's weights, from kept terms."""
    from lotscope.functions.intent import PRESETS
    from lotscope.plans.appraisal import candidates

    kept = ranking.score(candidates(spark, d), ranking.Intent())
    return rounded(ranking.reweighted(kept, PRESETS["commute"]), "score")


@query(f"""with {GRADED}, mid as (select make, model, count(price) as c, quantile_cont(cast(price as double), 0.5) as m from graded where price is not null group by all), f as (select g.*, coalesce(c >= 3 and (price >= 5 * m or 5 * price <= m), false) as far from graded g left join mid on g.make is not distinct from mid.make and g.model is not distinct from mid.model)
select listing_id, case when far then 'far_from_group' else price_status end as price_status, len(reasons) = 0 and not far as eligible from f""")
def quality_far_price_status(spark, d):
    """Far prices by the policy's own numbers lose their status and with it their place among eligible listings."""
    return quality.without_far_prices(graded(spark, d), ["make", "model"]).select("listing_id", "price_status", "eligible")


@query(f"""{ROWS}, c as (select source, run_id, cluster_id % 7 as depth, count(*) as n from listings group by all), u as (select *, case when count(n) over w >= 3 then quantile_cont(cast(n as double), 0.5) over w end as usual from c window w as (partition by source, depth order by run_id rows between 7 preceding and 1 preceding))
select source, run_id, depth, n, usual, coalesce(n < 0.5 * usual or n > 1.5 * usual, false) as odd from u""")
def ops_volume_policy(spark, d):
    """Runs against those before them that went as deep, by the policy's own bounds."""
    counts = listings(spark, d).groupBy("source", "run_id", (F.col("cluster_id") % 7).alias("depth")).agg(F.count("*").alias("n"))
    return summary.volume_anomalies(counts, ["source", "depth"], "run_id")


@query("with x as (select page_id, regexp_extract_all(html, '<li><a href=\"([^\"]*)\">', 1) as u, regexp_extract_all(html, '<li><a href=\"[^\"]*\">([^<]*)</a></li>', 1) as t from pages where html is not null) select page_id, i - 1 as place, u[i] as url, trim(replace(replace(replace(t[i], '&lt;', '<'), '&gt;', '>'), '&amp;', '&')) as text from (select *, unnest(range(1, len(u) + 1)) as i from x)")
def sources_page_cards(spark, d):
    """List items of pages as cards."""
    got = pages.extracted(table(spark, d, "pages"), lambda html: pages.cards(html, "li"))
    return got.select("page_id", F.col("place").cast("long").alias("place"), F.get_json_object("record", "$[0]").alias("url"), F.get_json_object("record", "$[1]").alias("text"))


ROBOTS = "User-agent: *\nDisallow: /\n\nUser-agent: lot\nDisallow: /de\nDisallow: /*/1\nAllow: /de/7\nAllow: /fr/1$\n"


@query("""with p as (select page_id, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) as path from pages), m as (select *, greatest(case when regexp_matches(path, '^/de/7') then 5 else -1 end, case when regexp_matches(path, '^/fr/1$') then 6 else -1 end) as yes, greatest(case when regexp_matches(path, '^/de') then 3 else -1 end, case when regexp_matches(path, '^/.*/1') then 4 else -1 end) as no from p)
select page_id, yes >= no as allowed from m""")
def sources_robots(spark, d):
    """Which pages a robots file lets a reader named lot fetch."""
    path = F.regexp_extract("url", "^[a-z]+://[^/?#]+([^?#]*)", 1)
    return table(spark, d, "pages").select("page_id", pages.robots_allow(path, 200, ROBOTS, "lotscope").alias("allowed"))


@query("select page_id, case when regexp_matches(path, '/(en|fr)/[^/?#]+') then 'listing' when regexp_matches(path, '/(de|es)(/|$)') then 'category' else 'other' end as kind from (select page_id, regexp_extract(url, '^(?:[a-z]+://[^/?#]+)?([^?#]*)', 1) as path from pages)")
def sources_url_kinds(spark, d):
    return table(spark, d, "pages").select("page_id", pages.url_kind(F.col("url"), r"/(?:en|fr)/[^/?#]+", r"/(?:de|es)(?:/|$)").alias("kind"))
