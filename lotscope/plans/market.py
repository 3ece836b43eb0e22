"""Registered queries: every operator over the driver's tables, with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotscope.operators import estimators, linkage, quality, ranking, review, sampling, summary, tracking
from lotscope.plans.views import LISTINGS, OBSERVATIONS, listings, observations, table

NOW = 2001
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """As the SQL rounds: the scaled double to a whole number, halves away from zero. (F.round goes by the shortest decimal form, where 0.45968749999999997 falls short of the half.)"""
    unit = float(10**digits)
    return df.withColumns({c: F.round(F.col(c).cast("double") * unit) / unit for c in columns})


def graded(spark: SparkSession, d: str) -> DataFrame:
    return quality.graded(listings(spark, d), NOW)


MILEAGE = f"case when mileage_km is null then 'unknown' when mileage_km < 0 or mileage_km > 1500000 then 'impossible' when mileage_km >= 900000 then 'suspicious' when {NOW} - year >= 3 and mileage_km < 1500 * ({NOW} - year) then 'suspicious' else 'ok' end"
PRICE = "case when price is null then 'absent' when price <= 0 then 'not_positive' when price < 10000000 then 'too_small' else 'ok' end"
GRADED = f"""{LISTINGS}, marked as (select *, {NOW} - year as age, {MILEAGE} as mileage_status, {PRICE} as price_status from listings),
graded as (select *, list_filter([case when make is null then 'no make' end, case when model is null then 'no model' end, case when year is null then 'no year' end, case when mileage_km is null then 'no mileage_km' end, case when price is null then 'no price' end,
  case when price is not null and price_status <> 'ok' then 'price is ' || price_status end, case when product_class is null then 'product class unknown' when product_class <> 'vehicle' then 'product class is ' || product_class end,
  case when price_kind is null then 'price kind unknown' when price_kind <> 'cash' then 'price is ' || price_kind end, case when mileage_status in ('suspicious', 'impossible') then 'mileage is ' || mileage_status end], lambda x: x is not null) as reasons from marked),
eligible as (select * from graded where len(reasons) = 0)"""
SUMMARY = "count(*) as n, count(case when price > 0 then price end) as priced, min(case when price > 0 then price end) as least, case when count(case when price > 0 then price end) >= 3 then cast(floor(quantile_cont(case when price > 0 then cast(price as double) end, 0.5)) as bigint) end as middle, max(case when price > 0 then price end) as greatest, min(year) as from_year, max(year) as to_year"


@query(f"with {GRADED} select make, model, {SUMMARY} from eligible group by make, model")
def summary_model(spark, d):
    return summary.summarise(graded(spark, d).where("eligible"), ["make", "model"])


@query(f"with {LISTINGS} select make, model, year, {SUMMARY.split(', min(year)')[0]} from listings group by make, model, year")
def summary_model_year(spark, d):
    return summary.summarise(listings(spark, d), ["make", "model", "year"]).drop("from_year", "to_year")


@query(f"""with {LISTINGS}, runs as (select distinct source, run_id from listings), mine as (select * from listings where make = 'Brand#11' and model = (select min(model) from listings)),
points as (select source, run_id, {SUMMARY} from mine group by source, run_id)
select r.source as source, r.run_id as run_id, coalesce(n, 0) as n, middle from runs r left join points p on r.source = p.source and r.run_id = p.run_id where r.source in (select source from mine)""")
def summary_history(spark, d):
    df = listings(spark, d)
    first = df.agg(F.min("model")).first()[0]
    return summary.history(df, df.select("source", "run_id").distinct(), (F.col("make") == "Brand#11") & (F.col("model") == first))


@query(f"with {GRADED} select listing_id, mileage_status, price_status, array_to_string(reasons, ';') as reasons, len(reasons) = 0 as eligible from graded")
def quality_eligibility_reasons(spark, d):
    return graded(spark, d).select("listing_id", "mileage_status", "price_status", F.array_join("reasons", ";").alias("reasons"), "eligible")


@query(f"""with {LISTINGS}, mid as (select make, model, trim, count(price) as c, quantile_cont(cast(price as double), 0.5) as m from listings where price is not null group by all)
select listing_id, coalesce(c >= 3 and (price >= 1.4 * m or 1.4 * price <= m), false) as far from listings l left join mid on l.make is not distinct from mid.make and l.model is not distinct from mid.model and l.trim is not distinct from mid.trim""")
def quality_far_prices(spark, d):
    return quality.hold_apart_far_prices(listings(spark, d), ["make", "model", "trim"], times=1.4).select("listing_id", "far")


@query(f"with {GRADED} select run_id, count(*) as fetched, count_if(make is not null and model is not null) as parsed, count_if(make is not null and model is not null and price_status = 'ok' and mileage_status in ('ok', 'unknown')) as usable, count_if(len(reasons) = 0) as eligible from graded group by run_id")
def quality_funnel(spark, d):
    return quality.funnel(graded(spark, d), ["run_id"])


@query(f"with {GRADED} select reasons[1] as reason, count(*) as n from graded where len(reasons) > 0 group by 1")
def quality_held_back(spark, d):
    return quality.held_back(graded(spark, d))


@query(f"with {GRADED} select unnest(reasons) as reason, count(*) as n from graded group by 1")
def quality_all_reasons(spark, d):
    return graded(spark, d).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query(f"""with {GRADED}, s as (select avg(case when model is not null then 1.0 else 0 end) as m, avg(case when price is not null then 1.0 else 0 end) as p, avg(case when price_status = 'too_small' then 1.0 else 0 end) as pg, avg(case when mileage_km is not null then 1.0 else 0 end) as k, avg(case when mileage_status in ('suspicious', 'impossible') then 1.0 else 0 end) as kg from graded)
select 'model' as field, round(m, 6) as filled, 0.0::double as garbage, round(m, 6) as usable from s union all select 'price', round(p, 6), round(pg, 6), round(p - pg, 6) from s union all select 'mileage_km', round(k, 6), round(kg, 6), round(k - kg, 6) from s""")
def quality_field_inventory(spark, d):
    bad = {"price": F.col("price_status") == "too_small", "mileage_km": F.col("mileage_status").isin("suspicious", "impossible")}
    return rounded(quality.field_inventory(graded(spark, d), ["model", "price", "mileage_km"], bad), "filled", "garbage", "usable")


@query("select l_orderkey, l_linenumber, case when l_linenumber = 7 or cast(l_quantity as int) * 9 + 200 in (404, 410) then 'absent' when cast(l_quantity as int) * 9 + 200 between 200 and 299 then 'ok' else 'unknown' end as status from lineitem")
def quality_http_status(spark, d):
    code = F.col("l_quantity").cast("int") * 9 + 200
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", quality.classify_http(code, F.col("l_linenumber") == 7).alias("status"))


@query("""with x as (select l_orderkey, l_linenumber, case when l_linenumber <> 1 then cast(floor(l_extendedprice) as bigint) end as t, case when l_linenumber = 2 then cast(floor(l_extendedprice) as bigint) * 10 when l_linenumber = 3 then cast(floor(l_extendedprice) as bigint) + 1 when l_linenumber = 4 then null when l_linenumber = 5 then cast(floor(l_extendedprice / 10) as bigint) else cast(floor(l_extendedprice * 1.3) as bigint) end as d from lineitem)
select l_orderkey, l_linenumber, case when t is null then d when d is null or abs(t - d) * 100 <= d then t when abs(t * 10 - d) * 100 <= d then t when abs(t - d * 10) * 100 <= t then d end as price from x""")
def quality_reconciled_price(spark, d):
    p, n = F.col("l_extendedprice"), F.col("l_linenumber")
    text = F.when(n != 1, F.floor(p).cast("long"))
    data = F.when(n == 2, F.floor(p).cast("long") * 10).when(n == 3, F.floor(p).cast("long") + 1).when(n == 4, F.lit(None).cast("long")).when(n == 5, F.floor(p / 10).cast("long")).otherwise(F.floor(p * 1.3).cast("long"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", quality.reconcile_price(text, data).alias("price"))


@query(f"""with {LISTINGS}, r as (select listing_id, cluster_id, condition, coalesce(list_position(['unknown', 'intact', 'minor_paint', 'multi_paint', 'replaced_part', 'accident'], condition), 1) as k from listings), m as (select cluster_id, max(k) as k from r group by 1)
select listing_id, (['unknown', 'intact', 'minor_paint', 'multi_paint', 'replaced_part', 'accident'])[greatest(r.k, case when m.k >= 5 then 3 else 1 end)] as worse, case condition when 'intact' then 0.05 when 'minor_paint' then 0.2 when 'multi_paint' then 0.5 when 'replaced_part' then 0.65 when 'accident' then 0.85 else 0.35 end::double as risk from r join m using (cluster_id)""")
def quality_worse_condition(spark, d):
    df = listings(spark, d)
    rank = F.array(*map(F.lit, ("unknown", *quality.CONDITION_SEVERITY)))
    top = df.groupBy("cluster_id").agg(F.max(F.array_position(rank, F.col("condition"))).alias("k"))
    other = F.when(F.col("k") >= 5, "minor_paint")
    return df.join(top, "cluster_id").select("listing_id", quality.worse_condition(F.col("condition"), other).alias("worse"), quality.condition_risk(F.col("condition")).alias("risk"))


# sampling

ROWS = f"with {LISTINGS}"


@query(f"{ROWS}, c as (select make, trim, count(*) as c from listings group by all), p as (select make, c, c / sum(c) over (partition by make) as p from c) select make, sum(c)::bigint as n, count(*) as strata, round(sum(p * p), 6) as hhi, round(case when count(*) < 2 then 0 else -sum(p * ln(p)) / ln(greatest(count(*), 2)) end, 6) as entropy, round(count(*) * count(*) / sum(1.0 / c), 4) as n_effective from p group by make")
def sampling_hhi_entropy(spark, d):
    return rounded(rounded(sampling.stratify(listings(spark, d), "make", "trim"), "hhi", "entropy"), "n_effective", digits=4)


def _wq(name: str, rows: str, keys: str, value: str, w: str, q: str = "0.5") -> str:
    return f"{name}_d as (select {keys}, {value} as v, sum({w}) as w from {rows} where {value} is not null group by all), {name}_c as (select *, sum(w) over (partition by {keys} order by v) as up, sum(w) over (partition by {keys}) as total from {name}_d), {name} as (select {keys}, min(v) as quantile from {name}_c where up >= {q} * total - 1e-9 * total group by {keys})"


@query(f"{ROWS}, w as (select make, price, cast(year - 1990 as double) as one from listings), {_wq('q', 'w', 'make', 'price', 'one', '0.35')} select make, quantile from q")
def sampling_weighted_quantile(spark, d):
    return sampling.weighted_quantile(listings(spark, d).withColumn("w", (F.col("year") - 1990).cast("double")), "make", "price", "w", 0.35)


@query(f"""{ROWS}, r as (select make, condition, price, 1.0 as one from listings where price is not null), s as (select make, condition, count(*) as c from r group by all), t as (select make, sum(c)::bigint as n, count(*) as k from s group by make),
{_wq('o', 'r', 'make', 'price', 'one')}, rw as (select r.make as make, price, 1.0 / c as w from r join s on r.make = s.make and r.condition = s.condition), {_wq('e', 'rw', 'make', 'price', 'w')},
lo as (select s.make as make, s.condition as left_out from s join t on s.make = t.make where n - c >= 4 and k > 1), rd as (select r.make as make, left_out, price, one from r join lo on r.make = lo.make where r.condition <> left_out), {_wq('x', 'rd', 'make, left_out', 'price', 'one')},
ends as (select make, min(quantile) as low, max(quantile) as high from x group by make)
select t.make as make, n, o.quantile as observed, e.quantile as equal, low, high, round((greatest(high, e.quantile) - least(low, e.quantile)) / o.quantile, 6) as span from t join o on t.make = o.make join e on t.make = e.make left join ends on t.make = ends.make where n >= 4""")
def sampling_sensitivity(spark, d):
    return rounded(sampling.sensitivity(listings(spark, d), "make", "condition", "price"), "span")


RIQR = "select make, max(n) as n, max(case when i = floor(0.25 * (n - 1)) then v end) as q1, max(case when i = floor(0.5 * (n - 1)) then v end) as q2, max(case when i = floor(0.75 * (n - 1)) then v end) as q3 from (select make, {0} as v, row_number() over (partition by make order by {0}) - 1 as i, count(*) over (partition by make) as n from listings where {0} is not null) group by make"
TOP = "select make, max(c) / sum(c) as share from (select make, {0}, count(*) as c from listings where {0} is not null group by all) group by make"


@query(f"""{ROWS}, n as (select make, count(*) as n from listings group by make), y as ({TOP.format('year')}), c as ({TOP.format('condition')}), k as ({RIQR.format('mileage_km')}), p as ({RIQR.format('price')}),
a as (select n.make as make, n.n as n, y.share as year_share, c.share as condition_share, case when k.n >= 4 and k.q2 <> 0 then (k.q3 - k.q1) / k.q2 end as mileage_riqr, case when p.n >= 4 and p.q2 <> 0 then (p.q3 - p.q1) / p.q2 end as price_riqr from n left join y on n.make = y.make left join c on n.make = c.make left join k on n.make = k.make left join p on n.make = p.make),
f as (select *, array_to_string(list_filter([case when year_share > 0.8 then 'year' end, case when condition_share > 0.8 then 'condition' end, case when mileage_riqr < 0.15 then 'mileage' end, case when price_riqr < 0.075 then 'price' end], lambda x: x is not null), ',') as findings from a)
select make, n, round(year_share, 6) as year_share, round(condition_share, 6) as condition_share, round(mileage_riqr, 6) as mileage_riqr, round(price_riqr, 6) as price_riqr, findings, n >= 30 and findings = '' as sufficient from f""")
def sampling_coverage(spark, d):
    return rounded(sampling.coverage(listings(spark, d), "make"), "year_share", "condition_share", "mileage_riqr", "price_riqr")


@query(f"{ROWS}, c as (select make, model, count(*) as c from listings group by all) select make, sum(c)::bigint as n, sum(case when model is null then c else 0 end)::bigint as missing, count_if(model is not null and c < 5) as thin, round(sum(case when model is not null and c >= 5 then c else 0 end) / sum(c), 6) as covered, round(sum(case when model is not null and c >= 5 then c else 0 end) / sum(c), 12) >= 0.7 as in_scope from c group by make")
def sampling_conditional_scope(spark, d):
    return rounded(sampling.conditional_scope(listings(spark, d), "make", "model"), "covered")


@query(f"{ROWS}, c as (select make, condition, count(*) as c from listings group by all), m as (select make, max(c) as m, sum(c) as n from c group by make) select c.make as make, min(condition) as top, round(max(m) / max(n), 6) as share from c join m on c.make = m.make and c.c = m.m group by c.make")
def sampling_top_share(spark, d):
    return rounded(sampling.top_share(listings(spark, d), "make", "condition"), "share")


# tracking

INTEGRITY = "integrity as (select day, present, absent, unknown, n, case when n < 20 then 'ok' when present + absent > 0 and absent > 0.2 * (present + absent) then 'suspect' when unknown > 0.3 * n then 'partial' else 'ok' end as integrity from (select day, count_if(status = 'present') as present, count_if(status = 'absent') as absent, count_if(status = 'unknown') as unknown, count(*) as n from observations group by day))"
DAYS = "days as (select item, day, (['unknown', 'absent', 'present'])[max(case status when 'present' then 2 when 'absent' then 1 else 0 end) + 1] as status, arg_max(price, fetch_id) filter (where status = 'present') as price from observations group by item, day)"
OBS = f"with {OBSERVATIONS}"


@query(f"{OBS}, {INTEGRITY} select * from integrity")
def tracking_integrity(spark, d):
    return tracking.integrity(observations(spark, d))


@query(f"{OBS}, {DAYS} select item, date_diff('day', min(day), max(day)) as span, count_if(status = 'present') as present_days, count_if(status = 'absent') as absent_days, greatest(date_diff('day', min(day), max(day)) + 1 - count_if(status = 'present') - count_if(status = 'absent'), 0) as unknown_days from days group by item")
def tracking_day_accounts(spark, d):
    return tracking.day_accounts(tracking.daily(observations(spark, d))).withColumn("span", F.col("span").cast("long"))


@query(f"""{OBS}, {DAYS}, sure as (select *, lag(status) over w as was, last_value(price ignore nulls) over (partition by item order by day rows between unbounded preceding and 1 preceding) as was_price from days where status <> 'unknown' window w as (partition by item order by day))
select item, day, 'appeared' as event, null::bigint as before, null::bigint as after from sure where status = 'present' and was is null union all select item, day, 'reappeared', null, null from sure where status = 'present' and was = 'absent'
union all select item, day, 'disappeared', null, null from sure where status = 'absent' and was = 'present' union all select item, day, 'price_change', was_price, price from sure where status = 'present' and price <> was_price""")
def tracking_events(spark, d):
    return tracking.events(tracking.daily(observations(spark, d)))


SPANS = f"{DAYS}, seen as (select *, min(case when status = 'present' then day end) over (partition by item order by day) as seen from days where status <> 'unknown'), per as (select item, min(seen) as first, min(case when status = 'absent' then day end) as gone, max(case when status = 'present' then day end) as last from seen where seen is not null and day >= seen group by item), spans as (select item, date_diff('day', first, coalesce(gone, last)) as t, gone is not null as ended, first = (select min(day) from days) as truncated from per)"


@query(f"{OBS}, {SPANS} select item, t, ended, truncated from spans")
def tracking_durations(spark, d):
    return tracking.durations(tracking.daily(observations(spark, d))).withColumn("t", F.col("t").cast("long"))


KM = f"{SPANS}, c as (select t, count(*) as c, count_if(ended) as ends from spans group by t), r as (select t, ends, sum(c) over (order by t desc) as at_risk from c)"


@query(f"{OBS}, {KM} select t, at_risk::bigint as at_risk, ends, round(case when min(at_risk - ends) over (order by t) = 0 then 0 else exp(sum(case when at_risk > ends then ln((at_risk - ends) / at_risk) end) over (order by t)) end, 6) as survival from r")
def survival_km_curve(spark, d):
    spans = tracking.durations(tracking.daily(observations(spark, d)))
    return rounded(tracking.kaplan_meier(spans).withColumn("t", F.col("t").cast("long")), "survival")


@query(f"{OBS}, {SPANS} select count_if(not truncated) as n, count_if(not truncated and ended) as ended, round(avg(case when not truncated and ended then t end), 6) as mean_ended, count_if(truncated) as left_truncated, count_if(not truncated) - count_if(not truncated and ended) as censored, count_if(not truncated and ended) >= 30 as enough from spans")
def survival_duration_stats(spark, d):
    return rounded(tracking.duration_stats(tracking.durations(tracking.daily(observations(spark, d)))), "mean_ended")


@query(f"""{ROWS}, a as (select cluster_id, max(price) as price, max(condition) as condition from listings where year <= 1997 group by 1), b as (select cluster_id, max(price) as price, max(condition) as condition from listings where year > 1997 group by 1),
j as (select a.cluster_id as ka, b.cluster_id as kb, a.price is distinct from b.price as p, a.condition is distinct from b.condition as c from a full join b on a.cluster_id = b.cluster_id)
select count_if(ka is not null and kb is not null) as "both", count_if(kb is null) as only_first, count_if(ka is null) as only_second, count_if(ka is not null and kb is not null and p) as changed_price, count_if(ka is not null and kb is not null and c) as changed_condition, round((count_if(kb is null) + count_if(ka is null)) / (count_if(kb is null) + count_if(ka is null) + 2 * count_if(ka is not null and kb is not null)), 6) as churn from j""")
def tracking_compare_runs(spark, d):
    df = listings(spark, d)
    side = lambda x: x.groupBy("cluster_id").agg(F.max("price").alias("price"), F.max("condition").alias("condition"))
    return rounded(tracking.compare_runs(side(df.where("year <= 1997")), side(df.where("year > 1997")), "cluster_id", ["price", "condition"]), "churn")


@query("select event_id, count(*) over (partition by user_id order by epoch(date_trunc('second', ts))::bigint range between 86399 preceding and current row) as recent, count(*) over (partition by user_id order by epoch(date_trunc('second', ts))::bigint range between 86399 preceding and current row) > 3 as blocked from events")
def ops_rate_limit(spark, d):
    return tracking.rate_limited(table(spark, d, "events"), "user_id", "ts", 3, 86_400).select("event_id", "recent", "blocked")


@query(f"""{ROWS}, c as (select source, run_id, count(*) as n from listings group by all), u as (select *, case when count(n) over w >= 3 then quantile_cont(cast(n as double), 0.5) over w end as usual from c window w as (partition by source order by run_id rows between 7 preceding and 1 preceding))
select source, run_id, n, usual, coalesce(n < 0.95 * usual or n > 1.05 * usual, false) as odd from u""")
def ops_volume_anomalies(spark, d):
    counts = listings(spark, d).groupBy("source", "run_id").agg(F.count("*").alias("n"))
    return summary.volume_anomalies(counts, ["source"], "run_id", low=0.95, high=1.05)


# linkage


def offers(spark, d, part=None):
    df = listings(spark, d, part=part)
    photos = F.array(F.concat(F.lit("p"), (F.col("cluster_id") % 97).cast("string")), F.concat(F.lit("q"), (F.col("cluster_id") % 11).cast("string")))
    # The same item again within a fortnight: the fixture takes items of one model.
    return df.where("model is not null").withColumns({"photos": photos, "color": F.col("condition"), "province": F.concat(F.lit("r"), (F.col("seller") % 4).cast("string")), "description": F.concat_ws(" ", "make", "model", "trim", "condition")})


def offer_parts(spark, d):
    """All offers, as parts by order that are joined in turn where lines are many: a join's shuffles are gone before the next one's."""
    n = 1 if table(spark, d, "lineitem").count() < 5_000_000 else 3
    return [offers(spark, d, (i, n) if n > 1 else None) for i in range(n)]


REPOST = """offers as (select *, ['p' || (cluster_id % 97), 'q' || (cluster_id % 11)] as photos, condition as color, 'r' || (seller % 4) as province from listings where model is not null),
pairs as (select a.listing_id as old_id, b.listing_id as new_id, a.trim = b.trim as t, a.color = b.color as c, a.province = b.province as pr, a.seller = b.seller as s, a.mileage_km as ka, b.mileage_km as kb, a.price as pa, b.price as pb, len(list_intersect(a.photos, b.photos)) / len(list_distinct(list_concat(a.photos, b.photos))) as img
  from offers a join offers b on a.make = b.make and a.model = b.model and a.year = b.year and date_diff('day', a.seen_on, b.seen_on) between 1 and 14 and a.listing_id <> b.listing_id),
scored as (select old_id, new_id, case when kb < ka * 0.95 then 0 else greatest(0, least(1, 0.45 * img + case when s then 0.35 else 0 end + case when kb <= ka * 1.10 then 0.15 else 0 end + case when t then 0.05 else 0 end + case when c then 0.05 else 0 end - case when not pr then 0.15 else 0 end
  + case when pb / pa between 0.8 and 1.1 then 0.1 when pb / pa < 0.55 or pb / pa > 1.45 then -0.1 else 0 end)) end as score from pairs)"""


@query(f"{ROWS}, {REPOST} select old_id, new_id, round(score, 6) as score from scored")
def linkage_repost_score(spark, d):
    parts = offer_parts(spark, d)
    return linkage.repost_candidates(parts, parts, digits=6)


@query(f"{ROWS}, {REPOST}, r as (select *, row_number() over w as nth, lead(score) over w as next from (select old_id, new_id, round(score, 6) as score from scored) window w as (partition by new_id order by score desc, old_id)) select new_id, old_id, score, case when score < 0.25 then 'none' when next is null or round(score - next, 9) >= 0.1 then 'match' else 'ambiguous' end as verdict from r where nth = 1")
def linkage_repost_top1(spark, d):
    parts = offer_parts(spark, d)
    return linkage.best_candidates(parts, parts, least=0.25)


@query("""with b as (select item_id, lower(text) as t from benchmark), g as (select item_id, list_distinct([substr(t, i, 4) for i in range(1, length(t) - 2)]) as s from b where length(t) >= 4)
select x.item_id as a, y.item_id as b, round(len(list_intersect(x.s, y.s)) / len(list_distinct(list_concat(x.s, y.s))), 6) as j from g x join g y on x.item_id < y.item_id and list_has_any(x.s, y.s)""")
def linkage_shingle_jaccard(spark, d):
    df = table(spark, d, "benchmark").select("item_id", linkage.shingles(F.lower("text")).alias("s")).where(F.size("s") > 0)
    each = df.select("item_id", F.size("s").alias("n"), F.explode("s").alias("shingle"))
    x, y = each.alias("x"), each.alias("y")
    both = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.item_id") < F.col("y.item_id")))
    both = both.groupBy(F.col("x.item_id").alias("a"), F.col("y.item_id").alias("b")).agg(F.count("*").alias("shared"), (F.first("x.n") + F.first("y.n")).alias("n"))
    return rounded(both.select("a", "b", (F.col("shared") / (F.col("n") - F.col("shared"))).alias("j")), "j")


@query(f"{ROWS} select make, count(*) as offers, count(distinct cluster_id) as items, round_even((count(*) / count(distinct cluster_id) - 1) * 100, 0)::bigint as inflation_pct from listings group by make")
def linkage_supply_correction(spark, d):
    return linkage.supply_correction(listings(spark, d), ["make"])


@query(f"{ROWS} select cluster_id, count(*) as offers, min(price) as least, max(price) as greatest, round((max(price) - min(price)) / min(price), 6) as spread from listings group by cluster_id having count(*) > 1")
def linkage_cluster_spread(spark, d):
    return rounded(linkage.cluster_spread(listings(spark, d)), "spread")


@query()
def linkage_same_item(spark, d):
    df = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.pmod("o_custkey", F.lit(400)).alias("k1"), F.concat_ws("|", "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd")).alias("k2"))
    return linkage.same_item(df, "id", [["k1"], ["k2"]])


@query("select distinct c.c_custkey as c_custkey from customer c where not exists (select 1 from orders o where o.o_custkey = c.c_custkey and o.o_orderstatus = 'P')")
def linkage_anti_join(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey").distinct()
