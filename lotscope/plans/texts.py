"""Registered queries of scalar text functions, sources and operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotscope.functions import text
from lotscope.plans.views import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


@query("with x as (select doc_id, regexp_extract_all(text, '" + text.CONTACT + "') as f from documents) select doc_id, len(f) as n, array_to_string(f, '|') as found from x where len(f) > 0")
def text_contacts(spark, d):
    df = table(spark, d, "documents").select("doc_id", text.contacts(F.col("text")).alias("f")).where(F.size("f") > 0)
    return df.select("doc_id", F.size("f").cast("long").alias("n"), F.array_join("f", "|").alias("found"))


@query("select conv_id, turn, md5(regexp_replace(text, '" + text.CONTACT + "', '[contact]', 'g')) as digest from conversations")
def text_redacted(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(text.redacted(F.col("text"))).alias("digest"))


@query("with p as (select page_id, regexp_replace(regexp_extract(url, '^[^?#]*'), '[0-9]+', '#', 'g') as path, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda x: regexp_extract(x, '^[^=]*')), lambda x: x <> ''))), '&') as names from pages) select page_id, case when names = '' then path else path || '?' || names end as shape from p")
def text_url_shape(spark, d):
    return table(spark, d, "pages").select("page_id", text.url_shape(F.col("url")).alias("shape"))


@query("select event_id, regexp_replace(props, '[0-9]', '#', 'g') as masked, cast(json_extract(props, '$.k') as bigint) as k from events")
def text_json_and_mask(spark, d):
    return table(spark, d, "events").select("event_id", text.mask_digits(F.col("props")).alias("masked"), F.get_json_object("props", "$.k").try_cast("long").alias("k"))


@query("select doc_id, substr(sha256(coalesce(cast(doc_id as varchar), '') || '|' || coalesce(lang, '') || '|' || coalesce(source, '')), 1, 16) as key, substr(sha256('salt' || source), 1, 24) as seller from documents")
def text_hashed_keys(spark, d):
    return table(spark, d, "documents").select("doc_id", text.hashed_key(F.col("doc_id"), F.col("lang"), F.col("source")).alias("key"), text.fingerprint(F.col("source"), "salt").alias("seller"))


@query("select l_linenumber as attempt, cast(least(21600, 60 * pow(4, greatest(l_linenumber - 1, 0))) as bigint) as wait, count(*) as n from lineitem group by 1, 2")
def ops_backoff(spark, d):
    df = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("attempt"))
    return df.withColumn("wait", text.backoff_seconds(F.col("attempt"))).groupBy("attempt", "wait").agg(F.count("*").alias("n"))


@query("select l_linenumber::bigint * 1000000000 + 480000000 as price, (80 + l_linenumber)::bigint * 1000 as km, (1390 + l_linenumber)::integer as year, count(*) as n from lineitem group by all")
def text_parsed_amounts(spark, d):
    """Amounts, distances and years of listing sentences made from order lines."""
    n = F.col("l_linenumber").cast("string")
    s = text.folded(F.concat(F.lit("مدل ۱۳۹"), n, F.lit(" کارکرد ۸"), n, F.lit(" هزار کیلومتر قیمت "), n, F.lit(" میلیارد و ۴۸۰ میلیون تومان")))
    df = table(spark, d, "lineitem").select(s.alias("s"))
    return df.select(text.parse_price(F.regexp_extract("s", "قیمت (.*)", 1)).alias("price"), text.parse_mileage_km(F.regexp_extract("s", "کارکرد (.*) قیمت", 1)).alias("km"), text.parse_year_jalali(F.regexp_extract("s", "^(.*) کارکرد", 1)).alias("year")).groupBy("price", "km", "year").agg(F.count("*").alias("n"))


@query("select date_trunc('day', ts) as day, event_type, count(*) as n, count(distinct user_id) as users, round(avg(value), 6) as mean from events group by all")
def ops_daily_counts(spark, d):
    return table(spark, d, "events").groupBy(F.date_trunc("day", "ts").alias("day"), "event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.avg("value"), 6).alias("mean"))


@query("with l as (select unnest([25.0, 50.0, 100.0, 250.0, 500.0]) as le) select event_type, le::double as le, count_if(value <= le) as n from events, l group by all")
def ops_histogram(spark, d):
    """Cumulative buckets, each bound's count in one pass."""
    bounds = [25.0, 50.0, 100.0, 250.0, 500.0]
    counts = table(spark, d, "events").groupBy("event_type").agg(*(F.count_if(F.col("value") <= b).alias(f"b{i}") for i, b in enumerate(bounds)))
    pairs = F.array(*(F.struct(F.lit(b).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)))
    return counts.select("event_type", F.explode(pairs).alias("x")).select("event_type", "x.le", "x.n")
