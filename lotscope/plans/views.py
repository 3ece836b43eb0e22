"""The driver's tables in the roles of a listing market, for Spark and, as common table expressions, for DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listings(spark: SparkSession, sf_dir: str, named: Column | None = None, part: tuple[int, int] | None = None) -> DataFrame:
    """Order lines as listings: an item of a make, model and trim, offered at a price in a run. `named`, of a line's own columns: which need their listing_id; the others are dealt out without it.
    `part`, (i, n): those of the i-th of n parts of the orders."""
    mine, (line, part, order) = part, (table(spark, sf_dir, t) for t in ("lineitem", "part", "orders"))
    if mine is not None:
        line, order = (df.where(F.pmod(F.xxhash64(F.col(k).cast("long")), F.lit(mine[1])) == mine[0]) for df, k in ((line, "l_orderkey"), (order, "o_orderkey")))
    listing_id = F.concat_ws(":", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")))
    if named is not None:
        line, listing_id = line.withColumn("_listing_id", F.when(named, listing_id)), F.col("_listing_id")
    # The parts' words come last: lines are dealt out as numbers alone.
    both = line.join(order, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    price = F.when(F.col("l_quantity") == 13, F.lit(None)).otherwise(F.floor("l_extendedprice").cast("long") * 100_000)
    return both.select(
        listing_id.alias("listing_id"),
        F.col("l_partkey").alias("cluster_id"),
        F.col("p_brand").alias("make"),
        F.when(F.col("p_size") == 50, F.lit(None)).otherwise(F.col("p_type")).alias("model"),
        F.col("p_size").cast("string").alias("trim"),
        F.concat(F.lit("s"), F.pmod(F.col("l_suppkey"), F.lit(3)).cast("string")).alias("source"),
        F.date_format("o_orderdate", "yyyy-MM").alias("run_id"),
        F.to_date("l_shipdate").alias("seen_on"),
        F.year("o_orderdate").alias("year"),
        (F.col("l_quantity").cast("long") * 24_000).alias("mileage_km"),
        price.alias("price"),
        F.element_at(F.array(*map(F.lit, ("intact", "minor_paint", "multi_paint", "replaced_part", "accident", "unknown"))), (F.col("l_linenumber") % 6 + 1).cast("int")).alias("condition"),
        F.when(F.col("l_returnflag") == "R", "assignment").otherwise("vehicle").alias("product_class"),
        F.when(F.col("l_linestatus") == "O", "cash").when(F.col("l_discount") > 0.05, "negotiable").otherwise("financing_total").alias("price_kind"),
        F.col("l_suppkey").alias("seller"),
    )


LISTINGS = """listings as (
  select concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey) as listing_id, l_partkey as cluster_id, p_brand as make,
    case when p_size = 50 then null else p_type end as model, cast(p_size as varchar) as trim, 's' || cast(l_suppkey % 3 as varchar) as source,
    strftime(o_orderdate, '%Y-%m') as run_id, cast(l_shipdate as date) as seen_on, cast(year(o_orderdate) as integer) as year,
    cast(l_quantity as bigint) * 24000 as mileage_km, case when l_quantity = 13 then null else cast(floor(l_extendedprice) as bigint) * 100000 end as price,
    (['intact', 'minor_paint', 'multi_paint', 'replaced_part', 'accident', 'unknown'])[l_linenumber % 6 + 1] as condition,
    case when l_returnflag = 'R' then 'assignment' else 'vehicle' end as product_class,
    case when l_linestatus = 'O' then 'cash' when l_discount > 0.05 then 'negotiable' else 'financing_total' end as price_kind, l_suppkey as seller
  from lineitem join part on l_partkey = p_partkey join orders on l_orderkey = o_orderkey)"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as fetches of tracked items: one row for each item, day and event."""
    kind = F.col("event_type")
    status = F.when(kind.isin("view", "click", "signup"), "present").when(kind == "purchase", "absent").otherwise("unknown")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("fetch_id"), F.col("user_id").alias("item"), F.to_date("ts").alias("day"), status.alias("status"), F.round(F.col("value") * 100).cast("long").alias("price"))


OBSERVATIONS = """observations as (
  select event_id as fetch_id, user_id as item, cast(ts as date) as day,
    case when event_type in ('view', 'click', 'signup') then 'present' when event_type = 'purchase' then 'absent' else 'unknown' end as status,
    cast(round(value * 100) as bigint) as price from events)"""
