"""Following items over days: what a batch of fetches says, what changed, and how long items stay.

Not knowing is never absence, and a disappearance is never a sale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Policy (fixed values).
SUSPECT_ABSENT, PARTIAL_UNKNOWN, LEAST_SAMPLE, REPOST_DAYS = 0.20, 0.30, 20, 14


def integrity(fetches: DataFrame, batch: str = "day") -> DataFrame:
    """Counts of each batch and its integrity: ok, partial (too much unknown) or suspect (too many absent of those resolved, or empty)."""
    out = fetches.groupBy(batch).agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("present", "absent", "unknown")), F.count("*").alias("n"))
    partial = F.col("unknown") > PARTIAL_UNKNOWN * F.col("n")
    resolved = F.col("present") + F.col("absent")
    suspect = (resolved > 0) & (F.col("absent") > SUSPECT_ABSENT * resolved)
    return out.withColumn("integrity", F.when(F.col("n") == 0, "suspect").when(F.col("n") < LEAST_SAMPLE, "ok").when(suspect, "suspect").when(partial, "partial").otherwise("ok"))


def daily(fetches: DataFrame, trust: DataFrame | None = None) -> DataFrame:
    """(item, day, status, price): one state a day. Presence outranks absence, absence outranks not knowing; suspect days count nothing, partial ones no absence."""
    df = fetches
    if trust is not None:
        df = df.join(trust.select("day", "integrity"), "day").where("integrity <> 'suspect'")
        df = df.withColumn("status", F.when((F.col("integrity") == "partial") & (F.col("status") == "absent"), "unknown").otherwise(F.col("status")))
    rank = F.when(F.col("status") == "present", 2).when(F.col("status") == "absent", 1).otherwise(0)
    got = df.groupBy("item", "day").agg(F.max(rank).alias("r"), F.max_by(F.when(F.col("status") == "present", F.col("price")), F.struct((F.col("status") == "present").cast("int"), "fetch_id")).alias("price"))
    return got.select("item", "day", F.element_at(F.array(F.lit("unknown"), F.lit("absent"), F.lit("present")), F.col("r") + 1).alias("status"), "price")


def day_accounts(days: DataFrame) -> DataFrame:
    """span + 1 = present + absent + unknown for each item; days without a fetch are unknown."""
    out = days.groupBy("item").agg(F.min("day").alias("first"), F.max("day").alias("last"), F.count_if(F.col("status") == "present").alias("present_days"), F.count_if(F.col("status") == "absent").alias("absent_days"))
    span = F.datediff("last", "first")
    return out.select("item", span.alias("span"), "present_days", "absent_days", F.greatest(span + 1 - F.col("present_days") - F.col("absent_days"), F.lit(0)).alias("unknown_days"))


def events(days: DataFrame) -> DataFrame:
    """(item, day, event, before, after): appeared, disappeared, reappeared, price_change, in the order of days. Unknown days change nothing."""
    w = Window.partitionBy("item").orderBy("day")
    sure = days.where("status <> 'unknown'").withColumn("was", F.lag("status").over(w)).withColumn("was_price", F.last(F.when(F.col("status") == "present", F.col("price")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    present = F.col("status") == "present"
    kinds = F.array(
        F.when(present & F.col("was").isNull(), "appeared"),
        F.when(present & (F.col("was") == "absent"), "reappeared"),
        F.when(~present & (F.col("was") == "present"), "disappeared"),
        F.when(present & (F.col("price") != F.col("was_price")), "price_change"),
    )
    out = sure.select("item", "day", F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("event"), "was_price", "price")
    change = F.col("event") == "price_change"
    return out.select("item", "day", "event", F.when(change, F.col("was_price")).alias("before"), F.when(change, F.col("price")).alias("after"))


def durations(days: DataFrame) -> DataFrame:
    """(item, t, ended, truncated): days from the first sighting to the first disappearance, or to the last sighting where none is known.

    Items already there in the first batch began before it and are marked as truncated.
    """
    start = days.agg(F.min("day").alias("start"))
    w = Window.partitionBy("item").orderBy("day")
    sure = days.where("status <> 'unknown'").withColumn("seen", F.min(F.when(F.col("status") == "present", F.col("day"))).over(w))
    sure = sure.where("seen is not null and day >= seen")
    per = sure.groupBy("item").agg(F.min("seen").alias("first"), F.min(F.when(F.col("status") == "absent", F.col("day"))).alias("gone"), F.max(F.when(F.col("status") == "present", F.col("day"))).alias("last"))
    first = start.first()["start"]
    return per.select("item", F.datediff(F.coalesce("gone", "last"), "first").alias("t"), F.col("gone").isNotNull().alias("ended"), (F.col("first") == F.lit(first)).alias("truncated"))


def kaplan_meier(spans: DataFrame, t: str = "t", ended: str = "ended") -> DataFrame:
    """(t, at_risk, ends, survival): spans that stop without an end at t are still at risk at t.

    Spans are counted by t; the product runs over the distinct times, of which there are as many as days.
    """
    per = spans.groupBy(F.col(t).alias("t")).agg(F.count("*").alias("c"), F.count_if(F.col(ended)).alias("ends"))
    # One row for each distinct number of days, so a single ordered window is small at any size of input.
    at_risk = F.sum("c").over(Window.orderBy(F.desc("t")))
    per = per.withColumn("at_risk", at_risk)
    upto = F.array_sort(F.collect_list(F.struct("t", "ends", "at_risk")).over(Window.orderBy("t")))
    survival = F.aggregate(upto, F.lit(1.0), lambda s, x: s * (1 - x.ends / x.at_risk))
    return per.select("t", "at_risk", "ends", survival.alias("survival"))


def median_survival(curve: DataFrame) -> DataFrame:
    return curve.agg(F.min(F.when(F.col("survival") <= 0.5, F.col("t"))).alias("median"))


def duration_stats(spans: DataFrame, least: int = 30) -> DataFrame:
    """Of spans whose beginning was seen: number, ended, censored, mean days of the ended, and whether there are enough."""
    own = F.col("truncated") == F.lit(False)
    out = spans.agg(F.count_if(own).alias("n"), F.count_if(own & F.col("ended")).alias("ended"), F.avg(F.when(own & F.col("ended"), F.col("t"))).alias("mean_ended"), F.count_if("truncated").alias("left_truncated"))
    return out.withColumn("censored", F.col("n") - F.col("ended")).withColumn("enough", F.col("ended") >= least)


def compare_runs(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Two snapshots: in both, only in each, churn (symmetric difference over all), and for each field how often it changed."""
    x = a.select(F.col(key).alias("ka"), *(F.col(f).alias(f"a_{f}") for f in fields)).dropDuplicates(["ka"])
    y = b.select(F.col(key).alias("kb"), *(F.col(f).alias(f"b_{f}") for f in fields)).dropDuplicates(["kb"])
    both = x.join(y, F.col("ka") == F.col("kb"), "full")
    met = F.col("ka").isNotNull() & F.col("kb").isNotNull()
    changed = [F.count_if(met & ~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}"))).alias(f"changed_{f}") for f in fields]
    out = both.agg(F.count_if(met).alias("both"), F.count_if(F.col("kb").isNull()).alias("only_first"), F.count_if(F.col("ka").isNull()).alias("only_second"), *changed)
    apart = F.col("only_first") + F.col("only_second")
    return out.withColumn("churn", F.try_divide(apart, apart + 2 * F.col("both")))


def rate_limited(events_: DataFrame, key: str, at: str, limit: int, seconds: int) -> DataFrame:
    """Adds recent (events of the key within the last `seconds`, this one included) and blocked (more than `limit`)."""
    w = Window.partitionBy(key).orderBy(F.unix_seconds(F.col(at).cast("timestamp"))).rangeBetween(-seconds + 1, 0)
    return events_.withColumn("recent", F.count("*").over(w)).withColumn("blocked", F.col("recent") > limit)
