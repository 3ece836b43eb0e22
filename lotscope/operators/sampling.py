"""Sampling diagnostics: how a group's rows are spread over strata, and what its level would be under other weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stratify(df: DataFrame, group: str, stratum: str) -> DataFrame:
    """For each group: rows, strata, Herfindahl index, normalised entropy and the effective size of equally weighted strata."""
    counts = df.groupBy(group, stratum).agg(F.count("*").alias("c"))
    p = F.col("c") / F.sum("c").over(Window.partitionBy(group))
    shares = counts.withColumn("p", p)
    k = F.count("*")
    entropy = F.when(k < 2, 0.0).otherwise(-F.sum(F.col("p") * F.ln("p")) / F.ln(F.when(k > 1, k).otherwise(2)))
    return shares.groupBy(group).agg(F.sum("c").alias("n"), k.alias("strata"), F.sum(F.col("p") * F.col("p")).alias("hhi"), entropy.alias("entropy"), (k * k / F.sum(1 / F.col("c"))).alias("n_effective"))


def weighted_quantile(df: DataFrame, group: str, value: str, weight: str, q: float) -> DataFrame:
    """The first value whose cumulative weight reaches q of all, by group.

    Rows with equal values are summed first, so what a group's window sees is its distinct values.
    """
    distinct = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.sum(weight).alias("w"))
    up = F.sum("w").over(Window.partitionBy(group).orderBy(value))
    total = F.sum("w").over(Window.partitionBy(group))
    return distinct.withColumn("reached", up >= q * total - 1e-9 * total).where("reached").groupBy(group).agg(F.min(value).alias("quantile"))


def sensitivity(df: DataFrame, group: str, stratum: str, value: str, least: int = 4, q: float = 0.5) -> DataFrame:
    """The level as observed, with strata weighted equally, and over all ways to leave one stratum out; span: how far these reach, as a share of the first.

    Leaving one out is computed from the counts of (stratum, value): every row meets the other strata of its group only.
    """
    rows = df.where(F.col(value).isNotNull() & F.col(stratum).isNotNull()).select(group, stratum, value)
    size = rows.groupBy(group, stratum).agg(F.count("*").alias("c"))
    total = size.groupBy(group).agg(F.sum("c").alias("n"), F.count("*").alias("k"))
    observed = weighted_quantile(rows.withColumn("one", F.lit(1.0)), group, value, "one", q).withColumnRenamed("quantile", "observed")
    equal = weighted_quantile(rows.join(size, [group, stratum]).withColumn("w", 1 / F.col("c")), group, value, "w", q).withColumnRenamed("quantile", "equal")
    dropped = size.join(total, group).where((F.col("n") - F.col("c") >= least) & (F.col("k") > 1)).select(group, F.col(stratum).alias("left_out"))
    cells = rows.groupBy(group, stratum, value).agg(F.count("*").cast("double").alias("w"))
    kept = cells.join(dropped, group).where(F.col(stratum) != F.col("left_out")).withColumn("key", F.struct(F.col(group), F.col("left_out")))
    without = weighted_quantile(kept, "key", value, "w", q).select(F.col(f"key.{group}").alias(group), "quantile")
    ends = without.groupBy(group).agg(F.min("quantile").alias("low"), F.max("quantile").alias("high"))
    out = total.where(F.col("n") >= least).join(observed, group).join(equal, group).join(ends, group, "left")
    top, bottom = F.greatest("high", "equal"), F.least("low", "equal")
    return out.select(group, "n", "observed", "equal", "low", "high", F.try_divide(top - bottom, F.col("observed")).alias("span"))


def relative_iqr(df: DataFrame, group: str, value: str, least: int = 4) -> DataFrame:
    """(q3 - q1) / median with quantiles that are values: the one at place int(q (n - 1)) of the sorted rows."""
    w = Window.partitionBy(group)
    rows = df.where(F.col(value).isNotNull()).select(group, value).withColumns({"i": F.row_number().over(w.orderBy(value)) - 1, "n": F.count("*").over(w)})
    at = lambda q: F.max(F.when(F.col("i") == F.floor(q * (F.col("n") - 1)), F.col(value)))
    got = rows.groupBy(group).agg(F.max("n").alias("n"), at(0.25).alias("q1"), at(0.5).alias("q2"), at(0.75).alias("q3"))
    return got.select(group, "n", F.when((F.col("n") >= least) & (F.col("q2") != 0), (F.col("q3") - F.col("q1")) / F.col("q2")).alias("riqr"))


def top_share(df: DataFrame, group: str, value: str) -> DataFrame:
    """The most frequent value and its share; of equally frequent ones the smallest."""
    counts = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("c"))
    best = counts.groupBy(group).agg(F.max("c").alias("m"), F.sum("c").alias("n"))
    return counts.join(best, group).where("c = m").groupBy(group).agg(F.min(value).alias("top"), (F.max("m") / F.max("n")).alias("share"))


def coverage(df: DataFrame, group: str, least: int = 30, level: float = 0.80, spread: float = 0.15) -> DataFrame:
    """What a fit over the group's rows could not learn: nearly one year or condition, hardly any spread of mileage or prices; sufficient if nothing and enough rows."""
    n = df.groupBy(group).agg(F.count("*").alias("n"))
    year = top_share(df, group, "year").select(group, F.col("share").alias("year_share"))
    cond = top_share(df, group, "condition").select(group, F.col("share").alias("condition_share"))
    km = relative_iqr(df, group, "mileage_km").select(group, F.col("riqr").alias("mileage_riqr"))
    price = relative_iqr(df, group, "price").select(group, F.col("riqr").alias("price_riqr"))
    out = n.join(year, group, "left").join(cond, group, "left").join(km, group, "left").join(price, group, "left")
    found = F.array(F.when(F.col("year_share") > level, "year"), F.when(F.col("condition_share") > level, "condition"), F.when(F.col("mileage_riqr") < spread, "mileage"), F.when(F.col("price_riqr") < spread / 2, "price"))
    out = out.withColumn("findings", F.array_join(F.filter(found, lambda x: x.isNotNull()), ","))
    return out.withColumn("sufficient", (F.col("n") >= least) & (F.col("findings") == ""))


def conditional_scope(df: DataFrame, group: str, stratum: str, thin: int = 5, least_share: float = 0.70) -> DataFrame:
    """Whether a statement by stratum covers enough: rows without one, thin strata, share of rows in others."""
    counts = df.groupBy(group, stratum).agg(F.count("*").alias("c"))
    known = F.col(stratum).isNotNull()
    thick = known & (F.col("c") >= thin)
    out = counts.groupBy(group).agg(F.sum("c").alias("n"), F.sum(F.when(~known, F.col("c")).otherwise(0)).alias("missing"), F.count_if(known & (F.col("c") < thin)).alias("thin"), (F.sum(F.when(thick, F.col("c")).otherwise(0)) / F.sum("c")).alias("covered"))
    return out.withColumn("in_scope", F.col("covered") >= least_share)
