"""Summaries of a market: what is offered of each model, at which middle price, and how that changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def priced(df: DataFrame) -> Column:
    return F.col("price") > 0


def summarise(df: DataFrame, by: list[str], least: int = 3) -> DataFrame:
    """count, priced, least, middle (of at least `least` prices, whole) and greatest price, and the years."""
    price = F.when(priced(df), F.col("price"))
    middle = F.when(F.count(price) >= least, F.floor(F.percentile(price, F.lit(0.5))).cast("long"))
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.count(price).alias("priced"), F.min(price).alias("least"), middle.alias("middle"), F.max(price).alias("greatest"), F.min("year").alias("from_year"), F.max("year").alias("to_year"))


def history(df: DataFrame, runs: DataFrame, model: Column, least: int = 3) -> DataFrame:
    """One row for each run of a source that ever held the model, with zero counts where it held none."""
    mine = df.where(model)
    sources = mine.select("source").distinct()
    points = summarise(mine, ["source", "run_id"], least).select("source", "run_id", "n", "middle")
    return runs.join(sources, "source", "left_semi").join(points, ["source", "run_id"], "left").select("source", "run_id", F.coalesce("n", F.lit(0)).alias("n"), "middle")


def volume_anomalies(counts: DataFrame, key: list[str], order: str, n: str = "n", back: int = 7, least: int = 3, low: float = 0.5, high: float = 1.5) -> DataFrame:
    """Adds usual (median of up to `back` earlier runs, if there are `least`) and odd (outside `low`..`high` times it)."""
    from pyspark.sql import Window

    w = Window.partitionBy(*key).orderBy(order).rowsBetween(-back, -1)
    usual = F.when(F.count(n).over(w) >= least, F.percentile(n, F.lit(0.5)).over(w))
    df = counts.withColumn("usual", usual)
    return df.withColumn("odd", F.coalesce((F.col(n) < low * F.col("usual")) | (F.col(n) > high * F.col("usual")), F.lit(False)))
