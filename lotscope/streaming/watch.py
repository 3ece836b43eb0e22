"""The same operators over streams: batches judged whole before they count, and windows over late events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lotscope.operators.tracking import daily, integrity


def windowed_counts(events: DataFrame, at: str, kind: str, window: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event-time window; events later than `late` are dropped."""
    w = F.window(at, window, slide) if slide else F.window(at, window)
    return events.withWatermark(at, late).groupBy(w.alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), kind, "n")


def burn_rate(events: DataFrame, at: str, failed: str, target: float, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """How many times faster than allowed the error budget of `target` is used up, by window."""
    out = events.withWatermark(at, late).groupBy(F.window(at, window).alias("w")).agg(F.count("*").alias("n"), F.sum(F.col(failed).cast("int")).alias("bad"))
    return out.select(F.col("w.start").alias("start"), "n", "bad", (F.col("bad") / F.col("n") / (1 - target)).alias("burn"))


def gated_snapshots(fetches: DataFrame, sink: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Days are judged whole before their states count: suspect days are dropped, partial ones keep no absences.

    A micro-batch's rows are kept as they came; every day that it touches is judged anew over all rows of that day so far, and what that gives replaces the
    day's earlier judgement (`kept_days`). Each epoch has folders of its own, so a batch that is run again writes the same.
    """

    def keep(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{sink}/raw/epoch={epoch}")
        raw = spark.read.parquet(f"{sink}/raw").where(F.col("epoch") <= epoch)
        touched = raw.where(F.col("epoch") == epoch).select("day").distinct()
        whole = raw.drop("epoch").join(touched, "day", "left_semi")
        verdict = integrity(whole)
        verdict.write.mode("overwrite").parquet(f"{sink}/verdicts/epoch={epoch}")
        daily(whole, verdict).write.mode("overwrite").parquet(f"{sink}/states/epoch={epoch}")

    return fetches.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def kept_days(spark: SparkSession, sink: str) -> DataFrame:
    """(item, day, status, price) of gated_snapshots so far, each day by its last judgement."""
    last = spark.read.parquet(f"{sink}/verdicts").groupBy("day").agg(F.max("epoch").alias("epoch"))
    return spark.read.parquet(f"{sink}/states").join(last, ["day", "epoch"], "left_semi").select("item", "day", "status", "price")


STATE = "status string, price long, day date"
EVENT = "item long, day date, event string, before long, after long"


def tracked(days: DataFrame) -> DataFrame:
    """Events of each item from a stream of (item, day, status, price), one row an item and day: the last certain state is kept between batches.

    A row of a day that isn't after the last one counted changes nothing any more; it is told as an event of its own, late.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        status, price, last = state.get if state.exists else (None, None, None)
        out = []
        rows = pd.concat(list(batches)).sort_values("day")
        for r in rows.itertuples():
            if r.status == "unknown":
                continue
            if last is not None and r.day <= last:
                out.append((key[0], r.day, "late", None, None))
                continue
            now = None if pd.isna(r.price) else int(r.price)
            if r.status == "present":
                if status is None:
                    out.append((key[0], r.day, "appeared", None, None))
                elif status == "absent":
                    out.append((key[0], r.day, "reappeared", None, None))
                if price is not None and now is not None and now != price:
                    out.append((key[0], r.day, "price_change", price, now))
                price = now if now is not None else price
            elif status == "present":
                out.append((key[0], r.day, "disappeared", None, None))
            status, last = r.status, r.day
        if status is not None:
            state.update((status, price, last))
        pdf = pd.DataFrame(out, columns=["item", "day", "event", "before", "after"])
        yield pdf.astype({"before": "Int64", "after": "Int64", "item": "int64"})

    return days.groupBy("item").applyInPandasWithState(step, EVENT, STATE, "append", "NoTimeout")
