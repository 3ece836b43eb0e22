"""Reports over runs and corpora: how long runs take, what alerts they raise, what is lost between stages, whether arms differ, and how deep a corpus is."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Policy (fixed values).
COUNT_LOW, COUNT_HIGH, COUNT_RUNS, COUNT_LEAST = 0.5, 1.5, 7, 3
SAME_ARMS = 0.8
LEAST_A_TRIM, HELD_OUT, JUDGEABLE, COVERED = 5, 0.25, 58, 0.70


def run_days(runs: DataFrame) -> DataFrame:
    """Of each day: the collected runs' time one after another (the sum of each source's longest) and side by side (the longest of all). A run that ends before it starts doesn't count."""
    took = runs.where("outcome = 'collected' and took >= 0").groupBy("day", "source").agg(F.max("took").alias("longest"))
    return took.groupBy("day").agg(F.count("*").alias("sources"), F.sum("longest").alias("one_after_another"), F.max("longest").alias("side_by_side"))


def loglog_slope(t_small: Column, t_big: Column, n_small: Column, n_big: Column) -> Column:
    """How time grows with size, as a power; null where a time isn't positive."""
    return F.when((t_small > 0) & (t_big > 0), F.ln(t_big / t_small) / F.ln(n_big / n_small))


def alerts(runs: DataFrame) -> DataFrame:
    """(key, source, run_id, kind) of what single runs raise: a run that stopped, a robots file that isn't the last known one, a count far from the middle of the runs before it that went as deep.

    runs: source, run_id, day, outcome, robots (hash or null), pages, listings. Runs are in the order of day and id.
    """
    order = Window.partitionBy("source").orderBy("day", "run_id")
    seen = runs.withColumn("was", F.last("robots", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    alike = Window.partitionBy("source", "pages").orderBy("day", "run_id").rowsBetween(-COUNT_RUNS, -1)
    counted = runs.where("outcome = 'collected' and listings is not null").withColumns({"n": F.count("listings").over(alike), "some": F.array_sort(F.collect_list("listings").over(alike))})
    counted = counted.where("n > 0").withColumn("mid", (F.expr("get(some, int((n - 1) div 2))") + F.expr("get(some, int(n div 2))")) / 2)
    odd = counted.where((F.col("n") >= COUNT_LEAST) & ~F.col("listings").between(COUNT_LOW * F.col("mid"), COUNT_HIGH * F.col("mid")))
    out = None
    for kind, rows in (("stopped", runs.where("outcome <> 'collected'")), ("robots", seen.where("robots is not null and was is not null and robots <> was")), ("count", odd)):
        some = rows.select(F.concat(F.lit(f"{kind}:"), F.col("run_id").cast("string")).alias("key"), "source", F.col("run_id").cast("string").alias("run_id"), F.lit(kind).alias("kind"))
        out = some if out is None else out.union(some)
    return out


def missing(runs: DataFrame, expected: DataFrame, days: DataFrame) -> DataFrame:
    """(key, source, day) of every expected source and day without any run."""
    return expected.crossJoin(days).join(runs.select("source", "day").distinct(), ["source", "day"], "left_anti").select(F.concat_ws(":", F.lit("missing"), "source", F.col("day").cast("string")).alias("key"), "source", "day")


def unsaid(found: DataFrame, said: DataFrame) -> DataFrame:
    """Alerts whose key hasn't been said, each once."""
    return found.join(said.select("key"), "key", "left_anti").dropDuplicates(["key"])


def eligibility_changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """One row: eligible before and after, lost on the way (or not there any more), and gained, which must be none. Both have `key` and eligible; rows that share a key count as one, eligible if any is."""
    before, after = (df.groupBy(key).agg(F.max("eligible").alias("eligible")) for df in (before, after))
    both = before.select(key, F.col("eligible").alias("a")).join(after.select(key, F.col("eligible").alias("b")), key, "left").select(F.col("a"), F.coalesce("b", F.lit(False)).alias("b"))
    counts = both.agg(F.count_if("a").alias("before"), F.count_if(F.col("a") & ~F.col("b")).alias("lost"), F.count_if(~F.col("a") & F.col("b")).alias("gained"))
    return counts.crossJoin(after.agg(F.count_if("eligible").alias("after")))


def field_survival(parsed: DataFrame, snapshot: DataFrame, published: DataFrame, fields: list[str]) -> DataFrame:
    """(field, parsed, snapshot, published, lost): rows of the same parsed listings that hold a field at each stage; lost: they held it when parsed and not when published.

    Ids of later stages may carry their source before a colon; of rows that share an id any may hold a field.
    """
    bare = lambda df, p: df.groupBy(F.substring_index("listing_id", ":", -1).alias("id")).agg(*(F.max(F.col(f).isNotNull()).alias(f"{p}_{f}") for f in fields))
    both = bare(parsed, "a").join(bare(snapshot, "b"), "id", "left").join(bare(published, "c"), "id", "left")
    held = lambda p, f: F.coalesce(F.col(f"{p}_{f}"), F.lit(False))
    rows = [F.struct(F.lit(f).alias("field"), *(F.count_if(held(p, f)).alias(n) for p, n in (("a", "parsed"), ("b", "snapshot"), ("c", "published"))), F.count_if(held("a", f) & ~held("c", f)).alias("lost")) for f in fields]
    return both.agg(F.array(*rows).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def arm_overlap(rows: DataFrame, arm: str, key: str) -> DataFrame:
    """One row: distinct keys in any arm, in every arm, the share of the second in the first, and whether the arms are the same question under other names."""
    arms = rows.select(arm).distinct().count()
    per = rows.groupBy(key).agg(F.countDistinct(arm).alias("n"))
    out = per.agg(F.count("*").alias("in_any"), F.count_if(F.col("n") == arms).alias("in_all"))
    return out.withColumn("share", F.coalesce(F.try_divide("in_all", "in_any"), F.lit(0.0))).withColumn("same", F.col("share") > SAME_ARMS)


def date_tables(rows: DataFrame) -> DataFrame:
    """(binned_by, bin, shown, not_shown): dated rows by age in days, and by the phrase's days where a phrase is shown. rows: age, phrase_days."""
    dated = rows.where("age is not null")
    shown = F.col("phrase_days").isNotNull()
    of = lambda name, days: dated.groupBy(F.lit(name).alias("binned_by"), F.when(days <= 6, "0-6").otherwise("7+").alias("bin")).agg(F.count_if(shown).alias("shown"), F.count_if(~shown).alias("not_shown"))
    return of("title age", F.col("age")).union(of("phrase", F.coalesce("phrase_days", "age")))


def term_liveness(rows: DataFrame, terms: dict[str, Column]) -> DataFrame:
    """(term, present, distinct, live): a term that is the same everywhere moves no score, whatever its weight."""
    cols = [F.struct(F.lit(t).alias("term"), F.count(c).alias("present"), F.count_distinct(c).alias("distinct")) for t, c in terms.items()]
    return rows.agg(F.array(*cols).alias("x")).select(F.explode("x").alias("x")).select("x.*").withColumn("live", F.col("distinct") > 1)


def depth_change(before: DataFrame, after: DataFrame, by: str, trim: str) -> DataFrame:
    """(by, n_before, n_after, trims_before, trims_after, covered_before, covered_after, deeper): whether more rows reached trims that lacked them, or only raised counts."""

    def side(df: DataFrame, name: str) -> DataFrame:
        c = df.where(F.col(trim).isNotNull()).groupBy(by, trim).agg(F.count("*").alias("c"))
        return c.groupBy(by).agg(F.sum("c").alias(f"n_{name}"), F.count("*").alias(f"trims_{name}"), (F.sum(F.when(F.col("c") >= LEAST_A_TRIM, F.col("c")).otherwise(0)) / F.sum("c")).alias(f"covered_{name}"))

    both = side(before, "before").join(side(after, "after"), by, "full")
    return both.na.fill(0).withColumn("deeper", F.col("covered_after") > F.col("covered_before") + 0.005)


def trim_profile(counts: list[int]) -> dict[str, float]:
    """What a corpus of trims of these sizes lets a gate judge: rows, trims, rows of thin trims, rows of held-out trims (each in the order of a hash of its place), and the share in trims that are deep enough."""
    import hashlib

    order = sorted(range(len(counts)), key=lambda i: hashlib.sha256(f"trim {i}".encode()).digest())
    held = set(order[: max(1, int(len(counts) * HELD_OUT))])
    total = sum(counts)
    return {
        "eligible": total, "trims": len(counts), "thin": sum(c for i, c in enumerate(counts) if i not in held and c < LEAST_A_TRIM), "held_out": sum(counts[i] for i in held if i < len(counts)),
        "coverage": sum(c for c in counts if c >= LEAST_A_TRIM) / total if total else 0.0,
    }


def smallest_corpus(counts: list[int], mode: str, steps: int = 6000) -> dict[str, float] | None:
    """The first profile, growing by hundredths, in which thin and held-out trims can be judged: deeper trims, more trims, or both (with enough of it covered). None if none is."""
    base = sorted(counts)

    def grown(k: float) -> list[int]:
        if mode == "deepen":
            return [max(1, round(c * k)) for c in base]
        if mode == "broaden":
            return [base[i % len(base)] for i in range(round(len(base) * k))]
        return [max(LEAST_A_TRIM, c) for c in base] + [LEAST_A_TRIM - 1] * round(len(base) * (k - 1))

    for step in range(1, steps + 1):
        k = 1 + step / 100
        got = trim_profile(grown(k))
        if min(got["thin"], got["held_out"]) >= JUDGEABLE and (mode in ("deepen", "broaden") or got["coverage"] >= COVERED):
            return got | {"k": k}
    return None


def page(df: DataFrame, order: list[Column], size: int, number: int = 0) -> DataFrame:
    """One page of an ordered list; the order must be total, so that pages don't overlap."""
    return df.orderBy(*order).offset(size * number).limit(size)


def by_price(price: str = "price", position: str = "listing_id") -> list[Column]:
    """The order of a price list: priced ones first, cheap ones before, ties by position."""
    return [F.col(price).isNull().asc(), F.col(price).asc(), F.col(position).asc()]


def most_common(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent values with their counts; ties by value."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc(column)).limit(k)


def in_request_order(df: DataFrame, key: str, asked: list) -> DataFrame:
    """(place, found, columns of df): one row for each asked key, in the order asked, whether there is such a row or not."""
    kind = dict(df.dtypes)[key]
    places = df.sparkSession.createDataFrame(list(enumerate(asked, 1)), f"place int, {key} {kind}")
    return places.join(df.withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False))).orderBy("place")


def intersect_all(rows: DataFrame, arm: str, key: str) -> DataFrame:
    """Keys that every arm holds."""
    arms = rows.select(arm).distinct().count()
    return rows.groupBy(key).agg(F.countDistinct(arm).alias("n")).where(F.col("n") == arms).select(key)


def found_by_source_id(tracked: DataFrame, ids: DataFrame) -> DataFrame:
    """(source_id, tracking_id) of the asked source ids among the tracked items' source_ids."""
    return tracked.select("tracking_id", F.explode("source_ids").alias("source_id")).join(ids.select("source_id").distinct(), "source_id").select("source_id", "tracking_id")


def union_isolated(readers: dict[str, Callable[[], DataFrame]]) -> tuple[DataFrame | None, dict[str, str]]:
    """All sources that can be read, by name, and why the others can't: one that fails doesn't take the rest with it."""
    out, failed = None, {}
    for name, read in readers.items():
        try:
            df = read().withColumn("source", F.lit(name))
        except Exception as e:  # noqa: BLE001  a source may fail in any way
            failed[name] = f"{type(e).__name__}: {str(e)[:200]}"
            continue
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out, failed
