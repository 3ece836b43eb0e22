"""Price quantiles: splits without leaks, shift, metrics, comparables, ridge and partial pooling, and the gates before any answer."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotscope.operators.quality import assert_not_features
from lotscope.operators.store import written

QUANTILES = (0.15, 0.35, 0.50, 0.85)
# Policy (fixed values).
LEAST_SIDE, MAX_KS, MAX_RATIO = 93, 0.2, 0.1
LEAST_SLICE, LEAST_SLICE_POOLED = 150, 58
LEAST_COMPARABLES = 5
LEAST_TRIM, BORROWED, NOMINAL = 5, 0.50, 0.70
#: Of exact_quantiles: a sketch is off by a ten-thousandth of a group's rows at most.
SLACK, WHOLE = 0.001, 10_000


def temporal_split(df: DataFrame, share: float = 0.3, cluster: str = "cluster_id", at: str = "ordinal") -> DataFrame:
    """Adds side: train, test or straddling. Clusters are ordered by when they were first seen; the last `share` of them are the test, and
    clusters with rows on both sides of the cutoff, seen first before it, are dropped from both."""
    per = df.groupBy(cluster).agg(F.min(at).alias("lo"), F.max(at).alias("hi"))
    n = per.count()
    if not n:
        return df.withColumn("side", F.lit("train"))
    test = max(1, round(n * share))
    # The cutoff is an order statistic of one number for each cluster: counts by day are few.
    days = per.groupBy("lo").agg(F.count("*").alias("c"))
    upto = days.withColumn("upto", F.sum("c").over(Window.orderBy("lo")))
    cutoff = upto.where(F.col("upto") >= max(1, n - test)).agg(F.min("lo")).first()[0]
    side = F.when((F.col("lo") <= cutoff) & (F.col("hi") > cutoff), "straddling").when(F.col("lo") > cutoff, "test").otherwise("train")
    return df.join(per.select(cluster, side.alias("side")), cluster)


def hashed_split(df: DataFrame, share: float, cluster: str, seed: str) -> DataFrame:
    """Adds side by a hash of the cluster: no cluster is on both, and reruns agree."""
    u = F.conv(F.substring(F.sha2(F.concat(F.lit(seed), F.col(cluster).cast("string")), 256), 1, 8), 16, 10).cast("double") / 4294967296.0
    return df.withColumn("side", F.when(u < share, "test").otherwise("train"))


def shift(df: DataFrame, value: str, side: str = "side") -> DataFrame:
    """Kolmogorov-Smirnov distance of train and test, ratio of medians, and a verdict; too few rows on a side are a verdict too."""
    rows = df.where(F.col(value).isNotNull() & F.col(side).isin("train", "test"))
    per = rows.groupBy(value).agg(F.count_if(F.col(side) == "train").alias("a"), F.count_if(F.col(side) == "test").alias("b"))
    sizes = rows.agg(F.count_if(F.col(side) == "train").alias("n_train"), F.count_if(F.col(side) == "test").alias("n_test"), F.percentile(F.when(F.col(side) == "train", F.col(value)), F.lit(0.5)).alias("m_train"), F.percentile(F.when(F.col(side) == "test", F.col(value)), F.lit(0.5)).alias("m_test"))
    na, nb = (lambda r: (r["n_train"] or 1, r["n_test"] or 1))(sizes.first())
    # Two levels of running sums: within ranges of the value, then over the ranges' totals.
    width = 200
    ranged = per.repartitionByRange(width, value).withColumn("part", F.spark_partition_id()).persist()
    inner = Window.partitionBy("part").orderBy(value)
    before = ranged.groupBy("part").agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    outer = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("part", F.coalesce(F.sum("ta").over(outer), F.lit(0)).alias("pa"), F.coalesce(F.sum("tb").over(outer), F.lit(0)).alias("pb"))
    gap = F.abs((F.sum("a").over(inner) + F.col("pa")) / F.lit(float(na)) - (F.sum("b").over(inner) + F.col("pb")) / F.lit(float(nb)))
    ks = ranged.join(before, "part").select(gap.alias("gap")).agg(F.max("gap")).first()[0]
    out = sizes.withColumn("ks", F.lit(ks).cast("double"))
    ratio = F.try_divide(F.col("m_test"), F.col("m_train"))
    few = (F.col("n_train") < LEAST_SIDE) | (F.col("n_test") < LEAST_SIDE)
    verdict = F.when(few, "insufficient").when((F.col("ks") > MAX_KS) | (F.abs(ratio - 1) > MAX_RATIO), "shifted").otherwise("comparable")
    return out.select("n_train", "n_test", "ks", ratio.alias("ratio"), verdict.alias("verdict"))


def exact_quantiles(df: DataFrame, value: str, at: tuple[float, ...], by: str | None = None) -> DataFrame:
    """(by, q): the interpolated quantiles of a number, as F.percentile gives them, though no task holds all of a group's values. Nulls don't count; nothing for a group without values.

    A sketch brackets each wanted rank within SLACK of the group's rows (groups of fewer than WHOLE are bracketed whole); the values below a bracket are counted, those inside
    are counted one by one and put in order. A bracket that misses its rank is told by these counts, and such a group goes to F.percentile. `df` is read twice: give a written table.
    """
    rows = df.select(F.lit(0).alias("g") if by is None else F.col(by).alias("g"), F.col(value).cast("double").alias("v")).where("v is not null")
    k = len(at)
    asked = [x for t in at for x in (max(0.0, t - SLACK), min(1.0, t + SLACK))]
    sketch = rows.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), F.percentile_approx("v", F.array(*map(F.lit, asked)), 10_000).alias("s"))
    edge = lambda i, end: F.when(F.col("n") < WHOLE, F.col(end)).otherwise(F.col("s")[i])
    sketch = written(sketch.select("g", "n", *(edge(2 * i, "least").alias(f"lo{i}") for i in range(k)), *(edge(2 * i + 1, "most").alias(f"hi{i}") for i in range(k))), "brackets")
    if by is None:
        known = sketch.first()
        met = rows.withColumns({c: F.lit(known[c] if known else None).cast("double") for c in sketch.columns if c not in ("g", "n")})
    else:
        met = rows.join(sketch.drop("n"), rows["g"].eqNullSafe(sketch["g"])).drop(sketch["g"])
    # In one pass: how many are on the same side of every bracket, and of each value that is inside of any. Bits name brackets.
    bits = lambda ok: sum((F.when(ok(i), 1 << i).otherwise(0) for i in range(k)), F.lit(0))
    met = met.select("g", "v", bits(lambda i: F.col("v") < F.col(f"lo{i}")).alias("under"), bits(lambda i: F.col("v").between(F.col(f"lo{i}"), F.col(f"hi{i}"))).alias("within"))
    met = written(met.groupBy("g", "under", "within", F.when(F.col("within") > 0, F.col("v")).alias("v")).agg(F.count("*").alias("c")), "counts")
    has = lambda c, i: F.col(c).bitwiseAND(F.lit(1 << i)) != 0
    below = met.groupBy("g").agg(*(F.sum(F.when(has("under", i), F.col("c")).otherwise(0)).alias(f"b{i}") for i in range(k)))
    inside = met.where("within > 0").withColumn("i", F.explode(F.filter(F.array(*(F.when(has("within", i), i) for i in range(k))), lambda x: x.isNotNull())))
    upto = inside.select("g", "i", "v", F.sum("c").over(Window.partitionBy("g", "i").orderBy("v")).alias("upto")).alias("x")
    ranks = sketch.select("g", "n").alias("y").join(below, F.col("y.g").eqNullSafe(below["g"])).select("y.g", "n", F.array(*(F.col(f"b{i}") for i in range(k))).alias("b")).alias("y")
    place = (F.col("n") - 1) * F.element_at(F.array(*map(F.lit, at)), F.col("i") + 1)
    upto = upto.join(ranks, F.col("x.g").eqNullSafe(F.col("y.g"))).select("x.g", "i", "v", (F.col("b")[F.col("i")] + F.col("upto")).alias("upto"), F.col("b")[F.col("i")].alias("b"), place.alias("place"))
    first = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("v")))
    found = upto.groupBy("g", "i", "place", "b").agg(first(F.floor("place")).alias("a"), first(F.ceil("place")).alias("z"))
    part = F.col("place") - F.floor("place")
    each = found.select("g", "i", F.when(F.col("b") <= F.floor("place"), F.when(part == 0, F.col("a")).otherwise((1 - part) * F.col("a") + part * F.col("z"))).alias("q"))
    out = written(each.groupBy("g").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "q"))), lambda x: x["q"]).alias("q")), "quantiles")
    missed = (F.size("q") < k) | F.exists("q", lambda x: x.isNull())
    if out.where(missed).limit(1).count():
        again = out.where(missed).select(F.col("g").alias("m"))
        plain = rows.join(again, F.col("g").eqNullSafe(F.col("m")), "left_semi").groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, at))).alias("q"))
        out = out.where(~missed).union(plain)
    return out.select("q") if by is None else out.withColumnRenamed("g", by)


def pinball(y: Column, q: Column, tau: float) -> Column:
    return F.greatest(F.lit(tau) * (y - q), F.lit(tau - 1) * (y - q))


def metrics(df: DataFrame, by: list[str], y: str = "price", quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """Of each slice: rows, mean pinball loss and coverage for each quantile column q1.., width, interval coverage, crossing rate before rearrangement."""
    qs = [F.col(f"q{i + 1}") for i in range(len(quantiles))]
    crossing = F.greatest(*((b < a).cast("int") for a, b in zip(qs, qs[1:], strict=False)))
    loss = sum((pinball(F.col(y), q, t) for q, t in zip(qs, quantiles, strict=True)), F.lit(0.0)) / len(qs)
    cover = [F.avg((F.col(y) <= q).cast("int")).alias(f"coverage{i + 1}") for i, q in enumerate(qs)]
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(loss).alias("pinball"), *cover, F.avg(((F.col(y) >= qs[0]) & (F.col(y) <= qs[-1])).cast("int")).alias("inside"), F.avg(crossing).alias("crossing"))


def wilson(df: DataFrame, share: str, n: str, z: float = 1.96) -> DataFrame:
    """Adds low and high: the Wilson interval of a share of n, within [0, 1]."""
    p, m = F.col(share), F.col(n)
    mid, half = p + z * z / (2 * m), z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m))
    base = 1 + z * z / m
    return df.withColumn("low", F.greatest(F.lit(0.0), (mid - half) / base)).withColumn("high", F.least(F.lit(1.0), (mid + half) / base))


def significant_error(df: DataFrame, n: str = "n", quantiles: tuple[float, ...] = QUANTILES, z: float = 2.5) -> DataFrame:
    """Adds off: the largest coverage error of columns coverage1.. that exceeds z standard errors of a share of n; 0 if none does."""
    worst = F.lit(0.0)
    for i, t in enumerate(quantiles):
        gap = F.abs(F.col(f"coverage{i + 1}") - t)
        worst = F.greatest(worst, F.when(gap > z * F.sqrt(F.lit(t * (1 - t)) / F.col(n)), gap).otherwise(0.0))
    return df.withColumn("off", worst)


def sliced(df: DataFrame, key: str, predicted: str = "q3", km: str = "mileage_km") -> DataFrame:
    """Each row once for each slice it is in: its model, its band of the predicted middle (never of the price itself), its band of mileage. All in one pass."""
    p, m = F.col(predicted), F.col(km)
    bands = F.array(
        F.concat(F.lit("model="), F.col(key)),
        F.when(p < 5e8, "pred<500M").when(p < 1e9, "pred 500M-1B").when(p < 2e9, "pred 1-2B").otherwise("pred>=2B"),
        F.when(m < 5e4, "km<50k").when(m < 1.5e5, "km 50-150k").when(m < 2.5e5, "km 150-250k").otherwise("km>=250k"),
    )
    return df.withColumn("slice", F.explode(bands))


def benchmark(predicted: DataFrame, key: str, y: str = "price") -> DataFrame:
    """(slice, n, pinball, coverage1.., inside, crossing, off) of held-out predictions q1.. as they came: overall and for every slice, coverage after rearrangement, crossing before."""
    qs = [F.col(f"q{i + 1}") for i in range(len(QUANTILES))]
    crossed = F.greatest(*((b < a).cast("int") for a, b in zip(qs, qs[1:], strict=False)))
    rows = predicted.withColumn("crossed", crossed).withColumns(monotone())
    rows = sliced(rows, key).unionByName(rows.withColumn("slice", F.lit("overall")))
    out = metrics(rows, ["slice"], y).drop("crossing").join(rows.groupBy("slice").agg(F.avg("crossed").alias("crossing")), "slice")
    return significant_error(out)


def within_split(df: DataFrame, share: float = 0.3, seed: str = "split", id_col: str = "listing_id", car: tuple[str, ...] = ("model_key", "year", "mileage_km", "price")) -> DataFrame:
    """Adds cluster (the smallest id of the car) and side: cars are rows joined by equal `car` columns or equal ids; of the cars in the order of a seeded hash the first share are the test.

    The cut is found by a count of cars for each of 4,096 buckets of the hash, so no task sorts them all; within the bucket of the cut by rank.
    """
    from lotscope.operators.linkage import same_item

    rows = df.withColumn("_row", F.xxhash64(id_col, *car)).withColumn("_car", F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in car)))
    item = same_item(rows.select("_row", id_col, "_car").distinct(), "_row", [[id_col], ["_car"]])
    named = rows.join(item.withColumnRenamed("id", "_row"), "_row")
    cars = named.groupBy("item").agg(F.min(id_col).alias("cluster")).withColumn("h", F.sha2(F.concat(F.lit(seed), "cluster"), 256)).withColumn("b", F.substring("h", 1, 3))
    counts = cars.groupBy("b").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    upto = F.coalesce(F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("b").orderBy("h"))
    ranked = cars.join(counts.withColumn("upto", upto).drop("n"), "b").withColumn("side", F.when(F.col("upto") + place <= max(1, round(total * share)), "test").otherwise("train"))
    return named.join(ranked.select("item", "cluster", "side"), "item").drop("_row", "_car", "item")


def held_out_groups(df: DataFrame, group: str, share: float = 0.2, seed: str = "trims") -> DataFrame:
    """Adds held_out: whole groups, the first share of them (one at least) in the order of a seeded hash."""
    # Written, so that `df` is not searched for its groups again by all that reads the result.
    groups = written(df.select(group).distinct().withColumn("h", F.sha2(F.concat(F.lit(seed), F.col(group).cast("string")), 256)), "groups")
    total = groups.count()
    out = groups.orderBy("h").limit(max(1, int(total * share))).select(group, F.lit(True).alias("held_out"))
    return df.join(out, group, "left").withColumn("held_out", F.coalesce("held_out", F.lit(False)))


def evidence_quality(tier: Column, n: Column, dispersion: Column) -> Column:
    """high, medium or low: what comparables of this tier, number and spread are worth."""
    return F.when(tier.isin("model_only", "global") | (n < 8), "low").when((tier == "strict") & (n >= 25) & (dispersion < 0.35), "high").otherwise("medium")


def monotone(quantiles: int = len(QUANTILES)) -> dict[str, Column]:
    """Columns q1.. sorted within each row."""
    ordered = F.array_sort(F.array(*(F.col(f"q{i + 1}") for i in range(quantiles))))
    return {f"q{i + 1}": F.element_at(ordered, i + 1) for i in range(quantiles)}


def comparables(test: DataFrame, train: DataFrame, key: str, id_col: str, least: int = LEAST_COMPARABLES, quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """For each test row the tightest tier with `least` comparables: strict (year +-1 and mileage +-30 %), relaxed_mileage, relaxed_year,
    model_only or global; with their number, dispersion and price quantiles.

    Both sides are first reduced to cells: train rows to their distinct (year, mileage, price) of a model, with counts, test rows to their
    distinct (year, mileage) of a model. Cells meet within their model, and as they are grouped by it again, nothing is dealt out
    a second time. Counts settle the tier; quantiles are then taken over the cells of that tier only, by their counts.
    """
    cells = train.groupBy(key, "year", "mileage_km", "price").agg(F.count("*").alias("w"))
    near_year = F.abs(F.col("t.year") - F.col("c.year")) <= 1
    near_km = (F.col("t.mileage_km") <= 0) | (F.abs(F.col("c.mileage_km") - F.col("t.mileage_km")) <= 0.3 * F.col("t.mileage_km"))
    tiers = {"strict": near_year & near_km, "relaxed_mileage": near_year, "relaxed_year": near_km, "model_only": F.lit(True)}
    at = [key, "year", "mileage_km"]
    here = [F.col(f"t.{c}").alias(c) for c in at]
    wanted = test.select(*at).distinct()
    asked = (*quantiles, 0.25, 0.75, 0.5)
    counts = [F.sum(F.when(ok, F.col("c.w")).otherwise(0)).alias(f"n_{name}") for name, ok in tiers.items()]
    per = wanted.alias("t").join(cells.alias("c"), F.col(f"t.{key}") == F.col(f"c.{key}")).groupBy(*here).agg(*counts)
    every = train.agg(F.count("*").alias("n"), F.percentile("price", F.array(*map(F.lit, asked))).alias("q")).first()
    per = per.withColumn("tier", F.coalesce(*(F.when(F.col(f"n_{name}") >= least, name) for name in tiers), F.lit("global")))
    per = per.withColumn("n", F.coalesce(*(F.when(F.col("tier") == name, F.col(f"n_{name}")) for name in tiers), F.lit(every["n"]))).select(*at, "tier", "n")
    inside = F.coalesce(*(F.when(F.col("t.tier") == name, ok) for name, ok in tiers.items()), F.lit(False))
    own = per.where("tier <> 'global'").alias("t").join(cells.alias("c"), (F.col(f"t.{key}") == F.col(f"c.{key}")) & inside)
    own = own.groupBy(*here, F.col("t.tier").alias("tier"), F.col("t.n").alias("n")).agg(F.percentile(F.col("c.price"), F.array(*map(F.lit, asked)), F.col("c.w")).alias("q"))
    out = test.join(own.withColumnsRenamed({c: f"_{c}" for c in at}), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in at], "left")
    out = out.withColumns({"tier": F.coalesce("tier", F.lit("global")), "n": F.coalesce("n", F.lit(every["n"]))})
    world = every["q"] or [None] * len(asked)
    pick = lambda i: F.coalesce(F.col("q")[i], F.lit(world[i]).cast("double"))
    spread = F.try_divide(pick(-2 + len(asked)) - pick(-3 + len(asked)), pick(-1 + len(asked)))
    return out.select(id_col, "price", "tier", "n", spread.alias("dispersion"), *(pick(i).alias(f"q{i + 1}") for i in range(len(quantiles))))


def parent_median_baseline(test: DataFrame, train: DataFrame, key: str, y: str = "price") -> DataFrame:
    """Adds baseline: the train median of the row's parent, or of everything."""
    parent = written(train.groupBy(key).agg(F.percentile(y, F.lit(0.5)).alias("parent_median")), "parents")
    # The train side is put in order as a whole only where a test row needs that.
    lone = test.join(parent.where("parent_median is not null"), key, "left_anti").limit(1).count()
    overall = ((exact_quantiles(train, y, (0.5,)).first() or [[None]])[0])[0] if lone else None
    return test.join(parent, key, "left").withColumn("baseline", F.coalesce("parent_median", F.lit(overall).cast("double"))).drop("parent_median")


@dataclass
class Ridge:
    """Centred ridge regression: (X'X + alpha I)^-1 X'y. The sums over rows are one Spark aggregate; only that small matrix reaches the driver."""

    features: list[str]
    alpha: float = 1.0
    coef: np.ndarray = field(default_factory=lambda: np.zeros(0))
    intercept: float = 0.0

    def fit(self, df: DataFrame, y: str) -> Ridge:
        assert_not_features(self.features)
        cols = [*self.features, y]
        centre = df.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(cols))).first()
        mean = np.array([x if x is not None else 0.0 for x in centre])
        d = [F.col(c) - F.lit(float(m)) for c, m in zip(cols, mean, strict=True)]
        k = len(cols)
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        got = df.agg(*(F.sum(d[i] * d[j]).alias(f"s{i}_{j}") for i, j in pairs)).first()
        s = np.zeros((k, k))
        for (i, j), v in zip(pairs, got, strict=True):
            s[i, j] = s[j, i] = v or 0.0
        return self.solved(mean, s)

    def solved(self, mean: np.ndarray, s: np.ndarray) -> Ridge:
        """From the means of the features and y, in this order, and the sums of their centred products."""
        self.coef = np.linalg.solve(s[:-1, :-1] + self.alpha * np.eye(len(s) - 1), s[:-1, -1])
        self.intercept = float(mean[-1] - mean[:-1] @ self.coef)
        return self

    def predict(self) -> Column:
        return sum((F.col(f) * float(c) for f, c in zip(self.features, self.coef, strict=True)), F.lit(self.intercept))


#: What a model of log price reads of a row.
READ = ("f_year", "f_km", "y")


def moments(rows: DataFrame, *by: str) -> DataFrame:
    """(by.., n, means of READ by their names, mean centred products c0_0, c0_1..) of each group, apart by which features are missing: all that linear fits
    need of the rows, in one pass, and as stable as deviations are."""
    missing = [F.col(c).isNull().alias(f"no_{c}") for c in READ[:-1]]
    products = [F.covar_pop(a, b).alias(f"c{i}_{j}") for i, a in enumerate(READ) for j, b in enumerate(READ) if i <= j]
    return written(rows.groupBy(*by, *missing).agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in READ), *products), "moments")


@dataclass
class LogLinear:
    """Log price by ridge on year and mileage within models' own levels; quantiles of the residuals around it. `train` is read for its moments and twice for the quantiles: give a written table."""

    key: str
    alpha: float = 1.0
    ridge: Ridge | None = None
    residuals: list[float] = field(default_factory=list)
    levels: DataFrame | None = None

    def prepared(self, df: DataFrame) -> DataFrame:
        return df.withColumns({"f_year": (F.col("year") - 1990).cast("double"), "f_km": F.col("mileage_km") / 1e5})

    def logged(self, train: DataFrame) -> DataFrame:
        return self.prepared(train.where("price > 0")).withColumn("y", F.ln("price"))

    def learn(self, cells: DataFrame) -> LogLinear:
        """Levels and slopes, from moments by the key or by more than it."""
        n = F.col("n")
        mean = lambda c: F.sum(n * c) / F.sum(F.when(c.isNotNull(), n))
        self.levels = written(cells.groupBy(self.key).agg(mean(F.col("y")).alias("level_y"), mean(F.col("f_year")).alias("level_year"), mean(F.col("f_km")).alias("level_km")), "levels")
        d = [F.col(c) - F.col(level) for c, level in zip(READ, ("level_year", "level_km", "level_y"), strict=True)]
        pairs = [(i, j) for i in range(len(d)) for j in range(i, len(d))]
        got = cells.join(self.levels, self.key).agg(*(mean(x) for x in d), *(F.sum(n * (F.col(f"c{i}_{j}") + d[i] * d[j])) for i, j in pairs)).first()
        s = np.zeros((len(d), len(d)))
        for (i, j), v in zip(pairs, got[len(d) :], strict=True):
            s[i, j] = s[j, i] = v or 0.0
        self.ridge = Ridge(list(READ[:-1]), self.alpha).solved(np.array([x or 0.0 for x in got[: len(d)]]), s)
        return self

    def fit(self, train: DataFrame) -> LogLinear:
        rows = self.logged(train)
        self.learn(moments(rows, self.key))
        inner = rows.join(self.levels, self.key).select((F.col("f_year") - F.col("level_year")).alias("f_year"), (F.col("f_km") - F.col("level_km")).alias("f_km"), (F.col("y") - F.col("level_y")).alias("y"))
        self.residuals = list(exact_quantiles(inner.select((F.col("y") - self.ridge.predict()).alias("r")), "r", QUANTILES).first()[0])
        return self

    def centred(self, rows: DataFrame) -> DataFrame:
        """Adds mu to rows, or to moments of rows, with f_year and f_km."""
        world = self.levels.agg(F.avg("level_y"), F.avg("level_year"), F.avg("level_km")).first()
        at = lambda c, v: F.coalesce(c, F.lit(v))
        a, b = (float(x) for x in self.ridge.coef)
        mu = at("level_y", world[0]) + a * (F.col("f_year") - at("level_year", world[1])) + b * (F.col("f_km") - at("level_km", world[2])) + self.ridge.intercept
        return rows.join(self.levels, self.key, "left").withColumn("mu", mu).drop("level_y", "level_year", "level_km")

    def predict(self, df: DataFrame) -> DataFrame:
        out = self.centred(self.prepared(df)).drop("f_year", "f_km")
        return out.withColumns({f"q{i + 1}": F.exp(F.col("mu") + r) for i, r in enumerate(self.residuals)})


def spread_of_groups(per: DataFrame) -> tuple[float, float]:
    """Of (group, n, mean, v): the noise within groups, and how much their means differ beyond it."""
    r = per.agg(F.avg(F.when(F.col("n") > 1, F.col("v"))).alias("s2"), F.var_pop("mean").alias("vm"), F.avg("n").alias("n")).first()
    s2 = r["s2"] if r["s2"] is not None else r["vm"] or 0.0  # groups of one value each: their means are all the values
    return s2, max(0.0, (r["vm"] or 0.0) - s2 / max(1, int(r["n"] or 1)))


def shrunk(per: DataFrame, s2: float, t2: float) -> DataFrame:
    """(group, n, mean, lam, offset): each group's mean residual, shrunk by how much groups differ beyond their noise."""
    lam = F.lit(t2) / F.nullif(F.lit(t2) + F.lit(s2) / F.col("n"), F.lit(0.0))
    return per.drop("v").withColumn("lam", F.coalesce(lam, F.lit(0.0))).withColumn("offset", F.col("lam") * F.col("mean"))


def pooled_offsets(rows: DataFrame, group: str, resid: str) -> DataFrame:
    """(group, n, mean, lam, offset) of the groups of some residuals."""
    per = written(rows.groupBy(group).agg(F.count("*").alias("n"), F.avg(resid).alias("mean"), F.var_samp(resid).alias("v")), "groups")
    return shrunk(per, *spread_of_groups(per))


@dataclass
class PartialPooling:
    """Log price by ridge on the parent's level, year and mileage, and each trim's offset from that, shrunk by how much trims differ beyond their noise.

    The parent's levels are a group mean, removed before the ridge (as LogLinear). Residual quantiles are those after offsets; a band widens by the part of the offset
    that wasn't observed. What an estimate borrows stands beside it.
    """

    parent: str = "make"
    trim: str = "model_key"
    base: LogLinear | None = None
    offsets: DataFrame | None = None
    t2: float = 0.0
    residuals: list[float] = field(default_factory=list)
    noise: float = 1e-12

    def fit(self, train: DataFrame) -> PartialPooling:
        """`train` is read for its moments, which give levels, slopes, offsets and noise, and twice for the quantiles: give a written table."""
        self.base = LogLinear(self.parent)
        rows = self.base.logged(train)
        cells = moments(rows, self.parent, self.trim)
        a, b = (float(x) for x in self.base.learn(cells).ridge.coef)
        c = lambda i, j: F.col(f"c{i}_{j}")
        n, r, m = F.col("n"), F.col("r"), F.sum(F.when(F.col("r").isNotNull(), F.col("n")))
        within = c(2, 2) + a * a * c(0, 0) + b * b * c(1, 1) - 2 * a * c(0, 2) - 2 * b * c(1, 2) + 2 * a * b * c(0, 1)
        left = self.base.centred(cells).select(self.trim, "n", (F.col("y") - F.col("mu")).alias("r"), within.alias("within"))
        per = left.groupBy(self.trim).agg(F.sum("n").alias("n"), m.alias("m"), (F.sum(n * r) / m).alias("mean"), F.greatest(F.lit(0.0), F.sum(n * (F.col("within") + r * r)) - F.sum(n * r) * F.sum(n * r) / m).alias("square"))
        per = written(per.withColumn("v", F.col("square") / F.nullif(F.col("m") - 1, F.lit(0))), "groups")
        s2, self.t2 = spread_of_groups(per)
        offsets = shrunk(per, s2, self.t2)
        self.offsets = offsets.drop("m", "square")
        gap = F.col("mean") - F.col("offset")
        got = offsets.where(F.col(self.trim).isNotNull()).agg(F.sum("m").alias("m"), F.sum(F.col("m") * gap).alias("r"), F.sum(F.col("square") + F.col("m") * gap * gap).alias("rr")).first()
        self.noise = (got["rr"] / got["m"] - (got["r"] / got["m"]) ** 2 if got["m"] else None) or 1e-12
        after = self.base.centred(rows).join(self.offsets, self.trim).select((F.col("y") - F.col("mu") - F.col("offset")).alias("r"))
        self.residuals = list(exact_quantiles(after, "r", QUANTILES).first()[0])
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds q1.. in order, n_trim, shrinkage, offset_raw, offset_applied, extrapolated and why (few or borrowed): never an estimate without its trace."""
        out = self.base.predict(df).join(self.offsets.withColumnsRenamed({"n": "n_trim", "mean": "offset_raw", "lam": "shrinkage", "offset": "offset_applied"}), self.trim, "left")
        out = out.na.fill(0, ["n_trim"]).na.fill(0.0, ["offset_raw", "shrinkage", "offset_applied"])
        wide = F.sqrt(1 + (1 - F.col("shrinkage")) * (1 - F.col("shrinkage")) * (self.t2 / self.noise))
        out = out.withColumns({f"q{i + 1}": F.exp(F.col("mu") + F.col("offset_applied") + wide * r) for i, r in enumerate(self.residuals)}).withColumns(monotone())
        why = F.when(F.col("n_trim") < LEAST_TRIM, "few").when(F.col("shrinkage") < BORROWED, "borrowed")
        return out.withColumns({"why": why, "extrapolated": why.isNotNull()}).drop("mu")


def pooled_slices(predicted: DataFrame, trim: str = "model_key", y: str = "price") -> DataFrame:
    """(slice, n, mae, median_ae, coverage, coverage_error, shrinkage, extrapolated, off): well-observed, thin and held-out trims, and each trim with enough rows.

    From PartialPooling.predict and held_out, whether the trim was kept out of fitting, written as it is read four times. off: the coverage error beyond what chance explains.
    """
    kind = F.when(F.col("held_out"), "held-out trim").when(F.col("n_trim") >= LEAST_TRIM, "well-observed trim").when(F.col("n_trim") > 0, "thin trim")
    rows = predicted.withColumn("slice", F.explode(F.array(kind, F.when(~F.col("held_out"), F.concat(F.lit("trim="), F.col(trim)))))).where("slice is not null")
    gap = F.abs(F.col("q3") - F.col(y))
    middle = exact_quantiles(rows.withColumn("gap", gap), "gap", (0.5,), "slice").select(F.col("slice").alias("_slice"), F.col("q")[0].alias("median_ae"))
    out = rows.groupBy("slice").agg(
        F.count("*").alias("n"), F.avg(gap).alias("mae"), F.avg(((F.col(y) >= F.col("q1")) & (F.col(y) <= F.col("q4"))).cast("int")).alias("coverage"),
        F.avg("shrinkage").alias("shrinkage"), F.avg(F.col("extrapolated").cast("int")).alias("extrapolated"),
    )
    out = out.join(middle, F.col("slice") == F.col("_slice"), "left").drop("_slice")
    out = out.where(~F.col("slice").startswith("trim=") | (F.col("n") >= LEAST_SLICE_POOLED)).withColumn("coverage_error", F.abs(F.col("coverage") - NOMINAL))
    return out.withColumn("off", F.greatest(F.lit(0.0), F.col("coverage_error") - 2.5 * F.sqrt(F.lit(NOMINAL * (1 - NOMINAL)) / F.col("n"))))


def four_slices(slices: DataFrame) -> list[dict]:
    """The three kinds of trims that were measured, and the single trim with the worst coverage among those with enough rows."""
    kinds = slices.where(~F.col("slice").startswith("trim="))
    worst = slices.where(F.col("slice").startswith("trim=")).orderBy(F.desc("coverage_error"), "slice").limit(1).withColumn("slice", F.concat(F.lit("worst "), F.col("slice")))
    return [r.asDict() for r in kinds.union(worst).collect()]


@dataclass(frozen=True)
class PooledGate:
    """What a pooled estimator must reach; a fault that was measured outranks a question that the data can't answer."""

    coverage: float = 0.15
    worst: float = 0.25
    mae: float = 1.10

    def reasons(self, slices: list[dict], model_mae: float, baseline_mae: float, population_weighted: bool = False) -> list[tuple[str, str, str]]:
        """(kind, subject, reason), kind failed or unanswered."""
        out = []
        if model_mae > baseline_mae * self.mae:
            out.append(("failed", "mae", f"error {model_mae:.0f} against the baseline's {baseline_mae:.0f}"))
        sure = [s for s in slices if s["n"] >= LEAST_SLICE_POOLED]
        out += [("failed", s["slice"], f"coverage {s['coverage']:.2f} of {s['n']} rows") for s in sure if s["off"] > self.coverage]
        if any(s["off"] > self.worst for s in sure):
            out.append(("failed", "worst slice", f"off by {max(s['off'] for s in sure):.2f}"))
        by = {s["slice"]: s["n"] for s in slices}
        out += [("unanswered", k, f"{by.get(k, 0)} rows, {LEAST_SLICE_POOLED} are needed") for k in ("thin trim", "held-out trim") if by.get(k, 0) < LEAST_SLICE_POOLED]
        if population_weighted:
            out.append(("failed", "weights", "no weight may be drawn from the sample's own shape"))
        return out

    def verdict(self, *args, **kwargs) -> tuple[str, list[tuple[str, str, str]]]:
        why = self.reasons(*args, **kwargs)
        failed = [x for x in why if x[0] == "failed"]
        return ("REJECTED" if failed else "UNJUDGEABLE_SLICE" if why else "ACCEPTED"), why


def synthetic_corpus(spark, rows: int, seed: int = 0) -> DataFrame:
    """A corpus with known structure: log-normal prices around a model's level, falling with age and mileage, beta-like risk. The same seed gives the same rows in any number of partitions of one count."""
    df = spark.range(rows, numPartitions=8).withColumns({"u": F.rand(seed), "z": F.randn(seed + 1), "k": F.rand(seed + 2), "r": F.rand(seed + 3) * F.rand(seed + 4), "a": F.rand(seed + 5)})
    model = F.floor(F.col("u") * 8)
    age, km = F.floor(F.col("a") * 15), F.floor(F.col("k") * 300_000)
    price = F.floor(F.exp(F.lit(20.2) + 0.15 * model - 0.06 * age - km / 8e5 + 0.18 * F.col("z")))
    return df.select(F.col("id").cast("string").alias("listing_id"), F.concat(F.lit("make"), (model % 3).cast("string")).alias("make"), F.concat(F.lit("make"), (model % 3).cast("string"), F.lit("|m"), model.cast("string")).alias("model_key"), (F.lit(1405) - age).cast("int").alias("year"), km.cast("long").alias("mileage_km"), price.cast("long").alias("price"), F.col("r").alias("risk"))


@dataclass(frozen=True)
class Gate:
    """What an estimator must reach before it may answer."""

    coverage: float = 0.07
    worst: float = 0.12
    crossing: float = 0.0

    def verdict(self, overall: dict, slices: list[dict], baseline: float) -> tuple[str, list[str]]:
        """accepted, rejected or unjudgeable, with reasons; a proven fault outranks a lack of rows."""
        bad, dark = [], []
        gap = max(abs(overall[f"coverage{i + 1}"] - t) for i, t in enumerate(QUANTILES))
        if gap > self.coverage:
            bad.append(f"coverage is off by {gap:.3f}")
        if overall["crossing"] > self.crossing:
            bad.append(f"quantiles cross in {overall['crossing']:.3f} of rows")
        if overall["pinball"] >= baseline:
            bad.append("no better than the baseline")
        big = [s for s in slices if s["n"] >= LEAST_SLICE_POOLED]
        if not big:
            dark.append("no slice has enough rows")
        for s in big:
            off = max(abs(s[f"coverage{i + 1}"] - t) for i, t in enumerate(QUANTILES))
            if off > self.worst:
                bad.append(f"slice {s['slice']} is off by {off:.3f}")
        return ("rejected" if bad else "unjudgeable" if dark else "accepted"), bad + dark


class Refused(RuntimeError):
    """An estimator without an accepted benchmark was asked for an answer."""


def serve(verdict: str, predict):
    if verdict != "accepted":
        raise Refused(f"the benchmark's verdict is {verdict}")
    return predict()


def cluster_bootstrap(errors: DataFrame, cluster: str, a: str, b: str, times: int = 10_000, seed: int = 7) -> dict[str, float]:
    """Interval of the difference of two mean errors when clusters are drawn anew, each as often as a Poisson number of mean one that its name and the seed give.

    A task keeps three sums for each draw, whatever the number of its clusters; the draws' sums meet in one aggregate, and only three numbers reach the driver.
    """
    per = errors.groupBy(F.xxhash64(cluster).alias("c"), F.col(cluster).alias("k")).agg(F.count("*").alias("n"), F.sum(a).alias("a"), F.sum(b).alias("b"))

    def draw(batches):
        import pyarrow as pa

        sums = np.zeros((times, 3))
        for batch in batches:
            x = np.stack([np.nan_to_num(np.array(batch.column(i).to_numpy(zero_copy_only=False), float)) for i in (1, 2, 3)], axis=1)
            for c, row in zip(batch.column(0).to_pylist(), x, strict=True):
                sums += np.random.default_rng([seed, c & (2**63 - 1)]).poisson(1.0, times)[:, None] * row
        if sums.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(times)), *(pa.array(np.ascontiguousarray(sums[:, i])) for i in range(3))], ["draw", "n", "a", "b"])

    draws = per.select("c", F.col("n").cast("double"), F.col("a").cast("double"), F.col("b").cast("double")).mapInArrow(draw, "draw long, n double, a double, b double")
    draws = draws.groupBy("draw").agg(F.sum("n").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b")).where("n > 0").select(((F.col("a") - F.col("b")) / F.col("n")).alias("d"))
    got = draws.agg(F.percentile("d", F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.avg((F.col("d") > 0).cast("int")).alias("worse")).first()
    low, high = got["q"] or (math.nan, math.nan)
    return {"low": low, "high": high, "worse": math.nan if got["worse"] is None else got["worse"]}
