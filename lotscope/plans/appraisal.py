"""Registered queries of estimators, ranking and review."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotscope.operators import estimators, ranking, review, tracking
from lotscope.operators.store import written
from lotscope.plans.market import KM, OBS, ROWS, SPANS, rounded
from lotscope.plans.views import listings, observations, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def priced(spark, d, named=None):
    df = listings(spark, d, named).where("price is not null and model is not null")
    return df.withColumns({"ordinal": F.datediff("seen_on", F.lit("1995-01-01")), "model_key": F.concat_ws("|", "make", "model")})


PRICED = f"{ROWS}, priced as (select *, date_diff('day', date '1995-01-01', seen_on) as ordinal, make || '|' || model as model_key from listings where price is not null and model is not null)"
SPLIT = """per as (select cluster_id, min(ordinal) as lo, max(ordinal) as hi from priced group by 1), n as (select count(*) as n from per),
cut as (select lo as cutoff from (select lo, row_number() over (order by lo) as i from per), n where i = greatest(1, n - greatest(1, cast(round_even(n * 0.3, 0) as bigint)))),
sides as (select cluster_id, case when lo <= cutoff and hi > cutoff then 'straddling' when lo > cutoff then 'test' else 'train' end as side from per, cut)"""
#: Half of the items by id: a split whose sides share models but no item.
HALVES = "halved as (select *, case when cluster_id % 5 = 0 then 'test' else 'train' end as side from priced)"


def halves(spark, d, named=None):
    df = priced(spark, d, named)
    return df.withColumn("side", F.when(F.col("cluster_id") % 5 == 0, "test").otherwise("train"))


def fitted(spark, d, *more):
    """What estimators read of each half, written once: they read it again for each of their sums. With listing_id, that of held-out listings alone."""
    return written(halves(spark, d, F.col("l_partkey") % 5 == 0).select("make", "model_key", "year", "mileage_km", "price", "side", *more), "halves")


@query(f"{PRICED}, {SPLIT} select side, count(*) as n, count(distinct cluster_id) as clusters from priced join sides using (cluster_id) group by side")
def split_temporal(spark, d):
    df = estimators.temporal_split(priced(spark, d))
    return df.groupBy("side").agg(F.count("*").alias("n"), F.countDistinct("cluster_id").alias("clusters"))


@query(f"""{PRICED}, {HALVES}, s as (select count_if(side = 'train') as n_train, count_if(side = 'test') as n_test, quantile_cont(case when side = 'train' then cast(price as double) end, 0.5) as a, quantile_cont(case when side = 'test' then cast(price as double) end, 0.5) as b from halved),
v as (select price, count_if(side = 'train') as x, count_if(side = 'test') as y from halved group by price), g as (select abs(sum(x) over (order by price) / (select n_train from s) - sum(y) over (order by price) / (select n_test from s)) as gap from v), k as (select max(gap) as ks from g)
select n_train, n_test, round(ks, 6) as ks, round(b / a, 6) as ratio, case when n_train < 93 or n_test < 93 then 'insufficient' when ks > 0.2 or abs(b / a - 1) > 0.1 then 'shifted' else 'comparable' end as verdict from s, k""")
def shift_train_test(spark, d):
    return rounded(estimators.shift(halves(spark, d), "price"), "ks", "ratio")


TAU = [0.15, 0.35, 0.5, 0.85]
GLOBAL = ", ".join(f"(select quantile_cont(cast(price as double), {t}) from halved where side = 'train') as q{i + 1}" for i, t in enumerate(TAU))
METRICS = (
    "count(*) as n, round(avg((" + " + ".join(f"greatest({t} * (price - q{i + 1}), ({t} - 1) * (price - q{i + 1}))" for i, t in enumerate(TAU)) + ") / 4), 2) as pinball, "
    + ", ".join(f"round(avg(case when price <= q{i + 1} then 1.0 else 0 end), 6) as coverage{i + 1}" for i in range(4))
    + ", round(avg(case when price between q1 and q4 then 1.0 else 0 end), 6) as inside, round(avg(case when q2 < q1 or q3 < q2 or q4 < q3 then 1.0 else 0 end), 6) as crossing"
)


def global_quantiles(spark, d):
    df = halves(spark, d)
    q = df.where("side = 'train'").agg(F.percentile("price", F.array(*map(F.lit, TAU)))).first()[0]
    return df.where("side = 'test'").withColumns({f"q{i + 1}": F.lit(x) for i, x in enumerate(q)})


def measured(df, by):
    out = estimators.metrics(df, by)
    return rounded(rounded(out, "coverage1", "coverage2", "coverage3", "coverage4", "inside", "crossing"), "pinball", digits=2)


@query(f"{PRICED}, {HALVES}, t as (select *, {GLOBAL} from halved where side = 'test') select make, {METRICS} from t group by make")
def metrics_global_by_make(spark, d):
    return measured(global_quantiles(spark, d), ["make"])


@query(f"{PRICED}, {HALVES}, t as (select *, {GLOBAL} from halved where side = 'test'), b as (select *, case when mileage_km < 300000 then 'km low' when mileage_km < 800000 then 'km mid' else 'km high' end as slice from t) select slice, {METRICS} from b group by slice")
def metrics_slices_by_mileage(spark, d):
    df = global_quantiles(spark, d)
    return measured(df.withColumn("slice", F.when(F.col("mileage_km") < 300_000, "km low").when(F.col("mileage_km") < 800_000, "km mid").otherwise("km high")), ["slice"])


@query(f"""{PRICED}, {HALVES}, t as (select *, {GLOBAL} from halved where side = 'test'), m as (select make, count(*) as n, round(avg(case when price <= q4 then 1.0 else 0 end), 9) as share from t group by make)
select make, n, round(share, 6) as share, round(greatest(0, (share + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(share * (1 - share) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n)), 6) as low, round(least(1, (share + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(share * (1 - share) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n)), 6) as high from m""")
def metrics_wilson(spark, d):
    df = global_quantiles(spark, d).groupBy("make").agg(F.count("*").alias("n"), F.round(F.avg((F.col("price") <= F.col("q4")).cast("int")), 9).alias("share"))
    return rounded(estimators.wilson(df, "share", "n"), "share", "low", "high")


def _tiers() -> str:
    ok = {"strict": "abs(t.year - c.year) <= 1 and (t.mileage_km <= 0 or abs(c.mileage_km - t.mileage_km) <= 0.3 * t.mileage_km)", "relaxed_mileage": "abs(t.year - c.year) <= 1", "relaxed_year": "(t.mileage_km <= 0 or abs(c.mileage_km - t.mileage_km) <= 0.3 * t.mileage_km)", "model_only": "c.price is not null"}
    aggs = []
    for name, x in ok.items():
        aggs.append(f"count_if({x}) as n_{name}")
        aggs += [f"quantile_cont(case when {x} then cast(c.price as double) end, {t}) as {name}_{i + 1}" for i, t in enumerate(TAU)]
        aggs += [f"quantile_cont(case when {x} then cast(c.price as double) end, {t}) as {name}_{n}" for n, t in (("lo", 0.25), ("hi", 0.75), ("mid", 0.5))]
    tier = "case " + " ".join(f"when n_{n} >= 5 then '{n}'" for n in ok) + " else 'global' end"
    pick = lambda c: "case tier " + " ".join(f"when '{n}' then {n}_{c}" for n in ok) + f" else world_{c} end"
    world = ", ".join(["count(*) as world_n", *(f"quantile_cont(cast(price as double), {t}) as world_{n}" for n, t in [*((i + 1, t) for i, t in enumerate(TAU)), ("lo", 0.25), ("hi", 0.75), ("mid", 0.5)])])
    qs = ", ".join(f"round({pick(i + 1)}, 2) as q{i + 1}" for i in range(4))
    return f"""m as (select t.listing_id as listing_id, t.price as price, {', '.join(aggs)} from (select * from halved where side = 'test') t left join (select * from halved where side = 'train') c on t.model_key = c.model_key group by t.listing_id, t.price),
    w_ as (select {world} from halved where side = 'train'), x as (select *, {tier} as tier from m, w_) select listing_id, price, tier, {pick('n').replace('strict_n', 'n_strict').replace('relaxed_mileage_n', 'n_relaxed_mileage').replace('relaxed_year_n', 'n_relaxed_year').replace('model_only_n', 'n_model_only')} as n, round(({pick('hi')} - {pick('lo')}) / {pick('mid')}, 6) as dispersion, {qs} from x"""


def _comparables(df):
    out = estimators.comparables(df.where("side = 'test'"), df.where("side = 'train'"), "model_key", "listing_id")
    return rounded(rounded(out, "dispersion"), "q1", "q2", "q3", "q4", digits=2)


@query(f"{PRICED}, {HALVES}, {_tiers()}")
def estimator_comparables(spark, d):
    return _comparables(halves(spark, d))


@query(f"with q as (select * from ({PRICED}, {HALVES}, {_tiers()})), w as (select tier, coalesce(n, 0) as n, dispersion from q) select tier, case when tier in ('model_only', 'global') or n < 8 then 'low' when tier = 'strict' and n >= 25 and dispersion < 0.35 then 'high' else 'medium' end as quality, count(*) as rows from w group by all")
def estimator_tier_histogram(spark, d):
    """How many answers rest on which tier, and what that is worth."""
    df = estimators.comparables(halves(spark, d).where("side = 'test'"), halves(spark, d).where("side = 'train'"), "model_key", "listing_id")
    return df.withColumn("quality", estimators.evidence_quality(F.col("tier"), F.col("n"), F.col("dispersion"))).groupBy("tier", "quality").agg(F.count("*").alias("rows"))


_OFF = "greatest(" + ", ".join(f"case when abs(coverage{i + 1} - {t}) > 2.5 * sqrt({t} * (1 - {t}) / n) then abs(coverage{i + 1} - {t}) else 0 end" for i, t in enumerate(TAU)) + ")"
_BANDS = "case when q3 < 5e8 then 'pred<500M' when q3 < 1e9 then 'pred 500M-1B' when q3 < 2e9 then 'pred 1-2B' else 'pred>=2B' end, case when mileage_km < 5e4 then 'km<50k' when mileage_km < 1.5e5 then 'km 50-150k' when mileage_km < 2.5e5 then 'km 150-250k' else 'km>=250k' end"


@query(f"{PRICED}, {HALVES}, t as (select *, {GLOBAL} from halved where side = 'test'), b as (select *, unnest(['overall', 'model=' || model_key, {_BANDS}]) as slice from t), m as (select slice, {METRICS} from b group by slice) select *, round({_OFF}, 6) as off from m")
def metrics_benchmark(spark, d):
    """Global quantiles on held-out items: overall, and in slices by model, predicted middle and mileage."""
    out = estimators.benchmark(global_quantiles(spark, d), "model_key")
    return rounded(rounded(out, "coverage1", "coverage2", "coverage3", "coverage4", "inside", "crossing", "off"), "pinball", digits=2)


@query(f"{PRICED}, c as (select *, min(listing_id) over (partition by model_key, year, mileage_km, price) as cluster from priced), k as (select cluster, row_number() over (order by sha256('split' || cluster)) as i, count(*) over () as n from (select distinct cluster from c)) select listing_id, cluster, case when i <= greatest(1, round_even(n * 0.3, 0)) then 'test' else 'train' end as side from c join k using (cluster)")
def split_within(spark, d):
    return estimators.within_split(priced(spark, d)).select("listing_id", "cluster", "side")


_HELD = "trims as (select model_key as k, row_number() over (order by sha256('trims' || model_key)) <= greatest(1, floor((select count(distinct model_key) from priced) * 0.2)) as held_out from (select distinct model_key from priced))"


@query(f"{PRICED}, {_HELD} select k as model_key, held_out from trims")
def split_held_out_trims(spark, d):
    return estimators.held_out_groups(priced(spark, d), "model_key").select("model_key", "held_out").distinct()


def _pooled(df):
    df = estimators.held_out_groups(df, "model_key")
    model = estimators.PartialPooling().fit(df.where("side = 'train' and not held_out"))
    return model.predict(df.where("side = 'test'"))


_R = [f"quantile_cont(r, {t}) as r{i + 1}" for i, t in enumerate(TAU)]
POOLED = f"""{PRICED}, {HALVES}, {_HELD}, rows_ as (select h.*, held_out, ln(price) as y, (year - 1990)::double as fy, mileage_km / 1e5 as fk from halved h join trims on model_key = k), tr as (select * from rows_ where side = 'train' and not held_out),
lv as (select make as mk, avg(y) as ly, avg(fy) as lfy, avg(fk) as lfk from tr group by 1), inn as (select fy - lfy as a, fk - lfk as b, y - ly as c from tr join lv on make = mk), mm as (select avg(a) as ma, avg(b) as mb, avg(c) as mc from inn),
ss as (select sum((a - ma) * (a - ma)) + 1 as s11, sum((a - ma) * (b - mb)) as s12, sum((b - mb) * (b - mb)) + 1 as s22, sum((a - ma) * (c - mc)) as t1, sum((b - mb) * (c - mc)) as t2, any_value(ma) as ma, any_value(mb) as mb, any_value(mc) as mc from inn, mm),
cf as (select (s22 * t1 - s12 * t2) / (s11 * s22 - s12 * s12) as ca, (s11 * t2 - s12 * t1) / (s11 * s22 - s12 * s12) as cb, ma, mb, mc from ss), mus as (select r.*, ly + ca * (fy - lfy) + cb * (fk - lfk) + mc - ma * ca - mb * cb as mu from rows_ r join lv on make = mk, cf),
per as (select model_key as g, count(*) as n_trim, avg(y - mu) as mean, var_samp(y - mu) as v from mus where side = 'train' and not held_out group by 1), kk as (select avg(case when n_trim > 1 then v end) as s2, var_pop(mean) as vm, avg(n_trim) as nn from per), tt as (select s2, greatest(0, vm - s2 / greatest(1, floor(nn))) as tau2 from kk),
off as (select g, n_trim, mean, coalesce(tau2 / nullif(tau2 + s2 / n_trim, 0), 0) as lam from per, tt), res as (select {', '.join(_R)}, var_pop(r) as noise from (select y - mu - lam * mean as r from mus join off on model_key = g where side = 'train' and not held_out)),
pr as (select m.*, coalesce(n_trim, 0) as n_trim, coalesce(lam, 0) as shrinkage, coalesce(lam * mean, 0) as applied, list_sort([{', '.join(f'exp(mu + coalesce(lam * mean, 0) + sqrt(1 + (1 - coalesce(lam, 0)) * (1 - coalesce(lam, 0)) * (tau2 / noise)) * r{i + 1})' for i in range(4))}]) as q from mus m left join off on model_key = g, tt, res where side = 'test'),
pooled as (select *, case when n_trim < 5 then 'few' when shrinkage < 0.5 then 'borrowed' end as why from pr)"""


@query(f"{POOLED} select listing_id, n_trim, round(shrinkage, 6) as shrinkage, round(applied, 6) as applied, why, " + ", ".join(f"round(q[{i + 1}] / 1e6, 3) as q{i + 1}" for i in range(4)) + " from pooled")
def estimator_pooled(spark, d):
    """Estimates of held-out items, some of trims that were never seen, each with what it borrows."""
    df = fitted(spark, d, "listing_id")
    out = _pooled(df).select("listing_id", "n_trim", "shrinkage", F.col("offset_applied").alias("applied"), "why", *((F.col(f"q{i + 1}") / 1e6).alias(f"q{i + 1}") for i in range(4)))
    return rounded(rounded(out, "shrinkage", "applied"), "q1", "q2", "q3", "q4", digits=3)


def _predicted(df):
    return written(_pooled(df).select("model_key", "price", "held_out", "n_trim", "shrinkage", "extrapolated", "q1", "q3", "q4"), "predicted")


@query(f"""{POOLED}, s as (select *, unnest([case when held_out then 'held-out trim' when n_trim >= 5 then 'well-observed trim' when n_trim > 0 then 'thin trim' end, case when not held_out then 'trim=' || model_key end]) as slice from pooled),
a as (select slice, count(*) as n, avg(abs(q[3] - price)) as mae, quantile_cont(abs(q[3] - price), 0.5) as median_ae, avg(case when price between q[1] and q[4] then 1.0 else 0 end) as coverage, avg(shrinkage) as shrinkage, avg(case when why is not null then 1.0 else 0 end) as extrapolated from s where slice is not null group by slice)
select slice, n, round(mae / 1e6, 3) as mae, round(median_ae / 1e6, 3) as median_ae, round(coverage, 6) as coverage, round(abs(coverage - 0.7), 6) as coverage_error, round(shrinkage, 6) as shrinkage, round(extrapolated, 6) as extrapolated, round(greatest(0, abs(coverage - 0.7) - 2.5 * sqrt(0.21 / n)), 6) as off from a where not starts_with(slice, 'trim=') or n >= 58""")
def estimator_pooled_slices(spark, d):
    out = estimators.pooled_slices(_predicted(fitted(spark, d))).withColumns({"mae": F.col("mae") / 1e6, "median_ae": F.col("median_ae") / 1e6})
    return rounded(rounded(out, "coverage", "coverage_error", "shrinkage", "extrapolated", "off"), "mae", "median_ae", digits=3)


@query()
def estimator_pooled_gate(spark, d):
    """The verdict on partial pooling, with every reason and its kind."""
    df = fitted(spark, d)
    out = _predicted(df)
    base = estimators.parent_median_baseline(out, df.where("side = 'train'"), "model_key")
    mae = base.agg(F.avg(F.abs(F.col("q3") - F.col("price"))).alias("a"), F.avg(F.abs(F.col("baseline") - F.col("price"))).alias("b")).first()
    verdict, why = estimators.PooledGate().verdict(estimators.four_slices(written(estimators.pooled_slices(out), "slices")), mae["a"], mae["b"])
    return spark.createDataFrame([(verdict, *w) for w in why] or [(verdict, None, None, None)], "verdict string, kind string, subject string, reason string")


@query(f"{PRICED}, {HALVES}, p as (select model_key, quantile_cont(cast(price as double), 0.5) as m from halved where side = 'train' group by 1) select h.make as make, count(*) as n, round(avg(abs(price - coalesce(m, (select quantile_cont(cast(price as double), 0.5) from halved where side = 'train')))), 2) as mae from halved h left join p using (model_key) where side = 'test' group by h.make")
def estimator_baseline_mae(spark, d):
    df = halves(spark, d)
    out = estimators.parent_median_baseline(df.where("side = 'test'"), df.where("side = 'train'"), "model_key")
    return rounded(out.groupBy("make").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("price") - F.col("baseline"))).alias("mae")), "mae", digits=2)


@query(f"""{PRICED}, c as (select (year - 1995)::double as x1, mileage_km / 1e6 as x2, price / 1e9 as y from priced), m as (select avg(x1) as a, avg(x2) as b, avg(y) as c from c),
s as (select sum((x1 - a) * (x1 - a)) + 1 as s11, sum((x1 - a) * (x2 - b)) as s12, sum((x2 - b) * (x2 - b)) + 1 as s22, sum((x1 - a) * (y - m.c)) as t1, sum((x2 - b) * (y - m.c)) as t2, any_value(a) as a, any_value(b) as b, any_value(m.c) as c from c, m)
select round((s22 * t1 - s12 * t2) / (s11 * s22 - s12 * s12), 6) as year_effect, round((s11 * t2 - s12 * t1) / (s11 * s22 - s12 * s12), 6) as km_effect, round(c - a * (s22 * t1 - s12 * t2) / (s11 * s22 - s12 * s12) - b * (s11 * t2 - s12 * t1) / (s11 * s22 - s12 * s12), 6) as intercept from s""")
def estimator_ridge(spark, d):
    df = priced(spark, d).select((F.col("year") - 1995).cast("double").alias("x1"), (F.col("mileage_km") / 1e6).alias("x2"), (F.col("price") / 1e9).alias("y"))
    r = estimators.Ridge(["x1", "x2"], 1.0).fit(df, "y")
    return rounded(spark.createDataFrame([(float(r.coef[0]), float(r.coef[1]), r.intercept)], "year_effect double, km_effect double, intercept double"), "year_effect", "km_effect", "intercept")


_LOG = f"""{PRICED}, {HALVES}, rows_ as (select *, ln(price) as y, (year - 1990)::double as fy, mileage_km / 1e5 as fk from halved), lv as (select model_key as mk, avg(y) as ly, avg(fy) as lfy, avg(fk) as lfk from rows_ where side = 'train' group by 1),
wd as (select avg(ly) as wy, avg(lfy) as wfy, avg(lfk) as wfk from lv), inn as (select fy - lfy as a, fk - lfk as b, y - ly as c from rows_ join lv on model_key = mk where side = 'train'), mm as (select avg(a) as ma, avg(b) as mb, avg(c) as mc from inn),
ss as (select sum((a - ma) * (a - ma)) + 1 as s11, sum((a - ma) * (b - mb)) as s12, sum((b - mb) * (b - mb)) + 1 as s22, sum((a - ma) * (c - mc)) as t1, sum((b - mb) * (c - mc)) as t2, any_value(ma) as ma, any_value(mb) as mb, any_value(mc) as mc from inn, mm),
cf as (select (s22 * t1 - s12 * t2) / (s11 * s22 - s12 * s12) as ca, (s11 * t2 - s12 * t1) / (s11 * s22 - s12 * s12) as cb, ma, mb, mc from ss), rq as (select {', '.join(f'quantile_cont(c - ca * a - cb * b - (mc - ma * ca - mb * cb), {t}) as r{i + 1}' for i, t in enumerate(TAU))} from inn, cf),
mu as (select r.*, coalesce(ly, wy) + ca * (fy - coalesce(lfy, wfy)) + cb * (fk - coalesce(lfk, wfk)) + mc - ma * ca - mb * cb as mu from rows_ r left join lv on model_key = mk, cf, wd where side = 'test'), t as (select mu.*, {', '.join(f'exp(mu.mu + r{i + 1}) as q{i + 1}' for i in range(4))} from mu, rq)"""


@query(f"{_LOG} select make, {METRICS} from t group by make")
def estimator_log_linear(spark, d):
    """Coverage of the log-linear model on held-out items."""
    df = fitted(spark, d)
    model = estimators.LogLinear("model_key").fit(df.where("side = 'train'"))
    return measured(model.predict(df.where("side = 'test'")), ["make"])


@query(f"""{PRICED}, r as (select make, trim, price / 1e9 - avg(price / 1e9) over (partition by make) as resid from priced), g as (select make || ':' || trim as g, resid from r), p as (select g, count(*) as n, avg(resid) as mean, var_samp(resid) as v from g group by g),
k as (select avg(case when n > 1 then v end) as s2, var_pop(mean) as vm, avg(n) as nn from p), t as (select s2, greatest(0, vm - s2 / greatest(1, floor(nn))) as t2 from k)
select g as "group", n, round(mean, 6) as mean, round(coalesce(t2 / (t2 + s2 / n), 0), 6) as lam, round(coalesce(t2 / (t2 + s2 / n), 0) * mean, 6) as "offset" from p, t""")
def estimator_partial_pooling(spark, d):
    df = priced(spark, d)
    middle = df.groupBy("make").agg(F.avg(F.col("price") / 1e9).alias("m"))
    rows = df.join(middle, "make").select(F.concat_ws(":", "make", "trim").alias("group"), (F.col("price") / 1e9 - F.col("m")).alias("resid"))
    return rounded(estimators.pooled_offsets(rows, "group", "resid"), "mean", "lam", "offset")


@query()
def estimator_gate(spark, d):
    """The verdict on global quantiles, with every reason; a refused estimator gives reasons and no prices."""
    df = global_quantiles(spark, d)
    overall = estimators.metrics(df.withColumn("slice", F.lit("all")), ["slice"]).first().asDict()
    slices = [r.asDict() for r in estimators.metrics(df.withColumn("slice", F.col("make")), ["slice"]).collect()]
    base = estimators.parent_median_baseline(df, halves(spark, d).where("side = 'train'"), "model_key")
    base = base.withColumns({f"q{i + 1}": F.col("baseline") for i in range(4)}).withColumn("slice", F.lit("all"))
    verdict, why = estimators.Gate().verdict(overall, slices, estimators.metrics(base, ["slice"]).first()["pinball"])
    return spark.createDataFrame([(verdict, w) for w in why] or [(verdict, None)], "verdict string, reason string")


@query()
def estimator_bootstrap(spark, d):
    """Interval of the difference in error between the parents' medians and the overall one, clusters drawn anew."""
    df = halves(spark, d)
    out = estimators.parent_median_baseline(df.where("side = 'test'"), df.where("side = 'train'"), "model_key")
    overall = df.where("side = 'train'").agg(F.percentile("price", F.lit(0.5))).first()[0]
    err = out.select("trim", F.abs(F.col("price") - F.col("baseline")).alias("a"), F.abs(F.col("price") - F.lit(overall)).alias("b"))
    got = estimators.cluster_bootstrap(err, "trim", "a", "b", 2000)
    return spark.createDataFrame([(got["low"], got["high"], got["worse"])], "low double, high double, worse double")


# ranking

ASK = ranking.Intent(budget_max=3_000_000_000, year_min=1997, max_km=480_000, breakers=("accident",))
JUDGED = "judged as (select *, [case when price is null then 'unknown' when price <= 3000000000 then 'met' else 'broken' end, case when year is null then 'unknown' when year >= 1997 then 'met' else 'broken' end, case when mileage_km is null then 'unknown' when mileage_km <= 480000 then 'met' else 'broken' end, case when condition is null or condition = 'unknown' then 'unknown' when condition = 'accident' then 'broken' else 'met' end] as states from listings where product_class = 'vehicle')"


@query(f"{ROWS}, {JUDGED} select listing_id, array_to_string(list_filter([case when states[4] = 'unknown' then 'accident' end, case when states[1] = 'unknown' then 'budget' end, case when states[3] = 'unknown' then 'mileage' end, case when states[2] = 'unknown' then 'year' end], lambda x: x is not null), ',') as unknown, case when list_contains(states, 'unknown') then 'apart' else 'matched' end as shelf from judged where not list_contains(states, 'broken')")
def ranking_constraints(spark, d):
    return ranking.evidence(listings(spark, d), ASK).select("listing_id", F.array_join("unknown", ",").alias("unknown"), "shelf")


NARROW = ranking.Intent(budget_max=130_000_000, year_min=2000, max_km=24_000, breakers=("accident",), soft=True)
_RUNGS = [(130_000_000, 24_000, 2000), (143_000_000, 24_000, 2000), (143_000_000, 31_200, 2000), (143_000_000, 31_200, 1999), (157_300_000, 31_200, 1999)]


@query(f"{ROWS}, r as (select listing_id, case " + " ".join(f"when price <= {b} and mileage_km <= {k} and year >= {y} and condition <> 'accident' then {i}" for i, (b, k, y) in enumerate(_RUNGS)) + " end as rung from listings), c as (select i, (select count(*) from r where rung <= i) as n from range(5) t(i)) select listing_id, rung from r where rung <= (select coalesce(min(i) filter (where n >= 3), 4) from c)")
def ranking_ladder(spark, d):
    return ranking.retrieve(listings(spark, d), NARROW)[0].select("listing_id", "rung")


def candidates(spark, d):
    df = listings(spark, d).where("price is not null and model is not null")
    from lotscope.operators.quality import condition_risk

    middle = df.groupBy("make").agg(F.percentile("price", F.lit(0.35)).alias("conservative"))
    df = df.join(middle, "make").withColumns({"risk": condition_risk(F.col("condition")), "owning": (F.col("seller") % 7) / 10, "liquidity": (F.col("seller") % 5) / 10, "recency": F.datediff("seen_on", F.lit("2000-01-01")), "query": F.col("make")})
    return df


RISK = "case condition when 'intact' then 0.05 when 'minor_paint' then 0.2 when 'multi_paint' then 0.5 when 'replaced_part' then 0.65 when 'accident' then 0.85 else 0.35 end::double"
_T = [("opportunity", 0.35), ("risk", -0.25), ("owning", -0.15), ("liquidity", 0.1), ("mileage_km", -0.1), ("recency", 0.05)]
SCORED = f"""cand as (select *, {RISK} as risk, (seller % 7) / 10 as owning, (seller % 5) / 10 as liquidity, date_diff('day', date '2000-01-01', seen_on) as recency, make as query, quantile_cont(cast(price as double), 0.35) over (partition by make) as conservative from listings where price is not null and model is not null),
o as (select *, risk * conservative * 0.6 as damage, conservative - price - risk * conservative * 0.6 as opportunity from cand),
e as (select query as q, {', '.join(f'min({c}) as lo_{c}, max({c}) as hi_{c}' for c, _ in _T)} from o group by query),
scored as (select o.*, {' + '.join(f'({w}) * case when hi_{c} - lo_{c} < 1e-9 then 0.5 else ({c} - lo_{c}) / (hi_{c} - lo_{c}) end' for c, w in _T)} as score from o join e on query = q)"""

@query(f"{ROWS}, {SCORED} select listing_id, round(damage, 2) as damage, round(opportunity, 2) as opportunity, round(score, 6) as score from scored")
def ranking_score(spark, d):
    out = ranking.score(candidates(spark, d), ranking.Intent()).select("listing_id", "damage", "opportunity", "score")
    return rounded(rounded(out, "damage", "opportunity", digits=2), "score")


@query(f"""{ROWS}, {SCORED}, r as (select *, quantile_cont(cast(price as double), 0.25) over (partition by query) as p25, row_number() over (partition by query order by round(score, 9) desc, listing_id) as place from scored),
a as (select *, place = 1 as p1 from r), b as (select *, min(case when not p1 and risk <= 0.15 then place end) over (partition by query) as safe from a),
c as (select *, min(case when not p1 and place is distinct from safe and opportunity > 0 then place end) over (partition by query) as bargain from b),
e2 as (select *, min(case when not p1 and place is distinct from safe and place is distinct from bargain and price <= p25 then place end) over (partition by query) as cheap from c),
f as (select *, case when p1 then 0 when place = safe then 1 when place = bargain then 2 when place = cheap then 3 else 4 end as role from e2), g as (select *, row_number() over (partition by query order by role, place) as pick from f)
select query, pick, listing_id, round(score, 6) as score, (['best overall', 'safest', 'best value', 'cheapest acceptable', 'alternative'])[role + 1] as role from g where pick <= 5""")
def ranking_diversify(spark, d):
    scored = ranking.score(candidates(spark, d), ranking.Intent()).withColumn("score", F.round("score", 9))
    return rounded(ranking.diversify(scored), "score")


@query(f"{ROWS} select listing_id, array_to_string(list_filter([case when model is null then 'model' end, case when price is null then 'price' end], lambda x: x is not null), ',') as missing, condition = 'unknown' as imputed, round((4 - case when model is null then 1 else 0 end - case when price is null then 1 else 0 end - case when condition = 'unknown' then 1 else 0 end) / 4, 6) as completeness from listings")
def ranking_ledger(spark, d):
    out = ranking.ledger(listings(spark, d), ["make", "model", "price", "mileage_km"], F.col("condition") == "unknown")
    return rounded(out.select("listing_id", "missing", "imputed", "completeness"), "completeness")


@query(f"""{ROWS}, {SCORED}, u as (select *, row_number() over (partition by query order by round(score, 9) desc, listing_id) as a, row_number() over (partition by query order by price, listing_id) as b, row_number() over (partition by query order by sha256(listing_id), listing_id) as c from scored),
m as (select query, avg(case when a <= 3 then opportunity end) as ranked, avg(case when b <= 3 then opportunity end) as cheapest, avg(case when c <= 3 then opportunity end) as random from u group by query) select query, round(ranked, 2) as ranked, round(cheapest, 2) as cheapest, round(random, 2) as random, ranked >= cheapest as wins from m""")
def ranking_win_rate(spark, d):
    scored = ranking.score(candidates(spark, d), ranking.Intent()).withColumn("score", F.round("score", 9))
    return rounded(ranking.win_rate(scored, "opportunity"), "ranked", "cheapest", "random", digits=2)


# review


def profiles(spark, d):
    days = tracking.day_accounts(tracking.daily(observations(spark, d)))
    known = 1 - F.col("unknown_days") / (F.col("span") + 1)
    tier = F.element_at(F.array(*map(F.lit, review.TIER_CEILING)), (F.col("item") % 5 + 1).cast("int"))
    return days.select("item", review.band(F.col("present_days"), review.EVIDENCE_DAYS).alias("evidence"), F.when(F.col("span") > 0, review.band(known, review.KNOWN_RATIO)).otherwise(0.0).alias("temporal"), review.comparable_strength(tier, F.col("item") % 40, (F.col("item") % 10) / 10).alias("comparable"), F.lit(0.8).alias("calibration"), ((F.col("item") % 4) / 3).alias("data_quality"), ((F.col("item") % 3) / 4).alias("anomaly"), F.col("absent_days"), F.col("present_days"))


_ACCOUNTS = SPANS.split(", seen as")[0] + ", acc as (select item, date_diff('day', min(day), max(day)) as span, count_if(status = 'present') as present_days, count_if(status = 'absent') as absent_days, greatest(date_diff('day', min(day), max(day)) + 1 - count_if(status = 'present') - count_if(status = 'absent'), 0) as unknown_days from days group by item)"
PROFILE = f"""{OBS}, {_ACCOUNTS}, p as (select item, absent_days, present_days, case when present_days >= 5 then 1.0 when present_days >= 3 then 0.65 when present_days >= 1 then 0.35 else 0.0 end::double as evidence,
case when span <= 0 then 0.0 when 1 - unknown_days / (span + 1) >= 0.9 then 1.0 when 1 - unknown_days / (span + 1) >= 0.7 then 0.6 when 1 - unknown_days / (span + 1) >= 0.5 then 0.3 else 0.1 end::double as temporal,
([1.0, 0.7, 0.45, 0.2, 0.0])[item % 5 + 1]::double * case when item % 40 > 0 then 0.35 + 0.65 * least(1.0, (item % 40) / 30) else 0 end * case when (item % 10) / 10 > 0.4 then 0.75 else 1 end as comparable, 0.8::double as calibration, (item % 4) / 3 as data_quality, (item % 3) / 4 as anomaly from acc),
c as (select *, 0.25 * comparable + 0.2 * evidence + 0.2 * calibration + 0.2 * data_quality + 0.15 * temporal - 0.3 * anomaly as confidence, least(evidence, comparable, temporal, calibration, data_quality) as low from p),
s as (select *, case when least(evidence, comparable, data_quality) < 0.2 then 'INSUFFICIENT_EVIDENCE' when confidence >= 0.68 then 'HIGH' when confidence >= 0.42 then 'MEDIUM' else 'LOW' end as status, case when evidence = low then 'evidence' when comparable = low then 'comparable' when temporal = low then 'temporal' when calibration = low then 'calibration' else 'data_quality' end as weakest from c)"""


@query(f"{PROFILE} select item, round(confidence, 6) as confidence, status, weakest from s")
def review_confidence(spark, d):
    return rounded(review.confidence(profiles(spark, d)).select("item", "confidence", "status", "weakest"), "confidence")


def cases(spark, d):
    """Held-out listings with what a review looks at; what was seen of each is made from its item's number."""
    df = halves(spark, d)
    c = F.col("cluster_id")
    train = df.where("side = 'train'")
    return review.market_range(df.where("side = 'test'"), train, "model_key").withColumns({
        "tier": F.element_at(F.array(*map(F.lit, review.TIER_CEILING)), (c % 11 % 5 + 1).cast("int")), "n": c % 43, "dispersion": (c % 10) / 10, "unknown_days": c % 4, "reposts": c % 3, "served": c % 13 != 0,
        "present_days": c % 8, "span": c % 30, "weak_link": c % 6 == 2, "tracked": c % 9 != 1, "q1": F.col("price") * 0.9, "q4": F.col("price") * (1.2 + (c % 5) / 10),
    })


_FOUND = {
    "risk": [("weak_comparable_tier", "'high'", "downgrade", False, "tier in ('model_only', 'global')"), ("relaxed_year", "'medium'", "downgrade", False, "tier = 'relaxed_year'"), ("sparse_comparables", "'high'", "downgrade", False, "n < 8"), ("high_dispersion", "'medium'", "downgrade", False, "dispersion > 0.55"), ("observation_gap", "case when unknown_days > 2 then 'medium' else 'low' end", "downgrade", False, "unknown_days > 0"), ("reposted", "'low'", "approve", False, "reposts > 0"), ("estimator_not_accepted", "'high'", "reject", True, "not served")],
    "adversarial": [("estimate_dominated_by_few", "'high'", "downgrade", False, "served and n between 1 and 11"), ("outside_observed_distribution", "'high'", "reject", True, "served and n_market >= 10 and (price < p01 or price > p99)"), ("interval_too_wide", "'medium'", "downgrade", False, "served and (q4 - q1) / q1 > 0.6"), ("repost_link_uncertain", "'medium'", "downgrade", False, "served and tracked and reposts > 0 and weak_link"), ("never_confirmed_present", "'high'", "reject", True, "served and tracked and present_days = 0")],
}
_STRUCTS = {k: "list_filter([" + ", ".join(f"case when {ok} then {{'code': '{code}', 'severity': {sev}, 'action': '{act}', 'hard': {str(hard).lower()}}} end" for code, sev, act, hard, ok in v) + "], lambda x: x is not null)" for k, v in _FOUND.items()}
CASES = f"""{PRICED}, {HALVES}, mk as (select model_key, count(*) as n_market, quantile_cont(cast(price as double), 0.01) as p01, quantile_cont(cast(price as double), 0.99) as p99 from halved where side = 'train' group by 1),
cases as (select h.listing_id as listing_id, price, coalesce(n_market, 0) as n_market, p01, p99, (['strict', 'relaxed_mileage', 'relaxed_year', 'model_only', 'global'])[cluster_id % 11 % 5 + 1] as tier, cluster_id % 43 as n, (cluster_id % 10) / 10 as dispersion, cluster_id % 4 as unknown_days, cluster_id % 3 as reposts, cluster_id % 13 <> 0 as served,
cluster_id % 8 as present_days, cluster_id % 30 as span, cluster_id % 6 = 2 as weak_link, cluster_id % 9 <> 1 as tracked, price * 0.9 as q1, price * (1.2 + (cluster_id % 5) / 10) as q4 from halved h left join mk on h.model_key = mk.model_key where side = 'test'),
found as (select *, {_STRUCTS['risk']} as risk, {_STRUCTS['adversarial']} as adversarial from cases)"""


@query(f"{CASES} select listing_id, array_to_string(list_transform(risk, lambda x: x.code || '/' || x.severity), ',') as found from found")
def review_risk(spark, d):
    return cases(spark, d).withColumn("f", review.findings(review.risk_rules())).select("listing_id", F.array_join(F.transform("f", lambda x: F.concat_ws("/", x["code"], x["severity"])), ",").alias("found"))


@query(f"{CASES} select listing_id, array_to_string(list_transform(adversarial, lambda x: x.code || '/' || x.severity), ',') as found from found")
def review_adversarial(spark, d):
    return cases(spark, d).withColumn("f", review.findings(review.challenges())).select("listing_id", F.array_join(F.transform("f", lambda x: F.concat_ws("/", x["code"], x["severity"])), ",").alias("found"))


_SEVERITY = "list_transform(list_concat(risk, adversarial), lambda x: case x.severity when 'high' then 0.5 when 'medium' then 0.25 else 0.1 end::double)"


@query(f"""{CASES}, p as (select *, list_concat(risk, adversarial) as f, case when present_days >= 5 then 1.0 when present_days >= 3 then 0.65 when present_days >= 1 then 0.35 else 0.0 end::double as evidence,
case when span <= 0 then 0.0 when 1 - unknown_days / (span + 1) >= 0.9 then 1.0 when 1 - unknown_days / (span + 1) >= 0.7 then 0.6 when 1 - unknown_days / (span + 1) >= 0.5 then 0.3 else 0.1 end::double as temporal,
case tier when 'strict' then 1.0 when 'relaxed_mileage' then 0.7 when 'relaxed_year' then 0.45 when 'model_only' then 0.2 else 0.0 end::double * case when n > 0 then 0.35 + 0.65 * least(1.0, n / 30) else 0 end * case when dispersion > 0.4 then 0.75 else 1 end as comparable, least(1.0, coalesce(list_sum({_SEVERITY}), 0)) as anomaly, case when served then 1.0 else 0.4 end::double as dq, case when served then 1.0 else 0.0 end::double as cal from found),
c as (select *, 0.25 * comparable + 0.2 * evidence + 0.2 * cal + 0.2 * dq + 0.15 * temporal - 0.3 * anomaly as confidence from p), s as (select *, case when least(evidence, comparable, dq) < 0.2 then 4 when confidence >= 0.68 then 1 when confidence >= 0.42 then 2 else 3 end as was,
list_transform(list_filter(f, lambda x: x.hard), lambda x: x.code) as hard, list_transform(list_filter(f, lambda x: x.action = 'downgrade' and x.severity = 'high'), lambda x: x.code) as high, list_transform(list_filter(f, lambda x: x.action = 'downgrade' and x.severity = 'medium'), lambda x: x.code)[1:1] as medium from c),
t as (select *, least(4, was + len(high)) as low from s), u as (select *, case when len(hard) > 0 or not served then 4 when low <> was then low else least(4, was + len(medium)) end as now from t)
select listing_id, round(confidence, 6) as confidence, (['HIGH', 'MEDIUM', 'LOW', 'INSUFFICIENT_EVIDENCE'])[was] as status_before, (['HIGH', 'MEDIUM', 'LOW', 'INSUFFICIENT_EVIDENCE'])[now] as status, case when len(hard) > 0 then 'reject' when not served or now = 4 then 'insufficient_evidence' when now = was then 'approve' else 'downgrade' end as decision,
array_to_string(case when len(hard) > 0 then hard when low <> was then high else list_concat(high, medium) end, ',') as reasons from u""")
def review_verdict(spark, d):
    return rounded(review.reviewed(cases(spark, d)).select("listing_id", "confidence", "status_before", "status", "decision", F.array_join("reasons", ",").alias("reasons")), "confidence")


@query(f"{CASES} select listing_id, case tier when 'strict' then n || ' آگهی مشابه (مدل، سال و کارکرد نزدیک)' when 'relaxed_mileage' then n || ' آگهی با همین مدل و سال (کارکرد متفاوت)' when 'relaxed_year' then n || ' آگهی با همین مدل (سال متفاوت)' when 'model_only' then n || ' آگهی از همین مدل — مشابه نیستند' else 'داده‌ی کافی برای این مدل نداریم' end as comparables, case when tracked then span || ' روز است که در بازار است' else 'از شروع رصد ما حداقل ' || span || ' روز در بازار بوده' end as age from cases")
def review_claims(spark, d):
    df = cases(spark, d)
    return df.select("listing_id", review.claim_of_comparables(F.col("tier"), F.col("n")).alias("comparables"), review.claim_of_age(F.col("span"), F.col("tracked")).alias("age"))


@query("""with c as (select o_orderkey as claim_id, case when o_orderkey % 7 = 0 then [] else [o_orderkey, o_orderkey + 1] end as ids from orders), x as (select claim_id, unnest(ids) as missing from c union all select claim_id, null from c where len(ids) = 0)
select claim_id, missing from x where missing is null or missing not in (select l_orderkey from lineitem)""")
def review_unsupported_claims(spark, d):
    orders = table(spark, d, "orders")
    ids = F.when(F.col("o_orderkey") % 7 == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.col("o_orderkey"), F.col("o_orderkey") + 1))
    claims = orders.select(F.col("o_orderkey").alias("claim_id"), ids.alias("evidence_ids"))
    return review.unsupported(claims, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("evidence_id")))


@query(f"{OBS}, {KM} select min(case when s <= 0.5 then t end) as median from (select t, case when min(at_risk - ends) over (order by t) = 0 then 0 else exp(sum(case when at_risk > ends then ln((at_risk - ends) / at_risk) end) over (order by t)) end as s from r)")
def survival_median(spark, d):
    spans = tracking.durations(tracking.daily(observations(spark, d)))
    return tracking.median_survival(tracking.kaplan_meier(spans)).withColumn("median", F.col("median").cast("long"))
