"""Finding and ranking offers for a buyer: filters that say what they don't know, relaxation in reported steps, and risk in money."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Policy (fixed values).
PROFILE_QUANTILE = {"risk_averse": 0.15, "balanced": 0.35, "risk_tolerant": 0.50}
DAMAGE_COST = 0.60
ENOUGH = 3


@dataclass(frozen=True)
class Weights:
    value: float = 0.35
    risk: float = 0.25
    running_cost: float = 0.15
    liquidity: float = 0.10
    mileage: float = 0.10
    recency: float = 0.05

    def normalized(self) -> Weights:
        """Summing to one; the defaults where nothing is left."""
        total = sum(vars(self).values())
        return Weights(**{k: v / total for k, v in vars(self).items()}) if total > 0 else Weights()


@dataclass(frozen=True)
class Intent:
    budget_max: int = 0
    budget_min: int = 0
    year_min: int = 0
    max_km: int = 0
    models: tuple[str, ...] = ()
    provinces: tuple[str, ...] = ()
    breakers: tuple[str, ...] = ()
    soft: bool = False
    profile: str = "balanced"
    weights: Weights = field(default_factory=Weights)


def red_line(name: str, columns: set[str]) -> Column:
    """met, broken or unknown: what a listing says to a red line, from the columns it has (condition, document_issue, gearbox). A line without a rule is a condition that must not be; nothing to read it from is unknown."""
    c = lambda n: F.col(n) if n in columns else F.lit(None).cast("string")
    if name == "unclear_documents":
        return F.when(c("document_issue").isNull(), "unknown").when(c("document_issue").cast("boolean"), "broken").otherwise("met")
    if name == "manual":
        return F.when(c("gearbox") == "manual", "broken").when(c("gearbox") == "automatic", "met").otherwise("unknown")
    if name == "repaint":
        return F.when(c("condition") == "intact", "met").when(c("condition").isin("minor_paint", "multi_paint", "replaced_part", "accident"), "broken").otherwise("unknown")
    return F.when(c("condition").isNull() | (c("condition") == "unknown"), "unknown").when(c("condition") == name, "broken").otherwise("met")


def judge(x: Intent, columns: set[str]) -> Column:
    """map<string,string>: for each constraint that is set whether an offer meets it, breaks it, or it isn't known.

    A mileage whose status says that it can't be believed decides nothing, nor does a price of no usable status or kind, where the offers have these columns.
    """
    state = lambda value, ok: F.when(value.isNull(), "unknown").when(ok, "met").otherwise("broken")
    price, year, km = F.col("price"), F.col("year"), F.col("mileage_km")
    if "mileage_status" in columns:
        km = F.when(F.col("mileage_status").isin("ok", "plausible"), km)
    if {"price_status", "price_kind"} <= columns:
        from lotscope.operators.quality import priced

        price = priced(price, F.col("price_status"), F.col("price_kind"))
    parts = []
    if x.budget_max:
        parts += [F.lit("budget"), state(price, price <= x.budget_max)]
    if x.budget_min:
        parts += [F.lit("floor"), state(price, price >= x.budget_min)]
    if x.year_min:
        parts += [F.lit("year"), state(year, year >= x.year_min)]
    if x.max_km:
        parts += [F.lit("mileage"), state(km, km <= x.max_km)]
    if x.provinces:
        place = F.col("province") if "province" in columns else F.lit(None).cast("string")
        parts += [F.lit("province"), state(F.nullif(place, F.lit("")), place.isin(list(x.provinces)))]
    for b in x.breakers:
        parts += [F.lit(b), red_line(b, columns)]
    return F.create_map(*parts) if parts else F.create_map().cast("map<string,string>")


def evidence(df: DataFrame, x: Intent) -> DataFrame:
    """Vehicles that break nothing (and are of the models asked for): matched (everything known and met) or apart, with what isn't known."""
    if "product_class" in df.columns:
        df = df.where("product_class = 'vehicle'")
    if x.models:
        df = df.where(F.lower("model").isin([m.lower() for m in x.models]))
    judged = df.withColumn("judged", judge(x, set(df.columns)))
    values = F.map_values("judged")
    unknown = F.array_sort(F.map_keys(F.map_filter("judged", lambda _, v: v == "unknown")))
    kept = judged.where(~F.exists(values, lambda v: v == "broken"))
    return kept.withColumn("unknown", unknown).withColumn("shelf", F.when(F.size("unknown") == 0, "matched").otherwise("apart")).drop("judged")


def rungs(x: Intent) -> list[tuple[str, Intent]]:
    """The intent as asked and ever more relaxed: cumulative steps, none touches a deal-breaker."""
    from dataclasses import replace

    out = [("as asked", x)]
    if x.budget_max:
        out.append(("budget +10%", x := replace(x, budget_max=int(x.budget_max * 1.10))))
    if x.max_km:
        out.append(("mileage +30%", x := replace(x, max_km=int(x.max_km * 1.30))))
    if x.year_min:
        out.append(("year -1", x := replace(x, year_min=x.year_min - 1)))
    if x.budget_max and x.soft:
        out.append(("budget +10% again", replace(x, budget_max=int(x.budget_max * 1.10))))
    return out


def passes(x: Intent) -> Column:
    """A bound of zero is not set; a value that isn't known passes no bound; a known deal-breaker never passes."""
    ok = F.lit(True)
    if x.budget_max:
        ok &= F.col("price") <= x.budget_max
    if x.budget_min:
        ok &= F.col("price") >= x.budget_min
    if x.year_min:
        ok &= F.col("year") >= x.year_min
    if x.max_km:
        ok &= F.col("mileage_km") <= x.max_km
    if x.models:
        ok &= F.lower("model").isin([m.lower() for m in x.models])
    if x.breakers:
        ok &= ~F.coalesce(F.col("condition").isin(list(x.breakers)), F.lit(False))
    return F.coalesce(ok, F.lit(False))


def retrieve(df: DataFrame, x: Intent, enough: int = ENOUGH) -> tuple[DataFrame, list[str]]:
    """Offers on the first rung with `enough` of them, or on the last; and the steps taken. Every row's lowest rung is found in one pass; only a count for each rung reaches the driver."""
    steps = rungs(x)
    rung = F.coalesce(*(F.when(passes(s), i) for i, (_, s) in enumerate(steps)))
    marked = df.withColumn("rung", rung).where("rung is not null")
    counts = dict(marked.groupBy("rung").count().collect())
    total, last = 0, len(steps) - 1
    for i in range(len(steps)):
        total += counts.get(i, 0)
        if total >= enough:
            last = i
            break
    return marked.where(F.col("rung") <= last), [name for name, _ in steps[1 : last + 1]]


def score(df: DataFrame, x: Intent, query: str = "query") -> DataFrame:
    """Adds damage, opportunity and score; conservative (the estimate at the profile's quantile), risk, owning, liquidity, mileage_km, recency and price must be there.

    Risk costs money, taken off before anything is scaled; terms are scaled between the least and the greatest of a query's candidates,
    a constant one to a half. The ends are aggregated and joined back: no window over all candidates.
    """
    damage = F.col("risk") * F.col("conservative") * DAMAGE_COST
    df = df.withColumn("damage", damage).withColumn("opportunity", F.col("conservative") - F.col("price") - F.col("damage"))
    w = x.weights.normalized()
    terms = [("opportunity", w.value), ("risk", -w.risk), ("owning", -w.running_cost), ("liquidity", w.liquidity), ("mileage_km", -w.mileage), ("recency", w.recency)]
    ends = df.groupBy(query).agg(*(f(c).alias(f"{n}_{c}") for c, _ in terms for n, f in (("lo", F.min), ("hi", F.max))))
    both = df.join(ends.withColumnRenamed(query, "_q"), F.col(query).eqNullSafe(F.col("_q")))
    norm = lambda c: F.when(F.col(f"hi_{c}") - F.col(f"lo_{c}") < 1e-9, 0.5).otherwise((F.col(c) - F.col(f"lo_{c}")) / F.nullif(F.col(f"hi_{c}") - F.col(f"lo_{c}"), F.lit(0)))
    both = both.withColumns({f"n_{c}": norm(c) for c, _ in terms})
    total = sum((F.col(f"n_{c}") * v for c, v in terms), F.lit(0.0))
    return both.withColumn("score", total).drop("_q", *(f"{n}_{c}" for c, _ in terms for n in ("lo", "hi")))


def diversify(scored: DataFrame, k: int = 5, query: str = "query", id_col: str = "listing_id") -> DataFrame:
    """Of each query the best offer, the best of low risk, the best bargain, the best cheap one (each not yet picked), then the next best, up to k; with the role.

    Each role's pick is among its first few by score, so only those are kept before roles are given: first of each of a query's parts, then
    of the query, so that no task ranks all candidates of a query.
    """
    cheap = scored.groupBy(query).agg(F.percentile("price", F.lit(0.25)).alias("p25"))
    both = scored.join(cheap, query)
    order = [F.desc("score"), F.asc(id_col)]
    tests = {"safe": F.col("risk") <= 0.15, "bargain": F.col("opportunity") > 0, "cheap": F.col("price") <= F.col("p25")}
    both = both.withColumn("_part", F.pmod(F.xxhash64(id_col), F.lit(32))).withColumns({f"is_{name}": ok for name, ok in tests.items()})

    def first(df: DataFrame, by: list[str]) -> DataFrame:
        df = df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
        for name in tests:
            df = df.withColumn(f"n_{name}", F.row_number().over(Window.partitionBy(*by, f"is_{name}").orderBy(*order)))
        return df.where(" or ".join([f"place <= {k + 4}", *(f"(is_{n} and n_{n} <= 4)" for n in tests)]))

    few = first(first(both, [query, "_part"]), [query])
    role = F.when(F.col("place") == 1, F.lit(0))
    few = few.withColumn("role", role)
    for i, name in enumerate(tests, 1):
        free = F.col("role").isNull() & F.col(f"is_{name}")
        first = F.min(F.when(free, F.col("place"))).over(Window.partitionBy(query))
        few = few.withColumn("role", F.when(free & (F.col("place") == first), i).otherwise(F.col("role")))
    few = few.withColumn("role", F.coalesce("role", F.lit(len(tests) + 1)))
    pick = F.row_number().over(Window.partitionBy(query).orderBy("role", "place"))
    names = F.array(*map(F.lit, ("best overall", "safest", "best value", "cheapest acceptable", "alternative")))
    return few.withColumn("pick", pick).where(F.col("pick") <= k).select(query, "pick", id_col, "score", F.element_at(names, F.col("role") + 1).alias("role"))


def ledger(df: DataFrame, fields: list[str], imputed: Column) -> DataFrame:
    """Which inputs of a score are present, imputed or missing, and how complete they are."""
    missing = F.filter(F.array(*(F.when(F.col(f).isNull(), f) for f in fields)), lambda x: x.isNotNull())
    out = df.withColumn("missing", F.array_join(missing, ",")).withColumn("imputed", imputed)
    return out.withColumn("completeness", (len(fields) - F.size(missing) - F.when(F.col("imputed"), 1).otherwise(0)) / len(fields))


def features(df: DataFrame) -> DataFrame:
    """Adds what a listing supplies to a score, from condition and document_issue: risk (filled in and named in `imputed` where the condition is unknown), has_accident, has_unclear_documents. What nothing supports stays null."""
    from lotscope.operators.quality import condition_risk

    known = F.col("condition").isNotNull()
    return df.withColumns({
        "risk": F.when(known, condition_risk(F.col("condition"))), "has_accident": F.when(known, F.when(F.col("condition") == "accident", 1.0).otherwise(0.0)), "has_unclear_documents": F.when(F.col("document_issue"), 1.0),
        "imputed": F.when(F.col("condition") == "unknown", F.array(F.lit("risk"))).otherwise(F.array().cast("array<string>")),
    })


def decision_ledger(df: DataFrame, x: Intent) -> DataFrame:
    """Adds, for each candidate, which of the eight inputs of a decision are there: hard_filter_pass, price_delta_to_estimate, missing, imputed_labels and completeness.

    From features, ownership_risk, liquidity, first_seen_ordinal and middle, the estimate's median; null where no accepted estimator serves one.
    """
    delta = F.col("middle") - F.col("price")
    lacks = [
        ("price_delta_to_estimate", delta.isNull()), ("risk_score", F.col("risk").isNull()), ("running_cost_signals", F.col("ownership_risk").isNull()), ("reliability_signals", F.col("liquidity").isNull()), ("recency", F.coalesce(F.col("first_seen_ordinal"), F.lit(0)) == 0),
    ]
    missing = F.filter(F.array(*(F.when(no, label) for label, no in lacks)), lambda v: v.isNotNull())
    labels = F.when(F.array_contains("imputed", "risk"), F.array(F.lit("risk_score"))).otherwise(F.array().cast("array<string>"))
    out = df.withColumns({"hard_filter_pass": passes(x), "price_delta_to_estimate": delta, "missing": missing, "imputed_labels": labels})
    return out.withColumn("completeness", (8 - F.size("missing") - F.size("imputed_labels")) / 8)


def reweighted(terms: DataFrame, weights: Weights, id_col: str = "listing_id") -> DataFrame:
    """(id, score): scores of candidates whose scaled terms are kept (n_opportunity, n_risk, n_owning, n_liquidity, n_mileage_km, n_recency), under other weights, without ranking anew."""
    w = weights.normalized()
    signed = {"n_opportunity": w.value, "n_risk": -w.risk, "n_owning": -w.running_cost, "n_liquidity": w.liquidity, "n_mileage_km": -w.mileage, "n_recency": w.recency}
    return terms.select(id_col, sum((F.col(c) * v for c, v in signed.items()), F.lit(0.0)).alias("score"))


def win_rate(scored: DataFrame, utility: str, k: int = 3, query: str = "query", id_col: str = "listing_id", price: str = "price") -> DataFrame:
    """(query, ranked, cheapest, random, wins): mean utility of the first k by score, by price, and by a hash of the id, and whether the score's are no worse than the cheapest.

    Each order's first k are kept by a rank that Spark limits before it shuffles, so a query's candidates are never sorted in one task.
    """
    out = None
    for name, order in (("ranked", [F.desc("score"), F.asc(id_col)]), ("cheapest", [F.asc(price), F.asc(id_col)]), ("random", [F.sha2(F.col(id_col).cast("string"), 256).asc(), F.asc(id_col)])):
        first = scored.withColumn("_n", F.row_number().over(Window.partitionBy(query).orderBy(*order))).where(F.col("_n") <= k).groupBy(query).agg(F.avg(utility).alias(name))
        out = first if out is None else out.join(first, query)
    return out.withColumn("wins", F.col("ranked") >= F.col("cheapest"))


def shortlist(df: DataFrame, x: Intent, k: int = 5, query: str = "query", id_col: str = "listing_id") -> tuple[DataFrame, list[str]]:
    """The picks of a buyer's intent and the steps taken to find enough: filtered, relaxed as far as needed, scored, diversified. df is as for `score`."""
    found, steps = retrieve(df, x)
    return diversify(score(found, x, query), k, query, id_col), steps
