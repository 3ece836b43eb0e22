"""Grading: suspicious values are kept and labelled; what is not known to be usable is not eligible."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Policy (fixed values).
MAX_KM, SUSPICIOUS_KM, LEAST_KM_A_YEAR, MIN_AGE = 1_500_000, 900_000, 1_500, 3
LEAST_PRICE = 10_000_000
USABLE_PRICES = ("display_confirmed", "structured_only", "displayed_only", "label_corrected")
FAR, FAR_LEAST = 5, 3
CONDITION_SEVERITY = ["intact", "minor_paint", "multi_paint", "replaced_part", "accident"]
CONDITION_RISK = {"intact": 0.05, "minor_paint": 0.20, "unknown": 0.35, "multi_paint": 0.50, "replaced_part": 0.65, "accident": 0.85}
DIAGNOSTICS = {"seller_type", "price_status", "mileage_status", "price_kind", "product_class", "province_source", "condition_source"}


def classify_http(status: Column, removed: Column) -> Column:
    """ok, absent or unknown. Only 404, 410 and a removed page are absence; being refused or failing is not knowing."""
    return F.when(removed | status.isin(404, 410), "absent").when(status.between(200, 299), "ok").otherwise("unknown")


def classify_mileage(km: Column, age: Column) -> Column:
    return (
        F.when(km.isNull(), "unknown")
        .when((km < 0) | (km > MAX_KM), "impossible")
        .when(km >= SUSPICIOUS_KM, "suspicious")
        .when((age >= MIN_AGE) & (km < LEAST_KM_A_YEAR * age), "suspicious")
        .otherwise("ok")
    )


def classify_price(price: Column) -> Column:
    return F.when(price.isNull(), "absent").when(price <= 0, "not_positive").when(price < LEAST_PRICE, "too_small").otherwise("ok")


def hold_apart_far_prices(df: DataFrame, groups: list[str], price: str = "price", times: int = FAR, least: int = FAR_LEAST) -> DataFrame:
    """Adds far: the price is `times` its group's median or more, or that many times less, among at least `least` priced rows. Rows stay.

    The medians are aggregated and joined back, so a large group is never sorted in one task; a null key is a group of its own.
    """
    middle = df.where(F.col(price).isNotNull()).groupBy(*groups).agg(F.count("*").alias("_n"), F.percentile(price, F.lit(0.5)).alias("_mid"))
    keys = [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in groups]
    both = df.join(middle.withColumnsRenamed({g: f"_{g}" for g in groups}), keys, "left")
    p = F.col(price)
    far = (F.col("_n") >= least) & ((p >= times * F.col("_mid")) | (times * p <= F.col("_mid")))
    return both.withColumn("far", F.coalesce(far, F.lit(False))).drop("_n", "_mid", *(f"_{g}" for g in groups))


def without_far_prices(graded_rows: DataFrame, groups: list[str], times: int = FAR, least: int = FAR_LEAST) -> DataFrame:
    """Graded listings whose far prices have the status far_from_group, and are not eligible for that reason; rows stay."""
    df = hold_apart_far_prices(graded_rows, groups, times=times, least=least)
    why = F.when(F.col("far"), F.array(F.lit("price is far_from_group"))).otherwise(F.array().cast("array<string>"))
    df = df.withColumns({"price_status": F.when(F.col("far"), "far_from_group").otherwise(F.col("price_status")), "reasons": F.concat("reasons", why)})
    return df.withColumn("eligible", F.size("reasons") == 0)


def reasons(required: list[str], mileage_status: Column) -> Column:
    """All reasons why a listing may not be appraised, in a fixed order; empty if it may. Unknown provenance counts against it."""
    found = [F.when(F.col(c).isNull(), f"no {c}") for c in required]
    price = classify_price(F.col("price"))
    found.append(F.when(F.col("price").isNotNull() & (price != "ok"), F.concat(F.lit("price is "), price)))
    found.append(F.when(F.col("product_class").isNull(), "product class unknown").when(F.col("product_class") != "vehicle", F.concat(F.lit("product class is "), F.col("product_class"))))
    found.append(F.when(F.col("price_kind").isNull(), "price kind unknown").when(F.col("price_kind") != "cash", F.concat(F.lit("price is "), F.col("price_kind"))))
    found.append(F.when(mileage_status.isNull(), "mileage unknown").when(mileage_status.isin("suspicious", "impossible"), F.concat(F.lit("mileage is "), mileage_status)))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def graded(listings: DataFrame, now: int, required: tuple[str, ...] = ("make", "model", "year", "mileage_km", "price")) -> DataFrame:
    """Listings with age, mileage_status, price_status, reasons and eligible."""
    df = listings.withColumn("age", F.lit(now) - F.col("year"))
    df = df.withColumn("mileage_status", classify_mileage(F.col("mileage_km"), F.col("age"))).withColumn("price_status", classify_price(F.col("price")))
    df = df.withColumn("reasons", reasons(list(required), F.col("mileage_status")))
    return df.withColumn("eligible", F.size("reasons") == 0)


def reconcile_price(text: Column, data: Column) -> Column:
    """One price from two readings: agreeing within a hundredth, or off by a factor of ten (rial and toman); else none."""
    near = F.abs(text - data) * 100 <= data
    return (
        F.when(text.isNull(), data)
        .when(data.isNull() | near, text)
        .when(F.abs(text * 10 - data) * 100 <= data, text)
        .when(F.abs(text - data * 10) * 100 <= text, data)
    )


def reconcile_odometer(structured: Column, shown: Column, rounding: int = 1_000, share: float = 0.02) -> tuple[Column, Column]:
    """(km, code) from two readings of one odometer: within rounding or a share of what is shown they agree; a structured one in thousands gives way to what is shown; else there is none."""
    room = F.greatest(F.lit(float(rounding)), shown * share)
    agree, thousands = F.abs(structured - shown) <= room, (structured > 0) & (F.abs(structured * 1000 - shown) <= room)
    code = F.when(structured.isNull() & shown.isNull(), "none").when(shown.isNull(), "structured_only").when(structured.isNull(), "shown_only").when(agree, "agree").when(thousands, "in_thousands").otherwise("disagree")
    km = F.when(code.isin("structured_only", "agree"), structured).when(code.isin("shown_only", "in_thousands"), shown)
    return km, code


def priced(price: Column, status: Column, kind: Column) -> Column:
    """The asking price that may be shown as one: above zero, of a usable status or none, cash or of no stated kind; else null."""
    usable = status.isNull() | status.isin("ok", *USABLE_PRICES)
    return F.when((price > 0) & usable & (kind.isNull() | (kind == "cash")), price)


#: Surfaces a field may appear on (fixed values); a field that isn't here may appear nowhere.
FIELDS = {
    "listing_id": (), "source_url": ("card", "detail"), "make": ("card", "detail"), "model": ("card", "detail", "facet"), "trim": ("card", "detail", "facet"), "year_jalali": ("card", "detail", "facet"), "color": ("detail", "facet"),
    "asking_price_toman": ("card", "detail", "facet"), "price_status": ("card", "detail"), "price_kind": ("card", "detail"), "price_kind_source": ("detail",), "price_currency_raw": (), "mileage_km": ("card", "detail", "facet"), "mileage_status": ("card", "detail"),
    "mileage_line_canonical": ("detail",), "condition": ("detail", "facet"), "condition_source": ("detail",), "product_class": ("card", "detail", "gate"), "product_class_source": ("detail",), "dealer_badge": (), "document_issue": (), "seller_type": (),
    "province": ("card", "detail", "facet"), "province_source": ("card", "detail"), "gearbox": ("facet",), "fuel": (), "model_key": ("card", "detail"), "derived_title": ("card", "detail"), "observed_at": ("card", "detail"), "listing_age": ("card", "detail"), "image": (),
}


def may(field: str, surface: str) -> bool:
    """Whether a field may appear on a surface: card, detail, gate or facet."""
    return surface in FIELDS.get(field, ())


def shown_on(df: DataFrame, surface: str) -> DataFrame:
    """The columns of df that may appear on a surface."""
    return df.select(*(c for c in df.columns if may(c, surface)))


def worse_condition(a: Column, b: Column) -> Column:
    """The more severe of two labels; a known one beats an unknown one."""
    rank = F.array(F.lit("unknown"), *map(F.lit, CONDITION_SEVERITY))
    at = lambda c: F.greatest(F.array_position(rank, F.coalesce(c, F.lit("unknown"))), F.lit(1))
    return F.element_at(rank, F.greatest(at(a), at(b)).cast("int"))


def condition_risk(condition: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in CONDITION_RISK.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.coalesce(condition, F.lit("unknown"))), F.lit(CONDITION_RISK["unknown"]))


def assert_not_features(names: list[str]) -> None:
    """Diagnostics describe how a value was read and may never be learned from."""
    if leaked := sorted(DIAGNOSTICS & set(names)):
        raise ValueError(f"diagnostics are not features: {', '.join(leaked)}")


def decide_seller_type(evidence: list[tuple[str, Column]]) -> Column:
    """dealer if any sign says so, else private if any does, else unknown; signs in the order given, dealers first."""
    dealers = [c for kind, c in evidence if kind == "dealer"]
    private = [c for kind, c in evidence if kind == "private"]
    any_of = lambda cs: F.greatest(*(F.coalesce(c, F.lit(False)) for c in cs), F.lit(False))
    return F.when(any_of(dealers), "dealer").when(any_of(private), "private").otherwise("unknown")


def funnel(df: DataFrame, by: list[str]) -> DataFrame:
    """Of each group: fetched, parsed (make and model), usable (priced and plausible), eligible."""
    parsed = F.col("make").isNotNull() & F.col("model").isNotNull()
    usable = parsed & (F.col("price_status") == "ok") & F.col("mileage_status").isin("ok", "unknown")
    return df.groupBy(*by).agg(F.count("*").alias("fetched"), F.count_if(parsed).alias("parsed"), F.count_if(usable).alias("usable"), F.count_if("eligible").alias("eligible"))


def held_back(df: DataFrame) -> DataFrame:
    """How many listings are held back for each first reason."""
    return df.where("not eligible").groupBy(F.element_at("reasons", 1).alias("reason")).agg(F.count("*").alias("n"))


def field_inventory(df: DataFrame, fields: list[str], garbage: dict[str, Column]) -> DataFrame:
    """One row for each field: share filled, share garbage, share usable, from one pass over the data."""
    sums = [F.struct(F.lit(f).alias("field"), F.avg(F.col(f).isNotNull().cast("int")).alias("filled"), F.avg(F.coalesce(garbage.get(f, F.lit(False)), F.lit(False)).cast("int")).alias("garbage")) for f in fields]
    rows = df.agg(F.array(*sums).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    return rows.withColumn("usable", F.col("filled") - F.col("garbage"))


def latest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
