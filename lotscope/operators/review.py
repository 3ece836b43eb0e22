"""Reviewing an answer: confidence from named bands, findings, and claims that must rest on evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Policy (fixed values): bands as (at least, score).
EVIDENCE_DAYS = [(5, 1.00), (3, 0.65), (1, 0.35), (0, 0.00)]
KNOWN_RATIO = [(0.90, 1.00), (0.70, 0.60), (0.50, 0.30), (0.00, 0.10)]
TIER_CEILING = {"strict": 1.00, "relaxed_mileage": 0.70, "relaxed_year": 0.45, "model_only": 0.20, "global": 0.0}
WEIGHTS = {"comparable": 0.25, "evidence": 0.20, "calibration": 0.20, "data_quality": 0.20, "temporal": 0.15}
ANOMALY, HIGH_AT, MEDIUM_AT, LEAST = 0.30, 0.68, 0.42, 0.20
SURE_LINK = 0.85
FEW_COMPARABLES, DISPERSED, DOMINATED, TOO_WIDE = 8, 0.55, 12, 0.60
SEVERITY_RISK = {"low": 0.10, "medium": 0.25, "high": 0.50}
LEVELS = ["HIGH", "MEDIUM", "LOW", "INSUFFICIENT_EVIDENCE"]


def band(value: Column, bands: list[tuple[float, float]]) -> Column:
    out = F.lit(bands[-1][1])
    for least, score in reversed(bands[:-1]):
        out = F.when(value >= least, score).otherwise(out)
    return out


def comparable_strength(tier: Column, n: Column, dispersion: Column) -> Column:
    """The tier sets the ceiling, the number of comparables how much of it is earned; wide dispersion costs a quarter."""
    known = F.create_map(*[F.lit(x) for kv in TIER_CEILING.items() for x in kv])
    earned = 0.35 + 0.65 * F.least(F.lit(1.0), n / 30)
    base = F.coalesce(F.try_element_at(known, tier), F.lit(0.0)) * F.when(n > 0, earned).otherwise(0.0)
    return base * F.when(dispersion > 0.40, 0.75).otherwise(1.0)


def confidence(df: DataFrame) -> DataFrame:
    """Adds confidence, status and weakest, from columns evidence, comparable, temporal, calibration, data_quality and anomaly."""
    total = sum((F.col(c) * w for c, w in WEIGHTS.items()), F.lit(0.0)) - ANOMALY * F.col("anomaly")
    core = F.least("evidence", "comparable", "data_quality")
    status = F.when(core < LEAST, LEVELS[3]).when(total >= HIGH_AT, LEVELS[0]).when(total >= MEDIUM_AT, LEVELS[1]).otherwise(LEVELS[2])
    order = ["evidence", "comparable", "temporal", "calibration", "data_quality"]
    low = F.least(*order)
    weakest = F.coalesce(*(F.when(F.col(c) == low, c) for c in order))
    return df.withColumns({"confidence": total, "status": status, "weakest": weakest})


def downgraded(status: Column, steps: Column) -> Column:
    """A level lower for each step, never below the last."""
    levels = F.array(*map(F.lit, LEVELS))
    return F.element_at(levels, F.least(F.array_position(levels, status) + steps, F.lit(len(LEVELS))).cast("int"))


def findings(rules: list[tuple[str, Column | str, str, bool, Column]]) -> Column:
    """array<struct<code, severity, action, hard>> of the rules (code, severity, action, hard, test) that hold, in their order."""
    lit = lambda x: F.lit(x) if isinstance(x, str | bool) else x
    found = [F.when(F.coalesce(ok, F.lit(False)), F.struct(F.lit(code).alias("code"), lit(severity).alias("severity"), F.lit(action).alias("action"), F.lit(hard).alias("hard"))) for code, severity, action, hard, ok in rules]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def risk_rules() -> list[tuple[str, Column | str, str, bool, Column]]:
    """What is weak in an answer, over columns tier, n, dispersion, unknown_days, reposts and served."""
    c = F.col
    return [
        ("weak_comparable_tier", "high", "downgrade", False, c("tier").isin("model_only", "global")),
        ("relaxed_year", "medium", "downgrade", False, c("tier") == "relaxed_year"),
        ("sparse_comparables", "high", "downgrade", False, c("n") < FEW_COMPARABLES),
        ("high_dispersion", "medium", "downgrade", False, ~F.isnan("dispersion") & (c("dispersion") > DISPERSED)),
        ("observation_gap", F.when(c("unknown_days") > 2, "medium").otherwise("low"), "downgrade", False, c("unknown_days") > 0),
        ("reposted", "low", "approve", False, c("reposts") > 0),
        ("estimator_not_accepted", "high", "reject", True, ~c("served")),
    ]


def challenges() -> list[tuple[str, Column | str, str, bool, Column]]:
    """Attempts to break an answer, none where no estimator serves one; over n, price, p01, p99, n_market, q1, q4, reposts, weak_link, tracked and present_days besides."""
    c, on = F.col, F.col("served")
    return [
        ("estimate_dominated_by_few", "high", "downgrade", False, on & (c("n") > 0) & (c("n") < DOMINATED)),
        ("outside_observed_distribution", "high", "reject", True, on & (c("n_market") >= 10) & ((c("price") < c("p01")) | (c("price") > c("p99")))),
        ("interval_too_wide", "medium", "downgrade", False, on & (c("q1") > 0) & (F.try_divide(c("q4") - c("q1"), c("q1")) > TOO_WIDE)),
        ("repost_link_uncertain", "medium", "downgrade", False, on & c("tracked") & (c("reposts") > 0) & c("weak_link")),
        ("never_confirmed_present", "high", "reject", True, on & c("tracked") & (c("present_days") == 0)),
    ]


def market_range(df: DataFrame, train: DataFrame, key: str, price: str = "price") -> DataFrame:
    """Adds n_market, p01 and p99 of the prices of the row's model: one aggregate of each model, joined back."""
    per = train.groupBy(key).agg(F.count(price).alias("n_market"), F.percentile(price, F.array(F.lit(0.01), F.lit(0.99))).alias("_p"))
    return df.join(per, key, "left").withColumns({"n_market": F.coalesce("n_market", F.lit(0)), "p01": F.col("_p")[0], "p99": F.col("_p")[1]}).drop("_p")


def verdicts(df: DataFrame, risk: str = "risk", adversarial: str = "adversarial") -> DataFrame:
    """Adds status_before, status, decision, reasons (codes) from the findings of both reviews; confidence, status and served must be there.

    In this order: a hard finding rejects, whatever the score; without an accepted estimator the evidence is insufficient; each high finding that
    asks for it lowers the status a level, or else any medium one does, once. A status lowered to the last level is insufficient evidence.
    """
    both = F.concat(risk, adversarial)
    df = df.withColumns({"findings": both, "status_before": F.col("status")})
    codes = lambda test: F.transform(F.filter("findings", test), lambda x: x["code"])
    hard = codes(lambda x: x["hard"])
    high = codes(lambda x: (x["action"] == "downgrade") & (x["severity"] == "high"))
    medium = F.slice(codes(lambda x: (x["action"] == "downgrade") & (x["severity"] == "medium")), 1, 1)
    df = df.withColumns({"_hard": hard, "_high": high, "_medium": medium})
    lowered = downgraded(F.col("status_before"), F.size("_high"))
    soft = F.when(lowered != F.col("status_before"), lowered).otherwise(downgraded(F.col("status_before"), F.size("_medium")))
    veto, last = F.size("_hard") > 0, LEVELS[-1]
    status = F.when(veto | ~F.col("served"), last).otherwise(soft)
    out = df.withColumn("status", status)
    decision = F.when(F.size("_hard") > 0, "reject").when(~F.col("served") | (F.col("status") == last), "insufficient_evidence").when(F.col("status") == F.col("status_before"), "approve").otherwise("downgrade")
    reasons = F.when(F.size("_hard") > 0, F.col("_hard")).when(~F.col("served"), F.array(F.lit("estimator_not_accepted"))).when(lowered != F.col("status_before"), F.col("_high")).otherwise(F.concat("_high", "_medium"))
    return out.withColumns({"decision": decision, "reasons": reasons}).drop("_hard", "_high", "_medium")


def reviewed(df: DataFrame, shift_severe: bool = False) -> DataFrame:
    """Every listing's answer from evidence to verdict, for all rows at once: strengths, findings of both reviews, confidence, and what the judge makes of them.

    From present_days, span, unknown_days, tier, n, dispersion, reposts, served, q1, q4, price, p01, p99, n_market, weak_link and tracked.
    """
    known = 1 - F.col("unknown_days") / (F.col("span") + 1)
    df = df.withColumns({"risk": findings(risk_rules()), "adversarial": findings(challenges())})
    severity = F.create_map(*[F.lit(x) for kv in SEVERITY_RISK.items() for x in kv])
    anomaly = F.aggregate(F.concat("risk", "adversarial"), F.lit(0.0), lambda a, x: a + F.element_at(severity, x["severity"]), lambda a: F.least(a, F.lit(1.0)))
    quality = F.lit(0.3) if shift_severe else F.when(F.col("served"), 1.0).otherwise(0.4)
    df = df.withColumns({
        "evidence": band(F.col("present_days"), EVIDENCE_DAYS), "temporal": F.when(F.col("span") > 0, band(known, KNOWN_RATIO)).otherwise(0.0), "comparable": comparable_strength(F.col("tier"), F.col("n"), F.col("dispersion")),
        "calibration": F.when(F.col("served"), 1.0).otherwise(0.0), "data_quality": quality, "anomaly": anomaly,
    })
    return verdicts(confidence(df))


def evidence_packet(tracked: DataFrame, events: DataFrame) -> DataFrame:
    """(item, span, present_days, unknown_days, reposts, weak_link, price_changes): what was seen of each item, from tracking.day_accounts and events (item, event, score)."""
    changes = events.groupBy("item").agg(F.count_if(F.col("event") == "price_change").alias("price_changes"), F.count_if(F.col("event") == "reposted").alias("reposts"), F.max((F.col("event") == "reposted") & F.coalesce(F.col("score") < SURE_LINK, F.lit(False))).alias("weak_link"))
    out = tracked.select("item", "span", "present_days", "unknown_days").join(changes, "item", "left")
    return out.na.fill(0, ["price_changes", "reposts"]).withColumn("weak_link", F.coalesce("weak_link", F.lit(False)))


def answers(listings: DataFrame, packets: DataFrame, comparables: DataFrame, estimates: DataFrame | None, train: DataFrame, key: str = "model_key", id_col: str = "listing_id", item: str = "item", shift_severe: bool = False) -> DataFrame:
    """Every listing's reviewed answer: what was seen of it, what it is compared with, an estimate if an accepted estimator serves one (else None), both reviews, and the verdict.

    listings: id, key, price and item; comparables: id, tier, n, dispersion; estimates: id, q1.., q4. A listing without history or comparables is judged as one without.
    """
    out = market_range(listings, train, key).join(packets.withColumn("tracked", F.lit(True)), item, "left").join(comparables.select(id_col, "tier", "n", "dispersion"), id_col, "left")
    if estimates is None:
        out = out.withColumns({"served": F.lit(False), "q1": F.lit(None).cast("double"), "q4": F.lit(None).cast("double")})
    else:
        out = out.join(estimates.select(id_col, "q1", "q4").withColumn("served", F.lit(True)), id_col, "left")
    filled = {"tracked": False, "weak_link": False, "served": False, "span": 0, "present_days": 0, "unknown_days": 0, "reposts": 0, "n": 0, "tier": "global", "dispersion": float("nan")}
    return reviewed(out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in filled.items()}), shift_severe)


def claim_of_comparables(tier: Column, n: Column) -> Column:
    """What may be said of the comparables: only those of the strict tier are called alike (wording is a fixed value)."""
    say = lambda tail: F.concat(n.cast("string"), F.lit(tail))
    return (
        F.when(tier == "strict", say(" آگهی مشابه (مدل، سال و کارکرد نزدیک)"))
        .when(tier == "relaxed_mileage", say(" آگهی با همین مدل و سال (کارکرد متفاوت)"))
        .when(tier == "relaxed_year", say(" آگهی با همین مدل (سال متفاوت)"))
        .when(tier == "model_only", say(" آگهی از همین مدل — مشابه نیستند"))
        .otherwise("داده‌ی کافی برای این مدل نداریم")
    )


def claim_of_age(span: Column, from_start: Column) -> Column:
    """How long a listing has been seen: at least so long, unless its appearance was seen (wording is a fixed value)."""
    return F.when(from_start, F.concat(span.cast("string"), F.lit(" روز است که در بازار است"))).otherwise(F.concat(F.lit("از شروع رصد ما حداقل "), span.cast("string"), F.lit(" روز در بازار بوده")))


def unsupported(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """(claim_id, missing): claims that cite nothing (missing is null) or evidence that doesn't exist."""
    cited = claims.select("claim_id", F.explode_outer("evidence_ids").alias("missing"))
    return cited.join(evidence.select(F.col("evidence_id").alias("missing")).distinct(), "missing", "left_anti").select("claim_id", "missing")
