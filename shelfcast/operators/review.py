"""Review of a finished forecast: exception rules, roll-ups, pages and search."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import NAMES, is_monotonic, round_half_up
from .context import expand_events
from .ranks import element_at_share

C = F.col
#: Families of everyday goods, severities, labels and actions of the rules.
STAPLES = ["BREAD/BAKERY", "DAIRY", "EGGS", "CLEANING", "HOME CARE", "PERSONAL CARE", "GROCERY I", "POULTRY", "PRODUCE"]
SEVERITY = {
    "monotonicity": "critical", "wide_spread": "critical", "baseline_deviation": "critical", "promo_no_lift": "critical",
    "perishable_spike": "warning", "holiday_flat": "warning", "essential_low": "warning", "promo_zero_history": "warning",
    "zero_forecast": "info",
}
ACTION = {
    "monotonicity": "Data problem — fix or reject before using this row",
    "wide_spread": "Uncertain forecast — use your judgement, not just the number",
    "baseline_deviation": "Double-check this — it's very different from the usual model",
    "promo_no_lift": "Check this promotion — no sales boost is expected",
    "perishable_spike": "Perishable item — double-check you won't overstock",
    "holiday_flat": "Check holiday staffing & stock — forecast doesn't reflect the holiday",
    "essential_low": "Everyday item — confirm zero is right before it runs out",
    "promo_zero_history": "Not a confirmed stockout — flagged for review, check before assuming no demand",
    "zero_forecast": "Double-check: is zero really expected here?",
}
RANK = {"critical": 0, "warning": 1, "info": 2}
SPREAD_SHARE, LOOKBACK = 0.95, 30


@dataclass(frozen=True)
class Review:
    """Inputs: submission and baseline have id and p25..p95; test has id, date,
    store_id, product_id, promotion; history has sales_count in place of id."""

    submission: DataFrame
    test: DataFrame
    items: DataFrame
    stores: DataFrame
    events: DataFrame
    baseline: DataFrame
    history: DataFrame
    staples: tuple[str, ...] = tuple(STAPLES)


def _named(kind: Column, values: dict[str, str]) -> Column:
    out = F.when(kind.isNull(), None)
    for k, v in values.items():
        out = out.when(kind == k, v)
    return out


def severity(kind: Column) -> Column:
    return _named(kind, SEVERITY)


def action(kind: Column) -> Column:
    """What a reviewer should do about a flag."""
    return _named(kind, ACTION)


def exported(flags: DataFrame) -> DataFrame:
    """The nine columns of the exception list, as text in their own order."""
    kind = C("type")
    return flags.select("id", "store_id", "product_id", "date", "promotion", kind.alias("flag"), severity(kind).alias("severity"), action(kind).alias("action"), "detail")


def holiday_days(r: Review) -> DataFrame:
    """(store_id, date): days of events not transferred, and the days before."""
    reached = expand_events(r.events.filter(~C("is_transferred")), r.stores)
    return reached.select("store_id", F.explode(F.array("date", F.date_sub("date", 1))).alias("date")).distinct()


def joined(r: Review) -> DataFrame:
    """Submission rows with a known id, product and store."""
    return r.submission.join(r.test, "id").join(r.items, "product_id").join(r.stores.select("store_id"), "store_id")


def series_stats(r: Review) -> DataFrame:
    """Average typical forecast of a series without promotion, and away from holidays."""
    rows = r.submission.join(r.test, "id").join(holiday_days(r).withColumn("holiday", F.lit(True)), ["store_id", "date"], "left")
    return rows.groupBy("store_id", "product_id").agg(F.avg(F.when(~C("promotion"), C("p50"))).alias("non_promo_avg"), F.avg(F.when(C("holiday").isNull(), C("p50"))).alias("non_holiday_avg"))


def spread() -> Column:
    return (C("p95") - C("p25")) / F.greatest(C("p50"), F.lit(1.0))


def spread_cutoff(submission: DataFrame) -> DataFrame:
    """One row: the spread above which a forecast is unusually wide in this submission."""
    return element_at_share(submission, spread(), SPREAD_SHARE)


def _num(c: Column, places: int = 2) -> Column:
    return F.format_string(f"%.{places}f", c)


def forecast_flags(r: Review) -> DataFrame:
    """Rules 1 to 8 in one pass over the joined rows; a row may raise several."""
    rows = (
        joined(r)
        .join(series_stats(r), ["store_id", "product_id"], "left")
        .join(holiday_days(r).withColumn("holiday", F.lit(True)), ["store_id", "date"], "left")
        .join(r.baseline.select("id", C("p50").alias("b50")), "id", "left")
        .crossJoin(F.broadcast(spread_cutoff(r.submission)))
    )
    p25, p50, p75, p95 = (C(n) for n in NAMES)
    zero = (p50 == 0) & (p95 > 0)
    staple = C("product_family").isin(list(r.staples))
    flat = F.abs(p50 - C("non_holiday_avg")) / F.when(C("non_holiday_avg") > 0, C("non_holiday_avg")) < 0.1
    apart = F.abs(p50 - C("b50"))
    relative = apart / F.greatest(C("b50"), F.lit(1.0))
    rules = {
        "monotonicity": (~is_monotonic(), F.concat(F.lit("not ascending: "), F.concat_ws(", ", *map(_num, (p25, p50, p75, p95))))),
        "perishable_spike": (C("is_perishable") & F.when(p50 == 0, p95 >= 3).otherwise(p95 / F.when(p50 != 0, p50) >= 2), F.concat(F.lit("typical "), _num(p50), F.lit(", worst case "), _num(p95))),
        "promo_no_lift": (C("promotion") & (C("non_promo_avg") > 0.5) & (p50 <= C("non_promo_avg") * 1.05), F.concat(F.lit("promoted "), _num(p50), F.lit(", normal "), _num(C("non_promo_avg"), 1))),
        "holiday_flat": (C("holiday") & (C("non_holiday_avg") > 0.5) & flat, F.concat(F.lit("holiday "), _num(p50), F.lit(", normal "), _num(C("non_holiday_avg"), 1))),
        "essential_low": (zero & staple, F.concat(F.lit("zero, worst case "), _num(p95))),
        "zero_forecast": (zero & ~staple, F.concat(F.lit("zero, worst case "), _num(p95))),
        "wide_spread": (spread() >= C("cutoff"), F.concat(F.lit("from "), _num(p25), F.lit(" to "), _num(p95))),
        "baseline_deviation": ((relative >= 1) & (apart >= 3), F.concat(F.lit("baseline "), _num(C("b50")), F.lit(", apart "), round_half_up(relative * 100).cast("string"), F.lit("%"))),
    }
    raised = F.filter(F.array(*[F.when(cond, F.struct(F.lit(k).alias("type"), text.alias("detail"))) for k, (cond, text) in rules.items()]), lambda x: x.isNotNull())
    return rows.select("id", "store_id", "product_id", "date", "promotion", F.explode(raised).alias("f")).select("id", "store_id", "product_id", "date", "promotion", "f.*")


def history_flags(r: Review) -> DataFrame:
    """Rule 9: promoted days without sales in the days before the forecast."""
    first = r.test.agg(F.min("date").alias("_first"))
    series = r.test.select("store_id", "product_id").distinct()
    recent = r.history.crossJoin(F.broadcast(first)).filter(C("date") >= F.date_sub("_first", LOOKBACK))
    found = recent.filter(C("promotion") & (C("sales_count") == 0)).join(series, ["store_id", "product_id"], "left_semi")
    return found.select(F.lit(None).cast("string").alias("id"), "store_id", "product_id", "date", "promotion", F.lit("promo_zero_history").alias("type"), F.concat(F.lit("promoted on "), C("date").cast("string"), F.lit(", none sold")).alias("detail"))


def all_flags(r: Review) -> DataFrame:
    return forecast_flags(r).unionByName(history_flags(r)).withColumn("severity", severity(C("type")))


def rollups(r: Review, flags: DataFrame) -> DataFrame:
    """Stores, store-products and products of the estate, by grouping sets in one pass.

    level is 'store', 'store_product' or 'product'.
    """
    forecast = r.submission.join(r.test, "id").select("store_id", "product_id", "p25", "p50", "p95", "promotion", F.lit(0).alias("exception"), F.lit(0).alias("critical"))
    raised = flags.select("store_id", "product_id", F.lit(1).alias("exception"), (C("severity") == "critical").cast("int").alias("critical"))
    both = forecast.unionByName(raised, allowMissingColumns=True)
    sets = both.groupingSets([["store_id"], ["store_id", "product_id"], ["product_id"]], "store_id", "product_id").agg(
        F.coalesce(F.sum("p50"), F.lit(0.0)).alias("sum_p50"),
        F.coalesce(F.sum("p95"), F.lit(0.0)).alias("sum_p95"),
        F.min("p25").alias("min_p25"),
        F.max("p95").alias("max_p95"),
        F.coalesce(F.bool_or("promotion"), F.lit(False)).alias("any_promotion"),
        F.sum("exception").alias("exceptions"),
        F.sum("critical").alias("critical"),
        F.grouping_id("store_id", "product_id").alias("_g"),
    )
    return sets.withColumn("level", F.when(C("_g") == 1, "store").when(C("_g") == 0, "store_product").otherwise("product")).drop("_g")


def flag_counts(flags: DataFrame) -> DataFrame:
    return flags.groupBy("type", "severity").agg(F.count("*").alias("n"))


def severity_rank() -> Column:
    out = F.when(C("severity").isNull(), 9)
    for k, v in RANK.items():
        out = out.when(C("severity") == k, v)
    return out


def exception_page(flags: DataFrame, kind: str | None = None, promotion: bool | None = None, start=None, end=None, size: int = 300) -> DataFrame:
    """The first ``size`` exceptions by severity and date, with the number of all."""
    for on, cond in ((kind, C("type") == kind), (promotion, C("promotion") == F.lit(promotion)), (start, C("date") >= F.lit(start).cast("date")), (end, C("date") <= F.lit(end).cast("date"))):
        if on is not None:
            flags = flags.filter(cond)
    total = flags.agg(F.count("*").alias("total"))
    return flags.orderBy(severity_rank(), "date", "store_id", "product_id", "type").limit(size).crossJoin(F.broadcast(total))


def top_risk(rolled: DataFrame, k: int = 3) -> DataFrame:
    """The riskiest products of each store."""
    w = Window.partitionBy("store_id").orderBy(F.desc("critical"), F.desc("exceptions"), "product_id")
    return rolled.filter("level = 'store_product' AND exceptions > 0").withColumn("rank", F.row_number().over(w)).filter(C("rank") <= k).select("store_id", "product_id", "critical", "exceptions", "rank")


def submission_check(submission: DataFrame, test: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: schema_ok, total, missing, extra, monotonic_violations."""
    ok = (columns or submission.columns) == ["id", *NAMES]
    both = submission.withColumn("_s", F.lit(1)).join(test.select("id").withColumn("_t", F.lit(1)), "id", "full")
    return both.agg(F.lit(ok).alias("schema_ok"), F.count("_s").alias("total"), F.count_if(C("_s").isNull()).alias("missing"), F.count_if(C("_t").isNull()).alias("extra"), F.count_if(C("_s").isNotNull() & ~is_monotonic()).alias("monotonic_violations"))


def store_search(stores: DataFrame, city=None, cluster=None, kind=None, text: str = "") -> DataFrame:
    """Stores by facets and a substring of id or city, by numeric id."""
    for on, cond in ((city, C("city") == city), (cluster, C("store_cluster") == cluster), (kind, C("store_type") == kind)):
        if on is not None:
            stores = stores.filter(cond)
    like = text.strip().lower()
    return stores.filter(F.lower("city").contains(like) | C("store_id").cast("string").contains(like)).orderBy(C("store_id").cast("int"))


def product_search(items: DataFrame, family=None, product_class=None, perishable=None, text: str = "") -> DataFrame:
    for on, cond in ((family, C("product_family") == family), (product_class, C("product_class") == product_class), (perishable, C("is_perishable") == F.lit(perishable))):
        if on is not None:
            items = items.filter(cond)
    like = text.strip().lower()
    return items.filter(F.lower("product_family").contains(like) | F.lower(C("product_id").cast("string")).contains(like)).orderBy("product_id")


def sorted_stores(rolled: DataFrame, by: str = "risk") -> DataFrame:
    keys = [F.desc("critical"), F.desc("exceptions")] if by == "risk" else [F.desc("sum_p95")]
    return rolled.filter("level = 'store'").orderBy(*keys, "store_id")


def sorted_products(rolled: DataFrame, items: DataFrame) -> DataFrame:
    """Products of the estate: perishable first, then by risk."""
    return rolled.filter("level = 'product'").drop("store_id").join(items, "product_id").orderBy(F.desc("is_perishable"), F.desc("critical"), F.desc("exceptions"), "product_id")


def chart_rows(r: Review) -> DataFrame:
    """Recent history and forecast of each series under one another, the latter beside its baseline."""
    first = r.test.agg(F.min("date").alias("_first"))
    past = r.history.crossJoin(F.broadcast(first)).filter(C("date") >= F.date_sub("_first", LOOKBACK)).select("store_id", "product_id", "date", "promotion", "sales_count", F.lit("history").alias("part"))
    base = [f"base_{n}" for n in NAMES]
    beside = r.baseline.select("id", *[C(n).alias(b) for n, b in zip(NAMES, base, strict=True)])
    ahead = r.submission.join(r.test, "id").join(beside, "id", "left").select("store_id", "product_id", "date", "promotion", *NAMES, *base, F.lit("forecast").alias("part"))
    return past.unionByName(ahead, allowMissingColumns=True)


def calendar_overlay(r: Review) -> DataFrame:
    """One event of each store and charted day: the last by type, then place."""
    days = chart_rows(r).select("store_id", "date").distinct()
    reached = expand_events(r.events.filter(~C("is_transferred")), r.stores)
    return reached.join(days, ["store_id", "date"]).groupBy("store_id", "date").agg(F.max(F.struct("event_type", "scope", "location")).alias("m")).select("store_id", "date", "m.*")


def traffic_lookup(rows: DataFrame, traffic: DataFrame) -> DataFrame:
    return rows.join(traffic, ["store_id", "date"], "left")
