"""Queries of the review and of scores, with their SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics
from ..operators import baseline, review, validation
from ..operators.context import unmatched_events
from ..sources.adapter import HORIZON, panel_sources
from ..sources.shared import written
from . import oracle, panel_queries
from .oracle import _QS, with_ctes
from .panel_queries import DATELESS, query, register, tidy

C = F.col
STAPLES = ("S", "E")


def _test(panel: DataFrame) -> DataFrame:
    return panel.filter("dataset_split = 'test'").select("id", "date", "store_id", "product_id", "promotion")


def _history(panel: DataFrame) -> DataFrame:
    return panel.filter("dataset_split = 'train'").select("date", "store_id", "product_id", "promotion", "sales_count")


def derived_submission(panel: DataFrame) -> DataFrame:
    """Trailing quantiles with faults put in on fixed days, so every rule has work.

    Store 1 has none that move its typical forecast: its holidays are as flat as rule 4 looks for.
    """
    k = (F.dayofmonth("date") + C("store_id") * 3 + F.length("product_id")) % 11
    k = F.when((C("store_id") == 1) & k.isin(0, 3), 10).otherwise(k)
    p25, p50, p75, p95 = (C(n) for n in metrics.NAMES)
    rows = _test(panel).join(baseline.trailing_quantiles(_history(panel)), ["store_id", "product_id"])
    return rows.select(
        "id",
        p25,
        F.when(k == 0, 0.0).when(k == 3, p50 * 2.5).otherwise(p50).alias("p50"),
        F.when(k == 2, p50 - 1).when(k == 3, p75 * 2.5).otherwise(p75).alias("p75"),
        F.when(k == 1, p95 * 4).when(k == 3, p95 * 2.5).otherwise(p95).alias("p95"),
    )


def derived_history(panel: DataFrame) -> DataFrame:
    """Past sales in which some promoted days sold nothing, so that rule 9 has work."""
    k = (F.dayofmonth("date") + C("store_id") * 3 + F.length("product_id")) % 11
    return _history(panel).withColumn("sales_count", F.when(C("promotion") & (k == 7), 0.0).otherwise(C("sales_count")))


def derived_review(spark: SparkSession, sf_dir: str) -> review.Review:
    """Inputs of a review. Panel, submission and baseline are files, as in practice:
    a review reads each of them under several roles. Events of working days count as
    moved, so that the horizon has days with a holiday and days without."""
    s = panel_sources(spark, sf_dir)
    panel = written(s.panel, "panel")
    submission = written(derived_submission(panel), "submission")
    base = written(baseline.historical_quantiles(_history(panel), _test(panel)).select("id", *metrics.NAMES), "baseline")
    return review.Review(submission, _test(panel), s.items, s.stores, s.events.withColumn("is_transferred", C("is_transferred") | (F.weekday("date") < 5)), base, derived_history(panel), STAPLES)


FLAG = "id, store_id, product_id, date, promotion, type, severity"


def _rule(number: int, kind: str) -> None:
    def run(spark, sf_dir):
        r = derived_review(spark, sf_dir)
        flags = review.history_flags(r) if kind == "promo_zero_history" else review.forecast_flags(r)
        return flags.filter(C("type") == kind).withColumn("severity", review.severity(C("type"))).drop("detail")

    register(f"r{number}_{kind}", run, with_ctes(f"SELECT {FLAG} FROM flags WHERE type = '{kind}'", "flags"))


for _i, _k in enumerate(["monotonicity", "perishable_spike", "promo_no_lift", "holiday_flat", "essential_low", "zero_forecast", "wide_spread", "baseline_deviation", "promo_zero_history"], 1):
    _rule(_i, _k)


@query(with_ctes(f"SELECT {FLAG} FROM flags", "flags"))
def r_all_flags(spark, sf_dir):
    return review.all_flags(derived_review(spark, sf_dir)).drop("detail")


DATELESS |= {
    "a23_spread_cutoff", "a18_series_stats", "a19_store_rollup", "a20_store_product_rollup", "a21_estate_rollup", "a22_flag_counts", "t5_top_risk", "t6_stores_by_exposure", "t7_products_by_risk",
    "p17_store_search", "p18_product_search", "v15_submission_check", "f13_pinball_report", "f14_weighted_score", "v1_panel_summary", "v7_final_audit", "u7_panel_completeness", "m5_split_stats", "v4_ordered_ids", "a17_horizon_days", "s9_submission_csv", "j16_ordered_ids", "t9_top_factors", "m19_shap_buckets", "v13_additivity", "f22_nice_maximum", "v2_dimension_summary",
}


@query(with_ctes("SELECT round(cutoff, 6) AS cutoff FROM cutoff", "cutoff"))
def a23_spread_cutoff(spark, sf_dir):
    return tidy(review.spread_cutoff(derived_submission(panel_sources(spark, sf_dir).panel)))


@query(with_ctes("SELECT store_id, product_id, round(non_promo_avg, 6) AS non_promo_avg, round(non_holiday_avg, 6) AS non_holiday_avg FROM stats", "stats"))
def a18_series_stats(spark, sf_dir):
    return tidy(review.series_stats(derived_review(spark, sf_dir)))


_SUMS = "round(coalesce(sum(p50), 0), 6) AS sum_p50, round(coalesce(sum(p95), 0), 6) AS sum_p95, round(min(p25), 6) AS min_p25, round(max(p95), 6) AS max_p95, coalesce(bool_or(promotion), false) AS any_promotion, CAST(sum(exception) AS BIGINT) AS exceptions, CAST(sum(critical) AS BIGINT) AS critical"


def _rolled(spark, sf_dir) -> DataFrame:
    r = derived_review(spark, sf_dir)
    return review.rollups(r, review.all_flags(r))


@query(with_ctes(f"SELECT store_id, {_SUMS} FROM both_ GROUP BY 1", "both_"))
def a19_store_rollup(spark, sf_dir):
    return tidy(_rolled(spark, sf_dir).filter("level = 'store'").drop("level", "product_id"))


@query(with_ctes(f"SELECT store_id, product_id, {_SUMS} FROM both_ GROUP BY 1, 2", "both_"))
def a20_store_product_rollup(spark, sf_dir):
    return tidy(_rolled(spark, sf_dir).filter("level = 'store_product'").drop("level"))


@query(with_ctes(f"SELECT product_id, {_SUMS} FROM both_ GROUP BY 1", "both_"))
def a21_estate_rollup(spark, sf_dir):
    return tidy(_rolled(spark, sf_dir).filter("level = 'product'").drop("level", "store_id"))


@query(with_ctes("SELECT type, severity, count(*) AS n FROM flags GROUP BY 1, 2", "flags"))
def a22_flag_counts(spark, sf_dir):
    return review.flag_counts(review.all_flags(derived_review(spark, sf_dir)))


@query(
    with_ctes(
        f"SELECT {FLAG}, (SELECT count(*) FROM flags) AS total FROM flags ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, date, store_id, product_id, type LIMIT 300",
        "flags",
    )
)
def t3_exception_page(spark, sf_dir):
    return review.exception_page(review.all_flags(derived_review(spark, sf_dir))).drop("detail")


@query(
    with_ctes(
        "SELECT *, CAST(row_number() OVER (PARTITION BY store_id ORDER BY critical DESC, exceptions DESC, product_id) AS INTEGER) AS rank FROM (SELECT store_id, product_id, CAST(sum(critical) AS BIGINT) AS critical, CAST(sum(exception) AS BIGINT) AS exceptions FROM both_ GROUP BY 1, 2) WHERE exceptions > 0 QUALIFY rank <= 3",
        "both_",
    )
)
def t5_top_risk(spark, sf_dir):
    return review.top_risk(_rolled(spark, sf_dir))


@query(with_ctes(f"SELECT store_id, {_SUMS} FROM both_ GROUP BY 1 ORDER BY sum(p95) DESC", "both_"))
def t6_stores_by_exposure(spark, sf_dir):
    return tidy(review.sorted_stores(_rolled(spark, sf_dir), "exposure").drop("level", "product_id"))


@query(with_ctes(f"SELECT r.*, product_family, product_class, is_perishable FROM (SELECT product_id, {_SUMS} FROM both_ GROUP BY 1) r JOIN items USING (product_id)", "both_", "items"))
def t7_products_by_risk(spark, sf_dir):
    return tidy(review.sorted_products(_rolled(spark, sf_dir), panel_sources(spark, sf_dir).items).drop("level"))


@query(with_ctes("SELECT store_id, city, department, store_type, store_cluster FROM stores WHERE store_cluster = 0 AND (lower(city) LIKE '%a%' OR CAST(store_id AS VARCHAR) LIKE '%a%')", "stores"))
def p17_store_search(spark, sf_dir):
    return review.store_search(panel_sources(spark, sf_dir).stores, cluster=0, text="A")


@query(with_ctes("SELECT product_id, product_family, product_class, is_perishable FROM items WHERE is_perishable AND (lower(product_family) LIKE '%s%' OR lower(product_id) LIKE '%s%')", "items"))
def p18_product_search(spark, sf_dir):
    return review.product_search(panel_sources(spark, sf_dir).items, perishable=True, text="s")


@query(with_ctes("SELECT store_id, product_id, date, promotion, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("sales_count", *_QS, *(f"base_{n}" for n in _QS))) + ", part FROM chart", "chart"))
def u2_chart_rows(spark, sf_dir):
    return tidy(review.chart_rows(derived_review(spark, sf_dir)))


@query(
    with_ctes(
        "SELECT r.store_id, r.date, m.event_type, m.scope, m.location FROM (SELECT store_id, date, max({'event_type': event_type, 'scope': scope, 'location': location}) AS m FROM reached WHERE NOT is_transferred GROUP BY 1, 2) r WHERE (r.store_id, r.date) IN (SELECT (store_id, date) FROM chart)",
        "reached",
        "chart",
    )
)
def j21_calendar_overlay(spark, sf_dir):
    # all events of charted days, those of working days too
    return review.calendar_overlay(replace(derived_review(spark, sf_dir), events=panel_sources(spark, sf_dir).events))


@query(with_ctes("SELECT f.id, f.date, f.store_id, f.product_id, f.type, CAST(t.transaction_count AS DOUBLE) AS transaction_count FROM flags f LEFT JOIN traffic t ON t.store_id = f.store_id AND t.date = f.date", "flags", "traffic"))
def j22_traffic_lookup(spark, sf_dir):
    flags = review.all_flags(derived_review(spark, sf_dir)).select("id", "date", "store_id", "product_id", "type")
    return review.traffic_lookup(flags, panel_sources(spark, sf_dir).traffic).withColumn("transaction_count", C("transaction_count").cast("double"))


@query(
    with_ctes(
        "SELECT true AS schema_ok, count(s.id) AS total, count(*) FILTER (WHERE s.id IS NULL) AS missing, count(*) FILTER (WHERE t.id IS NULL) AS extra, count(*) FILTER (WHERE s.id IS NOT NULL AND NOT (p25 <= p50 AND p50 <= p75 AND p75 <= p95)) AS monotonic_violations FROM (SELECT CASE WHEN (day(date) + store_id * 3 + length(product_id)) % 11 = 5 THEN id || '?' ELSE id END AS id, p25, p50, p75, p95 FROM submission JOIN test_rows USING (id)) s FULL JOIN test_rows t ON s.id = t.id",
        "submission",
        "test_rows",
    )
)
def v15_submission_check(spark, sf_dir):
    # some ids are wrong, each of them missing once and once too many
    p = panel_sources(spark, sf_dir).panel
    k = (F.dayofmonth("date") + C("store_id") * 3 + F.length("product_id")) % 11
    made = derived_submission(p).join(_test(p), "id")
    return review.submission_check(made.select(F.when(k == 5, F.concat("id", F.lit("?"))).otherwise(C("id")).alias("id"), *metrics.NAMES), _test(p))


@query(with_ctes("SELECT id, date, store_id, product_id, " + ", ".join(f"round({n}, 6) AS {n}" for n in _QS) + " FROM baseline", "baseline"))
def m1_historical_quantile(spark, sf_dir):
    p = panel_sources(spark, sf_dir).panel
    return tidy(baseline.historical_quantiles(_history(p), _test(p)).select("id", "date", "store_id", "product_id", *metrics.NAMES))


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baseline forecasts of the test days beside what was sold on them."""
    full = panel_sources(spark, sf_dir, truth=True).panel
    p = full.withColumn("sales_count", F.when(C("dataset_split") == "train", C("sales_count")))
    made = baseline.historical_quantiles(_history(p), _test(p))
    return made.join(full.filter("dataset_split = 'test'").select("id", "sales_count"), "id")


@query(with_ctes("\nUNION ALL ".join(f"SELECT CAST({q} AS DOUBLE) AS quantile, round(avg({oracle.log_pinball(q, n)}), 6) AS mean_log_pinball, count(*) AS n_rows FROM graded" for n, q in _QS.items()), "graded"))
def f13_pinball_report(spark, sf_dir):
    return tidy(metrics.loss_report(graded(spark, sf_dir)))


@query(with_ctes("SELECT round(sum(w * (" + " + ".join(oracle.log_pinball(q, n) for n, q in _QS.items()) + ")) / (4 * sum(w)), 6) AS score FROM (SELECT *, CASE WHEN is_perishable THEN 1.25 ELSE 1.0 END AS w FROM graded JOIN items USING (product_id))", "graded", "items"))
def f14_weighted_score(spark, sf_dir):
    rows = graded(spark, sf_dir).join(panel_sources(spark, sf_dir).items, "product_id")
    return tidy(metrics.weighted_score(rows.withColumn("weight", F.when(C("is_perishable"), 1.25).otherwise(1.0))))


@query(with_ctes("SELECT id, date, round(p25, 6) AS p25, round(greatest(p25, p50), 6) AS p50, round(greatest(p25, p50, p75), 6) AS p75, round(greatest(p25, p50, p75, p95), 6) AS p95 FROM submission JOIN test_rows USING (id)", "submission", "test_rows"))
def w31_running_max(spark, sf_dir):
    p = panel_sources(spark, sf_dir).panel
    rows = derived_submission(p).join(_test(p).select("id", "date"), "id")
    return tidy(metrics.running_max(rows))


def _sorted_sql() -> str:
    lists = ", ".join(f"{{'v': greatest({n}, 0), 'i': {i}}}" for i, n in enumerate(_QS))
    out = ", ".join(f"round(s[{i + 1}].v, 6) AS {n}, CAST([0.25, 0.5, 0.75, 0.95][s[{i + 1}].i + 1] AS DOUBLE) AS source_{n}" for i, n in enumerate(_QS))
    return with_ctes(f"SELECT id, date, {out} FROM (SELECT id, date, list_sort([{lists}]) AS s FROM submission JOIN test_rows USING (id))", "submission", "test_rows")


@query(_sorted_sql())
def t10_sorted_quantiles(spark, sf_dir):
    p = panel_sources(spark, sf_dir).panel
    return tidy(metrics.sorted_quantiles(derived_submission(p).join(_test(p).select("id", "date"), "id")))


LEADS = list(range(1, HORIZON + 1))


def _direct_sql() -> str:
    known = {f"sales_lag_{k}": f"lag(sales_count, {k}) OVER w" for k in (1, 7, 14, 28)}
    for n in (7, 28):
        known |= {f"sales_mean_{n}": f"avg(sales_count) OVER {oracle.past(n)}", f"sales_std_{n}": f"stddev_pop(sales_count) OVER {oracle.past(n)}"}
    known["likely_stockout_lag_1"] = "CAST(lag(is_likely_stockout) OVER w AS DOUBLE)"
    told = ", ".join(f"{c} AS {n}" for n, c in known.items())
    shifted = "\nUNION ALL ".join(f"SELECT date, store_id, product_id, sales_count, {h} AS lead, " + ", ".join(f"round(lag({n}, {h - 1}) OVER w, 6) AS {n}" for n in known) + f" FROM known {oracle.WINDOWS} QUALIFY row_number() OVER w >= {28 + h}" for h in LEADS)
    return with_ctes(f"SELECT * FROM (WITH known AS (SELECT date, store_id, product_id, sales_count, {told} FROM stock WHERE dataset_split = 'train' {oracle.WINDOWS}) {shifted})", "stock")


@query(_direct_sql())
def m9_direct_supervised(spark, sf_dir):
    return tidy(baseline.direct_supervised(_history(panel_sources(spark, sf_dir).panel), LEADS))


@query(
    with_ctes(
        "SELECT w AS \"window\", date, store_id, product_id, sales_count, CASE WHEN date > last - w * 28 - 28 THEN 'holdout' ELSE 'train' END AS part FROM history CROSS JOIN (SELECT max(date) AS last FROM history) CROSS JOIN (SELECT CAST(unnest([0, 1, 2]) AS INTEGER) AS w) WHERE date <= last - w * 28",
        "history",
    )
)
def m15_backtest_windows(spark, sf_dir):
    return baseline.backtest_windows(_history(panel_sources(spark, sf_dir).panel).drop("promotion"), 3, 28)


def _backtest_sql() -> str:
    loss = lambda n, q: f"avg(greatest({q} * (ln(1 + sales_count) - ln(1 + greatest({n}, 0))), ({q} - 1) * (ln(1 + sales_count) - ln(1 + greatest({n}, 0)))))"
    each = dict(zip(metrics.NAMES, metrics.QUANTILES, strict=True))
    told = ", ".join(f"round({loss(n, q)}, 6) AS pinball_{n}" for n, q in each.items())
    mean = f"round(({' + '.join(loss(n, q) for n, q in each.items())}) / 4, 6) AS mean_pinball"
    quantiles = ", ".join(f"quantile_cont(sales_count, {q}) AS {n}" for n, q in each.items())
    return with_ctes(
        f"""SELECT "window", count(*) AS n_rows, {told}, {mean} FROM (
  WITH dealt AS (SELECT w AS "window", h.*, date > last - w * 28 - 28 AS held FROM history h CROSS JOIN (SELECT max(date) AS last FROM history) CROSS JOIN (SELECT CAST(unnest([0, 1, 2]) AS INTEGER) AS w) WHERE date <= last - w * 28)
  SELECT * FROM dealt JOIN (SELECT "window", store_id, product_id, {quantiles} FROM dealt WHERE NOT held GROUP BY ALL) USING ("window", store_id, product_id) WHERE held
) GROUP BY "window\"""",
        "history",
    )


DATELESS.add("m15_backtest_losses")


@query(_backtest_sql())
def m15_backtest_losses(spark, sf_dir):
    return tidy(baseline.backtest_losses(_history(panel_sources(spark, sf_dir).panel)))


@query(
    with_ctes(
        "SELECT CASE WHEN date >= last - 27 THEN 'holdout' ELSE 'train' END AS part, count(*) AS n_rows, CAST(min(date) AS VARCHAR) AS first_day, CAST(max(date) AS VARCHAR) AS last_day, round(sum(sales_count), 6) AS sold FROM history CROSS JOIN (SELECT max(date) AS last FROM history) GROUP BY 1",
        "history",
    )
)
def m5_split_stats(spark, sf_dir):
    train, hold = baseline.chronological_split(_history(panel_sources(spark, sf_dir).panel), 28)
    both = train.withColumn("part", F.lit("train")).unionByName(hold.withColumn("part", F.lit("holdout")))
    return tidy(both.groupBy("part").agg(F.count("*").alias("n_rows"), F.min("date").cast("string").alias("first_day"), F.max("date").cast("string").alias("last_day"), F.sum("sales_count").alias("sold")))


_SUMMARY = "count(*) AS n_rows, count(DISTINCT (date, store_id, product_id)) AS unique_keys, count(*) FILTER (WHERE date IS NULL OR store_id IS NULL OR product_id IS NULL) AS null_keys, count(*) FILTER (WHERE id IS NULL) AS null_ids, count(*) FILTER (WHERE promotion IS NULL) AS null_promotions, CAST(min(date) AS VARCHAR) AS first_day, CAST(max(date) AS VARCHAR) AS last_day, count(*) FILTER (WHERE sales_count IS NULL OR sales_count < 0 OR isinf(sales_count) OR isnan(sales_count)) AS bad_sales"


@query(with_ctes(f"SELECT {_SUMMARY} FROM panel WHERE dataset_split = 'train'", "panel"))
def v1_panel_summary(spark, sf_dir):
    return validation.panel_summary(panel_sources(spark, sf_dir).panel.filter("dataset_split = 'train'")).withColumns({c: C(c).cast("string") for c in ("first_day", "last_day")})


@query(with_ctes("SELECT count(*) AS n_rows, count(DISTINCT store_id) AS unique_keys, count(*) FILTER (WHERE store_id IS NULL) AS null_keys FROM stores", "stores"))
def v2_dimension_summary(spark, sf_dir):
    return validation.dimension_summary(panel_sources(spark, sf_dir).stores, "store_id")


@query(with_ctes("SELECT date, store_id, product_id, count(*) AS n FROM (SELECT CAST(l_shipdate AS DATE) AS date, n_regionkey AS store_id, p_type AS product_id FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey) GROUP BY 1, 2, 3 HAVING count(*) > 1", "span").replace("MATERIALIZED", ""))
def a16_duplicate_keys(spark, sf_dir):
    return validation.duplicate_keys(panel_queries.sale_lines(spark, sf_dir), ["date", "store_id", "product_id"])


@query(with_ctes("SELECT count(*) AS n_rows, (SELECT count(*) FROM days) AS n_days, (SELECT count(*) FROM (SELECT DISTINCT store_id, product_id FROM panel)) AS n_series, count(*) = (SELECT count(*) FROM days) * (SELECT count(*) FROM (SELECT DISTINCT store_id, product_id FROM panel)) AS complete FROM panel", "panel"))
def u7_panel_completeness(spark, sf_dir):
    return validation.completeness(panel_sources(spark, sf_dir).panel)


@query(with_ctes("SELECT count(DISTINCT date) AS horizon FROM test_rows", "test_rows"))
def a17_horizon_days(spark, sf_dir):
    return _test(panel_sources(spark, sf_dir).panel).agg(F.count_distinct("date").alias("horizon"))


_AUDIT = """SELECT count(*) AS n_rows, count(DISTINCT (date, store_id, product_id)) AS unique_keys, count(*) FILTER (WHERE dataset_split = 'train') AS train_rows, count(*) FILTER (WHERE dataset_split = 'test') AS test_rows,
  count(*) FILTER (WHERE product_family IS NOT NULL) AS matched_products, count(*) FILTER (WHERE city IS NOT NULL) AS matched_stores, count(*) FILTER (WHERE oil_price IS NULL) AS null_oil, count(*) FILTER (WHERE traffic_source_missing IS NULL) AS missing_traffic,
  count(*) FILTER (WHERE sales_count IS NULL AND dataset_split = 'train') AS null_train_sales, count(*) FILTER (WHERE sales_count IS NOT NULL AND dataset_split = 'test') AS known_test_sales, CAST(min(date) AS VARCHAR) AS first_day, CAST(max(date) AS VARCHAR) AS last_day FROM enriched"""


@query(with_ctes(_AUDIT, "enriched"))
def v7_final_audit(spark, sf_dir):
    from ..operators.dataset import enrich

    return validation.audit(enrich(panel_sources(spark, sf_dir))).withColumns({c: C(c).cast("string") for c in ("first_day", "last_day")})


@query(with_ctes("SELECT count(*) AS n_rows, 0 AS misplaced FROM test_rows", "test_rows").replace("0 AS misplaced", "CAST(0 AS BIGINT) AS misplaced"))
def j16_ordered_ids(spark, sf_dir):
    p = panel_sources(spark, sf_dir).panel
    return validation.ordered_equality(validation.positions(derived_submission(p).select("id"), ["id"]), validation.positions(_test(p).select("id"), ["id"]))


@query(with_ctes("SELECT date, event_type, scope, location, CAST(is_transferred AS INTEGER) AS transferred, 'unmatched' AS state FROM event e WHERE NOT EXISTS (SELECT 1 FROM reached r WHERE r.event_id = e.event_id)", "event", "reached"))
def j7_unmatched_state(spark, sf_dir):
    s = panel_sources(spark, sf_dir)
    return unmatched_events(s.events, s.stores).select("date", "event_type", "scope", "location", C("is_transferred").cast("int").alias("transferred"), F.lit("unmatched").alias("state"))
