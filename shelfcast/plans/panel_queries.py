"""Queries over the derived panel and the SQL that states their rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import context, dataset, features, stockout
from ..sources.adapter import panel_sources
from ..sources.schemas import MERGED
from . import oracle
from .oracle import with_ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        register(f.__name__, f, sql)
        return f

    return add


def register(name: str, f: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    """Days leave a query as ISO text, so both engines print them alike."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = f(spark, sf_dir)
        return out.withColumns({n: F.col(n).cast("string") for n, t in out.dtypes if t == "date"})

    QUERIES[name] = run
    if sql:
        SQL[name] = sql if name in DATELESS else f"SELECT * REPLACE (CAST(date AS VARCHAR) AS date) FROM (\n{sql}\n)"


def sale_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the single sales behind the dense panel."""
    line, part, supplier, nation = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "part", "supplier", "nation"))
    return (
        line.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(F.col("l_shipdate").cast("date").alias("date"), F.col("n_regionkey").alias("store_id"), F.col("p_type").alias("product_id"))
    )


#: Queries whose rows have no date.
DATELESS = {"w29_stockout_last_day"}


#: Whole numbers that can be null leave as doubles: engines print those alike.
NULLABLE = {"transaction_count", "traffic_lag_1", "feature_traffic_lag_1", "feature_zero_run_3", "feature_promotion_count_7", "feature_promotion_count_28", "likely_stockout_lag_1"}


def tidy(df: DataFrame) -> DataFrame:
    """Computed numbers to six places, flags as integers, lists as text."""
    out = []
    for n, t in df.dtypes:
        c = F.col(n)
        out.append((F.round(c, 3 if n.startswith("feature_oil_mean") else 6) if t in ("double", "float") else c.cast("double") if n in NULLABLE else c.cast("int") if t in ("tinyint", "smallint") else F.array_join(c, ",") if t.startswith("array<string") else c).alias(n))
    return df.select(out)


def _parts(select: str = "*", *names: str) -> str:
    return with_ctes(f"SELECT {select} FROM {names[0]}", *names)


PANEL = "date, store_id, product_id, id, dataset_split, round(sales_count, 6) AS sales_count, promotion"


@query(_parts(PANEL, "panel"))
def src_panel_dense(spark, sf_dir):
    return tidy(panel_sources(spark, sf_dir).panel)


@query(_parts(PANEL, "panel_sparse"))
def src_panel_sparse(spark, sf_dir):
    return tidy(panel_sources(spark, sf_dir, "sparse").panel)


@query(_parts(PANEL, "panel"))
def u1_train_test_union(spark, sf_dir):
    p = panel_sources(spark, sf_dir).panel
    both = dataset.union_splits(p.filter("dataset_split = 'train'").drop("dataset_split"), p.filter("dataset_split = 'test'").drop("dataset_split", "sales_count"))
    return tidy(both.select(p.columns))


@query(with_ctes("SELECT date, store_id FROM days CROSS JOIN stores", "days", "stores"))
def f5_calendar_grid(spark, sf_dir):
    s = panel_sources(spark, sf_dir)
    return context.calendar(s.span).crossJoin(F.broadcast(s.stores.select("store_id")))


@query(
    with_ctes(
        "SELECT date, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, CAST(day(date) AS INTEGER) AS day, CAST(isodow(date) AS INTEGER) AS day_of_week, CAST(week(date) AS INTEGER) AS week_of_year, isodow(date) >= 6 AS is_weekend FROM days",
        "days",
    )
)
def f2_calendar_parts(spark, sf_dir):
    return context.calendar(panel_sources(spark, sf_dir).span).withColumns(context.calendar_parts(F.col("date")))


@query(_parts("date, round(oil_price, 6) AS oil_price, oil_price_source_missing", "oil_ctx"))
def w24_oil_ffill(spark, sf_dir):
    s = panel_sources(spark, sf_dir)
    return tidy(context.oil_context(s.oil, s.span))


@query(_parts("date, store_id, CAST(transaction_count AS DOUBLE) AS transaction_count, traffic_source_missing, CAST(traffic_lag_1 AS DOUBLE) AS traffic_lag_1, round(traffic_mean_7, 6) AS traffic_mean_7, round(traffic_mean_28, 6) AS traffic_mean_28, round(traffic_ratio_7_28, 6) AS traffic_ratio_7_28", "traffic_ctx"))
def w25_traffic_context(spark, sf_dir):
    s = panel_sources(spark, sf_dir)
    return tidy(context.traffic_context(s.traffic, s.stores, s.span))


@query(_parts("store_id, date, event_type, scope, location, is_transferred", "reached"))
def j6_event_scope_join(spark, sf_dir):
    s = panel_sources(spark, sf_dir)
    return context.expand_events(s.events, s.stores)


@query(
    with_ctes(
        "SELECT date, event_type, scope, location, is_transferred FROM event e WHERE NOT EXISTS (SELECT 1 FROM stores s WHERE e.scope = 'National' OR (e.scope = 'Regional' AND e.location = s.department) OR (e.scope = 'Local' AND e.location = s.city))",
        "event",
        "stores",
    )
)
def j7_unmatched_events(spark, sf_dir):
    s = panel_sources(spark, sf_dir)
    return context.unmatched_events(s.events, s.stores)


LISTS = "array_to_string(event_types, ',') AS event_types, array_to_string(event_scopes, ',') AS event_scopes, array_to_string(event_locations, ',') AS event_locations"


@query(_parts(f"* EXCLUDE (event_types, event_scopes, event_locations), {LISTS}", "rollup_"))
def a6_event_rollup(spark, sf_dir):
    s = panel_sources(spark, sf_dir)
    return tidy(context.event_rollup(s.events, s.stores))


@query(_parts("*", "distances"))
def j9_holiday_distance(spark, sf_dir):
    s = panel_sources(spark, sf_dir)
    return context.holiday_distances(s.events, s.stores, s.span)


@query(_parts(f"* EXCLUDE (event_types, event_scopes, event_locations), {LISTS}", "event_ctx"))
def p5_event_defaults(spark, sf_dir):
    s = panel_sources(spark, sf_dir)
    return tidy(context.event_context(s.events, s.stores, s.span))


_MERGED = ", ".join(f"round({c}, 6) AS {c}" if c in ("sales_count", "oil_price", "traffic_mean_7", "traffic_mean_28", "traffic_ratio_7_28") else f"CAST({c} AS DOUBLE) AS {c}" if c in NULLABLE else f"CAST({c} AS VARCHAR) AS {c}" if c == "is_likely_stockout" else f"array_to_string({c}, ',') AS {c}" if c.startswith("event_") and c != "event_count" else c for c in MERGED)


@query(_parts(_MERGED.replace("CAST(is_likely_stockout AS VARCHAR) AS is_likely_stockout, ", ""), "enriched"))
def j1_star_enrich(spark, sf_dir):
    return tidy(dataset.enrich(panel_sources(spark, sf_dir)).select([c for c in MERGED if c != "is_likely_stockout"]))


@query(_parts(_MERGED, "merged"))
def stage1_merged_panel(spark, sf_dir):
    return tidy(dataset.merged_panel(panel_sources(spark, sf_dir))).withColumn("is_likely_stockout", F.col("is_likely_stockout").cast("string"))


@query(_parts("date, store_id, product_id, CAST(is_likely_stockout AS VARCHAR) AS is_likely_stockout", "stock"))
def w28_stockout(spark, sf_dir):
    return stockout.add_stockout_flag(panel_sources(spark, sf_dir).panel).select("date", "store_id", "product_id", F.col("is_likely_stockout").cast("string").alias("is_likely_stockout"))


@query(
    with_ctes(
        "SELECT store_id, product_id, is_likely_stockout FROM stock WHERE dataset_split = 'train' QUALIFY row_number() OVER (PARTITION BY store_id, product_id ORDER BY date DESC) = 1",
        "stock",
    )
)
def w29_stockout_last_day(spark, sf_dir):
    return stockout.likely_stockout_for_last_day(panel_sources(spark, sf_dir).panel.filter("dataset_split = 'train'"))


def _feature_query(group: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        train = dataset.panel_for(panel_sources(spark, sf_dir), (group,)).filter("dataset_split = 'train'")
        return tidy(features.features(train, (group,), ["date", "store_id", "product_id"]))

    register(f"fg_{group}", run, oracle.feature_sql(group))


for _g in oracle.FEATURES:
    _feature_query(_g)


def _level_sql() -> str:
    parts, joins = [], []
    for level, keys in features.LEVELS.items():
        k = ", ".join(keys)
        parts.append(
            f"{level}_means AS (SELECT date, {k}, avg(m) OVER (PARTITION BY {k} ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS m7, avg(m) OVER (PARTITION BY {k} ORDER BY date ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING) AS m28 FROM (SELECT date, {k}, avg(sales_count) AS m FROM train GROUP BY ALL))"
        )
        joins.append(f"LEFT JOIN {level}_means ON " + " AND ".join(f"{level}_means.{c} = t.{c}" for c in ["date", *keys]))
    head = with_ctes("", "train").rstrip()
    columns = ", ".join(f"round({level}_means.m{n}, 6) AS feature_{level}_mean_{n}" for level in features.LEVELS for n in (7, 28))
    return f"{head},\n" + ",\n".join(parts) + f"\nSELECT t.date, t.store_id, t.product_id, {columns} FROM train t " + " ".join(joins)


@query(_level_sql())
def fg_hierarchy(spark, sf_dir):
    train = dataset.panel_for(panel_sources(spark, sf_dir), ("hierarchy",)).filter("dataset_split = 'train'")
    return tidy(features.features(train, ("hierarchy",), ["date", "store_id", "product_id"]))


@query(
    with_ctes(
        "SELECT date, store_id, product_id, "
        + ", ".join(f"round(lag(sales_count, {k}) OVER w, 6) AS sales_lag_{k}" for k in (1, 7, 14, 28))
        + ", "
        + ", ".join(f"round(avg(sales_count) OVER {oracle.past(n)}, 6) AS sales_mean_{n}, round(stddev_pop(sales_count) OVER {oracle.past(n)}, 6) AS sales_std_{n}" for n in (7, 28))
        + f", CAST(lag(is_likely_stockout) OVER w AS DOUBLE) AS likely_stockout_lag_1 FROM stock {oracle.WINDOWS}",
        "stock",
    )
)
def fg_forecaster_sales(spark, sf_dir):
    return tidy(features.forecaster_features(stockout.add_stockout_flag(panel_sources(spark, sf_dir).panel)))
