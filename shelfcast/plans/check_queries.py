"""Queries of sources, sinks, checks and display values, with their SQL.

A check raises, so its query runs it on whole tables as they are and on copies with
faults put in by a fixed rule, and returns what it said of each; the SQL counts the
faults by itself. A sink's query returns what is read back from the file written.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics
from ..operators import baseline, dataset, features, forecaster, review, shap, validation
from ..operators.joins import unique_by
from ..sources import files
from ..sources.adapter import panel_sources
from ..sources.schemas import SOURCES
from ..sources.shared import shared_folder, written
from .model_queries import _BUCKETS, _ROWS, derived_contributions
from . import oracle
from .oracle import _QS, with_ctes
from .panel_queries import DATELESS, query, tidy
from .review_queries import FLAG, _history, _test, derived_review, derived_submission

C = F.col
DATELESS |= {
    "s2_source_folder", "s6_parquet_sink", "s10_shap_sink", "s15_exceptions_export", "s16_shap_csv", "f21_csv_cells", "f22_axis_maximum", "f25_signed_segments", "j23_shap_lookup", "a15_facet_values", "a25_one_transform",
    "v3_context_check", "v5_oil_check", "v6_traffic_check", "v9_split_check", "v10_forecast_panel_check", "v12_submission_check", "v14_bucket_cover", "c7_context_names",
}


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/tables/{name}-{uuid.uuid4().hex}"


def _csv(df: DataFrame, path: str) -> str:
    df.write.option("header", True).option("escape", '"').csv(path)
    return path


# ---- sources and sinks


@query(with_ctes("SELECT date, event_type, scope, location, is_transferred FROM event", "event"))
def s1_csv_scan(spark, sf_dir):
    path = _csv(panel_sources(spark, sf_dir).events, _path(spark, "events.csv"))
    return files.scan_csv(spark, path, SOURCES["events"])


_FOLDER = {
    "history": ("history", 6), "test": ("test_rows", 5), "items": ("items", 4), "stores": ("stores", 5), "events": ("event", 5), "oil": ("oil", 2), "traffic": ("traffic", 3), "sample": ("test_rows", 5),
}


@query(with_ctes("\nUNION ALL ".join(f"SELECT '{k}' AS source, count(*) AS n_rows, CAST({n} AS BIGINT) AS n_columns FROM {t}" for k, (t, n) in _FOLDER.items()), *{t for t, _ in _FOLDER.values()}))
def s2_source_folder(spark, sf_dir):
    """All files of a folder, traffic and the sample among them, as ``scan_sources`` finds them."""
    s, folder = panel_sources(spark, sf_dir), _path(spark, "sources")
    panel = written(s.panel, "panel")
    number = F.length("product_id")
    id_ = F.datediff("date", F.lit("1990-01-01").cast("date")).cast("long") * 1000 + C("store_id") * 100 + number
    history = panel.filter("dataset_split = 'train'").select(id_.alias("id"), "date", "store_id", number.alias("product_id"), "sales_count", "promotion")
    test = panel.filter("dataset_split = 'test'").select(id_.alias("id"), "date", "store_id", number.alias("product_id"), "promotion")
    items = s.items.select(number.alias("product_id"), "product_family", "product_class", C("is_perishable").cast("byte").alias("is_perishable"))
    tables = {"history": history, "test": test, "items": items, "stores": s.stores, "events": s.events, "oil": s.oil}
    for k, df in tables.items():
        _csv(df, f"{folder}/{files.FILES[k]}")
    _csv(s.traffic, f"{folder}/context/{files.TRAFFIC}")
    _csv(test.select("id", *[F.lit(0.0).alias(f"sales_count_{n}") for n in metrics.NAMES]), f"{folder}/sample_submission.csv")
    found = files.scan_sources(spark, folder, f"{folder}/context")
    counts = [df.agg(F.lit(k).alias("source"), F.count("*").alias("n_rows"), F.lit(len(df.columns)).cast("long").alias("n_columns")) for k, df in found.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query(with_ctes("SELECT count(*) AS n_rows, CAST(min(date) AS VARCHAR) AS first_day, CAST(max(date) AS VARCHAR) AS last_day FROM traffic", "traffic"))
def s6_parquet_sink(spark, sf_dir):
    """What the sink verified of the file that it wrote."""
    got = files.write_parquet(panel_sources(spark, sf_dir).traffic, _path(spark, "traffic"))
    return spark.createDataFrame([(got["n_rows"], str(got["first_day"]), str(got["last_day"]))], "n_rows long, first_day string, last_day string")


@query(with_ctes("SELECT date, CAST(transaction_count AS INTEGER) AS transaction_count FROM traffic", "traffic"))
def s8_projected_csv(spark, sf_dir):
    """Two of three columns; the scan parses no other."""
    path = _csv(panel_sources(spark, sf_dir).traffic, _path(spark, "traffic.csv"))
    return files.scan_csv(spark, path, SOURCES["traffic"]).select("date", "transaction_count")


@query(with_ctes(f"SELECT quantile, count(*) AS n_rows, count(DISTINCT id) AS n_ids, round(sum(d / 10.0), 6) AS base FROM ({_ROWS}) GROUP BY 1", "test_rows"))
def s10_shap_sink(spark, sf_dir):
    path = _path(spark, "sidecar")
    files.write_shap(derived_contributions(spark, sf_dir), path)
    return tidy(spark.read.parquet(path).groupBy("quantile").agg(F.count("*").alias("n_rows"), F.count_distinct("id").alias("n_ids"), F.sum("base_value").alias("base")))


_ACTION = "CASE type " + " ".join(f"WHEN '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in review.ACTION.items()) + " END"


@query(with_ctes(f"SELECT id, CAST(store_id AS VARCHAR) AS store_id, product_id, CAST(date AS VARCHAR) AS day, CAST(promotion AS VARCHAR) AS promotion, type AS flag, severity, {_ACTION} AS action FROM flags", "flags"))
def s15_exceptions_export(spark, sf_dir):
    """The exported list read back; every cell is quoted text."""
    path = _path(spark, "exceptions")
    files.write_exceptions(review.exported(review.all_flags(derived_review(spark, sf_dir))), path)
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    return back.withColumnRenamed("date", "day").drop("detail")


@query(with_ctes(f"SELECT id, quantile, round(exp(d / 10.0) - 1, 2) AS base_units, {_BUCKETS} FROM ({_ROWS})", "test_rows"))
def s16_shap_csv(spark, sf_dir):
    """Buckets as CSV, and back: contributions are found by their prefix."""
    path = _path(spark, "buckets")
    files.write_display(shap.buckets(derived_contributions(spark, sf_dir), ["id"]), path)
    return files.read_shap_csv(spark, path)


# ---- display values


@query("SELECT CAST(o_orderdate AS DATE) AS date, o_orderkey FROM orders")
def f1_strict_days(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("raw")).select(files.parse_date("raw").alias("date"), "o_orderkey")


def _f(x: str, places: int = 2) -> str:
    """A number as text, halves away from zero."""
    return f"printf('%.{places}f', sign({x}) * floor(abs({x}) * {10**places} + 0.5) / {10**places})"


_DETAIL = {
    "monotonicity": "'not ascending: ' || " + " || ', ' || ".join(_f(n) for n in _QS),
    "perishable_spike": f"'typical ' || {_f('p50')} || ', worst case ' || {_f('p95')}",
    "promo_no_lift": f"'promoted ' || {_f('p50')} || ', normal ' || {_f('non_promo_avg', 1)}",
    "holiday_flat": f"'holiday ' || {_f('p50')} || ', normal ' || {_f('non_holiday_avg', 1)}",
    "essential_low": f"'zero, worst case ' || {_f('p95')}",
    "zero_forecast": f"'zero, worst case ' || {_f('p95')}",
    "wide_spread": f"'from ' || {_f('p25')} || ' to ' || {_f('p95')}",
    "baseline_deviation": f"'baseline ' || {_f('b50')} || ', apart ' || CAST(CAST(floor(abs(p50 - b50) / greatest(b50, 1) * 100 + 0.5) AS BIGINT) AS VARCHAR) || '%'",
}
_SAID = "CASE f.type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _DETAIL.items()) + " ELSE 'promoted on ' || CAST(f.date AS VARCHAR) || ', none sold' END"


@query(with_ctes(f"SELECT f.id, f.store_id, f.product_id, f.date, f.type, {_SAID} AS detail FROM flags f LEFT JOIN rows_ r ON r.id = f.id", "flags", "rows_"))
def f20_flag_detail(spark, sf_dir):
    return review.all_flags(derived_review(spark, sf_dir)).select("id", "store_id", "product_id", "date", "type", "detail")


@query("SELECT page_id, md5('\"' || replace(coalesce(html, ''), '\"', '\"\"') || '\"') AS cell FROM pages")
def f21_csv_cells(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.md5(metrics.csv_cell(C("html"))).alias("cell"))


_NICE = "SELECT store_id, product_id, CASE WHEN m <= 0 THEN 1.0 WHEN m <= p THEN p WHEN m <= 2 * p THEN 2 * p WHEN m <= 5 * p THEN 5 * p ELSE 10 * p END AS axis FROM (SELECT *, CASE WHEN m > 0 THEN pow(10.0, floor(log10(m))) END AS p FROM (SELECT store_id, product_id, max(p95) AS m FROM submission JOIN test_rows USING (id) GROUP BY 1, 2))"


@query(with_ctes(_NICE, "submission", "test_rows"))
def f22_axis_maximum(spark, sf_dir):
    panel = panel_sources(spark, sf_dir).panel
    tops = derived_submission(panel).join(_test(panel), "id").groupBy("store_id", "product_id").agg(F.max("p95").alias("m"))
    return tidy(tops.select("store_id", "product_id", metrics.nice_maximum(C("m")).alias("axis")))


@query(with_ctes("SELECT date, strftime(date, '%b %-d') AS label, CAST(floor(oil_price / 1000 + 0.5) AS BIGINT) AS thousands FROM oil", "oil"))
def f23_date_labels(spark, sf_dir):
    return panel_sources(spark, sf_dir).oil.select("date", metrics.date_label(C("date")).alias("label"), metrics.round_half_up(C("oil_price") / 1000).cast("long").alias("thousands"))


_SEGMENTS = "\nUNION ALL ".join(f"SELECT id, quantile, {i} AS i, '{b}' AS factor, contrib_{b} AS v FROM b" for i, b in enumerate(shap.BUCKETS))
_BEFORE = "(PARTITION BY id, quantile ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query(
    with_ctes(
        f"SELECT id, quantile, factor, round(start, 6) AS start, round(start + v, 6) AS stop FROM (SELECT *, coalesce(CASE WHEN v >= 0 THEN sum(greatest(v, 0)) OVER {_BEFORE} ELSE sum(least(v, 0)) OVER {_BEFORE} END, 0) AS start FROM (WITH b AS (SELECT id, quantile, {_BUCKETS} FROM ({_ROWS})) {_SEGMENTS}))",
        "test_rows",
    )
)
def f25_signed_segments(spark, sf_dir):
    return tidy(shap.signed_segments(shap.buckets(derived_contributions(spark, sf_dir), ["id"]), ["id"]))


# ---- selections and lookups


@query(with_ctes(f"SELECT {FLAG}, count(*) OVER () AS total FROM flags WHERE type = 'wide_spread' AND NOT promotion AND date >= DATE '2001-10-12' AND date <= DATE '2001-10-30' ORDER BY date, store_id, product_id LIMIT 300", "flags"))
def p19_exception_filter(spark, sf_dir):
    flags = review.all_flags(derived_review(spark, sf_dir))
    return review.exception_page(flags, kind="wide_spread", promotion=False, start="2001-10-12", end="2001-10-30").drop("detail")


_WORLD = "SELECT " + ", ".join(f"s[CAST(floor((len(s) - 1) * {q} + 0.5) AS INTEGER) + 1] AS {n}" for n, q in _QS.items()) + " FROM (SELECT list_sort(list(sales_count)) AS s FROM history WHERE store_id <> 0)"


@query(
    with_ctes(
        "SELECT t.id, t.date, "
        + ", ".join(f"round(CASE WHEN t.store_id = 0 THEN g.{n} ELSE b.{n} END, 6) AS {n}" for n in _QS)
        + f" FROM test_rows t JOIN baseline b ON b.id = t.id CROSS JOIN ({_WORLD}) g",
        "test_rows",
        "baseline",
        "history",
    )
)
def a12_global_quantile(spark, sf_dir):
    """One store has no past, so its series get the quantiles of all others' sales."""
    panel = panel_sources(spark, sf_dir).panel
    return tidy(baseline.historical_quantiles(_history(panel).filter("store_id <> 0"), _test(panel)).select("id", "date", *metrics.NAMES))


@query(with_ctes("SELECT 'city' AS facet, city AS value FROM stores UNION SELECT 'family', product_family FROM items UNION SELECT 'scope', scope FROM event", "stores", "items", "event"))
def a15_facet_values(spark, sf_dir):
    s = panel_sources(spark, sf_dir)
    parts = [df.select(F.lit(n).alias("facet"), C(c).alias("value")).distinct() for n, df, c in (("city", s.stores, "city"), ("family", s.items, "product_family"), ("scope", s.events, "scope"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).orderBy("facet", "value")


@query(
    with_ctes(
        f"SELECT p.id, CAST(0.5 AS DOUBLE) AS quantile, b.* EXCLUDE (id, quantile) FROM (SELECT id || CASE WHEN store_id = 1 THEN '?' ELSE '' END AS id FROM test_rows) p LEFT JOIN (SELECT id, quantile, round(exp(d / 10.0) - 1, 2) AS base_units, {_BUCKETS} FROM ({_ROWS})) b ON b.id = p.id AND b.quantile = 0.5",
        "test_rows",
    )
)
def j23_shap_lookup(spark, sf_dir):
    """Points of one store have no explanation."""
    ids = _test(panel_sources(spark, sf_dir).panel).select(F.concat("id", F.when(C("store_id") == 1, "?").otherwise("")).alias("id"), F.lit(0.5).alias("quantile"))
    return shap.lookup(ids, shap.buckets(derived_contributions(spark, sf_dir), ["id"]))


@query(with_ctes("SELECT t.id, t.date, CAST(v.transaction_count AS DOUBLE) AS transaction_count FROM test_rows t LEFT JOIN traffic v ON v.date = t.date AND v.store_id = t.store_id", "test_rows", "traffic"))
def j24_checked_join(spark, sf_dir):
    s = panel_sources(spark, sf_dir)
    right = unique_by(s.traffic, ["date", "store_id"], "traffic")
    return _test(s.panel).join(right, ["date", "store_id"], "left").select("id", "date", C("transaction_count").cast("double").alias("transaction_count"))


# ---- checks


def _said(check: Callable[..., object], *args: object) -> str:
    try:
        got = check(*args)
    except ValueError as e:
        return str(e)
    return got if isinstance(got, str) else "ok"


def _verdicts(spark: SparkSession, rows: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(rows.items()), "input string, verdict string")


def _verdict_sql(rows: dict[str, str], *ctes: str) -> str:
    select = "\nUNION ALL ".join(f"SELECT '{k}' AS input, {v} AS verdict" for k, v in rows.items())
    return with_ctes(select, *ctes) if ctes else select


def _n(table: str, where: str) -> str:
    return f"(SELECT count(*) FROM {table} WHERE {where})"


@query(
    _verdict_sql(
        {
            "whole": "'ok'",
            "nulls": f"'items has ' || {_n('items', 'product_family = ' + chr(39) + 'S' + chr(39))} || ' rows with nulls'",
            "perishable": f"'items has ' || {_n('items', 'product_family = ' + chr(39) + 'S' + chr(39))} || ' rows whose is_perishable is neither 0 nor 1'",
            "event nulls": f"'events has ' || {_n('event', 'day(date) = 3')} || ' rows with nulls'",
            "scopes": f"'events has an unknown scope in ' || {_n('event', 'scope = ' + chr(39) + 'Local' + chr(39))} || ' rows'",
        },
        "items",
        "event",
    )
)
def v3_context_check(spark, sf_dir):
    s = panel_sources(spark, sf_dir)
    is_s = C("product_family") == "S"
    cases = {
        "whole": (s.items, s.events),
        "nulls": (s.items.withColumn("product_class", F.when(~is_s, C("product_class"))), s.events),
        "perishable": (s.items.withColumn("is_perishable", F.when(is_s, 2).otherwise(C("is_perishable").cast("int"))), s.events),
        "event nulls": (s.items, s.events.withColumn("location", F.when(F.dayofmonth("date") != 3, C("location")))),
        "scopes": (s.items, s.events.withColumn("scope", F.when(C("scope") == "Local", "Village").otherwise(C("scope")))),
    }
    return _verdicts(spark, {k: _said(validation.validate_context, *v) for k, v in cases.items()})


@query(_verdict_sql({"whole": "'ok'", "twice": "'oil has duplicate or null dates'", "negative": f"'oil has ' || {_n('oil', 'day(date) = 3')} || ' prices that are not positive'"}, "oil"))
def v5_oil_check(spark, sf_dir):
    oil = written(panel_sources(spark, sf_dir).oil, "oil")
    negative = oil.withColumn("oil_price", F.when(F.dayofmonth("date") == 3, -C("oil_price")).otherwise(C("oil_price")))
    return _verdicts(spark, {k: _said(validation.validate_oil, v) for k, v in {"whole": oil, "twice": oil.unionByName(oil), "negative": negative}.items()})


@query(
    _verdict_sql(
        {
            "whole": "'ok'",
            "twice": "'traffic has duplicate date and store rows'",
            "faults": f"'traffic has ' || {_n('traffic', 'day(date) = 3')} || ' rows with nulls and ' || {_n('traffic', 'day(date) = 4')} || ' negative counts'",
        },
        "traffic",
    )
)
def v6_traffic_check(spark, sf_dir):
    t = written(panel_sources(spark, sf_dir).traffic, "traffic")
    day, n = F.dayofmonth("date"), C("transaction_count")
    faults = t.withColumn("transaction_count", F.when(day == 4, -n).when(day != 3, n))
    return _verdicts(spark, {k: _said(validation.validate_traffic, v) for k, v in {"whole": t, "twice": t.unionByName(t), "faults": faults}.items()})


@query(
    _verdict_sql(
        {"28": f"{_n('history', 'date <= (SELECT max(date) FROM history) - 28')} || ' and ' || {_n('history', 'date > (SELECT max(date) FROM history) - 28')}", "0": "'holdout has one day at least'"},
        "history",
    )
)
def v9_split_check(spark, sf_dir):
    history = _history(panel_sources(spark, sf_dir).panel)

    def sizes(days: int) -> str:
        train, hold = baseline.chronological_split(history, days)
        return f"{train.count()} and {hold.count()}"

    return _verdicts(spark, {str(k): _said(sizes, k) for k in (28, 0)})


@query(
    _verdict_sql(
        {
            "whole": "'ok'",
            "holes": "'the panel does not hold every day of every series'",
            "negative": f"{_n('history', 'store_id = 1 AND sales_count > 0')} || ' sales are negative'",
            "nulls": f"{_n('history', 'store_id = 2')} || ' rows lack a context value'",
        },
        "history",
    )
)
def v10_forecast_panel_check(spark, sf_dir):
    p = written(_history(panel_sources(spark, sf_dir).panel), "history")
    cases = {
        "whole": p,
        "holes": p.filter(~((C("store_id") == 0) & (F.dayofmonth("date") == 3))),
        "negative": p.withColumn("sales_count", F.when(C("store_id") == 1, -C("sales_count")).otherwise(C("sales_count"))),
        "nulls": p.withColumn("promotion", F.when(C("store_id") != 2, C("promotion"))),
    }
    return _verdicts(spark, {k: _said(validation.validate_forecast_panel, v, ["promotion"]) for k, v in cases.items()})


@query(
    _verdict_sql(
        {
            "whole": "'ok'",
            "crossing": f"'submission: monotonic_violations is ' || {_n('submission', 'NOT (p25 <= p50 AND p50 <= p75 AND p75 <= p95)')} || ', not 0'",
            "missing": f"'submission: missing is ' || {_n('test_rows', 'store_id = 3')} || ', not 0'",
            "nulls": f"'submission has ' || {_n('test_rows', 'store_id = 3')} || ' rows without all quantiles and ' || (SELECT count(*) FROM test_rows) || ' rows'",
        },
        "submission",
        "test_rows",
    )
)
def v12_submission_check(spark, sf_dir):
    panel = written(panel_sources(spark, sf_dir).panel, "panel")
    test = _test(panel)
    made = test.join(baseline.trailing_quantiles(_history(panel)), ["store_id", "product_id"])
    third = C("store_id") == 3
    cases = {
        "whole": made,
        "crossing": derived_submission(panel),
        "missing": made.filter(~third),
        "nulls": made.withColumn("p95", F.when(~third, C("p95"))),
    }
    return _verdicts(spark, {k: _said(validation.validate_submission, v.select("id", *metrics.NAMES), test) for k, v in cases.items()})


_LOST = shap.BUCKETS["oil_price"][0]


@query(_verdict_sql({"whole": f"(SELECT count(*) || ' rows covered' FROM ({_ROWS}))", "lost": f"'no contribution for {_LOST}'", "unknown": "'no bucket for moon'"}, "test_rows"))
def v14_bucket_cover(spark, sf_dir):
    """All contributions of every row are in its buckets; a contribution too few or too many is told."""
    told = written(derived_contributions(spark, sf_dir), "contributions")

    def covered(rows: DataFrame) -> str:
        summed = shap.buckets(rows, ["id", shap.total(shap.contributions(rows)).alias("_all")], 9)
        apart = F.abs(sum(C(f"contrib_{b}") for b in shap.BUCKETS) - C("_all")) > 1e-6
        n = summed.agg(F.count_if(~apart).alias("n"), F.count_if(F.coalesce(apart, F.lit(True))).alias("off")).first()
        if n.off:
            raise ValueError(f"{n.off} rows whose buckets miss contributions")
        return f"{n.n} rows covered"

    cases = {"whole": told, "lost": told.drop(f"shap_{_LOST}"), "unknown": told.withColumn("shap_moon", F.lit(0.0))}
    return _verdicts(spark, {k: _said(covered, v) for k, v in cases.items()})


@query(_verdict_sql({"one": "'log1p'", "two": "'target_transform is not one value: [''log1p'', ''none'']'", "unknown": "'unknown target_transform ''sqrt'''"}))
def a25_one_transform(spark, sf_dir):
    told = derived_contributions(spark, sf_dir).select("id", "quantile")
    kinds = {"one": F.lit("log1p"), "two": F.when(C("quantile") < 0.9, "log1p").otherwise("none"), "unknown": F.lit("sqrt")}
    return _verdicts(spark, {k: _said(shap.transform_of, told.withColumn("target_transform", v)) for k, v in kinds.items()})


@query(oracle.feature_sql("payday", "identity"))
def c6_group_names(spark, sf_dir):
    """Features of the groups that a list of names asks for, each once, of every training row."""
    groups = features.parse_groups("payday, identity,payday")
    train = dataset.panel_for(panel_sources(spark, sf_dir), groups).filter("dataset_split = 'train'")
    return tidy(features.features(train, groups, ["date", "store_id", "product_id"]))


_ASKED = [c for g in ("promotion", "store", "calendar", "event", "oil") for c in forecaster.CONTEXT[g]]


@query(with_ctes("\nUNION ALL ".join(f"SELECT '{c}' AS name, {k} AS place, count(*) AS n_rows, count({c}) AS n_known FROM merged" for k, c in enumerate(_ASKED)), "merged"))
def c7_context_names(spark, sf_dir):
    """Columns of the context groups that a list of names asks for, in the groups' own order, with
    the rows of the merged panel that know them."""
    groups = forecaster.parse_context("oil, event,calendar,sales,store,promotion")
    columns = [c for g in groups for c in forecaster.CONTEXT[g]]
    merged = dataset.merged_panel(panel_sources(spark, sf_dir))
    known = merged.agg(F.count("*").alias("n"), *[F.count(c).alias(c) for c in columns])
    told = F.array(*[F.struct(F.lit(c).alias("name"), F.lit(k).alias("place"), C("n").alias("n_rows"), C(c).alias("n_known")) for k, c in enumerate(columns)])
    return known.select(F.explode(told).alias("x")).select("x.*")
