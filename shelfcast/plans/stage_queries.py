"""Queries of whole stages: what they write is read back, and compared with SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.metrics import NAMES
from ..operators import context, features, forecaster, stockout, validation
from ..sources import files
from ..sources.adapter import panel_sources
from ..sources.schemas import KEY, SOURCES
from ..sources.shared import shared_folder, written
from . import oracle, stages
from .check_queries import _csv, _n, _said, _verdict_sql, _verdicts
from .model_queries import X, _panel
from .oracle import with_ctes
from .panel_queries import DATELESS, query, tidy
from .review_queries import _backtest_sql, _history, derived_submission

C = F.col
DATELESS |= {"s9_submission_sink", "m6_train_report", "p3_int_flags", "v8_feature_targets", "v16_context_span"}


def _path(spark, name: str) -> str:
    return f"{shared_folder(spark)}/tables/{name}-{uuid.uuid4().hex}"


_TEXT = ", ".join(f"printf('%.6f', {n}) AS sales_count_{n}" for n in NAMES)


@query(with_ctes(f"SELECT id, {_TEXT}, row_number() OVER (ORDER BY md5(id)) - 1 AS position FROM submission", "submission"))
def s9_submission_sink(spark, sf_dir):
    """A submission in the order of a sample of many files, as its lines say."""
    made = written(derived_submission(panel_sources(spark, sf_dir).panel), "submission")
    sample = _csv(made.select("id").orderBy(F.md5("id")), _path(spark, "sample.csv"))
    order = files.in_file_order(spark.read.option("header", True).csv(sample))
    out = _path(spark, "submission.csv")
    files.write_submission(made.join(order, "id").orderBy(*files.LINE), out)
    lines = files.in_file_order(spark.read.option("header", True).csv(out))
    return validation.positions(lines, files.LINE).drop(*files.LINE)


@query(with_ctes("SELECT date, store_id, product_id, row_number() OVER (ORDER BY date, product_id, store_id) - 1 AS position FROM panel", "panel"))
def t2_merged_order(spark, sf_dir):
    """Places of the merged panel's rows in its files."""
    path = _path(spark, "merged")
    stages.build_merged(panel_sources(spark, sf_dir), path)
    back = spark.read.parquet(path).select(*KEY, C("_metadata.file_name").alias("_file"), C("_metadata.row_index").alias("_row"))
    return validation.positions(back, ["_file", "_row"]).select("date", "store_id", "product_id", "position")


@query(
    with_ctes(
        "SELECT date, store_id, product_id, is_likely_stockout FROM (" + oracle._flagged("panel_truth").replace("CASE WHEN dataset_split = 'train' THEN ", "").replace(", false) END AS", ", false) AS") + ")",
        "panel_truth",
    )
)
def w30_stockout_every_row(spark, sf_dir):
    """The rule on every day, those of the test split too."""
    truth = panel_sources(spark, sf_dir, truth=True).panel
    return truth.select("date", "store_id", "product_id", stockout.likely_stockout(C("sales_count"), stockout.series_window()).alias("is_likely_stockout"))


_GROUPS = ("promotion", "sales_history")
_SINGLE = [*(f"lag(sales_count, {k}) OVER w AS feature_sales_lag_{k}" for k in (1, 7, 14, 28)), *(f"{f}(sales_count) OVER {oracle.past(n)} AS feature_sales_{m}_{n}" for n in (7, 28) for m, f in (("mean", "avg"), ("std", "stddev_samp")))]
_NAMED = [s.rsplit(" AS ", 1)[1] for s in _SINGLE]


@query(
    with_ctes(
        "SELECT date, store_id, product_id, 'float' AS width, " + ", ".join(f"round(CAST(CAST({n} AS FLOAT) AS DOUBLE), 6) AS {n}" for n in _NAMED) + f" FROM (SELECT date, store_id, product_id, dataset_split, {', '.join(_SINGLE)} FROM stock {oracle.WINDOWS}) WHERE dataset_split = 'train'",
        "stock",
    )
)
def p2_single_precision(spark, sf_dir):
    """Features of past sales in the width that models are trained on."""
    t = features.training_features(stockout.add_stockout_flag(panel_sources(spark, sf_dir).panel), _GROUPS)
    width = ",".join(sorted({dict(t.dtypes)[n] for n in _NAMED}))
    return tidy(t.select("date", "store_id", "product_id", F.lit(width).alias("width"), *[C(n).cast("double").alias(n) for n in _NAMED]))


@query(with_ctes("SELECT product_id, is_perishable FROM items", "items"))
def p3_int_flags(spark, sf_dir):
    """Flags that are 0 and 1 in a typed file."""
    items = panel_sources(spark, sf_dir).items.withColumn("is_perishable", C("is_perishable").cast("int"))
    kinds = SOURCES["items"].replace("product_id int", "product_id string")
    back = files.scan_csv(spark, _csv(items.select("product_id", "product_family", "product_class", "is_perishable"), _path(spark, "items.csv")), kinds)
    return back.select("product_id", (C("is_perishable") == 1).alias("is_perishable"))


@query(
    with_ctes(
        "SELECT date, store_id, product_id, round(sales_count, 6) AS sales_count, "
        + ", ".join(f"round(coalesce({n}, 0), 6) AS {n}" for n in [*(f"sales_lag_{k}" for k in (1, 7, 14, 28)), *(f"sales_{m}_{n}" for n in (7, 28) for m in ("mean", "std")), "likely_stockout_lag_1"])
        + ", CAST(promotion AS DOUBLE) AS promotion, CAST(isodow(date) AS DOUBLE) AS day_of_week FROM (SELECT *, row_number() OVER w AS n, "
        + ", ".join(f"lag(sales_count, {k}) OVER w AS sales_lag_{k}" for k in (1, 7, 14, 28))
        + ", "
        + ", ".join(f"avg(sales_count) OVER {oracle.past(n)} AS sales_mean_{n}, stddev_pop(sales_count) OVER {oracle.past(n)} AS sales_std_{n}" for n in (7, 28))
        + f", CAST(lag(is_likely_stockout) OVER w AS DOUBLE) AS likely_stockout_lag_1 FROM stock {oracle.WINDOWS}) WHERE n > 28 AND sales_count IS NOT NULL",
        "stock",
    )
)
def m8_supervised_rows(spark, sf_dir):
    """What the models of the next day are fitted to."""
    return tidy(forecaster.supervised(_panel(spark, sf_dir), X))


_ONE = _backtest_sql().replace("unnest([0, 1, 2])", "unnest([0])")


@query(
    with_ctes(
        f"""SELECT 'historical' AS model, 'log1p' AS target_transform, (SELECT count(*) FROM history) - n_rows AS train_rows, n_rows AS holdout_rows,
  pinball_p25, pinball_p50, pinball_p75, pinball_p95, mean_pinball AS mean_loss, (SELECT CAST(max(date) - 28 AS VARCHAR) FROM history) AS train_end, (SELECT CAST(max(date) - 27 AS VARCHAR) FROM history) AS holdout_start
FROM ({_ONE})""",
        "history",
    )
)
def m6_train_report(spark, sf_dir):
    """The report of a model fitted to all but the last days, as its file says."""
    path = _path(spark, "report.json")
    stages.train_and_evaluate(_history(panel_sources(spark, sf_dir).panel), path, "historical", 28)
    told = spark.read.option("multiLine", True).json(path)
    return tidy(told.select("model", "target_transform", "train_rows", "holdout_rows", *[C(f"losses.{n}").alias(f"pinball_{n}") for n in NAMES], "mean_loss", "train_end", "holdout_start"))


@query(_verdict_sql({"whole": "(SELECT count(*) || ' rows' FROM history)", "lost": f"{_n('history', 'day(date) = 3')} || ' feature rows have no target'"}, "history"))
def v8_feature_targets(spark, sf_dir):
    """The feature stage on a whole panel, and on one whose sales of some days are lost."""
    panel = stockout.add_stockout_flag(panel_sources(spark, sf_dir).panel)
    lost = panel.withColumn("sales_count", F.when(F.dayofmonth("date") != 3, C("sales_count")))

    def build(df):
        return f"{stages.build_features(df, _path(spark, 'features'), ('promotion',))['n_rows']} rows"

    return _verdicts(spark, {"whole": _said(build, panel), "lost": _said(build, lost)})


@query(
    _verdict_sql(
        {
            "both": "(SELECT (max(CAST(o_orderdate AS DATE)) - min(CAST(o_orderdate AS DATE)) + 1) || ' days' FROM orders)",
            "neither": "'0 days'",
            "start": "'start and end date: give both or neither'",
            "end": "'start and end date: give both or neither'",
        }
    )
)
def v16_context_span(spark, sf_dir):
    """Calendars between two dates of the orders, either of which may be missing."""
    first, last = spark.read.parquet(f"{sf_dir}/orders.parquet").agg(F.min(C("o_orderdate").cast("date")), F.max(C("o_orderdate").cast("date"))).first()

    def days(start, end):
        return f"{context.calendar(context.span_of(start, end, spark)).count()} days"

    return _verdicts(spark, {"both": _said(days, first, last), "neither": _said(days, None, None), "start": _said(days, first, None), "end": _said(days, None, last)})
