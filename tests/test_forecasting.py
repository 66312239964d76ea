"""Strategies, rolling evaluation, guarded submission, explanations and exports."""

import math
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from shelfcast import cli
from shelfcast.functions import metrics
from shelfcast.operators import forecaster, review, shap, validation
from shelfcast.operators.learner import BoostConfig
from shelfcast.plans import forecasting, stages
from shelfcast.sources import files

from test_cli import folder  # noqa: F401  the small folder of CSV files

D = date(2026, 1, 1)
CONFIG = BoostConfig(rounds=4, depth=2, min_leaf=2)


def _panel(spark, days=60, ahead=3):
    rows = [(f"{i}|{s}|{p}", D + timedelta(i), s, p, float((i * s + len(p)) % 9) if i < days - ahead else None, "train" if i < days - ahead else "test", i % 5 == 0) for i in range(days) for s in (1, 2) for p in ("a", "bb")]
    return spark.createDataFrame(rows, "id string, date date, store_id int, product_id string, sales_count double, dataset_split string, promotion boolean")


@pytest.mark.parametrize("strategy", forecasting.STRATEGIES)
def test_evaluation_never_sees_the_days_held_out(spark, strategy):
    p = _panel(spark)
    # a key among the context columns stays the key
    got = forecasting.rolling_evaluation(p, ["promotion", "store_id"], 2, 5, strategy, CONFIG)
    assert [w["n_rows"] for w in got["windows"]] == [20, 20]
    assert (got["windows"][1]["holdout_end"], got["holdout_start"], got["train_start"]) == (str(D + timedelta(56)), str(D + timedelta(47)), str(D))
    assert got["mean_pinball"] == pytest.approx(sum(got[f"pinball_{n}"] for n in metrics.NAMES) / 4)
    # other sales on the days held out change the losses of their window, not its forecasts
    part = p.filter(F.col("date") < F.lit(D + timedelta(52)))
    cut = F.lit(D + timedelta(47))
    made = []
    for sold in (F.col("sales_count"), F.col("sales_count") * 50):
        seen = part.withColumn("sales_count", F.when(F.col("date") < cut, F.col("sales_count")).otherwise(sold))
        made.append(forecasting.rolling_evaluation(seen, ["promotion"], 1, 5, strategy, CONFIG)["windows"][0])
    assert made[1]["mean_pinball"] > made[0]["mean_pinball"] and made[0]["train_end"] == str(D + timedelta(46))


def test_losses_are_of_log_sales(spark):
    """The published score of forecasts of 0 for a sale of 10, and losses of zeros that are sold."""
    one = spark.createDataFrame([(10.0, 0.0, 0.0, 0.0, 0.0)], "sales_count double, p25 double, p50 double, p75 double, p95 double")
    got = one.select(*[metrics.log_pinball(F.col("sales_count"), F.col(n), q).alias(n) for n, q in zip(metrics.NAMES, metrics.QUANTILES, strict=True)]).first()
    assert sum(got) / 4 == pytest.approx(1.468710854589002)
    # a model without trees forecasts a quantile of its training sales: losses by hand
    p = _panel(spark)
    told = forecasting.rolling_evaluation(p, [], 1, 5, "recursive", BoostConfig(rounds=0))["windows"][0]
    sold = sorted((r.date, r.sales_count, r.store_id, r.product_id) for r in p.filter("sales_count IS NOT NULL").collect())
    first = D + timedelta(28)
    start = date.fromisoformat(told["holdout_start"])
    y = [math.log1p(v) for d, v, *_ in sold if first <= d < start]
    held = [math.log1p(v) for d, v, *_ in sold if d >= start]
    for n, q in zip(metrics.NAMES, metrics.QUANTILES, strict=True):
        at = sorted(y)
        r = (len(at) - 1) * q
        made = at[math.floor(r)] + (at[math.ceil(r)] - at[math.floor(r)]) * (r - math.floor(r))
        assert told[f"pinball_{n}"] == pytest.approx(sum(max(q * (v - made), (q - 1) * (v - made)) for v in held) / len(held))


def test_windows_must_fit(spark):
    p = _panel(spark)
    for windows, holdout, train in ((3, 14, None), (1, 14, 50), (0, 5, None)):
        with pytest.raises(ValueError):
            forecasting.rolling_evaluation(p, [], windows, holdout, "recursive", CONFIG, train)
    with pytest.raises(ValueError, match="strategy"):
        forecasting.fitted(p, [], "both", 3, CONFIG)
    with pytest.raises(ValueError, match="held out"):
        stages.rolling_backtest(p, 1, 3, "boosted", ["feature_sales_lag_1"])
    assert forecasting.horizon(p) == 3


def test_submission_is_guarded(spark):
    test = spark.createDataFrame([("x", D, 1, "a"), ("y", D, 1, "bb")], "id string, date date, store_id int, product_id string")
    make = "date date, store_id int, product_id string, p25 double, p50 double, p75 double, p95 double"
    rows = [(D, 1, "a", 1.0, 2.0, 3.0, 4.0), (D, 1, "bb", 1.0, 1.0, 1.0, 1.0)]
    assert forecasting.guarded_submission(spark.createDataFrame(rows, make), test).count() == 2
    for other, fault in ((None, "without a forecast"), ((D, 1, "bb", 2.0, 1.0, 3.0, 4.0), "cross"), ((D, 1, "bb", 1.0, math.nan, 3.0, 4.0), "missing values"), ((D, 1, "bb", 1.0, None, 3.0, 4.0), "missing values")):
        with pytest.raises(ValueError, match=fault):
            forecasting.guarded_submission(spark.createDataFrame(rows[:1] + ([other] if other else []), make), test)
    with pytest.raises(ValueError, match="ids"):
        forecasting.guarded_submission(spark.createDataFrame(rows, make), test.withColumn("id", F.lit("x")))


def test_context_must_be_whole(spark):
    p = _panel(spark, 40)
    validation.validate_forecast_panel(p, ["promotion"])
    for bad, fault in (
        (p.filter(~((F.col("store_id") == 2) & (F.col("date") == F.lit(D)))), "every day"),
        (p.withColumn("sales_count", F.when(F.col("date") == F.lit(D), -1.0).otherwise(F.col("sales_count"))), "negative"),
        (p.withColumn("promotion", F.when(F.col("store_id") == 1, F.col("promotion"))), "context"),
    ):
        with pytest.raises(ValueError, match=fault):
            validation.validate_forecast_panel(bad, ["promotion"])


def test_display_rows_and_lookup(spark):
    parts = {f"shap_{c}": 0.25 for cols in shap.BUCKETS.values() for c in cols}
    rows = [{"id": "x", "quantile": q, "base_value": 1.0, "raw_model": 1.0 + sum(parts.values()), "submitted": 9.0, "target_transform": "log1p"} | parts for q in (0.25, 0.5)]
    told = spark.createDataFrame(rows)
    shown = shap.display_rows(told)
    got = shown.filter("quantile = 0.5").first()
    assert (got.base_value, got.display_base, got.display_prediction) == (1.0, round(math.e - 1, 2), 9.0)
    assert got.contrib_promotion == 0.25 and got.contrib_calendar == 1.5
    assert shap.display_rows(told.withColumn("target_transform", F.lit("identity"))).first().display_base == 1.0
    for wrong in (F.when(F.col("quantile") == 0.5, "log1p").otherwise("none"), F.lit("sqrt")):
        with pytest.raises(ValueError, match="target_transform"):
            shap.display_rows(told.withColumn("target_transform", wrong))
    points = spark.createDataFrame([("x", 0.25), ("y", 0.25)], "id string, quantile double")
    found = {r.id: r.contrib_promotion for r in shap.lookup(points, shown).collect()}
    assert found == {"x": 0.25, "y": None}


def test_segments_stack_by_sign(spark):
    df = spark.createDataFrame([("x", 0.5, 2.0, -1.0, 3.0, -4.0)], "id string, quantile double, contrib_a double, contrib_b double, contrib_c double, contrib_d double")
    got = {r.factor: (r.start, r.stop) for r in shap.signed_segments(df, ["id"]).collect()}
    assert got == {"a": (0, 2), "b": (0, -1), "c": (2, 5), "d": (-1, -5)}


def test_exception_list(spark, tmp_path):
    flags = spark.createDataFrame([("a", 1, "p", D, True, k, f'say "{k}"') for k in review.SEVERITY], "id string, store_id int, product_id string, date date, promotion boolean, type string, detail string")
    path = str(tmp_path / "exceptions")
    files.write_exceptions(review.exported(flags), path)
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    assert back.columns == ["id", "store_id", "product_id", "date", "promotion", "flag", "severity", "action", "detail"]
    got = {r.flag: r for r in back.collect()}
    assert set(got) == set(review.ACTION) == set(review.SEVERITY)
    assert all(r.severity == review.SEVERITY[k] and r.action == review.ACTION[k] and r.detail == f'say "{k}"' for k, r in got.items())
    page = review.exception_page(flags.withColumn("severity", review.severity(F.col("type"))), kind="zero_forecast", promotion=True, start=str(D), end=str(D))
    assert [(r.type, r.total) for r in page.collect()] == [("zero_forecast", 1)]


def test_command_line_strategies_and_explanations(spark, folder, tmp_path):  # noqa: F811
    common = ["forecast", "--data-dir", str(folder), "--context-dir", str(folder / "context"), "--cache-dir", str(tmp_path), "--rounds", "2", "--depth", "2", "--min-leaf", "2"]
    told = cli.main([*common, "--output", str(tmp_path / "a"), "--context-groups", "all", "--shap", "--eval-windows", "2", "--eval-holdout-days", "5", "--train-days", "40"], spark)
    assert told["evaluation"]["eval_windows"] == 2 and (tmp_path / "holdout_metrics.json").exists()
    sample = [r.id for r in spark.read.option("header", True).csv(str(folder / "sample_submission.csv")).collect()]
    assert [r.id for r in files.read_submission(spark, str(tmp_path / "a")).collect()] == sample
    side = spark.read.parquet(told["shap"])
    assert side.count() == 4 * len(sample) and shap.additivity(side.drop("target_transform")).first().off == 0
    assert files.read_shap_csv(spark, told["display"]).count() == 4 * len(sample)
    merged = told["data"].path
    keys = [(r.date, r.product_id, r.store_id) for r in spark.read.parquet(merged).collect()]
    assert keys == sorted(keys)
    told = cli.main([*common, "--output", str(tmp_path / "b"), "--forecast-strategy", "direct", "--context-groups", "promotion,store", "--processed-data", merged, "--skip-holdout", "--feature-fraction", "0.8", "--bagging-fraction", "0.8", "--bagging-freq", "1"], spark)
    assert set(told) == {"forecast", "models"} and files.read_submission(spark, str(tmp_path / "b")).count() == len(sample)
    with pytest.raises(SystemExit):
        cli.parse([*common, "--shap", "--forecast-strategy", "direct"])
    with pytest.raises(Exception, match="(?i)exists"):
        cli.main([*common, "--output", str(tmp_path / "b"), "--processed-data", merged, "--skip-holdout"], spark)
    assert cli.parse(common).eval_windows == 3
