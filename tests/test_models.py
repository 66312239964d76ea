"""Losses, learner, forecasts, explanations, review, stages and files."""

import math
from datetime import date, timedelta
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcast.functions import metrics
from shelfcast.operators import baseline, forecaster, review, shap
from shelfcast.operators.learner import BoostConfig
from shelfcast.plans import cache, model_queries, review_queries, stages
from shelfcast.sources import files, shared

D = date(2026, 1, 1)
Q = "p25 double, p50 double, p75 double, p95 double"


def test_scorer(spark):
    df = spark.createDataFrame([(10.0, 0.0, 0.0, 0.0, 0.0, 1.0)], f"sales_count double, {Q}, weight double")
    one = metrics.weighted_score(df).first().score
    assert one == pytest.approx(1.468710854589002)
    more = df.unionAll(spark.createDataFrame([(5.0, 5.0, 5.0, 5.0, 5.0, 3.0)], df.schema))
    assert metrics.weighted_score(more).first().score == pytest.approx(one / 4)


def test_quantiles_are_sorted_with_sources(spark):
    df = spark.createDataFrame([(3.0, 1.0, 2.0, 4.0), (-1.0, 4.0, 2.0, 3.0)], Q)
    got = metrics.sorted_quantiles(df).collect()
    assert [[r[n] for n in metrics.NAMES] for r in got] == [[1, 2, 3, 4], [0, 2, 3, 4]]
    assert [[r[f"source_{n}"] for n in metrics.NAMES] for r in got] == [[0.5, 0.75, 0.25, 0.95], [0.25, 0.75, 0.95, 0.5]]
    values, source = forecaster.coherent(np.log1p(np.array([[3, 1, 2, 4.0]])))
    assert np.allclose(values, [[1, 2, 3, 4]]) and source.tolist() == [[0.5, 0.75, 0.25, 0.95]]


def test_direct_rows(spark):
    df = spark.createDataFrame([(D + timedelta(i), 1, "a", float(i)) for i in range(36)], "date date, store_id int, product_id string, sales_count double")
    got = baseline.direct_supervised(df, [3]).orderBy("date").collect()
    assert (got[0].sales_count, got[0].sales_lag_1) == (30, 27)
    assert (got[-1].sales_count, got[-1].sales_lag_1) == (35, 32)


def test_baseline_falls_back(spark):
    train = spark.createDataFrame([(1, "a", float(v)) for v in range(5)], "store_id int, product_id string, sales_count double")
    rows = spark.createDataFrame([(1, "a"), (9, "z")], "store_id int, product_id string")
    got = {r.store_id: r for r in baseline.historical_quantiles(train, rows).collect()}
    assert (got[1].p25, got[1].p95) == (1.0, 3.8)
    assert (got[9].p50, got[9].p95) == (2.0, 4.0)


def _panel(spark, days=60, ahead=3):
    rows = [(D + timedelta(i), s, p, float((i * s + len(p)) % 9) if i < days - ahead else None, "train" if i < days - ahead else "test", i % 5 == 0) for i in range(days) for s in (1, 2) for p in ("a", "bb")]
    return spark.createDataFrame(rows, "date date, store_id int, product_id string, sales_count double, dataset_split string, promotion boolean")


def test_recursive_and_direct_forecasts(spark):
    p = _panel(spark)
    config = BoostConfig(rounds=8, depth=2, min_leaf=2)
    models = forecaster.train_models(forecaster.supervised(p, ["promotion"]), [*forecaster.SALES, "promotion"], config)
    got = forecaster.recursive_forecast(p, models, ["promotion"]).collect()
    assert len(got) == 12 and all(0 <= r.p25 <= r.p50 <= r.p75 <= r.p95 for r in got)
    rows = forecaster.direct_rows(p, [1, 2, 3], []).filter("sales_count is not null")
    by_lead = forecaster.train_models(rows, forecaster.SALES, config)
    made = forecaster.direct_forecast(p, [1, 2, 3], by_lead, forecaster.SALES).collect()
    assert len(made) == 12 and sorted(by_lead) == [1, 2, 3]
    told = shap.shap_long(forecaster.supervised(p, ["promotion"]).limit(2), models[0], [*forecaster.SALES, "promotion"], ["date", "store_id", "product_id"])
    assert told.count() == 8 and shap.additivity(told).first().off == 0
    with pytest.raises(ValueError, match="no contribution"):
        shap.buckets(told, ["date"])


@pytest.fixture
def month(spark, monkeypatch):
    """Queries of fitted models on a small panel whose test split is the whole horizon."""
    p = _panel(spark, 100, 28).withColumn("day_of_week", F.weekday("date") + 1).withColumn("id", F.concat_ws("|", "date", "store_id", "product_id"))
    p = p.persist()
    monkeypatch.setattr(model_queries, "_panel", lambda spark, sf_dir: p)
    monkeypatch.setattr(model_queries, "CONFIG", BoostConfig(rounds=4, depth=2, min_leaf=2))
    monkeypatch.setattr(model_queries, "_FITTED", {})
    monkeypatch.setattr(review_queries, "panel_sources", lambda spark, sf_dir: SimpleNamespace(panel=p))
    yield p
    p.unpersist()


def test_every_lead_of_the_horizon_is_forecast(spark, month):
    got = model_queries.m14_direct_forecast(spark, "").select("date", "store_id", "product_id")
    assert got.count() == 4 * 28
    assert got.exceptAll(month.filter("dataset_split = 'test'").select(got.columns)).count() == 0
    assert {r.lead for r in review_queries.m9_direct_supervised(spark, "").select("lead").distinct().collect()} == set(range(1, 29))


@pytest.mark.parametrize("query, rows", [("m13_recursive_forecast", 4 * 28), ("m12_scores_as_columns", 4 * 44), ("m20_ensemble_recursion", 4 * 28)])
def test_the_panel_is_made_once_a_query(spark, month, monkeypatch, query, rows):
    made = []
    monkeypatch.setattr(model_queries, "_panel", lambda spark, sf_dir: made.append(1) or month)
    assert getattr(model_queries, query)(spark, "").count() == rows and len(made) == 1


def test_shuffle_partitions_do_not_multiply_the_calls_of_a_model(spark):
    calls = spark.sparkContext.accumulator(0)

    class Counted:
        def predict(self, x):
            calls.add(1)
            return np.ones(len(x))

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        got = forecaster.recursive_forecast(_panel(spark), {0: [Counted()] * 4}, ["promotion"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == 12 and calls.value == 3 * 4


def test_registered_models_are_fitted_on_all_rows_as_the_learner_does(spark, monkeypatch):
    assert model_queries.CONFIG == BoostConfig()
    monkeypatch.setattr(model_queries, "CONFIG", BoostConfig(rounds=1, depth=1))
    monkeypatch.setattr(model_queries, "_FITTED", {})
    # 5,500 days of four series: 22,000 rows, less the first 28 days of each
    p = _panel(spark, 5_500, 0).withColumn("day_of_week", F.weekday("date") + 1)
    monkeypatch.setattr(model_queries, "_panel", lambda spark, sf_dir: p)
    assert {r.n_rows for r in model_queries.m10_quantile_boosting(spark, "").collect()} == {22_000 - 4 * 28}


def test_checks_find_faults(spark, month, monkeypatch):
    real = review_queries.derived_submission
    assert review_queries.j16_ordered_ids(spark, "").first().asDict() == {"n_rows": 4 * 28, "misplaced": 0}
    monkeypatch.setattr(review_queries, "derived_submission", lambda p: real(p).filter("NOT id LIKE '%|1|a'"))
    assert review_queries.j16_ordered_ids(spark, "").first().misplaced > 0
    assert model_queries.v13_additivity(spark, "").first().asDict() == {"n_rows": 4 * 4 * 28, "off": 0}
    told = model_queries._told(spark, "")
    monkeypatch.setattr(model_queries, "_told", lambda spark, sf_dir: told.withColumn("base_value", F.col("base_value") + 1))
    assert model_queries.v13_additivity(spark, "").first().off == 4 * 4 * 28


def test_every_forecast_is_explained(spark, month):
    told = model_queries.m18_shap_long(spark, "").persist()
    assert told.count() == 4 * 4 * 28 and told.select("id", "quantile").distinct().count() == 4 * 4 * 28
    made = {(r.date, r.store_id, r.product_id): r for r in model_queries.m13_recursive_forecast(spark, "").collect()}
    for r in told.collect():
        value = made[r.date, r.store_id, r.product_id][f"p{round(r.quantile * 100)}"]
        assert r.submitted == pytest.approx(value, abs=1e-5) == max(math.expm1(r.raw_model), 0)
    assert shap.additivity(told).first().off == 0


def test_features_for_next():
    h = np.arange(40.0)
    assert forecaster.features_for_next(h)[0, :4].tolist() == [39, 33, 26, 12]
    assert forecaster.last_day_flags(np.array([[100, 100, 100, 0.0]])).tolist() == [True]
    with pytest.raises(ValueError):
        forecaster.predictor("nothing")
    assert forecaster.parse_context("product,promotion,sales") == ("promotion", "product")


def _review(spark, quantiles, promotion=False, family="BREAD/BAKERY", perishable=False, base=None, normal=None, holiday=False, history=()):
    day = D + timedelta(10)
    sub = [("x", *quantiles)] + ([("y", *normal)] if normal else [])
    test = [("x", day, 1, "p", promotion)] + ([("y", D + timedelta(20), 1, "p", False)] if normal else [])
    make = spark.createDataFrame
    return review.Review(
        make([(i, *map(float, q)) for i, *q in sub], f"id string, {Q}"),
        make(test, "id string, date date, store_id int, product_id string, promotion boolean"),
        make([("p", family, 1, perishable)], "product_id string, product_family string, product_class int, is_perishable boolean"),
        make([(1, "Alpha", "North")], "store_id int, city string, department string"),
        make([(day + timedelta(1), "Additional", "Local", "Alpha", False)] if holiday else [], "date date, event_type string, scope string, location string, is_transferred boolean"),
        make([("x", *map(float, base))] if base else [], f"id string, {Q}"),
        make(list(history), "date date, store_id int, product_id string, promotion boolean, sales_count double"),
    )


def _types(r):
    return {x.type for x in review.all_flags(r).filter("id = 'x' OR id IS NULL").collect()}


def test_review_rules(spark):
    got = _types(_review(spark, (0, 0, 0, 3), base=(10, 10, 10, 10)))
    assert {"essential_low", "baseline_deviation"} <= got and "monotonicity" not in got
    assert "promo_no_lift" in _types(_review(spark, (10, 10, 10, 10), promotion=True, normal=(10, 10, 10, 10)))
    assert "holiday_flat" in _types(_review(spark, (10, 10, 10, 10), holiday=True, normal=(10, 10, 10, 10)))
    got = _types(_review(spark, (0, 0, 0, 5), family="LIQUOR"))
    assert "zero_forecast" in got and "essential_low" not in got
    assert "wide_spread" in _types(_review(spark, (0, 2, 10, 30)))
    assert "perishable_spike" in _types(_review(spark, (1, 2, 3, 4), perishable=True))
    assert "monotonicity" in _types(_review(spark, (3, 2, 3, 4)))
    past = [(D + timedelta(5), 1, "p", True, 0.0), (D + timedelta(6), 1, "p", False, 0.0), (D - timedelta(60), 1, "p", True, 0.0)]
    assert [x.type for x in review.history_flags(_review(spark, (1, 1, 1, 1), history=past)).collect()] == ["promo_zero_history"]


def test_rollups_and_submission_check(spark):
    r = _review(spark, (1, 2, 3, 4))
    got = {x.level: x for x in review.rollups(r, review.all_flags(r)).collect()}
    assert (got["store"].sum_p50, got["store"].sum_p95) == (2, 4)
    assert (got["store_product"].min_p25, got["store_product"].max_p95, got["product"].sum_p50) == (1, 4, 2)
    sub = spark.createDataFrame([("a", 1.0, 2.0, 3.0, 4.0), ("b", 2.0, 1.0, 3.0, 4.0), ("c", 1.0, 1.0, 1.0, 1.0)], f"id string, {Q}")
    test = spark.createDataFrame([("a",), ("b",)], "id string")
    x = review.submission_check(sub, test).first()
    assert (x.monotonic_violations, x.missing, x.extra, x.total) == (1, 0, 1, 3)


def test_small_functions(spark):
    r = spark.range(1).select(
        metrics.nice_maximum(F.lit(34.0)).alias("m"), metrics.round_half_up(F.lit(2.5)).alias("h"), metrics.csv_cell(F.lit('a"b')).alias("c"), metrics.date_label(F.lit("2026-07-04").cast("date")).alias("d")
    ).first()
    assert (r.m, r.h, r.c, r.d) == (50.0, 3, '"a""b"', "Jul 4")


def test_cache_hits_and_rebuilds(spark, tmp_path, monkeypatch):
    code, source, root = tmp_path / "c.py", tmp_path / "in.txt", "file://" + str(tmp_path / "out")
    code.write_text("1")
    source.write_text("x\ny\nlonger\n")
    built = []

    def build(path):
        built.append(path)
        shared.replace_text(spark, path, "made")
        return {"n": len(built)}

    def run():
        return cache.run_stage(spark, "s", root, [f"file://{source}"], [str(code)], {"a": 1}, build)

    with pytest.raises(FileNotFoundError):
        cache.current(spark, root)
    assert not run().hit and run().hit and cache.current(spark, root) == built[-1]
    code.write_text("2")
    assert not run().hit and len(built) == 2
    shared.replace_text(spark, built[-1], "other")
    assert not run().hit
    # files that many tasks share: the order and ends of lines count
    monkeypatch.setattr(cache, "LARGE", 4)
    told = [cache.table_digests(spark, f"file://{source}")]
    for text in ("x\ny\nlonger\n", "y\nx\nlonger\n", "x\ny\nlonges\n", "x\ny\nlonger\r\n"):
        source.write_bytes(text.encode())
        told.append(cache.table_digests(spark, f"file://{source}"))
    assert told[0] == told[1] and len({str(x) for x in told}) == 4 and all(len(x) == 1 for x in told)


def test_table_cache_survives_a_crash(spark, tmp_path, monkeypatch):
    root, source, code = "file://" + str(tmp_path / "cache"), "file://" + str(tmp_path / "in"), tmp_path / "c.py"
    code.write_text("1")
    spark.range(20).repartition(3).write.parquet(source)
    built = []

    def build(path):
        built.append(path)
        spark.read.parquet(source).selectExpr("id + 1 AS id").write.parquet(path)
        return {"n": len(built)}

    def run(**more):
        return cache.run_stage(spark, "s", root, [source], [str(code)], {"a": 1} | more, build)

    first, again = run(), run()
    assert (first.hit, again.hit, again.path, again.metadata) == (False, True, first.path, {"n": 1})
    assert len(cache.table_digests(spark, source)) == 3 and spark.read.parquet(first.path).count() == 20
    # a run that ends between the table and the pointer leaves the version that held
    code.write_text("2")
    with monkeypatch.context() as m:
        m.setattr(cache, "replace_text", lambda *x: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            run()
    assert spark.read.parquet(first.path).count() == 20 and len(built) == 2
    code.write_text("1")
    assert run().hit
    code.write_text("2")
    third = run()
    assert not third.hit and third.path != first.path and not (tmp_path / "cache" / first.path.rsplit("/", 1)[1]).exists()
    assert not run(a=2).hit and len(built) == 4
    spark.range(5).write.mode("append").parquet(source)
    changed = run(a=2)
    assert not changed.hit and spark.read.parquet(changed.path).count() == 25
    # a table that was changed behind the pointer is built anew
    spark.range(1).write.mode("append").parquet(changed.path)
    assert not run(a=2).hit
    with pytest.raises(RuntimeError, match="nothing"):
        cache.run_stage(spark, "t", root + "2", [], [], {}, lambda path: {})


def test_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="items.csv"):
        files.scan_sources(spark, str(tmp_path))
    df = spark.createDataFrame([("a", 1.0, 2.0, 3.0, 4.0)], f"id string, {Q}")
    path = str(tmp_path / "sub")
    files.write_submission(df, path)
    assert files.read_submission(spark, path).first().p95 == 4.0
    with pytest.raises(Exception, match="(?i)exists"):
        files.write_submission(df, path)
    (tmp_path / "q.csv").write_text('id,quantile,base_units,contrib_a\n"LIQUOR,WINE,BEER",0.5,1,2\n')
    assert files.read_shap_csv(spark, str(tmp_path / "q.csv")).first().id == "LIQUOR,WINE,BEER"
    files.write_json(spark, {"b": 1, "a": 2}, str(tmp_path / "r.json"))
    assert (tmp_path / "r.json").read_text().index('"a"') < (tmp_path / "r.json").read_text().index('"b"')
    for name in ("a_1.x", "a_2.x", "a_3.y"):
        (tmp_path / name).write_text("")
    assert files.newest(spark, str(tmp_path), ".x") == f"{tmp_path}/a_2.x"
    with pytest.raises(FileNotFoundError):
        files.newest(spark, str(tmp_path / "none"), ".x")


def test_train_and_evaluate(spark):
    rows = [(D + timedelta(i), 1, 1, i, float(i % 9), i % 31, i % 7) for i in range(40)]
    df = spark.createDataFrame(rows, "date date, store_id int, product_id int, id int, sales_count double, feature_day int, feature_cycle int")
    for model in ("historical", "boosted"):
        got = stages.train_and_evaluate(df, None, model, 3, BoostConfig(rounds=5, depth=2, min_leaf=2))
        assert (got["train_rows"], got["holdout_rows"], got["target_transform"]) == (37, 3, "log1p")
        assert got["train_end"] < got["holdout_start"] and got["configuration"]["rounds"] == 5
    assert stages.rolling_backtest(df, 2, 3).count() == 8


def test_the_overlay_has_events_of_working_days(spark):
    import __spark_entry__ as entry

    assert "isodow" not in entry.oracle_sql()["j21_calendar_overlay"].split("SELECT r.store_id")[1]
    got = {r.day for r in entry.queries()["j21_calendar_overlay"](spark, "/root/testdata/sf0.001").select(F.weekday(F.col("date").cast("date")).alias("day")).distinct().collect()}
    assert got == set(range(7))
