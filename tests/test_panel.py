"""Context, stockout, features and validation on small hand-made inputs."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from shelfcast.operators import context, features, joins, stockout, validation
from shelfcast.sources.adapter import panel_sources

D = date(2026, 1, 1)


def day(n):
    return D + timedelta(n - 1)


@pytest.fixture(scope="module")
def stores(spark):
    return spark.createDataFrame([(1, "Alpha", "North"), (2, "Beta", "South")], "store_id int, city string, department string")


EVENT = "date date, event_type string, scope string, location string, is_transferred boolean"


def span(spark, a, b):
    return spark.createDataFrame([(day(a), day(b))], "first_day date, last_day date")


def test_events_reach_stores_by_scope(spark, stores):
    events = spark.createDataFrame(
        [(day(2), "Holiday", "National", "Country", False), (day(2), "Event", "Regional", "North", False), (day(2), "Additional", "Local", "Beta", False), (day(2), "Holiday", "Local", "Elsewhere", False)], EVENT
    )
    assert context.unmatched_events(events, stores).count() == 1
    got = {r.store_id: r for r in context.event_rollup(events, stores).collect()}
    assert got[1].event_count == got[2].event_count == 2
    assert got[1].has_national_event and got[1].has_regional_event and not got[1].has_local_event
    assert got[2].has_national_event and got[2].has_local_event
    assert got[1].event_types == ["Event", "Holiday"]


def test_transfers_and_distances(spark, stores):
    events = spark.createDataFrame(
        [(day(3), "Holiday", "National", "Country", True), (day(4), "Transfer", "National", "Country", False), (day(6), "Holiday", "Local", "Alpha", False), (day(5), "Holiday", "Local", "Elsewhere", False)], EVENT
    )
    got = {(r.date, r.store_id): r for r in context.event_context(events, stores, span(spark, 2, 7)).collect()}
    assert len(got) == 12
    r = got[day(3), 1]
    assert r.has_holiday and r.is_event_day and not r.is_effective_holiday and not r.is_effective_event_day
    assert (r.event_count, r.effective_event_count, r.days_until_effective_holiday, r.is_1d_before_holiday) == (1, 0, 1, True)
    r = got[day(4), 1]
    assert r.is_effective_holiday and r.days_until_effective_holiday == r.days_since_effective_holiday == 0
    assert [got[day(5), s].days_until_effective_holiday for s in (1, 2)] == [1, -1]
    assert [got[day(5), s].is_1d_before_holiday for s in (1, 2)] == [True, False]
    assert got[day(2), 1].event_types == []


def test_oil_is_filled_forward_only(spark):
    oil = spark.createDataFrame([(day(2), 50.0), (day(4), 52.0)], "date date, oil_price double")
    got = context.oil_context(oil, span(spark, 1, 5)).orderBy("date").collect()
    assert [r.oil_price for r in got] == [None, 50, 50, 52, 52]
    assert [r.oil_price_source_missing for r in got] == [True, False, True, False, True]


def test_traffic_is_known_before_the_day(spark, stores):
    traffic = spark.createDataFrame([(day(1), 1, 100), (day(2), 1, 120)], "date date, store_id int, transaction_count int")
    got = context.traffic_context(traffic, stores.filter("store_id = 1"), span(spark, 1, 4)).orderBy("date").collect()
    assert [r.traffic_lag_1 for r in got] == [None, 100, 120, 120]
    assert [r.traffic_source_missing for r in got] == [False, False, True, True]
    assert [r.traffic_mean_7 and round(r.traffic_mean_7, 3) for r in got] == [None, 100, 110, 113.333]
    with pytest.raises(ValueError, match="duplicate"):
        validation.validate_traffic(traffic.unionAll(traffic))


def test_sources_are_refused(spark):
    items = spark.createDataFrame([("A", 1, 0)], "product_family string, product_class int, is_perishable int")
    events = spark.createDataFrame([(day(1), "Holiday", "Unknown", "X", False)], EVENT)
    with pytest.raises(ValueError, match="unknown scope"):
        validation.validate_context(items, events)
    with pytest.raises(ValueError, match="duplicate"):
        validation.validate_dimension(items.unionAll(items), "items", "product_class")


def test_joins_fail_on_repeated_keys(spark):
    left = spark.range(3).withColumnRenamed("id", "k")
    right = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    assert joins.checked_join(left, right, ["k"]).count() == 3
    with pytest.raises(Exception, match="duplicate keys"):
        joins.checked_join(left, right.unionAll(right), ["k"]).collect()


def series(spark, sales):
    return spark.createDataFrame([(day(i + 1), 1, 10, float(s), "train") for i, s in enumerate(sales)], "date date, store_id int, product_id int, sales_count double, dataset_split string")


def test_stockout_flags(spark):
    got = stockout.add_stockout_flag(series(spark, [100, 100, 100, 0, 0, 110])).orderBy("date").collect()
    assert [r.is_likely_stockout for r in got] == [False, False, False, True, True, False]
    assert stockout.likely_stockout_for_last_day(series(spark, [100, 100, 100, 0])).first().is_likely_stockout


def test_lags_and_groups(spark):
    rows = series(spark, range(35)).withColumn("is_likely_stockout", F.lit(False)).withColumns(context.calendar_parts(F.col("date")))
    got = features.features(rows, features.parse_groups("calendar,sales_history"), ["date"]).orderBy("date").collect()
    assert "feature_promotion" not in got[0].asDict()
    assert got[0].feature_sales_lag_1 is None and got[1].feature_sales_lag_1 == 0 and got[8].feature_sales_lag_7 == 1


def test_features_do_not_see_the_day_itself(spark):
    base = [float((i * 7) % 13) for i in range(40)]
    changed = [*base[:30], 999.0, *base[31:]]
    groups = features.parse_groups("sales_history,seasonal_history,intermittency,behavioral_profile")
    out = []
    for s in (base, changed):
        rows = stockout.add_stockout_flag(series(spark, s)).withColumn("promotion", F.col("store_id") == 1)
        out.append(features.features(rows, groups, ["date"]).orderBy("date").collect())
    assert out[0][:31] == out[1][:31]
    assert out[0][31] != out[1][31]


def test_group_parser():
    assert features.parse_groups("payday,calendar,payday") == ("payday", "calendar")
    assert len(features.parse_groups("all")) == 15 and len(features.parse_groups("best")) == 12
    with pytest.raises(ValueError):
        features.parse_groups("nothing")
    with pytest.raises(ValueError):
        features.parse_groups(" ,")


def test_hierarchy_means(spark):
    rows = [(day(1), s, p, v) for (s, p), v in zip([(1, 10), (1, 20), (2, 10), (2, 20)], [1.0, 5.0, 3.0, 7.0], strict=True)]
    rows += [(day(2), s, p, 100.0) for s in (1, 2) for p in (10, 20)]
    df = spark.createDataFrame(rows, "date date, store_id int, product_id int, sales_count double").withColumn("product_family", F.when(F.col("product_id") == 10, "A").otherwise("B"))
    r = features.add_hierarchy(df).filter((F.col("date") == day(2)) & (F.col("store_id") == 1) & (F.col("product_id") == 10)).first()
    assert (r.product_mean_7, r.store_mean_7, r.store_family_mean_7) == (2.0, 3.0, 1.0)


def test_positions_number_all_rows(spark):
    df = spark.range(1000).withColumn("id", F.hash("id"))
    got = [r.position for r in validation.positions(df, ["id"]).orderBy("id").collect()]
    assert got == list(range(1000))


@pytest.mark.parametrize("kind", ["dense", "sparse"])
def test_all_events_are_mapped(spark, tmp_path, kind):
    for t, columns in {
        "lineitem": "'2026-01-01' AS l_shipdate, 1 AS l_partkey, 1 AS l_suppkey, 1.0D AS l_quantity, 0.0D AS l_discount",
        "part": "1 AS p_partkey, 'SMALL' AS p_type, 'Brand#11' AS p_brand",
        "supplier": "1 AS s_suppkey, 1 AS s_nationkey",
        "nation": "1 AS n_nationkey, 1 AS n_regionkey, 'N' AS n_name",
        "region": "1 AS r_regionkey, 'AMERICA' AS r_name",
        "orders": "'2026-01-01' AS o_orderdate, 1 AS o_custkey, 1.0D AS o_totalprice",
        "customer": "1 AS c_custkey, 1 AS c_nationkey",
    }.items():
        spark.sql(f"SELECT {columns}").write.parquet(f"{tmp_path}/{t}.parquet")
    spark.range(200).selectExpr("id AS event_id", "timestamp'2024-01-01' AS ts", "id AS user_id", "'view' AS event_type").write.parquet(f"{tmp_path}/events.parquet")
    events = panel_sources(spark, str(tmp_path), kind).events
    assert events.count() == 200 and events.filter("is_transferred").count() == 100


def test_the_write_observes_what_a_scan_would_count(spark, tmp_path):
    from shelfcast.sources import files

    day = date(2026, 3, 1)
    rows = [(day + timedelta(i % 7), i, f"p{i % 3}", "train" if i % 5 else "test", "f" if i % 4 else None, "c", None if i % 6 else 1.0, i % 2 == 0, float(i) if i % 5 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "date date, store_id int, product_id string, dataset_split string, product_family string, city string, oil_price double, traffic_source_missing boolean, sales_count double").repartition(6)
    got = files.write_parquet(df, str(tmp_path / "t"), 400, figures=validation.audit_figures())
    want = validation.audit(spark.read.parquet(str(tmp_path / "t"))).first().asDict()
    assert want.pop("unique_keys") == 400 and got == want
    with pytest.raises(ValueError, match="matched_products is 300, not 400"):
        validation.validate_audit(got, df, {"matched_products": 400})
    with pytest.raises(ValueError, match="unique_keys is 400, not 800"):
        validation.validate_audit(got, df.union(df), {"unique_keys": 800})
    with pytest.raises(ValueError, match="written 400 rows, not 399"):
        files.write_parquet(df, str(tmp_path / "u"), 399)
    # nothing written: no days, and tables without days have none to tell
    assert files.write_parquet(df.limit(0), str(tmp_path / "v")) == {"n_rows": 0, "first_day": None, "last_day": None}
    assert files.write_parquet(df.select("city"), str(tmp_path / "w")) == {"n_rows": 400}


def test_sale_lines_are_read_once(spark, monkeypatch):
    from shelfcast.sources import adapter

    made = []
    write = adapter.written
    monkeypatch.setattr(adapter, "written", lambda df, name: made.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or write(df, name))
    rows = [r for r in panel_sources(spark, "/root/testdata/sf0.001").panel.orderBy("id").collect()]
    assert [name for name, _ in made] == ["sold", "panel"]
    s = panel_sources(spark, "/root/testdata/sf0.001")
    assert s.panel is s.panel and not any("lineitem" in f for f in s.panel.inputFiles())
    # a dimension with many rows is shuffled, with the same panel
    monkeypatch.setattr(adapter, "BROADCAST_ROWS", 10)
    assert panel_sources(spark, "/root/testdata/sf0.001").panel.orderBy("id").collect() == rows
    assert "shuffle_hash" not in made[0][1] and "shuffle_hash" in made[-2][1]
