"""Features of a stream equal those of a table, whatever the order of arrival."""

import math
import os
from datetime import datetime, timedelta

from shelfcast.streaming import rolling

T = datetime(2026, 1, 1)
SCHEMA = "ts timestamp, store_id int, product_id string, quantity double, note string"


def _sales():
    """Three series of 60 days: one dense, one with holes, one that ends early."""
    out = []
    for d in range(60):
        for n in range(3):
            out.append((T + timedelta(days=d, hours=7 * n + 1), 1, "a", float((d * 7 + n * 3) % 11), "x"))
        if d % 5 in (0, 3):
            out.append((T + timedelta(days=d, hours=5), 2, "b", float(d % 4), None))
        if d < 3:
            out.append((T + timedelta(days=d, hours=9), None, None, 1.5, None))
    return out


def _land(spark, rows, folder, k):
    """One file, younger than those before it: streams read files by age."""
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"file://{folder}")
    for name in os.listdir(folder):
        full = os.path.join(folder, name)
        if name.endswith(".parquet") and os.path.getmtime(full) > 1_000_000_000 + 1000:
            os.utime(full, (1_000_000_000 + k, 1_000_000_000 + k))


def _stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"file://{folder}")


def _rows(df):
    def tidy(v):
        return round(v, 9) if isinstance(v, float) else v

    return sorted((tuple(tidy(v) for v in r) for r in df.collect()), key=repr)


def _told(spark, rows, delay=2):
    """Days of a table that the watermark of its newest sale has passed."""
    mark = max(r[0] for r in rows if r[0] is not None) - timedelta(days=delay)
    return rolling.table_features(spark.createDataFrame(rows, SCHEMA)).filter(f"timestamp(date_add(date, 1)) <= timestamp'{mark}'")


def _disordered(rows):
    """Nine batches; sales of a day come up to a day and a half late, some before earlier days."""
    late = lambda i, r: r[0] + timedelta(hours=(i * 17) % 36)
    order = [r for _, r in sorted(((late(i, r), r) for i, r in enumerate(rows)), key=lambda x: x[0])]
    size = math.ceil(len(order) / 9)
    return [order[k : k + size] for k in range(0, len(order), size)]


def test_sums_of_a_disordered_stream(spark, tmp_path):
    rows = _sales()
    folder = str(tmp_path / "in")
    for k, part in enumerate(_disordered(rows)):
        _land(spark, part, folder, k)
    rolling.drained(spark, rolling.rolling_features(rolling.daily_sales(_stream(spark, folder))), f"file://{tmp_path}/out", f"file://{tmp_path}/cp")
    got = _rows(spark.read.parquet(f"file://{tmp_path}/out"))
    assert got == _rows(_told(spark, rows)) and len(got) > 70


def test_days_are_held_until_the_watermark(spark, tmp_path):
    rows = _sales() + [(None, 1, "a", 5.0, None), (T, 1, "a", None, None)]
    folder = str(tmp_path / "in")
    for k, part in enumerate(_disordered(rows[:-2])):
        _land(spark, part + (rows[-2:] if k == 0 else []), folder, k)
    daily = _stream(spark, folder).withWatermark("ts", "2 days").withColumnRenamed("quantity", "sales_count")
    rolling.drained(spark, rolling.rolling_features(daily), f"file://{tmp_path}/out", f"file://{tmp_path}/cp")
    assert _rows(spark.read.parquet(f"file://{tmp_path}/out")) == _rows(_told(spark, rows))


def test_a_restart_goes_on_and_late_sales_are_dropped(spark, tmp_path):
    rows = [r for r in _sales() if r[1] == 1]
    folder, out, cp = str(tmp_path / "in"), f"file://{tmp_path}/out", f"file://{tmp_path}/cp"
    half = len(rows) // 2
    _land(spark, rows[:half], folder, 0)
    rolling.drained(spark, rolling.rolling_features(rolling.daily_sales(_stream(spark, folder))), out, cp)
    first = spark.read.parquet(out).count()
    _land(spark, [(T, 1, "a", 1000.0, "too late"), *rows[half:]], folder, 1)
    rolling.drained(spark, rolling.rolling_features(rolling.daily_sales(_stream(spark, folder))), out, cp)
    got = _rows(spark.read.parquet(out))
    assert 0 < first < len(got) and got == _rows(_told(spark, rows))


def test_state_goes_when_it_is_out_of_reach(spark, tmp_path):
    rows = _sales()
    folder = str(tmp_path / "in")
    for k, part in enumerate(_disordered(rows)):
        _land(spark, part, folder, k)
    rolling.drained(spark, rolling.rolling_features(rolling.daily_sales(_stream(spark, folder))), f"file://{tmp_path}/out", f"file://{tmp_path}/cp")
    states = spark.read.format("statestore").option("operatorId", 0).option("stateVarName", "kept").load(f"file://{tmp_path}/cp")
    kept = {(r.key.store_id, r.key.product_id): r.value for r in states.select("key", "value").collect()}
    assert set(kept) == {(1, "a"), (2, "b")}
    assert all(len(v["days"]) <= rolling.RING + 4 for v in kept.values())


def test_an_empty_stream(spark, tmp_path):
    _land(spark, [], str(tmp_path / "in"), 0)
    features = rolling.rolling_features(rolling.daily_sales(_stream(spark, str(tmp_path / "in"))))
    rolling.drained(spark, features, f"file://{tmp_path}/out", f"file://{tmp_path}/cp")
    assert spark.read.schema(features.schema).parquet(f"file://{tmp_path}/out").count() == 0


def test_no_frame_is_built_for_a_series(spark, tmp_path, monkeypatch):
    """Series are many and short: state and results pass as rows."""
    _land(spark, [], str(tmp_path / "in"), 0)
    features = rolling.rolling_features(rolling.daily_sales(_stream(spark, str(tmp_path / "in"))))
    plan = features._jdf.queryExecution().analyzed().toString()
    assert "TransformWithStateInPySpark" in plan and "Pandas" not in plan
    sales = {3: 1.0, 9: 4.0, 10: 2.0}
    got = rolling._features(sales, 10)
    assert (got["sales_lag_1"], got["sales_lag_7"], got["sales_lag_14"]) == (4.0, 1.0, None)
    assert (got["sales_mean_7"], round(got["sales_std_7"], 9)) == (2.5, round(math.sqrt(4.5), 9))
    assert rolling._features(sales, 3)["sales_mean_28"] is None
