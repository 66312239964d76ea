"""The command line over a small folder of CSV files."""

import csv
import os
from datetime import date, timedelta

import pytest

from shelfcast import cli
from shelfcast.sources import files

D = date(2026, 1, 1)


def write(path, header, rows):
    with open(path, "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(header)
        w.writerows(rows)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("data")
    context = at / "context"
    context.mkdir()
    keys = [(s, p) for s in (1, 2) for p in (10, 20, 30)]
    days = [D + timedelta(i) for i in range(48)]
    rows = [(i, d, s, p, float((i * 7 + p) % 11), str(i % 4 == 0).capitalize()) for i, (d, s, p) in enumerate((d, s, p) for d in days for s, p in keys)]
    write(at / "sales_history.csv", ["id", "date", "store_id", "product_id", "sales_count", "promotion"], rows)
    ahead = [(1000 + i, d, s, p, "False") for i, (d, s, p) in enumerate((days[-1] + timedelta(k), s, p) for k in (1, 2, 3) for s, p in keys)]
    write(at / "test.csv", ["id", "date", "store_id", "product_id", "promotion"], ahead)
    write(at / "sample_submission.csv", ["id", "sales_count_p25"], [(r[0], 0) for r in ahead])
    write(at / "items.csv", ["product_id", "product_family", "product_class", "is_perishable"], [(10, "DAIRY", 1, 1), (20, "LIQUOR,WINE,BEER", 2, 0), (30, "EGGS", 3, 1)])
    write(at / "stores.csv", ["store_id", "city", "department", "store_type", "store_cluster"], [(1, "Alpha", "North", "A", 1), (2, "Beta", "South", "B", 2)])
    write(at / "events.csv", ["date", "event_type", "scope", "location", "is_transferred"], [(D + timedelta(9), "Holiday", "National", "Country", "False"), (D + timedelta(20), "Event", "Local", "Gamma", "False")])
    write(at / "oil_prices.csv", ["date", "oil_price"], [(D + timedelta(i), 50 + i) for i in range(0, 48, 2)])
    write(context / "store_traffic.csv", ["date", "store_id", "transaction_count"], [(d, s, 100 + s) for d in days for s in (1, 2)])
    return at


def test_stages_and_forecast(spark, folder, tmp_path):
    common = ["--data-dir", str(folder), "--context-dir", str(folder / "context"), "--cache-dir", str(tmp_path), "--rounds", "3", "--depth", "2", "--min-leaf", "2", "--holdout-days", "3"]
    told = cli.main(["all", *common, "--features", "calendar,product,store,sales_history"], spark)
    assert not any(o.hit for o in told.values())
    assert told["data"].metadata["n_rows"] == 306 and told["data"].metadata["unmatched_events"] == 1
    assert told["train"].metadata["holdout_rows"] == 18
    again = cli.main(["all", *common, "--features", "calendar,product,store,sales_history"], spark)
    assert all(o.hit for o in again.values())
    out = str(tmp_path / "submission")
    cli.main(["forecast", *common, "--output", out, "--context-groups", "promotion,product", "--skip-holdout"], spark)
    got = files.read_submission(spark, out)
    assert spark.read.parquet(f"{out}.models.parquet").filter("tree = -1").count() == 4
    assert (tmp_path / "train" / os.path.basename(again["train"].path) / "report.json").exists()
    assert got.count() == 18 and got.filter("p25 <= p50 AND p50 <= p75 AND p75 <= p95").count() == 18


def test_sample_order_is_checked(spark, folder, tmp_path):
    from shelfcast.plans.stages import sources_from_files

    for f in os.listdir(folder):
        if f.endswith(".csv"):
            (tmp_path / f).write_bytes((folder / f).read_bytes())
    lines = (tmp_path / "sample_submission.csv").read_text().splitlines()
    lines[1], lines[2] = lines[2], lines[1]
    (tmp_path / "sample_submission.csv").write_text("\n".join(lines) + "\n")
    with pytest.raises(ValueError, match="sample ids"):
        sources_from_files(spark, str(tmp_path))


def test_newest_explanations_are_displayed(spark, folder, tmp_path):
    common = ["--data-dir", str(folder), "--context-dir", str(folder / "context"), "--cache-dir", f"file://{tmp_path}/cache", "--rounds", "2", "--depth", "2", "--min-leaf", "2", "--output-dir", f"file://{tmp_path}/made"]
    groups = ",".join(cli.forecaster.CONTEXT)
    told = cli.main(["forecast", *common, "--skip-holdout", "--shap", "--context-groups", groups], spark)
    assert told["forecast"].startswith(f"file://{tmp_path}/made/forecast_")
    shown = cli.main(["display", "--output-dir", f"file://{tmp_path}/made"], spark)
    assert shown["shap"] == told["shap"] and spark.read.option("header", True).csv(shown["display"]).count() == 18 * 4
    with pytest.raises(SystemExit):
        cli.parse(["data"])
