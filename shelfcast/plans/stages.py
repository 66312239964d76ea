"""The three stages: merged panel, features, model report; and the backtest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metrics import NAMES, QUANTILES, loss_report
from ..operators import baseline, dataset, features, validation
from ..operators.context import unmatched_events
from ..operators.forecaster import predictor
from ..operators.learner import BoostConfig
from ..sources.adapter import Sources
from ..sources.files import LINE, in_file_order, scan_sources, write_json, write_parquet
from ..sources.schemas import KEY

C = F.col


def sources_from_files(spark: SparkSession, data_dir: str, context_dir: str | None = None, history_rows: int | None = None, test_rows: int | None = None) -> Sources:
    """Validated sources of a folder, as one panel over both splits."""
    t = scan_sources(spark, data_dir, context_dir)
    validation.validate_panel(t["history"], "history", history_rows, True)
    validation.validate_panel(t["test"], "test", test_rows, False)
    validation.validate_dimension(t["items"], "items", "product_id")
    validation.validate_dimension(t["stores"], "stores", "store_id")
    validation.validate_context(t["items"], t["events"])
    validation.validate_oil(t["oil"])
    traffic = t.get("traffic")
    if traffic is None:
        traffic = spark.createDataFrame([], "date date, store_id short, transaction_count int")
    validation.validate_traffic(traffic)
    ordered = [validation.positions(in_file_order(t[n]).select("id", *LINE), LINE) for n in ("test", "sample")]
    validation.validate_sample_ids(*ordered)
    panel = dataset.union_splits(t["history"], t["test"])
    span = panel.agg(F.min("date").alias("first_day"), F.max("date").alias("last_day"))
    return Sources(panel, t["items"].withColumn("is_perishable", C("is_perishable") == 1), t["stores"], t["events"], t["oil"], traffic, span)


def build_merged(s: Sources, path: str) -> dict:
    """Write the merged panel in the order of its key; it has the rows of both splits."""
    rows = s.panel.count()
    told = write_parquet(dataset.merged_panel(s).orderBy(*KEY), path, rows, figures=validation.audit_figures())
    back = s.panel.sparkSession.read.parquet(path)
    whole = ("unique_keys", "matched_products", "matched_stores")
    got = validation.validate_audit(told, back, {"null_train_sales": 0, "known_test_sales": 0, "missing_traffic": 0, "n_rows": rows} | dict.fromkeys(whole, rows))
    return got | {"unmatched_events": unmatched_events(s.events, s.stores).count()}


def build_features(merged: DataFrame, path: str, groups: tuple[str, ...]) -> dict:
    told = write_parquet(features.training_features(merged, groups), path, figures={"nulls": F.count_if(C("sales_count").isNull())})
    if nulls := told.pop("nulls"):
        raise ValueError(f"{nulls} feature rows have no target")
    return told | {"groups": list(groups)}


def train_and_evaluate(table: DataFrame, report: str | None, model: str, holdout: int, config: BoostConfig = BoostConfig()) -> dict:
    """Fit on all but the last days, score those, and write the report."""
    train, rows = baseline.chronological_split(table, holdout)
    counts = {"train_rows": train.count(), "holdout_rows": rows.count()}
    if not all(counts.values()):
        raise ValueError("both parts of the split need rows")
    columns = [c for c in table.columns if c.startswith(features.PREFIX) and dict(table.dtypes)[c] != "string"]
    made = predictor(model).run(train, rows, columns, config)
    losses = {r.quantile: r.mean_log_pinball for r in loss_report(made).collect()}
    out = counts | {
        "model": model,
        "target_transform": "log1p" if config.log_sales else "none",
        "configuration": vars(config) if not hasattr(config, "__dataclass_fields__") else {k: getattr(config, k) for k in config.__dataclass_fields__},
        "losses": {f"p{int(q * 100)}": losses[q] for q in QUANTILES},
        "mean_loss": sum(losses.values()) / len(losses),
        "train_end": str(train.agg(F.max("date")).first()[0]),
        "holdout_start": str(rows.agg(F.min("date")).first()[0]),
        "features": columns,
    }
    if report:
        write_json(table.sparkSession, out, report)
    return out


def rolling_backtest(panel: DataFrame, windows: int, holdout: int, model: str = "historical", columns: list[str] | None = None, config: BoostConfig = BoostConfig()) -> DataFrame:
    """Mean loss of each window and quantile; windows are judged one after another.

    ``columns`` must be known ahead. Features of past sales would have seen the days
    held out: ``forecasting.rolling_evaluation`` forecasts from each origin instead.
    """
    if seen := [c for c in columns or [] if "sales" in c or "stockout" in c or c.startswith(("feature_zero_", "feature_nonzero_", "feature_profile_", "feature_same_"))]:
        raise ValueError(f"made from sales of the days held out: {', '.join(seen)}")
    if windows < 1 or holdout < 1:
        raise ValueError("windows and holdout are 1 at least")
    dealt = baseline.backtest_windows(panel, windows, holdout)
    out = None
    for w in range(windows):
        part = dealt.filter(C("window") == w)
        made = predictor(model).run(part.filter("part = 'train'"), part.filter("part = 'holdout'"), columns or [], config)
        got = loss_report(made.select("sales_count", *NAMES)).withColumn("window", F.lit(w))
        out = got if out is None else out.unionByName(got)
    return out
