"""Command line: ``python -m shelfcast.cli {all,data,features,train,forecast,display}``.

All paths are those of Spark's file systems, so data, stages, reports and outputs can
be off the local disk.
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import boosting, features, forecaster, shap, validation
from .operators.learner import BoostConfig
from .plans import cache, forecasting, stages
from .sources import files
from .sources.shared import names_in

_HERE = os.path.dirname(os.path.abspath(__file__))


def parse(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="shelfcast")
    p.add_argument("stage", choices=["all", "data", "features", "train", "forecast", "display"])
    p.add_argument("--data-dir", help="the folder of source files (all but display)")
    p.add_argument("--context-dir")
    p.add_argument("--cache-dir", default="cache")
    p.add_argument("--features", default="best")
    p.add_argument("--model", default="boosted", choices=sorted(forecaster.PREDICTORS))
    p.add_argument("--holdout-days", type=int, default=28)
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--log-sales", action=argparse.BooleanOptionalAction, default=True)
    p.add_argument("--rounds", type=int, default=60)
    p.add_argument("--learning-rate", type=float, default=0.1)
    p.add_argument("--leaves", type=int, default=16)
    p.add_argument("--depth", type=int, default=5, help="levels of a tree, at most")
    p.add_argument("--feature-fraction", type=float, default=1.0)
    p.add_argument("--bagging-fraction", type=float, default=1.0)
    p.add_argument("--bagging-freq", type=int, default=0)
    p.add_argument("--min-leaf", type=int, default=20)
    p.add_argument("--context-groups", default="promotion,calendar")
    p.add_argument("--output", help="default: a new path in --output-dir, named by the time")
    p.add_argument("--output-dir", default="forecasts")
    p.add_argument("--force", action="store_true")
    p.add_argument("--processed-data", help="a merged panel to forecast from, instead of building one")
    p.add_argument("--forecast-strategy", choices=forecasting.STRATEGIES, default="recursive")
    p.add_argument("--eval-windows", type=int, default=3, help="rolling windows to judge before the forecast")
    p.add_argument("--eval-holdout-days", type=int, default=14)
    p.add_argument("--train-days", type=int, help="days before the latest window (default: all but its holdout)")
    p.add_argument("--skip-holdout", action="store_true", help="forecast only")
    p.add_argument("--shap", action="store_true", help="write explanations beside the submission")
    args = p.parse_args(argv)
    args.output = args.output or files.unique_path(args.output_dir, "display" if args.stage == "display" else "forecast")
    args.feature_groups = features.parse_groups(args.features)
    args.config = BoostConfig(rounds=args.rounds, learning_rate=args.learning_rate, leaves=args.leaves, depth=args.depth, min_leaf=args.min_leaf, seed=args.seed, log_sales=args.log_sales, feature_fraction=args.feature_fraction, bagging_fraction=args.bagging_fraction, bagging_freq=args.bagging_freq)
    if args.data_dir is None and args.stage != "display":
        p.error("--data-dir is needed")
    if args.shap and args.forecast_strategy != "recursive":
        p.error("--shap explains the recursive strategy only")
    if args.stage == "forecast" and args.model not in forecaster.TRAINERS:
        p.error(f"forecasts are made by {' or '.join(forecaster.TRAINERS)}")
    return args


def forecast(args: argparse.Namespace, panel: DataFrame) -> dict:
    """Judge the model on rolling windows if asked, forecast, and write what passes the checks."""
    groups = forecaster.parse_context(args.context_groups)
    columns = [c for g in groups for c in forecaster.CONTEXT[g]]
    # oil and traffic have no value before their first observation
    validation.validate_forecast_panel(panel, [c for g in groups if g not in ("oil", "traffic") for c in forecaster.CONTEXT[g]])
    panel = features.with_codes(panel, ("product", "store"))
    coded = {"product_family", "city", "department", "store_type"}
    panel = panel.withColumns({c: panel[f"code_{c}"] for c in coded & set(columns)}).withColumn("product_id", panel["product_id"].cast("string"))
    strategy, days, told = args.forecast_strategy, forecasting.horizon(panel), {}
    if args.eval_windows and not args.skip_holdout:
        told["evaluation"] = forecasting.rolling_evaluation(panel, columns, args.eval_windows, args.eval_holdout_days, strategy, args.config, args.train_days, args.model)
        files.write_json(panel.sparkSession, told["evaluation"], f"{args.cache_dir}/holdout_metrics.json")
    models = forecasting.fitted(panel, columns, strategy, days, args.config, args.model)
    made = forecasting.forecast(panel, models, columns, strategy, days, args.config).persist()
    try:
        test = panel.filter("dataset_split = 'test'").select("id", "date", "store_id", "product_id")
        whole = forecasting.guarded_submission(made, test)
        sample = files.in_file_order(panel.sparkSession.read.option("header", True).csv(f"{args.data_dir}/sample_submission.csv"))
        order = sample.select(F.col("id").cast(dict(test.dtypes)["id"]).alias("id"), *files.LINE)
        files.write_submission(whole.join(order, "id").orderBy(*files.LINE), args.output)
    finally:
        made.unpersist()
    told["forecast"] = args.output
    if args.model == "boosted":  # a blend is more than its trees
        told["models"] = f"{args.output}.models.parquet"
        files.write_model(boosting.model_table(panel.sparkSession, models, forecaster.SALES + columns), told["models"])
    if args.shap:
        told["shap"] = f"{args.output}.shap.parquet"
        files.write_shap(forecasting.sidecar(panel, models[0], columns, args.config), told["shap"])
        if groups == tuple(forecaster.CONTEXT):  # buckets are over all groups
            told["display"] = f"{args.output}.display"
            files.write_display(shap.display_rows(panel.sparkSession.read.parquet(told["shap"])), told["display"])
    return told


def display(args: argparse.Namespace, spark: SparkSession) -> dict:
    """The newest explanations of the output folder as they are shown."""
    found = files.newest(spark, args.output_dir, ".shap.parquet")
    files.write_display(shap.display_rows(spark.read.parquet(found)), args.output)
    return {"shap": found, "display": args.output}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    args = parse(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    apart = os.path.join(_HERE, "llm")
    code = [os.path.join(d, f) for d, _, names in os.walk(_HERE) for f in names if f.endswith(".py") and not d.startswith(apart)]
    told: dict = {}

    def stage(name, inputs, parameters, build):
        told[name] = cache.run_stage(spark, name, f"{args.cache_dir}/{name}", inputs, code, parameters, build, args.force)

    def holds(name):
        return told[name].path if name in told else cache.current(spark, f"{args.cache_dir}/{name}")

    if args.stage == "display":
        return display(args, spark)
    inputs = [f"{args.data_dir}/{n}" for n in names_in(spark, args.data_dir) if n.endswith(".csv")]
    if args.context_dir:
        inputs.append(f"{args.context_dir}/{files.TRAFFIC}")
    if args.stage in ("all", "data", "forecast") and not (args.stage == "forecast" and args.processed_data):
        stage("data", inputs, {}, lambda path: stages.build_merged(stages.sources_from_files(spark, args.data_dir, args.context_dir), path))
    if args.stage in ("all", "features"):
        merged = holds("data")
        stage("features", [merged], {"groups": args.feature_groups}, lambda path: stages.build_features(spark.read.parquet(merged), path, args.feature_groups))
    if args.stage in ("all", "train"):
        table = holds("features")

        def build(path: str) -> dict:
            return stages.train_and_evaluate(spark.read.parquet(table), f"{path}/report.json", args.model, args.holdout_days, args.config)

        stage("train", [table], {"model": args.model, "holdout": args.holdout_days, "config": str(args.config)}, build)
    if args.stage == "forecast":
        told |= forecast(args, spark.read.parquet(args.processed_data or holds("data")))
    return told


if __name__ == "__main__":
    main()
