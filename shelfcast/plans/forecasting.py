"""Forecasts from end to end: strategies, rolling evaluation, guarded submission, explanations."""

from __future__ import annotations

from datetime import timedelta
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import NAMES, QUANTILES, is_monotonic, log_pinball
from ..operators import forecaster, shap
from ..operators.learner import BoostConfig, Boosted
from ..operators.validation import is_finite
from ..sources.schemas import SERIES

C = F.col
STRATEGIES = ("recursive", "direct")
def horizon(panel: DataFrame) -> int:
    """Days after the last one with sales."""
    return panel.agg(F.datediff(F.max("date"), F.max(F.when(C("sales_count").isNotNull(), C("date")))).alias("n")).first().n or 0


def fitted(panel: DataFrame, columns: list[str], strategy: str, days: int, config: BoostConfig, model: str = "boosted") -> dict[int, list[Boosted]]:
    """Models by lead: those of the next day under lead 0, or one set a lead from 1 on."""
    return forecaster.TRAINERS[model](_rows(panel, columns, strategy, days), forecaster.SALES + columns, config)


def _rows(panel: DataFrame, columns: list[str], strategy: str, days: int) -> DataFrame:
    """Training rows of a strategy: lead, key, target, features."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy is one of {', '.join(STRATEGIES)}")
    if strategy == "recursive":
        return forecaster.supervised(panel, columns).withColumn("lead", F.lit(0))
    return forecaster.direct_rows(panel, list(range(1, days + 1)), columns).filter("sales_count is not null")


def forecast(panel: DataFrame, models: dict[int, list[Boosted]], columns: list[str], strategy: str, days: int, config: BoostConfig) -> DataFrame:
    if strategy == "direct":
        return forecaster.direct_forecast(panel, list(range(1, days + 1)), models, forecaster.SALES + columns, config.log_sales)
    return forecaster.recursive_forecast(panel, models, columns, config.log_sales)


#: Leads of one window are numbered from the window times this.
_WINDOW = 10_000


def rolling_evaluation(panel: DataFrame, columns: list[str], windows: int = 3, holdout: int = 28, strategy: str = "recursive", config: BoostConfig = BoostConfig(), train_days: int | None = None, model: str = "boosted") -> dict:
    """Log-pinball losses of forecasts made from rolling origins, the latest after ``train_days``.

    All windows are fitted side by side and judged in one job. A training row's features
    look back only, so a window takes those of targets before its origin; its
    forecasts start from a panel whose sales from the origin on are taken away, so no
    feature, flag or model of a window has seen its held-out days. By default the
    last window ends on the last day with sales.
    """
    if windows < 1 or holdout < 1:
        raise ValueError("windows and holdout are 1 at least")
    known = panel.filter("sales_count is not null")
    span = known.agg(F.min("date").alias("first"), F.max("date").alias("last")).first()
    days = (span.last - span.first).days + 1
    latest = days - holdout if train_days is None else train_days
    origins = [latest - k * holdout for k in reversed(range(windows))]
    if origins[0] <= forecaster.HISTORY or latest + holdout > days:
        raise ValueError("the windows do not fit within the history")
    starts = [span.first + timedelta(days=origin) for origin in origins]
    training = known.withColumn("dataset_split", F.lit("train"))
    upto = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(start).alias("start")) for w, start in enumerate(starts)])
    rows = _rows(training, columns, strategy, holdout).withColumn("_w", F.explode(upto)).filter(C("date") < C("_w.start"))
    models = forecaster.TRAINERS[model](rows.withColumn("lead", C("_w.w") * _WINDOW + C("lead")).drop("_w"), forecaster.SALES + columns, config)
    parts = [
        known.filter(C("date") < F.lit(start + timedelta(days=holdout))).withColumns({"dataset_split": F.when(C("date") < F.lit(start), "train").otherwise("test"), "sales_count": F.when(C("date") < F.lit(start), C("sales_count"))})
        for start in starts
    ]
    if strategy == "recursive":
        panels = reduce(DataFrame.unionByName, [p.withColumn("lead", F.lit(w * _WINDOW)) for w, p in enumerate(parts)])
        made = forecaster.recursive_rows(panels, models, columns, config.log_sales).withColumn("window", F.floor(C("lead") / _WINDOW))
    else:
        mine = [{lead - w * _WINDOW: m for lead, m in models.items() if lead // _WINDOW == w} for w in range(windows)]
        made = reduce(DataFrame.unionByName, [forecast(p, mine[w], columns, strategy, holdout, config).withColumn("window", F.lit(w)) for w, p in enumerate(parts)])
    actual = known.select(C("date"), *[C(c).cast(t).alias(c) for c, t in (("store_id", "int"), ("product_id", "string"))], C("sales_count"))
    losses = [F.avg(log_pinball(C("sales_count"), C(n), q)).alias(f"pinball_{n}") for n, q in zip(NAMES, QUANTILES, strict=True)]
    found = {r.window: r.asDict() for r in made.join(actual, ["date", *SERIES]).groupBy("window").agg(F.count("*").alias("n_rows"), *losses).collect()}
    told = []
    for w, start in enumerate(starts):
        got = {k: v for k, v in found[w].items() if k != "window"}
        got["mean_pinball"] = sum(got[f"pinball_{n}"] for n in NAMES) / len(NAMES)
        told.append(got | {"train_end": str(start - timedelta(days=1)), "holdout_start": str(start), "holdout_end": str(start + timedelta(days=holdout - 1))})
    means = {k: sum(w[k] for w in told) / windows for k in (*(f"pinball_{n}" for n in NAMES), "mean_pinball")}
    return means | {
        "train_start": str(span.first),
        "train_end": told[-1]["train_end"],
        "holdout_start": told[0]["holdout_start"],
        "holdout_end": told[-1]["holdout_end"],
        "model": model,
        "forecast_strategy": strategy,
        "target_transform": "log1p" if config.log_sales else "identity",
        "eval_windows": windows,
        "eval_holdout_days": holdout,
        "windows": told,
    }


def guarded_submission(made: DataFrame, test: DataFrame) -> DataFrame:
    """Every row of ``test`` with its forecast.

    Raises if a test row has no forecast, ids repeat, a quantile is null, NaN or
    infinite, or quantiles cross. ``made`` is read twice; keep it before.
    """
    rows = test.join(made.withColumn("_made", F.lit(True)), ["date", *SERIES], "left")
    whole = reduce(lambda a, b: a & b, [F.coalesce(is_finite(C(n)), F.lit(False)) for n in NAMES])
    got = rows.agg(
        F.count("*").alias("n"),
        F.count_distinct("id").alias("ids"),
        F.count_if(C("_made").isNull()).alias("missing"),
        F.count_if(C("_made").isNotNull() & ~whole).alias("values"),
        F.count_if(whole & ~is_monotonic()).alias("crossed"),
    ).first()
    faults = {"test rows without a forecast": got.missing, "rows with missing values": got["values"], "rows whose quantiles cross": got.crossed, "repeated or null ids": got.n - got.ids}
    if wrong := [f"{n} {what}" for what, n in faults.items() if n]:
        raise ValueError("submission: " + ", ".join(wrong))
    return rows.drop("_made")


def sidecar(panel: DataFrame, models: list[Boosted], columns: list[str], config: BoostConfig) -> DataFrame:
    """Explanations of each step of the recursive forecast: four rows a test id."""
    keys = ["date", *SERIES]
    rows = forecaster.recursive_rows(panel, {0: models}, columns, config.log_sales).join(panel.select("id", *keys), keys)
    told = shap.shap_long(rows, models, forecaster.SALES + columns, ["id", *keys], config.log_sales)
    return told.withColumn("target_transform", F.lit("log1p" if config.log_sales else "identity"))
