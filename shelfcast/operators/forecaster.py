"""Quantile forecasts: boosted models, recursion over many series at once, direct leads."""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import NAMES, QUANTILES
from ..sources.schemas import SERIES
from ..sources.shared import importable
from .baseline import HISTORY, direct_supervised, historical_quantiles
from .boosting import fit_models
from .ensemble import Blend, default_members, train_ensemble
from .features import forecaster_features
from .learner import BoostConfig, Boosted
from .stockout import LOOKBACK, POSITIVE_DAYS, POSITIVE_RATE, TYPICAL_SALES, add_stockout_flag

C = F.col
#: The sales features in the order models take them.
SALES = ["sales_lag_1", "sales_lag_7", "sales_lag_14", "sales_lag_28", "sales_mean_7", "sales_std_7", "sales_mean_28", "sales_std_28", "likely_stockout_lag_1"]
#: Context columns that are names of things, not amounts.
CATEGORICAL = ["store_id", "product_family", "product_class", "city", "department", "store_type", "store_cluster"]
#: Rows of history and horizon in one group of the recursion, about: some thousand series.
GROUP_ROWS = 200_000
#: Context groups of the forecaster and their columns.
CONTEXT = {
    "promotion": ["promotion"],
    "product": ["product_family", "product_class", "is_perishable"],
    "store": ["store_id", "city", "department", "store_type", "store_cluster"],
    "calendar": ["year", "month", "day", "day_of_week", "week_of_year", "is_weekend"],
    "event": [
        "event_count", "effective_event_count", "is_event_day", "is_effective_event_day", "has_holiday", "is_effective_holiday",
        "days_until_effective_holiday", "days_since_effective_holiday", "has_transfer", "has_additional", "has_special_event",
        "has_national_event", "has_regional_event", "has_local_event", "has_effective_national_event",
        "has_effective_regional_event", "has_effective_local_event", "has_transferred_event",
    ],
    "oil": ["oil_price", "oil_price_source_missing"],
    "traffic": ["traffic_lag_1", "traffic_mean_7", "traffic_mean_28", "traffic_ratio_7_28", "traffic_source_missing"],
}


def parse_context(raw: str) -> tuple[str, ...]:
    """Context groups in their own order; 'sales' is always there, 'all' means all."""
    asked = {x.strip() for x in raw.split(",") if x.strip()}
    if "all" in asked:
        return tuple(CONTEXT)
    if unknown := sorted(asked - set(CONTEXT) - {"sales"}):
        raise ValueError(f"unknown context groups: {', '.join(unknown)}")
    return tuple(g for g in CONTEXT if g in asked)


def last_day_flags(history: np.ndarray) -> np.ndarray:
    """The stockout rule for the last day of each series, judged on the days before it.

    A row is a series, NaN stands where it has no day yet.
    """
    past = history[:, -LOOKBACK - 1 : -1]
    sold = np.where(past > 0, past, np.nan)
    positive, days = (past > 0).sum(axis=1), (~np.isnan(past)).sum(axis=1)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", RuntimeWarning)  # series without a sale have no median
        typical = np.nanmedian(sold, axis=1) if past.shape[1] else np.full(len(past), np.nan)
    return (history[:, -1] == 0) & (positive >= POSITIVE_DAYS) & (typical >= TYPICAL_SALES) & (positive >= POSITIVE_RATE * days)


def features_for_next(history: np.ndarray) -> np.ndarray:
    """[series, feature]: sales features of the day after ``history`` [series, day]."""
    h = np.atleast_2d(np.asarray(history, float))
    week, month = h[:, -7:], h[:, -28:]
    return np.column_stack([*(h[:, -k] for k in (1, 7, 14, 28)), week.mean(axis=1), week.std(axis=1), month.mean(axis=1), month.std(axis=1), last_day_flags(h)])


def supervised(panel: DataFrame, context: list[str]) -> DataFrame:
    """Rows with a full history: key, target, sales features, context.

    A context column that is a key stays the key.
    """
    context = [c for c in context if c not in SERIES]
    flagged = add_stockout_flag(panel)
    n = F.row_number().over(Window.partitionBy(*SERIES).orderBy("date"))
    rows = forecaster_features(flagged).join(panel.withColumn("_n", n).filter(C("_n") > HISTORY).select("date", *SERIES, "sales_count", *context), ["date", *SERIES])
    return rows.filter("sales_count is not null").select("date", *SERIES, "sales_count", *[F.coalesce(C(c).cast("double"), F.lit(0.0)).alias(c) for c in SALES + context])


def train_models(rows: DataFrame, columns: list[str], config: BoostConfig = BoostConfig()) -> dict[int, list[Boosted]]:
    """Models by lead, in the order of the quantiles, fitted to all rows.

    ``rows`` may have a lead column; without one the lead is 0.
    """
    return fit_models(rows, columns, ["date", *SERIES], config, [c for c in columns if c in CATEGORICAL])


def train_blends(rows: DataFrame, columns: list[str], config: BoostConfig = BoostConfig()) -> dict[int, list[Blend]]:
    """Ensembles by lead around the booster of ``config``; they stand wherever models do."""
    return train_ensemble(rows, columns, ["date", *SERIES], default_members(config), [c for c in columns if c in CATEGORICAL])


#: Fits by name of what recursion, direct leads and explanations take as models.
TRAINERS = {"boosted": train_models, "ensemble": train_blends}


def coherent(raw: np.ndarray, log_sales: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Back-transformed, clipped and sorted quantiles of each row, and where each came from."""
    values = np.maximum(np.expm1(raw) if log_sales else raw, 0)
    order = np.argsort(values, axis=1, kind="stable")
    return np.take_along_axis(values, order, axis=1), np.array(QUANTILES)[order]


_OUT = "date date, store_id int, product_id string, " + ", ".join(f"{n} double" for n in NAMES)


def recursive_rows(panel: DataFrame, models: dict[int, list[Boosted]], context: list[str], log_sales: bool = True) -> DataFrame:
    """Forecasts of the days without sales and the features that each was made from.

    Each day's median feeds the next. A group holds the last days and the horizon
    of many series; one day of all of them is a matrix, so a model is called once a
    day and group. ``panel`` may have a lead column that tells which models a row is for, as
    windows of an evaluation have; without one the lead is 0. A feature that is a key stays the key.
    """
    importable(panel.sparkSession)
    features = [c for c in SALES + context if c not in SERIES]
    panel = panel if "lead" in panel.columns else panel.withColumn("lead", F.lit(0))
    rows = panel.select("lead", "date", *SERIES, "sales_count", *[F.coalesce(C(c).cast("double"), F.lit(0.0)).alias(f"x_{c}") for c in context])
    last = panel.filter("sales_count is not null").groupBy("lead").agg(F.max("date").alias("_last"))
    near = rows.join(F.broadcast(last), "lead").filter(C("date") > F.date_sub("_last", 2 * HISTORY + 1)).drop("_last")
    # a group costs its calls of the models, however few series it has
    groups = max(1, math.ceil(near.count() / GROUP_ROWS))
    near = near.withColumn("_group", F.pmod(F.xxhash64("lead", *SERIES), groups))
    spec = "lead int, " + _OUT + "".join(f", `{c}` double" for c in features)

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        lead = key[1]
        part = part.sort_values([*SERIES, "date"]).reset_index(drop=True)
        series = part.groupby(SERIES, sort=False).ngroup().to_numpy()
        n = series.max() + 1
        known = part["sales_count"].notna().to_numpy()
        history = np.full((n, 2 * HISTORY + 1), np.nan)
        past = part[known].groupby(series[known], sort=False)
        back = past.cumcount(ascending=False).to_numpy()
        take = back < history.shape[1]
        history[series[known][take], -1 - back[take]] = part["sales_count"].to_numpy(float)[known][take]
        history[:, -HISTORY:] = np.nan_to_num(history[:, -HISTORY:], nan=0.0)
        ahead = part[~known]
        of, step = series[~known], ahead.groupby(series[~known], sort=False).cumcount().to_numpy()
        x = ahead[[f"x_{c}" for c in context]].to_numpy(float) if context else np.empty((len(ahead), 0))
        out, seen = np.zeros((len(ahead), len(NAMES))), np.zeros((len(ahead), len(SALES) + len(context)))
        for day in range(step.max() + 1 if len(ahead) else 0):
            at = np.flatnonzero(step == day)
            seen[at] = np.column_stack([features_for_next(history[of[at]]), x[at]])
            out[at], _ = coherent(np.column_stack([m.predict(seen[at]) for m in models[lead]]), log_sales)
            history[of[at]] = np.column_stack([history[of[at], 1:], out[at, 1]])
        made = ahead[["date", *SERIES]].reset_index(drop=True)
        made.insert(0, "lead", lead)
        told = pd.DataFrame(seen, columns=SALES + context)[features]
        return pd.concat([made, pd.DataFrame(out, columns=list(NAMES)), told], axis=1)

    return near.groupBy("_group", "lead").applyInPandas(run, spec)


def recursive_forecast(panel: DataFrame, models: dict[int, list[Boosted]], context: list[str], log_sales: bool = True) -> DataFrame:
    """Forecast the days without sales, feeding each day's median to the next."""
    return recursive_rows(panel, models, context, log_sales).select("date", *SERIES, *NAMES)


def direct_rows(panel: DataFrame, leads: list[int], context: list[str]) -> DataFrame:
    """Sales features as known on the origin, context of the target day, one row a target and lead."""
    rows = direct_supervised(panel, leads, tuple(c for c in context if c not in SERIES))
    return rows.select("date", *SERIES, "sales_count", "lead", *[F.coalesce(C(c).cast("double"), F.lit(0.0)).alias(c) for c in SALES + context if c not in SERIES])


def direct_forecast(panel: DataFrame, leads: list[int], models: dict[int, list[Boosted]], columns: list[str], log_sales: bool = True) -> DataFrame:
    """Forecast each horizon day by the models of its lead, from what the last day knew."""
    importable(panel.sparkSession)
    last = panel.filter("sales_count is not null").agg(F.max("date").alias("_last"))
    rows = direct_rows(panel, leads, [c for c in columns if c not in SALES])
    rows = rows.crossJoin(F.broadcast(last)).filter(F.datediff("date", "_last") == C("lead")).drop("_last", "sales_count")

    def run(parts):
        for part in parts:
            made = part[["date", *SERIES]].copy()
            values = np.zeros((len(part), len(NAMES)))
            for lead, at in part.groupby("lead").indices.items():
                raw = np.stack([m.predict(part.iloc[at][columns].to_numpy(float)) for m in models[lead]], axis=1)
                values[at] = coherent(raw, log_sales)[0]
            for k, n in enumerate(NAMES):
                made[n] = values[:, k]
            yield made

    return rows.mapInPandas(run, _OUT)


@dataclass(frozen=True)
class Predictor:
    """A registered model: (train, rows, features, config) -> rows with quantiles."""

    name: str
    run: Callable[[DataFrame, DataFrame, list[str], BoostConfig], DataFrame]


def _historical(train, rows, columns, config):
    return historical_quantiles(train, rows)


def _fitted(fit: Callable, train, rows, columns, config):
    filled = [F.coalesce(C(c).cast("double"), F.lit(-1.0)).alias(c) for c in columns]
    models = fit(train.select("date", *SERIES, "sales_count", *filled), columns, config)[0]
    numbers = [f"_x{k}" for k in range(len(columns))]
    wide = rows.select("*", *[F.coalesce(C(c).cast("double"), F.lit(-1.0)).alias(n) for c, n in zip(columns, numbers, strict=True)])
    schema = wide.drop(*numbers).schema
    for n in NAMES:
        schema = schema.add(n, "double")

    def run(parts):
        for part in parts:
            raw = np.stack([m.predict(part[numbers].to_numpy(float)) for m in models], axis=1)
            raw = np.maximum.accumulate(np.maximum(np.expm1(raw) if config.log_sales else raw, 0), axis=1)
            part = part.drop(columns=numbers)
            for k, n in enumerate(NAMES):
                part[n] = raw[:, k]
            yield part

    return wide.mapInPandas(run, schema)


def _optional(module: str):
    def run(train, rows, columns, config):
        raise RuntimeError(f"{module} is not installed here; register a predictor for it")

    return run


#: Models by name; more can be registered.
PREDICTORS: dict[str, Predictor] = {p.name: p for p in (Predictor("historical", _historical), *(Predictor(n, partial(_fitted, fit)) for n, fit in TRAINERS.items()), *(Predictor(n, _optional(n)) for n in ("lightgbm", "autogluon")))}


def predictor(name: str) -> Predictor:
    if name not in PREDICTORS:
        raise ValueError(f"unknown model {name!r}; there are {', '.join(sorted(PREDICTORS))}")
    return PREDICTORS[name]
