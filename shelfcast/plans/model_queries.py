"""Queries of fitted models and explanations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metrics import NAMES
from ..operators import boosting, ensemble, forecaster, shap
from ..operators.learner import BoostConfig, Boosted
from ..sources.adapter import HORIZON, panel_sources
from .oracle import with_ctes
from .panel_queries import DATELESS, query, tidy

C = F.col
CONFIG = BoostConfig()


def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel_sources(spark, sf_dir).panel
    return p.withColumn("day_of_week", F.weekday("date") + 1)


X = ["promotion", "day_of_week"]


_FITTED: dict[str, tuple[tuple, dict]] = {}


def _models(spark: SparkSession, sf_dir: str, model: str = "boosted", panel: DataFrame | None = None) -> dict[int, list[Boosted]]:
    """Models of the next day, fitted once a session and folder: several queries read them.

    A query that reads the panel too gives it, since making it reads all sale lines.
    """
    key = (spark.sparkContext.applicationId, sf_dir, CONFIG)
    if _FITTED.get(model, (None,))[0] != key:
        panel = _panel(spark, sf_dir) if panel is None else panel
        _FITTED[model] = key, forecaster.TRAINERS[model](forecaster.supervised(panel, X), forecaster.SALES + X, CONFIG)
    return _FITTED[model][1]


@query()
def m10_quantile_boosting(spark, sf_dir):
    """The fitted models, one row a node."""
    return boosting.model_table(spark, _models(spark, sf_dir), forecaster.SALES + X)


@query()
def m13_recursive_forecast(spark, sf_dir):
    panel = _panel(spark, sf_dir)
    return tidy(forecaster.recursive_forecast(panel, _models(spark, sf_dir, panel=panel), X))


@query()
def m3_ensemble_weights(spark, sf_dir):
    """Members, weights and losses out of fold of the ensemble of the next day."""
    return tidy(ensemble.weight_table(spark, _models(spark, sf_dir, "ensemble")))


@query()
def m20_ensemble_recursion(spark, sf_dir):
    panel = _panel(spark, sf_dir)
    return tidy(forecaster.recursive_forecast(panel, _models(spark, sf_dir, "ensemble", panel), X))


@query()
def m14_direct_forecast(spark, sf_dir):
    p, leads = _panel(spark, sf_dir), list(range(1, HORIZON + 1))
    models = forecaster.train_models(forecaster.direct_rows(p, leads, X).filter("sales_count is not null"), forecaster.SALES + X, CONFIG)
    return tidy(forecaster.direct_forecast(p, leads, models, forecaster.SALES + X))


def _told(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explanations of every step of the recursive forecast: each test id and quantile."""
    panel, keys = _panel(spark, sf_dir), ["date", "store_id", "product_id"]
    models = _models(spark, sf_dir, panel=panel)
    rows = forecaster.recursive_rows(panel, models, X).join(panel.select("id", *keys), keys)
    return shap.shap_long(rows, models[0], forecaster.SALES + X, ["id", *keys])


@query()
def m12_scores_as_columns(spark, sf_dir):
    """Raw forecasts of the next day for every row with a history, by column expressions."""
    panel = _panel(spark, sf_dir)
    rows = forecaster.supervised(panel, X)
    got = boosting.scored(rows, _models(spark, sf_dir, panel=panel)[0], forecaster.SALES + X, [f"raw_{n}" for n in NAMES])
    return tidy(got.select("date", "store_id", "product_id", *[f"raw_{n}" for n in NAMES]))


@query()
def m18_shap_long(spark, sf_dir):
    return tidy(_told(spark, sf_dir))


FEATURES = [c for cols in shap.BUCKETS.values() for c in cols]


def derived_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contributions of every test row and quantile by a fixed rule of its key."""
    p = panel_sources(spark, sf_dir).panel.filter("dataset_split = 'test'")
    rows = p.select("id", F.dayofmonth("date").alias("d"), C("store_id").alias("s"), F.explode(F.array(*[F.lit(q) for q in (0.25, 0.5, 0.75, 0.95)])).alias("quantile"))
    parts = [(((C("d") + C("s") * 5 + k * 7 + F.lit(k % 3) * (C("quantile") * 20).cast("int")) % 23 - 11) / 10.0).alias(f"shap_{c}") for k, c in enumerate(FEATURES)]
    rows = rows.select("id", "quantile", (C("d") / 10.0).alias("base_value"), *parts)
    return rows.withColumn("raw_model", C("base_value") + shap.total(shap.contributions(rows)))


def _k(k: int) -> str:
    return f"((d + s * 5 + {k * 7} + {k % 3} * CAST(floor(quantile * 20) AS INTEGER)) % 23 - 11) / 10.0"


_ROWS = "SELECT id, day(date) AS d, store_id AS s, CAST(unnest([0.25, 0.5, 0.75, 0.95]) AS DOUBLE) AS quantile FROM test_rows"
_BUCKETS = ", ".join(f"round({' + '.join(_k(FEATURES.index(c)) for c in cols)}, 2) AS contrib_{b}" for b, cols in shap.BUCKETS.items())
DATELESS |= {"m19_shap_buckets", "v13_additivity", "t9_top_factors", "m10_quantile_boosting", "m3_ensemble_weights"}


@query(with_ctes(f"SELECT id, quantile, round(exp(d / 10.0) - 1, 2) AS base_units, {_BUCKETS} FROM ({_ROWS})", "test_rows"))
def m19_shap_buckets(spark, sf_dir):
    return shap.buckets(derived_contributions(spark, sf_dir), ["id"])


@query(with_ctes(f"SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS off FROM ({_ROWS})", "test_rows"))
def v13_additivity(spark, sf_dir):
    return shap.additivity(_told(spark, sf_dir))


_PAIRS = "\nUNION ALL ".join(f"SELECT id, quantile, '{b}' AS factor, contrib_{b} AS value FROM b" for b in shap.BUCKETS)


@query(
    with_ctes(f"SELECT id, quantile, CAST(row_number() OVER (PARTITION BY id, quantile ORDER BY abs(value) DESC, factor) AS INTEGER) AS rank, factor, value FROM (WITH b AS (SELECT id, quantile, {_BUCKETS} FROM ({_ROWS})) {_PAIRS}) WHERE abs(value) >= 0.05 QUALIFY rank <= 4", "test_rows")
)
def t9_top_factors(spark, sf_dir):
    return shap.top_factors(shap.buckets(derived_contributions(spark, sf_dir), ["id"]), ["id"])
