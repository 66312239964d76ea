"""Losses, quantile rules and small scalar functions as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The forecast quantiles and their column names.
QUANTILES = (0.25, 0.5, 0.75, 0.95)
NAMES = tuple(f"p{int(q * 100)}" for q in QUANTILES)


def pinball(actual: Column, forecast: Column, q: float | Column) -> Column:
    e = actual - forecast
    return F.greatest(e * q, e * (q - 1))


def at_least_zero(c: Column) -> Column:
    """Clip below at 0; null stays null."""
    return F.when(c < 0, 0.0).otherwise(c)


def log_pinball(actual: Column, forecast: Column, q: float | Column) -> Column:
    """Pinball loss of log1p values, the forecast clipped at 0."""
    return pinball(F.log1p(actual), F.log1p(at_least_zero(forecast)), q)


def weighted_score(df: DataFrame, actual: str = "sales_count", weight: str = "weight") -> DataFrame:
    """Sum of weighted losses over four times the sum of weights."""
    losses = sum(log_pinball(F.col(actual), F.col(n), q) for n, q in zip(NAMES, QUANTILES, strict=True))
    return df.agg((F.sum(F.col(weight) * losses) / (len(QUANTILES) * F.sum(weight))).alias("score"))


def loss_report(df: DataFrame, actual: str = "sales_count") -> DataFrame:
    """Mean log-pinball loss of each quantile."""
    pairs = F.array(*[F.struct(F.lit(q).alias("quantile"), log_pinball(F.col(actual), F.col(n), q).alias("loss")) for n, q in zip(NAMES, QUANTILES, strict=True)])
    return df.select(F.explode(pairs).alias("x")).groupBy("x.quantile").agg(F.avg("x.loss").alias("mean_log_pinball"), F.count("*").alias("n_rows"))


def running_max(df: DataFrame) -> DataFrame:
    """Quantile columns made coherent by carrying the largest so far."""
    return df.withColumns({n: F.greatest(*[F.col(m) for m in NAMES[: i + 1]]) if i else F.col(n) for i, n in enumerate(NAMES)})


def sorted_quantiles(df: DataFrame) -> DataFrame:
    """Clipped quantile columns in ascending order, with the quantile each came from.

    Equal values keep their order. Adds source_<name>.
    """
    found = F.array_sort(F.array(*[F.struct(at_least_zero(F.col(n)).alias("v"), F.lit(i).alias("i")) for i, n in enumerate(NAMES)]))
    qs = F.array(*map(F.lit, QUANTILES))
    df = df.withColumn("_s", found)
    out = {}
    for i, n in enumerate(NAMES):
        out[n] = F.col("_s")[i]["v"]
        out[f"source_{n}"] = F.get(qs, F.col("_s")[i]["i"])
    return df.withColumns(out).drop("_s")


def is_monotonic() -> Column:
    a, b, c, d = (F.col(n) for n in NAMES)
    return (a <= b) & (b <= c) & (c <= d)


def round_half_up(c: Column) -> Column:
    """Whole number as browsers round: halves go up."""
    return F.floor(c + 0.5)


def nice_maximum(c: Column) -> Column:
    """Smallest of 1, 2, 5, 10 times a power of ten that is not below ``c``."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(c)))
    step = c / power
    return F.when(c <= 0, 1.0).otherwise(F.when(step <= 1, 1.0).when(step <= 2, 2.0).when(step <= 5, 5.0).otherwise(10.0) * power)


def date_label(c: Column) -> Column:
    return F.date_format(c, "MMM d")


def csv_cell(c: Column) -> Column:
    """A quoted cell; quotes inside are doubled."""
    return F.concat(F.lit('"'), F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
