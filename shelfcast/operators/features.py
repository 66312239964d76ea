"""Stage 2: selectable groups of features that look at earlier days only.

Each group is a function from the two windows it may need to named columns, so
all chosen columns of one window share a single sort. Row-based frames need a
panel without missing days.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..sources.schemas import EVENT_FLAGS, SERIES
from .joins import unique_by

PREFIX = "feature_"
C = F.col


def _flag(c: Column | str) -> Column:
    return (C(c) if isinstance(c, str) else c).cast("byte")


def _past(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-n, -1)


def _at_least(m: int, c: Column, value: Column, frame: WindowSpec) -> Column:
    return F.when(F.count(c).over(frame) >= m, value)


def identity(w):
    return {"store_id": C("store_id"), "product_id": C("product_id")}


def promotion(w):
    return {"promotion": _flag("promotion")}


def calendar(w):
    return {c: C(c) for c in ("year", "month", "day", "day_of_week", "week_of_year")} | {"is_weekend": _flag("is_weekend")}


def product(w):
    return {"product_family": C("code_product_family"), "product_class": C("product_class"), "is_perishable": _flag("is_perishable")}


def store(w):
    return {"city": C("code_city"), "department": C("code_department"), "store_type": C("code_store_type"), "store_cluster": C("store_cluster")}


_NUMBERS = ["oil_price", "traffic_lag_1", "traffic_mean_7", "traffic_mean_28", "traffic_ratio_7_28", "event_count", "effective_event_count", "days_until_effective_holiday", "days_since_effective_holiday"]
_FLAGS = ["oil_price_source_missing", "traffic_source_missing", "is_event_day", "is_effective_event_day", "is_1d_before_holiday", "is_2d_before_holiday", *EVENT_FLAGS]


def external(w):
    return {c: C(c) for c in _NUMBERS} | {c: _flag(c) for c in _FLAGS}


def sales_history(w):
    s = C("sales_count")
    out = {f"sales_lag_{k}": F.lag(s, k).over(w) for k in (1, 7, 14, 28)}
    for n in (7, 28):
        out[f"sales_mean_{n}"] = F.avg(s).over(_past(w, n))
        out[f"sales_std_{n}"] = F.stddev_samp(s).over(_past(w, n))
    return out | {"likely_stockout_lag_1": _flag(F.coalesce(F.lag("is_likely_stockout", 1).over(w), F.lit(False)))}


def promotion_regime(w):
    p = C("promotion")
    lag = {k: F.coalesce(F.lag(p, k).over(w), F.lit(False)) for k in (1, 2, 3, 7)}
    out = {f"promotion_lag_{k}": _flag(v) for k, v in lag.items()}
    out |= {f"promotion_count_{n}": F.sum(p.cast("int")).over(_past(w, n)) for n in (7, 28)}
    return out | {
        "promotion_start": _flag(p & ~lag[1]),
        "post_promotion_1d": _flag(~p & lag[1]),
        "post_promotion_2d": _flag(~p & ~lag[1] & lag[2]),
        "post_promotion_3d": _flag(~p & ~lag[1] & ~lag[2] & lag[3]),
        "promotion_perishable": _flag(p & C("is_perishable")),
        "promotion_effective_holiday": _flag(p & C("is_effective_holiday")),
    }


def seasonal_history(w):
    s = C("sales_count")
    out = {f"sales_lag_{k}": F.lag(s, k).over(w) for k in (2, 3, 4, 5, 6, 8, 21, 35, 42, 56)}
    weeks = F.filter(F.array(*[F.lag(s, k).over(w) for k in (7, 14, 21, 28)]), lambda x: x.isNotNull())
    total = F.aggregate(weeks, F.lit(0.0), lambda a, x: a + x)
    m7, m28 = F.avg(s).over(_past(w, 7)), F.avg(s).over(_past(w, 28))
    return out | {
        "same_weekday_mean_4": F.try_divide(total, F.size(weeks)),
        "sales_median_7": F.percentile(s, 0.5).over(_past(w, 7)),
        "sales_median_28": F.percentile(s, 0.5).over(_past(w, 28)),
        "sales_max_28": F.max(s).over(_past(w, 28)),
        "sales_trend_7_28": m7 - m28,
        "sales_ratio_7_28": m7 / (m28 + 1.0),
    }


def intermittency(w):
    s = C("sales_count")
    zero = [F.lag(s, k).over(w) == 0 for k in (1, 2, 3)]
    out = {f"zero_rate_{n}": F.avg((s == 0).cast("int")).over(_past(w, n)) for n in (7, 28, 56)}
    out |= {f"nonzero_mean_{n}": F.avg(F.when(s > 0, s)).over(_past(w, n)) for n in (28, 56)}
    out |= {"zero_run_3": _flag(zero[0] & zero[1] & zero[2])}
    out |= {f"stockout_rate_{n}": F.avg(C("is_likely_stockout").cast("int")).over(_past(w, n)) for n in (7, 28)}
    return out | {"sales_cv_28": F.stddev_samp(s).over(_past(w, 28)) / (F.avg(s).over(_past(w, 28)) + 1.0)}


#: Days of the month on which salaries are paid.
PAYDAYS = (3, 18)


def payday(w):
    d = C("day")
    near = {"is_payday": 0, "is_1d_before_payday": -1, "is_2d_before_payday": -2, "is_1d_after_payday": 1, "is_2d_after_payday": 2}
    return {n: _flag(d.isin([x + k for x in PAYDAYS])) for n, k in near.items()} | {"promotion_payday": _flag(C("promotion") & d.isin(list(PAYDAYS)))}


def holiday_regime(w):
    before = C("is_1d_before_holiday") | C("is_2d_before_holiday")
    around = C("is_effective_holiday") | before
    return {
        "effective_holiday_window": _flag(around),
        "promotion_before_holiday": _flag(C("promotion") & before),
        "perishable_holiday_window": _flag(C("is_perishable") & around),
        "local_event_promotion": _flag(C("has_effective_local_event") & C("promotion")),
    }


def nearest_quantile(values: Column, q: float) -> Column:
    """Element of a sorted array at the rank nearest to (n - 1) * q, half up."""
    return F.try_element_at(values, (F.floor((F.size(values) - 1) * q + 0.5) + 1).cast("int"))


def behavioral_profile(w):
    s, p, f = C("sales_count"), C("promotion"), _past(w, 56)
    ordered = F.array_sort(F.collect_list(s).over(f))
    out = {f"profile_p{int(q * 100)}_56": _at_least(7, s, nearest_quantile(ordered, q), f) for q in (0.25, 0.75, 0.95)}
    promoted, regular = F.avg(F.when(p, s)).over(f), F.avg(F.when(~p, s)).over(f)
    return out | {"profile_p50_56": _at_least(7, s, F.percentile(s, 0.5).over(f), f), "promoted_mean_56": promoted, "regular_mean_56": regular, "promotion_uplift_56": promoted - regular}


def oil_trend(w):
    o = C("oil_price")
    out = {f"oil_lag_{k}": F.lag(o, k).over(w) for k in (30, 60, 90)}
    out |= {f"oil_mean_{n}": _at_least(7, o, F.avg(o).over(_past(w, n)), _past(w, n)) for n in (30, 60, 90)}
    return out | {"oil_change_30_90": F.lag(o, 30).over(w) - F.lag(o, 90).over(w)}


def hierarchy(w):
    """Columns that :func:`add_hierarchy` has joined."""
    return {f"{g}_mean_{n}": C(f"{g}_mean_{n}") for g in LEVELS for n in (7, 28)}


#: The levels of the hierarchy group and the keys of their daily means.
LEVELS = {"product": ["product_id"], "store": ["store_id"], "store_family": ["store_id", "product_family"]}
BASE = ["promotion", "calendar", "product", "store", "external", "sales_history"]
EXTRAS = ["promotion_regime", "seasonal_history", "intermittency", "payday", "holiday_regime", "behavioral_profile"]
GROUPS: dict[str, Callable[[WindowSpec], dict[str, Column]]] = {
    f.__name__: f for f in (identity, promotion, calendar, product, store, external, sales_history, promotion_regime, seasonal_history, intermittency, payday, holiday_regime, behavioral_profile, oil_trend, hierarchy)
}
PRESETS = {"best": BASE + EXTRAS, "all": list(GROUPS)}


def parse_groups(raw: str | list[str]) -> tuple[str, ...]:
    """Group and preset names, separated by commas; repeats are dropped, order stays."""
    names = [x.strip() for x in raw.split(",")] if isinstance(raw, str) else list(raw)
    wide = [g for n in names if n for g in PRESETS.get(n, [n])]
    unknown = sorted(set(wide) - set(GROUPS))
    if unknown:
        raise ValueError(f"unknown feature groups: {', '.join(unknown)}; there are {', '.join(GROUPS)}")
    if not wide:
        raise ValueError("no feature group is chosen")
    return tuple(dict.fromkeys(wide))


def coded(df: DataFrame, column: str) -> DataFrame:
    """Adds code_<column>: the place of a value among the sorted distinct values."""
    values = df.select(C(column).cast("string").alias(column)).filter(C(column).isNotNull()).distinct()
    codes = values.agg(F.array_sort(F.collect_set(column)).alias("_values"))
    return df.crossJoin(F.broadcast(codes)).withColumn(f"code_{column}", (F.array_position("_values", C(column).cast("string")) - 1).cast("int")).drop("_values")


def with_codes(df: DataFrame, groups: tuple[str, ...]) -> DataFrame:
    """Codes of the categories that the chosen groups use; each has few values."""
    for g, columns in (("product", ["product_family"]), ("store", ["city", "department", "store_type"])):
        if g in groups:
            for c in columns:
                df = coded(df, c)
    return df


def lagged_level_means(df: DataFrame, level: str) -> DataFrame:
    """Trailing means of a level's daily mean, of days before each day."""
    keys = LEVELS[level]
    w = Window.partitionBy(*keys).orderBy("date")
    daily = df.groupBy("date", *keys).agg(F.avg("sales_count").alias("_m"))
    return daily.select("date", *keys, *[F.avg("_m").over(_past(w, n)).alias(f"{level}_mean_{n}") for n in (7, 28)])


def add_hierarchy(df: DataFrame) -> DataFrame:
    for level, keys in LEVELS.items():
        df = df.join(lagged_level_means(df.select("date", "store_id", "product_id", "product_family", "sales_count"), level), ["date", *keys], "left")
    return df


def features(df: DataFrame, groups: tuple[str, ...], keep: list[str]) -> DataFrame:
    """``keep`` and the chosen features, in double precision, prefixed."""
    w = Window.partitionBy(*SERIES).orderBy("date")
    df = with_codes(df, groups)
    if "hierarchy" in groups:
        df = add_hierarchy(df)
    columns = {PREFIX + n: c for g in groups for n, c in GROUPS[g](w).items()}
    return df.select(*keep, *[c.alias(n) for n, c in columns.items()])


def as_float(df: DataFrame) -> DataFrame:
    """Feature columns in the width models are trained on."""
    return df.select(*[C(n).cast("float").alias(n) if n.startswith(PREFIX) and t in ("double", "bigint", "decimal") else C(n) for n, t in df.dtypes])


def training_features(merged: DataFrame, groups: tuple[str, ...]) -> DataFrame:
    """Features of the training split with its key, id and target."""
    train = merged.filter(C("dataset_split") == "train")
    return as_float(features(train, groups, ["date", "store_id", "product_id", "id", "sales_count"]))


def forecaster_columns(w: WindowSpec) -> dict[str, Column]:
    """Nine sales features as the forecaster takes them: population deviations, and
    the stockout flag of the day before, judged on the days before that."""
    s = C("sales_count")
    out = {f"sales_lag_{k}": F.lag(s, k).over(w) for k in (1, 7, 14, 28)}
    for n in (7, 28):
        out |= {f"sales_mean_{n}": F.avg(s).over(_past(w, n)), f"sales_std_{n}": F.stddev_pop(s).over(_past(w, n))}
    out["likely_stockout_lag_1"] = F.lag(C("is_likely_stockout").cast("int"), 1).over(w)
    return out


def forecaster_features(df: DataFrame) -> DataFrame:
    """The key and the nine sales features."""
    columns = forecaster_columns(Window.partitionBy(*SERIES).orderBy("date"))
    return df.select("date", *SERIES, *[c.alias(n) for n, c in columns.items()])


def unique_panel(df: DataFrame) -> DataFrame:
    return unique_by(df, ["date", *SERIES], "panel")
