"""Additive explanations: long sidecar, buckets, checks and top factors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import QUANTILES
from ..sources.shared import importable
from .forecaster import CONTEXT, SALES, coherent
from .learner import Boosted

C = F.col
#: Bucket of each contribution column.
BUCKETS = {
    "sales_trend": SALES,
    "promotion": CONTEXT["promotion"],
    "calendar": CONTEXT["calendar"],
    "holiday_event": CONTEXT["event"],
    "product": CONTEXT["product"],
    "store": CONTEXT["store"],
    "oil_price": CONTEXT["oil"],
    "traffic": CONTEXT["traffic"],
}


def shap_long(rows: DataFrame, models: list[Boosted], columns: list[str], keys: list[str], log_sales: bool = True) -> DataFrame:
    """Four rows a key: quantile, the quantile whose model it comes from after sorting,
    that model's value, base and contribution a feature, and the value submitted."""
    importable(rows.sparkSession)
    spec = ", ".join(f"`{n}` {t}" for n, t in rows.select(*keys).dtypes) + ", quantile double, source_quantile double, raw_model double, base_value double, submitted double, " + ", ".join(f"shap_{c} double" for c in columns)

    def run(parts):
        import pandas as pd

        for part in parts:
            x = part[columns].to_numpy(float)
            raw = np.stack([m.predict(x) for m in models], axis=1)
            told = [m.explain(x) for m in models]
            bases, shaps = np.array([base for base, _ in told]), np.stack([shap for _, shap in told])
            values, sources = coherent(raw, log_sales)
            out, row = [], np.arange(len(x))
            for k, q in enumerate(QUANTILES):
                of = np.searchsorted(QUANTILES, sources[:, k])
                made = part[keys].copy()
                made["quantile"], made["source_quantile"], made["raw_model"], made["base_value"], made["submitted"] = q, sources[:, k], raw[row, of], bases[of], values[:, k]
                out.append(pd.concat([made, pd.DataFrame(shaps[of, row], columns=[f"shap_{c}" for c in columns], index=part.index)], axis=1))
            yield pd.concat(out)

    return rows.select(*keys, *[F.coalesce(C(c).cast("double"), F.lit(0.0)).alias(c) for c in columns if c not in keys]).mapInPandas(run, spec)


def contributions(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("shap_")]


def total(columns: list[str]) -> Column:
    out = F.lit(0.0)
    for c in columns:
        out = out + F.coalesce(C(c), F.lit(0.0))
    return out


def additivity(df: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """One row: rows, and rows whose base and contributions miss the model value."""
    off = F.abs(C("base_value") + total(contributions(df)) - C("raw_model")) > tolerance
    return df.agg(F.count("*").alias("n_rows"), F.count_if(off).alias("off"))


def buckets(df: DataFrame, keys: list[str], places: int = 2) -> DataFrame:
    """Contributions summed into the eight buckets, rounded; base in display units.

    Raises if a contribution has no bucket or the other way round.
    """
    there, known = {c.removeprefix("shap_") for c in contributions(df)}, {c for b in BUCKETS.values() for c in b}
    if there - known:
        raise ValueError(f"no bucket for {', '.join(sorted(there - known))}")
    if known - there:
        raise ValueError(f"no contribution for {', '.join(sorted(known - there))}")
    return df.select(*keys, "quantile", F.round(F.expm1("base_value"), places).alias("base_units"), *[F.round(total([f"shap_{c}" for c in cols]), places).alias(f"contrib_{b}") for b, cols in BUCKETS.items()])


def transform_of(sidecar: DataFrame) -> str:
    """The one scale that all rows of a sidecar are on; raises if there are several or none."""
    kinds = sorted(str(r[0]) for r in sidecar.select("target_transform").distinct().limit(3).collect())
    if len(kinds) != 1:
        raise ValueError(f"target_transform is not one value: {kinds}")
    if kinds[0] not in ("log1p", "none", "identity"):
        raise ValueError(f"unknown target_transform {kinds[0]!r}")
    return kinds[0]


def display_rows(sidecar: DataFrame, places: int = 2) -> DataFrame:
    """A sidecar as shown: values on the model's scale and in units, and the eight buckets."""
    summed = buckets(sidecar, ["id", *[C(c).alias(f"_{c}") for c in ("base_value", "raw_model", "submitted")]], places)
    base = F.expm1("_base_value") if transform_of(sidecar) == "log1p" else C("_base_value")
    told = {"base_value": C("_base_value"), "prediction": C("_raw_model"), "display_base": base, "display_prediction": C("_submitted")}
    keep = [F.round(c, places).alias(n) for n, c in told.items()]
    return summed.select("id", "quantile", *keep, *[c for c in summed.columns if c.startswith("contrib_")])


def lookup(points: DataFrame, told: DataFrame) -> DataFrame:
    """The explanation of each (id, quantile); a point without one keeps nulls."""
    return points.join(told, ["id", "quantile"], "left")


def top_factors(df: DataFrame, keys: list[str], k: int = 4, least: float = 0.05) -> DataFrame:
    """The buckets that move a forecast most, by size, of those above ``least``."""
    names = [c for c in df.columns if c.startswith("contrib_")]
    pairs = F.array(*[F.struct((-F.abs(C(c))).alias("size"), F.lit(c.removeprefix("contrib_")).alias("factor"), C(c).alias("value")) for c in names])
    kept = F.slice(F.array_sort(F.filter(pairs, lambda x: -x["size"] >= least)), 1, k)
    return df.select(*keys, "quantile", F.posexplode(kept).alias("rank", "f")).select(*keys, "quantile", (C("rank") + 1).alias("rank"), "f.factor", "f.value")


def signed_segments(df: DataFrame, keys: list[str]) -> DataFrame:
    """Where each bucket's bar starts and stops: positive upwards, negative downwards."""
    names = [c for c in df.columns if c.startswith("contrib_")]
    out, up, down = [], F.lit(0.0), F.lit(0.0)
    for c in names:
        v = C(c)
        start = F.when(v >= 0, up).otherwise(down)
        out.append(F.struct(F.lit(c.removeprefix("contrib_")).alias("factor"), start.alias("start"), (start + v).alias("stop")))
        up, down = up + F.greatest(v, F.lit(0.0)), down + F.least(v, F.lit(0.0))
    return df.select(*keys, "quantile", F.explode(F.array(*out)).alias("s")).select(*keys, "quantile", "s.*")
