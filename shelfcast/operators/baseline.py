"""Historical quantiles, chronological splits and backtest windows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import NAMES, QUANTILES, log_pinball
from ..sources.schemas import SERIES
from .features import forecaster_columns, nearest_quantile
from .ranks import at_ranks
from .stockout import add_stockout_flag

C = F.col
#: Fixed value: days of history that a row needs.
HISTORY = 28


def chronological_split(df: DataFrame, holdout: int) -> tuple[DataFrame, DataFrame]:
    """Rows before the last ``holdout`` days, and of those days."""
    if holdout < 1:
        raise ValueError("holdout has one day at least")
    cut = df.agg(F.date_sub(F.max("date"), holdout - 1).alias("_cut"))
    both = df.crossJoin(F.broadcast(cut))
    return both.filter("date < _cut").drop("_cut"), both.filter("date >= _cut").drop("_cut")


def historical_quantiles(train: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` with the quantiles of their series' past sales, interpolated.

    A series without a past gets those of all sales, by the nearest rank, found
    when this is called.
    """
    own = train.groupBy(*SERIES).agg(F.percentile("sales_count", list(QUANTILES)).alias("_q"))
    world = at_ranks(train, C("sales_count"), lambda n: [math.floor((n - 1) * q + 0.5) for q in QUANTILES])
    out = rows.join(own, SERIES, "left")
    return out.withColumns({n: F.coalesce(C("_q")[i], F.lit(world[i]).cast("double")) for i, n in enumerate(NAMES)}).drop("_q")


def trailing_quantiles(df: DataFrame, n: int = 56) -> DataFrame:
    """The last ``n`` days of each series as nearest-rank quantiles: a simple forecast."""
    last = df.crossJoin(F.broadcast(df.agg(F.max("date").alias("_last")))).filter(C("date") > F.date_sub("_last", n))
    found = last.groupBy(*SERIES).agg(F.array_sort(F.collect_list("sales_count")).alias("_s"))
    return found.select(*SERIES, *[nearest_quantile(C("_s"), q).alias(m) for m, q in zip(NAMES, QUANTILES, strict=True)])


def direct_supervised(df: DataFrame, leads: list[int], keep: tuple[str, ...] = ()) -> DataFrame:
    """Targets with the nine sales features as known ``lead`` days before: one row a target and lead.

    The features of a target at lead h are those of the day h - 1 before it, which
    look back from there, so nothing sold after the origin is seen. The columns ``keep``
    are those of the target's day.
    """
    flagged = add_stockout_flag(df if "dataset_split" in df.columns else df.withColumn("dataset_split", F.lit("train")))
    w = Window.partitionBy(*SERIES).orderBy("date")
    rows = flagged.select("date", *SERIES, "sales_count", *keep, F.row_number().over(w).alias("_n"), F.struct(*[c.alias(n) for n, c in forecaster_columns(w).items()]).alias("_f"))
    told = F.array(*[F.struct(F.lit(h).alias("lead"), F.lag("_f", h - 1).over(w).alias("f")) for h in leads])
    rows = rows.select("date", *SERIES, "sales_count", *keep, "_n", told.alias("_l")).select("date", *SERIES, "sales_count", *keep, "_n", F.explode("_l").alias("x"))
    return rows.filter(C("_n") >= HISTORY + C("x.lead")).select("date", *SERIES, "sales_count", *keep, "x.lead", "x.f.*")


def backtest_losses(df: DataFrame, windows: int = 3, holdout: int = 28) -> DataFrame:
    """window, rows and mean log-pinball losses of historical quantiles, all windows in one job.

    Window 0 ends on the last day. A series is forecast in a window by the
    quantiles of its sales before the window's holdout days; one without any is left out.
    """
    dealt = backtest_windows(df.filter("sales_count IS NOT NULL"), windows, holdout)
    past = dealt.filter("part = 'train'").groupBy("window", *SERIES).agg(F.percentile("sales_count", list(QUANTILES)).alias("_q"))
    rows = dealt.filter("part = 'holdout'").join(past, ["window", *SERIES])
    losses = {n: F.avg(log_pinball(C("sales_count"), C("_q")[i], q)) for i, (n, q) in enumerate(zip(NAMES, QUANTILES, strict=True))}
    out = rows.groupBy("window").agg(F.count("*").alias("n_rows"), *[c.alias(f"pinball_{n}") for n, c in losses.items()])
    return out.withColumn("mean_pinball", sum(C(f"pinball_{n}") for n in NAMES) / len(NAMES))


def backtest_windows(df: DataFrame, windows: int, holdout: int) -> DataFrame:
    """Rolling origins: (window, part) of each row; window 0 ends on the last day.

    Each window's holdout days end where those of the next one begin.
    """
    step = holdout
    last = df.agg(F.max("date").alias("_last"))
    return (
        df.crossJoin(F.broadcast(last))
        .withColumn("window", F.explode(F.sequence(F.lit(0), F.lit(windows - 1))))
        .withColumn("_end", F.date_sub("_last", (C("window") * step).cast("int")))
        .filter(C("date") <= C("_end"))
        .withColumn("part", F.when(C("date") > F.date_sub("_end", holdout), "holdout").otherwise("train"))
        .drop("_last", "_end")
    )
