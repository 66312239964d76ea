"""Zeros that look like missing stock, judged on the days before them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..sources.schemas import SERIES

#: Fixed values of the rule.
LOOKBACK, POSITIVE_DAYS, POSITIVE_RATE, TYPICAL_SALES = 28, 3, 0.50, 5.0


def series_window() -> WindowSpec:
    return Window.partitionBy(*SERIES).orderBy("date")


def likely_stockout(sales: Column, w: WindowSpec) -> Column:
    """A zero after mostly positive days with typical sales; never null."""
    past = w.rowsBetween(-LOOKBACK, -1)
    positive = F.count_if(sales > 0).over(past)
    typical = F.percentile(F.when(sales > 0, sales), 0.5).over(past)
    rate = F.try_divide(positive, F.count(sales).over(past))
    return F.coalesce((sales == 0) & (positive >= POSITIVE_DAYS) & (typical >= TYPICAL_SALES) & (rate >= POSITIVE_RATE), F.lit(False))


def add_stockout_flag(panel: DataFrame) -> DataFrame:
    """Adds is_likely_stockout; null outside the training split."""
    flag = likely_stockout(F.col("sales_count"), series_window())
    return panel.withColumn("_stockout", flag).withColumn("is_likely_stockout", F.when(F.col("dataset_split") == "train", F.col("_stockout"))).drop("_stockout")


def likely_stockout_for_last_day(history: DataFrame) -> DataFrame:
    """The flag of each series' last day: store_id, product_id, is_likely_stockout."""
    w = series_window()
    last = F.row_number().over(Window.partitionBy(*SERIES).orderBy(F.desc("date"))) == 1
    return history.withColumn("is_likely_stockout", likely_stockout(F.col("sales_count"), w)).withColumn("_last", last).filter("_last").select(*SERIES, "is_likely_stockout")
