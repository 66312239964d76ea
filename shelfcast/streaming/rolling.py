"""Trailing features over a stream of sales that may come out of order.

``daily_sales`` adds sales up by day, partly before the exchange, so a series with many
sales sends one row a task and day. ``rolling_features`` holds each day of a series until
the watermark has passed its end, and then tells it with the days before it: what
comes late within the delay still counts, whatever the batches. What is later is
dropped by the watermark. A series keeps the last RING days and those
that are still open; a timer in event time removes it when its last day is out of reach.

Defined results
  A feature looks at calendar days: ``sales_lag_7`` is the day seven days before, null
  if nothing was sold then, and means and deviations are over the days with sales among
  the last n. Days are those of UTC. Sales without a time or a quantity are left out; a
  null store or product is a series of its own. Rows of one day are added up. Other
  columns are ignored. ``table_features`` gives the same rows of a table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.shared import importable

#: Days back that a feature looks at, at most.
RING = 28
LAGS, SPANS = (1, 7, 14, 28), (7, 28)
DAY_MS = 86_400_000
FEATURES = [*(f"sales_lag_{k}" for k in LAGS), *(f"sales_{kind}_{n}" for n in SPANS for kind in ("mean", "std"))]
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_SERIES = ["store_id", "product_id"]


@contextmanager
def stateful(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, as timers need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, _STORE)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def daily_sales(events: DataFrame, delay: str = "2 days") -> DataFrame:
    """Sums by day of a stream of sales (ts, store_id, product_id, quantity); ts becomes the
    last instant of the day. A day is told when the watermark, ``delay`` behind the newest sale, has passed it."""
    sales = events.filter("ts IS NOT NULL AND quantity IS NOT NULL").withWatermark("ts", delay)
    days = sales.groupBy(F.window("ts", "1 day").alias("w"), *_SERIES).agg(F.sum("quantity").cast("double").alias("sales_count"))
    return days.select(F.window_time("w").alias("ts"), *_SERIES, "sales_count")


class _Series(StatefulProcessor):
    """Open and past days of a series, by number; ``closed``: all up to it are told."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "days array<int>, sales array<double>, closed int, timer long")

    def _load(self) -> tuple[dict[int, float], int | None, int | None]:
        found = self.kept.get()
        if found is None:
            return {}, None, None
        days, sales, closed, timer = found
        return dict(zip(days, sales, strict=True)), closed, timer

    def _save(self, sales: dict[int, float], closed: int | None, timer: int | None) -> None:
        """The next timer: the end of the first open day, or when no feature can reach the last one."""
        open_ = [d for d in sales if closed is None or d > closed]
        if not sales:
            self.kept.clear()
            next_ = None
        else:
            next_ = (min(open_) + 1 if open_ else max(sales) + RING + 1) * DAY_MS
            days = sorted(sales)
            self.kept.update((days, [sales[d] for d in days], closed, next_))
        if timer not in (None, next_):
            self.handle.deleteTimer(timer)
        if next_ not in (None, timer):
            self.handle.registerTimer(next_)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        sales, closed, timer = self._load()
        for row in rows:
            if closed is None or row.day > closed:  # the watermark lets no other through
                sales[row.day] = sales.get(row.day, 0.0) + row.sales_count
        self._save(sales, closed, timer)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        sales, closed, timer = self._load()
        if expiredTimerInfo.getExpiryTimeInMs() == timer:
            timer = None  # it is gone already
        last = int(timerValues.getCurrentWatermarkInMs()) // DAY_MS - 1
        for day in sorted(d for d in sales if d <= last and (closed is None or d > closed)):
            yield Row(day=day, store_id=key[0], product_id=key[1], sales_count=sales[day], **_features(sales, day))
        closed = last if closed is None else max(closed, last)
        self._save({d: v for d, v in sales.items() if d > closed - RING}, closed, timer)


def _features(sales: dict[int, float], day: int) -> dict[str, float | None]:
    out = {f"sales_lag_{k}": sales.get(day - k) for k in LAGS}
    for n in SPANS:
        past = [sales[d] for d in range(day - n, day) if d in sales]
        mean = sum(past) / len(past) if past else None
        out[f"sales_mean_{n}"] = mean
        out[f"sales_std_{n}"] = math.sqrt(sum((x - mean) ** 2 for x in past) / (len(past) - 1)) if len(past) > 1 else None
    return out


def rolling_features(daily: DataFrame) -> DataFrame:
    """Features of each day from the days before it.

    ``daily`` has ts with a watermark (a time inside the day), store_id, product_id, sales_count.
    """
    importable(daily.sparkSession)
    rows = daily.filter("ts IS NOT NULL AND sales_count IS NOT NULL").select("ts", *_SERIES, F.col("sales_count").cast("double").alias("sales_count"), F.floor(F.unix_millis("ts") / DAY_MS).cast("int").alias("day"))
    kinds = dict(rows.dtypes)
    spec = ", ".join(["day int", *(f"{c} {kinds[c]}" for c in _SERIES), "sales_count double", *(f"{c} double" for c in FEATURES)])
    told = rows.groupBy(*_SERIES).transformWithState(_Series(), spec, "append", "eventTime")
    return told.select(F.date_from_unix_date("day").alias("date"), *_SERIES, "sales_count", *FEATURES)


def table_features(sales: DataFrame) -> DataFrame:
    """The same features of a table of sales (ts, store_id, product_id, quantity), of all its days."""
    day = F.floor(F.unix_millis("ts") / DAY_MS).cast("int")
    daily = sales.filter("ts IS NOT NULL AND quantity IS NOT NULL").groupBy(day.alias("day"), *_SERIES).agg(F.sum("quantity").cast("double").alias("sales_count"))
    w, s = Window.partitionBy(*_SERIES).orderBy("day"), F.col("sales_count")
    features = [F.first(s).over(w.rangeBetween(-k, -k)).alias(f"sales_lag_{k}") for k in LAGS]
    for n in SPANS:
        past = w.rangeBetween(-n, -1)
        features += [F.avg(s).over(past).alias(f"sales_mean_{n}"), F.stddev_samp(s).over(past).alias(f"sales_std_{n}")]
    return daily.select(F.date_from_unix_date("day").alias("date"), *_SERIES, "sales_count", *features)


def drained(spark: SparkSession, features: DataFrame, output: str, checkpoint: str) -> None:
    """Run a stream of features over what is there, into Parquet at ``output``."""
    with stateful(spark):
        query = features.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", output).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
