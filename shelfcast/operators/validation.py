"""Checks of sources and results, each one aggregate row."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.schemas import KEY
from ..sources.shared import written

C = F.col


def any_null(columns: list[str]) -> Column:
    return reduce(or_, [C(c).isNull() for c in columns])


def is_finite(c: Column) -> Column:
    return ~F.isnan(c) & (F.abs(c) < float("inf"))


def panel_summary(df: DataFrame, require_sales: bool = True) -> DataFrame:
    """One row of counts that :func:`validate_panel` judges."""
    bad = F.count_if(~F.coalesce(is_finite(C("sales_count")) & (C("sales_count") >= 0), F.lit(False))) if require_sales else F.lit(0)
    return df.agg(
        F.count("*").alias("n_rows"),
        F.count_distinct(F.struct(*KEY)).alias("unique_keys"),
        F.count_if(any_null(KEY)).alias("null_keys"),
        F.count_if(C("id").isNull()).alias("null_ids"),
        F.count_if(C("promotion").isNull()).alias("null_promotions"),
        F.min("date").alias("first_day"),
        F.max("date").alias("last_day"),
        bad.alias("bad_sales"),
    )


def _judge(name: str, row, expected: dict[str, object]) -> None:
    wrong = [f"{k} is {row[k]}, not {v}" for k, v in expected.items() if v is not None and row[k] != v]
    if wrong:
        raise ValueError(f"{name}: {'; '.join(wrong)}")


def validate_panel(df: DataFrame, name: str, rows: int | None, require_sales: bool):
    """Raise unless the panel has the rows, unique whole keys and sane sales."""
    got = panel_summary(df, require_sales).first()
    if got.unique_keys != got.n_rows:
        raise ValueError(f"{name} has duplicate keys: {got.n_rows - got.unique_keys}")
    _judge(name, got, {"n_rows": rows, "null_keys": 0, "null_ids": 0, "null_promotions": 0, "bad_sales": 0})
    return got


def dimension_summary(df: DataFrame, key: str) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), F.count_distinct(F.struct(key)).alias("unique_keys"), F.count_if(C(key).isNull()).alias("null_keys"))


def validate_dimension(df: DataFrame, name: str, key: str, rows: int | None = None) -> None:
    got = dimension_summary(df, key).first()
    if got.unique_keys != got.n_rows:
        raise ValueError(f"{name} has duplicate keys")
    _judge(name, got, {"n_rows": rows, "null_keys": 0})


def validate_context(items: DataFrame, events: DataFrame) -> None:
    """Items and events are whole; perishable is 0 or 1; scopes are known."""
    bad = items.agg(F.count_if(any_null(items.columns)).alias("nulls"), F.count_if(~C("is_perishable").cast("int").isin(0, 1)).alias("flags")).first()
    if bad.nulls:
        raise ValueError(f"items has {bad.nulls} rows with nulls")
    if bad.flags:
        raise ValueError(f"items has {bad.flags} rows whose is_perishable is neither 0 nor 1")
    bad = events.agg(F.count_if(any_null(events.columns)).alias("nulls"), F.count_if(~C("scope").isin("National", "Regional", "Local")).alias("scopes")).first()
    if bad.nulls:
        raise ValueError(f"events has {bad.nulls} rows with nulls")
    if bad.scopes:
        raise ValueError(f"events has an unknown scope in {bad.scopes} rows")


def validate_oil(oil: DataFrame) -> None:
    got = oil.agg(F.count("*").alias("n"), F.count_distinct("date").alias("u"), F.count_if(C("oil_price").isNotNull() & ~(is_finite(C("oil_price")) & (C("oil_price") > 0))).alias("bad")).first()
    if got.n != got.u:
        raise ValueError("oil has duplicate or null dates")
    if got.bad:
        raise ValueError(f"oil has {got.bad} prices that are not positive")


def validate_traffic(traffic: DataFrame) -> None:
    got = traffic.agg(F.count("*").alias("n"), F.count_distinct(F.struct("date", "store_id")).alias("u"), F.count_if(any_null(["date", "store_id", "transaction_count"])).alias("nulls"), F.count_if(C("transaction_count") < 0).alias("bad")).first()
    if got.n != got.u:
        raise ValueError("traffic has duplicate date and store rows")
    if got.nulls or got.bad:
        raise ValueError(f"traffic has {got.nulls} rows with nulls and {got.bad} negative counts")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def completeness(panel: DataFrame) -> DataFrame:
    """One row: whether every series has every day."""
    series = panel.groupBy("store_id", "product_id").agg(F.count("*").alias("n"))
    days = panel.select("date").distinct().agg(F.count("*").alias("n_days"))
    return series.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_series")).crossJoin(days).select("n_rows", "n_days", "n_series", (C("n_rows") == C("n_days") * C("n_series")).alias("complete"))


def validate_forecast_panel(panel: DataFrame, context: list[str]) -> None:
    """Raise unless every series has every day, sales are not negative and context is whole."""
    if not completeness(panel).first().complete:
        raise ValueError("the panel does not hold every day of every series")
    got = panel.agg(F.count_if(C("sales_count") < 0).alias("negative"), F.count_if(any_null(["store_id", "product_id", *context])).alias("nulls")).first()
    if got.negative:
        raise ValueError(f"{got.negative} sales are negative")
    if got.nulls:
        raise ValueError(f"{got.nulls} rows lack a context value")


def positions(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds position, from 0, in the given order.

    Rows are range-partitioned and numbered inside their partition; partitions
    are offset by the counts before them, so no single task sorts all rows. They are written
    once: counts and numbers must come of the same bounds.
    """
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_k", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    parts = written(parts, "positions")
    counts = parts.groupBy("_p").agg(F.count("*").alias("_n"))
    before = counts.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    return parts.join(F.broadcast(before), "_p").withColumn("position", C("_b") + C("_k")).drop("_p", "_k", "_b")


def ordered_equality(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: places (id, position) whose ids differ or that one side lacks."""
    both = a.select(C("position"), C("id").alias("_a")).join(b.select("position", C("id").alias("_b")), "position", "full")
    return both.agg(F.count("*").alias("n_rows"), F.count_if(~C("_a").eqNullSafe(C("_b"))).alias("misplaced"))


def validate_sample_ids(test: DataFrame, sample: DataFrame) -> None:
    """Both have position and id; ids must agree place by place."""
    got = ordered_equality(test, sample).first()
    if got.misplaced:
        raise ValueError(f"{got.misplaced} sample ids are not those of the test rows in order")


def audit_figures() -> dict[str, Column]:
    """Figures of the merged panel that a write can observe on its way, without keys."""
    train = C("dataset_split") == "train"
    return {
        "n_rows": F.count("*"),
        "train_rows": F.count_if(train),
        "test_rows": F.count_if(~train),
        "matched_products": F.count_if(C("product_family").isNotNull()),
        "matched_stores": F.count_if(C("city").isNotNull()),
        "null_oil": F.count_if(C("oil_price").isNull()),
        "missing_traffic": F.count_if(C("traffic_source_missing").isNull()),
        "null_train_sales": F.count_if(C("sales_count").isNull() & train),
        "known_test_sales": F.count_if(C("sales_count").isNotNull() & ~train),
        "first_day": F.min("date"),
        "last_day": F.max("date"),
    }


def audit(df: DataFrame) -> DataFrame:
    """Twelve figures of the merged panel in one row."""
    keys = F.count_distinct(F.struct(*KEY)).alias("unique_keys")
    return df.agg(keys, *[c.alias(n) for n, c in audit_figures().items()])


def validate_audit(told: dict, back: DataFrame, expected: dict[str, object]) -> dict:
    """Judge what the write observed and, by a scan of the keys alone, that none repeats."""
    keys = back.agg(F.count_distinct(F.struct(*KEY)).alias("n")).first().n
    _judge("merged panel", told | {"unique_keys": keys}, expected)
    return told | {"unique_keys": keys}


def validate_submission(submission: DataFrame, test: DataFrame) -> None:
    """Header, ids, coverage, whole and ascending quantiles."""
    from ..functions.metrics import NAMES
    from .review import submission_check

    got = submission_check(submission, test).first()
    nulls = submission.agg(F.count_if(any_null(list(NAMES)) | ~reduce(lambda a, b: a & b, [F.coalesce(is_finite(C(n)), F.lit(False)) for n in NAMES])).alias("n")).first().n
    _judge("submission", got, {"schema_ok": True, "missing": 0, "extra": 0, "monotonic_violations": 0})
    if nulls or got.total != test.count():
        raise ValueError(f"submission has {nulls} rows without all quantiles and {got.total} rows")
