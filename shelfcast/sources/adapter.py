"""Retail sources derived from the star-schema test tables.

Two panels: ``dense`` (region x part type) and ``sparse`` (nation x brand). Both
are filled with zeros over the whole calendar, and their last HORIZON days form
the test split, without sales.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import discard, written

HORIZON = 28
#: Rows of a dimension that may be sent whole to driver and executors: about 64 MB as a hash table.
BROADCAST_ROWS = 1_000_000


@dataclass(frozen=True)
class Sources:
    panel: DataFrame
    items: DataFrame
    stores: DataFrame
    events: DataFrame
    oil: DataFrame
    traffic: DataFrame
    #: One row: first and last day of the panel.
    span: DataFrame


class _Derived(Sources):
    """Sources whose panel and span are made when they are first asked for.

    The sales of a day and series and the panel are each written once, so the sale lines are read
    and joined once a query, however many branches and passes the panel has.
    """

    def __init__(self, make_panel: Callable[[DataFrame], DataFrame], make_span: Callable[[], DataFrame], **rest: DataFrame):
        self.__dict__.update(rest, _make_panel=make_panel, _make_span=make_span)

    @cached_property
    def span(self) -> DataFrame:
        return self._make_span()

    @cached_property
    def panel(self) -> DataFrame:
        return self._make_panel(self.span)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _side(df: DataFrame) -> DataFrame:
    """A dimension for a join: beyond BROADCAST_ROWS it is shuffled, whatever its files' size promises."""
    return df.hint("shuffle_hash") if df.count() > BROADCAST_ROWS else df


def panel_sources(spark: SparkSession, sf_dir: str, kind: str = "dense", truth: bool = False) -> Sources:
    """Sources of one panel; ``truth`` leaves the sales of the test split in."""
    line, part, supplier, nation, region = (_table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier", "nation", "region"))
    dense = kind == "dense"
    store, product = ("n_regionkey", "p_type") if dense else ("n_nationkey", "p_brand")

    def make_span() -> DataFrame:
        day = F.col("l_shipdate").cast("date")
        ends = line.agg(F.min(day).alias("first_day"), F.max(day).alias("last_day")).first()
        return spark.range(1).select(F.lit(ends.first_day).cast("date").alias("first_day"), F.lit(ends.last_day).cast("date").alias("last_day"))

    def make_panel(span: DataFrame) -> DataFrame:
        sold = (
            line.select(F.col("l_shipdate").cast("date").alias("date"), "l_partkey", "l_suppkey", "l_quantity", "l_discount")
            .join(_side(part.select("p_partkey", product)), F.col("l_partkey") == F.col("p_partkey"))
            .join(_side(supplier.select("s_suppkey", "s_nationkey")), F.col("l_suppkey") == F.col("s_suppkey"))
            .join(F.broadcast(nation.select("n_nationkey", "n_regionkey")), F.col("s_nationkey") == F.col("n_nationkey"))
            .groupBy("date", F.col(store).alias("store_id"), F.col(product).alias("product_id"))
            .agg(F.sum("l_quantity").alias("sold"), F.bool_or(F.col("l_discount") >= 0.08).alias("promoted"))
        )
        daily = written(sold, "sold")
        days = span.select(F.explode(F.sequence("first_day", "last_day")).alias("date"), "last_day")
        # calendar x series is what a dense panel is; the calendar is one row a day
        grid = daily.select("store_id", "product_id").distinct().crossJoin(F.broadcast(days))
        is_test = F.col("date") > F.date_sub("last_day", HORIZON)
        panel = grid.join(daily, ["date", "store_id", "product_id"], "left").select(
            "date",
            "store_id",
            "product_id",
            F.concat_ws("|", F.col("date").cast("string"), F.col("store_id").cast("string"), "product_id").alias("id"),
            F.when(is_test, "test").otherwise("train").alias("dataset_split"),
            (F.coalesce("sold", F.lit(0.0)) if truth else F.when(~is_test, F.coalesce("sold", F.lit(0.0)))).alias("sales_count"),
            F.coalesce("promoted", F.lit(False)).alias("promotion"),
        )
        out = written(panel, "panel")
        discard(daily)
        return out

    brand = F.substring_index("p_brand", "#", -1).cast("int")
    if dense:
        items = part.select(F.col("p_type").alias("product_id"), F.substring("p_type", 1, 1).alias("product_family"), F.length("p_type").alias("product_class"), F.col("p_type").isin("SMALL", "MEDIUM").alias("is_perishable")).distinct()
        k = F.col("r_regionkey")
        stores = region.select(k.alias("store_id"), F.col("r_name").alias("city"), F.when(k < 2, "NORTH").otherwise("SOUTH").alias("department"), F.chr(65 + k % 4).alias("store_type"), (k % 2).alias("store_cluster"))
    else:
        items = part.select(F.col("p_brand").alias("product_id"), (brand % 6).cast("string").alias("product_family"), brand.alias("product_class"), (brand % 4 == 0).alias("is_perishable")).distinct()
        k = F.col("n_nationkey")
        stores = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(k.alias("store_id"), F.col("n_name").alias("city"), F.col("r_name").alias("department"), F.chr(65 + k % 4).alias("store_type"), (k % 7).alias("store_cluster"))
    ev = _table(spark, sf_dir, "events")
    u = (F.col("user_id") / 3).cast("int")
    kind_of = F.when(F.col("event_type").isin("view", "signup"), "Holiday").when(F.col("event_type") == "click", "Transfer").when(F.col("event_type") == "purchase", "Additional").otherwise("Event")
    place = F.col("user_id") % 3
    events = ev.select(
        F.date_add(F.lit("2001-10-06").cast("date"), F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))).alias("date"),
        kind_of.alias("event_type"),
        F.when(place == 0, "National").when(place == 1, "Regional").otherwise("Local").alias("scope"),
        F.when(place == 0, "Country")
        .when(place == 1, F.element_at(F.array(*map(F.lit, ("NORTH", "SOUTH", "EAST"))), u % 3 + 1))
        .otherwise(F.element_at(F.array(*map(F.lit, ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST", "ATLANTIS"))), u % 6 + 1))
        .alias("location"),
        ((kind_of == "Holiday") & (F.col("event_id") % 2 == 0)).alias("is_transferred"),
    )
    orders = _table(spark, sf_dir, "orders")
    day = F.col("o_orderdate").cast("date")
    oil = orders.filter(F.weekday(day) < 5).groupBy(day.alias("date")).agg(F.avg("o_totalprice").alias("oil_price"))
    customer = _table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    traffic = (
        orders.select(day.alias("date"), "o_custkey")
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(F.broadcast(nation.select("n_nationkey", "n_regionkey")), F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("date", F.col("n_regionkey" if dense else "n_nationkey").alias("store_id"))
        .agg(F.count("*").alias("transaction_count"))
    )
    return _Derived(make_panel, make_span, items=items, stores=stores, events=events, oil=oil, traffic=traffic)
