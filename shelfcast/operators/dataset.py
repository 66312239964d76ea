"""Stage 1: the merged panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.adapter import Sources
from ..sources.schemas import MERGED
from . import context
from .joins import small, unique_by
from .stockout import add_stockout_flag


def union_splits(history: DataFrame, test: DataFrame) -> DataFrame:
    """UNION ALL of both splits, by name, with typed nulls for missing sales."""
    train = history.withColumn("dataset_split", F.lit("train"))
    return train.unionByName(test.withColumn("dataset_split", F.lit("test")).withColumn("sales_count", F.lit(None).cast("double")))


#: What each feature group reads besides the panel itself.
NEEDS = {
    "calendar": {"calendar"}, "payday": {"calendar"}, "product": {"items"}, "store": {"stores"}, "external": {"traffic", "oil", "events"},
    "sales_history": {"stockout"}, "intermittency": {"stockout"}, "promotion_regime": {"items", "events"}, "holiday_regime": {"items", "events"},
    "oil_trend": {"oil"}, "hierarchy": {"items"},
}
ALL = frozenset().union(*NEEDS.values())


def enrich(s: Sources, parts: frozenset[str] | set[str] = ALL) -> DataFrame:
    """The panel with dimensions, traffic, oil, events and calendar columns.

    Every right side is one row a product, store, day or store-day and is
    broadcast only while small. Parts that nothing reads are not joined.
    """
    out = s.panel
    if "items" in parts:
        out = out.join(small(unique_by(s.items, ["product_id"], "items")), "product_id", "left")
    if "stores" in parts:
        out = out.join(small(unique_by(s.stores, ["store_id"], "stores")), "store_id", "left")
    if "traffic" in parts:
        out = out.join(context.traffic_context(s.traffic, s.stores, s.span), ["date", "store_id"], "left")
    if "oil" in parts:
        out = out.join(context.oil_context(s.oil, s.span), "date", "left")
    if "calendar" in parts:
        out = out.withColumns(context.calendar_parts(F.col("date")))
    if "events" in parts:
        out = context.with_event_defaults(out.join(context.event_context(s.events, s.stores, s.span), ["date", "store_id"], "left"))
    return out


def merged_panel(s: Sources) -> DataFrame:
    return add_stockout_flag(enrich(s)).select(MERGED)


def panel_for(s: Sources, groups: tuple[str, ...]) -> DataFrame:
    """The panel with what the chosen feature groups read, and no more."""
    parts = set().union(*(NEEDS.get(g, set()) for g in groups))
    out = enrich(s, parts)
    return add_stockout_flag(out) if "stockout" in parts else out
