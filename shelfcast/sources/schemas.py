"""Column types of the sources and of the merged panel."""

from __future__ import annotations

#: Declared columns of each source, as DDL.
SOURCES = {
    "history": "id long, date date, store_id short, product_id int, sales_count double, promotion boolean",
    "test": "id long, date date, store_id short, product_id int, promotion boolean",
    "items": "product_id int, product_family string, product_class int, is_perishable byte",
    "stores": "store_id short, city string, department string, store_type string, store_cluster int",
    "events": "date date, event_type string, scope string, location string, is_transferred boolean",
    "oil": "date date, oil_price double",
    "traffic": "date date, store_id short, transaction_count int",
}
KEY = ["date", "product_id", "store_id"]
SERIES = ["store_id", "product_id"]
#: Flags of the event context and the merged panel's column order.
EVENT_FLAGS = [
    "has_holiday", "is_effective_holiday", "has_transfer", "has_additional", "has_special_event",
    "has_national_event", "has_regional_event", "has_local_event", "has_effective_national_event",
    "has_effective_regional_event", "has_effective_local_event", "has_transferred_event",
]
MERGED = [
    *KEY, "id", "dataset_split", "sales_count", "is_likely_stockout", "promotion",
    "product_family", "product_class", "is_perishable", "city", "department", "store_type", "store_cluster",
    "transaction_count", "traffic_source_missing", "traffic_lag_1", "traffic_mean_7", "traffic_mean_28", "traffic_ratio_7_28",
    "year", "month", "day", "day_of_week", "week_of_year", "is_weekend", "oil_price", "oil_price_source_missing",
    "event_count", "effective_event_count", "is_event_day", "is_effective_event_day", "event_types", "event_scopes", "event_locations",
    "has_holiday", "is_effective_holiday", "days_until_effective_holiday", "is_1d_before_holiday", "is_2d_before_holiday",
    "days_since_effective_holiday", "has_transfer", "has_additional", "has_special_event", "has_national_event",
    "has_regional_event", "has_local_event", "has_effective_national_event", "has_effective_regional_event",
    "has_effective_local_event", "has_transferred_event",
]
