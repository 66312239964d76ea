"""SQL that states the rows of the panel queries, as common table expressions."""

from __future__ import annotations

#: Name -> (body, names it reads).
CTE: dict[str, tuple[str, list[str]]] = {
    "span": ("SELECT min(CAST(l_shipdate AS DATE)) AS first_day, max(CAST(l_shipdate AS DATE)) AS last_day FROM lineitem", []),
    "days": ("SELECT CAST(unnest(generate_series(first_day, last_day, INTERVAL 1 DAY)) AS DATE) AS date, last_day FROM span", ["span"]),
    "sold": (
        """SELECT CAST(l_shipdate AS DATE) AS date, n_regionkey AS store_id, p_type AS product_id, sum(l_quantity) AS sold, bool_or(l_discount >= 0.08) AS promoted
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2, 3""",
        [],
    ),
    "sold_sparse": (
        """SELECT CAST(l_shipdate AS DATE) AS date, n_nationkey AS store_id, p_brand AS product_id, sum(l_quantity) AS sold, bool_or(l_discount >= 0.08) AS promoted
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2, 3""",
        [],
    ),
    "items": ("SELECT DISTINCT p_type AS product_id, substring(p_type, 1, 1) AS product_family, CAST(length(p_type) AS INTEGER) AS product_class, p_type IN ('SMALL', 'MEDIUM') AS is_perishable FROM part", []),
    "stores": ("SELECT r_regionkey AS store_id, r_name AS city, CASE WHEN r_regionkey < 2 THEN 'NORTH' ELSE 'SOUTH' END AS department, chr(CAST(65 + r_regionkey % 4 AS INTEGER)) AS store_type, r_regionkey % 2 AS store_cluster FROM region", []),
    "event": (
        """SELECT *, event_type = 'Transfer' OR (event_type = 'Holiday' AND NOT is_transferred) AS is_holiday, NOT (event_type = 'Holiday' AND is_transferred) AS is_effective FROM (
    SELECT *, event_type = 'Holiday' AND event_id % 2 = 0 AS is_transferred FROM (
      SELECT event_id, DATE '2001-10-06' + CAST(CAST(ts AS DATE) - DATE '2024-01-01' AS INTEGER) AS date,
        CASE WHEN event_type IN ('view', 'signup') THEN 'Holiday' WHEN event_type = 'click' THEN 'Transfer' WHEN event_type = 'purchase' THEN 'Additional' ELSE 'Event' END AS event_type,
        CASE user_id % 3 WHEN 0 THEN 'National' WHEN 1 THEN 'Regional' ELSE 'Local' END AS scope,
        CASE user_id % 3 WHEN 0 THEN 'Country' WHEN 1 THEN ['NORTH', 'SOUTH', 'EAST'][(user_id // 3) % 3 + 1]
          ELSE ['AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST', 'ATLANTIS'][(user_id // 3) % 6 + 1] END AS location
      FROM events))""",
        [],
    ),
    "reached": ("SELECT s.store_id, e.* FROM event e JOIN stores s ON e.scope = 'National' OR (e.scope = 'Regional' AND e.location = s.department) OR (e.scope = 'Local' AND e.location = s.city)", ["event", "stores"]),
    "rollup_": (
        """SELECT date, store_id, count(*) AS event_count, count(*) FILTER (WHERE is_effective) AS effective_event_count,
    list_sort(list(DISTINCT event_type)) AS event_types, list_sort(list(DISTINCT scope)) AS event_scopes, list_sort(list(DISTINCT location)) AS event_locations,
    bool_or(event_type = 'Holiday') AS has_holiday, bool_or(event_type = 'Transfer') AS has_transfer, bool_or(event_type = 'Additional') AS has_additional, bool_or(event_type = 'Event') AS has_special_event,
    bool_or(is_holiday) AS is_effective_holiday, bool_or(scope = 'National') AS has_national_event, bool_or(scope = 'Regional') AS has_regional_event, bool_or(scope = 'Local') AS has_local_event,
    bool_or(scope = 'National' AND is_effective) AS has_effective_national_event, bool_or(scope = 'Regional' AND is_effective) AS has_effective_regional_event, bool_or(scope = 'Local' AND is_effective) AS has_effective_local_event,
    bool_or(is_transferred) AS has_transferred_event, count(*) > 0 AS is_event_day, count(*) FILTER (WHERE is_effective) > 0 AS is_effective_event_day
  FROM reached GROUP BY 1, 2""",
        ["reached"],
    ),
    "distances": (
        """SELECT *, days_until_effective_holiday = 1 AS is_1d_before_holiday, days_until_effective_holiday = 2 AS is_2d_before_holiday FROM (
    SELECT d.date, s.store_id, CAST(coalesce(min(h.date - d.date) FILTER (WHERE h.date >= d.date), -1) AS INTEGER) AS days_until_effective_holiday,
      CAST(coalesce(min(d.date - h.date) FILTER (WHERE h.date <= d.date), -1) AS INTEGER) AS days_since_effective_holiday
    FROM days d CROSS JOIN stores s LEFT JOIN (SELECT DISTINCT store_id, date FROM reached WHERE is_holiday) h ON h.store_id = s.store_id GROUP BY 1, 2)""",
        ["days", "stores", "reached"],
    ),
    "event_ctx": (
        """SELECT d.*, coalesce(event_count, 0) AS event_count, coalesce(effective_event_count, 0) AS effective_event_count,
    coalesce(event_types, []) AS event_types, coalesce(event_scopes, []) AS event_scopes, coalesce(event_locations, []) AS event_locations, """
        + ", ".join(
            f"coalesce({c}, false) AS {c}"
            for c in (
                "has_holiday is_effective_holiday has_transfer has_additional has_special_event has_national_event has_regional_event has_local_event has_effective_national_event "
                "has_effective_regional_event has_effective_local_event has_transferred_event is_event_day is_effective_event_day"
            ).split()
        )
        + " FROM distances d LEFT JOIN rollup_ r ON r.date = d.date AND r.store_id = d.store_id",
        ["distances", "rollup_"],
    ),
    "oil": ("SELECT CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS oil_price FROM orders WHERE isodow(CAST(o_orderdate AS DATE)) < 6 GROUP BY 1", []),
    "oil_ctx": ("SELECT d.date, last_value(oil_price IGNORE NULLS) OVER (ORDER BY d.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS oil_price, oil_price IS NULL AS oil_price_source_missing FROM days d LEFT JOIN oil ON oil.date = d.date", ["days", "oil"]),
    "traffic": ("SELECT CAST(o_orderdate AS DATE) AS date, n_regionkey AS store_id, count(*) AS transaction_count FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2", []),
    "traffic_ctx": (
        """SELECT *, traffic_mean_7 / (traffic_mean_28 + 1) AS traffic_ratio_7_28 FROM (
    SELECT date, store_id, transaction_count, transaction_count IS NULL AS traffic_source_missing, lag(seen) OVER w AS traffic_lag_1,
      avg(seen) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS traffic_mean_7, avg(seen) OVER (w ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING) AS traffic_mean_28
    FROM (SELECT d.date, s.store_id, transaction_count, last_value(transaction_count IGNORE NULLS) OVER (PARTITION BY s.store_id ORDER BY d.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen
      FROM days d CROSS JOIN stores s LEFT JOIN traffic t ON t.date = d.date AND t.store_id = s.store_id) WINDOW w AS (PARTITION BY store_id ORDER BY date))""",
        ["days", "stores", "traffic"],
    ),
    "enriched": (
        """SELECT p.*, product_family, product_class, is_perishable, city, department, store_type, store_cluster, transaction_count, traffic_source_missing, traffic_lag_1, traffic_mean_7, traffic_mean_28, traffic_ratio_7_28,
    CAST(year(p.date) AS INTEGER) AS year, CAST(month(p.date) AS INTEGER) AS month, CAST(day(p.date) AS INTEGER) AS day, CAST(isodow(p.date) AS INTEGER) AS day_of_week, CAST(week(p.date) AS INTEGER) AS week_of_year, isodow(p.date) >= 6 AS is_weekend,
    oil_price, oil_price_source_missing, e.* EXCLUDE (date, store_id)
  FROM panel p LEFT JOIN items USING (product_id) LEFT JOIN stores USING (store_id) LEFT JOIN traffic_ctx t ON t.date = p.date AND t.store_id = p.store_id LEFT JOIN oil_ctx o ON o.date = p.date LEFT JOIN event_ctx e ON e.date = p.date AND e.store_id = p.store_id""",
        ["panel", "items", "stores", "traffic_ctx", "oil_ctx", "event_ctx"],
    ),
}


def _panel(sold: str, sales: str = "CASE WHEN d.date > last_day - 28 THEN NULL ELSE coalesce(sold, 0) END") -> str:
    return f"""SELECT d.date, k.store_id, k.product_id, strftime(d.date, '%Y-%m-%d') || '|' || k.store_id || '|' || k.product_id AS id,
    CASE WHEN d.date > last_day - 28 THEN 'test' ELSE 'train' END AS dataset_split,
    {sales} AS sales_count, coalesce(promoted, false) AS promotion
  FROM (SELECT DISTINCT store_id, product_id FROM {sold}) k CROSS JOIN days d LEFT JOIN {sold} s ON s.date = d.date AND s.store_id = k.store_id AND s.product_id = k.product_id"""


def _flagged(source: str) -> str:
    return f"""SELECT * EXCLUDE (median_, positive_, seen_), CASE WHEN dataset_split = 'train' THEN coalesce(sales_count = 0 AND positive_ >= 3 AND median_ >= 5 AND positive_ / nullif(seen_, 0) >= 0.5, false) END AS is_likely_stockout
  FROM (SELECT *, quantile_cont(CASE WHEN sales_count > 0 THEN sales_count END, 0.5) OVER (w ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING) AS median_,
    count(CASE WHEN sales_count > 0 THEN 1 END) OVER (w ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING) AS positive_, count(sales_count) OVER (w ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING) AS seen_
    FROM {source} WINDOW w AS (PARTITION BY store_id, product_id ORDER BY date))"""


CTE["panel"] = (_panel("sold"), ["sold", "days"])
CTE["panel_truth"] = (_panel("sold", "coalesce(sold, 0)"), ["sold", "days"])
CTE["panel_sparse"] = (_panel("sold_sparse"), ["sold_sparse", "days"])
CTE["stock"] = (_flagged("panel"), ["panel"])
CTE["merged"] = (_flagged("enriched"), ["enriched"])
CTE["train"] = ("SELECT * FROM merged WHERE dataset_split = 'train'", ["merged"])

#: Windows of the series: w, and frames of the last n days before a row.
WINDOWS = "WINDOW w AS (PARTITION BY store_id, product_id ORDER BY date)"


def past(n: int) -> str:
    return f"(PARTITION BY store_id, product_id ORDER BY date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


def with_ctes(select: str, *names: str) -> str:
    """``select`` behind the named expressions and all they read, in order."""
    order: list[str] = []

    def add(name: str) -> None:
        if name not in order:
            for n in CTE[name][1]:
                add(n)
            if name not in order:
                order.append(name)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED (\n  {CTE[n][0]})" for n in order) + "\n" + select


def r6(expression: str) -> str:
    return f"round({expression}, 6)"


def _dbl(expression: str) -> str:
    return f"CAST({expression} AS DOUBLE)"


def _int(expression: str) -> str:
    return f"CAST({expression} AS INTEGER)"


S = "sales_count"
NEAREST = "list_sort(list({s}) FILTER (WHERE {s} IS NOT NULL) OVER {w})[CAST(floor((count({s}) OVER {w} - 1) * {q} + 0.5) AS INTEGER) + 1]"
#: Group -> column -> SQL over ``train``.
FEATURES: dict[str, dict[str, str]] = {
    "identity": {"store_id": "store_id", "product_id": "product_id"},
    "promotion": {"promotion": _int("promotion")},
    "calendar": {c: c for c in ("year", "month", "day", "day_of_week", "week_of_year")} | {"is_weekend": _int("is_weekend")},
    "product": {"product_family": _int("dense_rank() OVER (ORDER BY product_family) - 1"), "product_class": "product_class", "is_perishable": _int("is_perishable")},
    "store": {c: _int(f"dense_rank() OVER (ORDER BY {c}) - 1") for c in ("city", "department", "store_type")} | {"store_cluster": "store_cluster"},
    "external": {c: r6(c) for c in ("oil_price", "traffic_mean_7", "traffic_mean_28", "traffic_ratio_7_28")}
    | {"traffic_lag_1": _dbl("traffic_lag_1")}
    | {c: c for c in ("event_count", "effective_event_count", "days_until_effective_holiday", "days_since_effective_holiday")}
    | {
        c: _int(c)
        for c in (
            "oil_price_source_missing traffic_source_missing is_event_day is_effective_event_day is_1d_before_holiday is_2d_before_holiday has_holiday is_effective_holiday has_transfer has_additional has_special_event has_national_event "
            "has_regional_event has_local_event has_effective_national_event has_effective_regional_event has_effective_local_event has_transferred_event"
        ).split()
    },
    "sales_history": {f"sales_lag_{k}": r6(f"lag({S}, {k}) OVER w") for k in (1, 7, 14, 28)}
    | {f"sales_mean_{n}": r6(f"avg({S}) OVER {past(n)}") for n in (7, 28)}
    | {f"sales_std_{n}": r6(f"stddev_samp({S}) OVER {past(n)}") for n in (7, 28)}
    | {"likely_stockout_lag_1": _int("coalesce(lag(is_likely_stockout) OVER w, false)")},
    "promotion_regime": {f"promotion_lag_{k}": _int(f"coalesce(lag(promotion, {k}) OVER w, false)") for k in (1, 2, 3, 7)}
    | {f"promotion_count_{n}": f"CAST(sum(CAST(promotion AS INTEGER)) OVER {past(n)} AS DOUBLE)" for n in (7, 28)}
    | {
        "promotion_start": _int("promotion AND NOT coalesce(lag(promotion) OVER w, false)"),
        "post_promotion_1d": _int("NOT promotion AND coalesce(lag(promotion) OVER w, false)"),
        "post_promotion_2d": _int("NOT promotion AND NOT coalesce(lag(promotion) OVER w, false) AND coalesce(lag(promotion, 2) OVER w, false)"),
        "post_promotion_3d": _int("NOT promotion AND NOT coalesce(lag(promotion) OVER w, false) AND NOT coalesce(lag(promotion, 2) OVER w, false) AND coalesce(lag(promotion, 3) OVER w, false)"),
        "promotion_perishable": _int("promotion AND is_perishable"),
        "promotion_effective_holiday": _int("promotion AND is_effective_holiday"),
    },
    "seasonal_history": {f"sales_lag_{k}": r6(f"lag({S}, {k}) OVER w") for k in (2, 3, 4, 5, 6, 8, 21, 35, 42, 56)}
    | {
        "same_weekday_mean_4": r6(f"list_avg([lag({S}, 7) OVER w, lag({S}, 14) OVER w, lag({S}, 21) OVER w, lag({S}, 28) OVER w])"),
        "sales_median_7": r6(f"quantile_cont({S}, 0.5) OVER {past(7)}"),
        "sales_median_28": r6(f"quantile_cont({S}, 0.5) OVER {past(28)}"),
        "sales_max_28": r6(f"max({S}) OVER {past(28)}"),
        "sales_trend_7_28": r6(f"avg({S}) OVER {past(7)} - avg({S}) OVER {past(28)}"),
        "sales_ratio_7_28": r6(f"avg({S}) OVER {past(7)} / (avg({S}) OVER {past(28)} + 1)"),
    },
    "intermittency": {f"zero_rate_{n}": r6(f"avg(CAST({S} = 0 AS INTEGER)) OVER {past(n)}") for n in (7, 28, 56)}
    | {f"nonzero_mean_{n}": r6(f"avg(CASE WHEN {S} > 0 THEN {S} END) OVER {past(n)}") for n in (28, 56)}
    | {"zero_run_3": _dbl(f"(lag({S}) OVER w = 0) AND (lag({S}, 2) OVER w = 0) AND (lag({S}, 3) OVER w = 0)")}
    | {f"stockout_rate_{n}": r6(f"avg(CAST(is_likely_stockout AS INTEGER)) OVER {past(n)}") for n in (7, 28)}
    | {"sales_cv_28": r6(f"stddev_samp({S}) OVER {past(28)} / (avg({S}) OVER {past(28)} + 1)")},
    "payday": {n: _int(f"day IN ({3 + k}, {18 + k})") for n, k in (("is_payday", 0), ("is_1d_before_payday", -1), ("is_2d_before_payday", -2), ("is_1d_after_payday", 1), ("is_2d_after_payday", 2))} | {"promotion_payday": _int("promotion AND day IN (3, 18)")},
    "holiday_regime": {
        "effective_holiday_window": _int("is_effective_holiday OR is_1d_before_holiday OR is_2d_before_holiday"),
        "promotion_before_holiday": _int("promotion AND (is_1d_before_holiday OR is_2d_before_holiday)"),
        "perishable_holiday_window": _int("is_perishable AND (is_effective_holiday OR is_1d_before_holiday OR is_2d_before_holiday)"),
        "local_event_promotion": _int("has_effective_local_event AND promotion"),
    },
    "behavioral_profile": {f"profile_p{int(q * 100)}_56": r6(f"CASE WHEN count({S}) OVER {past(56)} >= 7 THEN {NEAREST.format(s=S, w=past(56), q=q)} END") for q in (0.25, 0.75, 0.95)}
    | {
        "profile_p50_56": r6(f"CASE WHEN count({S}) OVER {past(56)} >= 7 THEN quantile_cont({S}, 0.5) OVER {past(56)} END"),
        "promoted_mean_56": r6(f"avg(CASE WHEN promotion THEN {S} END) OVER {past(56)}"),
        "regular_mean_56": r6(f"avg(CASE WHEN NOT promotion THEN {S} END) OVER {past(56)}"),
        "promotion_uplift_56": r6(f"avg(CASE WHEN promotion THEN {S} END) OVER {past(56)} - avg(CASE WHEN NOT promotion THEN {S} END) OVER {past(56)}"),
    },
    "oil_trend": {f"oil_lag_{k}": r6(f"lag(oil_price, {k}) OVER w") for k in (30, 60, 90)}
    | {f"oil_mean_{n}": f"round(CASE WHEN count(oil_price) OVER {past(n)} >= 7 THEN avg(oil_price) OVER {past(n)} END, 3)" for n in (30, 60, 90)}
    | {"oil_change_30_90": r6("lag(oil_price, 30) OVER w - lag(oil_price, 90) OVER w")},
}


def feature_sql(*groups: str) -> str:
    columns = ", ".join(f"{e} AS feature_{n}" for group in groups for n, e in FEATURES[group].items())
    return with_ctes(f"SELECT date, store_id, product_id, {columns} FROM train {WINDOWS}", "train")


_QS = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}
CTE["trail"] = (
    "SELECT store_id, product_id, "
    + ", ".join(f"s[CAST(floor((len(s) - 1) * {q} + 0.5) AS INTEGER) + 1] AS {n}" for n, q in _QS.items())
    + " FROM (SELECT store_id, product_id, list_sort(list(sales_count)) AS s FROM panel WHERE dataset_split = 'train' AND date > (SELECT max(date) FROM panel WHERE dataset_split = 'train') - 56 GROUP BY 1, 2)",
    ["panel"],
)
CTE["test_rows"] = ("SELECT id, date, store_id, product_id, promotion FROM panel WHERE dataset_split = 'test'", ["panel"])
CTE["history"] = ("SELECT date, store_id, product_id, promotion, sales_count FROM panel WHERE dataset_split = 'train'", ["panel"])
CTE["seen"] = ("SELECT * REPLACE (CASE WHEN promotion AND (day(date) + store_id * 3 + length(product_id)) % 11 = 7 THEN 0 ELSE sales_count END AS sales_count) FROM history", ["history"])
CTE["submission"] = (
    """SELECT id, p25, CASE k WHEN 0 THEN 0 WHEN 3 THEN p50 * 2.5 ELSE p50 END AS p50,
    CASE k WHEN 2 THEN p50 - 1 WHEN 3 THEN p75 * 2.5 ELSE p75 END AS p75, CASE k WHEN 1 THEN p95 * 4 WHEN 3 THEN p95 * 2.5 ELSE p95 END AS p95
  FROM (SELECT id, p25, p50, p75, p95, CASE WHEN t.store_id = 1 AND (day(date) + t.store_id * 3 + length(t.product_id)) % 11 IN (0, 3) THEN 10 ELSE (day(date) + t.store_id * 3 + length(t.product_id)) % 11 END AS k FROM test_rows t JOIN trail USING (store_id, product_id))""",
    ["test_rows", "trail"],
)
CTE["baseline"] = (
    "SELECT id, date, t.store_id, t.product_id, "
    + ", ".join(f"coalesce(q.{n}, g.{n}) AS {n}" for n in _QS)
    + " FROM test_rows t LEFT JOIN (SELECT store_id, product_id, "
    + ", ".join(f"quantile_cont(sales_count, {q}) AS {n}" for n, q in _QS.items())
    + " FROM history GROUP BY 1, 2) q ON q.store_id = t.store_id AND q.product_id = t.product_id CROSS JOIN (SELECT "
    + ", ".join(f"s[CAST(floor((len(s) - 1) * {q} + 0.5) AS INTEGER) + 1] AS {n}" for n, q in _QS.items())
    + " FROM (SELECT list_sort(list(sales_count)) AS s FROM history)) g",
    ["test_rows", "history"],
)
CTE["holiday_days"] = ("SELECT DISTINCT store_id, date FROM (SELECT store_id, date FROM reached WHERE NOT is_transferred AND isodow(date) >= 6 UNION ALL SELECT store_id, date - 1 FROM reached WHERE NOT is_transferred AND isodow(date) >= 6)", ["reached"])
CTE["stats"] = (
    """SELECT t.store_id, t.product_id, avg(CASE WHEN NOT promotion THEN p50 END) AS non_promo_avg, avg(CASE WHEN h.date IS NULL THEN p50 END) AS non_holiday_avg
  FROM submission JOIN test_rows t USING (id) LEFT JOIN holiday_days h ON h.store_id = t.store_id AND h.date = t.date GROUP BY 1, 2""",
    ["submission", "test_rows", "holiday_days"],
)
CTE["cutoff"] = ("SELECT s[least(len(s), CAST(floor(len(s) * 0.95) AS INTEGER) + 1)] AS cutoff FROM (SELECT list_sort(list((p95 - p25) / greatest(p50, 1))) AS s FROM submission)", ["submission"])
CTE["rows_"] = (
    """SELECT s.*, t.date, t.store_id, t.product_id, t.promotion, product_family, is_perishable, non_promo_avg, non_holiday_avg, h.date IS NOT NULL AS holiday, b.p50 AS b50, cutoff
  FROM submission s JOIN test_rows t USING (id) JOIN items USING (product_id) LEFT JOIN stats a ON a.store_id = t.store_id AND a.product_id = t.product_id
  LEFT JOIN holiday_days h ON h.store_id = t.store_id AND h.date = t.date LEFT JOIN baseline b ON b.id = s.id CROSS JOIN cutoff""",
    ["submission", "test_rows", "items", "stats", "holiday_days", "baseline", "cutoff"],
)
RULES = {
    "monotonicity": ("NOT (p25 <= p50 AND p50 <= p75 AND p75 <= p95)", "critical"),
    "perishable_spike": ("is_perishable AND CASE WHEN p50 = 0 THEN p95 >= 3 ELSE p95 / p50 >= 2 END", "warning"),
    "promo_no_lift": ("promotion AND non_promo_avg > 0.5 AND p50 <= non_promo_avg * 1.05", "critical"),
    "holiday_flat": ("holiday AND non_holiday_avg > 0.5 AND abs(p50 - non_holiday_avg) / non_holiday_avg < 0.1", "warning"),
    "essential_low": ("p50 = 0 AND p95 > 0 AND product_family IN ('S', 'E')", "warning"),
    "zero_forecast": ("p50 = 0 AND p95 > 0 AND product_family NOT IN ('S', 'E')", "info"),
    "wide_spread": ("(p95 - p25) / greatest(p50, 1) >= cutoff", "critical"),
    "baseline_deviation": ("abs(p50 - b50) / greatest(b50, 1) >= 1 AND abs(p50 - b50) >= 3", "critical"),
}
CTE["flags"] = (
    "\n  UNION ALL ".join(f"SELECT id, store_id, product_id, date, promotion, '{k}' AS type, '{v}' AS severity FROM rows_ WHERE {c}" for k, (c, v) in RULES.items())
    + """
  UNION ALL SELECT CAST(NULL AS VARCHAR), store_id, product_id, date, promotion, 'promo_zero_history', 'warning' FROM seen
  WHERE promotion AND sales_count = 0 AND date >= (SELECT min(date) FROM test_rows) - 30 AND (store_id, product_id) IN (SELECT (store_id, product_id) FROM test_rows)""",
    ["rows_", "seen", "test_rows"],
)
CTE["chart"] = (
    """SELECT store_id, product_id, date, promotion, sales_count, 'history' AS part, CAST(NULL AS DOUBLE) AS p25, CAST(NULL AS DOUBLE) AS p50, CAST(NULL AS DOUBLE) AS p75, CAST(NULL AS DOUBLE) AS p95, CAST(NULL AS DOUBLE) AS base_p25, CAST(NULL AS DOUBLE) AS base_p50, CAST(NULL AS DOUBLE) AS base_p75, CAST(NULL AS DOUBLE) AS base_p95 FROM seen WHERE date >= (SELECT min(date) FROM test_rows) - 30
  UNION ALL SELECT t.store_id, t.product_id, t.date, t.promotion, NULL, 'forecast', s.p25, s.p50, s.p75, s.p95, b.p25, b.p50, b.p75, b.p95 FROM submission s JOIN test_rows t ON t.id = s.id LEFT JOIN baseline b ON b.id = s.id""",
    ["submission", "test_rows", "seen", "baseline"],
)
CTE["both_"] = (
    """SELECT store_id, product_id, p25, p50, p95, promotion, 0 AS exception, 0 AS critical FROM submission JOIN test_rows USING (id)
  UNION ALL SELECT store_id, product_id, NULL, NULL, NULL, NULL, 1, CAST(severity = 'critical' AS INTEGER) FROM flags""",
    ["submission", "test_rows", "flags"],
)
CTE["graded"] = (
    """SELECT b.id, b.date, b.store_id, b.product_id, p.sold AS sales_count, b.p25, b.p50, b.p75, b.p95 FROM baseline b
  JOIN (SELECT d.date, k.store_id, k.product_id, coalesce(sold, 0) AS sold FROM (SELECT DISTINCT store_id, product_id FROM sold) k CROSS JOIN days d LEFT JOIN sold s ON s.date = d.date AND s.store_id = k.store_id AND s.product_id = k.product_id) p
    ON p.date = b.date AND p.store_id = b.store_id AND p.product_id = b.product_id""",
    ["baseline", "sold", "days"],
)


def log_pinball(q: float, n: str) -> str:
    e = f"(ln(1 + sales_count) - ln(1 + greatest({n}, 0)))"
    return f"greatest({e} * {q}, {e} * ({q} - 1))"
