"""The same results in the DuckDB dialect, over the test tables."""

from __future__ import annotations

DAY = "%Y-%m-%d"
# Exact sums, rounded after them, halves away from zero.
TOTAL = "sum(CAST(l_extendedprice AS DECIMAL(24,6)))"
REVENUE = f"CAST(round({TOTAL}, 2) AS DOUBLE)"
NOT_OUTLIER_DAY = "CAST(ts AS DATE) <> DATE '2024-01-14'"


def slots(table: str, when: str, prefix: str, part: str, count: int, first: int) -> str:
    """One filtered count per matrix column."""
    return ", ".join(
        f"count(*) FILTER ({part}({table}.{when}) = {value}) AS {prefix}{value}"
        for value in range(first, first + count)
    )


def hour_by_day(table: str, when: str, kept: str = "true") -> str:
    cells = slots("f", when, "d", "day", 31, 1)
    return (
        f"WITH f AS (SELECT {when} FROM {table} WHERE {kept}) "
        f"SELECT h.hour, {cells} FROM range(24) h(hour) "
        f"LEFT JOIN f ON hour(f.{when}) = h.hour GROUP BY h.hour"
    )


def weekday_by_hour(table: str, when: str, kept: str = "true") -> str:
    cells = slots("f", when, "h", "hour", 24, 0)
    return (
        f"WITH f AS (SELECT {when} FROM {table} WHERE {kept}), "
        "w AS (SELECT strftime(DATE '2024-01-01' + CAST(i AS INTEGER), '%A') AS weekday"
        " FROM range(7) r(i)) "
        f"SELECT w.weekday, {cells} FROM w "
        f"LEFT JOIN f ON strftime(f.{when}, '%A') = w.weekday GROUP BY w.weekday"
    )


def weekday_hours(table: str, when: str, kept: str = "true") -> str:
    return (
        f"SELECT strftime({when}, '%A') AS weekday, hour({when}) AS hour, "
        f"count(*) AS rentals FROM {table} WHERE {kept} GROUP BY 1, 2"
    )


def favourites(items: str) -> str:
    """Top genre per customer over ``items`` (customer key, genre)."""
    return (
        "WITH n AS (SELECT o_custkey, genre, count(*) AS rental_count FROM ("
        f"{items}) GROUP BY 1, 2) "
        "SELECT c_custkey AS customer_id, c_name AS first_name, "
        "c_mktsegment AS last_name, genre AS preferred_genre, rental_count "
        "FROM n JOIN customer ON c_custkey = o_custkey "
        "QUALIFY row_number() OVER (PARTITION BY c_custkey "
        "ORDER BY rental_count DESC, genre) = 1"
    )


def overdue_rates(catalogue: str, allowed: str) -> str:
    return (
        "WITH r AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, "
        f"datediff('day', o_orderdate, l_shipdate) > {allowed} AS late "
        f"FROM orders JOIN lineitem ON l_orderkey = o_orderkey {catalogue} "
        "WHERE l_shipdate IS NOT NULL) "
        "SELECT month, count(*) AS rentals, count(*) FILTER (late) AS overdue, "
        "CAST(count(*) FILTER (late) AS DOUBLE) * 100 / count(*) AS overdue_percent "
        "FROM r GROUP BY 1"
    )


SLOT_PAIRS = (
    "SELECT strftime(ts, '%A') AS weekday, hour(ts) AS hour, count(*) AS n_all, "
    f"count(*) FILTER ({NOT_OUTLIER_DAY}) AS n_kept FROM events GROUP BY 1, 2"
)

ORACLES: dict[str, str] = {
    "monthly_volume_revenue": f"""
        SELECT strftime(o_orderdate, '%Y-%m') AS month, count(o_orderkey) AS rentals,
               {REVENUE} AS revenue
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1""",
    "store_month_operating_days": f"""
        WITH t AS (
          SELECT s_nationkey, date_trunc('month', l_shipdate) AS m,
                 CAST({TOTAL} * 1000000 AS HUGEINT) AS millionths,
                 count(DISTINCT l_orderkey) AS rentals,
                 count(DISTINCT CAST(l_shipdate AS DATE)) AS operating_days,
                 day(last_day(date_trunc('month', l_shipdate))) AS d
          FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2)
        SELECT CAST(s_nationkey AS BIGINT) AS store_id, strftime(m, '%Y-%m') AS month,
               CAST((millionths + 5000) // 10000 AS DOUBLE) / 100 AS revenue,
               rentals, operating_days,
               CAST((millionths + 5000 * d) // (10000 * d) AS DOUBLE) / 100
                 AS revenue_per_day
        FROM t""",
    "store_month_revenue": f"""
        SELECT CAST(n_nationkey AS BIGINT) AS store_id,
               strftime(l_shipdate, '%Y-%m') AS month,
               {REVENUE} AS revenue,
               count(l_linenumber) AS payments
        FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
             JOIN nation ON n_nationkey = s_nationkey GROUP BY 1, 2""",
    "month_labels": """
        WITH m AS (SELECT date_trunc('month', o_orderdate) AS m, count(*) AS rentals
                   FROM orders GROUP BY 1)
        SELECT strftime(m, '%Y-%m') AS month,
               year(m) || '년 ' || month(m) || '월' AS label,
               year(m) || '년 ' || month(m) || '월' AS label_from_text, rentals,
               format('{:,}', rentals) || '건' AS rentals_label FROM m""",
    "daily_counts": f"""
        SELECT strftime(ts, '{DAY}') AS rental_day, count(*) AS rentals
        FROM events GROUP BY 1""",
    "daily_counts_sql": f"""
        SELECT strftime(date_trunc('week', ts), '{DAY}') AS "주",
               count(DISTINCT CAST(ts AS DATE)) AS "일수",
               count(event_id) AS "대여" FROM events GROUP BY 1""",
    "hour_cube": """
        SELECT date_trunc('hour', ts) AS rental_date, count(*) AS row_count,
               count(event_id) AS id_count FROM events GROUP BY 1""",
    "weekday_hour_counts_from_cube": weekday_hours("events", "ts"),
    "hourly_counts": """
        SELECT hour(ts) AS hour, count(event_id) AS rentals FROM events GROUP BY 1""",
    "single_day_hours": """
        SELECT hour(ts) AS hour, count(*) AS rentals FROM events
        WHERE CAST(ts AS DATE) = DATE '2024-01-14' GROUP BY 1""",
    "weekday_counts": """
        SELECT strftime(ts, '%A') AS weekday, count(*) AS rentals
        FROM events GROUP BY 1""",
    "weekday_hour_counts": weekday_hours("events", "ts"),
    "weekday_hour_counts_excluding": weekday_hours("events", "ts", NOT_OUTLIER_DAY),
    "weekday_hour_counts_excluding_year": weekday_hours(
        "orders", "o_orderdate", "year(o_orderdate) <> 1998"
    ),
    "date_hour_counts": f"""
        SELECT strftime(ts, '{DAY}') AS rental_day, hour(ts) AS hour,
               count(event_id) AS rentals FROM events
        WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'
        GROUP BY 1, 2""",
    "spike_slot_by_month": """
        SELECT strftime(ts, '%Y-%m') AS month, count(*) AS rentals FROM events
        WHERE day(ts) = 14 AND hour(ts) = 15 GROUP BY 1""",
    "heat_month_day": f"""
        SELECT year(o_orderdate) || '년 ' || month(o_orderdate) || '월' AS month_label,
               {slots("orders", "o_orderdate", "d", "day", 31, 1)}
        FROM orders GROUP BY 1""",
    "heat_hour_day": hour_by_day("events", "ts"),
    "heat_hour_day_excluding": hour_by_day("events", "ts", NOT_OUTLIER_DAY),
    "heat_hour_day_excluding_month": hour_by_day(
        "orders",
        "o_orderdate",
        "NOT (year(o_orderdate) = 1998 AND month(o_orderdate) = 2)",
    ),
    "heat_weekday_hour": weekday_by_hour("events", "ts"),
    "heat_weekday_hour_excluding": weekday_by_hour("events", "ts", NOT_OUTLIER_DAY),
    "heat_weekday_hour_excluding_year": weekday_by_hour(
        "orders", "o_orderdate", "year(o_orderdate) <> 1998"
    ),
    "heat_date_hour": f"""
        SELECT strftime(ts, '{DAY}') AS rental_day,
               {slots("events", "ts", "h", "hour", 24, 0)}
        FROM events GROUP BY 1""",
    "hourly_peak": """
        WITH n AS (SELECT hour(ts) AS hour, count(*) AS rentals FROM events GROUP BY 1)
        SELECT hour, rentals, avg(rentals) OVER () AS mean_rentals,
               format('{:.1f}', avg(rentals) OVER ()) AS mean_label,
               hour = first(hour) OVER (ORDER BY rentals DESC, hour
                 ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS is_peak
        FROM n""",
    "weekday_peak": """
        WITH n AS (SELECT strftime(ts, '%A') AS weekday, isodow(ts) AS i,
                          count(*) AS rentals FROM events GROUP BY 1, 2)
        SELECT weekday, rentals, format('{:,}', rentals) AS rentals_label,
               max(rentals) OVER () AS max_rentals,
               i = (SELECT i FROM n ORDER BY rentals DESC, i LIMIT 1) AS is_peak
        FROM n""",
    "top_slots": f"""
        WITH s AS ({SLOT_PAIRS})
        SELECT weekday, hour, n_kept AS rentals FROM s
        WHERE n_kept > 0 AND n_kept >= (SELECT quantile_cont(n_all, 0.95) FROM s)""",
    "top_slots_positional": f"""
        WITH s AS ({SLOT_PAIRS}),
             k AS (SELECT count(*) AS k FROM s WHERE n_kept > 0 AND
                   n_kept >= (SELECT quantile_cont(n_all, 0.95) FROM s)),
             r AS (SELECT weekday, hour, n_all, row_number() OVER (
                     ORDER BY n_all DESC, weekday, hour) AS place FROM s)
        SELECT weekday, hour, n_all AS rentals FROM r
        WHERE place <= (SELECT k FROM k)""",
    "slot_outliers": f"""
        WITH n AS (SELECT CAST(ts AS DATE) AS d, hour(ts) AS hour, count(*) AS rentals
                   FROM events GROUP BY 1, 2),
             u AS (SELECT *, median(rentals) OVER (PARTITION BY hour) AS usual FROM n),
             m AS (SELECT *, median(abs(rentals - usual)) OVER (PARTITION BY hour)
                     AS spread FROM u)
        SELECT strftime(d, '{DAY}') AS rental_day, hour, rentals, usual, spread
        FROM m WHERE rentals - usual > 3 * greatest(spread, 0.5)""",
    "top_category_per_customer": favourites(
        "SELECT o_custkey, p_type AS genre FROM orders "
        "JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey"
    ),
    "top_region_per_customer": favourites(
        "SELECT o_custkey, r_name AS genre FROM orders "
        "JOIN lineitem ON l_orderkey = o_orderkey "
        "JOIN supplier ON s_suppkey = l_suppkey "
        "JOIN nation ON n_nationkey = s_nationkey "
        "JOIN region ON r_regionkey = n_regionkey"
    ),
    "monthly_overdue_rate": overdue_rates(
        "JOIN part ON p_partkey = l_partkey", "p_size"
    ),
    "monthly_overdue_rate_by_nation": overdue_rates(
        "JOIN supplier ON s_suppkey = l_suppkey "
        "JOIN nation ON n_nationkey = s_nationkey",
        "n_nationkey",
    ),
    "table_scan": "SELECT * FROM customer",
    "rental_scan": """
        SELECT event_id AS rental_id, ts AS rental_date, user_id AS customer_id,
               event_type, value, props FROM events""",
    "rental_return_dates": """
        SELECT o_orderdate AS rental_date, l_shipdate AS return_date
        FROM orders JOIN lineitem ON l_orderkey = o_orderkey""",
    "stream_hourly_revenue": f"""
        SELECT date_trunc('hour', ts) AS hour_start, event_type AS kind,
               count(*) AS rentals,
               CAST(round(sum(CAST(value AS DECIMAL(24,6))), 2) AS DOUBLE) AS revenue
        FROM events GROUP BY 1, 2""",
    "stream_surge": """
        WITH n AS (SELECT date_trunc('hour', ts) AS hour_start, count(*) AS rentals
                   FROM events GROUP BY 1),
             u AS (SELECT *, avg(rentals) OVER (
                     PARTITION BY isodow(hour_start), hour(hour_start)
                     ORDER BY hour_start
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS usual
                   FROM n)
        SELECT hour_start, rentals, usual FROM u WHERE rentals > 1.5 * usual""",
    "weekday_counts_by_field": """
        SELECT isodow(ts) AS place, strftime(ts, '%A') AS weekday, count(*) AS rentals
        FROM events GROUP BY 1, 2""",
    "parsed_order_months": """
        SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS rentals,
               day(last_day(min(o_orderdate))) AS days, CAST(NULL AS VARCHAR) AS no_date
        FROM orders GROUP BY 1""",
    "parsed_event_times": """
        SELECT CASE WHEN event_id % 7 <> 0 THEN hour(ts) END AS hour,
               count(*) AS rentals FROM events GROUP BY 1""",
    "weekday_matrix_from_written_cube": weekday_by_hour("events", "ts"),
    "period_revenue": f"""
        SELECT strftime(o_orderdate, '%Y-%m') AS month, count(o_orderkey) AS rentals,
               {REVENUE} AS revenue
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey
        WHERE year(o_orderdate) = 1997 GROUP BY 1""",
    "evolving_rental_scan": """
        SELECT o_orderkey AS rental_id, year(o_orderdate) * 100 + month(o_orderdate) AS month,
               o_orderdate AS rental_date,
               CASE WHEN year(o_orderdate) >= 1997 THEN o_custkey END AS customer_id,
               CASE WHEN year(o_orderdate) >= 1999 THEN o_totalprice END AS price
        FROM orders""",
    "monthly_volume_mysql": f"""
        SELECT strftime(o_orderdate, '%Y-%m') AS month, count(o_orderkey) AS rentals,
               {REVENUE} AS revenue
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1""",
    "weekday_counts_mysql": """
        SELECT strftime(ts, '%A') AS weekday, count(*) AS rentals,
               strftime(min(ts), '%-d %B %Y, %H:%M') AS since
        FROM events GROUP BY 1""",
    "store_days_mysql": """
        SELECT CAST(s_nationkey AS BIGINT) AS store_id, strftime(l_shipdate, '%Y-%m') AS month,
               count(DISTINCT l_orderkey) AS rentals,
               count(DISTINCT CAST(l_shipdate AS DATE)) AS days_open,
               day(last_day(min(l_shipdate))) AS days
        FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2""",
    "date_hours_mysql": """
        SELECT strftime(ts, '%Y-%m-%d') AS day, hour(ts) AS hour, count(event_id) AS rentals
        FROM events
        WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' GROUP BY 1, 2""",
    "stream_late_hours": """
        SELECT date_trunc('hour', ts) AS hour_start, event_type AS kind, count(*) AS rentals,
               CAST(round(sum(CAST(value AS DECIMAL(24,6))), 2) AS DOUBLE) AS revenue
        FROM events
        WHERE ts < TIMESTAMP '2024-01-16'
          AND date_trunc('hour', ts) < (SELECT date_trunc('hour', max(ts)) FROM events
                                        WHERE ts >= TIMESTAMP '2024-01-16') - INTERVAL 48 HOUR
        GROUP BY 1, 2""",
    "weekday_matrix_from_kept_cube": weekday_by_hour("events", "ts"),
    "top_customer_slots": f"""
        WITH n AS (SELECT user_id AS customer_id, strftime(ts, '%A') AS weekday, hour(ts) AS hour,
                          count(*) AS everything, count(*) FILTER ({NOT_OUTLIER_DAY}) AS rentals
                   FROM events GROUP BY 1, 2, 3)
        SELECT customer_id, weekday, hour, rentals FROM n
        WHERE rentals > 0 AND rentals >= (SELECT quantile_cont(everything, 0.95) FROM n)""",
    "top_genre_ignoring_case": """
        WITH n AS (
          SELECT o_custkey, lower(p_type) AS genre, count(*) AS rental_count,
                 min(CASE WHEN p_partkey % 2 = 0 THEN upper(p_type) ELSE lower(p_type) END) AS spelling
          FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey
          GROUP BY 1, 2)
        SELECT c_custkey AS customer_id, c_name AS first_name, c_mktsegment AS last_name,
               spelling AS preferred_genre, rental_count
        FROM n JOIN customer ON c_custkey = o_custkey
        QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY rental_count DESC, genre) = 1""",
}
ORACLES["top_region_of_hot_items"] = ORACLES["top_region_per_customer"]
