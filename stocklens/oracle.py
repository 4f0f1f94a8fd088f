"""The registered queries as DuckDB SQL over the same Parquet tables."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

MAPPING = """
warehouses AS (
  SELECT s_suppkey AS warehouse_id, s_name AS warehouse_name, n_name AS city
  FROM supplier JOIN nation ON n_nationkey = s_nationkey
),
products AS (
  SELECT p_partkey AS product_id, p_name AS product_name, p_brand AS brand_name, p_type AS category_name FROM part
),
customers AS (
  SELECT c_custkey AS customer_id, c_name AS full_name, c_mktsegment AS segment,
         CAST(c_acctbal AS DECIMAL(14,2)) AS balance
  FROM customer
),
customer_orders AS (
  SELECT o_orderkey AS customer_order_id, o_custkey AS customer_id, 'Dock ' || o_orderpriority AS delivery_address,
         CAST(o_orderdate AS TIMESTAMP) AS created_at,
         CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'new' ELSE 'picking' END AS status,
         CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS delivery_priority,
         CAST(o_totalprice AS DECIMAL(14,2)) AS total_amount
  FROM orders
),
customer_order_items AS (
  SELECT l_orderkey AS customer_order_id,
         l_linenumber * 1000000000000 + l_partkey * 100 + CAST(l_quantity AS BIGINT) AS customer_order_item_id,
         l_partkey AS product_id, CAST(l_quantity AS DECIMAL(14,3)) AS ordered_quantity,
         CAST(l_extendedprice AS DECIMAL(14,2)) AS sale_price
  FROM lineitem
),
inventory_movements AS (
  SELECT l_partkey AS product_id, l_suppkey AS warehouse_id,
         CASE WHEN l_returnflag = 'A' THEN 'receipt' WHEN l_returnflag = 'N' THEN 'shipment'
              WHEN l_linestatus = 'F' THEN 'write_off' ELSE 'adjustment' END AS movement_type,
         CAST(l_quantity AS DECIMAL(14,3)) AS quantity, CAST(l_shipdate AS TIMESTAMP) AS moved_at
  FROM lineitem
),
notes AS (
  SELECT event_id AS audit_note_id,
         CASE WHEN event_type = 'error' THEN user_id ELSE event_id // 3 * 4 END AS customer_order_id,
         event_type AS note_type, props AS note_text, CAST(ts AS TIMESTAMP) AS created_at
  FROM events
),
raw_commands AS (
  SELECT user_id * 7 + event_id % 5 - 2 AS customer_order_id, event_id AS seq,
         CASE event_type WHEN 'view' THEN 'picking' WHEN 'purchase' THEN 'shipped' WHEN 'click' THEN 'confirmed'
              WHEN 'error' THEN 'cancelled' ELSE CASE WHEN event_id % 2 = 0 THEN 'delivered' ELSE 'lost' END
         END AS status
  FROM events
),
commands AS (
  SELECT customer_order_id, seq,
         CASE WHEN status IN ('new','confirmed','picking','shipped','delivered','cancelled') THEN status
              ELSE 'confirmed' END AS status
  FROM raw_commands
),
changes AS (
  SELECT event_id AS seq, user_id * 4 + event_id % 4 + 1 AS inventory_movement_id, event_id // 2 AS product_id,
         user_id AS warehouse_id,
         CASE event_type WHEN 'view' THEN 'receipt' WHEN 'purchase' THEN 'shipment' WHEN 'click' THEN 'write_off'
              ELSE 'adjustment' END AS movement_type,
         CAST(value AS DECIMAL(14,3)) AS quantity, date_trunc('millisecond', CAST(ts AS TIMESTAMP)) AS moved_at,
         user_id + 1 AS employee_id,
         CASE event_type WHEN 'signup' THEN 'c' WHEN 'error' THEN 'd' ELSE 'u' END AS cdc_op,
         event_id AS cdc_source_ts_ms, event_id AS version,
         CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS is_deleted
  FROM events
),
current_movements AS (
  SELECT * EXCLUDE (newest, is_deleted, seq)
  FROM (SELECT *, row_number() OVER (PARTITION BY inventory_movement_id ORDER BY version DESC, seq DESC) AS newest
        FROM changes)
  WHERE newest = 1 AND is_deleted = 0
),
requests AS (
  SELECT CAST(ts AS TIMESTAMP) AS ts,
         CASE event_type WHEN 'view' THEN 'oltp_read' WHEN 'purchase' THEN 'oltp_insert' WHEN 'click' THEN 'oltp_update'
              WHEN 'error' THEN 'log_insert' ELSE 'olap_revenue' END AS profile,
         value AS duration_ms, CASE WHEN value > 300 THEN 500 ELSE 200 END AS status, value > 300 AS failed
  FROM events
),
samples AS (
  SELECT CASE WHEN event_type IN ('view','click') THEN 'pg_stat_database_blks_hit'
              WHEN event_type = 'error' THEN 'pg_stat_database_blks_read'
              WHEN event_type = 'purchase' THEN 'pg_stat_database_xact_commit'
              ELSE 'pg_stat_activity_count' END AS metric,
         'db' || (user_id % 7) AS datname, 'node' || user_id AS instance,
         CASE WHEN event_type = 'signup' THEN CASE WHEN event_id % 3 = 0 THEN 'idle' ELSE 'active' END
              WHEN event_type = 'view' THEN 'idle' ELSE 'active' END AS state,
         CAST(ts AS TIMESTAMP) AS ts, floor(value) AS value
  FROM events
)
"""

START = "TIMESTAMP '1990-01-01'"
END = "TIMESTAMP '2100-01-01'"
ORDERS_FROM, ORDERS_TO = "TIMESTAMP '1996-03-05 12:00:00'", "TIMESTAMP '1998-07-01'"
EVENTS_FROM, EVENTS_TO = "TIMESTAMP '2024-01-20 06:00:00'", "TIMESTAMP '2024-01-30'"
AS_OF = "TIMESTAMP '2024-02-01'"
AS_OF_TEXT = "'2024-02-01 00:00:00.000000'"


def stamp(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"


def date(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d')"


def add(name: str, body: str, extra: str = "") -> None:
    """A query over the mapped tables; ``extra`` holds further named subqueries."""
    ORACLE[name] = f"WITH {MAPPING.strip()}{',' + extra if extra else ''}\n{body}"


# --- analytic reports ------------------------------------------------------


def turnover(restriction: str = "", start: str = START, end: str = END, least: int = 1) -> str:
    return f"""SELECT warehouse_id, warehouse_name, product_id, product_name,
  CAST(received AS DOUBLE) AS received_quantity, CAST(shipped AS DOUBLE) AS shipped_quantity,
  CAST(total - received - shipped AS DOUBLE) AS adjusted_quantity, CAST(total AS DOUBLE) AS total_quantity,
  CAST(dense_rank() OVER (PARTITION BY warehouse_id ORDER BY total DESC) AS BIGINT) AS product_rank
FROM (
  SELECT warehouse_id, product_id, sum(quantity) AS total,
    coalesce(sum(quantity) FILTER (WHERE movement_type = 'receipt'), 0) AS received,
    coalesce(sum(quantity) FILTER (WHERE movement_type = 'shipment'), 0) AS shipped
  FROM inventory_movements WHERE moved_at >= {start} AND moved_at < {end} {restriction} GROUP BY ALL)
JOIN warehouses USING (warehouse_id) JOIN products USING (product_id)
WHERE total >= {least}
QUALIFY product_rank <= 10"""


add("turnover_all_locations", turnover())
add(
    "turnover_top_locations",
    turnover(
        f"""AND warehouse_id IN (
    SELECT warehouse_id FROM inventory_movements WHERE moved_at >= {START} AND moved_at < {END}
    GROUP BY warehouse_id ORDER BY sum(quantity) DESC, warehouse_id LIMIT 100)"""
    ),
)

add(
    "turnover_best_sellers",
    turnover(
        f"""AND warehouse_id IN (
    SELECT warehouse_id FROM inventory_movements WHERE moved_at >= {ORDERS_FROM} AND moved_at < {ORDERS_TO}
    GROUP BY warehouse_id ORDER BY sum(quantity) DESC, warehouse_id LIMIT 10)""",
        ORDERS_FROM,
        ORDERS_TO,
        40,
    ),
)

REVENUE = """
amounts AS (
  SELECT customer_order_id, category_name, sum(ordered_quantity * sale_price) AS amount
  FROM customer_order_items JOIN products USING (product_id) GROUP BY ALL
),
daily AS (
  SELECT CAST(created_at AS DATE) AS sales_day, category_name, count(DISTINCT customer_order_id) AS order_count,
         sum(amount) AS revenue, CAST(coalesce(sum(n), 0) AS BIGINT) AS audit_note_count
  FROM amounts JOIN customer_orders USING (customer_order_id)
  LEFT JOIN (SELECT customer_order_id, count(*) AS n FROM notes GROUP BY ALL) USING (customer_order_id)
  GROUP BY ALL
)"""


def revenue(kind: str) -> str:
    value = f"CAST(CAST(revenue AS {kind}) AS DOUBLE)"
    return f"SELECT {date('sales_day')} AS sales_day, category_name, order_count, {value} AS revenue, audit_note_count FROM"


NEWEST = "ORDER BY d.sales_day DESC, d.revenue DESC, d.category_name LIMIT 100"
add("revenue_by_day", f"{revenue('DECIMAL(38,5)')} (SELECT * FROM daily d {NEWEST})", REVENUE)
add(
    "revenue_between",
    f"""{revenue('DECIMAL(38,5)')} (
  SELECT * FROM daily d ORDER BY d.sales_day DESC, d.revenue DESC, d.category_name LIMIT 5000)""",
    REVENUE.replace(
        "JOIN customer_orders USING (customer_order_id)",
        f"""JOIN (SELECT * FROM customer_orders WHERE created_at >= {ORDERS_FROM} AND created_at < {ORDERS_TO})
  USING (customer_order_id)""",
    ),
)
add(
    "revenue_between_stored",
    f"""{revenue('DECIMAL(18,2)')} (
  SELECT * FROM (SELECT * REPLACE (CAST(revenue AS DECIMAL(18,2)) AS revenue) FROM daily) d
  WHERE sales_day >= CAST({ORDERS_FROM} AS DATE) AND sales_day < CAST({ORDERS_TO} AS DATE)
  ORDER BY d.sales_day DESC, d.revenue DESC, d.category_name LIMIT 5000)""",
    REVENUE,
)
add("revenue_all_days", f"{revenue('DECIMAL(38,5)')} daily", REVENUE)
add("revenue_stored", f"{revenue('DECIMAL(18,2)')} daily", REVENUE)
add(
    "revenue_by_day_stored",
    f"""{revenue('DECIMAL(18,2)')} (
  SELECT * FROM (SELECT * REPLACE (CAST(revenue AS DECIMAL(18,2)) AS revenue) FROM daily) d {NEWEST})""",
    REVENUE,
)
ORACLE["revenue_from_periods"] = ORACLE["revenue_between"]
ORACLE["revenue_after_refresh"] = ORACLE["revenue_stored"]
ORACLE["turnover_from_periods"] = ORACLE["turnover_best_sellers"]
add(
    "order_document_lines",
    f"""SELECT customer_order_id, customer_id, full_name, delivery_address, {stamp('o.created_at')} AS created_at,
  status, delivery_priority, CAST(total_amount AS DOUBLE) AS total_amount, CAST(0 AS BIGINT) AS items_count,
  coalesce(noted, 0) AS audit_note_count, note_text AS last_audit_note, customer_order_item_id, product_id,
  product_name, brand_name, category_name, CAST(ordered_quantity AS DOUBLE) AS ordered_quantity,
  CAST(sale_price AS DOUBLE) AS sale_price
FROM customer_orders o JOIN customers USING (customer_id)
JOIN customer_order_items USING (customer_order_id) JOIN products USING (product_id)
LEFT JOIN (
  SELECT customer_order_id, note_text, count(*) OVER (PARTITION BY customer_order_id) AS noted FROM notes
  QUALIFY row_number() OVER (PARTITION BY customer_order_id ORDER BY created_at DESC, audit_note_id DESC) = 1
) USING (customer_order_id)""",
)
add(
    "order_document_totals",
    """SELECT co.customer_order_id AS order_id, c.full_name AS customer_name, count(*) AS line_count,
  CAST(sum(i.sale_price) AS DOUBLE) AS price_sum
FROM customer_orders co
JOIN customers c ON c.customer_id = co.customer_id
JOIN customer_order_items i ON i.customer_order_id = co.customer_order_id
JOIN products p ON p.product_id = i.product_id
GROUP BY co.customer_order_id, c.full_name""",
)
add(
    "order_document_parts",
    """SELECT customer_order_id, CAST((place - 1) // 3 AS BIGINT) AS part, count(*) AS line_count,
  min(customer_order_item_id) AS first_line
FROM (
  SELECT customer_order_id, customer_order_item_id,
    row_number() OVER (PARTITION BY customer_order_id ORDER BY customer_order_item_id) AS place
  FROM customer_order_items JOIN products USING (product_id))
JOIN customer_orders USING (customer_order_id) JOIN customers USING (customer_id)
GROUP BY ALL""",
)
add(
    "order_documents_by_id",
    """SELECT customer_order_id, full_name,
  (SELECT count(*) FROM notes n WHERE n.customer_order_id = o.customer_order_id) AS audit_note_count,
  count(*) AS line_count
FROM customer_orders o JOIN customers USING (customer_id)
JOIN customer_order_items USING (customer_order_id) JOIN products USING (product_id)
WHERE customer_order_id IN (SELECT c_custkey * 3 FROM customer)
GROUP BY customer_order_id, full_name""",
)

# --- change stream and dashboards -----------------------------------------

CURRENT_COLUMNS = f"""inventory_movement_id, product_id, warehouse_id, movement_type,
  CAST(quantity AS DOUBLE) AS quantity, {stamp('moved_at')} AS moved_at, employee_id, cdc_op, cdc_source_ts_ms, version"""
for _name in [
    "current_movements",
    "current_from_envelopes",
    "stream_current_movements",
    "compacted_current_movements",
]:
    add(_name, f"SELECT {CURRENT_COLUMNS} FROM current_movements")
DELIVERED = """
deliveries AS (
  SELECT *, seq % 4 AS delivery FROM changes UNION ALL SELECT *, 4 FROM changes WHERE seq % 10 = 3
)"""
add(
    "delivered_current_movements",
    f"""SELECT {CURRENT_COLUMNS}
FROM (SELECT * REPLACE (greatest(version, half) AS version),
        row_number() OVER (PARTITION BY inventory_movement_id
          ORDER BY greatest(version, half) DESC, delivery DESC, seq DESC) AS newest
      FROM deliveries, (SELECT max(event_id) // 2 AS half FROM events) WHERE seq % 50 NOT IN (7, 8, 9))
WHERE newest = 1 AND is_deleted = 0""",
    extra=DELIVERED,
)
add(
    "delivered_rejects",
    """SELECT CASE seq % 50 WHEN 7 THEN 'no message ' || seq WHEN 8 THEN '{"__op": "u", "__source_ts_ms": ' || seq || '}'
  ELSE '{"inventory_movement_id": "x' || seq || '"}' END AS value, count(*) AS times
FROM deliveries WHERE seq % 50 IN (7, 8, 9) GROUP BY 1""",
    extra=DELIVERED,
)
add(
    "snapshot_then_changes",
    f"""SELECT {CURRENT_COLUMNS} FROM (
  SELECT *, row_number() OVER (PARTITION BY inventory_movement_id ORDER BY version DESC, seq DESC) AS newest FROM (
    SELECT * FROM changes
    UNION ALL BY NAME
    SELECT -1 AS seq, o_orderkey + 1 AS inventory_movement_id, o_orderkey AS product_id, o_custkey AS warehouse_id,
      'receipt' AS movement_type, CAST(o_totalprice AS DECIMAL(14,3)) AS quantity,
      CAST(o_orderdate AS TIMESTAMP) AS moved_at, 1 AS employee_id, 'r' AS cdc_op, 0 AS cdc_source_ts_ms,
      0 AS version, 0 AS is_deleted
    FROM orders))
WHERE newest = 1 AND is_deleted = 0""",
)
RANGE = f"WHERE moved_at >= {START} AND moved_at < {END}"
TOTAL = "SELECT CAST(coalesce(sum(quantity), 0) AS DOUBLE) AS total_moved_quantity FROM current_movements"
add("kpi_total_quantity", f"{TOTAL} {RANGE}")
add("kpi_total_quantity_unbounded", TOTAL)
add(
    "daily_by_type",
    f"""SELECT {date('moved_at')} AS movement_day, movement_type, CAST(sum(quantity) AS DOUBLE) AS total_quantity
FROM current_movements {RANGE} GROUP BY 1, 2 ORDER BY 1, 2""",
)
add(
    "top_locations",
    f"""SELECT 'Warehouse ' || warehouse_id AS warehouse_name, CAST(sum(quantity) AS DOUBLE) AS total_quantity
FROM current_movements {RANGE} GROUP BY warehouse_id ORDER BY sum(quantity) DESC, warehouse_id LIMIT 10""",
)
BETWEEN = f"WHERE moved_at >= {EVENTS_FROM} AND moved_at < {EVENTS_TO}"
add("kpi_total_quantity_between", f"{TOTAL} {BETWEEN}")
for _name, _range, _limit in [("between", BETWEEN, 5), ("unbounded", "", 10)]:
    add(
        f"daily_by_type_{_name}",
        f"""SELECT {date('moved_at')} AS movement_day, movement_type, CAST(sum(quantity) AS DOUBLE) AS total_quantity
FROM current_movements {_range} GROUP BY 1, 2""",
    )
    add(
        f"top_locations_{_name}",
        f"""SELECT 'Warehouse ' || warehouse_id AS warehouse_name, CAST(sum(quantity) AS DOUBLE) AS total_quantity
FROM current_movements {_range} GROUP BY warehouse_id ORDER BY sum(quantity) DESC, warehouse_id LIMIT {_limit}""",
    )
add(
    "type_share",
    """SELECT movement_type, CAST(sum(quantity) AS DOUBLE) AS total_quantity,
  round(CAST(sum(quantity) AS DOUBLE) / (SELECT CAST(sum(quantity) AS DOUBLE) FROM current_movements), 9) AS share
FROM current_movements GROUP BY movement_type ORDER BY total_quantity DESC""",
)
add(
    "movements_by_id",
    f"""SELECT {CURRENT_COLUMNS} FROM current_movements
WHERE inventory_movement_id IN (SELECT c_custkey + 1 FROM customer)""",
)

# --- merges and ids ---------------------------------------------------------

NEWCOMERS = """
newcomers AS (
  SELECT o_orderkey AS customer_id, 'Order ' || o_orderkey AS full_name, o_orderpriority AS segment,
         CAST(o_totalprice AS DECIMAL(14,2)) AS balance
  FROM orders
)"""
add(
    "upsert_customers",
    """SELECT coalesce(c.customer_id, n.customer_id) AS customer_id, coalesce(c.full_name, n.full_name) AS full_name,
  coalesce(c.segment, n.segment) AS segment, CAST(coalesce(n.balance, c.balance) AS DOUBLE) AS balance
FROM customers c FULL JOIN newcomers n ON n.customer_id = c.customer_id""",
    NEWCOMERS,
)
add(
    "insert_missing_customers",
    """SELECT customer_id, full_name, segment, CAST(balance AS DOUBLE) AS balance FROM (
  SELECT * FROM customers UNION ALL
  SELECT * FROM newcomers n WHERE NOT EXISTS (SELECT 1 FROM customers c WHERE c.customer_id = n.customer_id))""",
    NEWCOMERS,
)
add(
    "delete_ordering_customers",
    """SELECT customer_id, full_name, segment, CAST(balance AS DOUBLE) AS balance FROM customers c
WHERE NOT EXISTS (SELECT 1 FROM customer_orders o WHERE o.customer_id = c.customer_id AND o.delivery_priority = 1)""",
)
TOTALS = """
totals AS (
  SELECT customer_order_id, CAST(sum(ordered_quantity * sale_price) AS DECIMAL(14,2)) AS amount, count(*) AS n
  FROM customer_order_items GROUP BY customer_order_id
)"""
add(
    "backfill_order_totals",
    f"""SELECT o.customer_order_id, o.customer_id, o.delivery_address, {stamp('o.created_at')} AS created_at, o.status,
  o.delivery_priority, CAST(coalesce(t.amount, o.total_amount, 0) AS DOUBLE) AS total_amount,
  coalesce(t.n, 0) AS items_count, {stamp('o.created_at')} AS last_status_changed_at
FROM customer_orders o LEFT JOIN totals t ON t.customer_order_id = o.customer_order_id""",
    TOTALS,
)
add(
    "numbered_notes",
    f"""SELECT audit_note_id, {stamp('created_at')} AS created_at,
  1000 + row_number() OVER (ORDER BY created_at, audit_note_id) AS note_number FROM notes""",
)
add(
    "cyclic_locations",
    """SELECT o.customer_order_id, o.customer_order_id + 1 AS n, w.warehouse_id
FROM customer_orders o
JOIN (SELECT warehouse_id, row_number() OVER (ORDER BY warehouse_id) AS place FROM warehouses) w
  ON w.place = o.customer_order_id % (SELECT count(*) FROM warehouses) + 1""",
)

add(
    "bounded_customers",
    """SELECT customer_order_id, customer_order_id + 1 AS n,
  (SELECT min(customer_id) FROM customers) + customer_order_id % (SELECT count(*) FROM customers) AS customer_id
FROM customer_orders""",
)

# --- order jobs -------------------------------------------------------------


def draw(seed: int, *parts: str) -> str:
    text = " || '-' || ".join([f"'{seed}'", *parts])
    return f"CAST('0x' || substr(md5({text}), 1, 12) AS BIGINT)"


CREATED = f"""
people AS (SELECT customer_id, row_number() OVER (ORDER BY customer_id) - 1 AS place FROM customers),
goods AS (SELECT product_id, row_number() OVER (ORDER BY product_id) - 1 AS place FROM products),
numbered AS (
  SELECT event_id + 1 AS request_id, row_number() OVER (ORDER BY event_id) - 1 AS n,
         (SELECT count(*) FROM people) AS np, (SELECT count(*) FROM goods) AS ng
  FROM events
),
free AS (
  SELECT *, {draw(17, 'request_id')} % np AS customer_place, {draw(7, 'request_id')} % ng AS a,
         {draw(8, 'request_id')} % (ng - 1) AS b0, {draw(9, 'request_id')} % (ng - 2) AS c0
  FROM numbered
),
second AS (SELECT *, b0 + CASE WHEN b0 >= a THEN 1 ELSE 0 END AS b FROM free),
third AS (SELECT *, c0 + CASE WHEN c0 >= least(a, b) THEN 1 ELSE 0 END AS c1 FROM second),
picks AS (
  SELECT *, [a, b, c1 + CASE WHEN c1 >= greatest(a, b) THEN 1 ELSE 0 END] AS places, 500001 + n AS customer_order_id
  FROM third
),
lines AS (
  SELECT request_id, n, customer_order_id, i, places[i + 1] AS place
  FROM picks CROSS JOIN (SELECT unnest(range(3)) AS i)
),
items AS (
  SELECT n * 3 + i + 700001 AS customer_order_item_id, customer_order_id, product_id,
         CAST(l.place + 2 AS DECIMAL(14,3)) AS ordered_quantity,
         CAST(20 + {draw(27, 'request_id', 'i')} % 150 AS DECIMAL(14,2)) AS sale_price
  FROM lines l JOIN goods g ON g.place = l.place
),
created AS (
  SELECT p.customer_order_id, q.customer_id,
         'Load street ' || ({draw(18, 'request_id')} % 1000) || ', building ' || ({draw(19, 'request_id')} % 200)
           AS delivery_address,
         t.total_amount, t.items_count
  FROM picks p JOIN people q ON q.place = p.customer_place
  JOIN (SELECT customer_order_id, CAST(sum(ordered_quantity * sale_price) AS DECIMAL(14,2)) AS total_amount,
               count(*) AS items_count FROM items GROUP BY customer_order_id) t
    ON t.customer_order_id = p.customer_order_id
)"""
add(
    "created_orders",
    f"""SELECT customer_order_id, customer_id, delivery_address, {AS_OF_TEXT} AS created_at, 'new' AS status,
  '2024-02-02 00:00:00.000000' AS delivery_window_start, '2024-02-02 04:00:00.000000' AS delivery_window_end,
  CAST(1 AS BIGINT) AS delivery_priority, CAST(total_amount AS DOUBLE) AS total_amount, items_count,
  {AS_OF_TEXT} AS last_status_changed_at FROM created""",
    CREATED,
)
add(
    "created_order_items",
    """SELECT customer_order_item_id, customer_order_id, product_id,
  CAST(ordered_quantity AS DOUBLE) AS ordered_quantity, CAST(sale_price AS DOUBLE) AS sale_price FROM items""",
    CREATED,
)
add(
    "created_order_notes",
    f"""SELECT customer_order_id + 400000 AS audit_note_id, customer_order_id, 'operator' AS note_type,
  'Order created by orders-api workload' AS note_text, {AS_OF_TEXT} AS created_at FROM created""",
    CREATED,
)
add(
    "order_creation_results",
    f"""SELECT c.customer_order_id, customer_id, delivery_address, {AS_OF_TEXT} AS created_at, 'new' AS status,
  CAST(total_amount AS DOUBLE) AS total_amount, items_count, i.item_count
FROM created c LEFT JOIN (SELECT customer_order_id, count(*) AS item_count FROM items GROUP BY 1) i
  ON i.customer_order_id = c.customer_order_id""",
    CREATED,
)
STEPS = """
steps AS (
  SELECT c.customer_order_id, c.seq, c.status AS new_status,
         coalesce(lag(c.status) OVER (PARTITION BY c.customer_order_id ORDER BY c.seq), o.status) AS old_status
  FROM commands c JOIN customer_orders o ON o.customer_order_id = c.customer_order_id
),
numbered_steps AS (SELECT *, row_number() OVER (ORDER BY seq) AS id FROM steps),
last_command AS (SELECT customer_order_id, arg_max(status, seq) AS status FROM commands GROUP BY customer_order_id)"""
ORDERS_AFTER = f"""SELECT o.customer_order_id, o.customer_id, coalesce(l.status, o.status) AS status,
  CASE WHEN l.status IS NULL THEN {stamp('o.created_at')} ELSE {AS_OF_TEXT} END AS last_status_changed_at
FROM customer_orders o LEFT JOIN last_command l ON l.customer_order_id = o.customer_order_id"""
add("status_changes_orders", ORDERS_AFTER, STEPS)
add("stream_status_orders", ORDERS_AFTER, STEPS)
EVENT = f"customer_order_id, old_status, new_status, 'orders-api' AS event_source, {AS_OF_TEXT} AS created_at"
add("status_changes_events", f"SELECT id AS order_status_event_id, {EVENT} FROM numbered_steps", STEPS)
add("stream_status_events", f"SELECT {EVENT} FROM steps", STEPS)
add(
    "status_changes_notes",
    f"""SELECT id AS audit_note_id, customer_order_id, 'status' AS note_type,
  'Status changed from ' || old_status || ' to ' || new_status || ' by orders-api workload' AS note_text,
  {AS_OF_TEXT} AS created_at FROM numbered_steps""",
    STEPS,
)
add(
    "status_change_results",
    """SELECT customer_order_id, old_status, new_status, id AS order_status_event_id, id AS audit_note_id
FROM numbered_steps""",
    STEPS,
)
add(
    "drawn_log_orders",
    f"""SELECT c.seq, c.status, o.customer_order_id FROM raw_commands c
JOIN (SELECT customer_order_id, row_number() OVER (ORDER BY customer_order_id) - 1 AS place FROM customer_orders) o
  ON o.place = {draw(7, 'c.seq')} % (SELECT count(*) FROM customer_orders)""",
)
add(
    "logged_status_events",
    f"""SELECT row_number() OVER (ORDER BY c.seq) AS order_status_event_id, c.customer_order_id,
  o.status AS old_status, c.status AS new_status, 'k6-log-stream' AS event_source, {AS_OF_TEXT} AS created_at
FROM commands c JOIN customer_orders o ON o.customer_order_id = c.customer_order_id""",
)

# --- data quality -----------------------------------------------------------

ORACLE["duplicate_line_keys"] = """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, count(*) AS copies
FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1"""
add(
    "commands_without_order",
    """SELECT customer_order_id, count(*) AS child_rows FROM raw_commands
WHERE customer_order_id NOT IN (SELECT customer_order_id FROM customer_orders) GROUP BY customer_order_id""",
)
add(
    "missing_order_values",
    """SELECT 'customer_id' AS column_name, count(*) FILTER (WHERE customer_id IS NULL) AS null_rows FROM customer_orders
UNION ALL SELECT 'created_at', count(*) FILTER (WHERE created_at IS NULL) FROM customer_orders
UNION ALL SELECT 'status', count(*) FILTER (WHERE status IS NULL) FROM customer_orders
UNION ALL SELECT 'items_count', count(*) FROM customer_orders
UNION ALL SELECT 'last_status_changed_at', count(*) FROM customer_orders""",
)
add(
    "unknown_statuses",
    """SELECT status AS bad_value, count(*) AS row_count FROM raw_commands
WHERE status NOT IN ('new','confirmed','picking','shipped','delivered','cancelled') GROUP BY status""",
)
add(
    "wrong_order_totals",
    """SELECT o.customer_order_id, CAST(o.total_amount AS DOUBLE) AS total_amount,
  CAST(coalesce(t.amount, 0) AS DOUBLE) AS line_amount, CAST(0 AS BIGINT) AS items_count, coalesce(t.n, 0) AS line_count
FROM customer_orders o LEFT JOIN totals t ON t.customer_order_id = o.customer_order_id
WHERE o.total_amount IS DISTINCT FROM coalesce(t.amount, 0) OR coalesce(t.n, 0) <> 0""",
    TOTALS,
)
add(
    "movement_differences",
    """SELECT coalesce(u.inventory_movement_id, c.inventory_movement_id) AS inventory_movement_id,
  CASE WHEN c.inventory_movement_id IS NULL THEN 'missing_in_sink'
       WHEN u.inventory_movement_id IS NULL THEN 'missing_in_source' ELSE 'different' END AS difference
FROM undeleted u FULL JOIN current_movements c ON c.inventory_movement_id = u.inventory_movement_id
WHERE c.inventory_movement_id IS NULL OR u.inventory_movement_id IS NULL
   OR (u.movement_type, u.quantity, u.moved_at) IS DISTINCT FROM (c.movement_type, c.quantity, c.moved_at)""",
    """
undeleted AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY inventory_movement_id ORDER BY version DESC, seq DESC) AS k
                 FROM changes WHERE is_deleted = 0) WHERE k = 1
)""",
)

# --- metrics and latency ----------------------------------------------------

SERIES = "metric, datname, instance, state"


def steps(window: int) -> str:
    return f"""
stepped AS (
  SELECT {SERIES}, epoch_us(ts) // {window}000000 * {window} AS window_start, value,
         lag(value) OVER (PARTITION BY {SERIES} ORDER BY ts) AS before
  FROM samples
),
rates AS (
  SELECT {SERIES}, window_start,
         sum(CASE WHEN value < before THEN value ELSE value - before END) / {window} AS rate
  FROM stepped WHERE before IS NOT NULL GROUP BY ALL
)"""


add(
    "counter_rates",
    f"""SELECT datname, instance, state, metric, window_start, round(rate, 9) AS rate FROM rates
WHERE metric <> 'pg_stat_activity_count'""",
    steps(300),
)
add(
    "cache_hit_ratio",
    """SELECT datname, window_start,
  round(CASE WHEN sum(rate) = 0 THEN NULL ELSE
    sum(CASE WHEN metric = 'pg_stat_database_blks_hit' THEN rate ELSE 0 END) / sum(rate) END, 9) AS hit_ratio
FROM rates WHERE metric IN ('pg_stat_database_blks_hit', 'pg_stat_database_blks_read') GROUP BY datname, window_start""",
    steps(86_400),
)
add(
    "transactions_per_second",
    """SELECT a.datname, a.instance, a.state, a.window_start, round(a.rate + b.rate, 9) AS rate
FROM rates a JOIN rates b USING (datname, instance, state, window_start)
WHERE a.metric = 'pg_stat_database_xact_commit' AND b.metric = 'pg_stat_database_blks_read'""",
    steps(86_400),
)
NOW = f"""
now AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {SERIES} ORDER BY ts DESC, value DESC) AS k FROM samples
                 WHERE ts <= {AS_OF}) WHERE k = 1
)"""
CONNECTIONS = "metric = 'pg_stat_activity_count'"
add(
    "connections_by_state",
    f"""SELECT state, sum(value) AS value FROM now WHERE {CONNECTIONS} GROUP BY state
UNION ALL SELECT 'total', sum(value) FROM now WHERE {CONNECTIONS}""",
    NOW,
)
add("gauge_by_database", f"SELECT datname, max(value) AS value FROM now WHERE {CONNECTIONS} GROUP BY datname", NOW)
add("database_names", f"SELECT DISTINCT datname FROM samples WHERE {CONNECTIONS}")
add("series_values", f"SELECT datname, instance, state, metric, value FROM now", NOW)
ORACLE["statement_mean_time"] = """WITH newest AS (
  SELECT event_type || '-' || user_id AS queryid, value AS seconds, CAST(event_id % 9 AS DOUBLE) AS calls,
         row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC) AS k
  FROM events
)
SELECT queryid, round(seconds / greatest(calls, 1.0) * 1000, 6) AS mean_ms
FROM newest WHERE k = 1 ORDER BY seconds / greatest(calls, 1.0) * 1000 DESC, queryid LIMIT 5"""
ORACLE["backup_staleness"] = f"""WITH newest AS (
  SELECT 'db' || user_id AS db, event_type AS bucket,
         CASE WHEN value > 20 THEN floor(epoch(ts)) ELSE 0.0 END AS value,
         row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC) AS k
  FROM events
)
SELECT db, bucket, epoch({AS_OF}) - value AS seconds_since_success FROM newest WHERE k = 1 AND value > 0"""
REPORT = """
report AS (
  SELECT profile, count(duration_ms) AS requests,
         CAST(sum(CAST(duration_ms AS DECIMAL(18,6))) AS DOUBLE) / count(duration_ms) AS avg,
         min(duration_ms) AS min, max(duration_ms) AS max,
         count(duration_ms) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6) AS per_second,
         quantile_cont(duration_ms, 0.5) AS med, quantile_cont(duration_ms, 0.9) AS p90,
         quantile_cont(duration_ms, 0.95) AS p95
  FROM requests GROUP BY profile
)"""
add(
    "latency_by_profile",
    """SELECT profile, requests, round(avg, 6) AS avg, min, max, round(per_second, 6) AS per_second,
  round(med, 6) AS med, round(p90, 6) AS p90, round(p95, 6) AS p95 FROM report""",
    REPORT,
)
add(
    "threshold_verdicts",
    """SELECT threshold, round(measured, 6) AS measured, allowed, measured < allowed AS passed FROM (
  SELECT 'p95 ' || profile AS threshold, p95 AS measured,
    CASE WHEN profile IN ('oltp_read', 'log_insert') THEN 100.0::DOUBLE WHEN profile LIKE 'olap%' THEN 30000.0::DOUBLE
         ELSE 10000.0::DOUBLE END AS allowed
  FROM report
  UNION ALL SELECT 'failure rate', count(*) FILTER (WHERE failed) / count(*), 0.05::DOUBLE FROM requests)""",
    REPORT,
)
add(
    "check_counts",
    """SELECT replace(profile, '_', ' ') || ' status is ' || expected AS check_name,
  count(*) FILTER (WHERE status = expected) AS passes, count(*) FILTER (WHERE status <> expected) AS fails
FROM (SELECT *, CASE WHEN profile = 'oltp_insert' THEN 201 ELSE 200 END AS expected FROM requests)
GROUP BY profile, expected""",
)
add(
    "run_comparison",
    """SELECT a.profile, round(a.p95, 6) AS p95_before, round(b.p95, 6) AS p95_after,
  round((b.p95 - a.p95) * 100 / a.p95, 6) AS change_percent
FROM report a JOIN (
  SELECT profile,
    quantile_cont(CASE WHEN profile = 'oltp_read' THEN duration_ms * 1.5 ELSE duration_ms + 2 END, 0.95) AS p95
  FROM requests GROUP BY profile) b ON b.profile = a.profile""",
    REPORT,
)
ORACLE["slowest_statements"] = """SELECT 'SELECT' || chr(10) || '"' || event_type || '", ' || user_id AS query,
  max(value) AS mean_exec_time, count(*) AS calls, CAST(sum(event_id) AS BIGINT) AS shared_blks_hit,
  max(event_id) AS shared_blks_read
FROM events GROUP BY event_type, user_id ORDER BY mean_exec_time DESC, query LIMIT 500"""
add(
    "newest_notes",
    f"""SELECT audit_note_id, customer_order_id, note_type, note_text, {stamp('created_at')} AS created_at
FROM notes ORDER BY audit_note_id DESC LIMIT 5""",
)
add(
    "sampled_products",
    f"SELECT * FROM products ORDER BY {draw(7, 'product_id')}, product_id LIMIT 100",
)

ORACLE["upsert_customers_bucketed"] = ORACLE["upsert_customers"]
ORACLE["backfill_order_totals_bucketed"] = ORACLE["backfill_order_totals"]


def failing(kind: str, table: str, subject: str, condition: str) -> str:
    return f"""SELECT '{kind}' AS check_kind, '{table}' AS table_name, '{subject}' AS subject,
  count(*) FILTER (WHERE {condition}) AS violations FROM {table}_now"""


def repeated(table: str, keys: str) -> str:
    return f"""SELECT 'unique', '{table}', '{keys}', count(*) FROM (SELECT 1 FROM {table}_now GROUP BY {keys} HAVING count(*) > 1)"""


def unparented(table: str, column: str, parent: str, of: str) -> str:
    return failing("reference", table, column, f"{column} IS NOT NULL AND {column} NOT IN (SELECT {of} FROM {parent}_now)")


SPOILT = """
customers_now AS (
  SELECT customer_id, full_name FROM customers UNION ALL SELECT customer_id, NULL FROM customers WHERE customer_id % 50 = 0
), warehouses_now AS (SELECT * FROM warehouses
), products_now AS (SELECT product_id, product_name FROM products
), customer_orders_now AS (
  SELECT * REPLACE (
    CASE customer_order_id % 100 WHEN 3 THEN 'lost' WHEN 4 THEN NULL ELSE status END AS status,
    CASE WHEN customer_order_id % 200 = 5 THEN -customer_id ELSE customer_id END AS customer_id,
    CASE WHEN customer_order_id % 150 <> 2 THEN created_at END AS created_at)
  FROM customer_orders
), customer_order_items_now AS (SELECT * FROM customer_order_items
), inventory_movements_now AS (
  SELECT * REPLACE (CASE WHEN product_id % 90 = 1 THEN 'moved' ELSE movement_type END AS movement_type)
  FROM inventory_movements
), customer_order_audit_notes_now AS (SELECT * FROM notes)"""
_statuses = "('new','confirmed','picking','shipped','delivered','cancelled')"
_checks = [
    failing("domain", "customer_orders", "status", f"status NOT IN {_statuses}"),
    failing("domain", "inventory_movements", "movement_type",
            "movement_type NOT IN ('receipt','shipment','write_off','adjustment')"),
]
for _table, _columns in {
    "customers": "customer_id full_name",
    "warehouses": "warehouse_id warehouse_name city",
    "products": "product_id product_name",
    "customer_orders": "customer_order_id customer_id delivery_address created_at status",
    "customer_order_items": "customer_order_item_id customer_order_id product_id ordered_quantity sale_price",
    "inventory_movements": "product_id warehouse_id movement_type quantity moved_at",
    "customer_order_audit_notes": "audit_note_id customer_order_id note_type note_text created_at",
}.items():
    _checks += [failing("not_null", _table, c, f"{c} IS NULL") for c in _columns.split()]
_checks += [
    repeated(*pair)
    for pair in [
        ("customers", "customer_id"),
        ("warehouses", "warehouse_id"),
        ("warehouses", "warehouse_name"),
        ("products", "product_id"),
        ("customer_orders", "customer_order_id"),
        ("customer_order_items", "customer_order_item_id"),
        ("customer_order_items", "customer_order_id,product_id"),
        ("customer_order_audit_notes", "audit_note_id"),
    ]
]
_checks += [
    unparented("customer_orders", "customer_id", "customers", "customer_id"),
    unparented("customer_order_items", "customer_order_id", "customer_orders", "customer_order_id"),
    unparented("customer_order_items", "product_id", "products", "product_id"),
    unparented("inventory_movements", "product_id", "products", "product_id"),
    unparented("inventory_movements", "warehouse_id", "warehouses", "warehouse_id"),
    unparented("customer_order_audit_notes", "customer_order_id", "customer_orders", "customer_order_id"),
]
add("constraint_violations", "\nUNION ALL ".join(_checks), SPOILT)
add(
    "wrong_backfilled_totals",
    """SELECT * FROM (
  SELECT o.customer_order_id,
    CAST(coalesce(t.amount, 0) + CASE WHEN o.customer_order_id % 300 = 7 THEN 0.01 ELSE 0 END AS DOUBLE) AS total_amount,
    CAST(coalesce(t.amount, 0) AS DOUBLE) AS line_amount,
    coalesce(t.n, 0) - CASE WHEN o.customer_order_id % 500 = 8 THEN 1 ELSE 0 END AS items_count,
    coalesce(t.n, 0) AS line_count
  FROM customer_orders o LEFT JOIN totals t ON t.customer_order_id = o.customer_order_id)
WHERE customer_order_id % 300 = 7 OR customer_order_id % 500 = 8""",
    TOTALS,
)


# --- overviews ----------------------------------------------------------------

ORACLE["commits_and_rollbacks_per_second"] = """WITH transactions AS (
  SELECT CASE WHEN event_id % 3 = 0 THEN 'rollback' ELSE 'commit' END AS metric, user_id % 5 AS db,
         'node' || user_id % 2 AS instance, CAST(ts AS TIMESTAMP) AS ts, floor(value) AS value
  FROM events WHERE user_id % 5 < 3
), stepped AS (
  SELECT metric, db, instance, epoch_us(ts) // 86400000000 * 86400 AS window_start, value,
         lag(value) OVER (PARTITION BY metric, db, instance ORDER BY ts) AS before
  FROM transactions
), rates AS (
  SELECT metric, db, instance, window_start,
         sum(CASE WHEN value < before THEN value ELSE value - before END) / 86400 AS rate
  FROM stepped WHERE before IS NOT NULL GROUP BY ALL
)
SELECT 'db' || a.db AS datname, instance, window_start, round(a.rate + b.rate, 9) AS rate
FROM rates a JOIN rates b USING (db, instance, window_start) WHERE a.metric = 'commit' AND b.metric = 'rollback'"""

OVERVIEW = f"""WITH taken AS (
  SELECT *, event_id % 14 AS k FROM events
), samples AS (
  SELECT CASE k WHEN 0 THEN 'pg_up' WHEN 1 THEN 'pg_database_size_bytes' WHEN 2 THEN 'pg_stat_database_numbackends'
           WHEN 6 THEN 'minio_cluster_capacity_usable_free_bytes' WHEN 7 THEN 'backup_last_size_bytes'
           WHEN 8 THEN 'patroni_primary' WHEN 9 THEN 'patroni_replica' WHEN 10 THEN 'etcd_server_has_leader'
           WHEN 11 THEN 'haproxy_server_up' WHEN 12 THEN 'haproxy_server_up' WHEN 13 THEN 'pg_replication_lag_seconds'
           ELSE 'up' END AS metric,
         CASE WHEN k NOT IN (1, 2) THEN '' WHEN user_id % 4 = 3 THEN 'template1' ELSE 'db' || user_id % 4 END AS datname,
         'node' || user_id % 3 AS instance,
         CASE k WHEN 3 THEN 'minio' WHEN 4 THEN 'backup_exporter' WHEN 5 THEN 'etcd' ELSE '' END AS job,
         CASE k WHEN 11 THEN 'patroni_primary' WHEN 12 THEN 'patroni_replica' ELSE '' END AS backend, ts,
         CASE WHEN k IN (1, 2, 6, 7, 13) THEN floor(value) WHEN value > 50 THEN 1.0 ELSE 0.0 END AS value
  FROM taken
), now AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY metric, datname, instance, job, backend ORDER BY ts DESC, value DESC) AS place
    FROM samples WHERE ts <= {AS_OF}) WHERE place = 1
)
"""
ORACLE["database_overview"] = OVERVIEW + """SELECT 'up' AS report, '' AS datname, max(value) AS value FROM now WHERE metric = 'pg_up'
UNION ALL SELECT 'size_bytes', '', sum(value) FROM now WHERE metric = 'pg_database_size_bytes' AND datname <> 'template1'
UNION ALL SELECT 'connections', datname, sum(value) FROM now
  WHERE metric = 'pg_stat_database_numbackends' AND datname <> 'template1' GROUP BY datname"""
ORACLE["backup_overview"] = OVERVIEW + """SELECT 'storage_up' AS report, max(value) AS value FROM now WHERE job = 'minio'
UNION ALL SELECT 'exporter_up', max(value) FROM now WHERE job = 'backup_exporter'
UNION ALL SELECT 'free_bytes', sum(value) FROM now WHERE metric = 'minio_cluster_capacity_usable_free_bytes'
UNION ALL SELECT 'last_size_bytes', value FROM now WHERE metric = 'backup_last_size_bytes'"""
ORACLE["cluster_counts"] = OVERVIEW + """SELECT
  sum(value) FILTER (WHERE metric = 'patroni_primary') AS primaries,
  sum(value) FILTER (WHERE metric = 'patroni_replica') AS replicas,
  sum(value) FILTER (WHERE metric = 'etcd_server_has_leader') AS members_with_leader,
  sum(value) FILTER (WHERE metric = 'up' AND job = 'etcd') AS members_up,
  sum(value) FILTER (WHERE metric = 'haproxy_server_up' AND backend = 'patroni_primary') AS proxy_backends_up,
  max(value) FILTER (WHERE metric = 'pg_up') AS database_up
FROM now"""
ORACLE["cluster_members"] = OVERVIEW + """SELECT metric, instance, job, backend, value FROM now
WHERE metric IN ('patroni_primary', 'patroni_replica', 'etcd_server_has_leader', 'up', 'pg_up', 'haproxy_server_up',
  'pg_replication_lag_seconds')"""

# Ids after which shipment and receipt movements are numbered.
SHIPMENT_BASE, RECEIPT_BASE = 540_000, 530_000


def combined(apart: bool) -> str:
    receipts_from = "(SELECT count(*) FROM shipped) + " if apart else ""
    taken = "" if apart else "WHERE inventory_movement_id NOT IN (SELECT inventory_movement_id FROM received)"
    base = SHIPMENT_BASE if apart else RECEIPT_BASE
    columns = f"""inventory_movement_id, product_id, warehouse_id, movement_type, CAST(quantity AS DOUBLE) AS quantity,
  {stamp('moved_at')} AS moved_at, employee_id"""
    return f"""WITH lines AS (
  SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS n, l_partkey AS product_id, o_custkey % 10 + 1 AS warehouse_id,
         CAST(l_quantity AS DECIMAL(14,3)) AS quantity, CAST(o_orderdate AS TIMESTAMP) AS moved_at,
         o_custkey % 7 + 1 AS employee_id, l_returnflag = 'R' AS came_back
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey
), shipped AS (
  SELECT *, {SHIPMENT_BASE} + row_number() OVER (ORDER BY n) AS inventory_movement_id, 'shipment' AS movement_type
  FROM lines WHERE NOT came_back
), received AS (
  SELECT *, {receipts_from}{base} + row_number() OVER (ORDER BY n) AS inventory_movement_id, 'receipt' AS movement_type
  FROM lines WHERE came_back
)
SELECT {columns} FROM shipped {taken} UNION ALL SELECT {columns} FROM received"""


ORACLE["combined_movements"] = combined(apart=False)
ORACLE["combined_movements_apart"] = combined(apart=True)

# --- stored tables --------------------------------------------------------------

add(
    "orders_of_two_schemas",
    """SELECT customer_order_id, status, CAST(NULL AS VARCHAR) AS delivery_window_start,
  CASE WHEN customer_order_id % 3 <> 0 THEN delivery_priority END AS delivery_priority,
  CASE WHEN customer_order_id % 3 <> 0 THEN CAST(total_amount AS DOUBLE) END AS total_amount
FROM customer_orders""",
)
add(
    "stored_requests",
    f"""SELECT profile, CAST(status AS BIGINT) AS status, count(*) AS requests, count(*) FILTER (WHERE failed) AS failures,
  {stamp("date_trunc('millisecond', min(ts))")} AS first_at, max(duration_ms) AS longest_ms
FROM requests GROUP BY profile, status""",
)
add(
    "stored_samples",
    """SELECT metric, datname, instance, state, count(*) AS samples, max(value) AS greatest
FROM samples GROUP BY metric, datname, instance, state""",
)
ORACLE["revenue_rebuilt"] = ORACLE["revenue_stored"]
add(
    "probing_movement",
    f"""SELECT CAST(990001 AS BIGINT) AS inventory_movement_id, (SELECT min(product_id) FROM products) AS product_id,
  (SELECT min(warehouse_id) FROM warehouses) AS warehouse_id, 'adjustment' AS movement_type, 11.111::DOUBLE AS quantity,
  {AS_OF_TEXT} AS moved_at, (SELECT min(customer_id) FROM customers) AS employee_id""",
)
add(
    "customer_contacts",
    f"""SELECT customer_id, '+100000' || lpad(CAST(customer_id AS VARCHAR), CAST(greatest(5, length(CAST(customer_id AS VARCHAR))) AS INT), ' ') AS phone,
  {stamp(f'{AS_OF} - to_days(CAST(customer_id % 400 AS INT))')} AS created_at,
  strftime(CAST({AS_OF} AS DATE) - CAST(customer_id % 90 AS INT), '%Y-%m-%d') AS hired_at,
  strftime(CAST({AS_OF} AS DATE) + CAST(customer_id % 30 AS INT), '%Y-%m-%d') AS expiration_date
FROM customers""",
)
