"""The domain tables of ``souklens.sources.market`` stated in SQL over the same parquet tables."""

from __future__ import annotations

ISO = "'%Y-%m-%dT%H:%M:%S'"

LINE_ID = "l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || strftime(l_shipdate, '%Y%m%d')"
CENTS = "CAST(round(l_extendedprice * 100) AS BIGINT)"
EACH = (f"CAST(((2 * {CENTS} + CAST(l_quantity AS BIGINT)) // (2 * CAST(l_quantity AS BIGINT))) AS DECIMAL(18,2)) / 100")
LINE = f"""CAST(l_quantity AS INTEGER) AS quantity, CAST({EACH} AS DECIMAL(10,2)) AS unit_price_usd,
    CAST(l_extendedprice AS DECIMAL(12,2)) AS line_total_usd"""

USER = ("email", "full_name", "country_code", "city")


def looked_up(table: str, key: str, value: str, *same: str, **renamed: str) -> str:
    """Columns of the row of ``table`` whose ``key`` is ``value``, each by a lookup of its own."""
    columns = {**{c: c for c in same}, **renamed}
    return ", ".join(f"(SELECT hit.{column} FROM {table} hit WHERE hit.{key} = {value}) AS {name}" for name, column in columns.items())


#: name -> (tables needed, body)
TABLES: dict[str, tuple[tuple[str, ...], str]] = {
    "users": ((), """
        SELECT c_custkey AS id, c_name || '@example.org' AS email, c_name AS full_name,
            CASE WHEN c_custkey % 37 <> 0 THEN n_name END AS country_code, c_mktsegment AS city,
            TIMESTAMP '1995-01-01' + to_days(CAST(c_custkey % 365 AS INTEGER)) AS created_at,
            CASE WHEN c_custkey % 5 <> 0 THEN TIMESTAMP '2001-08-01' - to_days(CAST(c_custkey % 90 AS INTEGER)) END AS last_login_at,
            c_acctbal > 0 AS is_active
        FROM customer JOIN nation ON n_nationkey = c_nationkey"""),
    "sellers": ((), f"""
        SELECT CAST(s_suppkey AS VARCHAR) AS user_id, s_name AS display_name, s_name || ', Ltd' AS legal_name,
            'T' || s_suppkey AS tax_id, lower(s_name) || '@pay.example.org' AS payout_email, n_name AS country_code,
            CASE WHEN s_acctbal > 0 THEN 'True' ELSE 'False' END AS is_verified,
            CASE WHEN s_suppkey % 4 <> 0 THEN 'Sells "goods", since ' || year(opened) END AS bio,
            '"' || strftime(opened, {ISO}) || '+00:00"' AS created_at,
            '"' || strftime(opened, {ISO}) || '+00:00"' AS updated_at, opened
        FROM (SELECT *, TIMESTAMP '2001-08-01' - to_days(CAST(s_suppkey * 37 % 1500 AS INTEGER)) AS opened FROM supplier)
        JOIN nation ON n_nationkey = s_nationkey"""),
    "products": ((), """
        SELECT p_partkey AS product_id, CAST(seller AS VARCHAR) AS seller_id, p_name AS name,
            replace(p_name, ' ', '-') || '-' || p_partkey AS slug, p_type AS product_type, p_brand AS description,
            CAST((CAST(p_retailprice AS DECIMAL(12,2)) - 900) * CAST(1.5 AS DECIMAL(3,1)) AS DECIMAL(10,2)) AS price_usd,
            'USD' AS currency, p_size > 5 AS is_active,
            TIMESTAMP '1994-01-01' + to_days(CAST(p_partkey % 700 AS INTEGER)) AS created_at,
            TIMESTAMP '1994-01-31' + to_days(CAST(p_partkey % 700 AS INTEGER)) AS updated_at
        FROM part LEFT JOIN (SELECT l_partkey, min(l_suppkey) AS seller FROM lineitem GROUP BY 1) ON l_partkey = p_partkey"""),
    "orders_d": ((), f"""
        SELECT o_orderkey AS id, o_custkey AS user_id, o_orderkey AS invoice_id, o_orderstatus AS status,
            n_name AS shipping_country, strftime(o_orderdate, {ISO}) || '+00:00' AS created_at, o_orderdate AS created_ts
        FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey"""),
    "order_items": ((), f"""
        SELECT {LINE_ID} AS id, l_orderkey AS order_id, l_partkey AS product_id, {LINE} FROM lineitem"""),
    "mkt_invoices": ((), f"""
        SELECT o_orderkey AS id, o_custkey AS user_id,
            CASE o_orderstatus WHEN 'F' THEN 'paid' ELSE 'pending' END AS status,
            CAST(o_totalprice AS DECIMAL(12,2)) AS total_usd, strftime(o_orderdate, {ISO}) || '+00:00' AS created_at
        FROM orders WHERE o_orderstatus <> 'P'"""),
    "mkt_lines": ((), f"""
        SELECT {LINE_ID} || '-M' AS id, l_orderkey AS invoice_id, l_partkey AS product_id, {LINE}
        FROM lineitem"""),
    "events_d": ((), """
        SELECT event_id AS id, user_id,
            CASE event_type
                WHEN 'view' THEN CASE WHEN event_id % 2 = 0 THEN 'page_view' ELSE 'product_view' END
                WHEN 'click' THEN CASE WHEN event_id % 2 = 0 THEN 'search' ELSE 'add_to_cart' END
                WHEN 'signup' THEN 'checkout_start' ELSE event_type END AS event_type,
            CASE WHEN k < 90 THEN k * ((SELECT count(*) FROM part) // 100) END AS product_id,
            's-' || user_id || '-' || (event_id % 7) AS session_id, props AS metadata,
            ts - to_months(CAST(270 + event_id % 79 AS INTEGER)) AS occurred_at
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"""),
    "tiers": ((), """
        SELECT DISTINCT o_orderpriority AS id, o_orderpriority AS name, 'Plan ' || o_orderpriority AS description FROM orders"""),
    "pricing": (("tiers",), """
        SELECT id || '-1' AS id, id AS tier_id, CAST(CAST(substr(id, 1, 1) AS INTEGER) * 10 - 0.01 AS DECIMAL(10,2)) AS monthly_price_usd,
            TIMESTAMP '1995-01-01' AS valid_from, TIMESTAMP '1998-07-01' AS valid_to, false AS is_active FROM tiers
        UNION ALL
        SELECT id || '-2', id, CAST(CAST(substr(id, 1, 1) AS INTEGER) * 10 + 2 AS DECIMAL(10,2)),
            TIMESTAMP '1998-07-01', NULL, true FROM tiers WHERE id <> '5-LOW'"""),
    "subscriptions": ((), """
        SELECT o_orderkey AS id, o_custkey AS user_id, o_orderpriority AS tier_id,
            CASE WHEN o_orderkey % 3 = 0 THEN 'cancelled' ELSE 'active' END AS status,
            o_orderdate AS started_at, o_orderdate AS current_period_start,
            CASE WHEN o_orderkey % 17 <> 0 THEN o_orderdate + to_days(CASE WHEN o_orderstatus = 'F' THEN 365 ELSE 30 END) END AS current_period_end,
            CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + to_days(CAST(o_orderkey % 200 AS INTEGER)) END AS cancelled_at,
            CASE WHEN o_orderkey % 3 = 0 THEN 'reason-' || (o_orderkey % 4) END AS cancel_reason,
            CASE WHEN o_orderstatus = 'F' THEN 'annual' ELSE 'monthly' END AS billing_cycle, o_orderdate AS created_at,
            CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + to_days(CAST(o_orderkey % 200 AS INTEGER)) ELSE o_orderdate END AS updated_at
        FROM orders"""),
    "sub_invoices": ((), f"""
        SELECT *, CAST(subtotal_usd - discount_usd AS DECIMAL(12,2)) AS total_usd FROM (
            SELECT {LINE_ID} AS id, o_custkey AS user_id, l_orderkey AS subscription_id, 'subscription' AS invoice_type,
                CASE l_returnflag WHEN 'N' THEN 'paid' WHEN 'R' THEN 'overdue' ELSE 'pending' END AS status,
                CAST(l_extendedprice AS DECIMAL(12,2)) AS subtotal_usd,
                CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(4,2)) AS DECIMAL(12,2)) AS tax_usd,
                CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(12,2)) AS discount_usd,
                l_shipdate AS billing_period_start, l_shipdate + to_days(30) AS billing_period_end,
                CASE WHEN l_returnflag = 'N' THEN l_shipdate + to_days(CAST(l_partkey % 30 AS INTEGER)) END AS paid_at,
                l_shipdate + to_days(14) AS due_at, l_shipdate AS created_at
            FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""),
    "sub_lines": ((), f"""
        SELECT {LINE_ID} || '-L1' AS id, {LINE_ID} AS invoice_id, l_partkey AS product_id,
            'Item ' || l_linenumber AS description, {LINE}, l_shipdate AS created_at
        FROM lineitem WHERE l_linenumber <> 7"""),
    "basket": (("order_items", "products"), """
        SELECT DISTINCT order_id, i.product_id FROM order_items i JOIN products p ON p.product_id = i.product_id"""),
    "pairs": (("basket",), """
        SELECT a.product_id AS product_1_id, b.product_id AS product_2_id, count(*) AS co_purchase_count
        FROM basket a JOIN basket b ON a.order_id = b.order_id AND a.product_id < b.product_id GROUP BY 1, 2"""),
    # an event of a known user, beside what the user's and the product's row say
    "user_activity": (("users", "events_d", "products"), f"""
        SELECT seen.id AS event_id, seen.user_id AS id, event_type, product_id, metadata, occurred_at,
            {looked_up("users", "id", "seen.user_id", *USER, "created_at", "last_login_at", "is_active")},
            {looked_up("products", "product_id", "seen.product_id", "product_type", "seller_id",
                       product_name="name", product_price_usd="price_usd", product_is_active="is_active")}
        FROM events_d seen WHERE EXISTS (FROM users WHERE id = seen.user_id)"""),
    # a line whose order and buyer are known
    "user_orders": (("users", "orders_d", "order_items", "mkt_invoices"), f"""
        WITH sold AS (
            SELECT product_id, quantity, unit_price_usd, line_total_usd, order_id,
                {looked_up("orders_d", "id", "line.order_id", "shipping_country", "created_ts",
                           id="user_id", bill="invoice_id", order_status="status", order_created_at="created_at")}
            FROM order_items line)
        SELECT sold.* EXCLUDE (bill), {looked_up("users", "id", "sold.id", *USER)},
            {looked_up("mkt_invoices", "id", "sold.bill", marketplace_invoice_id="id", invoice_status="status")}
        FROM sold WHERE id IN (SELECT id FROM users)"""),
    # the price is that of the period of the plan that began last, if it had not ended
    "user_subscription": (("users", "subscriptions", "tiers", "pricing"), f"""
        WITH begun AS (
            SELECT *, (SELECT arg_max(period, period.valid_from) FROM pricing period
                       WHERE period.valid_from <= sub.started_at AND period.tier_id = sub.tier_id) AS last_price
            FROM subscriptions sub WHERE user_id IN (SELECT id FROM users)),
        charged AS (SELECT *, CASE WHEN coalesce(last_price.valid_to > started_at, true) THEN last_price END AS price FROM begun)
        SELECT user_id, tier_id, id AS sub_id, status AS sub_status, started_at, current_period_start, current_period_end, cancelled_at,
            cancel_reason, billing_cycle, created_at AS sub_created_at, updated_at AS sub_updated_at, price.id AS price_id,
            price.monthly_price_usd AS monthly_price_usd, price.valid_from AS price_valid_from, price.valid_to AS price_valid_to, price.is_active AS price_is_active,
            {looked_up("users", "id", "charged.user_id", *USER, "last_login_at", user_created_at="created_at", user_is_active="is_active")},
            {looked_up("tiers", "id", "charged.tier_id", tier_name="name", tier_description="description")}
        FROM charged"""),
    "sub_cohort": (("user_subscription",), """
        WITH lives AS (SELECT *, coalesce(cancelled_at, current_period_end) AS ends FROM user_subscription)
        SELECT subscription_id: sub_id, subscription_status: sub_status, user_id, user_email: email, user_full_name: full_name,
            user_country_code: country_code, user_city: city, tier_id, tier_name, billing_cycle, monthly_price_usd, started_at,
            current_period_start, current_period_end, cancelled_at, cancel_reason,
            cohort_month: make_timestamp(year(started_at), month(started_at), 1, 0, 0, 0.0),
            days_active: date_diff('second', started_at, ifnull(ends, TIMESTAMP '2001-08-01')) / 86400.0,
            retained_30d: CAST(ifnull(ends - INTERVAL 30 DAY >= started_at, false) AS INTEGER),
            retained_90d: CAST(ifnull(ends - INTERVAL 90 DAY >= started_at, false) AS INTEGER),
            churned_flag: CAST(cancelled_at IS NOT NULL AS INTEGER)
        FROM lives"""),
    "geography": (("users", "sellers", "orders_d"), """
        WITH places AS (SELECT country_code FROM users UNION SELECT country_code FROM sellers UNION SELECT shipping_country FROM orders_d)
        SELECT country_code,
            total_orders: (SELECT count(*) FROM orders_d WHERE shipping_country IS NOT DISTINCT FROM places.country_code),
            total_sellers: (SELECT count(*) FROM sellers WHERE sellers.country_code IS NOT DISTINCT FROM places.country_code),
            total_users: (SELECT count(*) FROM users WHERE users.country_code IS NOT DISTINCT FROM places.country_code)
        FROM places"""),
    "affinity_type": (("pairs", "products"), f"""
        WITH told AS (
            SELECT *, {looked_up("products", "product_id", "pairs.product_1_id", product_1_type="product_type", product_1_seller_id="seller_id")},
                {looked_up("products", "product_id", "pairs.product_2_id", product_2_type="product_type", product_2_seller_id="seller_id")}
            FROM pairs)
        SELECT *, if(ifnull(product_1_type = product_2_type, false), 'same', 'cross') || '_type' AS affinity_type_category,
            if(ifnull(product_1_seller_id = product_2_seller_id, false), 'same', 'cross') || '_seller' AS affinity_seller_category
        FROM told"""),
}


def with_tables(body: str, *needed: str) -> str:
    """``body`` preceded by the table definitions it needs, each once and in order of use."""
    order: list[str] = []

    def add(name: str) -> None:
        for other in TABLES[name][0]:
            add(other)
        if name not in order:
            order.append(name)

    for name in needed:
        add(name)
    if not order:
        return body
    definitions = ",\n".join(f"{name} AS ({TABLES[name][1]})" for name in order)
    joined = body.strip()
    if joined.upper().startswith("WITH "):
        return f"WITH {definitions},\n{joined[5:]}"
    return f"WITH {definitions}\n{joined}"


def pct(part: str, whole: str, digits: int = 2) -> str:
    """100 * part / whole of whole numbers, rounded half away from zero in integer arithmetic."""
    return rounded(f"100 * CAST({part} AS HUGEINT)", whole, digits)


def rounded(numerator: str, denominator: str, digits: int = 2) -> str:
    """numerator / denominator of whole numbers (denominator positive), rounded half away from zero."""
    k = 10 ** digits
    n, d = f"({numerator})", f"CAST(({denominator}) AS HUGEINT)"
    half_up = f"sign({n}) * ((2 * {k} * abs(CAST({n} AS HUGEINT)) + {d}) // (2 * nullif({d}, 0)))"
    return f"CAST({half_up} AS DOUBLE) / {k}.0"
