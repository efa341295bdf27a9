"""Access, consolidation, fact and dimension datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from souklens.operators import baskets
from souklens.plans import access, consolidation, dimensions, facts
from souklens.session import new_path
from souklens.sources import delimited, documents, schemas
from souklens.sources.market import Market, as_of
from souklens.workload.registry import query

ORDERS_SQL = """SELECT CAST(id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS user_id, CAST(invoice_id AS VARCHAR) AS invoice_id,
    status, shipping_country, created_at FROM orders_d"""
ORDER_ITEMS_SQL = """SELECT id, CAST(order_id AS VARCHAR) AS order_id, CAST(product_id AS VARCHAR) AS product_id, quantity,
    CAST(unit_price_usd AS DOUBLE) AS unit_price_usd, CAST(line_total_usd AS DOUBLE) AS line_total_usd FROM order_items"""
MKT_INVOICES_SQL = """SELECT CAST(id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS user_id, status,
    CAST(total_usd AS DOUBLE) AS total_usd, created_at FROM mkt_invoices"""
EVENTS_SQL = """SELECT CAST(id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS user_id, event_type,
    CAST(product_id AS VARCHAR) AS product_id, replace(metadata, ' ', '') AS metadata,
    strftime(occurred_at, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS occurred_at FROM events_d"""


def _hex32(column: str) -> str:
    return f"lpad(lower(printf('%x', CAST({column} AS BIGINT))), 32, '0')"


def _uuid(column: str) -> str:
    h = _hex32(column)
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return f"CASE WHEN {column} IS NOT NULL THEN " + " || '-' || ".join(f"substr({h}, {a}, {b})" for a, b in cuts) + " END"


PRODUCTS_SQL = f"""SELECT base64(unhex({_hex32('product_id')})) AS product_id_b64, {_uuid('product_id')} AS product_id,
    base64(unhex({_hex32('seller_id')})) AS seller_id_b64, {_uuid('seller_id')} AS seller_id, name, slug, product_type,
    description, CAST(price_usd AS DOUBLE) AS price_usd, currency, CASE WHEN is_active THEN 'true' ELSE 'false' END AS is_active,
    created_at, updated_at FROM products"""
BOUGHT_WITH_SQL = """SELECT product_1_id, a.name AS product_1_name, product_2_id, b.name AS product_2_name, co_purchase_count
    FROM pairs JOIN products a ON a.product_id = product_1_id JOIN products b ON b.product_id = product_2_id"""
SELLERS_SQL = """SELECT user_id, display_name, legal_name, tax_id, payout_email, country_code, is_verified, bio,
    created_at, updated_at FROM sellers"""


# Staged once for a session, as a load does; queries time the reader alone.


def staged_orders(m: Market) -> DataFrame:
    return m.once("staged_orders", lambda: documents.stage_arrays(m.orders()))


def staged_order_items(m: Market) -> DataFrame:
    return m.once("staged_order_items", lambda: documents.stage_arrays(m.order_items()))


def staged_invoices(m: Market) -> DataFrame:
    return m.once("staged_invoices", lambda: documents.stage_arrays(m.marketplace_invoices()))


def staged_events(m: Market) -> DataFrame:
    """Events as documents; the metadata text becomes a nested object."""
    nested = m.events_text().withColumn("metadata", F.from_json("metadata", "k int"))
    return m.once("staged_events", lambda: documents.stage_arrays(nested))


def _binary_id(column: str):
    padded = F.lpad(F.hex(F.col(column).cast("long")), 32, "0")
    return F.struct(F.struct(F.base64(F.unhex(padded)).alias("base64")).alias("$binary")).alias(column)


def catalogue_documents(m: Market) -> DataFrame:
    """The catalogue as the document store serves it."""
    when = [F.struct(F.unix_millis(F.col(c)).alias("$date")).alias(c) for c in ("created_at", "updated_at")]
    return m.products().select(
        _binary_id("product_id").alias("id"), _binary_id("seller_id").alias("seller_id"), "name", "slug", "product_type",
        "description", "price_usd", "currency", F.col("is_active").cast("string").alias("is_active"), *when)


@query("pg_orders", ORDERS_SQL, "orders_d")
def pg_orders(m: Market) -> DataFrame:
    return access.orders(staged_orders(m))


@query("pg_order_items", ORDER_ITEMS_SQL, "order_items")
def pg_order_items(m: Market) -> DataFrame:
    return access.order_items(staged_order_items(m))


@query("pg_mkt_invoices", MKT_INVOICES_SQL, "mkt_invoices")
def pg_mkt_invoices(m: Market) -> DataFrame:
    return access.marketplace_invoices(staged_invoices(m))


@query("ts_events", EVENTS_SQL, "events_d")
def ts_events(m: Market) -> DataFrame:
    return access.events(staged_events(m))


@query("mg_products", PRODUCTS_SQL, "products")
def mg_products(m: Market) -> DataFrame:
    return access.products(m.once("staged_products", lambda: documents.stage_arrays(catalogue_documents(m))))


@query("bought_with", BOUGHT_WITH_SQL, "pairs", "products")
def bought_with(m: Market) -> DataFrame:
    return access.bought_with(m.order_items(), m.products())


@query("seller_profiles", SELLERS_SQL, "sellers")
def seller_profiles(m: Market) -> DataFrame:
    path = new_path(m.spark, "sellers_csv")
    delimited.write_csv(m.sellers(), path)
    return delimited.read_external(m.spark, path, schemas.SELLER_PROFILE)


# consolidation ------------------------------------------------------------------------------


def pairs(m: Market) -> DataFrame:
    return baskets.bought_with(m.order_items(), m.products())


@query("cons_user_activity", """
    SELECT * REPLACE (CAST(product_price_usd AS DOUBLE) AS product_price_usd) FROM user_activity""", "user_activity")
def cons_user_activity(m: Market) -> DataFrame:
    return consolidation.user_activity(m.users(), m.events_text(), m.products())


def _of_product(side: int, column: str) -> str:
    return f"(SELECT {column} FROM products WHERE product_id = product_{side}_id)"


@query("cons_product_affinity", "SELECT product_1_id, product_2_id, co_purchase_count, " + ", ".join(
    f"{_of_product(side, value)} AS product_{side}_{name}" for side in (1, 2)
    for name, value in (("name", "name"), ("type", "product_type"), ("price", "CAST(price_usd AS DOUBLE)"), ("seller_id", "seller_id"))) + " FROM pairs",
    "pairs", "products")
def cons_product_affinity(m: Market) -> DataFrame:
    return consolidation.product_affinity(pairs(m), m.products())


def _lookup(table: str, key: str, value: str, columns: dict[str, str]) -> str:
    """Each column as its own lookup of the row of ``table`` whose ``key`` is ``value``."""
    return ", ".join(f"(SELECT x.{c} FROM {table} x WHERE x.{key} = {value}) AS {name}" for name, c in columns.items())


@query("cons_seller_order_revenue", f"""
    WITH sold AS (
        SELECT line.*, {_lookup("products", "product_id", "line.product_id", {"seller_id": "seller_id", "name": "name", "product_type": "product_type"})}
        FROM order_items line)
    SELECT seller_id, product_id, name, product_type, order_id, id AS order_item_id, quantity, CAST(unit_price_usd AS DOUBLE) AS unit_price_usd,
        CAST(line_total_usd AS DOUBLE) AS line_total_usd,
        {_lookup("sellers", "user_id", "sold.seller_id", {"display_name": "display_name", "country_code": "country_code", "is_verified": "is_verified"})},
        {_lookup("orders_d", "id", "sold.order_id", {"buyer_user_id": "user_id", "order_status": "status", "shipping_country": "shipping_country", "created_at": "created_at"})}
    FROM sold WHERE seller_id IN (SELECT user_id FROM sellers) AND order_id IN (SELECT id FROM orders_d)""",
    "sellers", "products", "order_items", "orders_d")
def cons_seller_order_revenue(m: Market) -> DataFrame:
    return consolidation.seller_order_revenue(m.sellers(), m.products(), m.order_items(), m.orders())


@query("cons_invoices", f"""
    WITH every AS (
        SELECT id AS invoice_id, user_id, invoice_type, status AS invoice_status, total_usd, billing_period_start, billing_period_end, paid_at, due_at
        FROM sub_invoices
        UNION ALL BY NAME
        SELECT CAST(id AS VARCHAR) AS invoice_id, user_id, status AS invoice_status, total_usd FROM mkt_invoices)
    SELECT every.* EXCLUDE (total_usd), CAST(total_usd AS DOUBLE) AS amount_usd, user_id AS user_id_ref,
        {_lookup("users", "id", "every.user_id", {"full_name": "full_name"})}
    FROM every WHERE user_id IN (SELECT id FROM users)""", "sub_invoices", "mkt_invoices", "users")
def cons_invoices(m: Market) -> DataFrame:
    names = consolidation.user_names(m.users())
    market = m.marketplace_invoices().join(names, F.col("user_id") == F.col("user_id_ref"))
    return consolidation.invoices(m.subscription_invoices(names), market)


# facts --------------------------------------------------------------------------------------


def user_subscription(m: Market) -> DataFrame:
    return facts.user_subscription(m.users(), m.subscriptions(), m.tiers(), m.tier_pricing())


def sub_cohort(m: Market) -> DataFrame:
    return facts.sub_cohort(user_subscription(m), as_of())


query("cons_user_subscription", """
    SELECT * REPLACE (CAST(monthly_price_usd AS DOUBLE) AS monthly_price_usd) FROM user_subscription""",
    "user_subscription")(user_subscription)

SUB_COHORT_SQL = "SELECT * REPLACE (CAST(monthly_price_usd AS DOUBLE) AS monthly_price_usd, CAST(days_active AS DOUBLE) AS days_active) FROM sub_cohort"
query("cons_sub_cohort", SUB_COHORT_SQL, "sub_cohort")(sub_cohort)


@query("cons_sub_billing", """
    WITH parts AS (
        SELECT invoice_id, id AS line_item_id, product_id, description AS line_description, quantity, unit_price_usd, line_total_usd,
            created_at AS line_created_at FROM sub_lines
        UNION ALL BY NAME
        SELECT id AS invoice_id FROM sub_invoices WHERE id NOT IN (SELECT invoice_id FROM sub_lines WHERE invoice_id IS NOT NULL))
    SELECT parts.* REPLACE (CAST(unit_price_usd AS DOUBLE) AS unit_price_usd, CAST(line_total_usd AS DOUBLE) AS line_total_usd),
        head.* EXCLUDE (id, status, created_at) REPLACE (CAST(subtotal_usd AS DOUBLE) AS subtotal_usd, CAST(tax_usd AS DOUBLE) AS tax_usd,
            CAST(discount_usd AS DOUBLE) AS discount_usd, CAST(total_usd AS DOUBLE) AS total_usd),
        head.status AS invoice_status, head.created_at AS invoice_created_at
    FROM parts, sub_invoices head WHERE head.id = parts.invoice_id""", "sub_invoices", "sub_lines")
def cons_sub_billing(m: Market) -> DataFrame:
    return facts.sub_billing(m.subscription_invoices(), m.subscription_invoice_lines())


@query("cons_order_transactions", """
    SELECT o.id AS order_id, o.user_id, o.invoice_id, o.status, o.shipping_country, o.created_at, i.id, i.product_id, i.quantity,
        CAST(i.unit_price_usd AS DOUBLE) AS unit_price_usd, CAST(i.line_total_usd AS DOUBLE) AS line_total_usd
    FROM orders_d o LEFT JOIN order_items i ON i.order_id = o.id""", "orders_d", "order_items")
def cons_order_transactions(m: Market) -> DataFrame:
    return facts.order_transactions(m.orders(), m.order_items())


@query("cons_user_orders", """
    SELECT * EXCLUDE (created_ts) REPLACE (CAST(unit_price_usd AS DOUBLE) AS unit_price_usd, CAST(line_total_usd AS DOUBLE) AS line_total_usd)
    FROM user_orders""", "user_orders")
def cons_user_orders(m: Market) -> DataFrame:
    return facts.user_orders(m.users(), m.orders(), m.order_items(), m.marketplace_invoices())


def _events_where(condition: str) -> str:
    return f"(SELECT count(*) FROM seen WHERE seen.user_id = months.user_id AND seen.month = months.activity_month AND {condition})"


@query("cons_user_engagement_sales", f"""
    WITH seen AS (SELECT user_id, event_type, date_trunc('month', occurred_at) AS month FROM events_d WHERE user_id IN (SELECT id FROM users)),
    months AS (SELECT DISTINCT user_id, month AS activity_month FROM seen),
    per_order AS (
        SELECT o.id, o.user_id, date_trunc('month', o.created_ts) AS month,
            (SELECT sum(quantity) FROM order_items WHERE order_id = o.id) AS units, (SELECT sum(line_total_usd) FROM order_items WHERE order_id = o.id) AS paid
        FROM orders_d o WHERE o.id IN (SELECT order_id FROM order_items))
    SELECT user_id, (SELECT country_code FROM users WHERE id = months.user_id) AS user_country_code, activity_month, {_events_where("true")} AS total_events,
        {", ".join(f"{_events_where(f"event_type = '{kind}'")} AS {name}" for name, kind in (
            ("page_views", "page_view"), ("product_views", "product_view"), ("searches", "search"), ("add_to_cart_events", "add_to_cart"),
            ("checkout_starts", "checkout_start"), ("purchase_events", "purchase")))},
        (SELECT count(*) FROM per_order p WHERE p.user_id = months.user_id AND p.month = months.activity_month) AS order_count,
        CAST(coalesce((SELECT sum(units) FROM per_order p WHERE p.user_id = months.user_id AND p.month = months.activity_month), 0) AS BIGINT) AS total_quantity,
        CAST(coalesce((SELECT sum(paid) FROM per_order p WHERE p.user_id = months.user_id AND p.month = months.activity_month), 0) AS DOUBLE) AS total_revenue_usd
    FROM months""", "users", "events_d", "orders_d", "order_items")
def cons_user_engagement_sales(m: Market) -> DataFrame:
    return facts.user_engagement_sales(m.users(), m.events(), m.order_headers(), m.order_items())


# dimensions ---------------------------------------------------------------------------------


def _on_day(table: str, column: str) -> str:
    return f"EXISTS (SELECT 1 FROM {table} WHERE {column} >= day AND {column} < day + INTERVAL 1 DAY)"


@query("dim_time", f"""
    WITH calendar AS (SELECT unnest(generate_series(TIMESTAMP '1990-01-01', TIMESTAMP '2005-12-31', INTERVAL 1 DAY)) AS day)
    SELECT day AS date_key, CAST(date_part('year', day) AS INTEGER) AS year_no, CAST(date_part('month', day) AS INTEGER) AS month_no,
        left(CAST(day AS VARCHAR), 7) AS year_month, upper(left(monthname(day), 3)) AS month_name,
        CAST((date_part('month', day) + 2) // 3 AS VARCHAR) AS quarter_no
    FROM calendar
    WHERE {_on_day("users", "created_at")} OR {_on_day("subscriptions", "started_at")} OR {_on_day("sub_invoices", "created_at")}
        OR {_on_day("orders_d", "created_ts")}""", "users", "subscriptions", "sub_invoices", "orders_d")
def dim_time(m: Market) -> DataFrame:
    return dimensions.time(m.users(), m.subscriptions(), m.subscription_invoices(), m.order_headers())


@query("dim_product", """
    SELECT product_id, name AS product_name, slug, product_type, CAST(price_usd AS DOUBLE) AS price_usd, currency, is_active, seller_id,
        created_at AS product_created_at,
        CASE WHEN price_usd < 20 THEN 'budget' WHEN price_usd < 60 THEN 'mid_range' WHEN price_usd < 120 THEN 'premium'
            ELSE 'luxury' END AS price_band FROM products""", "products")
def dim_product(m: Market) -> DataFrame:
    return dimensions.product(m.products())


@query("dim_seller", """
    SELECT user_id, display_name, legal_name, payout_email, country_code, opened AS created_at, is_verified,
        CASE WHEN opened >= TIMESTAMP '2001-02-01' THEN 'new' WHEN opened >= TIMESTAMP '1999-08-01' THEN 'established'
            ELSE 'veteran' END AS seller_maturity FROM sellers""", "sellers")
def dim_seller(m: Market) -> DataFrame:
    return dimensions.seller(m.sellers(), as_of())


def affinity_type(m: Market) -> DataFrame:
    return dimensions.product_affinity(m.order_items(), m.products())


query("dim_product_affinity_type", "SELECT * FROM affinity_type", "affinity_type")(affinity_type)


def geography(m: Market) -> DataFrame:
    return dimensions.geography(m.users(), m.sellers(), m.orders_typed())


query("dim_geography", "SELECT * FROM geography", "geography")(geography)
