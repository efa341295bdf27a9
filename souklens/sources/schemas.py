"""Fixed row layouts of the stores."""

from __future__ import annotations

ORDER = "id string, user_id string, invoice_id string, status string, shipping_country string, created_at string"
ORDER_ITEM = ("id string, order_id string, product_id string, quantity int, unit_price_usd decimal(10,2), "
              "line_total_usd decimal(10,2)")
MARKETPLACE_INVOICE = "id string, user_id string, status string, total_usd decimal(10,2), created_at string"
EVENT = "id string, user_id string, event_type string, product_id string, metadata string, occurred_at string"
#: Ids and times are objects in one export of the catalogue and plain text in another, so they are
#: read as text, which keeps an object as JSON.
PRODUCT = ("id string, seller_id string, name string, slug string, product_type string, description string, "
           "price_usd decimal(10,2), currency string, is_active string, created_at string, updated_at string")
BINARY = "`$binary` struct<base64: string>"
DATE = "`$date` bigint"

SELLER_PROFILE = ("user_id string, display_name string, legal_name string, tax_id string, payout_email string, "
                  "country_code string, is_verified string, bio string, created_at string, updated_at string")
MARKETPLACE_INVOICE_CSV = (
    "id string, user_id string, invoice_type string, status string, subtotal_usd decimal(10,2), tax_usd decimal(10,2), "
    "discount_usd decimal(10,2), total_usd decimal(10,2), subscription_id string, billing_period_start timestamp, "
    "billing_period_end timestamp, paid_at timestamp, due_at timestamp, created_at timestamp")
MARKETPLACE_INVOICE_LINE_CSV = (
    "id string, invoice_id string, product_id string, description string, quantity smallint, unit_price_usd decimal(8,2), "
    "line_total_usd decimal(10,2), created_at timestamp")
ORDER_CSV = (
    "id string, user_id string, invoice_id string, status string, shipping_name string, shipping_address string, "
    "shipping_city string, shipping_country string, shipping_postal string, created_at timestamp, updated_at timestamp")
ORDER_ITEM_CSV = (
    "id string, order_id string, product_id string, quantity smallint, unit_price_usd decimal(8,2), "
    "line_total_usd decimal(10,2), fulfilment_status string, created_at timestamp")
EVENT_CSV = ("id string, user_id string, event_type string, product_id string, session_id string, metadata string, "
             "occurred_at timestamp")
PRODUCT_CSV = ("id string, seller_id string, name string, slug string, product_type string, description string, "
               "price_usd string, currency string, is_active string, attributes string, created_at string, updated_at string")
