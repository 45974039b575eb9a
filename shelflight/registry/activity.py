"""Events, context, history, carts."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelflight.functions.jsontext import as_valid_json, brand_of
from shelflight.operators import activity, carts
from shelflight.registry import query
from shelflight.registry.ctes import with_blocks
from shelflight.sources import testviews
from shelflight.sources.tables import read_table


def _as_of(logs):
    return logs.agg(F.max("ts")).scalar()


def _shop(spark, sf):
    return testviews.items(spark, sf), testviews.products(spark, sf)


@query("C7_items_with_products", with_blocks("""
  SELECT asin, i.parent_asin, title, main_category, category FROM items i JOIN products p USING (parent_asin)
""", "items", "products"))
def items_with_products(spark, sf):
    from shelflight.operators.catalog import item_details

    return item_details(*_shop(spark, sf)).select("asin", "parent_asin", "title", "main_category", "category")


@query("C8_logs_with_products", with_blocks("""
  SELECT event_id, l.asin, event_type, ts, main_category AS category
  FROM logs l LEFT JOIN items i USING (asin) LEFT JOIN products p ON i.parent_asin = p.parent_asin
""", "logs", "items", "products"))
def logs_with_products(spark, sf):
    return activity.log_details(testviews.interaction_logs(spark, sf), *_shop(spark, sf)).select(
        "event_id", "asin", "event_type", "ts", "category"
    )


@query("K19_brands", with_blocks("SELECT parent_asin, brand FROM products", "products"))
def brands(spark, sf):
    return testviews.products(spark, sf).select("parent_asin", brand_of(F.col("raw_metadata")).alias("brand"))


@query("K20_json_repair", """
  SELECT event_id, CASE WHEN json_valid(x) THEN x ELSE CAST(to_json(x) AS VARCHAR) END AS repaired
  FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN substr(props, 1, 5) ELSE props END AS x FROM events)""")
def json_repair(spark, sf):
    broken = F.when(F.col("event_type") == "error", F.substring("props", 1, 5)).otherwise(F.col("props"))
    return read_table(spark, sf, "events").select("event_id", as_valid_json(broken).alias("repaired"))


@query("K20_text_as_json", """
  SELECT doc_id, json_extract_string(CAST(to_json(text) AS VARCHAR), '$') AS decoded FROM documents""")
def text_as_json(spark, sf):
    return read_table(spark, sf, "documents").select(
        "doc_id", F.get_json_object(F.concat(F.lit('{"t":'), as_valid_json(F.col("text")), F.lit("}")), "$.t")
        .alias("decoded"),
    )


@query("K21_event_types", """
  SELECT event_type, event_type IN ('view', 'click', 'add_to_cart', 'purchase', 'rate') AS valid, count(*) AS events
  FROM events GROUP BY 1, 2""")
def event_types(spark, sf):
    logs = testviews.interaction_logs(spark, sf)
    return logs.groupBy("event_type", activity.is_valid_type().alias("valid")).agg(F.count("*").alias("events"))


@query("L1_valid_events", with_blocks("""
  SELECT event_id, user_id, l.asin, event_type, ts, main_category AS category, brand
  FROM logs l LEFT JOIN items i USING (asin) LEFT JOIN products p ON i.parent_asin = p.parent_asin
  WHERE event_type IN ('view', 'click', 'add_to_cart', 'purchase', 'rate')""", "logs", "items", "products"))
def valid_events(spark, sf):
    valid = activity.valid_events(testviews.interaction_logs(spark, sf))
    return activity.with_product_facts(valid, *_shop(spark, sf)).select(
        "event_id", "user_id", "asin", "event_type", "ts", "category", "brand"
    )


@query("L1_rejected_events", """
  SELECT event_id, event_type FROM events WHERE event_type NOT IN ('view', 'click', 'add_to_cart', 'purchase', 'rate')
""")
def rejected_events(spark, sf):
    return activity.rejected_events(testviews.interaction_logs(spark, sf)).select("event_id", "event_type")


@query("L2_enriched_metadata", with_blocks("""
  SELECT event_id, CAST(json_extract(metadata, '$.k') AS BIGINT) AS k, main_category AS category, brand
  FROM logs l LEFT JOIN items i USING (asin) LEFT JOIN products p ON i.parent_asin = p.parent_asin
""", "logs", "items", "products"))
def enriched_metadata(spark, sf):
    events = activity.enriched(testviews.interaction_logs(spark, sf), *_shop(spark, sf))
    return events.select(
        "event_id", F.get_json_object("metadata", "$.k").cast("bigint").alias("k"),
        F.get_json_object("metadata", "$.category").alias("category"),
        F.get_json_object("metadata", "$.brand").alias("brand"),
    )


# A longer life than the default, so that the sparse test events form lists at all.
_TTL = 6 * 3600


@query("L3_recent_items", with_blocks(f"""
  SELECT user_id, pos, asin FROM (
    SELECT *, max(CASE WHEN date_diff('microsecond', ts, later) >= {_TTL * 1000000} THEN 1 ELSE 0 END)
                OVER (PARTITION BY user_id ORDER BY pos) AS expired
    FROM (SELECT user_id, asin, ts, row_number() OVER w AS pos,
                 coalesce(lag(ts) OVER w, (SELECT max(ts) FROM events)) AS later
          FROM logs WINDOW w AS (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)))
  WHERE expired = 0 AND pos <= 20""", "logs"))
def recent_items(spark, sf):
    logs = testviews.interaction_logs(spark, sf)
    return activity.recent_items(logs, _as_of(logs), _TTL).select("user_id", "pos", "asin")


@query("L3_recent_categories", with_blocks(f"""
  SELECT user_id, category, count(*) AS count FROM (
    SELECT *, max(CASE WHEN date_diff('microsecond', ts, later) >= {_TTL * 1000000} THEN 1 ELSE 0 END)
                OVER (PARTITION BY user_id ORDER BY pos) AS expired
    FROM (SELECT user_id, main_category AS category, ts, row_number() OVER w AS pos,
                 coalesce(lag(ts) OVER w, (SELECT max(ts) FROM events)) AS later
          FROM logs JOIN items USING (asin) JOIN products USING (parent_asin) WHERE main_category <> ''
          WINDOW w AS (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)))
  WHERE expired = 0 GROUP BY 1, 2""", "logs", "items", "products"))
def recent_categories(spark, sf):
    logs = testviews.interaction_logs(spark, sf)
    facts = activity.with_product_facts(logs, *_shop(spark, sf))
    return activity.recent_categories(facts, _as_of(logs), _TTL)


@query("L4_recent_rows", with_blocks("""
  SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS pos, asin, event_type, ts
  FROM logs WHERE event_type IN ('view', 'purchase')
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 10""", "logs"))
def recent_rows(spark, sf):
    return activity.recent_rows(testviews.interaction_logs(spark, sf), 10, ["view", "purchase"]).select(
        "user_id", "pos", "asin", "event_type", "ts"
    )


@query("L5_reference_items", with_blocks("""
  SELECT user_id, asin, source, row_number() OVER (PARTITION BY user_id ORDER BY source, p) AS pos FROM (
    SELECT * FROM (
      SELECT user_id, asin, 0 AS source, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, asin) AS p
      FROM (SELECT DISTINCT user_id, asin, created_at FROM carts JOIN cart_items ON cart_id = id WHERE status = 'active')
      UNION ALL
      SELECT user_id, asin, 1, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)
      FROM logs WHERE event_type = 'purchase'
      UNION ALL
      SELECT user_id, asin, 2, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)
      FROM logs WHERE event_type = 'view')
    WHERE p <= 10
    QUALIFY row_number() OVER (PARTITION BY user_id, asin ORDER BY source, p) = 1)""", "carts", "cart_items", "logs"))
def reference_items(spark, sf):
    open_carts = testviews.carts(spark, sf).filter(F.col("status") == "active")
    cart = open_carts.join(testviews.cart_items(spark, sf), F.col("cart_id") == F.col("id")).select(
        "user_id", "asin", "created_at"
    )
    return activity.reference_items(testviews.interaction_logs(spark, sf), cart, views=True)


@query("L7_last_active", with_blocks(f"""
  SELECT user_id, epoch_us(max(ts)) // 1000000 AS last_active FROM logs GROUP BY 1
  HAVING date_diff('microsecond', max(ts), (SELECT max(ts) FROM events)) < {_TTL * 1000000}""", "logs"))
def last_active(spark, sf):
    logs = testviews.interaction_logs(spark, sf)
    return activity.last_active(logs, _as_of(logs), _TTL)


_NEWEST_100 = """
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS pos FROM logs
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 100"""


@query("E17_item_history", with_blocks(f"""
  SELECT user_id, list_sort(list(DISTINCT asin)) AS items, count(DISTINCT asin) AS all_items,
         count(*) AS interaction_count FROM ({_NEWEST_100})
  GROUP BY 1""", "logs"))
def item_history(spark, sf):
    logs = testviews.interaction_logs(spark, sf)
    return activity.item_history(activity.recent_items(logs, _as_of(logs), _TTL), logs, limit=100)


@query("E17_category_history", with_blocks(f"""
  SELECT user_id, category, sum(n) AS count FROM (
    SELECT user_id, main_category AS category, count(*) AS n FROM ({_NEWEST_100}) JOIN items USING (asin)
    JOIN products USING (parent_asin) GROUP BY 1, 2
    UNION ALL
    SELECT user_id, category, count(*) FROM (
      SELECT *, max(CASE WHEN date_diff('microsecond', ts, later) >= {_TTL * 1000000} THEN 1 ELSE 0 END)
                  OVER (PARTITION BY user_id ORDER BY pos) AS expired
      FROM (SELECT user_id, main_category AS category, ts, row_number() OVER w AS pos,
                   coalesce(lag(ts) OVER w, (SELECT max(ts) FROM events)) AS later
            FROM logs JOIN items USING (asin) JOIN products USING (parent_asin)
            WINDOW w AS (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)))
    WHERE expired = 0 GROUP BY 1, 2)
  GROUP BY 1, 2""", "logs", "items", "products"))
def category_history(spark, sf):
    logs = testviews.interaction_logs(spark, sf)
    items, products = _shop(spark, sf)
    context = activity.recent_categories(
        activity.with_product_facts(logs, items, products), _as_of(logs), _TTL
    )
    return activity.category_history(context, logs, items, products, limit=100)


@query("M1_cart_fold", with_blocks("""
  SELECT user_id, asin, final.q AS quantity FROM (
    SELECT user_id, asin, list_reduce(
      list_prepend({'op': 'start', 'q': CAST(-1 AS BIGINT)}, list({'op': op, 'q': quantity} ORDER BY ts, event_id)),
      lambda acc, e: {'op': e.op, 'q': CASE e.op
        WHEN 'add' THEN greatest(acc.q, 0) + e.q
        WHEN 'set' THEN CASE WHEN acc.q >= 0 THEN e.q ELSE -1 END
        ELSE -1 END}) AS final
    FROM (SELECT user_id, asin, op, quantity, ts, event_id FROM cart_events WHERE op <> 'clear'
          UNION ALL
          SELECT c.user_id, k.asin, 'clear', 0, c.ts, c.event_id FROM cart_events c
          JOIN (SELECT DISTINCT user_id, asin FROM cart_events WHERE op <> 'clear') k USING (user_id)
          WHERE c.op = 'clear')
    GROUP BY 1, 2)
  WHERE final.q >= 0""", "cart_events"))
def cart_fold(spark, sf):
    return carts.fold_carts(testviews.cart_events(spark, sf), testviews.items(spark, sf))


@query("M2_active_cart", with_blocks("""
  SELECT user_id, cart_id, asin, title, coalesce(nullif(i.primary_image, ''), p.primary_image) AS image, quantity,
         total_items
  FROM (SELECT id AS cart_id, user_id FROM carts WHERE status = 'active'
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) = 1) c
  JOIN (SELECT *, sum(quantity) OVER (PARTITION BY cart_id) AS total_items FROM cart_items) USING (cart_id)
  JOIN items i USING (asin) JOIN products p USING (parent_asin)""", "carts", "cart_items", "items", "products"))
def active_cart(spark, sf):
    return carts.active_cart(
        testviews.carts(spark, sf), testviews.cart_items(spark, sf), *_shop(spark, sf)
    )
