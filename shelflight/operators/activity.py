"""Interaction events: validation, enrichment, recent context, history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelflight.functions.common import first_per_group, top_per_group
from shelflight.functions.jsontext import brand_of, enriched_metadata
from shelflight.schemas import EVENT_TYPES

TTL_SECONDS = 900
RECENT_ITEMS = 20


def is_valid_type() -> Column:
    return F.coalesce(F.col("event_type").isin(*EVENT_TYPES), F.lit(False))


def valid_events(events: DataFrame) -> DataFrame:
    return events.filter(is_valid_type())


def rejected_events(events: DataFrame) -> DataFrame:
    return events.filter(~is_valid_type())


def product_facts(items: DataFrame, products: DataFrame) -> DataFrame:
    """(asin, category, brand) of every item whose product is known."""
    return items.select("asin", "parent_asin").join(
        products.select("parent_asin", F.col("main_category").alias("category"),
                        brand_of(F.col("raw_metadata")).alias("brand")),
        "parent_asin",
    ).select("asin", "category", "brand")


def with_product_facts(events: DataFrame, items: DataFrame, products: DataFrame) -> DataFrame:
    """Category and brand of the event's item; both null for unknown items."""
    return events.join(product_facts(items, products), "asin", "left")


def enriched(events: DataFrame, items: DataFrame, products: DataFrame) -> DataFrame:
    """Events whose metadata carries category and brand."""
    return enriched_by(events, product_facts(items, products))


def enriched_by(events: DataFrame, facts: DataFrame) -> DataFrame:
    """``enriched`` by (asin, category, brand)."""
    return events.join(facts, "asin", "left").withColumn(
        "metadata", enriched_metadata(F.col("metadata"), F.col("category"), F.col("brand"))
    )


def _newest() -> list[Column]:
    return [F.col("ts").desc(), F.col("event_id").desc()]


def recent_rows(
    logs: DataFrame, limit: int = 100, event_types: Sequence[str] | None = None
) -> DataFrame:
    """The newest rows of every user, optionally of some event types, with their position."""
    wanted = logs if event_types is None else logs.filter(F.col("event_type").isin(*event_types))
    return top_per_group(wanted, ["user_id"], _newest(), limit, "pos")


def _seconds(ts: Column) -> Column:
    """Seconds since the epoch with their fraction, exact to the microsecond."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1_000_000)


def recent_items(
    events: DataFrame, as_of: Column, ttl: int = TTL_SECONDS, limit: int = RECENT_ITEMS
) -> DataFrame:
    """What a list per user, capped and renewed for ``ttl`` seconds by every event, holds at ``as_of``.

    Only the newest ``limit`` events of a user can be in the list, so only those are
    shipped; the list ends at the first pause of ``ttl`` seconds or more.
    """
    newest = top_per_group(events.filter(F.col("ts") <= as_of), ["user_id"], _newest(), limit, "pos")
    w = Window.partitionBy("user_id").orderBy("pos")
    later = F.coalesce(F.lag("ts").over(w), as_of)
    expired = F.max((_seconds(later) - _seconds(F.col("ts")) >= ttl).cast("int")).over(w)
    return newest.withColumn("_expired", expired).filter(F.col("_expired") == 0).drop("_expired")


def recent_categories(events: DataFrame, as_of: Column, ttl: int = TTL_SECONDS) -> DataFrame:
    """Category counts per user since the last pause of ``ttl`` seconds between categorised events.

    Events are first folded into slots of ``ttl`` seconds.  Two events of one slot are
    always closer than ``ttl``, so pauses exist between slots only, and the window runs
    over slots, however many events a busy user has.
    """
    seen = events.filter((F.col("ts") <= as_of) & F.col("category").isNotNull() & (F.col("category") != ""))
    slotted = seen.withColumn("_slot", F.floor(_seconds(F.col("ts")) / ttl))
    per_category = slotted.groupBy("user_id", "_slot", "category").agg(
        F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )
    slots = per_category.groupBy("user_id", "_slot").agg(
        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"),
    )
    w = Window.partitionBy("user_id").orderBy(F.desc("_slot"))
    later = F.coalesce(F.lag("first_ts").over(w), as_of)
    expired = F.max((_seconds(later) - _seconds(F.col("last_ts")) >= ttl).cast("int")).over(w)
    live = slots.withColumn("_expired", expired).filter(F.col("_expired") == 0).select("user_id", "_slot")
    return per_category.join(live, ["user_id", "_slot"]).groupBy("user_id", "category").agg(
        F.sum("n").alias("count")
    )


def last_active(events: DataFrame, as_of: Column, ttl: int = TTL_SECONDS) -> DataFrame:
    """Whole epoch seconds of each user's last event, while not older than ``ttl``."""
    last = events.filter(F.col("ts") <= as_of).groupBy("user_id").agg(F.max("ts").alias("last_ts"))
    return last.filter(_seconds(as_of) - _seconds(F.col("last_ts")) < ttl).select(
        "user_id", F.floor(_seconds(F.col("last_ts"))).alias("last_active")
    )


def reference_items(
    logs: DataFrame, cart: DataFrame | None = None, purchases: bool = True, views: bool = False,
    limit_per_source: int = 10,
) -> DataFrame:
    """Items a user showed interest in: cart, then purchases, then views; first seen wins.

    ``cart`` has (user_id, asin, created_at).  At most ``limit_per_source`` rows per source.
    """
    parts = []
    if cart is not None:
        rows = cart.select("user_id", "asin", "created_at").distinct()
        top = top_per_group(rows, ["user_id"], [F.desc("created_at"), F.asc("asin")], limit_per_source, "pos")
        parts.append(top.select("user_id", "asin", F.lit(0).alias("source"), "pos"))
    for rank, wanted, kind in ((1, purchases, "purchase"), (2, views, "view")):
        if wanted:
            top = recent_rows(logs, limit_per_source, [kind])
            parts.append(top.select("user_id", "asin", F.lit(rank).alias("source"), "pos"))
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    first = first_per_group(merged, ["user_id", "asin"], [F.asc("source"), F.asc("pos")])
    w = Window.partitionBy("user_id").orderBy("source", "pos")
    return first.withColumn("pos", F.row_number().over(w)).select("user_id", "asin", "source", "pos")


def category_history(context: DataFrame, logs: DataFrame, items: DataFrame, products: DataFrame,
                     limit: int = 100) -> DataFrame:
    """Category counts over the live context and the newest log rows together.

    ``context`` has (user_id, category, count).
    """
    rows = recent_rows(logs, limit)
    with_category = log_details(rows, items, products).filter(F.coalesce("category", F.lit("")) != "")
    logged = with_category.groupBy("user_id", "category").agg(F.count("*").alias("count"))
    return context.select("user_id", "category", "count").unionByName(logged).groupBy("user_id", "category").agg(
        F.sum("count").alias("count")
    )


def item_history(recent: DataFrame, logs: DataFrame, limit: int = 100) -> DataFrame:
    """Distinct items over the live list and the newest log rows, sorted, with their number and that of log rows.

    Both sides hold a bounded number of rows per user, so the list does too.
    """
    rows = recent_rows(logs, limit).select("user_id", "asin", F.lit(1).alias("logged"))
    both = recent.select("user_id", "asin", F.lit(0).alias("logged")).unionByName(rows)
    return both.groupBy("user_id").agg(
        F.array_sort(F.collect_set("asin")).alias("items"), F.countDistinct("asin").alias("all_items"),
        F.sum("logged").alias("interaction_count"),
    )


def log_details(logs: DataFrame, items: DataFrame, products: DataFrame) -> DataFrame:
    """Log rows with the category of the item's product where it is known."""
    return logs.join(items.select("asin", "parent_asin"), "asin", "left").join(
        products.select("parent_asin", F.col("main_category").alias("category")), "parent_asin", "left"
    )
