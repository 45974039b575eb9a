"""Carts as folds over an operation log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelflight.functions.common import blank_to_null, first_per_group


def fold_carts(ops: DataFrame, known_items: DataFrame) -> DataFrame:
    """Cart contents after the log (user_id, asin, op, quantity, ts, event_id).

    ``add`` sums up, on known items only; ``set`` replaces, if the item is there; ``remove``
    takes one item out, ``clear`` all of a user's.

    Only what follows the last remove or clear counts.  From there on the item appears with
    its first add; a set after that add starts the sum anew.  So the state follows from a
    few extremes and one sum, all of them aggregates with map-side combining: no task folds
    one busy cart row by row.
    """
    log = ops.withColumn("_at", F.struct("ts", "event_id"))
    removed = (
        log.filter(F.col("op") == "remove").groupBy("user_id", "asin").agg(F.max("_at").alias("_removed"))
    )
    cleared = log.filter(F.col("op") == "clear").groupBy("user_id").agg(F.max("_at").alias("_cleared"))
    puts = log.filter(F.col("op").isin("add", "set")).join(known_items.select("asin").distinct(), "asin", "left_semi")
    live = (
        puts.join(removed, ["user_id", "asin"], "left")
        .join(cleared, "user_id", "left")
        .filter(
            (F.col("_removed").isNull() | (F.col("_at") > F.col("_removed")))
            & (F.col("_cleared").isNull() | (F.col("_at") > F.col("_cleared")))
        )
        .select("user_id", "asin", "op", "quantity", "_at")
    )
    extremes = live.groupBy("user_id", "asin").agg(
        F.min(F.when(F.col("op") == "add", F.col("_at"))).alias("_first_add"),
        F.max(F.when(F.col("op") == "set", F.struct("_at", "quantity"))).alias("_last_set"),
    ).filter(F.col("_first_add").isNotNull())
    reset = F.col("_last_set._at") > F.col("_first_add")
    counted = live.filter(F.col("op") == "add").join(extremes, ["user_id", "asin"])
    added = F.when(F.coalesce(reset, F.lit(False)) & (F.col("_at") < F.col("_last_set._at")), F.lit(0)).otherwise(
        F.col("quantity")
    )
    base = F.max(F.when(reset, F.col("_last_set.quantity")))
    return counted.groupBy("user_id", "asin").agg(
        (F.sum(added) + F.coalesce(base, F.lit(0))).alias("quantity")
    )


def active_cart(carts: DataFrame, cart_items: DataFrame, items: DataFrame, products: DataFrame) -> DataFrame:
    """Rows of every user's newest active cart with title, image and the cart's total."""
    newest = first_per_group(
        carts.filter(F.col("status") == "active"), ["user_id"], [F.desc("created_at"), F.desc("id")]
    ).select(F.col("id").alias("cart_id"), "user_id", "created_at")
    rows = cart_items.join(newest, "cart_id")
    totals = rows.groupBy("cart_id").agg(F.sum("quantity").alias("total_items"))
    facts = items.select("asin", "parent_asin", "primary_image").join(
        products.select("parent_asin", "title", F.col("primary_image").alias("product_image")), "parent_asin"
    )
    return (
        rows.join(totals, "cart_id").join(facts, "asin")
        .select(
            "user_id", "cart_id", "asin", "title",
            F.coalesce(blank_to_null(F.col("primary_image")), F.col("product_image")).alias("image"),
            "quantity", "total_items",
        )
        .orderBy("user_id", "asin")
    )
