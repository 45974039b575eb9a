"""User-item interactions: canonical ids, joins with metadata, time split."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelflight.functions.common import first_per_group, share
from shelflight.schemas import INTERACTIONS, ITEMS_FOR_RS, require_columns


def with_item_id(reviews: DataFrame) -> DataFrame:
    """The canonical item is the parent product, else the product itself."""
    return reviews.withColumn("item_id_train", F.coalesce("parent_asin", "asin"))


def item_id_counts(reviews: DataFrame) -> DataFrame:
    return reviews.agg(
        F.count("*").alias("total"),
        F.count("parent_asin").alias("from_parent"),
        F.count_if(F.col("parent_asin").isNull() & F.col("asin").isNotNull()).alias("from_asin"),
    )


def join_metadata(reviews: DataFrame, meta: DataFrame) -> DataFrame:
    """Left join on the canonical id with a marker of a real match."""
    side = meta.select(
        F.col("parent_asin").alias("item_id_train"), "title", "store", "main_category", "avg_rating",
        "rating_number", "primary_image", "raw_metadata", F.lit(True).alias("has_metadata"),
    )
    return reviews.join(side, "item_id_train", "left").withColumn(
        "has_metadata", F.coalesce("has_metadata", F.lit(False))
    )


def match_counts(reviews: DataFrame, meta: DataFrame) -> DataFrame:
    """Matched and unmatched review counts.

    Reviews are counted per item first, so the join sees one row per item and no hot key.
    """
    per_item = with_item_id(reviews).groupBy(F.col("item_id_train").alias("parent_asin")).agg(
        F.count("*").alias("n")
    )
    known = meta.select("parent_asin", F.lit(1).alias("hit"))
    return per_item.join(known, "parent_asin", "left").agg(
        F.sum("n").alias("total"),
        F.coalesce(F.sum(F.when(F.col("hit").isNotNull(), F.col("n"))), F.lit(0)).alias("with_metadata"),
        F.coalesce(F.sum(F.when(F.col("hit").isNull(), F.col("n"))), F.lit(0)).alias("without_metadata"),
    )


def build_interactions(reviews: DataFrame) -> DataFrame:
    return with_item_id(reviews).select(
        F.col("amazon_user_id").alias("user_id"), F.col("item_id_train").alias("item_id"), "rating", "ts"
    )


def items_for_rs(meta: DataFrame) -> DataFrame:
    """The item table of the recommender, one row per item."""
    renamed = meta.withColumnRenamed("parent_asin", "item_id").select(*ITEMS_FOR_RS)
    return first_per_group(
        renamed, ["item_id"],
        [F.col("title").asc_nulls_last(), F.to_json(F.struct(*ITEMS_FOR_RS)).asc()],
    )


def sort_by_user_time(interactions: DataFrame) -> DataFrame:
    """(user, time) order over the whole table by range partitions, not by one sorted group.

    The range key includes time and item, so a user with very many rows still spreads out.
    """
    return interactions.orderBy("user_id", "ts", "item_id")


def recency_rank(interactions: DataFrame) -> DataFrame:
    """Dense rank of each interaction's instant within its user.

    Ranks are computed over the distinct (user, instant) pairs, day by day: the number of a
    user's instants before a day comes from a window over that user's days, the rank inside
    a day from a window over (user, day).  No window ever holds a user's whole history.
    """
    instants = interactions.select("user_id", "ts").distinct().withColumn("day", F.to_date("ts"))
    per_day = instants.groupBy("user_id", "day").agg(F.count("*").alias("n"))
    before = Window.partitionBy("user_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_day.select("user_id", "day", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("user_id", "day").orderBy("ts"))
    ranked = (
        instants.withColumn("_inside", inside)
        .join(offsets, ["user_id", "day"])
        .select("user_id", "ts", (F.col("offset") + F.col("_inside")).alias("rank"))
    )
    return interactions.join(ranked, ["user_id", "ts"])


def last_instants(interactions: DataFrame) -> DataFrame:
    return interactions.groupBy("user_id").agg(F.max("ts").alias("last_ts"))


def marked_last(interactions: DataFrame) -> DataFrame:
    """The interactions with ``is_test``: whether the row lies at its user's last instant.

    The last instant comes from an aggregate with map-side combining and a join AQE may split,
    so no task ever holds one user whole.
    """
    require_columns(interactions, *INTERACTIONS)
    marked = interactions.join(last_instants(interactions), "user_id")
    return marked.select(*INTERACTIONS, (F.col("ts") == F.col("last_ts")).alias("is_test"))


def parts_of(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(train, test) of marked rows; keep the marked rows first where both sides are read."""
    return tuple(marked.filter(side).select(*INTERACTIONS) for side in (~F.col("is_test"), F.col("is_test")))


def split_last_out(interactions: DataFrame, mode: str = "ties") -> tuple[DataFrame, DataFrame]:
    """Leave-last-out: (train, test).

    ``ties``: every row at the user's last instant is test.  ``one``: exactly one row per
    user is, the largest item id deciding.
    """
    require_columns(interactions, *INTERACTIONS)
    if mode == "ties":
        return parts_of(marked_last(interactions))
    if mode == "one":
        order = [F.col("ts").desc(), F.col("item_id").desc(), F.col("rating").desc()]
        test = first_per_group(interactions.select(*INTERACTIONS), ["user_id"], order)
        train = interactions.select(*INTERACTIONS).exceptAll(test)
        return train, test
    raise ValueError(f"unknown split mode: {mode}")


def split_counts(interactions: DataFrame) -> DataFrame:
    """Rows and shares of the two sides of the split, in one pass over per-instant counts."""
    per_instant = interactions.groupBy("user_id", "ts").agg(F.count("*").alias("n"))
    per_user = per_instant.groupBy("user_id").agg(
        F.sum("n").alias("rows"), F.max(F.struct("ts", "n")).alias("last")
    )
    totals = per_user.agg(F.sum("rows").alias("total"), F.sum(F.col("last.n")).alias("test"))
    return totals.select(
        F.col("total"),
        (F.col("total") - F.col("test")).alias("train_count"),
        F.col("test").alias("test_count"),
        share(F.col("total") - F.col("test"), F.col("total")).alias("train_pct"),
        share(F.col("test"), F.col("total")).alias("test_pct"),
    )


def union_rows(train: DataFrame, test: DataFrame) -> DataFrame:
    return train.unionByName(test)
