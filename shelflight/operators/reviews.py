"""Reviews: normalise, clean, keep the latest per (user, product)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelflight.functions.common import first_per_group
from shelflight.schemas import REVIEWS_NORMALIZED, require_columns

_REQUIRED = ("amazon_user_id", "asin", "rating")


def normalize_reviews(raw: DataFrame) -> DataFrame:
    """Rename, turn epoch milliseconds into an instant, drop the images."""
    return raw.select(
        F.col("user_id").alias("amazon_user_id"),
        "asin",
        "parent_asin",
        "rating",
        F.col("title").alias("review_title"),
        F.col("text").alias("review_text"),
        "helpful_vote",
        F.col("verified_purchase").alias("verified"),
        F.timestamp_millis("timestamp").cast("timestamp_ntz").alias("ts"),
    )


def has_required_keys() -> Column:
    cond = F.lit(True)
    for name in _REQUIRED:
        cond = cond & F.col(name).isNotNull()
    return cond


def rating_in_range() -> Column:
    return F.col("rating").between(1, 5)


def fill_missing(reviews: DataFrame) -> DataFrame:
    """Rows with all keys; blanks for missing text, 0 votes, not verified."""
    return reviews.dropna(subset=list(_REQUIRED)).fillna(
        {"review_title": "", "review_text": "", "helpful_vote": 0, "verified": False}
    )


def sane(reviews: DataFrame) -> DataFrame:
    """Ratings from 1 to 5; negative votes count as none."""
    return reviews.filter(rating_in_range()).withColumn(
        "helpful_vote", F.greatest(F.col("helpful_vote"), F.lit(0))
    )


def latest_review_order() -> list[Column]:
    """Newest first; the remaining columns make the choice among equal instants repeatable."""
    return [
        F.col("ts").desc_nulls_last(), F.col("helpful_vote").desc(), F.col("rating").desc(),
        F.col("review_title").desc(), F.col("review_text").desc(), F.col("verified").desc(),
        F.col("parent_asin").desc_nulls_last(),
    ]


def keep_latest(reviews: DataFrame) -> DataFrame:
    return first_per_group(reviews, ["amazon_user_id", "asin"], latest_review_order())


def typed(reviews: DataFrame) -> DataFrame:
    return (
        reviews.withColumn("rating", F.col("rating").cast("double"))
        .withColumn("helpful_vote", F.col("helpful_vote").cast("bigint"))
        .withColumn("verified", F.col("verified").cast("boolean"))
        .select(*REVIEWS_NORMALIZED)
    )


def clean_reviews(reviews: DataFrame) -> DataFrame:
    """The whole review cleaning: keys, sanity, latest per (user, product), types."""
    require_columns(reviews, *REVIEWS_NORMALIZED)
    return typed(keep_latest(sane(fill_missing(reviews))))
