"""Table contracts between the phases."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Schemas of files, as DDL.
REVIEWS_RAW = (
    "user_id string, asin string, parent_asin string, rating double, title string, text string, "
    "helpful_vote bigint, verified_purchase boolean, timestamp bigint"
)
METADATA_RAW = (
    "parent_asin string, title string, store string, main_category string, average_rating double, "
    "rating_number bigint, images array<struct<large: string, hi_res: string>>, "
    "details map<string, string>, price string, categories array<string>, "
    "features array<string>, description array<string>"
)
REVIEWS_NORMALIZED = (
    "amazon_user_id", "asin", "parent_asin", "rating", "review_title", "review_text",
    "helpful_vote", "verified", "ts",
)
METADATA_NORMALIZED = (
    "parent_asin", "title", "store", "main_category", "avg_rating", "rating_number",
    "images", "details", "price", "raw_metadata", "primary_image",
)
METADATA_CLEAN = (
    "parent_asin", "title", "store", "main_category", "avg_rating", "rating_number",
    "primary_image", "raw_metadata",
)
INTERACTIONS = ("user_id", "item_id", "rating", "ts")
ITEMS_FOR_RS = (
    "item_id", "title", "store", "main_category", "avg_rating", "rating_number",
    "primary_image", "raw_metadata",
)
TEXT_VIEW = ("parent_asin", "title", "store", "main_category", "details", "features", "description")
RANKING_DATASET = (
    "user_id", "item_id", "mf_score", "content_score", "popularity_score", "rating_score", "label",
)
# The order in which the ranker reads its features.
FEATURES = ("mf_score", "popularity_score", "rating_score", "content_score")

# The event vocabulary.
EVENT_TYPES = ("view", "click", "add_to_cart", "purchase", "rate")

EVENTS = ("event_id bigint, user_id bigint, asin string, event_type string, ts timestamp, metadata string")


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """Fail early, by name, when a phase gets a table it cannot use."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def available(df: DataFrame, names) -> list[str]:
    """Those of ``names`` the frame really has, in the given order."""
    return [n for n in names if n in df.columns]
