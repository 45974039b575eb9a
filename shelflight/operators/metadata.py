"""Product metadata: normalise, clean, keep the best record per product."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelflight.functions.categories import resolve_category
from shelflight.functions.common import blank_to_null, first_per_group
from shelflight.schemas import METADATA_CLEAN, METADATA_NORMALIZED, TEXT_VIEW, available, require_columns


def primary_image(images: Column) -> Column:
    """The first image: its large form, else its high-resolution form, else none."""
    first = F.get(images, F.lit(0))
    return F.coalesce(blank_to_null(first["large"]), blank_to_null(first["hi_res"]))


def normalize_metadata(raw: DataFrame) -> DataFrame:
    """Rename, keep the source row as JSON, pick the primary image."""
    whole_row = F.to_json(F.struct(*[F.col(c) for c in raw.columns]), {"ignoreNullFields": "false"})
    return raw.select(
        "parent_asin",
        "title",
        "store",
        "main_category",
        F.col("average_rating").alias("avg_rating"),
        "rating_number",
        "images",
        "details",
        "price",
        whole_row.alias("raw_metadata"),
        primary_image(F.col("images")).alias("primary_image"),
    )


def fill_missing(meta: DataFrame) -> DataFrame:
    """Rows with key and title; unknown store named so; rating count never negative."""
    return (
        meta.dropna(subset=["parent_asin", "title"])
        .fillna({"store": "Unknown", "rating_number": 0})
        .withColumn("rating_number", F.greatest(F.col("rating_number"), F.lit(0)))
    )


def completeness() -> Column:
    """2 for a primary image plus 1 for details."""
    return F.col("primary_image").isNotNull().cast("int") * 2 + F.col("details").isNotNull().cast("int")


def keep_best(meta: DataFrame) -> DataFrame:
    """One row per product: the most complete one, the source text deciding between equals."""
    return first_per_group(meta, ["parent_asin"], [completeness().desc(), F.col("raw_metadata").desc()])


def typed(meta: DataFrame) -> DataFrame:
    return (
        meta.withColumn("avg_rating", F.col("avg_rating").cast("double"))
        .withColumn("rating_number", F.col("rating_number").cast("bigint"))
        .select(*METADATA_CLEAN)
    )


def clean_metadata(meta: DataFrame) -> DataFrame:
    """The whole metadata cleaning: keys, sanity, best record, types, category."""
    require_columns(meta, *METADATA_NORMALIZED)
    best = keep_best(fill_missing(meta))
    return typed(
        best.withColumn("main_category", resolve_category(F.col("main_category"), F.col("raw_metadata")))
    )


def text_view(meta: DataFrame) -> DataFrame:
    """Those of the seven text columns the source has, for rows with a key and a visible title."""
    return meta.select(*available(meta, TEXT_VIEW)).filter(
        F.col("parent_asin").isNotNull() & (F.trim("title") != "")
    )


def unique_text_view(view: DataFrame) -> DataFrame:
    """One text row per product; the smallest JSON form decides between copies."""
    return first_per_group(view, ["parent_asin"], [F.to_json(F.struct(*view.columns)).asc()])
