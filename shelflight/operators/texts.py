"""Jobs over the text view: titles, eligibility, semantic attributes, embedding texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelflight.functions import attributes as attr
from shelflight.functions import embedding_text as et
from shelflight.functions.categories import category_of_type
from shelflight.functions.text_cleaning import clean_texts
from shelflight.functions.titles import checked, clean_title, is_eligible, light_clean, rejection_reasons


def cleaned_titles(view: DataFrame, demographic: str = "exact") -> DataFrame:
    """Replace titles by their cleaned form; rows whose title vanishes are dropped."""
    return view.withColumn("title", clean_title(F.col("title"), demographic)).filter(F.col("title") != "")


def with_eligibility(view: DataFrame) -> DataFrame:
    """The eligibility flag and, for rejected titles, the reasons."""
    judged = view.withColumn("_checks", checked(F.col("title")))
    return judged.select(
        *view.columns,
        is_eligible(F.col("_checks")).alias("embedding_eligible"),
        rejection_reasons(F.col("_checks")).alias("reasons"),
    )


def eligible_only(view: DataFrame) -> DataFrame:
    return view.filter("embedding_eligible")


def semantic_attributes(view: DataFrame) -> DataFrame:
    """One record of semantic fields per eligible item."""
    staged = view.filter(F.col("parent_asin") != "").select(
        "parent_asin",
        light_clean(F.col("title")).alias("clean_title"),
        attr.semantic_details(F.col("details")).alias("attributes"),
        attr.usage_features(F.col("features")).alias("usage_features"),
        attr.description_fallback(F.col("description")).alias("_description"),
    )
    counted = staged.withColumn("semantic_detail_count", F.size("attributes")).withColumn(
        "product_type", attr.product_type(F.col("clean_title"))
    )
    dense = F.col("semantic_detail_count") >= 2
    described = F.when(dense, F.lit("")).otherwise(F.col("_description"))
    return counted.select(
        "parent_asin", "clean_title", "product_type", "attributes", "usage_features",
        described.alias("description_fallback"),
        dense.alias("details_has_semantic"),
        "semantic_detail_count",
        (
            (F.col("product_type") != "default") | dense | (F.size("usage_features") > 0)
            | (F.length(described) > 0)
        ).alias("has_valid_semantic"),
    )


def compact_texts(attributes: DataFrame) -> DataFrame:
    return attributes.select("parent_asin", et.compact_text().alias("embedding_text"))


def styled_texts(items: DataFrame, style: str) -> DataFrame:
    """Texts in one of the styles labelled, descriptive, natural, role."""
    return et.styled_texts(items, style)


def restyled_texts(texts: DataFrame, items: DataFrame, style: str) -> DataFrame:
    """Texts of eligible ids, written anew in a style from the metadata joined to them.

    ``texts`` has (item_id, embedding_text).  Every row keeps its place: an id without metadata,
    or whose new text is blank, keeps its old text; rows without an id go.
    """
    named = texts.filter(F.trim("item_id") != "")
    known = items.join(named.select("item_id"), "item_id", "left_semi")
    fresh = et.styled_texts(known, style).withColumnRenamed("embedding_text", "_fresh")
    told = F.when(F.trim("_fresh") != "", F.col("_fresh")).otherwise(F.col("embedding_text"))
    return named.join(fresh, "item_id", "left").select("item_id", told.alias("embedding_text"))


def with_text(texts: DataFrame) -> DataFrame:
    """Only texts worth encoding."""
    return texts.filter(F.trim("embedding_text") != "")


def cleaned_texts(texts: DataFrame) -> DataFrame:
    return clean_texts(texts, "embedding_text")


def typed_categories(attributes: DataFrame) -> DataFrame:
    """Category of each item by its product type."""
    return attributes.withColumn("category", category_of_type(F.col("product_type")))
