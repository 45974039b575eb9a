"""Catalogue: search, lookup, category maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelflight.functions.common import blank_to_null, first_per_group, share


def item_details(items: DataFrame, products: DataFrame) -> DataFrame:
    """Variants with their product's data; the variant's own image where it has one."""
    side = products.select(
        "parent_asin", "title", "store", "main_category", "avg_rating", "rating_number",
        F.col("primary_image").alias("product_image"),
    )
    return items.join(side, "parent_asin").withColumn(
        "image", F.coalesce(blank_to_null(F.col("primary_image")), F.col("product_image"))
    )


def _matching(details: DataFrame, text: str | None, category: str | None) -> DataFrame:
    if text:
        # A plain substring: the wanted text is a literal, so % and _ mean themselves.
        details = details.filter(F.contains(F.lower("title"), F.lit(text.lower())))
    if category:
        details = details.filter((F.col("main_category") == category) | (F.col("category") == category))
    return details


def search_total(items: DataFrame, products: DataFrame, text: str | None = None, category: str | None = None) -> DataFrame:
    return _matching(item_details(items, products), text, category).agg(F.countDistinct("asin").alias("total"))


def search_items(
    items: DataFrame, products: DataFrame, text: str | None = None, category: str | None = None,
    page: int = 1, page_size: int = 20,
) -> DataFrame:
    """One page of distinct variants in asin order, with the total and whether more follow.

    The best rated row stands for a variant.  Page rows come from a bounded top-n, the
    total from its own aggregate.
    """
    found = _matching(item_details(items, products), text, category)
    one = first_per_group(found, ["asin"], [F.col("avg_rating").desc_nulls_last(), F.col("title").asc_nulls_last()])
    total = found.agg(F.countDistinct("asin")).scalar()
    return (
        one.orderBy("asin").offset((page - 1) * page_size).limit(page_size)
        .withColumn("total", total)
        .withColumn("has_more", F.lit(page * page_size) < F.col("total"))
    )


def items_in_order(requested: DataFrame, items: DataFrame, products: DataFrame) -> DataFrame:
    """Details of requested variants in request order; unknown ones are absent.

    ``requested`` has (pos, asin).
    """
    return requested.join(item_details(items, products), "asin").orderBy("pos")


def _with_product_category(items: DataFrame, products: DataFrame) -> DataFrame:
    return items.select("asin", "parent_asin", "category").join(
        products.select("parent_asin", "main_category"), "parent_asin"
    )


def keys_with_category(items: DataFrame, products: DataFrame) -> DataFrame:
    """Every asin and parent that has a category of its own or through its product."""
    found = _with_product_category(items, products).filter(
        (F.coalesce("category", F.lit("")) != "") | (F.coalesce("main_category", F.lit("")) != "")
    )
    return found.select(F.explode(F.array("asin", "parent_asin")).alias("key")).dropna().distinct()


def items_without_category(items: DataFrame, products: DataFrame) -> DataFrame:
    return _with_product_category(items, products).filter(
        (F.coalesce("category", F.lit("")) == "") & (F.coalesce("main_category", F.lit("")) == "")
    )


def droppable_items(items: DataFrame, products: DataFrame, core_keys: DataFrame) -> DataFrame:
    """Uncategorised items whose asin and parent are both outside the core.

    ``core_keys`` has one column ``key`` with every asin and parent of the core.
    """
    bare = items_without_category(items, products)
    keys = core_keys.select("key").distinct()
    return bare.join(keys, F.col("asin") == F.col("key"), "left_anti").join(
        keys, F.coalesce("parent_asin", "asin") == F.col("key"), "left_anti"
    )


def drop_counts(dropped: DataFrame, tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Dry run: rows each table would lose, as (table, rows).

    ``tables`` maps a name to the frame and the column holding the asin; products are counted
    from ``orphan_products``, as they go only when no variant is left.
    """
    out = None
    asins = dropped.select("asin").distinct()
    for name, (df, column) in tables.items():
        hit = df.join(asins, df[column] == asins["asin"], "left_semi").agg(F.count("*").alias("rows"))
        row = hit.select(F.lit(name).alias("table"), "rows")
        out = row if out is None else out.unionByName(row)
    return out


def orphan_products(items: DataFrame, products: DataFrame, dropped: DataFrame) -> DataFrame:
    """Products that lose their last variant with the dropped items."""
    left = items.join(dropped.select("asin"), "asin", "left_anti").select("parent_asin").distinct()
    lost = dropped.select("parent_asin").distinct().join(left, "parent_asin", "left_anti")
    return products.join(lost, "parent_asin", "left_semi")


def without_items(df: DataFrame, dropped: DataFrame, column: str = "asin") -> DataFrame:
    """The cascade: the table without rows of dropped items."""
    gone = dropped.select(F.col("asin").alias("_gone")).distinct()
    return df.join(gone, F.col(column) == F.col("_gone"), "left_anti")


def retained(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows whose id is in the with-category set."""
    return df.join(keys.select(F.col("key").alias(column)).distinct(), column, "left_semi")


def retention_report(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Kept and removed rows; ids are counted first, so the join sees each id once."""
    per_id = df.groupBy(column).agg(F.count("*").alias("n"))
    marked = per_id.join(
        keys.select(F.col("key").alias(column), F.lit(1).alias("hit")).distinct(), column, "left"
    )
    return marked.agg(
        F.sum("n").alias("total"),
        F.coalesce(F.sum(F.when(F.col("hit").isNotNull(), F.col("n"))), F.lit(0)).alias("kept"),
        F.coalesce(F.sum(F.when(F.col("hit").isNull(), F.col("n"))), F.lit(0)).alias("removed"),
    ).withColumn("kept_pct", share(F.col("kept"), F.col("total")))


def dominant_category(items: DataFrame, products: DataFrame) -> DataFrame:
    """Per product the most frequent category of its variants and whether it replaces the old one."""
    counted = (
        items.filter(F.coalesce("category", F.lit("")) != "")
        .groupBy("parent_asin", "category").agg(F.count("*").alias("n"))
    )
    best = first_per_group(counted, ["parent_asin"], [F.desc("n"), F.asc("category")])
    joined = best.join(
        products.select("parent_asin", F.col("main_category").alias("old_category")), "parent_asin"
    )
    old, new = F.col("old_category"), F.col("category")
    return joined.select(
        "parent_asin", "old_category", F.col("category").alias("new_category"), F.col("n").alias("item_count"),
        (old.isNull() | (old != new) | (old == "All Beauty")).alias("update"),
    )


def category_update_counts(dominant: DataFrame) -> DataFrame:
    return dominant.agg(
        F.count_if("update").alias("updated"), F.count_if(~F.col("update")).alias("unchanged")
    )
