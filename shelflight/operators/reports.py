"""Dashboards: distributions, profiles, cleaning and quality reports.

Every report is an aggregate with map-side combining, usually in two levels: first per
key, then over the keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelflight.functions.common import banded, exact_medians, folded_median, share
from shelflight.functions.vectors import norm
from shelflight.operators.reviews import has_required_keys, rating_in_range

ACTIVITY_EDGES = (0, 5, 10, 20, 50, 100, 200, 500)
TOKEN_EDGES = (0, 50, 100, 200, 300, 500, 1000)


def _counted(df: DataFrame, by: Column, name: str) -> DataFrame:
    return df.groupBy(by.alias(name)).agg(F.count("*").alias("count"))


def rating_distribution(interactions: DataFrame, whole_stars: bool = True) -> DataFrame:
    """Counts and percent per rating, as whole stars or as given."""
    rating = F.col("rating").cast("int") if whole_stars else F.col("rating")
    total = interactions.agg(F.count("*")).scalar()
    return (
        _counted(interactions, rating, "rating")
        .withColumn("percent", share(F.col("count"), total))
        .orderBy("rating")
    )


def category_distribution(items: DataFrame, column: str, n: int | None = None, keep_null: bool = False) -> DataFrame:
    kept = items if keep_null else items.filter(F.col(column).isNotNull())
    counted = _counted(kept, F.col(column), "category").orderBy(F.desc("count"), F.asc_nulls_first("category"))
    return counted if n is None else counted.limit(n)


def top_items(interactions: DataFrame, n: int) -> DataFrame:
    return _counted(interactions, F.col("item_id"), "item_id").orderBy(F.desc("count"), "item_id").limit(n)


def interaction_stats(interactions: DataFrame) -> DataFrame:
    """Counts, ratings and the sizes of the leave-last-out split.

    Rows are folded per (user, instant), then per user, so the last instant of a user, whose rows
    are the test side, needs neither a window nor a join.
    """
    instants = interactions.groupBy("user_id", "ts").agg(
        F.count("*").alias("_n"), F.sum("rating").alias("_sum"), F.count("rating").alias("_rated"),
        F.min("rating").alias("_min"), F.max("rating").alias("_max"),
    )
    users = instants.groupBy("user_id").agg(
        F.sum("_n").alias("_n"), F.max_by("_n", "ts").alias("_last"), F.sum("_sum").alias("_sum"),
        F.sum("_rated").alias("_rated"), F.min("_min").alias("_min"), F.max("_max").alias("_max"),
    )
    base = users.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total_interactions"), F.count("user_id").alias("unique_users"),
        (F.sum("_sum") / F.sum("_rated")).alias("avg_rating"), F.min("_min").alias("min_rating"),
        F.max("_max").alias("max_rating"), F.coalesce(F.sum("_last"), F.lit(0)).alias("test_count"),
    ).withColumn("train_count", F.col("total_interactions") - F.col("test_count"))
    items = interactions.select("item_id").distinct().agg(F.count("item_id")).scalar()
    sides = base.withColumn("unique_items", items)
    both = F.col("train_count") + F.col("test_count")
    return sides.withColumn("train_ratio", share(F.col("train_count"), both, 1.0)).withColumn(
        "test_ratio", share(F.col("test_count"), both, 1.0)
    )


def table_stats(items: DataFrame, key: str) -> DataFrame:
    """Rows, columns, schema text, distinct keys and categories of an item table."""
    category = next((c for c in ("main_category", "category", "product_type") if c in items.columns), None)
    distinct = F.countDistinct(category) if category else F.lit(None).cast("bigint")
    return items.agg(
        F.count("*").alias("total_items"),
        F.lit(len(items.columns)).alias("columns"),
        F.lit(", ".join(f"{n} {t}" for n, t in items.dtypes)).alias("schema"),
        distinct.alias("unique_categories"),
        F.countDistinct(key).alias("unique_items"),
    )


def user_activity_histogram(interactions: DataFrame) -> DataFrame:
    """Users per activity band; bands are named by their edges and empty ones show zero."""
    per_user = interactions.groupBy("user_id").agg(F.count("*").alias("n"))
    found = _counted(per_user, banded(F.col("n"), ACTIVITY_EDGES), "range")
    spark = interactions.sparkSession
    names = [f"[{a},{b})" for a, b in zip(ACTIVITY_EDGES, ACTIVITY_EDGES[1:], strict=False)] + ["[500,inf)"]
    bands = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "band int, range string")
    return bands.join(found, "range", "left").select(
        "band", "range", F.coalesce("count", F.lit(0)).alias("count")
    )


def group_count_profile(interactions: DataFrame, key: str) -> DataFrame:
    """Mean, min, max and median number of rows per key, and the number of keys."""
    per_key = interactions.groupBy(key).agg(F.count("*").alias("n"))
    return per_key.agg(
        F.count("*").alias("groups"), F.avg("n").alias("mean"), F.min("n").alias("min"), F.max("n").alias("max")
    ).withColumn("median", folded_median(per_key, "n"))


def distinct_per_group_profile(interactions: DataFrame, key: str, value: str) -> DataFrame:
    """The same profile over distinct values per key."""
    return group_count_profile(interactions.select(key, value).distinct(), key)


def _flagged_pairs(reviews: DataFrame, nulls: Sequence[str]) -> DataFrame:
    """Per (user, product): additive counters every cleaning figure follows from."""
    keyed, ranged = has_required_keys(), F.coalesce(rating_in_range(), F.lit(False))
    return reviews.groupBy("amazon_user_id", "asin").agg(
        F.count("*").alias("n"),
        F.count_if(keyed).alias("keyed"),
        F.count_if(keyed & ranged).alias("sane"),
        F.count_if(~ranged).alias("bad_rating"),
        F.count_if(F.trim(F.coalesce("review_text", F.lit(""))) == "").alias("blank_text"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in nulls],
    )


_CHECKED = ("amazon_user_id", "asin", "rating", "review_title", "review_text")


def cleaning_report(reviews: DataFrame) -> DataFrame:
    """Rows before and after cleaning, drops per task, missing values, in one two-level aggregate."""
    totals = _flagged_pairs(reviews, _CHECKED).agg(
        F.sum("n").alias("before"),
        F.sum("keyed").alias("keyed"),
        F.sum("sane").alias("sane"),
        F.count_if(F.col("sane") > 0).alias("after"),
        *[F.sum(f"null_{c}").alias(f"missing_{c}") for c in _CHECKED],
    )
    before = F.col("before")
    drops = {
        "task1_dropped": before - F.col("keyed"),
        "task2_dropped": F.col("keyed") - F.col("sane"),
        "task3_dropped": F.col("sane") - F.col("after"),
    }
    return totals.select(
        "before", "after",
        (before - F.col("after")).alias("dropped"),
        share(F.col("after"), before).alias("retention_pct"),
        *[d.alias(n) for n, d in drops.items()],
        *[share(d, before).alias(n.replace("dropped", "pct")) for n, d in drops.items()],
        *[f"missing_{c}" for c in _CHECKED],
    )


def cleaning_steps(reviews: DataFrame) -> DataFrame:
    """Rows left after each cleaning task, as (step, task, count, percent)."""
    totals = _flagged_pairs(reviews, ()).agg(
        F.sum("n").alias("Initial"),
        F.sum("keyed").alias("After Task 1"),
        F.sum("sane").alias("After Task 2"),
        F.count_if(F.col("sane") > 0).alias("After Task 3"),
    )
    names = ["Initial", "After Task 1", "After Task 2", "After Task 3"]
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("step"), F.lit(n).alias("task"), F.col(f"`{n}`").cast("bigint").alias("count"),
                     share(F.col(f"`{n}`"), F.col("`Initial`")).alias("percent"))
            for i, n in enumerate(names)
        ]
    )
    return totals.select(F.inline(rows))


def core_retention(interactions: DataFrame, core: DataFrame) -> DataFrame:
    """Rows, users and items of the full table and the core with the shares kept."""
    def sizes(df: DataFrame, prefix: str) -> DataFrame:
        return df.agg(
            F.count("*").alias(f"{prefix}_rows"), F.countDistinct("user_id").alias(f"{prefix}_users"),
            F.countDistinct("item_id").alias(f"{prefix}_items"),
        )

    inner = sizes(core, "core").select(F.struct("*")).scalar()
    out = sizes(interactions, "all").withColumn("c", inner).select("all_rows", "all_users", "all_items", "c.*")
    for what in ("rows", "users", "items"):
        out = out.withColumn(f"{what}_retention", share(F.col(f"core_{what}"), F.col(f"all_{what}")))
    return out


def token_counts(texts: DataFrame, column: str) -> DataFrame:
    """Tokens as the pieces between single spaces, so double blanks count as empty tokens."""
    return texts.select(F.size(F.split(F.col(column), " ", -1)).alias("tokens"))


def token_stats(texts: DataFrame, column: str) -> DataFrame:
    counts = token_counts(texts, column)
    return counts.agg(
        F.count("*").alias("total_items"), F.avg("tokens").alias("avg_tokens"), F.min("tokens").alias("min_tokens"),
        F.max("tokens").alias("max_tokens"), F.stddev_samp("tokens").alias("std_tokens"),
    ).withColumn("median_tokens", folded_median(counts, "tokens"))


def token_distribution(texts: DataFrame, column: str) -> DataFrame:
    """Texts per token band with percent; empty bands are absent."""
    counts = token_counts(texts, column)
    total = texts.agg(F.count("*")).scalar()
    return _counted(counts, banded(F.col("tokens"), TOKEN_EDGES), "range").withColumn(
        "percent", share(F.col("count"), total)
    )


def review_quality(reviews: DataFrame) -> DataFrame:
    """Nulls, duplicate surplus, invalid ratings, blank texts, and two scores.

    ``score`` subtracts every problem; ``score_reference`` only the duplicate percentage.
    """
    columns = list(reviews.columns)
    totals = _flagged_pairs(reviews, columns).agg(
        F.sum("n").alias("total_rows"),
        F.sum(F.col("n") - 1).alias("duplicates"),
        F.sum("bad_rating").alias("invalid_ratings"),
        F.sum("blank_text").alias("empty_review_text"),
        *[F.sum(f"null_{c}").alias(f"null_{c}") for c in columns],
    )
    total = F.col("total_rows")
    key_nulls = F.col("null_amazon_user_id") + F.col("null_asin") + F.col("null_rating")
    worst = share(F.col("duplicates"), total)
    every = worst + share(F.col("invalid_ratings"), total) + share(key_nulls, total) / 3
    return (
        totals.withColumn("duplicate_pct", worst)
        .withColumn("invalid_pct", share(F.col("invalid_ratings"), total))
        .withColumn("empty_text_pct", share(F.col("empty_review_text"), total))
        .withColumn("score_reference", F.greatest(F.lit(0.0), 100 - worst))
        .withColumn("score", F.greatest(F.lit(0.0), 100 - every))
    )


def metadata_quality(meta: DataFrame) -> DataFrame:
    """The same for products: missing titles and categories instead of ratings and texts."""
    columns = list(meta.columns)
    category = F.col("main_category")
    per_key = meta.groupBy("parent_asin").agg(
        F.count("*").alias("n"),
        F.count_if(F.trim(F.coalesce("title", F.lit(""))) == "").alias("no_title"),
        F.count_if(category.isNull() | (category == "All Beauty") | (F.trim(category) == "")).alias("no_category"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns],
    )
    totals = per_key.agg(
        F.sum("n").alias("total_rows"), F.sum(F.col("n") - 1).alias("duplicates"),
        F.sum("no_title").alias("missing_title"), F.sum("no_category").alias("missing_category"),
        *[F.sum(f"null_{c}").alias(f"null_{c}") for c in columns],
    )
    total = F.col("total_rows")
    worst = share(F.col("duplicates"), total)
    every = worst + share(F.col("missing_title"), total) + share(F.col("missing_category"), total)
    return (
        totals.withColumn("duplicate_pct", worst)
        .withColumn("missing_category_pct", share(F.col("missing_category"), total))
        .withColumn("score_reference", F.greatest(F.lit(0.0), 100 - worst))
        .withColumn("score", F.greatest(F.lit(0.0), 100 - every))
    )


def null_profile(df: DataFrame) -> DataFrame:
    """(column, nulls, percent) for every column, from one aggregate."""
    wide = df.agg(F.count("*").alias("_total"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return wide.unpivot(["_total"], list(df.columns), "column", "nulls").select(
        "column", "nulls", share(F.col("nulls"), F.col("_total")).alias("percent")
    )


def rating_before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """Counts per whole star 1..5 before and after cleaning, zero where there are none."""
    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("rating").agg(F.count("*").alias(name))

    stars = before.sparkSession.range(1, 6).select(F.col("id").cast("double").alias("rating"))
    return stars.join(counted(before, "before"), "rating", "left").join(
        counted(after, "after"), "rating", "left"
    ).select(
        F.col("rating").cast("int").alias("rating"), F.coalesce("before", F.lit(0)).alias("before"),
        F.coalesce("after", F.lit(0)).alias("after"),
    )


def semantic_coverage(attributes: DataFrame) -> DataFrame:
    """How many items have attributes, features, a description, real details, any semantics, no type."""
    return attributes.agg(
        F.count("*").alias("items"),
        F.count_if(F.size("attributes") > 0).alias("with_attributes"),
        F.count_if(F.size("usage_features") > 0).alias("with_features"),
        F.count_if(F.length("description_fallback") > 0).alias("with_description"),
        F.count_if("details_has_semantic").alias("with_semantic_details"),
        F.count_if("has_valid_semantic").alias("valid"),
        F.count_if(F.col("product_type") == "default").alias("default_type"),
    )


def value_changes(df: DataFrame, old: str, new: str) -> DataFrame:
    """Distribution of the new value with the number of rows whose value changed."""
    return df.groupBy(F.col(new).alias("category")).agg(
        F.count("*").alias("count"), F.count_if(~F.col(old).eqNullSafe(F.col(new))).alias("changed")
    )


def column_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, min, max, mean, median, std) per numeric column; std of the population."""
    stats = df.agg(
        *[
            F.struct(
                F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"), F.avg(c).alias("mean"),
                F.stddev_pop(c).alias("std"), F.count(c).alias("filled"),
            ).alias(c)
            for c in columns
        ]
    )
    medians = exact_medians(df, columns)
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"), F.col(f"{c}.min").alias("min"), F.col(f"{c}.max").alias("max"),
                F.col(f"{c}.mean").alias("mean"), F.lit(medians[c]).cast("double").alias("median"),
                F.col(f"{c}.std").alias("std"), F.col(f"{c}.filled").alias("filled"),
            )
            for c in columns
        ]
    )
    return stats.select(F.inline(rows))


def label_counts(dataset: DataFrame) -> DataFrame:
    total = dataset.agg(F.count("*")).scalar()
    return _counted(dataset, F.col("label"), "label").withColumn("percent", share(F.col("count"), total))


def length_profile(texts: DataFrame, column: str) -> DataFrame:
    """Character lengths: mean, min, max, median, empty texts, share of 200 to 400 characters."""
    lengths = texts.select(F.length(F.coalesce(column, F.lit(""))).alias("chars"))
    return lengths.agg(
        F.count("*").alias("texts"), F.avg("chars").alias("mean"), F.min("chars").alias("min"),
        F.max("chars").alias("max"), F.count_if(F.col("chars") == 0).alias("empty"),
        share(F.count_if(F.col("chars").between(200, 400)), F.count("*")).alias("pct_200_400"),
    ).withColumn("median", folded_median(lengths, "chars"))


def norm_profile(vectors: DataFrame) -> DataFrame:
    n = norm(F.col("embedding"))
    return vectors.agg(
        F.count("*").alias("vectors"), F.avg(n).alias("mean_norm"), F.min(n).alias("min_norm"),
        F.max(n).alias("max_norm"),
    )


def trending(logs: DataFrame, as_of: Column, hours: int = 24, limit: int = 50) -> DataFrame:
    """Most viewed items of the last hours: views, then users; score = views + users / 2."""
    recent = logs.filter((F.col("event_type") == "view") & (F.col("ts") >= as_of - F.expr(f"INTERVAL {hours} HOURS")))
    counted = recent.groupBy("asin").agg(
        F.count("*").alias("view_count"), F.countDistinct("user_id").alias("unique_users")
    )
    return (
        counted.orderBy(F.desc("view_count"), F.desc("unique_users"), "asin").limit(limit)
        .withColumn("score", F.col("view_count") + 0.5 * F.col("unique_users"))
    )
