"""Offline evaluation: rating errors, ranking quality, content quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelflight.functions.common import share, top_per_group, wide_median
from shelflight.session import keep

CUTS = (5, 10, 20)
POSITIVE_FROM = 4.0
INFINITE = float("inf")


def rating_errors(predicted: DataFrame) -> DataFrame:
    """RMSE and MAE over pairs whose both sides are known; infinite when there are none."""
    err = F.col("prediction") - F.col("rating")
    return predicted.filter("known").agg(
        F.count("*").alias("pairs"),
        F.coalesce(F.sqrt(F.avg(err * err)), F.lit(INFINITE)).alias("rmse"),
        F.coalesce(F.avg(F.abs(err)), F.lit(INFINITE)).alias("mae"),
    )


def positives(test: DataFrame, known_users: DataFrame, known_items: DataFrame, threshold: float = POSITIVE_FROM) -> DataFrame:
    """Distinct liked (user, item) pairs of users and items the model knows."""
    liked = test.filter(F.col("rating") >= threshold).select("user_id", "item_id").distinct()
    return liked.join(known_users.select(F.col("id").alias("user_id")), "user_id", "left_semi").join(
        known_items.select(F.col("id").alias("item_id")), "item_id", "left_semi"
    )


def precision_recall(recommended: DataFrame, liked: DataFrame, cuts: Sequence[int] = CUTS) -> DataFrame:
    """Macro precision and recall at each cut over users with liked items.

    ``recommended`` has (user_id, item_id, position) down to the largest cut.  Precision
    divides by the cut, recall by the user's liked items.
    """
    totals = liked.groupBy("user_id").agg(F.count("*").alias("_liked"))
    hits = recommended.join(liked, ["user_id", "item_id"]).groupBy("user_id").agg(
        *[F.count_if(F.col("position") <= k).alias(f"_hit{k}") for k in cuts]
    )
    users = totals.join(hits, "user_id", "left")
    stats = users.agg(
        F.count("*").alias("users"),
        *[F.avg(F.coalesce(f"_hit{k}", F.lit(0)) / k).alias(f"precision_{k}") for k in cuts],
        *[F.avg(F.coalesce(f"_hit{k}", F.lit(0)) / F.col("_liked")).alias(f"recall_{k}") for k in cuts],
    )
    rows = F.array(
        *[
            F.struct(F.lit(k).alias("k"), F.col("users"), F.col(f"precision_{k}").alias("precision"),
                     F.col(f"recall_{k}").alias("recall"))
            for k in cuts
        ]
    )
    return stats.select(F.inline(rows))


def _liked(test: DataFrame, threshold: float) -> DataFrame:
    return test.filter(F.col("rating") >= threshold).select("user_id", "item_id").distinct()


def quality_seeds(test: DataFrame, threshold: float = POSITIVE_FROM, seeds_per_user: int = 5) -> DataFrame:
    """(user_id, item_id) that ``content_quality`` looks up: a few liked items per user, smallest ids first."""
    return top_per_group(_liked(test, threshold), ["user_id"], [F.asc("item_id")], seeds_per_user)


def content_quality(
    test: DataFrame, neighbours: DataFrame, categories: DataFrame, k: int = 10, threshold: float = POSITIVE_FROM,
    seeds_per_user: int = 5,
) -> DataFrame:
    """How well lists of similar items meet what users liked.

    Up to five liked items per user, smallest ids first, fetch k similar items each; a
    user's recommendations are their union.  ``neighbours`` has the top lists of the items,
    ``categories`` (item_id, category).
    """
    liked = _liked(test, threshold)
    seeds = quality_seeds(test, threshold, seeds_per_user)
    lists = neighbours.filter(F.col("position") <= k).select(
        F.col("query_id").alias("seed"), F.col("item_id").alias("rec"), "score"
    )
    shown = seeds.select("user_id", F.col("item_id").alias("seed")).join(lists, "seed")
    own = categories.select(F.col("item_id").alias("rec"), F.col("category").alias("_own"))
    of_seed = categories.select(F.col("item_id").alias("seed"), F.col("category").alias("_seed"))
    shown = shown.join(own, "rec", "left").join(of_seed, "seed", "left").withColumn(
        "category", F.coalesce("_own", "_seed", F.lit("Unknown"))
    )
    shown = keep(shown, "shown")  # read three times; the search behind it is the work
    variety = shown.groupBy("user_id").agg(
        (F.countDistinct("category") / F.count("*")).alias("diversity"),
        F.sum("score").alias("_score"), F.count("*").alias("_rows"),
    )
    hit = liked.select("user_id", F.col("item_id").alias("rec"), F.lit(1).alias("_hit"))
    sizes = liked.groupBy("user_id").agg(F.count("*").alias("_liked"))
    per_user = (
        shown.select("user_id", "rec").distinct().join(hit, ["user_id", "rec"], "left").groupBy("user_id")
        .agg(F.count("*").alias("_recs"), F.count("_hit").alias("_hits"))
        .join(sizes, "user_id").join(variety, "user_id")
    )
    out = per_user.agg(
        F.avg(F.col("_hits") / F.col("_recs")).alias("precision"),
        F.avg(F.col("_hits") / F.col("_liked")).alias("recall"),
        F.avg((F.col("_hits") > 0).cast("double")).alias("hit_rate"),
        (F.sum("_score") / F.sum("_rows")).alias("avg_similarity"),
        F.avg("diversity").alias("category_diversity"),
        F.sum("_recs").alias("total_recommendations"),
    )
    return (
        out.withColumn("valid_users", liked.agg(F.countDistinct("user_id")).scalar())
        .withColumn("unique_recommended_items", shown.agg(F.countDistinct("rec")).scalar())
        .withColumn("coverage", share(F.col("unique_recommended_items"), test.agg(F.countDistinct("item_id")).scalar(), 1.0))
    )


def similarity_quality(neighbours: DataFrame) -> DataFrame:
    """Mean, extremes and median of the scores in the lists, and the mean list length."""
    neighbours = keep(neighbours.select("query_id", "score"), "similarities")
    return neighbours.agg(
        F.avg("score").alias("avg_similarity"), F.min("score").alias("min_similarity"),
        F.max("score").alias("max_similarity"),
        (F.count("*") / F.countDistinct("query_id")).alias("avg_recommendations_per_item"),
    ).withColumn("median_similarity", wide_median(neighbours, "score"))
