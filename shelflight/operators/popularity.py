"""Item popularity: counts, normalised scores, fallbacks, leaderboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelflight.schemas import available


def popularity_stats(interactions: DataFrame) -> DataFrame:
    """Interaction count and mean rating per item."""
    return interactions.groupBy("item_id").agg(
        F.count("*").alias("interaction_count"), F.avg("rating").alias("mean_rating")
    )


def rating_score(mean_rating: Column) -> Column:
    """A rating of 1..5 on a 0..1 scale."""
    return (mean_rating - 1.0) / 4.0


def normalize_popularity(stats: DataFrame) -> DataFrame:
    """log1p of the count scaled to [0, 1]; the mean rating scaled from 1..5.

    The range is a scalar subquery over the item table; equal counts everywhere give 0.0.
    """
    bounds = stats.agg(
        F.struct(
            F.min(F.log1p("interaction_count")).alias("lo"), F.max(F.log1p("interaction_count")).alias("hi")
        )
    ).scalar()
    scaled = stats.withColumn("_b", bounds).withColumn("_log", F.log1p("interaction_count"))
    width = F.col("_b.hi") - F.col("_b.lo")
    return scaled.select(
        "item_id",
        F.when(width > 0, (F.col("_log") - F.col("_b.lo")) / width).otherwise(F.lit(0.0)).alias("popularity_score"),
        rating_score(F.col("mean_rating")).alias("rating_score"),
    )


def fallback_scores(stats: DataFrame, mode: str = "recall") -> DataFrame:
    """Scores for a table nobody normalised.

    ``recall``: 0.7 of the count share plus 0.3 of the rating score, 0.5 standing in for an
    unknown rating.  ``dataset``: the count share and the rating score side by side.
    Missing columns give the constant 0.5.
    """
    have = set(available(stats, ("interaction_count", "mean_rating")))
    half = F.lit(0.5)
    if "interaction_count" in have:
        top = stats.agg(F.max("interaction_count")).scalar()
        popular = F.coalesce(F.when(top > 0, F.col("interaction_count") / top), F.lit(0.0))
    else:
        popular = half
    rated = F.coalesce(rating_score(F.col("mean_rating")), half) if "mean_rating" in have else half
    if mode == "recall":
        combined = popular * 0.7 + rated * 0.3 if "interaction_count" in have else half
        return stats.select("item_id", combined.alias("popularity_score"), rated.alias("rating_score"))
    if mode == "dataset":
        return stats.select("item_id", popular.alias("popularity_score"), rated.alias("rating_score"))
    raise ValueError(f"unknown fallback mode: {mode}")


def leaderboard(stats: DataFrame, n: int) -> DataFrame:
    return stats.orderBy(F.desc("interaction_count"), "item_id").limit(n)
