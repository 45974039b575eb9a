"""Sinks with insert-ignore and upsert meaning on Parquet folders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelflight.functions.common import first_per_group
from shelflight.functions.jsontext import as_valid_json
from shelflight.session import scratch_path


def new_rows(incoming: DataFrame, existing: DataFrame | None, key: str, order: Sequence[Column]) -> DataFrame:
    """Insert-ignore: one row per key, and only keys the target does not hold yet."""
    rows = first_per_group(incoming.filter(F.col(key).isNotNull()), [key], order)
    return rows if existing is None else rows.join(existing.select(key), key, "left_anti")


def upserted(existing: DataFrame, incoming: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """Incoming rows replace existing ones with the same key; within a batch the first by ``order`` wins."""
    rows = first_per_group(incoming, [key], order)
    return existing.join(rows.select(key), key, "left_anti").unionByName(rows)


def products_for_load(items: DataFrame) -> DataFrame:
    """Catalogue rows in the shape of the products table, with JSON that always parses."""
    return items.select(
        F.col("item_id").alias("parent_asin"),
        "title", "store", "main_category",
        F.col("avg_rating").cast("double").alias("avg_rating"),
        F.col("rating_number").cast("int").alias("rating_number"),
        "primary_image",
        as_valid_json(F.col("raw_metadata")).alias("raw_metadata"),
    )


def items_from_reviews(reviews: DataFrame) -> DataFrame:
    """One row per asin with the smallest of its parents, both present."""
    return (
        reviews.select("asin", "parent_asin").dropna()
        .groupBy("asin").agg(F.min("parent_asin").alias("parent_asin"))
    )


def reviews_for_load(reviews: DataFrame) -> DataFrame:
    """Review rows in the shape of the reviews table; the internal user id is filled in later."""
    return reviews.select(
        F.lit(None).cast("bigint").alias("user_id"),
        "amazon_user_id", "asin", "parent_asin",
        F.col("rating").cast("double").alias("rating"),
        "review_title", "review_text", "helpful_vote", "verified",
        F.expr("try_to_timestamp(CAST(ts AS STRING))").cast("timestamp_ntz").alias("review_ts"),
    )


def point_id(item_id: Column) -> Column:
    """Numeric id of a vector: first 16 hex digits of the md5 of the item id, modulo 2^63."""
    head = F.conv(F.substring(F.md5(item_id.cast("string")), 1, 16), 16, 10).cast("decimal(20,0)")
    return (head % F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("bigint")


def vectors_for_load(vectors: DataFrame, key: str = "item_id") -> DataFrame:
    return vectors.select(point_id(F.col(key)).alias("id"), F.col(key).alias("item_id"), "embedding")


def write_factors(factors: DataFrame, path: str) -> DataFrame:
    """Store a factor table and return what was stored."""
    factors.write.mode("overwrite").parquet(path)
    return factors.sparkSession.read.parquet(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """A metrics frame of a few rows as one JSON file."""
    metrics.coalesce(1).write.mode("overwrite").json(path)


def append_new(incoming: DataFrame, target: str, key: str, order: Sequence[Column]) -> DataFrame:
    """Append the keys ``target`` lacks and return the table.

    The new rows are staged first, so the anti-join never reads the folder it writes to.
    """
    spark = incoming.sparkSession
    staged = scratch_path(spark, "append")
    new_rows(incoming, spark.read.parquet(target), key, order).write.parquet(staged)
    spark.read.parquet(staged).write.mode("append").parquet(target)
    return spark.read.parquet(target)


def upsert_table(incoming: DataFrame, path: str, key: str, arrival: Sequence[Column], buckets: int = 64) -> DataFrame:
    """Store rows by key in a table of hash buckets and return the table; the last arrival of a key wins.

    ``arrival`` orders rows of one batch from last to first.  Only buckets that receive rows are
    read and written anew, and they are staged first, so a job that fails leaves the table as it was.
    """
    spark = incoming.sparkSession
    placed = first_per_group(incoming.filter(F.col(key).isNotNull()), [key], arrival).withColumn(
        "bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    )
    staged = scratch_path(spark, "upsert")
    try:
        stored = spark.read.parquet(path)
    except AnalysisException as err:
        if "PATH_NOT_FOUND" not in str(err):
            raise
        placed.write.partitionBy("bucket").parquet(path)
        return spark.read.parquet(path)
    touched = placed.select("bucket").distinct()
    kept = stored.select(*placed.columns).join(touched, "bucket", "left_semi").join(placed.select(key), key, "left_anti")
    kept.unionByName(placed).write.parquet(staged)
    (spark.read.parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("bucket").parquet(path))
    return spark.read.parquet(path)
