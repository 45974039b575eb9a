"""Substring search over titles: posting lists of short character runs, checked exactly."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelflight.functions.common import top_per_group

GRAM = 3
BUCKETS = 64


@dataclass(frozen=True)
class TitleIndex:
    """Where an index lies: ``postings`` by bucket, ``counts`` per gram, ``titles`` in lower case."""

    spark: SparkSession
    path: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")


def _runs(text: Column, length: int) -> Column:
    """All runs of ``length`` characters, an empty array where the text is shorter."""
    starts = F.when(F.length(text) >= length, F.sequence(F.lit(1), F.length(text) - (length - 1)))
    return F.coalesce(F.transform(starts, lambda at: F.substring(text, at, F.lit(length))), F.array().cast("array<string>"))


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int").alias("bucket")


def _repeats(rows: DataFrame, key: str) -> bool:
    """Whether a key stands in several rows; only then are pairs made distinct, which takes memory for each."""
    n, distinct = rows.agg(F.count("*"), F.count_distinct(key)).first()
    return n != distinct


def build_title_index(products: DataFrame, path: str) -> TitleIndex:
    """Write the index of (parent_asin, title).

    Runs of one and two characters are indexed beside those of three, so short wanted texts are
    looked up like long ones.  Postings are dealt by (bucket, id): a gram that most titles hold
    is spread over many tasks and files.
    """
    index = TitleIndex(products.sparkSession, path)
    titles = products.filter(F.col("title").isNotNull()).select("parent_asin", F.lower("title").alias("title"))
    titles.write.parquet(f"{path}/titles")
    grams = F.array_distinct(F.concat(*[_runs(F.col("title"), n) for n in range(1, GRAM + 1)]))
    rows = index.table("titles").select("parent_asin", F.explode(grams).alias("gram"))
    if _repeats(index.table("titles"), "parent_asin"):
        rows = rows.distinct()
    rows.withColumn("bucket", _bucket(F.col("gram"))).repartition("bucket", F.pmod(F.xxhash64("parent_asin"), F.lit(8))) \
        .sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{path}/postings")
    index.table("postings").groupBy("gram").agg(F.count("*").alias("titles")).write.parquet(f"{path}/counts")
    return index


def search_titles(index: TitleIndex, wanted: DataFrame) -> DataFrame:
    """(query_id, parent_asin) of all titles that contain a wanted text, upper and lower case alike.

    ``wanted`` has (query_id, text).  A text is found by its rarest run: the list is read and
    its titles are compared with the whole text.  Nothing is gathered per text or title, so no task's memory
    grows with the number of pairs.  A text with a run that no title holds ends at the counts.  Null and empty texts find nothing.
    """
    asked = wanted.select("query_id", F.lower("text").alias("wanted")).filter(F.length("wanted") > 0).distinct()
    grams = F.array_distinct(F.when(F.length("wanted") >= GRAM, _runs(F.col("wanted"), GRAM)).otherwise(F.array("wanted")))
    parts = asked.select("query_id", "wanted", F.size(grams).alias("_all"), F.explode(grams).alias("gram"))
    counted = parts.join(index.table("counts"), "gram")
    known = counted.groupBy("query_id", "wanted").agg(F.count("*").alias("_known"))
    rare = top_per_group(counted, ["query_id", "wanted"], [F.asc("titles"), F.asc("gram")], 1)
    rare = rare.join(known, ["query_id", "wanted"]).filter(F.col("_known") == F.col("_all")).select(
        "query_id", "wanted", "gram", _bucket(F.col("gram"))
    )
    lists = rare.join(index.table("postings"), ["bucket", "gram"])
    # A text of one run is found by its list alone; others are compared with the titles on it.
    whole = lists.filter(F.col("wanted") == F.col("gram"))
    part = lists.filter(F.col("wanted") != F.col("gram")).join(index.table("titles"), "parent_asin").filter(
        F.contains("title", "wanted")
    )
    found = whole.select("query_id", "parent_asin").unionByName(part.select("query_id", "parent_asin"))
    several = _repeats(asked, "query_id") or _repeats(index.table("titles"), "parent_asin")
    return found.distinct() if several else found
