"""Parquet tables: read, first-existing read, write."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal rows out over the session's shuffle partitions.

    For work that costs far more than moving its input once: tasks then do not depend on how
    the files were cut, whatever the size of the table.  The number is given outright, because AQE
    would merge these small but costly partitions by their size.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def read_first(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """The first path that exists wins."""
    tried = []
    for path in paths:
        try:
            return spark.read.parquet(path)
        except AnalysisException as err:
            if "PATH_NOT_FOUND" not in str(err):
                raise
            tried.append(path)
    raise FileNotFoundError(f"none of these tables exists: {tried}")


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
