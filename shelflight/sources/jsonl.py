"""JSON-lines ingest: bad lines are skipped and counted, never fatal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CORRUPT = "_corrupt"


def _parsed(lines: DataFrame, schema: str) -> DataFrame:
    """(line, row) with ``row`` null for text that is not a JSON object.

    A field of the wrong type is only a null field: the line itself is valid JSON.
    The validity test runs on lines the typed parse complained about, nothing else.
    """
    parsed = lines.filter(F.trim("value") != "").select(
        F.col("value").alias("line"),
        F.from_json(
            "value", f"{schema}, {_CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
        ).alias("row"),
    )
    valid = F.col(f"row.{_CORRUPT}").isNull() | (
        F.get_json_object("line", "$").isNotNull() & F.try_parse_json("line").isNotNull()
    )
    return parsed.withColumn("ok", F.coalesce(valid & F.col("row").isNotNull(), F.lit(False)))


def parse_lines(lines: DataFrame, schema: str) -> DataFrame:
    """Rows of the good lines of a frame with one text column ``value``."""
    return _parsed(lines, schema).filter("ok").select("row.*").drop(_CORRUPT)


def line_counts(lines: DataFrame, schema: str) -> DataFrame:
    """How many non-blank lines were read, kept and skipped."""
    return _parsed(lines, schema).agg(
        F.count("*").alias("lines"),
        F.count_if("ok").alias("kept"),
        F.count_if(~F.col("ok")).alias("skipped"),
    )


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Scan JSON lines with an explicit schema, skipping unparsable lines."""
    return parse_lines(spark.read.text(path), schema)


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """Ingest of nothing at all is an error, not an empty table."""
    if df.isEmpty():
        raise ValueError(f"no valid record in {what}")
    return df
