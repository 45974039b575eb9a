"""Helpers the operators share: words, whole-row batches, kept tables."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = " \t\n\x0b\x0c\r"
# Bytes of a word once A-Z are lower-cased: ASCII letters and digits, and everything beyond ASCII.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text with A-Z lower-cased, as UTF-8; null has none."""
    return _WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


def ascii_lower(x: Column) -> Column:
    """A-Z lower-cased, everything else as it is."""
    return F.translate(x, UPPER, LOWER)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def wrapped(df: DataFrame) -> DataFrame:
    """Every row as one struct ``row``: what an operator adds beside it can clash with no column."""
    return df.select(F.struct(*[df[c] for c in df.columns]).alias("row"))


def unwrapped(df: DataFrame, columns: list[str], text: str = "kept") -> DataFrame:
    """The columns of ``row`` with the new text in place, and the character count that goes with it."""
    new = {"text": F.col(text), "n_chars": F.length(text).cast("long")}
    return df.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in columns])


def map_batches(
    df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: StructType | str
) -> DataFrame:
    """``fn`` on every Arrow batch of ``df``; narrow, so lost tasks are simply run again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return df.mapInArrow(run, schema)


def rows_per_batch(df: DataFrame, rows: int) -> None:
    """Rows of an Arrow batch in the plans that follow: few where a task holds much else, results never depend on it."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def slices(texts: list[str | None], most: int = 16 << 20) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of ``texts`` of about ``most`` characters; one text is never cut."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text or "") > most:
            yield start, i
            start, size = i, 0
        size += len(text or "")
    if start < len(texts):
        yield start, len(texts)


def labelled_sample(labels: DataFrame, columns: list[str], most: int) -> dict[str, list]:
    """At most ``most`` labelled rows, chosen by a hash of the id, as columns on the driver.

    ``most`` is the documented bound of what a model is fitted on; nulls are left out.
    """
    known = labels.select("doc_id", *columns).dropna()
    rows = known.orderBy(F.xxhash64("doc_id"), "doc_id", *columns).limit(most).toPandas()
    return {c: rows[c].to_numpy() for c in rows.columns}


def broadcast(df: DataFrame, value: object):
    """A value of bounded size for the tasks of ``df``'s session."""
    return df.sparkSession.sparkContext.broadcast(value)


def may_occur(rows: DataFrame, wanted: DataFrame, columns: list[str], bits: int = 1 << 24) -> DataFrame:
    """``rows`` with ``may``: false where ``columns`` surely do not occur in ``wanted``.

    A bit map of fixed size, 2 MB, is broadcast whatever the size of ``wanted``; the fuller it is,
    the more rows are marked, never one too few.
    """
    slot = F.pmod(F.xxhash64(*columns), F.lit(bits)) + 1
    maps = wanted.groupBy(F.bitmap_bucket_number(slot).alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("_map")
    )
    at = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring("_map", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    is_set = F.coalesce(F.bit_get(byte, (at % 8).cast("int")) == 1, F.lit(False))
    placed = rows.withColumn("_bucket", F.bitmap_bucket_number(slot)).join(F.broadcast(maps), "_bucket", "left")
    return placed.withColumn("may", is_set).drop("_bucket", "_map")
