"""Lines that many documents share, found with levelled sorted runs of line hashes.

The state is a set of runs, tables of (hash, number of documents) sorted by hash.  A batch of
documents adds its counts as a run of level 0; when a level has ``fanout`` runs, they are merged
into one run of the next level.  A hash that has reached the limit in a merge moves to the settled
runs: its lines are decided, and every later batch anti-joins those runs first, so a very common
line is counted only until it is settled.  Batches can come from separate jobs; the runs are
Parquet tables in the shared folder.

A line's key is the line without ASCII white space at its ends and with A-Z lower-cased.  Keys of
at least ``min_chars`` code points that occur in at least ``min_docs`` documents lose all their
lines.  Keys are compared by two 64-bit hashes.

Edge rows: a null or empty text is one empty line and stays as it is; empty keys are never
dropped; a key counts once per row however often the row repeats it, and repeated rows count each;
an empty table gives an empty result; other columns are carried along and may have any name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelflight.llm.common import SPACE, ascii_lower, wrapped
from shelflight.session import keep

MIN_DOCS, MIN_CHARS = 10, 1


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_hashes(text: Column, min_chars: int = MIN_CHARS) -> Column:
    """For every line the struct (a, b) of its key's hashes; null where the key is too short."""
    def hashed(line: Column) -> Column:
        key = F.btrim(line, F.lit(SPACE))
        return F.when(F.char_length(key) >= min_chars, F.struct(
            F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b")
        ))

    return F.transform(lines(ascii_lower(text)), hashed)


class LineRuns:
    """Levelled sorted runs of (a, b, n): line hashes and the documents they were seen in."""

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, fanout: int = 2) -> None:
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.levels: list[list[DataFrame]] = [[]]
        self.settled: list[DataFrame] = []

    def _without_settled(self, run: DataFrame) -> DataFrame:
        for known in self.settled:
            run = run.join(known.hint("merge"), ["a", "b"], "left_anti")
        return run

    def add(self, batch: DataFrame) -> None:
        """``batch``: (a, b, n).  Settled hashes are left out, the rest becomes a run of level 0."""
        run = self._without_settled(batch.select("a", "b", "n"))
        self.levels[0].append(keep(run.repartition("a").sortWithinPartitions("a", "b"), "line-run"))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self._merge(self.levels[level], level + 1)
            self.levels[level] = []
            level += 1

    def _merge(self, runs: Sequence[DataFrame], level: int) -> None:
        every = runs[0]
        for run in runs[1:]:
            every = every.unionByName(run)
        merged = self._without_settled(every).groupBy("a", "b").agg(F.sum("n").alias("n"))
        merged = keep(merged.sortWithinPartitions("a", "b"), "line-run")
        self.settled.append(merged.filter(F.col("n") >= self.min_docs).select("a", "b"))
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(merged.filter(F.col("n") < self.min_docs))

    def compact(self) -> DataFrame:
        """Merge all levels; the settled hashes (a, b)."""
        runs = [run for level in self.levels for run in level]
        self.levels = [[]]
        if runs:
            self._merge(runs, 1)
        found = self.settled[0] if self.settled else self.spark.createDataFrame([], "a long, b long")
        for part in self.settled[1:]:
            found = found.unionByName(part)
        return found


def batch_counts(docs: DataFrame, text: str = "text", batches: int = 4, min_chars: int = MIN_CHARS) -> DataFrame:
    """(batch, a, b, n): documents per line hash, cut into batches by a hash of the text."""
    keys = F.array_distinct(F.filter(key_hashes(F.col(text), min_chars), lambda k: k.isNotNull()))
    batch = F.pmod(F.xxhash64(text), F.lit(batches)).cast("int")
    return docs.select(batch.alias("batch"), F.inline(keys)).groupBy("batch", "a", "b").agg(F.count("*").alias("n"))


def common_lines(docs: DataFrame, text: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS,
                 batches: int = 4) -> DataFrame:
    """(a, b) of the keys found in at least ``min_docs`` documents."""
    spark = docs.sparkSession
    counted = keep(batch_counts(docs, text, batches, min_chars), "line-batches")
    runs = LineRuns(spark, min_docs)
    for number in range(batches):
        runs.add(counted.filter(F.col("batch") == number))
    return keep(runs.compact(), "line-settled")


def drop_common_lines(docs: DataFrame, text: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(row, kept, n_lines, n_dropped): the row as it was, its kept text and its counts.

    Only hashes travel to the settled keys; what comes back is, per distinct text, the sorted
    positions of its dropped lines.  Texts are shuffled once, by their own hash.
    """
    settled = common_lines(docs, text, min_docs, min_chars)
    body = F.coalesce(F.col(f"row.`{text}`"), F.lit(""))
    marked = wrapped(docs).select(
        "row", body.alias("body"), F.struct(F.xxhash64(body).alias("x"), F.xxhash64(F.lit(1), body).alias("y")).alias("mark")
    )
    placed = marked.select("mark", F.posexplode(key_hashes(F.col("body"), min_chars)).alias("at", "key"))
    hit = placed.filter(F.col("key").isNotNull()).select("mark", "at", "key.a", "key.b").join(settled, ["a", "b"])
    # Written, so that both sides of the join below are plain exchanges that AQE can split for a text of many copies.
    drops = keep(hit.groupBy("mark").agg(F.array_sort(F.collect_set("at")).alias("drops")), "line-drops")
    cut = marked.join(drops, "mark", "left").select(
        "row", "body", lines(F.col("body")).alias("lines"), F.coalesce("drops", F.array().cast("array<int>")).alias("drops")
    )
    # The kept lines are the stretches between dropped ones.
    edges = F.concat(F.array(F.lit(-1)), F.col("drops"), F.array(F.size("lines")))
    stretches = F.transform(
        F.sequence(F.lit(1), F.size("drops") + 1),
        lambda i: F.slice("lines", F.element_at("edges", i) + 2,
                          F.element_at("edges", i + 1) - F.element_at("edges", i) - 1),
    )
    kept = F.when(F.size("drops") == 0, F.col("body")).otherwise(F.array_join(F.flatten(stretches), "\n"))
    return cut.withColumn("edges", edges).select(
        "row", kept.alias("kept"), F.size("lines").cast("long").alias("n_lines"), F.size("drops").cast("long").alias("n_dropped")
    )
