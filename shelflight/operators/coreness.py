"""Coreness of users and items: one number per node, from which every k-core follows."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelflight.session import keep, scratch_path


@dataclass
class Coreness:
    """(user_id, level) and (item_id, level): the largest k whose k-core holds the node."""

    users: DataFrame
    items: DataFrame
    edges: DataFrame
    rounds: int

    def rows(self, interactions: DataFrame, k: int) -> DataFrame:
        """The interactions inside the k-core: those without a node that fell out, which are the fewer."""
        named = interactions.filter(F.col("user_id").isNotNull() & F.col("item_id").isNotNull())
        users, items = (side.filter(F.col("level") < k) for side in (self.users, self.items))
        return named.join(users, "user_id", "left_anti").join(items, "item_id", "left_anti").select(
            *interactions.columns
        )

    def sizes(self, ks: Sequence[int]) -> DataFrame:
        """(k, n_rows, n_users, n_items) of several cores from one pass over the edges."""
        both = self.edges.join(self.users.withColumnRenamed("level", "_user"), "user_id").join(
            self.items.withColumnRenamed("level", "_item"), "item_id"
        )
        counted = [
            both.groupBy(F.least("_user", "_item").alias("level")).agg(F.sum("n").alias("n"), F.lit("n_rows").alias("what")),
            self.users.groupBy("level").agg(F.count("*").alias("n"), F.lit("n_users").alias("what")),
            self.items.groupBy("level").agg(F.count("*").alias("n"), F.lit("n_items").alias("what")),
        ]
        levels = counted[0].unionByName(counted[1]).unionByName(counted[2])

        def total(what: str) -> Column:
            return F.coalesce(F.sum(F.when((F.col("what") == what) & (F.col("level") >= F.col("k")), F.col("n"))), F.lit(0))

        ladder = F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")
        return levels.select("*", ladder).groupBy("k").agg(
            *[total(w).alias(w) for w in ("n_rows", "n_users", "n_items")]
        )


def _neighbours(edges: DataFrame, side: str) -> DataFrame:
    """The edges as a table bucketed by one side: joins on that side never shuffle it again."""
    spark = edges.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"core_edges_{side}_{uuid.uuid4().hex}"
    writer = edges.repartition(parts, side).write.bucketBy(parts, side).format("parquet")
    writer.option("path", scratch_path(spark, "core-edges")).saveAsTable(name)
    return spark.table(name)


def _or_none(level: Column, least: int) -> Column:
    return F.when(level >= least, level).otherwise(F.lit(0).cast("bigint"))


def _told(changed: DataFrame, edges: DataFrame, near: str, far: str, cap: Column) -> DataFrame:
    """What nodes hear from neighbours whose level fell: (near, heard), rows gained or lost per level.

    One row per edge of a fallen node travels, to where it is summed and joined; a node hears at
    most once from each neighbour.  Rows at the cap are below nobody, so they go unsaid.
    """
    gained = F.struct(F.col("level").alias("at"), "n")
    lost = F.struct(F.col("sent").alias("at"), (-F.col("n")).alias("n"))
    moved = F.explode(F.when(F.col("sent") < cap, F.array(lost, gained)).otherwise(F.array(gained)))
    moves = edges.join(changed, far).select(near, "sent", "level", "n").repartition(near)
    moves = moves.select(near, moved.alias("m")).select(near, "m.at", "m.n")
    return moves.groupBy(near, "at").agg(F.sum("n").alias("n")).filter(F.col("n") != 0).groupBy(near).agg(
        F.map_from_entries(F.collect_list(F.struct("at", "n"))).alias("heard")
    )


def _fallen(state: DataFrame, heard: DataFrame, near: str, least: int) -> DataFrame:
    """The levels after what was heard: the largest h such that h rows lead to neighbours of level h or more.

    ``below`` holds the rows to neighbours under the node's own level, per level; all others of
    its ``n`` rows count in full.  ``sent`` becomes the level that the neighbours know.
    """
    none = F.create_map().cast("map<bigint,bigint>")
    level, below = F.col("level"), F.map_zip_with(
        "below", F.coalesce("heard", none), lambda _, a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    )
    under = F.map_filter(below, lambda at, n: (at < level) & (n != 0))
    placed = state.join(heard, near, "left").select(near, "n", level, under.alias("below"))
    entries = F.sort_array(F.map_entries("below"), asc=False)
    full = F.col("n") - F.aggregate(F.map_values("below"), F.lit(0).cast("bigint"), lambda s, n: s + n)
    h = F.aggregate(
        entries,
        F.struct(full.alias("rows"), F.least("level", full).alias("best")),
        lambda s, e: F.struct(
            (s["rows"] + e["value"]).alias("rows"),
            F.greatest(s["best"], F.least(e["key"], s["rows"] + e["value"])).alias("best"),
        ),
        lambda s: s["best"],
    )
    found = placed.select(near, "n", level.alias("sent"), _or_none(h, least).alias("level"), "below")
    return keep(
        found.withColumn("below", F.map_filter("below", lambda at, _: at < F.col("level"))), "core-levels"
    )


def coreness(interactions: DataFrame, most: int | None = None, max_rounds: int = 1000, least: int = 0) -> Coreness:
    """Levels of all nodes by repeated h-indexes over the user-item graph.

    A level starts as the node's number of rows and becomes the h-index of its neighbours'
    levels until no level changes; the fixpoint is the coreness.  With ``most`` levels stop at
    that number, which is all that cores up to it need and ends earlier.  Levels under ``least``
    become 0 at once, which is all that cores from it on need: with both at k a node falls once,
    and this is the peeling of the k-core.  Repeated rows of a pair count each; rows without a user or an item take no part.

    Every node keeps how many of its rows lead to neighbours below it, and hears only of
    neighbours whose level fell.  The edges lie bucketed by user and by item, so a round moves
    the levels and the rows of fallen nodes, not the edges.
    """
    named = interactions.filter(F.col("user_id").isNotNull() & F.col("item_id").isNotNull())
    by_user = _neighbours(named.groupBy("user_id", "item_id").agg(F.count("*").alias("n")), "user_id")
    by_item = _neighbours(by_user, "item_id")
    cap = F.lit(most if most is not None else 2**62).cast("bigint")
    none = F.create_map().cast("map<bigint,bigint>").alias("below")

    def start(edges: DataFrame, side: str, level: Column) -> DataFrame:
        return edges.groupBy(side).agg(F.sum("n").alias("n")).select(
            side, "n", cap.alias("sent"), level.alias("level"), none
        )

    # An item's rows bound its h-index from the start, so items need no first level.
    users = keep(start(by_user, "user_id", _or_none(F.least("n", cap), least)), "core-levels")
    items = start(by_item, "item_id", cap)
    fell = F.col("level") < F.col("sent")

    def done(number: int) -> Coreness:
        return Coreness(users.select("user_id", "level"), items.select("item_id", "level"), by_user, number)

    for number in range(1, max_rounds + 1):
        told = users.filter(fell).select("user_id", "sent", "level")
        items = _fallen(items, _told(told, by_user, "item_id", "user_id", cap), "item_id", least)
        told = items.filter(fell).select("item_id", "sent", "level")
        if told.isEmpty():
            return done(number)
        users = _fallen(users, _told(told, by_item, "user_id", "item_id", cap), "user_id", least)
        if users.filter(fell).isEmpty():
            return done(number)
    raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
