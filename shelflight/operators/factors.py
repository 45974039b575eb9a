"""Latent factors: biased matrix factorisation, recall, prediction."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.ml.recommendation import ALS
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelflight.functions.vectors import dot
from shelflight.operators.nearest import top_k
from shelflight.session import keep, shared_folder

RANK = 15
BLOCKS = 10  # of users and of items in ALS
CELLS = 1000  # stretches of items whose ratings are counted to cut the blocks


@dataclass
class Factors:
    """User and item tables (id, factors, bias) and the global mean."""

    users: DataFrame
    items: DataFrame
    mean: float


def dense_ids(df: DataFrame, key: str) -> DataFrame:
    """Consecutive integers for the values of a key, in its order: the frame with a column "index".

    The frame holds a key once; rows without one are left out.  They are range-partitioned,
    sorted and written with their partition number and their place in it; an index is that
    place plus the sizes of the earlier partitions, so nothing is shuffled for it again.
    """
    ids = df.filter(F.col(key).isNotNull()).repartitionByRange(key).sortWithinPartitions(key)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))
    placed = keep(ids.withColumn("_p", F.spark_partition_id()).withColumn("_i", place), "ids")
    sizes = placed.groupBy("_p").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    index = F.col("_offset") + F.col("_i")
    fits = F.assert_true(index < F.lit(2**31), F.lit("more ids than the factor model can number")).isNull()
    return placed.join(offsets, "_p").select(*df.columns, F.when(fits, index).cast("int").alias("index"))


def damped_mean(deviation: Column, damping: float = 10.0) -> Column:
    return F.sum(deviation) / (F.count("*") + damping)


def _placed(ids: DataFrame, block: Column, blocks: int) -> DataFrame:
    """The dense "index" as an id that ALS puts into the wanted block: ALS takes ids modulo their number."""
    placed = F.col("index").cast("bigint") * blocks + block
    fits = F.assert_true(placed < F.lit(2**31), F.lit("more ids than the factor model can number")).isNull()
    return ids.withColumn("index", F.when(fits, placed).cast("int"))


def _item_blocks(items: DataFrame, blocks: int) -> DataFrame:
    """Items in the order of their ids, cut into ranges of about as many ratings each."""
    cell = F.floor(F.col("index") / F.lit(max(1, items.count() // CELLS))).alias("_cell")
    cells = items.groupBy(cell).agg(F.sum("n").alias("_n"))
    before = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("_n").over(Window.partitionBy())
    part = F.floor(F.coalesce(F.sum("_n").over(before), F.lit(0)) * blocks / total).cast("int")
    cells = cells.select("_cell", part.alias("_block"))
    found = items.select("*", cell).join(cells, "_cell")
    return _placed(found, F.col("_block"), blocks).drop("_cell", "_block")


def _shared_out(load: Mapping[int, int], blocks: int, slack: float = 1.5) -> Column:
    """The block of a user, its "home" unless that holds more than ``slack`` times the mean.

    What is too much goes to the emptiest blocks, as few as can take it; which users go is told by
    a hash of their ids.
    """
    most = slack * sum(load.values()) / blocks
    room = {b: most - load.get(b, 0) for b in range(blocks)}
    place = F.pmod(F.xxhash64("user_id"), F.lit(1_000_003)) / 1_000_003.0
    block = F.col("home")
    for home in [b for b in range(blocks) if room[b] < 0]:
        taken, excess = 0.0, -room[home]
        while excess > 1e-6 * most:
            other = max(room, key=lambda b: (room[b], -b))
            part = min(excess, room[other])
            low, taken = taken, taken + part
            moves = (F.col("home") == home) & (place >= low / load[home]) & (place < taken / load[home])
            block = F.when(moves, F.lit(other)).otherwise(block)
            room[other] -= part
            excess -= part
    return block


def fit_factors(
    train: DataFrame, rank: int = RANK, reg: float = 0.1, iterations: int = 10, seed: int = 42,
    fit_on: DataFrame | None = None, blocks: int = BLOCKS,
) -> Factors:
    """Biases from damped means, items first, users on what the items leave; factors by ALS on the residuals.

    Fits on the train rows; pass ``fit_on`` to fit on another table, e.g. train and test.  The
    rows are read several times: keep them first where they are costly.

    Ratings meet the items once and the users once.  In each half round ALS sends a factor to
    every block of the other side that rates it.  So users go where most of their items are: what
    is known together lies together, and where ratings have no such order, nothing is lost.
    """
    rows = train if fit_on is None else fit_on
    ratings = rows.select("user_id", "item_id", F.col("rating").cast("double").alias("rating"))
    mean = ratings.agg(F.avg("rating")).first()[0]
    items = keep(ratings.groupBy("item_id").agg(
        damped_mean(F.col("rating") - mean).alias("bias"), F.count("*").alias("n")
    ), "biases")
    items = keep(_item_blocks(keep(dense_ids(items, "item_id"), "items"), blocks), "items")
    left = keep(
        ratings.join(items, "item_id").select(
            "user_id", F.col("index").alias("i"), (F.col("rating") - mean - F.col("bias")).alias("left")
        ), "residuals",
    )
    rated = [F.count_if(F.col("i") % blocks == b).alias(f"_{b}") for b in range(blocks)]
    home = F.array_max(F.array(*[
        F.struct(F.col(f"_{b}").alias("n"), F.xxhash64("user_id", F.lit(b)).alias("tie"), F.lit(b).alias("block"))
        for b in range(blocks)
    ]))["block"]
    users = keep(left.groupBy("user_id").agg(
        damped_mean(F.col("left")).alias("bias"), F.count("*").alias("n"), *rated
    ).select("user_id", "bias", "n", home.alias("home")), "biases")
    load = {r.home: r.n for r in users.groupBy("home").agg(F.sum("n").alias("n")).collect()}
    users = keep(_placed(dense_ids(users, "user_id"), _shared_out(load, blocks), blocks), "users")
    residuals = keep(  # ALS reads its input more than once
        left.join(users, "user_id").select(
            F.col("index").alias("u"), "i", (F.col("left") - F.col("bias")).cast("float").alias("r")
        ), "residuals",
    )
    shared_folder(train.sparkSession)
    model = ALS(
        rank=rank, regParam=reg, maxIter=iterations, seed=seed, userCol="u", itemCol="i", ratingCol="r",
        numUserBlocks=blocks, numItemBlocks=blocks, checkpointInterval=5,
    ).fit(residuals)

    def named(side: DataFrame, ids: DataFrame, key: str) -> DataFrame:
        return side.join(ids, side["id"] == ids["index"]).select(
            F.col(key).alias("id"), F.col("features").alias("factors"), "bias"
        )

    return Factors(named(model.userFactors, users, "user_id"), named(model.itemFactors, items, "item_id"), mean)


def factor_recall(users: DataFrame, items: DataFrame, k: int = 100, seen: DataFrame | None = None) -> DataFrame:
    """Top-k items per user by p.q alone; known items stay unless ``seen`` (user_id, item_id) hides them."""
    found = top_k(
        users.select(F.col("id").cast("string").alias("query_id"), F.col("factors").alias("vec")),
        items.select(F.col("id").cast("string").alias("item_id"), F.col("factors").alias("vec")), k,
        hidden=None if seen is None else seen.select(F.col("user_id").cast("string").alias("query_id"), "item_id"),
    )
    return found.select(F.col("query_id").alias("user_id"), "item_id", "score", "position")


def factor_recall_unseen(users: DataFrame, items: DataFrame, seen: DataFrame, k: int) -> DataFrame:
    """Top-k per user among the items the user has not seen.

    Seen items are masked inside each block, so every user ships k rows per block however many
    items the user has seen.
    """
    return factor_recall(users, items, k, seen)


def with_factors(pairs: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """(user_id, item_id, ...) with both sides' factors and biases, null where unknown."""
    u = users.select(F.col("id").alias("user_id"), F.col("factors").alias("_p"), F.col("bias").alias("_bu"))
    i = items.select(F.col("id").alias("item_id"), F.col("factors").alias("_q"), F.col("bias").alias("_bi"))
    return pairs.join(u, "user_id", "left").join(i, "item_id", "left")


def factor_score() -> Column:
    """p.q, 0.0 when a side is unknown."""
    return F.coalesce(dot(F.col("_p"), F.col("_q")), F.lit(0.0))


def with_mf_score(pairs: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    return with_factors(pairs, users, items).withColumn("mf_score", factor_score()).drop("_p", "_q", "_bu", "_bi")


def predict(pairs: DataFrame, users: DataFrame, items: DataFrame, mean: float, zero_bias: bool = False) -> DataFrame:
    """mean + biases + p.q within 1..5; an unknown side contributes nothing."""
    zero = F.lit(0.0)
    bias = zero if zero_bias else F.coalesce("_bu", zero) + F.coalesce("_bi", zero)
    value = F.lit(float(mean)) + bias + factor_score()
    return (
        with_factors(pairs, users, items)
        .withColumn("prediction", F.greatest(F.lit(1.0), F.least(F.lit(5.0), value)))
        .withColumn("known", F.col("_p").isNotNull() & F.col("_q").isNotNull())
        .drop("_p", "_q", "_bu", "_bi")
    )
