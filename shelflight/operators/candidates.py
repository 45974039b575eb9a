"""Recall: popularity, content, factors, merged into candidates for all users at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelflight.functions.common import first_per_group, hash_order, top_per_group
from shelflight.session import keep

K_MF = 100
K_CONTENT = 50
K_POPULAR = 50
MAX_REFERENCES = 10
RANGE_WIDTH = 256
SOURCES = ("mf", "content", "popularity")


def popularity_recall(
    users: DataFrame, popularity: DataFrame, k: int = K_POPULAR, max_excluded: int = K_MF + 20,
    shuffle: bool = True, seed: int = 42,
) -> DataFrame:
    """The k most popular items per user outside the user's exclusions, (user_id, item_id, pos).

    ``users`` has (user_id, excluded array).  Twice k items are taken; the first fifth stays in
    front and the rest is shuffled.  No user with at most ``max_excluded`` exclusions needs more
    than the top 2k + ``max_excluded`` items, so that short list is one scalar and the work per
    user is array arithmetic, without any join.  Users with more exclusions read ranges of ranks.
    """
    w = 2 * k + max_excluded
    head = popularity.orderBy(F.desc("popularity_score"), F.asc("item_id")).limit(w)
    ranked = F.transform(
        F.array_sort(F.collect_list(F.struct((-F.col("popularity_score")).alias("s"), "item_id"))), lambda e: e["item_id"]
    )
    few = F.coalesce(F.size("excluded"), F.lit(0)) <= max_excluded
    usual = users.filter(few).withColumn("_head", head.agg(ranked).scalar()).select(
        "user_id", F.slice(F.array_except("_head", "excluded"), 1, 2 * k).alias("_pool")
    )
    staged = usual.unionByName(pools_past_exclusions(users.filter(~few), popularity, 2 * k))
    size = F.size("_pool")
    fixed = F.floor(size * 0.2).cast("int")
    rest = F.slice("_pool", fixed + 1, F.greatest(size - fixed, F.lit(0)))
    mixed = F.transform(
        F.array_sort(F.transform(rest, lambda i: F.struct(hash_order(seed, F.col("user_id").cast("string"), i).alias("h"),
                                                          i.alias("item_id")))),
        lambda e: e["item_id"],
    )
    ordered = F.when((size > k) & F.lit(shuffle), F.concat(F.slice("_pool", F.lit(1), fixed), mixed)).otherwise(
        F.col("_pool")
    )
    return staged.select("user_id", F.posexplode(F.slice(ordered, 1, k)).alias("pos", "item_id")).select(
        "user_id", "item_id", (F.col("pos") + 1).alias("pos")
    )


def numbered(popularity: DataFrame) -> DataFrame:
    """(item_id, rank): places from 0 by score, ties by id.

    Items are dealt by range of the order and counted per part; only parts are summed in one task.
    """
    order = (-F.col("popularity_score")).alias("s")
    dealt = keep(
        popularity.select(order, "item_id").repartitionByRange("s", "item_id").withColumn("_part", F.spark_partition_id()),
        "ranks",
    )
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("_part").agg(F.count("*").alias("_size")).select(
        "_part", F.coalesce(F.sum("_size").over(ahead), F.lit(0)).alias("_start")
    )
    inside = F.row_number().over(Window.partitionBy("_part").orderBy("s", "item_id"))
    return dealt.withColumn("_at", inside).join(starts, "_part").select(
        "item_id", (F.col("_start") + F.col("_at") - 1).alias("rank")
    )


def pools_past_exclusions(users: DataFrame, popularity: DataFrame, n: int, width: int = RANGE_WIDTH) -> DataFrame:
    """(user_id, _pool): the n most popular items of users whose exclusions outgrow the shared list.

    Ranks are kept in ranges of ``width`` items.  A user's exclusions are counted per range, so
    the ranges that hold the user's first n free items follow from counts alone; only these are
    read, less the exclusions that fall on them.  Ranges without a free item are skipped.  No row
    holds more than a range or n x n items, whatever the size of the catalogue.
    """
    ranks = keep(numbered(popularity).withColumn("_range", F.floor(F.col("rank") / width)), "ranges")
    packed = ranks.groupBy("_range").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "item_id"))), lambda e: e["item_id"]).alias("_items")
    )
    gone = users.select("user_id", F.explode(F.array_distinct("excluded")).alias("item_id")).join(ranks, "item_id")
    hidden = gone.groupBy("user_id", "_range").agg(F.collect_list("item_id").alias("_hidden"))
    total = ranks.agg(F.count("*")).scalar()
    # e exclusions hide e items at most, so the first n + e ranks hold n free ones or all there are.
    last = F.floor((F.least(F.lit(n) + F.size("excluded"), F.col("_total")) - 1) / width)
    spans = users.withColumn("_total", total).filter(F.col("_total") > 0).select(
        "user_id", "_total", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("_range")
    )
    free = F.least(F.lit(width), F.col("_total") - F.col("_range") * width) - F.coalesce(F.size("_hidden"), F.lit(0))
    ahead = Window.partitionBy("user_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    read = spans.join(hidden, ["user_id", "_range"], "left").withColumn("_free", free).withColumn(
        "_before", F.coalesce(F.sum("_free").over(ahead), F.lit(0))
    ).filter((F.col("_before") < n) & (F.col("_free") > 0))
    none = F.array().cast(f"array<{popularity.schema['item_id'].dataType.simpleString()}>")
    open_items = F.slice(F.array_except("_items", F.coalesce("_hidden", none)), 1, n)
    parts = read.join(packed, "_range").groupBy("user_id").agg(
        F.array_sort(F.collect_list(F.struct("_range", open_items.alias("_open")))).alias("_parts")
    )
    return parts.select("user_id", F.slice(F.flatten(F.transform("_parts", lambda e: e["_open"])), 1, n).alias("_pool"))


def content_recall(
    references: DataFrame, neighbours: DataFrame, excluded: DataFrame | None = None,
    k: int = K_CONTENT, single: bool = False,
) -> DataFrame:
    """Items similar to a user's references: (user_id, item_id, score, pos).

    ``references`` has (user_id, reference_id, pos); ``neighbours`` the top lists of the
    distinct references, (query_id, item_id, score, position), long enough that k items per
    reference remain after a user's exclusions.  One reference alone gives its k best; n
    references (ten at most) give k // n + 5 each, merged first seen, best scores first.
    """
    refs = references.filter(F.col("pos") <= MAX_REFERENCES)
    counts = refs.groupBy("user_id").agg(F.count("*").alias("_n"))
    fetch = F.lit(k) if single else F.floor(F.lit(k) / F.col("_n")) + 5
    lists = refs.join(counts, "user_id").withColumn("_fetch", fetch).withColumnRenamed("pos", "ref_pos").join(
        neighbours.select(F.col("query_id").alias("reference_id"), "item_id", "score", "position"), "reference_id"
    )
    if excluded is None:
        # Nothing falls out of a list, so its own positions are the places; no row beyond them is shuffled.
        cut = lists.filter(F.col("position") <= F.col("_fetch")).withColumn("_at", F.col("position"))
    else:
        lists = lists.join(excluded.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
        # A user has ten references at most, so (user, reference) lists are short.
        per_ref = Window.partitionBy("user_id", "ref_pos").orderBy("position")
        cut = lists.withColumn("_at", F.row_number().over(per_ref)).filter(F.col("_at") <= F.col("_fetch"))
    # Ten short lists a user: dealt out by user, items and places need no exchange of their own.
    first = first_per_group(cut.repartition("user_id"), ["user_id", "item_id"], [F.asc("ref_pos"), F.asc("_at")])
    return top_per_group(
        first, ["user_id"], [F.desc(F.round("score", 9)), F.asc("ref_pos"), F.asc("_at")], k, "pos"
    ).select("user_id", "item_id", "score", "pos")


def merge_candidates(mf: DataFrame, content: DataFrame, popular: DataFrame, only_content: bool = False) -> DataFrame:
    """One list per user: factors, then content, then popularity; the first source of an item wins.

    Gives (user_id, item_id, source, pos, recall_count).
    """
    parts = [(1, content)] if only_content else [(0, mf), (1, content), (2, popular)]
    union = None
    for rank, part in parts:
        rows = part.select("user_id", "item_id", F.lit(rank).alias("_rank"), F.col("pos").alias("_at"))
        union = rows if union is None else union.unionByName(rows)
    # Recall lists are short, so a user's are one row; lists that lie by user already are not dealt out again.
    lists = union.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("_rank", "_at", "item_id"))).alias("_rows"))

    def items(last: int) -> Column:
        """Distinct items of the sources up to this one, the first place of each deciding."""
        rows = F.filter("_rows", lambda e: e["_rank"] <= last)
        return F.array_distinct(F.transform(rows, lambda e: e["item_id"]))

    counts = {rank: F.size(items(rank)).alias(f"_upto{rank}") for rank, _ in parts}
    placed = lists.select("user_id", items(parts[-1][0]).alias("_items"), *counts.values()).select(
        "user_id", *[f"_upto{rank}" for rank in counts], F.size("_items").cast("bigint").alias("recall_count"),
        F.posexplode("_items").alias("_place", "item_id"),
    )
    source = F.lit(None).cast("string")
    for rank in reversed(counts):
        source = F.when(F.col("_place") < F.col(f"_upto{rank}"), F.lit(SOURCES[rank])).otherwise(source)
    return placed.select(
        "user_id", "item_id", source.alias("source"), (F.col("_place") + 1).alias("pos"), "recall_count"
    )


def shuffled(recommendations: DataFrame, trending: DataFrame | None = None, seed: int = 42, refill: bool = False) -> DataFrame:
    """Seeded shuffle of each user's list; with trending items these take at most 60 % of the places.

    The other places go to the remaining items; surplus trending items are dropped unless
    ``refill``.  Adds ``position``.
    """
    key = hash_order(seed, F.col("user_id").cast("string"), F.col("item_id"))
    w = Window.partitionBy("user_id")
    rows = recommendations.withColumn("_h", key)
    if trending is not None:
        marks = trending.select(F.col("asin").alias("item_id"), F.lit(True).alias("_hot"))
        rows = rows.join(marks, "item_id", "left").withColumn("_hot", F.coalesce("_hot", F.lit(False)))
        total, hot = F.count("*").over(w), F.count_if("_hot").over(w)
        rows = rows.withColumn("_slots", F.least(hot, F.floor(total * 0.6))).withColumn("_total", total)
        place = F.row_number().over(Window.partitionBy("user_id", "_hot").orderBy("_h", "item_id"))
        rows = rows.withColumn("_place", place)
        keep = F.when(F.col("_hot"), F.col("_place") <= F.col("_slots")).otherwise(
            F.col("_place") <= F.col("_total") - F.col("_slots")
        )
        rows = rows if refill else rows.filter(keep)
        rows = rows.drop("_hot", "_slots", "_total", "_place")
    return rows.withColumn("position", F.row_number().over(w.orderBy("_h", "item_id"))).drop("_h")


def fallback_by_category(
    seeds: DataFrame, satisfied: DataFrame, items: DataFrame, k: int
) -> DataFrame:
    """For seed items without similar items: the best of the same category, the seed excluded.

    ``seeds`` has (seed_id); ``items`` (item_id, category, avg_rating, rating_number).  The
    best k + 1 of each category are found first, so a big category is never paired with
    each of its seeds.
    """
    open_seeds = seeds.join(satisfied.select("seed_id").distinct(), "seed_id", "left_anti")
    scored = items.filter(F.col("category").isNotNull()).withColumn(
        "score", F.coalesce("avg_rating", F.lit(0.0)) * F.coalesce("rating_number", F.lit(0))
    )
    best = top_per_group(scored, ["category"], [F.desc("score"), F.asc("item_id")], k + 1)
    with_category = open_seeds.join(items.select(F.col("item_id").alias("seed_id"), "category"), "seed_id")
    paired = with_category.join(best.select("category", "item_id", "score", "_pos"), "category").filter(
        F.col("item_id") != F.col("seed_id")
    )
    return top_per_group(paired, ["seed_id"], [F.asc("_pos")], k, "position").select(
        "seed_id", "item_id", "score", "position", F.lit("similar_category_fallback").alias("rule")
    )


def excluded_array(items: DataFrame, alias: str = "excluded") -> DataFrame:
    """Distinct item ids per user as an array; for lists that are short by construction."""
    return items.groupBy("user_id").agg(F.collect_set("item_id").alias(alias))

