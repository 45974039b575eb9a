"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source is due the same number of copies, target / size of the source.  Its
whole part is taken as it is; the fraction is a probability.  Two documents are paired and words
are moved between their probabilities - a random direction, chosen so that each expectation stays -
until one of them is 0 or 1.  The words a source takes therefore stay equal to its target up to
the rounding of one last document, and as groups are folded from large to small documents, that
one is small.

The ``HEAVY`` largest documents of a source go first, one after the other, as one long document is
worth thousands of others: each is paired with all documents after it together, and what its
rounding leaves over or short moves to them by their common rate.  The direction is random, unless
one direction would leave more or less than the others can take.  So only small documents are left
to the end.

The pairs form a reduction tree: documents meet in groups of ``GROUP`` by a hash of their id, a
group hands on its one undecided document, and those meet in groups again.  So a source of any
size is rounded by many tasks, and the tree has log(n) / log(GROUP) levels.  All randomness is a
hash of ids and seed: reruns agree, on any number of executors.

Edge rows: a null text or one without words has size 0, its fraction is rounded by its own hash
and it takes no words; the null source is a source of its own, last in order; repeated rows are
documents of their own; an empty table gives an empty result; other columns are ignored.  When
all sizes are 0 every target is 0.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelflight.functions.common import top_per_group
from shelflight.session import keep

GROUP = HEAVY = 64
WEIGHTS = (5.0, 2.0, 1.0)
_NEAR = 1e-9


def word_count(text: Column) -> Column:
    """Number of runs of anything but ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, n_docs, target) from (source, size).

    Targets are in proportion to the weights, none above ``most`` times its source.  Pouring the
    excess on until it fits ends at a level L with target = min(most * size, L * weight); sorted by
    size / weight, running sums give the level directly.  The windows hold one row per source.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    ready = per_source.withColumn("weight", cycle).withColumn("full", F.col("source_size") * F.lit(most))
    by_fill = Window.orderBy((F.col("full") / F.col("weight")), F.col("source").asc_nulls_last())
    before, rest = by_fill.rowsBetween(Window.unboundedPreceding, -1), by_fill.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("full").over(before), F.lit(0.0))) \
        / F.sum("weight").over(rest)
    # The first source that stays under its ceiling fixes the level for all that follow.
    levels = ready.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= F.col("full"))
    final = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(
        by_fill.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    target = F.when(final.isNull(), F.col("full")).otherwise(F.least(F.col("full"), final * F.col("weight")))
    return levels.select("source", "source_size", "n_docs", target.alias("target"))


def uniform(*parts: Column) -> Column:
    """A repeatable number in [0, 1)."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 53)).cast("double") / float(1 << 53)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _pair(state: Column, x: Column, level: int, seed: int) -> Column:
    """Fold one document into a group: (done, row, size, p, base), the undecided one last."""
    t, q = x["size"].cast("double"), x["p"]

    def opened(done: Column) -> Column:
        return F.struct(done.alias("done"), x["row"].alias("row"), t.alias("size"), q.alias("p"), x["base"].alias("base"))

    def moves() -> Column:
        s, p = state["size"], state["p"]
        up = F.least((1.0 - p) * s, q * t)  # words the first can take from the second
        down = F.least(p * s, (1.0 - q) * t)
        draw = uniform(state["row"]["doc_id"], x["row"]["doc_id"], F.lit(level), F.lit(seed))
        return let(
            F.struct(up.alias("up"), down.alias("down")),
            lambda m: F.when(draw * (m["up"] + m["down"]) < m["down"], m["up"]).otherwise(-m["down"]),
        )

    def whole(v: Column) -> Column:
        return F.when(v > 1 - _NEAR, 1).when(v < _NEAR, 0)

    def settle(m: Column) -> Column:
        return F.struct(
            (state["p"] + m / state["size"]).alias("a"), (q - m / t).alias("b"),
        )

    def close(row: Column, size: Column, base: Column, v: Column) -> Column:
        item = F.struct(row.alias("row"), size.cast("long").alias("size"), (base + whole(v)).cast("int").alias("copies"))
        return F.when(whole(v).isNotNull(), F.array(item)).otherwise(F.array().cast(_DONE))

    def result(r: Column) -> Column:
        done = F.concat(
            state["done"], close(state["row"], state["size"], state["base"], r["a"]),
            close(x["row"], t, x["base"], r["b"]),
        )
        left = whole(r["a"]).isNull()
        right = whole(r["b"]).isNull()
        return F.struct(
            done.alias("done"),
            F.when(left, state["row"]).when(right, x["row"]).alias("row"),
            F.when(left, state["size"]).otherwise(t).alias("size"),
            F.when(left, r["a"]).otherwise(r["b"]).alias("p"),
            F.when(left, state["base"]).otherwise(x["base"]).alias("base"),
        )

    return F.when(state["row"].isNull(), opened(state["done"])).otherwise(let(let(moves(), settle), result))


ROW = "struct<doc_id:bigint,copy:bigint>"
_DONE = f"array<struct<row:{ROW},size:bigint,copies:int>>"


def _folded(due: DataFrame, keys: list[str], level: int, seed: int) -> DataFrame:
    """One fold per group of bounded size: its decided documents and the one left over."""
    # Large documents first: what is left of a large one is spread over the smaller ones after it.
    item = F.struct((-F.col("size")).alias("order"), "row", "size", "p", "base")
    start = F.struct(
        F.array().cast(_DONE).alias("done"), F.lit(None).cast(ROW).alias("row"), F.lit(1.0).alias("size"),
        F.lit(0.0).alias("p"), F.lit(0).alias("base"),
    )
    return due.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("items")).select(
        *keys, F.aggregate("items", start, lambda state, x: _pair(state, x, level, seed)).alias("state")
    )


def _heaviest(heavy: DataFrame, goals: DataFrame, most: float, seed: int) -> DataFrame:
    """(_source, spent, heavy_size, n_heavy, done): the largest documents against all after them."""
    item = F.struct((-F.col("size")).alias("order"), "row", "size")
    grouped = heavy.groupBy("_source").agg(F.array_sort(F.collect_list(item)).alias("items")).join(goals, "_source")

    def settle(state: Column, x: Column) -> Column:
        s, due, behind = x["size"].cast("double"), F.col("target") - state["spent"], state["left"] - x["size"]
        rate = F.least(F.greatest(due / state["left"], F.lit(0.0)), F.lit(most))

        def choose(r: Column) -> Column:
            base = F.floor(r + _NEAR)
            up_fits = due - s * (base + 1) >= 0
            down_fits = due - s * base <= most * behind
            drawn = uniform(x["row"]["doc_id"], F.lit(seed), F.lit("heavy")) < r - base
            up = F.when(up_fits & ~down_fits, F.lit(True)).when(down_fits & ~up_fits, F.lit(False)).otherwise(drawn)
            return F.least(base + F.when(up & (r - base > _NEAR), 1).otherwise(0), F.lit(int(most))).cast("int")

        def after(copies: Column) -> Column:
            item = F.struct(x["row"].alias("row"), x["size"].alias("size"), copies.alias("copies"))
            return F.struct(
                (state["spent"] + s * copies).alias("spent"), behind.alias("left"),
                F.concat(state["done"], F.array(item)).alias("done"),
            )

        return let(let(rate, choose), after)

    start = F.struct(F.lit(0.0).alias("spent"), F.col("source_size").alias("left"), F.array().cast(_DONE).alias("done"))
    return grouped.withColumn("state", F.aggregate("items", start, settle)).select(
        "_source", "state.spent", (F.col("source_size") - F.col("state.left")).alias("heavy_size"),
        F.size("state.done").alias("n_heavy"), "state.done",
    )


def _last(open_: DataFrame, seed: int) -> DataFrame:
    """The document left over at the end is rounded by its own probability."""
    up = F.when(uniform(F.col("row.doc_id"), F.lit(seed), F.lit("last")) < F.col("p"), 1).otherwise(0)
    return open_.select("_source", F.struct("row", "size", (F.col("base") + up).cast("int").alias("copies")).alias("done"))


def _open(folded: DataFrame, *keys: str) -> DataFrame:
    return folded.filter(F.col("state.row").isNotNull()).select(
        *keys, "state.row", F.col("state.size").cast("long").alias("size"), "state.p", "state.base"
    )


def _due(docs: DataFrame, rates: DataFrame) -> DataFrame:
    """Whole and fractional copies of every document by the rate of its source."""
    whole = F.floor(F.col("rate") + _NEAR)
    return docs.join(rates, "_source").withColumn("base", whole.cast("int")).withColumn(
        "p", F.greatest(F.col("rate") - whole, F.lit(0.0))
    )


def mix(docs: DataFrame, seed: int = 17, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of every document."""
    thin = docs.select(
        F.struct("source").alias("_source"), word_count(F.col("text")).alias("size"),
        F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("copy")).alias("row"),
    )
    thin = keep(thin, "mix-sizes")
    goals = targets(thin.select("_source.source", "size"), weights, share, most)
    goals = keep(goals.select(F.struct("source").alias("_source"), "source_size", "target", "n_docs"), "mix-targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))

    # The largest documents, a bounded number per source.
    heavy = keep(top_per_group(
        thin.filter("size > 0"), ["_source"], [F.desc("size"), F.asc("row")], HEAVY
    ).drop("_pos"), "mix-heavy")
    spent = keep(_heaviest(heavy, goals, most, seed), "mix-heavy-fold")
    settled = spent.select("_source", F.explode("done").alias("done"))
    zero = F.lit(0)
    left = goals.join(spent.drop("done"), "_source", "left").select(
        "_source", F.greatest(F.col("n_docs") - F.coalesce("n_heavy", zero), zero).alias("n_rest"),
        F.when(
            F.col("source_size") > F.coalesce("heavy_size", zero),
            F.least(F.greatest((F.col("target") - F.coalesce("spent", zero)) / (F.col("source_size") - F.coalesce("heavy_size", zero)),
                               F.lit(0.0)), F.lit(most)),
        ).otherwise(rate).alias("rate"),
    )
    left = keep(left, "mix-rest")

    rest = _due(thin.join(heavy.select("row"), "row", "left_anti"), left)
    alone = (F.col("size") == 0) | (F.col("p") < _NEAR)
    own = F.when(uniform(F.col("row.doc_id"), F.lit(seed)) < F.col("p"), 1).otherwise(0)
    decided = rest.filter(alone).select(
        "_source", F.struct("row", "size", (F.col("base") + own).cast("int").alias("copies")).alias("done")
    )
    groups = F.greatest(F.ceil(F.col("n_rest") / GROUP), F.lit(1))
    # Rows that share an id are dealt by their place in the table, too: no cell gets all of them.
    shared = keep(thin.groupBy(F.struct("row.doc_id").alias("name")).agg(F.count("*").alias("n")).filter("n > 1"), "mix-shared-ids")
    paired = rest.filter(~alone).withColumn("name", F.struct("row.doc_id")).join(shared, "name", "left")
    deal = F.when(F.col("n").isNull(), F.xxhash64("row.doc_id", F.lit(seed))).otherwise(F.xxhash64("row", F.lit(seed)))
    level = paired.select(
        "_source", "row", "size", "p", "base", F.pmod(deal, groups).alias("cell"), groups.alias("cells"),
    )
    largest = left.agg(F.coalesce(F.max("n_rest"), F.lit(0))).first()[0]
    depth, cells = 1, -(-largest // GROUP)
    while cells > 1:
        depth, cells = depth + 1, -(-cells // GROUP)
    every = settled.unionByName(decided)
    for number in range(depth):
        folded = keep(_folded(level, ["_source", "cell", "cells"], number, seed), f"mix-level{number}")
        every = every.unionByName(folded.select("_source", F.explode("state.done").alias("done")))
        level = _open(folded, "_source", "cell", "cells").withColumn("cell", F.floor(F.col("cell") / GROUP)).withColumn(
            "cells", F.ceil(F.col("cells") / GROUP)
        )
    every = every.unionByName(_last(level, seed))
    return every.join(goals.select("_source", "source_size", "target"), "_source").select(
        F.col("done.row.doc_id").alias("doc_id"), F.col("_source.source").alias("source"), F.col("done.size").alias("size"),
        "source_size", "target", F.col("done.copies").alias("copies"),
        (F.col("done.size") * F.col("done.copies")).alias("taken"),
    )
