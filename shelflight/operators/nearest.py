"""Top-k by inner product or cosine, without emitting all pairs.

Items are dealt to groups of bounded size, queries to lanes, about as many as there are cores.  A
task holds the items of one group and lets the queries of one lane pass by, so a query is shipped
once per group, an item once per lane, and what is shuffled afterwards is k rows per query and
group; with one group nothing is.  Approximate search sends a query only to the groups of the
cells nearest to it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelflight.functions.common import clip01, top_per_group
from shelflight.functions.vectors import dot, norm, unit
from shelflight.session import keep

GROUP_BYTES = 128 << 20  # of doubles, in a group of items
TILE, QUERIES = 8192, 256  # items and queries multiplied at once
EQUAL = 4  # times fewer pairs of distinct vectors than of rows: then equal ones are searched once
RESERVE = 100  # items a list of a distinct vector is longer, where some may be hidden

_PAIR = "query_id string, item_id string, score double"
_PLACED_PAIR = f"{_PAIR}, position int"
_FOUND = ["query_id", "item_id", "score", "position"]


def best_of_block(scores: np.ndarray, k: int) -> np.ndarray:
    """Column indices of the k best scores per row, smaller index first among equals."""
    k = min(k, scores.shape[1])
    chosen = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    lowest = np.take_along_axis(scores, chosen, axis=1).min(axis=1)
    # argpartition picks freely among scores equal to the k-th; those rows are sorted whole.
    tied = np.nonzero((scores >= lowest[:, None]).sum(axis=1) > k)[0]
    for row in tied:
        chosen[row] = np.argsort(-scores[row], kind="stable")[:k]
    return chosen


class _Items:
    """The items of a cell in the order of their ids, as tiles of a few thousand."""

    def __init__(self) -> None:
        self.ids: list[pa.Array] = []
        self.tiles: list[np.ndarray] = []
        self.waiting: list[np.ndarray] = []
        self.joined: pa.Array | None = None

    def add(self, ids: pa.Array, matrix: np.ndarray) -> None:
        self.ids.append(ids)
        self.waiting.append(matrix)
        if sum(map(len, self.waiting)) >= TILE // 2:
            self._close()

    def _close(self) -> None:
        if self.waiting:
            whole = self.waiting[0] if len(self.waiting) == 1 else np.concatenate(self.waiting)
            self.tiles.extend(whole[at:at + TILE] for at in range(0, len(whole), TILE))
            self.waiting = []

    def ready(self) -> None:
        if self.joined is None:
            self._close()
            self.joined = pa.concat_arrays(self.ids) if self.ids else pa.array([], pa.string())
            self.ids = []

    def hidden(self, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """(place, row) of the items named in the lists, by place."""
        row = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        names, numbers = np.unique(lists.flatten().to_numpy(zero_copy_only=False).astype(object), return_inverse=True)
        known = pc.index_in(pa.array(names, pa.string()), self.joined).fill_null(-1).to_numpy(zero_copy_only=False)
        place = known[numbers] if len(names) else np.zeros(0, np.int64)
        row, place = row[place >= 0], place[place >= 0]
        order = np.argsort(place, kind="stable")
        return place[order], row[order]

    def best(self, queries: np.ndarray, k: int, lists: pa.ListArray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, place, score) of the k best items per query, best first.

        The order of summation differs between machines; without its noise equal scores are equal.
        Only the order goes by rounded scores; the scores themselves are passed on whole.  Tiles come
        in the order of ids, so what only equals the k-th of a full list stays out.
        """
        place_of, row_of = (np.zeros(0, np.int64),) * 2 if lists is None else self.hidden(lists)
        low = np.full(len(queries), -np.inf)
        row, place, score, key = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
        found: list[tuple[np.ndarray, ...]] = []
        start = n = 0
        for tile in self.tiles:
            raw = queries @ tile.T
            gone = slice(*np.searchsorted(place_of, [start, start + len(tile)]))
            raw[row_of[gone], place_of[gone] - start] = -np.inf
            many = np.isneginf(low).any()
            if not many:
                hit, at = np.divmod(np.flatnonzero(raw > (low - 1e-9)[:, None]), len(tile))
                many = len(hit) > 4 * k * len(queries)
            if many:
                rounded = np.where(np.isfinite(raw), np.round(raw, 9), -np.inf)
                at = best_of_block(rounded, k)
                hit, at = np.repeat(np.arange(len(queries)), at.shape[1]), at.ravel()
            value = raw[hit, at]
            rounded = np.round(value, 9)
            better = np.isfinite(value) & (rounded > low[hit])
            found.append((hit[better], at[better] + start, value[better], rounded[better]))
            n += int(better.sum())
            start += len(tile)
            if many or n > k * len(queries) or start == len(self.joined):
                row, place, score, key = (
                    np.concatenate([a, *b]) for a, b in zip((row, place, score, key), zip(*found, strict=True), strict=True)
                )
                order = np.lexsort((place, -key, row))
                first = np.searchsorted(row[order], np.arange(len(queries) + 1))
                order = order[np.arange(len(order)) - first[row[order]] < k]
                row, place, score, key = row[order], place[order], score[order], key[order]
                last = np.searchsorted(row, np.arange(len(queries)), "right")
                full = np.diff(np.searchsorted(row, np.arange(len(queries) + 1))) == k
                low[full] = key[last[full] - 1]
                found, n = [], 0
        return row, place, score


def _matrix(vectors: pa.ListArray) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def _walk(k: int, threshold: float | None):
    """The k best items of each query among those of its cell.

    Rows come by cell, the items before the queries, each by id.  The items of one cell are held;
    queries pass by a few at a time.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, items = None, _Items()
        for batch in batches:
            cells = batch.column(0).to_numpy(zero_copy_only=False)
            asks = batch.column(1).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((np.diff(cells) != 0) | (asks[1:] != asks[:-1])) + 1).tolist(), len(cells)]
            for begin, end in zip(cuts, cuts[1:]):
                if begin == end:
                    continue
                if cells[begin] != cell:
                    cell, items = cells[begin], _Items()
                ids, vectors, hidden = (batch.column(c).slice(begin, end - begin) for c in (2, 3, 4))
                if not asks[begin]:
                    items.add(ids, _matrix(vectors))
                    continue
                items.ready()
                for at in range(0, len(ids), QUERIES if items.tiles else len(ids)):
                    lists = hidden.slice(at, QUERIES)
                    if items.tiles:
                        row, place, score = items.best(
                            _matrix(vectors.slice(at, QUERIES)), k, None if lists.null_count == len(lists) else lists
                        )
                        position = np.arange(len(row)) - np.searchsorted(row, row) + 1
                        kept = slice(None) if threshold is None else score >= threshold
                        yield pa.RecordBatch.from_arrays(
                            [ids.slice(at, QUERIES).take(pa.array(row[kept])), items.joined.take(pa.array(place[kept])),
                             pa.array(score[kept]), pa.array(position[kept], pa.int32())],
                            ["query_id", "item_id", "score", "position"],
                        )

    return run


def _group_rows(vectors: DataFrame) -> int:
    """How many vectors of this table fill a group of ``GROUP_BYTES``."""
    first = vectors.select(F.size("vec")).first()
    return max(1, GROUP_BYTES // (8 * max(1, first[0] if first else 1)))


def _lanes(frame: DataFrame) -> int:
    """Lanes that keep all cores busy; every item is shipped once per lane."""
    return 2 * frame.sparkSession.sparkContext.defaultParallelism


def _slot(key: Column, slots: Column | int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(slots) if isinstance(slots, int) else slots)


_NOTHING = "array<string>"


def _merge(pairs: DataFrame, k: int) -> DataFrame:
    return top_per_group(pairs, ["query_id"], [F.desc(F.round("score", 9)), F.asc("item_id")], k, "position")


def _walked(queries: DataFrame, items: DataFrame, cells: int, k: int, threshold: float | None) -> DataFrame:
    """The k best items of every query in each of its cells: both sides name their ``_cell``.

    The number of partitions is given outright, because AQE would merge these small but costly
    partitions by their size; there are more than cells, so few cells share one.
    """
    rows = items.select(
        "_cell", F.lit(False).alias("asks"), F.col("item_id").alias("id"), "vec", F.lit(None).cast(_NOTHING).alias("hidden")
    ).unionByName(queries.select("_cell", F.lit(True).alias("asks"), F.col("query_id").alias("id"), "vec", "hidden"))
    placed = rows.repartition(4 * cells, "_cell").sortWithinPartitions("_cell", "asks", "id")
    return placed.mapInArrow(_walk(k, threshold), _PLACED_PAIR)


def top_k(
    queries: DataFrame, items: DataFrame, k: int, threshold: float | None = None, block: int | None = None,
    hidden: DataFrame | None = None,
) -> DataFrame:
    """Exact top-k by inner product: (query_id, vec) against (item_id, vec).

    ``hidden`` (query_id, item_id) names pairs that must not be found.  Where many vectors are equal, a vector
    is searched once for all queries and items that have it.  ``block`` sets the size of a group.
    """
    queries, items = keep(queries, "queries"), keep(items, "items")
    kinds = F.approx_count_distinct(F.xxhash64("vec"))
    n_items, item_kinds = items.agg(F.count("*"), kinds).first()
    n_queries, query_kinds, n_ids = queries.agg(F.count("*"), kinds, F.count_distinct("query_id")).first()
    if n_queries == n_ids and EQUAL * item_kinds * query_kinds < n_items * n_queries:
        return _top_k_of_equals(queries, items, k, threshold, block, hidden)
    return _searched(queries, items, k, threshold, block, hidden, n_items, n_queries, n_queries == n_ids)


def _top_k_of_equals(
    queries: DataFrame, items: DataFrame, k: int, threshold: float | None, block: int | None, hidden: DataFrame | None
) -> DataFrame:
    """``top_k`` by one query and one item for each distinct vector.

    An item is named by the smallest id with its vector.  As any list of k names holds the k best items,
    those are found among the names' own ids, k of each at most.  With ``hidden`` lists are longer by
    ``RESERVE``; the few queries that lose more of theirs than that are searched on their own.
    """
    fetch = k if hidden is None else k + RESERVE
    ids = top_per_group(items, ["vec"], [F.asc("item_id")], fetch)
    goods = keep(ids.groupBy("vec").agg(F.min("item_id").alias("_name"), F.array_sort(F.collect_list("item_id")).alias("_ids")), "names")
    asked = keep(queries.groupBy("vec").agg(F.min("query_id").alias("_asker")), "askers")
    found = _searched(
        asked.select(F.col("_asker").alias("query_id"), "vec"), goods.select(F.col("_name").alias("item_id"), "vec"),
        fetch, threshold, block, None, goods.count(), asked.count(), True,
    ).select(F.col("query_id").alias("_asker"), F.col("item_id").alias("_name"), "score", F.round("score", 9).alias("_key"))
    # A name counts unless names of better scores have enough items; names of equal scores mix their ids.
    w = Window.partitionBy("_asker").orderBy(F.desc("_key"))
    better = F.sum("_n").over(w) - F.sum("_n").over(Window.partitionBy("_asker", "_key"))
    needed = found.join(goods.select("_name", F.size("_ids").alias("_n")), "_name").withColumn("_better", better).filter(
        F.col("_better") < fetch
    )
    lists = keep(top_per_group(
        needed.select("_asker", "_name", "score", "_key").join(goods.select("_name", "_ids"), "_name")
        .select("_asker", F.explode("_ids").alias("item_id"), "score", "_key"),
        ["_asker"], [F.desc("_key"), F.asc("item_id")], fetch, "position",
    ).drop("_key"), "lists")
    packed = lists.groupBy("_asker").agg(F.array_sort(F.collect_list(F.struct("position", "item_id", "score"))).alias("_list"))
    askers = queries.join(asked, "vec").select("query_id", "_asker")
    if hidden is None:
        return askers.join(packed, "_asker").select("query_id", F.inline("_list")).select(*_FOUND)
    askers = keep(askers, "askers")
    # Of what a query must not find, only what its list holds is gathered.
    gone = hidden.join(askers, "query_id").join(lists.select("_asker", "item_id"), ["_asker", "item_id"], "left_semi").groupBy(
        "query_id").agg(F.collect_set("item_id").alias("_gone"))
    left = askers.join(packed, "_asker").join(gone, "query_id", "left").select(
        "query_id", (F.size("_list") == fetch).alias("_full"),
        F.filter("_list", lambda e: ~F.coalesce(F.array_contains("_gone", e["item_id"]), F.lit(False))).alias("_list"),
    )
    left = keep(left.select("query_id", (F.col("_full") & (F.size("_list") < k)).alias("_short"), F.slice("_list", 1, k).alias("_list")), "left")
    place = left.filter(~F.col("_short")).select("query_id", F.posexplode("_list").alias("_at", "_row")).select(
        "query_id", "_row.item_id", "_row.score", (F.col("_at") + 1).alias("position")
    )
    short = left.filter("_short").select("query_id")
    n_short = short.count()
    if n_short == 0:
        return place
    again = _searched(
        keep(queries.join(short, "query_id", "left_semi"), "short"), items, k, threshold, block,
        hidden.join(short, "query_id", "left_semi"), items.count(), n_short, True,
    )
    return place.unionByName(again.select(*_FOUND))


def _searched(
    queries: DataFrame, items: DataFrame, k: int, threshold: float | None, block: int | None, hidden: DataFrame | None,
    n_items: int, n_queries: int, unique: bool,
) -> DataFrame:
    """``top_k`` of stored frames by comparing all their rows.

    Hidden pairs travel with the query, each to the group of its item; the counts decide how many groups and
    lanes there are.  Without groups, and where a query comes once (``unique``), nothing is merged.
    """
    tasks = _lanes(items)
    lanes = max(1, min(tasks, math.ceil(n_queries / QUERIES)))
    groups = max(
        1, math.ceil(n_items / (block or _group_rows(items))), min(math.ceil(tasks / lanes), math.ceil(n_items / TILE))
    )

    def cell(group: Column, lane: Column) -> Column:
        return (group * lanes + lane).alias("_cell")

    def each(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))

    copies = items.withColumn("_lane", each(lanes)).select(
        "item_id", "vec", cell(_slot(F.col("item_id"), groups), F.col("_lane"))
    )
    dealt = queries.withColumn("_group", each(groups))
    if hidden is None:
        dealt = dealt.withColumn("hidden", F.lit(None).cast(_NOTHING))
    else:
        by_group = hidden.withColumn("_group", _slot(F.col("item_id"), groups)).groupBy("query_id", "_group").agg(
            F.collect_set("item_id").alias("hidden")
        )
        dealt = dealt.join(by_group, ["query_id", "_group"], "left")
    asked = dealt.select("query_id", "vec", "hidden", cell(F.col("_group"), _slot(F.col("query_id"), lanes)))
    found = _walked(asked, copies, groups * lanes, k, threshold)
    return found if groups == 1 and unique else _merge(found.drop("position"), k)


def unit_queries(vectors: DataFrame, key: str) -> DataFrame:
    """(query_id, vec) of unit vectors; zero vectors have no direction and are left out."""
    return vectors.select(F.col(key).cast("string").alias("query_id"), unit(F.col("embedding")).alias("vec")).filter(
        F.col("vec").isNotNull()
    )


def unit_items(vectors: DataFrame) -> DataFrame:
    return vectors.select("item_id", unit(F.col("embedding")).alias("vec")).filter(F.col("vec").isNotNull())


def similar_items(
    queries: DataFrame, vectors: DataFrame, k: int, key: str = "item_id", threshold: float | None = None
) -> DataFrame:
    """Exact cosine top-k.  A query that is itself an item finds itself unless excluded."""
    return top_k(unit_queries(queries, key), unit_items(vectors), k, threshold)


def without_excluded(neighbours: DataFrame, excluded: DataFrame, k: int) -> DataFrame:
    """Drop excluded (query_id, item_id) pairs and cut to k.

    ``neighbours`` must have been fetched with k plus the most exclusions of any query, else a
    list may come out short; ``top_k(hidden=...)`` needs no such reserve.
    """
    left = neighbours.drop("position").join(excluded, ["query_id", "item_id"], "left_anti")
    return _merge(left, k)


def _nearest_cells(centres: np.ndarray, probes: int):
    """Add the ``probes`` cells nearest to each vector; the centres are a table of fixed size."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                vectors = np.stack(frame.vec.to_numpy())
                distance = (centres**2).sum(axis=1) - 2 * vectors @ centres.T
                near = np.argsort(np.round(distance, 12), axis=1, kind="stable")[:, :probes]
                yield frame.assign(_near=list(near.astype(np.int32)))

    return run


def approximate_similar_items(
    queries: DataFrame, vectors: DataFrame, k: int, cells: int = 16, probes: int = 4,
    key: str = "item_id", block: int | None = None, seed: int = 42,
) -> DataFrame:
    """Cosine top-k over the ``probes`` cells nearest to each query.

    Cells come from k-means over the unit vectors.  A cell of any size is split into groups
    of bounded size, and its queries into lanes by their number, so a crowded cell is many tasks.
    """
    units = keep(unit_items(vectors), "units").withColumn("features", array_to_vector("vec"))
    asked = keep(unit_queries(queries, key), "queries")
    model = KMeans(k=cells, seed=seed, maxIter=10, featuresCol="features", predictionCol="_near").fit(units)
    centres = np.array(model.clusterCenters(), dtype=np.float64)
    placed = model.transform(units).select("item_id", "vec", "_near")
    probed = asked.mapInPandas(
        _nearest_cells(centres, probes), "query_id string, vec array<double>, _near array<int>"
    ).select("query_id", "vec", F.explode("_near").alias("_near"))
    tasks = _lanes(units)
    sizes = placed.groupBy("_near").agg(F.ceil(F.count("*") / F.lit(block or _group_rows(units))).alias("_groups"))
    share = F.lit(tasks / max(1, probes * asked.count()))
    loads = probed.groupBy("_near").agg(F.ceil(F.count("*") * share).alias("_lanes"))
    deal = sizes.join(loads, "_near")

    def each(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))

    def cell(group: Column, lane: Column) -> Column:
        return F.shiftleft(F.shiftleft(F.col("_near").cast("bigint"), 20) + group, 20) + lane

    copies = placed.join(deal, "_near").withColumn("_lane", each("_lanes")).withColumn(
        "_cell", cell(_slot(F.col("item_id"), F.col("_groups")), F.col("_lane"))
    )
    spread = probed.join(deal, "_near").withColumn("_group", each("_groups")).withColumn(
        "_cell", cell(F.col("_group"), _slot(F.col("query_id"), F.col("_lanes")))
    ).withColumn("hidden", F.lit(None).cast(_NOTHING))
    return _merge(_walked(spread, copies, tasks + cells, k, None).drop("position"), k)


def recall_against(exact: DataFrame, approximate: DataFrame) -> DataFrame:
    """Share of the exact neighbours the approximate search found."""
    found = exact.join(approximate.select("query_id", "item_id", F.lit(1).alias("hit")), ["query_id", "item_id"], "left")
    return found.agg(F.count("*").alias("pairs"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


def self_nearest(neighbours: DataFrame) -> DataFrame:
    """How many queries found themselves first."""
    return neighbours.filter(F.col("position") == 1).agg(
        F.count("*").alias("items"),
        F.count_if(F.col("query_id") == F.col("item_id")).alias("self_first"),
    )


def content_scores(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Cosine of (reference_id, item_id) pairs clipped to [0, 1]; a missing vector scores 0.

    Each distinct pair of items meets its two vectors once; what is joined back to the rows is
    one number, so no row of a user carries a vector.
    """
    units = keep(unit_items(vectors), "units")
    refs = units.select(F.col("item_id").alias("reference_id"), F.col("vec").alias("_ref"))
    own = units.select("item_id", F.col("vec").alias("_own"))
    distinct = pairs.select("reference_id", "item_id").distinct()
    scored = distinct.join(refs, "reference_id").join(own, "item_id").select(
        "reference_id", "item_id", clip01(dot(F.col("_ref"), F.col("_own"))).alias("score")
    )
    rows = pairs.join(keep(scored, "pair-scores"), ["reference_id", "item_id"], "left")
    return rows.withColumn("score", F.coalesce("score", F.lit(0.0)))


def weighted_content_scores(candidates: DataFrame, references: DataFrame, vectors: DataFrame) -> DataFrame:
    """Weighted mean of clipped cosines of a user's candidates to the user's references, at most 1.

    ``references`` has (user_id, reference_id, weight), a few per user; a null weight means equal shares.
    Weights are divided by their sum; a sum that is not positive makes them equal.  A user's
    references travel with their vectors as one row, so a candidate is shipped once by item and once
    by user, and no pairs are.  Items without a vector score 0; candidates of a user without
    references give no row.  Terms are added as decimals, so the score does not depend on the order
    of rows, and it has twelve digits.
    """
    totals = references.groupBy("user_id").agg(F.sum("weight").alias("_sum"), F.count("*").alias("_n"))
    share = F.when(F.col("_sum") > 0, F.coalesce("weight", F.lit(0.0)) / F.col("_sum")).otherwise(1 / F.col("_n"))
    weighted = references.join(totals, "user_id").select("user_id", "reference_id", share.alias("_w"))
    known = keep(
        vectors.select("item_id", F.col("embedding").alias("_vec"), norm(F.col("embedding")).alias("_norm"))
        .filter(F.col("_norm") > 0), "lengths",
    )
    own = weighted.join(known.withColumnRenamed("item_id", "reference_id"), "reference_id", "left").groupBy("user_id").agg(
        F.collect_list(F.when(F.col("_norm").isNotNull(), F.struct("_w", F.col("_vec").alias("_ref"), F.col("_norm").alias("_size"))))
        .alias("_refs")
    )

    def term(r: Column) -> Column:
        cosine = clip01(dot(r["_ref"], F.col("_vec")) / (r["_size"] * F.col("_norm")))
        return F.coalesce((r["_w"] * cosine).cast("decimal(28,20)"), F.lit(0).cast("decimal(28,20)"))

    zero = F.lit(0).cast("decimal(38,20)")
    total = F.aggregate("_refs", zero, lambda acc, r: (acc + term(r)).cast("decimal(38,20)"))
    score = F.when(F.col("_norm").isNotNull(), F.least(F.lit(1.0), F.round(total, 12).cast("double"))).otherwise(F.lit(0.0))
    return candidates.select("user_id", "item_id").join(known, "item_id", "left").join(own, "user_id").select(
        "user_id", "item_id", score.alias("content_score")
    )


def vectors_by_id(ids: DataFrame, vectors: DataFrame) -> DataFrame:
    """Vectors of requested items; unknown ids are absent."""
    return vectors.join(ids.select("item_id").distinct(), "item_id", "left_semi")


def encode_texts(texts: DataFrame, encoder=None, dimensions: int = 256) -> DataFrame:
    """Unit text embeddings (item_id, embedding) of an (item_id, embedding_text) frame.

    ``encoder`` maps a list of texts to a float matrix and runs on batches inside the tasks,
    e.g. a sentence model loaded once per worker.  Without one, hashed TF-IDF is used.
    """
    # Texts cost far more to make than to store: a filter on them, the fit and the transformation would each make them.
    visible = keep(texts.select("item_id", "embedding_text"), "texts").filter(F.trim("embedding_text") != "")
    if encoder is not None:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for start in range(0, len(frame), 48):
                    part = frame.iloc[start:start + 48]
                    matrix = np.asarray(encoder(part.embedding_text.tolist()), dtype=np.float64)
                    length = np.linalg.norm(matrix, axis=1, keepdims=True)
                    matrix = np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)
                    yield pd.DataFrame({"item_id": part.item_id.values, "embedding": list(matrix.astype(np.float32))})

        return visible.select("item_id", "embedding_text").mapInPandas(run, "item_id string, embedding array<float>")
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer

    stages = [
        RegexTokenizer(inputCol="embedding_text", outputCol="_tokens", pattern=r"[^\p{L}\p{N}]+"),
        HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=dimensions),
        IDF(inputCol="_tf", outputCol="_idf"),
        Normalizer(inputCol="_idf", outputCol="_unit", p=2.0),
    ]
    return Pipeline(stages=stages).fit(visible).transform(visible).select(
        "item_id", vector_to_array("_unit", "float32").alias("embedding")
    )
