"""A vector index that is kept: inverted lists by cell, product-quantised codes, exact re-score.

``build_index`` fits cells and code books once and writes, under one path, ``centres``, ``books`` and
``lists``, the last partitioned by cell.  ``add_vectors`` places new or changed vectors by the stored
centres, without a new fit.  A search reads the probed cells only, ranks their codes by table
lookups, and re-scores the survivors with their whole vectors, so its scores are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelflight.functions.common import first_per_group
from shelflight.operators.nearest import (
    _PAIR, _lanes, _matrix, _merge, _nearest_cells, _slot, best_of_block, recall_against, top_k, unit_items, unit_queries,
)
from shelflight.session import keep, scratch_path
from shelflight.sources.tables import write_table

FIT = 16_384  # vectors, about, that the code books are fitted on; every vector is indexed
MEASURED = 512  # stored vectors, about, that a search is measured with
LIST_ROWS = 65_536  # rows of a list that one task writes, or one block of a search holds
WIDTH = 4  # components that one code byte stands for

_PLACED = "item_id string, vec array<double>, code binary, cell int"


def _parts(matrix: np.ndarray) -> np.ndarray:
    """(rows, parts, WIDTH); the last part is filled up with zeros."""
    short = -matrix.shape[1] % WIDTH
    return np.pad(matrix, ((0, 0), (0, short))).reshape(len(matrix), -1, WIDTH)


def _nearest_code(values: np.ndarray, book: np.ndarray) -> np.ndarray:
    return np.argmin((book**2).sum(axis=1) - 2 * values @ book.T, axis=1)


def _sub_vectors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        if len(frame):
            parts = _parts(np.stack(frame.vec.to_numpy()))
            for at in range(parts.shape[1]):
                yield pd.DataFrame({"part": at, "item_id": frame.item_id, "value": list(parts[:, at])})


def _fit_book(codes: int, rounds: int = 12):
    """Lloyd's rounds over the sub-vectors of one part; a code nobody chose keeps its place."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        values = np.stack(frame.sort_values("item_id").value.to_numpy())
        distinct = np.unique(values, axis=0)
        book = distinct[np.linspace(0, len(distinct) - 1, min(codes, len(distinct))).astype(int)].copy()
        for _ in range(rounds):
            chosen = _nearest_code(values, book)
            n = np.bincount(chosen, minlength=len(book))
            sums = np.zeros_like(book)
            np.add.at(sums, chosen, values)
            book[n > 0] = sums[n > 0] / n[n > 0, None]
        return pd.DataFrame({"part": int(frame.part.iloc[0]), "code": range(len(book)), "value": list(book)})

    return run


def _model(spark: SparkSession, path: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """Centres and code books; their size depends on the parameters of the fit, not on the table."""
    centres = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()
    books: dict[int, list[list[float]]] = {}
    for row in spark.read.parquet(f"{path}/books").orderBy("part", "code").collect():
        books.setdefault(row.part, []).append(row.value)
    return np.array([r.centre for r in centres]), [np.array(books[p]) for p in sorted(books)]


def _place(units: DataFrame, centres: np.ndarray, books: Sequence[np.ndarray]) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                matrix = np.stack(frame.vec.to_numpy())
                parts = _parts(matrix)
                codes = np.stack([_nearest_code(parts[:, p], b) for p, b in enumerate(books)], axis=1).astype(np.uint8)
                yield frame.assign(code=[c.tobytes() for c in codes], cell=_nearest_code(matrix, centres).astype(np.int32))

    return units.mapInPandas(run, _PLACED)


def _split(lists: DataFrame) -> DataFrame:
    """Number the pieces of about ``LIST_ROWS`` rows a list is worked on in, so a crowded cell is many tasks."""
    sizes = lists.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(LIST_ROWS)).alias("_parts"))
    return lists.join(sizes, "cell").withColumn("_part", _slot(F.col("item_id"), F.col("_parts")))


def _write(lists: DataFrame, path: str) -> None:
    (_split(lists).repartition("cell", "_part").drop("_part", "_parts").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("cell").parquet(f"{path}/lists"))


def stored(spark: SparkSession, path: str) -> DataFrame:
    """(item_id, vec, code, cell) of all indexed vectors."""
    return spark.read.schema(_PLACED).parquet(f"{path}/lists").filter(F.col("item_id").isNotNull())


def build_index(vectors: DataFrame, path: str, cells: int = 16, codes: int = 64, seed: int = 42) -> None:
    """Fit and write an index of (item_id, embedding); a vector without direction is left out.

    Centres are fitted on all vectors by Spark, code books on about ``FIT`` of them, chosen by a hash
    of the id, one task per part of the vector.
    """
    if not 1 <= codes <= 256:
        raise ValueError("a code is one byte")
    units = keep(unit_items(vectors), "units")
    model = KMeans(k=cells, seed=seed, maxIter=10, featuresCol="features").fit(
        units.withColumn("features", array_to_vector("vec"))
    )
    centres = np.array(model.clusterCenters(), dtype=np.float64)
    spark = units.sparkSession
    rows = [(i, c.tolist()) for i, c in enumerate(centres)]
    write_table(spark.createDataFrame(rows, "cell int, centre array<double>"), f"{path}/centres")
    share = FIT / max(1, units.count())
    chosen = units.filter(_slot(F.col("item_id"), 1 << 30) < share * (1 << 30))
    sub = chosen.mapInPandas(_sub_vectors, "part int, item_id string, value array<double>")
    books = sub.groupBy("part").applyInPandas(_fit_book(codes), "part int, code int, value array<double>")
    write_table(books, f"{path}/books")
    _write(_place(units, *_model(spark, path)), path)


def add_vectors(incoming: DataFrame, path: str, arrival: Sequence[Column] = ()) -> None:
    """Insert or replace vectors; of a key sent twice the first by ``arrival`` stays.

    An item that changes cells leaves its former list, and one sent without direction leaves the index.
    Only lists that lose or gain rows are written anew, from a staged copy; the swap goes list by list,
    and the same batch given again after a lost job brings the index to the same state.  A list left
    empty keeps one row without id, since a partition without rows would not be overwritten.
    """
    spark = incoming.sparkSession
    last = keep(first_per_group(incoming.filter(F.col("item_id").isNotNull()), ["item_id"],
                                [*arrival, F.asc("embedding")]), "batch")
    placed = keep(_place(unit_items(last), *_model(spark, path)), "placed")
    own = stored(spark, path)
    ids = last.select("item_id")
    left = own.select("item_id", "cell").join(ids, "item_id", "left_semi").select("cell")
    # At most one row per cell of the index.
    touched = [r.cell for r in left.unionByName(placed.select("cell")).distinct().collect()]
    if not touched:
        return
    kept = own.filter(F.col("cell").isin(touched)).join(ids, "item_id", "left_anti")
    empty = spark.createDataFrame([(None, None, None, c) for c in touched], _PLACED)
    staged = scratch_path(spark, "lists")
    kept.unionByName(placed).unionByName(empty).write.parquet(staged)
    _write(spark.read.parquet(staged), path)


def _look_up(books: Sequence[np.ndarray], k: int, survivors: int):
    """The k best items of each query in its block: by codes, then by the whole vectors of the survivors.

    Rows come by block, the items before the queries, each by id.  One block is held; queries pass by.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, block = None, [], None
        for batch in batches:
            cells, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            cuts = [0, *(np.flatnonzero((np.diff(cells) != 0) | (asks[1:] != asks[:-1])) + 1).tolist(), len(cells)]
            for begin, end in zip(cuts, cuts[1:]):
                if begin == end:
                    continue
                if cells[begin] != cell:
                    cell, held, block = cells[begin], [], None
                ids, matrix = batch.column(2).slice(begin, end - begin), _matrix(batch.column(3).slice(begin, end - begin))
                if not asks[begin]:
                    codes = b"".join(batch.column(4).slice(begin, end - begin).to_pylist())
                    held.append((ids, matrix, np.frombuffer(codes, dtype=np.uint8).reshape(len(ids), -1)))
                    continue
                if block is None:
                    if not held:
                        continue
                    names, vectors, codes = zip(*held, strict=True)
                    block, held = (pa.concat_arrays(names), np.concatenate(vectors), np.concatenate(codes)), []
                names, vectors, codes = block
                # A few queries at a time: what is held is their scores over the block and their survivors.
                step = max(1, (1 << 21) // max(len(names), min(survivors, len(names)) * vectors.shape[1]))
                for start in range(0, len(matrix), step):
                    asked = matrix[start:start + step]
                    parts = _parts(asked)
                    scores = sum((parts[:, p] @ book.T)[:, codes[:, p]] for p, book in enumerate(books))
                    near = np.sort(best_of_block(scores, survivors), axis=1)
                    exact = np.einsum("qd,qsd->qs", asked, vectors[near])
                    best = best_of_block(np.round(exact, 9), k)
                    found = np.take_along_axis(near, best, axis=1).ravel()
                    yield pa.RecordBatch.from_arrays([
                        ids.slice(start, step).take(pa.array(np.repeat(np.arange(len(asked)), best.shape[1]))),
                        names.take(pa.array(found)), pa.array(np.take_along_axis(exact, best, axis=1).ravel()),
                    ], ["query_id", "item_id", "score"])

    return run


def search_index(
    queries: DataFrame, path: str, k: int, key: str = "item_id", probes: int = 10, refine: int = 8,
) -> DataFrame:
    """Cosine top-k (query_id, item_id, score, position) over the ``probes`` nearest cells of each query.

    In every block ``refine * k`` survivors of a query are re-scored exactly, where their vectors lie, so k rows a
    query and block leave the task and no vector travels with a pair.  A block is copied to a few lanes where blocks
    are fewer than tasks.
    """
    spark = queries.sparkSession
    centres, books = _model(spark, path)
    asked = keep(unit_queries(queries, key), "queries")
    probed = asked.mapInPandas(
        _nearest_cells(centres, probes), "query_id string, vec array<double>, _near array<int>"
    ).select("query_id", "vec", F.explode("_near").alias("cell"))
    visited = [r.cell for r in probed.select("cell").distinct().collect()]
    lists = stored(spark, path).filter(F.col("cell").isin(visited))
    sizes = lists.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(LIST_ROWS)).alias("_parts"))
    blocks = max(1, sizes.agg(F.sum("_parts")).first()[0] or 0)
    lanes = max(1, min(math.ceil(_lanes(asked) / blocks), math.ceil(asked.count() / 1024)))

    def each(n: Column) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1))

    def block(lane: Column) -> Column:
        return (F.shiftleft(F.shiftleft(F.col("cell").cast("bigint"), 20) + F.col("_part"), 20) + lane).alias("_cell")

    def rows(side: DataFrame, asks: bool, name: str, lane: Column, code: Column) -> DataFrame:
        return side.withColumn("_lane", lane).select(
            block(F.col("_lane")), F.lit(asks).alias("asks"), F.col(name).alias("id"), "vec", code.alias("code")
        )

    items = lists.join(sizes, "cell").withColumn("_part", _slot(F.col("item_id"), F.col("_parts")))
    spread = probed.join(sizes, "cell").withColumn("_part", each(F.col("_parts")))
    placed = rows(items, False, "item_id", each(F.lit(lanes)), F.col("code")).unionByName(
        rows(spread, True, "query_id", _slot(F.col("query_id"), lanes), F.lit(None).cast("binary"))
    ).repartition(4 * blocks * lanes, "_cell").sortWithinPartitions("_cell", "asks", "id")
    return _merge(placed.mapInArrow(_look_up(books, k, refine * k), _PAIR), k)


def measured_search(
    spark: SparkSession, path: str, k: int, target: float = 0.95, probes: int = 10, refine: int = 8, measured: int = MEASURED,
) -> tuple[int, int]:
    """(probes, refine) whose recall at ``k`` against brute force reaches ``target`` on the index as it is.

    About ``measured`` stored vectors, chosen by a hash of the id, are the queries; all stored vectors are
    searched.  Cells are added and survivors doubled until the target is met, at the latest where every
    cell is visited and every vector re-scored, which is the exact search.
    """
    rows = stored(spark, path).select("item_id", "vec")
    n, cells = rows.count(), len(_model(spark, path)[0])
    asked = keep(
        rows.filter(_slot(F.col("item_id"), 1 << 30) < measured / max(1, n) * (1 << 30))
        .select(F.col("item_id").alias("query_id"), "vec", F.col("vec").alias("embedding")), "measured",
    )
    exact = keep(top_k(asked.select("query_id", "vec"), rows, k), "exact")
    probes = min(probes, cells)
    while probes < cells or refine * k < n:
        found = search_index(asked, path, k, "query_id", probes, refine)
        recall = recall_against(exact, found).first().recall
        if recall is None or recall >= target:
            break
        probes, refine = min(cells, probes + math.ceil(cells / 6)), 2 * refine
    return probes, refine
