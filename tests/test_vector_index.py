"""The stored vector index: recall, additions, moves between lists, removals."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelflight.operators import nearest, vector_index
from shelflight.session import scratch_path

SCHEMA = "item_id string, embedding array<double>"


def frame(spark, matrix, prefix="v"):
    return spark.createDataFrame([(f"{prefix}{i:04d}", row.tolist()) for i, row in enumerate(matrix)], SCHEMA)


@pytest.fixture(scope="module")
def indexed(spark):
    rng = np.random.default_rng(7)
    vectors = frame(spark, rng.normal(size=(300, 10)))  # 10 is no multiple of a code's width
    path = scratch_path(spark, "index")
    vector_index.build_index(vectors, path, cells=6, codes=32)
    return vectors, path


def test_recall_and_exact_scores(spark, indexed):
    vectors, path = indexed
    exact = nearest.similar_items(vectors, vectors, 10)
    found = vector_index.search_index(vectors, path, 10, probes=5)
    assert nearest.recall_against(exact, found).first().recall >= 0.9
    both = found.join(exact.select("query_id", "item_id", F.col("score").alias("true")), ["query_id", "item_id"])
    assert both.filter(F.abs(F.col("score") - F.col("true")) > 1e-9).count() == 0


def test_added_changed_and_withdrawn_vectors(spark, indexed):
    vectors, path = indexed
    before = vector_index.stored(spark, path).count()
    whole = vector_index.stored(spark, path).filter("item_id = 'v0001'").first()
    opposite = [-x for x in whole.vec]
    batch = spark.createDataFrame(
        [("new", whole.vec), ("v0001", opposite), ("v0002", [0.0] * 10), (None, opposite), ("v0003", None)], SCHEMA
    )
    for _ in range(2):  # the same batch given again changes nothing
        vector_index.add_vectors(batch, path)
        rows = {r.item_id: r for r in vector_index.stored(spark, path).collect()}
        assert len(rows) == before - 1 == vector_index.stored(spark, path).count()
        assert rows["v0001"].cell != whole.cell and "v0002" not in rows and "v0003" not in rows
    asked = spark.createDataFrame([("q", whole.vec)], SCHEMA)
    assert vector_index.search_index(asked, path, 3, probes=2).filter("position = 1").first().item_id == "new"


def test_a_list_that_loses_all_its_rows(spark):
    vectors = frame(spark, np.array([[1.0, 0, 0, 0]] * 3 + [[0, 1.0, 0, 0]] * 3))
    path = scratch_path(spark, "index")
    vector_index.build_index(vectors, path, cells=2)
    vector_index.add_vectors(vectors.withColumn("embedding", F.array(*[F.lit(x) for x in (0.0, 1.0, 0.0, 0.0)])), path)
    stored = vector_index.stored(spark, path)
    assert stored.count() == 6 and stored.select("cell").distinct().count() == 1
    found = vector_index.search_index(vectors.limit(1), path, 10, probes=2)
    assert [r.item_id for r in found.orderBy("position").collect()] == [f"v{i:04d}" for i in range(6)]


def test_search_is_widened_until_it_reaches_its_recall(spark):
    vectors = frame(spark, np.random.default_rng(3).normal(size=(400, 16)))  # no clusters
    path = scratch_path(spark, "index")
    vector_index.build_index(vectors, path, cells=4, codes=16)
    exact = nearest.similar_items(vectors, vectors, 10)
    plain = vector_index.search_index(vectors, path, 10, probes=2, refine=1)
    assert nearest.recall_against(exact, plain).first().recall < 0.9
    probes, refine = vector_index.measured_search(spark, path, 10, probes=2, refine=1)
    found = vector_index.search_index(vectors, path, 10, probes=probes, refine=refine)
    assert nearest.recall_against(exact, found).first().recall >= 0.9


def test_no_vector_travels_with_a_pair(spark):
    rng = np.random.default_rng(9)
    rows = [(str(i), rng.normal(size=8).tolist()) for i in range(300)]
    vectors = spark.createDataFrame(rows, "item_id string, embedding array<double>")
    path = scratch_path(spark, "index")
    vector_index.build_index(vectors, path, cells=4, codes=16)
    found = vector_index.search_index(vectors, path, 5, probes=4, refine=60)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and not any(f"Join [{key}" in plan for key in ("item_id", "query_id"))
    want = {(r.query_id, r.position): r.item_id for r in nearest.similar_items(vectors, vectors, 5).collect()}
    assert {(r.query_id, r.position): r.item_id for r in found.collect()} == want
