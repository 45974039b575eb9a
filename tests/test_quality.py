"""Content quality from the lists of its seeds alone."""

import datetime as dt

from shelflight.operators import evaluate


def test_lists_of_the_seeds_are_enough(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [(f"u{u}", f"i{(u * 3 + n) % 20:02d}", 5.0 if n % 2 else 3.0, at) for u in range(6) for n in range(14)]
    test = spark.createDataFrame(rows, "user_id string, item_id string, rating double, ts timestamp")
    near = [(f"i{q:02d}", f"i{(q + p) % 20:02d}", 1 - p / 50, p) for q in range(20) for p in range(1, 13)]
    lists = spark.createDataFrame(near, "query_id string, item_id string, score double, position int")
    kinds = spark.createDataFrame([(f"i{n:02d}", str(n % 3)) for n in range(20)], "item_id string, category string")
    seeds = evaluate.quality_seeds(test)
    assert seeds.groupBy("user_id").count().filter("count > 5").count() == 0
    few = lists.join(seeds.selectExpr("item_id AS query_id").distinct(), "query_id", "left_semi").filter("position <= 10")
    assert few.count() < lists.count()
    assert evaluate.content_quality(test, few, kinds).collect() == evaluate.content_quality(test, lists, kinds).collect()
