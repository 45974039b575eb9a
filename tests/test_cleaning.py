"""Edge rows of ingest, cleaning, split and k-core."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shelflight.functions.common import folded_median, wide_median
from shelflight.operators import interactions, kcore, metadata, popularity, reports, reviews
from shelflight.schemas import REVIEWS_RAW
from shelflight.sources import jsonl, sinks

T0 = dt.datetime(2024, 1, 1)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_jsonl_skips_bad_lines_only(spark, tmp_path):
    lines = [
        '{"user_id":"u1","asin":"a1","rating":4.0,"timestamp":1000,"extra":1}',
        '{"user_id":"u2","asin"', "", "   ",
        '{"user_id":"u3","asin":"a3","rating":"bad"}', "[1, 2", '{"user_id":"u4","asin":"a4","rating":5}',
    ]
    (tmp_path / "r.jsonl").write_text("\n".join(lines))
    df = jsonl.read_jsonl(spark, str(tmp_path / "r.jsonl"), REVIEWS_RAW)
    assert [(r.user_id, r.rating) for r in df.orderBy("user_id").collect()] == [("u1", 4.0), ("u3", None), ("u4", 5.0)]
    counts = jsonl.line_counts(spark.read.text(str(tmp_path / "r.jsonl")), REVIEWS_RAW).first()
    assert (counts.lines, counts.kept, counts.skipped) == (5, 3, 2)
    with pytest.raises(ValueError):
        jsonl.require_rows(df.limit(0), "nothing")


def test_primary_image(spark):
    data = [(1, None), (2, []), (3, [None]), (4, [("", "h")]), (5, [("l", "h")]), (6, [(None, None)])]
    df = spark.createDataFrame(data, "id int, images array<struct<large:string,hi_res:string>>")
    got = rows(df.withColumn("i", metadata.primary_image(F.col("images"))), "id", "i")
    assert got == [(1, None), (2, None), (3, None), (4, "h"), (5, "l"), (6, None)]


def test_review_cleaning(spark):
    ts = T0
    data = [
        ("u", "a", None, 4.0, "old", "t", 1, True, ts), ("u", "a", None, 5.0, None, None, -3, None, ts + dt.timedelta(1)),
        (None, "a", None, 4.0, "x", "t", 1, True, ts), ("u", "b", "p", 5.5, "x", "t", 1, True, ts),
        ("u", "c", "p", 0.0, "x", "t", 1, True, ts), ("u", "d", "p", 1.0, "x", "t", None, True, None),
    ]
    cols = "amazon_user_id string, asin string, parent_asin string, rating double, review_title string, review_text string, helpful_vote bigint, verified boolean, ts timestamp_ntz"
    out = reviews.clean_reviews(spark.createDataFrame(data, cols))
    assert rows(out, "asin", "rating", "review_title", "helpful_vote", "verified") == [
        ("a", 5.0, "", 0, False), ("d", 1.0, "x", 0, True)]


def _interactions(spark, triples):
    data = [(u, i, 4.0, T0 + dt.timedelta(seconds=s)) for u, i, s in triples]
    return spark.createDataFrame(data, "user_id string, item_id string, rating double, ts timestamp_ntz")


def test_split_sends_all_ties_to_test(spark):
    df = _interactions(spark, [("one", "a", 1), ("same", "a", 1), ("same", "b", 1), ("tie", "a", 1), ("tie", "b", 2), ("tie", "c", 2)])
    train, test = interactions.split_last_out(df)
    assert rows(train, "user_id", "item_id") == [("tie", "a")]
    assert test.count() == 5
    train, test = interactions.split_last_out(df, "one")
    assert rows(test, "user_id", "item_id") == [("one", "a"), ("same", "b"), ("tie", "c")]
    assert train.count() == 3


def test_dense_rank_over_days(spark):
    df = _interactions(spark, [("u", "a", 0), ("u", "b", 0), ("u", "c", 90000), ("u", "d", 90001), ("v", "a", 5)])
    got = rows(interactions.recency_rank(df), "user_id", "item_id", "rank")
    assert got == [("u", "a", 1), ("u", "b", 1), ("u", "c", 2), ("u", "d", 3), ("v", "a", 1)]


def brute_core(pairs, k):
    pairs = list(pairs)
    while True:
        items = Counter(i for _, i in pairs)
        kept = [(u, i) for u, i in pairs if items[i] >= k]
        users = Counter(u for u, _ in kept)
        kept = [(u, i) for u, i in kept if users[u] >= k]
        if len(kept) == len(pairs):
            return kept
        pairs = kept


@pytest.mark.parametrize("k", [2, 3, 4, 9])
def test_k_core_against_brute_force(spark, k):
    rng = random.Random(k)
    pairs = [(f"u{rng.randint(0, 15)}", f"i{int(rng.random() ** 2 * 20)}") for _ in range(110)]
    pairs += [("hot", f"i{j}") for j in range(20)]  # one user holds a large share
    core = kcore.k_core(_interactions(spark, [(u, i, n) for n, (u, i) in enumerate(pairs)]), k)
    assert rows(core.rows, "user_id", "item_id") == sorted(brute_core(pairs, k))
    assert all(r[1] - r[2] == r[3] for r in core.rounds)


def test_popularity_with_equal_counts(spark):
    df = _interactions(spark, [("u", "a", 1), ("v", "b", 1)])
    out = popularity.normalize_popularity(popularity.popularity_stats(df))
    assert rows(out, "item_id", "popularity_score", "rating_score") == [("a", 0.0, 0.75), ("b", 0.0, 0.75)]


@pytest.mark.parametrize("values", [[1.0], [1.0, 2.0], [5.0, 5.0, 5.0], [0.1, 7.3, 2.2, 2.2, 100.0, -4.0]])
def test_exact_medians(spark, values):
    import statistics

    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    out = spark.range(1).select(folded_median(df, "v").alias("a"), wide_median(df, "v").alias("b")).first()
    assert out.a == pytest.approx(statistics.median(values)) and out.b == pytest.approx(statistics.median(values))


def test_token_counts_keep_double_blanks(spark):
    df = spark.createDataFrame([("",), ("a  b",), ("a b ",)], "t string")
    assert [r.tokens for r in reports.token_counts(df, "t").collect()] == [1, 3, 3]


def test_trending_cut_off_is_inclusive(spark):
    at = dt.datetime(2024, 1, 2)
    data = [(1, "a", "view", at - dt.timedelta(hours=24)), (1, "b", "view", at - dt.timedelta(hours=24, seconds=1)),
            (2, "a", "click", at)]
    df = spark.createDataFrame(data, "user_id bigint, asin string, event_type string, ts timestamp_ntz")
    assert rows(reports.trending(df, F.lit(at).cast("timestamp_ntz")), "asin", "score") == [("a", 1.5)]


def test_point_id_matches_python(spark):
    import hashlib

    df = spark.createDataFrame([("B00X",), ("42",), ("",)], "item_id string")
    for r in df.withColumn("id", sinks.point_id(F.col("item_id"))).collect():
        assert r.id == int(hashlib.md5(r.item_id.encode()).hexdigest()[:16], 16) % 2**63
