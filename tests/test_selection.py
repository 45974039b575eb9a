"""Coreness, exact medians, ranges of ranks and title search against brute force."""

import math
import random
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shelflight.functions.common import exact_medians
from shelflight.operators import candidates, coreness, texts, title_index
from shelflight.session import scratch_path


def brute_levels(pairs):
    """Coreness by peeling for k = 1, 2, ..."""
    levels, k = {}, 1
    pairs = list(pairs)
    while pairs:
        for u, i in pairs:
            levels["u", u] = levels["i", i] = k
        k += 1
        while True:
            users, items = Counter(u for u, _ in pairs), Counter(i for _, i in pairs)
            kept = [(u, i) for u, i in pairs if users[u] >= k and items[i] >= k]
            if len(kept) == len(pairs):
                break
            pairs = kept
    return levels


@pytest.mark.parametrize("most", [None, 3])
def test_coreness_against_peeling(spark, most):
    rng = random.Random(5)
    pairs = [(f"u{rng.randint(0, 14)}", f"i{int(rng.random() ** 2 * 18)}") for _ in range(120)]  # pairs repeat
    pairs += [("hot", f"i{j}") for j in range(18)]
    df = spark.createDataFrame(pairs + [(None, "i1"), ("u1", None)], "user_id string, item_id string")
    want = {n: min(k, most or k) for n, k in brute_levels(pairs).items()}
    out = coreness.coreness(df, most)
    got = {("u", r.user_id): r.level for r in out.users.collect()} | {("i", r.item_id): r.level for r in out.items.collect()}
    assert got == want
    for k in (1, 2, 3):
        inside = [(u, i) for u, i in pairs if min(want["u", u], want["i", i]) >= k]
        assert sorted(map(tuple, out.rows(df, k).collect())) == sorted(inside)
        sizes = out.sizes([k]).first()
        assert tuple(sizes) == (k, len(inside), len({u for u, _ in inside}), len({i for _, i in inside}))


@pytest.mark.parametrize("k", [2, 4])
def test_coreness_of_one_core_only(spark, k):
    rng = random.Random(k)
    pairs = [(f"u{rng.randint(0, 14)}", f"i{int(rng.random() ** 2 * 18)}") for _ in range(110)]
    want = {n: k if level >= k else 0 for n, level in brute_levels(pairs).items()}
    out = coreness.coreness(spark.createDataFrame(pairs, "user_id string, item_id string"), most=k, least=k)
    got = {("u", r.user_id): r.level for r in out.users.collect()} | {("i", r.item_id): r.level for r in out.items.collect()}
    assert got == want and len(set(want.values())) == 2


def test_coreness_of_nothing(spark):
    out = coreness.coreness(spark.createDataFrame([], "user_id string, item_id string"))
    assert out.users.count() == 0 and tuple(out.sizes([5]).collect()) == ()


def test_coreness_rounds_shuffle_no_edges(spark):
    """Joins with the edges read them by bucket, whatever has to be moved to them."""
    df = spark.createDataFrame([(f"u{n % 7}", f"i{n % 5}") for n in range(35)], "user_id string, item_id string")
    edges = coreness._neighbours(df.groupBy("user_id", "item_id").agg(F.count("*").alias("n")), "user_id")
    fell = edges.select("user_id", F.lit(2).cast("bigint").alias("sent"), F.lit(1).cast("bigint").alias("level")).distinct()
    told = coreness._told(fell.hint("shuffle_hash"), edges, "item_id", "user_id", F.lit(3).cast("bigint"))
    assert {r.item_id: r.heard for r in told.collect()} == {f"i{n}": {2: -7, 1: 7} for n in range(5)}
    plan = told._jdf.queryExecution().sparkPlan().toString()
    assert "Bucketed: true" in plan
    # One exchange deals the messages out; the edges and what is summed from them need none.
    assert told._jdf.queryExecution().toString().split("== Physical Plan ==")[1].split("Initial Plan")[-1].count("Exchange hash") == 1


@pytest.mark.parametrize("cells", [2, 64])
def test_medians_of_columns_together(spark, cells):
    rng = random.Random(cells)
    columns = {
        "wide": [rng.uniform(-1e3, 1e3) for _ in range(101)],
        "outliers": [1e300, -1e300, 1e308, -1.7e308] + [rng.gauss(0, 1) for _ in range(96)],
        "few": [float(rng.randint(0, 2)) for _ in range(60)],
        "tiny": [5e-324 * n for n in range(7)],
        "ends": [-math.inf, -math.inf, 1.0, 2.0, math.inf],
        "one": [3.25],
        "none": [],
    }
    size = max(map(len, columns.values()))
    rows = list(zip(*[v + [None] * (size - len(v)) for v in columns.values()]))
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns))
    got = exact_medians(df, list(columns), cells)
    assert got == {c: statistics.median(v) if v else None for c, v in columns.items()}
    edge = spark.createDataFrame([(math.nan,), (math.nan,), (1.0,)], "v double")
    assert math.isnan(exact_medians(edge, ["v"])["v"])


@pytest.mark.parametrize("width", [4, 64])
def test_pools_past_exclusions(spark, width):
    rng = random.Random(width)
    scores = {f"i{n:03d}": rng.randint(0, 40) / 40 for n in range(230)}  # many ties
    order = sorted(scores, key=lambda i: (-scores[i], i))
    excluded = {"few": order[3:5], "head": order[:150], "all": order, "odd": order[::2] + ["unknown", order[0]],
                "but_last": order[:-1], "holes": [i for n, i in enumerate(order) if n % 9]}
    pop = spark.createDataFrame(list(scores.items()), "item_id string, popularity_score double")
    users = spark.createDataFrame(list(excluded.items()), "user_id string, excluded array<string>")
    got = {r.user_id: r._pool for r in candidates.pools_past_exclusions(users, pop, 12, width).collect()}
    want = {u: [i for i in order if i not in set(out)][:12] for u, out in excluded.items()}
    assert got == {u: pool for u, pool in want.items() if pool}
    assert candidates.pools_past_exclusions(users, pop.limit(0), 12, width).count() == 0


def test_title_search_against_contains(spark):
    titles = {"a": "Hair CLIP 100%_off", "b": "aaaa", "c": "", "d": None, "e": "Clip-on hair", "f": "été Crème", "g": "ab",
              "h": "abcabd"}
    products = spark.createDataFrame(list(titles.items()), "parent_asin string, title string")
    index = title_index.build_title_index(products, scratch_path(spark, "titles"))
    wanted = ["clip", "HAIR", "aaaaa", "aaa", "a", "ab", "%_", "abd", "abcd", "crèm", "zzz", "", None, "hair clip 100%_off", " "]
    asked = spark.createDataFrame(list(enumerate(wanted)), "query_id int, text string")
    got = sorted(map(tuple, title_index.search_titles(index, asked).collect()))
    want = sorted((q, k) for q, w in enumerate(wanted) if w for k, t in titles.items() if t and w.lower() in t.lower())
    assert got == want


def test_restyled_texts_keep_every_id(spark):
    items = spark.createDataFrame(
        [("a", "Velvet hair clip", "Store", "Hair", None)],
        "item_id string, title string, store string, main_category string, raw_metadata string",
    ).withColumn("category", F.col("main_category"))
    old = spark.createDataFrame([("a", "old a"), ("x", "old x"), ("", "old"), (None, "old")], "item_id string, embedding_text string")
    got = dict(map(tuple, texts.restyled_texts(old, items, "descriptive").collect()))
    assert set(got) == {"a", "x"} and got["x"] == "old x" and "Velvet hair clip" in got["a"]


def test_title_search_gathers_no_pairs_and_repeats_none(spark):
    titles = [("a", "Hair clip"), ("a", "Hair clips"), ("b", "clip")]
    for rows, plain in ((titles, False), (titles[1:], True)):
        products = spark.createDataFrame(rows, "parent_asin string, title string")
        index = title_index.build_title_index(products, scratch_path(spark, "titles"))
        asked = spark.createDataFrame([(1, "hair cl"), (2, "clip")], "query_id int, text string")
        found = title_index.search_titles(index, asked)
        assert sorted(map(tuple, found.collect())) == [(1, "a"), (2, "a"), (2, "b")]
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert ("Aggregate [query_id" in plan.splitlines()[0]) != plain


def test_content_recall_ranks_lists_once(spark):
    refs = spark.createDataFrame([("u", "r", 1), ("u", "s", 2)], "user_id string, reference_id string, pos int")
    rows = [(q, f"{q}{p:02d}", 1 - p / 100, p) for q in "rs" for p in range(1, 61)]
    near = spark.createDataFrame(rows, "query_id string, item_id string, score double, position int")
    none = spark.createDataFrame([], "user_id string, item_id string")
    plain, masked = candidates.content_recall(refs, near), candidates.content_recall(refs, near, none)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, masked.collect())) and plain.count() == 50
    windows = [df._jdf.queryExecution().optimizedPlan().toString().count("Window [") for df in (plain, masked)]
    assert windows[0] == windows[1] - 1


def test_droppable_items_keep_no_interactions(spark, sf, monkeypatch):
    """The cascade asks for the core's items only: nothing but levels and edges is written, no rows are peeled."""
    from shelflight.operators import kcore
    from shelflight.registry import reporting

    want = sorted(map(tuple, kcore.k_core(reporting.testviews.interactions(spark, sf), 20).rows.select("item_id").distinct().collect()))
    monkeypatch.setattr(kcore, "k_core", lambda *_: pytest.fail("the core's rows are not asked for"))
    seen = []
    monkeypatch.setattr(reporting.catalog, "droppable_items", lambda items, products, keys: seen.append(keys) or items)
    reporting._droppable(spark, sf)
    assert sorted(map(tuple, seen[0].collect())) == want
