"""Vectors, recall, ranking rules, carts, context."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelflight.operators import activity, candidates, carts, evaluate, factors, nearest, ranker, rerank, scoring

T0 = dt.datetime(2024, 1, 1)


def test_top_k_against_numpy_with_many_blocks_and_ties(spark):
    rng = np.random.default_rng(1)
    items = rng.integers(-2, 3, size=(60, 4)).astype(float)
    queries = rng.integers(-2, 3, size=(25, 4)).astype(float)
    idf = spark.createDataFrame([(f"{i:03d}", v.tolist()) for i, v in enumerate(items)], "item_id string, vec array<double>")
    qdf = spark.createDataFrame([(f"q{i:03d}", v.tolist()) for i, v in enumerate(queries)], "query_id string, vec array<double>")
    got = {}
    for r in nearest.top_k(qdf, idf, 7, block=9).collect():
        got.setdefault(r.query_id, []).append((r.position, r.item_id))
    for q in range(25):
        order = sorted(range(60), key=lambda i: (-(queries[q] @ items[i]), f"{i:03d}"))[:7]
        assert [i for _, i in sorted(got[f"q{q:03d}"])] == [f"{i:03d}" for i in order]


def test_top_k_passes_on_k_rows_per_query_whatever_the_items(spark):
    """One group of several tiles: nothing to merge, so no exchange after the search; hidden items stay out."""
    rng = np.random.default_rng(5)
    items = rng.normal(size=(20_000, 3))
    items[::7] = items[0]  # ties across tiles
    idf = spark.createDataFrame([(f"{i:05d}", v.tolist()) for i, v in enumerate(items)], "item_id string, vec array<double>")
    queries = rng.normal(size=(9, 3))
    qdf = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(queries)], "query_id string, vec array<double>")
    gone = {q: set(np.argsort(-np.round(items @ v, 9), kind="stable")[:2 * q].tolist()) for q, v in enumerate(queries)}
    hidden = spark.createDataFrame([(f"q{q}", f"{i:05d}") for q in gone for i in gone[q]], "query_id string, item_id string")
    one = np.tile(queries, (30, 1))  # more lanes than one, so one group
    many = spark.createDataFrame([(f"q{i:03d}", v.tolist()) for i, v in enumerate(np.tile(one, (8, 1)))], qdf.schema)
    assert "Window" not in nearest.top_k(many, idf, 5)._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in nearest.top_k(qdf, idf, 5, hidden=hidden).collect():
        got.setdefault(r.query_id, {})[r.position] = r.item_id
    for q, v in enumerate(queries):
        order = [i for i in np.argsort(-np.round(items @ v, 9), kind="stable").tolist() if i not in gone[q]][:5]
        assert got[f"q{q}"] == {p + 1: f"{i:05d}" for p, i in enumerate(order)}


def test_zero_opposite_and_small_collections(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [-1.0, 0.0]), ("z", [0.0, 0.0]), ("c", [2.0, 0.0])],
                              "item_id string, embedding array<float>")
    found = nearest.similar_items(v, v, 10).filter("query_id = 'a'").orderBy("position").collect()
    assert [(r.item_id, r.score) for r in found] == [("a", 1.0), ("c", 1.0), ("b", -1.0)]
    pairs = spark.createDataFrame([("a", "b"), ("a", "z"), ("a", "x"), ("a", "c")], "reference_id string, item_id string")
    assert {r.item_id: r.score for r in nearest.content_scores(pairs, v).collect()} == {"b": 0.0, "z": 0.0, "x": 0.0, "c": 1.0}


def test_approximate_search_with_all_cells_is_exact(spark, sf):
    from shelflight.sources import testviews

    v = testviews.item_vectors(spark, sf)
    exact = nearest.similar_items(v, v, 5)
    every = nearest.approximate_similar_items(v, v, 5, cells=4, probes=4, block=20)
    assert nearest.recall_against(exact, every).first().recall == 1.0


def test_weights_that_do_not_sum_up_are_uniform(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 1.0])], "item_id string, embedding array<float>")
    refs = spark.createDataFrame([("u", "a", -1.0), ("u", "b", 1.0)], "user_id string, reference_id string, weight double")
    out = nearest.weighted_content_scores(spark.createDataFrame([("u", "c")], "user_id string, item_id string"), refs, v)
    assert out.first().content_score == pytest.approx(0.5 ** 0.5)


def test_weighted_content_ships_no_pairs_and_keeps_rows_without_vectors(spark):
    v = spark.createDataFrame([("a", [3.0, 0.0]), ("b", [0.0, 2.0]), ("c", [1.0, 1.0]), ("z", [0.0, 0.0])],
                              "item_id string, embedding array<float>")
    refs = spark.createDataFrame([("u", "a", 3.0), ("u", "b", 1.0), ("w", "gone", 1.0), ("w", "z", 2.0)],
                                 "user_id string, reference_id string, weight double")
    asked = spark.createDataFrame([("u", "a"), ("u", "c"), ("u", "z"), ("u", "x"), ("w", "a"), ("nobody", "a")],
                                  "user_id string, item_id string")
    out = nearest.weighted_content_scores(asked, refs, v)
    assert {(r.user_id, r.item_id): r.content_score for r in out.collect()} == {
        ("u", "a"): 0.75, ("u", "c"): pytest.approx(0.5 ** 0.5), ("u", "z"): 0.0, ("u", "x"): 0.0, ("w", "a"): 0.0}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") <= 4  # weights, vectors of references, of candidates, references of users


def test_factor_fit_beats_the_mean(spark):
    rng = random.Random(3)
    taste = {u: rng.choice([-1, 1]) for u in range(40)}
    kind = {i: rng.choice([-1, 1]) for i in range(30)}
    data = [(f"u{u}", f"i{i}", 3.0 + 1.5 * taste[u] * kind[i]) for u in range(40) for i in range(30) if rng.random() < .7]
    train = spark.createDataFrame(data, "user_id string, item_id string, rating double")
    model = factors.fit_factors(train, rank=4)
    errors = evaluate.rating_errors(factors.predict(train, model.users, model.items, model.mean)).first()
    assert errors.rmse < 0.5
    stranger = spark.createDataFrame([("new", "i1", 3.0)], "user_id string, item_id string, rating double")
    assert not factors.predict(stranger, model.users, model.items, model.mean).first().known
    seen = train.select("user_id", "item_id")
    unseen = factors.factor_recall_unseen(model.users, model.items, seen, 5)
    assert unseen.join(seen, ["user_id", "item_id"], "left_semi").count() == 0
    every = factors.factor_recall(model.users, model.items, 10_000)
    first = every.agg(F.min("user_id")).first()[0]
    nearly = every.filter((F.col("user_id") == first) & (F.col("position") > 2)).select("user_id", "item_id")
    left = factors.factor_recall_unseen(model.users, model.items, nearly, 5).filter(F.col("user_id") == first)
    assert left.count() == 2
    want = seen.groupBy("user_id").agg(F.least(F.lit(5), 30 - F.count("*")).alias("n")).agg(F.sum("n")).first()[0]
    assert unseen.count() == want


def _shuffled_after(spark, stage):
    """(bytes that stages after the given one shuffled, the last stage)."""
    sc = spark.sparkContext
    none, jvm = sc._jvm.java.util.ArrayList(), sc._jvm
    stages = sc._jsc.sc().statusStore().stageList(none, False, False, sc._gateway.new_array(jvm.double, 0), none)
    found = [(s.stageId(), s.shuffleWriteBytes()) for s in (stages.apply(i) for i in range(stages.size()))]
    return sum(n for at, n in found if at > stage), max((at for at, _ in found), default=-1)


def test_factor_fit_sends_factors_only_where_users_and_items_meet(spark):
    rng = random.Random(5)
    data = [(str(60 * c + u), str(80 * c + i), float(rng.randint(1, 5)))
            for c in range(20) for u in range(60) for i in rng.sample(range(80), 15)]
    train = spark.createDataFrame(data, "user_id string, item_id string, rating double").repartition(4).localCheckpoint()
    _, last = _shuffled_after(spark, -1)
    model = factors.fit_factors(train)
    assert (model.users.count(), model.items.count()) == (1200, len({i for _, i, _ in data}))
    shuffled, _ = _shuffled_after(spark, last)
    assert shuffled < 10_000_000  # dealt out by number they took 14.8 MB


def test_factor_fit_biases_equal_the_plain_formula(spark):
    rng = random.Random(6)
    data = [(f"u{rng.randrange(30)}", f"i{rng.randrange(20)}", float(rng.randint(1, 5))) for _ in range(300)]
    train = spark.createDataFrame(data, "user_id string, item_id string, rating double")
    model = factors.fit_factors(train, rank=2, iterations=1)
    mean = sum(r for *_, r in data) / len(data)

    def damped(key, value):
        groups = {}
        for row in data:
            groups.setdefault(row[key], []).append(value(row))
        return {k: sum(v) / (len(v) + 10) for k, v in groups.items()}

    items = damped(1, lambda row: row[2] - mean)
    users = damped(0, lambda row: row[2] - mean - items[row[1]])
    assert {r.id: r.bias for r in model.items.collect()} == pytest.approx(items)
    assert {r.id: r.bias for r in model.users.collect()} == pytest.approx(users)


def test_users_of_a_full_block_are_shared_out(spark):
    users = spark.range(4000).select(F.col("id").cast("string").alias("user_id"), F.lit(2).alias("home"))
    block = factors._shared_out({2: 4000}, 4)
    held = {r.block: r["count"] for r in users.groupBy(block.alias("block")).count().collect()}
    assert sum(held.values()) == 4000 and max(held.values()) < 1600 and set(held) <= set(range(4))
    even = factors._shared_out({b: 1000 for b in range(4)}, 4)
    assert users.filter(even != F.col("home")).count() == 0


def test_dense_ids_count_keys_in_order(spark):
    keys = spark.createDataFrame([(f"k{n:03d}", n) for n in range(500)] + [(None, -1)], "k string, n int")
    out = factors.dense_ids(keys, "k").collect()
    assert sorted((r.n, r["index"]) for r in out) == [(n, n) for n in range(500)]


def test_unknown_pairs_give_infinite_errors(spark):
    df = spark.createDataFrame([(3.0, 4.0, False)], "prediction double, rating double, known boolean")
    assert evaluate.rating_errors(df).first().rmse == float("inf")


def test_stratified_split_is_exact_and_disjoint(spark):
    df = spark.createDataFrame([(f"u{i}", f"i{i}", i % 3 == 0) for i in range(300)], "user_id string, item_id string, b boolean")
    df = df.withColumn("label", F.col("b").cast("int"))
    train, test = ranker.stratified_split(df)
    assert sorted(tuple(r) for r in test.groupBy("label").count().collect()) == [(0, 40), (1, 20)]
    assert train.join(test, ["user_id", "item_id"]).count() == 0 and train.count() == 240


def test_normaliser_on_single_and_equal_scores(spark):
    df = spark.createDataFrame([("one", -3.0, 0.5, 1.5, -1.0), ("two", 2.0, 1.0, 0.5, 0.5), ("two", 2.0, 3.0, 0.5, 0.5)],
                               "user_id string, mf_score double, popularity_score double, rating_score double, content_score double")
    out = sorted(tuple(r) for r in scoring.normalized(df).collect())
    assert out == [("one", 0.5, 0.4, 1.0, 0.0), ("two", 0.5, 0.0, 0.5, 0.5), ("two", 0.5, 0.8, 0.5, 0.5)]


def brute_rerank(rows, top_n):
    rows = sorted(rows, key=lambda r: -r["s"])
    pool = rows[: 3 * top_n]
    for _ in range(3):
        pool = sorted(pool, key=lambda r: -r["s"])
        top = pool[: 2 * top_n]
        named = [r["c"] for r in top if r["c"]]
        for r in top:
            if r["c"]:
                n = named.count(r["c"])
                if n / len(named) > 0.25:
                    r["s"] *= 0.7
                if n > 4:
                    r["s"] *= 0.5
    return [r["i"] for r in sorted(rows, key=lambda r: (-r["s"], r["p"]))][:top_n]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_diversity_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [{"i": f"i{n:02d}", "s": rng.choice([0.2, 0.4, 0.6, rng.random()]), "c": rng.choice(["x", "x", "y", "z", None]), "p": n + 1}
            for n in range(40)]
    rows.sort(key=lambda r: -r["s"])
    for n, r in enumerate(rows):
        r["p"] = n + 1
    df = spark.createDataFrame([("u", r["i"], r["s"], r["p"], r["c"]) for r in rows],
                               "user_id string, item_id string, adjusted_score double, rank_position int, category string")
    df = df.withColumn("applied_rules", F.array().cast("array<string>")).withColumn("parent_asin", F.lit(None).cast("string"))
    out = rerank.final_cut(rerank.diversify(df, 6), 6).orderBy("position")
    assert [r.item_id for r in out.collect()] == brute_rerank(rows, 6)


def test_diversity_rules_are_named_once(spark):
    # 5 of 16 rows share a category: 31.25 % is an exact half and goes to the even digit.
    rows = [("u", f"i{n:02d}", 1.0 - n / 100, n + 1, "x" if n < 5 else f"c{n}") for n in range(16)]
    df = spark.createDataFrame(rows, "user_id string, item_id string, adjusted_score double, rank_position int, category string")
    out = rerank.diversify(df.withColumn("applied_rules", F.array(F.lit("first"))), 20).collect()
    rules = {r.category: r.applied_rules for r in out}
    assert rules.pop("x") == ["first", "diversity_penalty(31.2%)", "category_limit_exceeded(5)"]
    assert all(r == ["first"] for r in rules.values())


def test_context_rules(spark):
    data = [("a", 0, 5, 5), ("b", 4, 6, 4), ("c", 5, None, None), ("d", 9, 1, 9), ("e", 10, None, 9), ("f", None, None, 9)]
    df = spark.createDataFrame([("u", i, 1.0, "c" if n else None, r, p, n) for i, p, n, r in data],
                               "user_id string, item_id string, rank_score double, category string, rating_number int, recent_pos int, category_count int")
    got = {r.item_id: r.adjusted_score for r in rerank.apply_rules(df).collect()}
    want = {"a": 1.4 * .2, "b": 1.4 * .2 * .9, "c": .4, "d": 1.08 * .4, "e": .6, "f": 1.0}
    assert got == pytest.approx(want)


def test_popularity_recall_keeps_the_head_and_excludes(spark):
    pop = spark.createDataFrame([(f"i{n:03d}", 1.0 - n / 1000) for n in range(200)], "item_id string, popularity_score double")
    users = spark.createDataFrame([("u", ["i000", "i003"]), ("v", [])], "user_id string, excluded array<string>")
    out = candidates.popularity_recall(users, pop, k=10, max_excluded=5)
    lists = {u: [r.item_id for r in out.filter(F.col("user_id") == u).orderBy("pos").collect()] for u in "uv"}
    assert lists["u"][:4] == ["i001", "i002", "i004", "i005"] and lists["v"][:4] == ["i000", "i001", "i002", "i003"]
    assert len(set(lists["u"])) == 10 and all(i < "i022" for i in lists["u"])
    # Users with more exclusions than the shared list allows for get the same lists another way.
    long = candidates.popularity_recall(users, pop, k=10, max_excluded=1)
    assert sorted(map(tuple, long.collect())) == sorted(map(tuple, out.collect()))


def brute_cart(ops, known):
    cart = {}
    for op, item, q in ops:
        if op == "add" and item in known:
            cart[item] = cart.get(item, 0) + q
        elif op == "set" and item in cart:
            cart[item] = q
        elif op == "remove":
            cart.pop(item, None)
        elif op == "clear":
            cart.clear()
    return cart


def test_cart_fold_against_brute_force(spark):
    rng = random.Random(5)
    users = {f"u{n}": [(rng.choice(["add"] * 5 + ["set", "set", "remove"] + (["clear"] if n % 2 else [])), rng.choice("abcx"), rng.randint(1, 5))
                       for _ in range(25)] for n in range(30)}
    data = [(u, i, op, q, T0 + dt.timedelta(seconds=n // 2), n) for u, ops in users.items() for n, (op, i, q) in enumerate(ops)]
    df = spark.createDataFrame(data, "user_id string, asin string, op string, quantity bigint, ts timestamp_ntz, event_id bigint")
    known = spark.createDataFrame([("a",), ("b",), ("c",)], "asin string")
    got = {(r.user_id, r.asin): r.quantity for r in carts.fold_carts(df, known).collect()}
    want = {(u, i): q for u, ops in users.items() for i, q in brute_cart(ops, "abc").items()}
    assert got == want


def test_context_life(spark):
    at = [0, 899, 1799, 2700, 2701]  # gaps 899, 900, 901, 1
    data = [("u", str(n), "c" if n != 3 else None, T0 + dt.timedelta(seconds=s), n) for n, s in enumerate(at)]
    df = spark.createDataFrame(data, "user_id string, asin string, category string, ts timestamp_ntz, event_id bigint")
    now = F.lit(T0 + dt.timedelta(seconds=2701)).cast("timestamp_ntz")
    items = activity.recent_items(df, now).orderBy("pos").collect()
    assert [r.asin for r in items] == ["4", "3"]
    assert [tuple(r) for r in activity.recent_categories(df, now).collect()] == [("u", "c", 1)]
    late = F.lit(T0 + dt.timedelta(seconds=2701 + 900)).cast("timestamp_ntz")
    assert activity.recent_items(df, late).count() == 0 and activity.last_active(df, late).count() == 0
    many = spark.createDataFrame([("u", str(n), "c", T0 + dt.timedelta(seconds=n), n) for n in range(21)], df.schema)
    assert activity.recent_items(many, F.lit(T0 + dt.timedelta(seconds=21)).cast("timestamp_ntz")).count() == 20


def test_lists_that_lie_by_user_are_merged_and_scored_where_they_are(spark):
    def by_user(rows, schema):
        return spark.createDataFrame(rows, schema).repartition("user_id")

    mf = [("u", "a", 1), ("u", "b", 2), ("v", "c", 1)]
    content = [("u", "b", 1), ("u", "d", 2), ("w", "a", 1)]
    popular = [("u", "a", 1), ("u", "e", 2), ("v", "c", 1), ("v", "a", 2)]
    merged = candidates.merge_candidates(*[by_user(r, "user_id string, item_id string, pos int") for r in (mf, content, popular)])
    scores = by_user([("u", "d", 0.5), ("u", "x", 0.7), ("v", "c", 0.1)], "user_id string, item_id string, content_score double")
    scored = scoring.with_content(merged, scores)
    assert sorted(map(tuple, scored.select("user_id", "pos", "item_id", "source", "recall_count", "content_score").collect())) == [
        ("u", 1, "a", "mf", 4, None), ("u", 2, "b", "mf", 4, None), ("u", 3, "d", "content", 4, 0.5),
        ("u", 4, "e", "popularity", 4, None), ("v", 1, "c", "mf", 2, 0.1), ("v", 2, "a", "popularity", 2, None),
        ("w", 1, "a", "content", 1, None),
    ]
    assert "ENSURE_REQUIREMENTS" not in scored._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("reserve", [0, 100])
def test_equal_vectors_are_searched_once_and_lists_stay_exact(spark, monkeypatch, reserve):
    monkeypatch.setattr(nearest, "RESERVE", reserve)
    asked = []
    searched = nearest._searched
    monkeypatch.setattr(nearest, "_searched", lambda q, i, *rest: (asked.append((q.count(), i.count())), searched(q, i, *rest))[1])
    rng = random.Random(3)
    kinds = [[float(rng.randrange(-2, 3)) for _ in range(3)] for _ in range(12)]  # scores tie between kinds, too
    queries = [(f"q{n}", kinds[n % 7]) for n in range(60)]
    items = [(f"i{n}", kinds[n * n % 12]) for n in range(80)]
    hidden = [(f"q{n}", f"i{m}") for n in range(60) for m in range(80) if n % 3 and rng.random() < 0.3]
    q = spark.createDataFrame(queries, "query_id string, vec array<double>")
    i = spark.createDataFrame(items, "item_id string, vec array<double>")
    for gone in ([], hidden):
        hide = spark.createDataFrame(gone, "query_id string, item_id string") if gone else None
        got = sorted((r.query_id, r.position, r.item_id, r.score) for r in nearest.top_k(q, i, 9, hidden=hide).collect())
        want = []
        for name, vec in queries:
            left = [(-sum(a * b for a, b in zip(vec, w)), m) for m, w in items if (name, m) not in set(gone)]
            want += [(name, p, m, -s) for p, (s, m) in enumerate(sorted(left)[:9], 1)]
        assert got == sorted(want)
    assert asked[0] == (7, len({tuple(v) for _, v in items})) == asked[1]
    assert (len(asked) > 2) == (reserve == 0)
