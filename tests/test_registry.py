"""The registry, the plans, and a stream against its batch twin."""

import re
from pathlib import Path

import pytest

import __spark_entry__ as entry
from shelflight.session import scratch_path

ROOT = Path(__file__).resolve().parents[1]


def test_every_twin_has_a_query():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 100
    assert all(re.match(r"^([A-M]|op)\d+_[a-z0-9_]+$|^pipeline$", name) for name in queries)


def test_entry(spark):
    assert entry.entry(spark).columns == ["item_id", "interaction_count", "mean_rating", "popularity_score"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_core_operators_stay_in_the_jvm_and_join_by_key(spark, sf):
    for name in ("B6_clean_reviews", "C1_match_counts", "E2_normalized_popularity", "F2_split_test", "I12_diversity",
                 "K13_compact_texts", "K18_cleaned_texts", "L3_recent_items", "M1_cart_fold"):
        plan = plan_of(entry.queries()[name](spark, sf))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "Python" not in plan, name


def test_scan_reads_only_needed_columns(spark, sf):
    plan = plan_of(entry.queries()["E1_item_popularity"](spark, sf))
    assert "l_extendedprice" not in plan and "o_totalprice" not in plan


def test_no_machine_local_checkpoints():
    for path in (ROOT / "shelflight").rglob("*.py"):
        assert "localCheckpoint" not in path.read_text()


def test_build_plan(spark, sf):
    from pyspark.sql import functions as F

    from shelflight.plans.build import build
    from shelflight.sources import testviews

    reviews, meta, out = (scratch_path(spark, n) for n in ("reviews", "meta", "build"))
    for df, path in ((testviews.reviews_raw(spark, sf), reviews), (testviews.metadata_raw(spark, sf), meta)):
        df.select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    def lengths(texts):  # a small deterministic encoder
        return [[len(t), t.count(" "), t.count("e"), 1.0] for t in texts]

    tables = build(spark, reviews, meta, out, encoder=lengths)
    rows = {n: t.count() for n, t in tables.items()}
    assert rows["interactions_train"] + rows["interactions_test"] == rows["interactions_core"] == rows["ranking_dataset"]
    assert rows["embedding_text"] == rows["semantic_attributes"] > 0
    from shelflight.operators import ranker, vector_index

    assert vector_index.stored(spark, f"{out}/vector_index").count() == rows["item_vectors"] == rows["embedding_text"]
    assert spark.read.json(f"{out}/metrics/lists").count() == 3
    assert spark.read.json(f"{out}/metrics/ratings").first().pairs > 0
    cells = spark.read.json(f"{out}/metrics/ranker").first()
    assert cells.tn + cells.fp + cells.fn + cells.tp == cells.rows > 0
    with pytest.raises(ValueError, match="fitted on"):
        ranker.load_ranker(f"{out}/ranker", ranker.FEATURES[::-1])


def test_context_stream_equals_batch(spark, sf):
    import duckdb

    con = duckdb.connect()
    for name in ("events",):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    want = sorted(con.execute(entry.oracle_sql()["L3_context_stream"]).fetchall())
    got = sorted(tuple(r) for r in entry.queries()["L3_context_stream"](spark, sf).collect())
    assert got == want


def test_context_folds_events_in_any_order():
    import random

    import pandas as pd

    from shelflight.streaming.events import RecentContext, newest_run

    context = RecentContext(ttl=900, limit=3)
    def run(*batches):
        newest, chains = [], []
        for batch in batches:
            newest, chains = context.fold(newest, chains, pd.DataFrame(batch, columns=["at", "event_id", "asin", "category"]))
        return newest_run(newest, 900), newest[0][0], chains[-1][2] if chains else {}
    a, b, c = (1000.0, 1, "A", "x"), (1200.0, 2, "B", "x"), (1500.0, 3, "C", None)
    assert run([a, c], [b]) == (["C", "B", "A"], 1500.0, {"x": 2})
    # A late event bridges what looked like a pause.
    assert run([(0.0, 1, "A", "x"), (1700.0, 2, "B", "y")], [(850.0, 3, "M", "z")]) == (["B", "M", "A"], 1700.0, {"x": 1, "y": 1, "z": 1})
    assert run([(0.0, 1, "A", "x"), (1700.0, 2, "B", "y")]) == (["B"], 1700.0, {"y": 1})
    rng = random.Random(3)
    events = [(float(rng.randrange(20_000)), n, f"i{n}", rng.choice(["x", "y", "", None])) for n in range(60)]
    want = run(sorted(events))
    for _ in range(20):
        rng.shuffle(events)
        assert run(*[events[k : k + 7] for k in range(0, 60, 7)]) == want


def test_a_cluster_must_name_its_shared_folder(monkeypatch):
    import pytest

    from shelflight import session

    class Somewhere:
        class conf:
            get = staticmethod(lambda key, default=None: default)
        class sparkContext:
            master = "spark://host:7077"
    with pytest.raises(RuntimeError):
        session.shared_folder(Somewhere)
