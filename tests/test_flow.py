"""The event flow: repeats, late events, batches run twice; panes against windows."""

import datetime as dt
import random

from pyspark.sql import Row
from pyspark.sql import functions as F

from shelflight.session import keep, scratch_path
from shelflight.streaming import events as stream
from shelflight.streaming import flow

SCHEMA = "event_id bigint, user_id bigint, asin string, event_type string, ts timestamp, metadata string"


def at(minutes):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


def catalogue(spark):
    items = spark.createDataFrame([("a", "p"), ("b", "q")], "asin string, parent_asin string")
    products = spark.createDataFrame([("p", "Shoes", '{"brand": "X"}'), ("q", "Hats", None)],
                                     "parent_asin string, main_category string, raw_metadata string")
    return items, products


def slices(spark, parts):
    """Each part as one file, read in order."""
    path = scratch_path(spark, "flow-input")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for n, rows in enumerate(parts):
        one = scratch_path(spark, "flow-part")
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(one)
        store = hadoop.Path(one).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        store.mkdirs(hadoop.Path(path))
        file = next(f.getPath() for f in store.listStatus(hadoop.Path(one)) if f.getPath().getName().startswith("part-"))
        target = hadoop.Path(f"{path}/{n}.parquet")
        store.rename(file, target)
        store.setTimes(target, 1_000_000_000_000 + 1000 * n, -1)
    return path


def test_every_event_is_logged_once_and_late_ones_change_no_context(spark):
    stream.prepare(spark)
    parts = [
        [(1, 7, "a", "view", at(0), "{}"), (1, 7, "a", "view", at(0), "{}"), (2, 7, "b", "click", at(1), "{}"), (9, 7, "a", "signup", at(1), "{}")],
        [(3, 7, "a", "view", at(200), "{}"), (2, 7, "b", "click", at(1), "{}"), (9, 7, "a", "signup", at(1), "{}"), (None, 7, "a", "view", at(1), "{}")],
        [(8, 9, "a", "view", at(200), "{}")],  # the watermark for late events is that of the batch before
        [(4, 7, "b", "view", at(2), "{}"), (4, 7, "b", "view", at(2), "{}"), (1, 7, "a", "view", at(0), "{}"), (5, 8, "x", "view", at(201), "{}")],
        [(4, 7, "b", "view", at(2), "{}"), (6, 7, "b", "purchase", at(202), "{}"), (3, 7, "a", "view", at(200), "{}"), (7, 7, "a", "view", None, "{}")],
    ]
    items, products = catalogue(spark)
    events = stream.read_events(spark, slices(spark, parts), SCHEMA, files_per_trigger=1)
    folder = scratch_path(spark, "flow")
    flow.event_flow(events, items, products, folder, scratch_path(spark, "state"), ttl=4 * 3600).awaitTermination()
    log = flow.read_flow(spark, folder, "log")
    assert sorted((r.event_id, r.category) for r in log.collect()) == [
        (1, "Shoes"), (2, "Hats"), (3, "Shoes"), (4, "Hats"), (5, None), (6, "Hats"), (7, "Shoes"), (8, "Shoes")]
    bad = flow.read_flow(spark, folder, "rejects")
    assert sorted((r.event_id or 0, r.event_type) for r in bad.collect()) == [(0, "view"), (9, "signup")]
    last = flow.read_flow(spark, folder, "context").filter("user_id = 7").orderBy(F.desc("batch")).first()
    assert last.recent_items[:4] == ["b", "a", "b", "a"] and last.recent_categories == {"Shoes": 2, "Hats": 2}

    # The batch of the late event run once more, as after a failure: nothing changes.
    number = log.filter("event_id = 4").first().batch
    before = sorted(map(tuple, log.drop("batch").collect()), key=repr)
    staged = keep(spark.read.parquet(f"{folder}/staged").filter(F.col("batch") == number).drop("batch"), "again")
    flow.sorter(items, products, folder)(staged, number)
    assert sorted(map(tuple, flow.read_flow(spark, folder, "log").drop("batch").collect()), key=repr) == before


def test_panes_add_up_to_windows(spark):
    rows = [(i, i % 50, f"i{i % 3}", "view", at(i * 7), None) for i in range(600)]
    events = spark.createDataFrame(rows, SCHEMA)
    got = stream.windows_of_panes(stream.view_panes(events))
    want = events.groupBy(F.window("ts", "24 hours", "1 hour"), "asin").agg(
        F.count("*").alias("n"), F.countDistinct("user_id").alias("users")
    ).select(F.col("window.end").alias("window_end"), "asin", "n", "users")
    both = got.join(want, ["window_end", "asin"], "full").collect()
    assert len(both) == want.count() and all(r.view_count == r.n and abs(r.unique_users - r.users) <= 1 for r in both)


def test_user_panes_count_many_users_exactly(spark):
    users = F.when(F.col("id") % 11 > 0, F.col("id") % 7919)  # some come back in later hours, some are unknown
    events = spark.range(20_000).select(
        F.col("id").alias("event_id"), users.alias("user_id"), F.lit("a").alias("asin"), F.lit("view").alias("event_type"),
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 9).alias("ts"), F.lit(None).cast("string").alias("metadata"),
    )
    got = stream.windows_of_user_panes(stream.user_panes(events))
    want = events.groupBy(F.window("ts", "24 hours", "1 hour"), "asin").agg(
        F.count("*").alias("n"), F.countDistinct("user_id").alias("users")
    ).select(F.col("window.end").alias("window_end"), "asin", "n", "users")
    both = got.join(want, ["window_end", "asin"], "full").collect()
    assert len(both) == want.count() and all((r.view_count, r.unique_users) == (r.n, r.users) for r in both)


class Value:
    """A state value that counts the calls to it."""

    def __init__(self, calls):
        self.calls, self.value = calls, None

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value


class Handle:
    def __init__(self):
        self.calls, self.timers = [], set()

    def getValueState(self, name, schema):
        return Value(self.calls)

    def registerTimer(self, at):
        self.calls.append("register")
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls.append("delete")
        self.timers.remove(at)


class Clock:
    def getCurrentWatermarkInMs(self):
        return 0


def test_a_users_batch_takes_few_calls_to_the_state():
    context, handle = stream.RecentContext(ttl=100, limit=3), Handle()
    context.init(handle)
    batches = [[(10.0, 1, "a", "x"), (12.0, 2, "b", None)], [(11.0, 3, "c", "x")], [(50.0, 4, "d", "y")]]
    for events, calls in zip(batches, (5, 4, 6), strict=True):
        handle.calls.clear()
        rows = (Row(at=at, event_id=n, asin=asin, category=c) for at, n, asin, c in events)
        out = list(context.handleInputRows(("u",), rows, Clock()))
        assert len(handle.calls) == calls and len(handle.timers) == 1
    assert handle.timers == {150_000}
    assert (out[0].recent_items, out[0].recent_categories, out[0].last_active) == (["d", "b", "c"], {"x": 2, "y": 1}, 50)


def test_contexts_of_a_batch_are_folded_together_as_one_user_at_a_time(spark):
    rng = random.Random(5)
    schema = "user_id bigint, event_id bigint, asin string, ts timestamp, category string"
    own, path = {}, scratch_path(spark, "folded")
    one = stream.RecentContext(ttl=600, limit=4)
    state = flow._state(spark, f"{path}/0", 0, spark.createDataFrame([], SCHEMA).schema)
    for n in range(4):
        # Batches overlap in time, so events bridge stretches of earlier ones.
        rows = [(rng.choice([None, 1, 2, 3, 4, 5]), 100 * n + i, rng.choice(["a", "b", None]), at(rng.randrange(40 * n, 40 * n + 60)),
                 rng.choice(["x", "y", "", None])) for i in range(12)]
        out = flow.folded(state, spark.createDataFrame(rows, schema), 600, 4, "60 minutes")
        state = keep(out, "folded")
        touched = {r.user_id: r for r in state.filter("touched").collect()}
        assert set(touched) == {r[0] for r in rows}
        for user, row in touched.items():
            events = [(ts.replace(tzinfo=dt.timezone.utc).timestamp(), e, asin, c) for u, e, asin, ts, c in rows if u == user]
            newest, chains = own[user] = one.fold_events(*own.get(user, ([], [])), events)
            live = chains[-1][2] if chains and newest[0][0] - chains[-1][1] < 600 else {}
            assert (row.recent_items, row.recent_categories, row.last_active) == (
                stream.newest_run(newest, 600), live, int(newest[0][0]))
        state = state.select("user_id", "newest", "stretches")


def test_the_flow_keeps_one_state_and_joins_the_catalogue_once(spark):
    stream.prepare(spark)
    items, products = catalogue(spark)
    read = spark.sparkContext.accumulator(0)
    products = spark.createDataFrame(products.rdd.map(lambda r: (read.add(1), r)[1]), products.schema)
    parts = [[(n, 7, "a", "view", at(n), "{}")] for n in range(3)]
    events = stream.read_events(spark, slices(spark, parts), SCHEMA, files_per_trigger=1)
    query = flow.event_flow(events, items, products, scratch_path(spark, "flow"), scratch_path(spark, "state"))
    query.awaitTermination()
    assert read.value == 2 and len(query.lastProgress["stateOperators"]) == 1
