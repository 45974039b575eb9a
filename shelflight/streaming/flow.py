"""One event flow: a single streaming query feeds the log, the rejects and the users' contexts.

Every micro-batch is written once, as a folder of its own, and sorted into three tables:

* ``log``: each accepted event once, enriched.  Events on time are told apart from their repeats by
  streaming state that the watermark bounds.  What that state did not pass on - repeats, and events
  beyond the watermark - is compared with the days of the log it belongs to, so a late event
  is logged once as well.
* ``rejects``: events without an id or with an unknown type, once per distinct event.
* ``context``: what every touched user's context holds after the batch.  It sees each event on time
  once, with the category it was enriched by; late events and those without a time do not change it.

What is known of the catalogue is joined and written once, when the flow starts.  Contexts are folded for
all users of a batch together, from ``state``: a table of its own per batch, of the users touched and
those whom an event on time could still reach.

A batch that is run again overwrites its own folders and ignores them when it looks for earlier
events, and reads the state of the batch before it, so running it twice changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from shelflight.functions.common import first_per_group, top_per_group
from shelflight.operators.activity import RECENT_ITEMS, TTL_SECONDS, enriched_by, is_valid_type, product_facts
from shelflight.session import keep
from shelflight.streaming.events import WATERMARK

_EVENT = ["event_id", "user_id", "asin", "event_type", "ts", "metadata"]
_LOG = [*_EVENT, "category", "brand", "on_time"]
_CONTEXT = ["user_id", "recent_items", "recent_categories", "last_active"]


def _accepted() -> Column:
    return is_valid_type() & F.col("event_id").isNotNull()


def _read(spark: SparkSession, table: str, schema: StructType) -> DataFrame:
    """A table; empty before the first write."""
    try:
        return spark.read.schema(schema).parquet(table)
    except AnalysisException as err:
        if "PATH_NOT_FOUND" not in str(err):
            raise
        return spark.range(0).select(*[F.lit(None).cast(c.dataType).alias(c.name) for c in schema])


def _day() -> Column:
    return F.coalesce(F.to_date("ts"), F.lit("1970-01-01").cast("date"))


def _store(rows: DataFrame, table: str, batch: int) -> None:
    rows.withColumn("day", _day()).write.mode("overwrite").partitionBy("day").parquet(f"{table}/batch={batch}")


def _not_yet(rows: DataFrame, table: str, batch: int, keys: list[str]) -> DataFrame:
    """Rows whose keys no earlier batch stored; only the days these rows fall on are read."""
    dated = rows.withColumn("day", _day())
    schema = dated.withColumn("batch", F.lit(0)).select(*keys, "day", "batch").schema
    earlier = _read(rows.sparkSession, table, schema).filter(F.col("batch") != batch)
    earlier = earlier.select(*[F.col(c).alias(f"_{c}") for c in (*keys, "day")])
    on = F.col("day") == F.col("_day")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return dated.join(earlier, on, "left_anti").drop("day")


def _state(spark: SparkSession, table: str, batch: int, events: StructType) -> DataFrame:
    """(user_id, newest, stretches) after a batch, none before the first."""
    kind = {c: events[c].dataType.simpleString() for c in _EVENT}
    schema = StructType.fromDDL(
        f"user_id {kind['user_id']}, newest array<struct<ts:timestamp,event_id:{kind['event_id']},asin:{kind['asin']}>>, "
        "stretches array<struct<first:timestamp,last:timestamp,counts:array<struct<key:string,value:bigint>>>>, batch int"
    )
    return _read(spark, table, schema).filter(F.col("batch") == batch).drop("batch")


def _pause(earlier: Column, later: Column, ttl: int) -> Column:
    return F.unix_micros(later) - F.unix_micros(earlier) >= ttl * 1_000_000


def _newest(before: DataFrame, events: DataFrame, ttl: int, limit: int) -> DataFrame:
    """(user_id, newest, recent_items): the newest ``limit`` events, and the items up to their first pause."""
    old = before.select("user_id", F.inline("newest"))
    top = top_per_group(
        old.unionByName(events.select("user_id", "ts", "event_id", "asin")), ["user_id"],
        [F.desc("ts"), F.desc("event_id")], limit, "pos",
    )
    w = Window.partitionBy("user_id").orderBy("pos")
    over = F.max(F.coalesce(_pause(F.col("ts"), F.lag("ts").over(w), ttl), F.lit(False))).over(w)
    lists = top.withColumn("over", over).groupBy("user_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "ts", "event_id", "asin", "over"))).alias("_rows")
    )
    return lists.select(
        "user_id", F.transform("_rows", lambda e: F.struct(e["ts"], e["event_id"], e["asin"])).alias("newest"),
        F.transform(F.filter("_rows", lambda e: ~e["over"]), lambda e: e["asin"]).alias("recent_items"),
    )


def _stretches(before: DataFrame, events: DataFrame, ttl: int, lowest: Column) -> DataFrame:
    """(user_id, stretches): categorised activity without a pause of ``ttl``, with its counts.

    Events are first folded into slots of ``ttl``, whose events are closer than that, so a busy user
    is a few rows.  A late event may extend or bridge stretches, so an older one is kept
    while an event that is not yet too late could bridge the pause after it.
    """
    slot = F.floor(F.unix_micros("ts") / (ttl * 1_000_000))
    fresh = events.filter(F.col("category") != "").groupBy("user_id", slot, F.col("category").alias("key")).agg(
        F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("value")
    ).select("user_id", "first", "last", "key", "value")
    old = before.select("user_id", F.inline("stretches")).select("user_id", "first", "last", F.inline("counts"))
    w = Window.partitionBy("user_id").orderBy("first", "last")
    until = F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.coalesce(_pause(until, F.col("first"), ttl), F.lit(True)).cast("int")
    named = fresh.unionByName(old).withColumn("_starts", starts).withColumn("_at", F.sum("_starts").over(w)).groupBy(
        "user_id", "_at", "key"
    ).agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("value").alias("value"))
    merged = named.groupBy("user_id", "_at").agg(
        F.min("first").alias("first"), F.max("last").alias("last"),
        F.array_sort(F.collect_list(F.struct("key", "value"))).alias("counts"),
    )
    following = F.lead("first").over(Window.partitionBy("user_id").orderBy("first"))
    open_ones = merged.withColumn("_next", following).withColumn("_lowest", lowest).filter(
        F.coalesce(F.col("_next") > F.col("_lowest"), F.lit(True))
    )
    return open_ones.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("first", "last", "counts"))).alias("stretches"))


def folded(before: DataFrame, events: DataFrame, ttl: int, limit: int, watermark: str) -> DataFrame:
    """The state of all users after (user_id, event_id, asin, ts, category) in any order, with the contexts it gives.

    ``before`` is the state without them.  ``touched`` marks users with events; others stay while an event on
    time could still find their last one less than ``ttl`` before it.  An event of the next batch is judged by
    the watermark that follows from the times in ``before``.
    """
    lowest = before.agg(F.max(F.get("newest", F.lit(0))["ts"]) - F.expr(f"INTERVAL '{watermark}'")).scalar()
    sides = _newest(before, events, ttl, limit).unionByName(
        _stretches(before, events, ttl, lowest), allowMissingColumns=True
    ).unionByName(events.select("user_id", F.lit(True).alias("touched")).distinct(), allowMissingColumns=True)
    columns = ["newest", "recent_items", "stretches", "touched"]
    users = sides.groupBy("user_id").agg(*[F.first(c, ignorenulls=True).alias(c) for c in columns])
    at, last = F.get("newest", F.lit(0))["ts"], F.try_element_at("stretches", F.lit(-1))
    live = F.when(~_pause(last["last"], at, ttl), F.map_from_entries(last["counts"]))
    touched = F.coalesce("touched", F.lit(False))
    reachable = F.coalesce(~_pause(at, F.col("_lowest"), ttl), F.lit(True))
    return users.withColumn("_lowest", lowest).filter(touched | reachable).select(
        "user_id", "newest", "stretches", touched.alias("touched"), "recent_items",
        F.coalesce(live, F.create_map().cast("map<string,bigint>")).alias("recent_categories"),
        F.unix_seconds(at).alias("last_active"),
    )


def sorter(
    items: DataFrame, products: DataFrame, folder: str, ttl: int = TTL_SECONDS, limit: int = RECENT_ITEMS,
    watermark: str = WATERMARK,
) -> Callable[[DataFrame, int], None]:
    """What is done with each micro-batch: staged once, then sorted into the three tables."""
    facts = keep(product_facts(items, products), "facts")
    spark = items.sparkSession

    def sort_batch(batch: DataFrame, number: int) -> None:
        staged = f"{folder}/staged/batch={number}"
        batch.write.mode("overwrite").partitionBy("kind").parquet(staged)
        # The engine hands the batch over in a session of its own, without adaptive plans.
        rows = spark.read.schema(batch.schema).parquet(staged)

        def of(kind: str) -> DataFrame:
            return rows.filter(F.col("kind") == kind).select(*_EVENT)

        first = of("first")
        others = first_per_group(of("seen"), ["event_id"], [F.col("ts"), F.col("user_id"), F.col("asin")])
        others = others.join(first.select("event_id"), "event_id", "left_anti").select(*_EVENT)
        late = _not_yet(others, f"{folder}/log", number, ["event_id"])
        arrived = first.withColumn("on_time", F.lit(True)).unionByName(late.withColumn("on_time", F.lit(False)))
        log = enriched_by(arrived, facts).select(*_LOG)
        _store(log, f"{folder}/log", number)
        bad = of("reject").distinct()
        _store(_not_yet(bad, f"{folder}/rejects", number, _EVENT), f"{folder}/rejects", number)
        logged = spark.read.schema(log.schema).parquet(f"{folder}/log/batch={number}")
        state = folded(
            _state(spark, f"{folder}/state", number - 1, batch.schema), logged.filter("on_time"), ttl, limit, watermark
        )
        state.write.mode("overwrite").parquet(f"{folder}/state/batch={number}")
        context = spark.read.schema(state.schema).parquet(f"{folder}/state/batch={number}").filter("touched")
        context.select(*_CONTEXT).write.mode("overwrite").parquet(f"{folder}/context/batch={number}")

    return sort_batch


def event_flow(
    events: DataFrame, items: DataFrame, products: DataFrame, folder: str, checkpoint: str,
    ttl: int = TTL_SECONDS, limit: int = RECENT_ITEMS, watermark: str = WATERMARK,
) -> StreamingQuery:
    """Start the flow over all that is there; the tables lie in ``folder``.

    ``events`` is a stream of (event_id, user_id, asin, event_type, ts, metadata).
    """
    kind = F.when(_accepted(), "seen").otherwise("reject")
    every = events.select(kind.alias("kind"), *_EVENT)
    on_time = events.filter(_accepted() & F.col("ts").isNotNull()).select(*_EVENT).withWatermark("ts", watermark)
    first = on_time.dropDuplicatesWithinWatermark(["event_id"])
    together = every.unionByName(first.withColumn("kind", F.lit("first")), allowMissingColumns=True)
    return (
        together.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
        .foreachBatch(sorter(items, products, folder, ttl, limit, watermark)).trigger(availableNow=True).start()
    )


def read_flow(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """One of the three tables; ``batch`` says which batch wrote a row."""
    return spark.read.parquet(f"{folder}/{table}")
