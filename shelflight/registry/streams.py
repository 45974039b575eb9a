"""Streaming forms, run over the whole event table to the end of the input."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelflight.functions.common import first_per_group
from shelflight.registry import query
from shelflight.registry.ctes import with_blocks
from shelflight.session import scratch_path
from shelflight.sources import testviews
from shelflight.streaming import events as stream
from shelflight.streaming import flow

_SCHEMA = "event_id bigint, user_id bigint, asin string, event_type string, ts timestamp, metadata string"
_TTL = 6 * 3600


def _log_stream(spark, sf, disorder_seconds=0):
    stream.prepare(spark)
    logs = testviews.interaction_logs(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    path = testviews.as_stream(logs, "event-stream", disorder_seconds=disorder_seconds)
    return stream.read_events(spark, path, _SCHEMA, files_per_trigger=1)


@query("A9_event_log_stream", with_blocks("""
  SELECT event_id, user_id, l.asin, event_type, ts, main_category AS category, brand
  FROM logs l LEFT JOIN items i USING (asin) LEFT JOIN products p ON i.parent_asin = p.parent_asin
  WHERE event_type IN ('view', 'click', 'add_to_cart', 'purchase', 'rate')""", "logs", "items", "products"))
def event_log_stream(spark, sf):
    log, rejects, state = (scratch_path(spark, n) for n in ("log", "rejects", "state"))
    stream.ingest(
        _log_stream(spark, sf), testviews.items(spark, sf), testviews.products(spark, sf), log, rejects, state
    ).awaitTermination()
    return spark.read.parquet(log).select(
        "event_id", "user_id", "asin", "event_type", F.col("ts").cast("timestamp_ntz").alias("ts"), "category", "brand"
    )


# The list and the counts after a user's last event, from all events in order; the stream gets them out of order.
@query("L3_context_stream", with_blocks(f"""
  SELECT user_id, recent_items, recent_categories, last_active FROM (
    SELECT user_id, list(asin ORDER BY pos) FILTER (expired = 0 AND pos <= 20) AS recent_items,
           epoch_us(max(ts)) // 1000000 AS last_active
    FROM (SELECT CAST(user_id AS VARCHAR) AS user_id, asin, pos, ts,
                 max(CASE WHEN date_diff('microsecond', ts, later) >= {_TTL * 1000000} THEN 1 ELSE 0 END)
                   OVER (PARTITION BY user_id ORDER BY pos) AS expired
          FROM (SELECT user_id, asin, ts, row_number() OVER w AS pos, coalesce(lag(ts) OVER w, ts) AS later
                FROM logs WINDOW w AS (PARTITION BY user_id ORDER BY ts DESC, event_id DESC))) GROUP BY 1)
  JOIN (
    SELECT user_id, string_agg(category || '=' || n, ',' ORDER BY category) AS recent_categories FROM (
      SELECT user_id, category, count(*) AS n FROM (
        SELECT CAST(user_id AS VARCHAR) AS user_id, event_type AS category, pos,
               max(CASE WHEN date_diff('microsecond', ts, later) >= {_TTL * 1000000} THEN 1 ELSE 0 END)
                 OVER (PARTITION BY user_id ORDER BY pos) AS expired
        FROM (SELECT user_id, event_type, ts, row_number() OVER w AS pos, coalesce(lag(ts) OVER w, ts) AS later
              FROM logs WINDOW w AS (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)))
      WHERE expired = 0 GROUP BY 1, 2) GROUP BY 1) USING (user_id)""", "logs"))
def context_stream(spark, sf):
    """What every user's context held after the user's last event; slices overlap by up to twenty minutes."""
    events = _log_stream(spark, sf, disorder_seconds=600).withColumn("category", F.col("event_type"))
    out = stream.drain(
        stream.context_updates(events, _TTL), scratch_path(spark, "context"), "update", scratch_path(spark, "state")
    )
    last = first_per_group(out, ["user_id"], [F.desc("batch")])
    counts = F.transform(
        F.array_sort(F.map_entries("recent_categories")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))
    )
    return last.select("user_id", "recent_items", F.array_join(counts, ",").alias("recent_categories"), "last_active")


def _flow(spark, sf):
    """The flow over the whole event table, every tenth event sent twice and every hundredth three times, out of order."""
    stream.prepare(spark)
    logs = testviews.interaction_logs(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    sent = F.when(F.col("event_id") % 100 == 0, 3).when(F.col("event_id") % 10 == 0, 2).otherwise(1)
    again = logs.withColumn("attempt", F.explode(F.sequence(F.lit(1), sent)))
    path = testviews.as_stream(again, "repeated-events", disorder_seconds=600)
    events = stream.read_events(spark, path, _SCHEMA, files_per_trigger=1)
    folder = scratch_path(spark, "flow")
    flow.event_flow(
        events, testviews.items(spark, sf), testviews.products(spark, sf), folder, scratch_path(spark, "state"), ttl=_TTL
    ).awaitTermination()
    return folder


@query("A9_append_once", with_blocks("""
  SELECT event_id, user_id, l.asin, event_type, ts, main_category AS category, brand,
         event_type IN ('view', 'click', 'add_to_cart', 'purchase', 'rate') AS accepted
  FROM logs l LEFT JOIN items i USING (asin) LEFT JOIN products p ON i.parent_asin = p.parent_asin
    AND event_type IN ('view', 'click', 'add_to_cart', 'purchase', 'rate')""", "logs", "items", "products"))
def append_once(spark, sf):
    """Log and rejects of the flow: every event once, however often it was sent."""
    folder = _flow(spark, sf)
    log = flow.read_flow(spark, folder, "log").withColumn("accepted", F.lit(True))
    bad = flow.read_flow(spark, folder, "rejects").withColumn("accepted", F.lit(False))
    return log.unionByName(bad, allowMissingColumns=True).select(
        "event_id", "user_id", "asin", "event_type", F.col("ts").cast("timestamp_ntz").alias("ts"), "category", "brand", "accepted"
    )


# Of the accepted events, the list and the counts of real categories after a user's last one.
@query("L1_event_flow", with_blocks(f"""
  SELECT * FROM (WITH named AS (
    SELECT user_id, event_id, l.asin, ts, main_category AS category
    FROM logs l LEFT JOIN items i USING (asin) LEFT JOIN products p ON i.parent_asin = p.parent_asin
    WHERE event_type IN ('view', 'click', 'add_to_cart', 'purchase', 'rate')),
  placed AS (
    SELECT *, max(CASE WHEN date_diff('microsecond', ts, later) >= {_TTL * 1000000} THEN 1 ELSE 0 END)
                OVER (PARTITION BY user_id ORDER BY pos) AS expired
    FROM (SELECT *, row_number() OVER w AS pos, coalesce(lag(ts) OVER w, ts) AS later
          FROM named WINDOW w AS (PARTITION BY user_id ORDER BY ts DESC, event_id DESC))),
  counted AS (
    SELECT *, max(CASE WHEN date_diff('microsecond', ts, later) >= {_TTL * 1000000} THEN 1 ELSE 0 END)
                OVER (PARTITION BY user_id ORDER BY pos) AS expired
    FROM (SELECT user_id, category, ts, row_number() OVER w AS pos,
                 coalesce(lag(ts) OVER w, (SELECT max(ts) FROM named m WHERE m.user_id = n.user_id)) AS later
          FROM named n WHERE category IS NOT NULL AND category <> ''
          WINDOW w AS (PARTITION BY user_id ORDER BY ts DESC, event_id DESC))),
  categories AS (
    SELECT user_id, string_agg(category || '=' || n, ',' ORDER BY category) AS recent_categories
    FROM (SELECT user_id, category, count(*) AS n FROM counted WHERE expired = 0 GROUP BY 1, 2) GROUP BY 1)
  SELECT user_id, recent_items, coalesce(recent_categories, '') AS recent_categories, last_active
  FROM (SELECT user_id, list(asin ORDER BY pos) FILTER (expired = 0 AND pos <= 20) AS recent_items,
               epoch_us(max(ts)) // 1000000 AS last_active FROM placed GROUP BY 1)
  LEFT JOIN categories USING (user_id))""", "logs", "items", "products"))
def event_flow(spark, sf):
    """Contexts that the same flow keeps, from categories of the catalogue and each event once."""
    out = flow.read_flow(spark, _flow(spark, sf), "context")
    last = first_per_group(out, ["user_id"], [F.desc("batch")])
    counts = F.transform(
        F.array_sort(F.map_entries("recent_categories")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))
    )
    return last.select("user_id", "recent_items", F.array_join(counts, ",").alias("recent_categories"), "last_active")


@query("L6_trending_stream", with_blocks("""
  SELECT h AS window_end, asin, count(*) AS view_count
  FROM logs, (SELECT unnest(generate_series(date_trunc('hour', (SELECT min(ts) FROM events)),
                            (SELECT max(ts) FROM events) + INTERVAL 25 HOURS, INTERVAL 1 HOUR)) AS h)
  WHERE event_type = 'view' AND ts < h AND ts >= h - INTERVAL 24 HOURS GROUP BY 1, 2""", "logs"))
def trending_stream(spark, sf):
    out = stream.drain(
        stream.trending_windows(_log_stream(spark, sf)), scratch_path(spark, "trending"), "update",
        scratch_path(spark, "state"),
    )
    last = first_per_group(out, ["window_end", "asin"], [F.desc("view_count")])
    return last.select(F.col("window_end").cast("timestamp_ntz").alias("window_end"), "asin", "view_count")


@query("L6_trending_panes", with_blocks("""
  SELECT h AS window_end, asin, count(*) AS view_count, count(DISTINCT user_id) AS unique_users,
         count(*) + 0.5 * count(DISTINCT user_id) AS score
  FROM logs, (SELECT unnest(generate_series(date_trunc('hour', (SELECT min(ts) FROM events)),
                            (SELECT max(ts) FROM events) + INTERVAL 25 HOURS, INTERVAL 1 HOUR)) AS h)
  WHERE event_type = 'view' AND ts < h AND ts >= h - INTERVAL 24 HOURS GROUP BY 1, 2""", "logs"))
def trending_panes(spark, sf):
    """Windows from hourly panes of each user, as the SQL counts users exactly and sketches estimate many."""
    out = stream.drain(
        stream.user_panes(_log_stream(spark, sf)), scratch_path(spark, "panes"), "update", scratch_path(spark, "state"),
    )
    last = first_per_group(out, ["pane", "asin", "user_id"], [F.desc("view_count")])
    return stream.windows_of_user_panes(last).withColumn("window_end", F.col("window_end").cast("timestamp_ntz"))


@query("L8_popularity_stream", with_blocks("""
  SELECT item_id, count(*) AS interaction_count, round(avg(rating), 6) AS mean_rating FROM interactions GROUP BY 1
""", "interactions"))
def popularity_stream(spark, sf):
    stream.prepare(spark)
    rows = testviews.interactions(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    path = testviews.as_stream(rows, "rating-stream")
    ratings = stream.read_events(spark, path, "user_id string, item_id string, rating double, ts timestamp", 1)
    out = stream.drain(
        stream.running_popularity(ratings), scratch_path(spark, "popularity"), "update", scratch_path(spark, "state")
    )
    last = first_per_group(out, ["item_id"], [F.desc("interaction_count")])
    return last.select("item_id", "interaction_count", F.round("mean_rating", 6).alias("mean_rating"))
