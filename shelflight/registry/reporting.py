"""Reports, trending, catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelflight.functions import rules
from shelflight.functions.categories import resolve_category
from shelflight.operators import catalog, coreness, kcore, popularity, reports, texts, title_index
from shelflight.operators import interactions as inter
from shelflight.registry import query
from shelflight.registry.cleaning import _DIRTY, _dirty
from shelflight.registry.ctes import CORE20, with_blocks
from shelflight.session import keep, scratch_path
from shelflight.sources import testviews
from shelflight.sources.tables import read_table


def rounded(df, *names):
    for n in names:
        df = df.withColumn(n, F.round(F.col(n).cast("double"), 6))
    return df


def _raw_interactions(spark, sf):
    """Interactions straight from the raw reviews, duplicates included."""
    return inter.build_interactions(testviews.reviews_normalized(spark, sf))


@query("E4_rating_distribution", with_blocks("""
  SELECT CAST(rating AS INTEGER) AS rating, count(*) AS count,
         round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM interactions GROUP BY 1""", "interactions"))
def rating_distribution(spark, sf):
    return rounded(reports.rating_distribution(testviews.interactions(spark, sf)), "percent")


@query("E5_category_distribution", with_blocks("""
  SELECT main_category AS category, count(*) AS count FROM products WHERE main_category IS NOT NULL
  GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 4""", "products"))
def category_distribution(spark, sf):
    return reports.category_distribution(testviews.products(spark, sf), "main_category", 4)


@query("E5_category_distribution_sql", with_blocks("""
  SELECT category, count(*) AS count FROM items GROUP BY 1""", "items"))
def category_distribution_sql(spark, sf):
    return reports.category_distribution(testviews.items(spark, sf), "category", keep_null=True)


@query("E6_top_items", with_blocks("""
  SELECT item_id, count(*) AS count FROM interactions GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""", "interactions"))
def top_items(spark, sf):
    return reports.top_items(testviews.interactions(spark, sf), 10)


@query("E7_interaction_stats", with_blocks("""
  SELECT count(*) AS total_interactions, count(DISTINCT user_id) AS unique_users,
         count(DISTINCT item_id) AS unique_items, round(avg(rating), 6) AS avg_rating,
         min(rating) AS min_rating, max(rating) AS max_rating,
         count(*) FILTER (ts < last_ts) AS train_count, count(*) FILTER (ts = last_ts) AS test_count,
         round(count(*) FILTER (ts < last_ts) / count(*), 6) AS train_ratio,
         round(count(*) FILTER (ts = last_ts) / count(*), 6) AS test_ratio FROM split""", "split"))
def interaction_stats(spark, sf):
    rows = reports.interaction_stats(testviews.interactions(spark, sf))
    return rounded(rows, "avg_rating", "train_ratio", "test_ratio")


@query("E8_table_stats", with_blocks("""
  SELECT count(*) AS total_items, 8 AS columns, count(DISTINCT main_category) AS unique_categories,
         count(DISTINCT parent_asin) AS unique_items FROM products""", "products"))
def table_stats(spark, sf):
    return reports.table_stats(testviews.products(spark, sf), "parent_asin").drop("schema")


@query("E9_user_activity_histogram", with_blocks("""
  SELECT b.band, b.range, count(n) AS count FROM
    (VALUES (0,'[0,5)',0,5),(1,'[5,10)',5,10),(2,'[10,20)',10,20),(3,'[20,50)',20,50),(4,'[50,100)',50,100),
            (5,'[100,200)',100,200),(6,'[200,500)',200,500),(7,'[500,inf)',500,1000000000)) b(band, range, lo, hi)
    LEFT JOIN (SELECT count(*) AS n FROM interactions GROUP BY user_id) ON n >= lo AND n < hi
  GROUP BY 1, 2""", "interactions"))
def user_activity_histogram(spark, sf):
    return reports.user_activity_histogram(testviews.interactions(spark, sf))


@query("E9_user_activity_profile", with_blocks("""
  SELECT count(*) AS groups, round(avg(n), 6) AS mean, min(n) AS min, max(n) AS max, median(n) AS median
  FROM (SELECT count(*) AS n FROM interactions GROUP BY user_id)""", "interactions"))
def user_activity_profile(spark, sf):
    return rounded(reports.group_count_profile(testviews.interactions(spark, sf), "user_id"), "mean")


@query("E11_cleaning_report", with_blocks(f"""
  SELECT sum(n) AS before, count(*) FILTER (sane > 0) AS after, sum(n) - count(*) FILTER (sane > 0) AS dropped,
         round(100.0 * count(*) FILTER (sane > 0) / sum(n), 6) AS retention_pct,
         sum(n) - sum(keyed) AS task1_dropped, sum(keyed) - sum(sane) AS task2_dropped,
         sum(sane) - count(*) FILTER (sane > 0) AS task3_dropped,
         round(100.0 * (sum(n) - sum(keyed)) / sum(n), 6) AS task1_pct,
         round(100.0 * (sum(keyed) - sum(sane)) / sum(n), 6) AS task2_pct,
         round(100.0 * (sum(sane) - count(*) FILTER (sane > 0)) / sum(n), 6) AS task3_pct,
         sum(nu) AS missing_amazon_user_id, 0 AS missing_asin, 0 AS missing_rating,
         sum(nt) AS missing_review_title, 0 AS missing_review_text
  FROM (SELECT amazon_user_id, asin, count(*) AS n, count(amazon_user_id) AS keyed,
               count(*) FILTER (amazon_user_id IS NOT NULL AND rating BETWEEN 1 AND 5) AS sane,
               count(*) FILTER (amazon_user_id IS NULL) AS nu, count(*) FILTER (review_title IS NULL) AS nt
        FROM ({_DIRTY}) GROUP BY 1, 2)""", "reviews_norm"))
def cleaning_report(spark, sf):
    return rounded(
        reports.cleaning_report(_dirty(spark, sf)), "retention_pct", "task1_pct", "task2_pct", "task3_pct"
    )


@query("E11_core_retention", with_blocks(f"""
  SELECT a.n AS all_rows, a.u AS all_users, a.i AS all_items, c.n AS core_rows, c.u AS core_users, c.i AS core_items,
         round(100.0 * c.n / a.n, 6) AS rows_retention, round(100.0 * c.u / a.u, 6) AS users_retention,
         round(100.0 * c.i / a.i, 6) AS items_retention
  FROM (SELECT count(*) n, count(DISTINCT user_id) u, count(DISTINCT item_id) i FROM interactions) a,
       (SELECT count(*) n, count(DISTINCT user_id) u, count(DISTINCT item_id) i FROM {CORE20}) c""", CORE20))
def core_retention(spark, sf):
    rows = testviews.interactions(spark, sf)
    out = reports.core_retention(rows, kcore.k_core(rows, 20).rows)
    return rounded(out, "rows_retention", "users_retention", "items_retention")


@query("E12_token_stats", """
  SELECT count(*) AS total_items, round(avg(n), 6) AS avg_tokens, min(n) AS min_tokens, max(n) AS max_tokens,
         round(stddev_samp(n), 6) AS std_tokens, median(n) AS median_tokens
  FROM (SELECT len(string_split(text, ' ')) AS n FROM documents)""")
def token_stats(spark, sf):
    return rounded(reports.token_stats(read_table(spark, sf, "documents"), "text"), "avg_tokens", "std_tokens")


@query("E12_token_distribution", """
  SELECT CASE WHEN n < 50 THEN '[0,50)' WHEN n < 100 THEN '[50,100)' WHEN n < 200 THEN '[100,200)'
              WHEN n < 300 THEN '[200,300)' WHEN n < 500 THEN '[300,500)' WHEN n < 1000 THEN '[500,1000)'
              ELSE '[1000,inf)' END AS range,
         count(*) AS count, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent
  FROM (SELECT len(string_split(text, ' ')) AS n FROM documents) GROUP BY 1""")
def token_distribution(spark, sf):
    return rounded(reports.token_distribution(read_table(spark, sf, "documents"), "text"), "percent")


@query("E13_review_quality", with_blocks(f"""
  SELECT count(*) AS total_rows, count(*) - count(DISTINCT coalesce(amazon_user_id, 'none') || '|' || asin) AS duplicates,
         count(*) FILTER (rating < 1 OR rating > 5 OR rating IS NULL) AS invalid_ratings,
         count(*) FILTER (amazon_user_id IS NULL) AS null_amazon_user_id,
         count(*) FILTER (review_title IS NULL) AS null_review_title,
         count(*) FILTER (verified IS NULL) AS null_verified,
         count(*) FILTER (trim(review_text) = '') AS empty_review_text,
         round(100 - 100.0 * (count(*) - count(DISTINCT coalesce(amazon_user_id, 'none') || '|' || asin)) / count(*), 6)
           AS score_reference,
         round(greatest(0, 100 - 100.0 * (count(*) - count(DISTINCT coalesce(amazon_user_id, 'none') || '|' || asin)) / count(*)
           - 100.0 * count(*) FILTER (rating < 1 OR rating > 5) / count(*)
           - 100.0 * count(*) FILTER (amazon_user_id IS NULL) / count(*) / 3), 6) AS score
  FROM ({_DIRTY})""", "reviews_norm"))
def review_quality(spark, sf):
    out = rounded(reports.review_quality(_dirty(spark, sf)), "score_reference", "score")
    return out.select(
        "total_rows", "duplicates", "invalid_ratings", "null_amazon_user_id", "null_review_title",
        "null_verified", "empty_review_text", "score_reference", "score",
    )


@query("E13_metadata_quality", with_blocks("""
  SELECT count(*) AS total_rows, 0 AS duplicates, 0 AS missing_title,
         count(*) FILTER (main_category = 'All Beauty') AS missing_category,
         count(*) FILTER (store IS NULL) AS null_store, count(*) FILTER (details IS NULL) AS null_details,
         100.0 AS score_reference,
         round(100 - 100.0 * count(*) FILTER (main_category = 'All Beauty') / count(*), 6) AS score
  FROM meta""", "meta"))
def metadata_quality(spark, sf):
    out = rounded(reports.metadata_quality(testviews.metadata_raw(spark, sf)), "score_reference", "score")
    return out.select(
        "total_rows", "duplicates", "missing_title", "missing_category", "null_store", "null_details",
        "score_reference", "score",
    )


@query("E13_null_profile", with_blocks(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls,"
    f" round(100.0 * (count(*) - count({c})) / count(*), 6) AS percent FROM ({_DIRTY})"
    for c in ("amazon_user_id", "asin", "parent_asin", "rating", "review_title", "review_text", "helpful_vote",
              "verified", "ts")), "reviews_norm"))
def null_profile(spark, sf):
    return rounded(reports.null_profile(_dirty(spark, sf)), "percent")


@query("E14_item_count_profile", with_blocks("""
  SELECT count(*) AS groups, round(avg(n), 6) AS mean, min(n) AS min, max(n) AS max, median(n) AS median
  FROM (SELECT count(*) AS n FROM interactions GROUP BY item_id)""", "interactions"))
def item_count_profile(spark, sf):
    return rounded(reports.group_count_profile(testviews.interactions(spark, sf), "item_id"), "mean")


@query("E14_test_items_per_user", with_blocks("""
  SELECT count(*) AS groups, round(avg(n), 6) AS mean, min(n) AS min, max(n) AS max, median(n) AS median
  FROM (SELECT count(DISTINCT item_id) AS n FROM test GROUP BY user_id)""", "test"))
def test_items_per_user(spark, sf):
    test = inter.split_last_out(testviews.interactions(spark, sf))[1]
    return rounded(reports.distinct_per_group_profile(test, "user_id", "item_id"), "mean")


@query("E15_trending", with_blocks("""
  SELECT asin, count(*) AS view_count, count(DISTINCT user_id) AS unique_users,
         count(*) + 0.5 * count(DISTINCT user_id) AS score
  FROM logs WHERE event_type = 'view' AND ts >= (SELECT max(ts) FROM events) - INTERVAL 240 HOURS
  GROUP BY asin ORDER BY 2 DESC, 3 DESC, 1 LIMIT 50""", "logs"))
def trending(spark, sf):
    logs = testviews.interaction_logs(spark, sf)
    return reports.trending(logs, logs.agg(F.max("ts")).scalar(), hours=240, limit=50)


@query("E16_dominant_category", with_blocks("""
  SELECT parent_asin, p.main_category AS old_category, b.category AS new_category, n AS item_count,
         p.main_category IS NULL OR p.main_category <> b.category OR p.main_category = 'All Beauty' AS "update"
  FROM (SELECT parent_asin, category, count(*) AS n FROM items WHERE coalesce(category, '') <> ''
        GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY parent_asin ORDER BY n DESC, category) = 1) b
  JOIN products p USING (parent_asin)""", "items", "products"))
def dominant_category(spark, sf):
    return catalog.dominant_category(testviews.items(spark, sf), testviews.products(spark, sf))


@query("E16_category_update_counts", with_blocks("""
  SELECT count(*) FILTER (category <> main_category OR main_category = 'All Beauty') AS updated,
         count(*) FILTER (category = main_category AND main_category <> 'All Beauty') AS unchanged
  FROM (SELECT DISTINCT parent_asin, category FROM items WHERE category IS NOT NULL) JOIN products USING (parent_asin)
""", "items", "products"))
def category_update_counts(spark, sf):
    return catalog.category_update_counts(
        catalog.dominant_category(testviews.items(spark, sf), testviews.products(spark, sf))
    )


@query("E18_rating_before_after", with_blocks(f"""
  SELECT r AS rating, (SELECT count(*) FROM ({_DIRTY}) WHERE rating = r) AS before,
         (SELECT count(*) FROM (SELECT rating FROM ({_DIRTY}) WHERE amazon_user_id IS NOT NULL
            AND rating BETWEEN 1 AND 5 QUALIFY row_number() OVER (PARTITION BY amazon_user_id, asin
            ORDER BY ts DESC, greatest(coalesce(helpful_vote, 0), 0) DESC, rating DESC) = 1) WHERE rating = r) AS after
  FROM (VALUES (1), (2), (3), (4), (5)) t(r)""", "reviews_norm"))
def rating_before_after(spark, sf):
    from shelflight.operators.reviews import clean_reviews

    dirty = _dirty(spark, sf)
    return reports.rating_before_after(dirty, clean_reviews(dirty))


def _text_view(spark, sf):
    from shelflight.operators.metadata import text_view

    return text_view(testviews.metadata_raw(spark, sf))


@query("E20_category_changes", with_blocks(f"""
  SELECT new AS category, count(*) AS count, count(*) FILTER (new <> old) AS changed
  FROM (SELECT main_category AS old, CASE WHEN main_category <> 'All Beauty' THEN main_category
       WHEN categories[1] <> 'All Beauty' THEN categories[1]
       WHEN details['category'] IS NOT NULL THEN details['category'] ELSE CASE {" ".join(
           f"WHEN contains(lower(title), '{k}') THEN '{v}'" for k, v in rules.CATEGORY_KEYWORDS_WIDE
       )} ELSE 'Beauty' END END AS new FROM meta) GROUP BY 1""", "meta"))
def category_changes(spark, sf):
    meta = testviews.metadata_normalized(spark, sf)
    resolved = meta.withColumn(
        "resolved", resolve_category(F.col("main_category"), F.col("raw_metadata"), wide=True)
    )
    return reports.value_changes(resolved, "main_category", "resolved")


def _profile_sql(source: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", round(min({c}), 6) AS min, round(max({c}), 6) AS max, round(avg({c}), 6) AS mean,"
        f" round(median({c}), 6) AS median, round(stddev_pop({c}), 6) AS std, count({c}) AS filled FROM {source}"
        for c in columns
    )


@query("E21_popularity_profile", with_blocks(
    _profile_sql("popularity", ["interaction_count", "mean_rating"]), "popularity"))
def popularity_profile(spark, sf):
    stats = popularity.popularity_stats(testviews.interactions(spark, sf))
    return rounded(
        reports.column_profile(stats, ["interaction_count", "mean_rating"]), "min", "max", "mean", "median", "std"
    )


@query("E21_price_profile", _profile_sql("lineitem", ["l_extendedprice", "l_discount"]))
def price_profile(spark, sf):
    lines = read_table(spark, sf, "lineitem")
    return rounded(
        reports.column_profile(lines, ["l_extendedprice", "l_discount"]), "min", "max", "mean", "median", "std"
    )


@query("E22_text_length_profile", """
  SELECT count(*) AS texts, round(avg(n), 6) AS mean, min(n) AS min, max(n) AS max, median(n) AS median,
         count(*) FILTER (n = 0) AS empty,
         round(100.0 * count(*) FILTER (n BETWEEN 200 AND 400) / count(*), 6) AS pct_200_400
  FROM (SELECT length(text) AS n FROM documents)""")
def text_length_profile(spark, sf):
    return rounded(reports.length_profile(read_table(spark, sf, "documents"), "text"), "mean", "pct_200_400")


@query("E23_norm_profile", with_blocks("""
  SELECT count(*) AS vectors, round(avg(n), 5) AS mean_norm, round(min(n), 5) AS min_norm, round(max(n), 5) AS max_norm
  FROM (SELECT sqrt(list_sum(list_transform(embedding, lambda x: x * x))) AS n FROM vectors)""", "vectors"))
def norm_profile(spark, sf):
    out = reports.norm_profile(testviews.item_vectors(spark, sf))
    return out.select("vectors", *[F.round(c, 5).alias(c) for c in ("mean_norm", "min_norm", "max_norm")])


@query("E24_cleaning_steps", with_blocks(f"""
  SELECT step, task, count, round(100.0 * count / max(count) OVER (), 6) AS percent FROM (
    SELECT 0 AS step, 'Initial' AS task, (SELECT count(*) FROM ({_DIRTY})) AS count
    UNION ALL SELECT 1, 'After Task 1', (SELECT count(amazon_user_id) FROM ({_DIRTY}))
    UNION ALL SELECT 2, 'After Task 2', (SELECT count(*) FROM ({_DIRTY})
      WHERE amazon_user_id IS NOT NULL AND rating BETWEEN 1 AND 5)
    UNION ALL SELECT 3, 'After Task 3', (SELECT count(DISTINCT (amazon_user_id, asin)) FROM ({_DIRTY})
      WHERE amazon_user_id IS NOT NULL AND rating BETWEEN 1 AND 5))""", "reviews_norm"))
def cleaning_steps(spark, sf):
    return rounded(reports.cleaning_steps(_dirty(spark, sf)), "percent")


# --- catalogue -----------------------------------------------------------------------

@query("B12_search_items", with_blocks("""
  SELECT asin, title, store, main_category, category, total, 60 < total AS has_more
  FROM (SELECT i.asin, p.title, p.store, p.main_category, i.category, count(*) OVER () AS total
        FROM items i JOIN products p USING (parent_asin)
        WHERE contains(lower(p.title), 'ring') AND (p.main_category = 'PROMO' OR i.category = 'PROMO'))
  ORDER BY asin LIMIT 20 OFFSET 40""", "items", "products"))
def search_items(spark, sf):
    page = catalog.search_items(
        testviews.items(spark, sf), testviews.products(spark, sf), "RiNg", "PROMO", page=3, page_size=20
    )
    return page.select("asin", "title", "store", "main_category", "category", "total", "has_more")


@query("B12_search_total", with_blocks("""
  SELECT count(DISTINCT asin) AS total FROM items i JOIN products p USING (parent_asin)
  WHERE contains(lower(p.title), 'hair')""", "items", "products"))
def search_total(spark, sf):
    return catalog.search_total(testviews.items(spark, sf), testviews.products(spark, sf), "hair")


# Every part wants a piece of its own name, from one to six characters long.
@query("B12_search_many", with_blocks("""
  SELECT wanted, count(*) AS titles, min(p.parent_asin) AS first_asin
  FROM (SELECT DISTINCT substr(p_name, 2 + p_partkey % 4, 1 + p_partkey % 6) AS wanted FROM part) q
  JOIN products p ON contains(lower(p.title), lower(wanted)) WHERE wanted <> '' GROUP BY wanted""", "products"))
def search_many(spark, sf):
    key = F.col("p_partkey")
    wanted = read_table(spark, sf, "part").select(
        F.substring("p_name", (key % 4 + 2).cast("int"), (key % 6 + 1).cast("int")).alias("text")
    ).distinct().withColumn("query_id", F.col("text"))
    index = title_index.build_title_index(testviews.products(spark, sf), scratch_path(spark, "titles"))
    return title_index.search_titles(index, wanted).groupBy(F.col("query_id").alias("wanted")).agg(
        F.count("*").alias("titles"), F.min("parent_asin").alias("first_asin")
    )


@query("B13_items_in_order", with_blocks("""
  SELECT pos, i.asin, p.title, coalesce(nullif(i.primary_image, ''), p.primary_image) AS image
  FROM (SELECT event_id AS pos, asin FROM logs) r JOIN items i USING (asin) JOIN products p USING (parent_asin)
""", "logs", "items", "products"))
def items_in_order(spark, sf):
    requested = testviews.interaction_logs(spark, sf).select(F.col("event_id").alias("pos"), "asin")
    return catalog.items_in_order(
        requested, testviews.items(spark, sf), testviews.products(spark, sf)
    ).select("pos", "asin", "title", "image")


# For the category rules the catalogue of half-known goods: specific product categories only.
_BARE = "(SELECT * REPLACE (CASE WHEN main_category IN ('PROMO', 'LARGE') THEN main_category END AS main_category) FROM products)"


def _bare_products(spark, sf):
    return testviews.products(spark, sf).withColumn(
        "main_category", F.when(F.col("main_category").isin("PROMO", "LARGE"), F.col("main_category"))
    )


@query("B14_keys_with_category", with_blocks(f"""
  SELECT DISTINCT unnest([asin, parent_asin]) AS key FROM items JOIN {_BARE} p USING (parent_asin)
  WHERE coalesce(category, '') <> '' OR coalesce(main_category, '') <> ''""", "items", "products"))
def keys_with_category(spark, sf):
    return catalog.keys_with_category(testviews.items(spark, sf), _bare_products(spark, sf))


@query("B14_items_without_category", with_blocks(f"""
  SELECT asin, parent_asin FROM items JOIN {_BARE} p USING (parent_asin)
  WHERE coalesce(category, '') = '' AND coalesce(main_category, '') = ''""", "items", "products"))
def items_without_category(spark, sf):
    return catalog.items_without_category(
        testviews.items(spark, sf), _bare_products(spark, sf)
    ).select("asin", "parent_asin")


def _droppable(spark, sf):
    # Only the items of the core are asked for, so no interactions are kept or joined.
    core = coreness.coreness(testviews.interactions(spark, sf), most=20, least=20).items
    keys = core.filter(F.col("level") >= 20).select(F.col("item_id").alias("key"))
    return catalog.droppable_items(testviews.items(spark, sf), _bare_products(spark, sf), keys)


_DROPPED = f"""
  SELECT asin, parent_asin FROM items JOIN {_BARE} p USING (parent_asin)
  WHERE coalesce(category, '') = '' AND coalesce(main_category, '') = ''
    AND asin NOT IN (SELECT item_id FROM {CORE20}) AND parent_asin NOT IN (SELECT item_id FROM {CORE20})"""


@query("B15_droppable_items", with_blocks(_DROPPED, "items", "products", CORE20))
def droppable_items(spark, sf):
    return _droppable(spark, sf).select("asin", "parent_asin")


@query("B15_drop_counts", with_blocks(f"""
  SELECT 'interaction_logs' AS "table", count(*) AS rows FROM logs WHERE asin IN (SELECT asin FROM ({_DROPPED}))
  UNION ALL SELECT 'reviews', count(*) FROM reviews_clean WHERE asin IN (SELECT asin FROM ({_DROPPED}))
  UNION ALL SELECT 'items', count(*) FROM items WHERE asin IN (SELECT asin FROM ({_DROPPED}))
  UNION ALL SELECT 'cart_items', count(*) FROM cart_items WHERE asin IN (SELECT asin FROM ({_DROPPED}))
  UNION ALL SELECT 'products', count(*) FROM products WHERE parent_asin IN (SELECT parent_asin FROM ({_DROPPED}))
    AND parent_asin NOT IN (SELECT parent_asin FROM items WHERE asin NOT IN (SELECT asin FROM ({_DROPPED})))
""", "items", "products", "logs", "reviews_clean", "cart_items", CORE20))
def drop_counts(spark, sf):
    dropped = keep(_droppable(spark, sf), "dropped")
    counts = catalog.drop_counts(dropped, {
        "cart_items": (testviews.cart_items(spark, sf), "asin"),
        "interaction_logs": (testviews.interaction_logs(spark, sf), "asin"),
        "reviews": (testviews.reviews_clean(spark, sf), "asin"),
        "items": (testviews.items(spark, sf), "asin"),
    })
    orphans = catalog.orphan_products(testviews.items(spark, sf), testviews.products(spark, sf), dropped)
    return counts.unionByName(orphans.agg(F.count("*").alias("rows")).select(F.lit("products").alias("table"), "rows"))


@query("B15_cascade_carts", with_blocks(f"""
  SELECT cart_id, asin, quantity FROM cart_items WHERE asin NOT IN (SELECT asin FROM ({_DROPPED}))
""", "items", "products", "cart_items", CORE20))
def cascade_carts(spark, sf):
    return catalog.without_items(testviews.cart_items(spark, sf), _droppable(spark, sf)).select("cart_id", "asin", "quantity")


@query("B15_cascade_products", with_blocks(f"""
  SELECT parent_asin FROM products WHERE parent_asin NOT IN (SELECT parent_asin FROM ({_DROPPED}))
    OR parent_asin IN (SELECT parent_asin FROM items WHERE asin NOT IN (SELECT asin FROM ({_DROPPED})))
""", "items", "products", CORE20))
def cascade_products(spark, sf):
    products = testviews.products(spark, sf).select("parent_asin")
    orphans = catalog.orphan_products(testviews.items(spark, sf), products, _droppable(spark, sf))
    return products.join(orphans, "parent_asin", "left_anti")


@query("B15_cascade_reviews", with_blocks(f"""
  SELECT amazon_user_id, asin, ts FROM reviews_clean WHERE asin NOT IN (SELECT asin FROM ({_DROPPED}))
""", "items", "products", "reviews_clean", CORE20))
def cascade_reviews(spark, sf):
    return catalog.without_items(testviews.reviews_clean(spark, sf), _droppable(spark, sf)).select(
        "amazon_user_id", "asin", "ts"
    )


@query("B15_orphan_products", with_blocks(f"""
  SELECT parent_asin FROM products WHERE parent_asin IN (SELECT parent_asin FROM ({_DROPPED}))
    AND parent_asin NOT IN (SELECT parent_asin FROM items WHERE asin NOT IN (SELECT asin FROM ({_DROPPED})))
""", "items", "products", CORE20))
def orphan_products(spark, sf):
    return catalog.orphan_products(
        testviews.items(spark, sf), testviews.products(spark, sf), _droppable(spark, sf)
    ).select("parent_asin")


_KEYS = f"""(SELECT DISTINCT unnest([asin, parent_asin]) FROM items JOIN {_BARE} p USING (parent_asin)
  WHERE coalesce(category, '') <> '' OR coalesce(main_category, '') <> '')"""


@query("B16_retained_vectors", with_blocks(f"""
  SELECT item_id, category FROM vectors WHERE item_id IN {_KEYS}""", "vectors", "items", "products"))
def retained_vectors(spark, sf):
    keys = catalog.keys_with_category(testviews.items(spark, sf), _bare_products(spark, sf))
    return catalog.retained(testviews.item_vectors(spark, sf), keys, "item_id").select("item_id", "category")


@query("B16_retention_report", with_blocks(f"""
  SELECT count(*) AS total, count(*) FILTER (parent_asin IN {_KEYS}) AS kept,
         count(*) FILTER (parent_asin NOT IN {_KEYS}) AS removed,
         round(100.0 * count(*) FILTER (parent_asin IN {_KEYS}) / count(*), 6) AS kept_pct
  FROM meta""", "meta", "items", "products"))
def retention_report(spark, sf):
    keys = catalog.keys_with_category(testviews.items(spark, sf), _bare_products(spark, sf))
    texts_ = texts.compact_texts(texts.semantic_attributes(_text_view(spark, sf)))
    return rounded(catalog.retention_report(texts_, keys, "parent_asin"), "kept_pct")
