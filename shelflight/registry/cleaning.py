"""Ingest, cleaning, interactions, k-core, popularity."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelflight.functions import rules
from shelflight.operators import interactions as inter
from shelflight.operators import coreness, kcore, metadata, popularity, reviews
from shelflight.registry import query
from shelflight.registry.ctes import CORE5, CORE20, CORE25, with_blocks
from shelflight.session import keep, scratch_path
from shelflight.schemas import METADATA_RAW, REVIEWS_RAW
from shelflight.sources import jsonl, sinks, tables, testviews


@query("E2_core_popularity", with_blocks(f"""
  SELECT item_id, interaction_count, round(mean_rating, 6) AS mean_rating,
         round((l - min(l) OVER ()) / (max(l) OVER () - min(l) OVER ()), 6) AS popularity_score
  FROM (SELECT item_id, count(*) AS interaction_count, avg(rating) AS mean_rating,
               ln(1 + count(*)) AS l FROM {CORE5} GROUP BY item_id)""", CORE5))
def core_popularity(spark, sf):
    core = kcore.k_core(testviews.interactions(spark, sf), 5)
    stats = popularity.popularity_stats(core.rows)
    normal = popularity.normalize_popularity(stats)
    return normal.join(stats, "item_id").select(
        "item_id", "interaction_count", F.round("mean_rating", 6).alias("mean_rating"),
        F.round("popularity_score", 6).alias("popularity_score"),
    )


# --- A: sources and sinks ------------------------------------------------------------

def _json_lines(df, broken):
    """Rows as JSON text, every so often cut short so that it no longer parses."""
    text = F.to_json(F.struct(*df.columns))
    return df.select(F.when(F.expr(broken), F.substring(text, 1, 20)).otherwise(text).alias("value"))


# Lines of returned goods arrive truncated.
_REVIEW_CUT = "NOT verified_purchase"


@query("A1_jsonl_reviews", with_blocks("""
  SELECT user_id, asin, parent_asin, rating, title, text, helpful_vote, verified_purchase,
         epoch_ms(ts) AS timestamp
  FROM reviews_raw WHERE verified_purchase""", "reviews_raw"))
def jsonl_reviews(spark, sf):
    path = scratch_path(spark, "reviews-jsonl")
    _json_lines(testviews.reviews_raw(spark, sf), _REVIEW_CUT).write.text(path)
    return jsonl.read_jsonl(spark, path, REVIEWS_RAW)


@query("A1_jsonl_bad_lines", with_blocks("""
  SELECT count(*) AS lines, count(*) FILTER (verified_purchase) AS kept,
         count(*) FILTER (NOT verified_purchase) AS skipped FROM reviews_raw""", "reviews_raw"))
def jsonl_bad_lines(spark, sf):
    return jsonl.line_counts(_json_lines(testviews.reviews_raw(spark, sf), _REVIEW_CUT), REVIEWS_RAW)


@query("A2_jsonl_metadata", with_blocks("""
  SELECT parent_asin, title, store, main_category, round(average_rating, 6) AS average_rating, rating_number,
         price, array_to_string(categories, '|') AS categories, array_to_string(features, '|') AS features,
         details['Material'] AS material
  FROM meta WHERE store IS NOT NULL""", "meta"))
def jsonl_metadata(spark, sf):
    path = scratch_path(spark, "metadata-jsonl")
    _json_lines(testviews.metadata_raw(spark, sf), "store IS NULL").write.text(path)
    return jsonl.read_jsonl(spark, path, METADATA_RAW).select(
        "parent_asin", "title", "store", "main_category", F.round("average_rating", 6).alias("average_rating"),
        "rating_number", "price", F.array_join("categories", "|").alias("categories"),
        F.array_join("features", "|").alias("features"), F.col("details")["Material"].alias("material"),
    )


@query("A3_parquet_first_existing", with_blocks("""
  SELECT user_id, item_id, rating, ts FROM interactions""", "interactions"))
def parquet_first_existing(spark, sf):
    path = scratch_path(spark, "interactions")
    tables.write_table(testviews.interactions(spark, sf), path)
    return tables.read_first(spark, [path + "-missing", path])


@query("A4_insert_ignore_products", with_blocks("""
  SELECT parent_asin, CASE WHEN store IS NULL THEN 'old' ELSE title END AS title
  FROM meta""", "meta"))
def insert_ignore_products(spark, sf):
    clean = testviews.metadata_clean(spark, sf)
    loaded = sinks.products_for_load(inter.items_for_rs(clean))
    target = scratch_path(spark, "products")
    known = loaded.filter(F.col("store") == "Unknown").withColumn("title", F.lit("old"))
    known.write.parquet(target)
    table = sinks.append_new(loaded.unionByName(loaded), target, "parent_asin", [F.col("title").asc()])
    return table.select("parent_asin", "title")


@query("A5_items_from_reviews", with_blocks("""
  SELECT asin, min(parent_asin) AS parent_asin FROM reviews_clean
  WHERE asin IS NOT NULL AND parent_asin IS NOT NULL GROUP BY asin""", "reviews_clean"))
def items_from_reviews(spark, sf):
    return sinks.items_from_reviews(testviews.reviews_clean(spark, sf))


@query("A6_append_reviews", with_blocks("""
  SELECT amazon_user_id, asin, rating, helpful_vote, ts AS review_ts, CAST(NULL AS BIGINT) AS user_id
  FROM reviews_clean""", "reviews_clean"))
def append_reviews(spark, sf):
    target = scratch_path(spark, "reviews-table")
    sinks.reviews_for_load(testviews.reviews_clean(spark, sf)).write.mode("append").parquet(target)
    return spark.read.parquet(target).select(
        "amazon_user_id", "asin", "rating", "helpful_vote", "review_ts", "user_id"
    )


def _scaled(factor):
    return F.transform("embedding", lambda x: (x * factor).cast("float"))


@query("A7_upsert_vectors", with_blocks("""
  SELECT item_id, round(embedding[1] * CASE WHEN category = '3' THEN 3 ELSE 1 END, 5) AS first_value,
         CAST(('0x' || substr(md5(item_id), 1, 16))::UBIGINT % 9223372036854775808 AS BIGINT) AS id
  FROM vectors""", "vectors"))
def upsert_vectors(spark, sf):
    """All vectors stored, then category 3 sent twice in one batch: the copy that arrives last stays."""
    vectors = testviews.item_vectors(spark, sf)
    path = scratch_path(spark, "vectors")
    sinks.upsert_table(sinks.vectors_for_load(vectors).withColumn("seq", F.lit(0)), path, "id", [F.desc("seq")])
    batch = None
    for seq, factor in ((1, 2), (2, 3)):
        rows = sinks.vectors_for_load(
            vectors.filter(F.col("category") == "3").withColumn("embedding", _scaled(factor))
        )
        rows = rows.withColumn("seq", F.lit(seq))
        batch = rows if batch is None else batch.unionByName(rows)
    merged = sinks.upsert_table(batch, path, "id", [F.desc("seq")])
    return merged.select(
        "id", "item_id", F.round(F.get("embedding", F.lit(0)).cast("double"), 5).alias("first_value")
    )


# --- B: projection, filters, types ---------------------------------------------------

@query("B1_normalize_reviews", with_blocks("SELECT * FROM reviews_norm", "reviews_norm"))
def normalize_reviews(spark, sf):
    return testviews.reviews_normalized(spark, sf)


@query("B2_normalize_metadata", with_blocks("""
  SELECT parent_asin, title, store, main_category, round(average_rating, 6) AS avg_rating, rating_number, price,
         primary_image, title AS json_title, details['Color'] AS json_color, categories[1] AS json_category
  FROM meta""", "meta"))
def normalize_metadata(spark, sf):
    return testviews.metadata_normalized(spark, sf).select(
        "parent_asin", "title", "store", "main_category", F.round("avg_rating", 6).alias("avg_rating"),
        "rating_number", "price", "primary_image",
        F.get_json_object("raw_metadata", "$.title").alias("json_title"),
        F.get_json_object("raw_metadata", "$.details.Color").alias("json_color"),
        F.get_json_object("raw_metadata", "$.categories[0]").alias("json_category"),
    )


@query("B3_primary_image", with_blocks("SELECT parent_asin, primary_image FROM meta", "meta"))
def primary_image(spark, sf):
    return testviews.metadata_raw(spark, sf).select(
        "parent_asin", metadata.primary_image(F.col("images")).alias("primary_image")
    )


_DIRTY = """
  SELECT CASE WHEN l_linenumber = 7 THEN NULL ELSE amazon_user_id END AS amazon_user_id, asin, parent_asin,
         CASE WHEN l_linenumber = 6 THEN 5.5 WHEN l_linenumber = 5 THEN 0.0 ELSE rating END AS rating,
         CASE WHEN l_linenumber = 4 THEN NULL ELSE review_title END AS review_title, review_text,
         CASE WHEN l_linenumber = 3 THEN NULL ELSE helpful_vote END AS helpful_vote,
         CASE WHEN l_linenumber = 4 THEN NULL ELSE verified END AS verified, ts
  FROM (SELECT *, helpful_vote + 2 AS l_linenumber FROM reviews_norm)"""


def _dirty(spark, sf):
    """Reviews with gaps and impossible values placed by line number."""
    line = F.col("helpful_vote") + 2
    df = testviews.reviews_normalized(spark, sf)
    return df.select(
        F.when(line != 7, F.col("amazon_user_id")).alias("amazon_user_id"), "asin", "parent_asin",
        F.when(line == 6, 5.5).when(line == 5, 0.0).otherwise(F.col("rating")).alias("rating"),
        F.when(line != 4, F.col("review_title")).alias("review_title"), "review_text",
        F.when(line != 3, F.col("helpful_vote")).alias("helpful_vote"),
        F.when(line != 4, F.col("verified")).alias("verified"), "ts",
    )


@query("B4_required_keys", with_blocks(f"""
  SELECT amazon_user_id, asin, parent_asin, rating, coalesce(review_title, '') AS review_title, review_text,
         coalesce(helpful_vote, 0) AS helpful_vote, coalesce(verified, false) AS verified, ts
  FROM ({_DIRTY}) WHERE amazon_user_id IS NOT NULL""", "reviews_norm"))
def required_keys(spark, sf):
    return reviews.fill_missing(_dirty(spark, sf))


_SANE = f"""
  SELECT amazon_user_id, asin, parent_asin, rating, coalesce(review_title, '') AS review_title, review_text,
         greatest(coalesce(helpful_vote, 0), 0) AS helpful_vote, coalesce(verified, false) AS verified, ts
  FROM ({_DIRTY}) WHERE amazon_user_id IS NOT NULL AND rating BETWEEN 1 AND 5"""


@query("B5_rating_sanity", with_blocks(_SANE, "reviews_norm"))
def rating_sanity(spark, sf):
    return reviews.sane(reviews.fill_missing(_dirty(spark, sf)))


@query("B6_clean_reviews", with_blocks(f"""
  SELECT * FROM ({_SANE}) QUALIFY row_number() OVER (
    PARTITION BY amazon_user_id, asin ORDER BY ts DESC NULLS LAST, helpful_vote DESC, rating DESC,
    review_title DESC, review_text DESC, verified DESC, parent_asin DESC NULLS LAST) = 1""", "reviews_norm"))
def clean_reviews(spark, sf):
    return reviews.clean_reviews(_dirty(spark, sf))


_KEYWORD_CASE = "CASE " + " ".join(
    f"WHEN contains(lower(title), '{k}') THEN '{v}'" for k, v in rules.CATEGORY_KEYWORDS
) + " ELSE 'Beauty' END"
_CATEGORY = f"""
  CASE WHEN main_category <> 'All Beauty' THEN main_category
       WHEN categories[1] <> 'All Beauty' THEN categories[1]
       WHEN details['category'] IS NOT NULL THEN details['category']
       ELSE {_KEYWORD_CASE} END"""


@query("B7_clean_metadata", with_blocks(f"""
  SELECT parent_asin, title, coalesce(store, 'Unknown') AS store, {_CATEGORY} AS main_category,
         round(average_rating, 6) AS avg_rating, rating_number, primary_image FROM meta""", "meta"))
def clean_metadata(spark, sf):
    return testviews.metadata_clean(spark, sf).drop("raw_metadata").withColumn(
        "avg_rating", F.round("avg_rating", 6)
    )


@query("B8_canonical_item", with_blocks("""
  SELECT count(*) AS total, count(parent_asin) AS from_parent,
         count(*) FILTER (parent_asin IS NULL) AS from_asin FROM reviews_clean""", "reviews_clean"))
def canonical_item(spark, sf):
    return inter.item_id_counts(testviews.reviews_clean(spark, sf))


@query("B9_text_view", with_blocks("""
  SELECT parent_asin, title, store, main_category, details['Color'] AS color,
         array_to_string(features, '|') AS features, array_to_string(description, '|') AS description
  FROM meta WHERE trim(title) <> ''""", "meta"))
def text_view(spark, sf):
    view = metadata.text_view(testviews.metadata_raw(spark, sf))
    return view.select(
        "parent_asin", "title", "store", "main_category", F.col("details")["Color"].alias("color"),
        F.array_join("features", "|").alias("features"), F.array_join("description", "|").alias("description"),
    )


# --- C, D: joins and deduplication ---------------------------------------------------

@query("C1_reviews_with_metadata", with_blocks("""
  SELECT r.amazon_user_id, r.asin, r.rating, m.title, m.parent_asin IS NOT NULL AS has_metadata
  FROM reviews_clean r LEFT JOIN (SELECT * FROM meta WHERE store IS NOT NULL) m
    ON coalesce(r.parent_asin, r.asin) = m.parent_asin""", "reviews_clean", "meta"))
def reviews_with_metadata(spark, sf):
    some = testviews.metadata_clean(spark, sf).filter(F.col("store") != "Unknown")
    joined = inter.join_metadata(inter.with_item_id(testviews.reviews_clean(spark, sf)), some)
    return joined.select("amazon_user_id", "asin", "rating", "title", "has_metadata")


@query("C1_match_counts", with_blocks("""
  SELECT count(*) AS total, count(m.parent_asin) AS with_metadata,
         count(*) - count(m.parent_asin) AS without_metadata
  FROM reviews_clean r LEFT JOIN (SELECT * FROM meta WHERE store IS NOT NULL) m
    ON coalesce(r.parent_asin, r.asin) = m.parent_asin""", "reviews_clean", "meta"))
def match_counts(spark, sf):
    some = testviews.metadata_clean(spark, sf).filter(F.col("store") != "Unknown")
    return inter.match_counts(testviews.reviews_clean(spark, sf), some)


@query("D1_latest_review", with_blocks("SELECT * FROM reviews_clean", "reviews_clean"))
def latest_review(spark, sf):
    return testviews.reviews_clean(spark, sf)


_DOUBLED = """
  SELECT parent_asin, title, primary_image, details, 0 AS copy FROM meta
  UNION ALL SELECT parent_asin, title || ' copy', NULL, NULL, 1 FROM meta"""


@query("D2_best_metadata", with_blocks(f"""
  SELECT parent_asin, title FROM ({_DOUBLED}) QUALIFY row_number() OVER (
    PARTITION BY parent_asin
    ORDER BY (primary_image IS NOT NULL)::INT * 2 + (details IS NOT NULL)::INT DESC, copy DESC) = 1""", "meta"))
def best_metadata(spark, sf):
    meta = testviews.metadata_normalized(spark, sf)
    bare = (
        meta.withColumn("title", F.concat("title", F.lit(" copy")))
        .withColumn("primary_image", F.lit(None).cast("string"))
        .withColumn("details", F.lit(None).cast("map<string,string>"))
    )
    # The copy's source text sorts after the original's, so it wins among equally bare records.
    marked = meta.withColumn("raw_metadata", F.lit("a")).unionByName(bare.withColumn("raw_metadata", F.lit("b")))
    return metadata.keep_best(marked).select("parent_asin", "title")


@query("D3_unique_items", with_blocks("""
  SELECT parent_asin AS item_id, title, rating_number FROM meta""", "meta"))
def unique_items(spark, sf):
    clean = testviews.metadata_clean(spark, sf)
    return inter.items_for_rs(clean.unionByName(clean)).select("item_id", "title", "rating_number")


@query("D3_unique_text_view", with_blocks("SELECT parent_asin, title FROM meta", "meta"))
def unique_text_view(spark, sf):
    view = metadata.text_view(testviews.metadata_raw(spark, sf))
    return metadata.unique_text_view(view.unionByName(view)).select("parent_asin", "title")


# --- E, F: popularity, split, k-core -------------------------------------------------

@query("E1_item_popularity", with_blocks("""
  SELECT item_id, interaction_count, round(mean_rating, 6) AS mean_rating FROM popularity""", "popularity"))
def item_popularity(spark, sf):
    stats = popularity.popularity_stats(testviews.interactions(spark, sf))
    return stats.withColumn("mean_rating", F.round("mean_rating", 6))


@query("E2_normalized_popularity", with_blocks("""
  SELECT item_id, round(popularity_score, 6) AS popularity_score, round(rating_score, 6) AS rating_score
  FROM popularity_norm""", "popularity_norm"))
def normalized_popularity(spark, sf):
    stats = popularity.popularity_stats(testviews.interactions(spark, sf))
    return popularity.normalize_popularity(stats).select(
        "item_id", F.round("popularity_score", 6).alias("popularity_score"),
        F.round("rating_score", 6).alias("rating_score"),
    )


@query("E3_popularity_fallback", with_blocks("""
  SELECT item_id, round(0.7 * interaction_count / max(interaction_count) OVER ()
                        + 0.3 * (mean_rating - 1) / 4, 6) AS recall_score,
         round(interaction_count / max(interaction_count) OVER (), 6) AS dataset_score
  FROM popularity""", "popularity"))
def popularity_fallback(spark, sf):
    stats = popularity.popularity_stats(testviews.interactions(spark, sf))
    recall = popularity.fallback_scores(stats).select("item_id", F.round("popularity_score", 6).alias("recall_score"))
    plain = popularity.fallback_scores(stats, "dataset").select(
        "item_id", F.round("popularity_score", 6).alias("dataset_score")
    )
    return recall.join(plain, "item_id")


@query("E10_leaderboard", with_blocks("""
  SELECT item_id, interaction_count, round(mean_rating, 6) AS mean_rating FROM popularity
  ORDER BY interaction_count DESC, item_id LIMIT 20""", "popularity"))
def leaderboard(spark, sf):
    stats = popularity.popularity_stats(testviews.interactions(spark, sf))
    return popularity.leaderboard(stats, 20).withColumn("mean_rating", F.round("mean_rating", 6))


@query("F1_recency_rank", with_blocks("""
  SELECT user_id, item_id, ts, dense_rank() OVER (PARTITION BY user_id ORDER BY ts) AS rank
  FROM interactions""", "interactions"))
def recency_rank(spark, sf):
    return inter.recency_rank(testviews.interactions(spark, sf)).select("user_id", "item_id", "ts", "rank")


@query("F2_split_train", with_blocks("SELECT * FROM train", "train"))
def split_train(spark, sf):
    return inter.split_last_out(testviews.interactions(spark, sf))[0]


@query("F2_split_test", with_blocks("SELECT * FROM test", "test"))
def split_test(spark, sf):
    return inter.split_last_out(testviews.interactions(spark, sf))[1]


@query("F2_split_one", with_blocks("""
  SELECT user_id, item_id, rating, ts FROM interactions QUALIFY row_number() OVER (
    PARTITION BY user_id ORDER BY ts DESC, item_id DESC, rating DESC) = 1""", "interactions"))
def split_one(spark, sf):
    return inter.split_last_out(testviews.interactions(spark, sf), "one")[1]


@query("F2_split_counts", with_blocks("""
  SELECT count(*) AS total, count(*) FILTER (ts < last_ts) AS train_count, count(*) FILTER (ts = last_ts) AS test_count,
         round(100.0 * count(*) FILTER (ts < last_ts) / count(*), 6) AS train_pct,
         round(100.0 * count(*) FILTER (ts = last_ts) / count(*), 6) AS test_pct FROM split""", "split"))
def split_counts(spark, sf):
    return inter.split_counts(testviews.interactions(spark, sf)).select(
        "total", "train_count", "test_count", F.round("train_pct", 6).alias("train_pct"),
        F.round("test_pct", 6).alias("test_pct"),
    )


@query("F3_sorted_interactions", with_blocks("""
  SELECT user_id, item_id, rating, ts FROM interactions ORDER BY user_id, ts, item_id""", "interactions"))
def sorted_interactions(spark, sf):
    return inter.sort_by_user_time(testviews.interactions(spark, sf))


@query("F4_core5", with_blocks(f"SELECT * FROM {CORE5}", CORE5))
def core5(spark, sf):
    return kcore.k_core(testviews.interactions(spark, sf), 5).rows


@query("F4_core20", with_blocks(f"SELECT * FROM {CORE20}", CORE20))
def core20(spark, sf):
    return kcore.k_core(testviews.interactions(spark, sf), 20).rows


@query("F4_core25_rounds", with_blocks("""
  SELECT 1 AS round, (SELECT count(*) FROM interactions) AS rows_before, (SELECT count(*) FROM core25_1) AS rows_after,
         (SELECT count(*) FROM interactions) - (SELECT count(*) FROM core25_1) AS dropped
""" + "".join(f"""
  UNION ALL SELECT {i}, (SELECT count(*) FROM core25_{i - 1}), (SELECT count(*) FROM core25_{i}),
         (SELECT count(*) FROM core25_{i - 1}) - (SELECT count(*) FROM core25_{i})
  WHERE (SELECT count(*) FROM core25_{i - 1}) > 0""" for i in range(2, 5)), "core25_4"))
def core25_rounds(spark, sf):
    return kcore.k_core(testviews.interactions(spark, sf), 25).stats()


# One run of levels answers for all three cores.
_CORES = {5: CORE5, 20: CORE20, 25: CORE25}


@query("F4_core_ladder", with_blocks(" UNION ALL ".join(f"""
  SELECT {k} AS k, count(*) AS n_rows, count(DISTINCT user_id) AS n_users, count(DISTINCT item_id) AS n_items
  FROM {core}""" for k, core in _CORES.items()), *_CORES.values()))
def core_ladder(spark, sf):
    return coreness.coreness(testviews.interactions(spark, sf), most=25).sizes([5, 20, 25])


@query("F4_core_levels", with_blocks(" UNION ALL ".join(f"""
  SELECT '{side}' AS side, {side}_id AS node, CASE {" ".join(
    f"WHEN {side}_id IN (SELECT {side}_id FROM {core}) THEN {k}" for k, core in sorted(_CORES.items(), reverse=True)
  )} ELSE 0 END AS core FROM (SELECT DISTINCT {side}_id FROM interactions)""" for side in ("user", "item")),
    "interactions", *_CORES.values()))
def core_levels(spark, sf):
    found = coreness.coreness(testviews.interactions(spark, sf), most=25)
    sides = [df.select(F.lit(name).alias("side"), F.col(f"{name}_id").alias("node"), "level")
             for name, df in (("user", found.users), ("item", found.items))]
    level = F.col("level")
    core = F.when(level >= 25, 25).when(level >= 20, 20).when(level >= 5, 5).otherwise(0)
    return sides[0].unionByName(sides[1]).select("side", "node", core.alias("core"))


@query("F4_core_rows_by_level", with_blocks(f"SELECT * FROM {CORE20}", CORE20))
def core_rows_by_level(spark, sf):
    rows = keep(testviews.interactions(spark, sf), "interactions")
    return coreness.coreness(rows, most=25).rows(rows, 20)


@query("F5_union_rows", with_blocks("""
  SELECT item_id, count(*) AS interaction_count FROM (SELECT * FROM train UNION ALL SELECT * FROM test)
  GROUP BY item_id""", "train", "test"))
def union_rows(spark, sf):
    train, test = inter.split_last_out(testviews.interactions(spark, sf))
    return popularity.popularity_stats(inter.union_rows(train, test)).select("item_id", "interaction_count")
