"""Vectors, factors, ranker, recall, ranking, re-ranking, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelflight.functions.vectors import norm, unit
from shelflight.operators import (
    candidates, evaluate, factors, nearest, popularity, ranker, rerank, reports, scoring, texts, vector_index,
)
from shelflight.operators import interactions as inter
from shelflight.registry import query
from shelflight.registry.ctes import block, with_blocks
from shelflight.registry.reporting import _text_view, rounded
from shelflight.session import keep, scratch_path
from shelflight.sources import sinks, testviews

def sql_dot(a: str, b: str) -> str:
    return f"list_dot_product({a}, {b})"


def _interactions(spark, sf):
    """Interactions as the earlier phase leaves them: a written table."""
    return keep(testviews.interactions(spark, sf), "interactions")


def _round(df, digits, *names):
    for n in names:
        df = df.withColumn(n, F.round(F.col(n), digits))
    return df


# --- G: vectors ----------------------------------------------------------------------

block("neighbours", """
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item_id) AS position FROM (
    SELECT a.item_id AS query_id, b.item_id, list_cosine_similarity(a.embedding, b.embedding) AS score
    FROM vectors a, vectors b)""", "vectors")


@query("G1_unit_vectors", with_blocks("""
  SELECT item_id, round(n, 5) AS norm, round(embedding[1] / n, 5) AS first_value FROM (
    SELECT *, sqrt(list_dot_product(embedding, embedding)) AS n FROM vectors)""", "vectors"))
def unit_vectors(spark, sf):
    v = testviews.item_vectors(spark, sf)
    return v.select(
        "item_id", F.round(norm(F.col("embedding")), 5).alias("norm"),
        F.round(F.get(unit(F.col("embedding")), F.lit(0)), 5).alias("first_value"),
    )


@query("G2_similar_items", with_blocks("""
  SELECT query_id, item_id, round(score, 5) AS score, position FROM neighbours WHERE position <= 10""", "neighbours"))
def similar_items(spark, sf):
    v = testviews.item_vectors(spark, sf)
    return _round(nearest.similar_items(v, v, 10), 5, "score")


@query("G2_similar_items_excluding", with_blocks("""
  SELECT query_id, item_id, round(score, 5) AS score,
         row_number() OVER (PARTITION BY query_id ORDER BY position) AS position
  FROM neighbours WHERE query_id <> item_id AND score >= 0.1
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY position) <= 10""", "neighbours"))
def similar_items_excluding(spark, sf):
    v = testviews.item_vectors(spark, sf)
    found = nearest.similar_items(v, v, 11, threshold=0.1)
    itself = v.select(F.col("item_id").alias("query_id"), "item_id")
    return _round(nearest.without_excluded(found, itself, 10), 5, "score")


@query("G3_approximate_recall")
def approximate_recall(spark, sf):
    v = testviews.item_vectors(spark, sf)
    exact = nearest.similar_items(v, v, 10)
    return nearest.recall_against(exact, nearest.approximate_similar_items(v, v, 10, cells=16, probes=6))


def _stored_index(spark, sf):
    """All vectors but category 3 are indexed, then those are added, one half of them twice."""
    v = testviews.item_vectors(spark, sf)
    path = scratch_path(spark, "index")
    vector_index.build_index(v.filter(F.col("category") != "3"), path)
    late = v.filter(F.col("category") == "3")
    vector_index.add_vectors(late, path)
    vector_index.add_vectors(late.filter(F.pmod(F.xxhash64("item_id"), F.lit(2)) == 0), path)
    return v, path


@query("A7_index_contents", with_blocks("""
  SELECT item_id, round(embedding[1] / sqrt(list_dot_product(embedding, embedding)), 5) AS first_value
  FROM vectors""", "vectors"))
def index_contents(spark, sf):
    _, path = _stored_index(spark, sf)
    return vector_index.stored(spark, path).select(
        "item_id", F.round(F.get("vec", F.lit(0)), 5).alias("first_value")
    )


# What must hold of the index, as figures: all pairs asked for, recall of 0.9 or more, added items found first.
@query("G3_index_recall", with_blocks("""
  SELECT count(*) AS pairs, true AS recall_reached,
         (SELECT count(*) FROM vectors WHERE category = '3') AS added_found
  FROM neighbours WHERE position <= 10""", "neighbours", "vectors"))
def index_recall(spark, sf):
    v, path = _stored_index(spark, sf)
    exact = nearest.similar_items(v, v, 10)
    probes, refine = vector_index.measured_search(spark, path, 10)
    found = keep(vector_index.search_index(v, path, 10, probes=probes, refine=refine), "found")
    added = v.filter(F.col("category") == "3").select(F.col("item_id").alias("query_id"))
    itself = found.filter((F.col("position") == 1) & (F.round("score", 9) == 1.0)).join(added, "query_id", "left_semi")
    return nearest.recall_against(exact, found).select(
        "pairs", (F.col("recall") >= 0.9).alias("recall_reached"),
        itself.agg(F.count("*")).scalar().alias("added_found"),
    )


# With every cell visited the approximate search is the exact one.
@query("G3_all_cells", with_blocks("""
  SELECT query_id, item_id, round(score, 5) AS score, position FROM neighbours WHERE position <= 10""", "neighbours"))
def all_cells(spark, sf):
    v = testviews.item_vectors(spark, sf)
    return _round(nearest.approximate_similar_items(v, v, 10, cells=16, probes=16), 5, "score")


def _pairs(spark, sf):
    """Pairs of bought item and its neighbour on the shelf."""
    return testviews.interactions(spark, sf).select(
        "user_id", F.col("item_id").alias("reference_id"),
        (F.col("item_id").cast("bigint") + 1).cast("string").alias("item_id"),
    )


@query("G4_content_scores", with_blocks("""
  SELECT i.user_id, i.item_id AS reference_id, CAST(CAST(i.item_id AS BIGINT) + 1 AS VARCHAR) AS item_id,
         round(greatest(0, least(1, coalesce(list_cosine_similarity(a.embedding, b.embedding), 0))), 5) AS score
  FROM interactions i LEFT JOIN vectors a ON a.item_id = i.item_id
  LEFT JOIN vectors b ON b.item_id = CAST(CAST(i.item_id AS BIGINT) + 1 AS VARCHAR)""", "interactions", "vectors"))
def content_scores(spark, sf):
    return _round(nearest.content_scores(_pairs(spark, sf), testviews.item_vectors(spark, sf)), 5, "score")


block("refs", """
  SELECT user_id, item_id AS reference_id, rating - 2 AS weight, pos FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item_id) AS pos FROM interactions)
  WHERE pos <= 10""", "interactions")
block("content", """
  SELECT user_id, p.item_id, least(1, round(sum(w * greatest(0, least(1, coalesce(
           list_cosine_similarity(a.embedding, b.embedding), 0)))), 12)) AS content_score
  FROM (SELECT i.user_id, i.item_id, r.reference_id,
               CASE WHEN sum(weight) OVER (PARTITION BY i.user_id, i.item_id) > 0
                    THEN weight / sum(weight) OVER (PARTITION BY i.user_id, i.item_id)
                    ELSE 1.0 / count(*) OVER (PARTITION BY i.user_id, i.item_id) END AS w
        FROM (SELECT DISTINCT user_id, item_id FROM interactions) i JOIN refs r USING (user_id)) p
  LEFT JOIN vectors a ON a.item_id = p.reference_id LEFT JOIN vectors b ON b.item_id = p.item_id
  GROUP BY user_id, p.item_id""", "interactions", "vectors", "refs")


def _references(spark, sf, rows):
    from shelflight.functions.common import top_per_group

    newest = top_per_group(rows, ["user_id"], [F.desc("ts"), F.asc("item_id")], candidates.MAX_REFERENCES, "pos")
    return newest.select("user_id", F.col("item_id").alias("reference_id"), (F.col("rating") - 2).alias("weight"), "pos")


@query("G5_weighted_content", with_blocks("""
  SELECT user_id, item_id, round(content_score, 5) AS content_score FROM content""", "content"))
def weighted_content(spark, sf):
    rows = testviews.interactions(spark, sf)
    scores = nearest.weighted_content_scores(
        rows.select("user_id", "item_id").distinct(), _references(spark, sf, rows), testviews.item_vectors(spark, sf)
    )
    return _round(scores, 5, "content_score")


@query("G6_vectors_by_id", with_blocks("""
  SELECT item_id, round(embedding[1], 5) AS first_value FROM vectors WHERE item_id IN (SELECT item_id FROM test)""",
  "vectors", "test"))
def vectors_by_id(spark, sf):
    test = inter.split_last_out(testviews.interactions(spark, sf))[1]
    return nearest.vectors_by_id(test, testviews.item_vectors(spark, sf)).select(
        "item_id", F.round(F.get("embedding", F.lit(0)).cast("double"), 5).alias("first_value")
    )


@query("G7_self_nearest", with_blocks("""
  SELECT count(*) AS items, count(*) FILTER (query_id = item_id) AS self_first FROM neighbours WHERE position = 1""",
  "neighbours"))
def self_nearest(spark, sf):
    v = testviews.item_vectors(spark, sf)
    return nearest.self_nearest(nearest.similar_items(v, v, 1))


@query("G8_text_embeddings", with_blocks("""
  SELECT parent_asin AS item_id, 256 AS dimensions, 1.0::DOUBLE AS norm FROM compact
  WHERE trim(embedding_text) <> ''""", "compact"))
def text_embeddings(spark, sf):
    compact = texts.compact_texts(texts.semantic_attributes(_text_view(spark, sf)))
    vectors = nearest.encode_texts(compact.withColumnRenamed("parent_asin", "item_id"))
    return vectors.select("item_id", F.size("embedding").alias("dimensions"),
                          F.round(norm(F.col("embedding")), 3).alias("norm"))


# --- H: factors and ranker -----------------------------------------------------------

for _name, _table, _key, _spread in (("user_factors", "customer", "c_custkey", 7), ("item_factors", "part", "p_partkey", 3)):
    block(_name, f"""
      SELECT CAST({_key} AS VARCHAR) AS id, CAST(embedding AS DOUBLE[])[1:15] AS factors,
             CAST(embedding[16] AS DOUBLE) AS bias
      FROM {_table} JOIN embeddings ON vec_id = {_key} * {_spread} % (SELECT count(*) FROM embeddings)""")
block("mf_recall", f"""
  SELECT u.id AS user_id, i.id AS item_id, {sql_dot("u.factors", "i.factors")} AS score,
         row_number() OVER (PARTITION BY u.id ORDER BY {sql_dot("u.factors", "i.factors")} DESC, i.id) AS position
  FROM user_factors u, item_factors i QUALIFY position <= 100""", "user_factors", "item_factors")
block("mf_pairs", f"""
  SELECT n.*, {sql_dot("u.factors", "i.factors")} AS mf_score, u.bias + i.bias AS bias
  FROM interactions n JOIN user_factors u ON u.id = n.user_id JOIN item_factors i ON i.id = n.item_id""",
      "interactions", "user_factors", "item_factors")


@query("C5_mf_lookup", with_blocks("""
  SELECT user_id, item_id, round(mf_score, 6) AS mf_score FROM mf_pairs""", "mf_pairs"))
def mf_lookup(spark, sf):
    rows = testviews.interactions(spark, sf).select("user_id", "item_id")
    return _round(
        factors.with_mf_score(rows, testviews.user_factors(spark, sf), testviews.item_factors(spark, sf)), 6, "mf_score"
    )


def _fitted(spark, sf):
    core = inter.parts_of(keep(inter.marked_last(_interactions(spark, sf)), "split"))
    return factors.fit_factors(core[0]), core


@query("H1_factor_fit")
def factor_fit(spark, sf):
    model, (train, test) = _fitted(spark, sf)
    return evaluate.rating_errors(factors.predict(test, model.users, model.items, model.mean))


# Stand-in factors repeat, so scores tie in the last digit; they are compared by score, not by the tied ids.
@query("H2_factor_recall", with_blocks("""
  SELECT user_id, position, round(score, 6) AS score FROM mf_recall""", "mf_recall"))
def factor_recall(spark, sf):
    found = factors.factor_recall(testviews.user_factors(spark, sf), testviews.item_factors(spark, sf))
    return found.select("user_id", "position", F.round("score", 6).alias("score"))


@query("H3_predictions", with_blocks("""
  SELECT user_id, item_id, round(greatest(1, least(5, (SELECT avg(rating) FROM interactions) + bias + mf_score)), 6)
    AS prediction FROM mf_pairs""", "mf_pairs"))
def predictions(spark, sf):
    rows = _interactions(spark, sf)
    mean = rows.agg(F.avg("rating")).first()[0]
    out = factors.predict(rows, testviews.user_factors(spark, sf), testviews.item_factors(spark, sf), mean)
    return out.select("user_id", "item_id", F.round("prediction", 6).alias("prediction"))


@query("H3_predictions_without_bias", with_blocks("""
  SELECT user_id, item_id, round(greatest(1, least(5, (SELECT avg(rating) FROM interactions) + mf_score)), 6)
    AS prediction FROM mf_pairs""", "mf_pairs"))
def predictions_without_bias(spark, sf):
    rows = _interactions(spark, sf)
    mean = rows.agg(F.avg("rating")).first()[0]
    out = factors.predict(
        rows, testviews.user_factors(spark, sf), testviews.item_factors(spark, sf), mean, zero_bias=True
    )
    return out.select("user_id", "item_id", F.round("prediction", 6).alias("prediction"))


block("dataset", """
  SELECT user_id, item_id, mf_score, 0.0 AS content_score, coalesce(popularity_score, 0) AS popularity_score,
         coalesce(rating_score, 0) AS rating_score, CAST(rating >= 4 AS INTEGER) AS label
  FROM mf_pairs LEFT JOIN popularity_norm USING (item_id)""", "mf_pairs", "popularity_norm")


def _dataset(spark, sf):
    rows = _interactions(spark, sf)
    popular = popularity.normalize_popularity(popularity.popularity_stats(rows))
    return ranker.ranking_dataset(
        rows, testviews.user_factors(spark, sf), testviews.item_factors(spark, sf), popular
    )


_SCORES = ("mf_score", "content_score", "popularity_score", "rating_score")


@query("H4_ranking_dataset", with_blocks(f"""
  SELECT user_id, item_id, label, {", ".join(f"round({c}, 6) AS {c}" for c in _SCORES)} FROM dataset""", "dataset"))
def ranking_dataset(spark, sf):
    return _round(_dataset(spark, sf), 6, *_SCORES)


@query("E21_label_counts", with_blocks("""
  SELECT label, count(*) AS count, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM dataset GROUP BY 1
""", "dataset"))
def label_counts(spark, sf):
    return rounded(reports.label_counts(_dataset(spark, sf)), "percent")


block("split_dataset", """
  SELECT *, n <= cut AS in_test FROM (
    SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || user_id || '|' || item_id)) AS n,
           round(count(*) OVER (PARTITION BY label) * 0.2) AS cut FROM dataset)""", "dataset")


@query("H5_stratified_split", with_blocks("SELECT user_id, item_id, label, in_test FROM split_dataset", "split_dataset"))
def stratified_split(spark, sf):
    train, test = ranker.stratified_split(_dataset(spark, sf))
    sides = train.withColumn("in_test", F.lit(False)).unionByName(test.withColumn("in_test", F.lit(True)))
    return sides.select("user_id", "item_id", "label", "in_test")


@query("H5_ranker_coefficients")
def ranker_coefficients(spark, sf):
    model = ranker.fit_ranker(ranker.stratified_split(_dataset(spark, sf))[0])
    values = [*model.coefficients.toArray().tolist(), model.intercept]
    return spark.createDataFrame(
        [(n, float(v)) for n, v in zip([*ranker.FEATURES, "intercept"], values, strict=True)], "feature string, weight double"
    )


# Scores of a stored and reloaded ranker against those of the model that was fitted.
@query("A8_ranker_reload", with_blocks("SELECT count(*) AS rows, 0 AS differing FROM dataset", "dataset"))
def ranker_reload(spark, sf):
    data = keep(_dataset(spark, sf), "dataset")
    model, path = ranker.fit_ranker(ranker.stratified_split(data)[0]), scratch_path(spark, "ranker")
    ranker.save_ranker(model, path)
    again = ranker.scored(ranker.load_ranker(path), data.withColumnRenamed("label", "_label"))
    both = ranker.scored(model, again.withColumnsRenamed({"rank_score": "_reloaded", "prediction": "_class"}))
    return both.agg(
        F.count("*").alias("rows"), F.count_if(~F.col("rank_score").eqNullSafe(F.col("_reloaded"))).alias("differing")
    )


_SIGMOID = " + ".join(
    [f"({ranker.INTERCEPT})"] + [f"({w}) * {f}" for f, w in zip(ranker.FEATURES, ranker.COEFFICIENTS, strict=True)]
)


# The published model on the test side; the area under the curve from the sum of ranks, ties at their mean rank.
@query("H6_ranker_metrics", with_blocks(f"""
  SELECT count(*) AS rows, round(avg((label = p)::INT), 6) AS accuracy,
         round((sum(mean_rank) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2)
               / (sum(label) * (count(*) - sum(label))), 6) AS roc_auc,
         count(*) FILTER (label = 0 AND p = 0) AS tn, count(*) FILTER (label = 0 AND p = 1) AS fp,
         count(*) FILTER (label = 1 AND p = 0) AS fn, count(*) FILTER (label = 1 AND p = 1) AS tp
  FROM (SELECT label, (s > 0.5)::INT AS p,
               rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS mean_rank
        FROM (SELECT label, 1 / (1 + exp(-({_SIGMOID}))) AS s FROM split_dataset WHERE in_test))""", "split_dataset"))
def ranker_metrics(spark, sf):
    test = ranker.stratified_split(_dataset(spark, sf))[1]
    return _round(ranker.binary_metrics(None, test), 6, "accuracy", "roc_auc")


@query("H6_fitted_metrics")
def fitted_metrics(spark, sf):
    train, test = ranker.stratified_split(_dataset(spark, sf))
    return ranker.binary_metrics(ranker.fit_ranker(train), test)


@query("H7_scores", with_blocks(f"""
  SELECT user_id, item_id, round(1 / (1 + exp(-({_SIGMOID}))), 6) AS rank_score FROM dataset""", "dataset"))
def scores(spark, sf):
    return _dataset(spark, sf).select("user_id", "item_id", F.round(ranker.probability(), 6).alias("rank_score"))


@query("H7_fitted_scores")
def fitted_scores(spark, sf):
    data = _dataset(spark, sf)
    model = ranker.fit_ranker(ranker.stratified_split(data)[0])
    return ranker.scored(model, data).select("user_id", "item_id", F.round("rank_score", 6).alias("rank_score"))


@query("A8_factor_tables", with_blocks("""
  SELECT id, round(bias, 6) AS bias, round(factors[1], 6) AS first_factor FROM user_factors""", "user_factors"))
def factor_tables(spark, sf):
    stored = sinks.write_factors(testviews.user_factors(spark, sf), scratch_path(spark, "factors"))
    return stored.select("id", F.round("bias", 6).alias("bias"),
                         F.round(F.get("factors", F.lit(0)).cast("double"), 6).alias("first_factor"))


# --- I: recall, ranking, re-ranking --------------------------------------------------

block("popular_recall", """
  SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id
           ORDER BY CASE WHEN p <= fixed THEN 0 ELSE 1 END, CASE WHEN p <= fixed THEN p END,
                    md5('42|' || user_id || '|' || item_id)) AS pos
  FROM (SELECT *, CASE WHEN n > 50 THEN floor(n * 0.2) ELSE n END AS fixed FROM (
    SELECT user_id, item_id, row_number() OVER w AS p, least(100, count(*) OVER (PARTITION BY user_id)) AS n
    FROM (SELECT DISTINCT user_id FROM interactions) u CROSS JOIN popularity_norm
    ANTI JOIN (SELECT user_id, reference_id AS item_id FROM refs) r USING (user_id, item_id)
    WINDOW w AS (PARTITION BY user_id ORDER BY popularity_score DESC, item_id)) WHERE p <= 100)
  QUALIFY pos <= 50""", "interactions", "popularity_norm", "refs")


def _popular_recall(spark, sf, rows=None, **options):
    rows = _interactions(spark, sf) if rows is None else rows
    popular = popularity.normalize_popularity(popularity.popularity_stats(rows))
    # Equal counts give equal scores up to the last digit; rounding makes them equal outright.
    popular = popular.withColumn("popularity_score", F.round("popularity_score", 9))
    known = _references(spark, sf, rows).select("user_id", F.col("reference_id").alias("item_id"))
    users = rows.select("user_id").distinct().join(candidates.excluded_array(known), "user_id")
    return candidates.popularity_recall(users, popular, **options)


@query("I1_popularity_recall", with_blocks("SELECT user_id, item_id, pos FROM popular_recall", "popular_recall"))
def popularity_recall(spark, sf):
    return _popular_recall(spark, sf)


# No exclusion is short enough for the shared list: every user goes by the ranges of ranks.
@query("I1_recall_by_ranges", with_blocks("SELECT user_id, item_id, pos FROM popular_recall", "popular_recall"))
def recall_by_ranges(spark, sf):
    return _popular_recall(spark, sf, max_excluded=0)


@query("F9_popularity_shuffle", with_blocks("""
  SELECT user_id, item_id, pos, pos <= 20 AS in_front FROM popular_recall""", "popular_recall"))
def popularity_shuffle(spark, sf):
    return _popular_recall(spark, sf).select("user_id", "item_id", "pos", (F.col("pos") <= 20).alias("in_front"))


block("content_recall", """
  SELECT user_id, item_id, score, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, ref_pos, position) AS pos
  FROM (SELECT r.user_id, n.item_id, n.score, r.pos AS ref_pos, n.position
        FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM refs) r
        JOIN neighbours n ON n.query_id = r.reference_id AND n.position <= 50 // r.n + 5
        QUALIFY row_number() OVER (PARTITION BY r.user_id, n.item_id ORDER BY r.pos, n.position) = 1)
  QUALIFY pos <= 50""", "refs", "neighbours")


def _content_recall(spark, sf, rows=None):
    rows = _interactions(spark, sf) if rows is None else rows
    v = testviews.item_vectors(spark, sf)
    return candidates.content_recall(_references(spark, sf, rows), nearest.similar_items(v, v, 60))


@query("I2_content_recall", with_blocks("""
  SELECT user_id, item_id, round(score, 5) AS score, pos FROM content_recall""", "content_recall"))
def content_recall(spark, sf):
    return _round(_content_recall(spark, sf), 5, "score")


@query("I2_single_reference", with_blocks("""
  SELECT user_id, item_id, round(score, 5) AS score,
         row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, position) AS pos
  FROM refs JOIN neighbours ON query_id = reference_id AND position <= 50 WHERE pos = 1""", "refs", "neighbours"))
def single_reference(spark, sf):
    rows, v = _interactions(spark, sf), testviews.item_vectors(spark, sf)
    newest = _references(spark, sf, rows).filter(F.col("pos") == 1)
    return _round(candidates.content_recall(newest, nearest.similar_items(v, v, 60), single=True), 5, "score")


# Factor lists of the test buyers, standing in with what they bought, newest first.
block("bought", """
  SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item_id) AS pos FROM interactions
  QUALIFY pos <= 100""", "interactions")
block("merged", """
  SELECT user_id, item_id, ['mf', 'content', 'popularity'][r + 1] AS source,
         row_number() OVER (PARTITION BY user_id ORDER BY r, p) AS pos, count(*) OVER (PARTITION BY user_id) AS recall_count
  FROM (SELECT * FROM (SELECT user_id, item_id, 0 AS r, pos AS p FROM bought
                       UNION ALL SELECT user_id, item_id, 1, pos FROM content_recall
                       UNION ALL SELECT user_id, item_id, 2, pos FROM popular_recall)
        QUALIFY row_number() OVER (PARTITION BY user_id, item_id ORDER BY r, p) = 1)""",
      "bought", "content_recall", "popular_recall")


def _merged(spark, sf, rows=None):
    from shelflight.functions.common import top_per_group

    rows = _interactions(spark, sf) if rows is None else rows
    bought = top_per_group(rows, ["user_id"], [F.desc("ts"), F.asc("item_id")], candidates.K_MF, "pos")
    return candidates.merge_candidates(
        bought, _content_recall(spark, sf, rows), _popular_recall(spark, sf, rows)
    )


@query("I3_merged_candidates", with_blocks("SELECT * FROM merged", "merged"))
def merged_candidates(spark, sf):
    return _merged(spark, sf)


@query("I3_content_only", with_blocks("""
  SELECT user_id, item_id, 'content' AS source, pos, count(*) OVER (PARTITION BY user_id) AS recall_count
  FROM content_recall""", "content_recall"))
def content_only(spark, sf):
    found = _content_recall(spark, sf)
    return candidates.merge_candidates(found, found, found, only_content=True)


@query("D4_first_seen", with_blocks("""
  SELECT user_id, item_id, source, pos FROM merged""", "merged"))
def first_seen(spark, sf):
    return _merged(spark, sf).select("user_id", "item_id", "source", "pos")


block("features", """
  SELECT m.user_id, m.item_id, m.pos, list_dot_product(u.factors, i.factors) AS mf_score,
         coalesce(p.popularity_score, 0) AS popularity_score, coalesce(p.rating_score, 0) AS rating_score,
         least(1, 1.5 * coalesce(c.content_score, 0)) AS content_score
  FROM merged m JOIN user_factors u ON u.id = m.user_id JOIN item_factors i ON i.id = m.item_id
  LEFT JOIN popularity_norm p USING (item_id) LEFT JOIN content c USING (user_id, item_id)""",
      "merged", "user_factors", "item_factors", "popularity_norm", "content")


def _catalogue(spark, sf):
    return testviews.products(spark, sf).select(
        F.col("parent_asin").alias("item_id"), "parent_asin", F.col("main_category").alias("category"),
        "rating_number", "avg_rating", "title", "store",
    )


def _features(spark, sf):
    rows = _interactions(spark, sf)
    popular = popularity.normalize_popularity(popularity.popularity_stats(rows))
    content = nearest.weighted_content_scores(
        rows.select("user_id", "item_id").distinct(), _references(spark, sf, rows), testviews.item_vectors(spark, sf)
    )
    listed = scoring.with_content(_merged(spark, sf, rows), content)
    scored = factors.with_mf_score(listed, testviews.user_factors(spark, sf), testviews.item_factors(spark, sf))
    full = scoring.with_features(scored, popular, _catalogue(spark, sf))
    return scoring.boosted(full, scoring.USER_PAGE_BOOST)


@query("I4_features", with_blocks(f"""
  SELECT user_id, item_id, pos, {", ".join(f"round({c}, 5) AS {c}" for c in _SCORES)} FROM features""", "features"))
def features(spark, sf):
    return _round(_features(spark, sf), 5, *_SCORES).select("user_id", "item_id", "pos", *_SCORES)


@query("I5_content_boost", with_blocks("""
  SELECT user_id, item_id, round(least(1, 2.5 * content_score), 5) AS content_score FROM features""", "features"))
def content_boost(spark, sf):
    return _round(scoring.boosted(_features(spark, sf), scoring.ITEM_PAGE_BOOST), 5, "content_score").select(
        "user_id", "item_id", "content_score"
    )


def _sql_minmax(c: str) -> str:
    return (f"CASE WHEN max({c}) OVER w > min({c}) OVER w THEN ({c} - min({c}) OVER w) / "
            f"(max({c}) OVER w - min({c}) OVER w) ELSE 0.5 END")


block("normal", f"""
  SELECT user_id, item_id, pos, {_sql_minmax("mf_score")} AS mf_score, 0.8 * {_sql_minmax("popularity_score")} AS popularity_score,
         greatest(0, least(1, rating_score)) AS rating_score, greatest(0, least(1, content_score)) AS content_score
  FROM features WINDOW w AS (PARTITION BY user_id)""", "features")


@query("I6_normalized_features", with_blocks(f"""
  SELECT user_id, item_id, {", ".join(f"round({c}, 5) AS {c}" for c in _SCORES)} FROM normal""", "normal"))
def normalized_features(spark, sf):
    return _round(scoring.normalized(_features(spark, sf)), 5, *_SCORES).select("user_id", "item_id", *_SCORES)


@query("I6_z_scores", with_blocks("""
  SELECT user_id, item_id,
    round(1 / (1 + exp(-(mf_score - avg(mf_score) OVER w) / stddev_pop(mf_score) OVER w)), 5) AS mf_score
  FROM features WINDOW w AS (PARTITION BY user_id)""", "features"))
def z_scores(spark, sf):
    return _round(scoring.normalized(_features(spark, sf), "z_score"), 5, "mf_score").select(
        "user_id", "item_id", "mf_score"
    )


@query("I7_ranked", with_blocks(f"""
  SELECT user_id, rank_position, round(rank_score, 5) AS rank_score FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rank_score DESC, pos) AS rank_position
    FROM (SELECT *, 1 / (1 + exp(-({_SIGMOID}))) AS rank_score FROM normal)) WHERE rank_position <= 40""", "normal"))
def ranked(spark, sf):
    return _round(scoring.ranked(scoring.normalized(_features(spark, sf)), 40), 5, "rank_score").select(
        "user_id", "rank_position", "rank_score"
    )


@query("F6_ranked_top", with_blocks("""
  SELECT user_id, item_id, pos FROM merged WHERE pos <= 10""", "merged"))
def ranked_top(spark, sf):
    return _merged(spark, sf).filter(F.col("pos") <= 10).select("user_id", "item_id", "pos")


@query("I8_ranked_without_model", with_blocks("""
  SELECT user_id, item_id, pos AS rank_position, round(0.9 - 0.01 * (pos - 1), 6) AS rank_score,
         least(40, recall_count) AS ranking_count FROM merged WHERE pos <= 40""", "merged"))
def ranked_without_model(spark, sf):
    return _round(scoring.ranked_without_model(_merged(spark, sf), 40), 6, "rank_score").select(
        "user_id", "item_id", "rank_position", "rank_score", "ranking_count"
    )


# Ranked lists with context for the re-ranking rules: what a user bought is the list, the score
# follows from the price, the newest events of the same user number are the context.
block("ranked_list", """
  SELECT user_id, item_id, rank_score, row_number() OVER (PARTITION BY user_id ORDER BY rank_score DESC, item_id) AS rank_position
  FROM (SELECT CAST(o_custkey AS VARCHAR) AS user_id, CAST(l_partkey AS VARCHAR) AS item_id,
               sqrt(max(l_extendedprice)) / 1000 AS rank_score
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2) QUALIFY rank_position <= 40""")
block("context_recent", """
  SELECT CAST(user_id AS VARCHAR) AS user_id, item_id, min(pos) - 1 AS recent_pos FROM (
    SELECT user_id, asin AS item_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS pos FROM logs)
  WHERE pos <= 20 GROUP BY 1, 2""", "logs")
block("context_categories", """
  SELECT CAST(user_id AS VARCHAR) AS user_id, main_category AS category, count(*) AS category_count
  FROM (SELECT user_id, asin, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS pos FROM logs)
  JOIN products ON parent_asin = asin WHERE pos <= 20 GROUP BY 1, 2""", "logs", "products")
block("ruled", """
  SELECT r.user_id, r.item_id, rank_position, category, rating_number,
    rank_score * CASE WHEN category_count IS NOT NULL THEN 1 + least(0.4, 0.08 * category_count) ELSE 1.0 END
      * CASE WHEN recent_pos < 5 THEN 0.2 WHEN recent_pos < 10 THEN 0.4 WHEN recent_pos >= 10 THEN 0.6 ELSE 1.0 END
      * CASE WHEN rating_number < 5 THEN 0.9 ELSE 1.0 END AS adjusted_score,
    (category_count IS NOT NULL)::INT + (recent_pos IS NOT NULL)::INT + coalesce((rating_number < 5)::INT, 0) AS rules,
    CASE WHEN recent_pos < 5 THEN 'recent_penalty_top5(-80%)' WHEN recent_pos < 10 THEN 'recent_penalty_top10(-60%)'
         WHEN recent_pos >= 10 THEN 'recent_penalty(-40%)' END AS recent_rule
  FROM ranked_list r JOIN (SELECT parent_asin AS item_id, main_category AS category, rating_number FROM products) p USING (item_id)
  LEFT JOIN context_recent USING (user_id, item_id) LEFT JOIN context_categories USING (user_id, category)""",
      "ranked_list", "products", "context_recent", "context_categories")


def _ranked_list(spark, sf):
    """Lists as the service passes them on: at most twice the final length per user."""
    from shelflight.functions.common import top_per_group
    from shelflight.sources.tables import read_table

    lines = read_table(spark, sf, "lineitem").join(read_table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    best = lines.groupBy(
        F.col("o_custkey").cast("string").alias("user_id"), F.col("l_partkey").cast("string").alias("item_id")
    ).agg((F.sqrt(F.max("l_extendedprice")) / 1000).alias("rank_score"))
    return top_per_group(best, ["user_id"], [F.desc("rank_score"), F.asc("item_id")], 2 * rerank.TOP_N, "rank_position")


def _ruled(spark, sf):
    from shelflight.operators import activity

    logs = testviews.interaction_logs(spark, sf).withColumn("user_id", F.col("user_id").cast("string"))
    recent = activity.recent_rows(logs, 20)
    counts = recent.join(
        _catalogue(spark, sf).select(F.col("item_id").alias("asin"), "category"), "asin"
    ).groupBy("user_id", "category").agg(F.count("*").alias("count"))
    listed = rerank.with_metadata(_ranked_list(spark, sf), _catalogue(spark, sf))
    return rerank.apply_rules(rerank.with_context(listed, recent, counts))


@query("I9_context_rules", with_blocks("""
  SELECT user_id, item_id, round(adjusted_score, 8) AS adjusted_score, rules FROM ruled""", "ruled"))
def context_rules(spark, sf):
    return _ruled(spark, sf).select(
        "user_id", "item_id", F.round("adjusted_score", 8).alias("adjusted_score"), F.size("applied_rules").alias("rules")
    )


@query("I10_recent_penalty", with_blocks("""
  SELECT user_id, item_id, recent_rule FROM ruled WHERE recent_rule IS NOT NULL""", "ruled"))
def recent_penalty(spark, sf):
    return _ruled(spark, sf).select("user_id", "item_id", F.explode("applied_rules").alias("recent_rule")).filter(
        F.col("recent_rule").startswith("recent_penalty")
    )


# The last digit stands in for the number of ratings, so that half of the items are under the floor of five.
@query("I11_popularity_floor", with_blocks("""
  SELECT user_id, item_id, rating_number % 10 < 5 AS floored,
         round(rank_score * CASE WHEN rating_number % 10 < 5 THEN 0.9 ELSE 1.0 END, 8) AS adjusted_score
  FROM ranked_list JOIN products ON parent_asin = item_id""", "ranked_list", "products"))
def popularity_floor(spark, sf):
    goods = _catalogue(spark, sf).withColumn("rating_number", F.col("rating_number") % 10)
    listed = rerank.with_metadata(_ranked_list(spark, sf), goods).withColumns({
        "recent_pos": F.lit(None).cast("int"), "category_count": F.lit(None).cast("long"),
    })
    ruled = rerank.apply_rules(listed)
    floored = F.exists("applied_rules", lambda r: r == F.concat(
        F.lit("popularity_floor(rating="), F.col("rating_number").cast("string"), F.lit(")")))
    return ruled.select("user_id", "item_id", floored.alias("floored"), F.round("adjusted_score", 8).alias("adjusted_score"))


_PREVIOUS = "pool0"
block("pool0", """
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY adjusted_score DESC, rank_position) AS o,
         row_number() OVER (PARTITION BY user_id ORDER BY adjusted_score DESC, rank_position) <= 60 AS pool,
         CAST([] AS VARCHAR[]) AS told FROM ruled""", "ruled")
for _i in (1, 2, 3):
    block(f"pass{_i}", f"""
      SELECT * EXCLUDE (o), row_number() OVER (PARTITION BY user_id ORDER BY pool DESC, adjusted_score DESC, o) AS o
      FROM {_PREVIOUS}""", _PREVIOUS)
    block(f"pool{_i}", f"""
      SELECT * EXCLUDE (top, same, named) REPLACE (adjusted_score * CASE WHEN top AND same / named > 0.25 THEN 0.7 ELSE 1.0 END
                                       * CASE WHEN top AND same > 4 THEN 0.5 ELSE 1.0 END AS adjusted_score,
        told || list_filter([
          CASE WHEN top AND same / named > 0.25
               THEN 'diversity_penalty(' || CAST(round_even(100.0 * same / named, 1) AS DECIMAL(9,1)) || '%)' END,
          CASE WHEN top AND same > 4 THEN 'category_limit_exceeded(' || same || ')' END],
          lambda x: x IS NOT NULL AND NOT list_contains(told, x)) AS told)
      FROM (SELECT *, pool AND o <= 40 AS top,
                   count(*) FILTER (pool AND o <= 40) OVER (PARTITION BY user_id, category) AS same,
                   count(*) FILTER (pool AND o <= 40) OVER (PARTITION BY user_id) AS named FROM pass{_i})""", f"pass{_i}")
    _PREVIOUS = f"pool{_i}"


@query("I12_diversity", with_blocks("""
  SELECT user_id, item_id, round(adjusted_score, 8) AS adjusted_score FROM pool3""", "pool3"))
def diversity(spark, sf):
    return rerank.diversify(_ruled(spark, sf)).select(
        "user_id", "item_id", F.round("adjusted_score", 8).alias("adjusted_score")
    )


@query("I13_rule_audit", with_blocks("""
  SELECT user_id, item_id, concat_ws('|',
           CASE WHEN category_count IS NOT NULL
                THEN 'intent_boost(' || category || ':+' || printf('%.2f', least(40.0, 8.0 * category_count)) || '%)' END,
           recent_rule,
           CASE WHEN rating_number < 5 THEN 'popularity_floor(rating=' || rating_number || ')' END) AS rules
  FROM ruled LEFT JOIN context_categories USING (user_id, category)""", "ruled", "context_categories"))
def rule_audit(spark, sf):
    return _ruled(spark, sf).select("user_id", "item_id", F.array_join("applied_rules", "|").alias("rules"))


# What the three passes add, in their order; a rule is named once however often it strikes.
@query("I13_diversity_audit", with_blocks("""
  SELECT user_id, item_id, array_to_string(told, '|') AS told FROM pool3""", "pool3"))
def diversity_audit(spark, sf):
    before = _ruled(spark, sf).withColumn("_first", F.size("applied_rules"))
    told = F.slice("applied_rules", F.col("_first") + 1, F.size("applied_rules"))
    return rerank.diversify(before).select("user_id", "item_id", F.array_join(told, "|").alias("told"))


@query("I14_final_cut", with_blocks("""
  SELECT user_id, position, item_id, round(adjusted_score, 8) AS adjusted_score FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY adjusted_score DESC, rank_position) AS position FROM pool3)
  WHERE position <= 20""", "pool3"))
def final_cut(spark, sf):
    return rerank.final_cut(rerank.diversify(_ruled(spark, sf))).select(
        "user_id", "position", "item_id", F.round("adjusted_score", 8).alias("adjusted_score")
    )


@query("D5_one_per_parent", with_blocks("""
  SELECT user_id, parent, position FROM (
    SELECT user_id, store AS parent, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, rp) AS position
    FROM (SELECT r.user_id, coalesce(store, 'none') AS store, max(adjusted_score) AS s,
                 arg_max(rank_position, (adjusted_score, -rank_position)) AS rp
          FROM ruled r JOIN products p ON parent_asin = item_id GROUP BY 1, 2)) WHERE position <= 20""", "ruled", "products"))
def one_per_parent(spark, sf):
    stores = _catalogue(spark, sf).select("item_id", F.coalesce("store", F.lit("none")).alias("parent_asin"))
    listed = _ruled(spark, sf).drop("parent_asin").join(stores, "item_id")
    return rerank.final_cut(listed).select("user_id", F.col("parent_asin").alias("parent"), "position")


@query("F7_rank_positions", with_blocks("""
  SELECT user_id, item_id, rank_position FROM ranked_list""", "ranked_list"))
def rank_positions(spark, sf):
    return _ranked_list(spark, sf).select("user_id", "item_id", "rank_position")


block("hot", """
  SELECT asin, count(*) + 0.5 * count(DISTINCT user_id) AS score FROM logs WHERE event_type = 'view' GROUP BY asin
  ORDER BY count(*) DESC, count(DISTINCT user_id) DESC, asin LIMIT 50""", "logs")


@query("F8_trending_shuffle", with_blocks("""
  SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY h, item_id) AS position FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, is_hot ORDER BY h, item_id) AS place FROM (
      SELECT *, least(count(*) FILTER (is_hot) OVER w, floor(count(*) OVER w * 0.6)) AS slots, count(*) OVER w AS total
      FROM (SELECT r.user_id, r.item_id, h.asin IS NOT NULL AS is_hot, md5('42|' || r.user_id || '|' || r.item_id) AS h
            FROM ranked_list r LEFT JOIN hot h ON h.asin = r.item_id) WINDOW w AS (PARTITION BY user_id)))
  WHERE CASE WHEN is_hot THEN place <= slots ELSE place <= total - slots END""", "ranked_list", "hot"))
def trending_shuffle(spark, sf):
    logs = testviews.interaction_logs(spark, sf)
    hot = reports.trending(logs, logs.agg(F.max("ts")).scalar(), hours=24 * 365, limit=50)
    return candidates.shuffled(_ranked_list(spark, sf), hot).select("user_id", "item_id", "position")


@query("I17_category_fallback", with_blocks("""
  SELECT s.item_id AS seed_id, b.item_id, round(b.score, 5) AS score,
         row_number() OVER (PARTITION BY s.item_id ORDER BY b.n) AS position
  FROM (SELECT parent_asin AS item_id, main_category AS category FROM products
        WHERE parent_asin NOT IN (SELECT item_id FROM vectors)) s
  JOIN (SELECT parent_asin AS item_id, main_category AS category, round(avg_rating * rating_number, 6) AS score,
               row_number() OVER (PARTITION BY main_category ORDER BY round(avg_rating * rating_number, 6) DESC, parent_asin) AS n
        FROM products) b ON b.category = s.category AND b.n <= 11 AND b.item_id <> s.item_id
  QUALIFY position <= 10""", "products", "vectors"))
def category_fallback(spark, sf):
    goods = _catalogue(spark, sf)
    # avg * count is the whole number of stars; rounding takes the division noise out of the order.
    goods = goods.withColumn("avg_rating", F.round(F.col("avg_rating") * F.col("rating_number"), 6)).withColumn(
        "rating_number", F.lit(1)
    )
    satisfied = testviews.item_vectors(spark, sf).select(F.col("item_id").alias("seed_id"))
    return _round(
        candidates.fallback_by_category(goods.select(F.col("item_id").alias("seed_id")), satisfied, goods, 10), 5, "score"
    ).drop("rule")


@query("I17_anonymous", with_blocks("""
  SELECT item_id, row_number() OVER (ORDER BY round(popularity_score, 9) DESC, item_id) AS pos FROM popularity_norm
  QUALIFY pos <= 50""", "popularity_norm"))
def anonymous(spark, sf):
    from shelflight.plans.recommend import anonymous_recommendations

    popular = popularity.normalize_popularity(popularity.popularity_stats(testviews.interactions(spark, sf)))
    popular = popular.withColumn("popularity_score", F.round("popularity_score", 9))
    return anonymous_recommendations(popular, shuffle=False).select("item_id", "pos")


@query("I17_similar_items_page", with_blocks("""
  SELECT query_id, item_id, position FROM (
    SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY position) AS position
    FROM neighbours WHERE query_id <> item_id) WHERE position <= 20""", "neighbours"))
def similar_items_page(spark, sf):
    from shelflight.plans.recommend import similar_item_pages

    return similar_item_pages(
        testviews.item_vectors(spark, sf), _catalogue(spark, sf), 20
    ).filter("rule IS NULL").select("query_id", "item_id", "position")


@query("I18_decorated", with_blocks("""
  SELECT user_id, title, row_number() OVER (PARTITION BY user_id ORDER BY rank_position) AS position
  FROM ranked_list JOIN products ON parent_asin = item_id WHERE store IS NOT NULL""", "ranked_list", "products"))
def decorated(spark, sf):
    known = _catalogue(spark, sf).filter(F.col("store").isNotNull())
    listed = _ranked_list(spark, sf).withColumnRenamed("rank_position", "position")
    return rerank.decorated(listed, known).select("user_id", "title", "position")


@query("I16_recommendations")
def recommendations(spark, sf):
    from shelflight.plans.recommend import Inputs, recommend

    rows = _interactions(spark, sf)
    popular = popularity.normalize_popularity(popularity.popularity_stats(rows))
    logs = testviews.interaction_logs(spark, sf).withColumn("user_id", F.col("user_id").cast("string"))
    out = recommend(Inputs(
        users=rows.select("user_id").distinct(), user_factors=testviews.user_factors(spark, sf),
        item_factors=testviews.item_factors(spark, sf), popularity=popular, items=_catalogue(spark, sf),
        vectors=testviews.item_vectors(spark, sf), logs=logs, as_of=logs.agg(F.max("ts")).scalar(),
    ))
    return out.select("user_id", "position", "item_id", F.round("adjusted_score", 8).alias("adjusted_score"),
                      "recall_count", "ranking_count")


# --- J: evaluation -------------------------------------------------------------------

@query("J1_rating_errors", with_blocks("""
  SELECT count(*) AS pairs, round(sqrt(avg((p - rating) ** 2)), 6) AS rmse, round(avg(abs(p - rating)), 6) AS mae FROM (
    SELECT rating, greatest(1, least(5, (SELECT avg(rating) FROM train) + bias + mf_score)) AS p
    FROM mf_pairs JOIN test USING (user_id, item_id, rating, ts))""", "mf_pairs", "train", "test"))
def rating_errors(spark, sf):
    train, test = inter.split_last_out(_interactions(spark, sf))
    mean = train.agg(F.avg("rating")).first()[0]
    out = factors.predict(test, testviews.user_factors(spark, sf), testviews.item_factors(spark, sf), mean)
    return _round(evaluate.rating_errors(out), 6, "rmse", "mae")


_POPULAR_LISTS = """
  SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY pos) AS position FROM popular_recall"""


@query("J2_precision_recall", with_blocks(f"""
  SELECT k, count(*) AS users, round(avg(hits / k), 6) AS precision, round(avg(hits / liked), 6) AS recall FROM (
    SELECT k, l.user_id, count(*) AS liked, count(r.item_id) AS hits
    FROM (SELECT k, user_id, item_id FROM (SELECT unnest([5, 10, 20]) AS k),
                 (SELECT DISTINCT user_id, item_id FROM test WHERE rating >= 4)) l
    LEFT JOIN ({_POPULAR_LISTS}) r ON r.user_id = l.user_id AND r.item_id = l.item_id AND r.position <= k
    GROUP BY 1, 2) GROUP BY 1""", "test", "popular_recall"))
def precision_recall(spark, sf):
    test = inter.split_last_out(testviews.interactions(spark, sf))[1]
    liked = evaluate.positives(test, testviews.user_factors(spark, sf), testviews.item_factors(spark, sf))
    lists = _popular_recall(spark, sf).withColumnRenamed("pos", "position")
    return _round(evaluate.precision_recall(lists, liked), 6, "precision", "recall")


# The lists of the factor model; its scores are compared to nine digits, equal ones go by item id.
@query("J2_factor_lists", with_blocks(f"""
  SELECT k, count(*) AS users, round(avg(hits / k), 6) AS precision, round(avg(hits / liked), 6) AS recall FROM (
    SELECT k, l.user_id, count(*) AS liked, count(r.item_id) AS hits
    FROM (SELECT k, user_id, item_id FROM (SELECT unnest([5, 10, 20]) AS k),
                 (SELECT DISTINCT user_id, item_id FROM test WHERE rating >= 4)) l
    LEFT JOIN (
      SELECT u.id AS user_id, i.id AS item_id,
             row_number() OVER (PARTITION BY u.id ORDER BY round({sql_dot("u.factors", "i.factors")}, 9) DESC, i.id) AS position
      FROM user_factors u, item_factors i QUALIFY position <= 20
    ) r ON r.user_id = l.user_id AND r.item_id = l.item_id AND r.position <= k
    GROUP BY 1, 2) GROUP BY 1""", "test", "user_factors", "item_factors"))
def factor_lists(spark, sf):
    test = inter.split_last_out(_interactions(spark, sf))[1]
    users, items = testviews.user_factors(spark, sf), testviews.item_factors(spark, sf)
    lists = factors.factor_recall(users, items, max(evaluate.CUTS))
    return _round(evaluate.precision_recall(lists, evaluate.positives(test, users, items)), 6, "precision", "recall")


# Stand-in factors over all items a user has not trained on; equal scores go by item id.
@query("J3_leave_one_out", with_blocks(f"""
  SELECT k, count(*) AS users, round(avg(hits / k), 6) AS precision, round(avg(hits / liked), 6) AS recall FROM (
    SELECT k, l.user_id, count(*) AS liked, count(r.item_id) AS hits
    FROM (SELECT k, user_id, item_id FROM (SELECT unnest([5, 10, 20]) AS k),
                 (SELECT DISTINCT user_id, item_id FROM test WHERE rating >= 3.5)) l
    LEFT JOIN (
      SELECT u.id AS user_id, i.id AS item_id,
             row_number() OVER (PARTITION BY u.id ORDER BY round({sql_dot("u.factors", "i.factors")}, 9) DESC, i.id) AS position
      FROM user_factors u, item_factors i
      ANTI JOIN (SELECT DISTINCT user_id AS uid, item_id AS iid FROM split WHERE ts < last_ts) s ON s.uid = u.id AND s.iid = i.id
      QUALIFY position <= 20) r ON r.user_id = l.user_id AND r.item_id = l.item_id AND r.position <= k
    GROUP BY 1, 2) GROUP BY 1""", "test", "split", "user_factors", "item_factors"))
def leave_one_out(spark, sf):
    train, test = inter.split_last_out(_interactions(spark, sf))
    users, items = testviews.user_factors(spark, sf), testviews.item_factors(spark, sf)
    lists = factors.factor_recall_unseen(users, items, train, 20)
    liked = evaluate.positives(test, users, items, 3.5)
    return _round(evaluate.precision_recall(lists, liked), 6, "precision", "recall")


@query("J3_fitted_leave_one_out")
def fitted_leave_one_out(spark, sf):
    model, (train, test) = _fitted(spark, sf)
    users, items = keep(model.users, "user-factors"), keep(model.items, "item-factors")
    lists = factors.factor_recall_unseen(users, items, train, 20)
    return evaluate.precision_recall(lists, evaluate.positives(test, users, items, 3.5))


block("liked", "SELECT DISTINCT user_id, item_id FROM test WHERE rating >= 4", "test")
block("shown", """
  SELECT s.user_id, n.item_id AS rec, n.score, v.category
  FROM (SELECT * FROM liked QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY item_id) <= 5) s
  JOIN neighbours n ON n.query_id = s.item_id AND n.position <= 10 JOIN vectors v ON v.item_id = n.item_id""",
      "liked", "neighbours", "vectors")
block("per_user", """
  SELECT s.user_id, count(DISTINCT rec) AS recs, count(DISTINCT l.item_id) AS hits,
         count(DISTINCT category) / count(*) AS diversity,
         (SELECT count(*) FROM liked x WHERE x.user_id = s.user_id) AS n_liked
  FROM shown s LEFT JOIN liked l ON l.user_id = s.user_id AND l.item_id = s.rec GROUP BY 1""", "shown", "liked")


@query("J4_content_quality", with_blocks("""
  SELECT round(avg(hits / recs), 5) AS precision, round(avg(hits / n_liked), 5) AS recall,
         round(avg(CAST(hits > 0 AS INTEGER)), 5) AS hit_rate, (SELECT round(avg(score), 5) FROM shown) AS avg_similarity,
         round(avg(diversity), 5) AS category_diversity, CAST(sum(recs) AS BIGINT) AS total_recommendations,
         (SELECT count(DISTINCT user_id) FROM liked) AS valid_users,
         (SELECT count(DISTINCT rec) FROM shown) AS unique_recommended_items,
         round((SELECT count(DISTINCT rec) FROM shown) / (SELECT count(DISTINCT item_id) FROM test), 5) AS coverage
  FROM per_user""", "per_user", "test"))
def content_quality(spark, sf):
    test = keep(inter.split_last_out(_interactions(spark, sf))[1], "test")
    v = testviews.item_vectors(spark, sf)
    asked = v.join(evaluate.quality_seeds(test).select("item_id").distinct(), "item_id", "left_semi")
    out = evaluate.content_quality(test, nearest.similar_items(asked, v, 10), v.select("item_id", "category"))
    return _round(out, 5, "precision", "recall", "hit_rate", "avg_similarity", "category_diversity", "coverage")


@query("J5_similarity_quality", with_blocks("""
  SELECT round(avg(score), 5) AS avg_similarity, round(min(score), 5) AS min_similarity, round(max(score), 5) AS max_similarity,
         round(count(*) / count(DISTINCT query_id), 5) AS avg_recommendations_per_item,
         round(median(score), 5) AS median_similarity FROM neighbours WHERE position <= 10""", "neighbours"))
def similarity_quality(spark, sf):
    v = testviews.item_vectors(spark, sf)
    return _round(
        evaluate.similarity_quality(nearest.similar_items(v, v, 10)), 5,
        "avg_similarity", "min_similarity", "max_similarity", "avg_recommendations_per_item", "median_similarity",
    )
