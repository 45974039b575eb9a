"""The batch build: from JSON lines to interactions, factors, a stored ranker, texts, a vector index and metrics.

Every phase is a function from frames to a frame; ``build`` writes what later phases read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelflight.operators import (
    evaluate, factors, interactions, kcore, metadata, nearest, popularity, ranker, reviews, texts, vector_index,
)
from shelflight.schemas import METADATA_RAW, REVIEWS_RAW
from shelflight.sources.jsonl import read_jsonl, require_rows
from shelflight.sources.sinks import write_metrics
from shelflight.sources.tables import write_table


def build(
    spark: SparkSession, reviews_path: str, metadata_path: str, out: str, k: int = 5, fit_on: str = "train", encoder=None,
) -> dict[str, DataFrame]:
    """Run all phases and return the written tables by name.

    Beside the tables, ``out`` gets the ``ranker``, the ``vector_index`` and ``metrics``.  ``encoder``
    makes the text vectors; see ``nearest.encode_texts``.
    """
    tables: dict[str, DataFrame] = {}

    def save(name: str, df: DataFrame) -> DataFrame:
        path = f"{out}/{name}"
        write_table(df, path)
        tables[name] = spark.read.parquet(path)
        return tables[name]

    raw = require_rows(save("reviews_raw", read_jsonl(spark, reviews_path, REVIEWS_RAW)), reviews_path)
    meta_raw = require_rows(save("metadata_raw", read_jsonl(spark, metadata_path, METADATA_RAW)), metadata_path)
    clean = save("reviews_clean", reviews.clean_reviews(reviews.normalize_reviews(raw)))
    meta = save("metadata_clean", metadata.clean_metadata(metadata.normalize_metadata(meta_raw)))
    save("items_for_rs", interactions.items_for_rs(meta))
    everything = save("interactions_all", interactions.build_interactions(clean))
    core = save("interactions_core", kcore.k_core(everything, k).rows)
    train, test = interactions.split_last_out(core)
    train, test = save("interactions_train", train), save("interactions_test", test)
    both = interactions.union_rows(train, test)
    stats = save("item_popularity", popularity.popularity_stats(both))
    popular = save("item_popularity_normalized", popularity.normalize_popularity(stats))
    fitted = factors.fit_factors(train, fit_on=both if fit_on == "all" else None)
    users, items = save("user_factors", fitted.users), save("item_factors", fitted.items)
    dataset = save("ranking_dataset", ranker.ranking_dataset(both, users, items, popular))

    rank_train, rank_test = ranker.stratified_split(dataset)
    ranker.save_ranker(ranker.fit_ranker(rank_train), f"{out}/ranker")
    # The model that is evaluated is the one that was stored.
    model = ranker.load_ranker(f"{out}/ranker")
    write_metrics(ranker.binary_metrics(model, rank_test), f"{out}/metrics/ranker")
    write_metrics(evaluate.rating_errors(factors.predict(test, users, items, fitted.mean)), f"{out}/metrics/ratings")
    lists = factors.factor_recall(users, items, max(evaluate.CUTS))
    write_metrics(evaluate.precision_recall(lists, evaluate.positives(test, users, items)), f"{out}/metrics/lists")

    view = metadata.unique_text_view(metadata.text_view(meta_raw))
    eligible = texts.eligible_only(texts.with_eligibility(texts.cleaned_titles(view)))
    attributes = save("semantic_attributes", texts.semantic_attributes(eligible))
    text = texts.cleaned_texts(texts.compact_texts(attributes))
    text = save("embedding_text", text.select(F.col("parent_asin").alias("item_id"), "embedding_text"))
    vectors = save("item_vectors", nearest.encode_texts(text, encoder))
    vector_index.build_index(vectors, f"{out}/vector_index")
    return tables
