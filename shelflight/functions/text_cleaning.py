"""Cleaning of finished embedding texts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelflight.functions import rules
from shelflight.functions.embedding_text import shortened_list
from shelflight.functions.matching import contains_any
from shelflight.functions.titles import squeeze

_LABELS = [rules.LABEL_TITLE, rules.LABEL_CATEGORY, rules.LABEL_BRAND, rules.LABEL_ATTRIBUTES]
_LETTER = "A-Za-zÀ-ỹ"


def _either_case_first(label: str) -> str:
    return f"[{label[0].upper()}{label[0].lower()}]{label[1:]}"


def tidy_punctuation(text: Column) -> Column:
    """One mark instead of runs, no blank before a mark, one after a stop or colon before a letter."""
    for mark in (r"\.", ",", ":", ";"):
        text = F.regexp_replace(text, mark + "{2,}", mark.strip("\\"))
    text = F.regexp_replace(text, r"[\s\p{Z}]+([.,:;])", "$1")
    text = F.regexp_replace(text, rf"\.([{_LETTER}])", ". $1")
    return F.regexp_replace(text, rf":([{_LETTER}])", ": $1")


def without_promotion(text: Column) -> Column:
    """Promotional phrases vanish together with the marks and blanks around them, one phrase after the other.

    A text without any phrase, the common case, is recognised by plain substring tests.
    """
    cleaned = text
    for phrase in rules.PROMO_PHRASES:
        cleaned = F.regexp_replace(
            cleaned, rf"(?iu)[.,:;]?[\s\p{{Z}}]*{re.escape(phrase)}[\s\p{{Z}}]*[.,:;]?", ""
        )
    return F.when(contains_any(F.lower(text), rules.PROMO_PHRASES), cleaned).otherwise(text)


def _split_stops(text: Column, pattern: str) -> Column:
    return F.split(text, pattern, -1)


def pruned_attributes(df: DataFrame) -> DataFrame:
    """The attribute section of ``_t``: distinct keys with real values, technical ones left out,
    five at most, 150 characters."""
    label = f"{rules.LABEL_ATTRIBUTES}:"
    text, pieces = F.col("_t"), F.col("_pieces")
    listed = F.filter(
        F.transform(_split_stops(F.get(pieces, F.lit(1)), r"\."), lambda a: F.trim(a)), lambda a: a != ""
    )

    def parsed(a: Column) -> Column:
        return F.struct(
            F.contains(a, F.lit(":")).alias("keyed"),
            F.trim(F.substring_index(a, ":", 1)).alias("key"),
            F.trim(F.substr(a, F.locate(":", a) + 1)).alias("value"),
            a.alias("whole"),
        )

    def usable(a: Column) -> Column:
        return F.when(
            a["keyed"],
            (a["value"] != "")
            & ~F.lower(a["value"]).isin(*rules.NULL_LIKE)
            & ~contains_any(F.lower(a["key"]), rules.UNIMPORTANT_KEY_PARTS),
        ).otherwise(F.length(a["whole"]) > 3)

    def is_first(x: Column, i: Column) -> Column:
        earlier = F.slice("_usable", F.lit(1), i)
        return ~x["keyed"] | ~F.exists(
            earlier, lambda e: e["keyed"] & (F.lower(e["key"]) == F.lower(x["key"]))
        )

    def shown(a: Column) -> Column:
        return F.when(a["keyed"], F.concat(a["key"], F.lit(": "), a["value"])).otherwise(a["whole"])

    staged = (
        df.withColumn("_pieces", F.when(F.contains(text, F.lit(label)), _split_stops(text, re.escape(label))))
        .withColumn("_usable", F.filter(F.transform(listed, parsed), usable))
        .withColumn("_shown", F.slice(F.transform(F.filter("_usable", is_first), shown), 1, 5))
    )
    prefix = F.rtrim(F.get(pieces, F.lit(0)))
    section = F.concat(prefix, F.lit(f"{label} "), shortened_list(F.col("_shown"), 150))
    kept = F.when(pieces.isNull(), text).when(F.size("_shown") > 0, section).otherwise(prefix)
    return staged.withColumn("_t", kept).drop("_pieces", "_usable", "_shown")


def merged_sentences(df: DataFrame) -> DataFrame:
    """Of sentences of ``_t`` with the same key, or the same words, only the first stays."""
    def key(s: Column) -> Column:
        keyed = F.contains(s, F.lit(":"))
        return F.lower(F.trim(F.when(keyed, F.substring_index(s, ":", 1)).otherwise(s)))

    staged = df.withColumn("_pieces", _split_stops(F.col("_t"), r"\. ")).withColumn(
        "_keys", F.transform("_pieces", key)
    )
    first = F.filter("_pieces", lambda s, i: F.array_position("_keys", F.get("_keys", i)) == i + 1)
    return staged.withColumn("_t", F.array_join(first, ". ")).drop("_pieces", "_keys")


def sentence_starts(text: Column) -> Column:
    """Upper case at the start and after every stop, and the labels in their own spelling."""
    pieces = _split_stops(text, rf"\.[\s\p{{Z}}]+(?=[{rules.LOWER_LETTERS}])")
    raised = F.array_join(
        F.transform(pieces, lambda s: F.concat(F.upper(F.substring(s, 1, 1)), F.substr(s, F.lit(2)))), ". "
    )
    for label in _LABELS:
        raised = F.regexp_replace(raised, f"(?iu){label}:", f"{label}:")
    return raised


def fitted(df: DataFrame, limit: int = rules.MAX_TEXT) -> DataFrame:
    """``_t`` within the limit: labelled sentences first, then the others, as many as fit."""
    text, ordered, rest = F.col("_t"), F.col("_ordered"), F.col("_rest")

    def labelled(s: Column) -> Column:
        return contains_any(F.lower(s), [f"{label.lower()}:" for label in _LABELS])

    def fitting(items: Column) -> Column:
        """How many leading items fit together."""
        sums = F.aggregate(
            items,
            F.struct(F.lit(0).alias("used"), F.lit(0).alias("count"), F.lit(False).alias("full")),
            lambda acc, s: F.when(
                ~acc["full"] & (acc["used"] + F.length(s) + 2 <= limit - 3),
                F.struct((acc["used"] + F.length(s) + 2).alias("used"), (acc["count"] + 1).alias("count"),
                         F.lit(False).alias("full")),
            ).otherwise(F.struct(acc["used"].alias("used"), acc["count"].alias("count"), F.lit(True).alias("full"))),
        )
        return sums["count"]

    too_long = F.length(text) > limit
    staged = (
        df.withColumn("_pieces", F.when(too_long, _split_stops(text, r"\. ")))
        .withColumn("_ordered", F.concat(
            F.filter("_pieces", labelled), F.filter("_pieces", lambda s: ~labelled(s))))
        .withColumn("_rest", F.slice(ordered, F.lit(2), F.greatest(F.size(ordered) - 1, F.lit(0))))
        .withColumn("_count", fitting(ordered))
        .withColumn("_rest_count", F.when(F.col("_count") == 0, fitting(rest)))
    )
    # When not even the first fits it is cut, and the following ones are measured without it.
    first = F.concat(F.substring(F.get(ordered, F.lit(0)), 1, limit - 3), F.lit("..."))
    cut_first = F.array_join(F.concat(F.array(first), F.slice(rest, F.lit(1), F.col("_rest_count"))), ". ")
    staged = staged.withColumn("_joined", F.when(
        F.col("_count") > 0, F.array_join(F.slice(ordered, F.lit(1), F.col("_count")), ". ")).otherwise(cut_first))
    capped = F.when(
        F.length("_joined") > limit, F.concat(F.substring("_joined", 1, limit - 3), F.lit("..."))
    ).otherwise(F.col("_joined"))
    return staged.withColumn("_t", F.when(too_long, capped).otherwise(text)).drop(
        "_pieces", "_ordered", "_rest", "_count", "_rest_count", "_joined"
    )


def _spaced_labels(text: Column) -> Column:
    names = "|".join(_either_case_first(label) for label in _LABELS)
    return F.regexp_replace(F.regexp_replace(text, rf"\.({names})", ". $1"), rf":({names})", ": $1")


def clean_texts(df: DataFrame, column: str = "embedding_text") -> DataFrame:
    """Clean a text column; a text that would become empty stays as it was."""
    def step(work: DataFrame, fn) -> DataFrame:
        return work.withColumn("_t", fn(F.col("_t")))

    work = df.withColumn("_t", F.coalesce(F.col(column), F.lit("")))
    work = step(work, lambda t: _spaced_labels(squeeze(t)))
    work = step(work, lambda t: F.regexp_replace(squeeze(tidy_punctuation(t)), rf"\.([{_LETTER}])", ". $1"))
    work = pruned_attributes(step(work, without_promotion))
    work = step(merged_sentences(work), squeeze)
    work = fitted(step(work, sentence_starts))
    work = step(work, squeeze)
    return work.withColumn(column, F.when(F.col("_t") == "", F.col(column)).otherwise(F.col("_t"))).drop("_t")
