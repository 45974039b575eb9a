"""Category resolution and type-to-category mapping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelflight.functions import rules
from shelflight.functions.common import let
from shelflight.functions.matching import first_contained


def _usable(category: Column) -> Column:
    return F.when((category != "") & (category != rules.DATASET_CATEGORY), category)


# What category resolution reads of a product's JSON; a nested list comes as the text of the inner one.
_READ = "title string, categories array<string>, details struct<{}>".format(
    ", ".join(f"`{key}`: string" for key in rules.CATEGORY_DETAIL_KEYS)
)


def resolve_category(current: Column, metadata: Column, wide: bool = False) -> Column:
    """A specific category for every product.

    The current one unless it is only the data set's name; else the first listed category
    (nested once or flat); else a category-like detail; else the first keyword in the
    title; else the generic category, also for JSON that does not parse.  The JSON is parsed once.
    """
    keywords = rules.CATEGORY_KEYWORDS_WIDE if wide else rules.CATEGORY_KEYWORDS

    def from_parsed(parsed: Column) -> Column:
        first = F.get(parsed["categories"], F.lit(0))
        inner = F.get(F.from_json(F.when(first.startswith("["), first), "array<string>"), F.lit(0))
        listed = F.array(
            _usable(inner), _usable(F.when(~first.startswith("["), first)),
            *[_usable(parsed["details"][key]) for key in rules.CATEGORY_DETAIL_KEYS],
        )
        by_title = let(F.lower(F.coalesce(parsed["title"], F.lit(""))), lambda title: first_contained(title, keywords))
        return F.coalesce(F.get(F.array_compact(listed), F.lit(0)), by_title)

    return F.coalesce(_usable(current), let(F.from_json(metadata, _READ), from_parsed), F.lit(rules.GENERIC_CATEGORY))


def category_of_type(product_type: Column) -> Column:
    """Exact key, else the first key that contains or is contained in the type, else the fallback."""
    kind = F.lower(F.trim(product_type))
    exact = F.coalesce(*[F.when(kind == key, F.lit(value)) for key, value in rules.CATEGORY_BY_TYPE])
    partial = F.coalesce(
        *[
            F.when(F.contains(kind, F.lit(key)) | F.contains(F.lit(key), kind), F.lit(value))
            for key, value in rules.CATEGORY_BY_TYPE
        ]
    )
    return F.when(F.coalesce(product_type, F.lit("")) == "", rules.FALLBACK_CATEGORY).otherwise(
        F.coalesce(exact, partial, F.lit(rules.FALLBACK_CATEGORY))
    )
