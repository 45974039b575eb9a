"""JSON held in text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelflight.functions.common import blank_to_null

_OBJECT = "map<string,variant>"


def as_valid_json(text: Column) -> Column:
    """Text that is not JSON becomes a JSON string holding it; null stays null.

    The parser ignores what follows the first value (``12 apples``), so the text is parsed as the
    first of two elements, the second being its own digest: they come out as such only if the
    whole text is one value.
    """
    quoted = F.regexp_extract(F.to_json(F.array(text)), r"(?s)^\[(.*)\]$", 1)
    pair = F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), F.md5(text), F.lit('"]')))
    whole = F.coalesce(F.try_variant_get(pair, "$[1]", "string") == F.md5(text), F.lit(False))
    return F.when(text.isNotNull() & ~whole, quoted).otherwise(text)


def brand_of(metadata: Column) -> Column:
    """``brand`` or else ``Brand`` of a JSON object."""
    return F.coalesce(
        blank_to_null(F.get_json_object(metadata, "$.brand")),
        blank_to_null(F.get_json_object(metadata, "$.Brand")),
    )


def enriched_metadata(metadata: Column, category: Column, brand: Column) -> Column:
    """Put category and brand, where known, into a JSON object, keeping its other values as they are."""
    base = F.coalesce(F.from_json(metadata, _OBJECT), F.from_json(F.lit("{}"), _OBJECT))
    known = F.map_filter(
        F.create_map(F.lit("category"), category, F.lit("brand"), brand), lambda _, v: v.isNotNull() & (v != "")
    )
    added = F.coalesce(F.from_json(F.to_json(known), _OBJECT), F.from_json(F.lit("{}"), _OBJECT))
    kept = F.map_filter(base, lambda k, _: ~F.map_contains_key(known, k))
    return F.to_json(F.map_concat(kept, added))
