"""Product types, details, features and descriptions of an item."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelflight.functions import rules
from shelflight.functions.matching import contains_any, first_contained, null_like, strings


def product_type(title: Column, patterns=rules.PRODUCT_TYPES, default: str | None = "default") -> Column:
    """The first known type whose pattern the title contains."""
    return first_contained(F.lower(F.coalesce(title, F.lit(""))), patterns, default)


def semantic_details(details: Column) -> Column:
    """Details under a whitelisted key with a real value of at most 100 characters, trimmed.

    Keys come out in whitelist order.
    """
    def entry(key: Column) -> Column:
        return F.struct(key.alias("key"), F.trim(F.element_at(details, key)).alias("value"))

    entries = F.filter(
        F.transform(strings(rules.SEMANTIC_DETAIL_KEYS), entry),
        lambda e: e["value"].isNotNull()
        & ~null_like(e["value"], rules.NULL_LIKE)
        & (F.length(e["value"]) <= rules.MAX_DETAIL_LENGTH),
    )
    return F.map_from_entries(F.coalesce(entries, F.array().cast("array<struct<key:string,value:string>>")))


def usage_features(features: Column) -> Column:
    """Up to five features of 5 to 100 characters."""
    trimmed = F.transform(F.coalesce(features, F.array().cast("array<string>")), lambda f: F.trim(f))
    return F.slice(F.filter(trimmed, lambda f: F.length(f).between(5, 100)), 1, 5)


def first_sentence(text: Column) -> Column:
    """The text before the first full stop, else before '!' or '?', else its first 100 characters."""
    whole = F.trim(text)

    def before(mark: str) -> Column:
        head = F.trim(F.substring_index(whole, mark, 1))
        return F.when(head != "", head)

    return F.coalesce(before("."), before("!"), before("?"), F.trim(F.substring(whole, 1, 100)))


def description_fallback(description: Column) -> Column:
    """First sentence of the first description that is long enough and not marketing, 150 characters at most."""
    sentences = F.transform(
        F.filter(F.coalesce(description, F.array().cast("array<string>")), lambda d: F.trim(d) != ""),
        first_sentence,
    )
    good = F.get(
        F.filter(
            sentences,
            lambda s: (F.length(s) >= 10) & ~contains_any(F.lower(s), rules.DESCRIPTION_MARKETING_WORDS),
        ),
        F.lit(0),
    )
    cut = F.when(F.length(good) > 150, F.concat(F.substring(good, 1, 147), F.lit("..."))).otherwise(good)
    return F.coalesce(cut, F.lit(""))


def lowered(details: Column) -> Column:
    """Details as (key, name, value) entries: the key in lower case, the name as it was."""
    return F.transform(
        F.map_entries(details),
        lambda e: F.struct(F.lower(e["key"]).alias("key"), e["key"].alias("name"), e["value"].alias("value")),
    )


def entry_for(entries: Column, key: Column) -> Column:
    """The entry with that lower-case key; of keys that differ only in case the last one counts."""
    return F.try_element_at(F.filter(entries, lambda e: e["key"] == key), F.lit(-1))


def strong_attributes(title: Column, entries: Column) -> Column:
    """Up to three attributes that tell products apart, from the title first, then the details."""
    text = F.lower(F.coalesce(title, F.lit("")))
    found = []
    for word in rules.STRONG_ATTRIBUTES:
        if word in ("auto", "human hair"):
            continue
        hit = F.contains(text, F.lit(word))
        if word == "pack of":
            number = F.regexp_extract(text, r"pack of (\p{Nd}+)", 1)
            found.append(F.when(hit & (number != ""), F.concat(F.lit("pack of "), number)))
        elif word == "13x1":
            found.append(F.when(hit, F.lit("13x1 lace front")))
        elif word == "lace front":
            found.append(F.when(hit & ~F.contains(text, F.lit("13x1")), F.lit(word)))
        else:
            found.append(F.when(hit, F.lit(word)))

    def detail(keys: list[str], allowed: list[str]) -> Column:
        value = F.lower(F.trim(first_value(entries, keys)))
        return F.when(value.isin(*allowed), value)

    found.append(detail(["material", "material type"], rules.STRONG_MATERIALS))
    found.append(detail(["form", "product form", "item form"], rules.STRONG_FORMS))
    return F.slice(F.array_distinct(F.array_compact(F.array(*found))), 1, 3)


def first_value(entries: Column, keys: list[str]) -> Column:
    """The first non-empty value among lower-case keys."""
    values = [entry_for(entries, F.lit(k))["value"] for k in keys]
    return F.coalesce(*[F.when(v != "", v) for v in values])
