"""Item texts for embedding, in five styles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelflight.functions import rules
from shelflight.functions.attributes import entry_for, first_value, lowered, product_type, strong_attributes
from shelflight.functions.jsontext import brand_of
from shelflight.functions.matching import contains_any, first_contained, null_like, strings


def sentence_case(text: Column) -> Column:
    """First letter upper case, everything else lower case."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substr(text, F.lit(2))))


def _filled(text: Column) -> Column:
    """Null instead of an empty text."""
    return F.when(text != "", text)


def _with_stop(text: Column) -> Column:
    return F.when(text.endswith("."), text).otherwise(F.concat(text, F.lit(".")))


def _capped(text: Column, limit: int = rules.MAX_TEXT) -> Column:
    return F.when(
        F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))
    ).otherwise(text)


def _tidy(text: Column) -> Column:
    """Blanks squeezed, runs of full stops reduced to one."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"\.{2,}", "."))


def details_of(metadata: Column) -> Column:
    """The ``details`` object of a JSON record as text values; empty when absent."""
    empty = F.create_map().cast("map<string,string>")
    return F.coalesce(F.from_json(F.get_json_object(metadata, "$.details"), "map<string,string>"), empty)


def brand_or_store(metadata: Column, store: Column) -> Column:
    """Brand, else store, trimmed; null when it says nothing."""
    name = F.coalesce(brand_of(metadata), _filled(store))
    return F.when(~null_like(name, rules.NULL_LIKE), F.trim(name))


# --- compact -------------------------------------------------------------------------

def type_sentence(kind: Column) -> Column:
    """The sentence that describes a product type; null for the default type."""
    known = F.create_map(*[F.lit(x) for pair in rules.TYPE_SENTENCES.items() for x in pair])
    generic = F.concat(sentence_case(kind), F.lit(" product."))
    return F.when((kind != "") & (kind != "default"), F.coalesce(F.element_at(known, kind), generic))


def attribute_sentence(attributes: Column) -> Column:
    """Up to three attribute values as one sentence: the important keys first, then the others."""
    important = strings(rules.ATTRIBUTE_PRIORITY)
    others = F.filter(F.map_keys(attributes), lambda k: ~F.array_contains(important, k))
    ordered = F.transform(F.concat(important, others), lambda k: F.element_at(attributes, k))
    top = F.slice(F.filter(ordered, lambda v: v.isNotNull() & (F.trim(v) != "")), 1, 3)
    a, b, c = (F.get(top, F.lit(i)) for i in range(3))
    return (
        F.when(F.size(top) == 0, F.lit(None).cast("string"))
        .when(F.size(top) == 1, F.concat(sentence_case(a), F.lit(" product.")))
        .when(F.size(top) == 2, F.concat(sentence_case(a), F.lit(" "), F.lower(b), F.lit(" product.")))
        .otherwise(F.concat(sentence_case(a), F.lit(" "), F.lower(b), F.lit(" with "), F.lower(c), F.lit(".")))
    )


def compact_text() -> Column:
    """From the semantic attribute columns: title, type, attributes, first feature or description."""
    title = F.coalesce(_filled(F.trim("clean_title")), F.lit("Product"))
    semantic = F.col("details_has_semantic") & (F.col("semantic_detail_count") >= 2)
    feature = _with_stop(_filled(F.trim(F.get("usage_features", F.lit(0)))))
    fallback = F.when(
        (F.size("usage_features") == 0) & ~semantic, _with_stop(_filled(F.trim("description_fallback")))
    )
    return F.trim(
        F.concat_ws(
            " ", title, type_sentence(F.col("product_type")),
            F.when(semantic, attribute_sentence(F.col("attributes"))), feature, fallback,
        )
    )


# --- field-labelled ------------------------------------------------------------------

def _telling(value: Column) -> Column:
    """A value worth showing: not null-like, no link, no bare number, at most 100 characters."""
    text = F.trim(value)
    return (
        value.isNotNull()
        & ~null_like(text, rules.NULL_LIKE)
        & ~text.startswith("http")
        & ~text.startswith("www.")
        & ~F.regexp_replace(text, r"[.,\- ]", "").rlike(r"^\p{Nd}+$")
        & (F.length(text) <= 100)
    )


def shortened_list(items: Column, limit: int) -> Column:
    """Items joined by ". "; as many leading ones as fit when the whole is too long.

    ``items`` should be a plain column: it is used many times.
    """
    whole = F.array_join(items, ". ")
    fits = F.filter(
        F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1))),
        lambda n: F.aggregate(F.slice(items, F.lit(1), n), F.lit(0), lambda acc, x: acc + F.length(x) + 2)
        <= limit - 3,
    )
    some = F.concat(F.array_join(F.slice(items, F.lit(1), F.size(fits)), ". "), F.lit("..."))
    one = F.concat(F.substring(F.get(items, F.lit(0)), 1, limit - 3), F.lit("..."))
    return (
        F.when(F.size(items) == 0, F.lit(""))
        .when(F.length(whole) <= limit, whole)
        .when(F.size(fits) > 0, some)
        .otherwise(one)
    )


def _with_labelled_attributes(df: DataFrame) -> DataFrame:
    """Add ``_attributes``: up to six "key: value" entries within 200 characters.

    Important keys come first in their own order; with fewer than five of them the other
    keys follow, except technical ones, a repeated brand and plain refusals, until there
    are eight.
    """
    entries = F.col("_entries")
    important_entries = F.filter(
        F.transform(strings(rules.LABELLED_KEYS), lambda k: entry_for(entries, k)),
        lambda e: e.isNotNull() & _telling(e["value"]),
    )

    def shown(e: Column) -> Column:
        return F.concat(e["name"], F.lit(": "), e["value"])

    def other(e: Column) -> Column:
        same_brand = F.contains(e["key"], F.lit("brand")) & F.coalesce(
            F.lower(F.trim(e["value"])) == F.lower(F.col("_brand")), F.lit(False)
        )
        return (
            ~F.exists(F.col("_important"), lambda i: i["key"] == e["key"])
            & ~contains_any(e["key"], rules.LABELLED_EXCLUDED)
            & ~same_brand
            & ~F.lower(e["value"]).isin("no", "false", "none", "n/a")
            & _telling(e["value"])
        )

    staged = df.withColumn("_important", important_entries).withColumn("_others", F.filter(entries, other))
    count = F.size("_important")
    room = F.when(count < 5, F.lit(8) - count).otherwise(F.lit(0))
    listed = F.slice(F.concat("_important", F.slice("_others", F.lit(1), room)), 1, 6)
    return staged.withColumn("_listed", F.transform(listed, shown)).withColumn(
        "_attributes", shortened_list(F.col("_listed"), 200)
    )


def labelled_texts(items: DataFrame) -> DataFrame:
    """Name, category, brand and attributes behind their labels, at most 500 characters."""
    def shown(label: str, value: Column) -> Column:
        return F.when(~null_like(value, rules.NULL_LIKE), F.concat(F.lit(f"{label}: "), F.trim(value)))

    parts = F.array_compact(
        F.array(
            shown(rules.LABEL_TITLE, F.col("title")),
            shown(rules.LABEL_CATEGORY, F.col("main_category")),
            shown(rules.LABEL_BRAND, F.col("_brand")),
            F.concat(F.lit(f"{rules.LABEL_ATTRIBUTES}: "), _filled(F.col("_attributes"))),
        )
    )
    staged = _with_labelled_attributes(items).withColumn("_parts", parts)
    count = F.size("_parts")
    staged = staged.withColumn("_whole", F.array_join("_parts", ". ")).withColumn(
        "_prefix", F.array_join(F.slice("_parts", F.lit(1), F.greatest(count - 1, F.lit(0))), ". ")
    )
    room = F.lit(500 - 3) - (F.length("_prefix") + 2)
    last = F.get("_parts", count - 1)
    trimmed = (
        F.when((count > 3) & (room > 20),
               F.concat("_prefix", F.lit(". "), F.substr(last, F.lit(1), room), F.lit("...")))
        .when(count > 3, F.col("_prefix"))
        .otherwise(F.col("_whole"))
    )
    staged = staged.withColumn("_trimmed", F.when(F.length("_whole") > 500, trimmed).otherwise(F.col("_whole")))
    return staged.withColumn("embedding_text", _capped(F.col("_trimmed")))


# --- descriptive ---------------------------------------------------------------------

def descriptive_use(title: Column, kind: Column) -> Column:
    """What the product is for, from its type first, then from title keywords."""
    k = F.lower(kind)

    def has(*words: str) -> Column:
        return contains_any(k, words)

    by_type = (
        F.when(has("hair") & has("clip", "accessory"), "beauty accessories")
        .when(has("hair") & has("extension", "wig"), "hair extension")
        .when(has("hair") & has("spray", "gel"), "hair styling")
        .when(has("eye", "mascara"), "eye makeup")
        .when(has("lip"), "lip makeup")
        .when(has("makeup"), "face makeup")
        .when(has("nail"), "nail care")
        .when(has("skincare"), "skincare")
        .when(has("perfume", "cologne"), "fragrance")
        .when(has("deodorant", "antiperspirant"), "personal care")
    )
    flat = [(word, use) for use, words in rules.USAGE_KEYWORDS_DESCRIPTIVE for word in words]
    return F.coalesce(by_type, first_contained(F.lower(F.coalesce(title, F.lit(""))), flat))


def descriptive_category(kind: Column, use: Column) -> Column:
    return F.coalesce(
        first_contained(F.lower(F.coalesce(kind, F.lit(""))), rules.CATEGORY_BY_TYPE_DESCRIPTIVE),
        first_contained(F.lower(F.coalesce(use, F.lit(""))), rules.CATEGORY_BY_TYPE_DESCRIPTIVE),
        F.lit(rules.FALLBACK_CATEGORY),
    )


def _short_values(keys: list[str], limit: int, skipped: list[str]) -> Column:
    """(key, value) of the given lower-case keys whose values are short, telling and no link or number."""
    def good(text: Column) -> Column:
        return (
            text.isNotNull()
            & ~F.lower(text).isin(*skipped)
            & ~text.startswith("http")
            & ~text.startswith("www.")
            & ~F.regexp_replace(text, r"[.,\-]", "").rlike(r"^\p{Nd}+$")
            & (F.length(text) <= limit)
        )

    found = F.transform(
        strings(keys),
        lambda k: F.struct(k.alias("key"), F.trim(entry_for(F.col("_entries"), k)["value"]).alias("value")),
    )
    return F.filter(found, lambda e: good(e["value"]))


def descriptive_texts(items: DataFrame) -> DataFrame:
    """Title, brand when the title lacks it, then type, use, attributes and category as sentences."""
    name, kind, use, category = F.col("_name"), F.col("_kind"), F.col("_use"), F.col("_category")
    staged = (
        items.withColumn("_name", F.coalesce("title", F.lit("")))
        .withColumn("_kind", product_type(name, rules.PRODUCT_TYPES_DESCRIPTIVE, None))
        .withColumn("_use", descriptive_use(name, kind))
        .withColumn("_category", descriptive_category(kind, use))
        .withColumn("_values", _short_values(rules.DESCRIPTIVE_KEYS, 50, ["null", "none", "n/a", ""]))
    )
    vague = ["various", "assorted"]

    def said(lead: str, keys: list[str], tail: str = "", skip: list[str] = vague) -> Column:
        value = first_value(F.col("_values"), keys)
        return F.when(~F.lower(value).isin(*skip), F.concat(F.lit(lead), value, F.lit(tail)))

    intro = (
        F.when(kind.isNotNull() & use.isNotNull(), F.concat(F.lit("A "), kind, F.lit(" designed for "), use))
        .when(kind.isNotNull(), F.concat(F.lit("A "), kind, F.lit(" product")))
        .when(use.isNotNull(), F.concat(F.lit("A product for "), use))
    )
    told = F.array_compact(
        F.array(
            intro,
            said("available in ", ["form", "product form", "item form"], " form"),
            said("made from ", ["material", "material type"]),
            said("featuring ", ["style"], " style"),
            said("available in ", ["color", "colour"], "", vague + ["multi", "multicolor"]),
        )
    )
    category_told = F.exists("_told", lambda t: F.contains(F.lower(t), F.lower(category)))
    filed = F.when(
        (category != rules.FALLBACK_CATEGORY) & ~category_told, F.concat(F.lit("categorized as "), category)
    )
    by = F.when(~F.contains(F.lower(name), F.lower("_brand")), F.concat(F.lit("by "), F.col("_brand")))
    staged = (
        staged.withColumn("_told", told)
        .withColumn("_description", F.array_join(F.array_compact(F.concat("_told", F.array(filed))), ". "))
        .withColumn("_by", by)
        .withColumn("_full_parts", F.array_compact(
            F.array(_filled(F.trim(name)), F.col("_by"), _filled(F.col("_description")))))
        .withColumn("_full", _tidy(F.array_join("_full_parts", ". ")))
    )
    # A text under 100 characters is laid out again: description before brand, a stock phrase if none.
    plain = F.coalesce(_filled(F.col("_description")), F.lit("A beauty product"))
    short_parts = F.array_compact(F.array(_filled(name), plain, F.col("_by")))
    staged = staged.withColumn(
        "_parts", F.when(F.length("_full") < 100, short_parts).otherwise(F.col("_full_parts"))
    ).withColumn("_text", _tidy(F.array_join("_parts", ". ")))
    return staged.withColumn(
        "embedding_text",
        F.when(F.length("_text") > rules.MAX_TEXT, _two_part_cut(F.col("_parts"), F.col("_text")))
        .otherwise(F.col("_text")),
    )


def _two_part_cut(parts: Column, text: Column) -> Column:
    """Keep the first part whole and of the second as many words as fit."""
    first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    room = F.lit(rules.MAX_TEXT - 10) - F.length(first)
    words = F.filter(F.split(second, r"\s+"), lambda w: w != "")
    fits = F.size(
        F.filter(
            F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1))),
            lambda n: F.aggregate(F.slice(words, F.lit(1), n), F.lit(0), lambda acc, w: acc + F.length(w) + 1)
            <= room - 3,
        )
    )
    kept = F.when(F.length(second) <= room, second).when(
        fits > 0, F.concat(F.array_join(F.slice(words, F.lit(1), fits), " "), F.lit("..."))
    )
    return F.when(F.size(parts) > 1, F.concat_ws(". ", first, kept)).otherwise(_capped(text))


# --- natural sentences ---------------------------------------------------------------

def natural_type(title: Column) -> Column:
    flat = [(word, kind) for kind, words, _ in rules.PRODUCT_TYPES_NATURAL for word in words]
    return first_contained(F.lower(title), flat)


def natural_use(title: Column, kind: Column) -> Column:
    text = F.lower(title)
    by_type = F.coalesce(*[F.when(kind == k, F.lit(use)) for k, _, use in rules.PRODUCT_TYPES_NATURAL])
    by_title = (
        F.when(contains_any(text, ["eye", "mascara"]), "eye makeup application")
        .when(contains_any(text, ["lip"]), "lip makeup application")
        .when(contains_any(text, ["wig", "extension"]), "hair extension and styling")
        .when(contains_any(text, ["hair"]) & contains_any(text, ["clip", "accessory"]),
              "hair styling and accessories")
        .when(contains_any(text, ["hair"]), "hair styling and hold")
        .when(contains_any(text, ["makeup", "cosmetic"]), "cosmetic application")
        .when(contains_any(text, ["perfume", "cologne", "fragrance"]), "fragrance and personal scent")
        .when(contains_any(text, ["deodorant", "antiperspirant"]), "personal hygiene and odor control")
        .when(contains_any(text, ["shampoo", "conditioner"]), "hair care and cleansing")
        .when(contains_any(text, ["moisturizer", "cleanser", "serum"]), "skincare and hydration")
    )
    return F.coalesce(by_type, by_title)


def natural_category(use: Column) -> Column:
    return first_contained(
        F.coalesce(use, F.lit("")), rules.CATEGORY_BY_USE_NATURAL, rules.FALLBACK_CATEGORY
    )


def natural_texts(items: DataFrame) -> DataFrame:
    """Title, then one running description of type, use, attributes, category and brand."""
    name, kind, use, category = F.col("_name"), F.col("_kind"), F.col("_use"), F.col("_category")
    staged = (
        items.withColumn("_name", F.trim(F.coalesce("title", F.lit(""))))
        .withColumn("_kind", natural_type(name))
        .withColumn("_use", natural_use(name, kind))
        .withColumn("_category", natural_category(use))
        .withColumn("_values", _short_values(
            rules.NATURAL_KEYS, 30, ["null", "none", "n/a", "", "various", "assorted", "multi"]))
    )
    verb = (
        F.when(contains_any(use, ["makeup", "cosmetic"]), " is designed for ")
        .when(contains_any(use, ["hair"]), " is used for ")
        .when(contains_any(use, ["fragrance", "personal"]), " is intended for ")
        .otherwise(" serves for ")
    )
    intro = (
        F.when(kind.isNotNull() & use.isNotNull(), F.concat(F.lit("This "), kind, verb, use, F.lit(",")))
        .when(kind.isNotNull(), F.concat(F.lit("This "), kind, F.lit(" product")))
        .when(use.isNotNull(), F.concat(F.lit("A product designed for "), use))
        .otherwise("A beauty product")
    )

    def said(lead: str, keys: list[str], tail: str = "") -> Column:
        return F.concat(F.lit(lead), first_value(F.col("_values"), keys), F.lit(tail))

    told = F.concat_ws(
        " ",
        said("made from ", ["material", "material type"]),
        said("available as ", ["form", "product form"]),
        said("featuring ", ["style"], " styling"),
        said("in ", ["color", "colour"]),
    )
    sentences = F.array_compact(
        F.array(
            intro,
            _filled(told),
            F.when(category != rules.FALLBACK_CATEGORY, F.concat(F.lit("categorized under "), category)),
            F.when(~F.contains(F.lower(name), F.lower("_brand")), F.concat(F.lit("from "), F.col("_brand"))),
        )
    )
    body = F.col("_body")
    titled = F.when(body.startswith(name), body).otherwise(F.concat(name, F.lit(". "), body))
    more = (
        F.when(kind.isNotNull() & use.isNotNull(),
               F.concat(F.lit(" This "), kind, F.lit(" is designed for "), use, F.lit(".")))
        .when(kind.isNotNull(), F.concat(F.lit(" This is a "), kind, F.lit(" product.")))
        .otherwise("")
    )
    belongs = F.when(
        category != rules.FALLBACK_CATEGORY, F.concat(F.lit(" It belongs to "), category, F.lit("."))
    ).otherwise(" It is a beauty product.")
    text, longer = F.col("_text"), F.col("_longer")
    padded = F.when(F.length(longer) < 100, F.concat(longer, belongs)).otherwise(longer)
    staged = (
        staged.withColumn("_sentences", sentences)
        .withColumn("_body", F.array_join("_sentences", " "))
        .withColumn("_text", F.trim(F.regexp_replace(_tidy(titled), r",\s*,", ",")))
        .withColumn("_longer", F.concat(text, more))
        .withColumn("_text", F.when(F.length(text) < 100, padded).otherwise(text))
    )
    return staged.withColumn(
        "embedding_text",
        F.when(name == "", F.lit(""))
        .when(F.length(text) > rules.MAX_TEXT, _natural_cut(name, F.col("_sentences"), text))
        .otherwise(text),
    )


def _natural_cut(name: Column, sentences: Column, text: Column) -> Column:
    """Title and the leading sentences while each fits beside the one before it."""
    room = F.lit(rules.MAX_TEXT - 20) - F.length(F.get(sentences, F.lit(0))) - F.length(name)
    positions = F.sequence(F.lit(1), F.greatest(F.size(sentences) - 1, F.lit(1)))
    blocked = F.filter(
        positions,
        lambda i: F.length(F.get(sentences, i)) + F.length(F.get(sentences, i - 1)) > room,
    )
    count = F.when(F.size(blocked) > 0, F.get(blocked, F.lit(0))).otherwise(F.size(sentences))
    joined = F.array_join(F.slice(sentences, F.lit(1), count), " ")
    lead = F.when(F.get(sentences, F.lit(0)).startswith(name), joined).otherwise(
        F.concat(name, F.lit(". "), joined)
    )
    return _capped(F.when(F.size(sentences) > 1, lead).otherwise(text))


# --- semantic role -------------------------------------------------------------------

def role_texts(items: DataFrame) -> DataFrame:
    """Fixed template of type, primary use, functional role, key characteristics and category."""
    roles = F.create_map(
        *[
            x
            for key, (use, role, category) in rules.SEMANTIC_ROLES.items()
            for x in (
                F.lit(key),
                F.struct(F.lit(use).alias("use"), F.lit(role).alias("role"), F.lit(category).alias("category")),
            )
        ]
    )
    kind, meaning, strong = F.col("_kind"), F.col("_meaning"), F.col("_strong")
    kind_part = F.concat(F.lit("Product type: "), kind)
    use_part = F.concat(F.lit("Primary use: "), meaning["use"])
    role_part = F.concat(F.lit("Functional role: "), meaning["role"])
    trait_part = F.when(
        F.size(strong) > 0, F.concat(F.lit("Key characteristics: "), F.array_join(strong, ", "))
    )
    category_part = F.concat(F.lit("Category: "), meaning["category"])

    def closed(*parts: Column) -> Column:
        return F.concat(F.concat_ws(". ", *parts), F.lit("."))

    text = F.col("_text")
    lacking = (F.length(text) < 150) & ~contains_any(F.lower(text), ["beauty", "cosmetic"])
    context = F.lit("Application context: beauty and personal care product")
    return (
        items.withColumn("_kind", product_type(F.col("title"), rules.PRODUCT_TYPES_ROLE))
        .withColumn("_meaning", F.coalesce(F.element_at(roles, kind), F.element_at(roles, F.lit("default"))))
        .withColumn("_strong", strong_attributes(F.col("title"), F.col("_entries")))
        .withColumn("_text", closed(kind_part, use_part, role_part, trait_part, category_part))
        .withColumn("_text", F.when(
            lacking, closed(kind_part, use_part, role_part, trait_part, context, category_part)).otherwise(text))
        .withColumn("embedding_text", F.when(
            F.length(text) > rules.MAX_TEXT, closed(kind_part, use_part, category_part)).otherwise(text))
    )


STYLES = {
    "labelled": labelled_texts,
    "descriptive": descriptive_texts,
    "natural": natural_texts,
    "role": role_texts,
}


def styled_texts(items: DataFrame, style: str) -> DataFrame:
    """(item_id, embedding_text) of items with title, store, main_category and raw_metadata.

    Every intermediate value is a column of its own, so no expression is repeated inside
    another one.
    """
    prepared = items.withColumn("_brand", brand_or_store(F.col("raw_metadata"), F.col("store"))).withColumn(
        "_entries", lowered(details_of(F.col("raw_metadata")))
    )
    return STYLES[style](prepared).select("item_id", "embedding_text")
