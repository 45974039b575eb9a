"""The driver's tables seen through the schemas of the recommender.

Order lines play the reviews, parts play the catalogue, events play the interaction log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelflight.operators import interactions as inter
from shelflight.operators import reviews as rev
from shelflight.session import scratch_path
from shelflight.sources.tables import read_table, spread

# Product phrases appended to part names, by part size (1..50), so that every
# rule of the text operators meets titles it applies to.
PHRASES = [
    "Hair Clip for Women", "Face Mask 100 ml", "Lip Gloss Set, 12 Pack", "Eyeliner Pencil (Waterproof)",
    "Body Lotion 500 ml", "Nail Polish - Gel Nail Kit", "Makeup Brush Set", "Lace Front Wig 13x1",
    "Face Cream Anti-Aging", "Shampoo & Conditioner", "Knitted Hat Unisex", "Beauty Product",
    "Hair Spray Strong Hold", "Perfume for Men 3.4 oz", "Hair Treatment Oil", "Neck Gaiter Bandana",
    "Face Towel", "Face Paint Shadow Paint", "Makeup Bag", "Makeup Kit with Mirror",
    "Hair Dryer 1200 Watt", "Hair Extension Deep Wave", "Eyebrow Tweezers", "Serum Cleanser Toner Mask",
    "Deodorant Unscented", "Cosmetic Item", "Scrunchie Scrunchie Headband", "Cologne Gift Premium",
    "Gel", "Moisturizer Moisturiser", "Concealer Matte", "Blush & Bronzer", "Lipstick Glossy",
    "Mascara Long Lasting", "Synthetic Wig Curly", "Brazilian Curly Human Hair", "Soap 2 pieces",
    "Eye Shadow Palette", "False Eyelash Glue", "Tattoo Temporary Tattoo", "Sunscreen Lotion",
    "Beard Straightener", "Acrylic Nail Tips", "Hair Comb", "Powder Puff", "Antiperspirant pack of 12",
    "Rabbit Fur Hat", "Fashion Accessory Scarf", "Crème Été", "Plain Thing",
]
MATERIALS = ["Cotton", "human hair", "Steel", "Synthetic", "various"]
FORMS = ["Gel", "liquid", "Powder", "Pencil"]


def _text(x: Column) -> Column:
    return x.cast("string")


def reviews_raw(spark: SparkSession, sf: str) -> DataFrame:
    orders = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = read_table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus"
    )
    part = F.col("l_partkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        _text(F.col("o_custkey")).alias("user_id"),
        _text(part).alias("asin"),
        F.when(part % 10 != 0, _text(part)).alias("parent_asin"),
        (F.lit(1) + F.col("l_quantity").cast("int") % 5).cast("double").alias("rating"),
        F.col("l_returnflag").alias("title"),
        F.col("l_linestatus").alias("text"),
        (F.col("l_linenumber") - 2).cast("bigint").alias("helpful_vote"),
        (F.col("l_returnflag") != "R").alias("verified_purchase"),
        F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("timestamp"),
    )


def reviews_normalized(spark: SparkSession, sf: str) -> DataFrame:
    return rev.normalize_reviews(reviews_raw(spark, sf))


def reviews_clean(spark: SparkSession, sf: str) -> DataFrame:
    return rev.clean_reviews(reviews_normalized(spark, sf))


def interactions(spark: SparkSession, sf: str) -> DataFrame:
    return inter.build_interactions(reviews_clean(spark, sf))


def metadata_raw(spark: SparkSession, sf: str) -> DataFrame:
    part = spread(read_table(spark, sf, "part"), "p_partkey")  # the text rules on top of it are the work
    rated = (
        read_table(spark, sf, "lineitem")
        .groupBy("l_partkey")
        .agg(F.avg(F.lit(1) + F.col("l_quantity").cast("int") % 5).alias("average_rating"),
             F.count("*").alias("rating_number"))
    )
    key = F.col("p_partkey")
    color = F.substring_index("p_name", " ", 1)
    image_type = "array<struct<large:string,hi_res:string>>"

    def image(large: Column, hi_res: Column) -> Column:
        return F.array(F.struct(large.alias("large"), hi_res.alias("hi_res"))).cast(image_type)

    none = F.lit(None).cast("string")
    url = F.concat(F.lit("img/"), _text(key))
    images = (
        F.when(key % 6 == 0, F.lit(None).cast(image_type))
        .when(key % 6 == 1, F.array().cast(image_type))
        .when(key % 6 == 2, F.array(F.lit(None)).cast(image_type))
        .when(key % 6 == 3, image(F.lit(""), F.concat(url, F.lit("/hi"))))
        .when(key % 6 == 4, image(url, none))
        .otherwise(image(none, none))
    )

    def pick(values: list[str], by: Column) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), (by % len(values)).cast("int") + 1)

    details = (
        F.when(key % 4 == 0, F.lit(None).cast("map<string,string>"))
        .when(key % 4 == 1, F.create_map(
            F.lit("Color"), color, F.lit("Material"), pick(MATERIALS, key), F.lit("Item Form"), pick(FORMS, key),
            F.lit("Size"), _text(F.col("p_size"))))
        .when(key % 4 == 2, F.create_map(
            F.lit("Brand"), F.col("p_brand"), F.lit("Color"), color, F.lit("Style"), F.col("p_type"),
            F.lit("Scent"), F.lit("N/A")))
        .otherwise(F.create_map(F.lit("category"), F.concat(F.lit("Tools "), F.col("p_brand")),
                                F.lit("Item Weight"), F.lit("2 pounds")))
    )
    return (
        part.join(rated, key == F.col("l_partkey"), "left")
        .select(
            _text(key).alias("parent_asin"),
            F.concat("p_name", F.lit(" "), F.element_at(F.array(*[F.lit(p) for p in PHRASES]), F.col("p_size")))
            .alias("title"),
            F.when(key % 13 != 0, F.col("p_brand")).alias("store"),
            F.when(F.col("p_type") == "STANDARD", "All Beauty").otherwise(F.col("p_type")).alias("main_category"),
            "average_rating",
            F.col("rating_number").cast("bigint").alias("rating_number"),
            images.alias("images"),
            details.alias("details"),
            _text(F.col("p_retailprice").cast("decimal(12,2)")).alias("price"),
            F.when(key % 3 == 0, F.array(F.lit("All Beauty")))
            .when(key % 3 == 1, F.array(F.concat(F.lit("Shelf "), F.col("p_brand")), F.lit("Other")))
            .alias("categories"),
            F.when(key % 5 != 0, F.array(
                F.lit("abc"), F.concat(F.lit("Made for "), F.col("p_name")), F.lit("  Easy to clean.  "),
                F.col("p_brand"))).alias("features"),
            F.when(key % 7 != 0, F.array(
                F.lit("Short."), F.lit("A perfect gift for everyone"),
                F.concat(F.lit("This "), F.col("p_name"), F.lit(" lasts long. Second sentence!")))).alias("description"),
        )
    )


def metadata_normalized(spark: SparkSession, sf: str) -> DataFrame:
    from shelflight.operators import metadata as meta

    return meta.normalize_metadata(metadata_raw(spark, sf))


def metadata_clean(spark: SparkSession, sf: str) -> DataFrame:
    from shelflight.operators import metadata as meta

    return meta.clean_metadata(metadata_normalized(spark, sf))


def products(spark: SparkSession, sf: str) -> DataFrame:
    """The products table; the category keeps the data set's name where there is nothing better."""
    return metadata_raw(spark, sf).select(
        "parent_asin", "title", "store", "main_category",
        F.col("average_rating").alias("avg_rating"), F.col("rating_number").cast("int").alias("rating_number"),
        F.concat(F.lit("p/"), "parent_asin").alias("primary_image"),
        F.to_json(F.struct("title", F.col("store").alias("Brand"))).alias("raw_metadata"),
    )


def items(spark: SparkSession, sf: str) -> DataFrame:
    """Sellable variants: two per catalogue part, every tenth with an image of its own."""
    part = read_table(spark, sf, "part")
    key = F.col("p_partkey")
    variant = F.explode(F.array(F.lit(""), F.lit("b"))).alias("variant")
    return part.select(key, "p_brand", "p_type", variant).select(
        F.concat(_text(key), "variant").alias("asin"),
        _text(key).alias("parent_asin"),
        "variant",
        F.when(key % 10 == 0, F.concat(F.lit("i/"), _text(key), F.col("variant")))
        .when(key % 10 == 1, F.lit("")).alias("primary_image"),
        F.when(key % 3 == 0, F.col("p_brand")).when(key % 3 == 1, F.concat(F.lit("x "), F.col("p_type")))
        .alias("category"),
    )


def interaction_logs(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "events").select(
        "event_id", "user_id", F.get_json_object("props", "$.k").alias("asin"), "event_type", "ts",
        F.col("props").alias("metadata"),
    )


def cart_events(spark: SparkSession, sf: str) -> DataFrame:
    """Cart operations: click adds, view sets, signup removes, error clears."""
    op = (
        F.when(F.col("event_type") == "click", "add")
        .when(F.col("event_type") == "view", "set")
        .when(F.col("event_type") == "signup", "remove")
        .when(F.col("event_type") == "error", "clear")
    )
    return (
        read_table(spark, sf, "events")
        .select(
            "event_id", "user_id", F.get_json_object("props", "$.k").alias("asin"), op.alias("op"), "ts",
            (F.lit(1) + F.col("value").cast("int") % 5).cast("bigint").alias("quantity"),
        )
        .filter(F.col("op").isNotNull())
    )


def item_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "embeddings").select(
        _text(F.col("vec_id")).alias("item_id"), "embedding", _text(F.col("label")).alias("category")
    )


def carts(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as carts: the open ones are active."""
    return read_table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"),
        F.when(F.col("o_orderstatus") == "O", "active").otherwise("checked_out").alias("status"),
        F.col("o_orderdate").alias("created_at"),
    )


def cart_items(spark: SparkSession, sf: str) -> DataFrame:
    return (
        read_table(spark, sf, "lineitem")
        .groupBy(F.col("l_orderkey").alias("cart_id"), _text(F.col("l_partkey")).alias("asin"))
        .agg(F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"))
    )


def _borrowed_factors(ids: DataFrame, spark: SparkSession, sf: str, spread: int) -> DataFrame:
    """Stand-in factors: each id takes the first 15 values of an embedding, and one more as its bias."""
    vectors = read_table(spark, sf, "embeddings").select("vec_id", "embedding")
    numbered = ids.withColumn("_count", vectors.agg(F.count("*")).scalar())
    borrowed = numbered.withColumn("vec_id", F.pmod(F.col("id").cast("bigint") * spread, F.col("_count")))
    return borrowed.join(vectors, "vec_id").select(
        "id", F.slice("embedding", 1, 15).alias("factors"), F.get("embedding", F.lit(15)).cast("double").alias("bias")
    )


def user_factors(spark: SparkSession, sf: str) -> DataFrame:
    users = read_table(spark, sf, "customer").select(_text(F.col("c_custkey")).alias("id"))
    return _borrowed_factors(users, spark, sf, 7)


def item_factors(spark: SparkSession, sf: str) -> DataFrame:
    parts = read_table(spark, sf, "part").select(_text(F.col("p_partkey")).alias("id"))
    return _borrowed_factors(parts, spark, sf, 3)


def as_stream(df: DataFrame, label: str, slices: int = 6, disorder_seconds: int = 0) -> str:
    """Write a closed table in one pass as time slices, a file each, that a file source reads in order.

    With ``disorder_seconds`` every row is placed by its time plus a hash of the row within that
    many seconds before or after, so neighbouring slices overlap by up to twice as much.  A file
    source takes files by their age; the ages are set from the slice numbers.
    """
    path = scratch_path(df.sparkSession, label)
    place = F.unix_micros(F.col("ts").cast("timestamp"))
    if disorder_seconds:
        spread = 2 * disorder_seconds * 1_000_000
        place = place + F.pmod(F.xxhash64(*df.columns), F.lit(spread)) - F.lit(spread // 2)
    placed = df.withColumn("_place", place).repartitionByRange(slices, "_place").drop("_place")
    placed.write.parquet(path)
    hadoop = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(path)
    store = folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration())
    names = sorted(f.getPath().toString() for f in store.listStatus(folder) if f.getPath().getName().startswith("part-"))
    for number, name in enumerate(names):  # names only, as many as slices
        store.setTimes(hadoop.Path(name), 1_000_000_000_000 + 1000 * number, -1)
    return path
