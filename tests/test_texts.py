"""Text rules on edge rows, and cleaning against a small twin in plain Python."""

import re

import pytest
from pyspark.sql import functions as F

from shelflight.functions import attributes as attr
from shelflight.functions import rules
from shelflight.functions.categories import resolve_category
from shelflight.functions.jsontext import as_valid_json
from shelflight.functions.text_cleaning import clean_texts
from shelflight.functions.titles import clean_title
from shelflight.operators import texts
from shelflight.sources import testviews


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column).first()[0]


@pytest.mark.parametrize("title,mode,want", [
    ("Treatment for Hair 12 123", "substring", "hair 12"),
    ("Treatment for Hair 12 123", "exact", "treatment for hair 12"),
    ("Crème-Été  NEW, crème-été", "exact", "crème-été"),
    ("5 oz Best!!! Lotion", "exact", "5 lotion"),
    (None, "exact", ""),
])
def test_titles(spark, title, mode, want):
    df = spark.createDataFrame([(title,)], "t string")
    assert df.select(clean_title(F.col("t"), mode)).first()[0] == want


def test_title_cap(spark):
    assert len(one(spark, clean_title(F.col("t")), t=" ".join(f"w{i}x" for i in range(50))).split()) == 35


@pytest.mark.parametrize("title,ok", [
    ("soft face mask cotton", False), ("face towel lipstick red", False), ("rich face cream jar", True),
    ("red lipstick", False), ("long hair thing lipstick", False), ("long hair clip", True), ("hair extension set", True),
    ("beauty lipstick item", True), ("makeup bag pink", False), ("", False),
])
def test_eligibility(spark, title, ok):
    df = texts.with_eligibility(spark.createDataFrame([(title,)], "title string")).first()
    assert df.embedding_eligible is ok and (df.reasons is None) is ok


@pytest.mark.parametrize("current,meta,want", [
    ("Hair", None, "Hair"), ("All Beauty", None, "Beauty"), ("All Beauty", "{broken", "Beauty"),
    (None, '{"categories":[["Nails","x"]]}', "Nails"), ("All Beauty", '{"categories":["Skin"]}', "Skin"),
    ("All Beauty", '{"categories":[],"details":{"category":"Oils"}}', "Oils"),
    ("All Beauty", '{"title":"Eye and hair"}', "Hair Care"), ("All Beauty", '{"title":"thing"}', "Beauty"),
])
def test_category(spark, current, meta, want):
    df = spark.createDataFrame([(current, meta)], "c string, m string")
    assert df.select(resolve_category(F.col("c"), F.col("m"))).first()[0] == want


def test_details_features_description(spark):
    df = spark.createDataFrame(
        [({"Material": "x" * 101, "Color": "y" * 100, "Scent": "N/A", "Coverage": " full "},
          ["four", "fives", "f" * 100, "f" * 101, "a1234", "b1234", "c1234"],
          ["Tiny.", "A gift for you and me. x", "z" * 151 + ". more"])],
        "d map<string,string>, f array<string>, t array<string>")
    r = df.select(attr.semantic_details(F.col("d")).alias("d"), attr.usage_features(F.col("f")).alias("f"),
                  attr.description_fallback(F.col("t")).alias("t")).first()
    assert r.d == {"Color": "y" * 100, "Coverage": "full"}
    assert r.f == ["fives", "f" * 100, "a1234", "b1234", "c1234"]
    assert r.t == "z" * 147 + "..."


def test_json_repair(spark):
    df = spark.createDataFrame([('{"a": 1}',), ('say "hi"\n',), (None,)], "j string")
    assert [r[0] for r in df.select(as_valid_json(F.col("j"))).collect()] == ['{"a": 1}', '"say \\"hi\\"\\n"', None]


def test_text_that_only_begins_with_json_is_quoted(spark):
    texts = ["12 apples", "1,2", "[1] [2]", '{"a":1} x', "null x", "1] [2", "", " 12 ", '[1,{"a":null}]', "null", '"x"']
    df = spark.createDataFrame([(t,) for t in texts], "j string")
    got = [r[0] for r in df.select(as_valid_json(F.col("j"))).collect()]
    assert got == ['"12 apples"', '"1,2"', '"[1] [2]"', '"{\\"a\\":1} x"', '"null x"', '"1] [2"', '""', *texts[7:]]


# --- a twin of the text cleaning, written over lists of sentences ---

def squeezed(s):
    return " ".join(s.split())


def twin(text):
    labels = ["Tên sản phẩm", "Danh mục", "Thương hiệu", "Thuộc tính chính"]
    t = squeezed(text)
    for mark in ".,:;":
        t = re.sub(re.escape(mark) + "{2,}", mark, t)
    t = squeezed(re.sub(r"([.:])(?=[A-Za-zÀ-ỹ])", r"\1 ", re.sub(r"\s+(?=[.,:;])", "", t)))
    for phrase in rules.PROMO_PHRASES:
        t = re.sub(rf"[.,:;]?\s*{re.escape(phrase)}\s*[.,:;]?", "", t, flags=re.I)
    section = "Thuộc tính chính:"
    if section in t:
        head, body = t.split(section)[:2]
        shown, seen = [], set()
        for part in filter(None, (p.strip() for p in body.split("."))):
            key, colon, value = (x.strip() for x in part.partition(":"))
            low = key.lower()
            if not colon:
                if len(part) > 3:
                    shown.append(part)
            elif (low not in seen and value.lower() not in rules.NULL_LIKE
                  and not any(w in low for w in rules.UNIMPORTANT_KEY_PARTS)):
                seen.add(low)
                shown.append(f"{key}: {value}")
        shown, joined = shown[:5], ". ".join(shown[:5])
        if len(joined) > 150:
            used, fit = 0, []
            for s in shown:
                used += len(s) + 2
                if used > 147:
                    break
                fit.append(s)
            joined = ". ".join(fit) + "..." if fit else shown[0][:147] + "..."
        t = head.rstrip() + (f"{section} {joined}" if shown else "")
    unique = {}
    for s in t.split(". "):
        unique.setdefault((s.split(":")[0] if ":" in s else s).strip().lower(), s)
    t = squeezed(". ".join(unique.values()))
    t = t[:1].upper() + t[1:]
    t = re.sub(rf"\.\s+([{rules.LOWER_LETTERS}])", lambda m: ". " + m.group(1).upper(), t)
    for label in labels:
        t = re.sub(f"{label}:", f"{label}:", t, flags=re.I)
    if len(t) > 500:
        parts = t.split(". ")
        named = [p for p in parts if any(f"{x.lower()}:" in p.lower() for x in labels)]
        out, used = [], 0
        for p in named + [p for p in parts if p not in named]:
            if used + len(p) + 2 <= 497:
                out.append(p)
                used += len(p) + 2
            elif not out:
                out.append(p[:497] + "...")
            else:
                break
        t = ". ".join(out)
        t = t[:497] + "..." if len(t) > 500 else t
    return squeezed(t) or text


def test_text_cleaning_against_twin(spark, sf):
    hand = [
        "a..b,, c :: d", "best seller", "tên sản phẩm: x.danh mục: y. Giá rẻ! hot deal, z",
        "Tên sản phẩm: Kem. Thuộc tính chính: Color: red. color: blue. Weight: 2. Size: N/A. abc. longer note",
        "Tên sản phẩm: Kem. Thuộc tính chính: " + ". ".join(f"K{i}: {'v' * 40}" for i in range(8)),
        "x" * 600, "one. One. two: 1. two: 2. three", "Danh mục: " + "y" * 520 + ". short",
    ]
    docs = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(hand + docs)], "id int, embedding_text string")
    got = {r.id: r.embedding_text for r in clean_texts(df).collect()}
    for i, t in enumerate(hand + docs):
        assert got[i] == twin(t), t[:200]


def test_styles_stay_within_the_cap(spark, sf):
    from shelflight.operators.interactions import items_for_rs

    items = items_for_rs(testviews.metadata_clean(spark, sf))
    for style in ("labelled", "descriptive", "natural", "role"):
        longest, rows = texts.styled_texts(items, style).agg(F.max(F.length("embedding_text")), F.count("*")).first()
        assert longest <= 500 and rows == items.count()


def test_text_rules_run_on_all_tasks_and_once(spark, sf):
    from shelflight.registry import reporting
    from shelflight.operators import nearest, texts

    view = reporting._text_view(spark, sf)  # one small file, which AQE would leave to one task
    assert view.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    compact = texts.compact_texts(texts.semantic_attributes(view)).withColumnRenamed("parent_asin", "item_id")
    encoded = nearest.encode_texts(compact)
    assert "usage_features" not in encoded._jdf.queryExecution().optimizedPlan().toString()
    assert encoded.count() == compact.filter("trim(embedding_text) <> ''").count()
