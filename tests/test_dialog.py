from pyspark.sql import functions as F

from vitrine.functions import intent as I
from vitrine.operators import catalog as C
from vitrine.operators import dialog as D
from vitrine.functions.records import thumbnail_uri


def parsed(spark, raws):
    df = spark.createDataFrame([(1, i + 1, r) for i, r in enumerate(raws)], "question_id long, attempt int, raw string")
    return {r["attempt"]: r for r in D.parsed_attempts(df).collect()}


def test_reply_cleaning_and_validation(spark):
    p = parsed(spark, [
        '```json\n{"intent": "x", "parts": ["A: 1", "B: 2", "C: 3", "D: 4"]}\n```',
        "\ufeff" '{"gender": "unisex", "max_price": "2000000"}',
        'xin chào', '{bad}', '{"parts": null}', '{"gender": "xyz", "max_price": 0}', '{"gender": 5}',
    ])
    assert p[1]["valid"] and p[1]["parts"] == ["A: 1", "B: 2", "C: 3"]
    assert p[2]["valid"] and p[2]["gender"] == "unisex" and p[2]["max_price"] == 2000000.0 and p[2]["price_filter"]
    assert not p[3]["valid"] and not p[4]["valid"] and not p[5]["valid"]
    assert p[6]["valid"] and p[6]["gender"] == "" and not p[6]["price_filter"]
    assert not p[7]["valid"]


def test_first_valid_attempt_and_fallback(spark):
    df = spark.createDataFrame([(1, 1, "{bad}"), (1, 2, '{"intent": "a"}'), (1, 3, '{"intent": "b"}'),
                                (2, 1, "x"), (2, 2, "y"), (2, 3, "z"), (3, 1, "x"), (3, 2, "y"), (3, 3, "z")],
                               "question_id long, attempt int, raw string")
    qs = spark.createDataFrame([(1, "q"), (2, "áo việt nam"), (3, "váy")], "question_id long, question string")
    got = {r["question_id"]: r for r in D.parse_questions(qs, df).collect()}
    assert got[1]["intent"] == "a" and got[1]["source"] == "model"
    assert (got[2]["intent"], got[2]["category"], got[2]["gender"]) == ("gợi ý sản phẩm", "áo", "MALE")
    assert got[3]["intent"] is None and got[3]["source"] == "fallback"


def test_part_routing(spark):
    df = spark.createDataFrame([("Áo: sơ mi: trắng",), ("quần áo: x",), ("Mũ: x",), ("áo",)], "part string")
    r = I.route_part(F.col("part"))
    got = df.select(*[v.alias(k) for k, v in r.items()]).collect()
    assert (got[0]["category_key"], got[0]["part_desc"]) == ("áo", "sơ mi: trắng")
    assert got[1]["category_key"] == "áo"
    assert got[2]["category_key"] is None and got[2]["has_colon"]
    assert not got[3]["has_colon"]


def test_question_rules(spark):
    qs = spark.createDataFrame([(1, "áo nam dưới 2 triệu"), (2, "set đồ nữ"), (3, "chào bạn"),
                                (4, "váy nữ và giày"), (5, "quần jeans nữ dưới 1.5 triệu")],
                               "question_id long, question string")
    got = {r["question_id"]: r for r in D.question_intent(qs).collect()}
    assert (got[1]["intent"], got[1]["category"], got[1]["gender"], got[1]["max_price"]) == \
        ("gợi ý sản phẩm", "áo", "MALE", 2000000.0)
    assert got[2]["intent"] == "gợi ý set đồ" and len(got[2]["parts"]) == 3
    assert got[3]["intent"] == "trò chuyện"
    assert got[4]["intent"] == "gợi ý set đồ" and got[4]["gender"] == "FEMALE"
    assert got[5]["max_price"] == 1500000.0


def test_catalog_filters(spark):
    prods = spark.createDataFrame(
        [("1", "c1", "MALE", 10.0, True, "a"), ("2", "c1", "UNISEX", 10.0, True, "b"),
         ("3", "c1", None, 10.0, True, "c"), ("4", "c1", "FEMALE", 30.0, True, "d"),
         ("5", "c1", "MALE", 10.0, False, "e")],
        "id string, category_id string, gender string, price double, status boolean, name string")
    cats = spark.createDataFrame([("c1", "AO", "Áo")], "id string, code string, name string")
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(C.gender_or_unisex(C.catalog_filter(prods, cats, "áo", "MALE"), "MALE")) == ["1"]
    assert ids(C.gender_or_unisex(C.catalog_filter(prods, cats, "áo", ""), "")) == ["2"]
    assert ids(C.catalog_filter(prods, cats, "áo", "xyz")) == ["1", "2", "3", "4"]
    assert ids(C.catalog_filter(prods, cats, "áo", None, 0)) == ["1", "2", "3", "4"]
    assert ids(C.catalog_filter(prods, cats, "áo", None, 20.0)) == ["1", "2", "3"]
    assert ids(C.catalog_filter(prods, cats, "mũ")) == []


def test_thumbnail_cases(spark):
    df = spark.createDataFrame([(None, None), ("", None), ("http://x", None), (None, bytes(range(100)))],
                               "t string, b binary")
    got = [r[0] for r in df.select(thumbnail_uri(F.col("t"), F.col("b"))).collect()]
    assert got[0] == got[1] == "https://via.placeholder.com/120" and got[2] == "http://x"
    assert got[3].startswith("data:image/jpeg;base64,") and "\n" not in got[3] and "\r" not in got[3]
