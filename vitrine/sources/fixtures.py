"""Reference-shaped views over the supplied tables.

The reference reads ``user_interactions``, ``products``, ``brands`` and
``categories`` from a shop database and asks a hosted model about shopping
questions.  These functions derive the same shapes from the supplied
TPC-H-like tables (see FIXTURES.md for the rules); the DuckDB oracle in
``vitrine.plans.oracle`` writes the same rules in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.sources.tables import read_table

# Interaction codes for the event stream and the order lines.
EVENT_CODES = {"view": 1, "click": 2, "signup": 3, "purchase": 4, "error": -3}
RETURNFLAG_CODES = {"A": 2, "N": 1, "R": -1}

# Category dimension (id, code, display name, source p_type).
CATEGORY_ROWS = (
    ("c1", "AO", "Áo", "ECONOMY"),
    ("c2", "QUAN", "Quần", "STANDARD"),
    ("c3", "GIAY", "Giày", "SMALL"),
    ("c4", "VAY", "Váy", "LARGE"),
    ("c5", "PK", "Phụ kiện", "MEDIUM"),
)
UNMAPPED_CATEGORY_ID = "c6"
MISSING_BRAND = "Brand#25"

# Phrases put before a user turn's text, chosen by (conv_id + turn) % 8;
# slot 7 has none.
QUESTION_TEMPLATES = (
    "áo nam dưới 2 triệu",
    "set đồ nữ đi làm",
    "quần jeans nữ dưới 1.5 triệu",
    "giày",
    "chào bạn, hôm nay thế nào",
    "váy nữ và giày",
    "outfit nam",
)


def _case(col: Column, mapping: dict, default=None) -> Column:
    expr = None
    for k, v in mapping.items():
        expr = F.when(col == F.lit(k), F.lit(v)) if expr is None else expr.when(col == F.lit(k), F.lit(v))
    return expr.otherwise(F.lit(default)) if default is not None else expr


# ---------------------------------------------------------------- interactions
def events_interactions(ev: DataFrame) -> DataFrame:
    """Events as (user_id, product_id, interaction_type)."""
    return ev.select(
        F.col("user_id").cast("long").alias("user_id"),
        F.get_json_object("props", "$.k").alias("product_id"),
        _case(F.col("event_type"), EVENT_CODES).cast("int").alias("interaction_type"),
    )


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole event stream as (user_id, product_id, interaction_type)."""
    return events_interactions(read_table(spark, sf_dir, "events", "user_id", "event_type", "props"))


def interactions_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole event stream as a sparse matrix: a user's day is a user, a
    product at an hour of the day a product."""
    ev = read_table(spark, sf_dir, "events", "ts", "user_id", "event_type", "props")
    return events_interactions(ev.withColumn(
        "user_id", F.col("user_id") * 100000 + F.datediff(F.to_date("ts"), F.lit("1970-01-01"))).withColumn(
        "props", F.to_json(F.struct(F.concat(F.get_json_object("props", "$.k"), F.lit("@"), F.hour("ts").cast("string")).alias("k")))))


def interactions_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as interactions: customer x part, code by return flag."""
    li = read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_returnflag")
    od = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    j = li.join(od, li.l_orderkey == od.o_orderkey)
    return j.select(
        F.col("o_custkey").cast("long").alias("user_id"),
        F.col("l_partkey").cast("string").alias("product_id"),
        _case(F.col("l_returnflag"), RETURNFLAG_CODES).cast("int").alias("interaction_type"),
    )


def call_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events", "event_id", "user_id", "ts")
    return ev.select(F.col("event_id").alias("call_id"), "user_id", "ts")


# ---------------------------------------------------------------- catalog
def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category dimension: one row per mapped part type present in ``part``."""
    types = read_table(spark, sf_dir, "part", "p_type").distinct()
    type_col = F.col("p_type")
    return types.where(type_col.isin([r[3] for r in CATEGORY_ROWS])).select(
        _case(type_col, {r[3]: r[0] for r in CATEGORY_ROWS}).alias("id"),
        _case(type_col, {r[3]: r[1] for r in CATEGORY_ROWS}).alias("code"),
        _case(type_col, {r[3]: r[2] for r in CATEGORY_ROWS}).alias("name"),
    )


def brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_table(spark, sf_dir, "part", "p_brand")
    return (part.where(F.col("p_brand") != MISSING_BRAND)
            .select(F.substring("p_brand", 7, 100).alias("id"), F.col("p_brand").alias("name"))
            .distinct())


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product table with the reference's 16 columns."""
    part = read_table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_type",
                      "p_size", "p_retailprice")
    li = (read_table(spark, sf_dir, "lineitem", "l_partkey", "l_shipdate", "l_quantity")
          .groupBy("l_partkey")
          .agg(F.min("l_shipdate").alias("first_ship"), F.sum("l_quantity").alias("qty")))
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    key = F.col("p_partkey")
    j = (part.join(li, part.p_partkey == li.l_partkey, "left")
         .join(docs, part.p_partkey == docs.doc_id, "left"))
    ts = F.when(key % 13 != 0, F.col("first_ship"))
    return j.select(
        key.cast("string").alias("id"),
        ts.alias("created_at"),
        F.lit(None).cast("string").alias("created_by"),
        ts.alias("updated_at"),
        F.lit(None).cast("string").alias("updated_by"),
        F.when(key % 17 != 0, F.col("p_name")).alias("name"),
        F.col("text").alias("description"),
        F.col("p_retailprice").cast("double").alias("price"),
        _case(F.col("p_size") % 4, {0: "MALE", 1: "FEMALE", 2: "UNISEX"}).alias("gender"),
        F.col("qty").cast("long").alias("sold"),
        F.when(key % 19 != 0, F.round(F.col("p_size") / F.lit(10.0), 1)).alias("rating"),
        (key % 10 != 0).alias("status"),
        _case(key % 3, {1: "", 2: "http://img/x.jpg"}).alias("thumbnail"),
        F.lit(None).cast("string").alias("slider"),
        _case(F.col("p_type"), {r[3]: r[0] for r in CATEGORY_ROWS},
              UNMAPPED_CATEGORY_ID).alias("category_id"),
        F.substring("p_brand", 7, 100).alias("brand_id"),
    )


def product_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, description): ids and descriptions of ``products``, the id as the
    part's number.  The merge join leaves a part's rows in one partition, so
    that counts by key and word need no shuffle of their own."""
    part = read_table(spark, sf_dir, "part", "p_partkey")
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text").where(F.col("text").isNotNull())
    return part.hint("merge").join(docs, part.p_partkey == docs.doc_id).select(
        F.col("p_partkey").alias("key"), F.col("text").alias("description"))


def product_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key) of every row of ``products``, the id as the part's number."""
    part = read_table(spark, sf_dir, "part", "p_partkey")
    docs = read_table(spark, sf_dir, "documents", "doc_id")
    return part.join(docs, part.p_partkey == docs.doc_id, "left").select(F.col("p_partkey").alias("key"))


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products by supplier: the rows of one part share its id."""
    li = read_table(spark, sf_dir, "lineitem", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    return li.groupBy("l_partkey", "l_suppkey").agg(
        F.min("l_shipdate").alias("created_at"), F.max("l_extendedprice").cast("double").alias("price")).select(
        F.col("l_partkey").cast("string").alias("id"), "created_at",
        F.concat(F.lit("supplier "), F.col("l_suppkey").cast("string")).alias("name"), "price")


# ---------------------------------------------------------------- questions
def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as shopping questions (question_id = conv_id * 1000 + turn): a
    phrase by slot, then the turn's whole text."""
    conv = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    slot = (F.col("conv_id") + F.col("turn")) % 8
    q = F.col("text")
    for i in reversed(range(len(QUESTION_TEMPLATES))):
        q = F.when(slot == i, F.concat(F.lit(QUESTION_TEMPLATES[i] + ". "), F.col("text"))).otherwise(q)
    return conv.where(F.col("role") == "user").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"),
        q.alias("question"),
    )


# Stored model replies, chosen by (question_id + attempt) % 10.
# {p} is replaced by a price derived from the question id.
REPLY_TEMPLATES = (
    '{"intent": "gợi ý sản phẩm", "category": "áo", "gender": "MALE", "max_price": {p}, "parts": []}',
    '```json\n{"intent": "gợi ý set đồ", "category": null, "gender": "FEMALE", "max_price": null, '
    '"parts": ["Áo: sơ mi trắng", "Quần: jeans xanh", "Giày: sandal", "Mũ: rộng vành"]}\n```',
    '\ufeff' '{"intent": "gợi ý sản phẩm", "category": "giày", "gender": "", "max_price": "{p}", "parts": []}',
    'xin chào',
    '{bad}',
    '{"intent": "gợi ý set đồ", "parts": null}',
    '  {"intent": "trò chuyện", "category": null, "gender": "xyz", "max_price": 0, "parts": []}  ',
    '{"intent": "gợi ý sản phẩm", "category": "quần", "gender": "unisex", "max_price": {p}, "parts": []}',
    '{"intent": "gợi ý set đồ", "category": null, "gender": "MALE", "max_price": null, '
    '"parts": ["quần áo: thể thao", "Blazer: đen", "dép: da"]}',
    '{"intent": "gợi ý sản phẩm", "category": "váy", "gender": "FEMALE", "max_price": {p}, "parts": []}',
)
REPLY_ATTEMPTS = 3


def model_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three stored model replies per question (question_id, attempt, raw).

    The templates form a 10-row dimension joined by slot (broadcast: fixed size).
    """
    qs = questions(spark, sf_dir).select("question_id")
    att = qs.select("question_id", F.explode(F.sequence(F.lit(1), F.lit(REPLY_ATTEMPTS))).alias("attempt"))
    tpl = spark.createDataFrame(
        [(i, t.split("{p}")[0], t.split("{p}")[1] if "{p}" in t else None)
         for i, t in enumerate(REPLY_TEMPLATES)], "slot int, head string, tail string")
    slot = ((F.col("question_id") + F.col("attempt")) % len(REPLY_TEMPLATES)).cast("int")
    price = ((F.col("question_id") % 40 + 5) * 100000).cast("string")
    j = att.withColumn("slot", slot).join(F.broadcast(tpl), "slot")
    raw = F.when(F.col("tail").isNull(), F.col("head")).otherwise(F.concat("head", price, "tail"))
    return j.select("question_id", F.col("attempt").cast("int").alias("attempt"), raw.alias("raw"))


# ---------------------------------------------------------------- vectors
def embedding_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = read_table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return emb.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
