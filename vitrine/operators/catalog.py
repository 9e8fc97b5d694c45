"""Catalog scans, enrichment, API records and the chat catalog filters.

Dimensions (brands, categories) are joined plainly: Spark broadcasts a side
whose measured size is under its threshold, and AQE splits a hot key of a
shuffled one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions import records as R

def category_dim(categories: DataFrame) -> DataFrame:
    """S3: (id, name) with the name lower-cased."""
    return categories.select("id", F.lower("name").alias("name"))


def category_by_name(categories: DataFrame) -> DataFrame:
    """lower(name) -> first (smallest) id."""
    return (category_dim(categories).groupBy("name").agg(F.min("id").alias("id"))
            .select(F.col("name").alias("category"), "id"))


def catalog_enriched(products: DataFrame, brands: DataFrame, categories: DataFrame) -> DataFrame:
    """Products left-joined with brands and categories (21 columns)."""
    b = brands.select(F.col("id").alias("brand_id_ref"), F.col("name").alias("brand_name"))
    c = categories.select(F.col("id").alias("category_id_ref"), F.col("code").alias("category_code"),
                          F.col("name").alias("category_name"))
    j = products.join(b, products.brand_id == b.brand_id_ref, "left")
    return j.join(c, j.category_id == c.category_id_ref, "left")


def product_dedup(products: DataFrame, order: Column | None = None) -> DataFrame:
    """One row per id -- the first by ``order`` (partial aggregation, so a
    hot duplicated id is collapsed map-side instead of sorted in one task)."""
    order = order if order is not None else F.struct(
        F.col("created_at").isNull(), F.col("created_at"), F.col("name"))
    cols = [c for c in products.columns if c != "id"]
    agg = products.groupBy("id").agg(F.min_by(F.struct(*cols), order).alias("r"))
    return agg.select("id", *[F.col(f"r.{c}").alias(c) for c in cols])


def product_record(enriched: DataFrame) -> DataFrame:
    """API record with defaults and casts."""
    return enriched.select(*R.product_record_columns())


def with_category_label(products: DataFrame, categories: DataFrame) -> DataFrame:
    """``category`` = lower name of the category id, default 'khác'."""
    dim = category_dim(categories).select(F.col("id").alias("_cid"), F.col("name").alias("_label"))
    return (products.join(dim, F.col("category_id") == F.col("_cid"), "left")
            .withColumn("category", F.coalesce("_label", F.lit(R.OTHER_CATEGORY))).drop("_cid", "_label"))


def category_label(products: DataFrame, categories: DataFrame) -> DataFrame:
    """(id, category_id, category) of every product."""
    return with_category_label(products.select("id", "category_id"), categories)


def missing_required_categories(categories: DataFrame, required=("áo", "quần", "giày")) -> DataFrame:
    """Required category names absent from the dimension (must be empty)."""
    return missing_categories(categories, categories.sparkSession.createDataFrame([(r,) for r in required], "name string"))


def missing_categories(categories: DataFrame, names: DataFrame) -> DataFrame:
    """Lower-case names (name) that no category has."""
    return names.join(category_dim(categories).select("name"), "name", "left_anti")


def resolve_gender(gender: str | None) -> str | None:
    """Request-level gender validation: upper-cased valid code, else no filter."""
    if not gender:
        return None
    g = gender.upper()
    return g if g in R.VALID_GENDERS or g == R.UNISEX else None


def catalog_filter(products: DataFrame, categories: DataFrame, category: str | None = None,
                   gender: str | None = None, max_price: float | None = None) -> DataFrame:
    """Active products under optional category, gender and price.

    Literal parameters become plain predicates, so they reach the parquet
    scan; an unknown category yields an empty frame (no error).
    """
    df = products.where(F.col("status"))
    if category:
        ids = category_by_name(categories).where(F.col("category") == category.lower()).select("id")
        df = df.join(ids, df.category_id == ids.id, "left_semi")
    g = resolve_gender(gender)
    if g is not None:
        df = df.where(F.col("gender") == g)
    if max_price:
        df = df.where(F.col("price") <= F.lit(float(max_price)))
    return df


def chat_products(filtered: DataFrame, categories: DataFrame) -> DataFrame:
    """Chat product record: id, name, description, gender, price, thumbnail URI, label."""
    return with_category_label(filtered, categories).select(
        F.col("id").cast("string").alias("id"), "name", "description", "gender", "price",
        R.thumbnail_uri(F.col("thumbnail")).alias("thumbnail"), "category")


def gender_or_unisex(df: DataFrame, gender: str) -> DataFrame:
    """keep rows whose gender equals the asked one or is UNISEX (NULL dropped)."""
    g = F.upper(F.col("gender"))
    return df.where(F.col("gender").isNotNull() & (F.col("gender") != "")
                    & ((g == F.lit((gender or "").upper())) | (g == R.UNISEX)))


def product_document(chat: DataFrame, *more: str) -> DataFrame:
    """Document text and metadata (and the columns ``more``)."""
    return chat.select(R.page_content(F.col("name"), F.col("description")).alias("page_content"),
                       "id", "name", "gender", "price", "thumbnail", "category", *more)
