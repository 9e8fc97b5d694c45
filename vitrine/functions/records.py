"""Column expressions for API records (all JVM-side, codegen-friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Record defaults and labels of the API surface.
DEFAULT_TS = "2025-01-01T00:00:00.000Z"
DEFAULT_USER = "system"
DEFAULT_GENDER = "UNISEX"
PLACEHOLDER_THUMB = "https://via.placeholder.com/120"
OTHER_CATEGORY = "khác"
VALID_GENDERS = ("MALE", "FEMALE")
UNISEX = "UNISEX"


def iso_utc(ts: Column) -> Column:
    """``isoformat() + 'Z'``: fraction printed (6 digits) only when non-zero."""
    frac = F.date_format(ts, "SSSSSS")
    return F.concat(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(frac != "000000", F.concat(F.lit("."), frac)).otherwise(F.lit("")),
        F.lit("Z"))


def thumbnail_uri(text_thumb: Column, blob_thumb: Column | None = None) -> Column:
    """Bytes -> base64 data URI (no line breaks), non-empty string -> as is,
    anything empty or NULL -> placeholder."""
    out = F.when(F.coalesce(F.length(text_thumb), F.lit(0)) > 0, text_thumb)
    if blob_thumb is not None:
        b64 = F.regexp_replace(F.base64(blob_thumb), r"[\r\n]", "")
        out = F.when(F.coalesce(F.length(blob_thumb), F.lit(0)) > 0,
                     F.concat(F.lit("data:image/jpeg;base64,"), b64)).otherwise(out)
    return F.coalesce(out, F.lit(PLACEHOLDER_THUMB))


def page_content(name: Column, description: Column) -> Column:
    """``f"{name}: {description}"`` with Python's ``None`` for missing values."""
    return F.concat(F.coalesce(name, F.lit("None")), F.lit(": "),
                    F.coalesce(description, F.lit("None")))


def product_record_columns(prefix: str = "") -> list[Column]:
    """The 19-field API record (flat: nested brand/category as *_ref columns)."""
    c = lambda n: F.col(f"{prefix}{n}")
    s = lambda n, d="": F.coalesce(c(n).cast("string"), F.lit(d))
    return [
        c("id").cast("string").alias("id"),
        F.coalesce(iso_utc(c("created_at")), F.lit(DEFAULT_TS)).alias("created_at"),
        s("created_by", DEFAULT_USER).alias("created_by"),
        F.coalesce(iso_utc(c("updated_at")), F.lit(DEFAULT_TS)).alias("updated_at"),
        s("updated_by", DEFAULT_USER).alias("updated_by"),
        s("name").alias("name"),
        s("description").alias("description"),
        F.coalesce(c("price").cast("double"), F.lit(0.0)).alias("price"),
        s("gender", DEFAULT_GENDER).alias("gender"),
        F.coalesce(c("sold").cast("long"), F.lit(0).cast("long")).alias("sold"),
        F.coalesce(c("rating").cast("double"), F.lit(0.0)).alias("rating"),
        F.coalesce(c("status").cast("boolean"), F.lit(True)).alias("status"),
        s("thumbnail").alias("thumbnail"),
        c("slider").cast("string").alias("slider"),
        s("category_id").alias("category_id"),
        s("brand_id").alias("brand_id"),
        s("brand_id_ref").alias("brand_ref_id"),
        s("brand_name").alias("brand_name"),
        s("category_id_ref").alias("category_ref_id"),
        s("category_code").alias("category_code"),
        s("category_name").alias("category_name"),
    ]


def product_struct(prefix: str = "") -> Column:
    """Nested API record: brand and category as structs, similarity NULL."""
    flat = product_record_columns(prefix)
    names = ["id", "created_at", "created_by", "updated_at", "updated_by", "name", "description",
             "price", "gender", "sold", "rating", "status", "thumbnail", "slider", "category_id",
             "brand_id"]
    fields = [col for col, n in zip(flat, names)]
    brand = F.struct(flat[16].alias("id"), flat[17].alias("name")).alias("brand")
    cat = F.struct(flat[18].alias("id"), flat[19].alias("code"), flat[20].alias("name")).alias("category")
    return F.struct(*fields, brand, cat)
