"""Cleaning and validation of stored model replies (column expressions).

A reply attempt is valid when, after strip -> BOM removal -> code-fence
removal -> strip, it is a non-empty text starting with '{' and ending with
'}', parses as JSON, has a string (or falsy) gender and a list (or missing)
``parts``.  Parsed fields follow the reference's defaults: gender is kept as
given when it is MALE / FEMALE / UNISEX in any case, else ''; parts keeps
the first three entries; ``max_price`` filters only when truthy (a number
other than 0 or a non-empty string).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions.text import strip_unicode

FENCE = r"^```json\n|\n```$"
BOM = "\ufeff"


def clean_reply(raw: Column) -> Column:
    s = strip_unicode(raw)
    s = F.regexp_replace(s, "^" + BOM, "")
    s = F.regexp_replace(s, FENCE, "")
    return strip_unicode(s)


def shape_ok(clean: Column) -> Column:
    return (F.length(clean) > 0) & clean.startswith("{") & clean.endswith("}")


def _kind(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _is_number(kind: Column) -> Column:
    return kind.rlike(r"^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)")


def _falsy(v: Column, path: str, kind: Column) -> Column:
    return (kind.isNull() | (kind == "VOID")
            | (_is_number(kind) & (F.try_variant_get(v, path, "double") == 0))
            | ((kind == "BOOLEAN") & ~F.try_variant_get(v, path, "boolean"))
            | ((kind == "STRING") & (F.try_variant_get(v, path, "string") == ""))
            | (kind.startswith("ARRAY") & (F.size(F.try_variant_get(v, path, "array<variant>")) == 0))
            | (kind == "OBJECT<>"))


FIELDS = ["valid", "intent", "category", "gender", "max_price", "price_filter", "parts"]


def parse_replies(df: DataFrame, raw: str = "raw", keep: tuple = ()) -> DataFrame:
    """Add the parsed reply fields (see module doc) to ``df``.

    Built in three projections so the JSON text is parsed once per row and
    the per-field expressions stay small enough for whole-stage codegen.
    """
    keep = list(keep)
    s1 = df.select(*keep, clean_reply(F.col(raw)).alias("_clean"))
    s1 = s1.select(*keep, "_clean", F.try_parse_json("_clean").alias("_v"))
    v = F.col("_v")
    s2 = s1.select(*keep, "_clean", "_v",
                   _kind(v, "$.gender").alias("_gk"), _kind(v, "$.parts").alias("_pk"),
                   _kind(v, "$.max_price").alias("_mk"))
    gk, pk, mk = F.col("_gk"), F.col("_pk"), F.col("_mk")
    s3 = s2.select(*keep, "_clean", "_v", "_pk", "_mk",
                   _falsy(v, "$.gender", gk).alias("_gfalsy"), (gk == "STRING").alias("_gstr"),
                   F.try_variant_get(v, "$.gender", "string").alias("_g"),
                   F.try_variant_get(v, "$.max_price", "string").alias("_ptext"),
                   F.try_variant_get(v, "$.max_price", "double").alias("_pnum"))
    g, mk = F.col("_g"), F.col("_mk")
    valid = (shape_ok(F.col("_clean")) & v.isNotNull() & (F.col("_gfalsy") | F.col("_gstr"))
             & (F.col("_pk").isNull() | F.col("_pk").startswith("ARRAY")))
    gender = (F.when(F.col("_gfalsy"), F.lit(""))
              .when(F.upper(g).isin("MALE", "FEMALE", "UNISEX"), g).otherwise(F.lit("")))
    parts = F.when(F.col("_pk").isNull(), F.array().cast("array<string>")).otherwise(
        F.slice(F.try_variant_get(v, "$.parts", "array<string>"), 1, 3))
    ptext = F.col("_ptext")
    max_price = (F.when(mk == "STRING", ptext.try_cast("double"))
                 .when(_is_number(mk), F.col("_pnum")))
    price_filter = F.coalesce(
        F.when(mk == "STRING", F.length(ptext) > 0).when(_is_number(mk), F.col("_pnum") != 0),
        F.lit(False))
    return s3.select(*keep,
                     F.coalesce(valid, F.lit(False)).alias("valid"),
                     F.try_variant_get(v, "$.intent", "string").alias("intent"),
                     F.try_variant_get(v, "$.category", "string").alias("category"),
                     gender.alias("gender"), max_price.alias("max_price"),
                     price_filter.alias("price_filter"), parts.alias("parts"))
