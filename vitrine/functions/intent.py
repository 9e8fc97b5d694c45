"""Shopping-question rules as column expressions.

``question_intent`` re-aims the hosted model's parsing prompt as explicit
rules (precedence is our choice): set words -> outfit with three parts;
exactly one category word -> single-category suggestion; no product,
price or gender word -> chat; anything else -> outfit.  Words match whole
tokens of the lower-cased, punctuation-free question; prices are read from
the lower-cased raw text ("1.5 triệu" -> 1500000).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitrine.functions.text import PUNCT, strip_unicode

# Intents, words and messages of the chat surface.
INTENT_OUTFIT = "gợi ý set đồ"
INTENT_SINGLE = "gợi ý sản phẩm"
INTENT_CHAT = "trò chuyện"
SET_WORDS = ("đồ", "bộ đồ", "set", "set đồ", "outfit")
CATEGORY_WORDS = ("áo", "quần", "giày", "váy", "phụ kiện")
PRICE_WORDS = ("giá", "triệu", "nghìn", "đồng")
GENDER_WORDS = {"nam": "MALE", "nữ": "FEMALE"}
OUTFIT_PARTS = ("Áo", "Quần", "Giày")
# part routing: (category key, substrings) checked in this order
PART_ROUTES = (("áo", ("áo", "blazer", "sơ mi")),
               ("quần", ("quần", "pants", "jeans")),
               ("giày", ("giày", "sandal", "dép")))
FALLBACK_WORDS = ("áo", "nam")


def padded_words(q: Column) -> Column:
    """' w1 w2 ... ' over the lower-cased, punctuation-free question."""
    norm = F.regexp_replace(F.regexp_replace(F.lower(q), PUNCT, ""), r"\s+", " ")
    return F.concat(F.lit(" "), F.trim(norm), F.lit(" "))


def has_word(padded: Column, word: str) -> Column:
    return padded.contains(f" {word} ")


def rule_price(q: Column) -> Column:
    low = F.lower(q)
    mil = F.regexp_extract(low, r"(\d+([.,]\d+)?)\s*triệu", 1)
    mil_v = F.regexp_replace(mil, ",", ".").try_cast("double") * F.lit(1_000_000.0)
    bare = F.regexp_extract(low, r"(\d{4,})", 1).try_cast("double")
    return F.when(mil != "", mil_v).when(bare >= 1000, bare)


def rule_gender(padded: Column) -> Column:
    male = has_word(padded, "nam")
    female = has_word(padded, "nữ")
    return F.when(male & ~female, "MALE").when(female & ~male, "FEMALE").otherwise("")


def rule_intent(q: Column) -> dict[str, Column]:
    p = padded_words(q)
    any_set = F.lit(False)
    for w in SET_WORDS:
        any_set = any_set | has_word(p, w)
    n_cat = sum((has_word(p, w).cast("int") for w in CATEGORY_WORDS), F.lit(0))
    the_cat = None
    for w in CATEGORY_WORDS:
        the_cat = F.when(has_word(p, w), F.lit(w)) if the_cat is None else the_cat.when(has_word(p, w), w)
    other = F.lit(False)
    for w in PRICE_WORDS + tuple(GENDER_WORDS):
        other = other | has_word(p, w)
    price = rule_price(q)
    other = other | price.isNotNull()
    intent = (F.when(any_set, INTENT_OUTFIT).when(n_cat == 1, INTENT_SINGLE)
              .when((n_cat == 0) & ~other, INTENT_CHAT).otherwise(INTENT_OUTFIT))
    parts = F.array(*[F.concat(F.lit(f"{c}: "), q) for c in OUTFIT_PARTS])
    return {
        "intent": intent,
        "category": F.when(intent == INTENT_SINGLE, the_cat),
        "gender": rule_gender(p),
        "max_price": price,
        "parts": F.when(intent == INTENT_OUTFIT, parts).otherwise(F.array().cast("array<string>")),
    }


def fallback_fields(q: Column) -> dict[str, Column]:
    """All attempts invalid: substring test for 'áo' and 'nam' (on purpose)."""
    low = F.lower(q)
    hit = low.contains(FALLBACK_WORDS[0]) & low.contains(FALLBACK_WORDS[1])
    return {
        "intent": F.when(hit, F.lit(INTENT_SINGLE)),
        "category": F.when(hit, F.lit("áo")),
        "gender": F.when(hit, F.lit("MALE")),
        "max_price": F.lit(None).cast("double"),
        "price_filter": F.lit(False),
        "parts": F.array().cast("array<string>"),
    }


def route_part(part: Column) -> dict[str, Column]:
    """Split at the first ':' and route the head by substring rules."""
    has_colon = part.contains(":")
    head = F.lower(strip_unicode(F.substring_index(part, ":", 1)))
    desc = strip_unicode(F.regexp_replace(part, r"^[^:]*:", ""))
    key = None
    for k, subs in PART_ROUTES:
        cond = F.lit(False)
        for s in subs:
            cond = cond | head.contains(s)
        key = F.when(cond, F.lit(k)) if key is None else key.when(cond, k)
    return {"has_colon": has_colon,
            "part_category": F.when(has_colon, head),
            "part_desc": F.when(has_colon, desc),
            "category_key": F.when(has_colon, key)}
