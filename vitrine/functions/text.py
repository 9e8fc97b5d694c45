"""Text normalisation as native column expressions.

Pipeline (reference order): lower-case -> (word segmentation: not built, see
README) -> delete everything that is not a letter, digit, '_' or whitespace
-> whitespace split -> stopword filter (keeps repeats; ``array_except``
would de-duplicate).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Java/RE2-safe form of Python's [^\w\s]: letters, digits, underscore, space.
PUNCT = r"[^\p{L}\p{N}_\s]"


def normalize_text(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), PUNCT, "")


def raw_tokens(text: Column) -> Column:
    return F.filter(F.split(normalize_text(text), r"\s+"), lambda x: x != "")


def split_words(text: Column) -> Column:
    """Whitespace split of the normalised text (may hold empty strings)."""
    return F.split(normalize_text(text), r"\s+")


def kept_word(word: Column, stopwords: list[str]) -> Column:
    """Row predicate for an exploded word: non-empty and not a stopword.

    Used after ``explode(split_words(...))`` where only the multiset of words
    matters: plain predicates stay inside whole-stage codegen, unlike the
    lambda of ``F.filter`` over the array.
    """
    words = sorted(set(stopwords))
    keep = word != ""
    return keep & ~word.isin(words) if words else keep


def clean_tokens(text: Column, stopwords: list[str]) -> Column:
    """array<string> of tokens, stopwords removed, order and repeats kept."""
    words = sorted(set(stopwords))
    if not words:
        return raw_tokens(text)
    # one pass over the words: empty strings and stopwords dropped together
    return F.filter(split_words(text), lambda x: (x != "") & ~x.isin(words))


def joined_tokens(text: Column, stopwords: list[str]) -> Column:
    """``split=False`` form: tokens re-joined by single spaces."""
    return F.array_join(clean_tokens(text, stopwords), " ")


def strip_unicode(c: Column) -> Column:
    """Python ``str.strip()``: leading/trailing Unicode whitespace (SQL trim only strips spaces)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
