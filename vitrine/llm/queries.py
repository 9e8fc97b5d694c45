"""Queries over the document tables, one for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vitrine.llm import filteraudit, turnrepair
from vitrine.llm.common import table
from vitrine.session import ensure_checkpoint_dir, scratch_path, ship_package

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {"op11_turns": turnrepair.SQL, "op13_filter_audit": filteraudit.SQL}


def query(name: str) -> Callable[[QueryFn], QueryFn]:
    def register(fn: QueryFn) -> QueryFn:
        def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_checkpoint_dir(spark)
            ship_package(spark)
            return fn(spark, sf_dir)
        prepared.__name__, prepared.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = prepared
        return prepared
    return register


def tokenizer_file(name: str) -> str:
    """Place of a public vocabulary file (a parameter of the operators)."""
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op1_bpe")
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE round trip of every document."""
    from public_tokenizers import PATTERN

    from vitrine.llm import bpe
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"), PATTERN)


@query("op9_quality")
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rule and risk-controlled verdict of every document."""
    from vitrine.llm import quality
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op7_packing")
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of at most 2048 ids."""
    from vitrine.llm import packing
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


@query("op6_secrets")
def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: base patterns and entropy spans."""
    from vitrine.llm import secrets
    return secrets.report(table(spark, sf_dir, "documents"))


@query("op10_fingerprints")
def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text."""
    from vitrine.llm import fingerprints
    return fingerprints.with_next(table(spark, sf_dir, "documents"))


@query("op5_language")
def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    from vitrine.llm import language
    return language.identify(table(spark, sf_dir, "documents"))


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    from vitrine.llm import toxicity
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_suffixes")
def op4_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that repeat an earlier document's."""
    from vitrine.llm import suffixes
    return suffixes.report(table(spark, sf_dir, "documents"))


@query("op2_ngram_join")
def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose shingle sets are alike."""
    from vitrine.llm import ngramjoin
    return ngramjoin.join(table(spark, sf_dir, "documents"))


@query("op8_html")
def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of every page, laid out."""
    from vitrine.llm import html
    return html.extract(table(spark, sf_dir, "pages"))


@query("op13_filter_audit")
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove in every order of them, by source."""
    return filteraudit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op12_simple8b")
def op12_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, written to Simple-8b files and read back."""
    from vitrine.llm import simple8b
    return simple8b.round_trip(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"),
                               scratch_path(spark, "token-ids"))


@query("op11_turns")
def op11_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest repair and its digest of every damaged conversation."""
    return turnrepair.report(turnrepair.damage(table(spark, sf_dir, "conversations")), present="present")
