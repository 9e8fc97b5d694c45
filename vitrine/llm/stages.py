"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir) and decides
by one operator.  All but the last return the columns of ``docs``.

A row travels in one struct column, so extra columns may have any name.  Rows
are judged by their own text: of rows with a null or an equal id only those
whose text breaks a rule go, and each keeps its own cut or redacted text.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm import ngramjoin, packing, quality, secrets, suffixes
from vitrine.llm.common import small_batches, table, text_or_empty
from vitrine.llm.queries import tokenizer_file
from vitrine.session import ensure_checkpoint_dir, ship_package

#: What stands for a secret.
REDACTED = "[SECRET]"


def _ready(spark: SparkSession) -> None:
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    small_batches(spark)


def _nested(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text, key): the whole row, its id, text and the text's hash."""
    text = text_or_empty("text")
    return docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                       text.alias("text"), F.xxhash64(text).alias("key"))


def _with_text(nested: DataFrame, docs: DataFrame, changed: Column) -> DataFrame:
    """The rows with the text ``changed`` where that is not null, and its length."""
    out = {f.name: F.col("row")[f.name] for f in docs.schema.fields}
    out["text"] = F.coalesce(changed, out["text"])
    if "n_chars" in out:
        out["n_chars"] = F.when(changed.isNull(), out["n_chars"]).otherwise(F.length(changed)).cast(
            docs.schema["n_chars"].dataType)
    return nested.select(*[c.alias(n) for n, c in out.items()])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break the base rule or a risk-controlled cutoff go."""
    _ready(spark)
    verdict = quality.judge(docs, table(spark, sf_dir, "labels"))
    # a verdict follows from the text and its stratum, so it holds for all rows with both
    rejected = verdict.filter("not kept").select(F.col("text_key").alias("key"), F.col("stratum")).distinct()
    return (_nested(docs).withColumn("stratum", F.coalesce(F.col("row")["lang"].cast("string"), F.lit("")))
            .join(rejected, ["key", "stratum"], "left_anti").select("row.*"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component (five words, similarity 0.8) stays."""
    _ready(spark)
    return ngramjoin.representatives(docs)


def _whole_chars(raw: bytes, starts: list[int], ends: list[int]) -> str:
    """What is left, with characters that a run covers in part kept whole."""
    inner = []
    for a, b in zip(starts, ends, strict=True):
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        inner.append((a, b))
    return suffixes.kept_bytes(raw, [a for a, _ in inner], [b for _, b in inner]).decode()


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes that repeat an earlier document's are cut out; a document of
    which nothing but white space is left goes."""
    _ready(spark)

    def cut(ids: pa.Array, texts: list[bytes], starts: list, ends: list) -> pa.RecordBatch | None:
        at = [i for i, s in enumerate(starts) if len(s) and ids[i].is_valid]
        if not at:
            return None
        return pa.RecordBatch.from_arrays(
            [ids.take(pa.array(at)), pa.array([texts[i] for i in at], pa.binary()).cast(pa.string()),
             pa.array([_whole_chars(texts[i], starts[i].tolist(), ends[i].tolist()) for i in at], pa.string())],
            ["_id", "old", "_text"])
    changed = (suffixes.with_runs(docs, cut, "_id long, old string, _text string")
               .select("_id", F.xxhash64("old").alias("_key"), "_text").dropDuplicates(["_id", "_key"]))
    nested = _nested(docs)
    out = _with_text(nested.join(changed, (nested["doc_id"] == changed["_id"]) & (nested["key"] == changed["_key"]), "left"),
                     docs, F.col("_text"))
    return out.filter(F.col("text").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]"))


def _redacted(text: Column, spans: Column) -> Column:
    """The text with its spans, sorted and perhaps overlapping, replaced."""
    start = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        return F.struct(F.when(s["start"] >= acc["at"], F.concat(acc["done"], gap, F.lit(REDACTED)))
                        .otherwise(acc["done"]).alias("done"), F.greatest(acc["at"], s["end"]).alias("at"))
    return F.aggregate(F.array_sort(spans), start, step,
                       lambda acc: F.concat(acc["done"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by ``REDACTED``; all documents stay."""
    _ready(spark)
    found = secrets.with_spans(_nested(docs), "text")
    spans = F.concat(*[F.col(f"_{k}") for k in secrets.KINDS])
    return _with_text(found, docs, F.when(F.size(spans) > 0, _redacted(F.col("text"), spans)))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents that are left, by sequence."""
    _ready(spark)
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))
