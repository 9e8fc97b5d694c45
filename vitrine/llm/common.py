"""Helpers shared by the operators of this package."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words (space, \\t \\n \\v \\f \\r).
WORD_SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the supplied tables, read by Spark."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_or_empty(text: str | Column = "text") -> Column:
    """A null text counts as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def map_batches(df: DataFrame, columns: list, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None],
                schema: str) -> DataFrame:
    """Narrow map over Arrow batches of the given columns (no shuffle)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield out
    return df.select(*columns).mapInArrow(run, schema)


#: Bytes of the Arrow batches that a session of the pipeline sends to a worker.
BATCH_BYTES = 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Have Spark cut Arrow batches at ``BATCH_BYTES`` if it cuts them later."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is not None and not 0 < int(re.sub(r"\D", "", now)) <= BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def give_back() -> None:
    """At the end of a task: return what Arrow and the allocator keep of freed
    memory to the system, since workers are used again by other tasks."""
    import ctypes
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def release(spark: SparkSession) -> None:
    """Between two steps of a long job: have the driver collect its garbage,
    upon which Spark deletes the shuffle files of plans that have ended (it
    does so by itself only every ``spark.cleaner.periodicGC.interval``)."""
    import gc
    gc.collect()
    try:
        spark.sparkContext._jvm.System.gc()
    except Exception:  # remote (Connect) session
        return


_WORD_HASH_MAX = 200_000


class _WordHash(dict):
    """bytes -> 64-bit hash, filled on first use; emptied when it is full so
    that the memory of a worker stays bounded."""

    def __missing__(self, word: bytes) -> int:
        import xxhash
        if len(self) >= _WORD_HASH_MAX:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _WordHash()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """Stable 64-bit hash of every word (equal in all processes)."""
    return np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (bijective)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Odd multipliers of a word's place in a window.
_PLACE = mix64(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of every window of n words (n <= 64); of the whole
    sequence if it is shorter; nothing without words."""
    if not len(words):
        return words
    m = min(n, len(words))
    size = len(words) - m + 1
    acc = words[:size] * _PLACE[0]
    for i in range(1, m):
        acc += words[i:i + size] * _PLACE[i]
    return mix64(acc + np.uint64(m))


def strata_bucket(doc_id: str, modulus: int) -> Column:
    """crc32 of the id's text modulo ``modulus``; a null id counts as ''."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus
