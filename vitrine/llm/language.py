"""Language identification by string kernels.

The kernel of two texts is the cosine of their sets of byte n-grams of several
lengths (blended spectrum, presence).  Nystroem landmarks turn it into a short
vector, kernel ridge regression learns one language against the rest, and
texts are scored by two matrix products for a batch.

Defined results: a null text, or one without letters, is ``und`` with score 0;
null languages are not learned; without any learned language all is ``und``;
repeated rows give repeated rows; an empty table gives an empty table; of the
input only the named columns are read, so other columns may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.llm.common import strata_bucket, text_or_empty

LENGTHS = (1, 2, 3, 4)
#: n-grams are hashed to so many places
PLACES = 8192
LANDMARKS = 128
#: Labelled texts that are fitted at most, of each language those of the lowest hashes.
FIT_ROWS = 6_000
RIDGE = 1e-2
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


def presence(text: str, out: np.ndarray) -> None:
    """Mark the n-grams of a whole text in one row of 0/1."""
    raw = np.frombuffer(text.lower().encode(), dtype=np.uint8)
    for lo in range(0, len(raw), 1 << 20):  # long texts by parts that overlap
        part = raw[lo:lo + (1 << 20) + max(LENGTHS) - 1].astype(np.uint32)
        code = np.zeros(len(part), dtype=np.uint32)
        for n in range(1, max(LENGTHS) + 1):
            if len(part) < n:
                break
            code = (code[:len(part) - n + 1] << np.uint32(8)) | part[n - 1:]
            if n in LENGTHS:
                out[((code * np.uint32(2654435761) + np.uint32(n * 40503)) >> np.uint32(8)) % np.uint32(PLACES)] = 1


def vectors(texts: list[str]) -> np.ndarray:
    """Presence rows of unit length."""
    x = np.zeros((len(texts), PLACES), dtype=np.float32)
    for i, t in enumerate(texts):
        presence(t, x[i])
    x /= np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
    return x


def fit(x: np.ndarray, lang: list[str], landmarks: int = LANDMARKS,
        ridge: float = RIDGE) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, landmark rows, weights: landmark similarities and 1 -> a score for each language)."""
    names = sorted(set(lang))
    y = np.array([[1.0 if v == n else -1.0 for n in names] for v in lang])
    turn = np.zeros(len(lang), dtype=np.int64)  # landmarks take turns over the languages
    seen: dict[str, int] = {}
    for i, v in enumerate(lang):
        turn[i] = seen.get(v, 0)
        seen[v] = turn[i] + 1
    chosen = np.argsort(turn, kind="stable")[:landmarks]
    marks = x[chosen]
    value, vector = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    keep = value > 1e-6 * value.max()
    half = vector[:, keep] / np.sqrt(value[keep])
    z = np.hstack([(x @ marks.T).astype(np.float64) @ half, np.ones((len(x), 1))])
    w = np.linalg.solve(z.T @ z + ridge * len(x) / len(names) * 0.01 * np.eye(z.shape[1]) + 1e-9 * np.eye(z.shape[1]), z.T @ y)
    return names, marks, np.vstack([half @ w[:-1], w[-1:]]).astype(np.float32)


def share(counts: list[int], rows: int) -> int:
    """Most texts of each language that together are at most ``rows``; what
    small languages leave goes to the others, and each has one at least."""
    left, quota = rows, 1
    for k, n in enumerate(sorted(counts)):
        quota = max(1, left // (len(counts) - k))
        left -= min(n, quota)
    return quota


def sample_keys(known: DataFrame, fit_rows: int) -> DataFrame:
    """(lang, at) of the distinct texts to be fitted, of rows (lang, at)."""
    keys = known.select("lang", "at").distinct()
    counts = {r["lang"]: r["count"] for r in keys.groupBy("lang").count().collect()}
    quota = share(list(counts.values()), fit_rows)
    if not counts:
        return keys
    # hashes are uniform: below this bound lie more than the quota, but not many, so that the ranks are over few rows
    bounds = [(lang, min(int(1.5 * (quota + 100) / n * 2 ** 64), 2 ** 64 - 1) - 2 ** 63) for lang, n in counts.items()]
    low = known.sparkSession.createDataFrame(bounds, "lang string, bound long")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("at"))
    return (keys.join(F.broadcast(low), "lang").filter("at <= bound").withColumn("rank", rank)
            .filter(F.col("rank") <= quota).select("lang", "at"))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             fit_rows: int = FIT_ROWS, landmarks: int = LANDMARKS) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document.

    At most ``fit_rows`` distinct texts that are not held out, spread over the
    languages, are fitted (one of each language at least); their packed presence rows (1 KB each) come to the
    driver, and the model (landmarks x places) goes to the tasks.
    """
    spark = docs.sparkSession
    held = strata_bucket(id_col, 4) == 2
    cols = [F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), text_or_empty(text_col).alias("text")]
    known = docs.filter(~held & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"),
        F.xxhash64(text_col).alias("at"))
    sample = known.join(F.broadcast(sample_keys(known, fit_rows)), ["lang", "at"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, int]] = set()
        for b in batches:
            langs, hashes, rows = [], [], []
            for lang, at, t in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if (lang, at) in seen:  # a copy
                    continue
                seen.add((lang, at))
                bits = np.zeros(PLACES, dtype=np.uint8)
                presence(t, bits)
                langs.append(lang)
                hashes.append(at)
                rows.append(np.packbits(bits).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(hashes, pa.int64()),
                                              pa.array(rows, pa.binary())], ["lang", "at", "bits"])
    got = (sample.select("lang", "at", "text").mapInArrow(pack, "lang string, at long, bits binary")
           .groupBy("lang", "at").agg(F.min("bits").alias("bits")).collect())
    got.sort(key=lambda r: (r["at"], r["lang"]))
    names: list[str] = []
    if got:
        x = np.stack([np.unpackbits(np.frombuffer(r["bits"], dtype=np.uint8)) for r in got]).astype(np.float32)
        x /= np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
        names, marks, weights = fit(x, [r["lang"] for r in got], landmarks)
        model = spark.sparkContext.broadcast((names, marks, weights))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            pred, conf = [UNKNOWN] * len(texts), np.zeros(len(texts))
            lettered = [i for i, t in enumerate(texts) if _LETTER.search(t)]
            for lo in range(0, len(lettered) if names else 0, 256):
                own, marks, weights = model.value
                rows = lettered[lo:lo + 256]
                s = vectors([texts[i] for i in rows]) @ marks.T @ weights[:-1] + weights[-1]
                top = s.argmax(axis=1)
                e = np.exp(3.0 * (s - s.max(axis=1, keepdims=True)))
                conf[rows] = 1.0 / e.sum(axis=1)
                for i, k in zip(rows, top.tolist(), strict=True):
                    pred[i] = own[k]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(pred, pa.string()), pa.array(conf)],
                                             ["doc_id", "held_out", "lang_pred", "score"])
    return docs.select(*cols).mapInArrow(score, "doc_id long, held_out boolean, lang_pred string, score double")
