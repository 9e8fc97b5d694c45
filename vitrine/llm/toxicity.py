"""Toxicity by a counterfactual-regularised classifier.

A logistic model over the words of a text and their stems, i.e. the first
characters (presence).  It is fitted on a bounded sample of the labelled
texts, picked by ids and hashes alone; the terms of the model are those that
tell the classes of the sample apart best (chi-square of document counts), if
they do so significantly.  Besides the usual loss, each labelled text is read
once more for every other identity term that could stand in place of its own,
and the squared change of its score is penalised, so that a neutral mention
of a group moves nothing; the penalty is raised until no swap changes a score
by more than ``gap``, or ``RAISES`` times.

Defined results: a null or empty text has no words and gets the score of the
intercept; null labels are not learned; a document with several labels counts
once, as toxic if any says so; without both classes all scores are 0; repeated
rows give repeated rows; an empty table gives an empty table; of the input
only the named columns are read, so other columns may have any name; a null
id has no label and is held out or not by the empty text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import strata_bucket, text_or_empty
from vitrine.session import materialize

#: Identity terms; those of one line may stand for each other.
IDENTITY = (
    "men women boys girls nonbinary transgender",
    "man woman boy girl",
    "muslims christians jews hindus buddhists atheists",
    "muslim christian jewish hindu buddhist atheist",
    "black white asian latino european african american arab indian",
    "gay straight lesbian bisexual heterosexual queer",
    "immigrants refugees natives foreigners citizens",
    "old young elderly disabled deaf blind",
    "hommes femmes garçons filles transgenres",
    "musulmans chrétiens juifs hindous bouddhistes athées",
    "noirs blancs asiatiques arabes africains européens",
    "immigrés réfugiés étrangers citoyens",
    "männer frauen jungen mädchen",
    "muslime christen juden hindus buddhisten atheisten",
    "schwarze weiße asiaten araber afrikaner europäer",
    "einwanderer flüchtlinge ausländer bürger",
    "hombres mujeres chicos chicas",
    "musulmanes cristianos judíos hindúes budistas ateos",
    "negros blancos asiáticos árabes africanos europeos",
    "inmigrantes refugiados extranjeros ciudadanos",
)
#: Parameters of ``score``: terms of the model, texts that are fitted (lowest hashes, copies once, each
#: class half), texts that a term must occur in, chi-square that it needs (1 degree of freedom).  Measured
#: on the 6,948 held-out labelled documents of 0.1 GB: see README.
WORDS = 2_000
FIT_ROWS = 20_000
MIN_DOCS = 3
SIGNIFICANT = 15.0
#: Change of a score by a swap that is small enough, and how often the penalty is raised for it.
GAP = 0.05
RAISES = 6
THRESHOLD = 0.7
_WORD = r"[^\p{L}\p{Nd}']+"


#: Lengths of stems (marked by ^).
STEMS = (4, 5)


def _stem(length: int) -> Callable[[Column], Column]:
    return lambda word: F.concat(F.lit("^"), F.substring(word, 1, length))


def _terms(words: Column) -> Column:
    """Distinct words and their stems."""
    parts = [words, *[F.transform(words, _stem(n)) for n in STEMS]]
    return F.array_distinct(F.concat(*parts))


def _words(text: Column) -> Column:
    return F.array_distinct(F.split(F.lower(text), _WORD))


def _python_terms(words: set[str]) -> set[str]:
    return words.union(*[{"^" + w[:n] for w in words} for n in STEMS])


def swaps() -> list[dict[str, str]]:
    """Each identity term's counterparts: by the n-th table the n-th next of
    its first line that has so many terms."""
    longest = max(len(line.split()) for line in IDENTITY)
    out: list[dict[str, str]] = [{} for _ in range(longest - 1)]
    for line in IDENTITY:
        terms = line.split()
        for n in range(1, len(terms)):
            for i, term in enumerate(terms):
                out[n - 1].setdefault(term, terms[(i + n) % len(terms)])
    return out


def _flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All terms of the rows, and the row of each."""
    terms = np.concatenate(rows) if len(rows) else np.empty(0, np.int64)
    return terms.astype(np.int64), np.repeat(np.arange(len(rows)), [len(x) for x in rows])


def _scores(terms: np.ndarray, row: np.ndarray, n: int, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(np.bincount(row, w[terms], n) + w[-1], -30, 30)))


def fit(rows: list[np.ndarray], swapped: list[list[np.ndarray]], y: np.ndarray, size: int, ridge: float = 1e-4,
        fairness: float = 1.0, rounds: int = 300, gap: float = GAP) -> np.ndarray:
    """Weights of the words and, last, the intercept (gradient steps with Adam;
    both classes weigh the same).  ``swapped`` has the versions of each row."""
    ia, ra = _flat(rows)
    n = len(rows)
    source = np.array([k for k, versions in enumerate(swapped) for v in versions if not np.array_equal(rows[k], v)],
                      dtype=np.int64)
    ib, rb = _flat([v for k, versions in enumerate(swapped) for v in versions if not np.array_equal(rows[k], v)])
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))

    def descend(penalty: float) -> np.ndarray:
        w, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
        for step in range(1, rounds + 1):
            s = _scores(ia, ra, n, w)
            d = weight * (s - y)
            g = ridge * w
            g[size] = 0
            if len(source):  # penalty * mean (s - s')^2
                t = _scores(ib, rb, len(source), w)
                own = s[source]
                slope = 2 * penalty * (own - t) / len(source)
                d += np.bincount(source, slope * own * (1 - own), n)
                e = -slope * t * (1 - t)
                g += np.bincount(ib, e[rb], size + 1)
                g[size] += e.sum()
            g += np.bincount(ia, d[ra], size + 1)
            g[size] += d.sum()
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        return w
    w = descend(fairness)
    for _ in range(RAISES if len(source) and fairness else 0):
        if np.abs(_scores(ia, ra, n, w)[source] - _scores(ib, rb, len(source), w)).max() <= gap:
            break
        fairness *= 4
        w = descend(fairness)
    return w


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, fit_rows: int) -> DataFrame:
    """(y, at, text) of at most ``fit_rows`` different learning texts, half of
    each class: ids, labels and hashes decide, then the texts are picked out by
    one broadcast join with the scan (the sample's ids, of bounded number)."""
    known = (labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
             .groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(F.col(label_col).cast("int")).alias("y")))
    own = docs.filter(~(strata_bucket(id_col, 3) == 1)).select(
        F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("at", F.xxhash64("text"))
    # copies of a text take one place, that of the lowest id
    texts = own.select("doc_id", "at").join(known, "doc_id").groupBy("y", "at").agg(F.min("doc_id").alias("doc_id"))
    texts = materialize(texts)
    half = fit_rows // 2
    picked = texts.filter("y = 1").orderBy("at").limit(half).unionAll(texts.filter("y = 0").orderBy("at").limit(half))
    return own.join(F.broadcast(picked), ["doc_id", "at"])


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", threshold: float = THRESHOLD, words: int = WORDS,
          fit_rows: int = FIT_ROWS, min_docs: int = MIN_DOCS, significant: float = SIGNIFICANT,
          fairness: float = 1.0, gap: float = GAP) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    The model is fitted on the sample (``fit_rows``); its terms' counts stay
    in Spark, and only the places of the texts' terms in the model come to
    the driver.  The model, at most ``words`` weights, goes to the tasks.
    """
    held = strata_bucket(id_col, 3) == 1
    rows = sample(docs, labels, id_col, text_col, label_col, fit_rows).select(
        "y", "at", _words(F.col("text")).alias("words"))
    rows = materialize(rows)
    # rows of one id and text share a place
    places = rows.groupBy("y", "at").agg(F.count(F.lit(1)).alias("rows"))
    total = {r["y"]: r["n"] for r in places.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = total.get(1, 0), total.get(0, 0)
    vocabulary: dict[str, int] = {}
    w = np.zeros(1)
    if n1 and n0:
        part = 1 / F.col("rows")
        counts = (rows.join(F.broadcast(places), ["y", "at"])
                  .select(F.when(F.col("y") == 1, part).otherwise(0.0).alias("a"),
                          F.when(F.col("y") == 0, part).otherwise(0.0).alias("b"),
                          F.explode(_terms(F.col("words"))).alias("word")).filter("word not in ('', '^')")
                  .groupBy("word").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
                  .filter(f"a + b >= {min_docs}"))
        share = F.expr(f"(a + b) / {n1 + n0}D")
        chi = F.expr(f"pow(a / {n1}D - b / {n0}D, 2)") / (share * (1 - share) * (1 / n1 + 1 / n0) + 1e-12)
        best = counts.filter(chi >= significant).orderBy(F.round(chi, 9).desc(), "word").limit(words).collect()
        vocabulary = {r["word"]: i for i, r in enumerate(best)}
        lookup, tables = dict(vocabulary), swaps()

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def terms(some: set[str]) -> list[int]:
                return sorted(lookup[x] for x in _python_terms(some) if x in lookup)
            for b in batches:
                own, other = [], []
                for ws in b.column(2).to_pylist():
                    own.append(terms(set(ws)))
                    versions = {frozenset(swap.get(x, x) for x in ws) for swap in tables} - {frozenset(ws)}
                    other.append(sorted(terms(set(v)) for v in versions))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(own, pa.list_(pa.int32())),
                     pa.array(other, pa.list_(pa.list_(pa.int32())))], ["y", "at", "own", "other"])
        got = (rows.select("y", "at", "words").mapInArrow(place, "y int, at long, own array<int>, other array<array<int>>")
               .groupBy("y", "at").agg(F.min(F.struct("own", "other")).alias("terms"))
               .select("y", "at", "terms.*").collect())
        got.sort(key=lambda r: (-r["y"], r["at"]))
        w = fit([np.array(r["own"], dtype=np.int64) for r in got],
                [[np.array(v, dtype=np.int64) for v in r["other"]] for r in got],
                np.array([r["y"] for r in got], dtype=float), len(vocabulary), fairness=fairness, gap=gap)
    weights = {word: float(w[i]) for word, i in vocabulary.items()}
    base = float(w[-1]) if vocabulary else None

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        split = regex.compile(_WORD).split
        for b in batches:
            out = np.zeros(b.num_rows)
            if base is not None:
                for i, t in enumerate(b.column(2).to_pylist()):
                    s = base + sum(map(weights.__getitem__, weights.keys() & _python_terms(set(split(t.lower())))))
                    out[i] = 1 / (1 + np.exp(-min(max(s, -30.0), 30.0)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(out), pa.array((out >= threshold).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"])
    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"),
                        text_or_empty(text_col).alias("text"))
            .mapInArrow(judge, "doc_id long, held_out boolean, score double, predicted int"))
