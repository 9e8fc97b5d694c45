"""Quality rules with risk-controlled thresholds.

Every document gets a few counts and from them the values of simple rules
(symbols per character, repeated words, repeated lines, capitals, short or
long words).  For each stratum the cutoff of a rule is chosen on labelled
documents so that all rules together reject at most a share ``risk`` of the
good ones, with confidence: cutoffs are tried from the most lenient to the strictest, each by
the exact binomial tail of its false rejections, and the first that fails ends
the sequence (no correction within a sequence is needed); the confidence is
divided by the number of sequences (Bonferroni over rules and strata).  Among
the certified cutoffs the one that removes most bad documents for the fewest
good ones is used, or none if that gains nothing.

Defined results: a null or empty text has no words and fails the base rule; a
null stratum is a stratum of its own; documents of a stratum without enough
labels meet the base rule only; repeated rows give repeated rows; a text that
several rows of a stratum share counts once for the cutoffs, as good if any of
its labels says so; null labels count as absent; a null id has no label;
an empty table gives an empty table; of the input only the named columns are
read, so other columns may have any name.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import WORD_SPACE, map_batches, shingle_hashes, text_or_empty, word_hashes
from vitrine.session import materialize

WINDOW = 8
SYMBOLS = "#*$%&|<>"
_CAPITALS = bytes(range(65, 91))
_NOT_SPACE = re.compile(r"[^\x20\x09-\x0D]")

#: rule -> value in 0..1 that is high for bad text
RULES = {
    "symbols": "n_symbols / greatest(word_chars, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "same_lines": "n_dup_lines / greatest(n_lines, 1)",
    "capitals": "n_capitals / greatest(word_chars, 1)",
    "long_words": "least(word_chars / greatest(n_words, 1) / 50, 1)",
    "short_words": "1 / greatest(word_chars / greatest(n_words, 1), 1)",
}
#: cutoffs tried for a rule: value > step / STEPS
STEPS = 200

_METRICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, " \
           "n_lines long, n_capitals long"
_COUNTS = [f.split()[0] for f in _METRICS.split(", ")]


def step_of(value: str) -> Column:
    """Step of a rule's value: ceil(value * STEPS), 0 to STEPS."""
    return F.expr(f"cast(least(greatest(ceil(({value}) * {STEPS}), 0), {STEPS}) as int)")


def repeat_words(words: np.ndarray, window: int = WINDOW) -> int:
    """Words in windows that occur twice or more."""
    if len(words) < window:
        return 0
    h = shingle_hashes(words, window)
    s = np.sort(h)
    same = s[1:][s[1:] == s[:-1]]
    if not len(same):
        return 0
    starts = np.flatnonzero(np.isin(h, same))
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    edges[starts] += 1
    edges[starts + window] -= 1
    return int((np.cumsum(edges) > 0).sum())


def measure(text: str) -> tuple[int, ...]:
    """The counts of one text, in the order of the schema."""
    raw = text.encode()
    words = raw.split()
    chars = len(text) - sum(map(text.count, WORD_SPACE))
    lines = [line for line in text.split("\n") if _NOT_SPACE.search(line)]
    return (len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)),
            repeat_words(word_hashes(words)), len(lines), len(raw) - len(raw.translate(None, _CAPITALS)))


def metrics(docs: DataFrame, stratum: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, stratum, the text's hash and the counts of every document."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [measure(t) for t in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(3), *[pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]],
            ["doc_id", "stratum", "text_key", *[f.split()[0] for f in _METRICS.split(", ")]])
    cols = [F.col(id_col).cast("long").alias("doc_id"),
            F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"),
            text_or_empty(text_col).alias("text"), F.xxhash64(text_or_empty(text_col)).alias("text_key")]
    return map_batches(docs, cols, run, f"doc_id long, stratum string, text_key long, {_METRICS}")


def log_binomial_tail(k: int, n: int, p: float) -> float:
    """log P(X <= k) for X ~ Binomial(n, p)."""
    if k >= n:
        return 0.0
    i = np.arange(k + 1)
    choose = np.concatenate([[0.0], np.cumsum(np.log((n - i[:-1]) / (i[:-1] + 1)))])
    terms = choose + i * math.log(p) + (n - i) * math.log1p(-p)
    top = terms.max()
    return float(top + np.log(np.exp(terms - top).sum()))


def choose_cutoff(good: np.ndarray, bad: np.ndarray, risk: float, delta: float, price: float) -> int | None:
    """Step of the chosen cutoff, or None.  ``good[s]``, ``bad[s]``: documents
    with values in ((s - 1) / STEPS, s / STEPS]; a cutoff at step s rejects
    step s and up."""
    n_good, n_bad = int(good.sum()), int(bad.sum())
    if not n_good or not n_bad:
        return None
    best, chosen = 0.0, None
    lost, caught = np.cumsum(good[::-1])[::-1], np.cumsum(bad[::-1])[::-1]
    for s in range(len(good) - 1, 0, -1):
        if log_binomial_tail(int(lost[s]), n_good, risk) > math.log(delta):
            break
        gain = caught[s] / n_bad - price * lost[s] / n_good
        if gain > best + 1e-12:
            best, chosen = gain, s
    return chosen


def thresholds(measured: DataFrame, labels: DataFrame, risk: float = 0.06, delta: float = 0.05,
               price: float = 100.0, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """(stratum, cutoffs map<rule, step>) from the labelled documents: a rule
    rejects values over (step - 1) / STEPS.

    ``risk``: largest share of good documents that the rules of a stratum may
    reject together (each rule has an equal part of it); ``delta``: chance that any rule of any stratum breaks that;
    ``price``: bad documents that must go, in shares, for a share of good
    ones.  The work is one aggregate over all labelled rows; what meets in a
    task is at most STEPS + 1 counts of one stratum and rule.
    """
    known = (labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("good"))
             .filter("doc_id is not null and good is not null").groupBy("doc_id").agg(F.max("good").alias("good")))
    parts = F.explode(F.array(*[
        F.struct(F.lit(r).alias("rule"),
                 step_of(v).alias("step"))
        for r, v in RULES.items()])).alias("part")
    # copies are no independent draws: each different text of a stratum counts once, good if any label says so
    holdout = measured.join(known, "doc_id").groupBy("stratum", "text_key").agg(
        F.max("good").alias("good"), *[F.max(c).alias(c) for c in _COUNTS])
    counts = (holdout.select("stratum", "good", parts)
              .groupBy("stratum", "part.rule", "part.step")
              .agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad")))
    sequences = max(1, measured.select("stratum").distinct().count()) * len(RULES)

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        good, bad = np.zeros(STEPS + 1), np.zeros(STEPS + 1)
        good[pdf["step"]], bad[pdf["step"]] = pdf["good"], pdf["bad"]
        step = choose_cutoff(good, bad, risk / len(RULES), delta / sequences, price)
        return pd.DataFrame({"stratum": [str(pdf["stratum"].iloc[0])], "rule": [str(pdf["rule"].iloc[0])],
                             "cutoff": [step or 0]})

    chosen = counts.groupBy("stratum", "rule").applyInPandas(choose, "stratum string, rule string, cutoff int")
    return chosen.filter("cutoff > 0").groupBy("stratum").agg(
        F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs"))


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", **limits) -> DataFrame:
    """doc_id, the counts, base_failed and kept for every document.

    ``base_failed``: fewer than 20 words, or more than 30 % repeated words.
    The counts are written once (checkpoint) and serve both the thresholds
    and the verdicts.
    """
    measured = materialize(metrics(docs, stratum))
    rules = thresholds(measured, labels, **limits)
    over = [F.coalesce(step_of(v) >= F.col("cutoffs")[r], F.lit(False)) for r, v in RULES.items()]
    failed = F.lit(False)
    for o in over:
        failed = failed | o
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return (measured.join(rules, "stratum", "left")
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    base.alias("base_failed"), (~base & ~failed).alias("kept"), "stratum",
                    F.array_compact(F.array(*[F.when(o, F.lit(r)) for o, r in zip(over, RULES, strict=True)]))
                    .alias("broken_rules"), "text_key"))
