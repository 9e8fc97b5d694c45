"""Secret scans: fixed patterns, and sliding-window entropy of candidates.

Everything is a column expression.  A pattern is looked for by
``\\G(gap)(match)``, so that the lengths of gaps and matches give the places
(code points).  Candidate strings (runs of token characters, without
what the patterns found) are read by a window of ``WINDOW`` characters; the counts of its
characters change by one in and one out at each step, and with them the sum
of c * log2(c) from which the Shannon entropy follows.  A candidate is a
secret if the highest entropy of its windows exceeds the limit of its
character class and no allow-list pattern covers it.  What the fixed patterns
found and placeholder words are cut out of a candidate; the parts that are
left are candidates if they have ``WINDOW`` characters or more.

Defined results: a null text is empty and has no spans; repeated rows give
repeated rows; an empty table gives an empty table; of the input only id and
text are read, so other columns may have any name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import text_or_empty

#: kind -> (pattern, characters that the match or its last group needs at least)
BASE = {
    "assign": (r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6),
    "access": (r"(AKIA[A-Z0-9]+)", 20),
    "hex": (r"([0-9a-f]+)", 24),
}
CANDIDATE = r"([A-Za-z0-9+/_=-]+)"
WINDOW = 20
#: character class -> (pattern of the whole candidate, bits that a window must exceed)
CLASSES = {
    "hex": (r"^[0-9A-Fa-f]+$", 3.0),
    "alphanumeric": (r"^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9]+$", 3.6),
    "base64": (r"^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[A-Za-z0-9+/_=-]+$", 3.8),
}
#: candidates that are no secrets: UUIDs, dates and numbers, paths of words
ALLOWED = (r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$|^[0-9_/=+-]+$"
           r"|^/?(?:[A-Za-z]++[/_=-])++[A-Za-z]*+[0-9]{0,4}$")
#: words that are cut out of candidates
PLACEHOLDER = r"((?i:example|sample|placeholder|x{6,}|0{6,}))"

_SPANS = "array<struct<start:bigint,end:bigint>>"


def pattern_spans(text: Column, pattern: str, least: int) -> Column:
    """Spans of the leftmost non-overlapping matches whose last group has at
    least so many characters."""
    whole = rf"\G(?s:.*?)({pattern})"
    step = F.arrays_zip(F.regexp_extract_all(text, F.lit(whole), F.lit(0)).alias("all"),
                        F.regexp_extract_all(text, F.lit(whole), F.lit(1)).alias("own"),
                        F.regexp_extract_all(text, F.lit(whole), F.lit(2)).alias("last"))
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_SPANS).alias("spans"))

    def add(acc: Column, m: Column) -> Column:
        end = acc["at"] + F.length(m["all"])
        span = F.struct((end - F.length(m["own"])).cast("long").alias("start"), end.cast("long").alias("end"))
        return F.struct(end.cast("long").alias("at"),
                        F.when(F.length(m["last"]) >= least, F.concat(acc["spans"], F.array(span)))
                        .otherwise(acc["spans"]).alias("spans"))
    found = F.aggregate(step, empty, add, lambda acc: acc["spans"])
    quick = pattern if least < 20 else pattern.replace("]+)", f"]{{{least - pattern.count('AKIA') * 4},}})")
    return F.when(text.rlike(quick), found).otherwise(F.array().cast(_SPANS))


#: Characters of a long candidate that are read from its own start on.
PART = 512


def window_entropy(value: Column, window: int = WINDOW) -> Column:
    """Highest Shannon entropy (bits) of the windows of an ASCII string, of
    the whole string if it is shorter.  A string is cut into parts of ``PART``
    characters, each with the first window - 1 of the next, so that every
    window lies in one part and the work grows with the length."""
    cut = F.regexp_extract_all(value, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0))
    parts = F.transform(cut, lambda p, i: F.concat(
        p, F.substring(F.coalesce(F.get(cut, i + 1), F.lit("")), 1, window - 1)))
    # what is left of a last part of a few characters lies in the windows of the part before
    whole = F.filter(parts, lambda p, i: (i == 0) | (F.length(p) >= window))
    return F.coalesce(F.array_max(F.transform(whole, lambda p: part_entropy(p, window))), F.lit(0.0))


def part_entropy(value: Column, window: int) -> Column:
    """``window_entropy`` of a short string."""
    def weight(c: Column) -> Column:
        return F.when(c > 1, c * F.log2(F.greatest(c, F.lit(1)))).otherwise(F.lit(0.0))

    def code(i: Column) -> Column:
        return F.ascii(F.substring(value, i, F.lit(1)))

    def put(counts: Column, at: Column, count: Column) -> Column:
        """The counts with one of them replaced."""
        return F.concat(F.slice(counts, 1, at), F.array(count), F.slice(counts, at + 2, 128))

    state = F.struct(F.array_repeat(F.lit(0), 128).alias("counts"), F.lit(0.0).alias("s"), F.lit(0.0).alias("best"))

    def slide(acc: Column, i: Column) -> Column:
        new = code(i)
        old = F.when(i > window, code(i - window)).otherwise(F.lit(-1))
        moved = F.struct(acc["counts"].alias("counts"), acc["s"].alias("s"), acc["best"].alias("best"),
                         F.get(acc["counts"], new).alias("c_in"), F.get(acc["counts"], old).alias("c_out"),
                         new.alias("new"), old.alias("old"))

        def update(m: Column) -> Column:
            same = m["new"] == m["old"]
            s = F.when(same, m["s"]).otherwise(
                m["s"] + weight(m["c_in"] + 1) - weight(m["c_in"])
                + F.when(m["old"] >= 0, weight(m["c_out"] - 1) - weight(m["c_out"])).otherwise(F.lit(0.0)))
            one_in = put(m["counts"], m["new"], m["c_in"] + 1)
            counts = F.when(same, m["counts"]).when(m["old"] < 0, one_in).otherwise(
                put(one_in, m["old"], m["c_out"] - 1))
            bits = F.log2(F.least(i, F.lit(window))) - s / F.least(i, F.lit(window))
            full = (i >= window) | (i == F.length(value))
            return F.struct(counts.alias("counts"), s.alias("s"),
                            F.when(full, F.greatest(m["best"], bits)).otherwise(m["best"]).alias("best"))
        return F.get(F.transform(F.array(moved), update), F.lit(0))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(value), F.lit(1))), state, slide,
                       lambda acc: acc["best"])


KINDS = (*BASE, "entropy")


def with_spans(rows: DataFrame, text_col: str) -> DataFrame:
    """The rows with the spans of every kind in columns ``_assign``,
    ``_access``, ``_hex`` and ``_entropy``: arrays of (start, end) in code
    points, end exclusive.  ``text_col`` has no nulls."""
    text = F.col(text_col)
    found = rows.withColumns({f"_{k}": pattern_spans(text, p, n) for k, (p, n) in BASE.items()}
                             | {"_candidates": pattern_spans(text, CANDIDATE, WINDOW)})
    found = found.withColumn("_base", F.concat(*[F.col(f"_{k}") for k in BASE]))

    def value_of(span: Column) -> Column:
        return F.substring(text, (span["start"] + 1).cast("int"), (span["end"] - span["start"]).cast("int"))

    def parts(span: Column) -> Column:
        """What is left of a candidate, without separators at the cuts."""
        words = F.transform(pattern_spans(value_of(span), PLACEHOLDER, 6), lambda s: F.struct(
            (s["start"] + span["start"]).alias("start"), (s["end"] + span["start"]).alias("end")))
        cuts = F.array_sort(F.concat(words, F.filter("_base", lambda b: (b["start"] < span["end"])
                                                     & (span["start"] < b["end"]))))
        start = F.struct(span["start"].alias("at"), F.array().cast(_SPANS).alias("spans"))

        def step(acc: Column, c: Column) -> Column:
            gap = F.array(F.struct(acc["at"].alias("start"), c["start"].alias("end")))
            return F.struct(F.greatest(acc["at"], c["end"]).alias("at"),
                            F.when(c["start"] > acc["at"], F.concat(acc["spans"], gap)).otherwise(acc["spans"]).alias("spans"))
        left = F.aggregate(cuts, start, step, lambda acc: F.concat(acc["spans"], F.array(F.struct(
            acc["at"].alias("start"), span["end"].alias("end")))))

        def trimmed(s: Column) -> Column:
            v = value_of(s)
            head = F.when(s["start"] > span["start"], F.length(v) - F.length(F.regexp_replace(v, "^[/_=+-]+", ""))).otherwise(0)
            tail = F.when(s["end"] < span["end"], F.length(v) - F.length(F.regexp_replace(v, "[/_=+-]+$", ""))).otherwise(0)
            return F.struct((s["start"] + head).alias("start"), (s["end"] - tail).alias("end"))
        return F.filter(F.transform(left, trimmed), lambda s: s["end"] - s["start"] >= WINDOW)

    def secret(span: Column) -> Column:
        value = value_of(span)
        limit = F.lit(math.inf)
        for pattern, bits in reversed(CLASSES.values()):
            limit = F.when(value.rlike(pattern), F.lit(bits)).otherwise(limit)
        return F.when(~value.rlike(ALLOWED) & (limit < 99), window_entropy(value) > limit).otherwise(F.lit(False))
    whole = F.filter("_candidates", lambda s: ~value_of(s).rlike(ALLOWED))
    return (found.withColumn("_parts", F.flatten(F.transform(whole, parts)))
            .withColumn("_entropy", F.filter("_parts", secret)).drop("_candidates", "_base", "_parts"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and the spans of every kind (see ``with_spans``)."""
    return with_spans(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")),
                      "text")


def _listed(kinds: list[str]) -> Column:
    """kind:start:end of the spans, by start and then kind as listed."""
    def named(n: int, kind: str) -> Column:
        return F.transform(F.col(f"_{kind}"), lambda s: F.struct(
            s["start"].alias("start"), F.lit(n).alias("n"),
            F.concat(F.lit(f"{kind}:"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")).alias("text")))
    parts = [named(n, kind) for n, kind in enumerate(kinds)]
    return F.array_join(F.transform(F.array_sort(F.concat(*parts)), lambda s: s["text"]), ",")


def report(docs: DataFrame, **columns) -> DataFrame:
    """Counts of the base kinds, digest of their spans, and all spans."""
    return scan(docs, **columns).select(
        "doc_id", *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(_listed(list(BASE)), 256).alias("base_sha256"), _listed(list(KINDS)).alias("spans"))
