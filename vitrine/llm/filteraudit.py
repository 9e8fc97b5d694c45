"""Interaction audit of five filters: what each removes at each place of
every order in which the filters can be applied.

A document is its mask, the set of filters that it fails, and an order
removes it at the first of its letters that is in the mask.  The orders are
ranked by their Lehmer code, that is lexicographically, so all orders that
begin with the same letters have adjacent ranks: a mask is removed at step k
in one interval of ranks for each prefix of k - 1 letters outside the mask
and one inside.  Its count is added at the start of the interval and taken
away at the end; a running sum over the 120 ranks of a step gives what the
step removes in every order.  Documents are only read to count the masks of
each part; everything after that works on parts x masks.

Which text is a copy is decided by the smallest id of its digest.  Copies are
counted by digest and part before anything is joined (the sums combine on the
map side), and the documents of the smallest id are found by digest and id,
so a group of copies of any size never meets in a task.

Defined results: a null text is empty; a null id is smaller than none, copies
none and has no label, so its row never fails the copy filter; rows of one id and text
don't make each other copies, and each counts; of several labels of an id
the largest value counts, and a null label is none; a null part is the empty
string; an empty table gives no part and no row.  Of the documents only the
named columns are read, so others may have any name.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.llm.common import text_or_empty
from vitrine.session import materialize

SPACE = r"[\x20\x09-\x0D]+"


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions that a text alone decides."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


#: The filter that other documents decide.
COPY = "E"
#: What is counted of documents.
LOST = ("n", "good", "toxic")


def removal_intervals(letters: str) -> list[tuple[int, int, int, int]]:
    """(mask, step, first rank, rank after the last) of all orders that remove
    the mask at the step; bit i of a mask is the i-th letter."""
    n = len(letters)
    out = []
    for mask in range(1, 1 << n):
        spared = [i for i in range(n) if not mask >> i & 1]
        for step in range(1, len(spared) + 2):
            size = factorial(n - step)
            for before in permutations(spared, step - 1):
                for last in (i for i in range(n) if mask >> i & 1):
                    rank, left = 0, list(range(n))
                    for at, i in enumerate((*before, last)):
                        rank += left.index(i) * factorial(n - 1 - at)
                        left.remove(i)
                    out.append((mask, step, rank, rank + size))
    return out


def masks(docs: DataFrame, labels: DataFrame, part: str = "source", id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the filters
    that they fail."""
    text = text_or_empty(text_col)
    own = text_filters(text)
    bits = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(own.values())), F.lit(0))
    rows = docs.select(
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(id_col).cast("long").alias("id"),
        F.unhex(F.sha2(text, 256)).alias("digest"), bits.alias("bits"))
    known = labels.groupBy(F.col(id_col).cast("long").alias("id")).agg(
        F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    rows = materialize(rows.join(known.filter("id is not null"), "id", "left").select(
        "part", "id", "digest", "bits", F.lit(1).alias("n"), F.when(F.col("quality") == 1, 1).otherwise(0).alias("good"),
        F.when(F.col("toxic") == 1, 1).otherwise(0).alias("toxic")))
    sums = [F.sum(c).alias(c) for c in LOST]
    # texts under several ids: all their documents fail the copy filter but those of the least id
    copied = (rows.groupBy("digest").agg(F.min("id").alias("least"), F.max("id").alias("most"))
              .filter("least < most").select("digest", "least"))
    of_texts = rows.filter("id is not null").groupBy("digest", "part", "bits").agg(*sums).join(copied, "digest")
    first = rows.join(copied.withColumnRenamed("least", "id"), ["digest", "id"])
    copy = 1 << len(own)

    def signed(counts: DataFrame, sign: int, bit: int) -> DataFrame:
        return counts.select("part", (F.col("bits") + bit).alias("mask"), *[(sign * F.col(c)).alias(c) for c in LOST])
    return (signed(rows, 1, 0).unionAll(signed(of_texts, -1, 0)).unionAll(signed(of_texts, 1, copy))
            .unionAll(signed(first, 1, 0)).unionAll(signed(first, -1, copy))
            .groupBy("part", "mask").agg(*sums).filter("n > 0"))


def audit(docs: DataFrame, labels: DataFrame, part: str = "source", id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """One row for each part, order and step: kept, removed, redundant,
    unique_fails, good_lost, toxic_lost and shapley."""
    spark = docs.sparkSession
    letters = "ABCD" + COPY
    n = len(letters)
    counted = materialize(masks(docs, labels, part, id_col, text_col))
    # per part: all documents, failures of each filter and of it alone
    part_totals = counted.groupBy("part").agg(
        F.sum("n").alias("total"),
        F.array(*[F.sum(F.when(F.col("mask").bitwiseAND(1 << i) != 0, F.col("n")).otherwise(0))
                  for i in range(n)]).alias("fails"),
        F.array(*[F.sum(F.when(F.col("mask") == 1 << i, F.col("n")).otherwise(0)) for i in range(n)]).alias("alone"))

    # difference arrays: counts at the start of an interval, their negatives at its end
    spans = spark.createDataFrame(removal_intervals(letters), "mask int, step int, low int, high int")
    at = F.explode(F.array(F.struct(F.col("low").alias("rank"), F.lit(1).alias("sign")),
                           F.struct(F.col("high").alias("rank"), F.lit(-1).alias("sign"))))
    ends = (counted.join(F.broadcast(spans), "mask").select("part", "step", *LOST, at.alias("at"))
            .groupBy("part", "step", F.col("at.rank").alias("rank"))
            .agg(*[F.sum(F.col(c) * F.col("at.sign")).alias(c) for c in LOST]))

    # all ranks and steps of a part (120 x 5), then the running sums over the ranks
    orders = ["".join(o) for o in permutations(letters)]
    listed = F.array(*[F.lit(o) for o in orders])
    grid = (part_totals.select("part", "total", "fails", "alone",
                               F.explode(F.sequence(F.lit(0), F.lit(len(orders) - 1))).alias("rank"))
            .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n)))))
    ranks = Window.partitionBy("part", "step").orderBy("rank")
    run = grid.join(ends, ["part", "step", "rank"], "left")
    for c in LOST:
        run = run.withColumn(c, F.coalesce(F.sum(c).over(ranks), F.lit(0)))
    run = (run.withColumn("filter_order", F.element_at(listed, F.col("rank") + 1))
           .withColumn("letter", F.substring("filter_order", F.col("step"), F.lit(1)))
           .withColumn("own", F.instr(F.lit(letters), F.col("letter"))))
    steps = Window.partitionBy("part", "rank").orderBy("step")
    return run.select(
        "part", "filter_order", "step", (F.col("total") - F.sum("n").over(steps)).alias("kept"),
        F.col("n").alias("removed"), (F.element_at("fails", F.col("own")) - F.col("n")).alias("redundant"),
        F.element_at("alone", F.col("own")).alias("unique_fails"), F.col("good").alias("good_lost"),
        F.col("toxic").alias("toxic_lost"), F.sum("n").over(Window.partitionBy("part", "letter")).alias("shapley"))


#: The same rows for DuckDB, by brute force over documents' masks and orders.
SQL = r"""
WITH known AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
texts AS (SELECT coalesce(source, '') AS part, doc_id, coalesce(text, '') AS t FROM documents),
firsts AS (SELECT t, min(doc_id) AS least FROM texts GROUP BY t),
counted AS (
  SELECT x.part, x.doc_id, x.t, f.least, regexp_extract_all(x.t, '[^\x20\x09-\x0D]+') AS w
  FROM texts x JOIN firsts f ON f.t = x.t),
failing AS (
  SELECT c.part, c.doc_id,
    CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > least THEN 'E' ELSE '' END AS fails, k.quality, k.toxic
  FROM counted c LEFT JOIN known k USING (doc_id)),
masks AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS good,
  count(*) FILTER (WHERE toxic = 1) AS bad FROM failing GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (SELECT a.l || b.l || c.l || d.l || e.l AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
places AS (SELECT o, k::INT AS step, substr(o, k::INT, 1) AS letter FROM orders, range(1, 6) AS r(k)),
told AS (
  SELECT m.part, p.o AS filter_order, p.step, p.letter, m.n, m.good, m.bad, m.fails,
    contains(m.fails, p.letter) AS failed,
    length(translate(substr(p.o, 1, p.step - 1), m.fails, '')) = p.step - 1 AS there
  FROM masks m, places p),
steps AS (
  SELECT part, filter_order, step, letter, sum(CASE WHEN there AND NOT failed THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN there AND failed THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN NOT there AND failed THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = letter THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN there AND failed THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN there AND failed THEN bad ELSE 0 END) AS toxic_lost
  FROM told GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM steps
"""
