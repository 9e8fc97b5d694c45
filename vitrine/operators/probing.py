"""Approximate L2 top-k by multi-probe hashing that widens until it has
enough candidates, with exact re-ranking.

A vector's bucket in a table is the signs of its products with the table's
planes, which are fixed by a formula.  A query looks into its own bucket and
then into others, in the order of the squared margins it would have had to
cross (then by number), until the buckets of each table hold at least
``want`` documents, or all of them: sizes of buckets, at most tables x 2^bits
numbers, decide that before any distance is computed.  So a query always
gets k documents if there are k, with ``want`` >= k.

Candidates are compared by the zoned kernel with the bucket as group: a tile
returns k documents a query, so a bucket that holds a third of all documents
is cut into blocks like any other group and no pair of rows is emitted.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.operators.vectorblocks import zoned_topk
from vitrine.session import materialize

TABLES = 4
#: Documents per bucket that the number of planes aims at, and planes at most (2^16 sizes a table).
BUCKET_ROWS = 128
MAX_BITS = 16
#: Candidates that each table must offer.
WANT = 256
#: Queries that are widened at a time: each gives a row per bucket, with its vector.
SLICE = 512


def plane(table: int, bit: int, dim: int) -> np.ndarray:
    """Components of a plane: sines of a quadratic sequence."""
    i = np.arange(1, dim + 1)
    return np.round(np.sin((31 * table + 7 * bit + 3) * i + 0.5 * i * i), 6)


def bits_for(n: int) -> int:
    return max(0, min(MAX_BITS, int(math.log2(max(n, 1) / BUCKET_ROWS)))) if n > BUCKET_ROWS else 0


def products(vectors: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """Products with all planes: rows x tables x bits."""
    dim = vectors.shape[1]
    planes = np.array([plane(t, b, dim) for t in range(tables) for b in range(bits)]).reshape(tables * bits, dim)
    return (vectors @ planes.T).reshape(len(vectors), tables, bits)


def probes(margins: np.ndarray, sizes: np.ndarray, want: int) -> list[int]:
    """Buckets of one table in the order of (sum of the squared margins of the crossed planes,
    bucket), until they hold ``want`` documents."""
    own = int((margins >= 0) @ (1 << np.arange(len(margins)))) if len(margins) else 0
    order = np.argsort(margins * margins, kind="stable")
    cost, flip = (margins * margins)[order], [1 << int(b) for b in order]
    heap, out, held, last, tied = [(0.0, own, -1)], [], 0, None, []
    # sets of crossed planes by rising cost: from each, move its last plane on or add the next one
    while heap and held < want:
        c, bucket, top = heapq.heappop(heap)
        out.append(bucket)
        held += int(sizes[bucket])
        if top + 1 < len(cost):
            heapq.heappush(heap, (c + cost[top + 1], bucket ^ flip[top + 1], top + 1))
            if top >= 0:
                heapq.heappush(heap, (c - cost[top] + cost[top + 1], bucket ^ flip[top] ^ flip[top + 1], top + 1))
    return out


def probe_neighbors(queries: DataFrame, corpus: DataFrame, k: int, tables: int = TABLES, want: int = WANT,
                    bits: int | None = None) -> DataFrame:
    """(qid, id, l2, pos): k documents of every query, the nearest of its
    candidates by squared L2 (9 dp), then id.

    queries: (qid, vector); corpus: (id, vector)."""
    n = corpus.count()
    bits = bits_for(n) if bits is None else bits
    qtype, ctype = queries.schema["qid"].dataType.simpleString(), corpus.schema["id"].dataType.simpleString()

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                signs = products(np.stack(rows["vector"].to_numpy()), tables, bits) >= 0
                yield pd.DataFrame({"id": rows["id"], "vector": rows["vector"],
                                    "buckets": list((signs @ (1 << np.arange(bits)) if bits else signs.sum(axis=2)).astype(np.int64))})
    index = materialize(corpus.select("id", "vector").mapInPandas(place, f"id {ctype}, vector array<double>, buckets array<long>")
                        .select("id", "vector", F.posexplode("buckets").alias("table", "bucket")))
    sizes = np.zeros((tables, 1 << bits), dtype=np.int64)  # at most tables x 2^MAX_BITS
    for r in index.groupBy("table", "bucket").count().collect():
        sizes[r["table"], r["bucket"]] = r["count"]

    def widen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in (b[lo:lo + SLICE] for b in batches for lo in range(0, len(b), SLICE)):
            margins = products(np.stack(rows["vector"].to_numpy()), tables, bits)
            found = [[(t, b) for t in range(tables) for b in probes(m[t], sizes[t], max(want, k)) if sizes[t, b]]
                     for m in margins]
            at = np.repeat(np.arange(len(rows)), [len(f) for f in found])
            flat = np.array([x for f in found for x in f], dtype=np.int64).reshape(-1, 2)
            yield pd.DataFrame({"qid": rows["qid"].to_numpy()[at], "vector": rows["vector"].to_numpy()[at],
                                "table": flat[:, 0], "bucket": flat[:, 1]})
    asked = queries.select("qid", "vector").mapInPandas(
        widen, f"qid {qtype}, vector array<double>, table long, bucket long")
    group = F.concat_ws("/", "table", "bucket").alias("group")
    none = F.lit(None).cast("double")
    # a query meets a document in several tables: k per bucket, then the k best different ones
    hits = zoned_groups_topk(asked.select("qid", group, F.col("vector").alias("v"), none.alias("ceiling")),
                             index.select(F.col("id").alias("key"), group, F.col("vector").alias("v"), none.alias("price")), k)
    w = Window.partitionBy("qid").orderBy("l2", "id")
    return hits.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k)


def zoned_groups_topk(requests: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """Different (qid, id, l2) of the k nearest documents in each group that a query asks."""
    qtype = requests.schema["qid"].dataType
    keyed = requests.withColumn("key", F.to_json(F.struct("qid", "group"))).drop("qid")
    top = zoned_topk(keyed, docs, k)
    return top.select(F.from_json("left_key", f"qid {qtype.simpleString()}")["qid"].alias("qid"),
                      F.col("right_key").alias("id"), F.col("score").alias("l2")).distinct()


def recall(approx: DataFrame, exact: DataFrame) -> float:
    """Share of the exact (qid, l2) places that the approximate result reaches
    (equally distant documents stand for each other)."""
    a = approx.select("qid", "pos", F.col("l2").alias("a"))
    e = exact.select("qid", "pos", F.col("l2").alias("e"))
    hit = F.when(F.col("a") <= F.col("e") + 1e-9, 1.0).otherwise(0.0)
    return e.join(a, ["qid", "pos"], "left").agg(F.avg(hit)).first()[0] or 0.0
