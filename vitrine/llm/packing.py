"""Packing of documents into sequences by cutting-stock column generation.

Documents are cut at multiples of the sequence length; what is left of each
is a piece shorter than a sequence.  The histogram of piece lengths (in steps
of ``QUANTUM`` tokens, so at most capacity / QUANTUM classes whatever the
input) is the demand of a cutting-stock problem: a linear program over
patterns, whose columns are priced by a knapsack dynamic program.  Patterns
are rounded down and the few pieces left over are packed first-fit.  Pieces
are ranked within their class in a distributed way, and rank r of a class goes
to the r-th place that the patterns have for that class.

Defined results: a null text is empty and has the end id only; repeated rows
are packed each on its own; an empty table gives an empty table; of the input
only id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.llm.bpe import slices
from vitrine.llm.common import map_batches, text_or_empty
from vitrine.llm.wordids import SLICE, word_ids
from vitrine.session import materialize

CAPACITY = 2048
QUANTUM = 8

_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut_pieces(docs: DataFrame, path: str, end_id: int = 1, capacity: int = CAPACITY,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece of at most ``capacity`` ids of a document."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = word_ids(path)
        texts = batch.column(1).to_pylist()
        rows, at = [], []
        for lo, hi in slices(texts, SLICE):
            for i, raw in enumerate(own.encode(texts[lo:hi]), lo):
                raw += end
                total = len(raw) // 4
                for start in range(0, total, capacity):
                    part = raw[4 * start:4 * (start + capacity)]
                    at.append(i)
                    rows.append((start, len(part) // 4, zlib.crc32(part), total))
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(at)), *[pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]],
            [f.split()[0] for f in _PIECE.split(", ")])
    cols = [F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")]
    return map_batches(docs, cols, run, _PIECE)


def best_pattern(value: np.ndarray, size: int) -> np.ndarray:
    """Counts of classes 1..size that fit into ``size`` with the highest value
    (unbounded knapsack, by capacity)."""
    best = np.zeros(size + 1)
    pick = np.zeros(size + 1, dtype=np.int64)
    for c in range(1, size + 1):
        gain = best[c - 1::-1][:c] + value[1:c + 1]
        k = int(np.argmax(gain))
        best[c], pick[c] = gain[k], k + 1
        if best[c - 1] >= best[c]:
            best[c], pick[c] = best[c - 1], 0
    pattern, c = np.zeros(size + 1, dtype=np.int64), size
    while c > 0:
        if pick[c]:
            pattern[pick[c]] += 1
        c -= pick[c] or 1
    return pattern


def first_basis(demand: np.ndarray) -> list[np.ndarray]:
    """A feasible basis: the largest class that is left, filled up greedily,
    until a class of the pattern runs out.  That class is in no later pattern,
    so the patterns are independent and as many as the classes."""
    size, left, basis = len(demand) - 1, demand.astype(float), []
    while (present := np.flatnonzero(left > 1e-9)).size:
        pattern, room = np.zeros(size + 1, dtype=np.int64), size
        while (fits := present[present <= room]).size:
            pattern[fits[-1]] += 1
            room -= int(fits[-1])
        inside = np.flatnonzero(pattern)
        times = (left[inside] / pattern[inside]).min()
        left -= times * pattern
        ended = inside[left[inside] <= 1e-9]
        left[ended] = 0
        basis.append(pattern)
        for c in ended[1:]:  # ended at the same time: patterns of their own, used no times
            alone = np.zeros(size + 1, dtype=np.int64)
            alone[c] = size // c
            basis.append(alone)
    return basis


def _times(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Matrix by vector, without BLAS: its threads have hung in a Spark driver."""
    return (matrix * vector).sum(axis=1)


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan with row pivots (a few hundred rows), without LAPACK."""
    n = len(matrix)
    work = np.hstack([matrix, np.eye(n)])
    for i in range(n):
        top = i + int(np.abs(work[i:, i]).argmax())
        work[[i, top]] = work[[top, i]]
        work[i] /= work[i, i]
        factor = work[:, i].copy()
        factor[i] = 0
        work -= factor[:, None] * work[i]
    return work[:, n:]


def solve(demand: np.ndarray, gap: float = 1e-4, max_rounds: int = 5_000) -> tuple[list[np.ndarray], np.ndarray]:
    """Patterns and their (fractional) counts: the LP relaxation of
    cutting-stock for ``demand[c]`` pieces of class c = 1..size, to a relative
    ``gap`` from the optimum (the most valuable pattern's excess over 1)."""
    size = len(demand) - 1
    classes = np.flatnonzero(demand > 0)
    m = len(classes)
    basis = first_basis(demand)
    inverse = _inverse(np.array([p[classes] for p in basis], dtype=float).T)
    counts = _times(inverse, demand[classes])
    for r in range(max_rounds):
        duals = inverse.sum(axis=0)
        value = np.zeros(size + 1)
        value[classes] = np.maximum(duals, 0)
        pattern = best_pattern(value, size)
        if (value * pattern).sum() <= 1 + gap:
            break
        column = _times(inverse, pattern[classes])
        ratio = np.full(m, np.inf)
        up = column > 1e-9
        ratio[up] = counts[up] / column[up]
        out = int(np.argmin(ratio))
        step = ratio[out]
        basis[out] = pattern
        counts = counts - step * column
        counts[out] = step
        row = inverse[out] / column[out]
        inverse = inverse - np.outer(column, row)
        inverse[out] = row
        if r % 200 == 199:  # keep rounding errors small
            matrix = np.array([p[classes] for p in basis], dtype=float).T
            inverse = _inverse(matrix)
            counts = _times(inverse, demand[classes])
    return basis, np.maximum(counts, 0)


def plan(demand: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """(pattern, times) that hold the whole demand."""
    if not demand.any():
        return []
    size = len(demand) - 1
    patterns, counts = solve(demand)
    left, out = demand.astype(np.int64).copy(), []
    for p, x in zip(patterns, counts, strict=True):
        n = int(x + 1e-6)
        if n:
            out.append((p, n))
            left = left - n * p
    left = np.maximum(left, 0)
    # what rounding has left, fewer than a pattern's pieces for each pattern
    while left.any():
        p, room = np.zeros(size + 1, dtype=np.int64), size
        for c in range(size, 0, -1):
            n = min(int(left[c]), room // c)
            p[c], room = n, room - n * c
        left -= p
        out.append((p, 1))
    return out


def pack(docs: DataFrame, path: str, end_id: int = 1, capacity: int = CAPACITY, quantum: int = QUANTUM,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of
    every piece.  Digests of the pieces are written once (checkpoint); only
    the histogram, capacity / quantum counts, comes to the driver."""
    spark = docs.sparkSession
    pieces = materialize(cut_pieces(docs, path, end_id, capacity, id_col, text_col))
    size = capacity // quantum
    pieces = pieces.withColumn("class", F.expr(f"cast(ceil(length / {quantum}) as int)"))
    demand = np.zeros(size + 1, dtype=np.int64)
    for row in pieces.groupBy("class").count().collect():
        demand[row["class"]] = row["count"]

    # places of each class, by rank: (first rank, places in a sequence, first sequence)
    places: dict[int, list[tuple[int, int, int]]] = {}
    used = np.zeros(size + 1, dtype=np.int64)
    sequences = 0
    for p, n in plan(demand):
        for c in np.flatnonzero(p).tolist():
            places.setdefault(c, []).append((int(used[c]), int(p[c]), sequences))
            used[c] += n * int(p[c])
        sequences += n
    tables = {c: np.array(t, dtype=np.int64).T for c, t in places.items()}

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        kind, rank = batch.column(5).to_numpy(), batch.column(6).to_numpy()
        sequence, slot = np.zeros(len(rank), dtype=np.int64), np.zeros(len(rank), dtype=np.int64)
        for c in np.unique(kind).tolist():
            first, per, base = tables[c]
            rows = np.flatnonzero(kind == c)
            at = np.searchsorted(first, rank[rows], side="right") - 1
            k = rank[rows] - first[at]
            sequence[rows] = base[at] + k // per[at]
            slot[rows] = k % per[at]
        return pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(sequence), pa.array(slot)],
                                          [*batch.schema.names[:6], "sequence_id", "slot"])

    blocks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocked = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "start"), F.lit(blocks)))
    before = (blocked.groupBy("class", "block").count()
              .withColumn("before", F.sum("count").over(
                  Window.partitionBy("class").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)))
              .select("class", "block", F.coalesce("before", F.lit(0)).alias("before")))
    own = Window.partitionBy("block", "class").orderBy("doc_id", "start", "ids_crc32", "length")
    ranked = (blocked.withColumn("own", F.row_number().over(own) - 1).join(before, ["class", "block"])
              .withColumn("rank", F.col("own") + F.col("before")))
    placed = map_batches(ranked, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "rank"], place,
                         f"{_PIECE}, class int, sequence_id long, slot long")
    inside = (Window.partitionBy("sequence_id").orderBy(F.desc("class"), "slot")
              .rowsBetween(Window.unboundedPreceding, -1))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
                         F.coalesce(F.sum("length").over(inside), F.lit(0)).alias("offset"))
