"""Distributed ranking helpers.

``global_rank`` gives every row its 1-based position in a total order
without a partition-less window: Spark range-partitions and sorts the rows
(hot keys spread over several partitions by the sampler), every row gets
``monotonically_increasing_id`` (partition index in the high bits), the
sorted frame is checkpointed so that the ids are stable, and per-partition
counts (one row per partition: a proven small side) are broadcast back as
offsets.

``first_k_excluding`` answers "the first k items of a ranked universe that
are not in the owner's own set" for many owners at once -- the shape of
both the zero-overlap neighbour fill and the popularity backfill.  It never
joins an owner to an unbounded prefix of the universe: the first k
survivors are always among the universe's first k items or among the k
successors of an excluded item, so each owner looks at k * (1 + |own set|)
candidates at most.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.session import materialize

_LOCAL_BITS = 33


def global_rank(df: DataFrame, order_cols: list[Column], rank_col: str = "rnk") -> DataFrame:
    """Append a dense 1-based rank following ``order_cols`` (must be a total order)."""
    cols = df.columns
    ordered = materialize(df.orderBy(*order_cols).withColumn("_mid", F.monotonically_increasing_id()))
    ordered = ordered.select(
        *cols,
        F.shiftright("_mid", _LOCAL_BITS).alias("_pid"),
        F.col("_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)).alias("_loc"),
    )
    counts = ordered.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (ordered.join(F.broadcast(offsets), "_pid")
            .select(*cols, (F.col("_off") + F.col("_loc") + 1).alias(rank_col)))


def running_total(df: DataFrame, order_cols: list[Column], weight: str, out: str = "before") -> DataFrame:
    """Append the sum of ``weight`` over all rows before each row in the total
    order of ``order_cols``: per sorted partition, plus what comes before the
    partition (one row per partition)."""
    cols = df.columns
    ordered = materialize(df.orderBy(*order_cols).withColumn("_mid", F.monotonically_increasing_id()))
    ordered = ordered.withColumn("_pid", F.shiftright("_mid", _LOCAL_BITS))
    totals = ordered.groupBy("_pid").agg(F.sum(weight).alias("_w"))
    earlier = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_pid", F.coalesce(F.sum("_w").over(earlier), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("_pid").orderBy("_mid").rowsBetween(Window.unboundedPreceding, -1)
    return (ordered.withColumn("_in", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
            .join(F.broadcast(offsets), "_pid")
            .select(*cols, (F.col("_off") + F.col("_in")).alias(out)))


def successors(ranked: DataFrame, key: str, k: int, rank_col: str = "rnk") -> DataFrame:
    """(src, cand, cand_rnk): the k items ranked right after each item."""
    want = ranked.select(
        F.col(key).alias("src"),
        F.explode(F.sequence(F.col(rank_col) + 1, F.col(rank_col) + k)).alias("cand_rnk"))
    target = ranked.select(F.col(rank_col).alias("cand_rnk"), F.col(key).alias("cand"))
    return want.join(target, "cand_rnk").select("src", "cand", "cand_rnk")


def head_items(ranked: DataFrame, key: str, k: int, rank_col: str = "rnk") -> list:
    """The first k items (k is a small constant: at most k rows reach the driver)."""
    rows = ranked.where(F.col(rank_col) <= k).select(key, rank_col).collect()
    return sorted(((r[1], r[0]) for r in rows))


def first_k_excluding(owners: DataFrame, excluded: DataFrame, ranked: DataFrame,
                      succ: DataFrame, head: list, key: str, k: int,
                      need_col: str | None = None) -> DataFrame:
    """For each owner, the first ``need`` (<= k) universe items not in its own set.

    owners:   (owner[, need])
    excluded: (owner, <key>)  the owner's own set (items of the universe)
    ranked:   (<key>, rnk)    the universe in its total order
    succ:     successors(ranked, key, k)
    head:     head_items(ranked, key, k)
    Returns (owner, <key>, rnk, pos) with pos = 1..need.
    """
    ex = excluded.select("owner", F.col(key).alias("src"))
    from_succ = ex.join(succ, "src").select("owner", "cand", "cand_rnk")
    head_arr = F.array(*[F.struct(F.lit(r).cast("long").alias("cand_rnk"),
                                  F.lit(v).alias("cand")) for r, v in head]) if head else None
    cands = from_succ
    if head_arr is not None:
        from_head = owners.select("owner", F.explode(head_arr).alias("h")).select(
            "owner", F.col("h.cand").alias("cand"), F.col("h.cand_rnk").alias("cand_rnk"))
        cands = cands.unionByName(from_head)
    kept = (cands.join(ex.select("owner", F.col("src").alias("cand")), ["owner", "cand"], "left_anti")
            .dropDuplicates(["owner", "cand"]))
    w = Window.partitionBy("owner").orderBy("cand_rnk")
    out = kept.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k)
    if need_col:
        out = out.join(owners.select("owner", need_col), "owner").where(F.col("pos") <= F.col(need_col))
    return out.select("owner", F.col("cand").alias(key), F.col("cand_rnk").alias("rnk"), "pos")


#: Packed blocks that travel together: bytes of a squad, and the squads that there are at least (if there are as many blocks).
SQUAD_BYTES = 32 << 20
MIN_SQUADS = 16
#: Tasks of blocks or pairs of squads, at most.  Small as packed blocks are, their work is not: dealt by a fixed number
#: of partitions, they are not put together by size.
PAIR_TASKS = 4096


def squad_size(n_blocks: int, block_bytes: float) -> int:
    """Blocks of a squad: bounded bytes, and enough squads for many tasks."""
    return max(1, min(int(SQUAD_BYTES / max(block_bytes, 1.0)), n_blocks // MIN_SQUADS))


def squad_pairs(left: DataFrame, right: DataFrame, pairs: DataFrame, size: int):
    """The packed blocks (block, ..) of the pairs (bl, br), cogrouped by pairs of
    squads: a block travels once per squad that it meets, not once per block.
    A left row's ``others`` are the right blocks that it is compared with."""
    def numbered(blocks: DataFrame, name: str, squad: str) -> DataFrame:
        if size == 1:
            return blocks.select(F.col("block").alias(name), F.col("block").alias(squad))
        ranked = global_rank(blocks.select("block"), [F.col("block")])
        return ranked.select(F.col("block").alias(name), F.floor((F.col("rnk") - 1) / size).alias(squad))
    cells = materialize(pairs.join(numbered(left, "bl", "gl"), "bl").join(numbered(right, "br", "gr"), "br"))
    meets = cells.groupBy("gl", "gr", F.col("bl").alias("block")).agg(F.collect_list("br").alias("others"))
    met = cells.select(F.col("gl").alias("gl"), F.col("gr").alias("gr"), F.col("br").alias("block")).distinct()
    a, b = left.join(meets, "block"), right.select(*[F.col(c).alias(c) for c in right.columns]).join(met, "block")
    tasks = max(1, min(cells.select("gl", "gr").distinct().count(), PAIR_TASKS))
    return a.repartition(tasks, "gl", "gr").groupBy("gl", "gr").cogroup(b.repartition(tasks, "gl", "gr").groupBy("gl", "gr"))


def by_block(blocks: DataFrame):
    """Packed blocks, grouped one by one."""
    return blocks.repartition(max(1, min(blocks.count(), PAIR_TASKS)), "block").groupBy("block")


class Nearest:
    """The k best rows per first column of frames (lk, rk, value), lower values
    first if ``ascending``, then by rk; an undefined value is the highest."""

    def __init__(self, names: list[str], k: int, ascending: bool, most: int = 500_000):
        self.names, self.k, self.ascending, self.most = names, k, ascending, most
        self.parts, self.rows = [], 0

    def add(self, frame: pd.DataFrame) -> None:
        self.parts.append(frame)
        self.rows += len(frame)
        if self.rows > self.most:
            self.parts = [self.best()]
            self.rows = len(self.parts[0])
            self.most = max(self.most, 2 * self.rows)

    def best(self) -> pd.DataFrame:
        if not self.parts:
            return pd.DataFrame({n: [] for n in self.names})
        left, right, value = self.names
        out = pd.concat(self.parts, ignore_index=True)
        out = out.assign(_v=out[value].astype(float).fillna(float("inf")))
        out = out.sort_values([left, "_v", right], ascending=[True, self.ascending, True])
        return out[out.groupby(left).cumcount() < self.k][self.names]
