"""Exact vector top-k (cosine or L2) as a blocked, distributed kernel.

Spark has no all-pairs nearest-neighbour operator, and a plain join on a
low-cardinality key (e.g. category) would put a third of all pairs in one
task.  The kernel therefore tiles both sides:

1. each side is cut into blocks of at most ``block_rows`` rows per group
   (group = optional equi key such as category); block counts come from a
   per-group count table (broadcast only under a checked bound);
2. every left block meets every right block of its group through
   ``cogroup(...).applyInPandas``: one NumPy GEMM per tile, with exact
   tie-breaking (score rounded to 9 dp, then key order) and an optional
   residual predicate (gender / price) evaluated on the tile;
3. each tile emits at most k rows per left key; a window whose limit is
   pushed below the shuffle merges the tiles.

Shuffled data is N_left x tiles x k rows, never N_left x N_right.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_BROADCAST_GROUPS = 1_000_000


def _stack(series: pd.Series) -> np.ndarray:
    if len(series) == 0:
        return np.zeros((0, 0))
    return np.stack([np.asarray(v, dtype=np.float64) for v in series.to_numpy()])


def _tile_scores(pl: pd.DataFrame, pr: pd.DataFrame, metric: str) -> np.ndarray:
    """Higher is nearer: cosine, or minus the squared L2 distance."""
    A, B = _stack(pl["_lv"]), _stack(pr["_rv"])
    if metric == "cosine":
        na = np.linalg.norm(A, axis=1)
        nb = np.linalg.norm(B, axis=1)
        A = A / np.where(na > 0, na, 1.0)[:, None]
        B = B / np.where(nb > 0, nb, 1.0)[:, None]
        S = A @ B.T
    else:  # negative squared L2, larger is nearer
        S = -((A * A).sum(1)[:, None] + (B * B).sum(1)[None, :] - 2.0 * (A @ B.T))
        S = np.minimum(S, 0.0)
    return np.round(S, 9) + 0.0


def _tile_topk(pl: pd.DataFrame, pr: pd.DataFrame, metric, k: int, exclude_same: bool,
               residual: Callable | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    S = metric(pl, pr) if callable(metric) else _tile_scores(pl, pr, metric)
    valid = np.ones(S.shape, dtype=bool)
    lk = pl["_lk"].to_numpy()
    rk = pr["_rk"].to_numpy()
    if exclude_same:
        valid &= lk[:, None] != rk[None, :]
    if residual is not None:
        valid &= residual(pl, pr)
    return _select_topk(np.where(valid, S, -np.inf), _key_order(rk), k)


def _key_order(keys: np.ndarray) -> np.ndarray:
    """Position of each key in ascending key order (the tie-break rank)."""
    return np.argsort(np.argsort(keys.astype(str) if keys.dtype == object else keys, kind="stable"),
                      kind="stable").astype(np.int64)


def _tile_topk_both(pl: pd.DataFrame, pr: pd.DataFrame, metric: str, k: int, exclude_same: bool,
                    both: bool) -> list:
    """Symmetric metric over one tile: top-k of the left rows among the right
    rows and, when ``both``, of the right rows among the left rows from the
    same score matrix (one GEMM answers an off-diagonal tile for both sides).
    Returns [(row_keys, col_keys, rows, cols, vals), ...]."""
    S = _tile_scores(pl, pr, metric)
    lk, rk = pl["_lk"].to_numpy(), pr["_rk"].to_numpy()
    if exclude_same:
        S = np.where(lk[:, None] != rk[None, :], S, -np.inf)
    out = [(lk, rk, *_select_topk(S, _key_order(rk), k))]
    if both:
        out.append((rk, lk, *_select_topk(np.ascontiguousarray(S.T), _key_order(lk), k)))
    return out


def _select_topk(S: np.ndarray, rord: np.ndarray, k: int):
    """Per row, the k best columns by (score desc, rord asc), -inf excluded.

    Exact under ties without sorting whole rows: the k-th best score t is
    found by partition; columns above t are all kept, and among the columns
    equal to t the smallest rord values fill the remaining slots.
    """
    n, m = S.shape
    kk = min(k, m)
    if n == 0 or kk == 0:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    t = -np.partition(-S, kk - 1, axis=1)[:, kk - 1]
    some = (S >= np.maximum(t, np.finfo(float).min)[:, None]) & (S < np.inf)
    if np.count_nonzero(some) <= 2 * kk * n:  # few ties
        rows, cols = np.nonzero(some)
        best = S[rows, cols]
        order = np.lexsort((rord[cols], -best, rows))
        order = np.sort(order[np.arange(len(rows)) - np.searchsorted(rows, rows) < kk])
        return rows[order], cols[order], best[order]
    above = S > t[:, None]
    n_above = above.sum(1)
    tie = (S == t[:, None]) & np.isfinite(t)[:, None]
    need = np.minimum(kk - n_above, tie.sum(1))
    sel = above & (S < np.inf)
    order = np.argsort(rord, kind="stable")
    for first in (order[:8 * kk], order):  # columns in the order of rord: often the first ones have enough ties
        number = np.cumsum(tie[:, first], axis=1, dtype=np.int32)
        if len(first) == m or (number[:, -1] >= need).all():
            sel[:, first] |= tie[:, first] & (number <= need[:, None])
            break
    rows, cols = np.nonzero(sel)
    return rows, cols, S[rows, cols]


def tile_cogroup(L: DataFrame, R: DataFrame, kernel: Callable, out_schema: T.StructType,
                 block_rows: int = 2048, grouped: bool = True, symmetric: bool = False) -> DataFrame:
    """Cut both sides into key blocks per group and run ``kernel(pl, pr)`` on
    every (left block, right block) pair of a group.

    L has columns _lk, _g (+ payload), R has _rk, _g (+ payload); several rows
    may share a key (they stay in one block).  Block counts come from per-group
    distinct-key counts (AQE picks broadcast from measured sizes); without
    groups they are two scalars.  ``symmetric`` (same keys on both sides, no groups):
    only block pairs bl <= br are formed and ``kernel(key, pl, pr)`` receives
    the block key so that an off-diagonal tile can answer for both sides.
    """
    spark = L.sparkSession
    if not grouped:
        nl = L.select(F.countDistinct("_lk")).first()[0]
        nr = R.select(F.countDistinct("_rk")).first()[0]
        if not nl or not nr:
            return spark.createDataFrame([], out_schema)
        nbl, nbr = max(1, math.ceil(nl / block_rows)), max(1, math.ceil(nr / block_rows))
        if symmetric:
            nb = max(nbl, nbr)
            lb = F.pmod(F.xxhash64("_lk"), F.lit(nb)).cast("int")
            rb = F.pmod(F.xxhash64("_rk"), F.lit(nb)).cast("int")
            L = L.select("*", lb.alias("_bl")).select(
                "*", F.explode(F.sequence(F.col("_bl"), F.lit(nb - 1))).alias("_br"))
            R = R.select("*", rb.alias("_br")).select(
                "*", F.explode(F.sequence(F.lit(0), F.col("_br"))).alias("_bl"))
            return (L.groupBy("_g", "_bl", "_br").cogroup(R.groupBy("_g", "_bl", "_br"))
                    .applyInPandas(kernel, out_schema))
        L = L.select("*", F.pmod(F.xxhash64("_lk"), F.lit(nbl)).cast("int").alias("_bl"),
                     F.explode(F.sequence(F.lit(0), F.lit(nbr - 1))).alias("_br"))
        R = R.select("*", F.explode(F.sequence(F.lit(0), F.lit(nbl - 1))).alias("_bl"),
                     F.pmod(F.xxhash64("_rk"), F.lit(nbr)).cast("int").alias("_br"))
        return (L.groupBy("_g", "_bl", "_br").cogroup(R.groupBy("_g", "_bl", "_br"))
                .applyInPandas(kernel, out_schema))
    nl = L.groupBy("_g").agg(F.countDistinct("_lk").alias("_nl"))
    nr = R.groupBy("_g").agg(F.countDistinct("_rk").alias("_nr"))
    # one row per group; AQE broadcasts it at runtime when its measured size is
    # under the threshold, else it stays a shuffle join (no driver-side count)
    sizes = nl.join(nr, "_g").select(
        "_g", F.greatest(F.lit(1), F.ceil(F.col("_nl") / block_rows)).cast("int").alias("_nbl"),
        F.greatest(F.lit(1), F.ceil(F.col("_nr") / block_rows)).cast("int").alias("_nbr"))
    L = L.join(sizes, "_g").select(
        "*", F.pmod(F.xxhash64("_lk"), F.col("_nbl")).cast("int").alias("_bl"),
        F.explode(F.sequence(F.lit(0), F.col("_nbr") - 1)).alias("_br")).drop("_nbl", "_nbr")
    R = R.join(sizes, "_g").select(
        "*", F.explode(F.sequence(F.lit(0), F.col("_nbl") - 1)).alias("_bl"),
        F.pmod(F.xxhash64("_rk"), F.col("_nbr")).cast("int").alias("_br")).drop("_nbl", "_nbr")
    return (L.groupBy("_g", "_bl", "_br").cogroup(R.groupBy("_g", "_bl", "_br"))
            .applyInPandas(kernel, out_schema))


def merge_tiles(tiles: DataFrame, k: int) -> DataFrame:
    """Global top-k per left key from per-tile top-k rows (_lk, _g, _rk, _s)."""
    w = Window.partitionBy("_lk", "_g").orderBy(F.col("_s").desc(), F.col("_rk").asc())
    return tiles.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k)


def blocked_topk(left: DataFrame, right: DataFrame, *, lkey: str, rkey: str, k: int,
                 lvec: str = "vector", rvec: str = "vector", group: str | None = None,
                 metric: str = "cosine", exclude_same_key: bool = False,
                 residual: Callable | None = None, lextra: tuple = (), rextra: tuple = (),
                 block_rows: int = 2048, score_fn: Callable | None = None,
                 symmetric: bool = False) -> DataFrame:
    """Top-k right rows per left row (per group).  Returns
    (left_key[, group], right_key, score, pos): score = cosine, or the squared
    L2 distance for 'l2' (rounded to 9 dp, the precision ties are decided at).

    ``symmetric``: left and right are the same keyed vector set (no group,
    no residual, built-in metric); only tiles bl <= br are formed and each
    off-diagonal tile answers for both of its blocks, which halves the
    shuffled vectors and the GEMM work of the all-pairs step."""
    if symmetric and (group or residual or score_fn or lextra or rextra):
        raise ValueError("symmetric tiles need one ungrouped set and a built-in metric")
    gexpr = F.col(group) if group else F.lit(0)
    lv = [F.col(lvec).alias("_lv")] if lvec else []
    rv = [F.col(rvec).alias("_rv")] if rvec else []
    L = left.select(F.col(lkey).alias("_lk"), gexpr.alias("_g"), *lv, *lextra)
    R = right.select(F.col(rkey).alias("_rk"), gexpr.alias("_g"), *rv, *rextra)
    out_schema = T.StructType([
        T.StructField("_lk", L.schema["_lk"].dataType), T.StructField("_g", L.schema["_g"].dataType),
        T.StructField("_rk", R.schema["_rk"].dataType), T.StructField("_s", T.DoubleType())])

    def kernel(pl: pd.DataFrame, pr: pd.DataFrame) -> pd.DataFrame:
        if len(pl) == 0 or len(pr) == 0:
            return pd.DataFrame({"_lk": [], "_g": [], "_rk": [], "_s": []})
        rows, cols, vals = _tile_topk(pl, pr, score_fn or metric, k, exclude_same_key, residual)
        return pd.DataFrame({"_lk": pl["_lk"].to_numpy()[rows], "_g": pl["_g"].to_numpy()[rows],
                             "_rk": pr["_rk"].to_numpy()[cols], "_s": vals})

    def sym_kernel(key, pl: pd.DataFrame, pr: pd.DataFrame) -> pd.DataFrame:
        if len(pl) == 0 or len(pr) == 0:
            return pd.DataFrame({"_lk": [], "_g": [], "_rk": [], "_s": []})
        parts = [pd.DataFrame({"_lk": a[rows], "_g": np.zeros(len(rows), dtype=np.int32),
                               "_rk": b[cols], "_s": vals})
                 for a, b, rows, cols, vals in _tile_topk_both(pl, pr, metric, k, exclude_same_key,
                                                               both=key[1] != key[2])]
        return pd.concat(parts, ignore_index=True)

    tiles = (tile_cogroup(L, R, sym_kernel, out_schema, block_rows, grouped=False, symmetric=True)
             if symmetric else
             tile_cogroup(L, R, kernel, out_schema, block_rows, grouped=group is not None))
    top = merge_tiles(tiles, k)
    score = (-F.col("_s") + F.lit(0.0)) if metric in ("l2", "neg") else F.col("_s")
    cols = [F.col("_lk").alias("left_key"), F.col("_rk").alias("right_key"),
            F.round(score, 9).alias("score"), "pos"]
    if group:
        cols.insert(1, F.col("_g").alias(group))
    return top.select(*cols)


def cosine_expr(a, b):
    """Cosine of two array<double> columns (0 when either is the zero vector)."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    na = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))
    nb = F.sqrt(F.aggregate(b, F.lit(0.0), lambda s, x: s + x * x))
    return F.when((na > 0) & (nb > 0), dot / (na * nb)).otherwise(F.lit(0.0))


def similar_products(vectors: DataFrame, k: int = 6, block_rows: int = 2048) -> DataFrame:
    """Six most similar products, the product itself excluded
    (= ranks 2-7 of the reference's order with self first).

    X17: a vector with a NaN counts as zero in the ranking, and its
    similarities, to it and of it, are NULL."""
    from vitrine.operators.vectorblocks import self_topk
    odd = F.exists("vector", F.isnan)
    clean = vectors.select("id", F.when(odd, F.transform("vector", lambda x: F.lit(0.0)))
                           .otherwise(F.col("vector")).alias("vector"))
    top = self_topk(clean, "id", k, exclude_self=True, block_rows=block_rows)
    undefined = vectors.where(odd).select(F.col("id").alias("odd_id"))
    a, b = undefined.select(F.col("odd_id").alias("odd_left")), undefined.select(F.col("odd_id").alias("odd_right"))
    top = (top.join(a, F.col("left_key") == F.col("odd_left"), "left")
           .join(b, F.col("right_key") == F.col("odd_right"), "left"))
    score = F.when(F.coalesce("odd_left", "odd_right").isNull(), F.col("score"))
    return top.select(F.col("left_key").alias("product_id"), F.col("pos").cast("long").alias("rank"),
                      F.col("right_key").alias("similar_id"), score.alias("score"))
