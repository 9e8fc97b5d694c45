import random

import pytest
from pyspark.sql import functions as F

from tests.bruteforce import matrix as bf_matrix
from tests.bruteforce import recommend as bf_recommend
from tests.conftest import inter_df
from vitrine.operators import matrix as M
from vitrine.operators import neighbors as N


def recs_of(spark, rows, mode="tile", params=N.CFParams()):
    inter = inter_df(spark, rows)
    m = M.user_product_matrix(inter)
    old = N.user_neighbors

    def forced(matrix, params=params, users_ranked=None, mode_=mode, checkpoint=True, **kw):
        return old(matrix, params, users_ranked, mode=mode_, checkpoint=checkpoint)
    N.user_neighbors = forced
    try:
        res = N.recommend_users(inter, params)
        got = res.recs.collect()
    finally:
        N.user_neighbors = old
    out = {}
    for r in got:
        out.setdefault(r["user_id"], []).append((r["rank"], r["product_id"], r["score"], r["source"]))
    return {u: sorted(v) for u, v in out.items()}, m


def test_duplicate_and_cancelling_cells(spark):
    rows = [(1, "a", 2), (1, "a", 2), (1, "a", 1), (2, "b", 3), (2, "b", -3), (3, "c", None), (None, "c", 1)]
    m = {(r["user_id"], r["product_id"]): r["score"]
         for r in M.user_product_matrix(inter_df(spark, rows)).collect()}
    assert m == {(1, "a"): 3, (2, "b"): 0, (3, "c"): 0}
    assert m == bf_matrix(rows)


def test_fewer_users_than_five_and_backfill(spark):
    rows = [(1, "a", 1), (1, "b", 2), (2, "a", 1), (2, "c", 4), (3, "d", 2)]
    got, _ = recs_of(spark, rows)
    want, k = bf_recommend(rows)
    assert k == 3
    assert got == {u: [tuple(x) for x in v] for u, v in want.items() if v}


def test_negative_own_score_never_recommended(spark):
    rows = [(1, "b", -3), (1, "a", 1), (2, "a", 1), (2, "b", 4), (3, "b", 2), (3, "c", 1)]
    got, _ = recs_of(spark, rows)
    assert all(p != "b" for _, p, _, _ in got.get(1, []))
    assert [p for _, p, _, _ in got[1]] == ["c"]
    want, _ = bf_recommend(rows)
    assert got == {u: [tuple(x) for x in v] for u, v in want.items() if v}


def test_all_zero_user_gets_smallest_ids(spark):
    rows = [(9, "a", 3), (9, "a", -3)] + [(u, "x", 1) for u in range(1, 7)]
    inter = inter_df(spark, rows)
    m = M.user_product_matrix(inter)
    for mode in ("tile", "sparse"):
        nb = N.user_neighbors(m, mode=mode).where(F.col("user_id") == 9).orderBy("nrank").collect()
        assert [r["neighbor_id"] for r in nb] == [1, 2, 3, 4, 5]
        assert all(r["dist"] == 1.0 for r in nb)


@pytest.mark.parametrize("mode", ["tile", "sparse"])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_bruteforce(spark, mode, seed):
    rnd = random.Random(seed)
    users = list(range(1, 25))
    items = [f"p{i}" for i in range(12)]
    codes = [1, 2, 3, 4, -3, None]
    rows = [(rnd.choice(users), rnd.choice(items), rnd.choice(codes)) for _ in range(70)]
    rows += [(99, "solo", 1)]          # zero-overlap user
    rows += [(98, "p0", 3), (98, "p0", -3)]  # all-zero user
    got, _ = recs_of(spark, rows, mode=mode)
    want, _ = bf_recommend(rows)
    assert got == {u: [tuple(x) for x in v] for u, v in want.items() if v}


def test_salted_pair_join_equals_unsalted(spark):
    rnd = random.Random(7)
    rows = [(rnd.randrange(40), f"p{rnd.randrange(5)}", rnd.choice([1, 2, -3])) for _ in range(200)]
    m = M.user_product_matrix(inter_df(spark, rows))
    a = sorted(map(tuple, N.user_pairs(m, N.CFParams(block_size=3)).collect()))
    b = sorted(map(tuple, N.user_pairs(m, N.CFParams()).collect()))
    assert a == b and len(a) > 100


def test_result_independent_of_shuffle_partitions(spark):
    rnd = random.Random(11)
    rows = [(rnd.randrange(30), f"p{rnd.randrange(15)}", rnd.choice([1, 2, 4])) for _ in range(150)]
    base, _ = recs_of(spark, rows, mode="sparse")
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            again, _ = recs_of(spark, rows, mode="sparse")
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
        assert again == base


def test_properties_on_events(spark):
    from tests.conftest import SF001
    from vitrine.sources import fixtures as FX
    res = N.recommend_users(FX.interactions(spark, SF001))
    recs = res.recs
    own = res.matrix.where(F.col("score") != 0).select("user_id", "product_id")
    assert recs.join(own, ["user_id", "product_id"]).count() == 0
    per = recs.groupBy("user_id").agg(F.count("*").alias("n"), F.countDistinct("product_id").alias("d"),
                                      F.max("rank").alias("mx")).collect()
    assert all(r["n"] == r["d"] == r["mx"] <= 8 for r in per)


@pytest.mark.parametrize("share", [0, 256, 10 ** 9])
@pytest.mark.parametrize("slots", [7, 2048])
def test_tile_kernel_branches_and_blocks(spark, share, slots, monkeypatch):
    from vitrine.operators import userblocks as UB
    rnd = random.Random(5)
    rows = [(rnd.randrange(60), f"p{rnd.randrange(30)}", rnd.choice([1, 2, -1, 4])) for _ in range(260)]
    rows += [(200, "q", 3), (200, "q", -3)]
    m = M.user_product_matrix(inter_df(spark, rows))
    # share 0: all products are expanded; huge: all go through the matrix product
    monkeypatch.setattr(UB, "GEMM_SHARE", share)
    monkeypatch.setattr(UB, "EXPANSION", 13)
    tiled = sorted(map(tuple, N.tile_user_neighbors(m, 5, block_rows=slots).collect()))
    sparse = sorted(map(tuple, N.sparse_user_neighbors(m, 5, N.CFParams()).collect()))
    assert tiled == sparse


def clustered(seed, groups, users, items):
    """Users of a group share products that no other group has; negative and cancelled cells too."""
    rnd = random.Random(seed)
    rows = [(g * 1000 + rnd.randrange(users), f"g{g}-{rnd.randrange(items)}", rnd.choice([1, 2, 3, -1]))
            for g in range(groups) for _ in range(users * 6)]
    return rows + [(g * 1000, f"g{g}-x", c) for g in range(groups) for c in (2, -2)]


def test_pruned_blocks_equal_join(spark):
    """Blocks that no user can profit from are not compared, and nothing is lost."""
    from vitrine.operators import userblocks as UB
    m = M.user_product_matrix(inter_df(spark, clustered(3, 12, 20, 15))).cache()
    blocks = UB.pack(m, 10)
    n = blocks.count()
    opened = UB.open_pairs(blocks, UB._settle(blocks, 5)).count()
    assert n > 15 and opened < (n - 1) * (n - 2) / 4
    tiled = sorted(map(tuple, N.tile_user_neighbors(m, 5, block_rows=10).collect()))
    sparse = sorted(map(tuple, N.sparse_user_neighbors(m, 5, N.CFParams()).collect()))
    assert tiled == sparse


@pytest.mark.parametrize("seed", [4, 5])
def test_users_without_overlap_and_with_opposite_scores(spark, seed):
    rnd = random.Random(seed)
    rows = [(u, f"own{u}", 1) for u in range(40)] + [(rnd.randrange(40), "all", rnd.choice([1, -3])) for _ in range(60)]
    m = M.user_product_matrix(inter_df(spark, rows))
    tiled = sorted(map(tuple, N.tile_user_neighbors(m, 5, block_rows=3).collect()))
    sparse = sorted(map(tuple, N.sparse_user_neighbors(m, 5, N.CFParams()).collect()))
    assert tiled == sparse


def test_tile_memory_at_full_blocks():
    """2048 users x 400 cells over 5,000 products: bounded memory, right dots."""
    import subprocess
    import sys
    code = """
import resource, numpy as np
from vitrine.operators import userblocks as UB
def block(seed):
    rng = np.random.default_rng(seed)
    who = np.repeat(np.arange(2048), 400)
    col = np.concatenate([rng.choice(5000, 400, replace=False) for _ in range(2048)])
    order = np.lexsort((who, col))
    starts = np.concatenate(([0], np.cumsum(np.bincount(col, minlength=5000))))
    return UB.Block({"block": seed, "users": (np.arange(2048) + 5000 * seed).astype("<i8").tobytes(),
        "products": np.array([f"p{i:05d}" for i in range(5000)], dtype=object), "starts": starts.astype("<i8").tobytes(),
        "who": who[order].astype("<i4").tobytes(), "score": rng.integers(1, 5, len(who)).astype("<f8").tobytes()})
a, b = block(0), block(1)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
UB.tile_top(a, b, 5, True)
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True)
    assert float(out.stdout) < 1000


def test_tile_pairs_equal_join_pairs(spark):
    rnd = random.Random(9)
    rows = [(rnd.randrange(50), f"p{rnd.randrange(20)}", rnd.choice([1, 2, -3, 4])) for _ in range(220)]
    m = M.user_product_matrix(inter_df(spark, rows))
    a = sorted(map(tuple, N.user_similarity(m, mode="tile").collect()))
    b = sorted(map(tuple, N.user_similarity(m, mode="sparse").collect()))
    assert a == b and len(a) > 50
