"""Steps that held, kept or compared more than they need."""
import numpy as np
import pytest

from vitrine.operators import embedding as E
from vitrine.operators import ranking as RK
from vitrine.operators import text as TX
from vitrine.operators import userblocks as UB
from vitrine.operators import vectorblocks as VB
from vitrine.operators import vectors as V


def test_blocks_of_vectors_are_not_broadcast(spark, monkeypatch):
    """few rows, but long ones: joined, they would go through the driver."""
    for name, value in (("BLOCK_WORDS", 4), ("GROUP_BLOCKS", 2)):
        monkeypatch.setattr(E, name, value)
    rng = np.random.default_rng(3)
    weights, share = rng.normal(size=(20, 20)).astype("<f4"), rng.normal(size=20)
    vectors = rng.normal(size=(20, 3)).astype("<f4")
    rows, cols = (x.astype("<i4").ravel() for x in np.indices((4, 4)))
    tiles = spark.createDataFrame(
        [(i, j, rows.tobytes(), cols.tobytes(), np.ascontiguousarray(weights[4 * i:4 * i + 4, 4 * j:4 * j + 4]).tobytes())
         for i in range(5) for j in range(5) if i != 3], "bi long, bj long, rows binary, cols binary, weights binary")
    sums = spark.createDataFrame([(i, share[4 * i:4 * i + 4].astype("<f8").tobytes()) for i in range(5)], "block long, sums binary")
    held = spark.createDataFrame([(i, vectors[4 * i:4 * i + 4].tobytes()) for i in range(5)], "block long, data binary")
    product = E._times(tiles, sums, held, 3, 5)
    assert "Join" not in product._jdf.queryExecution().optimizedPlan().toString()
    want = np.maximum(weights - share[None, :], 0) @ vectors
    got = {r["block"]: np.frombuffer(r["data"], dtype="<f4").reshape(-1, 3) for r in product.collect()}
    assert sorted(got) == [0, 1, 2, 4]
    for i, y in got.items():
        assert np.allclose(y, want[4 * i:4 * i + 4], atol=1e-4)


def test_packed_blocks_hold_few_bytes_a_cell(spark):
    """a block travels once per squad; names, wide numbers and offsets took over 30 bytes a cell."""
    rng = np.random.default_rng(4)
    rows = [(u, f"product-{p}", int(rng.choice([1, 2, -1]))) for u in range(400) for p in rng.choice(3000, 40, replace=False)]
    rows += [(7, "product-1", 2 ** 40), (900, "cancelled", 0)]
    matrix = spark.createDataFrame(rows, "user_id long, product_id string, score long").dropDuplicates(["user_id", "product_id"])
    packed = [r.asDict() for r in UB.pack(matrix, 100).drop("summary").collect()]
    assert len(packed) == 5 and sum(len(x) for r in packed for x in r.values() if not isinstance(x, int)) < 6 * len(rows)
    number = {p: i + 1 for i, p in enumerate(sorted({p for _, p, s in rows if s}))}
    got = set()
    for block in map(UB.unpacked, packed):
        column = np.repeat(block.products, np.diff(block.starts))
        got |= set(zip(block.users[block.who].tolist(), column.tolist(), block.score.tolist(), strict=True))
    assert got == {(r["user_id"], number[r["product_id"]], float(r["score"])) for r in matrix.collect() if r["score"]}


def test_arrays_are_narrowed_without_loss():
    for x in ([], [1, -2], [300], [2 ** 40], [-2.0 ** 62], [0.5, 2.0 ** 70], [1e300, 3.0]):
        x = np.array(x, dtype=float)
        assert np.array_equal(UB.widened(UB.narrowed(x), "<f8"), x)


@pytest.mark.parametrize("digits", [1, 9])
def test_vector_tiles_score_few_pairs_exactly(monkeypatch, digits):
    """a tile scores only pairs that can reach a bar in double, and finds what brute force finds: ties, copies,
    zero and undefined vectors; what k earlier ones are ahead of may be left out."""
    rng = np.random.default_rng(5)
    m = VB.unit(rng.normal(size=(900, 6)).round(digits))
    m[7], m[350], m[420], m[640], m[650] = m[20], m[20], m[20], np.nan, 0.0
    keys, k = np.array([f"v{i:03d}" for i in rng.permutation(900)], dtype=object), 4
    bars = np.sort(np.nan_to_num(VB.cosine(m, m), nan=-2.0), axis=1)[:, -40]
    cuts = [(0, 300), (300, 600), (600, 900)]
    monkeypatch.setattr(VB, "cosine", None)  # no matrix of all pairs
    monkeypatch.setattr(VB, "top_of", None)
    a, *others = [VB.Side(keys[x:y], m[x:y].tobytes(), bars[x:y].tobytes(), k) for x, y in cuts]
    got, seen = {}, 0
    for b in others:
        for lk, rk, s in VB.side_top(a, b):
            seen += len(lk)
            for x, y, v in zip(lk, rk, s, strict=True):
                got.setdefault(x, []).append((-v, y))
    exact = np.round(m @ m.T, 9) + 0.0
    for i, key in enumerate(keys):
        theirs = range(300, 900) if i < 300 else range(300)
        want = sorted((-exact[i, j], keys[j]) for j in theirs if exact[i, j] >= bars[i])[:k]
        assert sorted(got.get(key, []))[:k] == want
    assert 300 < seen < 900 * 2 * k


def test_best_columns_equal_sorting():
    """Few ties and many, rows with excluded and undefined scores."""
    rng = np.random.default_rng(6)
    for digits in (0, 1, 9):
        scores = rng.normal(size=(60, 40)).round(digits) + 0.0
        scores[rng.random(scores.shape) < 0.3] = -np.inf
        scores[0], scores[1, 1:] = -np.inf, -np.inf
        scores[2:30] = np.where(rng.random((28, 40)) < 0.9, 0.0, scores[2:30])
        order = rng.permutation(40)
        rows, cols, best = V._select_topk(scores, order, 5)
        for i in range(60):
            want = sorted(np.flatnonzero(np.isfinite(scores[i])), key=lambda j: (-scores[i, j], order[j]))[:5]
            assert cols[rows == i].tolist() == sorted(want) and np.array_equal(best[rows == i], scores[i, sorted(want)])


def test_bounds_are_not_dealt_by_stripe(spark):
    """a stripe's summaries meet every block; dealt by stripe, all blocks of it were in one task."""
    m = spark.createDataFrame([(u, f"p{u % 7}", 1 + u % 3) for u in range(40)], "user_id long, product_id string, score long")
    v = spark.createDataFrame([(f"{i}", [float(i % 5), 1.0]) for i in range(40)], "id string, vector array<double>")
    a = UB.pack(m, 10)
    b = VB.vector_blocks(v, "id", "vector", 10)
    for pairs in (UB.open_pairs(a, UB._settle(a, 3)), VB.open_pairs(b, VB._settle(b, v.schema["id"].dataType, 3, True))):
        plan = pairs._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInPandas" in plan and "FlatMapGroups" not in plan


@pytest.mark.parametrize("kind", ["long", "string"])
def test_hits_travel_once_and_packed(spark, kind):
    """(id, vector) pairs are packed where they are made; before, they were gathered by id first. Several
    blocks and chunks, ids in several batches, repeated and unknown vectors, null ids."""
    rng = np.random.default_rng(7)
    rows = [(None if i == 3 else int(i) if kind == "long" else f"n{i}", int(v), int(c)) for i, v, c in
            zip(rng.integers(0, 60, 900), rng.integers(0, 50, 900), rng.integers(1, 400, 900), strict=True)]
    hits = spark.createDataFrame(rows, f"id {kind}, vec_id long, cnt long").repartition(3)
    table = {i: rng.normal(size=4) for i in range(45)}
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in table.items()], "vec_id long, vector array<double>")
    sums = TX.tiled_sums(hits, vectors, 900, 4, chunk_vectors=16, tile_hits=60, pack_hits=100)
    assert "collect_list" not in sums._jdf.queryExecution().optimizedPlan().toString()
    want = {}
    for i, v, c in rows:
        if i is not None and v in table:
            old = want.get(i, (np.zeros(4), 0.0, 0))
            want[i] = (old[0] + c * table[v], old[1] + c, old[2] + c)
    got = {r["id"]: r for r in sums.collect()}
    assert got.keys() == want.keys() and len(got) == 59
    for i, (total, weight, tokens) in want.items():
        assert np.allclose(got[i]["sums"], total) and (got[i]["weight"], got[i]["tokens"]) == (weight, tokens)


def test_small_blocks_are_not_put_into_one_task(spark):
    """packed blocks are a few KB; put together by size, all of their work was in one task."""
    blocks = spark.range(40).selectExpr("id as block", "id * 2 as v")
    pairs = spark.range(40).selectExpr("id as bl", "39 - id as br")
    single = RK.by_block(blocks).applyInPandas(lambda rows: rows, blocks.schema)
    met = RK.squad_pairs(blocks, blocks, pairs, 4).applyInPandas(lambda a, b: a[["block", "v"]], blocks.schema)
    for done in (single, met):
        assert done.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).filter(lambda n: n > 0).count() > 6
        assert sorted(r["block"] for r in done.collect()) == list(range(40))
