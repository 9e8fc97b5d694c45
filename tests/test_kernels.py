"""Pruned kernels, probing, embeddings, phrases, streaming state and versions."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF001, inter_df
from tests.test_text_vectors import brute_topk
from vitrine.operators import matrix as M
from vitrine.operators import vectorblocks as VB
from vitrine.session import scratch_path, ship_package


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


def vector_rows(seed=1, groups=6, size=25, dim=8):
    """Clusters on the sphere, exact copies and zero vectors, under string keys."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    rows = {}
    for g, c in enumerate(centres):
        for i in range(size):
            rows[f"{g}-{i}"] = (c + rng.normal(scale=0.05, size=dim)).tolist()
    keys = list(rows)
    for i in range(10):
        rows[f"copy{i}"] = rows[keys[7 * i]]
    for i in range(40):
        rows[f"z{i}"] = [0.0] * dim
    return rows


@pytest.mark.parametrize("exclude", [True, False])
@pytest.mark.parametrize("block_rows", [7, 4096])
def test_self_topk_equals_brute_force(spark, exclude, block_rows):
    rows = vector_rows()
    df = spark.createDataFrame(list(rows.items()), "id string, vector array<double>")
    got = {}
    for r in VB.self_topk(df, "id", 5, exclude_self=exclude, block_rows=block_rows).orderBy("left_key", "pos").collect():
        got.setdefault(r["left_key"], []).append(r["right_key"])
    assert got == brute_topk(rows, 5, exclude)


def test_self_topk_skips_tiles(spark):
    rows = vector_rows(groups=10, size=30)
    df = spark.createDataFrame(list(rows.items()), "id string, vector array<double>")
    blocks = VB.vector_blocks(df, "id", "vector", 10)
    n = blocks.count()
    opened = VB.open_pairs(blocks, VB._settle(blocks, df.schema["id"].dataType, 3, True)).count()
    assert n > 20 and opened < n * (n - 1) / 4


def test_self_topk_of_nothing(spark):
    df = spark.createDataFrame([], "id string, vector array<double>")
    assert VB.self_topk(df, "id", 3).collect() == []


@pytest.mark.parametrize("block_rows", [4, 1000])
def test_zoned_topk_equals_brute_force(spark, block_rows):
    rng = np.random.default_rng(2)
    req = [(i, rng.choice(["a", "b", "none"]), rng.normal(size=4).round(2).tolist(), rng.choice([None, 10.0, 30.0, 0.0]))
           for i in range(40)]
    docs = [(f"d{i}", rng.choice(["a", "b"]), rng.normal(size=4).round(1).tolist(),
             rng.choice([None, *np.arange(0, 50, 5.0)])) for i in range(60)]
    r = spark.createDataFrame([(i, str(g), v, None if c is None else float(c)) for i, g, v, c in req],
                              "key long, group string, v array<double>, ceiling double")
    d = spark.createDataFrame([(i, str(g), v, None if c is None else float(c)) for i, g, v, c in docs],
                              "key string, group string, v array<double>, price double")
    got = {}
    for x in VB.zoned_topk(r, d, 3, block_rows).orderBy("left_key", "pos").collect():
        got.setdefault(x["left_key"], []).append(x["right_key"])
    want = {}
    for i, g, v, c in req:
        near = sorted((round(max(float(np.dot(v, v) + np.dot(w, w) - 2 * np.dot(v, w)), 0.0), 9), k)
                      for k, h, w, p in docs if h == g and (c is None or (p is not None and p <= c)))
        if near:
            want[i] = [k for _, k in near[:3]]
    assert got == want


def test_zones_leave_tiles_out(spark):
    docs = spark.createDataFrame([(f"d{i}", "g", [float(i)], float(i)) for i in range(100)],
                                 "key string, group string, v array<double>, price double")
    req = spark.createDataFrame([(i, "g", [0.0], 15.0) for i in range(30)],
                                "key long, group string, v array<double>, ceiling double")
    left = VB._pack_zones(VB._zones(req.withColumnRenamed("ceiling", "at"), [F.col("at"), F.col("key")], 10))
    right = VB._pack_zones(VB._zones(docs.withColumnRenamed("price", "at"), [F.col("at"), F.col("key")], 10))
    assert VB.zone_pairs(left, right).count() == 3 * 2  # of 3 x 10


def test_probing_finds_k_and_recalls(spark):
    from vitrine.operators import probing
    rng = np.random.default_rng(0)
    corpus = rng.normal(size=(2000, 16))
    corpus /= np.linalg.norm(corpus, axis=1, keepdims=True)
    q = corpus[:40] + rng.normal(scale=0.1, size=(40, 16))
    cdf = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(corpus)], "id string, vector array<double>")
    qdf = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "qid long, vector array<double>")
    got = probing.probe_neighbors(qdf, cdf, 5, want=300, bits=5).cache()
    assert all(r["n"] == 5 for r in got.groupBy("qid").agg(F.count("*").alias("n")).collect()) and got.count() == 200
    true = [(i, str(j), float(((q[i] - corpus[j]) ** 2).sum())) for i in range(40) for j in range(2000)]
    assert all(abs(r["l2"] - ((q[r["qid"]] - corpus[int(r["id"])]) ** 2).sum()) < 1e-8 for r in got.collect())
    exact = [(i, p + 1, d) for i in range(40)
             for p, (d, _) in enumerate(sorted((d, j) for k, j, d in true if k == i)[:5])]
    assert probing.recall(got, spark.createDataFrame(exact, "qid long, pos int, l2 double")) >= 0.9


def test_probing_widens_to_all_buckets(spark):
    """Fewer documents than wanted candidates: every query sees them all."""
    from vitrine.operators import probing
    rng = np.random.default_rng(1)
    cdf = spark.createDataFrame([(str(i), rng.normal(size=4).tolist()) for i in range(9)], "id string, vector array<double>")
    qdf = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(5)], "qid long, vector array<double>")
    got = probing.probe_neighbors(qdf, cdf, 9, tables=2, want=50, bits=3)
    assert got.count() == 45


def test_probes_rise_in_cost():
    from vitrine.operators import probing
    rng = np.random.default_rng(3)
    for _ in range(20):
        m = rng.normal(size=6)
        order = probing.probes(m, np.zeros(64, dtype=np.int64), 1)
        own = order[0]
        cost = [sum(m[j] ** 2 for j in range(6) if (b ^ own) >> j & 1) for b in order]
        assert sorted(order) == list(range(64)) and all(a <= b + 1e-12 for a, b in zip(cost, cost[1:], strict=False))


def test_embedding_spans_the_dominant_space(spark):
    """Cosines of trained vectors equal those of the weight matrix's rows in its dominant space."""
    from vitrine.operators import embedding
    rnd = random.Random(5)
    topics = [[f"t{t}w{i}" for i in range(12)] for t in range(3)]
    docs = [(i, [rnd.choice(topics[i % 3]) for _ in range(15)]) for i in range(90)] + [(90, ["alone"]), (91, [])]
    tokens = spark.createDataFrame(docs, "id long, tokens array<string>")
    got = {r["word"]: np.array(r["vector"]) for r in embedding.train(tokens, dim=3, window=3, rounds=12).collect()}
    words = sorted({w for _, t in docs for w in t})
    assert sorted(got) == words and all(len(v) == 3 for v in got.values())
    n = {}
    for _, t in docs:
        for i, a in enumerate(t):
            for b in t[i + 1:i + 4]:
                n[a, b] = n.get((a, b), 0) + 1
                n[b, a] = n.get((b, a), 0) + 1
    m = np.zeros((len(words), len(words)))
    for (a, b), c in n.items():
        m[words.index(a), words.index(b)] = c
    rows = m.sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        w = np.where(m > 0, np.maximum(np.log(m * m.sum() / (rows[:, None] * rows[None, :])), 0), 0)
    value, vec = np.linalg.eigh(w)
    top = vec[:, np.argsort(-np.abs(value))[:3]]
    mine = np.array([got[x] for x in words])
    assert np.allclose(mine @ mine.T, w @ top @ top.T @ w.T, atol=1e-3 * np.abs(w).max() ** 2 * 12)
    sim = {x: max((y for y in words if y != x), key=lambda y: got[x] @ got[y] / (1e-9 + np.linalg.norm(got[y]))) for x in words}
    assert all(sim[x][:2] == x[:2] for x in words if x != "alone")


def test_embedding_over_several_blocks(spark, monkeypatch):
    from vitrine.operators import embedding
    rnd = random.Random(6)
    tokens = spark.createDataFrame([(i, [f"t{i % 3}w{rnd.randrange(13)}" for _ in range(12)]) for i in range(60)],
                                   "id long, tokens array<string>")
    whole = {r["word"]: np.array(r["vector"]) for r in embedding.train(tokens, dim=3, rounds=12).collect()}
    monkeypatch.setattr(embedding, "BLOCK_WORDS", 7)
    cut = {r["word"]: np.array(r["vector"]) for r in embedding.train(tokens, dim=3, rounds=12).collect()}
    words = sorted(whole)
    a, b = [np.array([d[w] for w in words]) for d in (whole, cut)]
    assert np.allclose(a @ a.T, b @ b.T, atol=1e-3 * np.abs(a @ a.T).max())


def test_best_choice_of_overlapping_compounds():
    from itertools import combinations

    from vitrine.operators import phrases
    rnd = random.Random(8)
    for _ in range(300):
        places = sorted(rnd.sample(range(12), rnd.randint(0, 8)))
        weights = [rnd.randint(1, 9) for _ in places]
        got = phrases.choose(places, weights)
        assert all(b - a > 1 for a, b in zip(got, got[1:], strict=False))
        best = max(sum(weights[i] for i in c) for n in range(len(places) + 1) for c in combinations(range(len(places)), n)
                   if all(places[b] - places[a] > 1 for a, b in zip(c, c[1:], strict=False)))
        assert sum(w for p, w in zip(places, weights, strict=True) if p in got) == best


def test_compounds_are_joined(spark):
    from vitrine.operators import phrases
    rnd = random.Random(9)
    rows = []
    for i in range(200):
        t = [f"w{rnd.randrange(30)}" for _ in range(10)]
        t[3:3] = ["áo", "sơ", "mi"] if i % 2 else ["quần", "jeans"]
        rows.append((i, t))
    rows += [(200, []), (201, None), (202, ["áo"])]
    df = spark.createDataFrame(rows, "id long, tokens array<string>")
    got = {r["id"]: r["tokens"] for r in phrases.segment(df, passes=2).collect()}
    assert all("quần_jeans" in got[i] for i in range(0, 200, 2)) and all("áo_sơ_mi" in got[i] for i in range(1, 200, 2))
    assert got[200] == got[201] == [] and got[202] == ["áo"]
    assert all("_".join(got[i]).split("_") == rows[i][1] for i in range(200))


def test_stream_over_a_folder_of_files(spark):
    """Four files in three batches, a file that is read again, nulls and repeats: equal to the batch matrix."""
    from vitrine.sources import fixtures as FX
    from vitrine.streaming import matrix_stream as S
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    base = scratch_path(spark, "sf")
    ev.unionByName(ev.limit(50)).repartition(4).write.parquet(f"{base}/events.parquet")
    out = scratch_path(spark, "out")
    got = S.stream_matrix(spark, base, out, max_files_per_trigger=2)
    want = M.user_product_matrix(FX.interactions(spark, SF001))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    # later files: another run of the same stream goes on where it stopped
    ev.limit(30).withColumn("event_type", F.lit("error")).coalesce(1).write.mode("append").parquet(f"{base}/events.parquet")
    got = S.stream_matrix(spark, base, out, max_files_per_trigger=2)
    want = M.user_product_matrix(FX.interactions(spark, base))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    batches = {r["batch"] for r in spark.read.parquet(f"{out}/cells").select("batch").distinct().collect()}
    assert len(batches) == 3
    small = S.compact(spark, out, scratch_path(spark, "compact"))
    assert small.exceptAll(want).count() == 0 and small.count() == want.count()


def test_readers_keep_their_version(spark):
    from vitrine.streaming import refresh as RF
    base = RF.snapshot_base(spark)
    assert RF.Snapshot.open(spark, base).version == 0
    model = spark.createDataFrame([("áo", [1.0, 0.0]), ("quần", [0.0, 1.0])], "word string, vector array<double>")

    def products(rows):
        return spark.createDataFrame(rows, "id string, description string")
    inter = inter_df(spark, [(1, "a", 2), (1, "a", 2), (2, "b", 1), (2, "c", None)])
    texts = products([("a", "áo"), ("b", "quần"), ("c", None)])
    RF.refresh_all(spark, base, inter, texts, texts, model, [], 2)
    reader = RF.Snapshot.open(spark, base)
    before = {r["id"]: r["vector"] for r in reader.read("vectors").collect()}
    changed = products([("c", "áo quần"), ("d", "quần")])
    # a refresh between two reads of one reader
    RF.refresh_delta(spark, base, inter_df(spark, [(1, "a", 1), (1, "a", 2), (3, "d", 4), (None, "d", 1)]), changed, changed, [], 2)
    assert {r["id"]: r["vector"] for r in reader.read("vectors").collect()} == before
    assert reader.read("catalog").count() == 3
    later = RF.Snapshot.open(spark, base)
    assert (reader.version, later.version) == (1, 2)
    cells = {(r["user_id"], r["product_id"]): r["score"] for r in RF.matrix_of(later.read("cells")).collect()}
    assert cells == {(1, "a"): 3, (2, "b"): 1, (2, "c"): 0, (3, "d"): 4}
    got = {r["id"]: r["vector"] for r in later.read("vectors").collect()}
    assert got == {"a": [1.0, 0.0], "b": [0.0, 1.0], "c": [0.5, 0.5], "d": [0.0, 1.0]}
    assert later.read("catalog").count() == 4 and later.read("model").count() == 2
    with pytest.raises(Exception):  # a refresh of the superseded version
        reader.publish(delta={"catalog": changed})
    assert RF.Snapshot.open(spark, base).version == 2


def test_many_deltas_are_merged(spark):
    from vitrine.streaming import refresh as RF
    base = RF.snapshot_base(spark)
    rows = spark.createDataFrame([(i, "v0") for i in range(5)], "id int, v string")
    at = RF.Snapshot.open(spark, base).publish(whole={"t": (rows, ["id"])})
    for n in range(RF.MAX_PARTS + 2):
        at = at.publish(delta={"t": spark.createDataFrame([(n % 5, f"v{n + 1}")], rows.schema)})
    assert len(at.tables["t"]["parts"]) <= RF.MAX_PARTS
    got = {r["id"]: r["v"] for r in RF.Snapshot.open(spark, base).read("t").collect()}
    assert got == {i: f"v{max(n for n in range(RF.MAX_PARTS + 2) if n % 5 == i) + 1}" for i in range(5)}


def test_blocks_travel_by_squads(spark, monkeypatch):
    """Squads of blocks give the rows of single blocks, and the tasks return k rows a key."""
    from vitrine.operators import ranking as RK
    from vitrine.operators import userblocks as UB
    from vitrine.operators import vectorblocks as VB
    rnd = np.random.default_rng(3)
    m = spark.createDataFrame([(u, f"p{p}", int(rnd.integers(1, 5))) for u in range(90) for p in rnd.choice(15, 4, False)],
                              "user_id long, product_id string, score long")
    vectors = [(f"{i:03d}", rnd.integers(-2, 3, 4).astype(float).tolist()) for i in range(90)]
    v = spark.createDataFrame(vectors, "id string, vector array<double>")
    sizes, seen, whole = [], [], RK.squad_pairs

    def noted(left, right, pairs, size):
        sizes.append(size)
        out = whole(left, right, pairs, size)
        seen.append(pairs.count())
        return out
    for module in (UB, VB):
        monkeypatch.setattr(module, "squad_pairs", noted)
    found = []
    for least in (1000, 3):
        monkeypatch.setattr(RK, "MIN_SQUADS", least)
        found.append((sorted(map(tuple, UB.nearest(m, 5, 5).collect())), sorted(map(tuple, VB.self_topk(v, "id", 5, block_rows=5).collect()))))
    assert found[0] == found[1] and sizes[:2] == [1, 1] and min(sizes[2:]) > 1 and min(seen) > 3
    near = RK.Nearest(["lk", "rk", "s"], 2, False, 3)
    for rk, s in enumerate((0.1, 0.7, None, 0.7)):
        near.add(pd.DataFrame({"lk": ["x"], "rk": [rk], "s": [s]}))
    assert near.best()["rk"].tolist() == [2, 1]
