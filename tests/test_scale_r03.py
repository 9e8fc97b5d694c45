"""Steps that grew with the square of their input, or held it whole."""
import subprocess
import sys

import numpy as np
import pytest

from vitrine.operators import matrix as M
from vitrine.operators import neighbors as N
from vitrine.operators import ranking as RK
from vitrine.operators import userblocks as UB
from vitrine.operators import vectorblocks as VB
from tests.conftest import inter_df


def brute_zone(x, y, ceiling, price, keys, k):
    out = []
    for v, c in zip(x, ceiling, strict=True):
        near = sorted((round(max(float(v @ v + w @ w - 2 * (v @ w)), 0.0), 9), d) for w, p, d in zip(y, price, keys, strict=True)
                      if np.isnan(c) or p <= c)
        out.append(near[:k])
    return out


@pytest.mark.parametrize("scale", [1.0, 1e-3, 1e6, 1e17])
@pytest.mark.parametrize("digits", [0, 6])
def test_zone_tiles_equal_brute_force(scale, digits):
    """Rough scores leave nothing out: ties, many equal documents, ceilings, several blocks, all scales."""
    rng = np.random.default_rng(7)
    x, y = rng.normal(size=(300, 5)).round(digits) * scale, rng.normal(size=(180, 5)).round(digits) * scale
    ceiling = np.where(rng.random(300) < 0.3, np.nan, rng.integers(-1, 12, 300))
    price = np.where(rng.random(180) < 0.1, np.nan, rng.integers(0, 10, 180))
    docs = np.array([f"d{i:03d}" for i in rng.permutation(180)], dtype=object)
    shelves = [VB.Shelf(docs[lo:lo + 70], y[lo:lo + 70].tobytes(), price[lo:lo + 70].astype(float).tobytes()) for lo in (0, 70, 140)]
    found = VB.zone_top(np.arange(300), x.tobytes(), ceiling.astype(float).tobytes(), iter(shelves), 4)
    got = {i: [] for i in range(300)}
    for who, what, near in found:
        for i, d, s in zip(who, what, near, strict=True):
            got[i].append((-s + 0.0, d))
    want = brute_zone(x, y, ceiling, price, docs, 4)
    for i in range(300):
        mine = sorted(got[i])[:4]
        assert len(mine) == len(want[i])
        if scale <= 1:
            assert [d for _, d in mine] == [d for _, d in want[i]]
        assert np.allclose([s for s, _ in mine], [s for s, _ in want[i]], rtol=1e-6)


def test_zoned_blocks_travel_by_squads(spark, monkeypatch):
    rng = np.random.default_rng(4)
    req = [(i, "ab"[i % 2], rng.normal(size=3).round(1).tolist(), [None, 5.0, 9.0][i % 3]) for i in range(60)]
    docs = [(f"d{i}", "ab"[i % 2], rng.normal(size=3).round(1).tolist(), float(i % 10)) for i in range(80)]
    r = spark.createDataFrame(req, "key long, group string, v array<double>, ceiling double")
    d = spark.createDataFrame(docs, "key string, group string, v array<double>, price double")
    sizes, whole = [], RK.squad_pairs
    monkeypatch.setattr(VB, "squad_pairs", lambda a, b, pairs, size: (sizes.append(size), whole(a, b, pairs, size))[1])
    found = []
    for least in (1000, 3):
        monkeypatch.setattr(RK, "MIN_SQUADS", least)
        found.append(sorted(map(tuple, VB.zoned_topk(r, d, 3, 5).collect())))
    assert sizes[0] == 1 and sizes[1] > 1 and found[0] == found[1] and len(found[0]) == 180


def test_zone_tile_memory():
    code = """
import resource, numpy as np
from vitrine.operators import vectorblocks as VB
rng = np.random.default_rng(0)
data = [rng.normal(size=(2048, 64)).tobytes() for _ in range(2)]
at = np.full(2048, np.nan).tobytes()
shelf = VB.Shelf(np.arange(2048), data[1], at)
VB.zone_top(np.arange(8), data[0][:8 * 512], at[:64], iter([shelf]), 3)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
VB.zone_top(np.arange(2048), data[0], at, iter([shelf]), 3)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True)
    assert float(out.stdout) < 60  # a whole tile of scores alone has 32 MB, and there were seven


def block(number, users, cells, products, rng):
    who = np.repeat(np.arange(users), cells)
    col = np.concatenate([rng.choice(products, cells, replace=False) for _ in range(users)])
    order = np.lexsort((who, col))
    starts = np.concatenate(([0], np.cumsum(np.bincount(col, minlength=products))))
    return UB.Block({"block": number, "users": (np.arange(users) + users * number).astype("<i8").tobytes(),
                     "products": np.array([f"p{i}" for i in range(products)], dtype=object),
                     "starts": starts.astype("<i8").tobytes(), "who": who[order].astype("<i4").tobytes(),
                     "score": rng.choice([1, 2, 4, -3], len(who)).astype("<f8").tobytes()})


def test_sparse_tiles_expand_matching_cells_only(monkeypatch):
    rng = np.random.default_rng(8)
    a, b = block(0, 400, 2, 900, rng), block(1, 400, 2, 900, rng)
    limits = [rng.choice([0.0, 0.1, 0.5, 0.9], 400) for _ in range(2)]
    want = set()
    for (users, _, _), limit, first in zip([(a.users, 0, 0), (b.users, 0, 0)], limits, (0, 400), strict=True):
        for parts in UB.tile_top(a, b, 5, True):
            want |= {(u, v, d) for u, v, d in zip(*parts, strict=True) if u in set(users) and d <= limit[u - first]}
    monkeypatch.setattr(UB, "tile", None)  # no matrix of all pairs
    got = {x for parts in UB.sparse_top(a, b, 5, *limits) for x in zip(*parts, strict=True)}
    assert got == want and len(want) > 50
    assert UB.sparse_top(block(0, 50, 20, 30, rng), block(1, 50, 20, 30, rng), 5, np.ones(50), np.ones(50)) is None


def test_sparse_users_equal_the_join(spark):
    rng = np.random.default_rng(9)
    rows = [(u, f"p{p}", int(rng.choice([1, 2, 4, -3]))) for u in range(160) for p in rng.integers(0, 60, rng.integers(1, 4))]
    m = M.user_product_matrix(inter_df(spark, rows))
    tiled = sorted(map(tuple, N.tile_user_neighbors(m, 3, block_rows=16).collect()))
    assert tiled == sorted(map(tuple, N.sparse_user_neighbors(m, 3, N.CFParams()).collect()))


def test_only_rare_words_are_joined_with_their_vectors(spark):
    from vitrine.operators import text as TX
    rng = np.random.default_rng(6)
    texts = [(i, [f"w{w}" for w in rng.zipf(1.4, 20) % 40]) for i in range(30)] + [(30, []), (31, ["unknown"])]
    vectors = [(f"w{w}", rng.normal(size=3).tolist()) for w in range(38)] + [("w1", [1.0, 2.0, 3.0])]
    docs = spark.createDataFrame(texts, "id long, tokens array<string>")
    model = spark.createDataFrame(vectors, "word string, vector array<double>")
    for hot in (3, 1000):
        frame = TX.doc_vectors(docs, model, 3, hot)
        got = {r["id"]: r for r in frame.collect()}
        for i, words in texts:
            found = [np.array(v) for w in words for x, v in vectors if x == w]
            assert got[i]["n_vocab_tokens"] == len(found)
            assert np.allclose(got[i]["vector"], np.mean(found, axis=0) if found else np.zeros(3))
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert "FlatMapCoGroupsInPandas" in plan and len(got) == 32


def test_fingerprints_of_many_texts_equal_single_ones(monkeypatch):
    from vitrine.llm import fingerprints
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{w}" for w in rng.zipf(1.3, rng.integers(0, 60)) % 500) for _ in range(60)] + ["", "  "]
    want = [fingerprints.Sampler(32).of(t) for t in texts]
    drawn, learn = [], fingerprints.Sampler.learn
    monkeypatch.setattr(fingerprints.Sampler, "learn", lambda self, new: (drawn.append(len(new)), learn(self, new))[1])
    monkeypatch.setattr(fingerprints, "GROUP_TERMS", 50)
    for room in (20, 120, 10_000):
        monkeypatch.setattr(fingerprints, "CACHE_TERMS", room)
        own = fingerprints.Sampler(32)
        drawn.clear()
        got = [f for lo in range(0, len(texts), 7) for f in own.many(texts[lo:lo + 7])]
        assert all((a == b).all() for a, b in zip(got, want, strict=True)) and len(drawn) < len(texts)
        assert own.used <= max(room, 50) + 50


def test_fingerprints_draw_few_samples_of_a_word(monkeypatch):
    """Fingerprints from the low draws alone equal those from all draws: counts, few and many words, equal words."""
    from collections import Counter

    from vitrine.llm import fingerprints as FP
    from vitrine.llm.common import word_hashes
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{w}" for w in rng.zipf(1.2, n) % 5000) for n in (1, 2, 9, 60, 300, 1500, 4000)] + ["a " * 3000, "a b " * 40]
    own = FP.Sampler(128)
    for text, got in zip(texts, own.many(texts), strict=True):
        terms = Counter(text.encode().split())
        h = word_hashes(list(terms))
        every = np.repeat(h, 128)
        n = np.repeat(np.array(list(terms.values())), 128)
        _, key = FP.keys(FP.mix64(every ^ np.tile(own.salt, len(terms))), every, n)
        assert (got == key.reshape(-1, 128).min(axis=0).astype(np.uint32)).all()
    assert len(own.key[:own.begin[own.used]]) < own.used * 128 / 8
    monkeypatch.setattr(FP, "GROUP_TERMS", 100)
    monkeypatch.setattr(FP, "CACHE_TERMS", 150)
    small = FP.Sampler(128)
    assert (small.many(texts) == own.many(texts)).all()
    assert small.used <= 250 and len(small.word) <= 6000


def test_word_pairs_travel_in_packed_arrays(spark, monkeypatch):
    """The tiles of coded texts times vectors equal the weights of all pairs of words: several blocks and slabs of rows,
    texts counted by parts, words that occur beside themselves or alone."""
    from vitrine.operators import embedding as E
    rng = np.random.default_rng(3)
    texts = [[f"w{w % 60}" for w in rng.zipf(1.4, n)] for n in (0, 1, 2, 7, 90, 30)] + [["x", "x", "y"], ["alone"]]
    for name, value in (("BLOCK_WORDS", 16), ("GROUP_BLOCKS", 2), ("TOKENS", 37), ("STRIPES", 3), ("STRIPE_WORDS", 4)):
        monkeypatch.setattr(E, name, value)
    tokens = spark.createDataFrame([(t,) for t in texts], "tokens array<string>")
    vocab, blocks = E.vocabulary(tokens, 3)
    code = {r["word"]: r["place"] * blocks + r["block"] for r in vocab.collect()}
    n = np.zeros((len(code), len(code)))
    for t in texts:
        for i, a in enumerate(t):
            for b in t[i + 1:i + 4]:
                n[code[a], code[b]] += 1
                n[code[b], code[a]] += 1
    s = n.sum(axis=1)
    assert blocks > 2 and {r["word"]: r["s"] for r in vocab.collect()} == {w: s[c] for w, c in code.items()}
    with np.errstate(divide="ignore", invalid="ignore"):
        want = np.maximum(np.nan_to_num(np.log(n * s.sum() / (s[:, None] * s[None, :])), nan=0.0, neginf=0.0), 0)
    matrix = E.tiles(E.coded(tokens, vocab, blocks), blocks, 3, float(s.sum()))
    assert sorted(matrix.columns) == ["bi", "bj", "cols", "rows", "weights"] and matrix.count() <= 12 * blocks * blocks
    x = rng.normal(size=(blocks * 16, 5)).astype("<f4")  # of code c: row c
    held = [(b, x[b::blocks].tobytes(), np.pad(np.log(np.maximum(s, 1)), (0, len(x) - len(s)))[b::blocks].tobytes())
            for b in range(blocks)]
    v = spark.createDataFrame([h[:2] for h in held], "block long, data binary")
    sums = spark.createDataFrame([h[::2] for h in held], "block long, sums binary")
    got = np.zeros_like(x)
    for r in E._times(matrix, sums, v, 5, blocks).collect():
        got[r["block"]::blocks] = np.frombuffer(r["data"], dtype="<f4").reshape(-1, 5)
    assert np.allclose(got[:len(s)], want @ x[:len(s)], atol=1e-4)
    monkeypatch.undo()
    few = E.train(tokens, 4, 3, rounds=1).collect()
    assert {r["word"] for r in few} == set(code) and all(len(r["vector"]) == 4 for r in few)


def test_overlapping_pairs_travel_by_squads(spark, monkeypatch):
    """Blocks, blocks in squads and squads with themselves give each pair in both directions once; none of nothing."""
    rng = np.random.default_rng(12)
    rows = [(int(u), f"p{p}", int(c)) for u, p, c in zip(rng.integers(0, 60, 400), rng.integers(0, 90, 400), rng.choice([1, 2, -3, 4], 400), strict=True)]
    m = M.user_product_matrix(inter_df(spark, rows + [(77, "own", 1), (78, "zero", 1), (78, "zero", -1), (78, "p3", None)]))
    want = sorted(map(tuple, N.user_similarity(m, mode="sparse").collect()))
    sizes, whole = [], RK.squad_size
    monkeypatch.setattr(UB, "squad_size", lambda *a: (sizes.append(whole(*a)), sizes[-1])[1])
    for least, slots in ((1000, 7), (3, 7), (2, 5), (16, 2048)):
        monkeypatch.setattr(RK, "MIN_SQUADS", least)
        assert sorted(map(tuple, UB.overlapping(m, slots).collect())) == want
    assert sizes == [1, 3, 6, 1] and 100 < len(want) < 60 * 59
    assert UB.overlapping(m.where("false")).collect() == []


def test_two_directions_of_a_pair_lie_together(spark):
    """Within two blocks' users of each other, so that files hold their values about once; before, a slice of all pairs lay between."""
    rng = np.random.default_rng(13)
    rows = [(u, f"p{p}", int(c)) for u in range(120) for p, c in zip(rng.choice(12, 7, replace=False), rng.integers(1, 5, 7), strict=True)]
    found = UB.overlapping(M.user_product_matrix(inter_df(spark, rows)), 40).collect()
    place = {(r["user_id"], r["other_id"]): i for i, r in enumerate(found)}
    assert len(place) == len(found) == 120 * 119
    assert max(abs(i - place[v, u]) for (u, v), i in place.items()) <= 2 * 40


def test_pairs_of_full_blocks_leave_in_slices():
    """Two full blocks have 8.4 million rows, 270 MB at once: no slice holds over 2 x MIRRORED x 2048 of them."""
    rng = np.random.default_rng(14)
    a, b = (block(number, 2048, 49, 100, rng) for number in (0, 1))
    sizes = [{len(x) for x in part} for part in UB.mirrored(a, b)]
    assert all(len(s) == 1 and max(s) <= 2 * UB.MIRRORED * 2048 for s in sizes) and sum(map(max, sizes)) > 8_000_000
