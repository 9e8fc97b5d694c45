import math
import random

import numpy as np
from pyspark.sql import functions as F

from vitrine.operators import text as TX
from vitrine.operators import vectors as V
from vitrine.operators.probing import probe_neighbors


def tokens(spark, texts, stop):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, description string")
    return {r["id"]: r["tokens"] for r in TX.tokens_clean(df, stop).collect()}


def test_text_cleaning_golden(spark):
    t = tokens(spark, ["Áo sơ-mi, NỮ!", "a lô áo", None, "và của", "áo áo quần"], ["của", "và", "a lô"])
    assert t[0] == ["áo", "sơmi", "nữ"]
    assert t[1] == ["a", "lô", "áo"]          # two-word stopword never matches a token
    assert t[2] == [] and t[3] == []
    assert t[4] == ["áo", "áo", "quần"]       # repeats kept


def test_doc_vectors_mean_and_zero(spark):
    toks = spark.createDataFrame([(1, ["áo", "áo", "quần"]), (2, []), (3, ["oov"])], "id int, tokens array<string>")
    wv = spark.createDataFrame([("áo", [1.0, 0.0]), ("quần", [0.0, 3.0])], "word string, vector array<double>")
    got = {r["id"]: (r["vector"], r["n_vocab_tokens"]) for r in TX.doc_vectors(toks, wv, 2).collect()}
    assert np.allclose(got[1][0], [2 / 3, 1.0]) and got[1][1] == 3
    assert got[2][0] == [0.0, 0.0] and got[3][0] == [0.0, 0.0]


def test_word2vec_invariants(spark):
    toks = spark.createDataFrame([(i, ["áo", "quần", "giày", f"w{i % 3}"]) for i in range(20)],
                                 "id int, tokens array<string>")
    model = TX.train_word2vec(toks, vector_size=8, partitions=1)
    wv = TX.model_word_vectors(model).collect()
    assert len(wv) == 6 and all(len(r["vector"]) == 8 for r in wv)


def brute_topk(vecs, k, exclude_self):
    ids = sorted(vecs)
    out = {}
    for a in ids:
        sc = []
        for b in ids:
            if exclude_self and a == b:
                continue
            x, y = np.array(vecs[a]), np.array(vecs[b])
            na, nb = np.linalg.norm(x), np.linalg.norm(y)
            s = float(x @ y / (na * nb)) if na > 0 and nb > 0 else 0.0
            sc.append((-round(s, 9), b))
        sc.sort()
        out[a] = [b for _, b in sc[:k]]
    return out


def test_blocked_topk_matches_bruteforce_with_ties(spark):
    rnd = random.Random(3)
    vecs = {}
    for i in range(60):
        if i % 5 == 0:
            v = [0.0, 0.0, 0.0]                      # zero vectors: all ties
        elif i % 7 == 0:
            v = [1.0, 2.0, 2.0]                      # duplicates: similarity 1
        else:
            v = [float(rnd.randint(-3, 3)) for _ in range(3)]
        vecs[f"{i:03d}"] = v
    df = spark.createDataFrame(list(vecs.items()), "id string, vector array<double>")
    for block in (7, 1024):
        got = V.similar_products(df, k=6, block_rows=block).collect()
        res = {}
        for r in sorted(got, key=lambda r: (r["product_id"], r["rank"])):
            res.setdefault(r["product_id"], []).append(r["similar_id"])
        assert res == brute_topk(vecs, 6, True)


def test_symmetric_tiles_equal_full_grid(spark):
    rnd = random.Random(11)
    vecs = [(f"{i:03d}", [float(rnd.randint(-2, 2)) for _ in range(4)]) for i in range(90)]
    df = spark.createDataFrame(vecs, "id string, vector array<double>")
    for metric in ("cosine", "l2"):
        full = V.blocked_topk(df, df, lkey="id", rkey="id", k=7, metric=metric, block_rows=8).collect()
        sym = V.blocked_topk(df, df, lkey="id", rkey="id", k=7, metric=metric, block_rows=8,
                             symmetric=True).collect()
        assert sorted(map(tuple, sym)) == sorted(map(tuple, full)) and len(full) == 90 * 7


def test_four_products_give_three(spark):
    df = spark.createDataFrame([(str(i), [1.0, float(i)]) for i in range(4)], "id string, vector array<double>")
    got = V.similar_products(df).groupBy("product_id").count().collect()
    assert all(r["count"] == 3 for r in got) and len(got) == 4


def test_cosine_expression(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([1.0, 1.0], [2.0, 2.0]), ([0.0, 0.0], [1.0, 0.0])],
                               "a array<double>, b array<double>")
    got = [r[0] for r in df.select(V.cosine_expr(F.col("a"), F.col("b"))).collect()]
    assert got[0] == 0.0 and math.isclose(got[1], 1.0) and got[2] == 0.0


def test_lsh_recall(spark):
    rnd = np.random.default_rng(0)
    corpus = rnd.normal(size=(300, 8))
    corpus /= np.linalg.norm(corpus, axis=1, keepdims=True)
    q = corpus[:20] + rnd.normal(scale=0.05, size=(20, 8))
    cdf = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(corpus)], "id string, vector array<double>")
    qdf = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "qid long, vector array<double>")
    approx = probe_neighbors(qdf, cdf, k=3).collect()
    exact = V.blocked_topk(qdf, cdf, lkey="qid", rkey="id", k=3, metric="l2").collect()
    a = {(r["qid"], r["id"]) for r in approx}
    e = {(r["left_key"], r["right_key"]) for r in exact}
    assert len(a & e) / len(e) >= 0.9


def test_undefined_similarities_are_null(spark):
    nan = float("nan")
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.1]), ("c", [nan, 1.0]), ("d", [0.0, 1.0])],
                               "id string, vector array<double>")
    got = {(r["product_id"], r["similar_id"]): r["score"] for r in V.similar_products(df, k=3).collect()}
    assert len(got) == 12
    assert all((s is None) == ("c" in pair) for pair, s in got.items())


def test_stopword_file_is_read(spark, tmp_path):
    from vitrine.sources.stopwords import load_stopwords
    path = tmp_path / "words.txt"
    path.write_text("và\ncủa\n\nvà\na lô\n", encoding="utf-8")
    got = sorted(r["word"] for r in load_stopwords(spark, str(path)).collect())
    assert got == ["a lô", "của", "và"]


def test_tiled_means_over_chunks_repeats_and_rare_words(spark):
    rnd = np.random.default_rng(5)
    vectors = [(i, rnd.normal(size=3).tolist()) for i in range(11)] + [(4, [1.0, 2.0, 3.0]), (6, None), (None, [9.0] * 3)]
    counts = [(d, f"w{w}", int(rnd.integers(1, 4))) for d in range(9) for w in range(20) if rnd.random() < 0.4]
    words = [(f"w{w}", w % 13, w + 1) for w in range(19)]            # two ids without a vector, a word without an id
    cdf = spark.createDataFrame(counts, "id long, word string, cnt long")
    wdf = spark.createDataFrame(words, "word string, vec_id long, rnk long")
    vdf = spark.createDataFrame(vectors, "vec_id long, vector array<double>")
    to, want = {w: v for w, v, _ in words}, {}
    for d, w, c in counts:
        for i, v in vectors:
            if w in to and i == to[w]:
                s = want.setdefault(d, [np.zeros(3), 0, 0])
                s[2] += c
                if v is not None:
                    s[0], s[1] = s[0] + c * np.array(v), s[1] + c
    for hot, chunk, hits in ((3, 4, 7), (50, 100, 1000)):
        h = TX.hits_of(cdf, wdf, hot)
        got = {r["id"]: r for r in TX.tiled_means(h, vdf, len(counts), 3, chunk, hits).collect()}
        assert set(got) == set(want)
        for d, (s, n, tokens) in want.items():
            assert np.allclose(got[d]["vector"], s / max(n, 1)) and got[d]["n_vocab_tokens"] == tokens


def test_no_shuffled_row_holds_a_word_vector_per_word(spark, monkeypatch):
    """Neither the words' counts nor their vectors are joined row by row, nor checkpointed uncompressed."""
    from tests.conftest import SF001
    from vitrine.plans.registry import QUERIES
    seen, kind = [], type(spark.range(1))
    whole = kind.checkpoint
    monkeypatch.setattr(kind, "checkpoint", lambda self, *a, **kw: (seen.append(self.columns), whole(self, *a, **kw))[1])
    plan = QUERIES["doc_vectors"](spark, SF001)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and "vec_id" in line]
    assert "FlatMapCoGroupsInPandas" in plan and not joins
    assert not any({"id", "word", "cnt"} <= set(c) for c in seen)


def test_pairs_too_rare_for_a_compound_never_meet_their_words(spark, monkeypatch):
    from vitrine.operators import phrases
    texts = [["a", "b", "c"]] * 9 + [["a", "c"]] * 6 + [["b", "d", "a", "x", "y"]] * 4 + [["x", "y", "x", "y"]]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, tokens array<string>")
    whole, seen = TX.phrase_bigrams, []

    def noted(*a, **kw):
        out = whole(*a, **kw)
        seen.append(sorted(r["n"] for r in out.collect()))
        return out
    for t in (-1.0, 0.5, 2.0, 2.576):
        n, pairs = {}, {}
        for text in texts:
            for w in text:
                n[w] = n.get(w, 0) + 1
            for p in zip(text, text[1:], strict=False):
                pairs[p] = pairs.get(p, 0) + 1
        total = sum(n.values())
        want = {p for p, c in pairs.items() if (c - n[p[0]] * n[p[1]] / total) / math.sqrt(c) >= t
                and c * total > n[p[0]] * n[p[1]]}
        monkeypatch.setattr(phrases.TX, "phrase_bigrams", noted)
        assert {(r["w1"], r["w2"]) for r in phrases.compounds(df, t).collect()} == want
        monkeypatch.setattr(phrases.TX, "phrase_bigrams", whole)
    assert min(seen[-1]) >= 7 and min(seen[0]) < 7
