"""Plain-Python restatement of the recommendation rules (M1-M12) for small inputs.

Written from the rule text, independent of the Spark operators: dense
matrix, all-pairs cosine distances, sorted neighbour lists, dict scores.
"""

from __future__ import annotations

import math
from collections import defaultdict


def matrix(rows):
    cells = defaultdict(set)
    keys = set()
    for u, p, t in rows:
        if u is None or p is None:
            continue
        keys.add((u, p))
        if t is not None:
            cells[(u, p)].add(t)
    return {k: sum(cells.get(k, ())) for k in keys}


def recommend(rows, n_recs=8, max_k=5, eps=1e-5):
    m = matrix(rows)
    users = sorted({u for u, _ in m})
    items = sorted({p for _, p in m})
    vec = {u: {p: m.get((u, p), 0) for p in items} for u in users}
    norm = {u: math.sqrt(float(sum(x * x for x in vec[u].values()))) for u in users}
    k = min(max_k, len(users))
    pop = defaultdict(int)
    for (u, p), s in m.items():
        pop[p] += s
    pop_order = sorted(items, key=lambda p: (-pop[p], p))
    out = {}
    for u in users:
        dists = []
        for v in users:
            if norm[u] > 0 and norm[v] > 0:
                dot = sum(vec[u][p] * vec[v][p] for p in items)
                d = 1.0 - float(dot) / (norm[u] * norm[v])
                d = round(min(max(d, 0.0), 2.0), 9) + 0.0
            else:
                d = 1.0
            dists.append((d, v))
        dists.sort()
        scores, first = {}, {}
        for rank, (d, v) in enumerate(dists[:k], start=1):
            w = 1.0 / (d + eps)
            for p in items:
                if vec[v][p] > 0:
                    scores[p] = scores.get(p, 0.0) + w
                    first.setdefault(p, rank)
        cand = [p for p in scores if vec[u][p] == 0]
        cand.sort(key=lambda p: (-round(scores[p], 6), first[p], p))
        listed = cand[:n_recs]
        recs = [(i + 1, p, round(scores[p], 6), "cf") for i, p in enumerate(listed)]
        if len(listed) < n_recs:
            fill = [p for p in pop_order if p not in listed and vec[u][p] == 0]
            recs += [(len(listed) + i + 1, p, None, "popular")
                     for i, p in enumerate(fill[:n_recs - len(listed)])]
        out[u] = recs
    return out, k
