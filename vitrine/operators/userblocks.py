"""Exact user-user kNN over packed blocks of users, with block pruning.

1. Users are ordered (the smallest ids first, then by favourite product, so
   that alike users are neighbours) and cut into blocks of bounded weight: a
   user counts 1 and 1 more for every ``SLOT_CELLS`` cells, so a block has at
   most ``block_slots`` users and about block_slots x SLOT_CELLS cells, however
   heavy a user is.
2. Products are numbered in the order of their names.  A block is packed once,
   to one row: its cells by product (column order) in arrays of the narrowest
   type, rising ones as differences, compressed, and a summary, for each of
   ``CLASSES`` classes of products the largest norm of a user's unit vector
   within the class.
3. Every block is compared with itself and with the first block.  That gives
   each user a k-th distance to beat, and settles users without overlap: they
   are at distance 1 from each other, and the smallest ids are in block 0.
4. By Cauchy-Schwarz within classes, no user of a block is more similar to u
   than the sum of u's class norms times the block's.  Only pairs of blocks
   in which this bound reaches a user's k-th distance are compared at all.
5. Tiles return at most k rows per user; a window whose limit is pushed
   below the shuffle merges them.  Where few of a tile's pairs share a product
   and no user of it still needs others (``wide``), only the shared cells
   are expanded: its work is the number of matching cells, not of pairs.

A tile multiplies product by product: heavy products as slices of a matrix
product, others by expanding matching cells, at most ``EXPANSION`` at a time,
for ``ROWS`` left users at a time, so its memory does not depend on the
data.  Dots are sums of integer products (exact in float64) and norms square
roots of integer sums, as in SQL, so which way a product is multiplied
changes nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.operators.ranking import PAIR_TASKS, Nearest, by_block, global_rank, running_total, squad_pairs, squad_size
from vitrine.session import materialize

BLOCK_SLOTS = 2048     # weight of a block (users, heavy ones several times)
SLOT_CELLS = 1024      # cells that make a user one slot heavier
CLASSES = 256          # product classes of the pruning bound
ROWS = 512             # left users of a tile that are compared at a time
MIRRORED = 128         # left users whose pairs are returned at a time
EXPANSION = 1 << 20    # matching cells that are expanded at a time
GEMM_COLUMNS = 256     # products of one matrix-product slice
#: A product is multiplied in a matrix product if expanding it takes more than 1/GEMM_SHARE of the tile's cells.
GEMM_SHARE = 256
SPARSE_SHARE = 8       # a tile is sparse if its matching cells are less than 1/SPARSE_SHARE of its pairs
STRIPE = 1024          # blocks whose summaries are bounded together
HELD = 16              # right blocks of a squad that are unpacked at a time
SLACK = 1e-4           # covers the rounding of the float32 bounds

_PACK = "block long, users binary, products binary, starts binary, who binary, score binary, summary binary"
_RISING = ("users", "products", "starts")  # kept as differences
_TOP = "user_id long, neighbor_id long, dist double"


def user_blocks(matrix: DataFrame, block_slots: int = BLOCK_SLOTS) -> DataFrame:
    """(user_id, block) of every user of the matrix, one without nonzero cells too."""
    users = matrix.groupBy("user_id").agg(
        F.count_if(F.col("score") != 0).alias("n"),
        F.max(F.when(F.col("score") != 0, F.struct(F.abs("score").alias("a"), F.col("product_id").alias("p")))).alias("best"))
    users = materialize(users.select("user_id", "best.p", (F.lit(1) + F.floor(F.col("n") / SLOT_CELLS)).alias("w")))
    head = users.select("user_id").orderBy("user_id").limit(block_slots).agg(F.max("user_id")).first()[0]
    late = F.col("user_id") > F.lit(head)
    ordered = running_total(users, [late.asc(), F.when(late, F.col("p")).asc(), F.col("user_id").asc()], "w", "before")
    return ordered.select("user_id", F.floor(F.col("before") / block_slots).cast("long").alias("block"))


def narrowed(x: np.ndarray) -> bytes:
    """The array in the narrowest type that holds its values, compressed, after the type's name."""
    with np.errstate(invalid="ignore"):
        kind = next((k for k in ("i1", "i2", "i4", "i8") if np.array_equal(x.astype(f"<{k}"), x)), "f8")
    return kind.encode() + zlib.compress(x.astype(f"<{kind}").tobytes(), 1)


def widened(raw: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw[2:]), dtype=f"<{bytes(raw[:2]).decode()}").astype(kind)


class Block:
    """An unpacked block: cells by product, each product's by user."""

    def __init__(self, row: Mapping):
        self.block = int(row["block"])
        self.users = np.frombuffer(row["users"], dtype="<i8")
        self.products = np.asarray(row["products"])
        self.starts = np.frombuffer(row["starts"], dtype="<i8")
        self.who = np.frombuffer(row["who"], dtype="<i4")
        self.score = np.frombuffer(row["score"], dtype="<f8")
        self.norm = np.sqrt(np.bincount(self.who, self.score * self.score, len(self.users)))

    @cached_property
    def names(self) -> pd.Index:
        return pd.Index(self.products)

    def class_norms(self) -> np.ndarray:
        """Norm of each user's unit vector within each product class."""
        out = np.zeros((len(self.users), CLASSES))
        column = np.repeat(self.products % CLASSES, np.diff(self.starts))
        np.add.at(out, (self.who, column), self.score * self.score)
        return np.sqrt(out) / np.where(self.norm > 0, self.norm, 1.0)[:, None]


def unpacked(row: Mapping) -> Block:
    """The block of a packed row."""
    rising = {c: np.cumsum(widened(row[c], "<i8")) for c in _RISING}
    return Block({"block": row["block"], **rising, "who": widened(row["who"], "<i4"), "score": widened(row["score"], "<f8")})


def pack(matrix: DataFrame, block_slots: int = BLOCK_SLOTS) -> DataFrame:
    """One row per block of users (checkpointed)."""
    nz = matrix.where(F.col("score") != 0).select("user_id", "product_id", F.col("score").cast("double").alias("score"))
    numbers = global_rank(nz.select("product_id").where(F.col("product_id").isNotNull()).distinct(), [F.col("product_id")], "code")
    cells = user_blocks(matrix, block_slots).join(nz.join(numbers, "product_id").drop("product_id"), "user_id", "left")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        users, who = np.unique(rows["user_id"].to_numpy(), return_inverse=True)
        there = rows["code"].notna().to_numpy()
        products, column = np.unique(rows["code"].to_numpy()[there].astype(np.int64), return_inverse=True)
        who, score = who[there], rows["score"].to_numpy()[there]
        order = np.lexsort((who, column))
        plain = {"block": rows["block"].iloc[0], "users": users.astype("<i8"), "products": products,
                 "starts": np.concatenate(([0], np.cumsum(np.bincount(column, minlength=len(products))))).astype("<i8"),
                 "who": who[order].astype("<i4"), "score": score[order].astype("<f8")}
        row = {c: narrowed(np.diff(x, prepend=0) if c in _RISING else x) for c, x in plain.items() if c != "block"}
        return pd.DataFrame([{"block": plain["block"], **row,
                              "summary": Block(plain).class_norms().max(axis=0).astype("<f4").tobytes()}])
    return materialize(cells.groupBy("block").applyInPandas(run, _PACK))


def _squad_size(blocks: DataFrame) -> tuple[int, int | None]:
    """(blocks of a squad, last block) of packed blocks."""
    size = F.length("users") + F.length("products") + F.length("starts") + F.length("who") + F.length("score")
    n, size, last = blocks.agg(F.count(F.lit(1)), F.avg(size), F.max("block")).first()
    return squad_size(n, size or 0), last


def tile(left: Block, right: Block, overlap: bool = False) -> Iterator[tuple]:
    """(first left user, dots, numbers of shared products) for ``ROWS`` left
    users at a time; without ``overlap`` the last is None."""
    at = right.names.get_indexer(left.names) if len(left.products) else np.zeros(0, int)
    shared = np.flatnonzero(at >= 0)
    n_left, n_right = len(left.users), len(right.users)
    right_size = np.diff(right.starts)[at[shared]] if len(shared) else np.zeros(0, int)
    column = np.repeat(np.arange(len(left.products)), np.diff(left.starts))
    place = np.full(len(left.products), -1)
    place[shared] = np.arange(len(shared))
    column = place[column]
    for lo in range(0, n_left, ROWS):
        n = min(ROWS, n_left - lo)
        mine = (left.who >= lo) & (left.who < lo + n) & (column >= 0)
        who, col, score = left.who[mine] - lo, column[mine], left.score[mine]
        dots = np.zeros((n, n_right))
        count = np.zeros((n, n_right)) if overlap else None
        work = np.bincount(col, minlength=len(shared)) * right_size
        heavy = work * GEMM_SHARE > n * n_right
        number = np.cumsum(heavy) - 1
        for first in range(0, int(heavy.sum()), GEMM_COLUMNS):
            some = np.flatnonzero(heavy & (number >= first) & (number < first + GEMM_COLUMNS))
            a, b = np.zeros((n, len(some))), np.zeros((n_right, len(some)))
            own = heavy[col] & (number[col] >= first) & (number[col] < first + GEMM_COLUMNS)
            a[who[own], number[col[own]] - first] = score[own]
            for k, s in enumerate(some.tolist()):
                x, y = right.starts[at[shared[s]]], right.starts[at[shared[s]] + 1]
                b[right.who[x:y], k] = right.score[x:y]
            dots += a @ b.T
            if overlap:
                count += (a != 0).astype(float) @ (b != 0).astype(float).T
        light = ~heavy[col]
        who, col, score = who[light], col[light], score[light]
        begin, size = right.starts[at[shared[col]]], right_size[col]
        total = np.cumsum(size)
        x = 0
        while x < len(col):
            done = total[x - 1] if x else 0
            y = max(int(np.searchsorted(total, done + EXPANSION, side="right")), x + 1)
            cell = np.repeat(np.arange(x, y), size[x:y])
            match = np.repeat(begin[x:y] - (total[x:y] - size[x:y] - done), size[x:y]) + np.arange(len(cell))
            flat = who[cell] * n_right + right.who[match]
            dots += np.bincount(flat, score[cell] * right.score[match], n * n_right).reshape(n, n_right)
            if overlap:
                count += np.bincount(flat, minlength=n * n_right).reshape(n, n_right)
            x = y
        yield lo, dots, count


def distances(dots: np.ndarray, left_norm: np.ndarray, right_norm: np.ndarray) -> np.ndarray:
    """Cosine distances in [0, 2] to 9 places; 1 where a user has no nonzero cell."""
    scale = left_norm[:, None] * right_norm[None, :]
    d = np.divide(dots, scale, out=np.zeros_like(dots), where=scale > 0)
    return np.round(np.clip(1.0 - d, 0.0, 2.0), 9) + 0.0


def tile_top(left: Block, right: Block, k: int, both: bool) -> list[tuple]:
    """(users, their neighbours, distances): the k nearest users of the right block for
    every left user and, if ``both``, the other way round."""
    from vitrine.operators.vectors import _select_topk
    out, back = [], []
    order_left, order_right = np.arange(len(left.users)), np.arange(len(right.users))
    for lo, dots, _ in tile(left, right):
        n = len(dots)
        d = distances(dots, left.norm[lo:lo + n], right.norm)
        rows, cols, near = _select_topk(-d, order_right, k)
        out.append((left.users[lo + rows], right.users[cols], -near + 0.0))
        if both:
            rows, cols, near = _select_topk(np.ascontiguousarray(-d.T), order_left[lo:lo + n], k)
            back.append((rows, lo + cols, -near + 0.0))
    if back:
        rows, cols, d = [np.concatenate(x) for x in zip(*back, strict=True)]
        order = np.lexsort((cols, d, rows))  # the k best of all slices
        rows, cols, d = rows[order], cols[order], d[order]
        begin = np.searchsorted(rows, rows)
        keep = np.arange(len(rows)) - begin < k
        out.append((right.users[rows[keep]], left.users[cols[keep]], d[keep]))
    return out


def sparse_top(left: Block, right: Block, k: int, left_limit: np.ndarray, right_limit: np.ndarray) -> list[tuple] | None:
    """``tile_top`` both ways from the matching cells alone, of pairs that share a
    product and are within the limit of the user; None if the tile is not sparse."""
    if not (len(left.products) and len(right.products)):
        return []
    at = right.names.get_indexer(left.names)
    own = np.repeat(at, np.diff(left.starts))  # by cell, the product's place on the right
    cells = np.flatnonzero(own >= 0)
    begin, size = right.starts[own[cells]], np.diff(right.starts)[own[cells]]
    n = int(size.sum())
    if n > EXPANSION or n * SPARSE_SHARE > len(left.users) * len(right.users):
        return None
    cell = np.repeat(cells, size)
    match = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(n)
    flat = left.who[cell].astype(np.int64) * len(right.users) + right.who[match]
    order = np.argsort(flat, kind="stable")
    flat = flat[order]
    start = np.flatnonzero(np.append(True, flat[1:] != flat[:-1])) if n else np.zeros(0, int)
    dots = np.add.reduceat((left.score[cell] * right.score[match])[order], start) if n else np.zeros(0)
    rows, cols = np.divmod(flat[start], len(right.users))
    d = np.round(np.clip(1.0 - dots / (left.norm[rows] * right.norm[cols]), 0.0, 2.0), 9) + 0.0
    out = []
    for mine, theirs, users, others, limit in ((rows, cols, left.users, right.users, left_limit),
                                               (cols, rows, right.users, left.users, right_limit)):
        some = np.flatnonzero(d <= limit[mine])
        some = some[np.lexsort((theirs[some], d[some], mine[some]))]
        keep = some[np.arange(len(some)) - np.searchsorted(mine[some], mine[some]) < k]
        out.append((users[mine[keep]], others[theirs[keep]], d[keep]))
    return out


def _frame(parts: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame({n: np.concatenate(x) for n, x in zip(names, zip(*parts, strict=True), strict=True)})


def _settle(blocks: DataFrame, k: int) -> DataFrame:
    """(block, top, probe, limits, wide): each block against itself and block 0 (both
    ways); ``probe`` holds the similarity that each user's bound must reach,
    then the user's class norms, ``limits`` each user's k-th distance; ``wide``
    if a later user without overlap can still be among some user's k nearest."""
    first = blocks.where("block = 0").first()  # of bounded weight
    head_row = first.asDict() if first else None

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        own, head = unpacked(rows.iloc[0]), unpacked(head_row)
        parts = tile_top(own, own, k, False)
        if own.block:
            parts += tile_top(own, head, k, True)
        top = _frame(parts, ["user_id", "neighbor_id", "dist"]).sort_values(["user_id", "dist", "neighbor_id"])
        place = top.groupby("user_id").cumcount()
        top, last = top[place < k], top[place == k - 1].set_index("user_id").reindex(own.users)
        dist, by = last["dist"].fillna(3.0).to_numpy(), last["neighbor_id"].fillna(0).to_numpy()
        # a k-th place at distance 1 in block 0 stays ahead of all users of later blocks without overlap
        settled = (np.abs(dist - 1.0) < 1e-8) & (by <= head.users[-1])
        must = np.where(settled, 1e-12, 1.0 - dist - np.where(np.abs(dist - 1.0) < 1e-8, 1.0, SLACK))
        probe = np.concatenate((must[:, None], own.class_norms()), axis=1).astype("<f4")
        return pd.DataFrame([{"block": own.block, "top": top.to_dict("records"), "probe": zlib.compress(probe.tobytes(), 1),
                              "limits": narrowed(dist),
                              "wide": bool(((dist > 1.0 - 1e-8) & ~settled).any())}])
    return materialize(by_block(blocks).applyInPandas(
        run, "block long, top array<struct<user_id:long,neighbor_id:long,dist:double>>, probe binary, "
             "limits binary, wide boolean"))


def open_pairs(blocks: DataFrame, settled: DataFrame) -> DataFrame:
    """(bl, br), bl < br: the pairs of later blocks that can hold a nearer neighbour."""
    stripes = blocks.where("block > 0").select("block", "summary", F.floor(F.col("block") / STRIPE).alias("stripe"))
    probes = settled.where("block > 0").select("block", "probe")
    n = stripes.select("stripe").distinct().select(F.col("stripe").alias("to"))
    # blocks x stripes of STRIPE summaries each
    probes = probes.withColumn("stripe", F.explode(F.array(*[F.lit(r["to"]) for r in n.collect()] or [F.lit(0)])))
    shared = stripes.groupBy("stripe").agg(F.collect_list(F.struct("block", "summary")).alias("held"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block, probe, held in (row for rows in batches for row in rows.itertuples(index=False)):
            own = np.frombuffer(zlib.decompress(probe), dtype="<f4").reshape(-1, CLASSES + 1)
            to = np.array([h["block"] for h in held])
            bound = own[:, 1:] @ np.stack([np.frombuffer(h["summary"], dtype="<f4") for h in held]).T
            need = to[(bound >= own[:, :1]).any(axis=0) & (to != block)]
            yield pd.DataFrame({"bl": np.minimum(need, block), "br": np.maximum(need, block)})
    # the summaries go to the probes where they lie: dealt by stripe, those would be in as many tasks as there are stripes
    return (probes.join(F.broadcast(shared), "stripe").select("block", "probe", "held")
            .mapInPandas(run, "bl long, br long").distinct())


def nearest(matrix: DataFrame, k: int, block_slots: int = BLOCK_SLOTS) -> DataFrame:
    """(user_id, neighbor_id, nrank, dist): the k nearest users of every user,
    the user included, by distance, then id."""
    blocks = pack(matrix, block_slots)
    settled = _settle(blocks, k)

    names = ["user_id", "neighbor_id", "dist"]
    limited = blocks.drop("summary").join(settled.select("block", "limits", "wide"), "block")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        near = Nearest(names, k, True)
        rows, others = right.to_dict("records"), [set(x) for x in left["others"]] if len(left) else []
        for lo in range(0, len(rows), HELD):
            held = [(row["block"], unpacked(row), widened(row["limits"], "<f8"), row["wide"]) for row in rows[lo:lo + HELD]]
            for row, met in zip(left.to_dict("records"), others, strict=True):
                some = [x for x in held if x[0] in met]
                if not some:
                    continue
                own, limit, parts = unpacked(row), widened(row["limits"], "<f8"), []
                for _, block, its, wide in some:
                    found = None if wide or row["wide"] else sparse_top(own, block, k, limit, its)
                    parts += tile_top(own, block, k, True) if found is None else found
                    if sum(len(p[0]) for p in parts) > 100_000:
                        near.add(_frame(parts, names))
                        parts = []
                if parts:
                    near.add(_frame(parts, names))
        return near.best()
    found = (settled.select(F.explode("top").alias("t")).select("t.*").unionByName(
        squad_pairs(limited, limited, open_pairs(blocks, settled), _squad_size(blocks)[0]).applyInPandas(run, _TOP)))
    w = Window.partitionBy("user_id").orderBy("dist", "neighbor_id")
    return (found.withColumn("nrank", F.row_number().over(w)).where(F.col("nrank") <= k)
            .select("user_id", "neighbor_id", "nrank", "dist"))


def mirrored(left: Block, right: Block) -> Iterator[tuple]:
    """(users, others, dots, distances) of all pairs that share a product, both
    directions, for ``MIRRORED`` left users at a time.  A left user's pairs are
    followed at once by the same pairs the other way round: column files then
    hold their dots and distances about once, and no more than a slice is held."""
    for first, dots, count in tile(left, right, overlap=True):
        for at in range(0, len(dots), MIRRORED):
            own, lo = dots[at:at + MIRRORED], first + at
            d = distances(own, left.norm[lo:lo + len(own)], right.norm)
            some = count[at:at + MIRRORED] > 0
            if left.block == right.block:  # each pair once
                some &= np.arange(lo, lo + len(own))[:, None] < np.arange(len(right.users))
            rows, cols = np.nonzero(some)
            each = some.sum(axis=1)
            there = np.arange(len(rows)) + (np.cumsum(each) - each)[rows]
            back = there + each[rows]
            users, others = np.empty((2, 2 * len(rows)), np.int64)
            users[there] = others[back] = left.users[lo + rows]
            users[back] = others[there] = right.users[cols]
            dot, dist = np.empty(2 * len(rows), np.int64), np.empty(2 * len(rows))
            dot[there] = dot[back] = own[rows, cols]
            dist[there] = dist[back] = d[rows, cols]
            yield users, others, dot, dist


def overlapping(matrix: DataFrame, block_slots: int = BLOCK_SLOTS) -> DataFrame:
    """(user_id, other_id, dot, dist) of all users that share a product.  Blocks
    meet in pairs of squads: a block travels once per squad, not once per block,
    and compressed; only the two blocks of a tile are unpacked at a time."""
    blocks = pack(matrix, block_slots).drop("summary")
    held, last = _squad_size(blocks)
    squads = (last or 0) // held + 1
    squad, other = F.floor(F.col("block") / held), F.explode(F.sequence(F.lit(0), F.lit(squads - 1)))
    met = blocks.select("*", squad.alias("squad"), other.alias("other")).select(
        *blocks.columns, F.least("squad", "other").alias("gl"), F.greatest("squad", "other").alias("gr"), "squad")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [row for frame in frames for row in frame.to_dict("records")]
        for left in rows:
            # in a squad with itself, each pair of blocks once
            right = [row for row in rows if row["squad"] == row["gr"] and row["block"] >= left["block"]]
            if left["squad"] == left["gl"]:
                a = unpacked(left)
                for row in right:
                    for part in mirrored(a, unpacked(row)):
                        yield pd.DataFrame(dict(zip(["user_id", "other_id", "dot", "dist"], part, strict=True)))
    # more tasks than groups, as some get several
    return (met.repartition(min(2 * squads * (squads + 1), PAIR_TASKS), "gl", "gr").groupBy("gl", "gr")
            .applyInPandas(run, "user_id long, other_id long, dot long, dist double"))
