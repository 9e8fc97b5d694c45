"""N-gram Jaccard join by a token-group matrix.

A document is its set of distinct word shingles; equal sets are one class.
Classes are partitioned into groups of similar ones (equal lowest hash; large
groups are split).  The matrix holds, for each token of a group's union of
prefixes, the group; a prefix holds the n - ceil(t * n) + OVERLAP first tokens
of a set in a global order (rare ones first), of which similar sets share
OVERLAP (or, if they are smaller, ceil(t * n)).  Two groups that share so many
tokens and whose sizes fit qualify.  A qualifying pair is opened at one of the
two groups: a member of the other whose overlap with the group's token union
falls short of t * n is passed over, the rest is compared exactly.  A group
with many partners is opened in several tasks, ``PARTNERS`` of them in each.
Links between classes give the components.

The global order comes from a sketch of fixed size (``SLOTS`` counts, 1 MB):
whatever it holds, the order is the same everywhere, so no link is lost.

Defined results: A-Z are lower-cased; a null or empty text, or one without
words, has the empty set and is its own component; repeated rows and rows of
equal ids share a class if their texts do (the id then has the lowest component
of its rows); null ids are left out; an empty table gives an empty table; of
the input only id and text are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.llm.common import mix64, release, shingle_hashes, text_or_empty, word_hashes
from vitrine.session import materialize

SHINGLE = 3
PERCENT = 90
#: Counters of the frequency sketch, sent in ``CHUNKS`` parts.
SLOTS = 1 << 17
CHUNKS = 64
#: Tokens that a group holds, about.
GROUP_TOKENS = 100_000
#: Members that a group has, about.
GROUP_MEMBERS = 500
#: Tokens of their prefixes that two groups must share.
OVERLAP = 4
#: Partners of a group that are looked at in one task, about.
PARTNERS = 32
#: Characters whose words are hashed at once.
SLICE_CHARS = 1_000_000
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingles(texts: list[str], n: int) -> Iterator[np.ndarray]:
    """Hashes of the shingles of each text, repeated ones too; words are hashed
    for ``SLICE_CHARS`` of texts at once."""
    held, chars = [], 0
    for k, text in enumerate(texts, 1):
        held.append(text.encode().translate(_LOWER).split())
        chars += len(text)
        if chars < SLICE_CHARS and k < len(texts):
            continue
        words = word_hashes([w for own in held for w in own])
        whole = shingle_hashes(words, n) if len(words) >= n else words[:0]
        at = 0
        for own in held:
            yield whole[at:at + len(own) - n + 1] if len(own) >= n else shingle_hashes(words[at:at + len(own)], n)
            at += len(own)
        held, chars = [], 0


def token_set(text: str, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    return np.unique(next(shingles([text], n)))


def needed(size: int, percent: int) -> int:
    """Least overlap of a set of this size with a similar one."""
    return -(-size * percent // 100)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       text_or_empty(text_col).alias("text")).filter("doc_id is not null")


def frequency_sketch(texts: DataFrame, n: int = SHINGLE) -> np.ndarray:
    """Counts of tokens by slot; partial counts are summed in two steps."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, salt = np.zeros(SLOTS, dtype=np.int64), 0
        for b in batches:
            ids = b.column(0)
            salt = int(ids[0].as_py()) % 32 if b.num_rows else salt
            held, size = [], 0
            for t in shingles(b.column(1).to_pylist(), n):
                held.append((t & np.uint64(SLOTS - 1)).astype(np.int32))
                size += len(t)
                if size > SLOTS:
                    total += np.bincount(np.concatenate(held), minlength=SLOTS)
                    held, size = [], 0
            if held:
                total += np.bincount(np.concatenate(held), minlength=SLOTS)
        parts = total.reshape(CHUNKS, -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(CHUNKS), pa.int32()), pa.array([salt] * CHUNKS, pa.int32()),
             pa.array([p.tobytes() for p in parts], pa.binary())], ["chunk", "salt", "counts"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(SLOTS // CHUNKS, dtype=np.int64)
        for raw in pdf["counts"]:
            total += np.frombuffer(raw, dtype=np.int64)
        return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1], "salt": pdf["salt"].iloc[:1], "counts": [total.tobytes()]})
    schema = "chunk int, salt int, counts binary"
    parts = (texts.mapInArrow(count, schema).groupBy("chunk", "salt").applyInPandas(add, schema)
             .groupBy("chunk").applyInPandas(add, schema).collect())
    out = np.zeros((CHUNKS, SLOTS // CHUNKS), dtype=np.int64)
    for r in parts:
        out[r["chunk"]] = np.frombuffer(r["counts"], dtype=np.int64)
    return out.ravel()


def prefix_of(tokens: np.ndarray, order: np.ndarray, percent: int) -> np.ndarray:
    """The first tokens of a sorted set, by count and then value."""
    keep = min(len(tokens), len(tokens) - needed(len(tokens), percent) + OVERLAP)
    count = order[(tokens & np.uint64(SLOTS - 1)).astype(np.int64)]
    last = np.partition(count, keep - 1)[keep - 1]
    below = count < last
    return np.concatenate([tokens[below], tokens[count == last][:keep - int(below.sum())]])


def pack_tokens(tokens: np.ndarray) -> bytes:
    """The 48 upper bits of each token."""
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def unpack_tokens(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 6, 8), dtype=np.uint8)
    wide[:, 2:] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 6)
    return np.unique(wide.view("<u8").ravel())


def token_sets(texts: DataFrame, order: np.ndarray, n: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, low, prefix): digest of the set, its
    lowest hash, its prefix."""
    shared = texts.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        for b in batches:
            out = []
            for t in map(np.unique, shingles(b.column(1).to_pylist(), n)):
                if len(t):
                    low = int(mix64(t).min() >> np.uint64(1))
                    out.append((len(t), xxhash.xxh3_128_digest(t.tobytes()), low,
                                prefix_of(t, shared.value, percent).astype(np.int64)))
                else:
                    out.append((0, b"", 0, np.empty(0, dtype=np.int64)))
            if out:
                size, key, low, prefix = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(size, pa.int64()), pa.array(key, pa.binary()), pa.array(low, pa.int64()),
                     pa.array(prefix, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_key", "low", "prefix"])
    return texts.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, low long, prefix array<long>")


class Classes:
    """Components of a few sets, by the links looked at so far."""

    def __init__(self, size: int):
        self.parent = list(range(size))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, k: int) -> None:
        a, b = self.root(i), self.root(k)
        self.parent[max(a, b)] = min(a, b)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common elements of two sorted sets."""
    if not len(b):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Exact test: 100 * intersection >= percent * union."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    both = overlap(small, large)
    return 100 * both >= percent * (len(a) + len(b) - both)


class Opened:
    """One group, opened: its members, their token union, and what is known of
    the components of its members and its partners' ones."""

    def __init__(self, percent: int):
        self.percent = percent
        self.ids: list[int] = []
        self.sets: list[np.ndarray] = []
        self.classes = Classes(0)
        self.union: np.ndarray | None = None
        self.seen: set[tuple[int, int]] = set()

    def links(self, rep: int, tokens: np.ndarray, member: bool) -> list[tuple[int, int]]:
        """New links of a set with the members so far, one for each component
        it meets; a member is then one of them."""
        if member:
            row = (rep, hash(tokens.tobytes()))
            if row in self.seen:  # a repeated row
                return []
            self.seen.add(row)
        found, own = [], len(self.classes.parent)
        self.classes.parent.append(own)
        if not member and self.union is None:
            self.union = np.unique(np.concatenate(self.sets)) if self.sets else np.empty(0, dtype=np.uint64)
        if member or overlap(tokens, self.union) >= needed(len(tokens), self.percent):
            for k, other in enumerate(self.sets):
                if self.classes.root(k) != self.classes.root(own) and linked(tokens, other, self.percent):
                    self.classes.join(k, own)
                    found.append((rep, self.ids[k]))
        if member:
            self.ids.append(rep)
            self.sets.append(tokens)
        return found


def components(links: DataFrame) -> DataFrame:
    """(node, component) of the nodes of links (a, b), by alternating large
    and small stars; the edges are checkpointed each round."""
    edges = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                        .filter("a <> b").distinct())

    def mark(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    state = mark(edges)
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
            F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct()
        edges = materialize(small)
        now = mark(edges)
        if now == state:
            break
        state = now
    return (edges.groupBy("a").agg(F.min("b").alias("component"))
            .select(F.col("a").alias("node"), "component"))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
         percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    texts = _texts(docs, id_col, text_col)
    order = frequency_sketch(texts, shingle)
    sets = materialize(token_sets(texts, order, shingle, percent))
    some = sets.filter("n_shingles > 0")
    classes = materialize(some.groupBy("set_key").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("low").alias("low"),
        F.first("prefix").alias("prefix")))
    # an id with several different texts: its classes are linked by the id
    twice = (some.groupBy("doc_id").agg(F.count_distinct("set_key").alias("k")).filter("k > 1")
             .join(some, "doc_id").join(classes.select("set_key", "rep"), "set_key")
             .select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    splits = classes.groupBy("low").agg(
        F.ceil(F.greatest(F.sum("n") / GROUP_TOKENS, F.count("rep") / GROUP_MEMBERS)).alias("splits"))
    groups = materialize(classes.join(splits, "low").select(
        "set_key", "rep", "n", "prefix", F.xxhash64("low", F.pmod(F.xxhash64("set_key"), "splits")).alias("group")))
    spread = groups.groupBy("group").agg(F.min("n").alias("n_min"), F.max("n").alias("n_max"), F.count("rep").alias("members"))
    # one shuffle by token serves the sums by group and the count of a token's groups
    matrix = (groups.select("group", F.explode("prefix").alias("token"), "n").repartition("token")
              .groupBy("token", "group").agg(F.min("n").alias("n_min"), F.max("n").alias("n_max"))
              .withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("token"))))
    matrix = materialize(matrix.filter("k > 1").drop("k"))
    left, right = matrix.alias("x"), matrix.alias("y")
    least = F.expr(f"least({OVERLAP}, (x.n_min * {percent} + 99) div 100, (y.n_min * {percent} + 99) div 100)")
    pairs = materialize(
        left.join(right, (F.col("x.token") == F.col("y.token")) & (F.col("x.group") < F.col("y.group"))
                  & F.expr(f"100 * x.n_max >= {percent} * y.n_min and 100 * y.n_max >= {percent} * x.n_min"))
        .groupBy(F.col("x.group").alias("g"), F.col("y.group").alias("h"))
        .agg(F.count(F.lit(1)).alias("shared"), F.min(least).alias("least"))
        .filter("shared >= least").select("g", "h"))
    # a pair is opened at g, in the part of g's partners that h falls into
    parts = pairs.groupBy("g").agg(F.ceil(F.count("h") / PARTNERS).alias("parts"))
    placed = pairs.join(parts, "g").select("g", "h", F.pmod(F.xxhash64("h"), "parts").cast("int").alias("part"))
    places = (spread.filter("members > 1").select(F.col("group").alias("g"), F.lit(0).alias("part"))
              .union(placed.select("g", "part")).distinct()
              .select(F.col("g").alias("group"), "g", "part", F.lit(False).alias("partner"))
              .union(placed.select(F.col("h").alias("group"), "g", "part", F.lit(True))))
    wanted = (groups.join(places.groupBy("group").agg(F.collect_list(F.struct("g", "part", "partner")).alias("places")), "group")
              .select(F.col("rep").alias("doc_id"), "set_key", "group", "places"))

    def retell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        now, told = None, set()
        for b in batches:
            rows = zip(*[c.to_pylist() for c in b.columns[:3]], strict=True)
            texts_ = b.column(3).to_pylist()
            keep, tokens = [], []
            for k, ((i, key, _), t) in enumerate(zip(rows, map(np.unique, shingles(texts_, shingle)), strict=True)):
                if i != now:
                    now, told = i, set()
                # not another text of the same id, nor a repeated row
                if bytes(key) not in told and xxhash.xxh3_128_digest(t.tobytes()) == bytes(key):
                    told.add(bytes(key))
                    keep.append(k)
                    tokens.append(pack_tokens(t))
            if keep:
                at = pa.array(keep, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(at), b.column(2).take(at), pa.array(tokens, pa.binary())], ["rep", "places", "tokens"])
    members = (wanted.join(texts, "doc_id").select("doc_id", "set_key", "places", "text")
               .mapInArrow(retell, "rep long, places array<struct<g:long,part:int,partner:boolean>>, tokens binary")
               .select("rep", F.explode("places").alias("at"), "tokens").select("at.*", "rep", "tokens"))

    def open_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, opened = None, Opened(percent)
        for b in batches:
            out = []
            g, part, partner, rep, tokens = [b.column(k) for k in range(5)]
            for k in range(b.num_rows):
                here = (g[k].as_py(), part[k].as_py())
                if here != place:
                    place, opened = here, Opened(percent)
                member = not partner[k].as_py()
                new = opened.links(rep[k].as_py(), unpack_tokens(tokens[k].as_py()), member)
                # links within a group are told once, by its first part
                out += new if not member or here[1] == 0 else []
            if out:
                a, c = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c)], ["a", "b"])
    across = (members.repartition("g", "part").sortWithinPartitions("g", "part", "partner")
              .mapInArrow(open_all, "a long, b long"))
    found = components(across.union(twice))
    by_class = classes.join(found, classes["rep"] == found["node"], "left").select(
        "set_key", F.coalesce("component", "rep").alias("component_id"))
    return sets.join(by_class, "set_key", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5,
                    percent: int = 80) -> DataFrame:
    """The documents with the lowest id of each component, all columns.  Rows
    with a null id stay; of the rows of one id with equal sets, the one with
    the lowest text stays."""
    # a row travels in one struct, so its columns clash with none of these
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("doc_id"),
                       text_or_empty(text_col).alias("text"))
    repeated = rows.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select(
        F.col("doc_id").alias("again"))
    kept = materialize(join(docs, id_col, text_col, shingle, percent).filter("doc_id = component_id")
                       .select("doc_id").distinct().join(repeated, F.col("doc_id") == F.col("again"), "left"))
    release(docs.sparkSession)  # the shuffles of the join
    # texts are dealt once, by the ids that stay
    out = (rows.join(kept.filter("again is null").select("doc_id"), "doc_id", "left_semi").select("row.*")
           .unionAll(rows.filter("doc_id is null").select("row.*")))
    several = kept.filter("again is not null").select("doc_id")
    if several.isEmpty():
        return out

    @F.pandas_udf("binary")
    def set_key(texts: pd.Series) -> pd.Series:
        import xxhash
        return pd.Series([xxhash.xxh3_128_digest(np.unique(t).tobytes()) for t in shingles(texts.tolist(), shingle)], dtype=object)
    # of equal ids and sets the lowest text, of equal texts the row that is least as JSON
    one = (rows.join(several, "doc_id", "left_semi").select("doc_id", set_key("text").alias("set"), "row", "text")
           .groupBy("doc_id", "set").agg(F.min_by("row", F.struct("text", F.to_json("row"))).alias("row")))
    return out.unionAll(one.select("row.*"))
