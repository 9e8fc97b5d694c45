"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The pre-tokens of a slice of the corpus (what one task holds of it) are laid
out once each in one symbol array.  An inverted index takes a token pair to
the positions where it occurs; the merges are replayed over all words at once
in rank order, and a merge touches only its own positions and their two
neighbours, whose new pairs enter the index.  Documents are then spelled out
from the ids of their words.  There is no shuffle: a task's slice shares
nothing with others except the rank table.

Defined results: a null text is the empty text (no ids); repeated rows give
repeated rows; an empty table gives an empty table; other columns of the
input are ignored, so clashing names do no harm.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import map_batches, text_or_empty

#: Words kept between batches of a worker; emptied when full (bounded memory).
CACHE_WORDS = 900_000
#: Words of one replay; more are replayed in several runs (bounded memory).
REPLAY_WORDS = 250_000

#: ``\s`` of the split pattern is Unicode white space; Python's also takes
#: the separators U+001C-U+001F, so the class is written out.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


class RankTable:
    """Ranks of a byte-level vocabulary, and the pairs that merge."""

    def __init__(self, path: str, pattern: str):
        import regex
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
        size = max(self.ranks.values()) + 1
        self.size = size
        self.bytes_of = [b""] * size
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        explicit = pattern.replace(r"[^\s", f"[^{_SPACE}").replace(r"\S", f"[^{_SPACE}]").replace(
            r"\s", f"[{_SPACE}]")
        self.split = regex.compile(explicit).findall
        keys, ranks = [], []
        # a rank is early if one of its merges can make a pair of lower rank:
        # such merges are replayed one occurrence a word at a time
        early = np.zeros(size, dtype=bool)
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a * size + b)
                    ranks.append(rank)
                    for part in (a, b):
                        if part > rank:
                            early[part] = True
        order = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
        self.pair_keys = np.array(keys, dtype=np.int64)[order]
        self.pair_ranks = np.array(ranks, dtype=np.int64)[order]
        self.early = early

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it does not merge."""
        key = left * self.size + right
        at = np.searchsorted(self.pair_keys, key)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], -1)

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and where each word's ids end."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(lengths)
        n = int(ends[-1]) if len(words) else 0
        symbol = self.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
        word = np.repeat(np.arange(len(words)), lengths)
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        nxt[ends - 1] = -1
        prv[ends - lengths] = -1
        alive = np.ones(n, dtype=bool)
        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def add(positions: np.ndarray) -> None:
            """Enter the pairs that begin at the positions into the index."""
            positions = positions[nxt[positions] >= 0]
            rank = self.pair_rank(symbol[positions], symbol[nxt[positions]])
            known = rank >= 0
            positions, rank = positions[known], rank[known]
            if not len(rank):
                return
            order = np.argsort(rank, kind="stable")
            positions, rank = positions[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for r, group in zip(rank[np.r_[0, cuts]].tolist(), np.split(positions, cuts), strict=True):
                if r not in index:
                    index[r] = []
                    heapq.heappush(queue, r)
                index[r].append(group)

        add(np.arange(n))
        while queue:
            rank = heapq.heappop(queue)
            lists = index.pop(rank)
            at = np.sort(lists[0] if len(lists) == 1 else np.concatenate(lists))
            if len(at) > 1:
                at = at[np.r_[True, at[1:] != at[:-1]]]
            # entries whose symbols have changed since are stale
            at = at[alive[at] & (nxt[at] >= 0)]
            right = nxt[at]
            at = at[self.pair_rank(symbol[at], symbol[right]) == rank]
            if not len(at):
                continue
            if self.early[rank]:
                first = np.r_[True, word[at[1:]] != word[at[:-1]]]
                if not first.all():
                    index[rank] = [at[~first]]
                    heapq.heappush(queue, rank)
                at = at[first]
            elif len(at) > 1:
                # overlapping occurrences (aaa): every other one of a run, from the left
                linked = nxt[at[:-1]] == at[1:]
                if linked.any():
                    start = np.flatnonzero(np.r_[True, ~linked])
                    place = np.arange(len(at)) - np.repeat(start, np.diff(np.r_[start, len(at)]))
                    at = at[place % 2 == 0]
            right = nxt[at]
            after, before = nxt[right], prv[at]
            symbol[at] = rank
            alive[right] = False
            nxt[at] = after
            prv[after[after >= 0]] = at[after >= 0]
            add(np.concatenate([before[before >= 0], at]))
        # a word that is itself in the vocabulary is one id
        left = np.add.reduceat(alive, ends - lengths) if n else np.zeros(0, dtype=np.int64)
        for i in np.flatnonzero(left > 1).tolist():
            whole = self.ranks.get(words[i])
            if whole is not None:
                a = int(ends[i] - lengths[i])
                symbol[a] = whole
                alive[a + 1:int(ends[i])] = False
                left[i] = 1
        return symbol[alive], np.cumsum(left)


@lru_cache(maxsize=2)
def rank_table(path: str, pattern: str) -> RankTable:
    return RankTable(path, pattern)


_GLUED = re.compile(r"(?<=\S) (?=\S)")
_STOPS = ".,;:!?"


class Encoder:
    """Ids of texts; keeps the ids of a bounded number of chunks.

    No pre-token runs over a lone space or line feed between two other
    characters: a space opens the next pre-token, a line feed is one.  So a
    text is cut there and equal chunks are looked up.  A chunk's key is the
    chunk without its space; one that opens a line is marked by U+0000.  A
    chunk that is empty or bounded by white space shows that the cut was not
    such a place: its text is cut by the strict pattern instead, with keys
    marked by U+0001.
    """

    def __init__(self, table: RankTable):
        self.table = table
        self.known: dict[str, bytes | None] = {}

    def pieces(self, key: str) -> tuple[str, ...] | list[str] | None:
        """Pre-tokens of a chunk; None if its text needs the strict cut."""
        if key[:1] == "\x01":
            return self.table.split(key[1:])
        if key == "\n":
            return (key,)
        lead, body = ("", key[1:]) if key[:1] == "\x00" else (" ", key)
        if body.isalpha():
            return (lead + body,)
        if not body or body[0].isspace() or body[-1].isspace():
            return None
        if body[-1] in _STOPS and body[:-1].isalpha():
            return (lead + body[:-1], body[-1])
        return self.table.split(lead + body)

    def learn(self, chunks: set[str]) -> None:
        """Replay the merges over the pre-tokens of the given chunks."""
        todo = list(chunks)
        for lo in range(0, len(todo), REPLAY_WORDS):
            part = todo[lo:lo + REPLAY_WORDS]
            pieces = list(map(self.pieces, part))
            words = list({w for ps in pieces if ps for w in ps})
            ids, ends = self.table.replay([w.encode() for w in words])
            raw = ids.astype("<u4").tobytes()
            stops = (ends * 4).tolist()
            own = {w: raw[a:b] for w, a, b in zip(words, [0, *stops[:-1]], stops, strict=True)}
            for c, ps in zip(part, pieces, strict=True):
                if ps is None:
                    self.known[c] = None
                elif len(ps) == 1:
                    self.known[c] = own[ps[0]]
                elif len(ps) == 2:
                    self.known[c] = own[ps[0]] + own[ps[1]]
                else:
                    self.known[c] = b"".join(map(own.__getitem__, ps))

    def look_up(self, cut: list[list[str]]) -> None:
        """Have the ids of all chunks at hand."""
        wanted = set()
        for parts in cut:
            wanted.update(parts)
        new = wanted.difference(self.known)
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known.clear()
            new = wanted
        if new:
            self.learn(new)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut: list[list[str]] = []
        strict = []
        for i, text in enumerate(texts):
            if not text:
                cut.append([])
            elif "\x00" in text or "\x01" in text:
                cut.append([])
                strict.append(i)
            else:
                cut.append(("\x00" + text.replace("\n", " \n \x00")).split(" "))
        self.look_up(cut)
        get, out = self.known.__getitem__, []
        for i, parts in enumerate(cut):
            try:
                out.append(b"".join(map(get, parts)))
            except TypeError:  # a None among them
                out.append(b"")
                strict.append(i)
        if strict:
            again = []
            for i in strict:
                first, *rest = _GLUED.split(texts[i])
                again.append(["\x01" + first, *["\x01 " + p for p in rest]])
            self.look_up(again)
            get = self.known.__getitem__
            for i, parts in zip(strict, again, strict=True):
                out[i] = b"".join(map(get, parts))
        return out


@lru_cache(maxsize=1)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(rank_table(path, pattern))


def slices(texts: list[str], budget: int = 16_000_000):
    """Cut a batch into runs of at most so many characters (one text at least)."""
    lo = size = 0
    for i, text in enumerate(texts):
        if i > lo and size + len(text) > budget:
            yield lo, i
            lo, size = i, 0
        size += len(text)
    if lo < len(texts):
        yield lo, len(texts)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every document."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = encoder(path, pattern)
        texts, raw = batch.column(1).to_pylist(), []
        for lo, hi in slices(texts):
            raw += own.encode(texts[lo:hi])
        ids = [np.frombuffer(r, dtype="<u4").astype(np.int32) for r in raw]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])
    cols = [F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")]
    return map_batches(docs, cols, run, "doc_id long, ids array<int>")


def decode_bytes(raw: bytes, table: RankTable) -> bytes:
    """Bytes of packed ids."""
    return b"".join(map(table.bytes_of.__getitem__, np.frombuffer(raw, dtype="<u4").tolist()))


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); bytes that are no UTF-8 become U+FFFD."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        table = rank_table(path, pattern)
        texts = [decode_bytes(np.array(i or [], dtype="<u4").tobytes(), table).decode(errors="replace")
                 for i in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])
    return map_batches(encoded, ["doc_id", "ids"], run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """Encode and decode every text: doc_id, n_tokens, ids_sha256 and
    decoded_sha256 (hex digests of the packed ids and of the decoded bytes)."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = encoder(path, pattern)
        texts, n, a, b = batch.column(1).to_pylist(), [], [], []
        for lo, hi in slices(texts):
            for raw in own.encode(texts[lo:hi]):
                n.append(len(raw) // 4)
                a.append(hashlib.sha256(raw).hexdigest())
                b.append(hashlib.sha256(decode_bytes(raw, own.table)).hexdigest())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    cols = [F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")]
    return map_batches(docs, cols, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
