"""Document fingerprints by consistent weighted sampling.

A document is its words with their counts as weights.  For every sample k and
term, r and c are gamma(2, 1) and beta uniform, all drawn from the hash of
(term, k); the sample is the term of the lowest ``ln c - r * (t - beta) - r``
with ``t = floor(ln(weight) / r + beta)``, together with t.  Two documents
agree in a sample with the probability of their generalised Jaccard
similarity, sum of minima over sum of maxima of the weights.

Defined results: a null text is empty; texts without words have the
fingerprint of the empty set, which is like itself (1) and unlike all others
(0); documents with equal ids are ordered by their text; in ``with_next`` rows
with a null id, which have no next document, are left out; an empty table
gives an empty table; of the input only id and text are read, so other
columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import mix64, text_or_empty

SAMPLES = 128
#: (term, weight) rows kept by a worker; when full, those of few texts are dropped (bounded memory).
CACHE_TERMS = 300_000
#: Terms of texts that are looked up, and drawn if new, together; rows of a batch that are.
GROUP_TERMS = 20_000
SLICE_ROWS = 32
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Quantiles of the gamma tables: for r, and for c, whose low tail decides.
R_BITS, C_BITS = 16, 20


def gamma_quantiles(bits: int) -> np.ndarray:
    """Middle quantiles of Gamma(2, 1), by Newton steps on 1 - (1 + x) exp(-x) = p."""
    p = (np.arange(1 << bits) + 0.5) / (1 << bits)
    x = np.where(p < 0.5, np.sqrt(2 * p), 1.0 - np.log1p(-p))
    for _ in range(40):
        x = np.maximum(x - (-np.expm1(-x) - x * np.exp(-x) - p) / (x * np.exp(-x)), x / 4)
    return x


_R = gamma_quantiles(R_BITS).astype(np.float32)
_LN_C = np.log(gamma_quantiles(C_BITS)).astype(np.float32)
#: Of a term, the draws with ln a below this are kept, about 1 in 30 of a word that a text has once.
#: A text in which a sample has none (texts of few words) draws that sample for all of its terms.
LOW = np.float32(-3.7)
#: By the first bits of the place of r, the least place of c (as high bits) whose ln a cannot be below LOW for
#: weight 1, where ln a > ln c - r.
FEW_BITS = 12
_FIRST_HIGH = np.searchsorted(_LN_C, _R.reshape(1 << FEW_BITS, -1)[:, -1] + LOW + np.float32(1e-3)).astype(np.uint64)
_FIRST_HIGH = np.minimum(_FIRST_HIGH, np.uint64((1 << C_BITS) - 1)) << np.uint64(64 - C_BITS)
#: Draws that are looked at together.
DRAWS = 1 << 14
_NONE = np.iinfo(np.uint64).max
#: A term is one number, its word's above its weight's 32 bits; rows of weights up to LIGHT are found by table.
_WEIGHT = (1 << 32) - 1
LIGHT = 8


def mixed(h: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """``mix64`` of h in its own place."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        np.right_shift(h, np.uint64(shift), out=spare)
        h ^= spare
        if factor > 1:
            h *= np.uint64(factor)
    return h


def draw(h: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ln a, t) of draws: one hash gives the places of the two gamma draws in
    their tables and the uniform one."""
    # places are below 2^20, so signed views and clipping (no check of bounds) change nothing
    r = _R.take((h >> np.uint64(64 - R_BITS)).view(np.int64), mode="clip")
    ln_c = _LN_C.take(((h >> np.uint64(64 - R_BITS - C_BITS)) & np.uint64((1 << C_BITS) - 1)).view(np.int64), mode="clip")
    beta = (h.astype(np.uint32) & np.uint32((1 << 23) - 1)).view(np.int32).astype(np.float32)
    beta += np.float32(0.5)
    beta *= np.float32(2.0 ** -23)
    t = np.zeros(len(h), dtype=np.int32)
    low = (beta - np.float32(1)) * r + ln_c  # weight 1: ln 1 = 0, so t = 0
    at = np.flatnonzero(weights != 1)
    if len(at):
        r, ln_c, beta = r[at], ln_c[at], beta[at]
        whole = np.floor(np.log(weights[at].astype(np.float64)).astype(np.float32) / r + beta)
        low[at] = ln_c - (whole - beta) * r - r
        t[at] = whole.astype(np.int32)
    return low, t


def keys(h: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ln a, key) of draws; a key is ln a, so coded that the order stays, above the mark of (term, t)."""
    low, t = draw(h, weights)
    mark = (mix64(terms + _GOLDEN * t.astype(np.int64).astype(np.uint64)) >> np.uint64(32)) | np.uint64(1)
    return low, (ordered(low).astype(np.uint64) << np.uint64(32)) | mark


def ordered(x: np.ndarray) -> np.ndarray:
    """Unsigned codes of float32 values, in the same order."""
    bits = x.view(np.int32)
    return (bits ^ ((bits >> 31) | np.int32(-1 << 31))).view(np.uint32)


def spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers begin .. begin + size - 1 of all ranges, one after the other."""
    end = np.cumsum(size)
    return np.repeat(begin - (end - size), size) + np.arange(end[-1] if len(end) else 0)


def numbered(words: list[bytes]) -> defaultdict:
    """The words' places; a word that is looked up and not there gets the next one."""
    found = defaultdict(None, zip(words, range(len(words)), strict=True))
    found.default_factory = found.__len__
    return found


def grown(x: np.ndarray, need: int) -> np.ndarray:
    if need <= len(x):
        return x
    out = np.zeros(max(need, 2 * len(x)), dtype=x.dtype)
    out[:len(x)] = x
    return out


class Sampler:
    """Fingerprints of texts; what a term (word and weight) draws below LOW is kept."""

    def __init__(self, samples: int = SAMPLES):
        self.samples = samples
        self.salt = mix64(np.arange(1, samples + 1, dtype=np.uint64) * _GOLDEN)
        self.clear()

    def clear(self) -> None:
        self.word = numbered([])  # word -> number
        # by word: its hash, and 1 + the row of its term of each weight up to LIGHT
        self.hash = np.empty(0, dtype=np.uint64)
        self.light = np.zeros((0, LIGHT), dtype=np.int32)
        self.heavy: dict[int, int] = {}  # rows of the other terms
        # by row: its term (number and weight), texts, and where its low draws begin
        self.term = np.empty(0, dtype=np.int64)
        self.uses = np.zeros(0, dtype=np.int32)
        self.begin = np.zeros(1, dtype=np.int64)
        # by low draw: its sample and key
        self.sample = np.empty(0, dtype=np.uint16)
        self.key = np.empty(0, dtype=np.uint64)
        self.used = 0

    def trim(self, words: np.ndarray) -> np.ndarray:
        """Keeps the terms of several texts, those of most texts if they take over half of the room,
        and ``words``; the new numbers of the kept words."""
        keep = np.flatnonzero(self.uses[:self.used] > 2)  # a text and its edited text have most terms in common
        if 2 * len(keep) > CACHE_TERMS:
            keep = np.sort(keep[np.argsort(-self.uses[keep], kind="stable")[:CACHE_TERMS // 2]])
        size = np.diff(self.begin[:self.used + 1])[keep]
        draws = spread(self.begin[keep], size)
        self.sample, self.key, self.begin = self.sample[draws], self.key[draws], np.append(0, np.cumsum(size))
        self.uses, self.used = self.uses[keep] // 2, len(keep)
        term = self.term[keep]
        kept = np.unique(np.concatenate([term >> 32, words]))
        number = np.full(len(self.word), -1, dtype=np.int64)
        number[kept] = np.arange(len(kept))
        names = list(self.word)  # in the order of their numbers
        self.word.default_factory = None  # which refers to the dictionary
        self.word = numbered([names[i] for i in kept.tolist()])
        self.hash, self.light, self.heavy = self.hash[kept], np.zeros((len(kept), LIGHT), dtype=np.int32), {}
        self.term = number[term >> 32] << 32 | term & _WEIGHT
        self._enter(0)
        return number

    def _enter(self, first: int) -> None:
        """Notes the rows from ``first`` on."""
        term = self.term[first:self.used]
        weight = term & _WEIGHT
        at = np.flatnonzero(weight <= LIGHT)
        self.light[term[at] >> 32, weight[at] - 1] = first + at + 1
        at = np.flatnonzero(weight > LIGHT)
        self.heavy.update(zip(term[at].tolist(), (first + at).tolist(), strict=True))

    def _rows(self, terms: np.ndarray) -> np.ndarray:
        """Rows of terms, -1 for those that have none."""
        weight = terms & _WEIGHT
        rows = self.light[terms >> 32, np.minimum(weight, LIGHT) - 1].astype(np.int64) - 1
        at = np.flatnonzero(weight > LIGHT)
        rows[at] = [self.heavy.get(x, -1) for x in terms[at].tolist()]
        return rows

    def learn(self, new: np.ndarray) -> None:
        """Draws for terms without a row, given once each."""
        new = new[np.argsort((new & _WEIGHT) != 1, kind="stable")]  # those of weight 1 first, by themselves
        terms, weights = self.hash[new >> 32], new & _WEIGHT
        ones = int((weights == 1).sum())
        size, sample, key = (np.concatenate(x) for x in zip(
            *self._low(terms[:ones], weights[:ones]), *self._low(terms[ones:], weights[ones:]), strict=True))
        kept, need = int(self.begin[self.used]), self.used + len(new)
        self.term, self.uses = grown(self.term, need), grown(self.uses, need)
        self.term[self.used:need], self.uses[self.used:need] = new, 0
        self.begin = grown(self.begin, need + 1)
        self.begin[self.used + 1:need + 1] = kept + np.cumsum(size)
        self.sample, self.key = grown(self.sample, kept + len(key)), grown(self.key, kept + len(key))
        self.sample[kept:kept + len(key)], self.key[kept:kept + len(key)] = sample, key
        first, self.used = self.used, need
        self._enter(first)

    def _low(self, terms: np.ndarray, weights: np.ndarray) -> Iterator[tuple]:
        """(numbers by term, samples, keys) of the draws below LOW; the weights are 1, or none is."""
        step = max(1, DRAWS // self.samples)
        hold = np.empty((2, step * self.samples), dtype=np.uint64)
        yield np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint16), np.zeros(0, dtype=np.uint64)
        for first in range(0, len(terms), 16 * step):
            hashes, places = [], []
            for lo in range(first, min(first + 16 * step, len(terms)), step):
                part = terms[lo:lo + step]
                h, spare = hold[:, :len(part) * self.samples]
                np.bitwise_xor(part[:, None], self.salt[None, :], out=h.reshape(len(part), -1))
                mixed(h, spare)
                if weights[lo] == 1:
                    r = np.right_shift(h, np.uint64(64 - FEW_BITS), out=spare).view(np.int64)
                    limit = _FIRST_HIGH.take(r, mode="clip")
                    at = np.flatnonzero(np.left_shift(h, np.uint64(R_BITS), out=spare) < limit)
                else:
                    r = _R.take(np.right_shift(h, np.uint64(64 - R_BITS), out=spare).view(np.int64), mode="clip")
                    r += np.repeat(np.log(weights[lo:lo + step]).astype(np.float32) + (LOW + np.float32(1e-3)), self.samples)
                    np.right_shift(h, np.uint64(64 - R_BITS - C_BITS), out=spare)
                    spare &= np.uint64((1 << C_BITS) - 1)
                    at = np.flatnonzero(_LN_C.take(spare.view(np.int64), mode="clip") < r)
                hashes.append(h[at])
                places.append(at + (lo - first) * self.samples)
            who, sample = np.divmod(np.concatenate(places), self.samples)
            low, key = keys(np.concatenate(hashes), terms[first + who], weights[first + who])
            some = np.flatnonzero(low < LOW)
            yield (np.bincount(who[some], minlength=min(16 * step, len(terms) - first)),
                   sample[some].astype(np.uint16), key[some])

    def of(self, text: str) -> np.ndarray:
        return self.many([text])[0]

    def many(self, texts: list[str]) -> np.ndarray:
        """The fingerprint of each text; texts of up to GROUP_TERMS words meet their terms together."""
        best = np.full((len(texts), self.samples), _NONE, dtype=np.uint64)
        words: list[bytes] = []
        sizes: list[int] = []
        for i, text in enumerate(texts):
            own = text.encode().split()
            if words and len(words) + len(own) > GROUP_TERMS:
                self._group(words, sizes, best[i - len(sizes):i])
                words, sizes = [], []
            words += own
            sizes.append(len(own))
        self._group(words, sizes, best[len(texts) - len(sizes):])
        return (best & np.uint64(0xFFFFFFFF)).astype(np.uint32)

    def _group(self, words: list[bytes], sizes: list[int], best: np.ndarray) -> None:
        """Fingerprints of some texts, given their words, into ``best``."""
        best[np.array(sizes, dtype=np.int64) == 0] = 0
        if not words:
            return
        at = np.fromiter(map(self.word.__getitem__, words), dtype=np.int64, count=len(words))
        self._hash_words()
        at |= np.repeat(np.arange(len(sizes)) << 32, sizes)
        at.sort()
        start = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        text, terms = at[start] >> 32, (at[start] & _WEIGHT) << 32 | np.diff(start, append=len(at))
        for lo in range(0, len(terms), GROUP_TERMS):
            self._meet(text, terms, lo, min(lo + GROUP_TERMS, len(terms)), best)
        which, lacks = np.nonzero(best == _NONE)
        begin = np.searchsorted(text, which)
        self._draw_all(self.hash[terms >> 32], terms & _WEIGHT, begin, np.searchsorted(text, which, side="right") - begin,
                       which, lacks, best)

    def _hash_words(self) -> None:
        import xxhash
        n = len(self.word) - len(self.hash)
        late = list(islice(reversed(self.word), n))[::-1]
        self.hash = np.append(self.hash, np.fromiter(map(xxhash.xxh3_64_intdigest, late), dtype=np.uint64, count=n))
        if len(self.word) > len(self.light):
            light = np.zeros((max(len(self.word), 2 * len(self.light)), LIGHT), dtype=np.int32)
            light[:len(self.light)] = self.light
            self.light = light

    def _meet(self, text: np.ndarray, terms: np.ndarray, lo: int, hi: int, best: np.ndarray) -> None:
        rows = self._rows(terms[lo:hi])
        new = np.unique(terms[lo:hi][rows < 0])
        if self.used + len(new) > CACHE_TERMS or len(self.word) > 2 * CACHE_TERMS + len(terms):
            number = self.trim(np.unique(terms >> 32))
            terms[...] = number[terms >> 32] << 32 | terms & _WEIGHT
            rows = self._rows(terms[lo:hi])
            new = np.unique(terms[lo:hi][rows < 0])
        if len(new):
            self.learn(new)
            at = np.flatnonzero(rows < 0)
            rows[at] = self._rows(terms[lo:hi][at])
        self.uses[:self.used] += np.bincount(rows, minlength=self.used).astype(np.int32)
        size = self.begin[rows + 1] - self.begin[rows]
        draws = spread(self.begin[rows], size)
        np.minimum.at(best.reshape(-1), np.repeat(text[lo:hi] * self.samples, size) + self.sample[draws], self.key[draws])

    def _draw_all(self, terms: np.ndarray, weights: np.ndarray, begin: np.ndarray, size: np.ndarray,
                  texts: np.ndarray, lacks: np.ndarray, best: np.ndarray) -> None:
        """Sample ``lacks`` of each of ``texts`` over its terms, ``size`` from ``begin`` on."""
        end, x = np.cumsum(size), 0
        while x < len(lacks):
            y = max(x + 1, int(np.searchsorted(end, (end[x - 1] if x else 0) + DRAWS, side="right")))
            at = spread(begin[x:y], size[x:y])
            h = terms[at] ^ np.repeat(self.salt[lacks[x:y]], size[x:y])
            _, key = keys(mixed(h, np.empty_like(h)), terms[at], weights[at])
            least = np.minimum.reduceat(key, np.cumsum(size[x:y]) - size[x:y])
            best[texts[x:y], lacks[x:y]] = np.minimum(best[texts[x:y], lacks[x:y]], least)
            x = y


@lru_cache(maxsize=1)
def sampler(samples: int) -> Sampler:
    """The sampler of this worker: its tasks share what is kept."""
    return Sampler(samples)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                samples: int = SAMPLES) -> DataFrame:
    """(doc_id, fingerprint binary) of every document; no shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sampler(samples)
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([f.tobytes() for lo in range(0, b.num_rows, SLICE_ROWS)
                                        for f in own.many(b.column(1).slice(lo, SLICE_ROWS).to_pylist())], pa.binary())],
                ["doc_id", "fingerprint"])
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")) \
        .mapInArrow(run, "doc_id long, fingerprint binary")


def edited(text: str, following: str) -> str:
    """The last floor(n / 2) code points replaced by the first of the next text."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Every document's fingerprint, its edited text's, and their likeness.

    Documents are dealt to ranges of ids (bounds from quantiles of the ids);
    the first document of a range is dealt to the range before it, too (that
    of the first range to the last), so every task sees the next text of each
    of its documents.  Only the ranges' bounds and first ids, one number for
    each range, come to the driver; the texts are shuffled once.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")) \
        .filter("doc_id is not null")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranges = 4 * parts
    bounds = sorted(set(rows.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.25 / ranges)))
    schema = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double")
    if not bounds:
        return spark.createDataFrame([], schema)
    limits = F.array(*[F.lit(int(b)) for b in bounds])
    # the range of an id: how many bounds are at most the id (binary search by width)
    ids = rows.select("doc_id", F.size(F.filter(limits, lambda b: b <= F.col("doc_id"))).alias("range"))
    first = {r["range"]: r["first"] for r in ids.groupBy("range").agg(F.min("doc_id").alias("first")).collect()}
    order = sorted(first)
    before = {first[r]: order[i - 1] for i, r in enumerate(order)}
    edges = np.array([int(b) for b in bounds], dtype=np.int64)
    heads = np.array(sorted(before), dtype=np.int64)
    to = np.array([before[h] for h in sorted(before)], dtype=np.int32)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(0).to_numpy()
            places = np.searchsorted(edges, own, side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(np.zeros(len(own), dtype=np.int32)),
                                              b.column(0), b.column(1)], ["range", "tail", "doc_id", "text"])
            again = np.flatnonzero(np.isin(own, heads))
            if len(again):
                picked = b.take(pa.array(again))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to[np.searchsorted(heads, own[again])]), pa.array(np.ones(len(again), dtype=np.int32)),
                     picked.column(0), picked.column(1)], ["range", "tail", "doc_id", "text"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last, last_mark = sampler(samples), [], []  # last: [(range, tail, id, text)]
        for b in batches:
            out = []
            for lo in range(0, b.num_rows, SLICE_ROWS):
                rows = [*last]
                for now in zip(*[c.to_pylist() for c in b.slice(lo, SLICE_ROWS).columns], strict=True):
                    if not (rows and rows[-1][0] == now[0] and rows[-1][1] and now[1]):
                        rows.append(now)  # else a repeated id: the first of its texts is next
                at = [k for k in range(len(rows) - 1) if rows[k][0] == rows[k + 1][0] and not rows[k][1]]
                changed = [edited(rows[k][3], rows[k + 1][3]) for k in at]
                made = own.many([r[3] for r in rows[len(last):]] + changed)
                marks = [*last_mark, *made[:len(rows) - len(last)]]
                for k, text, mark in zip(at, changed, made[len(rows) - len(last):], strict=True):
                    out.append((rows[k][2], len(rows[k][3]), hashlib.sha256(text.encode()).hexdigest(),
                                marks[k].astype(">u4").tobytes().hex(), mark.astype(">u4").tobytes().hex(),
                                likeness(marks[k], mark), likeness(marks[k], marks[k + 1])))
                last, last_mark = rows[-1:], marks[-1:]
            if out:
                names = [f.split()[0] for f in schema.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names)

    dealt = rows.mapInArrow(deal, "range int, tail int, doc_id long, text string")
    return (dealt.repartition(parts, "range").sortWithinPartitions("range", "tail", "doc_id", "text")
            .mapInArrow(compare, schema))
