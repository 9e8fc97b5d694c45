"""Token ids in files of Simple-8b words.

A 64-bit word holds a selector (top four bits) and as many ids as fit into
the other 60 at the selector's width, the first in the lowest bits.
Selector 0 is the escape: the word holds the place, in a table of raw values,
of one id that needs more than 60 bits.  Selector 1 stands for 120 ids 0.

Files are plain binary, written and committed by Spark's own writer, so a
task that is run again after the loss of an executor leaves one copy of its
output.  A file is a row of segments, each followed by a line feed:

    header     magic, shard, number in the shard, documents and ids of the
               shard before this segment, documents, ids, words, escapes
    directory  null flags, ids and numbers of ids of the documents
    offsets    ids before each block of ``BLOCK`` words
    words, escapes

Documents are in ascending order of their ids over shards, segments and
places in the directory, whole in one segment.  A one-line index file per
shard gives its numbers of documents and ids; a reader sums one number per
shard, then decodes segments independently of each other, or single blocks
of a segment by their offsets.

Encoding finds, for every place, how many ids the next word can take from
the widest id of each window (numpy), then follows the chain of words;
decoding takes all words of a selector at once.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm.bpe import slices
from vitrine.llm.common import text_or_empty
from vitrine.llm.wordids import SLICE, word_ids

ESCAPE, ZEROS = 0, 1
#: Ids in a word and their width, by selector (fixed values of the format).
COUNT = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTH = np.array([60, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
PAYLOAD = np.uint64((1 << 60) - 1)

MAGIC = b"VS8B"
HEADER = struct.Struct("<4sIQQQQQQQ")
#: Words between two offsets.
BLOCK = 1024
#: A segment is closed once it holds so many ids (one document at least).
SEGMENT_IDS = 1 << 19
#: Segments in a file.
FILE_SEGMENTS = 16


_BITS_16 = np.array([i.bit_length() for i in range(1 << 16)], dtype=np.uint8)


def _bits(ids: np.ndarray) -> np.ndarray:
    """Bits that each id needs (0 for the id 0)."""
    if ids.max() < 1 << 16:
        return _BITS_16[ids]
    out = np.zeros(len(ids), dtype=np.uint8)
    for step in range(0, 64, 16):
        part = (ids >> np.uint64(step)) & np.uint64(0xFFFF)
        out = np.where(part > 0, _BITS_16[part] + np.uint8(step), out)
    return out


def _best_selectors(need: np.ndarray) -> np.ndarray:
    """For every place the selector that takes most of the ids from there on:
    the widest id of each window, from the widest of two shorter windows."""
    n, longest = len(need), int(COUNT.max())
    held = np.concatenate((need, np.zeros(longest, dtype=np.uint8)))  # filled up with 0
    best, widest, size = np.full(n, ESCAPE, dtype=np.int8), held, 1
    for s in range(15, ESCAPE, -1):
        count = int(COUNT[s])
        while size < count:
            step = min(size, count - size)
            widest = np.maximum(widest[:len(widest) - step], widest[step:])
            size += step
        np.copyto(best, s, where=widest[:n] <= WIDTH[s])
    return best


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, escapes) of unsigned ids; the last word is filled up with 0."""
    ids = np.asarray(ids, dtype=np.uint64)
    n = len(ids)
    if not n:
        return ids, ids
    best = _best_selectors(_bits(ids))
    taken = COUNT.astype(np.uint8)[best].tobytes()
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i += taken[i]
    start = np.array(starts)
    kind = best[start]
    words = kind.astype(np.uint64) << np.uint64(60)
    padded = np.concatenate((ids, np.zeros(int(COUNT.max()), dtype=np.uint64)))
    for s in np.unique(kind).tolist():
        if s in (ESCAPE, ZEROS):
            continue
        rows = np.flatnonzero(kind == s)
        held = np.zeros(len(rows), dtype=np.uint64)
        for k in range(int(COUNT[s])):
            held |= padded[start[rows] + k] << np.uint64(k * int(WIDTH[s]))
        words[rows] |= held
    raw = np.flatnonzero(kind == ESCAPE)
    words[raw] |= np.arange(len(raw), dtype=np.uint64)
    return words, ids[start[raw]]


def held_ids(words: np.ndarray) -> np.ndarray:
    """How many ids each word holds (places filled up at the end included)."""
    return COUNT[(words >> np.uint64(60)).astype(np.int64)]


def decode(words: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The first n ids of the words, all words of a selector at once."""
    kind = (words >> np.uint64(60)).astype(np.int64)
    ends = np.cumsum(COUNT[kind])
    out = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint64)
    start, payload = ends - COUNT[kind], words & PAYLOAD
    for s in np.unique(kind).tolist():
        rows = np.flatnonzero(kind == s)
        if s == ESCAPE:
            out[start[rows]] = escapes[payload[rows].astype(np.int64)]
        elif s != ZEROS:
            width = int(WIDTH[s])
            mask = np.uint64((1 << width) - 1)
            for k in range(int(COUNT[s])):
                out[start[rows] + k] = (payload[rows] >> np.uint64(k * width)) & mask
    return out[:n]


class Segment:
    """One segment of a file, its arrays as views of the file's bytes."""

    def __init__(self, raw: memoryview):
        magic, self.shard, self.number, self.docs_before, self.ids_before, docs, self.ids, words, escapes = \
            HEADER.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a segment of token ids")
        at = HEADER.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, dtype=kind, count=n, offset=at)
            at += out.nbytes
            return out
        self.null, self.doc, self.count = take("u1", docs), take("<i8", docs), take("<u8", docs)
        self.offsets = take("<u8", -(-words // BLOCK))
        self.words, self.escapes = take("<u8", words), take("<u8", escapes)
        self.size = at

    def all_ids(self) -> np.ndarray:
        return decode(self.words, self.escapes, self.ids)

    def doc_ids(self, place: int) -> np.ndarray:
        """Ids of one document: only the blocks that hold it are decoded."""
        first = int(self.count[:place].sum())
        n = int(self.count[place])
        low = max(int(np.searchsorted(self.offsets, first, side="right")) - 1, 0)
        high = int(np.searchsorted(self.offsets, first + n, side="left"))
        base = int(self.offsets[low]) if len(self.offsets) else 0
        part = decode(self.words[low * BLOCK:high * BLOCK], self.escapes, first + n - base)
        return part[first - base:]


def segment_bytes(shard: int, number: int, docs_before: int, ids_before: int, docs: list[int | None],
                  counts: np.ndarray, ids: np.ndarray) -> bytes:
    """A segment of whole documents: their ids, numbers of token ids and token ids."""
    words, escapes = encode(ids)
    before = np.concatenate(([0], np.cumsum(held_ids(words))))[:-1][::BLOCK]
    head = HEADER.pack(MAGIC, shard, number, docs_before, ids_before, len(docs), len(ids), len(words), len(escapes))
    return b"".join([head, np.array([d is None for d in docs], dtype="u1").tobytes(),
                     np.array([d or 0 for d in docs], dtype="<i8").tobytes(),
                     np.asarray(counts).astype("<u8").tobytes(), before.astype("<u8").tobytes(),
                     words.astype("<u8").tobytes(), escapes.astype("<u8").tobytes()])


def segments(raw: bytes) -> Iterator[Segment]:
    """All segments of a file."""
    view, at = memoryview(raw), 0
    while at < len(view):
        own = Segment(view[at:])
        yield own
        at += own.size + 1  # and the line feed


def write(docs: DataFrame, tokenizer: str, path: str, end_id: int = 2, id_col: str = "doc_id",
          text_col: str = "text", segment_ids: int = SEGMENT_IDS) -> None:
    """Write the ids of each text and the end id as files under ``path``, in
    ascending order of the documents' ids, null ids first.  Texts are dealt by
    ranges of the id (the bounds come from ids and hashes alone) and encoded
    where they are written; rows of one id are dealt by the text's hash, then
    at random, so that an id of any number of rows is spread over the shards."""
    order = ["doc_id", "digest", "salt"]
    dealt = (docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
             .withColumn("digest", F.xxhash64("text")).withColumn("salt", F.rand(0))
             .repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text"))
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = word_ids(tokenizer)
        shard = TaskContext.get().partitionId()
        number = docs_before = ids_before = held = 0
        names, counts, ids = [], [], []

        def out(kind: str, data: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary()), pa.array([kind])], ["data", "kind"])

        def close() -> pa.RecordBatch:
            nonlocal number, docs_before, ids_before, held
            data = segment_bytes(shard, number, docs_before, ids_before, names, np.concatenate(counts), np.concatenate(ids))
            number, docs_before, ids_before, held = number + 1, docs_before + len(names), ids_before + held, 0
            for part in (names, counts, ids):
                part.clear()
            return out("ids", data)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in slices(texts, SLICE):
                flat, per = own.encode_flat(texts[lo:hi])
                docs = batch.column(0).slice(lo, hi - lo).to_pylist()
                ends = np.cumsum(per + 1)
                at = 0
                while at < len(docs):  # as many documents as fill the segment
                    done = int(ends[at - 1]) if at else 0
                    to = min(int(np.searchsorted(ends, done + segment_ids - held)) + 1, len(docs))
                    part = np.full(int(ends[to - 1]) - done, end_id, dtype=np.uint64)
                    keep = np.ones(len(part), dtype=bool)
                    keep[ends[at:to] - done - 1] = False
                    part[keep] = flat[done - at:int(ends[to - 1]) - to]
                    names += docs[at:to]
                    counts.append(per[at:to] + 1)
                    ids.append(part)
                    held, at = held + len(part), to
                    if held >= segment_ids:
                        yield close()
        if names:
            yield close()
        if number:
            yield out("index", f"{shard} {docs_before} {ids_before}".encode())
    (dealt.mapInArrow(run, "data binary, kind string").select(F.col("data").cast("string").alias("value"), "kind")
     .write.option("maxRecordsPerFile", FILE_SEGMENTS).partitionBy("kind").text(path))


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def shard_starts(spark: SparkSession, path: str) -> dict[int, int]:
    """Ids before each shard, from the index: one line per shard."""
    rows = spark.read.text(f"{path}/kind=index").collect()
    starts, total = {}, 0
    for shard, _, ids in sorted(tuple(map(int, r["value"].split())) for r in rows):
        starts[shard] = total
        total += ids
    return starts


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids array<long>) of every document in the files."""
    def rows(own: Segment, start: int) -> pa.RecordBatch:
        ends = np.cumsum(own.count.astype(np.int64))
        ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()),
                                       pa.array(own.all_ids().astype(np.int64)))
        return pa.RecordBatch.from_arrays([_doc_column(own), pa.array(start + ends - own.count.astype(np.int64)), ids],
                                          ["doc_id", "start", "ids"])
    return _read(spark, path, rows, "doc_id long, start long, ids array<long>")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files;
    the crc32 is of the ids as little-endian unsigned 32-bit integers."""
    def rows(own: Segment, start: int) -> pa.RecordBatch:
        n = own.count.astype(np.int64)
        ends = np.cumsum(n)
        raw = memoryview(own.all_ids().astype("<u4").tobytes())
        crc = [zlib.crc32(raw[4 * (b - k):4 * b]) for b, k in zip(ends.tolist(), n.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays(
            [_doc_column(own), pa.array(start + ends - n), pa.array(n), pa.array(crc, pa.int64())],
            ["doc_id", "start", "n_tokens", "ids_crc32"])
    return _read(spark, path, rows, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _doc_column(own: Segment) -> pa.Array:
    return pa.array(own.doc, pa.int64(), mask=own.null.astype(bool))


def _read(spark: SparkSession, path: str, rows, schema: str) -> DataFrame:
    if _files(spark, path).select("path").isEmpty():  # no document was written
        return spark.createDataFrame([], schema)
    starts = shard_starts(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                for own in segments(content.as_buffer()):
                    yield rows(own, starts[own.shard] + own.ids_before)
    return _files(spark, f"{path}/kind=ids").select("content").mapInArrow(run, schema)


def round_trip(docs: DataFrame, tokenizer: str, path: str, end_id: int = 2, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """Digests of the documents' ids, read back from files written to ``path``.

    Defined results: a null text is empty and has the end id only; repeated
    rows are written each on its own, next to each other; a null id is
    written first, as null; an empty table gives no file and no row; of the
    input only id and text are read, so other columns may have any name."""
    write(docs, tokenizer, path, end_id, id_col, text_col)
    return digests(docs.sparkSession, path)
