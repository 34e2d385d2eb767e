"""Stupid-backoff scores of documents by an n-gram model of the corpus.

Words are runs of bytes other than space and 0x09-0x0D, A-Z lower-cased. With C the
count of an n-gram in the corpus, less those of the scored document itself where it
is part of the corpus, a word w after the history h has

    S(w | h) = C(h w) / C(h)                  if C(h w) > 0
             = BACKOFF * S(w | h less a word) otherwise
    S(w)     = C(w) / N                       if C(w) > 0, N being all words
             = BACKOFF / N                    otherwise

and a document's score is the mean of log S. No n-gram is dropped at any size, and
equal texts with equal counts around them have equal scores.

Documents are taken in blocks of about ``BLOCK`` words, at least one document each. A
block's n-grams are exploded to 64-bit hash keys and counted before they leave it, so
however common an n-gram is, it is one row a block. Those rows, packed by hash bucket
on the way, are dealt out by bucket, one a partition; a window over the key is the count table and its
join with the rows, and brings each block the counts of its n-grams that others have
too (the rest it has counted itself), by their place in the block. Blocks then meet
their counts, and each document adds up its own logs. Nothing is broadcast or gathered.

Nulls: a null text is an empty one; a text without words has score null, as has one
when no other document has a word; null and repeated ids get a row for each row.
Texts of any length are whole, a block being one document at least. Ties have no
effect. Other columns, whatever their names, are not read. An empty table gives an
empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from plumbline.llm.common import Scratch, repeatable

ORDER = 2
BACKOFF = 0.4
#: Words after which a block of documents is closed.
BLOCK = 1 << 21
#: Words of a block that are scored at a time, and bytes of text that are packed together.
_PART = 1 << 18
_PACK = 1 << 20
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def word_keys(text) -> np.ndarray:
    """The 64-bit keys of an Arrow string's words."""
    words = text.as_buffer().to_pybytes().translate(_LOWER).split() if text.is_valid else []
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def _mix(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The 64-bit key of an n-gram from that of its beginning and its last word's."""
    x = v * np.uint64(0x9E3779B97F4A7C15) + w * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class _Numbers:
    """Deals the documents of a task to blocks; a second pass over the same rows deals them alike."""

    def __init__(self, size: int):
        self.size, self.held = size, 0
        self.block = TaskContext.get().partitionId() << 32

    def next(self, n_words: int) -> int:
        if self.held >= self.size:
            self.block, self.held = self.block + 1, 0
        self.held += n_words
        return self.block


def _grams(keys: list[np.ndarray], order: int):
    """For each length up to ``order``: the keys of all n-grams, and where in the joined texts each ends."""
    words = np.concatenate(keys)
    sizes = np.fromiter(map(len, keys), dtype=np.int64, count=len(keys))
    place = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    key, ends = words, np.arange(len(words))
    yield key, ends
    for n in range(2, order + 1):
        before = np.empty(len(words), dtype=np.uint64)
        before[ends] = key
        ends = ends[place[ends] >= n - 1]
        key = _mix(before[ends - 1], words[ends])
        yield key, ends


def _counted(keys: list[np.ndarray], order: int, n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, bucket and count of each distinct n-gram of a block, in a fixed order, bucket by bucket."""
    found = [np.unique(key, return_counts=True) for key, _ in _grams(keys, order)]
    key, n = np.concatenate([k for k, _ in found]), np.concatenate([c for _, c in found])
    bucket = (key % np.uint64(n_buckets)).astype(np.int32)
    by = np.lexsort((key, bucket))
    return key[by], bucket[by], n[by]


def _runs(values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins, and the end."""
    return np.append(np.flatnonzero(np.diff(values, prepend=values[:1] - 1)), len(values)).astype(np.int32)


def exploded(texts: DataFrame, order: int, size: int, n_buckets: int) -> DataFrame:
    """``(bucket, key, block, at, n)``: how often each n-gram of each block of the one column occurs in it.

    Dealt out by ``bucket`` of the key; ``at`` is the n-gram's place in its block.
    """

    def run(batches):
        dealt, held, block = _Numbers(size), [], None

        def out():
            key, bucket, n = _counted(held, order, n_buckets)
            if len(key):
                cut = _runs(bucket)
                lists = lambda a: pa.ListArray.from_arrays(pa.array(cut), pa.array(a))
                columns = [pa.array(bucket[cut[:-1]]), pa.array(np.full(len(cut) - 1, block)), pa.array(cut[:-1].astype(np.int64)), lists(key.view(np.int64)), lists(n.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "block", "first", "keys", "ns"])

        for batch in batches:
            for t in batch.column(0):
                keys = word_keys(t)
                now = dealt.next(len(keys))
                if now != block and held:
                    yield from out()
                    held = []
                held.append(keys)
                block = now
        if held:
            yield from out()

    packed = texts.mapInArrow(run, "bucket int, block bigint, first bigint, keys array<bigint>, ns array<int>").repartitionById(n_buckets, F.col("bucket"))
    rows = packed.select("bucket", "block", "first", F.posexplode(F.arrays_zip("keys", "ns")).alias("i", "g"))
    return rows.select("bucket", F.col("g.keys").alias("key"), "block", (F.col("first") + F.col("i")).alias("at"), F.col("g.ns").cast("bigint").alias("n"))


def _packed(batches):
    """``(block, at, total)`` as lists by block."""
    held, n = [], 0

    def out():
        block, at, total = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(3))
        by = np.lexsort((at, block))
        cut = _runs(block[by])
        lists = lambda a: pa.ListArray.from_arrays(pa.array(cut), pa.array(a[by]))
        return pa.RecordBatch.from_arrays([pa.array(block[by][cut[:-1]]), lists(at), lists(total)], names=["block", "at", "total"])

    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= _PACK:
            yield out()
            held, n = [], 0
    if n:
        yield out()


def _logs(keys: list[np.ndarray], known: tuple[np.ndarray, np.ndarray], order: int, inside: bool):
    """For each text the sum of its logs without those of N, and how many times log N is to be taken off.

    ``known`` has the count of every n-gram of the texts, sorted by key.
    """
    n_words = sum(map(len, keys))
    doc = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    value, open_, less = np.zeros(n_words), np.ones(n_words, dtype=bool), np.zeros(n_words, dtype=bool)
    counts = []
    for key, ends in _grams(keys, order):
        own, at = np.unique(key, return_inverse=True)
        here = known[1][np.searchsorted(known[0], own)][at]
        if inside:  # less those of the document itself
            _, pair, times = np.unique(doc[ends] * len(own) + at, return_inverse=True, return_counts=True)
            here = here - times[pair]
        full = np.zeros(n_words, dtype=np.int64)
        full[ends] = here
        counts.append((full, ends))
    for n in range(order, 0, -1):
        here, ends = counts[n - 1]
        tried = np.zeros(n_words, dtype=bool)
        tried[ends] = True
        hit = open_ & tried & (here > 0)
        value[hit] += np.log(here[hit])
        if n > 1:
            value[hit] -= np.log(counts[n - 2][0][np.flatnonzero(hit) - 1])
            value[open_ & tried & ~hit] += math.log(BACKOFF)
        else:
            value[open_ & ~hit] += math.log(BACKOFF)
            less = open_.copy()
        open_ &= ~hit
    add = lambda x: np.bincount(doc, weights=x, minlength=len(keys))
    return add(value), add(less).astype(np.int64)


def _parts(keys: list[np.ndarray]):
    """Runs of documents of about ``_PART`` words."""
    held, n = [], 0
    for k in keys:
        held.append(k)
        n += len(k)
        if n >= _PART:
            yield held
            held, n = [], 0
    if held:
        yield held


def scores(docs: DataFrame, corpus: DataFrame | None = None, text_col: str = "text", id_col: str = "doc_id", order: int = ORDER, size: int = BLOCK) -> DataFrame:
    """``(id_col, n_words, score)`` for every row of ``docs``, by the counts of ``corpus``.

    Without a corpus the documents are it, each scored by all the others. ``order`` is
    the longest n-gram's length.
    """
    if order < 1:
        raise ValueError("order must be 1 or more")
    scratch = Scratch(docs.sparkSession, "lm")
    inside = corpus is None
    docs = repeatable(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), scratch)
    n_buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = exploded(docs.select("text"), order, size, n_buckets)
    if inside:
        known = own.withColumn("total", F.sum("n").over(Window.partitionBy("key", "bucket"))).where("total > n")
    else:
        counts = exploded(corpus.select(F.col(text_col).cast("string")), order, size, n_buckets).groupBy("bucket", "key").agg(F.sum("n").alias("total"))
        known = own.join(counts, ["bucket", "key"])
    known = known.select("block", "at", "total").mapInArrow(_packed, "block bigint, at array<bigint>, total array<bigint>")

    def deal(batches):
        """Blocks' documents, packed by Arrow into rows of about ``_PACK`` bytes of text."""
        dealt = _Numbers(size)
        for batch in batches:
            blocks = [dealt.next(len(word_keys(t))) for t in batch.column(1)]
            upto = np.cumsum([len(t.as_buffer()) if t.is_valid else 0 for t in batch.column(1)])
            cut = np.flatnonzero(np.diff(blocks) != 0) + 1
            cut = np.union1d(cut, np.flatnonzero(np.diff(upto // _PACK) != 0) + 1)
            for a, b in zip([0, *cut], [*cut, batch.num_rows], strict=True):
                if b > a:
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                        w.write_batch(batch.slice(a, b - a))
                    yield pa.RecordBatch.from_arrays([pa.array([blocks[a]], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "docs"])

    def score(packed, grams):
        tables = [pa.ipc.open_stream(x.as_buffer()).read_all() for x in packed.column("docs")]
        if not tables:
            return pa.table({"id": pa.nulls(0, id_arrow), "n_words": pa.array([], pa.int64()), "logs": pa.array([], pa.float64()), "less": pa.array([], pa.int64())})
        texts = pa.concat_tables(tables)
        keys = [word_keys(t) for t in texts.column("text")]
        key, _, total = _counted(keys, order, n_buckets)
        if not inside:
            total[:] = 0
        for at, n in zip(grams.column("at").chunks, grams.column("total").chunks, strict=True):
            total[at.flatten().to_numpy()] = n.flatten().to_numpy()
        by = np.argsort(key)
        counts = key[by], total[by]
        found = [_logs(some, counts, order, inside) for some in _parts(keys)]
        logs, less = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table({"id": texts.column("id"), "n_words": pa.array(list(map(len, keys)), pa.int64()), "logs": logs, "less": less})

    id_type = docs.schema["id"].dataType.simpleString()
    id_arrow = to_arrow_type(docs.schema["id"].dataType)
    texts = docs.mapInArrow(deal, "block bigint, docs binary")
    found = texts.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(score, f"id {id_type}, n_words bigint, logs double, less bigint")
    found = scratch.keep(found, "logs")
    if inside:
        n = found.agg(F.sum("n_words")).first()[0] or 0
        others = F.lit(n) - F.col("n_words")
    else:
        others = F.lit(corpus.select(F.sum(F.regexp_count(F.col(text_col).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")))).first()[0] or 0)
    mean = (F.col("logs") - F.col("less") * F.log(F.nullif(others, F.lit(0)).cast("double"))) / F.col("n_words")
    return found.select(F.col("id").alias(id_col), "n_words", F.when(F.col("n_words") > 0, F.round(mean, 6)).alias("score"))
