"""SimHash near-duplicates: fingerprints, a binary trie self-join, components.

Fingerprints: a text's A-Z are lower-cased, its words (runs of bytes other than
space and 0x09-0x0D) form shingles of ``shingle`` words joined by a space,
repeats included; a text of fewer words is one shingle, one without words has
fingerprint 0. A bit is 1 if it is set in over half the shingles' XXH64 values
(seed 42). Null texts count as empty.

Links: two fingerprints link at ``max_dist`` or fewer differing bits. They are
found by walking a binary trie against itself. A pair of nodes of equal depth
carries the bits in which their prefixes differ; a pair over the budget is cut
with all below it. By the pigeonhole principle two linked fingerprints agree on
one of ``max_dist + 1`` blocks of bits, so the walk runs over that many tries,
each with another block rotated to the top, and starts at the pairs (node, same
node) at the depth of that block with nothing spent. Pairs of nodes that hold
few fingerprints are opened to their leaves. Every step is a join of node pairs
with children, spread by node; a crowded prefix only makes more node pairs, and only
the leaves below pairs that are still open go down to the next step.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import BROADCAST_ROWS, Scratch, is_empty
from plumbline.llm.components import connected_components

BITS = 64
#: Bits that a node pair descends in one step.
STRIDE = 4
#: Node pairs with at most this many leaf pairs are opened to their leaves.
LEAF_PAIRS = 1024
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BLOCK = 1 << 15


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The 64-bit fingerprint of a UTF-8 text, unsigned."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    if len(words) < shingle:
        parts = [b" ".join(words)]
        n = 1
    else:
        parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
        n = len(words) - shingle + 1
    h = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(42)), dtype="<u8", count=n)
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, n, _BLOCK):
        part = h[i : i + _BLOCK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > n, bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = 3) -> DataFrame:
    """``(id_col, key, fp)`` for every row: a hash of the text, and its fingerprint as a signed long."""
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, key bigint, fp bigint"

    def run(batches):
        for batch in batches:
            texts = batch.column(2)
            fps = np.fromiter(
                (fingerprint(t.as_buffer().to_pybytes(), shingle) if t.is_valid else 0 for t in texts),
                dtype=np.uint64,
                count=len(texts),
            )
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], names=[id_col, "key", "fp"])

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col), F.xxhash64(text), text).mapInArrow(run, schema)


def _sent(df: DataFrame, rows: int) -> DataFrame:
    """A table of known, small size is sent to every task, which spares the other side a shuffle."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _prefix(key, depth: int):
    return F.shiftrightunsigned(key, BITS - depth)


def hamming_links(fps: DataFrame, scratch: Scratch, max_dist: int = 2) -> DataFrame:
    """Pairs ``(u, v)``, ``u < v``, of the distinct longs ``fps.fp`` at ``max_dist`` or fewer differing bits."""
    tries = max_dist + 1
    depth = BITS // tries
    rot = F.explode(F.array(*(F.lit(i * depth) for i in range(tries)))).alias("rot")
    trie = fps.select("fp", rot).select("rot", "fp", F.expr("(fp << rot) | case when rot = 0 then 0L else shiftrightunsigned(fp, 64 - rot) end").alias("key"))
    trie = scratch.keep(trie, "trie")
    links = None
    pairs = (
        trie.groupBy("rot", _prefix(F.col("key"), depth).alias("a"))
        .agg(F.count("*").alias("na"))
        .where("na > 1")
        .select("rot", "a", F.col("a").alias("b"), "na", F.col("na").alias("nb"), F.lit(0).alias("d"))
    )
    while True:
        pairs = scratch.keep(pairs, "pairs")
        few = F.col("na") * F.col("nb") <= LEAF_PAIRS
        leaf = trie.select("rot", "fp", "key", _prefix(F.col("key"), depth).alias("p"))
        left = leaf.select("rot", F.col("p").alias("a"), F.col("fp").alias("u"), F.col("key").alias("ku"))
        right = leaf.select("rot", F.col("p").alias("b"), F.col("fp").alias("v"), F.col("key").alias("kv"))
        n_pairs, n_left = pairs.where(few).agg(F.count("*"), F.coalesce(F.sum("na"), F.lit(0))).first()
        opened = _sent(pairs.where(few).select("rot", "a", "b"), n_pairs).join(left, ["rot", "a"])
        opened = _sent(opened, n_left).alias("l").join(
            right.alias("r"),
            F.expr(f"l.rot = r.rot and l.b = r.b and bit_count(l.ku ^ r.kv) <= {max_dist} and (l.a <> r.b or l.u < r.v)"),
        )
        found = opened.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        links = found if links is None else links.union(found)
        many = pairs.where(~few)
        if is_empty(many):
            return links.distinct()
        # only the leaves below open pairs are carried down
        ends = many.select("rot", F.explode(F.array("a", "b")).alias("p")).distinct()
        below = trie.withColumn("p", _prefix(F.col("key"), depth)).join(_sent(ends, ends.count()), ["rot", "p"], "left_semi")
        trie = scratch.keep(below.drop("p"), "trie")
        deeper = min(depth + STRIDE, BITS)
        child = trie.groupBy("rot", _prefix(F.col("key"), depth).alias("p"), _prefix(F.col("key"), deeper).alias("c")).agg(F.count("*").alias("n"))
        kids_a = child.select("rot", F.col("p").alias("a"), F.col("c").alias("ca"), F.col("n").alias("nca"))
        kids_b = child.select("rot", F.col("p").alias("b"), F.col("c").alias("cb"), F.col("n").alias("ncb"))
        mask = (1 << (deeper - depth)) - 1
        spent = f"l.d + bit_count((l.ca ^ r.cb) & {mask}L)"
        pairs = (
            many.select("rot", "a", "b", "d").join(kids_a, ["rot", "a"]).alias("l")
            .join(kids_b.alias("r"), F.expr(f"l.rot = r.rot and l.b = r.b and {spent} <= {max_dist} and (l.a <> r.b or l.ca <= r.cb)"))
            .where("l.ca <> r.cb or nca > 1")
            .select("l.rot", F.col("l.ca").alias("a"), F.col("r.cb").alias("b"), F.col("nca").alias("na"), F.col("ncb").alias("nb"), F.expr(spent).alias("d"))
        )
        depth = deeper


def _classes(docs: DataFrame, scratch: Scratch, text_col: str, id_col: str, shingle: int, max_dist: int) -> DataFrame:
    """``(id_col, key, fp, component_id, n_links, class)`` for every row."""
    rows = scratch.keep(fingerprints(docs, text_col, id_col, shingle), "fingerprints")
    own = scratch.keep(rows.groupBy("fp").agg(F.min(id_col).alias("rep")), "distinct")
    links = scratch.keep(hamming_links(own.select("fp"), scratch, max_dist), "links")
    root = scratch.keep(connected_components(links, scratch), "roots")
    degree = links.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    linked = own.join(root, own.fp == root.node).select("fp", "rep", "root")
    low = linked.groupBy("root").agg(F.min("rep").alias("component_id"))
    linked = linked.join(low, "root").join(degree, F.col("fp") == degree.node).select("fp", "component_id", "n_links", "root")
    classes = own.join(linked, "fp", "left").select(
        "fp", F.coalesce("component_id", "rep").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("root", "fp").alias("class")
    )
    classes = scratch.keep(classes, "classes")  # a join of two plain tables: a fingerprint of very many rows can be split
    return rows.join(classes, "fp").select(id_col, "key", "fp", "component_id", "n_links", "class")


def near_duplicates(
    docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = 3, max_dist: int = 2
) -> DataFrame:
    """``(id_col, fp, component_id, n_links)`` for every row of ``docs``.

    ``component_id`` is the smallest id reachable over links, itself included (null
    ids are passed over); ``n_links`` counts the other fingerprints linked to the
    row's own. Rows of equal fingerprint share a class; a repeated row gets a row
    each; an empty table gives an empty result; other columns are not read.
    """
    return _classes(docs, Scratch(docs.sparkSession, "simhash"), text_col, id_col, shingle, max_dist).drop("key", "class")


def keep_one(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = 3, max_dist: int = 2) -> DataFrame:
    """The rows of ``docs`` that stay when each class of near-duplicates keeps one row.

    That is one of its least id, null ids last, and of several texts under that id the
    one of least hash; of repeated rows one stays. The rows to drop are looked up, so
    that while they are few the documents themselves are not shuffled.
    """
    scratch = Scratch(docs.sparkSession, "simhash-keep")
    return keep_least(docs, _classes(docs, scratch, text_col, id_col, shingle, max_dist), scratch, text_col, id_col)


def keep_least(docs: DataFrame, rows: DataFrame, scratch: Scratch, text_col: str, id_col: str) -> DataFrame:
    """``keep_one`` by the classes ``rows(id_col, key, class)``; the other tables of ``scratch`` are deleted."""
    per = scratch.keep(rows.groupBy("class", F.col(id_col).alias("__id"), F.col("key").alias("__key")).agg(F.count("*").alias("__n")), "texts")
    least = per.groupBy("class").agg(F.min(F.struct(F.col("__id").isNull().alias("none"), "__id", "__key")).alias("w"))
    least = least.select(F.col("w.__id").alias("__wid"), F.col("w.__key").alias("__wkey"), F.lit(True).alias("__stays"))
    per = per.join(least, F.expr("__id <=> __wid and __key = __wkey"), "left").where("__stays is null or __n > 1")
    per = scratch.keep(per.select("__id", "__key", F.when(F.col("__stays"), F.col("__n")).otherwise(0).alias("__n")), "not-once")
    scratch.drop_but(per)  # the result reads no other
    n_drop = per.count()
    key = F.xxhash64(F.col(text_col).cast("string"))
    on = F.col(id_col).eqNullSafe(F.col("__id")) & (key == F.col("__key"))
    out = docs.join(_sent(per, n_drop), on, "left_anti")
    again = per.where("__n > 1")
    if is_empty(again):
        return out
    more = docs.join(_sent(again, n_drop), on, "left_semi")
    first = Window.partitionBy(id_col, key).orderBy(F.lit(0))
    return out.union(more.withColumn("__rn", F.row_number().over(first)).where("__rn = 1").drop("__rn"))
